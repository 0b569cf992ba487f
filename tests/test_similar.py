"""Fingerprints and groups of like signatures against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio_spark.operators import similar as M


def signed(number):
    return number - (1 << 64) if number >> 63 else number


def brute_fingerprint(text, words=1):
    own = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    features = own if len(own) < 2 else [f"{a} {b}" for a, b in zip(own, own[1:])]
    if not features:
        return None
    out = []
    for n in range(words):
        hashes = [int(hashlib.md5(f.encode()).hexdigest()[16 * n : 16 * n + 16], 16) for f in features]
        out.append(signed(sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))))
    return out


def test_fingerprint(spark):
    texts = [None, "", " \n\t", "one", "One  ONE", "a b", "a b a b", "ünïcode words here", "x " * 5000, "A\x0bB\x0cc d e f g"]
    rows = [(i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "id int, t string").select(
        "id", "t", M.text_fingerprint(F.col("t")).alias("one"), M.text_fingerprint(F.col("t"), 128).alias("two")
    )
    for r in frame.withColumn("shown", M.bit_text(F.col("two"), 128)).collect():
        assert r.one == brute_fingerprint(r.t) and r.two == brute_fingerprint(r.t, 2)
        if r.two:
            assert r.shown == "".join(format(w & (1 << 64) - 1, "064b")[::-1] for w in r.two)
    with pytest.raises(ValueError):
        M.text_fingerprint(F.col("t"), 100)


def brute_groups(rows, threshold):
    """Rows (id, signature): group, members and distance by comparing all pairs."""
    known = [(i, s) for i, s in rows if i is not None and s is not None]
    parent = list(range(len(known)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(known)):
        for b in range(a):
            if sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(known[a][1], known[b][1])) <= threshold:
                parent[find(a)] = find(b)
    groups = {}
    for k, (i, s) in enumerate(known):
        groups.setdefault(find(k), []).append((i, s))
    out = [(i, i, 1, None) for i, s in rows if i is not None and s is None]
    for members in groups.values():
        first, base = min(members)
        for i, s in members:
            out.append((i, first, len(members), sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(s, base))))
    return sorted(out, key=repr)


def found(frame):
    return sorted(((r.id, r.group_id, r.n_members, r.distance) for r in frame.collect()), key=repr)


def flipped(rng, words, most):
    words = list(words)
    for _ in range(rng.randrange(most + 1)):
        place = rng.randrange(64 * len(words))
        words[place // 64] = signed((words[place // 64] & (1 << 64) - 1) ^ 1 << place % 64)
    return words


@pytest.mark.parametrize(("words", "most", "depth"), [(1, 4096, 3), (2, 15, 2)])
def test_near_groups(spark, words, most, depth):
    """A third of all rows in one group of near copies, chains, exact copies, hot pieces, and rows alone."""
    rng = random.Random(words * 100 + most)
    fresh = lambda: [signed(rng.getrandbits(64)) for _ in range(words)]
    centre, rows = fresh(), []
    rows += [flipped(rng, centre, 4) for _ in range(150)]
    for _ in range(20):
        own = fresh()
        rows += [flipped(rng, own, 3) for _ in range(5)]
    chain = fresh()
    for _ in range(30):  # a chain: neighbours are alike, its ends aren't
        chain = flipped(rng, chain, 5)
        rows.append(chain)
    low = [signed(rng.getrandbits(12) << 50) for _ in range(80)]  # alike in most pieces
    rows += [[x, *[0] * (words - 1)] for x in low]
    rows += [fresh() for _ in range(60)] + [rows[0]] * 40 + [None, None]
    rng.shuffle(rows)
    table = [(i, s) for i, s in enumerate(rows)] + [(None, centre), (None, None)]
    frame = spark.createDataFrame(table, "id long, s array<bigint>").repartition(5)
    got = found(M.near_groups(frame, "id", "s", 64 * words, 5, most=most, depth=depth))
    assert got == brute_groups(table, 5)


def test_near_groups_of_nothing(spark):
    frame = spark.createDataFrame([], "id long, s array<bigint>")
    assert M.near_groups(frame, "id", "s").count() == 0


def test_repeated_ids(spark):
    table = [(1, [7]), (1, [7]), (1, [-1]), (2, [6]), (3, [-2]), (9, [1 << 40])]
    frame = spark.createDataFrame(table, "id long, s array<bigint>")
    assert found(M.near_groups(frame, "id", "s")) == brute_groups(table, 5)


def test_a_dense_bucket_returns_one_link_a_component():
    """A task names one link for each two components joined, not all pairs."""
    n = 300
    words = np.array([[i % 8] for i in range(n)], "u8")
    numbers = np.arange(n)
    assert len(list(M.linked(numbers, numbers, np.ones(n, bool), words, 5))) == n - 1


def test_runs_over_batches():
    """Runs of equal keys are whole, however the rows are cut into batches."""
    key = [1] * 5 + [2] + [3] * 4 + [4] * 2
    for size in (1, 2, 3, 5, 20):
        batches = [
            pa.RecordBatch.from_pydict({"key": key[i : i + size], "pair": [0] * len(key[i : i + size])})
            for i in range(0, len(key), size)
        ]
        assert [g["key"].to_pylist() for g in M.groups_of(iter(batches), ["key", "pair"])] == [[1] * 5, [2], [3] * 4, [4] * 2]
