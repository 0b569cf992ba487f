"""Signatures of texts, and groups of rows whose signatures differ in few bits.

``near_groups`` finds every pair of signatures within ``threshold`` bits without comparing all of them.
Equal signatures become one node. Cut into ``threshold + 1`` pieces, two signatures that differ in no
more bits than ``threshold`` agree in a whole piece, so nodes meet by (piece, value) alone: a bucket.

* In each bucket the nodes within the threshold of its least node are linked to it. A dense bucket (many
  near copies of one page) is settled by that, with one link a node.
* After the first components, only buckets that hold several components are looked at again. A bucket of
  more than ``most`` nodes is cut by the pieces of the bits left over, again and again.
* What is still larger is dealt into blocks, and pairs of blocks are compared in tasks of their own; blocks
  of one component aren't. A task returns no more links than it joins components.

Results are groups and each row's distance to its group's first row, not pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import settled
from .components import components
from .sequence import hamming
from .skew import salted_join, uneven_join

#: Nodes of a bucket compared in one task.
MOST = 4096
#: How often a large bucket is cut by further pieces before it is dealt into blocks.
DEPTH = 3
WORD_BITS = 64
#: Hashes of a text counted at once.
BLOCK = 4096


def text_fingerprint(text: Column, bits: int = 64) -> Column:
    """Signature of a text as 64-bit words: a bit is set if most of its bigrams' hashes have it set.

    Like texts get signatures that differ in few bits. Words are parted by ASCII blanks and A-Z is in lower
    case; a text of one word has that word instead of pairs. The hash is the leading part of MD5 (64 or 128
    bits). A null text, or one without words, has no signature (null).
    """
    if bits not in (64, 128):
        raise ValueError("a fingerprint has 64 or 128 bits")
    size, block, result = bits // 8, BLOCK, "array<bigint>"

    def fingerprint(data: bytes | None) -> list[int] | None:
        words = data.lower().split() if data else []
        if not words:
            return None
        features = [b" ".join(pair) for pair in zip(words, words[1:])] or words
        counts = np.zeros(bits, "i8")
        for begin in range(0, len(features), block):
            hashes = b"".join([hashlib.md5(f, usedforsecurity=False).digest()[:size] for f in features[begin : begin + block]])
            counts += np.unpackbits(np.frombuffer(hashes, "u1")).reshape(-1, bits).sum(axis=0, dtype="i8")
        # A hash's first bit is the highest of its first word.
        high = (2 * counts > len(features)).reshape(-1, WORD_BITS)[:, ::-1]
        return np.packbits(high, axis=1, bitorder="little").view("<i8").ravel().tolist()

    @F.pandas_udf(result)
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(data) for data in texts], dtype="object")

    return fingerprints(text.cast("binary"))


def bit_text(signature: Column, bits: int) -> Column:
    """The bits of a signature as text, lowest first."""
    word = lambda w: F.reverse(F.lpad(F.conv(w.cast("string"), 10, 2), WORD_BITS, "0"))
    return F.substring(F.array_join(F.transform(signature, word), ""), 1, bits)


def cut(rows: DataFrame, length: int, pieces: int) -> tuple[DataFrame, int]:
    """Rows once for each piece of ``rest``, with the piece in the key; and the least number of bits left."""
    sizes = [length // pieces + (i < length % pieces) for i in range(pieces)]
    begins = [sum(sizes[:i]) for i in range(pieces)]
    ways = F.array(*(
        F.struct(
            F.xxhash64("key", F.lit(i), F.substring("rest", begin + 1, size)).alias("key"),
            F.concat(F.substring("rest", 1, begin), F.substring("rest", begin + size + 1, length)).alias("rest"),
        )
        for i, (begin, size) in enumerate(zip(begins, sizes))
        if size
    ))
    return rows.select("node", "signature", "label", F.explode(ways).alias("way")).select(
        "node", "signature", "label", "way.*"
    ), length - sizes[0]


def star_links(rows: DataFrame, threshold: int) -> DataFrame:
    """Links of each bucket's least node with the nodes like it."""
    first = rows.groupBy("key").agg(F.min(F.struct("node", "signature")).alias("first"), F.count("*").alias("n"))
    met = salted_join(rows.select("key", "node", "signature"), first.where("n > 1").drop("n"), "key", "node")
    like = (F.col("node") != F.col("first.node")) & (hamming(F.col("signature"), F.col("first.signature")) <= threshold)
    return met.where(like).select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct()


def labelled(links: DataFrame) -> DataFrame:
    """The least node that each linked node reaches: ``node, label``."""
    both = links.select(F.lit(0).alias("gid"), "a", "b").unionByName(
        links.select(F.lit(0).alias("gid"), F.col("b").alias("a"), F.col("a").alias("b"))
    ).distinct()
    nodes = both.select("gid", F.col("a").alias("id")).distinct()
    return components(nodes, both).select(F.col("id").alias("node"), "label")


def open_buckets(rows: DataFrame) -> DataFrame:
    """Buckets that hold several components: ``key, n``."""
    found = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    return found.where("low < high").select("key", "n")


def block_links(rows: DataFrame, sizes: DataFrame, threshold: int, most: int) -> DataFrame:
    """Links between components of a bucket, found by pairs of its blocks.

    A component larger than a block is dealt into blocks of its own, the others share blocks; two blocks
    of the same large component aren't compared.
    """
    own = salted_join(rows, sizes, "key", "node")
    large = own.groupBy("key", "label").agg(F.count("*").alias("_members")).where(F.col("_members") > most)
    dealt = salted_join(own, large, ["key", "label"], "node", "left")
    block = F.when(
        F.col("_members").isNotNull(),
        F.struct(F.col("label").alias("of"), F.pmod(F.xxhash64("node"), F.ceil(F.col("_members") / most)).alias("number")),
    ).otherwise(
        F.struct(F.lit(None).cast("bigint").alias("of"), F.pmod(F.xxhash64("label"), F.ceil(F.col("n") / most)).alias("number"))
    )
    dealt = dealt.withColumn("block", block).select("key", "node", "label", "signature", "block")
    blocks = dealt.select("key", "block").distinct()
    ahead = blocks.select("key", F.col("block").alias("other"))
    pairs = blocks.join(ahead, "key").where(
        (F.col("block") <= F.col("other"))
        & ~((F.col("block.of") == F.col("other.of")) & F.col("block.of").isNotNull()).eqNullSafe(True)
    )
    pairs = pairs.withColumn("pair", F.xxhash64("key", "block", "other"))
    sides = pairs.select(
        "key", "pair", F.explode(F.array_distinct(F.array("block", "other"))).alias("block"), F.col("block").alias("_first"),
    )
    sent = dealt.join(sides, ["key", "block"]).select(
        "key", "pair", "node", "label", "signature", (F.col("block") == F.col("_first")).alias("first")
    )

    # Many pairs are small, so a task runs through its sorted rows instead of one call a pair.
    ordered = sent.repartition("key", "pair").sortWithinPartitions("key", "pair", F.desc("first"), "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["key", "pair"]):
            words = np.array(group["signature"].to_pylist(), "i8").view("u8")
            found = list(linked(*(np.array(group[c]) for c in ("node", "label", "first")), words, threshold))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    return ordered.mapInArrow(compare, "a bigint, b bigint")


def groups_of(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Runs of sorted rows that agree in ``by``; a run is held whole, whatever the batches."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        marks = np.stack([np.array(table[c]) for c in by])
        cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), table.num_rows]
        if held and any(held[-1][c][-1].as_py() != table[c][0].as_py() for c in by):
            yield pa.concat_tables(held)
            held = []
        for begin, end in zip(cuts, cuts[1:]):
            held.append(table.slice(begin, end - begin))
            if end < table.num_rows:
                yield pa.concat_tables(held)
                held = []
    if held:
        yield pa.concat_tables(held)


def linked(
    nodes: np.ndarray, label: np.ndarray, first: np.ndarray, words: np.ndarray, threshold: int
) -> Iterator[tuple[int, int]]:
    """One link for each two components that get joined; rows of the first block stand in front."""
    label = label.copy()
    front = int(first.sum())
    for i in range(front):
        # A block meets itself, or only the other one.
        begin = i + 1 if front == len(nodes) else front
        near = np.bitwise_count(words[begin:] ^ words[i]).sum(axis=1, dtype="i4") <= threshold
        for j in (begin + np.flatnonzero(near & (label[begin:] != label[i]))).tolist():
            if label[j] != label[i]:
                yield int(nodes[i]), int(nodes[j])
                label[label == label[j]] = label[i]


def near_groups(
    df: DataFrame,
    id_col: str,
    signature: str,
    bits: int = 64,
    threshold: int = 5,
    *,
    most: int = MOST,
    depth: int = DEPTH,
) -> DataFrame:
    """``id_col, group_id, n_members, distance``: one row per row of the input.

    Rows are of one group if signatures within ``threshold`` bits lead from one to the other. ``group_id``
    is the group's least id, ``distance`` the bits in which a row differs from that of this id (the
    least signature, if several rows have it). A row without a signature is alone (``distance`` null).
    Ids are whole numbers; rows without one are left out.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(signature).alias("signature")).where("id IS NOT NULL")
    # Read several times: a signature may be dear, its row is narrow.
    rows = settled(rows)
    nodes = settled(
        rows.where("signature IS NOT NULL").groupBy("signature").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
        # An id may have several signatures, so nodes have numbers of their own.
        .withColumn("node", F.monotonically_increasing_id())
    )
    whole = nodes.select(
        "node", "signature", F.col("node").alias("label"), F.lit(0).cast("bigint").alias("key"),
        bit_text(F.col("signature"), bits).alias("rest"),
    )
    level, left = cut(whole, bits, threshold + 1)
    links = settled(star_links(level, threshold))
    known = labelled(links)
    level = settled(
        level.drop("label").join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))
    )
    found = [links]
    for step in range(depth + 1):
        sizes = open_buckets(level)
        last = step == depth or left <= threshold
        ready = sizes if last else sizes.where(F.col("n") <= most)
        found.append(block_links(level, ready, threshold, most))
        if last:
            break
        large = salted_join(level, sizes.where(F.col("n") > most).drop("n"), "key", "node")
        level, left = cut(large, left, threshold + 1)
        level = settled(level)
        if level.isEmpty():
            break
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    joined = labelled(settled(every.distinct()))
    single = nodes.join(joined, "node", "left_anti").select(
        "signature", "copies", F.col("least").alias("group_id"), F.col("copies").alias("n_members"),
        F.lit(0).cast("bigint").alias("distance"),
    )
    named = nodes.join(joined, "node")
    firsts = named.groupBy("label").agg(
        F.sum("copies").alias("n_members"), F.min(F.struct("least", "signature")).alias("first")
    )
    grouped = salted_join(named.select("signature", "copies", "label"), firsts, "label", "signature").select(
        "signature", "copies", F.col("first.least").alias("group_id"), "n_members",
        hamming(F.col("signature"), F.col("first.signature")).alias("distance"),
    )
    placed = single.unionByName(grouped)
    out = uneven_join(rows.where("signature IS NOT NULL"), placed, "signature", "id", F.col("copies") > most).select(
        F.col("id").alias(id_col), "group_id", "n_members", "distance"
    )
    alone = rows.where("signature IS NULL").select(
        F.col("id").alias(id_col), F.col("id").alias("group_id"), F.lit(1).cast("bigint").alias("n_members"),
        F.lit(None).cast("bigint").alias("distance"),
    )
    return out.unionByName(alone)
