"""N-gram Jaccard join with signature trees.

A document's set is its distinct five-word shingles, as 64-bit hashes; two documents link when their
sets' Jaccard similarity reaches the threshold. The join is exact up to hash collisions.

1. Shingles travel in packed blocks by hash range. A task sends a set that it has met before only
   once, so copies of a text cost next to nothing. In each range the shingles that at least two
   different sets hold are found, and each set gets back its shared shingles with the number of sets
   that hold them. The other shingles cannot be in any intersection.
2. A set with less than the threshold's share of shared shingles links with nothing. Of the others,
   two that link have a shingle in common among the first ``n - needed + 1`` of each in the order of
   rarity (the sets' own shingles come first in it). Sets that meet in such a shingle, directly or
   through others, form a cluster; every link lies within a cluster.
3. Each cluster is joined by a signature tree: leaves hold a few sets, nodes the OR of their token
   bitmaps and the range of their sizes. A dual traversal descends into pairs of nodes and prunes a
   pair by size, by the largest overlap that the bitmaps allow, and when all its sets are in one
   component already. At the leaves intersections are counted exactly. Clusters too large for a task
   are cut into chunks of like size; the pairs of chunks that the size range allows are the tree's
   upper level, dealt to tasks.
4. Links join sets to components; copies get their set's component.

Cases: a null or empty text, or one without words, has no set and is a component of its own; rows
that share a text are copies; rows that share an id have the same component if their texts link; a
null id is never a component's id unless all its rows have none. Ties cannot arise: a component's id
is its least document id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from folio_spark.llm.common import as_bytes, byte_lengths, give_back, salted_join, slices, written
from folio_spark.llm.graph import components
from folio_spark.llm.shingles import U64, mix, shingles

#: Bytes of text whose shingles are packed together, and shingles that one hash range should hold.
SEGMENT = 8 << 20
RANGE = 1_500_000
#: Shared shingles that one task joins at a time.
CLUSTER = 1_000_000
LEAF, FAN = 16, 4

PACKED = (
    "slot int, doc_ids array<long>, doc_sets array<long>, doc_sizes array<long>, "
    "sets binary, sizes binary, hashes binary, owners binary"
)
SPLIT = "doc_id long, fp long, n long, hashes binary, holders binary"


def packed_hashes(hashes: np.ndarray, base: int) -> bytes:
    """Sorted hashes as differences of six bytes each where they fit, else plain."""
    steps = np.diff(hashes, prepend=U64(base))
    if len(steps) and int(steps.max()) >= 1 << 48:
        return hashes.tobytes()
    return steps.astype("<u4").tobytes() + (steps >> U64(32)).astype("<u2").tobytes()


def unpacked_hashes(data: bytes, count: int, base: int) -> np.ndarray:
    if len(data) == 8 * count:
        return np.frombuffer(data, U64)
    low = np.frombuffer(data, "<u4", count).astype(U64)
    high = np.frombuffer(data, "<u2", count, 4 * count).astype(U64)
    return np.cumsum(low | (high << U64(32)), dtype=U64) + U64(base)


def binaries(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value for each count of consecutive items."""
    ends = np.concatenate([[0], np.cumsum(counts * data.itemsize)]).astype("i4")
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())])


def packed_sets(ids: list, texts: list[bytes], width: int, bits: int, met: set[int]) -> pa.RecordBatch:
    """Rows of one segment: its documents in one of them, its shingles by hash range.

    ``met``: sets that this task has sent already.
    """
    hashes, owners = shingles(texts, width)
    order = np.argsort(hashes, kind="stable")
    sorted_hashes, sorted_owners = hashes[order], owners[order]
    first = np.ones(len(order), bool)
    first[1:] = (sorted_hashes[1:] != sorted_hashes[:-1]) | (sorted_owners[1:] != sorted_owners[:-1])
    sizes = np.bincount(sorted_owners[first], minlength=len(texts))
    sums = np.zeros(len(texts), U64)
    if len(hashes):
        once = np.zeros(len(order), bool)
        once[order[first]] = True
        begins = np.flatnonzero(np.diff(owners, prepend=-1))
        sums[owners[begins]] = np.add.reduceat(np.where(once, mix(hashes ^ U64(0x5851F42D4C957F2D)), U64(0)), begins)
    sets = mix(sums + sizes.astype(U64)).view("i8")
    new = np.zeros(len(texts), bool)
    for i, (fp, size) in enumerate(zip(sets.tolist(), sizes.tolist())):
        if size and fp not in met:
            met.add(fp)
            new[i] = True
    first &= new[sorted_owners] if len(new) else first
    sorted_hashes, sorted_owners = sorted_hashes[first], sorted_owners[first]
    slots = 1 << bits
    cuts = np.searchsorted(sorted_hashes, np.arange(1, slots, dtype=U64) << U64(64 - bits)) if bits else []
    edges = [0, *np.asarray(cuts).tolist(), len(sorted_hashes)]
    # Documents go along with a range that their segment's content picks.
    home = int(sets[0].astype(U64) if len(sets) else 0) % slots
    rows = []
    for slot in range(slots):
        a, b = edges[slot], edges[slot + 1]
        if a == b and slot != home:
            continue
        own, place = np.unique(sorted_owners[a:b], return_inverse=True)
        kind = "<u2" if len(own) < 1 << 16 else "<u4"
        rows.append(
            (
                slot,
                ids if slot == home else None,
                sets.tolist() if slot == home else None,
                sizes.tolist() if slot == home else None,
                sets[own].tobytes(),
                sizes[own].astype("<i8").tobytes(),
                packed_hashes(sorted_hashes[a:b], slot << (64 - bits) if bits else 0),
                place.astype(kind).tobytes(),
            )
        )
    many = pa.list_(pa.int64())
    types = [pa.int32(), many, many, many, pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    names = ["slot", "doc_ids", "doc_sets", "doc_sizes", "sets", "sizes", "hashes", "owners"]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)


def shared_shingles(group: pa.Table, bits: int) -> pa.Table:
    """Documents of a hash range's rows, and the shingles of each set that other sets hold too."""
    empty = [np.zeros(0, "i8")]
    ids, doc_sets, doc_sizes = [], [], []
    hashes, owners, sets, sizes, base = [np.zeros(0, U64)], [np.zeros(0, "i4")], list(empty), list(empty), 0
    columns = [group.column(n).to_pylist() for n in group.schema.names]
    for slot, own_ids, own_sets, own_sizes, fps, ns, packed, places in zip(*columns):
        if own_ids is not None:
            ids += own_ids
            doc_sets += own_sets
            doc_sizes += own_sizes
        known = np.frombuffer(fps, "<i8")
        if not len(known):
            continue
        wide = "<u2" if len(known) < 1 << 16 else "<u4"
        place = np.frombuffer(places, wide)
        hashes.append(unpacked_hashes(packed, len(place), slot << (64 - bits) if bits else 0))
        owners.append(place.astype("i4") + np.int32(base))
        sets.append(known)
        sizes.append(np.frombuffer(ns, "<i8"))
        base += len(known)
    hashes, owners = np.concatenate(hashes), np.concatenate(owners)
    fps, first, same = np.unique(np.concatenate(sets), return_index=True, return_inverse=True)
    ns = np.concatenate(sizes)[first]
    order = np.argsort(hashes, kind="stable")
    hashes, owners = hashes[order], same[owners[order]]
    equal = hashes[1:] == hashes[:-1]
    repeated = np.zeros(len(hashes), bool)
    repeated[1:] |= equal
    repeated[:-1] |= equal
    hashes, owners = hashes[repeated], owners[repeated]
    order = np.lexsort((owners, hashes))
    hashes, owners = hashes[order], owners[order]
    once = np.ones(len(hashes), bool)
    once[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    hashes, owners = hashes[once], owners[once]
    _, place, holders = np.unique(hashes, return_inverse=True, return_counts=True)
    holders = holders[place] if len(hashes) else np.zeros(0, "i8")
    several = holders > 1
    hashes, owners, holders = hashes[several], owners[several], holders[several].astype("<u4")
    order = np.argsort(owners, kind="stable")
    hashes, owners, holders = hashes[order], owners[order], holders[order]
    own, counts = np.unique(owners, return_counts=True)
    give_back()
    none = len(ids)
    return pa.table(
        {
            "doc_id": pa.array(ids + [None] * len(own), pa.int64()),
            "fp": pa.array(doc_sets + fps[own].tolist(), pa.int64()),
            "n": pa.array(doc_sizes + ns[own].tolist(), pa.int64()),
            "hashes": pa.concat_arrays([pa.nulls(none, pa.binary()), binaries(hashes, counts)]),
            "holders": pa.concat_arrays([pa.nulls(none, pa.binary()), binaries(holders, counts)]),
        }
    )


def needed(n: int, percent: int) -> int:
    """The least intersection that a set of this size has with a set it links with."""
    return -(-percent * n // 100)


def numbers(column: pa.Array | pa.ChunkedArray, row: int, kind) -> np.ndarray:
    """The numbers in one binary value, without a copy."""
    return np.frombuffer(column[row].as_buffer(), kind)


def prefixes(percent: int):
    """Rows ``token, fp`` of each batch's rare shingles, one per shingle, and ``fp, other`` of sets that meet here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, sets = [np.zeros(0, U64)], [np.zeros(0, "i8")]
            for row, (fp, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                hashes, holders = numbers(batch.column(2), row, U64), numbers(batch.column(3), row, "<u4")
                # The set's own shingles, held by no other, take the first places.
                count = n - needed(n, percent) + 1 - (n - len(hashes))
                order = np.lexsort((hashes, holders))[:count]
                tokens.append(hashes[order])
                sets.append(np.full(len(order), fp, "i8"))
            tokens, sets = np.concatenate(tokens), np.concatenate(sets)
            order = np.lexsort((sets, tokens))
            tokens, sets = tokens[order], sets[order]
            first = np.ones(len(tokens), bool)
            first[1:] = tokens[1:] != tokens[:-1]
            least = sets[first][np.cumsum(first) - 1] if len(sets) else sets
            pairs = np.unique(np.stack([sets[~first], least[~first]]), axis=1)
            pairs = pairs[:, pairs[0] != pairs[1]]
            made = int(first.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(tokens[first].view("i8")), pa.nulls(pairs.shape[1], pa.int64())]),
                    pa.array(np.concatenate([sets[first], pairs[0]])),
                    pa.concat_arrays([pa.nulls(made, pa.int64()), pa.array(pairs[1])]),
                ],
                ["token", "u", "v"],
            )

    return run


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between the sets of each token and the first of them; rows come sorted by token."""
    last, head = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        tokens, sets = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        first = np.ones(len(tokens), bool)
        first[1:] = tokens[1:] != tokens[:-1]
        heads = sets[first]
        if last is not None and tokens[0] == last:
            heads[0] = head
        own = heads[np.cumsum(first) - 1]
        last, head = tokens[-1], own[-1]
        pairs = np.unique(np.stack([sets, own])[:, sets != own], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])


class SignatureTree:
    """Sets under a hierarchy of OR-combined bitmaps and size ranges."""

    def __init__(self, sizes: np.ndarray, tokens: list[np.ndarray], bits: int):
        held = np.array([len(t) for t in tokens])
        least = np.array([mix(t).min() if len(t) else 0 for t in tokens], U64)
        band = np.floor(np.log(np.maximum(sizes, 1)) / math.log(1.25))
        # Sets alike in size and in their least token come to lie in one leaf.
        self.order = np.lexsort((sizes, least, band))
        self.sizes, self.held = sizes[self.order], held[self.order]
        self.tokens = [tokens[i] for i in self.order]
        flags = np.zeros(len(tokens) * bits, bool)
        places = np.concatenate(self.tokens) & U64(bits - 1) if len(tokens) else np.zeros(0, U64)
        flags[np.repeat(np.arange(len(tokens)), self.held) * bits + places.astype("i8")] = True
        self.maps = np.packbits(flags.reshape(-1, bits), axis=1).view(U64)
        set_bits = np.bitwise_count(self.maps).sum(1).astype("i8")
        self.spare = self.held - set_bits
        # Each level: first set of every node, bitmaps, least and largest size, most tokens, most spare.
        self.levels = []
        starts = np.arange(0, len(tokens), LEAF)
        rows = (self.maps, self.sizes, self.sizes, self.held, self.spare)
        ufuncs = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.maximum)
        firsts = starts
        while len(tokens):
            rows = tuple(f.reduceat(x, starts, axis=0) for f, x in zip(ufuncs, rows))
            self.levels.append((np.append(firsts, len(tokens)), *rows))
            if len(firsts) == 1:
                break
            starts = np.arange(0, len(firsts), FAN)
            firsts = firsts[starts]


def possible(common, a, b, percent: int):
    """Whether an overlap in ``common`` bits can be a link, by least and largest size, tokens and spare of two sides."""
    (low_a, high_a, held_a, spare_a), (low_b, high_b, held_b, spare_b) = a, b
    most = np.minimum(np.minimum(held_a, held_b), common + np.minimum(spare_a, spare_b))
    return (
        ((100 + percent) * most >= percent * (low_a + low_b))
        & (100 * high_a >= percent * low_b)
        & (100 * high_b >= percent * low_a)
    )


class TreeJoin:
    """Components of the sets of one or two trees under the links between (or within) them."""

    def __init__(self, left: SignatureTree, right: SignatureTree | None, percent: int):
        self.left, self.right, self.percent = left, right or left, percent
        self.shift = 0 if right is None else len(left.tokens)
        self.root = np.arange(self.shift + len(self.right.tokens))
        if len(left.tokens) and len(self.right.tokens):
            self.visit(len(left.levels) - 1, 0, len(self.right.levels) - 1, 0)

    def union(self, a: int, b: int) -> None:
        low, high = sorted((self.root[a], self.root[b]))
        self.root[self.root == high] = low

    def visit(self, p: int, i: int, q: int, j: int) -> None:
        """Join node ``i`` of the left tree's level ``p`` with node ``j`` of the right one's level ``q``."""
        starts_a, maps_a, *side_a = self.left.levels[p]
        starts_b, maps_b, *side_b = self.right.levels[q]
        a, b = self.root[starts_a[i] : starts_a[i + 1]], self.root[starts_b[j] + self.shift : starts_b[j + 1] + self.shift]
        if (a == a[0]).all() and (b == a[0]).all():
            return
        common = int(np.bitwise_count(maps_a[i] & maps_b[j]).sum())
        if not possible(common, [x[i] for x in side_a], [x[j] for x in side_b], self.percent):
            return
        if not p and not q:
            self.leaves(slice(starts_a[i], starts_a[i + 1]), slice(starts_b[j], starts_b[j + 1]), not self.shift and i == j)
            return
        if not self.shift and p == q and i == j:
            below = range(i * FAN, min((i + 1) * FAN, len(self.left.levels[p - 1][0]) - 1))
            for x in below:
                self.visit(p - 1, x, p - 1, x)
            for x in below:
                for y in range(x + 1, below.stop):
                    self.visit(p - 1, x, p - 1, y)
        elif p >= q:
            for x in range(i * FAN, min((i + 1) * FAN, len(self.left.levels[p - 1][0]) - 1)):
                self.visit(p - 1, x, q, j)
        else:
            for y in range(j * FAN, min((j + 1) * FAN, len(self.right.levels[q - 1][0]) - 1)):
                self.visit(p, i, q - 1, y)

    def leaves(self, x: slice, y: slice, same: bool) -> None:
        left, right = self.left, self.right
        common = np.bitwise_count(left.maps[x][:, None] & right.maps[y][None]).sum(2).astype("i8")
        a = [v[x][:, None] for v in (left.sizes, left.sizes, left.held, left.spare)]
        b = [v[y][None] for v in (right.sizes, right.sizes, right.held, right.spare)]
        open_pairs = possible(common, a, b, self.percent)
        if same:
            open_pairs = np.triu(open_pairs, 1)
        for i, j in zip(*(v.tolist() for v in np.nonzero(open_pairs))):
            i, j = i + x.start, j + y.start
            if self.root[i] != self.root[j + self.shift]:
                both = shared(left.tokens[i], right.tokens[j])
                if 100 * both >= self.percent * (int(left.sizes[i]) + int(right.sizes[j]) - both):
                    self.union(i, j + self.shift)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the sorted numbers of ``a`` are among those of ``b``."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a)) if len(b) else 0


def bitmap_bits(tokens: list[np.ndarray]) -> int:
    """Bits of a bitmap: about two for each token of the largest set, bounded for all sets together."""
    largest = max(len(t) for t in tokens)
    room = max(64, (32 << 20) // len(tokens))
    return 1 << min(max(6, (2 * largest - 1).bit_length()), room.bit_length() - 1, 16)


def linked(sizes: list[int], tokens: list[np.ndarray], sides: list[int], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of set and root (as places) of the sets that link with others; two sides are joined with each other only."""
    bits = bitmap_bits(tokens)
    places = [np.flatnonzero(np.array(sides) == s) for s in sorted(set(sides))]
    trees = [SignatureTree(np.array(sizes)[p], [tokens[i] for i in p], bits) for p in places]
    join = TreeJoin(trees[0], trees[1] if len(trees) > 1 else None, percent)
    order = np.concatenate([p[t.order] for p, t in zip(places, trees)])
    for place, root in enumerate(join.root.tolist()):
        if place != root:
            yield int(order[place]), int(order[root])


def join_unit(percent: int):
    """Edges of the clusters in one unit of work."""

    def run(group: pa.Table) -> pa.Table:
        clusters: dict[int, list[tuple]] = {}
        names = ["label", "side", "fp", "n"]
        for row, (label, side, fp, n) in enumerate(zip(*(group.column(c).to_pylist() for c in names))):
            tokens = np.sort(numbers(group.column("hashes"), row, U64))
            clusters.setdefault(label, []).append((side, fp, n, tokens))
        edges = []
        for rows in clusters.values():
            sides, fps, sizes, tokens = zip(*rows)
            edges += [(fps[a], fps[b]) for a, b in linked(list(sizes), list(tokens), list(sides), percent)]
        columns = zip(*edges) if edges else ([], [])
        return pa.table({k: pa.array(list(x), pa.int64()) for k, x in zip(("u", "v"), columns)})

    return run


def work_units(sets: DataFrame, cap: int, percent: int) -> tuple[DataFrame, bool]:
    """Sets ``label, fp, n, held`` with ``unit`` and ``side``, and whether a cluster is cut.

    Small clusters share units. A large one is cut into chunks of like size and, within a size, by
    chance; its units are the pairs of chunks whose sizes allow a link.
    """
    totals = written(sets.groupBy("label").agg(F.sum("held").alias("total"), F.count("*").alias("members")), "totals")
    small = F.col("total") <= cap
    together, large = totals.agg(F.sum(F.when(small, F.col("total"))), F.count_if(~small)).first()
    width = max(1, -(-(together or 0) // cap))
    marked = salted_join(sets, totals.where("members > 1").drop("members"), "label", "fp")
    units = marked.where(small).select(
        "fp", "label", F.pmod(F.xxhash64("label"), F.lit(width)).alias("unit"), F.lit(0).alias("side")
    )
    if not large:
        return units, False
    rest = marked.where(~small).withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.1))))
    bands = rest.groupBy("label", "band").agg(
        F.ceil(F.sum("held") / cap).alias("cuts"), F.min("n").alias("low"), F.max("n").alias("high")
    )
    bands = written(bands, "bands")
    chunks = bands.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts").cast("int") - 1)))
    a = chunks.select("label", *(F.col(c).alias(f"{c}_a") for c in ("band", "cut", "high")))
    b = chunks.select("label", *(F.col(c).alias(f"{c}_b") for c in ("band", "cut", "low")))
    # Chunks of a cluster that sizes allow to link; one row for each pair of chunks, not of sets.
    pairs = a.join(b, "label").where(
        (F.struct("band_a", "cut_a") <= F.struct(F.col("band_b"), F.col("cut_b")))
        & (100 * F.col("high_a") >= percent * F.col("low_b"))
    )
    pairs = pairs.withColumn("unit", F.xxhash64("label", "band_a", "cut_a", "band_b", "cut_b"))
    alone = (F.col("band_a") == F.col("band_b")) & (F.col("cut_a") == F.col("cut_b"))
    sides = pairs.select("label", F.col("band_a").alias("band"), F.col("cut_a").alias("cut"), "unit", F.lit(0).alias("side"))
    others = pairs.where(~alone).select(
        "label", F.col("band_b").alias("band"), F.col("cut_b").alias("cut"), "unit", F.lit(1).alias("side")
    )
    key = F.struct("label", "band").alias("key")
    placed = salted_join(rest.select(key, "fp"), bands.select(key, "cuts"), "key", "fp").select(
        "fp", "key.label", "key.band", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int").alias("cut")
    )
    cut = placed.join(sides.union(others), ["label", "band", "cut"]).select("fp", "label", "unit", "side")
    return units.union(cut), True


def put_together(name: str) -> Column:
    """One binary value of the ranges' values; a set has at most one for each hash range."""
    return F.aggregate(F.col("parts")[name], F.lit(b""), lambda a, b: F.concat(a, b)).alias(name)


def near_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    range_size: int = RANGE,
    cluster: int = CLUSTER,
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, (size // 6 // range_size).bit_length())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for a, b in slices(byte_lengths(batch.column(1)), SEGMENT):
                part = batch.slice(a, b - a)
                yield packed_sets(part.column(0).to_pylist(), as_bytes(part.column(1)), width, bits, met)
        give_back()

    split = written(
        texts.mapInArrow(pack, PACKED).groupBy("slot").applyInArrow(lambda t: shared_shingles(t, bits), SPLIT), "shingles"
    )
    rows = split.where("hashes is null").select("doc_id", "fp", "n")
    held = (F.octet_length("hashes") / 8).cast("long")
    sets = (
        split.where("hashes is not null")
        .groupBy("fp")
        .agg(
            F.first("n").alias("n"),
            F.sum(held).alias("held"),
            F.collect_list(F.struct("hashes", "holders")).alias("parts"),
        )
        .where(100 * F.col("held") >= percent * F.col("n"))
        .select("fp", "n", "held", put_together("hashes"), put_together("holders"))
    )
    sets = written(sets, "sets")
    rare = written(sets.select("fp", "n", "hashes", "holders").mapInArrow(prefixes(percent), "token long, u long, v long"), "rare")
    met = (
        rare.where("token is not null")
        .select("token", "u")
        .repartition("token")
        .sortWithinPartitions("token", "u")
        .mapInArrow(meetings, "u long, v long")
    )
    clusters = components(rare.where("token is null").select("u", "v").union(met))
    labelled = written(
        sets.select("fp", "n", "held").join(clusters.select(F.col("node").alias("fp"), F.col("root").alias("label")), "fp"),
        "labelled",
    )
    units, cut = work_units(labelled, cluster, percent)
    links = written(
        sets.select("fp", "n", "hashes").join(units, "fp").groupBy("unit").applyInArrow(join_unit(percent), "u long, v long"),
        "links",
    )
    # The links of one unit lead from each set to its root; roots of several units are joined once more.
    roots = components(links) if cut else links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    firsts = rows.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("first"))
    grouped = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "label", F.coalesce("root", "fp")
    )
    grouped = written(grouped.select("fp", "label", "first"), "grouped")
    least = grouped.groupBy("label").agg(F.min("first").alias("component_id"))
    named = salted_join(grouped.select("fp", "label"), least, "label", "fp").select("fp", "component_id")
    found = salted_join(rows.where("n > 0"), named, "fp", "doc_id")
    alone = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return (
        found.select("doc_id", "n", "component_id").union(alone).withColumnRenamed("n", "n_shingles")
    )
