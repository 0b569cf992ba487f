"""Exact top-k inner products with an impact-ordered score-at-a-time index.

Candidates are dealt to shards of bounded size. A shard's index holds, for every dimension, the
postings (vector, impact) cut into segments of one quantised impact level; level 0 has the largest
impacts. A block of queries is scored segment by segment in descending order of impact: the
accumulators of all candidates grow by what a level contributes, and what the levels still to come
can add or take away is bounded by the query's absolute sum times the level's largest impact (and by
the Cauchy-Schwarz bound of the vector's remaining part, if that is smaller). A query stops as soon
as that bound proves which candidates can still be members; those, and only those, are rescored
exactly. The ends of the shards' lists are merged by score and smaller id.

Scores are whole numbers and are computed exactly: in single precision while all partial sums fit it,
else in double, else in 64-bit integers.

Cases: vectors that are null or empty, or hold null or non-finite components, take no part, nor do
rows without an id; vectors of another length than a query's are no candidates of it; rows that share
an id are candidates each, except of a query with that id; ties go to the smaller id; an empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from folio_spark.llm.common import written

#: Vectors in a shard, queries in a block, impact levels.
SHARD = 8192
BLOCK = 1024
LEVELS = 4

PACKED = "kind int, dim int, number long, ids binary, values binary, levels binary, bounds binary"


def whole(vector: Column) -> Column:
    """The components times 64, rounded down; null if the vector takes no part."""
    usable = (F.size(vector) > 0) & F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))),
    )
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * 64).cast("long")))


def level_bounds(values: np.ndarray, levels: int) -> np.ndarray:
    """Least absolute impact of each level, in descending order; the last level has the rest."""
    impacts = np.abs(values).ravel()
    if not len(impacts):
        return np.zeros(levels, "i8")
    cuts = np.quantile(impacts, 1 - np.cumsum([0.5**k for k in range(levels, 1, -1)])).astype("i8")
    return np.append(np.maximum(cuts, 1), 0)


def packed(kind: int, levels: int):
    """A group of vectors as one row; a shard's values are stored with their level's number."""

    def run(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        lists = group.column("vector").combine_chunks()
        values = lists.flatten().to_numpy().reshape(len(ids), -1)[order]
        bounds = level_bounds(values, levels) if kind else np.zeros(0, "i8")
        # Segment numbers: level by level, and within a level dimension by dimension.
        level = np.full(values.shape, max(0, len(bounds) - 1), "u1")
        for k in range(len(bounds) - 2, -1, -1):
            level[np.abs(values) >= bounds[k]] = k
        row = (
            kind,
            values.shape[1],
            group.column("number")[0].as_py(),
            ids[order].tobytes(),
            values.tobytes(),
            level.tobytes() if kind else b"",
            bounds.tobytes(),
        )
        types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        names = ("kind", "dim", "number", "ids", "values", "levels", "bounds")
        return pa.table({n: pa.array([x], t) for n, x, t in zip(names, row, types)})

    return run


class Postings:
    """A shard's segments: of each level, the impacts of its postings, by dimension."""

    def __init__(self, ids: bytes, values: bytes, levels: bytes, bounds: bytes, dim: int):
        self.ids = np.frombuffer(ids, "i8")
        self.values = np.frombuffer(values, "i8").reshape(-1, dim)
        self.level = np.frombuffer(levels, "u1").reshape(-1, dim)
        self.bounds = np.frombuffer(bounds, "i8")
        self.largest = int(np.abs(self.values).max(initial=0))

    def segments(self, k: int, kind: str) -> np.ndarray:
        """The postings of a level, dimension by vector."""
        return np.where(self.level == k, self.values, 0).T.astype(kind)

    def rest(self, k: int) -> tuple[float, np.ndarray]:
        """Largest impact of the levels after ``k``, and the length of each vector's part in them."""
        left = np.where(self.level > k, np.abs(self.values), 0)
        return float(left.max(initial=0)), np.sqrt((left.astype(float) ** 2).sum(1))


def exact_kind(queries: np.ndarray, largest: int) -> str:
    top = int(np.abs(queries).max(initial=0)) * largest * queries.shape[1]
    return "f4" if top < 1 << 24 else "f8" if top < 1 << 53 else "i8"


def best(query_ids: np.ndarray, queries: np.ndarray, shard: Postings, k: int) -> Iterator[tuple]:
    """``query, vector, score`` of each query's best candidates of the shard."""
    kind = exact_kind(queries, shard.largest)
    sums = np.zeros((len(queries), len(shard.ids)), kind)
    wide = queries.astype(kind)
    absolute, lengths = np.abs(queries.astype(float)).sum(1), np.sqrt((queries.astype(float) ** 2).sum(1))
    own = (np.searchsorted(shard.ids, query_ids, "left"), np.searchsorted(shard.ids, query_ids, "right"))
    others = len(shard.ids) - (own[1] - own[0])
    open_queries = np.arange(len(queries))
    last = len(shard.bounds) - 1
    for level in range(last + 1):
        part = wide[open_queries] @ shard.segments(level, kind)
        sums = sums[: len(open_queries)] + part if level == 0 else sums + part
        most, tails = shard.rest(level)
        still, keep = [], []
        # What later levels can change, with room for the rounding of the lengths.
        change = np.minimum((absolute[open_queries] * most)[:, None], lengths[open_queries][:, None] * tails[None]) * (1 + 1e-9)
        change = np.ceil(change) if level < last else np.zeros((len(open_queries), 1))
        low, high = sums - change, sums + change
        for row, q in enumerate(open_queries.tolist()):
            a, b = own[0][q], own[1][q]
            low[row, a:b] = -np.inf if kind != "i8" else np.iinfo("i8").min
            n = min(k, int(others[q]))
            if not n:
                continue
            floor = np.partition(low[row], len(low[row]) - n)[len(low[row]) - n]
            members = np.flatnonzero(high[row] >= floor)
            members = members[(members < a) | (members >= b)]
            if level < last and len(members) > max(4 * k, len(shard.ids) >> 5):
                still.append(q)
                keep.append(row)
                continue
            # Proven: nothing else can be a member.
            scores = shard.values[members] @ queries[q]
            order = np.lexsort((shard.ids[members], -scores))[:n]
            yield query_ids[q], shard.ids[members[order]], scores[order]
        open_queries, sums = np.array(still, "i8"), sums[keep]
        if not still:
            return


def score(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, q_ids, q_values, *index in zip(*(c.to_pylist() for c in batch.columns)):
                queries = np.frombuffer(q_values, "i8").reshape(-1, dim)
                found = list(best(np.frombuffer(q_ids, "i8"), queries, Postings(*index, dim), k))
                if found:
                    names, ids, scores = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(names, [len(x) for x in ids])),
                            pa.array(np.concatenate(ids)),
                            pa.array(np.concatenate(scores)),
                        ],
                        ["query_id", "vec_id", "score"],
                    )

    return run


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard: int = SHARD,
    block: int = BLOCK,
    levels: int = LEVELS,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the vectors of highest inner product with each query."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), is_query.alias("asks"), whole(F.col(vector_col)).alias("vector")
    ).where(F.col("vector").isNotNull() & F.col("id").isNotNull())
    rows = written(rows.withColumn("dim", F.size("vector")), "vectors")
    # One row per vector length: the numbers of shards and blocks, which keep both of bounded size.
    sizes = rows.groupBy("dim").agg(
        F.ceil(F.count("*") / shard).cast("int").alias("shards"),
        F.ceil(F.count_if("asks") / block).cast("int").alias("blocks"),
    )
    sizes = written(sizes.where("blocks > 0"), "vector-sizes")
    dealt = rows.join(sizes, "dim")

    def group(kind: int, of: DataFrame, parts: str) -> DataFrame:
        numbered = of.withColumn("number", F.pmod(F.xxhash64("id"), F.col(parts)).cast("long"))
        made = numbered.select("dim", "number", "id", "vector").groupBy("dim", "number")
        return made.applyInArrow(packed(kind, levels), PACKED)

    index = written(group(1, dealt, "shards"), "impact-index")
    asked = written(group(0, dealt.where("asks"), "blocks"), "query-blocks")
    # Every block meets every shard: both sides are repeated by the other's count, a row each.
    each_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    each_shard = F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")
    left = asked.join(sizes, "dim").select(
        "dim", F.col("number").alias("block"), each_shard, F.col("ids").alias("q_ids"), F.col("values").alias("q_values")
    )
    right = index.join(sizes, "dim").select(
        "dim", F.col("number").alias("shard"), each_block, "ids", "values", "levels", "bounds"
    )
    pairs = left.join(right, ["dim", "block", "shard"]).select("dim", "q_ids", "q_values", "ids", "values", "levels", "bounds")
    found = pairs.mapInArrow(score(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
