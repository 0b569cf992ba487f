"""Best-fit packing of tokenised documents by linear grouping.

Lengths are whole numbers up to the capacity, so the histogram of piece lengths, at most ``capacity``
numbers however many documents there are, decides everything about the packing:

1. pieces of full length are sequences of their own;
2. the other large lengths, in descending order, are cut into groups of equal cardinality and every
   length is rounded up to its group's largest;
3. the few rounded sizes are packed optimally: a linear programme over configurations (multisets of
   sizes that fit), solved by column generation with a knapsack; configurations are used the whole
   number of times the programme gives;
4. actual documents take the places of their groups, in descending order, which opens gaps where
   they are shorter than the rounded size;
5. the few large documents that remain and all small ones go by best fit, longest first, into the
   smallest gap that takes them, else into a new sequence.

The plan is a list of runs: pieces of one length and of consecutive ranks take consecutive sequences
at one offset. Its size depends on the number of distinct lengths, not of documents, so it may be
broadcast. Ranks are numbered chunk by chunk, so that a length shared by a third of all pieces is
never gathered.

Cases: a null text is empty, and an empty text is the end id alone (length 1); repeated rows are
packed each; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from folio_spark.llm.common import as_bytes, written
from folio_spark.llm.tokens import encoder

Run = tuple[int, int, int, int, int]


def knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of most worth: its worth and how often it has each size."""
    use = np.flatnonzero(worth > 1e-12)
    counts = np.zeros(len(sizes))
    if not len(use):
        return 0.0, counts
    best, picks = np.zeros(capacity + 1), []
    # One more item in each round; all sizes are large, so rounds are few.
    for _ in range(capacity // int(sizes[use].min())):
        new, pick = best.copy(), np.full(capacity + 1, -1)
        for i in use:
            s = int(sizes[i])
            value = best[: capacity + 1 - s] + worth[i]
            better = value > new[s:] + 1e-12
            new[s:][better] = value[better]
            pick[s:][better] = i
        if (pick < 0).all():
            break
        best = new
        picks.append(pick)
    room = capacity
    for pick in reversed(picks):
        if pick[room] >= 0:
            counts[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return float(worth @ counts), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations of the fractional optimum, each with the whole number of times it is used."""
    basis = np.diag(capacity // sizes).astype(float)
    amount = np.linalg.solve(basis, demand.astype(float))
    for _ in range(40 * len(sizes)):
        price = np.linalg.solve(basis.T, np.ones(len(sizes)))
        worth, column = knapsack(sizes, price, capacity)
        if worth <= 1 + 1e-7:
            break
        way = np.linalg.solve(basis, column)
        ratio = np.full(len(sizes), np.inf)
        np.divide(amount, way, out=ratio, where=way > 1e-9)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        amount = np.maximum(np.linalg.solve(basis, demand.astype(float)), 0)
    return [(basis[:, i].astype(int), int(amount[i] + 1e-6)) for i in range(len(sizes)) if amount[i] >= 1 - 1e-6]


def plan(histogram: dict[int, int], capacity: int, groups: int = 40, large: float = 0.1) -> tuple[list[Run], int]:
    """Runs ``(length, first rank, pieces, first sequence, offset)`` and the number of sequences.

    Piece ``first rank + i`` of that length takes sequence ``first sequence + i`` at the offset.
    """
    runs: list[Run] = []
    used = dict.fromkeys(histogram, 0)
    bins: dict[int, list[tuple[int, int]]] = {}
    sequences = 0

    def place(length: int, count: int, sequence: int, offset: int) -> None:
        runs.append((length, used[length], count, sequence, offset))
        used[length] += count

    def leave(gap: int, sequence: int, count: int) -> None:
        if gap and count:
            bins.setdefault(gap, []).append((sequence, count))

    if histogram.get(capacity):
        place(capacity, histogram[capacity], 0, 0)
        sequences += histogram[capacity]

    big = sorted((x for x in histogram if capacity * large < x < capacity), reverse=True)
    total = sum(histogram[x] for x in big)
    if total:
        share = -(-total // groups)
        waiting: list[list[list[int]]] = []  # of each group: [length, pieces] in descending order
        room = 0
        for x in big:
            count = histogram[x]
            # A length that fills a group alone doesn't share one, and so isn't rounded.
            if count >= share:
                room = 0
            while count:
                if not room:
                    # A group that would have the size of the one before it goes on with that one.
                    if not waiting or waiting[-1][0][0] != x:
                        waiting.append([])
                    room = share
                take = min(count, room)
                waiting[-1].append([x, take])
                count, room = count - take, room - take
            if histogram[x] >= share:
                room = 0
        sizes = np.array([g[0][0] for g in waiting])
        demand = np.array([sum(c for _, c in g) for g in waiting])
        for column, copies in configurations(sizes, demand, capacity):
            slots = [g for g in range(len(sizes)) for _ in range(column[g])]
            taken: list[list[tuple[int, int]]] = []
            for g in slots:
                need, own = copies, []
                while need and waiting[g]:
                    x, count = waiting[g][0]
                    take = min(need, count)
                    own.append((x, take))
                    need -= take
                    if take == count:
                        waiting[g].pop(0)
                    else:
                        waiting[g][0][1] -= take
                if need:
                    own.append((0, need))
                taken.append(own)
            # Stretches of sequences in which every place has one length.
            edges = sorted({int(e) for own in taken for e in np.cumsum([c for _, c in own])})
            begin, heads = 0, [0] * len(slots)
            spent = [0] * len(slots)
            for end in edges:
                offset = 0
                for i, own in enumerate(taken):
                    x, count = own[heads[i]]
                    if x:
                        place(x, end - begin, sequences + begin, offset)
                        offset += x
                    spent[i] += end - begin
                    if spent[i] == count:
                        heads[i], spent[i] = heads[i] + 1, 0
                leave(capacity - offset, sequences + begin, end - begin)
                begin = end
            sequences += copies

    gaps = sorted(bins)
    for x in sorted((x for x in histogram if x < capacity), reverse=True):
        left = histogram[x] - used[x]
        while left:
            at = bisect.bisect_left(gaps, x)
            if at == len(gaps):
                each = capacity // x
                count = max(1, left // each)
                gap, sequence = capacity, sequences
                sequences += count
            else:
                gap = gaps[at]
                each = gap // x
                sequence, there = bins[gap].pop()
                count = min(there, max(1, left // each))
                if count < there:
                    bins[gap].append((sequence + count, there - count))
                if not bins[gap]:
                    del bins[gap]
                    gaps.pop(at)
            fill = min(each, left // count)
            for i in range(fill):
                place(x, count, sequence, capacity - gap + i * x)
            left -= fill * count
            rest = gap - fill * x
            if rest:
                if rest not in bins:
                    bisect.insort(gaps, rest)
                leave(rest, sequence, count)
    return runs, sequences


def token_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str, text_col: str, keep_ids: bool
) -> DataFrame:
    """Pieces of all documents with their chunk and their rank among the chunk's pieces of one length."""
    end = np.array([end_id], "<u4").tobytes()
    fields = [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("chunk", pa.int64()),
        ("place", pa.int64()),
    ] + [("ids", pa.binary())] * keep_ids
    shape = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            chunk, seen, rows = part * (1 << 24) + number, {}, []
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                ids = encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    length = len(own) // 4
                    place = seen.get(length, 0)
                    seen[length] = place + 1
                    row = (doc_id, k, at // 4, length, zlib.crc32(own), chunk, place)
                    rows.append((*row, own) if keep_ids else row)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, f.type) for x, f in zip(zip(*rows), shape)], schema=shape
                )

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk long, place long"
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(cut, kinds + ", ids binary" * keep_ids)


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
    groups: tuple[int, ...] = (24, 40),
) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``; with ``keep_ids`` also their ids.

    ``groups``: numbers of groups to plan with; the plan with the fewest sequences is used.
    """
    spark = docs.sparkSession
    pieces = written(
        token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col, keep_ids), "pieces"
    )
    counts = written(pieces.groupBy("chunk", "length").count(), "piece-counts")
    # At most ``capacity`` rows.
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}
    runs, _ = min((plan(histogram, capacity, n) for n in groups), key=lambda made: made[1])
    table = np.array(sorted(runs), "i8").reshape(-1, 5)
    shared = spark.sparkContext.broadcast(table)
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("chunk", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))

    @F.pandas_udf("sequence_id long, offset long")
    def seat(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table = shared.value
        # Ranks of one length are consecutive over its runs, and so are lengths in the table.
        starts = np.concatenate([[0], np.cumsum(table[:, 2])])
        lengths, first = np.unique(table[:, 0], return_index=True)
        base = starts[first][np.searchsorted(lengths, length.to_numpy())]
        at = np.searchsorted(starts, base + rank.to_numpy(), "right") - 1
        return pd.DataFrame(
            {"sequence_id": table[at, 3] + rank.to_numpy() - table[at, 1], "offset": table[at, 4]}
        )

    named = pieces.columns[:5] + ["ids"] * keep_ids
    return (
        pieces.join(firsts, ["chunk", "length"])
        .withColumn("seat", seat("length", F.col("first") + F.col("place")))
        .select(*named, "seat.sequence_id", "seat.offset")
    )
