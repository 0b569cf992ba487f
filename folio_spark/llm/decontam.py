"""Benchmark decontamination with a distributed positional inverted index.

The corpus is indexed by document: every task holds the index of its own segment of documents, a
sorted list of postings (word, position) for each word that a test item uses. A search intersects,
for each window of a test item, the offset-adjusted lists from the rarest word of the segment on:
the rarest word's postings, moved back by its offset, are the possible starts, and each next word
keeps those at which it stands too. With a slop, a word may stand up to so many places from its own
(a proximity match). No posting is shuffled and no list leaves its task.

Test items travel in blocks of at most ``block_words`` words, one pass over the index each, so
what is broadcast has a fixed bound however many items there are.

Cases: a null or empty text has no words and no hits; an item without words or without an id is
never found; items that share an id count as one; repeated documents are searched each; an empty
table of either kind gives no hits. A column of the documents with the name of a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField

from folio_spark.llm.common import add_columns, as_bytes, column_of, slices

#: Words consist of digits, a-z and every character beyond ASCII; all other bytes separate them.
LOWER = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
WINDOW = 10
#: Bytes of text indexed together in a task.
SEGMENT = 4 << 20

RESULT = [
    StructField("n_words", LongType()),
    StructField("n_hit", LongType()),
    StructField("hits", ArrayType(LongType())),
    StructField("items", ArrayType(LongType())),
    StructField("near_items", ArrayType(LongType())),
]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


class Windows:
    """The windows of a block of test items as numbers of their words."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        self.words: dict[bytes, int] = {}
        rows, owners, lengths = [], [], []
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words)) for w in words_of((text or "").encode())]
            if not ids or item is None:
                continue
            for at in range(max(1, len(ids) - width + 1)):
                own = ids[at : at + width]
                lengths.append(len(own))
                rows.append(own + [-1] * (width - len(own)))
                owners.append(item)
        self.rows = np.array(rows, "i4").reshape(-1, width)
        self.lengths = np.array(lengths, "i4")
        self.owners = np.array(owners, "i8")


class Segment:
    """The positional index of some documents, restricted to the words of the test items."""

    def __init__(self, texts: list[bytes], vocabulary: dict[bytes, int]):
        found, sizes = [], []
        for text in texts:
            words = words_of(text)
            sizes.append(len(words))
            found.append(np.fromiter((vocabulary.get(w, -1) for w in words), "i4", len(words)))
            found.append(np.full(1, -1, "i4"))  # no match crosses two documents
        self.sizes = np.array(sizes, "i8")
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 1)])[:-1]
        self.ids = np.concatenate(found)
        places = np.flatnonzero(self.ids >= 0)
        self.postings = places[np.argsort(self.ids[places], kind="stable")]
        self.counts = np.bincount(self.ids[places], minlength=len(vocabulary))
        self.firsts = np.concatenate([[0], np.cumsum(self.counts)])

    def matches(self, windows: Windows, slop: int, limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Windows and start positions of all their matches."""
        rows = windows.rows
        n = np.where(rows >= 0, self.counts[rows], np.iinfo("i8").max)
        order = np.argsort(n, axis=1, kind="stable")
        rarest = order[:, 0]
        amount = np.take_along_axis(n, order[:, :1], 1)[:, 0]
        use = np.flatnonzero(amount > 0)
        out_w, out_s = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
        for a, b in slices(amount[use].tolist(), limit):
            some = use[a:b]
            w = np.repeat(some, amount[some])
            word = rows[some, rarest[some]]
            within = np.arange(len(w)) - np.repeat(np.cumsum(amount[some]) - amount[some], amount[some])
            s = self.postings[np.repeat(self.firsts[word], amount[some]) + within] - rarest[w]
            if slop:
                s = (s[:, None] + np.arange(-slop, slop + 1)).ravel()
                w = np.repeat(w, 2 * slop + 1)
            inside = (s >= 0) & (s + windows.lengths[w] <= len(self.ids))
            w, s = w[inside], s[inside]
            for k in range(0 if slop else 1, rows.shape[1]):
                offset = order[w, k]
                word = rows[w, offset]
                fits = word < 0
                for d in range(-slop, slop + 1):
                    at = s + offset + d
                    fits |= self.ids[np.clip(at, 0, len(self.ids) - 1)] == word
                w, s = w[fits], s[fits]
            out_w.append(w)
            out_s.append(s)
        w, s = np.concatenate(out_w), np.concatenate(out_s)
        if slop and len(w):
            # A match lies within one document.
            doc = np.searchsorted(self.starts, s, "right") - 1
            inside = s + windows.lengths[w] <= self.starts[doc] + self.sizes[doc]
            w, s = w[inside], s[inside]
        return w, s

    def owners(self, windows: Windows, w: np.ndarray, s: np.ndarray) -> dict[int, list[int]]:
        """Items matched, by document."""
        doc = np.searchsorted(self.starts, s, "right") - 1
        pairs = np.unique(np.stack([doc, windows.owners[w]]), axis=1)
        out: dict[int, list[int]] = {}
        for d, item in pairs.T.tolist():
            out.setdefault(d, []).append(item)
        return out

    def covered(self, windows: Windows, w: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Which positions stand inside a match."""
        change = np.zeros(len(self.ids) + 1, "i8")
        np.add.at(change, s, 1)
        np.add.at(change, s + windows.lengths[w], -1)
        return np.cumsum(change)[:-1] > 0


def stretches(flags: np.ndarray) -> list[int]:
    """Begin and end of each run of set flags, one after the other."""
    return np.flatnonzero(np.diff(np.concatenate([[0], flags.astype("i1"), [0]]))).tolist()


def blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size; never more than one block is on the driver.

    An item longer than a block is a block of its own.
    """
    sized = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    block, size = [], 0
    for row in sized.toLocalIterator():
        words = len(words_of((row["text"] or "").encode()))
        if block and size + words > block_words:
            yield block
            block, size = [], 0
        block.append((row["id"], row["text"]))
        size += words
    yield block


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW,
    slop: int = 0,
    block_words: int = 1 << 20,
) -> DataFrame:
    """The documents with what test items they hold.

    ``n_words``, ``n_hit`` (words inside an exact match), ``hits`` (begin and end word of each such
    stretch, in turn), ``items`` (ids with an exact match), ``near_items`` (ids with a proximity
    match within ``slop``; with no slop, the same).
    """
    spark = docs.sparkSession
    out = docs
    for number, block in enumerate(blocks(items, item_col, item_text_col, block_words)):
        shared = spark.sparkContext.broadcast(Windows(block, width))
        out = add_columns(out, RESULT, lambda batch, b=shared, n=number: search(batch, b.value, text_col, slop, n > 0))
    return out


def search(batch: pa.RecordBatch, windows: Windows, text_col: str, slop: int, again: bool) -> list[pa.Array]:
    """The result columns of one batch; ``again``: the batch has those of earlier blocks of items."""
    texts = as_bytes(column_of(batch, text_col))
    n_words, n_hit, hits, items, near = [], [], [], [], []
    for a, b in slices([len(t) for t in texts], SEGMENT):
        segment = Segment(texts[a:b], windows.words)
        w, s = segment.matches(windows, 0)
        inside = segment.covered(windows, w, s)
        exact = segment.owners(windows, w, s)
        close = segment.owners(windows, *segment.matches(windows, slop)) if slop else exact
        for i in range(b - a):
            begin, size = int(segment.starts[i]), int(segment.sizes[i])
            flags = inside[begin : begin + size] if i in exact else np.zeros(0, bool)
            own = stretches(flags) if i in exact else []
            if again:
                before = column_of(batch, "hits")[a + i].as_py()
                if before:
                    flags = np.zeros(size, bool) if i not in exact else flags.copy()
                    for x, y in zip(before[::2], before[1::2]):
                        flags[x:y] = True
                    own = stretches(flags)
            n_words.append(size)
            n_hit.append(sum(own[1::2]) - sum(own[::2]))
            hits.append(own)
            items.append(exact.get(i, []))
            near.append(close.get(i, []))
    if again:
        for name, lists in (("items", items), ("near_items", near)):
            for i, old in enumerate(column_of(batch, name).to_pylist()):
                if old:
                    lists[i] = sorted({*old, *lists[i]})
    many = pa.list_(pa.int64())
    return [
        pa.array(n_words, pa.int64()),
        pa.array(n_hit, pa.int64()),
        pa.array(hits, many),
        pa.array(items, many),
        pa.array(near, many),
    ]
