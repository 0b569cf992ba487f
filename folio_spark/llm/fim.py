"""Fill-in-middle transformation with cuts found in a wavelet matrix over character classes.

The bytes of many texts are put into classes (continuation of a character, begin of a line, begin of
a word, inner character, white space) and held in one wavelet matrix. A unit (character, word, line)
begins at the bytes of some of the classes, so the number of units before a place is a sum of rank
queries, and the place at which a unit begins is found by bisection on that sum, for the cuts of all
texts at once. The order of the parts, and whether a text is left as it is, follow from the SHA-256
of the row's id, so every run and every partition gives the same result.

Cases: a null or empty text is plain, with no units and an empty output; a text that holds a marker
is plain, so that ``restored`` is exact; a null id counts as an empty one; rows that share an id get
the same draws; a text is cut whole, however long. A column of the input with the name of a result,
letter case aside, is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField

from folio_spark.llm.common import add_columns, as_bytes, column_of, slices, spare_name

#: The markers in front of the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 rows, those drawn at or above the first stay plain; of the others, those below the second put the suffix first.
PLAIN_FROM, SUFFIX_FIRST = 90, 20

#: Classes of bytes. Every class but the first begins a character.
CONTINUES, LINE_AND_WORD, WORD, INNER, SPACE, LINE_AND_SPACE = range(6)
BITS = 3
#: The classes at which a unit begins.
UNITS = {
    "character": (LINE_AND_WORD, WORD, INNER, SPACE, LINE_AND_SPACE),
    "word": (LINE_AND_WORD, WORD),
    "line": (LINE_AND_WORD, LINE_AND_SPACE),
}
#: Bytes of text in one matrix; a longer text has one of its own.
SEGMENT = 4 << 20

RESULT = [
    StructField("n", LongType()),
    StructField("form", StringType()),
    StructField("prefix_chars", LongType()),
    StructField("middle_chars", LongType()),
    StructField("output", StringType()),
]


def classes_of(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of each byte; ``starts`` are the first bytes of the texts that are not empty."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    after_space = np.concatenate([[True], space[:-1]])
    line = np.concatenate([[True], raw[:-1] == 10])
    after_space[starts] = line[starts] = True
    found = np.where(space, np.where(line, LINE_AND_SPACE, SPACE), np.where(after_space, WORD, INNER))
    found[line & ~space] = LINE_AND_WORD
    found[(raw & 0xC0) == 0x80] = CONTINUES
    return found.astype("u1")


class WaveletMatrix:
    """A sequence of small numbers with rank queries in one step per bit."""

    def __init__(self, values: np.ndarray, bits: int = BITS):
        self.size, self.bits = len(values), bits
        self.words, self.ones, self.zeros = [], [], []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(packed) // 8 + 1, "u8")
            words.view("u1")[: len(packed)] = packed
            ones = np.zeros(len(words) + 1, "i8")
            np.cumsum(np.bitwise_count(words), out=ones[1:])
            self.words.append(words)
            self.ones.append(ones)
            self.zeros.append(self.size - int(ones[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def ones_before(self, level: int, places: np.ndarray) -> np.ndarray:
        word = places >> 6
        rest = self.words[level][word] & ((np.uint64(1) << (places & 63).astype("u8")) - np.uint64(1))
        return self.ones[level][word] + np.bitwise_count(rest)

    def rank(self, value: int, places: np.ndarray) -> np.ndarray:
        """How often ``value`` stands before each place."""
        first, last = np.zeros(1, "i8"), places
        for level in range(self.bits):
            a, b = self.ones_before(level, first), self.ones_before(level, last)
            if value >> (self.bits - 1 - level) & 1:
                first, last = self.zeros[level] + a, self.zeros[level] + b
            else:
                first, last = first - a, last - b
        return last - first

    def count(self, values: tuple[int, ...], places: np.ndarray) -> np.ndarray:
        """How often any of ``values`` stands before each place."""
        return sum(self.rank(v, places) for v in values)

    def begin_of(self, values: tuple[int, ...], first: np.ndarray, last: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The place from ``first`` on that holds the unit of this number from 0; ``last`` if there are no more.

        It is the last place with no more than ``number`` units between ``first`` and itself, found by bisection.
        """
        most = self.count(values, first) + number
        low, high = first.copy(), last.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            fits = self.count(values, middle) <= most
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low


def draws(row_id: Column, seed: int) -> Column:
    """Four numbers of 32 bits from the SHA-256 of the seed, a colon and the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit("")))
    digest = F.sha2(text.cast("binary"), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)))


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "character", seed: int = 1
) -> DataFrame:
    """The documents with ``n`` units, the ``form`` (plain, psm, spm), the characters of prefix and middle, ``output``."""
    numbers = spare_name(docs, "draws")
    drawn = docs.withColumn(numbers, draws(F.col(id_col), seed))
    return add_columns(drawn, RESULT, lambda batch: transformed(batch, text_col, numbers, UNITS[unit])).drop(numbers)


def transformed(batch: pa.RecordBatch, text_col: str, numbers: str, unit: tuple[int, ...]) -> list[pa.Array]:
    texts = as_bytes(column_of(batch, text_col))
    h = np.array(column_of(batch, numbers).to_pylist(), "i8").reshape(-1, 4)
    markers = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    counts, forms, prefixes, middles, outputs = [], [], [], [], []
    for a, b in slices([len(t) for t in texts], SEGMENT):
        own = texts[a:b]
        ends = np.cumsum([len(t) for t in own])
        begins = ends - [len(t) for t in own]
        raw = np.frombuffer(b"".join(own), "u1")
        matrix = WaveletMatrix(classes_of(raw, begins[begins < ends]) if len(raw) else np.zeros(0, "u1"))
        n = matrix.count(unit, ends) - matrix.count(unit, begins)
        one, two = h[a:b, 0] % (n + 1), h[a:b, 1] % (n + 1)
        first = matrix.begin_of(unit, begins, ends, np.minimum(one, two))
        second = matrix.begin_of(unit, begins, ends, np.maximum(one, two))
        before, cut, stop = (matrix.count(UNITS["character"], p) for p in (begins, first, second))
        for i, text in enumerate(own):
            counts.append(int(n[i]))
            if not text or h[a + i, 2] % 100 >= PLAIN_FROM or any(m in text for m in markers):
                forms.append("plain")
                prefixes.append(None)
                middles.append(None)
                outputs.append(text)
                continue
            x, y = int(first[i] - begins[i]), int(second[i] - begins[i])
            prefix, middle, suffix = markers[0] + text[:x], markers[2] + text[x:y], markers[1] + text[y:]
            spm = h[a + i, 3] % 100 < SUFFIX_FIRST
            forms.append("spm" if spm else "psm")
            prefixes.append(int(cut[i] - before[i]))
            middles.append(int(stop[i] - cut[i]))
            outputs.append(b"".join([suffix, prefix, middle] if spm else [prefix, suffix, middle]))
    long = pa.int64()
    return [
        pa.array(counts, long),
        pa.array(forms, pa.string()),
        pa.array(prefixes, long),
        pa.array(middles, long),
        pa.array(outputs, pa.binary()).cast(pa.string()),
    ]


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No text of a cut form holds a marker, so each is found where it was put."""
    last = F.substring_index(output, MIDDLE, -1)
    head = F.substring_index(output, MIDDLE, 1)
    psm = F.concat(F.substring_index(F.substring_index(head, SUFFIX, 1), PREFIX, -1), last, F.substring_index(head, SUFFIX, -1))
    spm = F.concat(F.substring_index(head, PREFIX, -1), last, F.substring_index(F.substring_index(head, PREFIX, 1), SUFFIX, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
