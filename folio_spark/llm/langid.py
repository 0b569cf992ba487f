"""Language identification of mixed-language text.

A model learned from labelled texts has, for each language, log-probabilities of hashed letter
trigrams (a word's ends count as letters) and the scripts that the language is written in. A word's
script narrows the candidate languages to those that use it; each candidate's score is the mean
log-probability of the word's trigrams, scaled by the square root of their number so that long
words do not drown short ones. Viterbi over the words, with a penalty for each switch of language,
labels every word; runs of one label are the spans. A document's language is the one with most
labelled letters, its score their share.

Cases: a null or empty text, or one without a letter, is ``und`` with score 0 and has no spans; ties
go to the language first in alphabetical order; with no labelled text at all, every text is ``und``;
repeated rows are judged alike. A column of the documents with the name of a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from folio_spark.llm.common import add_columns, byte_lengths, column_of, slices

# First code points of ranges and the script that begins there (0: none of these).
SCRIPTS = (
    "none Latin Greek Cyrillic Armenian Hebrew Arabic Indic Thai Georgian Hangul Ethiopic Khmer Kana Han".split()
)
RANGES = [
    (0x0000, "none"), (0x0041, "Latin"), (0x005B, "none"), (0x0061, "Latin"), (0x007B, "none"),
    (0x00AA, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0780, "none"), (0x0900, "Indic"), (0x0E00, "Thai"), (0x0F00, "none"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "none"), (0x1780, "Khmer"),
    (0x1800, "none"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "none"), (0x2C60, "Latin"),
    (0x2C80, "none"), (0x3040, "Kana"), (0x3100, "none"), (0x3130, "Hangul"), (0x3190, "none"),
    (0x3400, "Han"), (0xA000, "none"), (0xAC00, "Hangul"), (0xD7B0, "none"), (0xF900, "Han"),
    (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "none"),
    (0xFE70, "Arabic"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "none"),
    (0x20000, "Han"), (0x32000, "none"),
]
BUCKETS = 1 << 16
#: Share of a language's letters from which a script counts as its own.
OWN_SCRIPT = 0.01
#: Letters scored together, and words whose scores are held for one run of Viterbi.
LETTERS, WORDS = 1 << 19, 1 << 19

SPAN = StructType([StructField("begin", LongType()), StructField("end", LongType()), StructField("lang", StringType())])


@cache
def letter_scripts() -> np.ndarray:
    """For each code point 0 if it is no letter, else 1 + its script's number."""
    scripts = np.zeros(0x110000, "u1")
    for (first, name), (end, _) in zip(RANGES, [*RANGES[1:], (0x110000, "")]):
        scripts[first:end] = SCRIPTS.index(name)
    letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return np.where(letters, scripts + 1, 0).astype("u1")


@dataclass
class Words:
    """The words (runs of letters) of some texts, and the trigram around each of their letters."""

    doc: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    scripts: np.ndarray
    first: np.ndarray
    grams: np.ndarray


def words_of(texts: list[str]) -> Words:
    data = "\n".join(texts)
    points = np.frombuffer(data.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = letter_scripts()[points]
    # Lower-case letters one by one, so that places stay those of the text.
    low = data.lower()
    if len(low) != len(data):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in data)
    folded = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
    inside = np.concatenate([[False], kinds > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begins, ends = edges[::2], edges[1::2]
    letters = np.where(kinds > 0, folded, 0)
    around = np.concatenate([[0], letters, [0]]).astype("u4")
    at = np.flatnonzero(kinds)
    grams = (around[at] * np.uint32(0x9E3779B1)) ^ (around[at + 1] * np.uint32(0x85EBCA77)) ^ (around[at + 2] * np.uint32(0xC2B2AE3D))
    grams = ((grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    doc = np.searchsorted(starts, begins, "right") - 1
    first = np.concatenate([[0], np.cumsum(ends - begins)])
    return Words(doc, begins - starts[doc], ends - starts[doc], kinds[begins], first, grams.astype("i8"))


@dataclass
class Model:
    """Log-probabilities of trigrams, bucket by language, and which scripts a language uses."""

    languages: list[str]
    logs: np.ndarray
    allowed: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        """Word by language; languages that do not use the word's script have none if others do."""
        sums = np.add.reduceat(self.logs[words.grams], words.first[:-1], axis=0)
        sums /= np.sqrt(words.ends - words.begins)[:, None].astype("f4")
        fits = self.allowed[words.scripts]
        fits |= ~fits.any(1)[:, None]
        return np.where(fits, sums, np.float32(-1e6))


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word of texts of ``counts`` words; all texts advance word by word together."""
    n, many = scores.shape
    back = np.zeros((n, many), "u1" if many <= 256 else "u2")
    starts = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    starts, left = starts[order], counts[order]
    longest = int(left[0]) if len(left) else 0
    alive = len(left) - np.searchsorted(left[::-1], np.arange(longest), "right")
    best = scores[starts[: alive[0]]].copy() if longest else scores[:0]
    stay = np.arange(many, dtype=back.dtype)
    ends = np.zeros(len(left), "i8")
    for t in range(1, longest):
        m = alive[t]
        if m < len(best):
            ends[m : len(best)] = best[m:].argmax(1)
            best = best[:m]
        top = best.argmax(1)
        switch = best[np.arange(m), top] - penalty
        move = best < switch[:, None]
        at = starts[:m] + t
        back[at] = np.where(move, top[:, None].astype(back.dtype), stay)
        best = np.where(move, switch[:, None], best) + scores[at]
    if longest:
        ends[: len(best)] = best.argmax(1)
    labels = np.zeros(n, "i4")
    now = ends.copy()
    for t in range(longest - 1, -1, -1):
        m = alive[t]
        at = starts[:m] + t
        labels[at] = now[:m]
        now[:m] = back[at, now[:m]]
    return labels


def best_labels(scores: np.ndarray, doc: np.ndarray, n: int, penalty: float) -> np.ndarray:
    """Viterbi labels of the words of ``n`` texts.

    The language of largest total is best for a whole text unless (a) some stretch of words gains more
    than the penalty under another: ``m`` stretches beside words of the main language take at least
    ``m`` switches; or (b) the words' best other languages gain more than the penalty over it together:
    without any word of the main language ``m`` stretches take only ``m - 1`` switches, and with none
    of these nothing is gained. Only texts that fail a test need the search.
    """
    counts = np.bincount(doc, minlength=n)
    firsts = np.cumsum(counts) - counts
    held = np.flatnonzero(counts)
    totals = np.zeros((n, scores.shape[1]))
    totals[held] = np.add.reduceat(scores, firsts[held], axis=0, dtype="f8")
    main = totals.argmax(1)
    labels = main[doc].astype("i4")
    own = scores[np.arange(len(doc)), labels].astype("f8")
    mixed = np.zeros(n, bool)
    least_gain = penalty - 1e-3
    others = np.full(len(doc), -np.inf)
    for k in range(scores.shape[1]):
        gains = scores[:, k] - own
        others = np.where(labels == k, others, np.maximum(others, gains))
        # A word beyond these bounds settles its stretches alone; sums of bounded gains stay precise.
        gains = np.clip(gains, -2 * penalty - 1, 2 * penalty + 1)
        rises, falls = np.maximum(gains, 0), np.maximum(-gains, 0)
        risen, fallen = np.cumsum(rises) - rises, np.cumsum(falls) - falls
        # Rises count from the text's start and falls from the first text's: each text starts at or below
        # all sums before it, so that the running least value starts anew.
        before = risen - risen[firsts[doc]] - fallen
        mixed[doc[before + gains - np.minimum.accumulate(before) > least_gain]] = True
    if scores.shape[1] > 1:
        mixed[held] |= np.add.reduceat(others, firsts[held]) > least_gain
    if mixed.any():
        hard = mixed[doc]
        labels[hard] = viterbi(scores[hard], counts[mixed], penalty)
    return labels


def learn(
    docs: DataFrame,
    labelled: Column,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    sample: int = 20_000,
    smooth: float = 0.5,
) -> Model:
    """A model from about ``sample`` of the rows for which ``labelled`` holds (all, if there are fewer).

    The sample is drawn by a hash of id and language; the whole texts of its rows count. Letter
    trigrams are counted task by task and added up by language and bucket.
    """
    rows = docs.where(labelled & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    total = rows.count()
    if total > sample:
        share = F.pmod(F.xxhash64("id", "lang"), F.lit(1 << 20))
        rows = rows.where(share < max(1, sample * (1 << 20) // total))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            for a, b in slices([len(t) for t in texts], LETTERS):
                words = words_of(texts[a:b])
                lengths = words.ends - words.begins
                own = langs[a:b][words.doc]
                for lang in set(own):
                    mine = own == lang
                    total = counts.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS) + 1, "i8"))
                    total[:BUCKETS] += np.bincount(words.grams[np.repeat(mine, lengths)], minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(
                        words.scripts[mine], lengths[mine], minlength=len(SCRIPTS) + 1
                    ).astype("i8")
        for lang, total in counts.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used)), pa.array(used), pa.array(total[used])], ["lang", "bucket", "n"]
            )

    counted = (
        rows.select("text", "lang").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    )
    # At most one row per language and bucket.
    found = counted.toPandas()
    languages = sorted(found["lang"].unique())
    table = np.zeros((BUCKETS + len(SCRIPTS) + 1, len(languages)))
    places = {lang: i for i, lang in enumerate(languages)}
    table[found["bucket"].to_numpy(), found["lang"].map(places).to_numpy(dtype="i8") if len(found) else []] = found["n"]
    grams, scripts = table[:BUCKETS] + smooth, table[BUCKETS:]
    logs = np.log(grams / grams.sum(0)) if languages else grams
    return Model(languages, logs.astype("f4"), scripts >= OWN_SCRIPT * np.maximum(scripts.sum(0), 1))


def label(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = 8.0, spans: bool = True) -> DataFrame:
    """The documents with ``lang_pred``, ``score`` and, on demand, ``spans`` (begin, end, language; code points)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    fields += [StructField("spans", ArrayType(SPAN))] * spans

    def fill(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = column_of(batch, text_col)
        # About six letters make a word: so many texts are judged together.
        parts = [
            predict(texts.slice(a, b - a).to_pylist(), shared.value, penalty, spans)
            for a, b in slices(byte_lengths(texts), 6 * WORDS)
        ]
        return [pa.concat_arrays(columns) for columns in zip(*parts)]

    return add_columns(docs, fields, fill)


def predict(texts: list[str | None], model: Model, penalty: float, spans: bool) -> list[pa.Array]:
    texts = [t or "" for t in texts]
    names = model.languages
    langs, scores, found = [], [], []
    for a, b in slices([len(t) for t in texts], 6 * WORDS):
        parts, docs, begins, ends = [], [], [], []
        for c, d in slices([len(t) for t in texts[a:b]], LETTERS):
            words = words_of(texts[a + c : a + d])
            if len(words.doc) and names:
                parts.append(model.scores(words))
                docs.append(words.doc + c)
                begins.append(words.begins)
                ends.append(words.ends)
        n = b - a
        votes = np.zeros((n, max(1, len(names))))
        if parts:
            doc, begin, end = np.concatenate(docs), np.concatenate(begins), np.concatenate(ends)
            labels = best_labels(np.concatenate(parts), doc, n, penalty)
            votes = np.bincount(doc * len(names) + labels, end - begin, n * len(names)).reshape(n, -1)
        total = votes.sum(1)
        top = votes.argmax(1)
        share = np.divide(votes[np.arange(n), top], total, out=np.zeros(n), where=total > 0)
        langs += [names[i] if t else "und" for i, t in zip(top, total)]
        scores += share.tolist()
        if spans:
            own: list[list[dict]] = [[] for _ in range(n)]
            if parts:
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (labels[1:] != labels[:-1])
                firsts = np.flatnonzero(new)
                lasts = np.append(firsts[1:], len(doc)) - 1
                for i, j in zip(firsts.tolist(), lasts.tolist()):
                    own[doc[i]].append({"begin": int(begin[i]), "end": int(end[j]), "lang": names[labels[i]]})
            found += own
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
    return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())] + ([pa.array(found, kind)] if spans else [])
