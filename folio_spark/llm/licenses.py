"""Licence scan with a positional index that is looked up from the rarest words on.

``document_counts`` counts, over all documents, how many hold each word of the templates: its IDF. A
template may miss a share of its words, say ``m`` of them, so every match holds one of its ``m + 1``
words of highest IDF, wherever it stands. Only their postings in a file are looked up; each proposes
a start (its place less its offset in the template), and the template's other words are intersected by
relative position, in order of falling IDF: a start that misses more than ``m`` is dropped at once. What
is left is checked for the template's mandatory key phrases and scored by the share of IDF found.
A phrase is a template that may miss nothing, so all its places are found.

With ``slop``, a word of a template (not of a phrase) may stand so many places from its own.

Cases: a null or empty text, or one without words, has no places, no labels and score 0; a long text
is indexed whole, in blocks of its words; repeated rows are scanned each; an empty table gives no rows;
ids aren't read. A column of the documents with the name of a result, letter case aside, is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from folio_spark.llm.common import add_columns, as_bytes, column_of, give_back
from folio_spark.llm.decontam import LOWER, words_of

#: Phrases that count at each of their places, and the label of each.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Label, public text of a notice or its begin, phrases that a match must hold.
NOTICES = [
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0",
        ("apache license version 2 0",),
    ),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http www apache org licenses LICENSE 2.0",
        ("compliance with the license", "apache org licenses"),
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
        ("redistribution and use", "source and binary forms"),
    ),
    (
        "cc-by-4.0",
        "licensed under a Creative Commons Attribution 4.0 International License",
        ("creative commons attribution",),
    ),
    (
        "cc-by-nc-4.0",
        "Licensed under CC BY-NC 4.0",
        ("cc by nc 4 0",),
    ),
    (
        "gpl-3.0",
        "licensed under the GNU General Public License, version 3",
        ("gnu general public license version 3",),
    ),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version",
        ("general public license", "free software foundation", "version 3"),
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted",
        ("with or without fee",),
    ),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction, including without limitation the rights to "
        "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted", "free of charge", "without restriction"),
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        ("mozilla public license",),
    ),
]
#: Of a notice's words, the share that a match holds at least.
SHARE = 0.8
SLOP = 2
#: Bytes of one text whose words are looked up together.
BLOCK = 1 << 20
#: Proposed starts intersected together.
STARTS = 1 << 18

RESULT = [
    StructField("n_words", LongType()),
    StructField("places", ArrayType(StructType([StructField("label", StringType()), StructField("start", LongType())]))),
    StructField("base_labels", ArrayType(StringType())),
    StructField("labels", ArrayType(StringType())),
    StructField("score", DoubleType()),
]


@dataclass
class Template:
    label: str
    words: np.ndarray  # numbers of its words
    keys: list[np.ndarray]
    missing: int  # words that a match may miss
    slop: int
    phrase: bool
    order: np.ndarray | None = None  # places in the template by falling IDF


class Templates:
    """The templates as numbers of their words, and the IDF of each word."""

    def __init__(
        self,
        phrases: dict[str, str] = PHRASES,
        notices: list[tuple[str, str, tuple[str, ...]]] = NOTICES,
        share: float = SHARE,
        slop: int = SLOP,
    ):
        self.words: dict[bytes, int] = {}
        self.all = [Template(label, self.numbers(text), [], 0, 0, True) for text, label in phrases.items()]
        for label, text, keys in notices:
            own = self.numbers(text)
            missing = len(own) - math.ceil(share * len(own) - 1e-9)
            self.all.append(Template(label, own, [self.numbers(k) for k in keys], missing, slop, False))
        self.idf = np.ones(len(self.words))
        self.rank()

    def numbers(self, text: str) -> np.ndarray:
        found = [self.words.setdefault(w, len(self.words)) for w in words_of(text.encode())]
        return np.array(found, "i4")

    def weigh(self, documents: int, counts: dict[int, int]) -> Templates:
        """Sets the IDF from the number of documents, and of those that hold each word."""
        held = np.array([counts.get(i, 0) for i in range(len(self.words))], "f8")
        self.idf = np.log((documents + 1) / (held + 1)) + 1
        self.rank()
        return self

    def rank(self) -> None:
        for template in self.all:
            template.order = np.argsort(-self.idf[template.words], kind="stable")


def numbered(text: bytes, words: dict[bytes, int]) -> np.ndarray:
    """The number of each word of a text, -1 for words of no template."""
    text = text.translate(LOWER)
    found, begin = [np.zeros(0, "i4")], 0
    while begin < len(text):
        end = begin + BLOCK
        if end < len(text):  # a block ends at a separator, so that no word is cut
            end = text.find(b" ", end)
            end = len(text) if end < 0 else end
        own = text[begin:end].split()
        found.append(np.fromiter((words.get(w, -1) for w in own), "i4", len(own)))
        begin = end
    return np.concatenate(found)


class File:
    """The positional index of one text: the places of each word of the templates."""

    def __init__(self, text: bytes, words: dict[bytes, int]):
        self.ids = numbered(text, words)
        held = np.flatnonzero(self.ids >= 0)
        self.postings = held[np.argsort(self.ids[held], kind="stable")]
        self.firsts = np.concatenate([[0], np.cumsum(np.bincount(self.ids[held], minlength=len(words)))])

    def places(self, word: int) -> np.ndarray:
        return self.postings[self.firsts[word] : self.firsts[word + 1]]

    def at(self, places: np.ndarray, word: int, slop: int) -> np.ndarray:
        """Whether the word stands at most ``slop`` from each place."""
        found = np.zeros(len(places), bool)
        for shift in range(-slop, slop + 1):
            near = places + shift
            inside = (near >= 0) & (near < len(self.ids))
            found |= inside & (self.ids[np.where(inside, near, 0)] == word)
        return found

    def starts(self, template: Template, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the template's matches, and the share of its IDF that each holds."""
        proposed = []
        for offset in template.order[: template.missing + 1].tolist():
            own = self.places(template.words[offset])
            if len(own):
                proposed += [own + (shift - offset) for shift in range(-template.slop, template.slop + 1)]
        if not proposed:
            return np.zeros(0, "i8"), np.zeros(0)
        every = np.unique(np.concatenate(proposed))
        # A match may begin before the text by as many words as it may miss.
        every = every[(every >= -template.missing) & (every + len(template.words) <= len(self.ids) + template.missing)]
        found, shares = [np.zeros(0, "i8")], [np.zeros(0)]
        for begin in range(0, len(every), STARTS):
            start = every[begin : begin + STARTS]
            missed, weight = np.zeros(len(start), "i4"), np.zeros(len(start))
            for offset in template.order.tolist():
                word = template.words[offset]
                here = self.at(start + offset, word, template.slop)
                weight += here * idf[word]
                missed += ~here
                left = missed <= template.missing
                start, missed, weight = start[left], missed[left], weight[left]
            found.append(start)
            shares.append(weight / idf[template.words].sum())
        start, share = np.concatenate(found), np.concatenate(shares)
        for key in template.keys:
            left = self.holds(key, start - template.slop, start + len(template.words) + template.slop)
            start, share = start[left], share[left]
        return start, share

    def holds(self, key: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether the key phrase stands, word by word, within each range."""
        if not len(begins):
            return np.zeros(0, bool)
        at = self.places(key[0])
        for offset in range(1, len(key)):
            at = at[self.at(at + offset, key[offset], 0)]
        return np.searchsorted(at, ends - len(key), "right") > np.searchsorted(at, begins, "left")


def document_counts(docs: DataFrame, templates: Templates, text_col: str = "text") -> Templates:
    """The templates weighed by all documents. What reaches the driver is one number per word of the templates."""
    words = templates.words

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = 0, np.zeros(len(words), "i8")
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                ids = numbered(text, words)
                held[np.unique(ids[ids >= 0])] += 1
                total += 1
        give_back()
        numbers = np.concatenate([[-1], np.flatnonzero(held)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int64()), pa.array(np.concatenate([[total], held[held > 0]]), pa.int64())],
            ["word", "n"],
        )

    rows = docs.select(text_col).mapInArrow(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {r["word"]: r["n"] for r in rows.collect()}
    return templates.weigh(counts.pop(-1, 0), counts)


def scan(docs: DataFrame, templates: Templates | None = None, text_col: str = "text") -> DataFrame:
    """The documents with ``n_words``, the ``places`` (label and first word) of the phrases, the labels of the phrases
    (``base_labels``) and of all templates (``labels``), and a ``score``: 1 with a phrase, else the greatest share of
    IDF of a notice found.
    """
    weighed = document_counts(docs, templates or Templates(), text_col)
    shared = docs.sparkSession.sparkContext.broadcast(weighed)  # the templates: their size is fixed
    return add_columns(docs, RESULT, lambda batch: scanned(batch, text_col, shared.value))


def scanned(batch: pa.RecordBatch, text_col: str, templates: Templates) -> list[pa.Array]:
    n_words, places, base, labels, scores = [], [], [], [], []
    for text in as_bytes(column_of(batch, text_col)):
        file = File(text, templates.words)
        own, noticed, score = [], set(), 0.0
        for template in templates.all:
            start, share = file.starts(template, templates.idf)
            if not len(start):
                continue
            if template.phrase:
                score = 1.0
                own += [{"label": template.label, "start": int(s)} for s in start]
            else:
                score = max(score, min(1.0, float(share.max())))
                noticed.add(template.label)
        own.sort(key=lambda p: (p["start"], p["label"]))
        n_words.append(len(file.ids))
        places.append(own)
        base.append(sorted({p["label"] for p in own}))
        labels.append(sorted(noticed.union(base[-1])))
        scores.append(score)
    place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    kinds = [pa.int64(), place, pa.list_(pa.string()), pa.list_(pa.string()), pa.float64()]
    return [pa.array(v, k) for v, k in zip((n_words, places, base, labels, scores), kinds)]
