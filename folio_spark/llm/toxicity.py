"""Toxicity scores by weak supervision.

1. Lexicons come from a bounded sample of labelled texts: words, and five-byte word beginnings, that
   toxic texts hold far more often than others. Dealt out by rank they make many lexicon voters; more
   voters are patterns (a published list of insults, several different entries in one text, an entry
   in capitals or before an exclamation mark, an entry near a second-person pronoun).
2. Every text's votes are one pattern of bits; patterns are counted over all texts. A generative label
   model explains the counts: a hidden label, each voter's accuracy under it, and correlations, each
   voter depending on one other (the tree of largest mutual information given the label). It is
   fitted by expectation maximisation, with the labels of the sample held fixed.
3. A linear classifier on words and word beginnings learns the posterior labels of a bounded sample of
   texts; its threshold is set on the labelled sample. It scores all texts.

Cases: a null or empty text is scored by the classifier's constant; a label that is null counts as
none; without labels of both kinds the lexicons are empty and only the pattern voters vote; ties in
rank go to the smaller term; repeated rows are scored alike. A column of the documents with the name
of a result is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from folio_spark.llm.common import add_columns, as_bytes, column_of

# Widely published insults and second-person pronouns.
INSULTS = b"idiot moron stupid loser scum trash worthless pathetic disgusting dumb imbecile jerk freak filth vermin".split()
PRONOUNS = b"you your yours u du dich dein tu toi vous te ti usted".split()

#: ASCII letters (lower-cased) and bytes beyond ASCII are parts of words, all others separate them.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
PREFIX = 5
WORD_VOTERS, PREFIX_VOTERS = 6, 3
PATTERN_VOTERS = 5


def terms_of(text: bytes) -> set[bytes]:
    """Distinct words, and beginnings of longer words with a mark before them."""
    words = set(text.translate(LETTERS).split())
    return words | {b"^" + w[:PREFIX] for w in words if len(w) > PREFIX}


@dataclass
class Voters:
    """Lexicon entries with their voter's number, and the patterns."""

    lexicon: dict[bytes, int]

    def votes(self, text: bytes, terms: set[bytes]) -> int:
        """The votes of a text as bits."""
        bits, found = 0, [t for t in self.lexicon.keys() & terms]
        for term in found:
            bits |= 1 << self.lexicon[term]
        at = WORD_VOTERS + PREFIX_VOTERS
        words = [t for t in found if not t.startswith(b"^")]
        insults = terms.intersection(INSULTS)
        bits |= bool(insults) << at
        bits |= (len(words) > 1) << at + 1
        bits |= (len(words) > 3) << at + 2
        spoken = words + list(insults)
        if spoken:
            one = b"(?:" + b"|".join(sorted(map(re.escape, spoken))) + b")"
            bits |= bool(re.search(rb"\b" + one.upper() + rb"\b|\b" + one + rb"\s*!", text)) << at + 3
            if not terms.isdisjoint(PRONOUNS):
                low = b" ".join(text.translate(LETTERS).split())
                near = rb"(?:^| )(?:" + b"|".join(PRONOUNS) + rb")(?: \S+){0,3} " + one + rb"(?: |$)"
                bits |= bool(re.search(near, low)) << at + 4
        return bits


N_VOTERS = WORD_VOTERS + PREFIX_VOTERS + PATTERN_VOTERS


def choose(stats: list[tuple[bytes, int, int]], positives: int, negatives: int, size: int) -> Voters:
    """Lexicons of the terms of highest odds: words to some voters, beginnings to others, dealt by rank."""
    ranked = []
    for term, pos, neg in stats:
        odds = np.log((pos + 0.5) / (positives + 1)) - np.log((neg + 0.5) / (negatives + 1))
        if pos >= 4 and odds > 3:
            ranked.append((-odds, term))
    lexicon: dict[bytes, int] = {}
    words = prefixes = 0
    for _, term in sorted(ranked)[:size]:
        if term.startswith(b"^"):
            lexicon[term] = WORD_VOTERS + prefixes % PREFIX_VOTERS
            prefixes += 1
        else:
            lexicon[term] = words % WORD_VOTERS
            words += 1
    return Voters(lexicon)


class LabelModel:
    """A hidden binary label behind binary voters, each depending on the label and one other voter."""

    def __init__(self, votes: np.ndarray, counts: np.ndarray, labelled: np.ndarray, rounds: int = 40):
        """``votes``: pattern by voter; ``counts``: texts without a label; ``labelled``: with label 0 and 1."""
        self.votes = votes.astype(int)
        known = labelled + 1e-9
        # Begin with what the labels of the sample say of each pattern.
        self.prior = np.array([0.9, 0.1]) if not labelled.sum() else known.sum(0) / known.sum()
        toxic = np.where(votes.any(1), 0.9, 0.1)
        weights = known if labelled.sum() else counts[:, None] * np.stack([1 - toxic, toxic], 1)
        self.parent = np.full(votes.shape[1], -1)
        self.fit(weights)
        for step in range(rounds):
            toxic = self.posteriors()
            weights = counts[:, None] * np.stack([1 - toxic, toxic], 1) + known
            if step in (0, rounds // 2):
                self.relate(weights)
            self.fit(weights)

    def relate(self, weights: np.ndarray) -> None:
        """Each voter's parent in the tree of largest mutual information given the label."""
        k = self.votes.shape[1]
        share = np.zeros((k, k))
        total = max(weights.sum(), 1e-6)
        for y in (0, 1):
            w = weights[:, y] + 1e-9
            for a in (0, 1):
                for b in (0, 1):
                    left, right = self.votes == a, self.votes == b
                    joint = (left * w[:, None]).T.astype(float) @ right + 1e-6
                    apart = np.outer(left.T @ w, right.T @ w) + 1e-6
                    share += joint / total * np.log(joint * max(w.sum(), 1e-6) / apart)
        self.correlation = share
        reached = [0]
        while len(reached) < k:
            rest = [j for j in range(k) if j not in reached]
            part = share[np.ix_(reached, rest)]
            i, j = np.unravel_index(part.argmax(), part.shape)
            self.parent[rest[j]] = reached[i]
            reached.append(rest[j])

    def fit(self, weights: np.ndarray) -> None:
        """Rates ``P(vote | parent's vote, label)``; a voter's accuracy is its rate under each label."""
        k = self.votes.shape[1]
        self.prior = (weights.sum(0) + 1) / (weights.sum() + 2)
        self.rates = np.zeros((k, 2, 2))
        self.accuracy = (self.votes.T @ weights + 1) / (weights.sum(0) + 2)
        for j in range(k):
            up = self.votes[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(self.votes), int)
            for p in (0, 1):
                w = weights * (up == p)[:, None]
                # Smoothed towards the rate that ignores the parent.
                self.rates[j, p] = (self.votes[:, j] @ w + 2 * self.accuracy[j]) / (w.sum(0) + 2)

    def posteriors(self, votes: np.ndarray | None = None) -> np.ndarray:
        votes = self.votes if votes is None else votes.astype(int)
        logs = np.tile(np.log(self.prior), (len(votes), 1))
        for j in range(votes.shape[1]):
            up = votes[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(votes), int)
            rate = self.rates[j][up]
            logs += np.log(np.where(votes[:, j : j + 1] == 1, rate, 1 - rate))
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))


@dataclass
class Classifier:
    weights: dict[bytes, float]
    constant: float
    scale: float
    threshold: float

    def logit(self, terms: set[bytes]) -> float:
        return self.constant + sum(map(self.weights.__getitem__, sorted(self.weights.keys() & terms)))

    def score(self, terms: set[bytes]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * (self.logit(terms) - self.threshold), -50, 50))))


def fit_linear(rows: list[list[int]], targets: np.ndarray, width: int, ridge: float = 1e-3, steps: int = 300):
    """Logistic regression on presence features with soft targets: accelerated gradient descent."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    place = np.array([j for r in rows for j in r], "i8")
    weights, constant = np.zeros(width), 0.0
    ahead, ahead_constant, momentum = weights, constant, 1.0
    step = 4.0 / (1 + max([1, *(len(r) for r in rows)]) ** 0.5)
    for _ in range(steps):
        z = np.bincount(owner, ahead[place], len(rows)) + ahead_constant
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - targets) / max(1, len(rows))
        slope = np.bincount(place, error[owner], width) + ridge * ahead / max(1, width) ** 0.5
        new, new_constant = ahead - step * slope, ahead_constant - step * error.sum()
        following = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        ahead = new + (momentum - 1) / following * (new - weights)
        ahead_constant = new_constant + (momentum - 1) / following * (new_constant - constant)
        weights, constant, momentum = new, new_constant, following
    return weights, constant


def cut_between(scores: np.ndarray, labels: np.ndarray) -> float:
    """The threshold with the best F1 on labelled scores: half way between two neighbours."""
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    f1[:-1][s[:-1] == s[1:]] = -1
    best = int(f1.argmax())
    return float((s[best] + s[best + 1]) / 2) if best + 1 < len(s) else float(s[best]) - 1.0


def learn(
    docs: DataFrame,
    labels: DataFrame,
    allowed: Callable[[Column], Column],
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = 15_000,
    lexicon: int = 600,
    features: int = 2_000,
) -> tuple[Classifier, LabelModel]:
    """The classifier and the label model.

    ``allowed``: whether the label of a document of this id may be used. About ``sample`` labelled texts
    are drawn by a hash of the id for lexicons and features, and as many texts of any kind for the
    classifier; votes are counted over all texts.
    """
    spark = docs.sparkSession
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    named = named.where(F.col("y").isin(0, 1)).where(allowed(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    total = named.count()
    if total > sample:
        named = named.where(share < max(1, sample * (1 << 20) // total))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    # Of the size of the sample.
    labelled = texts.join(F.broadcast(named), "id").select("text", "y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist()):
                sides[y].update(terms_of(text))
        terms = [t for t in {*sides[0], *sides[1]}]
        if terms:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(terms, pa.binary()),
                    pa.array([sides[1][t] for t in terms], pa.int64()),
                    pa.array([sides[0][t] for t in terms], pa.int64()),
                ],
                ["term", "pos", "neg"],
            )

    stats = labelled.mapInArrow(count, "term binary, pos long, neg long").groupBy("term").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    # Evidence: how far a term's share among toxic texts is from its share among the others, over its error.
    weight = F.abs(F.col("pos") * F.col("n0") - F.col("neg") * F.col("n1")) / F.sqrt(F.col("pos") + F.col("neg"))
    positives, negatives = labelled.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    positives, negatives = positives or 0, negatives or 0
    top = (
        stats.where("pos + neg >= 4")
        .withColumns({"n1": F.lit(positives), "n0": F.lit(negatives)})
        .withColumn("weight", weight)
        .orderBy(F.col("weight").desc(), "term")
        .limit(features)
        .collect()
    )
    chosen = [(bytes(r["term"]), r["pos"], r["neg"]) for r in top]
    voters = spark.sparkContext.broadcast(choose(chosen, positives, negatives, lexicon))
    vocabulary = spark.sparkContext.broadcast({t: i for i, (t, _, _) in enumerate(chosen)})

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Patterns met by this task: at most one for each combination of votes.
        seen: Counter = Counter()
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                seen[voters.value.votes(text, terms_of(text))] += 1
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()))], ["bits", "n"])

    patterns = texts.select("text").mapInArrow(vote, "bits long, n long").groupBy("bits").agg(F.sum("n")).collect()

    def examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, places = [], []
            for text in as_bytes(batch.column(0)):
                terms = terms_of(text)
                bits.append(voters.value.votes(text, terms))
                places.append(sorted(map(vocabulary.value.__getitem__, vocabulary.value.keys() & terms)))
            if bits:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bits, pa.int64()), pa.array(places, pa.list_(pa.int32())), batch.column(1)],
                    ["bits", "places", "y"],
                )

    shape = "bits long, places array<int>, y int"
    known = labelled.mapInArrow(examine, shape).collect()  # of the size of the sample
    everything = texts.where(allowed(F.col("id")))
    population = sum(r[1] for r in patterns)
    if population > sample:
        everything = everything.where(share < max(1, sample * (1 << 20) // population))
    drawn = everything.select("text", F.lit(None).cast("int").alias("y")).mapInArrow(examine, shape).collect()

    counts = {r[0]: r[1] for r in patterns}
    marks = Counter((r["bits"], r["y"]) for r in known)
    masks = sorted({*counts, *(b for b, _ in marks)})
    votes = (np.array(masks, "i8").reshape(-1, 1) >> np.arange(N_VOTERS)) & 1
    fixed = np.array([[marks[m, 0], marks[m, 1]] for m in masks], float).reshape(-1, 2)
    free = np.array([max(0, counts.get(m, 0) - marks[m, 0] - marks[m, 1]) for m in masks], float)
    model = LabelModel(votes, free, fixed)
    posterior = dict(zip(masks, model.posteriors()))
    rows = known + drawn
    extra = sorted({r["bits"] for r in drawn} - posterior.keys())
    if extra:
        new = (np.array(extra, "i8").reshape(-1, 1) >> np.arange(N_VOTERS)) & 1
        posterior.update(zip(extra, model.posteriors(new)))
    targets = np.array([posterior[r["bits"]] for r in rows])
    places = [r["places"] for r in rows]
    weights, constant = fit_linear(places, targets, max(1, len(vocabulary.value)))
    logits = np.array([weights[p].sum() + constant for p in places[: len(known)]])
    truth = np.array([r["y"] for r in known])
    threshold = cut_between(logits, truth) if len(truth) and truth.any() else 0.0
    made = {t: float(weights[i]) for t, i in vocabulary.value.items() if weights[i]}
    return Classifier(made, float(constant), 1.0, threshold), model


def score(docs: DataFrame, classifier: Classifier, text_col: str = "text") -> DataFrame:
    """The documents with ``score`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def fill(batch: pa.RecordBatch) -> list[pa.Array]:
        scores = [shared.value.score(terms_of(t)) for t in as_bytes(column_of(batch, text_col))]
        return [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]

    return add_columns(docs, [StructField("score", DoubleType()), StructField("predicted", IntegerType())], fill)
