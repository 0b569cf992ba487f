"""Personal data by candidate gradient boosting, on DataFrame functions alone.

Base spans follow fixed rules per kind (pattern and check). Beside them, generators of high recall
propose overlapping candidates. A candidate has format features (kind, digits in steps of four,
separators, grouping) and context features (the characters around it, cue words before it). Its
training label is whether the base rules verify it; no feature repeats a rule's check (a leading plus,
the number of digits, the check digit), so look-alikes of verified data in verified data's surroundings
score high. Features are small whole numbers, so all candidates of the corpus count into a table of
bounded size, on which trees are boosted; scores are calibrated on a held-out half, and per kind the
least score whose share of verified candidates, by the rule of succession, reaches the wanted precision
selects. Chosen candidates that overlap no base span are gone through from left to right: of two that
overlap the likelier stays, and what is left is added; base spans stay. Spans of one text are swept in
order, so a text with very many of them takes time in proportion to their number.

Positions are code points, ends exclusive. Cases: a null or empty text has no spans; repeated rows
are judged alike; ties between overlapping candidates go to the earlier kind, then start; without
candidates nothing is learned and only base spans remain. Other columns are kept; one with the name
of a result is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from folio_spark.functions.binding import let
from folio_spark.llm.common import spare_name

# Kinds in their order, patterns, cue words.
KINDS = ["email", "ip", "card", "phone"]
# Possessive forms match what the plain ones do, without backtracking or deep recursion.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
AT, DOT = r"(?:@|\x20?[(\[]at[)\]]\x20?|\x20at\x20)", r"(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)"
GENERATORS = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:[.,:-][0-9]++){3,}+",
    "number": r"\+?+\(?+[0-9](?:[\x20().\x2F-]{0,2}+[0-9])++",
}
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write)\b",
    "ip": r"(?i)\b(?:ip|host|address|server|addr)\b",
    "card": r"(?i)\b(?:card|visa|credit|payment|account)\b",
    "phone": r"(?i)\b(?:tel|phone|call|fax|mobile|cell)\b",
}
OTHER_CUE = r"(?i)\b(?:token|key|id|order|invoice|version|isbn|hash|no)\b\W*$"
#: Code points of context on either side.
CONTEXT = 24
LEAST_DIGITS = 7
FEATURES = ["kind", "size", "separators", "grouping", "before", "after", "cue"]
#: Values of each feature, in the order above: the training table has at most their product of rows, twice over.
WIDTHS = [4, 7, 6, 3, 5, 5, 3]
CHUNK = 512


def scan(items: Column, carry: Column, step: Callable[[Column, Column], tuple[Column, Column]], emits: str) -> Column:
    """``carry`` and ``out`` of a pass over an array: each item gives a new carry and an element of type ``emits``.

    Elements are gathered in chunks, so a long array takes linear time.
    """

    def add(state: Column, item: Column) -> Column:
        new, element = step(state["carry"], item)
        return F.struct(new.alias("carry"), F.concat(state["out"], F.array(element)).alias("out"))

    def empty(at: Column) -> Column:
        return F.struct(at.alias("carry"), F.array().cast(f"array<{emits}>").alias("out"))

    def chunk(state: Column, first: Column, every: Column) -> Column:
        own = F.aggregate(F.slice(every, first, CHUNK), empty(state["carry"]), add)
        return let(own, lambda o: F.struct(o["carry"].alias("carry"), F.concat(state["out"], o["out"]).alias("out")))

    def whole(every: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(every), F.lit(1)), F.lit(CHUNK))
        return F.aggregate(firsts, empty(carry), lambda state, first: chunk(state, first, every))

    return let(items, whole)


def starts_of(gaps: Column, lengths: Column) -> Column:
    """Start of each match from the lengths of the pieces between and of the matches."""

    def step(at: Column, piece: Column) -> tuple[Column, Column]:
        begin = at + piece["gap"]
        return begin + piece["length"], begin

    return scan(F.arrays_zip(gaps.alias("gap"), lengths.alias("length")), F.lit(0), step, "int")["out"]


def found(text: Column, pattern: str) -> Column:
    """Matches of a pattern: ``start``, ``end``, ``match``, and the text just before and after."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def located(m: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        return let(
            F.struct(m.alias("m"), pieces.alias("p")),
            lambda both: let(
                starts_of(
                    F.transform(F.slice(both["p"], F.lit(1), F.size(both["m"])), F.length),
                    F.transform(both["m"], F.length),
                ),
                lambda starts: F.transform(
                    both["m"],
                    lambda x, i: F.struct(
                        F.element_at(starts, i + 1).alias("start"),
                        (F.element_at(starts, i + 1) + F.length(x)).alias("end"),
                        x.alias("match"),
                        F.right(F.element_at(both["p"], i + 1), F.lit(CONTEXT)).alias("before"),
                        F.left(F.element_at(both["p"], i + 2), F.lit(CONTEXT)).alias("after"),
                    ),
                ),
            ),
        )

    kind = "array<struct<start:int,end:int,match:string,before:string,after:string>>"
    return let(matches, lambda m: F.when(F.size(m) > 0, located(m)).otherwise(F.array().cast(kind)))


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit is right: from the right, every second digit is doubled."""
    backwards = F.split(F.reverse(digits), "")
    values = F.transform(
        backwards,
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5)),
    )
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, b: a + b) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.try_to_number(p, F.lit("999")) <= 255))
    size = F.length(digits_of(match))
    if kind == "card":
        return size.between(12, 19) & F.when(size.between(12, 19), luhn(digits_of(match))).otherwise(False)
    return size.between(9, 15)


def base_spans(text: Column) -> Column:
    """Verified spans ``start, kind, end`` of all kinds, by start and kind."""

    def of_kind(number: int, kind: str) -> Column:
        kept = F.filter(found(text, BASE[kind]), lambda s: valid(kind, s["match"]))
        return F.transform(
            kept, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"))
        )

    return F.array_sort(F.concat(*(of_kind(number, kind) for number, kind in enumerate(KINDS))))


def side(text: Column, last: bool) -> Column:
    """The character next to a candidate: none, letter, digit, space, other."""
    c = F.right(text, F.lit(1)) if last else F.left(text, F.lit(1))
    return (
        F.when(c == "", 0).when(c.rlike(r"\p{L}"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike(r"\s"), 3).otherwise(4)
    )


def features(kind: int, c: Column) -> Column:
    """The candidate's features as one struct of small numbers."""
    match = c["match"]
    rest = F.regexp_replace(match, "[0-9A-Za-z+]", "")
    kinds = F.array_distinct(F.split(rest, ""))
    separators = (
        F.when(rest == "", 0)
        .when(F.size(kinds) > 1, 5)
        .when(rest.startswith(" "), 1)
        .when(rest.startswith("-"), 2)
        .when(rest.startswith("."), 3)
        .otherwise(4)
    )
    grouping = (
        F.when(match.rlike(r"^[0-9]{4}(?:[\x20-][0-9]{4}){2,}"), 1)
        .when(match.rlike(r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$"), 2)
        .otherwise(0)
    )
    cue = F.when(c["before"].rlike(CUES[KINDS[kind]]), 1).when(c["before"].rlike(OTHER_CUE), 2).otherwise(0)
    values = [
        F.lit(kind),
        F.least(F.floor(F.length(digits_of(match)) / 4), F.lit(WIDTHS[1] - 1)),
        separators,
        grouping,
        side(c["before"], True),
        side(c["after"], False),
        cue,
    ]
    return F.struct(*(v.cast("int").alias(n) for v, n in zip(values, FEATURES)))


def candidates(text: Column) -> Column:
    """Proposals of all generators as ``start, kind, end, f`` (features); a number is proposed as card and as phone."""

    def proposed(spans: Column, kind: int) -> Column:
        return F.transform(
            spans,
            lambda c: F.struct(
                c["start"].alias("start"), F.lit(kind).alias("kind"), c["end"].alias("end"), features(kind, c).alias("f")
            ),
        )

    numbers = F.filter(found(text, GENERATORS["number"]), lambda c: F.length(digits_of(c["match"])) >= LEAST_DIGITS)
    return F.concat(
        proposed(found(text, GENERATORS["email"]), 0),
        proposed(found(text, GENERATORS["ip"]), 1),
        let(numbers, lambda n: F.concat(proposed(n, 2), proposed(n, 3))),
    )


SPANS = "array<struct<start:int,kind:int,end:int>>"


def examined(text: Column) -> tuple[Column, Column]:
    """Base spans and candidates of a text; one without digit and at sign is not searched."""
    some = F.coalesce(text.rlike("[0-9@]|[(\\[]at[)\\]]|\\x20at\\x20"), F.lit(False))
    return F.when(some, base_spans(text)).otherwise(F.array().cast(SPANS)), F.when(some, candidates(text))


def span(s: Column) -> list[Column]:
    return [s[name].alias(name) for name in ("start", "kind", "end")]


def verified(base: Column, proposed: Column) -> Column:
    """The features ``f`` of each candidate, and whether it is a base span: both lie side by side when sorted."""
    none = F.lit(None).cast(f"struct<{','.join(f'{name}:int' for name in FEATURES)}>")
    of_base = F.transform(base, lambda s: F.struct(*span(s), F.lit(0).alias("proposed"), none.alias("f")))
    of_all = F.transform(proposed, lambda c: F.struct(*span(c), F.lit(1).alias("proposed"), c["f"].alias("f")))

    def beside(rows: Column) -> Column:
        marked = F.transform(
            rows,
            lambda r, i: F.struct(
                r["f"].alias("f"),
                r["proposed"].alias("proposed"),
                F.coalesce(
                    F.struct(*span(r)) == let(F.get(rows, i - 1), lambda before: F.struct(*span(before))), F.lit(False)
                ).alias("verified"),
            ),
        )
        return F.filter(marked, lambda r: r["proposed"] == 1)

    return let(F.array_sort(F.concat(of_base, of_all)), beside)


@dataclass
class Tree:
    """Two levels of cuts: a feature and value, then one for either side; leaves in order."""

    cuts: list[tuple[int, int]]
    leaves: list[float]


@dataclass
class Boosted:
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    #: Of each kind, the least score that is selected; None selects nothing.
    thresholds: list[float | None] = field(default_factory=lambda: [None] * len(KINDS))

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            (f, v), *below = tree.cuts
            right = x[:, f] > v
            for s in (0, 1):
                g, w = below[s]
                out += np.where(right == s, np.where(x[:, g] > w, tree.leaves[2 * s + 1], tree.leaves[2 * s]), 0)
        return out

    def score(self, f: Column) -> Column:
        """The margin as an expression over the feature struct."""
        total = F.lit(self.start)
        for tree in self.trees:
            (a, v), (b, w), (c, z) = ((f[FEATURES[g]], w) for g, w in tree.cuts)
            p, q, r, s = tree.leaves
            total = total + F.when(a > v, F.when(c > z, s).otherwise(r)).otherwise(F.when(b > w, q).otherwise(p))
        return total


def best_cut(x: np.ndarray, g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int, int]:
    """The feature and value whose cut gains most on gradients and curvatures."""
    best = (-1.0, 0, WIDTHS[0])
    total_g, total_h = g.sum(), h.sum()
    for f, width in enumerate(WIDTHS):
        left_g = np.cumsum(np.bincount(x[:, f], g, width))[:-1]
        left_h = np.cumsum(np.bincount(x[:, f], h, width))[:-1]
        gain = left_g**2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge)
        v = int(gain.argmax())
        if gain[v] > best[0] + 1e-9:
            best = (float(gain[v]), f, v)
    return best


def boost(x: np.ndarray, hits: np.ndarray, counts: np.ndarray, rounds: int, rate: float, ridge: float = 5.0) -> Boosted:
    """Trees on rows of equal features: ``hits`` of ``counts`` candidates are verified."""
    share = (hits.sum() + 1) / (counts.sum() + 2)
    model = Boosted(float(np.log(share / (1 - share))))
    margin = np.full(len(x), model.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = counts * p - hits, counts * p * (1 - p)
        _, f, v = best_cut(x, g, h, ridge)
        cuts, leaves = [(f, v)], []
        for right in (False, True):
            mine = (x[:, f] > v) == right
            _, k, w = best_cut(x[mine], g[mine], h[mine], ridge)
            cuts.append((k, w))
            for side_right in (False, True):
                leaf = mine & ((x[:, k] > w) == side_right)
                leaves.append(float(-rate * g[leaf].sum() / (h[leaf].sum() + ridge)))
        model.trees.append(Tree(cuts, leaves))
        margin = model.start + model.margins(x) - model.start
    return model


def calibrated(model: Boosted, x: np.ndarray, hits: np.ndarray, counts: np.ndarray, precision: float) -> Boosted:
    """Per kind the least margin from which the held-out candidates' calibrated share reaches the precision.

    The share of few candidates counts for less: one hit and one miss are added to each block.
    """
    margins = model.margins(x)
    for kind in range(len(KINDS)):
        mine = np.flatnonzero(x[:, 0] == kind)
        blocks: list[list[float]] = []  # pool adjacent violators: hits, counts, least margin
        for i in mine[np.argsort(margins[mine], kind="stable")]:
            blocks.append([hits[i], counts[i], margins[i]])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                a, b = blocks.pop(), blocks.pop()
                blocks.append([a[0] + b[0], a[1] + b[1], b[2]])
        chosen = [b for b in blocks if b[0] + 1 >= precision * (b[1] + 2)]
        if chosen:
            model.thresholds[kind] = float(chosen[0][2]) - 1e-9
    return model


def learn(
    docs: DataFrame,
    text_col: str = "text",
    rounds: int = 30,
    rate: float = 0.3,
    precision: float = 0.9,
) -> Boosted:
    """Trees and thresholds from all candidates of the corpus."""
    text = F.col(text_col)
    table = (
        docs.select(F.pmod(F.xxhash64(text), F.lit(2)).alias("half"), F.explode(verified(*examined(text))).alias("c"))
        .groupBy("half", "c.f")
        .agg(F.count_if(F.col("c.verified")).alias("hits"), F.count("*").alias("n"))
    )
    # A row for each combination of features that occurs: bounded by the product of their widths.
    rows = [(r["half"], *r["f"], r["hits"], r["n"]) for r in table.collect()]
    if not rows:
        return Boosted()
    data = np.array(sorted(rows), "i8")
    x, hits, counts = data[:, 1:-2], data[:, -2].astype(float), data[:, -1].astype(float)
    fit, rest = data[:, 0] == 0, data[:, 0] == 1
    model = boost(x[fit], hits[fit], counts[fit], rounds, rate)
    return calibrated(model, x[rest], hits[rest], counts[rest], precision)


def clear_of(base: Column, chosen: Column) -> Column:
    """The chosen candidates that overlap no base span, by start: one pass from either side."""
    of_base = F.transform(base, lambda s: F.struct(*span(s), F.lit(None).cast("double").alias("loss")))

    def forward(reached: Column, s: Column) -> tuple[Column, Column]:
        """``reached``: the greatest end of the base spans so far."""
        free = s["loss"].isNotNull() & (reached <= s["start"])
        return F.when(s["loss"].isNull(), F.greatest(reached, s["end"])).otherwise(reached), F.struct(
            *span(s), s["loss"].alias("loss"), free.alias("free")
        )

    def backward(next_: Column, s: Column) -> tuple[Column, Column]:
        """``next_``: the start of the base span behind."""
        free = s["free"] & (next_ >= s["end"])
        return F.when(s["loss"].isNull(), s["start"]).otherwise(next_), F.struct(*span(s), s["loss"].alias("loss"), free.alias("free"))

    item = "struct<start:int,kind:int,end:int,loss:double,free:boolean>"
    # A base span stands before a candidate of the same start.
    by_start = F.array_sort(
        F.transform(
            F.concat(of_base, chosen),
            lambda s: F.struct(s["start"].alias("start"), s["loss"].isNotNull().alias("mine"), *span(s)[1:], s["loss"].alias("loss")),
        )
    )
    one = scan(by_start, F.lit(0), forward, item)["out"]
    two = scan(F.reverse(one), F.lit(2**31 - 1), backward, item)["out"]
    return F.filter(F.reverse(two), lambda s: s["free"])


def likelier(free: Column) -> Column:
    """From left to right, of two candidates that overlap the one of less loss (then the earlier kind, then start)."""
    kept = "struct<start:int,kind:int,end:int,loss:double>"
    nothing = F.lit(None).cast(kept)

    def plain(s: Column) -> Column:
        return F.struct(*span(s), s["loss"].alias("loss"))

    def rank(s: Column) -> Column:
        return F.struct(s["loss"], s["kind"], s["start"])

    def step(held: Column, s: Column) -> tuple[Column, Column]:
        apart = held.isNull() | (s["start"] >= held["end"])
        return F.when(apart | (rank(s) < rank(held)), plain(s)).otherwise(held), F.when(apart, held)

    done = scan(free, nothing, step, kept)
    last = let(done, lambda d: F.concat(d["out"], F.array(d["carry"])))
    return F.transform(F.filter(last, lambda s: s.isNotNull()), lambda s: F.struct(*span(s)))


def annotate(docs: DataFrame, model: Boosted, text_col: str = "text") -> DataFrame:
    """The documents with ``base_spans`` and ``pii_spans`` (all): arrays of ``start, kind, end`` by start and kind."""
    kept = [c for c in docs.columns if c.lower() not in ("base_spans", "pii_spans")]
    # Columns of their own: what is used several times below is computed once.
    names = [spare_name(docs, "base"), spare_name(docs, "candidates")]
    rows = docs.select(*kept, *(c.alias(n) for c, n in zip(examined(F.col(text_col)), names)))
    base, proposed = (F.col(n) for n in names)
    if not any(t is not None for t in model.thresholds):
        return rows.select(*kept, base.alias("base_spans"), base.alias("pii_spans"))
    limits = F.array(*(F.lit(float("inf") if t is None else t) for t in model.thresholds))
    scored = F.transform(proposed, lambda c: F.struct(*span(c), (-model.score(c["f"])).alias("loss")))
    chosen = F.filter(scored, lambda c: -c["loss"] >= F.element_at(limits, c["kind"] + 1))
    added = let(chosen, lambda some: F.when(F.size(some) > 0, likelier(clear_of(base, some))))
    spans = F.array_sort(F.concat(base, F.coalesce(added, F.array().cast(SPANS))))
    return rows.select(*kept, base.alias("base_spans"), spans.alias("pii_spans"))


def shown(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first names the place."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def add(state: Column, s: Column) -> Column:
        inside = s["start"] < state["at"]
        piece = F.concat(
            F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.element_at(names, s["kind"] + 1)
        )
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(inside, state["out"]).otherwise(F.concat(state["out"], F.array(piece))).alias("out"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = let(
        F.aggregate(spans, begin, add),
        lambda d: F.concat(F.array_join(d["out"], ""), F.substring(text, d["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)
