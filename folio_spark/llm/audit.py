"""Filter interaction audit: what each filter removes in every order of the filters.

Each document becomes a mask, one bit for each filter that it fails, and all documents of a part with
the same mask become one weighted cell, so at most 2^filters cells a part are left of any corpus. A
cell is folded across the array of all orders, a constant in the plan, with ``transform`` over orders
and ``aggregate`` along an order: one struct for each order and step, weighted with the cell's counts.
The arrays of a part's cells are merged by elementwise sums, and the Shapley sums are a further fold.

A text's first row (least id) is not a repeat, however many rows have the text: rows meet by the
SHA-256 of their text, and only one narrow row per text, id and part is shuffled, never a text.

Cases: a null text is empty; a null part is the empty string; rows that share an id and a text are
all first or all repeats; a null id has no smaller one and makes no other row a repeat; an id with
several rows of labels is good or toxic if one of them says so; an id without labels is neither; an
empty table has no parts and gives no rows. Only the named columns are read, so others may have any
name.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from folio_spark.llm.common import salted_join, written

#: The counts of a step.
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def text_filters(
    least_words: int = 200, least_distinct: int = 50, most_capitals: int = 3, marks: str = "[#$%&*|]"
) -> dict[str, Column]:
    """Whether a text fails: too few words, too few distinct ones, too many capitals (both per cent), a mark."""
    text, own = F.col("text"), F.col("words")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(own) < least_words,
        "B": 100 * F.size(F.array_distinct(own)) < least_distinct * F.size(own),
        "C": 100 * capitals > most_capitals * F.length(text),
        "D": text.rlike(marks),
    }


def mask_cells(
    docs: DataFrame,
    labels: DataFrame,
    filters: dict[str, Column],
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """Rows ``part, mask, n, good, toxic``: bit i is set if filter i fails, the bit after them for a repeated text.

    ``filters`` are conditions on ``text`` and ``words``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text")
    ).withColumn("words", words(F.col("text")))
    bits = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(filters.values())), F.lit(0))
    # Repeated rows become one with a count, which combines before the shuffle.
    narrow = own.select("id", "part", bits.alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    # Read twice below, so kept as a table: the texts are read and split once.
    rows = written(narrow.groupBy("id", "part", "mask", "digest").agg(F.count("*").alias("n")), "masks")
    # The least id of a text combines likewise; an id meets its texts' firsts by both, so no large group of copies does.
    firsts = rows.groupBy("digest").agg(F.min("id").alias("id")).where("id IS NOT NULL").withColumn("first", F.lit(True))
    repeated = F.col("id").isNotNull() & F.col("first").isNull()
    # Both tables grow with the texts. Spark guesses their size from that of compressed files, without the salted
    # copies, so they are merged at every size and never broadcast.
    marked = rows.join(firsts.hint("merge"), ["id", "digest"], "left").select(
        "id", "part", "digest", "n", (F.col("mask") + F.when(repeated, 1 << len(filters)).otherwise(0)).alias("mask")
    )
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("is_good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("is_toxic"),
    )
    judged = salted_join(marked, known.hint("merge"), "id", "digest", "left")
    return judged.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.col("n") * F.col("is_good")), F.lit(0)).alias("good"),
        F.coalesce(F.sum(F.col("n") * F.col("is_toxic")), F.lit(0)).alias("toxic"),
    )


def folded(mask: Column, n: Column, good: Column, toxic: Column, orders: Column) -> Column:
    """The cell's counts at every step of every order, in the orders' order."""

    def none() -> Column:
        return F.lit(0).cast("long")

    def step(state: Column, place: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1), place)
        fails = mask.bitwiseAND(bit) != 0
        alive = state["alive"]
        removed, kept = alive & fails, alive & ~fails
        counts = (
            F.when(kept, n).otherwise(none()),
            F.when(removed, n).otherwise(none()),
            F.when(~alive & fails, n).otherwise(none()),
            F.when(mask == bit, n).otherwise(none()),
            F.when(removed, good).otherwise(none()),
            F.when(removed, toxic).otherwise(none()),
        )
        one = F.struct(*(c.alias(name) for c, name in zip(counts, COUNTS)))
        return F.struct(kept.alias("alive"), F.concat(state["steps"], F.array(one)).alias("steps"))

    nothing = F.array().cast(f"array<struct<{', '.join(f'{c}: bigint' for c in COUNTS)}>>")
    start = F.struct(F.lit(True).alias("alive"), nothing.alias("steps"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda s: s["steps"])))


def added(one: Column, two: Column) -> Column:
    """Elementwise sums of two arrays of structs of counts."""
    return F.zip_with(one, two, lambda x, y: F.struct(*((x[c] + y[c]).alias(c) for c in COUNTS)))


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """One row for each part, order and step; filter i of the cells' masks has letter i.

    The orders number the factorial of the letters: made for a handful of filters.
    """
    orders = list(permutations(range(len(letters))))
    places = F.array(*(F.array(*(F.lit(p) for p in order)) for order in orders))
    length = len(orders) * len(letters)
    empty = F.struct(*(F.lit(0).cast("long").alias(c) for c in COUNTS))
    steps = folded(*(F.col(c) for c in ("mask", "n", "good", "toxic")), places)
    # A part has one cell per mask at most, so the list is bounded by the number of filters.
    merged = (
        cells.select("part", steps.alias("steps"))
        .groupBy("part")
        .agg(F.collect_list("steps").alias("all"))
        .select("part", F.aggregate("all", F.array_repeat(empty, length), added).alias("steps"))
    )
    flat = F.flatten(places)
    shares = F.transform(
        F.sequence(F.lit(0), F.lit(len(letters) - 1)),
        lambda filter_: F.aggregate(
            F.zip_with("steps", flat, lambda s, place: F.when(place == filter_, s["removed"]).otherwise(0)),
            F.lit(0).cast("long"),
            lambda total, x: total + x,
        ),
    )
    names = F.array(*(F.lit("".join(letters[p] for p in order)) for order in orders))
    rows = merged.withColumn("shapley", shares).select("part", "shapley", F.posexplode("steps").alias("at", "counts"))
    number = F.floor(F.col("at") / len(letters)).cast("int")
    step = (F.col("at") % len(letters)).cast("int")
    order = F.get(names, number)
    return rows.select(
        "part",
        order.alias("filter_order"),
        (step + 1).alias("step"),
        *(F.col("counts")[c].alias(c) for c in COUNTS),
        F.get("shapley", F.get(F.get(places, number), step)).alias("shapley"),
    )
