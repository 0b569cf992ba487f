"""Ordered-page operators that never put a whole book into one task.

A book may hold a large share of all pages, so no window here is partitioned by
the book alone. Pages are cut into *chunks* (a fixed span of page numbers or of
time) and the shuffle key is ``(book, chunk)``. What a chunk must know of its
neighbours arrives in one of two ways:

* ``with_neighbours`` copies the few pages next to a chunk border into the chunk
  that needs them - one shuffle, no join; enough for any bounded look-back;
* ``number_pages`` reduces every chunk to one row first and runs the unbounded
  part over those rows only.

Page numbers are expected to be dense within a book; ``number_pages`` makes them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .skew import salted_join

CHUNK = 4096
#: Tasks that a book's chunks are dealt to where its one row (a cut, a restart) meets its pages.
BOOK_SALTS = 32
_CHUNK, _OWN = "_chunk", "_own"


def keys_of(book: str | Sequence[str]) -> list[str]:
    return [book] if isinstance(book, str) else list(book)


def page_chunk(page: str | Column, width: int = CHUNK) -> Column:
    page = F.col(page) if isinstance(page, str) else page
    return F.floor(page / F.lit(width)).cast("bigint")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    c = F.col(ts)
    days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("bigint")
    whole = (days * 24 + F.hour(c)) * 60 + F.minute(c)
    seconds = F.expr(f"extract(SECOND FROM {ts})")
    return whole * 60_000_000 + (seconds * 1_000_000).cast("bigint")


def time_chunk(ts: str, seconds: int = 3600) -> Column:
    return F.floor(micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def number_pages(
    df: DataFrame,
    book: str | Sequence[str],
    order: Sequence[str],
    chunk: Column,
    *,
    name: str = "page",
    start: int = 1,
) -> DataFrame:
    """Add dense page numbers in ``order`` within each book.

    ``chunk`` must not decrease along ``order``. Rows are ranked inside
    ``(book, chunk)``; only the per-chunk counts, one row each, are summed along
    the book.
    """
    keys = keys_of(book)
    rows = df.withColumn(_CHUNK, chunk)
    placed = rows.repartition(*keys, _CHUNK)
    counts = rows.groupBy(*keys, _CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    earlier = (
        Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        *keys, _CHUNK, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    return (
        placed.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, [*keys, _CHUNK])
        .withColumn(name, (F.col("_before") + F.col("_rank") + F.lit(start - 1)).cast("bigint"))
        .drop(_CHUNK, "_rank", "_before")
    )


def with_neighbours(
    df: DataFrame, book: str | Sequence[str], page: str, *, before: int = 0, after: int = 0, width: int = CHUNK
) -> DataFrame:
    """Place every page in its chunk, and border pages also in the next one.

    Adds ``_chunk`` and ``_own`` (false on the borrowed copies). ``before`` and
    ``after`` say how many neighbours a page must see; both are at most ``width``.
    The result is shuffled by book and chunk even if the input is laid out by book,
    which the windows over it would otherwise accept.
    """
    if max(before, after) > width:
        raise ValueError("neighbourhood is wider than a chunk")
    home = page_chunk(page, width)
    places = [home]
    if before:
        places.append(page_chunk(F.col(page) + before, width))
    if after:
        places.append(page_chunk(F.col(page) - after, width))
    spread = F.explode(F.array_distinct(F.array(*places))) if len(places) > 1 else home
    placed = df.withColumn(_CHUNK, spread).withColumn(_OWN, F.col(_CHUNK) == home)
    return placed.repartition(*keys_of(book), _CHUNK)


def previous_page(
    df: DataFrame,
    book: str | Sequence[str],
    page: str,
    values: dict[str, str],
    *,
    width: int = CHUNK,
) -> DataFrame:
    """Add columns of the preceding page; ``values`` maps new name to column."""
    w = Window.partitionBy(*keys_of(book), _CHUNK).orderBy(page)
    out = with_neighbours(df, book, page, before=1, width=width)
    out = out.withColumns({new: F.lag(old).over(w) for new, old in values.items()})
    return out.filter(_OWN).drop(_CHUNK, _OWN)


def runs_of(
    df: DataFrame,
    book: str | Sequence[str],
    page: str,
    hit: Column,
    length: int,
    *,
    width: int = CHUNK,
) -> DataFrame:
    """Pages at which ``hit`` has been true for ``length`` pages in a row."""
    keys = keys_of(book)
    recent = (
        Window.partitionBy(*keys, _CHUNK).orderBy(page).rowsBetween(-(length - 1), Window.currentRow)
    )
    rows = df.select(*keys, page, F.coalesce(hit, F.lit(False)).cast("int").alias("_hit"))
    return (
        with_neighbours(rows, book, page, before=length - 1, width=width)
        .withColumn("_run", F.sum("_hit").over(recent))
        .filter(F.col(_OWN) & (F.col("_run") >= length))
        .select(*keys, page)
    )


def first_run(
    df: DataFrame, book, page: str, hit: Column, length: int, *, name: str, width: int = CHUNK
) -> DataFrame:
    """One row per book that has such a run: the page completing the first one."""
    found = runs_of(df, book, page, hit, length, width=width)
    return found.groupBy(*keys_of(book)).agg(F.min(page).alias(name))


def failure_alarm(
    df: DataFrame, book, page: str, failed: str, k: int = 5, *, name: str = "abort_page", width=CHUNK
) -> DataFrame:
    """The page of the k-th consecutive failure of each book that has one."""
    return first_run(df, book, page, F.col(failed), k, name=name, width=width)


def failure_alarms(
    df: DataFrame, book, page: str, failed: str, lengths: Sequence[int], *, width: int = CHUNK
) -> DataFrame:
    """``(book, k, abort_page)`` for several run lengths in one pass."""
    keys = keys_of(book)
    rows = df.select(*keys, page, F.coalesce(F.col(failed), F.lit(False)).cast("int").alias("_hit"))
    near = with_neighbours(rows, book, page, before=max(lengths) - 1, width=width)
    by_page = Window.partitionBy(*keys, _CHUNK).orderBy(page)
    runs = {
        f"_run{k}": F.sum("_hit").over(by_page.rowsBetween(-(k - 1), Window.currentRow)) for k in lengths
    }
    firsts = near.withColumns(runs).filter(_OWN).groupBy(*keys).agg(
        *[F.min(F.when(F.col(f"_run{k}") == k, F.col(page))).alias(f"_first{k}") for k in lengths]
    )
    found = F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(f"_first{k}").alias("abort_page")) for k in lengths
    ])
    return firsts.select(*keys, F.inline(found)).filter(F.col("abort_page").isNotNull())


def cut_after(
    df: DataFrame, cuts: DataFrame, book, page: str, cut: str, *, inclusive: bool = True, width: int = CHUNK
) -> DataFrame:
    """Drop the pages behind each book's cut; books without a cut stay whole."""
    bound = F.col(page) <= F.col(cut) if inclusive else F.col(page) < F.col(cut)
    joined = salted_join(df, cuts, keys_of(book), page_chunk(page, width), "left", salts=BOOK_SALTS)
    return joined.filter(F.col(cut).isNull() | bound).drop(cut)


def abort_on_failure_run(
    df: DataFrame, book, page: str, failed: str, k: int = 5, *, width: int = CHUNK
) -> DataFrame:
    """Keep what was attempted up to and including the k-th failure in a row."""
    cuts = failure_alarm(df, book, page, failed, k, name="_cut", width=width)
    return cut_after(df, cuts, book, page, "_cut", width=width)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two signatures held as ``array<bigint>``."""
    words = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint"))
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda acc, d: acc + d)


def similar_pages(pairs: DataFrame, left: str, right: str, threshold: int = 5, bits: int = 256):
    """Compare two signatures per row: distance, score and the verdict.

    The pairs are the caller's (two editions joined on the page number, a page
    and its predecessor, ...); nothing is paired up here.
    """
    return (
        pairs.withColumn("distance", hamming(F.col(left), F.col(right)))
        .withColumn("score", F.lit(1.0) - F.col("distance") / F.lit(float(bits)))
        .withColumn("similar", F.col("distance") <= threshold)
    )


def end_of_sequence(
    df: DataFrame,
    book,
    page: str,
    content: str,
    *,
    n: int = 3,
    threshold: int | None = None,
    name: str = "end_page",
    width: int = CHUNK,
) -> DataFrame:
    """First page per book that completes ``n`` same pages in a row.

    Without a threshold pages are the same when ``content`` is equal. With one,
    ``content`` is a signature and a page is compared with the *first* page of
    the current run (the anchor), so a slow drift does not count as sameness.
    """
    if n < 2:
        raise ValueError("at least two pages make a run")
    if threshold is not None:
        differs = lambda a, b: hamming(a, b) > threshold
        states = sequence_states(df, book, page, content, n=n, differs=differs, name=name, width=width)
        return states.filter(F.col(name).isNotNull()).select(*keys_of(book), name)
    keys = keys_of(book)
    # Long texts are compared by digest, so the shuffle carries 32 bytes per page.
    wide = isinstance(df.schema[content].dataType, (T.StringType, T.BinaryType))
    value = F.unhex(F.sha2(F.col(content).cast("binary"), 256)) if wide else F.col(content)
    by_page = Window.partitionBy(*keys, _CHUNK).orderBy(page)
    recent = by_page.rowsBetween(-(n - 2), Window.currentRow)
    rows = with_neighbours(df.select(*keys, page, value.alias("_v")), book, page, before=n - 1, width=width)
    same = F.coalesce(F.col("_v") == F.lag("_v").over(by_page), F.lit(False)).cast("int")
    runs = rows.withColumn("_same", same).withColumn("_run", F.sum("_same").over(recent))
    done = runs.filter(F.col(_OWN) & (F.col("_run") >= n - 1))
    return done.groupBy(*keys).agg(F.min(page).alias(name))


def sequence_states(
    df: DataFrame, book, page: str, content: str, *, n: int, differs, name: str = "end_page", width: int = CHUNK
) -> DataFrame:
    """End page (null while there is none) and open ``anchor`` page of every book.

    An anchor at page p either ends the book (the next n-1 pages are all like it)
    or hands over to the first page that is not, at most n-1 pages on. So a page
    needs only n-1 successors to know its jump, and a chunk needs only the jump
    distance it is entered with (n-1 possibilities) to know how it is left. Chunks
    of chunks compose the same way, which keeps every collected list at most
    ``width`` long. ``differs(a, b)`` compares two content columns.
    """
    keys = keys_of(book)
    ahead = Window.partitionBy(*keys, _CHUNK).orderBy(page)
    rows = with_neighbours(
        df.select(*keys, page, content), book, page, after=n - 1, width=width
    )
    later = {f"_d{j}": differs(F.col(content), F.lead(content, j).over(ahead)) for j in range(1, n)}
    rows = rows.withColumns(later).filter(_OWN)
    # 0: the run is complete here; null: the book stops before either happens.
    jump = F.coalesce(*[F.when(F.col(f"_d{j}"), F.lit(j)) for j in range(1, n)])
    jump = F.coalesce(jump, F.when(F.col(f"_d{n - 1}").isNotNull(), F.lit(0)))
    steps = rows.select(*keys, _CHUNK, F.col(page).cast("bigint").alias("_page"), jump.alias("_jump"))

    chunks = steps.groupBy(*keys, _CHUNK).agg(
        F.sort_array(F.collect_list(F.struct("_page", "_jump"))).alias("_steps")
    )

    def walk(entry: Column) -> Column:
        start = F.struct(
            entry.cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("end")
        )

        def step(state, s):
            here = state["end"].isNull() & (state["at"] == s["_page"])
            done = here & (s["_jump"] == 0)
            return F.struct(
                F.when(here, s["_page"] + F.coalesce(s["_jump"], F.lit(0))).otherwise(state["at"]).alias("at"),
                F.when(done, s["_page"] + (n - 1)).otherwise(state["end"]).alias("end"),
            )

        return F.aggregate(F.col("_steps"), start, step)

    # One exit per possible entry page: the chunk start, the n-2 pages behind it, and
    # the chunk's first page, with which a book may begin.
    base = F.col(_CHUNK) * width
    entries = [base + e for e in range(n - 1)] + [F.element_at("_steps", 1)["_page"]]
    exits = chunks.select(
        *keys,
        F.col(_CHUNK).alias("_level"),
        F.array(*[F.struct(e.alias("entry"), walk(e).alias("exit")) for e in entries]).alias("_exits"),
    )

    def compose(list_col: Column, entry: Column) -> Column:
        start = F.struct(
            entry.cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("end")
        )

        def through(state, part):
            match = F.filter(part["_exits"], lambda x: x["entry"] == state["at"])
            hit = state["end"].isNull() & (F.size(match) > 0)
            exit_ = F.get(match, F.lit(0))["exit"]
            return F.struct(
                F.when(hit, exit_["at"]).otherwise(state["at"]).alias("at"),
                F.when(hit, exit_["end"]).otherwise(state["end"]).alias("end"),
            )

        return F.aggregate(list_col, start, through)

    parts = F.sort_array(F.collect_list(F.struct("_level", "_exits")))
    upper = exits.groupBy(*keys, F.floor(F.col("_level") / width).alias("_up")).agg(
        parts.alias("_parts")
    )
    ways_in = F.transform(
        F.element_at(F.col("_parts"), 1)["_exits"], lambda x: x["entry"]
    )
    upper = upper.select(
        *keys,
        F.col("_up").alias("_level"),
        F.transform(
            ways_in,
            lambda e: F.struct(e.alias("entry"), compose(F.col("_parts"), e).alias("exit")),
        ).alias("_exits"),
    )
    top = upper.groupBy(*keys).agg(parts.alias("_parts"))
    entry = F.element_at(F.element_at(F.col("_parts"), 1)["_exits"], -1)["entry"]
    final = top.withColumn("_state", compose(F.col("_parts"), entry))
    return final.select(*keys, F.col("_state.end").alias(name), F.col("_state.at").alias("anchor"))


def truncate_at_end(df: DataFrame, ends: DataFrame, book, page: str, end: str = "end_page"):
    """Keep pages up to and including each book's detected end."""
    return cut_after(df, ends, book, page, end)


def pages_since_restart(
    df: DataFrame, book, order: Sequence[str], restart: Column, chunk: Column
) -> DataFrame:
    """Rows from each book's last restart on; books never restarted stay whole.

    The last restart is a grouped maximum, so no running sum along the book.
    ``chunk`` cuts a book's rows into bounded pieces, as for ``number_pages``.
    """
    keys = keys_of(book)
    last = (
        df.filter(restart).groupBy(*keys).agg(F.max(F.struct(*order)).alias("_restart"))
    )
    kept = salted_join(df, last, keys, chunk, "left", salts=BOOK_SALTS)
    return kept.filter(
        F.col("_restart").isNull() | (F.struct(*order) >= F.col("_restart"))
    ).drop("_restart")
