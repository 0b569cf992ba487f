"""The run ledger: one row per (book, page, attempt), and what is derived from it.

Lists of pages stay rows. Where a list is the deliverable (a state record), it is
cut into parts of a fixed page span, so no list grows with the book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .assemble import strip
from .sequence import BOOK_SALTS, CHUNK, keys_of, page_chunk
from .skew import salted_join

IN_PROGRESS, COMPLETED, FAILED = "in_progress", "completed", "failed"
STATE_PART = 1000


def init_ledger(books: DataFrame, book, total_pages: str, *, start_page: int = 1, now: Column | None = None):
    """The initial state of every book: nothing processed, current page before the start."""
    now = F.current_timestamp() if now is None else now
    return books.select(
        *keys_of(book),
        F.lit(start_page - 1).cast("bigint").alias("current_page"),
        F.col(total_pages).cast("bigint").alias("total_pages"),
        F.lit(0).cast("bigint").alias("processed"),
        F.lit(0).cast("bigint").alias("failed"),
        F.lit(IN_PROGRESS).alias("status"),
        now.alias("start_datetime"),
        now.alias("last_update"),
    )


def latest_state(attempts: DataFrame, book, order: list[str]) -> DataFrame:
    """Current row of every key: the greatest by ``order`` (a partial aggregate, no window)."""
    keys = keys_of(book)
    rest = [c for c in attempts.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return attempts.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def drop_completed(ledger: DataFrame, states: DataFrame, book, page: str) -> DataFrame:
    """Ledger rows of the books that are not completed yet."""
    done = states.filter(F.col("status") == COMPLETED).select(*keys_of(book))
    return salted_join(ledger, done, keys_of(book), page_chunk(page), "left_anti", salts=BOOK_SALTS)


def delete_books(ledger: DataFrame, named: DataFrame, book) -> tuple[DataFrame, DataFrame]:
    """The ledger without the named books, and for each of them whether it was there: ``deleted, pages``.

    Rows of a book combine into one before they meet the names, so a large book is no large task; a name
    given twice is answered once. Null names no book.
    """
    keys = keys_of(book)
    names = named.select(*keys).distinct()
    held = ledger.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    answers = names.join(held, keys, "left").select(
        *keys, F.col("_n").isNotNull().alias("deleted"), F.coalesce("_n", F.lit(0)).cast("bigint").alias("pages")
    )
    found = held.join(names, keys, "left_semi").select(*keys, F.lit(True).alias("_gone"))
    deal = next((c for c in ledger.columns[::-1] if c not in keys), keys[0])
    kept = salted_join(ledger, found, keys, deal, "left").where("_gone IS NULL").drop("_gone")
    return kept, answers


def list_states(pages: DataFrame, book, page: str | None, failed: str, total: Column) -> DataFrame:
    """State of every book from its page rows: counters, frontier and status.

    Without a page column the rows are a book's pages from 1 on, so the frontier is their number.
    """
    bad = F.coalesce(F.col(failed), F.lit(False))
    frontier = F.count(F.lit(1)) if page is None else F.max(page)
    states = pages.groupBy(*keys_of(book)).agg(
        frontier.alias("current_page"),
        F.count_if(~bad).alias("processed"),
        F.count_if(bad).alias("failed"),
        total.alias("total_pages"),
    )
    done = F.col("current_page") >= F.col("total_pages")
    return states.withColumn("status", F.when(done, F.lit(COMPLETED)).otherwise(F.lit(IN_PROGRESS)))


def state_lists(pages: DataFrame, book, page: str, failed: str, *, span: int = STATE_PART):
    """Processed and failed page numbers as arrays, one row per span of pages."""
    bad = F.coalesce(F.col(failed), F.lit(False))
    number = F.col(page)
    return (
        pages.withColumn("part", page_chunk(page, span))
        .groupBy(*keys_of(book), "part")
        .agg(
            F.sort_array(F.collect_set(F.when(~bad, number))).alias("processed_pages"),
            F.sort_array(F.collect_set(F.when(bad, number))).alias("failed_pages"),
        )
    )


def run_summary(pages: DataFrame, book, page: str, failed: str) -> DataFrame:
    """Totals per book; the failed pages themselves are rows of ``failed_pages``."""
    bad = F.coalesce(F.col(failed), F.lit(False))
    return pages.groupBy(*keys_of(book)).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~bad).alias("processed"),
        F.count_if(bad).alias("failed"),
        F.min(F.when(bad, F.col(page))).alias("first_failed"),
        F.max(F.when(bad, F.col(page))).alias("last_failed"),
    )


def failed_pages(pages: DataFrame, book, page: str, failed: str) -> DataFrame:
    return pages.filter(F.col(failed)).select(*keys_of(book), page)


def expected_pages(books: DataFrame, book, first: Column, last: Column, *, name: str = "page", span: int = CHUNK):
    """All page numbers ``first..last`` of every book.

    Spans are generated first and shuffled, so the pages of one huge book are
    produced by many tasks.
    """
    keys = keys_of(book)
    spans = (
        books.select(*keys, first.cast("bigint").alias("_first"), last.cast("bigint").alias("_last"))
        .filter(F.col("_first") <= F.col("_last"))
        .withColumn(
            "_from",
            F.explode(F.sequence(F.col("_first"), F.col("_last"), F.lit(span).cast("bigint"))),
        )
        .repartition(*keys, "_from")
    )
    upto = F.least(F.col("_last"), F.col("_from") + (span - 1))
    return spans.select(*keys, F.explode(F.sequence(F.col("_from"), upto)).alias(name))


def resume_todo(states: DataFrame, book, *, name: str = "page") -> DataFrame:
    """Pages behind each open book's frontier: ``current_page + 1 .. total_pages``.

    A failed page lies before the frontier and is not retried.
    """
    open_books = states.filter(F.col("status") == IN_PROGRESS)
    first = F.greatest(F.col("current_page") + 1, F.lit(1))
    return expected_pages(open_books, book, first, F.col("total_pages"), name=name)


def retry_todo(expected: DataFrame, ledger: DataFrame, book, page: str, failed: str) -> DataFrame:
    """Expected pages without a successful attempt, failed ones included."""
    done = ledger.filter(~F.col(failed)).select(*keys_of(book), page).distinct()
    return expected.join(done, [*keys_of(book), page], "left_anti")


def attempted(processed: DataFrame, failed: DataFrame, book, page: str) -> DataFrame:
    """Union of both page sets; a page found in both counts as processed."""
    keys = [*keys_of(book), page]
    both = processed.select(*keys, F.lit(True).alias("_ok")).unionByName(
        failed.select(*keys, F.lit(False).alias("_ok"))
    )
    return both.groupBy(*keys).agg(
        F.when(F.max("_ok"), F.lit("processed")).otherwise(F.lit("failed")).alias("status")
    )


def missing_pages(expected: DataFrame, seen: DataFrame, book, page: str) -> DataFrame:
    """Pages expected and never attempted."""
    keys = [*keys_of(book), page]
    return expected.select(*keys).join(seen.select(*keys), keys, "left_anti")


def dedupe_lines(lines: DataFrame, book, line: str, position: str) -> DataFrame:
    """First occurrence of every line of a book; blank lines all stay.

    A grouped minimum: copies collapse before the shuffle, however many there are.
    """
    keys = keys_of(book)
    blank = strip(F.col(line)) == ""
    apart = F.when(blank, F.col(position))
    return (
        lines.groupBy(*keys, F.col(line), apart.alias("_apart"))
        .agg(F.min(position).alias(position))
        .select(*keys, position, line)
    )
