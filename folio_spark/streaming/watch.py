"""Watching page streams with state per book: ends, failure alarms and books that stop coming.

Two stateful operators share the work, so that a book with a third of all pages is no single task:

* the first is keyed by book and chunk and keeps the chunk's pages until they are complete. Whenever pages
  arrive it says what the chunk does to a scan along the book: for every state the scan may enter it with
  (a handful), the end found in it or the state it is left with;
* the second is keyed by book and gets one row per chunk touched. It follows these rows from the first page
  on, keeps only those of chunks that it can't reach yet, and emits the book's end once.

A batch touches the state of the books that got pages and no other. Pages may come in any order, repeated
pages count once (the first). With ``patience``, timers of the processing clock drop the state of books and
chunks that got no page for so long; a book without an end is then emitted with its first missing page.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..operators.sequence import keys_of, page_chunk

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
WIDTH = 256
EXIT = T.StructType([
    T.StructField("entry", T.LongType()),
    T.StructField("end", T.LongType()),
    T.StructField("at", T.LongType()),
    T.StructField("left", T.BooleanType()),
])
#: What a scan does with a chunk it enters: the end found, or the state it is in behind the known pages.
Exit = tuple[int, int | None, int, bool]


@dataclass(frozen=True)
class Repeats:
    """The end is the page that completes ``n`` equal pages in a row."""

    n: int = 3
    before, after = 1, 0

    def start(self, first: int) -> int:
        return 0

    @property
    def needed(self) -> int:
        return self.n - 1

    def hit(self, pages: dict, page: int, first: int) -> bool:
        return page > first and pages[page] is not None and pages[page] == pages[page - 1]

    def exits(self, pages: dict, begin: int, stop: int, first: int) -> tuple[int, list[Exit]]:
        """The first page that is missing, and the exits; a scan enters with its number of hits in a row."""
        at = begin
        if not (self.before and begin > first and begin - 1 not in pages):
            while at < stop and at in pages:
                at += 1
        hits = [self.hit(pages, p, first) for p in range(begin, at)]
        found = []
        for entry in range(self.needed):
            run, end = entry, None
            for page, hit in enumerate(hits, begin):
                run = run + 1 if hit else 0
                if run == self.needed:
                    end = page
                    break
            found.append((entry, end, run, at == stop))
        return at, found


@dataclass(frozen=True)
class Failures(Repeats):
    """The end is the page that completes ``n`` failures in a row; the content says whether a page failed."""

    n: int = 5
    before = 0

    @property
    def needed(self) -> int:
        return self.n

    def hit(self, pages: dict, page: int, first: int) -> bool:
        return bool(pages[page])


@dataclass(frozen=True)
class Anchored:
    """The end is the page that completes ``n`` pages like their first (the anchor); contents are signatures."""

    n: int = 3
    threshold: int = 5
    before = 0

    @property
    def after(self) -> int:
        return self.n - 1

    def start(self, first: int) -> int:
        return first

    def like(self, one: list[int], two: list[int]) -> bool:
        return sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(one, two)) <= self.threshold

    def exits(self, pages: dict, begin: int, stop: int, first: int) -> tuple[int, list[Exit]]:
        """A scan enters with the page of its anchor, one of the chunk's first."""
        missing = begin
        while missing < stop + self.after and missing in pages:
            missing += 1
        found = []
        for entry in range(begin, begin + self.n - 1 if begin > first else begin + 1):
            anchor, end = entry, None
            while anchor < stop:
                other = next(
                    (p for p in range(anchor + 1, anchor + self.n) if p >= missing or not self.like(pages[anchor], pages[p])),
                    None,
                ) if anchor < missing else anchor
                if other is None:
                    end = anchor + self.n - 1
                    break
                if other >= missing or other == anchor:
                    break
                anchor = other
            found.append((entry, end, anchor, anchor >= stop))
        return min(missing, stop), found


class Timer:
    """One timer per key, moved on with every arrival."""

    def __init__(self, handle: StatefulProcessorHandle, patience: int | None):
        self.handle, self.patience = handle, patience
        self.due = handle.getValueState("due", "at bigint") if patience is not None else None

    def move(self, now: TimerValues) -> None:
        if self.due is None:
            return
        old = self.due.get()
        if old is not None:
            self.handle.deleteTimer(old[0])
        at = now.getCurrentProcessingTimeInMs() + self.patience
        self.handle.registerTimer(at)
        self.due.update((at,))

    def clear(self) -> None:
        if self.due is not None:
            self.due.clear()


class ChunkOfPages(StatefulProcessor):
    """Keeps the pages of one chunk of a book and says what they do to the scan."""

    def __init__(self, keys: list[str], content: T.DataType, rule, first: int, width: int, patience: int | None):
        self.keys, self.rule, self.first, self.width, self.patience = keys, rule, first, width, patience
        self.content = content

    def init(self, handle: StatefulProcessorHandle) -> None:
        page = T.StructType([T.StructField("page", T.LongType()), T.StructField("content", self.content)])
        # One value a chunk (at most its width and a few pages more): every call to the store is a round trip.
        self.held = handle.getValueState("held", T.StructType([
            T.StructField("done", T.BooleanType()), T.StructField("pages", T.ArrayType(page)),
        ]))
        self.timer = Timer(handle, self.patience)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fresh = [(r["page"], r["content"]) for r in rows]
        self.timer.move(timerValues)
        done, kept = self.held.get() or (False, [])
        if done:
            return
        pages: dict = {}
        for page, content in kept:
            pages.setdefault(page, content)
        new = {}
        for page, content in fresh:
            if page not in pages and page not in new:
                new[page] = content
        if not new:
            return
        pages.update(new)
        chunk = key[-1]
        stop = (chunk + 1) * self.width
        missing, exits = self.rule.exits(pages, max(chunk * self.width, self.first), stop, self.first)
        if all(end is not None or left for _, end, _, left in exits):
            self.held.update((True, []))
        else:
            self.held.update((False, list(pages.items())))
        yield Row(**dict(zip(self.keys, key[:-1])), chunk=chunk, missing=missing, exits=[Row(entry=e, end=n, at=a, left=d) for e, n, a, d in exits])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        self.timer.clear()
        return iter(())

    def close(self) -> None:
        pass


def plain(exits: list) -> list[Exit]:
    """Exits as tuples; rows bring them as mappings, the state as rows."""
    return [tuple(x[f] for f in EXIT.names) if isinstance(x, dict) else tuple(x) for x in exits]


class BookOfChunks(StatefulProcessor):
    """Follows a book's chunks in order and emits its end, or that it stopped coming."""

    def __init__(self, keys: list[str], rule, first: int, width: int, patience: int | None):
        self.keys, self.rule, self.first, self.width, self.patience = keys, rule, first, width, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "chunk bigint, entry bigint, ended boolean, missing bigint")
        self.ahead = handle.getMapState("ahead", "chunk bigint", T.StructType([
            T.StructField("missing", T.LongType()), T.StructField("exits", T.ArrayType(EXIT)),
        ]))
        self.timer = Timer(handle, self.patience)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        arrived = {r["chunk"]: (r["missing"], plain(r["exits"])) for r in rows}
        self.timer.move(timerValues)
        chunk, entry, ended, missing = self.place.get() or (
            self.first // self.width, self.rule.start(self.first), False, self.first,
        )
        if ended:
            return
        end = None
        entered = passed = chunk
        while True:
            held = arrived.get(chunk)
            # Without new pages of its own the chunk it stands in says what it said before.
            if held is None and chunk != entered and self.ahead.containsKey((chunk,)):
                held = self.ahead.getValue((chunk,))
            if held is None:
                break
            missing, exits = held
            passed = chunk + 1
            found = next(x for x in plain(exits) if x[0] == entry)
            if found[1] is not None:
                end = found[1]
                break
            if not found[3]:
                break
            entry = found[2]
            arrived.pop(chunk, None)
            self.ahead.removeKey((chunk,))
            chunk += 1
        if end is not None:
            self.ahead.clear()
            self.place.update((chunk, entry, True, missing))
            yield Row(**dict(zip(self.keys, key)), end=end, missing=None)
            return
        for number, held in arrived.items():
            if number >= passed:
                self.ahead.updateValue((number,), held)
        self.place.update((chunk, entry, False, missing))

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        chunk, _, ended, missing = self.place.get() or (0, 0, True, None)
        self.place.clear()
        self.ahead.clear()
        self.timer.clear()
        if not ended:
            yield Row(**dict(zip(self.keys, key)), end=None, missing=max(missing, chunk * self.width))

    def close(self) -> None:
        pass


def compared(df: DataFrame, content: str) -> Column:
    """What pages are compared by: texts by digest, so the state keeps 32 bytes a page."""
    wide = isinstance(df.schema[content].dataType, (T.StringType, T.BinaryType))
    return F.unhex(F.sha2(F.col(content).cast("binary"), 256)) if wide else F.col(content)


def watched(
    pages: DataFrame,
    book: str | list[str],
    page: str,
    content: str,
    rule: Repeats | Failures | Anchored,
    *,
    first_page: int = 1,
    width: int = WIDTH,
    patience_ms: int | None = None,
) -> DataFrame:
    """A stream of the books' first ends: the keys of the book, ``end``, ``missing``.

    ``missing`` is set, and ``end`` null, for a book that got no page for ``patience_ms`` and has no end; its
    state is dropped, and pages that come later begin a new watch. Pages before ``first_page``, and rows
    without a page, are left out. Keys of books may be null.
    """
    keys = keys_of(book)
    if max(rule.before, rule.after) > width:
        raise ValueError("a rule looks further than a chunk")
    number = F.col(page).cast("bigint")
    rows = pages.where(number >= first_page).select(*keys, number.alias("page"), compared(pages, content).alias("content"))
    homes = [page_chunk(F.col("page") + shift, width) for shift in sorted({0, rule.before, -rule.after})]
    spread = rows.withColumn("chunk", F.explode(F.array_distinct(F.array(*homes))))
    spread = spread.where(F.col("chunk") >= first_page // width)
    books = [rows.schema[k] for k in keys]
    mode = "none" if patience_ms is None else "processingTime"
    summaries = spread.groupBy(*keys, "chunk").transformWithState(
        ChunkOfPages(keys, rows.schema["content"].dataType, rule, first_page, width, patience_ms),
        T.StructType([
            *books, T.StructField("chunk", T.LongType()), T.StructField("missing", T.LongType()),
            T.StructField("exits", T.ArrayType(EXIT)),
        ]), "append", mode,
    )
    return summaries.groupBy(*keys).transformWithState(
        BookOfChunks(keys, rule, first_page, width, patience_ms),
        T.StructType([*books, T.StructField("end", T.LongType()), T.StructField("missing", T.LongType())]),
        "append", mode,
    )


def start(ends: DataFrame, folder: str, checkpoint: str, **trigger):
    """Append the ends to a table. State lies in the RocksDB store, which keeps it on disk and as change logs.

    Without patience the default is to take what is there and stop. Timers of the processing clock fire in
    batches of their own, so a watch with patience runs until it is stopped.
    """
    spark = ends.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:  # a query takes the settings of the moment it is started
        return (
            ends.writeStream.format("parquet")
            .outputMode("append")
            .option("path", folder)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
