"""Extractors, their registry, and the choice among several results per page.

An extractor turns the payload column of a page into a ``RESULT`` struct. Native
ones are column expressions; ``model_extractor`` runs a user's batch function
through Arrow. Failure is a row with ``success = false``, never an exception.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.binding import let
from ..functions.text import HEIGHT_RATIO, heading_level, heading_marker, heading_score, is_heading
from ..schema import BLOCK, RESULT
from .assemble import joined_blocks, strip
from .progress import DEFAULT_CONFIDENCE
from .select import bbox
from .sequence import keys_of, page_chunk
from .skew import join_by_chunk

# Block tags with their line heights, dropped sections, entities.
TAG_HEIGHTS = {"h1": 40, "h2": 30, "h3": 25, "li": 25, "p": 20}
BASE_HEIGHT = 20
DROPPED = ("script", "style", "nav")
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ",
    "&copy;": "©", "&middot;": "·", "&amp;": "&",
}
OPENING_BLOCK = r"(?i)<(h[1-6]|p|li)(?:\s[^>]*)?>"
CLOSING_BLOCK = r"(?i)</(?:h[1-6]|p|li|ul|ol|div|article|footer|body)>"
PAGE_WIDTH, PAGE_HEIGHT = 800, 600


def result(engine: str, text: Column, confidence: Column, blocks: Column | None = None) -> Column:
    """A ``RESULT`` struct; blank text counts as a failure."""
    ok = F.coalesce(strip(text) != "", F.lit(False))
    return F.struct(
        F.lit(engine).alias("engine"),
        F.coalesce(text, F.lit("")).alias("text"),
        F.when(ok, confidence).otherwise(F.lit(0.0)).cast("double").alias("confidence"),
        (F.lit(None).cast(T.ArrayType(BLOCK)) if blocks is None else blocks).alias("blocks"),
        F.lit(None).cast("double").alias("processing_time"),
        ok.alias("success"),
        F.when(~ok, F.lit("no text")).alias("error_message"),
    )


def without_sections(html: Column, tags: Iterable[str] = DROPPED) -> Column:
    out = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    for tag in tags:
        out = F.regexp_replace(out, rf"(?is)<{tag}[\s>].*?</{tag}>", "")
    return out


def plain_text(html: Column) -> Column:
    """Tags out, entities decoded, blanks collapsed."""
    out = F.regexp_replace(html, "<[^>]*>", " ")
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def html_blocks(html: Column, dropped: Iterable[str] = DROPPED) -> Column:
    """``array<BLOCK>`` of headings, paragraphs and list items in document order."""
    marked = F.regexp_replace(without_sections(html, dropped), OPENING_BLOCK, "\x01$1\x02")
    marked = F.regexp_replace(marked, CLOSING_BLOCK, "\x01")
    pieces = F.filter(F.split(marked, "\x01"), lambda s: s.contains("\x02"))

    def block(piece, i):
        tag = F.lower(F.substring_index(piece, "\x02", 1))
        height = F.lit(BASE_HEIGHT)
        for name, value in TAG_HEIGHTS.items():
            height = F.when(tag == name, F.lit(value)).otherwise(height)
        text = plain_text(F.substring_index(piece, "\x02", -1))
        box = bbox(F.lit(0), i * 50, F.lit(PAGE_WIDTH), height, F.lit(DEFAULT_CONFIDENCE))
        return F.struct(
            text.alias("text"),
            box.alias("bounding_box"),
            unknown_confidence(text).alias("confidence"),
            tag.alias("block_type"),
            height.cast("int").alias("font_size"),
            F.lit(False).alias("is_bold"),
        )

    return F.transform(pieces, block)


def unknown_confidence(text: Column) -> Column:
    """Constant stand-in for engines that report none: 0.95, or 0 for empty text."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0.0)).otherwise(F.lit(DEFAULT_CONFIDENCE))


def single_block_layout(text: Column, width: int = PAGE_WIDTH, height: int = PAGE_HEIGHT) -> Column:
    """Layout of an engine that knows none: one block covering the page."""
    confidence = unknown_confidence(text)
    return F.array(
        F.struct(
            text.alias("text"),
            bbox(F.lit(0), F.lit(0), F.lit(width), F.lit(height), confidence).alias("bounding_box"),
            confidence.alias("confidence"),
            F.lit("text").alias("block_type"),
            F.lit(None).cast("int").alias("font_size"),
            F.lit(False).alias("is_bold"),
        )
    )


def kept_ratio(text: Column, payload: Column) -> Column:
    return F.length(text) / F.greatest(F.length(payload), F.lit(1))


def extract_blocks(payload: Column) -> Column:
    def found(blocks):
        return let(
            joined_blocks(blocks),
            lambda text: result("html_blocks", text, kept_ratio(text, payload), blocks),
        )

    return let(F.filter(html_blocks(payload), lambda b: b["text"] != ""), found)


def extract_plain(payload: Column) -> Column:
    text = plain_text(without_sections(payload, ("script", "style")))
    return let(text, lambda t: result("html_plain", t, kept_ratio(t, payload)))


@dataclass(frozen=True)
class Extractor:
    """A named extractor: ``apply(df, payload)`` adds a ``result`` column."""

    name: str
    expression: Callable[[Column], Column]
    available: Callable[[], bool] = lambda: True

    def apply(self, df: DataFrame, payload: str) -> DataFrame:
        return df.withColumn("result", self.expression(F.col(payload)))


_REGISTRY: dict[str, Extractor] = {}


def register(extractor: Extractor) -> None:
    _REGISTRY[extractor.name.lower()] = extractor


def create(name: str) -> Extractor | None:
    return _REGISTRY.get(name.lower())


def available() -> list[str]:
    return [name for name, e in _REGISTRY.items() if e.available()]


def preference(preferred: Iterable[str], fallback: bool = True) -> list[Extractor]:
    """Preferred extractors that are available, then the other registered ones."""
    usable = available()
    names = [n.lower() for n in preferred]
    chosen = [n for n in names if n in usable]
    if fallback:
        chosen += [n for n in usable if n not in names]
    return [_REGISTRY[n] for n in chosen]


register(Extractor("html_blocks", extract_blocks))
register(Extractor("html_plain", extract_plain))


def engine_lookup(requests: DataFrame, name: str, registry: DataFrame, registered: str) -> DataFrame:
    """Case-insensitive left join to a registry; an unknown name leaves nulls."""
    side = registry.withColumn("_name", F.lower(registered))
    return requests.withColumn("_name", F.lower(name)).join(side, "_name", "left").drop("_name")


def registry_table(spark: SparkSession) -> DataFrame:
    rows = [(name, e.available()) for name, e in _REGISTRY.items()]
    return spark.createDataFrame(rows, "engine string, available boolean")


def usable_engines(registered: DataFrame, present: DataFrame) -> DataFrame:
    return registered.intersect(present)


def extra_engines(registered: DataFrame, preferred: DataFrame) -> DataFrame:
    return registered.subtract(preferred)


def extract_with_fallback(
    df: DataFrame, payload: str, engines: list[Extractor], *, min_confidence: float = 0.0
) -> DataFrame:
    """First good result per page in order of preference, without a shuffle.

    Later engines run only on the pages the earlier ones failed.

    A result is good when it succeeded with enough confidence. If none is, the
    last engine's result stands, as a failed row.
    """

    def failed(r):
        return F.struct(
            *[(F.lit(False) if f.name == "success" else r[f.name]).alias(f.name) for f in RESULT.fields]
        )

    def attempt(rest):
        def judge(r):
            good = r["success"] & (r["confidence"] >= min_confidence)
            return F.when(good, r).otherwise(attempt(rest[1:]) if rest[1:] else failed(r))

        return let(rest[0].expression(F.col(payload)).cast(RESULT), judge)

    return df.withColumn("result", attempt(engines))


def best_attempt(results: DataFrame, keys, *, priority: str, attempt: str = "attempt") -> DataFrame:
    """Best of the stored attempts per page: success, then priority, confidence, latest.

    A grouped ``max_by``, so attempts combine before the shuffle.
    """
    keys = keys_of(keys)
    rank = F.struct(F.col("success"), -F.col(priority), F.col("confidence"), F.col(attempt))
    rest = [c for c in results.columns if c not in keys]
    chosen = F.max_by(F.struct(*rest), rank).alias("_best")
    return results.groupBy(*keys).agg(chosen).select(*keys, "_best.*")


def mark_headings(blocks: Column, *, position_weight: float = 0.7) -> Column:
    """Blocks of one page with heading verdict, level, marker and score.

    The average height is taken over the page's own layout array: no shuffle.
    """

    def average_height(bs):
        total = F.aggregate(
            bs, F.lit(0.0), lambda a, b: a + b["bounding_box"]["height"].cast("double")
        )
        return F.when(F.size(bs) > 0, total / F.size(bs)).otherwise(F.lit(0.0))

    def mark(b, i, average):
        height = b["bounding_box"]["height"]
        tall = (average > 0) & (height >= average * HEIGHT_RATIO)
        heading = is_heading(b["block_type"], height, average, b["text"])
        level = heading_level(height, average)
        line = F.when(heading, F.concat(heading_marker(level), b["text"])).otherwise(b["text"])
        return F.struct(
            i.alias("ord"),
            b["block_type"].alias("block_type"),
            b["text"].alias("text"),
            average.alias("average"),
            heading.alias("heading"),
            F.when(heading, level).alias("level"),
            line.alias("line"),
            heading_score(tall, i == 0, position_weight).alias("score"),
        )

    def marked(bs):
        return let(
            average_height(bs), lambda average: F.transform(bs, lambda b, i: mark(b, i, average))
        )

    return let(blocks, marked)


def heading_blocks(blocks: DataFrame, page, order: str, height: str, kind: str, text: str) -> DataFrame:
    """The same verdict for a table of blocks: page averages are joined back."""
    keys = keys_of(page)
    averages = blocks.groupBy(*keys).agg(F.avg(height).alias("average"))
    joined = join_by_chunk(blocks, averages, keys, {"_chunk": page_chunk(order)})
    h, a = F.col(height), F.col("average")
    verdict = is_heading(F.col(kind), h, a, F.col(text))
    return joined.withColumn("heading", verdict).withColumn(
        "level", F.when(F.col("heading"), heading_level(h, a))
    )


def answered(predict: Callable[[pd.Series], pd.DataFrame], payloads: pd.Series) -> pd.DataFrame:
    """``text, confidence, error`` of each payload; a call that raises is repeated on its halves."""
    try:
        out = predict(payloads)
        if len(out) != len(payloads):
            raise ValueError(f"{len(out)} answers to {len(payloads)} payloads")
        answers = pd.DataFrame({"text": out["text"].fillna("").to_numpy(), "confidence": out["confidence"].to_numpy()})
        return answers.assign(error=pd.Series([None] * len(answers), dtype=object))
    except Exception as e:  # failure is data
        if len(payloads) < 2:
            return pd.DataFrame({"text": "", "confidence": 0.0, "error": [str(e)] * len(payloads)})
    middle = len(payloads) // 2
    return pd.concat([answered(predict, part) for part in (payloads[:middle], payloads[middle:])], ignore_index=True)


def model_extractor(
    df: DataFrame,
    payload: str,
    engine: str,
    predict: Callable[[pd.Series], pd.DataFrame],
) -> DataFrame:
    """Run a user's batch model: ``predict(payloads)`` returns ``text`` and ``confidence``.

    A batch that raises is tried again in halves, so only the payloads that fail
    by themselves become failed rows carrying the message.
    """
    schema = T.StructType(
        [*df.schema.fields, *[f for f in RESULT.fields if f.name != "blocks"]]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            start = time.perf_counter()
            out = answered(predict, batch[payload])
            spent = (time.perf_counter() - start) / max(len(batch), 1)
            batch = batch.assign(
                engine=engine, text=out["text"].to_numpy(), confidence=out["confidence"].to_numpy(), processing_time=spent
            )
            batch["success"] = (batch["text"].str.strip() != "") & out["error"].isna().to_numpy()
            batch["error_message"] = out["error"].to_numpy()
            yield batch

    return df.mapInPandas(run, schema)
