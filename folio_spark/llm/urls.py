"""URL filters as a temporal list join.

A list is a history of dated entries: at some time a pattern is added to a list or removed from it.
Entries become validity intervals ``[valid_from, valid_to)``; a capture is judged by the entries
active when it was fetched. Patterns are hosts (they cover the host and its subdomains) and URL
prefixes at path segments.

The join is an equality join on pattern and time bucket: a capture asks with every suffix of its host
and every prefix of its path, an interval answers in every bucket it overlaps within the span of the
captures. A busy host's captures are dealt to several tasks, and its history is cut by time.

Cases: a null URL or time, or a URL without a host, matches nothing; of entries for one pattern and
list at one moment the last in ``seq`` counts; repeated entries change nothing; repeated captures are
judged each; empty tables match nothing. Other columns are kept; one with the name of a result is
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folio_spark.llm.common import written

DAY = 86400


def host_of(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(found != "", found)


def path_of(url: Column) -> Column:
    """Path segments without empty ones."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def patterns_of(url: Column) -> Column:
    """All patterns that cover a URL: its host, the domains above, and its path prefixes."""
    labels = F.split(host_of(url), r"\.")
    segments = path_of(url)
    hosts = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    prefixes = F.transform(
        F.when(F.size(segments) > 0, F.sequence(F.lit(1), F.size(segments))).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat_ws("/", host_of(url), F.array_join(F.slice(segments, F.lit(1), i), "/")),
    )
    return F.when(host_of(url).isNotNull(), F.concat(hosts, prefixes))


def intervals(entries: DataFrame) -> DataFrame:
    """``list, pattern, valid_from, valid_to`` (null: open) of entries ``list, pattern, added, at, seq``.

    A pattern's history is cut by day: within a day the next entry is found by a window, over days
    by one row per day.
    """
    key = ["list", "pattern"]
    # The last entry of a moment counts.
    last = (
        entries.where(F.col("at").isNotNull() & F.col("pattern").isNotNull())
        .groupBy(*key, "at")
        .agg(F.max_by("added", "seq").alias("added"))
        .withColumn("day", F.to_date("at"))
    )
    days = last.groupBy(*key, "day").agg(F.min("at").alias("first_at"))
    following = days.select(
        *key, "day", F.lead("first_at").over(Window.partitionBy(*key).orderBy("day")).alias("next_day_at")
    )
    within = F.lead("at").over(Window.partitionBy(*key, "day").orderBy("at"))
    return (
        last.withColumn("next_at", within)
        .join(following, [*key, "day"])
        .where("added")
        .select(
            *key, F.col("at").alias("valid_from"), F.coalesce("next_at", "next_day_at").alias("valid_to")
        )
    )


def judge(
    captures: DataFrame,
    entries: DataFrame,
    url_col: str = "url",
    time_col: str = "fetched",
    bucket: int = DAY,
    salts: int = 8,
) -> DataFrame:
    """Captures with ``n_block, n_allow`` (entries active), ``rule`` (the pattern that decides) and ``blocked``.

    The most specific pattern decides, that is the longest; on one pattern a block entry beats an
    allow entry. Without an active entry a capture is not blocked.
    """
    results = ["n_block", "n_allow", "rule", "blocked"]
    kept = [c for c in captures.columns if c.lower() not in results]
    # One number of bounded size per row, so equal rows stay apart.
    rows = captures.select(*kept).withColumn("_row", F.monotonically_increasing_id())
    rows = written(rows, "captures")
    url, time = F.col(url_col), F.col(time_col)
    second = F.unix_timestamp(time)
    asked = rows.select(
        "_row",
        time.alias("_time"),
        F.floor(second / bucket).alias("_bucket"),
        F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int").alias("_salt"),
        F.explode(patterns_of(url)).alias("pattern"),
    ).where(F.col("_time").isNotNull())
    low, high = rows.agg(F.min(second), F.max(second)).first()
    low, high = (0, -1) if low is None else (low, high)
    begin = F.greatest(F.unix_timestamp("valid_from"), F.lit(low))
    end = F.least(F.coalesce(F.unix_timestamp("valid_to"), F.lit(high)), F.lit(high))
    valid = (
        intervals(entries)
        .where(begin <= end)
        .withColumn("_bucket", F.explode(F.sequence(F.floor(begin / bucket), F.floor(end / bucket))))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    active = asked.join(valid, ["pattern", "_bucket", "_salt"]).where(
        (F.col("valid_from") <= F.col("_time"))
        & (F.col("valid_to").isNull() | (F.col("_time") < F.col("valid_to")))
    )
    blocks = F.col("list") == "block"
    top = F.max(F.struct(F.length("pattern"), "pattern", blocks.alias("block")))
    found = active.groupBy("_row").agg(
        F.count_if(blocks).alias("n_block"), F.count_if(~blocks).alias("n_allow"), top.alias("_top")
    )
    return rows.join(found, "_row", "left").select(
        *kept,
        F.coalesce("n_block", F.lit(0)).alias("n_block"),
        F.coalesce("n_allow", F.lit(0)).alias("n_allow"),
        F.col("_top.pattern").alias("rule"),
        F.coalesce("_top.block", F.lit(False)).alias("blocked"),
    )
