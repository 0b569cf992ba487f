"""Literal expectations for progress, selection, rules, text and records."""

import pytest
from pyspark.sql import functions as F

from folio_spark.functions import records as R
from folio_spark.functions import text as X
from folio_spark.functions.binding import let
from folio_spark.operators import assemble as A
from folio_spark.operators import extract as E
from folio_spark.operators import ledger as L
from folio_spark.operators import progress as P
from folio_spark.operators import quality as V
from folio_spark.operators import select as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def values(spark, rows, schema, column):
    return [r["v"] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column.alias("v")).collect()]


@pytest.mark.parametrize("current,total,want", [(0, 100, 0.0), (50, 100, 50.0), (100, 100, 100.0), (150, 100, 100.0), (0, 0, 0.0)])
def test_percentage(spark, current, total, want):
    assert value(spark, P.percentage(F.lit(current), F.lit(total))) == want


def test_remaining_and_rate(spark):
    avg, none = F.lit(1.0), F.lit(None).cast("double")
    assert value(spark, P.remaining_seconds(avg, F.lit(3), F.lit(100))) == 97.0
    assert value(spark, P.remaining_seconds(avg, F.lit(100), F.lit(100))) == 0.0
    assert value(spark, P.remaining_seconds(none, F.lit(3), F.lit(100))) is None
    assert value(spark, P.pages_per_minute(avg)) == 60.0
    assert value(spark, P.pages_per_minute(F.lit(0.0))) is None
    assert value(spark, P.pages_per_minute(none)) is None


def test_durations_and_bar(spark):
    got = [value(spark, P.format_duration(F.lit(s))) for s in (30, 330, 9045, 3600)]
    assert got == ["30s", "5m 30s", "2h 30m 45s", "1h 0m 0s"]
    assert value(spark, P.progress_bar(F.lit(0.0), 10)) == "[" + "░" * 10 + "] 0.0%"
    assert value(spark, P.progress_bar(F.lit(100.0), 10)) == "[" + "█" * 10 + "] 100.0%"


def test_progress_drops_time_of_failures(spark):
    rows = [(1, i + 1, f"2024-01-01 00:00:{s:02d}", bad) for i, (s, bad) in enumerate([(0, False), (1, False), (9, True), (11, False), (12, True)])]
    df = spark.createDataFrame(rows, "book int, page bigint, ts string, failed boolean").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    out = P.progress_summary(df, "book", "page", "ts", "failed", F.lit(10)).first()
    assert out["average_page_time"] == 1.5
    assert out["failed_pages_count"] == 2 and out["current_page"] == 5
    assert out["progress_percentage"] == 50.0 and out["remaining_seconds"] == 7.5


def test_confidence_average(spark):
    df = spark.createDataFrame([(90.0,), (80.0,), (-1.0,), (70.0,)], "c double")
    assert df.agg(F.round(P.average_confidence(F.col("c")), 9)).first()[0] == 0.8
    assert df.filter("c > 1000").agg(P.average_confidence(F.col("c"))).first()[0] == 0.0
    assert df.filter("c > 1000").agg(P.average_or(F.col("c"), P.DEFAULT_CONFIDENCE)).first()[0] == 0.95


def test_stage_report_is_empty_without_data(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert P.stage_report(df, {"x": "a", "y": "b"}).count() == 0


def test_boxes(spark):
    points = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in [(10, 20), (110, 20), (110, 70), (10, 70)]])
    assert tuple(value(spark, S.bbox_from_polygon(points))) == (10, 20, 100, 50, 0.95)
    assert tuple(value(spark, S.bbox_from_polygon(F.slice(points, 1, 3)))) == (0, 0, 0, 0, 0.0)
    corners = F.array(*[F.lit(float(v)) for v in (10, 20, 100, 50)])
    assert tuple(value(spark, S.bbox_from_corners(corners, F.lit(0), F.lit(0.9)))) == (10, 20, 90, 30, 0.9)
    none = F.lit(None).cast("array<double>")
    assert tuple(value(spark, S.bbox_from_corners(none, F.lit(2), F.lit(0.9)))) == (0, 60, 800, 30, 0.9)
    assert value(spark, S.region_or_null(F.lit(1), F.lit(None).cast("int"), F.lit(3), F.lit(4))) is None


def test_selection(spark):
    df = spark.createDataFrame([(0, " \t　"), (1, " a ")], "page bigint, text string")
    assert [r["text"] for r in S.drop_blank_text(df, "text").collect()] == ["a"]
    assert value(spark, S.text_or_placeholder(F.lit(True), F.lit(" \n"), F.lit(7))) == "\n[Page 7 - No text detected]\n\n"
    assert S.page_range(df, "page", -3, 5).count() == 1
    known = S.project_known_fields(df.withColumn("last_update", F.lit(None).cast("timestamp")), {"text": F.lit("n"), "other": F.lit(1)})
    row = known.first()
    assert row["text"] == "n" and row["last_update"] is not None and "other" not in known.columns
    grid = spark.createDataFrame([("a", 0, 5000, 1.0), ("b", 10, 10, 1.0)], "gid string, y int, x int, v double")
    assert {r["gid"]: r["within_limit"] for r in S.max_size_guard(grid).collect()} == {"a": False, "b": True}


def test_rules(spark):
    title = V.title_rule(F.col("t"))
    rows = [("  My Book  ",), ("",), ("   ",), ("A" * 201,), (None,)]
    assert values(spark, rows, "t string", ~title.broken) == [True, False, False, False, False]
    rng = V.page_range_rule(F.col("a"), F.col("b"))
    pairs = [("1", "10"), ("5", None), ("5", "4"), ("x", "9"), ("0", "3")]
    assert values(spark, pairs, "a string, b string", ~rng.broken) == [True, True, False, False, False]
    for rule, good, bad in [
        (V.image_format_rule, " PNG ", "gif"), (V.engine_rule, "Tesseract", "other"), (V.log_level_rule, "debug", "loud"),
        (V.positive_rule, "3", "0"), (V.non_negative_rule, "0", "-0.1"), (V.confidence_rule, "1.0", "1.1"), (V.page_number_rule, "1", "1.5x"),
    ]:
        assert values(spark, [(good,), (bad,)], "v string", ~rule(F.col("v")).broken) == [True, False]
    df = spark.createDataFrame(rows, "t string")
    ok, bad = V.split_valid(df, [title])
    assert ok.count() == 1 and bad.count() == 4
    assert V.rule_report(df, [title]).first()["failed"] == 4


def test_safe_names(spark):
    names = [("my<file>.txt",), ('file"path"/test.txt',), ("...",)]
    assert values(spark, names, "n string", V.sanitize_filename(F.col("n"))) == ["my_file_.txt", "file_path__test.txt", "untitled"]
    titles = [("Test Book",), ("Test/Book:Name*?",), ("日本 語",)]
    assert values(spark, titles, "n string", V.state_key(F.col("n"))) == ["Test_Book_state.json", "Test_Book_Name___state.json", "日本_語_state.json"]
    assert value(spark, V.log_key(F.lit(" a/b c? "))) == "ab_c"


def test_clean_text(spark):
    clean = lambda s: value(spark, X.clean_text(F.lit(s)))
    assert clean("") == ""
    assert "これはテストです。" in clean("これはテス-\nトです。")
    assert clean("行1\r\n行2\r行3\n行4") == "行1\n行2\n行3\n行4"
    assert clean("これは    テスト   です。") == "これは テスト です。"
    assert clean("テキスト\x00\x01\x02です") == "テキストです"
    assert value(spark, X.output_text(F.lit(" a\nb  c "), preserve_linebreaks=False)) == "a b c"


def test_artifacts_paragraphs_headings(spark):
    got = value(spark, X.remove_artifacts(F.lit("テキスト\n123\nさらにテキスト\n-----\n続くテキスト")))
    assert got == "テキスト\nさらにテキスト\n続くテキスト"
    assert "aaaaa" not in value(spark, X.remove_artifacts(F.lit("通常のテキストaaaaa異常な繰り返し")))
    assert value(spark, X.organize_paragraphs(F.lit("段落1の文章です。\n\n\n段落2の文章です。"))) == "段落1の文章です。\n\n段落2の文章です。"
    long = "x" * 51
    assert value(spark, X.organize_paragraphs(F.lit(f"# {long}\n{long}\nend"))) == f"# {long}\n{long}end"
    assert value(spark, X.format_headings(F.lit("第一章\n\nこれは本文です。"))) == "## 第一章\n\nこれは本文です。"
    assert value(spark, X.format_headings(F.lit("第一章\n\n本文"), detect_headings=False)) == "第一章\n\n本文"
    assert value(spark, X.format_full_text(F.lit(""))) == ""
    assert value(spark, X.format_full_text(F.lit("見出し\n\n\n本文テキスト   です。\nこれは-\n続きです。"))) == "## 見出し\n\n本文テキスト です。\nこれは続きです。"


def test_contents(spark):
    text = "# 大見出し\n\n## 中見出し1\n\n### 小見出し\n\n## 中見出し2"
    assert value(spark, X.table_of_contents(F.lit(text))) == "- 大見出し\n  - 中見出し1\n    - 小見出し\n  - 中見出し2"


def test_heading_levels(spark):
    got = [value(spark, X.heading_level(F.lit(h), F.lit(20.0))) for h in (40, 30, 25)]
    assert got == [1, 2, 3]
    verdict = lambda kind, h, text: value(spark, X.is_heading(F.lit(kind), F.lit(h), F.lit(20.0), F.lit(text)))
    assert verdict("heading", 20, "x" * 40) and verdict("text", 30, "x" * 40) and verdict("text", 20, "短い")
    assert not verdict("text", 20, "x" * 31)


def test_records(spark):
    j = '{"reader":{"window_title":"Reader"},"ocr":{"yomitoku":{"confidence_threshold":0.7}}}'
    assert value(spark, R.json_get(F.lit(j), "ocr.yomitoku.confidence_threshold")) == "0.7"
    assert value(spark, R.json_get(F.lit(j), "ocr.none", "d")) == "d"
    assert value(spark, R.missing_paths(F.lit(j), ["reader", "logging.level"])) == ["logging.level"]
    with pytest.raises(Exception, match="missing section"):
        value(spark, R.json_section(F.lit(j), "output"))
    fenced = '```json\n{"summary": {"total_issues": 2}, "issues": [{"title": "T", "severity": "high"}], "overall_comment": "ok"}\n```'
    got = value(spark, R.review_record(F.lit(fenced)))
    assert got["summary"]["total_issues"] == 2 and got["issues"][0]["title"] == "T"
    plain = value(spark, R.review_record(F.lit("x" * 600)))
    assert plain["overall_comment"] == "x" * 500 and plain["issues"] == []
    text = value(spark, let(R.review_record(F.lit(fenced)), R.review_markdown))
    assert "#### 1. 🔴 ✨ T" in text and "**Line**" not in text and "ok" in text
    assert value(spark, R.page_file(F.lit(7))) == "page_0007" and value(spark, R.page_file(F.lit(12345))) == "page_12345"


def test_assembly(spark):
    pages = spark.createDataFrame([("b", 3, "ページ3"), ("b", 1, "ページ1"), ("b", 2, "ページ2")], "book string, page bigint, text string")
    whole = A.assemble_pages(pages, "book", "page", "text").first()["text"]
    assert whole == "ページ1\n\n---\n\nページ2\n\n---\n\nページ3"
    parts = A.assemble_pages(pages, "book", "page", "text", part_pages=2)
    assert {r["part"]: r["text"] for r in parts.collect()} == {0: "ページ1", 1: "ページ2\n\n---\n\nページ3"}
    meta = F.create_map(F.lit("title"), F.lit("書籍タイトル"))
    top = {r["part"]: r["text"] for r in A.with_front_matter(parts, "book", meta).collect()}
    assert top[0].startswith("---\nTitle: 書籍タイトル\n---\n") and "Title" not in top[1]
    end = {r["part"]: r["text"] for r in A.with_front_matter(parts, "book", meta, top=False).collect()}
    assert end[1].endswith("---\nTitle: 書籍タイトル\n---\n") and "Title" not in end[0]
    nested = F.array(F.array(F.array(F.array(F.lit("テ"), F.lit("ス")), F.array(F.lit("ト")))))
    assert value(spark, A.nested_text(nested)) == "テスト"


def test_states(spark):
    pages = spark.createDataFrame([("b", p, p % 5 == 0) for p in range(1, 31)], "book string, page bigint, failed boolean")
    s = L.list_states(pages, "book", "page", "failed", F.lit(40)).first()
    assert (s["processed"], s["failed"], s["current_page"], s["status"]) == (24, 6, 30, "in_progress")
    lists = L.state_lists(pages, "book", "page", "failed").first()
    assert lists["failed_pages"] == [5, 10, 15, 20, 25, 30] and len(lists["processed_pages"]) == 24


def test_registry_and_fallback(spark):
    assert E.create("HTML_PLAIN").name == "html_plain" and E.create("nothing") is None
    assert [e.name for e in E.preference(["nothing", "html_plain"])] == ["html_plain", "html_blocks"]
    assert [e.name for e in E.preference(["html_plain"], fallback=False)] == ["html_plain"]
    df = spark.createDataFrame([(1, "<div>only text</div>"), (2, "<p>a &amp; b</p>"), (3, "")], "id int, html string")
    rows = E.extract_with_fallback(df, "html", E.preference(["html_blocks"])).orderBy("id").select("id", "result.*").collect()
    assert [(r["engine"], r["text"], r["success"]) for r in rows] == [
        ("html_plain", "only text", True), ("html_blocks", "a & b", True), ("html_plain", "", False)]
    assert rows[2]["confidence"] == 0.0 and rows[2]["error_message"] == "no text"
    names = spark.createDataFrame([("a",), ("b",)], "n string")
    other = spark.createDataFrame([("b",), ("c",)], "n string")
    assert [r["n"] for r in E.usable_engines(names, other).collect()] == ["b"]
    assert [r["n"] for r in E.extra_engines(names, other).collect()] == ["a"]
    single = value(spark, E.single_block_layout(F.lit("t")))[0]
    assert single["confidence"] == 0.95 and single["bounding_box"]["width"] == 800


def test_model_extractor(spark):
    import pandas as pd

    df = spark.createDataFrame([(1, "abc"), (2, "")], "id int, payload string")
    good = E.model_extractor(df, "payload", "upper", lambda s: pd.DataFrame({"text": s.str.upper(), "confidence": 0.8}))
    assert [(r["text"], r["success"]) for r in good.orderBy("id").collect()] == [("ABC", True), ("", False)]

    def fails(s):
        raise ValueError("no model")

    rows = E.model_extractor(df, "payload", "none", fails).collect()
    assert {(r["success"], r["error_message"]) for r in rows} == {(False, "no model")}
