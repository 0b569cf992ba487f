"""Sources and sinks on files in a temporary folder."""

import json

from pyspark.sql import functions as F

from folio_spark.sources import files, sinks


def test_page_files(spark, tmp_path):
    for book in ("a", "b"):
        (tmp_path / book).mkdir()
        for page in (1, 12):
            (tmp_path / book / f"page_{page:04d}.png").write_bytes(b"x" * page)
    (tmp_path / "a" / "cover.png").write_bytes(b"c")
    rows = files.scan_page_files(spark, str(tmp_path)).collect()
    assert sorted((r["book"], r["page"], r["size"]) for r in rows) == [("a", 1, 1), ("a", 12, 12), ("b", 1, 1), ("b", 12, 12)]


def test_states(spark, tmp_path):
    record = {
        "book_title": "A", "start_datetime": "2024-01-01T10:00:00.123456", "last_update": "2024-01-01T11:00:00",
        "current_page": 3, "total_pages": 9, "processed_pages": [1, 2, 3], "failed_pages": [], "output_file": "o",
        "screenshot_dir": "s", "status": "in_progress",
    }
    (tmp_path / "A_state.json").write_text(json.dumps(record, indent=2))
    (tmp_path / "B_state.json").write_text("{ broken")
    (tmp_path / "notes.json").write_text("{}")
    records = files.scan_states(spark, str(tmp_path))
    assert records.count() == 2
    rows = files.current_states(records).collect()
    assert [(r["book_title"], r["total_pages"], r["updated_at"].hour) for r in rows] == [("A", 9, 11)]


def test_write_modes(spark, tmp_path):
    path = str(tmp_path / "new" / "out")
    one = spark.createDataFrame([("x",)], "value string")
    assert sinks.write_text(one, path)
    assert not sinks.write_text(one, path, mode="create")
    assert not sinks.write_text(one, path, mode="unknown")
    assert sinks.write_text(one, path, mode="append") and spark.read.text(path).count() == 2
    assert sinks.write_text(one, path, mode="overwrite") and spark.read.text(path).count() == 1
    assert sinks.write_text(one, str(tmp_path / "fresh"), mode="append")


def test_write_pages(spark, tmp_path):
    rows = [("b", p, f"page {p}") for p in (3, 1, 2)] + [("c", 1, "only")]
    pages = spark.createDataFrame(rows, "book string, page bigint, text string")
    meta = F.create_map(F.lit("title"), F.lit("T"))
    path = str(tmp_path / "doc")
    assert sinks.write_pages(pages, path, "book", "page", "text", separator="\n==\n", metadata=meta)
    text = "".join(p.read_text() for p in sorted((tmp_path / "doc" / "book=b").rglob("part-*")))
    assert text == "---\nTitle: T\n---\n\npage 1\n==\npage 2\n==\npage 3\n"
    assert len(list((tmp_path / "doc" / "book=b").rglob("part-*"))) == 1


def test_markdown_and_names(spark):
    one = spark.range(1)
    title = sinks.title_from_path(F.lit("/tmp/quick.md"))
    doc = sinks.markdown_document(title, F.lit("## a\n\ntext"), toc=True)
    assert one.select(doc.alias("v")).first()["v"] == "# quick\n\n## 目次\n\n  - a\n\n## a\n\ntext"
    paths = one.select(sinks.markdown_path(F.lit("a/b.txt")).alias("p"), sinks.markdown_path(F.lit("a/b.md")).alias("q")).first()
    assert tuple(paths) == ("a/b.md", "a/b.md")


def test_markdown_of_a_long_book_lists_all_headings(spark):
    pages = spark.range(1, 8).select(F.lit("b").alias("book"), F.col("id").alias("page"), F.concat(F.lit("# h"), F.col("id")).alias("text"))
    rows = sinks.markdown_parts(pages, "book", "page", "text", title=F.col("book"), part_pages=3).collect()
    parts = sorted((r["section"], r["part"], r["text"]) for r in rows)
    assert [p[:2] for p in parts] == [(0, 0), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2)]
    toc = "\n".join(p[2] for p in parts if p[0] == 1)
    assert toc == "\n".join(f"- h{i}" for i in range(1, 8))
    assert parts[0][2] == "# b\n\n## 目次"


def test_encoding(spark):
    one = spark.range(1)
    got = one.select(sinks.encoded(F.lit("あ\nb"), "utf-8-sig", newline="\r\n").alias("v")).first()["v"]
    assert bytes(got) == "あ\r\nb".encode("utf-8-sig")
    try:
        sinks.encoded(F.lit("x"), "shift_jis")
        raise AssertionError("accepted")
    except ValueError as e:
        assert "shift_jis" in str(e)


def test_info_metrics_and_replace(spark, tmp_path):
    (tmp_path / "f.txt").write_text("hello")
    assert tuple(files.file_info(spark, str(tmp_path / "f.txt")).first())[1:3] == ("f.txt", 5)
    df = spark.createDataFrame([("t", 1, 0.1, 0.2, 0.5, 0.8, 100.0, 5.0)], files.METRIC)
    path = sinks.write_metrics(df, str(tmp_path), "20240101_000000")
    assert files.read_metrics(spark, path).first()["ocr_time"] == 0.5
    base = spark.createDataFrame([("a", 1), ("b", 1)], "book string, n int")
    target = str(tmp_path / "books")
    sinks.replace_books(base, target, "book")
    sinks.replace_books(spark.createDataFrame([("b", 2)], "book string, n int"), target, "book")
    assert sorted((r["book"], r["n"]) for r in spark.read.parquet(target).collect()) == [("a", 1), ("b", 2)]


def png(rows, colour):
    """A small PNG file: 8 bit, grey or RGB, unfiltered lines."""
    import struct
    import zlib

    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    width = len(rows[0]) // (3 if colour else 1)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 2 if colour else 0, 0, 0, 0)
    body = zlib.compress(b"".join(b"\0" + bytes(r) for r in rows))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def test_images_become_grids(spark, tmp_path):
    from folio_spark.sources import images

    (tmp_path / "grey.png").write_bytes(png([[0, 10, 20], [30, 40, 255]], False))
    (tmp_path / "rgb.png").write_bytes(png([[255, 0, 0, 0, 255, 0], [0, 0, 255, 9, 9, 9]], True))
    (tmp_path / "broken.png").write_bytes(b"nothing")
    scanned = images.scan_images(spark, str(tmp_path))
    assert {r["origin"].rsplit("/", 1)[1]: r["success"] for r in scanned.collect()} == {"grey.png": True, "rgb.png": True, "broken.png": False}
    rows = images.image_grids(scanned).collect()
    grey = {(r["y"], r["x"]): r["v"] for r in rows if r["gid"].endswith("grey.png")}
    rgb = {(r["y"], r["x"]): r["v"] for r in rows if r["gid"].endswith("rgb.png")}
    assert grey == {(0, 0): 0, (0, 1): 10, (0, 2): 20, (1, 0): 30, (1, 1): 40, (1, 2): 255}
    assert rgb == {(0, 0): 76, (0, 1): 150, (1, 0): 29, (1, 1): 9}


def test_normalised(spark):
    from folio_spark.operators import quality as V

    df = spark.createDataFrame([("  My Book ", " PNG", "debug ")], "t string, f string, l string")
    out = V.normalised(df, {"t": "title", "f": "format", "l": "log_level"}).first()
    assert tuple(out) == ("My Book", "png", "DEBUG")
