"""Files of one book each: literal bytes, character sets, spans, modes, and nothing left by a failed job."""

import codecs

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from folio_spark.sources import books as B

PAGES = [("本/1", 1, "ページ1の内容"), ("本/1", 2, "ページ2\n二行目"), ("本/1", 3, "ページ3の内容"), ("b.b", 5, "one"), ("b.b", 7, None), (None, 1, "x")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "book string, page int, text string").repartition(4)


def read(folder):
    return {p.name: p.read_bytes() for p in folder.rglob("*") if p.is_file() and not p.name.startswith(".")}


@pytest.mark.parametrize("encoding", ["utf-8", "shift_jis", "utf-16-le", "euc_jp"])
def test_bytes(pages, tmp_path, encoding):
    folder = tmp_path / "out"
    assert B.write_books(pages, str(folder), "book", "page", "text", encoding=encoding, newline="\r\n")
    expected = {
        B.name_of("本/1") + ".txt": "ページ1の内容\n\n---\n\nページ2\n二行目\n\n---\n\nページ3の内容",
        "b%2Eb.txt": "one\n\n---\n\n",
        "__none__.txt": "x",
    }
    assert read(folder) == {k: v.replace("\n", "\r\n").encode(encoding) for k, v in expected.items()}


def test_mark_and_front_matter(spark, tmp_path):
    folder = tmp_path / "out"
    one = spark.createDataFrame([("a", 1, "first"), ("a", 2, "second")], "book string, page int, text string")
    head = F.create_map(F.lit("title"), F.lit("書籍タイトル"))
    B.write_books(one, str(folder), "book", "page", "text", separator="|", metadata=head, bom=True, encoding="utf-16-be")
    text = "---\nTitle: 書籍タイトル\n---\n\nfirst|second"
    assert read(folder) == {"a.txt": codecs.BOM_UTF16_BE + text.encode("utf-16-be")}
    with pytest.raises(Exception, match="byte order mark"):
        B.write_books(one, str(tmp_path / "no"), "book", "page", "text", bom=True, encoding="shift_jis")


def test_long_book_in_spans(spark, tmp_path):
    folder = tmp_path / "out"
    rows = spark.range(0, 95).select(F.lit("long").alias("book"), (F.col("id") + 7).alias("page"), F.col("id").cast("string").alias("text"))
    B.write_books(rows, str(folder), "book", "page", "text", separator=",", page_span=20)
    files = read(folder)
    assert sorted(files) == ["long.0000000001.txt", "long.0000000002.txt", "long.0000000003.txt", "long.0000000004.txt", "long.0000000005.txt", "long.txt"]
    whole = b"".join(files[n] for n in ["long.txt", *sorted(files)[:-1]])
    assert whole.decode() == ",".join(str(i) for i in range(95))


def test_modes(spark, pages, tmp_path):
    folder = tmp_path / "out"
    write = lambda df, mode: B.write_books(df, str(folder), "book", "page", "text", mode=mode)
    assert write(pages, "create") and not write(pages, "create") and not write(pages, "unknown")
    more = spark.createDataFrame([("new", 1, "n")], "book string, page int, text string")
    assert write(more, "append") and len(read(folder)) == 4
    assert write(more, "overwrite") and read(folder) == {"new.txt": b"n"}


def test_failed_job_leaves_nothing(spark, tmp_path):
    folder = tmp_path / "out"
    rows = [("fine", 1, "plain"), ("bad", 1, "🙂 not in this set")]
    frame = spark.createDataFrame(rows, "book string, page int, text string").repartition(2, "book")
    with pytest.raises(PySparkException):
        B.write_books(frame, str(folder), "book", "page", "text", encoding="shift_jis")
    assert read(folder) == {}
