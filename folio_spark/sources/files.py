"""Page files, state files and metric files as tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ledger import latest_state
from ..schema import METRIC, STATE

PAGE_PATTERN = "page_*"
PAGE_NUMBER = r"page_([0-9]+)\.[A-Za-z0-9]+$"
BOOK_FOLDER = r"([^/]+)/[^/]+$"


def scan_page_files(spark: SparkSession, folder: str, *, pattern: str = PAGE_PATTERN, content: bool = True):
    """``(book, page, path, size, modified[, content])`` of the page files below a folder.

    Without content only the listing is read.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(folder)
    )
    number = F.regexp_extract("path", PAGE_NUMBER, 1)
    columns = [
        F.regexp_extract("path", BOOK_FOLDER, 1).alias("book"),
        number.cast("bigint").alias("page"),
        "path",
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    ]
    return files.filter(number != "").select(*columns, *(["content"] if content else []))


def scan_states(spark: SparkSession, folder: str) -> DataFrame:
    """State records of all books; an unreadable file is a row with ``_corrupt_record``."""
    schema = T.StructType([*STATE.fields, T.StructField("_corrupt_record", T.StringType())])
    records = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("pathGlobFilter", "*_state.json")
        .json(folder)
    )
    return records.withColumns({
        "started_at": F.try_to_timestamp("start_datetime"),
        "updated_at": F.try_to_timestamp("last_update"),
    })


def current_states(records: DataFrame, book: str = "book_title") -> DataFrame:
    """Newest readable record per book."""
    good = records.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    return latest_state(good, book, ["updated_at"])


def file_info(spark: SparkSession, path: str) -> DataFrame:
    """Path, name, size and modification time of files, from their listing; no rows for a missing path."""
    try:
        listed = spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, name string, size bigint, modified timestamp")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return listed.select(
        "path", name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")
    )


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC).json(path)
