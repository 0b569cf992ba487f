"""Row types of blocks, layouts, extraction results and state records."""

from __future__ import annotations

from pyspark.sql import types as T

BBOX = T.StructType([
    T.StructField("left", T.IntegerType()),
    T.StructField("top", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("confidence", T.DoubleType()),
])
BLOCK = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("bounding_box", BBOX),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("block_type", T.StringType()),
    T.StructField("font_size", T.IntegerType()),
    T.StructField("is_bold", T.BooleanType()),
])
RESULT = T.StructType([
    T.StructField("engine", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("blocks", T.ArrayType(BLOCK)),
    T.StructField("processing_time", T.DoubleType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("error_message", T.StringType()),
])
STATE = T.StructType([
    T.StructField("book_title", T.StringType()),
    T.StructField("start_datetime", T.StringType()),
    T.StructField("last_update", T.StringType()),
    T.StructField("current_page", T.LongType()),
    T.StructField("total_pages", T.LongType()),
    T.StructField("processed_pages", T.ArrayType(T.LongType())),
    T.StructField("failed_pages", T.ArrayType(T.LongType())),
    T.StructField("output_file", T.StringType()),
    T.StructField("screenshot_dir", T.StringType()),
    T.StructField("status", T.StringType()),
])
METRIC = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("page_number", T.LongType()),
    *[
        T.StructField(n, T.DoubleType())
        for n in (
            "screenshot_time", "preprocessing_time", "ocr_time", "total_time",
            "memory_usage_mb", "cpu_percent",
        )
    ],
])
