"""Explicit schemas of the engine's relations."""

from pyspark.sql import types as T

BBOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")])
SPAN = T.StructType([T.StructField("text", T.StringType()), T.StructField("size", T.DoubleType()), T.StructField("flags", T.IntegerType()), T.StructField("font", T.StringType()), T.StructField("bbox", BBOX)])
LAYOUT_LINES = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("page_index", T.IntegerType()), T.StructField("line_seq", T.IntegerType()), T.StructField("native", T.BooleanType()), T.StructField("page_width", T.DoubleType()), T.StructField("page_height", T.DoubleType()), T.StructField("spans", T.ArrayType(SPAN))]
)
JOBS = T.StructType(
    [
        T.StructField(c, t)
        for c, t in [
            ("id", T.StringType()), ("route", T.StringType()), ("original_filename", T.StringType()), ("slug", T.StringType()), ("file_hash", T.StringType()), ("upload_path", T.StringType()),
            ("status", T.StringType()), ("disciplina", T.StringType()), ("professora", T.StringType()), ("aula", T.StringType()), ("titulo", T.StringType()), ("tags", T.ArrayType(T.StringType())),
            ("job_dir", T.StringType()), ("md_path", T.StringType()), ("n_images", T.IntegerType()), ("n_artigos", T.IntegerType()), ("reaproveitado", T.BooleanType()), ("error_message", T.StringType()),
            ("created_at", T.TimestampType()), ("updated_at", T.TimestampType()),
        ]
    ]
)
