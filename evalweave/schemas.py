"""Declared schemas. Nothing here is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

FLOAT_COLUMN = "reconstruction_id_if_redacted"

# The input columns in their file order.
EXAMPLE_COLUMNS = (
    "id",
    "prompt",
    "response",
    "prompt_label",
    "response_label",
    "violated_categories",
    "prompt_label_source",
    "response_label_source",
    "tag",
    "language",
    "reconstruction_id_if_redacted",
    "source",
)
METADATA_COLUMNS = tuple(c for c in EXAMPLE_COLUMNS if c not in ("prompt", "response"))
FILTER_COLUMNS = ("language", "prompt_label", "response_label", "tag", "source")

EXAMPLE_SCHEMA = T.StructType(
    [
        T.StructField(c, T.DoubleType() if c == FLOAT_COLUMN else T.StringType())
        for c in EXAMPLE_COLUMNS
    ]
)
MANIFEST_SCHEMA = T.StructType(
    EXAMPLE_SCHEMA.fields
    + [T.StructField("row_index", T.LongType()), T.StructField("prompt_sha256", T.StringType())]
)

SCHEMA_VERSION = 1
CONTEXT_SCHEMA = T.StructType(
    [
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("experiment_id", T.StringType()),
        T.StructField("model_kind", T.StringType()),
        T.StructField("model_id", T.StringType()),
        T.StructField("model_revision", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("example_id", T.StringType()),
        T.StructField("row_index", T.LongType()),
        T.StructField("prompt_sha256", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("prompt_label", T.StringType()),
        T.StructField("response_label", T.StringType()),
        T.StructField("violated_categories", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("seed", T.LongType()),
    ]
)
CONTEXT_COLUMNS = tuple(CONTEXT_SCHEMA.names)

OUTPUT_SCHEMA = T.StructType(
    [T.StructField("event", T.StringType())]
    + CONTEXT_SCHEMA.fields
    + [
        T.StructField("prompt", T.StringType()),
        T.StructField("reference_response", T.StringType()),
        T.StructField("generation_configuration", T.StringType()),
        T.StructField("input_token_count", T.LongType()),
        T.StructField("output_token_count", T.LongType()),
        T.StructField("response", T.StringType()),
        T.StructField("final_text", T.StringType()),
        T.StructField("final_token_ids", T.ArrayType(T.IntegerType())),
        T.StructField("rendered_prompt", T.StringType()),
        T.StructField("raw_response", T.StringType()),
        T.StructField("response_error", T.StringType()),
    ]
)
