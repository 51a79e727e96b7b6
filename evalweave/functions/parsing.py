"""Column builders over JSON text, using the variant type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.text import strip

# The reply fields in the order they are looked at.
REPLY_FIELDS = ("response", "content", "final_answer", "text")


def _quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def parse_response(raw: str) -> Column:
    """Reply text out of a raw model answer held in column ``raw``.

    A JSON string is itself; an object gives its first reply field that holds a *string*; anything
    else, broken JSON included, stays as it came.
    """
    parsed = f"try_parse_json({_quoted(raw)})"
    picks = [
        f"CASE WHEN schema_of_variant(variant_get({parsed}, '$.{field}', 'variant')) = 'STRING' "
        f"THEN variant_get({parsed}, '$.{field}', 'string') END"
        for field in REPLY_FIELDS
    ]
    whole = f"CASE WHEN schema_of_variant({parsed}) = 'STRING' THEN variant_get({parsed}, '$', 'string') END"
    return F.expr(f"coalesce({whole}, {', '.join(picks)}, {_quoted(raw)})")


def json_line_kind(line: str) -> Column:
    """``blank``, ``object``, ``not_object`` or ``broken`` for one line of JSON text."""
    parsed = f"try_parse_json({_quoted(line)})"
    return (
        F.when(strip(F.col(line)) == "", "blank")
        .when(F.expr(f"{parsed} IS NULL"), "broken")
        .when(F.expr(f"schema_of_variant({parsed}) LIKE 'OBJECT%'"), "object")
        .otherwise("not_object")
    )


def scalar_entries(df: DataFrame, config: str, keys: list[str]) -> DataFrame:
    """One row per entry of the JSON object in ``config`` that is a scalar or null."""
    parsed = df.selectExpr(*map(_quoted, keys), f"try_parse_json({_quoted(config)}) AS _v")
    entries = parsed.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    kind = F.schema_of_variant(F.col("value"))
    return entries.filter(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY")).select(
        *keys, "key", F.to_json("value").alias("value")
    )
