"""From raw labelled rows to a numbered, validated input manifest."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evalweave.functions.text import clean_float, clean_text, prompt_hash, shuffle_key
from evalweave.operators.lazy import buffered_shuffle
from evalweave.operators.ordered import content, dense_index, limit_ordered, number_limited
from evalweave.operators.skew import lookup_join
from evalweave.schemas import (
    EXAMPLE_COLUMNS,
    EXAMPLE_SCHEMA,
    FILTER_COLUMNS,
    FLOAT_COLUMN,
    MANIFEST_SCHEMA,
    METADATA_COLUMNS,
)
from evalweave.session import stage

# Rules in the order in which a row is checked.
RULES = ("empty_id", "duplicate_id", "empty_prompt")


def allowed_values(values: Iterable[object] | str | None) -> list[str]:
    """A filter argument as texts: nothing, one bare text, or several values."""
    given = (values,) if isinstance(values, str) else values or ()
    return list(map(str, given))


@dataclass(frozen=True)
class ManifestSpec:
    """What to select and how to order it. ``order_by`` stands in for the file order of a source.

    A DataFrame is read lazily either way; ``streaming`` with ``shuffle`` means that rows are shuffled as
    they are read, through a buffer of ``shuffle_buffer`` rows of each of the ``shards`` (the columns
    that name a row's file), instead of all at once.
    """

    dataset_name: str = "dataset"
    revision: str = "main"
    split: str = "train"
    order_by: Sequence[str] = ("id",)
    max_samples: int | None = None
    languages: Sequence[str] | str | None = None
    prompt_labels: Sequence[str] | str | None = None
    response_labels: Sequence[str] | str | None = None
    tags: Sequence[str] | str | None = None
    sources: Sequence[str] | str | None = None
    seed: int = 42
    shuffle: bool = False
    normalize: bool = True
    streaming: bool = False
    shuffle_buffer: int = 10_000
    shards: Sequence[str] = ()

    def __post_init__(self) -> None:
        if self.streaming and self.shuffle and not self.shards:
            raise ValueError("a shuffle while reading needs the columns that name the shards")
        if self.max_samples is not None and self.max_samples <= 0:
            raise ValueError("max_samples must be greater than zero")

    def filters(self) -> dict[str, list[str]]:
        chosen = (
            self.languages, self.prompt_labels, self.response_labels, self.tags, self.sources,
        )
        return {name: allowed_values(values) for name, values in zip(FILTER_COLUMNS, chosen, strict=True)}


def missing_columns(columns: Iterable[str]) -> list[str]:
    return sorted(set(EXAMPLE_COLUMNS) - set(columns))


def require_columns(df: DataFrame) -> DataFrame:
    missing = missing_columns(df.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def schema_report(df: DataFrame) -> DataFrame:
    """One row per expected column: is it there, and how many of its values are set."""
    present = set(df.columns)
    counts = df.agg(
        *[
            (F.count(F.col(c)) if c in present else F.lit(0).cast("bigint")).alias(c)
            for c in EXAMPLE_COLUMNS
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(c in present).alias("present"),
                F.col(c).alias("values_set"),
            )
            for c in EXAMPLE_COLUMNS
        ]
    )
    return counts.select(F.inline(rows))


def membership(df: DataFrame, column: str, allowed: Sequence[str]) -> Column:
    """Is the raw value, as text, one of ``allowed``? A null reads ``None``, an absent column ``""``."""
    if column not in df.columns:
        return F.lit("" in allowed)
    value = F.col(column)
    if df.schema[column].dataType != T.StringType():
        value = value.cast("string")
    inside = value.isin(list(allowed))
    # Spelled as OR so that both halves still reach the parquet reader.
    return (value.isNull() | inside) if "None" in allowed else inside


def filter_examples(df: DataFrame, filters: dict[str, list[str]]) -> DataFrame:
    """Rows that pass every non-empty list; compares raw values, before any cleaning."""
    for column, allowed in filters.items():
        if allowed:
            df = df.filter(membership(df, column, allowed))
    return df


def normalize_examples(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The declared columns, cleaned; an absent column is treated as null. ``keep`` passes through."""

    def cleaned(name: str) -> Column:
        here = name in df.columns
        raw = F.col(name) if here else F.lit(None).cast("string")
        floating = here and isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
        build = clean_float if name == FLOAT_COLUMN else clean_text
        return build(raw, is_float=floating).alias(name)

    extra = [c for c in keep if c not in EXAMPLE_COLUMNS]
    return df.select(*[cleaned(c) for c in EXAMPLE_COLUMNS], *extra)


def map_rows(
    df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str
) -> DataFrame:
    """A user's own row function, one pandas batch at a time, for what no expression can say.

    Select the columns it needs first: nothing can be pruned through it.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return map(function, frames)

    return df.mapInPandas(run, schema)


def metadata(df: DataFrame) -> DataFrame:
    absent = F.lit(None)
    return df.select(
        *[
            F.col(c) if c in df.columns else absent.cast(EXAMPLE_SCHEMA[c].dataType).alias(c)
            for c in METADATA_COLUMNS
        ]
    )


def kept_columns(spec: ManifestSpec) -> list[str]:
    return list(dict.fromkeys([*spec.order_by, *spec.shards]))


def load_examples(df: DataFrame, spec: ManifestSpec) -> DataFrame:
    """Filter, clean, limit; no shuffle."""
    df = filter_examples(require_columns(df), spec.filters())
    if spec.normalize:
        df = normalize_examples(df, keep=kept_columns(spec))
    return limit_ordered(df, spec.order_by, spec.max_samples, spec.order_by)


def with_order(df: DataFrame, spec: ManifestSpec) -> tuple[DataFrame, list[str]]:
    """``df`` and the columns that put it in order: the seeded key first when shuffling."""
    if not spec.shuffle:
        return df, list(spec.order_by)
    if spec.streaming:
        shuffled = buffered_shuffle(df, spec.shards, seed=spec.seed, buffer=spec.shuffle_buffer)
        return shuffled, ["shuffle_shard", "shuffle_place", *spec.order_by]
    return df.withColumn("_shuffle", shuffle_key(spec.seed, F.col("id"))), ["_shuffle", *spec.order_by]


def seeded_shuffle(df: DataFrame, spec: ManifestSpec, name: str = "row_index") -> DataFrame:
    """Number the rows in an order set by the seed and the ids alone."""
    keyed, order = with_order(df, replace(spec, shuffle=True))
    return dense_index(keyed, order, name, keep=df.columns)


def number_examples(df: DataFrame, spec: ManifestSpec) -> DataFrame:
    """Filter, clean, shuffle, limit, number and hash: the manifest before validation."""
    rows = load_examples(df, replace(spec, max_samples=None))
    if not spec.normalize:
        # Every manifest row is clean, also when the loader was told to leave rows as they are.
        rows = normalize_examples(rows, keep=kept_columns(spec))
    rows = rows.withColumn("prompt_sha256", prompt_hash(F.col("prompt")))
    if spec.shuffle and spec.streaming:
        return _number_streamed(rows, spec).select(*MANIFEST_SCHEMA.names)
    rows, order = with_order(rows, spec)
    numbered = number_limited(rows, order, spec.max_samples, list(spec.order_by))
    return numbered.select(*MANIFEST_SCHEMA.names)


def _number_streamed(rows: DataFrame, spec: ManifestSpec) -> DataFrame:
    """The rows numbered as they leave the buffer of their shard, which takes them in by ``order_by``.

    Only order and shard of a row go through the buffers, as a task has a whole shard; the rows meet their
    number by ``order_by``. Where that does not tell them apart, whole rows go through, ties by content.
    """
    key = list(spec.order_by)
    absent = functools.reduce(Column.__or__, [F.col(c).isNull() for c in key])
    keys = stage(rows.select(*kept_columns(spec)), "shard-keys")
    unfit = keys.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > 1) | absent)
    narrow = unfit.isEmpty()
    taken = keys if narrow else stage(rows, "tied-examples")
    ties = [] if narrow else [content(taken)]
    laid = taken.repartition(*spec.shards).sortWithinPartitions(*spec.shards, *key, *ties)
    shuffled, order = with_order(laid, spec)
    numbered = number_limited(stage(shuffled, "shuffled-keys"), order, spec.max_samples, key)
    return rows.join(numbered.select(*key, "row_index"), key) if narrow else numbered


def violations(numbered: DataFrame) -> DataFrame:
    """Every broken rule of every row: (row_index, id, rule, priority).

    A duplicate is the second and any later row of an id. The empty id has its own rule and is
    left out before grouping, so it cannot become a hot key. An empty prompt is told by its hash,
    which leaves the texts unread.
    """
    no_prompt = F.col("prompt_sha256") == prompt_hash(F.lit(""))
    rows = numbered.select("row_index", "id", no_prompt.alias("_no_prompt"))
    named = rows.filter(F.col("id") != "")
    repeated = (
        named.groupBy("id")
        .agg(F.min("row_index").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > 1)
        .select("id", "_first")
    )
    marked = lookup_join(rows, repeated, ["id"])
    broken = F.array(
        F.when(F.col("id") == "", F.lit(0)),
        F.when(F.col("row_index") > F.col("_first"), F.lit(1)),
        F.when(F.col("_no_prompt"), F.lit(2)),
    )
    found = marked.select("row_index", "id", F.explode(broken).alias("priority")).filter(
        F.col("priority").isNotNull()
    )
    names = F.array(*[F.lit(rule) for rule in RULES])
    return found.select("row_index", "id", F.get(names, F.col("priority")).alias("rule"), "priority")


def first_violation(found: DataFrame) -> DataFrame:
    """The violation a row-by-row check would stop at; no row when all is well."""
    place = F.struct("row_index", "priority", "rule", "id")
    return (
        found.agg(F.min(place).alias("v"))
        .filter(F.col("v").isNotNull())
        .select("v.row_index", "v.id", "v.rule")
    )


def require_valid(numbered: DataFrame) -> DataFrame:
    worst = first_violation(violations(numbered)).first()
    if worst is not None:
        raise ValueError(f"row {worst['row_index']} ({worst['id']!r}): {worst['rule']}")
    return numbered


def build_manifest(df: DataFrame, spec: ManifestSpec, path: str | None = None) -> DataFrame:
    """The validated manifest as a stored table; raises at the first bad row.

    It is written once, to ``path`` or the shared folder, as the barrier between the dataset and the
    models: the checks read two of its narrow columns, and every model reads the same files.
    """
    return require_valid(stage(number_examples(df, spec), "manifest", path))


def manifest_facts(manifest: DataFrame) -> Row:
    """Number of rows and a fingerprint of the numbered ids and prompts, in one narrow pass.

    The fingerprint folds 60 bits of a hash per row by exclusive or, so it depends on every row and
    on its number but not on how the rows are laid out.
    """
    line = F.concat_ws(":", F.col("row_index").cast("string"), "id", "prompt_sha256")
    bits = F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("bigint")
    folded = F.coalesce(F.bit_xor(bits), F.lit(0).cast("bigint"))
    return manifest.agg(
        F.count(F.lit(1)).alias("examples"), F.lower(F.hex(folded)).alias("fingerprint")
    ).first()


def describe_manifest(spec: ManifestSpec, facts: Row, path: str, resolved: str) -> list[Column]:
    """The columns of the dataset metadata document."""
    filters = spec.filters()
    plural = dict(
        zip(
            FILTER_COLUMNS,
            ("languages", "prompt_labels", "response_labels", "tags", "sources"),
            strict=True,
        )
    )

    def texts(values: list[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    return [
        F.lit(spec.dataset_name).alias("dataset_name"),
        F.lit(spec.revision).alias("requested_revision"),
        F.lit(resolved).alias("resolved_revision"),
        F.lit(spec.split).alias("split"),
        F.lit(spec.streaming).alias("streaming"),
        F.lit(facts["fingerprint"]).alias("fingerprint"),
        F.lit(facts["examples"]).cast("bigint").alias("examples"),
        F.lit(path).alias("manifest_path"),
        F.struct(*[texts(filters[c]).alias(plural[c]) for c in FILTER_COLUMNS]).alias("filters"),
        F.lit(spec.shuffle).alias("shuffle"),
        F.lit(spec.seed).alias("seed"),
    ]


def assign_batches(df: DataFrame, batch_size: int) -> DataFrame:
    """Consecutive rows share a batch; the last batch may be short."""
    if batch_size <= 0:
        raise ValueError("batch_size must be greater than zero")
    return df.withColumn("batch_id", F.floor(F.col("row_index") / batch_size).cast("bigint"))


def first_batches(df: DataFrame, batch_size: int, max_batches: int | None) -> DataFrame:
    if max_batches is None:
        return df
    return df.filter(F.col("row_index") < batch_size * max_batches)


def collate(df: DataFrame, batch_size: int) -> DataFrame:
    """One row per batch with parallel lists; a group never exceeds ``batch_size`` rows."""
    ordered = F.array_sort(
        F.collect_list(
            F.struct(
                "row_index",
                clean_text(F.col("prompt")).alias("prompt"),
                clean_text(F.col("response")).alias("reference"),
                F.struct(
                    *METADATA_COLUMNS,
                    "row_index",
                    clean_text(F.col("prompt_sha256")).alias("prompt_sha256"),
                ).alias("metadata"),
            )
        )
    )
    batches = assign_batches(df, batch_size).groupBy("batch_id").agg(ordered.alias("_rows"))
    return batches.select(
        "batch_id",
        F.col("_rows.prompt").alias("prompts"),
        F.col("_rows.reference").alias("reference_responses"),
        F.col("_rows.metadata").alias("metadata"),
    )


def collate_with(
    df: DataFrame,
    batch_size: int,
    function: Callable[[list[dict]], dict],
    schema: T.StructType | str,
    *,
    per_row: Sequence[str] = (),
) -> DataFrame:
    """``batch_id`` and what a user's own ``function`` makes of the rows of each batch, in row order.

    For what ``collate`` cannot say. ``df`` holds the columns that the function reads, and ``row_index``.
    ``schema`` declares the fields that it returns; other fields are refused, and so is a list of
    ``per_row`` that has not one entry for each row. A worker holds one batch, whatever the number of
    batches in its task.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    unknown = set(per_row) - set(fields.names)
    if unknown:
        raise ValueError(f"not in the schema: {', '.join(sorted(unknown))}")
    whole = T.StructType([T.StructField("batch_id", T.LongType()), *fields.fields])
    rows = assign_batches(df, batch_size).repartition("batch_id").sortWithinPartitions("batch_id", "row_index")

    def made(batch: int, rows: list[dict]) -> dict:
        out = function(rows)
        if set(out) != set(fields.names):
            raise ValueError(f"batch {batch}: the function returned {sorted(out)}, not {sorted(fields.names)}")
        for name in per_row:
            if out[name] is None or len(out[name]) != len(rows):
                raise ValueError(f"batch {batch}: {name} has not one entry for each of {len(rows)} rows")
        return {"batch_id": batch, **out}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(whole)
        number, held = None, []
        for part in batches:
            done = []
            for row in part.to_pylist():
                own = row.pop("batch_id")
                if own != number and held:
                    done.append(made(number, held))
                    held = []
                number = own
                held.append(row)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=arrow)
        if held:
            yield pa.RecordBatch.from_pylist([made(number, held)], schema=arrow)

    return rows.mapInArrow(run, whole)


def iterate_examples(batches: DataFrame) -> DataFrame:
    """Batches back to (prompt, metadata, reference) rows; lists of unequal length are an error."""
    sizes = [F.size(c) for c in ("prompts", "metadata", "reference_responses")]
    even = (sizes[0] > 0) & (sizes[0] == sizes[1]) & (sizes[0] == sizes[2])
    checked = batches.withColumn(
        "prompts",
        F.when(even, F.col("prompts")).otherwise(
            F.raise_error(F.lit("a batch is empty or its lists differ in length")).cast(
                "array<string>"
            )
        ),
    )
    zipped = F.arrays_zip("prompts", "metadata", "reference_responses")
    return checked.select("batch_id", F.explode(zipped).alias("z")).select(
        "batch_id",
        F.col("z.prompts").alias("prompt"),
        F.col("z.metadata").alias("metadata"),
        F.col("z.reference_responses").alias("reference_response"),
    )
