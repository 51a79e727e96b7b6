"""Queries over examples: sources, cleaning, filters, order, manifest."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.functions import text as tx
from evalweave.functions.parsing import parse_response, scalar_entries
from evalweave.operators import dataset as ds
from evalweave.operators import lazy
from evalweave.operators.ordered import dense_index, limit_ordered
from evalweave.plans import fixtures as fx
from evalweave.plans import sql as q
from evalweave.plans.registry import query
from evalweave.schemas import EXAMPLE_COLUMNS, MANIFEST_SCHEMA
from evalweave.session import shared_path
from evalweave.sources import jsonl, snapshots, tables

SPEC = ds.ManifestSpec(dataset_name="documents", order_by=("position",))
COLUMNS = ", ".join(EXAMPLE_COLUMNS)
MANIFEST_COLUMNS = ", ".join(MANIFEST_SCHEMA.names)


@query("scan_examples", f"WITH {q.EXAMPLES} SELECT {COLUMNS} FROM examples")
def scan_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "examples")
    fx.examples(spark, sf_dir).write.parquet(f"{path}/rev-1/train")
    return tables.scan(spark, path, split="train", revision="rev-1").select(*EXAMPLE_COLUMNS)


@query(
    "snapshot_revisions",
    """SELECT 'pinned' AS revision, doc_id, lang FROM documents WHERE doc_id % 3 < 2
    UNION ALL SELECT 'third', doc_id, lang FROM documents
    UNION ALL SELECT 'latest', doc_id, lang FROM documents WHERE lang = 'en'""",
)
def snapshot_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three revisions of one table: a tagged one, the one after an append, and a replacement."""
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", "lang")
    path = shared_path(spark, "snapshots")
    for part in (0, 1):
        snapshots.commit(rows.filter(F.col("doc_id") % 3 == part), path)
    snapshots.tag(spark, path, "pinned")
    third = snapshots.commit(rows.filter(F.col("doc_id") % 3 == 2), path)
    snapshots.commit(rows.filter(F.col("lang") == "en"), path, replace=True)
    read = {"pinned": "pinned", "third": third, "latest": None}
    parts = [snapshots.read(spark, path, revision).withColumn("revision", F.lit(label)) for label, revision in read.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "schema_check",
    f"WITH {q.EXAMPLES} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, "
        f"{'false' if c == 'tag' else 'true'} AS present, "
        f"{'0 * count(*)' if c == 'tag' else f'count({c})'} AS values_set FROM examples"
        for c in EXAMPLE_COLUMNS
    ),
)
def schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ds.schema_report(fx.examples(spark, sf_dir).drop("tag"))


@query(
    "clean_text",
    f"WITH {q.DIRTY} SELECT position, {q.clean('id')} AS id, {q.clean('prompt')} AS prompt, "
    f"{q.clean('tag')} AS tag FROM dirty",
)
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = [tx.clean_text(F.col(c)).alias(c) for c in ("id", "prompt", "tag")]
    return fx.dirty_examples(spark, sf_dir).select("position", *cleaned)


@query(
    "clean_float",
    f"WITH {q.DIRTY} SELECT position, {q.number('reconstruction_id_if_redacted')} AS value FROM dirty",
)
def clean_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = tx.clean_float(F.col("reconstruction_id_if_redacted"))
    return fx.dirty_examples(spark, sf_dir).select("position", value.alias("value"))


@query("normalize_rows", f"WITH {q.DIRTY} {q.normalized('dirty', text_number=True)}")
def normalize_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ds.normalize_examples(fx.dirty_examples(spark, sf_dir), keep=["position"])


@query(
    "metadata_projection",
    f"WITH {q.EXAMPLES} SELECT {', '.join(c for c in EXAMPLE_COLUMNS if c not in ('prompt', 'response'))} "
    "FROM examples",
)
def metadata_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ds.metadata(fx.examples(spark, sf_dir))


@query(
    "prompt_hash",
    f"WITH {q.DIRTY} SELECT position, sha256({q.clean('prompt')}) AS prompt_sha256 FROM dirty",
)
def prompt_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = tx.clean_text(F.col("prompt"))
    return fx.dirty_examples(spark, sf_dir).select(
        "position", tx.prompt_hash(prompt).alias("prompt_sha256")
    )


@query("example_seed", f"SELECT doc_id, {q.seed(42, 'CAST(doc_id AS VARCHAR)')} AS seed FROM documents")
def example_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", tx.example_seed(42, F.col("doc_id").cast("string")).alias("seed")
    )


@query(
    "parse_response",
    f"""WITH {q.RAW}, parsed AS (SELECT example_id, raw, TRY_CAST(raw AS JSON) AS j FROM raw_responses)
    SELECT example_id, coalesce(
      CASE WHEN json_type(j) = 'VARCHAR' THEN j ->> '$' END,
      CASE WHEN json_type(j, '$.response') = 'VARCHAR' THEN j ->> '$.response' END,
      CASE WHEN json_type(j, '$.content') = 'VARCHAR' THEN j ->> '$.content' END,
      CASE WHEN json_type(j, '$.final_answer') = 'VARCHAR' THEN j ->> '$.final_answer' END,
      CASE WHEN json_type(j, '$.text') = 'VARCHAR' THEN j ->> '$.text' END, raw) AS response
    FROM parsed""",
)
def parse_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.raw_responses(spark, sf_dir).select("example_id", parse_response("raw").alias("response"))


@query(
    "scalar_config",
    """SELECT event_id, 'kind' AS key, '"' || event_type || '"' AS value FROM events
    UNION ALL SELECT event_id, 'value', CASE WHEN value > 100 THEN 'true' ELSE 'false' END FROM events
    UNION ALL SELECT event_id, 'absent', 'null' FROM events
    UNION ALL SELECT event_id, 'k', json_extract_string(props, '$.k') FROM events""",
)
def scalar_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.from_json("props", "k int")
    config = F.to_json(
        F.struct(
            F.col("event_type").alias("kind"),
            (F.col("value") > 100).alias("value"),
            F.lit(None).cast("string").alias("absent"),
            props["k"].alias("k"),
            props.alias("nested"),
            F.array(props["k"]).alias("listed"),
        ),
        {"ignoreNullFields": "false"},
    )
    rows = fx.table(spark, sf_dir, "events").select("event_id", config.alias("config"))
    return scalar_entries(rows, "config", ["event_id"])


def _count_words(frame):
    return frame[["doc_id"]].assign(words=frame["text"].str.count(" ") + 1)


@query(
    "mapped_rows",
    "SELECT doc_id, CAST(length(text) - length(replace(text, ' ', '')) + 1 AS BIGINT) AS words FROM documents",
)
def mapped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user-supplied Python function over whole texts."""
    texts = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    return ds.map_rows(texts, _count_words, "doc_id bigint, words bigint")


@query("filter_languages", "SELECT doc_id, lang AS language FROM documents WHERE lang IN ('en', 'de')")
def filter_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("language"))
    return ds.filter_examples(rows, {"language": ["en", "de"]})


@query(
    "filter_conjunction",
    f"""WITH {q.DIRTY} SELECT position, language, prompt_label, source FROM dirty
    WHERE language IN ('en', 'fr') AND prompt_label IN ('safe', 'unsafe')
      AND response_label IN ('good') AND source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5')""",
)
def filter_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ds.ManifestSpec(
        languages=["en", "fr"],
        prompt_labels=["safe", "unsafe"],
        response_labels="good",
        sources=[f"src{i}" for i in range(6)],
    )
    rows = ds.filter_examples(fx.dirty_examples(spark, sf_dir), spec.filters())
    return rows.select("position", "language", "prompt_label", "source")


@query(
    "filter_none_literal",
    f"""WITH {q.EXAMPLES} SELECT position, prompt_label FROM examples
    WHERE coalesce(prompt_label, 'None') IN ('None', 'unsafe') AND coalesce(tag, 'None') IN ('None')""",
)
def filter_none_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ds.ManifestSpec(prompt_labels=["None", "unsafe"], tags=["None"])
    rows = ds.filter_examples(fx.examples(spark, sf_dir), spec.filters())
    return rows.select("position", "prompt_label")


@query(
    "seeded_shuffle",
    f"""WITH {q.EXAMPLES} SELECT id, row_number() OVER (ORDER BY sha256('42:' || id), position) - 1
      AS row_index FROM examples""",
)
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.examples(spark, sf_dir).select("id", "position")
    return ds.seeded_shuffle(rows, SPEC).select("id", "row_index")


# Which row a drawn slot sends out is known at once: the one that took the slot last, so a row leaves
# when its slot is next drawn, and else with what is left at the end.
SHARDS, BUFFER = 8, 50
STREAMED = replace(SPEC, streaming=True, shuffle=True, shuffle_buffer=BUFFER, shards=("shard",))


def _wrapped(value: str) -> str:
    return f"(({value}) % 18446744073709551616::UHUGEINT)::UBIGINT"


def _draw(place: str) -> str:
    x = _wrapped(f"k::UHUGEINT + ({place})::UHUGEINT * {lazy.STEP}::UHUGEINT")
    for shift, factor in ((30, lazy.FACTOR_1), (27, lazy.FACTOR_2)):
        x = _wrapped(f"xor({x}, {x} >> {shift})::UHUGEINT * {factor}::UHUGEINT")
    return f"xor({x}, {x} >> 31)"


_STREAMED = f"""rows AS (SELECT doc_id, doc_id % {SHARDS} AS shard,
      row_number() OVER (PARTITION BY doc_id % {SHARDS} ORDER BY doc_id) - 1 AS t,
      count(*) OVER (PARTITION BY doc_id % {SHARDS}) AS n,
      ('0x' || substr(md5('42:' || (doc_id % {SHARDS})), 1, 15))::BIGINT AS k FROM documents),
    drawn AS (SELECT *, CASE WHEN t < {BUFFER} THEN t ELSE ({_draw('t')} % {BUFFER}::UBIGINT)::BIGINT END AS slot,
      {_draw(f't + {lazy.LEFT}')} AS last_draw FROM rows),
    sent AS (SELECT *, lead(t) OVER (PARTITION BY shard, slot ORDER BY t) AS t_out FROM drawn),
    placed AS (SELECT *, CASE WHEN t_out IS NOT NULL THEN t_out - {BUFFER} ELSE greatest(n - {BUFFER}, 0)
      + row_number() OVER (PARTITION BY shard, t_out IS NULL ORDER BY last_draw) - 1 END AS place FROM sent),
    streamed AS (SELECT doc_id, shard, place, row_number() OVER (ORDER BY k, place) - 1 AS row_index FROM placed)"""


def _sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples that lie in files of one shard each."""
    return fx.examples(spark, sf_dir).withColumn("shard", F.col("position") % SHARDS)


@query("buffered_shuffle", f"WITH {_STREAMED} SELECT doc_id AS position, shard, place, row_index FROM streamed")
def buffered_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sharded(spark, sf_dir).select("position", "shard")
    rows = rows.repartition(SHARDS, "shard").sortWithinPartitions("shard", "position")
    shuffled = lazy.buffered_shuffle(rows, ["shard"], seed=42, buffer=BUFFER)
    numbered = dense_index(shuffled, ["shuffle_shard", "shuffle_place"])
    return numbered.select("position", "shard", F.col("shuffle_place").alias("place"), "row_index")


@query(
    "manifest_streamed",
    f"""WITH {_STREAMED} SELECT CAST(d.doc_id AS VARCHAR) AS id, s.row_index, sha256(trim(d.text, {q.WS})) AS prompt_sha256
    FROM documents d JOIN streamed s ON d.doc_id = s.doc_id WHERE s.row_index < 300""",
)
def manifest_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of rows that were shuffled as they were read, its first 300."""
    spec = replace(STREAMED, max_samples=300)
    return ds.number_examples(_sharded(spark, sf_dir), spec).select("id", "row_index", "prompt_sha256")


@query("limit_ordered", f"WITH {q.EXAMPLES} SELECT id, language FROM examples ORDER BY position DESC LIMIT 100")
def limit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.examples(spark, sf_dir).select("id", "language", "position")
    return limit_ordered(rows, [F.desc("position")], 100).select("id", "language")


@query(
    "loader_view",
    f"""WITH {q.DIRTY}, kept AS (SELECT * FROM dirty WHERE language IN ('en', 'fr')),
    normal AS ({q.normalized('kept', text_number=True)})
    SELECT {COLUMNS} FROM normal ORDER BY position LIMIT 50""",
)
def loader_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ds.ManifestSpec(order_by=("position",), languages=["en", "fr"], max_samples=50)
    return ds.load_examples(fx.dirty_examples(spark, sf_dir), spec).select(*EXAMPLE_COLUMNS)


@query("dense_row_index", "SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS row_index FROM events")
def dense_row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "events").select("event_id", "value")
    return dense_index(rows, ["value", "event_id"]).select("event_id", "row_index")


@query("manifest", f"WITH {q.MANIFEST} SELECT {MANIFEST_COLUMNS} FROM manifest")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ds.build_manifest(fx.examples(spark, sf_dir), SPEC)


@query(
    "manifest_shuffled",
    f"""WITH {q.DIRTY}, kept AS (SELECT * FROM dirty WHERE language IN ('en', 'de', ' en ')),
    normal AS ({q.normalized('kept', text_number=True)}),
    placed AS (SELECT *, row_number() OVER (ORDER BY sha256('7:' || id), position) - 1 AS row_index FROM normal)
    SELECT {COLUMNS}, row_index, sha256(prompt) AS prompt_sha256 FROM placed WHERE row_index < 200""",
)
def manifest_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ds.ManifestSpec(
        order_by=("position",), languages=["en", "de", " en "], shuffle=True, seed=7, max_samples=200
    )
    return ds.number_examples(fx.dirty_examples(spark, sf_dir), spec)


@query("manifest_roundtrip", f"WITH {q.MANIFEST} SELECT {MANIFEST_COLUMNS}, count(*) OVER () AS rows_written FROM manifest")
def manifest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "inputs")
    written = jsonl.write_json(ds.number_examples(fx.examples(spark, sf_dir), SPEC), path)
    return tables.read_manifest(spark, path).withColumn("rows_written", F.lit(written).cast("bigint"))


@query(
    "manifest_metadata",
    f"""WITH {q.EXAMPLES}, kept AS (SELECT * FROM examples WHERE language IN ('en', 'fr')),
    normal AS ({q.normalized('kept')}),
    numbered AS (SELECT row_number() OVER (ORDER BY position) - 1 AS row_index, id, sha256(prompt) AS h FROM normal)
    SELECT 'documents' AS dataset_name, 'main' AS requested_revision, 'rev-1' AS resolved_revision,
      'train' AS split, false AS streaming,
      lower(to_hex(bit_xor(CAST('0x' || substr(sha256(row_index || ':' || id || ':' || h), 1, 15) AS BIGINT))))
        AS fingerprint,
      count(*) AS examples, 'inputs' AS manifest_path, 'en,fr' AS languages, 0 AS tags, false AS shuffle, 42 AS seed
    FROM numbered""",
)
def manifest_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ds.ManifestSpec("documents", order_by=("position",), languages=["en", "fr"])
    facts = ds.manifest_facts(ds.build_manifest(fx.examples(spark, sf_dir), spec))
    document = jsonl.write_document(
        spark, shared_path(spark, "dataset"), ds.describe_manifest(spec, facts, "inputs", "rev-1")
    )
    return document.select(
        "*",
        F.array_join("filters.languages", ",").alias("languages"),
        F.size("filters.tags").alias("tags"),
    ).drop("filters")


_VIOLATIONS = f"""{q.DIRTY}, normal AS ({q.normalized('dirty', text_number=True)}),
    numbered AS (SELECT *, row_number() OVER (ORDER BY position) - 1 AS row_index FROM normal),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_index) AS occurrence FROM numbered),
    found AS (
      SELECT row_index, id, 'empty_id' AS rule, 0 AS priority FROM ranked WHERE id = ''
      UNION ALL SELECT row_index, id, 'duplicate_id', 1 FROM ranked WHERE id <> '' AND occurrence > 1
      UNION ALL SELECT row_index, id, 'empty_prompt', 2 FROM ranked WHERE prompt = '')"""


@query("manifest_violations", f"WITH {_VIOLATIONS} SELECT row_index, id, rule, priority FROM found")
def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ds.violations(ds.number_examples(fx.dirty_examples(spark, sf_dir), SPEC))


@query(
    "first_violation",
    f"WITH {_VIOLATIONS} SELECT row_index, id, rule FROM found ORDER BY row_index, priority LIMIT 1",
)
def first_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = ds.number_examples(fx.dirty_examples(spark, sf_dir), SPEC)
    return ds.first_violation(ds.violations(numbered))


@query("batch_assign", f"WITH {q.MANIFEST} SELECT id, row_index, row_index // 16 AS batch_id FROM manifest")
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = ds.number_examples(fx.examples(spark, sf_dir), SPEC)
    return ds.assign_batches(numbered, 16).select("id", "row_index", "batch_id")


_ANSWERED_MANIFEST = f"""{q.ANSWERED}, normal AS ({q.normalized('answered')}), manifest AS (
      SELECT * EXCLUDE (position), row_number() OVER (ORDER BY position) - 1 AS row_index,
        sha256(prompt) AS prompt_sha256 FROM normal)"""


@query(
    "collate_batches",
    f"""WITH {_ANSWERED_MANIFEST}
    SELECT row_index // 4 AS batch_id, CAST(count(*) AS INTEGER) AS examples,
      string_agg(prompt, chr(1) ORDER BY row_index) AS prompts,
      string_agg(response, chr(1) ORDER BY row_index) AS reference_responses,
      string_agg(id || ':' || row_index || ':' || prompt_sha256, ',' ORDER BY row_index) AS metadata
    FROM manifest GROUP BY row_index // 4""",
)
def collate_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = ds.number_examples(fx.answered_examples(spark, sf_dir), SPEC)
    marks = F.transform(
        "metadata",
        lambda m: F.concat_ws(":", m["id"], m["row_index"].cast("string"), m["prompt_sha256"]),
    )
    return ds.collate(numbered, 4).select(
        "batch_id",
        F.size("prompts").alias("examples"),
        F.array_join("prompts", "\x01").alias("prompts"),
        F.array_join("reference_responses", "\x01").alias("reference_responses"),
        F.array_join(marks, ",").alias("metadata"),
    )


MICRO_WORDS = 120


def _micro_batches(rows: list[dict]) -> dict:
    """Rows share a micro-batch as long as their words stay within a budget; its padded size is what it costs."""
    words = [r["prompt"].count(" ") + 1 for r in rows]
    micro: list[int] = []
    number = used = 0
    for size in words:
        if used and used + size > MICRO_WORDS:
            number, used = number + 1, 0
        used += size
        micro.append(number)
    own = [[w for w, m in zip(words, micro, strict=True) if m == k] for k in range(number + 1)]
    return {"micro": micro, "words": words, "padded": sum(len(w) * max(w) for w in own)}


@query(
    "collate_custom",
    f"""WITH RECURSIVE {_ANSWERED_MANIFEST}, sized AS (
      SELECT row_index, length(prompt) - length(replace(prompt, ' ', '')) + 1 AS words FROM manifest),
    walk AS (SELECT row_index, words, 0 AS micro, words AS used FROM sized WHERE row_index % 16 = 0
      UNION ALL SELECT s.row_index, s.words, CASE WHEN w.used + s.words > {MICRO_WORDS} THEN w.micro + 1 ELSE w.micro END,
        CASE WHEN w.used + s.words > {MICRO_WORDS} THEN s.words ELSE w.used + s.words END
      FROM walk w JOIN sized s ON s.row_index = w.row_index + 1 AND s.row_index % 16 <> 0),
    costs AS (SELECT row_index // 16 AS batch_id, micro, count(*) * max(words) AS cost FROM walk GROUP BY ALL),
    totals AS (SELECT batch_id, CAST(sum(cost) AS BIGINT) AS padded FROM costs GROUP BY batch_id)
    SELECT row_index // 16 AS batch_id, string_agg(micro, ',' ORDER BY row_index) AS micro,
      string_agg(words, ',' ORDER BY row_index) AS words, any_value(padded) AS padded
    FROM walk JOIN totals ON totals.batch_id = row_index // 16 GROUP BY row_index // 16""",
)
def collate_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = ds.number_examples(fx.answered_examples(spark, sf_dir), SPEC).select("row_index", "prompt")
    schema = "micro array<int>, words array<int>, padded long"
    made = ds.collate_with(numbered, 16, _micro_batches, schema, per_row=("micro", "words"))
    return made.withColumns({c: F.array_join(c, ",") for c in ("micro", "words")})


@query(
    "max_batches_limit",
    f"""WITH {_ANSWERED_MANIFEST} SELECT row_index // 4 AS batch_id, id AS example_id, prompt,
      response AS reference_response FROM manifest WHERE row_index < 4 * 25""",
)
def max_batches_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = ds.number_examples(fx.answered_examples(spark, sf_dir), SPEC)
    batches = ds.collate(ds.first_batches(numbered, 4, 25), 4)
    return ds.iterate_examples(batches).select(
        "batch_id", F.col("metadata.id").alias("example_id"), "prompt", "reference_response"
    )


# Lines are objects, but for some that are blank, a list, a number or cut off.
_FORM = "(conv_id * 7 + turn) % 11"
_LINES = f"""{q.RAW}, lines AS (
      SELECT *, CASE WHEN {_FORM} = 1 THEN '[1, 2]' WHEN {_FORM} = 2 THEN '17'
        WHEN {_FORM} = 3 THEN '{{"response": ' WHEN {_FORM} = 0 THEN '  '
        WHEN turn % 4 = 3 THEN CAST(json_object('content', text) AS VARCHAR) ELSE raw END AS line
      FROM raw_responses)"""


def _write_lines(spark: SparkSession, sf_dir: str) -> str:
    number = F.regexp_extract("example_id", r"^(\d+)-", 1).cast("bigint")
    turn = F.regexp_extract("example_id", r"-(\d+)$", 1).cast("bigint")
    form = (number * 7 + turn) % 11
    line = (
        F.when(form == 1, "[1, 2]")
        .when(form == 2, "17")
        .when(form == 3, '{"response": ')
        .when(form == 0, "  ")
        .when(turn % 4 == 3, F.to_json(F.struct(F.col("raw").alias("content"))))
        .otherwise(F.col("raw"))
    )
    path = shared_path(spark, "lines")
    rows = fx.raw_responses(spark, sf_dir).select(number.alias("n"), turn.alias("t"), line.alias("value"))
    # One file per 64 conversations, in their order: the number of files follows the data.
    filed = rows.withColumn("file", F.floor(F.col("n") / 64)).repartition("file").sortWithinPartitions("file", "n", "t")
    filed.select("value", "file").write.partitionBy("file").text(path)
    return path


@query(
    "jsonl_strict",
    f"""WITH {_LINES} SELECT CASE WHEN json_type(line, '$.response') IN ('VARCHAR') THEN line ->> '$.response' END
        AS response, CASE WHEN json_type(line, '$.content') = 'VARCHAR' THEN line ->> '$.content' END AS content
      FROM lines WHERE {_FORM} NOT IN (0, 1, 2, 3) AND turn % 4 <> 1
      UNION ALL SELECT '5', text FROM lines WHERE {_FORM} NOT IN (0, 1, 2, 3) AND turn % 4 = 1""",
)
def jsonl_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _write_lines(spark, sf_dir)
    return jsonl.read_objects(spark, path, "response string, content string")


@query(
    "jsonl_rejects",
    f"""WITH {_LINES}, placed AS (SELECT *, CAST(conv_id // 64 AS BIGINT) AS file,
        row_number() OVER (PARTITION BY conv_id // 64 ORDER BY conv_id, turn) AS line_number FROM lines)
    SELECT file, line_number, CASE WHEN {_FORM} = 3 THEN 'broken' ELSE 'not_object' END AS reason, line
    FROM placed WHERE {_FORM} IN (1, 2, 3)""",
)
def jsonl_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.regexp_extract("path", r"file=(\d+)", 1).cast("bigint")
    found = jsonl.rejects(spark, _write_lines(spark, sf_dir))
    return found.select(file.alias("file"), "line_number", "reason", "line")
