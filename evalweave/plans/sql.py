"""SQL fragments shared by the oracle queries; each is a common table expression of an adapter."""

from __future__ import annotations

from evalweave.functions.text import WHITESPACE
from evalweave.plans.fixtures import EXPERIMENT, MODELS, SPECIAL_EVERY
from evalweave.schemas import EXAMPLE_COLUMNS, FLOAT_COLUMN

WS = "(" + "||".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"
MODELS_SQL = "(VALUES " + ", ".join(f"('{m}')" for m in MODELS) + ") AS m(model_id)"


def strip(value: str) -> str:
    return f"trim({value}, {WS})"


def clean(value: str) -> str:
    return f"coalesce({strip(f'CAST({value} AS VARCHAR)')}, '')"


def number(value: str) -> str:
    text = strip(value)
    pattern = r"(?i)([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)(e[+-]?[0-9]+)?|[+-]?(inf|infinity))"
    return f"CASE WHEN regexp_full_match({text}, '{pattern}') THEN TRY_CAST({text} AS DOUBLE) END"


def seed(base: int, value: str) -> str:
    return (
        f"(CAST(('0x' || substr(sha256('{base}:' || {value}), 9, 8)) AS BIGINT) & 2147483647)"
    )


TEXTS = tuple(c for c in EXAMPLE_COLUMNS if c not in (FLOAT_COLUMN, "source"))

EXAMPLES = """examples AS (
  SELECT d.doc_id AS position, CAST(d.doc_id AS VARCHAR) AS id, d.text AS prompt,
    CAST(NULL AS VARCHAR) AS response,
    CASE l.toxic WHEN 1 THEN 'unsafe' WHEN 0 THEN 'safe' END AS prompt_label,
    CASE l.quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END AS response_label,
    CASE WHEN l.toxic = 1 THEN 'toxic' END AS violated_categories,
    CASE WHEN l.toxic IS NOT NULL THEN 'labels' END AS prompt_label_source,
    CAST(NULL AS VARCHAR) AS response_label_source, CAST(NULL AS VARCHAR) AS tag,
    d.lang AS language, CAST(NULL AS DOUBLE) AS reconstruction_id_if_redacted, d.source AS source
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

_PAD = "(CASE position % 5 WHEN 0 THEN '' WHEN 1 THEN chr(9) WHEN 2 THEN chr(160) WHEN 3 THEN chr(12288) ELSE chr(10) END)"
DIRTY = f"""{EXAMPLES}, dirty AS (
  SELECT position,
    CASE WHEN position % 97 = 96 THEN '' WHEN position % 101 = 100
      THEN CAST(position - 1 AS VARCHAR) ELSE id END AS id,
    CASE WHEN position % 89 = 88 THEN ' ' || chr(9) || ' ' ELSE {_PAD} || prompt || {_PAD} END AS prompt,
    response, prompt_label, response_label, violated_categories, prompt_label_source,
    response_label_source, tag,
    CASE WHEN position % 7 = 6 THEN ' ' || language || ' ' ELSE language END AS language,
    CASE position % 6 WHEN 0 THEN '1.5' WHEN 1 THEN ' 2 ' WHEN 2 THEN 'nan' WHEN 3 THEN 'inf'
      WHEN 4 THEN '1.5d' ELSE 'abc' END AS reconstruction_id_if_redacted, source
  FROM examples)"""


def normalized(source: str, *, text_number: bool = False) -> str:
    """Cleaned declared columns of ``source`` plus ``position``."""
    cols = ", ".join(f"{clean(c)} AS {c}" for c in TEXTS)
    value = number("reconstruction_id_if_redacted") if text_number else "reconstruction_id_if_redacted"
    return (
        f"SELECT position, {cols}, {value} AS reconstruction_id_if_redacted, "
        f"{clean('source')} AS source FROM {source}"
    )


ANSWERED = """answered AS (
  SELECT a.conv_id * 4294967296 + a.turn AS position,
    CAST(a.conv_id AS VARCHAR) || '-' || CAST(a.turn AS VARCHAR) AS id, a.text AS prompt,
    b.text AS response, CAST(NULL AS VARCHAR) AS prompt_label,
    CAST(NULL AS VARCHAR) AS response_label, CAST(NULL AS VARCHAR) AS violated_categories,
    CAST(NULL AS VARCHAR) AS prompt_label_source, CAST(NULL AS VARCHAR) AS response_label_source,
    CAST(NULL AS VARCHAR) AS tag, CAST(NULL AS VARCHAR) AS language,
    CAST(NULL AS DOUBLE) AS reconstruction_id_if_redacted, 'conversations' AS source
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant')"""

# Manifest of all documents, numbered by position.
MANIFEST = f"""{EXAMPLES}, normal AS ({normalized('examples')}), manifest AS (
  SELECT * EXCLUDE (position), row_number() OVER (ORDER BY position) - 1 AS row_index,
    sha256(prompt) AS prompt_sha256 FROM normal)"""

RUNS = f"""{MANIFEST}, runs AS (
  SELECT '{EXPERIMENT}' AS experiment_id,
    CASE WHEN contains(lower(m.model_id), 'diffusion') THEN 'diffusion' ELSE 'autoregressive' END AS model_kind,
    m.model_id, substr(sha256('{EXPERIMENT}:' || m.model_id || ':' || id), 1, 32) AS run_id,
    id AS example_id, {seed(42, 'id')} AS seed, manifest.* EXCLUDE (id)
  FROM manifest, {MODELS_SQL})"""

SCORES = """scores AS (
  SELECT CAST(label AS VARCHAR) AS run_id, vec_id,
    CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS token_step,
    CAST(vec_id % 64 AS INTEGER) AS selected_token_id, embedding FROM embeddings),
cells AS (
  SELECT * EXCLUDE (embedding), CAST(unnest(embedding) AS DOUBLE) AS v,
    CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i FROM scores),
norms AS (SELECT vec_id, max(v) AS top FROM cells GROUP BY vec_id),
lse AS (SELECT c.vec_id, any_value(n.top) + ln(sum(exp(c.v - n.top))) AS lse
  FROM cells c JOIN norms n ON c.vec_id = n.vec_id GROUP BY c.vec_id)"""

_GROUP = "(vec_id // 8)"
CANVAS_SCORES = f"""canvas AS (
  SELECT vec_id, CAST({_GROUP} // 8 AS VARCHAR) AS run_id, CAST({_GROUP} % 8 AS INTEGER) AS global_step,
    CAST({_GROUP} % 4 AS INTEGER) AS step_index, CAST(vec_id % 8 AS INTEGER) AS position,
    vec_id % 3 = 0 AS accepted FROM embeddings),
cells AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v,
    CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i FROM embeddings),
norms AS (SELECT vec_id, max(v) AS top FROM cells GROUP BY vec_id),
lse AS (SELECT c.vec_id, any_value(n.top) + ln(sum(exp(c.v - n.top))) AS lse
  FROM cells c JOIN norms n ON c.vec_id = n.vec_id GROUP BY c.vec_id),
ranked AS (SELECT c.vec_id, c.i, c.v, exp(c.v - l.lse) AS p, c.v - l.lse AS lp,
    row_number() OVER (PARTITION BY c.vec_id ORDER BY c.v DESC, c.i) AS rk
  FROM cells c JOIN lse l ON c.vec_id = l.vec_id)"""

ROUTER = f"""router AS (
  SELECT vec_id, label, CAST({_GROUP} // 16 AS VARCHAR) AS run_id,
    CAST(({_GROUP} % 16) // 4 AS INTEGER) AS step, CAST(({_GROUP} % 4) // 2 AS INTEGER) AS event_order,
    CAST((({_GROUP} % 16) // 4) % 2 AS INTEGER) AS step_index,
    CASE WHEN {_GROUP} % 8 < 2 THEN 'model.encoder.layers.' ELSE 'model.layers.' END
      || CAST({_GROUP} % 2 AS VARCHAR) || '.router' AS module_name,
    CAST({_GROUP} % 2 AS INTEGER) AS layer_index, CAST(vec_id % 8 AS INTEGER) AS token_index, embedding
  FROM embeddings)"""
EVENT = "run_id, step, event_order, module_name"
ROUTED = f"""{ROUTER},
raw_cells AS (SELECT * EXCLUDE (embedding), CAST(unnest(embedding) AS DOUBLE) AS s,
    CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS e FROM router),
soft AS (SELECT *, exp(s - max(s) OVER w) / sum(exp(s)) OVER w * exp(max(s) OVER w) AS p,
    row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, e) AS rk
  FROM raw_cells WINDOW w AS (PARTITION BY vec_id)),
token_measures AS (
  SELECT {EVENT}, layer_index, token_index, vec_id, -sum(ln(greatest(p, 1e-12)) * p) AS entropy,
    sum(CASE rk WHEN 1 THEN p WHEN 2 THEN -p ELSE 0 END) AS margin, count(*) AS experts
  FROM soft GROUP BY ALL),
chosen AS (SELECT {EVENT}, layer_index, token_index, e FROM soft WHERE rk <= 8),
event_measures AS (
  SELECT {EVENT}, count(*) AS tokens_routed, max(experts) AS experts, avg(entropy) AS entropy_mean,
    quantile_cont(entropy, 0.95) AS entropy_p95, avg(margin) AS margin_mean
  FROM token_measures GROUP BY {EVENT}),
counts AS (SELECT {EVENT}, e, count(*) AS n FROM chosen GROUP BY ALL),
bins AS (
  SELECT m.run_id, m.step, m.event_order, m.module_name, CAST(x.e AS INTEGER) AS expert_id, coalesce(c.n, 0) AS n,
    coalesce(c.n, 0) / (m.tokens_routed * 8) AS load
  FROM event_measures m CROSS JOIN range(0, 64) x(e)
  LEFT JOIN counts c ON c.run_id = m.run_id AND c.step = m.step AND c.event_order = m.event_order
    AND c.module_name = m.module_name AND c.e = x.e),
variation AS (SELECT {EVENT}, stddev_pop(load) / avg(load) AS cv FROM bins GROUP BY {EVENT})"""

CANVAS_PASSES = """passes AS (SELECT DISTINCT run_id, step, step_index FROM router),
placed AS (SELECT *, CAST(sum(CASE WHEN step_index = 0 THEN 1 ELSE 0 END)
    OVER (PARTITION BY run_id ORDER BY step) - 1 AS INTEGER) AS canvas_index FROM passes)"""

CHANGES = f"""{ROUTED}, {CANVAS_PASSES},
event_sizes AS (SELECT run_id, canvas_index, layer_index, step, event_order, count(*) AS tokens
  FROM router JOIN placed USING (run_id, step)
  WHERE NOT contains(module_name, '.encoder.') GROUP BY ALL),
linked AS (SELECT *, lag(step) OVER w AS before_step, lag(event_order) OVER w AS before_order,
    lag(tokens) OVER w AS before_tokens
  FROM event_sizes WINDOW w AS (PARTITION BY run_id, canvas_index, layer_index ORDER BY step, event_order)),
shared AS (
  SELECT l.run_id, l.layer_index, l.step, l.event_order, c.token_index, count(b.e) AS both_have
  FROM linked l JOIN chosen c ON c.run_id = l.run_id AND c.layer_index = l.layer_index AND c.step = l.step
    AND c.event_order = l.event_order
  LEFT JOIN chosen b ON b.run_id = l.run_id AND b.layer_index = l.layer_index
    AND b.step = l.before_step AND b.event_order = l.before_order AND b.token_index = c.token_index AND b.e = c.e
    AND NOT contains(b.module_name, '.encoder.')
  WHERE NOT contains(c.module_name, '.encoder.')
  GROUP BY ALL),
rates AS (
  SELECT l.run_id, l.canvas_index, l.layer_index, l.step, l.event_order,
    CASE WHEN any_value(l.before_tokens) = any_value(l.tokens)
      THEN 1 - avg(s.both_have / greatest(16 - s.both_have, 1)) END AS change_rate
  FROM linked l JOIN shared s USING (run_id, layer_index, step, event_order)
  GROUP BY ALL)"""


def contexts(runs: str, model: str) -> str:
    """The context of every run that the table ``runs`` names; needs nothing but the input tables."""
    texts = ("source", "language", "prompt_label", "response_label", "violated_categories", "tag")
    columns = ", ".join(f"coalesce(n.{c}, '') AS {c}" for c in texts)
    kind = "diffusion" if "diffusion" in model.lower() else "autoregressive"
    return f"""{EXAMPLES}, normal AS ({normalized('examples')}), contexts AS (
  SELECT 1 AS schema_version, '{EXPERIMENT}' AS experiment_id, '{kind}' AS model_kind, '{model}' AS model_id,
    CAST(NULL AS VARCHAR) AS model_revision, a.run_id, a.run_id AS example_id, CAST(a.run_id AS BIGINT) AS row_index,
    sha256(coalesce(n.prompt, '')) AS prompt_sha256, {columns}, {seed(42, 'a.run_id')} AS seed
  FROM (SELECT DISTINCT run_id FROM {runs}) a LEFT JOIN normal n ON n.id = a.run_id)"""


STEPS = """numbered AS (
  SELECT CAST(user_id AS VARCHAR) AS run_id, event_id, event_type, value,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS global_step
  FROM events),
started AS (
  SELECT *, max(CASE WHEN event_type = 'signup' THEN global_step END)
    OVER (PARTITION BY run_id ORDER BY global_step) AS start_step FROM numbered),
steps AS (
  SELECT run_id, global_step, event_id, event_type, value,
    CAST(coalesce(global_step - start_step, global_step + 1) AS INTEGER) AS step_index,
    [k, k % 10, CAST(floor(value) AS INTEGER) % 7, CAST(length(event_type) AS INTEGER)] AS canvas,
    [value > 5, value > 20, value > 50, value > 100] AS accepted_index,
    [(k + 1) % 100, k % 10, CAST(floor(value) AS INTEGER) % 5, CAST(length(event_type) AS INTEGER)] AS sampled_tokens,
    [5 / (5 + value), 20 / (20 + value), 50 / (50 + value), 100 / (100 + value)] AS sampled_probs
  FROM started)"""
CANVASES = f"""{STEPS}, indexed AS (
  SELECT *, CAST(sum(CASE WHEN step_index = 0 THEN 1 ELSE 0 END)
      OVER (PARTITION BY run_id ORDER BY global_step) - 1 AS INTEGER) AS canvas_index FROM steps),
looked AS (
  SELECT *, CASE WHEN step_index <> 0 THEN lag(canvas) OVER (PARTITION BY run_id ORDER BY global_step) END
    AS before FROM indexed),
changed AS (
  SELECT *, list_filter([0, 1, 2, 3], lambda x: before IS NULL OR canvas[x + 1] <> before[x + 1]) AS changed_positions,
    list_filter([0, 1, 2, 3], lambda x: accepted_index[x + 1]) AS accepted_positions FROM looked)"""

WORDS = f"""words AS (
  SELECT doc_id, unnest(string_split(text, ' ')) AS word,
    generate_subscripts(string_split(text, ' '), 1) - 1 AS at FROM documents),
vocab AS (
  SELECT CAST(row_number() OVER (ORDER BY word) - 1 AS INTEGER) AS token_id, word AS token_text,
    (row_number() OVER (ORDER BY word) - 1) % {SPECIAL_EVERY} = 0 AS is_special
  FROM (SELECT DISTINCT word FROM words)),
coded AS (SELECT CAST(w.doc_id AS VARCHAR) AS run_id, CAST(w.at AS INTEGER) AS token_step, v.token_id,
    v.token_text, v.is_special, w.doc_id
  FROM words w JOIN vocab v ON w.word = v.token_text)"""

RAW = """raw_responses AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS example_id, conv_id, turn, text,
    CAST(CASE turn % 4 WHEN 0 THEN CAST(json_object('response', text) AS VARCHAR)
      WHEN 1 THEN CAST(json_object('response', 5, 'content', text) AS VARCHAR)
      WHEN 2 THEN '{"text":null}' ELSE text END AS VARCHAR) AS raw
  FROM conversations)"""

STATUS = """status AS (
  SELECT 'run-' || CAST(user_id % 5 AS VARCHAR) AS model_run,
    CASE WHEN event_type = 'error' AND value > 300 THEN 'scheduler_trace'
      WHEN event_id % 3 = 0 THEN 'canvas' WHEN event_id % 3 = 1 THEN 'logits' ELSE 'moe' END AS component,
    event_id AS ord, event_type = 'error' AND value > 200 AS failed FROM events)"""


def ints(column: str) -> str:
    return f"array_to_string({column}, ',')"
