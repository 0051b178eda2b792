"""Chat curation and training-sample queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chat
from corpusloom.plans.corpus_queries import key_sql, strip_sql, table

#: Bands at which the filters, caps and fills all have work on the test tables.
BAND = dict(min_response=200, max_response=1500, max_example=6000)
CAP, TARGET, BLOCK, SYSTEM = 10, 60, 700, "You are a helpful, concise assistant."


def _rows(spark, d):
    return chat.gather_messages(table(spark, d, "conversations"))


def chat_standardize(spark, d):
    made = chat.standardize(_rows(spark, d))
    return made.select("conv_id", F.size("messages").cast("bigint").alias("n_messages"), F.array_join(F.transform("messages", lambda x: x["role"]), ",").alias("roles"))


def chat_prompt_response(spark, d):
    made = chat.prompt_and_response(chat.standardize(_rows(spark, d)))
    return made.select("conv_id", F.md5("prompt").alias("prompt"), F.md5("response").alias("response"), chat.json_length(F.col("messages")).cast("bigint").alias("json_chars"))


def _candidates(spark, d):
    return chat.candidates(_rows(spark, d), **BAND)


def chat_candidates(spark, d):
    return _candidates(spark, d).select("conv_id", "score", "category", F.col("response_chars").cast("bigint").alias("response_chars"))


def chat_source_limit(spark, d):
    return chat.candidates(_rows(spark, d), source_limit=12).select("conv_id")


def select_longest(spark, d):
    return chat.select_longest(_candidates(spark, d), TARGET).select("conv_id", "score")


def select_quality(spark, d):
    return chat.select_quality(_candidates(spark, d), TARGET, CAP).select("conv_id", "category")


def select_mixed(spark, d):
    return chat.select_mixed(_candidates(spark, d), TARGET).select("conv_id", "category")


def select_summary(spark, d):
    got = chat.summarize(chat.select_quality(_candidates(spark, d), TARGET, CAP))
    names = F.array_join(F.transform(F.map_entries("categories"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return got.select("size", "mean_score", "mean_response_chars", names.alias("categories"))


def repetition_penalty(spark, d):
    return table(spark, d, "documents").select("doc_id", T.repetition_penalty(F.col("text")).alias("penalty"))


def quality_score(spark, d):
    return table(spark, d, "documents").select("doc_id", T.round4(T.quality_score(F.lit("a b c"), F.col("text"))).alias("score"), T.category(F.lit(""), F.col("text")).alias("category"))


def _samples(spark, d):
    return chat.render_sample(_rows(spark, d), SYSTEM).where(F.col("sample").isNotNull())


def sft_render(spark, d):
    return _samples(spark, d).select("conv_id", F.md5("sample.prompt").alias("prompt"), F.md5("sample.response").alias("response"))


def sft_instructions(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.substring("text", 1, 40).alias("instruction"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("input"), F.expr("substring(text, 41)").alias("output"))
    return chat.render_sample(rows).where(F.col("sample").isNotNull()).select("doc_id", F.md5("sample.prompt").alias("prompt"), F.length("sample.response").alias("chars"))


def sft_encode(spark, d):
    joined = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), ","))
    return chat.encode_sample(_samples(spark, d), BLOCK).select("conv_id", joined("input_ids").alias("input_ids"), joined("labels").alias("labels"), joined("attention_mask").alias("attention_mask"))


def sft_supervised_tokens(spark, d):
    made = chat.encode_sample(_samples(spark, d), BLOCK)
    return made.agg(F.count("*").alias("samples"), F.sum(chat.supervised_tokens(F.col("labels"))).alias("tokens"))


def sft_dataset(spark, d):
    made = chat.sample_dataset(_rows(spark, d), BLOCK, system=SYSTEM, max_chars=3000, max_examples=25)
    return made.select("conv_id", chat.supervised_tokens(F.col("labels")).cast("bigint").alias("tokens"))


def train_eval_split(spark, d):
    rows = _candidates(spark, d).select("conv_id", "score", "category", "response_chars")
    return chat.train_and_eval(rows, rows, 6, 4).select("conv_id", "split", "leaked")


def round4_sql(source: str, x: str, name: str) -> str:
    """``source`` with ``name``, the correctly rounded ``x``; ties go by the product's error, then to even."""
    return f"""SELECT * EXCLUDE (_p, _h, _x), (floor(_p) + CASE WHEN _p - floor(_p) > 0.5 THEN 1 WHEN _p - floor(_p) < 0.5 THEN 0
  WHEN (_h * 1e4 - _p) + (_x - _h) * 1e4 > 0 THEN 1 WHEN (_h * 1e4 - _p) + (_x - _h) * 1e4 < 0 THEN 0 ELSE abs(floor(_p)) % 2 END) / 1e4 AS {name}
FROM (SELECT *, {x} AS _x, {x} * 1e4 AS _p, 134217729e0 * {x} - (134217729e0 * {x} - {x}) AS _h FROM {source})"""


def _penalty_sql(x: str) -> str:
    words, lines = f"regexp_extract_all(lower({x}), '[a-z0-9'']+')", f"regexp_split_to_array({x}, '{T.LINE_END}')"
    n_lines = f"(CASE WHEN {x} = '' THEN 0 ELSE len({lines}) - CASE WHEN {lines}[-1] = '' THEN 1 ELSE 0 END END)"
    distinct = f"len(list_distinct(list_filter(list_transform({lines}, lambda v: lower({strip_sql('v')})), lambda v: v <> '')))"
    few = f"greatest(0e0, 0.45e0 - len(list_distinct({words})) / greatest(1, len({words}))::DOUBLE) * 2e0"
    return f"(CASE WHEN len({words}) < 20 THEN 0e0 ELSE {few} + least(0.6e0, ({n_lines} - {distinct}) * 0.1e0) END)"


def _count_sql(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^{T.BLANK}]+'))"


def _score_sql(p: str, r: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    marked = " OR ".join(f"contains({r}, {quote(m)})" for m in (":", "```", "\n1.", "\n-"))
    bad = " + ".join(f"(CASE WHEN contains(lower({r}), {quote(b)}) THEN 1e0 ELSE 0e0 END)" for b in T.BAD_PHRASES)
    refused = " OR ".join(f"starts_with(lower({r}), {quote(b)})" for b in T.REFUSALS)
    size = f"(least(3e0, length({r}) / 350e0) - CASE WHEN length({r}) > 1400 THEN least(1.5e0, (length({r}) - 1400e0) / 1600e0) ELSE 0e0 END)"
    structure = f"(CASE WHEN {marked} THEN 0.35e0 ELSE 0e0 END + CASE WHEN length({r}) - length(translate({r}, '.?!', '')) >= 2 THEN 0.25e0 ELSE 0e0 END)"
    return f"""(CASE WHEN length({r}) = 0 THEN -100e0 ELSE {size} + {structure} + least(1e0, {_count_sql(p)} / 30e0) - ({bad})
  - (CASE WHEN {refused} THEN 0.25e0 ELSE 0e0 END) - {_penalty_sql(r)} - (CASE WHEN {_count_sql(r)} < 20 THEN 2e0 ELSE 0e0 END) END)"""


def _category_sql(p: str, r: str) -> str:
    seen = f"lower({p} || chr(10) || substr({r}, 1, 500))"
    counts = {c: "(" + " + ".join(f"contains({seen}, '{k}')::INT" for k in keys.split(",")) + ")" for c, keys in T.KEYWORDS.items()}
    most = f"greatest({', '.join(counts.values())})"
    whens = " ".join(f"WHEN {n} = {most} THEN '{c}'" for c, n in counts.items())
    return f"(CASE WHEN {most} = 0 THEN '{T.GENERAL}' {whens} END)"


_STANDARD = f"""
m AS (SELECT conv_id, list_filter(list(struct_pack(role := lower({strip_sql("coalesce(role, '')")}), content := {strip_sql("coalesce(text, '')")}) ORDER BY turn),
  lambda x: x.role IN ('system', 'user', 'assistant') AND x.content <> '') AS m FROM conversations GROUP BY conv_id),
l AS (SELECT *, list_max(list_filter(list_transform(m, lambda x, i: CASE WHEN x.role = 'assistant' THEN i END), lambda v: v IS NOT NULL)) AS n FROM m),
s AS (SELECT conv_id, m[1:n] AS m, array_to_string(list_transform(m[1:n - 1], lambda x: x.content), chr(10)) AS p, m[n].content AS r
  FROM l WHERE n IS NOT NULL AND len(list_filter(m[1:n - 1], lambda x: x.role = 'user')) > 0),
j AS (SELECT *, length(CAST(to_json(struct_pack(messages := m)) AS VARCHAR)) + 4 * len(m) AS json_chars FROM s)
"""


def _candidates_sql(low: int, high: int, size: int, extra: str = "") -> str:
    return f"""{_STANDARD},
k AS (SELECT * FROM j WHERE length(r) BETWEEN {low} AND {high} AND json_chars <= {size} {extra} QUALIFY row_number() OVER (PARTITION BY {key_sql("p")} ORDER BY conv_id) = 1),
q AS (SELECT conv_id, CAST(length(r) AS BIGINT) AS response_chars, {_category_sql("p", "r")} AS category, {_score_sql("p", "r")} AS raw FROM k),
c AS (SELECT * EXCLUDE (raw) FROM ({round4_sql("q", "raw", "score")}))"""


_CANDIDATES = _candidates_sql(BAND["min_response"], BAND["max_response"], BAND["max_example"])
_ORDER = "score DESC, response_chars DESC, conv_id"
_RANKED = f"SELECT *, row_number() OVER (PARTITION BY category ORDER BY {_ORDER}) AS k FROM c"
_QUALITY = f"SELECT * FROM ({_RANKED}) ORDER BY k > {CAP}, {_ORDER} LIMIT {TARGET}"
_MIXED = " ".join(f"WHEN category = '{c}' AND k <= {n} THEN {i}" for i, (c, n) in enumerate(chat.quotas(TARGET).items()))

_RENDER = f"""
m AS (SELECT conv_id, list_filter(list(struct_pack(role := lower({strip_sql("coalesce(role, '')")}), content := {strip_sql("coalesce(text, '')")}) ORDER BY turn),
  lambda x: x.role <> '' AND x.content <> '') AS m FROM conversations GROUP BY conv_id),
l AS (SELECT *, list_max(list_filter(list_transform(m, lambda x, i: CASE WHEN x.role = 'assistant' THEN i END), lambda v: v IS NOT NULL)) AS n FROM m),
s AS (SELECT conv_id, '### System:' || chr(10) || '{SYSTEM}' || chr(10) || chr(10) || array_to_string(list_transform(m[1:n - 1], lambda x: CASE x.role
    WHEN 'system' THEN '### System:' || chr(10) || x.content || chr(10) || chr(10) WHEN 'user' THEN '### Instruction:' || chr(10) || x.content || chr(10) || chr(10)
    WHEN 'assistant' THEN '### Response:' || chr(10) || x.content || chr(10) || chr(10) ELSE '' END), '') || '### Response:' || chr(10) AS p, m[n].content AS r
  FROM l WHERE n IS NOT NULL),
t AS (SELECT conv_id, list_transform(regexp_extract_all(p, '(?s).'), lambda x: CAST(unicode(x) % 31 + 1 AS INT)) AS p,
  list_append(list_transform(regexp_extract_all(r, '(?s).'), lambda x: CAST(unicode(x) % 31 + 1 AS INT)), 0) AS r FROM s),
e AS (SELECT conv_id, list_concat(p, r)[1:{BLOCK}] AS i, list_concat(list_transform(p, lambda x: -100), r)[1:{BLOCK}] AS l FROM t),
f AS (SELECT *, {BLOCK} - len(i) AS pad FROM e WHERE len(list_filter(l, lambda x: x <> -100)) > 0)
"""


def _padded(x: str, fill: str) -> str:
    return f"md5(array_to_string(list_concat({x}, list_transform(range(0, pad), lambda k: {fill})), ','))"


QUERIES = {f.__name__: f for f in (chat_standardize, chat_prompt_response, chat_candidates, chat_source_limit, select_longest, select_quality, select_mixed, select_summary, repetition_penalty, quality_score, sft_render, sft_instructions, sft_encode, sft_supervised_tokens, sft_dataset, train_eval_split)}

SQL = {
    "chat_standardize": f"WITH {_STANDARD} SELECT conv_id, len(m) AS n_messages, array_to_string(list_transform(m, lambda x: x.role), ',') AS roles FROM s",
    "chat_prompt_response": f"WITH {_STANDARD} SELECT conv_id, md5(p) AS prompt, md5(r) AS response, CAST(json_chars AS BIGINT) AS json_chars FROM j",
    "chat_candidates": f"WITH {_CANDIDATES} SELECT conv_id, score, category, response_chars FROM c",
    "chat_source_limit": f"WITH {_candidates_sql(80, 3000, 12000, 'AND conv_id IN (SELECT DISTINCT conv_id FROM conversations ORDER BY conv_id LIMIT 12)')} SELECT conv_id FROM c",
    "select_longest": f"WITH {_CANDIDATES} SELECT conv_id, score FROM c ORDER BY response_chars DESC, score DESC, conv_id LIMIT {TARGET}",
    "select_quality": f"WITH {_CANDIDATES} SELECT conv_id, category FROM ({_QUALITY})",
    "select_mixed": f"WITH {_CANDIDATES} SELECT conv_id, category FROM ({_RANKED}) ORDER BY CASE {_MIXED} ELSE 99 END, {_ORDER} LIMIT {TARGET}",
    "select_summary": f"""WITH {_CANDIDATES}, z AS ({_QUALITY}), n AS (SELECT category, count(*) AS n FROM z GROUP BY category)
SELECT count(*) AS size, round(sum(score) / greatest(1, count(*)), 4) AS mean_score, round(sum(response_chars) / greatest(1, count(*)), 1) AS mean_response_chars,
  (SELECT string_agg(category || '=' || n, ',' ORDER BY category) FROM n) AS categories FROM z""",
    "repetition_penalty": f"SELECT doc_id, {_penalty_sql('text')} AS penalty FROM documents",
    "quality_score": f"WITH q AS (SELECT doc_id, {_score_sql(chr(39) + 'a b c' + chr(39), 'text')} AS raw, {_category_sql(chr(39) * 2, 'text')} AS category FROM documents) SELECT doc_id, score, category FROM ({round4_sql('q', 'raw', 'score')})",
    "sft_render": f"WITH {_RENDER} SELECT conv_id, md5(p) AS prompt, md5(r) AS response FROM s",
    "sft_instructions": f"""WITH x AS (SELECT doc_id, {strip_sql("substr(text, 1, 40)")} AS a, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS b, {strip_sql("substr(text, 41)")} AS c FROM documents)
SELECT doc_id, md5('### Instruction:' || chr(10) || a || chr(10) || chr(10) || CASE WHEN b <> '' THEN '### Input:' || chr(10) || b || chr(10) || chr(10) ELSE '' END || '### Response:' || chr(10)) AS prompt,
  CAST(length(c) AS INTEGER) AS chars FROM x WHERE a <> '' AND c <> ''""",
    "sft_dataset": f"""WITH {_RENDER}, w AS (SELECT conv_id FROM (SELECT conv_id, list(struct_pack(role := role, content := text) ORDER BY turn) AS m FROM conversations GROUP BY conv_id)
  WHERE length(CAST(to_json(struct_pack(messages := m)) AS VARCHAR)) + 4 * len(m) <= 3000)
SELECT conv_id, CAST(len(list_filter(l, lambda x: x <> -100)) AS BIGINT) AS tokens FROM f SEMI JOIN w USING (conv_id) ORDER BY conv_id LIMIT 25""",
    "train_eval_split": f"""WITH {_CANDIDATES}, t AS (SELECT conv_id FROM ({_RANKED}) ORDER BY k > 200, {_ORDER} LIMIT 6), e AS (SELECT conv_id FROM ({_RANKED}) ORDER BY k > 80, {_ORDER} LIMIT 4)
SELECT conv_id, 'train' AS split, FALSE AS leaked FROM t UNION ALL SELECT conv_id, 'eval', conv_id IN (SELECT conv_id FROM t) FROM e""",
    "sft_encode": f"WITH {_RENDER} SELECT conv_id, {_padded('i', '0')} AS input_ids, {_padded('l', '-100')} AS labels, {_padded('list_transform(i, lambda x: 1)', '0')} AS attention_mask FROM f",
    "sft_supervised_tokens": f"WITH {_RENDER} SELECT count(*) AS samples, CAST(sum(len(list_filter(l, lambda x: x <> -100))) AS BIGINT) AS tokens FROM f",
}
