"""Corpus and contamination queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import contamination, corpus
from corpusloom.sources import readers

BLOCK = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{T.BLANK}]+|[{T.BLANK}]+$', '', 'g')"


def collapse_sql(x: str) -> str:
    return f"regexp_replace({strip_sql(x)}, '[{T.BLANK}]+', ' ', 'g')"


def key_sql(x: str) -> str:
    return f"substr(regexp_replace({collapse_sql(f'lower({x})')}, '[^a-z0-9 ]+', '', 'g'), 1, 1000)"


def grams_sql(source: str, n: int, columns: str = "") -> str:
    tokens = f"list_transform(regexp_extract_all(text, '{T.TOKEN}'), lambda x: lower(x))"
    return f"SELECT {columns} array_to_string(t[i:i + {n - 1}], ' ') AS g FROM (SELECT {columns} t, unnest(range(1, len(t) - {n - 2})) AS i FROM (SELECT *, {tokens} AS t FROM {source}))"


def _filtered(spark, d, **more):
    docs = table(spark, d, "documents")
    if more.get("int_score"):
        docs = docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return corpus.filter_texts(docs, **more)


def corpus_filter(spark, d):
    return _filtered(spark, d, min_chars=300).select("doc_id", F.length("text").alias("chars"), F.md5("text").alias("digest"))


def corpus_filter_scored(spark, d):
    return _filtered(spark, d, min_chars=300, int_score="quality", min_int_score=1).select("doc_id", "quality")


def corpus_first_n(spark, d):
    return _filtered(spark, d, min_chars=1000, max_docs=50).select("doc_id")


def corpus_limit_zero(spark, d):
    return _filtered(spark, d, max_docs=0).select("doc_id")


def corpus_truncate(spark, d):
    return _filtered(spark, d, max_chars=5000).select("doc_id", F.length("text").alias("chars"))


def corpus_shuffle(spark, d):
    return corpus.shuffle_positions(table(spark, d, "documents").select("doc_id"), "doc_id", 3)


def text_sample(spark, d):
    return corpus.text_sample(table(spark, d, "documents"), min_chars=300).select("doc_id", F.md5("text").alias("digest"))


def byte_tokens(spark, d):
    ids = corpus.tokenizer("byte")(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(F.array_join(ids.cast("array<string>"), ",")).alias("digest"))


def paragraph_split(spark, d):
    parts = readers.paragraphs(table(spark, d, "pages").select("page_id", F.replace("html", F.lit("<p"), F.lit("\n\n<p")).alias("text")))
    return parts.select("page_id", "pos", F.md5("text").alias("digest"))


def whitespace_normalize(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(T.collapse_blanks(F.col("text"))).alias("digest"), T.count_words(F.col("text")).cast("bigint").alias("n_words"))


def dedupe_first(spark, d):
    return corpus.dedupe_texts(table(spark, d, "documents")).select("doc_id")


def _blocks(spark, d):
    docs = _filtered(spark, d, min_chars=300).select("doc_id", "text")
    return corpus.pack_in_order(docs, BLOCK, ids=corpus.char_tokenizer(F.col("text")), size=F.length("text"), kind="tinyint")


def pack_blocks(spark, d):
    return _blocks(spark, d).select("block_id", corpus.block_sums(F.col("input_ids")).alias("s")).select("block_id", "s.*")


def pack_batches(spark, d):
    return corpus.batches(pack_blocks(spark, d), 8).groupBy("batch_id").agg(F.count("*").alias("blocks"), F.sum("id_sum").alias("id_sum"))


def pack_block_stats(spark, d):
    return pack_blocks(spark, d).agg(F.count("*").alias("blocks"), F.sum("id_sum").alias("id_sum"), F.sum("weighted_sum").alias("weighted_sum"))


def ngram_counts(spark, d):
    sides = ("documents", "benchmark")
    return contamination.ngram_counts(*(table(spark, d, t) for t in sides), sides)


def ngram_first_texts(spark, d):
    return contamination.distinct_ngrams(table(spark, d, "documents"), 5, order="doc_id", limit=20).agg(F.count("*").alias("n"))


def contamination_report(spark, d):
    return contamination.contamination_report(table(spark, d, "documents"), table(spark, d, "benchmark"))


def contamination_by_doc(spark, d):
    return contamination.contaminated_documents(table(spark, d, "documents"), table(spark, d, "benchmark"))


def json_strings(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.to_json(F.struct("role", F.struct("text", F.array(F.lit(" "), F.lit("end")).alias("tail")).alias("body"))).alias("j"))
    return readers.json_strings(rows, "j").groupBy("conv_id").agg(F.count("*").alias("strings"), F.sum(F.length("text")).alias("chars"))


_PACK = f"""
f AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND length(text) >= 300),
c AS (SELECT doc_id, list_append(list_transform(regexp_extract_all(text, '(?s).'), lambda x: unicode(x) % 31 + 1), 0) AS ids FROM f),
o AS (SELECT doc_id, ids, coalesce(sum(len(ids)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c),
u AS (SELECT start + unnest(range(0, len(ids))) AS p, unnest(ids) AS id FROM o),
b AS (SELECT CAST(p // {BLOCK} AS BIGINT) AS block_id, CAST(sum(id) AS BIGINT) AS id_sum, CAST(sum(id * (p % {BLOCK})) AS BIGINT) AS weighted_sum FROM u GROUP BY 1 HAVING count(*) = {BLOCK})
"""

QUERIES = {f.__name__: f for f in (corpus_filter, corpus_filter_scored, corpus_first_n, corpus_limit_zero, corpus_truncate, corpus_shuffle, text_sample, byte_tokens, paragraph_split, whitespace_normalize, dedupe_first, pack_blocks, pack_batches, pack_block_stats, ngram_counts, ngram_first_texts, contamination_report, contamination_by_doc, json_strings)}

SQL = {
    "corpus_filter": "SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, md5(text) AS digest FROM documents WHERE length(text) >= 300",
    "corpus_filter_scored": "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE length(text) >= 300 AND (quality IS NULL OR quality >= 1)",
    "corpus_first_n": "SELECT doc_id FROM documents WHERE length(text) >= 1000 ORDER BY doc_id LIMIT 50",
    "corpus_limit_zero": "SELECT doc_id FROM documents WHERE length(text) >= 1 ORDER BY doc_id LIMIT 1",
    "corpus_truncate": "SELECT doc_id, CAST(length(substr(text, 1, 5000)) AS INTEGER) AS chars FROM documents WHERE length(text) >= 1",
    "corpus_shuffle": "SELECT doc_id, row_number() OVER (ORDER BY CAST('0x' || substr(md5(doc_id || ':3'), 1, 15) AS BIGINT)) - 1 AS position FROM documents",
    "text_sample": f"SELECT doc_id, md5({collapse_sql('text')}) AS digest FROM documents WHERE length(text) >= 300 AND {collapse_sql('text')} <> ''",
    "byte_tokens": """SELECT conv_id, turn, md5(array_to_string(list_transform(range(0, strlen(text)), lambda i: CAST('0x' || substr(hex(encode(text)), 2 * i + 1, 2) AS INT) + 1), ',')) AS digest FROM conversations""",
    "paragraph_split": f"""WITH p AS (SELECT page_id, string_split(replace(html, '<p', chr(10) || chr(10) || '<p'), chr(10) || chr(10)) AS s FROM pages),
u AS (SELECT page_id, CAST(unnest(range(0, len(s))) AS INTEGER) AS pos, {strip_sql("unnest(s)")} AS t FROM p)
SELECT page_id, pos, md5(t) AS digest FROM u WHERE t <> ''""",
    "whitespace_normalize": f"SELECT doc_id, md5({collapse_sql('text')}) AS digest, CAST(len(regexp_extract_all(text, '[^{T.BLANK}]+')) AS BIGINT) AS n_words FROM documents",
    "dedupe_first": f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {key_sql('text')}",
    "pack_blocks": f"WITH {_PACK} SELECT * FROM b",
    "pack_batches": f"WITH {_PACK} SELECT block_id // 8 AS batch_id, count(*) AS blocks, CAST(sum(id_sum) AS BIGINT) AS id_sum FROM b GROUP BY 1",
    "pack_block_stats": f"WITH {_PACK} SELECT count(*) AS blocks, CAST(sum(id_sum) AS BIGINT) AS id_sum, CAST(sum(weighted_sum) AS BIGINT) AS weighted_sum FROM b",
    "ngram_counts": " UNION ALL ".join(f"SELECT '{t}' AS side, count(DISTINCT g) AS n FROM ({grams_sql(t, 13)})" for t in ("documents", "benchmark")),
    "ngram_first_texts": f"SELECT count(DISTINCT g) AS n FROM ({grams_sql('(SELECT * FROM documents ORDER BY doc_id LIMIT 20)', 5)})",
    "contamination_report": f"""WITH t AS (SELECT DISTINCT g FROM ({grams_sql("documents", 13)})), b AS (SELECT DISTINCT g FROM ({grams_sql("benchmark", 13)})),
n AS (SELECT (SELECT count(*) FROM t) AS train_ngrams, (SELECT count(*) FROM b) AS benchmark_ngrams, (SELECT count(*) FROM t JOIN b USING (g)) AS overlap_ngrams)
SELECT *, overlap_ngrams / greatest(1, benchmark_ngrams) AS overlap_rate,
  CASE WHEN overlap_ngrams / greatest(1, benchmark_ngrams) <= {contamination.THRESHOLD} THEN 'pass' ELSE 'fail' END AS status FROM n""",
    "contamination_by_doc": f"""WITH b AS (SELECT DISTINCT g FROM ({grams_sql("benchmark", 13)}))
SELECT doc_id, count(DISTINCT g) AS hits FROM ({grams_sql("documents", 13, "doc_id,")}) JOIN b USING (g) GROUP BY doc_id""",
    "json_strings": f"""SELECT conv_id, CAST(sum(CASE WHEN {strip_sql("role")} <> '' THEN 1 ELSE 0 END + CASE WHEN {strip_sql("text")} <> '' THEN 1 ELSE 0 END + 1) AS BIGINT) AS strings,
  CAST(sum(length(role) + CASE WHEN {strip_sql("text")} <> '' THEN length(text) ELSE 0 END + 3) AS BIGINT) AS chars FROM conversations GROUP BY conv_id""",
}
