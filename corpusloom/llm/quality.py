"""Quality rules as a short-circuit cascade, in Spark expressions only.

A rule is an expression that holds for documents to reject. On a bounded sample each rule's cost (the
time it takes over the sample beyond that of reading it) and its selectivity (the share that it rejects) are estimated; rules then
run by falling rejection per cost as branches of one CASE, so that a document pays for no rule after the
first that rejects it. The order never changes which documents are kept. ``judge`` runs base rules in the
cascade too; the query needs their counts of every document, so its cascade holds the method's own rules.

Defined results: null or empty text has no words and fails ``few_words``. Window repeats are found by
64-bit hashes and settled on the windows' own words. Repeated rows are judged alike; an empty table
gives an empty table and the given order.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, let, table, words, written

#: Rows, at most about, of the sample on which rules are costed.
SAMPLE_ROWS = 1000
#: Timed runs of a rule over the sample.
COST_RUNS = 2
WINDOW = 5
SYMBOLS = "#*$%&|<>"


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def n_symbols(text: Column) -> Column:
    """Characters of SYMBOLS; texts without any are seen by one search."""
    found = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.when(text.rlike(r"[#*$%&|<>]"), found).otherwise(F.lit(0)).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _equal_neighbours(rows: Column, same) -> Column:
    """Positions (field i) of the sorted structs that equal a neighbour."""
    last = F.size(rows) - 1
    hit = F.filter(F.sequence(F.lit(0), last), lambda k: ((k > 0) & same(F.get(rows, k), F.get(rows, k - 1))) | ((k < last) & same(F.get(rows, k), F.get(rows, k + 1))))
    return F.transform(hit, lambda k: F.get(rows, k)["i"])


def n_repeat_words(w: Column, n: int = WINDOW) -> Column:
    """Words in windows of n words that the text holds twice or more."""
    places = F.sequence(F.lit(0), F.size(w) - n)
    hashes = F.transform(places, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))

    def exact(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        near = let(by_hash, lambda s: _equal_neighbours(s, lambda a, b: a["h"] == b["h"]))
        by_words = let(near, lambda at: F.sort_array(F.transform(at, lambda i: F.struct(F.array_join(F.slice(w, i + 1, n), " ").alias("g"), i.alias("i")))))
        starts = let(by_words, lambda s: F.when(F.size(s) > 1, F.sort_array(_equal_neighbours(s, lambda a, b: a["g"] == b["g"]))).otherwise(F.expr("CAST(array() AS array<int>)")))
        return let(starts, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(p, k + 1) - x, F.lit(n)))), F.lit(0), lambda a, b: a + b))

    repeats = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact(h)))
    return F.when(F.size(w) > n, repeats).otherwise(F.lit(0)).cast("long")


#: A rule: from (words, text) to whether the document is rejected.
Rule = Callable[[Column, Column], Column]
BASE_RULES: dict[str, Rule] = {
    "few_words": lambda w, text: F.size(w) < 10,
    "repeats": lambda w, text: 100 * n_repeat_words(w) > 20 * F.size(w),
}
#: The method's own rules: shares that clean prose stays far from.
METHOD_RULES: dict[str, Rule] = {
    "symbols": lambda w, text: 10 * n_symbols(text) > F.size(w),
    "exclamations": lambda w, text: 2 * (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))) > F.size(w),
    "capitals": lambda w, text: 100 * F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")) > 45 * F.length(text),
    "same_lines": lambda w, text: let(lines_with_words(text), lambda x: 100 * n_dup_lines(x) > 40 * F.size(x)),
    "word_length": lambda w, text: let(F.length(F.array_join(w, "")), lambda c: (c < 2 * F.size(w)) | (c > 15 * F.size(w))),
}


def order_rules(docs: DataFrame, rules: dict[str, Rule], rows: int = SAMPLE_ROWS) -> dict[str, Rule]:
    """Rules by falling rejection per second over a sample of about ``rows`` rows of docs (text, w)."""
    total = docs.count()
    if not total:
        return rules
    sample = written(docs.sample(fraction=min(1.0, rows / total), seed=7), "quality-sample")

    def cost(*asked: Column) -> tuple[float, int]:
        """The least seconds of several runs over the sample, the first of which compiles, and the last count."""
        took = []
        for _ in range(COST_RUNS + 1):
            begun = time.perf_counter()
            got = sample.agg(F.count("w"), F.count("text"), *asked).collect()[0]
            took.append(time.perf_counter() - begun)
        return min(took[1:]), got[-1]

    idle, _ = cost()
    worth = {}
    for name, rejects in rules.items():
        seconds, rejected = cost(F.count_if(rejects(F.col("w"), F.col("text"))))
        worth[name] = rejected / max(1e-4, seconds - idle)
    discard(sample)
    return {name: rules[name] for name in sorted(rules, key=lambda n: (-worth[n], n))}


def failed_rule(rules: dict[str, Rule], w: Column, text: Column) -> Column:
    """Name of the first rule, in their order, that rejects; later ones aren't evaluated. Null if none does."""
    out = F.lit(None).cast("string")
    for name, rejects in reversed(rules.items()):
        out = F.when(rejects(w, text), F.lit(name)).otherwise(out)
    return out


def with_words(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, _text().alias("text"), words(F.col("text")).alias("w"))


def judge(docs: DataFrame, name: str = "failed_rule") -> DataFrame:
    """``docs`` with the first rule of the cascade, base rules included, that each row fails."""
    rules = order_rules(with_words(docs), BASE_RULES | METHOD_RULES)
    return docs.withColumn(name, let(F.struct(words(F.col("text")).alias("w"), _text().alias("t")), lambda x: failed_rule(rules, x["w"], x["t"])))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_words(table(spark, sf_dir, "documents"), "doc_id")
    w, text = F.col("w"), F.col("text")
    rules = order_rules(docs, METHOD_RULES)
    counted = docs.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": n_symbols(text),
            "n_dup_lines": let(lines_with_words(text), n_dup_lines),
            "n_repeat_words": n_repeat_words(w),
        }
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(failed_rule(rules, w, text).isNull())
    judged = counted.withColumn("base_failed", failed).withColumn("kept", kept)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT row, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT row, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), s AS (
  SELECT row, i FROM g QUALIFY count(*) OVER (PARTITION BY row, g) > 1
), r AS (
  SELECT row, CAST(sum(least(5, coalesce(n - i, 5))) AS BIGINT) AS n FROM (SELECT row, i, lead(i) OVER (PARTITION BY row ORDER BY i) AS n FROM s) GROUP BY row
), f AS (
  SELECT doc_id, text, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM d LEFT JOIN r USING (row)
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words OR 2 * (length(text) - length(replace(text, '!', ''))) > n_words
    OR 100 * length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) > 45 * length(text) OR 100 * n_dup_lines > 40 * n_lines
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM b
"""
