"""License scan: phrases, and an exact set-similarity join of text blocks with license templates.

A block is a sentence, whatever single line ends are in it; blank lines part blocks too. A template is a set
of words; its text has to be one block by itself. The vocabulary of all templates is ordered by document
frequency over the whole corpus, rarest first. A block can only reach a template's threshold (the share of
the template's words that it contains) if it meets one of the template's first ``size - need + 1`` words
(prefix filter), has ``need`` words of the vocabulary (length filter), and if,
from the meeting word on, both sides have words enough left (positional filter). What passes is verified
on the whole sets. Only the templates, a constant of this module or the caller's list, are broadcast.

Defined results: null text counts as empty and has no words, labels or places and score 0; the score is
the highest containment that met the threshold, 1 where a phrase stands; repeated rows repeat their
result; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import ascii_lower, table, written

WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_BREAK = r"\n[\x20\x09-\x0D]*\n|[.!?][\x20\x09-\x0D]"
#: A full stop that ends no sentence: before a number, or after a lone letter. It is taken out before texts are cut into blocks.
INNER_STOP = r"\.([\x00-\x2F\x3A-\x60\x7B-\x7F]+[0-9])", r"([\x00-\x2F\x3A-\x60\x7B-\x7F][a-z])\.([\x20\x09-\x0D])"
THRESHOLD = 0.9
PHRASES = {"cc-by": ("cc", "by"), "gpl": ("general", "public", "license"), "reserved": ("all", "rights", "reserved")}
#: (label, text); a label may have several templates.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)


def template_words(text: str) -> list[str]:
    return sorted({w for w in re.split(WORD_BREAK, text.lower()) if w})


def words_of(lowered: Column) -> Column:
    return F.array_remove(F.split(lowered, WORD_BREAK), "")


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents that hold each word of the vocabulary; as many rows as it has words, at most."""
    held = F.array_intersect(words_of(ascii_lower(F.coalesce("text", F.lit("")))), F.lit(vocabulary))
    return {r[0]: r[1] for r in docs.select(F.explode(held).alias("word")).groupBy("word").count().collect()}


def _places(w: Column, phrase: tuple[str, ...]) -> Column:
    """Starts of the phrase; its words are looked at only where the joined words hold it."""
    joined = F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    at = lambda i: [F.get(w, i + k) == p for k, p in enumerate(phrase)]

    def whole(i: Column) -> Column:
        out, *more = at(i)
        for other in more:
            out = out & other
        return F.coalesce(out, F.lit(False))

    starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), whole)
    return F.when(joined.contains(f" {' '.join(phrase)} "), starts).otherwise(F.expr("CAST(array() AS array<int>)"))


def scan(docs: DataFrame, key: str = "doc_id", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score); labels are arrays here."""
    spark = docs.sparkSession
    docs = docs.select(key, "text")
    sets = [(label, template_words(text)) for label, text in templates]
    counts = document_frequencies(docs, sorted({w for _, s in sets for w in s}))
    order = sorted({w for _, s in sets for w in s}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    prefixes, whole = [], []
    for n, (label, s) in enumerate(sets):
        s = sorted(s, key=rank.__getitem__)
        need = math.ceil(threshold * len(s) - 1e-9)
        prefixes += [(w, n, i, len(s), need) for i, w in enumerate(s[: len(s) - need + 1])]
        whole.append((n, label, s, need))
    rare = sorted({p[0] for p in prefixes})

    low = docs.select(key, ascii_lower(F.coalesce("text", F.lit(""))).alias("t"))
    held = low.select(key, "t", words_of(F.col("t")).alias("w"))
    w = F.col("w")
    joined = F.regexp_replace(F.regexp_replace("t", INNER_STOP[0], " $1"), INNER_STOP[1], "$1 $2")
    blocks = F.transform(F.split(joined, BLOCK_BREAK), lambda b: F.array_distinct(words_of(b)))
    met = F.filter(blocks, lambda b: F.arrays_overlap(b, F.lit(rare)))
    found = held.select(
        F.monotonically_increasing_id().alias("_uid"),
        key,
        F.size(w).cast("long").alias("n_words"),
        *(_places(w, p).alias(f"_p{i}") for i, p in enumerate(PHRASES.values())),
        F.when(F.arrays_overlap(w, F.lit(rare)), met).alias("_blocks"),
    )
    found = written(found, "license-blocks")

    ordered = F.array_intersect(F.lit(order), F.col("b"))
    block = found.select("_uid", F.posexplode("_blocks").alias("_bid", "b")).select("_uid", "_bid", "b", ordered.alias("o"))
    token = block.select("_uid", "_bid", "b", F.size("o").alias("n"), F.posexplode("o").alias("j", "word"))
    index = spark.createDataFrame(prefixes, "word string, template int, i int, size int, need int")
    met = token.join(F.broadcast(index), "word").where((F.col("n") >= F.col("need")) & (1 + F.least(F.col("size") - F.col("i"), F.col("n") - F.col("j")) - 1 >= F.col("need")))
    full = spark.createDataFrame(whole, "template int, label string, t array<string>, need int").select("template", "label", "t", F.col("need").alias("least"))
    checked = met.join(F.broadcast(full), "template").withColumn("common", F.size(F.array_intersect("b", "t"))).where(F.col("common") >= F.col("least"))
    labels = checked.groupBy("_uid").agg(F.collect_set("label").alias("_more"), F.max(F.col("common") / F.size("t")).alias("_best"))

    places = F.concat(*(F.col(f"_p{i}") for i in range(len(PHRASES))))
    base = F.array_compact(F.array(*(F.when(F.size(f"_p{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES))))
    out = found.drop("_blocks").join(labels, "_uid", "left")
    return out.select(
        key,
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.sort_array(base).alias("base_labels"),
        F.sort_array(F.array_distinct(F.concat(base, F.coalesce("_more", F.expr("CAST(array() AS array<string>)"))))).alias("labels"),
        F.when(F.size(places) > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(table(spark, sf_dir, "documents"))
    return got.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def _sql() -> str:
    values = ", ".join(f"({n}, '{label}', {template_words(text)!r})" for n, (label, text) in enumerate(TEMPLATES))
    places = " UNION ALL ".join(
        f"SELECT row, i - 1 AS i, '{label}' AS label FROM x WHERE w[i:i + {len(p) - 1}] = {list(p)!r}" for label, p in PHRASES.items()
    )
    joined = rf"regexp_replace(regexp_replace(t, '{INNER_STOP[0]}', ' \1', 'g'), '{INNER_STOP[1]}', '\1 \2', 'g')"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), v AS (
  SELECT row, doc_id, t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d
), x AS (SELECT row, w, unnest(range(1, len(w) + 1)) AS i FROM v
), p AS ({places}
), b AS (
  SELECT row, list_distinct(regexp_extract_all(unnest(regexp_split_to_array({joined}, '{BLOCK_BREAK}')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS b FROM v
), s(template, label, s) AS (VALUES {values}
), m AS (
  SELECT row, label, len(list_intersect(b, s)) / len(s) AS share FROM b, s WHERE len(list_intersect(b, s)) >= ceil({THRESHOLD} * len(s) - 1e-9)
), l AS (
  SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT row, label FROM m UNION ALL SELECT row, label FROM p) GROUP BY row
), n AS (
  SELECT row, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY row
), k AS (SELECT row, max(share) AS share FROM m GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM v LEFT JOIN n USING (row) LEFT JOIN l USING (row) LEFT JOIN k USING (row)
"""


OP9_SQL = _sql()
