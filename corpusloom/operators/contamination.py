"""Overlap of word n-grams between a corpus and a benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import here, ngrams, tokens

N, THRESHOLD = 13, 0.001
#: Bytes of the tables whose n-grams one task counts, about, and tasks at most.
COUNTED_BYTES, COUNTED_TASKS = 4 << 20, 8192
#: The two low bits of an n-gram's second hash, which give way to its side.
SIDES = 3


def distinct_ngrams(texts: DataFrame, n: int = N, *, text: str = "text", order: str | None = None, limit: int | None = None) -> DataFrame:
    """Distinct n-grams (g) of all texts, or of the first ``limit`` by ``order``."""
    rows = texts if limit is None else texts.orderBy(order).limit(limit)
    return rows.select(F.explode(ngrams(tokens(F.col(text)), n)).alias("g")).distinct()


def hashed_ngrams(texts: DataFrame, side: int, n: int = N, *, text: str = "text") -> DataFrame:
    """(h1, h2): 94 bits of hash of every n-gram of all texts, 64 in h1 and 30 in the int h2, whose other two hold ``side``.

    Two hashes a word, then a hash of two hashes for each longer run: no n-gram is spelled out. On the check
    table these rows take 385 MB of shuffle where two longs and a side took 491.
    """
    made = texts.select(here(tokens(F.col(text))).alias("w")).where(F.size("w") >= n)
    made, size = made.select(*(here(F.transform("w", lambda x: F.xxhash64(F.lit(seed), x))).alias(f"h{seed}") for seed in (1, 2))), 1
    one = [F.col("o1"), F.col("o2")]
    made = made.select("h1", "h2", F.col("h1").alias("o1"), F.col("h2").alias("o2"))
    for bit in bin(n)[3:]:  # runs of twice as many words, and of one more

        def longer(run: Column, more: Column) -> Column:
            """Each run with that of ``more`` which begins where it ends."""
            count = F.greatest(F.lit(0), F.size(more) - size)
            return here(F.zip_with(F.slice(run, F.lit(1), count), F.slice(more, F.lit(size + 1), count), lambda x, y: F.xxhash64(x, y)))

        made, size = made.select(longer(F.col("h1"), F.col("h1")).alias("h1"), longer(F.col("h2"), F.col("h2")).alias("h2"), *one), 2 * size
        if bit == "1":
            made, size = made.select(longer(F.col("h1"), one[0]).alias("h1"), longer(F.col("h2"), one[1]).alias("h2"), *one), size + 1
    each = made.select("h2", F.posexplode("h1").alias("at", "x"))
    return each.select(F.col("x").alias("h1"), F.shiftleft(F.shiftright(F.get("h2", F.col("at")), 34).cast("int"), 2).bitwiseOR(F.lit(side)).alias("h2"))


def _tasks(*texts: DataFrame) -> int:
    size = sum(int(str(t.select("text")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in texts)
    return max(1, min(COUNTED_TASKS, size // COUNTED_BYTES))


def ngram_sides(first: DataFrame, second: DataFrame, n: int = N) -> DataFrame:
    """(side) of each distinct n-gram of two tables: 1 or 2, or 3 for one of both.

    Hardly any n-gram comes twice to a task, so a partial aggregate before the shuffle would fill memory for
    nothing. There are as many tasks as keep each one's n-grams in memory.
    """
    both = hashed_ngrams(first, 1, n).unionByName(hashed_ngrams(second, 2, n)).repartition(_tasks(first, second), "h1")
    side = F.col("h2").bitwiseAND(F.lit(SIDES))
    return both.groupBy("h1", F.col("h2").bitwiseAND(F.lit(~SIDES)).alias("h2")).agg(F.bit_or(side).alias("side")).select("side")


def _on(*sides: int) -> Column:
    return F.count_if(F.col("side").isin(*sides))


def ngram_counts(first: DataFrame, second: DataFrame, names: tuple[str, str], n: int = N) -> DataFrame:
    """(side, n): the number of distinct n-grams of either table beside its name."""
    counts = ngram_sides(first, second, n).agg(_on(1, 3).alias("a"), _on(2, 3).alias("b"))
    rows = F.array(*(F.struct(F.lit(name).alias("side"), F.col(c).alias("n")) for name, c in zip(names, "ab")))
    return counts.select(F.inline(rows))


def contamination_report(train: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """One row of counts, rate and status. One shuffle: both sides are counted in a single aggregate, n-grams told apart by 94 bits of hash."""
    counts = ngram_sides(train, benchmark, n).agg(_on(1, 3).alias("train_ngrams"), _on(2, 3).alias("benchmark_ngrams"), _on(3).alias("overlap_ngrams"))
    rate = F.col("overlap_ngrams") / F.greatest(F.lit(1), F.col("benchmark_ngrams"))
    return counts.withColumn("overlap_rate", rate).withColumn("status", F.when(rate <= threshold, "pass").otherwise("fail"))


def contaminated_documents(train: DataFrame, benchmark: DataFrame, n: int = N, order: str = "doc_id") -> DataFrame:
    """(doc, hits): distinct benchmark n-grams in each document that has any."""
    grams = train.select(order, F.explode(F.array_distinct(ngrams(tokens(F.col("text")), n))).alias("g"))
    return grams.join(distinct_ngrams(benchmark, n), "g", "left_semi").groupBy(order).agg(F.count("*").alias("hits"))
