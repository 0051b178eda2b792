"""What grows with the tables: rows that are shuffled, texts that are worked on, and how often."""

import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import contamination, corpus
from corpusloom.plans import chat_queries, corpus_queries


def shuffled(df):
    """The columns of the shuffles of ``df``'s plan, with their types."""
    out, nodes = [], [df._jdf.queryExecution().sparkPlan(), df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.initialPlan())
        if node.nodeName() == "Exchange":
            out.append(node.schema().simpleString())
        nodes.extend(node.children().apply(i) for i in range(node.children().size()))
    return out


@pytest.mark.parametrize("n", (1, 2, 3, 5, 13))
def test_hashed_ngrams_are_as_many_as_spelled_out_ones(spark, n):
    texts = ["a b c d e a b c d e a b c d e f g h", "A b C d", "", None, "b c d e a b c d e a b c d e", "one"]
    sides = [spark.createDataFrame([(t,) for t in part], "text string") for part in (texts, texts[:2] + ["x y z " * 9])]
    spelled = []
    for side in sides:
        words = [re.findall("[a-z0-9]+", (r.text or "").lower()) for r in side.collect()]
        spelled.append({tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1)})
    got = {r.side: r["count"] for r in contamination.ngram_sides(*sides, n).groupBy("side").count().collect()}
    a, b = spelled
    assert got == {k: v for k, v in ((1, len(a - b)), (2, len(b - a)), (3, len(a & b))) if v}


def test_ngrams_are_shuffled_as_a_long_and_an_int(spark, data):
    for name in ("ngram_counts", "contamination_report"):
        wide = [s for s in shuffled(corpus_queries.QUERIES[name](spark, data)) if "h1" in s]
        assert wide and set(wide) == {"struct<h1:bigint,h2:int>"}


def test_positive_classes_are_the_complements():
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    blank = {c for c in every if c.isspace()}
    assert set(T.BLANKS) == blank and len(T.BLANKS) == 29
    python = lambda c: re.sub(r"\\x\{(\w+)\}", lambda m: "\\U" + m[1].zfill(8), c)
    assert set(re.findall(f"[{python(T.NOT_BLANK)}]", every)) == set(every) - blank
    assert set(re.findall(f"[{python(T.NOT_PLAIN)}]", every)) == set(every) - set("abcdefghijklmnopqrstuvwxyz0123456789 ")


def test_no_pattern_has_a_negated_class(spark):
    made = spark.range(1).select(F.col("id").cast("string").alias("t")).select(T.count_words(F.col("t")), T.dedupe_key(F.col("t")), T.strip(F.col("t")))
    assert "[^" not in made._jdf.queryExecution().analyzed().toString().replace("&&[^ ]", "")


@pytest.mark.parametrize("length", (1, 5, 20))
def test_key_of_a_text_is_the_whole_text_s(spark, length):
    texts = ["  Ab\t c", "- " * 50 + "abc def  ghi", "a  b  c  d  e  f  g  h  i  j", "Ω" * 99 + "end", " \u2003", "", None, "x" * 4 + " " * 80 + "y", "abcde" * 9, "ab cd" + "!" * 80 + "efgh"]
    made = spark.createDataFrame([(t,) for t in texts], "text string")

    def key(t):
        return None if t is None else re.sub("[^a-z0-9 ]+", "", " ".join(t.lower().split()))[:length]

    assert [r.k for r in made.select(T.dedupe_key(F.col("text"), length).alias("k")).collect()] == [key(t) for t in texts]


def test_ends_and_keys_cost_no_pattern_or_long_key(spark, data):
    assert "regexp" not in spark.range(1).select(T.strip(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    keyed = [s for s in shuffled(corpus_queries.QUERIES["dedupe_first"](spark, data)) if "_key" in s]
    assert keyed and all("_key:binary" in s for s in keyed)


def test_tokenizers_give_one_id_a_character_or_byte_in_time_that_grows_with_the_text(spark):
    texts = ["a", "", None, "é\U0001f600 z\n", "aé\U00010400" * 100_000]  # quadratic work would take minutes
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(2)
    got = {r.i: r for r in made.select("i", corpus.tokenizer("char")(F.col("text")).alias("c"), corpus.tokenizer("byte")(F.col("text")).alias("b")).collect()}
    for i, t in enumerate(texts):
        assert got[i].c == (None if t is None else [ord(x) % 31 + 1 for x in t])
        assert got[i].b == [x + 1 for x in (t or "").encode()]
    empty = made.where("i > 99").select(corpus.tokenizer("char")(F.col("text")).alias("c"))
    assert empty.collect() == [] and dict(empty.dtypes)["c"] == "array<int>"


def test_packing_makes_ids_once_and_after_the_join(spark, data):
    plan = corpus_queries.QUERIES["pack_block_stats"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # ids and sums
    assert plan.rindex("ArrowEvalPython") < plan.index("Join")


def test_block_sums(spark):
    made = spark.createDataFrame([([5, 1, 2],), ([31, 31, 31],)], "ids array<int>").select(corpus.block_sums(F.col("ids")).alias("s"))
    assert sorted(tuple(r.s) for r in made.collect()) == [(8, 5), (93, 93)]
    assert made.where("s.id_sum < 0").collect() == []


def test_split_is_chosen_once(spark, data):
    made = chat_queries.QUERIES["train_eval_split"](spark, data)
    assert "conversations.parquet" not in " ".join(made.inputFiles())


def test_packed_ids_travel_as_narrow_as_asked(spark):
    docs = spark.createDataFrame([(0, "abcd"), (1, "efgh")], "doc_id long, text string")
    ids, size = corpus.char_tokenizer(F.col("text")), F.length("text")
    wide, narrow = (corpus.pack_in_order(docs, 5, ids=ids, size=size, kind=kind) for kind in ("int", "tinyint"))
    assert dict(narrow.dtypes)["input_ids"] == "array<tinyint>" and dict(wide.dtypes)["input_ids"] == "array<int>"
    assert sorted(map(tuple, narrow.collect())) == sorted(map(tuple, wide.collect())) and narrow.count() == 2
