"""Edge cases and literal expectations of the engine's own operators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chat, contamination, corpus, evals, runs
from corpusloom.plans import chat_queries, corpus_queries
from corpusloom.sources import readers
from corpusloom.streaming.packing import pack_stream


def one(spark, text, use):
    return spark.createDataFrame([(text,)], "t string").select(use(F.col("t"))).collect()[0][0]


def test_blanks_and_lines(spark):
    text = "\x1c  a 　b \x85"
    assert one(spark, text, T.strip) == text.strip()
    assert one(spark, text, T.collapse_blanks) == " ".join(text.split())
    for text in ("", "a", "a\n", "a\r\nb\n\n", "\n", "x\x0by\x1cz ", "a\r\rb"):
        assert one(spark, text, T.lines) == text.splitlines()


def test_round4_is_python_rounding(spark):
    rng = random.Random(5)
    values = [rng.uniform(-5, 5) for _ in range(3000)] + [0.00005, 0.00015, 2.00025, -1.00035, 0.5, -0.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", T.round4(F.col("v")).alias("r")).collect()
    assert [r["r"] for r in got] == [round(r["v"], 4) for r in got]


def test_tokens_fold_like_unicode(spark):
    assert one(spark, "Hello, İıſK wörld! 9", T.tokens) == ["hello", "i̇ıſk", "w", "rld", "9"]
    assert one(spark, "Hello, world!", lambda t: T.ngrams(T.tokens(t), 2)) == ["hello world"]
    assert one(spark, "Hello", lambda t: T.ngrams(T.tokens(t), 2)) == []


def test_filter_keeps_one(spark):
    rows = spark.createDataFrame([(1, "short", 5.0, 5), (2, "long enough text", 2.0, 5), (3, "long enough too", 3.0, 3), (4, None, 9.0, 9)], "doc_id long, text string, s double, i int")
    got = corpus.filter_texts(rows, min_chars=10, score="s", min_score=3.0, int_score="i", min_int_score=3)
    assert [r["doc_id"] for r in got.collect()] == [3]
    loose = spark.createDataFrame([(1, "abc", None), (2, "abc", float("nan"))], "doc_id long, text string, s double")
    assert corpus.filter_texts(loose, score="s", min_score=3.0).count() == 2
    assert corpus.filter_texts(loose, max_docs=0).count() == 1


def packed(documents, block, end):
    rest, out = [], []
    for ids in documents:
        rest += ids + [end] if ids else []
        while len(rest) >= block:
            out.append(rest[:block])
            rest = rest[block:]
    return out


def test_packing_in_order(spark):
    rng = random.Random(1)
    documents = [[rng.randint(1, 9) for _ in range(rng.choice([0, 0, 1, 3, 20, 60]))] for _ in range(300)]
    rows = spark.createDataFrame([(i, ids) for i, ids in enumerate(documents)], "doc_id long, ids array<int>").repartition(7)
    got = [list(r["input_ids"]) for r in corpus.pack_in_order(rows, 16).orderBy("block_id").collect()]
    assert got == packed(documents, 16, 0)
    assert corpus.pack_in_order(rows.limit(0), 16).count() == 0
    two = spark.createDataFrame([(0, "abcd"), (1, "efgh")], "doc_id long, text string").select("doc_id", corpus.char_tokenizer(F.col("text")).alias("ids"))
    assert corpus.pack_in_order(two, 5).count() == 2


def test_stream_packs_like_batch(spark, tmp_path):
    documents = [[i + 1] * (i % 5) for i in range(40)]
    rows = spark.createDataFrame([(0, i, ids) for i, ids in enumerate(documents)], "shard int, doc_id long, ids array<int>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = pack_stream(stream, 7).writeStream.format("memory").queryName("packed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = [list(r["input_ids"]) for r in spark.table("packed").orderBy("block_no").collect()]
    assert got == packed(documents, 7, 0)


def test_contamination_of_files(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(10))
    (tmp_path / "a.txt").write_text(words)
    (tmp_path / "b.jsonl").write_text(json.dumps({"prompt": words}) + "\nnot json\n")
    sides = [readers.read_any_texts(spark, str(tmp_path / n)) for n in ("a.txt", "b.jsonl")]
    got = contamination.contamination_report(*sides, n=5, threshold=0.0).collect()[0]
    assert (got["overlap_ngrams"], got["benchmark_ngrams"], got["status"]) == (6, 6, "fail")
    assert contamination.contamination_report(sides[0].limit(0), sides[1].limit(0)).collect()[0]["status"] == "pass"


def test_json_strings_are_recursive(spark):
    payload = json.dumps({"a": [" ", "x", {"b": "y", "c": 3}], "d": "z"})
    rows = spark.createDataFrame([(1, payload), (2, "{bad"), (3, None)], "id int, j string")
    assert [(r["id"], r["text"]) for r in readers.json_strings(rows, "j").orderBy("id", "pos").collect()] == [(1, "x"), (1, "y"), (1, "z")]


def test_strict_lines_fail(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"prompt": "a"}\n\n{"prompt": "b"}\n')
    (tmp_path / "bad.jsonl").write_text('{"prompt": "a"}\n[1]\n')
    assert readers.read_jsonl_strict(spark, str(tmp_path / "good.jsonl"), "prompt string").count() == 2
    with pytest.raises(Exception):
        readers.read_jsonl_strict(spark, str(tmp_path / "bad.jsonl"), "prompt string").collect()


def test_shards_and_results(spark, tmp_path):
    assert readers.sample_shards(str(tmp_path), "other") is None
    with pytest.raises(FileNotFoundError):
        readers.sample_shards(str(tmp_path), "sample-10BT")
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text('{"no": 1}')
    (tmp_path / "r" / "b.json").write_text('{"results": {"t": {"acc,none": 0.5}}}')
    got = evals.choose_metrics(readers.read_results(spark, str(tmp_path / "r"))).collect()
    assert [(r["task"], r["metric"], r["value"]) for r in got] == [("t", "acc,none", 0.5)]


def chats(spark, *conversations):
    rows = [(c, t, role, text) for c, turns in enumerate(conversations) for t, (role, text) in enumerate(turns)]
    return chat.gather_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


def test_messages(spark):
    rows = chats(spark, [("system", "s"), ("user", "2+2?"), ("assistant", "4"), ("user", "3+3?"), ("assistant", " 6 ")], [("assistant", "x"), ("user", "y")], [("user", "y")], [("tool", "t"), ("User ", "q"), ("assistant", "a"), ("user", "")])
    got = {r["conv_id"]: (r["prompt"], r["response"]) for r in chat.prompt_and_response(chat.standardize(rows)).collect()}
    assert got == {0: ("s\n2+2?\n4\n3+3?", "6"), 3: ("q", "a")}
    sample = {r["conv_id"]: r["sample"] for r in chat.render_sample(rows).collect()}
    assert sample[0]["response"] == "6" and "### Response:\n4\n\n" in sample[0]["prompt"] and sample[2] is None
    assert sample[1]["response"] == "x"
    text = spark.createDataFrame([('[{"role": "user", "content": "a"}]',), ("{bad",)], "m string")
    assert [r[0] is None for r in text.select(chat.parse_messages(chat.messages_from_json(F.col("m")))).collect()] == [False, True]


def test_encoding(spark):
    rows = spark.createDataFrame([("i", "abc", "", "xyz"), ("l", "p" * 90, "", "q")], "id string, instruction string, input string, output string")
    got = chat.encode_sample(chat.render_sample(rows), 80, end_id=0).collect()
    assert [r["id"] for r in got] == ["i"]
    labels = list(got[0]["labels"])
    supervised = [i for i, x in enumerate(labels) if x != chat.IGNORED]
    assert len(labels) == 80 and len(supervised) == 4 and labels[supervised[-1]] == 0
    assert sum(got[0]["attention_mask"]) == supervised[-1] + 1


def greedy_quality(rows, target, cap):
    taken, count = [], {}
    for r in rows:
        if count.get(r[1], 0) < cap and len(taken) < target:
            taken.append(r)
            count[r[1]] = count.get(r[1], 0) + 1
    return taken + [r for r in rows if r not in taken][: target - len(taken)]


def test_selection_is_the_greedy_walk(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("abc"), rng.randint(0, 4) / 2, rng.randint(1, 3)) for i in range(60)]
    frame = spark.createDataFrame(rows, "conv_id long, category string, score double, response_chars int")
    ranked = sorted(rows, key=lambda r: (-r[2], -r[3], r[0]))
    for target, cap in ((10, 3), (25, 5), (60, 2), (100, 4)):
        got = [r["conv_id"] for r in chat.select_quality(frame, target, cap).collect()]
        assert got == [r[0] for r in greedy_quality(ranked, target, cap)]
    assert chat.select_quality(frame, 0, 3).count() == 1
    assert chat.summarize(frame.limit(0)).collect()[0]["mean_score"] == 0.0


def test_win_rates_of_the_published_table(spark):
    from corpusloom.plans import run_queries as q

    got = {r["baseline"]: r["wins"] for r in q.win_rates(spark, "").collect()}
    assert got == {"gpt2": 5, "opt-125m": 4, "gpt-neo": 4, "cerebras-111m": 6, "pythia-160m": 6, "smollm": 0, "smollm2": 0}
    c, b = q._metrics(spark)
    assert "- `gpt-neo`: 4/6 = 0.667" in evals.markdown("x", c, b, ["gpt-neo"])
    assert evals.parse_named_path("a=b=c") == ("a", "b=c")
    with pytest.raises(ValueError):
        evals.parse_named_path("=x")


def test_budget_and_padding(spark):
    row = spark.range(1).select(*(v.alias(k) for k, v in runs.token_budget(F.lit(2048), F.lit(6), F.lit(43), F.lit(18928)).items())).collect()[0]
    assert (row["tokens_per_step"], row["planned_tokens"]) == (528384, 10001252352)
    assert spark.range(1).select(runs.pad_to_multiple(F.lit(101), 64)).collect()[0][0] == 128
    with pytest.raises(TypeError):
        runs.config_row(spark, {"x": 1}, {"y": "int"})


def whole_texts(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()}
    assert any(len(t) > 5000 for t in texts.values())
    return texts


def test_packing_takes_whole_texts(spark, data):
    size = corpus_queries.BLOCK
    texts = [t for t in whole_texts(spark, data).values() if len(t) >= 300]
    ids = [x for t in texts for x in [*(ord(c) % 31 + 1 for c in t), 0]]
    blocks = [ids[i : i + size] for i in range(0, len(ids) - size + 1, size)]
    want = [(i, sum(b), sum(x * k for k, x in enumerate(b))) for i, b in enumerate(blocks)]
    assert sorted(tuple(r) for r in corpus_queries.pack_blocks(spark, data).collect()) == want
    assert tuple(corpus_queries.pack_block_stats(spark, data).collect()[0]) == (len(want), sum(w[1] for w in want), sum(w[2] for w in want))
    batches = [want[i : i + 8] for i in range(0, len(want), 8)]
    assert sorted(tuple(r) for r in corpus_queries.pack_batches(spark, data).collect()) == [(i, len(b), sum(w[1] for w in b)) for i, b in enumerate(batches)]


def test_filter_keeps_whole_texts(spark, data):
    want = {i: len(t) for i, t in whole_texts(spark, data).items() if len(t) >= 300}
    assert {r["doc_id"]: r["chars"] for r in corpus_queries.corpus_filter(spark, data).collect()} == want


def test_instructions_take_whole_texts(spark, data):
    parts = {r["doc_id"]: (r["text"][:40].strip(), r["text"][40:].strip()) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert {r["doc_id"]: r["chars"] for r in chat_queries.sft_instructions(spark, data).collect()} == {i: len(c) for i, (a, c) in parts.items() if a and c}


def test_published_scores():
    from corpusloom.plans.run_queries import SCORES

    assert [v / 1e4 for v in SCORES["cerebras-111m"]] == [0.2099, 0.3506, 0.2720, 0.1912, 0.5811, 0.4901]
    assert [v / 1e4 for v in SCORES["pythia-160m"]] == [0.2312, 0.3641, 0.3030, 0.1225, 0.5979, 0.5075]


def test_split_guards_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([(i, "a", float(i), 1) for i in range(5)], "conv_id long, category string, score double, response_chars int")
    got = chat.train_and_eval(rows, rows, 3, 2).collect()
    assert sorted((r["split"], r["conv_id"], r["leaked"]) for r in got) == [("eval", 3, True), ("eval", 4, True), ("train", 2, False), ("train", 3, False), ("train", 4, False)]
    with pytest.raises(RuntimeError):
        chat.train_and_eval(rows, rows, 6, 2)
    with pytest.raises(ValueError):
        corpus.tokenizer("other")
    readers.write_report(chat.summarize(rows), str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())["categories"] == {"a": 5}
    texts = spark.createDataFrame([(1, " a \n b"), (2, "c d"), (3, " ")], "doc_id long, text string")
    corpus.write_text_sample(texts.coalesce(1), str(tmp_path / "t"))
    assert "".join(p.read_text() for p in (tmp_path / "t").glob("part*")) == "a b\n\nc d\n\n"
