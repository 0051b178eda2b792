"""The training-data operators: against SQL, brute force, exact round trips and held-out accuracy, and at the edges."""

import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, catalog, chat_format, common, langid, license_scan, ngram_join, packing, quality, topk, url_filter, warc
from tests.oracle import same

os.environ["TOKENIZERS_PARALLELISM"] = "false"
EDGE_TEXTS = [None, "", " \n\t", "a", "A b", "word " * 3000, "\x1cx\x85y　z", "é" * 50, "!!! ???", "one two three", "one two three", "<|endoftext|> [INST] </s>"]


def docs(spark, texts, extra=True):
    rows = [(i, t, "en", 7, "clash") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, size string")
    return frame if extra else frame.select("doc_id", "text", "lang")


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_query_matches_sql(spark, data, name):
    same(catalog.QUERIES[name](spark, data), catalog.SQL[name], data)


# packing and tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def test_codec_is_the_library(library):
    rng = random.Random(1)
    letters = "abcdeéßİΣſK'’  \n\t\x1d .,!#12٣漢한̀̈😀<|>"
    texts = [t for t in EDGE_TEXTS if t is not None] + ["<|startoftext|>x<|endoftext|>", "it's we'LL 'tis", "a" * 3000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    own, crc = bpe.codec(bpe.vocabulary_path()), packing._ids(bpe.vocabulary_path())
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, repr(text)
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
        assert b"".join(crc.of(text)) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_codec_query(spark, data, library):
    import hashlib

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in catalog.QUERIES["op6_bpe_codec"](spark, data).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def check_packing(rows, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_query(spark, data, library):
    rows = catalog.QUERIES["op1_best_fit_packing"](spark, data).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    want = []
    for i, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((i, k, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    used = check_packing(rows, 2048)
    assert used <= 1.03 * -(-sum(w[3] for w in want) // 2048) + 1


def test_plan_places_every_piece_once():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.choice([5, 20, 64])
        counts = {n: rng.randint(0, rng.choice([1, 3, 30])) for n in range(1, capacity + 1) if rng.random() < 0.6}
        seen, rows = set(), []
        for s in packing.plan_packing(counts, capacity):
            for i in range(s.count):
                assert (s.length, s.first + i) not in seen
                seen.add((s.length, s.first + i))
                rows.append({"sequence_id": s.sequence + i, "offset": s.offset, "length": s.length})
        assert len(seen) == sum(counts.values()) and all(r < counts[n] for n, r in seen)
        check_packing(rows, capacity)


def test_exact_complements_are_used():
    assert max(s.sequence + s.count for s in packing.plan_packing({7: 2, 2: 1, 1: 3, 4: 3, 5: 1, 3: 1}, 10)) == 4
    triple = packing.plan_packing({4: 1, 3: 1, 2: 1, 1: 1}, 10)
    assert {s.sequence for s in triple} == {0}


def test_packing_edges(spark):
    got = packing.pack_documents(docs(spark, EDGE_TEXTS), bpe.vocabulary_path(), capacity=64).collect()
    assert {r["doc_id"] for r in got} == set(range(len(EDGE_TEXTS)))
    check_packing(got, 64)
    assert packing.pack_documents(docs(spark, EDGE_TEXTS).limit(0), bpe.vocabulary_path()).count() == 0
    copies = spark.createDataFrame([(1, "same")] * 500, "doc_id long, text string")
    rows = packing.pack_documents(copies, bpe.vocabulary_path(), capacity=64).collect()
    assert len(rows) == 500 and check_packing(rows, 64) == -(-500 * rows[0]["length"] // 64)


# chat


def test_chat_round_trip(spark):
    rng = random.Random(4)
    bits = ["<", "s", ">", "/", "[", "]", "INST", "ROLE ", "SYS", " ", "+", "</s>", "<s>", "[INST] ", " [/INST] ", "[+]", "é", "\n", "[[]", "<[s]s>", "[/ROLE]"]
    rows, want = [], {}
    for c in range(200):
        turns = [(c, t, rng.choice(["user", "assistant", "system", "tool] x", ""]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for t in range(rng.randint(1, 8))]
        want[c] = [(t[2], t[3]) for t in turns]
        rows += turns
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat_format.parse(chat_format.format_conversations(frame)).collect():
        assert [(t["role"], t["text"]) for t in r["turns"]] == want[r["conv_id"]]
        assert r["loss"] == "".join(text for role, text in want[r["conv_id"]] if role == "assistant")


def test_chat_edges(spark):
    rows = [(1, None, None, None), (1, 2, "user", "b"), (1, 2, "user", "a"), (1, 2, "user", "a"), (None, 1, "assistant", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat_format.parse(chat_format.format_conversations(frame)).collect()}
    assert got == {1: [("", ""), ("user", "a"), ("user", "a"), ("user", "b")], None: [("assistant", "x")]}
    assert chat_format.format_conversations(frame.limit(0)).count() == 0


# URLs


def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://", "http://COM/", "http://a.COM/x", "http://xcom/", "http://a.net/es/", "http://a.net/ES/", "http://www.example.com/en/q", "http://b.example.com/en/?q#f", "http://free-bets.org/x", "http://bets2.org/", "a://b://c"]
    frame = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rank string")
    for shard in (100, 3):
        got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(frame, (*url_filter.BASE_RULES, *url_filter.METHOD_RULES), shard=shard).collect()}
        assert got[0] == ("", None, None) and got[2] == ("", None, None)
        assert got[4][1:] == ("com/", "allow") and got[5][1:] == ("com/", "allow") and got[6][1] is None
        assert got[7][1:] == ("net/es/", "block") and got[8][1] is None
        assert got[9][1:] == ("www.example.com/en/", "allow") and got[10][1:] == ("example.com/en/", "block")
        assert got[11][1:] == ("bets", "block") and got[12][1] is None and got[13][0] == "b:"
    assert url_filter.judge_urls(frame.limit(0), url_filter.BASE_RULES).count() == 0


def test_url_pairs_and_repeats(spark):
    long = "http://a.org/" + "x/" * 50_000
    urls = ["http://shop.a.org/en/cart?x", "http://shop.a.org/carts", "http://workshop.org/cart", "http://b-shop.io/cart/1", long, long, "http://shop.a.org/en/cart?x"]
    frame = spark.createDataFrame([(i % 6, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = [(r["rule"], r["verdict"]) for r in url_filter.judge_urls(frame.coalesce(1), url_filter.METHOD_RULES).collect()]
    assert got == [("shop+cart", "block"), (None, None), (None, None), ("shop+cart", "block"), (None, None), (None, None), ("shop+cart", "block")]


def test_rules_stand_under_their_rarest_token():
    index = url_filter.build_index(url_filter.BASE_RULES, {"com": 9, "en": 5, "www": 2, "net": 1, "es": 3})
    assert index["example"] == [1, 2] and index["com"] == [0] and index["net"] == [3] and index["fr"] == [4]


# WARC


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def read_back(spark, rows, **options):
    manifest = warc.write_archives(pages(spark, rows), **options)
    return manifest, warc.read_archives(manifest)


def test_warc_edges(spark):
    rows = [(3, "http://a/\r\nx", "same"), (1, None, "same"), (2, "http://b", None), (5, "http://c", ""), (None, "http://d", "same"), (7, "http://e", "long é" * 2000)]
    got = {r["page_id"]: r for r in read_back(spark, rows)[1].collect()}
    assert all(r["problem"] is None for r in got.values()) and len(got) == 6
    assert (got[1]["record_type"], got[3]["record_type"], got[3]["refers_to"], got[None]["record_type"]) == ("response", "revisit", 1, "response")
    assert (got[2]["record_type"], got[5]["refers_to"], got[5]["payload_bytes"]) == ("response", 2, 0)
    assert got[3]["payload_digest"] == warc.base32_sha1(b"same") and bytes(got[7]["payload"]) == ("long é" * 2000).encode()
    small = {r["page_id"]: r["record_type"] for r in read_back(spark, rows, min_bytes=5)[1].collect()}
    assert set(small.values()) == {"response"}
    assert read_back(spark, rows[:0] or [])[1].count() == 0


def members(rows):
    out = []
    for i, html in rows:
        packer = zlib.compressobj(3, wbits=31)
        data = warc.record(i, "http://x", html, warc.base32_sha1(html), None, "2000-01-01T00:00:00Z")
        out.append(packer.compress(data) + packer.flush())
    return out


@pytest.mark.parametrize("plain", [False, True])
def test_salvage(spark, tmp_path, plain):
    import random as r

    rng = r.Random(7)
    payloads = [bytes(rng.randbytes(300)) for _ in range(6)]
    parts = [warc.record(i, "http://x", p, warc.base32_sha1(p), None, "2000-01-01T00:00:00Z") for i, p in enumerate(payloads)] if plain else members(enumerate(payloads))
    broken = bytearray(parts[1])
    broken[len(broken) // 2] ^= 0xFF
    data = b"junk\x1f\x8b\x08" + parts[0] + bytes(broken) + parts[2] + parts[3][: len(parts[3]) // 2] + parts[4] + parts[5][:-9]
    (tmp_path / "a.warc.gz").write_bytes(data)
    got = warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "path string")).orderBy("offset").collect()
    assert [x["page_id"] for x in got if x["problem"] is None] == [0, 2, 4]
    assert all(bytes(x["payload"]) == payloads[x["page_id"]] for x in got if x["problem"] is None)
    at = 0
    for x in got:  # records and gaps cover the file
        assert x["offset"] == at
        at += x["size"]
    assert at == len(data) and sum(x["problem"] is not None for x in got) == 4


def test_salvage_reads_no_more_than_a_record(spark, tmp_path):
    """A header without an end, and a member that unpacks far beyond its record, are gaps; what follows is read."""
    good = members([(1, b"one"), (2, b"two")])
    packer = zlib.compressobj(9, wbits=31)
    bomb = packer.compress(b"WARC/1.1\r\nContent-Length: 5\r\n\r\n" + bytes(50 << 20)) + packer.flush()
    data = good[0] + bomb + b"WARC/1.1\r\n" + b"x: y\r\n" * 60000 + good[1]
    (tmp_path / "b.warc.gz").write_bytes(data)
    got = warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/b.warc.gz",)], "path string"))
    rows = got.orderBy("offset").collect()
    assert [r["page_id"] for r in rows] == [1, None, 2] and sum(r["size"] for r in rows) == len(data)
    gaps = warc.quarantined(got).collect()
    assert [(r["offset"], r["size"]) for r in gaps] == [(len(good[0]), len(data) - len(good[0]) - len(good[1]))]


def test_full_caches_keep_what_is_used(monkeypatch):
    """A frequent word among ever new ones is encoded once, the bounds hold, and ids are those of a large cache."""
    path = bpe.vocabulary_path()
    texts = [f"often word{i} it's w{i}x-{i} Éte{i}'S" for i in range(300)]
    whole = list(map(bpe.Codec(path).encode, texts))
    monkeypatch.setattr(bpe, "CACHED_CHUNKS", 40)
    monkeypatch.setattr(bpe, "CACHED_PIECES", 40)
    own, asked = bpe.Codec(path), []
    real = own.bpe.encode
    small = bpe.ChunkCache(lambda piece: asked.append(piece) or real(piece), list, lambda parts: [i for x in parts for i in x], {})
    assert [[i for part in small.of(t) for i in part] for t in texts] == whole
    assert asked.count("often") == 1 and all(len(x) + len(x.old) <= 40 for x in (small, small.pieces))


def test_pieces_of_ascii_are_the_pattern_s():
    rng = random.Random(14)
    for _ in range(3000):
        text = "".join(rng.choice("''stremvldazZ09.$-\x1f_") for _ in range(rng.randint(1, 12))).lower()
        assert bpe.pieces_of(text) == bpe.PIECE.findall(text)


# quality rules


def test_quality_edges(spark):
    texts = [*EDGE_TEXTS, "good plain words that say something new in every single place here today", "# " * 20, "SHOUT LOUD " + "ALL CAPITAL LETTERS OF THE SAME KIND ARE HERE NOW", "x\n" * 30]
    got = {r["doc_id"]: r["failed_rule"] for r in quality.judge(docs(spark, texts)).collect()}
    assert all(got[i] == "few_words" for i in (0, 1, 2, 3, 4)) and got[5] == "repeats"
    assert got[len(EDGE_TEXTS)] is None and all(got[len(EDGE_TEXTS) + k] for k in (1, 2, 3))
    assert quality.judge(docs(spark, texts).limit(0)).count() == 0


def test_repeat_words(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    for r in quality.with_words(docs(spark, texts), "doc_id").select("doc_id", quality.n_repeat_words(F.col("w")).alias("n")).collect():
        w = texts[r["doc_id"]].split()
        runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        assert r["n"] == len({j for i, g in enumerate(runs) if runs.count(g) > 1 for j in range(i, i + 5)})


def test_rule_order_changes_no_verdict(spark, data):
    rows = quality.with_words(spark.read.parquet(f"{data}/documents.parquet"), "doc_id")
    rules = quality.BASE_RULES | quality.METHOD_RULES
    turned = dict(reversed(rules.items()))
    verdicts = [rows.select("doc_id", quality.failed_rule(x, F.col("w"), F.col("text")).alias("failed")).collect() for x in (rules, turned)]
    assert [r["failed"] is None for r in verdicts[0]] == [r["failed"] is None for r in verdicts[1]]
    assert set(quality.order_rules(rows, rules)) == set(rules)


# language


def test_language_accuracy_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = langid.op7_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).collect()[0]
    assert held[0] >= 0.98 and 0 <= held[1] <= held[2] <= 1


def test_language_edges(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en"), ("123 !!", "de"), ("", None), ("the", None)] * 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(frame, langid.trained_on(frame)).collect()
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in got if r["text"] in (None, "123 !!", ""))
    assert all(r["lang_pred"] in ("en", "de") for r in got if r["text"] == "the")
    assert langid.trained_on(frame.where("lang IS NULL")) is None
    assert {r["lang_pred"] for r in langid.predict(frame, None).collect()} == {"und"}
    only = langid.trained_on(frame.where("lang = 'en'"))
    assert {r["score"] for r in langid.predict(frame.where("text = 'the'"), only).collect()} == {1.0}
    assert langid.predict(frame.limit(0), only).count() == 0


def test_network_is_brute_force():
    """Convolution, pooling and gradients against loops and finite differences."""
    import numpy as np

    rng = np.random.default_rng(3)
    model = langid.ByteCnn.blank(["a", "b", "c"], rng)
    model.tables = [t.astype(np.float64) for t in model.tables]
    model.dense, model.bias = model.dense.astype(np.float64), model.bias.astype(np.float64)
    x, y = rng.integers(0, 257, (5, 20)), np.array([0, 1, 2, 1, 0])
    n = 20 - len(model.tables) + 1
    slow = [[max(0.0, max(sum(t[row[i + k], f] for k, t in enumerate(model.tables) if f < t.shape[1]) for i in range(n))) for f in range(model.dense.shape[0])] for row in x]
    assert np.allclose(model.pooled(x)[0], slow)
    loss = lambda: -model.log_probabilities(x)[np.arange(5), y].mean()
    grads = model.gradients(x, y)
    for param, grad in zip([*model.tables, model.dense, model.bias], grads):
        where = np.argwhere(np.abs(grad) > 1e-6)
        for at in map(tuple, where[:: max(1, len(where) // 20)]):
            old = param[at]
            param[at] = old + 1e-5
            up = loss()
            param[at] = old - 1e-5
            down = loss()
            param[at] = old
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-5


def test_very_long_text_has_a_language(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog " * 20, "en"), ("der hund und die katze " * 20, "de")] * 8)] + [(100, "der hund und die katze " * 100_000, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(frame, langid.trained_on(frame)).collect()}
    assert got[100] == "de"


def test_language_stage_rejects_scrambled_letters(spark):
    import corpus_pipeline

    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 400").orderBy("doc_id").limit(300).collect()
    rng = random.Random(13)
    junk = [(-i, "".join(rng.sample(r["text"], len(r["text"]))), None, "x", 1) for i, r in enumerate(rows[:40], 1)]
    frame = spark.createDataFrame([tuple(r) for r in rows] + junk, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, frame, "").collect()}
    assert sum(i < 0 for i in kept) <= 12 and sum(i >= 0 for i in kept) == 300


def test_windows_cover_the_text():
    for n in (1, 255, 256, 257, 1000):
        x, w = langid.windows(b"a" * n)
        assert (x == ord("a")).sum() == n and w.sum() == n


# top k


def brute_top(rows, k, scale=1024):
    import math

    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in good:
        if q % 100 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b))[:k]
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("block", [topk.BLOCK_BYTES, 64])
def test_top_k_edges(spark, block):
    rng = random.Random(9)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(330)]
    rows += [(1000, None), (1100, [1.0, None, 0.0, 0.0]), (1200, [float("nan"), 0.0, 0.0, 0.0]), (1300, [1.0, 2.0]), (1301, [2.0, 2.0]), (1400, [float("inf")] * 4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = topk.exact_top_k(frame, frame.where("vec_id % 100 = 0"), 10, block_bytes=block).collect()
    assert {tuple(r) for r in got} == brute_top(rows, 10)
    assert topk.exact_top_k(frame.limit(0), frame.limit(0), 10).count() == 0


def test_top_k_of_large_components(spark):
    rows = [(0, [3e6, -2e6]), (1, [5e6, 7e6]), (2, [-4e6, 1e6]), (3, [5e6, 7e6])]
    got = topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>"), 2).collect()
    assert {tuple(r) for r in got} == brute_top(rows, 2)


# licenses


def test_license_edges(spark):
    texts = [*EDGE_TEXTS, "ALL RIGHTS  reserved.", "cc-by cc by", "Released under the MIT License.", "Permission is granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "all rights K reserved"]
    n = len(EDGE_TEXTS)
    got = {r["doc_id"]: r for r in license_scan.scan(docs(spark, texts)).collect()}
    assert all(got[i]["n_words"] == 0 and got[i]["labels"] == [] and got[i]["score"] == 0 for i in (0, 1, 2))
    assert (got[n]["n_base"], got[n]["first_word"], got[n]["last_word"], got[n]["labels"]) == (1, 0, 0, ["reserved"])
    assert (got[n + 1]["n_base"], got[n + 1]["first_word"], got[n + 1]["last_word"]) == (2, 0, 2)
    assert got[n + 2]["labels"] == ["mit"] and got[n + 2]["base_labels"] == [] and got[n + 3]["labels"] == ["mit"] and 0.9 <= got[n + 3]["score"] < 1
    assert got[n + 4]["n_base"] == 0 and got[n + 4]["n_words"] == 4
    assert license_scan.scan(docs(spark, texts).limit(0)).count() == 0


def test_license_join_is_exact(spark):
    rng = random.Random(10)
    vocabulary = sorted({w for _, t in license_scan.TEMPLATES for w in license_scan.template_words(t)})
    texts = []
    for _ in range(120):
        words = license_scan.template_words(rng.choice(license_scan.TEMPLATES)[1])
        kept = [w for w in words if rng.random() < 0.93] + rng.sample(vocabulary, rng.randint(0, 3))
        rng.shuffle(kept)
        texts.append(" ".join(kept))
    for r in license_scan.scan(docs(spark, texts)).collect():
        block = set(texts[r["doc_id"]].split())
        want = {label for label, t in license_scan.TEMPLATES if len(block & set(license_scan.template_words(t))) >= 0.9 * len(license_scan.template_words(t)) - 1e-9}
        assert want == set(r["labels"]) - set(r["base_labels"]) or want | set(r["base_labels"]) == set(r["labels"])


def wrapped(text, width, lead):
    import textwrap

    return "Some words before it.\n" + "\n".join(lead + line for line in textwrap.wrap(text, width)) + "\n" + lead + "and more after it"


def test_wrapped_templates_are_found(spark):
    cases = [(label, wrapped(text, width, lead)) for label, text in license_scan.TEMPLATES if label != "mpl-2.0" for width in (20, 45, 72) for lead in ("", " * ")]
    got = {r["doc_id"]: r for r in license_scan.scan(docs(spark, [text for _, text in cases])).collect()}
    assert [label for i, (label, _) in enumerate(cases) if label not in got[i]["labels"] or got[i]["score"] < 0.9] == []
    apart = ["Permission is hereby granted, free of charge, to any person\n \nobtaining a copy of this software and associated documentation files, to deal in the Software without restriction"]
    assert license_scan.scan(docs(spark, apart)).collect()[0]["labels"] == []


def test_every_template_gets_its_label(spark):
    mpl = next(text for label, text in license_scan.TEMPLATES if label == "mpl-2.0")
    cases = [*license_scan.TEMPLATES, *(("mpl-2.0", wrapped(mpl, width, lead)) for width in (20, 45, 72, 81) for lead in ("", " * "))]
    got = {r["doc_id"]: r for r in license_scan.scan(docs(spark, [text for _, text in cases])).collect()}
    assert [label for i, (label, _) in enumerate(cases) if label not in got[i]["labels"]] == []
    assert all(got[i]["score"] == 1 for i in range(len(license_scan.TEMPLATES)))


def test_wrapped_templates_match_sql(spark, tmp_path):
    texts = [wrapped(text, width, lead) for _, text in license_scan.TEMPLATES for width in (20, 72) for lead in ("", "# ")]
    docs(spark, texts, extra=False).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    (part,) = (tmp_path / "documents.parquet").glob("*.parquet")
    (tmp_path / "sf").mkdir()
    part.rename(tmp_path / "sf/documents.parquet")
    same(license_scan.op9_license_scan(spark, str(tmp_path / "sf")), license_scan.OP9_SQL, str(tmp_path / "sf"))


# near duplicates


def brute_groups(texts):
    sets = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ").replace("\x0c", " ")
        w = [x for x in w.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    n = len(sets)
    links = [[j for j in range(n) if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 70 * len(sets[i] | sets[j])] for i in range(n)]
    out = {}
    for i in range(n):
        seen, stack = {i}, [i]
        while stack:
            for j in links[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        out[i] = (len(sets[i]), len(links[i]), min(seen))
    return out


def varied(rng, words, n, copies, rate):
    out = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 9, 14, 25, 60, 120]))]
        for _ in range(rng.randint(1, copies)):
            out.append(" ".join(rng.choice(words) if rng.random() < rate else w for w in base))
    return out


@pytest.mark.parametrize("seed, boundary", [(1, None), (2, 2), (3, 4), (4, 8), (5, 16), (6, 32)])
def test_jaccard_is_brute_force(spark, seed, boundary, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(ngram_join, "CELL", 3)
    monkeypatch.setattr(ngram_join, "COUNTED", 5)
    words = [a + b for a in "abcdef" for b in ("x", "yy", "zzz")]
    shared = " ".join(rng.choice(words) for _ in range(12))
    texts = varied(rng, words, 40, 6, 0.03) + [shared + " " + t for t in varied(rng, words, 30, 1, 0)] + EDGE_TEXTS
    got = {r["doc_id"]: (r["n_shingles"], r["n_similar"], r["component_id"]) for r in ngram_join.jaccard_groups(docs(spark, texts), boundary=boundary).collect()}
    assert got == brute_groups(texts)


def test_small_sets_are_enumerated(spark):
    """Small sets that share common shingles: 2-subsets meet fewer pairs than lists do, so they are chosen."""
    rng = random.Random(11)
    common_ = [f"w{i}" for i in range(9)]
    texts = [" ".join(rng.choice(common_) for _ in range(rng.randint(5, 12))) for _ in range(150)]
    chosen = []
    real = ngram_join.choose_boundary
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ngram_join, "choose_boundary", lambda shared: chosen.append((real(shared), shared.where("subset AND size <= 32").count())) or chosen[-1][0])
        got = {r["doc_id"]: (r["n_shingles"], r["n_similar"], r["component_id"]) for r in ngram_join.jaccard_groups(docs(spark, texts)).collect()}
    (boundary, pairs), subsets = chosen[0]
    assert got == brute_groups(texts) and boundary > 2 and subsets > 0 and pairs[boundary] == min(pairs.values())


def test_a_family_meets_few_times(spark, monkeypatch):
    """Near copies with long lists in common meet about once a pair, not once a list, and dense cells are exact."""
    monkeypatch.setattr(ngram_join, "CELL", 16)
    rng = random.Random(13)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(150)]
    texts = [" ".join(rng.choice(words) if rng.random() < rate else w for w in base) for rate in (0.0, 0.01, 0.03, 0.06, 0.1, 0.2) for _ in range(20)]
    met, real = [], ngram_join.in_cells

    def counted(used, main):
        lists = [r[0] for r in used.groupBy("token", "subset").count().select("count").collect()]
        placed = real(used, main)
        cells = placed.groupBy("token", "subset", "lo", "hi").agg(F.count_if(F.col("share") == F.col("lo")).alias("x"), F.count_if(F.col("share") == F.col("hi")).alias("y"))
        met.append((sum(n * (n - 1) // 2 for n in lists), sum(r["x"] * (r["x"] - 1) // 2 if r["lo"] == r["hi"] else r["x"] * r["y"] for r in cells.collect())))
        return placed

    monkeypatch.setattr(ngram_join, "in_cells", counted)
    got = {r["doc_id"]: (r["n_shingles"], r["n_similar"], r["component_id"]) for r in ngram_join.jaccard_groups(docs(spark, texts)).collect()}
    assert got == brute_groups(texts) and 3 * met[0][1] < met[0][0]


def test_few_rows_or_many(spark, monkeypatch):
    texts = varied(random.Random(12), list("abcdefgh"), 20, 4, 0.05) * 2
    monkeypatch.setattr(ngram_join, "FEW_ROWS", 0)
    got = {r["doc_id"]: (r["n_shingles"], r["n_similar"], r["component_id"]) for r in ngram_join.jaccard_groups(docs(spark, texts)).collect()}
    assert got == brute_groups(texts)


# shared helpers


def test_hot_keys_are_spread(spark):
    """90 % of the rows have one key: no partition of the joined rows holds more than a share of them."""
    rows = common.written(spark.range(40000).select(F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")).repartition(8), "hot")
    counted = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = common.join_counted(rows, counted, ["k"], "n", 40000)
        parts = got.where("k = 0").groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in parts) < 36000 / 2 and got.count() == 40000
        assert got.where("top IS NULL OR n IS NULL").count() == 0
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_rows_keep_their_numbers(spark, tmp_path):
    spark.range(5000).selectExpr("id", "id AS row").repartitionByRange(4, "id").write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t")).where("id % 2 = 0")
    got = []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "2k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got.append({r["id"]: r["uid"] for r in common.numbered(read, "uid").collect()})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got[0] == got[1] and len(set(got[0].values())) == 2500
    copies = common.numbered(read.unionByName(read), "uid").collect()
    assert len({r["uid"] for r in copies}) == 5000


def test_no_shared_folder_off_one_machine():
    class Context:
        master = "spark://host:7077"
        getConf = lambda self: self
        get = lambda self, *a: None

    class Session:
        sparkContext = Context()
        conf = Context()

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


def test_jaccard_without_links(spark):
    frame = docs(spark, ["", None, "a b c d", "e f g h"])
    assert {tuple(r) for r in ngram_join.jaccard_groups(frame).collect()} == {(0, 0, 0, 0), (1, 0, 0, 1), (2, 2, 0, 2), (3, 2, 0, 3)}
    assert ngram_join.jaccard_groups(frame.limit(0)).count() == 0
    twice = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "A b c d")], "doc_id long, text string")
    assert {tuple(r) for r in ngram_join.jaccard_groups(twice).collect()} == {(5, 2, 2, 5), (None, 2, 2, 5)}


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)]
    got = {r["node"]: r["root"] for r in ngram_join.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# the pipeline


def test_pipeline_stages(spark, data):
    import corpus_pipeline

    current = spark.read.parquet(f"{data}/documents.parquet")
    columns = current.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, data)
        assert current.columns == columns
        current = spark.createDataFrame(current.collect(), current.schema)
        kept[name] = {r["doc_id"]: r["text"] for r in current.collect()}
    ids = sorted(kept["quality_rules"])
    groups = brute_groups([kept["quality_rules"][i] for i in ids])
    assert set(kept["ngram_jaccard"]) == {ids[i] for i, (_, _, first) in groups.items() if first == i}
    clean = spark.read.parquet(f"{data}/labels.parquet").where("quality = 1").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert all(r["doc_id"] in kept["quality_rules"] for r in clean if len(texts[r["doc_id"]].split()) >= 10)
    last = corpus_pipeline.STAGES[-1][1](spark, current, data).collect()
    assert {r["doc_id"] for r in last} == set(kept["ngram_jaccard"])
    check_packing(last, 2048)


def test_copies_go_whatever_the_splits(spark, tmp_path):
    import corpus_pipeline

    texts = [" ".join(f"{c}{i // 2}" for c in "abcdef") for i in range(160)]
    docs(spark, texts).repartitionByRange(8, "doc_id").write.parquet(str(tmp_path / "d"))
    got = corpus_pipeline.ngram_jaccard(spark, spark.read.parquet(str(tmp_path / "d")), "")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # as if cores came in before the last scan
    try:
        assert sorted(r["doc_id"] for r in got.collect()) == list(range(0, 160, 2))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_pipeline_edges(spark):
    import corpus_pipeline

    rows = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate([None, "", "the cat sat on the mat and then it went away again today"] * 2)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, rows.limit(0), "").count() == 0
    got = corpus_pipeline.ngram_jaccard(spark, rows.unionByName(rows), "").collect()
    assert [r["doc_id"] for r in got if r["text"] and "cat" in r["text"]] == [2] and sum(not r["text"] for r in got) == 8
