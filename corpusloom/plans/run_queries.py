"""Queries over evaluation results and training logs, with their SQL. Their inputs are literal rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from corpusloom.operators import evals, runs
from corpusloom.sources import readers, synthetic

TASKS = ("ARC-Challenge", "ARC-Easy", "HellaSwag", "LAMBADA", "PIQA", "WinoGrande")
#: Published scores in ten-thousandths, in the order of TASKS.
SCORES = {
    "candidate": (2765, 5059, 3272, 2540, 6224, 5099),
    "gpt2": (2261, 3973, 3138, 3076, 6208, 5067),
    "opt-125m": (2210, 3990, 3160, 3856, 6202, 5178),
    "gpt-neo": (2321, 3965, 3055, 3765, 6213, 5099),
    "cerebras-111m": (2099, 3506, 2720, 1912, 5811, 4901),
    "pythia-160m": (2312, 3641, 3030, 1225, 5979, 5075),
    "smollm": (2875, 5610, 4265, 3757, 6823, 5272),
    "smollm2": (2969, 5854, 4301, 4289, 6839, 5249),
}
BASELINES = [m for m in SCORES if m != "candidate"]
METRIC_ROWS = [(m, t, "acc,none" if t in ("LAMBADA", "WinoGrande") else "acc_norm,none", v / 1e4) for m, vs in SCORES.items() for t, v in zip(TASKS, vs)]
METRICS = "model string, task string, metric string, value double"
RESULTS = json.dumps({"results": {
    "hellaswag": {"acc_norm_stderr,none": 0.01, "alias": "h", "acc,none": 0.4, "acc_norm,none": 0.42},
    "piqa": {"acc_stderr,none": 0.02, "acc,none": 0.61},
    "wiki": {"bits_stderr,none": 0.5, "bits,none": 1.25, "word_perplexity,none": 20.5},
    "odd": {"zeta_stderr,none": 0.1, "zeta,none": 3, "alpha,none": 4},
    "none": {"alias": "text", "x_stderr,none": 0.1},
}})
_SETTINGS = "tokenizer_a string, tokenizer_b string, dataset_a string, dataset_b string, block_size_a int, block_size_b int, planned_tokens_a bigint, planned_tokens_b bigint, contamination string, controlled_rate double, public_rate double"
FACTS = [
    (1, "t", "t", "d", "d", 2048, 2048, 10_001_252_352, 10_001_252_352, "pass", 0.8, 0.57),
    (2, "t", "u", "d", "e", 2048, 1024, 10_001_252_352, 9_000_000_000, "fail", 0.5, 0.25),
    (3, "t", "t", "d", "d", 2048, 2048, 10_001_252_352, 9_990_000_000, None, None, None),
]
#: event, step, tokens or None, whether it had the field, loss, rate
LOG = [("train", s, s * 528384, True, 5.0 / (1 + s / 500), 5958.0 if s == 1 else 38000.0 + s % 7) for s in (1, 10, 500, 990, 1000, 1500, 2000, 2500)]
LOG += [("eval", 500, None, False, 5.25, None), ("eval", 2000, 77, True, 3.5, None), ("eval", 2250, None, False, 3.25, None), ("eval", 1500, None, True, 3.0, None)]
LOG_ROWS = [(i, *row) for i, row in enumerate(LOG)]
LOG_SCHEMA = "pos int, event string, step bigint, tokens bigint, had_tokens boolean, loss double, tokens_per_sec_window double"
LINES = ['{"tokens": 5, "step": 1, "loss": 2.5, "event": "train"}', "noise", '  {"event": "eval", "step": 2, "loss": 3.0}  ', '{"step": 3}', '{"event": "train", "step": ', '{"event": "done"}', "{broken}"]
PROMPTS = [
    ("capital", ["beijing"], None, "It is Beijing."),
    ("missing", ["london", "uk"], None, "London only"),
    ("json", None, True, '{"city": "Paris"}'),
    ("bad_json", None, True, '{"city": "Paris"} and more'),
    ("empty_json", None, True, ""),
    ("number", None, True, " 12 "),
    ("story", None, None, "Once."),
]


def _metrics(spark):
    rows = spark.createDataFrame(METRIC_ROWS, METRICS)
    return rows.where("model = 'candidate'"), rows.where("model <> 'candidate'")


def _log(spark):
    rows = spark.createDataFrame(LOG_ROWS, LOG_SCHEMA)
    return rows.where("event = 'train'"), rows.where("event = 'eval'")


def metric_choice(spark, d):
    return evals.choose_metrics(readers.results_table(spark.createDataFrame([(RESULTS,)], "value string")))


def compare_tasks(spark, d):
    return evals.compare(*_metrics(spark)).select("baseline", "task", "outcome")


def win_rates(spark, d):
    return evals.win_rates(*_metrics(spark))


def comparison_table(spark, d):
    candidate, baselines = _metrics(spark)
    return evals.comparison_table(candidate, baselines, BASELINES)


def public_average(spark, d):
    rates = evals.win_rates(*_metrics(spark))
    return rates.agg(F.avg(F.when(F.col("comparable") > 0, F.col("rate"))).alias("public_rate"))


def gate_status(spark, d):
    out = evals.gate(spark.createDataFrame(FACTS, "id int, " + _SETTINGS))
    return out.select("id", "status", F.array_join("failures", "; ").alias("failures"))


def readiness(spark, d):
    facts = spark.createDataFrame(FACTS, "id int, " + _SETTINGS).withColumns({"same_tokenizer": F.col("tokenizer_a") == F.col("tokenizer_b"), "gpu": F.lit(False)})
    return evals.readiness(facts, ["same_tokenizer", "gpu"]).select("id", "budget_ratio", "status")


def sanity_score(spark, d):
    rows = spark.createDataFrame(PROMPTS, "id string, expected_contains array<string>, json_required boolean, response string")
    return evals.score_responses(rows).select("id", "passed", "reason")


def sanity_counts(spark, d):
    rows = spark.createDataFrame(PROMPTS, "id string, expected_contains array<string>, json_required boolean, response string")
    return evals.sanity_summary(evals.score_responses(rows))


def response_only(spark, d):
    prompt = evals.format_prompt(F.lit("S"), F.lit("I"))
    rows = spark.createDataFrame([(1, "T"), (2, "x ### Response: a ### Response:\n b "), (3, " plain ")], "id int, t string")
    return rows.select("id", evals.response_only(prompt, F.when(F.col("id") == 1, F.concat(prompt, F.lit("t"))).otherwise(F.col("t"))).alias("response"))


def moving_average(spark, d):
    train, _ = _log(spark)
    return runs.moving_average(train, "loss", 3).select("step", F.round("smooth", 9).alias("smooth"))


def step_rates(spark, d):
    train, _ = _log(spark)
    rows = runs.step_rates(train.withColumn("ts", F.col("step") * F.lit(2.0)), "tokens")
    return rows.select("step", "per_second", "per_step")


def log_summary(spark, d):
    return runs.log_summary(*_log(spark))


def eval_token_lookup(spark, d):
    return runs.evaluation_tokens(*_log(spark)).select("pos", "step", "tokens")


def csv_rows(spark, d):
    train, evaluated = _log(spark)
    rows = runs.ordered_events(train, runs.evaluation_tokens(train, evaluated))
    return runs.csv_rows(rows.withColumn("loss", F.col("loss").cast("decimal(12,6)")))


def event_lines(spark, d):
    rows = spark.createDataFrame(list(enumerate(LINES)), "pos int, line string")
    return readers.parse_events(rows).select("pos", "event", "step", "loss", "had_tokens")


def final_eval(spark, d):
    log = readers.final_evaluation(spark.createDataFrame([("x loss=2.875 perplexity=17.75 loss=9 perplexity=8",)], "value string"), 18928, 10_001_252_352)
    _, evaluated = _log(spark)
    return runs.with_final_evaluation(evaluated.select("event", "step", "tokens", "loss"), log.select("event", "step", "tokens", "loss", "perplexity"))


def lr_schedule(spark, d):
    return spark.range(0, 400).select(F.col("id").alias("step"), F.round(runs.learning_rate(F.col("id"), 4e-4, 20, 400, 0.1), 12).alias("lr"))


def token_budget(spark, d):
    row = spark.createDataFrame([(2048, 6, 43, 18928), (64, 2, 2, 5)], "block int, micro int, accumulate int, steps int")
    return row.withColumns(runs.token_budget(*map(F.col, ("block", "micro", "accumulate", "steps"))))


def vocab_padding(spark, d):
    return spark.range(1, 300).select(F.col("id").alias("size"), runs.pad_to_multiple(F.col("id"), 64).alias("padded"))


def perplexity(spark, d):
    from corpusloom.functions.text import perplexity as ppl

    rows = spark.createDataFrame([(1, 2.875), (2, 19.5), (3, 20.0), (4, 700.0)], "id int, loss double")
    return rows.select("id", F.least(F.round(ppl(F.col("loss")), 6), F.lit(1e300)).alias("perplexity"))


def mean_loss(spark, d):
    _, evaluated = _log(spark)
    return runs.mean_loss(evaluated)


def checkpoint_retention(spark, d):
    names = spark.range(1, 12).select(F.format_string("step-%06d", F.col("id") * 500).alias("name"))
    return runs.pruned_checkpoints(names, 3)


def behavior_rows(spark, d):
    return synthetic.behaviour_rows(spark, 8)


QUERIES = {f.__name__: f for f in (metric_choice, compare_tasks, win_rates, comparison_table, public_average, gate_status, readiness, sanity_score, sanity_counts, response_only, moving_average, step_rates, log_summary, eval_token_lookup, csv_rows, event_lines, final_eval, lr_schedule, token_budget, vocab_padding, perplexity, mean_loss, checkpoint_retention, behavior_rows)}


def _values(rows, names):
    def cell(v):
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v) + ("e0" if isinstance(v, float) and "e" not in repr(v) else "")

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names}))"


_M = _values(METRIC_ROWS, "model, task, metric, value")
_L = _values(LOG_ROWS, "pos, event, step, tokens, had_tokens, loss, rate")
_MET = f"FROM {_M} b JOIN {_M} c ON b.task = c.task AND b.metric = c.metric WHERE c.model = 'candidate' AND b.model <> 'candidate'"
_RATES = f"SELECT b.model AS baseline, CAST(sum((c.value > b.value)::INT) AS BIGINT) AS wins, count(*) AS comparable, sum((c.value > b.value)::INT) / count(*) AS rate {_MET} GROUP BY b.model"
_F = _values(FACTS, "id, ta, tb, da, db, ba, bb, pa, pb, con, cr, pr")
_EVAL_TOKENS = f"""SELECT pos, step, CASE WHEN had_tokens THEN tokens WHEN t.step2 IS NOT NULL THEN t.tokens2 ELSE step * 528384 END AS tokens, event, loss
FROM {_L} e LEFT JOIN (SELECT step AS step2, max_by(tokens, pos) AS tokens2 FROM {_L} WHERE event = 'train' GROUP BY step) t ON e.step = t.step2 WHERE event = 'eval'"""

SQL = {
    "metric_choice": "SELECT * FROM (VALUES ('hellaswag', 'acc_norm,none', 0.42e0), ('piqa', 'acc,none', 0.61e0), ('wiki', 'word_perplexity,none', 20.5e0), ('odd', 'zeta,none', 3e0)) AS t(task, metric, value)",
    "compare_tasks": f"SELECT b.model AS baseline, b.task, CAST(sign(c.value - b.value) AS INTEGER) AS outcome {_MET}",
    "win_rates": _RATES,
    "comparison_table": f"""SELECT task, metric, {', '.join(f"max(printf('%.4f', value)) FILTER (model = '{m}') AS \"{m}\"" for m in SCORES)} FROM {_M} GROUP BY task, metric""",
    "public_average": f"SELECT avg(rate) AS public_rate FROM ({_RATES})",
    "gate_status": f"""SELECT id, CASE WHEN len(f) = 0 THEN 'pass' ELSE 'fail' END AS status, array_to_string(f, '; ') AS failures FROM (SELECT id, list_filter([
  CASE WHEN ta <> tb THEN 'controlled configs use different tokenizers' END, CASE WHEN da <> db THEN 'controlled configs use different datasets' END,
  CASE WHEN ba <> bb THEN 'controlled configs use different context lengths' END,
  CASE WHEN abs(pa / pb - 1) > 0.005 THEN printf('token budget ratio %.6f exceeds tolerance 0.005', pa / pb) END,
  CASE WHEN con IS NULL THEN 'missing contamination report' WHEN con <> 'pass' THEN 'contamination status is ' || con END,
  CASE WHEN cr IS NULL THEN 'controlled comparison unavailable' WHEN cr < 0.67 THEN printf('controlled win rate %.3f below 0.67', cr::DOUBLE) END,
  CASE WHEN pr IS NULL THEN 'no public baseline comparisons available' WHEN pr < 0.5 THEN printf('public average win rate %.3f below 0.5', pr::DOUBLE) END], lambda x: x IS NOT NULL) AS f FROM {_F})""",
    "readiness": f"SELECT id, pa / pb AS budget_ratio, CASE WHEN ta = tb AND abs(pa / pb - 1) <= 0.005 THEN 'ready' ELSE 'blocked' END AS status FROM {_F}",
    "sanity_score": """SELECT * FROM (VALUES ('capital', TRUE, 'contains_expected'), ('missing', FALSE, 'missing_expected'), ('json', TRUE, 'valid_json'), ('bad_json', FALSE, 'invalid_json'),
  ('empty_json', FALSE, 'invalid_json'), ('number', TRUE, 'valid_json'), ('story', NULL, 'manual_review')) AS t(id, passed, reason)""",
    "sanity_counts": "SELECT 3::BIGINT AS passed, 6::BIGINT AS scored, 7::BIGINT AS prompts",
    "response_only": "SELECT * FROM (VALUES (1, 't'), (2, 'b'), (3, 'plain')) AS t(id, response)",
    "moving_average": f"SELECT step::BIGINT AS step, round(avg(loss) OVER (ORDER BY step ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 9) AS smooth FROM {_L} WHERE event = 'train'",
    "step_rates": f"""SELECT step::BIGINT AS step, g / greatest(2e0 * ds, 1e-9) AS per_second, g / greatest(1, ds) AS per_step
FROM (SELECT step, tokens - coalesce(lag(tokens) OVER (ORDER BY step), 0) AS g, step - coalesce(lag(step) OVER (ORDER BY step), 0) AS ds FROM {_L} WHERE event = 'train')""",
    "log_summary": f"""SELECT count(*) FILTER (event = 'train') AS train_points, min_by(loss, step) FILTER (event = 'train') AS first_train_loss, max_by(loss, step) FILTER (event = 'train') AS last_train_loss,
  avg(rate) FILTER (event = 'train') AS mean_rate, avg(rate) FILTER (event = 'train' AND step >= 1000) AS steady_rate,
  count(*) FILTER (event = 'eval') AS eval_points, min_by(loss, step) FILTER (event = 'eval') AS first_eval_loss, max_by(loss, step) FILTER (event = 'eval') AS last_eval_loss FROM {_L}""",
    "eval_token_lookup": f"SELECT pos, step::BIGINT AS step, tokens::BIGINT AS tokens FROM ({_EVAL_TOKENS})",
    "csv_rows": f"""SELECT event, step::VARCHAR AS step, coalesce(tokens::VARCHAR, '') AS tokens, CASE WHEN tokens IS NULL THEN '' ELSE printf('%.6f', tokens / 1e9) END AS tokens_b,
  loss::DECIMAL(12,6)::VARCHAR AS loss, '' AS perplexity, '' AS lr, coalesce(rate::VARCHAR, '') AS tokens_per_sec_window, '' AS source
FROM (SELECT event, step, tokens, loss, rate FROM {_L} WHERE event = 'train' UNION ALL SELECT event, step, tokens, loss, NULL FROM ({_EVAL_TOKENS}))""",
    "event_lines": "SELECT * FROM (VALUES (0, 'train', 1::BIGINT, 2.5e0, TRUE), (2, 'eval', 2, 3e0, FALSE), (5, 'done', NULL, NULL, FALSE)) AS t(pos, event, step, loss, had_tokens)",
    "final_eval": f"SELECT event, step::BIGINT AS step, tokens::BIGINT AS tokens, loss, NULL::DOUBLE AS perplexity FROM {_L} WHERE event = 'eval' UNION ALL SELECT 'eval', 18928, 10001252352, 2.875e0, 17.75e0",
    "lr_schedule": "SELECT step, round(4e-4 * CASE WHEN step < 20 THEN (step + 1) / 20e0 ELSE 0.1e0 + 0.9e0 * 0.5e0 * (1 + cos(pi() * least(1e0, (step - 20) / 380e0))) END, 12) AS lr FROM range(0, 400) t(step)",
    "token_budget": "SELECT *, micro::BIGINT * accumulate AS sequences_per_step, block::BIGINT * micro * accumulate AS tokens_per_step, block::BIGINT * micro * accumulate * steps AS planned_tokens FROM (VALUES (2048, 6, 43, 18928), (64, 2, 2, 5)) AS t(block, micro, accumulate, steps)",
    "vocab_padding": "SELECT size, CAST(ceil(size / 64) * 64 AS BIGINT) AS padded FROM range(1, 300) t(size)",
    "perplexity": "SELECT id, CASE WHEN loss < 20 THEN round(exp(loss), 6) ELSE 1e300 END AS perplexity FROM (VALUES (1, 2.875e0), (2, 19.5e0), (3, 20e0), (4, 700e0)) AS t(id, loss)",
    "mean_loss": f"SELECT avg(loss) AS loss FROM {_L} WHERE event = 'eval'",
    "checkpoint_retention": "SELECT printf('step-%06d', i * 500) AS name FROM range(1, 9) t(i)",
    "behavior_rows": f"SELECT c * {len(synthetic.base_rows())} + i AS ord, instruction, '' AS input, output FROM {_values([(i, *r) for i, r in enumerate(synthetic.base_rows())], 'i, instruction, output')}, range(8) r(c)",
}
