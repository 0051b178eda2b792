"""Evaluation results: preferred metrics, comparisons, win rates and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import strip

_KINDS = ("perplexity", "word_perplexity", "byte_perplexity")
LOWER_IS_BETTER = tuple(f"{k},none" for k in (*_KINDS, "loss"))
PREFERRED = tuple(f"{k},none" for k in ("acc_norm", "acc", "exact_match", "f1", *_KINDS))
MARKER = "### Response:"
TITLE = "lm-eval Comparison"


def as_number(value: Column) -> Column:
    """JSON numbers and booleans as doubles; null for anything else."""
    return F.when(F.lower(value) == "true", F.lit(1.0)).when(F.lower(value) == "false", F.lit(0.0)).otherwise(value.try_cast("double"))


def choose_metrics(results: DataFrame, by: Sequence[str] = ("task",)) -> DataFrame:
    """(by..., metric, value): the first preferred metric that is a number, else the first number that is no
    standard error. ``results`` has task, metric, value (double or text) and pos."""
    value = as_number(F.col("value").cast("string"))
    rank = F.array_position(F.lit(list(PREFERRED)), F.col("metric"))
    place = F.when(rank > 0, rank - 1000).otherwise(F.col("pos"))
    able = results.withColumn("value", value).where(F.col("value").isNotNull() & ((rank > 0) | ~F.col("metric").endswith("_stderr,none")))
    best = able.groupBy(*by).agg(F.min_by(F.struct("metric", "value"), place).alias("b"))
    return best.select(*by, "b.metric", "b.value")


def outcome(metric: Column, candidate: Column, baseline: Column) -> Column:
    """1 where the candidate is better, -1 where worse, 0 for a tie."""
    better = F.when(metric.isin(*LOWER_IS_BETTER), baseline - candidate).otherwise(candidate - baseline)
    return F.signum(better).cast("int")


def compare(candidate: DataFrame, baselines: DataFrame) -> DataFrame:
    """(baseline, task, metric, candidate, value, outcome) of tasks with the same metric on both sides."""
    c = candidate.select("task", "metric", F.col("value").alias("candidate"))
    met = baselines.select(F.col("model").alias("baseline"), "task", "metric", "value").join(c, ["task", "metric"])
    return met.withColumn("outcome", outcome(F.col("metric"), F.col("candidate"), F.col("value")))


def win_rates(candidate: DataFrame, baselines: DataFrame) -> DataFrame:
    """(baseline, wins, comparable, rate); ties are no wins, and a baseline without a comparison has rate 0."""
    names = baselines.select(F.col("model").alias("baseline")).distinct()
    got = compare(candidate, baselines).groupBy("baseline").agg(F.count_if(F.col("outcome") > 0).alias("wins"), F.count("*").alias("comparable"))
    full = names.join(got, "baseline", "left").na.fill(0, ["wins", "comparable"])
    return full.withColumn("rate", F.when(F.col("comparable") > 0, F.col("wins") / F.col("comparable")).otherwise(F.lit(0.0)))


def comparison_table(candidate: DataFrame, baselines: DataFrame, models: Sequence[str]) -> DataFrame:
    """Tasks by model: all of the candidate's tasks, scores to four decimals, blank where a baseline has none."""
    wide = baselines.groupBy("task").pivot("model", list(models)).agg(F.format_string("%.4f", F.first("value")))
    own = candidate.select("task", "metric", F.format_string("%.4f", "value").alias("candidate"))
    return own.join(wide, "task", "left").na.fill("", list(models)).orderBy("task")


def markdown(name: str, candidate: DataFrame, baselines: DataFrame, models: Sequence[str]) -> str:
    """The comparison as a report; its rows are tasks and models, few by nature."""
    row = lambda cells: f"| {' | '.join(cells)} |"
    table = comparison_table(candidate, baselines, models).collect()
    rates = {r["baseline"]: r for r in win_rates(candidate, baselines).collect()}
    head = ["Task", "Metric", name, *models]
    out = ["# " + TITLE, "", "Candidate: `" + name + "`", "", row(head), row(["---"] * len(head)), *(row(list(r)) for r in table), "", "## Win Rates", ""]
    for m in models:
        wins, n, rate = (rates[m][k] for k in ("wins", "comparable", "rate")) if m in rates else (0, 0, 0.0)
        out.append(f"- `{m}`: {wins}/{n} = {rate:.3f}")
    return "\n".join([*out, ""])


def parse_named_path(pair: str) -> tuple[str, str]:
    name, sign, path = pair.partition("=")
    if not (name and sign and path):
        raise ValueError(f"NAME=PATH is wanted, not {pair!r}")
    return name, path


def gate(facts: DataFrame, *, tolerance: float = 0.005, status: str = "pass", controlled: float = 0.67, public: float = 0.50) -> DataFrame:
    """Adds failures, the messages of all conditions that aren't met, and status.

    ``facts``: candidate and controlled settings (tokenizer, dataset, block_size, planned_tokens, each with
    suffix _a and _b), contamination (null: no report), controlled_rate (null: no comparison) and public_rate
    (null: no baseline is comparable).
    """
    c = F.col
    ratio = c("planned_tokens_a") / c("planned_tokens_b")
    differ = lambda name, what: F.when(~c(f"{name}_a").eqNullSafe(c(f"{name}_b")), F.lit(f"controlled configs use different {what}"))
    failures = F.array(
        differ("tokenizer", "tokenizers"),
        differ("dataset", "datasets"),
        differ("block_size", "context lengths"),
        F.when(F.abs(ratio - 1) > tolerance, F.format_string(f"token budget ratio %.6f exceeds tolerance {tolerance}", ratio)),
        F.when(c("contamination").isNull(), "missing contamination report").when(c("contamination") != status, F.concat(F.lit("contamination status is "), c("contamination"))),
        F.when(c("controlled_rate").isNull(), "controlled comparison unavailable").when(c("controlled_rate") < controlled, F.format_string(f"controlled win rate %.3f below {controlled}", c("controlled_rate"))),
        F.when(c("public_rate").isNull(), "no public baseline comparisons available").when(c("public_rate") < public, F.format_string(f"public average win rate %.3f below {public}", c("public_rate"))),
    )
    out = facts.withColumn("failures", F.array_compact(failures))
    return out.withColumn("status", F.when(F.size("failures") == 0, "pass").otherwise("fail"))


def readiness(facts: DataFrame, checks: Sequence[str], tolerance: float = 0.005) -> DataFrame:
    """Adds budget_ratio, token_budget_within_tolerance and status; a check named gpu never blocks."""
    ratio = F.col("planned_tokens_a") / F.col("planned_tokens_b")
    out = facts.withColumn("budget_ratio", ratio).withColumn("token_budget_within_tolerance", F.abs(F.col("budget_ratio") - 1) <= tolerance)
    needed = [F.coalesce(F.col(n), F.lit(False)) for n in (*checks, "token_budget_within_tolerance") if n != "gpu"]
    return out.withColumn("status", F.when(F.forall(F.array(*needed), lambda x: x), "ready").otherwise("blocked"))


# Sanity prompts

PROMPT = "### System:\n%s\n\n### Instruction:\n%s\n\n" + MARKER + "\n"


def format_prompt(system: Column, instruction: Column) -> Column:
    return F.format_string(PROMPT, system, instruction)


def response_only(prompt: Column, text: Column) -> Column:
    """What follows the prompt, else what follows the last marker, else everything; stripped."""
    after = F.when(text.startswith(prompt), F.substring(text, F.length(prompt) + 1, F.length(text))).when(text.contains(MARKER), F.substring_index(text, MARKER, -1))
    return strip(F.coalesce(after, text))


def is_json(text: Column) -> Column:
    """Whether the text is one JSON value and nothing else. (Objects with repeated keys count as invalid here.)"""
    return F.coalesce(F.from_json(F.concat(F.lit('{"r":'), text, F.lit("}")), "r variant", {"allowSingleQuotes": "false"})["r"].isNotNull(), F.lit(False))


def score_responses(rows: DataFrame) -> DataFrame:
    """Adds passed (null: left to a person) and reason to rows (expected_contains, json_required, response)."""
    expected = F.coalesce(F.size("expected_contains"), F.lit(0)) > 0
    met = F.forall("expected_contains", lambda e: F.lower("response").contains(e))
    valid = is_json(F.col("response"))
    asked = F.coalesce("json_required", F.lit(False))
    return rows.withColumn("passed", F.when(expected, met).when(asked, valid)).withColumn(
        "reason",
        F.when(expected, F.when(met, "contains_expected").otherwise("missing_expected")).when(asked, F.when(valid, "valid_json").otherwise("invalid_json")).otherwise("manual_review"),
    )


def sanity_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count_if("passed").alias("passed"), F.count("passed").alias("scored"), F.count("*").alias("prompts"))


def sanity_markdown(scored: DataFrame) -> str:
    rows = scored.collect()  # a handful of prompts
    done = [r for r in rows if r["passed"] is not None]
    out = ["# Sanity report", "", f"Passed: {sum(r['passed'] for r in done)} / {len(done)}", ""]
    for r in rows:
        out += [f"## {r['id']}", "", f"- result: {r['reason']}", "", "```", r["response"], "```", ""]
    return "\n".join(out)
