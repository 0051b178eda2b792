"""Training-run analytics and closed forms."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOKENS_PER_STEP = 528_384
CSV_FIELDS = tuple("event step tokens tokens_b loss perplexity lr tokens_per_sec_window source".split())


def moving_average(rows: DataFrame, value: str, window: int = 25, order: str = "step", name: str = "smooth") -> DataFrame:
    """Trailing mean over at most ``window`` rows. A run's log is one ordered series, so it is one window."""
    over = Window.orderBy(order).rowsBetween(-(max(1, window) - 1), 0)
    return rows.withColumn(name, F.avg(value).over(over))


def step_rates(rows: DataFrame, done: str, time: str = "ts", order: str = "step") -> DataFrame:
    """Adds per_second and per_step of what was done since the row before (since zero for the first)."""
    over = Window.orderBy(order)
    gain = F.col(done) - F.coalesce(F.lag(done).over(over), F.lit(0))
    seconds = F.greatest(F.col(time) - F.coalesce(F.lag(time).over(over), F.lit(0.0)), F.lit(1e-9))
    steps = F.greatest(F.lit(1), F.col(order) - F.coalesce(F.lag(order).over(over), F.lit(0)))
    return rows.withColumns({"per_second": gain / seconds, "per_step": gain / steps})


def with_final_evaluation(evals: DataFrame, final: DataFrame) -> DataFrame:
    """Appends the final evaluation unless its step has one already."""
    return evals.unionByName(final.join(evals.select("step"), "step", "left_anti"), allowMissingColumns=True)


def evaluation_tokens(train: DataFrame, evals: DataFrame, tokens_per_step: int = TOKENS_PER_STEP) -> DataFrame:
    """Fills evaluations' tokens: their own, if they have the field, else the last training row's of that
    step, null included, else the step's share of the budget. ``had_tokens`` tells a present field."""
    by_step = train.groupBy(F.col("step").alias("_step")).agg(F.max_by(F.struct(F.col("tokens").alias("t")), "pos").alias("known"))
    met = evals.join(by_step, F.col("step").eqNullSafe(F.col("_step")), "left").drop("_step")
    fill = F.when(F.col("known").isNotNull(), F.col("known.t")).otherwise(F.coalesce(F.col("step"), F.lit(0)) * tokens_per_step)
    return met.withColumn("tokens", F.when(F.col("had_tokens"), F.col("tokens")).otherwise(fill)).drop("known")


def ordered_events(train: DataFrame, evals: DataFrame) -> DataFrame:
    """All rows by step, training before evaluation at the same one."""
    both = train.unionByName(evals, allowMissingColumns=True)
    return both.orderBy(F.coalesce("step", F.lit(0)), F.coalesce(F.col("event") != "train", F.lit(True)), "pos")


def csv_rows(rows: DataFrame) -> DataFrame:
    """The fixed columns as text, blank where missing, tokens also in billions."""
    have = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    billions = F.coalesce(F.format_string("%.6f", F.col("tokens") / F.lit(1e9)), F.lit("")) if "tokens" in rows.columns else F.lit("")
    billions = F.when(F.col("tokens").isNull(), "").otherwise(billions) if "tokens" in rows.columns else billions
    return rows.select(*((billions if c == "tokens_b" else have(c)).alias(c) for c in CSV_FIELDS))


def write_csv(rows: DataFrame, path: str) -> None:
    csv_rows(rows).coalesce(1).write.mode("overwrite").csv(path, header=True, emptyValue="")


def log_summary(train: DataFrame, evals: DataFrame) -> DataFrame:
    """One row: counts, first and last losses by step, and mean throughput, also from step 1000 on."""
    step = F.coalesce("step", F.lit(0))
    rate = F.col("tokens_per_sec_window")
    t = train.agg(
        F.count("*").alias("train_points"),
        F.min_by("loss", F.struct(step, "pos")).alias("first_train_loss"),
        F.max_by("loss", F.struct(step, "pos")).alias("last_train_loss"),
        F.avg(rate).alias("mean_rate"),
        F.avg(F.when(step >= 1000, rate)).alias("steady_rate"),
    )
    e = evals.agg(F.count("*").alias("eval_points"), F.min_by("loss", F.struct(step, "pos")).alias("first_eval_loss"), F.max_by("loss", F.struct(step, "pos")).alias("last_eval_loss"))
    return t.withColumn("_one", F.lit(1)).join(e.withColumn("_one", F.lit(1)), "_one").drop("_one")


def mean_loss(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.avg("loss"), F.lit(float("nan"))).alias("loss"))


def token_budget(block: Column, micro: Column, accumulate: Column, steps: Column) -> dict[str, Column]:
    per_step = block.cast("bigint") * micro * accumulate
    return {"sequences_per_step": micro.cast("bigint") * accumulate, "tokens_per_step": per_step, "planned_tokens": per_step * steps}


def learning_rate(step: Column, base: float, warmup: int, total: int, floor: float) -> Column:
    """Linear warm-up, then a cosine down to ``floor`` of the base."""
    w = max(1, warmup)
    t = max(w + 1, total)
    share = F.least(F.lit(1.0), (step - w) / F.lit(float(t - w)))
    cosine = F.lit(floor) + F.lit(1 - floor) * F.lit(0.5) * (1 + F.cos(F.pi() * share))
    return F.lit(base) * F.when(step < w, (step + 1) / F.lit(float(w))).otherwise(cosine)


def pad_to_multiple(value: Column, multiple: int) -> Column:
    return value if multiple <= 1 else F.ceil(value / multiple) * multiple


def pruned_checkpoints(names: DataFrame, keep: int, name: str = "name") -> DataFrame:
    """Checkpoints to remove: all but the last ``keep`` by name; none if ``keep`` isn't positive."""
    if keep <= 0:
        return names.limit(0)
    return names.withColumn("_rank", F.row_number().over(Window.orderBy(F.desc(name)))).where(F.col("_rank") > keep).drop("_rank")


def config_row(spark: SparkSession, values: Mapping[str, object], allowed: Mapping[str, str]) -> DataFrame:
    """A configuration as one row; unknown keys are an error, and null keeps the default null."""
    if unknown := set(values) - set(allowed):
        raise TypeError(f"unknown settings: {sorted(unknown)}")
    return spark.createDataFrame([tuple(values.get(k) for k in allowed)], ", ".join(f"{k} {t}" for k, t in allowed.items()))
