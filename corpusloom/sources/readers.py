"""Readers: text, JSON lines, recursive strings, shards, evaluation results and training logs."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType

from corpusloom.functions.text import strip

TEXT_SUFFIXES = (".md", ".txt")
ALL_SUFFIXES = (".json", ".jsonl", *TEXT_SUFFIXES)


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, text): stripped, non-empty parts of whole files between blank lines, in order."""
    return paragraphs(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def paragraphs(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row a paragraph, its place in ``pos``, beside the other columns."""
    others = [c for c in texts.columns if c != text]
    parts = texts.select(*others, F.posexplode(F.split(text, "\n\n")).alias("pos", text))
    return parts.withColumn(text, strip(F.col(text))).where(F.col(text) != "")


def read_jsonl_strict(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON objects a line; blank lines are skipped, anything else than an object fails the query."""
    lines = spark.read.text(path).where(strip(F.col("value")) != "")
    checked = F.when(F.trim(F.col("value")).startswith("{"), F.from_json("value", schema, {"mode": "FAILFAST"})).otherwise(F.raise_error(F.lit("a line is no JSON object")))
    return lines.select(checked.alias("r")).select("r.*")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_report(row: DataFrame, path: str) -> None:
    """A one-row report as indented JSON, keys in the order of the columns, arrays and maps included."""
    import json

    (only,) = row.collect()
    with open(path, "w", encoding="utf-8") as out:
        json.dump(only.asDict(recursive=True), out, indent=2, ensure_ascii=False)
        out.write("\n")


@udtf(returnType="pos: int, text: string")
class JsonStrings:
    """All non-blank string values of a JSON text, however nested; keys don't count. Bad JSON has none."""

    def eval(self, payload: str):
        import json

        try:
            stack = [json.loads(payload)]
        except (TypeError, ValueError, RecursionError):
            return
        pos = 0
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                if item.strip():
                    yield pos, item
                    pos += 1
            elif isinstance(item, dict):
                stack.extend(reversed(item.values()))
            elif isinstance(item, list):
                stack.extend(reversed(item))


def json_strings(rows: DataFrame, column: str) -> DataFrame:
    """One row (pos, text) a string value, beside the other columns."""
    spark = rows.sparkSession
    spark.udtf.register("loom_json_strings", JsonStrings)
    others = [f"t.`{c}`" for c in rows.columns if c != column]
    return spark.sql(f"SELECT {', '.join([*others, 's.pos', 's.text'])} FROM {{rows}} t, LATERAL loom_json_strings(t.`{column}`) s", rows=rows)


def read_any_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, pos, text) of a file or, recursively, of a folder's files with a known suffix.

    Text files give paragraphs; JSON files, and each line of JSON-lines files, their string values;
    unreadable JSON gives nothing.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    suffix = F.lower(F.concat(F.lit("."), F.substring_index("path", ".", -1)))
    plain = paragraphs(files.where(suffix.isin(*TEXT_SUFFIXES)).select("path", F.lit(0).alias("line"), F.col("value").alias("text"))).select("path", "line", "pos", "text")
    whole = files.where(suffix == ".json").select("path", F.lit(0).alias("line"), "value")
    lines = files.where(suffix == ".jsonl").select("path", F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    return plain.unionByName(json_strings(whole.unionByName(lines), "value"))


def sample_shards(root: str, name: str) -> list[str] | None:
    """Sorted Parquet files of the sample ``sample-<N>BT`` under ``root``; None for another name, an error for no file."""
    match = re.fullmatch(r"sample-(\d+BT)", name)
    if not match:
        return None
    folder = os.path.join(root, "sample", match[1])
    found = sorted(os.path.join(at, f) for at, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))
    if not found:
        raise FileNotFoundError(f"there is no Parquet file under {folder}")
    return found


def open_source(spark: SparkSession, *, local_text: str | None = None, parquet: list[str] | None = None, root: str | None = None, name: str | None = None, order: str | None = None, shuffle_seed: int | None = None) -> DataFrame:
    """A source by the first of: a local text, a list of Parquet files, a sample's shards or a mirror's folder."""
    if local_text:
        return read_paragraphs(spark, local_text)
    files = parquet or (sample_shards(root, name) if root and name else None) or [os.path.join(root or "", name or "")]
    rows = spark.read.parquet(*files)
    if shuffle_seed is None or order is None:
        return rows
    return rows.orderBy(F.xxhash64(F.col(order), F.lit(shuffle_seed)), order)


def open_chat_source(spark: SparkSession, schema: str, *, split: str | None, train_jsonl: str | None, eval_jsonl: str | None, eval_split: str | None = "eval", mirror: str | None = None) -> DataFrame:
    """The evaluation file for its split, else the training file whatever the split, else a mirror's folder."""
    if eval_split is not None and split == eval_split and eval_jsonl:
        return read_jsonl_strict(spark, eval_jsonl, schema)
    if train_jsonl:
        return read_jsonl_strict(spark, train_jsonl, schema)
    return spark.read.parquet(os.path.join(mirror or "", split or "train"))


EVENT = "event string, step bigint, loss double, perplexity double, lr double, tokens bigint, tokens_per_sec_window double, sequences bigint, supervised_tokens double, path string, checkpoint string"


def parse_events(lines: DataFrame, schema: str = EVENT) -> DataFrame:
    """Events of log lines (line, pos): those that are a JSON object with an event; ``had_tokens`` tells a present key."""
    text = strip(F.col("line"))
    good = lines.where(text.startswith("{") & text.endswith("}"))
    read = good.select("pos", F.from_json(text, schema).alias("e"), F.get_json_object(text, "$.event").isNotNull().alias("_ok"), F.array_contains(F.json_object_keys(text), "tokens").alias("had_tokens"))
    return read.where("_ok").select("pos", "had_tokens", "e.*")


def read_events(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """Events of a log file in order; the places are the lines' own, so any number of tasks may read it."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    return parse_events(whole, schema)


def final_evaluation(text: DataFrame, step: int, tokens: int) -> DataFrame:
    """An evaluation event from the first ``loss=... perplexity=...`` of a log's whole text; no row without one."""
    number = "([0-9.]+)"
    pattern = rf"loss={number}\s+perplexity={number}"
    got = text.where(F.col("value").rlike(pattern))
    return got.select(F.lit("eval").alias("event"), F.lit(step).cast("bigint").alias("step"), F.lit(tokens).cast("bigint").alias("tokens"), *(F.regexp_extract("value", pattern, i).cast("double").alias(n) for i, n in ((1, "loss"), (2, "perplexity"))))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(task, metric, value, pos) of the first JSON file, by path, that has results; text values are kept as text."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("path"), "value")
    usable = files.where(F.get_json_object("value", "$.results").isNotNull())
    one = usable.agg(F.min_by("value", "path").alias("value")).where(F.col("value").isNotNull())
    return results_table(one)


def results_table(payloads: DataFrame, column: str = "value") -> DataFrame:
    """Unpivots payloads {results: {task: {metric: value}}}, metrics in their own order."""
    tasks = payloads.select(F.explode(F.from_json(F.get_json_object(column, "$.results"), "map<string,string>")).alias("task", "m"))
    metrics = tasks.select("task", F.posexplode(F.from_json("m", "map<string,string>")).alias("pos", "metric", "value"))
    return metrics.select("task", "metric", "value", "pos")


def read_optional_json(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    return spark.read.schema(schema).json(path, multiLine=True) if os.path.exists(path) else None


def first_rows(rows: DataFrame, order: str, n: int) -> DataFrame:
    return rows.orderBy(order).limit(n)
