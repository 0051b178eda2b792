"""Shared helpers: row numbers, joins by counts, text expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.tables import discard, fresh_path, shared_dir, written  # noqa: F401

#: Word separators of the byte-oriented word definition ``[^\x20\x09-\x0D]+``.
SPACE = r"[\x20\x09-\x0D]+"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df`` whatever their names."""
    return [F.col(quoted(c)) for c in df.columns]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _is_file_scan(df: DataFrame) -> bool:
    """Whether ``df`` is a table of files with no more than columns chosen and rows filtered."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and plan.children().isEmpty()


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number a row that is the same at each scan, however the files are split between tasks.

    It is the row's place in its Parquet file beside the file's place among all paths (a list that the
    driver's own index holds as well). Rows from elsewhere are written once with their numbers.
    """
    spark = df.sparkSession
    try:
        if "_metadata" in map(str.lower, df.columns) or not _is_file_scan(df):
            raise AnalysisException("no file scan")
        paths = sorted(r[0] for r in df.select("_metadata.file_path").distinct().collect())
        at = df.select(*own_columns(df), F.col("_metadata.file_path").alias("_loom_file"), F.col("_metadata.row_index").alias("_loom_index"))
    except AnalysisException:
        return written(df.withColumn(name, F.monotonically_increasing_id()), "numbered")
    files = spark.createDataFrame([(p, i << 40) for i, p in enumerate(paths)], "_loom_file string, _loom_base long")
    return at.join(F.broadcast(files), "_loom_file").select(*own_columns(df), (F.col("_loom_base") + F.col("_loom_index")).alias(name))


#: Keys that ``join_counted`` broadcasts at most.
HOT_KEYS, COLD_ROWS = 100_000, 1000


def join_counted(rows: DataFrame, counted: DataFrame, key: list[str], n: str, total: int) -> DataFrame:
    """Left join of ``rows``, ``total`` of them, with one row a key, whose column ``n`` is the number of rows that hold it.

    Rows of hot keys, those of more than COLD_ROWS rows and more than the HOT_KEYS-th part of all, meet
    their key by broadcast alone (HOT_KEYS keys at most, as counts sum up to ``total``); all others by a
    shuffled join. ``rows`` is read twice: pass a scan or a written table.
    """
    hot = F.col(n) > max(COLD_ROWS, total // HOT_KEYS)
    frequent = F.broadcast(counted.where(hot))
    there = rows.join(frequent, key)
    rest = rows.join(F.broadcast(counted.where(hot).select(*key)), key, "left_anti").join(counted.where(~hot), key, "left")
    return there.unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. The fast ``lower`` serves texts of ASCII bytes, where it does the same."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """Array of the runs of characters other than space and \\t to \\r; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, and only where the expression is reached."""
    return F.get(F.transform(F.array(value), use), 0)


def here(value: Column) -> Column:
    """``value``, worked out once in this step: no filter that uses it is moved before it, to work it out again."""
    return F.when(F.spark_partition_id() >= 0, value)
