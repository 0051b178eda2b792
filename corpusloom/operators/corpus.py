"""Corpus operators: filter, truncation, dedup, tokenising and packing in order."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import collapse_blanks, dedupe_key

Tokenizer = Callable[[Column], Column]


def _python_ids(chars: bool) -> Callable[[Column], Column]:
    """Ids of characters (null for null text) or of bytes, a batch at a time. The inner function takes nothing of this module along."""

    def ids(text: pa.Array) -> pa.Array:
        if chars:
            ends = np.cumsum(pc.fill_null(pc.utf8_length(text), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            values, at = np.empty(ends[-1] if len(ends) else 0, np.int32), 0
            for x, end in zip(text, ends):
                if end > at:
                    values[at:end] = np.frombuffer(x.as_py().encode("utf-32-le"), "<u4") % 31
                    at = end
        else:
            data = [b"" if x is None else x for x in text.cast(pa.binary()).to_pylist()]
            ends, values = np.cumsum([len(x) for x in data], dtype=np.int64), np.frombuffer(b"".join(data), np.uint8).astype(np.int32)
        values += 1
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values), mask=text.is_null() if chars else None)

    return F.arrow_udf(ids, "array<int>")


def char_tokenizer(text: Column) -> Column:
    """An id a character: its code point modulo 31, from 1; 0 stays free for the end mark."""
    return _python_ids(True)(text)


def byte_tokenizer(text: Column) -> Column:
    """An id a byte of UTF-8, from 1; 0 stays free for the end mark."""
    return _python_ids(False)(text)


#: Tokenizers by name; a caller may register more. Each maps a text column to an array<int> column.
TOKENIZERS: dict[str, Tokenizer] = {"char": char_tokenizer, "byte": byte_tokenizer}


def tokenizer(name: str) -> Tokenizer:
    if name not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer {name!r}; there are {sorted(TOKENIZERS)}")
    return TOKENIZERS[name]


def text_sample(docs: DataFrame, text: str = "text", **filters) -> DataFrame:
    """(order, text) of a training sample: filtered texts with blanks collapsed, without empty ones."""
    order = filters.get("order", "doc_id")
    kept = filter_texts(docs, text=text, **filters).select(order, collapse_blanks(F.col(text)).alias(text))
    return kept.where(F.col(text) != "")


def write_text_sample(docs: DataFrame, path: str, **filters) -> None:
    """The sample as text files, an empty line after each text."""
    order = filters.get("order", "doc_id")
    text_sample(docs, **filters).orderBy(order).select("text").write.mode("overwrite").option("lineSep", "\n\n").text(path)


def filter_texts(docs: DataFrame, *, text: str = "text", order: str = "doc_id", max_docs: int | None = None, min_chars: int = 0, max_chars: int | None = None, score: str | None = None, int_score: str | None = None, min_int_score: int | None = None, min_score: float | None = None) -> DataFrame:
    """Drops null, empty and short texts and low scores (null scores pass), cuts long ones.

    The minimum counts before the cut. A limit keeps the first rows by ``order``; 0 keeps one.
    """
    t = F.col(text)
    out = docs.where(t.isNotNull() & (F.length(t) >= max(1, min_chars)))
    if score and min_score is not None:
        out = out.where(F.col(score).isNull() | (F.col(score) >= min_score))
    if int_score and min_int_score is not None:
        out = out.where(F.col(int_score).isNull() | (F.col(int_score).cast("int") >= min_int_score))
    if max_chars is not None:
        out = out.withColumn(text, F.substring(t, 1, max_chars))
    return out if max_docs is None else out.orderBy(order).limit(max(1, max_docs))


def keep_first(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row by ``order`` of each key. A partial aggregate finds it, so hot keys shrink before the shuffle.

    Keys are told apart by their digest, as they may be long.
    """
    keyed = rows.withColumn("_key", F.unhex(F.md5(key)))
    firsts = keyed.groupBy("_key").agg(F.min(order).alias("_first"))
    return keyed.join(firsts.select(F.col("_first").alias(order)), order, "left_semi").drop("_key")


def dedupe_texts(docs: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    return keep_first(docs, dedupe_key(F.col(text)), order)


def running_offsets(rows: DataFrame, order: str, size: str, name: str = "offset", parts: int = 64) -> DataFrame:
    """Adds the sum of ``size`` over all rows that come before by ``order``.

    Rows fall into ranges of the order by its quantiles; sums within a range run in parallel and those of
    the ranges, ``parts`` rows, are carried over, so no task sees the whole table.
    """
    marks = sorted(set(rows.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000)).collect()[0][0] or []))
    bucket = F.size(F.filter(F.lit(marks), lambda m: m < F.col(order))) if marks else F.lit(0)
    placed = rows.withColumn("_part", bucket)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_part").agg(F.sum(size).alias("_sum"))  # parts rows at most
    starts = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_within", F.coalesce(F.sum(size).over(within), F.lit(0)))
    return summed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_within")).drop("_part", "_start", "_within")


def pack_in_order(docs: DataFrame, block: int, *, ids: str | Column = "ids", order: str = "doc_id", end_id: int | None = 0, size: Column | None = None, kind: str = "int") -> DataFrame:
    """(block_id, input_ids): ids of all documents in order, each followed by the end id, cut into whole blocks.

    Documents without ids add nothing, not even an end id; a last partial block is dropped. Documents
    travel as one slice a block, not as single ids. ``size``, the number of ids, is for ids that are still to be
    made: offsets come from it alone, and ids are made once, after what they are made of has met its offset.
    They travel and come back as ``kind``, an integer type that holds them all.
    """
    if block < 1:
        raise ValueError("a block holds at least one id")
    own = F.col(ids) if isinstance(ids, str) else ids
    count = (F.size(own) if size is None else size).cast("long")
    counted = docs.where(count > 0).select(order, (count + (0 if end_id is None else 1)).alias("_n"))
    own = own if kind == "int" else own.cast(f"array<{kind}>")
    both = docs.join(running_offsets(counted, order, "_n", "_at"), order)
    both = both.select("_at", "_n", (F.concat(own, F.array(F.lit(end_id).cast(kind))) if end_id is not None else own).alias("_ids"))
    first, last = F.floor(F.col("_at") / block), F.floor((F.col("_at") + F.col("_n") - 1) / block)
    cut = both.select("_at", "_ids", F.explode(F.sequence(first, last)).alias("block_id"))
    start = F.greatest(F.col("block_id") * block - F.col("_at"), F.lit(0)).cast("int")
    until = F.least((F.col("block_id") + 1) * block - F.col("_at"), F.size("_ids").cast("long")).cast("int")
    part = cut.select("block_id", F.struct((F.col("_at") + start).alias("at"), F.slice("_ids", start + 1, until - start).alias("ids")).alias("s"))
    made = part.groupBy("block_id").agg(F.sort_array(F.collect_list("s")).alias("s"))  # a block's worth of ids
    whole = made.select("block_id", F.flatten(F.transform("s", lambda x: x["ids"])).alias("input_ids"))
    return whole.where(F.size("input_ids") == block)


def block_sums(ids: Column) -> Column:
    """struct(id_sum, weighted_sum) of blocks of one size: of their ids, and of these times their place from 0."""

    def sums(ids: pa.Array) -> pa.Array:
        values = ids.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1 if len(ids) else 0)
        parts = (values.sum(axis=1, dtype=np.int64), values.astype(np.int64) @ np.arange(values.shape[1]))
        return pa.StructArray.from_arrays([pa.array(p, pa.int64()) for p in parts], ["id_sum", "weighted_sum"])

    return F.arrow_udf(sums, "id_sum bigint, weighted_sum bigint")(ids)


def batches(blocks: DataFrame, size: int) -> DataFrame:
    """Adds the batch that a block falls into."""
    return blocks.withColumn("batch_id", F.floor(F.col("block_id") / size))


def shuffle_key(order: str, seed: int = 0) -> Column:
    """60 bits of the digest of a row's own order and the seed."""
    return F.conv(F.substring(F.md5(F.concat(F.col(order).cast("string"), F.lit(f":{seed}"))), 1, 15), 16, 10).cast("bigint")


def shuffled(rows: DataFrame, order: str, seed: int = 0) -> DataFrame:
    """A full shuffle that depends on the seed and the rows' own order alone."""
    return rows.orderBy(shuffle_key(order, seed), order)


def shuffle_positions(rows: DataFrame, order: str, seed: int = 0) -> DataFrame:
    """Adds position, a row's place from 0 in the shuffled order, by sums over ranges of it."""
    keyed = rows.withColumns({"_key": shuffle_key(order, seed), "_one": F.lit(1)})
    return running_offsets(keyed, "_key", "_one", "position").drop("_key", "_one")
