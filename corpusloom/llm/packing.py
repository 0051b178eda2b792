"""Best-fit packing by exact-complement hashing.

Documents become pieces of at most ``capacity`` tokens. Only the histogram of piece lengths (at most
``capacity`` rows, whatever the corpus) reaches the driver, where the plan is made: from the longest
length down, the gap that a length leaves is looked up in the indexes of available single lengths, of
pair sums and of triple sums, and combinations that fill it exactly are consumed as often as their
availability counts allow. Lengths without an exact complement go best-fit, longest first, into the
smallest open gap that holds them.

A plan entry says where the r-th piece of a length goes, for a range of r; pieces are numbered within
their length in salted groups of a bounded size, so no length, however frequent, meets in one task.

Null text counts as empty. Every row counts, repeated ones too; an empty document is its end mark alone.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.bpe import ChunkCache, vocabulary_path
from corpusloom.llm.common import numbered, table, written

CAPACITY, END_ID = 2048, 0
#: Rows of one numbering group.
GROUP_ROWS = 100_000


@dataclass(frozen=True)
class Slot:
    """Pieces ``first`` to ``first + count - 1`` of ``length`` open at ``offset`` of sequences ``sequence``, ``sequence + 1``, ..."""

    length: int
    first: int
    count: int
    sequence: int
    offset: int


class _Index:
    """Availability of single lengths and, kept up to date, in how many ways each pair sum can be had."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        there = (counts > 0).astype(np.int64)
        self.pairs = np.convolve(there, there)  # ordered pairs by sum
        self.there = there

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if self.counts[length] == 0:
            size = len(self.there)
            self.pairs[length : length + size] -= 2 * self.there
            self.pairs[2 * length] += 1
            self.there[length] = 0

    def pair(self, total: int) -> tuple[int, int] | None:
        """The available pair of this sum with the longest first length."""
        if total < 2 or not self.pairs[total]:
            return None
        high = np.arange(total - 1, (total - 1) // 2, -1)
        high = high[high < len(self.counts)]
        ok = (self.counts[high] > 0) & (self.counts[total - high] > 0) & ((2 * high != total) | (self.counts[high] > 1))
        return (int(high[at]), int(total - high[at])) if ok.any() and (at := int(ok.argmax())) >= 0 else None

    def fill(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths whose sum is the gap, fewest first."""
        if gap < len(self.counts) and self.counts[gap] > 0:
            return (gap,)
        if (two := self.pair(gap)) is not None:
            return two
        for a in np.nonzero(self.counts[: gap - 1])[0][::-1] if gap > 2 else ():
            a = int(a)
            if 3 * a < gap:
                break
            if self.pairs[gap - a]:
                self.counts[a] -= 1  # so that the pair can't use the same piece
                rest = self.pair(gap - a)
                self.counts[a] += 1
                if rest is not None:
                    return (a, *rest)
        return None


def plan_packing(histogram: dict[int, int], capacity: int) -> list[Slot]:
    """Slots for all pieces of a histogram length -> count (lengths 1 to capacity)."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] += n
    index, used, slots, sequences = _Index(counts), np.zeros(capacity + 1, np.int64), [], 0

    def place(lengths: tuple[int, ...], n: int) -> None:
        nonlocal sequences
        offset = 0
        for length in lengths:
            slots.append(Slot(length, int(used[length]), n, sequences, offset))
            used[length] += n
            offset += length
        sequences += n

    rest: list[tuple[int, int]] = []
    for length in range(capacity, 0, -1):
        while n := int(counts[length]):
            if length == capacity:
                index.take(length, n)
                place((length,), n)
                continue
            index.counts[length] -= 1  # the piece whose gap is filled
            found = index.fill(capacity - length)
            index.counts[length] += 1
            if found is None:
                index.take(length, n)
                rest.append((length, n))
                break
            need = {x: (length, *found).count(x) for x in (length, *found)}
            times = min(int(counts[x]) // k for x, k in need.items())
            for x, k in need.items():
                index.take(x, k * times)
            place((length, *found), times)

    # best fit, longest first; equal sequences are kept together: gap -> [(lengths, number)]
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length, n in rest:
        while n:
            gap = min((g for g in open_ if g >= length), default=None)
            if gap is None:
                fit = capacity // length
                for size, many in ((fit, n // fit), (n % fit, 1)):
                    if size and many:
                        open_.setdefault(capacity - size * length, []).append(((length,) * size, many))
                n = 0
                continue
            lengths, many = open_[gap].pop()
            take = min(many, n)
            if many > take:
                open_[gap].append((lengths, many - take))
            elif not open_[gap]:
                del open_[gap]
            open_.setdefault(gap - length, []).append(((*lengths, length), take))
            n -= take
    for group in open_.values():
        for lengths, many in group:
            place(lengths, many)
    return slots


def pack(pieces: DataFrame, capacity: int, length_col: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset. ``pieces`` is read several times: pass a written table.

    Pieces of full length get a sequence of their own, numbered below zero by their place in the table.
    """
    spark = pieces.sparkSession
    placed = numbered(pieces, "_uid")
    full = placed.where(F.col(length_col) == capacity).withColumns({"sequence_id": -1 - F.col("_uid"), "offset": F.lit(0).cast("long")}).drop("_uid")
    part = placed.where(F.col(length_col) < capacity)
    counts = {r[0]: r[1] for r in part.groupBy(F.col(length_col).cast("int")).count().collect()}  # fewer rows than capacity
    slots = plan_packing(counts, capacity)
    salts = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        salts[length] = -(-n // GROUP_ROWS)
    salt_of = F.lit([int(x) for x in salts])
    part = part.withColumn("_salt", F.pmod(F.xxhash64("_uid"), F.greatest(F.get(salt_of, F.col(length_col).cast("int")), F.lit(1))))
    group = Window.partitionBy(length_col, "_salt").orderBy("_uid")
    sizes = part.groupBy(length_col, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(length_col).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(length_col, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    many = sum(int(x) for x in salts)  # rows of starts; small ones are broadcast
    starts = F.broadcast(starts) if many <= 100_000 else starts
    ranked = part.withColumn("_rank", F.row_number().over(group) - 1).join(starts, [length_col, "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_start"))
    own = sorted(slots, key=lambda s: (s.length, s.first))
    plan = spark.sparkContext.broadcast(tuple(np.array([getattr(s, k) for s in own], np.int64) for k in ("length", "first", "sequence", "offset")))
    names = pieces.columns

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        length, first, sequence, offset = plan.value
        bounds = {int(x): (int(a), int(b)) for x in np.unique(length) for a, b in [np.searchsorted(length, [x, x + 1])]}
        for pdf in batches:
            at = np.zeros(len(pdf), np.int64)
            ranks, sizes_ = pdf["_rank"].to_numpy(np.int64), pdf[length_col].to_numpy(np.int64)
            for x in np.unique(sizes_):
                a, b = bounds[int(x)]
                mine = sizes_ == x
                at[mine] = a + np.searchsorted(first[a:b], ranks[mine], side="right") - 1
            yield pdf[names].assign(sequence_id=sequence[at] + ranks - first[at], offset=offset[at])

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return full.unionByName(ranked.mapInPandas(assign, schema))


@lru_cache(maxsize=2)
def _ids(path: str) -> ChunkCache:
    """Chunks' ids as little-endian 32-bit words, by the tokenizers library's own model."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    model = whole.model
    added = {t.content: i for i, t in whole.get_added_tokens_decoder().items()}
    return ChunkCache(lambda piece: [t.id for t in model.tokenize(piece)], lambda ids: np.array(ids, "<u4").tobytes(), b"".join, added)


def cut_documents(docs: DataFrame, path: str, capacity: int, end_id: int, key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32): documents' ids and the end id, cut only where longer than capacity."""
    kind = dict(docs.dtypes)[key]
    end = np.array([end_id], "<u4").tobytes()
    names = [key, "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _ids(path)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for n, text in enumerate(batch.column("text")):
                ids = b"".join(own.of(text.as_py())) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(n)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names)

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return pack(written(cut_documents(docs, path, capacity, end_id), "pieces"), capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())
