"""Packing of a stream of documents: each shard's unfinished block is its state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def pack_stream(docs: DataFrame, block: int, *, shard: str = "shard", order: str = "doc_id", ids: str = "ids", end_id: int | None = 0) -> DataFrame:
    """(shard, block_no, input_ids) of documents (shard, order, ids), within a shard in order of arrival, and by
    ``order`` within a micro-batch. The batch operator is the one for a corpus at rest."""
    kinds = dict(docs.dtypes)

    def pack(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, rest = state.get if state.exists else (0, [])
        rest, made = list(rest), []
        for pdf in sorted((row for b in batches for row in b.itertuples(index=False)), key=lambda r: getattr(r, order)):
            own = list(getattr(pdf, ids))
            if own:
                rest += own + ([end_id] if end_id is not None else [])
            while len(rest) >= block:
                made.append((key[0], number, rest[:block]))
                number, rest = number + 1, rest[block:]
        state.update((number, rest))
        if made:
            yield pd.DataFrame(made, columns=[shard, "block_no", "input_ids"])

    rows = docs.select(shard, order, F.col(ids).cast("array<int>").alias(ids))
    return rows.groupBy(shard).applyInPandasWithState(pack, f"`{shard}` {kinds[shard]}, block_no bigint, input_ids array<int>", "number bigint, rest array<int>", "append", GroupStateTimeout.NoTimeout)
