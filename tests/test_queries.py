"""Every query of the engine against its SQL."""

import pytest

from corpusloom.plans import chat_queries, corpus_queries, run_queries
from tests.oracle import same

PARTS = (corpus_queries, chat_queries, run_queries)
CASES = [(part, name) for part in PARTS for name in part.QUERIES]


@pytest.mark.parametrize("part, name", CASES, ids=[n for _, n in CASES])
def test_query_matches_sql(spark, data, part, name):
    same(part.QUERIES[name](spark, data), part.SQL[name], data)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    row = entry.entry(spark).collect()[0]
    assert (row["train_ngrams"], row["benchmark_ngrams"], row["overlap_ngrams"], row["status"]) == (68717, 1097, 105, "fail")
    assert set(entry.oracle_sql()) <= set(entry.queries())
