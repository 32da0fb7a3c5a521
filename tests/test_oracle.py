"""Queries against their SQL on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
NAMES = ["kg_edges", "first_value", "best_type", "bidirectional_paths", "pattern_enumeration", "top_patterns", "one_hop_facts", "mine_bidirectional", "mine_reverse", "blind_top_facts"]
NAMES += ["sampled_relevance", "snapshot_relevance", "simple_paths_3hop", "pattern_probability_3hop", "pattern_support_3hop", "top_path_patterns_3hop", "best_paths", "pattern_bounds", "mine_counters", "pattern_names", "mine_every_supplier", "pair_names", "mine_folder", "effective_pairs", "peer_jaccard", "merged_peer_sets"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    got = entry.queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    want = con.sql(entry.oracle_sql()[name]).df()
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted(map(repr, got[order].itertuples(index=False, name=None))) == sorted(map(repr, want[order].itertuples(index=False, name=None)))


def test_every_graph_query_has_sql():
    import __spark_entry__ as entry
    from strikegraph.plans.queries import QUERIES

    assert set(QUERIES) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())
