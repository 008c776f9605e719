"""Queries against their DuckDB SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from linkloom.plans.catalogue import FLAGSHIP, ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = """flagship_cosine_topk tokenize_names abbrev_address dba_tail ordinal_strip numeric_keys fold_accents romanised_names composite_keys exact_key_selectivity
token_df_idf view_union_topk shortlist_context pruned_topk recall_at_k budget_sweep pair_set_features pair_idf_overlap pair_jaro_winkler assign_argmax_margin
expected_f_prefix macro_fbeta_report threshold_margin_sweep oracle_pricing group_shape_features sibling_agreement entity_complete_lists list_summary
nearest_rank_percentiles grouped_holdout dev_pool average_precision char_ngram_df hard_negatives separability within_source_agreement text_variants delivery_problems
list_sizes holdout_report halves_improve sweep_leaderboard""".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def norm(rows):
    return sorted([tuple("null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows])


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    assert norm(found.select(*columns).collect()) == norm(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_catalogue():
    assert FLAGSHIP in QUERIES and set(ORACLE_SQL) <= set(QUERIES) and len(QUERIES) >= 80
