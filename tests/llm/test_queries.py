"""Every registered text query over the smallest driver tables: its rows and columns."""

import os

import pytest

from crateline.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
# Columns the contract names, and the table whose rows are answered one to one, if any.
COLUMNS = {
    "op1": ("doc_id n_shingles component_id", "documents"),
    "op2": ("doc_id held_out score predicted", "documents"),
    "op3": ("doc_id n_tokens ids_sha256 decoded_sha256", "documents"),
    "op4": ("doc_id size source_size target taken", "documents"),
    "op5": ("doc_id n_email n_ip n_card n_phone base_sha256 spans", "documents"),
    "op6": ("doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "documents"),
    "op7": ("doc_id held_out score predicted", "documents"),
    "op8": ("query_id rank vec_id score", None),
    "op9": ("doc_id section start end n_tokens n_crossing", None),
    "op10": ("doc_id held_out lang_pred score", "documents"),
    "op11": ("doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "documents"),
    "op12": ("part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley", None),
    "op13": ("doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256", "documents"),
}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are not here")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    columns, table = COLUMNS[name.split("_")[0]]
    df = QUERIES[name](spark, SMALL)
    assert set(columns.split()) <= set(df.columns)
    rows = df.collect()
    assert rows
    if table:
        assert len(rows) == spark.read.parquet(f"{SMALL}/{table}.parquet").count()
    for r in rows:
        assert "score" not in df.columns or r.score >= 0
