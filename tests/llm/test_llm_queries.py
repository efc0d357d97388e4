"""The registered queries: names, columns, whole tables, and SQL where there is any."""

import oracle
import pytest
from conftest import SF_DIR

from pipekit.llm.queries import ORACLES, QUERIES

COLUMNS = {
    1: "doc_id n_tokens ids_sha256 decoded_sha256",
    2: "doc_id n_words n_hit n_items items_sha256 contaminated",
    3: "doc_id n_bytes n_removed n_spans kept_sha256",
    4: "doc_id n_words n_base first_word last_word base_labels labels score",
    5: "slot shard doc_id part n_tokens tokens_sha256",
    6: "doc_id held_out score predicted",
    7: "page_id payload_bytes payload_digest record_type refers_to",
    8: "doc_id n_bytes n_tokens over_limit",
    9: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    10: "doc_id fingerprint component_id",
    11: "query_id rank vec_id score",
    12: "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    13: "vec_id component n deviation whitened explained identity_error",
}


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == sorted(COLUMNS)


@pytest.mark.parametrize("name", QUERIES)
def test_whole_table(spark, name):
    n = int(name[2:].split("_")[0])
    found = QUERIES[name](spark, SF_DIR)
    assert set(COLUMNS[n].split()) <= set(found.columns)
    if n not in (5, 11, 13):
        assert found.count() == spark.read.parquet(f"{SF_DIR}/{'pages' if n == 7 else 'documents'}.parquet").count()


@pytest.mark.parametrize("name", ORACLES)
def test_matches_sql(spark, name):
    assert oracle.differences(QUERIES[name](spark, SF_DIR), oracle.connect(SF_DIR), ORACLES[name]) == []
