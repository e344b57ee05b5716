"""Every registered query against its oracle, and the keys of the contract."""

import pytest

from basketry.llm.oracles import ORACLES
from basketry.llm.queries import QUERIES
from tests.oracle_check import compare, duck

COLUMNS = {
    "op1_mix": "doc_id size source_size target taken",
    "op2_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op3_near_dedup": "doc_id n_shingles component_id kept",
    "op4_langid": "doc_id held_out lang_pred score",
    "op5_pack": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op6_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op7_pii": "doc_id n_values text",
    "op8_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op9_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op10_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op11_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op12_prefix_trie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op13_ranked_search": "item_id rank doc_id score",
}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, sf_dir, con, key):
    assert set(COLUMNS[key].split()) <= set(QUERIES[key](spark, sf_dir).columns)
    res = compare(spark, sf_dir, key, QUERIES[key], ORACLES.get(key), con)
    assert res["status"] in ("match", "rows-only"), res


def test_all_are_registered():
    assert list(QUERIES) == list(COLUMNS) and set(ORACLES) <= set(QUERIES)
