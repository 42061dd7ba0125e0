"""The registered queries: names, columns of their contracts, SQL where it exists, whole tables."""

import pytest
from compare import compare, duck

from __spark_entry__ import oracle_sql, queries
from tests.llm.conftest import DATA

COLUMNS = {
    "op1_": {"page_id", "text"},
    "op2_": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    "op3_": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op4_": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op5_": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op6_": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op7_": {"doc_id", "fingerprint", "component_id"},
    "op8_": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op9_": {"doc_id", "first_word", "n_words", "source_doc_id"},
    "op10_": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op11_": {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"},
    "op12_": {"word", "form", "root", "n", "n_near", "form_n"},
    "op13_": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "pipeline": {"doc_id", "piece", "length", "sequence_id", "offset"},
}
LONG = {"n_words", "n_base", "first_word", "last_word", "size", "text_crc32", "slot", "n_turns", "loss_chars", "formatted_chars", "n_tokens",
        "group_size", "start", "length", "ids_crc32", "sequence_id", "offset", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_runs", "period", "exponent_milli", "n", "n_near", "form_n",
        "n_known", "train_tokens"}


@pytest.mark.parametrize("prefix", COLUMNS)
def test_columns(spark, prefix):
    (name,) = [q for q in queries() if q.startswith(prefix)]
    frame = queries()[name](spark, DATA)
    assert COLUMNS[prefix] <= set(frame.columns)
    if prefix != "op9_":
        assert all(kind == "bigint" for c, kind in frame.dtypes if c in LONG)
    assert frame.count() > 0


@pytest.mark.parametrize("name", ["op4_chat_format", "op6_exact_dedup"])
def test_sql(spark, name):
    assert compare(spark, duck("sf0.001"), name, queries()[name], oracle_sql()[name], "sf0.001") is None
