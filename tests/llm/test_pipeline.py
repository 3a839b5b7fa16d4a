"""The whole pipeline on a small table with planted cases, and the driver's contract."""

import os

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from helpers import DOCS, SF_DIR, groups_of, odd_rows, plain_fingerprint, prose

ITEMS = [(k, prose(700 + k, 30)) for k in range(4)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean texts 0-59, exact copies 100-, near copies 200-, junk 300-, texts with an item 400-."""
    kinds = ("en", "de", "fr")
    rows = [(k, prose(k, 120 + k, kinds[k % 3]), kinds[k % 3], "s", 1) for k in range(60)]
    rows += [(100 + k, rows[k][1], rows[k][2], "s", 1) for k in range(10)]
    near = []
    for k in range(10, 20):
        words = rows[k][1].split()
        words[40] = "changed"
        near.append((200 + k, " ".join(words), rows[k][2], "s", 1))
    junk = [(300 + k, " ".join(w + "###" for w in prose(k, 90).split()), "en", "s", 1) for k in range(8)]
    leaks = [(400 + k, prose(900 + k, 80) + " " + ITEMS[k % 4][1] + " " + prose(950 + k, 50), "en", "s", 1) for k in range(8)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows + near + junk + leaks + odd_rows() + [rows[5]], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def one_of_each_group(texts, ids):
    """The lowest id of each group that fingerprints at most three bits apart connect."""
    marks = {i: plain_fingerprint(texts[i]) for i in ids}
    find = groups_of([(a, b) for a in ids for b in ids if a < b and (marks[a] ^ marks[b]).bit_count() <= 3])
    return {find(i) for i in ids}


def test_stages_take_out_what_they_should(spark, folder, tmp_path):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    names, texts = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert (docs.columns == names) == (name != "best_fit_packing")
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    clean = set(range(60))
    assert clean <= seen["quality_rules"] and not seen["quality_rules"] & set(range(300, 308))
    assert not seen["quality_rules"] & set(range(1000, 1007))
    assert clean <= seen["language_id"]
    assert clean <= seen["simhash_near_dedup"] and not seen["simhash_near_dedup"] & set(range(100, 110))
    assert seen["simhash_near_dedup"] == one_of_each_group(texts, seen["language_id"])
    assert clean <= seen["benchmark_decontamination"] and not seen["benchmark_decontamination"] & set(range(400, 408))
    assert seen["best_fit_packing"] == seen["benchmark_decontamination"]
    lengths = docs.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in lengths) <= 4096


def test_run_equals_the_stages(spark, folder):
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()} >= set(range(60))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_the_contract_lists_all():
    names = set(contract.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{k}" for k in range(1, 14)}
    assert {"op3_benchmark_decontamination", "op9_url_filters", "op13_phrase_collocation"} <= set(contract.oracle_sql())


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
