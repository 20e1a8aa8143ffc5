import corpus_pipeline as C
import pytest

import __spark_entry__ as entry
from tests.llm import brute
from tests.llm.test_models import check_packed
from trackforge.llm import secrets as S
from trackforge.llm.shared import pin


def test_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n[:2] == "op" and n[2].isdigit()} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in names and [n for n, _ in C.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "packing"]


def test_stages_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    step = {}
    for name, f in C.STAGES:
        docs = pin(f(spark, docs, small), name)
        step[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    start = spark.read.parquet(f"{small}/documents.parquet").count()
    assert len(step["language_id"]) >= 0.98 * start
    groups = brute.near_groups([(r["doc_id"], r["text"]) for r in step["language_id"]], 5, 80)
    assert sorted(r["doc_id"] for r in step["near_dedup"]) == sorted(i for i, (_, c) in groups.items() if i == c)
    clean = {h[0] for h in brute.hits([(r["doc_id"], r["text"]) for r in step["near_dedup"]], items) if not h[5]}
    assert {r["doc_id"] for r in step["decontamination"]} == clean
    before = {r["doc_id"]: r["text"] for r in step["decontamination"]}
    for r in step["secret_scan"]:
        spans = S.scan(before[r["doc_id"]])
        assert r["text"] == S.redact(before[r["doc_id"]], spans) and (not spans or r["n_chars"] == len(r["text"]))
    assert {r["doc_id"] for r in step["packing"]} == clean
    check_packed(step["packing"])


@pytest.mark.parametrize("table", ["odd", "crowded", "none"])
def test_odd_rows_in_every_stage(spark, request, small, table):
    docs = request.getfixturevalue(table)
    for _, f in C.STAGES:
        out = f(spark, docs, small)
        assert out.count() <= 2 * max(11, docs.count()) * 20
        if f is not C.packing:
            assert out.columns == docs.columns


def test_run(spark, small):
    assert C.run(spark, small).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
