"""The pipeline's stages one by one and together on planted cases."""

import pytest

import corpus_pipeline
from tests.llm.data import SCHEMA, sentence


@pytest.fixture
def folder(spark, tmp_path):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    rows = [(i, f"{sentence(45)} {'zorblax' if i % 5 == 1 else ''}\nfooter line", "en", "a", 0) for i in range(120)]
    rows += [(500, f"{sentence(30)} {item} {sentence(10)}", "en", "b", 0), (501, rows[2][1], "en", "b", 0), (502, None, "en", "b", 0), (503, "", "en", "b", 0)]
    rows = [(*r[:4], len(r[1] or "")) for r in rows]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 1)) for i in range(120)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(seen["toxicity"]) == {i for i in range(120) if i % 5 != 1} | {500, 501, 502, 503}
    assert not any("footer" in (t or "") for d, t in seen["line_dedup"].items() if d < 120)
    assert 503 not in seen["simhash_near_dedup"] and 502 in seen["simhash_near_dedup"]
    assert 500 not in seen["benchmark_decontamination"] and len(seen["benchmark_decontamination"]) >= 95
    out = {r.doc_id: r for r in docs.collect()}
    assert set(out) == set(seen["benchmark_decontamination"]) and all(r.restored for r in out.values())


def test_line_dedup_rates(spark):
    """Lines on 2 to 9 % of a source's pages and footers of small sources go; clean lines and copied pages stay."""
    rows = [(i, f"own {i}\n" + "\n".join(f"on {p}" for p in (2, 3, 9) if i % 100 < p), "en", "large", 0) for i in range(1000)]
    rows += [(2000 + i, "copied\npage", "en", "large", 0) for i in range(4)]
    rows += [(3000 + i, f"small {i}\nfooter" + "\nthird" * (i < 3), "en", "small", 0) for i in range(9)]
    got = {r.doc_id: r.text.split("\n") for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert not any(x.startswith("on ") or x == "footer" for t in got.values() for x in t)
    assert all(got[i][0] == f"own {i}" for i in range(1000)) and all(got[2000 + i] == ["copied", "page"] for i in range(4))
    assert all(got[3000 + i] == [f"small {i}"] + ["third"] * (i < 3) for i in range(9))


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 90
    assert len(corpus_pipeline.STAGES) == 5
