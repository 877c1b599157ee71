import os

import pytest

import __spark_entry__ as driver
import corpus_pipeline
from cases import CLASHING, DOCS, ODD_IDS, ODD_TEXTS, documents
from palisade.llm import mix

SF = "/root/testdata/sf0.001"


def test_registered():
    names = set(driver.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination",
        "source_mix"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no data folder")
def test_stages_against_the_operators_results(spark):
    """Each stage keeps just what its operator, and the brute-force form of that, says."""
    from test_decontaminate import slow as leaks
    from test_simhash import slow_components, slow_print
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_classifier"](spark, docs, SF)
    assert 0 < good.count() < docs.count()

    lined = stages["line_dedup"](spark, good, SF).toPandas().sort_values("doc_id")
    assert list(lined.columns) == docs.columns and len(lined) == good.count()
    assert (lined["n_chars"] == lined["text"].str.len()).all()

    frame = spark.createDataFrame(lined, docs.schema)
    one = stages["simhash_near_dedup"](spark, frame, SF).toPandas()
    groups = slow_components([slow_print(t) for t in lined["text"]])
    first = {}
    for i, g in zip(lined["doc_id"], groups):
        first.setdefault(g, i)
    assert set(one["doc_id"]) == set(first.values()) and len(one) == len(first)

    clean = stages["benchmark_decontamination"](
        spark, spark.createDataFrame(one, docs.schema), SF).toPandas()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = list(one["text"])
    bad = {list(one["doc_id"])[d] for d, *_ in leaks(texts, items)}
    assert set(clean["doc_id"]) == set(one["doc_id"]) - bad

    left = spark.createDataFrame(clean, docs.schema)
    drawn = stages["source_mix"](spark, left, SF)
    assert drawn.columns == docs.columns
    expected = {r["doc_id"] for r in mix.mixed(left).where("sampled").collect()}
    assert {r["doc_id"] for r in drawn.collect()} == expected

    whole = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == expected


def test_odd_rows_pass_every_stage(spark, tmp_path):
    spark.createDataFrame([(3, 1, 0), (None, 0, 0)], "doc_id bigint, quality int, toxic int"
                          ).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "a b c d e f")], "item_id bigint, text string"
                          ).write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = documents(spark, ODD_TEXTS, ODD_IDS, CLASHING)
    for docs in (odd, spark.createDataFrame([], DOCS)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
