"""The pipeline against its parts, stage by stage, and the driver contract."""

import re

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from tests.conftest import SF_DIR
from tests.llm.test_operators import brute_links
from tidemark.llm import severity_model
from tidemark.llm.host_quality import text_counts
from tidemark.llm.queries import KEY


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        if name != "packing":
            assert out.columns == docs.columns
        kept[name] = (docs.collect(), out.collect())
        docs = spark.createDataFrame(kept[name][1], out.schema)

    before, after = kept["quality_rules"]
    good = {r.doc_id for r in before if (c := text_counts(r.text))[0] >= 10 and 100 * c[4] <= 20 * c[0]}
    assert {r.doc_id for r in after} == good  # no host of the fixture is bad

    before, after = kept["toxicity"]
    model = severity_model.train(spark.createDataFrame(before, spark.read.parquet(f"{SF_DIR}/documents.parquet").schema), labels)
    assert {r.doc_id for r in after} == {r.doc_id for r in before if not model.thresholds or model.probabilities(r.text)[0] < 0.5}

    before, after = kept["near_duplicates"]
    groups = brute_links([(r.doc_id, r.text) for r in before])
    assert {r.doc_id for r in after} == {d for d, _, c in groups if d == c} and len(after) == len({r.doc_id for r in after})

    before, after = kept["personal_data"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    originals = {r.doc_id: r.text for r in before}
    assert all(len(r.text.split()) == len(originals[r.doc_id].split()) for r in after)
    assert all(r.text == originals[r.doc_id] for r in after if not re.search(r'[0-9@"]', r.text))

    before, after = kept["packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}


def test_registered():
    names = queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "near_duplicates", "personal_data", "packing"]
    assert "pipeline" in names and sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert set(oracle_sql()) <= set(names) and KEY
