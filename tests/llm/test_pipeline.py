from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from heightline import staging
from heightline.llm import packing, quality, toxicity
from heightline.staging import staged
from tests.llm import brute
from tests.llm.test_packing import check


def test_stages_in_order(spark, sf_dir, monkeypatch):
    """Each stage on its own input, against a plain form of its decision; all but the last keep the columns."""
    monkeypatch.setattr(quality, "LEAST_STEPS", 150)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality_classifier", "ngram_jaccard_join", "substring_dedup", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = staged(stage(spark, docs, sf_dir), name)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        after = [(r["doc_id"], r["text"]) for r in out.collect()]
        if name in ("toxicity", "quality_classifier"):
            assert not Counter(after) - Counter(before)
            module, rejected = (toxicity, 1) if name == "toxicity" else (quality, 0)
            own = module.score(docs, module.fit(docs, labels)).where(f"predicted = {rejected}").collect()
            assert Counter((r["doc_id"], r["text"]) for r in own) == Counter(before) - Counter(after)
        elif name == "ngram_jaccard_join":
            firsts = {c for i, _, c in brute.linked(before)}
            assert sorted(after) == sorted((i, t) for i, t in before if i in firsts)
        else:
            kept = dict(after)
            for (i, t), (_, n, removed, _) in zip(before, brute.repeated_windows(before)):
                assert kept[i] == t if not removed else len(brute.words(kept[i])) == n - removed
            assert all(r["n_chars"] == len(r["text"] or "") for r in out.where("text is not null").collect())
        docs = out
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect(), rows)


@pytest.mark.parametrize("rows", ["edge", "none"])
def test_run_over_edges(spark, table, edge_rows, monkeypatch, rows):
    monkeypatch.setattr(quality, "LEAST_STEPS", 60)
    folder = table(edge_rows if rows == "edge" else [])
    spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(folder + "/labels.parquet")
    before = set(staging._written.get(spark.sparkContext.applicationId, []))
    found = corpus_pipeline.run(spark, folder)
    left = {p.rsplit("/", 1)[-1].split("-")[0] for p in set(staging._written[spark.sparkContext.applicationId]) - before}
    assert "substring_dedup" in left and not left & {"toxicity", "quality_classifier", "ngram_jaccard_join", "taught", "signatures", "sets", "parsed", "profile"}
    assert tuple(found.columns) == packing.COLUMNS
    found.collect()


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
