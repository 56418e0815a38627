"""The stages together, and the registered queries."""

import pytest
from tests.llm.common import ROWS, documents

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    extra = [(100 + k, f"Clean document number {k} about {w} that stands alone with its own {w} words and {w} thoughts, nothing else", "en", f"s{k % 2}") for k, w in enumerate(["water", "houses", "rivers", "mountains", "music", "paper"])]
    extra.append((110, "kappa lambda mu nu xi omicron pi rho sigma tau in front of a leak", "en", "s0"))
    docs = documents(spark, [*ROWS, *extra]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "kappa lambda mu nu xi omicron pi rho sigma tau")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [k for k, _ in pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "decontamination", "source_mixing"]
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        assert set(docs.columns) <= set(out.columns) and (k == 4 or out.columns == docs.columns)
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        ids = {r.doc_id for r in now.collect()}
        if k < 4:
            assert {100 + i for i in range(6)} <= ids, name
    assert not ids & {110, 1, 2, 5, 6, 7, 13}
    got = sorted(map(str, pipeline.run(spark, str(tmp_path)).collect()))
    assert got == sorted(map(str, now.collect()))


def test_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()] == [f"op{k}" for k in range(1, 11)] and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_empty_tables(spark, tmp_path):
    documents(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "text", "probability", "residual"} <= set(out.columns)


def test_failed_stage_leaves_no_tables(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from barloom.llm._spark import checkpoint_dir

    documents(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.glob("pipeline-*"))

    def fails(spark, docs, sf_dir):
        raise ValueError("stage")

    monkeypatch.setattr(pipeline, "STAGES", [("same", lambda spark, docs, sf_dir: docs), ("fails", fails)])
    with pytest.raises(ValueError, match="stage"):
        pipeline.run(spark, str(tmp_path))
    assert set(folder.glob("pipeline-*")) == before
