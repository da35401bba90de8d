"""The pipeline's stages against plain versions, on the smallest tables."""

import os
import re

import pytest

import corpus_pipeline as P

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, DATA)
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        seen[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = seen[name][1]
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}
    before, after = map(rows, seen["language"])
    assert set(after) == {k for k, t in before.items() if t and any(c.isalpha() for c in t)}
    before, after = map(rows, seen["exact"])
    first = {}
    for k in sorted(before):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[k]), k)
    assert set(after) == set(first.values())
    before, after = map(rows, seen["near"])
    from test_dedup import plain_components, plain_shingles

    truth = plain_components({k: plain_shingles(t, 5) for k, t in before.items()})
    assert set(after) == {k for k in truth if truth[k] == k}
    emitted = [r.doc_id for r in seen["mixing"][1].collect()]
    assert set(emitted) <= set(after) and max(map(emitted.count, emitted)) <= 3
    pieces = seen["packing"][1].filter("start = 0").collect()
    assert sorted(r.doc_id for r in pieces) == sorted(emitted)


def test_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None


def test_stages_on_odd_rows(spark, docs, empty):
    """Nulls in any column, empty texts, repeated rows, rows without id, and columns with odd names pass through all stages."""
    for df, least in ((docs, 20), (empty, 0)):
        for _, stage in P.STAGES[:-1]:
            df = stage(spark, df, "").cache()
            assert df.columns == docs.columns and df.count() >= least
        pieces = P.STAGES[-1][1](spark, df, "")
        assert pieces.count() >= least and (least == 0 or pieces.agg({"length": "max"}).first()[0] <= 2048)


def test_a_failed_run_leaves_no_folder(spark, docs, tmp_path, monkeypatch):
    from tabulon.llm.common import shared_folder

    docs.write.parquet(f"{tmp_path}/documents.parquet")

    def fails(spark, docs, sf_dir):
        raise ValueError("stopped")

    monkeypatch.setattr(P, "STAGES", [P.STAGES[1], ("fails", fails), P.STAGES[-1]])
    with pytest.raises(ValueError, match="stopped"):
        P.run(spark, str(tmp_path))
    shared = shared_folder(spark).removeprefix("file:")
    assert [x for x in os.listdir(shared) if x.startswith("pipeline-")] == []
    monkeypatch.setattr(P, "STAGES", [P.STAGES[0], P.STAGES[-1]])
    assert P.run(spark, str(tmp_path)).count() > 0 and [x for x in os.listdir(shared) if x.startswith("pipeline-")] == []
