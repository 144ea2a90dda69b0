"""The pipeline stage by stage on small rows with clashing columns."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_operators import docs_of, linked, prose  # noqa: E402


def test_stages(spark, tmp_path):
    import random

    rng = random.Random(3)
    item = "benchmark passage number one about rivers and the bridges that cross them every day"
    base = [(i, prose(rng, 80)) for i in range(30)]
    texts = [*base, (40, base[0][1]), (41, base[1][1] + " tail"), (42, f"{prose(rng, 30)} {item} {prose(rng, 30)}"), (43, None), (44, "12 34"), (45, prose(rng, 30) + " mail a@b.org now")]
    docs_of(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    cols, want = d.columns, {i: t for i, t in texts if i not in (43, 44)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == cols
        path = str(tmp_path / name)
        d.write.parquet(path)
        d = spark.read.parquet(path)
        got = {r["doc_id"]: r["text"] for r in d.collect()}
        if name == "near_dedup":
            want = {i: t for i, t in want.items() if linked(list(want.items()))[i][2]}
        if name == "decontamination":
            want.pop(42)
        if name == "pii":
            want[45] = want[45].replace("a@b.org", "<EMAIL>")
        assert got == want
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in last.collect()} == set(want)


def test_empty(spark, tmp_path):
    docs_of(spark, [(1, "a")]).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
