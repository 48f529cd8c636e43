import corpus_pipeline
from granary.llm import common


def test_stages_hand_on_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "decontamination", "mixing", "sharding"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.keep(stage(spark, docs, data))
        assert out.columns == columns and 0 < out.count()
        if name != "mixing":
            assert out.count() < rows and out.exceptAll(docs).isEmpty()
        docs, rows = out, out.count()
    name, stage = corpus_pipeline.STAGES[-1]
    last = stage(spark, docs, data)
    assert last.count() == rows
    shards = [r["n"] for r in last.groupBy("shard").count().withColumnRenamed("count", "n").collect()]
    assert max(shards) - min(shards) <= 1


def test_pipeline_on_no_rows(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.keep(stage(spark, docs, data))
    assert docs.count() == 0


def test_run_equals_its_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.keep(stage(spark, docs, data))
    assert sorted(map(tuple, corpus_pipeline.run(spark, data).collect())) == sorted(map(tuple, docs.collect()))


def test_stages_on_odd_rows(spark, data, tmp_path):
    """Nulls, empty and repeated rows, and extra columns with the stages' own names go through all of them."""
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, "s", 0), (None, docs.first()["text"], "en", None, 3), (2, None, "en", "s", 1)], docs.schema)
    docs = docs.union(docs.limit(5)).union(odd)
    for name in ("size", "shard", "slot", "key", "row", "id", "n", "component", "copies", "at", "positions", "kept", "content", "__file", "__row", "__in", "__of", "__id", "__at", "__dropped", "__leak", "__key"):
        docs = docs.selectExpr("*", f"'x' AS `{name}`")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.keep(stage(spark, docs, data))
        assert docs.columns == columns and docs.count() and not docs.where("n <> 'x' OR slot <> 'x'").count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert last.count() == docs.count() and set(last.columns) >= {"doc_id", "text", "shard", "slot"}


def test_scratch_tables_go(spark, tmp_path):
    from pathlib import Path

    with common.scratch():
        one = common.keep(spark.range(3))
        with common.scratch():
            two = common.keep(spark.range(4))
            assert two.count() == 4
        assert one.count() == 3 and not Path(two.kept_path).exists()
    assert not Path(one.kept_path).exists()


def test_slots_follow_the_curriculum(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    mixed = corpus_pipeline.keep(dict(corpus_pipeline.STAGES)["mixing"](spark, docs, data))
    order = mixed.selectExpr("doc_id", "text", "_metadata.file_path AS f", "_metadata.row_index AS r").orderBy("f", "r").collect()
    out = dict(corpus_pipeline.STAGES)["sharding"](spark, mixed, data).orderBy("shard", "slot").collect()
    at = {}
    for i, r in enumerate(order):
        at.setdefault(r["doc_id"], []).append(i)
    for shard in range(8):
        rows = [r for r in out if r["shard"] == shard]
        assert [r["slot"] for r in rows] == list(range(len(rows)))
        last = -1
        for r in rows:  # each row can stand after the one before
            last = min(i for i in at[r["doc_id"]] if i > last)
    texts = {r["doc_id"]: r["text"] for r in order}
    assert len(out) == len(order) and all(r["text"] == texts[r["doc_id"]] for r in out)
