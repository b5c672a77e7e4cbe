"""Graph documents are read once, shuffled by their id alone and written nowhere on the way."""

from pyspark.sql import functions as F


def test_documents_are_dealt_out_once(spark, monkeypatch):
    from tessera import storage
    from tessera.operators import graph

    def refused(*_):
        raise AssertionError("written on the way")

    monkeypatch.setattr(storage, "written", refused)
    monkeypatch.setattr(graph, "written", refused, raising=False)
    docs = spark.range(10).repartition("id").select(F.col("id").alias("doc_id"), F.parse_json(F.lit('{"@graph":[{"type":"Package","spdxId":"a"}]}')).alias("doc"), F.lit("x").alias("kept"))
    view = graph.flat_view(docs)
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Range (0, 10") == 1
    assert {(r.kept, r.n) for r in view.selectExpr("kept", "accounting.packages AS n").collect()} == {("x", 1)}


def test_versions_in_one_look(spark):
    from tessera.functions import versions

    kinds = [(k, v) for k in ("cyclonedx", "spdx", "other") for v in ("1.1", "1.2", "1.5", "1.5.0", "1.7", "1.8", "2.2", "SPDX-2.3", "3.0", "3.0.1", "3.0.2", " 3.0.1 ", "", "x", None)]
    rows = spark.createDataFrame(kinds, "k string, v string").select("k", "v", versions.supported(F.col("k"), F.col("v")).alias("now")).collect()
    got = {(r.k, r.v) for r in rows if r.now}
    assert got == {("cyclonedx", v) for v in ("1.2", "1.5", "1.5.0", "1.7")} | {("spdx", v) for v in ("2.2", "SPDX-2.3", "3.0", "3.0.1", " 3.0.1 ")}
