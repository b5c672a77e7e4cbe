"""Documents are read once for their components and what they declare."""

from pyspark.sql import functions as F


def test_declarations_are_read_with_their_document(spark):
    from tessera.operators import coverage

    docs = {
        "a": '{"components":[{"bom-ref":"r","name":"n"},{"bom-ref":"r"},{"name":"x"},{"bom-ref":"","version":1}],"vulnerabilities":[{"id":"V1","affects":[{"ref":"r"},{"ref":"r"},{}]},{"id":"","references":[{"id":"V2"},3]},{"affects":[{"ref":"r"}]},{"id":"V4","affects":[{"ref":""}]},5]}',
        "b": '{"components":[{"bom-ref":"r"}],"packages":[{"SPDXID":"s"}]}',
        "c": '{"packages":[{"SPDXID":"s"},4],"vulnerabilities":[{"id":"V1","affects":[{"ref":"s"}]}]}',
    }
    rows = spark.createDataFrame(list(docs.items()), "doc_id string, raw string").select("doc_id", F.parse_json("raw").alias("doc"))
    frame = coverage.components_from(rows)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") == 1
    got = sorted((r.doc_id, r.ref or "", r.name, r.version or "", tuple(sorted(r.declared))) for r in frame.collect())
    assert got == sorted([("a", "r", "n", "", ("V1", "V2", "V4")), ("a", "r", "", "", ("V1", "V2", "V4")), ("a", "", "x", "", ("V2", "V4")), ("a", "", "", "", ("V2", "V4")), ("b", "r", "", "", ()), ("c", "s", "", "", ("V1",))])
