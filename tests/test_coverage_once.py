"""Coverage reads documents once, and says the same of odd ones."""

from pyspark.sql import functions as F


def test_documents_are_read_once(spark):
    from tessera.plans.bound import QUERIES

    plan = QUERIES["coverage_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1


def test_odd_documents(spark):
    from tessera.operators import coverage

    docs = {
        1: '{"components":[{"purl":" \\u00a0","cpe":"NOASSERTION.","publisher":"NONE","supplier":{"name":"x"},"version":1,"licenses":[{"license":{"name":"MIT"}}],"hashes":[{"content":"a"}],"components":[{"purl":"p"}, 3]},{"purl":"none"},"x"],"packages":[{"versionInfo":"1"}]}',
        2: '{"packages":[{"versionInfo":"1","licenseDeclared":"NOASSERTION","licenseConcluded":" MIT","externalRefs":[{"referenceType":"cpe23","referenceLocator":"c"},{"referenceLocator":"x"}],"checksums":[{"checksumValue":"h"}]},7],"relationships":[1]}',
        3: '{"bomFormat":"CycloneDX","compositions":[1],"licenses":1}',
        4: None,
        5: "[]",
    }
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, raw string").select("doc_id", F.parse_json("raw").alias("doc"))
    got = {r.doc_id: tuple(r[c] for c in ("dependencies", "compositions", "total", "top_level", "identified", *coverage.ELEMENTS)) for r in coverage.coverage(rows).collect()}
    assert got == {
        1: (False, False, 3, 2, 2, 2, 0, 1, 0, 1, 1),
        2: (True, False, 1, 1, 1, 0, 1, 0, 1, 1, 1),
        3: (False, True, 0, 0, 0, 0, 0, 0, 0, 0, 0),
        4: (False, False, 0, 0, 0, 0, 0, 0, 0, 0, 0),
        5: (False, False, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    }
