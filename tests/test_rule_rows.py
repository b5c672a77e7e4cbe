"""Counts make no paths and labels, and presence is told by one look."""

from pyspark.sql import functions as F


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_counts_make_no_labels(spark):
    from tessera.plans.bound import QUERIES

    for name in ("findings_by_rule", "universal_rules"):
        plan = _plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "versionInfo" not in plan, name
    assert "versionInfo" in _plan(QUERIES["rule_findings"](spark, "/root/testdata/sf0.001"))


def test_presence_of_odd_values(spark):
    from tessera.operators import assertions, selectors

    said = {
        '{"a":{"b":"x"}}': True, '{"a":{"b":"[]"}}': True, '{"a":{"b":"{}"}}': True, '{"a":{"b":[]}}': False, '{"a":{"b":{}}}': False,
        '{"a":{"b":[0]}}': True, '{"a":{"b":{"c":null}}}': True, '{"a":{"b":" noAssertion "}}': False, '{"a":{"b":""}}': False, '{"a":{"b":0}}': True,
        '{"a":{"b":false}}': True, '{"a":{"b":null}}': False, '{"a":{}}': False, '{"a":[{"b":null},{"c":1}]}': True, '{"a":[{"c":1}]}': False,
        '{"a":[]}': False, '{"a":"b"}': False, '[{"a":{"b":1}}]': True, '[{"a":[{"b":1}]}]': False, "[]": False, "3": False, "null": False,
    }
    facts = assertions.Facts()
    held = assertions.holds({"exists": "a.b"}, "n", facts)
    assert list(facts.texts) == [("n", ("a", "b"))]
    rows = spark.createDataFrame([(s,) for s in said], "s string").select("s", F.parse_json("s").alias("n"))
    for level in facts.levels():
        rows = rows.selectExpr("*", *[f"{e} AS {name}" for e, name in level])
    assert {r.s: r.held for r in rows.selectExpr("s", f"{held} AS held").collect()} == said
    steps = selectors.parse("$.l[*].m[*].k")
    reach = {'{"l":[{"m":[{"k":null}]}]}': True, '{"l":[{"m":{"k":1}},3,{"m":[{"K":1}]}]}': False, '{"l":[{"m":null},{"m":[2,{"k":{}}]}]}': True, '{"l":{"m":[{"k":1}]}}': False, "{}": False, "7": False}
    rows = spark.createDataFrame([(s,) for s in reach], "s string").select("s", F.parse_json("s").alias("n"))
    assert {r.s: r.there for r in rows.selectExpr("s", f"{selectors.any_of('n', steps)} AS there").collect()} == reach
