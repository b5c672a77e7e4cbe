"""Ranges that are prepared once answer as ranges that are walked row by row."""

from pyspark.sql import functions as F


def test_windows_answer_as_ranges(spark):
    from tessera.functions import versions

    found = ["1.2.3", "v1.2.3", " 2.10.0 ", "2.9.99", "4.0.0", "4.0.0-rc.1", "5.20.3", "5.20.3+b", "5.20.4", "01.2.3", "1.2", "", "x", None, "0.0.0", "10.0.0", "1.2.3\n", "99999999999999999999.0.0"]
    rows = spark.createDataFrame([(v,) for v in found], "version string")
    e = lambda **k: F.struct(*[F.lit(k.get(n)).cast("string").alias(n) for n in ("introduced", "fixed", "last_affected", "limit")])
    for events in (F.array(e(last_affected="5.20.3"), e(introduced="0"), e(fixed="2.10.0"), e(introduced="4.0.0")), F.array(e(introduced="0"), e(limit="9.0.0")), F.array(e(fixed="1.0.0"))):
        prepared = versions.windows(versions.prepare_range(F.lit("SEMVER"), events))
        got = rows.select("version", versions.affected_in(F.col("version"), prepared).alias("got"), versions.affected_by(F.col("version"), F.lit("SEMVER"), events).alias("want"), versions.version_text(F.col("version")).alias("t"), versions.key_text(versions.semver_key(F.col("version"))).alias("u"))
        for r in got.collect():
            assert (r.got, r.t) == (r.want, r.u), r


def test_osv_range_prepares_a_range_once(spark):
    """No range is parsed beside a component: the rows' own projection has no events."""
    from tessera.plans.bound import QUERIES

    plan = QUERIES["osv_range"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Project [doc_id") and "last_affected" not in plan.splitlines()[0]
