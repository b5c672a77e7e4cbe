"""Pairs and counts of advisories without lists: the same as the lists say, and nothing of a component and a class in a shuffle."""

import pytest

COMPONENT = "component_id string, name string, version string, purl string, declared array<string>"


def _inputs(spark):
    from tessera.operators import advisories

    span = lambda *events: ("SEMVER", list(events))
    low, fixed, last = (lambda v: (v, None, None, None)), (lambda v: (None, v, None, None)), (lambda v: (None, None, v, None))
    adv = lambda i, ranges, listed=None, kind="vulnerability", name="a", eco="npm": (kind, eco, name, i, [f"C-{i}", "C-all"], None, [(name, eco, listed, ranges)])
    rows = [
        adv("A1", [span(low("0"), fixed("2.0.0"))], ["7.0.0", "odd"]),
        adv("A2", [span(low("0"), fixed("2.0.0"))], ["7.0.0", "odd"]),
        adv("A3", [span(low("1.0.0"), last("3.0.0")), span(low("2.0.0"), fixed("4.0.0"))], ["2.5.0"]),  # overlapping, and listed inside
        adv("A4", [span(low("5.0.0"))]),
        adv("A5", [("ECOSYSTEM", [low("0")])]),  # cannot be compared
        adv("A6", None, ["v1.0.0", "odd"]),
        adv("M1", [span(low("0"))], kind="malicious"),
        adv("B1", [("ECOSYSTEM", [low("0")])], name="b"),
        adv("M2", None, ["1.0.0"], kind="malicious", name="c"),
        adv("G1", [span(low("0"), fixed("2.0.0"))], name="x.org/m", eco="Go"),
    ]
    # Two entries of one package, the second of them wider.
    rows.append(("vulnerability", "npm", "a", "A7", None, None, [("a", "npm", ["8.0.0"], [span(low("0"), fixed("1.0.0"))]), ("a", "npm", None, [span(low("0"), fixed("1.5.0"))]), ("z", "npm", ["9.9.9"], None)]))
    a = spark.createDataFrame(rows, f"kind string, ecosystem string, name string, id string, aliases array<string>, summary string, affected {advisories.AFFECTED}")
    kev = spark.createDataFrame([("C-A1",), ("A3",)], "id string")
    shards = spark.createDataFrame([("npm", True), ("Go", True), ("Maven", False)], "ecosystem string, loaded boolean")
    found = ["0.5.0", "1.0.0", "v1.0.0", "1.0.0-rc.1", "1.5.0", "2.0.0", "2.5.0", "3.0.0", "3.0.1", "4.0.0", "5.0.0", "7.0.0", "8.0.0", "odd", "other", "10.0.0+b"]
    said = [None, [], ["C-A3"], ["A1", "C-A1", "C-all"], ["A7", "nothing", "A7", None]]
    comps = [(v, d, f"pkg:npm/a@{v}") for v in found for d in said] + [("1.0.0", said[3], f"pkg:npm/{n}@1.0.0") for n in "bcd"]
    comps += [("1.5.0", said[3], p) for p in ("pkg:golang/x.org/m/sub@v1.5.0", "pkg:golang/x.org/m@1.5.0", "pkg:golang/y@1.5.0", "pkg:maven/g/n@1", "pkg:npm/a", "pkg:npm/%61@0.5.0", "pkg:gem/a@1", "x", None)] + [(None, None, "pkg:npm/a")]
    frame = spark.createDataFrame([(str(i), "a", v, p, d) for i, (v, d, p) in enumerate(comps + comps[:7])], COMPONENT)
    return advisories, a, kev, shards, frame


@pytest.mark.parametrize("with_paths", [True, False])
def test_pairs_and_counts_are_what_the_lists_say(spark, with_paths):
    advisories, a, kev, shards, frame = _inputs(spark)
    a = a if with_paths else a.where("ecosystem <> 'Go'")
    lists = advisories.match(frame, advisories.index(a, kev), shards).collect()
    held = advisories.held(advisories.known(a, kev))
    got = sorted((r.component_id, r.id, r.ecosystem, r.matched_name, r.via_module, r.known_exploited, r.already_declared) for r in advisories.pairs(frame, *held, shards).collect())
    want = sorted((r.component_id, h.id, r.ecosystem, h.matched_name, r.via_module, h.known_exploited, h.already_declared) for r in lists for h in r.hits or [])
    key = lambda rows: [tuple(map(str, x)) for x in rows]
    assert key(got) == key(want) and len(got) > 100
    by_list = spark.createDataFrame([(r.status, r.n_exploited, r.n_malicious, r.n_undeclared) for r in lists], "status string, n_exploited long, n_malicious long, n_undeclared long")
    assert advisories.tally_of(frame, *held, shards).collect() == advisories.tally(by_list).collect()
    assert advisories.tally_of(frame.limit(0), *held, shards).collect() == advisories.tally(by_list.limit(0)).collect()


def test_pairs_leave_the_join_as_rows_and_counts_read_components_once(spark):
    from tessera.plans.bound import QUERIES

    plan = QUERIES["advisory_equi_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("lineitem.parquet" in line or "l_linenumber" in line and "Relation" in line for line in plan) == 1
    assert not any("Aggregate" in line for line in plan)  # no list is collected beside the components
    tally = QUERIES["verdict_tally"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_linenumber" not in tally and "collect_list" not in tally


def test_merged_windows_hold_the_same(spark):
    from pyspark.sql import functions as F

    from tessera.functions import versions

    rows = [("", "b", False), ("a", "c", True)], [("a", "b", False), ("b", "c", False)], [("a", "b", True), ("b", "b", True)], [("a", None, False), ("b", "c", True)], [("c", "d", False), ("a", "b", True)], [("a", "c", False), ("b", "c", True)], []
    made = spark.createDataFrame([(list(r),) for r in rows], "w array<struct<low:string,high:string,closed:boolean>>").withColumn("m", versions.merged(F.col("w")))
    holds = lambda c: [versions.in_windows(F.lit(t), F.col(c)) for t in ("", "a", "aa", "b", "bb", "c", "cc", "d")]
    for r in made.select("m", F.array(*holds("w")).alias("a"), F.array(*holds("m")).alias("b")).collect():
        assert r.a == r.b, r
        assert all(x.high is not None and (x.high < y.low or (x.high == y.low and not x.closed)) for x, y in zip(r.m, r.m[1:], strict=False)), r


def test_plain_package_urls_are_keyed_as_parsed_ones(spark):
    from pyspark.sql import functions as F

    from tessera.functions import purl

    found = ["pkg:npm/a-b.c_D@1.2.3", "pkg:npm/a@1.0.0+b", "pkg:npm/a@1@2", "pkg:npm/a", "pkg:npm/a@", "pkg:npm/%40s/a@1", "pkg:npm/@s/a@1", "pkg:npm/a@1#x", "pkg:npm/a@1?q=1", "pkg:npm/a@1\n", "pkg:NPM/a@1", "pkg:golang/a/b@v1", "", None]
    for r in spark.createDataFrame([(p,) for p in found], "p string").select("p", purl.key_of(F.col("p")).alias("a"), purl.purl_key(purl.purl_parts(F.col("p"))).alias("b")).collect():
        assert r.a == r.b, r
