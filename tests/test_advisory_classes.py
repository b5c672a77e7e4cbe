"""Advisories that say the same of versions are one class: rows of hits do not grow with them, lists and counts do."""


def test_hits_are_of_classes_and_counts_need_no_lists(spark):
    from tessera.operators import advisories

    span = lambda fixed: [("SEMVER", [("0", None, None, None), (None, fixed, None, None)])]
    adv = lambda i, fixed, kind="vulnerability": (kind, "npm", "a", f"A{i:02}", [f"CVE-{i}"], None, [("a", "npm", ["7.0.0"] if fixed == "2.0.0" else None, span(fixed))])
    rows = [adv(i, "2.0.0") for i in range(40)] + [adv(i, "1.0.0") for i in range(40, 43)] + [adv(90, "9.0.0", "malicious")]
    a = spark.createDataFrame(rows, f"kind string, ecosystem string, name string, id string, aliases array<string>, summary string, affected {advisories.AFFECTED}")
    kev = spark.createDataFrame([("CVE-3",), ("A41",)], "id string")
    shards = spark.createDataFrame([("npm", True)], "ecosystem string, loaded boolean")
    indexed = advisories.index(a, kev)
    classes, _ = advisories.classed(indexed)
    assert sorted(r.n for r in classes.collect()) == [3, 40]
    points = spark.createDataFrame([("npm", "a", "7.0.0", None)], "ecosystem string, target string, version string, text string")
    (hit,) = advisories.hits_of(points, classes).collect()
    assert [(f["class"], f.method, f.n, f.n_known) for f in hit.found] == [("A00", "enumerated-version", 40, 1)]
    comps = [("1", "0.5.0", ["CVE-1", "A01", "CVE-42"]), ("2", "1.5.0", []), ("3", "7.0.0", None), ("4", "8.0.0", ["CVE-1"]), ("5", "0.5.0", ["CVE-1", "A01", "CVE-42"])]
    frame = spark.createDataFrame([(i, "a", v, f"pkg:npm/a@{v}", d) for i, v, d in comps] + [("6", "a", "1.0.0", None, None)], "component_id string, name string, version string, purl string, declared array<string>")
    matched = advisories.match(frame, indexed, shards)
    got = {r.component_id: r for r in matched.collect()}
    assert {k: (r.status, r.n_hits, r.n_exploited, r.n_undeclared, r.n_malicious) for k, r in got.items()} == {
        "1": ("affected", 43, 2, 41, 1), "2": ("affected", 40, 1, 40, 1), "3": ("affected", 40, 1, 40, 1), "4": ("clear", 0, 0, 0, 1), "5": ("affected", 43, 2, 41, 1), "6": ("unknown", 0, 0, 0, 0),
    }
    assert [h.id for h in got["1"].hits] == [f"A{i:02}" for i in range(43)] and [h.id for h in got["1"].hits if h.already_declared] == ["A01", "A42"]
    tally = advisories.tally(matched)
    assert tuple(tally.first()) == (4, 1, 1, 6, 5, 162)
    assert "already_declared" not in tally._jdf.queryExecution().executedPlan().toString()
