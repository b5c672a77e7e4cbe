"""Operators on small inputs, and the bound queries against SQL."""

import copy
import io
import json
import math
import numbers
import os
import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def variant(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, raw string").select("doc_id", F.try_parse_json("raw").alias("doc")).repartition(2)


def one(df):
    return df.first()[0]


def test_semver_precedence(spark):
    from tessera.functions import versions

    chain = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "v1.0.0", "1.0.1+build", "1.10.0"]
    rows = [(i, a, j, b) for i, a in enumerate(chain) for j, b in enumerate(chain)]
    df = spark.createDataFrame(rows, "i int, a string, j int, b string").select("i", "j", versions.semver_compare(F.col("a"), F.col("b")).alias("c"))
    assert all(r.c == (r.i > r.j) - (r.i < r.j) for r in df.collect())
    bad = spark.createDataFrame([("1.2",), ("x",), (None,), ("1.2.3.4",)], "a string")
    assert all(r.c is None for r in bad.select(versions.semver_compare(F.col("a"), F.lit("1.0.0")).alias("c")).collect())


@pytest.mark.parametrize(
    ("version", "events", "want"),
    [
        ("1.5.0", [{"introduced": "0"}, {"fixed": "2.0.0"}], True),
        ("2.0.0", [{"fixed": "2.0.0"}, {"introduced": "0"}], False),
        ("2.0.0", [{"introduced": "1.0.0"}, {"last_affected": "2.0.0"}], True),
        ("2.0.1", [{"introduced": "1.0.0"}, {"last_affected": "2.0.0"}], False),
        ("1.0.0", [{"introduced": "1.0.0"}, {"fixed": "1.0.0"}], False),
        ("1.0.0", [{"fixed": "2.0.0"}], None),
        ("1.0.0", [{"introduced": "0"}, {"limit": "3.0.0"}], None),
        ("1.0.0", [{"introduced": "0"}, {"fixed": "next"}], None),
        ("1.0", [{"introduced": "0"}], None),
        ("3.0.0-rc.1", [{"introduced": "0"}, {"fixed": "3.0.0"}], True),
        ("5.0.0", [{"introduced": "0"}, {"fixed": "2.0.0"}, {"introduced": "4.0.0"}], True),
        ("1.0.0", [], None),
    ],
)
def test_ranges_are_three_valued(spark, version, events, want):
    from tessera.functions import versions

    kind = "array<struct<introduced:string,fixed:string,last_affected:string,limit:string>>"
    row = spark.range(1).select(versions.affected_by(F.lit(version), F.lit("SEMVER"), F.from_json(F.lit(json.dumps(events)), kind)))
    assert one(row) is want
    assert one(spark.range(1).select(versions.affected_by(F.lit(version), F.lit("ECOSYSTEM"), F.from_json(F.lit(json.dumps(events)), kind)))) is None


def test_dotted_and_supported_and_cycles(spark):
    from tessera.functions import versions as v

    r = spark.range(1)
    assert one(r.select(v.dotted_compare(F.lit("1.10"), F.lit("1.9.9")))) == 1 and one(r.select(v.dotted_compare(F.lit("1.0"), F.lit("1")))) == 0
    for kind, spec, want in (("cyclonedx", "1.7", True), ("cyclonedx", "1.8", False), ("spdx", "SPDX-2.2", True), ("spdx", "3.0.1", True), ("spdx", "unknown", False), ("other", "1.5", False)):
        assert one(r.select(v.supported(F.lit(kind), F.lit(spec)))) is want
    for version, cycle, want in (("1.1.1k", "1.1.1", True), ("1.1.10", "1.1.1", False), ("3.2", "3", True), ("33", "3", False)):
        assert one(r.select(v.in_cycle(F.lit(version), F.lit(cycle)))) is want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("pkg:npm/%40a/b@1.0", ("npm", "@a/b", "1.0", None)),
        ("pkg:npm/a/b", ("npm", "@a/b", None, None)),
        ("pkg:golang/github.com/a/b@v1#s", ("Go", "github.com/a/b", "v1", None)),
        ("pkg:maven/org.x/y@1?type=jar", ("Maven", "org.x:y", "1", None)),
        ("pkg:maven/y@1", (None, None, "1", "no group")),
        ("pkg:deb/debian/o@3.0+b1?distro=bookworm", ("Debian:12", "o", "3.0+b1", None)),
        ("pkg:deb/debian/o@3?distro=debian-11.2", ("Debian:11", "o", "3", None)),
        ("pkg:deb/debian/o@3", (None, None, "3", "no distro")),
        ("pkg:deb/debian/o@3?distro=sid", (None, None, "3", "unknown distro")),
        ("pkg:cargo/x@1", (None, None, "1", "ecosystem not mirrored")),
        ("npm/x", (None, None, None, "not a package URL")),
        ("pkg:npm", (None, None, None, "not a package URL")),
    ],
)
def test_package_urls(spark, text, want):
    from tessera.functions import purl

    assert tuple(one(spark.range(1).select(purl.purl_key(purl.purl_parts(F.lit(text)))))) == want


def test_names(spark):
    from tessera.functions import names

    assert names.norm_text("libOpenSSL (FIPS)") == "libopenssl"
    forms = names.candidate_forms("libOpenSSL (FIPS) 1.1.1k.tar.gz")
    assert forms[0].startswith("libOpenSSL") and "openssl" in forms and len(forms) <= 64
    assert names.candidate_forms("a") == []
    r = spark.range(1)
    assert one(r.select(names.slugify(F.lit("Go.uber.org/Atomic X")))) == "go.uber.org/atomic%20x"
    assert one(r.select(names.addressable(F.lit("./api")))) is False and one(r.select(names.addressable(F.lit("a/b")))) is True
    assert one(r.select(names.html_escape(F.lit("<a href='x'>&</a>")))) == "&lt;a href=&#39;x&#39;&gt;&amp;&lt;/a&gt;"


DOC = '{"bomFormat":"CycloneDX","specVersion":"1.5","metadata":{"timestamp":"2024"},"components":[{"name":"a","version":"1","purl":"p"},{"name":"b","publisher":" ","hashes":[{"alg":null},{"alg":"MD5"}]},{"name":"NOASSERTION","n":0,"l":[]}]}'


def test_selectors(spark):
    from tessera.operators import selectors

    d = variant(spark, [("1", DOC)])
    paths = lambda s: one(d.select(F.transform(selectors.nodes(F.col("doc"), s), lambda n: n["path"])))
    assert paths("$") == ["$"]
    assert paths("$.components[*]") == [f"$.components[{i}]" for i in range(3)]
    assert paths("$.components[*].hashes[*].alg") == ["$.components[1].hashes[0].alg", "$.components[1].hashes[1].alg"]
    assert paths("$.components[?(@.name=='b')].name") == ["$.components[1].name"]
    assert paths("$.components[7]") == paths("$.metadata[*]") == paths("$.none.x") == []
    for bad in ("components", "$..name", "$.a[?(@.b>1)]", "$.a["):
        with pytest.raises(ValueError):
            selectors.parse(bad)


@pytest.mark.parametrize(
    ("assertion", "want"),
    [
        ({"exists": "version"}, [True, False, False]),
        ({"exists": "purl|publisher"}, [True, False, False]),
        ({"exists": "name"}, [True, True, False]),
        ({"exists": "n"}, [False, False, True]),
        ({"exists": "l"}, [False, False, False]),
        ({"exists": "hashes.alg"}, [False, True, False]),
        ({"exists": "$.metadata.timestamp"}, [True, True, True]),
        ({"exists": "hashes[1].alg"}, [False, True, False]),
        ({"matches": "^[ab]$"}, [True, True, False]),
        ({"equals": {"name": "A", "version": "9"}}, [True, False, False]),
        ({"not": {"exists": "version"}}, [False, True, True]),
        ({"allOf": [{"exists": "name"}, {"exists": "version"}]}, [True, False, False]),
        ({"minLength": {"field": "components", "min": 3}}, [True, True, True]),
        ({"minLength": {"field": "components", "min": 4}}, [False, False, False]),
        ({"oneOf": "anything"}, [True, True, True]),
    ],
)
def test_assertions(spark, assertion, want):
    from tessera.operators import assertions, selectors

    facts = assertions.Facts()
    held = assertions.holds(assertion, "n", facts)
    d = variant(spark, [("1", DOC)]).selectExpr("*", *[f"{e} AS {name}" for e, name in facts.known.items()])
    d = d.select("*", F.posexplode(selectors.matches(F.col("doc"), "$.components[*]")).alias("i", "n"))
    for level in facts.levels():
        d = d.selectExpr("*", *[f"{e} AS {name}" for e, name in level])
    got = d.selectExpr("i", f"{held} AS held")
    assert [r.held for r in got.orderBy("i").collect()] == want


def test_packs_and_overrides(spark):
    from tessera.operators import rules
    from tessera.plans import packs

    for pack, n in ((packs.elements_pack(), 23), (packs.devices_pack(), 16)):
        assert len(pack.rules) == n
    pack = packs.devices_pack()
    reason = "x" * 60
    for asked, code in (([None], "005"), ([{"ruleId": 3}], "005"), ([{"ruleId": "no", "to": "info", "reason": reason}], "001"), ([{"ruleId": "FDA-STAT-001", "to": "bad", "reason": reason}], "003"), ([{"ruleId": "FDA-STAT-001", "to": "info", "reason": "short"}], "004"), ([{"ruleId": "FDA-STAT-001", "to": "info", "reason": reason}] * 2, "002")):
        with pytest.raises(rules.OverrideError) as e:
            rules.check_overrides(asked, pack)
        assert e.value.code == code
    for broken in ({"id": "x", "version": "1"}, {"id": "x", "version": "1", "rules": [{"id": "a"}]}):
        with pytest.raises(ValueError):
            rules.load_pack(broken)


def test_check_reports_problems_and_findings(spark):
    from tessera.operators import rules
    from tessera.plans import packs, report

    pack = packs.devices_pack()
    docs = variant(spark, [("good", DOC), ("old", '{"bomFormat":"CycloneDX","specVersion":"1.1"}'), ("list", "[1]"), ("none", "nope"), ("empty", '{"spdxVersion":"SPDX-2.3"}')])
    results = rules.evaluate(docs, pack)
    assert {r.doc_id: r.problem for r in results.where(F.col("rule_order") == rules.DOCUMENT).collect()} == {"good": None, "old": "version not supported", "list": "not an object", "none": "not JSON", "empty": None}
    asked = rules.check_overrides([{"ruleId": "FDA-NTIA-003", "to": "info", "reason": "y" * 60}, {"ruleId": "FDA-STAT-002", "to": "info", "reason": "y" * 60}, {"ruleId": "FDA-STAT-001", "to": "info", "reason": "y" * 60}], pack)
    table = rules.rule_table(spark, pack, asked)
    runs, found = rules.rule_runs(results, table), rules.findings(results, table)
    mine = [(r.path, r.component, r.severity, r.overridden_from) for r in found.where("doc_id = 'good' AND rule_id = 'FDA-NTIA-003'").orderBy("position").collect()]
    assert mine == [("$.components[1]", "b", "info", "warning"), ("$.components[2]", "NOASSERTION", "info", "warning")]
    inert = {r.why_inert for r in runs.where("doc_id = 'good' AND rule_id = 'FDA-STAT-002'").collect()}
    assert inert == {"the rule found nothing"}
    assert [r.path for r in found.where("doc_id = 'empty' AND rule_id = 'FDA-NTIA-001'").collect()] == ["$.packages[*]"]
    gates = {r.doc_id: r for r in rules.gate(results, table, "error").collect()}
    assert gates["empty"].moved_below and not gates["good"].blocked
    # Both rules that can reach an error were lowered where they found something; elsewhere the request is inert.
    assert gates["empty"].inert_gate and not gates["good"].inert_gate
    counts = {r.doc_id: (r.error, r.warning, r.info, r.advisory) for r in rules.severity_counts(results, table).collect()}
    by = {}
    for r in found.collect():
        by.setdefault(r.doc_id, []).append(r.severity)
    assert set(counts) == {"good", "old", "empty"} and all(counts[d] == tuple(by.get(d, []).count(s) for s in rules.SEVERITIES) for d in counts)
    grouped = rules.grouped(found)
    text, page = report.as_text(grouped), report.as_html(grouped, "A & B")
    assert "FDA-NTIA-003" in text and "A &amp; B" in page
    same = report.golden_diff(report.golden(runs), report.golden(runs))
    assert {r.state for r in same.collect()} == {"same"}


WHOLE = {
    "cyclonedx": {
        "bomFormat": "CycloneDX", "specVersion": "1.6", "version": 1, "serialNumber": "urn:uuid:1",
        "metadata": {"timestamp": "2026-01-01T00:00:00Z", "lifecycles": [{"phase": "build"}], "authors": [{"name": "A"}], "tools": [{"name": "T", "version": "1"}], "properties": [{"name": f"x:{p}", "value": "yes"} for p in ("vuln-assessment", "omission-justification", "traceability-ref")], "component": {"name": "device", "version": "2", "externalReferences": [{"type": "bom", "url": "u"}]}},
        "components": [{"name": "lib", "version": "1", "publisher": "P", "purl": "pkg:npm/lib@1", "hashes": [{"alg": "SHA-256", "content": "00"}], "licenses": [{"license": {"id": "MIT"}}], "properties": [{"name": "x:support-level", "value": "active"}, {"name": "x:end-of-support", "value": "2030"}]}],
        "dependencies": [{"ref": "a"}], "compositions": [{"aggregate": "complete"}], "vulnerabilities": [{"id": "V"}], "declarations": {"signature": {"value": "s"}},
    },
    "spdx": {
        "spdxVersion": "SPDX-2.3", "documentNamespace": "urn:d", "creationInfo": {"created": "2026", "creators": ["Organization: O", "Tool: t-1"], "comment": "build"},
        "packages": [{"SPDXID": "p", "name": "lib", "versionInfo": "1", "supplier": "Organization: O", "licenseDeclared": "MIT", "checksums": [{"algorithm": "SHA256", "checksumValue": "00"}], "externalRefs": [{"referenceType": "purl"}], "annotations": [{"comment": "support"}]}],
        "relationships": [{"spdxElementId": "a"}], "annotations": [{"comment": "c"}], "externalDocumentRefs": [{"spdxDocument": "x"}],
    },
}


def without(doc, assertion, selector):
    """A document whose first node of ``selector`` lacks what ``assertion`` asks for."""
    doc = copy.deepcopy(doc)
    node = doc
    for step in [x for x in selector.replace("[*]", ".0").replace("[0]", ".0").split(".")[1:] if x]:
        node = node[int(step) if step.isdigit() else step]

    def drop(a):
        for part in a.get("allOf", [])[:1] + a.get("anyOf", []):
            drop(part)
        for path in a.get("exists", "").split("|"):
            (doc if path.startswith("$") else node).pop(path.replace("$.", "").split(".")[0], None)
        if "_property" in a:
            where, suffix = a["_property"]
            held = node
            for key in where.split(".")[:-1]:
                held = held.get(key, {})
            held[where.split(".")[-1]] = [p for p in held.get(where.split(".")[-1], []) if not p["name"].endswith(suffix)]

    drop(assertion)
    return doc


def fired_by(spark, pack, docs):
    """Rules by document that found something; the format is in the name."""
    from tessera.operators import rules

    checked = rules.evaluate(variant(spark, docs).withColumn("format", F.regexp_extract("doc_id", "cyclonedx|spdx", 0)), pack)
    out = {d: set() for d, _ in docs}
    for r in rules.findings(checked, rules.rule_table(spark, pack)).select("doc_id", "rule_id").distinct().collect():
        out[r.doc_id].add(r.rule_id)
    return out


def test_every_built_in_rule_passes_and_can_fail(spark):
    """A whole document of each format fires no rule; one without a rule's fact fires that rule."""
    from tessera.plans import packs

    for pack in (packs.elements_pack(), packs.devices_pack()):
        docs = [(f"{kind} whole", json.dumps(doc)) for kind, doc in WHOLE.items()]
        docs += [(f"{kind} {r.id}", json.dumps(without(doc, r.assertion_of(kind), r.selector_of(kind)))) for kind, doc in WHOLE.items() for r in pack.rules]
        fired = fired_by(spark, pack, docs)
        assert not fired["cyclonedx whole"] and not fired["spdx whole"]
        assert not [d for d, found in fired.items() if not d.endswith("whole") and d.split()[1] not in found]


@pytest.mark.skipif("RULE_EXAMPLES" not in os.environ, reason="RULE_EXAMPLES names a folder of example documents: <rule>/{pass,fail}.<format>.json")
def test_example_documents(spark):
    from tessera.plans import packs

    files = sorted(Path(os.environ["RULE_EXAMPLES"]).glob("*/*.json"))
    fired = {}
    for pack in (packs.elements_pack(), packs.devices_pack()):
        mine = {r.id for r in pack.rules}
        fired |= fired_by(spark, pack, [(f"{f.parent.name} {f.name}", f.read_text()) for f in files if f.parent.name in mine])
    wrong = [d for d, found in fired.items() if (d.split()[0] in found) != d.split()[1].startswith("fail")]
    assert files and not wrong and len(fired) == len(files)


def test_results_stand_beside_the_problem(spark):
    """A document of a version that is not read is checked all the same; the gate leaves its results out."""
    from tessera.operators import rules
    from tessera.plans import packs

    old = '{"bomFormat":"CycloneDX","specVersion":"1.1","components":[{"name":"a"}]}'
    bare = '{"components":[{"name":"a"}]}'
    for pack, rule in ((packs.devices_pack(), "FDA-STAT-001"), (packs.elements_pack(), "CISA-MD-004")):
        rows = variant(spark, [("old", old), ("bare", bare), ("none", "{}"), ("stated", "{}")]).withColumn("format", F.when(F.col("doc_id") == "stated", "spdx"))
        checked = rules.evaluate(rows, pack)
        docs = {r.doc_id: r for r in checked.where(F.col("rule_order") == rules.DOCUMENT).collect()}
        assert docs["old"].problem == docs["bare"].problem == "version not supported" and docs["none"].statuses is None
        at = [r.id for r in pack.rules].index(rule)
        fired = {d: [r.path for r in checked.where((F.col("doc_id") == d) & (F.col("rule_order") == at)).collect()] for d in ("old", "bare", "stated")}
        assert fired == {"old": [], "bare": ["$"], "stated": ["$"]}
        left = rules.gated(checked).collect()
        assert sorted(r.doc_id for r in left) == ["bare", "none", "old", "stated"] and not any(r.statuses for r in left)


def test_a_document_of_very_many_components(spark):
    from tessera.operators import rules

    pack = rules.load_pack({"id": "p", "version": "1", "rules": [{"id": i, "severity": "error", "appliesTo": ["cyclonedx"], "selector": s, "assert": a, "onEmptySelector": e} for i, s, a, e in [("A", "$.components[*]", {"exists": "version"}, "fire"), ("B", "$.components[*].hashes[?(@.alg=='x')].content", {"exists": "y"}, "skip"), ("C", "$.components[7]", {"exists": "name"}, "fire"), ("D", "$.services[*]", {"exists": "name"}, "pass"), ("E", "$.components[*].hashes[*]", {"exists": "$.serialNumber"}, "fire")]]})
    n = 200_000
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.lit('{"name":"n'), i, F.when(i % 1000 == 0, '","hashes":[{"alg":"x","content":{}},{"alg":"z"}]}').otherwise('","version":"1"}'))), ",")
    docs = spark.range(1).select(F.lit("big").alias("doc_id"), F.parse_json(F.concat(F.lit('{"bomFormat":"CycloneDX","specVersion":"1.5","components":['), body, F.lit("]}"))).alias("doc"))
    checked = rules.evaluate(docs, pack)
    runs = {r.rule_id: (r.status, r.n_failures) for r in rules.rule_runs(checked, rules.rule_table(spark, pack)).collect()}
    assert runs == {"A": ("ran", n // 1000), "B": ("ran", n // 1000), "C": ("ran", 0), "D": ("ran", 0), "E": ("ran", n // 500)}
    found = rules.findings(checked, rules.rule_table(spark, pack)).where("rule_id = 'B'").orderBy("position").limit(2).collect()
    assert [(r.path, r.position) for r in found] == [("$.components[0].hashes[0].content", [0, 0]), ("$.components[1000].hashes[0].content", [1000, 0])]


def test_selectors_share_their_lists():
    from tessera.operators import selectors

    trie = selectors.Trie()
    tags = [trie.add("spdx", s)[0] for s in ("$", "$.a.b", "$.a[*]", "$.a[*].c[*]", "$.a[*].d", "$.a[*].c[*].e[0]", "$.a[?(@.k=='v')]")]
    assert tags == [0, 0, 1, 2, 1, 2, 3] and [len(level) for level in trie.levels()] == [2, 1]
    assert trie.add("cyclonedx", "$.a[*]")[0] == 4


def test_component_trees_have_no_limit(spark):
    from tessera.operators import coverage

    deep = '{"name":"x"}'
    for _ in range(120):
        deep = '{"name":"y","components":[' + deep + "]}"
    got = coverage.component_tree(variant(spark, [("d", '{"components":[' + deep + "]}"), ("e", "{}"), ("f", "x"), ("g", '{"components":[1,{"components":{}}]}')])).collect()
    assert max(r.level for r in got) == 120 and len(got) == 122
    assert {r.path for r in got if r.doc_id == "g"} == {"$.components[1]"}
    wide = F.concat(F.lit('{"components":['), F.array_join(F.array_repeat(F.lit('{"name":"n","components":[{"name":"m"}]}'), 500), ","), F.lit("]}"))
    many = spark.range(2000).select(F.col("id").cast("string").alias("doc_id"), F.parse_json(wide).alias("doc"))
    assert coverage.component_tree(many).count() == 2_000_000


def test_components_from_documents(spark):
    from tessera.operators import coverage

    nested = '{"bomFormat":"CycloneDX","packages":[{"name":"no"}],"components":[{"bom-ref":"r1","name":"a","version":"1","purl":"pkg:npm/a@1","components":[{"bom-ref":"r2"}]}],"vulnerabilities":[{"id":"V1","references":[{"id":"V2"},{}],"affects":[{"ref":"r2"}]},{"id":"V3"}]}'
    flat = '{"packages":[{"SPDXID":"s","name":"p","versionInfo":"2","externalRefs":[{"referenceType":"cpe","referenceLocator":"c"},{"referenceType":"purl","referenceLocator":"pkg:x/p"}]}]}'
    got = {(r.doc_id, r.ref): (r.name, r.version, r.purl, sorted(r.declared)) for r in coverage.components_from(variant(spark, [("n", nested), ("f", flat), ("x", "1")])).collect()}
    assert got == {("n", "r1"): ("a", "1", "pkg:npm/a@1", ["V3"]), ("n", "r2"): ("", None, None, ["V1", "V2", "V3"]), ("f", "s"): ("p", "2", "pkg:x/p", [])}


def test_damaged_files_are_problems(spark):
    from tessera.sources import documents, tables

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.json", "fine " * 50)
        z.writestr("b.json", "b" * 400)
    data = bytearray(out.getvalue())
    at = data.index(b"b.json") + 6
    data[at : at + 4] = b"\xff\xff\xff\xff"
    files = spark.createDataFrame([("ok.zip", bytes(data)), ("none.zip", None), ("bad.zip", b"PK")], "path string, content binary")
    got = {(r.path, r.entry): r.problem is None for r in documents.read_archives(files).collect()}
    assert got == {("ok.zip", "a.json"): True, ("ok.zip", "b.json"): False, ("none.zip", None): False, ("bad.zip", None): False}
    long = "x" * 200_000
    sheets = [("long.csv", f"name,version\n{long},1\n".encode()), ("gap.csv", b"\nname\n\n\na\n"), ("empty.csv", b""), ("null.csv", None), ("bad.pdf", b"%PDF-1.4\n1 0 obj << /Filter /FlateDecode >>\nstream\nnot deflate\nendstream\nendobj")]
    rows = tables.read_tables(spark.createDataFrame(sheets, "path string, content binary")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.path, []).append((r.row_number, r.problem))
    assert by["long.csv"] == [(0, None), (1, None)] and by["gap.csv"] == [(0, None), (3, None)]
    assert by["empty.csv"] == [(-1, "no rows")] and by["null.csv"] == [(-1, "no content")]
    assert len(by["bad.pdf"]) == 2 and all(n == -1 and p for n, p in by["bad.pdf"])
    assert [r.problem for r in tables.read_attachments(spark.createDataFrame([("x", None)], "path string, content binary")).collect()] == []


def test_predicted_streams():
    import zlib

    from tessera.sources import tables

    raw = bytes([1, 5, 1, 1, 2, 3, 3, 3, 4, 1, 1, 1])
    head = b"/Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 3 >>"
    assert list(tables._inflate(head, zlib.compress(raw))) == [5, 6, 7, 8, 9, 10, 9, 10, 11]


def test_names_given_back_and_filled_once(spark):
    from tessera.functions import names, texts

    r = spark.range(1)
    assert one(r.select(names.unslug(names.slugify(F.lit("a b/c+d%20é"))))) == "a b/c+d%20é"
    filled = texts.fill(F.lit("{a} {b} {c} {"), {"a": F.lit("{b}"), "b": F.lit("x"), "c": F.lit(None).cast("string")})
    assert one(r.select(filled)) == "{b} x {c} {"
    said = texts.attestation(["On {date}: {sha256}", "{engineVersion} {packId} {packVersion} {other}"], *map(F.lit, ("d", "s", "e", "p", "v")))
    assert one(r.select(said)) == "On d: s\n\ne p v {other}"
    for logo, safe in (("https://", False), ("https://a b", False), ("HTTPS://a/b", True), ("http://a", False), ("data:image/png;base64,AA+/=", True), ("data:text/html;base64,AA", False), ("data:image/png;base64,", False), ("data:image/svg+xml;base64,A<", False)):
        assert (one(r.select(texts.safe_logo(F.lit(logo)))) is not None) == safe, logo
    assert one(r.select(names.why_no_answer(F.lit("ab12" * 3)))) == "not in the dictionary"
    rows = spark.createDataFrame([("k", float(v)) for v in (4, 1, 3, 2, 2)] + [("l", None), ("m", 5.0)], "k string, v double")
    assert {x.k: x.upper_median for x in texts.grouped_upper_median(rows, "k", "v").collect()} == {"k": 2.0, "m": 5.0}


def test_support_data_and_baselines(spark):
    from tessera.operators import support
    from tessera.plans import identity

    names = spark.createDataFrame([(n,) for n in ("Node.js", "libcurl", "acme/redis", "spring-core", "other", "redis", "redis")], "name string")
    products = spark.createDataFrame([(p,) for p in ("nodejs", "node-js", "curl", "redis", "spring")], "product string")
    assert {r.name: r["product"] for r in support.match_products(names, products).collect()} == {"Node.js": "node-js", "libcurl": "curl", "acme/redis": "redis", "spring-core": "spring", "redis": "redis"}
    c = support.product_coverage(names, products).first()
    assert (c.names, c.instances, c.names_matched, c.instances_matched, c.names_percent) == (6, 7, 5, 6, 83.3)
    lines = spark.createDataFrame([("redis", 1, "7", "false", None, "7.1"), ("redis", 0, "8", "2030-01-01", True, None), ("mysql", 0, "8", "true", None, None)], "product string, position int, cycle string, eol string, lts boolean, latest string")
    data = support.product_data(names, products, lines, "s", "2026-01-01").collect()
    assert [(r["product"], [x.cycle for x in r.cycles]) for r in data] == [("redis", ["8", "7"])]
    known = spark.createDataFrame([("zig", "pkg:z"), ("libfoo", "pkg:f"), ("foo", "pkg:o")], "__k string, got string")
    rows = spark.createDataFrame([("libzig",), ("libfoo",), ("node-lib",)], "input string").selectExpr("input", "cast(null as string) purl", "cast(null as string) perturbation")
    assert {r.input: r.got for r in identity.prefix_strip(rows, known).collect()} == {"libzig": "pkg:z", "libfoo": "pkg:o", "node-lib": None}
    assert [r.input for r in identity.ordered(rows).collect()] == ["libfoo", "libzig", "node-lib"]


def test_graph_view_equals_flat_document(spark):
    from tessera.operators import rules
    from tessera.plans import packs

    flat = '{"spdxVersion":"SPDX-3.0.1","documentNamespace":"urn:d","creationInfo":{"creators":["Person: Ann"],"created":"2024"},"packages":[{"SPDXID":"urn:a","name":"foo","versionInfo":"1","supplier":"Organization: O","licenseDeclared":"MIT","checksums":[{"algorithm":"SHA256","checksumValue":"ab"}],"externalRefs":[{"referenceType":"purl","referenceLocator":"pkg:x/y"}]}],"relationships":[{"spdxElementId":"urn:d"}]}'
    graph = '{"@context":"https://spdx.org/rdf/3.0.1/c","@graph":[{"type":"CreationInfo","@id":"_:c","specVersion":"3.0.1","created":"2024","createdBy":["urn:p"]},{"type":"SpdxDocument","spdxId":"urn:d"},{"type":"Person","spdxId":"urn:p","name":"Ann"},{"type":"Organization","spdxId":"urn:o","name":"Other"},{"type":"Organization","spdxId":"urn:o","name":"O"},{"type":"software_Package","spdxId":"urn:a","name":"foo","software_packageVersion":"1","software_packageUrl":"pkg:x/y","suppliedBy":["urn:o"],"verifiedUsing":[{"type":"Hash","algorithm":"sha256","hashValue":"ab"}]},{"type":"Relationship","from":"urn:a","to":["urn:l"],"relationshipType":"hasDeclaredLicense"},{"type":"Relationship","from":"urn:d","to":["urn:a"],"relationshipType":"dependsOn"},{"type":"LicenseExpression","spdxId":"urn:l","licenseExpression":"MIT"}]}'
    for pack in (packs.elements_pack(), packs.devices_pack()):
        checked = rules.evaluate(variant(spark, [("f", flat), ("g", graph)]), pack)
        runs = rules.rule_runs(checked, rules.rule_table(spark, pack))
        got = {}
        for r in runs.collect():
            got.setdefault(r.doc_id, {})[r.rule_id] = [f.path for f in r.failures]
        assert got["f"] == got["g"]


def test_graph_elements_and_edges(spark):
    """Annotations, what is not used, references of every shape, and a document of very many elements."""
    from tessera.operators import graph

    rows = {
        "notes": [{"type": "software_Package", "spdxId": "a", "odd": 1}, {"type": "software_File", "spdxId": "b"}, {"type": "Annotation", "subject": ["a", "a", "d"], "statement": "s1"}, {"type": "Annotation", "subject": "a", "annotationType": "review", "comment": "s0"}, {"type": "Annotation", "statement": "whole"}, {"type": "SpdxDocument", "spdxId": "d", "name": "doc"}, {"type": "Weird"}],
        "refs": [
            {"type": "software_Package", "spdxId": "a", "suppliedBy": [{"type": "Person"}, "gone"], "originatedBy": {"type": "Tool", "name": "T"}, "verifiedUsing": ["h", {"type": "Hash", "hashValue": ""}, "gone"], "externalIdentifier": [{"externalIdentifierType": "cpe23", "identifier": "c"}, {"identifier": "i"}, {"externalIdentifierType": "packageUrl", "identifier": "p"}]},
            {"type": "Hash", "spdxId": "h", "algorithm": "sha-1", "hashValue": "00"},
            {"type": "Relationship", "from": "a", "to": ["n", "m"], "relationshipType": "hasConcludedLicense"},
            {"type": "NoAssertionLicense", "spdxId": "m"},
            {"type": "Relationship", "from": "a", "to": "gone", "relationshipType": "HASDECLAREDLICENSE"},
            {"type": "Relationship", "relationshipType": "dependsOn"},
            {"type": "CreationInfo", "createdBy": "gone", "createdUsing": [{"type": "Agent", "name": "x"}]},
            {"type": "Bom", "namespaceMap": {"namespace": "urn:n"}, "import": [{"externalSpdxId": "e"}, {}]},
        ],
        "none": [],
    }
    docs = variant(spark, [(k, json.dumps({"@context": "https://spdx.org/rdf/3.0.1/c", "@graph": v})) for k, v in rows.items()])
    got = {r.doc_id: (json.loads(r.j), r.accounting.asDict()) for r in graph.flat_view(docs).select("doc_id", F.to_json("doc").alias("j"), "accounting").collect()}
    view, counted = got["notes"]
    assert view["packages"] == [{"SPDXID": "a", "annotations": [{"annotationType": "OTHER", "comment": "s1"}, {"annotationType": "REVIEW", "comment": "s0"}]}, {"SPDXID": "b"}]
    assert view["annotations"] == [{"annotationType": "OTHER", "comment": "s1"}, {"annotationType": "OTHER", "comment": "whole"}] and view["name"] == "doc"
    assert counted == {"packages": 2, "relationships": 0, "agents": 0, "unmapped_types": ["weird"], "unmapped_package_keys": ["odd"]}
    view, counted = got["refs"]
    p = view["packages"][0]
    assert (p["supplier"], p["originator"], p["licenseConcluded"], p["licenseDeclared"]) == ("gone", "Tool: T", "NOASSERTION", "gone")
    assert p["checksums"] == [{"algorithm": "SHA1", "checksumValue": "00"}]
    assert [(r["referenceCategory"], r["referenceType"], r["referenceLocator"]) for r in p["externalRefs"]] == [("SECURITY", "cpe23", "c"), ("OTHER", "other", "i"), ("OTHER", "purl", "p")]
    assert view["relationships"] == [{"spdxElementId": "", "relatedSpdxElement": "", "relationshipType": "DEPENDS_ON"}]
    assert view["creationInfo"] == {"creators": ["gone", "Tool: x"]} and view["documentNamespace"] == "urn:n" and view["externalDocumentRefs"] == [{"externalDocumentId": "e", "spdxDocument": "e"}]
    assert counted["relationships"] == 1 and got["none"] == ({"spdxVersion": "SPDX-3.0.1", "packages": []}, {"packages": 0, "relationships": 0, "agents": 0, "unmapped_types": [], "unmapped_package_keys": []})
    n = 50_000
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.lit('{"type":"software_Package","spdxId":"u'), i, F.lit('","suppliedBy":"u'), n - 1 - i, F.lit('"}'))), ",")
    big = spark.range(1).select(F.lit("b").alias("doc_id"), F.parse_json(F.concat(F.lit('{"@context":"https://spdx.org/rdf/3.0.1/c","@graph":['), body, F.lit("]}"))).alias("doc"))
    assert graph.flat_view(big).select("accounting.packages").first().packages == n


def test_coverage_counts_nested_components(spark):
    from tessera.operators import coverage

    rows = [("1", '{"bomFormat":"CycloneDX","packages":[],"components":[{"purl":"p","components":[{"cpe":"x","components":[{"purl":"NONE"}]}]}]}'), ("2", '{"packages":[{"externalRefs":[{"referenceType":"cpe23Type","referenceLocator":"c"}]},{}]}'), ("3", '{"components":{}}'), ("4", "no")]
    got = {r.doc_id: (r.total, r.top_level, r.identified, r.purl, r.cpe) for r in coverage.coverage(variant(spark, rows)).collect()}
    assert got == {"1": (3, 1, 2, 1, 1), "2": (2, 2, 1, 0, 1), "3": (0,) * 5, "4": (0,) * 5}


def test_verdicts_never_clear_what_was_not_compared(spark):
    from tessera.operators import advisories

    event = lambda **k: {n: k.get(n) for n in ("introduced", "fixed", "last_affected", "limit")}
    adv = lambda kind, eco, name, i, versions, ranges: (kind, eco, name, i, [f"CVE-{i}"], None, [(name, eco, versions, [(t, [tuple(e.values()) for e in es]) for t, es in ranges])])
    rows = [
        adv("vulnerability", "npm", "a", "A1", ["1.0.0"], [("SEMVER", [event(introduced="0"), event(fixed="2.0.0")])]),
        adv("vulnerability", "npm", "b", "B1", None, [("ECOSYSTEM", [event(introduced="0")])]),
        adv("malicious", "npm", "c", "MAL-1", None, []),
        adv("vulnerability", "Go", "github.com/x/y", "G1", None, [("SEMVER", [event(introduced="0")])]),
        adv("vulnerability", "npm", "a", "A1", ["1.0.0"], []),
    ]
    a = spark.createDataFrame(rows, f"kind string, ecosystem string, name string, id string, aliases array<string>, summary string, affected {advisories.AFFECTED}").limit(4)
    kev = spark.createDataFrame([("CVE-A1",)], "id string")
    shards = spark.createDataFrame([("npm", True), ("Go", True), ("Maven", False)], "ecosystem string, loaded boolean")
    comps = [("1", "a", "1.5.0", "pkg:npm/a@1.5.0", ["CVE-A1"]), ("2", "a", None, "pkg:npm/a@3.0.0", None), ("3", "b", None, "pkg:npm/b@1.0.0", None), ("4", "c", None, "pkg:npm/c@1.0.0", None), ("5", "d", "1", None, None), ("6", "e", None, "pkg:npm/e", None), ("7", "f", None, "pkg:maven/g/f@1", None), ("8", "g", None, "pkg:nuget/g@1", None), ("9", "h", None, "pkg:golang/github.com/x/y/z@v1.0.0", None), ("10", "i", None, "pkg:golang/github.com/q@v1.0.0", None)]
    got = {r.component_id: r for r in advisories.match(spark.createDataFrame(comps, "component_id string, name string, version string, purl string, declared array<string>"), advisories.index(a, kev), shards).collect()}
    assert {k: r.status for k, r in got.items()} == {"1": "affected", "2": "clear", "3": "unknown", "4": "clear", "5": "unknown", "6": "unknown", "7": "unknown", "8": "unknown", "9": "affected", "10": "clear"}
    hit = got["1"].hits[0]
    assert (hit.id, hit.known_exploited, hit.already_declared, hit.method) == ("A1", True, True, "semver-range")
    assert got["9"].via_module == "github.com/x/y" and len(got["4"].malicious) == 1 and got["7"].why == "index did not load"


def test_windows_answer_as_the_walk_does(spark):
    """Ranges as windows of texts against the walk over their events, over random ranges and versions."""
    import random

    from tessera.functions import versions

    rng = random.Random(9)
    pool = ["0.0.1", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-2", "1.0.0-10", "1.0.0", "1.2.0", "1.10.0", "2.0.0-rc.1", "2.0.0", "10.0.0"]
    rows = []
    for _ in range(300):
        events = [{"introduced": "0"}] if rng.random() < 0.5 else []
        events += [{rng.choice(("introduced", "fixed", "last_affected")): rng.choice(pool)} for _ in range(rng.randrange(5))]
        rng.shuffle(events)
        rows.append((rng.choice([*pool, "x"]), [tuple(e.get(k) for k in ("introduced", "fixed", "last_affected", "limit")) for e in events]))
    frame = spark.createDataFrame(rows, "version string, events array<struct<introduced:string,fixed:string,last_affected:string,limit:string>>").repartition(2)
    prepared = versions.prepare_range(F.lit("SEMVER"), F.col("events"))
    text = versions.key_text(versions.semver_key(F.col("version")))
    got = frame.select(versions.affected_by(F.col("version"), F.lit("SEMVER"), F.col("events")).alias("walk"), versions.in_windows(text, versions.windows(prepared)).alias("windows")).collect()
    assert all(r.walk == r.windows for r in got) and len({r.walk for r in got}) == 3
    order = spark.createDataFrame([(v,) for v in pool], "v string").select("v", versions.key_text(versions.semver_key(F.col("v"))).alias("t")).collect()
    assert [r.v for r in sorted(order, key=lambda r: r.t.encode())] == ["0.0.1", "1.0.0-2", "1.0.0-10", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0", "1.2.0", "1.10.0", "2.0.0-rc.1", "2.0.0", "10.0.0"]


def test_resolver_abstains_when_forms_disagree(spark):
    from tessera.operators import resolve

    aliases = spark.createDataFrame([("openssl", "pkg:a", 3), ("left-pad", "pkg:b", 2), ("rare", "pkg:c", 1), ("zig 1.0", "pkg:d", 2), ("lib-zig", "pkg:e", 2), ("xyz", "pkg:f", 2), ("libxyz-2", "pkg:g", 2)], "alias string, purl_base string, observations long")
    names = ["openssl", "Left_Pad.jar", "libopenssl (FIPS)", "rare", "pkg:npm/x@1", "x", None, "unknown thing"]
    got = {r.input: (r.purl_base, r.method) for r in resolve.resolve(spark.createDataFrame([(n,) for n in names], "input string"), aliases).collect()}
    assert got["openssl"] == ("pkg:a", "exact") and got["Left_Pad.jar"] == ("pkg:b", "dictionary") and got["libopenssl (FIPS)"] == ("pkg:a", "heuristic")
    assert got["pkg:npm/x@1"] == ("pkg:npm/x", "exact")
    assert got["rare"] == got["x"] == got[None] == got["unknown thing"] == (None, None)
    assert {r.input for r in resolve.resolve(spark.createDataFrame([("rare",)], "input string"), aliases, least=1).collect() if r.purl_base} == {"rare"}


def test_tables_of_three_kinds(spark, tmp_path):
    from tessera.operators.detect import is_draft
    from tessera.plans import draft
    from tessera.sources import documents, tables

    book = io.BytesIO()
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="s" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Component</t></si><si><r><t>zl</t></r><r><t>ib</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Version</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>1.3</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData/></worksheet>")
    content = b"BT 1 0 0 1 50 700 Tm (Name) Tj 1 0 0 1 200 700 Tm (Version) Tj 1 0 0 1 50 680 Tm (foo\\051) Tj 1 0 0 1 200 680 Tm (2.0) Tj ET"
    pdf = b"%PDF-1.4\n1 0 obj << /Length " + str(len(content)).encode() + b" >>\nstream\n" + content + b"\nendstream\nendobj"
    files = [("a.csv", "﻿Component Name,Version,Supplier\n\"x, \"\"y\"\"\nz\",1.0,S\nshort\n".encode()), ("b.xlsx", book.getvalue()), ("c.pdf", pdf), ("d.pdf", b"%PDF-1.4 /Encrypt"), ("e.xlsx", b"PK\x03\x04broken")]
    frame = spark.createDataFrame(files, "path string, content binary")
    rows = tables.read_tables(frame)
    got = {r.doc_id: (r.n_components, r.n_ragged, json.loads(r.j)["components"][0]) for r in draft.documents(rows).withColumn("j", F.to_json("doc")).collect()}
    assert got["a.csv"][:2] == (2, 1) and got["a.csv"][2]["name"] == 'x, "y"\nz'
    assert got["b.xlsx"][2] == {"type": "library", "name": "zlib", "version": "1.3"}
    assert got["c.pdf"][2] == {"type": "library", "name": "foo)", "version": "2.0"}
    assert {r.path: r.problem for r in rows.where("problem IS NOT NULL").collect()}.keys() == {"d.pdf", "e.xlsx"}
    assert all(r[0] for r in draft.documents(rows).select(is_draft(F.col("doc"))).collect())
    kinds = {r.path: r.k for r in frame.select("path", documents.sniff(F.col("content")).alias("k")).collect()}
    assert kinds == {"a.csv": "text", "b.xlsx": "xlsx", "c.pdf": "pdf", "d.pdf": "pdf", "e.xlsx": "xlsx"}


def test_pdf_attachments():
    from tessera.sources import tables

    spec = b"<< /Type /Filespec /F (a.xml) /EF << /F 2 0 R >> >>"
    pdf = b"%PDF-1.7\n1 0 obj " + spec + b" endobj\n2 0 obj << /Length 5 >>\nstream\nhello\nendstream endobj\n3 0 obj " + spec + b" endobj"
    assert tables.pdf_attachments(pdf) == [("a.xml", b"hello")]


def test_report_functions(spark):
    from tessera.functions import texts
    from tessera.shipping import ship

    ship(spark)
    r = spark.range(1)
    for n, want in ((5, "5 bytes"), (1024, "1 KB"), (999_999, "977 KB"), (2_540_000, "2.5 MB")):
        assert one(r.select(texts.human_size(F.lit(n)))) == want
    assert one(r.select(texts.safe_logo(F.lit(" https://a/b.png ")))) == "https://a/b.png"
    assert one(r.select(texts.safe_logo(F.lit("javascript:alert(1)")))) is None
    assert one(r.select(texts.crosswalk_paths(F.lit("$.a; $.b ;")))) == ["$.a", "$.b"] and one(r.select(texts.crosswalk_paths(F.lit("None given")))) == []
    assert one(r.select(texts.upper_median(F.array(*map(F.lit, (4, 1, 3, 2)))))) == 3
    assert tuple(one(r.select(texts.json_problem(F.lit('{"a": nope}'))))) == (6, '{"a": nope}')
    assert one(r.select(texts.json_problem(F.lit("{}"))))["offset"] is None


def test_mirror_build_and_open(spark, tmp_path):
    from tessera.sources import mirror

    def archive(*entries):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in entries:
                z.writestr(name, data)
        return out.getvalue()

    adv = lambda i, *names: json.dumps({"id": i, "summary": "s", "details": "prose", "affected": [{"package": {"name": n, "ecosystem": "npm"}, "versions": ["1"]} for n in names]})
    exports = spark.createDataFrame([("x/npm.zip", archive(("1.json", adv("A", "p", "q")), ("2.json", adv("MAL-1", "p")), ("3.txt", "no"), ("4.json", adv("B")))), ("x/again.zip", archive(("1.json", adv("A", "p")))), ("x/bad.zip", b"PK broken")], "path string, content binary")
    mirror.build(exports, spark.createDataFrame([("CVE-1",)], "id string"), str(tmp_path / "m"), "2026-01-01")
    rows, kev, sources = mirror.open_mirror(spark, str(tmp_path / "m"))
    assert sorted((r.kind, r.name, r.id) for r in rows.collect()) == [("malicious", "p", "MAL-1"), ("vulnerability", "p", "A"), ("vulnerability", "q", "A")]
    assert sources.count() == 3 and kev.count() == 1
    broken = spark.createDataFrame([("npm", "vulnerability", b"{nope")], "ecosystem string, kind string, content binary")
    bad = mirror.read_shard_files(broken)[1]
    assert {(r.ecosystem, r.loaded) for r in mirror.shards(sources, bad).collect()} == {("npm", False), ("again", True), ("bad", False)}
    assert {r.ecosystem: r.problem is not None for r in mirror.status(sources).collect()} == {"npm": False, "again": False, "bad": True}
    assert {r.source for r in rows.where("id = 'A' AND name = 'p'").collect()} == {"again.zip"}
    none, problem = mirror.read_kev(spark, str(tmp_path / "absent.json"))
    assert none.count() == 0 and problem
    (tmp_path / "kev.json").write_text('{"vulnerabilities":[{"cveID":"CVE-1"},{"cveID":"CVE-1"}]}')
    known, problem = mirror.read_kev(spark, str(tmp_path / "kev.json"))
    assert [r.id for r in known.collect()] == ["CVE-1"] and problem is None
    assert json.loads(mirror.manifest(sources))


def _shard_rows(spark, n, fails=False):
    from tessera.sources import shards

    eco = F.concat(F.lit("e"), (F.col("id") % 3).cast("string"))
    kind = F.when(F.col("id") % 2 == 0, "malicious").otherwise("vulnerability")
    name = F.concat(F.lit("n"), F.col("id").cast("string"))
    if fails:
        name = F.when(F.col("id") == n - 1, F.raise_error(F.lit("lost"))).otherwise(name)
    rows = spark.range(0, n, 1, 3).select(F.lit("s").alias("source"), kind.alias("kind"), eco.alias("ecosystem"), name.alias("name"), F.col("id").cast("string").alias("id"), F.array(F.lit("A")).alias("aliases"))
    shape = spark.createDataFrame([], shards.SCHEMA).schema
    rows = rows.withColumn("summary", F.lit(None)).withColumn("affected", F.lit(None))
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in shape]).sortWithinPartitions("kind", "ecosystem")


def test_shards_commit_whole_or_not_at_all(spark, tmp_path):
    from tessera.sources import shards

    folder = str(tmp_path / "m")
    shards.register(spark)
    save = lambda rows: rows.write.format(shards.FORMAT).option("path", folder).mode("overwrite").save()
    load = lambda: spark.read.format(shards.FORMAT).option("path", folder).load()
    save(_shard_rows(spark, 60))
    first = shards.newest(folder)
    with pytest.raises(Exception, match="lost"):
        save(_shard_rows(spark, 90, fails=True))
    assert shards.newest(folder) == first and load().count() == 60
    assert [p.name for p in (tmp_path / "m" / "data").iterdir()] == [first["generation"]]
    save(_shard_rows(spark, 90))
    assert shards.newest(folder)["number"] == 2 and load().count() == 90 and load().where("problem IS NOT NULL").count() == 0
    with pytest.raises(Exception, match="overwrite"):
        _shard_rows(spark, 5).write.format(shards.FORMAT).option("path", folder).mode("append").save()
    save(_shard_rows(spark, 60).limit(0))
    assert load().count() == 0


def test_only_asked_shards_are_read_and_broken_ones_are_rows(spark, tmp_path):
    from pathlib import Path

    from tessera.sources import mirror, shards

    folder = str(tmp_path / "m")
    shards.register(spark)
    _shard_rows(spark, 60).write.format(shards.FORMAT).option("path", folder).mode("overwrite").save()
    read = spark.read.format(shards.FORMAT).option("path", folder).load()
    listed = shards.newest(folder)["shards"]
    assert read.rdd.getNumPartitions() == 1
    read = spark.read.format(shards.FORMAT).options(path=folder, packBytes="0").load()
    ask = read.where("ecosystem = 'e1' AND kind IN ('malicious', 'other')")
    assert ask.rdd.getNumPartitions() == sum(s["ecosystem"] == "e1" and s["kind"] == "malicious" for s in listed) < len(listed)
    assert sorted(int(r.id) for r in ask.collect()) == [i for i in range(60) if i % 3 == 1 and i % 2 == 0]
    assert read.where("ecosystem = 'none'").count() == 0
    assert read.where("name = 'n7' AND ecosystem = 'e1'").count() == 1
    for s in listed:
        if s["ecosystem"] == "e0":
            Path(folder, s["path"]).write_bytes(b"PAR1 no")
        if s["ecosystem"] == "e2" and s["kind"] == "malicious":
            Path(folder, s["path"]).unlink()
    assert {r.ecosystem for r in mirror.shard_problems(read).collect()} == {"e0", "e2"}
    assert read.where("ecosystem = 'e1' AND problem IS NULL").count() == 20
    assert {int(r.id) for r in read.where("ecosystem = 'e2' AND id IS NOT NULL").collect()} == {i for i in range(60) if i % 3 == 2 and i % 2 == 1}


def test_documents_read_leniently(spark, tmp_path):
    from tessera.sources import documents

    (tmp_path / "a.json").write_bytes(b'\xef\xbb\xbf{"components":[1],"components":[{"name":"x"}]}')
    (tmp_path / "b.json").write_text("nope")
    (tmp_path / "provenance.json").write_text("{}")
    got = {r.doc_id: r.j for r in documents.read_documents(spark, str(tmp_path)).select("doc_id", F.to_json("doc").alias("j")).collect()}
    assert got == {"a.json": '{"components":[{"name":"x"}]}', "b.json": None}
    said = {r.doc_id: r.outcome for r in documents.outcome(documents.read_documents(spark, str(tmp_path))).collect()}
    assert said == {"a.json": "unsupported-version", "b.json": "not-json"}


def test_bundle_is_stable_and_verifies(tmp_path):
    from tessera.plans import report

    files = {"b.json": report.stable_json({"z": 1, "a": [2]}), "a.txt": "x"}
    assert report.write_bundle(str(tmp_path / "1"), files) == report.write_bundle(str(tmp_path / "2"), dict(reversed(files.items())))
    assert {s for _, s in report.verify_bundle(str(tmp_path / "1"))} == {"ok"}
    (tmp_path / "1" / "a.txt").write_text("y")
    (tmp_path / "1" / "c.txt").write_text("y")
    (tmp_path / "1" / "b.json").unlink()
    assert report.verify_bundle(str(tmp_path / "1")) == [("a.txt", "changed"), ("b.json", "missing"), ("c.txt", "unlisted")]


def test_stream_checks_each_document_once(spark, tmp_path):
    from tessera.plans import packs
    from tessera.streaming import inbox

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(DOC)
    for n in (1, 2):
        inbox.check_stream(spark, str(folder), packs.devices_pack(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        found = spark.read.parquet(str(tmp_path / "out"))
        assert found.select("doc_id").distinct().count() == n
        (folder / "b.json").write_text(DOC)


def test_benchmark_of_resolvers(spark):
    from tessera.operators import resolve
    from tessera.plans import identity

    comps = spark.createDataFrame([("left-pad", "pkg:npm/left-pad@1"), ("left-pad", "pkg:npm/left-pad@1"), ("a/thing", "pkg:go/a/thing@1"), ("odd", None)], "name string, purl string")
    data = identity.dataset(comps)
    assert data.count() == data.select("input").distinct().count()
    aliases = spark.createDataFrame([("left-pad", "pkg:npm/left-pad", 2)], "alias string, purl_base string, observations long")
    scores = identity.benchmark(comps, aliases)
    by = {(r.resolver, r.subset): r for r in scores.collect()}
    assert by["always-abstain", "all"].abstention == 1 and by["tiers", "clean"].precision == 1
    assert "tiers" in {r.resolver for r in resolve.best(scores).collect()}


def test_no_row_without_a_claim(spark):
    from tessera.operators import workspace

    table = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "firm_id long, x string")
    workspace.claim(spark, None)
    assert workspace.guard(table, "guarded_rows").count() == 0
    for firm, want in ((2, ["b"]), ("1", ["a"]), ("1 OR true", []), (9, []), (None, [])):
        workspace.claim(spark, firm)
        assert [r.x for r in spark.sql("SELECT x FROM guarded_rows").collect()] == want
    with pytest.raises(ValueError):
        workspace.guard(table, "x; DROP")


def test_the_longest_release_line(spark):
    from tessera.operators import support

    cycles = spark.createDataFrame([("p", c, None, None) for c in ("1", "1.1", "1.10", "1.1.1k", "2.", None)] + [("q", "1.1.1", None, None)], "product string, cycle string, eol_date date, eol_flag boolean")
    asked = ["1", "1.1.10", "1.1.1k", "1.1.1kk", "1.10.3", "11", "1.100", "2.x", "1.1.1", "1-" + "9" * 5000]
    got = {r["__v"]: r["__c"].cycle for r in support.release_lines(spark.createDataFrame([("p", v) for v in asked], "product string, __v string"), cycles).collect()}
    assert got == {"1": "1", "1.1.10": "1.1", "1.1.1k": "1.1.1k", "1.1.1kk": "1.1.1k", "1.10.3": "1.10", "1.100": "1", "2.x": "2.", "1.1.1": "1.1", "1-" + "9" * 5000: "1"}


def rows_of(frame):
    import pandas as pd

    out = []
    frame = frame[sorted(frame.columns)]
    for r in frame.itertuples(index=False):
        out.append(tuple(None if pd.isna(x) else float(x) if isinstance(x, numbers.Number) and not isinstance(x, (bool, np.bool_)) else str(x) for x in r))
    return sorted(out, key=str)


def test_bound_queries_equal_their_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    wrong = []
    for name, sql in entry.oracle_sql().items():
        got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(sql).fetchdf()
        if sorted(got.columns) != sorted(want.columns) or rows_of(got) != rows_of(want):
            wrong.append(name)
    assert not wrong
    assert not math.isnan(entry.entry(spark).count())
