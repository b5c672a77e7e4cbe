"""The operators bound to the driver's tables, each with the same result in SQL.

A document is an order, its components are its line items, a component's name is the
part's, its supplier the supplier's; version and package URL are made from the keys so
that absence occurs.  The position in a document is the row number of its line items in
a full order, since no key of theirs is unique.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names, purl, texts, values, versions
from ..operators import advisories, coverage, detect, graph, resolve, rules, selectors, support, workspace
from ..sources import documents as readers
from ..sources import mirror as mirrors
from ..sources import tables as readers_of_tables
from ..storage import shared_dir, written
from . import draft, identity, report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL of the same result."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
COMP = """
comp AS (
  SELECT l_orderkey AS doc_id,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) - 1 AS BIGINT) AS idx,
         p_name AS name, l_linenumber || '.' || p_size || '.' || (l_partkey % 10) AS version,
         CASE WHEN l_partkey % 19 <> 0 THEN 'pkg:npm/' || replace(p_name, ' ', '-') || '-' || lower(replace(p_brand, '#', '-')) || '@' || l_linenumber || '.' || p_size || '.' || (l_partkey % 10) END AS purl,
         CASE WHEN l_suppkey % 7 <> 0 THEN s_name END AS supplier,
         CASE WHEN l_suppkey % 11 = 0 THEN 'NOASSERTION' WHEN l_suppkey % 5 <> 0 THEN p_brand END AS license,
         l_partkey AS partkey, l_suppkey AS suppkey, l_returnflag AS flag
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)
"""


def package_name() -> Column:
    """A part's name in its registry: name and brand."""
    return F.concat_ws("-", F.replace("p_name", F.lit(" "), F.lit("-")), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))))


def components(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, idx, name, version, purl, supplier, license, partkey, suppkey, flag of every line item."""
    items = table(spark, sf, "lineitem")
    idx = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER)) - 1
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_brand", package_name().alias("package"))
    rows = items.select("l_orderkey", "l_returnflag", *ORDER).withColumn("idx", idx.cast("long")).join(part, F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    version = F.concat_ws(".", F.col("l_linenumber").cast("string"), F.col("p_size").cast("string"), (F.col("l_partkey") % 10).cast("string"))
    return rows.select(
        F.col("l_orderkey").alias("doc_id"), "idx", F.col("p_name").alias("name"), version.alias("version"),
        F.when(F.col("l_partkey") % 19 != 0, F.concat(F.lit("pkg:npm/"), "package", F.lit("@"), version)).alias("purl"),
        F.when(F.col("l_suppkey") % 7 != 0, F.col("s_name")).alias("supplier"),
        F.when(F.col("l_suppkey") % 11 == 0, "NOASSERTION").when(F.col("l_suppkey") % 5 != 0, F.col("p_brand")).alias("license"),
        F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"), F.col("l_returnflag").alias("flag"),
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id and doc (VARIANT): every order as a document; orders without line items have no component key."""
    licence = F.when(F.col("license").isNotNull(), F.array(F.struct(F.struct(F.col("license").alias("id")).alias("license"))))
    c = F.struct("idx", F.struct("name", "version", "purl", F.col("supplier").alias("publisher"), licence.alias("licenses")).alias("c"))
    lists = components(spark, sf).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["c"]).alias("components"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).join(lists, "doc_id", "left")
    made = F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.struct(F.when(F.col("status") != "P", F.col("status")).alias("timestamp")).alias("metadata"), "components")
    return orders.select("doc_id", F.parse_json(F.to_json(made)).alias("doc"))


def _rule(name: str, severity: str, selector: str, wanted: dict) -> dict:
    return {"id": name, "severity": severity, "appliesTo": ["cyclonedx"], "selector": {"cyclonedx": selector}, "assert": wanted, "onEmptySelector": "fire", "title": name.lower()}


PACK = rules.load_pack({"id": "orders", "version": "1", "title": "components of orders", "rules": [
    _rule("R1-PURL", "error", "$.components[*]", {"exists": "purl|cpe"}),
    _rule("R2-SUPPLIER", "warning", "$.components[*]", {"anyOf": [{"exists": "publisher"}, {"exists": "supplier.name"}]}),
    _rule("R3-VERSION", "warning", "$.components[*]", {"allOf": [{"exists": "name"}, {"exists": "version"}, {"matches": r"^[1-5]\.\d+\.\d+$"}]}),
    _rule("R4-LICENCE", "info", "$.components[*].licenses[*].license", {"exists": "id"}),
    _rule("R5-TIME", "advisory", "$.metadata", {"exists": "timestamp"}),
    _rule("R6-NAMED", "info", "$.components[0]", {"not": {"equals": {"name": "small ring"}}}),
]})

FOUND = COMP.strip() + """,
docs AS (SELECT o_orderkey AS doc_id, o_orderstatus AS status, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders),
lic AS (SELECT *, license IS NOT NULL AS has FROM comp),
found AS (
  SELECT doc_id, 'R1-PURL' AS rule_id, 'error' AS severity, '$.components[' || idx || ']' AS path, name || ' ' || version AS component FROM comp WHERE purl IS NULL
  UNION ALL SELECT doc_id, 'R2-SUPPLIER', 'warning', '$.components[' || idx || ']', name || ' ' || version FROM comp WHERE supplier IS NULL
  UNION ALL SELECT doc_id, 'R3-VERSION', 'warning', '$.components[' || idx || ']', name || ' ' || version FROM comp WHERE NOT regexp_matches(version, '^[1-5]\\.[0-9]+\\.[0-9]+$')
  UNION ALL SELECT doc_id, 'R4-LICENCE', 'info', '$.components[' || idx || '].licenses[0].license', NULL FROM lic WHERE license = 'NOASSERTION'
  UNION ALL SELECT doc_id, 'R5-TIME', 'advisory', '$.metadata', NULL FROM docs WHERE status = 'P'
  UNION ALL SELECT doc_id, 'R6-NAMED', 'info', '$.components[0]', name || ' ' || version FROM comp WHERE idx = 0 AND name = 'small ring'
  UNION ALL SELECT doc_id, r.id, r.sev, r.sel, NULL FROM docs, (VALUES ('R1-PURL', 'error', '$.components[*]'), ('R2-SUPPLIER', 'warning', '$.components[*]'), ('R3-VERSION', 'warning', '$.components[*]'), ('R6-NAMED', 'info', '$.components[0]')) r(id, sev, sel) WHERE n = 0
  UNION ALL SELECT doc_id, 'R4-LICENCE', 'info', '$.components[*].licenses[*].license', NULL FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM lic WHERE has))
"""


def _checked(spark: SparkSession, sf: str, overrides: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """The evaluated documents and the rule table."""
    return rules.gated(rules.evaluate(documents(spark, sf), PACK)), rules.rule_table(spark, PACK, overrides)


def _found(spark: SparkSession, sf: str) -> DataFrame:
    return rules.findings(*_checked(spark, sf))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.k') IS NOT NULL AS present FROM events")
def json_select(spark, sf):
    """Child selection and presence in JSON."""
    e = table(spark, sf, "events").select("event_id", F.try_parse_json("props").alias("doc"))
    node = F.get(selectors.matches(F.col("doc"), "$.k"), F.lit(0))
    return e.select("event_id", F.try_variant_get(node, "$", "long").alias("k"), values.truthy(node).alias("present"))


@query(f"WITH {FOUND} SELECT doc_id, rule_id, severity, path, component FROM found")
def rule_findings(spark, sf):
    """All findings of the pack, with concrete paths and labels."""
    return _found(spark, sf).select("doc_id", "rule_id", "severity", "path", "component")


@query(f"WITH {FOUND} SELECT doc_id, rule_id, path FROM found WHERE path LIKE '%[*]%' OR (rule_id = 'R6-NAMED' AND component IS NULL)")
def rule_empty_selector(spark, sf):
    """Rules that fire because their selector reaches nothing."""
    f = _found(spark, sf).where(F.contains("path", F.lit("[*]")) | ((F.col("rule_id") == "R6-NAMED") & F.col("component").isNull()))
    return f.select("doc_id", "rule_id", "path")


@query(f"""WITH {FOUND} SELECT d.doc_id, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning,
  count(*) FILTER (severity = 'info') AS info, count(*) FILTER (severity = 'advisory') AS advisory FROM docs d LEFT JOIN found USING (doc_id) GROUP BY d.doc_id""")
def rule_severity_counts(spark, sf):
    """Findings of each severity per document, zeros kept."""
    return rules.severity_counts(*_checked(spark, sf))


@query(f"""WITH {FOUND} SELECT d.doc_id, coalesce(max(CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 WHEN 'info' THEN 1 WHEN 'advisory' THEN 0 END), -1) AS rank,
  coalesce(bool_or(severity IN ('error', 'warning')), false) AS blocked FROM docs d LEFT JOIN found USING (doc_id) GROUP BY d.doc_id""")
def rule_gate(spark, sf):
    """Highest severity rank of a document, and does it reach a warning?"""
    return rules.gate(*_checked(spark, sf), "warning").select("doc_id", "rank", "blocked")


ASKED = [
    {"ruleId": "R1-PURL", "to": "info", "reason": "Accepted for this programme until the supplier delivers identifiers in spring."},
    {"ruleId": "R2-SUPPLIER", "to": "warning", "reason": "Stated again from last year's list so that the reviewer can see it was considered."},
    {"ruleId": "R5-TIME", "to": "error", "reason": "The customer's contract makes the time of assembly a condition of delivery."},
]


@query(f"""WITH {FOUND}, asked(rule_id, own, asked) AS (VALUES ('R1-PURL', 'error', 'info'), ('R2-SUPPLIER', 'warning', 'warning'), ('R5-TIME', 'advisory', 'error')),
  n AS (SELECT doc_id, rule_id, count(*) AS n FROM found GROUP BY ALL)
  SELECT d.doc_id, a.rule_id, coalesce(n.n, 0) AS n_failures, CASE WHEN own <> asked AND coalesce(n.n, 0) > 0 THEN asked ELSE own END AS severity,
    own <> asked AND coalesce(n.n, 0) > 0 AS overridden,
    CASE WHEN own = asked THEN 'the pack already assigns this severity' WHEN coalesce(n.n, 0) = 0 THEN 'the rule found nothing' END AS why_inert
  FROM docs d CROSS JOIN asked a LEFT JOIN n ON n.doc_id = d.doc_id AND n.rule_id = a.rule_id""")
def override_apply(spark, sf):
    """Severity overrides: applied, or inert with the reason."""
    asked = rules.check_overrides(ASKED, PACK)
    runs = rules.rule_runs(*_checked(spark, sf, asked)).where(F.col("rule_id").isin(*asked))
    return runs.select("doc_id", "rule_id", F.col("n_failures").cast("long").alias("n_failures"), "severity", "overridden", "why_inert")


@query(f"""WITH {COMP} SELECT o_orderkey AS doc_id, count(c.doc_id) AS total, count(purl) AS purl, count(supplier) AS supplier, count(version) AS version,
  count(*) FILTER (license IS NOT NULL AND license <> 'NOASSERTION') AS license, count(purl) AS identified FROM orders LEFT JOIN comp c ON c.doc_id = o_orderkey GROUP BY o_orderkey""")
def coverage_counts(spark, sf):
    """Components, and those that state each element, per document."""
    return coverage.coverage(documents(spark, sf)).select("doc_id", "total", "purl", "supplier", "version", "license", "identified")


@query(f"""WITH {COMP} SELECT count(*) AS total, count(purl) AS purl, round(100.0 * count(purl) / count(*), 1)::DOUBLE AS purl_percent,
  round(100.0 * count(supplier) / count(*), 1)::DOUBLE AS supplier_percent FROM comp""")
def coverage_summary(spark, sf):
    """Totals and shares over all documents."""
    s = coverage.summary(coverage.coverage(documents(spark, sf)))
    return s.select("total", "purl", "purl_percent", "supplier_percent")


@query(f"""WITH {FOUND}, g AS (SELECT rule_id, severity, count(*) AS n, count(DISTINCT doc_id) AS files FROM found GROUP BY ALL)
  SELECT rule_id, severity, n, files FROM g ORDER BY CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 WHEN 'info' THEN 1 ELSE 0 END DESC, rule_id""")
def findings_by_rule(spark, sf):
    """Findings by rule, worst severity first."""
    return rules.grouped(_found(spark, sf)).select("rule_id", "severity", "n", "files")


@query(f"""WITH {FOUND}, g AS (SELECT rule_id, count(*) AS n FROM found GROUP BY ALL) SELECT rule_id, n FROM g ORDER BY n DESC, rule_id LIMIT 12""")
def top_rules(spark, sf):
    """The rules with most findings (a top-12 report)."""
    return rules.top(_found(spark, sf))


@query(f"""WITH {FOUND} SELECT o_orderpriority AS pack, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info,
  count(*) FILTER (severity = 'advisory') AS advisory, count(*) AS total FROM found JOIN orders ON o_orderkey = doc_id GROUP BY o_orderpriority""")
def corpus_pivot(spark, sf):
    """Findings per group and severity, with totals."""
    groups = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("group"))
    return rules.pivot(_found(spark, sf), groups).withColumnRenamed("group", "pack")


@query(f"""WITH {FOUND}, sums AS (SELECT rule_id, count(*) AS n FROM found GROUP BY ALL), size AS (SELECT count(*) AS n FROM comp)
  SELECT rule_id, sums.n AS n, sums.n = size.n AS universal FROM sums, size""")
def universal_rules(spark, sf):
    """Rules that fail on every component."""
    return rules.universal(_found(spark, sf), components(spark, sf))


def mirror(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts as advisories: (advisories, kev, shards)."""
    p = table(spark, sf, "part").select("p_partkey", package_name().alias("name"), "p_size")
    bound = lambda **k: F.struct(*[(F.lit(k[n]).cast("string") if not isinstance(k.get(n), Column) else k[n]).alias(n) for n in ("introduced", "fixed", "last_affected", "limit") if n in k], *[F.lit(None).cast("string").alias(n) for n in ("introduced", "fixed", "last_affected", "limit") if n not in k])
    order = ["introduced", "fixed", "last_affected", "limit"]
    ordered = lambda s: F.struct(*[s[n].alias(n) for n in order])
    fixed = F.concat(F.lit("3."), F.col("p_size").cast("string"), F.lit(".0"))
    semver = F.array(F.struct(F.lit("SEMVER").alias("type"), F.array(ordered(bound(introduced="0")), ordered(bound(fixed=fixed))).alias("events")))
    other = F.array(F.struct(F.lit("ECOSYSTEM").alias("type"), F.array(ordered(bound(introduced="0"))).alias("events")))
    listed = F.when(F.col("p_partkey") % 4 == 0, F.array(F.concat(F.lit("7."), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"))))
    ranges = F.when(F.col("p_partkey") % 5 == 0, other).otherwise(semver)
    affected = F.array(F.struct("name", F.lit("npm").alias("ecosystem"), listed.alias("versions"), ranges.alias("ranges")))
    rows = p.select(F.when(F.col("p_partkey") % 7 == 0, "malicious").otherwise("vulnerability").alias("kind"), F.lit("npm").alias("ecosystem"), "name", F.concat(F.lit("ADV-"), F.col("p_partkey").cast("string")).alias("id"), F.array(F.concat(F.lit("CVE-"), (F.col("p_partkey") % 50).cast("string"))).alias("aliases"), F.lit(None).cast("string").alias("summary"), affected.cast(advisories.AFFECTED).alias("affected"))
    kev = spark.range(0, 50, 9).select(F.concat(F.lit("CVE-"), F.col("id").cast("string")).alias("id"))
    shards = spark.sql("SELECT * FROM VALUES ('npm', true) AS t(ecosystem, loaded)")
    return rows, kev, shards


ADVISED = COMP.strip() + """,
adv AS (SELECT p_partkey AS pk, replace(p_name, ' ', '-') || '-' || lower(replace(p_brand, '#', '-')) AS name, p_size, CASE WHEN p_partkey % 7 = 0 THEN 'malicious' ELSE 'vulnerability' END AS kind FROM part),
v AS (SELECT *, split_part(split_part(purl, '/', 2), '@', 1) AS pname, CAST(split_part(version, '.', 1) AS INT) AS a, CAST(split_part(version, '.', 2) AS INT) AS b, CAST(split_part(version, '.', 3) AS INT) AS c FROM comp),
met AS (SELECT v.doc_id, v.idx, v.partkey, adv.kind, adv.pk,
          (adv.pk % 4 = 0 AND v.version = '7.' || adv.p_size || '.' || (adv.pk % 10)) OR (adv.pk % 5 <> 0 AND (v.a, v.b, v.c) < (3, adv.p_size, 0)) AS hit,
          adv.pk % 5 <> 0 OR adv.pk % 4 = 0 AS compared
        FROM v JOIN adv ON adv.name = v.pname WHERE v.purl IS NOT NULL),
verdict AS (SELECT v.doc_id, v.idx, v.partkey,
          CASE WHEN v.purl IS NULL THEN 'unknown' WHEN bool_or(m.hit AND m.kind = 'vulnerability') THEN 'affected' WHEN bool_or(m.kind = 'vulnerability' AND NOT m.hit AND NOT m.compared) THEN 'unknown' ELSE 'clear' END AS status,
          count(*) FILTER (m.hit AND m.kind = 'vulnerability') AS n_hits, count(*) FILTER (m.kind = 'malicious') AS n_malicious,
          count(*) FILTER (m.hit AND m.kind = 'vulnerability' AND (m.pk % 50) % 9 = 0) AS n_exploited,
          count(*) FILTER (m.hit AND m.kind = 'vulnerability' AND m.pk % 50 <> v.partkey % 50) AS n_undeclared
        FROM v LEFT JOIN met m ON m.doc_id = v.doc_id AND m.idx = v.idx GROUP BY v.doc_id, v.idx, v.partkey, v.purl)
"""


def _asking(spark: SparkSession, sf: str) -> DataFrame:
    """Components with the ids that they declare."""
    return components(spark, sf).select("doc_id", "idx", "name", "version", "purl", F.array(F.concat(F.lit("CVE-"), (F.col("partkey") % 50).cast("string"))).alias("declared"))


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    rows, kev, shards = mirror(spark, sf)
    return advisories.match(_asking(spark, sf), advisories.index(rows, kev), shards)


def _asked_of(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What counts and pairs are made of: (components, names, classes, shards)."""
    rows, kev, shards = mirror(spark, sf)
    return _asking(spark, sf), *advisories.held(written(advisories.known(rows, kev), "advisories")), shards


@query(f"WITH {ADVISED} SELECT doc_id, idx, status, CASE WHEN status = 'affected' THEN n_hits ELSE 0 END AS n_hits, CASE WHEN status <> 'unknown' THEN n_malicious ELSE 0 END AS n_malicious FROM verdict")
def advisory_verdicts(spark, sf):
    """Three-valued verdict of every component."""
    return _verdicts(spark, sf).select("doc_id", "idx", "status", "n_hits", "n_malicious")


@query(f"""WITH {ADVISED} SELECT count(*) FILTER (status = 'affected') AS affected, count(*) FILTER (status = 'clear') AS clear, count(*) FILTER (status = 'unknown') AS "unknown",
  CAST(coalesce(sum(n_exploited) FILTER (status = 'affected'), 0) AS BIGINT) AS known_exploited, CAST(coalesce(sum(n_malicious) FILTER (status <> 'unknown'), 0) AS BIGINT) AS malicious,
  CAST(coalesce(sum(n_undeclared) FILTER (status = 'affected'), 0) AS BIGINT) AS undeclared FROM verdict""")
def verdict_tally(spark, sf):
    """Counts of verdicts, of exploited and of undeclared hits."""
    return advisories.tally_of(*_asked_of(spark, sf))


@query(f"WITH {ADVISED} SELECT doc_id, idx, pk FROM met WHERE hit AND kind = 'vulnerability'")
def advisory_equi_match(spark, sf):
    """Every (component, advisory) whose range or list holds the version."""
    return advisories.pairs(*_asked_of(spark, sf)).select("doc_id", "idx", F.substr("id", F.lit(5)).cast("long").alias("pk"))


_PATHS = """c AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages),
  k AS (SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS module FROM c WHERE split_part(path, '/', 2) IN ('en', 'de'))"""


def _paths(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Pages with the path of their address, and the first two parts of some as modules."""
    c = table(spark, sf, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("path"))
    part = lambda i: F.split_part("path", F.lit("/"), F.lit(i))
    return c, c.where(part(2).isin("en", "de")).select(F.concat(part(1), F.lit("/"), part(2)).alias("module")).distinct()


@query(f"WITH {_PATHS} SELECT page_id, path, (SELECT module FROM k WHERE module = split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AND module <> path) AS module FROM c")
def module_fallback(spark, sf):
    """The nearest parent path that is a key of an index."""
    c, k = _paths(spark, sf)
    near = advisories.nearest_module(c.select(F.col("path").alias("name")).distinct(), k)
    return c.join(near.withColumnRenamed("name", "path"), "path", "left").select("page_id", "path", "module")


@query(f"""WITH {_PATHS} SELECT page_id, CASE WHEN k.module IS NULL OR k.module = path THEN NULL ELSE k.module END AS via_module, CASE WHEN k.module IS NOT NULL THEN 'affected' ELSE 'clear' END AS status
  FROM c LEFT JOIN k ON k.module = split_part(path, '/', 1) || '/' || split_part(path, '/', 2)""")
def go_module_retry(spark, sf):
    """Verdicts of packages whose advisories stand under a parent module."""
    c, k = _paths(spark, sf)
    event = lambda name, value: F.struct(*[(F.lit(value) if n == name else F.lit(None)).cast("string").alias(n) for n in ("introduced", "fixed", "last_affected", "limit")])
    ranges = F.array(F.struct(F.lit("SEMVER").alias("type"), F.array(event("introduced", "0")).alias("events")))
    affected = F.array(F.struct(F.col("module").alias("name"), F.lit("Go").alias("ecosystem"), F.lit(None).cast("array<string>").alias("versions"), ranges.alias("ranges")))
    known = k.select(F.lit("vulnerability").alias("kind"), F.lit("Go").alias("ecosystem"), F.col("module").alias("name"), F.concat(F.lit("GO-"), "module").alias("id"), F.lit(None).cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("summary"), affected.cast(advisories.AFFECTED).alias("affected"))
    asked = c.select("page_id", F.col("path").alias("name"), F.lit("1.0.0").alias("version"), F.concat(F.lit("pkg:golang/"), "path", F.lit("@v1.0.0")).alias("purl"), F.lit(None).cast("array<string>").alias("declared"))
    got = advisories.match(asked, advisories.index(known, spark.createDataFrame([], "id string")), spark.createDataFrame([("Go", True)], "ecosystem string, loaded boolean"))
    return got.select("page_id", "via_module", "status")


@query(f"WITH {COMP} SELECT doc_id, idx FROM comp WHERE partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def kev_semi(spark, sf):
    """Components whose key is in a set: a semi join."""
    small = table(spark, sf, "part").where("p_size < 10").select(F.col("p_partkey").alias("partkey"))
    return components(spark, sf).join(small, "partkey", "left_semi").select("doc_id", "idx")


@query("SELECT o_orderkey AS doc_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def undeclared_anti(spark, sf):
    """Documents without a component: an anti join."""
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id")).join(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id")), "doc_id", "left_anti")


@query(f"""WITH {COMP}, v AS (SELECT *, CAST(split_part(version, '.', 1) AS INT) AS a, CAST(split_part(version, '.', 2) AS INT) AS b, CAST(split_part(version, '.', 3) AS INT) AS c FROM comp)
  SELECT doc_id, idx, CASE WHEN (a, b, c) < (3, 25, 5) THEN -1 WHEN (a, b, c) > (3, 25, 5) THEN 1 ELSE 0 END AS cmp, CAST(rank() OVER (PARTITION BY doc_id ORDER BY a, b, c) AS BIGINT) AS place FROM v""")
def semver_order(spark, sf):
    """Versions compared, and their order within a document."""
    c = components(spark, sf)
    place = F.rank().over(Window.partitionBy("doc_id").orderBy(versions.semver_key(F.col("version")))).cast("long")
    return c.select("doc_id", "idx", versions.semver_compare(F.col("version"), F.lit("3.25.5")).alias("cmp"), place.alias("place"))


@query(f"""WITH {COMP}, v AS (SELECT *, CAST(split_part(version, '.', 1) AS INT) AS a, CAST(split_part(version, '.', 2) AS INT) AS b, CAST(split_part(version, '.', 3) AS INT) AS c FROM comp)
  SELECT doc_id, idx, CASE WHEN partkey % 13 <> 0 THEN (a, b, c) < (2, 10, 0) OR ((a, b, c) >= (4, 0, 0) AND (a, b, c) <= (5, 20, 3)) END AS affected FROM v""")
def osv_range(spark, sf):
    """Is a version in a range with two windows? NULL where the range cannot be understood."""
    e = lambda **k: F.struct(*[F.lit(k.get(n)).cast("string").alias(n) for n in ("introduced", "fixed", "last_affected", "limit")])
    events = F.array(e(last_affected="5.20.3"), e(introduced="0"), e(fixed="2.10.0"), e(introduced="4.0.0"))
    # Ranges are rows: each is prepared once, and a component only meets the windows of its own.
    ranges = spark.createDataFrame([(False,), (True,)], "unclear boolean").withColumn("events", F.when(F.col("unclear"), F.array_append(events, e(limit="9.0.0"))).otherwise(events))
    ranges = ranges.select("unclear", versions.windows(versions.prepare_range(F.lit("SEMVER"), F.col("events"))).alias("windows"))
    asked = components(spark, sf).withColumn("unclear", F.col("partkey") % 13 == 0).join(F.broadcast(ranges), "unclear", "left")
    return asked.select("doc_id", "idx", versions.affected_in(F.col("version"), F.col("windows")).alias("affected"))


_RAWNAME = "CASE p_partkey % 6 WHEN 0 THEN p_name || '.tar.gz' WHEN 1 THEN 'lib' || p_name WHEN 2 THEN p_name || ' (FIPS)' WHEN 3 THEN upper(p_name) || '-v1.2.' || p_size WHEN 4 THEN replace(p_name, ' ', '_') || '.jar' ELSE '  ' || p_name || ' ' END"


def raw_names(spark: SparkSession, sf: str) -> DataFrame:
    """Part names in the shapes that documents give them."""
    k, n, size = F.col("p_partkey") % 6, F.col("p_name"), F.col("p_size").cast("string")
    shape = F.when(k == 0, F.concat(n, F.lit(".tar.gz"))).when(k == 1, F.concat(F.lit("lib"), n)).when(k == 2, F.concat(n, F.lit(" (FIPS)"))).when(k == 3, F.concat(F.upper(n), F.lit("-v1.2."), size)).when(k == 4, F.concat(F.replace(n, F.lit(" "), F.lit("_")), F.lit(".jar"))).otherwise(F.concat(F.lit("  "), n, F.lit(" ")))
    return table(spark, sf, "part").select("p_partkey", "p_name", shape.alias("input"))


_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '\\.(jar|whl|tar\\.gz|tgz|zip|exe|dll|so)$', ''), '\\s*\\([^)]*\\)\\s*$', ''), '[_\\s]+', '-', 'g'), '-v?[0-9][0-9.\\-_a-z]*$', ''), '-')"


@query(f"SELECT p_partkey, input, {_NORM.format('input')} AS norm FROM (SELECT p_partkey, {_RAWNAME} AS input FROM part)")
def norm_name(spark, sf):
    """The normal form of names."""
    return raw_names(spark, sf).select("p_partkey", "input", names.norm(F.col("input")).alias("norm"))


@query(f"""WITH raw AS (SELECT DISTINCT {_RAWNAME} AS input FROM part), dict AS (SELECT replace(p_name, ' ', '-') AS alias, 'pkg:npm/' || replace(p_name, ' ', '-') AS base, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1, 2 HAVING count(*) >= 2),
  t AS (SELECT input, trim(input) AS r, {_NORM.format('input')} AS norm FROM raw),
  f AS (SELECT t.input, d1.base AS b1, d2.base AS b2, d2.n AS n2, d3.base AS b3, d3.n AS n3, r, norm, d3.alias AS a3 FROM t LEFT JOIN dict d1 ON d1.alias = r LEFT JOIN dict d2 ON d2.alias = norm LEFT JOIN dict d3 ON norm LIKE 'lib%' AND d3.alias = substr(norm, 4))
  SELECT input, coalesce(b1, b2, b3) AS purl_base, CASE WHEN b1 IS NOT NULL THEN 'exact' WHEN b2 IS NOT NULL THEN 'dictionary' WHEN b3 IS NOT NULL THEN 'heuristic' END AS method FROM f""")
def resolve_tiers(spark, sf):
    """Names resolved through the tiers, or abstained from."""
    d = table(spark, sf, "part").groupBy(F.replace("p_name", F.lit(" "), F.lit("-")).alias("alias")).agg(F.count("*").alias("observations"))
    d = d.withColumn("purl_base", F.concat(F.lit("pkg:npm/"), "alias"))
    return resolve.resolve(raw_names(spark, sf).select("input").distinct(), d).select("input", "purl_base", "method")


@query("""WITH r AS (SELECT d.doc_id, CASE WHEN quality = 1 THEN lang END AS purl, CASE WHEN toxic = 1 THEN 'p' END AS pert, CASE WHEN n_chars % 3 = 0 THEN NULL WHEN n_chars % 3 = 1 THEN lang ELSE 'xx' END AS got FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
  s AS (SELECT 'all' AS subset, * FROM r UNION ALL SELECT CASE WHEN pert IS NULL THEN 'clean' ELSE 'perturbed' END, * FROM r),
  n AS (SELECT subset, count(*) AS "rows", count(purl) AS answerable, count(*) FILTER (got = purl) AS tp, count(*) FILTER (got IS NOT NULL AND (purl IS NULL OR got <> purl)) AS fp, count(*) FILTER (got IS NULL) AS ab, count(*) FILTER (purl IS NULL) AS unknown_class, count(*) FILTER (purl IS NULL AND got IS NOT NULL) AS unknown_fp FROM s GROUP BY subset),
  q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN answerable > 0 THEN tp / answerable ELSE 0 END AS r FROM n)
  SELECT subset, "rows", tp + fp AS answered, round(p::DOUBLE, 4) AS precision, round(r::DOUBLE, 4) AS recall, round((CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END)::DOUBLE, 4) AS f1, round((ab / "rows")::DOUBLE, 4) AS abstention, unknown_class, unknown_fp FROM q""")
def resolver_score(spark, sf):
    """A resolver scored on overlapping subsets."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    got = F.when(F.col("n_chars") % 3 == 1, F.col("lang")).when(F.col("n_chars") % 3 == 2, "xx")
    rows = d.select(F.lit("own").alias("resolver"), F.col("doc_id").cast("string").alias("input"), F.when(F.col("quality") == 1, F.col("lang")).alias("purl"), F.when(F.col("toxic") == 1, "p").alias("perturbation"), got.alias("got"))
    return resolve.score(rows).drop("resolver")


CYCLES = [("small", "1", "2024-01-01", None), ("small", "1.1", "2030-01-01", None), ("small", "2", None, True), ("large", "3", None, False), ("large", "3.2", "2025-06-30", None), ("large", "3.25", "2019-01-01", None)]


@query(f"""WITH {COMP}, cyc(product, cycle, eol, flag) AS (VALUES ('small', '1', DATE '2024-01-01', NULL), ('small', '1.1', DATE '2030-01-01', NULL), ('small', '2', NULL, true), ('large', '3', NULL, false), ('large', '3.2', DATE '2025-06-30', NULL), ('large', '3.25', DATE '2019-01-01', NULL)),
  p AS (SELECT *, CASE WHEN split_part(name, ' ', 1) IN ('small', 'large') THEN split_part(name, ' ', 1) END AS product FROM comp),
  m AS (SELECT p.doc_id, p.idx, cycle, eol, cyc.flag AS flag, row_number() OVER (PARTITION BY p.doc_id, p.idx ORDER BY length(cycle) DESC) AS k FROM p JOIN cyc ON cyc.product = p.product AND starts_with(version, cycle) AND NOT regexp_matches(substr(version, length(cycle) + 1, 1), '^[0-9]$'))
  SELECT p.doc_id, p.idx, m.cycle, CAST(m.eol AS VARCHAR) AS end_of_support, CASE WHEN m.cycle IS NULL THEN NULL WHEN m.eol IS NOT NULL THEN m.eol < DATE '2026-01-01' ELSE NOT m.flag END AS past_end,
    CASE WHEN p.product IS NULL THEN 'no data for this component' WHEN m.cycle IS NULL THEN 'in no release line' END AS why
  FROM p LEFT JOIN m ON m.doc_id = p.doc_id AND m.idx = p.idx AND m.k = 1""")
def support_lines(spark, sf):
    """Release line by longest prefix, and is it past its end?"""
    cycles = spark.createDataFrame(CYCLES, "product string, cycle string, eol string, eol_flag boolean").select("product", "cycle", F.col("eol").cast("date").alias("eol_date"), "eol_flag")
    c = components(spark, sf).select("doc_id", "idx", F.split_part("name", F.lit(" "), F.lit(1)).alias("name"), "version", F.struct("doc_id", "idx").alias("component_id"))
    products = spark.createDataFrame([("small", "small"), ("large", "large")], "name string, product string")
    return support.support_state(c, products, cycles, "2026-01-01").select("doc_id", "idx", "cycle", F.col("end_of_support").cast("string").alias("end_of_support"), "past_end", "why")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def first_wins_dedup(spark, sf):
    """The first document of each distinct text."""
    return table(spark, sf, "documents").groupBy("text").agg(F.min(F.struct("doc_id", "lang")).alias("d")).select("d.doc_id", "d.lang")


def _workspace(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    projects = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("firm_id"))
    checks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")).alias("project_id"), (F.col("o_custkey") % 25).cast("int").alias("firm_id"), (F.col("o_custkey") % 97).alias("user_id"), F.col("o_orderdate").alias("created_at"))
    return projects, checks


_CHECKS = "checks AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS project_id, CAST(o_custkey % 25 AS INT) AS firm_id, o_custkey % 97 AS user_id, o_orderdate AS created_at FROM orders)"


@query(f"WITH {_CHECKS} SELECT c_custkey AS id, c_name AS name, count(c.id) AS check_count, max(c.created_at) AS last_check_at FROM customer LEFT JOIN checks c ON c.project_id = c_custkey GROUP BY ALL")
def project_counts(spark, sf):
    """Projects with their checks; empty ones kept."""
    projects, checks = _workspace(spark, sf)
    return workspace.project_summary(projects, checks).select("id", "name", "check_count", "last_check_at")


@query(f"WITH {_CHECKS} SELECT c.id, c.created_at, p.c_name AS project_name FROM checks c LEFT JOIN customer p ON p.c_custkey = c.project_id ORDER BY c.created_at DESC, c.id DESC LIMIT 50 OFFSET 10")
def recent_history(spark, sf):
    """A page of the history, newest first."""
    projects, checks = _workspace(spark, sf)
    return workspace.recent_checks(checks, projects.select("id", "name"), 50, 10).select("id", "created_at", "project_name")


@query(f"WITH {_CHECKS} SELECT n_nationkey AS firm_id, n_name AS name, count(DISTINCT user_id) AS seats_used, count(*) FILTER (created_at >= TIMESTAMP '1998-07-01') AS checks_this_month FROM nation LEFT JOIN checks ON firm_id = n_nationkey GROUP BY ALL")
def seat_usage(spark, sf):
    """Seats used and checks of the month, per firm."""
    firms = table(spark, sf, "nation").select(F.col("n_nationkey").alias("firm_id"), F.col("n_name").alias("name"))
    return workspace.seat_usage(firms, _workspace(spark, sf)[1], "1998-07-19")


@query(f"WITH {_CHECKS} SELECT firm_id, id, created_at FROM checks WHERE firm_id = 3")
def tenant_view(spark, sf):
    """What one firm may see."""
    workspace.claim(spark, 3)
    seen = workspace.guard(_workspace(spark, sf)[1], "guarded_checks").select("firm_id", "id", "created_at")
    workspace.claim(spark, None)
    return seen


@query("SELECT event_id AS id, event_type AS action, ts AS occurred_at FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def audit_trail(spark, sf):
    """The last hundred actions."""
    log = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("action"), F.col("ts").alias("occurred_at"))
    return workspace.audit_trail(log)


@query("""WITH RECURSIVE t(doc_id, level, path, k) AS (SELECT o_orderkey, 0, '$.components[0]', o_orderkey % 4 FROM orders UNION ALL SELECT doc_id, level + 1, path || '.components[0]', k FROM t WHERE level < k)
  SELECT doc_id, level, path, 'n' || level AS name FROM t""")
def nested_flatten(spark, sf):
    """Components nested up to four deep, flattened with their paths."""
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 4).alias("k"))
    inner = None
    for level in (3, 2, 1, 0):
        own = F.lit(f'{{"name":"n{level}"')
        inner = F.concat(own, F.lit("}")) if inner is None else F.concat(own, F.when(F.col("k") > level, F.concat(F.lit(',"components":['), inner, F.lit("]"))).otherwise(""), F.lit("}"))
    made = docs.select("doc_id", F.parse_json(F.concat(F.lit('{"components":['), inner, F.lit("]}"))).alias("doc"))
    return coverage.component_tree(made).select("doc_id", "level", "path", F.try_variant_get("component", "$.name", "string").alias("name"))


_KINDS = """CASE p_partkey % 6 WHEN 0 THEN 'pkg:npm/%40acme/' || p_partkey || '@1.0.0' WHEN 1 THEN 'pkg:golang/github.com/acme/p' || p_partkey || '@v1.2.3#sub' WHEN 2 THEN 'pkg:maven/org.acme.x/p' || p_partkey || '@2'
  WHEN 3 THEN 'pkg:deb/debian/p' || p_partkey || '@3.0%2Bb1?arch=all&distro=debian-' || (p_partkey % 3 + 10) || '.2' WHEN 4 THEN 'pkg:nuget/P' || p_partkey ELSE 'pkg:cargo/p' || p_partkey || '@1' END"""


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'npm' WHEN 1 THEN 'Go' WHEN 2 THEN 'Maven' WHEN 3 THEN 'Debian:' || (p_partkey % 3 + 10) WHEN 4 THEN 'NuGet' END AS ecosystem,
  CASE p_partkey % 6 WHEN 0 THEN '@acme/' || p_partkey WHEN 1 THEN 'github.com/acme/p' || p_partkey WHEN 2 THEN 'org.acme.x:p' || p_partkey WHEN 3 THEN 'p' || p_partkey WHEN 4 THEN 'P' || p_partkey END AS name,
  CASE p_partkey % 6 WHEN 0 THEN '1.0.0' WHEN 1 THEN 'v1.2.3' WHEN 2 THEN '2' WHEN 3 THEN '3.0+b1' WHEN 5 THEN '1' END AS version, CASE WHEN p_partkey % 6 = 5 THEN 'ecosystem not mirrored' END AS why FROM part""")
def purl_parse(spark, sf):
    """Package URLs of six kinds as advisory keys."""
    p = table(spark, sf, "part").select("p_partkey", F.expr(_KINDS).alias("purl"))
    return p.select("p_partkey", F.inline(F.array(purl.purl_key(purl.purl_parts(F.col("purl"))))))


@query("SELECT doc_id, sha256(text) AS sha256, substr(sha256(doc_id || chr(0) || source || chr(0) || lang), 1, 16) AS check_id FROM documents")
def bundle_digest(spark, sf):
    """Digests of files, and check ids over joined fields."""
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), texts.check_id(F.col("doc_id"), F.col("source"), F.col("lang")).alias("check_id"))


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderpriority <> '1-URGENT')
  SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'absent' WHEN b.k IS NULL THEN 'gone' WHEN a.v = b.v THEN 'same' ELSE 'drifted' END AS state FROM a FULL OUTER JOIN b ON a.k = b.k""")
def full_outer_diff(spark, sf):
    """Stored against live: same, drifted, gone, absent."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("cycle"), F.lit("p").alias("product"), F.col("o_orderstatus").alias("eol"), "o_orderpriority")
    live = o.where("o_orderpriority <> '1-URGENT'").withColumn("eol", F.when(F.col("cycle") % 3 == 0, "X").otherwise(F.col("eol")))
    return support.freshness(o.where("eol <> 'P'"), live).select(F.col("cycle").alias("k"), "state")


@query("""SELECT o_orderkey AS doc_id, CASE o_orderkey % 6 WHEN 0 THEN 'cyclonedx' WHEN 1 THEN 'spdx' WHEN 2 THEN 'spdx' WHEN 3 THEN 'spdx' WHEN 4 THEN 'cyclonedx' END AS format,
  CASE o_orderkey % 6 WHEN 0 THEN '1.' || (o_orderkey % 9) WHEN 1 THEN '2.3' WHEN 2 THEN '3.0.1' WHEN 3 THEN 'unknown' WHEN 4 THEN 'unknown' END AS spec,
  CASE o_orderkey % 6 WHEN 0 THEN o_orderkey % 9 BETWEEN 2 AND 7 WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS supported FROM orders""")
def detect_format(spark, sf):
    """Formats and versions by the ladder of tests."""
    k = F.col("o_orderkey")
    raw = (
        F.when(k % 6 == 0, F.concat(F.lit('{"bomFormat":"CycloneDX","specVersion":"1.'), (k % 9).cast("string"), F.lit('"}')))
        .when(k % 6 == 1, '{"spdxVersion":"SPDX-2.3"}')
        .when(k % 6 == 2, '{"@context":"https://spdx.org/rdf/3.0.1/spdx-context.jsonld","@graph":[{"type":"CreationInfo","specVersion":"3.0.1"}]}')
        .when(k % 6 == 3, '{"SPDXID":"x"}')
        .when(k % 6 == 4, '{"components":[]}')
        .otherwise('{"other":1}')
    )
    d = table(spark, sf, "orders").select(k.alias("doc_id"), detect.detect(F.try_parse_json(raw)).alias("d"))
    return d.select("doc_id", "d.format", "d.spec", "d.supported")


def graph_documents(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id and doc: every order as a graph document with its customer, a package, annotations, and elements that no view has."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    q = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    key = F.col("o_orderkey").cast("string")
    rel = F.when(F.col("o_orderkey") % 3 == 0, ',{"type":"Relationship","from":"urn:p","to":["urn:l"],"relationshipType":"hasDeclaredLicense"},{"type":"simplelicensing_LicenseExpression","spdxId":"urn:l","simplelicensing_licenseExpression":"MIT"}').otherwise("")
    note = F.when(F.col("o_orderstatus") == "F", q(',{"type":"Annotation","subject":"urn:p","annotationType":"review","statement":"', F.col("o_orderpriority"), '"},{"type":"Annotation","statement":"whole"}')).otherwise("")
    odd = F.when(F.col("o_orderkey") % 5 == 0, ',{"type":"ai_Model"},{"type":"Relationship","from":"urn:p","to":["urn:o","urn:x"],"relationshipType":"dependsOn"}').otherwise("")
    raw = q('{"@context":"https://spdx.org/rdf/3.0.1/x","@graph":[{"type":"Organization","spdxId":"urn:o","name":"old"},{"type":"Organization","spdxId":"urn:o","name":"', F.col("c_name"), '"},{"type":"software_Package","spdxId":"urn:p","name":"pkg', key, '","weight":1,"suppliedBy":"urn:o","verifiedUsing":[{"type":"Hash","algorithm":"sha-256","hashValue":"ab"}]}', rel, note, odd, "]}")
    # A document weighs far more than its order, so small files are dealt out before documents are made.
    return o.repartition("o_orderkey").select(F.col("o_orderkey").alias("doc_id"), F.parse_json(raw).alias("doc"))


@query("""SELECT o_orderkey AS doc_id, 'pkg' || o_orderkey AS name, 'Organization: ' || c_name AS supplier, CASE WHEN o_orderkey % 3 = 0 THEN 'MIT' END AS license, 'SHA256' AS algorithm,
  CASE WHEN o_orderstatus = 'F' THEN 'REVIEW' END AS note_type, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS note, CASE WHEN o_orderstatus = 'F' THEN 'whole' END AS document_note, CASE WHEN o_orderkey % 5 = 0 THEN 'DEPENDS_ON' END AS relation FROM orders JOIN customer ON o_custkey = c_custkey""")
def graph_view(spark, sf):
    """Graph documents as flat ones: references resolved to names, licences, checksums and annotations."""
    d = graph.flat_view(graph_documents(spark, sf))
    get = lambda p: F.try_variant_get("doc", p, "string")
    return d.select(
        "doc_id",
        get("$.packages[0].name").alias("name"),
        get("$.packages[0].supplier").alias("supplier"),
        get("$.packages[0].licenseDeclared").alias("license"),
        get("$.packages[0].checksums[0].algorithm").alias("algorithm"),
        get("$.packages[0].annotations[0].annotationType").alias("note_type"),
        get("$.packages[0].annotations[0].comment").alias("note"),
        get("$.annotations[0].comment").alias("document_note"),
        get("$.relationships[0].relationshipType").alias("relation"),
    )


@query("""SELECT o_orderkey AS doc_id, 1::BIGINT AS packages, (o_orderkey % 5 = 0)::BIGINT AS relationships, 2::BIGINT AS agents, CASE WHEN o_orderkey % 5 = 0 THEN 'model' ELSE '' END AS unmapped_types, 'weight' AS unmapped_package_keys FROM orders""")
def graph_accounting(spark, sf):
    """What the flat view of a graph document has and what it leaves out, as a check of the document reports it."""
    pack = rules.Pack("graph", "1", "", (rules.Rule("G1", "info", "$.packages[*]", {"exists": "name"}, applies_to=("spdx",)),))
    a = rules.evaluate(graph_documents(spark, sf), pack).where(F.col("rule_order") == rules.DOCUMENT).select("doc_id", "accounting.*")
    return a.withColumns({c: F.array_join(c, ",") for c in ("unmapped_types", "unmapped_package_keys")})


@query("""SELECT kind, ecosystem, count(DISTINCT name) AS names, count(DISTINCT id) AS advisories FROM (SELECT CASE WHEN p_partkey % 7 = 0 THEN 'malicious' ELSE 'vulnerability' END AS kind, 'npm' AS ecosystem, replace(p_name, ' ', '-') || '-' || lower(replace(p_brand, '#', '-')) AS name, 'ADV-' || p_partkey AS id FROM part) GROUP BY ALL""")
def mirror_counts(spark, sf):
    """Advisories and names of each shard of the mirror, doubled rows counted once."""
    rows = mirror(spark, sf)[0]
    return mirrors.counts(rows.unionByName(rows))


@query(f"""WITH {COMP}, own AS (SELECT doc_id, idx, 'CVE-' || (partkey % 50) AS id FROM comp WHERE flag = 'R'), whole AS (SELECT o_orderkey AS doc_id, 'CVE-X' AS id FROM orders WHERE o_orderstatus = 'F')
  SELECT c.doc_id, c.idx, CAST((o.id IS NOT NULL)::INT + (w.id IS NOT NULL)::INT AS BIGINT) AS n_declared FROM comp c LEFT JOIN own o ON o.doc_id = c.doc_id AND o.idx = c.idx LEFT JOIN whole w ON w.doc_id = c.doc_id""")
def declared_by_ref(spark, sf):
    """Advisories declared for a component or for its whole document."""
    c = components(spark, sf).select("doc_id", "idx", F.col("idx").cast("string").alias("ref"), "partkey", "flag")
    own = c.where("flag = 'R'").select("doc_id", F.concat(F.lit("CVE-"), (F.col("partkey") % 50).cast("string")).alias("id"), F.lit(None).cast("array<string>").alias("references"), F.array("ref").alias("affects"))
    whole = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id"), F.lit("CVE-X").alias("id"), F.lit(None).cast("array<string>").alias("references"), F.lit(None).cast("array<string>").alias("affects"))
    got = advisories.with_declared(c, advisories.declared_by_ref(own.unionByName(whole)))
    return got.select("doc_id", "idx", F.size("declared").cast("long").alias("n_declared"))


@query("""SELECT p_partkey, lower(replace(trim(p_name), ' ', '%20')) AS slug, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS header, regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g') AS shard,
  replace('<b>' || p_name || ' & co</b>', '&', '&amp;').replace('<', '&lt;').replace('>', '&gt;') AS escaped, 'DEPENDS_ON' AS relation FROM part""")
def name_functions(spark, sf):
    """Slugs, headings, shard names, escaped text, relationship types."""
    p = table(spark, sf, "part")
    return p.select("p_partkey", names.slugify(F.col("p_name")).alias("slug"), names.header_key(F.col("p_type")).alias("header"), names.ecosystem_slug(F.col("p_brand")).alias("shard"), names.html_escape(F.concat(F.lit("<b>"), "p_name", F.lit(" & co</b>"))).alias("escaped"), names.upper_snake(F.lit("dependsOn")).alias("relation"))


_SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"
_LADDER = f"""n AS (SELECT DISTINCT CASE p_size % 5 WHEN 0 THEN p_name || '-core' WHEN 1 THEN 'lib' || p_name WHEN 2 THEN 'acme/' || p_name WHEN 3 THEN 'Acme ' || split_part(p_name, ' ', 2) ELSE p_name || '7' END AS name FROM part),
  s AS (SELECT name, {_SLUG.format('name')} AS w FROM n),
  t AS (SELECT name, 0 AS k, w AS slug FROM s UNION ALL SELECT name, 1, split_part(w, '-', -1) FROM s UNION ALL SELECT name, 2, regexp_replace(w, '^(lib|python3?-|golang-|node-|ruby-|perl-)', '') FROM s
    UNION ALL SELECT name, 3, regexp_replace(w, '(-js|-core|-client|-server|-common|-dev|[0-9]+)$', '') FROM s UNION ALL SELECT name, 4, {_SLUG.format("split_part(name, '/', -1)")} FROM s WHERE contains(name, '/')),
  p AS (SELECT DISTINCT p_name AS product FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part WHERE p_name LIKE 's%'),
  m AS (SELECT t.name, p.product, row_number() OVER (PARTITION BY t.name ORDER BY t.k, p.product DESC) AS r FROM t JOIN p ON {_SLUG.format('p.product')} = t.slug)"""


def _slug_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Names in five shapes, and products: whole part names and second words of some."""
    k, n = F.col("p_size") % 5, F.col("p_name")
    second = F.split_part(n, F.lit(" "), F.lit(2))
    shaped = F.when(k == 0, F.concat(n, F.lit("-core"))).when(k == 1, F.concat(F.lit("lib"), n)).when(k == 2, F.concat(F.lit("acme/"), n)).when(k == 3, F.concat(F.lit("Acme "), second)).otherwise(F.concat(n, F.lit("7")))
    parts = table(spark, sf, "part")
    products = parts.select(n.alias("product")).union(parts.where(F.startswith(n, F.lit("s"))).select(second)).distinct()
    return parts.select(shaped.alias("name")), products


@query(f"WITH {_LADDER} SELECT name, product FROM m WHERE r = 1")
def product_slugs(spark, sf):
    """Component names to products by the nearest slug."""
    return support.match_products(*_slug_sides(spark, sf))


@query(f"""WITH {_LADDER}, i AS (SELECT CASE p_size % 5 WHEN 0 THEN p_name || '-core' WHEN 1 THEN 'lib' || p_name WHEN 2 THEN 'acme/' || p_name WHEN 3 THEN 'Acme ' || split_part(p_name, ' ', 2) ELSE p_name || '7' END AS name FROM part)
  SELECT count(DISTINCT i.name) AS names, count(*) AS instances, count(DISTINCT m.name) AS names_matched, count(m.name) AS instances_matched,
    round(100.0 * count(DISTINCT m.name) / count(DISTINCT i.name), 1)::DOUBLE AS names_percent, round(100.0 * count(m.name) / count(*), 1)::DOUBLE AS instances_percent FROM i LEFT JOIN m ON m.name = i.name AND m.r = 1""")
def product_coverage(spark, sf):
    """How many names and instances have support data."""
    return support.product_coverage(*_slug_sides(spark, sf))


@query("""WITH e AS (SELECT event_type AS target, CAST(json_extract(props, '$.k') AS INT) % 3 AS fit FROM events) SELECT target, count(*) FILTER (fit = 0) AS exact, count(*) FILTER (fit = 1) AS partial, count(*) FILTER (fit = 2) AS "none", count(*) AS total FROM e GROUP BY target""")
def crosswalk_tally(spark, sf):
    """Mappings by target and fit, with a total that must add up."""
    fit = F.try_variant_get(F.try_parse_json("props"), "$.k", "int") % 3
    e = table(spark, sf, "events").select(F.col("event_type").alias("target"), F.when(fit == 0, "exact").when(fit == 1, "partial").otherwise("none").alias("fit"))
    return texts.crosswalk_tally(e)


@query("""WITH f AS (SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de')), g AS (SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr')), s AS ((SELECT * FROM f) EXCEPT (SELECT * FROM g)), i AS ((SELECT * FROM f) INTERSECT (SELECT * FROM g)) SELECT 'difference' AS part, count(*) AS n FROM s UNION ALL SELECT 'intersection', count(*) FROM i UNION ALL SELECT 'union', count(*) FROM (SELECT * FROM f UNION SELECT * FROM g)""")
def set_operations(spark, sf):
    """Difference, intersection and union of two sets of rows."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    f, g = d.where("lang IN ('en', 'de')"), d.where("lang IN ('de', 'fr')")
    n = lambda name, x: x.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return n("difference", f.exceptAll(g)).unionByName(n("intersection", f.intersect(g))).unionByName(n("union", f.unionByName(g).distinct()))


@query("SELECT user_id, list_extract(list_sort(list(value)), CAST(floor(count(*) / 2) AS INT) + 1) AS upper_median, CAST(date_diff('day', max(ts)::DATE, DATE '2024-06-01') AS INT) AS days_since, date_diff('day', max(ts)::DATE, DATE '2024-06-01') > 90 AS stale FROM events GROUP BY user_id")
def staleness(spark, sf):
    """The upper median by rank, days since the last event, and is it over ninety?"""
    e = table(spark, sf, "events").select("user_id", "value", "ts")
    last = e.groupBy("user_id").agg(F.max("ts").alias("last"))
    by = last.join(texts.grouped_upper_median(e, "user_id", "value"), "user_id", "left")
    return by.select("user_id", "upper_median", texts.days_since(F.col("last"), "2024-06-01").alias("days_since"), texts.stale(F.col("last"), "2024-06-01").alias("stale"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'cyclonedx' ELSE 'spdx' END AS format, CASE p_partkey % 4 WHEN 0 THEN 'MD5' WHEN 1 THEN 'SHA1' WHEN 2 THEN 'BLAKE3' ELSE 'CRC' END AS algorithm,
  CASE WHEN p_partkey % 4 = 0 THEN 'registered' WHEN p_partkey % 4 = 1 AND p_size % 2 = 1 THEN 'registered' WHEN p_partkey % 4 = 2 THEN 'unregistered' ELSE 'unknown' END AS outcome FROM part""")
def hash_vocabulary(spark, sf):
    """Hash algorithms against the registered names, with three outcomes."""
    k = F.col("p_partkey") % 4
    h = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "cyclonedx").otherwise("spdx").alias("format"), F.when(k == 0, "MD5").when(k == 1, "SHA1").when(k == 2, "BLAKE3").otherwise("CRC").alias("algorithm"))
    return texts.hash_vocabulary(h).select("p_partkey", "format", "algorithm", "outcome")


_SIZE = "CASE WHEN {0} < 1024 THEN {0} || ' bytes' WHEN {0} < 1000000 THEN CAST(round({0} / 1024.0) AS BIGINT) || ' KB' ELSE CAST(round({0} / 1000000.0, 1) AS DECIMAL(20, 1)) || ' MB' END"


@query(f"SELECT doc_id, {_SIZE.format('n_chars')} AS size, {_SIZE.format('(n_chars * 1000)')} AS size_of_thousand, 'Checked ' || lang || ' by {{engine}}, {{lang}}' AS attested FROM documents")
def report_texts(spark, sf):
    """Sizes for readers, and templates filled in one pass."""
    n = F.col("n_chars").cast("long")
    attested = texts.fill(F.lit("Checked {lang} by {engine}, {quoted}"), {"lang": F.col("lang"), "quoted": F.lit("{lang}")})
    return table(spark, sf, "documents").select("doc_id", texts.human_size(n).alias("size"), texts.human_size(n * 1000).alias("size_of_thousand"), attested.alias("attested"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://') AND NOT regexp_matches(url, '[\\s\"<>'']') THEN url END AS logo FROM pages")
def safe_logo(spark, sf):
    """Addresses that may stand in a report."""
    return table(spark, sf, "pages").select("page_id", texts.safe_logo(F.col("url")).alias("logo"))


# Readers and writers over files made from the tables.


def _csv_files(spark: SparkSession, sf: str) -> DataFrame:
    """(path, content): the nations of each region as a comma separated file, one with a blank row, quotes and a ragged row."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", quoted(F.concat("n_name", F.lit(', "N"\nland'))), F.concat(F.lit("1."), F.col("n_nationkey").cast("string")), F.when(F.col("n_nationkey") > 4, F.lit("acme")))
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", line.alias("line")))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["line"]), "\r\n\r\n")
    return n.select(F.concat(F.lit("region-"), F.col("n_regionkey").cast("string"), F.lit(".csv")).alias("path"), F.concat(F.lit("\ufeff\r\nLibrary,Version,Vendor,Colour\r\n"), body, F.lit("\r\n")).cast("binary").alias("content"))


_CSV = "r AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)"


@query(f"""WITH {_CSV} SELECT 'region-' || n_regionkey || '.csv' AS path, CAST(2 * k - 1 AS INT) AS row_number, n_name || ', "N"' || chr(10) || 'land' AS first_cell, CAST(CASE WHEN n_nationkey > 4 THEN 3 ELSE 2 END AS INT) AS n_cells, true AS ragged FROM r
  UNION ALL SELECT 'region-' || r_regionkey || '.csv', 0, 'Library', 4, false FROM region""")
def csv_tables(spark, sf):
    """Cells of comma separated files: quotes, line breaks in cells, blank and ragged rows, a byte order mark."""
    rows = readers_of_tables.read_tables(_csv_files(spark, sf))
    return rows.select("path", "row_number", F.col("cells")[0].alias("first_cell"), F.size("cells").alias("n_cells"), "ragged")


@query(f"""WITH {_CSV} SELECT 'region-' || n_regionkey || '.csv' AS doc_id, CAST(k - 1 AS BIGINT) AS at, n_name || ', "N"' || chr(10) || 'land' AS name, '1.' || n_nationkey AS version, CASE WHEN n_nationkey > 4 THEN 'acme' END AS publisher, true AS draft FROM r""")
def draft_documents(spark, sf):
    """Supplier tables as draft documents."""
    docs = draft.documents(readers_of_tables.read_tables(_csv_files(spark, sf)))
    each = coverage.component_tree(docs).join(docs.select("doc_id", detect.is_draft(F.col("doc")).alias("draft")), "doc_id")
    get = lambda k: F.try_variant_get("component", f"$.{k}", "string").alias(k)
    return each.select("doc_id", F.regexp_extract("path", r"\[(\d+)\]", 1).cast("long").alias("at"), get("name"), get("version"), get("publisher"), "draft")


@query("SELECT 'region-' || n_regionkey || '.csv' AS path, 'Colour' AS columns, count(*) AS n_rows, 0::BIGINT AS n_problems FROM nation GROUP BY n_regionkey")
def draft_unmapped(spark, sf):
    """Headings that no field takes, and rows read, of each supplier table."""
    return draft.unmapped(readers_of_tables.read_tables(_csv_files(spark, sf))).withColumn("columns", F.array_join("columns", ","))


def _json_files(spark: SparkSession, sf: str) -> DataFrame:
    """(path, content): orders as JSON files, among them damaged, empty, doubled-key and unknown ones."""
    k, key = F.col("o_orderkey") % 7, F.col("o_orderkey").cast("string")
    raw = (
        F.when(k == 0, F.concat(F.lit('\ufeff{"bomFormat":"CycloneDX","specVersion":"1.5","components":[{"name":"n'), key, F.lit('"}]}')))
        .when(k == 1, '{"bomFormat":"CycloneDX","specVersion":"1.5","components":[]}')
        .when(k == 2, '{"bomFormat":"CycloneDX","specVersion":"0.9","specVersion":"9.9","components":[{"name":"x"}]}')
        .when(k == 3, F.concat(F.lit('{"bomFormat":"CycloneDX", '), key))
        .when(k == 4, " ")
        .when(k == 5, "[1, 2]")
        .otherwise('{"other":1}')
    )
    return table(spark, sf, "orders").select(F.concat(F.lit("in/"), key, F.lit(".json")).alias("path"), raw.cast("binary").alias("content"))


@query("""SELECT o_orderkey || '.json' AS doc_id, CASE o_orderkey % 7 WHEN 0 THEN 'checked' WHEN 1 THEN 'no-components' WHEN 2 THEN 'unsupported-version' WHEN 3 THEN 'not-json' WHEN 4 THEN 'empty' WHEN 5 THEN 'not-an-object' ELSE 'unknown-format' END AS outcome FROM orders""")
def document_outcomes(spark, sf):
    """What a reader is told of each document file before any rule runs."""
    return readers.outcome(readers.parse_documents(_json_files(spark, sf)))


@query("""SELECT o_orderkey || '.json' AS doc_id, sha256(CASE o_orderkey % 7 WHEN 0 THEN chr(65279) || '{"bomFormat":"CycloneDX","specVersion":"1.5","components":[{"name":"n' || o_orderkey || '"}]}' WHEN 1 THEN '{"bomFormat":"CycloneDX","specVersion":"1.5","components":[]}'
  WHEN 2 THEN '{"bomFormat":"CycloneDX","specVersion":"0.9","specVersion":"9.9","components":[{"name":"x"}]}' WHEN 3 THEN '{"bomFormat":"CycloneDX", ' || o_orderkey WHEN 4 THEN ' ' WHEN 5 THEN '[1, 2]' ELSE '{"other":1}' END) AS sha256, o_orderkey % 7 NOT IN (3, 4) AS parsed, CASE o_orderkey % 7 WHEN 0 THEN '1.5' WHEN 1 THEN '1.5' WHEN 2 THEN '9.9' END AS spec FROM orders""")
def document_files(spark, sf):
    """Document files parsed: byte order marks, doubled keys (the last wins), digests of the bytes."""
    d = readers.parse_documents(_json_files(spark, sf))
    return d.select("doc_id", "sha256", F.col("doc").isNotNull().alias("parsed"), F.try_variant_get("doc", "$.specVersion", "string").alias("spec"))


@query("SELECT o_orderkey || '.json' AS doc_id, CASE o_orderkey % 7 WHEN 3 THEN CAST(26 + length(CAST(o_orderkey AS VARCHAR)) * 0 AS BIGINT) WHEN 4 THEN 1 END AS offset_of, o_orderkey % 7 IN (3, 4) AS broken FROM orders")
def json_problems(spark, sf):
    """The first place where a text is no JSON."""
    raw = F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "")
    f = _json_files(spark, sf).select(F.element_at(F.split("path", "/"), -1).alias("doc_id"), texts.json_problem(raw).alias("p"))
    return f.select("doc_id", F.col("p.offset").alias("offset_of"), F.col("p.offset").isNotNull().alias("broken"))


def _zip(lists: pd.Series) -> pd.Series:
    """Zip archives of lists of (name, text); a NULL list makes a damaged archive."""

    def one(entries):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for e in [] if entries is None else entries:
                z.writestr(e["name"], e["text"])
        return out.getvalue() if entries is not None else out.getvalue()[:10]

    return lists.map(one)


def _exports(spark: SparkSession, sf: str) -> DataFrame:
    """(path, content, ecosystem): advisories of parts as zip exports by brand, an empty and a damaged one beside them."""
    p = table(spark, sf, "part")
    kind = F.when(F.col("p_partkey") % 7 == 0, "MAL-").otherwise("ADV-")
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    text = F.to_json(F.struct(F.concat(kind, F.col("p_partkey").cast("string")).alias("id"), F.array(F.struct(F.struct(name.alias("name"), F.lower("p_brand").alias("ecosystem")).alias("package"))).alias("affected")))
    entry = F.struct(F.concat(F.col("p_partkey").cast("string"), F.lit(".json")).alias("name"), text.alias("text"))
    lists = p.groupBy(F.lower("p_brand").alias("ecosystem")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    odd = spark.createDataFrame([("hollow", []), ("broken", None)], "ecosystem string, entries array<struct<name:string,text:string>>")
    zipped = F.pandas_udf(_zip, "binary")("entries")
    return lists.unionByName(odd).select(F.concat(F.lit("exports/"), "ecosystem", F.lit(".zip")).alias("path"), zipped.alias("content"), "ecosystem")


def _mirror_folder(spark: SparkSession, sf: str) -> str:
    folder = f"{shared_dir(spark)}/mirror-{uuid.uuid4().hex}"
    # An archive is made once and is a file of its own, so that archives are opened side by side.
    exports = written(_exports(spark, sf).repartition(32), "exports")
    mirrors.build(exports, spark.createDataFrame([("CVE-1",)], "id string"), folder, "2026-01-01")
    return folder


@query("""SELECT lower(p_brand) AS ecosystem, true AS loaded, 1::BIGINT AS exports, count(*) FILTER (p_partkey % 7 <> 0) AS vulnerabilities, count(*) FILTER (p_partkey % 7 = 0) AS malicious, false AS problem FROM part GROUP BY ALL
  UNION ALL VALUES ('hollow', true, 1, 0, 0, false), ('broken', false, 1, 0, 0, true)""")
def mirror_status(spark, sf):
    """A mirror built from exports: what is held, an empty export and a damaged one told apart."""
    got = mirrors.status(mirrors.open_mirror(spark, _mirror_folder(spark, sf))[2])
    return got.select("ecosystem", "loaded", "exports", "vulnerabilities", "malicious", F.col("problem").isNotNull().alias("problem"))


@query("""SELECT CASE WHEN p_partkey % 7 = 0 THEN 'malicious' ELSE 'vulnerability' END AS kind, lower(p_brand) AS ecosystem, replace(p_name, ' ', '-') AS name, CASE WHEN p_partkey % 7 = 0 THEN 'MAL-' ELSE 'ADV-' END || p_partkey AS id, lower(p_brand) || '.zip' AS source FROM part""")
def mirror_rows(spark, sf):
    """The advisories of a mirror, written as shards and read back."""
    return mirrors.open_mirror(spark, _mirror_folder(spark, sf))[0].select("kind", "ecosystem", "name", "id", "source")


@query("""SELECT lower(p_brand) AS ecosystem, count(*) AS advisories, false AS broken FROM part WHERE p_partkey % 7 = 0 GROUP BY ALL""")
def mirror_asked_shards(spark, sf):
    """Malicious packages by ecosystem: of a mirror's shards only those of that kind are read."""
    rows = mirrors.open_mirror(spark, _mirror_folder(spark, sf))[0].where("kind = 'malicious'")
    return rows.groupBy("ecosystem").agg(F.count("id").alias("advisories"), F.bool_or(F.col("problem").isNotNull()).alias("broken"))


@query(f"WITH {FOUND}, f AS (SELECT doc_id, rule_id, count(*) AS m FROM found GROUP BY ALL) SELECT d.doc_id, 'cyclonedx' AS format, r.rule_id, CAST(coalesce(m, 0) AS INT) AS n FROM docs d CROSS JOIN (VALUES ('R1-PURL'), ('R2-SUPPLIER'), ('R3-VERSION'), ('R4-LICENCE'), ('R5-TIME'), ('R6-NAMED')) r(rule_id) LEFT JOIN f ON f.doc_id = d.doc_id AND f.rule_id = r.rule_id")
def golden_records(spark, sf):
    """Stable records of a run: every rule that ran, those that pass with an empty list."""
    g = report.golden(rules.rule_runs(*_checked(spark, sf)))
    return g.select("doc_id", "format", F.explode(F.from_json("findings_by_rule", "map<string,array<string>>")).alias("rule_id", "paths")).select("doc_id", "format", "rule_id", F.size("paths").alias("n"))


_PREDICTED = """dict AS (SELECT replace(p_name, ' ', '-') AS alias, 'pkg:npm/' || replace(p_name, ' ', '-') AS base FROM part GROUP BY 1, 2 HAVING count(*) >= 2)"""


@query(f"WITH {_PREDICTED} SELECT DISTINCT replace(p_name, ' ', '-') AS input, base AS purl, CASE WHEN base IS NULL THEN 'abstain' ELSE 'exact' END AS method FROM part LEFT JOIN dict ON alias = replace(p_name, ' ', '-')")
def predictions(spark, sf):
    """Predictions of the resolver, written as lines of JSON and read back."""
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    d = table(spark, sf, "part").groupBy(name.alias("alias")).agg(F.count("*").alias("observations")).withColumn("purl_base", F.concat(F.lit("pkg:npm/"), "alias"))
    folder = f"{shared_dir(spark)}/predictions-{uuid.uuid4().hex}"
    identity.write_predictions(resolve.resolve(table(spark, sf, "part").select(name.alias("input")).distinct(), d), folder)
    return spark.read.schema("input string, purl string, method string").json(folder)


@query(f"""WITH {COMP} SELECT doc_id, idx, name, version, purl, CAST(CASE WHEN flag = 'R' THEN 1 ELSE 0 END AS INT) AS n_declared FROM comp""")
def components_with_declared(spark, sf):
    """Documents to components with the advisories that the document declares for them."""
    c = F.struct("idx", F.struct(F.concat(F.lit("c"), F.col("idx").cast("string")).alias("bom-ref"), "name", "version", "purl").alias("c"))
    stated = F.when(F.col("flag") == "R", F.struct(F.lit("CVE-1").alias("id"), F.array(F.struct(F.concat(F.lit("c"), F.col("idx").cast("string")).alias("ref"))).alias("affects")))
    made = components(spark, sf).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["c"]).alias("components"), F.collect_list(stated).alias("vulnerabilities"))
    docs = made.select("doc_id", F.parse_json(F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), "components", "vulnerabilities"))).alias("doc"))
    got = coverage.components_from(docs)
    return got.select("doc_id", F.substr("ref", F.lit(2)).cast("long").alias("idx"), "name", "version", "purl", F.size("declared").alias("n_declared"))


@query("SELECT count(*) AS documents, count(CASE WHEN trim(c) <> '' THEN 1 END) AS with_tool, count(DISTINCT CASE WHEN trim(c) <> '' THEN c END) AS tools FROM (SELECT CASE o_orderstatus WHEN 'P' THEN ' ' WHEN 'O' THEN o_orderpriority END AS c FROM orders)")
def tool_counts(spark, sf):
    """Documents that name their tool, and how many different tools."""
    status = F.col("o_orderstatus")
    return coverage.distinct_tools(table(spark, sf, "orders").select(F.when(status == "P", " ").when(status == "O", F.col("o_orderpriority")).alias("tool")))


@query("""SELECT 'tool' AS field, count(*) FILTER (o_orderstatus = 'O') AS supplied, count(*) FILTER (o_orderstatus = 'P') AS declared, count(*) FILTER (o_orderstatus NOT IN ('O', 'P')) AS silent FROM orders
  UNION ALL SELECT 'priority', count(*), 0, 0 FROM orders""")
def provenance_gaps(spark, sf):
    """Fields that are there, stated as unknown, or silently missing."""
    status = F.col("o_orderstatus")
    e = table(spark, sf, "orders").select(F.when(status == "O", "t").alias("tool"), F.when(status == "P", "not recorded").alias("toolUnknown"), F.col("o_orderpriority").alias("priority"), F.lit(" ").alias("priorityUnknown"))
    return coverage.gaps(e, ("tool", "priority"))


@query("SELECT l_orderkey AS doc_id, l_linenumber || ' ' || l_returnflag AS element, bool_or(l_quantity > 10) AS required, count(*) AS n, count(*) FILTER (CAST(floor(l_discount * 10) AS INT) = 0) AS zero FROM lineitem GROUP BY ALL")
def element_scores(spark, sf):
    """Sections of a compliance report by element, and those that score nothing."""
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("section_id"), F.col("l_returnflag").alias("section_data_field"), (F.col("l_quantity") > 10).alias("required"), F.floor(F.col("l_discount") * 10).cast("int").alias("score"))
    return coverage.element_scores(s)


@query(f"""WITH {FOUND}, g AS (SELECT rule_id, severity, count(*) AS n FROM found GROUP BY ALL), k AS (SELECT rule_id, severity, doc_id, row_number() OVER (PARTITION BY rule_id ORDER BY doc_id, CASE WHEN path LIKE '%[*]%' THEN -1 ELSE CAST(coalesce(nullif(regexp_extract(path, '\\[([0-9]+)\\]', 1), ''), '0') AS INT) END) AS r FROM found)
  SELECT g.rule_id, g.severity, g.n, string_agg(CAST(k.doc_id AS VARCHAR), ',' ORDER BY r) AS first_docs, g.n - count(k.r) AS more FROM g JOIN k ON k.rule_id = g.rule_id AND k.r <= 3 GROUP BY g.rule_id, g.severity, g.n""")
def findings_grouped(spark, sf):
    """Findings by rule, most findings first within a severity, with the first three of each."""
    g = rules.grouped(_found(spark, sf), by_instances=True)
    return g.select("rule_id", "severity", "n", F.array_join(F.transform("first", lambda x: x["doc_id"].cast("string")), ",").alias("first_docs"), F.col("more").cast("long").alias("more"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a digest' WHEN 1 THEN 'too short' WHEN 2 THEN 'no letters' ELSE 'not in the dictionary' END AS why, trim(p_name) AS back FROM part""")
def name_reasons(spark, sf):
    """Why a name has no answer, and names given back by their paths."""
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    odd = F.when(k == 0, F.sha2(n, 256)).when(k == 1, " x ").when(k == 2, F.concat(F.lit("12-"), F.col("p_size").cast("string"))).otherwise(F.substring(F.sha2(n, 256), 1, 12))
    return table(spark, sf, "part").select("p_partkey", names.why_no_answer(odd).alias("why"), names.unslug(names.slugify(n)).alias("back"))


@query("SELECT CASE WHEN p_size % 2 = 0 THEN 'c1' ELSE 'c2' END || '.' || replace(p_name, ' ', '-') || '-' || p_partkey AS element_id, t.target, CASE t.target WHEN 'cyclonedx' THEN 'exact' ELSE CASE WHEN p_size < 20 THEN 'partial' ELSE 'none' END END AS fit, CASE WHEN t.target = 'cyclonedx' THEN '$.a,$.b' WHEN p_size < 20 THEN '$.c' ELSE '' END AS paths FROM part, (VALUES ('cyclonedx'), ('spdx')) t(target)")
def crosswalk_rows(spark, sf):
    """Elements and the paths that two formats have for them, long."""
    small = F.col("p_size") < 20
    rows = table(spark, sf, "part").select(F.when(F.col("p_size") % 2 == 0, "c1").otherwise("c2").alias("cluster"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("element"), F.lit("$.a; $.b").alias("cyclonedx"), F.lit("Exact").alias("cyclonedx_fit"), F.when(small, "$.c").otherwise("No field").alias("spdx"), F.when(small, "partial").otherwise("none").alias("spdx_fit"))
    return texts.crosswalk(rows).withColumn("paths", F.array_join("paths", ","))
