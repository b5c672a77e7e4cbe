"""Rule packs over documents: findings, rule runs, severity overrides, counts, gates.

A pack is compiled on the driver.  Its selectors are one trie, and documents become a
table of nodes: a row for the document and one for each element of a list that the trie
spreads over, tagged with the list.  Every rule is a boolean over the nodes of its tag.
A document's components are rows, so their number has no limit, and findings need no
shuffle; counts of findings are sums that start where the nodes are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import assertions, detect, selectors

SEVERITIES = ("error", "warning", "info", "advisory")
LEAST_REASON = 60


@dataclass(frozen=True)
class Rule:
    """One rule: where it looks in each format, and what must hold there."""

    id: str
    severity: str
    selector: dict
    holds: dict
    title: str = ""
    fix: str = ""
    source: str = ""
    applies_to: tuple[str, ...] = ("cyclonedx", "spdx")
    on_empty: str = "fire"

    def selector_of(self, kind: str) -> str | None:
        return self.selector if isinstance(self.selector, str) else self.selector.get(kind)

    def assertion_of(self, kind: str) -> dict | None:
        if self.holds and set(self.holds) <= {"cyclonedx", "spdx"}:
            return self.holds.get(kind)
        return self.holds


@dataclass(frozen=True)
class Pack:
    """A named, versioned list of rules."""

    id: str
    version: str
    title: str
    rules: tuple[Rule, ...] = field(default_factory=tuple)


def load_pack(data: dict) -> Pack:
    """Validate and build a pack; refuses one that is incomplete or cannot be compiled."""
    for key in ("id", "version", "rules"):
        if key not in data:
            raise ValueError(f"the pack has no {key}")
    seen, rules = set(), []
    for r in data["rules"]:
        for key in ("id", "severity", "appliesTo", "selector", "assert", "onEmptySelector"):
            if key not in r:
                raise ValueError(f"rule {r.get('id', '?')} has no {key}")
        if r["id"] in seen:
            raise ValueError(f"rule {r['id']} stands twice")
        if r["severity"] not in SEVERITIES:
            raise ValueError(f"rule {r['id']} has severity {r['severity']}")
        if r["onEmptySelector"] not in ("fire", "skip", "pass"):
            raise ValueError(f"rule {r['id']} has onEmptySelector {r['onEmptySelector']}")
        seen.add(r["id"])
        for s in [r["selector"]] if isinstance(r["selector"], str) else r["selector"].values():
            selectors.parse(s)
        rules.append(Rule(r["id"], r["severity"], r["selector"], r["assert"], r.get("title", ""), r.get("fix", ""), f"{r.get('sourceDocument', '')}: {r.get('sourceLocation', '')}", tuple(r["appliesTo"]), r["onEmptySelector"]))
    return Pack(data["id"], data["version"], data.get("title", ""), tuple(rules))


class OverrideError(ValueError):
    """An override list that is refused before any rule runs; ``code`` says why."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


def check_overrides(requests: list, pack: Pack) -> dict[str, dict]:
    """Requests by rule; raises on the first one that cannot be used."""
    known, out = {r.id for r in pack.rules}, {}
    for r in requests:
        if not isinstance(r, dict) or not isinstance(r.get("ruleId"), str):
            raise OverrideError("005", "an override is an object with ruleId, to and reason")
        name = r["ruleId"]
        if name not in known:
            raise OverrideError("001", f"no rule {name} in pack {pack.id}")
        if name in out:
            raise OverrideError("002", f"rule {name} is overridden twice")
        if r.get("to") not in SEVERITIES:
            raise OverrideError("003", f"{r.get('to')} is no severity")
        if not isinstance(r.get("reason"), str) or len(r["reason"].strip()) < LEAST_REASON:
            raise OverrideError("004", f"a reason has {LEAST_REASON} characters or more")
        out[name] = r
    return out


DOCUMENT = -1
ACCOUNTING = "struct<packages:bigint,relationships:bigint,agents:bigint,unmapped_types:array<string>,unmapped_package_keys:array<string>>"


@dataclass
class _Row:
    """A row that a node of a list may be: when, of which rule, and what it shows, all SQL."""

    tag: int
    when: str
    rule_order: int
    path: str = "CAST(NULL AS STRING)"
    component: str = "CAST(NULL AS STRING)"


@dataclass
class _Compiled:
    """A pack as SQL: the trie, facts asked of documents and nodes, nodes that rules look at, and what rows are made of a node."""

    trie: selectors.Trie = field(default_factory=selectors.Trie)
    facts: assertions.Facts = field(default_factory=assertions.Facts)
    nodes: dict[str, str] = field(default_factory=dict)
    rows: list[_Row] = field(default_factory=list)
    statuses: str = ""

    def found(self) -> str:
        """SQL of the array of rows that a node is, as places in ``rows``, or NULL; what a row shows is made once the rows are there."""
        tags = sorted({r.tag for r in self.rows})
        of = lambda tag: ", ".join(f"CASE WHEN {r.when} THEN {at} END" for at, r in enumerate(self.rows) if r.tag == tag)
        return f"CASE tag {' '.join(f'WHEN {tag} THEN array({of(tag)})' for tag in tags)} END"

    def shown(self, what: str) -> str:
        """SQL of what the row at ``__at`` shows."""
        same: dict[str, list[int]] = {}
        for at, r in enumerate(self.rows):
            same.setdefault(str(getattr(r, what)), []).append(at)
        return f"CASE {' '.join(f'WHEN __at IN ({", ".join(map(str, ats))}) THEN {value}' for value, ats in same.items())} END"


def _compiled(pack: Pack) -> _Compiled:
    c = _Compiled(rows=[_Row(0, "true", DOCUMENT)])
    statuses: dict[str, list[str]] = {"cyclonedx": [], "spdx": []}
    for at, rule in enumerate(pack.rules):
        for kind in statuses:
            selector, assertion = rule.selector_of(kind), rule.assertion_of(kind)
            if kind not in rule.applies_to or not selector or assertion is None:
                statuses[kind].append("'not-applicable'" if kind not in rule.applies_to else "'no-path'")
                continue
            reaches = c.facts.ask(selectors.any_of(c.facts.doc, selectors.parse(selector)))
            statuses[kind].append(f"CASE WHEN {reaches} THEN 'ran' ELSE 'no-path' END" if rule.on_empty == "skip" else "'ran'")
            if rule.on_empty == "fire":
                c.rows.append(_Row(0, f"format <=> '{kind}' AND NOT {reaches}", at, selectors.literal(selector)))
            tag, rest = c.trie.add(kind, selector)
            here = f"tag = {tag}" + (f" AND format <=> '{kind}'" if tag == 0 else "")
            node = c.nodes.setdefault(f"CASE WHEN {here} THEN {selectors.walk('node', rest)} END", f"__node_{len(c.nodes)}")
            path = f"concat({c.trie.path(tag, 'position')}, {selectors.literal(selectors.suffix(rest))})"
            c.rows.append(_Row(tag, f"{node} IS NOT NULL AND NOT {assertions.holds(assertion, node, c.facts)}", at, path, label(node)))
    stated = " ".join(f"WHEN format <=> '{k}' THEN array({', '.join(v)})" for k, v in statuses.items())
    c.statuses = f"CASE WHEN __at = 0 THEN (CASE {stated} ELSE CAST(NULL AS ARRAY<STRING>) END) END"
    return c


def label(node: str) -> str:
    """SQL of the name and version of a component or package, as a reader would call it."""
    said = lambda *keys: detect.said(node, *keys)
    return f"concat({said('name', 'packageName')}, coalesce(concat(' ', {said('version', 'versionInfo')}), ''))"


def seen(docs: DataFrame, pack: Pack) -> DataFrame:
    """doc_id, doc, format, spec, problem and accounting of documents; a graph document has its flat view as doc.

    ``docs``: ``doc_id``, one row each, ``doc`` VARIANT, and ``format`` where it is stated.
    """
    from .graph import flat_view

    stated = (F.col("format") if "format" in docs.columns else F.lit(None)).cast("string")
    is_graph = detect.is_graph(F.col("doc"))
    told = docs.select("doc_id", "doc", detect.detect(F.col("doc")).alias("__d"), stated.alias("__format"), is_graph.alias("__graph"))
    problem = F.when(F.col("__d.format").isNotNull() & ~F.col("__d.supported"), "version not supported").otherwise(F.col("__d.problem"))
    told = told.select("doc_id", "doc", F.coalesce("__format", "__d.format").alias("format"), F.col("__d.spec").alias("spec"), problem.alias("problem"), "__graph")
    if not any("spdx" in r.applies_to and r.selector_of("spdx") for r in pack.rules):  # such a pack never reads the flat view
        return told.drop("__graph").withColumn("accounting", F.lit(None).cast(ACCOUNTING))
    flat = flat_view(told.where("__graph").drop("__graph"))
    return told.where("NOT __graph").drop("__graph").withColumn("accounting", F.lit(None).cast(ACCOUNTING)).unionByName(flat)


def evaluate(docs: DataFrame, pack: Pack) -> DataFrame:
    """A row for each document (``rule_order`` is ``DOCUMENT``) and one for each node that fails a rule.

    doc_id, format, spec, problem, rule_order, position (the node's place, a list of
    indices), path, component; on the document's row also ``statuses`` (a text for each
    rule of the pack, NULL if no format is told) and ``accounting`` of a graph document.

    A stated format is taken; a document without one is in the format that is detected.
    A document whose format is not told has its problem and no results.  One of a
    version that is not read has both: :func:`gated` leaves its results out.
    """
    c = _compiled(pack)
    carried = ["doc_id", "format", "spec", "problem", "accounting", *c.facts.known.values()]
    rows = seen(docs, pack).selectExpr("*", *[f"{e} AS {name}" for e, name in c.facts.known.items()])
    rows = rows.selectExpr(*carried, "0 AS tag", "CAST(array() AS array<int>) AS position", "doc AS node")
    node = "struct<tag:int,position:array<int>,node:variant>"
    # Lists are made before they are spread, since a generator works its input out without generated code,
    # and the outer forms keep the optimiser from adding filters that would work them out once more.
    for level in c.trie.levels():
        lists = [f"CASE WHEN {s.here()} THEN {s.rows('node', 'position')} ELSE CAST(array() AS array<{node}>) END" for s in level]
        rows = rows.selectExpr(*carried, f"concat(array(named_struct('tag', tag, 'position', position, 'node', node)), {', '.join(lists)}) AS __rows")
        rows = rows.selectExpr(*carried, "inline_outer(__rows)")
    rows = rows.selectExpr("*", *[f"{e} AS {name}" for e, name in c.nodes.items()])
    for depth in c.facts.levels():
        rows = rows.selectExpr("*", *[f"{e} AS {name}" for e, name in depth])
    facts, nodes = list(c.facts.known.values()), list(c.nodes.values())
    kept = ["doc_id", "format", "spec", "problem", "position", "accounting", *facts, *nodes]
    out = rows.selectExpr(*kept, f"{c.found()} AS __found").selectExpr(*kept, "explode_outer(__found) AS __at").where("__at IS NOT NULL")
    return out.selectExpr("doc_id", "format", "spec", "problem", f"{c.shown('rule_order')} AS rule_order", "position", f"{c.shown('path')} AS path", f"{c.shown('component')} AS component", f"{c.statuses} AS statuses", "CASE WHEN __at = 0 THEN accounting END AS accounting")


def gated(evaluated: DataFrame) -> DataFrame:
    """:func:`evaluate`'s rows without the results of documents that have a problem; the documents' own rows stay."""
    kept = evaluated.where((F.col("rule_order") == DOCUMENT) | F.col("problem").isNull())
    return kept.withColumn("statuses", F.when(F.col("problem").isNull(), F.col("statuses")))


def rule_table(spark, pack: Pack, overrides: dict[str, dict] | None = None) -> DataFrame:
    """The pack's rules as rows, with the overrides asked for."""
    asked = overrides or {}
    rows = [(k, r.id, r.title, r.severity, r.fix, r.source, asked.get(r.id, {}).get("to"), asked.get(r.id, {}).get("reason")) for k, r in enumerate(pack.rules)]
    return spark.createDataFrame(rows, "rule_order int, rule_id string, title string, pack_severity string, fix string, source string, override_to string, override_reason string")


def _with_rules(evaluated: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows with their rule (a document's own row has none) and the severity in force: a rule that found something has its override applied, if that changes anything.

    A pack's rules bound the broadcast.
    """
    applied = F.col("override_to").isNotNull() & (F.col("override_to") != F.col("pack_severity"))
    each = evaluated.join(F.broadcast(rules), "rule_order", "left")
    return each.withColumns({"overridden": applied, "severity": F.when(applied, F.col("override_to")).otherwise(F.col("pack_severity"))})


def _has_results() -> Column:
    """Of a group of a document's rows: was it checked at all?"""
    return F.bool_or(F.col("statuses").isNotNull())


def rule_runs(evaluated: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per document and rule: status, failures, severity in force, and what became of an override.

    Failures are counted before they are shuffled; the list of them is one document's and
    one rule's, for reports that show it.
    """
    failure = F.struct("position", "path", "component")
    row = lambda rule, status, found, f: F.struct(rule.alias("rule_order"), status.alias("status"), found.alias("found"), f.alias("f"))
    none = F.lit(None).cast("struct<position:array<int>,path:string,component:string>")
    own = F.transform(F.coalesce("statuses", F.array().cast("array<string>")), lambda s, i: row(i, s, F.lit(0), none))
    here = F.when(F.col("rule_order") == DOCUMENT, own).otherwise(F.array(row(F.col("rule_order"), F.lit(None).cast("string"), F.lit(1), failure)))
    each = evaluated.select("doc_id", "format", F.inline(here))
    each = each.groupBy("doc_id", "format", "rule_order").agg(F.max("status").alias("status"), F.sum("found").alias("n_failures"), F.array_sort(F.collect_list("f")).alias("failures")).where("status IS NOT NULL")
    each = each.join(F.broadcast(rules), "rule_order")
    inert = (
        F.when(F.col("override_to").isNull(), None)
        .when(F.col("status") == "not-applicable", "the rule does not apply to this format")
        .when(F.col("status") == "no-path", "the rule did not run")
        .when(F.col("override_to") == F.col("pack_severity"), "the pack already assigns this severity")
        .when(F.col("n_failures") == 0, "the rule found nothing")
    )
    applied = F.col("override_to").isNotNull() & inert.isNull()
    return each.select("doc_id", "rule_id", "rule_order", "title", "fix", "source", "format", "status", "failures", "n_failures", "pack_severity", F.when(applied, F.col("override_to")).otherwise(F.col("pack_severity")).alias("severity"), applied.alias("overridden"), inert.alias("why_inert"))


def findings(evaluated: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per failing node, in rule and document order by (rule_order, position); no shuffle."""
    out = _with_rules(evaluated.where(F.col("rule_order") != DOCUMENT), rules)
    return out.select("doc_id", "rule_id", "rule_order", "position", "title", "severity", F.when(F.col("overridden"), F.col("pack_severity")).alias("overridden_from"), "path", "component", "fix", "source", F.concat(F.lit("RULE-"), "rule_id").alias("code"))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 3).when(severity == "warning", 2).when(severity == "info", 1).otherwise(0)


def severity_counts(evaluated: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of each severity per document, zeros kept; a document without results has no row."""
    by = _with_rules(evaluated, rules).groupBy("doc_id").agg(_has_results().alias("checked"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return by.where("checked").drop("checked")


def gate(evaluated: DataFrame, rules: DataFrame, at: str = "error") -> DataFrame:
    """Per document: the highest rank found, does it reach ``at``, would the pack's own severities have, and can no rule of the pack reach it?

    An override that is applied changes what its rule can reach; one that is inert does not.
    """
    limit = SEVERITIES[::-1].index(at)
    rank_of = {s: k for k, s in enumerate(SEVERITIES[::-1])}
    ranks = [(r["rule_order"], rank_of[r["pack_severity"]], rank_of[r["override_to"] or r["pack_severity"]]) for r in rules.select("rule_order", "pack_severity", "override_to").collect()]
    each = _with_rules(evaluated, rules)
    known = lambda c: F.coalesce(F.max(F.when(F.col(c).isNotNull(), severity_rank(F.col(c)))), F.lit(-1))
    failing = F.collect_set(F.when(F.col("rule_order") != DOCUMENT, F.col("rule_order")))
    by = each.groupBy("doc_id").agg(_has_results().alias("checked"), known("severity").alias("rank"), known("pack_severity").alias("own"), failing.alias("rules")).where("checked")
    moved = [F.when(F.array_contains("rules", k), to).otherwise(own) for k, own, to in ranks if own != to]
    reachable = F.greatest(F.lit(-1), F.lit(max([own for _, own, to in ranks if own == to], default=-1)), *moved)
    rank, own = F.col("rank"), F.col("own")
    return by.select("doc_id", "rank", (rank >= limit).alias("blocked"), ((rank < limit) & (own >= limit)).alias("moved_below"), reachable.alias("reachable"), (reachable < limit).alias("inert_gate"))


def grouped(found: DataFrame, shown: int = 3, by_instances: bool = False) -> DataFrame:
    """Findings by rule: how many, the first few, and how many more.

    Worst first and by rule, or (``by_instances``) worst first and most findings first.
    The first findings are the least by document and position, kept by an aggregate of
    ``shown`` entries a rule and task, so a rule's row does not grow with the corpus.
    """
    key = F.struct("doc_id", "position", "path", "component")
    spread = found.withColumn("__part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    first = F.row_number().over(Window.partitionBy("rule_id", "severity", "__part").orderBy("doc_id", "position"))
    few = spread.withColumn("__k", first).where(F.col("__k") <= shown).groupBy("rule_id", "severity").agg(F.slice(F.array_sort(F.collect_list(key)), 1, shown).alias("first"))
    by = found.groupBy("rule_id", "title", "severity").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("files"), F.min_by("fix", F.struct("doc_id", "position")).alias("fix"))
    order = [F.desc("n"), "rule_id"] if by_instances else ["rule_id"]
    return by.join(few, ["rule_id", "severity"], "left").withColumn("more", F.col("n") - F.size("first")).orderBy(F.desc(severity_rank(F.col("severity"))), *order)


def universal(found: DataFrame, components: DataFrame) -> DataFrame:
    """(rule_id, n, universal): does a rule fail as often as there are components?"""
    size = components.agg(F.count("*").alias("__all"))
    return found.groupBy("rule_id").agg(F.count("*").alias("n")).join(F.broadcast(size)).select("rule_id", "n", (F.col("n") == F.col("__all")).alias("universal"))


def pivot(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, a count for each severity, total) of findings, by the ``group`` of their document (doc_id, group)."""
    p = found.join(groups, "doc_id").groupBy("group").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return p.withColumn("total", sum(F.col(s) for s in SEVERITIES))


def top(found: DataFrame, k: int = 12) -> DataFrame:
    """The ``k`` rules with most findings, the rule as tie-break (a top-k report)."""
    return found.groupBy("rule_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule_id").limit(k)
