"""Reports of checks: explained rules, text, HTML, stable JSON, and evidence bundles with digests.

The rows that a report shows are bounded by the report itself (rules, and a few first
findings of each); what is counted is counted over all findings before.
"""

from __future__ import annotations

import hashlib
import html
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rules import SEVERITIES, Pack, Rule


def explain(rule: Rule) -> list[tuple[str, str]]:
    """What a rule asks, field by field, always in this order."""
    rows = [("id", rule.id), ("title", rule.title), ("severity", rule.severity), ("applies to", ", ".join(rule.applies_to))]
    for kind in rule.applies_to:
        rows += [(f"selector ({kind})", rule.selector_of(kind) or "none"), (f"must hold ({kind})", json.dumps(rule.assertion_of(kind), sort_keys=True))]
    return [*rows, ("if nothing is selected", rule.on_empty), ("fix", rule.fix), ("source", rule.source)]


def pack_listing(pack: Pack) -> dict:
    """A pack and how many rules of each severity it has."""
    return {"id": pack.id, "version": pack.version, "title": pack.title, "rules": len(pack.rules), **{s: sum(r.severity == s for r in pack.rules) for s in SEVERITIES}}


def corpus_results(found: DataFrame) -> DataFrame:
    """Per rule: findings and documents, most findings first, rule as tie-break."""
    return found.groupBy("rule_id", "severity").agg(F.count("*").alias("findings"), F.count_distinct("doc_id").alias("documents")).orderBy(F.desc("findings"), "rule_id")


def as_json(grouped: DataFrame) -> str:
    """Grouped findings as stable JSON."""
    return stable_json([r.asDict(True) for r in grouped.collect()])


def as_text(grouped: DataFrame) -> str:
    """Grouped findings as plain text."""
    out = []
    for g in grouped.collect():
        out.append(f"{g.severity.upper()} {g.rule_id} {g.title}: {g.n}")
        out += [f"  {x.doc_id} {x.path}" + (f" ({x.component})" if x.component else "") for x in g.first or []]
        if g.more and g.more > 0:
            out.append(f"  and {g.more} more")
    return "\n".join(out) + "\n"


def as_html(grouped: DataFrame, title: str) -> str:
    """Grouped findings as one page of markup; every text is escaped."""
    rows = []
    for g in grouped.collect():
        shown = "".join(f"<li>{html.escape(f'{x.doc_id} {x.path}')}</li>" for x in g.first or [])
        rows.append(f"<section><h2>{html.escape(g.rule_id)} <small>{html.escape(g.severity)}</small></h2><p>{html.escape(g.title)}: {g.n}</p><ul>{shown}</ul></section>")
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>" + "".join(rows)


def stable_json(value: object) -> str:
    """JSON whose bytes depend on the value alone: sorted keys, two spaces, a line break at the end."""
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def write_bundle(folder: str, files: dict[str, str]) -> str:
    """Write files and their manifest of digests; returns the manifest's digest. Equal inputs give equal bytes."""
    root = Path(folder)
    root.mkdir(parents=True, exist_ok=True)
    listed = {}
    for name in sorted(files):
        data = files[name].encode()
        (root / name).write_bytes(data)
        listed[name] = hashlib.sha256(data).hexdigest()
    manifest = stable_json({"files": listed})
    (root / "manifest.json").write_text(manifest)
    return hashlib.sha256(manifest.encode()).hexdigest()


def verify_bundle(folder: str) -> list[tuple[str, str]]:
    """(file, state) with state ok, changed, missing or unlisted, sorted by file."""
    root = Path(folder)
    listed = json.loads((root / "manifest.json").read_text())["files"]
    there = {p.name for p in root.iterdir() if p.is_file()} - {"manifest.json"}
    state = {}
    for name in listed.keys() | there:
        if name not in there:
            state[name] = "missing"
        elif name not in listed:
            state[name] = "unlisted"
        else:
            state[name] = "ok" if hashlib.sha256((root / name).read_bytes()).hexdigest() == listed[name] else "changed"
    return sorted(state.items())


def golden(runs: DataFrame) -> DataFrame:
    """(doc_id, format, findings_by_rule as stable JSON) of rule runs: a rule that passes keeps an empty list."""
    ran = runs.where("status = 'ran'").select("doc_id", "format", F.struct(F.col("rule_id").alias("key"), F.transform("failures", lambda f: f["path"]).alias("value")).alias("entry"))
    by = ran.groupBy("doc_id", "format").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    return by.select("doc_id", "format", F.to_json(F.map_from_entries("entries")).alias("findings_by_rule"))


def golden_diff(fresh: DataFrame, kept: DataFrame) -> DataFrame:
    """(doc_id, state): missing, stale, differs or same, by a full outer join."""
    a = fresh.select("doc_id", F.col("findings_by_rule").alias("__a"))
    both = a.join(kept.select("doc_id", F.col("findings_by_rule").alias("__b")), "doc_id", "full_outer")
    return both.select("doc_id", F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "stale").when(F.col("__a") == F.col("__b"), "same").otherwise("differs").alias("state"))
