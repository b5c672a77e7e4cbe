"""The two built-in rule packs, compiled from a table of facts.

Each row states, for a rule, its severity and, for each of the two formats, where it
looks and what must be there.  Where a severity or a second condition could not be
established, the weaker reading is taken (see the README).
"""

from __future__ import annotations

from ..operators.rules import Pack, load_pack

_PROPERTY = lambda where, suffix: {"_property": (where, suffix)}

C, P = "$.components[*]", "$.packages[*]"
HASH_C, HASH_P = "$.components[*].hashes[*]", "$.packages[*].checksums[*]"
PURL = {"exists": "purl|cpe"}
SUPPORT = {"anyOf": [{"exists": "annotations"}, {"exists": "externalRefs"}]}

# Id, severity, selector and requirement in the nested format, and in the flat one.
ELEMENTS = (
    ("CISA-CD-001", "warning", C, {"anyOf": [{"exists": "publisher"}, {"exists": "supplier.name"}]}, P, {"exists": "supplier|originator"}),
    ("CISA-CD-002", "warning", "$", {"exists": "dependencies"}, "$", {"exists": "relationships"}),
    ("CISA-CD-003", "warning", C, {"exists": "hashes"}, P, {"exists": "checksums"}),
    ("CISA-CD-004", "warning", HASH_C, {"exists": "alg"}, HASH_P, {"exists": "algorithm"}),
    ("CISA-CD-005", "warning", C, PURL, P, {"exists": "externalRefs"}),
    ("CISA-CD-006", "info", C, {"exists": "licenses"}, P, {"anyOf": [{"exists": "licenseConcluded|licenseDeclared"}, {"equals": {"licenseConcluded": "NOASSERTION"}}, {"equals": {"licenseDeclared": "NOASSERTION"}}]}),
    ("CISA-CD-007", "warning", C, {"exists": "name"}, P, {"exists": "name"}),
    ("CISA-CD-008", "warning", C, {"exists": "version"}, P, {"exists": "versionInfo"}),
    ("CISA-MD-001", "warning", "$.metadata.authors[*]", {"exists": "name"}, "$.creationInfo", {"exists": "creators"}),
    ("CISA-MD-002", "warning", "$", {"exists": "declarations.signature|signature"}, "$", {"exists": "externalDocumentRefs"}),
    ("CISA-MD-003", "warning", "$", {"exists": "bomFormat"}, "$", {"exists": "spdxVersion"}),
    ("CISA-MD-004", "warning", "$", {"exists": "specVersion"}, "$", {"exists": "spdxVersion"}),
    ("CISA-MD-005", "warning", "$.metadata", {"exists": "lifecycles"}, "$.creationInfo", {"exists": "comment"}),
    ("CISA-MD-006", "warning", "$.metadata", {"exists": "timestamp"}, "$.creationInfo", {"exists": "created"}),
    ("CISA-MD-007", "info", "$.metadata.tools[*]", {"exists": "name"}, "$.creationInfo", {"exists": "creators"}),
    ("CISA-MD-008", "info", "$.metadata.tools[*]", {"exists": "version"}, "$.creationInfo", {"exists": "creators"}),
    ("CISA-MD-009", "warning", "$", {"exists": "version|serialNumber"}, "$", {"exists": "documentNamespace"}),
    ("CISA-PR-001", "info", "$", {"exists": "serialNumber|version"}, "$", {"exists": "documentNamespace"}),
    ("CISA-PR-002", "info", "$", {"exists": "dependencies|compositions"}, "$", {"exists": "relationships"}),
    ("CISA-PR-003", "info", "$.metadata.component", {"exists": "externalReferences"}, "$", {"exists": "documentNamespace"}),
    ("CISA-PR-004", "warning", "$", {"exists": "compositions"}, "$", {"exists": "annotations"}),
    ("CISA-PR-005", "info", "$.metadata.component", {"exists": "version"}, "$.packages[0]", {"exists": "versionInfo"}),
    ("CISA-PR-006", "info", "$", {"exists": "bomFormat"}, "$", {"exists": "spdxVersion"}),
)
DEVICES = (
    ("FDA-STAT-001", "error", "$", {"allOf": [{"exists": "bomFormat"}, {"exists": "components"}]}, "$", {"allOf": [{"exists": "spdxVersion"}, {"exists": "packages"}]}),
    ("FDA-STAT-002", "error", "$", {"exists": "components"}, "$", {"exists": "packages"}),
    ("FDA-NTIA-001", "warning", C, {"anyOf": [{"exists": "publisher"}, {"exists": "supplier.name"}]}, P, {"exists": "supplier|originator"}),
    ("FDA-NTIA-002", "warning", C, {"exists": "name"}, P, {"exists": "name"}),
    ("FDA-NTIA-003", "warning", C, {"exists": "version"}, P, {"exists": "versionInfo"}),
    ("FDA-NTIA-004", "warning", C, PURL, P, {"exists": "externalRefs"}),
    ("FDA-NTIA-005", "warning", "$", {"exists": "dependencies"}, "$", {"exists": "relationships"}),
    ("FDA-NTIA-006", "warning", "$.metadata", {"exists": "authors"}, "$.creationInfo", {"exists": "creators"}),
    ("FDA-NTIA-007", "warning", "$.metadata", {"exists": "timestamp"}, "$.creationInfo", {"exists": "created"}),
    ("FDA-SUP-001", "warning", C, _PROPERTY("properties", "support-level"), P, SUPPORT),
    ("FDA-SUP-002", "warning", C, _PROPERTY("properties", "end-of-support"), P, SUPPORT),
    ("FDA-VULN-001", "warning", "$.metadata", {"anyOf": [_PROPERTY("properties", "vuln-assessment"), {"exists": "$.vulnerabilities"}]}, "$", {"exists": "annotations"}),
    ("FDA-DEPTH-001", "warning", "$", {"exists": "dependencies"}, "$", {"exists": "relationships"}),
    ("FDA-JUST-001", "warning", "$.metadata", _PROPERTY("properties", "omission-justification"), "$", {"exists": "annotations"}),
    ("FDA-USER-001", "info", "$.metadata.component", {"exists": "externalReferences"}, "$", {"exists": "documentNamespace"}),
    ("FDA-TRACE-001", "info", "$.metadata", {"anyOf": [_PROPERTY("properties", "traceability-ref"), _PROPERTY("component.properties", "traceability-ref")]}, "$", {"exists": "documentNamespace"}),
)


def _pack(name: str, version: str, title: str, rows: tuple) -> Pack:
    rules = [
        {"id": i, "severity": s, "title": i, "appliesTo": ["cyclonedx", "spdx"], "selector": {"cyclonedx": a, "spdx": c}, "assert": {"cyclonedx": b, "spdx": d}, "onEmptySelector": "fire"}
        for i, s, a, b, c, d in rows
    ]
    return load_pack({"id": name, "version": version, "title": title, "rules": rules})


def elements_pack() -> Pack:
    """23 rules on the minimum elements."""
    return _pack("cisa-2026", "2.1", "Minimum elements", ELEMENTS)


def devices_pack() -> Pack:
    """16 rules on device submissions."""
    return _pack("fda-524b", "1.0", "Device submissions", DEVICES)
