"""The audit of sources against plain whole-number arithmetic, and its parts on their own."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, top=200):
    docs = [((lang or ""), (source or ""), TERM.findall((text or "").translate(LOWER))) for _, text, lang, source, _ in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for *_, terms in own for t in set(terms))
        kept = sorted(t for t, n in seen.items() if n >= 3)
        counts = {s: Counter() for _, s, _ in own}
        for _, s, terms in own:
            counts[s].update(t for t in terms if seen[t] >= 3)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in counts if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, v, k) for k, (item, v) in enumerate(found[:most], 1)}
    return out


def corpus():
    draw = random.Random(11)
    words = ["Ab", "aB", "éa", "Éa", "x", "y-z", "q1r", "@k`l", "文", "z\x7fz", "ß"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    rows = [(i, " ".join(draw.choices(words, k=draw.choice([0, 3, 40]))), draw.choice(["en", "fr"]), draw.choice(["a", "b", "b", "b", "é", "Z"]), 0) for i in range(150)]
    return rows + [(1, None, "en", "only nulls", 0), (1, "lone words here", "de", "a", 0), (2, "", "de", None, 0), (3, "x x x", None, None, 0), (3, "x x x", None, None, 0), (3, "x x x", None, "b", 0), (9, "ab " * 50000, "en", "a", 0)]


def test_audit_equals_plain_arithmetic(spark):
    from tessera.llm import divergence

    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    for how in ({}, {"block_entries": 60, "top": 5}):
        got = divergence.audit(docs, **how).collect()
        found = {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got}
        assert len(found) == len(got) and found == by_hand(rows, how.get("top", 200))
    clash = docs.selectExpr("*", "1 AS n", "'x' AS term", "'y' AS block").repartition(5)
    assert {tuple(r) for r in divergence.audit(clash).collect()} == by_hand(rows)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_slices_that_share_a_hash_are_told_apart():
    from tessera.llm.divergence import boundaries, count_terms, group_slices

    text = b"ab cd ab e cd fg ab e"
    starts, ends = boundaries(np.where(np.frombuffer(text, np.uint8) == 32, 0, np.frombuffer(text, np.uint8)))
    for digest in (hash, len, lambda _: 7):
        number, terms = group_slices(text, starts, ends, lambda x, d=digest: d(x) & (2**63 - 1))
        assert [terms[i] for i in number] == text.split()
    owner, term, n, docs, terms = count_terms([b"A a\xc3\xa9 a", b"", b"a b", b"b"], [0, 1, 1, 0])
    assert {(int(o), terms[t].decode(), int(x), int(d)) for o, t, x, d in zip(owner, term, n, docs, strict=True)} == {(0, "a", 2, 1), (0, "aé", 1, 1), (1, "a", 1, 1), (1, "b", 1, 1), (0, "b", 1, 1)}


def test_shares_are_exact_for_large_counts():
    from tessera.llm.divergence import shares

    draw = random.Random(2)
    totals = [draw.randint(1, 8 * 10**17) for _ in range(300)] + [1, 7, 10**9]
    counts = [draw.randint(1, t) for t in totals[:-3]] + [1, 7, 1]
    got = shares(np.array(counts), np.array(totals)).tolist()
    assert got == [1 + int(Fraction(10**9 * c, t)) for c, t in zip(counts, totals, strict=True)]
