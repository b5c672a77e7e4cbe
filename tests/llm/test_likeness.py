"""Likeness of texts with very different numbers of paragraphs."""

import pytest
from test_llm import docs


def test_likeness_is_exact_at_any_ratio(spark):
    from tessera.llm import fingerprint

    lines = lambda n, tag="line": "\n".join(f"{tag} {i}." for i in range(n))
    rows = [(5, lines(40)), (4, lines(8)), (3, lines(700)), (2, lines(3, "other") + "\n" + lines(2)), (1, "")]
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs(spark, [(i, t, "s") for i, t in rows])).collect()}
    near_next = {5: 8 / 40, 4: 8 / 700, 3: 2 / 703, 2: 0.0, 1: 0.0}
    assert {i: r.near_next for i, r in got.items()} == pytest.approx(near_next)
    body = "one long line of words. " * 40 + "\n"
    text, after = body + "end", lines(300, "q")
    cut = len(text) // 3
    edited = text[: len(text) - cut] + after[:cut]
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs(spark, [(2, text, "s"), (1, after, "s")])).collect()}
    import re

    x, y = ({q for q in re.split(r"\n|(?<=[.!?]) ", t) if q} for t in (text, edited))
    assert len(y) > 4 * len(x) and got[2].near_edited == pytest.approx(len(x & y) / len(x | y)) and got[2].near_edited > 0


def _checked(low):
    """48 bits with the check that the sketches carry, by Spark's 32-bit Murmur hash of a long."""
    mask = 0xFFFFFFFF
    mix = lambda k: (((k * 0xCC9E2D51 & mask) << 15 | (k * 0xCC9E2D51 & mask) >> 17) & mask) * 0x1B873593 & mask
    h = 42
    for k in (low & mask, low >> 32 & mask):
        h ^= mix(k)
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    h ^= 8
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h ^= h >> shift
        h = h * by & mask
    return (h << 48 | low) & (1 << 64) - 1


def test_several_digests_that_look_like_one_are_told_apart(spark):
    """Triples that share a cell of every table and whose XOR carries a right check."""
    import random

    from pyspark.sql import functions as F

    from tessera.llm import fingerprint

    draw, triples = random.Random(8), []
    while len(triples) < 4:
        a, b = (draw.getrandbits(42) << 6 for _ in range(2))
        part = _checked(a) ^ _checked(b)
        for _ in range(150_000):
            c = draw.getrandbits(42) << 6
            looks = part ^ _checked(c)
            if _checked(looks & (1 << 48) - 1) == looks:
                triples.append([_checked(x) - (1 << 64 if _checked(x) >> 63 else 0) for x in (a, b, c)])
                break
    rows = [(t[:k], t[k:]) for t in triples for k in (0, 1, 3)]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    checked = df.select(F.forall(F.concat("a", "b"), lambda k: fingerprint._checked(fingerprint._low(k)) == k).alias("ok"))
    assert all(r.ok for r in checked.collect())
    a, b = F.col("a"), F.col("b")
    got = df.select("a", "b", fingerprint.difference(a, b, fingerprint.sketch(a), fingerprint.sketch(b)).alias("d"), fingerprint.likeness(a, b, fingerprint.sketch(a), fingerprint.sketch(b)).alias("l")).collect()
    assert all(sorted(r.d) == sorted(r.a + r.b) and r.l == 0 for r in got)


def test_likeness_of_all_documents_is_that_of_their_paragraphs(spark):
    import re

    from tessera.llm import queries

    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    parts = {i: {q for q in re.split(r"\n|(?<=[.!?]) ", t) if q} for i, t in texts.items()}
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in queries.op2_document_fingerprints(spark, sf).collect()}
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        both = parts[i] | parts[j]
        assert got[i].near_next == pytest.approx(len(parts[i] & parts[j]) / len(both) if both else 1.0)
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1
