"""The near-duplicate stage finds candidates by SimHash fingerprints and BK-trees before anything else."""

import random

from test_llm import docs


def test_fingerprints_alone_join_what_is_within_their_radius(spark):
    """Without MinHash tables the groups are those of fingerprints within 2 bits and Jaccard 0.8 or more."""
    from tessera.llm import simhash

    rng = random.Random(8)
    rows = []
    for k in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(600)]
        for i in range(4):
            copy = list(base)
            copy[rng.randrange(600)] = f"x{k}-{i}"
            rows.append((10 * k + i, " ".join(copy), "s"))
    made = simhash.Shingles()
    sets = {i: set(made(t).tolist()) for i, t, _ in rows}
    prints = {i: simhash.shingle_print(made(t)) & (2**64 - 1) for i, t, _ in rows}
    part = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                one, other = sorted((part[a], part[b]))
                part = {i: one if p == other else p for i, p in part.items()}
    assert 12 < len(set(part.values())) < len(rows)
    for limit in (1000, 1):
        assert sorted(r.doc_id for r in simhash.keep_one(docs(spark, rows), tables=0, shard_limit=limit).collect()) == sorted(set(part.values()))
    assert sorted(r.doc_id for r in simhash.keep_one(docs(spark, rows)).collect()) == [10 * k for k in range(12)]
