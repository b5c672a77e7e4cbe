"""Copies with one contiguous edit, near the limit of similarity."""

from test_llm import docs


def test_near_dedup_finds_contiguous_edits(spark):
    import random

    from tessera.llm import simhash

    rng = random.Random(0)
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    jaccard = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, gone = [], set()
    for k in range(40):
        n = rng.randrange(150, 400)
        base = text(n)
        for kind in range(2):
            low, high = ((0.8, 0.85), (0.75, 0.8))[k % 4 == 3]
            for size in range(1, n):
                at = n // 3
                copy = base[: n - size] if kind == 0 else base[:at] + text(size) + base[at + size :]
                if low <= jaccard(base, copy) < high and rng.random() < 0.3 or jaccard(base, copy) < low + 0.01:
                    break
            similar = jaccard(base, copy)
            rows += [(10 * k + 2 * kind, " ".join(["k" + str(kind) + x for x in base]), "s"), (10 * k + 2 * kind + 1, " ".join(["k" + str(kind) + x for x in copy]), "s")]
            if similar >= 0.8:
                gone.add(10 * k + 2 * kind + 1)
    assert 50 <= len(gone) <= 60
    for limit in (1000, 1):
        kept = [r.doc_id for r in simhash.keep_one(docs(spark, rows), shard_limit=limit).collect()]
        assert sorted(kept) == sorted({i for i, *_ in rows} - gone)


def test_large_groups_are_joined_bucket_by_bucket(spark):
    """A chain whose ends share nothing, copies of one text, and texts that share a bucket alone; limits that cut every one."""
    import random

    from tessera.llm import simhash

    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, chain = [], text(200)
    for i in range(30):
        rows.append((i, " ".join(chain), "s"))
        chain = chain[8:] + text(8)
    base = text(300)
    for i in range(60):
        copy = list(base)
        copy[rng.randrange(300)] = f"x{i}"
        rows.append((100 + i, " ".join(copy), "s"))
    shingles = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t, _ in rows)}
    part = {i: i for i in shingles}
    for a in shingles:
        for b in shingles:
            if a < b and len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b]) >= 0.8:
                one, other = sorted((part[a], part[b]))
                part = {i: one if p == other else p for i, p in part.items()}
    for limits in ((1000, 1_000_000), (7, 1_000_000), (1000, 2000)):
        kept = sorted(r.doc_id for r in simhash.keep_one(docs(spark, rows), shard_limit=limits[0], shingle_limit=limits[1]).collect())
        assert kept == sorted(set(part.values())), limits
    assert 0 in part.values() and 100 in part.values()


def test_members_of_a_known_part_are_not_compared():
    import numpy as np

    from tessera.llm.simhash import links_by_jaccard

    s = np.arange(10, dtype=np.uint64)
    assert links_by_jaccard([([0], s, 1, 7), ([0], s, 2, 7), ([0], s + np.uint64(50), 3, 8)], 0.8) == []
    assert links_by_jaccard([([0], s, 1, 7), ([0], s, 2, None), ([0], s, 3, 7)], 0.8) in ([(1, 2)], [(2, 1)])
