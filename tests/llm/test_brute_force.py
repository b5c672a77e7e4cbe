"""Operators without SQL against slow, plain versions of what they state."""

import math
import random
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from test_llm import SF, docs

WORDS = "river stone bridge valley farmer apple garden letter winter market window silver yellow harbour ladder pocket".split()


def brute_contaminated(rows, items, window=8, least=3, plain_least=4):
    """Windows compared as words; a window counts if all its slots are filled consistently in its copy."""
    from tessera.llm import decontaminate as d

    def read(text):
        words, kinds, before = [], [], "stop"
        for w in d._TOKEN.findall(text):
            low = w.lower()
            kind = "stop" if w in ".!?;:\n" else "number" if w[0].isdigit() or low in d.NUMBERS else "unit" if low in d.UNITS else "name" if w[0].isupper() else "word"
            shown = "word" if (kind == "unit" and before != "number") or (kind == "name" and before == "stop") else kind
            if kind != "stop":
                words.append(low)
                kinds.append(shown)
            before = kind
        return words, kinds

    def windows(words, kinds, size):
        """(offset, template, slots) of each form of each window."""
        for at in range(len(words) - size + 1):
            part = list(zip(words[at : at + size], kinds[at : at + size], strict=True))
            for names in (True, False):
                slots = [(k, w) for w, k in part if k != "word" and (names or k != "name")]
                yield at, tuple(w if k == "word" or (k == "name" and not names) else f"<{k}>" for w, k in part), slots, names
            yield at, tuple(w for w, _ in part), [], None

    out = {}
    for item_id, item in items:
        words, kinds = read(item)
        size = min(window, len(words))
        if not size:
            continue
        held, literal = defaultdict(list), set()
        for at, template, slots, names in windows(words, kinds, size):
            part = kinds[at : at + size]
            enough = lambda names, at=at, part=part: len({w for w, k in zip(words[at : at + size], part, strict=True) if k == "word" or (k == "name" and not names)}) >= plain_least
            if names is not None and enough(names):
                held[template].append((at, slots))
            elif names is None and not enough(False):
                held[template].append((at, None))
                literal.add(at)
        held = {t: found[0] for t, found in held.items()}
        n = len({at for at, _ in held.values()})
        n_templates = len({at for at, s in held.values() if s is not None})
        for doc_id, text in rows:
            dw, dk = read(text)
            pairs = defaultdict(list)
            for at, template, slots, names in windows(dw, dk, size):
                if template in held:
                    offset, own = held[template]
                    if (own is None) == (names is None) and (own is None or len(own) == len(slots)):
                        pairs[at - offset].append((offset, own, slots))
            for found in pairs.values():
                values = defaultdict(set)
                for _, own, slots in found:
                    for a, b in zip(own or [], slots, strict=True):
                        values[a].add(b)
                good = lambda own: all(len(values[a]) == 1 for a in own or [])
                bad = {o for o, own, _ in found if own is not None and not good(own)}
                matched = {o for o, own, _ in found} - bad
                filled = {o for o, own, _ in found if own is not None} - bad
                if (n_templates and len(filled) >= min(least, n_templates)) or len(matched) >= min(least, n):
                    out[doc_id, item_id] = max(out.get((doc_id, item_id), 0), len(matched))
    return out


def test_decontamination_equals_brute_force(spark):
    from tessera.llm import decontaminate

    rng = random.Random(8)
    items = []
    for i in range(12):
        w = [rng.choice(WORDS) for _ in range(rng.randrange(3, 26))]
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(("12", "7", "7 km", "Anna", "Berlin", "three"))
        items.append((i, " ".join(w) + "."))
    rows = []
    for i in range(120):
        item = rng.choice(items)[1]
        swaps = {"12": rng.choice(("12", "90")), "Anna": rng.choice(("Anna", "Otto")), "7": rng.choice(("7", "8"))}
        copy = " ".join(swaps.get(w, w) if rng.random() < 0.9 else rng.choice(WORDS + ["5"]) if rng.random() < 0.3 else w for w in item.split())
        rows.append((i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(30))) + " " + copy + " " + " ".join(rng.choice(WORDS) for _ in range(5))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_matched for r in decontaminate.contaminated(docs(spark, [(i, t, "s") for i, t in rows]), bench).collect()}
    want = brute_contaminated(rows, items)
    assert got == want and 20 < len(want)


def spark_hash(*values):
    """The engine's 64-bit hash of whole numbers and texts, as a signed number without its last bit."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<i" if v[1] == 4 else "<q", v[0]), h)
    return h >> 1


def test_mixing_equals_brute_force(spark):
    """Weights, budgets, block orders and the edge block, worked out row by row."""
    from tessera.llm import mixing

    rows = [(i, "w " * (5 + i % 11), "big" if i % 5 else f"s{i % 3}") for i in range(900)]
    frame, seed, block_tokens = docs(spark, rows), 7, 200
    size = {i: 5 + i % 11 for i, *_ in rows}
    tokens = Counter()
    for i, _, s in rows:
        tokens[s] += size[i]
    total = sum(tokens.values())
    table = spark.createDataFrame(list(tokens.items()), "s string, tokens long")
    for entropy, repeats in ((0.9, 3.0), (0.3, None), (None, None), (1.0, 1.5)):
        alpha = mixing.exponents(table, total, entropy=entropy, repeats=repeats)
        z = sum((t / total) ** alpha for t in tokens.values())
        if entropy and not repeats:
            share = [(t / total) ** alpha / z for t in tokens.values()]
            assert -sum(x * math.log(x) for x in share) / math.log(len(tokens)) == pytest.approx(entropy, abs=1e-3)
        want = set()
        for s, n in tokens.items():
            budget = round((n / total) ** alpha / z * total)
            full, left = divmod(budget, n)
            blocks = math.ceil(n / block_tokens)
            key = {i: spark_hash((seed, 4), (i, 8), (len(t), 4)) for i, t, x in rows if x == s}
            want |= {(i, k) for i in key for k in range(full)}
            name = "s" + s
            order = sorted((spark_hash((seed + 1, 4), name, (b, 8), (full, 4)), b) for b in range(blocks))
            for _, b in order:
                for _, i in sorted((spark_hash((seed + 2, 4), (h, 8)), i) for i, h in key.items() if h % blocks == b):
                    if left > 0:
                        want.add((i, full))
                        left -= size[i]
        got = {(r.doc_id, r["pass"]) for r in mixing.mix(frame, entropy=entropy, repeats=repeats, block_tokens=block_tokens, seed=seed).collect()}
        assert got == want


def test_trees_and_scores_equal_brute_force():
    from tessera.llm import quality as q

    rng = np.random.default_rng(3)
    gain = lambda g, h: g**2 / (h + 2.0)
    for _ in range(40):
        g, h = rng.normal(size=9), rng.uniform(0.1, 1, 9)
        best = max(range(1, 9), key=lambda k: gain(g[:k].sum(), h[:k].sum()) + gain(g[k:].sum(), h[k:].sum()))
        want = np.where(np.arange(9) < best, g[:best].sum() / (h[:best].sum() + 2), g[best:].sum() / (h[best:].sum() + 2))
        if gain(g[:best].sum(), h[:best].sum()) + gain(g[best:].sum(), h[best:].sum()) <= gain(g.sum(), h.sum()) + 1e-9:
            want = np.full(9, g.sum() / (h.sum() + 2))
        assert q.shallow_tree(g, h, 1, 2.0) == pytest.approx(want)
        g, h = rng.normal(size=(5, 6)), rng.uniform(0.1, 1, (5, 6))
        cells = lambda a, i, j: (a[:i, :j].sum(), a[:i, j:].sum(), a[i:, :j].sum(), a[i:, j:].sum())
        top = max(((i, j) for i in range(1, 5) for j in range(1, 6)), key=lambda c: sum(gain(x, y) for x, y in zip(cells(g, *c), cells(h, *c), strict=True)))
        leaf, got = q.crossed_tree(g, h, 2.0)
        assert got == pytest.approx(sum(gain(x, y) for x, y in zip(cells(g, *top), cells(h, *top), strict=True)) - gain(g.sum(), h.sum()))
        assert leaf[0, 0] == pytest.approx(cells(g, *top)[0] / (cells(h, *top)[0] + 2))
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float)
    model = q.fit(x, y, bins=8, rounds=20, n_pairs=2)
    for row, score in zip(x, model.score(x), strict=True):
        bins = [sum(v >= c for c in cuts) for v, cuts in zip(row, model.cuts, strict=True)]
        raw = model.base + sum(t[b] for t, b in zip(model.tables, bins, strict=True)) + sum(t[bins[i], bins[j]] for (i, j), t in model.pairs.items())
        assert score == pytest.approx(1 / (1 + math.exp(-raw)))
    assert (0, 1) in model.pairs or (1, 0) in model.pairs


def test_ftrl_equals_brute_force(spark):
    """Features, training and scores by dictionaries, one coordinate at a time."""
    from tessera.llm import toxicity as t

    bits = 18
    digest, mask = xxhash.xxh64_intdigest, 2**64 - 1

    def features(text):
        words = t._WORD.findall(text.lower())
        u = [digest(w, 1) for w in words]
        raw = Counter(h >> (64 - bits) for h in u)
        for w in words:
            raw.update((digest(w[:n], 100 + n) if len(w) >= n else 0) >> (64 - bits) for n in t.STEMS)
        for step, k in ((1, int(t._NEXT)), (2, int(t._SKIP))):
            raw.update((((a * k + b) & mask) * k & mask) >> (64 - bits) for a, b in zip(u, u[step:], strict=False))
        return {int(t.at_level(np.int64(i), x, bits)) for i, n in raw.items() for x in t.LEVELS if n >= x}

    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(WORDS + (["scum"] * 4 if i % 3 == 0 else [])) for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    made = t.Features(bits)
    for _, text in rows:
        assert set(t.feature_set(made(text), bits).tolist()) == features(text)
    import zlib

    labels = {i: int("scum" in text) for i, text in rows}
    trained = sorted((i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1), key=lambda i: xxhash.xxh64_intdigest(str(i)))
    texts, z, n, bias, bias_n = dict(rows), defaultdict(float), defaultdict(float), 0.0, 0.0
    alpha, beta, l1, l2 = 0.5, 1.0, 4.0, 0.5
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for _ in range(4):
        for i in trained:
            f = features(texts[i])
            w = {k: weight(k) for k in f}
            g = 1 / (1 + math.exp(-(sum(w.values()) + bias))) - labels[i]
            for k in f:
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * w[k]
                n[k] += g * g
            bias_n += g * g
            bias -= alpha * g / (beta + math.sqrt(bias_n))
    frame = docs(spark, [(i, text, "s") for i, text in rows])
    got = {r.doc_id: r.score for r in t.toxicity(frame, spark.createDataFrame([(i, 1, y) for i, y in labels.items()], "doc_id long, quality int, toxic int"), bits=bits).collect()}
    want = {i: 1 / (1 + math.exp(-(sum(weight(k) for k in features(text)) + bias))) for i, text in rows}
    assert got == pytest.approx(want, abs=1e-6)


def test_near_duplicate_stage_equals_brute_force(spark):
    from tessera.llm import simhash

    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng = random.Random(6)
    for k in range(40):
        w = rng.choice(rows)[1].split()
        cut = rng.randrange(max(1, len(w) // 12) + 1)
        rows.append((5000 + k, " ".join(w[cut:])))
    sets = []
    for _, text in rows:
        w = text.encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    best = {i: i for i, _ in rows}
    changed = True
    near = [(a, b) for a in range(len(rows)) for b in range(a) if (sets[a] == sets[b] if not (sets[a] and sets[b]) else len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    while changed:
        changed = False
        for a, b in near:
            low = min(best[rows[a][0]], best[rows[b][0]])
            for x in (a, b):
                if best[rows[x][0]] > low:
                    best[rows[x][0]], changed = low, True
    kept = sorted(r.doc_id for r in simhash.keep_one(docs(spark, [(i, t, "s") for i, t in rows])).collect())
    assert kept == sorted(i for i in best if best[i] == i) and len(kept) < len(rows)
