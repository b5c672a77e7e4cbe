"""Each training-data operator against brute force, exact round trips, and odd inputs."""

import hashlib
import zlib

import pytest
from pyspark.sql import Row

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


ODD = [(1, None, "a"), (2, "", "a"), (3, "x", None), (None, "word word", "b"), (4, "One two three. Four five six.", "b"), (4, "One two three. Four five six.", "b"), (5, "é" * 3 + " \U0001f600 " + "w " * 30000, "b")]


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tessera.llm import token_count

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(r.doc_id, r.text, "s") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [*ODD, (9, "ΟΔΟΣ <|endoftext|>it's'LL <|startoftext|><|x|>", "s"), (10, "", "s")]
    library = Tokenizer.from_file(path)
    for chunk in (1 << 16, 53):
        got = token_count.count_tokens(docs(spark, rows), path, chunk=chunk).collect()
        assert len(got) == len(rows)
        want = sorted((i or -1, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
        assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def labelled(spark, bad, good, n=300):
    texts = [(i, bad(i) if i % 3 == 0 else good(i), "s") for i in range(n)]
    return docs(spark, texts), texts


def test_toxicity_learns_and_never_sees_held_out_rows(spark):
    from tessera.llm import toxicity

    good = lambda i: f"plain text number {i} about rivers and hills w{i % 17} z{i % 7}"
    d, texts = labelled(spark, lambda i: good(i) + " you utter gromwit" + "xyz"[i % 3], good)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, *_ in texts] + [(None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(d, labels).collect()}
    held = [i for i in got if crc(i, 3) == 1]
    assert all(got[i].held_out == (crc(i, 3) == 1) for i in got)
    assert sum(got[i].predicted == int(i % 3 == 0) for i in held) >= 0.97 * len(held)
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(doc_id AS string)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    again = {r.doc_id: r.score for r in toxicity.toxicity(d, turned).collect()}
    assert again == {i: r.score for i, r in got.items()}
    kept = {r.doc_id for r in toxicity.reject_toxic(d, labels).collect()}
    assert kept == {i for i, r in got.items() if not r.predicted}


def test_toxicity_odd_inputs(spark):
    from tessera.llm import toxicity

    d = docs(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.toxicity(d, none).collect()] == [0.0] * len(ODD)
    assert toxicity.reject_toxic(d.withColumnRenamed("lang", "score"), none).columns == ["doc_id", "text", "score", "source", "n_chars"]
    assert toxicity.toxicity(d.limit(0), none).count() == 0


def test_quality_learns_and_never_sees_held_out_rows(spark):
    from tessera.llm import quality

    d, texts = labelled(spark, lambda i: f"a$$$ b### c%%% {i}&&& d*** " * (1 + i % 5), lambda i: f"The river runs by the hill. It was calm on day {i}.\nThen rain came down." * (1 + i % 4))
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i, *_ in texts] + [(None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality(d, labels).collect()}
    held = [i for i in got if crc(i, 5) == 0]
    assert all(got[i].held_out == (crc(i, 5) == 0) for i in got)
    assert sum(got[i].predicted == int(i % 3 != 0) for i in held) >= 0.97 * len(held)
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    assert {r.doc_id: r.score for r in quality.quality(d, turned).collect()} == {i: r.score for i, r in got.items()}
    odd = quality.quality(docs(spark, ODD), labels).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert quality.keep_quality(docs(spark, ODD), labels.limit(0)).count() == len(ODD)


def brute_components(texts, radius=2):
    from tessera.llm.simhash import fingerprint

    prints = {i: fingerprint(t or "") for i, t in texts}
    out = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= radius and out[b] < out[a]:
                    out[a], changed = out[b], True
    return {i: (f"{prints[i]:016x}", out[i]) for i in prints}


def slow_fingerprint(text):
    import re

    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark):
    from tessera.llm import simhash

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    base = "der Fluss ÄB Weg  Tal Berg Stein Wald Feld Haus Tor Bach Moor Wiese Dorf " * 9
    rows += [(10_000 + i, base + f"x{i}") for i in range(40)] + [(20_000, None), (20_001, ""), (20_002, "Two words"), (20_003, "two\x0bWORDS")]
    for _, t in rows[:50] + rows[-8:]:
        assert simhash.fingerprint(t or "") == slow_fingerprint(t or "")
    for limit in (20_000, 3):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(spark, [(i, t, "s") for i, t in rows]), shard_limit=limit).collect()}
        assert got == brute_components(rows)


def test_simhash_search_loses_no_link():
    import random

    from tessera.llm.simhash import links_in_shard

    rng = random.Random(3)
    values = list({rng.getrandbits(12) for _ in range(300)})
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 1:
                parent[root(a)] = root(b)
    want = len({root(v) for v in values})
    got = links_in_shard([(v, v) for v in values], 1)
    assert len(values) - len(got) == want and all((a ^ b).bit_count() <= 1 for a, b in got)


def test_near_dedup_stage(spark):
    from tessera.llm import simhash

    words = [f"w{i}" for i in range(400)]
    near = " ".join(words[:200] + ["changed"] + words[201:])
    other = " ".join(f"v{i}" for i in range(400))
    rows = [(1, " ".join(words), "a"), (2, near, "a"), (3, other, "a"), (4, other, "b"), (None, other, "b"), (5, None, "b"), (6, "", "b"), (7, "short text", "b"), (7, "short text", "b"), (8, "text short", "b")]
    for limit in (20_000, 1):
        got = sorted(r.doc_id or -1 for r in simhash.keep_one(docs(spark, rows), shard_limit=limit).collect())
        assert got == [-1, 1, 3, 5, 7, 7, 8]
    assert simhash.keep_one(docs(spark, rows).limit(0)).count() == 0


QUESTION = "A farmer in the village has 12 apples and gives 5 km of rope to her neighbour before walking home across the old stone bridge"


def test_decontamination(spark):
    from tessera.llm import decontaminate

    copy = QUESTION.replace("12", "47").replace("5", "9")
    rows = [
        (1, f"Intro words here. {QUESTION} and more", "s"),
        (2, f"lead {copy} tail", "s"),
        (3, QUESTION.upper(), "s"),
        (4, "The farmer has apples and a rope and a bridge of old stone in the village", "s"),
        (5, None, "s"),
        (None, QUESTION, "s"),
        (6, QUESTION + "\n" + copy, "s"),
        (6, QUESTION + "\n" + copy, "s"),
        (7, "one two three four five six seven eight nine " * 50, "s"),
    ]
    bench = spark.createDataFrame([(1, QUESTION), (1, QUESTION), (2, None), (None, QUESTION), (3, "Tiny item"), (4, ""), (5, "only five plain words here")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (6, 1)}
    assert got[2, 1].re_parameterised and not got[1, 1].re_parameterised and got[1, 1].share == 1
    short = decontaminate.contaminated(docs(spark, [(1, "here are only five plain words here for you", "s")]), bench).collect()
    assert [(r.doc_id, r.item_id) for r in short] == [(1, 5)]
    kept = decontaminate.drop_contaminated(docs(spark, rows), bench)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 4, 5, 7]
    assert decontaminate.contaminated(docs(spark, rows).limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs(spark, rows), bench.limit(0)).count() == 0


def test_slots_must_be_filled_consistently(spark):
    from tessera.llm import decontaminate

    item = "take 3 grams of salt with 3 cups of water then stir the whole bowl until nothing of it is left"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item.replace("3", "8"), "s"), (2, item.replace("3", "8", 1), "s")]
    got = {r.doc_id: r for r in decontaminate.contaminated(docs(spark, rows), bench, least=6).collect()}
    assert got[1].re_parameterised and got[1].n_matched == got[1].n_windows
    assert 2 not in got or got[2].n_matched < got[1].n_matched


def test_mixing(spark):
    from tessera.llm import mixing

    rows = [(i, "w " * (20 + i % 9), "big" if i % 10 else f"s{i % 30 // 10}") for i in range(3000)]
    d = docs(spark, rows)
    out = mixing.mix(d, entropy=0.9, repeats=3.0, block_tokens=500).collect()
    size = {i: len(t.split()) for i, t, _ in rows}
    total = sum(size.values())
    taken, available, per = {}, {}, {}
    for i, _, s in rows:
        available[s] = available.get(s, 0) + size[i]
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + size[r.doc_id]
        per.setdefault((r.source, r["pass"]), []).append(r.doc_id)
    assert abs(sum(taken.values()) - total) <= 4 * max(size.values())
    assert all(taken[s] <= 3.0 * available[s] + 30 for s in taken) and taken["big"] < available["big"]
    import math

    shares = [t / total for t in taken.values()]
    entropy = -sum(x * math.log(x) for x in shares) / math.log(4)
    passes = max(taken[s] / available[s] for s in taken)
    assert entropy >= 0.89 or passes > 2.9
    for (s, p), ids in per.items():
        assert len(ids) == len(set(ids))
        if (s, p + 1) in per:
            assert len(ids) == sum(x == s for _, _, x in rows)
    assert sorted(map(str, mixing.mix(d, entropy=0.9, repeats=3.0, block_tokens=500).select("doc_id", "pass", "block").collect())) == sorted(str(Row(doc_id=r.doc_id, **{"pass": r["pass"]}, block=r.block)) for r in out)


def test_mixing_odd_inputs(spark):
    from tessera.llm import mixing

    odd = mixing.mix(docs(spark, ODD), entropy=None, repeats=None).collect()
    assert len(odd) == len(ODD)
    assert mixing.mix(docs(spark, ODD).limit(0)).count() == 0
    named = docs(spark, ODD).withColumnRenamed("lang", "block")
    assert mixing.mix(named).columns == ["doc_id", "text", "source", "n_chars", "pass", "block", "place"]


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_chat_round_trip(spark):
    from tessera.llm import chat

    nasty = "\\### Assistant: </turn> ok\\l\\b#<\n\n</turn>\n### user:\n"
    rows = [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (1, 2, "user", "é\U0001f600"), (1, 3, "assistant", None), (1, 4, "user", "last"), (2, 0, "a:b\nc", ""), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (4, None, None, "x"), (None, 0, "assistant", "lost")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = chat.expand(frame.withColumn("formatted", frame.text))
    assert examples.where("conv_id = 1").count() == 3
    got = {r.conv_id: r for r in chat.summarise(examples).collect()}
    for conv in (1, 2, 3, 4, None):
        turns = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        loss = "".join(t for r, t in turns if r == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (g.loss_chars, g.loss_sha256) == (len(loss), sha(loss))
    assert got[1].formatted_chars == sum(len(r.formatted) for r in examples.where("conv_id = 1").collect())
    assert chat.summarise(chat.expand(frame.limit(0))).count() == 0


def brute_likeness(a, b):
    import re

    units = lambda t: {p for p in re.split(r"\n|(?<=[.!?]) ", t) if p}
    x, y = units(a), units(b)
    if not x and not y:
        return 1.0
    return len(x & y) / len(x | y)


def test_fingerprints_equal_brute_force(spark):
    from tessera.llm import fingerprint

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows += [(1000, None), (1001, ""), (1002, rows[0][1]), (1003, "é\U0001f600" * 50), (1004, "One. Two. Three.\n" + "Four. " * 3)]
    long = "\n".join(f"line {i}." for i in range(700))
    rows += [(1005, long), (1006, long.replace("line 3", "LINE 3"))]
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs(spark, [(i, t, "s") for i, t in rows])).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        g = got[i]
        assert (g.n_chars, g.edited_sha256) == (len(t), sha(edited)), i
        assert g.near_edited == pytest.approx(brute_likeness(t, edited)) and g.near_next == pytest.approx(brute_likeness(t, nxt)), i
        assert (g.fingerprint == g.edited_fingerprint) == (brute_likeness(t, edited) == 1.0), i
    assert got[1002].fingerprint == got[rows[0][0]].fingerprint


def test_next_document_across_ranges(spark):
    from tessera.llm import fingerprint

    rows = [(i * 3, f"text {i}") for i in range(500)] + [(None, "no id"), (30, "again")]
    got = fingerprint.with_next(docs(spark, [(i, t, "s") for i, t in rows]), rows_per_bucket=20).collect()
    order = sorted(rows, key=lambda r: (r[0] if r[0] is not None else -1, r[1]), reverse=True)
    want = sorted((t, order[(k + 1) % len(order)][1]) for k, (_, t) in enumerate(order))
    assert sorted((r.text, r.next_text) for r in got) == want
    assert fingerprint.with_next(docs(spark, [(1, "a", "s")])).first().next_text == "a"
    assert fingerprint.edited_fingerprints(docs(spark, [(1, "a", "s")]).limit(0)).count() == 0


def test_likeness_comes_from_peeled_sketches(spark, monkeypatch):
    """Without peeling nothing is recovered, so no likeness below 1 can come from anywhere else."""
    from pyspark.sql import functions as F

    from tessera.llm import fingerprint as f

    rows = [(i, "\n".join(f"line {i * k}" for k in range(1 + i * 7))) for i in range(1, 12)]
    frame = docs(spark, [(i, t, "s") for i, t in rows])
    true = [r.near_next for r in f.edited_fingerprints(frame).orderBy("doc_id").collect()]
    assert max(true) < 0.6
    none = F.array().cast("array<long>")
    monkeypatch.setattr(f, "peel", lambda cells, steps=4: F.struct(none.alias("found"), none.alias("left")))
    assert [r.near_next for r in f.edited_fingerprints(frame).collect()] == [1.0] * len(rows)


def test_peeling_recovers_digests(spark):
    from pyspark.sql import functions as F

    from tessera.llm import fingerprint as f

    for n in (0, 3, 40, 400, 3000):
        texts = spark.createDataFrame([("\n".join(map(str, range(n + 6))), "\n".join(map(str, range(n, n + 9))))], "a string, b string")
        row = texts.select(f.paragraphs(F.col("a")).alias("a"), f.paragraphs(F.col("b")).alias("b"))
        found = row.select("a", "b", f.difference(F.col("a"), F.col("b"), f.sketch(F.col("a")), f.sketch(F.col("b"))).alias("d")).first()
        assert len(found.d) == len(set(found.d)) and set(found.d) == set(found.a) ^ set(found.b)


PAGES = "page_id long, url string, html string"


def test_warc_round_trip(spark, tmp_path):
    from tessera.llm import warc

    big = "<p>" + "long page text " * 40 + "</p>"
    rows = [(5, "http://a/\r\nX: y", big), (3, "http://b", big), (9, None, big), (1, "u", "small"), (2, "u", "small"), (4, "u", None), (6, "u", ""), (None, "u", big), (7, "u", "WARC/1.1\r\n\r\n" * 20), (8, "u", "é" * 60000)]
    pages = spark.createDataFrame(rows, PAGES).withColumnRenamed("url", "url").repartition(3)
    got = {r.page_id: r for r in warc.archive(pages, tmp_path.as_uri()).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        body = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        revisit = h == big and i != 3
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 3) if revisit else ("response", None))
    assert warc.archive(pages.limit(0), tmp_path.as_uri()).count() == 0


def test_warc_dictionary_leads_and_serves(tmp_path):
    import io
    import struct

    import zstandard

    from tessera.llm import warc

    records = [warc.build_record(i, f"http://x/{i}", f"<html><body>page {i} of the same site</body></html>".encode() * 3, "00", None) for i in range(200)]
    dictionary = warc.train_dictionary(records)
    out = io.BytesIO()
    w = warc.ArchiveWriter(out, dictionary)
    for r in records:
        w.add(r)
    data = out.getvalue()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and data[8 : 8 + size] == dictionary
    plain = sum(len(zstandard.ZstdCompressor().compress(r)) for r in records)
    assert len(data) - 8 - size < plain
    for step in (7, 1 << 18):
        assert list(warc.read_records(io.BytesIO(data), step)) == records
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(data[:-5])))


def test_extraction_exact_on_articles(spark):
    import html
    import re

    from tessera.llm import extract

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in extract.extract(pages).join(pages, ["page_id", "url"]).collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?p>|</?h1>", body)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_extraction_leaves_furniture_out():
    from tessera.llm.extract import best_run, main_text

    words = "The long report says that the bridge will stay shut until the spring of next year."
    page = f"""<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body class="with-sidebar">
    <header><h1>Site name</h1></header><div id="cookie-notice">We use cookies. <button>OK</button></div>
    <div class="menu"><a href=1>Home</a> <a href=2>News</a></div>
    <main><article><header><h1>Bridge   shut</h1></header><p>{words}<script>var a="</p>"</script></p>
    <div class="ad">Buy <b>now</b></div><p>Caf&eacute; &amp; bar &lt;open&gt;&nbsp;late<br>today<p>{words}
    <form><input name=q><label>Search</label></form><ul><li>first<li>second</ul>
    <section class="comments"><p>Reader says hello to everybody in the whole valley</p></section></article></main>
    <aside class="sidebar"><p>Most read this week</p></aside><footer>&copy; all rights</footer></body></html>"""
    assert main_text(page) == "\n\n".join(["Bridge shut", words, "Café & bar <open> late today", words, "first", "second"])
    plain = f"<body><div><a href=1>Home</a> <a href=2>About</a></div><h2>Title</h2><p>{words}</p><p>Short.</p><p>{words}</p><div><a href=3>Next</a></div></body>"
    assert main_text(plain) == "\n\n".join(["Title", words, "Short.", words])
    assert main_text(None) == main_text("") == main_text("<nav>Menu</nav>") == ""
    assert main_text("<p>" + "word " * 200_000 + "</p>") == ("word " * 200_000).strip()
    assert main_text("<article><p>cut off &am").endswith("&am")
    assert best_run([-1, 2, -1, 3, -5, 1]) == (1, 4) and best_run([-1]) == (0, 0)


def test_scan_finds_the_best_contiguous_run():
    import random

    from tessera.llm.extract import best_run

    rng = random.Random(2)
    for _ in range(400):
        scores = [rng.choice((-3, -1.5, -0.25, 0.5, 1, 4)) for _ in range(rng.randrange(14))]
        sums = {(a, b): sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)}
        best = max(sums.values(), default=0)
        a, b = best_run(scores)
        assert sum(scores[a:b]) == pytest.approx(max(best, 0))


def test_the_scan_decides(spark, monkeypatch):
    """Learned weights and the scan choose the region: without either the text is another."""
    from tessera.llm import extract

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights = extract.learn(pages)
    assert weights["word"] > 0 > max(v for k, v in weights.items() if k != "word")
    words = "Nobody at the depot had seen the second van since the storm, and its driver did not answer."
    page = f"<body><p>Tip: <i>x</i><i>y</i><i>z</i></p><hr><hr><hr><hr><div><h2>Lost van</h2><p>{words}</p><p>{words}</p></div><hr><hr><hr><hr><p><span>Ok</span><br><img><br><img></p></body>"
    parted = extract.WEIGHTS | {"<hr": -3.0}
    want = "\n\n".join(["Lost van", words, words])
    assert extract.main_text(page, parted) == want != extract.main_text(page)
    monkeypatch.setattr(extract, "best_run", lambda scores: (0, len(scores)))
    assert extract.main_text(page, parted) != want


@pytest.mark.parametrize("hold", ["article", "main", "div", "section", "td"])
def test_layouts(spark, hold):
    """The same text in layouts with and without elements that mark it, by weights learned from the test pages."""
    from tessera.llm import extract

    weights = extract.learn(spark.read.parquet(f"{SF}/pages.parquet"))
    words = "The council will vote on the new timetable in the second week of March, its speaker said."
    inner = f"<h1>New timetable</h1><p>{words}</p><div class='advert'>Buy <b>now</b></div><p>{words}</p><ul><li>first point of it<li>second point of it</ul><p>{words}</p>"
    body = f"<table><tr><td>{inner}</td></tr></table>" if hold == "td" else f"<{hold}>{inner}</{hold}>"
    page = f"<html><head><title>T</title><script>var x=1</script></head><body class='with-sidebar'><nav><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul></nav><div class='cookie-notice'>We use cookies here.</div>{body}<section class='comments'><p>A reader says hello to the whole town and more</p></section><aside class='sidebar'><p>Most read</p></aside><footer>All rights reserved</footer></body></html>"
    assert extract.main_text(page, weights) == "\n\n".join(["New timetable", words, words, "first point of it", "second point of it", words])
    kept = extract.main_text(f"<{hold if hold != 'td' else 'div'}><p>{words}</p><div class='print response'><p>{words}</p></div></{hold if hold != 'td' else 'div'}>", weights)
    assert kept == f"{words}\n\n{words}"


def test_extraction_odd_rows(spark):
    from tessera.llm import extract

    rows = spark.createDataFrame([(1, None, None), (1, None, None), (2, "u", "<p>" * 3000), (None, "u", "just words")], PAGES)
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in extract.extract(rows.withColumn("text", rows.html)).collect())
    assert got == [(0, "just words", 10), (1, "", 0), (1, "", 0), (2, "", 0)]


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "mixing"]
    start = spark.read.parquet(f"{SF}/documents.parquet")
    docs_ = start
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs_, SF)
        assert after.columns == corpus_pipeline.COLUMNS
        rows = {tuple(r) for r in after.collect()}
        assert rows and rows <= {tuple(r) for r in docs_.collect()}
        docs_ = after
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}


def test_columns_of_any_name_pass_through(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessera.llm import chat, decontaminate, extract, fingerprint, mixing, quality, simhash, token_count, toxicity, warc

    more = ["s", "t", "h", "full", "block", "pass", "node", "component", "component_id", "score", "bits", "keys", "h", "at", "slots", "item_id", "turns", "a", "b", "sa", "next_text", "n_tokens", "edge_turn", "tokens", "size", "predicted"]
    d = docs(spark, ODD).select("*", *[F.lit("x").alias(c) for c in dict.fromkeys(more)])
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x")).withColumn("score", F.lit("x"))
    bench = spark.createDataFrame([(1, QUESTION)], "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("h", F.lit(1))
    import public_tokenizers

    n = len(ODD)
    assert mixing.mix(d, entropy=None, repeats=None).count() == n
    assert token_count.count_tokens(d, public_tokenizers.path("word_bpe_49k.json")).count() == n
    assert fingerprint.edited_fingerprints(d).count() == simhash.near_duplicates(d).count() == n
    assert toxicity.toxicity(d, labels).count() == quality.quality(d, labels).count() == n
    for kept in (simhash.keep_one(d), decontaminate.drop_contaminated(d, bench), toxicity.reject_toxic(d, labels), quality.keep_quality(d, labels)):
        assert kept.columns == d.columns and kept.count() <= n
    assert decontaminate.contaminated(d, bench).count() == 0
    turns = spark.createDataFrame([(1, 0, "assistant", "x")], "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1)).withColumn("target", F.lit(1))
    assert chat.summarise(chat.expand(turns)).count() == 1
    pages = spark.createDataFrame([(1, "u", "<p>x</p>")], PAGES).withColumn("digest", F.lit(1)).withColumn("first", F.lit(1)).withColumn("payload", F.lit(1)).withColumn("text", F.lit(1)).withColumn("h", F.lit(1))
    assert extract.extract(pages).count() == warc.archive(pages, tmp_path.as_uri()).count() == 1


def test_class_words_inside_the_main_text():
    """Parts of an article whose class only has a word of furniture in it stay; furniture inside an article goes."""
    from tessera.llm.extract import main_text

    words = "The council will vote on the new timetable in the second week of March, its speaker said."
    for name, kept in (("related-work", True), ("rail-history", True), ("banner-headed-song", True), ("related-links", False), ("ad-slot-top", False), ("comment-list", False), ("newsletter box", False), ("share", False)):
        page = f"<article><p>{words}</p><section class='{name}'><p>part</p></section><p>{words}</p></article>"
        assert main_text(page) == "\n\n".join([words, "part", words] if kept else [words, words]), name
    assert main_text(f"<div class='related-work'><p>part</p></div><article><p>{words}</p></article>") == words
