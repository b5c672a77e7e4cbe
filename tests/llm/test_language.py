"""Cross-parsing against plain search, and languages of held-out texts."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def phrases_by_search(text, labelled):
    """The definition: each phrase is the longest run from where the last ended that stands in a labelled piece."""
    count = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and any(text[at : at + size + 1] in p for p in labelled):
            size += 1
        count, at = count + 1, at + size
    return count


def test_phrases_equal_plain_search():
    from tessera.llm.language import Model, letters

    draw = random.Random(5)
    word = lambda a: "".join(draw.choice(a) for _ in range(draw.randint(1, 6)))
    text = lambda a, n: " ".join(word(a) for _ in range(n))
    labelled = {"x": [text("abc", 40), text("abé", 9), "q"], "y": [text("cd文", 60)], "z": ["a"]}
    model = Model.of({k: [letters(p) for p in v] for k, v in labelled.items()})
    asked = [text("abcdé文Z", n) for n in (1, 2, 3, 10, 60, 200)] + ["", "...", labelled["x"][0], "ÉÉ a"]
    for block in (7, 64, 1024):
        got = model.phrases([letters(t) for t in asked], block)
        for t, row in zip(asked, got, strict=True):
            plain = "".join(map(chr, letters(t).tolist()))
            parts = [plain[i : i + block] for i in range(0, len(plain), block)]
            assert row.tolist() == [sum(phrases_by_search(p, labelled[k]) for p in parts) for k in sorted(labelled)]


def test_every_walk_of_the_automaton_is_a_run_and_every_run_a_walk():
    from tessera.llm.language import suffix_automaton

    text = "abcbcabbbcabca"
    edges = suffix_automaton(text)
    walks, todo = set(), [(0, "")]
    while todo:
        state, spelled = todo.pop()
        walks.add(spelled)
        todo += [(t, spelled + c) for c, t in edges[state].items()]
    assert walks == {text[i:j] for i in range(len(text) + 1) for j in range(i, len(text) + 1)}


def test_letters():
    from tessera.llm.language import letters

    assert "".join(map(chr, letters("  Ab1c -- É\n文! ").tolist())) == "ab c é 文"
    assert len(letters("12 .. ½²")) == 0


def corpus(spark):
    draw = random.Random(3)
    parts = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "ein", "ter"], "cc": ["ción", "ado", "lla", "que"]}
    rows = []
    for i in range(240):
        lang = sorted(parts)[i % 3]
        words = ["".join(draw.choice(parts[lang]) for _ in range(draw.randint(1, 3))) for _ in range(draw.choice([8, 30, 400]))]
        rows.append((i, " ".join(words), lang, "s", 0))
    return rows


def test_held_out_texts_and_odd_rows(spark):
    from tessera.llm import language

    rows = corpus(spark)
    odd = [(1000, None, "aa", "s", 0), (1001, "", "aa", "s", 0), (1002, "123 !", None, None, 0), (None, "toto kamira", None, "s", 0), (7, "toto kamira", "aa", "s", 0), (7, "toto kamira", "aa", "s", 0), (1003, "Кто там", None, "s", 0), (1004, "miratoka " * 30000, None, "s", 0)]
    docs = spark.createDataFrame(rows + odd, DOCS)
    got = language.languages(docs).collect()
    assert len(got) == len(rows) + len(odd)
    held = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(held[i].lang_pred == lang for i, _, lang, *_ in rows if i != 7)
    assert all((held[i].lang_pred, held[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert held[None].lang_pred == held[1004].lang_pred == "aa" and 0 <= held[1003].score <= 1
    # Labels of held-out rows, sources and ids change nothing.
    turned = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    again = {r.doc_id: (r.lang_pred, r.score) for r in language.languages(turned).collect()}
    assert again == {i: (r.lang_pred, r.score) for i, r in held.items()}


def test_no_labels_empty_tables_and_other_columns(spark):
    from tessera.llm import language

    docs = spark.createDataFrame([(1, "abc", None, "s", 1)], DOCS)
    assert [(r.lang_pred, r.score) for r in language.languages(docs).collect()] == [("und", 0.0)]
    assert language.languages(docs.limit(0)).count() == 0
    model = language.Model.of({"aa": [np.array([97, 98, 99], np.int32)]})
    clash = docs.withColumnRenamed("source", "score")
    assert language.predict(clash, model).columns == ["doc_id", "text", "lang", "n_chars", "lang_pred", "score"]


def test_the_sample_is_bounded_and_the_same_whatever_the_order(spark):
    from tessera.llm import language

    docs = spark.createDataFrame(corpus(spark), DOCS)
    a = language.train(docs, per_language=2000)
    b = language.train(docs.orderBy(F.desc("text")).repartition(3), per_language=2000)
    assert (a.sizes <= 2000 + 4).all() and (a.sizes > 500).all()
    assert (a.owner == b.owner).all() and (a.reached == b.reached).all()
