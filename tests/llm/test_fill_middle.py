"""Marker injection against plain cutting, with every character that is escaped."""

import hashlib
import re

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def by_hand(doc_id, text, percent=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    d = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    i, j = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", "\n", "\n\n\n", "one", "one\ntwo\nthree", "a\n\nb\n", "<P>x\ny", "<S\n>P>\n<\nM>", "\u001e\n\u001f\n\u001fm\u001fe\n\u001e\u001e", "\u001fe\u001em\n" * 5, "\r\nx\r\n y\n", "é\U0001f600\n" * 9, "$0\\1\n$1", "w" * 300000 + "\n" + "v\n" * 40000]


def test_equals_cutting_by_hand(spark):
    from tessera.llm import fill_middle

    rows = [(i * 100 + k, t, "l", "s", 0) for i, t in enumerate(TEXTS) for k in range(8)] + [(None, "p\nq\nr", None, None, 0)] * 2
    docs = spark.createDataFrame(rows, DOCS).withColumn("output", F.lit("clash"))
    for how in ({}, {"percent": 40, "spm_percent": 20}):
        made = fill_middle.transform(docs, **how)
        assert {(r.doc_id, r.n, r.form, r.output) for r in made.collect()} == {(i, n, f, o) for i, (n, f, _, _, o) in ((i, by_hand(i, t, how.get("percent", 100), how.get("spm_percent", 50))) for i, t, *_ in rows)}
        got = fill_middle.summarise(made).collect()
        assert len(got) == len(rows)
        texts = {i: t or "" for i, t, *_ in rows}
        for r in got:
            n, form, prefix, middle, output = by_hand(r.doc_id, texts[r.doc_id], how.get("percent", 100), how.get("spm_percent", 50))
            assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, middle)
            assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
            assert r.restored_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_escaping_is_reversible_and_leaves_no_mark(spark):
    from tessera.llm import fill_middle

    texts = ["".join(c) for c in __import__("itertools").product("\u001e\u001fem", repeat=4)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    e = fill_middle.escape(F.col("text"))
    got = df.select("text", e.alias("e"), fill_middle.unescape(e).alias("u")).collect()
    assert all(r.u == r.text and "\u001e" not in r.e for r in got)
    assert len({r.e for r in got}) == len(texts)


def test_other_units_and_empty_table(spark):
    from tessera.llm import fill_middle

    docs = spark.createDataFrame([(5, "one two  three. four", "l", "s", 0)], DOCS)
    made = fill_middle.transform(docs, pattern=r"\S+\s*|\s+").first()
    assert made.n == 4 and made.prefix + made.middle + made.suffix == made.text
    assert fill_middle.transform(docs.limit(0)).count() == 0
