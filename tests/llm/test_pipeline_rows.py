"""The pipeline's stages on odd rows, and its result against the stages' own definitions."""

import random

from pyspark.sql import functions as F


def odd_tables(spark, folder):
    """Documents with nulls, empty, repeated and very long texts and clashing columns; labels; a benchmark."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(("ba", "do", "ke", "lu", "mi", "no", "ri", "sa", "te")) for _ in range(rng.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n)) + "."
    item = text(30)
    rows, labels = [], []
    for i in range(240):
        toxic, bad = i % 8 == 0, i % 8 == 1
        t = text(60)
        t = t + " scum trash loser" * 3 if toxic else " ".join(w + "$$$ &&&" for w in t.split()) if bad else t
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, int(not bad), int(toxic)))
    base = text(120)
    long = text(60_000)
    extra = [(1000, base), (1001, base), (1002, base.replace(base.split()[50], "other", 1)), (1003, text(40) + " " + item + " " + text(40)), (1004, None), (1005, ""), (1006, long), (None, text(50)), (1007, base), (1007, base)]
    rows += [(i, t, None, None, len(t or "")) for i, t in extra]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).withColumns({c: F.lit("x") for c in ("score", "__score", "node", "keys", "h", "block", "s")})
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, item


def test_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as p

    rows, item = odd_tables(spark, tmp_path.as_uri())
    docs = spark.read.parquet(f"{tmp_path.as_uri()}/documents.parquet")
    ids = lambda df: sorted((r.doc_id if r.doc_id is not None else -1) for r in df.collect())
    out, after = {}, docs
    for name, stage in p.STAGES[:-1]:
        before = ids(after)
        after = p.materialise(stage(spark, after, tmp_path.as_uri()), name)
        assert after.columns == p.COLUMNS
        out[name] = set(before) - set(ids(after))
    toxic = {i for i in range(0, 240, 8)}
    assert len(out["toxicity"] & toxic) >= 0.9 * len(toxic) and out["toxicity"] <= toxic
    assert out["quality"] - {1004, 1005} <= {i for i in range(1, 240, 8)} and len(out["quality"]) >= 27
    assert out["near_duplicates"] >= {1001, 1002, 1007} and out["near_duplicates"] <= {1001, 1002, 1005, 1007}
    assert out["decontamination"] == {1003}
    kept = ids(after)
    assert {-1, 1000, 1006} <= set(kept)
    mixed = p.run(spark, tmp_path.as_uri())
    assert {r.doc_id for r in mixed.collect()} <= {i if i != -1 else None for i in kept}


def test_stages_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    odd_tables(spark, tmp_path.as_uri() + "/full")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path.as_uri()}/full/{t}.parquet").limit(0).write.parquet(f"{tmp_path.as_uri()}/none/{t}.parquet")
    full = spark.read.parquet(f"{tmp_path.as_uri()}/full/documents.parquet")
    for name, stage in p.STAGES:
        assert stage(spark, full.limit(0), tmp_path.as_uri() + "/full").count() == 0
        if name in ("toxicity", "quality", "decontamination"):
            assert stage(spark, full, tmp_path.as_uri() + "/none").count() == full.count()
