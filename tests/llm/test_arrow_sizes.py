"""What passes through Arrow at once: training sets in rows of bounded size, texts once."""

import numpy as np
from test_llm import docs


def test_training_sets_are_cut_and_complete(spark):
    from pyspark.sql import functions as F

    from tessera.llm import toxicity

    texts = {1: " ".join(f"w{i}" for i in range(3000)), 2: "one two", 3: "", 4: "!"}
    rows = docs(spark, [(i, t, "s") for i, t in texts.items()]).select("doc_id", "text", F.lit(1).alias("__label"))
    got = toxicity.training_sets(rows).collect()
    assert max(len(r["at"]) for r in got) == toxicity.CHUNK
    for i, t in texts.items():
        mine = sorted((r["chunk"], r["at"]) for r in got if r["doc_id"] == i)
        assert [c for c, _ in mine] == list(range(len(mine))) and mine
        assert [x for _, at in mine for x in at] == toxicity.feature_set(toxicity.Features()(t), toxicity.BITS).tolist()


def test_weights_are_those_of_whole_sets(spark):
    """The same model as training on each set in one piece, in the order of the hashed ids."""
    import xxhash

    from tessera.llm import toxicity

    rng = np.random.default_rng(3)
    texts = {i: " ".join([f"w{x}" for x in rng.integers(0, 400, 150)] + ["scum"] * (i % 3 == 0)) for i in range(60)}
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in texts], "doc_id long, toxic int")
    got = toxicity.train(docs(spark, [(i, t, "s") for i, t in texts.items()]), labels, held=-2)
    model = toxicity.Ftrl()
    for _ in range(4):
        for i in sorted(texts, key=lambda i: xxhash.xxh64_intdigest(str(i))):
            model.learn(toxicity.feature_set(toxicity.Features()(texts[i]), toxicity.BITS).astype(np.int32), int(i % 3 == 0))
    w = model.weights()
    assert got == {-1: model.bias, **{int(k): float(w[k]) for k in np.flatnonzero(w)}}


def test_a_text_passes_through_arrow_once(spark):
    from tessera.llm import quality, toxicity

    d = docs(spark, [(1, "a b", "s"), (2, None, "s")])
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    for kept in (toxicity.reject_toxic(d, labels), quality.keep_quality(d, labels)):
        assert "__text" not in kept._jdf.queryExecution().analyzed().toString()
