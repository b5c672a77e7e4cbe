"""Items with few plain words are matched word for word."""

from test_llm import docs


def test_items_with_few_plain_words(spark):
    from tessera.llm import decontaminate

    sums = "What is 12 + 45 * 3?"
    units = "Add 3 kg, 4 kg, 5 g and 6 g to 7 ml, then 8 ml and 9 l, 10 l or 11 m"
    mixed = "Berries grow slowly beside quiet rivers near 4 hills 5 km 6 km 7 km 8 km 9 km 10 km"
    bench = spark.createDataFrame([(1, sums), (2, "Name 7 primes"), (3, units), (4, mixed), (5, "+ * ?")], "item_id long, text string")
    rows = [
        (1, f"A sheet asks: {sums} Write it down.", "s"),
        (2, f"A sheet asks: {sums.replace('45', '46')} Write it down.", "s"),
        (3, "please name 7 primes today", "s"),
        (4, "please name 8 primes today", "s"),
        (5, f"Recipe. {units.upper()} in all", "s"),
        (6, "Add 4 kg, 5 kg, 6 g and 7 g to 8 ml, then 9 ml and 1 l, 2 l or 3 m", "s"),
        (7, f"so {mixed} on", "s"),
        (8, mixed.replace("4 hills 5", "3 hills 2"), "s"),
    ]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert set(got) == {(1, 1), (3, 2), (5, 3), (7, 4), (8, 4)}
    assert all(got[k].share == 1 and not got[k].re_parameterised for k in [(1, 1), (3, 2), (5, 3), (7, 4)])
    assert got[8, 4].re_parameterised
    kept = decontaminate.drop_contaminated(docs(spark, rows), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 6]
