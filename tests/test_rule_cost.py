"""Rules build no value on the way to another, and say the same as before."""


def test_lists_are_counted_and_paths_come_from_places(spark):
    from tessera.operators import assertions, selectors

    steps = selectors.parse("$.components[*]")
    assert "variant" not in selectors.any_of("doc", steps).replace("try_variant_get", "")
    trie = selectors.Trie()
    tag, rest = trie.add("cyclonedx", "$.a.b[*].c[?(@.k == 'x')].d")
    assert selectors.suffix(rest) == ".d" and "path" not in trie.spreads[0].rows("node", "position")
    docs = ["[]", "{}", '{"components": []}', '{"components": [null]}', '{"components": {"a": 1}}', '{"components": [{"a": 1}, 2]}', '{"components": null}']
    frame = spark.createDataFrame(list(enumerate(docs)), "i int, t string").selectExpr("i", "parse_json(t) AS doc", "array(3, 5) AS position")
    at = selectors.walk("doc", selectors.parse("$.components[1]"))
    got = frame.selectExpr("i", f"{selectors.any_of('doc', steps)} AS found", f"{trie.path(tag, 'position')} AS path", f"to_json({at}) AS second").orderBy("i").collect()
    assert [r.found for r in got] == [False, False, False, True, False, True, False]
    assert {r.path for r in got} == {"$.a.b[3].c[5]"} and [r.second for r in got if r.second] == ["2"]
    said = ["", " ", " ﻿\t\n", "x", " x ", "NOASSERTION", " noAssertion\n", "NOASSERTION x", "xNOASSERTION", "noaßertion", "noassertıon", "noaſsertion", "\u0085", " \u0085", "no assertion", "NOASSERTION\u0085"]
    trimmed = r"regexp_replace(s, '^[\\s\\u00a0\\ufeff]+|[\\s\\u00a0\\ufeff]+$', '')"
    texts = spark.createDataFrame([(s,) for s in said], "s string").selectExpr("s", "to_variant_object(named_struct('k', s)) AS o").selectExpr("s", "try_variant_get(o, '$.k', 'variant') AS v")
    for r in texts.selectExpr("s", f"{assertions.truthy('v')} AS now", f"{trimmed} <> '' AND upper({trimmed}) <> 'NOASSERTION' AS was").collect():
        assert r.now == r.was, (r.s, r.now, r.was)
