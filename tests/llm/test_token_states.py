"""The transducer's states and chunk maps against the library."""

import random

import public_tokenizers
from tokenizers import Tokenizer as Library

from tessera.llm.token_count import Tokenizer, prefix_scan

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Library.from_file(PATH)


def count(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_transitions_add_up():
    t = Tokenizer(PATH)
    for word in ("unbelievable", "zqxj", "a", "internationalisations", "abababababcabc"):
        assert sum(t.words.emitted(word)) == count(word)


def test_scan():
    for n in range(9):
        assert prefix_scan(list("abcdefgh"[:n]), lambda a, b: a + b) == ["abcdefgh"[: i + 1] for i in range(n)]


def test_chunk_maps_compose_in_any_order():
    t, rng = Tokenizer(PATH), random.Random(5)
    signs = "aabeilnorst" + "'" * 5 + "relvmd 0 9 .,!?\n　é ß漢字́Σİ"
    for _ in range(200):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(90)))
        whole, step = t.normalise(text), rng.randrange(1, 12)
        maps = [t.chunk(whole[i : i + step]) for i in range(0, len(whole), step)]
        while len(maps) > 1:
            i = rng.randrange(len(maps) - 1)
            maps[i : i + 2] = [t.compose(maps[i], maps[i + 1])]
        state, n = maps[0].apply(t.scanner, t.scanner.start) if maps else (t.scanner.start, 0)
        assert n + state.closing == count(text) == t.count(text, step), text
        upto = t.counts(text, step)
        assert len(upto) == -(-len(whole) // step)
        if "́" not in whole:
            assert upto == [count(whole[: i + step]) for i in range(0, len(whole), step)]


def test_states_are_shared_by_words():
    t, rng = Tokenizer(PATH), random.Random(7)
    words = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randrange(6, 30))) for _ in range(3000)]
    assert all(t.count(w) == count(w) for w in words)
    assert len(t.words.states) < len({w[:i] for w in words for i in range(1, len(w))})


def test_compiled_states_are_bounded(monkeypatch):
    from tessera.llm import token_count

    monkeypatch.setattr(token_count, "MOST_STATES", 40)
    t = Tokenizer(PATH)
    texts = [f"{i} internationalisation don't we'll {'x' * i}" for i in range(30)]
    assert all(t.count(x) == count(x) for x in texts)
