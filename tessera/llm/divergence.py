"""How the sources of a language differ in their words: byte-level tokens, sparse counts, exact divergences.

A worker joins the texts of a batch into one UTF-8 buffer.  A table over the 256 byte
values says which bytes stand in a term; where that changes are the terms' boundaries.
Slices are grouped by xxHash and compared byte by byte with the first of their group, so
that two terms which share a hash are told apart.  Spark adds up what the batches have.

Kept terms are dealt to blocks by hash.  A block holds one CSR matrix (sources by terms)
and gives, by sums over the rows' slices, its part of every pair of sources and its best
terms of every source; Spark adds and ranks those.  All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, pieces, ship

SCALE_DIGITS = 9
LEAST_DOCUMENTS, TOP = 3, 200
BLOCK_ENTRIES = 500_000
#: Bytes that a worker cuts at once.
MOST_AT_ONCE = 8_000_000

#: Byte to its lower-case form, 0 for a byte that ends a term.
FOLD = np.zeros(256, np.uint8)
FOLD[ord("a") : ord("z") + 1] = FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
FOLD[128:] = np.arange(128, 256)


def boundaries(folded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of nonzero bytes."""
    inside = np.zeros(len(folded) + 2, np.int8)
    inside[1:-1] = folded != 0
    change = np.diff(inside)
    return np.flatnonzero(change > 0), np.flatnonzero(change < 0)


def group_slices(buffer: bytes, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh64_intdigest) -> tuple[np.ndarray, list[bytes]]:
    """A number for each slice, equal for equal bytes only, and the bytes of each number.

    Slices are sorted by hash; every slice is compared with the first one of its hash,
    and what is not the same (a collision) gets a number by its bytes.
    """
    if not len(starts):
        return np.zeros(0, np.int64), []
    hashes = np.fromiter((digest(buffer[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    texts = [buffer[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    size, model = ends - starts, first[number]
    same = size == size[model]
    at = np.flatnonzero(same & (np.arange(len(starts)) != model))
    # Byte i of each slice against byte i of its model, all slices in one flat array.
    begin = np.cumsum(size[at]) - size[at]
    step = np.arange(int(size[at].sum())) - np.repeat(begin, size[at])
    data = np.frombuffer(buffer, np.uint8)
    differs = data[np.repeat(starts[at], size[at]) + step] != data[np.repeat(starts[model[at]], size[at]) + step]
    if len(at):
        same[at] = np.add.reduceat(differs, begin) == 0  # no slice is empty
    known: dict[bytes, int] = {}
    for i in np.flatnonzero(~same).tolist():
        text = buffer[starts[i] : ends[i]]
        if text not in known:
            known[text] = len(texts)
            texts.append(text)
        number[i] = known[text]
    return number, texts


def count_terms(texts: list[bytes], owner: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(owner, term, occurrences, documents) in columns, and the terms' bytes; ``owner`` says whose document a text is."""
    buffer = FOLD[np.frombuffer(b"\0".join([*texts, b""]), np.uint8)]
    starts, ends = boundaries(buffer)
    number, terms = group_slices(buffer.tobytes(), starts, ends)
    opens = np.cumsum([0, *(len(t) + 1 for t in texts)])
    document = np.searchsorted(opens, starts, side="right") - 1
    width = max(len(terms), 1)
    met, times = np.unique(document * width + number, return_counts=True)  # each term once a document
    keys = np.asarray(owner, np.int64)[met // width] * width + met % width
    order = np.argsort(keys, kind="stable")
    found, first = np.unique(keys[order], return_index=True)
    occurrences = np.add.reduceat(times[order], first) if len(found) else times
    documents = np.diff([*first.tolist(), len(keys)])
    return found // width, found % width, occurrences, documents, terms


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows with the term), added up over all rows."""
    import pyarrow as pa

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.divergence import MOST_AT_ONCE, count_terms

        names = ["lang", "source", "term", "n", "docs"]
        groups: dict[tuple[str, str], int] = {}
        texts, owner, size = [], [], 0

        def made() -> pa.RecordBatch:
            who, term, n, with_it, terms = count_terms(texts, owner)
            known = list(groups)
            words = pa.array(terms, pa.binary()).cast(pa.string())
            pick = lambda k: pa.array([g[k] for g in known], pa.string()).take(pa.array(who))
            return pa.RecordBatch.from_arrays([pick(0), pick(1), words.take(pa.array(term)), pa.array(n, pa.int64()), pa.array(with_it, pa.int64())], names=names)

        for b in pieces(batches, 200):
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                texts.append(text.encode())
                owner.append(groups.setdefault((lang, source), len(groups)))
                size += len(texts[-1])
                if size >= MOST_AT_ONCE:
                    yield made()
                    groups, texts, owner, size = {}, [], [], 0
        if texts:
            yield made()

    counted = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10**9 * count / total) for 0 < count <= total, exact for totals below 9 * 10**17."""
    count, total = np.broadcast_arrays(np.asarray(count, np.int64), np.asarray(total, np.int64))
    out, rest = np.divmod(count, total)
    for _ in range(SCALE_DIGITS):
        digit, rest = np.divmod(rest * 10, total)
        out = out * 10 + digit
    return out + 1


def gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / q); p and q are at most 10**9 + 1, so the square fits 63 bits."""
    d = p - q
    return d * d // q


def pair_sums(n: np.ndarray, row: np.ndarray, term: np.ndarray, terms: int, total: np.ndarray) -> np.ndarray:
    """For every two rows the sum of :func:`gain` over all ``terms`` columns of a sparse matrix of counts.

    Entries are in order of ``row``.  ``total`` is each row's number of occurrences over all
    kept terms plus that of kept terms, so a missing entry has the share of (0 + 1) in it.
    Against one row, spread out over all columns, every entry of the matrix stands with its
    own share instead of a missing one's: the sums of those differences over the rows'
    slices correct the sum in which all entries are missing.
    """
    rows = len(total)
    p = shares(n + 1, total[row])
    none = shares(np.ones(rows, np.int64), total)
    ends = np.searchsorted(row, np.arange(rows + 1))
    filled = np.flatnonzero(np.diff(ends))
    out = np.zeros((rows, rows), np.int64)
    spread = np.empty(terms, np.int64)
    for g in range(rows):
        own = slice(ends[g], ends[g + 1])
        spread[:] = none[g]
        spread[term[own]] = p[own]
        # All other rows empty: equal counts have equal shares, so each is asked once.
        values, times = np.unique(p[own], return_counts=True)
        out[g] = gain(none[g], none) * (terms - (ends[g + 1] - ends[g]))
        for k in range(0, len(values), 4096):
            out[g] += (gain(values[k : k + 4096, None], none) * times[k : k + 4096, None]).sum(0)
        if len(filled):
            mine = spread[term]
            out[g, filled] += np.add.reduceat(gain(mine, p) - gain(mine, none[row]), ends[filled])
    return out


def divergence_of_block(entries, groups, top: int):
    """The rows (lang, source, part, item, value) of one block of one language: Arrow tables in and out."""
    import pyarrow as pa
    import pyarrow.compute as pc

    names = ["lang", "source", "part", "item", "value"]
    if not entries.num_rows:
        return pa.table([pa.array([], pa.string())] * 4 + [pa.array([], pa.int64())], names=names)
    groups = groups.sort_by("source")
    sources = groups["source"].combine_chunks()
    kept, lang_total = groups["kept"][0].as_py(), groups["lang_total"][0].as_py()
    total = groups["total"].to_numpy() + kept
    row = pc.index_in(entries["source"].combine_chunks(), value_set=sources).to_numpy(zero_copy_only=False)
    order = np.argsort(row, kind="stable")
    words = entries["term"].combine_chunks().dictionary_encode()
    row, term = row[order], words.indices.to_numpy(zero_copy_only=False).astype(np.int64)[order]
    n, lang_n = entries["n"].to_numpy()[order], entries["lang_n"].to_numpy()[order]
    sums = pair_sums(n, row, term, len(words.dictionary), total)
    g, h = np.nonzero(~np.eye(len(sources), dtype=bool))
    p, q = shares(n + 1, total[row]), shares(lang_n + 1, lang_total + kept)
    over = np.flatnonzero(p > q)
    who, value = row[over], gain(p[over], q[over])
    place_of = np.empty(len(words.dictionary), np.int64)
    place_of[pc.sort_indices(words.dictionary).to_numpy()] = np.arange(len(place_of))
    best = np.lexsort((place_of[term[over]], -value, who))  # by source, then as they are ranked
    keep = best[np.arange(len(best)) - np.searchsorted(who[best], who[best]) < top]
    out = [(g, sources.take(pa.array(h)), sums[g, h], "pair"), (who[keep], words.dictionary.take(pa.array(term[over[keep]])), value[keep], "term")]
    lang = entries["lang"][0].as_py()
    tables = []
    for at, item, worth, part in out:
        tables.append(pa.table([pa.array([lang] * len(at), pa.string()), sources.take(pa.array(at)), pa.array([part] * len(at), pa.string()), item, pa.array(worth, pa.int64())], names=names))
    return pa.concat_tables(tables)


def audit(docs: DataFrame, *, least: int = LEAST_DOCUMENTS, top: int = TOP, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """lang, source, part, item, value, rank: how sources differ from each other, and in which terms from their language.

    Null texts, languages and sources count as empty ones; repeated rows count each;
    an empty table gives no row; other columns are not read.  A language without kept
    terms has value 0 for each pair.  Equal values are ranked by item in UTF-8 order.
    The result has a row for each pair of sources of a language, so a block gets the list
    of its language's sources with it, and gives as many rows as there are pairs.
    """
    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = materialise(term_counts(named), "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    entries = materialise(counts.drop("docs").join(kept, ["lang", "term"]), "kept")
    every = materialise(named.select("lang", "source").distinct(), "sources")
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = entries.groupBy("lang", "term").agg(F.max("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    groups = every.join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "kept", "lang_total")])
    groups = materialise(groups, "groups")
    blocks = max(1, -(-entries.count() // block_entries))
    dealt = entries.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)))
    sent = groups.where("kept > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))

    def run(left, right):
        from tessera.llm.divergence import divergence_of_block

        return divergence_of_block(left, right, top)

    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in ("lang", "source", "part", "item")], T.StructField("value", T.LongType())])
    ship(docs.sparkSession)
    found = dealt.groupBy("lang", "block").cogroup(sent.groupBy("lang", "block")).applyInArrow(run, schema)
    bare = groups.where("kept = 0").select("lang", "source")
    pairs = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    summed = materialise(found.unionByName(pairs).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "summed")
    ranked = lambda part: summed.where(F.col("part") == part).withColumn("rank", F.expr("row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)"))
    return ranked("pair").unionByName(ranked("term").where(F.col("rank") <= top))
