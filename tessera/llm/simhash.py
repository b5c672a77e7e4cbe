"""SimHash near-duplicates: fingerprints, BK-trees over sharded fingerprints, components.

:func:`near_duplicates` stops there; :func:`keep_one` takes the same components as
candidates that an exact comparison follows, and adds MinHash for texts that are alike
although their fingerprints are not.

Fingerprints within ``radius`` differing bits share all bits of some choice of
bands (pigeonhole), so a shard is one choice of bands and their value, and every
linked pair meets in a shard.  In a shard a BK-tree holds the fingerprints met so far,
and each new one searches it, following only edges within the radius.  A shard that is larger than
``shard_limit`` is cut once more, by bands of its remaining bits; what then shares a
shard agrees in at least 48 of 64 bits, which bounds a tree by 65,536 nodes.  Trees
stay on the executor that holds the shard: nothing of the corpus reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialise, pieces, ship

BANDS = 4


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """64 majority bits over the hashes of a text's shingles, repeats included.

    A-Z become lower case; words part at ASCII white space.  Fewer than ``words``
    words make one shingle of all of them; none make fingerprint 0.
    """
    w = text.encode().lower().split()
    if not w:
        return 0
    if len(w) < words:
        w = [b" ".join(w)]
        shingles = w
    else:
        shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, seed) for s in shingles], np.uint64)
    return int.from_bytes(majority(h.astype(">u8").view(np.uint8).reshape(-1, 8)), "big")


def majority(rows: np.ndarray) -> bytes:
    """The bits that are set in over half of the rows of bytes."""
    ones = np.zeros(rows.shape[1] * 8, np.int64)
    for i in range(0, len(rows), 255):  # so many fit a byte's sum
        ones += np.add.reduce(np.unpackbits(rows[i : i + 255], axis=1), axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(rows)).tobytes()


class BkTree:
    """Children keyed by their distance to the parent; nodes in flat lists."""

    def __init__(self) -> None:
        self.value: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """The node of ``value``, which is new to the tree."""
        new = len(self.value)
        self.value.append(value)
        self.children.append({})
        at = 0
        while new:
            d = (self.value[at] ^ value).bit_count()
            if d not in self.children[at]:
                self.children[at][d] = new
                break
            at = self.children[at][d]
        return new

    def near(self, value: int, radius: int) -> list[int]:
        """Nodes within ``radius``; follows only edges that can lead to one."""
        found, todo = [], [0] if self.value else []
        values, children = self.value, self.children
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            if kids := children[at]:
                if len(kids) <= 2 * radius + 1:
                    todo += [k for e, k in kids.items() if -radius <= e - d <= radius]
                else:
                    todo += [kids[e] for e in range(max(0, d - radius), d + radius + 1) if e in kids]
        return found


def links_in_shard(members: list[tuple[int, int]], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among (fingerprint, node): at most one row a member.

    Each member searches the BK-tree of those before it, then joins it.
    """
    parent, out, tree = list(range(len(members))), [], BkTree()

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, (value, node) in enumerate(members):
        for j in tree.near(value, radius):
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                out.append((node, members[j][1]))
        tree.add(value)
    return out


def band_keys(bits: Column, start: int, width: int, radius: int) -> Column:
    """Array of (choice, key): every choice of ``BANDS - radius`` of the bands of ``width`` bits from ``start``."""
    band = [F.shiftrightunsigned(bits, start + i * width).bitwiseAND((1 << width) - 1) for i in range(BANDS)]
    made = []
    for n, chosen in enumerate(combinations(range(BANDS), BANDS - radius)):
        key = F.lit(0).cast("long")
        for i in chosen:
            key = F.shiftleft(key, width).bitwiseOR(band[i])
        made.append(F.struct(F.lit(n).alias("choice"), key.alias("key")))
    return F.array(*made)


def _rest(bits: Column, choice: Column, width: int, radius: int) -> Column:
    """The bits of the bands that ``choice`` leaves out, side by side."""
    out = F.lit(None).cast("long")
    for n, chosen in enumerate(combinations(range(BANDS), BANDS - radius)):
        left = F.lit(0).cast("long")
        for i in (i for i in range(BANDS) if i not in chosen):
            left = F.shiftleft(left, width).bitwiseOR(F.shiftrightunsigned(bits, i * width).bitwiseAND((1 << width) - 1))
        out = F.when(choice == n, left).otherwise(out)
    return out


def _search(shards: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Links within each shard; rows of a shard stand together, a shard at a time is held."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.simhash import links_in_shard

        def made(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["src", "dst"])

        at, members, out = None, [], []
        for b in batches:
            for *key, value, node in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != at:
                    out += links_in_shard(members, radius)
                    at, members = key, []
                    if len(out) > 50_000:
                        yield made(out)
                        out = []
                members.append((int.from_bytes(value, "big") if isinstance(value, bytes) else value & (2**64 - 1), node))
        yield made(out + links_in_shard(members, radius))

    return shards.select(*keys, "bits", "node").mapInArrow(run, "src long, dst long")


def links(nodes: DataFrame, radius: int = 2, shard_limit: int = 20_000) -> DataFrame:
    """(src, dst) between ``node`` values whose distinct ``bits`` are linked; spanning forests, no link between parts is lost."""
    if not 0 <= radius < BANDS:
        raise ValueError(f"radius must be 0 to {BANDS - 1}")
    ship(nodes.sparkSession)
    width = 64 // BANDS
    spread = nodes.select("bits", "node", F.inline(band_keys(F.col("bits"), 0, width, radius)))
    sized = spread.withColumn("n", F.count("*").over(Window.partitionBy("choice", "key")))
    plain = sized.where((F.col("n") > 1) & (F.col("n") <= shard_limit))
    found = _search(plain, ["choice", "key"], radius)
    large = spread.groupBy("choice", "key").agg(F.count("*").alias("n")).where(F.col("n") > shard_limit)
    if not large.isEmpty() and radius:
        sub = width * radius // BANDS
        inner = spread.join(large.select("choice", "key"), ["choice", "key"], "left_semi").withColumn("rest", _rest(F.col("bits"), F.col("choice"), width, radius))
        inner = inner.select("choice", "key", "bits", "node", F.inline(F.transform(band_keys(F.col("rest"), 0, sub, radius), lambda s: F.struct(s["choice"].alias("choice2"), s["key"].alias("key2")))))
        window = Window.partitionBy("choice", "key", "choice2", "key2")
        inner = inner.withColumn("n", F.count("*").over(window)).where("n > 1")
        found = found.union(_search(inner, ["choice", "key", "choice2", "key2"], radius))
    return found


def _with_least(both: DataFrame, heavy: DataFrame, light: DataFrame) -> DataFrame:
    """Rows (hi, lo) of ``both`` with ``m`` of their ``hi``: heavy nodes by a broadcast of bounded size, the others by a join."""
    heavy = F.broadcast(heavy)
    return both.join(heavy, "hi").unionByName(both.join(heavy, "hi", "left_anti").join(light, "hi"))


def components(edges: DataFrame, most_heavy: int = 1000) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    Alternating star contraction; each round is written to the shared folder.  It ends
    when every edge points at its component's smallest node, in a number of rounds
    that grows with the logarithm of the longest chain.  A node with more than a
    ``most_heavy``-th of all rows is never the key of a shuffle: at most ``most_heavy``
    nodes have so many, and what they join to is broadcast; sums over them are taken
    before the shuffle.
    """

    def least(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
        found = materialise(rows.groupBy("hi").agg(F.least("hi", F.min("lo")).alias("m"), F.count("*").alias("n")), "least")
        return tuple(found.where(test).select("hi", "m") for test in (F.col("n") > n // most_heavy, F.col("n") <= n // most_heavy))

    def state(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())

    edges = materialise(edges.select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).where("hi <> lo").distinct(), "edges")
    was = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        large = _with_least(both, *least(both, 2 * was[0])).where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        large = materialise(large.where("hi <> lo").distinct(), "edges")
        small = _with_least(large, *least(large, large.count()))
        small = small.select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"))
        edges = materialise(small.where("hi <> lo").distinct(), "edges")
        now = state(edges)
        if now == was:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        was = now


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``bits``, the signed 64-bit fingerprint of the whole text (null: empty)."""
    import pyarrow as pa

    ship(docs.sparkSession)
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.simhash import fingerprint

        for b in batches:
            bits = np.array([fingerprint(v.as_py() or "", words) for v in b.column(len(names))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(bits, pa.int64())], names=[*names, "bits"])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("bits", T.LongType())])
    return docs.select(*names, docs[text].alias("__text")).mapInArrow(run, schema)


def print_components(prints: DataFrame, radius: int, shard_limit: int) -> DataFrame:
    """(bits, component) of each distinct fingerprint of (bits, node): the smallest node that links of ``radius`` bits reach."""
    classes = materialise(prints.groupBy("bits").agg(F.min("node").alias("node")), "classes")
    parts = components(links(classes, radius, shard_limit))
    return classes.join(parts, "node", "left").select("bits", F.coalesce("component", "node").alias("component"))


def near_duplicates(docs: DataFrame, *, radius: int = 2, words: int = 3, shard_limit: int = 20_000) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint 0 and link like any other.  Repeated rows
    stay, with equal results.  A null doc_id gets the component of its fingerprint,
    and is never a component's name unless no other id is there (then null).  An
    empty table gives none.  Other columns of ``docs`` are not read.
    """
    prints = materialise(fingerprints(docs, words=words), "prints")
    named = print_components(prints.where("doc_id IS NOT NULL").select("bits", F.col("doc_id").alias("node")), radius, shard_limit)
    joined = prints.join(named.select(F.col("bits").alias("b"), F.col("component").alias("component_id")), F.col("bits") == F.col("b"), "left")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


class Shingles:
    """Distinct word shingles of texts as sorted 64-bit hashes, and MinHash keys of them."""

    def __init__(self, words: int = 5, tables: int = 32, rows: int = 6) -> None:
        self.words, self.tables, self.rows = words, tables, rows
        self.known: dict[bytes, int] = {}
        self.hashes = np.zeros(1 << 12, np.uint64)
        seeds = [xxhash.xxh32_intdigest(str(i), 11) | 1 for i in range(tables * rows)]
        self.lanes = np.array(seeds, np.uint32)[:, None]

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """A number for each table: its place and ``rows`` least hashes, mixed."""
        least = np.full(len(self.lanes), 2**32 - 1, np.uint32)
        h = (shingles >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(h), 512):
            x = self.lanes * h[i : i + 512]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x85EBCA6B)
            np.minimum(least, x.min(axis=1), out=least)
        out = np.arange(1, self.tables + 1, dtype=np.uint64)
        for row in least.reshape(self.tables, self.rows).T:
            out = (out ^ row) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)

    def __call__(self, text: str) -> np.ndarray:
        w = text.encode().lower().split()
        if not w:
            return np.zeros(0, np.uint64)
        if len(self.known) > 200_000:
            self.known.clear()
        known = self.known
        fresh = set(w).difference(known)
        if len(known) + len(fresh) > len(self.hashes):
            grown = np.zeros(2 * (len(known) + len(fresh)), np.uint64)
            grown[: len(known)] = self.hashes[: len(known)]
            self.hashes = grown
        for x in fresh:
            self.hashes[len(known)] = xxhash.xxh64_intdigest(x, 5)
            known[x] = len(known)
        h = self.hashes[list(map(known.__getitem__, w))]
        size = min(self.words, len(h))
        shingles = np.full(len(h) - size + 1, size, np.uint64)
        for i in range(size):
            shingles = (shingles ^ h[i : i + len(shingles)]) * np.uint64(0x9E3779B97F4A7C15)
            shingles ^= shingles >> np.uint64(32)
        return np.unique(shingles)


def shingle_print(shingles: np.ndarray) -> int:
    """The SimHash fingerprint of distinct shingle hashes, signed; none have fingerprint 0."""
    return int.from_bytes(majority(shingles.astype(">u8").view(np.uint8).reshape(-1, 8)), "big", signed=True) if len(shingles) else 0


def shingle_prints(docs: DataFrame, words: int, tables: int, rows: int) -> DataFrame:
    """doc_id, ``digest`` (of the shingles), ``n`` shingles, ``bits`` (their fingerprint) and ``keys`` (``tables`` numbers) of each whole text."""
    import pyarrow as pa

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.simhash import Shingles, shingle_print

        made = Shingles(words, tables, rows)
        for b in pieces(batches):
            found = []
            for v in b.column(1):
                s = made(v.as_py() or "")
                found.append((xxhash.xxh3_128_digest(s), len(s), shingle_print(s), made.keys(s)))
            digests, sizes, bits, keys = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bits, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "digest", "n", "bits", "keys"])

    fields = [("digest", T.BinaryType()), ("n", T.LongType()), ("bits", T.LongType()), ("keys", T.ArrayType(T.LongType()))]
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, t) for c, t in fields]])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def with_shingles(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """``members`` (node, digest, ...) with ``shingles`` (8 bytes each), made again from the text of the document ``node``.

    They weigh more than the texts, so they are made for the classes that are compared
    alone, and nothing of them is kept in between.  A repeated id may have other texts,
    which are left out, and gives a member more than once if it repeats the text.
    """
    import pyarrow as pa

    names, digest = members.columns, members.columns.index("digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.simhash import Shingles

        made = Shingles(words)
        for b in pieces(batches):
            got = [made(v.as_py() or "") for v in b.column(len(names))]
            own = pa.array([xxhash.xxh3_128_digest(s) == d for s, d in zip(got, b.column(digest).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array([s.tobytes() for s in got], pa.binary())], names=[*names, "shingles"]).filter(own)

    schema = T.StructType([*members.schema.fields, T.StructField("shingles", T.BinaryType())])
    texts = docs.select(F.col("doc_id").alias("node"), F.col("text").alias("__text"))
    return members.join(texts, "node").select(*names, "__text").mapInArrow(run, schema)


def links_by_jaccard(members: list[tuple[list[int], np.ndarray, int, int | None]], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links among (keys, shingles, node, part): a key in common, and exact Jaccard ``similarity`` or more.

    Members that are already in one part, or come with the same ``part``, are not
    compared; a pair that has failed is not tried again.
    """
    first: dict[int, int] = {}
    parent = [i if m[3] is None else first.setdefault(m[3], i) for i, m in enumerate(members)]
    out, failed = [], set()

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def alike(i: int, j: int) -> bool:
        pair = (i, j) if i < j else (j, i)
        if pair in failed:
            return False
        a, b = members[i][1], members[j][1]
        few, many = sorted((len(a), len(b)))
        if many and few / many >= similarity:
            both = len(np.intersect1d(a, b, assume_unique=True))
            if both / (few + many - both) >= similarity:
                return True
        if len(failed) > 500_000:
            failed.clear()
        failed.add(pair)
        return False

    def meet(p: list[int], q: list[int]) -> bool:
        for i in p:
            for j in q:
                if alike(i, j):
                    parent[root(i)] = root(j)
                    out.append((members[i][2], members[j][2]))
                    return True
        return False

    holders: dict[int, list[int]] = {}
    for i, (keys, *_) in enumerate(members):
        for k in keys:
            holders.setdefault(k, []).append(i)
    for held in holders.values():
        groups: dict[int, list[int]] = {}
        for i in held:
            groups.setdefault(root(i), []).append(i)
        parts: list[list[int]] = []
        for group in groups.values():
            apart = []
            for p in parts:
                if meet(p, group):
                    group = p + group
                else:
                    apart.append(p)
            parts = [*apart, group]
    return out


def _verify(shards: DataFrame, keys: list[str], similarity: float) -> DataFrame:
    """Links within each shard by :func:`links_by_jaccard`; rows of a shard stand together, a shard at a time is held."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.simhash import links_by_jaccard

        def made(members: list) -> pa.RecordBatch:
            links = links_by_jaccard(members, similarity)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["src", "dst"])

        at, members, seen = None, [], set()
        for b in pieces(batches):
            for *key, node, shared, part, shingles in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != at:
                    if len(members) > 1:
                        yield made(members)
                    at, members, seen = key, [], set()
                if (node, shingles) not in seen:  # rows that repeat an id and its text
                    seen.add((node, shingles))
                    members.append((shared, np.frombuffer(shingles, np.uint64), node, part))
        yield made(members)

    together = shards.select(*keys, "node", "keys", "part", "shingles").repartition(*keys).sortWithinPartitions(*keys)
    return together.mapInArrow(run, "src long, dst long")


def with_totals(rows: DataFrame, by: str, *totals: Column, most_heavy: int = 1000) -> DataFrame:
    """``rows`` (a written table) with ``totals`` of their group in ``by``.

    Sums are taken before the shuffle; a group with more than a ``most_heavy``-th of all
    rows is no key of a shuffle: there are fewer than ``most_heavy`` such, and their
    totals are broadcast.
    """
    found = materialise(rows.groupBy(by).agg(*totals, F.count("*").alias("__rows")), "totals")
    least = (found.agg(F.sum("__rows")).first()[0] or 0) // most_heavy
    heavy = F.broadcast(found.where(F.col("__rows") > least).drop("__rows"))
    light = found.where(F.col("__rows") <= least).drop("__rows")
    return rows.join(heavy, by).unionByName(rows.join(heavy, by, "left_anti").join(light, by))


def jaccard_links(classes: DataFrame, docs: DataFrame, words: int, similarity: float, shard_limit: int, shingle_limit: int) -> DataFrame:
    """(src, dst): spanning forests of the verified links among classes (node, digest, n, keys) that share a key.

    Classes that hang together by keys are one group, and only groups get their shingles.
    A group of at most ``shard_limit`` classes and ``shingle_limit`` shingles is a shard.
    A larger one falls apart into the buckets of its keys, and a bucket that is larger
    still into bands of lengths, since similar texts are of similar lengths; so a class
    is copied at most twice a key, however large its group.  See :func:`_large_buckets`
    for what is still too large.
    """
    dealt = materialise(classes.select("node", F.explode("keys").alias("key")), "dealt")
    met = materialise(with_totals(dealt, "key", F.min("node").alias("least"), F.count("*").alias("__n")).where("__n > 1").select("node", "key", "least"), "met")
    hung = components(met.where("node <> least").select(F.col("node").alias("src"), F.col("least").alias("dst")))
    hung = hung.unionByName(hung.select(F.col("component").alias("node"), "component").distinct())
    members = materialise(classes.join(hung, "node"), "members")
    members = materialise(with_totals(members, "component", F.count("*").alias("__n"), F.sum("n").alias("__s")), "members")
    nothing = F.lit(None).cast("long").alias("part")
    fits = (F.col("__n") <= shard_limit) & (F.col("__s") <= shingle_limit)
    found = _verify(with_shingles(docs, members.where(fits).select("node", "digest", "keys", "component", nothing), words), ["component"], similarity)
    large = members.where(~fits).select("node", "digest", "n")
    if large.isEmpty():
        return found
    found = materialise(found, "links")
    held = materialise(with_shingles(docs, large.select("node", "digest"), words).dropDuplicates(["digest"]).select("digest", "shingles"), "held")
    shared = F.array(F.lit(0).cast("long")).alias("keys")
    buckets = materialise(met.select("node", "key").join(large, "node"), "buckets")
    sized = materialise(with_totals(buckets, "key", F.count("*").alias("__n"), F.sum("n").alias("__s")), "buckets")
    found = found.unionByName(materialise(_verify(sized.where(fits).select("node", "digest", shared, "key", nothing).join(held, "digest"), ["key"], similarity), "links"))
    over = sized.where(~fits)
    if over.isEmpty():
        return found
    band = F.floor(F.log(F.greatest("n", F.lit(1))) / float(-np.log(similarity))).cast("long")
    banded = over.select("node", "digest", "n", F.explode(F.array(F.xxhash64("key", band), F.xxhash64("key", band + 1))).alias("key"))
    return _large_buckets(materialise(banded.distinct(), "bands"), held, found, similarity, shard_limit, shingle_limit)


def _large_buckets(rows: DataFrame, held: DataFrame, found: DataFrame, similarity: float, shard_limit: int, shingle_limit: int) -> DataFrame:
    """``found`` and the links within buckets (node, digest, n, key) of any size.

    A bucket is cut into pieces, each with the bucket's smallest node as pivot.  In a
    bucket of copies every piece hangs on the pivot then, and nothing is left to do.
    Only members outside the pivot's component are compared with all other pieces:
    that many rows more, none where all hang together.  No link is lost, for two
    members of one component need none.
    """
    shared = F.array(F.lit(0).cast("long")).alias("keys")
    sized = materialise(with_totals(rows, "key", F.count("*").alias("__n"), F.sum("n").alias("__s"), F.min("node").alias("pivot")).where("__n > 1"), "sized")
    cut = F.least(F.col("__n"), F.greatest(F.ceil(F.col("__n") / shard_limit), F.ceil(F.col("__s") / shingle_limit), F.lit(1))).cast("int")
    sized = sized.withColumn("cuts", cut).withColumn("piece", F.pmod(F.xxhash64("digest"), "cuts").cast("int"))
    own = F.when(F.col("node") == F.col("pivot"), F.sequence(F.lit(0), F.col("cuts") - 1)).otherwise(F.array("piece"))
    pieces_of = sized.select("node", "digest", shared, "key", F.lit(None).cast("long").alias("part"), F.explode(own).alias("piece"))
    found = found.unionByName(materialise(_verify(pieces_of.join(held, "digest"), ["key", "piece"], similarity), "links"))
    parts = materialise(components(found), "parts")
    named = parts.unionByName(parts.select(F.col("component").alias("node"), "component").distinct())
    joined = materialise(sized.join(named, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component"), "joined")
    pivot_part = with_totals(joined, "key", F.max(F.when(F.col("node") == F.col("pivot"), F.col("part"))).alias("pivot_part"))
    apart = materialise(pivot_part.withColumn("apart", (F.col("part") != F.col("pivot_part")).cast("int")), "apart")
    left = with_totals(apart, "key", F.sum("apart").alias("__u"), F.sum(F.col("apart") * F.col("n")).alias("__us")).where("__u > 0")
    if left.isEmpty():
        return found
    strays = F.least(F.col("__u"), F.greatest(F.ceil(F.col("__u") / shard_limit), F.ceil(F.col("__us") / shingle_limit), F.lit(1))).cast("int")
    left = left.withColumn("strays", strays).withColumn("stray", F.pmod(F.xxhash64("digest", F.lit(1)), "strays").cast("int"))
    beside = F.transform(F.sequence(F.lit(0), F.col("strays") - 1), lambda i: F.struct(i.alias("i"), F.col("piece").alias("j")))
    across = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: F.struct(F.col("stray").alias("i"), j.alias("j")))
    both = F.when(F.col("apart") == 1, F.array_union(beside, across)).otherwise(beside)
    shards = left.select("node", "digest", shared, "key", "part", F.inline(both))
    return found.unionByName(_verify(shards.join(held, "digest"), ["key", "i", "j"], similarity))


def keep_one(docs: DataFrame, *, similarity: float = 0.8, words: int = 5, radius: int = 2, tables: int = 32, rows: int = 6, shard_limit: int = 1000, shingle_limit: int = 1_000_000) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, that with the smallest doc_id; same columns.

    Two texts are linked when the Jaccard similarity of their distinct ``words``-word
    shingles (64-bit hashes) is ``similarity`` or more, worked out exactly for all
    candidates.  Candidates are first the texts of one component of SimHash
    fingerprints within ``radius`` bits (:func:`print_components`: BK-trees over shards,
    star contraction).  Texts that are alike but differ in more bits meet by one of
    ``tables`` MinHash keys of ``rows`` shingles: a pair at Jaccard J shares one with a
    chance of 1 - (1 - J**rows)**tables, whatever the edit: 0.9999 at 0.8.  What the
    fingerprints have joined is not compared by these again.
    Null and empty texts are equal to each other; a text of fewer words is one shingle.
    Rows that repeat an id stay or go together; rows without an id stay.  An empty table
    gives none.
    """
    named = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    prints = materialise(shingle_prints(named, words, tables, rows), "prints")
    classes = materialise(prints.groupBy("digest").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("n", "bits", "keys")]), "classes")
    alike = print_components(classes.select("bits", "node"), radius, 20_000)
    keyed = classes.join(alike, "bits").select("node", "digest", "n", F.concat(F.array("component"), "keys").alias("keys"))
    parts = components(jaccard_links(materialise(keyed, "keyed"), named, words, similarity, shard_limit, shingle_limit))
    stays = classes.join(parts, "node", "left").where("component IS NULL OR component = node").select(F.col("node").alias("__node")).distinct()
    return docs.join(stays, docs["doc_id"] == stays["__node"], "left").where(docs["doc_id"].isNull() | F.col("__node").isNotNull()).select(*[docs[c] for c in docs.columns])
