"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame functions only.

A text's paragraphs (lines, and in them sentences) are hashed to digests of 48 bits
that carry a check of 16 bits.  Each digest is XORed into one cell in each of three
tables.  Subtracting the sketches of two versions (XOR) cancels what they share; a
cell whose check holds has one digest left, and peeling such cells recovers the rest.

A sketch for a larger difference has more cells: digests are dealt to blocks of cells
by their bits.  The number of blocks follows an estimate of the difference, taken from
the ``SAMPLE`` smallest digests of both texts.  A block that does not peel is made again
with twice as many blocks, by its digests' next bit, until it peels; once all bits have
been dealt a block holds one digest, so this ends and never leaves a rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TABLES, WIDTH = 3, 4
LOAD = 4
SAMPLE = 8
BLOCK_BIT, CHECK_BIT = 8, 48


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _checked(low: Column) -> Column:
    """48 bits with the check of them on top."""
    return F.shiftleft(F.hash(low).cast("long"), CHECK_BIT).bitwiseOR(low)


def _low(c: Column) -> Column:
    return c.bitwiseAND(_long((1 << CHECK_BIT) - 1))


def paragraphs(text: Column) -> Column:
    """Distinct digests of the paragraphs of a whole text."""
    parts = F.filter(F.split(text, r"\n|(?<=[.!?]) "), lambda p: p != "")
    return F.array_distinct(F.transform(parts, lambda p: _let(_low(F.xxhash64(p)), _checked)))


def _cell(keys: Column, t: int, i: int, start: Column | None = None) -> Column:
    """The XOR of the digests that fall into cell ``i`` of table ``t``."""
    mask, value = _long((WIDTH - 1) << (2 * t)), _long(i << (2 * t))
    return F.aggregate(keys, _long(0) if start is None else start, lambda acc, k: F.when(k.bitwiseAND(mask) == value, acc.bitwiseXOR(k)).otherwise(acc))


def sketch(keys: Column) -> Column:
    """The cells of an array of digests, table after table."""
    return F.array(*[_cell(keys, t, i) for t in range(TABLES) for i in range(WIDTH)])


def subtract(a: Column, b: Column) -> Column:
    """What two sketches of one size differ by."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def without(cells: Column, keys: Column) -> Column:
    """The cells after digests have been taken out of all tables."""
    return F.array(*[_cell(keys, t, i, F.element_at(cells, t * WIDTH + i + 1)) for t in range(TABLES) for i in range(WIDTH)])


def peel(cells: Column, steps: int = 4) -> Column:
    """struct(found, left): the digests that come out, and the cells, of which some are nonzero, that stay.

    A step takes the digests of all pure cells out of all tables; only when every cell of
    every table is zero is nothing left.
    """
    none = F.array().cast("array<long>")
    rest = lambda c: F.when(F.forall(c, lambda x: x == 0), none).otherwise(c)

    def step(state: Column) -> Column:
        pure = F.filter(F.array_distinct(state["left"]), lambda c: (c != 0) & (c == _checked(_low(c))))

        def take(p: Column) -> Column:
            after = _let(without(state["left"], p), rest)
            return F.when(F.size(p) == 0, state).otherwise(F.struct(F.concat(state["found"], p).alias("found"), after.alias("left")))

        return _let(pure, take)

    start = lambda c: F.struct(none.alias("found"), rest(c).alias("left"))
    going = lambda state, _: F.when(F.size(state["left"]) == 0, state).otherwise(step(state))
    return F.aggregate(F.array(*[F.lit(r) for r in range(steps)]), _let(cells, start), going)


def _stuck(state: Column, keys: Column) -> Column:
    """Whether a peel is to be made again: cells stay, or what came out is not, each once, of ``keys``.

    Several digests in one cell can look like one; the check cannot rule that out.
    """
    found = state["found"]
    return (F.size(state["left"]) > 0) | (F.size(F.array_intersect(found, keys)) < F.size(found))


def _halves(blocks: Column, bit: Column) -> Column:
    """Every block's digests dealt to two by a bit; a block without digests is none."""
    mask = F.call_function("shiftleft", _long(1), bit)
    two = lambda q: F.array(F.filter(q, lambda k: k.bitwiseAND(mask) == 0), F.filter(q, lambda k: k.bitwiseAND(mask) != 0))
    return F.filter(F.flatten(F.transform(blocks, two)), lambda q: F.size(q) > 0)


def estimate(a: Column, b: Column) -> Column:
    """About how many digests two arrays differ by, from the smallest ``SAMPLE`` digests of both."""
    least = lambda k: F.slice(F.sort_array(k), 1, SAMPLE)
    n = F.size(a) + F.size(b)

    def of(u: Column) -> Column:
        like = F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.greatest(F.size(u), F.lit(1))
        return F.greatest(F.abs(F.size(a) - F.size(b)).cast("double"), n * (1 - like) / (1 + like))

    return _let(least(F.array_union(least(a), least(b))), of)


def _solve(blocks: Column) -> Column:
    """struct(found, left): digests that came out of the blocks' differences, and the blocks that did not peel.

    A block holds the digests of both texts; XOR is its own inverse, so the sketch of
    both together is the difference of their two sketches.
    """
    each = F.transform(blocks, lambda q: _let(peel(sketch(q)), lambda s: F.struct(s["found"].alias("found"), _stuck(s, q).alias("stuck"), q.alias("q"))))
    return _let(
        each,
        lambda e: F.struct(
            F.flatten(F.transform(F.filter(e, lambda s: ~s["stuck"]), lambda s: s["found"])).alias("found"),
            F.transform(F.filter(e, lambda s: s["stuck"]), lambda s: s["q"]).alias("left"),
        ),
    )


def difference(a: Column, b: Column, small_a: Column, small_b: Column) -> Column:
    """Digests that one of two texts has and the other has not, all of them peeled from subtracted sketches.

    A small estimate takes the sketches of the fingerprints themselves (``small_a``,
    ``small_b``); a larger one takes as many blocks as it asks for.  What is stuck is
    made again with twice the blocks, until it peels.
    """
    both = F.concat(a, b)
    none = F.array().cast("array<long>")
    bits = F.greatest(F.lit(0), F.ceil(F.log2(estimate(a, b) / F.lit(float(LOAD)))).cast("int"))

    def bit(r: Column) -> Column:
        return F.pmod(r + BLOCK_BIT, F.lit(CHECK_BIT)).cast("int")

    def first(n: Column) -> Column:
        dealt = F.aggregate(F.slice(F.sequence(F.lit(0), n), 1, n), F.array(both), lambda blocks, r: _halves(blocks, bit(r)))
        small = _let(peel(subtract(small_a, small_b)), lambda s: F.struct(F.when(_stuck(s, both), none).otherwise(s["found"]).alias("found"), F.when(_stuck(s, both), F.array(both)).otherwise(F.array().cast("array<array<long>>")).alias("left")))
        return F.struct(F.when(n == 0, small).otherwise(_solve(dealt)).alias("s"), n.alias("used"))

    def finish(start: Column) -> Column:
        def again(state: Column, r: Column) -> Column:
            more = _solve(_halves(state["left"], bit(start["used"] + r)))
            return F.when(F.size(state["left"]) == 0, state).otherwise(_let(more, lambda m: F.struct(F.concat(state["found"], m["found"]).alias("found"), m["left"].alias("left"))))

        rounds = F.when(F.size(start["s"]["left"]) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.lit(CHECK_BIT - 1)))
        return F.aggregate(rounds, start["s"], again)["found"]

    return _let(_let(bits, first), finish)


def likeness(a: Column, b: Column, small_a: Column, small_b: Column) -> Column:
    """Shared digests over all digests, 0 to 1; 1 for two empty texts."""
    n = F.size(a) + F.size(b)
    return F.when(n == 0, 1.0).otherwise(_let(F.size(difference(a, b, small_a, small_b)), lambda d: (n - d) / (n + d)))


def written(small: Column, keys: Column) -> Column:
    """A sketch as text: the number of digests, then the cells, in hexadecimal."""
    pad = lambda c, w: F.lpad(F.lower(F.hex(c)), w, "0")
    return F.concat(pad(F.size(keys), 8), F.array_join(F.transform(small, lambda c: pad(c, 16)), ""))


def with_next(docs: DataFrame, carry: tuple[str, ...] = (), rows_per_bucket: int = 1000, most_buckets: int = 4096) -> DataFrame:
    """doc_id, text, ``carry``, and next_text and next_... of each: of the next document in descending order of doc_id; after the last, the first.

    Ids are cut into ranges at percentiles, each range is ordered on its own, and the
    first document of a range also stands at the end of the range before it.  The driver
    holds one id a range.  Ties on the id go by text; a null id comes last.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *carry, F.coalesce("doc_id", F.lit(-(2**63))).alias("__o"))
    n = base.count()
    buckets = max(1, min(most_buckets, n // rows_per_bucket))
    cuts = []
    if buckets > 1:
        got = base.agg(F.percentile_approx("__o", [i / buckets for i in range(1, buckets)], 10_000)).first()[0]
        cuts = sorted(set(got))
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    bucket = F.size(F.filter(bounds, lambda b: b <= F.col("__o")))
    heads = sorted(base.groupBy(bucket.alias("b")).agg(F.max("__o").alias("id")).collect())
    sends = {heads[i][1]: heads[(i + 1) % len(heads)][0] for i in range(len(heads))} if heads else {}
    target = F.create_map(*[F.lit(x).cast("long" if k % 2 == 0 else "int") for pair in sends.items() for k, x in enumerate(pair)]) if sends else F.create_map().cast("map<long,int>")
    own = F.struct(bucket.alias("b"), F.lit(0).alias("after"))
    placed = base.withColumn("__sent", F.try_element_at(target, F.col("__o")))
    placed = placed.select("doc_id", "text", *carry, "__o", F.inline(F.when(F.col("__sent").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("__sent").alias("b"), F.lit(1).alias("after"))))))
    order = Window.partitionBy("b").orderBy("after", F.desc("__o"), F.desc("text"))
    taken = ["text", *carry]
    return placed.select("doc_id", *taken, "after", *[F.lead(c).over(order).alias(f"next_{c}") for c in taken]).where("after = 0").drop("after")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and likenesses.

    The edited text has its last third (floor of the code points over 3) replaced by as
    many code points of the next document (:func:`with_next`).  A null text counts as
    empty; repeated rows stay; an empty table gives none; other columns are not read.
    """
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), paragraphs(F.coalesce("text", F.lit(""))).alias("a"))
    both = with_next(keyed.withColumn("sa", sketch(F.col("a"))), ("a", "sa"))
    edited = both.select("doc_id", n.cast("long").alias("n_chars"), F.concat(F.substr("text", F.lit(1), n - cut), F.substr("next_text", F.lit(1), cut)).alias("edited"), "a", "sa", "next_a", "next_sa")
    edited = edited.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), paragraphs(F.col("edited")).alias("b"), "a", "sa", "next_a", "next_sa").withColumn("sb", sketch(F.col("b")))
    a, b, sa, sb, c, sc = (F.col(x) for x in ("a", "b", "sa", "sb", "next_a", "next_sa"))
    return edited.select("doc_id", "n_chars", "edited_sha256", written(sa, a).alias("fingerprint"), written(sb, b).alias("edited_fingerprint"), likeness(a, b, sa, sb).alias("near_edited"), likeness(a, c, sa, sc).alias("near_next"))
