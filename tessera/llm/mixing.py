"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Source weights are the token shares raised to an exponent.  The exponent is bisected:
the largest one whose weights reach a target entropy, or the smallest one that keeps
every source within a number of passes over its data.  Each source's weight becomes a
token budget.  Documents fall into blocks of bounded size by a hash; each pass takes
the blocks in its own keyed order, whole passes first, then blocks of the last pass
until the budget is used; the block at the edge gives its documents in keyed order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, text_or_empty


#: Signs of scripts without spaces count one each; other letters and digits in runs of at most 16.
_TOKEN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]|[\p{L}\p{M}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]]{1,16}+|[^\s\p{L}\p{M}\p{N}]"


def token_weight(text: str = "text") -> Column:
    """Tokens of a text for budgets, at least 1: runs of up to 16 letters and digits, signs of unspaced scripts, and other signs."""
    return F.greatest(F.regexp_count(text_or_empty(text), F.lit(_TOKEN)), F.lit(1)).cast("long")


def exponents(sources: DataFrame, budget: int, *, entropy: float | None, repeats: float | None, steps: int = 5, grid: int = 16, most: float = 8.0) -> float:
    """The exponent from 0 to ``most``, by bisection in ``steps`` jobs of ``grid`` points each over the source table.

    ``entropy`` (a share of the largest possible, 0 to 1) asks for weights at least so
    even: entropy falls as the exponent grows from 0 (even) over 1 (as is), so the largest
    exponent that meets it is taken; above 1 it sharpens the natural shares.  ``repeats``
    limits the passes over any source: up to 1 they fall as the exponent grows, beyond 1
    they grow again, so the nearest exponent on the same side that keeps within it is
    taken, and it wins over the entropy where both cannot be had.
    """
    total = sources.agg(F.sum("tokens"), F.count("*")).first()
    if not total[0] or total[1] < 2:
        return 1.0
    all_tokens, n = int(total[0]), int(total[1])

    def measure(alphas: list[float]) -> list[tuple[float, float]]:
        share = F.col("tokens") / all_tokens
        z = sources.agg(*[F.sum(F.pow(share, a)) for a in alphas], *[F.sum(F.pow(share, a) * F.ln(F.pow(share, a))) for a in alphas], *[F.max(F.pow(share, a) / F.col("tokens")) for a in alphas]).first()
        k = len(alphas)
        return [(math.log(z[i]) - z[k + i] / z[i], budget * z[2 * k + i] / z[i]) for i in range(k)]

    def bisect(good, low: float, high: float, want_high: bool) -> float:
        """The last (``want_high``) or first exponent for which ``good`` holds, ``good`` being monotone."""
        for _ in range(steps):
            points = [low + (high - low) * i / grid for i in range(grid + 1)]
            held = [good(m) for m in measure(points)]
            if want_high:
                i = max((i for i, h in enumerate(held) if h), default=0)
                low, high = points[i], points[min(i + 1, grid)]
            else:
                i = min((i for i, h in enumerate(held) if h), default=grid)
                low, high = points[max(i - 1, 0)], points[i]
        return low if want_high else high

    alpha = 1.0
    if entropy is not None:
        alpha = bisect(lambda m: m[0] >= entropy * math.log(n) - 1e-9, 0.0, most, True)
    if repeats is not None:
        within = lambda m: m[1] <= repeats + 1e-9
        alpha = bisect(within, 1.0, alpha, True) if alpha > 1 else max(alpha, bisect(within, 0.0, 1.0, False))
    return alpha


def mix(docs: DataFrame, *, entropy: float | None = 0.97, repeats: float | None = 4.0, budget: int | None = None, block_tokens: int = 100_000, seed: int = 7, tokens: str | None = None) -> DataFrame:
    """Rows of ``docs``, each as often as the mixture takes it.

    Adds ``pass`` (0, 1, ...), ``block`` and ``place``: order by pass, block, place
    within a source.  Columns of ``docs`` with these names are replaced.  ``budget``
    is in tokens, by default as many as ``docs`` holds; ``tokens`` names a column of
    counts (of the token counter, say) to use instead of :func:`token_weight`.  A null
    source is a source of its own; null and empty texts weigh one token; repeated rows count each
    and go together; a budget edge takes documents until it is reached, so a source
    gets its budget to within one document (and its rows tied by id and text).  An
    empty table gives none.
    """
    base = docs.drop("pass", "block", "place")
    source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    key = _positive(F.xxhash64(F.lit(seed), "doc_id", F.length("text")))
    weight = F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(1)), F.lit(1)) if tokens else token_weight()
    slim = materialise(base.select(source.alias("s"), weight.alias("t"), key.alias("h")), "mix")
    sources = materialise(slim.groupBy("s").agg(F.sum("t").alias("tokens")), "sources")
    plan = materialise(passes(slim, sources, entropy=entropy, repeats=repeats, budget=budget, block_tokens=block_tokens, seed=seed), "plan")
    plan = plan.select(*[F.col(c).alias(f"__{c}") for c in plan.columns])  # clashes with no column of the documents
    joined = base.withColumn("__source", source).withColumn("__h", key).join(plan, F.col("__source") == F.col("__s"))
    block = F.pmod("__h", "__n_blocks")
    turn, place = _order("__s", block, "__full", seed), _place("__h", seed)
    more = (turn < F.col("__edge_turn")) | ((turn == F.col("__edge_turn")) & (place <= F.col("__edge_place")))
    out = joined.withColumn("__n", F.col("__full") + F.when(more, 1).otherwise(0)).where("__n > 0")
    out = out.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return out.select(*base.columns, "pass", _order("__s", block, "pass", seed).alias("block"), place.alias("place"))


def _positive(c: Column) -> Column:
    return F.shiftrightunsigned(c, 1)


def _order(source: str, block: Column | str, turn: str, seed: int) -> Column:
    """The key that a pass sorts a source's blocks by."""
    return _positive(F.xxhash64(F.lit(seed + 1), F.col(source), F.col(block) if isinstance(block, str) else block, F.col(turn)))


def _place(h: str, seed: int) -> Column:
    """The key that a block's documents are sorted by."""
    return _positive(F.xxhash64(F.lit(seed + 2), F.col(h)))


def passes(slim: DataFrame, sources: DataFrame, *, entropy: float | None, repeats: float | None, budget: int | None, block_tokens: int, seed: int) -> DataFrame:
    """Per source: whole passes, number of blocks, and how far its last pass goes (turn of a block, place in it).

    Running sums go in two levels (groups of blocks, then blocks of one group), and only
    the one block at each source's edge is ordered by document, so no task holds a source.
    """
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    share = F.col("tokens") / F.lit(max(total, 1))
    alpha = exponents(sources, budget, entropy=entropy, repeats=repeats)
    norm = sources.agg(F.sum(F.pow(share, F.lit(alpha)))).first()[0] or 1.0
    want = F.round(F.pow(share, F.lit(alpha)) / norm * budget).cast("long")
    plan = sources.withColumn("want", want).select("s", F.floor(F.col("want") / F.col("tokens")).cast("int").alias("full"), (F.col("want") % F.col("tokens")).alias("left"), F.ceil(F.col("tokens") / block_tokens).cast("long").alias("n_blocks"))
    placed = slim.join(plan, "s").withColumn("block", F.pmod("h", "n_blocks")).withColumn("turn", _order("s", "block", "full", seed))
    blocks = placed.groupBy("s", "turn", "left").agg(F.sum("t").alias("size")).withColumn("group", F.shiftright("turn", 53))
    groups = blocks.groupBy("s", "group").agg(F.sum("size").alias("size"))
    groups = groups.select("s", "group", (F.sum("size").over(Window.partitionBy("s").orderBy("group")) - F.col("size")).alias("before"))
    inner = F.sum("size").over(Window.partitionBy("s", "group").orderBy("turn")) - F.col("size")
    room = (F.col("left") - F.col("before") - F.col("inner")).alias("room")
    edge = blocks.withColumn("inner", inner).join(groups, ["s", "group"]).select("s", "turn", "size", room).where((F.col("room") > 0) & (F.col("room") <= F.col("size")))
    docs = placed.join(edge.select("s", "turn", "room"), ["s", "turn"]).withColumn("place", _place("h", seed))
    upto = F.sum("t").over(Window.partitionBy("s").orderBy("place"))  # rows tied on the place go together
    reach = docs.withColumn("first", upto - F.sum("t").over(Window.partitionBy("s", "place"))).where(F.col("first") < F.col("room"))
    reach = reach.groupBy("s").agg(F.max("turn").alias("edge_turn"), F.max("place").alias("edge_place"))
    return plan.join(reach, "s", "left").select("s", "full", "n_blocks", F.coalesce("edge_turn", F.lit(-1)).alias("edge_turn"), F.coalesce("edge_place", F.lit(-1)).alias("edge_place"))
