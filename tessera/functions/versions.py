"""Version ordering as Catalyst expressions: semantic versions, dotted numbers, ranges.

A semantic version becomes a struct whose natural order is its precedence, so sorting,
comparing and taking the least or greatest are the engine's own operations.  What
cannot be parsed is NULL, and stays NULL in every comparison.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEMVER = r"^(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"


def trim_all(c: Column) -> Column:
    """Trim every kind of white space, not only spaces."""
    return F.regexp_replace(c, r"^[\s ﻿]+|[\s ﻿]+$", "")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def semver_key(version: Column) -> Column:
    """Sortable struct of a semantic version (a leading v is allowed); NULL if it is none."""
    numeric = lambda t: t.rlike(r"^(0|[1-9]\d*)$")
    identifier = lambda t: F.struct(F.when(numeric(t), 0).otherwise(1).alias("alpha"), F.when(numeric(t), t.try_cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)")).alias("num"), F.when(numeric(t), "").otherwise(t).alias("txt"))

    def key(v: Column) -> Column:
        part = lambda i: F.regexp_extract(v, _SEMVER, i)
        number = lambda i: part(i).try_cast("decimal(38,0)")
        none = F.array().cast("array<struct<alpha:int,num:decimal(38,0),txt:string>>")
        made = lambda pre: F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), F.when(pre == "", 1).otherwise(0).alias("released"), F.when(pre == "", none).otherwise(F.transform(F.split(pre, r"\."), identifier)).alias("pre"))
        return F.when(v.rlike(_SEMVER), _let(part(4), made))

    return _let(F.regexp_replace(trim_all(version), "^v", ""), key)


def semver_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; NULL if either is not a semantic version."""
    order = lambda p: F.when(p["x"].isNull() | p["y"].isNull(), None).when(p["x"] < p["y"], -1).when(p["x"] > p["y"], 1).otherwise(0)
    return _let(F.struct(semver_key(a).alias("x"), semver_key(b).alias("y")), order)


def prepare_range(kind: Column, events: Column) -> Column:
    """struct(usable, marks) of a range of (introduced, fixed, last_affected, limit) events, to be asked many times.

    A range is not usable if it is not SEMVER, has no events, none of them opens it,
    holds an event of another kind, or has a bound that is no semantic version.
    """
    zero = lambda e: F.coalesce(e["introduced"] == "0", F.lit(False))
    bound = lambda e: F.coalesce(e["introduced"], e["fixed"], e["last_affected"])
    marked = F.transform(
        events,
        lambda e: F.struct(
            F.when(zero(e), 0).otherwise(1).alias("after_zero"),
            F.when(~zero(e), semver_key(bound(e))).alias("at"),
            F.when(e["introduced"].isNotNull(), 0).when(e["fixed"].isNotNull(), 1).when(e["last_affected"].isNotNull(), 2).otherwise(3).alias("what"),
        ),
    )

    def ready(marks: Column) -> Column:
        unclear = F.exists(marks, lambda m: (m["what"] == 3) | ((m["after_zero"] == 1) & m["at"].isNull()))
        opened = F.exists(marks, lambda m: m["what"] == 0)
        usable = F.coalesce((kind == "SEMVER") & (F.size(marks) > 0) & ~unclear & opened, F.lit(False))
        return F.struct(usable.alias("usable"), F.array_sort(marks).alias("marks"))

    return _let(marked, ready)


def in_range(key: Column, prepared: Column) -> Column:
    """Is a version (its :func:`semver_key`) inside a prepared range? NULL, not False, where that cannot be said."""

    def walk(state: Column, m: Column) -> Column:
        reached = (m["after_zero"] == 0) | (m["at"] <= key)
        after = F.when(m["what"] == 0, True).when(m["what"] == 1, False).otherwise(state & (key <= m["at"]))
        return F.when(reached, after).otherwise(state)

    return F.when(prepared["usable"] & key.isNotNull(), F.aggregate(prepared["marks"], F.lit(False), walk))


def key_text(key: Column) -> Column:
    """A :func:`semver_key` as a text whose natural order is the same: numbers with their lengths before them."""
    number = lambda n: _let(n.cast("string"), lambda t: F.concat(F.lpad(F.length(t).cast("string"), 2, "0"), t))
    part = lambda p: F.concat(F.lit("\x01"), F.when(p["alpha"] == 0, F.concat(F.lit("0"), number(p["num"]))).otherwise(F.concat(F.lit("1"), p["txt"])))
    released = F.when(key["released"] == 1, "1").otherwise(F.concat(F.lit("0"), F.array_join(F.transform(key["pre"], part), "")))
    return F.when(key.isNotNull(), F.concat(number(key["major"]), number(key["minor"]), number(key["patch"]), released))


_WINDOWS = "array<struct<low:string,high:string,closed:boolean>>"


def windows(prepared: Column) -> Column:
    """The windows of a prepared range as texts: array of (low, high or NULL, closed), NULL for one that is not usable."""
    none = F.array().cast(_WINDOWS)

    def step(state: Column, m: Column) -> Column:
        at = F.when(m["after_zero"] == 0, "").otherwise(key_text(m["at"]))
        shut = F.struct(F.lit(None).cast("string").alias("low"), F.array_append(state["done"], F.struct(state["low"].alias("low"), at.alias("high"), (m["what"] == 2).alias("closed"))).alias("done"))
        opened = F.struct(F.coalesce(state["low"], at).alias("low"), state["done"].alias("done"))
        return F.when(m["what"] == 0, opened).when(state["low"].isNotNull(), shut).otherwise(state)

    start = F.struct(F.lit(None).cast("string").alias("low"), none.alias("done"))
    last = lambda x: F.when(x["low"].isNull(), x["done"]).otherwise(F.array_append(x["done"], F.struct(x["low"].alias("low"), F.lit(None).cast("string").alias("high"), F.lit(False).alias("closed"))))
    return F.when(prepared["usable"], F.aggregate(prepared["marks"], start, step, last))


def merged(found: Column) -> Column:
    """Windows that hold the same texts, in order and none overlapping another."""

    def step(done: Column, w: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        meets = last["high"].isNull() | (w["low"] <= last["high"])
        wider = last["high"].isNotNull() & (w["high"].isNull() | (w["high"] > last["high"]) | ((w["high"] == last["high"]) & w["closed"]))
        both = F.struct(last["low"].alias("low"), F.when(wider, w["high"]).otherwise(last["high"]).alias("high"), F.when(wider, w["closed"]).otherwise(last["closed"]).alias("closed"))
        return F.when((F.size(done) == 0) | ~meets, F.array_append(done, w)).otherwise(F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), both))

    return F.when(F.size(found) < 2, found).otherwise(F.aggregate(F.array_sort(found), F.array().cast(_WINDOWS), step))


def in_windows(text: Column, found: Column) -> Column:
    """Is a version (its :func:`key_text`) in one of the windows?"""
    return F.exists(found, lambda w: (w["low"] <= text) & (w["high"].isNull() | (text < w["high"]) | (w["closed"] & (text == w["high"]))))


def version_text(version: Column) -> Column:
    """:func:`key_text` of a version as it is written; three plain numbers, the usual case, need one look and no parsing."""
    part = {1: F.substring_index(version, ".", 1), 2: F.substring_index(F.substring_index(version, ".", 2), ".", -1), 3: F.substring_index(version, ".", -1)}
    number = lambda i: F.concat(F.when(F.length(part[i]) < 10, F.lit("0")).otherwise(F.lit("")), F.length(part[i]).cast("string"), part[i])
    plain = version.rlike(r"^(?:0|[1-9][0-9]{0,17})\.(?:0|[1-9][0-9]{0,17})\.(?:0|[1-9][0-9]{0,17})\z")
    return F.when(plain, F.concat(number(1), number(2), number(3), F.lit("1"))).otherwise(_let(semver_key(version), key_text))


def affected_in(version: Column, found: Column) -> Column:
    """:func:`affected_by` with the :func:`windows` of a range that were worked out before, NULL for one that is not usable."""
    return _let(version_text(version), lambda t: F.when(t.isNotNull() & found.isNotNull(), in_windows(t, found)))


def affected_by(version: Column, kind: Column, events: Column) -> Column:
    """:func:`in_range` of a version and a range as they are written."""
    return _let(F.struct(semver_key(version).alias("k"), prepare_range(kind, events).alias("r")), lambda p: in_range(p["k"], p["r"]))


def dotted(version: Column) -> Column:
    """array<long> of a dotted version; NULL if a part is not a whole number."""
    return F.when(version.rlike(r"^\d+(\.\d+)*$"), F.transform(F.split(version, r"\."), lambda x: x.try_cast("long")))


def dotted_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 over dotted numbers of any length, missing parts being 0."""
    x, y = dotted(a), dotted(b)
    pairs = F.zip_with(x, y, lambda p, q: F.signum(F.coalesce(p, F.lit(0)) - F.coalesce(q, F.lit(0))))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, d: F.when(acc != 0, acc).otherwise(d)).cast("int")


SUPPORTED = {"cyclonedx": ("1.2", "1.7"), "spdx": ("2.2", "3.0.1")}
# Versions as documents mostly write them, all within the bounds: told in one look.
PLAIN = {"cyclonedx": ("1.2", "1.3", "1.4", "1.5", "1.6", "1.7"), "spdx": ("2.2", "2.3", "3.0", "3.0.0", "3.0.1")}


def supported(kind: Column, spec: Column) -> Column:
    """Is this version of this format one that is read? False where it cannot be told."""
    bound = lambda i: F.coalesce(*[F.when(kind == name, ends[i]) for name, ends in SUPPORTED.items()])
    inside = lambda v: (dotted_compare(v, bound(0)) >= 0) & (dotted_compare(v, bound(1)) <= 0)
    plain = [(kind == name) & spec.isin(*known) for name, known in PLAIN.items()]
    return F.when(plain[0] | plain[1], True).otherwise(F.coalesce(_let(trim_all(F.regexp_replace(spec, "^SPDX-", "")), inside), F.lit(False)))


def in_cycle(version: Column, cycle: Column) -> Column:
    """Does a version belong to a release line? What follows the line must not be a digit."""
    after = F.substr(version, F.length(cycle) + 1, F.lit(1))
    return F.startswith(version, cycle) & ~after.rlike("^[0-9]$")
