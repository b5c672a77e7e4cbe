"""Matching components to advisories, with three-valued verdicts.

Every distinct (ecosystem, name, version) is asked once, not once a component.  A name's
advisories that say the same are one class.  Listed versions and the windows of classes
are rows that meet the asked versions of their name; what could not be compared is counted for a name and taken off for its hits.  ``clear`` needs a comparison that
really ran: whatever could not be looked up or compared makes ``unknown``.

Who wants counts or pairs and no lists takes :func:`tally_of` and :func:`pairs`: counts are
running sums over the sorted bounds of a name, pairs leave their join as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import purl, versions
from ..storage import written

AFFECTED = "array<struct<name:string,ecosystem:string,versions:array<string>,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string,limit:string>>>>>>"


# Ecosystems whose names are paths, so that a parent path can be asked.
PATHS = ("Go",)


def known(advisories: DataFrame, kev: DataFrame) -> DataFrame:
    """(kind, ecosystem, name, id, ids, summary, known_exploited, entries): every advisory of a key once, ranges prepared.

    ``advisories``: kind (vulnerability or malicious), ecosystem, name, id, aliases,
    summary, affected; an id counts once for each key, the first by source (where there is
    one) and text.  ``kev``: id of every advisory
    known to be exploited, matched by id or alias.  Ranges are prepared once for each
    distinct text of them, which is the dear part.
    """
    rest = [c for c in advisories.columns if c not in ("kind", "ecosystem", "name", "id")]
    first = F.struct(*(["source"] if "source" in rest else []), F.to_json(F.struct("aliases", "summary", "affected")))
    once = advisories.groupBy("kind", "ecosystem", "name", "id").agg(F.min_by(F.struct("aliases", "summary", "affected"), first).alias("__r")).select("kind", "ecosystem", "name", "id", "__r.*")
    ids = F.concat(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>")))
    mine = F.filter("affected", lambda a: (a["ecosystem"] == F.col("ecosystem")) & (a["name"] == F.col("name")))
    said = F.transform(mine, lambda a: F.struct(a["versions"].alias("versions"), a["ranges"].alias("ranges")))
    once = written(once.select("kind", "ecosystem", "name", "id", ids.alias("ids"), "summary", said.alias("said")), "once")
    exploited = once.select("id", F.explode("ids").alias("any_id")).join(kev.select(F.col("id").alias("any_id")).distinct(), "any_id", "left_semi").select("id").distinct().withColumn("known", F.lit(True))
    ready = once.select("said").distinct().select("said", F.transform("said", _entry).alias("entries"))
    marked = once.join(exploited, "id", "left").join(ready, "said", "left")
    return marked.select("kind", "ecosystem", "name", "id", "ids", "summary", F.coalesce("known", F.lit(False)).alias("known_exploited"), "entries")


def index(advisories: DataFrame, kev: DataFrame) -> DataFrame:
    """(ecosystem, name, vulnerabilities, malicious): what is :func:`known`, by the key it is looked up by."""
    entry = F.struct("id", "ids", "summary", "known_exploited", "entries")
    pick = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, entry))).alias
    return known(advisories, kev).groupBy("ecosystem", "name").agg(pick("vulnerability")("vulnerabilities"), pick("malicious")("malicious"))


def _entry(a: Column) -> Column:
    """struct(versions, windows, listed, ranged) of what an advisory says of one package: is there a list, is there a range that can be compared?"""
    ranges = F.transform(a["ranges"], lambda r: versions.windows(versions.prepare_range(r["type"], r["events"])))

    def made(found: Column) -> Column:
        usable = F.filter(F.coalesce(found, F.array().cast("array<array<struct<low:string,high:string,closed:boolean>>>")), lambda w: w.isNotNull())
        listed = F.coalesce(F.size(a["versions"]) > 0, F.lit(False))
        return F.struct(a["versions"].alias("versions"), F.flatten(usable).alias("windows"), listed.alias("listed"), (F.size(usable) > 0).alias("ranged"))

    return F.element_at(F.transform(F.array(ranges), made), 1)


def nearest_module(lookups: DataFrame, modules: DataFrame) -> DataFrame:
    """``lookups`` (name, ...) that have a parent path among ``modules`` (module, ...), with the nearest such row.

    ``lookups`` must be distinct in their columns; the path itself does not count.
    """
    walked = lookups.select(*lookups.columns, F.posexplode(purl.module_candidates(F.col("name"))).alias("__at", "module")).where("__at > 0")
    rest = [c for c in modules.columns if c != "module"]
    near = walked.join(modules, "module").groupBy(*lookups.columns).agg(F.min_by(F.struct("module", *rest), "__at").alias("__m"))
    return near.select(*lookups.columns, "__m.*")


def _hit(a: Column, method: Column, name: Column, declared: Column) -> Column:
    return F.struct(a["id"].alias("id"), a["known_exploited"].alias("known_exploited"), method.alias("method"), name.alias("matched_name"), F.exists(declared, lambda d: F.coalesce(F.array_contains(a["ids"], d), F.lit(False))).alias("already_declared"))


RAW = ("__p", "__w")


def _questions(components: DataFrame) -> DataFrame:
    """``components`` with what is asked of them: package URL, written version and declared ids, none of them NULL."""
    return components.withColumns({"__p": F.coalesce("purl", F.lit("")), "__w": F.coalesce("version", F.lit("")), "__d": F.coalesce("declared", F.array().cast("array<string>"))})


def keyed_by(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """``rows`` (with ``RAW``) and their ecosystem, name, version (``__v``) and why they cannot be looked up (``__why``)."""
    keyed = rows.withColumn("__k", purl.key_of(F.col("__p")))
    keyed = keyed.select(*rows.columns, F.col("__k.ecosystem").alias("ecosystem"), F.col("__k.name").alias("name"), F.coalesce(F.nullif("__k.version", F.lit("")), F.nullif("__w", F.lit(""))).alias("__v"), F.col("__k.why").alias("__unread"))
    keyed = keyed.join(F.broadcast(shards.select("ecosystem", "loaded")), "ecosystem", "left")
    why = (
        F.when(F.col("__p") == "", "no package URL")
        .when(F.col("ecosystem").isNull(), F.col("__unread"))
        .when(F.col("__v").isNull(), "no version")
        .when(F.col("loaded").isNull(), "ecosystem not mirrored")
        .when(~F.col("loaded"), "index did not load")
    )
    return keyed.select(*rows.columns, "ecosystem", "name", "__v", why.alias("__why"))


def match(components: DataFrame, indexed: DataFrame, shards: DataFrame) -> DataFrame:
    """``components`` (name, version, purl, declared) with their verdicts.

    ``shards`` (ecosystem, loaded) names what the mirror holds and whether it could be
    read.  Adds ecosystem, matched_name, via_module, status, hits, malicious, why, and the
    counts n_hits, n_exploited, n_undeclared and n_malicious, which a caller that needs no
    lists should take: then no list goes through a shuffle.  Lists are made once for each
    distinct (ecosystem, name, version, declared).
    """
    rows, raw = _questions(components), [*RAW, "__d"]
    # Package URLs are parsed once for each distinct one, which is the dear part.
    keyed = keyed_by(rows.select(*raw).distinct(), shards)
    keyed = written(keyed, "asked")
    asked = keyed.where("__why IS NULL").select("ecosystem", "name", F.col("__v").alias("version"), F.col("__d").alias("declared")).distinct()
    classes, malicious = classed(indexed)
    answered = verdicts(asked.select("ecosystem", "name", "version").distinct(), classes)
    answered = _with_hits(asked.join(answered, ["ecosystem", "name", "version"]), classes, malicious)
    answered = answered.select(F.col("ecosystem").alias("__e"), F.col("name").alias("__name"), F.col("version").alias("__version"), F.col("declared").alias("__declared"), "via", "status", "unclear", "hits", "malicious", *COUNTS)
    told = keyed.join(answered, F.col("__why").isNull() & (F.col("ecosystem") == F.col("__e")) & (F.col("name") == F.col("__name")) & (F.col("__v") == F.col("__version")) & (F.col("__d") == F.col("__declared")), "left")
    state = F.when(F.col("__why").isNotNull(), "unknown").otherwise(F.col("status"))
    reason = F.when(state == "unknown", F.coalesce("__why", F.concat(F.col("unclear").cast("string"), F.lit(" advisories could not be compared"))))
    counts = [F.when((state != "unknown") if c == "n_malicious" else (state == "affected"), F.col(c)).otherwise(0).alias(c) for c in COUNTS]
    told = told.select(*raw, "ecosystem", F.coalesce("via", "name").alias("matched_name"), F.col("via").alias("via_module"), state.alias("status"), F.when(state == "affected", F.col("hits")).alias("hits"), F.when(state != "unknown", F.col("malicious")).alias("malicious"), reason.alias("why"), *counts)
    return rows.join(told, raw, "left").select(*components.columns, *[c for c in told.columns if c not in raw])


COUNTS = ("n_hits", "n_exploited", "n_undeclared", "n_malicious")
BLIND = ("blind_text", "blind")


def _with_hits(asked: DataFrame, classes: DataFrame, malicious: DataFrame) -> DataFrame:
    """``asked`` (with target, via, found and declared) and its hits, malicious hits and ``COUNTS``.

    Hits are spread from the classes of their name inside a row, in the order of ids; no
    pair of a version and an advisory is a row of a shuffle.
    """
    of_name = classes.groupBy("ecosystem", "target").agg(F.map_from_entries(F.collect_list(F.struct("class", "members"))).alias("__members"))
    of_name = of_name.join(malicious, ["ecosystem", "target"], "full")
    rows = asked.join(of_name, ["ecosystem", "target"], "left")
    here, declared = F.coalesce("via", "name"), F.col("declared")
    spread = F.flatten(F.transform("found", lambda x: F.transform(F.element_at("__members", x["class"]), lambda a: _hit(a, x["method"], here, declared))))
    hits = F.coalesce(F.array_sort(spread), F.array().cast("array<struct<id:string,known_exploited:boolean,method:string,matched_name:string,already_declared:boolean>>"))
    known = F.flatten(F.transform("found", lambda x: F.transform(F.filter(F.element_at("__members", x["class"]), lambda a: F.arrays_overlap(a["ids"], declared)), lambda a: a["id"])))
    bad = F.transform(F.coalesce("malicious_found", F.array().cast(malicious.schema["malicious_found"].dataType)), lambda a: _hit(a, F.lit("enumerated-version"), here, declared))
    total = lambda c: F.aggregate("found", F.lit(0).cast("long"), lambda n, x: n + x[c])
    undeclared = total("n") - F.when(F.size(declared) > 0, F.coalesce(F.size(known), F.lit(0))).otherwise(0)
    return rows.select(*asked.columns, hits.alias("hits"), bad.alias("malicious"), total("n").alias("n_hits"), total("n_known").alias("n_exploited"), undeclared.alias("n_undeclared"), F.coalesce("__n_malicious", F.lit(0)).cast("long").alias("n_malicious"))


def _slim(a: Column) -> Column:
    return F.struct(a["id"].alias("id"), a["ids"].alias("ids"), a["known_exploited"].alias("known_exploited"))


def _blind(entries: Column, with_ranges: bool) -> Column:
    """Is there an entry that a version cannot be compared with? With ``with_ranges`` a range that can be compared counts, as for a version that has an order."""
    known = lambda e: e["listed"] | e["ranged"] if with_ranges else e["listed"]
    return (F.size(entries) == 0) | F.exists(entries, lambda e: ~known(e))


def classed(indexed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Advisories of a name that say the same of versions, as one row; and a name's malicious ones.

    (ecosystem, target, class, entries, n, n_known, members) and (ecosystem, target,
    malicious_found, __n_malicious).  A class is named by its smallest id.  Both are
    written, since preparing ranges is dear and they are read several times.
    """
    indexed = written(indexed, "advisories")
    classes = _classes(indexed.select("ecosystem", F.col("name").alias("target"), F.inline("vulnerabilities")))
    malicious = indexed.where(F.size("malicious") > 0).select("ecosystem", F.col("name").alias("target"), F.transform("malicious", _slim).alias("malicious_found"), F.size("malicious").alias("__n_malicious"))
    return written(classes, "classes"), malicious


def _classes(each: DataFrame) -> DataFrame:
    """(ecosystem, target, class, entries, n, n_known, members) of advisories (ecosystem, target, id, ids, known_exploited, entries)."""
    member = F.struct("id", "ids", "known_exploited")
    return each.groupBy("ecosystem", "target", "entries").agg(F.min("id").alias("class"), F.count("*").alias("n"), F.count_if("known_exploited").alias("n_known"), F.array_sort(F.collect_list(member)).alias("members"))


def held(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is :func:`known` as (names, classes), for :func:`tally_of` and :func:`pairs`; both are written.

    names: ecosystem, target, n, n_malicious, and of how many vulnerabilities an entry
    cannot be compared with a version that has an order (blind_text) or none (blind).
    classes: ecosystem, target, n, n_known, blind_text, blind, members, windows (of all
    entries, none overlapping) and versions (listed and in no window).
    """
    bad = F.col("kind") == "vulnerability"
    names = known.groupBy("ecosystem", F.col("name").alias("target")).agg(F.count_if(bad).alias("n"), F.count_if(F.col("kind") == "malicious").alias("n_malicious"), *[F.count_if(bad & _blind(F.col("entries"), c == "blind_text")).alias(c) for c in BLIND])
    classes = _classes(known.where(bad).select("ecosystem", F.col("name").alias("target"), "id", "ids", "known_exploited", "entries"))
    all_of = lambda c: F.flatten(F.filter(F.transform("entries", lambda e: e[c]), lambda x: x.isNotNull()))
    classes = classes.withColumns({**{c: F.when(_blind(F.col("entries"), c == "blind_text"), F.col("n")).otherwise(0) for c in BLIND}, "windows": versions.merged(all_of("windows")), "versions": F.array_distinct(all_of("versions"))})
    outside = F.filter("versions", lambda v: v.isNotNull() & ~F.coalesce(versions.affected_in(v, F.col("windows")), F.lit(False)))
    return written(names, "names"), written(classes.withColumn("versions", outside).drop("entries", "class"), "classes")


def hits_of(points: DataFrame, classes: DataFrame) -> DataFrame:
    """(ecosystem, target, version, found, blind_text, blind): the classes of advisories that hold a version, and how many of their advisories have an entry that it cannot be compared with.

    ``points``: distinct ecosystem, target (the name to ask), version, text (its key text
    or NULL).  A list of versions is an equi-join; windows meet the points of their name
    as slim rows and are tested while they are joined, so that only hits are kept and a
    popular name is split by its join.  A hit is of a class, so its rows do not grow with
    the advisories that say the same.  Of the entries the first that hits says how.
    """
    entries = classes.select("ecosystem", "target", "class", "n", "n_known", _blind(F.col("entries"), True).alias("blind_text"), _blind(F.col("entries"), False).alias("blind"), F.posexplode("entries").alias("at", "e"))
    kept = ["ecosystem", "target", "version", "class", "n", "n_known", "blind_text", "blind", "at"]
    listed = entries.select("*", F.explode("e.versions").alias("version")).join(points, ["ecosystem", "target", "version"]).select(*kept, F.lit(0).alias("how"))
    windows = entries.select(*[c for c in kept if c != "version"], F.inline("e.windows"))
    inside = (F.col("low") <= F.col("text")) & (F.col("high").isNull() | (F.col("text") < F.col("high")) | (F.col("closed") & (F.col("text") == F.col("high"))))
    ranged = windows.join(points.where("text IS NOT NULL"), ["ecosystem", "target"]).where(inside).select(*kept, F.lit(1).alias("how"))
    key = ["ecosystem", "target", "version"]
    same = [F.first(c).alias(c) for c in ("n", "n_known", "blind_text", "blind")]
    one = listed.unionByName(ranged).groupBy(*key, "class").agg(F.min(F.struct("at", "how")).alias("first"), *same)
    method = F.when(F.col("first.how") == 0, "enumerated-version").otherwise("semver-range")
    weight = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return one.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("class", method.alias("method"), "n", "n_known"))).alias("found"), weight("blind_text"), weight("blind"))


def targeted(asked: DataFrame, names: DataFrame) -> DataFrame:
    """``asked`` (ecosystem, name, ...) with target, the name that is looked up, and via, the same where it is a parent path.

    A name without vulnerabilities of its own is asked again by its nearest parent path,
    for ecosystems whose names are paths (``PATHS``).  Where ``names`` (ecosystem, target,
    n) has no such path, no name has a parent and ``asked`` is not read for them.
    """
    own = names.where("n > 0").select("ecosystem", F.col("target").alias("name"), F.lit(True).alias("__has"))
    paths = own.where(F.col("ecosystem").isin(*PATHS))
    if paths.isEmpty():
        return asked.withColumns({"via": F.lit(None).cast("string"), "target": F.col("name")})
    exact = asked.join(own, ["ecosystem", "name"], "left")
    none = F.col("ecosystem").isin(*PATHS) & ~F.coalesce("__has", F.lit(False))
    near = nearest_module(exact.where(none).select("name").distinct(), paths.select(F.col("name").alias("module"))).select(F.col("name").alias("__path"), F.col("module").alias("via"))
    both = exact.withColumn("__path", F.when(none, F.col("name"))).join(near, "__path", "left")
    return both.select(*asked.columns, "via", F.coalesce("via", "name").alias("target"))


def verdicts(asked: DataFrame, classes: DataFrame) -> DataFrame:
    """``asked`` (distinct ecosystem, name, version) with target, via, status, found and unclear."""
    count = lambda ranges: F.sum(F.when(_blind(F.col("entries"), ranges), F.col("n")).otherwise(0))
    of_name = classes.groupBy("ecosystem", "target").agg(count(True).alias("__blind_text"), count(False).alias("__blind"))
    both = targeted(asked, of_name.select("ecosystem", "target", F.lit(1).alias("n")))
    both = both.select("ecosystem", "name", "version", "via", "target", versions.version_text(F.col("version")).alias("text"))
    hits = hits_of(both.select("ecosystem", "target", "version", "text").distinct(), classes)
    both = both.join(hits, ["ecosystem", "target", "version"], "left").join(of_name, ["ecosystem", "target"], "left")
    rest = lambda all_of, hit: F.coalesce(F.col(all_of) - F.coalesce(hit, F.lit(0)), F.lit(0))
    unclear = F.when(F.col("text").isNotNull(), rest("__blind_text", "blind_text")).otherwise(rest("__blind", "blind"))
    found = F.coalesce("found", F.array().cast(hits.schema["found"].dataType)).alias("found")
    status = F.when(F.size("found") > 0, "affected").when(F.col("unclear") > 0, "unknown").otherwise("clear")
    return both.select("ecosystem", "name", "version", "target", "via", found, unclear.alias("unclear")).withColumn("status", status)


def _at(text: Column, turn: int) -> Column:
    """Where a version's text (``turn`` 1) or a bound stands in the order of its name: a bound that a version reaches before it (0), one that it passes after it (2)."""
    return F.concat(F.lit("1"), text, F.lit(f"\x00{turn}"))


def counted(asked: DataFrame, names: DataFrame, classes: DataFrame) -> DataFrame:
    """``asked`` (ecosystem, target, version, text, ...) with n_hits, n_exploited, unclear, n_malicious and status.

    Windows are steps at their bounds: what holds a version is a running sum over the sorted
    versions and bounds of a name, however many windows there are.  Listed versions are
    an equi-join.
    """
    sums = ["n", "n_known", "blind_text"]
    each = classes.select("ecosystem", "target", *sums, F.inline("windows"))
    ends = F.array(F.struct(_at(F.col("low"), 0).alias("at"), F.lit(1).alias("sign")), F.struct(F.when(F.col("closed"), _at(F.col("high"), 2)).otherwise(_at(F.col("high"), 0)).alias("at"), F.lit(-1).alias("sign")))
    steps = each.select("ecosystem", "target", *sums, F.inline(ends)).where("at IS NOT NULL").groupBy("ecosystem", "target", "at").agg(*[F.sum(F.col(c) * F.col("sign")).alias(f"__{c}") for c in sums])
    # What has no order stands before every bound.
    rows = asked.withColumn("at", F.coalesce(_at(F.col("text"), 1), F.concat(F.lit("0"), "version"))).withColumn("__row", F.lit(True))
    w = Window.partitionBy("ecosystem", "target").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.unionByName(steps, allowMissingColumns=True).withColumns({f"__{c}": F.coalesce(F.sum(f"__{c}").over(w), F.lit(0)) for c in sums}).where("__row").drop("__row", "at")
    listed = classes.select("ecosystem", "target", "n", "n_known", *BLIND, F.explode("versions").alias("version")).groupBy("ecosystem", "target", "version").agg(*[F.sum(c).alias(f"__l_{c}") for c in ("n", "n_known", *BLIND)])
    of_name = names.select("ecosystem", "target", "n_malicious", *[F.col(c).alias(f"__all_{c}") for c in BLIND])
    both = placed.join(listed, ["ecosystem", "target", "version"], "left").join(of_name, ["ecosystem", "target"], "left")
    plus = lambda c: F.col(f"__{c}") + F.coalesce(f"__l_{c}", F.lit(0))
    blind_text, blind = F.coalesce("__all_blind_text", F.lit(0)) - plus("blind_text"), F.coalesce("__all_blind", F.lit(0)) - F.coalesce("__l_blind", F.lit(0))
    unclear = F.when(F.col("text").isNotNull(), blind_text).otherwise(blind)
    got = both.select(*asked.columns, plus("n").alias("n_hits"), plus("n_known").alias("n_exploited"), unclear.alias("unclear"), F.coalesce("n_malicious", F.lit(0)).alias("n_malicious"))
    return got.withColumn("status", F.when(F.col("n_hits") > 0, "affected").when(F.col("unclear") > 0, "unknown").otherwise("clear"))


def _pieces(classes: DataFrame) -> DataFrame:
    """(ecosystem, target, members, low, high, closed, listed): a class as rows of which one at most holds a version, see ``_holds``."""
    none = F.array(F.lit(None).cast("struct<low:string,high:string,closed:boolean>"))
    each = classes.select("ecosystem", "target", "members", "versions", F.posexplode(F.when(F.size("windows") > 0, F.col("windows")).otherwise(none)).alias("__nr", "__w"))
    listed = F.when((F.col("__nr") == 0) & (F.size("versions") > 0), F.col("versions"))
    return each.select("ecosystem", "target", "members", "__w.*", listed.alias("listed")).where("low IS NOT NULL OR listed IS NOT NULL")


def _holds() -> Column:
    """Does a piece hold this row's version and text?"""
    inside = (F.col("low") <= F.col("text")) & (F.col("high").isNull() | (F.col("text") < F.col("high")) | (F.col("closed") & (F.col("text") == F.col("high"))))
    return inside | F.array_contains("listed", F.col("version"))


def pairs(components: DataFrame, names: DataFrame, classes: DataFrame, shards: DataFrame) -> DataFrame:
    """Every component (name, version, purl, declared, ...) and vulnerability that holds its version, as rows: id, known_exploited, matched_name, via_module, already_declared.

    The same hits as :func:`match` lists.  A component meets the pieces of its name in one
    join and leaves it as rows; no list of hits, nor a row for a component and a class,
    goes through a shuffle or is kept.
    """
    own = {c: f"__own_{c}" for c in components.columns}
    asked = keyed_by(_questions(components).withColumnsRenamed(own), shards).where("__why IS NULL").withColumn("version", F.col("__v"))
    # Keys that cannot be NULL: else Spark works them out once more below the joins, to leave out NULLs.
    asked = targeted(asked, names).withColumns({**{c: F.coalesce(c, F.lit("")) for c in ("ecosystem", "target")}, "text": versions.version_text(F.col("version"))})
    met = asked.join(_pieces(classes), ["ecosystem", "target"]).where(_holds())
    hits = met.select(*own.values(), "ecosystem", F.col("target").alias("matched_name"), F.col("via").alias("via_module"), "__d", F.inline("members"))
    declared = F.arrays_overlap("ids", F.filter("__d", lambda d: d.isNotNull()))
    return hits.select(*[F.col(o).alias(c) for c, o in own.items()], "ecosystem", "matched_name", "via_module", "id", "known_exploited", F.coalesce(declared, F.lit(False)).alias("already_declared"))


def tally_of(components: DataFrame, names: DataFrame, classes: DataFrame, shards: DataFrame) -> DataFrame:
    """:func:`tally` of what :func:`match` says of ``components``, which are read once: distinct questions are counted and weigh by their numbers."""
    keyed = keyed_by(_questions(components).groupBy(*RAW, "__d").agg(F.count("*").alias("__weight")), shards)
    keyed = written(keyed.select("ecosystem", "name", F.col("__v").alias("version"), versions.version_text(F.col("__v")).alias("text"), F.col("__d").alias("declared"), "__weight", "__why"), "asked")
    asked = targeted(keyed.where("__why IS NULL").drop("__why"), names)
    told = counted(asked.select("ecosystem", "target", "version", "text", "__weight"), names, classes)
    told = told.select("status", "__weight", "n_hits", "n_exploited", "n_malicious")
    never = keyed.where("__why IS NOT NULL").select(F.lit("unknown").alias("status"), "__weight", *[F.lit(0).cast("long").alias(c) for c in ("n_hits", "n_exploited", "n_malicious")])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    weighed = lambda c, when: total(F.when(when, F.col(c) * F.col("__weight")))
    state, hit = F.col("status"), F.col("status") == "affected"
    sums = told.unionByName(never).agg(*[total(F.when(state == s, F.col("__weight"))).alias(s) for s in ("affected", "clear", "unknown")], weighed("n_exploited", hit).alias("known_exploited"), weighed("n_malicious", state != "unknown").alias("malicious"), weighed("n_hits", hit).alias("__hits"))
    # Hits that a question declares: by any of its ids, each once.
    declared = asked.select("ecosystem", "target", "version", "text", "declared", "__weight", F.explode(F.array_distinct("declared")).alias("any_id"))
    members = _pieces(classes).select("ecosystem", "target", "low", "high", "closed", "listed", F.inline("members")).withColumn("any_id", F.explode(F.array_distinct("ids")))
    first = (F.size("declared") == 1) | (F.col("any_id") == F.element_at(F.array_intersect("declared", "ids"), 1))
    said = declared.join(members, ["ecosystem", "target", "any_id"]).where(_holds() & first).agg(total("__weight").alias("__declared"))
    return sums.crossJoin(said).select("affected", "clear", "unknown", "known_exploited", "malicious", (F.col("__hits") - F.col("__declared")).alias("undeclared"))


def tally(verdicts: DataFrame) -> DataFrame:
    """Six counts over verdicts; no list of hits is read."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return verdicts.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("affected", "clear", "unknown")], total("n_exploited").alias("known_exploited"), total("n_malicious").alias("malicious"), total("n_undeclared").alias("undeclared"))


def declared_by_ref(vulnerabilities: DataFrame) -> DataFrame:
    """(doc_id, ref, ids): advisories that documents declare; an empty ref stands for the whole document.

    ``vulnerabilities``: doc_id, id, references array<string>, affects array<string>.
    """
    ids = F.filter(F.concat(F.array("id"), F.coalesce("references", F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != ""))
    refs = F.filter(F.coalesce("affects", F.array().cast("array<string>")), lambda r: r.isNotNull())
    each = vulnerabilities.select("doc_id", ids.alias("ids"), F.explode(F.when(F.size(refs) > 0, refs).otherwise(F.array(F.lit("")))).alias("ref")).where(F.size("ids") > 0)
    return each.groupBy("doc_id", "ref").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))


def with_declared(components: DataFrame, declared: DataFrame) -> DataFrame:
    """``components`` (doc_id, ref, ...) with the ids declared for them or for their whole document."""
    own = declared.where("ref <> ''").select("doc_id", "ref", F.col("ids").alias("__own"))
    whole = declared.where("ref = ''").select("doc_id", F.col("ids").alias("__whole"))
    none = F.array().cast("array<string>")
    return components.join(own, ["doc_id", "ref"], "left").join(whole, "doc_id", "left").withColumn("declared", F.array_distinct(F.concat(F.coalesce("__own", none), F.coalesce("__whole", none)))).drop("__own", "__whole")
