"""Fill-in-the-middle by escaped marker injection, in DataFrame functions only.

``MARK`` is escaped in the text, so that afterwards it stands nowhere; a regular
expression appends it to every unit; its number is the number of units; and
``substring_index`` takes the units up to, between and after two ranks.  The parts are
unescaped and put together again with sentinels around them.  Everything happens in the
document's row: no shuffle, and a text of any length is read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The delimiter, the escape character, and what stands for either behind the escape.
MARK, ESCAPE = "\u001e", "\u001f"
_MARK_NAME, _ESCAPE_NAME = "m", "e"
#: A line with its end, or the rest of the text; the possessive form never goes back.
LINES = r"[^\n]*+\n|[^\n]++"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def escape(text: Column) -> Column:
    """A text without ``MARK``; :func:`unescape` is its inverse."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + _ESCAPE_NAME)), F.lit(MARK), F.lit(ESCAPE + _MARK_NAME))


def unescape(part: Column) -> Column:
    """What an escaped part was.  An escape is read with what follows it, so neither step can see a pair that the other made."""
    return F.replace(F.replace(part, F.lit(ESCAPE + _MARK_NAME), F.lit(MARK)), F.lit(ESCAPE + _ESCAPE_NAME), F.lit(ESCAPE))


def mark_units(text: Column, pattern: str = LINES) -> Column:
    """The escaped text with ``MARK`` after every unit; ``pattern`` must match every character, and no empty unit."""
    return F.regexp_replace(escape(text), pattern, f"$0{MARK}")


def count_units(marked: Column) -> Column:
    return (F.length(marked) - F.length(F.replace(marked, F.lit(MARK)))).cast("long")


def _ranked(marked: Column, count: Column) -> Column:
    """``substring_index`` with a count of the row."""
    return F.call_function("substring_index", marked, F.lit(MARK), count.cast("int"))


def _plain(part: Column) -> Column:
    return unescape(F.replace(part, F.lit(MARK)))


def parts(marked: Column, units: Column, first: Column, second: Column) -> tuple[Column, Column, Column]:
    """The text of the units to rank ``first``, from there to ``second``, and of the rest.

    Every unit is followed by a mark, so what ``substring_index`` counts from the right
    has one empty part at the end.
    """
    upto = _ranked(marked, second)
    return _plain(_ranked(marked, first)), _plain(_ranked(upto, first - second)), _plain(_ranked(marked, second - units - 1))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four whole numbers below 2**32 from the digest of ``seed:id``; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, *, seed: int = 7, percent: int = 100, spm_percent: int = 50, pattern: str = LINES, text: str = "text") -> DataFrame:
    """doc_id, the text, n units, form, prefix, middle, suffix and output of every document.

    Two draws choose the ranks of the cuts, a third whether a text is transformed
    (``percent`` of 100), a fourth the order (``spm_percent`` of 100 have the suffix
    first).  A text that is empty or holds a sentinel stays ``plain``: its output is
    the text, its parts are null.  A null text counts as empty; repeated rows are
    treated alike; an empty table gives no row; other columns are not read.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    h = draws(F.col("doc_id"), seed)
    docs = docs.select("doc_id", whole.alias("text"), mark_units(whole, pattern).alias("__marked"), *[c.alias(f"__h{i}") for i, c in enumerate(h)])
    docs = docs.withColumn("n", count_units(F.col("__marked")))
    cuts = [F.col(f"__h{i}") % (F.col("n") + 1) for i in range(2)]
    docs = docs.withColumns({"__first": F.least(*cuts), "__second": F.greatest(*cuts)})
    taken = F.col("text") != ""
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        taken = taken & ~F.contains("text", F.lit(sentinel))
    form = F.when(~(taken & (F.col("__h2") % 100 < percent)), "plain").when(F.col("__h3") % 100 < spm_percent, "spm").otherwise("psm")
    docs = docs.withColumn("form", form)
    cut = [F.when(F.col("form") != "plain", c) for c in parts(F.col("__marked"), F.col("n"), F.col("__first"), F.col("__second"))]
    docs = docs.select("doc_id", "text", "n", "form", *[c.alias(a) for c, a in zip(cut, ("prefix", "middle", "suffix"), strict=True)])
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    return docs.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")))


def restore(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from; it reads the output alone.

    No part holds a sentinel, and none can arise where a part meets one, since ``<``
    opens a sentinel and stands nowhere else in it.
    """
    middle = F.substring_index(output, MIDDLE, -1)
    rest = F.substring_index(output, MIDDLE, 1)
    psm = F.concat(F.substring_index(F.substring_index(rest, SUFFIX, 1), PREFIX, -1), middle, F.substring_index(rest, SUFFIX, -1))
    spm = F.concat(F.substring_index(rest, PREFIX, -1), middle, F.substring_index(F.substring_index(rest, PREFIX, 1), SUFFIX, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def summarise(made: DataFrame) -> DataFrame:
    """Per document the sizes of its parts, and digests of its output and of the text rebuilt from that."""
    chars = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    restored = restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", chars("prefix"), chars("middle"), digest(F.col("output")).alias("output_sha256"), digest(restored).alias("restored_sha256"))
