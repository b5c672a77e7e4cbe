"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context,
and only its own text is trainable.  A conversation that does not end in an assistant
turn gets one more example without a trainable part, so that no turn is lost.

The template writes a turn as ``### role:``, a line break, the text, a line break,
``</turn>`` and a line break.  Inside texts and roles a backslash is written ``\\b``,
``#`` is ``\\h`` and ``<`` is ``\\l`` (in roles also ``:`` ``\\c`` and a line break
``\\n``), so no text can hold a mark of the template, and reading it back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "\n</turn>\n"
TRAINED = "assistant"


def _swap(c: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(c: Column) -> Column:
    return _swap(c, ("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))


def unescape(c: Column) -> Column:
    return _swap(c, ("\\h", "#"), ("\\l", "<"), ("\\b", "\\"))


def escape_role(c: Column) -> Column:
    return _swap(escape(c), (":", "\\c"), ("\n", "\\n"))


def unescape_role(c: Column) -> Column:
    return unescape(_swap(c, ("\\c", ":"), ("\\n", "\n")))


def expand(rows: DataFrame) -> DataFrame:
    """One row per example: conv_id, target (1-based turn, or 0), n_turns, formatted, loss_start, loss_length.

    ``rows`` has conv_id, turn, role and text, a row per turn; order is by turn, then
    role, then text, nulls first; repeated rows are turns of their own; a null text or
    role counts as empty; a null conv_id is one conversation.  Offsets are code points
    of ``formatted``, from 0; a length of 0 with target 0 marks the untrained tail.
    An empty table gives none; other columns are not read.
    """
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    head = lambda t: F.concat(F.lit("### "), escape_role(t["role"]), F.lit(":\n"))
    written = turns.withColumn("n", F.size("turns")).select(
        "conv_id",
        "n",
        F.transform("turns", lambda t: t["role"] == TRAINED).alias("trained"),
        F.transform("turns", lambda t: F.length(head(t))).alias("heads"),
        F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(END))).alias("parts"),
    )
    targets = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.element_at("trained", i) | (i == F.col("n")))
    made = written.select("conv_id", "n", "trained", "heads", "parts", F.explode(targets).alias("at"))
    trained = F.element_at("trained", F.col("at"))
    formatted = F.array_join(F.slice("parts", 1, F.col("at")), "")
    last = F.element_at("parts", F.col("at"))
    start = F.length(F.array_join(F.slice("parts", 1, F.col("at") - 1), "")) + F.element_at("heads", F.col("at"))
    length = F.length(last) - F.element_at("heads", F.col("at")) - len(END)
    return made.select("conv_id", F.when(trained, F.col("at")).otherwise(0).alias("target"), F.col("at").alias("n_turns"), formatted.alias("formatted"), F.when(trained, start).otherwise(0).cast("long").alias("loss_start"), F.when(trained, length).otherwise(0).cast("long").alias("loss_length"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted example: array of (role, text)."""
    parts = F.split(formatted, END)
    whole = F.slice(parts, 1, F.size(parts) - 1)
    cut = lambda p: F.instr(p, ":\n")  # noqa: E731  roles hold no colon
    return F.transform(whole, lambda p: F.struct(unescape_role(F.substr(p, F.lit(5), cut(p) - 5)).alias("role"), unescape(F.substr(p, cut(p) + 2)).alias("text")))


def read_loss(formatted: Column, start: Column, length: Column) -> Column:
    """The text under the loss mask, as it was before formatting."""
    return unescape(F.substr(formatted, (start + 1).cast("int"), length.cast("int")))


def summarise(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns, what is trained on, and sizes."""
    by = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "n_turns").alias("longest"),
        F.sort_array(F.collect_list(F.when(F.col("target") > 0, F.struct("target", read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("text"))))).alias("loss"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    parts = by.select("conv_id", "formatted_chars", read_turns(F.col("longest")).alias("turns"), F.array_join(F.transform("loss", lambda x: x["text"]), "").alias("loss"))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return parts.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
