r"""Recurring lines by a log-template tree of fixed depth.

Lines (between \n) are read as log messages: a token with a digit, an at sign or a
scheme is a variable field.  The tree has two levels of constant depth, the token count
and the leading tokens; a leaf holds the distinct lines with both alike.  Within a leaf
a place that takes more than ``MAX_VALUES`` tokens is a field too, provided that the
line keeps at least ``MIN_FIXED`` tokens and ``MIN_SHARE`` of its tokens; a line with
more fields than that stays a template of its own.

A template that occurs in at least ``MIN_DOCS`` documents recurs: its lines are dropped
everywhere but in the document with the smallest doc_id, so that nothing is lost
altogether.  With ``line_docs`` a line, masked, of at least ``LINE_WORDS`` words besides
fields recurs by itself from that many documents on.  Blank lines are never counted and never dropped.

Null text has no lines; its result is null text with 0 lines, and empty text has one
blank line.  Rows of one doc_id are one document for counting, rows with a null doc_id
together count as one document that comes last.  Repeated rows get equal results.
Other columns are kept; columns named n_lines and n_dropped are replaced.  All steps
are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quintavote.llm.common import let
from quintavote.staging import materialize

FIELD = "<*>"
DEPTH = 3
MAX_VALUES = 8
MIN_FIXED = 4
MIN_SHARE = 0.7
MIN_DOCS = 5
# Words of a line that can recur in fewer documents than a template.
LINE_WORDS = 8
# Leaves of several documents are broadcast up to this number, joined by shuffle beyond it.
BROADCAST_LEAVES = 2_000_000
_LAST = (1 << 63) - 1
# A whole token with a digit, an at sign or ://, read once from its start.
_FIELD_PATTERN = r"(?<![^ ])(?:[^ 0-9@:]|:(?!//))*+(?:[0-9@]|://)[^ ]*"


def masked(line: str) -> str:
    """SQL of a line whose tokens are set apart by one space and whose plain fields are masked."""
    spaced = rf"{line} RLIKE '[\t\\x0B\f\r]' OR instr({line}, '  ') > 0"
    spread = rf"trim(regexp_replace(translate({line}, '\t\u000B\f\r', '    '), ' {{2,}}', ' '))"
    even = f"if({spaced}, {spread}, trim({line}))"
    return (
        f"if({line} RLIKE '[0-9@:]', regexp_replace({even}, '{_FIELD_PATTERN}', '{FIELD}'), {even})"
    )


def _lines(rows: DataFrame) -> DataFrame:
    """One row per line that is not blank: document, place, leaf of the tree, masked line."""
    return (
        # Masked within the array and exploded by the outer form: an expression over exploded
        # lines would be worked out again by each filter and column that uses it, and the
        # inner form adds such a filter by itself.
        rows.withColumn("lines", F.expr(rf"transform(split(text, '\n'), x -> {masked('x')})"))
        .select("doc", "row", F.posexplode_outer("lines").alias("pos", "line"))
        .where("line <> ''")
        .select(
            "*",
            F.expr("length(line) - length(replace(line, ' ', '')) + 1").alias("n_tokens"),
        )
        .withColumn(
            "leaf", F.xxhash64("n_tokens", F.substring_index("line", " ", DEPTH))
        )
        .withColumn("h", F.xxhash64("line"))
    )


def _templates(distinct: DataFrame) -> DataFrame:
    """leaf, h, template (hash) of every distinct line of the leaves."""
    tokens = F.split("line", " ")
    places = (
        distinct.select("leaf", F.posexplode(tokens).alias("place", "token"))
        .groupBy("leaf", "place", "token")
        .agg(F.lit(1).alias("one"))
        .groupBy("leaf", "place")
        .agg((F.count("*") > MAX_VALUES).alias("field"))
    )
    fields = (
        places.groupBy("leaf")
        .agg(
            F.max("field").alias("any"),
            F.sort_array(F.collect_list(F.struct("place", "field"))).alias("places"),
        )
        .where("any")
        .select("leaf", F.col("places.field").alias("fields"))
    )
    general = f"zip_with(split(line, ' '), fields, (t, f) -> if(f, '{FIELD}', t))"
    fixed = f"size(filter(t, x -> x <> '{FIELD}'))"
    template = let(
        "t",
        general,
        f"if({fixed} >= {MIN_FIXED} AND {fixed} >= {MIN_SHARE} * size(t), array_join(t, ' '), line)",
    )
    return distinct.join(fields, "leaf", "left").select(
        "leaf", "h", F.xxhash64(F.expr(f"if(fields IS NULL, line, {template})")).alias("template")
    )


def _recurring(placed: DataFrame, by: str, least: int) -> DataFrame:
    """doc, row, pos of what recurs in at least ``least`` documents, but for the first of them."""
    found = (
        placed.select(by, "doc")
        .distinct()
        .groupBy(by)
        .agg(F.count("*").alias("n_docs"), F.min("doc").alias("first"))
        .where(F.col("n_docs") >= least)
        .select(by, "first")
    )
    return placed.join(found, by).where("doc <> first").select("doc", "row", "pos")


def drop_recurring(
    docs: DataFrame, key: str = "doc_id", text: str = "text", line_docs: int = MIN_DOCS
) -> DataFrame:
    """Every row with what is left of its text, n_lines and n_dropped."""
    # The row's own columns travel in one struct, where no working column can clash with them.
    rows = docs.select(
        F.struct("*").alias("own"),
        F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("doc"),
        F.xxhash64(F.col(text)).alias("row"),
        F.col(text).cast("string").alias("text"),
    )
    lines = _lines(rows)
    leaves = materialize(
        lines.select("leaf", "doc")
        .distinct()
        .groupBy("leaf")
        .count()
        .where(F.col("count") >= min(MIN_DOCS, line_docs))
        .select("leaf"),
        "leaves",
    )
    if leaves.count() <= BROADCAST_LEAVES:
        leaves = F.broadcast(leaves)
    found = materialize(
        lines.join(leaves, "leaf", "left_semi").select("leaf", "h", "line", "doc", "row", "pos"),
        "leaf-lines",
    )
    distinct = materialize(
        found.groupBy("leaf", "h").agg(F.first("line").alias("line")), "distinct-lines"
    )
    placed = found.select("leaf", "h", "doc", "row", "pos").join(_templates(distinct), ["leaf", "h"])
    placed = materialize(placed.select("template", "doc", "row", "pos"), "placed-lines")
    gone = _recurring(placed, "template", MIN_DOCS)
    if line_docs < MIN_DOCS:
        words = f"size(filter(split(line, ' '), x -> x <> '{FIELD}'))"
        long = found.where(f"{words} >= {LINE_WORDS}").select("h", "doc", "row", "pos")
        gone = gone.union(_recurring(long, "h", line_docs))
    dropped = gone.groupBy("doc", "row").agg(F.collect_set("pos").alias("dropped"))
    left = let(
        "l",
        r"split(text, '\n')",
        r"array_join(transform(array_except(sequence(0, size(l) - 1), dropped), i -> l[i]), '\n')",
    )
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    own = [
        F.col("own").getField(c).alias(c)
        for c in docs.columns
        if c.lower() not in (text.lower(), "n_lines", "n_dropped")
    ]
    return rows.join(dropped, ["doc", "row"], "left").select(
        *own,
        F.expr(f"if(dropped IS NULL, text, {left})").alias(text),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )
