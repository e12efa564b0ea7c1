r"""Document fingerprints: sketches that grow with their text.

A text's shingles (five words; the whole sequence of a shorter text) are hashed evenly over
sixteen hex digits, and every hash up to a fixed share of that range is retained, so a long
text keeps many and a short one few.  Two sketches are then samples under one rule, whatever
the sizes: the share of one text's retained hashes that the other holds estimates how much
of it the other contains.  A text with fewer than ``LEAST`` such hashes keeps its ``LEAST``
smallest instead, as a rate alone would leave short texts without any.

Sketches merge: the rule applied to the hashes of two sketches is the sketch of both texts
together.  Long texts are sketched in runs of ``RUN`` shingles and merged.

Words are runs of characters other than space, tab, LF, VT, FF and CR.  A null text counts as
empty; a text without words has an empty sketch.  Equal sketches are alike by 1, also empty
ones.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quintavote.llm.common import keyed_text, let
from quintavote.staging import materialize

WORD = r"[^\\x20\\x09-\\x0D]+"
SHINGLE = 5
# One hash in sixteen is retained.
FRACTION = 1 / 16
HIGHEST = f"{int(FRACTION * 2**64) - 1:016x}"
LEAST = 16
RUN = 4_096


def _rule(hashes: str) -> str:
    """SQL of the sketch of an array of hashes, sorted."""
    low = f"array_sort(array_distinct(filter(all_, h -> h <= '{HIGHEST}')))"
    some = f"slice(array_sort(array_distinct(all_)), 1, {LEAST})"
    return let("all_", hashes, let("low", low, f"if(size(low) >= {LEAST}, low, {some})"))


def sketch(text: str) -> Column:
    """The sorted hashes that the column ``text`` retains."""
    words = ", ".join(f"get(w, i + {k})" for k in range(SHINGLE))
    last = f"greatest(size(w) - {SHINGLE}, 0)"
    run = (
        f"transform(sequence(c, least(c + {RUN - 1}, {last})),"
        f" i -> left(md5(concat_ws(' ', {words})), 16))"
    )
    runs = f"flatten(transform(sequence(0, {last}, {RUN}), c -> {_rule(run)}))"
    found = f"if(size(w) = 0, array(), {_rule(runs)})"
    return F.expr(let("w", f"regexp_extract_all(coalesce({text}, ''), '{WORD}', 0)", found))


def merged(a: str, b: str) -> Column:
    """The sketch of two texts together, from their sketches."""
    return F.expr(_rule(f"concat({a}, {b})"))


def _common(a: str, b: str, measure: str) -> str:
    """``measure`` of x and y: the hashes of a and b in the range that both cover."""

    def reach(s: str) -> str:
        # A sketch of fewer than LEAST hashes holds all that its text has.
        return f"if(size({s}) < {LEAST}, 'g', greatest('{HIGHEST}', element_at({s}, -1)))"

    within = let("top", f"least({reach(a)}, {reach(b)})", "struct({0} AS x, {1} AS y)")
    pair = within.format(*(f"filter({s}, h -> h <= top)" for s in (a, b)))
    return let("p", pair, measure)


def likeness(a: str, b: str) -> Column:
    """Shared hashes over all hashes of two sketches (0 to 1); null where a sketch is."""
    shared = "size(array_intersect(p.x, p.y))"
    measure = let("n", shared, "CAST(n / greatest(size(p.x) + size(p.y) - n, 1) AS double)")
    return F.expr(f"CASE WHEN {a} = {b} THEN 1D ELSE {_common(a, b, measure)} END")


def containment(a: str, b: str) -> Column:
    """Estimated share of a's shingles that b holds; null where no hash of a can tell."""
    measure = "CAST(size(array_intersect(p.x, p.y)) / nullif(size(p.x), 0) AS double)"
    return F.expr(_common(a, b, measure))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and sketch of every document; repeated rows stay repeated."""
    return keyed_text(docs, key, text).select("doc_id", sketch("text").alias("sketch"))


def merge_groups(sketched: DataFrame, *by: str) -> DataFrame:
    """The distinct retained hashes of each group, one row each: by..., hash.

    Of every sketch only the hashes within the fraction count, so groups of any size are
    sketched alike; they stay rows, as the sketch of a large group does not fit one.
    """
    low = F.expr(f"filter(sketch, h -> h <= '{HIGHEST}')")
    return sketched.select(*by, F.explode(low).alias("hash")).distinct()


def contained_in_groups(sketched: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    """doc_id, ``by``, containment of every document in every group that shares a hash with it.

    ``sketched`` holds one row a doc_id.  Hits are counted before and after the exchange.
    """
    low = F.expr(f"filter(sketch, h -> h <= '{HIGHEST}')")
    own = sketched.select("doc_id", F.size(low).alias("n"), F.explode(low).alias("hash"))
    hits = own.join(groups.select(F.col(by).alias("_group"), "hash"), "hash")
    counted = hits.groupBy("doc_id", "_group", "n").count()
    return counted.select(
        "doc_id", F.col("_group").alias(by), (F.col("count") / F.col("n")).alias("containment")
    )


def _successors(ids: DataFrame) -> DataFrame:
    """Add ``next_id``, the following doc_id (the first after the last), to distinct ids.

    Ids are dealt by range, so each part finds its successors alone; only its last one looks
    at the first of the parts behind, of which there is one row a part.
    """
    dealt = ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "dealt")
    heads = dealt.groupBy("part").agg(F.min("doc_id").alias("head"))
    behind = Window.orderBy("part")
    first = F.min("head").over(behind.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("part", F.coalesce(F.lead("head").over(behind), first).alias("behind"))
    following = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return dealt.withColumn("next_id", following).join(F.broadcast(heads), "part").select(
        *ids.columns, F.coalesce("next_id", "behind").alias("next_id")
    )


def compare_with_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's sketch beside that of its edited text and of the next document.

    The edited text has the last quarter of its code points (rounded down) replaced by the
    first as many, or all, of the next document by ascending doc_id; after the last comes
    the first.  Of rows with one doc_id, the one whose text has the least md5 is that id's
    document for the one before.  A row without doc_id has no next document: its last
    quarter is only cut off, and it is compared with an empty text.

    Returns doc_id, n_chars, edited, sketch, edited_sketch, near_edited and near_next.
    """
    # An id that needs no renaming keeps its column: an alias that Spark drops in one join only
    # would keep both from sharing the exchange.
    same = key == "doc_id" and docs.schema[key].dataType == T.LongType()
    id_ = F.col("doc_id") if same else F.col(key).cast("long").alias("doc_id")
    rows = docs.select(id_, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    quarter = F.expr("CAST(length(t) DIV 4 AS int)")
    known = rows.where("doc_id IS NOT NULL")
    ids = known.groupBy("doc_id").agg(F.max(quarter).alias("wanted"))
    before = _successors(ids).select(
        F.col("next_id").alias("doc_id"), F.col("doc_id").alias("prior_id"), "wanted"
    )
    # Both joins read one exchange of texts and sketches; only the wanted heads move again.  The
    # first looks ids up by hash (a few bytes each), so that texts are sorted for the second alone.
    coded = known.select("doc_id", "t", sketch("t").alias("sketch"))
    heads = (
        coded.join(before.hint("shuffle_hash"), "doc_id")
        .select(
            F.col("prior_id").alias("doc_id"),
            F.struct(F.md5("t").alias("m"), F.expr("left(t, wanted)").alias("head"), "sketch").alias("n"),
        )
        .groupBy("doc_id")
        .agg(F.min("n").alias("n"))
    )
    own = coded.join(heads.hint("merge"), "doc_id", "left")
    alone = rows.where("doc_id IS NULL").select(
        "doc_id", "t", sketch("t").alias("sketch"), F.lit(None).cast(heads.schema["n"].dataType).alias("n")
    )
    q = "CAST(length(t) DIV 4 AS int)"
    edited = own.unionByName(alone).select(
        "doc_id",
        F.length("t").cast("long").alias("n_chars"),
        "sketch",
        F.expr(f"concat(left(t, length(t) - {q}), left(coalesce(n.head, ''), {q}))").alias("edited"),
        F.expr("coalesce(n.sketch, CAST(array() AS array<string>))").alias("next_sketch"),
    )
    return edited.withColumn("edited_sketch", sketch("edited")).select(
        "doc_id",
        "n_chars",
        "edited",
        "sketch",
        "edited_sketch",
        likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
    )
