r"""Benchmark items in documents, also with other numbers, names and units.

Texts are read as tokens: numbers and runs of letters.  Numbers, capitalised words and
units after a number become typed placeholders, other words are lower-cased, and every
window of ``WINDOW`` tokens is looked up by hash among the items' windows.  Hits that lie
on one diagonal (same distance between the places in document and item) are aligned; the
values behind their placeholders have to correspond one to one, so that a question with
new numbers is found and a chance resemblance with mixed values is not.  A document holds
an item if consistent diagonals cover at least ``MIN_SHARE`` of the item's windows.

A copy in other case has other names, or none.  So the items' windows are looked up a second
time in folded form, where case does not count and names are words like others; what only
these windows find is added.

Windows with fewer than ``MIN_WORDS`` ordinary words are no evidence and are left out of
the items; an item without any other window cannot be found.  An item shorter than a
window has one window of its own length.

Null and empty texts hold nothing and no document holds a null or empty item.  Rows of
one doc_id, or of one item_id, with different texts are judged text by text and reported
under the id once; null ids are left out.  Extra columns are ignored.  All steps are
DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quintavote.llm.common import let
from quintavote.staging import materialize

WINDOW = 8
MIN_WORDS = 3
MIN_SHARE = 0.5
# Windows of the benchmark, or ids of documents with a hit, are broadcast up to this number.
BROADCAST_ROWS = 1_000_000
# Units that are replaced after a number.
UNITS = (
    "mm", "cm", "dm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "ton", "tons", "ounce", "ounces", "pound", "pounds", "lb", "lbs",
    "ml", "cl", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "cup", "cups",
    "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours",
    "day", "days", "week", "weeks", "month", "months", "year", "years",
    "cent", "cents", "dollar", "dollars", "euro", "euros", "usd", "eur", "percent",
    "kmh", "kph", "mph", "w", "kw", "kwh", "v", "a", "hz", "khz", "mhz", "ghz", "k", "c", "f",
)

_TOKEN = r"\\p{N}+(?:[.,:/-]\\p{N}+)*|[\\p{L}\\p{M}]+"


def _tokens(text: str) -> str:
    """SQL of the tokens of a text."""
    return f"regexp_extract_all({text}, '{_TOKEN}', 0)"


def _folded(token: str) -> str:
    """SQL of a token without its case; the capitals of sharp s are ss, final sigma has none."""
    return f"replace(replace(lower({token}), 'ß', 'ss'), 'ς', 'σ')"


def _kinds(tokens: str, named: bool = True) -> str:
    """SQL of the canonical form of each token of the array ``tokens``."""
    units = ", ".join(f"'{u}'" for u in UNITS)
    number = "rlike({}, '^\\\\p{{N}}')"
    name = " WHEN left(x, 1) <> lower(left(x, 1)) THEN '<name>'" if named else ""
    return (
        f"transform({tokens}, (x, i) -> CASE WHEN {number.format('x')} THEN '<num>'{name}"
        f" WHEN x IN ({units}) AND {number.format(f'get({tokens}, i - 1)')} THEN '<unit>'"
        " ELSE lower(x) END)"
    )


def _windows(size: int, codes: str = "c", folded: bool = False) -> str:
    """SQL of the hashes of all windows of ``size`` tokens over token hashes ``codes``."""
    parts = ", ".join(f"{codes}[i + {k}]" for k in range(size))
    return (
        f"if(size({codes}) < {size}, array(), transform(sequence(0, size({codes}) - {size}),"
        f" i -> xxhash64({-size if folded else size}, {parts})))"
    )


def _window_hashes(text: str, sizes: list[int]) -> str:
    """SQL: an array with one array of window hashes for each size, typed and then folded."""

    def every(kinds: str, folded: bool) -> str:
        hashes = ", ".join(_windows(n, folded=folded) for n in sizes)
        return let("c", f"transform({kinds}, x -> xxhash64(x))", f"array({hashes})")

    folded = let("f", f"transform(t, x -> {_folded('x')})", every(_kinds("f", named=False), True))
    return let("t", _tokens(text), f"concat({every(_kinds('t'), False)}, {folded})")


def _forms(items: DataFrame) -> DataFrame:
    """The items' columns and tokens, kinds, folded: every item in typed and in folded form."""
    tokens = items.withColumn("tokens", F.expr(_tokens("text")))
    typed = tokens.withColumn("kinds", F.expr(_kinds("tokens")))
    folded = tokens.withColumn("tokens", F.expr(f"transform(tokens, x -> {_folded('x')})"))
    folded = folded.withColumn("kinds", F.expr(_kinds("tokens", named=False)))
    return typed.withColumn("folded", F.lit(False)).union(folded.withColumn("folded", F.lit(True)))


def _item_windows(items: DataFrame) -> DataFrame:
    """item, item_id, folded, size, place and hash of the usable windows."""
    kinds = _forms(items).where("size(tokens) > 0").withColumn(
        "size", F.least(F.lit(WINDOW), F.size("tokens"))
    )
    codes = kinds.withColumn("c", F.expr("transform(kinds, x -> xxhash64(x))"))
    ordinary = "size(filter(slice(kinds, place + 1, size), x -> x NOT LIKE '<%>'))"
    hashes = " ".join(
        f"WHEN {n} THEN if(folded, {_windows(n, folded=True)}, {_windows(n)})"
        for n in range(1, WINDOW + 1)
    )
    return (
        codes.select(
            "item_id", "item", "folded", "size", "kinds",
            F.posexplode(F.expr(f"CASE size {hashes} END")).alias("place", "hash"),
        )
        .where(f"{ordinary} >= least({MIN_WORDS}, size)")
        .select("item_id", "item", "folded", "size", "place", "hash")
    )


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """doc_id, item_id, n_windows, n_hit, reparameterised of every item held by a document."""
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")
    ).where("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("doc", F.xxhash64("doc_id", "text"))
    items = benchmark.select(
        F.col(item_key).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")
    ).where("item_id IS NOT NULL AND text IS NOT NULL")
    items = items.distinct().withColumn("item", F.xxhash64("item_id", "text"))

    windows = materialize(_item_windows(items), "item-windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    if not sizes:
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, item_id long, n_windows long, n_hit long, reparameterised boolean"
        )
    small = windows.count() <= BROADCAST_ROWS
    hashes = windows.select("hash").distinct()

    # The outer form: the inner one would work the windows out a second time, to filter.
    # Every window of every document meets the items' hashes; what does not match goes no further.
    seen = rows.select(
        "doc", F.explode_outer(F.expr(_window_hashes("text", sizes))).alias("hashes")
    ).select("doc", F.posexplode("hashes").alias("at", "hash"))
    hits = materialize(
        seen.join(F.broadcast(hashes) if small else hashes, "hash", "left_semi").distinct(),
        "window-hits",
    )
    aligned = hits.join(windows, "hash").select(
        "doc", "item", "item_id", "folded", "size", "place", "at", (F.col("at") - F.col("place")).alias("diagonal")
    )

    # Values behind the placeholders, for the documents with a hit alone.
    ids = hits.select("doc").distinct()
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    said = materialize(
        rows.join(ids, "doc", "left_semi")
        .dropDuplicates(["doc"])
        .select("doc", "doc_id", F.expr(_tokens("text")).alias("doc_tokens")),
        "hit-tokens",
    )
    asked = _forms(items).select("item", "folded", "tokens", "kinds")
    spans = aligned.groupBy("doc", "item", "folded", "diagonal").agg(
        F.first("item_id").alias("item_id"),
        F.first("size").alias("size"),
        F.collect_set("place").alias("places"),
    )
    # Placeholders under the diagonal's windows, each once.
    slots = (
        "filter(array_distinct(flatten(transform(places, p -> sequence(p, p + size - 1)))),"
        " p -> kinds[p] LIKE '<%>')"
    )
    theirs = "doc_tokens[p + diagonal]"
    theirs = f"if(folded, {_folded(theirs)}, {theirs})"
    pairs = f"array_distinct(transform({slots}, p -> struct(tokens[p] AS mine, {theirs} AS theirs)))"
    judged = (
        spans.join(asked, ["item", "folded"])
        .join(said, "doc")
        .select("doc", "doc_id", "item", "item_id", "folded", "places", F.expr(pairs).alias("pairs"))
        .where(
            "size(array_distinct(pairs.mine)) = size(pairs)"
            " AND size(array_distinct(pairs.theirs)) = size(pairs)"
        )
        .withColumn("other", F.expr("exists(pairs, p -> p.mine <> p.theirs)"))
    )
    total = windows.groupBy("item", "folded").agg(F.count("*").alias("n_windows"))
    per_text = (
        judged.groupBy("doc", "item", "folded")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("item_id").alias("item_id"),
            F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_hit"),
            F.max("other").alias("other"),
        )
        .join(total, ["item", "folded"])
        .where(F.col("n_hit") >= MIN_SHARE * F.col("n_windows"))
    )
    # Typed windows go before folded ones, so that these only add.
    return per_text.groupBy("doc_id", "item_id").agg(
        F.max(F.struct(~F.col("folded"), "n_hit", "n_windows", "other")).alias("best")
    ).select(
        "doc_id", "item_id", "best.n_windows", "best.n_hit",
        F.col("best.other").alias("reparameterised"),
    )
