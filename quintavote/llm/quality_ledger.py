"""Quality rules as a ledger of failure bits.

Every rule is evaluated once over the whole text.  The ledger holds, for each
document, the measurements and one bit per failed rule; policies are versioned
masks over those bits, so another policy, or the share of documents that one rule
alone removes, is bitwise arithmetic on the ledger and never reads text again.

Words are runs of characters other than space, tab, LF, VT, FF and CR.  Null and
empty texts have no words and fail ``few_words``.  Repeated rows give repeated
rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quintavote.llm.common import keyed_text, let

WORD = r"[^\\x20\\x09-\\x0D]+"
BLANKS = r" \u0009\u000A\u000B\u000C\u000D"
SYMBOLS = "#*$%&|<>"

# Rule name -> SQL that is true for a failing document.  Bits follow this order;
# append only, as stored ledgers keep their bits.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_words": "n_words > 1000000",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
    "some_repeated_words": "100 * n_repeat_words > 30 * n_words",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A document is kept if none of these rules fails."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[r] for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_words"))
STRICT = Policy("strict-1", tuple(RULES))
# Repeated lines alone also mark refrains and tables; without that rule no document
# that the labels call good and that passes BASE is removed.
STANDARD = Policy("standard-1", tuple(r for r in RULES if r != "duplicate_lines"))


def _covered(windows: str) -> str:
    """Words under 3-word windows that occur twice or more; ``windows`` are their hashes in order."""
    placed = f"sort_array(transform({windows}, (h, i) -> struct(h AS h, i AS i)))"
    again = "filter(s, (x, k) -> x.h = get(s, k - 1).h OR x.h = get(s, k + 1).h)"
    starts = f"sort_array(transform({let('s', placed, again)}, x -> x.i))"
    return (
        f"aggregate({starts}, struct(0L AS n, -3 AS last),"
        " (a, i) -> struct(a.n + least(3, i - a.last) AS n, i AS last), a -> a.n)"
    )


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the measurements and ``fail_bits`` of every document."""
    windows = (
        "if(size(w) < 3, array(), transform(sequence(0, size(w) - 3),"
        " i -> xxhash64(w[i], w[i + 1], w[i + 2])))"
    )
    words = let(
        "w",
        f"regexp_extract_all(t, '{WORD}', 0)",
        f"struct(CAST(size(w) AS long) AS n_words, {_covered(windows)} AS n_repeat_words)",
    )
    lines = let(
        "l",
        rf"filter(split(t, '\n'), x -> length(translate(x, '{BLANKS}', '')) > 0)",
        "struct(CAST(size(l) AS long) AS n_lines,"
        " CAST(size(l) - size(array_distinct(l)) AS long) AS n_dup_lines)",
    )
    measured = (
        keyed_text(docs, key, text)
        .select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
        .select(
            "doc_id",
            F.expr(f"CAST(length(translate(t, '{BLANKS}', '')) AS long)").alias("word_chars"),
            F.expr(f"CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS long)").alias(
                "n_symbols"
            ),
            F.expr(words).alias("w"),
            F.expr(lines).alias("l"),
        )
        .select(
            "doc_id", "w.n_words", "word_chars", "n_symbols",
            "l.n_dup_lines", "w.n_repeat_words", "l.n_lines",
        )
    )
    bits = " + ".join(f"if({sql}, {BITS[name]}L, 0L)" for name, sql in RULES.items())
    return measured.withColumn("fail_bits", F.expr(bits))


def apply_policy(rows: DataFrame, policy: Policy, out: str = "kept") -> DataFrame:
    """Add the verdict of one policy."""
    return rows.withColumn(out, F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """rule, n_failed, n_only: documents that a rule fails, and that it alone removes.

    Documents are first counted by their bits under the policy, so what is
    shuffled is one row per distinct mask and task.
    """
    masks = rows.groupBy(
        F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")
    ).agg(F.count("*").alias("n"))
    per_rule = [
        F.struct(
            F.lit(rule).alias("rule"),
            (F.col("bits").bitwiseAND(F.lit(BITS[rule])) != 0).alias("failed"),
            (F.col("bits") == BITS[rule]).alias("only"),
        )
        for rule in policy.rules
    ]
    return (
        masks.select("n", F.explode(F.array(*per_rule)).alias("r"))
        .groupBy("r.rule")
        .agg(
            F.sum(F.when(F.col("r.failed"), F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("r.only"), F.col("n")).otherwise(0)).alias("n_only"),
        )
    )
