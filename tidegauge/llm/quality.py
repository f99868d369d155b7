"""Quality rules as a ledger of failure bits, on DataFrame functions alone.

Each rule is evaluated once.  The ledger holds its measurements and one bit a
rule; a policy is a version and a mask of the rules in force, so a new policy,
or the effect of leaving a rule out, is a bitwise operation on stored bits and
needs no second look at the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._places import packed
from ._spark import let

#: White space that parts words.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Rule names in the order of their bits; never reordered, only added to.
RULES = (
    "too_few_words",  # 0: under 10 words
    "repeated_5grams",  # 1: over 20 % of words in a 5-word run found twice
    "symbol_heavy",  # 2: over 1 symbol for every 4 words
    "duplicate_lines",  # 3: over 30 % of lines with a word equal an earlier one
    "short_words",  # 4: under 2 code points a word on average
    "long_words",  # 5: over 20 code points a word on average
    "shouting",  # 6: over half of the letters A-Z and a-z are capitals
    "few_letters",  # 7: under half of the code points in words are letters
)
BIT = {name: 1 << k for k, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """Rules in force under a version; a text is kept if none of them fails."""

    version: str
    rules: tuple[str, ...] = RULES

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", ("too_few_words", "repeated_5grams"))
DEFAULT = Policy("2024.1")


def _repeat_words(words: Column) -> Column:
    """Words that lie in any run of 5 words found twice or more."""

    def grams(w: Column) -> Column:
        return F.when(F.size(w) < 6, F.lit(None).cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)])))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        places = lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"]))
        total = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - x, F.lit(5)))), F.lit(0).cast("bigint"), lambda a, x: a + x)
        return let(pairs, lambda s: let(places(s), total))

    return let(grams(words), lambda h: F.when(h.isNull() | (F.size(F.array_distinct(h)) == F.size(h)), F.lit(0).cast("bigint")).otherwise(covered(h)))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def quality_ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Measurements and failure bits, one row for each row of docs.

    Null text counts as empty: no words, no lines, and so ``too_few_words``.
    Repeated rows are judged one by one.  Columns: doc_id, n_words, word_chars,
    n_symbols, n_lines, n_dup_lines, n_repeat_words, n_letters, n_capitals,
    failed_bits; and a struct ``row`` of the columns to carry, if any.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.regexp_replace("t", SPACE, "")
    base = docs.select(F.col(id_col).alias("doc_id"), *packed(carry), t.alias("t"))
    row = ["row"] if carry else []
    n_words = lambda w: F.size(w).cast("bigint")
    measured = base.select(
        "doc_id",
        *row,
        let(F.array_remove(F.split("t", SPACE), ""), lambda w: F.struct(n_words(w).alias("n_words"), _repeat_words(w).alias("n_repeat_words"))).alias("w"),
        let(F.filter(F.split("t", "\n"), lambda x: F.rtrim(F.translate(x, "\t\n\x0b\x0c\r", "     ")) != ""), lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))).alias("l"),
        let(bare, lambda b: F.struct(F.char_length(b).cast("bigint").alias("word_chars"), (F.char_length(b) - F.char_length(F.translate(b, SYMBOLS, ""))).cast("bigint").alias("n_symbols"))).alias("c"),
        (F.char_length("t") - F.char_length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("bigint").alias("n_capitals"),
        F.char_length(F.regexp_replace("t", r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", "")).cast("bigint").alias("n_letters"),
    ).select("doc_id", *row, "w.*", "l.*", "c.*", "n_capitals", "n_letters")
    c = F.col
    failed = {
        "too_few_words": c("n_words") < 10,
        "repeated_5grams": 100 * c("n_repeat_words") > 20 * c("n_words"),
        "symbol_heavy": 4 * c("n_symbols") > c("n_words"),
        "duplicate_lines": 10 * c("n_dup_lines") > 3 * c("n_lines"),
        "short_words": (c("n_words") > 0) & (c("word_chars") < 2 * c("n_words")),
        "long_words": c("word_chars") > 20 * c("n_words"),
        "shouting": 2 * c("n_capitals") > c("n_letters"),
        "few_letters": 2 * c("n_letters") < c("word_chars"),
    }
    bits = sum((F.when(failed[r], F.lit(BIT[r])).otherwise(F.lit(0)) for r in RULES), F.lit(0)).cast("bigint")
    return measured.withColumn("failed_bits", bits)


def apply_policy(ledger: DataFrame, policy: Policy = DEFAULT, base: Policy = BASE) -> DataFrame:
    """Adds base_failed, policy (its version) and kept."""
    bad = lambda p: F.col("failed_bits").bitwiseAND(F.lit(p.mask)) != 0
    return ledger.withColumns({"base_failed": bad(base), "policy": F.lit(policy.version), "kept": ~(bad(base) | bad(policy))})


def ablation(ledger: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """For each rule of the policy: rows that fail it, fail it alone, and would be kept without it.

    One pass over the ledger: the rows are first counted by their bits, of which
    there are 2**len(RULES) at most.
    """
    counted = ledger.groupBy(F.col("failed_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("bigint").alias("bit")) for r in policy.rules])).alias("r")
    has, alone = F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("bits") == F.col("r.bit")
    return counted.select("bits", "n", rule).groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when((F.col("bits") == 0) | alone, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
