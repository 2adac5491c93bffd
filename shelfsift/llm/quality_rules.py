"""Quality rules as a bitmask ledger: every rule is evaluated once, policies are masks over the stored bits.

``ledger`` measures each text and sets one bit per rule that it fails. A policy is a named, versioned set of rules, so
a new policy, or a policy without one of its rules, is a bitwise expression over the ledger; texts are not read again.
``ablations`` counts the few distinct bit patterns first and works on those.

Everything is Column expressions. A 3-word window is compared by a 64-bit hash within its own text; two different
windows of one text share a hash with a probability below n*n / 2**65 for n words (1e-11 for 20,000 words).

Defined cases: a null or empty text has no words and fails ``few_words``; texts of any length are measured whole (a task
holds their words and window hashes); repeated rows get a row each; an empty table gives an empty ledger; other columns are carried in ``row`` and cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsift.llm.support import BLANKS, column

SYMBOLS = "#*$%&|<>"
_BLANK_SIGNS = " \t\n\x0b\x0c\r"

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_bullet_lines",
    "n_ellipsis_lines",
)


def _over(part: str, percent: int, whole: str) -> Column:
    return 100 * F.col(part) > percent * F.col(whole)


def _rules() -> dict[str, Column]:
    return {
        "few_words": F.col("n_words") < 50,
        "repeated_windows": _over("n_repeat_words", 50, "n_words"),
        "many_words": F.col("n_words") > 100_000,
        "short_words": _over("n_words", 50, "word_chars"),
        "long_words": F.col("word_chars") > 15 * F.col("n_words"),
        "symbols": _over("n_symbols", 25, "n_words"),
        "repeated_lines": (F.col("n_lines") > 1) & _over("n_dup_lines", 50, "n_lines"),
        "capitals": _over("n_capitals", 50, "word_chars"),
        "bullets": (F.col("n_lines") > 1) & _over("n_bullet_lines", 90, "n_lines"),
        "ellipses": (F.col("n_lines") > 1) & _over("n_ellipsis_lines", 30, "n_lines"),
    }


# Rule names in the order of their bits. A rule keeps its bit for ever; new rules are added at the end.
BITS = {
    name: 1 << bit
    for bit, name in enumerate(
        ("few_words", "repeated_windows", "many_words", "short_words", "long_words", "symbols", "repeated_lines",
         "capitals", "bullets", "ellipses")
    )
}
BASE = ("few_words", "repeated_windows")
POLICIES: dict[str, tuple[str, ...]] = {"base-1": BASE, "web-1": tuple(BITS)}
# For training text: length alone rejects no document; long ones are judged by the ratio rules.
POLICIES["corpus-1"] = tuple(name for name in BITS if name != "many_words")
DEFAULT_POLICY = "web-1"


def mask(rules: tuple[str, ...]) -> int:
    """The bits of some rules."""
    return sum(BITS[name] for name in rules)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (the given columns), the measurements, and ``fail_bits``: a bit for every rule that the text fails."""
    rows = docs.select(
        F.struct(*(column(docs, name) for name in docs.columns)).alias("row"),
        F.coalesce(column(docs, text).cast("string"), F.lit("")).alias("text"),
    )
    spaced = F.translate("text", _BLANK_SIGNS[1:], " " * (len(_BLANK_SIGNS) - 1))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(f"[^{BLANKS}]"))
    cut = rows.select(
        "row",
        _apart(F.array_remove(F.split(spaced, " "), "")).alias("words"),
        lines.alias("lines"),
        _length_without("text", _BLANK_SIGNS).alias("word_chars"),
        (F.length("text") - _length_without("text", SYMBOLS)).alias("n_symbols"),
        (F.length("text") - _length_without("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_capitals"),
    )
    hashed = cut.select(
        "row", "words", "word_chars", "n_symbols", "n_capitals",
        F.size("words").alias("n_words"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size(F.filter("lines", lambda line: line.rlike(f"^[{BLANKS}]*[-*•]"))).alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda line: line.rlike(rf"(\.\.\.|…)[{BLANKS}]*$"))).alias("n_ellipsis_lines"),
        _apart(_windows("words")).alias("windows"),
    )
    measured = hashed.withColumn("n_repeat_words", _repeated_words("windows"))
    long = [F.col(name).cast("bigint").alias(name) for name in MEASURES]
    failed = sum((F.when(rule, F.lit(BITS[name])).otherwise(0) for name, rule in _rules().items()), F.lit(0))
    return measured.select("row", *long).withColumn("fail_bits", failed.cast("bigint"))


def _apart(value: Column) -> Column:
    """The value, in a projection that no filter is pushed through: a filter on what follows from it would otherwise
    hold its whole expression, and compute it again wherever it is used, also once per word."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def _length_without(text: str, signs: str) -> Column:
    return F.length(F.translate(text, signs, ""))


def _windows(words: str) -> Column:
    """A hash for each 3 words in a row."""
    def window(i: Column) -> Column:
        return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    none = F.array().cast("array<bigint>")
    return F.when(F.size(words) < 3, none).otherwise(F.transform(F.sequence(F.lit(0), F.size(words) - 3), window))


def _repeated_words(windows: str) -> Column:
    """How many words lie in a window that occurs twice or more; texts without one are told by a set of hashes."""
    sorted_windows = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(met: Column) -> Column:
        twice = F.filter(
            F.transform(
                met,
                lambda w, k: F.when(
                    (w["h"] == F.get(met, k - 1)["h"]) | (w["h"] == F.get(met, k + 1)["h"]), w["i"]
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))

    # the sorted windows are computed once, as the one element of an array
    of_repeats = F.transform(F.array(sorted_windows), covered)[0]
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(of_repeats)


def kept(policy: str = DEFAULT_POLICY, without: str | None = None) -> Column:
    """Whether a ledger row passes a policy, or that policy without one of its rules."""
    rules = tuple(name for name in POLICIES[policy] if name != without)
    return F.col("fail_bits").bitwiseAND(F.lit(mask(rules)).cast("bigint")) == 0


def ablations(rows: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """For each rule of a policy: rows that fail it, rows that fail nothing else, and rows kept without it."""
    patterns = rows.groupBy("fail_bits").count()
    whole = F.lit(mask(POLICIES[policy])).cast("bigint")
    rules = patterns.select(
        F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(BITS[n]).cast("bigint").alias("bit"))
                            for n in POLICIES[policy]))).alias("r"),
        "fail_bits", "count",
    ).select("r.*", "fail_bits", "count")
    failing = F.col("fail_bits").bitwiseAND(whole)
    rest = failing.bitwiseAND(F.bitwise_not("bit"))

    def rows_where(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("count")).otherwise(0))

    return rules.groupBy(F.lit(policy).alias("policy"), "rule").agg(
        rows_where(failing.bitwiseAND(F.col("bit")) != 0).alias("failed"),
        rows_where(failing == F.col("bit")).alias("failed_alone"),
        rows_where(rest == 0).alias("kept_without"),
        F.bit_or("fail_bits").alias("seen_bits"),
    )
