"""True-casing in context: of all ways to write a row, the one whose neighbouring forms fit the corpus best.

The corpus supplies how often each form of a word occurs, and how often a form follows another (a row's first form follows
``START``). A way to write a row is a path through the forms of its words. Its score adds, for every word,

    ln( (follows(before, form) + share(form)) / (followed(before) + 1) )

where ``share`` is the form's part of its word's occurrences, and ``followed`` how often any form came behind ``before``:
what was seen after that neighbour counts most, and where nothing was seen the usual form does. The best path is found by
going through the row once, keeping the best way to each form of the word reached (Viterbi's method). Of paths with equal scores (to
twelve digits), the one that takes the greater form at the last place where they differ wins.

A word without another form than its lower case has one way, and only neighbours of words with several matter, so
the tables hold those words and pairs only. Small ones are copied to the tasks, words as Arrow columns (``token_map``). Of more pairs
than that, each row gets the entries of its own pairs by an equi join on a hash of their lower-case texts: a row asks with hash and
place, and an entry comes back as the place, how both forms are spelled (a sign where that follows from the lower-case word) and
their count, so no word travels twice. Of more words, a row gets those of its own by an equi join as well. Whole texts are
written as Parquet, which takes a fraction of a checkpoint's disk.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, inf, log

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsift.functions.text import blank_split, drop_digits, surface_text
from shelfsift.operators.token_map import COPIED_ROWS, Table
from shelfsift.session import BROADCAST_ROWS, cut_lineage, sided, small_table, stored

try:
    from math import fma
except ImportError:  # before Python 3.13
    fma = None

START = ""
# Rows that a task holds with their pairs at a time.
PIECE = 100
# How a form is spelled that is its word in lower case, with a capital, or in capitals: no form has these signs.
LOWER, CAPITAL, CAPITALS = "", "^", "*"
# Scores that differ by more differ in the twelve digits that count.
CLOSE = 1e-9

# a word's forms with their counts; a pair's forms with how often they met
_FORMS = "array<struct<form: string, n: bigint>>"
_PAIRS = "array<struct<before: string, form: string, n: bigint>>"


def surface_rows(df: DataFrame, text: str = "description") -> DataFrame:
    """``forms``: the blank-separated forms of each row's text as written, without digits."""
    words = blank_split(drop_digits(surface_text(F.col(text))))
    return df.select(F.filter(words, lambda form: form != "").alias("forms"))


def word_forms(surface: DataFrame) -> DataFrame:
    """``lower, forms``: the forms (with counts) of every word that has several, or one that is not its lower case."""
    counted = surface.select(F.explode("forms").alias("form")).groupBy("form").agg(F.count("*").alias("n"))
    grouped = counted.groupBy(F.lower("form").alias("lower")).agg(F.collect_list(F.struct("form", "n")).alias("forms"))
    return grouped.where((F.size("forms") > 1) | (F.get("forms", F.lit(0))["form"] != F.col("lower")))


def form_pairs(surface: DataFrame, words: DataFrame) -> DataFrame:
    """``lower_before, lower, pairs``: which forms of two neighbours met how often, where either has several forms."""
    both = F.transform(
        "forms",
        lambda form, i: F.struct(F.when(i == 0, F.lit(START)).otherwise(F.get("forms", i - 1)).alias("before"), form.alias("form")),
    )
    met = surface.select(F.explode(both).alias("p")).select("p.*")
    several = several_forms(words)
    # few words with several forms are copied, and pairs that do not matter drop out before they are counted
    small = sided(several, "lower")
    if small is not None:
        kept = _named(_with_either(_named(met), small).groupBy("before", "form").agg(F.count("*").alias("n")))
    else:
        kept = _with_either(_named(met.groupBy("before", "form").agg(F.count("*").alias("n"))), several)
    return kept.groupBy("lower_before", "lower").agg(F.collect_list(F.struct("before", "form", "n")).alias("pairs"))


def several_forms(words: DataFrame) -> DataFrame:
    """``lower``: the words with several forms."""
    return words.where(F.size("forms") > 1).select("lower")


def _named(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("lower_before", F.lower("before")).withColumn("lower", F.lower("form"))


def _with_either(pairs: DataFrame, several: DataFrame) -> DataFrame:
    """The pairs of which either word (``lower_before``, ``lower``) has several forms."""
    here = several.withColumn("_here", F.lit(True))
    there = several.select(F.col("lower").alias("lower_before"), F.lit(True).alias("_there"))
    met = pairs.join(here, "lower", "left").join(there, "lower_before", "left")
    return met.where("_here OR _there").drop("_here", "_there")


def followed_counts(surface: DataFrame, words: DataFrame) -> DataFrame:
    """``form, n``: how often a form of a word with several is followed by another form."""
    followed = F.slice("forms", 1, F.greatest(F.size("forms") - 1, F.lit(0)))
    counted = surface.select(F.explode(followed).alias("form")).groupBy("form").agg(F.count("*").alias("n"))
    several = several_forms(words)
    return counted.join(several, F.lower("form") == F.col("lower"), "left_semi")


def fit_casing(df: DataFrame, text: str = "description") -> CasingTables:
    """Count the corpus. The surface rows and the tables are written, as each is read more than once."""
    surface = stored(surface_rows(df, text))
    words = cut_lineage(word_forms(surface))
    return CasingTables(words, stored(form_pairs(surface, words)), cut_lineage(followed_counts(surface, words)))


class CasingTables:
    """``words`` (lower, forms), ``pairs`` (lower_before, lower, pairs) and ``followed`` (form, n)."""

    def __init__(self, words: DataFrame, pairs: DataFrame, followed: DataFrame):
        self.words, self.pairs, self.followed = words, pairs, followed

    def flat(self) -> tuple[DataFrame, DataFrame]:
        """The same as two narrow tables of text: word, form, count and followed count; and before, form, count."""
        words = self.words.select("lower", F.inline("forms")).join(
            self.followed.select("form", F.col("n").alias("followed")), "form", "left"
        )
        count = [F.col(name).cast("string") for name in ("n", "followed")]
        return words.select("lower", "form", *count), self.pairs.select(F.inline("pairs")).select(
            "before", "form", F.col("n").cast("string")
        )

    def encoded_words(self) -> DataFrame:
        """``lower, entries``: each word's forms with count and followed count, as one text (forms hold neither blank nor bar)."""
        words = self.flat()[0].select("lower", F.concat_ws(" ", "form", "n", F.coalesce("followed", F.lit("0"))).alias("entry"))
        return words.groupBy("lower").agg(F.concat_ws("|", F.collect_list("entry")).alias("entries"))

    def apply(self, df: DataFrame, tokens: str, output: str | None = None, limit: int | None = None) -> DataFrame:
        """Write the lower-case ``tokens`` of each row by its best path. NULL tokens stay and end a run of neighbours; a
        NULL list becomes an empty one. ``limit``: words and pairs that may be copied."""
        output = output or tokens
        small_words = small_table(self.encoded_words(), COPIED_ROWS if limit is None else limit)
        small_pairs = None if small_words is None else small_table(self.flat()[1], BROADCAST_ROWS if limit is None else limit)
        if small_pairs is not None:
            return df.withColumn(output, _copied(df, small_words, small_pairs)(F.col(tokens)))
        return self._joined(df, tokens, output, small_words)

    def _joined(self, df: DataFrame, tokens: str, output: str, small_words: pa.Table | None) -> DataFrame:
        """Each row gets the entries of its own pairs, and of its own words where not all words may be copied."""
        rows = stored(df.withColumn("_row", F.monotonically_increasing_id()))
        given = F.coalesce(F.col(tokens), F.array().cast("array<string>"))
        before = F.concat(F.array(F.lit(START)), F.slice(given, 1, F.greatest(F.size(given) - 1, F.lit(0))))
        # two hashes, so that no pair is taken for another one
        key = [hashed("lower_before", "lower").alias(name) for hashed, name in ((F.xxhash64, "_pair"), (F.hash, "_check"))]
        # the words and those before them, side by side: no word is looked up by its place
        both = F.arrays_zip(F.transform(before, lambda word: F.coalesce(word, F.lit(START))).alias("lower_before"), given.alias("lower"))
        asked = rows.select("_row", F.posexplode(both).alias("place", "p")).where("p.lower IS NOT NULL")
        asked = asked.select("_row", "place", "p.*").select("_row", "place", *key)
        # forms hold neither blank nor bar
        entry = lambda p: F.concat_ws(" ", _spelling(p["before"], "lower_before"), _spelling(p["form"], "lower"), p["n"].cast("string"))
        met = asked.join(self.pairs.select(*key, F.array_join(F.transform("pairs", entry), "|").alias("entries")), ["_pair", "_check"])
        pairs = met.groupBy("_row").agg(F.collect_list(F.struct("place", "entries")).alias("_pairs"))
        met = rows.join(pairs, "_row", "left")
        if small_words is not None:
            return met.withColumn(output, _by_own_pairs(df, small_words)(given, F.col("_pairs"))).drop("_row", "_pairs")
        followed = self.words.select("lower", F.inline("forms")).join(
            self.followed.select("form", F.col("n").alias("followed")), "form", "left"
        )
        entry = F.struct("lower", "form", "n", F.coalesce("followed", F.lit(0)).alias("followed"))
        own_words = rows.select("_row", F.explode(F.array_distinct(given)).alias("lower"))
        words = own_words.join(followed, "lower").groupBy("_row").agg(F.collect_list(entry).alias("_forms"))
        cased = met.join(words, "_row", "left").withColumn("_given", given)
        return cased.withColumn(output, _per_row("_given", "_forms", "_pairs")).drop("_row", "_given", "_forms", "_pairs")


def _spelling(form: Column, lower: str) -> Column:
    """LOWER, CAPITAL or CAPITALS where the form follows from the lower-case word, else the form."""
    word = F.col(lower)
    capital = F.concat(F.upper(F.substring(word, 1, 1)), F.expr(f"substring({lower}, 2)"))
    return F.when(form == word, F.lit(LOWER)).when(form == capital, F.lit(CAPITAL)).when(form == F.upper(word), F.lit(CAPITALS)).otherwise(form)


def spelled(code: str, word: str) -> str:
    """The form that ``_spelling`` stands for."""
    if code == LOWER:
        return word
    if code == CAPITAL:
        return word[:1].upper() + word[1:]
    return word.upper() if code == CAPITALS else code


def own_follows(words: list[str | None], entries: Iterator[tuple[int, str]]) -> dict[tuple[str, str], int]:
    """How often forms met, from a row's words and its entries (place, and before, form and count of each pair of forms)."""
    befores = [START, *(word or START for word in words)]
    found = {}
    for at, texts in entries:
        lower, word = befores[at], words[at]
        for text in texts.split("|"):
            before, form, n = text.split(" ")
            found[spelled(before, lower), spelled(form, word)] = int(n)
    return found


def _rows_of(given: pa.Array, pairs: pa.Array) -> Iterator[tuple[list[str | None], dict[tuple[str, str], int]]]:
    """Each row's words and how often their forms met; entries are read column by column."""
    columns = [column.to_pylist() for column in pairs.flatten().flatten()]
    end = 0
    for words, size in zip(given.to_pylist(), pc.fill_null(pc.list_value_length(pairs), 0).to_pylist()):
        start, end = end, end + size
        yield words, own_follows(words, zip(*(column[start:end] for column in columns)))


def rounded(score: float) -> float:
    """``round(score, 12)``, in a fraction of its time for scores of usual size."""
    scaled = score * 1e12
    if fma is None or not -4e15 < scaled < 4e15:
        return round(score, 12)
    whole = floor(scaled)
    rest = scaled - whole + fma(score, 1e12, -scaled)  # the second part is what the product lost
    return round(score, 12) if rest == 0.5 else (whole + (rest > 0.5)) / 1e12


class Casing:
    """Best paths by dictionaries: ``forms`` (word to its forms and their shares), ``follows`` and ``followed``."""

    def __init__(self, words: Iterator[tuple], pairs: Iterator[tuple]):
        """From rows (lower, form, n, followed) and (before, form, n)."""
        counts: dict[str, list[tuple[str, int]]] = {}
        self.followed: dict[str, int] = {}
        for lower, form, n, followed in words:
            counts.setdefault(lower, []).append((form, int(n)))
            self.followed[form] = int(followed or 0)
        self.forms = {
            lower: sorted((form, n / sum(k for _, k in forms)) for form, n in forms) for lower, forms in counts.items()
        }
        self.follows = {(before, form): int(n) for before, form, n in pairs}

    def best(self, words: list[str | None]) -> list[str | None]:
        """The best path of a row."""
        out: list[str | None] = []
        run: list[str] = []
        for word in [*words, None]:
            if word is None:
                out += self._run(run)
                out.append(None)
                run = []
            else:
                run.append(word)
        return out[:-1]

    def _run(self, words: list[str]) -> list[str]:
        ways: list[tuple[float, str]] = [(0.0, START)]  # best score of a way to each form of the word reached
        back: list[dict[str, str]] = []
        met, followed = self.follows.get, self.followed.get
        for word in words:
            forms = self.forms.get(word) or ((word, 1.0),)
            if len(ways) == len(forms) == 1:  # scores are compared with each other only
                back.append({forms[0][0]: ways[0][1]})
                ways = [(0.0, forms[0][0])]
                continue
            reached, came = [], {}
            from_ways = [(s, b, followed(b, 0) + 1) for s, b in ways]
            for form, share in forms:
                top = second = -inf
                for s, b, n in from_ways:
                    score = s + log((met((b, form), 0) + share) / n)
                    if score > top:
                        top, second, before = score, top, b
                    elif score > second:
                        second = score
                if top - second > CLOSE:
                    top = rounded(top)
                else:  # a tie, or nearly: the digits that count decide, then the greater form
                    top, before = max((rounded(s + log((met((b, form), 0) + share) / n)), b) for s, b, n in from_ways)
                reached.append((top, form))
                came[form] = before
            back.append(came)
            ways = reached if len(reached) > 1 else [(0.0, reached[0][1])]
        form = max(ways)[1]
        path = []
        for came in reversed(back):
            path.append(form)
            form = came[form]
        return path[::-1]


class _Copied:
    """A table of words (``encoded_words``), and one of pairs, whose dictionary is built once in each Python worker."""

    def __init__(self, words: pa.Table, pairs: pa.Table | None = None):
        self.words, self.pairs, self.follows = Table(words), pairs, None

    def __getstate__(self):
        return self.words, self.pairs

    def __setstate__(self, state):
        (self.words, self.pairs), self.follows = state, None

    def casing(self, lists: pa.Array) -> Casing:
        """The forms of the words in these rows; with a table of pairs, these as well."""
        words = lists.flatten().unique().cast(pa.string())
        _, entries = self.words.find(words)
        rows = [
            (word, *entry.split(" "))
            for word, known in zip(words.to_pylist(), entries.to_pylist()) if known is not None
            for entry in known.split("|")
        ]
        if self.follows is None and self.pairs is not None:
            pairs = zip(*(column.to_pylist() for column in self.pairs.columns))
            self.follows = {(before, form): int(n) for before, form, n in pairs}
        casing = Casing(rows, ())
        casing.follows = self.follows
        return casing


def _by_own_pairs(df: DataFrame, words: pa.Table):
    """A column function of words and the pairs that the row brings along; the table of words is copied."""
    shared = df.sparkSession.sparkContext.broadcast(_Copied(words))

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def cased(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for given, met in columns:
            for at in range(0, len(given), PIECE):
                piece, out = given.slice(at, PIECE), []
                casing = shared.value.casing(piece)
                for words, casing.follows in _rows_of(piece, met.slice(at, PIECE)):
                    out.append(casing.best(words))
                yield pa.array(out, pa.list_(pa.string()))

    return cased


def _copied(df: DataFrame, words: pa.Table, pairs: pa.Table):
    shared = df.sparkSession.sparkContext.broadcast(_Copied(words, pairs))

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def cased(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in lists:
            for at in range(0, len(batch), PIECE):
                piece = batch.slice(at, PIECE)
                best = shared.value.casing(piece).best
                yield pa.array([best(words or []) for words in piece.to_pylist()], pa.list_(pa.string()))

    return cased


def _per_row(given: str, forms: str, pairs: str) -> Column:
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def cased(given: pa.Array, forms: pa.Array, pairs: pa.Array) -> pa.Array:
        out = []
        for (words, follows), own in zip(_rows_of(given, pairs), forms.to_pylist()):
            casing = Casing([(f["lower"], f["form"], f["n"], f["followed"]) for f in own or ()], ())
            casing.follows = follows
            out.append(casing.best(words))
        return pa.array(out, pa.list_(pa.string()))

    return cased(given, forms, pairs)
