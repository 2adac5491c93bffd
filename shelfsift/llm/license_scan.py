"""Licence scan: normalised stretches of text against licence templates, by Dice over distinct word bigrams.

A text's words are its runs of ASCII letters and digits (with decimal points, so that versions stay whole), in lower
case; copyright lines are left out, as templates leave them out. Compared are each line, each paragraph of two or more
lines (blank lines part them), and a whole text of two or more paragraphs. A template of ``b`` bigrams can only reach
Dice ``t`` with a stretch of ``a`` bigrams if ``b*t/(2-t) <= a <= b*(2-t)/t``, and only if they share at least
``t*(a+b)/2``; stretches with fewer template bigrams than the smallest such number are passed over after one look-up
per word, and of the rest only templates within the size bounds are compared.

Everything is local to a row. Defined cases: null, empty and blank texts have no hits; single words have no bigrams
and match nothing; texts of any length are read whole, in one task's memory; a tie goes to the first identifier by name,
then the earlier line; repeated rows get rows of their own; an empty table gives an empty result; columns but doc_id and
text are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsift.llm.license_texts import TEMPLATES
from shelfsift.llm.support import inputs

LEAST_DICE = 0.8

_WORD = re.compile(r"[A-Za-z0-9]+(?:\.[0-9]+)*")
_COPYRIGHT = re.compile(r"[\x20\x09-\x0D]*(?:copyright|\(c\)|©)", re.I | re.A)
_HIT = "struct<license:string,dice:double,kind:string,first_line:int,last_line:int>"


def words_of(line: str) -> list[str]:
    """A line's normalised words."""
    found = _WORD.findall(line)
    return " ".join(found).lower().split(" ") if found else []


class Templates:
    """Templates by bigrams, with the bounds that follow from the least Dice."""

    def __init__(self, templates: list[tuple[str, str]], least: float):
        self.least = least
        self.bigrams = []
        for name, text in templates:
            words = words_of(text)
            self.bigrams.append((name, frozenset(zip(words, words[1:]))))
        self.known: dict[tuple[str, str], list[int]] = {}
        for k, (_, grams) in enumerate(self.bigrams):
            for gram in grams:
                self.known.setdefault(gram, []).append(k)
        ratio = least / (2 - least)
        self.bounds = [(len(g) * ratio, len(g) / ratio) for _, g in self.bigrams]
        self.least_shared = min((len(g) * ratio for _, g in self.bigrams if g), default=float("inf"))

    def best(self, grams: set) -> tuple[str, float] | None:
        """The best template at or above the least Dice, by name where equal."""
        size, shared = len(grams), Counter()
        within = [low - 1e-9 <= size <= high + 1e-9 for low, high in self.bounds]
        if not any(within):
            return None
        for gram in grams:
            for k in self.known.get(gram, ()):
                if within[k]:
                    shared[k] += 1
        scores = [(-2 * n / (size + len(self.bigrams[k][1])), self.bigrams[k][0]) for k, n in shared.items()]
        dice, name = min(scores, default=(0.0, ""))
        return (name, -dice) if -dice >= self.least else None

    def scan(self, text: str) -> list[dict]:
        """All hits in a text, in the order of lines, then paragraphs, then the whole."""
        lines = text.split("\n")
        words: list[str] = []
        starts, paragraphs, opened = [], [], None  # a paragraph: its first and last line
        for number, line in enumerate(lines):
            starts.append(len(words))
            if _COPYRIGHT.match(line):
                continue
            found = words_of(line)
            words += found
            if not found:
                opened = None
            elif opened is None:
                opened = [number, number]
                paragraphs.append(opened)
            else:
                opened[1] = number
        starts.append(len(words))
        pairs = list(zip(words, words[1:]))
        known = [i for i, pair in enumerate(pairs) if pair in self.known]
        if len(known) < self.least_shared:
            return []
        units = [("line", k, k) for k in range(len(lines))]
        units += [("paragraph", a, b) for a, b in paragraphs if a < b]
        if len(paragraphs) > 1:
            units.append(("text", paragraphs[0][0], paragraphs[-1][1]))
        hits = []
        for kind, first, last in units:
            a, b = starts[first], starts[last + 1] - 1
            if bisect_left(known, b) - bisect_left(known, a) < self.least_shared:
                continue
            best = self.best(set(pairs[a:b]))
            if best:
                hits.append({"license": best[0], "dice": best[1], "kind": kind, "first_line": first, "last_line": last})
        return hits


def scan(docs: DataFrame, least: float = LEAST_DICE, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id and ``hits`` (license, dice, kind, first_line, last_line; lines from 0) for every row of ``docs``."""
    given = templates or TEMPLATES

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(given, least)
        kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("kind", pa.string()),
                                   ("first_line", pa.int32()), ("last_line", pa.int32())]))
        for batch in batches:
            hits = [known.scan(text.as_py() or "") for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, kind)], ["doc_id", "hits"])

    rows = inputs(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return rows.mapInArrow(scanned, f"doc_id bigint, hits array<{_HIT}>")


def summary(scanned: DataFrame) -> DataFrame:
    """Per row: number of hits, their licences in name order, and the best hit."""
    rank = F.transform("hits", lambda h: F.struct(
        (-h["dice"]).alias("d"), h["license"].alias("license"), h["first_line"].alias("line"), h["dice"].alias("dice")
    ))
    best = F.get(F.sort_array(rank), F.lit(0))
    return scanned.select(
        "doc_id",
        F.size("hits").cast("bigint").alias("n_hits"),
        F.array_join(F.sort_array(F.array_distinct("hits.license")), ",").alias("licenses"),
        best["license"].alias("best_license"),
        F.round(best["dice"], 6).alias("best_dice"),
        best["line"].cast("bigint").alias("best_line"),
    )
