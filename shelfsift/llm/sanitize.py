"""Information-theoretic sanitisation of personal data: pattern spans, and terms that give a protected entity away.

1. Patterns find e-mail addresses, IP addresses, card and phone numbers (the base spans, as code point offsets).
2. Each distinct value found is a protected entity. Its context is the CONTEXT_WORDS words before and behind it. Over
   the whole corpus, documents are counted that hold the entity, the term, and the term in the entity's context.
3. The disclosure of entity e by term t is PMI(e, t) / IC(e) with IC(e) = -log2 P(e) and
   PMI = log2 P(e, t) / (P(e) P(t)): 1 when the term occurs nowhere without the entity, 0 when it says nothing. Terms
   at or above the threshold are sanitised wherever they stand, unless chance could explain their meeting: with E =
   docs(e) * docs(t) / documents meetings expected, n or more have at most the probability exp(n - E) * (E / n) ** n
   (Chernoff, for a Poisson count), which must not exceed CHANCE. For a rare entity one document is enough. ``term`` holds their spans in contexts of the entity, ``far_term`` all others, in any document.
4. ``sanitized`` replaces base spans by their kind, disclosing numbers by ``[NUMBER]`` (generalised), and removes other
   disclosing terms.

Everything is Column expressions and equi joins; patterns are written so that each character is looked at a bounded
number of times. Counts are combined before they are shuffled, and contexts, not documents, meet the entity table. The
distinct terms of documents meet the disclosing ones inside the task while those are few, else in a join.

Defined cases: a null text is empty and has no spans; texts of any length are read whole, as one value in a task; repeated ids and rows are kept, each counts as a document; an
empty table gives an empty result; other columns are carried in ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsift.llm.support import BLANKS, column, small_side, stored

CONTEXT_WORDS = 6
DISCLOSURE = 0.9
# No floor by number: a rare entity has few documents. What chance could explain is left out instead.
LEAST_DOCUMENTS = 1
CHANCE = 0.1

KINDS = ("email", "ip", "card", "phone")
# Each pattern finds what its plain form finds. A look-behind (or \G, the end of the match before) keeps the search
# from starting again inside a run that has failed, and possessive repeats from giving back what cannot help.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Cheap tests that a text without matches fails.
HINTS = {
    "email": lambda text: F.contains(text, F.lit("@")),
    "ip": lambda text: text.rlike(r"[0-9]\.[0-9]"),
    "card": lambda text: text.rlike(r"(?:[0-9][\x20-]?){15}[0-9]"),
    "phone": lambda text: text.rlike(r"\+[0-9]"),
}
_SPANS = "array<struct<start:bigint,end:bigint,value:string>>"
_WORD = f"[^{BLANKS}]+"
# Signs around a term that do not belong to it.
_EDGE = "[\\p{Punct}¡¿«»„“”‘’…]"


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern, leftmost first, with code point offsets (end exclusive)."""
    # what lies before each match, and behind the last one; the pieces add up to the text
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPANS).alias("spans"))
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    return F.when(F.size(found) == 0, F.array().cast(_SPANS)).otherwise(
        F.aggregate(pairs, empty, step, lambda state: state["spans"])
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    def worth(i: Column) -> Column:
        digit = F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int")
        doubled = digit * (1 + i % 2)
        return F.when(doubled > 9, doubled - 9).otherwise(doubled)

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(F.transform(places, worth), F.lit(0), lambda total, d: total + d) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(value, "[.]"), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    count = F.length(_digits(value))
    if kind == "card":
        return F.when(count.between(16, 19), _luhn(_digits(value))).otherwise(False)
    return count.between(8, 15)


def _is_valid(kind: str):
    return lambda span: _valid(kind, span["value"])


def _entity(kind: str, value: Column) -> Column:
    """What makes two values the same protected entity."""
    same = F.lower(value) if kind in ("email", "ip") else _digits(value)
    return F.concat(F.lit(kind + ":"), same)


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (the given columns), ``text`` (null: empty) and an array of base spans per kind."""
    rows = docs.select(
        F.struct(*(column(docs, name) for name in docs.columns)).alias("row"),
        F.coalesce(column(docs, text).cast("string"), F.lit("")).alias("text"),
    )
    spans = {
        kind: F.when(
            HINTS[kind](F.col("text")),
            F.filter(matches(F.col("text"), PATTERNS[kind]), _is_valid(kind)),
        ).otherwise(F.array().cast(_SPANS))
        for kind in KINDS
    }
    return rows.withColumns(spans)


def _words_at(words: Column, offset: Column) -> Column:
    """The words of a stretch of text with their offsets in the whole text, edge signs off, lower-cased."""
    def term(w: Column) -> Column:
        bare = F.regexp_replace(w["value"], f"^{_EDGE}+|{_EDGE}+$", "")
        lead = F.length(w["value"]) - F.length(F.regexp_replace(w["value"], f"^{_EDGE}+", ""))
        start = offset + w["start"] + lead
        return F.struct(
            F.lower(bare).alias("term"), start.alias("start"), (start + F.length(bare)).alias("end")
        )

    return F.filter(F.transform(matches(words, _WORD), term), lambda w: F.length(w["term"]) > 0)


def _contexts(found: DataFrame) -> DataFrame:
    """A row per entity occurrence and term in its context: row_id, entity, term, start, end."""
    def entities(kind: str) -> Column:
        def of_span(s: Column) -> Column:
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), _entity(kind, s["value"]).alias("entity"))

        return F.transform(kind, of_span)

    each = F.concat(*(entities(kind) for kind in KINDS))
    hits = found.select("row_id", "text", F.explode(each).alias("s")).select("row_id", "text", "s.*")
    few = f"(?:[{BLANKS}]*+{_WORD}+){{0,{CONTEXT_WORDS}}}"
    before = F.expr("substring(text, 1, CAST(start AS INT))")
    behind = F.expr("substring(text, CAST(end AS INT) + 1)")
    # reversed, the words just before the entity are the first ones
    left = F.reverse(F.regexp_extract(F.reverse(before), "^" + few, 0))
    right = F.regexp_extract(behind, "^" + few, 0)
    sides = hits.select("row_id", "entity", "start", "end", left.alias("left"), right.alias("right"))
    words = F.concat(
        _words_at(F.col("left"), F.col("start") - F.length("left")), _words_at(F.col("right"), F.col("end"))
    )
    return sides.select("row_id", "entity", F.explode(words).alias("w")).select("row_id", "entity", "w.*")


def _distinct_terms(text: str = "text") -> Column:
    spaced = F.split(F.lower(text), f"[{BLANKS}]+")
    return F.array_distinct(F.transform(spaced, lambda w: F.regexp_replace(w, f"^{_EDGE}+|{_EDGE}+$", "")))


def _term_documents(found: DataFrame) -> DataFrame:
    """In how many documents each term occurs, over the whole corpus."""
    terms = found.select(F.explode(_distinct_terms()).alias("term")).where("term <> ''")
    return terms.groupBy("term").agg(F.count("*").alias("term_docs"))


def _occurrences(text: Column, terms: Column) -> Column:
    """The spans of all words of a text that are one of ``terms``; only hits are added to the list."""
    edge = f"^[{BLANKS}]*+{_EDGE}*+"

    def measured(piece: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(piece, edge, ""), f"{_EDGE}+$", "")
        return F.struct(piece.alias("piece"), F.length(bare).alias("length"), F.lower(bare).alias("term"))

    def step(state: Column, w: Column) -> Column:
        start = state["at"] + F.length(w["piece"]) - F.length(F.regexp_replace(w["piece"], edge, ""))
        span = F.struct(start.alias("start"), (start + w["length"]).alias("end"), w["term"].alias("value"))
        spans = F.when(F.array_contains(terms, w["term"]), F.concat(state["spans"], F.array(span)))
        return F.struct(
            (state["at"] + F.length(w["piece"])).alias("at"), F.coalesce(spans, state["spans"]).alias("spans")
        )

    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPANS).alias("spans"))
    pieces = F.regexp_extract_all(text, F.lit(f"[{BLANKS}]*+{_WORD}+"), F.lit(0))
    return F.aggregate(F.transform(pieces, measured), empty, step, lambda state: state["spans"])


def find(docs: DataFrame, text: str = "text", threshold: float = DISCLOSURE, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``row``, ``text``, the base spans per kind, and ``term`` and ``far_term``: spans of terms that disclose a
    protected entity, in its contexts and everywhere else."""
    # rows are written once with a number of their own; their text is a column of the row
    found = stored(
        base_spans(docs, text).withColumn("row_id", F.monotonically_increasing_id()).drop("text"), "spans"
    )
    found = found.withColumn("text", F.coalesce(F.col("row")[text].cast("string"), F.lit("")))
    held = found.where(F.size(F.concat(*KINDS)) > 0)
    contexts = stored(_contexts(held), "contexts")
    total = found.agg(F.count("*")).first()[0]
    pairs = (
        contexts.select("row_id", "entity", "term").distinct()
        .groupBy("entity", "term").agg(F.count("*").alias("pair_docs")).where(F.col("pair_docs") >= least)
    )
    entity_docs = (
        contexts.select("row_id", "entity").distinct().groupBy("entity").agg(F.count("*").alias("entity_docs"))
    )
    scored = pairs.join(entity_docs, "entity").join(_term_documents(found), "term")
    information = -F.log2(F.col("entity_docs") / F.lit(float(max(1, total))))
    pmi = F.log2(F.col("pair_docs") * F.lit(float(max(1, total))) / (F.col("entity_docs") * F.col("term_docs")))
    expected = F.col("entity_docs") * F.col("term_docs") / F.lit(float(max(1, total)))
    by_chance = F.exp(F.col("pair_docs") * (1 + F.log(expected / F.col("pair_docs"))) - expected)
    disclosing = scored.where(
        (information > 0) & (pmi >= threshold * information) & (by_chance <= CHANCE)
    ).select("entity", "term")
    disclosing = stored(disclosing, "disclosing")
    span = F.struct("start", "end", F.col("term").alias("value"))
    terms = (
        contexts.join(disclosing, ["entity", "term"]).groupBy("row_id")
        .agg(F.array_sort(F.collect_set(span)).alias("term"))
    )
    met = (
        found.select("row_id", F.explode(_distinct_terms()).alias("term"))
        .join(small_side(disclosing.select("term").distinct()), "term", "left_semi")
        .groupBy("row_id").agg(F.collect_set("term").alias("met"))
    )
    marks = stored(met.join(terms, "row_id", "full"), "marks")
    none = F.array().cast(_SPANS)
    marked = found.join(small_side(marks), "row_id", "left").withColumn("term", F.coalesce("term", none))
    everywhere = F.when(F.col("met").isNotNull(), F.array_except(_occurrences(F.col("text"), F.col("met")), "term"))
    return marked.select("row", "text", *KINDS, "term", F.coalesce(everywhere, none).alias("far_term"))


def span_list(*kinds: str) -> Column:
    """``kind:start:end`` of every span, by kind as listed, then by start, joined by commas."""
    def listed(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    return F.array_join(F.concat(*(listed(kind) for kind in kinds)), ",")


def sanitized_text() -> Column:
    """The text of a row of ``find`` without its personal data; spans that overlap become one, named by the first."""
    def named(kind: str) -> Column:
        mark = F.lit(f"[{kind.upper()}]")
        if kind in ("term", "far_term"):
            return F.transform(
                kind,
                lambda s: F.struct(
                    s["start"].alias("start"), s["end"].alias("end"),
                    F.when(s["value"].rlike("[0-9]"), F.lit("[NUMBER]")).otherwise(F.lit("")).alias("mark"),
                ),
            )
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), mark.alias("mark")))

    spans = F.sort_array(F.concat(*(named(k) for k in (*KINDS, "term", "far_term"))))

    def step(state: Column, s: Column) -> Column:
        between = F.substring(F.col("text"), state["at"] + 1, F.greatest(F.lit(0), s["start"] - state["at"]).cast("int"))
        new = s["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], s["end"].cast("int")).alias("at"),
            F.when(new, F.concat(state["parts"], F.array(between, s["mark"]))).otherwise(state["parts"]).alias("parts"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def finish(state: Column) -> Column:
        rest = F.substring(F.col("text"), state["at"] + 1, F.length("text"))
        return F.concat(F.array_join(state["parts"], ""), rest)

    return F.when(F.size(spans) == 0, F.col("text")).otherwise(F.aggregate(spans, begin, step, finish))


def sanitize(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with its text column sanitised; a null text stays null."""
    found = find(docs, text, **options)
    cleaned = F.when(F.col("row")[text].isNotNull(), sanitized_text())
    return found.select(*(
        (cleaned if name == text else F.col("row")[name]).alias(name) for name in docs.columns
    ))
