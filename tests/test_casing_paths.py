"""True-casing in context: best paths against all paths, counts against counting by hand."""

import random
from collections import Counter, defaultdict
from itertools import product
from math import log

import pytest
from pyspark.sql import functions as F

from shelfsift.operators import casing_paths
from shelfsift.operators.casing_paths import START, Casing, fit_casing

CORPUS = [
    "New York style", "new shoes", "new shoes from New York", "New Balance shoes", "balance board", "YORK ham", "york 7 ham",
    "Turkey hat", "roast turkey", "roast turkey", "made in Turkey", "made in Turkey", "Made to order", None, "", "12 34",
]


def counted(rows):
    """Forms per word, pairs, and how often a form is followed."""
    lists = [["".join(c for c in w if not c.isdigit()) for w in (r or "").split()] for r in rows]
    lists = [[w for w in words if w] for words in lists]
    words = defaultdict(Counter)
    for w in (w for words_ in lists for w in words_):
        words[w.lower()][w] += 1
    pairs = Counter(p for words_ in lists for p in zip([START, *words_], words_))
    followed = Counter(w for words_ in lists for w in words_[:-1])
    return words, pairs, followed


def score(path, words, pairs, followed):
    total, before = 0.0, START
    for form in path:
        forms = words.get(form.lower(), {form: 1})
        share = forms[form] / sum(forms.values())
        total += log((pairs.get((before, form), 0) + share) / (followed.get(before, 0) + 1))
        before = form
    return total


def all_paths(row, words):
    return [list(p) for p in product(*(sorted(words.get(w, {w: 1})) for w in row))]


@pytest.mark.parametrize("limit", [1000, 0])
def test_like_all_paths(spark, texts, limit):
    chance = random.Random(limit)
    words, pairs, followed = counted(CORPUS)
    vocabulary = [*words, "unknown"]
    rows = [(i, [chance.choice(vocabulary) for _ in range(chance.randrange(9))]) for i in range(60)]
    frame = spark.createDataFrame(rows, "product_id bigint, tokens array<string>")
    found = {r["product_id"]: r["tokens"] for r in fit_casing(texts(CORPUS)).apply(frame, "tokens", limit=limit).collect()}
    assert len(found) == len(rows)
    for i, row in rows:
        assert [w.lower() for w in found[i]] == row
        best = max(score(p, words, pairs, followed) for p in all_paths(row, words))
        assert score(found[i], words, pairs, followed) == pytest.approx(best, abs=1e-9)


@pytest.mark.parametrize("limit", [1000, 0])
def test_neighbours_decide(spark, texts, limit):
    frame = spark.createDataFrame(
        [(0, "made in turkey".split()), (1, "roast turkey".split()), (2, "new york".split()), (3, "new shoes".split())],
        "product_id bigint, tokens array<string>",
    )
    rows = fit_casing(texts(CORPUS)).apply(frame, "tokens", "cased", limit=limit).orderBy("product_id").collect()
    assert [" ".join(r["cased"]) for r in rows] == ["made in Turkey", "roast turkey", "New York", "new shoes"]
    assert rows[0]["tokens"] == ["made", "in", "turkey"]


@pytest.mark.parametrize("limit", [1000, 0])
def test_nulls_and_empty_rows(spark, texts, limit):
    rows = [(0, None), (1, []), (2, ["new", None, "york"]), (2, ["new", None, "york"]), (None, [None, None]), (4, ["", "turkey"])]
    frame = spark.createDataFrame(rows, "product_id bigint, tokens array<string>")
    found = fit_casing(texts(CORPUS)).apply(frame, "tokens", limit=limit)
    both = sorted((repr(r["product_id"]), r["tokens"]) for r in found.collect())
    assert both[0] == ("0", []) and both[1] == ("1", []) and both[-1] == ("None", [None, None])
    assert both[2] == both[3] and both[2][1][1] is None and both[4][1][0] == ""


def test_no_corpus(spark, texts):
    tables = fit_casing(texts([]))
    frame = spark.createDataFrame([(0, ["new", "york"])], "product_id bigint, tokens array<string>")
    for limit in (1000, 0):
        assert tables.apply(frame, "tokens", limit=limit).first()["tokens"] == ["new", "york"]


def test_tables_hold_what_can_matter(spark, texts):
    tables = fit_casing(texts(CORPUS))
    words, pairs, followed = counted(CORPUS)
    got = {r["lower"]: Counter({f["form"]: f["n"] for f in r["forms"]}) for r in tables.words.collect()}
    assert got == {w: f for w, f in words.items() if len(f) > 1 or w not in f}
    several = {w for w, f in words.items() if len(f) > 1}
    kept = {(r["before"], r["form"]): r["n"] for r in tables.pairs.select(F.inline("pairs")).collect()}
    assert kept == {p: n for p, n in pairs.items() if several & {p[0].lower(), p[1].lower()}}
    assert {r["form"]: r["n"] for r in tables.followed.collect()} == {f: n for f, n in followed.items() if f.lower() in several}


def test_ties_go_to_the_greater_form_at_the_last_difference():
    casing = Casing([("a", "A", 1, 0), ("a", "a", 1, 0), ("b", "B", 1, 0), ("b", "b", 1, 0)], [])
    assert casing.best(["a", "b"]) == ["a", "b"]
    assert casing.best(["a", None, "b", "x"]) == ["a", None, "b", "x"]


def test_a_long_row(spark, texts):
    row = ["new", "york", "shoes", "turkey"] * 20_000
    frame = spark.createDataFrame([(0, row)], "product_id bigint, tokens array<string>")
    cased = fit_casing(texts(CORPUS)).apply(frame, "tokens").first()["tokens"]
    assert len(cased) == len(row) and cased[-4:-2] == ["New", "York"]


def test_rounding_like_round():
    chance = random.Random(2)
    scores = [chance.choice([1, -1]) * chance.random() * 10 ** chance.randrange(-13, 6) for _ in range(100_000)]
    scores += [chance.randrange(-10**15, 10**15) / 1e12 + 5e-13 for _ in range(50_000)] + [0.0, -0.0, 0.5, -1.5e-12, 2.5e-12]
    assert all(casing_paths.rounded(x) == round(x, 12) for x in scores)


def test_spellings_come_back(spark):
    words = ["new", "a", "h&m", "mcdonald", ""]
    forms = [(w, f) for w in words for f in {w, w.upper(), w[:1].upper() + w[1:], "McDonald" if w == "mcdonald" else w}]
    frame = spark.createDataFrame(forms, "lower string, form string")
    coded = frame.select("lower", "form", casing_paths._spelling(F.col("form"), "lower").alias("code")).collect()
    assert all(casing_paths.spelled(r["code"], r["lower"]) == r["form"] for r in coded)
    assert {r["code"] for r in coded} == {"", "^", "*", "McDonald"}


@pytest.mark.parametrize("limit", [None, 3, 0])
def test_pairs_do_not_travel_as_words(spark, texts, limit):
    """What a row asks with and what comes back is no list of words or forms, and the paths are those of all tables copied."""
    tables = fit_casing(texts(CORPUS))
    frame = spark.createDataFrame([(i, (text or "").lower().split()) for i, text in enumerate(CORPUS)], "product_id bigint, tokens array<string>")
    done = tables.apply(frame, "tokens", limit=limit)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct(transform" not in plan and "struct<place:int,before" not in plan
    want = tables.apply(frame, "tokens", limit=10_000)
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, want.collect()))
