"""Token lookups, lemmas, true-casing, entities and lexicons; small and large table paths."""

import random

import pytest
from pyspark.sql import functions as F

from shelfsift.functions.text import clean_text, split_tokens
from shelfsift.operators.lemmas import corpus_dictionary, preprocess
from shelfsift.operators.lexicon import lexicon_counts, lexicon_matches
from shelfsift.operators.token_map import drop_tokens, map_tokens
from shelfsift.operators.truecase import capitalised_entities, gazetteer_entities, surface_forms, truecase

ROWS = [(0, ["a", "b", "a", "c"]), (1, []), (2, None), (3, ["b"]), (4, ["z", "c"])]


@pytest.fixture(scope="module")
def tokens(spark):
    return spark.createDataFrame(ROWS, "product_id bigint, tokens array<string>").repartition(2)


@pytest.mark.parametrize("limit", [100, 0])
def test_map_tokens(spark, tokens, limit):
    table = spark.createDataFrame([("a", "A"), ("c", None)], "token string, value string")
    rows = {r["product_id"]: r["tokens"] for r in map_tokens(tokens, "tokens", table, limit=limit).collect()}
    assert rows == {0: ["A", "b", "A"], 1: [], 2: [], 3: ["b"], 4: ["z"]}


@pytest.mark.parametrize("limit", [100, 0])
def test_drop_tokens_keeps_the_rest(spark, tokens, limit):
    words = spark.createDataFrame([("b",), ("b",)], "word string")
    rows = {r["product_id"]: r["kept"] for r in drop_tokens(tokens, "tokens", words, output="kept", limit=limit).collect()}
    assert rows[0] == ["a", "a", "c"] and rows[3] == [] and rows[4] == ["z", "c"]


@pytest.mark.parametrize("limit,frequent", [(100, 5), (0, 5), (0, 0), (0, 1)])
def test_repeated_ids_repeated_keys_and_nulls(spark, limit, frequent):
    """The same rows on every path: repeated and null ids, null tokens, repeated and null table keys."""
    rows = [(1, ["a", "b"]), (1, ["a", "a", "c"]), (None, ["a"]), (2, ["b", None, "d"]), (2, ["b", None, "d"]), (3, None)]
    frame = spark.createDataFrame(rows, "product_id bigint, tokens array<string>")
    table = spark.createDataFrame(
        [("a", "z"), ("a", "y"), ("a", None), ("b", None), ("b", None), (None, "n"), ("c", "a")], "t string, v string"
    )
    found = map_tokens(frame, "tokens", table, limit=limit, frequent=frequent).collect()
    want = [(1, ["y"]), (1, ["y", "y", "a"]), (None, ["y"]), (2, [None, "d"]), (2, [None, "d"]), (3, [])]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))


def test_empty_table_changes_nothing(spark, tokens):
    table = spark.createDataFrame([], "token string, value string")
    rows = {r["product_id"]: r["tokens"] for r in map_tokens(tokens, "tokens", table).collect()}
    assert rows == {key: words or [] for key, words in ROWS}


def test_both_paths_agree_with_a_hot_token(spark):
    rng = random.Random(7)
    rows = [(i, ["hot"] * rng.randint(0, 30) + [f"w{rng.randint(0, 50)}" for _ in range(rng.randint(0, 40))]) for i in range(200)]
    frame = spark.createDataFrame(rows, "product_id bigint, tokens array<string>").repartition(4)
    table = spark.createDataFrame([("hot", "H")] + [(f"w{i}", f"v{i}" if i % 3 else None) for i in range(0, 50, 2)], "k string, v string")
    found = {path: sorted(map_tokens(frame, "tokens", table, limit=path).collect()) for path in (1000, 0)}
    assert found[1000] == found[0]
    lookup = {row["k"]: row["v"] for row in table.collect()}
    want = {i: [lookup.get(t, t) for t in words if lookup.get(t, t) is not None] for i, words in rows}
    assert {r["product_id"]: r["tokens"] for r in found[0]} == want


@pytest.mark.parametrize("hot", [1, 3, 10**9])
def test_lists_that_many_rows_share(spark, monkeypatch, hot):
    """A third of the rows have one list, another third none: the same rows whether lists are hot or not."""
    from shelfsift.operators import token_map

    monkeypatch.setattr(token_map, "HOT", hot)
    lists = [["a", "b", None, "a"], [], None, ["b"], ["c", "d"], ["x"]]
    rows = [(i, lists[0] if i % 3 == 0 else lists[1 + i % 2] if i % 3 == 1 else lists[3 + i % 3]) for i in range(60)]
    frame = spark.createDataFrame([(*r, "text") for r in rows], "product_id bigint, tokens array<string>, _map string").drop("_map")
    table = spark.createDataFrame([("a", "A"), ("b", None), ("c", "C"), ("never", "x")], "k string, v string")
    lookup = {"a": "A", "b": None, "c": "C"}
    want = sorted((i, [lookup.get(t, t) for t in ts or [] if lookup.get(t, t) is not None or t is None]) for i, ts in rows)
    for limit, frequent in ((0, 0), (0, 1), (2, 1), (3, 1), (100, 1)):
        assert sorted(map(tuple, map_tokens(frame, "tokens", table, limit=limit, frequent=frequent).collect())) == want


def test_corpus_dictionary(spark):
    words = "cat cats box boxes party parties walk walking walked red bus as bass ones one".split()
    frame = spark.createDataFrame([(words,)], "words array<string>")
    found = {r["form"]: r["lemma"] for r in corpus_dictionary(frame, "words").collect()}
    assert found == {
        "cats": "cat", "boxes": "box", "parties": "party", "walking": "walk", "walked": "walk", "ones": "one"
    }


def test_dictionary_rule_order(spark):
    # both "ax" (es rule) and "axe" (s rule) exist with three letters or more: the earlier rule wins
    frame = spark.createDataFrame([(["axes", "axx", "axxes", "axxe"],)], "words array<string>")
    assert [tuple(r) for r in corpus_dictionary(frame, "words").collect()] == [("axxes", "axx")]


@pytest.mark.parametrize("limit", [100, 0])
def test_preprocess_order(spark, texts, limit):
    lemmas = spark.createDataFrame([("jeans", "jean"), ("was", "be"), ("tops", "cannot")], "form string, lemma string")
    frame = texts(["The Jeans was NICE! http://a.b", "tops"])
    rows = {r["product_id"]: r["tokens"] for r in preprocess(frame, dictionary=lemmas, limit=limit).collect()}
    assert rows == {0: ["jean", "nice"], 1: []}  # lemma first, then contractions, then stop words
    plain = {r["product_id"]: r["tokens"] for r in preprocess(frame).collect()}
    assert plain[0] == ["jeans", "nice"]
    kept = {r["product_id"]: r["tokens"] for r in preprocess(frame, remove_stop=False).collect()}
    assert kept[0] == ["the", "jeans", "was", "nice"]


def test_surface_forms_and_truecase(spark, texts):
    frame = texts(["Nike nike NIKE Nike top", "Top top2 Zara zara"])
    forms = {r["lower_form"]: (r["best_form"], r["n"]) for r in surface_forms(frame).collect()}
    assert forms == {"nike": ("Nike", 2), "top": ("top", 2), "zara": ("zara", 1)}
    low = spark.createDataFrame([(0, ["nike", "top", "zara", ""])], "product_id bigint, cased array<string>")
    assert truecase(low, "cased", surface_forms(frame)).first()["cased"] == ["Nike", "top", "zara", ""]


def test_capitalised_entities(spark):
    frame = spark.createDataFrame([(["Luxe", "top", "M", "Luxe"],)], "t array<string>")
    row = frame.select(capitalised_entities(F.col("t")), capitalised_entities(F.col("t"), dedupe=False)).first()
    assert row[0] == ["Luxe", "M"] and row[1] == ["Luxe", "M", "Luxe"]


@pytest.mark.parametrize("limit", [100, 0])
def test_gazetteer_matches_whole_runs(spark, limit):
    rows = [(0, "new balance shoes new york".split()), (1, ["balance", "new"]), (2, []), (3, ["new", "york", "new", "york"])]
    frame = spark.createDataFrame(rows, "product_id bigint, words array<string>")
    names = spark.createDataFrame([("new balance",), ("york",), ("new york city",), (None,)], "name string")
    found = sorted(tuple(r) for r in gazetteer_entities(frame, "words", names, limit=limit).collect())
    assert found == [(0, "new balance"), (0, "york"), (3, "york")]


def runs_in(words, names):
    return {n for n in names for at in range(len(words)) if words[at : at + len(n.split(" "))] == n.split(" ")}


def test_many_names_that_share_a_first_word(spark):
    """100,000 names begin with the word that every row holds; each meets the places of its rarest word only."""
    chance = random.Random(8)
    names = [f"the shop{k}" for k in range(100_000)] + ["the the", "the old the", "of the old", "old of shop7"]
    rows = [
        (i, [w for _ in range(chance.randrange(12)) for w in ("the", chance.choice(["old", "of", f"shop{chance.randrange(40)}"]))])
        for i in range(60)
    ]
    frame = spark.createDataFrame(rows, "product_id bigint, words array<string>")
    table = spark.createDataFrame([(n,) for n in names], "name string")
    found = gazetteer_entities(frame, "words", table, limit=0).collect()
    assert len(found) == len(set(found))
    few = [n for n in names if n.split(" ")[-1] in {w for _, words in rows for w in words}]
    assert set(map(tuple, found)) == {(i, n) for i, words in rows for n in runs_in(words, few)}


def test_gazetteer_paths_agree(spark):
    chance = random.Random(4)
    word = lambda: chance.choice(["a", "b", "c", "", None, "d e"])
    rows = [(chance.choice([i, 1, None]), [word() for _ in range(chance.randrange(9))]) for i in range(60)] + [(5, None)]
    names = {" ".join(chance.choice(["a", "b", "c", "z", ""]) for _ in range(chance.randint(1, 3))) for _ in range(40)}
    frame = spark.createDataFrame(rows, "product_id bigint, words array<string>")
    table = spark.createDataFrame([(n,) for n in names], "name string")
    both = [set(map(tuple, gazetteer_entities(frame, "words", table, limit=n).collect())) for n in (1000, 0)]
    assert both[0] == both[1] == {(i, n) for i, words in rows for n in runs_in(words or [], names)}


@pytest.mark.parametrize("limit", [1000, 0])
def test_lexicon_like_brute_force(spark, texts, limit):
    rng = random.Random(3)
    rows = ["".join(rng.choice("abcé \n😀") for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, "ABC"]
    terms = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 4))) for _ in range(25)})
    lexicon = spark.createDataFrame([(t,) for t in terms + terms[:3]], "term string")
    got = {tuple(r) for r in lexicon_matches(texts(rows), lexicon, limit=limit).collect()}
    want = {(i, t) for i, text in enumerate(rows) for t in terms if t in (text or "").lower()}
    assert got == want
    counts = {r["product_id"]: r["term_hits"] for r in lexicon_counts(texts(rows), lexicon, limit=limit).collect()}
    assert counts == {i: len([t for t in terms if t in (text or "").lower()]) for i, text in enumerate(rows)}


def test_long_and_short_terms(spark, texts):
    """A 1-letter and a 400-letter term: beginnings have at most 8 characters, whatever the terms."""
    from shelfsift.operators.lexicon_shards import KEY_LENGTHS

    chance = random.Random(5)
    text = "".join(chance.choice("abcdefgh") for _ in range(3000))
    lexicon = spark.createDataFrame([("a",), (text[100:500],), ("zz",)], "term string")
    plan = lexicon_matches(texts([text]), lexicon, limit=0)
    assert sorted(r["term"] for r in plan.collect()) == sorted(["a", text[100:500]])
    assert max(KEY_LENGTHS) == 8
    explained = plan._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in explained  # no stretches of the text are made


def test_empty_lexicon(spark, texts):
    lexicon = spark.createDataFrame([], "term string")
    assert [tuple(r) for r in lexicon_counts(texts(["a"]), lexicon).collect()] == [(0, 0)]


def test_small_table_path_does_not_shuffle_texts(spark, texts):
    frame = texts(["a b"]).select("product_id", split_tokens(clean_text(F.col("description"))).alias("tokens"))
    table = spark.createDataFrame([("a", "x")], "k string, v string")
    plan = map_tokens(frame, "tokens", table)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
