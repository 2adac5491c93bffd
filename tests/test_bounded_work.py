"""Steps that must not repeat work over the texts, nor hold more than a piece of what Spark sends."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

import registered.queries as queries
import shelfsift.operators.casing_paths as casing_paths
import shelfsift.operators.heavy_terms as heavy_terms
import shelfsift.operators.scoring as scoring
import shelfsift.operators.token_map as token_map
import shelfsift.operators.truecase as truecase
import shelfsift.plans.models as models
import shelfsift.plans.second_order as second_order
import shelfsift.session as session
from shelfsift.functions.features import with_listing_features
from shelfsift.llm import encoding
from shelfsift.operators.lemmas import lemmatised_description, preprocess
from shelfsift.operators.tfidf import GRAM_SPEC, fit_tfidf


def plan_of(df):
    return str(df._jdf.queryExecution().optimizedPlan())


@pytest.fixture
def written(monkeypatch):
    """The frames that a module writes with ``cut_lineage`` or ``stored``, by the plan they had."""

    def watch(module, name="cut_lineage"):
        plans, real = [], getattr(module, name)
        monkeypatch.setattr(module, name, lambda df, *rest: (plans.append(plan_of(df)), real(df, *rest))[1])
        return plans

    return watch


def test_terms_are_made_once_for_the_sketch(spark, written):
    rows = spark.createDataFrame([(0, "a b a"), (1, ""), (2, None)], "id int, text string")
    plans = written(heavy_terms)
    found = heavy_terms.candidates(rows.select(F.split("text", " ").alias("terms")), "terms", 5, tracked=64, buckets=2)
    assert not any("Filter" in plan for plan in plans)
    assert found.agg(F.sum("n")).first()[0] == 4


def test_prepared_rows_are_not_prepared_again(spark, texts):
    rows = texts(["red shoes for sale", "blue shoes", None, "red hat for sale"])
    prepared = session.stored(models.prepared_listings(rows, None))
    assert models.prepared_listings(prepared, None) is prepared
    terms = models.forest_terms(prepared, GRAM_SPEC, None)
    plain = models.forest_terms(rows, GRAM_SPEC, None)
    assert sorted(map(tuple, terms.select("product_id", "terms").collect())) == sorted(
        map(tuple, plain.select("product_id", "terms").collect())
    )
    model = fit_tfidf(plain, models.replace(GRAM_SPEC, min_df=1, max_df=1.0))
    vectors = [models.forest_vectors(df, model).orderBy("product_id").select("features").collect() for df in (rows, prepared)]
    assert vectors[0] == vectors[1]


def test_look_ups_go_piece_by_piece(spark, monkeypatch):
    monkeypatch.setattr(token_map, "PIECE", 3)
    lists = [["a", None, "b"], [], None, ["b"], ["a", "c", "a"], ["z"], ["b", "b"]]
    pieces = list(token_map._pieces(iter([pa.array(lists, pa.list_(pa.string())).slice(1)])))
    assert [len(ends) - 1 for _, ends in pieces] == [3, 3]
    frame = spark.createDataFrame([(i, words) for i, words in enumerate(lists)] * 400, "id int, words array<string>").coalesce(1)
    table = spark.createDataFrame([("a", "x"), ("b", None), (None, "n")], "token string, value string")
    found = {i: {tuple(w) for (w,) in rows} for i, rows in
             ((i, token_map.map_tokens(frame, "words", table).where(f"id = {i}").select("words").collect()) for i in range(7))}
    expected = [["x", None], [], [], [], ["x", "c", "x"], ["z"], []]
    assert found == {i: {tuple(words)} for i, words in enumerate(expected)}


def test_scoring_holds_a_piece(spark):
    asked = []

    def scorer(prompts):
        asked.extend(prompts)
        return ["yes"] * len(prompts)

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([str(i) for i in range(1000)])], ["product_id", "prompt"])
    answers = scoring.scored_pieces(iter([batch]), scorer, "prompt", ("product_id",), 5, None)
    assert next(answers).num_rows <= scoring.PIECE and len(asked) <= scoring.PIECE
    assert sum(part.num_rows for part in answers) + scoring.PIECE // 5 * 5 == 1000 and len(asked) == 1000


def test_boosting_reads_its_rows_once(spark, written):
    rows = spark.createDataFrame([(float(i % 2), str(i % 3)) for i in range(60)], "label double, text string")
    made = F.udf(lambda text: Vectors.dense([float(text), 1.0]), Vectors.dense([0.0]).__UDT__)
    plans = written(second_order)
    second_order.fit_second_order(rows.select("label", made("text").alias("features")), second_order.BoostSpec(rounds=1, depth=1))
    assert sum("text" in plan for plan in plans) == 1


def test_training_vectors_are_dealt(spark):
    rows = [(0.0, Vectors.dense([float(i)])) for i in range(100)]
    vectors = session.cut_lineage(spark.createDataFrame(rows, ["label", "features"]).coalesce(2))
    assert models.dealt(vectors, 100) is vectors
    many = models.dealt(vectors, 100, task_bytes=4000)
    assert many.rdd.getNumPartitions() == 10 and many.count() == 100


def test_only_places_that_fit_meet_the_rows(spark, written):
    rows = spark.createDataFrame([(i, ["x", "b", "y"] if i else ["a", "b", "c"]) for i in range(50)], "product_id bigint, words array<string>")
    names = spark.createDataFrame([("a b",), ("b c",), ("a b c",), ("b",), ("c b",)], "name string")
    plans = written(truecase, "sided")
    found = truecase.gazetteer_entities(rows, "words", names, limit=0)
    assert len(plans) == 1  # few names are copied to the places
    assert sorted(r["entity"] for r in found.collect() if not r["product_id"]) == ["a b", "a b c", "b", "b c"]
    assert found.where("product_id > 0").select("entity").distinct().collect() == [("b",)]


@pytest.mark.parametrize("seed", range(3))
def test_casing_with_copied_words_only(spark, texts, monkeypatch, seed):
    chance = random.Random(seed)
    words = ["new", "New", "york", "York", "shoes", "from", "From", "NEW"]
    corpus = [" ".join(chance.choice(words) for _ in range(chance.randrange(12))) for _ in range(40)]
    rows = [(i, [w.lower() if chance.random() < 0.9 else None for w in text.split()]) for i, text in enumerate(corpus)]
    frame = spark.createDataFrame([*rows, (99, None)], "product_id bigint, tokens array<string>")
    tables = casing_paths.fit_casing(texts(corpus))
    flat = tables.flat()
    limit = flat[0].count()
    assert flat[1].count() > limit
    found = [
        sorted((r["product_id"], r["tokens"]) for r in tables.apply(frame, "tokens", limit=n).collect()) for n in (10_000, limit, 0)
    ]
    assert found[0] == found[1] == found[2]


def test_stored_rows_are_whole(spark):
    rows = spark.createDataFrame([(1, ["a", None], None), (2, None, "x")], "id int, words array<string>, text string")
    kept = session.stored(rows)
    assert kept.schema == rows.schema and sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)


def test_pieces_by_bytes_like_the_pattern():
    chance = random.Random(5)
    signs = "ab é'ß÷ ! ,.-0 9\t\nß·ÿøx\x7f…"
    for _ in range(3000):
        text = "".join(chance.choice(signs) for _ in range(chance.randrange(14))).lower()
        if encoding._PLAIN.fullmatch(text):
            assert encoding._pieces_of(text) == encoding._PIECES.findall(text)
    assert encoding._pieces_of("a,b 12") == ["a", ",", "b", "1", "2"]


@pytest.mark.parametrize("limit", [100, 0])
@pytest.mark.parametrize("keep_empty", [True, False])
def test_words_of_a_text_like_their_tokens(spark, monkeypatch, limit, keep_empty):
    """The same texts as by lists of words: empty and null texts, empty words, replacements that drop or hold a blank."""
    monkeypatch.setattr(token_map, "PIECE", 2)
    texts = ["a b  c", "", None, " a", "c", "x é a ", "b b", "  "]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    table = spark.createDataFrame([("a", "A A"), ("c", None), ("b", "B"), ("", "E")], "t string, v string")
    split = F.split("text", " ")
    lists = frame.withColumn("words", split if keep_empty else F.array_remove(split, ""))
    want = token_map.map_tokens(lists, "words", table).select("id", F.concat_ws(" ", "words").alias("text"))
    got = token_map.map_words(frame, "text", table, keep_empty=keep_empty, limit=limit)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_lemmas_send_texts_not_lists(spark):
    """What goes to Python and back is one text a row."""
    frame = spark.createDataFrame([(1, "cats sat")], "product_id bigint, description string")
    table = spark.createDataFrame([("cats", "cat")], "form string, lemma string")
    for done in (lemmatised_description(frame, table), preprocess(frame, dictionary=table)):
        plan = done._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "concat_ws" not in plan


def test_tables_are_copied_by_their_bytes(spark):
    """A table of 250,000 short entries is copied: nothing of the rows is shuffled or written."""
    frame = spark.createDataFrame([(1, ["w7", "x", None, "w249999"])], "id int, words array<string>")
    table = spark.range(250_000).select(F.concat(F.lit("w"), "id").alias("t"), F.concat(F.lit("v"), "id").alias("v"))
    done = token_map.map_tokens(frame, "words", table)
    assert "Join" not in plan_of(done) and done.first()["words"] == ["v7", "x", None, "v249999"]


def test_look_ups_tell_equal_hashes_apart(monkeypatch):
    keys, values = ["a", "bb", "cc", "d", "e"], ["A", "B", None, "D", "E"]
    tokens = pa.array(["cc", "zz", "bb", "e", "a", "", "d", "q"])
    for hashes in (token_map._hashes, lambda found: np.array([len(t) for t in found.to_pylist()], np.int64)):
        monkeypatch.setattr(token_map, "_hashes", hashes)
        table = token_map.Table(pa.table({"token": pa.array(keys), "value": pa.array(values)}))
        found, got = table.find(tokens)
        assert found.to_pylist() == [True, False, True, True, True, False, True, False]
        assert got.to_pylist() == [None, None, "B", "E", "A", None, "D", None]


def test_token_lists_are_not_written(spark, monkeypatch):
    """By the path for tables of any size, only entries of the table are written, and only what a filter lets through travels."""
    rows = [(i, [f"u{i * 50 + k}" for k in range(50)] + ["a", None, "b" if i % 2 else "c"]) for i in range(60)]
    frame = spark.createDataFrame(rows, "id int, words array<string>")
    table = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", None), ("never", "x")], "token string, value string")
    counts, real = [], token_map.cut_lineage
    monkeypatch.setattr(token_map, "cut_lineage", lambda df: (kept := real(df), counts.append(kept.count()))[0])
    found = token_map.map_tokens(frame, "words", table, limit=1, frequent=1).collect()
    want = {i: [{"a": "A", "b": "B"}.get(t, t) for t in words if t != "c"] for i, words in rows}
    assert {r["id"]: r["words"] for r in found} == want
    assert max(counts) <= 60  # of 3,180 tokens
    entries = spark.createDataFrame([("b",), ("c",)], "t string").select(F.xxhash64("t").alias("_hash"))
    hashes = frame.withColumn("h", F.transform("words", lambda t: F.xxhash64(t)))
    passed = hashes.select(F.explode(token_map._passing(frame, entries)("h")).alias("_hash"))
    assert passed.join(entries, "_hash", "left_semi").count() == 60 and passed.count() < 200


def test_words_are_counted_beside_hashtags_only(spark, texts):
    rows = texts(["no tag at all", "#one two three", "", None, "a # b #c"])
    found = with_listing_features(rows, names=["hashtag_to_text_ratio"])
    assert [r[0] for r in found.orderBy("product_id").select("hashtag_to_text_ratio").collect()] == [0.0, 1 / 3, 0.0, 0.0, 0.5]
    plan = plan_of(found)
    assert plan.index("CASE WHEN") < plan.index("regexp_extract_all")


def test_job_checks_make_their_lemmas_once(spark, monkeypatch):
    made, given = [], []

    class Stop(Exception):
        pass

    def hybrid(*args, dictionary, **rest):
        given.append(dictionary)
        raise Stop

    def comparison(*args, dictionary, **rest):
        given.append(dictionary)
        return type("Done", (), {"judged": None})

    monkeypatch.setattr(queries, "dictionary", lambda *args: made.append("lemmas") or made[-1])
    monkeypatch.setattr(queries, "comparison_job", comparison)
    monkeypatch.setattr(queries, "hybrid_job", hybrid)
    monkeypatch.setattr(queries, "labelled", lambda *args: spark.createDataFrame([(1, "a", 1, "train")], "product_id int, description string, label int, split string"))
    with pytest.raises(Stop):
        queries.job_scorer_checks(spark, "")
    assert made == ["lemmas"] and given == made * 2
