"""One query per operator, each over its whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsift.fixed_values import DESCRIPTION_SUFFIX, ENTITY_SUFFIX, THRESHOLD
from shelfsift.functions.features import LISTING_FEATURES, NOTEBOOK_FEATURES, with_listing_features, with_notebook_features
from shelfsift.functions.prompts import block_text, built_in_examples, few_shot_block, messages, user_prompt
from shelfsift.functions.responses import parse_responses
from shelfsift.functions.text import (
    bigrams,
    blank_split,
    clean_text,
    drop_digits,
    join_tokens,
    remove_stopwords,
    split_tokens,
    surface_text,
    tokenize,
    vector_terms,
)
from shelfsift.operators.casing_paths import fit_casing
from shelfsift.operators.html_cells import code_cells, code_like, page_scripts
from shelfsift.operators.hybrid import explain, with_hybrid
from shelfsift.operators.lemma_rules import learn_lemmas
from shelfsift.operators.lemmas import corpus_dictionary, lemmatised_description, lemmatize, preprocess
from shelfsift.operators.lexicon import lexicon_counts, lexicon_matches
from shelfsift.operators.metrics import (
    class_counts,
    classification_metrics,
    classification_report,
    confusion_matrix,
    log_loss,
    model_comparison,
    threshold_label,
)
from shelfsift.operators.reports import prediction_report
from shelfsift.operators.sampling import examples_of, few_shot_examples, head_subset, merge_states, rows_in, rows_not_in, sample_state
from shelfsift.operators.scoring import keyword_rule_scorer
from shelfsift.operators.tfidf import GRAM_SPEC, WORD_SPEC, TfidfSpec, fit_tfidf, vocabulary
from shelfsift.operators.truecase import capitalised_entities, gazetteer_entities, surface_forms, truecase
from shelfsift.plans.jobs import comparison_job, few_shot_job, hybrid_job, notebook_job, score_listings
from shelfsift.plans.models import (
    entity_terms,
    feature_importance,
    fit_boosted,
    fit_forest,
    forest_terms,
    forest_vectors,
    notebook_frame,
    prepared_listings,
    staged_log_loss,
    word_terms,
)
from shelfsift.plans.second_order import BoostSpec, fit_second_order
from shelfsift.plans.second_order import entries as vector_entries
from shelfsift.session import cut_lineage, new_folder, stored
from shelfsift.sources.listings import label_table, listings, read_listings, union_listings
from shelfsift.sources.pages import notebook_pages
from shelfsift.sources.sinks import write_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


def fixed_probability(key: str = "product_id") -> Column:
    return ((F.col(key) * 37) % 100 + 0.5) / 100


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    return listings(spark, folder, labelled=True).where(F.col("label").isNotNull())


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """Two rule models on every labelled listing: a tag section, or two tag phrases."""
    featured = with_listing_features(labelled(spark, folder), names=["tag_indicators", "has_tag_section"])
    models = F.array(
        F.struct(F.lit("tag_section").alias("model"), F.col("has_tag_section").cast("int").alias("prediction")),
        F.struct(F.lit("tag_phrases").alias("model"), (F.col("tag_indicators") >= 2).cast("int").alias("prediction")),
    )
    return featured.select("product_id", "label", F.inline(models))


# --- text ------------------------------------------------------------------------


@query
def clean_text_query(spark, folder):
    return listings(spark, folder).select("product_id", clean_text(F.col("description")).alias("clean_text"))


@query
def tokens(spark, folder):
    cleaned = listings(spark, folder).select("product_id", clean_text(F.col("description")).alias("clean"))
    split = cleaned.select("product_id", tokenize(F.col("clean")).alias("tokens"))
    return split.select(
        "product_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.concat_ws("|", "tokens").alias("tokens")
    )


@query
def remove_stopwords_query(spark, folder):
    cleaned = listings(spark, folder).select("product_id", clean_text(F.col("description")).alias("clean"))
    split = cleaned.select("product_id", tokenize(F.col("clean")).alias("tokens"))
    kept = split.select("product_id", remove_stopwords(F.col("tokens")).alias("kept"))
    return kept.select(
        "product_id", F.size("kept").cast("bigint").alias("n_kept"), join_tokens(F.col("kept")).alias("kept")
    )


def clean_words(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = listings(spark, folder).select("product_id", clean_text(F.col("description")).alias("clean"))
    return cleaned.select("product_id", split_tokens(F.col("clean")).alias("words"))


def dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus' own lemma table, written once because several steps look words up in it."""
    return cut_lineage(corpus_dictionary(clean_words(spark, folder), "words"))


@query
def lemma_dictionary(spark, folder):
    return corpus_dictionary(clean_words(spark, folder), "words")


@query
def lemmatize_dict(spark, folder):
    words = lemmatize(clean_words(spark, folder), "words", dictionary(spark, folder))
    return words.select("product_id", join_tokens(F.col("words")).alias("lemmas"))


@query
def preprocess_query(spark, folder):
    kept = preprocess(listings(spark, folder), dictionary=dictionary(spark, folder))
    return kept.select("product_id", join_tokens(F.col("tokens")).alias("preprocessed"))


def described(spark: SparkSession, folder: str) -> DataFrame:
    """The notebook path's cleaned descriptions, lemmas included."""
    cleaned = lemmatised_description(listings(spark, folder), dictionary(spark, folder))
    return cleaned.select("product_id", "clean_description")


@query
def lemma_rules(spark, folder):
    """Rewrites of endings that explain enough of the corpus' words."""
    rules, _ = learn_lemmas(clean_words(spark, folder), "words")
    return rules


@query
def lemma_learnt(spark, folder):
    _, learnt = learn_lemmas(clean_words(spark, folder), "words")
    return learnt


@query
def clean_description_query(spark, folder):
    return described(spark, folder)


@query
def drop_digits_query(spark, folder):
    return described(spark, folder).select("product_id", drop_digits(F.col("clean_description")).alias("letters"))


@query
def truecase_corpus(spark, folder):
    return surface_forms(listings(spark, folder))


def stored_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus' surface forms, written once because they are measured, then looked up."""
    return cut_lineage(surface_forms(listings(spark, folder)))


def cased_tokens(spark: SparkSession, folder: str) -> DataFrame:
    letters = described(spark, folder).select("product_id", drop_digits(F.col("clean_description")).alias("letters"))
    split = letters.select("product_id", blank_split(F.col("letters")).alias("cased"))
    return truecase(split, "cased", stored_forms(spark, folder))


@query
def truecase_text(spark, folder):
    return cased_tokens(spark, folder).select("product_id", join_tokens(F.col("cased")).alias("cased"))


@query
def truecase_context(spark, folder):
    """Each listing's words in the forms that fit their neighbours best."""
    letters = described(spark, folder).select("product_id", drop_digits(F.col("clean_description")).alias("letters"))
    split = letters.select("product_id", blank_split(F.col("letters")).alias("cased"))
    cased = fit_casing(listings(spark, folder)).apply(split, "cased")
    return cased.select("product_id", join_tokens(F.col("cased")).alias("cased"))


@query
def entity_tokens(spark, folder):
    return cased_tokens(spark, folder).select(
        "product_id", join_tokens(capitalised_entities(F.col("cased"))).alias("named_entities")
    )


def surface_words(spark: SparkSession, folder: str) -> DataFrame:
    words = listings(spark, folder).select("product_id", surface_text(F.col("description")).alias("surface"))
    return words.select("product_id", F.split("surface", " ").alias("words"))


def word_runs(words: str, count: int) -> Column:
    starts = F.slice(words, 1, F.greatest(F.size(words) - count + 1, F.lit(0)))
    return F.transform(starts, lambda _, i: F.array_join(F.slice(words, i + 1, count), " "))


@query
def entity_gazetteer(spark, folder):
    """Capitalised words of the benchmark passages as a name table, looked for in every listing."""
    passages = spark.read.parquet(f"{folder}/benchmark.parquet")
    names = passages.select(F.explode(F.split(surface_text(F.col("text")), " ")).alias("name"))
    return gazetteer_entities(surface_words(spark, folder), "words", names.where(F.col("name").rlike("^[A-Z]")))


@query
def entity_gazetteer_large(spark, folder):
    """All pairs and triples of words in the benchmark passages as names, by the path for tables of any size."""
    passages = spark.read.parquet(f"{folder}/benchmark.parquet")
    split = passages.select(F.split(surface_text(F.col("text")), " ").alias("w"))
    runs = [word_runs("w", n) for n in (2, 3)]
    names = split.select(F.explode(F.concat(*runs)).alias("name"))
    return gazetteer_entities(surface_words(spark, folder), "words", names, limit=0)


# --- features and lexicons -------------------------------------------------------


@query
def spam_features(spark, folder):
    featured = with_listing_features(listings(spark, folder)).select("product_id", *LISTING_FEATURES)
    return rounded(featured, "uppercase_ratio", "special_char_ratio", "hashtag_to_text_ratio", "keyword_density")


@query
def notebook_features(spark, folder):
    cleaned = described(spark, folder)
    return rounded(with_notebook_features(cleaned), *NOTEBOOK_FEATURES).drop("clean_description")


def part_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    part = spark.read.parquet(f"{folder}/part.parquet").select("p_name", "p_brand", "p_type")
    words = F.split(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")), " ")
    return part.select(F.explode(words).alias("term")).distinct()


@query
def lexicon_hits(spark, folder):
    return lexicon_counts(listings(spark, folder), part_lexicon(spark, folder))


@query
def lexicon_terms(spark, folder):
    found = lexicon_matches(listings(spark, folder), part_lexicon(spark, folder))
    return found.groupBy("term").agg(F.count("*").alias("listings"))


@query
def lexicon_terms_large(spark, folder):
    """The same by the path for lexicons of any size."""
    found = lexicon_matches(listings(spark, folder), part_lexicon(spark, folder), limit=0)
    return found.groupBy("term").agg(F.count("*").alias("listings"))


@query
def model_frame(spark, folder):
    cleaned = lemmatised_description(labelled(spark, folder), dictionary(spark, folder))
    featured = with_notebook_features(cleaned).drop("description", "clean_description", "split")
    return rounded(featured, *NOTEBOOK_FEATURES).withColumn("label", F.col("label").cast("bigint"))


# --- sets, joins, sampling -------------------------------------------------------


@query
def union_all(spark, folder):
    rows = listings(spark, folder)
    both = union_listings(rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test"))
    return both.select("product_id", "split", F.length("description").cast("bigint").alias("text_length"))


@query
def split_semi(spark, folder):
    kept = rows_in(listings(spark, folder), label_table(spark, folder))
    return kept.select("product_id", F.md5("description").alias("text_md5"))


@query
def split_anti(spark, folder):
    kept = rows_not_in(listings(spark, folder), label_table(spark, folder))
    return kept.select("product_id", F.md5("description").alias("text_md5"))


@query
def split_counts(spark, folder):
    counts = class_counts(listings(spark, folder, labelled=True), by=("split",))
    return counts.withColumn("label", F.col("label").cast("bigint"))


@query
def head_subset_query(spark, folder):
    return head_subset(listings(spark, folder)).select("product_id", "description")


@query
def few_shot_balanced(spark, folder):
    return few_shot_examples(labelled(spark, folder), examples=8).select("place", "product_id", "description", "label")


@query
def few_shot_merged(spark, folder):
    """The same picks from the merged samples of four parts."""
    rows = labelled(spark, folder)
    parts = [sample_state(rows.where(F.pmod(F.xxhash64("product_id"), F.lit(4)) == k), examples=8) for k in range(4)]
    halves = [merge_states(parts[:3], examples=8), parts[3]]
    return examples_of(merge_states(halves, examples=8)).select("place", "product_id", "description", "label")


@query
def csv_listings(spark, folder):
    """Listings written as a delimited file with line breaks in its fields, and read back by many tasks."""
    path = new_folder(spark, "csv-listings")
    rows = listings(spark, folder, labelled=True).select("product_id", "description", "label")
    write_table(rows, path, "csv")
    return read_listings(spark, path).select(
        "product_id", F.md5("description").alias("text_md5"), F.length("description").cast("bigint").alias("text_length"),
        F.col("label").cast("bigint").alias("label"),
    )


@query
def prediction_report_query(spark, folder):
    rows = labelled(spark, folder)
    predicted = with_listing_features(rows, names=["has_tag_section"]).select(
        "product_id", F.col("has_tag_section").alias("prediction")
    )
    return prediction_report(rows, predicted, use_all=True)


# --- TF-IDF ----------------------------------------------------------------------


def gram_terms(spark: SparkSession, folder: str) -> DataFrame:
    rows = listings(spark, folder).select("product_id", "description")
    return forest_terms(rows, GRAM_SPEC, dictionary(spark, folder), store=True)


def prepared_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All listings with what terms and hand features are made of, written once, and the lemmas used."""
    lemmas = dictionary(spark, folder)
    return stored(prepared_listings(listings(spark, folder).select("product_id", "description"), lemmas)), lemmas


def notebook_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = listings(spark, folder, labelled=True)
    return notebook_frame(rows, stored_forms(spark, folder), dictionary(spark, folder)).drop("description")


def description_terms(spark: SparkSession, folder: str) -> DataFrame:
    letters = described(spark, folder).select(
        "product_id", drop_digits(F.col("clean_description")).alias("clean_description")
    )
    return word_terms(stored(letters)).select("product_id", "terms")


def listing_entity_terms(spark: SparkSession, folder: str) -> DataFrame:
    return entity_terms(stored(entity_tokens(spark, folder))).select("product_id", "terms")


@query
def ngrams(spark, folder):
    words = listings(spark, folder).select("product_id", vector_terms(F.col("description")).alias("words"))
    pairs = words.select("product_id", bigrams(F.col("words")).alias("pairs"))
    return pairs.select(
        "product_id", F.size("pairs").cast("bigint").alias("n_pairs"), F.concat_ws("|", "pairs").alias("pairs")
    )


def vocabulary_of(terms: DataFrame, spec: TfidfSpec) -> DataFrame:
    return vocabulary(terms, spec).select("term", F.col("cf").cast("bigint"), F.col("df").cast("bigint"))


def weights_of(terms: DataFrame, spec: TfidfSpec, suffix: str = "") -> DataFrame:
    return rounded(fit_tfidf(terms, spec).long(terms, suffix=suffix), "tfidf")


@query
def vocab_rf(spark, folder):
    return vocabulary_of(gram_terms(spark, folder), GRAM_SPEC)


@query
def vocab_desc(spark, folder):
    return vocabulary_of(description_terms(spark, folder), WORD_SPEC)


@query
def tfidf_rf(spark, folder):
    return weights_of(gram_terms(spark, folder), GRAM_SPEC)


@query
def tfidf_desc(spark, folder):
    return weights_of(description_terms(spark, folder), WORD_SPEC, DESCRIPTION_SUFFIX)


@query
def tfidf_entities(spark, folder):
    return weights_of(listing_entity_terms(spark, folder), WORD_SPEC, ENTITY_SUFFIX)


def vector_summary(df: DataFrame, vector: str) -> list[Column]:
    values = F.unwrap_udt(vector)["values"]
    return [
        F.size(F.filter(values, lambda value: value != 0)).cast("bigint").alias("n_nonzero"),
        F.round(F.aggregate(values, F.lit(0.0), lambda total, value: total + value), 4).alias("total"),
    ]


@query
def feature_join(spark, folder):
    """Hand features and TF-IDF of the same row, side by side."""
    rows, lemmas = prepared_rows(spark, folder)
    terms = forest_terms(rows, GRAM_SPEC, lemmas)
    model = fit_tfidf(terms, GRAM_SPEC)
    joined = with_listing_features(model.with_vector(terms), names=["text_length", "word_count", "brand_count"])
    return joined.select(
        "product_id", "text_length", "word_count", "brand_count", *vector_summary(joined, "tfidf")
    )


@query
def feature_vector(spark, folder):
    rows, lemmas = prepared_rows(spark, folder)
    model = fit_tfidf(forest_terms(rows, GRAM_SPEC, lemmas), GRAM_SPEC)
    vectors = forest_vectors(rows, model, GRAM_SPEC, lemmas)
    return vectors.select("product_id", *vector_summary(vectors, "features"))


@query
def feature_vector_long(spark, folder):
    """The assembled vectors entry by entry: place and value."""
    rows, lemmas = prepared_rows(spark, folder)
    model = fit_tfidf(forest_terms(rows, GRAM_SPEC, lemmas), GRAM_SPEC)
    vectors = forest_vectors(rows, model, GRAM_SPEC, lemmas)
    entries = vectors.select("product_id", F.inline(vector_entries("features")))
    return entries.select("product_id", F.col("ix").cast("bigint").alias("ix"), F.round("value", 6).alias("value"))


# --- prompts, scoring, responses -------------------------------------------------


@query
def few_shot_block_query(spark, folder):
    return few_shot_block(few_shot_examples(labelled(spark, folder), examples=8))


@query
def prompts(spark, folder):
    block = block_text(built_in_examples(spark))
    rows = listings(spark, folder).select(
        "product_id",
        user_prompt(F.col("description"), block, long_form=False).alias("short"),
        user_prompt(F.col("description"), block).alias("long"),
    )
    asked = rows.select("product_id", "short", "long", messages(F.col("long")).alias("messages"))
    return asked.select(
        "product_id",
        F.md5("short").alias("short_md5"),
        F.md5("long").alias("long_md5"),
        F.length("long").cast("bigint").alias("long_length"),
        F.concat_ws(",", F.col("messages.role")).alias("roles"),
        F.md5(F.col("messages")[0]["content"]).alias("system_md5"),
    )


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Scorer answers of every shape, built from each listing's own text."""
    key, text = F.col("product_id"), F.col("description")
    score = F.concat(F.lit("0."), F.lpad((key % 100).cast("string"), 2, "0"))
    shapes = [
        F.concat(text, F.lit('\n{"is_spam": true, "spam_score": '), score, F.lit(', "reasoning": "doc '), key, F.lit('"}')),
        F.concat(F.lit('{"is_spam": false, "spam_score": '), score, F.lit("} "), text),
        text,
        F.concat(F.lit('{"is_spam": "no", "spam_score": "'), score, F.lit('", "reasoning": "x"}')),
        F.lit("{'is_spam': true}"),
        F.lit('Sure: {"is_spam": 1, "spam_score": 1}'),
        F.lit('{"is_spam": 0.0, "reasoning": null}'),
        F.lit('{"is_spam": [], "spam_score": null}'),
        F.lit('{"is_spam": [0], "spam_score": 0.5,}'),
        F.concat(F.lit('{"spam_score": '), score, F.lit(', "reasoning": {"why":"x"}}')),
        F.lit('{"is_spam": {}} t {"b": 2}'),
        F.lit(None).cast("string"),
        F.concat(F.lit("not SPAM } {"), F.replace(text, F.lit("}"), F.lit(""))),
    ]
    chosen = F.lit(None).cast("string")
    for number, shape in enumerate(shapes):
        chosen = F.when(key % len(shapes) == number, shape).otherwise(chosen)
    return listings(spark, folder).select("product_id", chosen.alias("response"))


@query
def llm_parse(spark, folder):
    parsed = parse_responses(responses(spark, folder)).drop("response")
    return rounded(parsed, "spam_score").withColumn("is_spam", F.col("is_spam").cast("bigint"))


@query
def llm_parse_strict(spark, folder):
    parsed = parse_responses(responses(spark, folder), lenient=False).drop("response")
    return rounded(parsed, "spam_score").withColumn("is_spam", F.col("is_spam").cast("bigint"))


@query
def score_batches(spark, folder):
    scored = score_listings(listings(spark, folder), keyword_rule_scorer)
    return rounded(scored, "spam_score").withColumn("is_spam", F.col("is_spam").cast("bigint"))


@query
def score_ledger(spark, folder):
    """The same through a ledger of responses, filled by one job and read by a second that asks for nothing."""
    ledger = (new_folder(spark, "score-ledger"), "keyword-rule-1")
    rows = listings(spark, folder)
    score_listings(rows, keyword_rule_scorer, ledger=ledger, batch_size=100)
    scored = score_listings(rows, _silent, ledger=ledger)
    return rounded(scored, "spam_score").withColumn("is_spam", F.col("is_spam").cast("bigint"))


def _silent(prompts: list) -> list[str]:
    raise RuntimeError("the ledger has every response")


@query
def hybrid_score(spark, folder):
    featured = with_listing_features(listings(spark, folder), names=["brand_count", "tag_indicators"])
    scored = featured.select(
        "product_id",
        "description",
        fixed_probability().alias("classical_score"),
        F.least(F.lit(1.0), (F.col("brand_count") + F.col("tag_indicators")) / 4).alias("llm_score"),
        F.concat(F.col("brand_count"), F.lit(" brands")).alias("llm_reasoning"),
    )
    explained = explain(with_hybrid(scored)).withColumn("is_spam", F.col("is_spam").cast("bigint"))
    return rounded(explained, "classical_score", "llm_score", "combined_score")


# --- metrics ---------------------------------------------------------------------


@query
def threshold_binary(spark, folder):
    rows = listings(spark, folder).select("product_id", F.round(fixed_probability(), 6).alias("probability"))
    return rows.withColumn("prediction", threshold_label(F.col("probability"), 0.505).cast("bigint"))


@query
def confusion_matrix_query(spark, folder):
    return confusion_matrix(judged(spark, folder), by=("model",))


@query
def classification_metrics_query(spark, folder):
    scored = classification_metrics(judged(spark, folder), by=("model",))
    return rounded(scored, "accuracy", "precision", "recall", "f1_score")


@query
def classification_report_query(spark, folder):
    return rounded(classification_report(judged(spark, folder), by=("model",)), "precision", "recall", "f1_score")


@query
def model_comparison_query(spark, folder):
    models = ["tag_section", "tag_phrases"]
    return rounded(model_comparison(judged(spark, folder), models), *models)


@query
def logloss(spark, folder):
    rows = labelled(spark, folder).withColumn("probability", fixed_probability())
    return rounded(log_loss(rows, by=("split",)), "logloss")


# --- HTML ------------------------------------------------------------------------


@query
def code_like_query(spark, folder):
    return notebook_pages(spark, folder).select("page_id", code_like(F.col("html")).cast("bigint").alias("code_like"))


@query
def code_cells_query(spark, folder):
    found = code_cells(notebook_pages(spark, folder))
    return found.select("page_id", F.col("tier").cast("bigint"), F.col("cell_ix").cast("bigint"), "code")


@query
def code_scripts(spark, folder):
    return page_scripts(notebook_pages(spark, folder))


# --- models and jobs -------------------------------------------------------------


def train_rows(spark: SparkSession, folder: str) -> DataFrame:
    return labelled(spark, folder).where(F.col("split") == "train")


def test_rows(spark: SparkSession, folder: str) -> DataFrame:
    return labelled(spark, folder).where(F.col("split") == "test")


@query
def rf_predictions(spark, folder):
    model = fit_forest(train_rows(spark, folder), dictionary(spark, folder))
    predicted = model.transform(listings(spark, folder))
    return rounded(predicted.select("product_id", "probability", "prediction"), "probability")


@query
def gbt_predictions(spark, folder):
    frame = cut_lineage(notebook_rows(spark, folder))
    predicted = fit_boosted(frame).transform(frame)
    return rounded(predicted.select("product_id", "split", "probability", "prediction"), "probability")


@query
def feature_importance_query(spark, folder):
    model = fit_boosted(cut_lineage(notebook_rows(spark, folder)))
    return rounded(feature_importance(spark, model), "feature_importance")


@query
def boosting_logloss(spark, folder):
    frame = cut_lineage(notebook_rows(spark, folder))
    known = frame.where(F.col("label").isNotNull())
    sides = {side: known.where(F.col("split") == side) for side in ("train", "test")}
    return rounded(staged_log_loss(fit_boosted(frame), sides), "logloss")


@query
def notebook_classifier_job(spark, folder):
    train, test = (rows(spark, folder).drop("split") for rows in (train_rows, test_rows))
    done = notebook_job(train, test, dictionary=dictionary(spark, folder))
    return rounded(done.metrics, "accuracy", "precision", "recall", "f1_score")


@query
def model_comparison_job(spark, folder):
    done = comparison_job(
        train_rows(spark, folder), test_rows(spark, folder), {"Keyword Rule": keyword_rule_scorer}, head_rows=None,
        dictionary=dictionary(spark, folder),
    )
    return rounded(done.comparison, "Random Forest", "Keyword Rule")


@query
def three_model_comparison_job(spark, folder):
    """The forest on all test listings, two scorers on the first 20 of them."""
    scorers = {"Keyword Rule": keyword_rule_scorer, "Tag Rule": tag_rule_scorer}
    done = comparison_job(
        train_rows(spark, folder), test_rows(spark, folder), scorers, dictionary=dictionary(spark, folder)
    )
    return rounded(done.comparison, "Random Forest", *scorers)


def tag_rule_scorer(prompts: list[str]) -> list[str]:
    """The keyword rule's answer with the score as the only say."""
    scores = [json.loads(answer)["spam_score"] for answer in keyword_rule_scorer(prompts)]
    return [json.dumps({"is_spam": score >= 0.5, "spam_score": score}) for score in scores]


@query
def few_shot_scoring_job(spark, folder):
    rows = labelled(spark, folder)
    done = few_shot_job(rows, keyword_rule_scorer, train=rows, use_all=True, num_few_shot=8)
    return rounded(done.metrics, "accuracy", "precision", "recall", "f1_score")


@query
def few_shot_scoring_report(spark, folder):
    rows = labelled(spark, folder)
    return few_shot_job(rows, keyword_rule_scorer, train=rows, use_all=True, num_few_shot=8).report


@query
def hybrid_evaluation_job(spark, folder):
    done = hybrid_job(
        train_rows(spark, folder), labelled(spark, folder), keyword_rule_scorer, dictionary=dictionary(spark, folder)
    )
    return rounded(done.metrics, "accuracy", "precision", "recall", "f1_score")


# --- what SQL can check of trained models ----------------------------------------


def prediction_checks(predicted: DataFrame) -> DataFrame:
    """For each listing: the prediction follows from the probability, which is one."""
    by_threshold = F.col("prediction") == (F.col("probability") >= THRESHOLD).cast("int")
    return predicted.select(
        "product_id", by_threshold.alias("by_threshold"), F.col("probability").between(0, 1).alias("in_range")
    )


@query
def rf_prediction_checks(spark, folder):
    model = fit_forest(train_rows(spark, folder), dictionary(spark, folder))
    return prediction_checks(model.transform(listings(spark, folder)))


@query
def gbt_prediction_checks(spark, folder):
    frame = cut_lineage(notebook_rows(spark, folder))
    return prediction_checks(fit_boosted(frame).transform(frame))


@query
def importance_checks(spark, folder):
    """How many inputs of each kind the boosted model names, and the sum of all importances."""
    table = feature_importance(spark, fit_boosted(cut_lineage(notebook_rows(spark, folder))))
    kind = F.when(F.col("feature_name").isin(*NOTEBOOK_FEATURES), "feature").when(
        F.col("feature_name").endswith(DESCRIPTION_SUFFIX), "description"
    )
    return table.agg(
        F.count(F.when(kind == "feature", 1)).alias("features"),
        F.count(F.when(kind == "description", 1)).alias("description_terms"),
        F.round(F.sum("feature_importance"), 6).alias("total"),
    )


def second_order_model(spark: SparkSession, folder: str):
    frame = cut_lineage(notebook_rows(spark, folder))
    return frame, fit_boosted(frame, second_order=True)


@query
def boosted_predictions(spark, folder):
    """Second-order boosted trees on every listing."""
    frame, model = second_order_model(spark, folder)
    return model.transform(frame).select("product_id", F.round("probability", 6).alias("probability"), "prediction")


@query
def boosting_gains(spark, folder):
    """Importance by the mean gain of a feature's splits."""
    frame, model = second_order_model(spark, folder)
    return rounded(feature_importance(spark, model), "feature_importance")


# hand features with few values, so that every value is a bin
FEW_VALUED = ["contains_ignore", "contains_hashtags_at_end", "brand_count", "tag_indicators", "has_tag_section"]


@query
def boosting_root_split(spark, folder):
    """The first split of the first round over five hand features: gain and leaf weights."""
    rows = with_listing_features(labelled(spark, folder), names=FEW_VALUED)
    numbers = F.array(*(F.col(name).cast("double") for name in FEW_VALUED))
    vectors = rows.select("label", array_to_vector(numbers).alias("features"))
    nodes = fit_second_order(vectors, BoostSpec(rounds=1, depth=1)).node_table(spark, FEW_VALUED)
    return rounded(nodes.select("node", "feature_name", "threshold", "gain", "cover", "weight"), "gain", "cover", "weight")


@query
def job_scorer_checks(spark, folder):
    """The scorer's side of the comparison and hybrid jobs, which no training touches, and each model's row count."""
    lemmas = dictionary(spark, folder)
    sides = {
        "comparison": comparison_job(
            train_rows(spark, folder), test_rows(spark, folder), {"LLM": keyword_rule_scorer}, head_rows=None,
            dictionary=lemmas, trees=10,
        ).judged,
        "hybrid": hybrid_job(
            train_rows(spark, folder), labelled(spark, folder), keyword_rule_scorer, dictionary=lemmas,
            trees=10,
        ).scored.select("label", F.inline(F.array(
            F.struct(F.lit("Random Forest").alias("model"), F.col("classical").alias("prediction")),
            F.struct(F.lit("LLM").alias("model"), F.col("llm").alias("prediction")),
        ))),
    }
    rows = None
    for job, judged_rows in sides.items():
        counted = confusion_matrix(judged_rows, by=("model",)).select(
            F.lit(job).alias("job"), "model", (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n"),
            F.when(F.col("model") == "LLM", F.col("tp")).alias("tp"),
            F.when(F.col("model") == "LLM", F.col("fp")).alias("fp"),
        )
        rows = counted if rows is None else rows.unionByName(counted)
    return rows


QUERIES = {name.removesuffix("_query"): build for name, build in QUERIES.items()}
