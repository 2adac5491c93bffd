"""Classifiers on MLlib: a forest over word pairs and hand features, boosted trees over notebook features."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasInputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsift.fixed_values import (
    BOOST_DEPTH,
    BOOST_ROUNDS,
    BOOST_STEP,
    DESCRIPTION_SUFFIX,
    ENGLISH_STOP_WORDS,
    ENTITY_SUFFIX,
    FOREST_DEPTH,
    FOREST_TREES,
    SEED,
    THRESHOLD,
)
from shelfsift.functions.features import LISTING_FEATURES, NOTEBOOK_FEATURES, with_listing_features, with_notebook_features
from shelfsift.functions.text import blank_split, clean_text, drop_digits, join_tokens
from shelfsift.operators.lemmas import lemmatised_description, preprocess
from shelfsift.operators.metrics import threshold_label
from shelfsift.operators.tfidf import GRAM_SPEC, WORD_SPEC, TfidfModel, TfidfSpec, fit_tfidf, with_terms
from shelfsift.operators.truecase import capitalised_entities, truecase
from shelfsift.plans.second_order import BoostSpec, SecondOrderModel, fit_second_order, gain_importance
from shelfsift.session import cut_lineage, stored


# What a task of MLlib's tree training may hold of the binned rows.
TASK_BYTES = 200_000_000


class ListingFeatures(Transformer, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The 14 hand-made features as an ML transformer; there is nothing to fit."""

    @keyword_only
    def __init__(self, inputCol: str = "description"):  # noqa: N803 (MLlib's spelling)
        super().__init__()
        self._set(inputCol=inputCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return with_listing_features(dataset, self.getInputCol())


def with_probability(df: DataFrame, threshold: float) -> DataFrame:
    """MLlib's probability vector to the probability of spam, and the label from the threshold upwards."""
    return (
        df.withColumn("probability", F.get(vector_to_array("probability"), F.lit(1)))
        .withColumn("prediction", threshold_label(F.col("probability"), threshold))
        .drop("rawPrediction", "features")
    )


def dealt(vectors: DataFrame, width: int, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Stored training vectors in enough partitions for MLlib, which holds each row as ``width`` whole numbers: at most
    ``task_bytes`` of them to a task. Vectors in enough partitions stay as they are."""
    needed = -(-4 * width * vectors.count() // task_bytes)
    return vectors.repartition(needed) if needed > vectors.rdd.getNumPartitions() else vectors


# --- forest ----------------------------------------------------------------------


@dataclass(frozen=True)
class ForestModel:
    tfidf: TfidfModel
    spec: TfidfSpec
    dictionary: DataFrame | None
    forest: RandomForestClassificationModel

    def transform(self, df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
        """Append ``probability`` (of spam) and ``prediction`` (0/1)."""
        vectors = forest_vectors(df, self.tfidf, self.spec, self.dictionary)
        return with_probability(self.forest.transform(vectors), threshold)

    def feature_names(self) -> list[str]:
        return [*self.tfidf.feature_names(), *LISTING_FEATURES]


def prepared_listings(df: DataFrame, dictionary: DataFrame | None, text: str = "description") -> DataFrame:
    """Append ``_cleaned``, the cleaned text, and ``_kept``, its tokens as a text: what terms and hand features are made of.

    Rows that have both come back as they are: prepare and write them (``stored``) where several steps read them."""
    if {"_cleaned", "_kept"} <= set(df.columns):
        return df
    cleaned = df.withColumn("_cleaned", clean_text(F.col(text)))
    prepared = preprocess(cleaned, text, "_kept", dictionary, clean_column="_cleaned")
    return prepared.withColumn("_kept", join_tokens(F.col("_kept")))


def forest_terms(
    df: DataFrame, spec: TfidfSpec, dictionary: DataFrame | None, text: str = "description", store: bool = False
) -> DataFrame:
    """Append ``terms``. With ``store``, the tokens are written first, without the text: terms are then read often."""
    prepared = prepared_listings(df, dictionary, text).drop("_cleaned")
    return _with_kept_terms(stored(prepared.drop(text)) if store else prepared, spec)


def _with_kept_terms(prepared: DataFrame, spec: TfidfSpec) -> DataFrame:
    return with_terms(prepared, F.col("_kept"), spec).drop("_kept")


def forest_vectors(
    df: DataFrame, tfidf: TfidfModel, spec: TfidfSpec = GRAM_SPEC, dictionary: DataFrame | None = None
) -> DataFrame:
    """Append ``features``: the TF-IDF vector and the 14 hand features, side by side in one row."""
    return _prepared_vectors(prepared_listings(df, dictionary), tfidf, spec)


def _prepared_vectors(prepared: DataFrame, tfidf: TfidfModel, spec: TfidfSpec) -> DataFrame:
    weighed = tfidf.with_vector(_with_kept_terms(prepared, spec)).drop("terms")
    featured = with_listing_features(weighed, cleaned="_cleaned").drop("_cleaned")
    assembler = VectorAssembler(inputCols=["tfidf", *LISTING_FEATURES], outputCol="features")
    return assembler.transform(featured).drop("tfidf", *LISTING_FEATURES)


def fit_forest(
    train: DataFrame,
    dictionary: DataFrame | None = None,
    spec: TfidfSpec = GRAM_SPEC,
    trees: int = FOREST_TREES,
    depth: int = FOREST_DEPTH,
    seed: int = SEED,
) -> ForestModel:
    """Vocabulary from the training texts, then the forest. ``train``: description, label (0/1).

    Texts are cleaned and lemmatised once; the vocabulary and the vectors read what was written then."""
    prepared = cut_lineage(prepared_listings(train.select("description", "label"), dictionary))
    tfidf = fit_tfidf(_with_kept_terms(prepared, spec), spec)
    vectors = cut_lineage(
        _prepared_vectors(prepared, tfidf, spec).select("features", F.col("label").cast("double").alias("label"))
    )
    vectors = dealt(vectors, len(tfidf.terms) + len(LISTING_FEATURES))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(vectors)
    return ForestModel(tfidf, spec, dictionary, forest)


# --- boosted trees ---------------------------------------------------------------


def notebook_frame(
    df: DataFrame,
    forms: DataFrame | None = None,
    dictionary: DataFrame | None = None,
    stop_words: list[str] = ENGLISH_STOP_WORDS,
) -> DataFrame:
    """Cleaned description, its three features, then the digit-free text and its entity words.

    ``forms`` is the surface-form table for true-casing; without it there are no capitals,
    so no entities.
    """
    cleaned = lemmatised_description(df, dictionary)
    featured = with_notebook_features(cleaned, stop_words=stop_words)
    letters = featured.withColumn("clean_description", drop_digits(F.col("clean_description")))
    cased = letters.withColumn("_cased", blank_split(F.col("clean_description")))
    if forms is not None:
        cased = truecase(cased, "_cased", forms)
    return cased.withColumn("named_entities", join_tokens(capitalised_entities(F.col("_cased")))).drop("_cased")


@dataclass(frozen=True)
class BoostedModel:
    entities: TfidfModel
    words: TfidfModel
    include_product_id: bool
    trees: GBTClassificationModel | SecondOrderModel
    stop_words: tuple[str, ...] = tuple(ENGLISH_STOP_WORDS)

    def vectors(self, frame: DataFrame) -> DataFrame:
        return boosted_vectors(frame, self.entities, self.words, self.include_product_id, self.stop_words)

    def transform(self, frame: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
        """Append ``probability`` and ``prediction`` to a notebook frame."""
        if isinstance(self.trees, SecondOrderModel):
            return self.trees.transform(self.vectors(frame), threshold).drop("features")
        return with_probability(self.trees.transform(self.vectors(frame)), threshold)

    def feature_names(self) -> list[str]:
        return [
            *boosted_columns(self.include_product_id),
            *self.entities.feature_names(ENTITY_SUFFIX),
            *self.words.feature_names(DESCRIPTION_SUFFIX),
        ]


def boosted_columns(include_product_id: bool) -> list[str]:
    return [*(["product_id"] if include_product_id else []), *NOTEBOOK_FEATURES]


def word_spec(stop_words: list[str] | tuple[str, ...] = ENGLISH_STOP_WORDS) -> TfidfSpec:
    """The notebook path's TF-IDF settings with a stop list of the caller's."""
    return replace(WORD_SPEC, stop_words=tuple(stop_words))


def entity_terms(frame: DataFrame, stop_words: list[str] = ENGLISH_STOP_WORDS) -> DataFrame:
    return with_terms(frame, F.col("named_entities"), word_spec(stop_words))


def word_terms(frame: DataFrame, stop_words: list[str] = ENGLISH_STOP_WORDS) -> DataFrame:
    return with_terms(frame, F.col("clean_description"), word_spec(stop_words))


def boosted_vectors(
    frame: DataFrame,
    entities: TfidfModel,
    words: TfidfModel,
    include_product_id: bool,
    stop_words: tuple[str, ...] = tuple(ENGLISH_STOP_WORDS),
) -> DataFrame:
    """Append ``features``; the texts they came from are dropped."""
    weighed = entities.with_vector(entity_terms(frame, stop_words), output="_entities").drop("terms")
    weighed = words.with_vector(word_terms(weighed, stop_words), output="_words").drop("terms")
    inputs = [*boosted_columns(include_product_id), "_entities", "_words"]
    assembled = VectorAssembler(inputCols=inputs, outputCol="features").transform(weighed)
    return assembled.drop("clean_description", "named_entities", "_entities", "_words")


def fit_boosted(
    frame: DataFrame,
    fit_on: str = "train",
    include_product_id: bool = False,
    rounds: int = BOOST_ROUNDS,
    depth: int = BOOST_DEPTH,
    step: float = BOOST_STEP,
    seed: int = SEED,
    stop_words: list[str] = ENGLISH_STOP_WORDS,
    second_order: bool = False,
) -> BoostedModel:
    """Boosted trees over a notebook frame with ``label`` and ``split``.

    MLlib's trees, or, with ``second_order``, trees that maximise the regularised second-order gain.

    Vocabularies come from all rows of the frame. The trees learn from the train rows, or,
    with ``fit_on="all"``, from the test rows as well.
    """
    if fit_on not in ("train", "all"):
        raise ValueError('fit_on is "train" or "all"')
    entities = fit_tfidf(entity_terms(frame, stop_words), word_spec(stop_words))
    words = fit_tfidf(word_terms(frame, stop_words), word_spec(stop_words))
    rows = frame.where(F.col("label").isNotNull())
    rows = rows if fit_on == "all" else rows.where(F.col("split") == "train")
    vectors = boosted_vectors(rows, entities, words, include_product_id, tuple(stop_words)).select(
        "features", F.col("label").cast("double").alias("label")
    )
    if second_order:  # which writes them itself
        fitted = fit_second_order(vectors, BoostSpec(rounds=rounds, depth=depth, step=step))
        return BoostedModel(entities, words, include_product_id, fitted, tuple(stop_words))
    width = len(boosted_columns(include_product_id)) + len(entities.terms) + len(words.terms)
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed).fit(dealt(cut_lineage(vectors), width))
    return BoostedModel(entities, words, include_product_id, trees, tuple(stop_words))


def staged_log_loss(model: BoostedModel, frames: dict[str, DataFrame]) -> DataFrame:
    """``round, dataset, logloss`` after each boosting round, on each labelled frame."""
    rows = []
    for name, frame in frames.items():
        labelled = model.vectors(frame).select("features", F.col("label").cast("double").alias("label"))
        if isinstance(model.trees, SecondOrderModel):
            losses = model.trees.staged_losses(labelled)
        else:  # MLlib's loss is twice the binomial log loss
            losses = [loss / 2 for loss in model.trees.evaluateEachIteration(labelled)]
        rows += [(number, name, loss) for number, loss in enumerate(losses)]
    spark = next(iter(frames.values())).sparkSession
    return spark.createDataFrame(rows, "round int, dataset string, logloss double")


def feature_importance(spark: SparkSession, model: ForestModel | BoostedModel) -> DataFrame:
    """``feature_name, feature_importance``, most important first (one row per model input).

    MLlib's normalised impurity gains, or of second-order trees the mean gain of a feature's splits as a share."""
    if isinstance(model, BoostedModel) and isinstance(model.trees, SecondOrderModel):
        nodes = model.trees.node_table(spark, model.feature_names())
        return gain_importance(nodes, model.feature_names()).select("feature_name", "feature_importance")
    trees = model.forest if isinstance(model, ForestModel) else model.trees
    rows = [(name, float(value)) for name, value in zip(model.feature_names(), trees.featureImportances.toArray())]
    table = spark.createDataFrame(rows, "feature_name string, feature_importance double")
    return table.orderBy(F.desc("feature_importance"), "feature_name")
