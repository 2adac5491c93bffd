"""Metrics, splits, sampling, reports and hybrid scores."""

from hashlib import md5

import pytest
from pyspark.sql import functions as F

from shelfsift.operators.hybrid import combined_score, explain, with_hybrid
from shelfsift.operators.metrics import (
    class_counts,
    classification_metrics,
    classification_report,
    confusion_matrix,
    log_loss,
    model_comparison,
    threshold_label,
)
from shelfsift.operators.reports import number_rows, prediction_report
from shelfsift.operators.sampling import few_shot_examples, head_subset, rows_in, rows_not_in

# the published run: truth and prediction of its 20 rows
TRUTH = [1, 1, 1, 0, 0, 1, 1, 0, 0, 1, 0, 0, 0, 0, 0, 1, 1, 0, 1, 1]
GUESS = [1, 1, 1, 0, 0, 1, 1, 0, 0, 1, 0, 0, 0, 1, 0, 1, 1, 0, 1, 1]


@pytest.fixture(scope="module")
def pairs(spark):
    return lambda rows: spark.createDataFrame(rows, "label int, prediction int")


def test_published_run(pairs):
    row = classification_metrics(pairs(list(zip(TRUTH, GUESS)))).first()
    assert [round(row[m], 4) for m in ("accuracy", "precision", "recall", "f1_score")] == [0.95, 0.9091, 1.0, 0.9524]
    assert [row[m] for m in ("tn", "fp", "fn", "tp")] == [9, 1, 0, 10]


def test_one_sided_inputs(pairs):
    row = classification_metrics(pairs([(0, 0), (0, 1)])).first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1_score"]) == (0.5, 0.0, 0.0, 0.0)
    row = classification_metrics(pairs([(1, 0), (0, 0)])).first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1_score"]) == (0.5, 0.0, 0.0, 0.0)
    assert tuple(confusion_matrix(pairs([(1, 1)])).first()) == (0, 0, 0, 1)


def test_empty_input(pairs):
    row = classification_metrics(pairs([])).first()
    assert row["accuracy"] is None and row["f1_score"] == 0.0 and row["tp"] == 0


def test_report(pairs):
    rows = {r["class"]: r for r in classification_report(pairs([(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 1 + [(1, 0)] * 1)).collect()}
    assert [rows[c]["support"] for c in ("0", "1", "macro avg", "weighted avg")] == [4, 2, 6, 6]
    assert (rows["0"]["precision"], rows["0"]["recall"]) == (0.75, 0.75)
    assert (rows["1"]["precision"], rows["1"]["recall"], rows["1"]["f1_score"]) == (0.5, 0.5, 0.5)
    assert rows["macro avg"]["f1_score"] == 0.625
    assert abs(rows["weighted avg"]["f1_score"] - (0.75 * 4 + 0.5 * 2) / 6) < 1e-12


def test_model_comparison(spark):
    rows = [("a", 1, 1), ("a", 0, 1), ("b", 1, 0), ("b", 0, 0)]
    table = model_comparison(spark.createDataFrame(rows, "model string, label int, prediction int"), ["a", "b", "c"])
    found = {r["metric"]: (r["a"], r["b"], r["c"]) for r in table.collect()}
    assert found == {
        "accuracy": (0.5, 0.5, None), "precision": (0.5, 0.0, None), "recall": (1.0, 0.0, None),
        "f1_score": (2 / 3, 0.0, None),
    }


def test_log_loss(spark):
    frame = spark.createDataFrame([(1, 0.8), (0, 0.4)], "label int, probability double")
    assert abs(log_loss(frame).first()["logloss"] - 0.3669845875401002) < 1e-12
    certain = spark.createDataFrame([(1, 0.0), (0, 1.0)], "label int, probability double")
    assert 34 < log_loss(certain).first()["logloss"] < 35


def test_threshold_includes_its_value(spark):
    frame = spark.createDataFrame([(0.5,), (0.49999,)], "p double")
    assert [r[0] for r in frame.select(threshold_label(F.col("p"))).collect()] == [1, 0]


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, f"text {i}", 1 if i % 4 == 0 else 0) for i in range(40)]
    return spark.createDataFrame(rows, "product_id bigint, description string, label int").repartition(3)


def test_splits(spark, labelled):
    ids = spark.createDataFrame([(1,), (1,), (5,), (99,)], "product_id bigint")
    assert sorted(r["product_id"] for r in rows_in(labelled, ids).collect()) == [1, 5]
    assert rows_not_in(labelled, ids).count() == 38
    assert {r["label"]: r["n"] for r in class_counts(labelled).collect()} == {0: 30, 1: 10}
    assert [r["product_id"] for r in head_subset(labelled, 3).collect()] == [0, 1, 2]
    assert head_subset(labelled, 3, use_all=True).count() == 40
    assert head_subset(labelled, 100).count() == 40


@pytest.mark.parametrize("examples,per_class", [(8, 4), (5, 2), (1, 0), (60, 10)])
def test_few_shot_is_balanced_and_clamped(labelled, examples, per_class):
    rows = few_shot_examples(labelled, examples, seed=42).collect()
    assert sorted(r["place"] for r in rows) == list(range(1, 2 * per_class + 1))
    assert [r["label"] for r in rows].count("Spam") == per_class
    spam = sorted((md5(f"42:{i}".encode()).hexdigest(), i) for i in range(0, 40, 4))[:per_class]
    assert {r["product_id"] for r in rows if r["label"] == "Spam"} == {i for _, i in spam}


def test_few_shot_depends_on_seed_only(labelled):
    first, again = (sorted(few_shot_examples(labelled, 8, 42).collect()) for _ in range(2))
    assert first == again
    assert first != sorted(few_shot_examples(labelled, 8, 123).collect())
    other = labelled.where(F.col("label") == 0)
    assert few_shot_examples(other, 8).count() == 0
    extra = labelled.unionByName(labelled.limit(5).withColumn("label", F.lit(7)).withColumn("product_id", F.lit(1000) + F.col("product_id")))
    assert sorted(few_shot_examples(extra, 8, 42).collect()) == first


def test_report_numbers_everything(spark, labelled):
    guesses = labelled.select("product_id", F.lit(1).alias("prediction"))
    rows = sorted(prediction_report(labelled, guesses, use_all=True).collect())
    assert [r["row_number"] for r in rows] == list(range(1, 41))
    assert [r["product_id"] for r in rows] == list(range(40))
    assert (rows[0]["actual"], rows[1]["actual"], rows[1]["predicted"]) == ("Spam", "Not Spam", "Spam")
    assert prediction_report(labelled, guesses, rows=7).count() == 7


@pytest.mark.parametrize("buckets", [1, 2, 7, 500])
def test_number_rows_over_skewed_ids(spark, buckets):
    ids = [*range(300), *(10**12 + i * i for i in range(150)), -5]
    frame = spark.createDataFrame([(i,) for i in ids], "product_id bigint").repartition(5)
    rows = sorted((r["product_id"], r["row_number"]) for r in number_rows(frame, "product_id", buckets).collect())
    assert [n for _, n in rows] == list(range(1, len(ids) + 1))


def test_hybrid(spark):
    frame = spark.createDataFrame(
        [(1, "x" * 120, 1.0, 0.0, "no"), (2, "y", 0.2, 0.7, None), (3, "z", 0.5, 0.5, "half")],
        "product_id bigint, description string, classical_score double, llm_score double, llm_reasoning string",
    )
    rows = {r["product_id"]: r for r in explain(with_hybrid(frame)).collect()}
    assert [round(rows[i]["combined_score"], 9) for i in (1, 2, 3)] == [0.4, 0.5, 0.5]
    assert [rows[i]["is_spam"] for i in (1, 2, 3)] == [0, 1, 1]
    assert rows[1]["text"] == "x" * 100 + "..."
    with pytest.raises(ValueError):
        combined_score(F.lit(1.0), F.lit(1.0), 0, 0)


@pytest.mark.parametrize("row", [(None, 1), (1, None), (2, 1), (0, -1)])
def test_odd_labels_are_refused(spark, row):
    frame = spark.createDataFrame([(0, 0), row], "label int, prediction int")
    with pytest.raises(Exception, match="must be 0 or 1"):
        classification_metrics(frame).collect()
