"""Prompts, batched scoring, and reading the responses."""

import json

import pytest
from pyspark.sql import functions as F

from shelfsift.functions.prompts import block_text, built_in_examples, choose_examples, messages, user_prompt
from shelfsift.functions.responses import parse_responses
from shelfsift.operators.scoring import keyword_rule_scorer, score_with
from shelfsift.plans.jobs import score_listings

RESPONSES = [
    '{"is_spam": true, "spam_score": 0.9, "reasoning": "brands"}',
    'Sure!\n{"is_spam": false, "spam_score": 0.1}\nBye',
    "This is Spam, clearly",
    "all fine",
    "} {",
    "{'is_spam': true}",
    '{"is_spam": true,}',
    '{"is_spam": 1}',
    '{"is_spam": 0}',
    '{"is_spam": 0.0}',
    '{"is_spam": null}',
    '{"is_spam": ""}',
    '{"is_spam": "no"}',
    '{"is_spam": "false"}',
    '{"is_spam": []}',
    '{"is_spam": [0]}',
    '{"is_spam": {}}',
    '{"is_spam": {"a": 1}}',
    '{"spam_score": 0.3}',
    '{"a":1} t {"b":2}',
    '{"a":1}, {"b":2}',
    '{"a":1}], [{"b":2}',
    '{"is_spam": true, "spam_score": "0.75"}',
    '{"is_spam": true, "spam_score": null, "reasoning": null}',
    '{"note": {"is_spam": true}, "spam_score": 1}',
    "",
    None,
    '{"is_spam": -2.5e0, "spam_score": 1e-1}',
    '{"is_spam": true, "is_spam": false, "spam_score": 0.1, "spam_score": 0.2}',
    "[[{\"is_spam\": true}]]",
    '{"is_spam": true, "reasoning": "a } brace { inside"}',
    '{"is_spam": 9007199254740993, "spam_score": 0.123456789012345}',
]


def by_json(text):
    """What Python's own JSON reader makes of the first-brace-to-last-brace part."""
    if text is None:
        return 0, 0.0, "error"
    first, last = text.find("{"), text.rfind("}")
    if not 0 <= first < last:
        mentioned = "spam" in text.lower()
        return int(mentioned), 0.5 if mentioned else 0.0, "no_json"
    try:
        value = json.loads(text[first : last + 1])
    except ValueError:
        return 0, 0.0, "error"
    return int(bool(value.get("is_spam"))), float(value.get("spam_score") or 0.0), "ok"


def parsed(spark, rows, **options):
    frame = spark.createDataFrame(list(enumerate(rows)), "id int, response string")
    return sorted(parse_responses(frame, **options).collect())


def test_lenient_parse_like_python(spark):
    for row, text in zip(parsed(spark, RESPONSES), RESPONSES):
        assert (row["is_spam"], row["spam_score"], row["parse_status"]) == by_json(text), text


def test_reasons(spark):
    rows = parsed(spark, RESPONSES[:6] + [None, '{"reasoning": {"why": 1}}'])
    assert [r["reasoning"] for r in rows] == [
        "brands", None, "Failed to parse JSON response", "Failed to parse JSON response",
        "Failed to parse JSON response", "Error processing with LLM: invalid JSON",
        "Error processing with LLM: no response", '{"why":1}',
    ]


def test_strict_parse_takes_the_whole_response(spark):
    rows = parsed(spark, ['{"is_spam": true}', 'x {"is_spam": true}', "[1]", "spam", " {\"is_spam\": 1} "], lenient=False)
    assert [r["parse_status"] for r in rows] == ["ok", "error", "error", "error", "ok"]
    assert [r["is_spam"] for r in rows] == [1, 0, 0, 0, 1]


def test_scorer_error_wins(spark):
    frame = spark.createDataFrame([(1, None, "quota")], "id int, response string, e string")
    row = parse_responses(frame, error="e").first()
    assert (row["is_spam"], row["spam_score"], row["reasoning"]) == (0, 0.0, "Error processing with LLM: quota")


def test_built_in_block(spark):
    block = block_text(built_in_examples(spark))
    assert block.startswith("Description: Super cute high waisted blue jeans.")
    assert block.count("\n\nDescription: ") == 3 and block.count("Label: Not Spam") == 2 and block.endswith("Label: Spam")


def test_example_choice(spark):
    given = spark.createDataFrame([(2, "b", "Spam"), (1, "a", "Not Spam")], "place bigint, description string, label string")
    assert block_text(choose_examples(spark, given)) == "Description: a\nLabel: Not Spam\n\nDescription: b\nLabel: Spam"
    assert choose_examples(spark, None, given) is given
    assert choose_examples(spark).count() == 4


def test_prompt_layout(spark, texts):
    row = texts(["my top", None]).select(
        "product_id",
        user_prompt(F.col("description"), "BLOCK").alias("long"),
        user_prompt(F.col("description"), "BLOCK", long_form=False).alias("short"),
        messages(F.lit("U"), "S").alias("messages"),
    ).orderBy("product_id").collect()
    pad = " " * 16
    head = (
        f"\n{pad}Here are some examples of spam and non-spam product descriptions:\n{pad}\n{pad}BLOCK\n{pad}\n"
        f"{pad}Now, analyze this product description for keyword spam:\n{pad}\n{pad}Description: "
    )
    assert row[0]["short"] == f"{head}my top\n{pad}"
    assert row[0]["long"].startswith(f"{head}my top\n{pad}\n{pad}Respond with a JSON object containing:\n")
    assert row[0]["long"].endswith(f'3. "reasoning": brief explanation of your decision\n{pad}')
    assert row[1]["short"] == f"{head}\n{pad}"
    assert [tuple(m) for m in row[0]["messages"]] == [("system", "S"), ("user", "U")]


@pytest.mark.parametrize("batch_size", [1, 3, 5, 1000])
def test_every_row_is_scored_once(spark, texts, batch_size):
    frame = texts([f"t{i}" for i in range(57)]).repartition(4)

    def scorer(prompts):
        assert len(prompts) <= batch_size
        return [p.upper() for p in prompts]

    rows = score_with(frame, scorer, "description", batch_size=batch_size, concurrency=3).collect()
    assert sorted((r["product_id"], r["response"]) for r in rows) == [(i, f"T{i}") for i in range(57)]


def test_a_failing_row_does_not_take_its_batch_along(texts):
    def scorer(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("refused")
        return prompts

    rows = {r["product_id"]: r for r in score_with(texts(["a", "bad", "b"]).coalesce(1), scorer, "description").collect()}
    assert (rows[0]["response"], rows[2]["response"]) == ("a", "b")
    assert rows[1]["response"] is None and rows[1]["score_error"] == "refused"


def test_wrong_number_of_answers_is_an_error(texts):
    rows = score_with(texts(["a", "b"]).coalesce(1), lambda prompts: [], "description").collect()
    assert {r["score_error"] for r in rows} == {"0 responses for 1 prompts"}


def test_keyword_rule_reads_only_the_listing(spark, texts):
    frame = texts(["plain top", "nike adidas", "tags: a", None])
    rows = {r["product_id"]: r for r in score_listings(frame, keyword_rule_scorer).collect()}
    assert [rows[i]["is_spam"] for i in range(4)] == [0, 1, 1, 0]
    assert [rows[i]["spam_score"] for i in range(4)] == [0.0, 0.5, 0.75, 0.0]
    assert rows[1]["reasoning"] == "2 brands, 0 tag phrases" and rows[1]["parse_status"] == "ok"
