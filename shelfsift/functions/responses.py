"""Reading scorer responses: JSON inside prose, fallbacks, scores and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsift.fixed_values import REASON_ERROR, REASON_NO_JSON, SCORE_NO_JSON_OTHER, SCORE_NO_JSON_SPAM

END_MARK = "#end-of-response#"


def json_part(response: Column) -> Column:
    """From the first ``{`` to the last ``}``; '' if there is no such stretch."""
    return F.regexp_extract(response, r"(?s)(\{.*\})", 1)


FIELDS = "end string, is_spam variant, spam_score variant, reasoning variant"


def parsed(json_text: Column) -> Column:
    """The answer's fields, or NULL if the text is not exactly one JSON object.

    A closing element after the object catches text behind it, which a parser would ignore. Reading into named fields
    takes the last value of a repeated key, whatever the session allows in variants.
    """
    listed = F.from_json(
        F.concat(F.lit("["), json_text, F.lit(f',{{"end":"{END_MARK}"}}]')),
        f"array<struct<{FIELDS.replace(' ', ':').replace(',:', ',')}>>",
        {"allowSingleQuotes": "false"},
    )
    whole = (F.size(listed) == 2) & (F.get(listed, F.lit(1))["end"] == END_MARK)
    return F.when(whole & F.ltrim(json_text).startswith("{"), F.get(listed, F.lit(0)))


def truthy(value: Column) -> Column:
    """Whether a JSON value counts as true: not null, false, 0, '', [] or {}. Any other text is true."""
    kind, text = F.schema_of_variant(value), value.cast("string")
    return (
        F.when(value.isNull() | (kind == "VOID"), False)
        .when(kind == "BOOLEAN", text == "true")
        .when(kind == "STRING", text != "")
        .when(kind.startswith("ARRAY"), text != "[]")
        .when(kind.startswith("OBJECT"), text != "{}")
        .otherwise(F.coalesce(text.try_cast("double") != 0, F.lit(False)))
    )


def parse_responses(
    df: DataFrame, response: str = "response", error: str | None = None, lenient: bool = True
) -> DataFrame:
    """Append ``is_spam`` (0/1), ``spam_score``, ``reasoning`` and ``parse_status``.

    ``lenient`` looks for the JSON object inside surrounding prose; strict takes the whole
    response. Statuses: ``ok``; ``no_json`` (label from whether "spam" is mentioned at all);
    ``error`` for broken JSON, a missing response, or a scorer error named in ``error``.
    """
    raw = F.col(response)
    failed = F.col(error) if error else F.lit(None).cast("string")
    found = json_part(raw) if lenient else raw
    # one step per projection, so each regex and each parse runs once per row
    parts = df.withColumn("_json", found).withColumn("_value", parsed(F.col("_json")))
    status = (
        F.when(failed.isNotNull() | raw.isNull(), "error")
        .when(F.lit(lenient) & (F.col("_json") == ""), "no_json")
        .when(F.col("_value").isNotNull(), "ok")
        .otherwise("error")
    )
    mentions = F.lower(raw).contains("spam")
    cause = F.coalesce(failed, F.when(raw.isNull(), "no response").otherwise("invalid JSON"))
    known = parts.withColumn("parse_status", status)
    ok, prose = F.col("parse_status") == "ok", F.col("parse_status") == "no_json"
    return known.withColumns(
        {
            "is_spam": F.when(ok, truthy(F.col("_value.is_spam"))).when(prose, mentions).otherwise(False).cast("int"),
            "spam_score": F.coalesce(
                F.when(ok, F.try_variant_get("_value.spam_score", "$", "double"))
                .when(prose & mentions, SCORE_NO_JSON_SPAM)
                .when(prose, SCORE_NO_JSON_OTHER),
                F.lit(0.0),
            ),
            "reasoning": F.when(ok, F.try_variant_get("_value.reasoning", "$", "string"))
            .when(prose, REASON_NO_JSON)
            .otherwise(F.concat(F.lit(f"{REASON_ERROR}: "), cause)),
        }
    ).drop("_json", "_value")
