from pyspark.sql import functions as F
from test_text import EDGES, plain_clean

from shelfsift.functions.features import (
    LISTING_FEATURES,
    with_listing_features,
    with_notebook_features,
)
from shelfsift.plans.models import ListingFeatures

BRANDS = {"nike", "adidas", "gucci", "chanel", "versace", "supreme", "zara", "h&m", "brandy", "melville"}


def expected(text):
    """The counts restated over characters and sets."""
    raw, low, words = text or "", (text or "").lower(), plain_clean(text).split()
    tail = raw.rstrip()
    end = len(tail)
    while end and (tail[end - 1].isalnum() or tail[end - 1] == "_"):
        end -= 1
    return {
        "text_length": len(raw),
        "clean_text_length": len(" ".join(words)),
        "word_count": len(words),
        "hashtag_count": raw.count("#"),
        "uppercase_ratio": len([c for c in raw if c.isupper()]) / (len(raw) or 1),
        "special_char_ratio": len([c for c in raw if not (c.isalnum() or c.isspace())]) / (len(raw) or 1),
        "hashtag_to_text_ratio": raw.count("#") / (len(raw.split()) or 1),
        "contains_ignore": int("ignore" in low),
        "contains_hashtags_at_end": int(0 < end < len(tail) and tail[end - 1] == "#"),
        "hashtag_section_length": len(raw) - raw.rfind("#") - 1 if "#" in raw else 0,
        "brand_count": len({b for b in BRANDS if b in low}),
        "tag_indicators": len({p for p in ("tag", "tags:", "tags", "tagged", "ignore:", "ignore") if p in low}),
        "keyword_density": len(set(words)) / (len(words) or 1),
        "has_tag_section": int(bool({m for m in ("tags:", "ignore:", "~ignore~", "tagged for exposure") if m in low})),
    }


def test_listing_features_like_plain_python(texts):
    cases = EDGES + [None, "tagged for exposure", "NIKE Supreme h&m Brandy Melville", "a#b#cd ef", "#é_1 "]
    rows = with_listing_features(texts(cases)).collect()
    assert len(rows) == len(cases)
    for row in rows:
        want = expected(cases[row["product_id"]])
        got = {name: row[name] for name in LISTING_FEATURES}
        assert got == want, repr(cases[row["product_id"]])


def test_overlapping_phrases(texts):
    rows = {r["product_id"]: r for r in with_listing_features(texts(["vintage", "tags:", "ignore:"])).collect()}
    assert [rows[i]["tag_indicators"] for i in range(3)] == [1, 3, 2]


def test_clean_text_is_computed_once(texts):
    plan = with_listing_features(texts(["a"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(http|www)") == 1


GOLDEN = (
    "super cute high waiste blue jean recommend for short petite girl I m 51 and it fit I perfect example show in last "
    "pic these be more of jegging than jean and have a polyester material inside only flaw the zipper go down by itself "
    "sometimes brand for exposure size 0 waist 23"
)
GOLDEN_STOP_WORDS = "for i and it show in last these be more of than have a only the go down by itself sometimes".split()


def test_notebook_golden_row(spark):
    frame = spark.createDataFrame([(1, GOLDEN)], "product_id bigint, clean_description string")
    row = with_notebook_features(frame, stop_words=GOLDEN_STOP_WORDS).first()
    assert round(row["average_length_of_word"], 6) == 4.169811
    assert round(row["proportion_of_numbers"], 6) == 0.056604
    assert round(row["proportion_of_stopwords"], 6) == 0.45283


def test_notebook_features_of_nothing(spark):
    frame = spark.createDataFrame([(1, ""), (2, None), (3, "12 the")], "product_id bigint, clean_description string")
    rows = {r["product_id"]: r[2:] for r in with_notebook_features(frame).collect()}
    assert rows[1] == rows[2] == (0.0, 0.0, 0.0)
    assert rows[3] == (0.5, 2.5, 0.5)


def test_features_by_name(texts):
    assert with_listing_features(texts(["a"]), names=["brand_count"]).columns == ["product_id", "description", "brand_count"]


def test_transformer_round_trip(texts, tmp_path):
    transformer = ListingFeatures(inputCol="description")
    path = str(tmp_path / "features")
    transformer.save(path)
    loaded = ListingFeatures.load(path)
    assert loaded.transform(texts(["#a"])).select(*LISTING_FEATURES).collect() == (
        with_listing_features(texts(["#a"])).select(*LISTING_FEATURES).collect()
    )
    assert loaded.transform(texts(["#a"])).where(F.col("hashtag_count") == 1).count() == 1
