"""Text columns against values worked out by hand and against plain Python."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfsift.fixed_values import ENGLISH_STOP_WORDS, TRANSLITERATIONS
from shelfsift.functions import text as X

EDGES = [
    "", "   ", "#", "a #b", "x #y \n", "x #y\n\n", "AWWW cute", "see http://x.y/z now", "café Café ÑANDÚ",
    "a b\x1cc d", "½ ² ٣ Ⅷ", "party 🎉 time", "tags: #nike #h&m Ignore: 80s", "vintage", "snake_case word",
    "www.shop.example", "httpx", "tab\tnew\nline\r\nend", "don't stop", "a-b/c", "\x85next",
]


def plain_clean(text):
    lowered = re.sub("(?:http|www)[^%s]+" % "".join(map(re.escape, BLANKS)), "", (text or "").lower())
    return " ".join("".join(c if c.isalnum() or c == "_" else " " for c in lowered).split())


BLANKS = [chr(code) for code in range(0x3001) if chr(code).isspace()]


def column(frame, expression, name="out"):
    rows = frame.select("product_id", expression.alias(name)).collect()
    return [row[name] for row in sorted(rows)]


def test_clean_text_by_hand(texts):
    # a URL needs at least one character behind its prefix, and no word boundary before it
    frame = texts(["AWWW cute", "AWWWW cute", "see http://x.y/z now", None, "tags: #nike #h&m Ignore: 80s", "½ ² ٣ Ⅷ", "a_b"])
    got = column(frame, X.clean_text(F.col("description")))
    assert got == ["awww cute", "a cute", "see now", "", "tags nike h m ignore 80s", "½ ² ٣ ⅷ", "a_b"]


def test_clean_text_like_plain_python(texts):
    got = column(texts(EDGES), X.clean_text(F.col("description")))
    assert got == [plain_clean(text) for text in EDGES]


ALPHABET = st.sampled_from(list("abzAZ019 _#&@:/.,'\t\n") + ["é", "ß", "ü", "½", "٣", "🎉", "́", " ", "\x1c", "http", "www"])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.lists(ALPHABET, max_size=30).map("".join), min_size=30, max_size=60))
def test_clean_text_property(texts, rows):
    frame = texts(rows)
    assert column(frame, X.clean_text(F.col("description"))) == [plain_clean(text) for text in rows]
    assert column(frame, X.split_tokens(X.clean_text(F.col("description")))) == [plain_clean(t).split() for t in rows]


def test_tokenize_splits_contractions(texts):
    frame = texts(["i cannot go", "gonna wanna gotta gimme lemme", "cannots xcannot wannabe", "", "Cannot"])
    assert column(frame, X.tokenize(F.col("description"))) == [
        ["i", "can", "not", "go"],
        ["gon", "na", "wan", "na", "got", "ta", "gim", "me", "lem", "me"],
        ["cannots", "xcannot", "wannabe"],
        [],
        ["Can", "not"],
    ]


def test_stop_words(texts):
    assert len(ENGLISH_STOP_WORDS) == len(set(ENGLISH_STOP_WORDS)) == 179
    frame = texts(["The cat and The hat", "the", ""])
    kept = X.remove_stopwords(X.split_tokens(F.col("description")))
    assert column(frame, kept) == [["cat", "hat"], [], []]
    assert column(frame, X.remove_stopwords(X.split_tokens(F.col("description")), ["cat"]))[0] == ["The", "and", "The", "hat"]


def test_notebook_cleaning(texts):
    frame = texts(
        [
            "I'm 5'1 (see last pic)  high-waisted; size 0 / waist 23!",
            "Crème BRÛLÉE straße £15",
            "h&m + zara\ttop",
            "Café – “nice”",
            "½ off",
            None,
            "日本",
        ]
    )
    assert column(frame, X.clean_description(F.col("description"))) == [
        "im 51 see last pic high waisted size 0 waist 23",
        "creme brulee strasse PS15",
        "h&m zaratop",
        "cafe nice",
        "12 off",
        "",
        "",
    ]
    assert column(frame, X.surface_text(F.col("description")))[1] == "Creme BRULEE strasse PS15"
    assert column(frame, X.drop_digits(X.clean_description(F.col("description"))))[0] == "im  see last pic high waisted size  waist "


@pytest.mark.parametrize("source,target", TRANSLITERATIONS)
def test_spelling_table_is_one_to_ascii(source, target):
    assert len(source) == 1 and target.isascii()


def test_to_ascii_uses_the_whole_table(texts):
    frame = texts([source for source, _ in TRANSLITERATIONS])
    assert column(frame, X.to_ascii(F.col("description"))) == [target for _, target in TRANSLITERATIONS]


def test_bigrams_and_vector_terms(texts):
    frame = texts(["One two THREE", "one", "", "h&m a big_top x2"])
    words = frame.select("product_id", X.vector_terms(F.col("description")).alias("words"))
    assert column(words, F.col("words")) == [["one", "two", "three"], ["one"], [], ["big_top", "x2"]]
    assert column(words, X.bigrams(F.col("words"))) == [["one two", "two three"], [], [], ["big_top x2"]]


def test_preview_and_label_names(texts):
    frame = texts(["x" * 50, "y" * 51])
    assert column(frame, X.preview(F.col("description"))) == ["x" * 50, "y" * 47 + "..."]
    assert column(frame, X.label_name(F.col("product_id"))) == ["Not Spam", "Spam"]
