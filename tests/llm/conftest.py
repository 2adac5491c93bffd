import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def tokenizer():
    from shelfsift.llm.queries import tokenizer_path

    return tokenizer_path()


@pytest.fixture(scope="session")
def library(tokenizer):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer)


AWKWARD = [
    (1, "Plain text, twice.\nPlain text, twice."),
    (2, None),
    (3, ""),
    (4, "   \n\t "),
    (5, "l'été d'Œuvre <|endoftext|> ΑΣ Σ. 日本 👍🏽 é   x​y 1½²"),
    (6, "a" * 30_000),
    (7, "word " * 9_000),
    (None, "no id"),
    (9, "same id"),
    (9, "same id"),
    (9, "same id, other text"),
    (10, "x@y.zz 1.2.3.4"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, and further columns with clashing names."""
    rows = [(i, t, None if k % 3 else f"s{k % 2}", k, "x") for k, (i, t) in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_tokens int, start string")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
