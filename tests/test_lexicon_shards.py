"""Sharded automata: the terms of a large lexicon in texts, against looking for each."""

import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from shelfsift.operators import lexicon_shards
from shelfsift.operators.lexicon import lexicon_matches
from shelfsift.operators.lexicon_shards import Filter, _codes, _key_length, build_filter, sharded_matches, start_hashes


def found_in(spark, texts, terms, parts=5):
    frame = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "content string, text string").repartition(parts)
    lexicon = spark.createDataFrame([(t,) for t in terms], "term string")
    rows = sharded_matches(frame, lexicon).collect()
    assert len(rows) == len(set(rows))
    return set(map(tuple, rows))


def by_hand(texts, terms):
    return {(str(k), t) for k, text in enumerate(texts) for t in terms if t in text}


def random_terms(chance, count, letters="abcé日😀 "):
    return sorted({"".join(chance.choice(letters) for _ in range(chance.randint(1, 12))) for _ in range(count)})


@pytest.mark.parametrize("shard, visits", [(5, 4), (50, 1000)])
def test_like_looking_for_each_term(spark, monkeypatch, shard, visits):
    monkeypatch.setattr(lexicon_shards, "SHARD", shard)
    monkeypatch.setattr(lexicon_shards, "VISITS", visits)
    chance = random.Random(shard)
    terms = random_terms(chance, 300)
    texts = ["".join(chance.choice("abcé日😀 ") for _ in range(chance.randint(0, 300))) for _ in range(40)] + ["", "b", *terms[::40]]
    assert found_in(spark, texts, terms) == by_hand(texts, terms)


def test_terms_that_share_their_beginning(spark, monkeypatch):
    """A shard whose terms all begin alike has several automata."""
    monkeypatch.setattr(lexicon_shards, "SHARD", 10)
    terms = [f"beginning{k}" for k in range(100)] + ["end"]
    texts = ["x beginning7 beginning42 end", "beginnin", "beginning99beginning1", "nothing"]
    assert found_in(spark, texts, terms) == by_hand(texts, terms)


def test_borders_of_pieces(spark, monkeypatch):
    monkeypatch.setattr(lexicon_shards, "PIECE", 10)
    text = "".join(chr(97 + k % 26) for k in range(95))
    terms = [text[k : k + n] for k in range(80) for n in (1, 3, 8, 11)]
    made, _ = build_filter(spark.createDataFrame([(t,) for t in sorted(set(terms))], "term string"), len(set(terms)))
    for term in set(terms):
        own = start_hashes(_codes(term), _key_length(term))[:1]
        assert set(made.shard(own).tolist()) <= made.visits(text)


def test_a_text_of_megabytes(spark):
    chance = random.Random(2)
    text = "".join(chance.choice("abcdefgh") for _ in range(3_000_000))
    terms = [text[-30:], text[1 << 20 : (1 << 20) + 9], text[(1 << 20) - 4 : (1 << 20) + 4], "z", "hgfedcbahgfedcba"]
    assert found_in(spark, [text, "z"], terms) == by_hand([text, "z"], terms)


def test_few_texts_visit_a_shard_without_need(spark):
    """Hardly any text without a term passes the filter."""
    chance = random.Random(3)
    terms = sorted({"".join(chance.choice("abcdefghij") for _ in range(12)) for _ in range(3000)})
    made, kept = build_filter(spark.createDataFrame([(t,) for t in terms], "term string"), len(terms))
    assert kept.count() == len(terms) and made.lengths == [8]
    texts = ["".join(chance.choice("klmnopqrst") for _ in range(500)) for _ in range(50)]
    assert sum(bool(made.visits(t)) for t in texts) <= 10
    assert all(made.visits(t) for t in terms[:50])


@given(st.text(max_size=20), st.sampled_from([1, 2, 4, 8]))
def test_hashes_follow_the_stretches(text, length):
    hashes = start_hashes(_codes(text), length).tolist()
    assert hashes == [int(start_hashes(_codes(text[k : k + length]), length)[0]) for k in range(len(text) - length + 1)]


def test_places_use_all_bits():
    hashes = start_hashes(np.arange(5000, dtype=np.uint32), 1)
    first, second = Filter(12, 7, [1]).places(hashes)
    assert len(set(first.tolist())) > 2500 and len(set(second.tolist())) > 2500
    assert max(first.max(), second.max()) < 1 << 12


def test_no_terms_and_no_texts(spark):
    assert found_in(spark, ["a"], []) == set() and found_in(spark, [], ["a"]) == set()


def test_rows_with_equal_texts_and_ids(spark):
    frame = spark.createDataFrame([(1, "Red Top"), (1, "red top"), (None, "red top"), (2, None)], "product_id bigint, description string")
    lexicon = spark.createDataFrame([("red",), ("top",), ("",), (None,)], "term string")
    found = sorted(map(repr, map(tuple, lexicon_matches(frame, lexicon, limit=0).collect())))
    assert found == sorted(map(repr, [(1, "red"), (1, "top"), (None, "red"), (None, "top")]))
