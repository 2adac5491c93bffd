"""Lemma rules from a corpus: hand-worked words, and a plain version."""

import random
from collections import Counter

import pytest

from shelfsift.operators.lemma_rules import explained, learn_lemmas, learn_rules, learnt_dictionary

STEMS = "walk talk look jump turn play".split()
WORDS = [s + e for s in STEMS for e in ("", "s", "ed", "ing")] + ["party", "parties", "city", "cities", "bake", "baking", "thing", "bus"]


def learnt(spark, words, **bounds):
    frame = spark.createDataFrame([(words[::2],), (words[1::2],), (words[:3],), (None,), ([None],)], "words array<string>")
    rules, dictionary = learn_lemmas(frame, "words", **bounds)
    return {(r[0], r[1]): (r[2], r[3]) for r in rules.collect()}, dict(map(tuple, dictionary.collect()))


def test_hand_worked(spark):
    rules, lemmas = learnt(spark, WORDS, least_words=2)
    # ten words end in s (8 stems long enough with bus, parties and cities), six of them have a base
    assert rules[("s", "")] == (6, 8)  # walks .. plays; parties and cities have no such base, bus is too short
    assert rules[("ed", "")] == (6, 6) and rules[("ing", "")] == (6, 7)  # baking has none; thing is too short
    assert rules[("ies", "y")] == (2, 2) and ("ing", "e") not in rules  # baking alone explains it
    assert lemmas == {s + e: s for s in STEMS for e in ("s", "ed", "ing")} | {"parties": "party", "cities": "city"}
    _, more = learnt(spark, WORDS, least_words=1, least_percent=1)
    assert more["baking"] == "bake" and "thing" not in more and "bus" not in more


def test_a_share_of_the_ending_is_needed(spark):
    words = ["abcd", "abcds", "efgh", "efghs"] + [f"{c}loss" for c in "bcdfg"]
    assert ("s", "") in learnt(spark, words, least_words=2, least_percent=20)[0]
    assert ("s", "") not in learnt(spark, words, least_words=2, least_percent=50)[0]


def by_hand(words, least_words, least_percent):
    every = set(words)
    found = set()
    for form in every:
        for n in range(1, 5):
            stem, ending = form[:-n], form[-n:]
            if len(stem) < 3:
                continue
            for base in every:
                rest = base[len(stem) :]
                if base.startswith(stem) and len(rest) < 2 and (rest == "" or (n > 1 and ending[0] != rest)):
                    found.add((form, ending, rest, base))
    explains = Counter((e, b) for _, e, b, _ in found)
    ends = Counter(w[-n:] for w in every for n in range(1, 5) if len(w) >= 3 + n)
    rules = {r: (k, ends[r[0]]) for r, k in explains.items() if k >= least_words and 100 * k >= least_percent * ends[r[0]]}
    lemmas = {}
    for form in every:
        ranked = sorted((-rules[e, b][0], -len(e), e, b, base) for f, e, b, base in found if f == form and (e, b) in rules)
        if ranked:
            lemmas[form] = ranked[0][-1]
    return rules, lemmas


@pytest.mark.parametrize("bounds", [(1, 1), (3, 20)])
def test_like_the_plain_version(spark, bounds):
    chance = random.Random(bounds[0])
    words = sorted({"".join(chance.choice("abé") for _ in range(chance.randint(1, 8))) for _ in range(400)})
    assert learnt(spark, words, least_words=bounds[0], least_percent=bounds[1]) == by_hand(words, *bounds)


def test_no_words(spark):
    words = spark.createDataFrame([], "word string")
    assert learn_rules(words, explained(words)).count() == 0
    assert learnt_dictionary(explained(words), learn_rules(words, explained(words))).count() == 0
