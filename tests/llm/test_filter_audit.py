"""Filter interaction audit: lists against sets, whole tables against counting by hand."""

import random
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfsift.llm.filter_audit import FILTERS, audit, difference, gallop, own_filters, range_sizes, union

IDS = st.lists(st.integers(0, 60), unique=True).map(sorted)


@given(IDS, st.integers(-1, 62))
def test_gallop(ids, value):
    for start in range(len(ids) + 1):
        assert gallop(ids, value, start) == start + sum(i < value for i in ids[start:])


@given(st.lists(IDS, max_size=5))
def test_union(lists):
    assert union(lists) == sorted(set().union(*lists))


@given(IDS, IDS)
def test_difference(ids, other):
    assert difference(ids, other) == sorted(set(ids) - set(other))


@settings(max_examples=20, deadline=None)
@given(st.lists(IDS, min_size=5, max_size=5), IDS, IDS)
def test_range_sizes(lists, good, toxic):
    found = {(k, before): rest for k, before, *rest in range_sizes(lists, good, toxic)}
    assert len(found) == 5 * 16
    for (k, before), rest in found.items():
        gone = set().union(*(lists[j] for j in range(5) if before >> j & 1))
        removed = set(lists[k]) - gone
        assert rest == [len(removed), len(removed & set(good)), len(removed & set(toxic))]


def test_long_runs_are_copied_whole():
    low, high = list(range(100_000)), list(range(100_000, 200_000))
    assert union([high, low]) == low + high and difference(low, high) == low and difference(low, low) == []


@pytest.mark.parametrize(
    "text, bits",
    [
        ("", 1), (" \n\t ", 1), ("a", 1), ("a a a", 3), ("A a", 5), ("a #", 9),
        (" ".join(map(str, range(200))), 0), ("x" * 98 + "AB", 1), ("x" * 97 + "ABC", 5), ("a\x0bb\x1cc", 1),
        ("word " * 1_000_000 + "|", 10), ("É" * 3, 1),
    ],
)
def test_own_filters(text, bits):
    assert own_filters(text) == bits


def by_hand(docs, labels):
    """The whole result by going through every order and document."""
    texts, rows = {}, []
    for doc_id, text, source in docs:
        if doc_id is not None:
            texts.setdefault(text or "", []).append(doc_id)
    for doc_id, text, source in docs:
        fails = own_filters(text or "")
        if doc_id is not None and doc_id > min(texts[text or ""]):
            fails |= 16
        marks = [doc_id is not None and any(i == doc_id and m[k] == 1 for i, *m in labels) for k in (0, 1)]
        rows.append((source or "", fails, *marks))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        for order in permutations(range(5)):
            left = [r for r in rows if r[0] == part]
            every = list(left)
            for step, k in enumerate(order, 1):
                gone = [r for r in left if r[1] >> k & 1]
                left = [r for r in left if not r[1] >> k & 1]
                failing = [r for r in every if r[1] >> k & 1]
                shapley[part, k] = shapley.get((part, k), 0) + len(gone)
                out[part, "".join(FILTERS[j] for j in order), step] = [
                    len(left), len(gone), len(failing) - len(gone), sum(r[1] == 1 << k for r in failing),
                    sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
    return {(part, order, step): (*v, shapley[part, FILTERS.index(order[step - 1])]) for (part, order, step), v in out.items()}


def collected(frame):
    rows = frame.collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_awkward_rows(spark, awkward):
    marks = [(1, 1, 1), (2, 1, None), (2, 0, 0), (9, None, 1), (None, 1, 1), (7, 2, 2)]
    labels = spark.createDataFrame([(*m, "x") for m in marks], "doc_id bigint, quality int, toxic int, text string")
    docs = [tuple(r) for r in awkward.select("doc_id", "text", "source").collect()]
    for span in (1 << 16, 2):
        assert collected(audit(awkward, labels, span)) == by_hand(docs, marks)


def test_no_documents_and_no_labels(spark, no_documents, awkward):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audit(no_documents, labels).count() == 0
    found = collected(audit(awkward, labels))
    assert found and all(v[4] == v[5] == 0 for v in found.values())


def test_hot_source_and_hot_text(spark):
    chance = random.Random(5)
    texts = ["same text"] * 1500 + [" ".join(f"w{chance.randrange(300)}" for _ in range(chance.choice((50, 250)))) for _ in range(700)]
    texts += [t + chance.choice(("", " #", " ABCDEFGHIJK" * 9)) for t in texts[-500:]]
    docs = [(i, t, chance.choice(("hot", "hot", None, "b"))) for i, t in enumerate(texts)]
    chance.shuffle(docs)
    marks = [(i, chance.randrange(2), chance.randrange(2)) for i in range(0, len(docs), 2)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, source string").repartition(7)
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    assert collected(audit(frame, labels, 64)) == by_hand(docs, marks)
