import random

import numpy as np
import pytest
import xxhash
from test_llm_common import SMALL

from shelfsift.llm import simhash as S
from shelfsift.llm.components import components
from shelfsift.llm.queries import op9_gray_simhash


def plain_fingerprint(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", (text or "").translate(
        {c: c + 32 for c in range(65, 91)})) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, limit):
    """Smallest id reached, by comparing all pairs; prints: [(id, fp)]."""
    label = list(range(len(prints)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    values = np.array([f for _, f in prints], np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= limit).tolist():
            a, b = root(i), root(j)
            label[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((d, f"{f:016x}", least.get(root(i))) for i, (d, f) in enumerate(prints)), key=repr)


def test_whole_table_like_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    expected = plain_components([(d["doc_id"], plain_fingerprint(d["text"])) for d in docs], 2)
    rows = op9_gray_simhash(spark, SMALL).collect()
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows), key=repr) == expected


@pytest.mark.parametrize("limit", [0, 2, 5])
def test_index_finds_what_all_pairs_find(spark, monkeypatch, limit):
    monkeypatch.setattr(S, "BLOCK", 40)
    chance = random.Random(limit)
    prints = set()
    while len(prints) < 700:  # chains of near fingerprints, dense clusters, and strangers
        f = chance.getrandbits(64) if chance.random() < 0.7 else chance.getrandbits(6)
        for _ in range(chance.randint(1, 9)):
            prints.add(f)
            for _ in range(chance.randint(0, 3)):
                f ^= 1 << chance.randrange(64)
    rows = [(i, f) for i, f in enumerate(sorted(prints))]
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for _, f in rows], "fp bigint")
    near = S.near_links(frame, limit)
    links = {(r["a"], r["b"]) for r in near.collect()}
    assert all((a ^ b) & (2**64 - 1) and ((a ^ b) & (2**64 - 1)).bit_count() <= limit for a, b in links)
    roots = {r["node"]: r["root"] for r in components(near).collect()}
    signed = {f: int(np.uint64(f).astype(np.int64)) for _, f in rows}
    mine = {}
    for _, f in rows:
        mine.setdefault(roots.get(signed[f], signed[f]), set()).add(f)
    theirs = {}
    for i, name, component in plain_components(rows, limit):
        theirs.setdefault(component, set()).add(int(name, 16))
    assert {frozenset(g) for g in mine.values()} == {frozenset(g) for g in theirs.values()}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 400)] + [(5, 900 + i) for i in range(300)] + [(7, 7), (-4, 5), (905, 8)]
    chance = random.Random(1)
    chance.shuffle(links)
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(found[i] == 100 for i in range(100, 401)) and len(found) == 301 + 303
    assert all(found[x] == -4 for x in (-4, 5, 8, *range(900, 1200)))


def test_awkward_rows(spark, awkward, no_documents):
    docs = awkward.collect()
    rows = S.near_duplicates(awkward).collect()
    prints = [(d["doc_id"], plain_fingerprint(d["text"])) for d in docs]
    mine = sorted(((r["doc_id"], f"{r['fp'] % 2**64:016x}", r["component_id"]) for r in rows), key=repr)
    assert mine == plain_components(prints, 2)
    kept = S.keep_one(awkward)
    assert kept.columns == awkward.columns
    # empty texts 2, 3, 4 are one group; of the three rows with id 9, the copies are one group and the third is another
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 5, 6, 7, None, 9, 9, 10], key=str)
    assert {r["text"] for r in kept.collect() if r["doc_id"] == 9} == {"same id", "same id, other text"}
    assert S.near_duplicates(no_documents).collect() == [] and S.keep_one(no_documents).collect() == []


def test_components_without_ids_keep_a_row_each(spark):
    texts = ["one text here", "one text here", "quite another one", "and a third of them", "and a third of them"]
    frame = spark.createDataFrame([(None, t) for t in texts] + [(3, texts[0])], "doc_id bigint, text string")
    assert sorted(map(tuple, S.keep_one(frame).collect()), key=str) == sorted(
        [(3, texts[0]), (None, texts[2]), (None, texts[3])], key=str
    )


def test_components_that_share_an_id_keep_a_row_each(spark):
    texts = ["one text here", "quite another one", "and a third of them", "and a third of them"]
    frame = spark.createDataFrame([(7, t) for t in texts] + [(8, texts[0])], "doc_id bigint, text string")
    assert sorted(map(tuple, S.keep_one(frame).collect())) == sorted([(7, t) for t in texts[:3]])


def test_links_of_hubs_are_spread(spark, monkeypatch):
    """Every node a hub, and none: the same components."""
    from shelfsift.llm import components as module

    chance = random.Random(2)
    links = [(1, 10 + i) for i in range(400)] + [(500 + i, 499 + i) for i in range(60)] + [(30, 520), (9000, 9001)]
    frame = spark.createDataFrame(links + [(chance.choice([40, 41]), 7000 + i) for i in range(200)], "a bigint, b bigint")
    expected = {n: 1 for a, b in links[:400] for n in (a, b)} | {n: 1 for n in range(499, 560)} | {9000: 9000, 9001: 9000}
    expected |= {n: 1 for n in range(7000, 7200)}
    for hubs in (1, 1000, 10**9):
        monkeypatch.setattr(module, "HUBS", hubs)
        assert {r["node"]: r["root"] for r in components(frame).collect()} == expected
