import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from test_llm_common import SMALL, by_library

from shelfsift.llm import packing as P
from shelfsift.llm.queries import op2_mixture_packing


def literal_round(weights, window, windows):
    """The ledger of the round, window by window: credits as fractions, whole tokens given, deficits carried."""
    total, above = sum(weights), np.cumsum([0, *weights])
    given, out = [0] * len(weights), []
    for i in range(1, windows + 1):
        row = []
        for k in range(len(weights)):
            whole = i * window * int(above[k + 1]) // total - i * window * int(above[k]) // total
            row.append(whole - given[k])
            assert row[-1] >= 1
            credit = i * window * weights[k] / total
            assert abs(credit - whole) < 1  # the deficit
            given[k] = whole
        assert sum(row) == window
        out.append(row)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_ledger_covers_every_position_once(seed):
    chance = random.Random(seed)
    window = 64
    tokens = [chance.choice([0, 1, 3, 50, 700, 5000]) + chance.randint(0, 40) for _ in range(chance.randint(1, 9))]
    weights = [chance.randint(3, 30) for _ in tokens]
    spans = P.ledger(tokens, weights, window)
    cells = defaultdict(list)
    for queue, count in enumerate(tokens):
        position = 0
        while position < count:
            step = min(count - position, chance.randint(1, 90))
            got = list(P.cut(position, step, spans[queue], count))
            assert sum(length for length, *_ in got) == step
            for length, w, offset in got:
                cells[w].append((offset, offset + length, queue))
            position += step
    for w, pieces in cells.items():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
        assert pieces[-1][1] == window or w == max(cells)
    assert sorted(cells) == list(range(len(cells)))
    # while all queues last, each window holds the round's own tokens
    alive = [w for w in sorted(cells) if {q for *_, q in cells[w]} == {q for q, n in enumerate(tokens) if n}]
    expected = literal_round([w for w, n in zip(weights, tokens) if n], window, max(1, len(alive)))
    names = [q for q, n in enumerate(tokens) if n]
    for w, row in zip(alive[:-1], expected):
        sums = defaultdict(int)
        for a, b, q in cells[w]:
            sums[q] += b - a
        assert [sums[q] for q in names] == row


def check_pieces(rows, docs, library, end_id):
    ids = [np.array([*by_library(library, t), end_id], "<u4") for _, t in docs]
    windows = defaultdict(list)
    total = 0
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        total += r["length"]
    assert total == sum(map(len, ids))
    for w, spans in windows.items():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        assert sum(spans[-1]) == 4096 or w == max(windows)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
    whole = defaultdict(list)
    for (doc, _), i in zip(docs, ids):
        whole[doc, len(i)].append(i)
    assert set(pieces) == set(whole)
    for key, copies in whole.items():
        for i in copies:
            for start, n, crc in [p for p in pieces[key]]:
                if len({c.tobytes() for c in copies}) == 1:
                    assert zlib.crc32(i[start : start + n].tobytes()) == crc
        assert sum(n for _, n, _ in pieces[key]) == key[1] * len(copies)


def test_whole_table(spark, library):
    docs = [(d["doc_id"], d["text"]) for d in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check_pieces(op2_mixture_packing(spark, SMALL).collect(), docs, library, 2)


def test_awkward_rows_and_sequences(spark, awkward, tokenizer, library, monkeypatch):
    from pyspark.sql import functions as F

    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    pieces = P.stored(P.pack(awkward, tokenizer, 2, weights={"s0": 3.0, None: 1.0}), "pieces")
    check_pieces(pieces.withColumn("ids_crc32", F.crc32("ids")).collect(), docs, library, 2)
    built = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in P.sequences(pieces).collect()}
    assert sorted(np.concatenate(list(built.values())).tolist()) == sorted(
        i for _, t in docs for i in [*by_library(library, t), 2]
    )
    monkeypatch.setattr(P, "MOST_SOURCES", 1)  # the others share a queue
    check_pieces(P.pack(awkward, tokenizer, 2).withColumn("ids_crc32", F.crc32("ids")).collect(), docs, library, 2)


def test_empty_table(no_documents, tokenizer):
    assert P.pack(no_documents, tokenizer, 2).collect() == []


def pieces_by_window(rounds, tokens, step=10**9):
    """(offset, end, source) of every piece, by window; sources are cut in steps as tasks would."""
    cells = defaultdict(list)
    for source, path in rounds.paths().items():
        for at in range(0, tokens[source], step):
            for length, window, offset in P.cut_path(path, at, min(step, tokens[source] - at)):
                cells[window].append((offset, offset + length, source))
    return cells


def assert_gapless(cells, window, total):
    assert sorted(cells) == list(range(-(-total // window)))
    for w, pieces in cells.items():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
        assert pieces[-1][1] == window or w == max(cells)


@pytest.mark.parametrize("seed", range(6))
def test_nested_rounds_cover_every_position_once(seed, monkeypatch):
    chance = random.Random(seed)
    monkeypatch.setattr(P, "CHILDREN", chance.choice([2, 3, 200]))
    monkeypatch.setattr(P, "FAN", chance.choice([2, 5, 64]))
    tokens = [chance.choice([0, 1, 2, 30, 400]) + chance.randint(0, 9) for _ in range(60)]
    weights = P.whole_weights([10 ** chance.uniform(-6, 0) for _ in tokens])
    rounds = P.nested_rounds(tokens, weights, 64)
    assert set(rounds.paths()) == {k for k, n in enumerate(tokens) if n}
    assert_gapless(pieces_by_window(rounds, tokens, step=37), 64, sum(tokens))


def test_a_thousand_sources_keep_their_shares():
    """Shares from some percent down to 1e-6: in every window, each source's tokens so far are within a few of its target."""
    chance = random.Random(5)
    shares = [10 ** chance.uniform(-6, -1.5) for _ in range(1000)]
    whole = sum(shares)
    shares = [s / whole for s in shares]
    assert min(shares) < 2e-6 and P.WINDOW * min(shares) < 0.01
    windows = 300
    # as many tokens as the windows and some more need, so that no source ends before
    tokens = [int(s * P.WINDOW * windows * 1.05) + 20 for s in shares]
    rounds = P.nested_rounds(tokens, P.whole_weights(shares))
    cells = pieces_by_window(rounds, tokens)
    assert_gapless(cells, P.WINDOW, sum(tokens))
    given, worst = [0] * len(shares), 0.0
    for w in range(windows):
        for a, b, source in cells[w]:
            given[source] += b - a
        worst = max(worst, max(abs(n - s * P.WINDOW * (w + 1)) for n, s in zip(given, shares)))
    assert worst < 6


def test_small_shares_are_not_lifted():
    """200 sources that should hold 0.4 % together do, next to three large ones."""
    shares = [0.332] * 3 + [2e-5] * 200
    tokens = [int(s * 10**7) for s in shares]
    cells = pieces_by_window(P.nested_rounds(tokens, P.whole_weights(shares)), tokens)
    small = sum(b - a for w in range(1000) for a, b, source in cells[w] if source > 2)
    assert small / (1000 * P.WINDOW) == pytest.approx(0.004, rel=0.01)


def test_many_sources_in_a_table(spark, tokenizer, library):
    chance = random.Random(3)
    docs = [(i, f"words of {chance.random()} " * chance.randint(0, 40), f"site{chance.randrange(450)}") for i in range(900)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, source string").repartition(4)
    pieces = P.pack(frame, tokenizer, 2, temperature=0.7, digests=True)
    check_pieces(pieces.collect(), [(i, t) for i, t, _ in docs], library, 2)
