import hashlib
import math
import zlib
from collections import Counter

from pyspark.sql import functions as F
from test_llm_common import SMALL

from shelfsift.llm import hash_tree as H
from shelfsift.llm.queries import op3_hash_tree


def plain_shard(key, node):
    while node.shard is None:
        def draw(child):
            bits = int(hashlib.md5(f"{child.name}|{key}".encode()).hexdigest()[:13], 16)
            return -math.log((bits + 1) / 2**52) / child.weight

        node = min(node.children, key=draw)
    return node.shard


def check(rows, docs):
    tree = H.default_tree()
    expected = Counter()
    for doc, text in docs:
        data = (text or "").encode()
        key = "null" if doc is None else str(doc)
        expected[doc, len(data) + 1, None if text is None else zlib.crc32(data), plain_shard(key, tree),
                 plain_shard(key, H.grown(tree))] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in rows) == expected
    slots = Counter()
    for shard in range(8):
        mine = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert mine == list(range(len(mine)))
        slots[shard] = len(mine)
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)
    return slots


def test_whole_table_like_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    check(op3_hash_tree(spark, SMALL).collect(), [(d["doc_id"], d["text"]) for d in docs])


def test_awkward_rows(spark, awkward, no_documents):
    check(H.assign(awkward).collect(), [(r["doc_id"], r["text"]) for r in awkward.collect()])
    assert H.assign(no_documents).collect() == []


def test_weights_and_movement(spark):
    weights = {0: 1.0, 1: 3.0, 2: 1.0, 3: 1.0, 4: 2.0, 5: 1.0, 6: 1.0, 7: 1.0}
    tree = H.Node("root", (H.region(0, [[0, 1], [2, 3]], weights), H.region(1, [[4, 5], [6, 7]], weights)))
    heavier = H.Node(
        "root", (H.region(0, [[0, 1], [2, 3]], weights), H.region(1, [[4, 5], [6, 7]], {**weights, 6: 3.0}))
    )
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    rows = keys.select(H.shard_for(F.col("k"), tree).alias("a"), H.shard_for(F.col("k"), heavier).alias("b")).collect()
    share = Counter(r["a"] for r in rows)
    for shard, weight in weights.items():
        assert abs(share[shard] / 20_000 - weight / 11) < 0.02
    # only the region, rack and shard that grew take documents in; nothing moves among the others
    moved = [(r["a"], r["b"]) for r in rows if r["a"] != r["b"]]
    assert moved and all(b in (4, 5, 6, 7) for _, b in moved)
    assert all(b in (6, 7) for a, b in moved if a in (4, 5)) and not any(a in (6, 7) and b in (4, 5) for a, b in moved)
