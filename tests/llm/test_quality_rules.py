import random
import re

from test_llm_common import SMALL

from shelfsift.llm import quality_rules as Q
from shelfsift.llm.queries import op6_rule_ledger


def plain(text):
    """The measurements and failed rules by their definitions."""
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    seen, covered = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for spots in seen.values():
        if len(spots) > 1:
            covered |= {i + k for i in spots for k in range(3)}
    m = {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall("[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_capitals": len(re.findall("[A-Z]", text)),
        "n_bullet_lines": sum(bool(re.match("[\x20\x09-\x0d]*[-*•]", x)) for x in lines),
        "n_ellipsis_lines": sum(bool(re.search("(\\.\\.\\.|…)[\x20\x09-\x0d]*\\Z", x)) for x in lines),
    }
    n, c, many = m["n_words"], m["word_chars"], m["n_lines"] > 1
    failed = {
        "few_words": n < 50, "repeated_windows": 100 * m["n_repeat_words"] > 50 * n, "many_words": n > 100_000,
        "short_words": 2 * n > c, "long_words": c > 15 * n, "symbols": 100 * m["n_symbols"] > 25 * n,
        "repeated_lines": many and 2 * m["n_dup_lines"] > m["n_lines"], "capitals": 2 * m["n_capitals"] > c,
        "bullets": many and 100 * m["n_bullet_lines"] > 90 * m["n_lines"],
        "ellipses": many and 100 * m["n_ellipsis_lines"] > 30 * m["n_lines"],
    }
    return m, {name for name, bad in failed.items() if bad}


ODD = [
    None, "", " \t\n", "a b c a b c a b c", "one two", "x " * 60, "- item\n- item\n* other...\n", "a\x0bb\x0cc\rd\x1ce\x85f g h",
    "SHOUT " * 30 + "\n" + "SHOUT " * 30, "é👍🏽 ж " * 40, "w" * 20000, " ".join(f"w{i % 700}" for i in range(20000)),
    " ".join(f"w{i}" for i in range(80)) + "\n\n" + " ".join(f"w{i}" for i in range(80)), "## a | b\n" * 30,
]


def test_measures_rules_and_policies(spark):
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id int, text string, n_words string")
    rows = Q.ledger(frame).withColumn("kept", Q.kept()).withColumn("loose", Q.kept(without="few_words")).collect()
    for row in rows:
        measures, failed = plain(ODD[row["row"]["doc_id"]])
        assert {m: row[m] for m in Q.MEASURES} == measures, row["row"]["doc_id"]
        assert {name for name, bit in Q.BITS.items() if row["fail_bits"] & bit} == failed
        assert row["kept"] == (not failed) and row["loose"] == (not failed - {"few_words"})


def test_ablations_by_definition(spark):
    docs = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    failures = [plain(t)[1] for t in docs]
    rows = {r["rule"]: r for r in Q.ablations(Q.ledger(spark.read.parquet(f"{SMALL}/documents.parquet"))).collect()}
    assert set(rows) == set(Q.POLICIES[Q.DEFAULT_POLICY])
    for rule, row in rows.items():
        assert row["failed"] == sum(rule in f for f in failures)
        assert row["failed_alone"] == sum(f == {rule} for f in failures)
        assert row["kept_without"] == sum(not f - {rule} for f in failures)


def test_clean_documents_stay(spark):
    kept = {r["doc_id"]: r["kept"] for r in op6_rule_ledger(spark, SMALL).collect()}
    rows = op6_rule_ledger(spark, SMALL).where("NOT base_failed").collect()
    good = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1").collect()}
    assert all(r["kept"] for r in rows if r["doc_id"] in good) and len(kept) == 200


def test_plan_has_no_python(spark, no_documents):
    plan = op6_rule_ledger(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
    assert Q.ledger(no_documents).collect() == []


def test_length_alone_rejects_no_document(spark):
    """A clean text of over 100,000 words is kept by op6; its bit stays in the ledger."""
    chance = random.Random(9)
    long = " ".join(chance.choice(WORDS_OF_BOOK) + str(chance.randrange(4000)) for _ in range(100_001))
    frame = spark.createDataFrame([(1, long)], "doc_id bigint, text string")
    row = Q.ledger(frame).select("n_words", "fail_bits", Q.kept("corpus-1").alias("kept"), Q.kept("web-1").alias("web")).first()
    assert tuple(row) == (100_001, Q.BITS["many_words"], True, False)


WORDS_OF_BOOK = ["river", "mountain", "letter", "window", "garden", "morning", "father", "story"]
