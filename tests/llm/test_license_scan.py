from shelfsift.llm import license_scan as L
from shelfsift.llm.license_texts import TEMPLATES


def test_templates_find_themselves_and_variants():
    known = L.Templates(TEMPLATES, L.LEAST_DICE)
    for name, text in TEMPLATES:
        hits = known.scan(text)
        assert hits and hits[0]["license"] == name and hits[0]["dice"] == 1.0, name
    wrapped = "Copyright (c) 2020 A. Author\n" + TEMPLATES[0][1].replace(". ", ".\n").replace("Software", "software")
    assert ("paragraph", "MIT") in {(h["kind"], h["license"]) for h in known.scan("Intro words here.\n\n" + wrapped)}
    assert known.scan("The MIT people released a report under pressure.") == []


def test_pruning_loses_nothing():
    """The bounds against the plain definition, for stretches of every size cut from the templates."""
    known = L.Templates(TEMPLATES, 0.6)
    for _, text in TEMPLATES:
        words = L.words_of(text)
        for size in range(2, len(words) + 1, 3):
            part = words[:size] + ["other", "words"] * (size % 5)
            grams = set(zip(part, part[1:]))
            scores = [(-2 * len(grams & g) / (len(grams) + len(g)), n) for n, g in known.bigrams]
            dice, name = min(scores)
            assert known.best(grams) == ((name, -dice) if -dice >= 0.6 else None)
            hits = [h for h in known.scan(" ".join(part)) if h["kind"] == "line"]
            assert [(h["license"], h["dice"]) for h in hits] == ([(name, -dice)] if -dice >= 0.6 else [])


def test_awkward_rows(spark, awkward, no_documents):
    rows = L.summary(L.scan(awkward)).collect()
    assert len(rows) == 12 and all(r["n_hits"] == 0 and r["licenses"] == "" and r["best_license"] is None for r in rows)
    frame = spark.createDataFrame([(1, "x\nReleased under the MIT license\nLicensed under CC BY-NC 4.0")], "doc_id int, text string")
    row = L.summary(L.scan(frame)).first()
    assert (row["n_hits"], row["licenses"], row["best_license"], row["best_line"]) == (2, "CC-BY-NC-4.0,MIT", "CC-BY-NC-4.0", 2)
    assert L.summary(L.scan(no_documents)).collect() == []
