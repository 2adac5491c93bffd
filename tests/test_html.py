import pytest
from pyspark.sql import functions as F

from shelfsift.operators.html_cells import code_cells, code_like, page_scripts, read_pres
from shelfsift.sources.pages import read_html_files
from shelfsift.sources.sinks import write_scripts

PAGES = [
    # notebook cells, two export styles, markup inside the code, a second pre that is not taken
    '<div class="jp-Cell jp-CodeCell"><div class="jp-Cell-inputArea x"><pre><span>a</span> = 1 &lt; 2<br/>b</pre><pre>no</pre></div></div>'
    '<div class="cell code_cell"><div class="input_area"><pre>second</pre></div></div><pre>import os</pre>',
    # bare pre blocks, only code-like ones
    "<p>x<pre>import os</pre><PRE>prose only</PRE><pre>  # comment</pre><pre>def f (x)</pre><pre>class A(B)</pre>",
    # highlight blocks, one without pre
    '<div class="highlight"><pre>prose</pre></div><div class="highlight-x"></div>',
    "<p>nothing</p>",
    "<pre>prose that will not do</pre>",
    # a cell without input area, then code in a bare pre
    '<div class="code_cell"><pre>import re</pre></div>',
    # nested cells share the inner input; unclosed tags; script text is not code
    '<div class="code_cell"><div class="code_cell"><div class="input_area"><pre>x<script>y</script>z</pre></div></div></div><div>',
    "<predicate>import os</predicate>",
    "",
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(list(enumerate(PAGES)), "page_id bigint, html string")


def test_cells_by_tier(pages):
    found = {}
    for row in sorted(code_cells(pages).collect()):
        found.setdefault(row["page_id"], []).append((row["tier"], row["cell_ix"], row["code"]))
    assert found == {
        0: [(1, 0, "a = 1 < 2b"), (1, 1, "second")],
        1: [(2, 0, "import os"), (2, 1, "  # comment"), (2, 2, "def f (x)"), (2, 3, "class A(B)")],
        2: [(3, 0, "prose")],
        5: [(2, 0, "import re")],
        6: [(1, 0, "xz"), (1, 1, "xz")],
    }


def test_reader_is_plain():
    assert read_pres("<pre>a<pre>b</pre>c</pre>") == ([], ["abc", "b"], [])
    assert read_pres('<div class="highlight"><pre>&eacute;&#65;</pre>') == ([], ["éA"], ["éA"])


def test_code_like(spark):
    cases = {
        "import os": True, "an important word": False, "import os": True, "import 1": True, "imports x": False,
        "def  f(": True, "def f": False, "class C (": True, "class C:": False, "x\n  # y": True, "x # y": False,
        "\r# y": True, "x\r# y": False, "#": True, "  \n ": False, "": False,
    }
    frame = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r["t"]: r["code"] for r in frame.select("t", code_like(F.col("t")).alias("code")).collect()}
    assert got == cases


def test_scripts_and_sink(spark, pages, tmp_path):
    scripts = {r["page_id"]: r["script"] for r in page_scripts(pages).collect()}
    header = '#!/usr/bin/env python3\n"""\nThis script was automatically generated from a Jupyter notebook HTML export\n"""\n\n'
    assert scripts[0] == header + "a = 1 < 2b\n\n\nsecond".replace("\n\n\n", "\n\n")
    assert scripts[2] == header + "prose"
    target = str(tmp_path / "per_page")
    write_scripts(page_scripts(pages), target, per_page=True)
    written = spark.read.text(f"{target}/page_id=0", wholetext=True).collect()
    assert any(row["value"].startswith(scripts[0]) for row in written)
    # the table keeps every page's script apart
    target = str(tmp_path / "table")
    write_scripts(page_scripts(pages), target)
    assert {r["page_id"]: r["script"] for r in spark.read.parquet(target).collect()} == scripts and len(scripts) > 1



def test_one_row_per_html_file(spark, tmp_path):
    for number in (0, 1):
        (tmp_path / f"p{number}.html").write_text(PAGES[number], encoding="utf-8")
    rows = read_html_files(spark, str(tmp_path))
    assert sorted(r["html"] for r in rows.collect()) == sorted(PAGES[:2])
    assert code_cells(rows).count() == 6


def test_pages_without_pre_stay_in_the_jvm(pages):
    plan = code_cells(pages)._jdf.queryExecution().optimizedPlan().toString()
    before = plan[plan.index("MapInPandas"):]
    assert "RLIKE" in before and "Exchange" not in plan
