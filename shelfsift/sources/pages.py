"""HTML pages: from a table, or one file per page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsift.session import spread


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per HTML file: ``page_id`` (the file's path) and ``html``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("page_id"), F.col("value").alias("html")
    )


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html"), "page_id")


def notebook_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``pages`` with notebook cells built from each page's own url appended, one layout per id.

    The plain pages hold no code, so this is what gives the cell reader work on every page.
    """
    code = F.concat(
        F.lit("import os\n# page "), F.col("page_id").cast("string"), F.lit("\nprint(&quot;"),
        F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("&quot;)"),
    )
    cell = F.concat(
        F.lit('<div class="cell code_cell"><div class="input"><div class="input_area"><pre><span>'), code,
        F.lit("</span></pre><pre>second</pre></div></div></div>"),
    )
    lab = F.concat(
        F.lit('<div class="jp-Cell jp-CodeCell"><div class="jp-Cell-inputArea"><div class="highlight"><pre>x = 1<br>'),
        code, F.lit("</pre></div></div></div>"),
    )
    bare = F.concat(F.lit("<pre>just prose</pre><pre>"), code, F.lit("</pre>"))
    painted = F.lit('<div class="highlight-python"><p>note<pre>y = 2</pre></div>')
    prose = F.lit("<pre>no code here at all</pre>")
    kind = F.col("page_id") % 6
    cells = (
        F.when(kind == 1, F.concat(cell, lab))
        .when(kind == 2, lab)
        .when(kind == 3, bare)
        .when(kind == 4, painted)
        .when(kind == 5, prose)
        .otherwise("")
    )
    return read_pages(spark, folder).select("page_id", "url", F.concat("html", cells).alias("html"))
