"""Code cells of notebook HTML. Python reads the markup; choosing the cells is done in Spark."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsift.fixed_values import (
    CELL_CLASSES,
    HIGHLIGHT_CLASS,
    INPUT_CLASSES,
    SCRIPT_HEADER,
    SCRIPT_SEPARATOR,
    WHITESPACE,
    WORD,
)

VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def code_like(text: Column) -> Column:
    """Not blank, and holds an import, a function or class header, or a line starting with ``#``."""
    word, blank = f"[{WORD}]", f"[{WHITESPACE}]"
    shape = (
        f"import{blank}+{word}"
        f"|def{blank}+{word}+{blank}*\\("
        f"|class{blank}+{word}+{blank}*\\("
        f"|(?:^|\n){blank}*#"
    )
    return text.rlike(f"[^{WHITESPACE}]") & text.rlike(shape)


class PreReader(HTMLParser):
    """Collects ``pre`` texts: all of them, those of notebook cells, those of highlight blocks."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.pres: list[dict] = []
        self.cells: list[dict] = []
        self.highlights: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID_TAGS:
            return
        element = {"tag": tag, "input": None, "pre": None, "text": []}
        if tag == "div":
            classes = dict(attrs).get("class") or ""
            if any(name in classes for name in INPUT_CLASSES):
                for cell in self.open:
                    if cell.get("is_cell") and cell["input"] is None:
                        cell["input"] = element
            if any(name in classes for name in CELL_CLASSES):
                element["is_cell"] = True
                self.cells.append(element)
            if HIGHLIGHT_CLASS in classes:
                self.highlights.append(element)
        elif tag == "pre":
            self.pres.append(element)
            for holder in self.open:
                if holder["pre"] is None:
                    holder["pre"] = element
        self.open.append(element)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth]["tag"] == tag:
                del self.open[depth:]
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1]["tag"] in ("script", "style"):
            return
        for element in self.open:
            if element["tag"] == "pre":
                element["text"].append(data)

    def found(self) -> tuple[list[str], list[str], list[str]]:
        def texts(elements: list) -> list[str]:
            return ["".join(element["text"]) for element in elements if element]

        cells = [cell["input"]["pre"] for cell in self.cells if cell["input"]]
        return texts(cells), texts(self.pres), texts([block["pre"] for block in self.highlights])


def read_pres(html: str) -> tuple[list[str], list[str], list[str]]:
    reader = PreReader()
    reader.feed(html)
    reader.close()
    return reader.found()


def code_arrays(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, tier, codes``: the ordered code cells of each page that has any.

    Tier 1 is notebook cells, tier 2 code-like ``pre`` blocks, tier 3 highlight blocks;
    a page's first non-empty tier is used. Pages without a ``pre`` tag never leave the JVM.
    """
    schema = T.StructType(
        [pages.schema[key], *[T.StructField(name, T.ArrayType(T.StringType())) for name in ("cells", "pres", "lit")]]
    )

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [read_pres(page) for page in frame[html]]
            yield pd.DataFrame(
                {
                    key: frame[key].tolist(),
                    "cells": [cells for cells, _, _ in found],
                    "pres": [pres for _, pres, _ in found],
                    "lit": [lit for _, _, lit in found],
                }
            )

    candidates = pages.where(F.col(html).rlike("(?i)<pre[^a-z]")).select(key, html)
    read = candidates.mapInPandas(parse, schema).withColumn("pres", F.filter("pres", code_like))
    tier = F.when(F.size("cells") > 0, 1).when(F.size("pres") > 0, 2).when(F.size("lit") > 0, 3)
    chosen = F.when(tier == 1, F.col("cells")).when(tier == 2, F.col("pres")).otherwise(F.col("lit"))
    return read.select(key, tier.alias("tier"), chosen.alias("codes")).where(F.col("tier").isNotNull())


def code_cells(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, tier, cell_ix, code``, one row per code cell, numbered from 0 in page order."""
    return code_arrays(pages, key, html).select(key, "tier", F.posexplode("codes").alias("cell_ix", "code"))


def page_scripts(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, script``: a page's cells as one Python script, header first. Nothing is shuffled."""
    return code_arrays(pages, key, html).select(
        key, F.concat(F.lit(SCRIPT_HEADER), F.concat_ws(SCRIPT_SEPARATOR, "codes")).alias("script")
    )
