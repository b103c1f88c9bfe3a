"""Packets: binary files, their pages and their text. Page extraction is an injected function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PDF_MAGIC = "%PDF"
PAGES = "path string, pages array<struct<page:int,text:string>>, error string"


def read_binary(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Files as rows (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def is_pdf(content: Column) -> Column:
    """Whether content begins as a PDF does; false for null."""
    return F.coalesce(F.substring(content, 1, 4) == F.encode(F.lit(PDF_MAGIC), "UTF-8"), F.lit(False))


def parse(files: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, pages, error) of files by an extractor of page texts; one that fails gives an error, not a failed job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    out.append((path, [{"page": i, "text": t} for i, t in enumerate(extract(bytes(content)), 1)], None))
                except Exception as e:  # the reason is part of the result
                    out.append((path, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=["path", "pages", "error"])

    return files.select("path", "content").mapInPandas(run, PAGES)


def join_pages(pages: Column) -> Column:
    """The text of a file: before each page an empty line, its marker and an empty line; pages in order, empty ones left out."""
    kept = F.array_sort(F.filter(pages, lambda p: F.coalesce(F.trim(p["text"]), F.lit("")) != ""))
    return F.array_join(F.transform(kept, lambda p: F.concat(F.lit("\n--- PAGE "), p["page"].cast("string"), F.lit(" ---\n\n"), p["text"])), "\n")


def page_count(document: Column) -> Column:
    """Pages of a raw PDF by its page objects."""
    return F.size(F.regexp_extract_all(F.decode(document, "ISO-8859-1"), F.lit(r"/Type\s*/Page[^s]"), F.lit(0)))
