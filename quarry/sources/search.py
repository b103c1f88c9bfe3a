"""Search results and pages as tables: a pluggable source, fetches as joins, directory searches over a fixed list of hosts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry import constants as K
from quarry.functions import text as T

RESULTS = "query string, ordinal int, link string, title string, snippet string"
#: What a search shows at most, how many of its pages are fetched, and how many of a directory's.
RESULTS_SHOWN, PAGES_FETCHED, DIRECTORY_PAGES = 8, 6, 3


class SearchSource(DataSource):
    """spark.read.format("search"): results of queries from a function named by its import path ("module:function").

    Options: client, queries (separated by line breaks), parallel (queries per task). Without a client
    there are no results: nothing is ever fetched by default.
    """

    @classmethod
    def name(cls) -> str:
        return "search"

    def schema(self) -> str:
        return RESULTS

    def reader(self, schema) -> DataSourceReader:
        return SearchReader(self.options)


class SearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.client = options.get("client")
        self.queries = [q for q in options.get("queries", "").split("\n") if q.strip()]
        self.size = max(1, int(options.get("parallel", "16")))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.queries[i : i + self.size]) for i in range(0, len(self.queries), self.size)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not self.client:
            return
        from importlib import import_module

        module, _, function = self.client.partition(":")
        search: Callable[[str], list[dict]] = getattr(import_module(module), function)
        for q in partition.value:
            for i, r in enumerate(search(q)[:RESULTS_SHOWN]):
                yield q, i, r.get("link"), r.get("title"), r.get("snippet")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SearchSource)


def searched(queries: DataFrame, results: DataFrame) -> DataFrame:
    """queries (…, query) beside the results of a table of searches: an equi-join on the query's text."""
    return queries.join(results, "query")


def fetched(wanted: DataFrame, pages: DataFrame, most: int | None = PAGES_FETCHED) -> DataFrame:
    """wanted (key, ordinal, url) beside the pages (url, status, content_type, body) that could be fetched, each address once per key.

    Addresses are compared without case of the host, fragment and closing slash. Failed answers and what
    is neither a page nor a PDF fall away; a PDF is marked. At most so many addresses per key are asked
    for, in their order, the first writing of each; None asks for all.
    """
    one = wanted.where("url is not null").groupBy("key", T.normal_url(F.col("url")).alias("url")).agg(F.min("ordinal").alias("ordinal"))
    if most is not None:
        from quarry.operators.rows import top_per

        one = top_per(one, ["key"], most, F.col("ordinal"), F.col("url"))
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    kept = pages.where((F.coalesce("status", F.lit(0)) < 400) & (kind.contains("html") | kind.contains("pdf")))
    return one.join(kept.select(T.normal_url(F.col("url")).alias("url"), "body", kind.contains("pdf").alias("is_pdf")), "url")


def directory_queries(leads: DataFrame, hosts: tuple[str, ...] = K.DIRECTORY_HOSTS) -> DataFrame:
    """(app, host, query): for each lead one query per directory. The list of hosts is a literal, so nothing is joined."""
    return leads.where("name is not null").select("app", F.explode(F.array(*[F.lit(h) for h in hosts])).alias("host"), "name").select("app", "host", F.concat(F.lit('"'), "name", F.lit('" site:'), "host").alias("query"))


def listed(results: DataFrame, most: int = DIRECTORY_PAGES) -> DataFrame:
    """Directory results (app, host, name, ordinal, link, title, snippet) that stand on their directory and name the lead in full, the first of each."""
    from quarry.functions import contact as C
    from quarry.operators.rows import top_per

    low = F.lower(F.concat_ws(" ", "title", "snippet"))
    words = C.name_tokens(F.col("name"))
    ours = results.where((F.size(words) > 0) & (C.any_within(words, low) == F.size(words)) & T.hosted_by_column(T.host(F.col("link")), F.col("host")))
    return top_per(ours, ["app", "host"], most, F.col("ordinal"), F.col("link"))


def all_sources(listings: list[DataFrame], feeds: list[DataFrame]) -> DataFrame:
    """Records (source, title, url, day, ordinal) of listing pages and feeds in one table, the last of each address in the order of the sources."""
    from quarry.operators.rows import union_sources

    parts = [df.withColumn("_n", F.lit(i)) for i, df in enumerate([*listings, *feeds])]
    rows = union_sources(*parts)
    return rows.where("url is not null").groupBy("url").agg(F.max_by(F.struct("source", "title", "day"), F.struct("_n", "ordinal")).alias("r"), F.count("*").alias("times")).select("url", "r.source", "r.title", "r.day", "times")
