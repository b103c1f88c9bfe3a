"""Links of listing pages and feeds. Acquisition is a table of pages; nothing here opens a connection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import constants as K
from quarry.functions import dates as D
from quarry.functions import text as T


def links(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(url, key, times, kind) of the URLs that texts name; the last page of each stays."""
    each = pages.where(F.col("text").contains("://")).select(key, F.explode(T.all_matches(F.col("text"), K.URL)).alias("url"))
    low = F.lower("url")
    kind = F.when(low.rlike("agenda"), "agenda").when(low.rlike("packet|[.]pdf"), "packet").otherwise("other")
    return each.groupBy("url").agg(F.max(key).alias(key), F.count("*").alias("times")).withColumn("kind", kind)


def anchors(pages: DataFrame, base: str) -> DataFrame:
    """(url, title, kind, day) of the anchors of listing pages (html): relative links are put under base, the last of equal URLs stays."""
    tag = r'(?is)<a\s[^>]*href="([^"]+)"[^>]*>(.*?)</a>'
    found = pages.select(F.posexplode(F.arrays_zip(F.regexp_extract_all("html", F.lit(tag), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(tag), F.lit(2)).alias("label"))).alias("n", "a"))
    url = F.when(F.col("a.href").rlike(r"^[a-z]+://"), F.col("a.href")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(F.col("a.href"), F.lit("/"))))
    title = T.without_markup(F.col("a.label"))
    kind = F.when(F.lower(title).contains("agenda"), "agenda").otherwise("previous_versions")
    rows = found.select("n", url.alias("url"), title.alias("title"), kind.alias("kind"))
    return rows.groupBy("url").agg(F.max_by("title", "n").alias("title"), F.max_by("kind", "n").alias("kind")).withColumn("day", D.url_date(F.col("url")))


def feed(spark: SparkSession, path: str) -> DataFrame:
    """(title, url, day) of the items of RSS files."""
    items = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, pubDate string").load(path)
    day = F.try_to_date(F.regexp_extract("pubDate", r"([0-9]{1,2} [A-Za-z]{3} [0-9]{4})", 1), "d MMM yyyy")
    return items.select(T.collapse(F.col("title")).alias("title"), T.collapse(F.col("link")).alias("url"), day.alias("day"))
