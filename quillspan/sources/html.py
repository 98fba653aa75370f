"""HTML pages as documents: title and body text by pattern, tags stripped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<.*?>", "")


def parse_html(df: DataFrame, html_col: str = "html", body: str = r"(?s)<body[^>]*>(.*)</body>") -> DataFrame:
    """df with title and bodytext: the first <title>, and the group of the body pattern without tags."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    title = F.regexp_extract(html, r"(?s)<title>(.+?)</title>", 1)
    return df.withColumns({"title": title, "bodytext": strip_tags(F.regexp_extract(html, body, 1))})


def read_html_files(spark: SparkSession, path: str, body: str = r'(?s)<div id="bodytext">(.*?)</div>') -> DataFrame:
    """(url, html, title, bodytext) of the HTML files under path, without index.html."""
    files = spark.read.option("pathGlobFilter", "*.html").option("recursiveFileLookup", "true").text(path, wholetext=True)
    named = files.select(F.regexp_extract(F.input_file_name(), r"[^/]+$", 0).alias("url"), F.col("value").alias("html"))
    return parse_html(named.where("url <> 'index.html'"), "html", body)
