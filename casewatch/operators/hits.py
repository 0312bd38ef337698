"""News hits with the text of the pages they point to."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window, functions as F

from casewatch.functions import dates as D
from casewatch.session import stage


def enrich_hits(
    hits: DataFrame, extracts: DataFrame, failed: DataFrame, as_of, days: int = 30,
    max_results: int = 5, topic: str = "topic", published: str = "published_on",
    score: str = "score",
) -> DataFrame:
    """The best recent hits of each topic, each with its own page's text.

    Hits are limited first, to `max_results` per topic within `days` of `as_of`,
    and staged. Page texts are large, so extracts are reduced to the pages still
    asked for before anything else, in place where those hits are few. A hit whose page failed drops; one without an
    extract keeps a null text. A URL extracted twice gives its larger text.
    """
    recent = hits.filter(
        (F.col(published) > D.as_date(as_of - timedelta(days=days)))
        & (F.col(published) <= D.as_date(as_of))
    )
    best = Window.partitionBy(topic).orderBy(F.desc(score), "url")
    top = stage(
        recent.withColumn("position", F.row_number().over(best))
        .filter(F.col("position") <= max_results)
        .join(failed.select("url"), "url", "left_anti")
    )
    wanted = extracts.join(top.select("url"), "url", "left_semi")
    texts = wanted.groupBy("url").agg(F.max("raw_content").alias("content"))
    return top.join(texts, "url", "left")
