"""Page metadata, fetch rules and image choice."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.functions.text import present
from gazette.functions.urls import is_blocked, normalize_url

# Which metas give a field, in order.
METAS = {
    "og_title": ("og:title", "twitter:title"),
    "og_description": ("og:description", "description", "twitter:description"),
    "og_image": ("og:image", "twitter:image", "twitter:image:src"),
}
RULES = "struct<image_fallback:boolean,requires_ua:boolean,blocked:array<string>>"


class _Metas(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.first: dict[tuple[str, str], str | None] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "meta":
            named = dict(reversed(attrs))
            for kind in ("property", "name"):
                if named.get(kind):
                    self.first.setdefault((kind, named[kind]), named.get("content"))

    handle_startendtag = handle_starttag


def page_fields(html: str | None) -> tuple[str | None, ...]:
    """For each field the first key with a tag that has content: a property tag if there is one, else a name tag."""
    seen = _Metas()
    seen.feed(html or "")
    out: list[str | None] = []
    for keys in METAS.values():
        tags = [seen.first.get(("property", k), seen.first.get(("name", k))) for k in keys]
        out.append(next((x.strip() for x in tags if x), None))
    return tuple(out)


@F.pandas_udf(T.StructType([T.StructField(name, T.StringType()) for name in METAS]))
def og_fields(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([page_fields(x) for x in html], columns=list(METAS), dtype=object)


def merge_rules(sources: DataFrame, defaults: dict) -> DataFrame:
    """sources (name, src_pos, image_fallback, requires_ua, blocked: null where not overridden) with the defaults in. A list
    given replaces the default's, empty or not."""
    return sources.withColumns(
        {
            "image_fallback": F.coalesce("image_fallback", F.lit(defaults["image_fallback"])),
            "requires_ua": F.coalesce("requires_ua", F.lit(defaults["requires_ua"])),
            "blocked": F.coalesce("blocked", F.array(*[F.lit(x) for x in defaults["blocked"]]).cast("array<string>")),
        }
    )


def lookup_rules(df: DataFrame, rules: DataFrame, source: str = "source_name") -> DataFrame:
    """df with each source's rules; of equal names the last counts; a source that is not listed has the built-in rules."""
    last = rules.groupBy(F.col("name").alias("_name")).agg(F.max_by(F.struct("image_fallback", "requires_ua", "blocked"), "src_pos").alias("_rules"))
    out = df.join(last, F.col(source) == F.col("_name"), "left")
    none = F.array().cast("array<string>")
    return out.withColumns({"image_fallback": F.coalesce("_rules.image_fallback", F.lit(True)), "requires_ua": F.coalesce("_rules.requires_ua", F.lit(True)), "blocked": F.coalesce("_rules.blocked", none)}).drop("_name", "_rules")


def choose_image(og_image: Column, rss_image: Column, fallback: Column) -> Column:
    return F.coalesce(present(og_image), F.when(fallback, present(rss_image)))


def enrich(articles: DataFrame, pages: DataFrame) -> DataFrame:
    """articles (url, rss_image_url, image_fallback, blocked) with what their pages (url, html, content_type, final_url) say.

    Blocked articles and those without a page keep the feed's image only. Pages are joined by normalised url; of several pages
    of one, that with the least url and final_url as they came counts.
    """
    a = articles.withColumn("url", normalize_url(F.col("url"))).withColumn("_blocked", is_blocked(F.col("url"), F.col("blocked")))
    p = pages.select(normalize_url(F.col("url")).alias("_url"), "url", "html", "content_type", "final_url")
    first = F.min_by(F.struct("html", "content_type", "final_url"), F.struct("url", "final_url", "html")).alias("page")
    p = p.groupBy("_url").agg(first).select("_url", "page.*")
    p = p.withColumn("_og", F.when(F.contains("content_type", F.lit("text/html")), og_fields("html"))).drop("html")
    out = a.join(p, (F.col("url") == F.col("_url")) & ~F.col("_blocked"), "left")
    return out.withColumns(
        {
            "og_title": present(F.col("_og.og_title")),
            "og_description": present(F.col("_og.og_description")),
            "image_url": choose_image(F.col("_og.og_image"), F.col("rss_image_url"), F.col("image_fallback")),
            "url": F.when(F.col("_url").isNotNull(), F.coalesce(normalize_url(F.col("final_url")), F.col("url"))).otherwise(F.col("url")),
        }
    ).drop("_og", "_url", "content_type", "final_url", "_blocked")


def fetch_pages(urls: DataFrame, get: Callable[[str, bool], tuple[str, str, str]], concurrency: int = 8) -> DataFrame:
    """url, final_url, content_type, html, error of each row (url, requires_ua): get(url, send_user_agent) in at most
    `concurrency` tasks at a time; what it raises becomes the row's error."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url, agent in zip(batch.url, batch.requires_ua, strict=True):
                try:
                    rows.append((url, *get(url, bool(agent)), None))
                except Exception as e:  # noqa: BLE001 - one failing page must not stop the others
                    rows.append((url, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["url", "final_url", "content_type", "html", "error"], dtype=object)

    schema = "url string, final_url string, content_type string, html string, error string"
    return urls.select("url", "requires_ua").repartition(concurrency).mapInPandas(each, schema)
