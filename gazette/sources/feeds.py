"""Feed catalogs, feed documents and their entries."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from email.utils import parsedate_to_datetime
from html.entities import html5
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gazette.functions.text import present, strip
from gazette.functions.urls import with_normal_url
from gazette.operators.enrich import merge_rules

CATALOG = Path(__file__).parent.parent / "data" / "sources.yaml"
SOURCE_SCHEMA = "src_pos long, name string, url string, rss string, image_fallback boolean, requires_ua boolean, blocked array<string>"
ENTRY = (
    "struct<title:string,link:string,summary:string,description:string,published:string,updated:string,"
    "media_content:array<struct<url:string>>,media_thumbnail:array<struct<url:string>>,links:array<struct<href:string,type:string>>,image:struct<href:string>>"
)


def load_catalog(spark: SparkSession, path: str | Path = CATALOG) -> DataFrame:
    """Sources in the catalog's order with their rules merged; an empty file or one without sources is an error."""
    data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    if not data.get("sources"):
        raise ValueError(f"{path}: no sources")
    given = data.get("fetch_defaults") or {}
    rule = lambda r, default: {"image_fallback": r.get("image_fallback_rss_enclosure", default), "requires_ua": r.get("requires_user_agent", default), "blocked": r.get("blocked_domains")}
    defaults = rule(given, True) | {"blocked": given.get("blocked_domains") or []}
    rows = [(i, s["name"], s["url"], s["rss"], *rule(s.get("fetch_overrides") or {}, None).values()) for i, s in enumerate(data["sources"])]
    return merge_rules(spark.createDataFrame(rows, SOURCE_SCHEMA), defaults)


_CDATA = re.compile(r"(<!\[CDATA\[.*?\]\]>)", re.DOTALL)
_AMPERSAND = re.compile(r"&(?:(#\d+;|#[xX][0-9a-fA-F]+;|(?:amp|lt|gt|quot|apos);)|([A-Za-z][A-Za-z0-9]*;))?")


def _known(found: re.Match) -> str:
    if found[1]:
        return found[0]
    return html5.get(found[2], f"&amp;{found[2]}") if found[2] else "&amp;"


def _tree(xml: str) -> ElementTree.Element:
    """The document's root. Entities that HTML has and XML hasn't, and bare ampersands, are mended outside of CDATA."""
    parts = _CDATA.split(xml.lstrip("\ufeff \t\r\n"))
    return ElementTree.fromstring("".join(p if i % 2 else _AMPERSAND.sub(_known, p) for i, p in enumerate(parts)))


def _fields(item: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """An item's own elements, and those of its media groups: not what lies deeper, such as the title of an entry's source."""
    for e in item:
        if e.tag.endswith("}group") and "search.yahoo.com/mrss" in e.tag:
            yield from e
        else:
            yield e


def entries_of(xml: str) -> list[dict]:
    """The items of an RSS, RDF or Atom document, in its order."""
    local = lambda e: e.tag.rpartition("}")[2]
    media = lambda e: "search.yahoo.com/mrss" in e.tag
    out = []
    for item in (e for e in _tree(xml).iter() if isinstance(e.tag, str) and local(e) in ("item", "entry")):
        row: dict = {"media_content": [], "media_thumbnail": [], "links": []}
        for e in (x for x in _fields(item) if isinstance(x.tag, str)):
            kind, text = local(e), "".join(e.itertext())
            if media(e):
                if kind in ("content", "thumbnail"):
                    row[f"media_{kind}"].append({"url": e.get("url")})
                    row["media_thumbnail"] += [{"url": x.get("url")} for x in e if isinstance(x.tag, str) and media(x) and local(x) == "thumbnail"]
            elif kind == "link" and e.get("href"):
                row["links"].append({"href": e.get("href"), "type": e.get("type")})
                if e.get("rel", "alternate") == "alternate":
                    row.setdefault("link", e.get("href"))
            elif kind == "enclosure":
                row["links"].append({"href": e.get("url"), "type": e.get("type")})
            elif kind in ("title", "link", "updated", "summary"):
                row.setdefault(kind, text)
            elif kind in ("pubDate", "published", "date"):
                row.setdefault("published", text)
            elif kind in ("description", "encoded", "content"):
                row.setdefault("summary" if kind == "description" else "description", text)
            elif kind == "image" and e.get("href"):
                row["image"] = {"href": e.get("href")}
        out.append(row)
    return out


class FeedTasks:
    """The feeds of a catalog (src_pos, name, url of each), fetched in tasks."""

    def __init__(self, fetch: Callable[[str], str], rows: list, concurrency: int):
        self.fetch, self.rows, self.concurrency = fetch, rows, concurrency

    def dealt(self) -> list[list]:
        n = min(self.concurrency, len(self.rows))
        return [self.rows[i::n] for i in range(n)]

    def read(self, rows: list):
        for row in rows:
            yield from self._entries(*row)

    def _entries(self, src_pos, name, rss):
        names = ("title", "link", "summary", "description", "published", "updated")
        try:
            entries = entries_of(self.fetch(rss))
        except Exception as e:  # noqa: BLE001 - one failing source must not stop the others
            yield (src_pos, None, None, f"Source fetch failed ({name}): {e}")
            return
        for i, e in enumerate(entries):
            links = [(x["href"], x["type"]) for x in e["links"]]
            yield (src_pos, i, (*(e.get(n) for n in names), [(x["url"],) for x in e["media_content"]], [(x["url"],) for x in e["media_thumbnail"]], links, (e["image"]["href"],) if "image" in e else None), None)


class FeedSource(DataSource):
    """spark.read.format("feeds"). Options: `catalog` rows as JSON and `concurrency`, the number of partitions that the sources
    are dealt over; the fetcher is given to read_feeds(). A source that fails gives one row with an error and no entry."""

    COLUMNS = f"src_pos long, entry_pos long, entry {ENTRY}, error string"
    fetch: Callable[[str], str]

    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return self.COLUMNS

    def reader(self, schema):
        return _FeedReader(type(self).fetch, json.loads(self.options["catalog"]), int(self.options["concurrency"]))


class _FeedReader(DataSourceReader):
    def __init__(self, fetch: Callable[[str], str], rows: list, concurrency: int):
        self.tasks = FeedTasks(fetch, rows, concurrency)

    def partitions(self):
        return [InputPartition(rows) for rows in self.tasks.dealt()]

    def read(self, partition):
        yield from self.tasks.read(partition.value)


def read_feeds(sources: DataFrame, fetch: Callable[[str], str], concurrency: int = 8) -> DataFrame:
    """src_pos, entry_pos, entry, error of every source's feed, at most `concurrency` of them fetched at a time."""
    spark = sources.sparkSession
    spark.dataSource.register(type("Feeds", (FeedSource,), {"fetch": staticmethod(fetch)}))
    rows = [tuple(r) for r in sources.select("src_pos", "name", "rss").collect()]  # a catalog, not data
    return spark.read.format("feeds").option("catalog", json.dumps(rows)).option("concurrency", concurrency).load()


@F.pandas_udf(T.TimestampType())
def _any_date(texts: pd.Series) -> pd.Series:
    def one(text):
        try:
            return pd.Timestamp(parsedate_to_datetime(text)).tz_localize("UTC") if parsedate_to_datetime(text).tzinfo is None else pd.Timestamp(parsedate_to_datetime(text)).tz_convert("UTC")
        except (TypeError, ValueError):
            return pd.NaT

    return pd.to_datetime(pd.Series([one(t) for t in texts], index=texts.index), utc=True)


def parse_date(text: Column, any_date: bool = False) -> Column:
    """The instant of a mail or ISO date, read as UTC where it names no zone, whatever the session's; null where it can't be
    read. With any_date, an Arrow UDF reads what the JVM's patterns don't."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    iso = F.when(bare.rlike(r"^\d{4}-\d"), bare)
    # Only a text that names no zone is a time with a Z behind it.
    utc = [F.try_to_timestamp(F.concat(iso, F.lit(end))) for end in ("Z", "T00:00:00Z")]
    parsed = F.coalesce(*[F.try_to_timestamp(bare, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z")], *utc, F.try_to_timestamp(iso))
    return F.coalesce(parsed, _any_date(F.when(parsed.isNull(), text))) if any_date else parsed


def entry_time(published: Column, updated: Column) -> Column:
    """The first of the two that can be read."""
    return F.coalesce(parse_date(published, any_date=True), parse_date(updated, any_date=True))


def entry_image(entry: Column) -> Column:
    """The first image of media contents, thumbnails, links of an image type, and the entry's own image."""
    first = lambda a, key: F.try_element_at(F.filter(a, lambda x: x[key] != ""), F.lit(1))[key]
    pictures = F.filter(entry["links"], lambda x: F.coalesce(F.startswith(x["type"], F.lit("image/")), F.lit(False)))
    return F.coalesce(first(entry["media_content"], "url"), first(entry["media_thumbnail"], "url"), first(pictures, "href"), present(entry["image"]["href"]))


def entry_title(title: Column) -> Column:
    return strip(F.coalesce(present(title), F.lit("Untitled Article")))


def entry_description(summary: Column, description: Column) -> Column:
    return present(strip(F.coalesce(present(summary), present(description), F.lit(""))))


def article_id(source: Column, url: Column, title: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", source, url, strip(F.lower(title))), 256), 1, 24)


def head_then_filter(entries: DataFrame, link: Column, most: int = 50) -> DataFrame:
    """The first `most` entries of each feed, and of those the ones with a link."""
    return entries.where(F.col("entry_pos") < most).where(strip(F.coalesce(link, F.lit(""))) != "")


def scanned(entries: DataFrame, sources: DataFrame, most: int = 50) -> DataFrame:
    """Articles of the feeds' entries that have a link, with the link as it came and why no URL can be read from it (fault, else
    null); pos says their order over all sources. entries should be stored (see with_normal_url)."""
    e = F.col("entry")
    good = head_then_filter(entries.where("error is null"), e["link"], most)
    s = sources.select("src_pos", F.col("name").alias("source_name"), F.col("rss").alias("source_rss"), F.col("url").alias("source_url"))
    read = with_normal_url(good, e["link"], "url", "fault")
    out = read.join(F.broadcast(s), "src_pos").select(
        *s.columns,
        (F.col("src_pos") * 1_000_000 + F.col("entry_pos")).alias("pos"),
        entry_title(e["title"]).alias("title"),
        e["link"].alias("link"),
        "url",
        "fault",
        entry_time(e["published"], e["updated"]).alias("published_at"),
        entry_description(e["summary"], e["description"]).alias("description"),
        entry_image(e).alias("rss_image_url"),
    )
    return out.withColumn("id", article_id(F.col("source_name"), F.col("url"), F.col("title"))).withColumn("duplicate_count", F.lit(1))


def articles(entries: DataFrame, sources: DataFrame, most: int = 50) -> DataFrame:
    """The scanned articles whose links can be read."""
    return scanned(entries, sources, most).where("fault is null").drop("link", "fault")
