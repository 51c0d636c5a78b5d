"""The registered queries of the news operators, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazette.functions import render, scoring, text, urls
from gazette.functions.lexicon import DEFAULT
from gazette.operators import clustering, datefilter, dedupe, enrich, ranking, rejects
from gazette.plans import adapters as A
from gazette.plans import deliver
from gazette.sources import feeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_as_of = lambda: F.lit(A.AS_OF).cast("timestamp")
_list = lambda c: F.array_join(F.array_sort(c), " ")

# Sources and rules: the hosts of the pages and the sources of the documents stand for a catalog.

_RULES_SQL = """named AS (SELECT source AS name, row_number() OVER (ORDER BY source) AS src_pos FROM documents GROUP BY source),
overrides AS (SELECT name, src_pos,
    CASE WHEN src_pos % 3 = 0 THEN false END AS image_fallback, CASE WHEN src_pos % 4 = 0 THEN false END AS requires_ua,
    CASE WHEN src_pos % 5 = 0 THEN []::VARCHAR[] WHEN src_pos % 5 = 1 THEN ['site1.example', name || '.example'] END AS blocked FROM named),
merged AS (SELECT name, src_pos, coalesce(image_fallback, true) AS image_fallback, coalesce(requires_ua, true) AS requires_ua, coalesce(blocked, ['default.example']) AS blocked FROM overrides)"""


def _sources(spark, sf_dir) -> DataFrame:
    n = F.row_number().over(Window.orderBy("name")).cast("long")
    s = A.table(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct().withColumn("src_pos", n)
    some = lambda by, v: F.when(F.col("src_pos") % by == 0, v)
    blocked = some(5, F.array().cast("array<string>")).when(F.col("src_pos") % 5 == 1, F.array(F.lit("site1.example"), F.concat("name", F.lit(".example"))))
    s = s.withColumns({"image_fallback": some(3, F.lit(False)), "requires_ua": some(4, F.lit(False)), "blocked": blocked})
    return enrich.merge_rules(s, {"image_fallback": True, "requires_ua": True, "blocked": ["default.example"]})


@query(f"WITH {_RULES_SQL} SELECT name, src_pos, image_fallback, requires_ua, array_to_string(blocked, ',') AS blocked FROM merged")
def rules_merge(spark, sf_dir):
    return _sources(spark, sf_dir).withColumn("blocked", F.array_join("blocked", ","))


@query(f"""WITH {_RULES_SQL}, listed AS (SELECT name, CASE WHEN src_pos % 6 = 4 THEN false ELSE image_fallback END AS image_fallback, requires_ua, CASE WHEN src_pos % 6 = 4 THEN ['again.example'] ELSE blocked END AS blocked FROM merged WHERE src_pos % 6 <> 5)
SELECT d.doc_id, coalesce(m.image_fallback, true) AS image_fallback, coalesce(m.requires_ua, true) AS requires_ua, coalesce(array_to_string(m.blocked, ','), '') AS blocked
FROM documents d LEFT JOIN listed m ON m.name = d.source""")
def rules_lookup(spark, sf_dir):
    """Some sources are not listed, and some are listed twice: then the later rules count."""
    d = A.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_name"))
    listed = _sources(spark, sf_dir).where("src_pos % 6 <> 5")
    again = listed.where("src_pos % 6 = 4").withColumns({"src_pos": F.col("src_pos") + 1000, "image_fallback": F.lit(False), "blocked": F.array(F.lit("again.example"))})
    return enrich.lookup_rules(d, listed.unionByName(again)).select("doc_id", "image_fallback", "requires_ua", F.array_join("blocked", ",").alias("blocked"))


@query(f"WITH {A.PAGES_SQL} SELECT page_id, 0::BIGINT AS entry_pos, title, url AS link FROM t1 UNION ALL SELECT page_id, 1, 'second of ' || page_id, NULL FROM t1")
def feed_scan(spark, sf_dir):
    """Each page as a feed of two items, one of them without a link, read by the feed parser."""
    p = A.page_articles(spark, sf_dir)
    item = F.concat(F.lit("<item><title>"), text.escape_html(F.col("title")), F.lit("</title><link>"), text.escape_html(F.col("url")), F.lit("</link></item>"))
    rss = F.concat(F.lit("<rss><channel>"), item, F.lit("<item><title>second of "), "page_id", F.lit("</title></item></channel></rss>"))
    rows = p.select("page_id", rss.alias("xml"))

    def each(batches):
        for b in batches:
            found = [(i, k, e.get("title"), e.get("link")) for i, x in zip(b.page_id, b.xml, strict=True) for k, e in enumerate(feeds.entries_of(x))]
            yield pd.DataFrame(found, columns=["page_id", "entry_pos", "title", "link"])

    return rows.mapInPandas(each, "page_id long, entry_pos long, title string, link string")


_ENTRIES_SQL = "entries AS (SELECT doc_id, source, CASE WHEN doc_id % 7 <> 0 THEN 'https://x.example/' || doc_id END AS link, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS entry_pos FROM documents)"


@query(f"WITH {_ENTRIES_SQL} SELECT doc_id, entry_pos FROM entries WHERE entry_pos < 50 AND link IS NOT NULL")
def feed_head_then_filter(spark, sf_dir):
    at = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long") - 1
    link = F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("https://x.example/"), "doc_id"))
    e = A.table(spark, sf_dir, "documents").select("doc_id", "source").withColumn("link", link).withColumn("entry_pos", at)
    return feeds.head_then_filter(e, F.col("link")).select("doc_id", "entry_pos")


@query(r"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Untitled Article' WHEN doc_id % 5 = 1 THEN '' ELSE trim(text, E' \n\t\r') END AS title,
    CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN nullif(trim(text, E' \n\t\r'), '') ELSE nullif(trim('also ' || text, E' \n\t\r'), '') END AS description FROM documents""")
def entry_projection(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    by = lambda n, *x: F.when(F.col("doc_id") % n == 0, x[0]).when(F.col("doc_id") % n == 1, x[1]).otherwise(x[2])
    title = by(5, F.lit(""), F.lit("  \n "), F.col("text"))
    return d.select("doc_id", feeds.entry_title(title).alias("title"), feeds.entry_description(by(3, F.lit(" \t"), F.col("text"), F.lit("")), F.concat(F.lit("also "), "text")).alias("description"))


@query("SELECT event_id, date_trunc('second', ts) AS ts FROM events")
def rfc2822_parse(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    said = F.date_format("at", "E, dd MMM yyyy HH:mm:ss")
    return e.select("event_id", feeds.parse_date(F.concat(said, F.when(F.col("event_id") % 2 == 0, " GMT").otherwise(" +0000"))).cast("timestamp_ntz").alias("ts"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN url || '#c' WHEN 1 THEN url || '#t' WHEN 2 THEN url || '#l' ELSE NULL END AS image FROM pages")
def entry_image_coalesce(spark, sf_dir):
    u, k = F.col("url"), F.col("page_id") % 4
    one = lambda c, when: F.array(F.struct(F.when(when, F.concat(u, F.lit(c))).otherwise(F.lit("")).alias("url")))
    links = F.array(F.struct(u.alias("href"), F.lit("text/html").alias("type")), F.struct(F.when(k <= 2, F.concat(u, F.lit("#l"))).alias("href"), F.lit("image/png").alias("type")))
    e = F.struct(one("#c", k == 0).alias("media_content"), one("#t", k <= 1).alias("media_thumbnail"), links.alias("links"), F.struct(F.lit(None).cast("string").alias("href")).alias("image"))
    return A.table(spark, sf_dir, "pages").withColumn("entry", e).select("page_id", feeds.entry_image(F.col("entry")).alias("image"))


@query(f"WITH {A.PAGES_SQL} SELECT page_id, substr(sha256(source_name || '|' || url || '|' || trim(lower(title))), 1, 24) AS id FROM t1")
def article_id(spark, sf_dir):
    return A.page_articles(spark, sf_dir).select("page_id", feeds.article_id(F.col("source_name"), F.col("url"), F.col("title")).alias("id"))


_KEPT = f"list_filter(string_split(regexp_extract(whole, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT list_contains({_quoted(urls.TRACKING)}, split_part(p, '=', 1)))"


_URLS_SQL = f"""cut AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS whole FROM pages),
kept AS (SELECT page_id, split_part(whole, '?', 1) AS base, array_to_string(list_transform({_KEPT}, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), '&') AS q FROM cut),
urls AS (SELECT page_id, CASE WHEN q = '' THEN base ELSE base || '?' || q END AS url FROM kept)"""


@query(f"WITH {_URLS_SQL} SELECT page_id, url FROM urls")
def normalize_url(spark, sf_dir):
    return urls.with_normal_url(A.table(spark, sf_dir, "pages").select("page_id", "url"), F.col("url"))


_BAD_LINKS_SQL = """links AS (SELECT page_id, source_name, CASE page_id % 5 WHEN 0 THEN 'http://[' || page_id || '/a' WHEN 1 THEN ' http://[p' || page_id || ']/a#b' ELSE url END AS link,
    CASE page_id % 5 WHEN 0 THEN 'Invalid IPv6 URL' WHEN 1 THEN chr(39) || 'p' || page_id || chr(39) || ' does not appear to be an IPv4 or IPv6 address' END AS fault FROM t1)"""


def _bad_links(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Pages, two of five with links that no URL can be read from: the good ones and the rejects."""
    p = A.page_articles(spark, sf_dir).select("page_id", "source_name", "url")
    k = F.col("page_id") % 5
    link = F.when(k == 0, F.concat(F.lit("http://["), "page_id", F.lit("/a"))).when(k == 1, F.concat(F.lit(" http://[p"), "page_id", F.lit("]/a#b"))).otherwise(F.col("url"))
    return rejects.split(urls.with_normal_url(p.withColumn("link", link), F.col("link"), "url", "fault"), "fault", "links")


@query(f"WITH {A.PAGES_SQL}, {_BAD_LINKS_SQL} SELECT page_id, source_name, link, fault FROM links WHERE fault IS NOT NULL")
def rejected_links(spark, sf_dir):
    return _bad_links(spark, sf_dir)[1].select("page_id", "source_name", "link", "fault")


@query(f"WITH {_URLS_SQL} SELECT page_id, url FROM urls WHERE page_id % 5 > 1")
def accepted_links(spark, sf_dir):
    """The other side of the same split."""
    return _bad_links(spark, sf_dir)[0].select("page_id", "url")


@query(f"""WITH {_URLS_SQL}, {A.PAGES_SQL}, keyed AS (SELECT u.url, t1.page_id, t1.published_at FROM t1 JOIN urls u USING (page_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY published_at DESC NULLS LAST, page_id) AS nth, count(*) OVER (PARTITION BY url) AS duplicate_count, min(page_id) OVER (PARTITION BY url) AS first_pos FROM keyed)
SELECT url, page_id, duplicate_count, first_pos FROM r WHERE nth = 1""")
def dedupe_urls(spark, sf_dir):
    """The latest page of each normalised URL."""
    p = urls.with_normal_url(A.page_articles(spark, sf_dir).select("page_id", "published_at", "url"), F.col("url"))
    return dedupe.keep_latest(p, ["url"], "published_at", "page_id").select("url", "page_id", "duplicate_count", "first_pos")


_HOST = "lower(regexp_extract(url, '^https?://([^/:?#]+)', 1))"


@query(f"WITH h AS (SELECT page_id, {_HOST} AS host FROM pages) SELECT page_id, host, host IN ('site1.example') OR ends_with(host, '.site1.example') OR host = 'example.com' OR ends_with(host, '.example.com') AS blocked FROM h")
def domain_block(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.is_blocked(F.col("url"), text.literal_array([" Site1.example", "example.com "])).alias("blocked"))


@query(f"WITH {A.PAGES_SQL} SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE trim(title) END AS og_title, nullif('about ' || page_id, '') AS og_description, url AS og_image FROM t1")
def og_extract(spark, sf_dir):
    p = A.page_articles(spark, sf_dir)
    esc = lambda c: text.escape_html(c, quotes=True)
    # Titles are cut from html, so their entities are as they should be.
    title = F.when(F.col("page_id") % 3 == 0, F.lit('<meta property="og:title"><meta name="og:title" content="no">')).otherwise(F.concat(F.lit('<meta content=" '), text.escape_html(F.col("title"), quotes=True), F.lit('" property="og:title"/>')))
    metas = F.concat(title, F.lit('<meta name="description" content="about '), "page_id", F.lit('"><meta property="twitter:image" content="'), esc(F.col("url")), F.lit('">'))
    html = F.concat(F.lit("<html><head>"), metas, F.lit("</head>"), "html")
    return p.select("page_id", enrich.og_fields(html).alias("og")).select("page_id", "og.*")


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || '#og' WHEN page_id % 3 <> 0 AND page_id % 5 <> 0 THEN url || '#rss' END AS image_url FROM pages")
def image_fallback(spark, sf_dir):
    k, u = F.col("page_id"), F.col("url")
    og = F.when(k % 2 == 0, F.concat(u, F.lit("#og"))).otherwise(F.lit(""))
    rss = F.when(k % 5 != 0, F.concat(u, F.lit("#rss"))).otherwise(F.lit(""))
    return A.table(spark, sf_dir, "pages").select("page_id", enrich.choose_image(og, rss, k % 3 != 0).alias("image_url"))


@query(f"""WITH {A.PAGES_SQL}, {_URLS_SQL}, fetched AS (SELECT u.url AS key, min(page_id) AS f, arg_min(p.url, page_id) AS own FROM urls u JOIN pages p USING (page_id) GROUP BY u.url)
SELECT page_id, CASE WHEN f % 4 <> 0 THEN 'og ' || f ELSE title END AS effective_title, CASE WHEN f % 4 <> 0 AND f % 6 <> 0 THEN own ELSE t1.url || '/rss.png' END AS image_url
FROM t1 JOIN urls u USING (page_id) JOIN fetched ON key = u.url""")
def enrich_join(spark, sf_dir):
    p = A.page_articles(spark, sf_dir)
    art = p.select("page_id", "title", F.concat("url", F.lit("#frag")).alias("url"), F.concat("url", F.lit("/rss.png")).alias("rss_image_url"), F.lit(True).alias("image_fallback"), F.array().cast("array<string>").alias("blocked"))
    image = F.when(F.col("page_id") % 6 != 0, F.concat(F.lit('<meta property="og:image" content="'), text.escape_html(F.col("url"), quotes=True), F.lit('">'))).otherwise("")
    html = F.concat(F.lit('<meta property="og:title" content="og '), "page_id", F.lit('">'), image)
    pages = p.select("page_id", "url", html.alias("html"), F.when(F.col("page_id") % 4 != 0, "text/html; charset=utf-8").otherwise("application/pdf").alias("content_type"), F.col("url").alias("final_url"))
    # A normalised url is fetched once: for the first of its pages.
    first = F.min_by(F.struct("url", "html", "content_type", "final_url"), "page_id").alias("page")
    pages = pages.groupBy(urls.normalize_url(F.col("url"))).agg(first).select("page.*")
    out = enrich.enrich(art, pages)
    return out.select("page_id", scoring.effective_title(F.col("og_title"), F.col("title")).alias("effective_title"), "image_url")


# Text.

_TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"


def _tokens_sql(x: str) -> str:
    return f"list_filter(list_distinct({_TOKENS.format(x)}), lambda w: NOT list_contains({_quoted(DEFAULT.stopwords)}, w))"


@query(f"SELECT doc_id, array_to_string({_TOKENS.format('text')}, ' ') AS norm FROM documents")
def normalize_text(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("norm"))


@query(f"SELECT doc_id, array_to_string(list_sort({_tokens_sql('text')}), ' ') AS tokens FROM documents")
def tokenize(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", _list(text.tokenize(F.col("text"), DEFAULT.stopwords)).alias("tokens"))


_SENTENCES = r"list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


@query(f"SELECT doc_id, len({_SENTENCES})::BIGINT AS n, array_to_string({_SENTENCES}, '|') AS sentences FROM documents")
def split_sentences(spark, sf_dir):
    s = text.split_sentences(F.col("text"))
    return A.table(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.array_join(s, "|").alias("sentences"))


def _enforced(x: str) -> str:
    return f"array_to_string(list_concat({x}, {_quoted(text.SENTENCE_PADS)}[len({x}) + 1:3])[1:3], ' ')"


@query(f"WITH s AS (SELECT doc_id, {_SENTENCES} AS s FROM documents) SELECT doc_id, {_enforced('s')} AS text FROM s")
def enforce_sentences(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", text.enforce_sentences(F.col("text")).alias("text"))


_SUMMARY_SQL = A.DOCUMENTS_SQL + r""", said AS (SELECT *, trim(description, E' \n\t') AS bare FROM t2),
three AS (SELECT doc_id, title || ' is a notable AI update from ' || source || '. ' ||
    CASE WHEN bare <> '' THEN 'Key context: ' || rtrim(left(bare, 180), '.') || '.' ELSE 'The story appears relevant to current AI research and product developments.' END ||
    ' Open the link to review full details, claims, and technical context.' AS text FROM said),
cut AS (SELECT doc_id, """ + _SENTENCES + " AS s FROM three), summaries AS (SELECT doc_id, " + _enforced("s") + " AS summary FROM cut)"


@query(f"WITH {_SUMMARY_SQL} SELECT doc_id, summary FROM summaries")
def template_summary(spark, sf_dir):
    return _summaries(spark, sf_dir).select("doc_id", "summary")


def _summaries(spark, sf_dir) -> DataFrame:
    return render.with_template_summary(A.document_articles(spark, sf_dir), F.col("title"), F.col("source"), F.col("description"))


def _cut(x: str, limit: str) -> str:
    return rf"CASE WHEN length({x}) <= {limit} THEN {x} WHEN {limit} <= 3 THEN left({x}, greatest({limit}, 0)) ELSE rtrim(left({x}, greatest({limit} - 3, 0)), E' \n\t') || '...' END"


def _escaped(x: str, quotes: bool = False) -> str:
    out = f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return f"replace(replace({out}, '\"', '&quot;'), '''', '&#x27;')" if quotes else out


@query(f"SELECT doc_id, {_cut('text', '(doc_id % 300)')} AS text FROM documents")
def truncate_text(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", text.truncate(F.col("text"), (F.col("doc_id") % 300).cast("int")).alias("text"))


_LINKED = f"""{_SUMMARY_SQL}, parts AS (SELECT t2.doc_id, 'https://x.example/?a=1&b="' || t2.doc_id AS url, description AS title, description || ' <' || summary || '>' AS summary, t2.doc_id % 2 = 0 AS image FROM t2 JOIN summaries USING (doc_id)),
esc AS (SELECT doc_id, image, {_escaped('url', True)} AS url, {_escaped('title')} AS title, {_escaped('summary')} AS body FROM parts),
pre AS (SELECT *, '<a href="' || url || '">' || {_cut('title', '200')} || '</a>' || chr(10) || chr(10) AS prefix, '<a href="' || url || '">' || title || '</a>' || chr(10) || chr(10) || body AS whole FROM esc),
shown AS (SELECT doc_id, image, left(prefix || {_cut('body', 'greatest(1024 - length(prefix), 0)')}, 1024) AS caption, {_cut('whole', '4096')} AS message FROM pre)"""


def _parts(spark, sf_dir) -> DataFrame:
    d = _summaries(spark, sf_dir)
    return d.select("doc_id", F.concat(F.lit('https://x.example/?a=1&b="'), "doc_id").alias("url"), F.col("description").alias("title"), F.concat("description", F.lit(" <"), "summary", F.lit(">")).alias("summary"), F.when(F.col("doc_id") % 2 == 0, F.lit("i")).alias("image"))


@query(f"WITH {_LINKED} SELECT doc_id, caption AS text FROM shown")
def render_caption(spark, sf_dir):
    return render.with_caption(_parts(spark, sf_dir), F.col("url"), F.col("title"), F.col("summary"), "text").select("doc_id", "text")


@query(f"WITH {_LINKED} SELECT doc_id, message AS text FROM shown")
def render_text(spark, sf_dir):
    return render.with_text_message(_parts(spark, sf_dir), F.col("url"), F.col("title"), F.col("summary"), "text").select("doc_id", "text")


@query(f"WITH {_LINKED} SELECT doc_id, CASE WHEN image THEN 'photo' ELSE 'text' END AS mode, CASE WHEN image THEN caption ELSE message END AS preview FROM shown")
def delivery_preview(spark, sf_dir):
    shown = render.with_preview(_parts(spark, sf_dir), F.col("url"), F.col("title"), F.col("summary"), F.col("image"))
    return shown.select("doc_id", "mode", "preview")


@query("SELECT count(*) AS attempted, count(*) FILTER (WHERE doc_id % 3 = 0) AS failed, count(*) FILTER (WHERE doc_id % 3 <> 0) AS sent FROM documents")
def delivery_rollup(spark, sf_dir):
    k = F.col("doc_id") % 3
    return deliver.rollup(A.table(spark, sf_dir, "documents").select(F.when(k == 0, "error").when(k == 1, "sent").otherwise("dry_run").alias("status")))


@query("SELECT doc_id AS rank, doc_id || ': ' || CASE WHEN doc_id % 2 = 0 THEN 'unknown' ELSE source END AS failure FROM documents WHERE doc_id % 3 = 0 ORDER BY doc_id LIMIT 3")
def delivery_failures(spark, sf_dir):
    """The first three of all deliveries that failed."""
    error = F.when(F.col("doc_id") % 2 == 1, F.col("source"))
    d = A.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("article_id"), F.col("doc_id").alias("rank"), error.alias("error"), F.when(F.col("doc_id") % 3 == 0, "error").otherwise("sent").alias("status"))
    return deliver.first_failures(d)


# Scores.

_CONTENT = "array_to_string(regexp_extract_all(lower(title || ' ' || description), '[a-z0-9]+'), ' ')"
_GROUPS = [(n, w) for n, w, _ in DEFAULT.groups] + [("low", DEFAULT.low)]
_hits_sql = lambda w: f"len(list_intersect(tokens, {_quoted(w)}))::BIGINT"
_phrases_sql = lambda p: "(" + " + ".join(f"contains(norm, '{x}')::BIGINT" for x in p) + ")"
_HITS_SQL = f"""{A.HEADLINES_SQL}, normed AS (SELECT *, {_CONTENT} AS norm FROM t3), tokened AS (SELECT *, {_tokens_sql('norm')} AS tokens FROM normed),
hit AS (SELECT *, {", ".join(f"{_hits_sql(w)} AS {n}" for n, w in _GROUPS)}, {_phrases_sql(DEFAULT.high_phrases)} AS high_phrases, {_phrases_sql(DEFAULT.low_phrases)} AS low_phrases FROM tokened)"""
_d = lambda x: f"{x}::DOUBLE"
_BOOSTS = " + ".join(f"(CASE WHEN {n} <= 0 THEN 0::DOUBLE ELSE {b}::DOUBLE + least({n} - 1, 2) * 0.03::DOUBLE END)" for n, _, b in DEFAULT.groups)
_SCORES_SQL = f"""{_HITS_SQL}, added AS (SELECT *, 0.15::DOUBLE + {_BOOSTS} + least(high_phrases, 2) * 0.07::DOUBLE AS s, low + low_phrases AS lows, product + tech + startup + enterprise + deal > 0 AS any_hit FROM hit),
scored AS (SELECT *, CASE WHEN norm = '' THEN 0.2::DOUBLE ELSE greatest(0::DOUBLE, least(1::DOUBLE, s - CASE WHEN lows > 0 THEN CASE WHEN any_hit THEN 0.08::DOUBLE ELSE 0.22::DOUBLE END + least(lows, 3) * 0.03::DOUBLE ELSE 0::DOUBLE END)) END AS relevance,
    CASE WHEN published_at IS NULL THEN 0.3::DOUBLE ELSE {{recency}} END AS recency,
    coalesce(map_extract(MAP {{{{{", ".join(f"'{k}': {v}::DOUBLE" for k, v in DEFAULT.source_weights.items())}}}}}, trim(lower(source_name)))[1], 0.7::DOUBLE) AS weight,
    least(len(list_distinct(list_filter(regexp_split_to_array(lower(title), '\\s+'), lambda x: x <> ''))) / 20::DOUBLE, 1::DOUBLE) AS novelty FROM added)"""


def _recency_sql(ts: str) -> str:
    age = f"greatest(epoch_us(TIMESTAMP '{A.AS_OF}') - epoch_us({ts}), 0) / 3600000000.0::DOUBLE"
    return "CASE " + " ".join(f"WHEN {age} <= {h} THEN {v}::DOUBLE" for h, v in ((6, 1.0), (24, 0.8), (48, 0.6), (96, 0.4))) + " ELSE 0.2::DOUBLE END"


_SCORES_SQL = _SCORES_SQL.format(recency=_recency_sql("published_at"))
_final = lambda size: f"round(0.38::DOUBLE * relevance + 0.24::DOUBLE * recency + 0.14::DOUBLE * weight + 0.10::DOUBLE * least(duplicate_count / 5::DOUBLE, 1::DOUBLE) + 0.09::DOUBLE * least({size} / 5::DOUBLE, 1::DOUBLE) + 0.05::DOUBLE * novelty, 5)"


def _headlines(spark, sf_dir) -> DataFrame:
    none = F.lit(None).cast("string")
    return A.headlines(spark, sf_dir).withColumns({"og_title": none, "og_description": none, "cluster_size": F.lit(1)})


@query(f"WITH {_HITS_SQL} SELECT doc_id, product, tech, startup, enterprise, deal, low FROM hit")
def lexicon_hits(spark, sf_dir):
    hit, at = scoring.with_hits(A.headlines(spark, sf_dir), F.col("title"), F.col("description"))
    return hit.select("doc_id", *[F.col(at[n]).alias(n) for n, _ in _GROUPS])


@query(f"WITH {_HITS_SQL} SELECT doc_id, high_phrases, low_phrases FROM hit")
def phrase_hits(spark, sf_dir):
    hit, at = scoring.with_hits(A.headlines(spark, sf_dir), F.col("title"), F.col("description"))
    return hit.select("doc_id", F.col(at["high_phrases"]).alias("high_phrases"), F.col(at["low_phrases"]).alias("low_phrases"))


@query(f"WITH {_SCORES_SQL} SELECT doc_id, round(relevance, 9) AS relevance FROM scored")
def relevance_score(spark, sf_dir):
    scored = scoring.with_relevance(A.headlines(spark, sf_dir), F.col("title"), F.col("description"))
    return scored.select("doc_id", F.round("relevance", 9).alias("relevance"))


@query(f"SELECT event_id, {_recency_sql('ts')} AS recency FROM events")
def recency_score(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select("event_id", scoring.recency(F.col("ts"), _as_of()).alias("recency"))


@query(f"WITH {_SCORES_SQL} SELECT doc_id, weight FROM scored")
def source_weight(spark, sf_dir):
    return A.headlines(spark, sf_dir).select("doc_id", scoring.source_weight(F.col("source_name")).alias("weight"))


@query(f"WITH {_SCORES_SQL} SELECT doc_id, novelty FROM scored")
def novelty_score(spark, sf_dir):
    return A.headlines(spark, sf_dir).select("doc_id", scoring.novelty(F.col("title")).alias("novelty"))


@query(f"WITH {_SCORES_SQL} SELECT doc_id, {_final('1')} AS score FROM scored")
def final_score(spark, sf_dir):
    return ranking.score_rows(_headlines(spark, sf_dir), _as_of()).select("doc_id", "score")


@query(f"""WITH {_SCORES_SQL}, f AS (SELECT doc_id, published_at, {_final('1')} AS score FROM scored)
SELECT row_number() OVER (ORDER BY score DESC, published_at DESC NULLS LAST, doc_id) AS rank, doc_id, score FROM f QUALIFY rank <= 50""")
def rank_topk(spark, sf_dir):
    return ranking.top_k(ranking.score_rows(_headlines(spark, sf_dir), _as_of()), 50, tie="doc_id").select("rank", "doc_id", "score")


# Filters, keep-latest, clusters.

_NOON = datetime(2024, 1, 15, 12, tzinfo=timezone.utc)


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16'")
def today_filter(spark, sf_dir):
    return datefilter.published_today(A.table(spark, sf_dir, "events"), _NOON, "ts").select("event_id", "ts")


@query("SELECT event_id, ts FROM events WHERE date_trunc('day', ts - INTERVAL 5 HOUR) = TIMESTAMP '2024-01-15'")
def today_filter_tz(spark, sf_dir):
    return datefilter.published_today(A.table(spark, sf_dir, "events"), _NOON.astimezone(timezone(timedelta(hours=-5))), "ts").select("event_id", "ts")


@query("""WITH d AS (SELECT *, (ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16') AS today FROM events)
SELECT count(*) AS n, count(*) FILTER (WHERE today) AS kept, count(*) - count(*) FILTER (WHERE today) AS filtered FROM d""")
def filtered_count(spark, sf_dir):
    """How many rows the filter by day keeps and drops."""
    events = A.table(spark, sf_dir, "events")
    kept = datefilter.published_today(events, _NOON, "ts").select(F.lit(1).alias("kept"), F.lit(0).alias("n"))
    return events.select(F.lit(0).alias("kept"), F.lit(1).alias("n")).unionByName(kept).agg(F.sum("n").alias("n"), F.sum("kept").alias("kept")).withColumn("filtered", F.col("n") - F.col("kept"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id) AS nth, count(*) OVER (PARTITION BY user_id, event_type) AS duplicate_count,
    min(event_id) OVER (PARTITION BY user_id, event_type) AS first_pos FROM events)
SELECT user_id, event_type, event_id, duplicate_count, first_pos FROM r WHERE nth = 1""")
def dedupe_keep_latest(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return dedupe.keep_latest(e, ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "duplicate_count", "first_pos")


@query("SELECT event_id, row_number() OVER (ORDER BY ts DESC NULLS LAST, event_id) AS rk FROM events")
def scan_order(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("published_at"), F.col("event_id").alias("pos"))
    return clustering.scan_order(e).select("event_id", "rk")


def _ranked_pages(spark, sf_dir) -> DataFrame:
    return clustering.stored(clustering.with_tokens(clustering.scan_order(A.page_articles(spark, sf_dir).drop("html"))), "page-rows")


#: Rows whose page_id is divisible by 50 ask all titles: each distinct title, by the rk of its first row.
def _pairs_sql(articles: str) -> str:
    return f"""{articles}, ordered AS (SELECT row_number() OVER (ORDER BY published_at DESC NULLS LAST, page_id) AS rk, page_id, published_at, title, array_to_string({_TOKENS.format('title')}, ' ') AS norm FROM t1),
tokened AS (SELECT *, {_tokens_sql('title')} AS tokens FROM ordered),
kinds AS (SELECT * FROM tokened QUALIFY rk = min(rk) OVER (PARTITION BY norm)),
asked AS (SELECT * FROM tokened WHERE page_id % 50 = 0),
pairs AS (SELECT a.l, b.r, count(*) AS overlap FROM (SELECT rk AS l, norm, unnest(tokens) AS t FROM asked) a JOIN (SELECT rk AS r, norm, unnest(tokens) AS t FROM kinds) b ON a.t = b.t AND a.norm <> b.norm GROUP BY ALL HAVING count(*) >= 2),
sides AS (SELECT p.*, len(a.tokens) AS ln, len(b.tokens) AS rn, a.published_at AS la, a.norm AS lnorm, b.norm AS rnorm FROM pairs p JOIN asked a ON a.rk = p.l JOIN kinds b ON b.rk = p.r)"""


_PAIRS_SQL = _pairs_sql(A.PAGES_SQL)
#: The headlines of the documents as articles.
_HEADS_SQL = f"{A.HEADLINES_SQL}, t1 AS (SELECT doc_id AS page_id, title, published_at FROM t3)"


@query(f"WITH {_PAIRS_SQL} SELECT l, r, overlap FROM pairs")
def candidate_pairs(spark, sf_dir):
    """Rows of every fiftieth page with the titles that share two tokens or more; title_members has a title's rows."""
    _, asked, kinds = _asked(spark, sf_dir)
    return clustering.candidate_pairs(asked, kinds).select("l", "r", "overlap")


def _titles(spark, sf_dir) -> DataFrame:
    return clustering.stored(clustering.titles(_ranked_pages(spark, sf_dir)), "page-titles")


def _asked(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _ranked_pages(spark, sf_dir)
    return rows, rows.where("page_id % 50 = 0"), clustering.stored(clustering.titles(rows), "page-titles")


def _sides(spark, sf_dir, **more) -> DataFrame:
    _, asked, kinds = _asked(spark, sf_dir)
    return clustering.with_ratios(clustering.candidate_pairs(asked, kinds, **more))


_quick = lambda: clustering.shared_ratio(F.col("both"), F.col("l_length") + F.col("r_length"))


@query(f"WITH {_PAIRS_SQL} SELECT l, r, overlap / (ln + rn - overlap)::DOUBLE AS jaccard FROM sides")
def title_jaccard(spark, sf_dir):
    return _sides(spark, sf_dir).select("l", "r", "jaccard")


@query(f"""WITH {_PAIRS_SQL}, met AS (SELECT s.l, s.r, s.la IS NULL OR o.published_at IS NULL OR abs(epoch_us(s.la) - epoch_us(o.published_at)) <= 432000000000 AS near FROM sides s JOIN ordered o ON o.norm = s.rnorm)
SELECT l, r, count(*) FILTER (WHERE near) AS aligned, count(*) FILTER (WHERE NOT near) AS apart FROM met GROUP BY l, r""")
def time_aligned_pairs(spark, sf_dir):
    """Of the rows that have title r, how many are near row l in time and how many aren't."""
    rows, asked, kinds = _asked(spark, sf_dir)
    return clustering.candidate_pairs(asked, kinds, rows=rows).select("l", "r", "aligned", "apart")


def _headline_rows(spark, sf_dir) -> DataFrame:
    heads = A.headlines(spark, sf_dir).select(F.col("doc_id").alias("page_id"), F.col("doc_id").alias("pos"), "title", "published_at")
    return clustering.stored(clustering.with_tokens(clustering.scan_order(heads)), "headline-rows")


_CHARACTERS_SQL = "string_split(' 0123456789abcdefghijklmnopqrstuvwxyz', '')"


_QUICK_SQL = f"2 * list_sum(list_transform({_CHARACTERS_SQL}, lambda c: least(length(lnorm) - length(replace(lnorm, c, '')), length(rnorm) - length(replace(rnorm, c, '')))))::DOUBLE / (length(lnorm) + length(rnorm))"


@query(f"WITH {_PAIRS_SQL} SELECT l, r, {_QUICK_SQL} AS quick FROM sides")
def title_quick_ratio(spark, sf_dir):
    """What the matching ratio of the pairs is at most."""
    return _sides(spark, sf_dir, characters=True).select("l", "r", _quick().alias("quick"))


_similar_sql = lambda articles: f"""WITH {articles}, ordered AS (SELECT row_number() OVER (ORDER BY published_at DESC NULLS LAST, page_id) AS rk, title, array_to_string({_TOKENS.format('title')}, ' ') AS norm FROM t1),
kinds AS (SELECT rk, {_tokens_sql('title')} AS tokens FROM ordered QUALIFY rk = min(rk) OVER (PARTITION BY norm)),
words AS (SELECT rk, len(tokens) AS n, unnest(tokens) AS t FROM kinds),
met AS (SELECT a.rk AS l, b.rk AS r, any_value(a.n) AS ln, any_value(b.n) AS rn, count(*) AS overlap FROM words a JOIN words b ON a.t = b.t AND a.rk > b.rk GROUP BY ALL)
SELECT l, r, overlap FROM met WHERE overlap >= 2 AND overlap >= 0.415 * (ln + rn - overlap)"""  # noqa: E731


@query(_similar_sql(A.PAGES_SQL))
def similar_titles(spark, sf_dir):
    """All pairs of distinct titles whose tokens have a Jaccard index of 0.415 or more, below which no two tell one story."""
    return clustering.similar_sets(_titles(spark, sf_dir), 0.415, 2)


@query(_similar_sql(_HEADS_SQL))
def similar_headlines(spark, sf_dir):
    """The same of all documents' headlines, which share most of their frequent words."""
    return clustering.similar_sets(clustering.stored(clustering.titles(_headline_rows(spark, sf_dir)), "headline-titles"), 0.415, 2)


@query(f"""WITH {_pairs_sql(_HEADS_SQL)}, met AS (SELECT s.l, s.r, s.la IS NULL OR o.published_at IS NULL OR abs(epoch_us(s.la) - epoch_us(o.published_at)) <= 432000000000 AS near FROM sides s JOIN ordered o ON o.norm = s.rnorm),
dated AS (SELECT l, r, count(*) FILTER (WHERE near) AS aligned, count(*) FILTER (WHERE NOT near) AS apart FROM met GROUP BY l, r)
SELECT l, r, overlap, overlap / (ln + rn - overlap)::DOUBLE AS jaccard, overlap / least(ln, rn)::DOUBLE AS overlap_ratio, {_QUICK_SQL} AS quick, aligned, apart FROM sides JOIN dated USING (l, r)""")
def headline_pairs(spark, sf_dir):
    """Every fiftieth document's headline with all that share two words or more: what the story rules look at, but the matcher."""
    rows = _headline_rows(spark, sf_dir)
    asked, kinds = rows.where("page_id % 50 = 0"), clustering.stored(clustering.titles(rows), "headline-titles")
    pairs = clustering.with_ratios(clustering.candidate_pairs(asked, kinds, rows=rows, characters=True))
    return pairs.select("l", "r", "overlap", "jaccard", "overlap_ratio", _quick().alias("quick"), "aligned", "apart")


@query()
def title_similarity(spark, sf_dir):
    return clustering.title_similarity(_sides(spark, sf_dir, named=True)).select("l", "r", "sim")


@query()
def same_story_pairs(spark, sf_dir):
    return clustering.same_story_pairs(_titles(spark, sf_dir)).select("l", "r", "sim", "any_date")


@query(f"""WITH {A.PAGES_SQL}, rows_ AS (SELECT row_number() OVER (ORDER BY published_at DESC NULLS LAST, page_id) AS rk, array_to_string({_TOKENS.format('title')}, ' ') AS norm FROM t1)
SELECT rk, min(rk) OVER (PARTITION BY norm) AS title, count(*) OVER (PARTITION BY norm) AS copies FROM rows_""")
def title_members(spark, sf_dir):
    """The title each row has, named by the rk of that title's first row."""
    rows = _ranked_pages(spark, sf_dir).select("rk", "norm", "published_at", "tokens")
    kinds = clustering.titles(rows).select("norm", F.col("rk").alias("title"), "copies")
    return rows.join(kinds, "norm").select("rk", "title", "copies")


@query()
def story_clusters(spark, sf_dir):
    return clustering.story_clusters(A.page_articles(spark, sf_dir).drop("html")).select("id", "cluster_id", "cluster_size")


_BY_TITLE = f"{A.PAGES_SQL}, k AS (SELECT page_id, title, published_at, array_to_string({_TOKENS.format('title')}, ' ') AS cluster FROM t1)"


@query(f"WITH {_BY_TITLE} SELECT cluster, count(*) AS cluster_size FROM k GROUP BY cluster")
def cluster_size(spark, sf_dir):
    return A.page_articles(spark, sf_dir).groupBy(text.normalize_text(F.col("title")).alias("cluster")).agg(F.count(F.lit(1)).alias("cluster_size"))


@query(f"WITH {_BY_TITLE}, s AS (SELECT *, (page_id % 5)::DOUBLE AS score FROM k) SELECT cluster, page_id FROM s QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY score DESC, published_at DESC NULLS LAST, page_id) = 1")
def cluster_representative(spark, sf_dir):
    p = A.page_articles(spark, sf_dir).drop("html").withColumns({"cluster": text.normalize_text(F.col("title")), "score": (F.col("page_id") % 5).cast("double"), "rk": F.col("page_id")})
    return ranking.representatives(p, "cluster").select("cluster", "page_id")


@query()
def rank_articles(spark, sf_dir):
    none = F.lit(None).cast("string")
    a = A.page_articles(spark, sf_dir).drop("html").withColumns({"og_title": none, "og_description": none, "description": none, "duplicate_count": F.lit(1)})
    return ranking.rank_articles(a, _as_of(), 50).select("rank", "id", "score", "cluster_id", "cluster_size")
