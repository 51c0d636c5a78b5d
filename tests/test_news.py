"""Goldens of the news operators and a sequential scan that the parallel clustering must equal."""

import html
import json
import os
import random
import re
import threading
import time
from collections import Counter
from dataclasses import replace
from datetime import datetime, timedelta, timezone
from difflib import SequenceMatcher
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import duckdb
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gazette import storage
from gazette.functions import lexicon, render, scoring, staging, text, urls
from gazette.operators import clustering, components, datefilter, dedupe, enrich, overlaps, ranking
from gazette.plans import deliver, queries
from gazette.plans.run import main, run
from gazette.plans.settings import Settings
from gazette.sources import feeds
from gazette.streaming import ingest, latest, polls

NOW = datetime(2026, 3, 2, 12, tzinfo=timezone.utc)
ARTICLE = "id string, source_name string, title string, description string, published_at timestamp, duplicate_count int, pos long, url string, og_title string, og_description string, image_url string"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def articles(spark, rows):
    """rows: (id, source, title, hours old or None, duplicates, description)"""
    made = [(i, s, t, d, None if h is None else NOW - timedelta(hours=h), n, k, f"https://example.com/{i}", None, None, None) for k, (i, s, t, h, n, d) in enumerate(rows)]
    return spark.createDataFrame(made, ARTICLE)


def ranked(spark, rows, limit=50):
    return ranking.rank_articles(articles(spark, rows), F.lit(NOW.isoformat()).cast("timestamp"), limit).orderBy("rank").collect()


@pytest.mark.parametrize(
    "url, normal",
    [
        ("https://example.com/story?utm_source=x&id=123&fbclid=abc", "https://example.com/story?id=123"),
        ("https://e.com/a?b&&c=#top", "https://e.com/a?b=&c="),
        ("https://e.com/a?UTM_SOURCE=1&%75tm_source=2", "https://e.com/a?UTM_SOURCE=1"),
        (" https://e.com/a?x=%20;*&y=%zz ", "https://e.com/a?x=+%3B%2A&y=%25zz"),
        ("https://e.com/?", "https://e.com/"),
        (None, None),
    ],
)
def test_urls(spark, url, normal):
    assert spark.createDataFrame([(url,)], "u string").select(urls.normalize_url(F.col("u"))).first()[0] == normal


def test_keep_latest(spark):
    rows = [("k", "a1", datetime(2026, 1, 1), 0), ("k", "a2", datetime(2026, 1, 2), 1), ("j", "b1", None, 2), ("j", "b2", None, 3), ("i", "c1", datetime(2026, 1, 1), 4), ("i", "c2", datetime(2026, 1, 1), 5)]
    got = dedupe.keep_latest(spark.createDataFrame(rows, "key string, id string, at timestamp, pos long"), ["key"], "at", "pos").orderBy("first_pos").collect()
    assert [(r.id, r.duplicate_count, r.first_pos) for r in got] == [("a2", 2, 0), ("b1", 2, 2), ("c1", 2, 4)]


@pytest.mark.parametrize(
    "now, times, kept",
    [
        (NOW, ["2026-03-02T01:00:00", "2026-03-01T23:59:00"], [0]),
        (datetime(2026, 3, 2, 0, 30, tzinfo=timezone(timedelta(hours=-5))), ["2026-03-02T03:30:00", "2026-03-02T06:00:00"], [1]),
        (NOW, [None], []),
    ],
)
def test_today(spark, now, times, kept):
    df = spark.createDataFrame([(i, t and datetime.fromisoformat(t + "+00:00")) for i, t in enumerate(times)], "i int, published_at timestamp")
    assert [r.i for r in datefilter.published_today(df, now).collect()] == kept


def test_page_fields():
    html = '<meta property="og:title" content="AI Title"/><meta property="og:description" content="AI Description"/><meta property="og:image" content="https://example.com/image.jpg"/>'
    assert enrich.page_fields(html) == ("AI Title", "AI Description", "https://example.com/image.jpg")
    assert enrich.page_fields('<meta property="og:title"><meta name="og:title" content="x"><meta name="twitter:title" content=" y ">') == ("y", None, None)
    assert enrich.page_fields(None) == (None, None, None)


def test_scores(spark):
    got = ranked(spark, [("fresh", "OpenAI Blog", "OpenAI Blog title fresh", 1, 3, None), ("old", "Unknown", "Unknown title old", 120, 1, None)])
    assert [(r.id, r.score) for r in got] == [("fresh", 0.525), ("old", 0.2485)]
    said = spark.createDataFrame([(1, "...", ""), (2, "Launch", " of a NEW model: how to show tomorrow")], "norm int, title string, _words string")
    scored = scoring.with_relevance(said, F.col("title"), F.col("_words"))
    assert scored.columns == [*said.columns, "relevance"] and {r.norm: r.relevance for r in scored.collect()} == {1: 0.2, 2: pytest.approx(0.15 + 0.31 + 0.07 - 0.08 - 0.03)}
    assert value(spark, scoring.phrase_hits(F.lit("series about show tomorrow"), lexicon.HIGH_PHRASES)) == 1
    hours = [None, -1, 6, 24, 48, 96, 97]
    df = spark.createDataFrame([(i, None if h is None else NOW - timedelta(hours=h)) for i, h in enumerate(hours)], "i int, t timestamp")
    assert [r[0] for r in df.orderBy("i").select(scoring.recency(F.col("t"), F.lit(NOW.isoformat()).cast("timestamp"))).collect()] == [0.3, 1.0, 1.0, 0.8, 0.6, 0.4, 0.2]


def test_one_story_across_sources(spark):
    got = ranked(
        spark,
        [
            ("tc1", "TechCrunch (AI)", "OpenAI launches new multimodal model for developers", 2, 1, None),
            ("vg1", "The Verge (AI)", "OpenAI launches a new multimodal model for developers", 3, 1, None),
            ("other1", "MIT Technology Review", "NVIDIA unveils next generation AI accelerator chips", 1, 1, None),
        ],
    )
    assert [(r.id, r.score, r.cluster_size, r.cluster_id) for r in got] == [("tc1", 0.6979, 2, "tc1"), ("other1", 0.6827, 1, "other1")]


def test_relevance_beats_a_roundup(spark):
    got = ranked(spark, [("low", "OpenAI Blog", "Top AI events and webinar roundup for this week", 2, 1, None), ("high", "Unknown", "Startup raises Series B to launch enterprise AI agent platform", 8, 1, None)])
    assert [(r.id, r.score) for r in got] == [("high", 0.733), ("low", 0.4405)]


def test_leader_names_the_cluster_and_score_picks_its_row(spark):
    event = "Conference event recap and webinar schedule for this month."
    got = ranked(spark, [("event", "Unknown", "Daily AI update", 1, 1, event), ("deal", "Unknown", "Daily AI update", 4, 1, "A startup raised seed funding and signed an enterprise partnership deal.")])
    assert [(r.id, r.score, r.cluster_id, r.cluster_size) for r in got] == [("deal", 0.7435, "event", 2)]


def test_similarity_depends_on_the_order(spark):
    a, b = "new series chips launches agents funding", "deal chips google nvidia b enterprise"
    tc, vg = "openai launches new multimodal model for developers", "openai launches a new multimodal model for developers"
    got = spark.createDataFrame([(1, a, b), (2, b, a), (3, vg, tc)], "i int, l string, r string").select("i", clustering.sequence_ratio("l", "r").alias("x")).collect()
    assert {r.i: round(r.x, 5) for r in got} == {1: 0.38961, 2: 0.33766, 3: 0.98077}
    same = spark.createDataFrame([(6, 6, vg, tc)], "overlap int, l_n int, l_norm string, r_norm string").withColumn("jaccard", F.lit(1.0))
    assert clustering.title_similarity(same).first().sim == pytest.approx(0.99327, abs=1e-5)


def test_top_k(spark):
    assert len(ranked(spark, [(str(i), "Test", f"Unique story {i}", i, 1, None) for i in range(30)], 20)) == 20
    assert [ranking.clamp_limit(n) for n in (0, 7, 51)] == [1, 7, 50]


def scanned(rows):
    """rows in scan order: (id, title, time). Each joins the first leader that tells its story, else it leads."""
    word, leaders, out = re.compile("[a-z0-9]+"), [], {}
    for i, title, at in rows:
        norm = " ".join(word.findall(title.lower()))
        tokens = set(norm.split()) - set(lexicon.STOPWORDS)
        for j, n, t, b in leaders:
            both = len(tokens & t)
            if both < 2:
                continue
            ratio, sim = both / min(len(tokens), len(t)), 0.65 * both / len(tokens | t) + 0.35 * SequenceMatcher(None, norm, n).ratio()
            near = at is None or b is None or abs(at - b) <= timedelta(hours=120)
            if sim >= 0.78 and ratio >= 0.5 or sim >= 0.62 and ratio >= 0.7 and near:
                out[i] = j
                break
        else:
            leaders.append((i, norm, tokens, at))
            out[i] = i
    return out


def test_clusters_equal_the_scan(spark):
    rng = random.Random(5)
    pool = "chips launches agents funding series deal google nvidia enterprise model rollout cloud".split()
    rows = []
    for i in range(150):
        title = " ".join(rng.sample(pool, rng.randint(0, 6)))
        rows.append((f"a{i}", "s", title, rng.choice([None, *range(0, 400, 20)]), 1, None))
    # Copies on many dates. Every character of the long titles is frequent, so that their ratio with themselves is 0.
    copied = ["chips launches agents", "chips launches agents funding", "Chips: launches agents!", "chips launches " * 20, "chips launches agents " * 15, "chips"]
    rows += [(f"c{i}", "s", rng.choice(copied), rng.choice([None, *range(0, 1000, 10)]), 1, None) for i in range(120)]
    got = {r.id: r.cluster_id for r in clustering.story_clusters(articles(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: (r[3] is None, r[3] or 0))
    assert got == scanned([(r[0], r[2], None if r[3] is None else NOW - timedelta(hours=r[3])) for r in order])


def test_pairs_of_one_story_against_all_pairs(spark):
    rng = random.Random(6)
    pool = "chips launches agents funding series deal google nvidia".split()
    rows = [(f"a{i}", "s", " ".join(rng.sample(pool, rng.randint(0, 6))), rng.choice([None, *range(0, 400, 20)]), 1, None) for i in range(120)]
    ranked_rows = clustering.stored(clustering.with_tokens(clustering.scan_order(articles(spark, rows))), "test")
    kinds = {}
    for r in ranked_rows.orderBy("rk").collect():
        kinds.setdefault(r.norm, [r.rk, r.rk, set(r.tokens), 0])
        kinds[r.norm][1], kinds[r.norm][3] = r.rk, kinds[r.norm][3] + 1
    want = set()
    for n, (rk, last, t, copies) in kinds.items():
        for m, (first, _, u, _) in kinds.items():
            both = len(t & u)
            if both < 2 or first >= last or (n == m and copies < 2):
                continue
            ratio, sim = both / min(len(t), len(u)), 0.65 * both / len(t | u) + 0.35 * SequenceMatcher(None, n, m).ratio()
            if sim >= 0.78 and ratio >= 0.5 or sim >= 0.62 and ratio >= 0.7:
                want.add((rk, first, round(sim, 9), sim >= 0.78 and ratio >= 0.5))
    got = clustering.same_story_pairs(clustering.titles(ranked_rows)).collect()
    assert len(got) == len(want) and {(r.l, r.r, round(r.sim, 9), r.any_date) for r in got} == want


def test_candidates_lose_no_pair(spark):
    rng = random.Random(8)
    rows = [(i, rng.sample(range(40) if i % 3 else range(6), rng.randint(0, 6 if i % 3 == 0 else 14))) for i in range(400)]
    df = spark.createDataFrame([(i, [f"w{x}" for x in t]) for i, t in rows], "rk long, tokens array<string>")
    for least, shared, cell in ((0.415, 2, 4096), (0.415, 2, 20), (0.8, 1, 7)):
        want = {(a, b, len(set(x) & set(y))) for a, x in rows for b, y in rows if a > b and len(set(x) & set(y)) >= shared and len(set(x) & set(y)) >= least * len({*x, *y})}
        got = clustering.similar_sets(df, least, shared, cell).collect()
        assert len(got) == len(want) > 20 and {tuple(r) for r in got} == want
        met = clustering.set_candidates(df, least, shared, cell)
        assert met.count() == met.distinct().count() >= len(want)


def plan_above_python(df):
    """The operators of df's plan that get what its last Python step gives."""
    return df._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]


def test_similar_pairs_are_counted_where_they_meet(spark):
    """Neither pairs nor their sets are shuffled behind the meeting, and what meets without being similar is not given."""
    df = spark.createDataFrame([(i, [f"w{x}" for x in {0, 1, 2 + i % 5, 10 + i % 7, 20 + i % 11, 40 + i}]) for i in range(150)], "rk long, tokens array<string>")
    sets = {r.rk: set(r.tokens) for r in df.collect()}
    want = {(a, b, len(x & y)) for a, x in sets.items() for b, y in sets.items() if a > b and len(x & y) >= max(2, 0.415 * len(x | y))}
    for cell in (4096, 9):
        met = clustering.set_candidates(df, 0.415, 2, cell)
        got = [tuple(r) for r in met.collect()]
        assert len(got) == len(want) > 100 and set(got) == want
        assert "Exchange" not in plan_above_python(met) and "Join" not in plan_above_python(met)


def test_sets_too_large_for_each_other_are_not_counted(monkeypatch):
    """Sets whose shared token is so near their end that no two of that size are similar by it make no pairs to count; smaller ones meet them."""
    late = [[*range(100 + 20 * i, 109 + 20 * i), 9000, *range(10_000 + 9 * i, 10_005 + 9 * i)] for i in range(300)]
    short = [[9000, 10_000 + 9 * i, 10_001 + 9 * i, 10_002 + 9 * i, 10_003 + 9 * i, 10_004 + 9 * i] for i in range(3)]
    sets, seen, cells = [*late, *short], [], overlaps.Postings.cells
    monkeypatch.setattr(overlaps.Postings, "cells", lambda *args: (out := cells(*args), seen.append(len(out)))[0])
    same = lambda x: pa.array([x] * len(sets), pa.int64())
    rows = pa.record_batch({"first": same(9000), "x": same(0), "y": same(0), "rk": pa.array(range(len(sets))), "block": same(0), "own": pa.array(sets, pa.list_(pa.int64()))})
    for least in (0.415, 0.35):
        got = [r for batch in overlaps.meet(iter([rows]), ["l", "r", "overlap"], least, 2) for r in zip(*batch.to_pydict().values(), strict=True)]
        want = [(a, b, len(x & y)) for a, x in enumerate(map(set, sets)) for b, y in enumerate(map(set, sets)) if a > b and min(x & y) == 9000 and len(x & y) >= max(2, least * len(x | y))]
        assert sorted(got) == sorted(want) and len(want) == (0 if least > 0.4 else 3)
    assert 0 < sum(seen) < 10 * len(sets)


def test_asked_rows_in_blocks_against_all_pairs(spark):
    """Any blocks of the asked rows and chunks of a title's dates give the same rows, and no pair is shuffled."""
    rng = random.Random(12)
    at = lambda: None if rng.random() < 0.2 else datetime(2024, 1, 1) + timedelta(hours=rng.randint(0, 400))
    rows = [(i, i, " ".join(rng.choices("ab cd ef gh0 ij kl mn op".split(), k=rng.randint(0, 5))) or None, at()) for i in range(200)] + [(200 + i, 200 + i, "ab cd", at()) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, pos long, title string, published_at timestamp_ntz")
    ranked = clustering.stored(clustering.with_tokens(clustering.scan_order(df)), "test")
    asked, kinds = ranked.where("id % 5 = 0"), clustering.stored(clustering.titles(ranked), "test")
    every, firsts = ranked.collect(), {}
    for r in sorted(every, key=lambda r: r.rk):
        firsts.setdefault(r.norm, r)
    want, near = set(), lambda a, b: a is None or b is None or abs(a - b) <= timedelta(hours=clustering.MAX_HOURS)
    for a in every:
        for b in firsts.values():
            shared = len(set(a.tokens or ()) & set(b.tokens or ()))
            if a.id % 5 == 0 and a.norm != b.norm and shared >= 2:
                dates = [near(a.published_at, r.published_at) for r in every if r.norm == b.norm]
                both = sum((Counter(a.norm) & Counter(b.norm)).values())
                want.add((a.rk, b.rk, shared, len(set(a.tokens)), len(set(b.tokens)), both, len(a.norm), len(b.norm), sum(dates), len(dates) - sum(dates), a.norm, b.norm))
    for block, chunk in ((8192, 4096), (7, 3)):
        got = clustering.candidate_pairs(asked, kinds, rows=ranked, characters=True, named=True, block=block, chunk=chunk)
        names = ["l", "r", "overlap", "l_n", "r_n", "both", "l_length", "r_length", "aligned", "apart", "l_norm", "r_norm"]
        told = [tuple(r) for r in got.select(*names).collect()]
        assert len(told) == len(want) > 500 and set(told) == want
    plain = clustering.candidate_pairs(asked, kinds, block=7)
    assert {(r.l, r.r, r.overlap) for r in plain.collect()} == {w[:3] for w in want} and "Exchange" not in plan_above_python(plain)


def test_the_quick_ratio_is_a_bound(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abc 0z") for _ in range(rng.randint(0, 30)))
    rows = [(" ".join(word().split()), " ".join(word().split())) for _ in range(200)] + [("abc", "abc"), ("", "abc"), ("abc " * 60, "cab " * 60)]
    sides = spark.createDataFrame([(i, i, *r) for i, r in enumerate(rows)], "l int, r int, l_norm string, r_norm string")
    for r in clustering.with_quick_ratio(sides).withColumn("ratio", clustering.sequence_ratio("l_norm", "r_norm")).collect():
        assert r.quick == pytest.approx(SequenceMatcher(None, r.l_norm, r.r_norm).quick_ratio()) and r.ratio <= r.quick + 1e-12


def test_components(spark):
    rng = random.Random(10)
    edges = [(i, i + 1) for i in range(1000, 1700)] + [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(5000, i) for i in range(5001, 5400)] + [(7, 7)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert len(got) == len(want) and {r.node: r.root for r in got} == want
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_chain_of_leaders_takes_few_jobs(spark):
    """Every row of a chain may join the one before it, so every second one leads."""
    n = 1000
    rows = spark.createDataFrame([(i, i, None) for i in range(1, n + 1)], "rk long, title long, published_at timestamp")
    edges = spark.createDataFrame([(i, i - 1, True) for i in range(2, n + 1)], "l long, r long, any_date boolean")
    spark.sparkContext.setJobGroup("chain", "chain")
    got = {r.title: r.leader for r in clustering.leaders(rows, edges).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {i: i if i % 2 else i - 1 for i in range(1, n + 1)} and jobs < 150


def test_large_components_are_decided_in_rounds(spark):
    rng = random.Random(11)
    at = [None, *(NOW - timedelta(hours=60 * i) for i in range(8))]
    rows = [(i, rng.randint(1, 40), rng.choice(at)) for i in range(1, 300)]
    edges = list({(a, b): (a, b, rng.random() < 0.5) for a, b in ((rng.randint(1, 40), rng.randint(1, 40)) for _ in range(50))}.values())
    r, e = spark.createDataFrame(rows, "rk long, title long, published_at timestamp"), spark.createDataFrame(edges, "l long, r long, any_date boolean")
    told = [sorted((str(x.title), str(x.published_at), x.leader) for x in clustering.leaders(r, e, whole, bucket).collect()) for whole, bucket in ((4096, 16384), (4096, 30), (0, 30), (12, 30))]
    assert told[0] == told[1] == told[2] == told[3] and len(told[0]) > 50


def test_names_of_other_columns_do_not_matter(spark):
    rows = [("a", "s", "chips launches agents", 1, 1, None), ("b", "s", "chips launches agents", 3, 1, None), ("c", "s", "other things happen", 2, 1, None)]
    names = "norm tokens leader _part _at _shift _title _nth n first title_ lead root bucket of at l r _best _relevance copies last rk leader_rk cluster_id cluster_size score rank".split()
    df = articles(spark, rows)
    wide = df.withColumns({n: F.lit(f"my {n}") for n in names})
    plain = {r.id: (r.cluster_id, r.cluster_size) for r in clustering.story_clusters(df).collect()}
    got = clustering.story_clusters(wide).collect()
    assert {r.id: (r.cluster_id, r.cluster_size) for r in got} == plain == {"a": ("a", 2), "b": ("a", 2), "c": ("c", 1)}
    made = {"rk", "leader_rk", "cluster_id", "cluster_size"}
    assert all(r[n] == f"my {n}" for r in got for n in names if n not in made)
    best = ranking.rank_articles(wide, F.lit(NOW.isoformat()).cast("timestamp"), 50).collect()
    assert {r.id for r in best} == {"a", "c"} and all(r[n] == f"my {n}" for r in best for n in names if n not in made | {"score", "rank"})


def test_stream_of_entries(spark, tmp_path):
    at = [datetime(2026, 3, 2, h) for h in range(3)]
    schema = "url string, published_at timestamp, n int"
    spark.createDataFrame([("https://e.com/a?utm_source=x", at[0], 1), ("https://e.com/b", at[1], 2)], schema).write.parquet(f"{tmp_path}/landed")
    spark.createDataFrame([("https://e.com/a#top", at[2], 3), ("https://e.com/c", at[2], 4)], schema).write.mode("append").parquet(f"{tmp_path}/landed")
    stream = ingest.unique_articles(ingest.landed(spark, f"{tmp_path}/landed", schema))
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["https://e.com/a", "https://e.com/b", "https://e.com/c"]


def test_feeds_as_a_stream_give_new_entries_only(spark, tmp_path):
    catalog = tmp_path / "c.yaml"
    catalog.write_text("sources:\n  - {name: One, url: 'https://one.example', rss: 'https://one.example/rss'}\n  - {name: Two, url: 'https://two.example', rss: 'https://two.example/rss'}\n")
    shown = tmp_path / "shown"

    def fetch(url):
        if "two" in url:
            raise OSError("down")
        return "<rss><channel>" + "".join(f"<item><title>{t}</title><link>https://e.com/{t}</link></item>" for t in shown.read_text().split()) + "</channel></rss>"

    sources = feeds.load_catalog(spark, catalog)
    for poll, (now, fresh) in enumerate((("a b", "ab"), ("c a b", "c"), ("c a b", ""), ("d c", "d"))):
        shown.write_text(now)
        stream = polls.new_entries(polls.polled_feeds(spark, sources, fetch))
        query = stream.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
        query.foreachBatch(lambda df, i, out=f"{tmp_path}/out{poll}": df.write.mode("append").parquet(out)).start().awaitTermination()
        got = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out{poll}").collect()
        assert sorted(r.entry.title for r in got if r.entry) == list(fresh)
        assert [r.error for r in got if r.error] == ["Source fetch failed (Two): down"]


@pytest.mark.parametrize("seed", [1, 2])
def test_the_latest_of_a_stream_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["x", "y", "z", None]), None if rng.random() < 0.3 else NOW.replace(tzinfo=None) - timedelta(hours=rng.randint(0, 4)), i, f"text {i}") for i in range(60)]
    schema = "url string, published_at timestamp, pos long, title string"
    rng.shuffle(rows)
    for k in range(4):
        spark.createDataFrame(rows[15 * k : 15 * k + 15], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    before = spark.conf.get(latest.PROVIDER)
    try:
        stream = latest.keep_latest(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), ["url"], "published_at", "pos", None if seed == 1 else 3_600_000)
        query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={i}")).start()
        ended = time.time() + 120
        while time.time() < ended and sum(p["numInputRows"] for p in query.recentProgress) < len(rows):
            time.sleep(0.5)
        query.stop()
    finally:
        spark.conf.set(latest.PROVIDER, before)
    told = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    last = {r.url: tuple(r) for r in told.orderBy("duplicate_count").collect()}
    want = dedupe.keep_latest(spark.createDataFrame(rows, schema), ["url"], "published_at", "pos").select(*told.columns)
    assert last == {r.url: tuple(r) for r in want.collect()} and told.count() > len(last)


def test_text(spark):
    assert value(spark, text.enforce_sentences(F.lit("Sentence one. Sentence two. Sentence three. Sentence four."))) == "Sentence one. Sentence two. Sentence three."
    for n in range(3):
        said = " ".join(["Yes."] * n)
        assert value(spark, text.enforce_sentences(F.lit(said))) == " ".join(["Yes."] * n + list(text.SENTENCE_PADS[n:]))
    assert value(spark, text.strip(F.lit("\xa0\x1c a b "))) == "a b"
    assert [value(spark, text.truncate(F.lit("abc def"), n)) for n in (7, 6, 3, 0)] == ["abc def", "abc...", "abc", ""]
    assert [text.count_sentences(x) for x in ("The model scores 3.5 on U.S. tests.", " \n", "One. Two!  Three?", "no end")] == [2, 0, 3, 1]


def plain_cut(x, limit):
    return x if len(x) <= limit else x[:limit] if limit <= 3 else x[: limit - 3].rstrip() + "..."


def plain_link(url, title):
    return f'<a href="{html.escape(url, quote=True)}">{title}</a>\n\n'


def plain_caption(url, title, summary, limit=1024):
    prefix = plain_link(url, plain_cut(html.escape(title, quote=False), 200))
    return (prefix + plain_cut(html.escape(summary, quote=False), max(limit - len(prefix), 0)))[:limit]


def test_messages(spark):
    rows = [("https://example.com/a", "T" * 500, "s" * 2000, 1), ("https://e.com/?a=1&b=\"'", "<&>" * 90, "&" * 300 + " x" * 800, 2), ("u", "t", "short & sweet", 3), ("u" * 1100, "t", "s", 4), ("u", "", None, 5), ("u", "t" * 5000, "s" * 5000, 6)]
    made = render.with_messages(spark.createDataFrame(rows, "url string, _head string, _said string, _step1 int"), F.col("url"), F.col("_head"), F.col("_said"))
    assert made.columns == ["url", "_head", "_said", "_step1", "caption", "message"]
    for r in made.collect():
        said = r["_said"] or "Summary unavailable."
        assert r.caption == plain_caption(r.url, r["_head"], said)
        assert r.message == plain_cut(plain_link(r.url, html.escape(r["_head"], quote=False)) + html.escape(said, quote=False), 4096)


def plain_summary(title, source, context):
    bare = context.strip()
    second = f"Key context: {bare[:180].rstrip('.')}." if bare else "The story appears relevant to current AI research and product developments."
    said = [s for s in re.split(r"(?<=[.!?])\s+", " ".join(f"{title} is a notable AI update from {source}. {second} Open the link to review full details, claims, and technical context.".split())) if s]
    return " ".join((said + list(text.SENTENCE_PADS[len(said) :]))[:3])


WILD = st.text(alphabet=st.sampled_from(list("aB9.!? \t\n\x0b\x1c\x85\xa0\u2003\u3000&<>\"'é😀")), max_size=60)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(said=st.lists(st.tuples(WILD, WILD, st.integers(0, 40)), min_size=40, max_size=60))
def test_columns_equal_plain_python(spark, said):
    df = spark.createDataFrame([(a, b, n) for a, b, n in said], "a string, b string, n int")
    df = df.select("*", text.strip(F.col("a")).alias("strip"), text.rstrip(F.col("a")).alias("rstrip"), text.split_sentences(F.col("a")).alias("cut"), text.enforce_sentences(F.col("a")).alias("three"), text.truncate(F.col("a"), F.col("n")).alias("short"), text.escape_html(F.col("a"), quotes=True).alias("safe"), text.normalize_text(F.col("a")).alias("norm"), text.present(F.col("a")).alias("present"))
    for r in render.with_template_summary(df, F.col("a"), F.col("b"), F.col("b")).collect():
        a = r.a
        cut = [s for s in re.split(r"(?<=[.!?])\s+", " ".join(a.split())) if s]
        assert (r.strip, r.rstrip, r.cut, r.present) == (a.strip(), a.rstrip(), cut, a or None)
        assert r.three == " ".join((cut + list(text.SENTENCE_PADS[len(cut) :]))[:3])
        assert (r.short, r.safe, r.norm) == (plain_cut(a, r.n), html.escape(a, quote=True), " ".join(re.findall("[a-z0-9]+", a.lower())))
        assert r.summary == plain_summary(a, r.b, r.b)


def test_a_million_blanks(spark):
    many = " " * 1_000_000
    df = spark.createDataFrame([(f"{many}a{many}b{many}",)], "x string").cache()
    df.count()
    x = F.col("x")
    wanted = {
        "strip": (text.strip(x), f"a{many}b"), "rstrip": (text.rstrip(x), f"{many}a{many}b"), "content": (scoring.content(x, x), "a b a b"),
        "title": (feeds.entry_title(x), f"a{many}b"), "description": (feeds.entry_description(x, x), f"a{many}b"), "url": (urls.normalize_url(x), f"a{many}b"),
    }
    for column, want in wanted.values():
        df.limit(0).select(column).collect()
        began = time.time()
        assert df.select(column.alias("v")).first().v == want
        assert time.time() - began < 10
    began = time.time()
    assert render.with_template_summary(df, F.lit("T"), F.lit("S"), x).first().summary.startswith("T is a notable AI update from S. Key context: a .")
    assert feeds.head_then_filter(df.withColumn("entry_pos", F.lit(0)), x).count() == 1 and time.time() - began < 20


def test_prompt_in_any_zone(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "America/New_York")
    at = [datetime(2026, 3, 8, 7, 30, tzinfo=timezone.utc), datetime(2026, 3, 2, 10, 0, 0, 250000, tzinfo=timezone.utc), datetime(1969, 12, 31, 23, 59, 59, tzinfo=timezone.utc), None]
    df = session.createDataFrame([(i, t) for i, t in enumerate(at)], "i int, t timestamp")
    for r in df.select("i", render.prompt(F.lit("T"), F.lit("S"), F.col("t"), F.lit("U"), F.lit("C")).alias("p")).collect():
        when = at[r.i].isoformat() if at[r.i] else "unknown"
        assert r.p == f"Title: T\nSource: S\nPublished: {when}\nURL: U\nContext: C\nWrite exactly 3 sentences focused on key facts and why this matters."
def test_retry():
    waits, answers = [], [(429, {"parameters": {"retry_after": 5}}), (500, {}), (200, {"ok": True, "result": {"message_id": 4}})]
    assert deliver.send_with_retry(lambda m, p: answers.pop(0), "sendMessage", {}, waits.append)["ok"] and waits == [5, 2]
    assert deliver.send_with_retry(lambda m, p: (429, {}), "sendMessage", {}, waits.append) == {"ok": False, "description": "Unknown send failure."}


def test_catalog(spark):
    rows = {r.name: r for r in feeds.load_catalog(spark).collect()}
    assert len(rows) == 33 and rows["arXiv.org (cs.AI)"].blocked == ["arxiv.org"] and rows["TLDR AI"].blocked == [] and rows["TLDR AI"].image_fallback


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_dates(spark, zone):
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", zone)
    said = {
        "Mon, 02 Mar 2026 10:00:00 GMT": "2026-03-02T10:00:00", "2 Mar 2026 10:00:00 -0500": "2026-03-02T15:00:00", "2026-03-02T10:00:00Z": "2026-03-02T10:00:00", "2026-03-02T10:00:00": "2026-03-02T10:00:00",
        "2026-03-02 10:00:00.5+01:00": "2026-03-02T09:00:00.500000", "2026-03-02": "2026-03-02T00:00:00", "Mon, 02 Mar 2026 10:00:00": "2026-03-02T10:00:00", "junk": None, "10:00:00": None, None: None,
    }
    df = session.createDataFrame([(t,) for t in said], "t string").select("t", F.unix_micros(feeds.parse_date(F.col("t"), any_date=True)).alias("at"))
    start = datetime(1970, 1, 1)
    assert {r.t: None if r["at"] is None else (start + timedelta(microseconds=r["at"])).isoformat() for r in df.collect()} == said


def test_updated_counts_where_published_cannot_be_read(spark):
    df = spark.createDataFrame([("junk", "2026-03-02T10:00:00Z"), ("2026-03-01T10:00:00Z", "2026-03-02T10:00:00Z"), ("", None)], "p string, u string")
    got = df.select(F.unix_seconds(feeds.entry_time(F.col("p"), F.col("u"))).alias("t")).collect()
    assert [r.t and datetime.fromtimestamp(r.t, timezone.utc).day for r in got] == [2, 1, None]


def test_feed_dialects():
    rss = """\ufeff<?xml version="1.0" encoding="iso-8859-1"?><rss xmlns:media="http://search.yahoo.com/mrss/" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>no</title>
    <item><title>A&nbsp;B & C &amp; D &bogus;</title><link>https://e.com/1?a=1&amp;b=2</link><description><![CDATA[x &nbsp; <b>y</b>]]></description><content:encoded>long</content:encoded><pubDate>Mon, 02 Mar 2026 10:00:00 GMT</pubDate>
    <media:group><media:content url="https://e.com/1.png"/><media:title>not this</media:title></media:group><enclosure url="https://e.com/e.png" type="image/png"/></item></channel></rss>"""
    (row,) = feeds.entries_of(rss)
    assert (row["title"], row["link"], row["summary"], row["description"]) == ("A\xa0B & C & D &bogus;", "https://e.com/1?a=1&b=2", "x &nbsp; <b>y</b>", "long")
    assert row["media_content"] == [{"url": "https://e.com/1.png"}] and row["links"] == [{"href": "https://e.com/e.png", "type": "image/png"}] and row["published"].startswith("Mon")
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><title>no</title><entry><source><title>the source's</title><link href="https://s.com"/></source><title>Own</title>
    <link rel="self" href="https://e.com/self"/><link href="https://e.com/2"/><updated>2026-03-02T10:00:00Z</updated><content type="xhtml"><div>in <b>bold</b></div></content></entry></feed>"""
    (row,) = feeds.entries_of(atom)
    assert (row["title"], row["link"], row["updated"], row["description"]) == ("Own", "https://e.com/2", "2026-03-02T10:00:00Z", "in bold") and "published" not in row
    rdf = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel/><item><title>R</title><link>https://e.com/3</link><dc:date>2026-03-02</dc:date></item></rdf:RDF>'
    assert [(r["title"], r["link"], r["published"]) for r in feeds.entries_of(rdf)] == [("R", "https://e.com/3", "2026-03-02")]


def test_catalog_errors(spark, tmp_path):
    for name, said in (("empty.yaml", ""), ("none.yaml", "sources: []\n")):
        (tmp_path / name).write_text(said)
        with pytest.raises(ValueError):
            feeds.load_catalog(spark, tmp_path / name)
    with pytest.raises(FileNotFoundError):
        feeds.load_catalog(spark, tmp_path / "missing.yaml")


def test_answers_short_of_sentences_are_asked_for_again(spark):
    df = spark.createDataFrame([("1", "The model scores 3.5 on U.S. tests."), ("2", "One. Two. Three. Four."), ("3", "fail")], "id string, title string")
    df = df.withColumns({k: F.lit(None).cast("string") for k in ("og_title", "og_description", "description", "url")} | {"source_name": F.lit("S"), "published_at": F.lit(None).cast("timestamp"), "_template": F.lit(1)})

    def ask(prompt, again):
        title = prompt.split("\n")[0].removeprefix("Title: ")
        if title == "fail":
            raise OSError("down")
        return "Again one. Again two." if again else title

    got = {r.id: r.summary for r in deliver.summarize(df, ask).collect()}
    assert got["1"] == f"Again one. Again two. {text.SENTENCE_PADS[2]}" and got["2"] == "One. Two. Three." and got["3"].startswith("fail is a notable AI update from S.")


def test_deliver(spark):
    rows = [("a", 1, "https://i/x.png"), ("b", 2, None), ("c", 3, "https://i/y.png")]
    df = spark.createDataFrame(rows, "id string, rank int, image_url string").withColumns({k: F.lit(k) for k in ("url", "title", "summary")} | {"og_title": F.lit(None).cast("string")})
    for post, chat in ((None, "c"), (lambda m, p: (200, {}), "")):
        assert {(r.status, r.error) for r in deliver.deliver(df, post, chat).collect()} == {("error", "Telegram credentials are missing.")}

    def post(method, payload):
        if method == "sendPhoto":
            return (200, {"ok": True, "result": {"message_id": 7}}) if payload["photo"].endswith("x.png") else (400, {"ok": False, "description": "no photo"})
        return (200, {"ok": True, "result": {"message_id": 8}}) if payload["disable_web_page_preview"] is False and payload["text"].startswith("<a href") else (400, {})

    got = deliver.deliver(df, post, "c", sleep=lambda s: None).orderBy("rank").collect()
    assert [(r.article_id, r.status, r["mode"], r.message_id) for r in got] == [("a", "sent", "photo", 7), ("b", "sent", "text", 8), ("c", "sent", "text", 8)]
    bad = deliver.deliver(df, lambda m, p: (500, {}), "c", sleep=lambda s: None)
    assert {r.error for r in bad.collect()} == {"Telegram send failed."} and deliver.rollup(bad).first().failed == 3
    assert [r.failure for r in deliver.first_failures(bad, 2).collect()] == ["a: Telegram send failed.", "b: Telegram send failed."]


@pytest.mark.parametrize("stops", ["before an intent", "while sending", "before a result"])
def test_a_stopped_sink_neither_repeats_nor_loses(spark, tmp_path, monkeypatch, stops):
    rows = [(f"a{i}", f"https://e.com/{i}", f"T{i}", None, "One. Two. Three.", None, i) for i in range(1, 7)]
    df = spark.createDataFrame(rows, "id string, url string, title string, og_title string, summary string, image_url string, rank int")
    journal, sent, refused = f"file://{tmp_path}/journal", [], []

    class Stopped(BaseException):
        pass

    def post(method, payload):
        title = payload["text"].split(">")[1][:2]
        if title == "T4" and stops == "while sending" and not sent.count("stop"):
            sent.append("stop")
            raise Stopped
        if title == "T2" and not refused:
            refused.append(title)
            return 400, {"ok": False, "description": "refused"}
        sent.append(title)
        return 200, {"ok": True, "result": {"message_id": len(sent)}}

    once = lambda method: lambda self, article, *rest: (_ for _ in ()).throw(Stopped()) if article == "a4" else method(self, article, *rest)
    with monkeypatch.context() as patch:
        patch.setattr(deliver, "send_with_retry", lambda post, method, payload, sleep: post(method, payload)[1])
        if stops != "while sending":
            kind = "intend" if stops == "before an intent" else "close"
            patch.setattr(deliver.Journal, kind, once(getattr(deliver.Journal, kind)))
        with pytest.raises(Stopped):
            deliver.deliver(df, post, "c", journal=journal)
    got = {r.article_id: (r.status, r.error) for r in deliver.deliver(df, post, "c", journal=journal).collect()}
    doubt = ("error", deliver.IN_DOUBT) if stops != "before an intent" else ("sent", None)
    assert got == {f"a{i}": ("sent", None) if i != 4 else doubt for i in range(1, 7)}
    messages = [x for x in sent if x != "stop"]
    assert sorted(messages) == ["T1", "T2", "T3", *(["T4"] if stops != "while sending" else []), "T5", "T6"]
    again = len(sent)
    assert {r.article_id: (r.status, r.error) for r in deliver.deliver(df, post, "c", journal=journal).collect()} == got and len(sent) == again


def test_run_end_to_end(spark, tmp_path):
    catalog = tmp_path / "c.yaml"
    catalog.write_text("sources:\n  - {name: One, url: 'https://one.example', rss: 'https://one.example/rss'}\n  - {name: Two, url: 'https://two.example', rss: 'https://two.example/rss'}\n")
    item = "<item><title>{}</title><link>https://one.example/{}</link><pubDate>Mon, 02 Mar 2026 {}:00:00 GMT</pubDate><description>A new model.</description></item>"

    def fetch(url):
        if "two" in url:
            raise OSError("down")
        return "<rss><channel>" + item.format("Chip launch today", "a?utm_source=x", "08") + item.format("Other thing entirely", "b", "09") + "<item><title>no link</title></item></channel></rss>"

    def get(url, agent):
        return url, "text/html", '<meta property="og:image" content="https://i.example/x.png">'

    done = run(spark, fetch, get, NOW, catalog=catalog)
    assert {r.title for r in done.ranked.collect()} == {"Chip launch today", "Other thing entirely"}
    assert {(r.status, r["mode"]) for r in done.results.collect()} == {("dry_run", "photo")}
    assert [r.message for r in done.errors.collect()] == ["Source fetch failed (Two): down"]
    sent = []
    post = lambda m, p: (sent.append(m), (200, {"ok": True, "result": {"message_id": len(sent)}}))[1]
    real = run(spark, fetch, get, NOW, dry_run=False, ask=lambda p, again: "One. Two. Three. Four.", post=post, chat_id="c", catalog=catalog)
    assert [r.status for r in real.results.collect()] == ["sent", "sent"] and sent == ["sendPhoto", "sendPhoto"]
    assert done.filtered == 0 and run(spark, fetch, get, NOW + timedelta(days=1), catalog=catalog).filtered == 2
    assert done.counts == {"entries": 4, "rejects": 0, "unique": 2, "today": 2, "selected": 2, "errors": 1}


def test_links_that_cannot_be_read_are_errors_and_no_articles(spark, tmp_path):
    catalog = tmp_path / "c.yaml"
    catalog.write_text("sources:\n  - {name: One, url: 'https://one.example', rss: 'https://one.example/rss'}\n")
    item = "<item><title>{0} launches chips</title><link>{1}</link><pubDate>Mon, 02 Mar 2026 08:00:00 GMT</pubDate></item>"
    links = ["http://[bad/a", "http://[bad/b", "https://[no]/c", "https://good.example/d"]
    fetch = lambda url: "<rss><channel>" + "".join(item.format(w, u) for w, u in zip(("Alpha", "Beta", "Gamma", "Delta"), links, strict=True)) + "</channel></rss>"
    done = run(spark, fetch, lambda url, agent: (url, "text/html", ""), NOW, catalog=catalog)
    assert [(r.url, r.duplicate_count) for r in done.ranked.collect()] == [("https://good.example/d", 1)]
    why = ["Invalid IPv6 URL", "Invalid IPv6 URL", "'no' does not appear to be an IPv4 or IPv6 address"]
    assert sorted(tuple(r) for r in done.rejects.collect()) == [("One", u, f) for u, f in zip(links, why, strict=False)]
    assert sorted(r.message for r in done.errors.collect()) == [f"Entry rejected (One): {u}: {f}" for u, f in zip(links, why, strict=False)]
    assert done.counts["rejects"] == done.counts["errors"] == 3 and done.counts["unique"] == 1
    none = run(spark, lambda url: "<rss><channel></channel></rss>", lambda url, agent: (url, "text/html", ""), NOW, catalog=catalog)
    assert none.counts == {"entries": 0, "rejects": 0, "unique": 0, "today": 0, "selected": 0, "errors": 0}


def test_only_urls_that_are_not_plain_meet_python(spark):
    df = spark.createDataFrame([("https://e.com/a?utm_source=1&b#c", 1), ("https://e.com/ä", 2), ("http://[x", 3), (None, 4), ("", 5)], "link string, url int")
    got = urls.with_normal_url(df, F.col("link"), "normal", "fault")
    assert got.columns == ["link", "url", "normal", "fault"]
    assert [tuple(r)[1:] for r in got.orderBy("url").collect()] == [(1, "https://e.com/a?b=", None), (2, "https://e.com/ä", None), (3, None, "Invalid IPv6 URL"), (4, None, None), (5, "", None)]
    assert [r.link for r in urls.with_normal_url(df, F.col("link"), "link").orderBy("url").collect()] == ["https://e.com/a?b=", "https://e.com/ä", None, None, ""]


def test_representatives_are_merged(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("abc"), rng.choice([None, 0.0, 0.5]), None if rng.random() < 0.3 else NOW - timedelta(hours=rng.randint(0, 3)), {"x": i}, i * 2) for i in rng.sample(range(400), 400)]
    df = spark.createDataFrame(rows, "rk long, of string, score double, published_at timestamp, odd map<string,long>, _best long").repartition(7)
    out = ranking.representatives(df, "of")
    assert out.columns == df.columns
    want = {min((r for r in rows if r[1] == c), key=lambda r: (-(r[2] or 0), r[3] is None, -(r[3].timestamp() if r[3] else 0), r[0]))[0] for c in "abc"}
    assert {r.rk for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan


def test_blocked_pages_are_not_requested(spark, tmp_path):
    catalog = tmp_path / "c.yaml"
    catalog.write_text("sources:\n  - {name: One, url: 'https://one.example', rss: 'https://one.example/rss', fetch_overrides: {blocked_domains: [bad.example]}}\n")
    asked = tmp_path / "asked"
    asked.mkdir()

    def fetch(url):
        item = "<item><title>{}</title><link>{}</link><pubDate>Mon, 02 Mar 2026 08:00:00 GMT</pubDate></item>"
        return "<rss><channel>" + item.format("Blocked story here", "https://www.bad.example/a") + item.format("Open thing entirely", "https://good.example/b") + "</channel></rss>"

    def get(url, agent):
        (asked / url.split("/")[2]).touch()
        if "bad" in url:
            raise OSError("must not be asked")
        return url, "text/html", ""

    done = run(spark, fetch, get, NOW, catalog=catalog)
    assert [p.name for p in asked.iterdir()] == ["good.example"] and done.errors.count() == 0 and done.ranked.count() == 2


class Site(BaseHTTPRequestHandler):
    """A feed, its pages, a model and a message service that refuses articles of 'bad'."""

    def log_message(self, *_):
        pass

    def _answer(self, status, kind, body):
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.end_headers()
        self.wfile.write(body.encode())

    def do_GET(self):
        base = f"http://{self.headers['Host']}"
        if self.path == "/rss" and self.headers["User-Agent"] == "gazette/0.1":
            item = "<item><title>{0} launches chips</title><link>{1}/{0}?utm_source=x</link><pubDate>Mon, 02 Mar 2026 08:00:00 GMT</pubDate></item>"
            self._answer(200, "application/rss+xml", "<rss><channel>" + item.format("good", base) + item.format("moved", base) + item.format("gone", base) + "</channel></rss>")
        elif self.path == "/moved":
            self.send_response(302)
            self.send_header("Location", "/arrived")
            self.end_headers()
        elif self.path in ("/good", "/arrived"):
            self._answer(200, "text/html; charset=utf-8", f'<meta property="og:title" content="Page {self.path[1:]} é"><meta property="og:image" content="{base}/i.png">')
        else:
            self._answer(404, "text/plain", "no")

    def do_POST(self):
        said = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path == "/v1/chat/completions":
            ok = self.headers["Authorization"] == "Bearer key" and said["max_tokens"] == 220 and said["messages"][0]["role"] == "system"
            self._answer(200 if ok else 500, "application/json", json.dumps({"choices": [{"message": {"content": "One. Two. Three." if len(said["messages"]) == 3 else "Short."}}]}))
        elif "gone" in (said.get("caption") or said["text"]):
            self._answer(400, "application/json", json.dumps({"ok": False, "description": "refused"}))
        else:
            self._answer(200, "application/json", json.dumps({"ok": self.path.startswith("/bottoken/send"), "result": {"message_id": 1}}))


def test_command_line(spark, tmp_path, capsys):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    catalog = tmp_path / "c.yaml"
    catalog.write_text(f"sources:\n  - {{name: One, url: '{base}', rss: '{base}/rss'}}\n")
    env = {"SOURCES_FILE": str(catalog), "TELEGRAM_BASE_URL": base, "OPENROUTER_BASE_URL": f"{base}/v1", "OPENROUTER_API_KEY": "key", "REQUEST_TIMEOUT_SECONDS": "10"}
    dry = Settings.load(tmp_path / "none", env)
    assert main([]) == 0 and main(["run"], settings=dry) == 2
    assert "TELEGRAM_BOT_TOKEN, TELEGRAM_CHAT_ID" in capsys.readouterr().out
    assert main(["run", "--dry-run"], {"now": NOW}, dry) == 0
    assert "selected=3 attempted=3 sent=3 failed=0 dry_run=True" in capsys.readouterr().out
    real = replace(dry, telegram_bot_token="token", telegram_chat_id="c")
    assert main(["run", "--limit", "5"], {"now": NOW}, real) == 1
    assert "selected=3 attempted=3 sent=2 failed=1 dry_run=False" in capsys.readouterr().out
    server.shutdown()


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# a comment\nexport TELEGRAM_BOT_TOKEN='to ken'\ntelegram_chat_id=5 # mine\nHTTP_CONCURRENCY=3\nOTHER=x\nUSER_AGENT=file\n")
    s = Settings.load(tmp_path / ".env", {"USER_AGENT": "environment"})
    assert (s.telegram_bot_token, s.telegram_chat_id, s.http_concurrency, s.user_agent, s.max_articles_per_run) == ("to ken", "5", 3, "environment", 50)
    assert s.missing(False) == [] and Settings(telegram_chat_id=" ").missing(False) == ["TELEGRAM_BOT_TOKEN", "TELEGRAM_CHAT_ID"] and Settings().missing(True) == []
    assert [s.limit(x) for x in (None, 0, 7, 99)] == [50, 1, 7, 50]


def test_today_in_any_zone(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "America/New_York")
    df = session.createDataFrame([(0, datetime(2026, 3, 2, 1, tzinfo=timezone.utc)), (1, datetime(2026, 3, 1, 23, 59, tzinfo=timezone.utc))], "i int, published_at timestamp")
    assert [r.i for r in datefilter.published_today(df, NOW).collect()] == [0]


def test_storage_is_removed(spark, tmp_path):
    made = storage.stored(spark.range(5), "some")
    where = storage.root(spark).removeprefix("file:")
    assert made.count() == 5 and os.path.isdir(where)
    storage.clear(spark)
    assert not os.path.exists(where) and storage.root(spark) != where
    assert staging.free_names(["a", "_B"], "_b", "_b", "c") == ["_b_", "_b__", "c"]


def test_every_query_runs(spark):
    import __spark_entry__

    folder = "/root/testdata/sf0.01"  # a table of 50 pages, as of the smallest size, has no two titles that share two words
    assert __spark_entry__.entry(spark).count() == 50
    known, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(known)
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    text_of = lambda v: "" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    for name in queries.QUERIES:
        got = known[name](spark, folder)
        cols = sorted(got.columns)
        rows = sorted(tuple(map(text_of, r)) for r in got.select(*cols).collect())
        assert rows, name
        if name in sql:
            want = con.execute(f"SELECT {', '.join(cols)} FROM ({sql[name]})").fetchall()
            assert rows == sorted(tuple(map(text_of, r)) for r in want), name
