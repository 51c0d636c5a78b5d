"""The whole run: feeds, keep-latest, pages, today's articles, clusters and scores, summaries, delivery. Also the command line."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions.urls import is_blocked
from gazette.operators.datefilter import published_today
from gazette.operators.dedupe import keep_latest
from gazette.operators.enrich import enrich, fetch_pages, lookup_rules
from gazette.operators.ranking import clamp_limit, rank_articles
from gazette.operators.rejects import split
from gazette.plans import deliver
from gazette.plans.settings import Settings
from gazette.sources import feeds, http
from gazette.storage import metered, stored

log = logging.getLogger(__name__)


@dataclass
class Run:
    ranked: DataFrame
    results: DataFrame
    errors: DataFrame  # stage, message
    rejects: DataFrame  # source_name, link, fault: entries whose links can't be read
    counts: dict[str, int]  # rows of each stage, gathered while it was written

    @property
    def filtered(self) -> int:
        """Articles that are not of today."""
        return self.counts["unique"] - self.counts["today"]


def run(spark: SparkSession, fetch: Callable[[str], str], get: Callable[[str, bool], tuple[str, str, str]], now: datetime, limit: int = 50, dry_run: bool = True, ask=None, post=None, chat_id: str | None = None, catalog=feeds.CATALOG, settings: Settings | None = None, journal: str | None = None) -> Run:
    """A `now` without a zone is UTC. Pages of blocked domains are not requested. Entries whose links can't be read are no articles
    but errors. With a `journal` (a folder of the shared storage), a run that was stopped while it sent goes on."""
    known = settings or Settings()
    now = now if now.tzinfo else now.replace(tzinfo=timezone.utc)
    counts: dict[str, int] = {}

    def counted(df: DataFrame, name: str) -> DataFrame:
        out, seen = metered(df, name, rows=F.count(F.lit(1)))
        counts[name] = seen.get("rows", 0)
        log.info("%s: %s rows", name, counts[name])
        return out

    sources = feeds.load_catalog(spark, catalog)
    entries = counted(feeds.read_feeds(sources, fetch, known.http_concurrency), "entries")
    good, rejects = split(feeds.scanned(entries, sources, known.max_feed_items_per_source), "fault", "scanned")
    rejects = counted(rejects.select("source_name", "link", "fault"), "rejects")
    unique = keep_latest(good.drop("link"), ["url"], "published_at", "pos", "duplicate_count").drop("pos").withColumnRenamed("first_pos", "pos")
    ruled = counted(lookup_rules(unique, sources), "unique")
    asked = ruled.where(~is_blocked(F.col("url"), F.col("blocked"))).groupBy("url").agg(F.bool_or("requires_ua").alias("requires_ua"))
    pages = stored(fetch_pages(asked, get, known.http_concurrency), "pages")
    today = counted(published_today(enrich(ruled, pages.where("error is null").drop("error")), now), "today")
    ranked = counted(rank_articles(today, F.lit(now.isoformat()).cast("timestamp"), clamp_limit(limit, known.max_articles_per_run)), "selected")
    told = stored(deliver.summarize(ranked, None if dry_run else ask), "told")
    results = deliver.previews(told) if dry_run else deliver.deliver(told, post, chat_id, known.telegram_parse_mode, journal=journal)
    said = lambda df, stage, *message: df.select(F.lit(stage).alias("stage"), F.concat(*message).alias("message"))
    failed = ruled.join(pages.where("error is not null").select("url", "error"), "url")
    errors = said(entries.where("error is not null"), "ingest", F.col("error"))
    errors = errors.unionByName(said(rejects, "ingest", F.lit("Entry rejected ("), "source_name", F.lit("): "), "link", F.lit(": "), "fault"))
    errors = errors.unionByName(said(failed, "enrich", F.lit("Enrichment failed ("), "source_name", F.lit("): "), "error"))
    if not dry_run:
        errors = errors.unionByName(said(results.where("status = 'error'"), "deliver", F.lit("Delivery failure ("), "article_id", F.lit("): "), "error"))
    return Run(ranked, results, counted(errors, "errors"), rejects, counts)


def transports(settings: Settings, dry_run: bool) -> dict:
    """The HTTP clients of a run; without a key for the model the template's summaries stand."""
    how = {"user_agent": settings.user_agent, "timeout": settings.request_timeout_seconds}
    made: dict = {"fetch": partial(http.fetch_feed, **how), "get": partial(http.fetch_page, **how), "ask": None, "post": None}
    if settings.openrouter_api_key:
        made["ask"] = partial(
            http.ask_model, base_url=settings.openrouter_base_url, key=settings.openrouter_api_key, model=settings.openrouter_model,
            site=settings.openrouter_site_url, app=settings.openrouter_app_name, timeout=settings.request_timeout_seconds,
        )
    if not dry_run:
        made["post"] = partial(http.post_message, base_url=settings.telegram_base_url, token=settings.telegram_bot_token, timeout=settings.request_timeout_seconds)
    return made


def main(argv: list[str] | None = None, given: dict | None = None, settings: Settings | None = None) -> int:
    """Exit code 0, 1 if a delivery failed, 2 if a real run lacks settings. Without a command it prints help. `given` replaces
    transports (fetch, get, ask, post) or the moment (now)."""
    parser = argparse.ArgumentParser(prog="gazette")
    command = parser.add_subparsers(dest="command").add_parser("run", help="run everything")
    command.add_argument("--dry-run", action="store_true", help="send nothing")
    command.add_argument("--limit", type=int, default=None, help="articles to send at most")
    command.add_argument("--journal", default=None, help="a folder that a stopped run is continued from")
    command.add_argument("--verbose", action="store_true", help="log more")
    args = parser.parse_args(argv)
    if args.command is None:
        parser.print_help()
        return 0
    logging.basicConfig(level=logging.INFO, format="%(asctime)s | %(levelname)s | %(name)s | %(message)s")
    log.setLevel(logging.DEBUG if args.verbose else logging.INFO)
    settings = settings or Settings.load()
    if lacking := settings.missing(args.dry_run):
        print(f"Configuration error: missing required .env values: {', '.join(lacking)}")
        return 2
    t = transports(settings, args.dry_run) | (given or {})
    spark = SparkSession.builder.appName("gazette").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    done = run(spark, t["fetch"], t["get"], t.get("now") or datetime.now().astimezone(), settings.limit(args.limit), args.dry_run, t["ask"], t["post"], settings.telegram_chat_id, settings.sources_file, settings, args.journal)
    counts = deliver.rollup(done.results).first()
    failures = [r.failure for r in deliver.first_failures(done.results).collect()]
    if failures:
        log.error("First failed deliveries: %s", " | ".join(failures))
    if done.counts["errors"]:
        log.warning("%s errors that stopped nothing", done.counts["errors"])
    # This line and that of missing settings are the command line's contract.
    print(f"Run complete. selected={done.counts['selected']} attempted={counts.attempted} sent={counts.sent} failed={counts.failed} dry_run={args.dry_run}")
    return int(counts.failed > 0)


if __name__ == "__main__":
    raise SystemExit(main())
