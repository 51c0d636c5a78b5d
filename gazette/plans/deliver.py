"""Summaries by a language model and delivery of messages, with transports given by the caller."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions import render
from gazette.functions.scoring import effective_context, effective_title
from gazette.functions.staging import free_names
from gazette.functions.text import count_sentences, enforce_sentences
from gazette.storage import get, names, put

RESULT = "article_id string, status string, mode string, preview string, message_id long, error string, rank long"

# What a failed delivery says.
NO_CREDENTIALS = "Telegram credentials are missing."
SEND_FAILED = "Telegram send failed."
GAVE_UP = "Unknown send failure."

#: What is said of a message that a stopped run had begun to send.
IN_DOUBT = "A run that was stopped may have sent this message."


def summarize(df: DataFrame, ask: Callable[[str, bool], str] | None = None, concurrency: int = 4) -> DataFrame:
    """df with summary. ask(prompt, again) answers; an answer short of three sentences is asked for once more, and padded if it
    stays so. Without ask, or where it raises, the template's summary stands."""
    title, context = effective_title(F.col("og_title"), F.col("title")), effective_context(F.col("og_description"), F.col("description"))
    if ask is None:
        return render.with_template_summary(df, title, F.col("source_name"), context)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = []
            for text in batch["_prompt"]:
                try:
                    answer = ask(text, False)
                    said.append(answer if count_sentences(answer) >= 3 else ask(text, True))
                except Exception:  # noqa: BLE001 - whatever fails, the template answers
                    said.append(None)
            yield batch[["id"]].assign(_answer=pd.Series(said, dtype=object, index=batch.index))

    asked = df.select("id", render.prompt(title, F.col("source_name"), F.col("published_at"), F.col("url"), context).alias("_prompt"))
    answers = asked.repartition(concurrency).mapInPandas(each, "id string, _answer string")
    (template,) = free_names(df.columns, "_template")
    told = render.with_template_summary(df.join(answers, "id", "left"), title, F.col("source_name"), context, template)
    answer = F.col("_answer")
    return told.withColumn("summary", F.when(answer.isNotNull(), enforce_sentences(answer)).otherwise(F.col(template))).drop("_answer", template)


def previews(df: DataFrame) -> DataFrame:
    """What a dry run would send, in the columns of RESULT."""
    shown = render.with_preview(df, F.col("url"), effective_title(F.col("og_title"), F.col("title")), F.col("summary"), F.col("image_url"))
    return shown.select(F.col("id").alias("article_id"), F.lit("dry_run").alias("status"), "mode", "preview", F.lit(None).cast("long").alias("message_id"), F.lit(None).cast("string").alias("error"), F.col("rank").cast("long").alias("rank"))


def send_with_retry(post: Callable[[str, dict], tuple[int, dict]], method: str, payload: dict, sleep: Callable[[float], None] = time.sleep, attempts: int = 3) -> dict:
    """Post until it succeeds. Status 429 waits as told (2 s by default) and takes an attempt; other failures wait one second
    more each time; the last answer comes back."""
    for attempt in range(1, attempts + 1):
        try:
            status, data = post(method, payload)
        except Exception as e:  # noqa: BLE001 - a failing transport is an answer too
            if attempt == attempts:
                return {"ok": False, "description": str(e)}
            sleep(attempt)
            continue
        if status == 429:
            sleep(int(data.get("parameters", {}).get("retry_after", 2)))
        elif 200 <= status < 300 and data.get("ok") or attempt == attempts:
            return data
        else:
            sleep(attempt)
    return {"ok": False, "description": GAVE_UP}


class Journal:
    """What became of each message of a run, in a folder of the shared storage: an intent before it is sent, a result after it.

    A run that was stopped anywhere is given its journal again and sends the rest. A message with an intent and no result may
    have been sent or not; it is reported (IN_DOUBT) and not repeated.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.intents, self.results = (set(names(spark, f"{self.path}/{kind}")) for kind in ("intents", "results"))

    @staticmethod
    def _key(article: str) -> str:
        return hashlib.sha256(article.encode()).hexdigest()

    def result(self, article: str) -> dict | None:
        key = self._key(article)
        return json.loads(get(self.spark, f"{self.path}/results/{key}")) if key in self.results else None

    def begun(self, article: str) -> bool:
        return self._key(article) in self.intents

    def intend(self, article: str) -> None:
        put(self.spark, f"{self.path}/intents/{self._key(article)}", article)

    def close(self, article: str, result: dict) -> None:
        put(self.spark, f"{self.path}/results/{self._key(article)}", json.dumps(result))


def _send(r, post, chat_id: str, parse_mode: str, sleep) -> dict:
    """status, mode, message_id, error of one message. A photo that fails is sent as a text."""
    sent: dict = {}
    if r.image_url:
        sent = send_with_retry(post, "sendPhoto", {"chat_id": chat_id, "photo": r.image_url, "caption": r.caption, "parse_mode": parse_mode}, sleep)
    mode = "photo"
    if not sent.get("ok"):
        mode = "text"
        sent = send_with_retry(post, "sendMessage", {"chat_id": chat_id, "text": r.message, "parse_mode": parse_mode, "disable_web_page_preview": False}, sleep)
    if sent.get("ok"):
        return {"status": "sent", "mode": mode, "message_id": sent["result"].get("message_id"), "error": None}
    return {"status": "error", "mode": None, "message_id": None, "error": sent.get("description", SEND_FAILED)}


def deliver(df: DataFrame, post: Callable[[str, dict], tuple[int, dict]] | None, chat_id: str | None, parse_mode: str = "HTML", sleep: Callable[[float], None] = time.sleep, journal: str | None = None) -> DataFrame:
    """Send df's rows in the order of `rank`, one after the other from the driver: a top-k report, and a task that is run
    again must not send twice. With a `journal` (a folder of the shared storage), what it says was sent is not sent again; what
    failed is."""
    spark = df.sparkSession
    shown = render.with_messages(df, F.col("url"), effective_title(F.col("og_title"), F.col("title")), F.col("summary"))
    rows = shown.orderBy("rank").select("id", "image_url", "caption", "message", "rank")
    kept = Journal(spark, journal) if journal else None
    out = []
    for r in rows.toLocalIterator():
        known = kept.result(r.id) if kept else None
        if known and known["status"] == "sent":
            told = known
        elif post is None or not chat_id:
            told = {"status": "error", "mode": None, "message_id": None, "error": NO_CREDENTIALS}
        elif kept and known is None and kept.begun(r.id):
            told = {"status": "error", "mode": None, "message_id": None, "error": IN_DOUBT}
        else:
            if kept:
                kept.intend(r.id)
            told = _send(r, post, chat_id, parse_mode, sleep)
            if kept:
                kept.close(r.id, told)
        out.append((r.id, told["status"], told["mode"], None, told["message_id"], told["error"], r["rank"]))
    return spark.createDataFrame(out, RESULT)


def rollup(results: DataFrame) -> DataFrame:
    """attempted, failed and sent (dry runs too) of delivery results."""
    return results.agg(F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("status") == "error").alias("failed"), F.count_if(F.col("status").isin("sent", "dry_run")).alias("sent"))


def first_failures(results: DataFrame, most: int = 3) -> DataFrame:
    """rank, failure of the first deliveries that failed: which article, and why."""
    said = F.concat("article_id", F.lit(": "), F.coalesce("error", F.lit("unknown")))
    return results.where("status = 'error'").orderBy("rank").limit(most).select("rank", said.alias("failure"))
