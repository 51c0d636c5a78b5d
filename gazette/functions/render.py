"""Summaries, prompts and messages of an article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions.staging import free_names, with_steps
from gazette.functions.text import enforce_sentences, escape_html, present, strip, truncate

CAPTION_LIMIT, TEXT_LIMIT = 1024, 4096


def with_template_summary(df: DataFrame, title: Column, source: Column, context: Column, out: str = "summary") -> DataFrame:
    """df with three sentences made from title, source and the first 180 code points of the context. The sentences are fixed values."""

    def three(head: Column) -> Column:
        first = F.concat(title, F.lit(" is a notable AI update from "), source, F.lit("."))
        known = F.concat(F.lit("Key context: "), F.rtrim(head, F.lit(".")), F.lit("."))
        second = F.when(head != "", known).otherwise("The story appears relevant to current AI research and product developments.")
        return enforce_sentences(F.concat_ws(" ", first, second, F.lit("Open the link to review full details, claims, and technical context.")))

    return with_steps(df, out, lambda: F.substring(strip(context), 1, 180), three)


def utc_text(at: Column) -> Column:
    """An instant as ISO text in UTC, whatever the session's zone; a fraction only where there is one."""
    micros = F.unix_micros(at.cast("timestamp"))
    seconds, fraction = F.floor(micros / F.lit(1_000_000)), F.pmod(micros, F.lit(1_000_000))
    of_day = F.pmod(seconds, F.lit(86400))
    two = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    day = F.date_from_unix_date(F.floor(seconds / F.lit(86400)).cast("int")).cast("string")
    clock = F.concat_ws(":", two(F.floor(of_day / 3600)), two(F.floor(of_day / 60) % 60), two(of_day % 60))
    return F.concat(day, F.lit("T"), clock, F.when(fraction != 0, F.concat(F.lit("."), F.lpad(fraction.cast("string"), 6, "0"))).otherwise(""), F.lit("+00:00"))


def prompt(title: Column, source: Column, published: Column, url: Column, context: Column) -> Column:
    """What a model is asked. Labels and the last line are fixed values."""
    lines = [("Title: ", title), ("Source: ", source), ("Published: ", F.coalesce(utc_text(published), F.lit("unknown"))), ("URL: ", url), ("Context: ", context)]
    return F.concat_ws("\n", *[F.concat(F.lit(k), v) for k, v in lines], F.lit("Write exactly 3 sentences focused on key facts and why this matters."))


def _link(url: Column, title: Column) -> Column:
    return F.concat(F.lit('<a href="'), escape_html(url, quotes=True), F.lit('">'), title, F.lit("</a>\n\n"))


def _escaped(x: Column, limit: int) -> Column:
    """The escaped text, as far as a message of `limit` can show it: escaping makes no text shorter."""
    return escape_html(F.substring(x, 1, limit + 1))


def with_caption(df: DataFrame, url: Column, title: Column, summary: Column, out: str = "caption", limit: int = CAPTION_LIMIT) -> DataFrame:
    """df with a linked title, cut after escaping, and as much of the summary as the limit leaves."""
    return with_steps(
        df,
        out,
        lambda: _escaped(title, limit),
        lambda t: _link(url, truncate(t, max(40, min(200, limit // 3)))),
        lambda t, prefix: _escaped(summary, limit),
        lambda t, prefix, body: F.greatest(F.lit(limit) - F.char_length(prefix), F.lit(0)),
        lambda t, prefix, body, room: F.substring(F.concat(prefix, truncate(body, room)), 1, limit),
    )


def with_text_message(df: DataFrame, url: Column, title: Column, summary: Column, out: str = "message", limit: int = TEXT_LIMIT) -> DataFrame:
    return with_steps(df, out, lambda: F.concat(_link(url, _escaped(title, limit)), _escaped(summary, limit)), lambda whole: truncate(whole, limit))


def with_messages(df: DataFrame, url: Column, title: Column, summary: Column) -> DataFrame:
    """df with caption and message; where there is no summary they say so, in a fixed value."""
    said, link, head = free_names(df.columns, "_said", "_link", "_head")
    df = df.withColumns({said: F.coalesce(present(summary), F.lit("Summary unavailable.")), link: url, head: title})
    at = (F.col(link), F.col(head), F.col(said))
    return with_text_message(with_caption(df, *at), *at).drop(said, link, head)


def with_preview(df: DataFrame, url: Column, title: Column, summary: Column, image: Column) -> DataFrame:
    """df with mode and preview: a photo with a caption where there is an image, else a text. Replaces such columns."""
    (photo,) = free_names(df.columns, "_photo")
    shown = with_messages(df.withColumn(photo, F.coalesce(image != "", F.lit(False))), url, title, summary)
    columns = {"mode": F.when(F.col(photo), "photo").otherwise("text"), "preview": F.when(F.col(photo), F.col("caption")).otherwise(F.col("message"))}
    return shown.withColumns(columns).drop(photo, *{"caption", "message"}.difference(df.columns))
