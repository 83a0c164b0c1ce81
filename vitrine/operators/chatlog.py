"""Message log: sessions, last-N history, prompt contexts, transcripts, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import values as V
from vitrine.functions.store import as_date, role_label
from vitrine.functions.text import strip

EMAIL_PATTERN = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
PHONE_PATTERN = "\\(?[0-9]{2,3}\\)?[ .-]?[0-9]{3,5}[ .-][0-9]{4}"


def new_sessions(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Session rows that ``messages`` would add: sessions not known yet, created at their first message."""
    first = messages.groupBy("session_id").agg(F.min("message_id").alias("first_message_id"))
    return first.join(sessions.select("session_id"), "session_id", "left_anti")


def append(messages: DataFrame, new: DataFrame) -> DataFrame:
    return messages.unionByName(new, allowMissingColumns=True)


def reset(messages: DataFrame, resets: DataFrame) -> DataFrame:
    """The log without the sessions in ``resets``."""
    return messages.join(resets.select("session_id").distinct(), "session_id", "left_anti")


def last_n(messages: DataFrame, n: int = V.HISTORY_LIMIT) -> DataFrame:
    """The last ``n`` messages of each session; ``turn_no`` counts them oldest first.

    Spark cuts each session to ``n`` rows before the shuffle, so a long session costs nothing extra.
    """
    newest = Window.partitionBy("session_id").orderBy(F.col("message_id").desc())
    kept = messages.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= n)
    return kept.withColumn("turn_no", F.row_number().over(Window.partitionBy("session_id").orderBy("message_id"))).drop(
        "_back"
    )


def _history(messages: DataFrame, n: int, *fields: Column) -> DataFrame:
    """Per session its last ``n`` messages as one array, oldest first: never more than ``n`` elements."""
    listed = F.sort_array(F.collect_list(F.struct("message_id", *fields)))
    return last_n(messages, n).groupBy("session_id").agg(listed.alias("history"))


def prompt_context(messages: DataFrame, template: str, as_of, n: int = V.HISTORY_LIMIT) -> DataFrame:
    """``(session_id, context)``: the system text dated ``as_of``, then the last messages, as role/content structs."""
    today = F.date_format(as_date(as_of), V.DATE_FORMAT)
    system = F.struct(F.lit("system").alias("role"), F.replace(F.lit(template), F.lit("{today}"), today).alias("content"))
    turns = F.transform("history", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return _history(messages, n, F.col("role"), F.col("content")).select(
        "session_id", F.concat(F.array(system), turns).alias("context")
    )


def render(messages: DataFrame, model: str, n: int = V.HISTORY_LIMIT) -> DataFrame:
    """``(session_id, transcript)``: the last messages as Markdown text."""
    line = F.concat(F.lit("**"), role_label(F.col("role")), F.lit(":** "), F.col("content"), F.lit("\n"))
    return _history(messages, n, line.alias("line")).select(
        "session_id",
        F.concat_ws("\n", F.lit(f"model: {model}\n"), F.transform("history", lambda m: m["line"])).alias("transcript"),
    )


def with_fallback(replies: DataFrame) -> DataFrame:
    """Empty replies become the fixed apology; ``is_fallback`` marks them."""
    empty = F.coalesce(strip(F.col("content")), F.lit("")) == ""
    return replies.withColumn("is_fallback", empty).withColumn(
        "content", F.when(empty, V.APOLOGY).otherwise(F.col("content"))
    )


def fallback_rate(replies: DataFrame) -> DataFrame:
    return (
        with_fallback(replies)
        .groupBy("session_id")
        .agg(F.count("*").alias("replies"), F.count_if("is_fallback").alias("fallbacks"))
        .withColumn("rate", F.col("fallbacks") / F.col("replies"))
    )


def expand_scenarios(scenarios: DataFrame) -> DataFrame:
    """Scenario rows ``(session_id, messages array)`` as user messages numbered from 0."""
    return scenarios.select("session_id", F.posexplode("messages").alias("message_id", "content")).select(
        "session_id", F.col("message_id").cast("long").alias("message_id"), F.lit("user").alias("role"), "content"
    )


def replay(messages: DataFrame, scenarios: DataFrame) -> DataFrame:
    """The log after replaying scenarios: each clears its own session first."""
    return append(reset(messages, scenarios), expand_scenarios(scenarios))


def pii_audit(texts: DataFrame, text: str, *groups: str) -> DataFrame:
    """Texts with e-mail addresses or phone numbers, and how many, per group."""
    counted = texts.select(
        *groups,
        F.regexp_count(text, F.lit(EMAIL_PATTERN)).alias("_emails"),
        F.regexp_count(text, F.lit(PHONE_PATTERN)).alias("_phones"),
    )
    return counted.groupBy(*groups).agg(
        F.count("*").alias("texts"),
        F.count_if((F.col("_emails") > 0) | (F.col("_phones") > 0)).alias("flagged"),
        F.sum("_emails").alias("emails"),
        F.sum("_phones").alias("phones"),
    )
