"""Sessions and conversation history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectra.plans.constants import HISTORY_TOKENS, SESSION_TTL_SECONDS


def session_threads(requests: DataFrame, user: str, ts: str, tie: str, ttl: int = SESSION_TTL_SECONDS) -> DataFrame:
    """Requests with their thread number: a gap of ttl seconds or more starts a new thread."""
    order = Window.partitionBy(user).orderBy(ts, tie)
    gap = F.timestamp_diff("MICROSECOND", F.lag(ts).over(order), F.col(ts))
    started = F.coalesce(gap >= ttl * 1_000_000, F.lit(True)).cast("int")
    return requests.withColumn("_start", started).withColumn("thread", F.sum("_start").over(order)).drop("_start")


def trimmed_history(messages: DataFrame, conversation: str, turn: str, role: str, tokens: Column, budget: int = HISTORY_TOKENS, human: str = "user") -> DataFrame:
    """Latest messages of each conversation within the budget, from the first human one among them on."""
    latest = Window.partitionBy(conversation).orderBy(F.desc(turn)).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(conversation)
    kept = messages.withColumn("_used", F.sum(tokens).over(latest))
    start = F.min(F.when((F.col("_used") <= budget) & (F.col(role) == human), F.col(turn))).over(whole)
    return kept.withColumn("_from", start).where((F.col("_used") <= budget) & (F.col(turn) >= F.col("_from"))).drop("_from", "_used")


def last_turn(messages: DataFrame, conversation: str, turn: str, role: str, human: str = "user") -> DataFrame:
    """Messages from the last human one on; all where there is none.

    A pre-aggregated maximum and a join, not a window, so that no task holds a whole long conversation.
    """
    last = messages.groupBy(conversation).agg(F.max(F.when(F.col(role) == human, F.col(turn))).alias("_last"))
    return messages.join(last, conversation).where(F.col("_last").isNull() | (F.col(turn) >= F.col("_last"))).drop("_last")
