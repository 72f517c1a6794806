"""Bulk analysis: cached answers first, then the curated list, then the model; in request order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.operators.audit import log_gate, log_rows
from wardlight.operators.lookups import combine_results, known_lookup, known_verdict, live_entries, payload_json
from wardlight.session import checkpoint

ANSWER = ["score", "label", "confidence"]


def bulk_analyze(requests: DataFrame, sets: DataFrame, known: DataFrame, now: Column,
                 score: Callable[[DataFrame], DataFrame], order: str = "pos", tie: str = "seq") -> DataFrame:
    """``requests`` (domain and its place ``order``) with source, score, label and confidence.

    Each distinct domain is looked up once in the live entries of ``sets`` and in the
    curated list; ``score`` gets the remaining ones (column domain) and returns them with
    the answer columns.  Of a cached entry come the answer columns that ``sets`` holds, the
    others are null.  Every request has one row, repeated domains included; a null domain
    has none.  Where the lookups lead is written once, names and verdicts only, so
    the branches don't repeat the joins.
    """
    kept = [c for c in ANSWER if c in sets.columns]
    live = live_entries(sets, now, tie=tie).select("domain", F.struct(*kept).alias("cached_answer"))
    asked = requests.select("domain").where(F.col("domain").isNotNull()).distinct()
    routed = checkpoint(known_lookup(asked.join(live, "domain", "left"), known))
    cached, listed = F.col("cached_answer").isNotNull(), F.col("known").isNotNull()
    types = {"score": "double", "label": "string", "confidence": "string"}
    answers = {
        "cache": routed.where(cached).select("domain", *[
            (F.col("cached_answer")[c] if c in kept else F.lit(None)).cast(types[c]).alias(c) for c in ANSWER]),
        "known": known_verdict(routed.where(~cached & listed)).select("domain", *ANSWER),
        "model": score(routed.where(~cached & ~listed).select("domain")).select("domain", *ANSWER)}
    return combine_results(requests, *[a.withColumn("source", F.lit(n)) for n, a in answers.items()], order=order)


def fresh_answers(answers: DataFrame) -> DataFrame:
    """One row for each domain that no cache answered."""
    return answers.where(F.col("source") != "cache").groupBy("domain").agg(
        *[F.min(c).alias(c) for c in ["source", *ANSWER]])


def rows_to_log(answers: DataFrame, now: Column) -> DataFrame:
    """The flagged fresh answers as log rows."""
    return log_rows(log_gate(fresh_answers(answers))).withColumn("created_at", now)


def rows_to_cache(answers: DataFrame, now: Column) -> DataFrame:
    """What the next request for a fresh domain may be answered with."""
    return payload_json(fresh_answers(answers), ["domain", *ANSWER]).select(
        "domain", "label", "payload", now.alias("cached_at"))
