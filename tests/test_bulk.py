from datetime import datetime

from pyspark.sql import functions as F

from wardlight.operators import bulk
from wardlight.session import written_once

NOW = datetime(2024, 1, 2, 12)
KNOWN = "domain string, verdict string, source string, is_active boolean"


def model(asked):
    """Records nothing but its input: a domain scores 0.9 where its name starts with m, else 0.1."""
    bad = F.col("domain").startswith("m")
    return asked.withColumns({"score": F.when(bad, 0.9).otherwise(0.1), "label": F.when(bad, "malicious").otherwise("safe"),
                              "confidence": F.lit("high")})


def answers(spark, columns="label string, score double", cached=("safe", 0.05)):
    requests = spark.createDataFrame(
        [(3, "c.com"), (0, "m.com"), (1, "k.com"), (4, "m.com"), (2, "x.com"), (5, None), (6, "www.k.com"), (7, "old.com")],
        "pos int, domain string")
    sets = spark.createDataFrame(
        [(1, "c.com", datetime(2024, 1, 2, 11, 30), *cached), (2, "old.com", datetime(2024, 1, 1), *cached),
         (3, "c.com", datetime(2024, 1, 2, 13), *cached)], f"seq long, domain string, cached_at timestamp, {columns}")
    known = spark.createDataFrame([("K.com", "phishing", "feed", True), ("c.com", "malicious", None, True),
                                   ("x.com", "malicious", None, False)], KNOWN)
    return bulk.bulk_analyze(requests, sets, known, F.lit(NOW), model)


def test_cache_then_list_then_model_in_request_order(spark):
    rows = {r["pos"]: r for r in answers(spark).collect()}
    assert {p: (r["domain"], r["source"], r["score"], r["label"]) for p, r in rows.items()} == {
        0: ("m.com", "model", 0.9, "malicious"), 1: ("k.com", "known", 1.0, "malicious"), 2: ("x.com", "model", 0.1, "safe"),
        3: ("c.com", "cache", 0.05, "safe"), 4: ("m.com", "model", 0.9, "malicious"),
        6: ("www.k.com", "known", 1.0, "malicious"), 7: ("old.com", "model", 0.1, "safe")}
    assert rows[3]["confidence"] is None and rows[1]["confidence"] == "high"
    only_label = {r["pos"]: r for r in answers(spark, "label string", ("safe",)).collect()}
    assert only_label[3]["score"] is None and only_label[3]["label"] == "safe"


def test_fresh_answers_are_logged_and_cached_once(spark):
    got = answers(spark)
    assert sorted(r["domain"] for r in bulk.rows_to_log(got, F.lit(NOW)).collect()) == ["k.com", "m.com", "www.k.com"]
    stored = bulk.rows_to_cache(got, F.lit(NOW)).collect()
    assert sorted(r["domain"] for r in stored) == ["k.com", "m.com", "old.com", "www.k.com", "x.com"]
    assert all(r["cached_at"] == NOW and '"score"' in r["payload"] for r in stored)


def test_nothing_asked(spark):
    none = spark.createDataFrame([], "pos int, domain string")
    sets = spark.createDataFrame([], "seq long, domain string, cached_at timestamp, label string")
    assert bulk.bulk_analyze(none, sets, spark.createDataFrame([], KNOWN), F.lit(NOW), model).count() == 0


def test_written_once(spark):
    calls = []

    def write(path):
        calls.append(path)
        spark.range(3).write.mode("overwrite").parquet(path)

    paths = {written_once(spark, "once-test", write) for _ in range(3)}
    assert len(calls) == 1 and spark.read.parquet(paths.pop()).count() == 3
