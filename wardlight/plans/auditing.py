"""Queries over lookups, caches, the verdict log, the registry and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.functions import scores as S
from wardlight.operators import audit as A
from wardlight.operators import lookups as L
from wardlight.operators import metrics as M
from wardlight.plans.parsing import rounded
from wardlight.plans.registry import query, with_inputs
from wardlight.sources.adapters import adapted

NOW = "1997-06-15 12:00:00"
LOG_NOW = "2024-01-20 00:00:00"


def at(text):
    return F.lit(text).cast("timestamp")


KEY = "CASE WHEN starts_with(lower(domain), 'www.') THEN substr(lower(domain), 5) ELSE lower(domain) END"
ACTIVE = """SELECT lower(domain) AS k, min({'verdict': verdict, 'source': source}) AS e FROM known
  WHERE is_active AND verdict IN ('safe', 'malicious', 'phishing') GROUP BY 1"""
_KNOWN = dict(req=f"SELECT row_id, domain, {KEY} AS mk FROM asset_hosts", active=ACTIVE)


def known(spark, sf):
    from wardlight.operators.parse import validate_known

    return validate_known(adapted(spark, sf, "known"))


@query("jn2_known_lookup", with_inputs("asset_hosts known", """SELECT row_id, e.verdict AS verdict, e.source AS source
  FROM req LEFT JOIN active ON mk = k""", **_KNOWN))
def known_lookup(spark, sf):
    return L.known_lookup(adapted(spark, sf, "asset_hosts"), known(spark, sf)).select(
        "row_id", "known.verdict", "known.source")


@query("jn3_route_verdicts", with_inputs("asset_hosts known", """SELECT row_id,
  CASE WHEN k IS NULL THEN 'unknown' ELSE 'known' END AS route FROM req LEFT JOIN active ON mk = k""", **_KNOWN))
def route(spark, sf):
    hit, miss = L.route_verdicts(adapted(spark, sf, "asset_hosts"), known(spark, sf))
    return hit.select("row_id", F.lit("known").alias("route")).unionByName(
        miss.select("row_id", F.lit("unknown").alias("route")))


@query("jn4_known_verdict", with_inputs("asset_hosts known", """SELECT row_id, domain, CASE WHEN e.verdict = 'safe' THEN 0.0 ELSE 1.0 END::DOUBLE AS score,
  CASE WHEN e.verdict = 'safe' THEN 'safe' ELSE 'malicious' END AS label, 'high' AS confidence,
  CASE WHEN e.verdict = 'safe' THEN '' ELSE 'This domain is on a curated threat list (source: ' || coalesce(e.source, 'manual') || ')' END AS reasons
  FROM req JOIN active ON mk = k""", **_KNOWN))
def known_verdict(spark, sf):
    rows = L.known_lookup(adapted(spark, sf, "asset_hosts").drop("label"), known(spark, sf)).where("known IS NOT NULL")
    return L.known_verdict(rows).select("row_id", "domain", "score", "label", "confidence",
                                        F.array_join("reasons", "|").alias("reasons"))


_ASOF = """SELECT r.read_id, s.seq AS found_seq FROM cache_reads r ASOF LEFT JOIN newest s
  ON r.domain = s.domain AND r.ts >= s.cached_at"""
_NEWEST = "SELECT * FROM cache_sets WHERE ns = 'dns' QUALIFY row_number() OVER (PARTITION BY domain, cached_at ORDER BY seq DESC) = 1"


@query("jn6_latest_snapshot", with_inputs("cache_reads cache_sets", """SELECT read_id, CASE WHEN ts - cached_at < INTERVAL 24 HOUR THEN seq END AS found_seq
  FROM (SELECT r.read_id, r.ts, s.seq, s.cached_at FROM cache_reads r ASOF LEFT JOIN newest s ON r.domain = s.domain AND r.ts >= s.cached_at)""",
                                          newest=_NEWEST))
def latest_snapshot(spark, sf):
    obs = adapted(spark, sf, "cache_sets").where("ns = 'dns'")
    out = L.latest_snapshot(adapted(spark, sf, "cache_reads"), obs, "domain", "ts", "cached_at", "seq", ["seq"])
    return out.select("read_id", F.col("found.seq").alias("found_seq"))


_TTL = "to_seconds(CASE WHEN label = 'safe' THEN 3600 ELSE 900 END)"


@query("jn7_cached_hits", with_inputs("cache_reads cache_sets", f"""SELECT read_id, coalesce(hit, false) AS hit, CASE WHEN hit THEN label END AS cached_label
  FROM (SELECT r.read_id, s.label, r.ts < s.cached_at + {_TTL} AS hit FROM cache_reads r ASOF LEFT JOIN newest s
        ON r.domain = s.domain AND r.ts >= s.cached_at)""", newest=_NEWEST.replace("WHERE ns = 'dns' ", "")))
def cached_hits(spark, sf):
    return L.cached_hits(adapted(spark, sf, "cache_reads"), adapted(spark, sf, "cache_sets")).select(
        "read_id", "hit", "cached_label")


_LIVE = (f"SELECT *, cached_at + {_TTL} AS expires_at FROM (SELECT * FROM cache_sets WHERE cached_at <= TIMESTAMP '{NOW}'"
         " QUALIFY row_number() OVER (PARTITION BY domain ORDER BY cached_at DESC, seq DESC) = 1)")


@query("jn8_bulk_probe", with_inputs("asset_hosts cache_sets", f"""SELECT row_id, label AS cached_label, label IS NOT NULL AS cached
  FROM (SELECT row_id, replace(domain, 'www.', '') AS domain FROM asset_hosts) a LEFT JOIN
  (SELECT * FROM live WHERE expires_at > TIMESTAMP '{NOW}') l ON a.domain = l.domain""", live=_LIVE))
def bulk_probe(spark, sf):
    asked = adapted(spark, sf, "asset_hosts").drop("label").withColumn("domain", F.regexp_replace("domain", r"^www\.", ""))
    return L.bulk_probe(asked, adapted(spark, sf, "cache_sets"), at(NOW)).select("row_id", "cached_label", "cached")


@query("set1_combine_results", with_inputs("asset_hosts known cache_sets", f"""SELECT row_id, domain,
  CASE WHEN l.label IS NOT NULL THEN 'cache' WHEN e IS NOT NULL THEN 'known' ELSE 'model' END AS origin
  FROM req LEFT JOIN active ON mk = k LEFT JOIN (SELECT domain AS ld, label FROM live WHERE expires_at > TIMESTAMP '{NOW}') l ON domain = ld""",
  **_KNOWN, live=_LIVE))
def combine_results(spark, sf):
    asked = adapted(spark, sf, "asset_hosts").select("row_id", "domain")
    probed = L.bulk_probe(asked, adapted(spark, sf, "cache_sets"), at(NOW))
    hit, miss = L.route_verdicts(probed.where("NOT cached").select("domain"), known(spark, sf))
    answers = [d.select("domain").distinct().withColumn("origin", F.lit(n)) for n, d in
               (("cache", probed.where("cached")), ("known", hit), ("model", miss))]
    return L.combine_results(asked, *answers, order="row_id")


@query("sc9_payload_round_trip", with_inputs("analyses", """SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN domain END AS domain,
  CASE WHEN event_id % 6 <> 0 THEN label END AS label FROM analyses"""))
def payload_round_trip(spark, sf):
    rows = L.payload_json(adapted(spark, sf, "analyses"), ["domain", "score", "label"])
    broken = rows.withColumn("payload", F.when(F.col("event_id") % 6 == 0, F.concat(F.lit("{oops"), "payload"))
                             .otherwise(F.col("payload")))
    parsed = L.payload_parsed(broken, "domain string, score double, label string")
    return parsed.select("event_id", "parsed.domain", "parsed.label")


@query("flt1_log_gate", with_inputs("analyses", "SELECT event_id FROM analyses WHERE score >= 0.5"))
def log_gate(spark, sf):
    return A.log_gate(adapted(spark, sf, "analyses")).select("event_id")


@query("log1_log_rows", with_inputs("analyses", "SELECT event_id, lower(domain) AS domain, round(score, 6) AS score, source FROM analyses WHERE score >= 0.5"))
def log_rows(spark, sf):
    return A.log_rows(A.log_gate(adapted(spark, sf, "analyses"))).select("event_id", "domain", "score", "source")


_CURRENT = """SELECT lower(domain) AS domain, event_id, label, score FROM analyses
  QUALIFY row_number() OVER (PARTITION BY lower(domain) ORDER BY created_at DESC, event_id DESC) = 1"""


def current(spark, sf):
    return A.latest_per_key(A.log_rows(adapted(spark, sf, "analyses")), ["domain"], ["created_at", "event_id"])


@query("wn1_latest_per_domain", with_inputs("analyses", "SELECT domain, event_id, label FROM cur", cur=_CURRENT))
def latest_per_domain(spark, sf):
    return current(spark, sf).select("domain", "event_id", "label")


@query("log2_upsert_analyses", with_inputs("analyses", "SELECT domain, event_id, label FROM cur",
    cur=_CURRENT.replace("ORDER BY created_at DESC", "ORDER BY event_id % 3 = 0 DESC, created_at DESC")))
def upsert_analyses(spark, sf):
    """A later batch replaces earlier rows, whatever their timestamps."""
    rows = A.log_rows(adapted(spark, sf, "analyses"))
    old = A.latest_per_key(rows.where("event_id % 3 <> 0"), ["domain"], ["created_at", "event_id"])
    return A.upsert(old, rows.where("event_id % 3 = 0"), ["domain"], ["created_at", "event_id"]).select(
        "domain", "event_id", "label")


@query("log2_upsert_registry", with_inputs("registry", """SELECT version, arg_max(auc_roc, seq) FILTER (auc_roc IS NOT NULL) AS auc_roc,
  arg_max(notes, seq) FILTER (notes IS NOT NULL) AS notes, arg_max(is_production, seq) AS is_production FROM registry GROUP BY version"""))
def upsert_registry(spark, sf):
    return A.upsert_non_null(adapted(spark, sf, "registry"), "version", "seq")


_REG = "SELECT version, bool_or(is_production) AS is_production FROM registry GROUP BY version"


def registry(spark, sf):
    return A.upsert_non_null(adapted(spark, sf, "registry"), "version", "seq")


@query("log3_promote", with_inputs("registry", f"""SELECT version, version = 'v4' AS is_production,
  CASE WHEN version = 'v4' THEN epoch_us(TIMESTAMP '{NOW}') END AS deployed_us FROM reg""", reg=_REG))
def promote(spark, sf):
    return A.promote(registry(spark, sf), "v4", at(NOW)).select(
        "version", "is_production", F.unix_micros("deployed_at").alias("deployed_us"))


@query("log3_promote_missing", with_inputs("registry", "SELECT version, false AS is_production FROM reg", reg=_REG))
def promote_missing(spark, sf):
    return A.promote(registry(spark, sf), "v99", at(NOW)).select("version", "is_production")


@query("log4_production_model", with_inputs("registry", "SELECT version FROM reg WHERE is_production", reg=_REG))
def production_model(spark, sf):
    return A.production_model(registry(spark, sf)).select("version")


@query("log5_purge_count", with_inputs("analyses", f"""SELECT count_if(created_at < TIMESTAMP '{LOG_NOW}' - INTERVAL 10 DAY) AS purged,
  count_if(created_at >= TIMESTAMP '{LOG_NOW}' - INTERVAL 10 DAY) AS kept FROM analyses"""))
def purge_count(spark, sf):
    return A.purge_count(adapted(spark, sf, "analyses"), at(LOG_NOW), 10)


@query("log5_purge", with_inputs("analyses", f"SELECT event_id FROM analyses WHERE created_at >= TIMESTAMP '{LOG_NOW}' - INTERVAL 10 DAY"))
def purge(spark, sf):
    return A.purge_older_than(adapted(spark, sf, "analyses"), at(LOG_NOW), 10).select("event_id")


@query("ag2_analysis_stats", with_inputs("analyses", """SELECT count(*) AS total_logged, count_if(label = 'suspicious') AS suspicious_count,
  count_if(label = 'malicious') AS malicious_count, epoch_us(max(created_at)) AS latest_us FROM analyses"""))
def analysis_stats(spark, sf):
    stats = A.analysis_stats(adapted(spark, sf, "analyses"))
    return stats.withColumn("latest_us", F.unix_micros("latest_analysis_at")).drop("latest_analysis_at")


@query("ag3_top_malicious", with_inputs("analyses", """SELECT lower(domain) AS domain, count(*) AS n FROM analyses WHERE label = 'malicious'
  GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10"""))
def top_malicious(spark, sf):
    return A.top_malicious(A.log_rows(adapted(spark, sf, "analyses")))


@query("tk1_recent_analyses", with_inputs("analyses", """SELECT event_id, domain, label FROM analyses WHERE label = 'suspicious'
  ORDER BY created_at DESC, event_id LIMIT 50"""))
def recent_analyses(spark, sf):
    return A.recent_analyses(adapted(spark, sf, "analyses"), 50, "suspicious", "event_id").select("event_id", "domain", "label")


@query("tk1_recent_all_labels", with_inputs("analyses", "SELECT event_id, domain, label FROM analyses ORDER BY created_at DESC, event_id LIMIT 500"))
def recent_all(spark, sf):
    return A.recent_analyses(adapted(spark, sf, "analyses"), A.MAX_RECENT, None, "event_id").select("event_id", "domain", "label")


_ENTRIES = f"SELECT *, cached_at + {_TTL} AS expires_at FROM cache_sets"


def entries(spark, sf):
    return adapted(spark, sf, "cache_sets").withColumn("expires_at", L.expiry(F.col("cached_at"), F.col("label")))


@query("ag13_cache_stats", with_inputs("cache_sets", f"""SELECT ns, count_if(expires_at > t) AS live, count_if(expires_at <= t) AS expired,
  max(CASE WHEN expires_at > t THEN floor((epoch_us(expires_at) - epoch_us(t)) / 1000000)::BIGINT ELSE -2 END) AS longest_ttl
  FROM (SELECT *, TIMESTAMP '{NOW}' AS t FROM entries) GROUP BY ns""", entries=_ENTRIES))
def cache_stats(spark, sf):
    return A.cache_stats(entries(spark, sf), at(NOW))


@query("log6_expire_cache", with_inputs("cache_sets", f"SELECT seq, ns FROM entries WHERE expires_at > TIMESTAMP '{NOW}'", entries=_ENTRIES))
def expire_cache(spark, sf):
    return A.expire_cache(entries(spark, sf), at(NOW)).select("seq", "ns")


@query("log6_flush_network", with_inputs("cache_sets", "SELECT seq, ns FROM cache_sets WHERE ns = 'result'"))
def flush_network(spark, sf):
    return A.flush_cache(adapted(spark, sf, "cache_sets"), "network").select("seq", "ns")


@query("log6_flush_domain", with_inputs("cache_sets", "SELECT seq FROM cache_sets WHERE domain <> 'h7.com'"))
def flush_domain(spark, sf):
    return A.flush_cache(adapted(spark, sf, "cache_sets"), "domain", "H7.com").select("seq")


_GOOD = "SELECT * FROM feedback WHERE system_label <> 'odd' AND user_verdict <> 'nonsense'"


def feedback(spark, sf):
    return adapted(spark, sf, "feedback").where("system_label <> 'odd' AND user_verdict <> 'nonsense'")


@query("ag14_feedback_summary", with_inputs("feedback", "SELECT system_label, user_verdict, count(*) AS n FROM good GROUP BY 1, 2", good=_GOOD))
def feedback_summary(spark, sf):
    return A.feedback_summary(feedback(spark, sf))


@query("ag14_feedback_rollup", with_inputs("feedback", """SELECT system_label, user_verdict, count(*) AS n, count_if(user_verdict = 'false_positive') AS n_false_positive,
  (GROUPING_ID(system_label, user_verdict))::BIGINT AS level, round(count_if(user_verdict = 'false_positive') / count(*), 9) AS false_positive_rate
  FROM good GROUP BY ROLLUP (system_label, user_verdict)""", good=_GOOD))
def feedback_rollup(spark, sf):
    return rounded(A.feedback_summary(feedback(spark, sf), rollup=True), ["false_positive_rate"])


@query("jn11_feedback_vs_verdict", with_inputs("feedback analyses", """SELECT f.event_id, c.label AS current_label, c.label <> f.system_label AS label_changed
  FROM good f LEFT JOIN cur c ON lower(f.domain) = c.domain""", good=_GOOD, cur=_CURRENT))
def feedback_vs_verdict(spark, sf):
    return A.feedback_vs_verdict(feedback(spark, sf), current(spark, sf)).select("event_id", "current_label", "label_changed")


@query("jn10_registry_mismatch", with_inputs("analyses registry", """SELECT event_id, model_version FROM analyses
  WHERE model_version NOT IN (SELECT version FROM reg WHERE is_production)""", reg=_REG))
def registry_mismatch(spark, sf):
    return A.registry_mismatch(adapted(spark, sf, "analyses"), registry(spark, sf)).select("event_id", "model_version")


# --- metrics -----------------------------------------------------------------

_CELLS = """count_if(score < {t} AND y = 0) AS tn, count_if(score >= {t} AND y = 0) AS fp,
  count_if(score < {t} AND y = 1) AS fn, count_if(score >= {t} AND y = 1) AS tp"""


def _div(a, b):
    return f"round(CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b}) END, 9)"


_RATES = f"""{_div('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {_div('tp', 'tp + fp')} AS precision_score,
  {_div('tp', 'tp + fn')} AS recall_score, {_div('2 * tp', '2 * tp + fp + fn')} AS f1_score,
  {_div('fp', 'fp + tn')} AS false_positive_rate, {_div('fn', 'fn + tp')} AS false_negative_rate,
  {_div('tp', 'tp + fn')} AS true_positive_rate, {_div('tn', 'tn + fp')} AS specificity,
  tn + fp + fn + tp AS test_samples, tp + fn AS positives_in_test, tn + fp AS negatives_in_test"""
RATE_NAMES = ["accuracy", "precision_score", "recall_score", "f1_score", "false_positive_rate",
              "false_negative_rate", "true_positive_rate", "specificity", "auc_roc", "pr_auc"]


def _cells_cte(by=""):
    return f"SELECT {by + ', ' if by else ''}{_CELLS.format(t=0.5)} FROM scored {'GROUP BY ' + by if by else ''}"


def _areas_sql(by=""):
    keys = by + ", " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""SELECT {keys}round(sum(neg * (2 * (cp - pos) + pos)) / (2.0 * sum(pos) * sum(neg)), 9)::DOUBLE AS auc_roc,
      round(sum(pos * cp::DOUBLE / (cp + cn)) / sum(pos), 9) AS pr_auc FROM (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn FROM
      (SELECT {keys}score, count_if(y = 1) AS pos, count_if(y = 0) AS neg FROM scored GROUP BY {keys}score)
      WINDOW w AS ({part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) {'GROUP BY ' + by if by else ''}"""


@query("ag4_confusion", with_inputs("scored", "SELECT * FROM c", c=_cells_cte()))
def confusion(spark, sf):
    return M.confusion(adapted(spark, sf, "scored"))


@query("ag4_confusion_by_version_fold", with_inputs("scored", "SELECT * FROM c", c=_cells_cte("model_version, fold")))
def confusion_by(spark, sf):
    return M.confusion(adapted(spark, sf, "scored"), by=["model_version", "fold"])


@query("ag5_binary_metrics", with_inputs("scored", f"SELECT *, {_RATES} FROM c", c=_cells_cte("model_version")))
def binary_metrics(spark, sf):
    return rounded(M.binary_metrics(adapted(spark, sf, "scored"), by=["model_version"]), RATE_NAMES)


@query("wn3_score_curve", with_inputs("scored", """SELECT score, pos, neg, (sum(pos) OVER w)::BIGINT AS cum_pos, (sum(neg) OVER w)::BIGINT AS cum_neg FROM
  (SELECT score, count_if(y = 1) AS pos, count_if(y = 0) AS neg FROM scored GROUP BY score) WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)"""))
def score_curve(spark, sf):
    return M.score_curve(adapted(spark, sf, "scored"))


@query("ag6_roc_auc", with_inputs("scored", "SELECT auc_roc FROM a", a=_areas_sql()))
def roc_auc(spark, sf):
    return rounded(M.curve_metrics(adapted(spark, sf, "scored")), RATE_NAMES).select("auc_roc")


@query("ag7_pr_auc_by_version", with_inputs("scored", "SELECT model_version, pr_auc FROM a", a=_areas_sql("model_version")))
def pr_auc(spark, sf):
    return rounded(M.curve_metrics(adapted(spark, sf, "scored"), ["model_version"]), RATE_NAMES).select("model_version", "pr_auc")


_SWEEP = " UNION ALL ".join(
    f"SELECT {t}::DOUBLE AS threshold, {_div('tp', 'tp + fp')} AS precision, {_div('tp', 'tp + fn')} AS recall,"
    f" {_div('2 * tp', '2 * tp + fp + fn')} AS f1, {_div('fp', 'fp + tn')} AS fpr FROM (SELECT {_CELLS.format(t=t)} FROM scored)"
    for t in M.SWEEP)


@query("ag8_threshold_sweep", with_inputs("scored", _SWEEP))
def threshold_sweep(spark, sf):
    return rounded(M.threshold_sweep(adapted(spark, sf, "scored")), ["precision", "recall", "f1", "fpr"])


@query("ag9_tier_breakdown", with_inputs("scored", """SELECT model_version, count_if(score < 0.5) AS safe, count_if(score >= 0.5 AND score < 0.8) AS suspicious,
  count_if(score >= 0.8) AS malicious FROM scored GROUP BY model_version"""))
def tier_breakdown(spark, sf):
    return M.tier_breakdown(adapted(spark, sf, "scored"), ["model_version"])


_EVAL = dict(c=_cells_cte("model_version"), a=_areas_sql("model_version"))
_REPORT = f"SELECT c.*, {_RATES}, auc_roc, pr_auc FROM c JOIN a ON c.model_version = a.model_version"


@query("ag10_check_targets", with_inputs("scored", """SELECT model_version, 'auc_roc' AS metric, auc_roc AS value, 0.95::DOUBLE AS target, auc_roc >= 0.95 AS passed FROM r
  UNION ALL SELECT model_version, 'f1_score', f1_score, 0.9, f1_score >= 0.9 FROM r
  UNION ALL SELECT model_version, 'false_positive_rate', false_positive_rate, 0.02, false_positive_rate <= 0.02 FROM r""", **_EVAL, r=_REPORT))
def check_targets(spark, sf):
    report = M.evaluate(adapted(spark, sf, "scored"), by=["model_version"])
    return rounded(M.check_targets(report, ["model_version"]), ["value"])


@query("ml13_evaluate", with_inputs("scored", """SELECT r.*, safe, suspicious, malicious FROM r JOIN (SELECT model_version, count_if(score < 0.5) AS safe,
  count_if(score >= 0.5 AND score < 0.8) AS suspicious, count_if(score >= 0.8) AS malicious FROM scored GROUP BY 1) t ON t.model_version = r.model_version""", **_EVAL, r=_REPORT))
def evaluate(spark, sf):
    return rounded(M.evaluate(adapted(spark, sf, "scored"), by=["model_version"]), RATE_NAMES)


@query("ag11_cv_summary", with_inputs("scored", """SELECT count(*) AS folds, round(avg(auc_roc), 6) AS auc_mean, round(stddev_pop(auc_roc), 6) AS auc_std, round(avg(f1_score), 6) AS f1_mean,
  round(stddev_pop(f1_score), 6) AS f1_std, round(avg(false_positive_rate), 6) AS fpr_mean, round(stddev_pop(false_positive_rate), 6) AS fpr_std FROM r""",
    c=_cells_cte("fold"), a=_areas_sql("fold"), r=_REPORT.replace("model_version", "fold")))
def cv_summary(spark, sf):
    out = M.cv_summary(M.evaluate(adapted(spark, sf, "scored"), by=["fold"]))
    return rounded(out, [c for c in out.columns if c != "folds"], 6)


@query("ag12_phase_delta", with_inputs("scored", "SELECT fold, " + ", ".join(
    f"round(any_value({n}) FILTER (model_version = 'vO') - any_value({n}) FILTER (model_version = 'vF'), 6) AS delta_{n}"
    for n in ("auc_roc", "f1_score", "false_positive_rate", "accuracy")) + " FROM r GROUP BY fold",
    c=_cells_cte("model_version, fold"), a=_areas_sql("model_version, fold"),
    r=f"SELECT c.*, {_RATES}, auc_roc, pr_auc FROM c JOIN a ON c.model_version = a.model_version AND c.fold = a.fold"))
def phase_delta(spark, sf):
    report = M.evaluate(adapted(spark, sf, "scored"), by=["model_version", "fold"])
    old, new = (report.where(F.col("model_version") == v).drop("model_version") for v in ("vF", "vO"))
    out = M.phase_delta(old, new, ["fold"])
    return rounded(out, [c for c in out.columns if c != "fold"], 6)


@query("sc1_score_bands", with_inputs("scored", """SELECT l_orderkey, l_linenumber, CASE WHEN score >= 0.8 THEN 'malicious' WHEN score >= 0.5 THEN 'suspicious' ELSE 'safe' END AS label,
  CASE WHEN greatest(score, 1 - score) >= 0.8 THEN 'high' WHEN greatest(score, 1 - score) >= 0.65 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN score <= 0.15 OR score >= 0.85 THEN 'high' WHEN score <= 0.35 OR score >= 0.65 THEN 'medium' ELSE 'low' END AS confidence_by_distance,
  CASE WHEN score >= 0.8 THEN 'alert' WHEN score >= 0.5 THEN 'caution' ELSE 'silent' END AS tier, score >= 0.5 AS notify,
  CASE WHEN score >= 0.5 THEN 900 ELSE 3600 END AS ttl, round(least(greatest(score * 1.4 - 0.2, 0), 1), 4) AS clamped FROM scored"""))
def score_bands(spark, sf):
    s = F.col("score")
    label = S.score_to_label(s)
    return adapted(spark, sf, "scored").select(
        "l_orderkey", "l_linenumber", label.alias("label"), S.score_to_confidence(s).alias("confidence"),
        S.score_to_confidence(s, "distance").alias("confidence_by_distance"), S.tier_for_score(s).alias("tier"),
        S.should_notify(s).alias("notify"), S.ttl_for_label(label).alias("ttl"),
        F.round(S.clamp01(s * 1.4 - 0.2), 4).alias("clamped"))
