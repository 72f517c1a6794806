"""Queries over scoring with an ensemble given as data and over reasons."""

from __future__ import annotations

import hashlib
import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.operators import bulk as B
from wardlight.operators import encode as E
from wardlight.operators import ensembles as N
from wardlight.operators import explain as X
from wardlight.operators import hooks as K
from wardlight.operators.assemble import assemble, features_array
from wardlight.operators.lexical import structural_features
from wardlight.operators.lookups import known_lookup, known_verdict
from wardlight.plans import ducktext as D
from wardlight.plans.auditing import _KNOWN, _TTL, NOW, at, known
from wardlight.plans.featuring import _ASSET_CTES, _INPUTS, _NET, _PAIRS, as_of, assembled, token_rows, whois_obs
from wardlight.plans.parsing import HOSTS, PARTED
from wardlight.plans.registry import query, with_inputs
from wardlight.reasons import RULES
from wardlight.schemas import FEATURE_NAMES, NETWORK_FEATURES
from wardlight.session import written_once
from wardlight.sources.adapters import adapted
from wardlight.sources.writers import load_vocab, save_vocab

INF = 1e18
# A small demonstration ensemble: (tree, leaf, feature, low, high, value).
LEAVES = [
    (0, 0, "tld_is_suspicious", 0.0, 1.0, -0.75), (0, 1, "tld_is_suspicious", 1.0, 2.0, 1.0),
    (1, 0, "num_phishing_keywords", 0.0, 1.0, -0.5), (1, 1, "num_phishing_keywords", 1.0, INF, 0.25),
    (1, 1, "contains_brand_name", 0.0, 1.0, 0.25), (1, 2, "num_phishing_keywords", 1.0, INF, 1.5),
    (1, 2, "contains_brand_name", 1.0, 2.0, 1.5), (2, 0, "domain_length", 0.0, 20.0, -0.25),
    (2, 1, "domain_length", 20.0, 30.0, 0.25), (2, 2, "domain_length", 30.0, INF, 0.75),
    (3, 0, "is_typosquat_candidate", 1.0, 2.0, 1.25), (3, 1, "num_digits", 4.0, INF, 0.5),
    (3, 1, "is_typosquat_candidate", 0.0, 1.0, 0.5),
]
LEAF_SCHEMA = "tree int, leaf int, feature string, low double, high double, value double"


def leaf_table(spark) -> DataFrame:
    return spark.createDataFrame(LEAVES, LEAF_SCHEMA)


def _leaf_sql() -> str:
    leaves: dict = {}
    for tree, leaf, feature, low, high, value in LEAVES:
        leaves.setdefault((tree, leaf), (value, []))[1].append(f"{feature} >= {low} AND {feature} < {high}")
    return " + ".join(f"CASE WHEN {' AND '.join(b)} THEN {v} ELSE 0 END" for v, b in leaves.values())


# A node table over the full 48-feature vector: (tree, node, feature, threshold, left, right, value, weight, cover).
_F = {n: i for i, n in enumerate(FEATURE_NAMES)}
NODES = [
    (0, 0, _F["tld_is_suspicious"], 0.5, 1, 2, 0.1, 1.0, 1000), (0, 1, -1, 0.0, -1, -1, -0.4, 1.0, 690),
    (0, 2, -1, 0.0, -1, -1, 1.2, 1.0, 310),
    (1, 0, _F["num_phishing_keywords"], 0.5, 1, 2, 0.0, 0.5, 1000), (1, 1, -1, 0.0, -1, -1, -1.0, 0.5, 500),
    (1, 2, _F["contains_brand_name"], 0.5, 3, 4, 1.0, 0.5, 500), (1, 3, -1, 0.0, -1, -1, 0.5, 0.5, 400),
    (1, 4, -1, 0.0, -1, -1, 3.0, 0.5, 100),
    (2, 0, _F["domain_length"], 18.5, 1, 2, 0.2, 1.0, 1000), (2, 1, -1, 0.0, -1, -1, -0.2, 1.0, 510),
    (2, 2, _F["num_digits"], 3.5, 3, 4, 0.6, 1.0, 490), (2, 3, -1, 0.0, -1, -1, 0.4, 1.0, 330),
    (2, 4, -1, 0.0, -1, -1, 1.0, 1.0, 160),
    (3, 0, _F["typosquat_distance"], 2.5, 1, 2, 0.1, 1.0, 1000), (3, 1, -1, 0.0, -1, -1, 0.9, 1.0, 110),
    (3, 2, _F["has_mx_record"], 0.5, 3, 4, 0.0, 1.0, 890), (3, 3, -1, 0.0, -1, -1, 0.15, 1.0, 600),
    (3, 4, -1, 0.0, -1, -1, -0.3, 1.0, 290),
    (4, 0, _F["whois_country"], 9.5, 1, 2, 0.05, 1.0, 1000), (4, 1, -1, 0.0, -1, -1, -0.35, 1.0, 380),
    (4, 2, _F["tld"], 1.5, 3, 4, 0.3, 1.0, 620), (4, 3, -1, 0.0, -1, -1, 0.2, 1.0, 500),
    (4, 4, _F["domain_length"], 24.5, 5, 6, 0.7, 1.0, 120), (4, 5, -1, 0.0, -1, -1, 0.6, 1.0, 70),
    (4, 6, -1, 0.0, -1, -1, 0.85, 1.0, 50),
]


def node_table(spark) -> DataFrame:
    return spark.createDataFrame([(*n[:-1], float(n[-1])) for n in NODES], N.NODE_SCHEMA)


_NODE = {(t, n): rest for t, n, *rest in NODES}


def _mean_sql(t: int, n: int, asked: frozenset) -> str:
    """The tree's answer below a node when only the features in ``asked`` are looked at."""
    f, cut, left, right, value, weight, cover = _NODE[t, n]
    if left < 0:
        return f"{value * weight}e0"
    a, b = _mean_sql(t, left, asked), _mean_sql(t, right, asked)
    if f in asked:
        return f"CASE WHEN {FEATURE_NAMES[f]} <= {cut} THEN {a} ELSE {b} END"
    return f"({_NODE[t, left][-1]}e0 / {cover}e0 * ({a}) + {_NODE[t, right][-1]}e0 / {cover}e0 * ({b}))"


def _trees() -> dict[int, set[int]]:
    return {t: {f for s, _, f, *_ in NODES if s == t and f >= 0} for t, *_ in NODES}


def _tree_sql() -> str:
    """Sum over trees of the reached leaf."""
    return " + ".join(_mean_sql(t, 0, frozenset(used)) for t, used in _trees().items())


def _push_sql(name: str) -> str:
    """Shapley value of a feature, by its gain over every subset of its tree's other features."""
    f, terms = FEATURE_NAMES.index(name), []
    for t, used in _trees().items():
        for size in range(len(used)) if f in used else ():
            weight = math.factorial(size) * math.factorial(len(used) - size - 1) / math.factorial(len(used))
            for others in itertools.combinations(sorted(used - {f}), size):
                asked = frozenset(others)
                terms.append(f"{weight}e0 * (({_mean_sql(t, 0, asked | {f})}) - ({_mean_sql(t, 0, asked)}))")
    return " + ".join(terms)


@query("ml10_score_leaf_boxes", with_inputs("raw_hosts", f"""SELECT row_id, round(m, 9)::DOUBLE AS margin, round(1 / (1 + exp(-m)), 9) AS score
  FROM (SELECT row_id, {_leaf_sql()} AS m FROM lex)""", hosts=HOSTS, parted=PARTED, lex=D.structural("parted", "row_id")))
def score_leaf_boxes(spark, sf):
    scored = N.score_leaf_boxes(structural_features(adapted(spark, sf, "raw_hosts")), leaf_table(spark))
    return scored.select("row_id", F.round("margin", 9).alias("margin"), F.round("score", 9).alias("score"))


CONTEXT = ["matched_keywords", "brand", "similar_domain"]


def vectors(spark, sf) -> DataFrame:
    """Assembled hosts with context columns and the numeric vector."""
    wide = assembled(spark, sf, structural_fn=lambda d: structural_features(d, context=True), extra=CONTEXT)
    return numeric(spark, sf, wide)


def saved_vocab(spark, sf) -> DataFrame:
    """The vocabulary that belongs to the model: fitted on all raw hosts and saved once an application, then only read."""
    name = "vocab-" + hashlib.sha256(sf.encode()).hexdigest()[:16]
    path = written_once(spark, name, lambda path: save_vocab(E.fit_vocab(token_rows(spark, sf)), path))
    return load_vocab(spark, path)


def numeric(spark, sf, wide: DataFrame) -> DataFrame:
    """The 48 features as an array, text features by the codes of the saved vocabulary."""
    coded = E.apply_vocab(wide.withColumn("tld_text", F.col("tld")), saved_vocab(spark, sf))
    return features_array(coded).drop("tld", "whois_country").withColumnRenamed("tld_text", "tld")


def _code_sql(feature: str) -> str:
    token = f"coalesce(nullif(lower(trim(net.{feature})), ''), 'unknown')"
    known = f"(SELECT max(code) FROM vocab WHERE feature = '{feature}' AND token = {token})"
    return f"coalesce({known}, (SELECT code FROM vocab WHERE feature = '{feature}' AND token = 'unknown')) AS {feature}"


# The assembled features, and the same with codes in place of texts.
_CODED_INPUTS = f"{_INPUTS} raw_hosts"
_CODED = dict(
    **_ASSET_CTES, net=_NET, vhosts=_PAIRS["hosts"], vparted=D.parts("vhosts"),
    lexraw=_PAIRS["lexraw"].replace("parted", "vparted"), tokens=_PAIRS["tokens"], vocab=_PAIRS["vocab"],
    coded=f"SELECT * REPLACE ({_code_sql('tld')}, {_code_sql('whois_country')}) FROM net")


@query("ml9_predict_batch", with_inputs(_CODED_INPUTS, f"""SELECT row_id, round(s, 4) AS score,
  CASE WHEN s >= 0.8 THEN 'malicious' WHEN s >= 0.5 THEN 'suspicious' ELSE 'safe' END AS label,
  CASE WHEN greatest(s, 1 - s) >= 0.8 THEN 'high' WHEN greatest(s, 1 - s) >= 0.65 THEN 'medium' ELSE 'low' END AS confidence
  FROM (SELECT row_id, 1 / (1 + exp(-({_tree_sql()}))) AS s FROM coded)""", **_CODED))
def predict_batch(spark, sf):
    scored = N.score_nodes(numeric(spark, sf, assembled(spark, sf)), node_table(spark))
    return N.verdict_columns(scored).select("row_id", "score", "label", "confidence")


_USED = sorted({FEATURE_NAMES[f] for _, _, f, *_ in NODES if f >= 0})


@query("ml11_contributions", with_inputs(_CODED_INPUTS, " UNION ALL ".join(
    f"SELECT row_id, '{n}' AS feature, round({_push_sql(n)}, 9)::DOUBLE AS contribution FROM coded" for n in _USED), **_CODED))
def contributions(spark, sf):
    scored = N.score_nodes(numeric(spark, sf, assembled(spark, sf)), node_table(spark), contributions=True)
    return (N.contributions_long(scored, ["row_id"]).where(F.col("feature").isin(*_USED))
            .select("row_id", "feature", F.round("contribution", 9).alias("contribution")))


@query("ml11_additivity", with_inputs(_CODED_INPUTS, f"SELECT row_id, round({_tree_sql()}, 6)::DOUBLE AS total FROM coded", **_CODED))
def additivity(spark, sf):
    """Bias plus contributions, against the margin of the trees."""
    scored = N.score_nodes(numeric(spark, sf, assembled(spark, sf)), node_table(spark), contributions=True)
    total = F.aggregate("contributions", F.col("bias"), lambda a, c: a + c)
    return scored.select("row_id", F.round(total, 6).alias("total"))


# --- reasons over a long contribution table ----------------------------------

_NAMES = D.words(FEATURE_NAMES)
_PUSHED = f"""SELECT row_key, {_NAMES}[feature_no + 1] AS feature, feature_no, max(value) AS value, max(contribution) AS contribution
  FROM pushes GROUP BY row_key, feature_no"""
_RANKED = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY contribution DESC, feature_no) AS rank FROM
  (SELECT *, sum(greatest(contribution, 0)) OVER (PARTITION BY row_key) AS total,
    coalesce(max(value) FILTER (feature = 'network_features_available') OVER (PARTITION BY row_key) >= 0.5, true) AS net FROM pushed)
  WHERE contribution > 0 AND contribution / total >= 0.01 AND (net OR NOT list_contains({D.words(NETWORK_FEATURES)}, feature))) WHERE rank <= 12"""


def _gate_sql(gate: str) -> str:
    kind, *b = gate.split()
    n = "round_even(value, 0)"
    if kind in ("on", "off"):
        return "value >= 0.5" if kind == "on" else "value < 0.5"
    if kind == "real":
        return f"value >= {b[0]}"
    return f"{n} BETWEEN {b[0]} AND {b[1]}" if len(b) > 1 else f"{n} >= {b[0]}"


def _case_sql(pick) -> str:
    arms = []
    for feature, category, gate, text in RULES:
        if "{" in text.replace("{n}", ""):
            continue
        quoted = text.replace("'", "''")
        arms.append(f"WHEN feature = '{feature}' AND {_gate_sql(gate)} THEN "
                    + (f"replace('{quoted}', '{{n}}', round_even(value, 0)::BIGINT::VARCHAR)" if pick == "text" else f"'{category}'"))
    return "CASE " + " ".join(arms) + " END"


_TOLD = f"SELECT *, {_case_sql('text')} AS text, {_case_sql('category')} AS category FROM ranked"
_BEST = """SELECT row_key, row_number() OVER (PARTITION BY row_key ORDER BY rank) AS position, feature, text FROM
  (SELECT *, row_number() OVER (PARTITION BY row_key, category ORDER BY rank) AS n FROM told WHERE text IS NOT NULL) WHERE n = 1"""


def pushed(spark, sf) -> DataFrame:
    names = F.array(*[F.lit(n) for n in FEATURE_NAMES])
    return (adapted(spark, sf, "pushes").groupBy("row_key", "feature_no")
            .agg(F.max("value").alias("value"), F.max("contribution").alias("contribution"))
            .select("row_key", F.get(names, F.col("feature_no")).alias("feature"), "value", "contribution"))


@query("wn2_rank_contributions", with_inputs("pushes", "SELECT row_key, feature, rank::INT AS rank FROM ranked", pushed=_PUSHED, ranked=_RANKED))
def rank_contributions(spark, sf):
    return X.rank_contributions(pushed(spark, sf)).select("row_key", "feature", "rank")


@query("sc7_reason_texts", with_inputs("pushes", "SELECT row_key, feature, text FROM told WHERE text IS NOT NULL", pushed=_PUSHED, ranked="SELECT * FROM pushed", told=_TOLD))
def reason_texts(spark, sf):
    return X.render_long(pushed(spark, sf)).where("text IS NOT NULL").select("row_key", "feature", "text")


@query("wn4_explain_top_reasons", with_inputs("pushes", "SELECT row_key, position::INT AS position, feature, text FROM best WHERE position <= 3",
                                              pushed=_PUSHED, ranked=_RANKED, told=_TOLD, best=_BEST))
def explain_top(spark, sf):
    return X.explain_long(pushed(spark, sf))


@query("sc10_alternative_texts", with_inputs("pushes", """SELECT row_key, feature, replace(feature, '_', ' ') || ' (' || value::BIGINT::VARCHAR || ') raised the score' AS text
  FROM pushed WHERE value IS NOT NULL""", pushed=_PUSHED))
def alternative_texts(spark, sf):
    text = X.alternative_text(F.col("feature"), F.col("value").cast("long").cast("string"))
    return pushed(spark, sf).select("row_key", "feature", text.alias("text")).where("text IS NOT NULL")


def _wide_sql(ctx: bool) -> str:
    arrows = {n: _push_sql(n) for n in _USED}
    longs = " UNION ALL ".join(
        f"SELECT row_id AS row_key, '{n}' AS feature, {i} AS feature_no, {n}::DOUBLE AS value, {arrows[n]} AS contribution, network_features_available AS avail FROM coded"
        for i, n in enumerate(FEATURE_NAMES) if n in _USED)
    return longs


@query("ml12_explain", with_inputs(_CODED_INPUTS, """SELECT row_id, label, coalesce(reasons, '') AS reasons FROM
  (SELECT row_id, CASE WHEN s >= 0.8 THEN 'malicious' WHEN s >= 0.5 THEN 'suspicious' ELSE 'safe' END AS label FROM
    (SELECT row_id, 1 / (1 + exp(-({tree}))) AS s FROM coded)) v
  LEFT JOIN (SELECT row_key, string_agg(text, '|' ORDER BY position) AS reasons FROM best WHERE position <= 3 GROUP BY row_key) b
    ON b.row_key = row_id AND label <> 'safe'""".replace("{tree}", _tree_sql()), **_CODED, pushed=_wide_sql(False),
    ranked=_RANKED.replace("coalesce(max(value) FILTER (feature = 'network_features_available') OVER (PARTITION BY row_key) >= 0.5, true)", "avail >= 0.5"),
    told=_TOLD, best=_BEST))
def explain(spark, sf):
    scored = N.score_nodes(numeric(spark, sf, assembled(spark, sf)), node_table(spark), contributions=True)
    out = X.explain(N.verdict_columns(scored))
    return out.select("row_id", "label", F.array_join("reasons", "|").alias("reasons"))


@query("ml12_explain_with_context")
def explain_with_context(spark, sf):
    scored = N.verdict_columns(N.score_nodes(vectors(spark, sf), node_table(spark), contributions=True))
    out = X.explain(scored, context=True)
    return out.select("row_id", "score", "label", "confidence", F.array_join("reasons", "|").alias("reasons"))


def flagship(spark, sf, with_reasons: bool = True) -> DataFrame:
    """Curated list first, then features, score, label and reasons."""
    columns = ["row_id", "domain", "score", "label", "confidence", "reasons"]
    hosts = adapted(spark, sf, "asset_hosts").drop("label")
    curated = known(spark, sf)
    routed = known_lookup(hosts, curated)
    answered = known_verdict(routed.where("known IS NOT NULL")).select(*columns)
    wide = assemble(routed.where("known IS NULL").drop("known"), adapted(spark, sf, "dns_obs"), whois_obs(spark, sf), as_of(), tie="obs_id")
    scored = N.verdict_columns(N.score_nodes(numeric(spark, sf, wide), node_table(spark), contributions=with_reasons))
    if not with_reasons:
        columns.remove("reasons")
        return answered.drop("reasons").unionByName(scored.select(*columns))
    return answered.unionByName(X.explain(scored).select(*columns))


_ANSWERED = """SELECT row_id, domain, CASE WHEN e.verdict = 'safe' THEN 0.0 ELSE 1.0 END::DOUBLE AS score,
  CASE WHEN e.verdict = 'safe' THEN 'safe' ELSE 'malicious' END AS label, 'high' AS confidence FROM req JOIN active ON mk = k"""


def _flagship_sql() -> str:
    return with_inputs("asset_hosts known dns_obs whois_obs raw_hosts", f"""SELECT * FROM answered UNION ALL SELECT net.row_id, net.domain, round(s, 4),
      CASE WHEN s >= 0.8 THEN 'malicious' WHEN s >= 0.5 THEN 'suspicious' ELSE 'safe' END,
      CASE WHEN greatest(s, 1 - s) >= 0.8 THEN 'high' WHEN greatest(s, 1 - s) >= 0.65 THEN 'medium' ELSE 'low' END
      FROM (SELECT *, 1 / (1 + exp(-({_tree_sql()}))) AS s FROM coded) net WHERE row_id NOT IN (SELECT row_id FROM answered)""",
      **_KNOWN, **_CODED, answered=_ANSWERED)


@query("analyze_hosts", _flagship_sql())
def analyze_hosts(spark, sf):
    """The whole bulk analysis without the reason texts (as in bulk answers)."""
    return flagship(spark, sf, with_reasons=False)


_BULK = dict(
    live=f"""SELECT domain AS ld, label AS cl FROM (SELECT * FROM cache_sets WHERE ns = 'result' AND cached_at <= TIMESTAMP '{NOW}'
      QUALIFY row_number() OVER (PARTITION BY domain ORDER BY cached_at DESC, seq DESC) = 1)
      WHERE cached_at + {_TTL} > TIMESTAMP '{NOW}'""",
    modelled=f"SELECT row_id AS model_row, 1 / (1 + exp(-({_tree_sql()}))) AS s FROM coded",
    routed="""SELECT *, CASE WHEN cl IS NOT NULL THEN 'cache' WHEN e IS NOT NULL THEN 'known' ELSE 'model' END AS source
      FROM req LEFT JOIN active ON mk = k LEFT JOIN live ON domain = ld LEFT JOIN modelled ON row_id = model_row""",
    answers="""SELECT row_id AS pos, domain, source,
      (CASE source WHEN 'known' THEN CASE WHEN e.verdict = 'safe' THEN 0 ELSE 1 END WHEN 'model' THEN round(s, 4) END)::DOUBLE AS score,
      CASE source WHEN 'cache' THEN cl WHEN 'known' THEN CASE WHEN e.verdict = 'safe' THEN 'safe' ELSE 'malicious' END
        ELSE CASE WHEN s >= 0.8 THEN 'malicious' WHEN s >= 0.5 THEN 'suspicious' ELSE 'safe' END END AS label,
      CASE source WHEN 'known' THEN 'high' WHEN 'model' THEN
        CASE WHEN greatest(s, 1 - s) >= 0.8 THEN 'high' WHEN greatest(s, 1 - s) >= 0.65 THEN 'medium' ELSE 'low' END END AS confidence
      FROM routed""")
_BULK_INPUTS = "asset_hosts known dns_obs whois_obs raw_hosts cache_sets"


def bulk_answers(spark, sf) -> DataFrame:
    """All hosts as one bulk request."""
    def score(hosts: DataFrame) -> DataFrame:
        wide = assemble(hosts, adapted(spark, sf, "dns_obs"), whois_obs(spark, sf), as_of(), tie="obs_id", asked_only=True)
        return N.verdict_columns(N.score_nodes(numeric(spark, sf, wide), node_table(spark)))

    requests = adapted(spark, sf, "asset_hosts").select(F.col("row_id").alias("pos"), "domain")
    results = adapted(spark, sf, "cache_sets").where("ns = 'result'")
    return B.bulk_analyze(requests, results, known(spark, sf), at(NOW), score)


@query("bulk_analyze", with_inputs(_BULK_INPUTS, "SELECT * FROM answers", **_KNOWN, **_CODED, **_BULK))
def bulk_analyze(spark, sf):
    return bulk_answers(spark, sf).select("pos", "domain", "source", *B.ANSWER)


@query("bulk_rows_to_log", with_inputs(_BULK_INPUTS, f"""SELECT lower(domain) AS domain, source, score, label, confidence,
  TIMESTAMP '{NOW}' AS created_at FROM answers WHERE source <> 'cache' AND score >= 0.5""", **_KNOWN, **_CODED, **_BULK))
def bulk_rows_to_log(spark, sf):
    return B.rows_to_log(bulk_answers(spark, sf), at(NOW))


@query("bulk_rows_to_cache", with_inputs(_BULK_INPUTS, f"""SELECT domain, label, score, TIMESTAMP '{NOW}' AS cached_at
  FROM answers WHERE source <> 'cache'""", **_KNOWN, **_CODED, **_BULK))
def bulk_rows_to_cache(spark, sf):
    rows = B.rows_to_cache(bulk_answers(spark, sf), at(NOW))
    return rows.select("domain", "label", F.get_json_object("payload", "$.score").cast("double").alias("score"), "cached_at")


@query("sc6_analysis_ids", with_inputs("analyses", "SELECT event_id, CASE WHEN score >= 0.5 THEN sha256(lower(domain) || '|' || epoch_us(created_at)::VARCHAR) END AS analysis_id FROM analyses"))
def analysis_ids(spark, sf):
    rows = K.with_analysis_id(adapted(spark, sf, "analyses"))
    return rows.select("event_id", "analysis_id")


@query("udf1_custom_extractor", with_inputs("raw_hosts", """SELECT row_id, length(domain)::INT AS raw_length,
  (length(domain) > 20)::INT AS is_long FROM raw_hosts"""))
def custom_extractor(spark, sf):
    """A caller's per-domain pandas function used as a feature extractor."""
    extract = K.per_domain(_raw_length, "raw_length int, is_long int")
    return extract(adapted(spark, sf, "raw_hosts")).select("row_id", "raw_length", "is_long")


def _raw_length(domains):
    import pandas as pd

    n = domains.str.len()
    return pd.DataFrame({"raw_length": n, "is_long": (n > 20).astype(int)})


@query("udf2_callable_encoder", with_inputs("raw_hosts", "SELECT row_id, length(coalesce(nullif(tld, ''), 'unknown')) * 10 AS code FROM parted", hosts=HOSTS, parted=PARTED))
def callable_encoder(spark, sf):
    from wardlight.plans.parsing import hosts_and_parts

    rows = K.encode_with(hosts_and_parts(spark, sf), "tld", lambda tokens: tokens.str.len() * 10)
    return rows.select("row_id", F.col("tld").cast("long").alias("code"))


@query("udf3_custom_contributions", with_inputs("analyses", """SELECT event_id AS row_key, 1 AS position, 'num_digits' AS feature,
  'The domain name contains an unusual number of digits (' || (event_id % 9)::VARCHAR || ')' AS text FROM analyses WHERE event_id % 9 >= 4"""))
def custom_contributions(spark, sf):
    """A caller's contribution function feeding the standard reason rules."""
    def contributions(df):
        return df.select(F.col("event_id").alias("row_key"), F.lit("num_digits").alias("feature"),
                         (F.col("event_id") % 9).cast("double").alias("value"), F.lit(1.0).alias("contribution"))

    return K.explain_with(adapted(spark, sf, "analyses"), contributions)


@query("udf4_custom_classifier", with_inputs("scored", "SELECT model_version, count(*) AS n, true AS in_range, true AS better_than_chance FROM scored GROUP BY 1"))
def custom_classifier(spark, sf):
    """Any classifier with a probability vector as the scorer: here a logistic regression of the outcome on two columns."""
    from pyspark.ml.classification import LogisticRegression

    from wardlight.operators.learning import with_vector

    rows = adapted(spark, sf, "scored").withColumn("features", F.array(F.col("score"), F.col("fold").cast("double")))
    train = with_vector(rows.where("l_linenumber % 2 = 0")).withColumn("_y", F.col("y").cast("double"))
    model = LogisticRegression(featuresCol="vector", labelCol="_y", maxIter=10).fit(train)
    scored = K.score_with(rows.drop("score"), model)
    gap = F.avg(F.when(F.col("y") == 1, F.col("score"))) - F.avg(F.when(F.col("y") == 0, F.col("score")))
    return scored.groupBy("model_version").agg(
        F.count("*").alias("n"), F.bool_and(F.col("score").between(0, 1)).alias("in_range"), (gap > 0).alias("better_than_chance"))
