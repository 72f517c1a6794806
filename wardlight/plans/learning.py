"""Queries over splits, resampling, training and file round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.operators import clean
from wardlight.operators import encode as E
from wardlight.operators import ensembles as N
from wardlight.operators import learning as L
from wardlight.operators import metrics as M
from wardlight.operators.assemble import build_feature_matrix, features_array
from wardlight.plans.auditing import _EVAL, _REPORT
from wardlight.plans.featuring import _ASSET_CTES, _NET, _PAIRS, assembled, token_rows
from wardlight.plans.parsing import CLEANED, FIRST, PREPARED, cleaned, rounded
from wardlight.plans.registry import query, with_inputs
from wardlight.schemas import CATEGORICAL_FEATURES, CONTINUOUS_FEATURES, FEATURE_NAMES
from wardlight.session import checkpoint, scratch_path, written
from wardlight.sources import readers, writers
from wardlight.sources.adapters import adapted

_ROWS = dict(prepared=PREPARED, cleaned=CLEANED, firsts=FIRST)


def firsts(spark, sf) -> DataFrame:
    return clean.dedupe_first(cleaned(spark, sf))


def _frac(seed: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || domain), 1, 8))::BIGINT / 4294967296.0)"


@query("ml1_stratified_split", with_inputs("labeled", f"SELECT domain, label, {_frac('test-42')} < 0.2 AS is_test FROM firsts", **_ROWS))
def stratified_split(spark, sf):
    return L.stratified_split(firsts(spark, sf)).select("domain", "label", "is_test")


@query("ml1_stratified_split_exact", with_inputs("labeled", f"""SELECT domain, label, row_number() OVER (PARTITION BY label ORDER BY {_frac('test-42')}, domain)
  <= round(0.2 * count(*) OVER (PARTITION BY label)) AS is_test FROM firsts""", **_ROWS))
def stratified_split_exact(spark, sf):
    return L.stratified_split(firsts(spark, sf), exact=True).select("domain", "label", "is_test")


@query("ml2_validation_split", with_inputs("labeled", f"""SELECT domain, {_frac('validation-42')} < 0.1 AS is_validation FROM firsts
  WHERE NOT {_frac('test-42')} < 0.2""", **_ROWS))
def validation_split(spark, sf):
    train = L.stratified_split(firsts(spark, sf)).where("NOT is_test")
    return L.validation_split(train).select("domain", "is_validation")


@query("ml3_kfold", with_inputs("labeled", f"SELECT domain, floor({_frac('fold-42')} * 5)::INT AS fold FROM firsts", **_ROWS))
def kfold(spark, sf):
    return L.kfold(firsts(spark, sf), 5).select("domain", "fold")


@query("ml4_class_weights", with_inputs("labeled", """SELECT domain, round(CASE WHEN label = 1 THEN (SELECT count_if(label = 0) / count_if(label = 1) FROM firsts)
  ELSE 1.0 END, 9)::DOUBLE AS weight FROM firsts""", **_ROWS))
def class_weights(spark, sf):
    return rounded(L.class_weights(firsts(spark, sf)), ["weight"]).select("domain", "weight")


def skewed(spark, sf) -> DataFrame:
    """A set with a rare class: of the positives one residue class is kept."""
    rows = adapted(spark, sf, "scored").withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber", F.round("score", 4)))
    return rows.groupBy("key").agg(
        F.max(F.when((F.col("y") == 1) & (F.col("l_orderkey") % 29 == 0), 1).otherwise(0)).alias("label"),
        F.max("score").alias("score"), F.max("fold").alias("fold"), F.max("model_version").alias("model_version"))


_SKEWED = "SELECT max(CASE WHEN y = 1 AND l_orderkey % 29 = 0 THEN 1 ELSE 0 END) AS label FROM scored GROUP BY l_orderkey, l_linenumber, round(score, 4)"
_PLAN = """SELECT least(z, o) AS n_minority, greatest(z, o) AS n_majority, CASE WHEN o <= z THEN 1 ELSE 0 END AS minority_label,
  round(least(z, o) / (z + o), 9) AS minority_fraction, least(z, o) / (z + o) < 0.1 AS resample, least(5, least(z, o) - 1) AS k_neighbors,
  CASE WHEN least(z, o) / (z + o) < 0.1 THEN trunc(greatest(z, o) * 0.5 - least(z, o))::BIGINT ELSE 0 END AS n_new
  FROM (SELECT count_if(label = 0) AS z, count_if(label = 1) AS o FROM skewed)"""


@query("ml5_oversample_plan", with_inputs("scored", _PLAN, skewed=_SKEWED))
def oversample_plan(spark, sf):
    return rounded(L.oversample_plan(skewed(spark, sf)), ["minority_fraction"])


@query("ml5_oversample_counts", with_inputs("scored", """SELECT label, false AS synthetic, count(*) AS n, true AS in_range FROM skewed GROUP BY label
  UNION ALL SELECT minority_label, true, n_new, true FROM plan""", skewed=_SKEWED, plan=_PLAN))
def oversample_counts(spark, sf):
    made = L.oversample(skewed(spark, sf), key="key", continuous=["score", "fold"], categorical=["model_version"])
    ok = F.col("score").between(0, 1) & F.col("fold").between(0, 4) & F.col("model_version").isin("vF", "vO")
    return made.groupBy("label", "synthetic").agg(F.count("*").alias("n"), F.min(ok).alias("in_range"))


@query("ml5_oversample_matrix", with_inputs("asset_hosts", """SELECT rare AS label, false AS synthetic, count(*) AS n, true AS in_range FROM rows GROUP BY rare
  UNION ALL SELECT 1, true, trunc(count_if(rare = 0) * 0.5 - count_if(rare = 1))::BIGINT, true FROM rows""",
  rows="SELECT domain, CASE WHEN row_id % 13 = 0 THEN 1 ELSE 0 END AS rare FROM asset_hosts"))
def oversample_matrix(spark, sf):
    """All 48 columns of the assembled hosts, one in thirteen of the rare class; new rows stay in its ranges."""
    rows = checkpoint(assembled(spark, sf).withColumn("label", F.when(F.col("row_id") % 13 == 0, 1).otherwise(0)).select(
        "domain", *FEATURE_NAMES, "label"))
    rare = rows.where("label = 1")
    ends = rare.agg(*(f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in CONTINUOUS_FEATURES for n, f in (("lo", F.min), ("hi", F.max))),
                    *(F.collect_set(c).alias(c) for c in CATEGORICAL_FEATURES)).first()  # a row
    ok = F.lit(True)
    for c in CONTINUOUS_FEATURES:
        ok = ok & F.col(c).between(ends[f"lo_{c}"], ends[f"hi_{c}"])
    for c in CATEGORICAL_FEATURES:
        ok = ok & F.col(c).isin(ends[c])
    made = L.oversample(rows)
    return made.groupBy("label", "synthetic").agg(F.count("*").alias("n"), F.bool_and(ok | ~F.col("synthetic")).alias("in_range"))


#: Hosts whose lexical features one task computes: much work on few bytes, so the files' splits are too few.
HOSTS_PER_TASK = 20_000


def hosts_told(spark, sf) -> DataFrame:
    """The assembled hosts, written once, with ``told``: the registration with one host in ten told wrong."""
    full = assembled(spark, sf, per_task=HOSTS_PER_TASK)
    told = ((F.col("whois_privacy_enabled") == 1) != (F.col("row_id") % 10 == 3)).cast("int")
    return written(full.drop("label").withColumn("told", told), "hosts")


def training_rows(spark, sf, include_network: bool = True, full: DataFrame | None = None) -> DataFrame:
    """All 48 features of the hosts as an array, ``label`` from the registration with one host in ten told wrong.

    The vocabulary is fitted on the training part.  Without network columns the matrix holds
    their defaults, as for a first model; the labels are the same.  ``full`` is what
    ``hosts_told`` returned, where it is needed more than once.
    """
    full = hosts_told(spark, sf) if full is None else full
    matrix = full.drop("told") if include_network else assembled(
        spark, sf, per_task=HOSTS_PER_TASK, include_network=False).drop("label")
    matrix = written(matrix.join(full.select("domain", F.col("told").alias("label")), "domain"), "matrix")
    encoded = E.apply_vocab(matrix, E.fit_vocab(L.stratified_split(matrix).where("NOT is_test")))
    return checkpoint(features_array(encoded).select("domain", "features", "label"))


_LABELED = dict(_ASSET_CTES, net=_NET, made="SELECT domain, ((whois_privacy_enabled = 1) <> (row_id % 10 = 3))::INT AS label FROM net")

# Rounds and patience of the training queries but ml6_train_and_evaluate; the operators' defaults are the full recipe.
TRIAL = dict(maxIter=20, patience=5)


@query("ml6_train_and_evaluate")
def train_and_evaluate(spark, sf):
    """The full recipe: folds choose the number of rounds, all training rows are fitted for it, the test part is scored once."""
    rows = L.stratified_split(training_rows(spark, sf))
    nodes, _ = L.train_validated(rows.where("NOT is_test"))
    # scored once: the metrics read the scores several times
    scored = N.score_nodes(rows.where("is_test"), nodes).select(F.col("label").alias("y"), "score")
    return M.evaluate(written(scored, "scores"))


@query("ml6_weighted_patience", with_inputs("asset_hosts dns_obs whois_obs", f"""SELECT part, count(*) AS n, sum(label)::BIGINT AS n_malicious,
  true AS cut_at_lowest, true AS below_base_loss FROM (SELECT label, CASE WHEN {_frac('test-42')} < 0.2 THEN 'test'
    WHEN {_frac('validation-42')} < 0.1 THEN 'validation' ELSE 'train' END AS part FROM made) GROUP BY part""", **_LABELED))
def weighted_patience(spark, sf):
    """Rows of each part; boosting with class weights is cut at the validation part's lowest loss looked at.

    Over all rows the cut model's log loss is below that of the base rate.
    """
    split = checkpoint(L.validation_split(L.stratified_split(training_rows(spark, sf))))
    part = F.when(F.col("is_test"), "test").when(F.col("is_validation"), "validation").otherwise("train")
    rows = split.withColumn("part", part)
    train = L.class_weights(rows.where("part = 'train'"))
    nodes, rounds, losses = L.train_with_patience(train, rows.where("part = 'validation'"), weight="weight", **TRIAL)
    p, y = F.col("score"), F.col("label")
    base = F.avg(y.cast("double"))
    loss = F.avg(-F.log(F.when(y == 1, p).otherwise(1 - p)))
    better = N.score_nodes(rows, nodes).agg((loss < -(base * F.log(base) + (1 - base) * F.log(1 - base))).alias("better")).first()[0]
    lowest = losses[rounds - 1] == min(losses[:rounds + TRIAL["patience"]])
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.sum(y).cast("long").alias("n_malicious"),
                                    F.lit(lowest).alias("cut_at_lowest"), F.lit(better).alias("below_base_loss"))


@query("ml7_cross_validate")
def cross_validate(spark, sf):
    return L.cross_validate(training_rows(spark, sf), 3, **TRIAL)[1]


@query("ml7_fold_facts", with_inputs("asset_hosts dns_obs whois_obs", f"""SELECT floor({_frac('fold-42')} * 3)::INT AS fold, count(*) AS n,
  sum(label)::BIGINT AS n_malicious, true AS rounds_in_range, true AS better_than_chance FROM made GROUP BY 1""", **_LABELED))
def fold_facts(spark, sf):
    folds, _ = L.cross_validate(training_rows(spark, sf), 3, **TRIAL)
    return folds.select(
        "fold", F.col("test_samples").alias("n"), F.col("positives_in_test").alias("n_malicious"),
        F.col("best_round").between(1, TRIAL["maxIter"]).alias("rounds_in_range"), (F.col("auc_roc") > 0.5).alias("better_than_chance"))


def continued(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with network features, a first model without them, the model continued on them)."""
    full = hosts_told(spark, sf)
    plain = L.stratified_split(training_rows(spark, sf, include_network=False, full=full)).where("NOT is_test")
    first = checkpoint(L.model_nodes(L.train_gbt(plain, maxIter=5, maxDepth=3), spark))
    rows = L.stratified_split(training_rows(spark, sf, full=full))
    train = checkpoint(L.validation_split(rows.where("NOT is_test")))
    longer = checkpoint(L.finetune(train.where("NOT is_validation"), first, rounds=20, learning_rate=0.1, depth=3,
                                   held=train.where("is_validation"), patience=5))
    return rows, first, longer


@query("ml8_finetune_delta")
def finetune_delta(spark, sf):
    rows, first, longer = continued(spark, sf)
    test = rows.where("is_test").withColumn("y", F.col("label"))
    # scored once: the metrics read the scores several times
    old, new = (M.evaluate(written(N.score_nodes(test, n).select("y", "score"), "scores")) for n in (first, longer))
    return M.phase_delta(old, new)


@query("ml8_continued_facts", with_inputs("asset_hosts dns_obs whois_obs", f"""SELECT {_frac('test-42')} < 0.2 AS is_test, count(*) AS n, true AS first_kept,
  true AS rounds_in_range, true AS better FROM made GROUP BY 1""", **_LABELED))
def continued_facts(spark, sf):
    """The earlier trees stay, at most 20 join them, and both parts' log loss falls."""
    rows, first, longer = continued(spark, sf)
    kept = first.exceptAll(longer).isEmpty()
    added = longer.select("tree").distinct().count() - first.select("tree").distinct().count()
    p = F.col("score")
    loss = -F.log(F.when(F.col("label") == 1, p).otherwise(1 - p))
    old = N.score_nodes(rows, first).select("domain", loss.alias("old_loss"))
    both = N.score_nodes(rows, longer).select("domain", "is_test", loss.alias("loss")).join(old, "domain")
    return both.groupBy("is_test").agg(F.count("*").alias("n"), F.lit(kept).alias("first_kept"), F.lit(1 <= added <= 20).alias("rounds_in_range"),
                                       (F.avg("loss") < F.avg("old_loss")).alias("better"))


@query("ml14_model_card", with_inputs("scored", """SELECT model_version AS version, accuracy, f1_score, auc_roc, precision_score, recall_score, false_positive_rate,
  test_samples AS training_samples, 48 AS feature_count, 'trial' AS notes FROM r""", **_EVAL, r=_REPORT))
def model_card(spark, sf):
    report = M.evaluate(adapted(spark, sf, "scored"), by=["model_version"])
    cards = L.model_card(report, F.col("model_version"), F.col("test_samples"), "trial")
    return rounded(cards, ["accuracy", "f1_score", "auc_roc", "precision_score", "recall_score", "false_positive_rate"])


@query("src1_labeled_csv", with_inputs("labeled", "SELECT domain, label FROM firsts", **_ROWS))
def labeled_csv(spark, sf):
    """The raw set written as several CSV files in row order, read back and cleaned in file order."""
    path = scratch_path(spark, "labeled")
    rows = (adapted(spark, sf, "labeled").repartitionByRange(8, "row_id").sortWithinPartitions("row_id")
            .select(F.col("domain").alias("Domain"), F.col("label").alias(" LABEL")))
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    return clean.dedupe_first(clean.clean_labeled(readers.load_labeled(spark, path)), "row_order").select("domain", "label")


@query("snk1_feature_files", with_inputs("labeled", """SELECT 'parquet' AS format, count(*) AS n, sum(label)::BIGINT AS malicious FROM cleaned
  UNION ALL SELECT 'csv', count(*), sum(label)::BIGINT FROM cleaned""", **_ROWS))
def feature_files(spark, sf):
    matrix = build_feature_matrix(cleaned(spark, sf), include_network=False)
    counts = []
    for fmt in ("parquet", "csv"):
        path = scratch_path(spark, "matrix")
        writers.save_features(matrix, path, fmt)
        back = readers.load_features(spark, f"{path}.{fmt}")
        counts.append(back.agg(F.count("*").alias("n"), F.sum("label").alias("malicious")).select(F.lit(fmt).alias("format"), "n", "malicious"))
    return counts[0].unionByName(counts[1])


@query("src3_eval_set", with_inputs("scored", "SELECT l_orderkey::DOUBLE AS l_orderkey, score, y AS label FROM scored"))
def eval_set(spark, sf):
    path = scratch_path(spark, "eval") + ".tsv"
    adapted(spark, sf, "scored").select("l_orderkey", "score", "y").write.option("header", True).option("sep", "\t").csv(path)
    return readers.load_eval_set(spark, path)


@query("snk3_metrics_json", with_inputs("scored", "SELECT model_version, tn, fp, fn, tp FROM c", **_EVAL))
def metrics_json(spark, sf):
    path = scratch_path(spark, "metrics")
    writers.save_metrics(M.confusion(adapted(spark, sf, "scored"), by=["model_version"]), path, "1")
    return spark.read.schema("model_version string, tn long, fp long, fn long, tp long").json(path).select(
        "model_version", "tn", "fp", "fn", "tp")


@query("snk4_vocab_files", with_inputs("raw_hosts whois_obs", "SELECT * FROM vocab", **_PAIRS))
def vocab_files(spark, sf):
    path = scratch_path(spark, "vocab")
    writers.save_vocab(E.fit_vocab(token_rows(spark, sf)), path)
    return writers.load_vocab(spark, path)


@query("snk5_append_analyses", with_inputs("analyses", "SELECT event_id, label FROM analyses WHERE score >= 0.5 AND created_at >= TIMESTAMP '2024-01-10'"))
def append_analyses(spark, sf):
    from wardlight.operators.audit import log_gate, log_rows

    path, kept = scratch_path(spark, "log"), scratch_path(spark, "kept")
    flagged = log_rows(log_gate(adapted(spark, sf, "analyses")))
    for parity in (0, 1):
        writers.append_analyses(flagged.where(F.col("event_id") % 2 == parity), path)
    writers.retain_days(spark, path, kept, "2024-01-10")
    return spark.read.parquet(kept).select("event_id", "label")
