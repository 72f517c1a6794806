"""Model-quality metrics over scored rows, as grouped jobs.

Every function takes ``by`` (fold, version, suffix, month, ...) and works from
integer counts; curves are built over distinct scores, never over raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions.scores import score_to_label
from wardlight.operators.bounds import running_total

# Thresholds and release targets.
DECISION_THRESHOLD = 0.5
SWEEP = (0.30, 0.50, 0.70, 0.80, 0.90)
TARGETS = [("auc_roc", 0.95, "min"), ("f1_score", 0.90, "min"), ("false_positive_rate", 0.02, "max")]


def _grouped(df: DataFrame, by: list[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def _cells(threshold: float, y: str, score: str) -> dict[str, Column]:
    said, real = F.col(score) >= threshold, F.col(y) == 1
    return {"tn": F.count_if(~said & ~real), "fp": F.count_if(said & ~real),
            "fn": F.count_if(~said & real), "tp": F.count_if(said & real)}


def confusion(df: DataFrame, threshold: float = DECISION_THRESHOLD, by: list[str] = (),
              y: str = "y", score: str = "score") -> DataFrame:
    return _grouped(df, list(by), *[c.alias(n) for n, c in _cells(threshold, y, score).items()])


def safe_ratio(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / F.nullif(whole, F.lit(0).cast("long"))).otherwise(0.0)


def rates(tn: Column, fp: Column, fn: Column, tp: Column) -> dict[str, Column]:
    return {
        "accuracy": safe_ratio(tp + tn, tp + tn + fp + fn),
        "precision_score": safe_ratio(tp, tp + fp), "recall_score": safe_ratio(tp, tp + fn),
        "f1_score": safe_ratio(2 * tp, 2 * tp + fp + fn),
        "false_positive_rate": safe_ratio(fp, fp + tn), "false_negative_rate": safe_ratio(fn, fn + tp),
        "true_positive_rate": safe_ratio(tp, tp + fn), "specificity": safe_ratio(tn, tn + fp)}


def binary_metrics(df: DataFrame, threshold: float = DECISION_THRESHOLD, by: list[str] = (),
                   y: str = "y", score: str = "score") -> DataFrame:
    cells = confusion(df, threshold, by, y, score)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return cells.withColumns({
        **rates(tn, fp, fn, tp), "test_samples": tn + fp + fn + tp,
        "positives_in_test": tp + fn, "negatives_in_test": tn + fp})


def score_curve(df: DataFrame, by: list[str] = (), y: str = "y", score: str = "score") -> DataFrame:
    """Per distinct score: positives, negatives and both counts at or above it."""
    groups = df.groupBy(*by, F.col(score).alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    return running_total(groups, list(by), "score", ["pos", "neg"])


def curve_metrics(df: DataFrame, by: list[str] = (), y: str = "y", score: str = "score") -> DataFrame:
    """``auc_roc`` (ties count half) and ``pr_auc``; NaN with one class only."""
    return _areas(score_curve(df, by, y, score), list(by), [])


def _areas(curve: DataFrame, by: list[str], extra: list[Column]) -> DataFrame:
    whole = lambda c: c.cast("decimal(19,0)")
    above = F.col("cum_pos") - F.col("pos")
    wins = F.sum(whole(F.col("neg")) * whole(2 * above + F.col("pos")))
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    sums = _grouped(curve, by, wins.alias("_w"), F.sum(F.col("pos") * precision).alias("_a"),
                    F.sum("pos").alias("_p"), F.sum("neg").alias("_n"), *extra)
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    one = F.lit(float("nan"))
    pairs = F.nullif(2.0 * F.col("_p").cast("double") * F.col("_n").cast("double"), F.lit(0.0))
    auc = F.when(both, F.col("_w").cast("double") / pairs).otherwise(one)
    prc = F.when(both, F.col("_a") / F.nullif(F.col("_p"), F.lit(0).cast("long"))).otherwise(one)
    return sums.withColumns({"auc_roc": auc, "pr_auc": prc}).drop("_w", "_a", "_p", "_n")


def threshold_sweep(df: DataFrame, thresholds=SWEEP, by: list[str] = (), y: str = "y",
                    score: str = "score") -> DataFrame:
    """All thresholds in one pass of conditional counts."""
    aggs = [c.alias(f"{n}_{i}") for i, t in enumerate(thresholds) for n, c in _cells(t, y, score).items()]
    wide = _grouped(df, list(by), *aggs)

    def row(i: int, t: float) -> Column:
        m = rates(*[F.col(f"{n}_{i}") for n in ("tn", "fp", "fn", "tp")])
        return F.struct(F.lit(float(t)).alias("threshold"), m["precision_score"].alias("precision"),
                        m["recall_score"].alias("recall"), m["f1_score"].alias("f1"),
                        m["false_positive_rate"].alias("fpr"))

    return wide.select(*by, F.inline(F.array(*[row(i, t) for i, t in enumerate(thresholds)])))


def tier_breakdown(df: DataFrame, by: list[str] = (), score: str = "score") -> DataFrame:
    """Rows per label; labels that do not occur read 0."""
    label = score_to_label(F.col(score))
    return _grouped(df, list(by), *[F.count_if(label == n).alias(n) for n in ("safe", "suspicious", "malicious")])


def check_targets(metrics: DataFrame, by: list[str] = (), scheme: str = "release") -> DataFrame:
    """One row per target: value, target and whether it is met.

    ``release`` accepts equality and fails NaN; ``train`` is strict.
    """
    if scheme not in ("release", "train"):
        raise ValueError(f"unknown scheme: {scheme}")

    def row(name: str, target: float, way: str) -> Column:
        v = F.col(name)
        ok = {("release", "min"): v >= target, ("release", "max"): v <= target,
              ("train", "min"): v > target, ("train", "max"): v < target}[scheme, way]
        known = v.isNotNull() & ~F.isnan(v)
        return F.struct(F.lit(name).alias("metric"), v.alias("value"), F.lit(target).alias("target"),
                        (known & ok).alias("passed"))

    return metrics.select(*by, F.inline(F.array(*[row(*t) for t in TARGETS])))


def cv_summary(folds: DataFrame, by: list[str] = ()) -> DataFrame:
    """Mean and population deviation over folds; NaN AUCs are left out."""
    auc = F.when(~F.isnan("auc_roc"), F.col("auc_roc"))
    aggs = [F.count("*").alias("folds"), F.avg(auc).alias("auc_mean"), F.stddev_pop(auc).alias("auc_std")]
    for short, col in (("f1", "f1_score"), ("fpr", "false_positive_rate")):
        aggs += [F.avg(col).alias(f"{short}_mean"), F.stddev_pop(col).alias(f"{short}_std")]
    return _grouped(folds, list(by), *aggs)


def evaluate(df: DataFrame, threshold: float = DECISION_THRESHOLD, by: list[str] = (),
             y: str = "y", score: str = "score") -> DataFrame:
    """Full report: confusion cells, rates, both areas and the tier counts.

    Rows are first reduced to counts per distinct score, so the three parts
    share one small input instead of scanning the scored rows three times.
    """
    by = list(by)
    curve = score_curve(df, by, y, score)
    s, pos, neg = F.col("score"), F.col("pos"), F.col("neg")
    said = s >= threshold
    label = score_to_label(s)

    def total(cond: Column, n: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0))

    cells = [total(~said, neg).alias("tn"), total(said, neg).alias("fp"),
             total(~said, pos).alias("fn"), total(said, pos).alias("tp")]
    tiers = [total(label == n, pos + neg).alias(n) for n in ("safe", "suspicious", "malicious")]
    report = _areas(curve, by, cells + tiers)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return report.withColumns({
        **rates(tn, fp, fn, tp), "test_samples": tn + fp + fn + tp,
        "positives_in_test": tp + fn, "negatives_in_test": tn + fp})


def phase_delta(before: DataFrame, after: DataFrame, by: list[str] = ()) -> DataFrame:
    """Later minus earlier metrics on the same test rows."""
    names = ["auc_roc", "f1_score", "false_positive_rate", "accuracy"]
    old = before.select(*by, *[F.col(n).alias(f"_{n}") for n in names])
    joined = after.join(old, list(by)) if by else after.withColumn("_one", F.lit(1)).join(
        old.withColumn("_one", F.lit(1)), "_one")
    return joined.select(*by, *[(F.col(n) - F.col(f"_{n}")).alias(f"delta_{n}") for n in names])
