"""Detector evaluation: ranking metrics, curves, histograms, sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sugartrace import constants as K
from sugartrace.operators import calibrate, ordered
from sugartrace.session import materialize

PID = "patient_id"
CUTOFFS = (2, 4, 6, 8, 10, 15, 20, 30)


def ranked_counts(scored: DataFrame, labels: Sequence[str], keys: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Per distinct score: rows `n` and positives per label, with running sums from the top.

    Rows are first counted per score, then summed in quantile blocks, so ties cost one row
    and no task sees the whole ranking.
    """
    counts = scored.groupBy(*keys, (-F.col(score)).alias("_rank")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum((F.col(c) > 0).cast("long")).alias(c) for c in labels]
    )
    counts = materialize(counts)
    sums = {"cum_n": F.col("n"), **{f"cum_{c}": F.col(c) for c in labels}}
    out = ordered.prefix_sum(ordered.with_value_block(counts, "_rank"), list(keys), ["_rank"], sums)
    return out.withColumn(score, -F.col("_rank")).drop("_rank", ordered.BLOCK)


def ranking_metrics(scored: DataFrame, labels: Sequence[str], keys: Sequence[str] = (), score: str = "score") -> DataFrame:
    """AUROC (ties count half) and average precision per label; null without positives or negatives."""
    ranked = ranked_counts(scored, labels, keys, score)
    wide = ranked.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        *[F.sum(c).alias(f"p_{c}") for c in labels],
        *[F.sum((F.col("n") - F.col(c)) * (F.col(f"cum_{c}") - 0.5 * F.col(c))).alias(f"u_{c}") for c in labels],
        *[F.sum(F.col(c) * F.col(f"cum_{c}") / F.col("cum_n")).alias(f"a_{c}") for c in labels],
    )

    def one(c: str) -> Column:
        p, n = F.col(f"p_{c}"), F.col("n")
        usable = (p > 0) & (p < n)
        return F.struct(
            F.lit(c).alias("label"),
            p.alias("positives"),
            F.when(usable, F.col(f"u_{c}") / (p * (n - p))).alias("auroc"),
            F.when(p > 0, F.col(f"a_{c}") / p).alias("auprc"),
        )

    return wide.select(*keys, F.inline(F.array(*[one(c) for c in labels])))


def with_any(scored: DataFrame, flags: Sequence[str], name: str = "any_class") -> DataFrame:
    return scored.withColumn(name, (F.greatest(*flags) > 0).cast("double"))


def pr_curve(scored: DataFrame, labels: Sequence[str], score: str = "score") -> DataFrame:
    """Precision and recall at every distinct score, per label with positives."""
    ranked = ranked_counts(scored, labels, (), score)
    totals = scored.agg(*[F.sum((F.col(c) > 0).cast("long")).alias(f"p_{c}") for c in labels])
    points = F.array(
        *[
            F.struct(
                F.lit(c).alias("label"),
                F.col(score).alias("threshold"),
                (F.col(f"cum_{c}") / F.col("cum_n")).alias("precision"),
                F.when(F.col(f"p_{c}") > 0, F.col(f"cum_{c}") / F.col(f"p_{c}")).alias("recall"),
            )
            for c in labels
        ]
    )
    return ranked.crossJoin(F.broadcast(totals)).select(F.inline(points)).filter("recall IS NOT NULL")


def score_histogram(scored: DataFrame, label: str = "any_class", edges: int = 80, top: float = 0.995) -> DataFrame:
    """Normal and anomalous counts and densities in equal bins from the minimum to the 99.5th percentile."""
    limits = ordered.grouped_quantiles(scored, [], "score", {"hi": top}).select("hi").crossJoin(
        scored.agg(F.min("score").alias("lo"))
    )
    bins = edges - 1
    width = (F.col("hi") - F.col("lo")) / bins
    placed = (
        scored.crossJoin(F.broadcast(limits))
        .filter(F.col("score") <= F.col("hi"))
        .withColumn("bin", F.least(F.floor((F.col("score") - F.col("lo")) / width), F.lit(bins - 1)).cast("long"))
    )
    counts = placed.groupBy("bin").agg(
        F.count_if(F.col(label) == 0).alias("normal"),
        F.count_if(F.col(label) > 0).alias("anomalous"),
        F.first("lo").alias("_lo"),
        F.first(width).alias("_w"),
    )
    totals = counts.agg(F.sum("normal").alias("_n"), F.sum("anomalous").alias("_a"))  # at most 79 rows in
    return counts.crossJoin(F.broadcast(totals)).select(
        "bin",
        (F.col("_lo") + F.col("bin") * F.col("_w")).alias("left_edge"),
        "normal",
        "anomalous",
        F.when(F.col("_n") > 0, F.col("normal") / (F.col("_n") * F.col("_w"))).alias("normal_density"),
        F.when(F.col("_a") > 0, F.col("anomalous") / (F.col("_a") * F.col("_w"))).alias("anomalous_density"),
    )


def severity_sweep(
    scored: DataFrame, truth: Column, stride: int = K.SCORE_STRIDE, cutoffs: Sequence[float] = CUTOFFS
) -> DataFrame:
    """Per cutoff, with and without the direction gate: shown, precision, recall, per day, lift.

    All cutoffs are conditional sums of one pass.
    """
    rows = scored.select("severity", "direction", F.coalesce(truth, F.lit(False)).alias("t"))
    shown, hits = {}, {}
    for gate in (False, True):
        for i, cutoff in enumerate(cutoffs):
            pick = F.col("severity") >= float(cutoff)
            if gate:
                pick = pick & (F.col("direction") >= 0)
            shown[i, gate] = F.count_if(pick).alias(f"s_{i}_{int(gate)}")
            hits[i, gate] = F.count_if(pick & F.col("t")).alias(f"h_{i}_{int(gate)}")
    sums = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("t").alias("p"), *shown.values(), *hits.values()
    )
    n, p = F.col("n"), F.col("p")
    days = n * stride / 1440.0

    def line(i: int, gate: bool) -> Column:
        s, h = F.col(f"s_{i}_{int(gate)}"), F.col(f"h_{i}_{int(gate)}")
        precision = F.when(s > 0, h / s)
        return F.struct(
            F.lit(float(cutoffs[i])).alias("cutoff"),
            F.lit(gate).alias("gated"),
            s.alias("shown"),
            precision.alias("precision"),
            F.when(p > 0, h / p).alias("recall"),
            (s / days).alias("per_day"),
            F.when(p > 0, precision / (p / n)).alias("lift"),
        )

    return sums.select(F.inline(F.array(*[line(i, g) for i, g in shown])))


def false_positives_at_artifacts(injected: DataFrame, clean: DataFrame, k: float = K.THRESHOLD_K) -> DataFrame:
    """False-positive rate at artefact-only and at untouched normal windows, over the clean threshold.

    Both: score, label; `injected` also has `artifact`.
    """
    limit = calibrate.threshold_all(clean, [], k).select("threshold")
    over = F.col("score") > F.col("threshold")
    normal = F.col("label") == 0
    rows = injected.crossJoin(F.broadcast(limit))
    touched, untouched = F.col("artifact") & normal, ~F.col("artifact") & normal
    return rows.agg(
        F.first("threshold").alias("threshold"),
        F.count_if(touched).alias("artifact_windows"),
        (F.count_if(touched & over) / F.nullif(F.count_if(touched), F.lit(0))).alias("artifact_fp_rate"),
        F.count_if(untouched).alias("normal_windows"),
        (F.count_if(untouched & over) / F.nullif(F.count_if(untouched), F.lit(0))).alias("normal_fp_rate"),
    )


def over_detection(held_out: DataFrame, arms: dict[str, DataFrame]) -> DataFrame:
    """Flagged share of the held-out windows under each arm's per-patient thresholds."""
    out = None
    for arm, thresholds in arms.items():
        flagged = calibrate.flag(held_out, thresholds.select(PID, "threshold"))
        part = flagged.agg(F.count(F.lit(1)).alias("windows"), F.count_if("flagged").alias("flagged")).select(
            F.lit(arm).alias("arm"), "windows", "flagged", (F.col("flagged") / F.nullif("windows", F.lit(0))).alias("share")
        )
        out = part if out is None else out.unionByName(part)
    return out


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("true_class", "pred_class").agg(F.count(F.lit(1)).alias("n"))


def recall_by_class(predictions: DataFrame) -> DataFrame:
    """Per true class: count, recall, mean uncertainty and distance, and the balanced accuracy of all.

    `predictions`: true_class, pred_class, uncertainty, distance.
    """
    per_class = predictions.groupBy("true_class").agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_if(F.col("true_class") == F.col("pred_class")) / F.count(F.lit(1))).alias("recall"),
        F.avg("uncertainty").alias("mean_uncertainty"),
        F.avg("distance").alias("mean_distance"),
    )
    balanced = per_class.agg(F.avg("recall").alias("balanced_accuracy"))  # one row per class in
    return per_class.crossJoin(F.broadcast(balanced))


def model_compare(scored: DataFrame, models: dict[str, str], labels: Sequence[str]) -> DataFrame:
    """AUPRC and AUROC of several score columns side by side, with a mean row."""
    stacked = scored.select(
        *labels, F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("score")) for m, c in models.items()]))
    )
    long = ranking_metrics(stacked, labels, ["model"])
    rates = scored.agg(*[F.avg((F.col(c) > 0).cast("double")).alias(c) for c in labels])
    prevalence = rates.select(F.inline(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("prevalence")) for c in labels])))
    wide = long.groupBy("label").agg(
        *[F.max(F.when(F.col("model") == m, F.col(x))).alias(f"{x}_{m}") for x in ("auprc", "auroc") for m in models]
    )
    values = [c for c in wide.columns if c != "label"]
    mean = wide.agg(*[F.avg(c).alias(c) for c in values]).select(F.lit("mean").alias("label"), *values)
    return wide.unionByName(mean).join(prevalence, "label", "left")


def detection_rule_validation(events: DataFrame, boluses: DataFrame) -> DataFrame:
    """F1 of missed and late, and the share of normal meals flagged.

    `events`: patient, minute, truth (missed, late or normal). `boluses`: patient, minute.
    """
    from sugartrace.operators import rules

    named = rules.classify_detection(events, boluses, "minute", direction=None)
    truth, guess = F.col("truth"), F.col("rule_label")
    sums = named.agg(
        *[F.count_if((truth == c) & (guess == c)).alias(f"tp_{c}") for c in ("missed", "late")],
        *[F.count_if((truth == c) & ~guess.eqNullSafe(c)).alias(f"fn_{c}") for c in ("missed", "late")],
        *[F.count_if((truth != "normal") & (truth != c) & (guess == c)).alias(f"fp_{c}") for c in ("missed", "late")],
        F.count_if(truth == "normal").alias("normal_meals"),
        F.count_if((truth == "normal") & guess.isNotNull()).alias("normal_flagged"),
    )

    def f1(c: str) -> Column:
        tp, fp, fn = F.col(f"tp_{c}"), F.col(f"fp_{c}"), F.col(f"fn_{c}")
        return F.when(tp > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)

    return sums.select(
        f1("missed").alias("f1_missed"),
        f1("late").alias("f1_late"),
        "normal_meals",
        F.when(F.col("normal_meals") > 0, F.col("normal_flagged") / F.col("normal_meals")).otherwise(0.0).alias("normal_flagged_share"),
    )
