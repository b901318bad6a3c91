"""Exact classification metrics over threshold labels.

Scores are counted per distinct value before anything is ranked, so ties are exact and a value
shared by a third of all rows costs one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from groundsieve.functions.ordered import MAX_GROUPS, row_numbers, running_totals, value_counts
from groundsieve.operators.small import checked_broadcast
from groundsieve.session import cut_lineage

# Threshold labels on N.
LABELS = {"lt5": ("below", 5.0), "lt10": ("below", 10.0), "lt15": ("below", 15.0), "ge30": ("above", 30.0)}
ECE_BINS = 15
LOG_CLIP = 1e-7


def with_labels(df: DataFrame, n: str = "n_value", labels: Mapping[str, tuple[str, float]] = LABELS) -> DataFrame:
    """Rows once per threshold label with the 0/1 outcome ``y``."""
    items = [F.struct(F.lit(k).alias("label"), (F.col(n) < c if side == "below" else F.col(n) >= c).cast("int").alias("y"))
             for k, (side, c) in labels.items()]
    return df.select("*", F.inline(F.array(*items)))


def positive_rates(df: DataFrame, by: Sequence[str] = ("label",)) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("y").cast("double")).alias("positive_rate"))


def brier_and_log_loss(df: DataFrame, by: Sequence[str], p: str = "p") -> DataFrame:
    """Brier score, log loss and Brier skill against the constant rate."""
    d = F.col(p) - F.col("y")
    c = F.least(F.greatest(F.col(p), F.lit(LOG_CLIP)), F.lit(1 - LOG_CLIP))
    g = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(d * d).alias("brier"),
        F.avg(-F.when(F.col("y") == 1, F.log(c)).otherwise(F.log(1 - c))).alias("log_loss"),
        F.avg(F.col("y").cast("double")).alias("_r"))
    base = F.col("_r") * (1 - F.col("_r"))
    return g.withColumn("brier_skill", F.when(base >= 1e-9, 1 - F.col("brier") / base)).drop("_r")


def ece(df: DataFrame, by: Sequence[str], p: str = "p", bins: int = ECE_BINS) -> DataFrame:
    """Expected calibration error over equal-width bins, last bin closed."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    per = df.groupBy(*by, b.alias("_b")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("conf"), F.avg(F.col("y").cast("double")).alias("acc"))
    return per.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"))


def ranked_scores(df: DataFrame, by: Sequence[str], p: str = "p", descending: bool = False) -> DataFrame:
    counts = value_counts(df, by, p, {"pos": F.col("y").cast("long")}, complete=True)
    return running_totals(counts, by, p, ["n", "pos"], descending=descending)


def roc_auc(df: DataFrame, by: Sequence[str], p: str = "p") -> DataFrame:
    """Rank-sum AUC with average ranks for ties; NULL with one class (T4)."""
    r = ranked_scores(df, by, p)
    neg = F.col("n") - F.col("pos")
    below = (F.col("cum_n") - F.col("cum_pos")) - neg
    pairs = F.max(F.col("tot_pos") * (F.col("tot_n") - F.col("tot_pos")))
    return r.groupBy(*by).agg(F.when(pairs > 0, F.sum(F.col("pos") * (below + neg / 2)) / pairs).alias("auc"))


def rank_metrics(df: DataFrame, by: Sequence[str], fpr_targets: Sequence[float] = (0.01, 0.05, 0.1), p: str = "p") -> DataFrame:
    """Average precision (T5) and recall at fixed false-positive rates (T7) from one ranking."""
    r = ranked_scores(df, by, p, descending=True)
    pos, neg = F.col("tot_pos"), F.col("tot_n") - F.col("tot_pos")
    both = (F.max(pos) > 0) & (F.max(neg) > 0)
    ap = F.sum(F.col("pos") / pos * (F.col("cum_pos") / F.col("cum_n")))
    aggs = [F.when(both, ap).alias("average_precision")]
    for t in fpr_targets:
        fpr = (F.col("cum_n") - F.col("cum_pos")) / neg
        aggs.append(F.when(both, F.coalesce(F.max(F.when(fpr <= F.lit(t), F.col("cum_pos") / pos)), F.lit(0.0)))
                    .alias(f"recall_at_fpr_{int(round(t * 100))}"))
    return r.groupBy(*by).agg(*aggs)


def top_k_precision(df: DataFrame, by: Sequence[str], fractions: Sequence[float], key: str, p: str = "p") -> DataFrame:
    """Precision of the k = max(1, round-half-even(n * f)) highest scores, ties by key.

    Scores above the k-th are counted by value; only rows tied at the k-th score are ranked by key.
    """
    counts = ranked_scores(df, by, p, descending=True)
    names = {f"precision_top_{int(round(f * 100))}": f for f in fractions}
    k = {n: F.greatest(F.lit(1), F.rint(F.col("tot_n") * F.lit(f)).cast("long")) for n, f in names.items()}
    edge = counts.groupBy(*by).agg(*[
        F.min_by(F.struct(F.col(p).alias("v"), (F.col("cum_pos") - F.col("pos")).alias("above"),
                          (k[n] - F.col("cum_n") + F.col("n")).alias("need"), k[n].alias("_size")),
                 F.when(F.col("cum_n") >= k[n], F.col("cum_n"))).alias(n) for n in names])
    edge = edge.select(*by, F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"{n}.v").alias("v"), F.col(f"{n}.above").alias("above"),
                                                        F.col(f"{n}.need").alias("need"), F.col(f"{n}._size").alias("_size")) for n in names])))
    tied = cut_lineage(df.select(*by, F.col(p).alias("v"), key, "y").join(checked_broadcast(edge), [*by, "v"]))
    ranked = row_numbers(tied, [*by, "name"], key, key)
    out = ranked.groupBy(*by, "name").agg(F.max("_size").alias("_size"), (F.max("above") + F.sum(F.when(F.col("rn") <= F.col("need"), F.col("y")).otherwise(0))).alias("hits"))
    return out.groupBy(*by).agg(*[F.max(F.when(F.col("name") == n, F.col("hits") / F.col("_size"))).alias(n) for n in names])


def net_benefit(df: DataFrame, by: Sequence[str], thresholds: Sequence[float], p: str = "p") -> DataFrame:
    """Decision-curve net benefit per probability threshold; NULL at 1."""
    aggs = []
    for i, _ in enumerate(thresholds):
        hit = F.col(p) >= F.lit(float(thresholds[i]))
        aggs += [F.sum((hit & (F.col("y") == 1)).cast("long")).alias(f"tp{i}"), F.sum((hit & (F.col("y") == 0)).cast("long")).alias(f"fp{i}")]
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *aggs)
    rows = [F.struct(F.lit(float(t)).alias("threshold"),
                     (F.col(f"tp{i}") / F.col("n") - F.col(f"fp{i}") / F.col("n") * F.lit(t / (1 - t)) if t < 1 else F.lit(None).cast("double")).alias("net_benefit"))
            for i, t in enumerate(thresholds)]
    return wide.select(*by, F.inline(F.array(*rows)))


def reliability_equal_mass(df: DataFrame, by: Sequence[str], key: str, bins: int = 10, p: str = "p") -> DataFrame:
    """Rank slices with edges floor(i * n / bins), ties by key.

    Scores are counted by value; only rows of the values that an edge cuts, ``bins`` - 1 of them at most, are ranked by key.
    """
    def slot(rank):
        return sum([(F.floor(F.lit(i) * F.col("tot_n") / bins) <= rank).cast("int") for i in range(1, bins)], F.lit(0))

    y = F.col("y").cast("double")
    counts = value_counts(df, by, p, {"pos": y, "known": y.isNotNull().cast("long")}, complete=True)
    above = F.col("cum_n") - F.col("n")
    counts = cut_lineage(running_totals(counts, by, p, ["n"]).withColumns({"_above": above, "_first": slot(above), "bin": slot(F.col("cum_n") - 1)}))
    columns = [*by, "bin", "n", p, "pos", "known"]
    whole = counts.where("_first = bin").select(*columns)
    cut_before = F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy(p).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = counts.where("_first < bin").select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col(p).alias("_cut"), "tot_n", (F.col("_above") - cut_before).alias("_shift"))
    same = F.col(p).eqNullSafe(F.col("_cut"))
    for i, c in enumerate(by):
        same = same & (F.col(c) == F.col(f"_g{i}"))
    tied = cut_lineage(df.select(*by, key, p, y.alias("pos")).join(checked_broadcast(cut, bins * MAX_GROUPS), same).select(*by, key, p, "pos", "tot_n", "_shift"))
    ranked = row_numbers(tied, by, p, key)
    parts = ranked.select(*by, slot(F.col("rn") - 1 + F.col("_shift")).alias("bin"), F.lit(1).cast("long").alias("n"), p, "pos", F.col("pos").isNotNull().cast("long").alias("known"))
    scored = F.sum(F.when(F.col(p).isNotNull(), F.col("n")))
    return whole.unionByName(parts.select(*columns)).groupBy(*by, "bin").agg(
        F.sum("n").alias("n"), (F.sum(F.col(p) * F.col("n")) / scored).alias("mean_p"), (F.sum("pos") / F.sum("known")).alias("observed"))


def class_weights(df: DataFrame, by: Sequence[str], rare: float = 0.2) -> DataFrame:
    """(1, max(1, (1 - r) / r)) where the positive rate r is under ``rare``."""
    r = F.col("positive_rate")
    w = F.when((r > 0) & (r < rare), F.greatest(F.lit(1.0), (1 - r) / r)).otherwise(1.0)
    return positive_rates(df, by).withColumn("weight_positive", w)
