"""Ranks and what rests on them: AUC, average precision, boards, knees, rank correlation, consensus, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.written import materialize


def running_sum(df: DataFrame, value: str, order: list[Column | str], by: list[str] | None = None, to: str = "upto") -> DataFrame:
    """df with the sum of value up to and with each row in the given order (which should have no ties), in each group of by.

    Rows are dealt to ranges of the order, written so that they stay where they are; each range is summed, the sums (a row a
    range and group) are accumulated, and a row adds up its own range only. No task holds a whole group."""
    by = by or []
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = materialize(df.repartitionByRange(*[F.col(c) for c in by], *columns).withColumn("_range", F.spark_partition_id()), "ranges")
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy(*by, "_range").agg(F.sum(value).alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    sums = sums.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_range").alias("_at"), "_ahead")
    same = F.col("_range") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    own = F.sum(value).over(W.partitionBy(*by, "_range").orderBy(*columns).rowsBetween(W.unboundedPreceding, 0))
    return ranged.withColumn("_own", own).join(sums, same).withColumn(to, F.col("_own") + F.col("_ahead")).select(*df.columns, to)


def average_ranks(df: DataFrame, value: str, by: list[str], to: str = "rank") -> DataFrame:
    """Ascending ranks from 1, ties given their mean. Distinct values are counted first, so ties never meet in one place."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranks = running_sum(counts, "_n", [value], by, "_upto").withColumn(to, F.col("_upto") - (F.col("_n") - 1) / 2.0).drop("_n", "_upto")
    return df.join(ranks, [*by, value])


def auc(df: DataFrame, score: str, target: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by rank sums; null where a class is missing."""
    by = by or []
    counts = df.groupBy(*by, score).agg(F.sum(target).alias("pos"), F.count("*").alias("n"))
    ranked = running_sum(counts, "n", [score], by, "_upto").withColumn("ranks", (F.col("_upto") - (F.col("n") - 1) / 2.0) * F.col("pos"))
    sums = ranked.groupBy(*by).agg(F.sum("ranks").alias("s"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    p, n = F.col("p"), F.col("n") - F.col("p")
    return sums.select(*by, p.alias("positives"), n.alias("negatives"), F.try_divide(F.col("s") - p * (p + 1) / 2.0, p * n).alias("auc"))


def auc_by_support(aucs: DataFrame, bands: list[tuple[int, int | None]]) -> DataFrame:
    """Mean AUC, weighted by positives and plain, in bands of support (low, high included)."""
    band = F.coalesce(*[F.when((F.col("positives") >= a) & (F.lit(True) if b is None else F.col("positives") <= b), F.lit(f"{a}-{'' if b is None else b}")) for a, b in bands])
    known = aucs.where("auc is not null").withColumn("band", band).where("band is not null")
    return known.groupBy("band").agg(F.count("*").alias("columns"), F.avg("auc").alias("mean_auc"), (F.sum(F.col("auc") * F.col("positives")) / F.sum("positives")).alias("weighted_auc"))


def average_precision(df: DataFrame, score: str, target: str, by: list[str], tie: list[str]) -> DataFrame:
    """Per column mean precision at its positives, best scores first; columns of one class only are left out."""
    down = W.partitionBy(*by).orderBy(F.desc(score), *tie)
    hits = df.withColumn("hits", F.sum(target).over(down.rowsBetween(W.unboundedPreceding, 0))).withColumn("at", F.row_number().over(down))
    sums = hits.groupBy(*by).agg((F.sum(F.col("hits") / F.col("at") * F.col(target)) / F.sum(target)).alias("average_precision"), F.sum(target).alias("p"), F.count("*").alias("n"))
    return sums.where("p > 0 and p < n").select(*by, "average_precision")


def mean_average_precision(df: DataFrame, score: str, target: str, by: list[str], tie: list[str], mask: str | None = None) -> DataFrame:
    """columns, mean_average_precision over the columns that have both classes; mask: a boolean column, rows to be left in."""
    found = average_precision(df.where(mask) if mask else df, score, target, by, tie)
    return found.groupBy().agg(F.count("*").alias("columns"), F.avg("average_precision").alias("mean_average_precision"))


def group_shares(labels: DataFrame, cases: DataFrame, bank: DataFrame, group: str, most: int = 60) -> DataFrame:
    """Of the most prevalent statements: proto, largest_share (of the sum of the groups' rates, that of the group that states
    it most), style_auc (how well a case's group alone foretells it). labels: case_id, proto; cases: case_id, group; bank:
    proto, prevalence. Statements of all cases or none are left out.

    All goes by counts of group and statement, so no case meets a statement that it doesn't have."""
    top = bank.orderBy(F.desc("prevalence"), "proto").limit(most).select("proto")
    sizes = cases.groupBy(group).agg(F.count("*").alias("n"))
    stated = labels.join(top, "proto", "left_semi").distinct().join(cases.select("case_id", group), "case_id").groupBy("proto", group).agg(F.count("*").alias("pos"))
    grid = sizes.crossJoin(top).join(stated, ["proto", group], "left").fillna(0, ["pos"]).withColumn("rate", F.col("pos") / F.col("n"))
    # the rate is the score: cases of groups of one rate are ties
    tied = grid.groupBy("proto", "rate").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    ranks = F.sum("n").over(W.partitionBy("proto").orderBy("rate").rowsBetween(W.unboundedPreceding, 0)) - (F.col("n") - 1) / 2.0
    sums = tied.withColumn("ranks", ranks * F.col("pos")).groupBy("proto").agg(F.sum("ranks").alias("s"), F.sum("pos").alias("p"), F.sum("n").alias("n")).where("p > 0 and p < n")
    style = sums.select("proto", ((F.col("s") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * (F.col("n") - F.col("p")))).alias("style_auc"))
    share = grid.groupBy("proto").agg((F.max("rate") / (F.sum("rate") + 1e-9)).alias("largest_share"))
    return share.join(style, "proto")


def discrimination(matched: DataFrame, mismatched: DataFrame, value: str) -> DataFrame:
    """cases, matched_mean, mismatched_mean, separation, auc: how surely a pair that belongs together outscores one that
    doesn't, ties half."""
    both = matched.select(F.col(value).alias("v"), F.lit(1).alias("y")).unionByName(mismatched.select(F.col(value).alias("v"), F.lit(0).alias("y")))
    means = both.groupBy().agg(F.count_if(F.col("y") == 1).alias("cases"), F.avg(F.when(F.col("y") == 1, F.col("v"))).alias("matched_mean"), F.avg(F.when(F.col("y") == 0, F.col("v"))).alias("mismatched_mean"))
    return means.withColumn("separation", F.col("matched_mean") - F.col("mismatched_mean")).crossJoin(auc(both, "v", "y").select("auc"))


def decoys(cases: DataFrame, each: int, seed: int = 2026) -> DataFrame:
    """case_id, other: as many other cases for each, by hash: cases stand in a ring of hashes, and the next ones are taken."""
    turned = cases.select("case_id", F.xxhash64(F.lit(seed), "case_id").alias("turn"), F.lit(1).cast("long").alias("one"))
    ring = materialize(running_sum(turned, "one", ["turn", "case_id"], to="at").select("case_id", F.col("at") - 1), "ring").toDF("case_id", "at")
    n = ring.count()
    steps = ring.select("case_id", F.explode(F.expr(f"filter(sequence(1, {each}), k -> k < {n})")).alias("k"), "at")
    return steps.withColumn("at", (F.col("at") + F.col("k")) % max(n, 1)).join(ring.withColumnRenamed("case_id", "other"), "at").select("case_id", "other")


def leaderboard(results: DataFrame, metric: str, config: list[str], most: int = 15) -> DataFrame:
    """The best configurations by a metric, with their place; a report of the first `most`."""
    top = results.orderBy(F.desc(metric), *config).limit(most)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc(metric), *config)))


def grid(spark: SparkSession, choices: dict[str, list]) -> DataFrame:
    """Every combination of the listed values, a column a name: a list of settings, made of literals."""
    out = spark.range(1).select()
    for name, values in choices.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def positions(board: DataFrame, metrics: list[str]) -> DataFrame:
    """Competition rank of each metric (1 + how many are strictly better) and their mean."""
    for m in metrics:
        counts = board.groupBy(F.col(m).alias("_m")).agg(F.count("*").alias("_n"))
        ranks = running_sum(counts, "_n", [F.col("_m").desc()], to="_upto").select("_m", (F.col("_upto") - F.col("_n") + 1).alias(f"{m}_rank"))
        board = board.join(ranks, F.col(m).eqNullSafe(F.col("_m"))).drop("_m")
    return board.withColumn("mean_position", sum(F.col(f"{m}_rank") for m in metrics) / float(len(metrics)))


def insert_entry(board: DataFrame, entries: DataFrame, metrics: list[str], entry: str = "entry", order: str = "input_order") -> DataFrame:
    """The board anew with each further entry by itself (column trial): ordinal places, ties in input order, mean place and
    whether the entry wins. A board is short: it is repeated once for each trial."""
    base = board.select(entry, order, *metrics)
    trials = entries.select(F.col(entry).alias("trial"))
    grown = base.crossJoin(trials).unionByName(entries.select(F.col(entry).alias("trial"), entry, order, *metrics))
    for m in metrics:
        grown = grown.withColumn(f"{m}_place", F.row_number().over(W.partitionBy("trial").orderBy(F.desc(m), order)))
    grown = grown.withColumn("mean_place", sum(F.col(f"{m}_place") for m in metrics) / float(len(metrics)))
    return grown.withColumn("wins", F.col("mean_place") == F.min("mean_place").over(W.partitionBy("trial")))


def knee(curve: DataFrame, n: str, value: str, least_gain: float, by: list[str] | None = None) -> DataFrame:
    """The last length before the gain falls below least_gain for the first time; the last of all if it never does."""
    by = by or []
    w = (W.partitionBy(*by) if by else W.partitionBy()).orderBy(n)
    steps = curve.withColumn("gain", F.col(value) - F.lag(value, 1, 0.0).over(w)).withColumn("before", F.lag(n).over(w))
    stop = F.min(F.when((F.col("gain") < least_gain) & F.col("before").isNotNull(), F.struct(n, "before")))
    return steps.groupBy(*by).agg(F.coalesce(stop["before"], F.max(n)).alias("knee"))


def pinned_or_knee(curve: DataFrame, n: str, value: str, least_gain: float, pinned: int | None = None, by: list[str] | None = None) -> DataFrame:
    """The row of a search's curve that is taken: that of the pinned length, else that of the knee."""
    by = by or []
    if pinned is not None:
        return curve.where(F.col(n) == pinned)
    at = knee(curve, n, value, least_gain, by).withColumnRenamed("knee", n)
    return curve.join(at, [*by, n], "left_semi")


def medoid(utility: DataFrame, by: list[str], tie: str = "n") -> DataFrame:
    """utility: by, i, j, u and tie (of i). Per group the candidate of greatest mean utility to the others; of equals the one of
    greater tie, then the first. utility has no pair of a candidate with itself."""
    means = utility.groupBy(*by, "i").agg(F.round(F.avg("u"), 9).alias("m"), F.max(tie).alias("t"))
    return means.groupBy(*by).agg(F.max_by("i", F.struct("m", "t", -F.col("i"))).alias("chosen"))


def consensus(sets: DataFrame, by: list[str], words: str = "words", tie: str = "n") -> DataFrame:
    """sets: by, i, words (distinct) and tie. Per group the candidate whose words have the greatest mean Jaccard with the others',
    as `medoid`. Candidates meet within their group only."""
    other = sets.select(*by, F.col("i").alias("j"), F.col(words).alias("_v"))
    met = sets.join(other, by).where("i <> j")
    return medoid(met.select(*by, "i", "j", T.jaccard(F.col(words), F.col("_v")).alias("u"), tie), by, tie)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with mean ranks for ties, and whether both metrics have the same best row."""
    ranked = average_ranks(average_ranks(df.select(a, b), a, [], "ra"), b, [], "rb")
    return ranked.groupBy().agg(F.corr("ra", "rb").alias("spearman"), (F.max_by(a, F.struct(F.col(b), F.col(a))) == F.max(a)).alias("same_winner"))


def quota(df: DataFrame, by: str, order: list[Column | str], each: int) -> DataFrame:
    """The first rows of each group, as many of each."""
    return df.withColumn("_at", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("_at") <= each).drop("_at")


def weighted_consensus(utility: DataFrame, by: list[str]) -> DataFrame:
    """utility: by, i, j, u, weight (of j). Per group the candidate of greatest mean utility to the others; first wins."""
    scores = utility.where("i <> j").groupBy(*by, "i").agg(F.coalesce(F.try_divide(F.sum(F.col("u") * F.col("weight")), F.sum("weight")), F.lit(0.0)).alias("score"))
    return scores.groupBy(*by).agg(F.max_by("i", F.struct(F.col("score"), -F.col("i"))).alias("chosen"), F.max("score").alias("score"))


def grid_rollup(results: DataFrame, config: list[str], metrics: list[str]) -> DataFrame:
    """Per configuration the mean and the least (worst fold) of each metric over its folds, and how many folds."""
    return results.groupBy(*config).agg(F.count("*").alias("folds"), *[f(m).alias(f"{name}_{m}") for m in metrics for f, name in ((F.avg, "mean"), (F.min, "worst"))])
