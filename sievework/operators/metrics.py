"""Classifier metrics from one table of scores.

Rows are first reduced to distinct scores with counts of both classes; running sums over those go bucket by bucket (see
`ranks`), so no task sorts a whole condition, and conditions or families are just keys. Where a class is missing, what
needs it is null.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import joined, running, value_buckets, value_edges


def cumulative(scored: DataFrame, by: list[str]) -> DataFrame:
    """One row for each distinct score `sc`: p, n (rows of both classes), cp, cn (so far, descending), tp, tn (all), rn, k,
    the next row's p1, n1 and the score `before` it."""
    counts = scored.groupBy(*by, "sc").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")).withColumn("one", F.lit(1))
    counts = value_buckets(counts, "sc", value_edges(scored, "sc"))
    frame = running(counts, by, "sc", {"cp": "p", "cn": "n", "rn": "one"})
    edge = Window.partitionBy(*by).orderBy(F.desc("_b"))
    ends = counts.groupBy(*by, "_b").agg(F.max_by(F.struct("p", "n"), "sc").alias("_top"), F.min("sc").alias("_low"))
    ends = ends.select(*by, "_b", F.lead("_top").over(edge).alias("_next"), F.lag("_low").over(edge).alias("_above"))
    inside = Window.partitionBy(*by, "_b").orderBy(F.desc("sc"))
    near = frame.withColumns({"p1": F.lead("p").over(inside), "n1": F.lead("n").over(inside), "before": F.lag("sc").over(inside)})
    near = joined(near, ends, [*by, "_b"])
    return near.select(
        *by, "sc", "p", "n", "cp", "cn", F.col("cp_all").alias("tp"), F.col("cn_all").alias("tn"), "rn", F.col("rn_all").alias("k"),
        F.coalesce("p1", "_next.p").alias("p1"), F.coalesce("n1", "_next.n").alias("n1"), F.coalesce("before", "_above").alias("before"),
    )


AUROC = "try_divide(sum(p * ((tn - cn) + n / 2.0d)), cast(max(tp) as double) * max(tn))"
AVERAGE_PRECISION = "case when max(tn) > 0 then sum(try_divide(cast(p as double), tp) * try_divide(cast(cp as double), cp + cn)) end"
FPR_AT = "case when max(tp) > 0 and max(tn) > 0 then coalesce(min(case when try_divide(cast(cp as double), tp) >= {tpr} {more} then try_divide(cast(cn as double), tn) end), 1.0d) end"
PRUNED = "and (rn = 1 or rn = k or p <> p1 or n <> n1)"


def rank_metrics(scored: DataFrame, by: list[str], tpr: float = 0.95) -> DataFrame:
    """auroc (ties count half), ap, fpr95 and fpr95_pruned (without collinear points); null where a class is missing."""
    frame = cumulative(scored, by)
    return frame.groupBy(*by).agg(F.expr(AUROC).alias("auroc"), F.expr(AVERAGE_PRECISION).alias("ap"), F.expr(FPR_AT.format(tpr=f"{tpr}d", more="")).alias("fpr95"), F.expr(FPR_AT.format(tpr=f"{tpr}d", more=PRUNED)).alias("fpr95_pruned"))


def auroc_by_ranks(scored: DataFrame, by: list[str]) -> DataFrame:
    """The Mann-Whitney form with average ranks of tied scores; null where a class is missing."""
    c = F.col("p") + F.col("n")
    below = F.col("tp") + F.col("tn") - F.col("cp") - F.col("cn")
    ranked = cumulative(scored, by).select(*by, "p", "n", (below + (c + 1) / 2).alias("rank"))
    pos, neg = F.sum("p"), F.sum("n")
    return ranked.groupBy(*by).agg(F.try_divide(F.sum(F.col("rank") * F.col("p")) - pos * (pos + 1) / 2, pos * neg).alias("auroc"))


def threshold_metrics(scored: DataFrame, by: list[str], tau: float) -> DataFrame:
    """Confusion counts at score >= tau, balanced accuracy (over the classes present), Brier, rates, prevalence."""
    hit, fake = F.col("sc") >= tau, F.col("y") == 1
    counts = scored.groupBy(*by).agg(
        F.count_if(hit & fake).alias("tp"), F.count_if(hit & ~fake).alias("fp"), F.count_if(~hit & ~fake).alias("tn"), F.count_if(~hit & fake).alias("fn"),
        F.avg(F.pow(F.col("sc") - F.col("y"), 2)).alias("brier"), F.avg("sc").alias("mean_pred"), F.avg(F.col("y").cast("double")).alias("prevalence"), F.count("*").alias("n"),
    )
    tpr, tnr = F.try_divide("tp", F.col("tp") + F.col("fn")), F.try_divide("tn", F.col("tn") + F.col("fp"))
    return counts.withColumns({"tpr": tpr, "fpr": 1 - tnr, "bacc": F.coalesce((tpr + tnr) / 2, tpr, tnr)})


def bin_of(score: Column, bins: int, closed: str = "left") -> Column:
    """0 to bins - 1 by equal widths: [lo, hi) or (lo, hi], the ends included; compared edge by edge, as the oracle does."""
    edges = F.array(*[F.lit(k * (1.0 / bins)) for k in range(1, bins)])
    over = (lambda e: score >= e) if closed == "left" else (lambda e: score > e)
    return F.size(F.filter(edges, over))


def reliability(scored: DataFrame, by: list[str], bins: int = 15, closed: str = "left") -> DataFrame:
    binned = scored.withColumn("bin", bin_of(F.col("sc"), bins, closed))
    return binned.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("sc").alias("mean_score"), F.avg(F.col("y").cast("double")).alias("rate"))


def calibration_error(scored: DataFrame, by: list[str], bins: int = 15, closed: str = "left") -> DataFrame:
    """ece, the signed gap (mean score less rate) and the share of rows in bins above the diagonal."""
    gap = F.col("mean_score") - F.col("rate")
    total = F.sum("n")
    return reliability(scored, by, bins, closed).groupBy(*by).agg((F.sum(F.col("n") * F.abs(gap)) / total).alias("ece"), (F.sum(F.col("n") * gap) / total).alias("signed_gap"), (F.sum(F.when(gap < 0, F.col("n")).otherwise(0)) / total).alias("above"))


def bundle(scored: DataFrame, by: list[str], tau: float) -> DataFrame:
    """All metrics by key: three aggregates that share their grouping, joined on it."""
    return rank_metrics(scored, by).join(threshold_metrics(scored, by, tau), by).join(calibration_error(scored, by), by)


def per_family(scored: DataFrame, tau: float, bins: int = 15) -> DataFrame:
    """Each family of fakes against all real rows. Fakes and reals run once along the scores: a fake score needs only how
    many reals lie above it, so the reals are not repeated for each family."""
    counts = scored.groupBy(F.when(F.col("y") == 1, F.col("family")).alias("family"), "y", "sc").agg(F.count("*").alias("c"))
    counts = value_buckets(counts.select("family", "y", "sc", (F.col("c") * F.col("y")).alias("p"), (F.col("c") * (1 - F.col("y"))).alias("n")), "sc", value_edges(scored, "sc"))
    line = running(counts, [], "sc", {"cn": "n"}).withColumn("tied", F.sum("n").over(Window.partitionBy("_b", "sc")))
    quiet = scored.where("y = 0").agg(F.try_divide(F.count_if(F.col("sc") < tau), F.count("*")).alias("quiet"))
    fakes = line.where("y = 1").select("family", "sc", "_b", "p", F.col("tied").alias("n"), "cn", F.col("cn_all").alias("tn"))
    frame = running(fakes, ["family"], "sc", {"cp": "p"}).withColumnRenamed("cp_all", "tp")
    recall = F.try_divide(F.sum(F.when(F.col("sc") >= tau, F.col("p")).otherwise(0)), F.sum("p"))
    whole = F.expr(FPR_AT.format(tpr="0.95d", more="")).alias("fpr95")
    found = frame.groupBy("family").agg(F.sum("p").alias("n_fake"), F.max("tn").alias("n_real"), F.expr(AUROC).alias("auroc"), F.expr(AVERAGE_PRECISION).alias("ap"), whole, recall.alias("recall"))
    found = found.join(F.broadcast(quiet)).withColumn("bacc", F.coalesce((F.col("recall") + F.col("quiet")) / 2, "recall")).drop("recall", "quiet")
    return found.join(family_calibration(scored, bins), "family")


def family_calibration(scored: DataFrame, bins: int = 15) -> DataFrame:
    """family, brier and ece of each family of fakes with all reals: sums by bin of the one meet those of the other."""
    binned = scored.select(F.when(F.col("y") == 1, F.col("family")).alias("family"), "y", "sc", bin_of(F.col("sc"), bins).alias("bin"))
    sums = binned.groupBy("family", "y", "bin").agg(F.count("*").alias("n"), F.sum("sc").alias("s"), F.sum(F.pow(F.col("sc") - F.col("y"), 2)).alias("q"))
    fakes, reals = sums.where("y = 1").drop("y"), sums.where("y = 0").select("bin", F.col("n").alias("rn"), F.col("s").alias("rs"), F.col("q").alias("rq"))
    grid = fakes.select("family").distinct().select("family", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    cells = grid.join(fakes, ["family", "bin"], "left").join(F.broadcast(reals), "bin", "left").fillna(0, ["n", "s", "q", "rn", "rs", "rq"])
    n, gap = F.col("n") + F.col("rn"), F.abs(F.col("s") + F.col("rs") - F.col("n"))
    return cells.groupBy("family").agg(F.try_divide(F.sum(F.col("q") + F.col("rq")), F.sum(n)).alias("brier"), F.try_divide(F.sum(gap), F.sum(n)).alias("ece"))


def delta_vs(table: DataFrame, key: str, base: str, metric: str) -> DataFrame:
    """The metric less that of the base row (null where there is none). The table is a few result rows, computed once."""
    first = F.max(F.when(F.col(key) == base, F.col(metric))).over(Window.partitionBy())
    return table.withColumn(f"delta_{metric}", F.col(metric) - first)


def worst(table: DataFrame, key: str, metric: str) -> DataFrame:
    return table.agg(F.min(metric).alias(f"worst_{metric}"), F.min_by(key, F.struct(metric, key)).alias(f"worst_{key}"))
