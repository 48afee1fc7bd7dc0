"""Operating points and decision curves, over distinct scores or aggregates, never over rows times thresholds."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import cumulative


def freeze_threshold(scored: DataFrame, by: list[str], max_fpr: float = 0.05) -> DataFrame:
    """tau with the best balanced accuracy among thresholds with FPR <= max_fpr; of equals the lowest. Thresholds lie
    midway between neighbouring scores, just below the least and just above the greatest. Without both classes, or without
    such a threshold, a key's row holds nulls."""
    frame = cumulative(scored, by)
    middle = F.when(F.col("rn") == 1, F.col("sc") + 1e-9).otherwise((F.col("sc") + F.col("before")) / 2)
    cut = frame.select(*by, middle.alias("t"), F.try_divide(F.col("cn") - F.col("n"), "tn").alias("fpr"), F.try_divide(F.col("cp") - F.col("p"), "tp").alias("tpr"))
    low = frame.where("rn = k").select(*by, (F.col("sc") - 1e-9).alias("t"), F.lit(1.0).alias("fpr"), F.lit(1.0).alias("tpr"))
    points = cut.unionByName(low)
    score = (1 - F.col("fpr") + F.col("tpr")) / 2
    order = F.when((F.col("fpr") <= max_fpr) & F.col("tpr").isNotNull(), F.struct(score, -F.col("t")))
    best = F.max_by(F.struct("t", "fpr", "tpr", score.alias("bacc")), order)
    return points.groupBy(*by).agg(best.alias("x")).select(*by, "x.*")


def net_benefit(scored: DataFrame, by: list[str], steps: int = 100) -> DataFrame:
    """Net benefit at thresholds 1/steps to 1 - 1/steps, beside treating all. Each score adds to the number of the last
    threshold it reaches; suffix sums give the counts, so the grid meets counts, not rows."""
    near = F.floor(F.col("sc") * steps)  # off by one at most, as thresholds are k / steps rounded
    reached = F.when(F.col("sc") >= (near + 1) / float(steps), near + 1).when(F.col("sc") >= near / float(steps), near).otherwise(near - 1)
    last = F.least(F.lit(steps - 1), F.greatest(F.lit(0), reached)).cast("int")
    hits = scored.groupBy(*by, last.alias("g")).agg(F.sum("y").alias("p"), F.count("*").alias("c"))
    keys = hits.select(*by).distinct() if by else None
    grid = scored.sparkSession.range(0, steps).select(F.col("id").cast("int").alias("g"))
    full = (keys.crossJoin(F.broadcast(grid)) if by else grid).join(hits, [*by, "g"], "left").fillna(0, ["p", "c"])
    up = Window.partitionBy(*by).orderBy(F.desc("g")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)  # over `steps` rows a key, not over scores
    counts = full.select(*by, "g", F.sum("p").over(up).alias("tp"), F.sum(F.col("c") - F.col("p")).over(up).alias("fp"), F.sum("c").over(whole).alias("n"), F.sum("p").over(whole).alias("pos"))
    pt = F.col("g") / float(steps)
    odds = pt / (1 - pt)
    return counts.where("g > 0").select(*by, pt.alias("pt"), "tp", "fp", (F.col("tp") / F.col("n") - F.col("fp") / F.col("n") * odds).alias("net_benefit"), (F.col("pos") / F.col("n") - (1 - F.col("pos") / F.col("n")) * odds).alias("treat_all"))


def first_negative(curve: DataFrame, by: list[str]) -> DataFrame:
    """The first threshold with negative net benefit, and where the curve is lowest (the earliest of equals)."""
    low = F.min_by("pt", F.struct("net_benefit", "pt"))
    return curve.groupBy(*by).agg(F.min(F.when(F.col("net_benefit") < 0, F.col("pt"))).alias("first_negative"), low.alias("lowest_at"), F.min("net_benefit").alias("lowest"))


def bootstrap_accuracy(scored: DataFrame, by: list[str], tau: float, replicates: int = 1000, seed: int = 17, level: float = 0.95) -> DataFrame:
    """by, low and high: the percentile interval of the balanced accuracy at tau over resamples within each class.

    How many of a class's n draws with replacement hit one of its h right rows is binomial (n, h / n), so a replicate needs
    two draws, whatever the size of the table. A class without rows is left out of the mean; without rows the result is null.
    """
    right = (F.col("sc") >= tau) == (F.col("y") == 1)
    classes = scored.groupBy(*by, "y").agg(F.count("*").alias("n"), F.count_if(right).alias("h"))
    name = F.xxhash64(F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by], "y")

    def draw(keys: pd.Series, ns: pd.Series, hits: pd.Series) -> pd.Series:
        out = [np.random.default_rng(k & (1 << 63) - 1).binomial(n, h / n, replicates) / n for k, n, h in zip(keys, ns, hits)]
        return pd.Series(out)

    recalls = classes.select(*by, "y", F.pandas_udf(draw, "array<double>")(name, F.col("n"), F.col("h")).alias("r"))
    mean = recalls.select(*by, F.posexplode("r").alias("b", "recall")).groupBy(*by, "b").agg(F.avg("recall").alias("v"))
    edge = (1 - level) / 2
    return mean.groupBy(*by).agg(F.percentile("v", F.lit(edge)).alias("low"), F.percentile("v", F.lit(1 - edge)).alias("high"))


def thin(scored: DataFrame, by: list[str], least: int = 100) -> DataFrame:
    """Keys with fewer than `least` rows, with their number."""
    return scored.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") < least)


def nll_grid(logits: DataFrame, temperatures: list[float], alphas: list[float]) -> DataFrame:
    """Mean negative log-likelihood at each (temperature, alpha), over distinct (logit, label) with counts."""
    spark = logits.sparkSession
    grid = spark.createDataFrame([(t, a) for t in temperatures for a in alphas], "t double, a double")
    counts = logits.groupBy("z", "y").count()
    z = (F.col("z") + F.col("a")) / F.col("t")
    loss = F.greatest(z, F.lit(0.0)) - z * F.col("y") + F.log1p(F.exp(-F.abs(z)))
    return counts.join(F.broadcast(grid)).groupBy("t", "a").agg((F.sum(loss * F.col("count")) / F.sum("count")).alias("nll"))


def fit_temperature(logits: DataFrame, rounds: int = 40) -> tuple[float, float, float]:
    """Temperature, alpha and loss: the best of a coarse grid, then coordinate steps that halve when nothing improves.
    Each round is one aggregate over five candidates.

    Rows of infinite logits are left out of the fit and its loss: no temperature changes theirs. Without others the fit is
    (1, 0), with a loss of NaN."""
    logits = logits.where(F.abs("z") < float("inf"))
    grid = nll_grid(logits, [0.05 * 400 ** (i / 59) for i in range(60)], [-5 + 0.25 * i for i in range(41)])
    best = grid.orderBy("nll", "t", "a").first()
    if best is None:
        return 1.0, 0.0, math.nan
    t, a, loss, step = best["t"], best["a"], best["nll"], 0.25
    for _ in range(rounds):
        tried = nll_grid(logits, sorted({t, t * (1 + step), t / (1 + step)}), sorted({a, a + step, a - step})).orderBy("nll", "t", "a").first()
        if tried["nll"] < loss - 1e-12:
            t, a, loss = tried["t"], tried["a"], tried["nll"]
        else:
            step /= 2
            if step < 1e-4 or math.isnan(loss):
                break
    return t, a, loss
