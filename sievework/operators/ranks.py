"""Places and running sums within keys, without a window over a whole key.

Few keys may hold all rows, so a window by key would sort the table in as many tasks. Here the rows of a key are cut into
buckets that follow the order (by quantiles of a value, or by the leading digits of a hash); a window runs in each bucket,
and what the earlier buckets hold comes from one row a bucket.
"""

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEX_DIGITS = 3


def same(left: DataFrame, right: DataFrame, by: list[str]) -> Column:
    """Equality on columns whose copies on the right begin with `_k_`; null is a key like any other."""
    on = F.lit(True)
    for c in by:
        on = on & left[c].eqNullSafe(right[f"_k_{c}"])
    return on


def joined(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    right = right.select(*[F.col(c).alias(f"_k_{c}") for c in by], *[F.col(c) for c in right.columns if c not in by])
    return left.join(right, same(left, right, by), how).drop(*[f"_k_{c}" for c in by])


def value_edges(df: DataFrame, value: str, buckets: int | None = None) -> list[float]:
    """Approximate quantiles that cut `value` into buckets: one aggregate without a shuffle of rows; the driver gets them.
    They only balance work; no result depends on them."""
    buckets = buckets or max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = df.agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 10 * buckets).alias("e")).first()["e"]
    return sorted({float(e) for e in found or [] if e == e})


def value_buckets(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """df with `_b`, a bucket number that does not fall as `value` grows; equal values share one."""
    if not edges:
        return df.withColumn("_b", F.lit(0.0))
    return Bucketizer(splits=[-float("inf"), *edges, float("inf")], inputCol=value, outputCol="_b", handleInvalid="keep").transform(df)


def running(df: DataFrame, by: list[str], order: str, sums: dict[str, str], descending: bool = True) -> DataFrame:
    """df (with `_b` in the order of `order`) with inclusive running sums: sums maps a new column to the one that is summed.
    Rows equal in `order` get the same sum. A column `{name}_all` holds the key's total."""
    turn = F.desc if descending else F.asc
    inside = Window.partitionBy(*by, "_b").orderBy(turn(order)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*by).orderBy(turn("_b")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    parts = df.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    parts = parts.select(*by, "_b", *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_e_{n}") for n in sums], *[F.sum(f"_s_{n}").over(whole).alias(f"{n}_all") for n in sums])
    own = df.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    out = joined(own, parts, [*by, "_b"])
    return out.withColumns({n: F.col(n) + F.col(f"_e_{n}") for n in sums}).drop(*[f"_e_{n}" for n in sums])


def hash_places(df: DataFrame, by: list[str], digest: Column, key: str, name: str = "place") -> DataFrame:
    """df with `name`, the place (from 1) of each row within `by` in the order of a hexadecimal hash, then of `key`."""
    own = df.withColumn("_h", digest).withColumn("_b", F.substring("_h", 1, HEX_DIGITS))
    parts = own.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_e"))
    own = own.withColumn(name, F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", key)))
    return joined(own, parts, [*by, "_b"]).withColumn(name, F.col(name) + F.col("_e")).drop("_h", "_b", "_e")


def quantiles(df: DataFrame, by: list[str], value: Column, shares: list[float]) -> DataFrame:
    """by, k and edge: the exact quantile at shares[k], linear between neighbours. Nulls don't count; distinct values are
    rows, never the state of one aggregate."""
    values = df.select(*by, value.cast("double").alias("_v")).where("_v is not null")
    counts = values.groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    run = running(value_buckets(counts, "_v", value_edges(values, "_v")), by, "_v", {"_upto": "_c"}, descending=False)
    last = (F.col("_upto_all") - 1).cast("double")
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), (last * s).alias("at")) for k, s in enumerate(shares)])
    holds = lambda i: (i >= F.col("_upto") - F.col("_c")) & (i < F.col("_upto"))
    own = F.filter(wanted, lambda w: holds(F.floor(w["at"])) | holds(F.ceil(w["at"])))
    hit = run.select(*by, "_v", (F.col("_upto") - F.col("_c")).alias("_from"), "_upto", F.explode(own).alias("w"))
    inside = lambda i: (i >= F.col("_from")) & (i < F.col("_upto"))
    low = F.max(F.when(inside(F.floor("w.at")), F.col("_v")))
    high = F.max(F.when(inside(F.ceil("w.at")), F.col("_v")))
    part = F.max(F.col("w.at") - F.floor("w.at"))
    return hit.groupBy(*by, F.col("w.k").alias("k")).agg((low + (high - low) * part).alias("edge"))
