"""Audits, links between tables and small table helpers: each is a join, an aggregate or a projection."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import keyed_hash
from .curation import first_rows


def keep_set(rows: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    return rows.join(kept.select(key).distinct(), key, "left_semi")


def differing(own: DataFrame, given: DataFrame, on: list[str], columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """on, column, own and given of every value that differs by more than the tolerance, or that only one table has."""
    pairs = lambda df, name: df.select(*on, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias(name)) for c in columns])).alias("x")).select(*on, "x.*")
    both = pairs(own, "own").join(pairs(given, "given"), [*on, "column"], "full")
    same = (F.abs(F.col("own") - F.col("given")) <= tolerance) | (F.col("own").isNull() & F.col("given").isNull())
    return both.where(~F.coalesce(same, F.lit(False)))


def union_first(tables: list[DataFrame], key: str) -> DataFrame:
    """The rows of all tables by name, one a key: that of the earliest table."""
    out = None
    for i, df in enumerate(tables):
        own = df.withColumn("_table", F.lit(i))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in (key, "_table")]
    return first_rows(out, [key], ["_table", *rest]).drop("_table")


def last_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One value a key, the one that comes last."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def moving_average(values: Column, decay: float) -> Column:
    """The exponential moving average over an ordered array; the first value starts it."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, 0), lambda a, x: decay * a + (1 - decay) * x)


def linked_pairs(rows: DataFrame, links: DataFrame, key: str, parent: str) -> DataFrame:
    """key and parent of links both of whose ends are among the rows."""
    have = rows.select(key).distinct()
    return links.join(have, key, "left_semi").join(have.select(F.col(key).alias(parent)), parent, "left_semi").select(key, parent)


def sample_with_pairs(rows: DataFrame, links: DataFrame, key: str, parent: str, label: str, per_label: int, pairs: int, seed: int = 17) -> DataFrame:
    """Keys of a sample: so many rows of each label by a keyed hash, and both ends of so many linked pairs."""
    order = lambda c, purpose: [keyed_hash(F.col(c), purpose, seed), F.col(c)]
    plain = first_rows(rows, [label], order(key, "pairs"), per_label).select(key)
    forced = linked_pairs(rows, links, key, parent).orderBy(*order(key, "forced")).limit(pairs)
    return plain.union(forced.select(key)).union(forced.select(parent)).distinct()


def random_subset(rows: DataFrame, key: str, most: int, seed: int = 17) -> DataFrame:
    """`most` rows by a keyed hash, in the order of their keys."""
    return rows.orderBy(keyed_hash(F.col(key), "subset", seed), key).limit(most).orderBy(key)


def head(rows: DataFrame, most: int, order: list[str]) -> DataFrame:
    return rows.orderBy(*order).limit(most)


def window_or_nearest(samples: DataFrame, time: str, since, until) -> DataFrame:
    """The samples from `since` to `until`; if there are none, the last one before and the first one after. `widened` tells which."""
    t = F.col(time)
    state = samples.agg(F.count_if(t.between(since, until)).alias("_n"), F.max(F.when(t <= since, t)).alias("_low"), F.min(F.when(t >= until, t)).alias("_high"))
    near = samples.join(F.broadcast(state))
    inside = F.when(F.col("_n") > 0, t.between(since, until)).otherwise((t == F.col("_low")) | (t == F.col("_high")))
    return near.where(inside).withColumn("widened", F.col("_n") == 0).drop("_n", "_low", "_high")


def group_offsets(groups: DataFrame, file: str, place: str, rows: str) -> DataFrame:
    """The number of rows before each group of a file: one row a row group, so the window runs over metadata only."""
    before = Window.partitionBy(file).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return groups.withColumn("base", F.coalesce(F.sum(rows).over(before), F.lit(0)).cast("long"))


def config_grid(spark, **values) -> DataFrame:
    """Every combination of the values, one column each."""
    out = None
    for name, own in values.items():
        one = spark.createDataFrame([(v,) for v in own], [name])
        out = one if out is None else out.crossJoin(F.broadcast(one))  # the values are the caller's own short lists
    return out


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """A percentage; 0 of nothing."""
    return F.when(whole == 0, 0.0).otherwise(F.round(100 * part / whole, digits))


def complete(rows: DataFrame, missing: str, unreadable: str) -> DataFrame:
    """Whether no row counts anything missing or unreadable."""
    return rows.agg(F.coalesce(F.bool_and((F.col(missing) == 0) & (F.col(unreadable) == 0)), F.lit(True)).alias("complete"))
