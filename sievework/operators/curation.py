"""Curation of labelled corpora: gates, deduplication, caps, balance, group splits, matching, sampling.

Every random choice ranks rows by a keyed hash, so results don't depend on partitions or row order.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import hamming64, keyed_hash
from .ranks import hash_places, joined, quantiles

#: Rows of a table of keys up to which it is broadcast.
FEW = 100_000


def beside_keys(df: DataFrame, table: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """df joined to a table with one row a key; the table is broadcast if the keys of df are proven to be few."""
    few = df.select(*by).distinct().limit(FEW + 1).count() <= FEW
    return joined(df, F.broadcast(table) if few else table, by, how)


def first_rows(df: DataFrame, by: list[str], order: list, most: int = 1) -> DataFrame:
    """The first `most` rows of each key by an explicit order (Spark limits groups before the shuffle)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= most).drop("_rn")


def cap(df: DataFrame, by: str, key: str, most: int, seed: int = 17) -> DataFrame:
    return first_rows(df, [by], [keyed_hash(F.col(key), "cap", seed), F.col(key)], most)


def quotas(df: DataFrame, label: str, bucket: str) -> DataFrame:
    """Largest-remainder quotas that shrink each label to the size of the smallest, bucket by bucket. One row a bucket."""
    sizes = df.groupBy(label, bucket).count()
    totals = sizes.groupBy(label).agg(F.sum("count").alias("total"))
    target = totals.agg(F.min("total").alias("target"))
    share = sizes.join(totals, label).join(F.broadcast(target)).withColumn("exact", F.col("count") * F.col("target") / F.col("total"))
    part = share.withColumn("floor", F.floor("exact").cast("long"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.desc(F.col("exact") - F.col("floor")), bucket))
    short = F.col("target") - F.sum("floor").over(Window.partitionBy(label))
    return part.select(label, bucket, "count", (F.col("floor") + F.when(rank <= short, 1).otherwise(0)).alias("quota"))


def balance(df: DataFrame, label: str, bucket: str, key: str, seed: int = 17) -> DataFrame:
    own = quotas(df, label, bucket).select(label, bucket, F.col("quota").alias("_quota"))
    placed = hash_places(df, [label, bucket], keyed_hash(F.col(key), "balance", seed), key, "_rn")
    return beside_keys(placed, own, [label, bucket]).where("_rn <= _quota").drop("_rn", "_quota")


def group_split(df: DataFrame, group: str, bucket: str, order: str, dev: float = 0.1, calib: float = 0.1, seed: int = 17) -> DataFrame:
    """group -> split; a group moves as one and belongs to the bucket of its first row. Counts round half to even."""
    groups = df.groupBy(group).agg(F.min_by(bucket, order).alias("bucket"))
    placed = hash_places(groups, ["bucket"], keyed_hash(F.col(group), "split", seed), group, "_rank")
    ranked = beside_keys(placed, groups.groupBy("bucket").agg(F.count("*").alias("_n")), ["bucket"])
    n_dev, n_cal = F.bround(F.col("_n") * dev), F.bround(F.col("_n") * calib)
    return ranked.select(group, "bucket", F.when(F.col("_rank") <= n_dev, "dev").when(F.col("_rank") <= n_dev + n_cal, "calib").otherwise("train").alias("split"))


def quantile_bins(df: DataFrame, stratum: str, value: str, bins: int = 40) -> DataFrame:
    """df with bin: where log1p(value) lies among the stratum's quantiles (to nine digits, so that any engine agrees)."""
    x = F.log1p(F.col(value).cast("double"))
    cuts = quantiles(df, [stratum], x, [i / bins for i in range(bins + 1)])
    edges = cuts.groupBy(stratum).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("k", "edge"))), lambda e: e["edge"])).alias("_edges"))
    inner = F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    return beside_keys(df, edges, [stratum], "left").withColumn("bin", F.coalesce(F.size(F.filter(inner, lambda e: F.round(e, 9) <= F.round(x, 9))), F.lit(0))).drop("_edges")


def cell_least(binned: DataFrame, stratum: str, label: str) -> DataFrame:
    """binned with _least: the rows of the rarer label in each cell (stratum, bin)."""
    cells = binned.groupBy(stratum, "bin").agg(F.least(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).alias("_least"))
    return beside_keys(binned, cells, [stratum, "bin"])


def matched(df: DataFrame, stratum: str, value: str, label: str, key: str, bins: int = 40, seed: int = 17) -> DataFrame:
    """Rows kept so that in every stratum and quantile bin of log1p(value) both labels are equally many."""
    cells = cell_least(quantile_bins(df.where(F.col(label).isNotNull()), stratum, value, bins), stratum, label)
    placed = hash_places(cells, [stratum, "bin", label], keyed_hash(F.col(key), "match", seed), key, "_rn")
    return placed.where("_rn <= _least").drop("_least", "_rn")


def mark_denied(rows: DataFrame, hashes: DataFrame, paths: DataFrame, prints: DataFrame, families: list[str], sources: list[str], most: int = 4) -> DataFrame:
    """rows (sha, path, family, source and the 64-bit hash h) with split: "denied" where any gate holds, else "unassigned".

    Gates: family and source (without case), path, content hash, and a hash at most `most` bits from a denied one. They
    mark and never drop; without denied hashes or prints the other gates still hold.
    """
    flag = lambda df, name: df.distinct().withColumn(name, F.lit(True))
    near = flag(near_hashes(rows.where("h is not null").select("h").distinct(), prints.select("h"), most).select("h"), "_near")
    out = rows.join(flag(hashes.select("sha"), "_hash"), "sha", "left").join(flag(paths.select("path"), "_path"), "path", "left").join(near, "h", "left")
    hit = F.coalesce(F.lower("family").isin(families), F.lit(False)) | F.coalesce(F.lower("source").isin(sources), F.lit(False))
    hit = hit | F.col("_hash").isNotNull() | F.col("_path").isNotNull() | F.col("_near").isNotNull()
    return out.withColumn("split", F.when(hit, "denied").otherwise("unassigned")).drop("_hash", "_path", "_near")


def of_split(rows: DataFrame, split: str | None = None) -> DataFrame:
    """Rows of one split, or, without a name, all that are not denied; a table without the column passes whole."""
    if "split" not in rows.columns:
        return rows
    own = F.coalesce(F.col("split"), F.lit(""))
    return rows.where(own != "denied") if split is None else rows.where(own == split)


def near_hashes(left: DataFrame, deny: DataFrame, most: int, small: int = 20_000) -> DataFrame:
    """left rows (key, h) with a denied 64-bit hash at most `most` bits away. Beyond `small` denied hashes, up to 7 bits go
    through most + 1 bands, one of which must agree (pigeonhole), and are verified; more bits leave bands too short to
    select, so the denied hashes are compared in blocks of about `small`, each a broadcast of its own."""
    hashes = deny.select(F.col("h").alias("g")).distinct()
    total = hashes.count()
    if total > small and most <= 7:
        return near_hashes_banded(left, deny, most)
    blocks = max(1, -(-total // small))
    found = None
    for block in range(blocks):
        own = hashes.where(F.pmod(F.xxhash64("g"), F.lit(blocks)) == block) if blocks > 1 else hashes
        hit = left.select("h").distinct().join(F.broadcast(own), hamming64(F.col("h"), F.col("g")) <= most, "left_semi")
        found = hit if found is None else found.union(hit)
    return left.join(found.distinct(), "h", "left_semi")


def near_hashes_banded(left: DataFrame, deny: DataFrame, most: int) -> DataFrame:
    return left.join(near_pairs_banded(left, deny, most).select("h").distinct(), "h", "left_semi")


def near_pairs_banded(left: DataFrame, deny: DataFrame, most: int) -> DataFrame:
    """h of left and g of deny, at most `most` bits apart; a pair comes once for each band in which it agrees."""
    if most > 7:
        raise ValueError("bands of fewer than eight bits select too little")
    hashes = deny.select(F.col("h").alias("g")).distinct()
    found = left.select("h").distinct().select("h", bands(F.col("h"), most).alias("band")).join(hashes.select("g", bands(F.col("g"), most).alias("band")), "band")
    return found.where(hamming64(F.col("h"), F.col("g")) <= most).select("h", "g")


def bands(h: Column, most: int) -> Column:
    cuts = [i * 64 // (most + 1) for i in range(most + 2)]
    part = lambda a, b: F.shiftrightunsigned(h, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
    return F.explode(F.array(*[F.struct(F.lit(i).alias("i"), part(a, b).alias("v")) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]))


def longest_prefix(paths: DataFrame, archives: DataFrame, path: str, prefix: str) -> DataFrame:
    """Each path with the longest listed prefix that ends at one of its slashes: prefixes are exploded and equi-joined."""
    parts = F.split(F.col(path), "/")
    tried = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    found = paths.select("*", F.explode(tried).alias(prefix)).join(archives.select(prefix).distinct(), prefix)
    best = found.groupBy(path).agg(F.max_by(prefix, F.length(prefix)).alias(prefix))
    return paths.join(best, path, "left")
