"""Sharding (operator 2, native): a two-pass external shuffle.

Which shard a record goes to follows from its id and the shard count alone: the shard with the highest seeded hash of
(id, shard) takes it, so one more shard takes records only into itself.

Pass 1 measures bytes and scatters the records of each shard uniformly, by another seeded hash of the whole record, into
buckets that fit in memory (`bucket_bytes`; their number grows with the data). A bucket that many equal records make too
large is dealt again, by row number. Pass 2 holds one bucket at a time as an array in a canonical order, runs Spark's
`shuffle`, a seeded Fisher-Yates, over it and writes it: a folder a shard, bucket by bucket in order. Its seed is
the query's seed plus the partition's number; the number of partitions is given, so AQE does not merge them, and buckets
are sorted within a partition: the order is the same each time, but for buckets that were dealt again. A record's slot is
its place in the bucket plus the counts of the shard's earlier buckets; those counts, one row a bucket, come from what was
written.

Defined cases: a null text has 1 byte of size; a null id is a key like any other; columns named like a result are replaced,
others pass through, maps too; a map inside another column is refused; an empty table gives no rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, new_path, without

RESULTS = ("size", "shard", "slot", "grown_shard")
#: Oversized buckets up to which their list is broadcast.
FEW = 100_000


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The number of the shard whose hash with the key is highest (ties: the lowest number)."""
    weights = F.array(*[F.xxhash64(F.lit(seed), F.lit(s), key) for s in range(shards)])
    return (F.array_position(weights, F.array_max(weights)) - 1).cast("int")


def holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType)


def ordered(field: T.StructField) -> Column:
    """The column in a form that can be hashed and sorted: a map as its entries in order."""
    column = F.col(f"`{field.name}`")
    if not isinstance(field.dataType, T.MapType):
        if holds_map(field.dataType):
            raise ValueError(f"column {field.name}: a map inside another type has no order")
        return column
    if holds_map(field.dataType.keyType) or holds_map(field.dataType.valueType):
        raise ValueError(f"column {field.name}: a map inside another type has no order")
    return F.array_sort(F.map_entries(column))


def shard(docs: DataFrame, shards: int = 8, seed: int = 17, bucket_bytes: int = 8 << 20, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """docs with size, shard, slot (gapless from 0 in each shard) and grown_shard, the shard were there one more. The shards
    are written at `path`, by default in the shared folder, and read from there."""
    spark = docs.sparkSession
    taken = [c for c in RESULTS if c not in (key, text)]
    docs = without(docs, *taken)
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long") + 1
    total = docs.agg(F.sum(size).alias("n")).first()["n"] or 1
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    fields = [ordered(f) for f in docs.schema.fields]
    placed = docs.select(
        shard_of(F.col(f"`{key}`"), shards, seed).alias("shard"),
        F.pmod(F.xxhash64(F.lit(seed + 1), *fields), F.lit(buckets)).cast("int").alias("bucket"),
        size.alias("bytes"),
        F.struct(F.xxhash64(F.lit(seed + 2), *fields).alias("h"), *[f.alias(f"c{i}") for i, f in enumerate(fields)]).alias("record"),
    )
    parts = F.ceil(F.sum("bytes") / bucket_bytes).cast("int")
    large = materialize(placed.groupBy("shard", "bucket").agg(parts.alias("parts")).where("parts > 3"), "large")
    few = large.limit(FEW + 1).count()
    keys = ["shard", "bucket"]
    if few:
        again = placed.join(F.broadcast(large) if few <= FEW else large, keys, "left")
        placed = again.withColumn("part", F.coalesce(F.pmod(F.xxhash64(F.lit(seed + 3), F.monotonically_increasing_id()), F.col("parts")), F.lit(0)).cast("int"))
        keys.append("part")
    whole = (
        placed.repartition(min(int(shards * buckets), 1 << 20), *keys)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("record")).alias("records"))
        .sortWithinPartitions(*keys)
        .select("shard", "bucket", F.col("part") if few else F.lit(0).alias("part"), F.shuffle("records", seed).alias("records"))
    )
    rows = whole.select("shard", "bucket", "part", F.posexplode("records").alias("place", "record"))
    back = [F.map_from_entries(f"record.c{i}").alias(f"c{i}") if isinstance(f.dataType, T.MapType) else F.col(f"record.c{i}").alias(f"c{i}") for i, f in enumerate(docs.schema.fields)]
    out = rows.select("shard", "bucket", "part", "place", *back)
    path = path or new_path(spark, "shards")
    out.write.partitionBy("shard").parquet(path)
    written = spark.read.schema(out.schema).parquet(path)
    counts = written.groupBy("shard", "bucket", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("shard", "bucket", "part", F.coalesce(before, F.lit(0)).alias("base"))
    if shards * buckets <= FEW:
        counts = F.broadcast(counts)
    found = written.join(counts, ["shard", "bucket", "part"])
    names = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    result = found.select(*names, "shard", (F.col("base") + F.col("place")).cast("long").alias("slot"))
    return result.withColumn("size", size).withColumn("grown_shard", shard_of(F.col(f"`{key}`"), shards + 1, seed))
