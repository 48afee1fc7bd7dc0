"""Shortcut probes: out-of-fold balanced accuracy of a balanced logistic regression on metadata or embeddings."""

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import keyed_hash
from .audits import linked_pairs
from .ranks import hash_places


def folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 17) -> DataFrame:
    """df with fold: rows of each label dealt in the order of a keyed hash."""
    placed = hash_places(df, [label], keyed_hash(F.col(key), "fold", seed), key, "_rank")
    return placed.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def probe(df: DataFrame, features: list[str] | str, label: str, key: str, k: int = 5, least: int = 20) -> float:
    """Balanced accuracy over all folds, each scored by a model of the others; NaN below two classes or `least` rows."""
    sizes = df.groupBy(label).count().collect()
    total = sum(r["count"] for r in sizes)
    if len(sizes) < 2 or total < least:
        return float("nan")
    index = {r[label]: i for i, r in enumerate(sorted(sizes, key=lambda r: r[label]))}
    weight = {r[label]: total / (len(sizes) * r["count"]) for r in sizes}
    lookup = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col(label)]
    dealt = folds(df, label, key, k)
    if isinstance(features, str):
        rows = dealt.withColumn("raw", array_to_vector(features))
    else:
        rows = VectorAssembler(inputCols=features, outputCol="raw").transform(dealt)
    rows = rows.select("fold", "raw", lookup({a: float(b) for a, b in index.items()}).alias("y"), lookup(weight).alias("w")).cache()
    hits = []
    for f in range(k):
        train, test = rows.where(F.col("fold") != f), rows.where(F.col("fold") == f)
        scaler = StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True).fit(train)
        mass, n = train.agg(F.sum("w"), F.count("*")).first()
        # population standard deviation: features grow by sqrt(n / (n - 1)), which is the same as a penalty smaller by (n - 1) / n
        model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=200, regParam=(n - 1) / n / mass, standardization=False).fit(scaler.transform(train))
        hits.append(model.transform(scaler.transform(test)).select("y", (F.col("prediction") == F.col("y")).cast("int").alias("hit")))
    out = hits[0]
    for h in hits[1:]:
        out = out.union(h)
    recall = out.groupBy("y").agg(F.avg("hit").alias("r")).agg(F.avg("r")).first()[0]
    rows.unpersist()
    return float(recall)


def contrasts(rows: DataFrame, links: DataFrame, features: str, label: str, group: str, key: str, parent: str, least: int = 20) -> dict[str, float]:
    """Balanced accuracies of five contrasts: all rows by label, the rows of linked pairs by label, the groups of each label,
    and the gap between the first two, which tells how much rests on content. Missing ones are NaN."""
    nan = float("nan")
    pairs = linked_pairs(rows, links, key, parent)
    ends = pairs.select(key).union(pairs.select(F.col(parent).alias(key))).distinct()
    out = {"label_all": probe(rows, features, label, key)}
    out["label_matched"] = probe(rows.join(ends, key, "left_semi"), features, label, key) if pairs.limit(least).count() >= least else nan
    for name, value in (("real_source", 0), ("fake_family", 1)):
        out[name] = probe(rows.where(F.col(label) == value), features, group, key)
    out["content_gap"] = out["label_all"] - out["label_matched"]
    return out


def gate(rows: DataFrame, metadata: dict[str, list[str]], label: str, key: str, embeddings: DataFrame | None = None, features: str = "embedding") -> dict[str, float]:
    """The probes of metadata, and that of embeddings (by key) where there are any; without them the others still run."""
    out = {name: probe(rows, columns, label, key) for name, columns in metadata.items()}
    if embeddings is not None:
        out["embedding"] = probe(rows.select(key, label).join(embeddings.select(key, features), key), features, label, key)
    return out


def gate_code(values: dict[str, float], gate: float = 0.6) -> int:
    """The exit code of the gate: 1 if any value reaches it, else 0; NaN passes."""
    return int(any(v >= gate for v in values.values()))


def verdict(values: DataFrame, column: str, gate: float = 0.6) -> DataFrame:
    """Passes if every value is below the gate or not a number (NaN compares as equal in SQL, so it is asked for)."""
    return values.agg(F.bool_and(F.isnan(column) | (F.col(column) < gate)).alias("passes"))
