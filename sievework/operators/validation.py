"""Rules that stop a run, as aggregates over all rows; each gives a table of findings or raises Refused."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Refused(Exception):
    """A rule failed; `code` is the exit code that a command gives for it."""

    def __init__(self, message: str, code: int = 1):
        super().__init__(message)
        self.code = code


def strict_build(counters: dict, strict: bool, keys: tuple[str, ...] = ("missing", "unreadable")) -> bool:
    """Whether the build is complete; a strict one that isn't is refused, after its receipt and partial output were written."""
    short = {k: counters[k] for k in keys if counters.get(k)}
    if strict and short:
        raise Refused(f"incomplete build: {short}", 1)
    return not short


def training_gate(rows: DataFrame, denied: DataFrame | None, key: str, receipt: dict | None) -> None:
    """No table, an incomplete receipt or any row of the denied keys stops training."""
    if denied is None:
        raise Refused("no table of denied keys")
    if not receipt or not receipt.get("complete"):
        raise Refused("the receipt is incomplete")
    hits = rows.join(denied.select(key).distinct(), key, "left_semi").count()
    if hits:
        raise Refused(f"{hits} rows are denied")


def protected_run(protected: bool, allowed: bool, done: bool) -> None:
    if protected and not allowed:
        raise Refused("the protected set needs a flag", 2)
    if protected and done:
        raise Refused("the protected set was evaluated before", 3)


def result_findings(results: DataFrame, alias: Column) -> DataFrame:
    """rule and n of each broken rule: a condition that differs from its file's name, one in two files, a path twice in a
    condition, thresholds that disagree, labels other than 0 and 1, predictions outside 0 to 1."""
    r = results.withColumn("_c", alias)
    files = r.groupBy("_c").agg(F.count_distinct("stem").alias("n"))
    twice = r.where("path is not null").groupBy("_c", "path").count().where("count > 1")
    taus = r.agg(F.count_distinct("threshold").alias("n"))
    bad = lambda c: F.sum(F.when(c, 0).otherwise(1))  # noqa: E731  null is broken too
    rowwise = r.agg(bad(F.col("_c") == F.col("stem")).alias("name"), bad(F.col("label").isin(0, 1)).alias("label"), bad(F.col("pred").between(0.0, 1.0)).alias("pred"))
    found = rowwise.unpivot([], ["name", "label", "pred"], "rule", "n")
    for rule, n in (("file", files.agg(F.count_if(F.col("n") > 1))), ("duplicate", twice.agg(F.count("*"))), ("threshold", taus.select(F.greatest(F.col("n") - 1, F.lit(0))))):
        found = found.unionByName(n.toDF("n").select(F.lit(rule).alias("rule"), F.col("n").cast("long").alias("n")))
    return found.where("n > 0")


def require_none(findings: DataFrame, code: int = 1) -> None:
    rows = findings.orderBy("rule").limit(20).collect()
    if rows:
        raise Refused("; ".join(f"{r['rule']}: {r['n']}" for r in rows), code)


def expected_counts(rows: DataFrame, label: str, expected: dict[int, int]) -> DataFrame:
    """label, n and expected of the labels whose number of rows differs."""
    want = rows.sparkSession.createDataFrame(list(expected.items()), f"{label} int, expected long")
    have = rows.groupBy(F.col(label).cast("int").alias(label)).agg(F.count("*").alias("n"))
    both = want.join(have, label, "full").select(label, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("expected", F.lit(0)).alias("expected"))
    return both.where("n <> expected")


def denylist_state(n_rows: int, complete: bool) -> None:
    if not n_rows:
        raise Refused("the denylist is empty", 1)
    if not complete:
        raise Refused("the denylist is partial", 2)


def threshold_of(text: str | None) -> float:
    """The number in a threshold file; there is no default."""
    try:
        value = float((text or "").strip())
    except ValueError:
        value = -1.0
    if not 0 < value < 1:
        raise Refused("the threshold file must hold a number between 0 and 1")
    return value


def predictions_or_errors(rows: DataFrame, pred: str, error: str, strict: bool) -> DataFrame:
    """Failed rows count as 0.5 and keep their error; a strict run with any, or a run without rows, is refused."""
    n = rows.agg(F.count("*").alias("n"), F.count(error).alias("bad")).first()
    if not n["n"]:
        raise Refused("no records", 4)
    if strict and n["bad"]:
        raise Refused(f"{n['bad']} records failed", 3)
    return rows.withColumn(pred, F.when(F.col(error).isNull(), F.col(pred)).otherwise(0.5))


def same_run(old: dict, new: dict) -> None:
    """A run resumes only with the settings it began with."""
    differ = sorted(k for k in old.keys() | new.keys() if old.get(k) != new.get(k))
    if differ:
        raise Refused(f"settings differ: {differ}")
