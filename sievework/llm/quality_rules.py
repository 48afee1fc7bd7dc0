"""Quality rules (operator 6): risk-controlled thresholds.

Rules are ratios of a text (see `RULES`); a document is rejected by a rule whose ratio exceeds the cutoff of its stratum.
Labelled documents choose the cutoffs. Half of them (by a hash of the id) propose: at level t, a rule's cutoff is the
lowest value of a fixed grid that at most a share t of the stratum's good documents exceeds. The other half tests: levels
are tried from the most lenient on, and a level passes if the exact binomial probability of so few false rejections,
were the true rate `risk`, is at most `error` / number of strata. The first level that fails ends the sequence, so the
order needs no further correction; Bonferroni covers the strata. With probability 1 - `error`, no stratum rejects more
than a share `risk` of its good documents by these cutoffs. A stratum without enough labels rejects nothing by them.

What goes to the driver are counts by stratum, rule and grid value. Texts are read once and not shuffled; features are
written to the shared folder, since cutoffs and verdicts need them.

Defined cases: a null text has no words; a null stratum is a stratum of its own; a null or missing label is no label; an
id with several labels is good only if all are 1; an id that repeats gets a verdict for each row; an empty table gives
no rows; columns named like a result are not carried.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, by_bytes, materialize, trimming

SYMBOLS = b"#*$%&|<>"
FEW = 100_000
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits")
UPPER, MARKS, DIGITS = bytes(range(65, 91)), b"!?", bytes(range(48, 58))
#: Ratios; each grows with what it holds against a text.
RULES = {
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_upper / greatest(word_chars, 1)",
    "shouts": "n_marks / greatest(n_words, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
}
GRID = [0.0, *[round(0.002 * 1.12**i, 6) for i in range(70)]]
LEVELS = [0.0, 0.0005, 0.001, 0.002, 0.005, 0.01]
STEP, STEP2, STEP4 = (np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in (1, 2, 4))


def repeated_words(words: list[bytes], size: int = 8) -> int:
    """The number of words in windows of `size` words that occur at least twice."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    if size == 8:
        with np.errstate(over="ignore"):
            h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
            h = h[:-1] * STEP + h[1:]
            h = h[:-2] * STEP2 + h[2:]
            h = h[:-4] * STEP4 + h[4:]
        ordered = np.sort(h)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            return 0
        at = np.flatnonzero(np.isin(h, twice)).tolist()
    else:
        at = range(n)
    seen: dict[tuple, list[int]] = {}  # equal hashes are candidates; the words decide
    for i in at:
        seen.setdefault(tuple(words[i : i + size]), []).append(i)
    edge = np.zeros(len(words) + 1, np.int32)
    for places in seen.values():
        if len(places) > 1:
            np.add.at(edge, places, 1)
            np.add.at(edge, [p + size for p in places], -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def text_features(body: bytes) -> tuple[int, ...]:
    words, lines = body.split(), body.split(b"\n")
    full = [x for x in lines if x.strip(SPACE)]
    without = lambda drop: len(body) - len(body.translate(None, drop))
    chars = len(body.decode("utf-8")) - without(SPACE)
    return len(words), chars, without(SYMBOLS), len(full) - len(set(full)), repeated_words(words), len(full), without(UPPER), without(MARKS), without(DIGITS)


def features(docs: DataFrame, stratum: str = "lang", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, stratum and the counts of `FEATURES` of each whole text, and the columns `carry` of its row as a struct `carried`."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in trimming(batches):
            out = np.zeros((len(texts), len(FEATURES)), np.int64)
            sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
            for a, b in by_bytes(sizes, 8 << 20):
                out[a:b] = [text_features(x or b"") for x in texts.slice(a, b - a).to_pylist()]
            yield pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in out.T], names=list(FEATURES))

    found = F.arrow_udf(run, f"struct<{', '.join(f'{c}: bigint' for c in FEATURES)}>")(F.col(f"`{text}`").cast("binary"))
    more = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    rows = docs.select("doc_id", F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("")).alias("stratum"), *more, found.alias("found"))
    return rows.select("doc_id", "stratum", "found.*", *(["carried"] if carry else []))


def small(table: DataFrame, n: int) -> DataFrame:
    """A table that the driver made, broadcast up to `FEW` rows: texts' features need not be shuffled to meet it."""
    return F.broadcast(table) if n <= FEW else table


def binomial_tail(x: int, n: int, p: float) -> float:
    """P(X <= x) of a binomial, exactly summed in logarithms."""
    if x >= n:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(x + 1)]
    top = max(log)
    return min(1.0, math.exp(top) * math.fsum(math.exp(v - top) for v in log))


def upper_bound(x: int, n: int, error: float) -> float:
    """The Clopper-Pearson upper bound of a rate, by bisection."""
    if not n or x >= n:
        return 1.0
    low, high = x / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_tail(x, n, mid) > error else (low, mid)
    return high


def fit_cutoffs(feats: DataFrame, labels: DataFrame, risk: float = 0.02, error: float = 0.05) -> list[dict]:
    """One row for each stratum and rule with a certified cutoff, with the level and the bound of its false rejections."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good = feats.join(marks.where("quality = 1"), "doc_id").select("stratum", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("proposes"), *[F.expr(e).alias(r) for r, e in RULES.items()])
    good = materialize(good, "labelled")
    grid = F.array(*[F.lit(float(g)) for g in GRID])
    place = lambda r: F.size(F.filter(grid, lambda g: g < F.col(r)))  # noqa: E731  cutoffs below the value, all of which reject it
    long = good.where("proposes").select("stratum", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), place(r).alias("bin")) for r in RULES])).alias("x"))
    counts: dict[str, dict[str, np.ndarray]] = {}
    for row in long.groupBy("stratum", "x.rule", "x.bin").count().collect():
        counts.setdefault(row["stratum"], {}).setdefault(row["rule"], np.zeros(len(GRID) + 1, np.int64))[row["bin"]] += row["count"]
    if not counts:
        return []
    cuts: dict[tuple[str, int, str], float | None] = {}
    for s, own in counts.items():
        for rule, c in own.items():
            over = c[::-1].cumsum()[::-1]  # over[i + 1]: good documents that GRID[i] rejects
            for t, level in enumerate(LEVELS):
                fits = np.flatnonzero(over[1:] <= level * c.sum())
                cuts[s, t, rule] = GRID[fits[0]] if len(fits) else None
    rows = [(s, t, *[cuts[s, t, r] for r in RULES]) for s in counts for t in range(len(LEVELS))]
    table = good.sparkSession.createDataFrame(rows, f"stratum string, level int, {', '.join(f'cut_{r} double' for r in RULES)}")
    out = F.lit(False)
    for r in RULES:
        out = out | F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))
    tested = good.where("not proposes").join(small(table, len(rows)), "stratum").groupBy("stratum", "level").agg(F.count("*").alias("n"), F.count_if(out).alias("x")).collect()
    tests = {(r["stratum"], r["level"]): (r["x"], r["n"]) for r in tested}
    found = []
    for s in counts:
        best = None
        for t in range(len(LEVELS)):
            x, n = tests.get((s, t), (0, 0))
            if not n or binomial_tail(x, n, risk) > error / len(counts):
                break
            best = (t, x, n)
        if best:
            t, x, n = best
            bound = upper_bound(x, n, error / len(counts))
            found += [{"stratum": s, "rule": r, "cutoff": cuts[s, t, r], "level": LEVELS[t], "rejected": x, "tested": n, "bound": bound} for r in RULES if cuts[s, t, r] is not None]
    return found


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text: str = "text", risk: float = 0.02, error: float = 0.05, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, stratum, the features, base_failed, the rules that reject (`failed_rules`) and kept, for each row of docs;
    with `carry`, those columns of the row too, as a struct `carried`."""
    feats = materialize(features(docs, stratum, text, carry), "features")
    found = fit_cutoffs(feats, labels, risk, error)
    by_stratum: dict[str, dict] = {}
    for f in found:
        by_stratum.setdefault(f["stratum"], {})[f["rule"]] = f["cutoff"]
    wide = feats.sparkSession.createDataFrame([(k, *[v.get(r) for r in RULES]) for k, v in by_stratum.items()], f"stratum string, {', '.join(f'cut_{r} double' for r in RULES)}")
    failed = F.array_compact(F.array(*[F.when(F.expr(e) > F.col(f"cut_{r}"), F.lit(r)) for r, e in RULES.items()]))
    out = feats.join(small(wide, len(by_stratum)), "stratum", "left").withColumn("failed_rules", failed)
    base = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    return out.select("doc_id", "stratum", *FEATURES, base.alias("base_failed"), "failed_rules", *(["carried"] if carry else [])).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
