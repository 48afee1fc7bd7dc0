"""Queries of links, audits, samples and small helpers; importing this module adds them to the catalogue."""

from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import audits, metrics, scoring
from ..sources import scans
from .catalogue import C, ORACLE_SQL, TAU, query, r6
from .views import LABELLED, MANIFEST, SCORED, labelled, manifest, scores, table


@query(f"WITH {MANIFEST} SELECT doc_id FROM m WHERE sha IN (SELECT sha FROM m WHERE doc_id % 3 = 0)")
def keep_set(spark, sf):
    m = manifest(spark, sf)
    return audits.keep_set(m, m.where("doc_id % 3 = 0"), "sha").select("doc_id")


@query(f"WITH {LABELLED} SELECT d.doc_id, label FROM (SELECT doc_id, 'cache/' || doc_id || '.jpg' AS file FROM documents) d JOIN l ON regexp_extract(file, '([^/]*)\\.jpg$', 1) = regexp_extract(path, '([^/]*)\\.txt$', 1)")
def label_by_stem(spark, sf):
    files = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("cache/"), "doc_id", F.lit(".jpg")).alias("file"))
    known = labelled(spark, sf).select(scans.stem("path").alias("stem"), "label")
    return files.withColumn("stem", scans.stem("file")).join(known, "stem").select("doc_id", "label")


@query("SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS file, regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder, lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '.(\\.[^.]*)$', 1)) AS extension, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem FROM pages")
def path_parts(spark, sf):
    return table(spark, sf, "pages").select("page_id", scans.file_name("url").alias("file"), scans.folder("url").alias("folder"), scans.extension("url").alias("extension"), scans.stem("url").alias("stem"))


RATES = f"""k AS (SELECT condition, count(*) FILTER (sc >= {TAU} AND y = 1)::DOUBLE AS tp, count(*) FILTER (sc >= {TAU} AND y = 0)::DOUBLE AS fp, avg(sc) AS mean_pred FROM scored GROUP BY condition),
 g AS (SELECT condition, tp + (condition = 'jpeg_30')::INT AS tp, fp, mean_pred + CASE condition WHEN 'clean' THEN 1e-12 WHEN 'blur_20' THEN 1e-6 ELSE 0 END AS mean_pred FROM k WHERE condition <> 'noise_010')"""


@query(f"""WITH {SCORED}, {RATES}, a AS (UNPIVOT k ON tp, fp, mean_pred INTO NAME "column" VALUE own), b AS (UNPIVOT g ON tp, fp, mean_pred INTO NAME "column" VALUE given)
SELECT condition, "column", round(own, 6) AS own, round(given, 6) AS given FROM a FULL JOIN b USING (condition, "column") WHERE own IS NULL OR given IS NULL OR abs(own - given) > 1e-9""")
def audit_join(spark, sf):
    """Recomputed values against delivered ones, in which three were changed and one condition is missing."""
    own = metrics.threshold_metrics(scores(spark, sf), C, TAU).select("condition", "tp", "fp", "mean_pred")
    shift = F.when(F.col("condition") == "clean", 1e-12).when(F.col("condition") == "blur_20", 1e-6).otherwise(0.0)
    given = own.where("condition <> 'noise_010'").select("condition", (F.col("tp") + (F.col("condition") == "jpeg_30").cast("int")).alias("tp"), "fp", (F.col("mean_pred") + shift).alias("mean_pred"))
    return r6(audits.differing(own, given, C, ["tp", "fp", "mean_pred"]))


@query("WITH u AS (SELECT 0 AS t, doc_id, quality FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT 1, doc_id, 1 - quality FROM labels) SELECT doc_id, quality FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY t) = 1")
def union_first(spark, sf):
    own = table(spark, sf, "labels").select("doc_id", "quality")
    return audits.union_first([own.where("doc_id % 2 = 0"), own.withColumn("quality", 1 - F.col("quality"))], "doc_id")


@query("SELECT user_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_wins(spark, sf):
    return audits.last_wins(table(spark, sf, "events"), "user_id", "event_type", "event_id")


@query("WITH v AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events WHERE value IS NOT NULL GROUP BY user_id) SELECT user_id, round(list_reduce(v, lambda a, x: 0.9 * a + (1 - 0.9) * x), 6) AS ema FROM v")
def moving_average(spark, sf):
    rows = table(spark, sf, "events").where("value is not null").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("x"))
    return r6(rows.select("user_id", audits.moving_average(F.transform("x", lambda e: e["value"]), 0.9).alias("ema")))


LINKS = "k AS (SELECT md5(doc_id::VARCHAR) AS sha, md5((doc_id // 2)::VARCHAR) AS src FROM documents WHERE doc_id % 2 = 1), h AS (SELECT doc_id, md5(doc_id::VARCHAR) AS sha, (doc_id % 2)::INT AS label FROM documents WHERE doc_id % 5 <> 0), j AS (SELECT sha, src FROM k WHERE sha IN (SELECT sha FROM h) AND src IN (SELECT sha FROM h))"


def _linked(spark, sf):
    sha = lambda c: F.md5(c.cast("string").cast("binary"))
    docs = table(spark, sf, "documents").select("doc_id")
    links = docs.where("doc_id % 2 = 1").select(sha(F.col("doc_id")).alias("sha"), sha(F.floor(F.col("doc_id") / 2)).alias("src"))
    return docs.where("doc_id % 5 <> 0").select("doc_id", sha(F.col("doc_id")).alias("sha"), (F.col("doc_id") % 2).cast("int").alias("label")), links


@query(f"WITH {LINKS} SELECT sha, src FROM j")
def lineage_by_hash(spark, sf):
    """Links by content hash whose two ends are both in the sample."""
    rows, links = _linked(spark, sf)
    return audits.linked_pairs(rows, links, "sha", "src")


@query(f"""WITH {LINKS}, p AS (SELECT sha FROM h QUALIFY row_number() OVER (PARTITION BY label ORDER BY sha256(sha || '|pairs|17'), sha) <= 25), f AS (SELECT sha, src FROM j ORDER BY sha256(sha || '|forced|17'), sha LIMIT 30)
SELECT sha FROM p UNION SELECT sha FROM f UNION SELECT src FROM f""")
def sample_with_pairs(spark, sf):
    rows, links = _linked(spark, sf)
    return audits.sample_with_pairs(rows, links, "sha", "src", "label", 25, 30)


@query("SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY sha256(doc_id || '|subset|17'), doc_id LIMIT 60) ORDER BY doc_id")
def random_subset(spark, sf):
    return audits.random_subset(table(spark, sf, "documents").select("doc_id"), "doc_id", 60)


@query("SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 40")
def head(spark, sf):
    return audits.head(table(spark, sf, "events").select("event_id", "event_type"), 40, ["event_id"])


@query(f"WITH {MANIFEST} SELECT doc_id FROM m WHERE source = 'src1' AND lang <> 'fr' ORDER BY doc_id LIMIT 25")
def source_head(spark, sf):
    """The first rows of one source that are not denied."""
    return audits.head(manifest(spark, sf).where("source = 'src1' and lang <> 'fr'").select("doc_id"), 25, ["doc_id"])


@query("""WITH e AS (SELECT user_id, value AS t FROM events WHERE user_id % 3 = 0), w AS (SELECT t, t BETWEEN 40.001 AND 40.0010001 AS inside FROM e), s AS (SELECT count(*) FILTER (inside) AS n, max(t) FILTER (t <= 40.001) AS low, min(t) FILTER (t >= 40.0010001) AS high FROM w)
SELECT round(t, 6) AS t, n = 0 AS widened FROM w, s WHERE CASE WHEN n > 0 THEN inside ELSE t = low OR t = high END""")
def window_or_nearest(spark, sf):
    own = table(spark, sf, "events").where("user_id % 3 = 0").select(F.col("value").alias("t"))
    return r6(audits.window_or_nearest(own, "t", 40.001, 40.0010001))


@query("SELECT user_id, event_type, n, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)")
def group_offsets(spark, sf):
    groups = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return audits.group_offsets(groups, "user_id", "event_type", "n")


@query("SELECT m AS mode, r AS side, b AS micro_batch, c AS checkpointing, concat_ws('|', m, r, b, c) AS key FROM (SELECT unnest(['train', 'eval']) AS m), (SELECT unnest([224, 448, 512]::BIGINT[]) AS r), (SELECT unnest([1, 2, 4]::BIGINT[]) AS b), (SELECT unnest([true, false]) AS c) WHERE m = 'train' OR NOT c")
def config_grid(spark, sf):
    """Every setting, with its key; only training has checkpoints."""
    grid = audits.config_grid(spark, mode=["train", "eval"], side=[224, 448, 512], micro_batch=[1, 2, 4], checkpointing=[True, False])
    own = grid.where("mode = 'train' or not checkpointing")
    return own.withColumn("key", F.concat_ws("|", "mode", *[F.col(c).cast("string") for c in ("side", "micro_batch", "checkpointing")]))


@query("SELECT event_type, round(median(value), 6) AS median, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events WHERE value BETWEEN 10 AND 90 GROUP BY event_type")
def window_stats(spark, sf):
    from ..operators import ranks

    own = table(spark, sf, "events").where(F.col("value").between(10, 90)).select("event_type", "value")
    middle = ranks.quantiles(own, ["event_type"], F.col("value"), [0.5]).select("event_type", F.col("edge").alias("median"))
    whole = own.groupBy("event_type").agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
    return whole.join(middle, "event_type").select("event_type", F.round("median", 6).alias("median"), F.round("mean", 6).alias("mean"), "least", "most")


@query(f"WITH {MANIFEST} SELECT source, count(*) FILTER (label IS NULL) AS missing, round(100.0 * count(*) FILTER (label IS NULL) / count(*), 2)::DOUBLE AS missing_pct, (SELECT count(*) = count(label) FROM m) AS complete FROM m GROUP BY source")
def coverage(spark, sf):
    by = manifest(spark, sf).groupBy("source").agg(F.count_if(F.col("label").isNull()).alias("missing"), F.count("*").alias("n")).withColumn("unreadable", F.lit(0))
    return by.select("source", "missing", audits.share(F.col("missing"), F.col("n")).alias("missing_pct")).join(audits.complete(by, "missing", "unreadable"))


@query(f"WITH {SCORED} SELECT id, CASE WHEN family = '' THEN 'real' ELSE family END AS generator, printf('%.6f', sc) AS pred FROM scored")
def relabelled(spark, sf):
    """Rows as the long report has them: a name for the reals, six digits."""
    name = F.when(F.col("family") == "", "real").otherwise(F.col("family"))
    return scores(spark, sf).select("id", name.alias("generator"), F.format_string("%.6f", F.col("sc")).alias("pred"))


@query("SELECT count(*) AS rows, count(*) FILTER (contains(url, '.html#')) AS refused FROM (SELECT CASE WHEN page_id % 4 = 0 THEN url || '.html#1' ELSE url END AS url FROM pages)")
def literal_guard(spark, sf):
    url = F.when(F.col("page_id") % 4 == 0, F.concat("url", F.lit(".html#1"))).otherwise(F.col("url"))
    return table(spark, sf, "pages").select(url.alias("url")).agg(F.count("*").alias("rows"), F.count_if(F.contains("url", F.lit(".html#"))).alias("refused"))


@query("SELECT DISTINCT lower(regexp_extract(path, '([^/]*)$', 1)) AS name FROM (SELECT 'Set/coco2017/val2017/' || doc_id || '.JPG' AS path FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'Set/coco2017/train2017/' || doc_id || '.jpg' FROM documents) WHERE contains('/' || lower(path), '/coco2017/val2017/')")
def demo_ids(spark, sf):
    docs = table(spark, sf, "documents")
    paths = docs.where("doc_id % 2 = 0").select(F.concat(F.lit("Set/coco2017/val2017/"), "doc_id", F.lit(".JPG")).alias("path")).union(docs.select(F.concat(F.lit("Set/coco2017/train2017/"), "doc_id", F.lit(".jpg"))))
    return scans.demo_ids(paths, "path").withColumnRenamed("id", "name")


@query(f"WITH {SCORED}, {MANIFEST} SELECT id, condition, coalesce(lang, '?') AS lang FROM scored LEFT JOIN m ON id = doc_id")
def items_with_manifest(spark, sf):
    own = manifest(spark, sf).select(F.col("doc_id").alias("id"), "lang")
    return scores(spark, sf).select("id", "condition").join(own, "id", "left").select("id", "condition", F.coalesce("lang", F.lit("?")).alias("lang"))


@query(f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) = 64) SELECT vec_id, round(list_dot_product(e, {[round((i % 7 - 3) / 10, 1) for i in range(64)]}::DOUBLE[]) + 0.25, 5) AS logit FROM v WHERE len(list_filter(e, lambda x: isnan(x) OR isinf(x))) = 0")
def model_scores(spark, sf):
    """A linear head over the embeddings, in the batch loop that any model goes through."""
    own = table(spark, sf, "embeddings").where(F.size("embedding") == 64).where(F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))))
    weights = [round((i % 7 - 3) / 10, 1) for i in range(64)]
    return r6(scoring.scored(own.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), "embedding", scoring.linear(weights, 0.25)).select("vec_id", "logit"), 5)


@query(f"WITH {SCORED} SELECT condition, round(avg(sc), 6) AS mean_pred, round(avg(y::DOUBLE), 6) AS prevalence FROM scored GROUP BY condition")
def mean_and_prevalence(spark, sf):
    return r6(metrics.threshold_metrics(scores(spark, sf), C, TAU).select("condition", "mean_pred", "prevalence"))


@query("SELECT page_id FROM pages WHERE lower(url) IN (SELECT lower(url) FROM pages WHERE page_id % 7 = 0)", "deny_path_key")
def deny_path_key(spark, sf):
    """Path keys against the keys of a denylist."""
    own = table(spark, sf, "pages").select("page_id", K.path_key(F.col("url"), "https:/").alias("key"))
    return audits.keep_set(own, own.where("page_id % 7 = 0"), "key").select("page_id")


_KEYED = ORACLE_SQL["path_key"]
ORACLE_SQL["deny_path_key"] = f"WITH x AS ({_KEYED}) SELECT page_id FROM x WHERE key IN (SELECT key FROM x WHERE page_id % 7 = 0)"


@query("SELECT count(*) AS items, count(DISTINCT text) AS texts, (SELECT count(*) FROM documents d WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))) AS documents FROM benchmark")
def benchmark_contamination(spark, sf):
    """Documents that hold a benchmark item word for word: items go out as a broadcast of checked size, in blocks beyond it."""
    items = table(spark, sf, "benchmark").where("text is not null")
    docs = table(spark, sf, "documents").select(F.monotonically_increasing_id().alias("row"), "text")
    hit = scans.containing(docs, items, "row", "text")
    return items.agg(F.count("*").alias("items"), F.count_distinct("text").alias("texts")).join(hit.agg(F.count("*").alias("documents")))
