"""Queries of scans, sinks, image transforms and validation rules; importing this module adds them to the catalogue.

What a query writes goes to the folder that driver and executors share, under the application's id.
"""

import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import images, validation
from ..sources import archives, scans, sinks, store
from .catalogue import query
from .views import MANIFEST, SCORED, manifest, scores, table


def scratch(spark: SparkSession, label: str) -> str:
    """A path in the folder that driver and executors share; one is made only in local runs."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="sievework-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/sievework-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


# Scans


@query("SELECT count(*) AS rows, count(DISTINCT doc_id) AS ids, count(*) AS places FROM documents")
def row_group_scan(spark, sf):
    rows = scans.parquet_rows(spark, f"{sf}/documents.parquet", ["doc_id"])
    return rows.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids"), F.count_distinct("file", "row").alias("places"))


@query("SELECT doc_id, doc_id % 3 > 0 AS found, CASE WHEN doc_id % 3 > 0 THEN n_chars END AS n_chars FROM documents")
def point_lookup(spark, sf):
    """Every row by its reference path#place, a third of them beyond the end of any file, resolved by one join on whole paths."""
    rows = scans.parquet_rows(spark, f"{sf}/documents.parquet", ["doc_id", "n_chars"])
    place = F.col("row") + F.when(F.col("doc_id") % 3 == 0, 1 << 40).otherwise(0)
    wanted = rows.select("doc_id", F.concat_ws("#", "file", place.cast("string")).alias("ref"))
    found = scans.lookup_rows(rows.select("file", "row", "n_chars", F.lit(True).alias("hit")), wanted, "ref")
    return found.select("doc_id", F.coalesce("hit", F.lit(False)).alias("found"), "n_chars")


@query("SELECT doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS k FROM labels) WHERE k <= 50 AND doc_id % 2 = 0")
def capped_scan(spark, sf):
    """The cap counts rows before the later filter; labels lie in the order of their ids."""
    rows = scans.recode_labels(table(spark, sf, "labels"), "quality").withColumns({"file": F.lit(""), "row": F.col("doc_id")})
    return scans.capped_scan(rows, "quality", 50, F.col("doc_id") % 2 == 0).select("doc_id", "quality")


@query(f"WITH {MANIFEST}, r AS (SELECT *, CASE WHEN source = 'src3' THEN 'protected' WHEN doc_id IN (SELECT doc_id FROM documents WHERE n_chars >= 200) THEN 'resolved' ELSE 'unavailable' END AS state FROM m) SELECT state, count(*) AS n FROM r GROUP BY state")
def source_stats(spark, sf):
    m = manifest(spark, sf)
    found = table(spark, sf, "documents").where("n_chars >= 200")
    return scans.resolved_buckets(m, found, "doc_id", F.when(F.col("source") == "src3", "protected"), K.bucket(F.col("label"), F.col("family"), F.col("source")), 20)[1]


@query("SELECT (SELECT count(DISTINCT doc_id) FROM labels) AS expected, (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS found, (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS outside, (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS absent")
def demo_subset(spark, sf):
    return scans.demo_subset(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")[1]


@query("SELECT doc_id, quality, text IS NOT NULL AS first FROM (SELECT doc_id, -1 AS quality, text FROM documents WHERE n_chars > 500 UNION ALL SELECT doc_id, quality, NULL FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 500))")
def prefer_first_root(spark, sf):
    first = table(spark, sf, "documents").where("n_chars > 500").select("doc_id", F.lit(-1).alias("quality"), F.lit(True).alias("first"))
    second = table(spark, sf, "labels").select("doc_id", "quality", F.lit(False).alias("first"))
    return scans.prefer_first(first, second, "doc_id")


@query()
def dir_stats(spark, sf):
    return scans.files(spark, sf, (".parquet",)).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def _archives(spark: SparkSession, sf: str):
    """One zip a tenth of the pages, written by the tasks that hold them."""
    root = scratch(spark, "zips")
    rows = table(spark, sf, "pages").select((F.col("page_id") % 10).cast("int").alias("part"), F.concat("page_id", F.lit(".png")).alias("name"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("body"))

    def write(frame):
        import io

        import pandas as pd

        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
            for name, body in zip(frame["name"], frame["body"]):
                z.writestr(name, body)
        return pd.DataFrame([(f"part-{frame['part'].iloc[0]}.zip", packed.getvalue())], columns=["name", "content"])

    made = rows.groupBy("part").applyInPandas(write, "name string, content binary")
    return root, made


@query()
def zip_verification(spark, sf):
    """Archives of this query's own making are written to the shared folder, then verified in full."""
    root, made = _archives(spark, sf)

    def put(frames):
        for frame in frames:
            for name, body in zip(frame["name"], frame["content"]):
                store.write_shared(f"{root}/{name}", body)
            yield frame[["name"]].assign(archive=[f"{root}/{n}" for n in frame["name"]])[["archive"]]

    own = made.mapInPandas(put, "archive string")
    return archives.totals(archives.verify(own))


# Sinks


@query("SELECT count(*) AS rows, count(*) - count(*) FILTER (doc_id % 3 = 0) AS second, 0::BIGINT AS third FROM labels")
def append_new_rows(spark, sf):
    path, rows = scratch(spark, "append"), table(spark, sf, "labels")
    sinks.append_new(rows.where("doc_id % 3 = 0"), path, "doc_id")
    second, third = sinks.append_new(rows, path, "doc_id"), sinks.append_new(rows, path, "doc_id")
    return spark.read.parquet(path).agg(F.count("*").alias("rows"), F.lit(second).cast("long").alias("second"), F.lit(third).cast("long").alias("third"))


@query(f"WITH {SCORED} SELECT condition, printf('%.6f', avg(sc)) AS mean FROM scored GROUP BY condition")
def report_csv(spark, sf):
    path = scratch(spark, "report")
    sinks.write_report(scores(spark, sf).groupBy("condition").agg(F.avg("sc").alias("mean")), path, ["condition", "mean"], ["condition"])
    return spark.read.csv(path, header=True)


@query("SELECT count(*) AS n_records, count(*) FILTER (quality = 0) AS n_errors, TRUE AS strict FROM labels")
def error_file(spark, sf):
    rows = table(spark, sf, "labels").select(F.when(F.col("quality") == 0, F.concat(F.lit("doc "), "doc_id")).alias("error"))
    return sinks.error_summary(rows, "error", True).drop("examples")


@query("SELECT count(DISTINCT sha256(text)) AS blobs, count(*) AS refs FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND text IS NOT NULL")
def extract_blobs(spark, sf):
    path = scratch(spark, "blobs")
    rows = table(spark, sf, "documents").where("text is not null").select("doc_id", F.col("text").cast("binary").alias("body"))
    refs = sinks.extract_blobs(rows, table(spark, sf, "labels"), ["doc_id"], "body", path)
    return spark.read.parquet(path).agg(F.count("*").alias("blobs")).join(refs.agg(F.count("*").alias("refs")))


@query("""SELECT '{' || chr(10) || ' "rows": ' || count(*) || ',' || chr(10) || ' "sources": ' || count(DISTINCT source) || chr(10) || '}' AS receipt, TRUE AS done FROM documents""")
def receipt(spark, sf):
    path = scratch(spark, "receipt") + ".json"
    row = sinks.write_receipt(table(spark, sf, "documents").agg(F.count("*").alias("rows"), F.count_distinct("source").alias("sources")), path)
    sinks.mark_done(spark, path, scans.fingerprint(row))
    return spark.createDataFrame([(store.read_text(spark, path), sinks.is_done(spark, path, scans.fingerprint(row)))], "receipt string, done boolean")


# Images


def _pictures(spark: SparkSession, sf: str):
    """Each vector of 64 numbers as a grey 8 x 8 picture."""

    def run(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            out = []
            for key, v in zip(frame["vec_id"], frame["embedding"]):
                x = np.nan_to_num(np.asarray(v, np.float64), nan=0.0, posinf=0.0, neginf=0.0).reshape(8, 8, 1)
                out.append((str(key), images.png_encode(np.repeat(np.clip(128 + 64 * x, 0, 255).astype(np.uint8), 3, 2))))
            yield pd.DataFrame(out, columns=["key", "content"])

    return table(spark, sf, "embeddings").where(F.size("embedding") == 64).select("vec_id", "embedding").mapInPandas(run, "key string, content binary")


SQUARE = "(SELECT count(*) FROM embeddings WHERE len(embedding) = 64)"


@query(f"SELECT c AS condition, {SQUARE} AS images, {SQUARE} * CASE WHEN c = 'crop_80' THEN 36 ELSE 64 END AS pixels, 0::BIGINT AS errors FROM (SELECT unnest({K.CONDITIONS}) AS c)")
def condition_fan_out(spark, sf):
    done = images.fan_out(_pictures(spark, sf), "key", "content")
    return done.groupBy("condition").agg(F.count("*").alias("images"), F.sum(F.col("width").cast("long") * F.col("height")).alias("pixels"), F.count("error").alias("errors"))


@query()
def image_manifest(spark, sf):
    return images.describe(_pictures(spark, sf), "key", "content")


@query(f"SELECT family, count(*) AS n FROM (SELECT unnest(string_split(families, '+')) AS family FROM ({{}})) WHERE family <> '' GROUP BY family".format("""
 WITH u AS (SELECT doc_id, f, w, -ln(1 - ('0x' || substr(md5(doc_id || '|' || f || '|order|17'), 1, 8))::BIGINT / 4294967296.0::DOUBLE) / w AS late,
   ('0x' || substr(md5(doc_id || '|number|17'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS chance FROM documents, (SELECT unnest(['jpeg', 'resize', 'blur', 'noise', 'jitter', 'crop']) AS f, unnest([0.30, 0.20, 0.15, 0.15, 0.10, 0.10]::DOUBLE[]) AS w)),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY late) AS k FROM u)
 SELECT doc_id, string_agg(f, '+') AS families FROM r WHERE k <= (chance >= 0.30)::INT + (chance >= 0.85)::INT GROUP BY doc_id"""))
def distortion_families(spark, sf):
    """How often the plan of a document holds each family of training distortions."""
    plan = images.distortion_plan(F.col("doc_id"), 17)
    return table(spark, sf, "documents").select(F.explode(plan).alias("x")).groupBy(F.col("x.family").alias("family")).agg(F.count("*").alias("n"))


@query()
def distorted_images(spark, sf):
    return images.distorted(_pictures(spark, sf), "key", "content").select("key", "families", F.length("content").alias("bytes"), "error")


@query()
def normalised_images(spark, sf):
    plan = K.normalization_plan(F.col("key"), F.lit("png"), 17)
    return images.normalised(_pictures(spark, sf), "key", "content", plan).drop("content")


@query(f"WITH v AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0) SELECT vec_id, sum(least(255, greatest(0, trunc(128 + 64 * x))))::BIGINT AS grey FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM v) GROUP BY vec_id")
def image_tensors(spark, sf):
    """The first channel's sum of each picture's tensor, scaled back to bytes."""
    made = images.tensors(_pictures(spark, sf), "key", "content", 8).where("error is null")
    plane = F.slice("tensor", 1, 64)
    total = F.aggregate(plane, F.lit(0.0), lambda a, x: a + x)
    own = made.select(F.col("key").cast("long").alias("vec_id"), F.round((total * images.CHANNEL_STD[0] + 64 * images.CHANNEL_MEAN[0]) * 255).cast("long").alias("grey"))
    finite = table(spark, sf, "embeddings").where(F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))).select("vec_id")
    return own.join(finite, "vec_id", "left_semi")


@query()
def image_rows(spark, sf):
    return images.manifest_rows(_pictures(spark, sf), "key", "content", label=F.lit(1), source=F.lit("vectors"))


@query(f"SELECT v::INT AS view, {SQUARE} AS images FROM (SELECT unnest(range(5)) AS v)")
def five_crop_views(spark, sf):
    return images.five_views(_pictures(spark, sf), "key", "content", 6).groupBy("view").agg(F.count("*").alias("images"))


@query(f"SELECT (row_number() OVER () - 1)::INT AS place, c AS condition FROM (SELECT unnest({K.CONDITIONS}) AS c)")
def condition_registry(spark, sf):
    return images.registry(spark).where("standard").select("place", "condition")


# Rules


@query(f"WITH {SCORED}, d AS (SELECT condition, family, count(*) AS n FROM scored GROUP BY ALL) SELECT 'duplicate' AS rule, count(*) FILTER (n > 1) AS n FROM d")
def result_rules(spark, sf):
    """Paths that a condition repeats; every other rule holds."""
    own = scores(spark, sf).select(F.col("condition").alias("stem"), "condition", F.lit(0.5).alias("threshold"), F.col("family").alias("path"), F.col("y").alias("label"), F.col("sc").alias("pred"))
    return validation.result_findings(own, F.col("condition"))


@query("SELECT quality AS label, count(*) AS n, 100::BIGINT AS expected FROM labels GROUP BY quality HAVING count(*) <> 100")
def expected_counts(spark, sf):
    return validation.expected_counts(table(spark, sf, "labels").withColumnRenamed("quality", "label"), "label", {0: 100, 1: 100})


@query("SELECT event_id, CASE WHEN value > 20 THEN 0.5 ELSE value / 20 END AS pred FROM events WHERE value IS NOT NULL")
def failures_as_half(spark, sf):
    rows = table(spark, sf, "events").where("value is not null").select("event_id", (F.col("value") / 20).alias("pred"), F.when(F.col("value") > 20, "too large").alias("error"))
    return validation.predictions_or_errors(rows, "pred", "error", False).select("event_id", "pred")
