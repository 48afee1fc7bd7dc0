"""Scans of tables, CSV labels, lists, denylists, JSON results and configurations."""

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import path_key
from ..functions.rules import family_from_path, family_of, protected_by
from ..operators.curation import first_rows
from . import archives
from .store import exists, read_text

RESULT = "condition string, n long, threshold double, calibration struct<temperature:double,alpha:double,threshold:double>, predictions array<struct<image_id:string,path:string,label:int,generator_family:string,pred:double>>"


def parquet_rows(spark: SparkSession, path: str, columns: list[str], skip: bool = True) -> DataFrame:
    """Only the columns named, with each row's file (its whole path) and place in it, which Spark's reader gives without a
    shuffle. Unreadable shards are skipped if `skip`; `damaged_shards` names them."""
    rows = spark.read.option("ignoreCorruptFiles", str(skip).lower()).parquet(path)
    return rows.select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def damaged_shards(spark: SparkSession, path: str) -> DataFrame:
    """file and error of every parquet file below path whose first and last bytes are not those of a whole one."""
    ends = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    head, tail = F.substring("content", 1, 4), F.substring("content", -4, 4)
    mark = F.lit(b"PAR1")
    error = F.when(F.col("length") < 12, "too short").when(head != mark, "no mark at its start").when(tail != mark, "no mark at its end")
    return ends.select(F.col("path").alias("file"), error.alias("error")).where("error is not null")


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def folder(path: Column | str) -> Column:
    """What stands before the last slash; empty without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column | str) -> Column:
    """From the last dot of the file's name on, in lower case; a name that begins with its only dot has none."""
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]*)$", 1))


def stem(path: Column | str) -> Column:
    return F.regexp_replace(file_name(path), r"(.)\.[^.]*$", "$1")


def lookup_rows(rows: DataFrame, wanted: DataFrame, ref: str, root: str = "") -> DataFrame:
    """Rows that references `path#row` name; relative paths lie below root. Whole paths are compared (without scheme), as
    folders may hold files of one name. A reference without a row stays, with nulls: a left join, not a read a row."""
    bare = lambda c: F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.\-]*:/+", "/")
    path = F.regexp_extract(ref, r"^(.*)#\d+$", 1)
    whole = F.when(path.rlike(r"^(/|[A-Za-z][A-Za-z0-9+.\-]*:/)"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/" if root else ""), path))
    parts = wanted.select("*", bare(whole).alias("_file"), F.regexp_extract(ref, r"#(\d+)$", 1).try_cast("long").alias("_row"))
    known = rows.select(bare(F.col("file")).alias("_file"), F.col("row").alias("_row"), *[c for c in rows.columns if c not in ("file", "row")])
    return parts.join(known, ["_file", "_row"], "left").drop("_file", "_row")


def capped_scan(rows: DataFrame, label: str, most: int, keep: Column | None = None) -> DataFrame:
    """The first `most` rows of each label in the order of file and row; `keep` filters after the cap, as the cap counts
    rows before that filter."""
    capped = first_rows(rows, [label], ["file", "row"], most)
    return capped if keep is None else capped.where(keep)


def recode_labels(rows: DataFrame, label: str) -> DataFrame:
    """0 and 1 stay; every other label, or none, goes."""
    return rows.where(F.col(label).isin(0, 1)).withColumn(label, F.col(label).cast("int"))


def csv_labels(spark: SparkSession, path: str, schema: str, required: str, only: list[str] | None = None) -> DataFrame:
    """Label files with a header; rows without `required` go; `only` names the files to take. Undecodable bytes become U+FFFD."""
    rows = spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE", enforceSchema=True).withColumn("file", F.col("_metadata.file_name"))
    rows = rows.where(F.coalesce(F.col(required), F.lit("")) != "")
    return rows if only is None else rows.where(F.col("file").isin(only))


def resolved_buckets(rows: DataFrame, found: DataFrame, key: str, reason: Column, bucket: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(kept, stats): rows with a reason are refused and counted; of those whose key is found, the first `most` of each bucket stay."""
    judged = rows.withColumns({"_reason": reason, "bucket": bucket})
    hit = judged.join(found.select(F.col(key)).distinct().withColumn("_found", F.lit(True)), key, "left")
    state = F.coalesce(F.col("_reason"), F.when(F.col("_found"), "resolved").otherwise("unavailable"))
    stats = hit.groupBy(state.alias("state")).agg(F.count("*").alias("n"))
    kept = first_rows(hit.where("_reason is null and _found"), ["bucket"], [key], most).drop("_reason", "_found")
    return kept, stats


def demo_subset(members: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(members kept, one row of expected, found, outside and absent). Partial overlap keeps the subset; where no member or
    every one is wanted, the whole archive stays."""
    w = wanted.select(key).distinct()
    flagged = members.join(w.withColumn("_want", F.lit(True)), key, "left")
    audit = members.select(key).distinct().withColumn("_have", F.lit(True)).join(w.withColumn("_want", F.lit(True)), key, "full").agg(
        F.count("_want").alias("expected"), F.count_if(F.col("_want") & F.col("_have")).alias("found"),
        F.count_if(F.col("_want").isNull()).alias("outside"), F.count_if(F.col("_have").isNull()).alias("absent"),
    )
    partial = audit.select(((F.col("found") > 0) & (F.col("outside") > 0)).alias("_partial"))
    kept = flagged.join(F.broadcast(partial)).where("not _partial or _want").drop("_partial", "_want")
    return kept, audit


def files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (), content: bool = False) -> DataFrame:
    """path, length and, if asked for, content of all files below path; suffixes are compared without case."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if suffixes:
        rows = rows.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*suffixes))
    return rows.select("path", "length", *(["content"] if content else []))


def labelled_by_path(rows: DataFrame) -> DataFrame:
    return rows.withColumn("label", F.when(F.lower("path").contains("/real/"), 0).otherwise(1))


def prefer_first(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of the first root, and those of the second whose key the first lacks."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"), allowMissingColumns=True)


def input_list(spark: SparkSession, path: str) -> DataFrame:
    """Paths of a .txt (one a line, blank lines skipped), a .csv (its column path) or the files of a folder (relative), sorted."""
    if path.endswith(".txt"):
        out = spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")
    elif path.endswith(".csv"):
        out = spark.read.csv(path, header=True).select("path").where("path is not null")
    else:
        root = path.rstrip("/").rpartition("/")[2]
        out = files(spark, path).select(F.expr(f"substr(path, instr(path, '/{root}/') + {len(root) + 2})").alias("path"))
    return out.orderBy("path")


def deny_list(spark: SparkSession, path: str) -> DataFrame:
    """sha256 and path of lines `sha path`; split once, as paths may hold spaces."""
    part = F.split(F.trim("value"), r"\s+", 2)
    return spark.read.text(path).where("trim(value) <> ''").select(part[0].alias("sha256"), F.get(part, 1).alias("path"))


def condition_results(spark: SparkSession, path: str) -> DataFrame:
    """One row a prediction of every *.json below path, *.done.json left out. `stem` is the file's name without its suffix."""
    rows = spark.read.schema(RESULT).option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)
    rows = rows.withColumn("stem", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")).where("not stem like '%.done'")
    return rows.select("stem", "condition", F.coalesce("calibration.threshold", "threshold").alias("threshold"), F.explode_outer("predictions").alias("p")).select("stem", "condition", "threshold", "p.*")


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A parquet table, or None where there is none: what needs it is left out by the caller."""
    return spark.read.parquet(path) if exists(spark, path) else None


def items_of(spark: SparkSession, path: str, conditions: list[str]) -> DataFrame:
    """The items of the conditions asked for; the filter reaches the scan."""
    return spark.read.parquet(path).where(F.col("condition").isin(conditions))


def load_config(spark: SparkSession, path: str) -> dict:
    """A configuration from JSON, or from YAML where a YAML reader is installed; it must be a mapping."""
    text = read_text(spark, path)
    if text is None:
        raise FileNotFoundError(path)
    if path.endswith(".json"):
        config = json.loads(text)
    else:
        try:
            import yaml
        except ImportError:
            raise RuntimeError("YAML configurations need the package yaml") from None
        config = yaml.safe_load(text)
    if not isinstance(config, dict):
        raise ValueError(f"{path} is no mapping")
    return config


def config_hash(config: dict) -> str:
    """Twelve hex digits of the SHA-256 of the compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


def fingerprint(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]


def demo_ids(paths: DataFrame, path: str, marker: str = "/coco2017/val2017/") -> DataFrame:
    """The distinct file names, in lower case, of the paths that lie below the marker."""
    key = F.lower(path)
    return paths.where(F.contains(F.concat(F.lit("/"), key), F.lit(marker))).select(file_name(key).alias("id")).distinct()


def containing(docs: DataFrame, items: DataFrame, key: str, text: str, most: int = 2000) -> DataFrame:
    """Keys of documents that hold the text of an item. Items are compared in blocks of at most about `most`, each broadcast."""
    known = items.select(F.col(text).alias("_item")).distinct()
    blocks = max(1, -(-known.count() // most))
    found = None
    for block in range(blocks):
        own = known.where(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == block) if blocks > 1 else known
        hit = docs.join(F.broadcast(own), F.contains(F.col(text), F.col("_item")), "left_semi").select(key)
        found = hit if found is None else found.union(hit)
    return found.distinct()


def zip_rows(spark: SparkSession, root: str, archive: str, label: int, source: str, family: Column | str = "") -> DataFrame:
    """path (archive#member), label, source and generator_family of the images in one archive below root."""
    listed = archives.members(spark.createDataFrame([(f"{root.rstrip('/')}/{archive}",)], "archive string"), content=False).where("error is null")
    path = F.concat(F.lit(archive + "#"), "member")
    return listed.select(path.alias("path"), F.lit(label).alias("label"), F.lit(source).alias("source"), (F.lit(family) if isinstance(family, str) else family).alias("generator_family"))


def folder_rows(spark: SparkSession, root: str, below: str, source: str) -> DataFrame:
    """The images below a folder and in the archives there; the path tells label and family."""
    found = files(spark, f"{root.rstrip('/')}/{below}", (*archives.IMAGES, ".zip"))
    rel = F.expr(f"substr(path, instr(path, '/{below.strip('/')}/') + 1)")
    listed = found.select("path", rel.alias("rel"))
    inner = archives.members(listed.where(extension("rel") == ".zip").select(F.col("path").alias("archive")), content=False).where("error is null")
    inner = inner.join(listed.withColumnRenamed("path", "archive"), "archive").select(F.col("rel").alias("of"), F.concat("rel", F.lit("#"), "member").alias("path"))
    every = listed.where(extension("rel") != ".zip").select(F.col("rel").alias("of"), F.col("rel").alias("path")).union(inner)
    label = F.when(F.contains(F.lower(F.concat(F.lit("/"), "of", F.lit("/"))), F.lit("/real/")), 0).otherwise(1)
    return every.select("path", label.alias("label"), F.lit(source).alias("source"), F.when(label == 0, "").otherwise(family_from_path(F.col("of"))).alias("generator_family"))


def shard_rows(spark: SparkSession, root: str, below: str, source: str, family: str) -> DataFrame:
    """The rows of parquet shards: labels 0 and 1 stay; a path is shard#place."""
    rows = recode_labels(parquet_rows(spark, f"{root.rstrip('/')}/{below}", ["label"]), "label")
    rel = F.concat(F.lit(below.strip("/") + "/"), file_name("file"), F.lit("#"), F.col("row").cast("string"))
    return rows.select(rel.alias("path"), "label", F.lit(source).alias("source"), F.when(F.col("label") == 0, "").otherwise(family).alias("generator_family"))


def csv_rows(spark: SparkSession, root: str, labels: str, images: str, source: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows, stats) of label files: protected rows are refused and counted, the first `most` of each bucket that resolve
    to a file below `images` stay (0: all)."""
    kinds = "Generator string, Architecture string, Weight string, Category string, IsAdvanced string, IsFake string, Image_path string, Num string"
    own = csv_labels(spark, f"{root.rstrip('/')}/{labels}", kinds, "Image_path").select(
        "file", path_key(F.col("Image_path"), "wildfake/images/").alias("key"), F.coalesce("Architecture", F.lit("")).alias("architecture"),
        F.coalesce("Category", F.lit("")).alias("category"), F.coalesce(F.col("IsFake") == "1", F.lit(False)).alias("fake"),
    )
    family = family_of(F.col("architecture"), F.col("fake"))
    found = folder_rows(spark, root, images, source).select(path_key(F.col("path"), images.strip("/").lower() + "/").alias("key"), F.col("path"))
    reason = F.when(protected_by(F.col("file"), F.col("architecture"), F.col("category"), F.col("fake"), F.col("key")).isNotNull(), "protected")
    group = F.when(F.col("fake"), family).otherwise(F.concat(F.lit("real:"), F.col("architecture")))
    kept, stats = resolved_buckets(own.withColumn("family", family), found, "key", reason, group, most or (1 << 31) - 1)
    rows = kept.join(found, "key").select("path", F.col("fake").cast("int").alias("label"), F.lit(source).alias("source"), F.col("family").alias("generator_family"))
    return rows, stats


#: The sources by name, and where their files lie below the root.
SOURCES: dict[str, Callable] = {
    "coco_train": lambda spark, root, **_: zip_rows(spark, root, "COCO/train2017.zip", 0, "coco_train2017"),
    "coco_val": lambda spark, root, **_: zip_rows(spark, root, "COCO/val2017.zip", 0, "coco_val2017"),
    "coco_val_demo": lambda spark, root, wanted=None, **_: demo_subset(zip_rows(spark, root, "COCO/val2017.zip", 0, "coco_val2017").withColumn("name", file_name("path")), wanted, "name")[0].drop("name"),
    "wildfake": lambda spark, root, **_: folder_rows(spark, root, "WildFake/Images", "wildfake"),
    "wildfake_csv": lambda spark, root, most=0, **_: csv_rows(spark, root, "WildFake/label_csv_files", "WildFake/Images", "wildfake", most)[0],
    "sid_set": lambda spark, root, **_: shard_rows(spark, root, "SID_Set/data", "sid_set", "flux"),
}


def source_rows(spark: SparkSession, name: str, root: str, **options) -> DataFrame:
    """path, label, source and generator_family of one of the six sources."""
    if name not in SOURCES:
        raise ValueError(f"unknown source {name!r}; known: {sorted(SOURCES)}")
    return SOURCES[name](spark, root, **options)


def dispatch(builders: dict[str, Callable], source: str, *args) -> DataFrame:
    if source not in builders:
        raise ValueError(f"unknown source {source!r}; known: {sorted(builders)}")
    return builders[source](*args)
