"""The stages one by one on the smallest tables, against plain versions."""

from pyspark.sql import functions as F

import corpus_pipeline
from sievework.llm import decontamination, line_dedup, quality_rules, simhash_golay


def shingled(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "packing"]
    columns = docs.columns

    kept = stage["quality_rules"](spark, docs, sf).cache()
    judged = quality_rules.judge(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert kept.columns == columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in judged.where("kept").select("doc_id").collect()}

    lines = stage["line_dedup"](spark, kept, sf).cache()
    assert lines.columns == columns and lines.count() == kept.count()
    assert lines.where(F.length("text") != F.col("n_chars")).count() == 0
    left = [x for r in lines.collect() for x in r["text"].split("\n") if len(x) >= 32]
    assert len(left) == len(set(left))
    assert line_dedup.dedup_lines(lines).where("n_exact > 0").count() == 0

    alone = stage["near_duplicates"](spark, lines, sf).cache()
    assert alone.columns == columns
    sets = [(r["doc_id"], shingled(r["text"])) for r in lines.collect()]
    root = list(range(len(sets)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    left = {r[0] for r in alone.select("doc_id").collect()}
    assert len(left) <= len({find(i) for i in range(len(sets))})  # the fingerprints may link more
    by_root = {}
    for i, (d, _) in enumerate(sets):
        by_root.setdefault(find(i), set()).add(d)
    assert all(len(g & left) <= 1 for g in by_root.values())
    prints = {r["doc_id"]: r["component_id"] for r in simhash_golay.near_duplicates(lines, shingle=5).collect()}
    assert all(prints[d] in left or len(g) > 1 for g in by_root.values() for d in g)

    clean = stage["decontamination"](spark, alone, sf).cache()
    assert clean.columns == columns
    found = decontamination.decontaminate(alone, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").count()
    assert clean.count() + found == alone.count()

    packed = stage["packing"](spark, clean, sf)
    assert {r[0] for r in packed.select("doc_id").collect()} == {r[0] for r in clean.select("doc_id").collect()}
    for df in (kept, lines, alone, clean):
        df.unpersist()


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_stages_take_empty_and_null_documents(spark, sf):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (1, "", "en", "s", 0), (2, "x " * 30, None, None, 60)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, sf)
            assert out.count() >= 0, name
