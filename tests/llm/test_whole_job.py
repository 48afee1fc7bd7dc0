"""Cases that a cut in an operator would lose."""

import numpy as np

import corpus_pipeline
from sievework.llm import line_dedup, shingle_sets
from sievework.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def doc(doc_id, text):
    return (doc_id, text, "en", "s", len(text))


def windows(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def test_near_duplicates_reach_a_similarity_of_0_8(spark):
    r = np.random.default_rng(3)
    texts = []
    for _ in range(60):
        base = [f"w{i}" for i in r.integers(0, 5000, r.integers(60, 300))]
        texts.append(base)
        for edits in (1, 2, 3, 5, 9):
            own = list(base)
            for at in r.choice(len(base), edits, replace=False):
                own[at] = "edited%d" % r.integers(0, 1 << 30)
            texts.append(own)
    texts = [" ".join(t) for t in texts]
    sets = [windows(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = {find(i) for i in range(len(texts))}
    docs = spark.createDataFrame([doc(i, t) for i, t in enumerate(texts)], DOCS)
    assert {x["doc_id"] for x in corpus_pipeline.copies(spark, docs, "").collect()} == want
    assert len(want) < len(texts) < 6 * len(want)


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
        p = q
    return p[-1]


def test_short_lines_repeat_too(spark, tmp_path):
    r = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnop"))
    texts = ["\n".join("".join(r.choice(letters, n)) for n in r.integers(1, 14, 12)) for _ in range(30)]
    texts += ["Les.\n\n  \nA.", "Les.\n\n  \nA.\nA.\na line of its own, unlike any other"]
    spark.createDataFrame([doc(i, t) for i, t in enumerate(texts)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    first, want = {}, {}
    for d, t in enumerate(texts):
        for n, line in enumerate(t.split("\n")):
            if line.strip():
                first.setdefault(line, (d, n))
    near = {a for a in first for b in first if min(len(a), len(b)) > 2 and abs(len(a) - len(b)) <= 2 and first[b] < first[a] and edits(a, b) <= 2}
    for d, t in enumerate(texts):
        want[d] = "\n".join(x for n, x in enumerate(t.split("\n")) if not x.strip() or (first[x] == (d, n) and x not in near))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert {x["doc_id"]: x["text"] for x in corpus_pipeline.lines(spark, docs, "").collect()} == want
    sizes = {x["doc_id"]: x["kept_bytes"] for x in QUERIES["op7_line_dedup"](spark, str(tmp_path)).collect()}
    assert sizes == {d: len(t) for d, t in want.items()}
    assert near and line_dedup.WHOLE["min_chars"] == line_dedup.WHOLE["most"] + 1


def test_rows_that_share_an_id_lose_their_own_lines_only(spark):
    long = "a line that more than one of the rows holds, word for word"
    rows = [doc(1, long + "\nfirst line of its own in row one, kept"), doc(None, "something that only the second row says\n" + long), doc(None, long + "\nwhat only the third row says, at line two"), doc(None, long), doc(2, long + "\nx"), doc(2, long + "\ny1234")]
    for whole in (rows, [(2, *r[1:]) for r in rows]):
        docs = spark.createDataFrame(whole, DOCS).coalesce(1)
        got = sorted(x["text"] for x in corpus_pipeline.lines(spark, docs, "").collect())
        assert sum(x.split("\n").count(long) for x in got) == 1
        assert sorted(line for x in got for line in x.split("\n") if line not in ("", long)) == sorted(line for r in whole for line in r[1].split("\n") if line != long)


def test_a_rejected_row_takes_no_other_of_its_id(spark, sf):
    clean = " ".join(f"word{i}" for i in range(60))
    rows = [doc(None, clean), doc(None, "too short"), doc(None, clean + " more"), doc(7, "short too"), doc(7, clean + " of seven"), (None, None, None, None, None)]
    kept = corpus_pipeline.quality(spark, spark.createDataFrame(rows, DOCS), sf)
    assert kept.columns == corpus_pipeline.COLUMNS
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, (rows[0], rows[2], rows[4])))


def test_large_groups_meet_block_by_block(spark, monkeypatch):
    r = np.random.default_rng(11)
    near = []
    for i in range(70):
        line = list("every one of these lines is a near copy of the same sentence")
        line[r.integers(0, len(line))] = chr(97 + r.integers(0, 26))
        near.append("".join(line))
    docs = spark.createDataFrame([doc(i, t + f"\nown {i * 7919 % 104729}") for i, t in enumerate(near)], DOCS)
    columns = ("doc_id", "text", "n_exact", "n_near", "n_links")
    whole = {tuple(x) for x in line_dedup.dedup_lines(docs).select(*columns).collect()}
    texts = {" ".join(f"w{k}" for k in range(80)) + f" own{i // 2} end" for i in range(60)} | {f"text {i} alone " * 9 for i in range(5)}
    more = spark.createDataFrame([doc(i, t) for i, t in enumerate(sorted(texts))], DOCS)
    kept = {x["doc_id"] for x in corpus_pipeline.copies(spark, more, "").collect()}
    monkeypatch.setattr(line_dedup, "HOT", 9)
    monkeypatch.setattr(line_dedup, "BLOCK", 8)
    monkeypatch.setattr(shingle_sets, "BLOCK", 4)
    assert {tuple(x) for x in line_dedup.dedup_lines(docs).select(*columns).collect()} == whole
    assert {x["doc_id"] for x in corpus_pipeline.copies(spark, more, "").collect()} == kept
    distinct = set(near)
    links = {a: sum(edits(a, b) <= 2 for b in distinct - {a}) for a in distinct}
    assert {(i, n) for i, _, _, _, n in whole} == {(i, links[a]) for i, a in enumerate(near)}
