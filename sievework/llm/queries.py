"""The ten operators as queries over whole tables, and DuckDB SQL where it can say the same."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import class_lm, decontamination, line_dedup, packing, quality_rules, quotation_threads, sharding, simhash_golay, token_counts, warc_index
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return out.select("doc_id", "size", crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_index.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return class_lm.score(docs, class_lm.ClassModel(docs))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), **line_dedup.WHOLE)
    kept = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_exact", "n_near", "n_links", F.size("removed").alias("n_removed"), F.octet_length(kept).alias("kept_bytes"), F.crc32(kept.cast("binary")).alias("kept_crc32"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_quotation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quotation_threads.as_conversations(quotation_threads.threads(table(spark, sf_dir, "conversations")))
    return out.select("conv_id", "turn", "role", "reply_text", "parent_turn", "thread_turn", "depth", "n_quoted", "n_linked")


def op10_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_golay.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_sharding, op3_warc, op4_packing, op5_class_lm, op6_quality_rules, op7_line_dedup, op8_decontamination, op9_quotation_threads, op10_simhash_golay, pipeline)}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
QUINTET = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha, 1 + 5 * g, 5))::BIGINT >> {shift}) & 31)::INT, 1)"

ORACLE_SQL = {
    "op3_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
        d AS (SELECT sha, string_agg({' || '.join(QUINTET.format(shift=k) for k in (15, 10, 5, 0))}, '' ORDER BY g) AS digest FROM (SELECT DISTINCT sha FROM p), (SELECT unnest(range(8)) AS g) GROUP BY sha)
        SELECT page_id, strlen(html) AS payload_bytes, digest AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to FROM p JOIN d USING (sha)
    """,
    "op8_decontamination": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
        b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {WORDS} AS w FROM benchmark),
        s AS (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
        bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS v FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM s)),
        dn AS (SELECT r, w, n FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
        dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS v FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dn)),
        h AS (SELECT DISTINCT r, i, n, item FROM dw JOIN bw USING (n, v)),
        k AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS spot FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
        t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN k USING (r) LEFT JOIN t USING (r)
    """,
    "op9_quotation_threads": r"""
        WITH RECURSIVE i AS (SELECT row_number() OVER () AS message, conv_id, turn, string_split_regex(text, '\r?\n') AS s FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL),
        m AS (SELECT message, conv_id, turn, unnest(s) AS line, unnest(range(len(s))) AS place FROM i),
        q AS (SELECT *, regexp_extract(line, '^([ \t]*>)+') AS mark FROM m),
        l AS (SELECT message, conv_id, turn, place, length(regexp_replace(mark, '[^>]', '', 'g')) AS level, trim(regexp_replace(lower(substr(line, length(mark) + 1)), '[^\p{L}\p{N}]+', ' ', 'g')) AS bare FROM q),
        g AS (SELECT *, (lag(level) OVER (PARTITION BY message ORDER BY place) IS DISTINCT FROM level)::INT AS changed FROM l WHERE bare <> ''),
        h AS (SELECT *, sum(changed) OVER (PARTITION BY message ORDER BY place) AS stretch FROM g),
        z AS (SELECT *, string_agg(bare, chr(10)) OVER (PARTITION BY message, stretch ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS whole FROM h),
        o AS (SELECT conv_id, bare, min(turn) AS by_line FROM z WHERE level = 0 GROUP BY ALL),
        w AS (SELECT conv_id, whole, min(turn) AS by_whole FROM z WHERE level = 0 GROUP BY ALL),
        u AS (SELECT conv_id, turn, bare, whole, min(level) AS level FROM z WHERE level > 0 GROUP BY ALL),
        e AS (SELECT u.*, coalesce(CASE WHEN by_whole < u.turn THEN by_whole END, CASE WHEN by_line < u.turn THEN by_line END) AS original FROM u LEFT JOIN o ON o.conv_id = u.conv_id AND o.bare = u.bare LEFT JOIN w ON w.conv_id = u.conv_id AND w.whole = u.whole),
        f AS (SELECT conv_id, turn, bare, level, original FROM e QUALIFY row_number() OVER (PARTITION BY conv_id, turn, bare ORDER BY original IS NULL, level, original) = 1),
        c AS (SELECT conv_id, turn, original, min(level) AS level, count(*) AS n FROM f GROUP BY ALL),
        p AS (SELECT conv_id, turn, sum(n) AS n_quoted, coalesce(sum(n) FILTER (original IS NOT NULL), 0) AS n_linked,
                     first(original ORDER BY level, n DESC, original DESC) FILTER (original IS NOT NULL) AS parent_turn FROM c GROUP BY ALL),
        t AS (SELECT conv_id, turn, turn AS up, 0 AS depth FROM p WHERE parent_turn IS NOT NULL
              UNION ALL SELECT t.conv_id, t.turn, p.parent_turn, t.depth + 1 FROM t JOIN p ON p.conv_id = t.conv_id AND p.turn = t.up WHERE p.parent_turn IS NOT NULL),
        r AS (SELECT conv_id, turn, max(depth) AS depth, min(up) AS thread_turn FROM t GROUP BY ALL)
        SELECT s.conv_id, s.turn, s.role,
               regexp_replace(array_to_string(list_filter(string_split_regex(text, '\r?\n'), lambda x: NOT regexp_matches(x, '^([ \t]*>)+') AND NOT regexp_matches(x, '^(On|Am|Le|El)\b.*(wrote|schrieb.*|a écrit ?|escribió):[ \t]*$')), chr(10)), '^\s+|\s+$', '', 'g') AS reply_text,
               parent_turn, coalesce(thread_turn, s.turn) AS thread_turn, coalesce(depth, 0)::BIGINT AS depth, coalesce(n_quoted, 0)::BIGINT AS n_quoted, coalesce(n_linked, 0)::BIGINT AS n_linked
        FROM conversations s LEFT JOIN p ON p.conv_id = s.conv_id AND p.turn = s.turn LEFT JOIN r ON r.conv_id = s.conv_id AND r.turn = s.turn
    """,
}
