"""The queries opN_<name>: each applies its operator to the whole of its table and returns its digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, join_feed, media, packing, pieces, secrets, simhash, substring, token_files, toxicity, warc, whitening, zset
from .common import table


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"))
    return token_files.read_token_files(manifest)


def op2_media_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _ = media.write_archives(table(spark, sf_dir, "documents"))
    return media.media_features(media.read_archives(spark, path))


def op3_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_pieces, ids_sha256 (of the ids as little-endian unsigned 16-bit integers),
    decoded_sha256 (of the text decoded from them)."""
    decoded = pieces.decode(pieces.encode(table(spark, sf_dir, "documents")))
    return decoded.select("doc_id", "n_pieces", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.spans_text(F.col("base")), 256).alias("base_sha256"),
        secrets.spans_text(F.col("spans")).alias("spans"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))  # no id: not held out
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), texts=False)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_warc(warc.with_revisits(table(spark, sf_dir, "pages")))
    return warc.record_table(warc.read_warc(manifest))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.search(table(spark, sf_dir, "documents"), decontaminate.Benchmark(table(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(decontaminate.items_text("items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_join_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    circuit = zset.RightOuterJoin("join_key", {"doc_part": F.lit("-")})
    out = []
    for t in (0, 1, 2):
        changed = circuit.step(join_feed.changes(docs, "d", t, join_feed.document_rows), join_feed.changes(labels, "l", t, join_feed.label_rows))
        out.append(changed.select(F.lit(t).alias("batch"), "join_key", "doc_part", "label_part", "weight", "total"))
    return zset.plus(*out[1:])


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_planes,
        op2_media_archive,
        op3_hilbert_packing,
        op4_sentencepiece,
        op5_secret_scan,
        op6_toxicity,
        op7_simhash,
        op8_substring_dedup,
        op9_warc,
        op10_exact_dedup,
        op11_decontaminate,
        op12_whiten,
        op13_join_maintenance,
    )
}

ORACLE_SQL = {
    "op8_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, s, array_to_string(w[s:s + 49], ' ') AS t
                FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
        early AS (SELECT t, min(doc_id) AS lo FROM win GROUP BY t HAVING min(doc_id) < max(doc_id)),
        hit AS (SELECT doc_id, s FROM win JOIN early USING (t) WHERE doc_id > lo),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM hit),
        word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS k, count(*) AS n
                 FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(k, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        g AS (SELECT page_id, h, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS chief FROM p),
        b AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(x, 5 * i + 1, 5) AS BIGINT)) AS v FROM g)
        SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST((v[j // 4 + 1] >> (15 - 5 * (j % 4))) & 31 AS INT) + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = chief THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> chief THEN chief END AS refers_to
        FROM b""",
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op11_decontaminate": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS t
                FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0)),
        gram AS (SELECT r, s, k, array_to_string(w[s:s + k - 1], ' ') AS t
                 FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
        hit AS (SELECT DISTINCT r, s, k, item_id FROM gram JOIN win USING (k, t)),
        word AS (SELECT r, count(DISTINCT i) AS n FROM (SELECT r, unnest(range(s, s + k)) AS i FROM (SELECT DISTINCT r, s, k FROM hit)) GROUP BY r),
        item AS (SELECT r, count(*) AS n, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(word.n, 0) AS n_hit, coalesce(item.n, 0) AS n_items,
               sha256(coalesce(l, '')) AS items_sha256, coalesce(word.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN word USING (r) LEFT JOIN item USING (r)""",
    # The table of CRC-32 is made from its polynomial; c is taken over the bytes of texts like d:17:3.
    "op13_join_maintenance": """
        WITH crc AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS x FROM range(256) g(i)),
        ids AS (SELECT DISTINCT 'd' AS p, doc_id FROM documents UNION ALL SELECT DISTINCT 'l', doc_id FROM labels),
        txt AS (SELECT p, doc_id, t, list_transform(string_split(concat(p, ':', coalesce(CAST(doc_id AS VARCHAR), 'null'), ':', t), ''), lambda a: CAST(ord(a) AS BIGINT)) AS b FROM ids, range(3) g(t)),
        c AS (SELECT p, doc_id, t, xor(list_reduce(list_concat([4294967295], b), lambda a, y: xor(a >> 8, x[(xor(a, y) & 255) + 1])), 4294967295) AS c FROM txt, crc),
        w AS (SELECT p, doc_id, any_value(c) FILTER (t = 0) % 3 <> 0 AS p0, any_value(c) FILTER (t = 1) % 19 AS c1, any_value(c) FILTER (t = 2) % 19 AS c2 FROM c GROUP BY p, doc_id),
        w1 AS (SELECT *, CAST(c1 = 1 AND p0 AS INT) AS u1, CASE WHEN c1 = 0 THEN NOT p0 ELSE p0 END AS p1 FROM w),
        w2 AS (SELECT *, u1 + CAST(c2 = 1 AND p1 AS INT) AS u2, CASE WHEN c2 = 0 THEN NOT p1 ELSE p1 END AS p2 FROM w1),
        st AS (SELECT p, doc_id, 0 AS t, 0 AS u FROM w2 WHERE p0 UNION ALL SELECT p, doc_id, 1, u1 FROM w2 WHERE p1 UNION ALL SELECT p, doc_id, 2, u2 FROM w2 WHERE p2),
        d AS (SELECT t, CAST(floor(s.doc_id / 3.0) AS BIGINT) + u AS k, coalesce(lang, 'null') AS doc_part
              FROM documents x JOIN st s ON p = 'd' AND x.doc_id IS NOT DISTINCT FROM s.doc_id),
        l AS (SELECT t, CAST(floor(s.doc_id / 3.0) AS BIGINT) AS k,
                     concat(coalesce(CAST(CASE WHEN u % 2 = 1 THEN 1 - quality ELSE quality END AS VARCHAR), 'null'), ',', coalesce(CAST(toxic AS VARCHAR), 'null')) AS label_part
              FROM labels x JOIN st s ON p = 'l' AND x.doc_id IS NOT DISTINCT FROM s.doc_id),
        j AS (SELECT l.t, l.k AS join_key, coalesce(doc_part, '-') AS doc_part, label_part, count(*) AS n FROM l LEFT JOIN d ON d.t = l.t AND d.k = l.k GROUP BY ALL),
        z AS (SELECT t AS batch, join_key, doc_part, label_part, n AS weight, n AS total FROM j WHERE t > 0
              UNION ALL SELECT t + 1, join_key, doc_part, label_part, -n, 0 FROM j WHERE t < 2)
        SELECT CAST(batch AS INT) AS batch, join_key, doc_part, label_part, CAST(sum(weight) AS BIGINT) AS weight, CAST(sum(total) AS BIGINT) AS total
        FROM z GROUP BY ALL HAVING sum(weight) <> 0""",
}
