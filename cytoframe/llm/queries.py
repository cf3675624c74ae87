"""The registered queries of the corpus operators, and the SQL that some of them can be held against."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cytoframe.llm import decontaminate, embed_neardup, langid, ngram_join, packing, quality, resample, secrets, sharding, suffix_dedup, warc, window_dedup
from cytoframe.llm._session import shared_dir, spread, table


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer's file as text, by path or the installed one for op7."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def _documents(spark, sf_dir):
    """The documents over all cores, for operators that work on each where it stands."""
    return spread(table(spark, sf_dir, "documents"))


def op1_ngram_join(spark, sf_dir):
    rows = ngram_join.similar_documents(table(spark, sf_dir, "documents"), shingle=4, percent=85)
    return rows.select("doc_id", "n_shingles", "component_id")


def op2_secret_scan(spark, sf_dir):
    found = secrets.find_secrets(_documents(spark, sf_dir))

    def joined(column):
        return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op3_byte_shards(spark, sf_dir):
    rows = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_suffix_dedup(spark, sf_dir):
    rows = suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_decontamination(spark, sf_dir):
    rows = decontaminate.contamination(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_language(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    found = langid.predict_language(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_packing(spark, sf_dir):
    return packing.pack_tokens(_documents(spark, sf_dir), tokenizer_json(), chunked=True)


def op8_embedding_neardup(spark, sf_dir):
    return embed_neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_window_dedup(spark, sf_dir):
    rows = window_dedup.remove_repeated_windows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_quality(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))


def op11_importance_resampling(spark, sf_dir):
    rows = resample.importance_scores(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op12_warc(spark, sf_dir):
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4()}"
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_join,
        op2_secret_scan,
        op3_byte_shards,
        op4_suffix_dedup,
        op5_decontamination,
        op6_language,
        op7_packing,
        op8_embedding_neardup,
        op9_window_dedup,
        op10_quality,
        op11_importance_resampling,
        op12_warc,
    )
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: SQL for the queries that it can express; the others are tested against brute force, round trips or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_FOLDED)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS d, doc_id AS o FROM documents UNION SELECT r.d, l.b FROM r JOIN l ON l.a = r.o)
SELECT r.d AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.d GROUP BY r.d""",
    "op3_byte_shards": """
WITH tb AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), [CAST(0 AS BIGINT) for k in range(8)]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
s AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || h AS BIGINT) for h in regexp_extract_all(hex(encode(coalesce(text, ''))), '..')]), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) AS text_crc32 FROM documents, tb),
o AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) AS ends, sum(size) OVER () AS total FROM s),
p AS (SELECT *, CAST(least((2 * ends - size) * 40 // (2 * total), 39) AS INTEGER) AS shard FROM o)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p""",
    "op4_suffix_dedup": """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
h AS (SELECT doc_id, octet_length(t) AS n, hex(t) AS x FROM b),
win AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS i FROM h WHERE n >= 100)),
f AS (SELECT *, min((doc_id, i)) OVER (PARTITION BY k) AS first FROM win),
g AS (SELECT doc_id, i FROM f WHERE first < (doc_id, i)),
m AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 100 THEN 0 ELSE 1 END AS starts FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM m) GROUP BY doc_id, s),
k AS (SELECT doc_id, n, x, list(a ORDER BY a) FILTER (a IS NOT NULL) AS a, list(z ORDER BY a) FILTER (a IS NOT NULL) AS z FROM h LEFT JOIN c USING (doc_id) GROUP BY ALL)
SELECT doc_id, n AS n_bytes, CAST(coalesce(list_sum(z) - list_sum(a), 0) AS BIGINT) AS n_removed, CAST(coalesce(len(a), 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN a IS NULL THEN x ELSE array_to_string([substr(x, 2 * (CASE WHEN j = 1 THEN 0 ELSE z[j - 1] END) + 1, 2 * ((CASE WHEN j > len(a) THEN n ELSE a[j] END) - (CASE WHEN j = 1 THEN 0 ELSE z[j - 1] END))) for j in range(1, len(a) + 2)], '') END)) AS kept_sha256 FROM k""",
    "op5_decontamination": f"""
WITH i AS (SELECT item_id, ws, least(13, len(ws)) AS m FROM (SELECT item_id, {_TERMS} AS ws FROM benchmark) WHERE len(ws) > 0),
v AS (SELECT DISTINCT item_id, m, array_to_string(ws[j : j + m - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) AS j FROM i)),
sizes AS (SELECT DISTINCT m FROM v),
d AS (SELECT doc_id, {_TERMS} AS ws FROM documents),
o AS (SELECT doc_id, j, m, array_to_string(ws[j : j + m - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) AS j FROM d, sizes WHERE len(ws) >= m)),
f AS (SELECT DISTINCT o.doc_id, o.j, o.m, v.item_id FROM o JOIN v USING (m, k)),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(j, j + m)) AS p FROM f) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n, array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS ids FROM f GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op8_embedding_neardup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r AS (SELECT vec_id AS d, vec_id AS o FROM v UNION SELECT r.d, p.b FROM r JOIN p ON p.a = r.o)
SELECT d AS vec_id, (SELECT count(*) FROM p WHERE p.a = d) AS n_links, min(o) AS component_id, d = min(o) AS kept FROM r GROUP BY d""",
    "op9_window_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
v AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY k) AS first FROM v),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM f WHERE first < doc_id),
a AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
k AS (SELECT a.doc_id, count(g.p) AS n_removed, string_agg(a.word, ' ' ORDER BY a.p) FILTER (g.p IS NULL) AS kept FROM a LEFT JOIN g ON g.doc_id = a.doc_id AND g.p = a.p GROUP BY a.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
    "op11_importance_resampling": f"""
WITH tb AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), [CAST(0 AS BIGINT) for k in range(8)]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, {_TERMS} AS ws FROM documents),
b AS (SELECT {_TERMS} AS ws FROM benchmark),
f AS (SELECT doc_id, array_to_string(ws[i : i + n - 1], ' ') AS g, count(*) AS k FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (VALUES (1), (2), (3)) v(n)) GROUP BY ALL),
e AS (SELECT array_to_string(ws[i : i + n - 1], ' ') AS g, count(*) AS k FROM (SELECT ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM b, (VALUES (1), (2), (3)) v(n)) GROUP BY ALL),
h AS (SELECT g, hex(encode(g)) AS x FROM (SELECT g FROM f UNION SELECT g FROM e)),
u AS (SELECT g, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || substr(x, 2 * j + 1, 2) AS BIGINT) for j in range(len(x) // 2)]), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS q FROM h, tb),
s AS (SELECT q, sum(k) AS n FROM f JOIN u USING (g) GROUP BY q),
t AS (SELECT q, sum(k) AS n FROM e JOIN u USING (g) GROUP BY q),
z AS (SELECT CAST(coalesce((SELECT sum(n) FROM s), 0) AS DOUBLE) AS s, CAST(coalesce((SELECT sum(n) FROM t), 0) AS DOUBLE) AS t),
w AS (SELECT s.q, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * (z.s + 10000) / ((s.n::DOUBLE + 1) * (z.t + 10000)))) AS gain FROM s LEFT JOIN t USING (q), z),
o AS (SELECT doc_id, sum(k) AS n, sum(k * gain) AS weight FROM f JOIN u USING (g) JOIN w USING (q) GROUP BY doc_id),
r AS (SELECT d.doc_id, len(ws) AS n_words, CAST(coalesce(o.n, 0) AS BIGINT) AS n_features, CAST(coalesce(o.weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(o.weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || d.doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN o USING (doc_id)),
p AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM r WHERE n_words >= 20)
SELECT r.doc_id, n_features, weight, score, CASE WHEN rank <= 5 * p.n // 100 THEN rank END AS rank FROM r LEFT JOIN p USING (doc_id)""",
    "op12_warc": """
WITH d AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, octet_length(encode(t)) AS n, sha1(t) AS x, min(page_id) OVER (PARTITION BY t) AS first FROM d)
SELECT page_id, n AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1) for i in range(32)], '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM h""",
}
