"""Registered queries of the numbered operators, and the DuckDB twins SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlake.llm import ann, audit, bpe, decontam, linededup, pii, quality, resample, simhash, tokencount, toxicity, urlfilter, warc
from cardlake.session import checkpoint_dir, table

Query = Callable[[SparkSession, str], DataFrame]


#: vocabulary of the tokenizer queries
BYTE_BPE = "byte_bpe_50k.json"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives in the shared folder and read back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.payload_table(warc.read_archives(spark, path))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all vectors."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that are on over 2 % of their source's pages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return linededup.drop_boilerplate(docs, "source", "text", ratio=0.02, min_pages=3, counts=("n_lines", "n_dropped"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded; digests of the ids and of the decoded texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode_decode(docs, public_tokenizers.path(BYTE_BPE))
    return out.select(
        "doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded_text").cast("binary"), 256).alias("decoded_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), limit=512)


#: fixed values: the rules of the url query, as (host, path, verdict)
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages judged by the rules."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items leaked by all documents: 5-word shingles, similarity 0.8."""
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates of all documents: 4-word shingles, 4 bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", mod=3, rest=1)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", mod=5, rest=0)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of the five filters over all documents, per source."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents: base counts and digest, and all spans."""
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.span_text(base).cast("binary"), 256).alias("base_sha256"),
                        pii.span_text(F.col("spans")).alias("spans"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents of at least 20 words, drawn towards the benchmark."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_warc": op1_warc,
    "op2_ann": op2_ann,
    "op3_line_dedup": op3_line_dedup,
    "op4_bpe": op4_bpe,
    "op5_token_counts": op5_token_counts,
    "op6_url_filter": op6_url_filter,
    "op7_decontam": op7_decontam,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_filter_audit": op11_filter_audit,
    "op12_pii": op12_pii,
    "op13_resample": op13_resample,
}

SQL: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
d AS (SELECT page_id, payload_bytes, sha1(html) AS payload_digest FROM p),
o AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS original FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to FROM o""",
    "op3_line_dedup": """
WITH pages AS (SELECT DISTINCT source, text FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
totals AS (SELECT source, count(*) AS total FROM pages GROUP BY source),
lines AS (SELECT DISTINCT source, text, trim(line) AS line
          FROM (SELECT source, text, unnest(string_split(text, chr(10))) AS line FROM pages)),
over AS (SELECT source, line FROM lines JOIN totals USING (source) WHERE line <> ''
         GROUP BY source, line, total HAVING count(*) >= 3 AND count(*)::DOUBLE / total > 0.02),
sets AS (SELECT source, list(line) AS gone FROM over GROUP BY source),
cleaned AS (SELECT d.doc_id, d.source, string_split(d.text, chr(10)) AS parts,
                   list_filter(string_split(d.text, chr(10)), lambda x: NOT coalesce(list_contains(s.gone, trim(x)), false)) AS kept
            FROM documents d LEFT JOIN sets s ON d.source = s.source)
SELECT doc_id, source, array_to_string(kept, chr(10)) AS text, coalesce(len(parts), 0)::INTEGER AS n_lines,
       coalesce(len(parts) - len(kept), 0)::INTEGER AS n_dropped FROM cleaned""",
    "op6_url_filter": f"""
WITH rules(rhost, rpath, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
urls AS (SELECT DISTINCT host, path FROM parts),
won AS (SELECT host, path, max(struct_pack(size := length(rhost || rpath), hs := length(rhost), rule := rhost || rpath, verdict := verdict)) AS r
        FROM urls JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path)
SELECT p.page_id, coalesce(p.host, '') AS host, coalesce(p.path, '') AS path, r.rule AS rule, coalesce(r.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN won ON p.host = won.host AND p.path = won.path""",
    "op11_filter_audit": r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM docs),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                 (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
                 + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
                 + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask
          FROM words LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
f(x, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
           FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
           AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (SELECT o, k::INT AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before FROM orders, range(1, 6) r(k)),
counts AS (SELECT part, o AS filter_order, step, bit,
                  coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
                  coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
                  coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
                  coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
                  coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
                  coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
           FROM cells, steps GROUP BY part, o, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counts""",
    "op13_resample": rf"""
WITH crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
             FROM range(256) r(i)),
d AS (SELECT 0 AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{urlfilter.UPPER}', '{urlfilter.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
      UNION ALL
      SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), '{urlfilter.UPPER}', '{urlfilter.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
occ AS (SELECT side, doc_id, word, count(*) AS n FROM (SELECT side, doc_id, unnest(w) AS word FROM d) GROUP BY side, doc_id, word),
hexed AS (SELECT word, list_transform(range(2 * strlen(word)), lambda i: instr('0123456789ABCDEF', substr(hex(word), i + 1, 1)) - 1) AS x FROM (SELECT DISTINCT word FROM occ)),
bucket AS (SELECT word, xor(list_reduce([4294967295] || list_transform(range(len(x) // 2), lambda i: x[2 * i + 1] * 16 + x[2 * i + 2]),
                            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b FROM hexed, crc),
tot AS (SELECT b, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM occ JOIN bucket USING (word) GROUP BY b),
whole AS (SELECT sum(s) AS s_all, coalesce(sum(t), 0) AS t_all FROM tot),
gain AS (SELECT b, floor(1000 * ln(((coalesce(t, 0) + 1) * (s_all + 10000))::DOUBLE / ((coalesce(s, 0) + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS g FROM tot, whole),
weights AS (SELECT doc_id, sum(n * g)::BIGINT AS weight FROM occ JOIN bucket USING (word) JOIN gain USING (b) WHERE side = 0 GROUP BY doc_id),
hashed AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
                  list_reduce(list_transform(range(8), lambda i: instr('0123456789abcdef', substr(sha256('2024:' || doc_id), i + 1, 1)) - 1), lambda a, b: a * 16 + b) AS h
           FROM d LEFT JOIN weights USING (doc_id) WHERE side = 0),
scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM hashed),
ranked AS (SELECT *, n_features >= 20 AS able, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
                  count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 10 * n // 100 THEN place END AS rank FROM ranked""",
}
