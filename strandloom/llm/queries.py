"""The registered queries of this subpackage over the given tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import bpe, fill_middle, filter_audit, fingerprints, html_extract, jaccard_join, langid, line_dedup, media, mixing
from strandloom.llm import pii, quality, secret_scan


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next_fingerprints(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = quality.fold(F.col("doc_id"), 5) == 0
    forest = quality.train(documents, labels, held_out)
    scored = quality.score_quality(documents, forest)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.KEEP_SCORE).cast("int").alias("predicted")
    )


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract_pages(pages).withColumn("n_chars", F.length("text").cast("long"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = documents.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), media.text_to_media(F.col("text")).alias("media")
    )
    # Declared as what a store says that doesn't know; the signature corrects it.
    found = media.with_features(stored.withColumn("declared", F.lit("application/octet-stream")), declared="declared")
    shown = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "true_type", "corrected")
    return found.select("doc_id", "n_bytes", *[f"features.{k}" for k in shown])


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    held_out = quality.fold(F.col("doc_id"), 3) == 1
    model = langid.train(documents, ~held_out)
    found = langid.identify(documents, model, spans=False)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, ids=False)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_mix(_table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five filters over all documents, by language; nulls, copies and empty tables as ``filter_audit.audit`` says."""
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's files are added as batches; then lines of keys in at least ten documents go from all documents."""
    documents = _table(spark, sf_dir, "documents")
    stripped = line_dedup.dedup_lines(line_dedup.file_batches(documents), documents)
    return stripped.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document transformed, its output's hash and that of the text restored from it."""
    made = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    restored = fill_middle.restore(F.col("output"), F.col("form"))
    hashes = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashes)


QUERIES = {
    f.__name__: f
    for f in (
        op1_fingerprints, op2_quality, op3_html, op4_pii, op5_secrets, op6_jaccard_join, op7_media, op8_language, op9_bpe, op10_mix,
        op11_filter_audit, op12_line_dedup, op13_fill_middle,
    )
}

_MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, CAST(3 * source_size AS BIGINT) AS cap,
         CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w
  FROM sums
), placed AS (
  SELECT *, row_number() OVER o AS place, sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_size,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight
  FROM weighed WINDOW o AS (ORDER BY cap / w, source ASC NULLS LAST)
), opened AS (
  SELECT *, min(CASE WHEN w * left_size <= cap * left_weight THEN place END) OVER () AS free FROM placed
), at_free AS (
  SELECT *, max(CASE WHEN place = free THEN left_size END) OVER () AS size_f, max(CASE WHEN place = free THEN left_weight END) OVER () AS weight_f FROM opened
), targets AS (
  SELECT source, source_size, CASE WHEN place >= free THEN CAST(w * size_f AS DOUBLE) / CAST(weight_f AS DOUBLE) ELSE CAST(cap AS DOUBLE) END AS target FROM at_free
), rates AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rates
"""

#: Every pair of documents with a common shingle is counted, and components are closed by recursion: for small tables.
_JACCARD_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY 1
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs JOIN sizes u ON u.doc_id = x JOIN sizes v ON v.doc_id = y WHERE 100 * c >= 75 * (u.n + v.n - c)
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.c AS component_id
FROM documents d JOIN (SELECT x, min(y) AS c FROM reach GROUP BY 1) r ON r.x = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

#: Every order of the filters is walked; a document's step is its first failed filter in it.
_AUDIT_SQL = """
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), failed AS (
  SELECT d.part,
         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(body) - length(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(body) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 'E' ELSE '' END AS fails,
         coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
  FROM words d LEFT JOIN (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1
  ) l USING (doc_id)
), masks AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY 1, 2
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS f, filter_order[1 : step - 1] AS earlier
  FROM (SELECT DISTINCT part FROM masks), orders, (SELECT unnest(range(1, 6)) AS step)
), walked AS (
  SELECT s.part, filter_order, step, f, n, good, toxic, contains(fails, f) AS fails_it, fails = f AS only_it,
         translate(fails, earlier, '') <> fails AS gone
  FROM steps s JOIN masks m ON m.part = s.part
), counted AS (
  SELECT part, filter_order, step, f, CAST(sum(CASE WHEN gone OR fails_it THEN 0 ELSE n END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN fails_it AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN fails_it AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN only_it THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN fails_it AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN fails_it AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM walked GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""

_LINES_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), often AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(o.k) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE o.k IS NULL), '')) AS kept_sha256
FROM keyed x LEFT JOIN often o ON x.k = o.k GROUP BY doc_id
"""

_MIDDLE_SQL = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS body, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u
  FROM documents
), drawn AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS c2,
         CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50
              THEN 'plain' WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM units
), cut AS (
  SELECT *, array_to_string(u[1 : least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1 : greatest(c1, c2)], '') AS m, array_to_string(u[greatest(c1, c2) + 1 :], '') AS s FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM cut
"""

SQL = {
    "op6_jaccard_join": _JACCARD_SQL,
    "op10_mix": _MIX_SQL,
    "op11_filter_audit": _AUDIT_SQL,
    "op12_line_dedup": _LINES_SQL,
    "op13_fill_middle": _MIDDLE_SQL,
}
