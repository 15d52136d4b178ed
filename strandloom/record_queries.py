"""Registered queries on records, pairs, filters and small functions of hits, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom import sql_parts as q
from strandloom.functions import cigar as cigars
from strandloom.functions.sequence import bases, largest_gap, least_band, strand_position, subsequence, unescape
from strandloom.jobs import mapping
from strandloom.operators import hits, intervals, records, scoring, seeds, sketch
from strandloom.queries import _REGION, _benchmark, _documents, _exact, _register, map_passages, map_regions, mapq_short

_KEY = ["read_id", "rid", "rev", "qs", "qe", "rs"]
_LETTER = "substr('ACGT', ascii({}) % 4 + 1, 1)"


def _reads(spark: SparkSession, d: str) -> DataFrame:
    return _benchmark(spark, d).select(
        F.col("item_id").alias("read_id"), F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("name"), bases(F.col("text")).alias("seq"), F.lit(None).cast("string").alias("qual")
    )


@_register(f"""WITH {q.best()},{q.rivals()}, r AS (SELECT item_id AS read_id, 'item' || item_id AS name, length(text) AS len,
  array_to_string(list_transform(string_split(text, ''), lambda x: {_LETTER.format('x')}), '') AS fwd,
  array_to_string(list_transform(list_reverse(string_split(text, '')), lambda x: substr('TGCA', ascii(x) % 4 + 1, 1)), '') AS turned FROM benchmark),
y AS (SELECT *, {q.mapq_short()} AS mapq FROM v),
h AS (SELECT v.*, r.len, CASE WHEN v.rev THEN turned ELSE fwd END AS seq, CASE WHEN v.rev THEN r.len - v.qe ELSE v.qs END AS lead, CASE WHEN v.rev THEN v.qs ELSE r.len - v.qe END AS trail
  FROM best JOIN y v ON {' AND '.join(f'v.{k} = best.{k}' for k in _KEY)} JOIN r ON r.read_id = v.read_id WHERE place = 1),
k AS (SELECT read_id, k, {_LETTER.format("substr(d.text, rs + k + 1, 1)")} AS t, substr(seq, lead + k + 1, 1) AS c FROM (SELECT h.*, unnest(range(qe - qs)) AS k FROM h) h JOIN documents d ON d.doc_id = h.rid),
w AS (SELECT read_id, k, t, k - lag(k, 1, -1) OVER (PARTITION BY read_id ORDER BY k) - 1 AS run FROM k WHERE c <> t),
e AS (SELECT read_id, count(*) AS nm, string_agg(run || t, '' ORDER BY k) AS md, max(k) AS spot FROM w GROUP BY 1)
SELECT r.read_id, CASE WHEN h.rid IS NULL THEN concat_ws(chr(9), name, '4', '*', '0', '0', '*', '*', '0', '0', fwd, '*')
  ELSE concat_ws(chr(9), name, CASE WHEN rev THEN '16' ELSE '0' END, 'doc' || h.rid, rs + 1, mapq, CASE WHEN lead > 0 THEN lead || 'S' ELSE '' END || (qe - qs) || 'M' || CASE WHEN trail > 0 THEN trail || 'S' ELSE '' END,
    '*', '0', '0', seq, '*', 'NM:i:' || coalesce(nm, 0), 'MD:Z:' || coalesce(md, '') || (qe - qs - 1 - coalesce(spot, -1)), 'AS:i:' || score, 'XS:i:' || sub) END AS line
FROM r LEFT JOIN h ON h.read_id = r.read_id LEFT JOIN e ON e.read_id = r.read_id""")
def sam_records(spark: SparkSession, d: str) -> DataFrame:
    """A record for every benchmark text: its best hit, whose chain lies on one diagonal, or an unmapped record.

    Edits are counted base by base; ``sam_alignments`` has the records of alignments with gaps.
    """
    reads = _reads(spark, d)
    regions = map_regions(spark, d)
    best = hits.best_hits(regions).where("place = 1").select(*_KEY)  # a row for each read at most
    scored = scoring.mapq_short(scoring.rivals(regions).withColumn("frac_rep", F.lit(0.0))).join(best, _KEY)
    placed = mapping.windows(scored.withColumns({"w_from": F.col("rs"), "w_len": F.col("re") - F.col("rs")}), _documents(spark, d), "doc_id", mapping.few(reads))
    read = reads.select("read_id", F.length("seq").alias("len"), "seq")
    turned = F.translate(F.reverse("seq"), "ACGT", "TGCA")
    met = placed.join(read, "read_id").withColumns({"q_bases": F.when(F.col("rev"), turned).otherwise(F.col("seq")), "t_bases": bases(F.col("t"))})
    found = records.ungapped(met)
    false = F.lit(False)
    core = F.concat((F.col("qe") - F.col("qs")).cast("string"), F.lit("M"))
    return records.sam_records(
        reads,
        found.select(
            "read_id",
            "rev",
            cigars.flags(false, F.col("rev"), false, false).alias("flag"),
            F.concat(F.lit("doc"), F.col("rid").cast("string")).alias("rname"),
            F.col("rs").alias("pos"),
            "mapq",
            records.turned_clips(core, F.col("rev"), F.col("qs"), F.col("qe"), F.col("len")).alias("cigar"),
            records.tags(F.col("nm"), F.col("md"), F.col("score"), F.col("sub")).alias("tags"),
        ),
    )


@_register(f"WITH {q.best()} SELECT read_id, '[read id:' || read_id || ']' || chr(9) || (qe - qs) || 'M' AS line FROM best WHERE place = 1")
def cigar_records(spark: SparkSession, d: str) -> DataFrame:
    """The CIGAR of each benchmark text's best hit, as a line."""
    best = map_passages(spark, d).where("place = 1")
    return records.cigar_lines(best.select("read_id", F.concat((F.col("qe") - F.col("qs")).cast("string"), F.lit("M")).alias("cigar")))


_RLE = """WITH c AS (SELECT item_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM benchmark),
o AS (SELECT item_id, i, substr('MID=', ascii(c) % 4 + 1, 1) AS op FROM c), s AS (SELECT *, CASE WHEN op = lag(op) OVER w THEN 0 ELSE 1 END AS cut FROM o WINDOW w AS (PARTITION BY item_id ORDER BY i)),
g AS (SELECT *, sum(cut) OVER (PARTITION BY item_id ORDER BY i) AS g FROM s), r AS (SELECT item_id, g, count(*) AS n, min(op) AS op FROM g GROUP BY 1, 2)"""


@_register(f"""{_RLE} SELECT item_id, string_agg(n || op, '' ORDER BY g) AS cigar, CAST(sum(CASE WHEN op IN ('M', 'I', '=') THEN n ELSE 0 END) AS INTEGER) AS q_bases,
  CAST(sum(CASE WHEN op IN ('M', 'D', '=') THEN n ELSE 0 END) AS INTEGER) AS t_bases, CAST(sum(CASE WHEN op IN ('I', 'D') THEN n ELSE 0 END) AS INTEGER) AS gaps,
  CAST(sum(CASE WHEN op IN ('I', 'D') THEN 1 ELSE 0 END) AS INTEGER) AS opened FROM r GROUP BY 1""")
def merged_cigars(spark: SparkSession, d: str) -> DataFrame:
    """CIGARs of one operation for each character, merged, and what they consume."""
    single = F.array_join(F.transform(F.split(bases(F.col("text")), ""), lambda c: F.when(c != "", F.concat(F.lit("1"), F.translate(c, "ACGT", "MID=")))), "")
    found = _benchmark(spark, d).select("item_id", cigars.merged(single).alias("cigar"))
    c = F.col("cigar")
    return found.select("item_id", c, cigars.query_length(c).alias("q_bases"), cigars.reference_length(c).alias("t_bases"), cigars.gap_bases(c).alias("gaps"), cigars.gap_opens(c).alias("opened"))


@_register(f"""WITH {q.mapped()}, s AS (SELECT m.*, substr(d.text, rs + 1, re - rs) AS piece FROM m JOIN documents d ON d.doc_id = m.rid)
SELECT read_id, rid, rev, rs, re, md5(CASE WHEN rev THEN array_to_string(list_transform(list_reverse(string_split(piece, '')), lambda x: substr('TGCA', ascii(x) % 4 + 1, 1)), '')
  ELSE array_to_string(list_transform(string_split(piece, ''), lambda x: {_LETTER.format('x')}), '') END) AS digest FROM s""")
def hit_bases(spark: SparkSession, d: str) -> DataFrame:
    """The reference's bases under every hit, on the hit's strand."""
    met = map_regions(spark, d).join(_documents(spark, d).select(F.col("doc_id").alias("rid"), "text"), "rid")
    return met.select("read_id", "rid", "rev", "rs", "re", F.md5(subsequence(F.col("text"), F.col("rs"), F.col("re"), F.col("rev"))).alias("digest"))


@_register("WITH t AS (SELECT sum(length(text)) AS n FROM documents), p AS (SELECT o_orderkey, (o_orderkey * 104729) % (2 * n) AS spot, n FROM orders, t) SELECT o_orderkey, CAST(CASE WHEN spot >= n THEN 2 * n - 1 - spot ELSE spot END AS BIGINT) AS pos, spot >= n AS rev FROM p")
def strand_positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions on all documents and their reverse complements, as positions on the documents and a strand."""
    total = _documents(spark, d).agg(F.sum(F.length("text")).cast("long").alias("n"))
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    placed = orders.join(F.broadcast(total)).select("o_orderkey", strand_position((F.col("o_orderkey") * 104729) % (2 * F.col("n")), F.col("n")).alias("p"))
    return placed.select("o_orderkey", F.col("p.pos").cast("long").alias("pos"), "p.rev")


@_register(f"""WITH {q.mapped()}, p AS (SELECT m.*, len.len, qe - qs AS a, re - rs AS b FROM m JOIN len ON len.rid = read_id)
SELECT read_id, rid, rev, qs, qe, rs, re, CAST(least(greatest(trunc((len - 6) / 1.0 + 1), 1), 200) AS INTEGER) AS gap,
  CAST(CASE WHEN a = b AND a - score < 12 THEN 0 ELSE greatest(trunc((least(a, b) - score - 6) / 1.0 + 2), abs(a - b)) END AS INTEGER) AS band FROM p""")
def gap_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The longest gap that each hit's read can pay for, and the band that its score needs."""
    met = map_regions(spark, d).join(mapping.lengths(_benchmark(spark, d), "item_id").withColumnRenamed("rid", "read_id"), "read_id")
    gap = largest_gap(F.col("len"), 1, 6, 1, 100)
    band = least_band(F.col("qe") - F.col("qs"), F.col("re") - F.col("rs"), F.col("score"), 1, 6, 1)
    return met.select(*_KEY, "re", gap.cast("int").alias("gap"), band.cast("int").alias("band"))


@_register(f"WITH {q.mapped()} SELECT {_REGION}, CAST(greatest(trunc(score * (1 - CAST(0.15 AS DOUBLE)) + CAST(0.499 AS DOUBLE)), 1) AS INTEGER) AS alt FROM m")
def alternative_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every hit's score if its document were an alternative sequence."""
    return map_regions(spark, d).withColumn("alt", scoring.alt_score(F.col("score")))


@_register(f"""WITH {q.mapped()},{q.rivals()}, p AS (SELECT *, {q.mapq_short()} AS mapq, rid % 3 = 0 AS inv FROM v), o AS (SELECT *, lag(mapq) OVER w AS before, lead(mapq) OVER w AS after FROM p WINDOW w AS (PARTITION BY read_id ORDER BY rid, rs, re, rev, qs, qe))
SELECT read_id, rid, rev, qs, qe, rs, re, CASE WHEN inv AND before IS NOT NULL AND after IS NOT NULL THEN least(before, after) ELSE mapq END AS mapq FROM o""")
def inversion_qualities(spark: SparkSession, d: str) -> DataFrame:
    """Qualities of hits of which those on every third document stand for inversions."""
    found = scoring.inversion_quality(mapq_short(spark, d).withColumn("inv", F.col("rid") % 3 == 0))
    return found.select(*_KEY, "re", "mapq")


@_register(f"""WITH {q.mapped()}, p AS (SELECT x.read_id, x.rid, x.rs, x.re, y.rs AS m_rs, y.re AS m_re, greatest(x.rs, y.rs) - least(x.re, y.re) AS gap, x.score + y.score AS total
FROM m x JOIN m y ON y.read_id = x.read_id AND y.rid = x.rid AND x.rev = y.rev)
SELECT read_id, rid, rs, re, m_rs, m_re, gap, total FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY total DESC, gap, rid, rs, m_rs) AS i FROM p WHERE gap <= 5000) WHERE i = 1""")
def paired_hits(spark: SparkSession, d: str) -> DataFrame:
    """The best pair of hits of each benchmark text and the same text read from the other strand."""
    found = map_regions(spark, d)
    return hits.pair_hits(found, found.withColumn("rev", ~F.col("rev")), 5000)


@_register(f"""WITH {q.sketch('b', 'benchmark', 'item_id')}, len AS (SELECT item_id AS rid, CAST(coalesce(length(text), 0) AS INTEGER) AS len FROM benchmark),
a AS (SELECT x.rid AS read_id, y.rid AS rid, x.strand <> y.strand AS rev, y.pos AS rpos, CAST(CASE WHEN x.strand <> y.strand THEN len.len - (x.pos - 14) - 1 ELSE x.pos END AS INTEGER) AS qpos FROM b x JOIN b y ON y.hash = x.hash JOIN len ON len.rid = x.rid)
SELECT read_id, rid, rev, rpos, qpos FROM a WHERE read_id <= rid AND NOT rev""")
def self_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Forward anchors among the benchmark texts, each pair in one order."""
    b = _benchmark(spark, d)
    k = sketch.minimizers(b, "item_id")
    found = seeds.skip_pairs(seeds.anchors(k, k, mapping.lengths(b, "item_id")), no_dual=True, reverse=False)
    return found.select("read_id", "rid", "rev", "rpos", "qpos")


@_register(f"""WITH {q.mapped()} SELECT {', '.join('m.' + c for c in _REGION.split(', '))} FROM m JOIN len ON len.rid = m.read_id
WHERE cnt >= 5 AND mlen >= 60 AND score >= 80 AND NOT (qs > len * CAST(0.1 AS DOUBLE) AND len - qe > len * CAST(0.1 AS DOUBLE))""")
def hit_filter(spark: SparkSession, d: str) -> DataFrame:
    """Hits of enough anchors and bases that are not clipped at both ends."""
    return hits.filter_hits(map_regions(spark, d), mapping.lengths(_benchmark(spark, d), "item_id"), 5, 60, 80, 0.1).select(*_REGION.split(", "))


@_register(f"""WITH {q.best()} SELECT {', '.join('x.' + c for c in _REGION.split(', '))}, x.place FROM best x JOIN best p ON p.read_id = x.read_id AND p.place = 1 WHERE x.place = 1 OR x.score >= p.score * CAST(0.9 AS DOUBLE)""")
def secondary_filter(spark: SparkSession, d: str) -> DataFrame:
    """Best hits and those others that score nine tenths of them."""
    return hits.drop_secondary(map_passages(spark, d).withColumn("parent", F.lit(1)), 0.9, every=True).drop("parent")


@_register(f"""WITH {q.mapped()}, r AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY score DESC, cnt DESC, rid, rev, rs, qs) AS p FROM m)
SELECT read_id, max(score) AS best, CAST(sum(CASE WHEN p = 2 THEN score ELSE 0 END) AS INTEGER) AS second, sum(CASE WHEN p = 2 THEN score ELSE 0 END) >= max(score) * CAST(0.95 AS DOUBLE) AS close FROM r WHERE p <= 2 GROUP BY 1""")
def best_and_second(spark: SparkSession, d: str) -> DataFrame:
    return hits.two_best(map_regions(spark, d))


@_register(f"""WITH {q.best()},
n AS (SELECT m.read_id, m.rid, m.rev, m.qs, m.qe, m.rs, count(*) AS n_tot FROM m JOIN b ON b.rid = m.read_id AND b.pos - 14 >= m.qs AND b.pos + 1 <= m.qe GROUP BY ALL),
v AS (SELECT best.read_id, best.rid, best.rev, best.qs, best.rs, place, round(CASE WHEN cnt >= n_tot THEN 0.0 ELSE 1 - pow(CAST(cnt AS DOUBLE) / n_tot, 1.0 / 15) END, 6) AS div FROM best JOIN n ON {' AND '.join(f'n.{k} = best.{k}' for k in _KEY)})
SELECT x.read_id, x.rid, x.rev, x.qs, x.rs, x.place, x.div FROM v x JOIN v p ON p.read_id = x.read_id AND p.place = 1 WHERE x.div < p.div * 5 OR x.div < CAST(0.01 AS DOUBLE)""")
def low_divergence_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits that diverge little, or less than five times as much as the best."""
    regions = map_regions(spark, d)
    diverged = scoring.divergence(regions, sketch.minimizers(_benchmark(spark, d), "item_id"), sketch.K).withColumn("div", F.round("div", 6))
    placed = hits.best_hits(regions).join(diverged.select("read_id", "rid", "rev", "qs", "rs", "div"), ["read_id", "rid", "rev", "qs", "rs"])
    parents = placed.where("place = 1").select("read_id", "place", "div")
    return scoring.strand_retained(placed.withColumn("parent", F.lit(1)), parents).select("read_id", "rid", "rev", "qs", "rs", "place", "div")


@_register(f"WITH {q.exact()} SELECT x.read_id, x.rid, x.rev, CAST(rbeg AS INTEGER) AS rbeg FROM x JOIN l ON l.rid = x.read_id WHERE qbeg = 0 AND qend = len")
def whole_matches(spark: SparkSession, d: str) -> DataFrame:
    """Places of whole benchmark texts in the documents, on either strand."""
    lens = mapping.lengths(_benchmark(spark, d), "item_id").withColumnRenamed("rid", "read_id")
    return _exact(spark, d).join(lens, "read_id").where("qbeg = 0 AND qend = len").select("read_id", "rid", "rev", "rbeg")


@_register(f"""WITH {q.best()} SELECT read_id, rid, place, CAST(length(b.text) AS BIGINT) * length(d.text) AS cells, CAST(length(b.text) AS BIGINT) * length(d.text) <= 300000 AS cheap
FROM best JOIN benchmark b ON b.item_id = read_id JOIN documents d ON d.doc_id = rid""")
def alignment_costs(spark: SparkSession, d: str) -> DataFrame:
    """Which alignments of whole benchmark texts and documents are cheap, and their matrices' cells."""
    q_text, t_text = _benchmark(spark, d).select(F.col("item_id").alias("read_id"), F.col("text").alias("q")), _documents(spark, d).select(F.col("doc_id").alias("rid"), F.col("text").alias("t"))
    cheap, dear = mapping.by_cost(map_passages(spark, d).join(q_text, "read_id").join(t_text, "rid"), 300_000)
    both = cheap.withColumn("cheap", F.lit(True)).unionByName(dear.withColumn("cheap", F.lit(False)))
    return both.select("read_id", "rid", "place", (F.length("q").cast("long") * F.length("t")).alias("cells"), "cheap")


@_register(f"""WITH {q.sketch('b', 'benchmark', 'item_id')}, w AS (SELECT item_id AS rid, i AS window_id, i * 64 AS w_st, i * 64 + 64 AS w_en FROM benchmark, range(3) t(i))
SELECT window_id, b.rid, CAST(pos - 14 AS INTEGER) AS st, CAST(pos + 1 AS INTEGER) AS en FROM b JOIN w ON w.rid = b.rid AND pos - 14 >= w_st AND pos + 1 <= w_en""")
def windows_inside(spark: SparkSession, d: str) -> DataFrame:
    """Minimizers that lie wholly within the first three windows of 64 characters of their text."""
    b = _benchmark(spark, d)
    windows = b.select(F.col("item_id").alias("rid"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("window_id")).withColumns({"w_st": F.col("window_id") * 64, "w_en": F.col("window_id") * 64 + 64})
    spans = sketch.minimizers(b, "item_id").select("rid", (F.col("pos") + 1 - F.col("span")).alias("st"), (F.col("pos") + 1).alias("en"))
    return intervals.inside(spans, windows)


@_register(r"""SELECT item_id, md5(replace(replace(replace(replace(replace(replace(text, ' ', '\t'), '\\', chr(0)), '\t', chr(9)), '\n', chr(10)), '\r', chr(13)), chr(0), '\')) AS digest FROM benchmark""")
def unescaped_texts(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts whose blanks were written as backslash t, with these read as tabs."""
    return _benchmark(spark, d).select("item_id", F.md5(unescape(F.replace("text", F.lit(" "), F.lit("\\t")))).alias("digest"))


@_register(f"""WITH {q.mapped()} SELECT read_id, rid, rev, CAST(qs // 100 AS INTEGER) AS seg, CAST(sum(cnt) AS INTEGER) AS cnt, CAST(sum(score) AS INTEGER) AS score FROM m GROUP BY ALL""")
def segment_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits by stretches of 100 characters of their text, which stand for a read's segments."""
    return hits.segment_counts(map_regions(spark, d), F.floor(F.col("qs") / 100).cast("int"))


@_register()
def sam_alignments(spark: SparkSession, d: str) -> DataFrame:
    """A record for every benchmark text: the alignment of its best hit with gaps, on its strand, or an unmapped record."""
    reads = _reads(spark, d)
    benchmark, documents = _benchmark(spark, d), _documents(spark, d)
    ranked = mapping.map_primary(benchmark, "item_id", documents, "doc_id").where("place = 1")
    quality = ranked.select("read_id", "mapq", "subsc")
    found = mapping.align_hits(ranked, benchmark, "item_id", documents, "doc_id").join(quality, "read_id")
    lens = mapping.lengths(benchmark, "item_id").withColumnRenamed("rid", "read_id")
    placed = found.join(lens, "read_id").withColumns({"a_s": F.col("q_start"), "a_e": F.col("q_start") + F.col("q_end")})
    return records.sam_records(
        reads,
        placed.select(
            "read_id",
            "rev",
            cigars.flags(F.lit(False), F.col("rev"), F.lit(False), F.lit(False)).alias("flag"),
            F.concat(F.lit("doc"), F.col("rid").cast("string")).alias("rname"),
            F.col("rs").alias("pos"),
            "mapq",
            cigars.clipped(F.col("cigar"), F.col("a_s"), F.col("len") - F.col("a_e")).alias("cigar"),
            records.tags(F.col("nm"), F.col("md"), F.col("score"), F.col("subsc")).alias("tags"),
        ),
    )
