"""Scores, qualities and record forms of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def divergence(hits: DataFrame, minimizers: DataFrame, k: int) -> DataFrame:
    """Add n_tot and div: the share of the read's minimizers within the hit that no anchor matches, taken to
    the base.  ``minimizers`` are the reads'; a hit is (read_id, qs, qe, cnt)."""
    inside = minimizers.select(F.col("rid").alias("read_id"), (F.col("pos") + 1 - F.col("span")).alias("m_s"), (F.col("pos") + 1).alias("m_e"))
    key = ["read_id", "rid", "rev", "qs", "qe", "rs"]
    met = hits.join(inside, "read_id").where("m_s >= qs AND m_e <= qe").groupBy(*key).agg(F.count("*").alias("n_tot"))
    share = F.when(F.col("cnt") >= F.col("n_tot"), 0.0).otherwise(1 - F.pow(F.col("cnt") / F.col("n_tot"), F.lit(1.0 / k)))
    return hits.join(met, key).withColumn("div", share)


def strand_retained(hits: DataFrame, parents: DataFrame, factor: float = 5.0, floor: float = 0.01) -> DataFrame:
    """Hits kept for their strand that diverge little: less than ``factor`` times their parent, or ``floor``."""
    p = parents.select("read_id", F.col("place").alias("parent"), F.col("div").alias("p_div"))
    return hits.join(p, ["read_id", "parent"]).where((F.col("div") < F.col("p_div") * factor) | (F.col("div") < floor)).drop("p_div")


def mapq_short(hits: DataFrame, match: int = 1, mismatch: int = 4, min_seed: int = 19, length_from: int = 50) -> DataFrame:
    """Add mapq of short-read regions (score, sub, sub_n, qs, qe, rs, re, frac_rep).

    How far the score is above its rival, in matches, weighed down by edits and, from ``length_from`` bases
    on, by length; a rival of no less score gives 0.
    """
    rival = F.when(F.col("sub") > 0, F.col("sub")).otherwise(min_seed * match)
    length = F.greatest(F.col("qe") - F.col("qs"), F.col("re") - F.col("rs")).cast("double")
    identity = 1 - (length * match - F.col("score")) / (match + mismatch) / length
    by_length = F.when(length < length_from, 1.0).otherwise(F.log(F.lit(float(length_from))) / F.log(length))
    weight = by_length * identity * identity
    raw = (6.02 * (F.col("score") - rival) / match * weight * weight + 0.499).cast("int")
    less = raw - F.when(F.col("sub_n") > 0, (4.343 * F.log(F.col("sub_n") + F.lit(1.0)) + 0.499).cast("int")).otherwise(0)
    held = F.greatest(F.lit(0), F.least(F.lit(60), less))
    return hits.withColumn("mapq", F.when(rival >= F.col("score"), 0).otherwise((held * (1 - F.col("frac_rep")) + 0.499).cast("int")))


def rivals(hits: DataFrame) -> DataFrame:
    """Add sub and sub_n: the best score among a read's other hits that overlap one by half on the read, and how
    many score as near as a mismatch or gap would bring them (here: within 11)."""
    o = hits.select("read_id", *[F.col(c).alias(f"o_{c}") for c in ("rid", "rev", "qs", "qe", "rs", "score")])
    shared = F.least("qe", "o_qe") - F.greatest("qs", "o_qs")
    shorter = F.least(F.col("qe") - F.col("qs"), F.col("o_qe") - F.col("o_qs"))
    itself = F.struct("rid", "rev", "qs", "qe", "rs") == F.struct(*[F.col(f"o_{c}") for c in ("rid", "rev", "qs", "qe", "rs")])
    key = ["read_id", "rid", "rev", "qs", "qe", "rs"]
    met = hits.join(o, "read_id").where(~itself & (shared * 2 >= shorter) & (F.col("o_score") <= F.col("score")))
    found = met.groupBy(*key).agg(F.max("o_score").alias("sub"), F.sum((F.col("score") - F.col("o_score") <= 11).cast("int")).cast("int").alias("sub_n"))
    return hits.join(found, key, "left").fillna(0, ["sub", "sub_n"])


def inversion_quality(hits: DataFrame) -> DataFrame:
    """mapq of inversions (``inv``) set to the lesser of the hits before and after them on the reference."""
    order = Window.partitionBy("read_id").orderBy("rid", "rs", "re")
    before, after = F.lag("mapq").over(order), F.lead("mapq").over(order)
    return hits.withColumn("mapq", F.when(F.col("inv") & before.isNotNull() & after.isNotNull(), F.least(before, after)).otherwise(F.col("mapq")))


def alt_score(score: Column, discount: float = 0.15) -> Column:
    """A hit's score after the discount for alternative sequences; one above 0 stays above."""
    less = (score * (1 - discount) + 0.499).cast("int")
    return F.when(score < 0, score).otherwise(F.greatest(less, F.lit(1)))


def seed_coverage(hits: DataFrame, matches: DataFrame, lengths: DataFrame) -> DataFrame:
    """Add seedcov: bases of the exact matches (qbeg, qend, rbeg) that lie within each hit on both axes.

    Matches of the reverse strand are counted from the read's end, hits from its beginning; ``lengths`` (rid, len) turns
    the ones to the others.
    """
    placed = matches.join(lengths.select(F.col("rid").alias("read_id"), "len"), "read_id")
    n = F.col("qend") - F.col("qbeg")
    m = placed.select("read_id", "rid", "rev", F.when(F.col("rev"), F.col("len") - F.col("qend")).otherwise(F.col("qbeg")).alias("m_q"), F.col("rbeg").alias("m_r"), n.alias("m_n"))
    on_read = (F.col("m_q") >= F.col("qs")) & (F.col("m_q") + F.col("m_n") <= F.col("qe"))
    on_reference = (F.col("m_r") >= F.col("rs")) & (F.col("m_r") + F.col("m_n") <= F.col("re"))
    key = ["read_id", "rid", "rev", "qs", "qe", "rs", "re"]
    found = hits.join(m, ["read_id", "rid", "rev"]).where(on_read & on_reference).groupBy(*key).agg(F.sum("m_n").cast("long").alias("seedcov"))
    return hits.join(found, key, "left").fillna(0, ["seedcov"])


def paf_lines(hits: DataFrame, q_len: DataFrame, r_len: DataFrame) -> DataFrame:
    """(read_id, line): tab-separated records of twelve columns; ids stand for names."""
    named = hits.join(q_len.select(F.col("rid").alias("read_id"), F.col("len").alias("q_len")), "read_id").join(
        r_len.select("rid", F.col("len").alias("r_len")), "rid"
    )
    cells = ["read_id", "q_len", "qs", "qe", F.when(F.col("rev"), "-").otherwise("+"), "rid", "r_len", "rs", "re", "mlen", "blen", F.lit(255)]
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cells]
    return named.select("read_id", F.concat_ws("\t", *texts).alias("line"))


def paf_alignments(aligned: DataFrame, q_len: DataFrame, r_len: DataFrame) -> DataFrame:
    """(read_id, line): records of ``align_reads``' regions, twelve columns and the tags NM, AS, ms, nn, tp, cm, cg and cs.

    tp is P for primaries, S for secondaries and I for inversions; a secondary's quality is 0.  Ids stand for names.
    """
    named = aligned.join(q_len.select(F.col("rid").alias("read_id"), F.col("len").alias("q_len")), "read_id").join(
        r_len.select("rid", F.col("len").alias("r_len")), "rid"
    )
    kind = F.when(F.col("inv"), "I").when(F.col("place") == F.col("parent"), "P").otherwise("S")
    cells = ["read_id", "q_len", "qs", "qe", F.when(F.col("rev"), "-").otherwise("+"), "rid", "r_len", "rs", "re", "matches", "columns", "mapq"]
    tags = {"NM:i": "nm", "AS:i": "score", "ms:i": F.floor("dp_max"), "nn:i": "n_ambi", "tp:A": kind, "cm:i": "anchors", "cg:Z": "cigar", "cs:Z": "cs"}
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cells]
    tagged = [F.concat(F.lit(f"{t}:"), (F.col(c) if isinstance(c, str) else c).cast("string")) for t, c in tags.items()]
    return named.select("read_id", F.concat_ws("\t", *texts, *tagged).alias("line"))


def other_places(hits: DataFrame) -> DataFrame:
    """(read_id, xa): a read's hits after the first, as rid,strand and 1-based place,matched bases; by place."""
    item = F.concat(F.col("rid").cast("string"), F.lit(","), F.when(F.col("rev"), "-").otherwise("+"), (F.col("rs") + 1).cast("string"), F.lit(","), (F.col("qe") - F.col("qs")).cast("string"), F.lit("M;"))
    others = hits.where("place > 1").select("read_id", F.struct("place", item.alias("x")).alias("s"))
    gathered = others.groupBy("read_id").agg(F.array_sort(F.collect_list("s")).alias("s"))  # bounded by best_n
    return gathered.select("read_id", F.array_join(F.transform("s", lambda x: x["x"]), "").alias("xa"))
