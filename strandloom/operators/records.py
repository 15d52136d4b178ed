"""Alignment records: ungapped chains against the bases, tags, pairs of files and ordered output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import cigar as cigars
from strandloom.functions.sequence import reverse_complement
from strandloom.sources.sequences import fragment_name


def ungapped(hits: DataFrame) -> DataFrame:
    """Add nm and md of hits on one diagonal (read_id, rid, rev, qs, qe, len), from ``q_bases`` and ``t_bases``.

    ``q_bases`` are the whole read's on the hit's strand and ``t_bases`` those of the hit on the reference, as strings.
    """
    begin = F.when(F.col("rev"), F.col("len") - F.col("qe")).otherwise(F.col("qs"))
    own = F.expr("substring(q_bases, u_begin + 1, qe - qs)")
    placed = hits.withColumn("u_begin", begin).withColumn("u_q", F.filter(F.split(own, ""), lambda c: c != "")).withColumn("u_t", F.filter(F.split("t_bases", ""), lambda c: c != ""))
    differ = F.filter(F.transform("u_q", lambda c, i: F.struct(i.alias("i"), c.alias("q"), F.get(F.col("u_t"), i).alias("t"))), lambda x: x["q"] != x["t"])
    marked = placed.withColumn("u_x", differ)
    runs = F.transform("u_x", lambda x, i: F.concat((x["i"] - F.when(i == 0, -1).otherwise(F.get(F.col("u_x"), i - 1)["i"]) - 1).cast("string"), x["t"]))
    tail = F.size("u_q") - 1 - F.when(F.size("u_x") == 0, -1).otherwise(F.element_at("u_x", -1)["i"])
    return marked.withColumns({"nm": F.size("u_x"), "md": F.concat(F.array_join(runs, ""), tail.cast("string"))}).drop("u_begin", "u_q", "u_t", "u_x")


def turned_clips(cigar: Column, rev: Column, start: Column, end: Column, length: Column) -> Column:
    """Soft clips around a CIGAR of read bases start to end; on the reverse strand they change places."""
    before, after = start, length - end
    return cigars.clipped(cigar, F.when(rev, after).otherwise(before), F.when(rev, before).otherwise(after))


def tags(nm: Column, md: Column, score: Column, second: Column) -> Column:
    """NM, MD, AS and XS fields of a record."""
    return F.concat_ws("\t", F.concat(F.lit("NM:i:"), nm.cast("string")), F.concat(F.lit("MD:Z:"), md), F.concat(F.lit("AS:i:"), score.cast("string")), F.concat(F.lit("XS:i:"), second.cast("string")))


def sam_records(reads: DataFrame, hits: DataFrame) -> DataFrame:
    """(read_id, line): a tab-separated record of every read's hits, or one unmapped record.

    ``reads`` has (read_id, name, seq, qual), ``hits`` (read_id, flag, rname, pos, mapq, cigar, rev, tags), pos counted
    from 0.  On the reverse strand the read's bases are turned and its qualities reversed.
    """
    joined = reads.join(hits, "read_id", "left")
    none, rev = F.col("rname").isNull(), F.coalesce(F.col("rev"), F.lit(False))
    seq = F.when(rev, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    qual = F.when(rev, F.reverse("qual")).otherwise(F.col("qual"))
    cell = lambda c, otherwise: F.when(none, F.lit(otherwise)).otherwise(F.col(c).cast("string"))
    cells = ["name", cell("flag", "4"), cell("rname", "*"), F.when(none, "0").otherwise((F.col("pos") + 1).cast("string")), cell("mapq", "0"), cell("cigar", "*")]
    line = F.concat_ws("\t", *cells, F.lit("*"), F.lit("0"), F.lit("0"), F.when(F.length(seq) > 0, seq).otherwise("*"), F.coalesce(qual, F.lit("*")), F.when(~none, F.col("tags")))
    return joined.select("read_id", line.alias("line"))


def supplementary(hits: DataFrame) -> DataFrame:
    """(read_id, seg, place, sa): for each of an end's primary lines the others, as rname,pos,strand,cigar,mapq,NM; each.

    ``hits`` has (read_id, seg, place, rname, pos, rev, cigar, mapq, nm), pos counted from 0; an end has few of them.
    """
    item = F.concat_ws(",", "rname", (F.col("pos") + 1).cast("string"), F.when(F.col("rev"), "-").otherwise("+"), "cigar", F.col("mapq").cast("string"), F.col("nm").cast("string"))
    own = hits.select("read_id", "seg", "place", F.concat(item, F.lit(";")).alias("item"))
    gathered = own.groupBy("read_id", "seg").agg(F.array_sort(F.collect_list(F.struct("place", "item"))).alias("all"))
    others = F.filter("all", lambda x: x["place"] != F.col("place"))
    met = own.drop("item").join(gathered, ["read_id", "seg"])
    return met.select("read_id", "seg", "place", F.array_join(F.transform(others, lambda x: x["item"]), "").alias("sa"))


def pair_records(reads: DataFrame, hits: DataFrame) -> DataFrame:
    """(read_id, seg, place, line): tab-separated records of both ends of every fragment, with the fields of their mates.

    ``reads`` has (read_id, seg, name, seq, qual), seg 0 and 1; ``hits`` (read_id, seg, place, rname, pos, rev, cigar,
    mapq, tags, proper, sa), place 1 an end's first line and the mates' place, the others supplementary.  An end without a
    hit stands where its mate's first line is, on its strand; without that too, it is nowhere.
    """
    placed = reads.join(hits, ["read_id", "seg"], "left").withColumn("place", F.coalesce("place", F.lit(1)))
    rlen = F.when(F.col("cigar").isNotNull(), cigars.reference_length(F.col("cigar")))
    held = placed.withColumns({"mapped": F.col("rname").isNotNull(), "rlen": rlen})
    m = held.where("place = 1").select("read_id", (1 - F.col("seg")).alias("seg"), *[F.col(c).alias(f"m_{c}") for c in ("rname", "pos", "rev", "mapped", "rlen")])
    met = held.join(m, ["read_id", "seg"], "left").withColumn("m_mapped", F.coalesce("m_mapped", F.lit(False)))
    met = met.withColumns({c: F.when(F.col("mapped"), F.col(c)).otherwise(F.col(f"m_{c}")) for c in ("rname", "pos", "rev")})
    met = met.withColumns({f"m_{c}": F.when(F.col("m_mapped"), F.col(f"m_{c}")).otherwise(F.col(c)) for c in ("rname", "pos", "rev")})
    rev, m_rev = F.coalesce("rev", F.lit(False)), F.coalesce("m_rev", F.lit(False))
    bit = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0))
    flag = bit(F.lit(True), 0x1) + bit(F.coalesce("proper", F.lit(False)), 0x2) + bit(~F.col("mapped"), 0x4) + bit(~F.col("m_mapped"), 0x8)
    flag = flag + bit(rev, 0x10) + bit(m_rev, 0x20) + F.when(F.col("seg") == 0, 0x40).otherwise(0x80) + bit(F.col("place") > 1, 0x800)
    here = F.col("pos") + F.when(rev, F.col("rlen") - 1).otherwise(0)
    there = F.col("m_pos") + F.when(m_rev, F.col("m_rlen") - 1).otherwise(0)
    both = F.col("mapped") & F.col("m_mapped") & (F.col("rname") == F.col("m_rname"))
    size = F.when(both, there - here + F.signum(there - here).cast("int")).otherwise(0)
    text = lambda c, otherwise: F.coalesce(c.cast("string"), F.lit(otherwise))
    cells = [
        F.col("name"), flag.cast("string"), text(F.col("rname"), "*"), text(F.col("pos") + 1, "0"), text(F.when(F.col("mapped"), F.col("mapq")), "0"),
        text(F.when(F.col("mapped"), F.col("cigar")), "*"), F.when(F.col("m_rname").isNull(), "*").when(F.col("rname") == F.col("m_rname"), "=").otherwise(F.col("m_rname")),
        text(F.col("m_pos") + 1, "0"), size.cast("string"),
        F.when(F.length("seq") > 0, F.when(rev, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))).otherwise("*"),
        F.coalesce(F.when(rev, F.reverse("qual")).otherwise(F.col("qual")), F.lit("*")),
        F.when(F.col("mapped"), F.col("tags")), F.when(F.col("mapped") & (F.col("sa") != ""), F.concat(F.lit("SA:Z:"), "sa")),
    ]
    return met.select("read_id", "seg", "place", F.concat_ws("\t", *cells).alias("line"))


def cigar_lines(hits: DataFrame) -> DataFrame:
    """(read_id, line): the read's id and a CIGAR, as [read id:N] and a tab."""
    return hits.select("read_id", F.concat(F.lit("[read id:"), F.col("read_id").cast("string"), F.lit("]\t"), F.col("cigar")).alias("line"))


def write_ordered(lines: DataFrame, path: str, *by: str) -> None:
    """Write the ``line`` column as text whose files, in order of their names, hold the lines in order of ``by``."""
    lines.repartitionByRange(*by).sortWithinPartitions(*by).select("line").write.mode("overwrite").text(path)


def pair_reads(left: DataFrame, right: DataFrame) -> DataFrame:
    """(fragment, seq, qual, mate_seq, mate_qual): the reads of two files, by fragment name and its n-th occurrence.

    A read without its mate has null mate columns, or is left out if it is of the second file.
    """

    def numbered(reads: DataFrame) -> DataFrame:
        order = Window.partitionBy("fragment").orderBy("seq", "qual")
        return reads.select(fragment_name(F.col("name")).alias("fragment"), "seq", "qual").withColumn("nth", F.row_number().over(order))

    mates = numbered(right).select("fragment", "nth", F.col("seq").alias("mate_seq"), F.col("qual").alias("mate_qual"))
    return numbered(left).join(mates, ["fragment", "nth"], "left").drop("nth")
