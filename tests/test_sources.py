import gzip

import pytest

from strandloom.jobs import options
from strandloom.operators import intervals
from strandloom.sources import sequences
from strandloom.streaming.mapping import map_stream, throughput


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">r1 first read\nACGU\nAC\n>r2\n\n>r3\nTTT\n")
    rows = sequences.read_fasta(spark, str(tmp_path / "a.fa")).collect()
    assert [(r.name, r.comment, r.seq, r.len) for r in rows] == [("r1", "first read", "ACGTAC", 6), ("r2", None, "", 0), ("r3", None, "TTT", 3)]
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write("@q1/1 c\nACGT\n+\n@III\n@q2\nACG\n+\nII\n")
    rows = sequences.read_fastq(spark, str(tmp_path / "b.fq.gz")).select("*", sequences.fragment_name("name").alias("f")).collect()
    assert [(r.name, r.seq, r.qual, r.f) for r in rows] == [("q1/1", "ACGT", "@III", "q1"), ("q2", None, None, "q2")]


def test_fastq_splits_anywhere(spark, tmp_path):
    rows = [(f"r{i}", "ACGT" * (i % 5 + 1), ("@" if i % 2 else "I") * 4 * (i % 5 + 1)) for i in range(200)]
    (tmp_path / "c.fq").write_text("".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in rows))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = sequences.read_fastq(spark, str(tmp_path / "c.fq")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r.name, r.seq, r.qual) for r in found) == sorted(rows)


def test_bed_introns(spark, tmp_path):
    (tmp_path / "a.bed").write_text("track x\nchr1\t10\t100\tt1\t0\t+\t10\t100\t0\t3\t10,20,5,\t0,30,85,\nchr1\t5\t9\n")
    found = intervals.introns(intervals.bed_blocks(sequences.read_bed(spark, str(tmp_path / "a.bed"))))
    assert sorted((r.st, r.en) for r in found.collect()) == [(20, 40), (60, 95)]


def test_presets_and_checks():
    assert options.preset("map-pb").k == 19 and options.preset("ava-ont").no_dual
    assert options.from_settings('{"k": 17}', {"w": 5}).k == 17
    for bad in ({"k": 40}, {"w": 0}, {"gap_extend": 0}, {"band": 30000}):
        with pytest.raises(ValueError):
            options.from_settings(bad)
    with pytest.raises(ValueError):
        options.preset("no-such")


def test_stream_equals_batch(spark, tmp_path):
    from strandloom.jobs.mapping import map_best

    base = "/root/testdata/sf0.001"
    reads = spark.read.parquet(f"{base}/benchmark.parquet").withColumnRenamed("item_id", "read_id")
    documents = spark.read.parquet(f"{base}/documents.parquet")
    reads.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    map_stream(stream, documents, "doc_id", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    columns = ["read_id", "rid", "qs", "rs", "score", "place"]
    found = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(columns).collect()))
    assert found == sorted(map(tuple, map_best(reads, "read_id", documents, "doc_id").select(columns).collect()))
    assert throughput(spark, str(tmp_path / "out")).count() >= 1
