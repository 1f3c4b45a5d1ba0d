import gzip
import os

import pytest
from pyspark.sql import functions as F

from cladeflow.functions import names
from cladeflow.operators import aggregate
from cladeflow.sources import fasta, files, logs, tables
from cladeflow.streaming import incremental


def write(path, text, opener=open):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with opener(path, "wt") as f:
        f.write(text)
    return str(path)


RECORDS = ">s1 first > record [locus_tag=AB_1]\nACGT\nacgtN\n>s2\nAC\r\nGX\r\n>s3 no residues\n>s4\ttabbed text\nTT"


def test_fasta_records(spark, tmp_path):
    plain = write(f"{tmp_path}/a.fna", RECORDS)
    packed = write(f"{tmp_path}/b.fna.gz", RECORDS, gzip.open)
    for path in (plain, packed):
        rows = {r["seq_id"]: r for r in fasta.read_fasta(spark, path).collect()}
        assert {k: r["sequence"] for k, r in rows.items()} == {"s1": "ACGTacgtN", "s2": "ACGX", "s3": "", "s4": "TT"}
        assert rows["s1"]["description"] == "first > record [locus_tag=AB_1]" and rows["s2"]["description"] == ""
        assert rows["s4"]["description"] == "tabbed text"
        assert rows["s1"]["length"] == 9 and rows["s1"]["path"].endswith(os.path.basename(path))
    tag = names.locus_tag(F.col("description"), F.col("seq_id"))
    tags = {r["t"] for r in fasta.read_fasta(spark, plain).select(tag.alias("t")).collect()}
    assert tags == {"AB_1", "s2", "s3", "s4"}


def test_fasta_splits_of_a_plain_file_keep_records_whole(spark, tmp_path):
    text = "".join(f">r{i} d\n{'ACGT' * (i % 50)}\n" for i in range(2000))
    path = write(f"{tmp_path}/big.fna", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = fasta.read_fasta(spark, path)
        assert df.rdd.getNumPartitions() > 4
        got = {r["seq_id"]: r["length"] for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"r{i}": 4 * (i % 50) for i in range(2000)}


def test_located_files(spark, tmp_path):
    for name in (
        "GCF_1.1_A_genomic.fna.gz", "GCF_1.1_A_cds_from_genomic.fna.gz", "GCF_1.1_A_rna_from_genomic.fna.gz",
        "GCF_2.1_A_genomic.fna.gz", "GCF_2.1_B_genomic.fna.gz", "GCF_2.1_A_protein.faa.gz", "GCF_2.1_B_protein.faa.gz",
    ):
        write(f"{tmp_path}/all/{name[:5]}/{name}", "x")
    os.utime(f"{tmp_path}/all/GCF_2/GCF_2.1_A_genomic.fna.gz", (1, 1))
    listing = files.list_files(spark, str(tmp_path))
    asked = spark.createDataFrame([("RS_GCF_1.1",), ("GCF_2.1",), ("GCF_3.1",)], "accession string")
    rows = {r["accession"]: (os.path.basename(r["path"] or ""), r["status"]) for r in files.locate_files(listing, asked).collect()}
    assert rows == {
        "GCF_1.1": ("GCF_1.1_A_genomic.fna.gz", "found"),
        "GCF_2.1": ("GCF_2.1_B_genomic.fna.gz", "newest of several"),
        "GCF_3.1": ("", "no file"),
    }
    proteins = {r["accession"]: r["status"] for r in files.locate_files(listing, asked, "protein").collect()}
    assert proteins == {"GCF_1.1": "no file", "GCF_2.1": "several files", "GCF_3.1": "no file"}
    with pytest.raises(Exception, match="no file"):
        files.require_files(files.locate_files(listing, asked)).collect()


def test_accession_list(spark, tmp_path):
    path = write(f"{tmp_path}/accs.txt", "RS_GCF_1.1\n\nGCA_2.1 \n")
    assert [r["accession"] for r in files.read_accessions(spark, path).collect()] == ["GCF_1.1", "GCA_2.1"]


def test_profiler_tables_per_rank(spark, tmp_path):
    def report(rank, extra):
        rows = [f"[Strategy]a{i}  |  1.0  |  {rank * 100 + i}  |  5 %" for i in range(32)]
        return "\n".join(["noise | x", "Action  |  Mean  |  Total time (s)  |  Percentage %", "-" * 20, f"Total  |  -  |  {rank + 9}  |  100 %", "-" * 9, *rows, *extra])

    text = report(0, ["late  |  1  |  1  |  1 %"]) + "\nnot a table\nstray  |  1  |  1  |  1 %\n" + report(1, [])
    path = write(f"{tmp_path}/job_n4_g8_b32_x.log", text)
    rows = logs.parse_profile_logs(spark, path).collect()
    assert len(rows) == 2 * 33 + 1
    by = {(r["rank"], r["action"]): r for r in rows}
    assert by[1, "[Strategy]a31"]["total"] == 131 and by[1, "total"]["total"] == 10 and by[0, "late"]["total"] == 1
    assert (rows[0]["n_nodes"], rows[0]["n_gpu"], rows[0]["batch_size"]) == (4, 8, 32)
    wide = logs.pivot_actions(logs.parse_profile_logs(spark, path), ["total"]).collect()
    assert {(r["rank"], r["total"]) for r in wide} == {(0, 9.0), (1, 10.0)}


def test_linked_tables_prune_by_genome(spark, tmp_path):
    seqs = spark.createDataFrame([(i, f"g{i % 3}", "ACGT" * i) for i in range(30)], "seq_id long, genome_id string, sequence string")
    taxa = spark.createDataFrame([("g0", "x")], "taxon_id string, species string")
    tables.write_dataset(f"{tmp_path}/d", seqs, taxa, seqs.select("genome_id").distinct(), 4, distances=seqs.select("seq_id"))
    back = tables.read_dataset(spark, f"{tmp_path}/d", "sequences")
    assert sorted(back.columns) == sorted(seqs.columns) and back.exceptAll(seqs.select(back.columns)).isEmpty() and back.count() == 30
    assert tables.read_dataset(spark, f"{tmp_path}/d", "distances").count() == 30
    plan = back.where("genome_id = 'g1'").select("seq_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(genome_id,g1)" in plan and "sequence:" not in plan.split("ReadSchema")[1]


def test_late_rows_are_dropped_and_windows_come_once(spark, tmp_path):
    def save(i, rows):
        df = spark.createDataFrame(rows, "t long, v double").select(F.timestamp_seconds("t").alias("ts"), "v")
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")

    day = 86400
    save(0, [(10, 1.0), (20, 3.0)])
    save(1, [(2 * day + 5, 5.0)])
    save(2, [(2 * day + 6, 6.0)])
    save(3, [(30, 99.0), (3 * day, 7.0)])  # the first row is two days late
    for i in range(4):
        os.utime(next(f"{tmp_path}/in/{i}/{n}" for n in os.listdir(f"{tmp_path}/in/{i}") if n.endswith("parquet")), (1000 + i, 1000 + i))
    stream = spark.readStream.schema("ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    windows = incremental.stream_metrics(stream, "ts", "v")
    incremental.write_append(windows, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    rows = [(r["n"], r["mean"], r["last"]) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("start").collect()]
    assert rows == [(2, 2.0, 3.0)]


def test_streamed_means_equal_the_batch(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    df.repartition(5).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = incremental.write_updates(incremental.stream_mean(stream, ["k"], "v"), f"{tmp_path}/out", f"{tmp_path}/ck")
    query.awaitTermination()
    got = {r["k"]: (r["total"], r["n"]) for r in incremental.latest_updates(spark, f"{tmp_path}/out", ["k"]).collect()}
    want = {r["k"]: (r["t"], r["n"]) for r in df.groupBy("k").agg(F.sum("v").alias("t"), F.count("v").alias("n")).collect()}
    assert got == want


def test_missing_metric_columns_are_null(spark, tmp_path):
    a = write(f"{tmp_path}/a.csv", "epoch,step,training_loss\n0,1,0.5\n")
    b = write(f"{tmp_path}/b.csv", "epoch,validation_loss,lr\n0,0.7,0.01\n")
    rows = tables.read_metrics(spark, [a, b]).orderBy(F.col("step").desc()).collect()
    assert rows[0]["lr"] is None and rows[1]["validation_loss"] == 0.7 and rows[1]["training_loss"] is None


def test_vectors_keep_their_order(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 2.0])], "n string, v array<double>")
    tables.write_vectors(df, f"{tmp_path}/v", "n", "v")
    assert tables.read_vectors(spark, f"{tmp_path}/v").first()["vec"] == [1.0, 2.0]
    freq = aggregate.tetramer_freq(spark.createDataFrame([("a", "ACGTACGT")], "name string, s string"), ["name"], "s")
    tables.write_tnf(freq, f"{tmp_path}/t")
    assert tables.read_tnf(spark, f"{tmp_path}/t", tables.read_vectors(spark, f"{tmp_path}/v")).count() == freq.count()


def test_a_bucket_is_written_by_as_many_tasks_as_its_rows_need(spark, tmp_path):
    seqs = spark.range(0, 4000, 1, 12).selectExpr("id AS seq_id", "'g' AS genome_id", "'l' AS label", "'ACGT' AS seq")
    tables.write_dataset(str(tmp_path), seqs, seqs.select("label").distinct(), seqs.select("genome_id").distinct(), n_buckets=3)
    for bucket in (tmp_path / "sequences").glob("bucket=*"):
        assert len(list(bucket.glob("*.parquet"))) == 4
    assert tables.read_dataset(spark, str(tmp_path), "sequences").agg({"seq_id": "sum"}).first()[0] == 4000 * 3999 // 2
