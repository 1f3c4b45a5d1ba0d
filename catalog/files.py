"""Round trips through files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.aggregating import MEANS_CTE, TOP_SQL, probability_columns, rolled
from catalog.common import DIST_CTE, LINEAGE_CTE, META_CTE, SEQS_CTE, Catalog, distances, lineage, metadata, sequences, table
from catalog.windowing import KMERS_CTE, LENS_CTE, settled_lengths
from cladeflow import scratch
from cladeflow.functions import names
from cladeflow.operators import aggregate, ordering, taxonomy
from cladeflow.sources import fasta, files, logs, tables

catalog = Catalog()


def header():
    composed = names.compose_header(F.col("genome_id"), F.length("seq"), F.col("seq_id"))
    return F.concat(composed, F.lit(" [locus_tag=L"), F.col("seq_id").cast("string"), F.lit("] > x"))


@catalog.add("s01_read_fasta", f"""
WITH {SEQS_CTE} SELECT genome_id || '-' || length(seq) || '-' || seq_id AS seq_id,
  '[locus_tag=L' || seq_id || '] > x' AS description, md5(seq) AS digest, CAST(length(seq) AS INTEGER) AS length FROM seqs""")
def read_fasta(spark, sf):
    path = scratch(spark, "fasta")
    fasta.write_fasta(sequences(spark, sf), path, header(), "seq", compression="gzip")
    return fasta.read_fasta(spark, path).select("seq_id", "description", F.md5("sequence").alias("digest"), "length")


@catalog.add("s14_write_fasta", f"""
WITH {SEQS_CTE}, every AS (SELECT seq FROM seqs UNION ALL SELECT '' FROM seqs WHERE seq_id % 10 = 0)
SELECT CAST(sum(1 + ceil(length(seq) / 100)) AS BIGINT) AS n_lines, CAST(sum(length(seq)) AS BIGINT) AS n_residues,
  CAST(count(*) AS BIGINT) AS n_headers, 100 AS longest FROM every""")
def write_fasta(spark, sf):
    path = scratch(spark, "fasta")
    blank = sequences(spark, sf).where("seq_id % 10 = 0").withColumn("seq", F.lit(""))
    fasta.write_fasta(sequences(spark, sf).unionByName(blank), path, header(), "seq")
    is_header = F.col("value").startswith(">")
    residues = F.when(is_header, 0).otherwise(F.length("value"))
    return spark.read.text(path).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(residues).cast("bigint").alias("n_residues"),
        F.sum(is_header.cast("int")).alias("n_headers"),
        F.max(residues).alias("longest"),
    )


@catalog.add("s02_read_metadata", f"""
WITH {LINEAGE_CTE}, p AS (SELECT s_suppkey, string_split(lineage, ';') AS l FROM lineage)
SELECT 'GCF_' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || '.1' AS accession, CAST(s_suppkey % 9 AS INTEGER) AS contig_count,
  l[1] AS domain, l[2] AS phylum, l[3] AS class, l[4] AS "order", l[5] AS family, l[6] AS genus,
  string_split(l[7], ' ')[2] AS species FROM p""")
def read_metadata(spark, sf):
    path = scratch(spark, "metadata")
    rows = lineage(spark, sf).select(
        F.concat(F.lit("RS_GCF_"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"), F.lit(".1")).alias("accession"),
        F.col("s_name").alias("unused"),
        F.col("lineage").alias("gtdb_taxonomy"),
        (F.col("s_suppkey") % 9).cast("int").alias("contig_count"),
    )
    tables.write_csv(rows, path, sep="\t")
    return tables.read_metadata(spark, path, ["accession", "contig_count", "gtdb_taxonomy"], epithet=True)


@catalog.add("s03_read_accessions", f"""
WITH {META_CTE} SELECT 'list' AS source, regexp_replace(accession, '^(RS|GB)_', '') AS accession FROM meta
UNION ALL SELECT DISTINCT 'column', p_brand FROM meta""")
def read_accessions(spark, sf):
    path = scratch(spark, "accessions")
    meta = metadata(spark, sf)
    meta.select("accession").write.text(path)
    listed = files.read_accessions(spark, path).select(F.lit("list").alias("source"), "accession")
    return listed.unionByName(files.accessions_of(meta, "p_brand").select(F.lit("column").alias("source"), "accession"))


@catalog.add("s04_locate_files", """
WITH f AS (SELECT 'GCF_' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS accession, o_orderdate, o_orderkey,
  '/data/all/x/GCF_' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || '_v' || o_orderkey ||
    CASE WHEN o_orderkey % 3 = 0 THEN '_cds_from_genomic.fna.gz' ELSE '_genomic.fna.gz' END AS path FROM orders),
a AS (SELECT 'GCF_' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS accession FROM customer),
g AS (SELECT accession, arg_max(path, (o_orderdate, path)) AS path, count(*) AS n FROM f
  WHERE path LIKE '%\\_genomic.fna.gz' ESCAPE '\\' AND NOT contains(path, 'cds_from') GROUP BY accession),
c AS (SELECT accession, min(path) AS path, count(*) AS n FROM f WHERE contains(path, '_cds_from_genomic') GROUP BY accession)
SELECT 'genomic' AS kind, accession, path, coalesce(n, 0) AS n_files, CASE WHEN n IS NULL THEN 'no file' WHEN n > 1 THEN
  'newest of several' ELSE 'found' END AS status FROM a LEFT JOIN g USING (accession)
UNION ALL SELECT 'cds', accession, CASE WHEN n = 1 THEN path END, coalesce(n, 0), CASE WHEN n IS NULL THEN 'no file' WHEN n > 1
  THEN 'several files' ELSE 'found' END FROM a LEFT JOIN c USING (accession)""")
def locate_files(spark, sf):
    def accession(col):
        return F.concat(F.lit("GCF_"), F.lpad(F.col(col).cast("string"), 9, "0"))

    ending = F.when(F.col("o_orderkey") % 3 == 0, "_cds_from_genomic.fna.gz").otherwise("_genomic.fna.gz")
    listing = table(spark, sf, "orders").select(
        F.concat(F.lit("/data/all/x/"), accession("o_custkey"), F.lit("_v"), F.col("o_orderkey").cast("string"), ending).alias("path"),
        F.col("o_orderdate").alias("modified"),
    )
    asked = table(spark, sf, "customer").select(accession("c_custkey").alias("accession"))
    found = [
        files.locate_files(listing, asked, kind).withColumn("kind", F.lit(kind))
        for kind in ("genomic", "cds")
    ]
    both = found[0].unionByName(found[1])
    return both.select("kind", "accession", "path", "n_files", "status")


@catalog.add("s05_read_hits", """
SELECT 'GCA_' || l_orderkey AS accession, 'c' || l_partkey AS seq_name, CAST(l_linenumber AS VARCHAR) AS orf_id,
  'GCF_' || l_suppkey AS hit, l_extendedprice AS bitscore FROM lineitem""")
def read_hits(spark, sf):
    path = scratch(spark, "hits")
    query = F.concat(F.lit("GCA_"), F.col("l_orderkey").cast("string"), F.lit("-9-c"), F.col("l_partkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"))
    subject = F.concat(F.lit("GCF_"), F.col("l_suppkey").cast("string"), F.lit("-x"))
    middle = [F.lit(i).alias(f"m{i}") for i in range(9)]
    table(spark, sf, "lineitem").select(query, subject, *middle, "l_extendedprice").write.csv(path, sep="\t")
    return tables.split_hits(tables.read_hits(spark, path))


@catalog.add("s06_read_classifications", """
SELECT 'kmer' AS fmt, CAST(s_suppkey AS VARCHAR) AS id, r_name AS domain, CASE WHEN s_suppkey % 3 > 0 THEN n_name END AS phylum,
  NULL AS score FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'model', CAST(s_suppkey AS VARCHAR), r_name, n_name, s_acctbal
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def read_classifications(spark, sf):
    places = lineage(spark, sf).join(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey")
    key, blank = F.col("s_suppkey").cast("string").alias("ID"), [F.lit("").alias(r) for r in names.RANKS[2:]]
    phylum = F.when(F.col("s_suppkey") % 3 > 0, F.col("n_name")).otherwise("")
    paths = {fmt: scratch(spark, fmt) for fmt in ("kmer", "model")}
    kmer = places.select(key, F.lit("found").alias("status"), F.col("r_name").alias("superkingdom"), phylum.alias("phylum"), *blank, F.lit("").alias("strain"))
    model = places.select(F.lit("f").alias("filename"), key, F.col("r_name").alias("domain"), F.col("n_name").alias("phylum"), *blank, F.col("s_acctbal").alias("score"))
    tables.write_csv(kmer, paths["kmer"])
    tables.write_csv(model, paths["model"])
    a = tables.read_classifications(spark, paths["kmer"], "kmer").withColumn("score", F.lit(None).cast("double"))
    b = tables.read_classifications(spark, paths["model"], "model")
    return a.select(F.lit("kmer").alias("fmt"), F.col("ID").alias("id"), "domain", "phylum", "score").unionByName(
        b.select(F.lit("model").alias("fmt"), F.col("ID").alias("id"), "domain", "phylum", "score")
    )


@catalog.add("s07_read_metrics", """
SELECT event_id AS step, CAST(user_id AS INTEGER) AS epoch, value AS training_loss, NULL AS validation_loss, NULL AS lr FROM events
  WHERE event_type <> 'signup'
UNION ALL SELECT event_id, CAST(user_id AS INTEGER), NULL, value, value / 2 FROM events WHERE event_type = 'signup'""")
def read_metrics(spark, sf):
    events = table(spark, sf, "events").withColumn("epoch", F.col("user_id").cast("int")).withColumnRenamed("event_id", "step")
    paths = [scratch(spark, "metrics") for _ in range(2)]
    tables.write_csv(events.where("event_type <> 'signup'").select("epoch", "step", F.col("value").alias("training_loss")), paths[0])
    signups = events.where("event_type = 'signup'")
    tables.write_csv(signups.select("step", "epoch", F.col("value").alias("validation_loss"), (F.col("value") / 2).alias("lr")), paths[1])
    return tables.read_metrics(spark, paths).select("step", "epoch", "training_loss", "validation_loss", "lr")


N_ACTIONS = 34


@catalog.add("s08_profile_logs", f"""
WITH t AS (SELECT user_id % 3 AS run, event_id % 2 AS rank, event_id % {N_ACTIONS} // 2 AS a, sum(CAST(round(value * 100) AS BIGINT)) AS total FROM events GROUP BY ALL),
x AS (SELECT run, rank, a, total, sum(total) OVER (PARTITION BY run, rank) AS everything FROM t)
SELECT CAST(1 + run AS INTEGER) AS n_nodes, CAST(4 * (1 + run) AS INTEGER) AS n_gpu, CAST(16 AS INTEGER) AS batch_size, CAST(rank AS BIGINT) AS rank,
  CAST(max(total) FILTER (a = 1) AS DOUBLE) AS action_1, CAST(max(total) FILTER (a = 15) AS DOUBLE) AS action_15,
  CAST(0 AS DOUBLE) AS filler_39, CAST(max(everything) AS DOUBLE) AS total FROM x GROUP BY run, rank""")
def profile_logs(spark, sf):
    path = scratch(spark, "logs")
    events = table(spark, sf, "events")
    cents = F.round(F.col("value") * 100).cast("bigint")
    run, rank, action = F.col("user_id") % 3, F.col("event_id") % 2, F.expr(f"(event_id % {N_ACTIONS}) div 2")
    sums = events.groupBy(run.alias("run"), rank.alias("rank"), action.alias("a")).agg(F.sum(cents).alias("total"))
    whole = sums.groupBy("run", "rank").agg(F.sum("total").alias("total"))

    def cells(*parts):
        return F.concat_ws("  |  ", *parts)

    row = cells(F.concat(F.lit("action_"), F.col("a").cast("string")), F.lit("1.5"), F.col("total").cast("string"), F.lit("3 %"))
    heads = whole.select("run", "rank", F.lit(-2).alias("at"), F.lit("Action  |  Mean duration (s)  |  _Total time (s)  |  Percentage").alias("value"))
    rules = whole.select("run", "rank", F.lit(-1).alias("at"), F.lit("-" * 40).alias("value"))
    totals = whole.select("run", "rank", F.lit(0).alias("at"), cells(F.lit("Total"), F.lit("-"), F.col("total").cast("string"), F.lit("100 %")).alias("value"))
    body = sums.select("run", "rank", (F.col("a") + 1).cast("int").alias("at"), row.alias("value"))
    # Tables hold 17 actions and 40 fillers, of which every row counts.
    spare = F.explode(F.sequence(F.lit(0), F.lit(39)))
    fill = whole.select("run", "rank", spare.alias("i"))
    fillers = fill.select("run", "rank", (F.col("i") + 100).alias("at"), cells(F.concat(F.lit("filler_"), F.col("i").cast("string")), F.lit("0"), F.lit("0"), F.lit("0")).alias("value"))
    lines = heads.unionByName(rules).unionByName(totals).unionByName(body).unionByName(fillers)
    file = F.concat(F.lit("log_n"), (F.col("run") + 1).cast("string"), F.lit("_g"), (4 * (F.col("run") + 1)).cast("string"), F.lit("_b16_"))
    named = lines.withColumn("file", file).repartition("file").sortWithinPartitions("file", "rank", "at")
    named.select("file", "value").write.partitionBy("file").text(path)
    found = logs.pivot_actions(logs.parse_profile_logs(spark, path), ["action_1", "action_15", "filler_39", "total"])
    return found.drop("path")


@catalog.add("s09_dataset", f"""
WITH {SEQS_CTE} SELECT label, genome_id, count(*) AS n, CAST(sum(length(seq)) AS BIGINT) AS n_bases FROM seqs GROUP BY label, genome_id""")
def dataset(spark, sf):
    path = scratch(spark, "dataset")
    seqs = sequences(spark, sf)
    genomes = seqs.select("genome_id").distinct().withColumn("rep", F.col("genome_id"))
    tables.write_dataset(path, seqs, seqs.select("label").distinct(), genomes, n_buckets=8)
    stored = tables.read_dataset(spark, path, "sequences").join(tables.read_dataset(spark, path, "genomes"), "genome_id")
    labelled = stored.join(tables.read_dataset(spark, path, "taxa"), "label")
    return labelled.groupBy("label", "genome_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("seq")).alias("n_bases"))


@catalog.add("s10_vectors", f"""
WITH {DIST_CTE} SELECT 'vector' AS kind, CAST(vec_id AS VARCHAR) AS a, NULL AS b, round(CAST(list_sum(embedding) AS DOUBLE), 3) AS d FROM embeddings
UNION ALL SELECT 'distance', CAST(a AS VARCHAR), CAST(b AS VARCHAR), round(CAST(CAST(d AS FLOAT) AS DOUBLE), 3) FROM dist""")
def vectors(spark, sf):
    paths = scratch(spark, "vectors"), scratch(spark, "distances")
    tables.write_vectors(table(spark, sf, "embeddings"), paths[0], "vec_id", "embedding")
    tables.write_distances(distances(spark, sf), paths[1])
    total = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x)
    vecs = tables.read_vectors(spark, paths[0]).select(F.lit("vector").alias("kind"), F.col("name").alias("a"), F.round(total, 3).alias("d"))
    pairs = tables.read_distances(spark, paths[1])
    pairs = pairs.select(F.lit("distance").alias("kind"), F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.round(F.col("d").cast("double"), 3).alias("d"))
    return vecs.unionByName(pairs, allowMissingColumns=True)


@catalog.add("s11_tnf", f"""
WITH {KMERS_CTE}, c AS (SELECT genome_id AS name, least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n FROM kmers
  WHERE NOT contains(kmer, 'N') GROUP BY 1, 2), f AS (SELECT name, kmer, n / sum(n) OVER (PARTITION BY name) AS freq FROM c)
SELECT name, kmer, round(freq, 6) AS freq, CAST(vec_id AS VARCHAR) AS target FROM f
JOIN embeddings ON name = 'src' || vec_id""")
def tnf(spark, sf):
    path = scratch(spark, "tnf")
    freq = aggregate.tetramer_freq(sequences(spark, sf), ["genome_id"], "seq").withColumnRenamed("genome_id", "name")
    tables.write_tnf(freq, path)
    targets = table(spark, sf, "embeddings").select(F.concat(F.lit("src"), F.col("vec_id").cast("string")).alias("name"), F.col("vec_id").cast("string").alias("target"))
    return tables.read_tnf(spark, path, targets).withColumn("freq", F.round("freq", 6))


@catalog.add("s12_summary", f"WITH {MEANS_CTE}, {TOP_SQL}")
def summary(spark, sf):
    path = scratch(spark, "summary")
    tables.write_summary({"sequences": taxonomy.level_predictions(rolled(spark, sf), ["seq_id"], 3)}, path)
    return tables.read_summary(spark, path, "sequences").select("seq_id", "level", "pred", *probability_columns())


@catalog.add("s13_csv", f"WITH {LINEAGE_CTE} SELECT CAST(s_suppkey AS VARCHAR) AS id, lineage FROM lineage")
def csv(spark, sf):
    path = scratch(spark, "csv")
    tables.write_csv(lineage(spark, sf).select(F.col("s_suppkey").alias("id"), "lineage"), path)
    return spark.read.csv(path, header=True, schema="id string, lineage string")


@catalog.add("s15_write_splits", f"""
WITH {LENS_CTE}, r AS (SELECT seq_id, L, row_number() OVER (ORDER BY L DESC, seq_id) - 1 AS k FROM lens),
b AS (SELECT seq_id, L, CASE WHEN (k // 6) % 2 = 0 THEN k % 6 ELSE 5 - k % 6 END AS bucket FROM r)
SELECT CAST(bucket AS INTEGER) AS bucket, count(*) AS n_files, CAST(sum(seq_id) AS BIGINT) AS id_sum FROM b GROUP BY bucket""")
def write_splits(spark, sf):
    path = scratch(spark, "splits")
    placed = ordering.balanced_buckets(settled_lengths(spark, sf), "seq_id", "L", 6)
    fasta.write_splits(placed.select("bucket", F.col("seq_id").cast("string").alias("value")), path)
    lists = spark.read.text(path)
    return lists.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.col("value").cast("bigint")).alias("id_sum"))
