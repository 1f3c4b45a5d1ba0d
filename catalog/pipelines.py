"""Whole plans over the given tables: data preparation, the alignment baseline, hierarchical summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.aggregating import scored
from catalog.common import (
    CHUNKS_CTE, DNA_SQL, HITS_CTE, LEVELS, META_CTE, TAX_CTE, TAXA_CTE, Catalog, class_taxa, hits, metadata, sequences, subject_taxonomy,
)
from cladeflow import scratch
from cladeflow.functions import names
from cladeflow.plans import baseline, inference, prepare
from cladeflow.session import settle
from cladeflow.sources import fasta, files, tables

catalog = Catalog()

#: Genomes that have files: the parts with the first keys.
GENOMES = 150


def name_files(spark, root, ending):
    """Give the one file of each `accession=…` folder the name of an archive file."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in fs.listStatus(path):
        if folder.isDirectory():
            accession = folder.getPath().getName().split("=")[-1]
            for file in fs.listStatus(folder.getPath()):
                if file.getPath().getName().startswith("part-"):
                    fs.rename(file.getPath(), jvm.org.apache.hadoop.fs.Path(folder.getPath(), f"{accession}_asm{ending}"))


def archive(spark, sf):
    """(path of a metadata table, folder of genomic files and others) of the parts as genomes."""
    meta, root, path = settle(metadata(spark, sf)), scratch(spark, "archive"), scratch(spark, "metadata")
    reps = meta.groupBy("p_brand").agg(F.min("p_partkey").alias("p_partkey")).join(meta.select("p_partkey", F.col("accession").alias("rep")), "p_partkey")
    lineage = F.concat(F.lit("d__"), F.substring("p_brand", 1, 7), F.lit(";p__"), "p_brand", F.lit(";c__;o__;f__;g__;s__"), "p_brand")
    rows = meta.join(reps.select("p_brand", "rep"), "p_brand").select(
        "accession", lineage.alias("gtdb_taxonomy"), F.col("rep").alias("gtdb_genome_representative"), "contig_count",
        F.lit(99.5).alias("checkm_completeness"), F.col("p_name").alias("unused"),
    )
    tables.write_csv(rows, path, sep="\t")
    named = meta.select("p_partkey", names.strip_tag(F.col("accession")).alias("accession")).where("accession LIKE 'GC%'")
    owned = sequences(spark, sf).withColumn("p_partkey", F.col("seq_id") % GENOMES).join(named, "p_partkey")
    records = owned.select("accession", F.concat(F.lit(">s"), F.col("seq_id").cast("string"), F.lit(" x\n"), "seq").alias("value"))
    for kind, part in (("genomic", records), ("cds", records.where("value LIKE '>s1%'"))):
        below, ending = f"{root}/{kind}", files.SUFFIX[kind]
        part.repartition("accession").write.partitionBy("accession").option("compression", "gzip").text(below)
        name_files(spark, below, ending)
    return path, root


ARCHIVE_CTE = f"""{META_CTE}, tagged AS (SELECT p_partkey, p_brand, regexp_replace(accession, '^(RS|GB)_', '') AS accession, contig_count FROM meta),
m AS (SELECT t.accession, r.accession AS rep, t.p_partkey, t.p_brand, t.contig_count FROM tagged t JOIN tagged r ON t.p_brand = r.p_brand
  JOIN (SELECT p_brand, min(p_partkey) AS k FROM meta GROUP BY p_brand) b ON r.p_brand = b.p_brand AND r.p_partkey = b.k
  WHERE t.accession LIKE 'GC%' AND r.accession LIKE 'GC%'),
picked AS (SELECT arg_min(accession, (contig_count, accession)) AS accession FROM m WHERE accession <> rep GROUP BY rep
  UNION SELECT arg_min(accession, (-contig_count, accession)) FROM m WHERE accession <> rep GROUP BY rep),
docs AS (SELECT 's' || doc_id AS seq_id, accession, {DNA_SQL} AS seq FROM documents JOIN tagged ON p_partkey = doc_id % {GENOMES})"""


@catalog.add("s16_prepare_data", f"""
WITH {ARCHIVE_CTE}
SELECT 'genome' AS kind, m.accession AS id, m.rep AS taxon, count(*) AS n_seqs, CAST(sum(length(seq)) AS BIGINT) AS bases, min(md5(seq_id || seq)) AS first
FROM m JOIN picked USING (accession) JOIN docs USING (accession) GROUP BY ALL
UNION ALL SELECT 'taxon', accession, 'p__' || p_brand, NULL, NULL, NULL FROM m WHERE accession = rep""")
def prepare_data(spark, sf):
    path, root = archive(spark, sf)
    out = scratch(spark, "dataset")
    prepare.write_prepared(prepare.prepare_data(spark, path, root, which="nonreps", missing="skip"), out)
    parts = {name: tables.read_dataset(spark, out, name) for name in ("sequences", "genomes", "taxa")}
    genomes = parts["sequences"].join(parts["genomes"], "genome_id").groupBy("genome_id", "taxon_id").agg(
        F.count(F.lit(1)).alias("n_seqs"), F.sum("length").cast("bigint").alias("bases"), F.min(F.md5(F.concat("seq_id", "sequence"))).alias("first")
    )
    genomes = genomes.select(F.lit("genome").alias("kind"), F.col("genome_id").alias("id"), F.col("taxon_id").alias("taxon"), "n_seqs", "bases", "first")
    taxa = parts["taxa"].select(F.lit("taxon").alias("kind"), F.col("taxon_id").alias("id"), F.col("phylum").alias("taxon"))
    return genomes.unionByName(taxa, allowMissingColumns=True)


@catalog.add("s04_list_files", f"""
WITH {ARCHIVE_CTE}, f AS (SELECT accession, count(*) FILTER (seq_id LIKE 's1%') AS n FROM docs WHERE accession LIKE 'GC%' GROUP BY accession)
SELECT accession, k AS kind, CASE WHEN n IS NULL OR k = 'cds' AND n = 0 THEN 'no file' ELSE 'found' END AS status
FROM tagged LEFT JOIN f USING (accession), (SELECT unnest(['genomic', 'cds']) AS k)""")
def list_files(spark, sf):
    _, root = archive(spark, sf)
    listing = files.list_files(spark, root)
    asked = metadata(spark, sf).select("accession")
    found = [files.locate_files(listing, asked, kind).withColumn("kind", F.lit(kind)) for kind in ("genomic", "cds")]
    return found[0].unionByName(found[1]).select("accession", "kind", "status")


RANKS = ("domain", "phylum", "species")


@catalog.add("x09_alignment_baseline", f"""
WITH {HITS_CTE}, {TAX_CTE}, h AS (SELECT 'G' || orf % 50 AS accession, 's' || orf % 400 AS seq_name, orf, subject, bitscore FROM hits WHERE orf % 3 > 0),
near AS (SELECT *, max(bitscore) OVER (PARTITION BY orf) AS best FROM h QUALIFY bitscore >= CAST(0.9 AS DOUBLE) * best),
o AS (SELECT accession, seq_name, orf, avg(bitscore) AS score, CASE WHEN count(DISTINCT domain) = 1 THEN min(domain) END AS domain,
  CASE WHEN count(DISTINCT phylum) = 1 THEN min(phylum) END AS phylum, CASE WHEN count(DISTINCT species) = 1 THEN min(species) END AS species
  FROM near LEFT JOIN tax USING (subject) GROUP BY ALL),
l AS (SELECT accession, seq_name, score, 'domain' AS rank, domain AS taxon FROM o UNION ALL SELECT accession, seq_name, score, 'phylum', phylum FROM o
  UNION ALL SELECT accession, seq_name, score, 'species', species FROM o),
g AS (SELECT accession, seq_name, rank, taxon, sum(score) AS s FROM l GROUP BY ALL),
w AS (SELECT accession, seq_name, rank, arg_min(taxon, (-s, taxon)) FILTER (taxon IS NOT NULL) AS taxon,
  max(s) FILTER (taxon IS NOT NULL) >= 0.5 * sum(s) AS enough FROM g GROUP BY ALL),
inputs AS (SELECT DISTINCT 'G' || orf % 50 AS accession, 's' || orf % 400 AS seq_name FROM hits),
truth AS (SELECT 'G' || subject AS accession, domain, phylum, species FROM tax WHERE subject < 50),
j AS (SELECT t.domain AS d, r.rank, CASE WHEN w.enough THEN w.taxon END AS pred, CASE r.rank WHEN 'phylum' THEN t.phylum ELSE t.species END AS truth
  FROM inputs i JOIN truth t USING (accession), (SELECT unnest(['phylum', 'species']) AS rank) r
  LEFT JOIN w ON w.accession = i.accession AND w.seq_name = i.seq_name AND w.rank = r.rank)
SELECT rank, d AS domain, round(avg(CAST(pred IS NOT NULL AS INT)), 6) AS share, round(avg(CAST(pred = truth AS INT)), 6) AS accuracy, count(*) AS n
FROM j GROUP BY GROUPING SETS ((rank), (rank, d))""")
def alignment_baseline(spark, sf):
    orf = F.col("orf").cast("string")
    genome, name = F.concat(F.lit("G"), (F.col("orf") % 50).cast("string")), F.concat(F.lit("s"), (F.col("orf") % 400).cast("string"))
    found = hits(spark, sf)
    query = F.concat(genome, F.lit("-9-"), name, F.lit("_"), orf)
    aligned = found.where("orf % 3 > 0").select(query.alias("query"), F.concat(F.lit("G"), F.col("subject").cast("string"), F.lit("-x")).alias("subject"), "bitscore")
    records = found.select(F.concat(genome, F.lit("-9-"), name).alias("seq_id")).distinct()
    taxa = subject_taxonomy(spark, sf).withColumn("accession", F.concat(F.lit("G"), F.col("subject").cast("string")))
    classified = settle(baseline.classify_by_hits(aligned, taxa, RANKS)[1])
    known = taxa.where("subject < 50")
    report = baseline.hit_accuracy(baseline.input_sequences(records), classified, known, RANKS)
    return report.select("rank", "domain", F.round("share", 6).alias("share"), F.round("accuracy", 6).alias("accuracy"), "n")


@catalog.add("x10_hierarchical_summary", f"""
WITH {CHUNKS_CTE}, {TAXA_CTE}, s AS (SELECT seq_id, class, avg(p) AS p FROM probs GROUP BY ALL),
r AS (SELECT seq_id, species, genus, family, p FROM s JOIN taxa ON class = species),
f AS (SELECT seq_id, family, sum(p) AS p FROM r GROUP BY ALL),
f1 AS (SELECT seq_id, arg_min(family, (-round(p, 12), family)) AS pred, max(p) / sum(p) AS top FROM f GROUP BY seq_id),
g AS (SELECT r.seq_id, genus, sum(p) AS p FROM r JOIN f1 ON r.seq_id = f1.seq_id AND family = pred GROUP BY ALL),
g1 AS (SELECT seq_id, arg_min(genus, (-round(p, 12), genus)) AS pred, max(p) / sum(p) AS top FROM g GROUP BY seq_id),
t AS (SELECT r.seq_id, species, p FROM r JOIN g1 ON r.seq_id = g1.seq_id AND genus = pred),
t1 AS (SELECT seq_id, arg_min(species, (-round(p, 12), species)) AS pred, max(p) / sum(p) AS top FROM t GROUP BY seq_id)
SELECT seq_id, 'family' AS level, pred, round(top, 6) AS p1 FROM f1 UNION ALL SELECT seq_id, 'genus', pred, round(top, 6) FROM g1
UNION ALL SELECT seq_id, 'species', pred, round(top, 6) FROM t1""")
def hierarchical_summary(spark, sf):
    rows = scored(spark, sf).withColumn("genome_id", F.col("seq_id") % 4)
    lengths = rows.groupBy("seq_id", "genome_id").agg(F.sum("length").cast("bigint").alias("length"))
    seqs, _ = inference.infer_summary(rows, lengths, class_taxa(spark, sf), "species", LEVELS, hierarchy=True)
    return seqs.select("seq_id", "level", "pred", F.round(F.get("maxprob", 0), 6).alias("p1"))
