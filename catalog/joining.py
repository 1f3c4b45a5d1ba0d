"""Joins of sequences, genomes, taxa, vectors and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.aggregating import MEANS_CTE, rolled, scored
from catalog.common import CHUNKS_CTE, REPS_CTE, SEQS_CTE, TAXA_CTE, Catalog, chunks, class_taxa, members, metadata, sequences, table
from catalog.common import META_CTE
from cladeflow.operators import aggregate, joins, taxonomy

catalog = Catalog()


@catalog.add("j01_attach_rep", f"""
WITH {REPS_CTE}, taxa AS (SELECT p_partkey AS rep, p_name AS species FROM part WHERE p_partkey % 5 < 4)
SELECT accession, rep, species FROM members LEFT JOIN taxa USING (rep)""")
def attach_rep(spark, sf):
    genomes = members(spark, sf).select("accession", "rep")
    taxa = table(spark, sf, "part").where("p_partkey % 5 < 4").select(F.col("p_partkey").alias("rep"), F.col("p_name").alias("species"))
    found = taxonomy.attach_rep(genomes, taxa, "rep")
    return found.unionByName(taxonomy.missing_reps(genomes, taxa, "rep"), allowMissingColumns=True)


@catalog.add("j02_resolve_labels", """
SELECT o_orderkey, n_nationkey, n_name AS phylum, r_name AS domain, r_name || ',' || n_name AS labels FROM orders
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def resolve_labels(spark, sf):
    seqs = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("genome"))
    genomes = table(spark, sf, "customer").select(F.col("c_custkey").alias("genome"), F.col("c_nationkey").alias("n_nationkey"))
    taxa = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    taxa = taxa.select("n_nationkey", F.col("n_name").alias("phylum"), F.col("r_name").alias("domain"))
    found = taxonomy.resolve_labels(seqs, genomes, taxa, "genome", "n_nationkey", ["domain", "phylum"])
    return found.select("o_orderkey", "n_nationkey", "phylum", "domain", F.array_join("labels", ",").alias("labels"))


@catalog.add("j03_attach_embeddings", """
WITH d AS (SELECT doc_id, [CAST(0 AS DOUBLE), CAST(doc_id AS DOUBLE)] AS old FROM documents)
SELECT 'match' AS kind, doc_id, round(list_sum([CAST(x AS DOUBLE) for x in embedding]), 5) AS total FROM d JOIN embeddings ON doc_id = vec_id
UNION ALL SELECT 'overwrite', doc_id, round(coalesce(list_sum([CAST(x AS DOUBLE) for x in embedding]), list_sum(old)), 5) FROM d
LEFT JOIN embeddings ON doc_id = vec_id""")
def attach_embeddings(spark, sf):
    name = F.concat(F.lit("RS_"), F.col("doc_id").cast("string"))
    old = F.array(F.lit(0.0), F.col("doc_id").cast("double"))
    taxa = table(spark, sf, "documents").select("doc_id", name.alias("taxon"), old.alias("embedding"))
    vectors = table(spark, sf, "embeddings").select(
        F.concat(F.lit("GB_"), F.col("vec_id").cast("string")).alias("name"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    parts = []
    for kind, unmatched in (("match", False), ("overwrite", True)):
        found = taxonomy.attach_embeddings(taxa, vectors, "taxon", "name", "embedding", keep_unmatched=unmatched)
        total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x)
        parts.append(found.select(F.lit(kind).alias("kind"), "doc_id", F.round(total, 5).alias("total")))
    return parts[0].unionByName(parts[1])


@catalog.add("j05_match_files", f"""
WITH {META_CTE}, a AS (SELECT regexp_replace(accession, '^(RS|GB)_', '') AS accession FROM meta),
f AS (SELECT url || '/' || a.accession || '_' || page_id || '.fna' AS path, a.accession FROM pages
  JOIN (SELECT regexp_replace(accession, '^(RS|GB)_', '') AS accession, p_partkey FROM meta) a ON page_id // 2 = p_partkey)
SELECT a.accession, min(path) AS path FROM a LEFT JOIN f ON f.accession = a.accession
WHERE a.accession LIKE 'GC%' GROUP BY a.accession""")
def match_files(spark, sf):
    from cladeflow.functions import names

    meta = metadata(spark, sf).select("p_partkey", names.strip_tag(F.col("accession")).alias("accession")).where("accession LIKE 'GC%'")
    pages = table(spark, sf, "pages").select("page_id", "url", F.expr("page_id div 2").alias("p_partkey")).join(meta, "p_partkey")
    path = F.concat("url", F.lit("/"), "accession", F.lit("_"), F.col("page_id").cast("string"), F.lit(".fna"))
    found, missing = taxonomy.match_files(meta, pages.select(path.alias("path")), "accession", "path")
    return found.unionByName(missing, allowMissingColumns=True)


@catalog.add("j14_reconcile", f"""
WITH {SEQS_CTE}, stored AS (SELECT genome_id, seq_id, CASE WHEN seq_id % 31 = 0 THEN seq || 'A' ELSE seq END AS seq FROM seqs WHERE seq_id % 50 <> 0),
source AS (SELECT genome_id, seq_id, seq FROM seqs WHERE seq_id % 70 <> 0)
SELECT genome_id, seq_id, CASE WHEN b.seq IS NULL THEN 'only_stored' WHEN a.seq IS NULL THEN 'only_source' ELSE 'content' END AS status
FROM stored a FULL JOIN source b USING (genome_id, seq_id) WHERE a.seq IS NULL OR b.seq IS NULL OR a.seq <> b.seq""")
def reconcile(spark, sf):
    seqs = sequences(spark, sf).select("genome_id", "seq_id", "seq")
    changed = F.when(F.col("seq_id") % 31 == 0, F.concat("seq", F.lit("A"))).otherwise(F.col("seq"))
    stored = seqs.where("seq_id % 50 <> 0").withColumn("seq", changed)
    return joins.reconcile(stored, seqs.where("seq_id % 70 <> 0"), ["genome_id", "seq_id"], "seq")


@catalog.add("j19_expand_vectors", f"""
WITH {CHUNKS_CTE}, parents AS (SELECT label % 5 AS region, class, avg(z) AS z FROM raw_long GROUP BY ALL),
meta AS (SELECT n_regionkey AS region, c_nationkey AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT s_nationkey % 5, s_nationkey FROM supplier)
SELECT nation, class, round(avg(z), 6) AS z FROM meta JOIN parents USING (region) GROUP BY nation, class""")
def expand_vectors(spark, sf):
    labelled = chunks(spark, sf).withColumn("region", F.col("label") % 5)
    parents = aggregate.mean_outputs(labelled, ["region"], "logits").drop("n_chunks")
    customers = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    meta = customers.select(F.col("n_regionkey").alias("region"), F.col("c_nationkey").alias("nation")).unionByName(
        table(spark, sf, "supplier").select((F.col("s_nationkey") % 5).alias("region"), F.col("s_nationkey").alias("nation"))
    )
    expanded = taxonomy.expand_vectors(parents, meta, "region", "nation", "logits")
    long = aggregate.long_outputs(expanded, ["nation"], "logits")
    return long.select("nation", F.col("class").cast("bigint").alias("class"), F.round("p", 6).alias("z"))


@catalog.add("j20_spread_logits", f"""
WITH {CHUNKS_CTE}, {TAXA_CTE}, s AS (SELECT genus, count(*) AS n FROM taxa GROUP BY genus)
SELECT chunk_id, genus, species, round(z - ln(n), 6) AS z FROM raw_long JOIN s ON class = genus JOIN taxa USING (genus)""")
def spread_logits(spark, sf):
    logits = aggregate.long_outputs(chunks(spark, sf), ["chunk_id"], "logits")
    logits = logits.select("chunk_id", F.col("class").alias("genus"), F.col("p").alias("z"))
    spread = taxonomy.spread_logits(logits, class_taxa(spark, sf), "genus", "species", "z")
    return spread.select("chunk_id", "genus", "species", F.round("z", 6).alias("z"))


@catalog.add("j21_classification_table", f"""
WITH {MEANS_CTE}, b AS (SELECT seq_id, arg_min(class, (-p, class)) AS pred, max(p) AS score FROM means GROUP BY seq_id)
SELECT 'file' || seq_id % 3 AS filename, seq_id AS "ID", family, genus, species, round(score, 6) AS score FROM b JOIN taxa ON pred = species""")
def classification_table(spark, sf):
    from cladeflow.functions import vectors as V

    means = aggregate.mean_outputs(scored(spark, sf), ["seq_id"], "p")
    preds = means.select(
        F.concat(F.lit("file"), (F.col("seq_id") % 3).cast("string")).alias("filename"),
        F.col("seq_id").alias("ID"),
        V.argmax(F.col("p")).alias("pred"),
        F.round(F.array_max("p"), 6).alias("score"),
    )
    taxa = class_taxa(spark, sf)
    found = taxonomy.classification_table(preds, taxa.withColumn("leaf", F.col("species")), "leaf", ["family", "genus", "species"])
    return found.select("filename", "ID", "family", "genus", "species", "score")
