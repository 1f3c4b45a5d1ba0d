"""Grouped statistics of records, assemblies and window outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import CHUNKS_CTE, LEVELS, TAXA_CTE, Catalog, chunks, class_taxa, table
from catalog.windowing import LENS_CTE, lengths
from cladeflow.functions import vectors as V
from cladeflow.operators import aggregate, taxonomy

catalog = Catalog()

NESTED_CTE = """level_map AS (
  SELECT species AS class, 'species' AS level, species AS taxon FROM taxa
  UNION SELECT species, 'genus', genus FROM taxa UNION SELECT species, 'family', family FROM taxa)"""
MEANS_CTE = f"""{CHUNKS_CTE}, {TAXA_CTE}, {NESTED_CTE},
means AS (SELECT seq_id, class, avg(p) AS p FROM probs GROUP BY seq_id, class),
rolled AS (SELECT seq_id, level, taxon, sum(p) AS p FROM means JOIN level_map USING (class) GROUP BY ALL)"""


def scored(spark, sf):
    """Window probabilities."""
    return chunks(spark, sf).withColumn("p", V.softmax(F.col("logits"))).drop("logits")


def long_rounded(df, keys, vec, name, digits=6):
    long = aggregate.long_outputs(df, keys, vec)
    return long.select(*keys, F.col("class").cast("bigint").alias("class"), F.round("p", digits).alias(name))


@catalog.add("a01_count_sequence", f"""
WITH {LENS_CTE} SELECT genome_id, count(*) AS n_records, CAST(sum(L) AS BIGINT) AS n_bases FROM lens
GROUP BY ROLLUP (genome_id)""")
def count_sequence(spark, sf):
    return aggregate.count_sequence(lengths(spark, sf), "genome_id", "L")


@catalog.add("a02_genome_lengths", f"""
WITH {LENS_CTE} SELECT 'genome' AS kind, genome_id AS id, CAST(sum(L) AS BIGINT) AS length FROM lens GROUP BY genome_id
UNION ALL SELECT 'label', label, CAST(sum(L) AS BIGINT) FROM lens GROUP BY label""")
def genome_lengths(spark, sf):
    rows = lengths(spark, sf)
    out = [
        aggregate.genome_lengths(rows, key, "L").select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "length")
        for kind, key in (("genome", "genome_id"), ("label", "label"))
    ]
    return out[0].unionByName(out[1])


@catalog.add("a03_assembly_stats", """
WITH c AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS len FROM lineitem),
o AS (SELECT l_orderkey, len, row_number() OVER w AS rank, sum(len) OVER w AS cum, sum(len) OVER (PARTITION BY l_orderkey) AS total
  FROM c WINDOW w AS (PARTITION BY l_orderkey ORDER BY len DESC ROWS UNBOUNDED PRECEDING))
SELECT l_orderkey, count(*) AS n_ctgs, max(len) AS max_len, round(avg(len), 6) AS mean_len,
  arg_min(len, rank) FILTER (cum > total * 0.5) AS n50_len, min(rank) FILTER (cum > total * 0.5) AS n50_rank,
  arg_min(len, rank) FILTER (cum > total * 0.9) AS n90_len, min(rank) FILTER (cum > total * 0.9) AS n90_rank
FROM o GROUP BY l_orderkey""")
def assembly_stats(spark, sf):
    contigs = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").cast("bigint").alias("len"))
    return aggregate.assembly_stats(contigs, "l_orderkey", "len").withColumn("mean_len", F.round("mean_len", 6))


@catalog.add("a04_mean_outputs", f"""
WITH {CHUNKS_CTE} SELECT seq_id, class, round(avg(p), 6) AS p, count(*) AS n_chunks FROM probs GROUP BY seq_id, class""")
def mean_outputs(spark, sf):
    means = aggregate.mean_outputs(scored(spark, sf), ["seq_id"], "p")
    long = aggregate.long_outputs(means, ["seq_id", "n_chunks"], "p")
    return long.select("seq_id", F.col("class").cast("bigint").alias("class"), F.round("p", 6).alias("p"), "n_chunks")


@catalog.add("a05_weighted_mean", f"""
WITH {CHUNKS_CTE} SELECT seq_id, class, round(sum(p * length) / sum(length), 6) AS p FROM probs GROUP BY seq_id, class""")
def weighted_mean(spark, sf):
    return long_rounded(aggregate.mean_outputs(scored(spark, sf), ["seq_id"], "p", weight="length"), ["seq_id"], "p", "p")


@catalog.add("a06_var_outputs", f"""
WITH {CHUNKS_CTE} SELECT seq_id, class, round(var_pop(p), 8) AS variance FROM probs GROUP BY seq_id, class""")
def var_outputs(spark, sf):
    return long_rounded(aggregate.var_outputs(scored(spark, sf), ["seq_id"], "p"), ["seq_id"], "p", "variance", 8)


@catalog.add("a07_median_outputs", f"""
WITH {CHUNKS_CTE} SELECT seq_id, class, round(median(p), 6) AS median FROM probs GROUP BY seq_id, class""")
def median_outputs(spark, sf):
    medians = aggregate.median_outputs(scored(spark, sf), ["seq_id"], "p")
    return medians.select("seq_id", F.col("class").cast("bigint").alias("class"), F.round("median", 6).alias("median"))


VOTES_CTE = f"""{CHUNKS_CTE}, pick AS (SELECT chunk_id, seq_id, label, length, arg_min(class, (-p, class)) AS pred
  FROM probs GROUP BY ALL),
votes AS (SELECT seq_id, pred, count(*) AS n FROM pick GROUP BY seq_id, pred)"""


@catalog.add("a08_votes", f"""
WITH {VOTES_CTE}, m AS (SELECT seq_id, arg_min(pred, (-n, pred)) AS vote FROM votes GROUP BY seq_id)
SELECT seq_id, pred, n, round(n / sum(n) OVER (PARTITION BY seq_id), 6) AS share, vote FROM votes JOIN m USING (seq_id)""")
def votes(spark, sf):
    rows = scored(spark, sf)
    cast = aggregate.votes(rows, ["seq_id"], "p")
    winner = aggregate.majority_vote(rows, ["seq_id"], "p").withColumnRenamed("pred", "vote")
    return cast.join(winner, "seq_id").select(
        "seq_id", F.col("pred").cast("bigint").alias("pred"), "n", F.round("share", 6).alias("share"),
        F.col("vote").cast("bigint").alias("vote"),
    )


@catalog.add("a09_single_label", f"""
WITH {CHUNKS_CTE} SELECT 'seq' AS kind, seq_id AS id, min(label) AS first_label, max(label) AS last_label FROM chunks
GROUP BY seq_id HAVING min(label) <> max(label)
UNION ALL SELECT 'batch', chunk_id // 50, min(label), max(label) FROM chunks GROUP BY 2 HAVING min(label) <> max(label)
UNION ALL SELECT 'label', seq_id, min(label), NULL FROM chunks GROUP BY seq_id""")
def single_label(spark, sf):
    rows = chunks(spark, sf).withColumn("batch", F.expr("chunk_id div 50"))
    seqs = aggregate.mixed_labels(rows, "seq_id", "label").withColumnRenamed("seq_id", "id")
    batches = aggregate.mixed_labels(rows, "batch", "label").withColumnRenamed("batch", "id")
    picked = aggregate.pick_label(rows, "seq_id", "label").select(
        F.lit("label").alias("kind"), F.col("seq_id").alias("id"), F.col("label").alias("first_label")
    )
    mixed = seqs.withColumn("kind", F.lit("seq")).unionByName(batches.withColumn("kind", F.lit("batch")))
    return mixed.unionByName(picked, allowMissingColumns=True).select("kind", "id", "first_label", "last_label")


@catalog.add("a10_argmax", f"WITH {VOTES_CTE} SELECT chunk_id, pred FROM pick")
def argmax(spark, sf):
    return scored(spark, sf).select("chunk_id", V.argmax(F.col("p")).cast("bigint").alias("pred"))


TOP_SQL = """r AS (SELECT seq_id, level, taxon, p, row_number() OVER (PARTITION BY seq_id, level ORDER BY p DESC, taxon) AS rn
  FROM rolled)
SELECT seq_id, level, max(taxon) FILTER (rn = 1) AS pred, round(max(p) FILTER (rn = 1), 6) AS p1,
  round(max(p) FILTER (rn = 2), 6) AS p2, round(max(p) FILTER (rn = 3), 6) AS p3 FROM r GROUP BY seq_id, level"""


def probability_columns(k=3):
    return [F.round(F.get("maxprob", i), 6).alias(f"p{i + 1}") for i in range(k)]


def rolled(spark, sf):
    means = aggregate.mean_outputs(scored(spark, sf), ["seq_id"], "p")
    return taxonomy.roll_up(means, ["seq_id"], "p", class_taxa(spark, sf), "species", LEVELS)


@catalog.add("a11_top_probs", f"WITH {MEANS_CTE}, {TOP_SQL}")
def top_probs(spark, sf):
    return taxonomy.level_predictions(rolled(spark, sf), ["seq_id"], 3).select("seq_id", "level", "pred", *probability_columns())


@catalog.add("j15_roll_up", f"WITH {MEANS_CTE} SELECT seq_id, level, taxon, round(p, 6) AS p FROM rolled")
def roll_up(spark, sf):
    return rolled(spark, sf).withColumn("p", F.round("p", 6))


@catalog.add("j16_predict_hierarchical", f"""
WITH {MEANS_CTE},
f AS (SELECT seq_id, arg_min(taxon, (-p, taxon)) AS pred, max(p) / sum(p) AS p1 FROM rolled WHERE level = 'family' GROUP BY 1),
g AS (SELECT r.seq_id, arg_min(r.taxon, (-r.p, r.taxon)) AS pred, max(r.p) / sum(r.p) AS p1 FROM rolled r JOIN f USING (seq_id)
  JOIN (SELECT DISTINCT family, genus FROM taxa) t ON t.family = f.pred AND t.genus = r.taxon WHERE level = 'genus' GROUP BY 1),
s AS (SELECT r.seq_id, arg_min(r.taxon, (-r.p, r.taxon)) AS pred, max(r.p) / sum(r.p) AS p1 FROM rolled r JOIN g USING (seq_id)
  JOIN (SELECT DISTINCT genus, species FROM taxa) t ON t.genus = g.pred AND t.species = r.taxon WHERE level = 'species' GROUP BY 1)
SELECT seq_id, 'family' AS level, pred, round(p1, 6) AS p1 FROM f UNION ALL SELECT seq_id, 'genus', pred, round(p1, 6) FROM g
UNION ALL SELECT seq_id, 'species', pred, round(p1, 6) FROM s""")
def predict_hierarchical(spark, sf):
    picked = taxonomy.predict_hierarchical(rolled(spark, sf), class_taxa(spark, sf), ["seq_id"], LEVELS, 2)
    return picked.select("seq_id", "level", "pred", *probability_columns(1))


@catalog.add("a12_aggregate_seqs", f"""
WITH {CHUNKS_CTE}, s AS (SELECT seq_id, label, class, avg(p) AS p, sum(length) AS length FROM probs GROUP BY ALL)
SELECT label, class, round(sum(p * length) / sum(length), 6) AS p, CAST(sum(length) AS BIGINT) AS length FROM s GROUP BY label, class""")
def aggregate_seqs(spark, sf):
    seqs = aggregate.aggregate_chunks(scored(spark, sf), "seq_id", "p", "label", "length")
    by_label = aggregate.aggregate_seqs(seqs, "label", "mean", "length")
    long = aggregate.long_outputs(by_label, ["label", "length"], "mean")
    return long.select("label", F.col("class").cast("bigint").alias("class"), F.round("p", 6).alias("p"), "length")


@catalog.add("a13_aggregate_chunks", f"""
WITH {VOTES_CTE}, v AS (SELECT seq_id, arg_min(pred, (-n, pred)) AS vote FROM votes GROUP BY seq_id),
m AS (SELECT seq_id, label, class, sum(p * length) / sum(length) AS mean, var_pop(p) AS variance, count(*) AS n_chunks,
    sum(length) AS length FROM probs GROUP BY ALL),
b AS (SELECT seq_id, arg_min(class, (-mean, class)) AS pred FROM m GROUP BY seq_id)
SELECT seq_id, label, class, round(mean, 6) AS mean, round(variance, 8) AS variance, n_chunks,
  CAST(floor(length / 2) AS BIGINT) AS length, pred, vote FROM m JOIN b USING (seq_id) JOIN v USING (seq_id)""")
def aggregate_chunks(spark, sf):
    seqs = aggregate.aggregate_chunks(
        chunks(spark, sf), "seq_id", "logits", "label", "length", weighted=True, softmax=True, both_strands=True
    )
    pairs = F.posexplode(F.arrays_zip("mean", "variance")).alias("class", "_p")
    long = seqs.select("seq_id", "label", "n_chunks", "length", "pred", "vote", pairs)
    return long.select(
        "seq_id", "label", F.col("class").cast("bigint").alias("class"), F.round("_p.mean", 6).alias("mean"),
        F.round("_p.variance", 8).alias("variance"), "n_chunks", "length", F.col("pred").cast("bigint").alias("pred"),
        F.col("vote").cast("bigint").alias("vote"),
    )


@catalog.add("a33_mean_coordinates", """
WITH e AS (SELECT label * 10 + vec_id % 10 AS seq_id, vec_id, generate_subscripts(embedding, 1) - 1 AS i,
    CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
xy AS (SELECT seq_id, vec_id, sum(v) FILTER (i % 2 = 0) AS x, sum(v) FILTER (i % 2 = 1) AS y FROM e GROUP BY seq_id, vec_id)
SELECT seq_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM xy GROUP BY seq_id""")
def mean_coordinates(spark, sf):
    def half(odd):
        kept = F.filter(F.col("embedding").cast("array<double>"), lambda x, i: i % 2 == odd)
        return F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x)

    # The display coordinates of a vector: the sums of its elements in even and in odd places.
    points = table(spark, sf, "embeddings").select(
        (F.col("label") * 10 + F.col("vec_id") % 10).alias("seq_id"), F.array(half(0), half(1)).alias("xy")
    )
    means = aggregate.mean_outputs(points, ["seq_id"], "xy")
    return means.select("seq_id", F.round(F.get("xy", 0), 6).alias("x"), F.round(F.get("xy", 1), 6).alias("y"))


@catalog.add("x06_group_pooling", """
WITH e AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT label, pos, round(avg(x), 6) AS mean, round(max(x), 6) AS max FROM e GROUP BY label, pos""")
def group_pooling(spark, sf):
    rows = table(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    pools = [
        aggregate.long_outputs(aggregate.mean_outputs(rows, ["label"], "v", pool=pool), ["label"], "v").select(
            "label", F.col("class").cast("bigint").alias("pos"), F.round("p", 6).alias(pool)
        )
        for pool in ("mean", "max")
    ]
    return pools[0].join(pools[1], ["label", "pos"])
