"""User models over windows, inference summaries and confidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.aggregating import MEANS_CTE, probability_columns, scored
from catalog.common import LEVELS, SEQS_CTE, Catalog, class_taxa, sequences
from catalog.windowing import starts_sql
from cladeflow.operators import aggregate, taxonomy
from cladeflow.plans import confidence, inference

catalog = Catalog()

WIDTH, STEP, CLASSES = 512, 256, 3


def linear_model():
    """A fixed linear model: class values from the residue composition of a window."""

    def load():
        import numpy as np

        # Residue codes of A, C, T, N, and their weight in each class.
        codes, weights = (0, 1, 9, 8), np.array([[3.0, 1.0, 0.5], [0.0, 4.0, 1.0], [2.0, 0.0, 3.0], [1.0, 1.0, 1.0]])

        def model(matrix):
            counts = np.stack([(matrix == c).sum(axis=1) for c in codes], axis=1)
            return counts @ weights / matrix.shape[1]

        return model

    return load


SCORED_CTE = f"""{SEQS_CTE}, w AS (SELECT seq_id, genome_id, s, rpad(substr(seq, CAST(s + 1 AS BIGINT), {WIDTH}), {WIDTH}, 'N') AS win
  FROM seqs, {starts_sql(STEP, 1)}),
k AS (SELECT seq_id, genome_id, s, len(win) - len(replace(win, 'A', '')) AS a, len(win) - len(replace(win, 'C', '')) AS c,
  len(win) - len(replace(win, 'T', '')) AS t, len(win) - len(replace(win, 'N', '')) AS n FROM w),
z AS (SELECT seq_id, genome_id, s, exp((3.0 * a + 2.0 * t + n) / {WIDTH}) AS z0, exp((a + 4.0 * c + n) / {WIDTH}) AS z1,
  exp((0.5 * a + c + 3.0 * t + n) / {WIDTH}) AS z2 FROM k),
p AS (SELECT seq_id, genome_id, s, z0 / (z0 + z1 + z2) AS p0, z1 / (z0 + z1 + z2) AS p1, z2 / (z0 + z1 + z2) AS p2 FROM z)"""


@catalog.add("x01_score_windows", f"""
WITH {SCORED_CTE} SELECT genome_id, seq_id, count(*) AS n_chunks, round(avg(p0), 6) AS p0, round(avg(p1), 6) AS p1, round(avg(p2), 6) AS p2
FROM p GROUP BY genome_id, seq_id""")
def score_windows(spark, sf):
    seqs = sequences(spark, sf).select("seq_id", "genome_id", "seq")
    outputs = inference.infer_sequences(seqs, "seq", WIDTH, STEP, linear_model(), CLASSES)
    means = aggregate.mean_outputs(outputs, ["genome_id", "seq_id"], "p")
    return means.select("genome_id", "seq_id", "n_chunks", *[F.round(F.get("p", i), 6).alias(f"p{i}") for i in range(CLASSES)])


@catalog.add("x08_classify_sequences", f"""
WITH {SCORED_CTE}, m AS (SELECT genome_id, seq_id, avg(p0) AS a, avg(p1) AS b, avg(p2) AS c FROM p GROUP BY genome_id, seq_id),
x AS (SELECT *, greatest(a, b, c) AS score, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS pred FROM m)
SELECT genome_id, seq_id, round(score, 6) AS score, 'f' || pred // 2 AS family, 's' || pred AS species FROM x""")
def classify_sequences(spark, sf):
    """From residues to a table of classified sequences: windows, model, means, taxa."""
    seqs = sequences(spark, sf).select("seq_id", "genome_id", "seq")
    outputs = inference.infer_sequences(seqs, "seq", WIDTH, STEP, linear_model(), CLASSES)
    species = spark.range(CLASSES).select(
        F.col("id").cast("int").alias("leaf"),
        F.concat(F.lit("f"), F.expr("id div 2").cast("string")).alias("family"),
        F.concat(F.lit("s"), F.col("id").cast("string")).alias("species"),
    )
    found = inference.classify_sequences(outputs, species, "leaf", ["family", "species"], "genome_id", "seq_id")
    return found.withColumn("score", F.round("score", 6))


SUMMARY_SQL = f"""
WITH {MEANS_CTE}, g AS (SELECT seq_id % 4 AS genome_id, level, taxon, p, n FROM
  (SELECT seq_id, class, sum(p) AS p, count(*) AS n FROM probs GROUP BY ALL) JOIN level_map USING (class)),
gm AS (SELECT genome_id, level, taxon, sum(p) AS p FROM g GROUP BY ALL),
gn AS (SELECT seq_id % 4 AS genome_id, count(*) AS n FROM chunks GROUP BY 1),
gr AS (SELECT genome_id, level, taxon, p / n AS p FROM gm JOIN gn USING (genome_id)),
r AS (SELECT 'sequence' AS kind, seq_id AS id, level, taxon, p FROM rolled UNION ALL SELECT 'genome', genome_id, level, taxon, p FROM gr),
k AS (SELECT *, row_number() OVER (PARTITION BY kind, id, level ORDER BY p DESC, taxon) AS rn FROM r),
s AS (SELECT seq_id, CAST(sum(length) AS BIGINT) AS length FROM chunks GROUP BY seq_id),
o AS (SELECT seq_id % 4 AS genome_id, length, sum(length) OVER w AS cum, sum(length) OVER (PARTITION BY seq_id % 4) AS total
  FROM s WINDOW w AS (PARTITION BY seq_id % 4 ORDER BY length DESC, seq_id ROWS UNBOUNDED PRECEDING)),
a AS (SELECT genome_id, sum(length) AS length, count(*) AS n_ctgs, max(length) FILTER (cum > total * 0.5) AS n50 FROM o GROUP BY genome_id),
size AS (SELECT 'sequence' AS kind, seq_id AS id, length, NULL AS n_ctgs, NULL AS n50_len FROM s
  UNION ALL SELECT 'genome', genome_id, CAST(length AS BIGINT), n_ctgs, n50 FROM a)
SELECT kind, id, level, max(taxon) FILTER (rn = 1) AS pred, round(max(p) FILTER (rn = 1), 6) AS p1, round(max(p) FILTER (rn = 2), 6) AS p2,
  any_value(length) AS length, any_value(n_ctgs) AS n_ctgs, any_value(n50_len) AS n50_len FROM k JOIN size USING (kind, id) GROUP BY kind, id, level"""


@catalog.add("x02_infer_summary", SUMMARY_SQL)
def infer_summary(spark, sf):
    rows = scored(spark, sf).withColumn("genome_id", F.col("seq_id") % 4)
    lengths = rows.groupBy("seq_id", "genome_id").agg(F.sum("length").cast("bigint").alias("length"))
    seqs, genomes = inference.infer_summary(rows, lengths, class_taxa(spark, sf), "species", LEVELS)
    columns = ["level", "pred", *probability_columns(2), "length"]
    a = seqs.select(F.lit("sequence").alias("kind"), F.col("seq_id").alias("id"), *columns)
    b = genomes.select(F.lit("genome").alias("kind"), F.col("genome_id").alias("id"), *columns, "n_ctgs", "n50_len")
    return a.unionByName(b, allowMissingColumns=True)


@catalog.add("x03_confidence")
def confidence_model(spark, sf):
    rows = scored(spark, sf)
    tops = aggregate.top_classes(rows, ["chunk_id", "label", "length"], "p", 2)
    data = confidence.confidence_features(tops).withColumn("right", (F.col("pred") == F.col("label")).cast("int"))
    model = confidence.fit_confidence(data, ["length"], "right")
    return confidence.confidence_metrics(confidence.apply_confidence(model, data), "right")


@catalog.add("x04_rf_report")
def rf_report(spark, sf):
    rows = scored(spark, sf)
    return confidence.rf_report(rows.where("chunk_id % 2 = 0"), rows.where("chunk_id % 2 = 1"), "p", "label", "seq_id")
