"""Windows over sequences, splits, sampling orders and k-mer profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import DNA_SQL, SEQS_CTE, Catalog, permuted_sql, sequences, table
from catalog.scalar import CANONICAL_CTE, KMERS_CTE
from cladeflow import cut_lineage
from cladeflow.functions import sequence as S
from cladeflow.operators import aggregate, containment, ordering, windows

catalog = Catalog()

LENS_CTE = f"lens AS (SELECT doc_id AS seq_id, source AS genome_id, lang AS label, length({DNA_SQL}) AS L FROM documents)"


def starts_sql(step, min_len):
    return f"unnest(range(0, greatest(length(seq) - {min_len}, -1) + 1, {step})) AS t(s)"


def lengths(spark, sf):
    """Lengths of the sequences."""
    return sequences(spark, sf).select("seq_id", "genome_id", "label", F.length("seq").cast("bigint").alias("L"))


def settled_lengths(spark, sf):
    """The lengths written once, for operators that read their input several times: the texts are then read once."""
    return cut_lineage(lengths(spark, sf))


@catalog.add("c01_window_sequences", f"""
WITH {SEQS_CTE} SELECT seq_id, genome_id, label, s AS start, least(s + 1024, length(seq)) AS "end",
  md5(substr(seq, CAST(s + 1 AS BIGINT), 1024)) AS digest FROM seqs, {starts_sql(128, 100)}""")
def window_sequences(spark, sf):
    cuts = windows.window_sequences(sequences(spark, sf), "seq", 1024, 128)
    return cuts.select("seq_id", "genome_id", "label", "start", "end", F.md5("window").alias("digest"))


@catalog.add("c02_window_counts", f"""
WITH {SEQS_CTE}, w AS (SELECT seq_id, count(*) AS n FROM seqs, {starts_sql(128, 100)} GROUP BY seq_id)
SELECT seq_id, coalesce(n, 0) AS n_windows, round(coalesce(n, 0) / ceil(length(seq) / 128), 6) AS kept
FROM seqs LEFT JOIN w USING (seq_id) WHERE length(seq) > 0""")
def window_counts(spark, sf):
    counted = windows.window_counts(lengths(spark, sf).where("L > 0"), "L", 1024, 128)
    return counted.select("seq_id", "n_windows", F.round("kept", 6).alias("kept"))


@catalog.add("c03_both_strands", f"""
WITH {SEQS_CTE}, st AS (SELECT seq_id, '+' AS strand, seq FROM seqs
  UNION ALL SELECT seq_id, '-', reverse(translate(seq, 'ACGT', 'TGCA')) FROM seqs)
SELECT seq_id, strand, s AS start, md5(substr(seq, CAST(s + 1 AS BIGINT), 1000)) AS digest FROM st, {starts_sql(500, 100)}
""")
def both_strands(spark, sf):
    doubled = windows.both_strands(sequences(spark, sf), "seq")
    cuts = windows.window_sequences(doubled, "seq", 1000, 500)
    return cuts.select("seq_id", "strand", "start", F.md5("window").alias("digest"))


@catalog.add("c04_window_ids", f"""
WITH {SEQS_CTE} SELECT genome_id || '|' || s || '-' || least(s + 1000, length(seq)) AS window_id, seq_id,
  md5(substr(seq, CAST(s + 1 AS BIGINT), 1000)) AS digest FROM seqs, {starts_sql(1000, 100)}""")
def window_ids(spark, sf):
    cuts = windows.window_ids(windows.window_sequences(sequences(spark, sf), "seq", 1000), "genome_id")
    return cuts.select("window_id", "seq_id", F.md5("window").alias("digest"))


@catalog.add("c05_window_for_inference", f"""
WITH {SEQS_CTE} SELECT seq_id, s AS start, s // 512 // 16 AS batch,
  md5(rpad(substr(seq, CAST(s + 1 AS BIGINT), 1024), 1024, 'N')) AS digest FROM seqs, {starts_sql(512, 1)}""")
def window_for_inference(spark, sf):
    cuts = windows.window_for_inference(sequences(spark, sf), "seq", 1024, 512)
    batched = windows.batch_ids(cuts, "seq_id", 512, 16)
    return batched.select("seq_id", "start", "batch", F.md5("window").alias("digest"))


SPLIT_SQL = f"""
WITH {SEQS_CTE}, w AS (SELECT seq_id, s, count(*) OVER (PARTITION BY seq_id) AS n, md5('7:' || seq_id) AS digest
  FROM seqs, {starts_sql(128, 100)}),
p AS (SELECT seq_id, s, n, {permuted_sql("s // 128", "n", "digest")} AS perm FROM w)
SELECT seq_id, s AS start, perm, CASE WHEN perm < n - round_even(0.2 * n, 0) THEN 'train' ELSE 'val' END AS split FROM p"""


@catalog.add("c06_split_windows", SPLIT_SQL)
def split_windows(spark, sf):
    split = windows.split_windows(lengths(spark, sf), "seq_id", "L", 1024, 128, seed=7)
    return split.select("seq_id", "start", F.col("perm").cast("bigint").alias("perm"), "split")


@catalog.add("c07_dataset_stats", f"""
WITH {LENS_CTE}, n AS (SELECT *, CASE WHEN L >= 100 THEN (L - 100) // 128 + 1 ELSE 0 END AS n FROM lens)
SELECT count(DISTINCT CASE WHEN n > 0 THEN genome_id END) AS n_taxa, count(*) AS n_seqs,
  CAST(2 * sum(n) AS BIGINT) AS n_windows, CAST(2 * sum(CAST(ceil(L / 128) AS BIGINT) - n) AS BIGINT) AS n_discarded,
  CAST(2 * sum(n - CAST(round_even(0.2 * n, 0) AS BIGINT)) AS BIGINT) AS n_train,
  CAST(2 * sum(CAST(round_even(0.2 * n, 0) AS BIGINT)) AS BIGINT) AS n_val FROM n""")
def dataset_stats(spark, sf):
    return windows.dataset_stats(lengths(spark, sf), "genome_id", "L", 1024, 128, both=True)


@catalog.add("c08_epoch_order", f"""
WITH r AS (SELECT o_orderkey, CAST(o_orderkey % 7 AS INTEGER) AS part, row_number() OVER (PARTITION BY o_orderkey % 7 ORDER BY o_orderkey) - 1 AS i,
  count(*) OVER (PARTITION BY o_orderkey % 7) AS n FROM orders),
v AS (SELECT part, sum(count(*)) OVER (ORDER BY md5('11:' || part)) - count(*) AS start FROM r GROUP BY part)
SELECT o_orderkey, r.part, CAST(start + {permuted_sql("i", "n", "md5('11:' || r.part)")} AS BIGINT) AS position FROM r JOIN v ON r.part = v.part""")
def epoch_order(spark, sf):
    return ordering.epoch_order(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 7, 11)


@catalog.add("c09_sample_rows", f"""
WITH {LENS_CTE}, n AS (SELECT seq_id, L FROM lens ORDER BY md5('3:' || seq_id), seq_id LIMIT 100)
SELECT 'rows' AS kind, seq_id, L AS length FROM n
UNION ALL SELECT 'share', seq_id, L FROM lens
  WHERE CAST('0x' || substr(md5('3:' || seq_id), 1, 8) AS BIGINT) < CAST(floor(0.25 * 4294967296) AS BIGINT)""")
def sample_rows(spark, sf):
    rows = lengths(spark, sf).select("seq_id", F.col("L").alias("length"))
    n = ordering.sample_rows(rows, "seq_id", 100, 3).select(F.lit("rows").alias("kind"), "seq_id", "length")
    share = ordering.sample_fraction(rows, "seq_id", 0.25, 3).select(F.lit("share").alias("kind"), "seq_id", "length")
    return n.unionByName(share)


@catalog.add("c10_verify_windows", f"""
WITH {SEQS_CTE}, w AS (SELECT seq_id, s, rpad(substr(seq, CAST(s + 1 AS BIGINT), 1000), 1000, 'N') AS win
  FROM seqs, {starts_sql(1000, 100)}), b AS (
  SELECT seq_id, s, rtrim(CASE WHEN s % 3000 = 0 THEN reverse(translate(win, 'ACGT', 'TGCA')) ELSE win END, 'N') AS bare
  FROM w)
SELECT seq_id, s AS start, contains(seq, bare) AS hit, contains(seq, reverse(translate(bare, 'ACGT', 'TGCA'))) AS rc_hit
FROM b JOIN seqs USING (seq_id)""")
def verify_windows(spark, sf):
    seqs = sequences(spark, sf)
    cuts = windows.window_sequences(seqs, "seq", 1000)
    padded = cuts.withColumn("window", S.pad_seq(F.col("window"), 1000))
    turned = F.when(F.col("start") % 3000 == 0, S.revcomp(F.col("window"))).otherwise(F.col("window"))
    checked = containment.verify_windows(padded.withColumn("window", turned), seqs, "seq_id", "seq")
    return checked.select("seq_id", "start", "hit", "rc_hit")


@catalog.add("a17_tetramer_freq", f"""
WITH {KMERS_CTE}, c AS (SELECT genome_id, least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n
  FROM kmers GROUP BY 1, 2), t AS (SELECT genome_id, sum(n) AS every,
    sum(n) FILTER (NOT contains(kmer, 'N')) AS kept FROM c GROUP BY genome_id)
SELECT genome_id, kmer, round(n / kept, 6) AS freq, round(n / every, 6) AS freq_all
FROM c JOIN t USING (genome_id) WHERE NOT contains(kmer, 'N')""")
def tetramer_freq(spark, sf):
    both = aggregate.tetramer_freq(sequences(spark, sf), ["genome_id"], "seq", "both")
    return both.select("genome_id", "kmer", F.round("freq", 6).alias("freq"), F.round("freq_all", 6).alias("freq_all"))


@catalog.add("x07_window_udtf", f"""
WITH {SEQS_CTE} SELECT seq_id, s AS start, least(s + 1024, length(seq)) AS "end",
  md5(substr(seq, CAST(s + 1 AS BIGINT), 1024)) AS digest FROM seqs, {starts_sql(512, 100)}""")
def window_udtf(spark, sf):
    from cladeflow.functions.udtf import register

    register(spark)
    seqs = sequences(spark, sf)
    return spark.sql(
        "SELECT s.seq_id, w.start, w.end, md5(w.window) AS digest FROM {seqs} s, "
        "LATERAL cut_windows(s.seq, 1024, 512, 100) w",
        seqs=seqs,
    )


@catalog.add("w01_cum_offsets", f"""
WITH {LENS_CTE} SELECT seq_id, CAST(sum(L) OVER (ORDER BY seq_id) AS BIGINT) AS end_offset,
  CAST(sum(L) OVER (PARTITION BY label ORDER BY seq_id) AS BIGINT) AS label_offset FROM lens""")
def cum_offsets(spark, sf):
    rows = settled_lengths(spark, sf).select("seq_id", "label", "L")
    order, buckets = [F.col("seq_id")], ordering.id_buckets("seq_id")
    whole = ordering.cum_offsets(rows, "L", buckets, order)
    by_label = ordering.cum_offsets(rows, "L", buckets, order, keys=["label"])
    named = by_label.select("seq_id", F.col("end_offset").alias("label_offset"))
    return whole.select("seq_id", "end_offset").join(named, "seq_id")


@catalog.add("w05_even_split", """
SELECT doc_id, CAST(ntile(7) OVER (ORDER BY doc_id) - 1 AS INTEGER) AS part FROM documents""")
def even_split(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return ordering.even_split(docs, 7, ordering.id_buckets("doc_id"), [F.col("doc_id")])


@catalog.add("w10_balanced_buckets", f"""
WITH {LENS_CTE}, r AS (SELECT seq_id, L, row_number() OVER (ORDER BY L DESC, seq_id) - 1 AS k FROM lens),
b AS (SELECT seq_id, L, CAST(CASE WHEN (k // 8) % 2 = 0 THEN k % 8 ELSE 7 - k % 8 END AS INTEGER) AS bucket FROM r),
g AS (SELECT genome_id, row_number() OVER (ORDER BY sum(L) DESC, genome_id) - 1 AS k, sum(L) AS L FROM lens GROUP BY 1)
SELECT 'record' AS unit, CAST(seq_id AS VARCHAR) AS id, bucket FROM b
UNION ALL SELECT 'genome', genome_id, CAST(CASE WHEN (k // 4) % 2 = 0 THEN k % 4 ELSE 3 - k % 4 END AS INTEGER) FROM g""")
def balanced_buckets(spark, sf):
    rows = settled_lengths(spark, sf)
    records = ordering.balanced_buckets(rows, "seq_id", "L", 8)
    genomes = ordering.balanced_buckets(aggregate.genome_lengths(rows, "genome_id", "L"), "genome_id", "length", 4)
    out = records.select(F.lit("record").alias("unit"), F.col("seq_id").cast("string").alias("id"), "bucket")
    return out.unionByName(genomes.select(F.lit("genome").alias("unit"), F.col("genome_id").alias("id"), "bucket"))


@catalog.add("w10_balanced_local")
def balanced_local(spark, sf):
    rows = ordering.balanced_buckets(lengths(spark, sf), "seq_id", "L", 8, mode="local")
    return ordering.balance_report(rows, "L", 8)


@catalog.add("j13_locate", f"""
WITH {LENS_CTE}, o AS (SELECT seq_id, L, sum(L) OVER (ORDER BY seq_id) AS e FROM lens),
q AS (SELECT o_orderkey, (o_orderkey * 7919) % (SELECT sum(L) FROM lens) AS pos FROM orders)
SELECT o_orderkey, seq_id, CAST(pos - (e - L) AS BIGINT) AS inside FROM q JOIN o ON pos >= e - L AND pos < e""")
def locate(spark, sf):
    from cladeflow.operators import joins

    rows = settled_lengths(spark, sf).select("seq_id", "L")
    spans = ordering.cum_offsets(rows, "L", ordering.id_buckets("seq_id"), [F.col("seq_id")])
    total = rows.agg(F.sum("L")).scalar()
    points = table(spark, sf, "orders").select("o_orderkey", ((F.col("o_orderkey") * 7919) % total).alias("at"))
    found = joins.locate(points, "at", spans, "start_offset", "end_offset", bin_size=4096)
    return found.select("o_orderkey", "seq_id", (F.col("at") - F.col("start_offset")).alias("inside"))
