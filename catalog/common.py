"""Stand-ins over the given tables: DNA text, accessions, window outputs, hits, distances and trees.

Every derivation exists twice, as DataFrame code and as SQL text, so that both engines start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cladeflow import spread
from cladeflow.operators.ordering import MULTIPLIERS, PRIME, ROUNDS

# The letter map that turns prose into DNA. Every character becomes one residue: other characters are N.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TO_DNA = "ACGTACGTACGTACGTACGTACGTAN"


class Catalog:
    """Collects queries and their SQL by name."""

    def __init__(self):
        self.queries = {}
        self.oracles = {}

    def add(self, name: str, sql: str | None = None):
        def register(fn):
            self.queries[name] = fn
            if sql is not None:
                self.oracles[name] = sql
            return fn

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def permuted_sql(i: str, n: str, digest: str) -> str:
    """The place of a number in a permutation that a digest names: rounds over a list, with the state in a struct."""
    a, b, c = MULTIPLIERS
    first, second = (f"CAST('0x' || substr({digest}, {at}, 7) AS BIGINT)" for at in (1, 9))
    zero = "CAST(0 AS BIGINT)"
    k = f"((t.f + q.r * t.s) % {PRIME} * {a} % {PRIME} * {PRIME + 2} + (t.s + q.r * t.f) % {PRIME} * {b} % {PRIME}) % t.n"
    mixed = f"xor(greatest(p.x, p.o) % {PRIME}, (t.f + q.r * {c}) % {PRIME}) * {a} % {PRIME + 1}"
    drawn = f"list_transform([{mixed}], lambda m: xor(m, m >> 13) * {b} % {PRIME + 1})[1]"
    moved = f"list_transform([{drawn}], lambda d: CASE WHEN (d >> 16) & 1 = 1 THEN p.o ELSE p.x END)[1]"
    step = f"list_transform([{{'x': t.x, 'o': (({k} - t.x) % t.n + t.n) % t.n}}], lambda p: {moved})[1]"
    rounds = f"list_transform(range({ROUNDS}), lambda q: {{'x': {zero}, 'n': {zero}, 'f': {zero}, 's': {zero}, 'r': q}})"
    start = f"{{'x': CAST({i} AS BIGINT), 'n': CAST({n} AS BIGINT), 'f': {first}, 's': {second}, 'r': {zero}}}"
    return f"list_reduce(list_prepend({start}, {rounds}), lambda t, q: {{'x': {step}, 'n': t.n, 'f': t.f, 's': t.s, 'r': q.r}}).x"


# -- sequences ---------------------------------------------------------------------------------------------------

LETTERS_SQL = f"regexp_replace(translate(text, '{LETTERS.lower()}', '{LETTERS}'), '[^A-Z]', 'N', 'g')"
DNA_SQL = f"translate({LETTERS_SQL}, '{LETTERS}', '{TO_DNA}')"
SEQS_CTE = f"seqs AS (SELECT doc_id AS seq_id, source AS genome_id, lang AS label, {DNA_SQL} AS seq FROM documents)"


def documents(spark, sf_dir) -> DataFrame:
    """The texts, over all cores also when they lie in one small file."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), "doc_id")


def letters():
    return F.regexp_replace(F.translate("text", LETTERS.lower(), LETTERS), "[^A-Z]", "N")


def sequences(spark, sf_dir) -> DataFrame:
    """`seq_id, genome_id, label, seq` out of the documents."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("seq_id"),
        F.col("source").alias("genome_id"),
        F.col("lang").alias("label"),
        F.translate(letters(), LETTERS, TO_DNA).alias("seq"),
    )


# -- genome metadata ---------------------------------------------------------------------------------------------

META_CTE = """meta AS (
  SELECT p_partkey,
         (CASE WHEN p_partkey % 2 = 0 THEN 'RS_GCF_' WHEN p_partkey % 7 = 0 THEN 'U_GUT_' ELSE 'GB_GCA_' END)
           || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || '.' || CAST(1 + p_size % 3 AS VARCHAR) AS accession,
         p_type, p_brand, p_name, p_size AS contig_count, p_retailprice
  FROM part)"""


def metadata(spark, sf_dir) -> DataFrame:
    key = F.col("p_partkey")
    tag = F.when(key % 2 == 0, "RS_GCF_").when(key % 7 == 0, "U_GUT_").otherwise("GB_GCA_")
    version = (1 + F.col("p_size") % 3).cast("string")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(tag, F.lpad(key.cast("string"), 9, "0"), F.lit("."), version).alias("accession"),
        "p_type",
        "p_brand",
        "p_name",
        F.col("p_size").alias("contig_count"),
        "p_retailprice",
    )


REPS_CTE = META_CTE + """,
reps AS (SELECT p_brand, min(p_partkey) AS rep FROM meta GROUP BY p_brand),
members AS (SELECT m.p_partkey AS accession, r.rep, m.contig_count, m.p_brand
            FROM meta m JOIN reps r ON m.p_brand = r.p_brand)"""


def members(spark, sf_dir) -> DataFrame:
    """`accession, rep, contig_count, p_brand`: each brand is represented by its smallest key."""
    meta = metadata(spark, sf_dir)
    reps = meta.groupBy("p_brand").agg(F.min("p_partkey").alias("rep"))
    return meta.join(reps, "p_brand").select(F.col("p_partkey").alias("accession"), "rep", "contig_count", "p_brand")


LINEAGE_CTE = """lineage AS (
  SELECT s_suppkey, r_name, n_name, s_name,
         'd__' || r_name || ';p__' || n_name || ';c__C' || CAST(s_nationkey % 5 AS VARCHAR)
           || ';o__O' || CAST(s_suppkey % 7 AS VARCHAR) || ';f__F' || CAST(s_suppkey % 11 AS VARCHAR)
           || ';g__G' || CAST(s_suppkey % 13 AS VARCHAR) || ';s__G' || CAST(s_suppkey % 13 AS VARCHAR)
           || ' sp' || CAST(s_suppkey AS VARCHAR) AS lineage
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def lineage(spark, sf_dir) -> DataFrame:
    """`s_suppkey, r_name, n_name, s_name, lineage` of the suppliers."""
    places = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    key = F.col("s_suppkey")
    text = F.concat(
        F.lit("d__"), "r_name", F.lit(";p__"), "n_name",
        F.lit(";c__C"), (F.col("s_nationkey") % 5).cast("string"),
        F.lit(";o__O"), (key % 7).cast("string"),
        F.lit(";f__F"), (key % 11).cast("string"),
        F.lit(";g__G"), (key % 13).cast("string"),
        F.lit(";s__G"), (key % 13).cast("string"), F.lit(" sp"), key.cast("string"),
    )
    joined = table(spark, sf_dir, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select("s_suppkey", "r_name", "n_name", "s_name", text.alias("lineage"))


# -- window outputs ----------------------------------------------------------------------------------------------

CHUNKS_CTE = """chunks AS (
  SELECT vec_id AS chunk_id, label * 10 + vec_id % 10 AS seq_id, label, vec_id % 5 + 100 AS length,
         [CAST(x AS DOUBLE) for x in embedding] AS logits
  FROM embeddings),
raw_long AS (SELECT chunk_id, seq_id, label, length, generate_subscripts(logits, 1) - 1 AS class, unnest(logits) AS z
             FROM chunks),
exp_long AS (SELECT *, exp(z - max(z) OVER (PARTITION BY chunk_id)) AS e FROM raw_long),
probs AS (SELECT chunk_id, seq_id, label, length, class, e / sum(e) OVER (PARTITION BY chunk_id) AS p FROM exp_long)"""


def chunks(spark, sf_dir) -> DataFrame:
    """`chunk_id, seq_id, label, length, logits`: the elements of each vector as the logits of as many classes."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"),
        (F.col("label") * 10 + F.col("vec_id") % 10).alias("seq_id"),
        "label",
        (F.col("vec_id") % 5 + 100).alias("length"),
        F.col("embedding").cast("array<double>").alias("logits"),
    )


TAXA_CTE = """taxa AS (
  SELECT species, species // 2 AS genus, species // 4 AS family
  FROM (SELECT DISTINCT CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS species FROM embeddings))"""

LEVELS = ("family", "genus", "species")


def class_taxa(spark, sf_dir) -> DataFrame:
    """`species, genus, family` codes of the classes, one for each element of the vectors: a strict hierarchy."""
    classes = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("species", "_")).select("species").distinct()
    return classes.select(
        "species",
        F.expr("species div 2").cast("int").alias("genus"),
        F.expr("species div 4").cast("int").alias("family"),
    )


# -- alignment hits ----------------------------------------------------------------------------------------------

TAX_CTE = """tax AS (
  SELECT s_suppkey AS subject, r_name AS domain, n_name AS phylum, s_name AS species
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 7 <> 0)"""
HITS_CTE = """hits AS (SELECT l_orderkey AS orf, l_suppkey AS subject,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS bitscore FROM lineitem)"""


def subject_taxonomy(spark, sf_dir) -> DataFrame:
    """`subject, domain, phylum, species`; every seventh subject is unknown."""
    return lineage(spark, sf_dir).where("s_suppkey % 7 <> 0").select(
        F.col("s_suppkey").alias("subject"),
        F.col("r_name").alias("domain"),
        F.col("n_name").alias("phylum"),
        F.col("s_name").alias("species"),
    )


def hits(spark, sf_dir) -> DataFrame:
    """`orf, subject, bitscore`; scores are whole numbers, so that their means do not depend on the order of addition."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("orf"),
        F.col("l_suppkey").alias("subject"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("bitscore"),
    )


# -- distances ---------------------------------------------------------------------------------------------------

DIST_CTE = """dist AS (
  SELECT least(l_suppkey, l_partkey % 97) AS a, greatest(l_suppkey, l_partkey % 97) AS b,
         sum(CAST(l_quantity AS BIGINT)) / CAST(count(*) AS DOUBLE) AS d,
         sum(CAST(round(l_discount * 100) AS BIGINT)) / CAST(count(*) AS DOUBLE) AS d2
  FROM lineitem WHERE l_suppkey <> l_partkey % 97 GROUP BY 1, 2)"""


def distances(spark, sf_dir) -> DataFrame:
    """`a, b, d, d2` with `a < b`: two values on the pairs of nodes that occur together on an order line."""
    other = F.col("l_partkey") % 97
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_suppkey") != other)
    pairs = lines.groupBy(F.least("l_suppkey", other).alias("a"), F.greatest("l_suppkey", other).alias("b"))
    n = F.count(F.lit(1)).cast("double")
    return pairs.agg(
        (F.sum(F.col("l_quantity").cast("bigint")) / n).alias("d"),
        (F.sum(F.round(F.col("l_discount") * 100).cast("bigint")) / n).alias("d2"),
    )


# -- tree --------------------------------------------------------------------------------------------------------

EDGES_CTE = """edges AS (
  SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS child, 'root' AS parent, CAST(1 + r_regionkey AS DOUBLE) AS length, false AS is_tip
  FROM region
  UNION ALL
  SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR), CAST(1 + n_nationkey % 4 AS DOUBLE), false
  FROM nation
  UNION ALL
  SELECT 'c' || CAST(c_custkey AS VARCHAR), 'n' || CAST(c_nationkey AS VARCHAR), abs(c_acctbal) / CAST(1000 AS DOUBLE), true
  FROM customer)"""
CLOSURE_CTE = EDGES_CTE + """,
up AS (
  SELECT child AS node, child AS ancestor, 0 AS hops, CAST(0 AS DOUBLE) AS dist FROM edges
  UNION ALL SELECT u.node, e.parent, u.hops + 1, u.dist + e.length FROM up u JOIN edges e ON u.ancestor = e.child),
closure AS (SELECT * FROM up UNION ALL SELECT 'root', 'root', 0, 0)"""


def tree_edges(spark, sf_dir) -> DataFrame:
    """`child, parent, length, is_tip`: root, regions, nations and customers."""

    def level(name, prefix, key, parent, length, is_tip):
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(prefix), F.col(key).cast("string")).alias("child"),
            parent.alias("parent"),
            length.cast("double").alias("length"),
            F.lit(is_tip).alias("is_tip"),
        )

    regions = level("region", "r", "r_regionkey", F.lit("root"), 1.0 + F.col("r_regionkey"), False)
    under_region = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    nations = level("nation", "n", "n_nationkey", under_region, 1.0 + F.col("n_nationkey") % 4, False)
    under_nation = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    tips = level("customer", "c", "c_custkey", under_nation, F.abs("c_acctbal") / 1000.0, True)
    return regions.unionByName(nations).unionByName(tips)
