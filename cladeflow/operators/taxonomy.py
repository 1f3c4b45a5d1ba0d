"""Genomes, taxa and ranks: label resolution, class roll-up, hierarchy checks and balanced sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from cladeflow.functions import names, vectors as V
from cladeflow.operators import aggregate, ordering

# Lookup tables are joined without a broadcast hint: the optimiser broadcasts a side whose measured size is small and
# shuffles it otherwise, with skewed partitions split at run time.


def attach_rep(genomes: DataFrame, taxa: DataFrame, rep: str) -> DataFrame:
    """Genomes with the row of their representative taxon; both tables name it `rep`."""
    return genomes.join(taxa, rep)


def missing_reps(genomes: DataFrame, taxa: DataFrame, rep: str) -> DataFrame:
    """Genomes whose representative has no taxon."""
    return genomes.join(taxa, rep, "left_anti")


def resolve_labels(seqs: DataFrame, genomes: DataFrame, taxa: DataFrame, genome: str, taxon: str, ranks: Sequence[str]) -> DataFrame:
    """Sequence → genome → taxon: adds the asked rank columns, or the array of them in `labels` when several."""
    joined = seqs.join(genomes.select(genome, taxon), genome).join(taxa.select(taxon, *ranks), taxon)
    if len(ranks) > 1:
        joined = joined.withColumn("labels", F.array(*[F.col(r).cast("string") for r in ranks]))
    return joined


def attach_embeddings(taxa: DataFrame, vectors: DataFrame, key: str, name: str, vec: str, keep_unmatched: bool = False) -> DataFrame:
    """Vectors by taxon, whatever source tag either name carries. `keep_unmatched` overwrites where there is a match only."""
    found = vectors.select(names.strip_tag(F.col(name)).alias("_name"), F.col(vec).alias("_vec"))
    keyed = taxa.withColumn("_name", names.strip_tag(F.col(key)))
    joined = keyed.join(found, "_name", "left" if keep_unmatched else "inner").drop("_name")
    if keep_unmatched and vec in taxa.columns:
        return joined.withColumn(vec, F.coalesce("_vec", vec)).drop("_vec")
    return joined.drop(vec).withColumnRenamed("_vec", vec)


def restrict_to_tree(meta: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Metadata rows that are tips of the tree."""
    tips = edges.where("is_tip").select(F.col("child").alias(key))
    return meta.join(tips, key, "left_semi")


def match_files(accessions: DataFrame, listing: DataFrame, key: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(accession with its first path in name order, accessions without a file)."""
    found = listing.withColumn(key, names.path_accession(F.col(path)))
    first = found.groupBy(key).agg(F.min(path).alias(path))
    asked = accessions.select(key).distinct()
    return asked.join(first, key), asked.join(first, key, "left_anti")


# -- classes -----------------------------------------------------------------------------------------------------


def level_map(taxa: DataFrame, leaf: str, levels: Sequence[str]) -> DataFrame:
    """`class, level, taxon`: every ancestor code of each leaf class, itself included."""
    pairs = F.array(*[F.struct(F.lit(r).alias("level"), F.col(r).alias("taxon")) for r in levels])
    long = taxa.select(F.col(leaf).alias("class"), F.explode(pairs).alias("_p")).distinct()
    return long.select("class", F.col("_p.level").alias("level"), F.col("_p.taxon").alias("taxon"))


def roll_up(df: DataFrame, keys: Sequence[str], vec: str, taxa: DataFrame, leaf: str, levels: Sequence[str]) -> DataFrame:
    """Class probabilities summed to every rank in one pass: `keys, level, taxon, p`.

    The roll-up is linear, so means per sequence can be taken before it, on short vectors.
    """
    long = aggregate.long_outputs(df, keys, vec)
    rolled = long.join(level_map(taxa, leaf, levels), "class")
    return rolled.groupBy(*keys, "level", "taxon").agg(F.sum("p").alias("p"))


def level_predictions(rolled: DataFrame, keys: Sequence[str], k: int = 2) -> DataFrame:
    """Greatest taxon and k greatest probabilities per key and level: `keys, level, pred, maxprob`."""
    best = F.struct(F.col("p"), -F.col("taxon"))
    top = Window.partitionBy(*keys, "level").orderBy(F.desc("p"), "taxon")
    kept = rolled.withColumn("_rn", F.row_number().over(top)).where(F.col("_rn") <= k)
    return kept.groupBy(*keys, "level").agg(
        F.max_by("taxon", best).alias("pred"), F.sort_array(F.collect_list("p"), asc=False).alias("maxprob")
    )


def predict_hierarchical(rolled: DataFrame, taxa: DataFrame, keys: Sequence[str], levels: Sequence[str], k: int = 2) -> DataFrame:
    """Prediction from the root down: at each level only children of the pick above count, renormalised.

    The plan holds one join and one grouping per level; `levels` runs from the root down.
    """
    out, above = None, None
    for parent, level in zip([None, *levels], levels):
        here = rolled.where(F.col("level") == level).select(*keys, "taxon", "p")
        if above is not None:
            children = taxa.select(F.col(parent).alias("pred"), F.col(level).alias("taxon")).distinct()
            allowed = above.select(*keys, "pred").join(children, "pred").drop("pred")
            here = here.join(allowed, [*keys, "taxon"])
        picked = here.groupBy(*keys).agg(
            F.max_by("taxon", F.struct(F.col("p"), -F.col("taxon"))).alias("pred"),
            F.sum("p").alias("_mass"),
            # At most one value per child taxon.
            F.sort_array(F.collect_list("p"), asc=False).alias("_ps"),
        )
        above = picked.select(
            *keys,
            F.lit(level).alias("level"),
            "pred",
            V.bind(F.col("_mass"), lambda m: F.transform(F.slice("_ps", 1, k), lambda p: F.try_divide(p, m))).alias("maxprob"),
        )
        out = above if out is None else out.unionByName(above)
    return out


def expand_vectors(parents: DataFrame, meta: DataFrame, parent_rank: str, rank: str, vec: str) -> DataFrame:
    """Parent vectors spread over the members, averaged per child rank."""
    pairs = meta.select(parent_rank, rank).groupBy(parent_rank, rank).agg(F.count(F.lit(1)).alias("_n"))
    return aggregate.mean_outputs(pairs.join(parents, parent_rank), [rank], vec, weight="_n").drop("n_chunks")


def spread_logits(logits: DataFrame, taxa: DataFrame, parent: str, child: str, z: str) -> DataFrame:
    """Parent logits on their children, lowered by the log of the number of children: parent mass is kept."""
    pairs = taxa.select(parent, child).distinct()
    sizes = pairs.groupBy(parent).agg(F.count(F.lit(1)).alias("_n"))
    return logits.join(sizes, parent).join(pairs, parent).withColumn(z, F.col(z) - F.log("_n")).drop("_n")


def classification_table(preds: DataFrame, taxa: DataFrame, leaf: str, ranks: Sequence[str]) -> DataFrame:
    """Predicted classes with their taxonomy: the columns of `preds` but for `pred`, then the ranks."""
    named = taxa.select(F.col(leaf).alias("pred"), *[F.col(r) for r in ranks]).distinct()
    return preds.join(named, "pred").drop("pred")


def level_cardinality(taxa: DataFrame, levels: Sequence[str]) -> DataFrame:
    """`level, n_classes`: distinct names per rank."""
    pairs = F.array(*[F.struct(F.lit(r).alias("level"), F.col(r).cast("string").alias("taxon")) for r in levels])
    long = taxa.select(F.explode(pairs).alias("_p")).select("_p.*").where("taxon IS NOT NULL").distinct()
    return long.groupBy("level").agg(F.count(F.lit(1)).alias("n_classes"))


def outputs_map(taxa: DataFrame, parent: str, child: str) -> DataFrame:
    """`child, parent, n_parents`; a strict hierarchy has one parent everywhere."""
    pairs = taxa.select(child, parent).distinct()
    return pairs.groupBy(child).agg(F.min(parent).alias(parent), F.count(F.lit(1)).alias("n_parents"))


def checked_outputs_map(taxa: DataFrame, parent: str, child: str) -> DataFrame:
    """The child → parent map; fails on a child with two parents."""
    message = F.concat(F.lit(f"{child} with more than one {parent}: "), F.col(child).cast("string"))
    single = F.when(F.col("n_parents") == 1, F.col(parent)).otherwise(F.raise_error(message))
    return outputs_map(taxa, parent, child).select(child, single.alias(parent))


# -- sampling ----------------------------------------------------------------------------------------------------


def extreme_members(df: DataFrame, rep: str, accession: str, weight: str, rounds: int = 1) -> DataFrame:
    """Members with the least and the greatest `weight` per representative, smallest accession on ties: `accession, round`.

    Each further round looks at the members that earlier rounds left.
    """
    members, out = df.where(F.col(accession) != F.col(rep)), None
    for number in range(1, rounds + 1):
        # Ties go to the smallest accession, at both ends, so the weights are settled first.
        ends = members.groupBy(rep, weight).agg(F.min(accession).alias("_first"))
        ends = ends.groupBy(rep).agg(F.min_by("_first", weight).alias("_a"), F.max_by("_first", weight).alias("_b"))
        picked = ends.select(F.explode(F.array("_a", "_b")).alias(accession)).distinct()
        out_round = picked.withColumn("round", F.lit(number))
        out = out_round if out is None else out.unionByName(out_round)
        members = members.join(picked, accession, "left_anti")
    return out


def sample_nonreps(meta: DataFrame, reps: DataFrame, accession: str, rep: str, order: str, n: int | None = None, include_self: bool = False) -> DataFrame:
    """Members of the asked representatives but for the representative: the first n by `order`, or all.

    `include_self` adds the representative. Columns `rep, accession`.
    """
    asked = reps.select(rep).distinct()
    strains = meta.where(F.col(accession) != F.col(rep)).join(asked, rep, "left_semi")
    if n is not None:
        strains = ordering.first_n(strains, [rep], [F.col(order)], n)
    out = strains.select(rep, accession)
    return out.unionByName(asked.select(rep, F.col(rep).alias(accession))) if include_self else out


def strain_shortages(meta: DataFrame, reps: DataFrame, accession: str, rep: str, n: int) -> DataFrame:
    """Representatives with fewer than n other members: `rep, n_found`."""
    found = meta.where(F.col(accession) != F.col(rep)).groupBy(rep).agg(F.count(F.lit(1)).alias("n_found"))
    return reps.select(rep).distinct().join(found, rep, "left").na.fill(0, ["n_found"]).where(F.col("n_found") < n)


def sample_taxa(
    df: DataFrame,
    ranks: tuple[str, str, str],
    accession: str,
    n_classes: int = 1,
    n_genera: int = 1,
    n_species: int = 1,
    n_total: int | None = None,
) -> DataFrame:
    """The most frequent species of the most frequent genera of the most frequent classes, one accession each.

    Ties go to the first name; the accession is the smallest of its species.
    """
    cls, genus, species = ranks
    counts = df.groupBy(cls, genus, species).agg(F.count(F.lit(1)).alias("_ns"), F.min(accession).alias(accession))
    genera = counts.groupBy(cls, genus).agg(F.sum("_ns").alias("_ng"))
    classes = genera.groupBy(cls).agg(F.sum("_ng").alias("_nc"))
    top_classes = classes.orderBy(F.desc("_nc"), cls).limit(n_classes)
    top_genera = ordering.first_n(genera.join(top_classes, cls), [cls], [F.desc("_ng"), F.col(genus)], n_genera)
    within = counts.join(top_genera, [cls, genus])
    picked = ordering.first_n(within, [cls, genus], [F.desc("_ns"), F.col(species)], n_species)
    if n_total is not None:
        order = [F.desc("_nc"), F.col(cls), F.desc("_ng"), F.col(genus), F.desc("_ns"), F.col(species)]
        picked = picked.orderBy(*order).limit(n_total)
    return picked.select(cls, genus, species, accession)
