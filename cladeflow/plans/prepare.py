"""From genome metadata and a folder of sequence files to the linked tables of a labelled data set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cladeflow.functions import names, sequence as S
from cladeflow.operators import filters, taxonomy, trees
from cladeflow.sources import fasta, files, tables

ACCESSION, REP = "accession", "gtdb_genome_representative"


def select_genomes(
    meta: DataFrame, which: str = "all", extremes: bool = True, nontest: bool = False, accessions: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(genomes to convert, taxa) out of a metadata table.

    Genomes that are not in the archives, or whose representative is not, go first; the taxa are the representatives that
    are left. `which` keeps `all` genomes, `reps` or `nonreps`; of the latter those with the fewest and the most contigs
    per representative, or (`nontest`) those that come next to them, unless `extremes` is off.
    """
    if which not in ("all", "reps", "nonreps"):
        raise ValueError(f"{which} is none of all, reps, nonreps")
    archived = filters.filter_ncbi(meta, ACCESSION, REP)
    taxa = filters.filter_reps(archived, ACCESSION, REP)
    genomes = archived if accessions is None else filters.keep_keys(archived, accessions.select(ACCESSION), ACCESSION)
    if which == "reps":
        genomes = filters.filter_reps(genomes, ACCESSION, REP)
    elif which == "nonreps":
        genomes = filters.filter_reps(genomes, ACCESSION, REP, keep=False)
        if extremes:
            picked = taxonomy.extreme_members(genomes, REP, ACCESSION, "contig_count", rounds=2 if nontest else 1)
            genomes = filters.keep_keys(genomes, picked.where(F.col("round") == (2 if nontest else 1)).select(ACCESSION), ACCESSION)
    return genomes, taxa


def read_sequences(spark: SparkSession, located: DataFrame, kind: str = "genomic", min_len: int | None = None, max_degenerate: float | None = None) -> DataFrame:
    """`seq_id, genome_id, sequence, length` of the records of located files.

    The list of paths passes the driver, as the file index of any scan does. DNA letters outside the alphabet become N;
    coding and protein records are named by their locus tag, proteins lose a trailing stop and may be checked.
    """
    paths = [r["path"] for r in located.where("path is not null").select("path").collect()]
    if not paths:
        return spark.createDataFrame([], "seq_id string, genome_id string, sequence string, length int")
    records = fasta.read_fasta(spark, paths)
    name = F.col("seq_id") if kind == "genomic" else names.locus_tag(F.col("description"), F.col("seq_id"))
    rows = records.select(name.alias("seq_id"), names.path_accession(F.col("path")).alias("genome_id"), "sequence")
    if kind == "protein":
        rows = filters.protein_qc(rows, "sequence", 1.0 if max_degenerate is None else max_degenerate)
        rows = rows.withColumn("sequence", S.clean_protein(F.col("sequence")))
    else:
        rows = rows.withColumn("sequence", S.clean_dna(F.col("sequence")))
    rows = rows.withColumn("length", F.length("sequence"))
    return rows if min_len is None else filters.filter_min_len(rows, "sequence", min_len)


def prepare_data(
    spark: SparkSession, metadata: str, root: str, kind: str = "genomic", which: str = "all", extremes: bool = True, nontest: bool = False,
    accessions: DataFrame | None = None, min_len: int | None = None, max_degenerate: float | None = None, missing: str = "error",
    tree_edges: DataFrame | None = None, pairs: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """`sequences`, `genomes` and `taxa` of a data set, and with a tree its edges over the taxa and the distances of `pairs`.

    Metadata are filtered, the files of the chosen genomes looked up below `root` (the newest of several), and their records
    labelled through genome and representative. An accession without a file is an error, or (`missing="skip"`) left out.
    """
    genomes, taxa = select_genomes(tables.read_metadata(spark, metadata), which, extremes, nontest, accessions)
    located = files.locate_files(files.list_files(spark, root), genomes, kind)
    located = files.require_files(located) if missing == "error" else located.where("path is not null")
    labelled = taxonomy.attach_rep(genomes, taxa.select(REP), REP)
    kept = filters.keep_keys(labelled, located.select(ACCESSION), ACCESSION)
    out = {
        "sequences": read_sequences(spark, located, kind, min_len, max_degenerate),
        "genomes": kept.select(F.col(ACCESSION).alias("genome_id"), F.col(REP).alias("taxon_id"), "contig_count", "checkm_completeness"),
        "taxa": taxa.select(F.col(ACCESSION).alias("taxon_id"), *names.RANKS),
    }
    if tree_edges is not None:
        tree = trees.lift(tree_edges)
        out["tree_edges"] = trees.shear_tree(tree, out["taxa"].select(F.col("taxon_id").alias("tip")))
        if pairs is not None:
            out["distances"] = trees.patristic(tree, pairs)
    return out


def write_prepared(prepared: dict[str, DataFrame], path: str) -> None:
    extra = {k: v for k, v in prepared.items() if k not in ("sequences", "taxa", "genomes")}
    tables.write_dataset(path, prepared["sequences"], prepared["taxa"], prepared["genomes"], **extra)
