"""Column functions on accessions, lineages, headers and paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The ranks from the root down, and the archive host path.
RANKS = ("domain", "phylum", "class", "order", "family", "genus", "species")
ARCHIVE = "ftp.ncbi.nlm.nih.gov/genomes/all"

# Fixed value: a query name is accession-length-sequence_ORF.
_QUERY = r"^([^-]*)-([^-]*)-(.*)_([^_]*)$"


def strip_tag(col: Column, always: bool = False) -> Column:
    """Remove the source tag; `always` drops three characters whatever they are."""
    return F.substr(col, F.lit(4)) if always else F.regexp_replace(col, "^(RS|GB)_", "")


def accession_path(col: Column, sequence_only: bool = True) -> Column:
    """Archive path of an accession, cut into groups of three digits."""
    acc = strip_tag(col)
    parts = [F.lit(ARCHIVE)] + [F.substring(acc, at, 3) for at in (1, 5, 8, 11)] + [F.concat(acc, F.lit("*"))]
    if sequence_only:
        parts.append(F.lit("*f[a,n]a.gz"))
    return F.concat_ws("/", *parts)


def path_accession(col: Column) -> Column:
    """Accession at the start of a file's base name: its first two `_` tokens."""
    return F.substring_index(F.substring_index(col, "/", -1), "_", 2)


def split_lineage(col: Column, epithet: bool = False) -> list[Column]:
    """Seven rank columns out of a `;`-separated lineage; `epithet` keeps the second word of the species.

    What a short lineage lacks is NULL.
    """
    names = F.split(col, ";")
    out = [F.get(names, F.lit(i)).alias(rank) for i, rank in enumerate(RANKS)]
    if epithet:
        out[-1] = F.get(F.split(F.get(names, F.lit(6)), " "), F.lit(1)).alias("species")
    return out


def compose_header(accession: Column, length: Column, seq_id: Column) -> Column:
    return F.concat_ws("-", accession, length.cast("string"), seq_id.cast("string"))


def parse_query_id(col: Column) -> list[Column]:
    """`accession-length-sequence_orf` to its four fields."""
    fields = ("accession", "seq_len", "seq_name", "orf_id")
    return [F.regexp_extract(col, _QUERY, i + 1).alias(name) for i, name in enumerate(fields)]


def parse_subject_id(col: Column) -> Column:
    return F.substring_index(col, "-", 1)


def locus_tag(description: Column, fallback: Column) -> Column:
    """The `[locus_tag=…]` value of a description, else `fallback`."""
    found = F.regexp_extract(description, r"\[locus_tag=([^\[\]]*)\]", 1)
    return F.coalesce(F.when(found != "", found), fallback.cast("string"))


def norm_name(col: Column) -> Column:
    """Tip name with spaces as underscores."""
    return F.translate(col, " ", "_")


def is_ncbi(col: Column) -> Column:
    return col.rlike("^(RS_|GB_)?GC[AF]_")


def coarser_ranks(rank: str) -> list[str]:
    """The ranks at and above `rank`, from the root down."""
    return list(RANKS[: RANKS.index(rank) + 1])
