"""Data preparation from files on disk, and the alignment baseline on a worked case."""

import gzip

import pytest
from pyspark.sql import functions as F

from cladeflow.plans import baseline, prepare
from cladeflow.sources import tables

META = [
    ("RS_GCF_000000001.1", "d__B;p__X;c__;o__;f__;g__;s__a one", "RS_GCF_000000001.1", 3, 99.0),
    ("RS_GCF_000000002.1", "d__B;p__X;c__;o__;f__;g__;s__a one", "RS_GCF_000000001.1", 5, 98.0),
    ("GB_GCA_000000003.1", "d__B;p__X;c__;o__;f__;g__;s__a one", "RS_GCF_000000001.1", 9, 97.0),
    ("GB_GCA_000000004.1", "d__B;p__X;c__;o__;f__;g__;s__a one", "RS_GCF_000000001.1", 7, 96.0),
    ("GB_GCA_000000005.1", "d__A;p__Y;c__;o__;f__;g__;s__b two", "GB_GCA_000000005.1", 1, 95.0),
    ("U_GUT_000000006.1", "d__A;p__Y;c__;o__;f__;g__;s__b two", "GB_GCA_000000005.1", 1, 95.0),
    ("GB_GCA_000000007.1", "d__A;p__Y;c__;o__;f__;g__;s__b two", "U_GUT_000000006.1", 1, 95.0),
]


@pytest.fixture
def archive(spark, tmp_path):
    lines = ["accession\tgtdb_taxonomy\tgtdb_genome_representative\tcontig_count\tcheckm_completeness", *["\t".join(map(str, r)) for r in META]]
    (tmp_path / "meta.tsv").write_text("\n".join(lines) + "\n")
    for n, tag in ((1, "GCF"), (2, "GCF"), (3, "GCA"), (5, "GCA")):
        folder = tmp_path / "all" / tag / str(n)
        folder.mkdir(parents=True)
        with gzip.open(folder / f"{tag}_00000000{n}.1_asm_genomic.fna.gz", "wt") as f:
            f.write(f">c{n} first\nACGTN\nacgtx\n>d{n}\n{'A' * 120}\n")
    return str(tmp_path / "meta.tsv"), str(tmp_path / "all")


def accessions(df):
    return {r["accession"][-3] for r in df.select("accession").collect()}


def test_genomes_are_chosen_by_kind(spark, archive):
    meta = tables.read_metadata(spark, archive[0])
    want = {"all": "12345", "reps": "15", "nonreps": "23"}
    for which, numbers in want.items():
        genomes, taxa = prepare.select_genomes(meta, which)
        assert accessions(genomes) == set(numbers) and accessions(taxa) == set("15")
    assert accessions(prepare.select_genomes(meta, "nonreps", extremes=False)[0]) == set("234")
    assert accessions(prepare.select_genomes(meta, "nonreps", nontest=True)[0]) == set("4")
    some = spark.createDataFrame([("GCF_000000002.1",)], "accession string")
    genomes, taxa = prepare.select_genomes(meta, accessions=some)
    assert accessions(genomes) == {"2"} and accessions(taxa) == set("15")
    with pytest.raises(ValueError):
        prepare.select_genomes(meta, "other")


def test_files_become_linked_tables(spark, archive, tmp_path):
    edges = spark.createDataFrame([("GCF_000000001.1", "x", 1.0), ("GCA_000000005.1", "x", 2.0), ("other", "x", 3.0), ("x", "root", 1.0)], "child string, parent string, length double")
    pairs = spark.createDataFrame([("GCF_000000001.1", "GCA_000000005.1")], "a string, b string")
    prepared = prepare.prepare_data(spark, *archive, missing="skip", tree_edges=edges, pairs=pairs)
    prepare.write_prepared(prepared, str(tmp_path / "out"))
    read = {name: tables.read_dataset(spark, str(tmp_path / "out"), name).collect() for name in prepared}
    assert {(r["genome_id"], r["seq_id"], r["sequence"], r["length"]) for r in read["sequences"] if r["seq_id"][0] == "c"} == {
        (f"{tag}_00000000{n}.1", f"c{n}", "ACGTNACGTN", 10) for n, tag in ((1, "GCF"), (2, "GCF"), (3, "GCA"), (5, "GCA"))
    }
    assert {(r["genome_id"][-3], r["taxon_id"][-3]) for r in read["genomes"]} == {("1", "1"), ("2", "1"), ("3", "1"), ("5", "5")}
    assert {(r["taxon_id"][-3], r["phylum"], r["species"]) for r in read["taxa"]} == {("1", "p__X", "s__a one"), ("5", "p__Y", "s__b two")}
    assert {(r["child"], r["parent"], r["length"]) for r in read["tree_edges"]} == {("GCF_000000001.1", "x", 1.0), ("GCA_000000005.1", "x", 2.0)}
    assert [r["d"] for r in read["distances"]] == [3.0]
    longer = prepare.prepare_data(spark, *archive, missing="skip", min_len=10)["sequences"]
    assert {r["seq_id"] for r in longer.collect()} == {"d1", "d2", "d3", "d5"}


def test_a_missing_file_is_an_error(spark, archive):
    with pytest.raises(Exception, match="GCA_000000004.1: no file"):
        prepare.prepare_data(spark, *archive)["sequences"].count()


def test_baseline_of_a_worked_case(spark):
    taxa = spark.createDataFrame([("G1", "d1", "p1", "s1"), ("G2", "d1", "p1", "s2"), ("G3", "d2", "p3", "s3")], "accession string, domain string, phylum string, species string")
    ranks = ["domain", "phylum", "species"]
    hits = [
        ("G1-9-a_1", "G1-x", 100.0), ("G1-9-a_1", "G2-x", 95.0), ("G1-9-a_1", "G3-x", 10.0), ("G1-9-a_2", "G1-x", 50.0),
        ("G1-9-a_3", "G3-x", 40.0), ("G3-9-b_1", "G1-x", 60.0),
    ]
    records = spark.createDataFrame([("G1-9-a",), ("G3-9-b",), ("G3-9-c-d",)], "seq_id string")
    orfs, classified, report = baseline.alignment_baseline(spark.createDataFrame(hits, "query string, subject string, bitscore double"), records, taxa, ranks)
    assert {(r["orf_id"], r["seq_name"], r["bitscore"], r["phylum"], r["species"]) for r in orfs.collect()} == {
        ("1", "a", 97.5, "p1", None), ("2", "a", 50.0, "p1", "s1"), ("3", "a", 40.0, "p3", "s3"), ("1", "b", 60.0, "p1", "s1")
    }
    # The taxon with half of all scores, counting ORFs without one: 147.5 of 187.5 for p1, 50 of 187.5 for s1.
    assert {(r["seq_name"], r["phylum"], r["species"]) for r in classified.collect()} == {("a", "p1", None), ("b", "p1", "s1")}
    got = {(r["rank"], r["domain"]): (round(r["share"], 6), r["accuracy"], r["n"]) for r in report.collect()}
    assert got["phylum", None] == (0.666667, 0.5, 3) and got["phylum", "d1"] == (1.0, 1.0, 1) and got["species", "d2"] == (0.5, 0.0, 2)
    assert got["species", "d1"] == (0.0, None, 1)
