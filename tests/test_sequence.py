import random

import pytest
from pyspark.sql import functions as F

from cladeflow.functions import names, sequence as S, vectors as V
from cladeflow.operators import aggregate, filters, windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def seqs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string")


def test_decodes_the_ragged_table(spark):
    # Codes over A, C, G, T with exclusive end offsets; the expected texts are the golden ones.
    codes = "AATCGATCGGGGGCTAAGCCTACACATG"
    ends, expected = [6, 14, 20, 24, 28], ["AATCGA", "TCGGGGGC", "TAAGCC", "TACA", "CATG"]
    rows = [(i, [S.DNA_VOCAB.index(c) for c in codes[a:b]]) for i, (a, b) in enumerate(zip([0, *ends], ends))]
    df = spark.createDataFrame(rows, "id int, codes array<tinyint>")
    decoded = df.select("id", S.decode_seq(F.col("codes")).alias("s")).orderBy("id").collect()
    assert [r["s"] for r in decoded] == expected


def test_encoding_folds_case_and_maps_unknown_to_n(spark):
    codes = one(spark, S.encode_seq(F.lit("acgtNxe*")))
    assert codes == [S.DNA_VOCAB.index(c) for c in "ACGTNNNN"]
    assert one(spark, S.encode_seq(F.lit(""))) == []
    assert one(spark, S.encode_seq(F.lit("AZ"), "protein")) == [0, 25]


def test_reverse_complement_is_an_involution(spark):
    text = "".join(random.Random(1).choices(S.DNA_VOCAB, k=300))
    assert one(spark, S.revcomp(S.revcomp(F.lit(text)))) == text
    assert one(spark, S.revcomp(F.lit("AACGTN"))) == "NACGTT"


def test_one_hot_of_residues(spark):
    hot = one(spark, S.one_hot_seq(S.encode_seq(F.lit("AC")), 15))
    assert hot == [[1] + [0] * 14, [0, 1] + [0] * 13]


def test_wrap_has_no_trailing_newline(spark):
    assert one(spark, S.wrap(F.lit("A" * 200), 100)) == "A" * 100 + "\n" + "A" * 100
    assert one(spark, S.wrap(F.lit("A" * 101), 100)) == "A" * 100 + "\nA"


def test_softmax_of_large_values(spark):
    p = one(spark, V.softmax(F.array(F.lit(1000.0), F.lit(1000.0))))
    assert p == [0.5, 0.5]


def test_argmax_takes_the_first_of_equal(spark):
    assert one(spark, V.argmax(F.array(F.lit(0.1), F.lit(0.4), F.lit(0.4)))) == 1


def test_accession_paths(spark):
    path = one(spark, names.accession_path(F.lit("RS_GCF_000978935.1"), sequence_only=False))
    assert path == "ftp.ncbi.nlm.nih.gov/genomes/all/GCF/000/978/935/GCF_000978935.1*"
    found = one(spark, names.path_accession(F.lit("/d/GCF_000978935.1_ASM97893v1_genomic.fna.gz")))
    assert found == "GCF_000978935.1"


def test_query_ids_split_at_the_outer_marks(spark):
    fields = names.parse_query_id(F.lit("GCF_004208935.1-141866-NZ_SGPD01000037.1_12"))
    row = spark.range(1).select(*fields).first()
    assert tuple(row) == ("GCF_004208935.1", "141866", "NZ_SGPD01000037.1", "12")


def test_minimum_record_length_is_strict(spark):
    kept = filters.filter_min_len(seqs(spark, "A" * 50, "A" * 51), "seq", 50)
    assert [r["seq_id"] for r in kept.collect()] == [1]


def test_ncbi_filter_refuses_other_letters(spark):
    rows = spark.createDataFrame([("RS_GCF_1",), ("GCA_2",), ("GC,_3",), ("U_GUT_4",)], "a string")
    assert {r["a"] for r in filters.filter_ncbi(rows, "a").collect()} == {"RS_GCF_1", "GCA_2"}


def brute_windows(text, window, step, min_len):
    starts = range(0, max(len(text), 1), step)
    return [(s, text[s : s + window]) for s in starts if len(text[s : s + window]) >= min_len]


@pytest.mark.parametrize("window,step,min_len", [(100, 100, 100), (50, 20, 30), (10, 30, 5), (7, 1, 7), (1024, 128, 100)])
def test_windows_equal_slices(spark, window, step, min_len):
    rng = random.Random(window)
    texts = ["".join(rng.choices("ACGT", k=n)) for n in (0, 1, 49, 50, 51, 99, 100, 101, 333, 2500)]
    cuts = windows.window_sequences(seqs(spark, *texts), "seq", window, step, min_len).collect()
    expected = {(i, s): w for i, t in enumerate(texts) for s, w in brute_windows(t, window, step, min_len)}
    assert {(r["seq_id"], r["start"]): r["window"] for r in cuts} == expected
    assert all(r["end"] == r["start"] + len(r["window"]) for r in cuts)
    counts = windows.window_counts(seqs(spark, *texts).withColumn("L", F.length("seq")), "L", window, step, min_len)
    assert sum(r["n_windows"] for r in counts.collect()) == len(expected)


def test_windows_of_a_record_longer_than_a_tile(spark):
    text = "".join(random.Random(3).choices("ACGT", k=3 * windows.WINDOWS_PER_TILE + 77))
    cuts = windows.window_sequences(seqs(spark, text), "seq", 60, 1, 20)
    wrong = [r for r in cuts.collect() if r["window"] != text[r["start"] : r["start"] + 60]]
    assert not wrong and cuts.count() == len(text) - 20 + 1


def test_tiles_hold_every_kmer_once(spark):
    text = "".join(random.Random(4).choices("ACGTN", k=1000))
    tiles = windows.tile(seqs(spark, text, "ACG", "ACGT"), "seq", span=64, overlap=3)
    found = sorted(r["k"] for r in tiles.select(F.explode(S.kmers(F.col("seq"))).alias("k")).collect())
    assert found == sorted([text[i : i + 4] for i in range(997)] + ["ACGT"])


def test_reverse_windows_are_windows_of_the_reverse_complement(spark):
    text = "".join(random.Random(5).choices("ACGT", k=450))
    swap = str.maketrans("ACGT", "TGCA")
    turned = text.translate(swap)[::-1]
    rows = windows.window_sequences(windows.both_strands(seqs(spark, text), "seq"), "seq", 100, 50).collect()
    for r in rows:
        source = text if r["strand"] == "+" else turned
        assert r["window"] == source[r["start"] : r["end"]]


def test_split_is_a_partition_with_exact_sizes(spark):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate((99, 100, 500, 1234, 5000))], "seq_id long, L long")
    split = windows.split_windows(rows, "seq_id", "L", 100, 10, seed=5).collect()
    for i, length in enumerate((99, 100, 500, 1234, 5000)):
        mine = [r for r in split if r["seq_id"] == i]
        n = max(0, (length - 100) // 10 + 1)
        assert sorted(r["start"] for r in mine) == [10 * k for k in range(n)]
        assert sum(r["split"] == "val" for r in mine) == round(0.2 * n)


def test_window_arguments_are_checked(spark):
    with pytest.raises(ValueError):
        windows.window_sequences(seqs(spark, "A"), "seq", 50, 10, 100)
    with pytest.raises(ValueError):
        windows.window_sequences(seqs(spark, "A"), "seq", 100, 0, 10)


def test_tetramer_frequencies_of_both_kinds(spark):
    rows = {(r["kmer"]): r["freq"] for r in aggregate.tetramer_freq(seqs(spark, "AAAATTTTN"), ["seq_id"], "seq").collect()}
    assert abs(sum(rows.values()) - 1) < 1e-12 and abs(rows["AAAA"] - 2 / 5) < 1e-12
    every = aggregate.tetramer_freq(seqs(spark, "AAAATTTTN"), ["seq_id"], "seq", norm="all").collect()
    assert abs(sum(r["freq"] for r in every) - 5 / 6) < 1e-12
    assert len(aggregate.canonical_kmers()) == 136
    wide = aggregate.tetramer_table(seqs(spark, "AAAATTTTN"), ["seq_id"], "seq").first()
    assert len(wide) == 137 and wide["CCCC"] == 0.0


def test_short_lineages_have_nulls(spark):
    row = spark.range(1).select(*names.split_lineage(F.lit("d__A;p__B"), epithet=True)).first()
    assert (row["domain"], row["phylum"], row["class"], row["species"]) == ("d__A", "p__B", None, None)
