import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cladeflow.operators import aggregate, evaluate, lca, taxonomy


def contigs(spark, **genomes):
    return spark.createDataFrame([(g, n) for g, lengths in genomes.items() for n in lengths], "genome string, length long")


def brute_stats(lengths):
    """Add contigs, longest first, until they hold strictly more than the share."""
    found = []
    for share in (0.5, 0.9):
        held, used, waiting = 0, 0, list(lengths)
        while held <= share * sum(lengths):
            longest = max(waiting)
            waiting.remove(longest)
            held, used = held + longest, used + 1
        found += [longest, used]
    return tuple(found)


def test_assembly_statistics_use_a_strict_threshold(spark):
    # 5 of 10 bases is not more than half: the second contig decides.
    row = aggregate.assembly_stats(contigs(spark, a=[5, 3, 2]), "genome", "length").first()
    assert (row["n_ctgs"], row["max_len"], row["n50_len"], row["n50_rank"]) == (3, 5, 3, 2)
    compat = aggregate.assembly_stats(contigs(spark, a=[5, 3, 2]), "genome", "length", compat=True).first()
    assert (compat["l50"], compat["n50"]) == (3, 1)


def test_assembly_statistics_equal_a_sorted_sweep(spark):
    rng = random.Random(1)
    genomes = {f"g{i}": [rng.choice((1, 5, 5, 9, rng.randrange(1, 10**6))) for _ in range(rng.randrange(1, 60))] for i in range(40)}
    rows = aggregate.assembly_stats(contigs(spark, **genomes), "genome", "length").collect()
    for r in rows:
        assert (r["n50_len"], r["n50_rank"], r["n90_len"], r["n90_rank"]) == brute_stats(genomes[r["genome"]])
        assert r["mean_len"] == pytest.approx(np.mean(genomes[r["genome"]]))


@pytest.fixture(scope="module")
def outputs(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet(np.ones(4), size=60)
    pdf = pd.DataFrame({"seq": np.arange(60) // 10, "label": np.arange(60) // 10 % 4, "length": rng.integers(50, 99, 60), "p": list(p)})
    return spark.createDataFrame(pdf), pdf


def test_pooled_vectors(outputs):
    df, pdf = outputs
    groups = {k: np.stack(g["p"].to_numpy()) for k, g in pdf.groupby("seq")}
    for r in aggregate.mean_outputs(df, ["seq"], "p").collect():
        assert np.allclose(r["p"], groups[r["seq"]].mean(axis=0)) and r["n_chunks"] == 10
    for r in aggregate.mean_outputs(df, ["seq"], "p", pool="max").collect():
        assert np.allclose(r["p"], groups[r["seq"]].max(axis=0))
    for r in aggregate.var_outputs(df, ["seq"], "p").collect():
        assert np.allclose(r["p"], groups[r["seq"]].var(axis=0))


def test_variance_of_a_single_window_is_zero(spark):
    one = spark.createDataFrame([(1, [0.3, 0.7])], "seq int, p array<double>")
    assert aggregate.var_outputs(one, ["seq"], "p").first()["p"] == [0.0, 0.0]


def test_aggregate_chunks(outputs):
    df, pdf = outputs
    rows = aggregate.aggregate_chunks(df, "seq", "p", "label", "length", weighted=True, both_strands=True).collect()
    for r in rows:
        mine = pdf[pdf["seq"] == r["seq"]]
        p, w = np.stack(mine["p"].to_numpy()), mine["length"].to_numpy()
        assert np.allclose(r["mean"], (p * w[:, None]).sum(axis=0) / w.sum())
        assert np.allclose(r["variance"], p.var(axis=0))
        assert r["length"] == w.sum() // 2
        assert r["vote"] == np.bincount(p.argmax(axis=1), minlength=4).argmax()


def test_votes_prefer_the_smallest_class_on_ties(spark):
    df = spark.createDataFrame([(1, [0.1, 0.9]), (1, [0.9, 0.1])], "seq int, p array<double>")
    assert aggregate.majority_vote(df, ["seq"], "p").first()["pred"] == 0


def test_mixed_labels_are_found_and_refused(spark):
    df = spark.createDataFrame([(1, 2), (1, 3), (2, 2)], "seq int, label int")
    assert [r["seq"] for r in aggregate.mixed_labels(df, "seq", "label").collect()] == [1]
    with pytest.raises(Exception, match="more than one label"):
        aggregate.pick_label(df, "seq", "label").collect()


TAXA = [(0, 0, 0), (1, 0, 0), (2, 1, 0), (3, 2, 1)]


def test_roll_up_keeps_the_mass_and_hierarchy_wins(spark):
    taxa = spark.createDataFrame(TAXA, "species int, genus int, family int")
    # The best species (3) lies outside the best family (0).
    df = spark.createDataFrame([(1, [0.25, 0.1, 0.25, 0.4])], "seq int, p array<double>")
    levels = ["family", "genus", "species"]
    rolled = taxonomy.roll_up(df, ["seq"], "p", taxa, "species", levels)
    mass = rolled.groupBy("level").agg(F.sum("p").alias("p")).collect()
    assert all(abs(r["p"] - 1) < 1e-12 for r in mass)
    flat = {r["level"]: r["pred"] for r in taxonomy.level_predictions(rolled, ["seq"]).collect()}
    nested = {r["level"]: (r["pred"], r["maxprob"]) for r in taxonomy.predict_hierarchical(rolled, taxa, ["seq"], levels).collect()}
    assert flat == {"family": 0, "genus": 2, "species": 3}
    assert {k: v[0] for k, v in nested.items()} == {"family": 0, "genus": 0, "species": 0}
    assert nested["genus"][1] == pytest.approx([0.35 / 0.6, 0.25 / 0.6])
    assert nested["species"][1] == pytest.approx([0.25 / 0.35, 0.1 / 0.35])


def test_hierarchy_violation_fails(spark):
    taxa = spark.createDataFrame([("g1", "f1"), ("g1", "f2"), ("g2", "f1")], "genus string, family string")
    found = {r["genus"]: r["n_parents"] for r in taxonomy.outputs_map(taxa, "family", "genus").collect()}
    assert found == {"g1": 2, "g2": 1}
    with pytest.raises(Exception, match="more than one family"):
        taxonomy.checked_outputs_map(taxa, "family", "genus").collect()


def test_spread_logits_keep_parent_mass(spark):
    taxa = spark.createDataFrame(TAXA, "species int, genus int, family int")
    logits = spark.createDataFrame([(0, 1.5), (1, -0.5), (2, 0.0)], "genus int, z double")
    rows = taxonomy.spread_logits(logits, taxa, "genus", "species", "z").collect()
    mass = {}
    for r in rows:
        mass[r["genus"]] = mass.get(r["genus"], 0) + np.exp(r["z"])
    assert mass == pytest.approx({0: np.exp(1.5), 1: np.exp(-0.5), 2: 1.0})


def test_extreme_members_by_round(spark):
    rows = [("r", "r", 0), ("a", "r", 5), ("b", "r", 1), ("c", "r", 9), ("d", "r", 9), ("e", "r", 2), ("s", "s", 1), ("t", "s", 4)]
    df = spark.createDataFrame(rows, "acc string, rep string, n int")
    found = {(x["acc"], x["round"]) for x in taxonomy.extreme_members(df, "rep", "acc", "n", 2).collect()}
    assert found == {("b", 1), ("c", 1), ("t", 1), ("e", 2), ("d", 2)}


def brute_lca(hits, tax, frac):
    out = {}
    for orf, group in hits.groupby("orf"):
        near = group[group["score"] >= frac * group["score"].max()]
        names = [tax[s] for s in near["subject"]]
        agreed = tuple(n[0] if len(set(n)) == 1 else None for n in zip(*names))
        out[orf] = (near["score"].mean(), *agreed)
    return out


def test_hits_lca_of_ordinary_and_crowded_orfs(spark):
    rng = random.Random(3)
    tax = {s: (f"d{s % 2}", f"p{s % 4}" if s != 5 else None) for s in range(12)}
    rows = [(0 if rng.random() < 0.4 else rng.randrange(1, 40), rng.randrange(12), float(rng.randrange(80, 100))) for _ in range(400)]
    hits = pd.DataFrame(rows, columns=["orf", "subject", "score"])
    taxa = spark.createDataFrame([(s, *t) for s, t in tax.items()], "subject long, domain string, phylum string")
    found = lca.hits_lca(spark.createDataFrame(hits), taxa, ["orf"], "subject", "score", ["domain", "phylum"], 0.9)
    rows = {r["orf"]: (r["score"], r["domain"], r["phylum"]) for r in found.collect()}
    want = brute_lca(hits, tax, 0.9)
    assert rows.keys() == want.keys()
    for orf, value in want.items():
        assert rows[orf][0] == pytest.approx(value[0]) and rows[orf][1:] == value[1:]


def test_hits_without_a_lineage_stay(spark):
    hits = spark.createDataFrame([("o", "s1", 10.0), ("o", "s2", 9.5), ("o2", "s2", 4.0)], "orf string, subject string, score double")
    taxa = spark.createDataFrame([("s1", "d1")], "subject string, domain string")
    found = {r["orf"]: (r["n_hits"], r["score"], r["domain"]) for r in lca.hits_lca(hits, taxa, ["orf"], "subject", "score", ["domain"]).collect()}
    assert found == {"o": (2, 9.75, "d1"), "o2": (1, 4.0, None)}


def test_unclassified_sequences_count_as_wrong(spark):
    seqs = spark.createDataFrame([(0, 0, 10), (0, None, 10), (0, 7, 20)], "label int, pred int, length long")
    taxa = spark.createDataFrame([(0, 5), (1, 5)], "species int, genus int")
    found = {r["level"]: r for r in evaluate.taxonomic_accuracy(seqs, taxa, "species", ["genus", "species"], "length").collect()}
    for row in found.values():
        assert (row["n"], row["seq_acc"], row["base_acc"]) == (3, pytest.approx(1 / 3), 0.25)


def test_null_scores_are_in_no_curve(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, None), (0, None)], "y int, s double")
    assert evaluate.roc_auc(df, "y", "s").first()["auc"] == 1.0
    assert [(r["fpr"], r["tpr"]) for r in evaluate.roc_curve(df, "y", "s").orderBy("fpr", "tpr").collect()] == [(0.0, 1.0), (1.0, 1.0)]


def test_assembly_statistics_keep_the_null_genome(spark):
    rows = spark.createDataFrame([(None, 4), (None, 2), ("a", 5)], "genome string, length long")
    assert {r["genome"]: r["n_ctgs"] for r in aggregate.assembly_stats(rows, "genome", "length").collect()} == {None: 2, "a": 1}


def test_orfs_without_a_taxon_count_in_the_total(spark):
    rows = [("s1", 4.0, "d1", "p1"), ("s1", 3.0, "d1", None), ("s1", 2.0, "d2", "p2"), ("s2", 1.0, None, None)]
    orfs = spark.createDataFrame(rows, "seq string, score double, domain string, phylum string")
    found = {r["seq"]: (r["domain"], r["phylum"]) for r in lca.aggregate_orfs(orfs, ["seq"], "score", ["domain", "phylum"]).collect()}
    assert found == {"s1": ("d1", None), "s2": (None, None)}
    tied = spark.createDataFrame([("s", 2.0, "b"), ("s", 2.0, "a")], "seq string, score double, domain string")
    assert lca.aggregate_orfs(tied, ["seq"], "score", ["domain"]).first()["domain"] == "a"


def test_curves_of_a_perfect_and_a_tied_score(spark):
    df = spark.createDataFrame([("x", 1, 0.9), ("x", 0, 0.1), ("y", 1, 0.5), ("y", 0, 0.5)], "k string, y int, s double")
    assert {r["k"]: r["auc"] for r in evaluate.roc_auc(df, "y", "s", ["k"]).collect()} == {"x": 1.0, "y": 0.5}
    assert {r["k"]: r["aupr"] for r in evaluate.pr_auc(df, "y", "s", ["k"]).collect()} == {"x": 1.0, "y": 0.75}
    assert evaluate.roc_auc(df, "y", "s").first()["auc"] == 0.875


def test_report_by_hand(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)], "t int, p int")
    rows = {r["class"]: r for r in evaluate.classification_report(df, "t", "p").collect()}
    assert rows["1"]["precision"] == pytest.approx(2 / 3) and rows["1"]["recall"] == 1.0
    assert rows["2"]["precision"] == 0.0 and rows["2"]["f1"] == 0.0
    assert rows["accuracy"]["recall"] == pytest.approx(0.6)
    assert rows["macro avg"]["recall"] == pytest.approx((0.5 + 1 + 0) / 3)


def test_longest_sequence_is_in_the_last_bin(spark):
    df = spark.createDataFrame([(i, i % 2 == 0) for i in range(1, 12)], "n long, ok boolean")
    rows = evaluate.accuracy_by_length(df, "n", "ok", 10).collect()
    assert sum(r["n"] for r in rows) == 11 and {r["bin"]: r["n"] for r in rows}[9] == 2
    same = spark.createDataFrame([(5, True), (5, False)], "n long, ok boolean")
    assert evaluate.accuracy_by_length(same, "n", "ok", 10).first()["bin"] == 0


def test_empty_contigs_and_one_sided_labels_do_not_fail(spark):
    rows = {r["genome"]: r for r in aggregate.assembly_stats(contigs(spark, a=[5, 0, 3, 0], b=[0]), "genome", "length").collect()}
    assert (rows["a"]["n_ctgs"], rows["a"]["n50_len"], rows["a"]["n90_len"]) == (4, 5, 3)
    assert rows["b"]["n50_len"] is None and rows["b"]["n_ctgs"] == 1
    only = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    assert evaluate.roc_auc(only, "y", "s").first()["auc"] is None
    assert evaluate.pr_auc(only, "y", "s").first()["aupr"] == 1.0
