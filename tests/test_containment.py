"""Windows found by seeds against plain containment."""

import random
import time

import pytest
from pyspark.sql import functions as F

from cladeflow.operators import containment

TURN = str.maketrans("ACGT", "TGCA")


def turned(text):
    return text.translate(TURN)[::-1]


def records(seed):
    rng = random.Random(seed)
    dna = "".join(rng.choice("ACGT") for _ in range(5000))
    return {
        1: dna,
        2: dna[1000:3000] + "N" * 3000 + dna[:700],  # shares stretches with itself and the first
        3: "AC" * 1500 + "G" + "AC" * 600,
        4: "N" * 800,
        5: "ACGT",
        6: turned(dna[2000:4000]) + dna[2000:4000],
        7: "",
    }


def windows_of(texts, seed):
    rng = random.Random(seed)
    out = []
    for key, text in texts.items():
        for _ in range(25):
            n = rng.choice([1, 5, 40, 62, 63, 64, 100, 300, 1000])
            at = rng.randrange(max(1, len(text) - n + 1))
            cut = text[at : at + n]
            kind = rng.randrange(5)
            if kind == 0 and cut:
                i = rng.randrange(len(cut))
                cut = cut[:i] + rng.choice("ACGT") + cut[i + 1 :]
            if kind == 1:
                cut = turned(cut)
            if kind == 2:
                cut = cut + "N" * 30
            out.append((key, cut))
        out += [(key, "N" * 200), (key, ""), (key, None)]
    return out + [(99, "ACGT"), (None, "ACGT")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_seeds_equal_plain_containment(spark, seed, monkeypatch):
    monkeypatch.setattr(containment, "TILE", 1 << 10)
    texts = records(seed)
    cuts = [(i, *w) for i, w in enumerate(windows_of(texts, seed))]
    found = containment.verify_windows(
        spark.createDataFrame(cuts, "i int, k long, window string"), spark.createDataFrame(list(texts.items()), "k long, seq string"), "k", "seq"
    )
    want = {}
    for i, key, cut in cuts:
        if key in texts:
            bare = None if cut is None else cut.rstrip("N")
            want[i] = (None, None) if bare is None else (bare in texts[key], turned(bare) in texts[key])
    assert {r["i"]: (r["hit"], r["rc_hit"]) for r in found.collect()} == want


def test_seeds_of_a_part_are_seeds_of_the_whole():
    seeds = containment._sampler()
    rng = random.Random(4)
    text = "".join(rng.choice("ACGTN") for _ in range(4000)) + "A" * 300 + "".join(rng.choice("AC") for _ in range(500))
    whole = set(zip(*(x.tolist() for x in seeds(text.encode()))))
    assert len(whole) < len(text) / 10
    for _ in range(200):
        at, n = rng.randrange(len(text)), rng.randrange(63, 900)
        hashes, places = seeds(text[at : at + n].encode())
        assert {(h, p + at) for h, p in zip(hashes.tolist(), places.tolist())} <= whole


def test_a_record_of_five_million_residues(spark):
    n = 5_000_000
    rng = random.Random(5)
    text = "".join(rng.choices("ACGT", k=n))
    record = spark.createDataFrame([(1, text)], "k long, seq string")
    cuts = [(1, text[i : i + 1000]) for i in range(0, n, 1000)] + [(1, text[i : i + 500] + "A" + text[i + 501 : i + 1000]) for i in range(7, n, 100_000)]
    start = time.time()
    found = containment.verify_windows(spark.createDataFrame(cuts, "k long, window string"), record, "k", "seq")
    kinds = {(r["hit"], r["rc_hit"]): r["n"] for r in found.groupBy("hit", "rc_hit").agg(F.count(F.lit(1)).alias("n")).collect()}
    unchanged = sum(text[i + 500] == "A" for i in range(7, n, 100_000))
    assert kinds == {(True, False): 5000 + unchanged, (False, False): 50 - unchanged}
    assert time.time() - start < 120


def test_long_windows_are_sampled_sparsely():
    rng = random.Random(6)
    text = "".join(rng.choice("ACGT") for _ in range(20_000))
    counts = [len(containment._sampler(span)(text.encode())[0]) for span in containment.SPANS]
    assert counts[0] > 3 * counts[1] > 9 * counts[2] > 0
    for span in containment.SPANS:
        whole = set(zip(*(x.tolist() for x in containment._sampler(span)(text.encode()))))
        for at in range(0, 15_000, 977):
            hashes, places = containment._sampler(span)(text[at : at + containment.SEED + span - 1].encode())
            assert len(hashes) == 1 and {(h, p + at) for h, p in zip(hashes.tolist(), places.tolist())} <= whole
