"""Whitening against numpy's eigenvalues, the prefix trie against brute force, pieces against the sentencepiece library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from cladeflow.llm import piece_bpe, prefix_trie, whitening
from fixtures import frames

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# -- whitening -----------------------------------------------------------------------------------------------------------


def symmetric(rng, kind, d):
    x = rng.integers(-80, 80, (2 * d + 1, d)).astype(float)
    if kind == "equal columns":
        x = np.repeat(x[:, :1], d, axis=1)
    if kind == "ties":
        return np.eye(d) * 50
    if kind == "close":
        return np.diag(1 + 1e-9 * np.arange(d))
    return np.cov(x.T, bias=True).reshape(d, d)


@pytest.mark.parametrize("kind", ["any", "equal columns", "ties", "close"])
@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_counts_and_leading_pairs(kind, d):
    rng = np.random.default_rng(d)
    v = symmetric(rng, kind, d)
    values = np.linalg.eigvalsh(v)[::-1]
    for shift in (-1.0, values[0] / 2, values[0] * 1.01 + 1):
        assert whitening.count_above(v, shift) == (values > shift).sum()
    pairs = whitening.leading_pairs(v, 4)
    found, vectors = np.array([e for e, _ in pairs]), np.array([x for _, x in pairs])
    scale = np.abs(v).sum() or 1
    assert np.allclose(found, values[: len(found)], atol=1e-13 * scale)
    assert np.abs(v @ vectors.T - vectors.T * found).max() < 1e-12 * scale
    assert np.abs(vectors @ vectors.T - np.eye(len(found))).max() < 1e-9


def brute_whitening(rows):
    kept = [(k, v) for k, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max((len(v) for _, v in kept), default=0)
    x = np.array([[int(np.floor(256 * c)) for c in v] + [0] * (width - len(v)) for _, v in kept], dtype=np.int64).reshape(len(kept), width)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(((fit - sums / n).T @ (fit - sums / n)) / n)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    spread = n * x - sums
    return [k for k, _ in kept], n, (spread**2).sum(axis=1), (spread / n) @ vectors / np.sqrt(values), values / np.trace(np.cov(fit.T, bias=True))


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=9).tolist()) for i in range(120)]
    rows += [(200 + i, rows[5][1]) for i in range(60)] + [(None, rows[6][1]), (300, None), (301, [1.0, None]), (302, [float("nan")] * 9)]
    rows += [(303, []), (304, [0.5, -0.0]), (305, [float("inf")] * 9), (7, rows[7][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"x": F.lit(1), "n": F.lit("clash"), "key": F.lit(2)})
    found = whitening.whitened_vectors(table.repartition(5)).toPandas()
    keys, n, deviation, whitened, explained = brute_whitening(rows)
    assert len(found) == 4 * len(keys) and set(found.n) == {n} and found.identity_error.nunique() == 1 and found.identity_error[0] < 1e-9
    for key, dev, values in zip(keys, deviation, whitened):
        own = found[found.vec_id.isna() if key is None else found.vec_id == key].sort_values("component").drop_duplicates("component")
        assert set(own.deviation) == {dev}
        assert np.allclose(np.abs(own.whitened), np.abs(values), atol=1e-9) and np.allclose(own.explained, explained, rtol=1e-9)
    # Either sign, the same for all rows.
    signs = {np.sign(found[(found.vec_id == k) & (found.component == 1)].whitened.iloc[0] * w[0]) for k, w in zip(keys, whitened) if k is not None}
    assert len(signs) == 1


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whitened_vectors(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened_vectors(spark.createDataFrame([(1, None)], schema)).count() == 0
    assert whitening.whitened_vectors(spark.createDataFrame([(1, [])], schema)).count() == 0
    one = whitening.whitened_vectors(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0])], schema)).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] is None for r in one)
    huge = whitening.whitened_vectors(spark.createDataFrame([(1, [1e300, 1.0]), (2, [3e14, 5.0]), (3, [0.0, 0.0])], schema)).collect()
    assert len(huge) == 6 and [r["deviation"] for r in huge if r["vec_id"] == 1] == [None, None]


# -- prefix trie ---------------------------------------------------------------------------------------------------------


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def brute_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        family = c - int(np.fmod(c, 100))
        rebuilt[c] = own.get(family, [])[:h] + turns[h:]
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in members)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(convs), len(path), parent, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talk(seed, convs=60, start=90):
    rng = random.Random(seed)
    rows = []
    for c in [*range(start, start + convs), *rng.sample(range(1000, 9999), 5), -5, -250, 200_000_000_000]:
        for turn in range(rng.choice([1, 2, 3, 5, 8, 12])):
            rows.append((c, turn if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["", "a", "bé", "c" * 40, None, "😀"])))
    # Copies of one conversation, repeated turns, a long conversation, rows of none.
    rows += [(c, turn, "user", "same") for c in range(300, 380) for turn in range(7)]
    rows += [(100, 3, "user", "again")] * 3 + [(77, turn, "user", f"{turn % 3}") for turn in range(90)] + [(None, 1, "user", "x"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,bits", [(1, None), (2, 4), (3, 7)])
def test_trie_equals_brute_force(spark, seed, bits):
    rows = talk(seed)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"key": F.lit(1), "pos": F.lit("x"), "n": F.lit(2)})
    found = prefix_trie.prefix_trie(table.repartition(3), bits=bits)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_trie(rows)


def test_trie_with_hot_paths(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ENDS_AT_ONCE", 3)
    monkeypatch.setattr(prefix_trie.ordering.salted_join, "__defaults__", ("_rows", 5))
    ends = prefix_trie.ends_digests.__defaults__
    monkeypatch.setattr(prefix_trie.ends_digests, "__defaults__", (3,))
    monkeypatch.setattr(prefix_trie, "IDS_A_CHUNK", 4)
    assert ends == (10_000,)
    rows = talk(4, convs=10)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted((tuple(r) for r in prefix_trie.prefix_trie(table).collect()), key=str) == brute_trie(rows)


def test_sketch_proves_singles_only(spark):
    rows = [(c, d, hashlib.sha256(str((d, c if d > 2 else 0)).encode()).digest()[:16]) for c in range(200) for d in range(1, 5)]
    table = spark.createDataFrame([(c, d, bytearray(k), None) for c, d, k in rows], "conv_id long, d long, key binary, parent binary")
    counts = {}
    for _, _, key in rows:
        counts[key] = counts.get(key, 0) + 1
    for bits, least in ((4, 0), (14, 0.95)):
        found = prefix_trie.screen(table, bits).collect()
        assert all(counts[bytes(r["key"])] == 1 for r in found if r["single"])
        assert sum(r["single"] for r in found) >= least * sum(n == 1 for n in counts.values())


def test_trie_of_empty_and_turnless_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "a")], schema)).count() == 0
    rows = [(5, 0, "user", "long " * 20_000), (7, 0, "user", "b")]
    assert sorted((tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, schema)).collect()), key=str) == brute_trie(rows)


# -- pieces --------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def both():
    with open(MODEL, "rb") as f:
        return piece_bpe.PieceBpe(f.read()), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts():
    rng = random.Random(11)
    parts = [*"abcdefghijklmnopqrstuvwxyzABC  \n\t\r.,;'\"éßüñ中文日本語😀▁́ﬁ0123\x00　�", "the", "ing", " th", "▁▁", "<s>", "<0x41>", "    "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    return [*texts, "", " ", " " * 700, "x" * 5000, "ab" * 3000, "的是中文" * 500, "\n" * 300, "aaaa " * 100, "1234567890" * 50]


def test_pieces_equal_the_library(both):
    own, library = both
    texts = odd_texts()
    found = [np.frombuffer(x, "<i4").tolist() for x in own.encode(texts)]
    assert found == library.encode(texts)
    assert [own.decode(x) for x in found] == [library.decode(x) for x in found]
    # A second time, from memory.
    assert [np.frombuffer(x, "<i4").tolist() for x in own.encode(texts)] == found


def test_any_ids_decode_like_the_library(both):
    own, library = both
    rng = random.Random(12)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(300), rng.randrange(own.size)]) for _ in range(rng.randrange(8))]
        assert own.decode(ids) == library.decode(ids)


def test_rounds_equal_the_queue(both):
    own, _ = both
    rng = random.Random(13)
    for _ in range(300):
        word = "".join(rng.choice(["a", "b", "the", "in", "g", "▁", "s", "es", "t"]) for _ in range(rng.randrange(1, 40)))
        code = np.array([ord(c) for c in word])
        queued = [s for s in own._queue(own.char_symbol[code].tolist()) if s != -2]
        assert own._rounds(code, np.array([0]))[0].tolist() == queued


def test_frames_of_pieces(spark, both):
    rows, none = frames(spark)
    _, library = both
    found = piece_bpe.decode(piece_bpe.encode(rows.withColumn("ids", F.lit("clash")), MODEL), MODEL).collect()
    assert len(found) == rows.count()
    for r in found:
        want = library.encode(r["text"] or "")
        assert r["ids"] == want and r["decoded"] == library.decode(want)
    assert sorted(map(str, piece_bpe.round_trip(rows, MODEL).select("doc_id", "ids", "decoded").collect())) == sorted(
        str(r) for r in piece_bpe.decode(piece_bpe.encode(rows, MODEL), MODEL).select("doc_id", "ids", "decoded").collect()
    )
    assert piece_bpe.round_trip(none, MODEL).count() == 0


def test_other_models_are_refused(tmp_path):
    with pytest.raises(ValueError):
        piece_bpe.PieceBpe(b"")
