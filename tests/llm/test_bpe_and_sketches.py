import hashlib
import random

import pytest
from fixtures import edge_rows, frames

from cladeflow.llm import bpe, iblt

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def odd_texts():
    rng = random.Random(6)
    alphabet = "ab'srtveldmn  \t\n\r\x0b\x1c\x85\xa0 éß中Ⅷ²½٣_-.,<|>\U0001f600́"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300)]
    return [*texts, "<|endoftext|>a<|endoftext|> <|endoftext", "it's we'll I'D", "z" * 3000, "", "\x00\x01"]


def test_ids_and_text_equal_the_library(spark):
    library = tokenizers.Tokenizer.from_file(PATH)
    texts = odd_texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = bpe.decode(bpe.encode(rows, PATH), PATH).orderBy("i").collect()
    for row, encoded in zip(found, library.encode_batch(texts, add_special_tokens=False)):
        assert list(row["ids"]) == encoded.ids, row["text"]
        assert row["decoded"] == library.decode(encoded.ids, skip_special_tokens=False) == row["text"]


def test_broken_bytes_decode_like_the_library(spark):
    library = tokenizers.Tokenizer.from_file(PATH)
    coder = bpe.ByteBpe(open(PATH, encoding="utf-8").read())
    ids = [coder.byte_ids[b] for b in (0xE2, 0x82, 0x41, 0xFF, 0xC3)]
    assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_merging_equals_the_plain_definition():
    coder = bpe.ByteBpe(open(PATH, encoding="utf-8").read())

    def plain(ids):
        while True:
            best = min(((coder.merges[a << bpe.PACK | b], i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if a << bpe.PACK | b in coder.merges), default=None)
            if best is None:
                return ids
            i = best[1]
            ids = [*ids[:i], best[0] & ((1 << bpe.PACK) - 1), *ids[i + 2 :]]

    rng = random.Random(7)
    for _ in range(300):
        word = [coder.byte_ids[rng.choice(b" etaoinshrthandaaa")] for _ in range(rng.randrange(1, 25))]
        assert coder.merge(list(word)) == plain(word)


def test_bpe_of_odd_tables(spark):
    rows, empty = frames(spark)
    found = bpe.decode(bpe.encode(rows, PATH), PATH).collect()
    assert sorted(r["decoded"] for r in found) == sorted(r[1] or "" for r in edge_rows())
    assert all(r["row"] == "clash" for r in found)
    assert bpe.decode(bpe.encode(empty, PATH), PATH).count() == 0


def test_peeling_recovers_what_differs():
    rng = random.Random(8)
    for n, m, shared in ((0, 0, 0), (0, 0, 30), (1, 0, 0), (5, 7, 100), (300, 1, 50), (1000, 1200, 3000)):
        def draw(k):
            return {rng.getrandbits(64) for _ in range(k)}

        both, left, right = draw(shared), draw(n), draw(m)
        assert iblt.difference(both | left, both | right) == (left, right)
        total = 2 * shared + n + m
        assert iblt.likeness(both | left, both | right) == pytest.approx(2 * shared / total if total else 1.0)


def brute_next(rows):
    """Each text with the one that follows in descending id, null ids last, texts of one id by digest."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    return [(a[0], a[1], b[1]) for a, b in zip(order, order[1:] + order[:1])]


def check_edits(spark, rows):
    found = iblt.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"], r["edited_sha256"], round(r["near_next"], 9), round(r["near_edited"], 9)) for r in found)
    want = []
    for i, text, after in brute_next([(i, t or "") for i, t in rows]):
        n = len(text) // 3
        edit = text[: len(text) - n] + after[:n]
        near = []
        for other in (after, edit):
            a, b = iblt.pieces(text), iblt.pieces(other)
            near.append(round(2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0, 9))
        want.append((i is None, i or 0, len(text), hashlib.sha256(edit.encode()).hexdigest(), *near))
    assert got == sorted(want)
    marks = {}
    for r in found:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    return marks


def test_edits_follow_the_order_of_ids(spark):
    rng = random.Random(9)
    ids = rng.sample(range(10**9), 700)
    rows = [(i, "\n".join(" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(40))) for _ in range(rng.randrange(6)))) for i in ids]
    check_edits(spark, rows)
    check_edits(spark, [(5, "alone\ntext")])
    check_edits(spark, [(r[0], r[1]) for r in edge_rows()])


def test_equal_texts_have_equal_fingerprints(spark):
    rows = [(i, f"same text {i % 4}\nand more") for i in range(40)]
    found = iblt.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({(r["doc_id"] % 4, r["fingerprint"]) for r in found}) == 4
    rows, empty = frames(spark)
    assert iblt.fingerprint_edits(rows).count() == rows.count() and iblt.fingerprint_edits(empty).count() == 0


def test_next_documents_of_repeated_and_null_ids(spark):
    rng = random.Random(4)
    rows = [(i, f"text {rng.random()}") for i in rng.sample(range(10_000), 1200)]
    rows += [(5_000, f"hot {rng.random()}") for _ in range(700)] + [(None, f"none {rng.random()}") for _ in range(700)]
    rows += [(rows[0][0], "twice"), (7, None), (7, "")]
    rng.shuffle(rows)
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    want = [(d, t, order[(i + 1) % len(order)][1]) for i, (d, t) in enumerate(order)]
    found = iblt.with_next(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", per_bucket=1)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)
    buckets = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in buckets
