import math
import os
import random
import re
from collections import defaultdict

import numpy as np
import xxhash
from fixtures import edge_rows, frames
from pyspark.sql import functions as F

from cladeflow.llm import fuzzy_lines, nn_descent, trie_simhash
from cladeflow.llm.common import components


def groups_of(n, links):
    """The least member of each node's connected group."""
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def brute_simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 400)] + [(0, i) for i in range(1, 60)] + [(rng.randrange(500, 600), rng.randrange(500, 600)) for _ in range(60)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = groups_of(600, edges)
    assert found == {i: want[i] for e in edges if e[0] != e[1] for i in e}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def near(rng, base, copies, most):
    return [base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(most + 1))) for _ in range(copies)]


def test_trie_join_equals_all_pairs(spark):
    rng = random.Random(2)
    values = [rng.getrandbits(64) for _ in range(300)] + [0, 2**64 - 1]
    for v in values[:40]:
        values += near(rng, v, 5, 4)
    values += near(rng, values[0], 900, 6)
    v = np.unique(np.array(values, dtype=np.uint64))
    links = [(i, int(j)) for i in range(len(v)) for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= 3) if j > i]
    want = groups_of(len(v), links)
    rows = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fingerprint long")
    for aimed, most in ((64, 20_000), (1, 20_000), (10_000, 20_000), (256, 700)):
        edges = trie_simhash.fingerprint_links(rows, aimed, most)
        place = {int(x): i for i, x in enumerate(v.view(np.int64))}
        assert groups_of(len(v), [(place[r["a"]], place[r["b"]]) for r in edges.collect()]) == want, (aimed, most)


def test_fingerprints_and_groups_of_texts(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(60))) for _ in range(80)]
    for t in texts[:30]:
        words = t.upper().split() or ["X"]
        words[rng.randrange(len(words))] = "changed"
        texts += ["\t".join(words), t + " ", t]
    rows = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string")
    marks = [brute_simhash(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 3]
    want = groups_of(len(texts), links)
    found = {r["doc_id"]: (r["fingerprint"] % 2**64, r["component_id"]) for r in trie_simhash.simhash_groups(rows).select("row.doc_id", "fingerprint", "component_id").collect()}
    assert found == {i * 3: (marks[i], want[i] * 3) for i in range(len(texts))}
    kept = trie_simhash.one_of_each(rows)
    assert kept.columns == rows.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({w * 3 for w in want})


def test_near_duplicates_of_odd_tables(spark):
    rows, empty = frames(spark)
    found = trie_simhash.simhash_groups(rows)
    assert found.count() == rows.count()
    zero = {r["doc_id"]: r["component_id"] for r in found.where("fingerprint = 0").select("row.doc_id", "component_id").collect()}
    assert zero == {0: 0, 1: 0, 2: 0, None: 0}
    kept = trie_simhash.one_of_each(rows)
    assert kept.columns == rows.columns and kept.where("doc_id = 3").count() == 1
    assert trie_simhash.simhash_groups(empty).count() == 0 and trie_simhash.one_of_each(empty).count() == 0


# -- lines -----------------------------------------------------------------------------------------------------------


def word_hashes(line):
    return [xxhash.xxh64_intdigest(w.encode(), 42) for w in line]


def pair_hashes(line):
    """Spark hashes several columns in turn, each seeded by the hash of those before; a missing word leaves the seed."""
    if len(line) == 1:
        return word_hashes(line)
    return [xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42)) for a, b in zip(line, line[1:])]


def brute_bits(hashes):
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def brute_lines(docs):
    """The text that each document keeps, from all pairs of distinct lines."""
    seen = [(d, p, tuple(line.lower().split())) for d, t in dict(docs).items() for p, line in enumerate((t or "").split("\n")) if line.split()]
    lines = sorted({s[2] for s in seen})
    place, hashes = {w: i for i, w in enumerate(lines)}, [word_hashes(w) for w in lines]
    bits = [brute_bits(pair_hashes(w)) for w in lines]
    signs = [[(x - 2**64 if x >> 63 else x) % fuzzy_lines.SIGNS for x in h] for h in hashes]
    links = [
        (i, j) for i in range(len(lines)) for j in range(i)
        if (bits[i] ^ bits[j]).bit_count() <= fuzzy_lines.BITS
        and edits(signs[i], signs[j]) <= (1 - fuzzy_lines.SIMILAR) * max(len(signs[i]), len(signs[j])) + 1e-9
    ]
    group, taken, kept = groups_of(len(lines), links), set(), defaultdict(set)
    for d, p, w in sorted(seen, key=lambda s: (s[0] is None, s[0] or 0, s[1])):
        if group[place[w]] not in taken:
            taken.add(group[place[w]])
            kept[d].add(p)
    return {d: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if not x.split() or p in kept[d]) for d, t in docs}, len(links)


def test_line_simhash_of_short_and_long_lines(spark):
    rng = random.Random(4)
    lines = [[f"w{rng.randrange(5000)}" for _ in range(n)] for n in (1, 2, 3, 50, 126, 127, 128, 129, 255, 256, 1000, 33_000)]
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lines)], "doc_id long, text string")
    found = {r["first"]["doc"]: r["sim"] % 2**64 for r in fuzzy_lines.line_classes(rows).collect()}
    assert found == {i: brute_bits(pair_hashes(w)) for i, w in enumerate(lines)}


def test_fuzzy_lines_equal_all_pairs(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(2000)}" for _ in range(rng.randrange(1, 60))] for _ in range(40)]
    docs = []
    for d in range(120):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            words = list(rng.choice(base))
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(2000)}"
            lines.append(rng.choice(("  ", " ", "\t")).join(words).upper() if rng.random() < 0.3 else " ".join(words))
        docs.append((d, "\n".join(lines)))
    docs += [(500, None), (501, ""), (502, "\n \n")]
    want, links = brute_lines(docs)
    found = fuzzy_lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).select("row.doc_id", "text").collect()
    assert links > 5 and {r["doc_id"]: r["text"] for r in found} == want


def kept_lines(spark, lines):
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return {r["doc_id"] for r in fuzzy_lines.dedup_lines(rows).select("row.doc_id", "text").collect() if r["text"]}


def all_pairs_kept(lines):
    """The first line of each group by word edits alone."""
    words = [line.split() for line in lines]
    links = [(i, j) for i in range(len(words)) for j in range(i) if 5 * edits(words[i], words[j]) <= max(len(words[i]), len(words[j]))]
    return set(groups_of(len(words), links))


def test_lines_are_linked_by_edits_alone(spark):
    rng = random.Random(11)
    lines = []
    for n in [*range(3, 34), 40, 64, 90]:
        base = [f"w{rng.randrange(3000)}" for _ in range(n)]
        lines.append(" ".join(base))
        for most in (n // 5, n // 5, n // 5 + 1, n // 5 + 1):
            words = list(base)
            for _ in range(most):
                at = rng.randrange(len(words))
                rng.choice((lambda: words.pop(at), lambda: words.insert(at, f"x{rng.randrange(10**6)}"), lambda: words.__setitem__(at, f"y{rng.randrange(10**6)}")))()
            lines.append(" ".join(words))
    lines = sorted(set(lines), key=lines.index)
    assert kept_lines(spark, lines) == all_pairs_kept(lines)


def test_lines_of_one_simhash_are_all_compared(spark):
    lines = [" ".join(["-"] * n) for n in (200, 90, 6, 7, 30, 33, 60, 64, 85, 12)] + [" ".join(["0"] * n + [f"e{n}"]) for n in (40, 100, 43, 20, 104)]
    kept = all_pairs_kept(lines)
    assert kept_lines(spark, lines) == kept and 5 < len(kept) < len(lines)


def test_lines_with_one_passage_are_not_paired(spark, monkeypatch):
    """Long lines that share most of their words, none alike: their comparisons follow their number, not its square."""
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(180)]
    lines = [" ".join([f"w{rng.randrange(10**9)}" for _ in range(60)] + passage + [f"w{rng.randrange(10**9)}" for _ in range(60)]) for _ in range(150)]
    compared, verified = [], fuzzy_lines._verified

    def counted(pairs, classes):
        compared.append(pairs.distinct().count())
        return verified(pairs, classes)

    monkeypatch.setattr(fuzzy_lines, "_verified", counted)
    assert kept_lines(spark, lines) == set(range(150)) and sum(compared) < 10 * len(lines)


def test_lines_of_odd_tables(spark):
    rows, empty = frames(spark)
    found = fuzzy_lines.dedup_lines(rows).select("row.doc_id", F.col("row.text").alias("given"), "text", "n_lines", "n_dropped").collect()
    assert len(found) == len(edge_rows())
    by = defaultdict(set)
    for r in found:
        by[r["doc_id"]].add((r["given"], r["text"], r["n_dropped"]))
    assert by[0] == {(None, None, 0)} and by[1] == {("", "", 0)} and by[2] == {(" \n\t\n", " \n\t\n", 0)}
    assert by[5] == {("one", "", 1)} and by[4] == {("one", "one", 0), ("two", "two", 0)}
    (given, text, dropped), = by[6]
    assert dropped == 49 and text == "one two three four five six\n"
    assert len(by[3]) == 1 and all(d == 0 for _, _, d in by[3])
    assert fuzzy_lines.dedup_lines(empty).count() == 0


def test_word_levels_are_of_all_lines(spark):
    n = 150_000
    lines = spark.range(n).select(F.col("id").alias("c"), F.concat(F.lit("same w"), "id").alias("line"))
    levels = np.frombuffer(fuzzy_lines.word_levels(lines), np.uint8).reshape(2, -1)
    sign = word_hashes(["same"])[0]
    sign = (sign - 2**64 if sign >> 63 else sign) % fuzzy_lines.SIGNS
    signs = [(x - 2**64 if x >> 63 else x) % fuzzy_lines.SIGNS for x in word_hashes(f"w{i}" for i in range(n))]
    cells = [(x % fuzzy_lines.CELLS, x // (fuzzy_lines.SIGNS // fuzzy_lines.CELLS)) for x in [*signs, *[sign] * n]]
    for row in (0, 1):
        counts = np.bincount([c[row] for c in cells], minlength=fuzzy_lines.CELLS)
        assert levels[row].tolist() == [round(3 * math.log2(x)) if x else 0 for x in counts]
    # The plan, which the driver keeps in text, holds no more than these.
    assert levels.nbytes <= 1 << 15


def test_lines_leave_little_scratch(spark):
    rng = random.Random(13)
    lines = [" ".join(f"w{rng.randrange(60)}" for _ in range(12)) for _ in range(400)]
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    kept_lines(spark, lines)
    left = [name.rpartition("-")[0] for name in set(os.listdir(folder)) - before]
    assert "lines" in left and not {"named", "open", "mixed", "keys"} & {*left}


# -- vectors ---------------------------------------------------------------------------------------------------------


def brute_vectors(rows):
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = nn_descent.matrix([rows[i][1] for i in good])
    linked = (x @ x.T) >= nn_descent.THRESHOLD
    counts = [0] * len(rows)
    links = []
    for a, i in enumerate(good):
        counts[i] = int(linked[a].sum()) - 1
        links += [(i, good[b]) for b in np.flatnonzero(linked[a]) if b > a]
    return counts, groups_of(len(rows), links)


def test_vector_links_equal_all_pairs(spark):
    rng = np.random.default_rng(6)
    rows = []
    for size, noise in ((1, 0), (2, 0.03), (5, 0.03), (60, 0.03), (200, 0.05), (30, 0.0)):
        centre = rng.standard_normal(24)
        rows += [(centre + noise * rng.standard_normal(24)).astype(np.float32).tolist() for _ in range(size)]
    rows += [rng.standard_normal(24).astype(np.float32).tolist() for _ in range(500)]
    rows += [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23]
    rows = [(i, v) for i, v in enumerate(rows)]
    counts, groups = brute_vectors(rows)
    found = {r["vec_id"]: r for r in nn_descent.vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert all(r["audited_recall"] >= 0.99 for r in found.values())
    assert [found[i]["n_links"] for i in range(len(rows))] == counts
    assert [found[i]["component_id"] for i in range(len(rows))] == groups
    assert all(found[i]["kept"] == (groups[i] == i) for i in range(len(rows)))


def vectors_found(spark, rows):
    found = {r["vec_id"]: r for r in nn_descent.vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    return [found[i]["n_links"] for i in range(len(rows))], [found[i]["component_id"] for i in range(len(rows))]


def test_links_between_two_tight_groups(spark):
    rng = np.random.default_rng(8)
    angle = np.arccos(0.935)
    centres = np.zeros((2, 32))
    centres[0, 0], centres[1, :2] = 1, (np.cos(angle), np.sin(angle))
    rows = [(i, (centres[i % 2] + 0.005 * rng.standard_normal(32)).astype(np.float32).tolist()) for i in range(120)]
    counts, groups = brute_vectors(rows)
    assert min(counts) == 119 and set(groups) == {0}
    assert vectors_found(spark, rows) == (counts, groups)


def test_audit_sees_lost_pairs(spark):
    rng = np.random.default_rng(9)
    centres = [rng.standard_normal(32) for _ in range(51)]
    rows = [(i, (centres[i // 2] + 0.01 * rng.standard_normal(32)).astype(np.float32).tolist(), 1000) for i in range(100)]
    rows += [(i, (centres[50] + 0.01 * rng.standard_normal(32)).astype(np.float32).tolist(), 1000) for i in range(100, 200)]
    # Half of the pairs are lost, the large group is not.
    found = [(i, 2000 if i < 50 else 1000, int(i < 50)) for i in range(100)] + [(i, 100_000, 99) for i in range(100, 200)]
    vectors = spark.createDataFrame(rows, "c long, vec array<float>, n long")
    assert nn_descent.audit(vectors, spark.createDataFrame(found, "c long, links long, others long"), 32) == 0.75
    for n in (2_500, 100_000, 1_000_000, 10_000_000):
        shared = (1 - np.arccos(0.9) / np.pi) ** nn_descent.planes_of(n)
        assert 1 - (1 - shared) ** nn_descent.tables_of(n) >= 0.99


def test_audit_where_links_are_rare(spark):
    rng = np.random.default_rng(10)
    x = rng.standard_normal((20_000, 32))
    x[:100:2] = x[1:100:2] + 0.01 * rng.standard_normal((50, 32))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "c long, vec array<double>")
    nothing = spark.createDataFrame([], "c long, links long, others long")
    assert nn_descent.audit(vectors, nothing, 32) == 0
    alone = spark.createDataFrame([(i, np.eye(64)[i].tolist()) for i in range(64)], "c long, vec array<double>")
    assert nn_descent.audit(alone, nothing, 64, first=16, most=16) is None
    assert nn_descent.audit(alone, nothing, 64) == 1.0


def test_parts_of_a_group_are_shuffled_apart(spark):
    rows = spark.createDataFrame([(0, 1, [1.0, 0.0], 1)], "component long, c long, vec array<float>, n long")
    plan = nn_descent.count_links(rows, 2)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(component#\d+L, i#\d+, j#\d+", plan)


def test_vectors_in_double_precision(spark):
    # Rounded to floats, the cosine of the first two is above the threshold; squares of the last two overflow.
    y = 0.9 - 1e-12
    rows = [(0, [1.0, 0.0, 0.0]), (1, [y, math.sqrt(1 - y * y), 0.0]), (2, [0.0, 0.0, 1e200]), (3, [0.0, 0.0, 1e-200])]
    found = nn_descent.vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == [(0, 0, 0), (1, 0, 1), (2, 1, 2), (3, 1, 2)]


def test_vector_blocks_add_up(spark):
    rng = np.random.default_rng(7)
    centre = rng.standard_normal(8)
    rows = [(0, i, (centre + 0.3 * rng.standard_normal(8)).astype(np.float32).tolist(), 1 + i % 3) for i in range(2500)]
    x, n = nn_descent.matrix([r[2] for r in rows]), np.array([r[3] for r in rows])
    want = ((x @ x.T) >= nn_descent.THRESHOLD) @ n
    found = nn_descent.count_links(spark.createDataFrame(rows, "component long, c long, vec array<float>, n long"), 8).collect()
    assert {r["c"]: r["links"] for r in found} == dict(enumerate(want.tolist()))


def test_vectors_of_odd_tables(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 5), (1, [1.0, 0.0], 5), (None, [1.0, 0.1], 5), (7, [3.0], 5), (8, None, 5)], "vec_id long, embedding array<float>, n int")
    found = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in nn_descent.vector_groups(rows).collect())
    assert found == [(0, 3, 1, False), (1, 3, 1, True), (1, 3, 1, True), (7, 3, 1, False), (8, 0, 8, True)]
    assert nn_descent.vector_groups(rows.where("false")).count() == 0
