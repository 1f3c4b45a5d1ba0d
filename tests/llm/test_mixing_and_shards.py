import math
import random
import zlib
from collections import defaultdict

from fixtures import frames
from pyspark.sql import functions as F

from cladeflow.llm import mixing, shards


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, full = share * sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in full]
        level = (budget - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in free) if free else math.inf
        over = {s for s in free if most * sizes[s] <= level * weight[s]}
        if not over:
            return {s: most * sizes[s] if s in full else level * weight[s] for s in sizes}
        full |= over


def test_targets_are_filled_up_to_their_stop(spark):
    rng = random.Random(2)
    for n in (1, 2, 5, 12):
        sizes = {f"s{i:02d}" if i else None: rng.choice((0, 3, 50, 1000, rng.randrange(1, 10**6))) for i in range(n)}
        rows = spark.createDataFrame([(s, z) for s, z in sizes.items()], "source string, size long")
        found = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
        want = brute_targets(sizes)
        assert all(abs(found[s] - want[s]) <= 1e-9 * max(1, want[s]) for s in sizes)


def test_copies_come_near_the_targets_and_repeat(spark):
    rows = spark.createDataFrame([(i, "a b c d", f"s{i % 3}") for i in range(6000)], "doc_id long, text string, source string")
    plan = mixing.mix_plan(rows).select("row.doc_id", "row.source", "size", "target", "copies").toPandas()
    again = mixing.mix_plan(rows.repartition(7)).select("row.doc_id", "copies").toPandas()
    assert dict(zip(plan.doc_id, plan.copies)) == dict(zip(again.doc_id, again.copies))
    assert plan.copies.max() <= 2
    for _, part in plan.groupby("source"):
        assert abs((part["size"] * part.copies).sum() - part.target.iloc[0]) <= 0.06 * part.target.iloc[0]
    mixed = mixing.mix_sources(rows)
    assert mixed.columns == rows.columns and mixed.count() == plan.copies.sum()


def test_mix_of_odd_tables(spark):
    rows, empty = frames(spark)
    plan = mixing.mix_plan(rows)
    assert plan.count() == rows.count() and plan.where("size * copies > 2 * size or target is null").count() == 0
    assert mixing.mix_sources(rows).columns == rows.columns
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix_sources(empty).count() == 0


def brute_capacity(sizes, n):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, held = (low + high) // 2, 1, 0
        for s in sizes:
            if held + s > mid:
                used, held = used + 1, 0
            held += s
        low, high = (low, mid) if used <= n else (mid + 1, high)
    return low


def check_shards(rows, n=8):
    found = shards.minimax_shards(rows, n).collect()
    import hashlib

    texts = [(r["text"] or "") for r in rows.collect()]
    groups = defaultdict(int)
    for t in texts:
        groups[hashlib.md5(t.encode()).hexdigest()] += len(t.encode()) + 1
    loads, slots = defaultdict(int), defaultdict(list)
    for r in found:
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert sorted(r["text_crc32"] for r in found) == sorted(zlib.crc32(t.encode()) for t in texts)
    assert len({(r["text_crc32"], r["size"], r["shard"]) for r in found}) == len(set(texts))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads.values()) == brute_capacity([groups[k] for k in sorted(groups)], n)


def test_shards_have_the_least_greatest_size(spark):
    rng = random.Random(4)
    for count, n in ((3, 8), (60, 8), (500, 8), (300, 5)):
        rows = [(i, None if rng.random() < 0.05 else "x" * int(rng.paretovariate(0.8)) + str(rng.randrange(count))) for i in range(count)]
        rows += [(1000 + i, "copy " * 40) for i in range(count // 3)]
        check_shards(spark.createDataFrame(rows, "doc_id long, text string"), n)


def test_shards_of_odd_tables(spark):
    rows, empty = frames(spark)
    check_shards(rows)
    assert shards.minimax_shards(empty).count() == 0
    assert shards.minimax_shards(rows).agg(F.count(F.lit(1))).first()[0] == rows.count()
