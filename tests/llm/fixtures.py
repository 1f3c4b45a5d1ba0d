"""Small tables with the cases that every operator must survive."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, size int, n long, drop int"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edge_rows():
    """Null ids, texts and sources, empty, blank and very long texts, ties and repeated rows, columns that clash."""
    rng = random.Random(5)
    long = " ".join(words(rng, 30_000))
    texts = [None, "", " \n\t\n", long, "one", "one", "one two three four five six\n" * 50, "É ß 😀 a b\x00c", "x" * 5000]
    rows = [(i, t, "en", ("a", "b", None)[i % 3]) for i, t in enumerate(texts)]
    rows += [(None, "no id", None, None), (None, None, None, "b"), (3, long, "en", "a"), (3, long, "en", "a"), (4, "two", "en", "z")]
    return [(*r, None if r[1] is None else len(r[1]), "clash", 7, 8, 9) for r in rows]


def frames(spark):
    """The edge table and an empty one."""
    rows = spark.createDataFrame(edge_rows(), DOCS)
    return rows, rows.where("false")
