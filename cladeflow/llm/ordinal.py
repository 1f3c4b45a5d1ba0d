"""Quality by ordinal regression: cumulative links over hashed text, expected grade and tail probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Hashed dimensions; rated documents that are fitted on, at most; features of one document are all used.
DIMENSIONS, TRAINING_ROWS = 1 << 18, 8_000
STEPS, RATE, RIDGE = 200, 0.3, 3e-4
#: Standard errors by which the mean grade of a feature's documents must differ from that of all to give it a weight.
TELLING = 4.0
GRADES = 3
#: Words that a worker remembers.
REMEMBERED = 100_000

# Signs that make a word's shape.
_SHAPES = {**{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "0" for c in "0123456789"}}


def _shape(word: str) -> str:
    """Runs of small letters, capitals and digits as one sign each; other signs as they are, repeats once."""
    out = []
    for c in word:
        s = _SHAPES.get(c) or ("a" if c.islower() else "A" if c.isupper() else c)
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out)


def _place(name: str) -> int:
    return xxhash.xxh32_intdigest(name.encode("utf-8", "surrogatepass")) % DIMENSIONS


def _letters(word: str) -> str:
    return "".join(c for c in word.lower() if c.isalnum())


class Features:
    """Hashed features of whole texts.

    Each distinct word gives its letters, weighted by log(1 + count); each word shape gives its share of the words, and
    the share of words that have come before is spread over ten steps.
    """

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def places(self, word: str) -> tuple[int, int]:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        found = self.known[word] = (_place("w:" + _letters(word)), _place("s:" + _shape(word)))
        return found

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places and values; places may repeat."""
        counts: dict[str, int] = {}
        words = text.split()
        for word in words:
            counts[word] = counts.get(word, 0) + 1
        if not words:
            return np.array([_place("empty")]), np.array([1.0])
        known = self.known
        places = np.array([known.get(w) or self.places(w) for w in counts], dtype=np.int64)
        n = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
        repeated = 1.0 - len(counts) / len(words)
        extra = np.array([_place(f"r:{int(10 * repeated)}"), _place("repeated")])
        # Shares are scaled so that one shape in all words weighs as much as a few telling words.
        return (
            np.concatenate([places[:, 0], places[:, 1], extra]),
            np.concatenate([np.log1p(n), 4.0 * n / len(words), [1.0, 4.0 * repeated]]),
        )


@dataclass
class Model:
    """Shared weights and ordered thresholds: P(grade > k) = σ(w·x − θ_k)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade ≥ 1), P(grade ≥ 2), … by row."""
        return 1.0 / (1.0 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -500, 500)))


def fit(places: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, n_grades: int = GRADES) -> Model:
    """Maximum likelihood of the cumulative logit model with a ridge, by full-batch adaptive gradient steps.

    `places` has each feature of a document once. Features whose documents are graded like all others keep weight
    zero: rare words would otherwise be learnt by heart.
    Thresholds are a first one and positive gaps, so they stay ordered. Deterministic: no sampling, starts at zero.
    Without rows every grade is equally likely.
    """
    start = np.log(np.arange(1, n_grades) / (n_grades - np.arange(1, n_grades)))
    weights = np.zeros(DIMENSIONS)
    if not len(grades):
        return Model(weights, start)
    sizes = np.array([len(p) for p in places])
    flat, x = np.concatenate(places), np.concatenate(values)
    row = np.repeat(np.arange(len(sizes)), sizes)
    n = np.maximum(np.bincount(flat, minlength=DIMENSIONS), 1)
    mean = np.bincount(flat, weights=grades[row], minlength=DIMENSIONS) / n
    told = (np.abs(mean - grades.mean()) * np.sqrt(n) > TELLING * max(grades.std(), 1e-9))[flat]
    flat, x, row = flat[told], x[told], row[told]
    used, inverse = np.unique(flat, return_inverse=True)
    seen = np.minimum(np.maximum(np.bincount(grades, minlength=n_grades)[::-1].cumsum()[::-1][1:] / len(grades), 1e-3), 1 - 1e-3)
    prior = -np.log(seen / (1 - seen))
    params = np.concatenate([[prior[0]], np.log(np.maximum(np.diff(prior), 1e-2)), np.zeros(len(used))])
    squares = np.full(len(params), 1e-8)
    k = n_grades - 1
    for _ in range(STEPS):
        theta = np.concatenate([[params[0]], params[0] + np.cumsum(np.exp(params[1:k]))])
        score = np.bincount(row, weights=params[k:][inverse] * x, minlength=len(sizes))
        tail = 1.0 / (1.0 + np.exp(-np.clip(score[:, None] - theta[None, :], -50, 50)))
        full = np.concatenate([np.ones((len(sizes), 1)), tail, np.zeros((len(sizes), 1))], axis=1)
        chance = np.maximum(full[np.arange(len(sizes)), grades] - full[np.arange(len(sizes)), grades + 1], 1e-12)
        slope = full * (1 - full)
        upper, lower = slope[np.arange(len(sizes)), grades], slope[np.arange(len(sizes)), grades + 1]
        by_score = -(upper - lower) / chance / len(sizes)
        by_theta = np.zeros(k)
        np.add.at(by_theta, grades[grades > 0] - 1, (upper / chance / len(sizes))[grades > 0])
        np.add.at(by_theta, grades[grades < k], -(lower / chance / len(sizes))[grades < k])
        after = by_theta[::-1].cumsum()[::-1]
        gradient = np.concatenate([
            [after[0]], after[1:] * np.exp(params[1:k]),
            np.bincount(inverse, weights=by_score[row] * x, minlength=len(used)) + RIDGE * params[k:],
        ])
        squares += gradient**2
        params -= RATE * gradient / np.sqrt(squares)
    weights[used] = params[k:]
    return Model(weights, np.concatenate([[params[0]], params[0] + np.cumsum(np.exp(params[1:k]))]))


def grade_of(quality: Column, toxic: Column) -> Column:
    """The graded rating: 0 for low quality, 1 for good text that is toxic, 2 for good text that is not; null without quality."""
    return F.when(quality == 0, 0).when((quality == 1) & (toxic == 1), 1).when(quality == 1, 2)


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAINING_ROWS, seed: int = 4) -> Model:
    """Fit on at most `most` rated documents, those whose seeded digest of the id is least.

    `ratings` has the id and `grade` (0 … GRADES − 1); null grades are left out; an id that is rated more than once has
    its least grade. The bounded sample is the only thing that reaches the driver, as features.
    """
    rated = ratings.where(F.col("grade").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min("grade").alias("_grade"))
    chosen = rated.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string"))), "_id").limit(most)
    one_text = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    sample = one_text.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_id", "_grade", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [features.of(t or "") for t in batch.column("_text").to_pylist()]
            merged = [_merge(p, v) for p, v in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_grade"), pa.array([m[0] for m in merged], pa.list_(pa.int32())), pa.array([m[1] for m in merged], pa.list_(pa.float32()))],
                names=["_id", "_grade", "places", "values"],
            )

    schema = sample.drop("_text").schema.add("places", T.ArrayType(T.IntegerType())).add("values", T.ArrayType(T.FloatType()))
    rows = sample.mapInArrow(run, schema).toArrow()
    order = np.argsort(rows["_id"].to_numpy(), kind="stable") if rows.num_rows else np.array([], dtype=int)
    places, values = rows["places"].combine_chunks(), rows["values"].combine_chunks()
    columns = [[np.asarray(c[int(i)].values, dtype=t) for i in order] for c, t in ((places, np.int64), (values, np.float64))]
    grades = rows["_grade"].to_numpy().astype(np.int64)[order] if rows.num_rows else np.array([], dtype=np.int64)
    return fit(*columns, grades)


def _merge(places: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    used, inverse = np.unique(places, return_inverse=True)
    return used.astype(np.int32), np.bincount(inverse, weights=values).astype(np.float32)


_REMEMBERED: dict[str, Features] = {}


def grade(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`row, expected_grade, tail_1 … tail_k`: every whole text rated; `row` holds the document's columns.

    Null texts count as empty; texts without words have one feature of their own. The model sent to the executors has a
    fixed size. An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("_text"))
    tails = [f"tail_{k + 1}" for k in range(len(model.thresholds))]
    schema = rows.drop("_text").schema.add("expected_grade", "double")
    for name in tails:
        schema = schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = sent.value
        features = _REMEMBERED.setdefault("one", Features())
        own = Model(weights, thresholds)
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column("_text").to_pylist()):
                places, values = features.of(text or "")
                scores[i] = float(weights[places].astype(np.float64) @ values)
            found = own.tails(scores)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(found.sum(axis=1)), *[pa.array(found[:, k]) for k in range(found.shape[1])]],
                names=["row", "expected_grade", *tails],
            )

    return rows.mapInArrow(run, schema)


def select_good(docs: DataFrame, model: Model, text_col: str = "text", least: int = GRADES - 1, chance: float = 0.5) -> DataFrame:
    """The documents whose tail probability P(grade ≥ least) is at least `chance`, with the columns of the input."""
    return grade(docs, model, text_col).where(F.col(f"tail_{least}") >= chance).select("row.*")
