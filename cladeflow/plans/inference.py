"""From sequences to classified sequences and genomes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from cladeflow.functions import sequence as S, vectors as V
from cladeflow.operators import aggregate, taxonomy, windows


def score_windows(
    df: DataFrame, window: str, width: int, load_model: Callable[[], Callable], n_classes: int, batch: int = 256, out: str = "output"
) -> DataFrame:
    """Class vectors of windows from a user model.

    `load_model` runs once per worker and returns a function from an integer matrix (windows × `width` residue codes) to
    a matrix of class values (windows × `n_classes`). Windows travel as text in Arrow batches; one table lookup per batch
    turns their bytes into codes. Residues outside the alphabet become N; a NULL window has a NULL output.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, DoubleType

    vocab, pad = S.DNA_VOCAB, S.PAD

    def make():
        import numpy as np

        model = load_model()
        codes = np.full(256, vocab.index(pad), dtype=np.int32)
        for code, letter in enumerate(vocab):
            codes[ord(letter)] = codes[ord(letter.lower())] = code

        def predict(texts):
            residues = np.frombuffer("".join(texts).encode("ascii"), dtype=np.uint8)
            return np.asarray(model(codes[residues].reshape(len(texts), width)), dtype=np.float64)

        return predict

    score = predict_batch_udf(make, return_type=ArrayType(DoubleType()), batch_size=batch)
    clean = S.pad_seq(S.clean_dna(F.coalesce(F.col(window), F.lit(""))), width)
    return df.withColumn(out, F.when(F.col(window).isNotNull(), score(clean)))


def infer_sequences(
    seqs: DataFrame,
    seq: str,
    width: int,
    step: int,
    load_model: Callable[[], Callable],
    n_classes: int,
    batch: int = 256,
) -> DataFrame:
    """Windows cut, padded, scored and made probabilities: the columns of `seqs` but for the residues, `start, p`."""
    cuts = windows.window_for_inference(seqs, seq, width, step)
    scored = score_windows(cuts, "window", width, load_model, n_classes, batch)
    return scored.withColumn("p", V.softmax(F.col("output"))).drop("window", "output", "end")


def classify_sequences(outputs: DataFrame, taxa: DataFrame, leaf: str, ranks: Sequence[str], filename: str, seq_id: str, vec: str = "p") -> DataFrame:
    """Window probabilities to one row per sequence: file name, id, ranks and score."""
    means = aggregate.mean_outputs(outputs, [filename, seq_id], vec)
    preds = means.select(filename, seq_id, V.argmax(F.col(vec)).alias("pred"), F.array_max(vec).alias("score"))
    return taxonomy.classification_table(preds, taxa, leaf, ranks)


def infer_summary(
    chunks: DataFrame, lengths: DataFrame, taxa: DataFrame, leaf: str, levels: Sequence[str], k: int = 2, hierarchy: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(sequence table, genome table), one row per id and level.

    `chunks` is `seq_id, genome_id, p`, `lengths` is `seq_id, genome_id, length`. Windows are pooled per sequence, and
    from window sums per genome; ranks follow from the pooled vectors. Genomes get their assembly statistics.
    """
    by_seq = aggregate.mean_outputs(chunks, ["seq_id", "genome_id"], "p")
    # Genome means over windows: sequence means weighted by their window counts, from far fewer rows.
    by_genome = aggregate.mean_outputs(by_seq, ["genome_id"], "p", weight="n_chunks").drop("n_chunks")

    def predict(pooled, key):
        rolled = taxonomy.roll_up(pooled, [key], "p", taxa, leaf, levels)
        if hierarchy:
            return taxonomy.predict_hierarchical(rolled, taxa, [key], levels, k)
        return taxonomy.level_predictions(rolled, [key], k)

    sizes = lengths.select("seq_id", "length")
    sequences = predict(by_seq, "seq_id").join(sizes, "seq_id")
    stats = aggregate.assembly_stats(lengths, "genome_id", "length")
    totals = aggregate.genome_lengths(lengths, "genome_id", "length")
    genomes = predict(by_genome, "genome_id").join(totals, "genome_id").join(stats, "genome_id")
    return sequences, genomes
