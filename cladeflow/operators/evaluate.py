"""Accuracy of predictions by rank, class, base, length and score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cladeflow.operators import ordering, taxonomy
from cladeflow.session import settle


def join_truth(inputs: DataFrame, preds: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Every input with its prediction, NULL where there is none, and its truth."""
    return inputs.join(preds, key, "left").join(truth, key)


def taxonomic_accuracy(preds: DataFrame, taxa: DataFrame, leaf: str, levels: Sequence[str], length: str) -> DataFrame:
    """`level, n, seq_acc, base_acc, present, total` from leaf classes `label` and `pred`.

    Every input counts: a prediction that is NULL or no class of the taxa is wrong, and so is any for an unknown label.
    Equal (label, pred) pairs are counted first: joins and ranks then work on at most classes² rows.
    """
    pairs = preds.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("_n"), F.sum(length).alias("_bases"))
    named = taxonomy.level_map(taxa, leaf, levels)
    truth = named.select(F.col("class").alias("label"), "level", F.col("taxon").alias("_truth"))
    guess = named.select(F.col("class").alias("pred"), "level", F.col("taxon").alias("_guess"))
    every = pairs.select("*", F.explode(F.array(*map(F.lit, levels))).alias("level"))
    rows = every.join(truth, ["label", "level"], "left").join(guess, ["pred", "level"], "left")
    same = F.col("_truth") == F.col("_guess")
    scored = rows.groupBy("level").agg(
        F.sum("_n").alias("n"),
        (F.sum(F.when(same, F.col("_n")).otherwise(0)) / F.sum("_n")).alias("seq_acc"),
        F.try_divide(F.sum(F.when(same, F.col("_bases")).otherwise(0)), F.sum("_bases")).alias("base_acc"),
        F.count_distinct("_truth").alias("present"),
    )
    totals = taxonomy.level_cardinality(taxa, levels).withColumnRenamed("n_classes", "total")
    return scored.join(totals, "level")


def predicted_level(n_classes: int, cardinality: DataFrame) -> DataFrame:
    """The ranks with that many classes: which rank a class vector of that width stands for."""
    return cardinality.where(F.col("n_classes") == n_classes).select("level")


def report_by_domain(df: DataFrame, domain: str, ranks: Sequence[str]) -> DataFrame:
    """Share classified and accuracy among the classified, overall (`domain` NULL) and per domain, per rank.

    Reads `truth_<rank>` and `pred_<rank>`; a NULL prediction is unclassified.
    """
    pairs = F.array(
        *[F.struct(F.lit(r).alias("rank"), (F.col(f"pred_{r}").isNotNull()).cast("int").alias("found"),
                   (F.col(f"pred_{r}") == F.col(f"truth_{r}")).cast("int").alias("right")) for r in ranks]
    )
    long = df.select(F.col(domain).alias("domain"), F.explode(pairs).alias("_p")).select("domain", "_p.*")
    return long.groupingSets([["rank"], ["rank", "domain"]], "rank", "domain").agg(
        F.avg("found").alias("share"), F.avg("right").alias("accuracy"), F.count(F.lit(1)).alias("n")
    )


def bases_classified(df: DataFrame, length: str, preds: Sequence[str]) -> DataFrame:
    """Share of the bases in sequences that have a prediction, one column per prediction."""
    return df.agg(*[F.try_divide(F.sum(F.when(F.col(p).isNotNull(), F.col(length)).otherwise(0)), F.sum(length)).alias(p) for p in preds])


def confusion(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def classification_report(df: DataFrame, true: str, pred: str) -> DataFrame:
    """`class, precision, recall, f1, specificity, support` per class, then `macro avg`, `weighted avg`, `accuracy`.

    Everything follows from the confusion counts, one row per pair of classes.
    """
    counts = confusion(df, true, pred)
    ends = F.array(
        F.struct(F.col("true").cast("string").alias("class"), F.col("n").alias("sup"), F.lit(0).cast("bigint").alias("prd")),
        F.struct(F.col("pred").cast("string").alias("class"), F.lit(0).cast("bigint").alias("sup"), F.col("n").alias("prd")),
    )
    hit = F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)
    long = counts.select(hit.alias("tp"), F.explode(ends).alias("_e")).select("tp", "_e.*")
    per_class = long.groupBy("class").agg(
        (F.sum("tp") / 2).cast("bigint").alias("tp"), F.sum("sup").alias("support"), F.sum("prd").alias("predicted")
    )
    total = counts.agg(F.sum("n").alias("total"), F.sum(hit).alias("right"))
    summary = total.agg(F.first(F.struct("total", "right"))).scalar()
    rows = per_class.withColumn("total", summary.getField("total"))
    precision, recall = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("support"))
    negatives = F.col("total") - F.col("support")
    scored = rows.select(
        "class",
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(2 * precision * recall, precision + recall).alias("f1"),
        _ratio(negatives - F.col("predicted") + F.col("tp"), negatives).alias("specificity"),
        "support",
    )
    metrics = ["precision", "recall", "f1", "specificity"]
    macro = scored.agg(*[F.avg(m).alias(m) for m in metrics], F.sum("support").alias("support"))
    weighted = scored.agg(
        *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in metrics], F.sum("support").alias("support")
    )
    accuracy = total.select(*[(F.col("right") / F.col("total")).alias(m) for m in metrics], F.col("total").alias("support"))
    for name, part in (("macro avg", macro), ("weighted avg", weighted), ("accuracy", accuracy)):
        scored = scored.unionByName(part.withColumn("class", F.lit(name)))
    return scored


def _score_counts(df: DataFrame, label: str, score: str, keys: Sequence[str]) -> DataFrame:
    """Positives and negatives at each distinct score, and running counts from the highest score down.

    Rows without a score or a label are in no point and in no total.
    """
    df = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    by_score = df.groupBy(*keys, score).agg(
        F.sum(F.col(label).cast("bigint")).alias("_tp"), F.sum(1 - F.col(label).cast("bigint")).alias("_fp")
    )
    by_score = settle(by_score, "scores")
    falling = [-F.col(score)]
    running = ordering.prefix(by_score, keys, ordering.sketch_buckets(by_score, keys, falling), falling, sums={"tp": F.col("_tp"), "fp": F.col("_fp")})
    if keys:
        totals = by_score.groupBy(*keys).agg(
            F.sum("_tp").alias("_P"), F.sum("_fp").alias("_N"), F.count(F.lit(1)).alias("_rows")
        )
        return ordering.salted_join(running, totals, list(keys), spread=[score])
    return running.withColumn("_P", by_score.agg(F.sum("_tp")).scalar()).withColumn("_N", by_score.agg(F.sum("_fp")).scalar())


def roc_curve(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """`keys, threshold, fpr, tpr` at every distinct score. The origin is left out."""
    rows = _score_counts(df, label, score, keys)
    return rows.select(
        *keys, F.col(score).alias("threshold"), F.try_divide("fp", "_N").alias("fpr"), F.try_divide("tp", "_P").alias("tpr")
    )


def roc_auc(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by trapezoids."""
    rows = _score_counts(df, label, score, keys)
    # The point before this one is the running count without this score's own share.
    area = F.col("_fp") * (F.col("tp") - F.col("_tp") / 2)
    return rows.groupBy(*keys).agg(F.try_divide(F.sum(area), F.first(F.col("_P") * F.col("_N"))).alias("auc"))


def pr_curve(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """`keys, threshold, precision, recall` at every distinct score."""
    rows = _score_counts(df, label, score, keys)
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    return rows.select(
        *keys, F.col(score).alias("threshold"), precision.alias("precision"), F.try_divide("tp", "_P").alias("recall")
    )


def pr_auc(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the precision–recall curve by trapezoids, starting at precision 1 and recall 0."""
    rows = _score_counts(df, label, score, keys)
    tp0, fp0 = F.col("tp") - F.col("_tp"), F.col("fp") - F.col("_fp")
    before = F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(F.lit(1.0))
    here = F.col("tp") / (F.col("tp") + F.col("fp"))
    area = F.col("_tp") * (before + here) / 2
    return rows.groupBy(*keys).agg(F.try_divide(F.sum(area), F.first("_P")).alias("aupr"))


def accuracy_by_length(df: DataFrame, length: str, right: str, bins: int = 100) -> DataFrame:
    """Accuracy in `bins` equal-width length bins, the last one closed: `bin, n, mean_length, accuracy`."""
    bounds = df.agg(F.struct(F.min(length).alias("_min"), F.max(length).alias("_max"))).scalar()
    rows = df.withColumn("_min", bounds.getField("_min")).withColumn("_max", bounds.getField("_max"))
    width = F.col("_max") - F.col("_min")
    at = F.when(width > 0, F.floor((F.col(length) - F.col("_min")) * bins / width)).otherwise(0)
    binned = rows.withColumn("bin", F.least(at, F.lit(bins - 1)).cast("int"))
    return binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(length).alias("mean_length"), F.avg(F.col(right).cast("int")).alias("accuracy")
    )


def epoch_hours(df: DataFrame, epoch: str, seconds: str, training: str, validation: str) -> DataFrame:
    """Hours from first to last training row of each epoch that has a validation row."""
    spans = df.groupBy(epoch).agg(
        F.max(F.when(F.col(training).isNotNull(), F.col(seconds))).alias("_to"),
        F.min(F.when(F.col(training).isNotNull(), F.col(seconds))).alias("_from"),
        F.count(validation).alias("_n"),
    )
    return spans.where("_n > 0").select(epoch, ((F.col("_to") - F.col("_from")) / 3600).alias("hours"))


def join_epoch(*tables: DataFrame, epoch: str = "epoch") -> DataFrame:
    """Per-epoch tables side by side, for the epochs that all have."""
    out = tables[0]
    for other in tables[1:]:
        out = out.join(other, epoch)
    return out


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights `n / (2 · count(class))`: `label, weight`."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    total = counts.agg(F.sum("_c")).scalar()
    return counts.select(label, (total / (2 * F.col("_c"))).alias("weight"))
