"""Accuracy tables, curves and training-log summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.aggregating import VOTES_CTE, scored
from catalog.common import LEVELS, TAXA_CTE, Catalog, class_taxa, table
from catalog.windowing import LENS_CTE, lengths
from cladeflow import cut_lineage
from cladeflow.functions import vectors as V
from cladeflow.operators import aggregate, evaluate

catalog = Catalog()

ACCURACY_CTE = f"""{VOTES_CTE}, {TAXA_CTE},
m AS (SELECT seq_id, label, class, avg(p) AS p, sum(length) AS length FROM probs GROUP BY ALL),
b AS (SELECT seq_id, label, length, arg_min(class, (-p, class)) AS pred FROM m GROUP BY ALL),
c AS (SELECT seq_id, label, length, CASE WHEN seq_id % 11 = 0 THEN NULL WHEN seq_id % 13 = 0 THEN -1 ELSE pred END AS pred FROM b),
x AS (SELECT c.seq_id, c.label, c.length, q.species AS pred, t.genus AS tg, t.family AS tf, q.genus AS pg, q.family AS pf
  FROM c LEFT JOIN taxa t ON c.label = t.species LEFT JOIN taxa q ON c.pred = q.species)"""


def accuracy_sql(level, true, pred):
    return f"""SELECT '{level}' AS level, count(*) AS n, round(avg(CAST(coalesce({true} = {pred}, false) AS INT)), 6) AS seq_acc,
  round(sum(CASE WHEN {true} = {pred} THEN length ELSE 0 END) / sum(length), 6) AS base_acc,
  count(DISTINCT {true}) AS present, (SELECT count(DISTINCT {level}) FROM taxa) AS total FROM x"""


@catalog.add("a20_taxonomic_accuracy", f"WITH {ACCURACY_CTE} " + " UNION ALL ".join(
    accuracy_sql(*a) for a in (("species", "label", "pred"), ("genus", "tg", "pg"), ("family", "tf", "pf"))))
def taxonomic_accuracy(spark, sf):
    seqs = aggregate.aggregate_chunks(scored(spark, sf), "seq_id", "p", "label", "length")
    # Some sequences are unclassified, some get a class that the taxa do not have.
    pred = F.when(F.col("seq_id") % 11 == 0, F.lit(None)).when(F.col("seq_id") % 13 == 0, -1).otherwise(F.col("pred"))
    seqs = seqs.withColumn("pred", pred)
    table_ = evaluate.taxonomic_accuracy(seqs, class_taxa(spark, sf), "species", LEVELS, "length")
    return table_.select(
        "level", "n", F.round("seq_acc", 6).alias("seq_acc"), F.round("base_acc", 6).alias("base_acc"), "present", "total"
    )


JUDGED_CTE = f"""{LENS_CTE}, judged AS (SELECT seq_id, genome_id, label, L, seq_id % 2 AS truth_quality,
  CAST(seq_id % 10 = 0 AS INT) AS truth_toxic, quality AS pred_quality, toxic AS pred_toxic
  FROM lens LEFT JOIN labels ON seq_id = doc_id)"""


def judged(spark, sf):
    """All documents with truth, and predictions where there are any."""
    inputs = lengths(spark, sf)
    truth = inputs.select(
        "seq_id",
        (F.col("seq_id") % 2).alias("truth_quality"),
        (F.col("seq_id") % 10 == 0).cast("int").alias("truth_toxic"),
    )
    preds = table(spark, sf, "labels").select(
        F.col("doc_id").alias("seq_id"), F.col("quality").alias("pred_quality"), F.col("toxic").alias("pred_toxic")
    )
    return evaluate.join_truth(inputs, preds, truth, "seq_id")


@catalog.add("j07_join_truth", f"WITH {JUDGED_CTE} SELECT * FROM judged")
def join_truth(spark, sf):
    return judged(spark, sf)


@catalog.add("a21_report_by_domain", f"""
WITH {JUDGED_CTE}, l AS (
  SELECT label, 'quality' AS rank, truth_quality AS t, pred_quality AS p FROM judged
  UNION ALL SELECT label, 'toxic', truth_toxic, pred_toxic FROM judged)
SELECT rank, label AS domain, round(avg(CAST(p IS NOT NULL AS INT)), 6) AS share, round(avg(CAST(p = t AS INT)), 6) AS accuracy,
  count(*) AS n FROM l GROUP BY GROUPING SETS ((rank), (rank, label))""")
def report_by_domain(spark, sf):
    report = evaluate.report_by_domain(judged(spark, sf), "label", ["quality", "toxic"])
    return report.select("rank", "domain", F.round("share", 6).alias("share"), F.round("accuracy", 6).alias("accuracy"), "n")


@catalog.add("a22_bases_classified", f"""
WITH {JUDGED_CTE} SELECT round(sum(L) FILTER (pred_quality IS NOT NULL) / sum(L), 6) AS pred_quality FROM judged""")
def bases_classified(spark, sf):
    share = evaluate.bases_classified(judged(spark, sf), "L", ["pred_quality"])
    return share.select(F.round("pred_quality", 6).alias("pred_quality"))


@catalog.add("a23_classification_report", f"""
WITH {VOTES_CTE}, c AS (SELECT DISTINCT c FROM (SELECT label AS c FROM pick UNION SELECT pred FROM pick)),
k AS (SELECT c, (SELECT count(*) FROM pick WHERE label = c AND pred = c) AS tp, (SELECT count(*) FROM pick WHERE pred = c) AS pr,
  (SELECT count(*) FROM pick WHERE label = c) AS su, (SELECT count(*) FROM pick) AS n FROM c),
r AS (SELECT CAST(c AS VARCHAR) AS class, CASE WHEN pr > 0 THEN tp / pr ELSE 0 END AS precision,
  CASE WHEN su > 0 THEN tp / su ELSE 0 END AS recall, CASE WHEN tp > 0 THEN 2 * tp / (pr + su) ELSE 0 END AS f1,
  CASE WHEN n > su THEN (n - su - pr + tp) / (n - su) ELSE 0 END AS specificity, su AS support FROM k),
a AS (SELECT avg(CAST(label = pred AS INT)) AS acc, count(*) AS n FROM pick),
every AS (SELECT * FROM r
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), avg(specificity), CAST(sum(support) AS BIGINT) FROM r
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), sum(specificity * support) / sum(support), CAST(sum(support) AS BIGINT) FROM r
  UNION ALL SELECT 'accuracy', acc, acc, acc, acc, n FROM a)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  round(specificity, 6) AS specificity, support FROM every""")
def classification_report(spark, sf):
    picked = scored(spark, sf).select("label", V.argmax(F.col("p")).alias("pred"))
    report = evaluate.classification_report(picked, "label", "pred")
    metrics = [F.round(m, 6).alias(m) for m in ("precision", "recall", "f1", "specificity")]
    return report.select("class", *metrics, "support")


# Truth is one bit per labelled document; the score is a share of its letters.
SCORES_CTE = f"""{LENS_CTE}, scores AS (SELECT CASE WHEN seq_id % 3 = 0 THEN 'a' ELSE 'b' END AS level, quality AS y,
  (L % 1000) / 1000.0 AS score FROM lens JOIN labels ON seq_id = doc_id),
g AS (SELECT level, score, sum(y) AS tp, sum(1 - y) AS fp FROM scores GROUP BY ALL),
cum AS (SELECT level, score, tp AS dtp, fp AS dfp, sum(tp) OVER w AS tp, sum(fp) OVER w AS fp,
  sum(tp) OVER (PARTITION BY level) AS P, sum(fp) OVER (PARTITION BY level) AS N
  FROM g WINDOW w AS (PARTITION BY level ORDER BY score DESC))"""


def scores(spark, sf):
    labelled = lengths(spark, sf).join(table(spark, sf, "labels"), F.col("seq_id") == F.col("doc_id"))
    return labelled.select(
        F.when(F.col("seq_id") % 3 == 0, "a").otherwise("b").alias("level"),
        F.col("quality").alias("y"),
        ((F.col("L") % 1000) / 1000.0).alias("score"),
    )


@catalog.add("a24_roc_curve", f"""
WITH {SCORES_CTE} SELECT level, round(score, 6) AS threshold, round(fp / N, 6) AS fpr, round(tp / P, 6) AS tpr FROM cum
UNION ALL SELECT level || ' auc', NULL, NULL, round(sum(dfp * (2 * tp - dtp)) / 2 / (any_value(P) * any_value(N)), 6)
FROM cum GROUP BY level""")
def roc_curve(spark, sf):
    rows = cut_lineage(scores(spark, sf))
    curve = evaluate.roc_curve(rows, "y", "score", ["level"])
    area = evaluate.roc_auc(rows, "y", "score", ["level"])
    points = curve.select("level", F.round("threshold", 6).alias("threshold"), F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))
    named = area.select(F.concat("level", F.lit(" auc")).alias("level"), F.round("auc", 6).alias("tpr"))
    return points.unionByName(named, allowMissingColumns=True)


@catalog.add("a25_pr_curve", f"""
WITH {SCORES_CTE} SELECT level, round(score, 6) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / P, 6) AS recall FROM cum
UNION ALL SELECT level || ' aupr', NULL, NULL, round(sum(dtp * (tp / (tp + fp) + CASE WHEN tp + fp > dtp + dfp
  THEN (tp - dtp) / (tp + fp - dtp - dfp) ELSE 1 END)) / 2 / any_value(P), 6) FROM cum GROUP BY level""")
def pr_curve(spark, sf):
    rows = cut_lineage(scores(spark, sf))
    curve = evaluate.pr_curve(rows, "y", "score", ["level"])
    area = evaluate.pr_auc(rows, "y", "score", ["level"])
    points = curve.select("level", F.round("threshold", 6).alias("threshold"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))
    named = area.select(F.concat("level", F.lit(" aupr")).alias("level"), F.round("aupr", 6).alias("recall"))
    return points.unionByName(named, allowMissingColumns=True)


@catalog.add("a26_accuracy_by_length", f"""
WITH {JUDGED_CTE}, j AS (SELECT L, CAST(coalesce(pred_quality = truth_quality, false) AS INT) AS ok,
  min(L) OVER () AS lo, max(L) OVER () AS hi FROM judged),
b AS (SELECT *, CAST(least((L - lo) * 100 // (hi - lo), 99) AS INTEGER) AS bin FROM j)
SELECT bin, count(*) AS n, round(avg(L), 6) AS mean_length, round(avg(ok), 6) AS accuracy FROM b GROUP BY bin""")
def accuracy_by_length(spark, sf):
    right = F.coalesce(F.col("pred_quality") == F.col("truth_quality"), F.lit(False))
    report = evaluate.accuracy_by_length(judged(spark, sf).withColumn("right", right), "L", "right", 100)
    return report.select("bin", "n", F.round("mean_length", 6).alias("mean_length"), F.round("accuracy", 6).alias("accuracy"))


METRICS_CTE = """metrics AS (SELECT CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS epoch, epoch_us(ts) / 1000000.0 AS time,
  CASE WHEN event_type IN ('view', 'click') THEN CAST(round(value * 100) AS BIGINT) END AS training_loss,
  CASE WHEN event_type = 'purchase' AND user_id < 8 THEN CAST(round(value * 100) AS BIGINT) END AS validation_loss,
  CASE WHEN event_type = 'signup' THEN CAST(round(value * 100) AS BIGINT) END AS lr FROM events)"""


def metrics(spark, sf):
    """A training log in whole numbers: one epoch per day, training rows, a few validation rows and learning rates."""
    kind, value = F.col("event_type"), F.round(F.col("value") * 100).cast("bigint")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select(
        F.floor(micros / 86400000000).alias("epoch"),
        (micros / 1000000.0).alias("time"),
        F.when(kind.isin("view", "click"), value).alias("training_loss"),
        F.when((kind == "purchase") & (F.col("user_id") < 8), value).alias("validation_loss"),
        F.when(kind == "signup", value).alias("lr"),
    )


HOURS_CTE = f"""{METRICS_CTE}, hours AS (SELECT epoch, (max(time) FILTER (training_loss IS NOT NULL)
  - min(time) FILTER (training_loss IS NOT NULL)) / 3600 AS hours FROM metrics GROUP BY epoch
  HAVING count(validation_loss) > 0)"""


@catalog.add("a27_epoch_hours", f"WITH {HOURS_CTE} SELECT epoch, round(hours, 6) AS hours FROM hours")
def epoch_hours(spark, sf):
    hours = evaluate.epoch_hours(metrics(spark, sf), "epoch", "time", "training_loss", "validation_loss")
    return hours.withColumn("hours", F.round("hours", 6))


@catalog.add("j08_join_epoch", f"""
WITH {HOURS_CTE}, v AS (SELECT epoch, avg(validation_loss) AS validation_loss FROM metrics GROUP BY epoch
  HAVING count(validation_loss) > 0), r AS (SELECT epoch, avg(lr) AS lr FROM metrics GROUP BY epoch HAVING count(lr) > 0)
SELECT epoch, validation_loss, lr, round(hours, 6) AS hours
FROM v JOIN r USING (epoch) JOIN hours USING (epoch)""")
def join_epoch(spark, sf):
    log = metrics(spark, sf)
    losses = log.where("validation_loss IS NOT NULL").groupBy("epoch").agg(F.avg("validation_loss").alias("validation_loss"))
    rates = log.where("lr IS NOT NULL").groupBy("epoch").agg(F.avg("lr").alias("lr"))
    hours = evaluate.epoch_hours(log, "epoch", "time", "training_loss", "validation_loss")
    joined = evaluate.join_epoch(losses, rates, hours)
    return joined.select("epoch", "validation_loss", "lr", F.round("hours", 6).alias("hours"))


@catalog.add("j09_asof_last", """
WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup'),
a AS (SELECT user_id, ts, value FROM events WHERE event_type IN ('view', 'click')),
b AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase')
SELECT l.event_id, l.user_id, a.value AS loss, b.value AS val_loss FROM l
ASOF LEFT JOIN a ON l.user_id = a.user_id AND l.ts >= a.ts ASOF LEFT JOIN b ON l.user_id = b.user_id AND l.ts >= b.ts""")
def asof_last(spark, sf):
    from cladeflow.operators import joins

    events = table(spark, sf, "events")
    kind, value = F.col("event_type"), F.col("value")
    values = {"loss": F.when(kind.isin("view", "click"), value), "val_loss": F.when(kind == "purchase", value)}
    found = joins.asof_last(
        events.where(kind == "signup"), events.where(kind != "signup"), "ts", values, ["user_id"], "event_id"
    )
    return found.select("event_id", "user_id", "loss", "val_loss")


@catalog.add("a32_class_weights", """
SELECT quality, round((SELECT count(*) FROM labels) / (2 * count(*)), 6) AS weight FROM labels GROUP BY quality""")
def class_weights(spark, sf):
    return evaluate.class_weights(table(spark, sf, "labels"), "quality").withColumn("weight", F.round("weight", 6))
