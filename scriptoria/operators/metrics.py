"""Confusion matrices, classification reports, fold metrics: all from integer counts.

Predictions are rows (id, modello, fold, y_true, y_pred). One aggregation makes the
confusion counts; every metric follows from these at most labels^2 rows a model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.functions.labels import LABELS
from scriptoria.operators.learn import BAYES, PREDICTED_SQL, _rows, cross_validate, fold_predictions
from scriptoria.plans import sqlkit as Q

QUERIES: dict = {}
ORACLES: dict = {}

METRICS = ("accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted")


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def confusion(pred: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """G9, long form: (by..., y_true, y_pred, n)."""
    return pred.filter("y_true is not null and y_pred is not null").groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def confusion_wide(conf: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """G9 and S8's form: a row vero_<label> with a column pred_<label> for each label."""
    base = conf.sparkSession.createDataFrame([(x,) for x in labels], "y_true string")
    wide = conf.groupBy("y_true").pivot("y_pred", list(labels)).agg(F.sum("n"))
    x = base.join(wide, "y_true", "left")
    return x.select(F.concat(F.lit("vero_"), "y_true").alias("vero"), *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(f"pred_{c}") for c in labels])


def per_class(conf: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by..., label, tp, support, predicted, precision, recall, f1); no division by zero."""
    n, zero = F.col("n"), F.lit(0).cast("bigint")
    side = lambda c, support, predicted, tp: F.struct(c.alias("label"), support.alias("support"), predicted.alias("predicted"), tp.alias("tp"))
    true = side(F.col("y_true"), n, zero, F.when(F.col("y_true") == F.col("y_pred"), n).otherwise(zero))
    both = conf.select(*by, F.explode(F.array(true, side(F.col("y_pred"), zero, n, zero))).alias("s")).select(*by, "s.*")
    x = both.groupBy(*by, "label").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("tp", "support", "predicted")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, s, p = F.col("tp"), F.col("support"), F.col("predicted")
    return x.select(*by, "label", "tp", "support", "predicted", ratio(tp, p).alias("precision"), ratio(tp, s).alias("recall"), ratio(2 * tp, s + p).alias("f1"))


def summary(conf: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by..., accuracy, precision_macro, recall_macro, f1_macro, f1_weighted)."""
    n = F.sum("support")
    return per_class(conf, by).groupBy(*by).agg(
        (F.sum("tp") / n).alias("accuracy"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("f1_weighted"),
    )


def report(conf: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) of each class, then accuracy (the
    value in all four columns), macro and weighted averages."""
    kept = ("label", "tp", "support", "precision", "recall", "f1")
    one = per_class(conf).agg(F.collect_list(F.struct(*kept)).alias("c"))  # a row a label: small
    total = lambda f: F.aggregate("c", F.lit(0.0), lambda a, r: a + f(r))
    row = lambda name, p, r, f, s: F.struct(F.lit(name).alias("label"), p.alias("precision"), r.alias("recall"), f.alias("f1"), s.alias("support"))
    n = total(lambda r: r["support"].cast("double"))
    acc = total(lambda r: r["tp"].cast("double")) / n
    macro = [total(lambda r, m=m: r[m]) / F.size("c") for m in ("precision", "recall", "f1")]
    weighted = [total(lambda r, m=m: r[m] * r["support"]) / n for m in ("precision", "recall", "f1")]
    classes = F.transform("c", lambda r: F.struct(r["label"].alias("label"), r["precision"].alias("precision"), r["recall"].alias("recall"), r["f1"].alias("f1"), r["support"].cast("double").alias("support")))
    averages = F.array(row("accuracy", acc, acc, acc, acc), row("macro avg", *macro, n), row("weighted avg", *weighted, n))
    return one.filter(F.size("c") > 0).select(F.explode(F.concat(classes, averages)).alias("r")).select("r.*")


def fold_summary(pred: DataFrame) -> DataFrame:
    """Mean and population deviation over the folds of each metric, per model."""
    per = summary(confusion(pred, ["modello", "fold"]), ["modello", "fold"])
    return per.groupBy("modello").agg(
        F.count_distinct("fold").alias("cv_n_splits"),
        *[F.avg(m).alias(f"{m}_mean") for m in METRICS],
        *[F.stddev_pop(m).alias(f"{m}_std") for m in METRICS],
    )


def best_model(table_: DataFrame, by: str = "f1_macro") -> DataFrame:
    """The first model by a metric, the name breaking ties."""
    return table_.orderBy(F.desc(by), "modello").limit(1)


def percent(table_: DataFrame) -> DataFrame:
    """K6: the metrics times 100, rounded for display."""
    return table_.select("modello", *[F.round(F.col(m) * 100, 2).alias(m) for m in METRICS])


# The queries below measure the out-of-fold predictions of two classifiers for every
# labelled row of the dataset.
_PRED = (
    PREDICTED_SQL
    + """,
cf AS (SELECT modello, fold, y_true, y_pred, count(*) AS n FROM p GROUP BY ALL),
c AS (SELECT modello, y_true, y_pred, CAST(sum(n) AS BIGINT) AS n FROM cf GROUP BY ALL),
"""
)
FIRST = BAYES[0][0]


def _classes(src: str, by: str) -> str:
    k = f"{by}, " if by else ""
    return f"""(SELECT {k}label, sum(tp) AS tp, sum(s) AS support, sum(q) AS predicted, CASE WHEN sum(q) > 0 THEN sum(tp) / sum(q) ELSE 0.0 END AS precision, CASE WHEN sum(s) > 0 THEN sum(tp) / sum(s) ELSE 0.0 END AS recall,
CASE WHEN sum(s) + sum(q) > 0 THEN 2 * sum(tp) / (sum(s) + sum(q)) ELSE 0.0 END AS f1 FROM
(SELECT {k}y_true AS label, n AS s, 0 AS q, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp FROM {src} UNION ALL SELECT {k}y_pred, 0, n, 0 FROM {src}) GROUP BY ALL)"""


def _summary(src: str, by: str) -> str:
    return f"(SELECT {by}, sum(tp) / sum(support) AS accuracy, avg(precision) AS precision_macro, avg(recall) AS recall_macro, avg(f1) AS f1_macro, sum(f1 * support) / sum(support) AS f1_weighted FROM {_classes(src, by)} GROUP BY {by})"


@query(_PRED.rstrip(",\n") + " SELECT modello, y_true, y_pred, n FROM c")
def confusion_counts(s, d):
    """G9, long."""
    return confusion(fold_predictions(s, d), ["modello"])


@query(
    _PRED
    + "w AS (SELECT * FROM c WHERE modello = '" + FIRST + "') SELECT 'vero_' || l AS vero, "
    + ", ".join(f"CAST(coalesce(sum(n) FILTER (y_pred = '{x}'), 0) AS BIGINT) AS \"pred_{x}\"" for x in LABELS)
    + f" FROM (SELECT unnest([{', '.join(Q.lit(x) for x in LABELS)}]) AS l) LEFT JOIN w ON w.y_true = l GROUP BY l"
)
def confusion_matrix(s, d):
    """G9, wide."""
    return confusion_wide(confusion(fold_predictions(s, d).filter(F.col("modello") == FIRST)))


@query(
    _PRED
    + f"w AS (SELECT y_true, y_pred, n FROM c WHERE modello = '{FIRST}'), kk AS {_classes('w', '')} "
    + """SELECT label, precision, recall, f1, CAST(support AS DOUBLE) AS support FROM kk
UNION ALL SELECT 'accuracy', a, a, a, a FROM (SELECT sum(tp) / sum(support) AS a FROM kk)
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS DOUBLE) FROM kk
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS DOUBLE) FROM kk"""
)
def class_report(s, d):
    """G11."""
    return report(confusion(fold_predictions(s, d).filter(F.col("modello") == FIRST)))


@query(_PRED + f"z AS {_summary('c', 'modello')} SELECT * FROM z")
def macro_metrics(s, d):
    """G10, K6."""
    return summary(confusion(fold_predictions(s, d), ["modello"]), ["modello"])


@query(
    _PRED
    + f"z AS {_summary('cf', 'modello, fold')} SELECT modello, count(DISTINCT fold) AS cv_n_splits, "
    + ", ".join(f"avg({m}) AS {m}_mean, stddev_pop({m}) AS {m}_std" for m in METRICS)
    + " FROM z GROUP BY 1"
)
def fold_metrics(s, d):
    """G12."""
    return fold_summary(fold_predictions(s, d))


@query(_PRED + f"z AS {_summary('c', 'modello')} SELECT * FROM z ORDER BY f1_macro DESC, modello LIMIT 1")
def best_by_f1(s, d):
    """A top-1 report."""
    return best_model(summary(confusion(fold_predictions(s, d), ["modello"]), ["modello"]))


@query()
def cv_summary(s, d):
    """Fold means and deviations of the three classifiers."""
    return fold_summary(cross_validate(_rows(s, d), "riga_id", "y", "tm"))
