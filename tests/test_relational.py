"""Ids, upserts, splits, metrics, learning, cleaning, on small hand-made tables."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptoria.operators import cleaning, learn, metrics, ranking, relational


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_group_rank_is_row_number(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, None).otherwise((F.col("id") % 7).cast("string")).alias("g"), F.lit(1).alias("h"), F.lit(2).alias("rank"))
    got = ranking.group_rank(df, "g", "id", 5)
    want = df.selectExpr("*", "row_number() over (partition by g order by md5(concat(cast(id as string), ':5')), id) as w")
    assert got.join(want.select("id", "w"), "id").filter("__rank <> w").count() == 0 and got.count() == 3000
    assert {"h", "rank"} < set(got.columns)
    assert ranking.group_rank(df.limit(0), "g", "id", 5).count() == 0


def test_total_rank(spark):
    df = spark.createDataFrame([(x % 50, x) for x in range(500)], "k int, v int")
    got = ranking.total_rank(df, F.col("k"), F.col("v")).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(1, 501)) and [(r["k"], r["v"]) for r in got] == sorted((x % 50, x) for x in range(500))
    assert ranking.total_rank(df.limit(0), F.col("k")).count() == 0


def test_act_ids(spark):
    df = spark.createDataFrame([("0012",), (" 12 ",), ("0012_2",), ("12_02",), ("x",), (None,), ("0",), ("000",)], "id_atto string")
    assert [r[0] for r in df.select(relational.act_id("id_atto")).collect()] == ["12", "12", "12_2", "12_2", None, None, "0", "0"]


def test_latest_keeps_last_row(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "z"), ("a", 2, "y")], "k string, t int, v string")
    assert rows(relational.latest(df, ["k"], ["t", "v"])) == [("a", 2, "y"), ("b", 1, "z")]


def test_balanced_sample(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "id int, y string")
    got = relational.balanced_sample(df, "y", "id", 4)
    assert rows(got.groupBy("y").count()) == [("a", 4), ("b", 4)]
    with pytest.raises(ValueError, match="a: 10"):
        relational.balanced_sample(df, "y", "id", 11)


@pytest.mark.parametrize("sizes", [(5, 5), (40, 30, 30), (97, 2, 1), (1, 1, 1)])
def test_stratified_split(spark, sizes):
    df = spark.createDataFrame([(100 * k + i, str(k)) for k, n in enumerate(sizes) for i in range(n)], "id int, y string")
    got = relational.stratified_split(df, "y", "id").collect()
    n, k = sum(sizes), len(sizes)
    assert len(got) == n and sum(r["split"] == "test" for r in got) == max(round(n * 0.25), k if round(n * 0.25) < k else 0)


def test_folds_are_balanced(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(30)], "id int, y string")
    counts = relational.folds(df, "y", "id").groupBy("y", "fold").count().collect()
    assert len(counts) == 10 and {r["count"] for r in counts} == {3}


def test_routes(spark):
    df = spark.createDataFrame([(80, 99, False), (60, 65, False), (60, 64, False), (None, 3, False), (10, None, False), (None, None, False), (90, 10, True), (90, None, True)], "n int, o int, f boolean")
    got = [r[0] for r in df.select(relational.route(F.col("n"), F.col("o"), forced=F.col("f"))).collect()]
    assert got == ["nativo", "ocr", "nativo", "ocr", "nativo", "errore", "ocr", "errore"]
    got = [r[0] for r in df.select(relational.engine(F.col("n"), F.col("o"))).collect()][:6]
    assert got == ["rapidocr", "paddleocr", "rapidocr", "paddleocr", "rapidocr", None]


def test_metrics_by_hand(spark):
    pred = spark.createDataFrame([(i, "m", i % 2, t, p) for i, (t, p) in enumerate([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")])], "id int, modello string, fold int, y_true string, y_pred string")
    conf = metrics.confusion(pred)
    r = metrics.summary(conf).first()
    assert r["accuracy"] == 0.5 and r["precision_macro"] == pytest.approx((1 + 1 / 3 + 0) / 3) and r["recall_macro"] == pytest.approx((0.5 + 1 + 0) / 3)
    assert r["f1_macro"] == pytest.approx((2 / 3 + 0.5 + 0) / 3) and r["f1_weighted"] == pytest.approx((2 * 2 / 3 + 0.5) / 4)
    rep = {x["label"]: x for x in metrics.report(conf).collect()}
    assert rep["accuracy"]["support"] == 0.5 and rep["macro avg"]["support"] == 4 and rep["c"]["f1"] == 0
    wide = metrics.confusion_wide(conf, ("a", "b", "c")).collect()
    assert [tuple(x) for x in wide] == [("vero_a", 1, 1, 0), ("vero_b", 0, 1, 0), ("vero_c", 0, 1, 0)] or len(wide) == 3
    f = metrics.fold_summary(pred).first()
    assert f["cv_n_splits"] == 2 and f["accuracy_mean"] == 0.5 and f["accuracy_std"] == 0.5
    assert metrics.best_model(metrics.summary(metrics.confusion(pred, ["modello"]), ["modello"])).first()["modello"] == "m"


TEXTS = [(f"determina impegno spesa ufficio {i}", "D") for i in range(12)] + [(f"ordinanza divieto sosta via {i}", "O") for i in range(12)] + [(f"statuto comune articolo {i}", "S") for i in range(6)]


@pytest.mark.parametrize("model", sorted(learn.MODELS))
def test_classifiers(model):
    x, y = zip(*TEXTS)
    assert learn.fit_predict(model, list(x), list(y), ["nuovo impegno di spesa", "divieto di sosta", "articolo dello statuto"]) == ["D", "O", "S"]
    assert learn.fit_predict(model, ["a b"], ["D"], ["c"]) == ["D"] and learn.fit_predict(model, [], [], []) == []


def test_row_space_gives_the_same_model():
    x, y = zip(*TEXTS)
    names = sorted(set(y))
    t = np.array([names.index(v) for v in y])
    feats = learn.Features(list(x))
    full = learn.fit_logistic(feats.of(list(x)), t, 3)
    z = feats.of(["spesa per la sosta dello statuto"])
    k = feats.of(list(x))
    low = np.linalg.cholesky(k.gram(k) + 1e-9 * np.eye(len(t)))
    m = learn.fit_logistic(learn.Dense(low), t, 3)
    a, b = z.dot(full[:-1]) + full[-1], np.linalg.solve(low, k.gram(z)).T @ m[:-1] + m[-1]
    assert np.allclose(a - a.mean(), b - b.mean(), atol=0.02)


def test_naive_bayes_plan(spark):
    tr = spark.createDataFrame([(i, y, x) for i, (x, y) in enumerate(TEXTS)], "i int, y string, x string")
    te = spark.createDataFrame([(1, "impegno spesa"), (2, "divieto sosta"), (3, "xyz"), (4, None)], "i int, x string")
    assert dict(rows(learn.naive_bayes(tr, te, "i", "y", "x"))) == {1: "D", 2: "O", 3: "D", 4: "D"}


def test_cross_validation(spark):
    df = spark.createDataFrame([(i, y, x) for i, (x, y) in enumerate(TEXTS)], "i bigint, y string, x string")
    got = learn.cross_validate(df, "i", "y", "x")
    assert got.count() == 90 and metrics.summary(metrics.confusion(got)).first()["accuracy"] > 0.95
    assert learn.cross_validate(df.limit(0), "i", "y", "x").count() == 0


def test_cleaning_seam(spark):
    df = spark.createDataFrame([(1, "Oggetto: prova del testo."), (2, None), (3, "testo tre"), (4, "testo quattro"), (5, "testo cinque")], "i bigint, t string")

    def model(prompts):
        p = prompts[0]
        if "tre" in p:
            raise TimeoutError
        if "quattro" in p:
            return [("ERRORE_LINGUA_NON_ITALIANA", 3, 1)]
        if "cinque" in p:
            return [(" ", 3, 0)]
        return [("```\nPulito.  Bene.\n```", 10, 4)]

    got = {r["id"]: r for r in cleaning.clean_texts(df, "i", "t", cleaning.VARIANTS["A"], model, (1.0, 2.0)).collect()}
    assert (got[1]["testo"], got[1]["total_tokens"], got[1]["costo_totale"]) == ("Pulito. Bene.", 14, 0.018)
    assert (got[2]["testo"], got[2]["errore_tecnico"]) == ("", "Testo non disponibile per atto")
    assert (got[3]["testo"], got[3]["fallback_locale"], got[3]["errore_tecnico"]) == ("testo tre", 1, "")
    assert (got[4]["testo"], got[4]["errore_tecnico"]) == ("", "ERRORE_LINGUA_NON_ITALIANA")
    assert (got[5]["testo"], got[5]["errore_tecnico"]) == ("", "Risposta LLM vuota")
    assert relational.audit_rows(df.select(F.col("i").alias("id_atto"))).columns[-1] == "timestamp"
    local = cleaning.clean_texts(df, "i", "t").filter("id = 1").first()
    assert local["fallback_locale"] == 1 and local["testo"] == "Oggetto: prova del testo."


def test_stream_upsert(spark, tmp_path):
    from scriptoria.streaming import upsert

    day = lambda n: dt.datetime(2024, 1, n)
    schema = "id string, testo string, t timestamp"
    src = str(tmp_path / "in")
    spark.createDataFrame([("1", "a", day(1)), ("2", "b", day(1))], schema).write.mode("append").parquet(src)
    go = lambda: upsert.upsert_stream(
        upsert.stream_of(spark, src, spark.createDataFrame([], schema).schema), str(tmp_path / "ds"), str(tmp_path / "audit"), str(tmp_path / "cp"), ["id"], ["t"]
    ).awaitTermination()
    go()
    spark.createDataFrame([("2", "c", day(2)), ("3", "d", day(2)), ("1", "vecchio", dt.datetime(2023, 1, 1))], schema).write.mode("append").parquet(src)
    go()
    assert sorted((r["id"], r["testo"]) for r in upsert.current(spark, str(tmp_path / "ds")).collect()) == [("1", "a"), ("2", "c"), ("3", "d")]
    assert spark.read.parquet(str(tmp_path / "audit") + "/*").count() == 5
