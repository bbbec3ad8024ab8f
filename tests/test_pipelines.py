"""The pipelines end to end, with stand-ins for the PDF reader, the OCR and the model."""

import pytest
from pyspark.sql import functions as F

from scriptoria.operators import learn
from scriptoria.operators.cleaning import VARIANTS
from scriptoria.plans import pipelines
from scriptoria.sources import files

GOOD = "Visto il regolamento, considerato lo statuto, ritenuto, determina: oggetto 12. " * 60


def test_extraction(spark, tmp_path):
    for n, b in (("atto_1.pdf", GOOD), ("atto_2.pdf", "scan"), ("atto_3.pdf", "vuoto"), ("atto_4.pdf", "vecchio")):
        (tmp_path / n).write_text(b)
    docs = files.documents(spark, str(tmp_path))
    old = spark.createDataFrame([("0004", "x.pdf", "0", "testo valido", "Decreto"), ("0002", "y.pdf", "0", "", "Statuto"), ("0099", "z.pdf", "1", "altro", "")], ", ".join(f"{c} string" for c in files.DATASET))
    seen = tmp_path / "ocr.log"
    native = lambda b: "" if b == b"vuoto" else b.decode()

    def ocr(content):
        with open(seen, "a") as f:
            f.write("x")
        return GOOD if content == b"scan" else ""

    out = pipelines.extract(docs, old, native, ocr, lambda p: [("Pulito.", 5, 2)], VARIANTS["A"], "m")
    got = {r["id_atto"]: tuple(r)[1:] for r in out.dataset.collect()}
    assert got == {
        "0001": ("atto_1.pdf", "0", "Pulito.", ""),
        "0002": ("atto_2.pdf", "1", "Pulito.", "Statuto"),
        "0003": ("atto_3.pdf", "1", "", ""),
        "0004": ("x.pdf", "0", "testo valido", "Decreto"),
        "0099": ("z.pdf", "1", "altro", ""),
    }
    assert seen.read_text() == "xx"  # neither on the good text nor on the skipped document
    audit = {r["id_atto"]: r for r in out.audit.collect()}
    assert set(audit) == {"0001", "0002", "0003"} and audit["0003"]["errore_tecnico"] and audit["0001"]["total_tokens"] == 7
    assert "record audit: 3" in pipelines.update_report("titolo", out.audit)
    again = pipelines.extract(docs, old, native, ocr, None, VARIANTS["VF"])
    assert again.audit.count() == 4 and {r["id_atto"]: r["fallback_locale"] for r in again.audit.collect()}["0001"] == 1


def test_training(spark):
    rows = [(i, f"determina impegno spesa {i}", "determina") for i in range(20)] + [(50 + i, f"ordinanza divieto sosta {i}", "Ordinanza sindacale") for i in range(20)] + [(99, "boh", "da controllare"), (98, None, "Decreto")]
    df = spark.createDataFrame(rows, "riga_id bigint, testo_completo_llm string, golden_label string")
    t = pipelines.train(df, models=("naive_bayes", "linear_svm"))
    assert t.split.groupBy("split").count().orderBy("split").collect() == [("test", 10), ("train", 30)]
    assert {r["modello"]: r["accuracy"] for r in t.test_summary.collect()} == {"naive_bayes": 1.0, "linear_svm": 1.0}
    assert {r["cv_n_splits"] for r in t.cv_summary.collect()} == {5} and t.cv_confusion.agg(F.sum("n")).first()[0] == 80
    with pytest.raises(ValueError, match="not trainable"):
        pipelines.train(df.filter("riga_id < 20"))


def _labelled(spark):
    word = {"Determina": "determina impegno spesa", "Ordinanza": "ordinanza divieto sosta"}
    rows = [(i, f"{word[y]} {i % 7}", y) for i in range(600) for y in [list(word)[i % 2]]] + [(600 + i, f"statuto comunale articolo {i}", "Statuto") for i in range(4)]
    return spark.createDataFrame([(*r, "x") for r in rows], "riga_id bigint, testo_completo_llm string, golden_label string, altro string")


def test_training_covers_all_rows(spark):
    t = pipelines.train(_labelled(spark), most=50, models=("naive_bayes",))
    assert t.split.count() == 604 and t.predictions.count() == t.split.filter("split = 'test'").count() == 151
    assert {r["label"] for r in t.split.select("label").distinct().collect()} >= {"Statuto"}
    assert t.cv_confusion.agg(F.sum("n")).first()[0] == 604


def test_cross_validation_predicts_every_row(spark):
    x = _labelled(spark)
    got = learn.cross_validate(x, "riga_id", "golden_label", "testo_completo_llm", 40, ("naive_bayes", "linear_svm")).collect()
    assert sorted((r["modello"], r["id"]) for r in got) == [(m, i) for m in ("linear_svm", "naive_bayes") for i in range(604)]
    assert all(r["y_true"] == r["y_pred"] for r in got if r["modello"] == "linear_svm")
    assert learn.cross_validate(x.limit(0), "riga_id", "golden_label", "testo_completo_llm").count() == 0
