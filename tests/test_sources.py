"""Records, files and reports."""

import csv

import pytest
from pyspark.sql import functions as F

from scriptoria.operators import metrics
from scriptoria.sources import files
from scriptoria.sources.records import assemble, parse, parse_records, read_records, rejected_rows, valid_rows

GOOD = '12;a.pdf;0;"uno; due ""tre""\nquattro";Determina'


@pytest.mark.parametrize(
    ("record", "reason"),
    [
        (GOOD, None),
        ("12_2;a;1;testo;", None),
        (" 7 ;a; 0 ;testo\ncon riga; DETERMINA ", None),
        (None, "colonne"),
        ("", "colonne"),
        (";;;;", "valore"),
        ("12;a;0;testo", "colonne"),
        ("12;a;0;te;sto;Determina", "colonne"),
        ('12;a;0;"testo;Determina', "virgolette"),
        ('12;a;0;te"sto;Determina', "virgolette"),
        ('12;a;0;"te"sto";Determina', "virgolette"),
        ('12;a;0; "testo";Determina', "virgolette"),
        ('12;a;0;"testo" ;Determina', "virgolette"),
        ("1234567890;a;0;t;", "valore"),
        ("12_123;a;0;t;", "valore"),
        ("12;a;2;t;", "valore"),
        ("12;a;0;t;boh", "valore"),
        ("12;a;0;\u00a0 ;", "valore"),
        ("12;a;0;t\ufffd;", "valore"),
        ("12;a;0;t\0;", "valore"),
        ("12;a;0;" + "x" * 300_000 + ";Decreto", None),
    ],
)
def test_reasons(record, reason):
    csv.field_size_limit(10**9)
    assert parse(record)[-2] == reason


def test_parse_whole_table(spark):
    df = spark.createDataFrame([(1, GOOD, "x"), (1, GOOD, "x"), (2, None, None), (3, "a;b", "y")], "id bigint, riga string, motivo string")
    p = parse_records(df, "riga", "id")
    ok = valid_rows(p, "id").collect()
    assert len(ok) == 2 and ok[0]["testo_completo_llm"] == 'uno; due "tre"\nquattro'
    assert sorted((r["id"], r["motivo"]) for r in rejected_rows(p, "id").collect()) == [(2, "colonne"), (3, "colonne")]
    assert parse_records(df.limit(0), "riga", "id").count() == 0


def test_assemble():
    text = GOOD + "\n1;b;0;x;\n2;c;0;\"aperto"
    assert list(assemble(text.split("\n"))) == [GOOD, "1;b;0;x;", '2;c;0;"aperto']


def test_record_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeff" + GOOD + "\n1;b;0;x;\n\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text('2;c;0;"aperto\nresto', encoding="utf-8")
    (tmp_path / "c.csv").write_text("\n", encoding="utf-8")
    got = read_records(spark, str(tmp_path)).orderBy("file_csv", "num_riga").collect()
    assert [tuple(r) for r in got] == [("a.csv", 1, GOOD), ("a.csv", 2, "1;b;0;x;"), ("b.csv", 1, '2;c;0;"aperto\nresto')]
    assert [r["motivo"] for r in parse_records(read_records(spark, str(tmp_path)), "riga", "file_csv").orderBy("file_csv").collect()] == [None, None, "virgolette"]


def test_dataset_round_trip(spark, tmp_path):
    rows = [("0012", "a.pdf", "0", 'testo; con "virgolette" e\nriga ', "Determina"), ("0012_2", "b.pdf", "1", "altro", "")]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in files.DATASET))
    files.write_dataset(df, str(tmp_path / "d.csv"))
    got = files.read_dataset(spark, [str(tmp_path / "manca.csv"), str(tmp_path / "d.csv")])
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    assert files.read_dataset(spark, ["/nowhere"]).count() == 0
    files.write_jsonl(df, str(tmp_path / "d.jsonl"))
    assert spark.read.json(str(tmp_path / "d.jsonl")).filter("id_atto = '0012'").first()["testo_completo_llm"] == 'testo; con "virgolette" e riga'
    files.write_texts(df, str(tmp_path / "testi"))
    assert (tmp_path / "testi" / "0012_2_b_testo_completo_llm.txt").read_text() == "altro"


def test_old_columns_and_last_row(spark, tmp_path):
    (tmp_path / "v.csv").write_text("\ufeffid_atto;file_origine;ocr;testo_completo_llm;tipo\n1;x.pdf;0;primo;Decreto\n1;y.pdf;0;secondo;Decreto\n;z;0;t;\n", encoding="utf-8")
    got = files.read_dataset(spark, [str(tmp_path / "v.csv")]).collect()
    assert [tuple(r) for r in got] == [("1", "y.pdf", "0", "secondo", "Decreto")]


def test_audit_log(spark, tmp_path):
    (tmp_path / "audit_log.csv").write_text("id_atto;modello;input_tokens;costo_totale;timestamp\n1;m;1,0;0,5;2024-01-02 03:04:05\n2;m;;abc;ieri\n3;m;7;1;2024-01-01 00:00:00;di;troppo\n", encoding="utf-8")
    got = files.read_audit(spark, str(tmp_path / "audit_log.csv")).orderBy("id_atto").collect()
    assert got[0]["input_tokens"] == 1 and got[0]["costo_totale"] == 0.5 and str(got[0]["timestamp"]) == "2024-01-02 03:04:05"
    assert got[1]["input_tokens"] == 0 and got[1]["timestamp"] is None and got[1]["num_chunk_llm"] == 0
    files.append_audit(files.read_audit(spark, str(tmp_path / "audit_log.csv")).filter("id_atto = '1'"), str(tmp_path / "a"))
    files.append_audit(files.read_audit(spark, str(tmp_path / "audit_log.csv")).filter("id_atto = '1'"), str(tmp_path / "a"))
    assert files.read_audit(spark, str(tmp_path / "a")).count() == 2
    assert files.audit_file(str(tmp_path)).endswith("audit_log.csv")


def test_documents_and_texts(spark, tmp_path):
    for n, b in (("atto_10.pdf", b"dieci"), ("atto_2.pdf", b"due"), ("altro.pdf", b"due")):
        (tmp_path / n).write_bytes(b)
    (tmp_path / "atto_10.txt").write_text("testo\ndieci")
    (tmp_path / "atto_1.txt").write_text("testo uno")
    docs = files.documents(spark, str(tmp_path))
    assert [r["file_name"] for r in docs.collect()] == ["atto_2.pdf", "atto_10.pdf", "altro.pdf"]
    joined = {r["file_name"]: r["text"] for r in files.with_text(docs, files.texts(spark, str(tmp_path))).collect()}
    assert joined == {"atto_2.pdf": "", "atto_10.pdf": "testo\ndieci", "altro.pdf": ""}
    out = {r["file_name"]: (r["text"], r["errore"] != "") for r in files.extracted(docs, lambda b: b.decode() if b != b"dieci" else 1 / 0).collect()}
    assert out["atto_2.pdf"] == ("due", False) and out["atto_10.pdf"] == ("", True)
    with pytest.raises(ValueError, match="lack"):
        files.check_numbering(docs)
    with pytest.raises(ValueError, match="equal"):
        files.check_contents(docs)
    lack = files.copy_selected(spark.createDataFrame([("atto_2.pdf",), ("manca.pdf",)], "file_name string"), str(tmp_path), str(tmp_path / "copia"))
    assert lack == ["manca.pdf"] and (tmp_path / "copia" / "atto_2.pdf").exists()


def test_finding_files(spark, tmp_path):
    (tmp_path / "dati.csv").write_text("testo_completo_llm;golden_label\nuno;Determina\ndue;determinazione\ntre;Decreto\nquattro;decreto\n")
    (tmp_path / "solo.csv").write_text("testo_completo_llm;golden_label\nuno;Determina\ndue;determina\n")
    (tmp_path / "altro.csv").write_text("a;b\n1;2\n")
    assert [p.rsplit("/", 1)[1] for p in files.trainable_files(spark, str(tmp_path))] == ["dati.csv"]
    assert files.resolve(str(tmp_path), "dati") == files.resolve(str(tmp_path), "da") == str(tmp_path / "dati.csv")
    with pytest.raises(FileNotFoundError):
        files.resolve(str(tmp_path), "zzz")
    (tmp_path / "risultati_training_x.txt").write_text("")
    assert files.result_folders(str(tmp_path)) == [str(tmp_path)]


def test_matrix_report_and_splice(spark, tmp_path):
    (tmp_path / "m.csv").write_text(";pred_A;pred_B\nvero_A;3;1\nvero_B;0;4\n")
    conf = files.matrix_counts(files.read_matrix(spark, str(tmp_path / "m.csv")))
    r = metrics.summary(conf).first()
    assert r["accuracy"] == pytest.approx(7 / 8) and r["f1_macro"] == pytest.approx((6 / 7 + 8 / 9) / 2)
    text = files.metrics_text(metrics.summary(conf.withColumn("modello", F.lit("m")), ["modello"]), "Prova")
    assert "87.50%" in text
    once = files.splice("testa", "<<", ">>", "uno")
    assert once == "testa\n\n<<\nuno\n>>\n" and files.splice(once, "<<", ">>", r"due \1") == "testa\n\n<<\ndue \\1\n>>\n"
    files.manifest(str(tmp_path / "m.json"), a=[1], b={"c": "è"})
    assert "è" in (tmp_path / "m.json").read_text()
