"""Text expressions against plain Python written from their description."""

import re

import pytest
from pyspark.sql import functions as F

from scriptoria.functions import convert as C
from scriptoria.functions import text as T
from scriptoria.functions.labels import canonical, canonical_label, normalize_label

EDGES = [
    None, "", "   ", "\u00a0\t\n", "città è 12 _\u00a0,; x", "a", "....\n----\n||||", "Visto il decreto.\r\nOggetto: prova\r\n\r\nfirma digitale\n\npagina 1 di 2",
    "parola " * 200, "x" * 999, "x" * 1000, "x" * 1001, "x" * 3200, "Una frase. " * 150, "riga\n" * 400, "fine; " * 300,
    "primo blocco\n\nsecondo blocco\n\nprimo blocco\n\nterzo\n\nOggetto: quarto\n\nOggetto: quinto", "```txt\nciao\r\r\r\rfine  qui\n```", "a\u2028b\u0085c\u000bd", "\U0001f600 prova " * 90,
]


def col(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")


def run(spark, expr, values=EDGES):
    return [r[0] for r in col(spark, values).select("i", expr.alias("x")).orderBy("i").select("x").collect()]


def collapse(t):
    return re.sub(r"\s+", " ", t or "").strip()


def letters(t):
    return sum(c.isalpha() for c in t)


def symbols(t):
    return sum(not (c.isalnum() or c == "_" or c.isspace()) for c in t)


def preclean(t):
    out = []
    for line in (t or "").replace("\r", "\n").replace("\t", " ").splitlines():
        line = collapse(line)
        if not line or (letters(line) < 3 and symbols(line) > letters(line)):
            continue
        for p in (r"[|_]{3,}", r"\.{5,}", r"[-=]{5,}"):
            line = re.sub(p, " ", line)
        if collapse(line):
            out.append(collapse(line))
    return "\n".join(out)


def truncate(t, most):
    t = t or ""
    if len(t) <= most:
        return t
    w = t[:most]
    cut = max(w.rfind(p) for p in T.UNIT_ENDS)
    if cut < int(most * 0.75):
        cut = w.rfind(" ")
    if cut <= 0:
        cut = most
    return re.sub(r"[,;:\-\s]+$", ".", t[: cut + 1].strip()).strip()


def chunks(t, most, overlap=0):
    t = (t or "").strip()
    if len(t) <= most:
        return [t]
    out, start = [], 0
    while True:
        end = min(start + most, len(t))
        if end < len(t):
            cut = max(t[start:end].rfind(p) for p in ("\n", ". ", "; "))
            if cut > most * 0.65:
                end = start + cut + 1
        out.append(t[start:end].strip())
        if end >= len(t):
            return [c for c in out if c]
        start = max(0, end - overlap)


def quality(t):
    t = collapse(t)
    if not t:
        return 0
    n = len(t)
    s = min(40, n // 80) + min(25, int(letters(t) / n * 100 / 2.5)) - min(20, int(symbols(t) / n * 100))
    s += min(20, 4 * sum(k in t.lower() for k in T.KEYWORDS)) + (5 if any(c.isdigit() for c in t) else 0)
    return max(0, min(100, s))


def test_line_operators(spark):
    assert run(spark, T.collapse(F.col("c"))) == [collapse(t) for t in EDGES]
    assert run(spark, T.preclean(F.col("c"))) == [preclean(t) for t in EDGES]
    assert run(spark, T.quality(F.col("c"))) == [quality(t) for t in EDGES]


@pytest.mark.parametrize("most", [750, 900, 1000, 2500])
def test_truncate(spark, most):
    assert run(spark, T.truncate_unit(F.col("c"), most)) == [truncate(t, most) for t in EDGES]


@pytest.mark.parametrize(("most", "overlap"), [(1000, 0), (750, 0), (300, 50)])
def test_chunks(spark, most, overlap):
    assert run(spark, T.chunks(F.col("c"), most, overlap)) == [chunks(t, most, overlap) for t in EDGES]


def test_blocks(spark):
    t = ["primo blocco\n\nfirma digitale\n\nsecondo blocco\n\nprimo blocco\n\nterzo\n\nOggetto: quarto\n\nOggetto: quinto", "firma digitale\n\nhash", None]
    assert run(spark, T.select_blocks(F.col("c"), None), t) == [
        "primo blocco\n\nsecondo blocco\n\nprimo blocco\n\nOggetto: quarto\n\nOggetto: quinto",
        "firma digitale\n\nhash",
        "",
    ]
    assert run(spark, T.filter_blocks(F.col("c"), None), t) == ["primo blocco\n\nsecondo blocco\n\nOggetto: quarto", "firma digitale\n\nhash", ""]
    assert run(spark, T.noisy(F.col("c")), ["", None, "Pagina 3 di 9", "***", "testo utile"]) == [True, True, True, True, False]


def test_small_strings(spark):
    assert run(spark, T.output_clean(F.col("c")), ["```txt\nciao\r\r\r\rfine  qui\n```", None]) == ["ciao\n\nfine qui", ""]
    assert run(spark, T.token_estimate(F.col("c")), [None, "", "abc", "a" * 41]) == [0, 0, 1, 10]
    assert run(spark, T.ml_clean(F.col("c")), ["La SOCIETÀ è 2²!", None]) == ["la societ 2²", ""]
    assert run(spark, T.ml_clean(F.col("c"), keep_accents=True), ["La SOCIETÀ è"]) == ["la società è"]
    assert run(spark, T.truthy(F.col("c")), ["1", " SI ", "ocr", "no", "", None, "0"]) == ["1", "1", "1", "0", "0", "0", "0"]
    assert run(spark, T.slug(F.col("c")), ["gemma3:4b", "llama-3.1:8b", None, "::"]) == ["gemma3_4b", "llama-3_1_8b", "modello_non_selezionato", "modello_non_selezionato"]
    assert run(spark, T.slug(F.col("c"), keep_dash=False), ["llama-3.1"]) == ["llama_3_1"]


def test_conversions(spark):
    cells = ["12", "1,5", "1.234,5", "", "abc", "nan", None, " 7 ", "1e3", "1d", "-2,5"]
    assert run(spark, C.number(F.col("c")), cells) == [12.0, 1.5, 0.0, 0.0, 0.0, 0.0, 0.0, 7.0, 1000.0, 0.0, -2.5]
    assert run(spark, C.whole(F.col("c")), ["1,9", "-1.9", "x"]) == [1, -1, 0]
    assert run(spark, C.duration(F.col("c").cast("bigint")), ["0", "3661", "360000", None]) == ["00:00:00", "01:01:01", "100:00:00", "n/d"]
    assert [str(x) for x in run(spark, C.stamp(F.col("c")), ["2024-01-02 03:04:05", "ieri", None])] == ["2024-01-02 03:04:05", "None", "None"]
    names = ["atto_1.pdf", "atto 01.pdf", "Atto-12 .pdf", "x.pdf", "atto_0.pdf", None, "atto_3 (copia).pdf"]
    assert run(spark, C.name_number(F.col("c")), names) == [1, 1, 12, None, 0, None, 3]
    assert run(spark, C.act_number(F.col("c")), names) == [1, 1, 12, None, 0, None, None]
    assert run(spark, C.padded_id(F.col("c")), ["5", "12345", " 7_2", "x", None]) == ["0005", "12345", "0007", "", ""]
    assert run(spark, C.id_digits(F.col("c")), ["007", "a12b3", "", None]) == ["007", "12", "", ""]
    windows = run(spark, C.page_window(F.col("c").cast("int"), 3, 2), ["0", "4", "5", "6", "10", None])
    assert windows == [[], [0, 1, 2, 3], [0, 1, 2, 3, 4], [0, 1, 2, 4, 5], [0, 1, 2, 8, 9], []]
    assert run(spark, C.first_pages(F.col("c").cast("int"), 3), ["0", "2", "9"]) == [[], [0, 1], [0, 1, 2]]
    assert C.effective_test_share(10, 8) == 0.8 and C.effective_test_share(100, 8) == 0.25 and C.effective_test_share(0, 0) == 0.25
    assert [tuple(x) for x in run(spark, C.experiment(F.col("c")), ["gemma3_4b_pipeline_A", "altro", None])] == [("gemma3_4b", "A"), (None, None), (None, None)]


def test_labels(spark):
    v = [" Deliberazione della GIUNTA ", "determina", "DeliberaGiunta", "ambigua", "", None]
    assert run(spark, normalize_label(F.col("c")), v) == ["DeliberaGiunta", "Determina", "DeliberaGiunta", "ambigua", "", ""]
    assert run(spark, canonical_label(F.col("c")), v) == ["DeliberaGiunta", "Determina", "DeliberaGiunta", None, None, None] == [canonical(x) for x in v]


def test_file_uri_escapes_as_paths_do(spark):
    from pathlib import Path

    from scriptoria.functions import convert

    paths = ["/a b/perché #1.pdf", "/100%/x?y=z&w;v.pdf", "/at@to/[1]{2}~*'(3)!.pdf", "/semplice/atto_1.pdf", None]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(convert.file_uri(F.col("p"))).collect()] == [p and Path(p).as_uri() for p in paths]
