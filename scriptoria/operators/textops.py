"""Queries of the text, conversion and filter operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.functions import convert as C
from scriptoria.functions import text as T
from scriptoria.functions.labels import REJECTED, canonical_label, normalize_label, not_blank
from scriptoria.plans import sqlkit as Q
from scriptoria.session import spread, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs(s: SparkSession, d: str, *cols) -> DataFrame:
    """Expressions over the documents' text, spread over the cores where files are few."""
    return spread(table(s, d, "documents").select("doc_id", "text")).select("doc_id", *cols)


t = "text"


@query(f"SELECT lang, count(*) AS n, avg({Q.quality('text')}) AS avg_score, count(*) FILTER (length({Q.collapse('text')}) >= 500 AND {Q.quality('text')} >= 75) AS sufficient FROM documents GROUP BY lang")
def quality_by_lang(s, d):
    """Flagship: quality, routing flag and counts by language."""
    x = spread(table(s, d, "documents").select("lang", "text")).select("lang", T.quality(t).alias("score"), (F.length(T.collapse(t)) >= 500).alias("long"))
    x = x.withColumn("ok", F.col("long") & (F.col("score") >= 75))
    return x.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("avg_score"), F.count_if("ok").alias("sufficient"))


@query(f"SELECT doc_id, {Q.collapse('text')} AS testo FROM documents")
def cell_normalize(s, d):
    """P1."""
    return docs(s, d, T.collapse(t).alias("testo"))


@query(f"SELECT doc_id, {Q.preclean('text')} AS testo FROM documents")
def line_preclean(s, d):
    """P2."""
    return docs(s, d, T.preclean(t).alias("testo"))


_CHUNKS = f"""WITH RECURSIVE src AS (SELECT doc_id, {Q.strip("coalesce(text, '')")} AS t FROM documents),
c(doc_id, t, n, st, en) AS (
 SELECT doc_id, t, 0, 0, 0 FROM src
 UNION ALL
 SELECT doc_id, t, n + 1, en, CASE WHEN stop < length(t) AND cut > 650 THEN en + cut + 1 ELSE stop END FROM
  (SELECT *, least(en + 1000, length(t)) AS stop, greatest({Q.rfind('w', chr(10))}, {Q.rfind('w', '. ')}, {Q.rfind('w', '; ')}) AS cut FROM
   (SELECT *, substr(t, en + 1, least(1000, length(t) - en)) AS w FROM c WHERE en < length(t) AND length(t) > 1000))),
p AS (SELECT doc_id, n, {Q.strip('substr(t, st + 1, en - st)')} AS piece FROM c WHERE n > 0
 UNION ALL SELECT doc_id, 1, t FROM src WHERE length(t) <= 1000)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INT) AS pos, piece FROM p WHERE length(piece) > 0 OR n = 1 AND NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = p.doc_id AND c.n > 0)"""


@query(_CHUNKS)
def chunk_text(s, d):
    """Chunks of 1000 characters, numbered."""
    x = docs(s, d, F.posexplode(T.chunks(t, 1000)).alias("pos", "piece"))
    return x.select("doc_id", (F.col("pos") + 1).alias("pos"), "piece")


@query(f"SELECT doc_id, {Q.truncate('text', '1000')} AS testo FROM documents")
def truncate_unit(s, d):
    """P4."""
    return docs(s, d, T.truncate_unit(t, 1000).alias("testo"))


@query(
    "SELECT doc_id, CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens,"
    " round(CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END / 1000 * 0.25, 6) AS costo FROM documents"
)
def token_estimate(s, d):
    """P5 and M5: estimated tokens and their price at 0.25 a thousand."""
    n = T.token_estimate(t)
    return docs(s, d, n.alias("tokens"), C.cost(n, F.lit(0.25)).alias("costo"))


_OUT = Q.strip("coalesce(testo_completo_llm, '')")
_OUT = Q.strip(f"regexp_replace({_OUT}, '^```(?:text|txt)?', '', 'i')")
_OUT = Q.strip(f"regexp_replace({_OUT}, '```$', '')")
_OUT = Q.strip(f"regexp_replace(regexp_replace(replace({_OUT}, chr(13), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g')")


@query(f"SELECT coppia_id, {_OUT} AS testo FROM coppie_llm")
def output_clean(s, d):
    """P6."""
    return table(s, d, "coppie_llm").select("coppia_id", T.output_clean(F.col("testo_completo_llm")).alias("testo"))


@query(f"SELECT doc_id, {Q.quality('text')} AS score, length({Q.collapse('text')}) >= 500 AND {Q.quality('text')} >= 75 AS sufficiente FROM documents")
def quality_score(s, d):
    """P7 and P8."""
    return docs(s, d, T.quality(t).alias("score"), T.sufficient(t).alias("sufficiente"))


@query(f"SELECT txt_id, CAST(i AS INT) AS linea, {Q.noisy('x')} AS rumore FROM (SELECT txt_id, unnest(string_split(txt, chr(10))) AS x, generate_subscripts(string_split(txt, chr(10)), 1) AS i FROM txt_opendataloader)")
def noisy_block(s, d):
    """P9, on the lines of scanned texts."""
    x = table(s, d, "txt_opendataloader").select("txt_id", F.posexplode(F.split("txt", "\n")).alias("i", "x"))
    return x.select("txt_id", (F.col("i") + 1).alias("linea"), T.noisy(F.col("x")).alias("rumore"))


_SELECT = f"""SELECT txt_id, {Q.truncate('sel', '1000')} AS testo FROM (SELECT txt_id, {Q.strip("coalesce(array_to_string(CASE WHEN len(u) > 0 THEN u ELSE b[1:8] END, chr(10) || chr(10)), '')")} AS sel FROM
 (SELECT txt_id, b, list_filter(b, lambda x, i: NOT {Q.noisy(Q.collapse('x'))} AND (i <= 4 OR regexp_matches(lower({Q.collapse('x')}), {Q.lit('|'.join(T.USEFUL))})
  OR (length({Q.collapse('x')}) > 350 AND {Q.quality('x')} >= 75))) AS u FROM (SELECT txt_id, {Q.blocks('txt')} AS b FROM txt_opendataloader)))"""


@query(_SELECT)
def block_select(s, d):
    """P10, on raw scanned texts."""
    return table(s, d, "txt_opendataloader").select("txt_id", T.select_blocks(F.col("txt"), 1000).alias("testo"))


_FILTER = f"""WITH b AS (SELECT txt_id, {Q.blocks('txt')} AS b FROM txt_opendataloader),
u AS (SELECT txt_id, unnest(b) AS x, generate_subscripts(b, 1) AS i FROM b),
c AS (SELECT *, left(regexp_replace(lower({Q.collapse('x')}), '[^a-z0-9]+', ' ', 'g'), 220) AS sig FROM u
 WHERE NOT {Q.noisy(Q.collapse('x'))} AND NOT regexp_matches(lower({Q.collapse('x')}), {Q.lit('|'.join(T.DISCARD))})),
o AS (SELECT *, row_number() OVER (PARTITION BY txt_id ORDER BY i) AS k FROM (SELECT *, row_number() OVER (PARTITION BY txt_id, sig ORDER BY i) AS r FROM c) WHERE r = 1),
g AS (SELECT txt_id, i, x FROM o WHERE k <= 2 UNION ALL
 SELECT txt_id, i, x FROM (SELECT *, row_number() OVER (PARTITION BY txt_id ORDER BY i) AS q FROM o WHERE k > 2 AND regexp_matches(lower({Q.collapse('x')}), '\\boggetto\\b')) WHERE q = 1),
j AS (SELECT txt_id, string_agg(x, chr(10) || chr(10) ORDER BY i) AS sel FROM g GROUP BY 1),
m AS (SELECT b.txt_id, {Q.strip("coalesce(j.sel, array_to_string(b.b[1:3], chr(10) || chr(10)), '')")} AS sel FROM b LEFT JOIN j USING (txt_id))
SELECT txt_id, {Q.truncate('sel', '750')} AS testo FROM m"""


@query(_FILTER)
def block_filter(s, d):
    """P11, on raw scanned texts."""
    return table(s, d, "txt_opendataloader").select("txt_id", T.filter_blocks(F.col("txt"), 750).alias("testo"))


@query(f"SELECT riga_id, {Q.ml_clean('testo_completo_llm')} AS testo_ml FROM dataset_atti")
def ml_clean(s, d):
    """P12."""
    return table(s, d, "dataset_atti").select("riga_id", T.ml_clean(F.col("testo_completo_llm")).alias("testo_ml"))


@query(f"SELECT riga_id, {Q.label('golden_label')} AS label, {Q.canonical('golden_label')} AS canonica FROM dataset_atti")
def label_canonical(s, d):
    """P13."""
    g = F.col("golden_label")
    return table(s, d, "dataset_atti").select("riga_id", normalize_label(g).alias("label"), canonical_label(g).alias("canonica"))


@query(f"SELECT riga_id, CASE WHEN {Q.strip(chr(108) + 'ower(coalesce(ocr, ' + chr(39) * 2 + '))')} IN ('1', 'si', 'sã¬', 'yes', 'true', 'ocr', 'usato') THEN '1' ELSE '0' END AS ocr FROM dataset_atti")
def ocr_flag(s, d):
    """P14."""
    return table(s, d, "dataset_atti").select("riga_id", T.truthy(F.col("ocr")).alias("ocr"))


_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(coalesce(nullif(modello, ''), 'modello_non_selezionato'), '[^A-Za-z0-9-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'modello_non_selezionato')"


@query(f"SELECT modello, {_SLUG} AS slug, replace({_SLUG}, '-', '_') AS slug_var, count(*) AS n FROM audit_log GROUP BY 1, 2, 3")
def model_slug(s, d):
    """P15, both variants."""
    x = table(s, d, "audit_log").select("modello", T.slug(F.col("modello")).alias("slug"), T.slug(F.col("modello"), keep_dash=False).alias("slug_var"))
    return x.groupBy("modello", "slug", "slug_var").agg(F.count(F.lit(1)).alias("n"))


_ACT = f"TRY_CAST(nullif(regexp_extract({Q.strip(f'lower({Q.stem(chr(102) + "ile_name")})')}, '^atto{Q.S}*(?:[_\\-]|{Q.S})*([0-9]+){Q.S}*$', 1), '') AS BIGINT)"


@query(f"SELECT riga_id, {Q.stem('file_name')} AS stem, {Q.name_number('file_name')} AS numero, {_ACT} AS atto FROM dataset_atti")
def name_numbers(s, d):
    """P16 and P17."""
    f = F.col("file_name")
    return table(s, d, "dataset_atti").select("riga_id", C.stem(f).alias("stem"), C.name_number(f).alias("numero"), C.act_number(f).alias("atto"))


_PAD = f"coalesce(TRY_CAST(nullif(regexp_extract(coalesce(id_atto, ''), '([0-9]+)', 1), '') AS BIGINT), {Q.name_number('file_name')})"


@query(f"SELECT riga_id, CASE WHEN {_PAD} IS NULL THEN '' WHEN {_PAD} < 10000 THEN lpad(CAST({_PAD} AS VARCHAR), 4, '0') ELSE CAST({_PAD} AS VARCHAR) END AS id, regexp_extract(coalesce(id_atto, ''), '([0-9]+)', 1) AS cifre FROM training_set")
def id_normalize(s, d):
    """P19 and P20."""
    i = F.col("id_atto")
    return table(s, d, "training_set").select("riga_id", C.padded_id(i, F.col("file_name")).alias("id"), C.id_digits(i).alias("cifre"))


_URI = "'file://' || replace(replace(url_encode(pdf_path_locale), '%2F', '/'), '*', '%2A')"


@query(f"SELECT audit_id, {_URI} AS uri, pdf_link = {_URI} AS uguale FROM audit_log")
def path_uri(s, d):
    """P22."""
    u = C.file_uri(F.col("pdf_path_locale"))
    return table(s, d, "audit_log").select("audit_id", u.alias("uri"), (F.col("pdf_link") == u).alias("uguale"))


@query("SELECT esperimento, nullif(regexp_extract(esperimento, '^(.+)_pipeline_([AB])$', 1), '') AS modello, nullif(regexp_extract(esperimento, '^(.+)_pipeline_([AB])$', 2), '') AS pipeline, count(*) AS n FROM audit_log GROUP BY 1, 2, 3")
def experiment_parse(s, d):
    """P23."""
    x = table(s, d, "audit_log").select("esperimento", C.experiment(F.col("esperimento")).alias("e"))
    return x.groupBy("esperimento", F.col("e.modello").alias("modello"), F.col("e.pipeline").alias("pipeline")).agg(F.count(F.lit(1)).alias("n"))


_DIRTY = "CASE audit_id % 7 WHEN 0 THEN replace(CAST(avg_input_tokens_per_chunk AS VARCHAR), '.', ',') WHEN 1 THEN ' ' || CAST(input_tokens AS VARCHAR) || ' ' WHEN 2 THEN '' WHEN 3 THEN 'abc' WHEN 4 THEN '1.234,5' WHEN 5 THEN NULL ELSE CAST(input_tokens AS VARCHAR) || '.75' END"


@query(f"SELECT audit_id, {Q.number('v')} AS numero, CAST(trunc({Q.number('v')}) AS BIGINT) AS intero FROM (SELECT audit_id, {_DIRTY} AS v FROM audit_log)")
def lenient_numbers(s, d):
    """M1 and M2, on figures written in several ways."""
    k, n = F.col("audit_id") % 7, F.col("input_tokens").cast("string")
    v = (
        F.when(k == 0, F.regexp_replace(F.col("avg_input_tokens_per_chunk").cast("string"), r"\.", ","))
        .when(k == 1, F.concat(F.lit(" "), n, F.lit(" ")))
        .when(k == 2, "")
        .when(k == 3, "abc")
        .when(k == 4, "1.234,5")
        .when(k == 5, F.lit(None))
        .otherwise(F.concat(n, F.lit(".75")))
    )
    return table(s, d, "audit_log").select("audit_id", v.alias("v")).select("audit_id", C.number(F.col("v")).alias("numero"), C.whole(F.col("v")).alias("intero"))


_STAMP = "CASE WHEN audit_id % 11 = 0 THEN 'n/d' ELSE strftime(registrato_il, '%Y-%m-%d %H:%M:%S') END"


@query(
    f"""WITH x AS (SELECT esperimento, TRY_CAST({_STAMP} AS TIMESTAMP) AS ts FROM audit_log),
g AS (SELECT esperimento, min(ts) AS inizio, max(ts) AS fine, CAST(epoch(max(ts)) - epoch(min(ts)) AS BIGINT) AS sec FROM x GROUP BY 1)
SELECT esperimento, inizio, fine, CASE WHEN sec IS NULL THEN 'n/d' ELSE format('{{:02d}}:{{:02d}}:{{:02d}}', sec // 3600, sec % 3600 // 60, sec % 60) END AS durata FROM g"""
)
def observed_duration(s, d):
    """M3 and M4, per experiment; texts that are no timestamp are left out."""
    ts = F.when(F.col("audit_id") % 11 == 0, "n/d").otherwise(F.date_format("registrato_il", "yyyy-MM-dd HH:mm:ss"))
    x = table(s, d, "audit_log").select("esperimento", C.stamp(ts).alias("ts"))
    g = x.groupBy("esperimento").agg(F.min("ts").alias("inizio"), F.max("ts").alias("fine"))
    return g.withColumn("durata", C.duration(F.unix_timestamp("fine") - F.unix_timestamp("inizio")))


@query("SELECT esperimento, 100.0 * sum(coalesce(fallback_locale, 0)) / count(*) AS fallback_pct, sum(coalesce(total_tokens, 0)) / greatest(count(*), 1) AS token_medi FROM audit_log GROUP BY 1")
def percent_table(s, d):
    """M6 and M7, unrounded."""
    z = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    n = F.count(F.lit(1))
    return table(s, d, "audit_log").groupBy("esperimento").agg((100.0 * z("fallback_locale") / n).alias("fallback_pct"), C.average(z("total_tokens"), n).alias("token_medi"))


@query(
    """SELECT txt_id, v AS variante, CASE WHEN n <= h + t THEN range(n) ELSE list_concat(range(h), range(greatest(n - t, h), n)) END AS pagine, range(least(n, 3)) AS prime
FROM (SELECT txt_id, num_pagine * 4 AS n FROM txt_opendataloader) CROSS JOIN (VALUES ('A', 7, 7), ('B', 5, 3)) AS p(v, h, t)"""
)
def page_windows(s, d):
    """M8 and M9, for the windows of either pipeline."""
    x = table(s, d, "txt_opendataloader").select("txt_id", (F.col("num_pagine") * 4).alias("n"))
    v = F.explode(F.array(*[F.struct(F.lit(k).alias("v"), F.lit(h).alias("h"), F.lit(e).alias("t")) for k, h, e in (("A", 7, 7), ("B", 5, 3))])).alias("p")
    y = x.select("txt_id", "n", v)
    return y.select("txt_id", F.col("p.v").alias("variante"), C.page_window(F.col("n"), F.col("p.h"), F.col("p.t")).cast("array<bigint>").alias("pagine"), C.first_pages(F.col("n"), 3).cast("array<bigint>").alias("prime"))


_BAD = ", ".join(Q.lit(x) for x in REJECTED)


@query(
    f"""WITH x AS (SELECT riga_id, {Q.label('golden_label')} AS label, {Q.ml_clean('testo_completo_llm')} AS tm FROM dataset_atti),
f AS (SELECT * FROM x WHERE tm <> '' AND label <> '' AND lower(label) NOT IN ({_BAD}))
SELECT riga_id, label FROM f WHERE label IN (SELECT label FROM f GROUP BY 1 HAVING count(*) >= 2)"""
)
def training_rows(s, d):
    """Rows fit for training."""
    return prepared(table(s, d, "dataset_atti")).select("riga_id", "label")


def prepared(rows: DataFrame) -> DataFrame:
    """Rows with label and testo_ml: text and label not empty, label not rejected, its
    class of two rows at least. Classes are counted with partial aggregation and joined
    back, so that a class that holds a third of the rows sits in no single task."""
    x = rows.withColumn("label", normalize_label(F.col("golden_label"))).withColumn("testo_ml", T.ml_clean(F.col("testo_completo_llm")))
    x = x.filter((F.length("testo_ml") > 0) & (F.length("label") > 0) & ~F.lower("label").isin(*REJECTED))
    classes = x.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("label")
    return x.join(classes, "label", "left_semi")


@query(f"SELECT esperimento, count(*) AS righe, count(*) FILTER ({Q.strip('testo_completo_llm')} <> '') AS valide FROM dataset_atti GROUP BY 1")
def valid_records(s, d):
    """rows with text."""
    return table(s, d, "dataset_atti").groupBy("esperimento").agg(F.count(F.lit(1)).alias("righe"), F.count_if(not_blank(F.col("testo_completo_llm"))).alias("valide"))


@query(f"SELECT modello, count(*) AS runs, count(*) FILTER ({Q.strip('errore_tecnico')} <> '') AS errori FROM audit_log GROUP BY 1")
def error_rows(s, d):
    """runs with a technical error."""
    return table(s, d, "audit_log").groupBy("modello").agg(F.count(F.lit(1)).alias("runs"), F.count_if(not_blank(F.col("errore_tecnico"))).alias("errori"))


_VARIANTS = (("A", 7, 7, 1000, 2500), ("B", 5, 3, 750, 900), ("VF", 5, 3, 1000, 2500), ("VL", 7, 7, 750, 900), ("VO", 7, 7, 1000, 2500), ("VP", 7, 7, 1000, 2500))


@query(
    "SELECT variante, count(*) AS n, avg(length(inp)) AS media_input, avg(length(outp)) AS media_output FROM (SELECT v.variante, "
    + Q.truncate("pc", "v.mi")
    + " AS inp, "
    + Q.truncate("pc", "v.mo")
    + f" AS outp FROM (SELECT {Q.preclean('text')} AS pc FROM documents) d CROSS JOIN (VALUES "
    + ", ".join(f"('{v}', {i}, {o})" for v, _, _, i, o in _VARIANTS)
    + ") AS v(variante, mi, mo)) GROUP BY 1"
)
def variant_sweep(s, d):
    """The parameter sweep: every variant's limits on every document."""
    limits = F.array(*[F.struct(F.lit(k).alias("variante"), F.lit(i).alias("mi"), F.lit(o).alias("mo")) for k, _, _, i, o in _VARIANTS])

    def all_(pc):  # the cleaned text is computed once for all variants
        one = lambda v: F.struct(v["variante"].alias("variante"), T.truncate_unit(pc, v["mi"]).alias("inp"), T.truncate_unit(pc, v["mo"]).alias("outp"))
        return F.transform(limits, one)

    x = docs(s, d, F.explode(T.let(T.preclean(t), all_)).alias("v")).select("v.*")
    return x.groupBy("variante").agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("inp")).alias("media_input"), F.avg(F.length("outp")).alias("media_output"))
