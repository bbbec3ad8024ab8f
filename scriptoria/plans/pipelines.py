"""The three pipelines end to end, composed of the operators.

Extraction: documents -> native text -> score -> OCR only where needed -> route -> clean
-> dataset rows and audit rows. Training: prepare -> split -> fit and predict -> metrics
and cross-validation. Audit: the log's summary spliced into a report.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.functions import convert as C
from scriptoria.functions import text as T
from scriptoria.functions.labels import not_blank
from scriptoria.operators import learn, metrics
from scriptoria.operators.cleaning import VARIANTS, Model, Variant, clean_texts
from scriptoria.operators.ranking import total_rank
from scriptoria.operators.relational import audit_rows, route, stratified_split
from scriptoria.operators.textops import prepared
from scriptoria.session import cut
from scriptoria.sources import files

Reader = Callable[[bytes], str]


def with_ids(docs: DataFrame) -> DataFrame:
    """Documents with id_atto: the number in the name, else the position in natural order;
    later documents of one number get suffixes."""
    from pyspark.sql import Window

    x = total_rank(docs, *C.natural_key(F.col("file_name")), F.col("file_name"))
    x = x.withColumn("__base", F.coalesce(F.nullif(C.name_number(F.col("file_name")), F.lit(0)), F.col("pos")))
    x = x.withColumn("__k", F.row_number().over(Window.partitionBy("__base").orderBy("pos")))
    suffix = F.when(F.col("__k") > 1, F.concat(F.lit("_"), F.col("__k"))).otherwise("")
    return x.withColumn("id_atto", F.concat(F.format_string("%04d", "__base"), suffix)).drop("__base", "__k", "pos")


def routed_texts(docs: DataFrame, native: Reader, ocr: Reader | None = None, least: int = 75, force_ocr: bool = False) -> DataFrame:
    """(id_atto, file_name, path, uri, text, ocr, errore) of (id_atto, file_name, path,
    uri, content): OCR runs on those documents alone whose native text is not good
    enough, as a stage of its own, since a UDF inside CASE WHEN would run on all rows."""
    keep = ["id_atto", "file_name", "path", "uri"]
    first = files.extracted(docs.select(*keep, "content"), native).select(*keep, F.col("text").alias("native"))
    first = cut(first.withColumn("ns", F.when(not_blank(F.col("native")), T.quality(F.col("native")))))
    enough = T.sufficient(F.col("native"), least_score=least) & F.lit(not force_ocr)
    done = first.filter(enough).select(*keep, F.col("native").alias("text"), F.lit("0").alias("ocr"), F.lit("").alias("errore"))
    todo = first.filter(~enough)
    if ocr is None:
        second = todo.withColumn("scan", F.lit("")).withColumn("os", F.lit(None).cast("bigint"))
    else:
        work = docs.select("id_atto", "content").join(todo.select("id_atto"), "id_atto", "left_semi")
        scans = files.extracted(work, ocr).select("id_atto", F.col("text").alias("scan"))
        second = todo.join(scans, "id_atto", "left").withColumn("os", F.when(not_blank(F.col("scan")), T.quality(F.col("scan"))))
    via = route(F.lit(None).cast("bigint") if force_ocr else F.col("ns"), F.col("os"), least=101)
    rest = second.withColumn("via", via).select(
        *keep,
        F.when(F.col("via") == "ocr", F.col("scan")).when(F.col("via") == "nativo", F.col("native")).otherwise("").alias("text"),
        F.when(F.col("via") == "nativo", "0").otherwise("1").alias("ocr"),
        F.when(F.col("via") == "errore", "Testo non disponibile per atto").otherwise("").alias("errore"),
    )
    return done.unionByName(rest)


@dataclass
class Extraction:
    """What one run yields: the whole dataset after it, and the audit rows of its documents."""

    dataset: DataFrame
    audit: DataFrame


def extract(
    docs: DataFrame, existing: DataFrame, native: Reader, ocr: Reader | None = None, model: Model | None = None,
    variant: Variant = VARIANTS["A"], model_name: str = "locale", force_ids: tuple[str, ...] = (),
) -> Extraction:
    """New and forced documents through the pipeline, merged over the existing dataset.

    A document is skipped if its existing row has text, unless forced or the variant
    reprocesses all. The label of an existing row is carried over; a failed document
    has empty text. Skipped documents leave no audit row.
    """
    if variant.check_sequence:
        files.check_numbering(docs)
        files.check_contents(docs)
    ids = with_ids(docs)
    if not variant.reprocess_all:
        valid = existing.filter(not_blank(F.col("testo_completo_llm"))).select("id_atto").filter(~F.col("id_atto").isin(*force_ids)) if force_ids else existing.filter(not_blank(F.col("testo_completo_llm"))).select("id_atto")
        ids = ids.join(valid.distinct(), "id_atto", "left_anti")
    texts = cut(routed_texts(ids, native, ocr))
    cleaned = cut(clean_texts(texts, "id_atto", "text", variant, model).withColumnRenamed("id", "id_atto"))
    run = texts.drop("text").join(cleaned, "id_atto")
    old = existing.select("id_atto", *[F.col(c).alias(f"__{c}") for c in files.DATASET[1:]])
    new = run.select("id_atto", "file_name", "ocr", F.col("testo").alias("testo_completo_llm"))
    merged = new.join(old, "id_atto", "full").select(
        "id_atto",
        F.coalesce("file_name", "__file_name").alias("file_name"),
        F.coalesce("ocr", "__ocr").alias("ocr"),
        F.coalesce("testo_completo_llm", "__testo_completo_llm", F.lit("")).alias("testo_completo_llm"),
        F.coalesce("__golden_label", F.lit("")).alias("golden_label"),
    )
    audit = audit_rows(
        run.withColumn("pdf_path_locale", F.col("path")).withColumn("pdf_link", F.col("uri")).withColumn("modello", F.lit(model_name))
    )
    return Extraction(merged, audit)


@dataclass
class Training:
    """Split rows, test predictions, and the metrics of test and cross-validation."""

    split: DataFrame
    predictions: DataFrame
    test_summary: DataFrame
    cv_summary: DataFrame
    cv_confusion: DataFrame


def train(rows: DataFrame, id_: str = "riga_id", most: int = learn.MOST_ROWS, models: tuple[str, ...] = tuple(learn.MODELS)) -> Training:
    """Prepare, split, fit, predict and cross-validate; ValueError where fewer than two
    classes are left. All rows are split and all test rows predicted; only the fits, in a
    task of their own, take ``most`` of the training rows (learn.fit_sample)."""
    good = cut(prepared(rows).select(F.col(id_).alias("id"), "label", F.col("testo_ml").alias("t")))
    good = good.join(good.groupBy("label").count().filter("count >= 2").select("label"), "label", "left_semi")
    if good.select("label").distinct().limit(2).count() < 2:
        raise ValueError("not trainable: fewer than two classes")
    split = cut(stratified_split(good, "label", "id"))
    named = split.select("id", F.col("label").alias("y"), "t", "split", F.lit(0).alias("run"))
    fitted = learn.fitted_runs(learn.fit_sample(named.filter("split = 'train'"), "y", "id", most), models)
    pred = cut(learn.predicted(named.filter("split = 'test'").withColumn("fold", F.col("run")), fitted).drop("fold"))
    cv = cut(learn.cross_validate(good.withColumn("id", F.col("id").cast("bigint")), "id", "label", "t", most, models))
    summary = metrics.summary(metrics.confusion(pred, ["modello"]), ["modello"])
    return Training(split, pred, summary, metrics.fold_summary(cv), metrics.confusion(cv, ["modello"]))


def audit_section(audit: DataFrame) -> str:
    """The audit log in a few lines of text."""
    r = audit.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(C.whole(F.col("ocr"))), F.lit(0)).alias("ocr"),
        F.coalesce(F.sum("fallback_locale"), F.lit(0)).alias("fallback"),
        F.count_if(not_blank(F.col("errore_tecnico"))).alias("errori"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("token"),
        C.duration(F.unix_timestamp(F.max("timestamp")) - F.unix_timestamp(F.min("timestamp"))).alias("durata"),
    ).first()
    return "\n".join(f"{k}: {v}" for k, v in (("record audit", r["n"]), ("ocr usati", r["ocr"]), ("fallback locale", r["fallback"]), ("errori tecnici", r["errori"]), ("token totali", r["token"]), ("durata osservata", r["durata"])))


def update_report(report: str, audit: DataFrame, start: str = "<!-- audit -->", end: str = "<!-- /audit -->") -> str:
    """A report's text with its audit section brought up to date."""
    return files.splice(report, start, end, audit_section(audit))


