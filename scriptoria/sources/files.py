"""Sources and sinks: documents, texts, delimited datasets, audit logs, reports."""

from __future__ import annotations

import glob
import json
import os
import re
import shutil
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptoria.functions import convert as C

from scriptoria.functions.text import strip

DATASET = ("id_atto", "file_name", "ocr", "testo_completo_llm", "golden_label")
#: Older column names that are read as the present ones.
ALIASES = {"file_origine": "file_name", "tipo": "golden_label"}
AUDIT = (
    "id_atto", "file_name", "pdf_path_locale", "pdf_link", "txt_path_locale", "txt_link", "testo_llm_path_locale", "testo_llm_link", "ocr", "errore_tecnico",
    "fallback_locale", "modello", "input_tokens", "output_tokens", "total_tokens", "costo_input", "costo_output", "costo_totale",
    "avg_input_tokens_per_chunk", "avg_output_tokens_per_chunk", "avg_total_tokens_per_chunk", "num_chunk_llm", "timestamp",
)
READ = {"sep": ";", "header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
WRITE = {"sep": ";", "header": True, "quote": '"', "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


# --- sources


def documents(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Files of a folder in natural order with content and URI; files without a
    byte are none."""
    x = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    x = x.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "modificationTime", "length", "content").withColumn("file_name", F.regexp_replace("path", r"^.*/", ""))
    return x.withColumn("uri", C.file_uri(F.col("path"))).orderBy(*C.natural_key(F.col("file_name")), "file_name")


def texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """Whole text files by name."""
    x = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern)
    return x.select(F.regexp_replace(F.col("_metadata.file_name"), "%20", " ").alias("file_name"), F.col("value").alias("text"))


def stem_key(name):
    """A file's stem, lower case and without blanks: the key names are matched by."""
    return F.regexp_replace(F.lower(C.stem(name)), r"(?U)\s+", "")


def with_text(docs: DataFrame, text_files: DataFrame) -> DataFrame:
    """S3: documents with the text of equal stem, '' where there is none. Only equal
    stems match: a name that is part of another one does not."""
    t = text_files.select(stem_key(F.col("file_name")).alias("__k"), F.col("text")).groupBy("__k").agg(F.min("text").alias("text"))
    x = docs.withColumn("__k", stem_key(F.col("file_name")))
    return x.join(t, "__k", "left").drop("__k").withColumn("text", F.coalesce("text", F.lit("")))


def read_strings(spark: SparkSession, path: str | list[str], mode: str = "PERMISSIVE") -> DataFrame:
    """A delimited file with every column a string and nulls as ''."""
    return spark.read.options(**READ, mode=mode, inferSchema=False).csv(path).na.fill("")


def read_dataset(spark: SparkSession, candidates: list[str]) -> DataFrame:
    """The first dataset file that exists, older column names taken over; the last
    row of an id wins. Suffixed ids are ids of their own."""
    path = next((p for p in candidates if os.path.exists(p)), None)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in DATASET])
    if path is None:
        return spark.createDataFrame([], schema)
    x = spark.read.options(**READ, inferSchema=False).csv(path)
    x = x.withColumn("__row", F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    for old, new in ALIASES.items():
        if old in x.columns:
            x = x.withColumn(new, F.coalesce(F.nullif(F.col(new), F.lit("")), F.col(old)) if new in x.columns else F.col(old)).drop(old)
    x = x.select("__row", *[(F.coalesce(F.col(c), F.lit("")) if c in x.columns else F.lit("")).alias(c) for c in DATASET])
    x = x.withColumn("id_atto", strip(F.col("id_atto"))).filter("id_atto <> ''")
    last = x.groupBy("id_atto").agg(F.max_by(F.struct(*DATASET[1:]), "__row").alias("r"))
    return last.select("id_atto", "r.*")


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """A training file; the two columns it cannot do without are checked."""
    x = read_strings(spark, path)
    lack = {"testo_completo_llm", "golden_label"} - set(x.columns)
    if lack:
        raise ValueError(f"missing columns: {', '.join(sorted(lack))}")
    return x


def read_audit(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """An audit log; rows with too many fields are dropped, figures and
    times parsed leniently, numeric columns that lack are 0."""
    x = spark.read.options(**READ, mode="DROPMALFORMED", inferSchema=False).csv(path)
    whole = {"fallback_locale", "input_tokens", "output_tokens", "total_tokens", "num_chunk_llm"}
    real = {c for c in AUDIT if c.startswith(("costo_", "avg_"))}

    def col(c: str):
        if c in whole or c in real:
            v = C.number(F.col(c)) if c in x.columns else F.lit(0.0)
            return v.cast("bigint" if c in whole else "double").alias(c)
        v = F.col(c) if c in x.columns else F.lit(None).cast("string")
        return (C.stamp(v) if c == "timestamp" else v).alias(c)

    return x.select(*[col(c) for c in AUDIT])


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A confusion matrix or report file; its first, unnamed column is 'label'."""
    x = spark.read.options(**READ, inferSchema=True).csv(path)
    return x.withColumnRenamed(x.columns[0], "label").withColumn("label", F.regexp_replace("label", "^vero_", ""))


def matrix_counts(matrix: DataFrame) -> DataFrame:
    """A wide confusion matrix as (y_true, y_pred, n)."""
    cols = [c for c in matrix.columns if c.startswith("pred_")]
    return matrix.unpivot("label", cols, "y_pred", "n").select(F.col("label").alias("y_true"), F.regexp_replace("y_pred", "^pred_", "").alias("y_pred"), F.col("n").cast("bigint").alias("n"))


def extracted(docs: DataFrame, extract: Callable[[bytes], str]) -> DataFrame:
    """Text of each document's bytes by a plug (a PDF reader, an OCR engine);
    a document on which it raises has '' and the error."""
    keep = [c for c in docs.columns if c != "content"]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("errore", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, bad = [], []
            for content in b["content"]:
                try:
                    out.append(extract(content) or "")
                    bad.append("")
                except Exception as e:  # noqa: BLE001
                    out.append("")
                    bad.append(str(e))
            yield b[keep].assign(text=out, errore=bad)

    return docs.mapInPandas(run, schema)


def trainable(spark: SparkSession, path: str) -> bool:
    """Has both columns, two rows with text and label, two labels as training sees them."""
    from scriptoria.operators.textops import prepared

    try:
        x = read_training(spark, path)
    except ValueError:
        return False
    n, k = prepared(x).agg(F.count(F.lit(1)), F.count_distinct("label")).first()
    return n >= 2 and k >= 2


def trainable_files(spark: SparkSession, folder: str) -> list[str]:
    return [p for p in sorted(glob.glob(f"{folder}/**/*.csv", recursive=True)) if trainable(spark, p)]


def resolve(folder: str, name: str) -> str:
    """A dataset by its exact name, with .csv, or by a prefix that only one file has."""
    for p in (os.path.join(folder, name), os.path.join(folder, name + ".csv")):
        if os.path.isfile(p):
            return p
    hits = sorted(glob.glob(os.path.join(folder, glob.escape(name) + "*.csv")))
    if len(hits) != 1:
        raise FileNotFoundError(f"{name}: {'no file' if not hits else ', '.join(map(os.path.basename, hits))}")
    return hits[0]


def result_folders(base: str) -> list[str]:
    """Folders that hold a training report."""
    return sorted({os.path.dirname(p) for p in glob.glob(f"{base}/**/risultati_training*.txt", recursive=True)})


def audit_file(folder: str) -> str:
    """The audit log of a dataset folder."""
    hits = sorted(glob.glob(f"{folder}/audit_log*.csv"))
    if not hits:
        raise FileNotFoundError(f"no audit log in {folder}")
    return hits[0]


# --- sinks


def write_dataset(rows: DataFrame, path: str) -> None:
    """K1: the five fields, overwritten once a batch."""
    rows.select(*DATASET).write.mode("overwrite").options(**WRITE).csv(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """K2: one object a line, text without line breaks."""
    from scriptoria.functions.text import collapse

    rows.select(*[collapse(F.col(c)).alias(c) if c == "testo_completo_llm" else F.col(c) for c in DATASET]).write.mode("overwrite").json(path)


def append_audit(rows: DataFrame, path: str) -> None:
    """K3: rows appended to the audit log's folder."""
    rows.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).select(*AUDIT).write.mode("append").options(**WRITE).csv(path)


def write_texts(rows: DataFrame, folder: str) -> None:
    """K4: a text file <id>_<stem>_testo_completo_llm.txt a row, from the tasks. The
    folder must be one that all executors share."""
    os.makedirs(folder, exist_ok=True)

    def put(part) -> None:
        for r in part:
            with open(os.path.join(folder, f"{r['id_atto']}_{r['s']}_testo_completo_llm.txt"), "w", encoding="utf-8") as f:
                f.write(r["testo_completo_llm"] or "")

    rows.select("id_atto", C.stem(F.col("file_name")).alias("s"), "testo_completo_llm").foreachPartition(put)


def write_table(rows: DataFrame, path: str) -> None:
    """Any result as a delimited file with header."""
    rows.write.mode("overwrite").options(**WRITE).csv(path)


def metrics_text(summary: DataFrame, title: str) -> str:
    """K6, K7: the metrics of a handful of models as fixed-layout text, best first."""
    from scriptoria.operators.metrics import METRICS

    lines = [title, "=" * len(title), f"{'modello':<24}" + "".join(f"{m:>18}" for m in METRICS)]
    for r in summary.orderBy(F.desc("f1_macro"), "modello").collect():
        lines.append(f"{r['modello']:<24}" + "".join(f"{100 * r[m]:>17.2f}%" for m in METRICS))
    return "\n".join(lines) + "\n"


def splice(text: str, start: str, end: str, section: str) -> str:
    """K8: ``section`` between its markers in place of what stood there, else appended."""
    block = f"{start}\n{section.rstrip()}\n{end}"
    pattern = re.compile(re.escape(start) + r".*?" + re.escape(end), re.S)
    if pattern.search(text):
        return pattern.sub(lambda _: block, text, count=1)
    return text.rstrip() + "\n\n" + block + "\n"


def manifest(path: str, **facts) -> None:
    """The run's facts as JSON."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(facts, f, ensure_ascii=False, indent=2, default=str)


def copy_selected(names: DataFrame, src: str, dst: str) -> list[str]:
    """Copy the named files of a folder; the names that are not there."""
    os.makedirs(dst, exist_ok=True)
    spark = names.sparkSession
    have = spark.createDataFrame([(f,) for f in os.listdir(src)], "file_name string")
    for r in names.select("file_name").distinct().join(have, "file_name", "left_semi").toLocalIterator():
        shutil.copy2(os.path.join(src, r[0]), os.path.join(dst, r[0]))
    return sorted(r[0] for r in names.select("file_name").distinct().join(have, "file_name", "left_anti").toLocalIterator())


def check_numbering(docs: DataFrame) -> None:
    """ValueError where act numbers repeat or lack between 1 and the greatest."""
    n = docs.select(C.act_number(F.col("file_name")).alias("n")).filter("n is not null").groupBy("n").count()
    twice = [r[0] for r in n.filter("count > 1").orderBy("n").limit(50).collect()]
    if twice:
        raise ValueError(f"numbers used twice: {twice}")
    top, many = n.agg(F.max("n"), F.count(F.lit(1))).first()
    if top is not None and top != many:
        raise ValueError(f"{top - many} numbers lack between 1 and {top}")


def check_contents(docs: DataFrame) -> None:
    """ValueError where two documents have the same bytes."""
    same = docs.groupBy(F.sha2("content", 256).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.min("file_name").alias("f")).filter("n > 1").limit(50).collect()
    if same:
        raise ValueError("equal documents: " + ", ".join(r["f"] for r in same))


