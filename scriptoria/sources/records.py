"""Delimited records: quote-aware assembly, strict parsing, typed fields, rejects."""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.functions.labels import BY_FOLDED

FIELDS = ("id_atto", "file_name", "ocr", "testo_completo_llm", "golden_label")
ID = re.compile(r"[0-9]{1,9}(?:_[0-9]{1,2})?")


def assemble(lines: Iterable[str]) -> Iterator[str]:
    """Physical lines (without their ends) to records: a line feed inside an open
    quoted field belongs to the record. A record left open at the end is given out
    as it stands, so that the parser can name its fault."""
    open_, quotes = [], 0
    for line in lines:
        open_.append(line)
        quotes += line.count('"')
        if quotes % 2 == 0:
            yield "\n".join(open_)
            open_, quotes = [], 0
    if open_:
        yield "\n".join(open_)


def bare_quotes(record: str, sep: str) -> bool:
    """True where a field that is not quoted holds a quote, which Python's strict
    reader lets pass. Call it for records the strict reader accepts."""
    if '"' not in record:
        return False
    inside, start, i, n = False, True, 0, len(record)
    while i < n:
        c = record[i]
        if inside:
            if c == '"':
                if record[i + 1 : i + 2] == '"':
                    i += 1
                else:
                    inside = False
        elif c == '"':
            if not start:
                return True
            inside = True
        start = not inside and c == sep
        i += 1
    return inside


def split_record(record: str, sep: str = ";") -> list[str]:
    """Fields of one record by Python's strict csv reader; csv.Error on broken quoting."""
    if bare_quotes(record, sep):
        raise csv.Error("quote in a field that is not quoted")
    rows = list(csv.reader([_guard(record)], delimiter=sep, quotechar='"', doublequote=True, strict=True))
    return [x.translate(UNGUARD) for x in rows[0]] if rows else [""]


# Line ends stand as private-use characters while the reader works: one row is one
# record here, and a line feed in it is data.
GUARD = {10: "\ue00a", 13: "\ue00d"}
UNGUARD = {0xE00A: "\n", 0xE00D: "\r"}


def _guard(record: str) -> str:
    return record.translate(GUARD)


class FieldError(ValueError):
    """A field that is structurally there but holds no valid value."""


def typed(fields: list[str]) -> tuple[str, str, str, str, str]:
    """The dataset's typed row; FieldError on an invalid value."""
    act, name, ocr, text, label = fields
    act, ocr = act.strip(), ocr.strip()
    if not ID.fullmatch(act):
        raise FieldError("id_atto")
    if ocr not in ("0", "1"):
        raise FieldError("ocr")
    if label.strip() and label.strip().lower() not in BY_FOLDED:
        raise FieldError("golden_label")
    if not text.strip() or "�" in text or "\0" in text:
        raise FieldError("testo_completo_llm")
    return act, name, ocr, text, label


def parse(record: str | None, sep: str = ";") -> tuple:
    """(five fields or Nones, motivo or None, detail or None) of one record."""
    none = (None,) * len(FIELDS)
    try:
        fields = split_record(record or "", sep)
    except csv.Error as e:
        return (*none, "virgolette", str(e))
    if len(fields) != len(FIELDS):
        return (*none, "colonne", f"{len(fields)} fields")
    try:
        return (*typed(fields), None, None)
    except FieldError as e:
        return (*none, "valore", str(e))


def parse_records(df: DataFrame, record: str, *keep: str | Column, sep: str = ";") -> DataFrame:
    """Every row of ``df`` parsed: the kept columns, the five fields, motivo, dettaglio.

    Rows that load have a null motivo. A null or empty record has one empty field and
    so counts as ``colonne``. Repeated rows are parsed one by one; other columns of
    ``df`` are ignored unless kept, whatever their names. An empty table gives none.
    One narrow stage: Arrow batches to Python and back, no shuffle.
    """
    src = df.select(*keep, F.col(record).alias("__record"))
    kept = src.columns[:-1]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]]
        + [f"__{x} string" for x in FIELDS]
        + ["motivo string", "dettaglio string"]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(sys.maxsize)
        for b in batches:
            out = pd.DataFrame(
                [parse(x, sep) for x in b["__record"]],
                columns=[*(f"__{x}" for x in FIELDS), "motivo", "dettaglio"],
                dtype=object,
            )
            yield pd.concat([b[kept].reset_index(drop=True), out], axis=1)

    return src.mapInPandas(run, schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file_csv, num_riga, riga): the records of delimited files before parsing, in the
    file's order. A file is read whole by one task, as only its quotes from the start
    on tell which line feeds end a record; many files are read side by side. A byte
    order mark at the start and empty lines at the end are no records."""
    src = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_csv"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, text in zip(b["file_csv"], b["value"]):
                body = text.removeprefix("\ufeff").replace("\r\n", "\n").rstrip("\n")
                rows = [(name, i, r) for i, r in enumerate(assemble(body.split("\n")), 1)] if body else []
                if rows:
                    yield pd.DataFrame(rows, columns=["file_csv", "num_riga", "riga"])

    return src.mapInPandas(run, "file_csv string, num_riga bigint, riga string")


def valid_rows(parsed: DataFrame, *keep: str) -> DataFrame:
    """The rows that loaded, with the dataset's own field names."""
    ok = parsed.filter(F.col("motivo").isNull())
    return ok.select(*keep, *[F.col(f"__{x}").alias(x) for x in FIELDS])


def rejected_rows(parsed: DataFrame, *keep: str) -> DataFrame:
    """The rows that did not load and why."""
    return parsed.filter(F.col("motivo").isNotNull()).select(*keep, "motivo", "dettaglio")
