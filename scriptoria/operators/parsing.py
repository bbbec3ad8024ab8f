"""Queries over raw records: rows that load and rows that do not, with the reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.session import spread, table
from scriptoria.sources.records import parse_records, rejected_rows, valid_rows


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_records(spread(table(spark, sf_dir, "righe_grezze")), "riga", "grezzo_id", "file_csv", "num_riga")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that do not load, with the reason."""
    return rejected_rows(parsed(spark, sf_dir), "grezzo_id").select("grezzo_id", "motivo")


def p7_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that load, as typed rows."""
    return valid_rows(parsed(spark, sf_dir), "grezzo_id")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each file by outcome."""
    p = parsed(spark, sf_dir).select("file_csv", F.coalesce("motivo", F.lit("caricata")).alias("esito"))
    return p.groupBy("file_csv", "esito").agg(F.count(F.lit(1)).alias("righe"))


QUERIES = {"p7_found": p7_found, "p7_loaded": p7_loaded, "p7_report": p7_report}

_FIELDS = r"""
WITH r AS (SELECT grezzo_id, file_csv, coalesce(riga, '') AS riga FROM righe_grezze),
q AS (SELECT *, regexp_full_match(riga, '(?s)("([^"]|"")*"|[^";]*)(;("([^"]|"")*"|[^";]*))*') AS quoting FROM r),
f AS (SELECT *, CASE WHEN quoting THEN regexp_extract_all(riga || ';', '(?s)("(?:[^"]|"")*"|[^";]*);', 1) END AS raw FROM q),
u AS (SELECT *, list_transform(raw, lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END) AS c FROM f),
t AS (SELECT *, regexp_replace(c[1], '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS id, regexp_replace(c[3], '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS o,
  lower(regexp_replace(c[5], '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS l, regexp_replace(c[4], '[\s\p{Z}]+', '', 'g') AS bare FROM u),
m AS (SELECT *, CASE WHEN NOT quoting THEN 'virgolette' WHEN len(raw) <> 5 THEN 'colonne'
  WHEN NOT regexp_full_match(id, '[0-9]{1,9}(_[0-9]{1,2})?') OR o NOT IN ('0', '1')
    OR (l <> '' AND l NOT IN ('accordo sindacale', 'accordosindacale', 'decreto', 'decreto sindacale', 'delibera consiglio', 'delibera di consiglio',
      'deliberazione consiglio', 'deliberazione di consiglio', 'deliberazione del consiglio', 'deliberaconsiglio', 'delibera giunta', 'delibera di giunta',
      'deliberazione giunta', 'deliberazione di giunta', 'deliberazione della giunta', 'deliberagiunta', 'determina', 'determina dirigenziale',
      'determinazione', 'determinazione dirigenziale', 'ordinanza', 'ordinanza sindacale', 'regolamento', 'regolamento comunale', 'statuto'))
    OR bare = '' OR contains(c[4], chr(65533)) OR contains(c[4], chr(0)) THEN 'valore' END AS motivo FROM t)
"""
ORACLES = {
    "p7_found": _FIELDS + "SELECT grezzo_id, motivo FROM m WHERE motivo IS NOT NULL",
    "p7_loaded": _FIELDS
    + "SELECT grezzo_id, id AS id_atto, c[2] AS file_name, o AS ocr, c[4] AS testo_completo_llm, c[5] AS golden_label FROM m WHERE motivo IS NULL",
    "p7_report": _FIELDS + "SELECT file_csv, coalesce(motivo, 'caricata') AS esito, count(*) AS righe FROM m GROUP BY ALL",
}
