"""The queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.functions.labels import canonical_label, not_blank
from scriptoria.llm import abuse, leaks, mixing, near, overlap, pairs, quotas, scans, truncation
from scriptoria.plans import sqlkit as Q
from scriptoria.session import cut, table

SIMILAR, SHINGLE = 0.6, 3  # "alike" in this project's data

# --- 1: noise from scanned pages


def _scans(spark: SparkSession, d: str) -> scans.Repaired:
    return scans.Repaired(table(spark, d, "txt_opendataloader"), table(spark, d, "dataset_atti"), "testo_completo_llm")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a defect and its kind."""
    return _scans(spark, d).found()


def p1_text(spark: SparkSession, d: str) -> DataFrame:
    """The repaired texts, a paragraph a line."""
    return _scans(spark, d).text()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Texts and lines with each kind of defect."""
    return _scans(spark, d).found().groupBy("difetto").agg(F.countDistinct("txt_id").alias("testi"), F.count(F.lit(1)).alias("linee"))


# --- 2: cut texts


def _cut_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "dataset_atti")
    tokens = truncation.last_tokens(rows, table(spark, d, "audit_log"))
    return truncation.truncated(rows, "riga_id", "testo_completo_llm", "esperimento", tokens)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose text was cut."""
    return _cut_rows(spark, d).filter("cut").select(F.col("id").alias("riga_id"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Per experiment the share of cut texts, the share that the fitted lengths alone call
    cut at a limit, and the verdicts that the lengths changed."""
    r = _cut_rows(spark, d).filter("form <> 'blank'")
    return r.groupBy(F.col("source").alias("esperimento")).agg(
        F.count(F.lit(1)).alias("testi"),
        F.sum(F.col("cut").cast("bigint")).alias("tagliati"),
        F.avg(F.col("cut").cast("double")).alias("tasso"),
        F.avg("posterior").alias("tasso_ai_limiti"),
        F.count_if(F.col("cut") != F.col("unaided")).alias("decisi_dai_limiti"),
    )


# --- 3: quota samples


def _usable(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "dataset_atti").filter(not_blank(F.col("testo_completo_llm")))
    return rows.select("riga_id", canonical_label(F.col("golden_label")).alias("label")).filter("label is not null")


def _quotas(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = cut(_usable(spark, d))  # id and label alone: sampling reads them several times
    return rows, quotas.quota_targets(rows, "label", table(spark, d, "quote_campione"))


def _quota_report(spark: SparkSession, d: str) -> DataFrame:
    rows, targets = _quotas(spark, d)
    return quotas.quota_report(rows, "riga_id", "label", targets)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Labels of which the sampler could not draw what was asked for."""
    return _quota_report(spark, d).filter("deficit > 0").select("campagna_id", "golden_label")


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sampled rows of each campaign."""
    rows, targets = _quotas(spark, d)
    return quotas.quota_sample(rows, "riga_id", "label", targets).withColumnRenamed("id", "riga_id")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """What each campaign asked for, drew and lacks, by label."""
    return _quota_report(spark, d).select("campagna_id", "golden_label", "usable", "size", "needed", "drawn", "deficit")


# --- 4: overlap of the splits


def _splits(spark: SparkSession, d: str) -> tuple:
    return table(spark, d, "training_set"), table(spark, d, "test_set"), "riga_id", "testo_completo_llm", "id_atto", SHINGLE, SIMILAR


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a training and a test row that are the same act or alike."""
    return overlap.split_overlaps(*_splits(spark, d)).select(F.least("id_a", "id_b").alias("riga_a"), F.greatest("id_a", "id_b").alias("riga_b")).distinct()


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """Every test row with the number of training rows it overlaps with, and the share of
    its text that stands in one of them."""
    return overlap.record_overlaps(*_splits(spark, d)).select(
        F.col("id").alias("riga_id"), F.col("pairs").alias("coppie"), F.col("same_act").alias("stesso_atto"), F.col("near").alias("testi_simili"), F.col("coverage").alias("copertura")
    )


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping test rows and pairs per split and experiment."""
    return _per_split(spark, d).select("split_nome", "esperimento", "coppie", "righe_test", "stesso_atto", "testi_simili")


def p4_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per split and experiment, the mean and the greatest share of a test row's text that
    stands in one training row, over the rows that overlap."""
    return _per_split(spark, d).select("split_nome", "esperimento", "righe_test", "copertura_media", "copertura_massima")


def _per_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "test_set").select("riga_id", "split_nome", "esperimento")
    return (
        p4_records(spark, d)
        .filter("coppie > 0")
        .join(rows, "riga_id")
        .groupBy("split_nome", "esperimento")
        .agg(
            F.sum("coppie").alias("coppie"),
            F.count(F.lit(1)).alias("righe_test"),
            F.sum("stesso_atto").alias("stesso_atto"),
            F.sum("testi_simili").alias("testi_simili"),
            F.avg("copertura").alias("copertura_media"),
            F.max("copertura").alias("copertura_massima"),
        )
    )


# --- 5: defective pairs


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective pairs and their type."""
    got = pairs.defective_pairs(table(spark, d, "coppie_llm"), "coppia_id", "richiesta", "testo_completo_llm")
    return got.withColumnRenamed("id", "coppia_id")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Defects per model, and in how many of the pairs the fallback flag or a technical
    error says that something went wrong."""
    error = F.coalesce(F.trim("errore_tecnico"), F.lit("")) != ""
    rows = table(spark, d, "coppie_llm").select("coppia_id", "modello", "fallback_locale", error.alias("errore"))
    return rows.join(p5_found(spark, d), "coppia_id").groupBy("modello", "difetto").agg(
        F.count(F.lit(1)).alias("coppie"), F.count_if(F.col("fallback_locale") == 1).alias("con_fallback"), F.count_if("errore").alias("con_errore")
    )


# --- 6: near copies


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of rows with alike texts."""
    return near.row_pairs(*near.near_duplicates(table(spark, d, "dataset_atti"), "riga_id", "testo_completo_llm", SHINGLE, SIMILAR))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row a text: its group, named by the least row in it, and the group's size."""
    named = cut(near.near_groups(table(spark, d, "dataset_atti"), "riga_id", "testo_completo_llm", SHINGLE, SIMILAR))
    sizes = named.groupBy("group").agg(F.min("id").alias("gruppo"), F.count(F.lit(1)).alias("righe"))
    return named.join(sizes, "group").select(F.col("id").alias("riga_id"), "gruppo", "righe")


# --- 8: leaked evaluation texts


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "brani_valutazione"), "item_id", "brano")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least 20 consecutive words of an item."""
    return _leaks(spark, d).select("doc_id", "item_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Every item with the documents it leaked into and the most of it in one."""
    got = _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documenti"), F.max("coverage").alias("copertura"))
    items = table(spark, d, "brani_valutazione").select("item_id", "insieme")
    return items.join(got, "item_id", "left").select("item_id", "insieme", F.coalesce("documenti", F.lit(0)).alias("documenti"), F.coalesce("copertura", F.lit(0.0)).alias("copertura"))


# --- 9: source mix


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    counted = mixing.counted_documents(table(spark, d, "documents"))
    return counted, mixing.mix_rates(counted, table(spark, d, "pesi_fonte"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose copies, as many as they may have, do not fill their share of a mix."""
    return mixing.mix_shares(*_mix(spark, d)).filter("short").select("miscela_id", "source")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The chosen copies of documents."""
    return mixing.mixed(*_mix(spark, d))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Actual shares of the mixes."""
    return mixing.mix_shares(*_mix(spark, d))


# --- 10: abusive content


def _abuse(spark: SparkSession, d: str) -> DataFrame:
    return abuse.abusive(table(spark, d, "documents"), table(spark, d, "etichette_doc"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with abusive, hateful or sexually explicit text."""
    return _abuse(spark, d).filter("tossico").select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """A score per document."""
    return _abuse(spark, d).select("doc_id", "score")


def p10_report(spark: SparkSession, d: str) -> DataFrame:
    """The rate per source."""
    return _abuse(spark, d).groupBy("source").agg(
        F.count(F.lit(1)).alias("documenti"), F.sum(F.col("tossico").cast("bigint")).alias("tossici"), F.avg(F.col("tossico").cast("double")).alias("tasso")
    )


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_text, p1_report, p2_found, p2_report, p3_found, p3_sample, p3_report, p4_found, p4_records, p4_report, p4_coverage, p5_found, p5_report, p6_found, p6_groups,
        p8_found, p8_report, p9_found, p9_mix, p9_shares, p10_found, p10_scores, p10_report,
    )
}

_QUOTAS = f"""
WITH u AS (SELECT riga_id, {Q.canonical('golden_label')} AS label FROM dataset_atti WHERE regexp_replace(testo_completo_llm, '[\\s\\p{{Z}}]+', '', 'g') <> ''),
c AS (SELECT label, count(*) AS usable FROM u WHERE label IS NOT NULL GROUP BY 1),
t AS (SELECT coalesce(sum(usable), 0) AS total FROM c),
z AS (SELECT q.campagna_id, q.golden_label, coalesce(c.usable, 0) AS usable, CAST(total * frazione_pct // 100 AS BIGINT) AS size, quota_pct, minimo
  FROM quote_campione q CROSS JOIN t LEFT JOIN c ON c.label = q.golden_label),
n AS (SELECT *, greatest(minimo, size * quota_pct // 100) AS needed FROM z)
"""


def _alike(rows: str, pair: str) -> str:
    """Brute-force Jaccard over distinct runs of three words of the rows (side, id, text)."""
    return f"""
WITH r AS ({rows}),
w AS (SELECT side, id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM r WHERE text IS NOT NULL),
s AS (SELECT DISTINCT side, id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
n AS (SELECT side, id, count(*) AS n FROM s GROUP BY ALL),
j AS (SELECT a.side AS sa, b.side AS sb, a.id AS x, b.id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND {pair} GROUP BY ALL),
k AS (SELECT x, y FROM j JOIN n na ON na.id = x AND na.side = sa JOIN n nb ON nb.id = y AND nb.side = sb WHERE c >= 0.6 * (na.n + nb.n - c))
"""


_SPLITS = "SELECT 'a' AS side, riga_id AS id, testo_completo_llm AS text FROM training_set UNION ALL SELECT 'b', riga_id, testo_completo_llm FROM test_set"
_ACTS = """, ids AS (SELECT 'a' AS side, riga_id, regexp_extract(regexp_replace(id_atto, '[\\s\\p{Z}]+', '', 'g'), '^0*([0-9]+)(?:_0*([0-9]+))?$', ['n', 's']) AS p FROM training_set
 UNION ALL SELECT 'b', riga_id, regexp_extract(regexp_replace(id_atto, '[\\s\\p{Z}]+', '', 'g'), '^0*([0-9]+)(?:_0*([0-9]+))?$', ['n', 's']) FROM test_set)
"""

ORACLES = {
    "p3_found": _QUOTAS + "SELECT campagna_id, golden_label FROM n WHERE usable < needed",
    "p3_sample": _QUOTAS
    + """, r AS (SELECT n.campagna_id, n.golden_label, u.riga_id, least(needed, usable) AS target,
  row_number() OVER (PARTITION BY n.campagna_id, n.golden_label ORDER BY left(md5('quote:' || n.campagna_id || ':' || u.riga_id), 13), u.riga_id) AS r FROM n JOIN u ON u.label = n.golden_label)
SELECT campagna_id, golden_label, riga_id FROM r WHERE r <= target""",
    "p3_report": _QUOTAS
    + "SELECT campagna_id, golden_label, usable, size, CAST(needed AS BIGINT) AS needed, CAST(least(needed, usable) AS BIGINT) AS drawn, CAST(needed - least(needed, usable) AS BIGINT) AS deficit FROM n",
    "p4_report": _alike(_SPLITS, "a.side = 'a' AND b.side = 'b'")
    + _ACTS
    + """, same AS (SELECT a.riga_id AS x, b.riga_id AS y FROM ids a JOIN ids b ON a.side = 'a' AND b.side = 'b' AND a.p.n <> '' AND a.p.n = b.p.n AND a.p.s = b.p.s),
u AS (SELECT x, y FROM k UNION SELECT x, y FROM same)
SELECT split_nome, esperimento, count(*) AS coppie, count(DISTINCT y) AS righe_test, count(*) FILTER ((x, y) IN (SELECT (x, y) FROM same)) AS stesso_atto, count(*) FILTER ((x, y) IN (SELECT (x, y) FROM k)) AS testi_simili
FROM u JOIN test_set t ON t.riga_id = u.y GROUP BY ALL""",
    "p4_found": _alike(_SPLITS, "a.side = 'a' AND b.side = 'b'")
    + _ACTS
    + """SELECT least(x, y) AS riga_a, greatest(x, y) AS riga_b FROM k
UNION SELECT least(a.riga_id, b.riga_id), greatest(a.riga_id, b.riga_id) FROM ids a JOIN ids b ON a.side = 'a' AND b.side = 'b' AND a.p.n <> '' AND a.p.n = b.p.n AND a.p.s = b.p.s""",
    "p6_found": _alike("SELECT 'a' AS side, riga_id AS id, testo_completo_llm AS text FROM dataset_atti", "a.id < b.id") + "SELECT x AS riga_a, y AS riga_b FROM k",
    "p6_groups": _alike("SELECT 'a' AS side, riga_id AS id, testo_completo_llm AS text FROM dataset_atti", "a.id < b.id").replace("WITH r AS", "WITH RECURSIVE r AS", 1)
    + """, l AS (SELECT x, y FROM k UNION ALL SELECT y, x FROM k),
reach(x, m) AS (SELECT id, id FROM n UNION SELECT reach.x, l.y FROM reach JOIN l ON l.x = reach.m),
g AS (SELECT x AS riga_id, min(m) AS gruppo FROM reach GROUP BY 1)
SELECT riga_id, gruppo, count(*) OVER (PARTITION BY gruppo) AS righe FROM g""",
    "p8_found": """
WITH x AS (SELECT doc_id, regexp_replace(lower(strip_accents(text)), '([\\p{L}\\p{N}])[-‐‑­]\\s*\\n\\s*([\\p{L}\\p{N}])', '\\1\\2', 'g') AS t FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, w, array_to_string(w, '') AS t FROM (SELECT doc_id, regexp_extract_all(t, '[\\p{L}\\p{N}]+') AS w FROM x)),
w AS (SELECT item_id, regexp_extract_all(lower(strip_accents(brano)), '[\\p{L}\\p{N}]+') AS w FROM brani_valutazione WHERE brano IS NOT NULL),
p AS (SELECT item_id, array_to_string(w[i:i + 19], '') AS p FROM (SELECT *, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
c AS (SELECT doc_id, item_id, p, strpos(t, p) - 1 AS beg FROM d JOIN p ON contains(t, p)),
e AS (SELECT doc_id, list_transform(range(0, len(w) + 1), lambda i: coalesce(length(array_to_string(w[1:i], '')), 0)) AS ends FROM d WHERE doc_id IN (SELECT doc_id FROM c))
SELECT DISTINCT doc_id, item_id FROM c JOIN e USING (doc_id) WHERE list_contains(ends, beg) AND list_contains(ends, beg + length(p))""",
}
