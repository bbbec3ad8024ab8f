"""Ids and gaps, joins and upserts, aggregations, samples and splits, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions import convert as C
from scriptoria.functions import text as T
from scriptoria.functions.labels import canonical_label, not_blank
from scriptoria.operators.ranking import group_rank, total_rank
from scriptoria.plans import sqlkit as Q
from scriptoria.session import table

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


def act_id(c: str | Column) -> Column:
    """An act id as 'number' or 'number_suffix', whatever its padding or blanks; suffixed
    ids stay distinct. Null where the id has another form."""
    c = F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"(?U)\s+", "")
    pat = r"^0*([0-9]+)(?:_0*([0-9]+))?$"
    return F.when(c.rlike(pat), F.concat_ws("_", F.regexp_extract(c, pat, 1), F.nullif(F.regexp_extract(c, pat, 2), F.lit(""))))


ACT = rf"(CASE WHEN regexp_full_match(regexp_replace(id_atto, '{Q.S}+', '', 'g'), '[0-9]+(_[0-9]+)?') THEN regexp_replace(regexp_replace(regexp_replace(id_atto, '{Q.S}+', '', 'g'), '^0*([0-9])', '\1'), '_0*([0-9])', '_\1') END)"
RANK = "md5(CAST({id} AS VARCHAR) || ':{seed}')"

# --- ids


@query(
    f"""WITH f AS (SELECT DISTINCT file_name FROM audit_log WHERE file_name IS NOT NULL),
p AS (SELECT file_name, nullif({Q.name_number('file_name')}, 0) AS num, row_number() OVER (ORDER BY {Q.name_number('file_name')} IS NULL, {Q.name_number('file_name')}, replace(lower({Q.stem('file_name')}), ' ', ''), file_name) AS pos FROM f),
b AS (SELECT *, coalesce(num, pos) AS base FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY pos) AS k FROM b)
SELECT file_name, (CASE WHEN base < 10000 THEN lpad(CAST(base AS VARCHAR), 4, '0') ELSE CAST(base AS VARCHAR) END) || CASE WHEN k > 1 THEN '_' || CAST(k AS VARCHAR) ELSE '' END AS id FROM r"""
)
def disambiguated_ids(s, d):
    """An id for each file in natural order; a file without number, or
    with number 0, takes its position; later files of one number get suffixes."""
    files = table(s, d, "audit_log").filter("file_name is not null").select("file_name").distinct()
    x = total_rank(files, *C.natural_key(F.col("file_name")), F.col("file_name"))
    x = x.withColumn("base", F.coalesce(F.nullif(C.name_number(F.col("file_name")), F.lit(0)), F.col("pos")))
    k = F.row_number().over(Window.partitionBy("base").orderBy("pos"))
    x = x.withColumn("k", k)
    return x.select("file_name", F.concat(F.format_string("%04d", "base"), F.when(F.col("k") > 1, F.concat(F.lit("_"), F.col("k"))).otherwise("")).alias("id"))


@query(
    f"""WITH o AS (SELECT a, min(riga_id) AS pos FROM (SELECT {ACT} AS a, riga_id FROM dataset_atti) WHERE a IS NOT NULL GROUP BY 1),
u AS (SELECT DISTINCT {ACT} AS a FROM audit_log WHERE {ACT} IS NOT NULL)
SELECT u.a AS id, row_number() OVER (ORDER BY o.pos NULLS LAST, CAST(regexp_extract(u.a, '([0-9]+)', 1) AS BIGINT), u.a) AS posto FROM u LEFT JOIN o USING (a)"""
)
def stable_order(s, d):
    """Known ids in their file's order, the rest by number."""
    known = table(s, d, "dataset_atti").select(act_id("id_atto").alias("id"), "riga_id").filter("id is not null").groupBy("id").agg(F.min("riga_id").alias("pos0"))
    ids = table(s, d, "audit_log").select(act_id("id_atto").alias("id")).filter("id is not null").distinct()
    x = total_rank(ids.join(known, "id", "left"), F.col("pos0").asc_nulls_last(), C.id_digits(F.col("id")).cast("bigint"), F.col("id"))
    return x.select("id", F.col("pos").alias("posto"))


@query(
    f"""WITH f AS (SELECT DISTINCT file_name, {Q.name_number('file_name')} AS numero FROM dataset_atti WHERE file_name IS NOT NULL)
SELECT numero, count(*) AS files, string_agg(file_name, ', ' ORDER BY file_name) AS nomi FROM f WHERE numero IS NOT NULL GROUP BY 1 HAVING count(*) > 1"""
)
def duplicate_numbers(s, d):
    """Numbers that several file names share."""
    f = table(s, d, "dataset_atti").filter("file_name is not null").select("file_name").distinct().withColumn("numero", C.name_number(F.col("file_name")))
    return f.filter("numero is not null").groupBy("numero").agg(F.count(F.lit(1)).alias("files"), F.array_join(F.array_sort(F.collect_list("file_name")), ", ").alias("nomi")).filter("files > 1")


@query(
    f"""WITH n AS (SELECT DISTINCT {Q.name_number('file_name')} AS n FROM dataset_atti WHERE {Q.name_number('file_name')} IS NOT NULL)
SELECT CAST(i AS BIGINT) AS mancante FROM (SELECT unnest(range(1, (SELECT coalesce(max(n), 0) FROM n) + 1)) AS i) WHERE i NOT IN (SELECT n FROM n)"""
)
def numbering_gaps(s, d):
    """Numbers missing between 1 and the greatest. The gap before each number comes
    from the one before it, so that only what is missing is ever listed."""
    n = table(s, d, "dataset_atti").select(C.name_number(F.col("file_name")).alias("n")).filter("n is not null").distinct()
    x = total_rank(n.filter("n > 0"), F.col("n"))
    nxt = x.select((F.col("pos") + 1).alias("pos"), F.col("n").alias("prev"))
    gaps = x.join(nxt, "pos", "left").select(F.coalesce("prev", F.lit(0)).alias("prev"), "n").filter("n > prev + 1")
    return gaps.select(F.explode(F.sequence(F.col("prev") + 1, F.col("n") - 1)).alias("mancante"))


@query("SELECT sha256(text) AS sha, count(*) AS copie, min(doc_id) AS primo FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def content_duplicates(s, d):
    """Documents of equal content."""
    x = table(s, d, "documents").filter("text is not null").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"))
    return x.groupBy("sha").agg(F.count(F.lit(1)).alias("copie"), F.min("doc_id").alias("primo")).filter("copie > 1")


# --- records: load, upsert, skip


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the given order: an aggregation that combines map-side,
    where a window would gather a hot key's rows in one task."""
    rest = [c for c in rows.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return rows.groupBy(*key).agg(best).select(*key, "r.*")


_LAST_D = f"(SELECT * FROM (SELECT *, {ACT} AS a, row_number() OVER (PARTITION BY {ACT}, esperimento ORDER BY caricato_il DESC, riga_id DESC) AS rn FROM dataset_atti) WHERE rn = 1 AND a IS NOT NULL)"
_LAST_A = f"(SELECT * FROM (SELECT *, {ACT} AS a, row_number() OVER (PARTITION BY {ACT}, esperimento ORDER BY registrato_il DESC, audit_id DESC) AS rn FROM audit_log) WHERE rn = 1 AND a IS NOT NULL)"


def _existing(s, d, *cols: str) -> DataFrame:
    """Last dataset row of each act and experiment; the columns are picked before the
    aggregation packs them, so that the scan reads no others."""
    x = table(s, d, "dataset_atti").select(act_id("id_atto").alias("a"), "esperimento", "caricato_il", "riga_id", *cols).filter("a is not null")
    return latest(x, ["a", "esperimento"], ["caricato_il", "riga_id"])


def _runs(s, d, *cols: str) -> DataFrame:
    """Last audited run of each act and experiment."""
    x = table(s, d, "audit_log").select(act_id("id_atto").alias("a"), "esperimento", "registrato_il", "audit_id", *cols).filter("a is not null")
    return latest(x, ["a", "esperimento"], ["registrato_il", "audit_id"])


@query(f"SELECT a AS id, esperimento, riga_id, file_name, golden_label FROM {_LAST_D}")
def dataset_load(s, d):
    """The last row of each act and experiment."""
    return _existing(s, d, "file_name", "golden_label").select(F.col("a").alias("id"), "esperimento", "riga_id", "file_name", "golden_label")


@query(f"SELECT n.a AS id, n.esperimento, n.audit_id, e.riga_id FROM {_LAST_A} n LEFT JOIN {_LAST_D} e ON e.a = n.a AND e.esperimento = n.esperimento")
def existing_lookup(s, d):
    """Runs with the existing record of their act, if any."""
    n, e = _runs(s, d).select("a", "esperimento", "audit_id"), _existing(s, d).select("a", "esperimento", "riga_id")
    return n.join(e, ["a", "esperimento"], "left").select(F.col("a").alias("id"), "esperimento", "audit_id", "riga_id")


@query(
    f"""SELECT coalesce(n.a, e.a) AS id, coalesce(n.esperimento, e.esperimento) AS esperimento, coalesce(n.file_name, e.file_name) AS file_name, coalesce(n.ocr, e.ocr) AS ocr,
CASE WHEN {Q.strip("coalesce(n.errore_tecnico, '')")} <> '' THEN '' ELSE coalesce(e.testo_completo_llm, '') END AS testo, coalesce(e.golden_label, '') AS golden_label
FROM {_LAST_A} n FULL JOIN {_LAST_D} e ON e.a = n.a AND e.esperimento = n.esperimento"""
)
def upsert_merge(s, d):
    """New runs over existing records; the new side wins, the label is carried over,
    and a failed run blanks the text."""
    n = _runs(s, d, "file_name", "ocr", "errore_tecnico").select("a", "esperimento", F.col("file_name").alias("nf"), F.col("ocr").alias("no"), not_blank(F.col("errore_tecnico")).alias("failed"))
    e = _existing(s, d, "file_name", "ocr", "testo_completo_llm", "golden_label").select("a", "esperimento", "file_name", "ocr", "testo_completo_llm", "golden_label")
    return n.join(e, ["a", "esperimento"], "full").select(
        F.col("a").alias("id"),
        "esperimento",
        F.coalesce("nf", "file_name").alias("file_name"),
        F.coalesce("no", "ocr").alias("ocr"),
        F.when(F.coalesce("failed", F.lit(False)), "").otherwise(F.coalesce("testo_completo_llm", F.lit(""))).alias("testo"),
        F.coalesce("golden_label", F.lit("")).alias("golden_label"),
    )


_VALID = f"(SELECT DISTINCT {ACT} AS a, esperimento FROM dataset_atti WHERE {Q.strip('testo_completo_llm')} <> '' AND {ACT} IS NOT NULL)"
_FORCED = "(n.a IN ('7', '22') OR n.file_name IN ('atto_711.pdf'))"


@query(
    f"SELECT n.a AS id, n.esperimento, {_FORCED} AS forzato FROM {_LAST_A} n WHERE coalesce({_FORCED}, false) OR NOT EXISTS (SELECT 1 FROM {_VALID} v WHERE v.a = n.a AND v.esperimento = n.esperimento)"
)
def incremental_work(s, d):
    """What is left to do: acts without a valid record, and forced ones."""
    valid = table(s, d, "dataset_atti").filter(not_blank(F.col("testo_completo_llm"))).select(act_id("id_atto").alias("a"), "esperimento").filter("a is not null").distinct()
    forced = F.col("a").isin("7", "22") | F.col("file_name").isin("atto_711.pdf")
    n = _runs(s, d, "file_name").select("a", "esperimento", forced.alias("forzato"))
    must = n.filter(F.coalesce("forzato", F.lit(False)))
    todo = n.filter(~F.coalesce("forzato", F.lit(False))).join(valid, ["a", "esperimento"], "left_anti")
    return must.unionByName(todo).select(F.col("a").alias("id"), "esperimento", "forzato")


# --- membership


def _split_ids(s, d, name: str, where: str = "true") -> DataFrame:
    return table(s, d, name).filter(where).select(act_id("id_atto").alias("id")).filter("id is not null").distinct()


_TR = f"(SELECT DISTINCT {ACT} AS id FROM training_set WHERE {ACT} IS NOT NULL)"
_TE = f"(SELECT DISTINCT {ACT} AS id FROM test_set WHERE split_nome = 'test' AND {ACT} IS NOT NULL)"
_CO = f"(SELECT DISTINCT {ACT} AS id FROM test_set WHERE split_nome = 'convalida' AND {ACT} IS NOT NULL)"


@query(
    f"""WITH u AS (SELECT 'training' AS split, riga_id, {ACT} AS id FROM training_set UNION ALL SELECT split_nome, riga_id, {ACT} FROM test_set)
SELECT split, riga_id, id, id IS NOT NULL AND id IN (SELECT id FROM {_TR}) AS in_training, id IS NOT NULL AND id IN (SELECT id FROM {_TE}) AS in_test, id IS NOT NULL AND id IN (SELECT id FROM {_CO}) AS in_convalida FROM u"""
)
def split_membership(s, d):
    """The splits' union, each row flagged with the splits its act is in."""
    cols = ["split", "riga_id", "id"]
    tr = table(s, d, "training_set").select(F.lit("training").alias("split"), "riga_id", act_id("id_atto").alias("id"))
    te = table(s, d, "test_set").select(F.col("split_nome").alias("split"), "riga_id", act_id("id_atto").alias("id"))
    u = tr.unionByName(te, allowMissingColumns=True).select(*cols)
    for flag, ids in (("in_training", _split_ids(s, d, "training_set")), ("in_test", _split_ids(s, d, "test_set", "split_nome = 'test'")), ("in_convalida", _split_ids(s, d, "test_set", "split_nome = 'convalida'"))):
        u = u.join(ids.withColumn(flag, F.lit(True)), "id", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return u.select(*cols, "in_training", "in_test", "in_convalida")


@query(f"SELECT id FROM {_TR} INTERSECT SELECT id FROM (SELECT * FROM {_TE} UNION SELECT * FROM {_CO})")
def overlap_audit(s, d):
    """Acts on either side of the split."""
    return _split_ids(s, d, "training_set").intersect(_split_ids(s, d, "test_set"))


@query(
    f"""SELECT (SELECT count(*) FROM {_TR}) AS training, (SELECT count(*) FROM {_TE}) AS test, (SELECT count(*) FROM {_CO}) AS convalida,
NOT EXISTS (SELECT id FROM {_TE} EXCEPT SELECT id FROM {_TR}) AS test_subset,
NOT EXISTS (SELECT id FROM {_TE} EXCEPT SELECT id FROM {_CO}) AND NOT EXISTS (SELECT id FROM {_CO} EXCEPT SELECT id FROM {_TE}) AS uguali,
(SELECT count(*) FROM (SELECT id FROM {_TR} INTERSECT SELECT id FROM {_TE})) AS sovrapposti"""
)
def split_audit(s, d):
    """Sizes, subset and equality of the splits' acts. One aggregation over
    the acts with their memberships; no comparison of sets on the driver."""
    flag = lambda n, ids: ids.withColumn(n, F.lit(True))
    x = flag("tr", _split_ids(s, d, "training_set"))
    x = x.join(flag("te", _split_ids(s, d, "test_set", "split_nome = 'test'")), "id", "full")
    x = x.join(flag("co", _split_ids(s, d, "test_set", "split_nome = 'convalida'")), "id", "full").fillna(False)
    z = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    tr, te, co = F.col("tr"), F.col("te"), F.col("co")
    return x.agg(
        z(tr).alias("training"),
        z(te).alias("test"),
        z(co).alias("convalida"),
        (z(te & ~tr) == 0).alias("test_subset"),
        (z(te != co) == 0).alias("uguali"),
        z(tr & te).alias("sovrapposti"),
    )


# --- aggregations


@query(f"SELECT label, count(*) AS n FROM (SELECT {Q.canonical('golden_label')} AS label FROM dataset_atti) WHERE label IS NOT NULL GROUP BY 1")
def class_counts(s, d):
    """G1."""
    x = table(s, d, "dataset_atti").select(canonical_label(F.col("golden_label")).alias("label")).filter("label is not null")
    return x.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


@query(f"SELECT count(DISTINCT label) AS classi, list_sort(list(DISTINCT label)) AS labels, CAST(least(5, min(n)) AS BIGINT) AS n_splits FROM (SELECT {Q.canonical('golden_label')} AS label, count(*) AS n FROM dataset_atti GROUP BY 1) WHERE label IS NOT NULL")
def label_set(s, d):
    """The sorted labels, and the folds that the smallest class allows."""
    x = table(s, d, "dataset_atti").groupBy(canonical_label(F.col("golden_label")).alias("label")).agg(F.count(F.lit(1)).alias("n")).filter("label is not null")
    return x.agg(F.count_distinct("label").alias("classi"), F.sort_array(F.collect_set("label")).alias("labels"), F.least(F.lit(5), F.min("n")).cast("bigint").alias("n_splits"))


_Z = lambda c: f"coalesce(sum({c}), 0)"


@query(
    f"""SELECT coalesce(esperimento, 'n/d') AS esperimento, count(*) AS record_audit, CAST({_Z(f"trunc({Q.number('ocr')})")} AS BIGINT) AS ocr_usati, CAST({_Z('fallback_locale')} AS BIGINT) AS fallback_locale,
count(*) FILTER ({Q.strip('errore_tecnico')} <> '') AS errori_tecnici, CAST({_Z('input_tokens')} AS BIGINT) AS input_tokens_totali, CAST({_Z('output_tokens')} AS BIGINT) AS output_tokens_totali, CAST({_Z('total_tokens')} AS BIGINT) AS total_tokens_totali,
{_Z('input_tokens')} / greatest(count(*), 1) AS input_tokens_medi, {_Z('output_tokens')} / greatest(count(*), 1) AS output_tokens_medi, {_Z('total_tokens')} / greatest(count(*), 1) AS total_tokens_medi,
CAST({_Z('num_chunk_llm')} AS BIGINT) AS chunk_llm_totali, {_Z('costo_totale')} AS costo_totale, CAST({_Z(f"trunc({Q.number('ocr')})")} AS DOUBLE) / greatest(count(*), 1) * 100 AS ocr_percento,
min(registrato_il) AS inizio, max(registrato_il) AS fine, CAST(epoch(date_trunc('second', max(registrato_il))) - epoch(date_trunc('second', min(registrato_il))) AS BIGINT) AS secondi
FROM audit_log GROUP BY 1"""
)
def audit_summary(s, d):
    """The audit log of each experiment in one row, unrounded."""
    n = F.count(F.lit(1))
    z = lambda c: F.coalesce(F.sum(c), F.lit(0))
    ocr = z(C.whole(F.col("ocr")))
    return (
        table(s, d, "audit_log")
        .groupBy(F.coalesce("esperimento", F.lit("n/d")).alias("esperimento"))
        .agg(
            n.alias("record_audit"),
            ocr.alias("ocr_usati"),
            z("fallback_locale").alias("fallback_locale"),
            F.count_if(not_blank(F.col("errore_tecnico"))).alias("errori_tecnici"),
            *[z(f"{k}_tokens").alias(f"{k}_tokens_totali") for k in ("input", "output", "total")],
            *[C.average(z(f"{k}_tokens"), n).alias(f"{k}_tokens_medi") for k in ("input", "output", "total")],
            z("num_chunk_llm").alias("chunk_llm_totali"),
            z("costo_totale").cast("double").alias("costo_totale"),
            (C.average(ocr, n) * 100).alias("ocr_percento"),
            F.min("registrato_il").alias("inizio"),
            F.max("registrato_il").alias("fine"),
        )
        .withColumn("secondi", F.unix_timestamp("fine") - F.unix_timestamp("inizio"))
    )


@query("SELECT esperimento, string_agg(modello, ', ' ORDER BY primo) AS modelli FROM (SELECT esperimento, modello, min(audit_id) AS primo FROM audit_log WHERE trim(modello) <> '' GROUP BY 1, 2) GROUP BY 1")
def models_seen(s, d):
    """The models of each experiment in the order they were first seen."""
    x = table(s, d, "audit_log").filter(not_blank(F.col("modello"))).groupBy("esperimento", "modello").agg(F.min("audit_id").alias("primo"))
    seen = F.array_sort(F.collect_list(F.struct("primo", "modello")))
    return x.groupBy("esperimento").agg(F.array_join(F.transform(seen, lambda r: r["modello"]), ", ").alias("modelli"))


@query(
    f"""SELECT label AS golden_label, count(*) AS numero_atti, string_agg(id, ', ' ORDER BY CAST(regexp_extract(id, '([0-9]+)', 1) AS BIGINT), id) AS id_atti FROM
(SELECT DISTINCT {Q.canonical('golden_label')} AS label, {ACT} AS id FROM test_set) WHERE label IS NOT NULL AND id IS NOT NULL GROUP BY 1"""
)
def class_summary(s, d):
    """Acts of each class, joined in the order of their numbers."""
    x = table(s, d, "test_set").select(canonical_label(F.col("golden_label")).alias("golden_label"), act_id("id_atto").alias("id")).filter("golden_label is not null and id is not null").distinct()
    ids = F.array_sort(F.collect_list(F.struct(C.id_digits(F.col("id")).cast("bigint").alias("n"), F.col("id"))))
    return x.groupBy("golden_label").agg(F.count(F.lit(1)).alias("numero_atti"), F.array_join(F.transform(ids, lambda r: r["id"]), ", ").alias("id_atti"))


# --- samples and splits

SEED = 1234
_LAB = f"(SELECT riga_id, {Q.canonical('golden_label')} AS label FROM dataset_atti WHERE {Q.canonical('golden_label')} IS NOT NULL)"
_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY label ORDER BY {RANK.format(id='riga_id', seed=SEED)}, riga_id) AS rank, count(*) OVER (PARTITION BY label) AS n FROM {_LAB})"


def labelled(s, d) -> DataFrame:
    return table(s, d, "dataset_atti").select("riga_id", canonical_label(F.col("golden_label")).alias("label")).filter("label is not null")


def balanced_sample(rows: DataFrame, label: str, id_: str, per_class: int, seed: int = SEED) -> DataFrame:
    """``per_class`` rows of each class; ValueError where a class has fewer."""
    small = rows.groupBy(label).count().filter(F.col("count") < per_class).limit(20).collect()
    if small:
        raise ValueError("classes too small: " + ", ".join(f"{r[0]}: {r[1]}" for r in small))
    return group_rank(rows, label, id_, seed).filter(F.col("__rank") <= per_class).drop("__rank")


@query(f"SELECT riga_id, label FROM {_RANKED} WHERE rank <= (SELECT least(5, min(n)) FROM {_RANKED})")
def balanced_rows(s, d):
    """Five rows of each class, or as many as the smallest class has."""
    rows = labelled(s, d)
    n = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.least(F.lit(5), F.min("n"))).first()[0] or 0
    return balanced_sample(rows, "label", "riga_id", n)


def stratified_split(rows: DataFrame, label: str, id_: str, share: float = 0.25, seed: int = SEED) -> DataFrame:
    """W5: 'test' for the first rows of each class in seeded order, as many as the
    class's share of the test size by largest remainder, 'train' for the rest. The test
    size holds a row of each class at least (M10)."""
    ranked = group_rank(rows, label, id_, seed)
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total, classes = n.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    size = round(total * C.effective_test_share(total, classes, share)) if total else 0
    exact = F.lit(size) * F.col("n") / F.lit(max(total, 1))
    q = n.withColumn("base", F.floor(exact)).withColumn("part", exact - F.floor(exact))
    left = Window.orderBy(F.desc("part"), F.desc("n"), label)
    spare = F.lit(size) - F.sum("base").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    q = q.withColumn("quota", F.col("base") + (F.row_number().over(left) <= spare).cast("int")).select(F.col(label).alias("__l"), F.col("quota").alias("__quota"))
    return ranked.join(F.broadcast(q), F.col(label) == F.col("__l")).withColumn("split", F.when(F.col("__rank") <= F.col("__quota"), "test").otherwise("train")).drop("__rank", "__l", "__quota")


@query(
    f"""WITH c AS (SELECT label, count(*) AS n FROM {_LAB} GROUP BY 1), t AS (SELECT sum(n) AS total, count(*) AS k FROM c),
z AS (SELECT CAST(round_even(CASE WHEN round_even(total * 0.25, 0) < k THEN total * (k / total) ELSE total * 0.25 END, 0) AS BIGINT) AS size, total FROM t),
e AS (SELECT label, n, floor(CAST(size * n AS DOUBLE) / total) AS base, CAST(size * n AS DOUBLE) / total - floor(CAST(size * n AS DOUBLE) / total) AS part, size FROM c, z),
q AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY part DESC, n DESC, label) <= size - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM e)
SELECT r.riga_id, r.label, CASE WHEN r.rank <= q.quota THEN 'test' ELSE 'train' END AS split FROM {_RANKED} r JOIN q USING (label)"""
)
def stratified_rows(s, d):
    """W5, M10, J7."""
    return stratified_split(labelled(s, d), "label", "riga_id")


@query(f"SELECT riga_id, label, CAST((rank - 1) % (SELECT least(5, min(n)) FROM {_RANKED}) AS INT) AS fold FROM {_RANKED}")
def stratified_folds(s, d):
    """Folds that deal every class out in seeded order."""
    return folds(labelled(s, d), "label", "riga_id")


def folds(rows: DataFrame, label: str, id_: str, most: int = 5, seed: int = SEED) -> DataFrame:
    """``rows`` with fold: as many folds as the smallest class allows, ``most`` at most."""
    k = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.least(F.lit(most), F.min("n"))).first()[0] or 1
    return group_rank(rows, label, id_, seed).withColumn("fold", ((F.col("__rank") - 1) % F.lit(k)).cast("int")).drop("__rank")


# --- routing


def route(native: Column, ocr: Column, least: int = 75, gain: int = 5, forced: Column | None = None) -> Column:
    """Native or OCR text, from their scores (null where there is no text): forced OCR or
    nothing; native if good enough; OCR if native lacks or OCR is better by ``gain``;
    else native; else an error."""
    forced = F.lit(False) if forced is None else forced
    better = ocr.isNotNull() & (native.isNull() | (ocr >= native + gain))
    free = F.when(F.coalesce(native >= least, F.lit(False)), "nativo").when(better, "ocr").when(native.isNotNull(), "nativo").otherwise("errore")
    return F.when(forced, F.when(ocr.isNotNull(), "ocr").otherwise("errore")).otherwise(free)


def engine(rapid: Column, paddle: Column, least: int = 75, gain: int = 5) -> Column:
    """The OCR engine of the cascade: the first if good enough; the second if better by
    ``gain``; else the first, else the second, else none."""
    return (
        F.when(F.coalesce(rapid >= least, F.lit(False)), "rapidocr")
        .when(paddle.isNotNull() & (rapid.isNull() | (paddle >= rapid + gain)), "paddleocr")
        .when(rapid.isNotNull(), "rapidocr")
        .when(paddle.isNotNull(), "paddleocr")
    )


@query(
    f"""WITH x AS (SELECT t.txt_id, {Q.quality('t.txt')} AS ns, e.s AS os FROM txt_opendataloader t LEFT JOIN (SELECT {ACT} AS a, max({Q.quality('testo_completo_llm')}) AS s FROM dataset_atti WHERE {Q.strip('testo_completo_llm')} <> '' GROUP BY 1) e ON e.a = {ACT.replace('id_atto', 't.id_atto')})
SELECT txt_id, ns, os, CASE WHEN ns >= 75 THEN 'nativo' WHEN os IS NOT NULL AND os >= ns + 5 THEN 'ocr' ELSE 'nativo' END AS via,
CASE WHEN ns >= 75 THEN 'rapidocr' WHEN os IS NOT NULL AND os >= ns + 5 THEN 'paddleocr' ELSE 'rapidocr' END AS motore FROM x"""
)
def routing(s, d):
    """The routing cascades, with scanned texts on one side and dataset texts on the other."""
    a = table(s, d, "txt_opendataloader").select("txt_id", act_id("id_atto").alias("a"), T.quality(F.col("txt")).alias("ns"))
    b = table(s, d, "dataset_atti").filter(not_blank(F.col("testo_completo_llm"))).select(act_id("id_atto").alias("a"), T.quality(F.col("testo_completo_llm")).alias("q")).groupBy("a").agg(F.max("q").alias("os"))
    x = a.join(b, "a", "left")
    return x.select("txt_id", "ns", "os", route(F.col("ns"), F.col("os")).alias("via"), engine(F.col("ns"), F.col("os")).alias("motore"))


def audit_rows(records: DataFrame) -> DataFrame:
    """Records in the audit's columns, stamped with the time of the run."""
    have = set(records.columns)
    cols = "id_atto file_name pdf_path_locale pdf_link txt_path_locale txt_link testo_llm_path_locale testo_llm_link ocr errore_tecnico".split()
    counts = "fallback_locale input_tokens output_tokens total_tokens num_chunk_llm".split()
    money = "costo_input costo_output costo_totale avg_input_tokens_per_chunk avg_output_tokens_per_chunk avg_total_tokens_per_chunk".split()
    pick = lambda c, kind, default: (F.coalesce(F.col(c).cast(kind), F.lit(default)) if c in have else F.lit(default)).cast(kind).alias(c)
    return records.select(
        *[pick(c, "string", "") for c in cols], pick("modello", "string", ""), *[pick(c, "bigint", 0) for c in counts], *[pick(c, "double", 0.0) for c in money], F.current_timestamp().alias("timestamp")
    )

