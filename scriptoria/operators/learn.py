"""TF-IDF features as plans; three text classifiers; cross-validation.

Counts, document frequencies and weights are DataFrame aggregations and scale with the
data. The classifiers' solvers work on hundreds to thousands of rows, so each fold is
one task that fits its features and models on a bounded sample of its training rows
(``most``). The fitted models are of fixed size and broadcast; every test row is
predicted, in batches, and all metrics come from one table.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.functions.labels import canonical_label
from scriptoria.operators.ranking import group_rank
from scriptoria.operators.relational import SEED, folds
from scriptoria.plans import sqlkit as Q
from scriptoria.session import cut, spread, table

QUERIES: dict = {}
ORACLES: dict = {}
MAX_WORDS, MAX_CHARS = 20_000, 12_000
MOST_ROWS = 400  # training rows that a model is fitted on
MOST_TERMS = 100_000  # terms with their counts that are broadcast: about 50 MB
STEP = 256  # rows predicted at a time


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- features as plans


def word_grams(c: Column, least: int = 1, most: int = 3) -> Column:
    """L1: all runs of ``least`` to ``most`` words of two characters or more."""
    w = F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]{2,})"), 1)
    run = lambda w, n: F.transform(F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(w, i, n), " "))
    return T.let(w, lambda w: F.concat(*[run(w, n) for n in range(least, most + 1)]))


def char_grams(c: Column, least: int = 3, most: int = 5) -> Column:
    """L2: character runs inside words padded by a blank; a word shorter than the run
    counts once, whole."""

    def of(p: Column) -> Column:
        n = F.length(p)
        cuts = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(p, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
        whole = F.when(n < most, F.array(p)).otherwise(F.array().cast("array<string>"))
        return F.concat(*[cuts(k) for k in range(least, most + 1)], whole)

    words = F.filter(F.split(c, r"\s+"), lambda w: F.length(w) > 0)
    return F.flatten(F.transform(words, lambda w: of(F.concat(F.lit(" "), w, F.lit(" ")))))


def term_counts(rows: DataFrame, id_: str, grams: Column) -> DataFrame:
    """(id, term, tf), written down. Rows are parted by id before their terms unfold, so
    that the texts travel once and the terms not at all."""
    n = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    each = rows.repartition(n, id_).select(F.col(id_).alias("id"), F.explode(grams).alias("term"))
    return cut(each.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf")))


def kept_terms(tf: DataFrame, rows: int, most: int) -> DataFrame:
    """L4: (term, idf) of the ``most`` commonest terms (ties by the term), marked for
    broadcast: ln((1 + n) / (1 + df)) + 1."""
    top = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).orderBy(F.desc("total"), "term").limit(most)
    return F.broadcast(cut(top.select("term", (F.ln((1 + F.lit(rows)) / (1 + F.col("df"))) + 1).alias("idf"))))


def weighed(tf: DataFrame, terms: DataFrame) -> DataFrame:
    """L1 to L3: (id, term, w), each row's weights of length 1: (1 + ln tf) times idf. A
    row's terms are packed, normed and unpacked in one pass."""
    x = tf.join(terms, "term").groupBy("id").agg(F.collect_list(F.struct("term", ((1 + F.ln("tf")) * F.col("idf")).alias("w"))).alias("ts"))
    norm = F.sqrt(F.aggregate("ts", F.lit(0.0), lambda a, t: a + t["w"] * t["w"]))
    x = x.select("id", "ts", norm.alias("norm"))  # before the rows unfold, else once for each term
    return x.select("id", "norm", F.inline("ts")).select("id", "term", (F.col("w") / F.col("norm")).alias("w"))


def tfidf(rows: DataFrame, id_: str, grams: Column, most: int) -> DataFrame:
    """L1 to L4: (id, term, w) of the rows over their own commonest terms. Ids must differ."""
    tf = term_counts(rows, id_, grams)
    return weighed(tf, kept_terms(tf, rows.count(), most))


def _grams_sql(src: str) -> str:
    return f"""w AS (SELECT id, regexp_extract_all(tm, '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM {src}),
g AS (SELECT id, array_to_string(w[i:i + k - 1], ' ') AS term FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS ks(k) WHERE len(w) >= k))"""


def _chars_sql(src: str) -> str:
    return f"""cw AS (SELECT id, ' ' || unnest(list_filter(string_split(tm, ' '), lambda x: x <> '')) || ' ' AS p FROM {src}),
cg AS (SELECT id, substr(p, i, k) AS term FROM (SELECT id, p, k, unnest(range(1, length(p) - k + 2)) AS i FROM cw, (VALUES (3), (4), (5)) AS ks(k) WHERE length(p) >= k) UNION ALL SELECT id, p FROM cw WHERE length(p) < 5)"""


_SRC = f"src AS (SELECT riga_id AS id, {Q.ml_clean('testo_completo_llm')} AS tm FROM dataset_atti)"
_TF = f"WITH {_SRC}, {_grams_sql('src')}, tf AS (SELECT id, term, count(*) AS tf FROM g GROUP BY ALL)"
_TOP = lambda most: f", dfs AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1 ORDER BY total DESC, term LIMIT {most})"
_W = ", x AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM src)) / (1 + df)) + 1) AS w FROM tf JOIN dfs USING (term)) SELECT id AS riga_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS w FROM x"


def _texts(s, d) -> DataFrame:
    return table(s, d, "dataset_atti").select("riga_id", T.ml_clean("testo_completo_llm").alias("tm"))


@query(_TF + _TOP(MAX_WORDS) + _W)
def tfidf_word(s, d):
    """L1, L3, L4."""
    return tfidf(_texts(s, d), "riga_id", word_grams(F.col("tm")), MAX_WORDS).select(F.col("id").alias("riga_id"), "term", F.round("w", 6).alias("w"))


@query(f"WITH {_SRC}, {_chars_sql('src')}, tf AS (SELECT id, term, count(*) AS tf FROM cg GROUP BY ALL)" + _TOP(MAX_CHARS) + _W)
def tfidf_char(s, d):
    """L2 to L4."""
    return tfidf(_texts(s, d), "riga_id", char_grams(F.col("tm")), MAX_CHARS).select(F.col("id").alias("riga_id"), "term", F.round("w", 6).alias("w"))


@query(_TF + " SELECT term, df, ln((1 + (SELECT count(*) FROM src)) / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1)")
def idf(s, d):
    """L4: smooth idf of every term."""
    x = _texts(s, d)
    n = x.count()
    g = x.select("riga_id", F.explode(F.array_distinct(word_grams(F.col("tm")))).alias("term"))
    return g.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", "df", (F.ln((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))


@query(
    f"""WITH {_SRC}, p AS (SELECT id, ' ' || unnest(list_filter(string_split(tm, ' '), lambda x: x <> '')) || ' ' AS p FROM src),
g AS (SELECT substr(p, i, k) AS gram FROM (SELECT p, k, unnest(range(1, length(p) - k + 2)) AS i FROM p, (VALUES (3), (4), (5)) AS ks(k) WHERE length(p) >= k) UNION ALL SELECT p FROM p WHERE length(p) < 5)
SELECT gram, count(*) AS n FROM g GROUP BY 1"""
)
def char_ngrams(s, d):
    """L2: counts of all padded character runs."""
    x = table(s, d, "dataset_atti").select(T.ml_clean("testo_completo_llm").alias("tm"))
    return x.select(F.explode(char_grams(F.col("tm"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def naive_bayes(train: DataFrame, test: DataFrame, id_: str, label: str, text: str, alpha: float = 1.0) -> DataFrame:
    """L5, as a plan: (id, label): the likeliest label of each test row by word counts,
    smoothed by ``alpha``; the class prior is not smoothed; equal scores go to the first
    label. Words unseen in training say nothing; a row without known words gets the
    commonest label. Word counts are aggregated before they meet the labels."""
    w = lambda df, *keep: df.select(*keep, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)).alias("t"))
    prior = train.groupBy(F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    n = train.count()
    counts = w(train, F.col(label).alias("y")).groupBy("y", "t").agg(F.count(F.lit(1)).alias("c"))
    terms = counts.select("t").distinct()
    size = terms.count()
    total = counts.groupBy("y").agg(F.sum("c").alias("m"))
    base = prior.join(total, "y", "left").select("y", F.ln(F.col("n") / F.lit(n)).alias("prior"), F.ln(F.lit(alpha) / (F.coalesce("m", F.lit(0)) + F.lit(alpha * size))).alias("unseen"))
    lift = counts.select("y", "t", F.ln((F.col("c") + alpha) / F.lit(alpha)).alias("lift"))
    mine = w(test, id_).groupBy(id_, "t").agg(F.count(F.lit(1)).alias("k")).join(terms, "t", "left_semi")
    known = mine.groupBy(id_).agg(F.sum("k").alias("words"))
    gain = mine.join(lift, "t").groupBy(id_, "y").agg(F.sum(F.col("k") * F.col("lift")).alias("gain"))
    return _likeliest(test.select(id_).join(known, id_, "left"), base, gain, [id_], "words")


@query(
    f"""WITH tr AS (SELECT riga_id AS id, {Q.canonical('golden_label')} AS y, {Q.ml_clean('testo_completo_llm')} AS tm FROM training_set WHERE {Q.canonical('golden_label')} IS NOT NULL),
te AS (SELECT riga_id AS id, {Q.ml_clean('testo_completo_llm')} AS tm FROM test_set),
c AS (SELECT y, t, count(*) AS c FROM (SELECT y, unnest(regexp_extract_all(tm, '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS t FROM tr) GROUP BY ALL),
b AS (SELECT y, ln(n / (SELECT count(*) FROM tr)) AS prior, ln(1 / (coalesce(m, 0) + (SELECT count(DISTINCT t) FROM c))) AS unseen FROM (SELECT y, count(*) AS n FROM tr GROUP BY 1) LEFT JOIN (SELECT y, sum(c) AS m FROM c GROUP BY 1) USING (y)),
m AS (SELECT id, t, count(*) AS k FROM (SELECT id, unnest(regexp_extract_all(tm, '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS t FROM te) WHERE t IN (SELECT t FROM c) GROUP BY ALL),
x AS (SELECT te.id, b.y, round(b.prior + coalesce((SELECT sum(k) FROM m WHERE m.id = te.id), 0) * b.unseen + coalesce((SELECT sum(k * ln(c + 1)) FROM m JOIN c USING (t) WHERE m.id = te.id AND c.y = b.y), 0), 8) AS s FROM te, b)
SELECT id AS riga_id, arg_min(y, (-s, y)) AS label FROM x GROUP BY 1"""
)
def nb_predict(s, d):
    """Trained on the training set, applied to the test set."""
    tr = table(s, d, "training_set").select("riga_id", canonical_label(F.col("golden_label")).alias("y"), T.ml_clean("testo_completo_llm").alias("tm")).filter("y is not null")
    te = table(s, d, "test_set").select("riga_id", T.ml_clean("testo_completo_llm").alias("tm"))
    return naive_bayes(tr, te, "riga_id", "y", "tm")


def union_bayes(train: DataFrame, test: DataFrame, id_: str, label: str, text: str, alpha: float = 1.0) -> DataFrame:
    """(id, label) of each test row by multinomial Bayes over word and character
    TF-IDF side by side, as the published classifier has it: terms and idf from the
    training rows, class weights smoothed by ``alpha``, the class prior not; equal scores
    go to the first label, a row without known terms to the commonest. What is sent to
    all tasks has MAX_WORDS + MAX_CHARS terms of each label at most. Ids must differ."""
    n = train.count()
    mine, theirs = [], []
    for name, grams, most in (("w", word_grams, MAX_WORDS), ("c", char_grams, MAX_CHARS)):
        tf = term_counts(train, id_, grams(F.col(text)))
        terms = kept_terms(tf, n, most)
        mine.append(weighed(tf, terms).withColumn("part", F.lit(name)))
        theirs.append(weighed(term_counts(test, id_, grams(F.col(text))), terms).withColumn("part", F.lit(name)))
    y = train.select(F.col(id_).alias("id"), F.col(label).alias("y"))
    sums = mine[0].unionByName(mine[1]).join(y, "id").groupBy("y", "part", "term").agg(F.sum("w").alias("c"))
    sums = cut(sums)
    size = sums.select("part", "term").distinct().count()
    total = sums.groupBy("y").agg(F.sum("c").alias("m"))
    base = y.groupBy("y").agg(F.ln(F.count(F.lit(1)) / F.lit(n)).alias("prior")).join(total, "y", "left")
    base = base.select("y", "prior", F.ln(F.lit(alpha) / (F.coalesce("m", F.lit(0.0)) + F.lit(alpha * size))).alias("unseen"))
    lift = F.broadcast(sums.select("y", "part", "term", F.ln((F.col("c") + alpha) / F.lit(alpha)).alias("lift")))
    x = cut(theirs[0].unionByName(theirs[1]))
    gain = x.join(lift, ["part", "term"]).groupBy("id", "y").agg(F.sum(F.col("w") * F.col("lift")).alias("gain"))
    all_ = test.select(F.col(id_).alias("id")).join(x.groupBy("id").agg(F.sum("w").alias("mass")), "id", "left")
    return _likeliest(all_, base, gain, ["id"], "mass").withColumnRenamed("id", id_)


def _likeliest(rows: DataFrame, base: DataFrame, gain: DataFrame, key: list[str], mass: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(key, label): the label of the greatest prior + mass x unseen + gain of each row."""
    x = rows.join(F.broadcast(base), by) if by else rows.join(F.broadcast(base.groupBy().agg(F.collect_list(F.struct("y", "prior", "unseen")).alias("ys"))), F.lit(True)).select(*rows.columns, F.inline("ys"))
    x = x.join(gain, [*key, "y"], "left")
    s = F.round(F.col("prior") + F.coalesce(F.col(mass), F.lit(0)) * F.col("unseen") + F.coalesce("gain", F.lit(0.0)), 8)
    return x.groupBy(*key).agg(F.min_by("y", F.struct(-s, F.col("y"))).alias("label"))


def _side_sql(name: str, terms: str, most: int) -> str:
    """TF-IDF of training and test texts over the training texts' commonest terms."""
    return f""", {name}f AS (SELECT id, term, count(*) AS tf FROM {terms} GROUP BY ALL),
{name}d AS (SELECT term, count(*) AS df, sum(tf) AS total FROM {name}f WHERE id IN (SELECT id FROM tr) GROUP BY 1 ORDER BY total DESC, term LIMIT {most}),
{name}x AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM tr)) / (1 + df)) + 1) AS w FROM {name}f JOIN {name}d USING (term)),
{name}w AS (SELECT id, '{name}' || term AS term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM {name}x)"""


@query(
    f"""WITH tr AS (SELECT riga_id AS id, {Q.canonical('golden_label')} AS y, {Q.ml_clean('testo_completo_llm')} AS tm FROM training_set WHERE {Q.canonical('golden_label')} IS NOT NULL),
te AS (SELECT riga_id AS id, {Q.ml_clean('testo_completo_llm')} AS tm FROM test_set), src AS (SELECT id, tm FROM tr UNION ALL SELECT id, tm FROM te), {_grams_sql('src')}, {_chars_sql('src')}"""
    + _side_sql("w_", "g", MAX_WORDS)
    + _side_sql("c_", "cg", MAX_CHARS)
    + """, a AS (SELECT * FROM w_w UNION ALL SELECT * FROM c_w), c AS (SELECT y, term, sum(w) AS c FROM a JOIN tr USING (id) GROUP BY ALL),
b AS (SELECT y, ln(n / (SELECT count(*) FROM tr)) AS prior, ln(1 / (coalesce(m, 0) + (SELECT count(DISTINCT term) FROM c))) AS unseen FROM (SELECT y, count(*) AS n FROM tr GROUP BY 1) LEFT JOIN (SELECT y, sum(c) AS m FROM c GROUP BY 1) USING (y)),
t AS (SELECT te.id, term, w FROM te JOIN a USING (id)), gn AS (SELECT t.id, c.y, sum(w * ln(c + 1)) AS gain FROM t JOIN c USING (term) GROUP BY ALL), ms AS (SELECT id, sum(w) AS mass FROM t GROUP BY 1),
x AS (SELECT te.id, b.y, round(b.prior + coalesce(mass, 0) * b.unseen + coalesce(gain, 0), 8) AS s FROM te CROSS JOIN b LEFT JOIN ms USING (id) LEFT JOIN gn ON gn.id = te.id AND gn.y = b.y)
SELECT id AS riga_id, arg_min(y, (-s, y)) AS label FROM x GROUP BY 1"""
)
def nb_union(s, d):
    """Bayes over the TF-IDF union, trained on the training set, applied to the test set."""
    tr = table(s, d, "training_set").select("riga_id", canonical_label(F.col("golden_label")).alias("y"), T.ml_clean("testo_completo_llm").alias("tm")).filter("y is not null")
    te = table(s, d, "test_set").select("riga_id", T.ml_clean("testo_completo_llm").alias("tm"))
    return union_bayes(tr, te, "riga_id", "y", "tm")


def bayes_folds(rows: DataFrame, id_: str, label: str, fold: str, grams: Column, models: tuple[tuple[str, float], ...]) -> DataFrame:
    """(id, modello, fold, y_true, y_pred): for each model (name, smoothing) out-of-fold labels of all rows by multinomial
    Bayes over counts of ``grams``. A fold's training counts are all counts less its own,
    so that one pass over the texts fits every fold's model and a second applies it; no
    row is left out and no model is fitted on a sample. Ties go to the first label."""
    n = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = rows.select(F.col(id_).alias("id"), F.col(label).alias("y"), F.col(fold).alias("fold"), grams.alias("g"))
    tf = cut(x.repartition(n, "id").select("id", "y", "fold", F.explode("g").alias("t")).groupBy("id", "y", "fold", "t").agg(F.count(F.lit(1)).alias("k")))
    own = tf.groupBy("t", "y", "fold").agg(F.sum("k").alias("c"))
    by_label = own.groupBy("t", "y").agg(F.sum("c").alias("all"), F.map_from_entries(F.collect_list(F.struct("fold", "c"))).alias("cs"))
    terms = cut(by_label.groupBy("t").agg(F.collect_list(F.struct("y", "all", "cs")).alias("ys")))  # an entry a label, a count a fold
    # A vocabulary of known size goes to all tasks. A larger one is shuffled anew, so that
    # the rows of a word that is in every text can be split.
    many = terms.count()
    looked = F.broadcast(terms) if many <= MOST_TERMS else terms.select(F.concat("t", F.lit("")).alias("t"), "ys")
    left = lambda r: r["all"] - F.coalesce(F.try_element_at(r["cs"], F.col("fold")), F.lit(0))
    # What a fold has to learn from: rows, words and different words outside it.
    ys = F.col("ys")
    inside = cut(terms.select(F.inline("ys")).select("y", "all", F.explode("cs").alias("fold", "c")).groupBy("y", "fold").agg(F.sum("c").alias("c")))
    sizes = cut(x.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n")))
    alone = terms.select(F.array_distinct(F.flatten(F.transform(ys, lambda r: F.map_keys(r["cs"])))).alias("f")).filter(F.size("f") == 1).groupBy(F.col("f")[0].alias("fold")).agg(F.count(F.lit(1)).alias("gone"))
    every = sizes.select("y").distinct().crossJoin(F.broadcast(sizes.select("fold").distinct()))  # labels x folds
    total = lambda d, c: d.groupBy("y").agg(F.sum(c).alias("__all")).join(every, "y").join(d, ["y", "fold"], "left").select("y", "fold", (F.col("__all") - F.coalesce(c, F.lit(0))).alias(c))
    base = total(sizes, "n").filter("n > 0").join(total(inside, "c"), ["y", "fold"], "left").join(alone, "fold", "left").withColumn("v", F.lit(many) - F.coalesce("gone", F.lit(0)))
    rows_of = base.groupBy("fold").agg(F.sum("n").alias("rows"))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("modello"), F.lit(a).alias("alpha")) for m, a in models])).alias("m")
    base = base.join(rows_of, "fold").select("*", each).select("*", "m.*")
    base = cut(base.select("modello", "fold", "y", F.ln(F.col("n") / F.col("rows")).alias("prior"), F.ln(F.col("alpha") / F.greatest(F.coalesce("c", F.lit(0)) + F.col("v") * F.col("alpha"), F.col("alpha"))).alias("unseen")))
    known = F.when(F.exists(ys, lambda r: left(r) > 0), F.array(F.struct(F.lit(None).cast("string").alias("modello"), F.lit(None).cast("string").alias("y"), F.col("k").cast("double").alias("s")))).otherwise(F.array().cast("array<struct<modello:string,y:string,s:double>>"))
    seen = F.filter(ys, lambda r: left(r) > 0)
    speaks = lambda m, a: F.transform(seen, lambda r: F.struct(F.lit(m).alias("modello"), r["y"].alias("y"), (F.col("k") * F.ln((left(r) + a) / F.lit(a))).alias("s")))
    lift = [speaks(m, a) for m, a in models]
    sums = cut(tf.select("id", "fold", "t", "k").join(looked, "t").select("id", "fold", F.inline(F.concat(known, *lift))).groupBy("id", "fold", "modello", "y").agg(F.sum("s").alias("s")))
    truth = x.select("id", "fold", F.col("y").alias("y_true"))
    mass = sums.filter("y is null").select("id", "fold", F.col("s").alias("mass"))
    gain = sums.filter("y is not null").select("id", "fold", "modello", "y", F.col("s").alias("gain"))
    asked = truth.select("id", "fold", F.explode(F.array(*[F.lit(m) for m, _ in models])).alias("modello")).join(mass, ["id", "fold"], "left")
    pred = _likeliest(asked, base, gain, ["id", "fold", "modello"], "mass", ["fold", "modello"])
    return truth.join(pred, ["id", "fold"]).select("id", "modello", "fold", "y_true", F.col("label").alias("y_pred"))


BAYES = (("bayes_1", 1.0), ("bayes_01", 0.1))  # two smoothings of the words' counts


def fold_predictions(s, d) -> DataFrame:
    """(id, modello, fold, y_true, y_pred) of two models over all labelled rows with text."""
    x = cut(folds(_rows(s, d), "y", "riga_id"))
    return cut(bayes_folds(x, "riga_id", "y", "fold", word_grams(F.col("tm"), 1, 1), BAYES))


def _fold_sql(name: str, alpha: float) -> str:
    """Out-of-fold predictions of one model of BAYES from the words g (id, y, fold, t)."""
    p = name.removeprefix("bayes")
    return f"""b{p} AS (SELECT n.fold, n.y, ln(n.n / sum(n.n) OVER (PARTITION BY n.fold)) AS prior, ln({alpha} / (coalesce(m, 0) + {alpha} * v)) AS unseen FROM n JOIN v USING (fold) LEFT JOIN (SELECT fold, y, sum(c) AS m FROM c0 GROUP BY ALL) m ON m.fold = n.fold AND m.y = n.y),
a{p} AS (SELECT id, c.y, sum(k * ln((c + {alpha}) / {alpha})) AS gain FROM k JOIN c0 c USING (fold, t) GROUP BY ALL),
s{p} AS (SELECT r.id, r.fold, r.y AS y_true, b.y, round(prior + coalesce(mass, 0) * unseen + coalesce(gain, 0), 8) AS s FROM r JOIN b{p} b USING (fold) LEFT JOIN m ON m.id = r.id LEFT JOIN a{p} a ON a.id = r.id AND a.y = b.y),
p{p} AS (SELECT id, '{name}' AS modello, fold, y_true, arg_min(y, (-s, y)) AS y_pred FROM s{p} GROUP BY id, fold, y_true)"""


PREDICTED_SQL = f"""WITH r0 AS (SELECT riga_id AS id, {Q.canonical('golden_label')} AS y, {Q.ml_clean('testo_completo_llm')} AS tm FROM dataset_atti),
r1 AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(id AS VARCHAR) || ':{SEED}'), id) AS rank, count(*) OVER (PARTITION BY y) AS n FROM r0 WHERE y IS NOT NULL AND length(tm) > 0),
r AS (SELECT id, y, CAST((rank - 1) % (SELECT least(5, min(n)) FROM r1) AS INT) AS fold, regexp_extract_all(tm, '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM r1),
g AS (SELECT id, y, fold, unnest(w) AS t FROM r),
c0 AS (SELECT f.fold, g.y, g.t, count(*) AS c FROM g JOIN (SELECT DISTINCT fold FROM r) f ON f.fold <> g.fold GROUP BY ALL),
n AS (SELECT f.fold, r.y, count(*) AS n FROM r JOIN (SELECT DISTINCT fold FROM r) f ON f.fold <> r.fold GROUP BY ALL),
v AS (SELECT fold, count(DISTINCT t) AS v FROM c0 GROUP BY 1), k AS (SELECT id, fold, t, count(*) AS k FROM g GROUP BY ALL),
m AS (SELECT id, sum(k) AS mass FROM k JOIN (SELECT DISTINCT fold, t FROM c0) USING (fold, t) GROUP BY 1),
""" + ",\n".join(_fold_sql(*b) for b in BAYES) + """,
p AS (SELECT * FROM p_1 UNION ALL SELECT * FROM p_01)"""


@query(PREDICTED_SQL + " SELECT id AS riga_id, modello, fold, y_true, y_pred FROM p")
def bayes_predictions(s, d):
    """Out-of-fold labels of every labelled row by two models."""
    return fold_predictions(s, d).select(F.col("id").alias("riga_id"), "modello", "fold", "y_true", "y_pred")


# --- features and solvers in one task


class Rows:
    """A sparse matrix by rows: products with dense matrices on either side."""

    def __init__(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, shape: tuple[int, int]):
        self.row, self.col, self.val, self.shape = row, col, val, shape

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.row, self.val * w[self.col, k], self.shape[0]) for k in range(w.shape[1])], axis=1)

    def tdot(self, g: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.col, self.val * g[self.row, k], self.shape[1]) for k in range(g.shape[1])], axis=1)

    def columns(self, a: int, b: int) -> np.ndarray:
        out = np.zeros((self.shape[0], b - a))
        here = (self.col >= a) & (self.col < b)
        out[self.row[here], self.col[here] - a] = self.val[here]
        return out

    def gram(self, other: Rows, step: int = 4096) -> np.ndarray:
        """Inner products of all rows with all rows of ``other``, by blocks of columns."""
        out = np.zeros((self.shape[0], other.shape[0]))
        for a in range(0, self.shape[1], step):
            b = min(a + step, self.shape[1])
            out += self.columns(a, b) @ other.columns(a, b).T
        return out


class Dense:
    """A dense matrix with the products of Rows."""

    def __init__(self, m: np.ndarray):
        self.m, self.shape = m, m.shape

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.m @ w

    def tdot(self, g: np.ndarray) -> np.ndarray:
        return self.m.T @ g


WORD = re.compile(r"[^\W]{2,}")


def py_word_grams(t: str) -> list[str]:
    w = WORD.findall(t)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def py_char_grams(t: str) -> list[str]:
    out = []
    for w in t.split():
        p = f" {w} "
        for n in (3, 4, 5):
            out += [p[i : i + n] for i in range(len(p) - n + 1)]
        if len(p) < 5:
            out.append(p)
    return out


class Features:
    """L1 to L4 fitted on training texts: word and character TF-IDF side by side."""

    def __init__(self, texts: list[str]):
        self.parts = []
        for cut, most in ((py_word_grams, MAX_WORDS), (py_char_grams, MAX_CHARS)):
            each = [Counter(cut(t)) for t in texts]
            total, df = Counter(), Counter()
            for c in each:
                total.update(c)
                df.update(c.keys())
            top = sorted(total, key=lambda g: (-total[g], g))[:most]
            idf = np.array([np.log((1 + len(texts)) / (1 + df[g])) + 1 for g in top])
            self.parts.append((cut, {g: i for i, g in enumerate(top)}, idf))

    def of(self, texts: list[str]) -> Rows:
        rows, cols, vals, base = [], [], [], 0
        for cut, at, idf in self.parts:
            for i, t in enumerate(texts):
                c = [(at[g], n) for g, n in Counter(cut(t)).items() if g in at]
                if c:
                    j = np.array([x for x, _ in c])
                    v = (1 + np.log([n for _, n in c])) * idf[j]
                    rows.append(np.full(len(j), i))
                    cols.append(j + base)
                    vals.append(v / np.linalg.norm(v))
            base += len(at)
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.empty(0, t)
        return Rows(cat(rows, int), cat(cols, int), cat(vals, float), (len(texts), base))


def lbfgs(f, x: np.ndarray, rounds: int = 100, memory: int = 10, tol: float = 1e-3) -> np.ndarray:
    """Minimum of a smooth convex function ``f(x) -> (value, gradient)``."""
    v, g = f(x)
    ss, ys = [], []
    for _ in range(rounds):
        if np.abs(g).max() < tol:
            break
        q, back = g.copy(), []
        for s, y in zip(reversed(ss), reversed(ys)):
            a = s @ q / (y @ s)
            q -= a * y
            back.append(a)
        if ys:
            q *= ss[-1] @ ys[-1] / (ys[-1] @ ys[-1])
        for (s, y), a in zip(zip(ss, ys), reversed(back)):
            q += s * (a - y @ q / (y @ s))
        step, slope = 1.0 if ys else min(1.0, 1 / np.abs(g).sum()), g @ q
        while True:
            new = x - step * q
            v2, g2 = f(new)
            if v2 <= v - 1e-4 * step * slope or step < 1e-12:
                break
            step /= 2
        s, y = new - x, g2 - g
        if s @ y > 1e-12:
            ss.append(s)
            ys.append(y)
            ss, ys = ss[-memory:], ys[-memory:]
        x, v, g = new, v2, g2
    return x


def balanced(y: np.ndarray, k: int) -> np.ndarray:
    n = np.bincount(y, minlength=k)
    return len(y) / (k * np.maximum(n, 1))[y]


def fit_logistic(x: Rows, y: np.ndarray, k: int, c: float = 1.0) -> np.ndarray:
    """Multinomial, balanced weights, L2 on all but the intercept; (features + 1) x k."""
    w, hot = balanced(y, k), np.eye(k)[y]

    def f(flat: np.ndarray):
        m = flat.reshape(-1, k)
        z = x.dot(m[:-1]) + m[-1]
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        loss = -c * (w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum() + 0.5 * (m[:-1] ** 2).sum()
        g = c * w[:, None] * (p - hot)
        return loss, np.vstack([x.tdot(g) + m[:-1], g.sum(axis=0)]).ravel()

    return lbfgs(f, np.zeros((x.shape[1] + 1) * k)).reshape(-1, k)


def fit_svm(x: Rows, y: np.ndarray, k: int, c: float = 1.0) -> np.ndarray:
    """One against the rest, squared hinge, balanced weights, intercept penalised."""
    w, sign = balanced(y, k), 2 * np.eye(k)[y] - 1

    def f(flat: np.ndarray):
        m = flat.reshape(-1, k)
        slack = np.maximum(0, 1 - sign * (x.dot(m[:-1]) + m[-1]))
        g = -2 * c * w[:, None] * sign * slack
        return c * (w[:, None] * slack**2).sum() + 0.5 * (m**2).sum(), np.vstack([x.tdot(g) + m[:-1], g.sum(axis=0) + m[-1]]).ravel()

    return lbfgs(f, np.zeros((x.shape[1] + 1) * k)).reshape(-1, k)


def fit_bayes(x: Rows, y: np.ndarray, k: int, alpha: float = 1.0) -> np.ndarray:
    """L5 on TF-IDF weights; the class prior is not smoothed."""
    c = x.tdot(np.eye(k)[y]) + alpha
    return np.vstack([np.log(c / c.sum(axis=0)), np.log(np.maximum(np.bincount(y, minlength=k), 1e-300) / len(y))])


MODELS = {"linear_svm": fit_svm, "logistic_regression": fit_logistic, "naive_bayes": fit_bayes}


Fitted = tuple[Features | None, dict[str, tuple[list[str], np.ndarray]]]  # features, and of each model its labels and weights


def fit_all(models, texts: list[str], labels: list[str]) -> Fitted:
    """MODELS by name, fitted on the training texts over the same features."""
    names = sorted(set(labels))
    if len(names) < 2:
        return None, {m: (names, np.empty(0)) for m in models}
    y = np.array([names.index(v) for v in labels])
    feats = Features(texts)
    x = feats.of(texts)
    out, low = {}, None
    for model in models:
        if model == "naive_bayes":
            m = fit_bayes(x, y, len(names))
        else:
            # The best weights lie in the span of the rows, of which there are far fewer than
            # features: with K = X X' = L L', the rows of L stand for those of X, and the
            # loss and the penalty are the same. Weights m of L's columns are X' L'^-1 m of X's.
            if low is None:
                low = np.linalg.cholesky(x.gram(x) + 1e-9 * np.eye(len(y)))
            m = MODELS[model](Dense(low), y, len(names))
            m = np.vstack([x.tdot(np.linalg.solve(low.T, m[:-1])), m[-1]])
        out[model] = names, m
    return feats, out


def predict_all(fitted: Fitted, texts: list[str]) -> dict[str, list[str | None]]:
    """Of each model the labels of the texts; null where there was nothing to learn."""
    feats, models = fitted
    out: dict[str, list[str | None]] = {m: [] for m in models}
    for a in range(0, len(texts), STEP):
        part = texts[a : a + STEP]
        z = feats.of(part) if feats is not None else None
        for model, (names, m) in models.items():
            out[model] += [names[i] for i in (z.dot(m[:-1]) + m[-1]).argmax(axis=1)] if z is not None else (names or [None]) * len(part)
    return out


def fit_predict(model: str, texts: list[str], labels: list[str], test: list[str]) -> list[str]:
    """Labels of the test texts by one of MODELS fitted on the training texts."""
    return predict_all(fit_all((model,), texts, labels), test)[model] if labels else []


def fit_sample(rows: DataFrame, label: str, id_: str, most: int) -> DataFrame:
    """The first rows of each class in seeded order: ``most`` by the classes' shares, two
    of each at least."""
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    total = n.agg(F.sum("__n")).first()[0] or 1
    quota = n.select(F.col(label).alias("__l"), F.greatest(F.lit(2), F.ceil(F.lit(most) * F.col("__n") / F.lit(total))).alias("__quota"))
    x = group_rank(rows, label, id_, SEED).join(F.broadcast(quota), F.col(label) == F.col("__l"))
    return x.filter("__rank <= __quota").drop("__rank", "__l", "__quota")


def fitted_runs(sample: DataFrame, models) -> dict[int, Fitted]:
    """The models of each run of (run, id, y, t), one task a run."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id")
        return pd.DataFrame({"run": p["run"].iloc[:1], "model": [pickle.dumps(fit_all(models, p["t"].tolist(), p["y"].tolist()))]})

    got = sample.select("run", "id", "y", "t").groupBy("run").applyInPandas(run, "run int, model binary").collect()
    return {r["run"]: pickle.loads(r["model"]) for r in got}


def predicted(rows: DataFrame, fitted: dict[int, Fitted]) -> DataFrame:
    """(id, modello, fold, y_true, y_pred) of every row of (id, y, t, fold), by the models
    of run ``fold``."""
    known = rows.sparkSession.sparkContext.broadcast(fitted)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for fold, b in p.groupby("fold"):
                if fold in known.value:
                    for model, got in predict_all(known.value[fold], b["t"].tolist()).items():
                        yield pd.DataFrame({"id": b["id"], "modello": model, "fold": fold, "y_true": b["y"], "y_pred": got})

    return spread(rows.select("id", "y", "t", "fold")).mapInPandas(run, f"id {kind}, modello string, fold int, y_true string, y_pred string")


def cross_validate(rows: DataFrame, id_: str, label: str, text: str, most: int = MOST_ROWS, models=tuple(MODELS)) -> DataFrame:
    """(id, modello, fold, y_true, y_pred): out-of-fold predictions of every model for
    every row of a label with two rows or more; each fold's models are fitted on about
    ``most`` of its training rows (fit_sample)."""
    x = rows.select(F.col(id_).alias("id"), F.col(label).alias("y"), F.col(text).alias("t"))
    big = cut(x.join(x.groupBy("y").count().filter("count >= 2").select("y"), "y", "left_semi"))
    x = cut(folds(big, "y", "id"))
    k = x.agg(F.max("fold")).first()[0]
    if k is None:
        return rows.sparkSession.createDataFrame([], "id bigint, modello string, fold int, y_true string, y_pred string")
    pool = fit_sample(x, "y", "id", -(-most * (k + 1) // max(k, 1)))  # the folds share it evenly
    sample = pool.withColumn("run", F.explode(F.array(*[F.lit(i) for i in range(k + 1)]))).filter("run <> fold")
    return predicted(x, fitted_runs(sample, models))


def _rows(s, d) -> DataFrame:
    x = table(s, d, "dataset_atti").select("riga_id", canonical_label(F.col("golden_label")).alias("y"), T.ml_clean("testo_completo_llm").alias("tm"))
    return x.filter("y is not null and length(tm) > 0")


@query()
def cv_predictions(s, d):
    """Out-of-fold predictions of the three classifiers."""
    return cross_validate(_rows(s, d), "riga_id", "y", "tm")
