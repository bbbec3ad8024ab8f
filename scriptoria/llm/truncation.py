"""Texts cut before their end: censored length distributions and ending evidence.

Plan. A first pass reduces every text to its lengths and the form of its ending. Closing
marks and known closing formulas settle their texts, and so do ends after which more
must come: a comma, a function word, half a word. What is left is open: a fragment of
whole words that may be a closing formula not known beforehand, or a full stop that may
belong to a figure or a name. Two passes over the corpus judge its parts: a fragment
that ends distinct texts more often than it goes on in them, and a last word that
stands inside other texts. Equal copies of a text count once throughout.

Length histograms of distinct texts give for each source a right-censored log-normal by
maximum likelihood, the limits where lengths pile up, and the posterior that a text of
just that length was cut there; the token cap of the last run in the audit is a third
measure. How cut texts end is learned where the posterior is high, how complete ones
end from the texts away from all limits, less what cuts explain there. The log odds of
a text are those of its form and those of being cut, which the posterior raises at a
limit: an open end that is more common away from the limits than cuts explain is
complete there, and cut at a limit.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.common import U, WordHashes, as_long, signed, small
from scriptoria.session import cut, spread

SKETCH_BITS = 22  # of fragment beginnings worth counting: where it fills, more are counted, none is lost
FORMULA_SHARE = 2e-3  # a frequent fragment ends at least this share of the distinct texts: at most 500 are
FORMULA_LEAST = 3
BEFORE = 24  # words before a last fragment by which two texts that end with it differ
SOURCE_ROWS = 50  # texts that the rate of cuts over all sources weighs in that of each
# How cut texts end, weighing as much as four of them: rules where a table has few at its limits.
USUAL = {"inside": 1.8, "hanging": 0.8, "dangling": 0.3, "fragment": 1.0, "repeated": 0.05, "frequent": 0.02, "doubtful": 0.03}
CUT = ("inside", "hanging", "dangling")  # forms after which more must come
OPEN = ("fragment", "repeated", "frequent", "doubtful")  # forms that the odds decide
SURE = 0.5  # posterior from which a text is at a limit

# Abbreviations after which a sentence goes on; marks of omission.
ABBREVIATIONS = frozenset(
    "all art artt avv c.a cap cfr co comm dott dr ecc fg geom ing lett loc mapp mod n nn nr num on p pag par pp prof prot rag rep rif s sec sez sig sigg spett tab tel v vol".split()
)
# Words that end no sentence, closing formula or value.
HANGING = frozenset(
    "il lo la i gli le l un uno una di d del dello della dei degli delle dell a ad al allo alla ai agli alle all da dal dalla dai dalle dall in nel nella nei nelle nell con su sul sulla sui sulle sull per tra fra e ed o che se come ma n via viale piazza piazzale largo strada vicolo corso numero comma art articolo cui ai sensi euro è dal quale presso entro".split()
)
OMISSION = re.compile(
    r"(?:\s*(?:\[\s*(?:\.{2,}|…|segue|continua|omissis)\s*\]|\(\s*(?:\.{2,}|…|segue|continua|omissis)\s*\)|…|\.{2,}|\bomissis\b|\bsegue\b|\bcontinua\b))+\s*$",
    re.I,
)
NAME = re.compile(r"\b[A-ZÀ-Ý]\.\s*[A-ZÀ-Ý][\w'’-]*(?:\s+[A-ZÀ-Ý][\w'’-]*)?")
ROLE = "sindaco|sindaca|vicesindaco|presidente|segretario|segretaria|dirigente|responsabile|assessore|funzionario|comandante|direttore|commissario|verbalizzante|notaio|relatore"
OFFICE = "comunale|generale|capo|supplente|vicario|delegato|servizio|settore|ufficio|procedimento|consiglio|giunta|area|ente"
OFFICE_ALONE = re.compile(rf"(?:il|la|lo|l['’])\s*(?:{ROLE})")  # a signature where it stands in capitals
# Closing formulas known beforehand; the corpus adds its own. A bare office is none here.
SIGN_OFF = re.compile(
    rf"(?:f\.?to|firmato)\b.*\b(?:{ROLE}|{OFFICE}|§)"
    rf"|(?:il|la|lo|l['’])\s*(?:{ROLE})\b(?:\s+(?:del|della|dello|dell['’]|di|{OFFICE}))*\s*(?:\b(?:{OFFICE})|§)"
    r"|letto,? (?:approvato|confermato) e sottoscritto|visto:? si approva|parere favorevole|pubblicato all['’]albo(?: pretorio)?"
    r"|allegato [a-z0-9]+: .{3,60}|in fede|(?:cordiali|distinti) saluti|così deciso|per copia conforme(?: all['’]originale)?|la seduta è tolta"
)
BOUNDARY = re.compile(r"[.!?;]['\"”»)\]]*\s+(?=[\w«\"“(])|\n+")
OPENERS = tuple(",:-–—/\\(['\"“«‘&+*")
AMOUNT = re.compile(r"(?:€|euro|eur)\s+\d{1,3}(?:\.\d{3})*\.$", re.I)
HALF_DATE = re.compile(r"\b\d{1,2}[./]\d{0,2}[./]?$")
WHOLE_DATE = re.compile(r"\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\.?$")


def ending(text: str | None) -> tuple[str, str, str]:
    """(kind, fragment, last word) of a text's end.

    kinds: blank; closed (a sentence or other closing mark ends it); dangling (a comma,
    bracket, abbreviation or the like, after which more must come); doubtful (a full
    stop that may belong to a number or a company's name); open (no mark at all).
    """
    if text is None or not text.strip():
        return "blank", "", ""
    t = text.strip().rstrip("​﻿")
    short = OMISSION.sub("", t).rstrip()
    omitted = short != t
    t = short
    if not t:
        return "dangling", "", ""
    if omitted and t[-1].isalnum():
        return "dangling", "", ""
    bare = t.rstrip("\"”»’)]")
    if bare != t and bare and not bare[-1].isalnum():
        t = bare
    last = t[-1]
    if last == ".":
        word = re.search(r"(\S+)$", t).group(1).rstrip(".").lstrip("(['\"«“").lower()
        if AMOUNT.search(t):
            return "doubtful", "", word
        if word in ABBREVIATIONS or (len(word) == 1 and word.isalpha()):
            return "dangling", "", word
        if re.search(r"['’]([^\W\d_]+)$", word) and re.search(r"['’]([^\W\d_]+)$", word).group(1) in ABBREVIATIONS:
            return "dangling", "", word
        if word in ("soc", "coop"):
            return "doubtful", "", word
        return "closed", "", word
    if last in "!?;" or last in ")]»”":
        return "closed", "", ""
    if last in OPENERS or not last.isalnum():
        return "dangling", "", ""
    frag = BOUNDARY.split(_masked(t))[-1]
    return "open", " ".join(frag.split()), re.search(r"([\w]+)$", t).group(1).lower()


def _masked(t: str) -> str:
    """Names with an initial as one sign, so that their full stop ends no sentence."""
    return NAME.sub("§", t)


def _digest(words: list[str]) -> int:
    return signed(xxhash.xxh3_64_intdigest(" ".join(words)))


def shape(fragment: str) -> str:
    """A fragment as fragments are compared: in lower case, unless it is all capitals."""
    return fragment if fragment.isupper() else fragment.lower()


def head_hashes(tokens: list[str], hashes: WordHashes) -> list[int]:
    """Signed hashes of the first 1, 2, ... tokens."""
    out, h = [], 0
    for w in hashes(tokens).tolist():
        h = ((h ^ w) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 29
        out.append(signed(h))
    return out


def described(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, chars, bytes, kind, fragment, words, word, stem, key, before, known, named)
    of each row: fragment, word and key are hashes of the last fragment, of its last
    word and of the text, blanks and case apart; words counts the fragment's tokens,
    stem is its last word; before stands for the words ahead of it; known: it is a
    closing formula known beforehand; named: it ends in a name."""
    src = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    fields = [("chars", pa.int32()), ("bytes", pa.int32()), ("kind", pa.string()), ("fragment", pa.int64()), ("words", pa.int32()), ("word", pa.int64()), ("stem", pa.string()), ("key", pa.int64()), ("before", pa.int64()), ("known", pa.bool_()), ("named", pa.bool_())]

    def of(t: str | None, hashes: WordHashes) -> tuple:
        kind, frag, word = ending(t)
        seq = (t or "").lower().split()
        size = len((t or "").encode("utf-8", "replace"))
        if kind == "open":
            tokens = shape(frag).split()
            low = frag.lower()
            known = bool(SIGN_OFF.fullmatch(low)) or (frag.isupper() and bool(OFFICE_ALONE.fullmatch(low)))
            before = _digest(seq[: max(0, len(seq) - len(tokens))][-BEFORE:])
            return len(t), size, kind, head_hashes(tokens, hashes)[-1], len(tokens), signed(int(hashes([word])[0])), word, _digest(seq), before, known, frag.endswith("§")
        return len(t or ""), size, kind, None, 0, None, word, _digest(seq), None, False, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            rows = [of(t, hashes) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(fields)]], names=["id", "source", *[f for f, _ in fields]])

    return src.mapInArrow(run, f"id {kind}, source string, chars int, bytes int, kind string, fragment bigint, words int, word bigint, stem string, key bigint, before bigint, known boolean, named boolean")


def corpus_evidence(df: DataFrame, text_col: str, rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(fragments, words, least): the last fragments of distinct texts that end more than
    one (fragment, n, heads, on: how often texts go on after it, part: a longer word
    begins with its last one) and the last words that stand inside texts (word, lo, hi:
    the least and the greatest text). ``least`` texts make a fragment frequent."""
    ends = rows.filter("kind <> 'blank'")
    n = ends.select("key").distinct().count()
    least = max(FORMULA_LEAST, math.ceil(FORMULA_SHARE * n))
    open_ = ends.filter("kind = 'open'")
    each = open_.groupBy("fragment").agg(F.countDistinct("key").alias("n"), F.countDistinct("before").alias("heads"), F.max("words").alias("words"), F.min("stem").alias("stem"))
    each = cut(each.filter("n > 1 and heads > 1"))
    spark = df.sparkSession
    slots = each.select(F.shiftrightunsigned("fragment", 64 - SKETCH_BITS).alias("s")).distinct().toArrow().column("s").to_numpy()
    sketch = np.zeros(1 << SKETCH_BITS, dtype=bool)
    sketch[slots] = True
    stems = {r[0] for r in each.filter(F.col("n") >= least).select("stem").distinct().collect()}  # of at most 1 / FORMULA_SHARE fragments
    given = spark.sparkContext.broadcast((np.packbits(sketch), each.agg(F.max("words")).first()[0] or 0, stems))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, longest, asked = given.value
        wanted = np.unpackbits(packed).tobytes()
        sizes = sorted({len(w) for w in asked})
        hashes, tokens = WordHashes(), WordHashes()
        checked: set[str] = set()
        longer: set[str] = set()
        for b in batches:
            seen, of, on = [], [], []
            for t in b.column(0).to_pylist():
                if not t:
                    continue
                key = _digest(t.lower().split())
                every = re.findall(r"[^\W_]+", t.lower())
                for w in every if asked else ():
                    if w not in checked:
                        if len(checked) > 400_000:
                            checked.clear()
                        checked.add(w)
                        longer.update(w[:k] for k in sizes if k < len(w) and w[:k] in asked)
                inside = np.unique(hashes(every[:-1]))
                seen.append(inside)
                of.append(np.full(len(inside), key))
                if longest:
                    for s in BOUNDARY.split(_masked(t.strip())):
                        w = s.split(None, longest + 1)[: longest + 1]
                        for h in set(head_hashes([x.lower() for x in w[:-1]], tokens)) | (set(head_hashes(w[:-1], tokens)) if s[:2].isupper() else set()):
                            if wanted[(h & 0xFFFFFFFFFFFFFFFF) >> (64 - SKETCH_BITS)]:
                                on.append((h, key))
            if seen:
                h, k = as_long(np.concatenate(seen)), np.concatenate(of)
                order = np.lexsort((k, h))
                h, k = h[order], k[order]
                first = np.nonzero(np.r_[True, h[1:] != h[:-1]])[0] if len(h) else np.empty(0, int)
                yield block("in", h[first], 0, k[first], np.r_[k[first[1:] - 1], k[-1:]])
            if on:
                h, k = np.array(on, np.int64).T
                yield block("on", h, k, k, k)
        part = as_long(hashes(sorted(longer)))
        yield block("part", part, 0, 0, 0)

    def block(what: str, h, k, lo, hi) -> pa.RecordBatch:
        full = lambda x: pa.array(np.broadcast_to(x, len(h)).astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array([what] * len(h), pa.string()), full(h), full(k), full(lo), full(hi)], names=["what", "h", "k", "lo", "hi"])

    per = df.select(F.col(text_col)).mapInArrow(run, "what string, h bigint, k bigint, lo bigint, hi bigint")
    per = per.groupBy("what", "h", "k").agg(F.count(F.lit(1)).alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    asked = open_.select("word").distinct()
    # A word that is only asked for leaves the rest of the vocabulary behind at once.
    per = cut(per.filter("what <> 'in'").unionByName(per.filter("what = 'in'").join(asked.withColumnRenamed("word", "h"), "h", "left_semi").select(per.columns)))
    words = per.filter("what = 'in'").select(F.col("h").alias("word"), "lo", "hi")
    on = per.filter("what = 'on'").groupBy(F.col("h").alias("fragment")).agg(F.sum("n").alias("on"))
    part = per.filter("what = 'part'").select(F.col("h").alias("last"), F.lit(True).alias("part"))
    last = open_.groupBy("fragment").agg(F.min("word").alias("last"))
    fragments = each.join(last, "fragment").join(on, "fragment", "left").join(small(part), "last", "left")
    return fragments.select("fragment", "n", "heads", F.coalesce("on", F.lit(0)).alias("on"), F.coalesce("part", F.lit(False)).alias("part")), words, least


# --- censored lengths ------------------------------------------------------------


def _phi(z):
    return np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def _upper(z):
    """P(Z > z)."""
    return 0.5 * np.array([math.erfc(x / math.sqrt(2)) for x in np.atleast_1d(z)])


def fit_censored(x: np.ndarray, n: np.ndarray, cut_share: np.ndarray, rounds: int = 40) -> tuple[float, float]:
    """Log-normal (mu, sigma) by maximum likelihood (EM): of the n texts of length x
    the share cut_share was cut there, so that their own length is only known to be more."""
    y = np.log(np.maximum(x, 1.0))
    w = n * (1 - cut_share)
    c = n * cut_share
    total = n.sum()
    mu = float((n * y).sum() / total)
    sd = max(1e-3, float(np.sqrt((n * (y - mu) ** 2).sum() / total)))
    for _ in range(rounds):
        z = np.clip((y - mu) / sd, -8, 8)
        hazard = _phi(z) / np.maximum(_upper(z), 1e-300)
        e1 = mu + sd * hazard  # mean of a length beyond y
        e2 = sd * sd * (1 + z * hazard - hazard * hazard)  # and its variance
        mu_new = float((w * y + c * e1).sum() / total)
        var = float((w * (y - mu_new) ** 2 + c * (e2 + (e1 - mu_new) ** 2)).sum() / total)
        done = abs(mu_new - mu) < 1e-7
        mu, sd = mu_new, max(1e-3, math.sqrt(max(var, 0)))
        if done:
            break
    return mu, sd


def limits_of(x: np.ndarray, n: np.ndarray, ended: np.ndarray | None = None, least: int = 4, near: int = 25) -> list[tuple[int, int, float, float]]:
    """(limit, texts there, expected there, posterior) for the lengths of one source:
    candidates are lengths with many more texts than their surroundings; the fit and
    the posteriors are repeated until they agree. ``ended`` of the texts of each length
    are known to be complete, so that the others alone can have been cut there."""
    order = np.argsort(x)
    x, n = x[order].astype(float), n[order].astype(float)
    most = 1 - (ended[order] / n if ended is not None else np.zeros_like(n))
    lo, hi = np.searchsorted(x, x - near), np.searchsorted(x, x + near, "right")
    run = np.concatenate([[0], np.cumsum(n)])
    around = (run[hi] - run[lo] - n) / (2 * near)
    cand = (n >= least) & (n > around + 4 * np.sqrt(around + 0.25))
    share = np.where(cand, np.minimum(0.9, most), 0.0)
    expected = np.zeros_like(n)
    for _ in range(10):
        mu, sd = fit_censored(x, n, share)
        z = (np.log(np.maximum(x, 1)) - mu) / sd
        model = n.sum() * _phi(z) / (sd * np.maximum(x, 1))
        expected = np.maximum(np.maximum(model, around), 1e-3)
        new = np.where(cand, np.clip(1 - expected / np.maximum(n, 1e-9), 0, most), 0.0)
        if np.abs(new - share).max(initial=0) < 1e-4:
            break
        share = new
    return [(int(x[i]), int(n[i]), float(expected[i]), float(share[i])) for i in np.nonzero(cand & (share > 0))[0]]


def length_limits(rows: DataFrame, measures: list[str]) -> DataFrame:
    """(source, measure, limit, texts, expected, posterior) over the columns of lengths;
    equal copies of a text (key) count once, and texts of settled forms as complete."""
    long = None
    for m in measures:
        part = rows.filter(F.col(m) > 0).groupBy("source", F.col(m).cast("bigint").alias("x")).agg(F.countDistinct("key").alias("n"), F.countDistinct(F.when(F.col("form").isin("closed", "formula"), F.col("key"))).alias("ended"))
        part = part.select("source", F.lit(m).alias("measure"), "x", "n", "ended")
        long = part if long is None else long.unionByName(part)

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        out = limits_of(p["x"].to_numpy(), p["n"].to_numpy(), p["ended"].to_numpy())
        r = pd.DataFrame(out, columns=["limit", "texts", "expected", "posterior"])
        r.insert(0, "source", p["source"].iloc[0])
        r.insert(1, "measure", p["measure"].iloc[0])
        return r

    return long.groupBy("source", "measure").applyInPandas(
        fit, "source string, measure string, limit bigint, texts bigint, expected double, posterior double"
    )


# --- odds ------------------------------------------------------------------------


def formed(rows: DataFrame, fragments: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """``rows`` with form: blank; closed or formula (complete); inside a word, hanging on a
    function word or dangling (cut); frequent, repeated, fragment or doubtful (open)."""
    rows = rows.join(small(words), "word", "left").join(small(fragments), "fragment", "left")
    whole = F.col("lo").isNotNull() & ((F.col("lo") != F.col("hi")) | (F.col("lo") != F.col("key")))
    ends = F.col("n") > F.col("on")
    # 'Presidente' may stand in closing formulas alone: then the texts before it must
    # differ, and no text may have a longer word that begins with it.
    alone = (F.col("heads") >= least) & ~F.col("part")
    form = (
        F.when(F.col("kind") != "open", F.col("kind"))
        .when(F.col("known") & (whole | ~F.col("named")), "formula")
        .when(F.col("stem").isin(*sorted(HANGING)), "hanging")
        .when(ends & (F.col("n") >= least) & (whole | alone), "frequent")
        .when(~F.coalesce(whole, F.lit(False)), "inside")
        .when(ends, "repeated")
        .otherwise("fragment")
    )
    return rows.withColumn("form", form).drop("lo", "hi", "n", "heads", "on", "part")


def with_posterior(rows: DataFrame) -> DataFrame:
    """``rows`` with the posterior of having been cut at a limit of their source."""
    measures = ("chars", "bytes", "tokens")
    limits = length_limits(rows.filter("kind <> 'blank'"), list(measures)).filter("posterior > 0")
    per = limits.groupBy("source").pivot("measure", list(measures)).agg(F.map_from_entries(F.collect_list(F.struct("limit", "posterior"))))
    per = small(per.select(F.col("source").alias("__s"), *[F.col(m).alias(f"__{m}") for m in measures]))
    at = lambda m: F.coalesce(F.try_element_at(F.col(f"__{m}"), F.col(m).cast("bigint")), F.lit(0.0))
    out = rows.join(per, F.col("source").eqNullSafe(F.col("__s")), "left")
    return out.withColumn("posterior", F.least(F.greatest(*map(at, measures)), F.lit(0.999))).drop("__s", *[f"__{m}" for m in measures])


def form_odds(counts: list[tuple[str, float, float]]) -> tuple[dict[str, float], float, float]:
    """From (form, posterior mass at limits, distinct texts away from them): the log odds
    of each open form, the share of the cut forms among cut texts, and the rate of cuts
    away from the limits. What cuts explain of a form away from the limits follows from
    the function words there: a cut between words leaves so many of them for each other
    word. Only what is more than that by a standard deviation counts as complete."""
    at = {f: USUAL[f] for f in USUAL}
    off = {f: 0.0 for f in USUAL}
    done = 0.0
    for form, mass, texts in counts:
        if form in at:
            at[form] += mass
            off[form] += texts
        elif form != "blank":
            done += texts
    total = sum(at.values())
    anchor = sum(at[f] for f in CUT) / total
    cuts = sum(off[f] for f in CUT) / anchor  # away from the limits
    left = {}
    for f in OPEN:
        expected = max(off["hanging"] * at[f] / at["hanging"], cuts * at[f] / total)
        left[f] = max(0.0, off[f] - expected - math.sqrt(expected + off[f])) + 0.5 * at[f] / total
    complete = done + sum(left.values())
    return {f: math.log(at[f] / total) - math.log(left[f] / max(complete, 1.0)) for f in OPEN}, anchor, cuts / max(cuts + complete, 1.0)


def truncated(
    df: DataFrame, id_col: str, text_col: str, source_col: str, tokens: DataFrame | None = None
) -> DataFrame:
    """(id, source, form, posterior, score, cut, unaided) of every row of ``df``: score
    holds the log odds, infinite for forms that settle the matter; unaided is the
    verdict that the form alone would give, without the lengths.

    ``tokens``: optional (id, tokens), the output tokens of the run that made the text.
    Blank and null texts are never cut. A null source is a source of its own. Repeated
    rows are judged alike. Texts of any length are read whole. An empty table gives
    no rows.
    """
    src = spread(df.select(id_col, text_col, source_col))
    rows = described(src, id_col, text_col, source_col)
    if tokens is not None:
        rows = rows.join(tokens.select(F.col("id"), F.col("tokens").cast("bigint").alias("tokens")).dropDuplicates(["id"]), "id", "left")
    else:
        rows = rows.withColumn("tokens", F.lit(None).cast("bigint"))
    rows = cut(rows)
    rows = cut(with_posterior(formed(rows, *corpus_evidence(src, text_col, rows))))
    texts = rows.groupBy("source", "key").agg(F.min("form").alias("form"), F.max("posterior").alias("posterior"))
    limit = F.col("posterior") >= SURE
    counts = texts.groupBy("form").agg(F.coalesce(F.sum(F.when(limit, F.col("posterior"))), F.lit(0.0)).alias("at"), F.count_if(~limit).cast("double").alias("off"))
    odds, anchor, rate = form_odds([tuple(r) for r in counts.collect()])
    free = texts.filter(~limit & (F.col("form") != "blank"))
    cuts = F.count_if(F.col("form").isin(*CUT)) / anchor
    rates = free.groupBy(F.col("source").alias("__s")).agg(((cuts + rate * SOURCE_ROWS) / (F.count(F.lit(1)) + SOURCE_ROWS)).alias("__rate"))
    logit = lambda p: F.ln(p / (1 - p))
    own = F.least(F.coalesce("__rate", F.lit(rate)), F.lit(0.99)) + 1e-6
    either = 1 - (1 - F.col("posterior")) * (1 - own)
    form = F.create_map(*[F.lit(v) for kv in odds.items() for v in kv])[F.col("form")]
    settled = lambda c: F.when(F.col("form").isin(*CUT), float("inf")).when(form.isNull(), float("-inf")).otherwise(c)
    return rows.join(small(rates), F.col("source").eqNullSafe(F.col("__s")), "left").select(
        "id",
        "source",
        "form",
        "posterior",
        settled(form + logit(either)).alias("score"),
        (settled(form + logit(either)) > 0).alias("cut"),
        (settled(form + logit(own)) > 0).alias("unaided"),
    )


def last_tokens(df: DataFrame, audit: DataFrame) -> DataFrame:
    """(id, tokens): for each dataset row the output tokens of its act's last audited
    run in the same experiment; acts are matched by number and suffix."""
    from scriptoria.operators.relational import act_id

    runs = (
        audit.select(act_id("id_atto").alias("act"), "esperimento", "output_tokens", "registrato_il")
        .filter("act is not null and output_tokens is not null")
        .groupBy("act", "esperimento")
        .agg(F.max_by("output_tokens", F.struct("registrato_il", "output_tokens")).alias("tokens"))
    )
    rows = df.select(F.col("riga_id").alias("id"), act_id("id_atto").alias("act"), "esperimento")
    return rows.join(runs, ["act", "esperimento"]).select("id", "tokens")
