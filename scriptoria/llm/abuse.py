"""Abusive, hateful or sexual content: class-conditional Kneser-Ney language models.

Plan. The two models, toxic and ordinary, are fitted in one task on a bounded sample
of labelled documents (``most`` of either class, by hash order) and broadcast; all
documents then go past them in one narrow pass. Labels hold for documents, but only a
sentence or two of a document is abusive, and labels err. So the fit alternates: the
ordinary model learns the sentences of unlabelled-as-toxic documents, the toxic model
those sentences of toxic documents that the ordinary model finds strange, and after
each round sentences are reassigned by the models' verdict. A document's score is the
highest length-normalised log-likelihood ratio of its sentences. Spellings meant to
hide a word (digits for letters, stars, doubled or spaced letters) are undone first.
"""

from __future__ import annotations

import io
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.common import U, mix
from scriptoria.llm.mixing import source_key
from scriptoria.session import spread

MOST_LABELLED = 2000  # labelled documents of either class that the models are fitted on
DISCOUNT = 0.75
LENGTH_PRIOR = 2.0  # words added to a sentence's length before normalising
PART, PART_MARGIN = 5, 0.8  # see Model.sentence_scores
THRESHOLD = 0.55

TOKEN = re.compile(r"[^\W_]+(?:[@$!*#€+]+[^\W_]+)*")
SENTENCE = re.compile(r"(?<=[.!?])[\"»)]?\s+(?=[^\W\d_a-z]|[«\"(])|\n+")
NAMED = re.compile(r"\b([A-Z])\.\s?([A-Z][\w'’]+)")
SPACED = re.compile(r"(?<!\w)[^\W\d_](?:[ .\-_*·]{1,2}[^\W\d_]){3,}(?!\w)")
DIVIDED = re.compile(r"(?<=[^\W\d_])[-‐‑­¬][ \t]*\n[ \t]*(?=[^\W\d_])")
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "€": "e", "+": "t"})
LONG_RUN = re.compile(r"(.)\1{2,}")

# Expressions known beforehand, a thin prior for the toxic model.
KNOWN = """
coglione|coglioni|stronzo|stronzi|stronza|bastardo|bastardi|merda|pezzo di merda|gente di merda|testa di cazzo|cazzo|vaffanculo|figlio di puttana|puttana|puttane|troia|troie|zoccola|
idiota|idioti|imbecille|imbecilli|cretino|cretini|deficiente|deficienti|buffone|verme|feccia|schifoso|ritardato|mongoloide|ricchione|frocio|froci|negro di merda|sporchi negri|zingari di merda|
ti ammazzo|vi ammazzo|ti spacco la faccia|devi morire|dovete morire|crepa|crepate|andate a morire|ti vengo a prendere|bruciamoli|sono bestie|sono parassiti|esseri subumani|razza inferiore|
scopare|scoperei|scopata|scopate|pompino|pompini|orgia|orge|ammucchiata|porno|video porno|vogliosa|vogliose|leccarti|inculare|culo|tette|cazzo duro|figa|fica|foto nuda|sesso anale|massaggi erotici|sborra|
fuck you|fucking|motherfucker|bastard|bitch|asshole|idiot|moron|whore|slut|scum|kill you|i will kill|nude pics|want to fuck|vermin|subhuman|
connard|connards|ordure|salope|pute|putain|enculé|enculés|fils de pute|va te faire foutre|sales étrangers|je vais te tuer|baiser|
arschloch|arschlöcher|schwein|wichser|hurensohn|fotze|schlampe|ungeziefer|ich bringe dich um|verdammte|ficken|drecksau|missgeburt|
gilipollas|hijo de puta|puta|maricón|cabrón|mierda
"""


def sentences(text: str) -> list[str]:
    """A text's sentences; a word divided at a line's end is whole again, spaced letters
    are a word, and a name with its initial is one sign."""
    text = DIVIDED.sub("", text) if "\n" in text else text
    t = SPACED.sub(lambda m: re.sub(r"[^\w]|_", "", m.group()), text)
    t = NAMED.sub("Nnnn", t)
    return [s for s in SENTENCE.split(t) if s and not s.isspace()]


def fold(w: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))


class Normal:
    """Tokens to word ids, with the disguises undone; unknown words are -1."""

    def __init__(self, vocabulary: dict[str, int], toxic: set[str]):
        self.vocabulary = vocabulary
        self.toxic = toxic
        self.memo: dict[str, int] = {}
        self.one_off: dict[str, str] = {}
        for w in sorted(toxic):
            if len(w) >= 6 and w.isalpha():
                for i in range(len(w)):
                    self.one_off.setdefault(w[:i] + w[i + 1 :], w)

    def spellings(self, token: str) -> Iterator[str]:
        w = fold(token.lower())
        if w.isdigit():
            yield "0"
            return
        yield w
        plain = w.translate(LEET) if not w.isalpha() and any(c.isalpha() for c in w) else w
        yield plain
        if LONG_RUN.search(plain):
            yield LONG_RUN.sub(r"\1\1", plain)
            yield LONG_RUN.sub(r"\1", plain)

    def look(self, token: str) -> int:
        last = ""
        for s in self.spellings(token):
            i = self.vocabulary.get(s)
            if i is not None:
                return i
            last = s
        if re.search(r"[*#]", last):
            pat = re.compile("".join("." if c in "*#" else re.escape(c) for c in last))
            hit = next((w for w in sorted(self.toxic) if len(w) == len(last) and pat.fullmatch(w)), None)
            if hit:
                return self.vocabulary[hit]
        if len(last) >= 6 and last.isalpha():
            for v in (last, *(last[:i] + last[i + 1 :] for i in range(len(last)))):
                hit = self.one_off.get(v) or (v if v in self.toxic else None)
                if hit and abs(len(hit) - len(last)) <= 1:
                    return self.vocabulary[hit]
        return -1

    def ids(self, tokens: list[str]) -> list[int]:
        memo = self.memo
        if len(memo) > 500_000:
            memo.clear()
        out = []
        for t in tokens:
            i = memo.get(t)
            if i is None:
                i = memo[t] = self.look(t)
            out.append(i)
        return out


def surface(token: str) -> str:
    """A labelled token as the vocabulary has it."""
    w = fold(token.lower())
    if w.isdigit():
        return "0"
    if not w.isalpha() and any(c.isalpha() for c in w) and len(w) > 3 and sum(c.isalpha() for c in w) >= len(w) / 2:
        w = w.translate(LEET)
    return LONG_RUN.sub(r"\1", w)


def _key2(v, w):
    return mix((v.astype(np.uint64) << U(32)) | w.astype(np.uint64))


def _key3(u, v, w):
    return mix(_key2(u, v) * U(0x100000001B3) + w.astype(np.uint64))


START = 0


def grams(seqs: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (u, v, w) of id sequences, each with two starts before it."""
    u, v, w = [], [], []
    for s in seqs:
        p = [START, START, *s]
        u += p[:-2]
        v += p[1:-1]
        w += p[2:]
    return np.array(u, np.int64), np.array(v, np.int64), np.array(w, np.int64)


class KneserNey:
    """Interpolated trigram model of one class over a shared lowest order."""

    def __init__(self, seqs: list[list[int]], size: int, shared: np.ndarray, d: float = DISCOUNT):
        u, v, w = grams(seqs)
        tri, first, count = np.unique(_key3(u, v, w), return_index=True, return_counts=True)
        u, v, w = u[first], v[first], w[first]
        self.tri, c = tri, count.astype(float)
        ctx, inv = np.unique(_key2(u, v), return_inverse=True)
        total = np.bincount(inv, weights=c, minlength=len(ctx))
        kinds = np.bincount(inv, minlength=len(ctx))
        self.ctx, self.bow2 = ctx, d * kinds / total
        bi, first2, cont = np.unique(_key2(v, w), return_index=True, return_counts=True)
        bv, bw = v[first2], w[first2]
        tot1 = np.bincount(bv, weights=cont, minlength=size)
        kin1 = np.bincount(bv, minlength=size)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.bow1 = np.where(tot1 > 0, d * kin1 / np.maximum(tot1, 1), 1.0)
        uni = np.bincount(bw, minlength=size).astype(float)
        n = max(uni.sum(), 1.0)
        self.p1 = np.maximum(uni - d, 0) / n + d * np.count_nonzero(uni) / n * shared if uni.any() else shared.copy()
        self.bi = bi
        self.p2 = np.maximum(cont - d, 0) / tot1[bv] + self.bow1[bv] * self.p1[bw]
        low = self.p2[np.searchsorted(bi, _key2(v, w))]
        self.p3 = np.maximum(c - d, 0) / total[inv] + self.bow2[inv] * low
        self.seen = uni > 0

    def log2(self, v, w):
        k = _key2(v, w)
        i = np.minimum(np.searchsorted(self.bi, k), len(self.bi) - 1)
        hit = self.bi[i] == k if len(self.bi) else np.zeros(len(k), bool)
        p = np.where(hit, self.p2[i] if len(self.bi) else 0.0, self.bow1[v] * self.p1[w])
        return np.log(np.maximum(p, 1e-300))

    def log3(self, u, v, w):
        k = _key3(u, v, w)
        i = np.minimum(np.searchsorted(self.tri, k), len(self.tri) - 1)
        hit = self.tri[i] == k
        c = _key2(u, v)
        j = np.minimum(np.searchsorted(self.ctx, c), len(self.ctx) - 1)
        bow = np.where(self.ctx[j] == c, self.bow2[j], 1.0)
        return np.where(hit, np.log(self.p3[i]), np.log(bow) + self.log2(v, w))


class Model:
    """Both models as one table of log-likelihood ratios per n-gram."""

    def __init__(self, toxic: list[list[int]], ordinary: list[list[int]], words: list[str]):
        size = len(words)
        pooled = [*toxic, *ordinary]
        _, v, w = grams(pooled)
        pair = np.unique(_key2(v, w), return_index=True)[1]
        shared = np.bincount(w[pair], minlength=size).astype(float) + 0.5
        shared /= shared.sum()
        t, o = KneserNey(toxic or [[START]], size, shared), KneserNey(ordinary or [[START]], size, shared)
        u, v, w = grams(pooled)
        self.tri, first = np.unique(_key3(u, v, w), return_index=True)
        u, v, w = u[first], v[first], w[first]
        self.llr3 = (t.log3(u, v, w) - o.log3(u, v, w)).astype(np.float32)
        self.ctx, first = np.unique(_key2(u, v), return_index=True)
        at = lambda m: np.where(
            (j := np.minimum(np.searchsorted(m.ctx, self.ctx), len(m.ctx) - 1)) >= 0, np.where(m.ctx[j] == self.ctx, m.bow2[j], 1.0), 1.0
        )
        self.bow2 = np.log(at(t) / at(o)).astype(np.float32)
        self.bi, first = np.unique(_key2(v, w), return_index=True)
        self.llr2 = (t.log2(v[first], w[first]) - o.log2(v[first], w[first])).astype(np.float32)
        self.bow1 = np.log(t.bow1 / o.bow1).astype(np.float32)
        self.llr1 = np.log(t.p1 / o.p1).astype(np.float32)
        self.seen = t.seen.copy()
        self.seen[[i for i, w in enumerate(words) if not w.isalpha()]] = False  # a number is no evidence
        self.words = words

    def ratios(self, ids: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of each word; sentences are parted by two starts, and
        unknown words (-1) say nothing. Only words seen as toxic speak for toxicity."""
        known = np.maximum(ids, 0)
        u, v, w = known[:-2], known[1:-1], known[2:]
        k = _key3(u, v, w)
        i = np.minimum(np.searchsorted(self.tri, k), len(self.tri) - 1)
        out = self.llr3[i].copy()
        miss = np.nonzero(self.tri[i] != k)[0]
        if len(miss):
            u, v, w = u[miss], v[miss], w[miss]
            k = _key2(v, w)
            i = np.minimum(np.searchsorted(self.bi, k), len(self.bi) - 1)
            low = np.where(self.bi[i] == k, self.llr2[i], self.bow1[v] + self.llr1[w])
            c = _key2(u, v)
            j = np.minimum(np.searchsorted(self.ctx, c), len(self.ctx) - 1)
            out[miss] = np.where(self.ctx[j] == c, self.bow2[j], 0.0) + low
        w = ids[2:]
        out = np.where(self.seen[np.maximum(w, 0)], out, np.minimum(out, 0))
        return np.where(w > 0, out, 0.0)

    def sentence_scores(self, seqs: list[list[int]]) -> np.ndarray:
        """Length-normalised ratio of each sentence, or of its most toxic run of PART
        words less PART_MARGIN where that is higher: abuse in part of a long sentence."""
        if not seqs:
            return np.empty(0)
        flat: list[int] = []
        for s in seqs:
            flat += [START, START, *s]
        ids = np.array(flat, np.int64)
        r = np.concatenate([[0.0, 0.0], self.ratios(ids)])
        n = np.array([len(s) for s in seqs])
        ends = np.cumsum(n + 2)
        total = np.concatenate([[0.0], np.cumsum(r)])
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        whole = (total[ends] - total[ends - n]) / (known[ends] - known[ends - n] + LENGTH_PRIOR)
        place = np.arange(len(ids)) - np.repeat(ends - n, n + 2)  # place in the sentence, starts negative
        part = np.full(len(ids), -99.0)
        if len(ids) > PART:
            part[PART - 1 :] = (total[PART:] - total[:-PART]) / (PART + LENGTH_PRIOR)
        part[place < PART - 1] = -99.0
        return np.maximum(whole, np.maximum.reduceat(part, ends - n - 2) - PART_MARGIN)

    def dump(self) -> bytes:
        b = io.BytesIO()
        np.savez_compressed(
            b, words=np.array("\n".join(self.words)), **{k: getattr(self, k) for k in ("tri", "llr3", "ctx", "bow2", "bi", "llr2", "bow1", "llr1", "seen")}
        )
        return b.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Model:
        m = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as z:
            for k in z.files:
                setattr(m, k, z[k])
        m.words = str(m.words).split("\n")
        return m

    def normal(self) -> Normal:
        toxic = {w for w, s, r in zip(self.words, self.seen, self.llr1) if s and r > 1.0}
        return Normal({w: i for i, w in enumerate(self.words) if i}, toxic)


def fit(texts: list[str], labels: list[int], rounds: int = 4) -> Model:
    """Both models from labelled documents; see the module's text."""
    seen: dict[str, str] = {}

    def plain(t: str) -> str:
        w = seen.get(t)
        if w is None:
            w = seen[t] = surface(t)
        return w

    docs = [[[plain(t) for t in TOKEN.findall(s)] for s in sentences(x or "")] for x in texts]
    prior = [[plain(t) for t in TOKEN.findall(p)] for p in re.split(r"[|\n]+", KNOWN) if p.strip()]
    count = Counter(w for d in docs for s in d for w in s)
    lexicon = {w for p in prior for w in p}
    words = ["", *sorted({w for w, c in count.items() if c > 0} | lexicon)]
    at = {w: i for i, w in enumerate(words)}
    docs = [[[at[w] for w in s] for s in d if s] for d in docs]
    prior = [[at[w] for w in p] for p in prior]
    ordinary = [s for d, y in zip(docs, labels) if not y for s in d]
    flagged = [s for d, y in zip(docs, labels) if y for s in d]
    size = len(words)
    # How strange a sentence is to the ordinary documents: the share of its word pairs they lack.
    have = np.unique(_key2(*grams(ordinary)[1:])) if ordinary else np.empty(0, np.uint64)

    long = [s for s in flagged if len(s) >= 3]
    _, v, w = grams(long)
    key = _key2(v, w)
    if len(have):
        lack = have[np.minimum(np.searchsorted(have, key), len(have) - 1)] != key
    else:
        lack = np.ones(len(key), bool)
    of = np.repeat(np.arange(len(long)), [len(s) for s in long])
    strange = np.bincount(of, lack, len(long)) / np.maximum(np.bincount(of, minlength=len(long)), 1)
    toxic = [s for s, x in zip(long, strange) if x >= 0.6]
    model = Model(prior * 2 + toxic * 2, ordinary, words)
    for _ in range(rounds):
        score = model.sentence_scores(flagged)
        toxic = [s for s, x in zip(flagged, score) if x > THRESHOLD]
        score = model.sentence_scores(ordinary)
        kept = [s for s, x in zip(ordinary, score) if x <= THRESHOLD]
        new = Model(prior * 2 + toxic * 2, kept, words)
        same = len(new.tri) == len(model.tri) and np.array_equal(new.llr3, model.llr3)
        model = new
        if same:
            break
    assert len(model.llr1) == size
    return model


def fitted(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, most: int = MOST_LABELLED) -> Model:
    """The model of a bounded sample of labelled documents, fitted in one task."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).filter("y is not null").dropDuplicates(["id"])
    order = F.xxhash64("id")
    sample = known.filter("y = 1").orderBy(order, "id").limit(most).unionByName(known.filter("y = 0").orderBy(order, "id").limit(most))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id").select("text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ys = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            ys += b.column(1).to_pylist()
        pairs = sorted(zip(ys, (t or "" for t in texts)))
        yield pa.RecordBatch.from_arrays([pa.array([fit([t for _, t in pairs], [y for y, _ in pairs]).dump()], pa.binary())], names=["model"])

    got = rows.repartition(1).mapInArrow(run, "model binary").first()
    return Model.load(got[0]) if got else fit([], [])


def scored(docs: DataFrame, doc_id: str, text: str, source: str, model: Model) -> DataFrame:
    """(doc_id, source, score): the highest sentence score of every document; 0 for
    null and empty texts. Sources come in one spelling; nulls stay null."""
    src = spread(docs.select(F.col(doc_id).alias("doc_id"), F.nullif(source_key(F.col(source)), F.lit("")).alias("source"), F.col(text).alias("text")))
    kind = src.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model.dump())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.load(shared.value)
        normal = m.normal()
        for b in batches:
            seqs, of = [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                for s in sentences(t) if t else ():
                    ids = normal.ids(TOKEN.findall(s))
                    if ids:
                        seqs.append(ids)
                        of.append(i)
            best = np.zeros(b.num_rows)
            if seqs:
                np.maximum.at(best, np.array(of), m.sentence_scores(seqs))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best)], names=["doc_id", "source", "score"])

    return src.mapInArrow(run, f"doc_id {kind}, source string, score double")


def abusive(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", label: str = "tossico") -> DataFrame:
    """(doc_id, source, score, tossico) of every document.

    Labels: a sample of documents, 1 toxic and 0 not; null labels are left out and
    repeated ones count once. Without any toxic label the prior expressions alone
    speak. Null and empty texts score 0. Repeated documents are scored one by one.
    """
    model = fitted(docs, labels, doc_id, text, label)
    return scored(docs, doc_id, text, source, model).withColumn("tossico", F.col("score") > F.lit(THRESHOLD))
