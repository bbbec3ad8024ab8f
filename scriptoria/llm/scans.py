"""Noise in text from scanned pages: furniture, divided words, misread characters.

Plan. (1) A narrow pass lays out every text: page-number lines, running headers and
footers, body. Line pairs of a text that look alike are judged by boosted trees, whose
features say whether a line interrupts a sentence, how often such lines do so in the
whole collection (a table of fixed size), and how many of them there are to a page.
(2) Word counts over the collection and a clean one give the vocabulary. Tokens it
lacks meet vocabulary words in an inverted join on character q-grams; each token
brings only its rarest q-grams, as many as two edits can destroy and one more, so no
word within two edits is missed and no common q-gram blows the join up. Boosted trees,
trained on words misread on purpose, rank the candidates and accept or leave the
token. (3) The two halves of a line end are judged by a third set of trees from the
counts of halves, joined word and compound. Accepted replacements and joins rebuild
the paragraphs.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.llm.boost import Boosted
from scriptoria.llm.common import small
from scriptoria.llm.near import components, near_groups
from scriptoria.operators.relational import act_id
from scriptoria.session import cut, spread

SAMPLE_TEXTS = 1500  # texts the furniture trees are trained on
SAMPLE_WORDS = 1500  # words misread on purpose to train the ranking
INDEX_WORDS = 20_000  # commonest words that those training candidates come from
KEYS = 1 << 14  # hashed line beginnings
FEATURES = 19  # of a line pair
Q = 2
GRAMS = 2 * Q + 1  # two edits destroy at most 2 q of a word's q-grams
KNOWN = 3  # a word seen so often in the clean texts is a word

# Readings that scanners confuse, each way.
CONFUSIONS = tuple(
    tuple(x.split("/"))
    for x in "rn/m ri/n ii/u li/h cl/d vv/w 0/o 1/l 1/i !/i |/l |/i 5/s 6/b 9/g q/g @/a c/e f/t 8/b 2/z u/ii h/b n/u ni/m in/m jo/p ci/a".split()
) + (("\\/", "v"),)
DIGIT_LOOKS = str.maketrans({"O": "0", "o": "0", "l": "1", "I": "1", "i": "1", "|": "1", "!": "1", "Z": "2", "z": "2", "S": "5", "s": "5", "B": "8", "b": "6", "g": "9", "q": "9", "A": "4", "@": "4", "D": "0", "Q": "0"})
HYPHENS = "-‐‑­¬"
EDGE = ".,;:()\"«»“”„…?[]{}<>*'’‘`"
NUM = r"[0-9OolIZSB!|]{1,3}"
ROMAN = re.compile(r"[ivxl]{1,6}|[IVXL]{1,6}")
PAGE_DRESS = re.compile(
    rf"[\W_]*(?:(?:p[a@4à]g(?:[i1!l|í]n[a@4])?|p|pg|f|fg|foglio|facciata|page)\s*[.:]?\s*(?:n\s*[.°]?\s*)?{NUM}(?:\s*(?:di|d1|dl|/|su|of|\\|-)\s*{NUM})?|{NUM}\s*(?:/|di|su)\s*{NUM})[\W_]*", re.I
)
PAGE_MARKED = re.compile(rf"\s*(?:[-–—~•*=|.·_]+\s*({NUM}|[ivxlIVXL]{{1,6}})\s*[-–—~•*=|.·_]+|[\[(<{{]\s*({NUM}|[ivxl]{{1,6}})\s*[\])>}}])\s*")
BARE = re.compile(r"\s*([0-9]{1,4})\s*")
TABLE = re.compile(r"\s*(?:(?:cap|art|artt|capitolo|articolo|all|tab|eur|euro|€|n|mapp|fg)\b\.?\s*)?[\d.,/]+\s*(?:€|eur|euro)?\s*", re.I)
PAGE_TAIL = re.compile(rf"[\s\-–—|]*(?:\b(?:p[a@]g(?:ina)?|p)\s*\.?\s*|(?<![^\s\-–—|])){NUM}(?:\s*(?:di|d1|dl|/|su)\s*{NUM})?\s*$", re.I)
ENDS = re.compile(r"[.!?:;]['\"»”)]*\s*$")


def _roman(s: str) -> int:
    v = {"i": 1, "v": 5, "x": 10, "l": 50}
    n = [v[c] for c in s.lower()]
    return sum(-a if a < b else a for a, b in zip(n, [*n[1:], 0]))


def masked(line: str) -> str:
    """A line without what differs from page to page: its page number and digits."""
    return re.sub(r"\d+", "9", PAGE_TAIL.sub("", line.strip().lower()) or line.strip().lower())


def line_key(line: str) -> int:
    """Hash slot of a line's first word, digits masked."""
    return xxhash.xxh3_64_intdigest("".join(masked(line).split()[:1])) % KEYS


def page_numbers(lines: list[str], pages: int) -> set[int]:
    """Lines with nothing but the page's number: dressed ones by their form; bare ones
    where they count up by one from page to page and stand in no column of figures."""
    out = {i for i, s in enumerate(lines) if PAGE_DRESS.fullmatch(s) or PAGE_MARKED.fullmatch(s)}
    filled = [i for i, s in enumerate(lines) if s.strip()]

    def column(i: int) -> bool:
        near = [j for j in (i - 1, i + 1) if 0 <= j < len(lines) and lines[j].strip()]
        return any(TABLE.fullmatch(lines[j]) and j not in out for j in near)

    for pat, value in ((BARE, int), (ROMAN, _roman)):
        cand = [(i, value(m.group(m.lastindex or 0))) for i in filled if (m := pat.fullmatch(lines[i].strip())) and i not in out and not column(i)]
        best: list[int] = []
        chains: dict[int, list[int]] = {}
        for i, v in cand:
            c = [*chains.get(v - 1, []), i]
            if len(c) > len(chains.get(v, [])):
                chains[v] = c
            if len(chains[v]) > len(best):
                best = chains[v]
        if len(best) >= max(2, pages - 1):
            out.update(best)
        elif pages <= 2 and best and not out and filled and best[0] in (filled[0], filled[-1]):
            v = dict(cand)[best[0]]
            if v < 100:
                out.add(best[0])
    return out


def breaks(lines: list[str], skip: set[int]) -> list[bool]:
    """For each line: does the body around it run on, as if it were not there?"""
    n = len(lines)
    body = [
        i not in skip and bool(s.strip()) and (s.rstrip().endswith(".") or (not TABLE.fullmatch(s) and (len(s.split()) > 3 or s.strip()[:1].islower())))
        for i, s in enumerate(lines)
    ]
    before, last = [None] * n, None
    for i in range(n):
        before[i] = last
        if body[i]:
            last = i
    after, last = [None] * n, None
    for i in range(n - 1, -1, -1):
        after[i] = last
        if body[i]:
            last = i
    return [
        before[i] is not None and after[i] is not None and not ENDS.search(lines[before[i]]) and (lines[after[i]].strip()[:1].islower() or lines[after[i]].strip()[:1].isdigit() or not ENDS.search(lines[before[i]]))
        for i in range(n)
    ]


def alike_lines(lines: list[str], skip: set[int]) -> dict[int, tuple[list[int], float]]:
    """Lines with look-alikes elsewhere in the text: line -> (others, best likeness).
    Alike are lines that, page numbers gone, have the same figures but for one sign and
    the same letters but for misreadings; two or more words each, two in five of them
    in common. Lines of any length count."""
    same = defaultdict(list)
    for i, s in enumerate(lines):
        if i not in skip and any(c.isalpha() for c in s) and not TABLE.fullmatch(s):
            f = " ".join(PAGE_TAIL.sub("", s.strip().lower()).split())
            if " " in f:
                same[f].append(i)
    forms = list(same)
    bag = [frozenset(f.split()) for f in forms]
    figures = ["".join(c for c in f if c.isdigit()) for f in forms]
    count = Counter(x for w in bag for x in w)
    # Lines that share two in five of their words share, in any one order, one of the
    # first of either that are left when so many are taken away: rarest first.
    lead = [sorted(w, key=lambda x: (count[x], x))[: len(w) - -(-2 * len(w) // 5) + 1] for w in bag]
    where = defaultdict(list)
    for a, w in enumerate(lead):
        for x in w:
            where[x].append(a)
    near: dict[int, list[tuple[int, float]]] = defaultdict(list)
    for a, f in enumerate(forms):
        for b in sorted({b for x in lead[a] if count[x] > 1 for b in where[x] if b > a}):
            most = max(2, max(len(f), len(forms[b])) // 10)
            if abs(len(f) - len(forms[b])) > most or len(bag[a] & bag[b]) < 0.4 * max(len(bag[a]), len(bag[b])) or edits(figures[a], figures[b], 1) > 1:
                continue
            d = edits(f, forms[b], most)
            if d <= max(2, min(len(f), len(forms[b])) // 10):
                r = 1 - d / max(len(f), len(forms[b]))
                near[a].append((b, r))
                near[b].append((a, r))
    out: dict[int, tuple[list[int], float]] = {}
    for a, f in enumerate(forms):
        group = [*same[f], *(i for b, _ in near[a] for i in same[forms[b]])]
        top = 1.0 if len(same[f]) > 1 else max((r for _, r in near[a]), default=0.0)
        if top:
            for i in same[f]:
                out[i] = ([j for j in group if j != i], top)
    return out


RATE, GAP = 3, 1  # places of the rate and of the gap among a pair's features


def pair_features(lines: list[str], pages: int, skip: set[int]) -> tuple[list[int], list[int], np.ndarray]:
    """The lines that have look-alikes, their kinds (line_key), and what the trees know of
    each such pair; the rate at which its kind interrupts sentences is filled in later."""
    like = alike_lines(lines, skip)
    gap = breaks(lines, skip | set(like))
    n = max(1, len(lines))
    rows, at = [], sorted(like)
    for i in at:
        others, top = like[i]
        s = lines[i].strip()
        j = min(others, key=lambda x: abs(x - i))
        group = [i, *others]
        rows.append(
            (
                top,
                float(gap[i]),
                sum(gap[x] for x in group) / len(group),
                0.0,
                len(group) / max(1, pages),
                abs(i - j) / n,
                abs(i - j) / n * max(1, pages),
                len(s),
                len(s.split()),
                float(bool(ENDS.search(s))),
                sum(c.isupper() for c in s) / len(s),
                float(i == 0 or not lines[i - 1].strip() or i - 1 in skip),
                float(i == len(lines) - 1 or not lines[i + 1].strip() or i + 1 in skip),
                float(any(x in skip for x in (i - 2, i - 1, i + 1, i + 2))),
                float(any(c.isdigit() for c in s)),
                float(pages),
                float(s[:1].islower()),
                float(i > 0 and bool(lines[i - 1].strip()) and i - 1 not in skip and not ENDS.search(lines[i - 1])),
                float(i + 1 < len(lines) and lines[i + 1].strip()[:1].islower()),
            )
        )
    return at, [line_key(lines[i]) for i in at], np.array(rows, float).reshape(len(rows), FEATURES)


def _split(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def paired_lines(txt: DataFrame) -> DataFrame:
    """(txt_id, num_pagine, txt, numbers, at, key, x) of every text: its page-number lines,
    and the lines with look-alikes, their kinds and the features of the pairs in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers, at, key, x = [], [], [], []
            for pages, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                lines = _split(t)
                skip = page_numbers(lines, pages or 1)
                i, k, f = pair_features(lines, pages or 1, skip)
                numbers.append(sorted(skip))
                at.append(i)
                key.append(k)
                x.append(f.ravel())
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(numbers, ints), pa.array(at, ints), pa.array(key, ints), pa.array(x, pa.list_(pa.float64()))], names=["txt_id", "num_pagine", "txt", "numbers", "at", "key", "x"]
            )

    src = txt.select(F.col("txt_id").cast("bigint").alias("txt_id"), F.col("num_pagine").cast("int").alias("num_pagine"), "txt")
    return src.mapInArrow(run, "txt_id bigint, num_pagine int, txt string, numbers array<int>, at array<int>, key array<int>, x array<double>")


def break_rates(paired: DataFrame) -> np.ndarray:
    """How often lines with a given beginning interrupt a sentence, over all texts:
    a table of KEYS shares, shrunk towards 0.1."""
    each = paired.select(F.posexplode("key").alias("i", "k"), "x")
    each = each.select("k", F.element_at("x", F.col("i") * FEATURES + GAP + 1).alias("gap"))
    got = each.groupBy("k").agg(F.sum("gap").alias("hit"), F.count(F.lit(1)).alias("n")).toArrow()  # KEYS rows at most
    out = np.full(KEYS, 0.1)
    out[got.column("k").to_numpy()] = (got.column("hit").to_numpy() + 0.2) / (got.column("n").to_numpy() + 2.0)
    return out


def _rated(key, x, rates: np.ndarray) -> np.ndarray:
    m = np.array(x, float).reshape(-1, FEATURES)
    m[:, RATE] = rates[np.asarray(key, int)]
    return m


def sure_pairs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(running lines, body lines) among the pairs that need no judgement: alike lines
    that interrupt sentences where lines of their kind commonly do, one to a page or to
    every second one; alike lines of a kind that never does, that end a sentence, or
    that the text flows into and out of."""
    inside = (x[:, 17] == 1) & (x[:, 18] == 1) & ((x[:, 16] == 1) | (x[:, 4] < 0.38))
    sure = (x[:, 3] > 0.3) & (x[:, 2] > 0) & (x[:, 9] == 0) & (x[:, 4] >= 0.38) & ~inside
    return sure, (x[:, 3] < 0.1) | (x[:, 9] == 1) | inside


def furniture_trees(paired: DataFrame, rates: np.ndarray, most: int = SAMPLE_TEXTS) -> Boosted | None:
    """Trees for running lines, taught by the sure pairs of a bounded sample of texts.
    None where these are all of one kind: then the sure pairs alone decide."""
    sample = paired.filter("num_pagine > 1").select("txt_id", "key", "x").orderBy(F.xxhash64("txt_id"), "txt_id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs = [_rated(k, x, rates) for b in batches for k, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        x = np.concatenate(xs) if xs else np.empty((0, FEATURES))
        sure, never = sure_pairs(x)
        keep = sure | never
        if sure[keep].any() and not sure[keep].all():
            yield pa.RecordBatch.from_arrays([pa.array([Boosted(40).fit(x[keep], sure[keep]).dump()], pa.binary())], names=["m"])

    got = sample.repartition(1).mapInArrow(run, "m binary").collect()
    return Boosted.load(got[0][0]) if got else None


def layout(lines: list[str], numbers: set[int], at: list[int], x: np.ndarray, trees: Boosted | None) -> list[str]:
    """Kind of each line: vuota, numero_pagina, intestazione or corpo."""
    p = trees.predict(x) if trees is not None else sure_pairs(x)[0]
    running = {i for i, q in zip(at, p) if q > 0.5}
    return [
        "numero_pagina" if i in numbers else "intestazione" if i in running else "corpo" if s.strip() else "vuota" for i, s in enumerate(lines)
    ]


# --- tokens ----------------------------------------------------------------------


def misread_number(t: str) -> bool:
    """A figure with a letter in it: most of it digits, and figures alone once letters
    that look like digits are read as such. Codes in capitals are none."""
    digits, letters = sum(c.isdigit() for c in t), sum(c.isalpha() or c in "!|@" for c in t)
    if len(t) == 2:
        return re.fullmatch(r"[0-9][lIO|!ZSB]|[lIO|!ZSB][0-9]", t) is not None
    if not digits or not letters or len(t) < 3 or (len(t) >= 8 and t.isalnum() and t.isupper() and letters > 1):
        return False
    plain = t.translate(DIGIT_LOOKS)
    if re.fullmatch(r"\d+(?:[.,/:-]\d+)*", plain):
        return digits >= letters and not re.fullmatch(r"\d+[aº°]?", t)
    return digits > letters and letters <= 2 and len(t) >= 4 and re.fullmatch(r"[\d.,/]*[a-z@!|]{1,2}[\d.,/]+", t) is not None and digits >= 3


def parts_of(token: str) -> list[str]:
    """The words of a white-space token, outer punctuation gone, inner noise kept."""
    t = token.strip(EDGE)
    return [x for x in (y.strip(EDGE) for y in re.split(r"['’‘\-‐–—]|(?<!\\)/", t)) if x]


def wordlike(part: str) -> bool:
    return any(c.isalpha() for c in part) and not (len(part) >= 6 and part.isalnum() and part.isupper() and any(c.isdigit() for c in part) and sum(c.isdigit() for c in part) > 1)


def laid_out(paired: DataFrame, rates: np.ndarray, trees: Boosted | None) -> DataFrame:
    """(txt_id, num_linea, kind, line, words, number, left, right, hyphen): every line,
    the words to look up (lower case), whether a figure on it is misread, and the two
    halves at its end with the sign between them ('' for none)."""
    model = trees.dump() if trees is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Boosted.load(model) if model else None
        for b in batches:
            ids, no, kind, text, words, number, left, right, hyphen = ([] for _ in range(9))
            for i, t, numbers, at, key, x in zip(*(c.to_pylist() for c in b.columns)):
                lines = _split(t)
                kinds = layout(lines, set(numbers), at, _rated(key, x, rates), m)
                body = [k for k, x in enumerate(kinds) if x == "corpo"]
                follow = dict(zip(body, body[1:]))
                taken = False
                for k, (s, x) in enumerate(zip(lines, kinds)):
                    w, wrong, lt, rt, hy = [], False, None, None, None
                    if x == "corpo":
                        tokens = s.split()
                        nxt = lines[follow[k]].split() if k in follow else []
                        head = tokens[1:] if taken else tokens
                        taken = False
                        if tokens and nxt:
                            last, first = tokens[-1], nxt[0]
                            sign = last[-1] if last[-1] in HYPHENS and len(last) > 1 else ""
                            a = re.split(r"['’‘/(\"«]", last[: len(last) - len(sign)])[-1]
                            c = re.split(r"['’‘/]", first.rstrip(EDGE))[0].lstrip("(\"«")
                            if a and c and a[-1].isalnum() and c[0].islower() and (sign or (a.isalpha() and c.isalpha())):
                                lt, rt, hy = a.lower(), c.lower(), sign
                                if sign:
                                    head, taken = head[:-1], True
                                    w += [p.lower() for p in parts_of(last)[:-1] if wordlike(p)]
                        for tok in head:
                            bare = tok.strip(EDGE)
                            if misread_number(bare):
                                wrong = True
                                continue
                            w += [p.lower() for p in parts_of(tok) if wordlike(p)]
                    ids.append(i)
                    no.append(k + 1)
                    kind.append(x)
                    text.append(s)
                    words.append(w)
                    number.append(wrong)
                    left.append(lt)
                    right.append(rt)
                    hyphen.append(hy)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(no, pa.int32()), pa.array(kind), pa.array(text, pa.string()), pa.array(words, pa.list_(pa.string())),
                    pa.array(number, pa.bool_()), pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(hyphen, pa.string()),
                ],
                names=["txt_id", "num_linea", "kind", "line", "words", "number", "left", "right", "hyphen"],
            )

    return paired.select("txt_id", "txt", "numbers", "at", "key", "x").mapInArrow(
        run, "txt_id bigint, num_linea int, kind string, line string, words array<string>, number boolean, left string, right string, hyphen string"
    )


COMMON = 0.02  # a word in this share of the distinct scans, and in three at least, is a word too
COMMONER = 5  # times as common as a scanned word is the clean word that it is taken for a misreading of


def distinct_scans(txt: DataFrame, act: bool) -> DataFrame:
    """(txt_id, scan): texts that are near copies, or of one act, are one scan."""
    rows = txt.select(F.col("txt_id").cast("bigint").alias("txt_id"), "txt", (act_id("id_atto") if act else F.lit(None).cast("string")).alias("act"))
    near = near_groups(rows, "txt_id", "txt", 3, 0.6).select(F.col("id").alias("txt_id"), F.col("group").alias("key"))
    rows = rows.select("txt_id", "act").join(near, "txt_id", "left")
    rows = cut(rows.select("txt_id", "act", F.coalesce("key", F.xxhash64(F.lit("txt"), "txt_id")).alias("key")))
    acts = rows.filter("act is not null").select(F.col("key").alias("a"), F.xxhash64(F.lit("act"), "act").alias("b")).distinct()
    group = components(rows.select("key").distinct(), acts)
    return cut(rows.join(group, "key").select("txt_id", F.col("group").alias("scan")))


def confused(word: str) -> set[str]:
    """All that one known confusion makes of a word."""
    both = [(a, b) for x, y in CONFUSIONS for a, b in ((x, y), (y, x))]
    return {word[:i] + b + word[i + len(a) :] for a, b in both for i in range(len(word)) if word.startswith(a, i)} - {word}


def _readings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        yield pd.DataFrame([(w, n, c) for w, n in zip(p["w"], p["n"]) for c in sorted(confused(w))], columns=["w", "n", "c"])


def vocabulary(clean: DataFrame, text_col: str, body: DataFrame, txt: DataFrame) -> DataFrame:
    """(w, n): words of the clean texts with their counts, and the words that stand in
    so many distinct scans of ``txt`` (txt_id, txt, perhaps id_atto) that they cannot be
    misreadings, unless they are one confusion away from a clean word that is much
    commoner. Scans are told apart among the texts of words that hang on it alone."""
    w = F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"(?U)(\p{L}+)"), 1)).alias("w")
    known = cut(clean.filter(F.col(text_col).isNotNull()).select(w).groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    sure = known.filter(F.col("n") >= KNOWN)
    act = "id_atto" in txt.columns
    own = F.coalesce(act_id("id_atto"), F.sha2("txt", 256)) if act else F.sha2("txt", 256)
    least = max(KNOWN, int(COMMON * txt.filter("txt is not null").select(own.alias("own")).distinct().count()))
    each = body.select("txt_id", F.explode("words").alias("w")).filter(F.col("w").rlike(r"(?U)^\p{L}+$")).groupBy("w", "txt_id").agg(F.count(F.lit(1)).alias("c"))
    mine = cut(each.groupBy("w").agg(F.count(F.lit(1)).alias("df"), F.sum("c").alias("n")))
    often = mine.filter(F.col("df") >= least)
    strange = cut(often.join(sure, "w", "left_anti").select("w", "n"))
    often = often.join(sure, "w", "left_semi").select("w", "n")
    if not strange.isEmpty():
        held = cut(each.join(small(strange.select("w")), "w", "left_semi"))
        scans = distinct_scans(txt.join(held.select("txt_id").distinct(), "txt_id", "left_semi"), act)
        wide = held.join(scans, "txt_id").groupBy("w").agg(F.countDistinct("scan").alias("df")).filter(F.col("df") >= least)
        total = sure.join(mine.select("w", F.col("n").alias("m")), "w", "left").select(F.col("w").alias("c"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("nc"))
        taken = strange.mapInPandas(_readings, "w string, n bigint, c string").join(total, "c").filter(F.col("nc") >= COMMONER * F.col("n")).select("w").distinct()
        often = often.unionByName(strange.join(wide, "w", "left_semi").join(taken, "w", "left_anti"))
    return known.unionByName(often).groupBy("w").agg(F.sum("n").alias("n"))


# --- replacements ----------------------------------------------------------------


def _costs() -> dict[tuple[str, str], float]:
    c = {}
    for a, b in CONFUSIONS:
        c[a, b] = c[b, a] = 0.3
    return c


COSTS = _costs()


def reading_distance(a: str, b: str) -> float:
    """Edit distance where a confusion costs 0.3 and any other edit 1."""
    n, m = len(a), len(b)
    rows = [[float(j) for j in range(m + 1)]]
    for i in range(1, n + 1):
        up, row, x = rows[-1], [float(i)], a[i - 1]
        for j in range(1, m + 1):
            y = b[j - 1]
            best = min(up[j] + 1, row[-1] + 1, up[j - 1] + (0.0 if x == y else COSTS.get((x, y), 1.0)))
            if j > 1 and (k := COSTS.get((x, b[j - 2 : j]))) is not None:
                best = min(best, up[j - 2] + k)
            if i > 1 and (k := COSTS.get((a[i - 2 : i], y))) is not None:
                best = min(best, rows[-2][j - 1] + k)
            row.append(best)
        rows.append(row)
    return rows[n][m]


def edits(a: str, b: str, most: int = 3) -> int:
    """Levenshtein distance, ``most`` + 1 where it is more; a column of the table at a
    time, its steps up and down as the bits of two numbers."""
    if a == b:
        return 0
    n = len(a)
    if abs(n - len(b)) > most:
        return most + 1
    if not n or not b:
        return max(n, len(b))
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top, d = (1 << n) - 1, 1 << (n - 1), n
    up, down = full, 0
    for j, c in enumerate(b, 1):
        same = where.get(c, 0)
        flat = same | down
        cross = (((same & up) + up) ^ up) | same
        right, left = down | (full & ~(cross | up)), up & cross
        if right & top:
            d += 1
        elif left & top:
            d -= 1
        if d - (len(b) - j) > most:
            return most + 1
        right = (right << 1 | 1) & full
        left = left << 1 & full
        up, down = left | (full & ~(flat | right)), right & flat
    return min(d, most + 1)


def grams_of(w: str, q: int = Q) -> list[str]:
    p = "^" * (q - 1) + w + "$" * (q - 1)
    return sorted({p[i : i + q] for i in range(len(p) - q + 1)})


def rank_features(token: str, n_token: float, cands: list[tuple[str, float]]) -> np.ndarray:
    """What the ranking knows of each candidate of a token."""
    ga = set(grams_of(token))
    dist = [reading_distance(token, c) for c, _ in cands]
    best = sorted(dist)
    rows = []
    for (c, n), r in zip(cands, dist):
        gb = set(grams_of(c))
        other = next((x for x in best if x > r), r + 3) if r == best[0] and best.count(r) == 1 else best[0]
        rows.append(
            (
                r, edits(token, c), len(token), len(c) - len(token), np.log1p(n), np.log1p(n_token), np.log1p(n) - np.log1p(n_token),
                float(not token.isalpha()), float(token[0] == c[0]), float(token[-1] == c[-1]), 2 * len(ga & gb) / (len(ga) + len(gb)), other - r, r / max(1, len(c)),
            )
        )
    return np.array(rows, float).reshape(len(rows), 13)


def misread(word: str, rng: np.random.Generator) -> str:
    """The word with one reading changed: mostly a known confusion, now and then any."""
    out = word
    for _ in range(1 if rng.random() < 0.85 else 2):
        here = [(i, a, b) for a0, b0 in CONFUSIONS for a, b in ((a0, b0), (b0, a0)) for i in range(len(out)) if out.startswith(a, i)]
        if here and rng.random() < 0.85:
            i, a, b = here[rng.integers(len(here))]
            out = out[:i] + b + out[i + len(a) :]
        else:
            i = int(rng.integers(len(out)))
            out = out[:i] + "aceilnorstu1!|@0rn"[rng.integers(18)] + out[i + 1 :]
    return out


def ranking_trees(vocab: DataFrame, most: int = SAMPLE_WORDS, index: int = INDEX_WORDS) -> Boosted | None:
    """Trees that accept a candidate, trained on words misread on purpose against rare
    words that are right as they stand. None where the vocabulary is too small."""
    top = vocab.filter((F.length("w") >= 2) & (F.col("n") >= KNOWN)).orderBy(F.desc("n"), "w").limit(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = {w: n for b in batches for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
        if len(count) < 50:
            return
        rng = np.random.default_rng(7)
        where = defaultdict(list)
        for w in sorted(count):
            for g in grams_of(w):
                where[g].append(w)

        def candidates(t: str, without: str | None = None) -> list[tuple[str, float]]:
            gs = sorted(grams_of(t), key=lambda g: (len(where.get(g, ())), g))[:GRAMS]
            got = {c for g in gs for c in where.get(g, ()) if c != without and c != t and abs(len(c) - len(t)) <= 2}
            return [(c, count[c]) for c in sorted(got) if edits(t, c) <= 3]

        ws = sorted((w for w in count if len(w) >= 3), key=lambda w: xxhash.xxh3_64_intdigest(w))
        xs, ys = [], []
        for w in ws[:most]:
            t = misread(w, rng)
            if t in count or t == w:
                continue
            c = candidates(t)
            if c:
                xs.append(rank_features(t, 0, c))
                ys += [x == w for x, _ in c]
            c = candidates(w, w)  # the word itself, as if the vocabulary lacked it
            if c:
                xs.append(rank_features(w, min(2, count[w]), c))
                ys += [False] * len(c)
        if ys:
            yield pa.RecordBatch.from_arrays([pa.array([Boosted(80, 4, 0.2).fit(np.concatenate(xs), np.array(ys)).dump()], pa.binary())], names=["m"])

    got = top.repartition(1).mapInArrow(run, "m binary").collect()
    return Boosted.load(got[0][0]) if got else None


def replacements(unknown: DataFrame, vocab: DataFrame, trees: Boosted | None) -> DataFrame:
    """(t, w): the accepted reading of each unknown token (t, n).

    Candidates come from the inverted join on q-grams: of a token only its GRAMS rarest
    by their number of words, of the vocabulary all.
    """
    words = vocab.filter(F.col("n") >= KNOWN)
    pad = lambda c: F.concat(F.lit("^" * (Q - 1)), F.col(c), F.lit("$" * (Q - 1)))
    cut_up = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(pad(c)) - Q + 1), lambda i: F.substring(pad(c), i, Q)))
    inverted = cut(words.select("w", "n", F.length("w").alias("lw"), F.explode(cut_up("w")).alias("g")))
    df = inverted.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    mine = unknown.select("t", F.col("n").alias("nt"), F.explode(cut_up("t")).alias("g")).join(df, "g", "left")
    few = mine.withColumn("r", F.row_number().over(Window.partitionBy("t").orderBy(F.coalesce("df", F.lit(0)), "g"))).filter(F.col("r") <= GRAMS)
    pairs = (
        few.filter("df is not null")
        .join(inverted, "g")
        .filter((F.abs(F.col("lw") - F.length("t")) <= 2) & (F.col("t") != F.col("w")))
        .groupBy("t", "w")
        .agg(F.max("nt").alias("nt"), F.max("n").alias("n"))
        .filter(F.levenshtein("t", "w", 3) >= 0)
    )
    if trees is None:
        return pairs.select("t", "w").limit(0)
    model = trees.dump()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Boosted.load(model)
        for p in batches:
            out = []
            for t, nt, cands in zip(p["t"], p["nt"], p["cands"]):
                c = sorted((x["w"], float(x["n"])) for x in cands)
                score = m.predict(rank_features(t, float(nt), c))
                k = int(score.argmax())
                if score[k] > 0.5 and reading_distance(t, c[k][0]) <= min(1.2, 0.4 * len(t)):
                    out.append((t, c[k][0], float(score[k])))
            yield pd.DataFrame(out, columns=["t", "w", "score"])

    # Few bytes and much work: as many parts as cores, whatever their size.
    pairs = pairs.repartition(2 * pairs.sparkSession.sparkContext.defaultParallelism, "t")
    grouped = pairs.groupBy("t").agg(F.max("nt").alias("nt"), F.collect_list(F.struct("w", "n")).alias("cands"))
    return grouped.mapInPandas(run, "t string, w string, score double")


# --- line ends -------------------------------------------------------------------


def joins(lines: DataFrame, vocab: DataFrame, compounds: DataFrame) -> DataFrame:
    """(txt_id, num_linea, left, right, hyphen, divided): is the word at a line's end
    divided there? Counts of the halves, of the joined word and of the compound with
    its hyphen, looked up by three joins, go to the trees."""
    ends = lines.filter("left is not null").select("txt_id", "num_linea", "left", "right", "hyphen")
    look = lambda d, key, name: d.join(vocab.select(F.col("w").alias(key), F.col("n").alias(name)), key, "left")
    x = ends.withColumn("whole", F.concat("left", "right")).withColumn("compound", F.concat_ws("-", "left", "right"))
    x = look(look(look(x, "left", "nl"), "right", "nr"), "whole", "nw")
    x = x.join(compounds, "compound", "left").fillna(0, ["nl", "nr", "nw", "nc"])
    x = cut(x)
    feats = ["nl", "nr", "nw", "nc"]

    def matrix(p: pd.DataFrame) -> np.ndarray:
        c = np.log1p(p[feats].to_numpy(float))
        soft = p["hyphen"].isin(["‐", "­", "¬", "\\"]).to_numpy(float)
        return np.column_stack([c, c[:, 2] - np.maximum(c[:, 0], c[:, 1]), c[:, 2] - np.minimum(c[:, 0], c[:, 1]), (p["hyphen"] != "").to_numpy(float), soft, p["left"].str.len(), p["right"].str.len()])

    def sure(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        signed = (p["hyphen"] != "").to_numpy()
        yes = ((p["nw"] >= KNOWN) & ((p["nl"] < KNOWN) | (p["nr"] < KNOWN))).to_numpy() | (signed & (p["nw"] >= KNOWN).to_numpy())
        no = ((p["nw"] == 0) & (p["nl"] >= KNOWN) & (p["nr"] >= KNOWN)).to_numpy() | (~signed & (p["nw"] < KNOWN).to_numpy()) | ((p["nc"] > 0) & (p["nw"] == 0)).to_numpy()
        return yes & ~no, no

    sample = x.orderBy(F.xxhash64("txt_id", "num_linea")).limit(20 * SAMPLE_TEXTS)

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            p = pd.concat(parts)
            yes, no = sure(p)
            keep = yes | no
            if yes.any() and no.any():
                yield pd.DataFrame({"m": [Boosted(40).fit(matrix(p)[keep], yes[keep]).dump()]})

    got = sample.repartition(1).mapInPandas(train, "m binary").collect()
    model = bytes(got[0][0]) if got else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Boosted.load(model) if model else None
        for p in batches:
            p = p[["txt_id", "num_linea", "left", "right", "hyphen", *feats]]
            yes, _ = sure(p)
            p = p.assign(divided=m.predict(matrix(p)) > 0.5 if m is not None else yes)
            yield p[["txt_id", "num_linea", "left", "right", "hyphen", "divided"]]

    return x.select("txt_id", "num_linea", "left", "right", "hyphen", *feats).mapInPandas(
        run, "txt_id bigint, num_linea int, left string, right string, hyphen string, divided boolean"
    )


class Repaired:
    """Everything found in a table of scanned texts (txt_id, num_pagine, txt), with a
    table of clean texts to take words from.

    Null and blank texts have no lines. A null or zero page count counts as one page.
    Repeated texts are worked on one by one; their txt_id must differ. An id_atto, where
    there is one, says which texts are of one act. Other columns are not read. Without clean texts the words common to the scanned ones are the
    vocabulary.
    """

    def __init__(self, txt: DataFrame, clean: DataFrame, clean_text: str):
        src = spread(txt.select("txt_id", "num_pagine", "txt"))
        paired = cut(paired_lines(src))
        rates = break_rates(paired)
        self.lines = cut(laid_out(paired, rates, furniture_trees(paired, rates)))
        body = self.lines.filter("kind = 'corpo'")
        self.vocab = cut(vocabulary(clean, clean_text, body, txt))
        compound = F.explode(F.regexp_extract_all(F.lower("line"), F.lit(r"(?U)(\p{L}+-\p{L}+)"), 1)).alias("compound")
        compounds = body.select(compound).groupBy("compound").agg(F.count(F.lit(1)).alias("nc"))
        self.joins = cut(joins(self.lines, self.vocab, compounds))
        whole = self.joins.filter("divided and hyphen <> ''").select("txt_id", "num_linea", F.concat("left", "right").alias("t"), F.length("left").alias("at"))
        halves = self.joins.filter("not divided and hyphen <> ''").select("txt_id", "num_linea", F.explode(F.array("left", "right")).alias("t"), F.lit(None).cast("int").alias("at"))
        single = body.select("txt_id", "num_linea", F.explode("words").alias("t"), F.lit(None).cast("int").alias("at"))
        self.tokens = single.unionByName(whole).unionByName(halves)
        known = self.vocab.filter(F.col("n") >= KNOWN).select(F.rtrim("w").alias("k"))
        types = self.tokens.groupBy("t").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.regexp_replace("t", "[!.]+$", ""))
        unknown = types.join(known, "k", "left_anti").filter(F.length("t") >= 2).select("t", "n")
        seen = unknown.join(self.vocab.select(F.col("w").alias("t"), F.col("n").alias("c")), "t", "left").select("t", F.coalesce("c", F.lit(0)).alias("n"))
        self.fixes = cut(replacements(seen, self.vocab, ranking_trees(self.vocab)))

    def misread_lines(self) -> DataFrame:
        """(txt_id, num_linea) of body lines with a misread word or figure. In a divided
        word the first character that differs says which of its two lines is meant."""
        hit = self.tokens.join(self.fixes.select("t", "w"), "t")
        first = F.expr("size(filter(sequence(1, length(t)), i -> substring(t, 1, i) = substring(w, 1, i)))")
        nxt = self.lines.filter("kind = 'corpo'").select(
            "txt_id", "num_linea", F.lead("num_linea").over(Window.partitionBy("txt_id").orderBy("num_linea")).alias("next")
        )
        split = hit.filter("at is not null").join(nxt, ["txt_id", "num_linea"]).select("txt_id", F.when(first < F.col("at"), F.col("num_linea")).otherwise(F.col("next")).alias("num_linea"))
        plain = hit.filter("at is null").select("txt_id", "num_linea")
        figure = self.lines.filter("kind = 'corpo' and number").select("txt_id", "num_linea")
        return plain.unionByName(split).unionByName(figure).distinct()

    def found(self) -> DataFrame:
        """(txt_id, num_linea, difetto), one row a line and defect."""
        furniture = self.lines.filter("kind in ('intestazione', 'numero_pagina')").select("txt_id", "num_linea", F.col("kind").alias("difetto"))
        divided = self.joins.filter("divided").select("txt_id", "num_linea", F.lit("sillabazione").alias("difetto"))
        wrong = self.misread_lines().select("txt_id", "num_linea", F.lit("carattere").alias("difetto"))
        return furniture.unionByName(divided).unionByName(wrong)

    def text(self) -> DataFrame:
        """(txt_id, testo): the repaired text, a line a paragraph."""
        body = self.lines.filter("kind in ('corpo', 'vuota')").select("txt_id", "num_linea", "kind", "line", "words")
        fix = (
            self.tokens.join(self.fixes.select("t", "w"), "t")
            .groupBy("txt_id")
            .agg(F.map_from_entries(F.collect_set(F.struct("t", "w"))).alias("fixes"))
        )
        end = self.joins.filter("divided").select("txt_id", "num_linea", "hyphen")
        rows = (
            body.join(end, ["txt_id", "num_linea"], "left")
            .groupBy("txt_id")
            .agg(F.array_sort(F.collect_list(F.struct("num_linea", "kind", "line", "hyphen"))).alias("lines"))
            .join(fix, "txt_id", "left")
        )

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                out = [paragraphs(x, dict(f) if f is not None else {}) for x, f in zip(p["lines"], p["fixes"])]
                yield pd.DataFrame({"txt_id": p["txt_id"], "testo": out})

        return rows.mapInPandas(run, "txt_id bigint, testo string")


def paragraphs(lines, fixes: dict[str, str]) -> str:
    """Body lines joined to paragraphs, divided words whole and misread ones replaced."""
    out, text, glue = [], "", False
    for r in lines:
        s = " ".join((r["line"] or "").split())
        if r["kind"] == "vuota":
            if text and ENDS.search(text) and not glue:
                out.append(text)
                text = ""
            continue
        text = text + s if glue or not text else text + " " + s
        glue = r["hyphen"] is not None
        if r["hyphen"]:
            text = text[:-1]
    if text:
        out.append(text)

    def fix(m: re.Match) -> str:
        t = m.group()
        w = fixes.get(t.lower())
        if w is None:
            return t
        return w.upper() if t.isupper() and len(t) > 1 else w.capitalize() if t[:1].isupper() else w

    def figure(m: re.Match) -> str:
        t = m.group()
        bare = t.strip(EDGE)
        return t.replace(bare, bare.translate(DIGIT_LOOKS), 1) if bare and misread_number(bare) else t

    out = [re.sub(r"\S+", figure, x) for x in out]
    return "\n".join(re.sub(r"[^\s.,;:()\"«»“”…?\[\]{}<>*'’‘`/‐–—-]+", fix, x) for x in out)
