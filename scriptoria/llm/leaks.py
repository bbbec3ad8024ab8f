"""Evaluation passages inside a training corpus, by greedy string tiling.

Plan. Texts are compared as streams of letters and digits without case, accents,
spaces and punctuation, so that none of these, nor a hyphen at a line end, can hide a
passage; a tile begins and ends where a word of the item and one of the document do.
Items of bounded size are broadcast with their Karp-Rabin hashes, and the corpus goes
past them in one narrow pass, with no shuffle whatever the corpus' size. Of more items
only a sieve of fixed size is broadcast: the corpus, still in one pass, gives the hashes
that the sieve lets through, these meet the items' hashes in a join, and the pairs of
document and item that meet are tiled. The seed length follows from the items
themselves: it is chosen so that every stretch of ``least`` item words is longer than a
seed plus the probing step, hence no such stretch can be missed. Seeds grow to maximal
matches; the longest is marked as a tile, what it covers is cut from the rest, and so
on until no match of ``least`` words is left.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.common import U, WORD, as_long, mix
from scriptoria.session import cut, spread

STEP = 8  # the corpus is probed at every eighth character
BLOCK_CHARS = 4_000_000  # item characters broadcast at most: about 100 MB of hashes; more are joined
SIEVE_BITS = 26  # of the sieve for more: 8 MB; of other hashes it lets through one in 2^26 / item characters
BASE = 0x9E3779B97F4A7C15 | 1
_STRIP = re.compile(r"[\W_]+")
_HYPHEN = re.compile(r"(?<=\w)[-‐‑­]\s*\n\s*(?=\w)")
_MARKS = re.compile(r"[\u0300-\u036f]+")
_CODES = mix(np.arange(1 << 16, dtype=np.uint64) + U(77))


def plain(text: str) -> str:
    """Lower case without accents; compatibility forms unfolded."""
    t = text.lower()
    return t if t.isascii() else unicodedata.normalize("NFKD", t)


def stream(text: str | None) -> np.ndarray:
    """The letters and digits of a text as code points."""
    if not text:
        return np.empty(0, np.uint32)
    return np.frombuffer(_STRIP.sub("", plain(text)).encode("utf-32-le"), dtype=np.uint32)


def word_ends(text: str) -> np.ndarray:
    """Places of a text's stream where a word ends and the next begins, 0 among them."""
    t = _MARKS.sub("", plain(_HYPHEN.sub("", text)))
    return np.concatenate([[0], np.cumsum([len(w) for w in WORD.findall(t)], dtype=np.int64)])


def item_words(text: str | None) -> list[str]:
    """An item's words: runs of letters and digits, a word divided at a line end being one."""
    t = _HYPHEN.sub("", text.lower()) if text else ""
    parts = (_STRIP.sub("", plain(w)) for w in WORD.findall(unicodedata.normalize("NFC", t)))
    return [w for w in parts if w]


class Rolling:
    """Karp-Rabin hashes of all windows of a stream: differences of running sums over
    powers of the base, brought to the window's own start."""

    def __init__(self, most: int = 1 << 20):
        self.up = np.cumprod(np.full(most, BASE, dtype=np.uint64))
        self.down = np.cumprod(np.full(most, pow(BASE, -1, 1 << 64), dtype=np.uint64))
        self.most = most

    def windows(self, codes: np.ndarray, size: int, step: int = 1) -> np.ndarray:
        """Hash of codes[i : i + size] for i = 0, step, 2 step, ..."""
        out = []
        last = len(codes) - size
        span = (self.most - size) // step * step
        for at in range(0, last + 1, span):
            part = codes[at : at + span + size]
            run = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_CODES[part & 0xFFFF] * self.down[: len(part)], out=run[1:])
            i = np.arange(0, min(span, len(part) - size + 1), step)
            out.append(mix((run[i + size] - run[i]) * self.up[i]))
        return np.concatenate(out) if out else np.empty(0, np.uint64)


class Items:
    """A block of evaluation items, hashed for lookup."""

    def __init__(self, rows: list[tuple[int, str]], least: int, shortest: int | None = None):
        self.least = least
        words = [(i, w) for i, t in rows if len(w := item_words(t)) >= least]
        self.ids = [i for i, _ in words]
        self.codes = [np.frombuffer("".join(w).encode("utf-32-le"), dtype=np.uint32) for _, w in words]
        self.edge = [np.concatenate([[0], np.cumsum([len(x) for x in w])]) for _, w in words]
        self.shortest = min((int((e[least:] - e[:-least]).min()) for e in self.edge), default=0) if shortest is None else shortest
        self.step = max(1, min(STEP, self.shortest // 4))
        self.size = max(1, self.shortest - self.step + 1)
        roll = Rolling()
        h = [roll.windows(c, self.size) for c in self.codes]
        flat = np.concatenate(h) if h else np.empty(0, np.uint64)
        of = np.repeat(np.arange(len(h)), [len(x) for x in h])
        pos = np.concatenate([np.arange(len(x)) for x in h]) if h else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.hash, self.of, self.pos = flat[order], of[order].astype(np.int32), pos[order].astype(np.int32)
        self.sieve = np.zeros(1 << 22, dtype=bool)
        self.sieve[(self.hash >> U(42)).astype(np.int64)] = True

    def covered(self, item: int, start: int, end: int) -> int:
        """Whole words of the item within its characters start..end."""
        e = self.edge[item]
        return max(0, int(np.searchsorted(e, end, "right")) - 1 - int(np.searchsorted(e, start, "left")))

    def matches(self, doc: np.ndarray, probes: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Maximal matches (length, start in doc, start in item) of an item, from the
        hashes at every step-th character of the document."""
        out: dict[int, list[tuple[int, int, int]]] = {}
        at = np.nonzero(self.sieve[(probes >> U(42)).astype(np.int64)])[0]
        if not len(at):
            return out
        lo = np.searchsorted(self.hash, probes[at], "left")
        hi = np.searchsorted(self.hash, probes[at], "right")
        done: dict[tuple[int, int], int] = {}  # (item, diagonal) -> end of its last match
        for p, a, b in zip((at * self.step).tolist(), lo.tolist(), hi.tolist()):
            for x in range(a, b):
                item, q = int(self.of[x]), int(self.pos[x])
                if done.get((item, p - q), -1) >= p + self.size:
                    continue
                code = self.codes[item]
                n = min(p, q)
                diff = np.nonzero(doc[p - n : p] != code[q - n : q])[0]
                left = n - 1 - int(diff[-1]) if len(diff) else n
                n = min(len(doc) - p, len(code) - q)
                diff = np.nonzero(doc[p : p + n] != code[q : q + n])[0]
                right = int(diff[0]) if len(diff) else n
                done[item, p - q] = p + right
                if right >= self.size:
                    out.setdefault(item, []).append((left + right, p - left, q - left))
        return out

    def trimmed(self, item: int, n: int, d: int, i: int, ends: np.ndarray) -> tuple[int, int, int]:
        """The part of a match (length, start in doc, start in item) that begins and ends
        where words of the item and of the document, whose ``ends`` are given, do."""
        e = self.edge[item]
        both = e[(e >= i) & (e <= i + n)]
        both = both[np.isin(both - i + d, ends, assume_unique=True)]
        return (int(both[-1] - both[0]), int(both[0]) - i + d, int(both[0])) if len(both) > 1 else (0, d, i)

    def tiles(self, item: int, found: list[tuple[int, int, int]], ends: np.ndarray) -> list[tuple[int, int, int]]:
        """Greedy tiles (length, start in doc, start in item): the longest match first,
        none overlapping another on either side, each of ``least`` item words or more."""
        heap: list[tuple[int, int, int]] = []

        def push(n: int, d: int, i: int) -> None:
            if self.covered(item, i, i + n) < self.least:
                return
            n, d, i = self.trimmed(item, n, d, i, ends)
            if n and self.covered(item, i, i + n) >= self.least:
                heapq.heappush(heap, (-n, d, i))

        for m in found:
            push(*m)
        out: list[tuple[int, int, int]] = []
        while heap:
            n, d, i = heapq.heappop(heap)
            n = -n
            cuts = sorted(
                {(max(d2, d) - d, min(d2 + m, d + n) - d) for m, d2, _ in out if d2 < d + n and d < d2 + m}
                | {(max(i2, i) - i, min(i2 + m, i + n) - i) for m, _, i2 in out if i2 < i + n and i < i2 + m}
            )
            if not cuts:
                out.append((n, d, i))
                continue
            at = 0
            for x, y in [*cuts, (n, n)]:
                if x > at:
                    push(x - at, d + at, i + at)
                at = max(at, y)
        return out

    def tiled(self, text: str, roll: Rolling) -> Iterator[tuple[int, int, int, int, float]]:
        """(item_id, longest, tiles, words, coverage) of every item the text has tiles of."""
        doc = stream(text)
        hits = self.matches(doc, roll.windows(doc, self.size, self.step))
        ends = None
        for item, found in hits.items():
            found = [m for m in found if self.covered(item, m[2], m[2] + m[0]) >= self.least]
            if not found:
                continue
            ends = word_ends(text) if ends is None else ends
            each = [self.covered(item, q, q + n) for n, _, q in self.tiles(item, found, ends)]
            if each:
                yield self.ids[item], max(each), len(each), sum(each), sum(each) / (len(self.edge[item]) - 1)


SCHEMA = "doc_id bigint, item_id bigint, longest int, tiles int, words int, coverage double"
TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())


def _block(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(TYPES)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def leaked(
    docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, least: int = 20, coverage: float = 0.0
) -> DataFrame:
    """(doc_id, item_id, longest, tiles, words, coverage) of every document that holds
    at least ``least`` consecutive words of an item, and at least ``coverage`` of its
    words in all tiles together, in whatever order.

    Null and empty documents hold nothing; items of fewer than ``least`` words leak
    nowhere. Repeated documents and items are reported one by one. Only the named
    columns are read. No items or no documents: no rows. Documents of any length are
    compared whole.
    """
    src = spread(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(doc_text).alias("text"))).filter("text is not null")
    wanted = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("item")).filter("item is not null")
    size = wanted.agg(F.sum(F.length("item"))).first()[0] or 0
    if size > BLOCK_CHARS:
        return _joined(src, wanted, least, coverage)
    shared = docs.sparkSession.sparkContext.broadcast(Items([tuple(r) for r in wanted.collect()], least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Items = shared.value
        roll = Rolling()
        for b in batches:
            pairs = zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if block.ids else ()
            yield _block([(i, *t) for i, text in pairs for t in block.tiled(text, roll) if t[-1] >= coverage])

    return src.mapInArrow(run, SCHEMA)


def _joined(docs: DataFrame, items: DataFrame, least: int, coverage: float) -> DataFrame:
    """leaked() for items of any number: hashes that the sieve lets through meet the items'."""
    spark = docs.sparkSession

    def shortest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [x.shortest for t in b.column(1).to_pylist() if (x := Items([(0, t)], least)).ids]
            yield pa.RecordBatch.from_arrays([pa.array([min(n)] if n else [], pa.int64())], names=["n"])

    least_chars = items.mapInArrow(shortest, "n bigint").agg(F.min("n")).first()[0]
    if least_chars is None:
        return spark.createDataFrame([], SCHEMA)
    step = max(1, min(STEP, least_chars // 4))
    size = max(1, least_chars - step + 1)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling()
        for b in batches:
            each = [np.unique(roll.windows(np.frombuffer("".join(item_words(t)).encode("utf-32-le"), np.uint32), size)) for t in b.column(1).to_pylist()]
            ids = np.repeat(np.array(b.column(0).to_pylist(), np.int64), [len(h) for h in each])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(as_long(np.concatenate(each)) if each else np.empty(0, np.int64))], names=["item_id", "h"])

    seeds = cut(items.mapInArrow(hashed, "item_id bigint, h bigint"))
    slots = seeds.select(F.shiftrightunsigned("h", 64 - SIEVE_BITS).alias("s")).distinct().toArrow().column("s").to_numpy()
    sieve = np.zeros(1 << SIEVE_BITS, dtype=bool)
    sieve[slots] = True
    packed = spark.sparkContext.broadcast(np.packbits(sieve))

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling()
        bits = packed.value
        for b in batches:
            ids, hs = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = roll.windows(stream(text), size, step)
                at = (h >> U(64 - SIEVE_BITS)).astype(np.int64)
                h = np.unique(h[(bits[at >> 3] >> (7 - (at & 7))) & 1 == 1])
                ids.append(np.full(len(h), i))
                hs.append(h)
            cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cat(ids)), pa.array(as_long(np.concatenate(hs)) if hs else cat(hs))], names=["doc_id", "h"])

    probes = docs.filter("doc_id is not null").mapInArrow(probed, "doc_id bigint, h bigint")
    pairs = cut(probes.join(seeds.distinct(), "h").select("doc_id", "item_id").distinct())
    work = docs.join(pairs, "doc_id").join(items, "item_id").select("doc_id", "item_id", "text", "item")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling()
        for b in batches:
            out = []
            for i, item, text, words in zip(*(c.to_pylist() for c in b.columns)):
                out += [(i, *t) for t in Items([(item, words)], least).tiled(text, roll) if t[-1] >= coverage]
            yield _block(out)

    return work.mapInArrow(tile, SCHEMA)
