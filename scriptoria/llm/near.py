"""Near-duplicate records: DartMinHash signatures, banded join, exact check, groups.

Plan. One Arrow pass turns every text into a class key, its band keys and a sketch of
one bit a signature value; shingles are written nowhere. Texts with equal word sequences
collapse to one class (a class that holds a third of all rows is signed and sent once
per map task). Classes meet a few bands at a time, and the shuffle files of these are
removed before the next; a pair is written only if its sketches differ in no more bits
than a near pair's do, so that texts of one trade that share a band by chance cost no
disk. Of the classes in a pair, and of no others, the texts are then read again and
brought together, each once for its neighbours, for the exact Jaccard check. Pairs of
rows, where wanted, come last by expanding classes. Groups need no pairs: the classes of
a band are checked against one of them, and only classes of different groups then meet.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.common import U, WordHashes, as_hash, mix, salt, shingles, text_key, unit, words
from scriptoria.session import cut, spread

HASHES = 256  # signature length
BLOCK = 100_000  # shingles signed at a time
WIDEST = 256  # of a cell: its Poisson probabilities are far from underflow
ROWS = 4  # rows of a band: a pair of similarity s meets with 1-(1-s^4)^64, 0.99986 at 0.6
WORDS = HASHES // 64  # longs of a sketch
SIGMAS = 6  # a sketch may differ by so many deviations more than at the threshold: 1e-9 of the pairs there do
SEEN = 200_000  # class keys that a task remembers as signed
ENTRIES = 500_000  # band entries that meet at a time, or an eighth of all if that is more
FETCHED = 100_000  # classes whose texts are found by a broadcast; more through a sieve and a shuffle
SIEVE_BITS = 26  # the sieve has 2^26 bits whatever the data's size: 8 MB to broadcast
BUCKET = 2_000_000  # shingles, and pairs, checked in one group


# --- DartMinHash -----------------------------------------------------------------


def _poisson_cdf(mean: float) -> np.ndarray:
    """P(N <= j) for j = 0, 1, ... until it is 1 in double precision."""
    p = math.exp(-mean)
    out, c, j = [], 0.0, 0
    while c < 1 - 1e-15 and j < 40 + 4 * mean:
        c += p
        out.append(c)
        j += 1
        p *= mean / j
    return np.array(out)


def _cells() -> Iterator[tuple[int, float, float]]:
    """Rank cells (number, low, width), half as wide as all before them, up to WIDEST."""
    low, width, n = 0.0, 0.5, 0
    while True:
        yield n, low, width
        low, n = low + width, n + 1
        width = min(low / 2, WIDEST)


def dart_signatures(el: np.ndarray, wt: np.ndarray, doc: np.ndarray, n_docs: int, k: int = HASHES) -> np.ndarray:
    """n_docs x k DartMinHash values of weighted sets; weights in (0, 1].

    Each element owns one Poisson process of darts over (weight 0..1) x (rank 0..),
    drawn cell by cell from its hash alone, so that equal elements of two documents
    have equal darts; a dart is in a document if it lies under the element's weight.
    The value of a slot is its dart of least rank. Cells rise in rank, so a slot that has
    a dart is closed to later cells, and a document whose slots are all closed throws no
    more. Equal slots of two documents agree with the probability of their weighted
    Jaccard similarity. Sets without elements keep zeros.
    """
    sig = np.zeros(n_docs * k, dtype=np.uint64)
    is_open = np.ones(n_docs * k, dtype=bool)
    left = np.bincount(doc, weights=wt, minlength=n_docs) > 0
    whole = bool((wt >= 1).all())
    for n, low, width in _cells():
        on = left[doc]
        if not on.all():
            el, doc, wt = el[on], doc[on], wt[on]
        if not len(el):
            break
        base = mix(el ^ salt(1, n))
        count = np.searchsorted(_poisson_cdf(width), unit(base), side="right")
        of = np.repeat(np.arange(len(el)), count)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        dart = mix(base[of] + mix(np.arange(count.max(initial=0), dtype=np.uint64) + salt(2, n))[nth])
        cell = (doc * k)[of] + (dart % U(k)).astype(np.int64)
        hit = is_open[cell]
        if not whole:
            hit &= unit(mix(dart ^ salt(4))) < wt[of]
        hit = np.nonzero(hit)[0]
        dart, cell = dart[hit], cell[hit]
        rank = mix(dart ^ salt(3))
        least = np.full(n_docs * k, ~U(0))
        np.minimum.at(least, cell, rank)
        first = rank == least[cell]
        sig[cell[first]] = dart[first]
        is_open[cell] = False
        left &= is_open.reshape(-1, k).any(axis=1)
    return sig.reshape(n_docs, k)


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Band keys (documents x bands) of signatures; the band's number is in the key."""
    n, k = sig.shape
    x = sig.reshape(n, k // rows, rows)
    key = np.zeros((n, k // rows), dtype=np.uint64) + np.arange(k // rows, dtype=np.uint64)
    for j in range(rows):
        key = mix(key * U(0x100000001B3) + x[:, :, j])
    return key


def sketches(sig: np.ndarray) -> np.ndarray:
    """One bit of each value of the signatures, as documents x values / 64 longs."""
    bits = np.packbits((mix(sig ^ salt(6)) >> U(63)).astype(np.uint8), axis=1)
    return np.ascontiguousarray(bits).view(np.int64)


def signed_rows(df: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, raw, key, n, bands, sketch) of each text that has at least ``k`` words; shorter,
    empty and null texts have no shingles and are left out. raw is the hash of the text
    as it is, key that of its words, n the number of its distinct shingles. Shingles weigh
    alike, so that the weighted similarity is the plain one that the exact check uses.
    A text of a class that the task has signed already has n 0 and empty lists."""
    src = df.select(F.col(id_col).alias("id"), _raw(text_col).alias("raw"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for b in batches:
            keep, keys, sets = [], [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                h = hashes(words(t))
                if len(h) < k:
                    continue
                keep.append(i)
                keys.append(text_key(h))
                sets.append(np.empty(0, U) if keys[-1] in seen else np.unique(shingles(h, k)))
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(keys[-1])
            n = np.array([len(x) for x in sets], dtype=np.int64)
            signed = np.nonzero(n)[0]
            ends = np.cumsum(n[signed])
            band, bits, at = [], [], 0
            while at < len(signed):  # as many texts at a time as have BLOCK shingles
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
                part = signed[at:upto]
                flat = np.concatenate([sets[i] for i in part])
                sig = dart_signatures(flat, np.ones(len(flat)), np.repeat(np.arange(len(part)), n[part]), len(part))
                band.append((bands(sig) >> U(32)).astype(np.uint32).view(np.int32).ravel())
                bits.append(sketches(sig).ravel())
                at = upto
            rows = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(rows),
                    b.column(1).take(rows),
                    pa.array(keys, pa.int64()),
                    pa.array(n, pa.int32()),
                    _lists(band, np.int32, (n > 0) * (HASHES // ROWS)),
                    _lists(bits, np.int64, (n > 0) * WORDS),
                ],
                names=["id", "raw", "key", "n", "bands", "sketch"],
            )

    return src.mapInArrow(run, f"id {kind}, raw bigint, key bigint, n int, bands array<int>, sketch array<bigint>")


def _raw(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col))


def _lists(parts: list[np.ndarray], kind, lengths: np.ndarray) -> pa.ListArray:
    flat = np.concatenate(parts) if parts else np.empty(0, kind)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(flat))


def _lean(df: DataFrame) -> DataFrame:
    """``cut``; the shuffle files that it took are removed when it is written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    conf = df.sparkSession.conf
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        return cut(df.select("*"))
    finally:
        conf.set(name, before)


def banded(sig: DataFrame, low: int, many: int, *other: str) -> DataFrame:
    """(key, n, sketch's longs, band): a row a class and each of ``many`` bands from ``low`` on."""
    longs = [F.col("sketch")[i].alias(f"s{i}") for i in range(WORDS)]
    each = sig.select("key", "n", *longs, *other, F.posexplode(F.slice("bands", low + 1, many)).alias("i", "h"))
    band = F.shiftleft(F.col("i").cast("bigint"), 32).bitwiseOR(F.col("h").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))
    return each.withColumn("band", band).drop("i", "h")


def _near(a: str, b: str, threshold: float) -> Column:
    """Near enough in size, a bound that is exact, and in sketch: of the bits of a pair at
    the threshold (1 - threshold) / 2 differ on average."""
    odds = (1 - threshold) / 2
    most = HASHES * odds + SIGMAS * math.sqrt(HASHES * odds * (1 - odds))
    differ = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(WORDS)), F.lit(0))
    return (F.least(f"{a}.n", f"{b}.n") >= F.greatest(f"{a}.n", f"{b}.n") * F.lit(threshold)) & (differ <= F.lit(most))


def _meeting(sig: DataFrame, meet: Callable[[DataFrame], DataFrame], *other: str) -> DataFrame:
    """(a, b), each once, of what ``meet`` makes of the bands, a few bands at a time."""
    bands_ = HASHES // ROWS
    many = max(bands_ // 8, min(bands_, ENTRIES // max(1, sig.count())))
    met = None
    for low in range(0, bands_, many):
        new = meet(banded(sig, low, many, *other)).distinct()
        new = _lean(new if met is None else new.join(met, ["a", "b"], "left_anti"))
        met = new if met is None else met.unionByName(new)
    return met


def _self_join(band: DataFrame, threshold: float, *cond: Column) -> DataFrame:
    """(a, b), a < b, of classes that share a band and are near enough in size and sketch."""
    near = (F.col("a.band") == F.col("b.band")) & (F.col("a.key") < F.col("b.key")) & _near("a", "b", threshold)
    for c in cond:
        near = near & c
    return band.alias("a").join(band.alias("b"), near).select(F.col("a.key").alias("a"), F.col("b.key").alias("b"))


class Texts:
    """The texts of classes, read again from where they came."""

    def __init__(self, df: DataFrame, text_col: str, k: int):
        self.rows, self.k = df.select(_raw(text_col).alias("raw"), F.col(text_col).alias("text")), k

    def of(self, needed: DataFrame, many: int) -> DataFrame:
        """(raw, text), each raw once, of ``needed`` (raw), ``many`` rows; where they are too
        many to broadcast some others get through the sieve, but a join with needed drops them."""
        rows = self.rows.join(F.broadcast(needed), "raw") if many <= FETCHED else self._sieved(needed)
        return rows.groupBy("raw").agg(F.first("text").alias("text"))

    def _sieved(self, needed: DataFrame) -> DataFrame:
        slot = needed.select(F.shiftrightunsigned("raw", 64 - SIEVE_BITS).alias("slot"))
        got = slot.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(slot & 63 AS INT)))").alias("bits")).toArrow()
        table = np.zeros(1 << (SIEVE_BITS - 6), dtype=np.uint64)
        table[got.column("at").to_numpy()] = as_hash(got.column("bits").to_numpy())
        sieve = needed.sparkSession.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                slot = as_hash(b.column(0).to_numpy()) >> U(64 - SIEVE_BITS)
                bit = sieve.value[(slot >> U(6)).astype(np.int64)] >> (slot & U(63)) & U(1)
                yield b.filter(pa.array(bit.astype(bool)))

        return self.rows.mapInArrow(run, "raw bigint, text string")

    def verified(self, pairs: DataFrame, sig: DataFrame, threshold: float) -> DataFrame:
        """(a, b, similarity) of the pairs (a, b) of classes of ``sig`` whose exact Jaccard
        reaches ``threshold``. Pairs go to the least class beside their a, so that a text
        is sent once for a group of near copies, and by their a to several places where
        there are too many for one."""
        needed = _lean(sig.join(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "key", "left_semi").select("key", "raw", "n"))
        many, total = needed.agg(F.count(F.lit(1)), F.sum("n")).first()
        buckets = max(2 * pairs.sparkSession.sparkContext.defaultParallelism, (total or 0) // BUCKET)
        hub = _both(pairs).groupBy(F.col("u").alias("a")).agg(F.least("a", F.min("v")).alias("hub"))
        placed = pairs.join(hub, "a")
        shares = placed.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / F.lit(BUCKET)).alias("shares")).filter("shares > 1")
        share = F.coalesce(F.pmod(F.xxhash64("a"), "shares"), F.lit(0).cast("bigint"))
        placed = placed.join(shares, "hub", "left").select(F.pmod(F.xxhash64("hub", share), F.lit(buckets)).alias("bucket"), "a", "b")
        placed = _lean(placed)
        asked = placed.select(F.col("bucket").alias("place"), F.explode(F.array("a", "b")).alias("key")).distinct().join(needed.select("key", "raw"), "key")
        texts = asked.join(self.of(needed.select("raw"), many), "raw").select("place", "key", "text")
        k = self.k

        def run(pair: pa.Table, text: pa.Table) -> pa.Table:
            hashes = WordHashes()
            at = {key: i for i, key in enumerate(text.column("key").to_pylist())}
            sets = [np.unique(shingles(hashes(words(t)), k)) for t in text.column("text").to_pylist()]
            a, b = (pair.column(c).to_numpy() for c in "ab")
            alike = np.empty(len(a))
            for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
                x, y = sets[at[x]], sets[at[y]]
                place = np.minimum(np.searchsorted(x, y), len(x) - 1)
                shared = int((x[place] == y).sum())
                alike[i] = shared / (len(x) + len(y) - shared)
            near = alike >= threshold
            return pa.table({"a": a[near], "b": b[near], "similarity": alike[near]})

        return placed.groupBy("bucket").cogroup(texts.groupBy("place")).applyInArrow(run, "a bigint, b bigint, similarity double")


def class_links(sig: DataFrame, texts: Texts, threshold: float) -> DataFrame:
    """(a, b, similarity), a < b, of signed classes whose exact Jaccard reaches ``threshold``."""
    return texts.verified(_meeting(sig, lambda band: _self_join(band, threshold)), sig, threshold)


def class_groups(sig: DataFrame, texts: Texts, threshold: float) -> DataFrame:
    """(key, group): the components of class_links, without listing the pairs of a large
    group. Every class of a band is checked against the band's least one alone, and
    the groups that this makes are taken; only classes that share a band but no group
    then meet. What is left out are links inside a group, so the groups are the same."""
    longs = [f"s{i}" for i in range(WORDS)]

    def star(band: DataFrame) -> DataFrame:
        hub = band.groupBy("band").agg(F.min(F.struct("key", "n", *longs)).alias("hub"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("band", "hub.*")
        near = (F.col("a.band") == F.col("b.band")) & (F.col("a.key") < F.col("b.key")) & _near("a", "b", threshold)
        return hub.alias("a").join(band.alias("b"), near).select(F.col("a.key").alias("a"), F.col("b.key").alias("b"))

    def across(band: DataFrame) -> DataFrame:
        mixed = band.groupBy("band").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo <> hi").select("band")
        return _self_join(band.join(mixed, "band"), threshold, F.col("a.group") != F.col("b.group"))

    first = _lean(texts.verified(_meeting(sig, star), sig, threshold).select("a", "b"))
    group = _lean(components(sig.select("key"), first))
    second = _lean(texts.verified(_meeting(_lean(sig.join(group, "key")), across, "group"), sig, threshold).select("a", "b"))
    if second.isEmpty():
        return group
    return components(sig.select("key"), first.unionByName(second))


def signed_texts(df: DataFrame, id_col: str, text_col: str, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(members, classes): members (id, key) gives each text's class of equal word
    sequences, classes (key, raw, n, bands, sketch) are signed.

    Nulls, empty texts and texts of fewer than ``k`` words are in no class. Repeated
    rows share a class. Other columns of ``df`` play no part, whatever their names.
    """
    rows = cut(signed_rows(spread(df), id_col, text_col, k))
    return rows.select("id", "key"), _lean(rows.filter("n > 0").drop("id").dropDuplicates(["key"]))


def near_duplicates(df: DataFrame, id_col: str, text_col: str, k: int = 5, threshold: float = 0.8):
    """(members, links): members (id, key) of signed_texts, links (a, b, similarity) the
    pairs of different classes that are near."""
    members, sig = signed_texts(df, id_col, text_col, k)
    return members, class_links(sig, Texts(df, text_col, k), threshold)


def near_groups(df: DataFrame, id_col: str, text_col: str, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, key, group): each text with its class of equal word sequences and the group
    of classes that near pairs connect; texts as in signed_texts."""
    members, sig = signed_texts(df, id_col, text_col, k)
    return members.join(class_groups(sig, Texts(df, text_col, k), threshold), "key").select("id", "key", "group")


def row_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(riga_a, riga_b), smaller first: all pairs of rows behind links and classes."""
    m = members
    across = (
        links.join(m.select(F.col("key").alias("a"), F.col("id").alias("x")), "a")
        .join(m.select(F.col("key").alias("b"), F.col("id").alias("y")), "b")
        .select(F.least("x", "y").alias("riga_a"), F.greatest("x", "y").alias("riga_b"))
    )
    x, y = m.alias("x"), m.alias("y")
    within = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id"))).select(
        F.col("x.id").alias("riga_a"), F.col("y.id").alias("riga_b")
    )
    return across.unionByName(within)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(key, group): connected components by alternating large-star and small-star
    steps over (a, b), each written to the checkpoint folder, until a step changes
    nothing; their number grows with the logarithm of the longest chain. The smallest
    key of a component names it; a node without links is its own group. Every step
    aggregates by minimum before it joins, so that a hub is never gathered in one task."""
    edges = cut(links.select("a", "b").distinct())
    mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(edges)
    while before[0]:
        edges = cut(_small(_large(edges)).distinct())
        after = mark(edges)
        if after == before:
            break
        before = after
    group = edges.groupBy(F.greatest("a", "b").alias("key")).agg(F.min(F.least("a", "b")).alias("g"))
    return nodes.join(group, "key", "left").select("key", F.coalesce("g", "key").alias("group"))


def _both(e: DataFrame) -> DataFrame:
    return e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        e.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )


def _large(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least node around it."""
    both = _both(e)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b")


def _small(e: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the least around it."""
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).filter("a <> b")
