"""Same or near-same records across splits, by winnowing fingerprints.

Plan. Texts collapse to classes of equal word sequences. Of each class, winnowing
keeps the least shingle of every window of consecutive shingles ("rolling-hash
minima"). Least means rarest first: the order is (document count of the shingle in a
sketch of fixed size, hash), one order for all texts, so that two texts that share a
run as long as a window keep the same shingle of it, and common phrases of the trade
are hardly ever kept. Candidates are exact: two texts that share c shingles have, in
any fixed order, l of them among the first n - c + l of either, so the rarest of either
side are joined across the splits and pairs counted that meet in l of them.
The kept shingles that a candidate pair shares are its seeds (all shared shingles where
it has none). They are chained collinearly, the chains extended word by word, and the
pair measured: coverage of either side and exact Jaccard.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.common import U, WordHashes, as_hash, lists, mix, shingles, small, text_key, words
from scriptoria.operators.relational import act_id
from scriptoria.session import cut, spread

SKETCH_BITS = 20  # the sketch has 2^20 counters whatever the data's size: 4 MB to broadcast
MEET = 4  # rarest shingles in which a candidate pair meets, l above
WINDOW = 7  # shingles of a winnowing window: any 9 words in a row that two texts share yield a common seed


def hashed(df: DataFrame, k: int) -> DataFrame:
    """(side, id, act, key, wh) of (side, id, act, text): wh are the word hashes in
    order; texts of fewer than ``k`` words, empty and null ones keep a null key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            keys, seqs = [], []
            for t in b.column(3).to_pylist():
                h = hashes(words(t))
                keys.append(text_key(h) if len(h) >= k else None)
                seqs.append(h if len(h) >= k else h[:0])
            wh = lists(np.concatenate(seqs) if seqs else np.empty(0, U), [len(s) for s in seqs])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(keys, pa.int64()), wh],
                names=["side", "id", "act", "key", "wh"],
            )

    return df.mapInArrow(run, "side string, id bigint, act string, key bigint, wh array<bigint>")


def _each(b: pa.RecordBatch, col: int) -> Iterator[np.ndarray]:
    a = b.column(col)
    flat, off = as_hash(a.values.to_numpy(zero_copy_only=False)), a.offsets.to_numpy()
    for i in range(b.num_rows):
        yield flat[off[i] : off[i + 1]]


def count_sketch(classes: DataFrame, k: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """Documents per hashed shingle over all classes: 2^bits counters, summed in the
    tasks and by Spark before the driver sees at most that many rows."""
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(size, dtype=np.int64)
        for b in batches:
            for wh in _each(b, 0):
                slot = (np.unique(shingles(wh, k)) >> U(64 - bits)).astype(np.int64)
                np.add.at(count, slot, 1)
        at = np.nonzero(count)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], names=["slot", "n"])

    per = classes.select("wh").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    got = per.toArrow()
    out = np.zeros(size, dtype=np.int32)
    out[got.column("slot").to_numpy()] = np.minimum(got.column("n").to_numpy(), 2**31 - 1)
    return out


def winnow(sh: np.ndarray, rank: np.ndarray, w: int = WINDOW) -> np.ndarray:
    """Positions of the least-ranked shingle of every window of ``w`` (the last of
    equals); at least one position if there is any shingle."""
    n = len(sh)
    if n == 0:
        return np.empty(0, np.int64)
    w = min(w, n)
    win = np.lib.stride_tricks.sliding_window_view(rank, w)[:, ::-1]
    return np.unique(np.arange(n - w + 1) + w - 1 - win.argmin(axis=1))


def window_of(n: int, w: int = WINDOW) -> int:
    """The window for a text of ``n`` distinct shingles: smaller in short texts, where
    few edits leave only short runs. Texts of different windows still meet: the least
    shingle of a shared run that is as long as either window is kept by both."""
    return 1 if n <= 12 else min(w, 2) if n <= 30 else min(w, 4) if n <= 60 else w


def order_of(sh: np.ndarray, counts: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """One number a shingle, rarest first and then by hash, as float-free uint64."""
    c = np.minimum(counts[(sh >> U(64 - bits)).astype(np.int64)], (1 << 24) - 1).astype(np.uint64)
    return (c << U(40)) | (mix(sh) >> U(24))


def seeded(classes: DataFrame, counts, k: int, threshold: float, w: int = WINDOW) -> DataFrame:
    """(key, in_a, in_b, wh, n, hs, ps, first) of (key, in_a, in_b, wh): the number of
    distinct shingles, the kept ones with their positions, each once a text, and the
    rarest n - ceil(tn) + MEET, rarest first. Kept are winnowed shingles among the
    1 - threshold rarest, with a quarter of that as a margin for shared shingles that
    stand in runs shorter than a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for b in batches:
            n_out, h_out, p_out, f_out = [], [], [], []
            for wh in _each(b, 3):
                sh = shingles(wh, k)
                rank = order_of(sh, table)
                each, first = np.unique(sh, return_index=True)
                n = len(first)
                order = np.lexsort((each, rank[first]))
                f_out.append(each[order[: n - math.ceil(n * threshold - 1e-9) + MEET]])
                prefix = min(n, int(n * (1 - threshold) * 1.25) + 2)
                limit = np.partition(rank[first], prefix - 1)[prefix - 1] if n else 0
                pos = winnow(sh, rank, window_of(n, w))
                pos = pos[rank[pos] <= limit]
                if n and not len(pos):
                    pos = np.array([int(rank.argmin())])
                h, at = np.unique(sh[pos], return_index=True)
                n_out.append(n)
                h_out.append(h)
                p_out.append(pos[at].astype(np.uint64))
            cat = lambda x: np.concatenate(x) if x else np.empty(0, U)
            many = [len(h) for h in h_out]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(n_out, pa.int32()), lists(cat(h_out), many), lists(cat(p_out), many), lists(cat(f_out), [len(f) for f in f_out])],
                names=["key", "in_a", "in_b", "wh", "n", "hs", "ps", "first"],
            )

    return classes.select("key", "in_a", "in_b", "wh").mapInArrow(
        run, "key bigint, in_a boolean, in_b boolean, wh array<bigint>, n int, hs array<bigint>, ps array<bigint>, first array<bigint>"
    )


def chain(pa_: np.ndarray, pb: np.ndarray) -> list[tuple[int, int]]:
    """The longest run of seeds that rises on both sides."""
    order = np.lexsort((-pb, pa_))
    tails: list[int] = []
    at: list[int] = []
    back = np.full(len(order), -1)
    seq = pb[order]
    for i, y in enumerate(seq.tolist()):
        j = bisect.bisect_left(tails, y)
        if j == len(tails):
            tails.append(y)
            at.append(i)
        else:
            tails[j], at[j] = y, i
        back[i] = at[j - 1] if j else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append((int(pa_[order[i]]), int(pb[order[i]])))
        i = back[i]
    return out[::-1]


def extend(a: np.ndarray, b: np.ndarray, chained: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Collinear matched blocks (start in a, start in b, words) grown from the seeds."""
    blocks: list[tuple[int, int, int]] = []
    end_a = end_b = 0
    for i, j in chained:
        if i < end_a or j < end_b:
            continue
        room = min(i - end_a, j - end_b)
        left = 0
        while left < room and a[i - left - 1] == b[j - left - 1]:
            left += 1
        most = min(len(a) - i, len(b) - j)
        differ = np.nonzero(a[i : i + most] != b[j : j + most])[0]
        right = int(differ[0]) if len(differ) else most
        blocks.append((i - left, j - left, left + right))
        end_a, end_b = i + right, j + right
    return blocks


def jaccard(a: np.ndarray, b: np.ndarray, k: int) -> float:
    x, y = np.unique(shingles(a, k)), np.unique(shingles(b, k))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def candidates(sig: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of classes a of one split and b of the other that can reach ``threshold``. To
    reach it they must share c = t (na + nb) / (1 + t) shingles; a shared one at places
    i and j counts if enough of either side is left from there on for c - MEET + 1 to
    come, and MEET of them, or c where that is less, make a pair."""
    one = sig.select("key", "in_a", "in_b", "n", F.posexplode("first").alias("i", "h"))
    a, b = one.filter("in_a").alias("a"), one.filter("in_b").alias("b")
    near = F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * F.lit(threshold)
    c = F.ceil((F.col("a.n") + F.col("b.n")) * F.lit(threshold / (1 + threshold)) - F.lit(1e-6))
    room = F.least(F.col("a.n") - F.col("a.i"), F.col("b.n") - F.col("b.i")) > c - MEET
    met = a.join(b, (F.col("a.h") == F.col("b.h")) & near & room & (F.col("a.key") != F.col("b.key"))).select(F.col("a.key").alias("a"), F.col("b.key").alias("b"), c.alias("c"))
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"), F.first("c").alias("c")).filter(F.col("m") >= F.least(F.col("c"), F.lit(MEET))).select("a", "b")


def class_overlaps(classes: DataFrame, k: int, threshold: float) -> DataFrame:
    """(a, b, seeds, coverage_a, coverage_b, similarity) of classes a of one split and
    b of the other whose Jaccard reaches ``threshold``; a class is not paired with itself."""
    spark = classes.sparkSession
    counts = spark.sparkContext.broadcast(count_sketch(classes, k))
    sig = cut(seeded(classes, counts, k, threshold))
    pairs = cut(candidates(sig, threshold))
    needed = small(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    kept = sig.select("key", "wh", "hs", "ps").join(needed, "key", "left_semi")
    side = lambda x: kept.select(F.col("key").alias(x), *[F.col(c).alias(c + x) for c in ("wh", "hs", "ps")])
    work = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for x in p.itertuples(index=False):
                wa, wb = as_hash(x.wha), as_hash(x.whb)
                _, i, j = np.intersect1d(x.hsa, x.hsb, assume_unique=True, return_indices=True)
                alike = jaccard(wa, wb, k)
                if alike < threshold:
                    continue
                pa_, pb = np.asarray(x.psa)[i], np.asarray(x.psb)[j]
                if not len(i):
                    _, pa_, pb = np.intersect1d(shingles(wa, k), shingles(wb, k), return_indices=True)
                got = sum(n for *_, n in extend(wa, wb, chain(pa_, pb)))
                out.append((x.a, x.b, len(pa_), got / len(wa), got / len(wb), alike))
            yield pd.DataFrame(out, columns=["a", "b", "seeds", "coverage_a", "coverage_b", "similarity"])

    return work.mapInPandas(
        run, "a bigint, b bigint, seeds bigint, coverage_a double, coverage_b double, similarity double"
    )


def linked_rows(left: DataFrame, right: DataFrame, id_col: str, text_col: str, act_col: str | None, k: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(rows, links): the rows (side, id, act, key) of both splits, with the class of
    equal word sequences as key, and (a, b, coverage_a, coverage_b, similarity) of the
    classes of either side that are near, a class of both sides with itself among them."""
    pick = lambda d, side: d.select(
        F.lit(side).alias("side"),
        F.col(id_col).cast("bigint").alias("id"),
        (act_id(act_col) if act_col else F.lit(None).cast("string")).alias("act"),
        F.col(text_col).alias("text"),
    )
    rows = cut(hashed(spread(pick(left, "a").unionByName(pick(right, "b"))), k))
    classes = rows.filter("key is not null").groupBy("key").agg(F.first("wh").alias("wh"), F.bool_or(F.col("side") == "a").alias("in_a"), F.bool_or(F.col("side") == "b").alias("in_b"))
    classes = cut(classes)
    one = F.lit(1.0)
    same = classes.filter("in_a and in_b").select(F.col("key").alias("a"), F.col("key").alias("b"), one.alias("coverage_a"), one.alias("coverage_b"), one.alias("similarity"))
    return rows.select("side", "id", "act", "key"), class_overlaps(classes, k, threshold).select(*same.columns).unionByName(same)


def split_overlaps(
    left: DataFrame, right: DataFrame, id_col: str, text_col: str, act_col: str | None = None, k: int = 5, threshold: float = 0.8
) -> DataFrame:
    """(id_a, id_b, same_act, coverage_a, coverage_b, similarity): rows of ``left`` and
    of ``right`` with the same act key or with texts whose Jaccard over runs of ``k``
    words reaches ``threshold``.

    Null, empty and too short texts overlap by act key alone, null and malformed act
    ids by text alone. Repeated rows are paired one by one. Only the named columns of
    either side are read. Empty sides give no pairs. Same-act pairs whose texts are
    not near have null coverage and similarity.
    """
    rows, links = linked_rows(left, right, id_col, text_col, act_col, k, threshold)
    one = lambda s: rows.filter((F.col("side") == s) & F.col("key").isNotNull()).select(F.col("key").alias(s), F.col("id").alias(f"id_{s}"))
    by_text = links.join(one("a"), "a").join(one("b"), "b").select("id_a", "id_b", "coverage_a", "coverage_b", "similarity")
    acts = lambda s: rows.filter((F.col("side") == s) & F.col("act").isNotNull()).select("act", F.col("id").alias(f"id_{s}"))
    by_act = acts("a").join(acts("b"), "act").select("id_a", "id_b", F.lit(True).alias("same_act"))
    return by_text.join(by_act, ["id_a", "id_b"], "full").select(
        "id_a", "id_b", F.coalesce("same_act", F.lit(False)).alias("same_act"), "coverage_a", "coverage_b", "similarity"
    )


def record_overlaps(
    left: DataFrame, right: DataFrame, id_col: str, text_col: str, act_col: str | None = None, k: int = 5, threshold: float = 0.8
) -> DataFrame:
    """(id, pairs, same_act, near, coverage) of every row of ``right``: with how many rows
    of ``left`` it overlaps, by act, by text and in all, and the most of its text that
    lies in one of them. No pair of rows is listed: classes and acts are counted, and
    what both ways find is counted once. Rows, nulls and texts as in split_overlaps."""
    rows, links = linked_rows(left, right, id_col, text_col, act_col, k, threshold)
    links = cut(links)
    mine, theirs = rows.filter("side = 'a'"), rows.filter("side = 'b'")
    many = lambda *by: mine.filter(" and ".join(f"{c} is not null" for c in by)).groupBy(*by).agg(F.count(F.lit(1)).alias("m"))
    acts = many("act").withColumnRenamed("m", "same_act")
    texts = links.join(many("key").withColumnRenamed("key", "a"), "a").groupBy(F.col("b").alias("key")).agg(F.sum("m").alias("near"), F.max("coverage_b").alias("coverage"))
    both = links.join(many("key", "act").withColumnRenamed("key", "a"), "a").groupBy(F.col("b").alias("key"), "act").agg(F.sum("m").alias("both"))
    x = theirs.join(acts, "act", "left").join(texts, "key", "left").join(both, ["key", "act"], "left").fillna(0, ["same_act", "near", "both", "coverage"])
    return x.select("id", (F.col("same_act") + F.col("near") - F.col("both")).alias("pairs"), "same_act", "near", "coverage")
