"""Training-data operators against brute force, and on dirty input: nulls in any column,
empty and very long texts, ties and repeated rows, empty tables, clashing names."""

import functools
import hashlib
import random
import re
import subprocess
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptoria.llm import abuse, common, leaks, mixing, near, overlap, pairs, quotas, scans, truncation
from scriptoria.llm.boost import Boosted
from scriptoria.session import checkpoint_dir

WORDS = [f"parola{i}" for i in range(400)]


def text(rng, n=120):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, t, n):
    w = t.split()
    for _ in range(n):
        i = rng.randrange(len(w))
        kind = rng.randrange(3)
        if kind == 0:
            w[i] = f"nuova{rng.randrange(999)}"
        elif kind == 1:
            w.insert(i, f"messa{rng.randrange(999)}")
        else:
            del w[i]
    return " ".join(w)


@functools.cache
def grams(t, k=3):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def jaccard(a, b, k=3):
    a, b = grams(a, k), grams(b, k)
    return len(a & b) / len(a | b) if a and b else 0.0


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    base = [text(rng, rng.choice([8, 40, 120, 300])) for _ in range(60)]
    out = list(base)
    for t in base[:40]:
        out.append(edited(rng, t, rng.randrange(1, max(2, len(t.split()) // 14))))
    w = base[50].split()
    out.append(" ".join(w[len(w) // 2 :] + w[: len(w) // 2]))  # reordered
    out += [base[0], base[0].upper(), "a b", "", None, "!!!", "x " * 30_000, base[1] + " ."]
    return list(enumerate(out))


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    el = rng.integers(1, 2**63, 300, dtype=np.int64).astype(np.uint64)
    for shared in (100, 200, 280):
        doc = np.r_[np.zeros(300, int), np.ones(300, int)]
        other = rng.integers(1, 2**63, 300 - shared, dtype=np.int64).astype(np.uint64)
        both = np.r_[el, el[:shared], other]
        sig = near.dart_signatures(both, np.ones(600), doc, 2, 2048)
        assert abs((sig[0] == sig[1]).mean() - shared / (600 - shared)) < 0.05
    wt = np.r_[np.full(300, 0.8), np.full(300, 0.4)]  # same elements, half the weight
    sig = near.dart_signatures(np.r_[el, el], wt, np.r_[np.zeros(300, int), np.ones(300, int)], 2, 2048)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.05
    assert (near.dart_signatures(el[:1], np.ones(1), np.zeros(1, int), 2, 64)[0] != 0).all()


def test_near_duplicates_equal_brute_force(spark, corpus):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in corpus], "id bigint, text string, key int, sh string")
    got = {tuple(r) for r in near.row_pairs(*near.near_duplicates(df, "id", "text", 3, 0.6)).collect()}
    want = {(i, j) for i, a in corpus for j, b in corpus if i < j and jaccard(a, b) >= 0.6}
    assert got == want and len(want) > 20


def test_groups_are_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(12)], "key bigint")
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (7, 3), (4, 5), (8, 9), (8, 10), (8, 11)], "a bigint, b bigint")
    got = dict(tuple(r) for r in near.components(nodes, links).collect())
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 7: 0, 4: 4, 5: 4, 6: 6, 8: 8, 9: 8, 10: 8, 11: 8}
    assert near.components(nodes, links.limit(0)).filter("key <> group").count() == 0


def test_a_long_chain_is_one_group(spark):
    ids = list(range(3000))
    random.Random(1).shuffle(ids)
    links = spark.createDataFrame(list(zip(ids, ids[1:])), "a bigint, b bigint")
    got = near.components(spark.createDataFrame([(i,) for i in ids], "key bigint"), links)
    assert got.filter("group <> 0").count() == 0 and got.count() == 3000


def test_groups_equal_brute_force(spark, corpus):
    """Chains of edits, whose ends are not near, and families that differ among themselves."""
    rng = random.Random(9)
    rows = [t for _, t in corpus]
    for _ in range(4):
        t = text(rng, 150)
        for _ in range(8):
            rows.append(t)
            t = edited(rng, t, 9)
    df = spark.createDataFrame(list(enumerate(rows)), "id bigint, text string")
    got = near.near_groups(df, "id", "text", 3, 0.6).collect()
    group = {i: i for i, t in enumerate(rows) if grams(t)}
    for i in group:
        for j in group:
            if i < j and group[i] != group[j] and jaccard(rows[i], rows[j]) >= 0.6:
                a, b = sorted((group[i], group[j]))
                group = {k: a if v == b else v for k, v in group.items()}
    parts = lambda pairs: sorted(sorted(v) for v in {g: [i for i, x in pairs if x == g] for _, g in pairs}.values())
    assert parts([(r["id"], r["group"]) for r in got]) == parts(list(group.items()))


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold, in short and long texts, of which two in five share
    a preamble with all others: what brute force finds both operators find."""
    rng = random.Random(31)
    left, right, common_ = [], [], text(rng, 30)
    for i in range(150):
        n = rng.choice([10, 25, 60, 150, 300])
        a = (common_ + " " if i % 5 < 2 else "") + text(rng, n)
        want = rng.uniform(0.60, 0.72)
        b = a
        while jaccard(a, c := edited(rng, b, 1)) >= want:
            b = c
        left.append((i, a))
        right.append((1000 + i, b))
    make = lambda rows: spark.createDataFrame(rows, "id bigint, text string")
    near_ = lambda a, b: min(len(a), len(b)) >= 0.6 * max(len(a), len(b)) and len(a & b) >= 0.375 * (len(a) + len(b)) > 0
    pairs_ = lambda xs, ys: {(i, j) for i, a in xs for j, b in ys if i < j and near_(grams(a), grams(b))}
    over = {(r["id_a"], r["id_b"]) for r in overlap.split_overlaps(make(left), make(right), "id", "text", None, 3, 0.6).collect()}
    assert over == pairs_(left, right) and len(over) >= 150
    both = left + right
    found = {tuple(r) for r in near.row_pairs(*near.near_duplicates(make(both), "id", "text", 3, 0.6)).collect()}
    want = pairs_(both, both)
    assert found <= want and len(found) >= 0.995 * len(want)


def test_near_duplicates_take_little_disk(spark):
    """What is left in the checkpoint folder and of shuffles is bounded by the texts: sets
    of shingles, written for every row, class and pair, were several times as large."""
    rng = random.Random(12)
    rows = [text(rng, 150) for _ in range(1500)]
    rows += [edited(rng, t, 4) for t in rows[:300]] + rows[:50]
    df = spark.createDataFrame(list(enumerate(rows)), "id bigint, text string").repartition(4)
    jvm = spark.sparkContext._jvm
    folders = [*jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString(), checkpoint_dir(spark).removeprefix("file:")]
    used = lambda: int(subprocess.run(["du", "-scb", *folders], capture_output=True, text=True).stdout.split()[-2])
    jvm.System.gc()
    time.sleep(2)
    before = used()
    m, links = near.near_duplicates(df, "id", "text", 3, 0.6)
    assert near.row_pairs(m, links).count() >= 300
    assert used() - before < 3 * sum(map(len, rows))


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, None)], "id bigint, text string")
    for x in (df, df.limit(0)):
        m, links = near.near_duplicates(x, "id", "text")
        assert m.count() == 0 and links.count() == 0


def test_split_overlaps_equal_brute_force(spark, corpus):
    left, right = corpus[:60], [(1000 + i, t) for i, t in corpus[50:]]
    make = lambda rows: spark.createDataFrame([(i, t, None if i % 9 == 0 else f" 0{i % 25} ", "s", 1) for i, t in rows], "id bigint, text string, act string, side string, h int")
    got = overlap.split_overlaps(make(left), make(right), "id", "text", "act", 3, 0.6).collect()
    by_text = {(r["id_a"], r["id_b"]) for r in got if r["similarity"] is not None}
    assert by_text == {(i, j) for i, a in left for j, b in right if jaccard(a, b) >= 0.6}
    by_act = {(r["id_a"], r["id_b"]) for r in got if r["same_act"]}
    assert by_act == {(i, j) for i, _ in left for j, _ in right if i % 9 and j % 9 and i % 25 == j % 25}
    assert len(got) == len(by_text | by_act)
    for r in overlap.record_overlaps(make(left), make(right), "id", "text", "act", 3, 0.6).collect():
        mine = [x for x in got if x["id_b"] == r["id"]]
        assert (r["pairs"], r["same_act"], r["near"]) == (len(mine), sum(x["same_act"] for x in mine), sum(x["similarity"] is not None for x in mine))
        assert r["coverage"] == max([x["coverage_b"] or 0 for x in mine], default=0)
    empty = make(left).limit(0)
    assert overlap.record_overlaps(empty, make(right), "id", "text", "act").filter("pairs > 0 or coverage > 0").count() == 0
    assert overlap.split_overlaps(empty, make(right), "id", "text", "act").count() == 0


def test_split_overlaps_of_reordered_sentences(spark):
    rng = random.Random(21)
    left, right = [], []
    for i in range(8):
        parts = [text(rng, 8) for _ in range(20)]
        left.append((i, " ".join(parts)))
        right.append((i, " ".join(rng.sample(parts, 20))))
    other = [(50 + i, text(rng, 160)) for i in range(8)]
    make = lambda rows: spark.createDataFrame(rows, "id bigint, text string")
    got = overlap.split_overlaps(make(left + other), make(right), "id", "text", None, 3, 0.6).collect()
    assert {(r["id_a"], r["id_b"]) for r in got} == {(i, j) for i, a in left + other for j, b in right if jaccard(a, b) >= 0.6} != set()
    assert all(r["coverage_a"] > 0 for r in got)


def test_winnowing_guarantee():
    rng = np.random.default_rng(5)
    for _ in range(50):
        run = rng.integers(0, 2**63, overlap.WINDOW, dtype=np.int64).astype(np.uint64)
        sides = [np.r_[rng.integers(0, 2**63, 20, dtype=np.int64).astype(np.uint64), run, rng.integers(0, 2**63, 9, dtype=np.int64).astype(np.uint64)] for _ in range(2)]
        kept = [set(s[overlap.winnow(s, common.mix(s))].tolist()) for s in sides]
        assert kept[0] & kept[1] & set(run.tolist())


def test_leaks_equal_brute_force(spark):
    rng = random.Random(11)
    items = [(i, text(rng, 60)) for i in range(12)] + [(90, "troppo corto"), (91, None)]
    docs = []
    for i in range(60):
        t = text(rng, 80).split()
        n = rng.choice([0, 15, 19, 20, 21, 35])
        src = items[rng.randrange(12)][1].split()
        a = rng.randrange(0, len(src) - n)
        docs.append((i, " ".join(t[:30] + src[a : a + n] + t[30:])))
    src = items[0][1].split()
    noisy = " ".join(src[5:30]).upper().replace(" ", ",  ")
    docs += [(100, "prima " + noisy), (101, "prima " + " ".join(src[:12]) + " paro-\nla12 " + " ".join(src[12:31])), (102, None), (103, ""), (104, " ".join(src[20:41] + src[:20])), (104, " ".join(src[20:41] + src[:20]))]
    d = spark.createDataFrame([(i, t, 7, "q") for i, t in docs], "doc_id bigint, text string, item_id int, coverage string")
    it = spark.createDataFrame(items, "item_id bigint, brano string")
    got = [(r["doc_id"], r["item_id"]) for r in leaks.leaked(d, "doc_id", "text", it, "item_id", "brano").collect()]

    def holds(doc, item):
        flat = re.sub(r"[\W_]+", "", (doc or "").lower())
        w = (item or "").split()
        return any("".join(w[j : j + 20]) in flat for j in range(len(w) - 19))

    want = sorted((i, j) for i, t in docs for j, b in items if holds(t, b))
    assert sorted(got) == want and len(want) > 15
    inside = "il" + " ".join(src[:20]) + "x poi"  # the first and the last word belong to other words
    more = spark.createDataFrame([(1, "in " + inside), (2, "in " + inside.replace("il" + src[0], "il " + src[0]).replace("x poi", " poi")), (3, "in il" + " ".join(src[:21]) + " poi")], "doc_id bigint, text string")
    assert {r["doc_id"] for r in leaks.leaked(more, "doc_id", "text", it, "item_id", "brano").collect()} == {2, 3}
    half = {(r["doc_id"], r["item_id"]) for r in leaks.leaked(d, "doc_id", "text", it, "item_id", "brano", coverage=0.5).collect()}
    assert half == {(r["doc_id"], r["item_id"]) for r in leaks.leaked(d, "doc_id", "text", it, "item_id", "brano").collect() if r["words"] >= 30} and (104, 0) in half
    tiles = leaks.leaked(d.filter("doc_id = 104"), "doc_id", "text", it.filter("item_id = 0"), "item_id", "brano").first()
    assert tiles["tiles"] == 2 and tiles["words"] == 41
    assert leaks.leaked(d.limit(0), "doc_id", "text", it, "item_id", "brano").count() == 0
    assert leaks.leaked(d, "doc_id", "text", it.limit(0), "item_id", "brano").count() == 0


def test_leaks_of_many_items_are_joined(spark, monkeypatch):
    rng = random.Random(2)
    items = [(i, text(rng, 40)) for i in range(9)] + [(50, None), (51, "corto")]
    docs = [(i, "zzz " + (t or "") + " " + text(rng, 50)) for i, t in items] + [(60, items[1][1][:150] + " zzz " + items[2][1]), (60, "niente"), (61, None), (None, items[0][1])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    it = spark.createDataFrame(items, "item_id bigint, brano string")
    look = lambda it=it: sorted(tuple(r) for r in leaks.leaked(d, "doc_id", "text", it, "item_id", "brano").collect() if r["doc_id"] is not None)
    whole = look()
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 700)
    monkeypatch.setattr(leaks, "SIEVE_BITS", 12)  # a full sieve costs time, no row
    assert look() == whole and len(whole) >= 10
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 3)
    assert look(it.filter("item_id > 9")) == []


def test_quota_sample_is_exact(spark):
    rows = spark.createDataFrame([(i % 900, "abc"[min(2, i % 7)], 5, 6) for i in range(2000)], "id bigint, lab string, u int, bin int")
    quota = spark.createDataFrame([(1, "a", 50, 10, 50), (1, "b", 40, 10, 50), (1, "c", 10, 10, 50), (1, "manca", 0, 3, 50), (2, "a", 100, 1, 90)], "campagna_id bigint, golden_label string, quota_pct int, minimo int, frazione_pct int")
    t = quotas.quota_targets(rows, "lab", quota)
    by = {(r["campagna_id"], r["golden_label"]): r for r in t.collect()}
    assert by[1, "a"]["needed"] == 500 and by[1, "a"]["usable"] == 286
    report = {(r["campagna_id"], r["golden_label"]): (r["drawn"], r["deficit"]) for r in quotas.quota_report(rows, "id", "lab", t).collect()}
    assert report[1, "manca"] == (0, 3) and report[1, "a"] == (286, 214) and report[1, "b"] == (by[1, "b"]["target"], by[1, "b"]["needed"] - by[1, "b"]["target"])
    got = {(r[0], r[1]): r[2] for r in quotas.quota_sample(rows, "id", "lab", t).groupBy("campagna_id", "golden_label").count().collect()}
    assert got == {k: r["target"] for k, r in by.items() if r["target"]}
    again = quotas.quota_sample(rows, "id", "lab", t)
    assert again.exceptAll(quotas.quota_sample(rows, "id", "lab", t)).count() == 0
    empty = quotas.quota_targets(rows.limit(0), "lab", quota)
    assert quotas.quota_sample(rows.limit(0), "id", "lab", empty).count() == 0 and quotas.quota_report(rows.limit(0), "id", "lab", empty).filter("deficit = minimo").count() == 5


@pytest.mark.parametrize("bins", [1, 4, 4096])
def test_quota_sample_takes_the_least_draws(spark, monkeypatch, bins):
    monkeypatch.setattr(quotas, "BINS", bins)
    rows = spark.createDataFrame([(i, "abc"[min(2, i % 7)]) for i in range(500)] + [(None, "a"), (None, "a")], "id bigint, lab string")
    quota = spark.createDataFrame([(1, "a", 10, 1, 90), (1, "b", 3, 1, 90), (1, "c", 40, 1, 90), (2, "a", 7, 1, 50)], "campagna_id bigint, golden_label string, quota_pct int, minimo int, frazione_pct int")
    t = quotas.quota_targets(rows, "lab", quota)
    got = sorted(map(tuple, quotas.quota_sample(rows, "id", "lab", t).collect()), key=str)
    want = []
    for q in t.collect():
        ids = [r["id"] for r in rows.filter(F.col("lab") == q["golden_label"]).collect()]
        u = lambda i: hashlib.md5(f"quote:{q['campagna_id']}:{'' if i is None else i}".encode()).hexdigest()[:13]  # noqa: B023, E731
        want += [(q["campagna_id"], q["golden_label"], i) for i in sorted(ids, key=lambda i: (u(i), i or -1))[: q["target"]]]
    assert got == sorted(want, key=str) and got


def test_mix(spark):
    docs = spark.createDataFrame([(i, None if i == 5 else "parola " * (1 + i % 5), [" Albo Pretorio", "ALBO_PRETORIO", "forum", None][i % 4], 1) for i in range(400)], "doc_id bigint, text string, source string, rate int")
    w = spark.createDataFrame([(1, "albo_pretorio", 60, 2, 100), (1, "forum", 40, 1, 100), (2, "assente", 10, 5, 50), (3, "forum", 30, 4, 200)], "miscela_id bigint, source string, peso_pct int, max_ripetizioni int, dimensione_pct int")
    counted = mixing.counted_documents(docs)
    e = mixing.encoder()
    assert counted.agg(F.sum("tokens")).first()[0] == sum(len(e.encode_ordinary("parola " * (1 + i % 5))) for i in range(400) if i != 5)
    rates = mixing.mix_rates(counted, w)
    mixed = mixing.mixed(counted, rates)
    got = mixing.mix_shares(counted, rates).collect()
    assert sorted((r["miscela_id"], r["source"]) for r in got if r["short"]) == [(1, "forum"), (2, "assente")]
    copies, want = {(r[0], r[1], r[2]): r[3] for r in mixed.groupBy("miscela_id", "source", "doc_id").count().collect()}, {}
    for r in rates.filter("rate > 0").collect():
        for doc in counted.filter(F.col("source") == r["key"]).collect():
            u = int(hashlib.md5(f"miscela:{r['miscela_id']}:{doc['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
            want[r["miscela_id"], r["source"], doc["doc_id"]] = int(r["rate"]) + (u < r["rate"] % 1)
    assert copies == {k: n for k, n in want.items() if n}
    for r in got:
        if not r["short"] and r["wanted_tokens"]:
            assert abs(r["drawn_tokens"] - r["wanted_tokens"]) < 0.15 * r["wanted_tokens"]
    assert mixed.groupBy("miscela_id", "source", "doc_id").count().filter("count > 4").count() == 0
    none = mixing.counted_documents(docs.limit(0))
    assert mixing.mix_shares(none, mixing.mix_rates(none, w)).filter("short").count() == 0 and mixing.mixed(none, mixing.mix_rates(none, w)).count() == 0


@pytest.mark.parametrize(
    ("t", "kind"),
    [
        (None, "blank"), ("  \n", "blank"), ("Fine della frase.", "closed"), ("Davvero?", "closed"), ("(come sopra.)", "closed"), ("a favore del comune;", "closed"),
        ("la nota prot.", "dangling"), ("presieduta da G.", "dangling"), ("ai sensi dell'art.", "dangling"), ("somma di euro 12.", "doubtful"), ("il tecnico,", "dangling"),
        ("sotto la [...]", "dangling"), ("sotto la…", "dangling"), ("Fine. [...]", "closed"), ("Letto, confermato e sottoscritto", "open"), ("si rende necess", "open"), ("nota n. 41.", "closed"),
    ],
)
def test_endings(t, kind):
    assert truncation.ending(t)[0] == kind


def test_truncated_texts(spark):
    rng = random.Random(4)
    phrase = lambda: f"Il comune di {rng.choice(WORDS)} approva la spesa di euro {rng.randrange(99)},00 per {rng.choice(WORDS)}."
    rows = []
    for i in range(300):
        t = " ".join(phrase() for _ in range(rng.randrange(3, 9)))
        if i % 3 == 0 and len(t) > 300:
            t = t[:300]
        elif i % 7 == 0:
            t += " Il Segretario Comunale"
        rows.append((i, t, "s1" if i % 2 else None, i))
    rows += [(900, None, "s1", 1), (901, "", "s1", 1), (902, "parola " * 40_000 + "fine.", "s1", 1)]
    df = spark.createDataFrame(rows, "id bigint, text string, source string, kind int")
    got = {r["id"]: r["cut"] for r in truncation.truncated(df, "id", "text", "source").collect()}
    for i, t, *_ in rows:
        assert got[i] == bool(t and not t.endswith(".") and not t.endswith("Comunale")), t[-40:]
    assert truncation.truncated(df.limit(0), "id", "text", "source").count() == 0


def test_copies_of_a_cut_text_make_no_formula(spark):
    rng = random.Random(8)
    phrase = lambda: f"Il comune di {rng.choice(WORDS)} approva la spesa di euro {rng.randrange(99)},00 per {rng.choice(WORDS)}."
    texts = [" ".join(phrase() for _ in range(rng.randrange(3, 9))) for _ in range(60)]
    inside = texts[0] + " Si dispone la liquidaz"  # cut inside a word, of which an intact copy goes on
    between = texts[1] + " Si dispone la spesa"  # cut after a whole word
    signed = [t + " Il Segretario Comunale" for t in texts[2:6]]
    rows = [inside] * 30 + [between] * 3 + [inside + "ione della spesa."] * 3 + signed + [t + " Il Presidente" for t in texts[6:10]] + texts[10:] + ["Il segretario comunale riferisce."] * 2 + [f"Il sindaco sente il segretario comunale {w}." for w in WORDS[:3]]
    rows += [f"Prima nota {w}. {between}" for w in WORDS[:3]]  # near copies, equal before the cut
    rows += [phrase() + " Si trasmette al compet" for _ in range(4)] + ["Si trasmette al competente ufficio."]  # texts of their own, no whole last word
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(rows)], "id bigint, text string, source string")
    got = {r["id"]: r["cut"] for r in truncation.truncated(df, "id", "text", "source").collect()}
    for i, t in enumerate(rows):
        assert got[i] == (not t.endswith((".", "Comunale", "Presidente"))), t[-40:]


def test_the_posterior_decides_an_unknown_closing_fragment(spark):
    """A fragment that many texts end with is a closing formula away from any limit, and a
    cut where the text is as long as the texts that were cut at a limit."""
    rng = random.Random(12)
    phrase = lambda: f"Il comune di {rng.choice(WORDS)} approva la spesa di euro {rng.randrange(99)},00 per {rng.choice(WORDS)}."
    make = lambda: " ".join(phrase() for _ in range(rng.randrange(3, 9)))
    closing = " Tutti gli uffici ringraziano"
    rows = [t for t in (make() for _ in range(300)) if len(t) != 300]
    limited = [t[:300] for t in (make() + " " + make() for _ in range(400)) if t[299].isalpha() and t[298].isalpha()][:60]
    signed = [t + closing for t in (make() for _ in range(40)) if abs(len(t + closing) - 300) > 40][:14]
    other = [f"Essi ringraziano {w} e {phrase()}" for w in WORDS[:6]]
    t = make() + make() + make()
    at_limit = t[: 300 - len(closing) - 1] + "." + closing
    assert len(at_limit) == 300
    texts = rows + limited + signed + other + [at_limit]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "id bigint, text string, source string")
    got = {r["id"]: r for r in truncation.truncated(df, "id", "text", "source").collect()}
    for i, t in enumerate(texts[:-1]):
        assert got[i]["cut"] == (i >= len(rows) and not t.endswith((".", closing))), t[-40:]
    last = got[len(texts) - 1]
    assert last["form"] == "frequent" and last["posterior"] > 0.9 and last["cut"] and not last["unaided"]


def test_censored_fit_recovers_the_distribution():
    rng = np.random.default_rng(0)
    x = np.exp(rng.normal(6.5, 0.4, 20_000))
    y = np.minimum(x, 900).astype(int)
    v, n = np.unique(y, return_counts=True)
    mu, sd = truncation.fit_censored(v.astype(float), n.astype(float), np.where(v == 900, 0.99, 0.0))
    assert abs(mu - 6.5) < 0.02 and abs(sd - 0.4) < 0.02
    assert [(a, round(p, 1)) for a, _, _, p in truncation.limits_of(v, n) if a == 900] == [(900, 1.0)]
    ended = np.where(v == 900, n, 0)  # a length that only complete texts have is no limit
    assert not [a for a, *_ in truncation.limits_of(v, n, ended) if a == 900]


REQ = "Quale ufficio se ne occupa?\n\nCOMUNE DI PROVA ORDINANZA n. 41 del 3 marzo 2020. OGGETTO: pulizia - fontana di via Rossi, incarico annuale. Se ne occupa il Settore Tecnico del comune di Prova."
SUM = REQ.replace("Quale ufficio se ne occupa?", "Scrivi una breve sintesi dell'atto.")


@pytest.mark.parametrize(
    ("answer", "request_", "want"),
    [
        (None, REQ, "vuota"), (" ​", REQ, "vuota"), ("N/D", REQ, "vuota"), ("```\n```", REQ, "vuota"),
        ("Mi dispiace, non posso aiutarti con questa richiesta.", REQ, "rifiuto"), ("ERRORE_LINGUA_NON_ITALIANA", REQ, "rifiuto"), ("I'm sorry, but I can't help with that.", REQ, "rifiuto"),
        ("Il comune comunica di non essere in grado di rispondere entro i termini.", SUM, None),
        ("The council approved the budget for the bridge and the road.", SUM, "altra_lingua"), ("Ecco il riassunto: Die Kosten der Schule trägt die Gemeinde im Jahr 2020.", SUM, "altra_lingua"),
        ("Quale ufficio se ne occupa?", REQ, "copia"), ("Testo: " + REQ.split("\n\n")[1].upper(), REQ, "copia"),
        ("Settore Tecnico", REQ, None), ("Settore Tecnico.", REQ, None), ("41", REQ, None), ("Settore Tecn", REQ, "troncata"), ("L'atto riguarda la pulizia della font", SUM, "troncata"),
        ("L'atto riguarda la pulizia.", SUM, None), ("L'atto riguarda la pulizia.", None, None),
    ],
)
def test_pair_defects(answer, request_, want):
    known = {w for q in (REQ, SUM) for w in re.findall(r"\w+", q.lower())}
    got = pairs.defect(answer, request_)
    if got and got.startswith("troncata?"):
        got = None if got[9:] in known else "troncata"
    assert got == want


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ("Grazie per la domanda. Non posso rispondere.", True), ("Temo di non poterti aiutare.", True), ("Rifiuto di rispondere.", True), ("Questa richiesta esula dalle mie competenze.", True),
        ("La risposta non può essere fornita.", True), ("Tyvärr kan jag inte svara. Jag kan inte hjälpa till.", True), ("Niestety nie mogę odpowiedzieć.", True), ("Mi spiace, non riusciamo ad aiutarla.", True),
        ("Buongiorno. Ho letto il testo. Non mi è possibile rispondere. Provi più tardi.", True),
        ("Il testo non consente deroghe: la richiesta presentata non può essere accolta e il comune conferma l'appalto.", False), ("Il comune comunica di non essere in grado di rispondere entro i termini.", False),
        ("Il comune approva la spesa per la scuola e per il ponte di via Rossi. Non è possibile presentare nuove domande.", False), ("La domanda non può essere presentata dopo il 3 marzo.", False), ("È vietato sostare in via Rossi.", False),
        ("Il comune approva la spesa per la scuola e affida i lavori. " * 3 + "Non posso aggiungere altro.", False),
    ],
)
def test_refusals_anywhere(answer, want):
    assert pairs.refused(answer) == want


def test_unlisted_languages(spark):
    rng = random.Random(5)
    parts = "Il comune approva la spesa per la scuola|La giunta affida i lavori della strada alla ditta|Visto il regolamento si dispone la chiusura del ponte|Il settore tecnico provvede entro il termine|Considerato che le domande sono state esaminate dalla commissione|Si autorizza la manutenzione dell'impianto di illuminazione".split("|")
    act = lambda: ". ".join(rng.sample(parts, 4)) + f" numero {rng.randrange(99)}."
    foreign = ["Kommunen har godkänt budgeten för vägen och skolan under nästa år.", "Rada miejska zatwierdziła budżet na remont drogi i szkoły w przyszłym roku.", "Ecco il riassunto: Városi tanács jóváhagyta a következő évi költségvetést.", "The council approved the budget for the bridge and the road."]
    good = ["Il comune dispone la manutenzione della strada e affida i lavori alla ditta.", "La commissione ha esaminato le domande per la scuola.", "Si tratta della chiusura del ponte."]
    rows = [(i, "Scrivi una sintesi dell'atto.\n\n" + act(), a) for i, a in enumerate(foreign + good + [None])]
    rows += [(100 + i, "Scrivi una sintesi dell'atto.\n\n" + act(), "La giunta affida i lavori.") for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, q string, a string")
    got = dict(map(tuple, pairs.defective_pairs(df, "id", "q", "a").collect()))
    assert got == {**{i: "altra_lingua" for i in range(len(foreign))}, len(foreign) + len(good): "vuota"}


def test_copies_with_edits_everywhere():
    """An edit in every eleventh word leaves few runs of words, and yet a copy."""
    rng = random.Random(3)
    w = text(rng, 110).split()
    edited_ = [f"altro{i}" if i % 11 == 10 else x for i, x in enumerate(w)]
    assert pairs.copied(" ".join(edited_), "Riassumi.\n\n" + " ".join(w)) and not pairs.copied(text(rng, 110), "Riassumi.\n\n" + " ".join(w))


def test_pair_table(spark):
    df = spark.createDataFrame([(1, REQ, None, "x"), (1, REQ, None, "x"), (2, None, "Va bene.", None), (3, REQ, "parola " * 50_000 + "fine.", "y")], "id bigint, q string, a string, difetto string")
    assert sorted(map(tuple, pairs.defective_pairs(df, "id", "q", "a").collect())) == [(1, "vuota"), (1, "vuota")]
    assert pairs.defective_pairs(df.limit(0), "id", "q", "a").count() == 0


def test_lcs():
    rng = random.Random(1)
    for _ in range(30):
        a, b = [[rng.choice("abc") for _ in range(rng.randrange(0, 12))] for _ in range(2)]
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        assert pairs.lcs(a, b) == d[-1][-1]


def test_abuse_on_held_out_documents(spark, sf):
    """Fit on half of the labelled documents of a table; sentences of abuse are planted in
    documents of the other half, and all of them must be found, and nearly nothing else."""
    rng = random.Random(6)
    calm = ["Chiedo un sopralluogo in via Rossi.", "La seduta è sospesa alle ore dieci.", "Il bando scade il 3 marzo 2020.", "Ringrazio lo sportello per la risposta.", "È vietato gettare rifiuti nel parco."]
    bad = ["Siete una banda di coglioni.", "Ti spacco la faccia, idiota.", "Quella gente è feccia, fuori dal paese.", "Mandami una foto nuda stasera."]
    disguised = ["Siete una banda di c0gl10ni.", "Siete una banda di cogliooooni.", "Ti spacco la faccia, id!ota.", "Siete una banda di c o g l i o n i."]
    docs, labels = [], []
    for i in range(400):
        s = [rng.choice(calm) for _ in range(6)]
        if i % 10 == 0:
            s.insert(rng.randrange(6), rng.choice(bad if i < 200 else bad + disguised))
        docs.append((i, " ".join(s), "Forum ", i))
        if i < 200:
            labels.append((i, int(i % 10 == 0) if i % 50 != 1 else 1))  # some labels err
    docs += [(800, "Coglione!", "x", 1), (801, "La seduta è sospesa. Coglioni! Il bando scade il 3 marzo 2020.", "x", 1), (802, "Grazie!", "x", 1)]
    docs += [(900, None, None, 1), (901, "", "x", 1), (901, "", "x", 1), (902, "Il bando scade. " * 20_000, "x", 1)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, score int")
    got = abuse.abusive(d, spark.createDataFrame(labels, "doc_id bigint, tossico int")).collect()
    found = {r["doc_id"] for r in got if r["tossico"]}
    assert found == {*range(0, 400, 10), 800, 801} and len(got) == len(docs)
    assert {r["source"] for r in got} == {"forum", None, "x"}
    none = abuse.abusive(d.limit(0), spark.createDataFrame([], "doc_id bigint, tossico int"))
    assert none.count() == 0


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(2)
    seqs = [list(rng.integers(1, 9, 12)) for _ in range(40)]
    shared = np.r_[0.0, np.full(9, 1 / 9)]
    m = abuse.KneserNey(seqs, 10, shared)
    for u, v in ((1, 2), (3, 4), (0, 5)):
        w = np.arange(10)
        p = np.exp(m.log3(np.full(10, u), np.full(10, v), w)[1:])
        assert abs(p.sum() - 1) < 1e-6


def test_boosted_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = (x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)
    m = Boosted.load(Boosted(60, 3).fit(x[:1000], y[:1000]).dump())
    assert ((m.predict(x[1000:]) > 0.5) == y[1000:]).mean() > 0.97


def test_reading_distance():
    assert scans.reading_distance("coinune", "comune") == pytest.approx(0.3) and scans.reading_distance("comurne", "comurne") == 0
    assert scans.reading_distance("uff!cio", "ufficio") == pytest.approx(0.3) and scans.reading_distance("xa", "ya") == 1
    assert scans.edits("abc", "abd") == 1 and scans.edits("abc", "xyzuvw") == 4
    rng = random.Random(2)
    for _ in range(300):
        a, b = ["".join(rng.choice("abc ") for _ in range(rng.randrange(0, 14))) for _ in range(2)]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        for most in (0, 1, 3, 20):
            assert scans.edits(a, b, most) == min(row[-1], most + 1)


def test_running_lines_of_any_length_and_misread_words():
    head = "Comune di Prova - Settore Affari Generali e Contratti - " + "ufficio protocollo e archivio storico " * 4
    lines = [head + "di sede", "testo della prima pagina che va", head + "di sede", "avanti senza fine e poi"]
    assert len(head) > 160 and set(scans.alike_lines(lines, set())) == {0, 2}
    words_ = "alfa beta gamma delta epsilon zeta eta theta iota kappa".split()
    other = [w[:-1] + "x" if i < 5 else w for i, w in enumerate(words_)]  # the five rarest words misread
    common_ = [f"{' '.join(words_[5:])} {i} righe diverse in tutto" for i in range(6)]
    got = scans.alike_lines([" ".join(words_), *common_, " ".join(other)], set())
    assert {0, 7} <= set(got)


def test_misread_figures_are_mended():
    rows = [{"line": "La spesa è di euro 2O24,5O per il 2Ol9, codice ABC12DEF9.", "kind": "corpo", "hyphen": None}]
    assert scans.paragraphs(rows, {}) == "La spesa è di euro 2024,50 per il 2019, codice ABC12DEF9."


def test_scans_round_trip(spark):
    """Clean acts are set in pages with headers, page numbers, divided and misread words;
    what was done to each line must be found again."""
    rng = random.Random(8)
    vocab = "comune settore ufficio tecnico determina approva somma bilancio capitolo responsabile procedimento affidamento servizio manutenzione ordinaria strada pubblica illuminazione progetto esecutivo incarico professionista termine giorni pagamento fattura controllo verifica relazione".split()
    vocab += [a + b for a in ("in", "pro", "con", "ri", "di", "tras") for b in ("dotto", "scritto", "tenuto", "posto", "corso", "messo")]
    clean, txts, truth = [], [], set()
    sentence = lambda: " ".join(rng.choice(vocab) for _ in range(rng.randrange(9, 16))).capitalize() + "."
    for i in range(40):
        clean.append((i, " ".join(sentence() for _ in range(30))))
        lines, page, n = [], 1, 0
        words = " ".join(sentence() for _ in range(24)).split()
        while words:
            if n % 12 == 0:
                lines.append(f"Comune di Prova {chr(65 + i % 26)}lta - Ufficio Contratti")
                truth.add((i, len(lines), "intestazione"))
            line = []
            while words and sum(map(len, line)) + len(line) < 50:
                line.append(words.pop(0))
            if rng.random() < 0.2 and len(line[-1]) > 8 and line[-1].isalpha() and words:
                words.insert(0, line[-1][5:])
                line[-1] = line[-1][:5] + "-"
                truth.add((i, len(lines) + 1, "sillabazione"))
            elif rng.random() < 0.2 and len(line) > 1 and len(line[1]) > 6 and "i" in line[1][1:-1]:
                line[1] = line[1][0] + line[1][1:].replace("i", "!", 1)
                truth.add((i, len(lines) + 1, "carattere"))
            lines.append(" ".join(line))
            n += 1
            if n % 12 == 0:
                lines += ["", f"Pag. {page}", ""]
                truth.add((i, len(lines) - 1, "numero_pagina"))
                page += 1
        txts.append((i, page, "\n".join(lines), "x"))
    txts += [(90, None, None, "y"), (91, 1, "", None), (92, 0, "\n \n", None)]
    t = spark.createDataFrame(txts, "txt_id bigint, num_pagine int, txt string, kind string")
    c = spark.createDataFrame(clean, "id bigint, testo string")
    r = scans.Repaired(t, c, "testo")
    got = {tuple(x) for x in r.found().collect()}
    for kind in ("intestazione", "numero_pagina", "sillabazione", "carattere"):
        a, b = {x for x in got if x[2] == kind}, {x for x in truth if x[2] == kind}
        assert len(a & b) >= 0.9 * len(b) and len(a & b) >= 0.9 * len(a), (kind, len(a), len(b), len(a & b))
    out = dict(map(tuple, r.text().collect()))
    assert "Ufficio Contratti" not in out[0] and "Pag." not in out[0] and "!" not in out[0]
    empty = scans.Repaired(t.limit(0), c, "testo")
    assert empty.found().count() == 0 and empty.text().count() == 0
    assert scans.Repaired(t, c.limit(0), "testo").found().filter("difetto = 'numero_pagina'").count() == len([x for x in truth if x[2] == "numero_pagina"])


def test_copies_of_a_scan_make_no_vocabulary(spark):
    rng = random.Random(17)
    clean = [(i, "della delibera del consiglio " + text(rng, 30)) for i in range(40)]
    one = "una prova con provvedlmento " + text(rng, 40)
    txts = [(i, one, None) for i in range(30)]  # copies of one scan
    txts += [(100 + i, f"zzqwx {text(rng, 40)}", "7") for i in range(8)]  # windows of one act
    txts += [(200 + i, f"dclla giunta {text(rng, 40)}", str(50 + i)) for i in range(6)]  # a common misreading
    txts += [(300 + i, f"protocollo {text(rng, 40)}", str(90 + i)) for i in range(6)]  # a word that only scans have
    t = spark.createDataFrame(txts, "txt_id bigint, txt string, id_atto string")
    c = spark.createDataFrame(clean, "id bigint, testo string")
    body = t.select("txt_id", F.split("txt", " ").alias("words"))
    w = {r["w"] for r in scans.vocabulary(c, "testo", body, t).collect()}
    assert {"della", "protocollo", "giunta"} <= w and not {"provvedlmento", "zzqwx", "dclla"} & w
