"""Collocations, ranked search and the Jaccard join against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from contourlake.llm import collocations, jaccard, ranking

ODD = [(1, None, None), (1, "", "en"), (None, "a b", "en"), (2, " \n\t", "de"), (2, " \n\t", "de"), (3, "é" * 40_000, "fr"), (4, "Word next. " * 9_000, "en"), (5, "a a a a", None), (5, "a a a a", None)]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(rnd, words, vocabulary=40):
    return "".join(rnd.choice([" ", " ", " ", "  ", ". ", "\t", "\n", ", "]) + f"w{min(rnd.randrange(vocabulary), rnd.randrange(vocabulary))}" for _ in range(words))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    return ODD + [(i, prose(rnd, rnd.randrange(0, 160)), rnd.choice(["en", "de", None, "und"])) for i in range(10, 120)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 5, "x", 1.5) for r in rows], "doc_id long, text string, lang string, n long, phrase string, score double").repartition(5)


# collocations


def brute_collocations(rows, min_count, max_words, keep, cover):
    out = []
    by_lang = defaultdict(Counter)
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            ws = re.findall("[^ \t]+", piece)
            for k in range(1, max_words + 1):
                by_lang[lang or "und"].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    for lang, f in by_lang.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        cand = {p: v for p, v in f.items() if len(p) > 1 and v >= min_count}
        found = []
        most = Counter()
        for q, v in cand.items():
            for size in range(2, len(q)):
                for i in range(len(q) - size + 1):
                    most[q[i : i + size]] = max(most[q[i : i + size]], v)
        for p, a in cand.items():
            if most[p] and 100 * most[p] >= cover * a:
                continue
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:keep], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


@pytest.mark.parametrize(("min_count", "max_words", "keep", "cover", "block"), [(10, 3, 2000, 50, 16 << 20), (3, 4, 30, 80, 20_000)])
def test_collocations(docs, rows, min_count, max_words, keep, cover, block):
    got = collocations.collocations(docs, min_count=min_count, max_words=max_words, keep=keep, cover=cover, block_bytes=block)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, min_count, max_words, keep, cover)


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None), ("en", "a b")], "lang string, text string")).collect() == []


def test_scores_beyond_64_bits(spark):
    counts = [(10**14, 10**14, 10**14), (999_999_999_999_999, 10**15 - 1, 10**15 - 1), (3, 7, 11), (123_456_789_012_345, 234_567_890_123_456, 345_678_901_234_567)]
    rows = spark.createDataFrame(counts, "f long, l long, r long")
    got = [tuple(r) for r in rows.select("f", "l", "r", collocations._score(rows.f, rows.l, rows.r)).collect()]
    assert got == [(f, a, b, 10**6 * f * f // (a * b)) for f, a, b in counts]


# ranked search


def brute_search(docs, items, k):
    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower(t))
    split = [(d, Counter(find(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in split]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in split for t in c)
    out = []
    for item, text in items:
        found = []
        for (doc, counts), n in zip(split, sizes):
            score = 0
            for t in set(find(text)) & set(counts):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 50 + 50 * n * n_docs // n_terms
                score += w * (10**9 * counts[t] // (1000 * counts[t] + 20 * m))
            if score > 0:
                found.append((-score, doc if doc is not None else -(2**63), doc))
        out += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(sorted(found, key=lambda r: r[:2])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard", "query_bytes", "k"), [(32 << 20, 16 << 20, 50), (9000, 30_000, 3)])
def test_search(spark, docs, rows, shard, query_bytes, k):
    rnd = random.Random(3)
    items = [("i0", None), ("i1", ""), ("i2", "w1 w1 W2"), ("i2", "w1 w1 W2"), (None, "w3"), ("i3", "zzz é"), ("i4", "é" * 40_000)]
    items += [(f"j{i}", prose(rnd, 30, 60)) for i in range(9)]
    table = spark.createDataFrame([(*i, 3) for i in items], "item_id string, text string, score long")
    got = ranking.search(docs, table, k=k, shard_bytes=shard, query_bytes=query_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_search([r[:2] for r in rows], items, k)


def test_reads_stop_early_and_agree_with_full_reads():
    rnd = np.random.default_rng(5)
    n = 20_000
    codes = np.repeat(np.arange(6), 3000)
    docs = np.concatenate([np.sort(rnd.choice(n, 3000, replace=False)) for _ in range(6)])
    counts = rnd.zipf(1.6, len(codes)).clip(1, 500)
    sizes = rnd.integers(500, 4000, n)
    lists = ranking.ImpactLists(codes, docs, counts, sizes, n, int(sizes.sum()))
    weights = np.array([9000, 7000, 100, 50, 20, 10])
    whole = lists.top(np.arange(6), weights, 10, stretch=10**6)
    short = lists.top(np.arange(6), weights, 10, stretch=8)
    assert sorted(zip(*whole)) == sorted(zip(*short))


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    some = spark.createDataFrame([(1, "a c"), (2, None)], "doc_id long, text string")
    assert ranking.search(none, items).collect() == []
    assert ranking.search(some, items.limit(0)).collect() == []


# Jaccard join


def brute_jaccard(rows, threshold=85):
    sets = []
    for _, text in rows:
        ws = re.findall("[^ \t-\r]+", lower(text))
        sets.append({tuple(ws[i : i + 4]) for i in range(len(ws) - 3)} if len(ws) >= 4 else {tuple(ws)} if ws else set())
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= threshold * len(a | sets[j]):
                top[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return sorted(((d, len(s), least[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def edited(rnd, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rnd.randrange(len(words) + 1)
        kind = rnd.randrange(3)
        if kind == 0:
            words.insert(at, f"n{rnd.randrange(10**6)}")
        elif words and kind == 1:
            words.pop(min(at, len(words) - 1))
        elif words:
            words[min(at, len(words) - 1)] = f"n{rnd.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def families():
    rnd = random.Random(11)
    rows = [r[:2] for r in ODD] + [(6, "x y z"), (7, "X  y\nz"), (8, None), (9, "\x0b\r")]
    for size in (4, 6, 8, 10, 14, 20, 35, 60, 110, 200, 400):
        for _ in range(3):
            base = [f"b{rnd.randrange(10**6)}" for _ in range(size)]
            rows += [(rnd.randrange(10**6), " ".join(edited(rnd, base, rnd.randrange(0, 2 + size // 18)))) for _ in range(14)]
    passage = [f"p{i}" for i in range(60)]  # many documents share a passage but are not linked
    rows += [(rnd.randrange(10**6), " ".join(passage + [f"q{rnd.randrange(10**6)}" for _ in range(40)])) for _ in range(40)]
    return rows


def test_jaccard(spark, families, threshold=85):
    docs = spark.createDataFrame([(*r, 1, 2) for r in families], "doc_id long, text string, n long, node long").repartition(6)
    got = jaccard.jaccard_join(docs, threshold=threshold)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_jaccard(families, threshold)


def test_every_linked_pair_shares_a_sought_signature():
    """The pigeonhole argument by itself: for random pairs at the very limit, whichever set gives up its spare."""
    rnd = random.Random(2)
    for _ in range(1500):
        a = rnd.choice([1, 2, 3, 6, 7, 9, 13, 20, 33, 47, 80, 150, 400])
        b = rnd.randint(-(-a * 85 // 100), a)
        most = jaccard.differences(a, b)
        extra = a - b
        if extra > most:
            continue
        swaps = (most - extra) // 2
        tokens = [rnd.getrandbits(64) for _ in range(a + swaps)]
        x = np.unique(np.array(tokens[:a], np.uint64))
        y = np.unique(np.array(tokens[swaps + extra : a] + tokens[a : a + swaps], np.uint64))
        common = len(np.intersect1d(x, y))
        if 100 * common < 85 * (len(x) + len(y) - common):
            continue
        sides = []
        for h in (x, y):
            keys, tags, spare = jaccard.signatures(h)
            droppable = np.flatnonzero(tags & jaccard.SPARE)
            gone = rnd.sample(droppable.tolist(), min(spare, len(droppable)))
            sought = (tags & jaccard.PROBE) > 0
            sought[gone] = False
            up = (tags & jaccard.NEXT) > 0
            sides.append((set(keys[~up]), set(keys[~up & sought]), set(keys[up])))
        (x_all, x_seek, x_up), (y_all, y_seek, y_up) = sides
        if x_up & y_all or y_up & x_all:
            continue
        assert x_seek & y_all and y_seek & x_all, (a, b, common)
        bits = jaccard.turned([jaccard.sketch(x).tobytes()], [jaccard.sketch(y).tobytes()])[0]
        assert bits <= len(x) + len(y) - 2 * common


def test_folded_sketches_tell_unlike_sets_apart():
    """Sets of 1,000 shingles that differ in 300 cannot link (162 at most); the sketches in the join see it."""
    rng = np.random.default_rng(5)
    for _ in range(20):
        h = rng.integers(0, 1 << 63, 1150).astype(np.uint64)
        one, two = (np.bitwise_xor.reduce(jaccard.sketch(x).reshape(-1, jaccard.FOLD), axis=0).view(np.uint64) for x in (h[:1000], h[-1000:]))
        assert jaccard.differences(1000, 1000) < np.bitwise_count(one ^ two).sum() <= 300


def test_jaccard_of_nothing(spark):
    assert jaccard.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    odd = spark.createDataFrame([(1, None), (1, ""), (None, " ")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.jaccard_join(odd).collect()), key=str) == [(1, 0, 1), (1, 0, 1), (None, 0, None)]
