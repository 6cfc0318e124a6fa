"""Suffix-array deduplication and benchmark decontamination against brute force."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from contourlake.llm import decontaminate as D
from contourlake.llm import repeats as R
from contourlake.llm.fmindex import FmIndex, suffix_order
from contourlake.llm.suffixes import suffix_array

DOCS = "doc_id long, text string"


def test_suffix_array_orders_all_suffixes():
    rnd = random.Random(1)
    for _ in range(300):
        symbols = rnd.choice([[1, 2], [1], [1, 2, 3], list(range(1, 200))])
        parts = [[rnd.choice(symbols) for _ in range(rnd.randint(0, 12))] for _ in range(rnd.randint(0, 5))]
        codes, ends = [], []
        for p in parts:
            codes += [*p, 7]
            ends.append(len(codes) - 1)
        order = suffix_array(np.array(codes, int), np.array(ends, int), 200).tolist()
        end_of = {i: e for e, p in zip(ends, parts) for i in range(e - len(p), e + 1)}
        keys = [codes[i : end_of[i]] for i in order]
        assert sorted(order) == list(range(len(codes)))
        assert all(a <= b for a, b in zip(keys, keys[1:]))


@pytest.mark.parametrize("part", [[1] * 3000, [1, 2] * 1500, [1] * 2999 + [2], [2] + [1] * 2999])
def test_suffix_array_of_periodic_text(part):
    order = suffix_array(np.array([*part, 1]), np.array([len(part)]), 2).tolist()
    assert order == sorted(range(len(part) + 1), key=lambda i: part[i:])


def test_suffix_array_of_more_symbols_than_code_points():
    n = 1_300_000
    codes = np.concatenate([np.arange(n, 0, -1), [1], [n, 1], [1]])
    order = suffix_array(codes, np.array([n, n + 3]), n)
    # closing places, "1" twice, then 2, 3, ... and n twice: n followed by 1 is below n followed by n - 1
    assert order[:4].tolist() in ([n, n + 3, n - 1, n + 2], [n, n + 3, n + 2, n - 1])
    assert order[4:].tolist() == [*range(n - 2, 0, -1), n + 1, 0]


def test_log_like_texts_with_many_windows_under_few_keys(spark):
    """Two documents hold one anchor in every line, so a key has far more windows than documents."""
    rnd = random.Random(9)
    line = lambda: f"{rnd.randrange(10**12):012d} GET /static/app.js HTTP/1.1 200 {rnd.randrange(10**9):09d} "
    lines = [line() for _ in range(300)]
    rows = [(1, "".join(lines)), (2, "".join(line() for _ in range(200)) + "".join(lines[50:90])), (3, lines[7] * 5)]
    df = spark.createDataFrame(rows, DOCS)
    want = removed(rows)
    for hot in (20, R.HOT_WINDOWS):
        assert result(R.repeated_spans(df, hot=hot)) == want


def removed(rows):
    """Brute force over all 50-byte strings."""
    first = {}
    key = lambda i: R.NO_ID if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], R.NO_ID), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < key(i):
                mark[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, mark) if not y)
        spans = sum(1 for j, y in enumerate(mark) if y and (j == 0 or not mark[j - 1]))
        out.append((str(i), len(b), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.fixture(scope="module")
def repeated():
    rnd = random.Random(5)
    base = "".join(rnd.choice("abé cd") for _ in range(400))
    rows = []
    for i in range(60):
        t = "".join(rnd.choice("abcdefgh é\n") for _ in range(rnd.randint(0, 150)))
        for _ in range(rnd.randint(0, 3)):
            a = rnd.randrange(330)
            t += base[a : a + rnd.randint(40, 90)] + rnd.choice(["", "x", "yz"])
        rows.append((rnd.choice([i, i, i, None, 7]), t))
    rows += [(500, "a" * 300), (501, "b" + "a" * 120), (502, "ab" * 100), (503, "ba" * 60), (504, None), (505, "")]
    rows += [(506, rows[3][1]), (507, rows[3][1]), (507, rows[3][1]), (508, "\0" * 120), (509, "x" + "\0" * 80)]
    long = "".join(rnd.choice("abcdef gh") for _ in range(70_000))
    return rows + [(600, long), (601, "zz" + long[100:69_000] + "y")]


@pytest.mark.parametrize(("groups", "hot"), [(None, R.HOT_WINDOWS), (3, 3), (1, 1)])
def test_repeated_spans_equal_brute_force(spark, repeated, groups, hot):
    df = spark.createDataFrame(repeated, DOCS).repartition(4)
    assert result(R.repeated_spans(df, groups=groups, hot=hot)) == removed(repeated)


def test_repeats_edge_tables(spark):
    df = spark.createDataFrame([(1, "x" * 60, "a", 1, 9), (2, "é" * 26 + "x" * 60, "b", 2, None)], "doc_id long, text string, n_bytes string, _doc long, n_chars long")
    assert R.repeated_spans(df.limit(0)).count() == 0
    assert {r.doc_id: r.n_removed for r in R.repeated_spans(df).collect()} == {1: 0, 2: 60}
    plain = df.drop("_doc")
    assert R.without_repeats(plain.limit(0)).count() == 0
    out = {r.doc_id: r for r in R.without_repeats(plain).collect()}
    assert out[2].text == "é" * 26 and out[2].n_chars == 26 and out[1].n_chars == 9 and out[2].n_bytes == "b"


def test_fm_index_counts_and_locates():
    rnd = random.Random(2)
    for alphabet in (2, 5, 70_000):
        text = np.array([rnd.choice([0, *([rnd.randint(1, alphabet)] * 4)]) for _ in range(400)] + [0])
        index = FmIndex(text, alphabet, sample=4)
        patterns = [text[a : a + n] for a in range(0, 380, 7) for n in (1, 2, 3) if (text[a : a + n] > 0).all()]
        rows, lengths = np.zeros((len(patterns), 3), int), np.array([len(p) for p in patterns])
        for k, p in enumerate(patterns):
            rows[k, 3 - len(p) :] = p
        low, high = index.search(rows, lengths)
        for k, p in enumerate(patterns):
            want = [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == want
    assert len(suffix_order(np.zeros(0, int))) == 0


PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def contaminated(docs, items, window=10):
    split = lambda t: PATTERN.findall((t or "").translate(LOWER))
    phrases = {}
    for i, t in items:
        w = split(t)
        for j in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[j : j + window]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(p) for p in phrases}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in phrases:
                    hit.update(range(j, j + n))
                    found |= phrases[tuple(w[j : j + n])]
        out.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_contamination_equals_brute_force(spark):
    rnd = random.Random(3)
    items = [(i, " ".join(rnd.choice("a B c é 1 dd ee".split()) for _ in range(rnd.choice([0, 1, 4, 10, 11, 25])))) for i in range(12)]
    items += [(None, "null Item words"), (5, "short ITEM"), (13, None), (14, "!!")]
    docs = [(i, " ".join(rnd.choice("a b c É é 1 dd ee x".split()) for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    docs += [(100 + (i or 0), f"intro, {t or ''}. OUTRO!") for i, t in items] + [(100, None), (None, ""), (7, "short-item Short.ITEM"), (7, "short-item")]
    docs.append((900, "x " * 50_000 + (items[4][1] or "a")))
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = lambda df: sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())
    want = contaminated(docs, items)
    assert got(D.contamination(d, b)) == want
    assert got(D.contamination(d, b, block_bytes=60, shard_words=50)) == want
    assert not any(r.contaminated for r in D.contamination(d, b.limit(0)).collect())
    assert D.contamination(d.limit(0), b).count() == 0


def test_decontaminated_cuts_spans_and_keeps_rows(spark):
    b = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    rows = [(1, "Zero, One  two (three) four", "k", 27), (2, "clean", None, 5), (3, None, None, None), (4, "one two three", "k", 13)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_words string, n_chars long")
    out = {r.doc_id: r for r in D.decontaminated(d, b).collect()}
    assert out[1].text == "Zero, ) four" and out[1].n_chars == 12 and out[1].n_words == "k"
    assert out[2].text == "clean" and out[3].text is None and out[4].text.strip() == ""
    assert D.merge_spans([(3, 5), (0, 2), (2, 3), (7, 9)]) == [(0, 5), (7, 9)]


def test_suffix_order_of_repeated_words():
    """Long repeats are sorted in rounds of doubled length, not word by word."""
    rnd = np.random.default_rng(1)
    for _ in range(40):
        text = rnd.integers(0, 3, rnd.integers(1, 60))
        text[-1] = 0
        ends = np.flatnonzero(text == 0)
        stop = lambda i: ends[np.searchsorted(ends, i)]
        assert suffix_order(text).tolist() == sorted(range(len(text)), key=lambda i: (text[i : stop(i) + 1].tolist(), i))
    t0 = time.time()
    order = suffix_order(np.r_[np.ones(400_000, np.int64), 0])
    assert order.tolist() == list(range(400_000, -1, -1)) and time.time() - t0 < 20
