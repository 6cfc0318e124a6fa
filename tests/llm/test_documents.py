"""Token counts, quality rules, packing, SimHash, toxicity and sharding."""

import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from contourlake.llm import packing, quality, sharding, simhash, tokens, toxicity

DOCS = "doc_id long, text string"
ODD = [(1, None), (1, ""), (None, "a b"), (2, " \n\t"), (2, " \n\t"), (3, "é" * 40_000), (4, "word " * 9_000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 5, "x") for r in ODD], DOCS + ", n_tokens long, score string")


# token counts


def test_splices_give_the_whole_count():
    model, joined = tokens._load(P.path(tokens.MODEL))
    rnd = random.Random(1)
    texts = ["a" * 3000, "日本語" * 700, " " * 500 + "é" * 400, "<s>" * 100, "", "x", "Ein Satz, der  weitergeht.\n" * 60]
    texts += ["".join(rnd.choice("ab \nécd☃") for _ in range(1500)) for _ in range(4)]
    for text in texts:
        for chunk, overlap in ((2, 1), (40, 5), (100, 10), (400, 30)):
            assert tokens.count_spliced(text, model, joined, chunk, overlap) == len(model.encode(text))


def test_token_counts(spark, odd):
    model, _ = tokens._load(P.path(tokens.MODEL))
    want = sorted((str(i), len((t or "").encode()), len(model.encode(t or ""))) for i, t in ODD)
    rows = tokens.token_counts(odd, chunk=1000).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in rows)
    assert tokens.token_counts(odd.limit(0)).count() == 0


# quality rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(t):
    w = WORD.findall(t)
    windows = list(zip(w, w[1:], w[2:]))
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_base_counts_equal_the_rule():
    rnd = random.Random(4)
    for _ in range(300):
        t = "".join(rnd.choice("ab é#\n \t\x0b\x1c\xa0\u2028|") for _ in range(rnd.randint(0, 80)))
        assert quality.base_counts(t) == counted(t), repr(t)


def test_viterbi_is_the_best_path():
    rnd = np.random.default_rng(0)
    for n in range(1, 7):
        model = quality.Crf(rnd.normal(size=3), rnd.normal(size=(2, 2)))
        rows = rnd.normal(size=(n, 3)).tolist()
        emit = np.array(rows) @ model.weights
        value = lambda y: sum(e for e, k in zip(emit, y) if k) + sum(model.pairs[a, b] for a, b in zip(y, y[1:]))
        best = max(value([(m >> k) & 1 for k in range(n)]) for m in range(2**n))
        assert value(model.viterbi(rows)) == pytest.approx(best)


def test_quality_learns_held_out_lines(spark):
    rnd = random.Random(6)
    prose = lambda: "\n".join(" ".join(rnd.choice("the sun and moon over hills with rain falls softly".split()) + str(rnd.randint(0, 99)) for _ in range(25)) + "." for _ in range(4))
    junk = lambda: "\n".join(" ".join("BUY$$$ NOW### !!! | &&&".split()[rnd.randint(0, 4)] + str(rnd.randint(0, 999)) for _ in range(25)) for _ in range(4))
    rows = [(i, prose() if i % 2 else junk()) for i in range(120)]
    docs = spark.createDataFrame([(*r, "z") for r in rows + [(900, None), (901, ""), (None, prose())]], DOCS + ", kept string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(5, None), (None, 1), (999, 0)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality.quality(docs, labels).collect()}
    assert all(got[i] == bool(i % 2) for i in range(60, 120)) and not got[900] and not got[901] and got[None]
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == {i for i, k in got.items() if k}
    alone = {r.doc_id: r for r in quality.quality(docs, labels.limit(0)).collect()}
    assert all(r.kept == (not r.base_failed) for r in alone.values())
    assert quality.quality(docs.limit(0), labels).count() == 0


# packing


def test_pieces_ids_and_places(spark, odd):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(P.path(packing.MODEL))
    rows = packing.pack(odd, group_items=4).collect()
    want = Counter()
    for i, t in ODD:
        ids = np.array(slow.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want.update((i, k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(packing.spans(len(ids))))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert packing.pack(odd.limit(0)).count() == 0


@pytest.mark.parametrize("options", [{}, {"group_items": 1, "group_tokens": 6000}])
def test_short_pieces_leave_one_open_sequence(spark, options):
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    rows = packing.pack(docs, **options).collect()
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert len(rows) == 12_000 and max(used.values()) <= packing.CAPACITY
    assert len(used) == -(-sum(used.values()) // packing.CAPACITY)


def test_pieces_of_long_documents():
    assert packing.spans(2048) == [(0, 2048)] and packing.spans(2049) == [(0, 1), (1, 2048)] and packing.spans(4096) == [(0, 2048), (2048, 2048)]


def test_fast_ids_equal_the_library():
    encode = packing._encoder(P.path(packing.MODEL), P.path(packing.RANKS))
    exact = packing._encoder(P.path(packing.MODEL), None)
    rnd = random.Random(0)
    texts = [x for c in range(0x280) for x in (chr(c) * 3, f"a{chr(c)} b", f" {chr(c)}{chr(c)}1", f"x'{chr(c)}\n\n {chr(c)}")]
    texts += ["".join(chr(rnd.randrange(0x280)) if rnd.random() < 0.5 else rnd.choice(" \n\t'abc12") for _ in range(40)) for _ in range(500)]
    texts += ["a<|endoftext|>b", "日本 x", "ʀ"]
    assert all(encode(t) == exact(t) for t in texts)


def test_evolution_packs_perfect_bins():
    rnd = random.Random(8)
    sizes = []
    for _ in range(30):
        cuts = sorted(rnd.sample(range(1, 100), 2))
        sizes += [cuts[0], cuts[1] - cuts[0], 100 - cuts[1]]
    first = packing.best_fit([], sorted(range(90), key=lambda i: -sizes[i]), sizes, 100)
    pool = packing.evolve(sizes, [], "seed", 100, generations=60, population=6)
    assert 30 <= len(pool[0]) <= len(first)
    for bins in pool:
        assert sorted(i for b in bins for i in b) == list(range(90)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
    child = packing.crossover(pool[0], first, sizes, 100, rnd)
    assert sorted(i for b in child for i in b) == list(range(90))


# SimHash


def fingerprint(t):
    w = (t or "").encode().translate(simhash._LOWER).split()
    parts = [b" ".join(w[j : j + 4]) for j in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def component(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("stars", [1, 4])
def test_links_of_clusters_are_complete(spark, stars):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(5)]
    values = set()
    for _ in range(250):
        b = rnd.choice(base)
        for _ in range(rnd.randint(0, 7)):
            b ^= 1 << rnd.randrange(64)
        values.add(b)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {r.fp: r.component for r in simhash.classes(spark.createDataFrame([(v,) for v in signed], "fp long"), stars=stars).collect()}
    of = component(values)
    low = {}
    for v, c in zip(signed, of):
        low[c] = min(low.get(c, v), v)
    assert all(got.get(v, v) == low[c] for v, c in zip(signed, of))


def test_near_duplicates(spark, odd):
    rnd = random.Random(2)
    base = " ".join(f"w{rnd.randint(0, 5000)}" for _ in range(400))
    rows = ODD + [(10, base), (11, base + " one more"), (12, base), (13, "A b"), (9, "other " + base)]
    df = spark.createDataFrame([(*r, "z") for r in rows], DOCS + ", fingerprint string")
    got = Counter((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    prints = [fingerprint(t) for _, t in rows]
    of = component(prints)
    low = {}
    for (i, _), c in zip(rows, of):
        if i is not None:
            low[c] = min(low.get(c, i), i)
    assert got == Counter((str(i), f"{p:016x}", low.get(c)) for (i, _), p, c in zip(rows, prints, of))
    kept = Counter(str(r.doc_id) for r in simhash.without_near_duplicates(df).collect())
    assert kept == Counter(str(i) for (i, _), c in zip(rows, of) if i == low.get(c))
    assert simhash.near_duplicates(df.limit(0)).count() == 0


# toxicity


def test_index_holds_little_beside_itself():
    """While it is made, the index takes little more than it keeps: matrices and lists are filled in place."""
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(6000):
        t = np.unique(np.r_[rng.integers(0, 400, 150), rng.integers(400, 40_000, 150)]).astype(np.int32)
        vectors.append((t, np.full(len(t), 1 / np.sqrt(len(t)))))
    index = toxicity.BlockMaxIndex(vectors)
    tracemalloc.start()
    index._prepare()
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert index.dense.nbytes > 8e6 and len(index.parts) > 800_000
    assert peak < 1.1 * kept + 20e6


def test_nearest_equals_a_scan():
    rnd = random.Random(5)
    vectors = []
    for _ in range(300):
        v = {rnd.randrange(12): rnd.random() for _ in range(rnd.randint(1, 5))}
        norm = sum(x * x for x in v.values()) ** 0.5
        vectors.append({t: x / norm for t, x in v.items()})
    vectors += vectors[:20]  # ties
    index = toxicity.BlockMaxIndex(vectors, block=16)
    for q in vectors[::17]:
        cosines = [round(sum(w * v.get(t, 0.0) for t, w in q.items()), 12) for v in vectors]
        ranked = sorted((c for c in cosines if c > 0), reverse=True)
        floor = ranked[min(9, len(ranked) - 1)]
        got = index.nearest(q, 10)
        assert {h.example for h in got} == {i for i, c in enumerate(cosines) if c > 0 and c >= floor - 1e-9}
    assert toxicity.BlockMaxIndex([]).nearest({1: 1.0}, 3) == []
    light = toxicity.BlockMaxIndex([{1: 0.01, 2: 0.99}, {2: 1.0}]).nearest({1: 1.0}, 3)  # all terms within the slack
    assert [h.example for h in light] == [0]


def test_index_reads_few_lists(monkeypatch):
    """Long lists of light terms are not read where heavy terms settle the nearest examples, which equal a scan's."""
    rng = np.random.default_rng(8)
    vectors = []
    for i in range(3000):
        light = np.unique(rng.integers(0, 400, 12))
        t = np.r_[light, 400 + i % 600, 1000 + rng.integers(0, 2000)].astype(np.int32)
        w = np.r_[np.full(len(light), 0.02), 1.0, 0.5]
        vectors.append((t, w / np.sqrt((w * w).sum())))
    index, read = toxicity.BlockMaxIndex(vectors), []
    add = index._add
    monkeypatch.setattr(index, "_add", lambda total, t, w: (read.append(int((index.at[t + 1] - index.at[t]).sum())), add(total, t, w)))
    asked = vectors[::300]
    got = index.nearest_of(asked, 5)
    entries = sum(int((index.at[t + 1] - index.at[t]).sum()) for t, _ in asked)
    assert entries > 8000 and sum(read) < entries / 3
    table = np.zeros((3000, 3000))
    for row, (t, w) in zip(table, vectors):
        row[t] = w
    for (t, w), hits in zip(asked, got):
        cosines = np.round(table[:, t] @ w, 12)
        assert {h.example for h in hits} == set(np.flatnonzero(cosines >= np.sort(cosines)[-5]).tolist())


def test_counts_of_known_terms():
    """Words are counted by a table that grows and is cleared; stored counts come back as they were."""
    texts = [b"", b"!?", "Ärger ärgerlich ab abcd ABCDE abcdef abcdeg x9 Éa".encode(), b"abcdz abcd abcd", b"none of them", bytes(range(128, 256)) + b" abcd"]
    known = sorted(set().union(*(toxicity.terms(t) for t in texts[:4])))
    words = toxicity.Vocabulary(known)
    words.KEPT = 5
    for text in texts * 2 + [b" ".join(b"w%d" % i for i in range(3000)) + b" abcd"]:
        ids, n, blank = words.count(text)
        want = {words.number[t]: c for t, c in toxicity.terms(text).items() if t in words.number}
        assert list(zip(ids.tolist(), n.tolist())) == sorted(want.items()) and blank == (not toxicity.terms(text))
        back = toxicity.unpacked(toxicity.packed(ids, n, blank))
        assert back[0].tolist() == ids.tolist() and back[1].tolist() == n.tolist() and back[2] == blank
    ids, n = np.array([0, 70_000, 3_000_000], np.int32), np.array([1, 300, 70_000], np.int32)
    back = toxicity.unpacked(toxicity.packed(ids, n, False))
    assert back[0].tolist() == ids.tolist() and back[1].tolist() == n.tolist()


def test_isotonic_is_monotone():
    rnd = np.random.default_rng(1)
    x = rnd.random(200).round(1)
    knots, values = toxicity.isotonic(x, (rnd.random(200) < x).astype(int))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) > 0).all() and values.min() > 0 and values.max() < 1


def test_toxicity_finds_held_out_rows(spark):
    rnd = random.Random(7)
    plain = lambda: " ".join(f"word{rnd.randint(0, 300)}" for _ in range(40))
    bad = lambda: plain() + " " + rnd.choice(["Nasty", "vile", "grubby"]) + rnd.choice(["", "ness", "ly"])
    rows = [(i, bad() if i % 4 == 0 else plain()) for i in range(600)]
    docs = spark.createDataFrame([(*r, "x") for r in rows + [(9000, None), (9001, ""), (None, "vile"), (0, rows[0][1])]], DOCS + ", score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 604 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    for r in got:
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0)
    right = [r.predicted == (r.doc_id % 4 == 0) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert sum(right) / len(right) > 0.95
    by = {r.doc_id: r for r in got}
    assert by[9000].score == by[9001].score < 0.5 and by[None].predicted == 1
    known = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5}
    assert all(set(r.evidence) <= known for r in got)
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_rare_terms_find_their_example(spark):
    """A copy of a toxic example is scored and traced by words that one labelled row has, in a small labelled table."""
    rows = [(i, f"plain{i} text{i % 7}") for i in range(1, 40)] + [(100, "zorgle fnarp"), (101, "quibber snood"), (200, "zorgle fnarp"), (201, "unheard")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in rows if i < 200], "doc_id long, toxic int")
    assert zlib.crc32(b"100") % 5 and zlib.crc32(b"101") % 5
    by = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert by[200].evidence == [100] and by[201].evidence == []
    plain = [by[i] for i in range(1, 40)]
    assert all(by[200].score > r.score for r in plain) and all(r.evidence for r in plain if not r.held_out)


# sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 12, 100, 1009])
def test_permutation_is_one_to_one(spark, n):
    from pyspark.sql import functions as F

    rows = spark.range(n).select(sharding.permute(F.col("id"), F.lit(n).cast("long")).alias("p")).collect()
    assert sorted(r.p for r in rows) == list(range(n))


def test_shards_are_even_and_reproducible(spark, odd):
    rows = [(i, f"t{i % 50}" if i % 3 else "copy") for i in range(500)] + [(None, None), (None, "")] + [(7, "same")] * 30 + ODD
    df = spark.createDataFrame(rows, DOCS)
    got = sharding.shard(df, shards=24).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(24)]
    assert max(sizes) - min(sizes) <= 1
    again = sharding.shard(df.repartition(7), shards=24).collect()
    assert Counter(tuple(r) for r in got) == Counter(tuple(r) for r in again)
    assert sharding.shard(odd.limit(0)).count() == 0
