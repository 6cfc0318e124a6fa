"""URL filter and WARC archives."""

import base64
import hashlib
import re

import pytest

from contourlake.llm import urlfilter as U
from contourlake.llm import warc as X
from contourlake.llm.common import stored
from contourlake.session import scratch_table

PAGES = "page_id long, url string, html string"


def page(*links):
    return " ".join(f'<a href="{link}">x</a>' for link in links)


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :], re.S)[0]


def test_hosts_paths_and_rules(spark):
    urls = ["http://A.Example.COM/en/x?q#f", "x://b", "://c.net/es/", "no scheme", None, "", "http://www.example.com/en/1", "http://example.com/en/"]
    urls += ["http://com/", "http://com", "http://notexample.com/en/", "http://net/fr/?a", "http://x.net/en/", "http://h?x://y/z", "a://b://c/d", "http://É.com/é\n/x"]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], PAGES)
    rows = {r.page_id: r for r in U.judge(df).collect()}
    assert {i: parse(u) for i, u in enumerate(urls)} == {i: (r.host, r.path) for i, r in rows.items()}
    rule = lambda i: (rows[i].rule, rows[i].verdict)
    assert rule(0) == ("example.com/en/", "block") and rule(2) == ("net/es/", "block") and rule(6) == ("www.example.com/en/", "allow")
    assert rule(7) == ("example.com/en/", "block") and rule(8) == ("com/", "allow") and rows[9].rule is None and rule(10) == ("com/", "allow")
    assert rule(11) == ("net/fr/", "block") and rows[12].rule is None and rule(4) == (None, "allow")


def ranks(seeds, edges, damping=0.85):
    """Dense power iteration."""
    hosts = set(seeds) | {h for e in edges for h in e[:2]}
    whole = sum(seeds.values())
    seed = {h: seeds.get(h, 0) / whole if whole else 0.0 for h in hosts}
    out = {}
    for a, _, n in edges:
        out[a] = out.get(a, 0) + n
    score = dict(seed)
    for _ in range(300):
        lost = sum(score[h] for h in hosts if h not in out)
        score = {h: (1 - damping) * seed[h] + damping * (lost * seed[h] + sum(score[a] * n / out[a] for a, b, n in edges if b == h)) for h in hosts}
    return score


def test_propagation_equals_power_iteration(spark):
    links = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 3), ("d", "e", 1), ("f", "d", 1), ("e", "x", 1)]
    good, bad = {"a": 1.0, "c": 0.5}, {"d": 1.0, "x": 0.25}
    seeds = spark.createDataFrame([(h, good.get(h, 0.0), bad.get(h, 0.0)) for h in "acdx"], "host string, good double, bad double")
    got = {r.host: r for r in U.propagate(seeds, spark.createDataFrame(links, "src string, dst string, n long"), iterations=200, tolerance=1e-12).collect()}
    trust, distrust = ranks(good, links), ranks(bad, [(b, a, n) for a, b, n in links])
    assert all(r.trust == pytest.approx(trust[h], abs=1e-9) and r.distrust == pytest.approx(distrust[h], abs=1e-9) for h, r in got.items())


def test_propagation_settles_or_fails(spark):
    assert 4 * U.DAMPING**U.ITERATIONS < U.TOLERANCE  # two scores, each of which changes by at most 2 in the first round
    links = [(f"h{i}", f"h{i + 1}", 1) for i in range(6)]
    seeds = spark.createDataFrame([("h0", 1.0, 0.0), ("h6", 0.0, 1.0)], "host string, good double, bad double")
    with pytest.raises(RuntimeError):
        U.propagate(seeds, spark.createDataFrame(links, "src string, dst string, n long"), iterations=3)


def test_verdicts_follow_links(spark):
    rows = [
        (1, "http://a.com/x", page("http://b.org/", "//c.org/z", "/self", "mailto:x@y", "http://a.com/2")),
        (2, "http://b.org/x", page("https://c.org/1", "https://C.org/2")),
        (3, "http://spam.org/", page("http://d.net/es/1")),
        (4, "http://d.net/es/q", page("http://a.com/")),
        (5, None, None),
        (5, None, None),
        (7, "http://c.org", ""),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], PAGES + ", host string")
    got = sorted((r.page_id, r.verdict) for r in U.judge(df).collect())
    assert got == [(1, "allow"), (2, "allow"), (3, "block"), (4, "block"), (5, "allow"), (5, "allow"), (7, "allow")]
    assert U.judge(df.limit(0)).count() == 0
    links = {(r.src, r.dst): r.n for r in U.host_links(df).collect()}
    assert links == {("a.com", "b.org"): 1, ("a.com", "c.org"): 1, ("b.org", "c.org"): 1, ("spam.org", "d.net"): 1, ("d.net", "a.com"): 1}


def test_archives_round_trip(spark):
    rows = [(i, f"http://h/{i}", f"<html>{'word ' * (i % 7)}{i % 40}</html>") for i in range(120)]
    rows += [(500, None, None), (501, "a b\r\nWARC-Type: x", ""), (None, "x", ""), (None, None, "only null"), (3, rows[3][1], rows[3][2]), (600, "u", "é" * 90_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], PAGES + ", record_type string").repartition(3)
    largest = {}
    for i, _, html in rows:
        if i is not None:
            largest[html or ""] = max(largest.get(html or "", i), i)
    want = []
    for i, _, html in rows:
        raw, main = (html or "").encode(), largest.get(html or "")
        same = main is None or i == main
        want.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if same else "revisit", None if same else main))
    got = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in X.archived(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert X.archived(df.limit(0)).count() == 0
    folder = scratch_table(spark, "warc-test")
    manifest = stored(X.write_archives(df, folder, archive_bytes=9_000, sample_bytes=5_000, min_bytes=1000), "manifest")
    assert manifest.count() > 3
    back = X.read_archives(manifest, folder, payload=True).collect()
    texts = {str(i): (h or "").encode() for i, _, h in rows if i is not None}
    assert all(bytes(r.payload) == texts[str(r.page_id)] for r in back if r.page_id is not None)
    assert {r.record_type for r in back} == {"response"}  # payloads below the limit are all responses


def test_leading_frame_holds_the_dictionary(spark):
    import struct

    folder = scratch_table(spark, "warc-frame")
    df = spark.createDataFrame([(i, "u", f"<p>{'shared markup ' * 20}{i}</p>") for i in range(100)], PAGES).coalesce(1)
    path = stored(X.write_archives(df, folder), "manifest").first()["path"]
    raw = open(path, "rb").read()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == X.MAGIC and size > 0 and raw[8 + size : 12 + size] == b"\x28\xb5\x2f\xfd"
