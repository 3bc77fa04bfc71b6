"""Centroids, URL filters and spelling variants against brute force, and on odd and empty tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from barloom.llm import centroids, spelling, url_filter

# 11 centroids

VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute_kmeans(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    h = lambda i: "~" if i is None else hashlib.sha256(f"2:{i}".encode()).hexdigest()
    c = [v for i, v in sorted(kept, key=lambda r: (h(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), n) for n, x in enumerate(c))
    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        c = [[sum(x) // len(own[n]) for x in zip(*own[n])] if n in own else x for n, x in enumerate(c)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    per = collections.Counter()
    for _, n, d in found:
        per[n] += d
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, n, d, per[n], sum(per.values()), digest[n]) for i, n, d in found), key=repr)


def clustered(spark, rows, parts=3, **kw):
    d = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    for name in ("cluster", "distance", "apex", "v", "h", "n"):
        d = d.withColumn(name, d.vec_id)
    got = centroids.centroid_clusters(d.repartition(parts), **kw)
    return sorted((tuple(r)[:6] for r in got.collect()), key=repr), got


@pytest.mark.parametrize("shape", ["blobs", "line", "grid", "same"])
def test_centroids_by_brute_force(spark, shape):
    rng = random.Random(shape)
    if shape == "blobs":
        middles = [[rng.uniform(-2, 2) for _ in range(6)] for _ in range(7)]
        rows = [(k, [x + rng.gauss(0, 0.2) for x in rng.choice(middles)]) for k in range(300)]
    elif shape == "line":  # all pivots but two lie in the space of the others
        rows = [(k, [k % 37 / 16] * 6) for k in range(200)]
    elif shape == "grid":  # ties
        rows = [(k, [float(x) for x in p]) for k, p in enumerate(itertools.product((0, 1), repeat=6))]
    else:
        rows = [(k, [0.5] * 6) for k in range(50)]
    for parts in (1, 4):
        got, _ = clustered(spark, rows, parts, k=9, rounds=3, dims=6)
        assert got == brute_kmeans(rows, 9, 3, 6)


def test_centroids_of_odd_tables(spark):
    inf, nan = math.inf, math.nan
    rows = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [-1.0, 0.5]), (7, [-1.0, 0.5]), (7, [2.0, 2.0]), (None, [0.1, 0.2]), (None, [3.0, 0.2]), (8, [1.0, 2.0, 3.0])]
    got, df = clustered(spark, rows, k=4, rounds=2, dims=2)
    assert got == brute_kmeans(rows, 4, 2, 2) and len(got) == 5
    few, _ = clustered(spark, rows, k=40, rounds=2, dims=2)
    assert few == brute_kmeans(rows, 40, 2, 2)
    empty, e = clustered(spark, rows[:6], k=4, dims=2)
    assert empty == [] and e.dtypes == df.dtypes
    with pytest.raises(Exception, match="would not fit a long"):
        clustered(spark, [(1, [1e20, 0.0]), (2, [0.0, 0.0])], k=2, dims=2)


@pytest.mark.parametrize("n_pivots", [1, 2, 12, 30, 64])
def test_bounds_filter_and_never_lose_the_nearest(n_pivots):
    rng = np.random.default_rng(5)
    middles = rng.integers(-3000, 3000, (30, 64))
    v = middles[rng.integers(0, 30, 2000)] + rng.integers(-200, 200, (2000, 64))
    simplex = centroids.Simplex(v[:80], n_pivots)
    at, tops = simplex.apexes(v), simplex.apexes(middles)
    exact = ((v[:, None, :] - middles) ** 2).sum(axis=2)
    cluster, distance, compared = centroids.nearest(v, at, middles, tops)
    assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert compared < 0.05 * exact.size or n_pivots < 12
    flat = ((at[:, None, :-1] - tops[:, :-1]) ** 2).sum(axis=2)
    low, high = flat + (at[:, -1:] - tops[:, -1]) ** 2, flat + (at[:, -1:] + tops[:, -1]) ** 2
    assert (low <= exact * (1 + 1e-9) + 1).all() and (exact <= high * (1 + 1e-9) + 1).all()


# 12 url filters

URLS = [
    None, "", "no scheme", "http://a.net", "http://a.net/", "HTTP://A.NET/x", "https://example.net/en/1", "https://www.example.net/en", "https://Example.NET/en/?q=/de/",
    "http://example.com/de/a#x", "http://xexample.com/de/a", "http://b.org/fr/", "http://org/fr/1", "http://b.org/fr?x", "http://a.net:80/", "http://u@a.net/", "x://y://z.net/", "://net/", "http://net./",
    "http://a.b.c.net/en/", "http://a/b\nc/", "http://\u00c4.net/\u00e9", "http://" + "a." * 400 + "net/" + "x/" * 3000, "http://c.net/?" + "q" * 300_000, "ftp:///path", "http://?x", "http://a.net//",
]


def brute_verdict(url, rules, default="allow"):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [(0 if not h else h.count(".") + 1, len(p), a == "block", h + p, a) for a, h, p in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    *_, rule, action = max(fits, default=(None, default))
    return host, path, rule, action


RULE_SETS = [
    [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")],
    [("block", "", ""), ("allow", "net", ""), ("block", "net", ""), ("allow", "a.net", "/x"), ("block", "c.net", "//"), ("allow", "c.net", "/e"), ("block", "b.c.net", "/en/x"), ("allow", "net", "/xyz"), ("block", "org", "/f"), ("allow", "org", "/fr/1")],
    [],
]


@pytest.mark.parametrize("rules", RULE_SETS)
@pytest.mark.parametrize("max_bytes", [url_filter.MAX_BYTES, 0])
def test_urls_by_brute_force(spark, rules, max_bytes):
    rows = [*enumerate(URLS), (0, URLS[4]), (None, URLS[6]), (None, None)] + [(1000, "http://hot.net/a")] * 900
    d = spark.createDataFrame([(i, u, "<p>") for i, u in rows], "page_id bigint, url string, html string")
    for name in ("host", "path", "rule", "id", "found", "key", "verdict"):
        d = d.withColumn(name, d.page_id)
    got = url_filter.judge_urls(d, url_filter.rule_table(spark, rules), max_bytes=max_bytes)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = [(i, *brute_verdict(u, rules)) for i, u in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert url_filter.judge_urls(d.limit(0), url_filter.rule_table(spark, rules), max_bytes=max_bytes).collect() == []


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.tuples(st.sampled_from(["allow", "block"]), st.sampled_from(["", "a", "b.a", "c.b.a", "b"]), st.sampled_from(["", "/", "/x", "/x/", "/x/y", "/xy", "//"])), max_size=8),
    st.sampled_from(["a", "b.a", "d.c.b.a", "b", "ab", ""]),
    st.sampled_from(["", "/", "/x", "/x/", "/x/y/z", "/xyz", "//", "/z"]),
)
def test_trie_by_brute_force(rules, host, path):
    got = url_filter.UrlTrie(rules).find(host, path)
    assert (got or (None, "allow")) == brute_verdict(f"s://{host}{path}", rules)[2:]


# 13 spelling


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def brute_forms(rows, least=2, ratio=10, every=31):
    n = collections.Counter()
    for i, t, *_ in rows:
        for w in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m.group().lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= 7
    n = {w: k for w, k in n.items() if k >= least and len(w) >= 7}
    out, form = [], {}
    for w, k in n.items():
        near = sorted((-m, x) for x, m in n.items() if one_edit(w, x))
        if near and -near[0][0] >= ratio * k:
            form[w] = near[0][1]
        out.append((w, k, len(near)))
    root = lambda w: root(form[w]) if w in form else w
    return sorted((w, form.get(w), root(w), k, m, n[form[w]] if w in form else None) for w, k, m in out)


def words_of(rng, n):
    """Words near each other in every place, with long runs of a letter and long common parts."""
    base = ["aaaaaaaa", "abababab", "bcdefgh", "zéàçüößa", "prefixxx" * 8, "m" * 63, "m" * 64, "qrst" * 30, "a" * 97]
    out = list(base)
    while len(out) < n:
        w = rng.choice(out)
        i, c = rng.randrange(len(w) + 1), rng.choice("abm\u00e9")
        out.append(rng.choice([w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :] if len(w) > 7 else w + c]))
    return out


@pytest.mark.parametrize("most", [1, 4, 1000])
def test_forms_by_brute_force(spark, docs, most):
    rng = random.Random(13)
    rows = []
    for k, w in enumerate(words_of(rng, 420)):
        rows.append((k, f"{w}, {w.upper() if k % 3 else w}. " * rng.choice([1, 1, 1, 11, 130])))
    got = spelling.spelling_forms(docs(rows), most=most).select("word", "form", "root", "n", "n_near", "form_n")
    want = brute_forms(rows)
    assert sorted(map(tuple, got.collect())) == want
    assert any(f and r != f for _, f, r, *_ in want) and any(len(w) > 64 and m for w, _, _, _, m, _ in want)


def test_forms_of_odd_tables(spark, docs, odd_rows):
    rows = [*odd_rows, (20, "abcdefg " * 2 + "abcdefh " * 30), (20, "abcdefg"), (None, "ABCDEFG\u00c9 abcdefg\u00e9 abcdefg\u00c9"), (21, "ab" * 150_000), (22, "ab" * 150_000 + " " + "ab" * 149_999 + "a "), (23, "ab" * 149_999 + "a ")]
    got = spelling.spelling_forms(docs(rows)).select("word", "form", "root", "n", "n_near", "form_n")
    assert sorted(map(tuple, got.collect())) == brute_forms(rows)
    assert spelling.spelling_forms(docs(rows).limit(0)).collect() == []
    assert spelling.spelling_forms(docs([(1, None)])).collect() == []


def test_no_partition_is_large(spark):
    """A third of all words share a beginning; all partitions stay within the bound."""
    rng = random.Random(4)
    words = {"prefixed" + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(3000)}
    words |= {"".join(rng.choice("ijklmnop") for _ in range(9)) for _ in range(1500)}
    words |= {"w" * 40 + a + "w" * 50 + b for a in "abcdefghijk" for b in "abcdefghijk"}
    d = spark.createDataFrame([(w,) for w in words], "word string").withColumn("id", spelling._id(F.col("word")))
    rows = spelling.partitions(d, 50)
    assert rows.groupBy("key").count().agg(F.max("count")).first()[0] <= 91
    ids = {bytes(r.id): r.word for r in d.collect()}
    got = [(ids[bytes(r.a)], ids[bytes(r.b)]) for r in spelling.compose(rows).collect()]
    assert len(got) == len(set(got))
    index = collections.defaultdict(set)
    for w in words:
        for k in range(len(w)):
            index[w[:k] + w[k + 1 :]].add(w)
    want = {(a, b) for own in index.values() for a in own for b in own if one_edit(a, b)} | {(a, b) for w in words for x in index.get(w, ()) if one_edit(w, x) for a, b in ((w, x), (x, w))}
    assert set(got) == want


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("ab", min_size=0, max_size=6), min_size=1, max_size=30))
def test_composition_by_brute_force(words):
    found = list(spelling.Composition(sorted(words)).pairs())
    want = {frozenset(p) for p in itertools.combinations(words, 2) if one_edit(*p)}
    assert len(found) == len(want) and {frozenset(p) for p in found} == want and all(len(a) <= len(b) for a, b in found)
