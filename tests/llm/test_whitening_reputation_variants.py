"""Whitening, URL filters and spelling variants against brute force, and their defined cases."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import reputation, variants, whitening
from tidemark.llm.queries import QUERIES, URL_RULES
from tidemark.llm.reputation import Rule

VECTORS = "vec_id long, embedding array<double>, x string, d int, kept string, copies int"


# --- whitening ------------------------------------------------------------------------------------------------


def _vectors(rng, n, d=5):
    mix = rng.normal(size=(d, d))
    return [(i, [float(v) for v in rng.normal(size=d) @ mix]) for i in range(n)]


def _brute(rows, counted=False, most=16):
    """vec_id, n, deviation, whitened, explained, by numpy over all rows at once."""
    xs = {i: tuple(math.floor(64 * c) + 1_000_000 for c in v) for i, v in rows}
    fit = list(xs.values()) if counted else sorted(set(xs.values()))
    m = np.array(fit, object)
    n, s = len(fit), m.sum(axis=0)
    y = ((n * m - s) / n).astype(float)
    values, vectors = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-values)[:most]
    out = {}
    for i, x in xs.items():
        z = ((n * np.array(x, object) - s) / n).astype(float) @ vectors[:, order] / np.sqrt(values[order])
        out[i] = (n, int(((n * np.array(x, object) - s) ** 2).sum()), np.abs(z), values[order] / values.sum())
    return out


@pytest.mark.parametrize("counted", [False, True])
def test_whitening_against_brute_force(spark, counted):
    rows = _vectors(np.random.default_rng(3), 300)
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # a third of the rows are one vector
    df = spark.createDataFrame([(*r, "x", 1, "k", 9) for r in rows], VECTORS).repartition(5)
    found = whitening.whiten(df, weights="count" if counted else "one").collect()
    expected = _brute(rows, counted)
    assert sorted(r.vec_id for r in found) == sorted(expected)
    for r in found:
        n, deviation, z, explained = expected[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation)
        assert np.allclose(np.abs(r.whitened), z, rtol=1e-7, atol=1e-9) and np.allclose(r.explained, explained, rtol=1e-9)
        assert r.identity_error < 1e-9 and r.copies == (151 if r.vec_id == 0 or r.vec_id >= 1000 else 1)
    signs = np.array([r.whitened for r in sorted(found, key=lambda r: r.vec_id) if counted or r.vec_id < 300])
    assert np.allclose(signs.T @ signs / len(signs), np.eye(5), atol=1e-9)  # one sign for all rows of the fit list


def test_whitening_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, [1.0, None]), (3, [1.0, nan]), (4, [inf, 0.0]), (None, [0.5, 1.0]), (None, [0.5, 1.0]), (5, [0.25, -2.0]), (6, [3.0, 3.0]), (7, [1.0]), (8, []), (9, [1e300, -1e300, 2.0]), (10, [0.0, 0.0, 0.0]), (11, [0.0, 0.0, 1.0])]
    found = whitening.whiten(spark.createDataFrame([(*r, "x", 1, "k", 9) for r in rows], VECTORS)).collect()
    by = {r.vec_id: r for r in found}
    assert sorted(map(str, (r.vec_id for r in found))) == sorted(["None", "None", "5", "6", "7", "8", "9", "10", "11"])
    assert by[5].n == 3 and by[7].n == 1 and by[7].whitened == [None] and by[7].explained == [None]
    assert by[8].whitened == [] and by[9].whitened[-1] is None  # three vectors span two directions
    assert by[9].deviation is None and by[5].identity_error < 1e-9
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([], VECTORS), weights="none")


def test_whitening_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    expected = _brute(rows)
    found = QUERIES["op11_embedding_whitening"](spark, sf_dir).collect()
    assert len(found) == 16 * len(rows) and {r.component for r in found} == set(range(1, 17))
    for r in found:
        n, deviation, z, explained = expected[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation) and abs(abs(r.whitened) - z[r.component - 1]) < 1e-6
        assert abs(r.explained - explained[r.component - 1]) < 1e-9 and r.identity_error < 1e-4


# --- URL filters ----------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, host string, kept string, bad string, n int"


def _pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "k", "b", 1) for i, u in enumerate(urls)], PAGES)


def _outcomes(spark, rows):
    return spark.createDataFrame([(u, g) for u, g, n in rows for _ in range(n)], "url string, good boolean")


def test_rules_hosts_and_paths(spark):
    urls = [None, "", "no-scheme.com/en/", "http://WWW.Example.com/en/1?q=/x#y", "http://example.com/en/", "https://a.example.com/en", "http://a.example.com/fr/", "ftp://b.net/es/a", "http://net/fr/x",
            "http://xnet/fr/x", "http://example.com", "http://example.com?x=/en/", "a://b://example.com/en/", "http://ÀB.COM/", "http://example.com:80/en/", "http://x.com#f/en/", "http://notexample.com/en/"]
    found = {r.page_id: r for r in reputation.judge(_pages(spark, urls), _outcomes(spark, [("http://q.org/", True, 1)]), URL_RULES).collect()}
    expected = [("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("example.com", "/en/", "example.com/en/", "block"), ("a.example.com", "/en", "com/", "allow"),
                ("a.example.com", "/fr/", "com/", "allow"), ("b.net", "/es/a", "net/es/", "block"), ("net", "/fr/x", "net/fr/", "block"), ("xnet", "/fr/x", None, "allow"), ("example.com", "", None, "allow"), ("example.com", "", None, "allow"),
                ("b:", "//example.com/en/", None, "allow"), ("Àb.com", "/", "com/", "allow"), ("example.com:80", "/en/", None, "allow"), ("x.com", "", None, "allow"), ("notexample.com", "/en/", "com/", "allow")]
    assert [(found[i].host, found[i].path, found[i].rule, found[i].verdict) for i in range(len(urls))] == expected
    assert reputation.judge(_pages(spark, []), _outcomes(spark, []), URL_RULES).collect() == []
    tied = reputation.judge(_pages(spark, ["http://a.b/c/d"]), _outcomes(spark, []), [Rule("allow", "b", "/c/d"), Rule("block", "a.b", "/c/"), Rule("allow", "a.b", "/c/")]).first()
    assert (tied.rule, tied.verdict) == ("a.b/c/", "block")  # equal lengths: blocking first
    assert reputation.judge(_pages(spark, ["http://a.b/"]), _outcomes(spark, []), []).first().rule is None


def test_domains_and_suffixes(spark):
    hosts = ["a.b.c.com", "b.co.uk", "x.b.co.uk", "co.uk", "com", "", "10.0.0.1", "10.0.0.1:80"]
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select(reputation.domain_of(F.col("h")), reputation.suffix_of(F.col("h"))).collect()
    assert [tuple(r) for r in rows] == [("c.com", "com"), ("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("com", "com"), ("", ""), ("10.0.0.1", ""), ("10.0.0.1:80", "")]


def _shrunk(groups, worth):
    return {g: (k + worth * m) / (n + worth) for g, (n, k, m) in groups.items()}


def _moments(groups):
    seen = sum((k - n * m) ** 2 for n, k, m in groups.values())
    chance, more = sum(n * m * (1 - m) for n, k, m in groups.values()), sum(n * (n - 1) * m * (1 - m) for n, k, m in groups.values())
    r = (seen - chance) / more if more else 0
    return 10_000.0 if r <= 0 else min(10_000.0, max(1.0, 1 / r - 1))


def test_reputation_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for d in range(30):
        for h in range(rng.randrange(1, 6)):
            p = 0.1 if d % 7 == 0 else 0.85
            for good in (True, False):
                rows.append((f"http://h{h}.d{d}.{'com' if d % 2 else 'org'}/x", good, sum(rng.random() < (p if good else 1 - p) for _ in range(rng.choice([1, 4, 40])))))
    rows.append(("http://hot.big.com/", True, 3000))
    rows.append(("http://hot.big.com/", None, 5))
    urls = sorted({u for u, _, _ in rows}) + ["http://new.d0.org/", "http://new.d1.com/", "http://none.else/"]
    found = {r.host: r for r in reputation.reputations(_pages(spark, urls), _outcomes(spark, rows)).collect()}
    hosts = {u.split("/")[2]: [0, 0] for u in urls}
    for u, g, n in rows:
        if g is not None:
            hosts[u.split("/")[2]][0] += n
            hosts[u.split("/")[2]][1] += n * g
    up = lambda of, cut: {g: [sum(x[i] for h, x in of.items() if cut(h) == g) for i in (0, 1)] for g in {cut(h) for h in of}}
    domain, suffix = lambda h: ".".join(h.split(".")[-2:]), lambda h: h.split(".")[-1]
    domains, suffixes = up(hosts, domain), up(hosts, suffix)
    base = (sum(k for _, k in hosts.values()) + 1) / (sum(n for n, _ in hosts.values()) + 2)
    of_suffix = {g: (n, k, base) for g, (n, k) in suffixes.items()}
    of_suffix = _shrunk(of_suffix, _moments(of_suffix))
    of_domain = {g: (n, k, of_suffix[suffix(g)]) for g, (n, k) in domains.items()}
    of_domain = _shrunk(of_domain, _moments(of_domain))
    of_host = {g: (n, k, of_domain[domain(g)]) for g, (n, k) in hosts.items()}
    worth = _moments(of_host)
    for h, m in _shrunk(of_host, worth).items():
        sd = math.sqrt(m * (1 - m) / (hosts[h][0] + worth + 1))
        assert (found[h].n, found[h].k) == tuple(hosts[h])
        assert abs(found[h].mean - m) < 1e-9 and abs(found[h].upper - min(1, m + 1.645 * sd)) < 1e-9 and abs(found[h].lower - max(0, m - 1.645 * sd)) < 1e-9
    verdicts = {r.host: r.verdict for r in reputation.judge(_pages(spark, urls), _outcomes(spark, rows), []).collect()}
    assert verdicts == {h: "block" if found[h].upper < 0.5 else "allow" for h in hosts}
    assert "block" in verdicts.values() and verdicts["hot.big.com"] == verdicts["none.else"] == verdicts["new.d1.com"] == "allow"


# --- spelling variants ----------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, word string, id long, run string, doc string, n int, key string"


def _counted(rows):
    out = {}
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            w = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            out[w] = out.get(w, 0) + 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _groups(words, factor=10):
    out, form = {}, {}
    for w, n in words.items():
        near = [v for v in words if v != w and _near(v, w)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= factor * n else None
        out[w] = [n, len(near)]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] += [form[w], words.get(form[w]), root]
    return {w: tuple(x) for w, x in out.items()}


def _found(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_variants_against_brute_force(spark):
    rng = random.Random(8)
    stems = ["aabbaab", "aaaaaaa", "zzéàzzz", "banana×", "abcabca"]
    words = {}
    for s in stems:
        for _ in range(60):
            w = list(s)
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(w))
                how = rng.randrange(3)
                if how == 0:
                    w[i] = rng.choice("abcé")
                elif how == 1:
                    w.insert(i, rng.choice("abz"))
                elif len(w) > 1:
                    del w[i]
            words["".join(w)] = rng.choice([2, 2, 3, 20, 200, 2000])
    long = "".join(rng.choice("ab") for _ in range(300))
    words |= {long: 500, long[:150] + long[151:]: 40, long[:299] + "z": 4, "z" + long[1:]: 500, long + "q": 5}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(7)
    assert _found(variants.variant_groups(df)) == _groups(words)
    assert _found(variants.variant_groups(df, factor=2)) == _groups(words, 2)


def test_counts_whole_query_and_cases(spark, sf_dir):
    rng = random.Random(4)
    base = ["Strasse", "straßenbahn", "GROSSEN", "überall", "ÜBERALL", "x×yzabc", "kürzere"]
    rows = [(rng.choice([None, *range(40)]), " 7".join(rng.choice(base) + rng.choice(["", "", "s", "-q"]) for _ in range(30))) for _ in range(120)] + [(1, None), (2, ""), (3, "b" * 3000), (4, "b" * 3000), (5, "b" * 2999), (6, "b" * 2999)]
    df = spark.createDataFrame([(d, t, "w", 1, "r", "d", 2, "k") for d, t in rows], DOCS).repartition(3)
    counted = _counted(rows)
    assert {r.word: r.n for r in variants.count_words(df).collect()} == counted
    assert _found(variants.variant_groups(variants.count_words(df))) == _groups(counted)
    assert variants.variant_groups(variants.count_words(df.limit(0))).collect() == []
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.word: r.n for r in QUERIES["op13_permuterm_variants"](spark, sf_dir).collect()} == _counted(docs)


def test_a_word_of_many_letters_is_no_quadratic_work(spark):
    rows = [(i, "ab" * 150_000) for i in range(2)] + [(i, "ab" * 150_000 + "c") for i in range(2, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = variants.variant_groups(variants.count_words(df, one_in=None)).select(F.length("word").alias("l"), "n_near", "form").collect()
    assert sorted((r.l, r.n_near, r.form) for r in found) == [(300_000, 1, None), (300_001, 1, None)]


@pytest.mark.parametrize("width", [5, 32, 33, 40, 120])
def test_keys_are_those_of_the_substrings(width):
    ring = "".join(random.Random(1).choice("abé") for _ in range(200)) + "$"
    keys = list(variants._keys(ring, 2, width, len(ring) - width))
    texts = [ring[i : i + width] for i in range(2, len(ring) - width + 1)]
    assert len(set(keys)) == len(set(texts)) and all((a == b) == (k == m) for a, k in zip(texts, keys, strict=True) for b, m in zip(texts, keys, strict=True))
