"""Collocations, whitening and url verdicts against plain versions, and their edge cases."""

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from stepgrid.llm import phrases as phrases_module
from stepgrid.llm.phrases import Mining, collocations, frequent_phrases
from stepgrid.llm.urls import FLOOR, RULES, URLS_SQL, host_links, judge_pages, rule_table, spread
from stepgrid.llm.whitening import block_sums, cross_products, store, whiten
from stepgrid.session import configure

DOCS = "doc_id long, text string, lang string"
PAGES = "page_id long, url string, html string"
VECTORS = "vec_id long, embedding array<float>"


@pytest.fixture(scope="module", autouse=True)
def configured(spark):
    configure(spark)


# --- phrases


def plain_counts(docs, longest=5):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\v\f\r]", low):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts[lang][" ".join(words[i : i + n])] += 1
    return counts, total


def plain_collocations(docs, least, share=100, top=2000):
    counts, total = plain_counts(docs)
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if " " in p and a >= least}
        kept = []
        for p, a in found.items():
            w = p.split(" ")
            cuts = [(1000 * a * total[lang] // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            inside = [b for q, b in found.items() if len(q.split(" ")) > len(w) and f" {p} " in f" {q} "]
            if not any(100 * b >= share * a for b in inside):
                kept.append((-score, -a, p.encode(), f[" ".join(w[:k])], f[" ".join(w[k:])]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def invented(rows, seed=7):
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "Éclair", "x", "naïve", "日本", "a|b", "I", "to", "New", "York", "city", "hall", "\u00a0y", "Z"]
    weights = [9, 8, 1, 3, 1, 2, 1, 4, 5, 3, 3, 2, 2, 1, 1]
    out = []
    for i in range(rows):
        words = rnd.choices(vocabulary, weights, k=rnd.randrange(0, 60))
        text = "".join(w + rnd.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " \r\n", "?!"]) for w in words)
        out.append((i if i % 7 else None, text + "New York city hall " * (i % 3 == 0), rnd.choice(["en", "en", "en", "de", None])))
    return out


@pytest.mark.parametrize("least,share,top", [(3, 100, 2000), (10, 100, 5), (10, 60, 2000)])
def test_collocations_equal_counting_by_hand(spark, least, share, top):
    docs = invented(250)
    got = collocations(spark.createDataFrame(docs, DOCS).repartition(3), Mining(least=least, share=share, top=top))
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(docs, least, share, top)


@pytest.mark.parametrize("keep", [0xFF00000000000000, 0xFFF0000000000000, 0])
def test_shared_fingerprints_are_counted_by_text(spark, keep):
    docs = invented(120, 3)
    got = collocations(spark.createDataFrame(docs, DOCS), Mining(least=8, keep=keep))
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(docs, 8)


def test_small_bitmaps_and_slices_change_nothing(spark, monkeypatch):
    docs = invented(150, 5)
    whole = collocations(spark.createDataFrame(docs, DOCS), Mining(least=6, bits=15)).collect()
    assert sorted(tuple(r) for r in whole) == plain_collocations(docs, 6)
    monkeypatch.setattr(phrases_module, "HASH_BYTES", 5)
    data = np.frombuffer(b"one three thousandfold x", np.uint8)
    starts, ends = np.array([0, 4, 10, 23]), np.array([3, 9, 22, 24])
    short = phrases_module.word_prints(data, starts, ends, 0xABCD1235)
    monkeypatch.setattr(phrases_module, "HASH_BYTES", 1 << 20)
    assert (short == phrases_module.word_prints(data, starts, ends, 0xABCD1235)).all()
    assert len(set(short.tolist())) == 4


def test_places_beyond_a_pointer_are_found(spark, monkeypatch):
    monkeypatch.setattr(phrases_module, "PLACE_BITS", 3)
    docs = [(1, " ".join(f"w{i % 40}" for i in range(400)), "en"), (2, "", "en")]
    got = frequent_phrases(spark.createDataFrame(docs, DOCS), Mining(least=5))
    counts, total = plain_counts(docs)
    want = {(p, a) for p, a in counts["en"].items() if a >= 5} | {("", total["en"])}
    assert {(r["phrase"], r["f"]) for r in got.collect()} == want


def test_collocation_edges(spark):
    edge = [(1, None, "en"), (2, "", None), (3, "a b. a b", None), (3, "a b. a b", None), (None, "A B " * 3000, "en"), (5, "." * 50, "und"), (6, "x" * 300_000, "en")]
    docs = spark.createDataFrame([(*r, 1, "t") for r in edge], DOCS + ", words int, f string")
    got = collocations(docs, Mining(least=4))
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(edge, 4)
    empty = collocations(spark.createDataFrame([], DOCS))
    assert empty.collect() == [] and empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


# --- whitening


def test_cross_products_are_exact():
    rng = np.random.default_rng(1)
    for top, rows in [(2, 1), (1 << 13, 100), (1 << 40, 70), (1 << 62, 65)]:
        x = rng.integers(0, top, (rows, 5), dtype=np.uint64)
        want = x.astype(object).T @ x.astype(object)
        assert (cross_products(x) == want).all()
        y = rng.integers(-top, top, (rows, 3))
        sums, cross = block_sums(y // 2)
        z = (y // 2).astype(object)
        assert (sums == z.sum(axis=0)).all() and (cross == z.T @ z).all()


def plain_whitening(rows, most=8):
    used = [(i, [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(used), len(used[0][1])
    sums = [sum(x[k] for _, x in used) for k in range(d)]
    cov = [[Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for _, x in used), n**3) for j in range(d)] for i in range(d)]
    return used, n, sums, np.array([[float(c) for c in row] for row in cov])


def test_whitening_equals_exact_covariance(spark):
    rng = np.random.default_rng(4)
    mixed = rng.normal(size=(150, 9)) @ rng.normal(size=(9, 9)) * 0.2 + 3
    rows = [(i, v.tolist()) for i, v in enumerate(mixed)]
    rows += [(900, None), (901, [math.nan] * 9), (902, [1.0] * 8 + [None]), (903, [math.inf] + [0.0] * 8), (3, rows[3][1]), (None, rows[5][1])]
    got = whiten(spark.createDataFrame(rows, VECTORS).repartition(4)).collect()
    used, n, sums, cov = plain_whitening(rows)
    assert len(got) == 8 * len(used) == 8 * 152
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    by_id = {i: x for i, x in used}
    white = defaultdict(list)
    for r in got:
        x = by_id[r["vec_id"]]
        k = r["component"] - 1
        assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        want = (np.array(x) - np.array(sums) / n) @ vectors[:, k] / math.sqrt(values[k])
        assert abs(abs(r["whitened"]) - abs(want)) < 1e-7
        assert abs(r["explained"] - values[k] / values.sum()) < 1e-9 and r["identity_error"] < 1e-9
        white[k].append(r["whitened"])
    for k, w in white.items():
        assert abs(np.mean(np.square(w)) - 1) < 1e-9 and abs(np.mean(w)) < 1e-9


def test_whitening_edges(spark):
    make = lambda rows: whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert make([]) == [] and make([(1, None), (2, [math.nan])]) == [] and make([(1, []), (2, [])]) == []
    same = make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert len(same) == 4 and all(r["whitened"] == 0 and r["deviation"] == 0 and r["identity_error"] == 1 for r in same)
    ragged = make([(1, [1.0, 2.0]), (2, [3.0, 2.5]), (3, [1.0]), (4, [])])
    assert {r["vec_id"] for r in ragged} == {1, 2}
    huge = make([(1, [1e15, 1.0]), (2, [-1e15, 2.0]), (3, [3e38, 0.0]), (4, [0.0, 5.0])])
    assert {r["vec_id"] for r in huge} == {1, 2, 4} and all(r["deviation"] is None for r in huge if r["vec_id"] == 1)
    clash = spark.createDataFrame([(1, [1.0, 0.0], 5, 7), (2, [0.0, 1.0], 6, 8)], VECTORS + ", component int, v int")
    assert len(whiten(clash).collect()) == 4
    # int entries, many rows over a block
    many = whiten(spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(9000)], VECTORS)).where("component = 1")
    assert many.count() == 9000


def test_whitening_is_stored(spark):
    from stepgrid.llm.whitening import fitted

    path = store(fitted(2, [3, 5], [[5, 8], [8, 13]], 2), spark)
    assert [r["component"] for r in spark.read.parquet(path).orderBy("component").collect()] == [1, 2]


# --- urls


def linked(rnd, hosts, pages):
    out = []
    for i in range(pages):
        host = rnd.choice(hosts)
        links = "".join(rnd.choice(['<a href="http://{}/x">', "<A HREF = '//{}?q'>", "<a href=https://{}#t>", '<a href="/{}">']).format(rnd.choice(hosts).upper()) for _ in range(rnd.randrange(4)))
        out.append((i, f"http://{host}{rnd.choice(['/en/1', '/de/2', '/fr/3?x=/en/', '', '?a', '/'])}", links))
    return out


def plain_rule(host, path):
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, None)


def test_verdicts_equal_sql_and_rules_by_hand(spark):
    rnd = random.Random(11)
    hosts = ["example.net", "a.example.net", "b.net", "c.example.com", "example.com", "d.example.org", "org", "e.example.org", "f.com", "g.com", "xnet", "net"]
    rows = linked(rnd, hosts, 300) + [(1000, None, None), (None, "no scheme", "<a href='//b.net/'>"), (1001, "://", ""), (1002, "a://B.NET:80/en/", None), (1003, "http://Ä.NET/", None), (5, "x://y://z.net/a", None)]
    got = judge_pages(spark.createDataFrame(rows, PAGES), rule_table(spark, RULES))
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = con.execute(URLS_SQL)
    names = [d[0] for d in want.description]
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=key) == sorted(want.fetchall(), key=key)
    by_method = Counter()
    for r in got.collect():
        rule, verdict = plain_rule(r["host"], r["path"])
        assert r["rule"] == rule
        if verdict:
            assert r["verdict"] == verdict
        else:
            by_method[r["verdict"]] += 1
            assert r["verdict"] == ("block" if r["distrust"] >= FLOOR and r["distrust"] > r["trust"] else "allow")
    assert by_method["block"] and by_method["allow"]


def test_mass_follows_links(spark):
    links = spark.createDataFrame([("good", "near", 3), ("good", "far", 1), ("near", "far", 1), ("bait", "bad", 1), ("far", "bad", 9)], "source string, target string, pages long")
    seeds = spark.createDataFrame([("good", True), ("bad", False)], "host string, trusted boolean")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in spread(links, seeds).collect()}
    d = 0.85
    far = d / 4 + d * d * 3 / 4
    assert got["near"][0] == pytest.approx(d * 3 / 4) and got["far"][0] == pytest.approx(far)
    assert got["bad"][0] == pytest.approx(d * far) and got["bad"][1] == 1
    assert got["bait"] == (0, pytest.approx(d / 10)) and got["far"][1] == pytest.approx(d * 9 / 10)


def test_seeds_and_rules_of_any_kind(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x", '<a href="http://b.com">'), (2, "http://b.com/", ""), (3, "http://c.com/", "")], PAGES)
    seeds = spark.createDataFrame([("b.com", False), ("c.com", True), ("", True)], "host string, trusted boolean")
    none = rule_table(spark, [("block", "", "/")])
    got = {r["page_id"]: r["verdict"] for r in judge_pages(pages, none, seeds).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}
    ties = rule_table(spark, [("allow", "a.com", "/x"), ("block", "a.com", "/x"), ("allow", "com", "/")])
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in judge_pages(pages, ties).collect()}
    assert got == {1: ("a.com/x", "block"), 2: ("com/", "allow"), 3: ("com/", "allow")}


def test_url_edges(spark):
    assert judge_pages(spark.createDataFrame([], PAGES), rule_table(spark, RULES)).collect() == []
    rows = [(1, "http://" + "a." * 3000 + "net/", "href=" * 5000), (1, "http://" + "a." * 3000 + "net/", None), (2, "http://..net/", None), (3, None, None)]
    clash = spark.createDataFrame([(*r, "h", "r") for r in rows], PAGES + ", host string, rule string")
    got = sorted((r["page_id"], r["verdict"], r["rule"]) for r in judge_pages(clash, rule_table(spark, RULES)).collect() if r["page_id"] < 3)
    assert got == [(1, "block", "net/"), (1, "block", "net/"), (2, "block", "net/")]
    assert host_links(spark.createDataFrame([("a", None), ("a", "<a href='//a/'><a href='//b/'><a href='//B'>")], "host string, html string")).collect() == [("a", "b", 1)]
