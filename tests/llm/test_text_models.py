"""Contamination, language ID, token counts, page text, archives and neighbours on small planted tables."""

import gzip
import hashlib
import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from agentscan.llm import archives, contamination, language, neighbours, pages, tokens


def split(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def test_decontamination_against_brute_force(spark, monkeypatch):
    r = random.Random(2)
    items = [(i, " ".join(f"w{r.randrange(40)}é" for _ in range(r.choice([1, 4, 13, 30])))) for i in range(30)] + [(30, None), (31, ""), (3, "again the number three " * 5), (None, "no number here")]
    docs = []
    for d in range(80):
        t = [f"w{r.randrange(60)}É" for _ in range(r.randrange(0, 120))]
        if d % 3 == 0:
            t[5:5] = (items[r.randrange(len(items))][1] or "").upper().split()
        docs.append((d, " ".join(t)))
    docs += [(80, None), (81, ""), (81, "no NUMBER here"), (None, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit(1))
    it = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for n, t in items:
        w = split(t)
        for k in range(max(len(w) - 13, 0) + 1) if w else ():
            windows[tuple(w[k : k + 13])].add("" if n is None else str(n))
    want = []
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        want.append((d, len(w), len(hit), tuple(sorted(found))))
    for limit in (contamination.BLOCK_WORDS, 100):  # one block of items, and several
        monkeypatch.setattr(contamination, "BLOCK_WORDS", limit)
        got = contamination.decontaminate(df, it, keep=["doc_id"]).collect()
        assert sorted(((x.doc_id, x.n_words, x.n_hit, tuple(sorted(x["items"]))) for x in got), key=str) == sorted(want, key=str)
        for x in got:
            assert sum(s.end - s.first for s in x.spans) == x.n_hit
            assert all(a.end <= b.first and a.to <= b["from"] for a, b in zip(x.spans, x.spans[1:], strict=False))
            text = next((t or "").encode() for d, t in docs if d == x.doc_id and len(split(t)) == x.n_words)
            assert all(len(split(text[s["from"] : s.to].decode())) == s.end - s.first for s in x.spans)
    assert contamination.decontaminate(df.where("false"), it).count() == 0
    assert {x.n_hit for x in contamination.decontaminate(df, it.where("false")).collect()} == {0}


def test_suffix_array_and_index():
    r = np.random.default_rng(1)
    seq = np.append(r.integers(0, 4, 500), 0)
    index = contamination.FMIndex(seq, 3)
    for size in (1, 2, 5):
        p = r.integers(1, 4, (50, size)).astype(np.int32)
        lo, hi = index.search(p, np.full(50, size))
        for row, a, b in zip(p, lo, hi, strict=True):
            want = [i for i in range(len(seq) - size + 1) if (seq[i : i + size] == row).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_language(spark):
    r = random.Random(4)
    syl = {"aa": ["tha", "ing", "er", "wh"], "bb": ["éau", "ouè", "çle"], "cc": ["sch", "ung", "über"]}
    rows = [(i, " ".join("".join(r.choice(syl[k]) for _ in range(3)) for _ in range(r.randrange(3, 60))), k) for i in range(300) for k in [r.choice(list(syl))]]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 ?! 42", "cc"), (1003, "thaing erwh tha", None), (None, "ouèéau çle", "bb"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    net = language.train(df)
    out = language.identify(df, net).collect()
    assert len(out) == len(rows)
    assert {x.lang_pred for x in out if x.doc_id in (1000, 1001, 1002)} == {"und"}
    held = [x for x in out if x.lang and x.lang_pred != "und" and x.doc_id is not None and language.crc_fold(x.doc_id) == 0]
    assert sum(x.lang == x.lang_pred for x in held) >= 0.95 * len(held)
    assert all(0 <= x.score <= 1 for x in out)
    none = language.train(df.where("lang is null"))
    assert none is None and {x.lang_pred for x in language.identify(df, none).collect()} == {"und"}
    assert language.identify(df.where("false"), net).count() == 0


def test_gradients_match_differences():
    net = language.Network(["a", "b", "c"])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    r = np.random.default_rng(3)
    seq, lab = r.integers(0, 256, (7, 5)), np.array([0, 1, 2, 1, 0])
    _, g = net.gradients(seq, lab)
    for k in ("ruf", "rrb", "rcf", "of", "ob", "b"):
        i = tuple(r.integers(0, s) for s in net.w[k].shape)
        keep, e = net.w[k][i], 1e-2
        net.w[k][i] = keep + e
        up, _ = net.gradients(seq, lab)
        net.w[k][i] = keep - e
        down, _ = net.gradients(seq, lab)
        net.w[k][i] = keep
        assert abs((up - down) / (2 * e) - g[k][i]) < 2e-3


def test_tokens_equal_the_library(spark):
    r = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "▁", "é", "日本", "\t", "the", "ing", "<s>", "\r", " \n", "　", "0", "🙂", "http://", "}{", "x" * 90]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(0, 14))) for _ in range(1500)] + [None, "", " ", "word " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    model = tokens.load(tokens.vocabulary_path())
    for x in tokens.token_counts(df, tokens.vocabulary_path()).collect():
        t = x.text or ""
        assert (x.n_tokens, x.n_bytes) == (len(model.encode(t)), len(t.encode())), repr(t)
        assert x.over_limit == (x.n_tokens > 4096)


PAGE = "<html><head><title>T</title><script>a<b</script></head><body><nav><li>Home</li></nav>{top}{body}<footer>© x</footer></body></html>"


def test_pages(spark):
    art = "<article><h1>One &amp; two</h1><p>Some <b>text</b><br>here<p>  More\n\t text </article>"
    free = "<div>Site line</div><div>Body of {}</div><p>Own words {}</p><div>Every page</div>"
    rows = [
        (1, "http://h/b/1", PAGE.format(top="<div class='ad'>Buy</div>", body=art)),
        (2, "http://h/a/2", PAGE.format(top="", body=free.format(2, 2))),
        (3, "http://h/a/3", PAGE.format(top="", body=free.format(3, 3))),
        (4, "http://alone/x", PAGE.format(top="", body=free.format(4, 4))),
        (5, None, None),
        (6, "not a url", ""),
        (7, "http://h/zz", "<article>cut <p>off &am"),
        (3, "http://h/a/3", PAGE.format(top="", body=free.format(3, 3))),
        (8, "http://q/8", PAGE.format(top="", body="<article><p>Main</p><section class='comments'><p>I disagree</p></section><form>Mail</form></article>")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    out = pages.extract(df).collect()
    got = {x.page_id: x.text for x in out}
    assert len(out) == len(rows)
    assert got[1] == "One & two\n\nSome text here\n\nMore text"
    assert got[2] == "Body of 2\n\nOwn words 2" and got[3] == "Body of 3\n\nOwn words 3"
    assert got[4] == "Site line\n\nBody of 4\n\nOwn words 4\n\nEvery page"
    assert got[5] == got[6] == "" and got[7] == "cut\n\noff &am" and got[8] == "Main"
    assert all(x.n_chars == len(x.text) for x in out)
    assert pages.extract(df.where("false")).count() == 0


def test_pages_difference_articles(spark):
    own = "<h1>Title {0}</h1><div>First of {0}</div><p>Second of {0}</p>"
    site = "<article><div>Ask us by mail</div>" + own + "<div>Rate this text</div></article>"
    copy = "<article>" + "".join(f"<p>Told again {i}</p>" for i in range(9)) + "<p>Print {}</p></article>"
    rows = [(i, f"http://s/a/{i}", PAGE.format(top="", body=site.format(i))) for i in (1, 2, 3)]
    rows += [(i, f"http://c/a/{i}", PAGE.format(top="", body=copy.format(i))) for i in (4, 5)]
    rows += [(6, "http://n/a/6", PAGE.format(top="<div class='ad'>Said</div>", body="<article><p>Said</p><p>Six</p></article>"))]
    rows += [(7, "http://n/a/7", PAGE.format(top="<div class='ad'>Said</div>", body="<article><p>Seven</p></article>"))]
    got = {x.page_id: x.text for x in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in (1, 2, 3):
        assert got[i] == f"Title {i}\n\nFirst of {i}\n\nSecond of {i}"
    for i in (4, 5):  # a copy of its neighbour is kept
        assert got[i].split("\n\n") == [f"Told again {n}" for n in range(9)] + [f"Print {i}"]
    assert got[6] == "Said\n\nSix" and got[7] == "Seven"  # a declared advert is no evidence


def test_pages_with_long_paths(spark):
    path = "http://h/" + "d" * 450
    texts = [("a", "Early", "A"), ("b1", "Early", "Late", "B"), ("b2", "Late", "C")]
    rows = [(i, f"{path}/{t[0]}", "".join(f"<p>{x}</p>" for x in t[1:])) for i, t in enumerate(texts)]
    got = {x.page_id: x.text for x in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Early\n\nB"  # the later page is nearer


def quadratic(a, b):
    """The length of a longest common subsequence, from the whole table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def subsequence(a, b):
    rest = iter(b)
    return all(x in rest for x in a)


def test_shared_lines_are_a_longest_common_subsequence():
    assert pages.shared([1, 2, 3, 4, 1], [2, 9, 4, 1, 3]) == [1, 3, 4]
    assert pages.shared([], [1]) == pages.shared([1], []) == []
    r = random.Random(8)
    for n in range(600):
        k = r.choice([2, 4, 30])
        a, b = ([r.randrange(k) for _ in range(r.randrange(40))] for _ in range(2))
        s = pages.shared(a, b)
        assert s == sorted(set(s)) and subsequence([a[i] for i in s], b) and len(s) == quadratic(a, b)


def test_pages_against_brute_force(spark):
    """Every page of the table: nearest page by all paths of its host, lines aligned by the whole table of lengths."""
    path = "/root/testdata/sf0.01/pages.parquet"
    rows = spark.read.parquet(path).collect()
    parsed = {}
    for r in rows:
        m = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)", r.url)
        parsed[r.page_id] = (m[1].lower(), m[2], r.page_id, pages.lines_of(r.html))
    order = sorted(parsed.values(), key=lambda x: x[:3])
    removed, got = 0, {r.page_id: r.text for r in pages.extract(spark.read.parquet(path)).collect()}
    for i, (host, p, k, lines) in enumerate(order):
        near = [(len(os.path.commonprefix([p, order[j][1]])), -j, j) for j in (i - 1, i + 1) if 0 <= j < len(order) and order[j][0] == host]
        own = [t for t, article, bad in lines if article and not bad]
        if near:
            a, b = ([t for t, _, bad in order[n][3] if not bad] for n in (i, max(near)[2]))
            assert len(pages.shared([hash(x) for x in a], [hash(x) for x in b])) == quadratic(a, b)
            gone = len(own) - len(got[k].split("\n\n"))
            assert subsequence(got[k].split("\n\n"), own) and gone in (0, quadratic(own, b))
            removed += gone
        else:
            assert got[k] == "\n\n".join(own)
    assert removed > 0


def test_pages_without_articles_lose_what_their_neighbours_share(spark):
    html = "<body class='page no-sidebar'><div>Menu of the site</div><div class='post has-comments'><p>Only here {0}</p><p class='share-of-market'>Shares {0}</p></div><div class='cookie-banner-wrapper'>We use {0}</div><div>Write to us</div></body>"
    rows = [(i, f"http://s/a/{i}", html.format(i)) for i in range(40)]
    rows += [(100 + i, f"http://s/b/{i}", "<body class='ads'><div id='top'><article class='no-sidebar'><p>Told {0}</p><div id='comments' class='comments-area'><article class='comment-body'>Not told {0}</article></div></article></div></body>".format(i)) for i in range(40)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Only here {i}\n\nShares {i}" for i in range(40))
    assert all(got[100 + i] == f"Told {i}" for i in range(40))


def test_archives_round_trip(spark):
    big = "<p>" + "x" * 200 + "</p>\r\n\r\nWARC/1.1\r\nend"
    rows = [(1, "http://a/é b", big), (2, "http://a/2", big), (3, None, None), (4, "http://a/4", ""), (5, "http://a/5", "short"), (6, "http://a/6", "short"), (7, "u", big + "ü🙂"), (2, "http://a/2", big), (1, "http://a/again", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("part", F.lit(9)).repartition(3)
    out = archives.round_trip(df).collect()
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = min(j for j, _, g in rows if (g or "") == (h or ""))
        again = len(b) >= 100 and first != i
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    assert sorted(((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in out), key=str) == sorted(want, key=str)
    assert all(x.sound for x in out)
    assert archives.round_trip(df.where("false")).count() == 0


@pytest.mark.parametrize("version", ["1", "2"])
def test_arc_headers_by_version(version):
    f = archives.FIELDS[version]
    body = f"{version} 0 x\n{' '.join(f)}\n"
    head = {"URL": "filedesc://x", "IP-address": "0.0.0.0", "Archive-date": "2001", "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": "x", "Archive-length": str(len(body))}
    data = (" ".join(head[k] for k in f) + "\n" + body).encode()
    page = {**head, "URL": "http://a/", "Content-type": "text/html", "Archive-length": "7"}
    data += ("\n" + " ".join(page[k] for k in f) + "\nab\n\ncde" + "\n" + " ".join(page[k] for k in f) + "\ncut").encode()
    got = list(archives.arc_records(gzip.compress(data)))
    assert [c for _, c in got] == [body.encode(), b"ab\n\ncde"] and got[1][0]["URL"] == "http://a/"
    assert archives._iso("2001") == "2001-01-01T00:00:00Z"


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 32)
    r = np.random.default_rng(6)
    x = r.normal(size=(400, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, x[7].tolist()) for i in range(120)]  # a very common vector
    rows += [(2000, None), (2050, []), (2100, [0.0] * 16), (2150, [float("nan")] * 16), (2200, [None] + [1.0] * 15), (None, x[3].tolist()), (0, x[0].tolist()), (3000, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    out = defaultdict(list)
    for q in neighbours.nearest(df).collect():
        out[q.query_id].append((q.rank, q.vec_id, q.score))
    ok = [(i, np.array(v, float)) for i, v in dict(r for r in rows if r[0] is not None and r[1]).items() if None not in v and np.isfinite(np.array(v, float)).all() and any(v) and len(v) == 16]
    ids, m = np.array([i for i, _ in ok]), np.array([v / np.linalg.norm(v) for _, v in ok])
    hit = n = 0
    for q in ids[ids % 50 == 0]:
        s = m @ m[ids == q][0]
        s[ids == q] = -9
        top = ids[np.lexsort((ids, -np.round(s, 12)))[:5]].tolist()
        got = sorted(out[q])
        assert [g[0] for g in got] == [1, 2, 3, 4, 5] and all(abs(g[2] - s[ids == g[1]][0]) < 1e-9 for g in got)
        hit += len(set(top) & {g[1] for g in got})
        n += 5
    assert hit >= 0.9 * n and not set(out) - set(ids.tolist())
    assert [g[1] for g in sorted(out[1000])] == [7, 1001, 1002, 1003, 1004]
    assert neighbours.nearest(df.where("false")).count() == 0


def test_codes_bound_the_cosine():
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 48)) ** 3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code, scale, away = neighbours.codes(x)
    near = (code * scale[:, None].astype(float)) @ (code * scale[:, None].astype(float)).T
    assert (np.abs(near - x @ x.T) <= away[:, None] + (1 + away[:, None]) * away + 1e-9).all()


def test_far_apart_and_scaled_vectors_are_found(spark):
    rows = [(0, [1.0, 0.0]), (1, [-1.0, 0.001]), (2, [0.0, -1.0]), (50, [3.0, 4.0]), (51, [6.0, 8.0]), (52, [1.5, 2.0]), (53, [1.5, 2.0]), (100, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = defaultdict(list)
    for q in neighbours.nearest(df).collect():
        out[q.query_id].append((q.rank, q.vec_id, q.score))
    assert [g[1] for g in sorted(out[50])] == [51, 52, 53, 0, 1] and {g[2] for g in out[50] if g[0] <= 3} == {1.0}
    assert [g[1] for g in sorted(out[0])] == [50, 51, 52, 53, 2] and 100 not in out


def recall(df, **how):
    rows = df.select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    size = np.linalg.norm(x, axis=1)
    hit = n = 0
    out = defaultdict(list)
    for q in neighbours.nearest(df, **how).collect():
        out[q.query_id].append((q.rank, q.vec_id, q.score))
    for i in np.flatnonzero(ids % 50 == 0):
        s = (x @ x[i]) / (size * size[i])
        s[i] = -9
        top = ids[np.lexsort((ids, -s))[:5]]
        got = sorted(out[ids[i]])
        assert (len(got) == 5 or not how.get("exact", True)) and all(abs(g[2] - s[ids == g[1]][0]) < 1e-12 for g in got)
        hit += len({g[1] for g in got} & set(top.tolist()))
        n += 5
    return hit / n


def clustered(spark, n=20_000, dim=32):
    r = np.random.default_rng(8)
    centres = r.normal(size=(n // 20, dim))
    x = centres[r.integers(0, len(centres), n)] + 0.35 * r.normal(size=(n, dim))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").where("vec_id % 2 = 1 or vec_id % 250 = 0")


def without_help(monkeypatch):
    """No floor: only hashing decides what a query finds."""
    monkeypatch.setattr(neighbours, "SAMPLE", 0)


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_against_brute_force(spark, monkeypatch, sf):
    df = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    assert recall(df) >= 0.9
    without_help(monkeypatch)
    assert recall(df, exact=False) >= 0.9


def test_recall_on_clusters_comes_from_the_probes(spark, monkeypatch):
    df = clustered(spark)
    without_help(monkeypatch)
    assert recall(df, exact=False) >= 0.9
    monkeypatch.setattr(neighbours, "TABLES", 1)
    monkeypatch.setattr(neighbours, "PROBES", 1)
    assert recall(df, exact=False) < 0.6


def test_exact_pass_in_cells(spark, monkeypatch):
    """Queries of which no bucket holds enough are compared with every entry, whatever the cells' sizes."""
    monkeypatch.setattr(neighbours, "TABLES", 1)
    monkeypatch.setattr(neighbours, "PROBES", 1)
    monkeypatch.setattr(neighbours, "EXACT_ENTRIES", 130)
    monkeypatch.setattr(neighbours, "EXACT_QUERIES", 2)
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=40 if i % 4 else 24).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = defaultdict(list)
    for q in neighbours.nearest(df).collect():
        out[q.query_id].append((q.rank, q.vec_id))
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    exact = 0
    for i in range(0, 900, 50):
        top = sorted((-float(unit[i] @ unit[j]), j) for j in unit if j != i and len(unit[j]) == len(unit[i]))[:5]
        assert len(out[i]) == 5
        exact += [j for _, j in sorted(out[i])] == [j for _, j in top]
    assert exact >= 15
