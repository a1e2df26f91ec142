"""Texts of several megabytes, alone and beside short ones, through the operators that read whole texts."""

import hashlib
import re

import pytest

from agentscan.llm import archives, contamination, jaccard, language, licences, mixing, pages, sharding, tokens

LONG = " ".join(f"word{i % 5000}" for i in range(400_000))  # some 3.5 MB
UNBROKEN = "x" * 1_500_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(0, LONG + " released under the mit license", "en", "a"), (1, "short text of five words", "en", "a"), (2, LONG, "en", "b"), (3, UNBROKEN, None, None), (4, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_contamination(spark, docs):
    item = " ".join(f"word{i}" for i in range(4990, 5000)) + " released under the mit"
    items = spark.createDataFrame([(7, item), (8, " ".join(f"word{i}" for i in range(20)))], "item_id long, text string")
    got = {r.doc_id: r for r in contamination.decontaminate(docs, items).collect()}
    assert got[0].n_words == 400_005 and sorted(got[0]["items"]) == ["7", "8"] and got[2].n_hit == 20 * 80
    assert got[3].n_words == 1 and got[4].n_words == 0


def test_links(docs):
    got = {r.doc_id: (r.n_links, r.class_id) for r in jaccard.jaccard_join(docs).collect()}
    assert got == {0: (1, 0), 2: (1, 0), 1: (0, 1), 3: (0, 3), 4: (0, 4)}


def test_licences(docs):
    r = {x.doc_id: x for x in licences.scan(docs).collect()}
    assert (r[0].n_base, r[0].first_word, r[0].labels) == (1, 400_001, "mit") and r[3].n_words == 1


def test_language_and_tokens(docs):
    out = {x.doc_id: x.lang_pred for x in language.identify(docs, language.train(docs)).collect()}
    assert out[2] == "en" and out[4] == "und"
    model = tokens.load(tokens.vocabulary_path())
    n = {x.doc_id: x.n_tokens for x in tokens.token_counts(docs, tokens.vocabulary_path()).collect()}
    assert n[2] == len(model.encode(LONG)) and n[4] == 0


def test_mix_and_shards(docs):
    assert {x.doc_id: x["size"] for x in mixing.mix(docs, keep=["doc_id"]).collect()}[2] == 400_000
    assert {x.doc_id: x["size"] for x in sharding.shard_records(docs).collect()}[3] == len(UNBROKEN) + 1


def test_pages_and_archives(spark):
    html = "<article>" + "<p>A line &amp; more.</p>" * 60_000 + "</article>"
    p = spark.createDataFrame([(1, "http://h/1", html), (2, "http://h/2", html), (3, "http://h/3", "<" * 200_000), (4, "http://h/4", '<a "' * 50_000)], "page_id long, url string, html string")
    out = {r.page_id: r.text for r in pages.extract(p).collect()}
    assert out[1] == "\n\n".join(["A line & more."] * 60_000) and re.fullmatch("<*", out[3])
    back = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type) for r in archives.round_trip(p).collect()}
    assert back[2] == (len(html), hashlib.sha256(html.encode()).hexdigest(), "revisit")
