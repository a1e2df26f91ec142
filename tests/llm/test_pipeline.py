"""The pipeline's stages against brute-force versions on the smallest tables."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from agentscan.llm import contamination, language

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # a text of equal parts of all languages, and one without a label
    some = docs.where("length(text) > 400").groupBy("lang").agg(F.min(F.substring("text", 1, 400)).alias("t")).agg(F.array_join(F.array_sort(F.collect_list("t")), "\n").alias("text"))
    odd = some.select(F.lit(-1).cast("long").alias("doc_id"), "text", F.lit("en").alias("lang"), F.lit("src0").alias("source"), F.length("text").cast("long").alias("n_chars"))
    odd = odd.unionByName(docs.where("lang = 'de' and length(text) > 300").limit(1).withColumns({"doc_id": F.lit(-2).cast("long"), "lang": F.lit(None).cast("string")}))
    extra = docs.limit(3).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit("12 34")}))
    out = [docs.unionByName(extra).unionByName(odd)]
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        f(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "sharding"]


def test_language_keeps_what_one_language_has_most_of(stages):
    net = language.train(stages[0])
    want, rejected = Counter(), 0
    for r in stages[0].collect():
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        if not any(c.isalpha() for c in r.text or ""):
            continue
        p = net.pooled(raw, np.array([0, len(raw)]))[0]  # a text alone
        if p.max() >= 0.5:
            want[(r.doc_id, r.text, r.lang or net.languages[int(p.argmax())])] += 1
        else:
            rejected += 1
    got = stages[1].collect()
    assert Counter((r.doc_id, r.text, r.lang) for r in got) == want
    assert rejected and -1 not in {r.doc_id for r in got}
    assert [r.lang for r in got if r.doc_id == -2] == ["de"]
    assert len(got) > 0.98 * stages[0].count() - 5


def test_one_document_of_each_group_stays(stages):
    rows = stages[1].collect()
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 5, 0) + 1)} if w else set() for w in (words(r.text) for r in rows)]
    par = list(range(len(rows)))

    def root(x):
        while par[x] != x:
            x = par[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                par[root(a)] = root(b)
    least = {}
    for i, r in enumerate(rows):
        k = root(i)
        least[k] = min((x for x in (least.get(k), r.doc_id) if x is not None), default=None)
    assert Counter(r.doc_id for r in stages[2].collect()) == Counter(least.values())


def test_contaminated_documents_go_and_passages_are_cut(spark, stages):
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[k : k + 13]) for k in range(max(len(w) - 13, 0) + 1)} if w else set()
    want = Counter()
    for r in stages[2].collect():
        w, hit = words(r.text), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
        if hit and 20 * len(hit) >= len(w):
            continue
        text = r.text
        if hit:
            raw = text.encode()
            at = [m.span() for m in re.finditer(rb"[0-9a-zA-Z\x80-\xff]+", raw)]
            runs = [i for i in sorted(hit) if i - 1 not in hit]
            for i in reversed(runs):
                j = i
                while j + 1 in hit:
                    j += 1
                raw = raw[: at[i][0]] + raw[at[j][1] :]
            text = raw.decode()
        want[(r.doc_id, text, len(text) if text is not None and hit else r.n_chars)] += 1
    assert Counter((r.doc_id, r.text, r.n_chars) for r in stages[3].collect()) == want


def test_passages_are_cut_by_bytes(spark):
    item = " ".join(f"wört{i}" for i in range(13))
    rest = " ".join(f"öther{i}" for i in range(400))
    rows = [(0, f"({item.replace('w', 'W')}) {rest}"), (1, f"{rest}, {item}; {item}!"), (2, rest), (3, None), (4, ""), (5, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = contamination.decontaminate(docs, items)
    got = {r.doc_id: r.t for r in found.select("doc_id", contamination.without_spans(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got == {0: f"() {rest}", 1: f"{rest}, !", 2: rest, 3: None, 4: "", 5: ""}


CLASH = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, spans int, draws string, `a.b` int, __row__ int, hash string, blocks array<int>"


def test_stages_keep_clashing_columns_and_hard_rows(spark):
    long = " ".join(f"word{i % 900} the house" for i in range(60_000))
    texts = ["The small house stood by the old river and nobody lived there.", "Das kleine Haus stand am alten Fluss und niemand wohnte dort.", None, "", "?! 12", long, long + " end"]
    rows = [(i % 30, texts[i % len(texts)], (None, "en", "de")[i % 3], (None, "a", "b")[i % 3], i, "s", "x", 1, "d", 2, 3, "h", [1]) for i in range(60)] + [(None, texts[0], "en", None, 1, None, None, None, None, None, None, None, None)] * 4
    docs = spark.createDataFrame(rows, CLASH)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        have = Counter(map(str, docs.drop("lang").collect()))
        if name != "mixing sources to target weights":
            assert not Counter(map(str, out.drop("lang").collect())) - have, name
        else:
            assert set(map(str, out.drop("lang").collect())) <= set(have)
        assert stage(spark, docs.where("false"), SF).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, SF).count() == len(rows) and last(spark, docs.where("false"), SF).count() == 0


def test_mixture_and_shards(stages):
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in stages[3].collect()}
    drawn = Counter(r.doc_id for r in stages[4].collect())
    assert set(drawn) <= set(size) and max(drawn.values()) <= 2
    total, mixed = sum(size.values()), sum(size[k] * n for k, n in drawn.items())
    assert abs(mixed - 1.5 * total) < 0.02 * total
    out = stages[5].collect()
    assert Counter(r.doc_id for r in out) == drawn
    assert all(r.shard in range(16) and r.grown_shard in (r.shard, 16) and r.text_crc32 == zlib.crc32(r.text.encode()) for r in out)
    assert len({(r.doc_id, r.shard) for r in out}) == len(drawn)


def test_run_is_all_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
