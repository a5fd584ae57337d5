import gzip
import hashlib
import io
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from recordloom.llm import bpe, decontaminate, exact_dedup, html_extract, language_id, minhash, pii, quality, substring_dedup, warc
from recordloom.llm.shared import OWN, new_path, summed
from recordloom.llm.textkit import chunks

tiktoken = pytest.importorskip("tiktoken")


# exact dedup


def test_exact_dedup(spark):
    rows = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " "), (7, "c"), (7, "c"), (None, "c"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1))
    got = sorted((r["doc_id"] or -1, r[exact_dedup.KEEP], r[exact_dedup.SIZE], r[OWN + "kept"]) for r in exact_dedup.exact_dedup(df).collect())
    assert [g for g in got if g[0] > 0] == [(1, 3, 3, False), (2, 3, 3, False), (3, 3, 3, True), (4, 6, 4, False), (5, 6, 4, False), (6, 6, 4, True), (7, 7, 3, True), (7, 7, 3, True)]
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in exact_dedup.keep_first(df.filter("doc_id < 7")).collect()) == [3, 6]


def test_digest_index_persists(spark):
    path = new_path(spark, "index")
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    rows = lambda x: exact_dedup.digests(docs(x), "text", "doc_id")
    one = exact_dedup.DigestIndex(spark, path, 4)
    one.add(rows([(5, "x"), (6, "y")]))
    two = exact_dedup.DigestIndex(spark, path)
    new, known = two.split(rows([(1, "x"), (2, "z"), (3, "z")]))
    assert [r[exact_dedup.KEEP] for r in new.collect()] == [2] and [r[exact_dedup.KEEP] for r in known.collect()] == [1]
    plan = new._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("SortMergeJoin") :].partition("Initial Plan")[0]
    assert "LeftAnti" in join and join.count("Exchange") == 1 and "Bucketed: true" in join
    two.add(rows([(1, "x"), (2, "z"), (3, "z"), (9, "z  ")]))
    got = {r[exact_dedup.KEEP]: r[exact_dedup.SIZE] for r in two.read().collect()}
    assert got == {5: 2, 6: 1, 9: 3}
    plan = two.read()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, path, 7)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        exact_dedup.DigestIndex(spark, path).add(rows([(7, "y"), (8, "w")]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    last = exact_dedup.DigestIndex(spark, path)
    assert {r[exact_dedup.KEEP]: r[exact_dedup.SIZE] for r in last.read().collect()} == {5: 2, 6: 2, 8: 1, 9: 3}
    # an increment that has no mark doesn't count
    last.marks += "-lost"
    last._mark("done-0-0")
    assert {r[exact_dedup.KEEP] for r in last.read().collect()} == {5, 6}
    assert not [t for t in spark.catalog.listTables() if "digests" in t.name]


def test_second_batch(spark):
    path = new_path(spark, "index")
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    take = lambda x: sorted((r["doc_id"], r[exact_dedup.KEEP], r[exact_dedup.SIZE], r[OWN + "kept"]) for r in exact_dedup.exact_dedup(docs(x), path=path).collect())
    assert take([(5, "x"), (6, "y"), (7, "y")]) == [(5, 5, 1, True), (6, 6, 2, True), (7, 6, 2, False)]
    assert take([(1, "x"), (2, "x "), (3, "z"), (4, "z ")]) == [(1, 5, 3, False), (2, 5, 3, False), (3, 4, 2, False), (4, 4, 2, True)]
    assert [r["doc_id"] for r in exact_dedup.keep_first(docs([(8, "y"), (9, "new"), (9, "new")]), path=path).collect()] == [9]
    odd = docs([(7, "c"), (7, "c"), (None, "d"), (None, "d"), (8, "a\tb"), (8, "a b")])
    assert sorted(str(r["doc_id"]) for r in exact_dedup.keep_first(odd).collect()) == ["7", "8", "None"]
    assert exact_dedup.keep_first(odd.limit(0)).count() == 0


# BPE


@pytest.fixture(scope="module")
def vocabulary():
    pytest.importorskip("public_tokenizers")
    return bpe.public_vocabulary()


def reference(codec, pattern):
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=codec.ranks, special_tokens={})


@pytest.mark.parametrize("least", [1, 64])
def test_bpe_is_exact(vocabulary, monkeypatch, least):
    monkeypatch.setattr(bpe, "LEAST_AT_ONCE", least)
    c, rng = bpe.Codec(bpe.read_vocabulary(vocabulary[0]), vocabulary[1]), random.Random(1)
    parts = ["a", "ab", "é", " ", "  ", "1", "²", "𝐀", "一", "the", "\n", "'s", "'ll", "\x1c", "\x85", "!", "aaaaaa", "\0", "😀", "́", "_", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(50))) for _ in range(1500)] + ["a" * 5000, "ab" * 3000, "".join(rng.choice("abcd") for _ in range(9000))]
    e = reference(c, vocabulary[1])
    for text, ids in zip(texts, c.joined(texts)):
        ids = [int(x) for x in ids.split(",")] if ids else []
        assert ids == e.encode_ordinary(text)
        assert c.decode(ids) == text.encode()


def test_bpe_forgets_within_bounds(vocabulary, monkeypatch):
    texts = ["one two " * k + "three\n\nfour" for k in range(12)] + ["x" * 3000, "", "two one"]
    table_ = bpe.read_vocabulary(vocabulary[0])
    e = reference(bpe.Codec(table_, vocabulary[1]), vocabulary[1])
    want = [e.encode_ordinary(t) for t in texts]
    for most, chars in ((3, 1 << 20), (1000, 40)):
        monkeypatch.setattr(bpe, "CACHE", most)
        monkeypatch.setattr(bpe, "CACHE_CHARS", chars)
        c = bpe.Codec(table_, vocabulary[1])
        assert [c.encode(t) for t in texts + texts] == want + want


@pytest.mark.parametrize("least", [1, 3, 64])
def test_bpe_with_ranks_in_any_order(monkeypatch, least):
    """Vocabularies in which merging makes pairs of lower rank."""
    monkeypatch.setattr(bpe, "LEAST_AT_ONCE", least)
    rng = random.Random(2)
    for _ in range(60):
        extra = list({bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(30)})
        rng.shuffle(extra)
        c = bpe.Codec.__new__(bpe.Codec)
        c.ranks = {t: i for i, t in enumerate([bytes([i]) for i in range(256)] + extra)}
        c.low = [0] * 2
        e = reference(c, r"[\s\S]+")
        texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 40))) for _ in range(15)]
        assert c.merge([t.encode() for t in texts]) == [e.encode_ordinary(t) for t in texts]


def test_bpe_frames(docs_of, vocabulary):
    texts = [None, "", "Hello world", "tab\tand  spaces ", "x" * 3000]
    c = bpe.Codec(bpe.read_vocabulary(vocabulary[0]), vocabulary[1])
    got = {r["doc_id"]: r for r in bpe.digests(docs_of(texts, extra=True), *vocabulary, with_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = reference(c, vocabulary[1]).encode_ordinary(t or "")
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs_of(texts), *vocabulary), *vocabulary).collect()
    assert all((r["text"] or "").encode() == bytes(r[OWN + "bytes"]) for r in back)
    assert bpe.digests(docs_of([]), *vocabulary).count() == 0


def test_bpe_gives_results_in_parts(docs_of, vocabulary, monkeypatch):
    """What a worker returns at once is bounded by a part of the texts, not by the batch that it gets."""
    texts = ["", None, *("word " * (k + 1) for k in range(200)), "x" * 5000, ""]
    docs, got = docs_of(texts), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: got.append(run))
    monkeypatch.setattr(bpe, "PART_BYTES", 2000)
    bpe.digests(docs, *vocabulary, with_ids=True)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts, pa.string())})
    parts = list(got[0](iter([batch, batch.slice(0, 0), batch.slice(150, 20)])))
    assert max(sum(len((texts[i] or "").encode()) for i in p["doc_id"].to_pylist()) for p in parts if len(p) > 1) <= 2000
    rows = [r for p in parts for r in p.to_pylist()]
    assert [r["doc_id"] for r in rows] == [*range(len(texts)), *range(150, 170)]
    c = bpe.Codec(bpe.read_vocabulary(vocabulary[0]), vocabulary[1])
    assert all(r["ids"] == c.encode(texts[r["doc_id"]] or "") and r["n_tokens"] == len(r["ids"]) for r in rows)


# decontamination


def test_decontamination(spark, docs_of):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh")
    items = [(k, " ".join(word() for _ in range(rng.randrange(0, 25)))) for k in range(25)] + [(30, None), (31, "..."), (32, "Solo"), (3, "x y z"), (None, "a b")]
    texts = [None, "", "solo", "SOLO, x;y\nz"]
    for _ in range(60):
        text = [word() for _ in range(rng.randrange(0, 40))]
        if rng.random() < 0.5:
            text += (items[rng.randrange(25)][1] or "").upper().split()
        texts.append(rng.choice([" ", ", ", "\n"]).join(text))
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    windows = {}
    for k, t in items:
        w = find(t)
        for s in range(len(w) - min(10, len(w)) + 1) if w and k is not None else ():
            windows.setdefault(tuple(w[s : s + min(10, len(w))]), set()).add(str(k))
    want = []
    for t in texts:
        w, hit, found = find(t), set(), set()
        for s in range(len(w)):
            for n in range(1, 11):
                if tuple(w[s : s + n]) in windows and s + n <= len(w):
                    found |= windows[tuple(w[s : s + n])]
                    hit |= set(range(s, s + n))
        want.append((len(w), len(hit), sorted(found)))

    def maximal(t, k, item):
        w, v = find(t), find(item)
        for a in range(len(w)):
            for b in range(len(v)):
                if not (a and b and w[a - 1] == v[b - 1]):
                    n = next((x for x in range(min(len(w) - a, len(v) - b)) if w[a + x] != v[b + x]), min(len(w) - a, len(v) - b))
                    if n >= min(10, len(v)):
                        yield a, str(k), b, n

    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 60):  # one block, and many
        got = {r["doc_id"]: r for r in decontaminate.find(docs_of(texts, extra=True), bench, block_bytes=block).collect()}
        assert [(got[i][decontaminate.N_WORDS], got[i][decontaminate.N_HIT], got[i][decontaminate.ITEMS]) for i in range(len(texts))] == want
        assert all(sum(s["last"] - s["first"] + 1 for s in r[decontaminate.SPANS]) == r[decontaminate.N_HIT] for r in got.values())
        for i, t in enumerate(texts):
            every = sorted(m for k, item in items if k is not None for m in maximal(t, k, item))
            assert [(m["first"], m["item_id"], m["at"], m["words"]) for m in got[i][decontaminate.MATCHES]] == every
            assert got[i][decontaminate.LONGEST] == max((m[3] for m in every), default=0)
        plan = decontaminate.find(docs_of(texts), bench, block_bytes=block)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1
    # two items side by side are two matches
    x, y = (" ".join(f"{c}{k}" for k in range(12)) for c in "xy")
    both = spark.createDataFrame([(1, x), (2, y)], "item_id long, text string")
    row = decontaminate.find(docs_of([f"{x} {y}"]), both).first()
    assert [(m["item_id"], m["first"], m["words"]) for m in row[decontaminate.MATCHES]] == [("1", 0, 12), ("2", 12, 12)] and row[decontaminate.LONGEST] == 12
    assert row[decontaminate.SPANS] == [(0, 23)]
    assert all(r[decontaminate.N_HIT] == 0 for r in decontaminate.find(docs_of(texts), bench.limit(0)).collect())
    assert decontaminate.find(docs_of([]), bench).count() == 0


# language identification


def test_language_id(spark):
    rng = random.Random(6)
    vocab = {"xx": "the and of with from this that".split(), "yy": "ünd der früh straße für nicht".split(), "zz": "мир дом и на вода".split()}
    rows = [(i, " ".join(rng.choice(vocab[k]) for _ in range(rng.randrange(3, 40))), k) for i, k in enumerate(["xx", "yy", "zz"] * 60)]
    rows += [(500, None, "xx"), (501, "", None), (502, "123 !!", "yy"), (503, "THE AND OF", None), (504, "é" * 10, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("s")).repartition(4)
    model = language_id.fit(df.filter("doc_id % 5 <> 0"))
    got = {r["doc_id"]: r for r in language_id.predict(df, model).collect()}
    held = [r for r in rows if r[0] % 5 == 0 and r[0] < 500]
    assert all(got[i][language_id.LANG] == k for i, _, k in held)
    assert [got[i][language_id.LANG] for i in (500, 501, 502, 503)] == ["und", "und", "und", "xx"] and got[504][language_id.LANG] != "und"
    assert all(0 <= r[language_id.SCORE] <= 1 for r in got.values()) and got[500][language_id.SCORE] == 0
    nothing = language_id.fit(df.limit(0))
    assert {r[language_id.LANG] for r in language_id.predict(df, nothing).collect()} == {"und"}


def test_language_id_against_brute_force(spark):
    """Counts, log-probabilities and posteriors by plain loops; equal texts get equal rows, and a tie the first language."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdeé ") for _ in range(rng.randrange(0, 60))) for _ in range(120)]
    rows = [(i, t, "pqr"[i % 3]) for i, t in enumerate(texts)] + [(200, texts[0], None), (201, texts[0], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    orders, buckets = (1, 2), 64
    model = language_id.fit(df, buckets=buckets, orders=orders)

    def keys(text, order):
        return language_id.ngrams(*language_id.code_points(next(iter(chunks(pa.array([text]))))), order, buckets)[0].tolist()

    counts = {lang: [[0.5] * buckets for _ in orders] for lang in "pqr"}
    for _, t, lang in rows:
        for k, order in enumerate(orders):
            for key in keys(t, order) if lang else ():
                counts[lang][k][key] += 1
    got = {r["doc_id"]: r for r in language_id.predict(df, model).collect()}
    for i, t, _ in rows:
        logs = [math.log(40 / 120) + sum(math.log(counts[lang][k][key] / sum(counts[lang][k])) for k, order in enumerate(orders) for key in keys(t, order)) for lang in "pqr"]
        best = max(logs)
        if any(c.isalpha() for c in t):
            assert got[i][language_id.LANG] == "pqr"[logs.index(best)]
            assert abs(got[i][language_id.SCORE] - 1 / sum(math.exp(x - best) for x in logs)) < 1e-9
        else:
            assert got[i][language_id.LANG] == "und"
    assert got[200][2:] == got[201][2:]
    same = language_id.fit(spark.createDataFrame([(1, "ab", "q"), (2, "ab", "p")], "doc_id long, text string, lang string"))
    assert language_id.predict(df.limit(1).selectExpr("doc_id", "'ab' as text"), same).first()[language_id.LANG] == "p"


def test_sums_of_very_many_tasks(spark):
    """Three steps give the sum of all tasks, whatever their number and width."""
    rows = [("a" if k % 3 else "b", k, w, np.array([k, -k * 1000, 1], f"i{w}").tobytes()) for k in range(400) for w in ((4, 8) if k % 2 else (8,))]
    got = {r["key"]: np.frombuffer(r["sums"], f"i{r['width']}").tolist() for r in summed(spark.createDataFrame(rows, "key string, task int, width int, sums binary"), ["key"]).collect()}
    for key in "ab":
        own = [k for name, k, _, _ in rows if name == key]
        assert got[key] == [sum(own), -1000 * sum(own), len(own)]


def test_word_vectors_against_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["one", "two", "thrée", "##", "x9"]) for _ in range(rng.randrange(0, 30))) for _ in range(50)] + [None, "", "one"]
    for n, d in ((64, 8), (256, 16)):
        place, sign = quality.index_vectors(n, d, quality.NONZEROS)
        want = np.zeros((n, d))
        for t in texts:
            own = quality.word_buckets(next(iter(chunks(pa.array([t], pa.string())))), n)[0].tolist()
            for i in range(len(own)):
                for j in range(max(0, i - quality.REACH), min(len(own), i + quality.REACH + 1)):
                    for k in range(quality.NONZEROS) if i != j else ():
                        want[own[i], place[own[j], k]] += sign[own[j], k]
        length = np.sqrt((want**2).sum(1, keepdims=True))
        got = quality.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), buckets=n, dimensions=d)
        assert np.allclose(got, want / np.where(length > 0, length, 1), atol=1e-6)


def test_very_long_texts(spark, docs_of):
    """Texts of a few megabytes, longer than any chunk, beside short ones."""
    rng = random.Random(9)
    words_ = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(5000)]
    long = [rng.choice(words_) for _ in range(350_000)]
    near = [*long[:-50], *("changed" for _ in range(50))]
    passage = " ".join(long[200_000:200_040])
    docs = docs_of([" ".join(long), " ".join(near), passage, "short", None], extra=True)
    got = {r["node"]: r["component"] for r in minhash.near_dedup(docs).collect()}
    assert [got[i] for i in range(5)] == [0, 0, 2, 3, 4]
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(docs).collect()}
    assert [got[i][substring_dedup.N_REMOVED] for i in range(5)] == [0, 350_000 - 50, 40, 0, 0]
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.find(docs, bench).collect()}
    assert [got[i][decontaminate.LONGEST] for i in range(5)] == [40, 40, 40, 0, 0] and got[0][decontaminate.SPANS] == [(200_000, 200_039)]
    model = language_id.fit(docs.selectExpr("*", "if(doc_id = 0, 'p', 'q') as lang"))
    got = {r["doc_id"]: r[language_id.LANG] for r in language_id.predict(docs, model).collect()}
    assert got[0] == "p" and got[4] == "und"
    scores = {r["doc_id"]: r[quality.SCORE] for r in quality.score(docs, quality.fit(docs, spark.createDataFrame([(0, 1), (3, 0)], "doc_id long, quality int"))).collect()}
    assert len(scores) == 5 and all(0 <= x <= 1 for x in scores.values())
    kept = exact_dedup.keep_first(docs.unionByName(docs.selectExpr("doc_id + 10 as doc_id", "text", "score", "n_words", "kept", "node")))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 4]


def test_ngrams_stay_inside_rows():
    for texts in (["ab", "", "c", "def"], ["", ""], ["x"], ["漢字", "é"]):
        for order in (1, 2, 3):
            for chunk in chunks(pa.array(texts)):
                points, offsets = language_id.code_points(chunk)
                key, first = language_id.ngrams(points, offsets, order, 1 << 15)
                assert list(np.diff(first)) == [max(0, len(t) - order + 1) for t in texts] and len(key) == first[-1]
                for r, t in enumerate(texts):
                    alone = next(iter(chunks(pa.array([t]))))
                    assert list(language_id.ngrams(*language_id.code_points(alone), order, 1 << 15)[0]) == list(key[first[r] : first[r + 1]])


# HTML


def test_html_blocks():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body class="home"><header>Site</header><nav><ul><li>Menu</li></ul></nav>
    <div class="cookie-notice">We use cookies</div><aside>Side</aside><div id="main"><article class="post"><h1>Head&nbsp;line</h1><p>One <b>bold</b>
    text&hellip;<br>next<p>Two &lt;tag&gt; &amp;amp; &#x41;<!-- hidden --><script>var t="</p>"; x<3</script><ul><li>a<li>b</ul><form><input><label>Name</label></form><div class="comments"><p>First!</p></div></article></div><footer>&copy; x</footer>"""
    assert html_extract.extract(page) == "Head line\nOne bold text… next\nTwo <tag> &amp; A\na\nb"
    assert html_extract.extract("") == "" and html_extract.extract("<p>x") == "x" and html_extract.extract("plain a < b") == "plain a < b"
    assert html_extract.extract("<article><p title='a > b'>x</p><p title=it's>y</p></article>") == "x\ny"
    assert html_extract.extract("<body><!-- open") == ""
    assert html_extract.extract('<div class="layout has-sidebar"><article><div class="entry-header"><h1>T</h1></div><p>x</p></article><div class="sidebar">no</div></div>') == "T\nx"
    assert html_extract.extract('<div class="post-header">T</div><p>x</p><div class="site-header">no</div><div id="footer">no</div>') == "T\nx"


def test_html_templates(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    rows, want = [], {}
    for i in range(24):
        body = [" ".join(word() for _ in range(rng.randrange(8, 30))) for _ in range(rng.randrange(2, 6))]
        inner = "".join(f"<p>{x}</p>" for x in body)
        rows.append((i, f"https://A.example/{i}", f"<html><body><div class=top><span>Always the same</span></div><div class=x><ul>{'<li>n</li>' * rng.randrange(1, 9)}</ul></div><div class=content>{inner}</div><div class=end>Same end</div></body></html>"))
        want[i] = "\n".join(body)
    rows += [(100, "http://b.example/", "<article><p>Own</p></article>"), (101, None, "<p>No host</p>"), (102, "http://b.example/2", None), (103, "", ""), (0, rows[0][1], rows[0][2])]
    want |= {100: "Own", 101: "No host", 102: "", 103: ""}
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("t")).repartition(4)
    got = html_extract.extract_main(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r[html_extract.TEXT] == want[r["page_id"]] and r[html_extract.N_CHARS] == len(want[r["page_id"]])
    deduced = html_extract.templates(df.select(html_extract.host(F.col("url")).alias("host"), F.xxhash64("page_id").alias("page"), "html").filter("host = 'a.example'")).collect()
    assert deduced[0]["main"].endswith("div.content") and len(deduced[0]["constant"]) >= 2
    assert html_extract.extract_main(df.limit(0)).count() == 0


# WARC


def test_warc(spark):
    big = "<p>ü</p>" * 400
    rows = [(1, "http://a/x y", big), (2, "http://b", big), (3, None, big), (4, "http://c", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "u", big), (8, "http://é\n", "z" * 70_000), (3, None, big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit(1)).repartition(3)
    archives = warc.write_warc(pages, new_path(spark, "warc"))
    assert sum(r["records"] for r in archives.collect()) == len(rows)
    for split in (100, 1000, 1 << 20):
        got = warc.read_warc(archives, split).collect()
        assert len(got) == len(rows)
        for r in got:
            if r["page_id"] is not None:
                html = next((h or "").encode() for i, _, h in rows if i == r["page_id"])
                assert r["payload_bytes"] == len(html) and r["payload_digest"] == hashlib.sha1(html).hexdigest()
                assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if r["page_id"] in (1, 2) else ("response", None))
                assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == html
    assert warc.read_warc(warc.write_warc(pages.limit(0), new_path(spark, "warc"))).count() == 0


def test_warc_scan_finds_each_record_once():
    """Ranges of any size, magic bytes inside payloads and between records."""
    rng = random.Random(3)
    raw, starts = b"", []
    for i in range(20):
        if rng.random() < 0.4:
            raw += warc.MAGIC + bytes(rng.randrange(256) for _ in range(rng.randrange(30)))
        starts.append(len(raw))
        raw += gzip.compress(warc.record(i, "u", warc.MAGIC * rng.randrange(5) + bytes(rng.randrange(256) for _ in range(rng.randrange(2000))), "response", None))
    for size in (1, 37, 500, 10**6):
        got = [at for lo in range(0, len(raw), size) for at, _ in warc.records(io.BytesIO(raw), lo, min(len(raw), lo + size))]
        assert got == starts
    with pytest.raises(EOFError):
        list(warc.records(io.BytesIO(raw[:-20]), 0, len(raw)))


# personal data


def test_pii_rules():
    text = "Mail Ann.Lee@corp.example.com or ann.lee@corp.example.com, call +1 (017) 555-7713 / +1 017 555 7713; card 4539 1488 0343 6467, not 4539 1488 0343 6468. Host 97.51.17.173, version 1.2.3. token = \"04dbebab91ab85687d33\". Frau Dr. Weber and Herr WEBER. IBAN DE89 3704 0044 0532 0130 00."
    found = [(text[a:b], k) for a, b, k, _ in pii.find(text)]
    assert [k for _, k in found] == ["email", "email", "phone", "phone", "card", "ip", "secret", "name", "name", "iban"]
    new, spans = pii.replaced(text, b"k", {})
    assert not any(x in new for x, _ in found)
    values = [new[s["start"] : s["end"]] for s in spans]
    assert values[0].lower() == values[1].lower() and values[0][0].isupper()
    assert pii.digits_of(values[2]) == pii.digits_of(values[3]) and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", values[2])
    assert pii.luhn(pii.digits_of(values[4])) and values[4].count(" ") == 3
    # a woman and a man of one name in one text are two
    assert values[8].isupper() and values[8] != values[7].upper() and values[7][1:].islower()
    assert values[0].rpartition("@")[2].lower() == values[1].rpartition("@")[2]
    assert pii.iban_ok(values[9].replace(" ", ""))
    assert [s["kind"] for s in spans] == [k for _, k in found] == [e[2] for e in pii.find(new)]
    assert pii.replaced(text, b"other", {})[0] != new
    clean = "Nothing here: 4.0, 12-34, a@b, 3.14.15 and 1,234,567."
    assert pii.replaced(clean, b"k", {}) == (clean, [])


def test_pii_is_a_bijection_and_checked(spark, docs_of):
    assert len({pii.surrogate(b"k", "ssn", f"{k:09d}") for k in range(3000)}) == 3000
    # two-letter names: their surrogates meet other real names again and again
    rng = random.Random(1)
    names = sorted({rng.choice("bcdfg") .upper() + rng.choice("aeiou") for _ in range(200)})
    texts = [f"Mr {a} met Mr {b}" for a in names for b in names[:3]] + [None, "", "clean text"]
    got = {r["doc_id"]: r for r in pii.pseudonymise(docs_of(texts, extra=True), key=b"k").collect()}
    mapping = {}
    for i, t in enumerate(texts):
        if not t or t == "clean text":
            assert got[i][pii.TEXT] == t and got[i][pii.ENTITIES] == []
            continue
        old, new = re.findall(r"Mr (\w+)", t), re.findall(r"Mr (\w+)", got[i][pii.TEXT])
        for a, b in zip(old, new):
            assert mapping.setdefault(a, b) == b
    assert len(set(mapping.values())) == len(names) and not set(mapping.values()) & set(names)
    assert pii.pseudonymise(docs_of([]), key=b"k").count() == 0


# quality


def test_quality(spark):
    rng = random.Random(2)
    good = "the river runs past old stone houses and green fields where people walk".split()
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join((rng.choice(good) + "###") if bad else rng.choice(good) for _ in range(rng.randrange(5, 60)))))
        labels.append((i, 0 if bad else 1))
    rows += [(900, None), (901, ""), (902, "  ")]
    labels += [(None, 1), (901, None), (3, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).repartition(4)
    frame = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r["doc_id"]: r[quality.SCORE] for r in quality.score(docs, quality.fit(docs, frame.filter("doc_id % 5 <> 0"))).collect()}
    held = [(got[i], y) for i, y in labels if i is not None and i % 5 == 0 and y is not None]
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and got[900] == got[901] == got[902]
    one = quality.fit(docs, frame.limit(0))
    assert len({round(r[quality.SCORE], 9) for r in quality.score(docs, one).collect()}) == 1


# the registered queries and the pipeline


def test_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names


def test_pipeline(spark, tmp_path, vocabulary):
    import corpus_pipeline

    rng = random.Random(5)
    word = lambda k: "".join(rng.choice(k) for _ in range(5))
    texts = [" ".join(word("abcdefghij" if i % 2 else "uvwxyzäöüß") for _ in range(60)) for i in range(40)]
    leak = " ".join(word("abcdefghij") for _ in range(15))
    near = texts[3].split()
    near[0] = "changed"
    rows = [(i, t, "ab"[i % 2], "s", len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[5].replace(" ", "  "), "b", "s", 1), (101, " ".join(near), "b", "s", 1), (102, texts[7] + " " + leak, "b", "s", 1), (103, None, "a", "s", 0), (104, "123 !", "a", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    # of equal texts the longer one stays; 102 is no near copy of 7, since a fifth of it is new
    assert got == sorted(set(range(40)) - {5} | {100})
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def _hosted(spark, bodies):
    df = spark.createDataFrame([(i, f"https://h.example/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)], "page_id long, url string, html string").repartition(3)
    return [r[html_extract.TEXT] for r in html_extract.extract_main(df).orderBy("page_id").collect()]


def test_html_template_text_in_articles_is_dropped_by_class(spark):
    # two adverts on as many pages each, but not the same ones: only the vectors tell their classes apart; headings that pages share are no class
    advert = lambda k: f"<div class=x{'ab'[k]}><h4>Buy {k}</h4><p>Now {k}</p></div>"
    own = [f"Own text {i} of the page, longer than all the rest {i * i}" for i in range(12)]
    bodies = [f"<article><p>{t}</p>{advert(0) if i < 8 else ''}<p>Notice of the host</p>{advert(1) if i >= 4 else ''}<p>Intro</p>{'<p>Intro</p>' * (i % 2)}</article>" for i, t in enumerate(own)]
    assert _hosted(spark, bodies) == ["\n".join([t, *["Intro"] * (1 + i % 2)]) for i, t in enumerate(own)]
    # copies of one page are no template
    copy = "<article><h1>Title</h1><p>The same text on all these pages</p></article>"
    assert _hosted(spark, [copy] * 5) == ["Title\nThe same text on all these pages"] * 5


def test_html_main_slot_encloses_all_varying_text(spark):
    body = lambda i: " ".join(f"w{i * 7 + k}" for k in range(40))
    bodies = [f"<div class=top>Same top</div><div class=post><h1>Title {i}</h1><div class=lead>Lead {i}</div><div class=body><p>{body(i)}</p></div></div><div class=end>Same end</div>" for i in range(8)]
    assert _hosted(spark, bodies) == [f"Title {i}\nLead {i}\n{body(i)}" for i in range(8)]


def test_pii_bare_mentions_of_a_name():
    text = "Weber kam. Frau Weber-Lindt und Dr. Weber: WEBER, Weber's weber Webern. Lindt@a.example Anna"
    new, spans = pii.replaced(text, b"k", {})
    name, other = re.search(r"Frau (\w+)-(\w+)", new).groups()
    assert new.startswith(f"{name} kam. Frau {name}-{other} und Dr. {name}: {name.upper()}, {name}'s weber Webern. ") and new.endswith(" Anna")
    assert "Weber" not in new.replace("Webern", "") and name != "Weber" and other != "Lindt"
    assert [s["kind"] for s in spans] == ["name"] * 6 + ["email"]
    assert pii.replaced("Weber kam.", b"k", {})[0] == "Weber kam."


def test_pii_gender_and_script():
    ends = lambda script, tag: tuple(pii.SYLLABLES[script][2][tag])
    new, _ = pii.replaced("Mr Smith met Mrs Smith. Smith said hello; John Smith left. Mr John Smith and Prof Lee; Sr Developer, Sr. Gómez", b"k", {})
    he, she, last, john, again, full, family, lee, dev, gomez = re.fullmatch(r"Mr (\w+) met Mrs (\w+)\. (\w+) said hello; (\w+) (\w+) left\. Mr (\w+) (\w+) and Prof (\w+); Sr (\w+), Sr\. (\w+)", new).groups()
    assert last == again == she != he == family and john == full and dev == "Developer"
    assert he.endswith(ends("latin", "ms")) and she.endswith(ends("latin", "fs")) and john.endswith(ends("latin", "mg")) and lee.endswith(ends("latin", "ns")) and gomez != "Gómez"
    new, _ = pii.replaced("г-н Иванов и г-жа Анна Петрова; Петрова, Mme 李娜", b"k", {})
    he, anna, she, again, han = re.fullmatch(r"г-н (\w+) и г-жа (\w+) (\w+); (\w+), Mme (\w+)", new).groups()
    assert he.endswith(ends("cyrillic", "ms")) and anna.endswith(ends("cyrillic", "fg")) and she.endswith(ends("cyrillic", "fs")) and she == again and "\u3400" <= han[0] <= "\u9fff"


def test_pii_against_brute_force(spark, docs_of):
    """Distinctness, coreference and no original left, over texts that share entities."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("bdfgklm") + rng.choice("aeiou") for _ in range(3)).capitalize()
    people = [(rng.choice(["Mr", "Mrs", "Herr", "Frau"]), word(), word()) for _ in range(60)]
    mails = [f"{word().lower()}@{d}.example" for d in ("one", "two", "three") for _ in range(15)]
    texts, used = [], []
    for _ in range(120):
        title, given, family = rng.choice(people)
        mail = rng.choice(mails)
        texts.append(f"{title} {given} {family} wrote from {mail}. Then {given} left, and {family.upper()} was gone; {mail.upper()}")
        used.append((title, given, family, mail))
    texts += [None, "", "nothing here " * 20_000]
    got = {r["doc_id"]: r[pii.TEXT] for r in pii.pseudonymise(docs_of(texts, extra=True), key=b"another").collect()}
    assert [got[i] for i in range(120, 123)] == texts[120:]
    originals = {x.lower() for t, g, f, m in used for x in (g, f, m)}
    seen, back = {}, {}
    for i, (title, given, family, mail) in enumerate(used):
        g, f, m, g2, f2, m2 = re.fullmatch(rf"{title} (\w+) (\w+) wrote from (\S+)\. Then (\w+) left, and (\w+) was gone; (\S+)", got[i]).groups()
        assert (g2, f2, m2) == (g, f.upper(), m.upper())
        gender = "mf"[title in ("Mrs", "Frau")]
        for old, new in (((gender, "given", given), g), ((gender, "family", family), f), (mail, m), ("domain " + mail.rpartition("@")[2], m.rpartition("@")[2])):
            assert seen.setdefault(old, new) == new and back.setdefault(new, old) == old
            assert new.lower() not in originals
    assert not any(re.search(rf"\b{x}\b", t.lower()) for x in originals for t in (got[i] for i in range(120)))
