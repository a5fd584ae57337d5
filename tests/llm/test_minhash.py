import random
import re

import numpy as np
import pytest

from recordloom.llm import components, minhash
from recordloom.llm.shared import materialise

TR = {i: i + 32 for i in range(65, 91)}


def sets_of(texts, size):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(TR))
        out.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def groups_of(sets, least, of):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and of * both >= least * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(x) for x in range(len(sets))]


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [None, "", "  \n", "One", "one", "two words", "Two  words", "x y z"]
    for _ in range(6):
        base = [word() for _ in range(rng.choice([8, 40, 150]))]
        for _ in range(rng.choice([1, 5, 12])):
            new = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 20) + 1)):
                new[rng.randrange(len(new))] = word()
            texts.append(" ".join(new))
    hub = [word() for _ in range(200)]
    for k in range(45):  # each is close to the hub only
        new = list(hub)
        for j in range(4):
            new[(k * 4 + j * 37) % 200] = word()
        texts.append(" ".join(new))
    texts.append(" ".join(hub))
    texts += [" ".join(hub).upper()] * 30
    return texts


@pytest.mark.parametrize("size,similar", [(3, (85, 100)), (5, (80, 100))])
def test_against_brute_force(docs_of, size, similar):
    texts = corpus()
    got = {r["node"]: r for r in minhash.near_dedup(docs_of(texts, extra=True), size=size, similar=similar).collect()}
    sets = sets_of(texts, size)
    want = groups_of(sets, *similar)
    assert [(got[i]["n"], got[i]["component"]) for i in range(len(texts))] == list(zip(map(len, sets), want))


def test_pools_of_paragraphs(docs_of):
    """Documents that draw 12 of the same 20 paragraphs meet in every bucket, but hardly any two are linked."""
    rng = random.Random(4)
    paragraphs = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30)) for _ in range(20)]
    drawn = list({tuple(sorted(rng.sample(range(20), 12))) for _ in range(600)})
    texts = ["\n".join(paragraphs[k] for k in ks) for ks in drawn]
    members = materialise(minhash.sketch(docs_of(texts), "text", "doc_id", 3, 5), "pool")
    live = members.selectExpr("node", "key", "n", "node as group")
    keyed = docs_of(texts).selectExpr("doc_id as node", "xxhash64(text) as key", "text")
    pairs, costs = minhash.remaining(live, keyed, 3, (85, 100))
    met = costs.selectExpr("sum(least(prefix, band)) as n").first()["n"]
    assert met < 40 * len(texts) and pairs.count() < 5 * len(texts)
    got = {r["node"]: r["component"] for r in minhash.near_dedup(docs_of(texts), size=3, similar=(85, 100)).collect()}
    assert [got[i] for i in range(len(texts))] == groups_of(sets_of(texts, 3), 85, 100)


def test_edits_of_one_text_meet_over_rare_shingles(docs_of):
    """Texts that share most of one text without being linked: the rarest shingles leave hardly a pair; no linked pair is lost."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(150)]
    texts = []
    for k in range(300):
        new = list(base)
        for _ in range(rng.choice([2, 4, 8, 12])):
            new[rng.randrange(150)] = word()
        texts.append(" ".join(new[: rng.choice([150, 150, 130])]))
    sets = sets_of(texts, 3)
    linked = {(a, b) for b in range(300) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    live = minhash.sketch(docs_of(texts), "text", "doc_id", 3, 5).selectExpr("node", "key", "n", "node as group")
    keyed = docs_of(texts).selectExpr("doc_id as node", "xxhash64(text) as key", "text")
    pairs, costs = minhash.remaining(live, keyed, 3, (85, 100))
    found = {(r["a"], r["b"]) for r in pairs.collect()}
    assert linked <= found and len(found) < 4 * len(linked)
    got = {r["node"]: r["component"] for r in minhash.near_dedup(docs_of(texts), size=3, similar=(85, 100)).collect()}
    assert [got[i] for i in range(300)] == groups_of(sets, 85, 100)


def test_keep_one(docs_of, spark):
    texts = ["a b c d e f g h", "A b c d e f g h", None, "", "q"]
    assert sorted(r["doc_id"] for r in minhash.keep_one(docs_of(texts, extra=True)).collect()) == [0, 2, 3, 4]
    odd = spark.createDataFrame([(None, "a b c d e f g h"), (3, "a b c d e f g h"), (3, "a b c d e f g h"), (None, "zz")], "doc_id long, text string")
    assert minhash.near_dedup(odd).count() == 4
    assert sorted(map(str, (r["doc_id"] for r in minhash.keep_one(odd).collect()))) == ["3", "None"]
    twice = spark.createDataFrame([(7, "c"), (7, "c"), (None, "d"), (None, "d"), (8, None), (8, None)], "doc_id long, text string")
    assert sorted(map(str, (r["doc_id"] for r in minhash.keep_one(twice).collect()))) == ["7", "8", "None"]
    assert minhash.near_dedup(docs_of([])).count() == 0


def test_superminhash_estimates_and_stops_early():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    rows = [values[:1000], values[200:1200], values[:1], values[:7], np.zeros(0, np.uint64)]
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    s = minhash.superminhash(np.concatenate(rows), first)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.15
    top = np.uint64(np.iinfo(np.uint64).max)
    assert (s[:4] != top).all() and (s[4] == top).all()
    # one element: its registers hold every step once
    assert sorted((s[2] >> np.uint64(40)).tolist()) == list(range(minhash.REGISTERS))
    alone = minhash.superminhash(values[:7], np.array([0, 7]))
    assert (alone[0] == s[3]).all()


def test_bands():
    assert minhash.rows_in_band((85, 100)) == 5 and minhash.rows_in_band((80, 100)) == 4
    assert minhash.rows_in_band((85, 100), minhash.WIDE) == 15 and minhash.rows_in_band((80, 100), minhash.WIDE) == 12


@pytest.mark.parametrize("most", [500_000, 7])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(components, "MOST_NODES", most)
    rng = random.Random(3)
    for edges in ([(i, i + 1) for i in range(120)], [(rng.randrange(200), rng.randrange(200)) for _ in range(150)], [(0, i) for i in range(1, 90)] + [(5, 5)], []):
        parent = {}

        def root(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            if a != b:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
        df = spark.createDataFrame(edges, "a long, b long").repartition(8)
        assert {r["node"]: r["component"] for r in components.components(df).collect()} == {x: root(x) for x in list(parent)}
