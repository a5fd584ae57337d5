import hashlib
import random
import re

import pytest

from recordloom.llm import substring_dedup as sd


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def corpus(seed, few):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") if few else "".join(rng.choice("abcdefgh") for _ in range(3))
    passages = [[word() for _ in range(rng.randrange(5, 60))] for _ in range(6)]
    rows = [(0, None), (1, ""), (2, " \n "), (3, "a " * 40), (4, "a " * 30), (5, "a\tb  c\n" * 12)]
    for i in range(6, 70):
        text = []
        for _ in range(rng.randrange(1, 5)):
            text += [word() for _ in range(rng.randrange(0, 25))] + (rng.choice(passages) if rng.random() < 0.7 else [])
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(text)))
    rows += [(70, rows[20][1]), (71, rows[20][1]), (None, rows[20][1]), (8, rows[8][1])]
    return rows


@pytest.mark.parametrize("seed,few", [(1, False), (2, True), (3, True)])
@pytest.mark.parametrize("window,seed_words", [(13, 5), (8, 3)])
def test_against_brute_force(spark, seed, few, window, seed_words):
    rows = corpus(seed, few)
    df = spark.createDataFrame([(n, i, t, "x", 0) for n, (i, t) in enumerate(rows)], "n long, doc_id long, text string, kept_text string, sum long").repartition(4)
    got = sorted(sd.substring_dedup(df, window=window, seed=seed_words, keep=["n", "kept_text", "sum"]).collect(), key=lambda r: r["n"])
    assert [(r[sd.N_WORDS], r[sd.N_REMOVED], r[sd.KEPT]) for r in got] == brute(rows, window)
    assert all(sum(s["last"] - s["first"] + 1 for s in r[sd.SPANS]) == r[sd.N_REMOVED] for r in got)


def test_empty_and_limits(docs_of):
    assert sd.substring_dedup(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        sd.substring_dedup(docs_of(["a"]), window=90, seed=5)
