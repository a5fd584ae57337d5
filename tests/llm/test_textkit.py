import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from recordloom.llm.textkit import ALNUM, NOT_SPACE, Sequences, chunks, ranges, words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab Zé\t\n.1\x0b漢", max_size=30)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.sampled_from([8, 64, 1 << 20]), st.booleans())
def test_words(texts, most, lower):
    seen = {}
    for kind, pattern in ((NOT_SPACE, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        got = []
        for chunk in chunks(pa.array(texts, pa.string()), most):
            w = words(chunk, kind, lower)
            for r in range(chunk.hi - chunk.lo):
                part = range(w.first[r], w.first[r + 1])
                found = [w.data[w.start[k] : w.end[k]].tobytes().decode() for k in part]
                got.append(found)
                for k, x in zip(part, found):
                    assert seen.setdefault(x, w.hash[k]) == w.hash[k]
        low = lambda t: t.translate({i: i + 32 for i in range(65, 91)}) if lower else t
        assert got == [re.findall(pattern, low(t or "")) for t in texts]
    assert len(set(map(int, seen.values()))) == len(seen)


def test_sequences():
    h = np.arange(50, dtype=np.uint64)
    whole = Sequences(np.concatenate([h, h]))
    assert (whole.of(np.arange(40), 5) == whole.of(np.arange(50, 90), 5)).all()
    assert len(set(map(int, whole.of(np.arange(46), 5)))) == 46
    assert list(ranges(np.array([3, 10]), np.array([2, 3]))) == [3, 4, 10, 11, 12]
