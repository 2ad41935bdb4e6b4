import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import kernels as K
from tests.llm.helpers import WORD, lower_az

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ \t\n\x0b.-é漢😀", max_size=40)), max_size=8)
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_windows(texts):
    data, offs = K.text_buffer(pa.array(texts, pa.string()))
    assert data.tobytes().decode() == "".join(t or "" for t in texts)
    raw = data.tobytes()
    for pattern, table in ((WORD, K.SPACE_WORDS), (ALNUM, K.ALNUM_WORDS)):
        w = K.Words(data, offs, True, table)
        got = [[] for _ in texts]
        names = {}
        for s, e, d, h in zip(w.start, w.end, w.doc, w.hash.tolist()):
            word = lower_az(raw[s:e].decode())
            got[d].append(word)
            assert names.setdefault(h, word) == word
        assert got == [pattern.findall(lower_az(t or "")) for t in texts]
        assert len(names) == len({x for g in got for x in g})
        for n in (1, 3):
            hashes, at = w.windows(n)
            want = [tuple(g[i:i + n]) for g in got for i in range(max(len(g) - n + 1, 1)) if g]
            assert len(hashes) == len(want)
            assert len(set(hashes.tolist())) == len(set(want))
            assert [int(d) for d in w.doc[at]] == [k for k, g in enumerate(got) for _ in range(max(len(g) - n + 1, 1)) if g]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=20), st.integers(1, 40))
def test_slices_cover_all_rows(sizes, limit):
    offs = np.append(0, np.cumsum(sizes)).astype(np.int64)
    parts = list(K.slices(offs, limit))
    assert [i for a, b in parts for i in range(a, b)] == list(range(len(sizes)))
    assert all(b - a == 1 or offs[b] - offs[a] <= limit for a, b in parts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=30))
def test_repeated(values):
    both, later = K.repeated(np.array(values, np.uint64))
    assert both.tolist() == [values.count(v) > 1 for v in values]
    assert later.tolist() == [v in values[:i] for i, v in enumerate(values)]


def test_sliced_array_and_even_deal():
    data, offs = K.text_buffer(pa.array(["abc", None, "dé", ""]).slice(1))
    assert data.tobytes().decode() == "dé" and offs.tolist() == [0, 0, 3, 3]
    chunks = np.concatenate([(np.arange(400) << 24) + k for k in range(3)])
    assert np.bincount(K.home(chunks, 16), minlength=16).max() < 2 * len(chunks) / 16
