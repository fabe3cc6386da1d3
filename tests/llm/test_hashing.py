import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from attestry.llm import hashing as H
from attestry.llm.common import text_buffer

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\t\n\x0b世", max_size=40)), min_size=1, max_size=8)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_and_prefixes_agree_with_a_regex(texts):
    raw, off = text_buffer(pa.array(texts, pa.string()))
    h, rows, pre = H.word_hashes(raw, off, prefixes=(2,))
    want = [words_of(t) for t in texts]
    assert [len(w) for w in want] == list(np.diff(rows))
    flat = [w for ws in want for w in ws]
    assert len({*h.tolist()}) == len({*flat}) and len({*zip(flat, h.tolist(), strict=True)}) == len({*flat})
    assert [x == 0 for x in pre[2].tolist()] == [len(w.encode()) < 2 for w in flat]


def test_a_word_hashes_alike_in_a_long_text_and_alone(monkeypatch):
    text = "alpha " * 30_000 + "x" * 200_000 + " omega"
    raw, off = text_buffer(pa.array([text, "alpha", "x" * 200_000, "omega"]))
    h, rows, pre = H.word_hashes(raw, off, prefixes=(3,))
    assert list(np.diff(rows)) == [30_002, 1, 1, 1]
    assert h[0] == h[29_999] == h[30_002] and h[30_000] == h[30_003] and h[30_001] == h[30_004]
    assert pre[3][30_000] == pre[3][30_003] and pre[3][30_001] == pre[3][30_004]


def test_shingles_short_rows_and_distinct():
    raw, off = text_buffer(pa.array(["a b c a b c", "a b", "", None, "a b c"]))
    words, rows, _ = H.word_hashes(raw, off)
    s, p = H.shingles(words, rows, 3)
    assert list(np.diff(p)) == [4, 1, 0, 0, 1]
    assert s[0] == s[3] == s[5] and s[4] != s[5]
    d, q = H.distinct_by_row(s, p)
    assert list(np.diff(q)) == [3, 1, 0, 0, 1] and len(d) == 5
    assert list(np.diff(H.shingles(words, rows, 3, "none")[1])) == [4, 0, 0, 0, 1]
