import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkreel.llm import textbytes as tb


def plain_sets(texts, width):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()})
    return out


def hashed_sets(texts, width, size=tb.BLOCK_BYTES):
    out = []
    for i, j, data, offsets in tb.blocks(pa.array(texts, pa.string()), size):
        values, starts = tb.shingle_sets(*tb.words(data, offsets), width)
        out += [set(values[starts[k] : starts[k + 1]].tolist()) for k in range(j - i)]
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aAbBéß \n\t.", max_size=30)), max_size=8), st.integers(1, 5))
def test_sets_agree_with_plain_python(texts, width):
    plain, hashed = plain_sets(texts, width), hashed_sets(texts, width, 40)
    assert [len(x) for x in plain] == [len(x) for x in hashed]
    for a in range(len(texts)):
        for b in range(len(texts)):
            assert len(plain[a] & plain[b]) == len(hashed[a] & hashed[b])


def test_long_texts_are_read_in_pieces():
    text = " ".join(f"w{i % 5000}" for i in range(600_000))
    assert len(text) > 2 * tb.BLOCK_BYTES
    assert len(hashed_sets([text], 1)[0]) == 5000
    giant = "x" * (3 * tb.BLOCK_BYTES) + " y"
    assert len(hashed_sets([giant], 1)[0]) == 2


def test_words_at_text_borders_stay_apart():
    values, starts = tb.shingle_sets(*tb.words(np.frombuffer(b"abcd", np.uint8), np.array([0, 2, 4])), 1)
    assert len(values) == 2 and starts.tolist() == [0, 1, 2]
