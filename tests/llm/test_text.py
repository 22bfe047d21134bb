import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelex.llm import textvec

TEXT = st.text(st.sampled_from("aAbé \t\n\x0b.!😀"), max_size=60)


@settings(deadline=None, max_examples=80)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6), st.sampled_from([3, 7, 1 << 20]))
def test_tokens_are_the_words(texts, limit):
    got = [[] for _ in texts]
    ended = []
    for rows, h, whole in textvec.tokens(pa.array(texts, pa.string()), limit=limit):
        ended += whole.tolist()
        for r, x in zip(rows.tolist(), h.tolist(), strict=True):
            got[r].append(x)
    low = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w)
    assert got == [[textvec.hash_text(low(w)) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    assert ended == list(range(len(texts)))


@settings(deadline=None, max_examples=60)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_char_grams_stay_within_words(texts):
    buf, first, rows, _ = next(iter(textvec.chunks(*textvec.utf8(pa.array(texts, pa.string())))))
    chars, at = textvec.code_points(buf, first)
    whole = "".join(texts)
    assert "".join(map(chr, chars)) == whole
    bounds = np.r_[at, len(chars)]
    for k, starts, _ in textvec.char_grams(chars, at, (3, 4)):
        want = [i for a, b in zip(bounds, bounds[1:], strict=False) for i in range(a, b - k + 1) if not re.search(r"[\x20\x09-\x0D]", whole[i + 1 : i + k - 1])]
        assert starts.tolist() == want
