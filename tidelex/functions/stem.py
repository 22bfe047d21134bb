"""English (Porter2) stemming."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType

V = "aeiouy"
#: Fixed values of the public Porter2 definition.
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDING = "cdeghkmnrt"
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
KEPT_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP_2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""))
STEP_3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    if r1 is None:
        m = re.search(f"[{V}][^{V}]", w)
        r1 = m.end() if m else len(w)
    m = re.search(f"[{V}][^{V}]", w[r1:])
    return r1, r1 + m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search(f"[^{V}][{V}][^{V}wxY]$", w) or re.fullmatch(f"[{V}][^{V}]", w))


def stem(word: str) -> str:
    w = word.lower()
    if len(w) <= 2:
        return w
    if w in WHOLE:
        return WHOLE[w]
    w = w.removeprefix("'")
    w = re.sub(f"(^|[{V}])y", r"\1Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif re.search("(ied|ies)$", w):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not re.search("(us|ss)$", w) and re.search(f"[{V}].", w[:-1]):
        w = w[:-1]
    if w in KEPT_1A:
        return w
    if m := re.search("(eedly|eed)$", w):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search("(ingly|edly|ing|ed)$", w)) and re.search(f"[{V}]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in V:
        w = w[:-1] + "i"
    for old, new in STEP_2:
        if w.endswith(old):
            at = len(w) - len(old)
            if at >= r1 and (old != "ogi" or w[at - 1 : at] == "l") and (old != "li" or w[at - 1 : at] in tuple(LI_ENDING)):
                w = w[:at] + new
            break
    for old, new in STEP_3:
        if w.endswith(old):
            at = len(w) - len(old)
            if at >= (r2 if old == "ative" else r1):
                w = w[:at] + new
            break
    for old in STEP_4:
        if w.endswith(old):
            at = len(w) - len(old)
            if at >= r2 and (old != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


#: Stems that a worker has found, kept from batch to batch.
_FOUND: dict[str, str] = {}


def _stems(words: list[str | None], most: int = 1 << 17) -> pa.Array:
    if len(_FOUND) > most:
        _FOUND.clear()
    return pa.array([None if w is None else _FOUND.get(w) or _FOUND.setdefault(w, stem(w)) for w in words], pa.string())


@arrow_udf(ArrayType(StringType()))
def stems_of(tokens: pa.Array) -> pa.Array:
    """The stem of each token, found once for each distinct token of a batch."""
    flat = tokens.flatten().dictionary_encode()
    stems = _stems(flat.dictionary.to_pylist()).take(flat.indices)
    sizes = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), stems, mask=pc.is_null(tokens) if tokens.null_count else None)


@arrow_udf(StringType())
def stem_of(token: pa.Array) -> pa.Array:
    """The stem of a token, null for null."""
    each = token.dictionary_encode()
    return _stems(each.dictionary.to_pylist()).take(each.indices)
