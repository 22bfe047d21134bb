"""Text functions on columns, without UDFs."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letter classes of the two languages that words and dictionary entries are made of, and tokens of any script.
WORD = "[a-záéíóúüñàèìòùâêîôûäëïöü]+"
ENTRY = "^[a-záéíóúüñ]+$"
TOKEN = r"[\p{L}\p{Nl}\p{No}]+"
SENTENCE_GAP = r"(?<=[.!?])\s+"


def sentences(text: Column) -> Column:
    """Pieces between whitespace that follows a full stop, exclamation or question mark; stripped, none empty."""
    return F.filter(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), SENTENCE_GAP, -1), lambda s: s != "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


#: Runs of letters, numbers and underscores: what is left when all else becomes a space.
PLAIN = r"[\p{L}\p{N}_]+"


def plain_tokens(text: Column) -> Column:
    """The lower-cased text split at all that is no letter, number or underscore; digits and mixed words stay, which tokens() leaves out."""
    return F.regexp_extract_all(F.lower(text), F.lit(PLAIN), F.lit(0))


def words(text: Column) -> Column:
    """The distinct words, in the order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def valid_entry(word: Column) -> Column:
    return (F.length(word) >= 2) & word.rlike(ENTRY)


def row_uuid(lang: Column, focal: Column, sentence: Column) -> Column:
    """The first 16 bytes of a SHA-256 over lang:focal:sentence, in UUID form."""
    h = F.sha2(F.concat_ws(":", lang, focal, sentence), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def shift_spans(spans: Column, by: Column) -> Column:
    """Spans of a text, moved to where they are after a prefix of that length."""
    return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end")))


def trim_around(sentence: Column, targets: Column, window: int = 5) -> Column:
    """The words up to window places from the first target word (compared lower-cased, without outer ASCII punctuation)."""
    # Parts, bare words and the place are bound once each, not worked out again for every target and use.
    once = lambda x, f: F.transform(F.array(x), f)[0]
    bare = lambda w: F.lower(F.regexp_replace(w, r"""^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$""", ""))
    first = lambda p: once(F.transform(p, bare), lambda b: F.array_min(F.filter(F.transform(targets, lambda t: F.array_position(b, t)), lambda i: i > 0)).cast("int"))
    low = lambda at: F.greatest(at - window, F.lit(1))
    cut = lambda p, at: F.when(at.isNotNull(), F.array_join(F.slice(p, low(at), at + window - low(at) + 1), " "))
    return once(F.split(F.regexp_replace(sentence, r"^\s+|\s+$", ""), r"\s+"), lambda p: once(first(p), lambda at: cut(p, at)))


def shortened(sentence: Column, targets: Column, window: int = 5) -> Column:
    """trim_around() as an array, empty where nothing is found or cut: exploded, it is worked out once, which a test of a column isn't."""
    return F.filter(F.array(trim_around(sentence, targets, window)), lambda t: t.isNotNull() & (t != sentence))


SPANS = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.arrow_udf(SPANS)
def token_spans(text: pa.Array) -> pa.Array:
    """All tokens of the lower-cased text with their character positions, which no built-in function gives. Some texts at a time become columns: no
    object a token is kept."""
    import regex

    of, parts, step = regex.compile(TOKEN), [], 128
    for i in range(0, max(len(text), 1), step):
        found, start, end, at = [], array("i"), array("i"), array("i", [0])
        for t in text[i : i + step].to_pylist():
            for m in of.finditer((t or "").lower()):
                found.append(m[0]), start.append(m.start()), end.append(m.end())
            at.append(len(found))
        spans = pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(np.array(start)), pa.array(np.array(end))], ["token", "start", "end"])
        parts.append(pa.ListArray.from_arrays(pa.array(np.array(at)), spans))
    return pa.concat_arrays(parts)


#: Where a run of token characters ends, and where one begins.
_TAIL, _HEAD = TOKEN.replace("+", "*") + r"\z", "^" + TOKEN.replace("+", "*")


def focal_tokens(sentence: Column, focal: Column, prefix: str = "passage: ") -> Column:
    """The tokens that overlap the first place of the focal word, as any substring, in the prefixed lower-cased sentence; none if it stands nowhere."""
    text = F.lower(F.concat(F.lit(prefix), sentence))
    at = F.instr(text, focal)
    before = F.when(focal.rlike("^" + TOKEN), F.regexp_extract(F.substr(text, F.lit(1), at - 1), _TAIL, 0)).otherwise("")
    after = F.when(focal.rlike(TOKEN + r"\z"), F.regexp_extract(F.substr(text, at + F.length(focal)), _HEAD, 0)).otherwise("")
    return F.when(at > 0, F.regexp_extract_all(F.concat(before, focal, after), F.lit(TOKEN), F.lit(0)))


def focal_span(sentence: Column, focal: Column, prefix: str = "passage: ") -> Column:
    """Where the focal word first stands, as any substring, in the prefixed lower-cased sentence; null if nowhere."""
    at = F.instr(F.lower(F.concat(F.lit(prefix), sentence)), focal)
    return F.when(at > 0, F.struct((at - 1).cast("long").alias("start"), (at - 1 + F.length(focal)).cast("long").alias("end")))


def label_of(en: Column, es: Column, most: int = 24) -> Column:
    """The first English and the first Spanish word, cut to most characters each."""
    return F.concat_ws(" / ", F.substring(F.get(en, F.lit(0)), 1, most), F.substring(F.get(es, F.lit(0)), 1, most))


def highlighted(sentence: Column, word: Column) -> Column:
    """The sentence with the word, wherever it stands as a whole one in any case, between asterisks."""
    return F.regexp_replace(sentence, F.concat(F.lit(r"(?i)(?<!\p{L})("), word, F.lit(r")(?!\p{L})")), F.lit("*$1*"))


#: Fixed value of RFC 4122: the name space of DNS names.
NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def name_uuid(name: Column, namespace: str = NAMESPACE) -> Column:
    """The version 5 UUID of a name: its SHA-1 after the name space, with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.lower(F.conv((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8).cast("string"), 10, 16))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
