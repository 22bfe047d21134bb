"""Archives, URLs and conversations."""

import base64
import collections
import gzip
import hashlib
import math
import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest

from oracle import DATA
from tidelex.llm import chat, queries, url_filter, warc

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

PAGES = [(1, "http://a b", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u", "WARC/1.1\r\nfoo\r\n\r\n"), (5, "u2", "z"), (6, "u", "é" * 200_000), (None, "n", "x")]


def test_round_trip_with_revisits(spark):
    got = sorted((tuple(r) for r in warc.round_trip(spark.createDataFrame(PAGES, "page_id long, url string, html string"), max_bytes=400).collect()), key=repr)
    top = {}
    for p, _, h in PAGES:
        top[h or ""] = max(top.get(h or "", -1), p if p is not None else -1)
    want = []
    for p, _, h in PAGES:
        body = (h or "").encode()
        again = p != top[h or ""]
        want.append((p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", top[h or ""] if again else None))
    assert got == sorted(want, key=repr)
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_short_payloads_need_no_revisit(spark):
    got = warc.round_trip(spark.createDataFrame(PAGES, "page_id long, url string, html string"), min_revisit=2)
    assert {r.record_type for r in got.collect()} == {"response"}


def made(n=6, pack=False):
    rs = [warc.record(i, f"http://h/{i}", b"payload %d " % i * 20, None) + b"\r\n\r\n" for i in range(n)]
    return [gzip.compress(r) for r in rs] if pack else rs


@pytest.mark.parametrize("pack", [False, True])
@pytest.mark.parametrize("seed", range(12))
def test_salvage_recovers_what_is_whole(pack, seed):
    r = random.Random(seed)
    parts = made(pack=pack)
    hurt = sorted(r.sample(range(6), r.randint(1, 3)))
    for i in hurt:
        b = bytearray(parts[i])
        kind = r.choice(["flip", "cut", "junk"])
        if kind == "flip":
            b[len(b) - 12] ^= 0xFF
        elif kind == "cut":
            del b[len(b) // 2 :]
        else:
            b = bytearray(b"\x00junk WARC/1.0 \x1f\x8b\x08 more") + b[:0]
        parts[i] = bytes(b)
    data = b"".join(parts)
    seen, covered = [], 0
    for kind, at, x in warc.salvage(data):
        if kind == "record":
            seen.append(x["fields"]["warc-record-id"])
        else:
            covered += x[0]
            assert x[1]
    assert seen == [f"<{warc.NAME}{i}>" for i in range(6) if i not in hurt]
    assert covered == sum(len(parts[i]) for i in hurt)


def ids_and_gaps(data):
    out = list(warc.salvage(data))
    return [x["fields"]["warc-record-id"] for k, _, x in out if k == "record"], [(at, x[0]) for k, at, x in out if k == "gap"]


def test_one_stream_loses_only_its_bad_records():
    parts = [warc.record(i, f"http://h/{i}", random.Random(i).randbytes(3000).hex().encode(), None) + b"\r\n\r\n" for i in range(30)]
    name = lambda i: f"<{warc.NAME}{i}>"
    hurt = [bytes([*p[:-20], p[-20] ^ 1, *p[-19:]]) if i in (3, 4, 20) else p for i, p in enumerate(parts)]
    whole = gzip.compress(b"".join(hurt))
    for data in (whole, parts[0] + whole, whole + gzip.compress(parts[0])):
        ids, gaps = ids_and_gaps(data)
        more = [name(0)]
        want = [name(i) for i in range(30) if i not in (3, 4, 20)]
        assert ids == (more + want if data.endswith(whole) and len(data) > len(whole) else want + more * (len(data) > len(whole)))
        assert gaps == [(len(parts[0]) if data.startswith(b"WARC") else 0, len(whole))]
    good = gzip.compress(b"".join(parts))
    cut = good[: len(good) * 2 // 3]
    ids, gaps = ids_and_gaps(cut)
    assert ids == [name(i) for i in range(len(ids))] and 18 <= len(ids) < 22 and gaps == [(0, len(cut))]
    stored = gzip.compress(b"".join(parts), 0)
    ids, gaps = ids_and_gaps(stored[:-8] + b"\0" * 8)
    assert ids == [name(i) for i in range(30)] and gaps == [(0, len(stored))]
    ids, gaps = ids_and_gaps(cut + gzip.compress(parts[29]))
    assert ids[-1] == name(29) and len(ids) >= 19 and gaps == [(0, len(cut))]


def foreign(block, digest_of, kind="application/http; msgtype=response", block_digest=None):
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <{warc.NAME}1>\r\nWARC-Payload-Digest: sha1:{warc.sha1_32(digest_of)}\r\n"
    if block_digest is not None:
        head += f"WARC-Block-Digest: sha1:{hashlib.sha1(block_digest).hexdigest()}\r\n"
    return f"{head}Content-Type: {kind}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_payload_digest_of_http_is_of_the_body():
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<html>body</html>"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\n<html\r\n3;x=y\r\n>ab\r\n0\r\n\r\n"
    for block, body in ((http, b"<html>body</html>"), (chunked, b"<html>ab"), (chunked, chunked.split(b"\r\n\r\n", 1)[1])):
        assert warc.parse(foreign(block, body, block_digest=block), 0)[1]["payload"] == body
    for bad in (foreign(http, b"else"), foreign(http, b"<html>body</html>", block_digest=b"else"), foreign(http, b"<html>body</html>", "text/html")):
        with pytest.raises(warc.Bad, match="digest differs"):
            warc.parse(bad, 0)


def test_gaps_are_logged_by_the_reader(spark, tmp_path):
    parts = made()
    (tmp_path / "a.warc").write_bytes(parts[0] + b"garbage" + parts[1])
    (tmp_path / "b.warc").write_bytes(b"nothing here")
    found = warc.read(spark, f"file://{tmp_path}")
    records, gaps = warc.records(found), warc.gaps(found)
    assert records.count() == 2 and bytes(records.orderBy("offset").first().payload).startswith(b"payload 0")
    assert sorted((r.offset, r.length) for r in gaps.collect()) == sorted([(len(parts[0]), 7), (0, 12)])


def test_rules_and_hosts(spark):
    urls = {
        None: ("", "", None), "abc": ("", "", None), "http://WWW.EXAMPLE.com/en/a?b://c": ("www.example.com", "/en/a", "www.example.com/en/"), "x://example.com#/en/": ("example.com", "", None),
        "http://example.com/en": ("example.com", "/en", "com/"), "http://m.example.com/en/x": ("m.example.com", "/en/x", "example.com/en/"), "http://a.net/es/\n1": ("a.net", "/es/\n1", "net/es/"),
        "http://a.net/fr/?q": ("a.net", "/fr/", "net/fr/"), "http://xexample.com/en/": ("xexample.com", "/en/", "com/"), "://": ("", "", None), "http://notcom/": ("notcom", "/", None),
    }
    df = spark.createDataFrame([(i, u, 1.0) for i, u in enumerate(urls)], "page_id long, url string, score double")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    for i, (_, want) in enumerate(urls.items()):
        r = got[i]
        assert (r.host, r.path, r.rule) == want
        if r.rule:
            assert r.verdict == {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}[r.rule]
    assert url_filter.judge(df.limit(0)).count() == 0


def test_model_on_hosts_it_has_not_seen(spark):
    """Hosts apart from those learned from, of the table's kind, and some of others."""
    df = lambda rows: spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(rows)], "page_id long, url string, y int")
    learned = {u.split("/")[2] for u, _ in url_filter.default_labels()}
    new = [x for x in url_filter.default_labels(600, 123) if x[0].split("/")[2] not in learned]
    got = url_filter.judge(df(new), rules=()).join(df(new).select("page_id", "y"), "page_id").collect()
    assert len(new) > 400 and sum((r.verdict == "block") == bool(r.y) for r in got) / len(got) > 0.95
    other = [("https://casinoroyal-online.net/win/99", 1), ("http://cheappills24.biz/buy", 1), ("http://freepornvideos.xyz/", 1), ("https://mit.edu/courses/6", 0), ("https://en.wikipedia.org/wiki/Tide", 0), ("https://therhe.example.org/en/8423", 0)]
    assert [r.verdict == "block" for r in url_filter.judge(df(other), rules=()).orderBy("page_id").collect()] == [bool(y) for _, y in other]


def test_labels_may_be_a_table_of_one_class_or_none(spark):
    df = spark.createDataFrame([(1, "http://a/b"), (2, None)], "page_id long, url string")
    for labels, want in (([("http://a/b", 1)], "block"), ([("http://a/b", 0), (None, 0)], "allow"), (df.selectExpr("url", "1 AS y"), "block"), (df.selectExpr("url", "CAST(NULL AS int) AS y"), "allow")):
        assert {r.verdict for r in url_filter.judge(df, labels, rules=()).collect()} == {want}


def test_regression_against_brute_force(spark):
    """The weights against gradient steps on a dense matrix, and the query's verdicts against scores worked out row by row."""
    table = [("spam.com", "/x", 1), ("good.org", "/y/z", 0), ("cheap-spam.net", "", 1), ("", "/a", 0), ("good.net", "/spam", 0)]
    bits, sizes = 10, (3, 4)
    m = url_filter.train(table, bits, sizes, epochs=30, rate=0.5)
    x = np.zeros((len(table), 1 << bits))
    for i, (h, p, _) in enumerate(table):
        for row, k in url_filter.grams(pa.array([h]), pa.array([p]), bits, sizes):
            np.add.at(x[i], k, 1)
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    y, w, b = np.array([v for *_, v in table], float), np.zeros(1 << bits), 0.0
    used = x.any(0)
    for _ in range(30):
        g = (1 / (1 + np.exp(-(b + x @ w))) - y) / len(y)
        w, b = np.where(used, w - 0.5 * 20 * (x.T @ g + 1e-3 * w / len(y)), 0), b - 0.5 * g.sum()
    assert np.allclose(m["weights"], w, atol=1e-5) and m["intercept"] == pytest.approx(b)
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r.page_id: r for r in queries.op8_url_filter(spark, DATA).collect()}
    split = lambda u: re.match(r"(?s)[^/?#]*", u)[0].translate(LOWER)
    learned = [((split(u.split("://", 1)[1])), re.match(r"(?s)[^/?#]*([^?#]*)", u.split("://", 1)[1])[1], y) for u, y in url_filter.default_labels()]
    model = url_filter.train(learned)
    for r in pages.collect():
        rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
        host, path = split(rest), re.match(r"(?s)[^/?#]*([^?#]*)", rest)[1]
        fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        z = url_filter.margins(pa.array([host]), pa.array([path]), model["weights"], model["intercept"], model["bits"], model["sizes"])[0]
        rule, verdict = max(fit)[1:] if fit else (None, "block" if 1 / (1 + math.exp(-z)) >= 0.6 else "allow")
        assert (got[r.page_id].host, got[r.page_id].path, got[r.page_id].rule, got[r.page_id].verdict) == (host, path, rule, verdict)


def test_chat_round_trip(spark):
    r = random.Random(0)
    bits = ["<|im_end|>", "<|im_start|>", "assistant", "\n", "<", "|", "\\", "<\\|", "é", "x", "<|im_turn|>", "<|im_end|>\n", "", "😀"]
    rows = []
    for c in [None, *range(1, 25)]:
        for t in range(r.choice([1, 2, 5, 150])):
            turn = None if c is not None and c < 5 and r.random() < 0.3 else t
            rows.append((c, turn, r.choice(["user", "assistant", "system", None, "a|<|b\n%0A"]), r.choice([None, "".join(r.choice(bits) for _ in range(r.randint(0, 12)))]), "extra"))
    rows += rows[:3]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    by = collections.defaultdict(list)
    for c, t, role, x, _ in rows:
        by[c].append((t is not None, t or 0, role or "", x or ""))
    want = {}
    for c, ts in by.items():
        ts.sort()
        loss = "".join(x for *_, role, x in ts if role == "assistant")
        want[c] = (len(ts), hashlib.sha256("".join(f"{role}\n{x}\n" for *_, role, x in ts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for n in (4, 64):
        out = chat.digests(chat.format_chats(df, segment_turns=n)).collect()
        assert {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in out} == want
    a, b = (sorted(x.formatted for x in chat.format_chats(df, segment_turns=n).collect()) for n in (4, 64))
    assert a == b
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def test_adjacent_turns_of_a_role_are_one_block(spark):
    rows = [(1, i, role, t) for i, (role, t) in enumerate([("user", "a"), ("user", "b"), ("assistant", "c"), ("assistant", "d")])]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), segment_turns=1).first()
    assert out.formatted == "<|im_start|>user\na<|im_turn|>b<|im_end|>\n<|im_start|>assistant\nc<|im_turn|>d<|im_end|>\n"
    raw = out.formatted.encode()
    assert [raw[s["at"] : s["at"] + s["bytes"]] for s in out.loss_spans] == [b"c", b"d"]
