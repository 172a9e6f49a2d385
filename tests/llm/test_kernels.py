"""Kernels without a session, against plain versions."""

import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from tessella.llm import bpe, decontaminate, elias_fano, quality, secrets, simhash, warc
from tessella.llm.ann import KdTree, chi_square_quantile
from tessella.llm.components import linked_in
from tessella.llm.elias_fano import EliasFano
from tessella.llm.words import SEGMENT, Words, run_hashes, slices

ODD = ["", " ", "a", "A'S it's", "don’t Ünïcode ﬁ é <|endoftext|> x", "<|startoftext|>", "\x1c\x85a  b", "12345 abc_def--!!", "İstanbul", "日本語 text", "a ", "a\n\n b  c\t\td", "x" * 3000, "ab cd. " * 900, "¼ ½ x²", "é é"]


def test_counts_and_ids_are_the_librarys():
    path = public_tokenizers.path("word_bpe_49k.json")
    c = bpe.TokenCounter(path, bpe.whole_tokens(path))
    assert c.counts(ODD) == [len(x) for x in bpe._encode(bpe._library(path), ODD)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    e, lib = bpe.Encoder(path), bpe._library(path)
    for _ in range(2):  # from the cache too
        ids = [np.frombuffer(e.encode(t), "<u4").tolist() for t in ODD]
        assert ids == bpe._encode(lib, ODD)
        assert [e.decode(e.encode(t)).decode() for t in ODD] == [lib.decode(i, skip_special_tokens=False) for i in ids]


def test_joins_of_chunks_are_mended():
    path = public_tokenizers.path("byte_bpe_50k.json")
    e, lib, rng = bpe.Encoder(path), bpe._library(path), random.Random(2)
    parts = ["a", "B", " ", "  ", "\n", "'s", "'", "é", "日", "—", "1", "²", "!", "\u2003", "\xa0", "😀", "́", "'ll", "<|", "<|endoftext|>", "the", " of"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3000))) for _ in range(150)] + [" " * 5000 + "a", "'" * 3000 + "s", "日本語" * 3000, "“quote” — dash… " * 400]
    for t in texts:
        raw = t.encode()
        bounds = bpe.chunk_bounds(np.frombuffer(raw, np.uint8))
        table, known = bpe.Shared("", 1), []
        for s, x in zip(bounds.tolist(), bounds[1:].tolist()):  # as the table holds them
            record = bpe._record(*e.chunk(raw[s:x].decode()))
            table.files = {"off-0": np.array([0, len(record)]), "records-0": np.frombuffer(record, np.uint8)}
            known.append(table.known(0, 0) if rng.random() < 0.8 else None)
        assert np.frombuffer(e.encode(t, bounds, known), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t[:80]


def test_chunks_are_the_same_wherever_they_stand():
    rng = random.Random(1)
    text = " ".join(rng.choice(["alpha", "beta,", "gämma", "delta."]) for _ in range(3000)).encode()

    def pieces(t):
        b = bpe.chunk_bounds(np.frombuffer(t, np.uint8)).tolist()
        assert b[0] == 0 and b[-1] == len(t) and [t[x:y].decode() for x, y in zip(b, b[1:])]
        return {t[x:y] for x, y in zip(b, b[1:])}

    assert len(pieces(text) - pieces(b"another start " + text)) <= 2
    assert bpe.chunk_bounds(np.empty(0, np.uint8)).tolist() == [0]
    far = np.frombuffer(text * 8, np.uint8)  # more than is hashed in one go
    assert len(far) > 1 << 16 and {bytes(far[x:y]) for x, y in zip(bpe.chunk_bounds(far)[3:].tolist(), bpe.chunk_bounds(far)[4:-1].tolist())} <= pieces(text + text)


@pytest.mark.parametrize("n,universe", [(0, 1), (1, 5), (1000, 1000), (5000, 10**12)])
def test_elias_fano(tmp_path, n, universe):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, universe, n).astype(np.uint64))
    EliasFano.build(v, universe).store(str(tmp_path), "x")
    e = EliasFano.open(str(tmp_path), "x")
    assert (e.get(np.arange(n)) == v).all()
    q = np.concatenate([v, rng.integers(0, universe, 500).astype(np.uint64)])
    assert (e.successor(q) == np.searchsorted(v, q)).all()
    assert ((e.find(q) >= 0) == np.isin(q, v)).all()


def test_arrays_of_a_store(tmp_path, monkeypatch):
    monkeypatch.setattr(elias_fano.tempfile, "gettempdir", lambda: str(tmp_path / "own"))
    store = f"file://{tmp_path}/store"
    (tmp_path / "store").mkdir()
    values = np.arange(0, 3000, 3, dtype=np.uint64)
    EliasFano.build(values, 3000).store(store, "x")
    assert elias_fano.exists(store, "x.head") and not elias_fano.exists(store, "y") and elias_fano.exists(f"{tmp_path}/store", "x.head")
    assert (EliasFano.open(store, "x").successor(values) == np.arange(1000)).all() and (EliasFano.open(store, "x").get(np.arange(1000)) == values).all()
    assert list((tmp_path / "own").iterdir())


def test_fingerprint_by_counting():
    import xxhash

    for text in ["", "One two", "a b c d e", "a b c d a b c d", "É É x y z q"]:
        w = text.encode().lower().split()
        s = [b" ".join(w[i : i + 4]) for i in range(max(len(w) - 3, 1))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_linked_in_is_single_linkage():
    x = np.array([0, 1, 2, 10, 11, 30])
    got = linked_in(np.arange(6), lambda i, rest: np.abs(x[rest] - x[i]) <= 1)
    assert sorted(tuple(sorted(map(int, p))) for p in got) == [(0, 1), (1, 2), (3, 4)]


def test_smith_waterman_by_the_matrix():
    rng = random.Random(3)
    for _ in range(60):
        a, b = ([rng.randint(1, 4) for _ in range(rng.randint(1, 9))] for _ in range(2))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        score, first, last = decontaminate.smith_waterman(a, b)
        assert score == h.max()
        alone = decontaminate.smith_waterman(a, b[first:last])
        assert alone == (score, 0, last - first)


def test_markov_ratio_parts_random_from_ordinary():
    table = secrets.fit(secrets.samples(1500))
    held = secrets.samples(2000)[3000:]
    right = [(secrets.ratio(s, table) > secrets.MARGIN) == bool(y) for s, y in held]
    assert sum(right) / len(right) > 0.93
    assert secrets.ratio("internationalization_of_the_configuration", table) < 0


def test_kd_tree_holds_every_row_once_and_bounds_hold():
    x = np.random.default_rng(0).standard_normal((1000, 8))
    t = KdTree(x)
    assert sorted(np.concatenate(t.leaves).tolist()) == list(range(1000))
    q = x[0] + 1
    for rows, low in zip(t.leaves, t.bounds(q)):
        assert ((x[rows] - q) ** 2).sum(1).min() >= low - 1e-9
    assert abs(chi_square_quantile(0.95, 8) - 15.507) < 1e-2


def test_warc_round_trip_and_links():
    head, block = warc.page_response("7", "http://x/é", "<html lang=en><title>T &amp; t</title><style>p{}</style><p>One<b> two</b><p>three<a href='/q'>l</a>")
    (h, b), = warc.read_records(warc.write_record(head, block))
    assert b == block and h == head
    meta, conv = warc.derive(h, b)
    assert conv[1].decode() == "T & t\nOne two\nthreel" and conv[0]["WARC-Refers-To"] == meta[0]["WARC-Refers-To"] == head["WARC-Record-ID"]
    assert b"outlink: /q" in meta[1] and conv[0]["WARC-Source-Payload-Digest"] == head["WARC-Payload-Digest"]
    assert conv[0]["WARC-Block-Digest"] == warc.digest(conv[1])
    assert warc.derive({**h, "WARC-Type": "request"}, b) == []


def test_warc_as_found():
    import gzip
    import time
    import zlib

    body = "<p>héllo <a title='x>y' href=/q>hi</a>".encode()
    packed = gzip.compress(body)
    chunks = b"".join(b"%x;n=v\r\n%s\r\n" % (len(packed[i : i + 7]), packed[i : i + 7]) for i in range(0, len(packed), 7)) + b"0\r\n\r\n"
    raw = zlib.compressobj(wbits=-15)
    ways = [
        (b"content-encoding: gzip\r\ntransfer-ENCODING: chunked", chunks), (b"Content-Encoding: deflate", zlib.compress(body)), (b"Content-Encoding: deflate", raw.compress(body) + raw.flush()),
        (b"Content-Type: text/html; charset=\"latin-1\"", body.decode().encode("latin-1")), (b"Content-Type: text/html", b"<meta charset=latin-1>" + body.decode().encode("latin-1")), (b"X: y", body),
    ]
    for head, sent in ways:
        block = b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + sent
        record = warc.write_record({"warc-TYPE": "response", "WARC-Record-Id": "<urn:x>", "warc-target-uri": "http://x"}, block)
        for data in (record * 2, gzip.compress(record) * 2, gzip.compress(record * 2)):
            (h, b), (h2, b2) = warc.read_records(data)
            assert h == h2 and b == b2 == block and h["WARC-Type"] == "response"
        meta, conv = warc.derive(h, b)
        assert conv[1].decode() == "héllo hi" and b"outlink: /q" in meta[1] and conv[0]["WARC-Refers-To"] == "<urn:x>" and conv[0]["WARC-Source-Payload-Digest"] == warc.digest(sent)
    (meta, conv) = warc.derive(h, b"HTTP/1.1 200 OK\r\nContent-Encoding: br\r\n\r\nxyz")
    assert conv[1] == b"" and b"encoding-not-undone: br" in meta[1]
    (meta, conv) = warc.derive(h, b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\nxyz")
    assert conv[1] == b"" and b"encoding-not-undone: gzip" in meta[1]
    for cut in (record[:-40], gzip.compress(record)[:-10], b"WARC/1.1\r\nWARC-Type: x\r\n\r\n", b"HTTP/1.1"):
        with pytest.raises(ValueError):
            list(warc.read_records(cut))
    began = time.process_time()
    for text in ("<!--", "<title>", "<a ", '<a b=">" ', "<script>", "<![CDATA[", "<a href='", "<", "<a href = "):
        page = text * (400_000 // len(text))
        warc.plain_text(page), warc.page_facts(page)
    assert time.process_time() - began < 20


def test_weights_and_cut():
    assert quality.cut([1, 2, 3, 4], [0, 0, 1, 1]) == 2.5
    assert quality.cut([], []) == -np.inf and quality.cut([1, 2], [1, 1]) == -np.inf
    texts = pa.array(["", None, "a b", "a", "b a"])
    one, two, first = quality.features(texts)
    assert first.tolist() == [0, 0, 0, 2, 3, 5] and one[0] == one[2] == one[4] and two[0] == two[2] != two[1] and two.min() >= quality.BUCKETS > one.max()
    ratios = np.arange(2.0 * quality.BUCKETS)[None]
    assert quality.text_weights(texts, ratios)[0].tolist() == [0, 0, one[0] + one[1] + two[0] + two[1], one[2] + two[2], one[3] + one[4] + two[3] + two[4]]


def test_words_of_columns():
    texts = ["", None, "Ab  cd\nEF", " x", "é É x\x0by", "z ", "end", None, "z", "b" * (SEGMENT + 9) + " yy " + "b" * (SEGMENT + 9), "yy"]
    w = Words(pa.array(["before", *texts, "after"]).slice(1, len(texts)))
    words = [[w.raw[s:e].tobytes() for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.first, w.first[1:])]
    assert words == [(t or "").encode().lower().split() for t in texts]
    flat = [x for t in words for x in t]
    assert len(set(zip(flat, w.hashes.tolist()))) == len(set(flat)) == len(set(w.hashes.tolist()))
    assert (w.hashes == Words(pa.array([t or "" for t in texts])).hashes).all()
    folded = Words(pa.array(["It's ÉTÉ,x", "a-b"]), punctuation=True, fold=True)
    assert [folded.raw[s:e].tobytes().decode() for s, e in zip(folded.start, folded.end)] == ["it", "s", "été", "x", "a", "b"] and folded.first.tolist() == [0, 4, 6]
    assert w.characters()[w.off].tolist() == np.concatenate([[0], np.cumsum([len(t or "") for t in texts])]).tolist()
    h = np.arange(40, dtype=np.uint64) % np.uint64(7)
    r = run_hashes(h, np.array([0, 7, 14, 3]), np.array([5, 5, 5, 5]))
    assert r[0] == r[1] == r[2] != r[3]
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["x", None, "y"])], ["doc_id", "text"])
    assert [b.column(0).to_pylist() for b in slices([rows])] == [[1, 2, 3]] and list(slices([rows.slice(0, 0)])) == []


def test_base_patterns_compile_alike():
    assert re.compile(secrets.HEX) and re.compile(secrets.ACCESS)
