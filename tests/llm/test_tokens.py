"""Token files, token counts and packing, against the library itself."""

import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import packing, token_counts, token_files, tokens
from quarry.llm.common import Scratch

from .helpers import documents, odd_texts, rows_of

TOK = Tokenizer.from_file(tokens.tokenizer_path())
ENC = tokens.Encoder(tokens.tokenizer_path())


def ids_of(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30) | st.text("ab \n'st1é  ", max_size=40), max_size=6))
def test_encoder_is_the_library(texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in ENC.ids(texts)] == [ids_of(t) for t in texts]


def test_encoder_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_WORDS", 20)
    enc = tokens.Encoder(tokens.tokenizer_path())
    for t in odd_texts() * 2:
        assert np.frombuffer(enc.ids([t or ""])[0], "<u4").tolist() == ids_of(t)


def test_memo_of_another_size(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_WORDS", 2)
    asked = []
    learn = lambda words: asked.extend(words) or list(words)
    memo = tokens.Memo(100)
    for _ in range(3):
        assert memo.get([b"a", b"b", b"c", b"d"], learn) == [b"a", b"b", b"c", b"d"]
    assert asked == [b"a", b"b", b"c", b"d"] and not memo.before


def test_many_words_take_little_memory():
    """Workers that kept them as objects took more memory than an executor has."""
    import tracemalloc

    enc = tokens.Encoder(tokens.tokenizer_path())
    enc.ids(["warm up"])
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(5))
    texts = [" ".join(map(word, range(k, k + 10_000))) for k in range(0, 60_000, 10_000)]
    tracemalloc.start()
    for t in texts:
        enc.ids([t])
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 110 * 60_000


def test_words_by_their_bytes():
    """Of one to many bytes, cut short or long by a zero byte, beyond ASCII, again after two generations."""
    texts = ["a a\0 a\0\0 \0a \0", *("é" * k + "x" * j for k in range(10) for j in range(10)), "z" * 15 + " " + "z" * 14 + " " + "z" * 16 + " " + "z" * 40]
    enc = tokens.Encoder(tokens.tokenizer_path())
    enc.memo.most = 30
    for t in [*texts, *texts[::-1], " ".join(texts)] * 2:
        assert np.frombuffer(enc.ids([t])[0], "<u4").tolist() == ids_of(t)
        assert enc.counts([t, t]) == [len(ids_of(t))] * 2


def test_words_in_full_and_shared_places():
    r = np.random.default_rng(1)
    words = tokens.Words(8)
    a, b = r.integers(0, 1 << 63, 5000).astype(np.uint64), np.full(5000, 1 << 56, np.uint64)
    for k in range(0, 5000, 500):
        part = slice(k, k + 500)
        assert not words.find(a[part], b[part])[0].any()
        words.add(a[part], b[part], np.arange(2 * k, 2 * k + 1000, dtype=np.uint32), np.full(500, 2))
    known, start, number = words.find(a, b)
    assert known.all() and (number == 2).all() and (words.flat[start] == np.arange(0, 10_000, 2)).all()
    assert not words.find(a + np.uint64(1), b)[0].any() and words.count == 5000


def test_heads_look_for_no_long_matches():
    """That took a tenth of the coder's time, and made heads larger."""
    r = np.random.default_rng(4)
    blocks = [np.unique(r.integers(0, 20_000, 400)).astype(np.uint32) for _ in range(50)]
    heads = [split(x)[2] for x in token_files.encode_blocks(blocks)]
    before = [zlib.compressobj(1, zlib.DEFLATED, 11, 4) for _ in heads]
    assert sum(map(len, heads)) < sum(len(z.compress(zlib.decompress(h)) + z.flush()) for z, h in zip(before, heads))


def test_heads_are_small_and_read_by_any_window():
    block = np.arange(0, 2048 * 20, 20, dtype=np.uint32)
    n, a, head, code = split(token_files.encode_blocks([block])[0])
    assert head[0] >> 4 <= 3  # a window of 2,048 bytes, made anew for each block
    assert np.cumsum(np.frombuffer(zlib.decompress(head), "<u2")).tolist() == block.tolist()


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_other_tokenizers(name):
    path = tokens.tokenizer_path(name)
    enc = tokens.Encoder(path)
    texts = [t or "" for t in odd_texts()]
    if name.endswith("model"):
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    else:
        want = [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for t in texts]
    assert enc.counts(texts) == want


def split(raw):
    import struct

    h = struct.calcsize(token_files.HEAD)
    n, a, na, nc, _ = struct.unpack(token_files.HEAD, raw[:h])
    return n, a, raw[h : h + na], raw[h + na : h + na + nc]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**31), min_size=1, max_size=60) | st.lists(st.integers(0, 3), min_size=1, max_size=300), min_size=1, max_size=5))
def test_coder_round_trip(blocks):
    blocks = [np.array(b, np.uint32) for b in blocks]
    back = token_files.decode_blocks([split(b) for b in token_files.encode_blocks(blocks)])
    assert [b.tolist() for b in back] == [b.tolist() for b in blocks]


def test_coder_full_blocks_and_size():
    r = np.random.default_rng(3)
    blocks = [np.arange(2048, dtype=np.uint32), np.full(2048, 9, np.uint32), r.integers(0, 50257, 2048).astype(np.uint32), np.tile(np.array([5, 6, 7, 8], np.uint32), 512)]
    coded = token_files.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(token_files.decode_blocks([split(c) for c in coded]), blocks))
    assert len(coded[1]) < 200 and len(coded[3]) < 400  # what repeats is predicted


def test_damage_is_noticed(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text here")], "doc_id long, text string")
    files = Scratch(spark, "t").table(token_files.write_token_files(docs, f"file://{tmp_path}/ids"))
    path = files.where("n_docs > 0").first()["path"].removeprefix("file:/")
    raw = bytearray(open("/" + path.lstrip("/"), "rb").read())
    raw[40] ^= 1
    open("/" + path.lstrip("/"), "wb").write(raw)
    with pytest.raises(Exception, match="checksum"):
        token_files.read_documents(files.where("n_docs > 0")).collect()


def test_op1(spark, tmp_path):
    texts = odd_texts()
    ids = list(range(len(texts)))
    random.Random(2).shuffle(ids)
    sf = documents(spark, tmp_path, list(zip(ids, texts)))
    got = token_files.op1_token_files(spark, sf).orderBy("doc_id").collect()
    at = 0
    for r, (d, t) in zip(got, sorted(zip(ids, texts))):
        want = [*ids_of(t), 2]
        assert tuple(r) == (d, at, len(want), crc(want))
        at += len(want)
    assert len(got) == len(texts)


def test_op1_repeats_nulls_and_nothing(spark, tmp_path):
    sf = documents(spark, tmp_path, [(None, "b"), (3, "a"), (3, "a"), (1, None)])
    assert rows_of(token_files.op1_token_files(spark, sf), "doc_id", "start", "n_tokens") == sorted([(None, 0, 2), (1, 2, 1), (3, 3, 2), (3, 5, 2)], key=repr)
    assert token_files.op1_token_files(spark, documents(spark, tmp_path / "e", [])).count() == 0


def test_op7(spark, tmp_path):
    texts = odd_texts()
    sf = documents(spark, tmp_path, [*enumerate(texts), (0, texts[9]), (None, "a b")])
    got = rows_of(token_counts.op7_token_counts(spark, sf), "doc_id", "n_bytes", "n_tokens", "over_limit")
    one = lambda d, t: (d, len((t or "").encode()), len(ids_of(t)), len(ids_of(t)) > 512)
    assert got == sorted([*(one(d, t) for d, t in enumerate(texts)), one(0, texts[9]), one(None, "a b")], key=repr)
    assert token_counts.op7_token_counts(spark, documents(spark, tmp_path / "e", [])).count() == 0


def test_cache_encodes_only_misses(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    df = lambda *t: spark.createDataFrame([(i, x, "keep") for i, x in enumerate(t)], "doc_id long, text string, n_tokens string")
    token_counts.token_counts(df("a b", "a b", None, "c"), cache)
    assert token_counts.read_cache(spark, cache).count() == 3
    got = token_counts.token_counts(df("a b", "d e f"), cache)
    assert got.columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]
    assert rows_of(got, "text", "n_tokens") == [("a b", 2), ("d e f", 3)] and token_counts.read_cache(spark, cache).count() == 4
    # A count stored twice by runs at the same time is read once; what is stored is believed.
    spark.sql("SELECT unhex(sha2('zz', 256)) AS digest, '%s' AS tokenizer, 7L AS n_tokens FROM range(2)" % tokens.tokenizer_digest(tokens.tokenizer_path())).write.mode("append").parquet(cache)
    assert rows_of(token_counts.token_counts(df("zz"), cache), "n_tokens") == [(7,)]


def check_pieces(got, docs, length=1024):
    """docs: (doc_id, ids) with ends; ids may repeat."""
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    want = {}
    for d, i in docs:
        want.setdefault(d, []).append(i)
    assert set(by) == set(want)
    for d, copies in want.items():
        rows = sorted(by[d], key=lambda r: (r["start"], r["sequence_id"], r["offset"]))
        assert sum(r["length"] for r in rows) == sum(map(len, copies))
        if len(copies) == 1:
            at = 0
            for r in rows:
                assert r["start"] == at and r["doc_tokens"] == len(copies[0]) and r["ids_crc32"] == crc(copies[0][at : at + r["length"]])
                at += r["length"]
    fill = {}
    for r in got:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in fill.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at and n > 0
            at += n
        assert at <= length
    assert sorted(fill) == list(range(len(fill)))
    assert sum(sum(n for _, n in p) < length for p in fill.values()) <= 1


def test_op6(spark, tmp_path):
    texts = odd_texts()
    rows = [(i, t, (None, "a", "b", "b", "b")[i % 5]) for i, t in enumerate(texts)]
    got = packing.op6_packing(spark, documents(spark, tmp_path, rows)).collect()
    check_pieces(got, [(i, [*ids_of(t), 0]) for i, t in enumerate(texts)])
    assert packing.op6_packing(spark, documents(spark, tmp_path / "e", [])).count() == 0


def test_packing_repeats(spark, tmp_path):
    got = packing.op6_packing(spark, documents(spark, tmp_path, [(1, "a b c"), (1, "a b c"), (None, None), (2, "")])).collect()
    check_pieces(got, [(1, [*ids_of("a b c"), 0]), (1, [*ids_of("a b c"), 0]), (None, [0]), (2, [0])])


def test_schedule_fills_windows_in_proportion():
    r = random.Random(4)
    for sizes, weights in (([1000, 3000, 50], [1000, 3000, 50]), ([5000, 10, 700, 1], [1, 1, 5, 2]), ([7], [1]), ([r.randint(1, 9999) for _ in range(40)], [r.random() + 0.01 for _ in range(40)])):
        s = packing.Schedule(sizes, weights, 256)
        seen = np.zeros(sum(sizes), bool)
        for q, n in enumerate(sizes):
            at = 0
            while at < n:
                step = min(n - at, r.randint(1, 90))
                for f, t, pos in s.place(q, at, step):
                    assert not seen[pos : pos + t - f].any()
                    seen[pos : pos + t - f] = True
                at += step
        assert seen.all()
        w = np.array(weights) / sum(weights)
        for k in range(1, s.windows):
            served = s.quota(k) - s.quota(k - 1)
            going = s.quota(k) < s.sizes
            assert abs(served.sum() - 256) <= len(sizes)
            if going.all():
                assert (abs(served - 256 * w) <= 1.001).all()


def round_robin(sizes, weights, window):
    """Queue by queue, token by token: each window gives every queue its share and what it is owed from before, whole tokens at
    a time; a queue that has run out leaves its share to the others. Tokens served of each queue after each window."""
    from fractions import Fraction

    left, owed, served, out = list(sizes), [Fraction(0)] * len(sizes), [0] * len(sizes), []
    while any(left):
        room = Fraction(min(window, sum(left) + sum(owed)))
        while room > 0:
            live = [q for q in range(len(sizes)) if left[q] - owed[q] > 0]
            if not live:
                break
            w = sum(weights[q] for q in live)
            step = min([room, *(Fraction((left[q] - owed[q]) * w, 1) / weights[q] for q in live)])
            for q in live:
                owed[q] += step * weights[q] / w
            room -= step
        for q in range(len(sizes)):
            n = int(owed[q])
            owed[q] -= n
            left[q] -= n
            served[q] += n
        out.append(tuple(served))
        if room > 0:
            break
    return out


def test_schedule_is_deficit_round_robin():
    from fractions import Fraction

    r = random.Random(5)
    cases = [([1000, 3000, 50], [1000, 3000, 50]), ([5000, 10, 700, 3], [1, 1, 5, 2]), ([r.randint(1, 3000) for _ in range(12)], [r.randint(1, 9) for _ in range(12)])]
    for sizes, weights in cases:
        s = packing.Schedule(sizes, weights, 256)
        want = round_robin(sizes, [Fraction(w) for w in weights], 256)
        for k in range(1, s.windows):
            assert max(abs(a - b) for a, b in zip(s.quota(k).tolist(), want[k - 1])) <= 1, k


def test_more_sources_than_queues(spark):
    """Sources that share a queue are spread over it evenly, and every token is packed once."""
    docs = spark.createDataFrame([(i, "w " * 40, "big" if i % 2 else f"s{i % 20}") for i in range(400)], "doc_id long, text string, source string")
    got = packing.pack(Scratch(spark, "t"), docs, queues=1, length=64, window=1024).collect()
    check_pieces(got, [(i, [*ids_of("w " * 40), 0]) for i in range(400)], 64)
    n, last = len(ids_of("w " * 40)) + 1, max(r["sequence_id"] for r in got)
    for s in range(0, 20, 2):
        first = sum(r["length"] for r in got if r["doc_id"] % 20 == s and r["sequence_id"] <= last / 2)
        assert abs(first - 10 * n) <= 2 * n
    assert sorted({r["doc_id"] for r in got}) == list(range(400))


def test_targets_of_packing(spark):
    docs = spark.createDataFrame([(i, "w " * 300, "a" if i % 2 else "b") for i in range(60)], "doc_id long, text string, source string")
    got = packing.pack(Scratch(spark, "t"), docs, targets={"a": 3.0, "b": 1.0}, window=4096).collect()
    check_pieces(got, [(i, [*ids_of("w " * 300), 0]) for i in range(60)])
    first = [r for r in got if r["sequence_id"] < 4]
    share = sum(r["length"] for r in first if r["doc_id"] % 2) / sum(r["length"] for r in first)
    assert abs(share - 0.75) < 0.01


def test_steps_that_give_two_words():
    """Ids that cost more than 16 bits, in some lanes of a group only."""
    from quarry.llm.token_files import BLOCK, HEAD, decode_blocks, encode_blocks

    rng = np.random.default_rng(3)
    blocks = [np.where(rng.random(BLOCK) < 0.003 * (i % 3), rng.integers(0, 50_000, BLOCK), 7).astype(np.uint32) for i in range(40)]
    parts = []
    for b in encode_blocks(blocks):
        n, alphabet, head, _, _ = struct.unpack(HEAD, b[: (at := struct.calcsize(HEAD))])
        parts.append((n, alphabet, b[at : at + head], b[at + head :]))
    assert all((x == y).all() for x, y in zip(blocks, decode_blocks(parts), strict=True))
