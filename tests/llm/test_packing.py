import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyspark.llm import packing
from tallyspark.llm.common import text_buffers
from tallyspark.llm.packing import _encoder, best_fit_decreasing, pack_documents


def plain_best_fit(lengths, window):
    """Scan all windows for the tightest one."""
    rooms, out = [], [None] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fit = [r for r in rooms if r >= lengths[k]]
        if fit:
            i = rooms.index(min(fit))
            rooms[i] -= lengths[k]
        else:
            rooms.append(window - lengths[k])
        out[k] = None
    return len(rooms), sorted(rooms)


def test_segment_tree_is_best_fit():
    rng = np.random.default_rng(1)
    for window in (7, 64, 100):
        lengths = rng.integers(1, window, 300)
        where, at = best_fit_decreasing(lengths, window)
        rooms = [window - int(lengths[where == w].sum()) for w in range(where.max() + 1)]
        assert (len(rooms), sorted(rooms)) == plain_best_fit(lengths.tolist(), window)
        for w in range(where.max() + 1):
            o = sorted(zip(at[where == w], lengths[where == w], strict=True))
            assert [x for x, _ in o] == list(np.cumsum([0, *[n for _, n in o]])[:-1])


def test_encoder_is_the_tokenizer():
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encode = _encoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(0)
    alphabet = list("abcdeABCÀÉéßñøÿ÷×þÞ .,.,'st!3ªµºſKİς\u0301\u00a0\u2003\x1c\n<|>中😀")
    texts = ["".join(rng.choice(alphabet, int(rng.integers(0, 40)))) for _ in range(3000)]
    texts += ["e\u0301 E\u0301.", "we'll don't it's. 's, 'S", "a.b a..b, ..a", "<|endoftext|>x <|startoftext|>", "ÀÉÎ, Straße. ÿ"]
    data, off = text_buffers(pa.array(texts))
    got, at = encode(data, off)
    for k, t in enumerate(texts):
        ids = got[4 * at[k]:4 * at[k + 1]]
        assert ids == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_special_tokens_and_other_files():
    """Special strings are what the library's plain call makes of them; a file that splits otherwise takes the whole tokenizer."""
    encode = _encoder(public_tokenizers.path("word_bpe_49k.json"))
    data, off = text_buffers(pa.array(["a <|endoftext|> b", "x<|startoftext|>y <|ENDOFTEXT|>"]))
    ids, at = encode(data, off)
    assert np.frombuffer(ids, "<u4")[:at[1]].tolist() == [320, 49407, 321]
    texts = ["Hello World  two", "", " it's 42\n\nÉté <|endoftext|> end", "x" * 300]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        tok, encode = Tokenizer.from_file(public_tokenizers.path(name)), _encoder(public_tokenizers.path(name))
        data, off = text_buffers(pa.array(texts))
        ids, at = encode(data, off)
        assert [np.frombuffer(ids, "<u4")[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_pack_documents(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [(1, "Hello  world's Été é <|endoftext|> 42"), (2, None), (3, ""), (4, "the of " * 3000), (5, "x" * 5000),
             (6, "a b c"), (6, "a b c"), (None, "no id here\x1cx"), (7, "​ΣΑΣ İstanbul ﬁ")]
    df = spark.createDataFrame([(a, b, "clash") for a, b in texts], "doc_id long, text string, TEXT_ string").withColumn("start", F.lit("x"))
    got = pack_documents(df, window=512, shard_pieces=3, keep_ids=True).collect()
    want = sorted([(d, np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for d, t in texts], key=repr)
    by: dict = {}
    for r in sorted(got, key=lambda r: r.start):
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert sum(r.length for r in got) == sum(len(i) // 4 for _, i in want)
    for d, ids in want:
        parts = by[(d, len(ids) // 4)]
        copies = sum(w == (d, ids) for w in want)
        starts = sorted(r.start for r in parts)
        assert starts == sorted(list(range(0, len(ids) // 4, 512)) * copies)
        assert all(r.ids == ids[4 * r.start:4 * (r.start + r.length)] for r in parts)
    seqs: dict = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length, r.padding))
    for s in seqs.values():
        s.sort()
        total = sum(n for _, n, _ in s)
        assert [o for o, _, _ in s] == list(np.cumsum([0, *[n for _, n, _ in s]])[:-1]) and total <= 512
        assert {p for *_, p in s} == {0 if total & (total - 1) == 0 else 512 - total}


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_chunks_are_held_packed(monkeypatch):
    """Chunks and their ids take few bytes; forgetting them, or chunks of one hash, changes nothing."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, rng = Tokenizer.from_file(path), np.random.default_rng(6)
    parts = ["the", "tion", "er", "Ou", "é", "st", ".", ",", "4", "中"]
    texts = [" ".join("".join(parts[i] for i in rng.integers(0, len(parts), 8)) for _ in range(4000)) for _ in range(50)]
    data, off = text_buffers(pa.array(texts))
    encode = _encoder(path)
    encode(data[:off[1]], off[:2])
    tracemalloc.start()
    arrow = pa.total_allocated_bytes()
    for k in range(len(texts)):
        encode(data[off[k]:off[k + 1]], off[k:k + 2] - off[k])
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert held < 100 * 200_000  # some 200 bytes each as Python objects

    want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts[:6]]

    def same(encode):
        for _ in range(2):
            for k, w in enumerate(want):
                assert encode(data[off[k]:off[k + 1]], off[k:k + 2] - off[k])[0] == w
            ids, at = encode(data[:off[6]], off[:7])
            assert [ids[4 * i:4 * j] for i, j in zip(at, at[1:], strict=False)] == want

    same(encode)
    for name, value in (("CACHE", 5000), ("CACHE_BYTES", 100_000), ("hash_words", lambda _, starts, ends: (ends - starts).astype(np.uint64))):
        with monkeypatch.context() as m:
            m.setattr(packing, name, value)
            same(_encoder(path))
