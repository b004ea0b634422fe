import hashlib
import time
import tracemalloc
from types import SimpleNamespace

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken

from tallyspark.llm import bpe
from tallyspark.llm.bpe import decode, encode, merge_long, read_ranks
from tallyspark.llm.common import table
from tallyspark.llm.queries import op9_byte_bpe

SF001 = "/root/testdata/sf0.001"


def reference():
    ranks = read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_and_decode(spark):
    enc, rng = reference(), np.random.default_rng(0)
    words = ["the", "ababab", "don't", " we'll", "été", "Straße", " ", "　", " \n\n", "\t", "123456", "!!!", "====", "中文字", "😀😀", "́", "İ", "\x00", "\x85", "aaaaaaaaaaaaaaa", "<|endoftext|>"]
    texts = ["".join(rng.choice(words, int(rng.integers(0, 30)))) for _ in range(120)]
    texts += ["".join(chr(int(c)) for c in rng.integers(32, 0x250, 40)) for _ in range(80)]
    texts += ["", None, " ", "x" * 700, "=" * 300 + "\n" * 50, "ab" * 200, "a  b   c "]
    df = spark.createDataFrame([(i % 150, t, "z", 1) for i, t in enumerate(texts)] + [(None, "null id", "z", 1)], "doc_id long, text string, words string, IDS int").repartition(3)
    got = decode(encode(df)).collect()
    assert len(got) == len(texts) + 1
    want = sorted((tuple(enc.encode_ordinary(t or "")), (t or "").encode()) for t in [*texts, "null id"])
    assert sorted((tuple(r.ids), bytes(r.decoded)) for r in got) == want
    assert encode(df.limit(0)).collect() == []


def test_query(spark):
    enc = reference()
    got = {r.doc_id: tuple(r)[1:] for r in op9_byte_bpe(spark, SF001).collect()}
    for r in table(spark, SF001, "documents").collect():
        ids = enc.encode_ordinary(r.text)
        assert got.pop(r.doc_id) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
    assert not got


def test_unknown_ids(spark):
    df = spark.createDataFrame([(1, [0, 99999]), (2, None), (3, [])], "i int, ids array<int>")
    assert [None if r.decoded is None else bytes(r.decoded) for r in decode(df).orderBy("i").collect()] == [None, None, b""]


def test_long_matches(spark):
    """Unbroken runs take time in proportion to their length (times its logarithm), with the library's ids."""
    enc, ranks, rng = reference(), read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), np.random.default_rng(8)
    for n in (2, 3, 50, 257, 900):
        t = "".join(rng.choice(list("abcdeéßth"), n))
        assert merge_long(t.encode(), ranks) == enc.encode_ordinary(t)
    texts = ["".join(rng.choice(list("etaoinshrdlu"), n)) for n in (255, 256, 257, 5000, 1_000_000)] + ["x" * 100_000, "=" * 50_000]
    begin = time.monotonic()
    got = decode(encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2))).collect()
    assert time.monotonic() - begin < 90
    for r in got:
        assert list(r.ids) == enc.encode_ordinary(texts[r.doc_id]) and bytes(r.decoded).decode() == texts[r.doc_id]


def test_tasks_hold_no_word_as_an_object():
    """Frequent words and the ids of all words are held packed; forgetting rare words, or words of one hash, changes nothing."""
    words = [f"w{i} é" for i in range(60_000)]
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = read_ranks(path)
    shared = SimpleNamespace(value=pa.table({"word": pa.array(words, pa.string()), "ids": pa.array([[i, i + 1] for i in range(len(words))], pa.list_(pa.int32()))}))
    docs = [[words[5], "rare one", "x" * 300, words[59_999]], [], ["rare one", "other"], ["other", "", words[0]]]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(docs)), pa.int64()), pa.array(docs, pa.list_(pa.string()))], names=["doc_id", "words"])

    def held(task):
        """Bytes that Python objects take while the task is between two batches."""
        tracemalloc.start()
        run = task(iter([b] * 3))
        next(run)
        size = tracemalloc.get_traced_memory()[0]
        tracemalloc.stop()
        return size

    number, folded = bpe._number(path, shared), []
    base = held(lambda x: (m for m in [(bpe._byte_tokens(path), read_ranks(path))] for _ in x))
    assert held(number) - base < 1 << 20 < len(words) * 50
    for m in number(iter([b, b])):
        lists = [[int(x) - bpe.TOKEN for x in t[1:]] if t[:1] == [-1] else [-int(x) for x in t] for t in m.column(4)[0].as_py()]
        folded.append(pa.RecordBatch.from_arrays([*m.columns[:4], pa.array([lists], pa.list_(pa.list_(pa.int32())))], names=["docs", "sizes", "words", "anew", "codes"]))
    assert [m.column(4)[0].as_py() for m in folded[1:]] == [[]]  # the second time no word is new
    assert held(lambda _: bpe._assemble(shared)(iter(folded))) < 4 << 20
    token = bpe._byte_tokens(path)
    ids = {w: [i, i + 1] for i, w in enumerate(words)} | {"x" * 300: merge_long(b"x" * 300, ranks)}
    for w in ("rare one", "other", ""):
        ids[w] = [-int(token[c]) for c in w.encode()]
    got = [r for o in bpe._assemble(shared)(iter(folded)) for r in o.to_pylist()]
    assert got == 2 * [{"doc_id": i, "ids": [x for w in d for x in ids[w]]} for i, d in enumerate(docs)]
    find = bpe._places(pa.array(["a", "b", "ab", ""]))
    assert find(pa.array(["b", "c", "", "abc", "a"])).tolist() == [1, -1, 3, -1, 0]


def test_words_are_merged_together():
    """Distinct words take a few microseconds each, not a Spark expression's step for each byte, with the library's ids."""
    path, rng = P.path("byte_bpe_multi_50k.tiktoken"), np.random.default_rng(4)
    ranks, pairs = read_ranks(path), bpe.rank_table(path)
    parts = ["the", "tion", "er", "ou", "Th", " a", "é", "ß", "中", "aa", "=", "\n", "x", "12"]
    words = ["".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(1, 9))) for _ in range(200_000)]
    words += ["", "a", "", "ab" * 128, "ab" * 129, "x" * 256, "y" * 3000, ""]
    tokens = bpe._tokens(pa.array(words), bpe._byte_tokens(path), ranks)
    begin = time.process_time()
    got = bpe.fold_merges(tokens, pairs)
    assert time.process_time() - begin < 4
    enc = tiktoken.Encoding("whole", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    assert got.to_pylist() == enc.encode_ordinary_batch(words)
    assert bpe.fold_merges(tokens.slice(0, 0), pairs).to_pylist() == []
