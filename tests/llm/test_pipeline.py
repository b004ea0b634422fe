"""Each stage against a brute-force version of its decision, on the stage's own input."""

import re

import corpus_pipeline as P
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tallyspark.llm.common import table
from tallyspark.llm.cotraining import quality_scores
from tallyspark.llm.toxicity import toxicity_scores
from test_ngram_join import brute as all_pairs
from test_suffix_dedup import brute as all_runs

SF001 = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    assert [n for n, _ in P.STAGES] == ["toxicity", "quality", "near_copies", "repeated_passages", "packing"] and P.ORACLE_SQL is None
    docs, frames = table(spark, SF001, "documents"), []
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF001)
        out.write.parquet(str(tmp_path / name))
        frames.append((docs, spark.read.parquet(str(tmp_path / name))))
        docs = frames[-1][1]
    for before, after in frames[:-1]:
        assert after.dtypes == before.dtypes
    rows = lambda df: sorted((r.doc_id, r.text) for r in df.collect())

    before, after = frames[0]
    toxic = {r.doc_id for r in toxicity_scores(before, table(spark, SF001, "labels")).collect() if r.predicted}
    assert rows(after) == [r for r in rows(before) if r[0] not in toxic]

    before, after = frames[1]
    kept = {r.doc_id for r in quality_scores(before, table(spark, SF001, "labels")).collect() if r.keep}
    assert rows(after) == [r for r in rows(before) if r[0] in kept]

    before, after = frames[2]
    heads = {d for d, _, c in all_pairs(rows(before)) if d == c}
    assert rows(after) == [r for r in rows(before) if r[0] in heads] and len(heads) < before.count()

    before, after = frames[3]
    cuts = {d: set(c) for d, (_, c) in all_runs(rows(before), 50).items()}
    left = {d: [w for i, w in enumerate(re.findall(r"[^\x20\x09-\x0D]+", t)) if i not in cuts.get(d, ())] for d, t in rows(before)}
    assert {r.doc_id: r.text.split() for r in after.collect()} == {d: w for d, w in left.items() if w or not cuts.get(d)}
    assert all(r.n_chars == len(r.text) for r in after.collect() if cuts.get(r.doc_id))

    before, after = frames[4]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {d: len(tok.encode(t, add_special_tokens=False).ids) + 1 for d, t in rows(before)}
    got: dict = {}
    for r in after.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == sizes
    last = [tuple(r) for r in P.run(spark, SF001).select("doc_id", "start", "ids_crc32").collect()]
    assert sorted(last) == sorted(tuple(r) for r in after.select("doc_id", "start", "ids_crc32").collect())
    assert np.array(list(sizes.values())).min() >= 1


def test_near_copies_with_odd_rows(spark):
    t = "one two three four five six seven"
    docs = spark.createDataFrame([(3, t, "a"), (2, t.upper(), "b"), (2, t.upper(), "b"), (5, "", "c"), (5, "", "c"), (6, None, "d"), (None, t, "e")], "doc_id long, text string, lang string")
    got = sorted((r.doc_id or 0, r.lang) for r in P.drop_near_copies(spark, docs, "").collect())
    assert got == [(0, "e"), (2, "b"), (5, "c"), (5, "c"), (6, "d")]
    empty = P.cut_repeated_passages(spark, P.drop_near_copies(spark, docs.limit(0), ""), "")
    assert empty.columns == docs.columns and empty.count() == 0


def test_near_copies_with_repeated_ids(spark):
    """Rows of one id with unlinked texts both stay; only texts that link are dropped."""
    a, b = "one two three four five six seven", "red green blue black white brown pink"
    docs = spark.createDataFrame([(1, a, "x"), (2, a.upper(), "y"), (2, b, "z"), (3, b, "u"), (4, "lone words stand here by themselves", "v"), (4, "other words that link with none of those", "w")],
                                 "doc_id long, text string, lang string")
    got = sorted((r.doc_id, r.lang) for r in P.drop_near_copies(spark, docs, "").collect())
    assert got == [(1, "x"), (2, "z"), (4, "v"), (4, "w")]
    assert P.drop_near_copies(spark, docs, "").columns == docs.columns


def test_stages_with_clashing_columns(spark):
    """All five stages on a frame with TEXT, DOC_ID and the like beside the real columns: same rows, all columns back."""
    docs = table(spark, SF001, "documents").limit(60).cache()
    extra = ["TEXT", "DOC_ID", "Lang", "N_CHARS"]
    more = docs.selectExpr("*", *[f"concat('x', doc_id) as {c}" for c in extra])
    for name, stage in P.STAGES:
        plain, got = stage(spark, docs, SF001), stage(spark, more, SF001)
        if name == "packing":
            assert sorted(map(tuple, got.select("doc_id", "start", "ids_crc32").collect())) == sorted(map(tuple, plain.select("doc_id", "start", "ids_crc32").collect()))
            continue
        assert got.columns == [*docs.columns, *extra]
        at = got.columns.index("text")
        assert sorted((r[0], r[at]) for r in got.collect()) == sorted((r[0], r[at]) for r in plain.collect())
        assert all(r[got.columns.index("DOC_ID")] == f"x{r[0]}" for r in got.collect())
