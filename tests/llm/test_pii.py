"""Personal data: base spans against the plain patterns, what is added, and the parts of the method."""

import hashlib
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import pii as P

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(n):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(n))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            n = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(n) <= 19 and luhn(n), "phone": 9 <= len(n) <= 15}[kind]:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(3)
    bits = ["a", "b.c", "@", ".", "-", "+", "%", " ", "é", "(", ")", "1", "23", "255", "256", "0004", "4111111111111111", "x@y.z", "@mail.example.com", "+1 (407) 555-7710", "\n", "9-9", "日"]
    for _ in range(6000):
        text = "".join(rng.choices(bits, k=rng.randrange(1, 25)))
        good, _ = P.matches(text)
        assert P.written(good) == ",".join(brute(text)), text


def test_long_runs_take_linear_time():
    begin = time.monotonic()
    for text in ("a" * 2_000_000, "a@" * 500_000, "1" * 2_000_000, "1." * 500_000, "+" * 500_000, "+1" + " " * 1_000_000, "1-" * 500_000, "a.b@c." * 200_000, "(at) " * 200_000, "12 " * 300_000):
        good, bad = P.matches(text)
        P.candidates(text, good, bad)
    assert time.monotonic() - begin < 60


def test_em_finds_reliabilities():
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.3
    right, speaks, votes = [0.95, 0.8, 0.7, 0.9], [1.0, 0.6, 0.8, 0.5], []
    for r, s in zip(right, speaks, strict=True):
        v = np.where(rng.random(len(truth)) < r, truth, ~truth)
        votes.append(np.where(rng.random(len(truth)) < s, np.where(v, "+", "-"), "0"))
    rows, n = np.unique(["".join(x) for x in zip(*votes, strict=True)], return_counts=True)
    post, prior, told = P.estimate([(0, str(v), int(c)) for v, c in zip(rows, n, strict=True)])
    assert abs(prior[0] - 0.3) < 0.03
    for j, (r, s) in enumerate(zip(right, speaks, strict=True)):
        assert abs(told[0, j, 1, "+"] - r * s) < 0.05 and abs(told[0, j, 0, "-"] - r * s) < 0.05
    assert post[0, "++++"] > 0.95 and post[0, "----"] < 0.05


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_added_spans_and_odd_rows(spark):
    good, other = "4111111111111111", "5500005555555559"
    texts = {1: f"pay by card {good} {other} today", 2: "reach +1 (826) 555-4081 190.137.223.204 now", 3: "call (407) 555-7710, or write jane.doe [at] example [dot] org",
             4: None, 5: "", 6: f"order 1234567812345678 and build 300.1.2.3 {good[:-1]}2", 7: "a@b.co " * 3, 8: "plain words, 12 of them, and page 3.", 9: f"mail bob@mail.example.com, tel +1 (301) 555-0346, ip 10.2.3.4, card {good}"}
    more = [(100 + i, f"the.{i}@mail{i % 9}.example.com of +1 (4{i:02d}) 555-{1000 + i} in 10.{i}.3.{i} and {x}") for i, x in enumerate([good, other, "4000123412341234"] * 20)]
    df = spark.createDataFrame([*texts.items(), *more, (9, texts[9]), (None, "z@z.zz")], "doc_id long, text string").repartition(3)
    df = df.select("*", F.lit("q@q.qq").alias("TEXT"), F.lit(1).alias("Doc_Id"))
    got = P.personal_data(df)
    assert got.count() == len(texts) + len(more) + 2
    by = rows(got)
    for d, t in [*texts.items(), *more]:
        r, base = by[d], brute(t)
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r.spans.split(",") if r.spans else [])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in base) for k in PLAIN]
        assert r.n_added == len(r.spans.split(",") if r.spans else []) - len(base)
    assert by[1].spans == "card:12:28,card:29:45" and by[1].n_card == 0
    assert by[2].spans == "phone:6:23,ip:24:39" and by[2].n_phone == 0
    for d in (4, 5, 8):
        assert by[d].spans == "" and by[d].n_added == 0
    assert by[6].n_added == 0  # numbers that fail their checks, with words against them
    assert P.personal_data(df.where("false")).count() == 0
    only = spark.createDataFrame([(8, texts[8])], "doc_id long, text string")
    assert [r.spans for r in P.personal_data(only).collect()] == [""]


def test_query(spark):
    from tallyspark.llm.common import table
    from tallyspark.llm.queries import op12_personal_data

    sf = "/root/testdata/sf0.01"
    text = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = rows(op12_personal_data(spark, sf))
    assert set(got) == set(text)
    for d, t in text.items():
        base = brute(t)
        assert got[d].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        extra = [s.split(":") for s in got[d].spans.split(",") if s and s not in base]
        for kind, start, end in extra:  # every added span passes its own kind's check
            assert P.rule(P.KINDS.index(kind), t[int(start):int(end)])
