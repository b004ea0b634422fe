"""Personal data by weak supervision: labelers vote on spans, EM weighs their votes, a classifier learns the outcome.

1. Each whole text gives base spans (four fixed patterns with their checks) and further candidates: parts of base
   matches that a check refused (two card numbers in a row, a phone number that ran into an address), phone numbers
   without a plus, e-mail addresses whose marks are spelled out.  Texts are read once; every pattern is linear in the
   length of the text.
2. Five labelers vote for (+), against (-) or not at all (0) on each candidate: the base rule on the candidate's own
   characters, a check of its numbers, gazetteers, the words around it, and the characters next to it.
3. The number of candidates with each pattern of votes, over all documents, is all that EM needs (at most 4 * 3**5
   rows).  It estimates for each kind how common personal data is and how reliable each labeler is (a Dawid-Skene model).
4. A logistic regression on votes, shape and neighbouring words learns EM's posteriors from at most FIT_ROWS
   candidates (those of least hash) and scores all.  Candidates with a score of at least 0.5 become spans; base spans
   always stay.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import Scratch, single
from tallyspark.llm.linear import Sparse, fit_logistic, sigmoid

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Candidates that the classifier learns from; its hashed features; characters around a span that are looked at.
FIT_ROWS, FEATURES, AROUND = 16_384, 4096, 48

# ------------------------------------------------------------------ base spans
# The patterns are those of the contract; those whose plain form is quadratic on long runs start only where a run starts.

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``: each holds one @ behind its first part."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


_TWICE = {c: int(c) * 2 - 9 * (c > "4") for c in "0123456789"}


def luhn(number: str) -> bool:
    return (sum(map(int, number[::-2])) + sum(map(_TWICE.__getitem__, number[-2::-2]))) % 10 == 0


def rule(kind: int, s: str) -> bool:
    """The check of a kind on a match of its pattern."""
    if kind == IP:
        return all(len(p) <= 3 or not p.strip("0") or len(p.lstrip("0")) <= 3 for p in s.split(".")) and all(int(p[-4:]) <= 255 for p in s.split("."))
    if kind == CARD:
        return 12 <= len(n := digits(s)) <= 19 and luhn(n)
    return kind == EMAIL or 9 <= len(digits(s)) <= 15


def matches(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kind, start, end) of the matches that pass their check, and of those that do not."""
    found = [(EMAIL, *s) for s in emails(text)]
    for kind, p in ((IP, _IP), (CARD, _CARD), (PHONE, _PHONE)):
        found.extend((kind, *m.span()) for m in p.finditer(text))
    good, bad = [], []
    for m in found:
        (good if rule(m[0], text[m[1]:m[2]]) else bad).append(m)
    return good, bad


# ------------------------------------------------------------------ candidates

_RUN = re.compile(r"[0-9]+(?:[\x20-][0-9]+)*")
_GROUP = re.compile(r"[0-9]+")
_FULL_PHONE = re.compile(r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])")
_LOCAL_PHONE = re.compile(r"(?<![\w+(.-])(?:\([0-9]{2,4}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{4}(?![\w-]|\.[0-9])")
_AT = re.compile(r"\x20?(?:\[\x20?at\x20?\]|\(\x20?at\x20?\)|\{\x20?at\x20?\})\x20?", re.I | re.A)
_NAME_BEFORE = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_HOST_AFTER = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?(?:\[\x20?dot\x20?\]|\(\x20?dot\x20?\)|\{\x20?dot\x20?\})\x20?)[A-Za-z0-9-]{1,63})+", re.I | re.A)


def _cards(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Parts of a refused card match: groups of digits that make 12 to 19 digits, the first fit from the left; else all."""
    groups = [m.span() for m in _GROUP.finditer(text, start, end)]
    number = digits(text[start:end])
    at = np.concatenate([[0], np.cumsum([b - a for a, b in groups])]).tolist()  # first digit of each group
    # Running sums of the digits, doubled at odd or at even places: the check of any part is a difference.
    sums = [[0], [0]]
    for i, c in enumerate(number):
        for odd in (0, 1):
            sums[odd].append(sums[odd][-1] + (int(c) if (i + odd) % 2 else _TWICE[c]))
    i, found = 0, False
    while i < len(groups):
        j = i + 1
        while j <= len(groups) and at[j] - at[i] <= 19:
            run = sums[at[j] % 2]
            if at[j] - at[i] >= 12 and (run[at[j]] - run[at[i]]) % 10 == 0 and (i, j) != (0, len(groups)):
                yield groups[i][0], groups[j - 1][1]
                found, i = True, j - 1
                break
            j += 1
        i += 1
    if not found and 12 <= at[-1] <= 19:
        yield start, end


def candidates(text: str, good: list[tuple[int, int, int]], bad: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further (kind, start, end): they overlap no base span and none of their own kind."""
    more: list[tuple[int, int, int]] = []
    for kind, start, end in bad:
        if kind == CARD:
            more.extend((CARD, *s) for s in _cards(text, start, end))
        elif kind == PHONE:
            more.extend((PHONE, *m.span()) for m in _FULL_PHONE.finditer(text, start, end))
        else:
            more.append((kind, start, end))
    more.extend((PHONE, *m.span()) for m in _LOCAL_PHONE.finditer(text))
    for m in _AT.finditer(text):
        lo = max(0, m.start() - 64)
        name, host = _NAME_BEFORE.search(text[lo:m.start()]), _HOST_AFTER.match(text, m.end())
        if name and host:
            more.append((EMAIL, lo + name.start(), host.end()))
    out, last = [], {}
    spans = sorted((s, e) for _, s, e in good)
    starts, reach = np.array([s for s, _ in spans]), np.maximum.accumulate([e for _, e in spans] or [0])
    for kind, start, end in sorted(set(more), key=lambda x: (x[1], x[0], x[2])):
        i = np.searchsorted(starts, end)
        if (i and reach[i - 1] > start) or last.get(kind, 0) > start:
            continue
        last[kind] = end
        out.append((kind, start, end))
    return out


# ------------------------------------------------------------------ labelers
# Gazetteers and context words: fixed values.

_TLDS = frozenset("com org net edu gov mil int info biz io dev app eu uk us de fr es it nl be ch at pl pt se no dk fi ie ca au nz br mx ar jp cn in ru za".split())
_CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58",
            "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
_ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[0-9]|6[0-9]")
_FOR = {EMAIL: frozenset("mail email e-mail contact write courriel correo kontakt adresse".split()), IP: frozenset("ip host server address client login adresse".split()),
        CARD: frozenset("card visa mastercard amex credit debit pay karte carte tarjeta".split()), PHONE: frozenset("phone tel call mobile fax cell telefon téléphone teléfono anruf".split())}
_AGAINST = frozenset("version release isbn issn order invoice ref reference serial build section page token hash sha md5 bestellung facture pedido".split())
_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def votes(kind: int, text: str, start: int, end: int) -> tuple[int, ...]:
    """1, -1 or 0 by the base rule, the numbers, the gazetteers, the words around and the characters next to the span."""
    s, number = text[start:end], digits(text[start:end])
    own = ((EMAIL, _DOMAIN.search(s) and "@" in s), (IP, _IP.fullmatch(s)), (CARD, _CARD.fullmatch(s)), (PHONE, _PHONE.fullmatch(s)))[kind][1]
    by_rule = 0 if not own else 1 if rule(kind, s) else -1
    if kind == EMAIL:
        tail = re.split(r"[^A-Za-z0-9-]+", s.rstrip(")]}"))[-1]
        by_number, by_name = (1 if tail.isalpha() and len(s) <= 254 else -1), int(tail.lower() in _TLDS)
    elif kind == IP:
        parts = s.split(".")
        by_number, by_name = (1 if rule(IP, s) and not any(len(p) > 1 and p[0] == "0" for p in parts) else -1), (1 if 0 < int(parts[0][-4:]) < 224 else 0)
    elif kind == CARD:
        by_number, by_name = (1 if 12 <= len(number) <= 19 and luhn(number) else -1), int(bool(_ISSUERS.match(number)))
    else:
        by_number, by_name = (1 if 9 <= len(number) <= 15 else -1), int(s[0] != "+" or number.startswith(_CALLING))
    near = {w.lower() for w in _WORDS.findall(text[max(0, start - AROUND):start])} | {w.lower() for w in _WORDS.findall(text[end:end + AROUND // 2])}
    by_words = 1 if near & _FOR[kind] else -1 if near & _AGAINST else 0
    before, after = text[start - 1:start], text[end:end + 1]
    joined = before.isalnum() or after.isalnum() or (before in "._-/" and before and text[start - 2:start - 1].isalnum()) or (after in "_-/" and after and text[end + 1:end + 2].isalnum())
    return by_rule, by_number, by_name, by_words, -1 if joined else 1


def features(kind: int, text: str, start: int, end: int, vote: tuple[int, ...]) -> list[int]:
    """Hashed features of a candidate: votes, shape, size, neighbours."""
    s = text[start:end]
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[A-Za-z]+", "a", s))[:24]
    before, after = _WORDS.findall(text[max(0, start - AROUND):start]), _WORDS.findall(text[end:end + AROUND // 2])
    named = [f"v{i}{v}" for i, v in enumerate(vote)] + [f"s{shape}", f"n{min(len(digits(s)), 20)}", f"b{text[start - 1:start]}", f"a{text[end:end + 1]}"]
    named += [f"w{before[-1].lower()}"] if before else []
    named += [f"x{after[0].lower()}"] if after else []
    return sorted({zlib.crc32(f"{kind}{n}".encode()) % FEATURES for n in named})


# ------------------------------------------------------------------ passes over the documents

SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))])
SPAN_DDL = "array<struct<kind:int,start:long,end:long,base:boolean,votes:string,features:array<int>>>"


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], x[0], x[2])))


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, len(b), 500):
            part, found = b.slice(lo, 500), []
            for i in range(len(part)):
                text = part.column(1)[i].as_py() or ""
                good, bad = matches(text)
                rows = []
                for base, spans in ((True, good), (False, candidates(text, good, bad))):
                    for kind, start, end in spans:
                        v = votes(kind, text, start, end)
                        rows.append({"kind": kind, "start": start, "end": end, "base": base, "votes": "".join("-0+"[x + 1] for x in v), "features": features(kind, text, start, end, v)})
                found.append(rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(SPAN))], names=["doc_id", "found"])


def estimate(patterns: list[tuple[int, str, int]], steps: int = 500) -> tuple[dict[tuple[int, str], float], dict[int, float], dict[tuple[int, int, int, str], float]]:
    """EM over (kind, votes, number of candidates).  Returns the posterior of each pattern, how common personal data is
    by kind, and the reliabilities: P(vote of labeler | truth) by (kind, labeler, truth, vote)."""
    first = {(0, "+"): 0.1, (0, "0"): 0.3, (0, "-"): 0.6, (1, "+"): 0.6, (1, "0"): 0.3, (1, "-"): 0.1}
    size = len(patterns[0][1]) if patterns else 0
    prior = {k: 0.5 for k, _, _ in patterns}
    told = {(k, j, y, v): p for k in prior for j in range(size) for (y, v), p in first.items()}
    post: dict = {}
    for _ in range(steps):
        now = {}
        for k, votes_, _ in patterns:
            odds = np.log(prior[k]) - np.log(1 - prior[k]) + sum(np.log(told[k, j, 1, v]) - np.log(told[k, j, 0, v]) for j, v in enumerate(votes_))
            now[k, votes_] = float(sigmoid(odds))
        # One candidate's worth of the first guess keeps every estimate inside (0, 1), and says which truth is which.
        for k in prior:
            mine = [(v, n, now[k, v]) for kk, v, n in patterns if kk == k]
            prior[k] = (1 + sum(n * p for _, n, p in mine)) / (2 + sum(n for _, n, _ in mine))
            for j in range(size):
                for y in (0, 1):
                    weight = {v: first[y, v] for v in "-0+"}
                    for v, n, p in mine:
                        weight[v[j]] += n * (p if y else 1 - p)
                    total = sum(weight.values())
                    told.update({(k, j, y, v): w / total for v, w in weight.items()})
        done = post and max(abs(now[x] - post[x]) for x in now) < 1e-9
        post = now
        if done:
            break
    return post, prior, told


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(features, target) of the sample -> weights and intercept."""
    t = pa.Table.from_batches(list(batches))
    col = t["features"].combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.int32()))
    row, f = np.repeat(np.arange(t.num_rows), col.value_lengths().to_numpy()), col.flatten().to_numpy()
    x = Sparse(np.ones(FEATURES), t.num_rows)
    order = np.argsort(f, kind="stable")
    which, n = np.unique(f, return_counts=True)
    x.add(row[order], which, n)
    w, b = fit_logistic(x, t["y"].to_numpy().astype(float), l2=0.1)
    yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([b])], names=["weight", "bias"])


RESULT_DDL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _choose(weight: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for i in range(len(b)):
                found = b.column(1)[i].as_py()
                base = [(r["kind"], r["start"], r["end"]) for r in found if r["base"]]
                # Of added spans that overlap, that of the higher score stays.
                more = sorted((-(weight[r["features"]].sum() + bias), r["start"], r["kind"], r["end"]) for r in found if not r["base"])
                added: list[tuple[int, int, int]] = []
                for z, start, kind, end in more:
                    if z <= 0 and all(end <= s or e <= start for _, s, e in added):
                        added.append((kind, start, end))
                for k in range(4):
                    out[k].append(sum(x[0] == k for x in base))
                out[4].append(hashlib.sha256(written(base).encode()).hexdigest())
                out[5].append(written(base + added))
                out[6].append(len(added))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string() if k in (4, 5) else pa.int64()) for k, c in enumerate(out))],
                                             names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return run


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 (of their list), spans
    (base and added ones: kind:start:end in code points, by start and kind, joined by commas), n_added.

    Null and empty texts have no spans.  Rows that repeat an id, or have none, are read one by one; an empty table gives
    no rows; only id and text are read.  Without any candidate there is nothing to learn and nothing is added.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    src = single(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    told = scratch.save(src.mapInArrow(_detect, f"doc_id long, found {SPAN_DDL}"), "found")
    each = told.select("doc_id", F.explode("found").alias("s")).select("doc_id", "s.*")
    patterns = [tuple(r) for r in each.groupBy("kind", "votes").count().orderBy("kind", "votes").collect()]  # at most 4 * 3**5
    weight, bias = np.zeros(FEATURES), -1.0
    if patterns:
        post, _, _ = estimate(patterns)
        target = F.create_map(*[F.lit(x) for (k, v), p in post.items() for x in (f"{k}{v}", p)])
        sample = each.orderBy(F.xxhash64("doc_id", "kind", "start", "end"), "doc_id", "kind", "start", "end").limit(FIT_ROWS)
        sample = sample.select("features", F.element_at(target, F.concat(F.col("kind").cast("string"), "votes")).alias("y"))
        w, bias = sample.coalesce(1).mapInArrow(_learn, "weight binary, bias double").first()
        weight = np.frombuffer(w, np.float64)
    return told.mapInArrow(_choose(weight, bias), RESULT_DDL)
