"""Personal data: labelers vote on candidate spans, EM estimates their reliabilities, a span classifier is trained.

The base patterns (e-mail addresses, IP addresses, card and phone numbers) always stay.  Candidates are the base
matches, valid or failing, and looser forms: national phone numbers, identity numbers, disguised addresses, and
names after a title or a given name from a gazetteer.  Five labelers vote yes, no or nothing on each candidate:
pattern validity, gazetteer, words before it, what touches it, and form.

``learn`` scans all documents once for candidates (``Candidate`` rows, no text), counts vote patterns over all of
them (at most 3**5), runs expectation-maximisation on the counts, and fits a logistic regression on hashed span
features to the posteriors of a bounded sample (``max_rows``, by hash).  ``pii_column`` then tags whole texts: base
spans, and every loose candidate the classifier accepts that meets no base span.  ``redacted`` replaces spans.

Patterns are written without backtracking and base spans are looked up by bisection, so a text of any content and length
takes time in proportion to its length.  Names are whole words, with accents, hyphens and apostrophes, in the forms of English, French,
German and Spanish.  Offsets are code points, end exclusive.

Defined results: a null or empty text has no spans; redaction leaves it as it is.  Without candidates nothing is added.  Base spans
of several kinds may overlap and all stay; an added span that meets a base span is left out, and of equal added spans one stays.
Repeated rows are each tagged; empty tables give empty results; the input's columns are kept and result columns replace
those of the same name.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medspan.llm.common import Spans, buffers, checkpointed, code_points, doc_groups, unused

#: Base kinds as the contract lists them, then those of the method.
KINDS = ("email", "ip", "card", "phone", "local_phone", "identity", "hidden_email", "person")
BASE = 4
LABELERS = 5
FEATURES = 128
RESULT = "struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base_sha256:string,spans:string>"

#: Fixed patterns of the contract, in forms that do not backtrack: a match can only begin where a run begins.
LOCAL, DOMAIN = rb"[A-Za-z0-9._%+-]++", rb"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
EMAIL = re.compile(rb"(?<![A-Za-z0-9._%+-])" + LOCAL + DOMAIN)
EMAIL_HERE = re.compile(LOCAL + DOMAIN)
IP = re.compile(rb"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
#: Our looser forms.
LOCAL_PHONE = re.compile(rb"(?<![0-9A-Za-z+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])")
IDENTITY = re.compile(rb"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
HIDDEN_EMAIL = re.compile(rb"(?<![A-Za-z0-9._%+-])" + LOCAL + rb" ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)+")
LETTER = rb"(?:[A-Za-z]|[\xc3-\xc9][\x80-\xbf])"
NAME = rb"(?:[A-Z]|\xc3[\x80-\x96\x98-\x9e])(?:" + LETTER + rb"|['-](?=" + LETTER + rb"))++"
TITLES = b"Mr Mrs Ms Dr Prof Mme Mlle Monsieur Madame Herr Frau Sr Sra Srta Don Do\xc3\xb1a Se\xc3\xb1or Se\xc3\xb1ora".split()
TITLED = re.compile(rb"(?<![A-Za-z\x80-\xff])(?:" + b"|".join(sorted(TITLES, key=len, reverse=True)) + rb")\.? " + NAME + rb"(?: " + NAME + rb")?+")
GIVEN_NAMES = (
    b"James Robert Michael William Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Patricia Jennifer Linda "
    b"Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Sandra Ashley Kimberly Emily Michelle Carlos Fernando Isabel "
    b"Pierre Sophie Wolfgang Juergen"
).split()
NAMED = re.compile(rb"(?<![A-Za-z\x80-\xff])(?:" + b"|".join(GIVEN_NAMES) + rb") " + NAME)
TOP_DOMAINS = frozenset(b"com org net edu gov io info biz de fr es it uk us ca eu".split())
TRIGGERS = re.compile(rb"(?i)\b(?:phone|tel|call|fax|mobile|e-?mail|mail|contact|write|ip|address|server|host|card|visa|credit|ssn|social|name|from|by)\b[^A-Za-z0-9]*$")
COUNTER_TRIGGERS = re.compile(rb"(?i)\b(?:version|ver|v|isbn|issn|order|item|page|figure|table|sku|invoice|total|section|chapter|serial)\b[^A-Za-z0-9]*$")


@dataclass(frozen=True)
class Candidate:
    kind: int
    start: int
    end: int
    valid: bool
    #: Votes of the labelers as a base-3 number: 0 nothing, 1 no, 2 yes.
    votes: int = 0
    features: tuple[int, ...] = ()


@dataclass(frozen=True)
class SpanModel:
    weights: np.ndarray
    bias: float

    def accepts(self, features: tuple[int, ...]) -> bool:
        return float(self.weights[list(features)].sum()) + self.bias > 0


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: bytes):
    m = EMAIL.search(text)
    while m:
        yield m.start(), m.end()
        m = EMAIL_HERE.match(text, m.end()) or EMAIL.search(text, m.end())


def _digits(text: bytes) -> bytes:
    return bytes(c for c in text if 48 <= c <= 57)


def matches(text: bytes, n_digits: int) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, valid) of all pattern matches of one text, in bytes."""
    out = []
    if b"@" in text:
        out += [(0, s, e, True) for s, e in _emails(text)]
    if n_digits >= 4:
        out += [(1, m.start(), m.end(), all(len(p.lstrip(b"0")) <= 3 and int(p[-8:]) <= 255 for p in m.groups())) for m in IP.finditer(text)]
    if n_digits >= 14:
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = _digits(m[0])
                if len(d) >= 14:
                    out.append((2, m.start(), m.end(), len(d) <= 19 and luhn(d)))
    if b"+" in text and n_digits >= 3:
        out += [(3, m.start(), m.end(), 10 <= len(_digits(m[0])) <= 15) for m in PHONE.finditer(text)]
    if n_digits >= 9:
        out += [(4, m.start(), m.end(), True) for m in LOCAL_PHONE.finditer(text)]
        out += [(5, m.start(), m.end(), True) for m in IDENTITY.finditer(text)]
    if b"[at]" in text or b"(at)" in text:
        out += [(6, m.start(), m.end(), True) for m in HIDDEN_EMAIL.finditer(text)]
    if any(t in text for t in TITLES):
        out += [(7, m.start(), m.end(), True) for m in TITLED.finditer(text)]
    if any(name in text for name in GIVEN_NAMES):
        out += [(7, m.start(), m.end(), True) for m in NAMED.finditer(text)]
    return out


def _class(c: int) -> int:
    if c < 0 or c in b" \t\r\n":
        return 0
    if 48 <= c <= 57:
        return 1
    return 2 if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 3


def describe(text: bytes, kind: int, start: int, end: int, valid: bool) -> Candidate:
    """A candidate with its votes and span features."""
    own, before = text[start:end], text[max(0, start - 40) : start]
    left, right = _class(text[start - 1] if start else -1), _class(text[end] if end < len(text) else -1)
    digits = _digits(own)
    pattern = 2 if kind < BASE and valid else 1 if kind < BASE else 0
    gazetteer = 0
    if kind in (0, 6):
        gazetteer = 2 if re.split(rb"[^A-Za-z]+", own.lower())[-1] in TOP_DOMAINS else 1
    elif kind == 7:
        gazetteer = 2 if any(name in own for name in GIVEN_NAMES) else 0
    context = 2 if TRIGGERS.search(before) else 1 if COUNTER_TRIGGERS.search(before) else 0
    touch = 1 if left in (1, 2) or right in (1, 2) else 2
    form = 0
    if digits:
        form = 1 if len(set(digits)) <= 2 or own.startswith((b"0.", b"127.")) else 2 if re.search(rb"[ ().-]", own) else 0
    votes = 0
    for v in (pattern, gazetteer, context, touch, form):
        votes = votes * 3 + v
    words = re.findall(rb"[a-z]+", before.lower())[-3:]
    features = (
        kind,
        8 + min(7, len(own) // 4),
        16 + min(4, 5 * len(digits) // max(1, len(own))),
        21 + min(4, len(own) - len(re.findall(rb"[A-Za-z0-9]", own))),
        26 + left,
        31 + right,
        *(36 + zlib.crc32(w) % (FEATURES - 36) for w in words),
    )
    return Candidate(kind, start, end, valid, votes, tuple(sorted(set(features))))


def _digit_counts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum((raw >= 48) & (raw <= 57), out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _texts(texts: pa.Array):
    """(row, bytes, digits in it) of each text that holds anything."""
    raw, off = buffers(texts)
    for i, j in doc_groups(off):
        n = _digit_counts(raw[off[i] : off[j]], off[i : j + 1] - off[i])
        for d in range(i, j):
            if off[d + 1] > off[d]:
                yield d, raw[off[d] : off[d + 1]], int(n[d - i])


def em(votes: np.ndarray, n: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Posterior of each vote pattern (rows of 0, 1, 2) under conditionally independent labelers; ``n`` counts patterns."""
    post = np.clip(0.5 + 0.2 * ((votes == 2).sum(1) - 1.5 * (votes == 1).sum(1)), 0.05, 0.95)
    for _ in range(rounds):
        prior = (n * post).sum() / n.sum()
        log = np.tile(np.log([1 - prior + 1e-9, prior + 1e-9]), (len(n), 1))
        for k in range(votes.shape[1]):
            for c, w in ((0, n * (1 - post)), (1, n * post)):
                p = np.bincount(votes[:, k], weights=w, minlength=3) + 1.0
                log[:, c] += np.log(p / p.sum())[votes[:, k]]
        post = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
    return post


def learn(docs: DataFrame, text: str = "text", max_rows: int = 20_000, rounds: int = 300) -> SpanModel:
    """The span classifier of a corpus: candidates of all documents, EM over their votes, a fit to a bounded sample."""

    def candidates(batches):
        for batch in batches:
            found = [describe(b, *m) for _, raw, n in _texts(batch.column("text")) for b in (raw.tobytes(),) for m in matches(b, n)]
            at = [zlib.crc32(repr((c.kind, c.start, c.end, c.features)).encode()) & 0x3FFFFFFF for c in found]
            yield pa.RecordBatch.from_arrays([pa.array([c.votes for c in found], pa.int32()), pa.array([list(c.features) for c in found], pa.list_(pa.int32())), pa.array(at, pa.int32())], ["votes", "features", "at"])

    found = checkpointed(docs.select(F.col(text).alias("text")).mapInArrow(candidates, "votes int, features array<int>, at int"))
    patterns = found.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()
    if not patterns:
        return SpanModel(np.zeros(FEATURES), -1.0)
    table = np.array([[r["votes"] // 3 ** (LABELERS - 1 - k) % 3 for k in range(LABELERS)] for r in patterns])
    n = np.array([r["n"] for r in patterns], dtype=float)
    post = dict(zip([r["votes"] for r in patterns], em(table, n), strict=True))
    limit = int(min(1.0, max_rows / n.sum()) * (1 << 30))
    sample = found.where(F.col("at") < limit).groupBy("votes", "features").agg(F.count("*").alias("n")).orderBy("votes", "features").collect()
    x = np.zeros((len(sample), FEATURES))
    for i, r in enumerate(sample):
        x[i, r["features"]] = 1
    y = np.array([post[r["votes"]] for r in sample])
    w = np.array([r["n"] for r in sample], dtype=float)
    weights, bias = np.zeros(FEATURES), 0.0
    for step in range(rounds if len(sample) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -40, 40)))
        rate = 2.0 / (1 + step / 100)
        weights -= rate * ((w * (p - y)) @ x / w.sum() + 1e-4 * weights)
        bias -= rate * (w * (p - y)).sum() / w.sum()
    return SpanModel(np.round(weights, 9), round(float(bias), 9))


def spans_of(text: bytes, n_digits: int, model: SpanModel) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) in bytes: the base spans, and those the method adds."""
    found = matches(text, n_digits)
    base = [(s, k, e) for k, s, e, valid in found if k < BASE and valid]
    added, held = [], Spans([(s, e) for s, _, e in base])
    for k, s, e, valid in found:
        if k >= BASE and not held.meets(s, e) and model.accepts(describe(text, k, s, e, valid).features):
            added.append((s, k, e))
    return base, sorted(set(added))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def pii_column(spark: SparkSession, text: Column, model: SpanModel) -> Column:
    shared = spark.sparkContext.broadcast(model)
    empty = hashlib.sha256(b"").hexdigest()

    @F.arrow_udf(RESULT)
    def pii(texts: pa.Array) -> pa.Array:
        counts = np.zeros((BASE, len(texts)), dtype=np.int64)
        sha, out = [empty] * len(texts), [""] * len(texts)
        for row, raw, n in _texts(texts):
            base, added = spans_of(raw.tobytes(), n, shared.value)
            if not base and not added:
                continue
            at = code_points(raw)
            base, added = ([(int(at[s]), k, int(at[e])) for s, k, e in spans] for spans in (base, added))
            for _, k, _ in base:
                counts[k, row] += 1
            sha[row] = hashlib.sha256(_joined(base).encode()).hexdigest()
            out[row] = _joined(base + added)
        return pa.StructArray.from_arrays([*(pa.array(c) for c in counts), pa.array(sha, pa.string()), pa.array(out, pa.string())], ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return pii(text)


def redact_text(text: bytes, spans: list[tuple[int, int, int]]) -> bytes:
    """Spans replaced by their kind in brackets; spans that overlap become one, under the first one's kind."""
    parts, at, open_ = [], 0, None
    for s, k, e in sorted(spans):
        if open_ is not None and s < open_[1]:
            open_ = (open_[0], max(open_[1], e), open_[2])
            continue
        if open_ is not None:
            parts += [text[at : open_[0]], b"[" + KINDS[open_[2]].upper().encode() + b"]"]
            at = open_[1]
        open_ = (s, e, k)
    if open_ is not None:
        parts += [text[at : open_[0]], b"[" + KINDS[open_[2]].upper().encode() + b"]"]
        at = open_[1]
    return b"".join([*parts, text[at:]])


def redacted(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """``docs`` with the personal data of ``text`` replaced; all columns and their order stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def redact(texts: pa.Array) -> pa.Array:
        changed = {}
        for row, raw, n in _texts(texts):
            whole = raw.tobytes()
            base, added = spans_of(whole, n, shared.value)
            if base or added:
                changed[row] = redact_text(whole, base + added).decode("utf-8", "replace")
        if not changed:
            return texts
        values = texts.to_pylist()
        for row, value in changed.items():
            values[row] = value
        return pa.array(values, pa.string())

    return docs.withColumn(text, redact(F.col(text)))


def find_pii(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """``docs`` with counts of each base kind, the digest of the base spans, and all spans."""
    names = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    made = unused(docs, "pii")
    return docs.withColumn(made, pii_column(docs.sparkSession, F.col(text), model)).withColumns({c: F.col(f"{made}.{c}") for c in names}).drop(made)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_pii(docs, learn(docs)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
