"""Secret scan: fixed patterns, and character Markov models of random strings and ordinary identifiers.

The base patterns (assignments, access keys, hex runs) always stay.  The method adds spans of kind ``random``.  What
base spans leave of each run of token characters is scored by the best log-likelihood ratio per character between a
first-order Markov model of random strings (one for each alphabet) and one of ordinary identifiers: the whole run first and, where that
is not random, its parts between ``/ _ = -``, so that a key within a path or a name is found.  The bound rises with shortness
(``least_ratio``), as short strings tell less; runs and parts under ``min_token`` characters are not scored (README has figures).  Both models are trained from labelled samples,
which ``labelled_samples`` builds from fixed parts and a seed.

Texts are scanned as UTF-8 bytes in Arrow batches; offsets are reported in code points, end exclusive.

Defined results: a null text counts as empty and has no spans.  A text of any length and content takes time in proportion to
its length.  A ratio equal to the bound counts as random; of equal ratios of several alphabets it does not matter which.  Repeated
rows are each scanned, an empty table gives an empty result, columns of the input are kept and the result columns replace
those of the same name.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medspan.llm.common import Spans, buffers, code_points, doc_groups, runs, unused

KINDS = ("assign", "access", "hex", "random")
#: Least characters of a scored run or part.
MIN_TOKEN = 12
#: Nats per character by which a random model must beat the ordinary one, and how much more for each character under ``SURE``.
MIN_RATIO, SHORT_RATIO, SURE = 0.7, 0.05, 20
RESULT = "struct<n_assign:bigint,n_access:bigint,n_hex:bigint,base_sha256:string,spans:string>"

#: Fixed patterns of the contract.
ASSIGN = re.compile(rb"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

ALPHABETS = {
    "hex": "0123456789abcdef",
    "upper_hex": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": "abcdefghijklmnopqrstuvwxyz0123456789",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
IDENTIFIER_PARTS = (
    "user account service request response handler factory builder manager config session cache index table column row value "
    "field record query result error status message event listener buffer stream reader writer parser token lexer node tree graph "
    "edge vertex matrix vector number string integer double float boolean array list map queue stack heap thread process task job "
    "worker schedule timer clock date time zone region country city street address name title label color width height length size "
    "count total average maximum minimum offset limit page header footer body content document paragraph section chapter version "
    "release build deploy test check verify validate update delete insert create remove connection network socket server client "
    "protocol packet router gateway balance payment invoice order product customer supplier warehouse shipment delivery tracking "
    "international organization understanding administration responsibilities communications recommendation transformation"
).split()
#: Common short words and syllables of English, German, French and Spanish, for words that run together.
PROSE_PARTS = (
    "the and with that this from have which their there would about other these between through because another without something "
    "und nicht schaft heit keit lich ver ein sch ung zeit tion ment aux eau que pour dans avec elle vous est les des sur "
    "cion dad mente para como esta pero sobre entre cuando donde"
).split()

PART = re.compile(rb"[A-Za-z0-9+]+")
_CODE = np.full(256, -1, dtype=np.int64)
_CHARS = sorted(set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"))
for _i, _c in enumerate(_CHARS):
    _CODE[ord(_c)] = _i
_HEX = np.zeros(256, dtype=bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True


def labelled_samples(seed: int = 17, per_kind: int = 1500) -> list[tuple[str, str]]:
    """(string, label): ``ordinary``, or the alphabet of a random string.  The same for every seed and machine."""
    rng = random.Random(seed)
    rows = []
    for name, alphabet in ALPHABETS.items():
        rows += [("".join(rng.choice(alphabet) for _ in range(rng.randint(20, 64))), name) for _ in range(per_kind)]
    for _ in range(3 * per_kind):
        parts = [rng.choice(IDENTIFIER_PARTS) for _ in range(rng.randint(1, 4))]
        text = rng.choice(("_", "-", "/", "")).join(p.capitalize() if rng.random() < 0.3 else p for p in parts)
        text = text.upper() if rng.random() < 0.12 else text
        rows.append((text + (str(rng.randint(0, 2030)) if rng.random() < 0.2 else ""), "ordinary"))
    rows += [("".join(rng.choice(PROSE_PARTS) for _ in range(rng.randint(2, 6))), "ordinary") for _ in range(per_kind)]
    return rows


def train(samples: list[tuple[str, str]], smoothing: float = 0.05) -> np.ndarray:
    """Log-ratio tables, one (from, to) matrix for each alphabet: random minus ordinary."""
    k = len(_CHARS)
    names = sorted({label for _, label in samples} - {"ordinary"})
    count = {name: np.full((k, k), smoothing) for name in [*names, "ordinary"]}
    count["ordinary"] += 0.45  # ordinary text may hold any pair
    for text, label in samples:
        codes = _CODE[np.frombuffer(text.encode(), dtype=np.uint8)]
        np.add.at(count[label], (codes[:-1], codes[1:]), 1)
    log = {name: np.log(c / c.sum(1, keepdims=True)) for name, c in count.items()}
    return np.stack([log[name] - log["ordinary"] for name in names])


def ratio(token: bytes, tables: np.ndarray) -> float:
    """Best mean log-likelihood ratio over the alphabets."""
    codes = _CODE[np.frombuffer(token, dtype=np.uint8)]
    if len(codes) < 2:
        return 0.0
    return float(tables[:, codes[:-1], codes[1:]].mean(1).max())


def least_ratio(size: int) -> float:
    return MIN_RATIO + SHORT_RATIO * max(0, SURE - size)


def is_random(token: bytes, tables: np.ndarray) -> bool:
    return ratio(token, tables) >= least_ratio(len(token))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def random_spans(text: bytes, start: int, end: int, tables: np.ndarray, min_token: int) -> list[tuple[int, int]]:
    """The run itself if it is random, else its random parts."""
    if end - start < min_token:
        return []
    if is_random(text[start:end], tables):
        return [(start, end)]
    parts = [(start + m.start(), start + m.end()) for m in PART.finditer(text[start:end]) if m.end() - m.start() >= min_token]
    return [(s, e) for s, e in parts if (s, e) != (start, end) and is_random(text[s:e], tables)]


def scan(texts: pa.Array, tables: np.ndarray, min_token: int = MIN_TOKEN) -> pa.StructArray:
    raw, off = buffers(texts)
    n = len(off) - 1
    counts = np.zeros((3, n), dtype=np.int64)
    sha, found = [hashlib.sha256(b"").hexdigest()] * n, [""] * n
    for i, j in doc_groups(off):
        block, limits = raw[off[i] : off[j]], off[i:j] - off[i]
        hexes, longs = runs(_HEX[block], limits, 32), runs(_CODE[block] >= 0, limits, min_token)
        hex_doc, long_doc = (np.searchsorted(limits, x[0], side="right") - 1 for x in (hexes, longs))
        for d in range(j - i):
            text = raw[off[i + d] : off[i + d + 1]].tobytes()
            base: list[tuple[int, int, int]] = []
            low = text.lower()
            if any(hint in low for hint in ASSIGN_HINTS):
                base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
            if b"AKIA" in text:
                base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
            lo, hi = np.searchsorted(hex_doc, (d, d + 1))
            base += [(int(s - limits[d]), 2, int(e - limits[d])) for s, e in zip(hexes[0][lo:hi], hexes[1][lo:hi], strict=True)]
            lo, hi = np.searchsorted(long_doc, (d, d + 1))
            added, held = [], Spans([(s, e) for s, _, e in base])
            for s, e in zip((longs[0][lo:hi] - limits[d]).tolist(), (longs[1][lo:hi] - limits[d]).tolist(), strict=True):
                added += [(x, 3, y) for a, b in held.gaps(s, e) for x, y in random_spans(text, a, b, tables, min_token)]
            if not base and not added:
                continue
            at = code_points(raw[off[i + d] : off[i + d + 1]])
            base = [(int(at[s]), k, int(at[e])) for s, k, e in base]
            added = [(int(at[s]), k, int(at[e])) for s, k, e in added]
            for _, k, _ in base:
                counts[k, i + d] += 1
            sha[i + d] = hashlib.sha256(_joined(base).encode()).hexdigest()
            found[i + d] = _joined(base + added)
    return pa.StructArray.from_arrays([*(pa.array(c) for c in counts), pa.array(sha, pa.string()), pa.array(found, pa.string())], ["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def secret_column(spark: SparkSession, text: Column, min_token: int = MIN_TOKEN) -> Column:
    shared = spark.sparkContext.broadcast(train(labelled_samples()))

    @F.arrow_udf(RESULT)
    def secrets(texts: pa.Array) -> pa.Array:
        return scan(texts, shared.value, min_token)

    return secrets(text)


def find_secrets(docs: DataFrame, text: str = "text", min_token: int = MIN_TOKEN) -> DataFrame:
    """``docs`` with counts of each base kind, the digest of the base spans, and all spans."""
    names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
    made = unused(docs, "secrets")
    return docs.withColumn(made, secret_column(docs.sparkSession, F.col(text), min_token)).withColumns({c: F.col(f"{made}.{c}") for c in names}).drop(made)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
