"""Token counts: prefix dynamic programming over byte-level BPE.

For a pre-token (a run the tokenizer never merges across), the last token of each prefix follows from the last token
of a shorter prefix: token ``t`` ends prefix ``i`` exactly when ``t`` is a token of its own, and the last token of the
prefix before it and ``t`` stay apart when encoded together (a published property of BPE).  So one pass stores the exact token count at every
prefix; a text's counts are running sums over its pre-tokens.  ``PrefixCounter`` answers totals, counts at any prefix,
and the longest prefix within a budget, without encoding again.

Work memory is bounded: pre-token tables are kept in a cache of at most 2 x ``CACHE`` entries and 2 x ``CACHE_CHARS`` characters,
long texts are read in pieces, and a pre-token of any length takes one linear pass.  A vocabulary file with another model, normaliser
or pre-tokenizer than the one written here is refused.

Defined results: a null text counts as empty (0 tokens).  A special token's string inside a text is one token, the
library's default.  Repeated rows are each counted; empty tables give empty results; the input's columns are kept and
the result columns replace those of the same name.  The vocabulary file's path is a parameter.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medspan.llm.common import unused

LIMIT = 1024
CACHE, CACHE_CHARS = 300_000, 16_000_000
PIECE = 1 << 20
RESULT = "struct<n_tokens:bigint,fit_chars:bigint>"
#: Fixed pattern of the vocabulary's published pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTRACTIONS = ("'re", "'ve", "'ll")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte, as byte-level vocabularies write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def _unassigned() -> re.Pattern:
    """Characters that Unicode had not assigned when this Python was built; libraries may class them differently."""
    spans, start = [], None
    for c in range(0x110001):
        open_ = c < 0x110000 and unicodedata.category(chr(c)) == "Cn"
        if open_ and start is None:
            start = c
        elif not open_ and start is not None:
            spans.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return re.compile("[" + "".join(spans) + "]")


def check(spec: dict) -> None:
    """Refuse vocabulary files whose rules are not the ones that this module applies."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    bytewise = cut.get("type") == "ByteLevel" and cut.get("add_prefix_space") is False and cut.get("use_regex", True) is True
    tokens = all(not (t.get("single_word") or t.get("lstrip") or t.get("rstrip")) for t in spec["added_tokens"])
    if not (plain and bytewise and tokens and spec.get("normalizer") is None and spec.get("post_processor") is None):
        raise ValueError("the vocabulary file is no plain byte-level BPE with the standard pre-tokenizer")


class PrefixCounter:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check(spec)
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank: dict[tuple[str, str], int] = {(a, b): i for i, (a, b) in enumerate(merges)}
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split = regex.compile(PATTERN).findall
        self.own_split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.unassigned = _unassigned()
        self.high = re.compile(r"[^\x00-ԯ]")
        self.letters = byte_alphabet()
        self.ascii = {i: c for i, c in enumerate(self.letters[:128])}
        self.tables: dict[str, bytes | list[int]] = {}
        self.old_tables: dict[str, bytes | list[int]] = {}
        self.held_chars = 0
        self.apart: dict[int, bool] = {}
        self._own_tokens()

    def merge(self, text: str) -> list[str]:
        """Plain BPE of a short string of stand-ins: the rule that the dynamic program rests on."""
        parts = list(text)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _own_tokens(self) -> None:
        """Number the tokens that encode to themselves in the order of their merges, with the two parts of each.

        A merge makes a token of its own when its parts, side by side, meet no earlier merge; so one pass in merge
        order, each step a test of two known tokens, finds them all.
        """
        self.own: dict[str, int] = {c: i for i, c in enumerate(self.letters)}
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(256)]
        self.joins: dict[int, int] = {}
        for (a, b), rank in sorted(self.rank.items(), key=lambda x: x[1]):
            x, y = self.own.get(a), self.own.get(b)
            if x is None or y is None or a + b in self.own or not self._stays(x, y):
                continue
            self.own[a + b] = len(self.parts)
            self.joins[x << 20 | y] = len(self.parts)
            self.parts.append((x, y))
        #: Every beginning of a token: its number where it is a token itself, else -1.
        self.begins: dict[str, int] = {t[:k]: -1 for t in self.own for k in range(1, len(t))} | self.own

    def _stays(self, left: int, right: int) -> bool:
        """Whether two tokens side by side stay two: no merge across their border comes before a merge that made them.

        Both are undone step by step, the later one first; a join of the facing parts that is older than what was
        undone last would have happened before it.
        """
        joins, parts, before = self.joins.get, self.parts, 1 << 60
        while True:
            if joins(left << 20 | right, before) < before:
                return False
            if left > right or right < 256:
                if left < 256:
                    return True
                before, left = left, parts[left][1]
            else:
                before, right = right + 1, parts[right][0]

    def prefix_counts(self, piece: str) -> list[int]:
        """Token count of each byte prefix of one pre-token, given in stand-ins; entry 0 is 0.

        Prefixes are settled in order; from each, the tokens that begin there are walked until no token goes on.
        """
        n = len(piece)
        count, last = [0] * (n + 1), [0] * (n + 1)
        begins, apart = self.begins.get, self.apart
        for j in range(n):
            before = last[j] << 20
            for i in range(j + 1, n + 1):
                token = begins(piece[j:i])
                if token is None:
                    break
                if token < 0 or count[i]:
                    continue
                if j:
                    stays = apart.get(before | token)
                    if stays is None:
                        if len(apart) >= CACHE:
                            apart.clear()
                        stays = apart[before | token] = self._stays(last[j], token)
                    if not stays:
                        continue
                count[i], last[i] = count[j] + 1, token
        return count

    def counts_of(self, piece: str) -> list[int] | bytes:
        """Token count at each character prefix of a pre-token (as text); entry 0 is 0."""
        known = self.tables.get(piece)
        if known is None:
            known = self.old_tables.get(piece) or self._table(piece)
            if len(self.tables) >= CACHE or self.held_chars >= CACHE_CHARS:  # two generations: what was not asked for lately goes
                self.tables, self.old_tables, self.held_chars = {}, self.tables, 0
            self.tables[piece] = known
            self.held_chars += len(piece)
        return known

    def _table(self, piece: str) -> list[int] | bytes:
        if piece.isascii():
            known = self.prefix_counts(piece.translate(self.ascii))
        else:
            by_byte = self.prefix_counts("".join([self.letters[b] for b in piece.encode("utf-8")]))
            known, at = [0], 0
            for c in piece:
                at += len(c.encode("utf-8"))
                known.append(by_byte[at])
        if piece in CONTRACTIONS:  # a shorter prefix is an apostrophe and a letter, two pre-tokens
            known = [0, 1, 2, known[3]]
        return bytes(known) if len(known) < 256 else known

    def n_tokens(self, piece: str) -> int:
        return self.counts_of(piece)[-1]

    def pieces(self, text: str):
        """Lists of pre-tokens of a text without special tokens, in order.  Long texts are cut where no pre-token can run across."""
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > PIECE:
                cut = _SAFE_CUT.search(text, at + PIECE)
                end = cut.start() + 1 if cut else end
            part = text[at:end] if at or end < len(text) else text
            if not part.isascii() and self.high.search(part) and self.unassigned.search(part):
                yield [part[s:e] for _, (s, e) in self.own_split(part)]
            else:
                yield self.split(part)
            at = end

    def segments(self, text: str):
        """(is_special, string) in order."""
        at = 0
        if self.special is not None:
            for m in self.special.finditer(text):
                if m.start() > at:
                    yield False, text[at : m.start()]
                yield True, m[0]
                at = m.end()
        if at < len(text):
            yield False, text[at:]

    def count(self, text: str | None, limit: int) -> tuple[int, int]:
        """(tokens of the text, ``fit``).

        ``fit`` counts the characters of the whole pre-tokens within ``limit`` tokens, and of the longest prefix of the
        next pre-token that its stored counts still allow.
        """
        total, chars, fit = 0, 0, None
        for special, part in self.segments(text or ""):
            for pieces in [[part]] if special else self.pieces(part):
                counts = [1] if special else self._totals(pieces)
                here = sum(counts)
                if fit is None and total + here > limit:
                    fit = chars + self._fit(pieces, counts, limit - total, special)
                total += here
                chars += sum(map(len, pieces)) if fit is None else 0
        return total, chars if fit is None else fit

    def _totals(self, pieces: list[str]) -> list[int]:
        known = list(map(self.tables.get, pieces))
        return [(self.counts_of(p) if t is None else t)[-1] for p, t in zip(pieces, known, strict=True)]

    def _fit(self, pieces: list[str], counts: list[int], budget: int, special: bool) -> int:
        sums = list(accumulate(counts))
        i = bisect_right(sums, budget)
        left, inside = budget - (sums[i - 1] if i else 0), 0
        if not special:
            for p, n in enumerate(self.counts_of(pieces[i])):
                inside = p if n <= left else inside
        return sum(map(len, pieces[:i])) + inside

    def at_prefix(self, text: str, chars: int) -> int:
        """Tokens of ``text[:chars]``, from stored counts."""
        return next(n for p, n in self.all_prefixes(text) if p == chars)

    def all_prefixes(self, text: str):
        """(characters, tokens) for every prefix of a text, the empty one first."""
        yield 0, 0
        total = chars = 0
        run, run_total = "", 0  # the ordinary text since the last special token, and the tokens before it
        for special, part in self.segments(text):
            if special:
                for k in range(1, len(part)):  # until it is complete, its letters are ordinary text
                    yield chars + k, run_total + sum(self.n_tokens(p) for ps in self.pieces(run + part[:k]) for p in ps)
                total, chars = total + 1, chars + len(part)
                yield chars, total
                run, run_total = "", total
                continue
            run, before = part, ""
            for pieces in self.pieces(part):
                for piece in pieces:
                    counts = self.counts_of(piece)
                    for k in range(1, len(piece) + 1):
                        n = total + counts[k]
                        if k == 1 and before.isspace() and piece[0].isspace():  # one run of white space so far
                            n = total - self.n_tokens(before) + self.n_tokens(before + piece[0])
                        yield chars + k, n
                    total, chars, before = total + counts[-1], chars + len(piece), piece


_SAFE_CUT = re.compile(r"[^\s'] [^\s]")
_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The counter of a vocabulary file; each Python worker builds it once."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_column(text: Column, path: str, limit: int = LIMIT) -> Column:
    @F.arrow_udf(RESULT)
    def tokens(texts: pa.Array) -> pa.Array:
        made = counter(path)
        n, fit = [], []
        for text in texts:
            a, b = made.count(text.as_py(), limit)
            n.append(a)
            fit.append(b)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(fit, pa.int64())], ["n_tokens", "fit_chars"])

    return tokens(text)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens``, ``over_limit`` and ``fit_chars`` (longest prefix within the limit)."""
    own = unused(docs, "tokens")
    made = docs.withColumn(own, token_column(F.col(text), path, limit))
    return made.withColumns(
        {
            "n_bytes": F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long"),
            "n_tokens": F.col(f"{own}.n_tokens"),
            "over_limit": F.col(f"{own}.n_tokens") > limit,
            "fit_chars": F.col(f"{own}.fit_chars"),
        }
    ).drop(own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, default_path()).select("doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars")
