"""Spans of notes that may be keys of a dictionary, found for a batch of notes at once.

A note's look-up keys are word sequences: of the span itself, of its repaired form, and of both without context words, units and
numbers.  This scan walks a batch as arrays, never span by span:

1. The batch is folded to one stream of ASCII letters and digits; words are runs of it, told by a polynomial hash of which every sub-run is read off a
   running sum.  Tokens point into the stream, also where they begin or end within a folded word.
2. Each word is classed: *known* (a word of some key), *droppable* (forms of a key may lack it), *wild* (repairs may
   change it: shorthands, digits next to letters, spelled letters), or a part of a *pair* that repairs join.  What is none of these is dead, and so is
   every span over it; and a span that holds nothing known or repairable is dead too.
3. Of the spans left, those that no repair touches are matched as word sequences: running sums over all words, over names alone
   and over words that are no context words give the hash of each form, whatever the span's length, and ``KeyFilter`` tells whether the dictionary
   holds it.  Repaired spans stay as candidates.
4. Known names of dense lines are searched in the stream without its gaps.

The result is a superset of the spans with a look-up hit: candidates are looked up exactly afterwards.  Bit sets have a fixed size whatever the dictionary.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from medspan.functions import lexicon as lx

#: Bits of the sets of words and of keys.
WORD_BITS, KEY_BITS = 24, 26
BATCH_CHARS = 1 << 18
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}
_CONFUSABLE = str.maketrans(lx.CONFUSABLE_FROM, lx.CONFUSABLE_TO)
_ALNUM = np.zeros(128, dtype=np.uint8)  # letters and digits as lower-case codes, everything else zero
for _c in "0123456789abcdefghijklmnopqrstuvwxyz":
    _ALNUM[ord(_c)] = _ALNUM[ord(_c.upper())] = ord(_c)


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, BATCH_CHARS + 2), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


class Sums:
    """Polynomial hashes of all sub-runs of a sequence, from a running sum."""

    def __init__(self, values: np.ndarray, base: int):
        self.base, self.total = base, np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * _power(base, len(values)), out=self.total[1:])

    def raw(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.total[b] - self.total[a]) * _power(_inverse(self.base), len(self.total))[a]


def _running(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _has(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bits[slot >> np.uint64(3)] >> (np.uint64(7) - (slot & np.uint64(7))).astype(np.uint8)) & 1 == 1


def _sorted_mix(word: np.ndarray) -> np.ndarray:
    return _mix(word * np.uint64(0xC2B2AE3D27D4EB4F))


class KeyFilter:
    """What a dictionary may hold, as bit sets: words, keys as word sequences, and keys of two or three words in order as word sets; and what
    keys begin with: their first words, however many, or parts of their word sets."""

    def __init__(self, word_slots: np.ndarray, key_slots: np.ndarray, begin_slots: np.ndarray):
        self.words, self.keys, self.begun = (self._packed(s, n) for s, n in ((word_slots, WORD_BITS), (key_slots, KEY_BITS), (begin_slots, KEY_BITS)))

    @staticmethod
    def _packed(slots: np.ndarray, bits: int) -> np.ndarray:
        out = np.zeros(1 << bits, dtype=bool)
        out[slots.astype(np.int64)] = True
        return np.packbits(out)

    @classmethod
    def of(cls, names: list[str]) -> KeyFilter:
        return cls(*key_slots(names))

    def knows(self, word: np.ndarray) -> np.ndarray:
        return _has(self.words, word >> np.uint64(64 - WORD_BITS))

    def holds(self, key: np.ndarray) -> np.ndarray:
        return _has(self.keys, key >> np.uint64(64 - KEY_BITS))

    def found(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether keys begin so, and whether a key is so."""
        begun = _has(self.begun, key >> np.uint64(64 - KEY_BITS))
        held = begun.copy()
        at = np.flatnonzero(begun)
        held[at] = self.holds(key[at])
        return begun, held


def key_slots(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the words of normalised names, of the names, and of what they begin with."""
    stream = np.frombuffer(("\n".join(names) + "\n").encode(), dtype=np.uint8)
    line = np.concatenate([[0], np.flatnonzero(stream == 10) + 1])
    stream = np.where(stream < 128, _ALNUM[stream & 127], 0)
    starts, ends = _runs(stream != 0)
    word = _mix(Sums(stream.astype(np.uint64), _P).raw(starts, ends))
    first = np.searchsorted(starts, line)
    a, b = first[:-1], first[1:]
    sums = Sums(word, _Q)
    keys = _mix(sums.raw(a, b))[b > a]
    few = np.flatnonzero((b - a >= 2) & (b - a <= 3))
    few = few[[(w := names[i].split()) == sorted(w) for i in few.tolist()]] if len(few) else few
    x, size = a[few], (b - a)[few]
    one = _sorted_mix(np.append(word, np.zeros(2, np.uint64)))
    two, three = one[x] + one[x + 1], one[x] + one[x + 1] + one[x + 2]
    more = size == 3
    sets = _mix(np.where(more, three, two) + np.uint64(1))
    parts = [one[x], one[x + 1], one[x + 2][more], two[more], (one[x] + one[x + 2])[more], (one[x + 1] + one[x + 2])[more]]
    begun = [keys, sets, *(_mix(p + np.uint64(1)) for p in parts)]
    for n in range(1, int((b - a).max(initial=0))):
        longer = a[b - a > n]
        begun.append(_mix(sums.raw(longer, longer + n)))
    slots = lambda h, bits: np.unique(h >> np.uint64(64 - bits))
    return slots(word, WORD_BITS), slots(np.concatenate([keys, sets]), KEY_BITS), slots(np.concatenate(begun), KEY_BITS)


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


@lru_cache(maxsize=1)
def _fixed() -> dict[str, np.ndarray]:
    """Sorted hashes of the fixed words, and a bit set of them."""
    lists = {
        "context": lx.CONTEXT_WORDS,
        "dropped": [*lx.CONTEXT_WORDS, *lx.STRENGTH_UNITS],
        "short": list(lx.TOKEN_REPLACEMENTS),
        "zeros": ["o" * k + u for k in range(1, 10) for u in ("", "mg", "mcg", "g", "ml", "unit", "units", "meq") if k > 1 or u],
        "o": ["o"],
        "0": ["0"],
        "split": ["m", "mc"],
    }
    out = {}
    for name, words in lists.items():
        stream = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
        stream = np.where(stream == 32, 0, stream)
        out[name] = np.unique(_mix(Sums(stream.astype(np.uint64), _P).raw(*_runs(stream != 0))))
        out[f"{name} slots"] = np.zeros(1 << 14, dtype=bool)
        out[f"{name} slots"][out[name] >> np.uint64(50)] = True
    return out


def _among(word: np.ndarray, kind: str) -> np.ndarray:
    table = _fixed()[kind]
    hit = _fixed()[f"{kind} slots"][word >> np.uint64(50)]
    at = np.flatnonzero(hit)
    hit[at] = table[np.minimum(np.searchsorted(table, word[at]), len(table) - 1)] == word[at]
    return hit


@lru_cache(maxsize=1 << 16)
def _folded(char: str) -> str:
    """ASCII form of a character outside ASCII."""
    return unicodedata.normalize("NFKD", char.translate(_CONFUSABLE)).encode("ascii", "ignore").decode()


@dataclass
class Note:
    """What the scan found in a note; offsets are the note's.

    ``spans`` are (first token, tokens, start, end) by line, longest first, then from the left, each line a list; ``shorts`` the
    (token, start, end) that may be shorthands, and ``dense`` the starts of lines that may be dense, both by line start.
    """

    has_token: bool
    lines: dict[int, list[tuple[int, int, int, int]]]
    shorts: dict[int, list[tuple[int, int, int]]]
    dense: list[int]


class Batch:
    """Arrays of some notes joined by line ends."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.whole = "\n".join(texts) + "\n"
        self.code = np.frombuffer(self.whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        self.base, self.length = np.cumsum(size) - size, size - 1
        self._fold()
        self._tokens()
        self._words()

    def _fold(self) -> None:
        code = self.code
        wide = np.flatnonzero(code >= 128)
        low = _ALNUM[np.where(code < 128, code, 0)]
        length = np.ones(len(code), dtype=np.int64)
        if len(wide):
            chars, of = np.unique(code[wide], return_inverse=True)
            made = [_folded(chr(c)) for c in chars.tolist()]
            length[wide] = np.array([len(m) for m in made])[of]
            low[wide] = np.array([_ALNUM[ord(m[0])] if m else 0 for m in made], dtype=np.uint8)[of]
        #: Place of each code point in the stream.
        self.place = np.zeros(len(code) + 1, dtype=np.int64)
        np.cumsum(length, out=self.place[1:])
        self.stream = np.repeat(low, length)
        if len(wide):
            for k in np.flatnonzero(np.array([len(m) for m in made]) > 1).tolist():
                at = self.place[wide[of == k]]
                for j, c in enumerate(made[k]):
                    self.stream[at + j] = _ALNUM[ord(c)]

    def _tokens(self) -> None:
        """Tokens as the fixed pattern cuts them: runs of letters and digits, linked by one of ``+/%_-``, then by dots only."""
        code = self.code
        starts, ends = _runs((code < 128) & (_ALNUM[np.where(code < 128, code, 0)] != 0))
        mark = code[np.minimum(ends[:-1], len(code) - 1)] if len(ends) else ends
        close = starts[1:] - ends[:-1] == 1
        dot = close & (mark == ord("."))
        link = close & np.isin(mark, [ord(c) for c in "+/%_-"])
        link[1:] &= ~dot[:-1]
        new = np.append(True, ~(dot | link)) if len(starts) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.start, self.end = starts[first], ends[np.append(first[1:] - 1, len(ends) - 1)] if len(first) else ends
        breaks = np.flatnonzero(code == 10)
        self.line = np.searchsorted(breaks, self.start)
        #: Start of each line, and the note it is of.
        self.line_start = np.append(0, breaks + 1)
        self.note = np.searchsorted(np.searchsorted(self.line_start, self.base), np.arange(len(self.line_start)), side="right") - 1

    def _words(self) -> None:
        s = self.stream
        self.ws, self.we = _runs(s != 0)
        self.hashes = Sums(s.astype(np.uint64), _P)
        digit = (s >= 48) & (s < 58)
        self.digits = _running(digit)
        border = np.zeros(len(s), dtype=bool)
        border[:-1] = (s[:-1] != 0) & (s[1:] != 0) & (digit[:-1] != digit[1:])
        self.borders = _running(border)
        a, b = self.place[self.start], self.place[self.end]
        #: First and last word of each token, and whether the token begins or ends within it.
        self.fw, self.lw = np.searchsorted(self.we, a, side="right"), np.searchsorted(self.ws, b - 1, side="right") - 1
        self.a, self.b = a, b
        self.cut_start, self.cut_end = self.ws[self.fw] < a, self.we[self.lw] > b

    def classed(self, a: np.ndarray, b: np.ndarray, knows) -> dict[str, np.ndarray]:
        """Classes of the runs [a, b) of the stream, each a word or a part of one."""
        raw = self.hashes.raw(a, b)
        word = _mix(raw)
        size = b - a
        digits = self.digits[b] - self.digits[a]
        wild = (self.borders[b - 1] - self.borders[a] > 0) | _among(word, "short") | _among(word, "zeros")
        long = np.flatnonzero(size > 9)
        for k in (0, 1, 2, 4, 8):
            long = long[self.stream[a[long] + k] == ord("o")]
        wild[long] = True
        return {"raw": raw, "word": word, "size": size, "digits": digits, "wild": wild, "known": knows(word), "context": _among(word, "context"), "dropped": _among(word, "dropped") | (digits == size), "single": (size == 1) & (digits == 0), "zero": _among(word, "o")}

    @staticmethod
    def good_pair(x: dict, y: dict, knows, i=slice(None), j=slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Whether repairs join the words ``x[i]`` and ``y[j]``; whether what they make may be of a key; whether it is a shorthand; its hash."""
        sx, sy = x["size"][i], y["size"][j]
        plain = (x["digits"][i] == 0) & (y["digits"][j] == 0) & (sx >= 2) & (sx <= 6) & (sy >= 2) & (sy <= 8) & ~x["context"][i] & ~y["context"][j]
        word = _mix(x["raw"][i] + y["raw"][j] * _power(_P, 16)[np.minimum(sx, 15)])
        short = plain & _among(word, "short")
        joins = plain & ((sx + sy >= 7) | short)
        return joins, joins & (short | _among(word, "dropped") | knows(word)), short, word


def _near(flags: np.ndarray) -> np.ndarray:
    """Flags and their neighbours."""
    out = flags.copy()
    out[1:] |= flags[:-1]
    out[:-1] |= flags[1:]
    return out


@dataclass
class Scanned:
    """What the scan found in a batch: ``first`` tokens and sizes of spans by line, longest first, then from the left; tokens that may be
    shorthands; and lines that may be dense."""

    batch: Batch
    first: np.ndarray
    size: np.ndarray
    shorts: np.ndarray
    dense: np.ndarray

    def notes(self, asked: np.ndarray | None = None) -> list[Note | None]:
        """The ``Note`` of each text, or of those ``asked`` for."""
        t = self.batch
        asked = np.ones(len(t.texts), dtype=bool) if asked is None else asked
        notes = [Note(False, {}, {}, []) if own else None for own in asked.tolist()]
        for k in np.flatnonzero(asked & (np.bincount(t.note[t.line], minlength=len(asked)) > 0)).tolist():
            notes[k].has_token = True
        own = asked[t.note[t.line[self.first]]]
        first, size = self.first[own], self.size[own]
        k = t.note[t.line[first]]
        base = t.base[k]
        for k, at, i, n, a, b in zip(k.tolist(), (t.line_start[t.line[first]] - base).tolist(), first.tolist(), size.tolist(), (t.start[first] - base).tolist(), (t.end[first + size - 1] - base).tolist(), strict=True):
            notes[k].lines.setdefault(at, []).append((i, n, a, b))
        for i in self.shorts.tolist():
            k = int(t.note[t.line[i]])
            base = int(t.base[k])
            if asked[k]:
                notes[k].shorts.setdefault(int(t.line_start[t.line[i]]) - base, []).append((i, int(t.start[i]) - base, int(t.end[i]) - base))
        for line in self.dense.tolist():
            k = int(t.note[line])
            if asked[k]:
                notes[k].dense.append(int(t.line_start[line] - t.base[k]))
        return notes


def scan(texts: list[str], keys: KeyFilter, max_ngram: int = 8) -> list[Note]:
    """The ``Note`` of each text."""
    return scanned(texts, keys, max_ngram).notes()


def scanned(texts: list[str], keys: KeyFilter, max_ngram: int = 8) -> Scanned:
    t = Batch(texts)
    none = np.zeros(0, np.int64)
    if not len(t.start):
        return Scanned(t, none, none, none, none)
    knows = keys.knows
    w = t.classed(t.ws, t.we, knows)
    n = len(t.ws)
    # Words that repairs may change: beside their class, spelled letters and numbers before a torn unit.
    single = w["single"]
    run = single.copy()
    run[1:-1] &= single[:-2] & single[2:] if n > 2 else False
    run[[0, -1]] = False
    spelled = _near(run)
    torn = np.zeros(n, dtype=bool)
    torn[:-1] = (w["digits"][:-1] == w["size"][:-1]) & _among(w["word"][1:], "split")
    torn[1:] |= torn[:-1].copy()
    wild = w["wild"] | spelled | torn
    joins, good, short_pair, pair_word = (np.append(x, x.dtype.type(0)) for x in Batch.good_pair(w, w, knows, slice(0, -1), slice(1, None)))
    odd_pair = short_pair | (joins & _among(pair_word, "dropped"))  # what they make is replaced or left out in turn
    in_good = good.copy()
    in_good[1:] |= good[:-1]
    # A letter o by itself is a zero when repaired, which changes nothing beside it.
    nought = _fixed()["0"][0]
    able = w["known"] | _near(wild) | in_good | (w["zero"] & knows(np.array([nought])))
    alive = able | w["dropped"] | w["zero"]
    zeros = _running(w["zero"])
    dead, telling, strange = _running(~alive), _running(able), _running(wild)
    # For spans from each word on: the end of the first joined pair on the way that repairs take, and of the first that may be of a key.
    far = np.iinfo(np.int64).max
    at = np.arange(n)
    step = np.minimum(np.where(joins, at + 2, at + 1), n)
    joined_end, good_end = (np.append(np.where(x, at + 2, far), far) for x in (joins, good))
    step = np.append(step, n)
    for _ in range((max_ngram * int((t.lw - t.fw).max() + 1)).bit_length()):  # as many words as a span may have
        joined_end, good_end, step = np.minimum(joined_end, joined_end[step]), np.minimum(good_end, good_end[step]), step[step]
    names = ~w["dropped"]
    forms = {kind: (_running(kept), Sums(w["word"][kept], _Q)) for kind, kept in (("all", np.ones(n, bool)), ("names", names), ("stripped", ~w["context"]))}
    sets = np.append(np.uint64(0), np.cumsum(_sorted_mix(w["word"][names]), dtype=np.uint64))

    def matched(a: np.ndarray, b: np.ndarray, untouched: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether keys may begin with a form of the words [a, b), which no repair changes (or only into what no key holds), and whether a form may be a key."""
        begun, hit = np.zeros(len(a), dtype=bool), np.zeros(len(a), dtype=bool)
        for kind, (count, sums) in forms.items():
            x, y = count[a], count[b]
            more, one = keys.found(_mix(sums.raw(x, y)))
            begun |= more | (x == y)
            hit |= one & (y > x) & untouched if kind == "stripped" else one & (y > x)
            if kind == "names":
                begun_, hit_ = matched_sets(y - x, sets[y] - sets[x])
                begun |= begun_
                hit |= hit_
        return begun, hit

    def matched_sets(count: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``matched`` for sets of so many names."""
        begun, hit = np.zeros(len(count), dtype=bool), np.zeros(len(count), dtype=bool)
        few = np.flatnonzero((count > 0) & (count <= 3))
        begun[few], one = keys.found(_mix(total[few] + np.uint64(1)))
        hit[few] = one & (count[few] >= 2)
        return begun, hit

    # Parts of words in which tokens begin or end.
    cs, ce = np.flatnonzero(t.cut_start), np.flatnonzero(t.cut_end)
    head, tail = t.classed(t.a[cs], t.we[t.fw[cs]], knows), t.classed(t.ws[t.lw[ce]], t.b[ce], knows)
    after, before = np.minimum(t.fw[cs] + 1, n - 1), np.maximum(t.lw[ce] - 1, 0)
    head_wild = head["wild"] | (head["single"] & single[after] & single[np.minimum(after + 1, n - 1)]) | ((head["digits"] == head["size"]) & _among(w["word"][after], "split"))
    tail_wild = tail["wild"] | (tail["single"] & single[before] & single[np.maximum(before - 1, 0)])
    head_joins, head_pair, head_odd, head_word = Batch.good_pair(head, w, knows, slice(None), after)
    tail_joins, tail_pair, tail_odd, tail_word = Batch.good_pair(w, tail, knows, before)
    head_odd, tail_odd = head_odd | (head_joins & _among(head_word, "dropped")), tail_odd | (tail_joins & _among(tail_word, "dropped"))
    head_able, tail_able = head["known"] | head_pair | wild[after], tail["known"] | tail_pair | wild[before]
    goods = _running(good)
    # Words of which what comes after them may change the repaired form: what begins a span is judged up to other words.
    part = np.zeros(n, dtype=bool)
    part[t.fw[cs]] = part[t.lw[ce]] = True
    soft = good.copy()
    soft[:-1] |= wild[1:] | part[1:]

    def matched_repaired(a: np.ndarray, b: np.ndarray, h: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``matched`` for the repaired words [a, b), where repairs join neighbours or read an o as a zero and change nothing else.

        ``h`` and ``e`` are the parts in place of the first and the last word, or -1.  Words are followed from the first on, as repair does.
        """
        at = a.copy()
        begun, hit = np.zeros(len(a), dtype=bool), np.zeros(len(a), dtype=bool)
        count = {kind: np.zeros(len(a), np.int64) for kind in forms}
        total = {kind: np.zeros(len(a), np.uint64) for kind in (*forms, "set")}
        power = _power(_Q, int((b - a).max(initial=0)) + 1)
        while len(go := np.flatnonzero(at < b)):
            x, end = at[go], b[go]
            word, kept, zero, two, odd, pair = w["word"][x], {"names": names[x], "stripped": ~w["context"][x]}, w["zero"][x], joins[x], odd_pair[x], pair_word[x]
            k = np.flatnonzero((x + 2 == end) & (e[go] >= 0))  # before the part at the end
            own = e[go[k]]
            two[k], odd[k], pair[k] = tail_joins[own], tail_odd[own], tail_word[own]
            for part, own, k, joined in ((head, h[go], np.flatnonzero((x == a[go]) & (h[go] >= 0)), (head_joins, head_odd, head_word)), (tail, e[go], np.flatnonzero((x + 1 == end) & (e[go] >= 0)), None)):
                own = own[k]
                word[k], zero[k] = part["word"][own], part["zero"][own]
                kept["names"][k], kept["stripped"][k] = ~part["dropped"][own], ~part["context"][own]
                if joined:
                    two[k], odd[k], pair[k] = (j[own] for j in joined)
                    if len(last := k[(x[k] + 2 == end[k]) & (e[go[k]] >= 0)]):  # of two parts
                        two[last], _, odd[last], pair[last] = Batch.good_pair(head, tail, knows, h[go[last]], e[go[last]])
                        odd[last] |= _among(pair[last], "dropped")
            two &= x + 1 < end
            hit[go] |= two & odd
            word = np.where(two, pair, np.where(zero, nought, word))
            for kind in forms:
                own = np.flatnonzero(two | kept[kind] & ~(zero & (kind == "names"))) if kind != "all" else np.arange(len(go))
                to = go[own]
                total[kind][to] += word[own] * power[count[kind][to]]
                count[kind][to] += 1
                if kind == "names":
                    total["set"][to] += _sorted_mix(word[own])
            at[go] += 1 + two
        begun |= hit
        for kind in forms:
            more, one = keys.found(_mix(total[kind]))
            begun |= more | (count[kind] == 0)
            hit |= one & (count[kind] > 0)
        more, one = matched_sets(count["names"], total["set"])
        return begun | more, hit | one
    where_head, where_tail = np.zeros(len(t.start), np.int64), np.zeros(len(t.start), np.int64)
    where_head[cs], where_tail[ce] = np.arange(len(cs)), np.arange(len(ce))

    def cut_spans(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether longer spans from there, and whether spans of the tokens i to j, which begin or end within a word, may be found."""
        a, b = t.fw[i], t.lw[j] + 1
        on, out = np.ones(len(i), dtype=bool), np.zeros(len(i), dtype=bool)
        one = b - a == 1
        k = np.flatnonzero(one)
        part = t.classed(t.a[i[k]], t.b[j[k]], knows)
        out[k] = keys.holds(_mix(part["word"])) | part["wild"] | (part["zero"] & keys.holds(_mix(np.array([nought]))))
        k = np.flatnonzero(~one)
        i, j, a, b = i[k], j[k], a[k], b[k]
        hs, te = t.cut_start[i], t.cut_end[j]
        h, e = where_head[i], where_tail[j]
        at = lambda x, own, has: x[own] & has if len(x) else has & False
        h_wild, e_wild = at(head_wild, h, hs), at(tail_wild, e, te)
        h_able, e_able = at(head_able, h, hs), at(tail_able, e, te)
        h_zero, e_zero = at(head["zero"], h, hs), at(tail["zero"], e, te)
        h_drop, e_drop = at(head["dropped"], h, hs) | h_zero, at(tail["dropped"], e, te) | e_zero
        h_pair, e_pair = at(head_pair, h, hs), at(tail_pair, e, te)
        both = np.flatnonzero(hs & te & (b - a == 2))
        if len(both):
            pair = Batch.good_pair(head, tail, knows, h[both], e[both])[1]
            h_able[both] |= pair
            e_able[both] |= pair
            h_pair[both] |= pair
        three = np.flatnonzero(hs & te & (b - a == 3))
        if len(three):  # letters spelled over both ends
            spelt = head["single"][h[three]] & single[a[three] + 1] & tail["single"][e[three]]
            h_wild[three] |= spelt
            e_wild[three] |= spelt
        # A part that repairs change may draw on up to three words beside it.
        lo = np.minimum(a + hs + np.where(h_wild, 3, at(head_pair, h, hs)), b - te)
        hi = np.maximum(b - te - np.where(e_wild, 3, at(tail_pair, e, te)), lo)
        fine = (dead[hi] - dead[lo] == 0) & (~hs | h_able | h_drop | h_wild) & (~te | e_able | e_drop | e_wild)
        fine &= (telling[b - te] - telling[a + hs] > 0) | h_able | e_able | h_wild | e_wild | ((h_zero | e_zero) & knows(np.array([nought])))
        able = fine & (h_wild | e_wild | (strange[b - te] - strange[a + hs] > 0))
        left = np.flatnonzero(fine & ~able & (h_pair | e_pair | h_zero | e_zero | (goods[b] - goods[a] > 0) | (zeros[b] - zeros[a] > 0)))
        begun, able[left] = matched_repaired(a[left], b[left], np.where(hs, h, -1)[left], np.where(te, e, -1)[left])
        more = np.ones(len(k), dtype=bool)
        more[left] = begun
        changed = np.zeros(len(k), dtype=bool)
        changed[left] = True
        wild_ = able & ~changed
        left = np.flatnonzero(fine & ~able)  # as it is
        h, e, one, two, a, b = h[left], e[left], hs[left], te[left], a[left], b[left] - 1
        of = lambda x, own, at, has, whole: np.where(has, x[own], whole[at]) if len(x) else whole[at]
        first, last = of(head["word"], h, a, one, w["word"]), of(tail["word"], e, b, two, w["word"])
        begun, hit = np.zeros(len(left), dtype=bool), np.zeros(len(left), dtype=bool)
        for kind, (count, sums) in forms.items():
            gone = {"all": None, "names": "dropped", "stripped": "context"}[kind]
            x, y = (np.ones(len(left), bool) if gone is None else ~of(z[gone], own, at, has, w[gone]) for z, own, at, has in ((head, h, a, one), (tail, e, b, two)))
            lo, hi = count[a + 1], count[b]
            size = x + (hi - lo) + y
            power = _power(_Q, int(size.max(initial=0)) + 1)
            begun_, hit_ = keys.found(_mix(first * x + sums.raw(lo, hi) * power[x.astype(np.int64)] + last * y * power[x + (hi - lo)]))
            begun |= begun_ | (size == 0)
            hit |= hit_ & (size > 0)
            if kind == "names":
                begun_, hit_ = matched_sets(size, _sorted_mix(first) * x + sets[hi] - sets[lo] + _sorted_mix(last) * y)
                begun |= begun_
                hit |= hit_
        able[left] = hit
        more[left] = begun | (more[left] & changed[left])
        out[k] = able
        on[k] = more | ~fine | able | wild_ | te | soft[t.lw[j]]
        return on, out

    found: list[np.ndarray] = []
    total = len(t.start)
    i = np.arange(total)  # tokens from which spans may begin
    lo = t.fw + t.cut_start
    lo[cs] += np.where(head_wild, 3, head_pair)
    lo = np.minimum(lo, n)
    for size in range(1, max_ngram + 1):
        if size > total:
            break
        i = i[i + size <= total]
        i = i[t.line[i] == t.line[i + size - 1]]
        b = t.lw[i + size - 1] + 1
        i = i[dead[np.maximum(b - 4, lo[i])] - dead[lo[i]] == 0]  # the last three words may be repaired, and the last be cut
        j = i + size - 1
        cut = t.cut_start[i] | t.cut_end[j]
        a, b = t.fw[i], t.lw[j] + 1
        on = np.ones(len(i), dtype=bool)
        plain = ~cut & (dead[b] - dead[a] == 0) & (telling[b] - telling[a] > 0)
        k = np.flatnonzero(plain)
        x, y = a[k], b[k]
        hit = strange[y] - strange[x] > 0
        rest = np.flatnonzero(~hit)
        x, y = x[rest], y[rest]
        repaired = (good_end[x] <= y) | (zeros[y] - zeros[x] > 0)
        more, hit[rest] = matched(x, y, (joined_end[x] > y) & ~repaired)
        on[k[rest]] = more | soft[y - 1]
        rest, x, y = rest[repaired], x[repaired], y[repaired]
        none = np.full(len(x), -1)
        more, one = matched_repaired(x, y, none, none)
        on[k[rest]] |= more
        hit[rest] |= one
        k = k[hit]
        c = np.flatnonzero(cut)
        if len(c):
            on[c], one = cut_spans(i[c], j[c])
            c = c[one]
        own = np.sort(i[np.concatenate([k, c])])
        found.append(np.stack([t.line[own], np.full(len(own), -size), own], axis=1))
        i = i[on]
    spans = np.concatenate(found)
    spans = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))]
    # Shorthands, also torn or spelled ones, and the lines that hold any or a name of the dense list.
    short = _running(_among(w["word"], "short") | spelled | short_pair | np.append(False, short_pair[:-1]))
    cuts = t.cut_start | t.cut_end
    shorts = np.flatnonzero((short[t.lw + 1] - short[t.fw] > 0) | (cuts & (t.lw > t.fw)))
    hit = np.zeros(len(t.line_start), dtype=bool)
    word_line = np.searchsorted(t.line_start, np.searchsorted(t.place, t.ws, side="right") - 1, side="right") - 1
    hit[word_line[np.flatnonzero(np.diff(short))]] = True
    dense = np.flatnonzero(t.stream != 0)
    squeezed = t.stream[dense].tobytes()
    for term in lx.DENSE_LINE_TERMS:
        at, sought = -1, "".join(c for c in term if c.isalnum()).encode()
        while (at := squeezed.find(sought, at + 1)) >= 0:
            hit[np.searchsorted(t.line_start, np.searchsorted(t.place, dense[[at, at + len(sought) - 1]], side="right") - 1, side="right") - 1] = True
    return Scanned(t, spans[:, 2], -spans[:, 1], shorts, np.flatnonzero(hit))


def batches(texts: pa.Array, chars: int = BATCH_CHARS):
    """Yield lists of (row, text) of about ``chars`` characters; null texts are left out."""
    held, size = [], 0
    for at in range(0, len(texts), 64):
        for row, text in enumerate(texts.slice(at, 64).to_pylist(), at):
            if text is None:
                continue
            held.append((row, text))
            size += len(text)
            if size >= chars:
                yield held
                held, size = [], 0
    if held:
        yield held
