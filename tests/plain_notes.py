"""A plain detector, note by note, from the stated rules: every span of every line is looked up, nothing is skipped.  It shares only the
fixed word lists and the plain twins of normalisation with the engine."""

from __future__ import annotations

import re

from medspan.functions import lexicon as lx
from medspan.functions.textnorm import noisy_py, normalize_py

DROPPED = {*lx.CONTEXT_WORDS, *lx.STRENGTH_UNITS}


def strip(norm):
    return " ".join(w for w in norm.split() if w not in lx.CONTEXT_WORDS)


def keys_of(span):
    first = []
    for key, label in ((normalize_py(span), "surface_norm"), (noisy_py(span), "noisy_norm"), (strip(noisy_py(span)), "stripped_noisy_norm")):
        if key and key not in [k for k, _ in first]:
            first.append((key, label))
    out = list(first)
    for key, label in first:
        names = [w for w in key.split() if re.search("[a-z]", w) and w not in DROPPED]
        forms = [(" ".join(names), "alpha_only")] if names else []
        forms += [(" ".join(sorted(names)), "alpha_sorted")] if len(names) in (2, 3) else []
        out += [(k, f"{label}:{form}") for i, (k, form) in enumerate(forms) if k not in [x for x, _ in out] + [x for x, _ in forms[:i]]]
    return out


def rows_of(table, key, most):
    """The first rows of a key; none for terms that name no drug, or if every kept row's type is no drug's."""
    rows = [] if not key or key in lx.NON_DRUG_TERMS else table.get(key, [])[:most]
    return [] if {t for _, t in rows} <= set(lx.NON_DRUG_TYPES) else rows


def bounds(text, start, end):
    """The line or lines that a span lies in."""
    lo = max((i + 1 for i, c in enumerate(text[:start]) if c == "\n"), default=0)
    hi = next((i for i in range(end, len(text)) if text[i] == "\n"), len(text))
    return lo, hi


def mention(text, start, end, norm, rows, method, label, whole=False):
    return {"text": text[start:end], "norm": norm, "start": start, "end": end, "ids": [r[0] for r in rows], "types": sorted({r[1] for r in rows}), "method": method, "source": label, "whole": whole}


def spans_of_line(text, lo, hi, table, longest, most):
    tokens = [(lo + m.start(), lo + m.end()) for m in re.finditer(lx.TOKEN, text[lo:hi])]
    hits = []
    for i in range(len(tokens)):
        for j in range(i, min(i + longest, len(tokens))):
            a, b = tokens[i][0], tokens[j][1]
            span = text[a:b]
            if j > i and "," in span and not any(x in span.lower() for x in (" and ", " with ", "/", "+")):
                continue
            if not normalize_py(span) or normalize_py(span) in lx.NON_DRUG_TERMS:
                continue
            known = next(((k, s, rows_of(table, k, most)) for k, s in keys_of(span) if rows_of(table, k, most)), None)
            if known:
                hits.append((-(j - i), i, j, a, b, *known))
    used, out = set(), []
    for _, i, j, a, b, key, label, rows in sorted(hits, key=lambda h: h[:2]):
        if not used & {*range(i, j + 1)}:
            used |= {*range(i, j + 1)}
            out.append(mention(text, a, b, key, rows, "exact_alias_span", label))
    return out


def dense_of_line(text, lo, hi, table, most):
    line = text[lo:hi]
    own, parts = line.strip(), line.split()
    terms = sorted(lx.DENSE_LINE_TERMS, key=lambda t: (-len(t), t))
    pattern = "|".join(terms)
    crowded = len(parts) <= 4 or sum(1 for p in parts if re.search(r"[A-Za-z]", p) and re.search(r"[0-9]", p)) > 1 or sum(1 for p in parts if len(p) > 11) > 2
    if len(own) < 70 or len(noisy_py(own)) < 50 or len(re.findall(pattern, noisy_py(own))) < 2 or not crowded:
        return []
    low = line.translate(str.maketrans(lx.CONFUSABLE_FROM, lx.CONFUSABLE_TO)).lower()
    at = [m.span() for m in re.finditer(pattern, low)]
    out = []
    for k, (a, b) in enumerate(at):
        segment = line[a : at[k + 1][0] if k + 1 < len(at) else len(line)].strip(" ,;")
        if len(segment) < 3:
            continue
        core, rest = noisy_py(lx.DENSE_LINE_TERMS.get(low[a:b], low[a:b])), noisy_py(segment)
        key, label = (core, "dense_core_norm") if rows_of(table, core, most) else (strip(rest), "dense_segment_norm")
        out.append(mention(text, lo + a, lo + a + len(segment), rest or core, rows_of(table, key, most), "dense_line_scan", label, True))
    return out


def shown(text, m):
    lo, hi = bounds(text, m["start"], m["end"])
    line = text[lo:hi]
    if m["whole"] or not line.strip():
        return m["text"].strip()
    left = re.search(r"[^.;:!?,]*\Z", line[: m["start"] - lo], re.DOTALL)[0]
    right = re.match(r"[^.;:!?,]*", line[m["end"] - lo :], re.DOTALL)[0]
    return (left + m["text"] + right).strip() if not re.search(r"[.;:!?,]", m["text"]) else None


def detected(text, table, longest=8, most=25):
    if not re.search("[A-Za-z0-9]", text):
        return [mention(text.strip(), 0, len(text.strip()), normalize_py(text), [], "unknown", "")] if text.strip() else []
    found, at = [], 0
    dense = []
    for line in text.split("\n"):
        own = spans_of_line(text, at, at + len(line), table, longest, most)
        dense += dense_of_line(text, at, at + len(line), table, most) if len(own) < 2 else []
        found += own
        at += len(line) + 1
    spans = [(m["start"], m["end"]) for m in found]
    for m in dense:
        if (m["start"], m["end"]) not in spans:
            spans.append((m["start"], m["end"]))
            found.append(m)
    lines = [bounds(text, m["start"], m["end"]) for m in found]
    wrapped = [m["start"] > 0 and m["end"] < len(text) and text[m["start"] - 1] in "([" and text[m["end"]] in ")]" for m in found]
    kept = [m for m, line, w in zip(found, lines, wrapped, strict=True) if not (w and lines.count(line) > 1)]
    if found:
        return sorted(kept, key=lambda m: m["start"])
    chunks = [(m.start() + len(m[0]) - len(m[0].lstrip()), m[0].strip()) for m in re.finditer(r"[^;\n]+", text) if m[0].strip()]
    if len(chunks) < 2:
        return [mention(text, 0, len(text.strip()), normalize_py(text), [], "fallback_whole_text", "fallback_whole_text") | {"text": text.strip()}]
    return [mention(text, a, a + len(c), normalize_py(c), [], "fallback_chunk", "fallback_chunk") for a, c in chunks]
