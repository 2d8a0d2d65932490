"""Plain Python versions of operators, for small fixtures."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import regex

SPACE = "[\x20\x09-\x0d]"
WORD = "[^\x20\x09-\x0d]+"


def luhn(d: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(d)):
        x = int(ch) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the contract's plain patterns."""
    found = []
    only = lambda s: re.sub("[^0-9]", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 12 <= len(only(m[0])) <= 19 and luhn(only(m[0])):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(only(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def normalised(text: str | None) -> str:
    return re.sub(SPACE + "+", " ", text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def crc_mod(doc_id, mod: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % mod


def shingles(text: str | None, n: int = 3) -> set[tuple[bytes, ...]]:
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))}


def closure(ids, links) -> dict:
    """id -> least id that links lead to."""
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {i: top(i) for i in ids}


def jaccard_components(docs: list[tuple[int, str | None]], n: int = 3, percent: int = 90) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t, n) for i, t in docs}
    links = []
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    roots = closure(ids, links)
    return {i: (len(sets[i]), roots[i]) for i in ids}


def by_id(i):
    return (i is None, i or 0)


def first_copies(rows: list[tuple]) -> list[tuple]:
    """(id, normalised text) of one row of each text, that of the least id, null last."""
    first = {}
    for i, t in rows:
        t = normalised(t)
        first[t] = min(first.get(t, i), i, key=by_id)
    return sorted(((i, t) for t, i in first.items()), key=repr)


def first_of_groups(rows: list[tuple], n: int, percent: int) -> list[tuple]:
    """(id, text) of one row of each group of similar texts, that of the least id, null last, and of all rows without words."""
    roots = jaccard_components([(k, t) for k, (_, t) in enumerate(rows)], n, percent)
    groups: dict = {}
    for k, (size, root) in roots.items():
        groups.setdefault(root if size else -1 - k, []).append(rows[k])
    return sorted((min(g, key=lambda r: by_id(r[0])) for g in groups.values()), key=repr)


TERM = regex.compile(r"\p{L}[\p{L}\p{N}]*")


def masked(text: str, spans) -> str:
    chars = list(text)
    for a, _, b in spans:
        chars[a:b] = "." * (b - a)
    return "".join(chars)


def pii_classes(kind: int, value: str) -> tuple[str, str, str]:
    value, number = value.lower(), re.sub("[^0-9]", "", value)
    group = [value.split("@")[-1], ".".join(value.split(".")[:2]), number[:6], number[:4]][kind]
    return str(kind), f"{kind}|{group}", f"{kind}:{value if kind <= 1 else number}"


def disclosing(texts: list, threshold: float) -> dict:
    """(class, term) -> disclosure, counted plainly."""
    word = regex.compile(r"[\p{L}\p{N}]+")
    n_term, n_class, met, meetings = {}, {}, {}, 0
    for text in texts:
        text = text or ""
        for t in {t.lower() for t in TERM.findall(text)}:
            n_term[t] = n_term.get(t, 0) + 1
        spans = base_spans(text)
        hidden, firsts = masked(text, spans), {}
        for a, k, b in spans:
            for c in pii_classes(k, text[a:b]):
                firsts.setdefault(c, (tuple(word.findall(hidden[:a])[-4:]), tuple(word.findall(hidden[b:])[:4])))
        terms = {t.lower() for t in TERM.findall(hidden)} if spans else set()
        meetings += len(terms) * len(firsts)
        for c, context in firsts.items():
            n_class[c] = n_class.get(c, 0) + 1
            for t in terms:
                met.setdefault((c, t), []).append(context)
    out = {}
    for (c, t), contexts in met.items():
        times = [contexts.count(x) for x in set(contexts)]
        n_met = sum(times) ** 2 / sum(k * k for k in times)
        n = max(n_term.get(t, 0), n_met)
        p, q = n_met / n, n_class[c] / len(texts)
        if q < p:
            evidence = n * (p * math.log2(p / q) + ((1 - p) * math.log2((1 - p) / (1 - q)) if p < 1 else 0))
            disclosure = math.log2(p / q) / math.log2(1 / q)
            if evidence > math.log2(max(2, meetings)) and disclosure >= threshold:
                out[c, t] = disclosure
    return out


def all_spans(text: str, marked: dict) -> list[tuple[int, int, int]]:
    spans = base_spans(text)
    classes = {c for a, k, b in spans for c in pii_classes(k, text[a:b])}
    terms = {t for c, t in marked if c in classes}
    return sorted(spans + [(m.start(), 4, m.end()) for m in TERM.finditer(masked(text, spans)) if m[0].lower() in terms])
