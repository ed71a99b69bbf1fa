"""The contracts written out plainly, a document at a time."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


def repeated_bytes(rows, length):
    """doc -> (n_bytes, n_removed, n_spans, sha): bytes under strings that start at two places or more."""
    raw = [(k, (t or "").encode()) for k, t in rows]
    count = Counter(b[s : s + length] for _, b in raw for s in range(len(b) - length + 1))
    out = []
    for k, b in raw:
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                gone[s : s + length] = [True] * length
        out.append((k, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def repeated_words(rows, window):
    seen, out = set(), []
    for k, t in sorted(rows):
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            run = tuple(w[s : s + window])
            if run in seen:
                gone[s : s + window] = [True] * window
            seen.add(run)
        out.append((k, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def base_quality(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    repeat = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(3)}
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeat), n < 50 or 100 * len(repeat) > 50 * n)


def sets(rows, width):
    out = {}
    for k, t in rows:
        w = words((t or "").translate(LOWER))
        out[k] = frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    return out


def components(rows, width, percent):
    s = sets(rows, width)
    up = {k: k for k in s}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    keys = sorted(s)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(s[a] & s[b])
            if s[a] and s[b] and 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {k: (len(s[k]), root(k)) for k in keys}


def contamination(text, items, width):
    w = ALNUM.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, t in items:
        x = ALNUM.findall((t or "").translate(LOWER))
        n = min(width, len(x))
        windows = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if x else set()
        for i in range(len(w) - n + 1) if x else ():
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_pii(text):
    text = text or ""
    only = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(only(s)) <= 19 and luhn(only(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(only(s)) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, text) if ok(m[0])]


def corpus(seed=1, n=60, vocabulary=400):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéstz") for _ in range(rng.randint(1, 9)))
    known = [word() for _ in range(vocabulary)]
    line = lambda k: " ".join(rng.choice(known) for _ in range(k))
    shared = [line(70), line(33), line(25)]
    texts = [line(rng.randint(1, 200)) for _ in range(n)]
    for i in range(0, n, 4):
        w = texts[i].split()
        w.insert(rng.randrange(len(w) + 1), rng.choice(shared))
        texts[i] = " ".join(w)
    texts += [texts[3]] * 5 + [texts[4].upper(), texts[5].replace(" ", "\n")]
    near = line(150).split()
    for _ in range(12):
        w = list(near)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [None, "", "   \n\t ", "one", "one", "two words", "a b c", "a  b\tc", "aaaa " * 300, "ab" * 900, "x" * 500, line(30000), shared[0], "𝒳 😀 " * 60, "zero\x00byte " * 40]
    return texts
