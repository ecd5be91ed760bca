"""Plain Python versions of run detection, conversation repair and quality rules."""

import hashlib
import math
import zlib
from collections import Counter

from brute import SPLIT, FOLD


def runs(w, least=12):
    """[(start, length, period)] of a word list"""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plant(doc_id, text):
    w = SPLIT.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def periodic(doc_id, text):
    w = plant(doc_id, text)
    found = runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    return (len(found), *best, 1000 * best[1] // best[2] if found else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of one conversation's
    [(turn, role, text)]"""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows),
                  key=lambda m: (m[0] is not None, m[0] or 0, m[1].encode(), m[2].encode()))
    seen, fault = set(), []
    for _, r, x in rows:
        body = "".join(SPLIT.findall(x))
        fault.append(1 if not body else 2 if (r, x) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((r, x))
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    big = (10**9, "")
    best = {"": (0, ""), "s": big, "u": big, "a": (0, "")}

    def inserted(v):
        for _ in range(3):
            v = {s: min([v[s], *((v[t][0] + 3, "I" + v[t][1]) for (a, r), t in after.items() if a == s and r != "s")]) for s in v}
        return v

    tables = [inserted(best)]
    for (_, r, _), f in zip(reversed(rows), reversed(fault)):
        nxt, cut, v = tables[-1], 3 * (f == 3), {}
        for s in nxt:
            options = [(nxt[s][0] + 4, "D" + nxt[s][1])]
            if f not in (1, 2):
                if (s, r[:1]) in after:
                    t = after[s, r[:1]]
                    options.append((nxt[t][0] + cut, "K" + nxt[t][1]))
                for role in "ua":
                    if (s, role) in after:
                        t = after[s, role]
                        options.append((nxt[t][0] + 3 + cut, "R" + nxt[t][1]))
            v[s] = min(options)
        tables.append(inserted(v))
    cost, audit = tables[-1][""]
    total, j, i, lines = sum(x != "D" for x in audit), 0, 0, []
    for x in audit:
        if x != "D":
            j += 1
            role = "user" if (j + total) % 2 else "assistant"
            lines.append(":".join((rows[i][1] if x == "K" else role, "" if x == "I" else rows[i][2])))
        i += x != "I"
    turns = [t for t, *_ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(fault.count(k) for k in (1, 2, 3)),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damage(rows):
    """[(conv, turn, role, text)] after the damage of the registered query"""
    out = []
    for c, t, r, x in rows:
        r, x = r if r is not None else " ", x if x is not None else " "
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if h == 1:
            x = ""
        if h == 2:
            x = x.translate({ord(k): None for k in ".!?"})
        out += [(c, t, "user" if h == 4 else r, x)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def base(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    w = SPLIT.findall(text)
    lines, seen = 0, set()
    for line in text.split("\n"):
        if SPLIT.search(line):
            lines += line in seen
            seen.add(line)
    n = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {i + j for i in range(len(w) - 2) if n[tuple(w[i:i + 3])] > 1 for j in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), lines, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))


def kind(c):
    o = ord(c)
    if o < 0x80:
        return (0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 4 if c in "#*$%&|<>" else
                5 if o < 0x20 or o == 0x7F else 3)
    return 6 if o < 0x300 else 7 if o < 0x2000 else 9 if o < 0x3000 else 8 if o < 0xE000 else 9


def divergence(p, q):
    p, q = [x / max(1, sum(p)) for x in p], [x / max(1, sum(q)) for x in q]
    half = lambda a: sum(x * math.log2(2 * x / (x + y)) for x, y in a if x)
    return (half(zip(p, q)) + half(zip(q, p))) / 2


def quality(docs):
    """[(doc_id, *base, kept)] of [(doc_id, text, lang)]"""
    seen = [(i, base(t), l, Counter(w.translate(FOLD) for w in SPLIT.findall(t or "")), [0] * 10) for i, t, l in docs]
    for (_, t, _), s in zip(docs, seen):
        for w in SPLIT.findall(t or ""):
            for c in w:
                s[4][kind(c)] += 1
    refs = {}
    for lang in {s[2] for s in seen} | {None}:
        mine = [s for s in seen if not s[1][5] and (lang is None or s[2] == lang)]
        n, has = Counter(), Counter()
        for s in mine:
            n.update(s[3])
            has.update(set(s[3]))
        order = sorted(has, key=lambda w: -has[w])
        top = [w for w in order[:64] if has[w] > (has[order[64]] if len(order) > 64 else 0)]
        if lang is None or sum(n.values()) >= 2000:
            refs[lang] = [sum(s[4][k] for s in mine) for k in range(10)], top, n
    out = []
    for i, b, lang, tf, chars in seen:
        own = lang is not None and lang in refs
        classes, top, n = refs[lang if own else None]
        bad = b[1] >= 200 and sum(classes) and divergence(chars, classes) > 0.25**2 + 9 / (8 * math.log(2) * b[1])
        if own and b[0] >= 50:
            p, q = [tf[w] for w in top], [n[w] for w in top]
            p.append(b[0] - sum(p))
            q.append(sum(n.values()) - sum(q))
            bad = bad or divergence(p, q) > 0.3**2 + len(top) / (8 * math.log(2) * b[0])
        out.append((i, *b, not b[5] and not bad))
    return out
