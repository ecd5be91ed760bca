"""Plain Python versions of the operators, for small tables."""

import re

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=4):
    w = SPLIT.findall((text or "").translate(FOLD))
    if not w:
        return set()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))}


def component_of(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(docs):
    """docs: {id: text} -> {id: (n, component, kept)}"""
    sets = {i: shingles(t) for i, t in docs.items()}
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    seen = {}
    for ids in by.values():
        for n, a in enumerate(ids):
            for b in ids[n + 1:]:
                seen[a, b] = seen.get((a, b), 0) + 1
    links = [(a, b) for (a, b), n in seen.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    c = component_of(docs, links)
    return {i: (len(sets[i]), c[i], c[i] == i) for i in docs}


def decontaminate(docs, items, width=13):
    """{doc_id: (n_words, n_hit, items, contaminated)} of {doc_id: text} and {item_id: text}"""
    by = {}
    for i, t in items.items():
        w = PLAIN.findall((t or "").translate(FOLD))
        n = min(width, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            by.setdefault(tuple(w[s:s + n]), set()).add(str(i))
    sizes = {len(k) for k in by}
    out = {}
    for d, t in docs.items():
        w = PLAIN.findall((t or "").translate(FOLD))
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                got = by.get(tuple(w[s:s + n]))
                if got:
                    found |= got
                    hit |= set(range(s, s + n))
        out[d] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


def passages(docs, k=13):
    """[(doc_id, n_words, n_removed, kept)] of [(doc_id, text)]; None counts as the largest id"""
    big = float("inf")
    first, rows = {}, []
    for d, t in docs:
        w = SPLIT.findall(t or "")
        rows.append((d, w))
        for s in range(len(w) - k + 1):
            key = tuple(w[s:s + k])
            first[key] = min(first.get(key, big), big if d is None else d)
    out = []
    for d, w in rows:
        gone = set()
        for s in range(len(w) - k + 1):
            if first[tuple(w[s:s + k])] < (big if d is None else d):
                gone |= set(range(s, s + k))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def vectors(rows, least=0.98):
    """{vec_id: (n_links, component, kept)} of [(vec_id, vector, label)]"""
    import math

    good = {}
    for i, v, y in rows:
        if v and y is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = ([float(x) for x in v], y)
    links = []
    ids = sorted(good)
    for n, a in enumerate(ids):
        va, ya = good[a]
        for b in ids[n + 1:]:
            vb, yb = good[b]
            if ya == yb and len(va) == len(vb):
                dot = sum(x * y for x, y in zip(va, vb))
                if dot / math.sqrt(sum(x * x for x in va) * sum(x * x for x in vb)) >= least:
                    links.append((a, b))
    c = component_of([r[0] for r in rows], links)
    n = {r[0]: 0 for r in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], c[i], c[i] == i) for i in n}


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """{source: target} of {source: words}, the excess reshared round by round"""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = {}, share * sum(sizes.values())
    open_ = set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not over:
            return full | {s: level * weight[s] for s in open_}
        for s in over:
            full[s] = cap * sizes[s]
            left -= full[s]
        open_ -= over
    return full


def other_answers(table):
    """{(pair, part, turn, segment): n} of conversations [(conv_id, turn, role, text)]"""
    rows = [(c, t, role or "user", text or "") for c, t, role, text in table if c is not None and t is not None]
    last = {}
    for c, t, role, _ in rows:
        if role == "assistant":
            last[c] = max(t, last.get(c, t))
    answer = {c: min(x for d, u, role, x in rows if d == c and u == t and role == "assistant") for c, t in last.items()}
    ids = sorted(last)
    pairs = [(c, "chosen", t, role, x) for c, t, role, x in rows if c in last and t <= last[c]]
    pairs += [(c, "rejected", t, role, x) for c, t, role, x in rows if c in last and t < last[c]]
    pairs += [(c, "rejected", last[c], "assistant", answer[ids[(k + 1) % len(ids)]]) for k, c in enumerate(ids)]
    clean = lambda s: s.replace("<|im_", "< |im_")
    return {(p, part, t, f"<|im_start|>{clean(role)}\n{clean(x)}<|im_end|>\n"): n
            for (p, part, t, role, x), n in preference(pairs).items()}


def preference(rows):
    """{(pair, part, turn, role, text): n} of [(pair, side, turn, role, text)]"""
    from collections import Counter

    out = Counter()
    for pair in {r[0] for r in rows if r[0] is not None}:
        side = {s: [r for r in rows if r[0] == pair and r[1] == s] for s in ("chosen", "rejected")}
        if not side["chosen"] or not side["rejected"]:
            continue
        at = {s: {} for s in side}
        for s, mine in side.items():
            for _, _, turn, role, text in mine:
                at[s].setdefault(turn, Counter())[role or "user", text or ""] += 1
        turns = sorted({t for s in at for t in at[s] if t is not None})
        split = next((t for t in turns if at["chosen"].get(t) != at["rejected"].get(t)), float("inf"))
        for s in at:
            for t, messages in at[s].items():
                for (role, text), n in messages.items():
                    if t is not None and t < split:
                        out[pair, "prompt", t, role, text] = n
                    else:
                        out[pair, s, t, role, text] = n
    return out
