"""Plain Python for what the operators compute, written from their rules."""

import re

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LETTER = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def quality_counts(t):
    t = t or ""
    w = SPACE.findall(t)
    grams = {}
    for k in range(len(w) - 2):
        grams.setdefault(tuple(w[k : k + 3]), []).append(k)
    hit = {k + d for at in grams.values() if len(at) > 1 for k in at for d in range(3)}
    lines = [x for x in t.split("\n") if SPACE.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit), "base_failed": len(w) < 50 or 100 * len(hit) > 50 * len(w)}


def bucket(v):
    low = max(v.bit_length() - 6, 0)
    return v >> low << low


def quality_verdicts(found):
    """kept of every (group, counts)."""
    metrics = [{"len": 100 * c["word_chars"] // max(c["n_words"], 1), "sym": 1000 * c["n_symbols"] // max(c["n_words"], 1), "dup": 1000 * c["n_dup_lines"] // max(c["n_lines"], 1)} for _, c in found]
    ranges = {}
    for group in {g for g, _ in found}:
        for k in ("len", "sym", "dup"):
            own = sorted(bucket(m[k]) for (g, c), m in zip(found, metrics, strict=True) if g == group and c["n_words"] >= 50)
            if own:
                q1, q2, q3 = (own[-(-len(own) * j // 4) - 1] for j in (1, 2, 3))
                wide = 3 * max(q3 - q1, {"len": q2 // 8, "sym": 50, "dup": 100}[k])
                ranges[group, k] = q1 - wide, q3 + wide
    return [not c["base_failed"] and all(ranges[g, k][0] <= v <= ranges[g, k][1] for k, v in m.items()) for (g, c), m in zip(found, metrics, strict=True)]


def line_dedup(rows):
    """Brute force: the texts of (doc_id, text) rows without the lines that recur."""
    lines = {}
    for i, t in dict.fromkeys(rows):
        for k, raw in enumerate(t.split("\n") if t is not None else []):
            f = tuple(re.sub(r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", "<*>", raw).split(" "))
            if len(f) >= 5 or re.search(r"[A-Za-z]|[^\x00-\x7F]", raw):
                lines[(i, t, k)] = f if len(f) >= 5 else raw
    nodes, template = {}, {}
    for f in set(lines.values()):
        if isinstance(f, tuple):
            nodes.setdefault((len(f), *f[:2]), []).append(f)
    for again in range(3):
        below = {}
        for node, own in nodes.items():
            if len(own) < 2:
                continue
            n = node[0]
            const = {p: x for p in range(n) for x in {f[p] for f in own} if 2 * sum(f[p] == x for f in own) > len(own)}
            split = min((len({f[p] for f in own}), p) for p in range(n) if len({f[p] for f in own}) > 1)[1]
            for f in own:
                if 10 * len(const) < 7 * n:
                    below.setdefault((*node, split, f[split]), []).append(f)
                elif all(f[p] == x for p, x in const.items()):
                    template[f] = (again, node)
                else:
                    below.setdefault(node, []).append(f)
        nodes = below
    seen, gone = {}, set()
    for at, f in lines.items():
        seen.setdefault(template.get(f, f), []).append(at)
    for key, at in seen.items():
        short = isinstance(key, str) and len(key.encode()) < 40
        if len({x[:2] for x in at}) >= (max(10, -(-len(rows) // 1000)) if short else 2):
            first = min(at, key=lambda x: (x[0] is not None, x[0] or 0, x[2]))
            gone |= {x for x in at if x != first}
    return [(i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, t, k) not in gone)) for i, t in rows], len(gone)


def components(texts, k=5, percent=80):
    """For every text the place of the first one that it is linked with, itself included; its own where it has no words."""
    sets = []
    for t in texts:
        w = SPACE.findall(low(t))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    top = list(range(len(texts)))

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return [find(a) for a in range(len(texts))], sets


def contaminated(texts, items):
    """Whether each text holds a window of an item."""
    windows = {}
    for t in items:
        w = LETTER.findall(low(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(n, set()).add(tuple(w[k : k + n]))
    out = []
    for t in texts:
        w = LETTER.findall(low(t))
        out.append(any(tuple(w[k : k + n]) in own for n, own in windows.items() for k in range(len(w) - n + 1)))
    return out
