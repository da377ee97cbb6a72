"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def decontamination(docs, bench):
    windows, out = defaultdict(set), {}
    for i, t in bench:
        w = ITEM_WORD.findall((t or "").translate(LOW))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(str(i))
    for i, t in docs:
        w, hit, items = ITEM_WORD.findall((t or "").translate(LOW)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    items |= x
                    hit.update(range(k, k + n))
        out[i] = (len(w), len(hit), len(items), sha(",".join(sorted(items))), 0 < len(hit) and 20 * len(hit) >= len(w))
    return out


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(zip(*[w[j:] for j in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard(docs):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeats(docs, n):
    first, words = {}, {i: WORD.findall(t or "") for i, t in docs}
    for i in sorted(words):
        for k in range(len(words[i]) - n + 1):
            first.setdefault(tuple(words[i][k : k + n]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def gone_lines(docs, percent=80):
    sets, first, gone = [], {}, set()
    for i, t in sorted(docs, key=lambda x: x[0]):
        for k, line in enumerate(t.split("\n") if t is not None else []):
            if x := frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w):
                sets.append((i, k, x))
                first.setdefault(x, (i, k))
    order, holders = list(first), defaultdict(list)
    for j, x in enumerate(order):
        common = Counter(b for w in x for b in holders[w])
        if any(100 * v >= percent * (len(x) + len(order[b]) - v) for b, v in common.items()):
            gone.add(x)
        for w in x:
            holders[w].append(j)
    out = {i: set() for i, _ in docs}
    for i, k, x in sets:
        if x in gone or first[x] < (i, k):
            out[i].add(k)
    return out


def lines(docs, percent=80):
    out = gone_lines(docs, percent)
    return {i: (len(t.split("\n")) if t is not None else 0, len(out[i]), sha("\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in out[i]))) for i, t in docs}


def packed(rows, capacity):
    """Sequences are gapless from 0 and hold no more than the capacity; pieces of a document follow each other."""
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= capacity
    return len(sequences), pieces


def chat(rows):
    groups, out = defaultdict(list), {}
    for c, t, r, x in rows:
        groups[c].append((-(2**60) if t is None else t, r or "", x or ""))
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    return out


def top_k(rows, k=5):
    import math

    v = {i: tuple(math.floor(256 * float(x)) for x in e) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for q in v:
        if q % 50 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), c) for c in v if c != q and len(v[c]) == len(v[q])))[:k]
            out += [(q, r, c, -s) for r, (s, c) in enumerate(scores, 1)]
    return sorted(out)
