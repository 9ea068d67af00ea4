"""Plain versions of the contracts, for small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def contamination(texts, items, width=13):
    windows = defaultdict(set)
    for item, body in items:
        w = words(body)
        for i in range(max(1, len(w) - width + 1)) if w else ():
            windows[tuple(w[i : i + width])].add(item)
    sizes = {len(w) for w in windows}
    for text in texts:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                part = windows.get(tuple(w[i : i + n]))
                if part:
                    hit |= set(range(i, i + n))
                    found |= part
        ids = sorted(str(x) for x in found if x is not None)
        yield len(w), len(hit), len(ids), sha(",".join(ids)), len(hit) > 0 and 20 * len(hit) >= len(w)


def near_passages(text, items, width=13, slop=3, share=0.8):
    """{(item, start)}: every start tried, runs of starts up to slop apart merged, those with an exact one left out."""
    w, result = words(text), set()
    for item, body in items:
        b = words(body)
        for i in range(max(1, len(b) - width + 1)) if len(b) > 1 else ():
            part, starts = b[i : i + width], []
            for s in range(-width - slop, len(w) + slop):
                n = sum(t in w[max(s + k - slop, 0) : max(s + k + slop + 1, 0)] for k, t in enumerate(part))
                if n >= share * len(part) - 1e-9:
                    starts.append((s, n, s >= 0 and w[s : s + len(part)] == part))
            runs = []
            for x in starts:
                if runs and x[0] - runs[-1][-1][0] <= slop:
                    runs[-1].append(x)
                else:
                    runs.append([x])
            for run in runs:
                if not any(x[2] for x in run):
                    best = max(run, key=lambda x: (x[1], -x[0]))[0]
                    result.add((None if item is None else str(item), min(max(best, 0), len(w) - 1)))
    return result


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def jaccard_components(rows, percent=90):
    """{doc_id: (n, component)} by comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    for i, s in sets.items():
        common = defaultdict(int)
        for g in s:
            for j in by[g]:
                if j < i:
                    common[j] += 1
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    odd = [int(c) for c in digits[::-1][::2]]
    even = [sum(divmod(2 * int(c), 10)) for c in digits[::-1][1::2]]
    return (sum(odd) + sum(even)) % 10 == 0


def personal(text):
    """Counts and the digest of base spans."""
    found = []
    for k, (kind, pattern) in enumerate((("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))):
        for m in pattern.finditer(text or ""):
            digits = re.sub(r"[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), k, m.end(), kind))
    found.sort()
    counts = [sum(f[1] == k for f in found) for k in range(4)]
    return (*counts, sha(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found)))


def licence(text):
    w, phrases = words(text), {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    places = [(i, label) for label, p in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def crc(ids):
    import numpy as np

    return zlib.crc32(np.array(ids, "<u4").tobytes())


SPACE = " \t\n\x0b\x0c\r"


def duplicates(rows):
    """[(doc_id, keep_id, group_size, kept, sha)] of (doc_id, text) rows."""
    groups = defaultdict(list)
    for place, (i, text) in enumerate(rows):
        body = text or ""
        groups["".join(c for c in body if c not in SPACE)].append((-len(body), i is None, i or 0, place))
    out = []
    for body, members in groups.items():
        best = min(members)
        for m in members:
            out.append((rows[m[3]][0], rows[best[3]][0], len(members), m == best, sha(body)))
    return out


def aligned(text, a, b, a_bytes, b_bytes):
    """((n_a, n_b, n_groups, n_links, sha), {(A id, B id): links}) from whole texts."""
    nothing = (0, 0, 0, 0, ""), {}
    if not text:
        return nothing
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    whole = (" " + text).encode()
    if any(b"".join(t[i] for i in ids) != whole for t, ids in ((a_bytes, ids_a), (b_bytes, ids_b))):
        return nothing

    def ends(table, ids):
        at, out = 0, []
        for i in ids:
            at += len(table[i])
            out.append(at)
        return out

    ends_a, ends_b = ends(a_bytes, ids_a), ends(b_bytes, ids_b)
    written, links, i, j = [], defaultdict(int), 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        i2, j2 = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
        written.append(",".join(map(str, ids_a[i:i2])) + "|" + ",".join(map(str, ids_b[j:j2])))
        for x in ids_a[i:i2]:
            for y in ids_b[j:j2]:
                links[x, y] += 1
        i, j = i2, j2
    return (len(ids_a), len(ids_b), len(written), sum(links.values()), sha(";".join(written))), dict(links)


def cheapest_edits(rows):
    """(cost, audit) of (initial, must be deleted, truncated) rows: the best prefix for every place, row by row."""
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    keeps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def with_inserts(best):
        for _ in range(6):
            for place, (cost, audit) in list(best.items()):
                new = (cost + 3, audit + "I")
                best[after[place]] = min(new, best.get(after[place], new))
        return best

    best = with_inserts({0: (0, "")})
    for initial, must, truncated in rows:
        steps = defaultdict(list)
        for place, (cost, audit) in best.items():
            steps[place].append((cost + 4, audit + "D"))
            if not must:
                steps[after[place]].append((cost + 3 + 3 * truncated, audit + "R"))
                if (place, initial) in keeps:
                    steps[keeps[place, initial]].append((cost + 3 * truncated, audit + "K"))
        best = with_inserts({place: min(found) for place, found in steps.items()})
    return min(best[p] for p in (0, 3) if p in best)


def damage(rows):
    """{conv_id: [(turn, role, text)]} of (conv_id, turn, role, text) rows, as the contract damages them."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        lot = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        role = "user" if lot == 4 else role
        out[conv] += [(turn, role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    return out


def repaired(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of (turn, role, text) rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        end = text.rstrip(SPACE)[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
    cost, audit = cheapest_edits([(c, f in ("blank", "duplicate"), f == "truncated") for c, f in zip(initials, faults)])
    lines, place, i = [], "", 0
    for letter in audit:
        if letter == "I" or letter == "R":
            place = "a" if place == "u" else "u"
            lines.append(("user:" if place == "u" else "assistant:") + ("" if letter == "I" else rows[i][2]))
        elif letter == "K":
            place = initials[i]
            lines.append(f"{rows[i][1]}:{rows[i][2]}")
        i += letter != "I"
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha("\n".join(lines)))
