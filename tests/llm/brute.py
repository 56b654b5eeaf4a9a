"""Plain single-machine versions of the contracts, to test the operators."""

import hashlib
import re
from collections import defaultdict

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def substrings(docs, width=50):
    """docs: (doc_id, text). Rows (doc_id, n_words, n_removed, kept_sha256)."""
    big = float("inf")
    ids = [big if d is None else d for d, _ in docs]
    ws = [SPACE_WORD.findall(t or "") for _, t in docs]
    least = {}
    for d, w in zip(ids, ws):
        for i in range(len(w) - width + 1):
            k = tuple(w[i:i + width])
            least[k] = min(least.get(k, d), d)
    out = []
    for (doc, _), d, w in zip(docs, ids, ws):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if least[tuple(w[i:i + width])] < d:
                gone[i:i + width] = [True] * width
        out.append((doc, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def contamination(docs, items, width=13):
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    where = defaultdict(set)
    for item, text in items:
        w = BENCH_WORD.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - width + 1)) if w else ():
            where[tuple(w[i:i + width])].add(item)
    sizes = sorted({len(k) for k in where})
    out = []
    for doc, text in docs:
        w = BENCH_WORD.findall((text or "").translate(LOWER))
        hit, found = [False] * len(w), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                got = where.get(tuple(w[i:i + n]))
                if got:
                    found |= got
                    hit[i:i + n] = [True] * n
        h = sum(hit)
        out.append((doc, len(w), h, len(found), sha(",".join(sorted(map(str, found)))), h > 0 and 20 * h >= len(w)))
    return out


def near(docs, width=4, percent=80):
    """Rows (doc_id, n_shingles, component_id, kept); every pair is compared."""
    sets = []
    for _, t in docs:
        w = SPACE_WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    parent = {d: d for d, _ in docs}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    seen = set()
    for rows in by.values():
        for i in rows:
            for j in rows:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        a, b = sorted((root(docs[i][0]), root(docs[j][0])))
                        parent[b] = a
    return [(d, len(s), root(d), root(d) == d) for (d, _), s in zip(docs, sets)]


def vectors(rows, cosine=0.95):
    """rows: (vec_id, list or None). Rows (vec_id, n_links, component_id, kept)."""
    import math
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in good:
        for b in good:
            va, vb = rows[a][1], rows[b][1]
            if a < b and len(va) == len(vb):
                dot = math.fsum(x * y for x, y in zip(va, vb))
                if dot / math.sqrt(math.fsum(x * x for x in va) * math.fsum(x * x for x in vb)) >= cosine:
                    links[a] += 1
                    links[b] += 1
                    x, y = sorted((root(a), root(b)), key=lambda i: rows[i][0])
                    parent[y] = x
    return [(i, n, rows[root(k)][0], rows[root(k)][0] == i) for k, ((i, _), n) in enumerate(zip(rows, links))]


def secrets(docs):
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256)."""
    kinds = (("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
             ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32))
    out = []
    for doc, text in docs:
        spans, n = [], []
        for rank, (kind, pattern, group, least) in enumerate(kinds):
            found = [m for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
            n.append(len(found))
            spans += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in found]
        out.append((doc, *n, sha(",".join(s for _, _, s in sorted(spans)))))
    return out


RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def url(u):
    """(host, path, rule, verdict or None)."""
    host = path = ""
    if u and "://" in u:
        rest = u.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = host.translate(LOWER)
    best = None
    for verdict, rule in RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best and best[1], best and best[0]
