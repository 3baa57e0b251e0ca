"""Plain definitions of what the operators compute, for small tables."""

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def components(rows, size, percent=80):
    """Per row of (doc_id, text): n_shingles, component_id, kept, over all pairs."""
    sets = [shingle_set(t, size) for _, t in rows]
    where = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            where[g].append(k)
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, s in enumerate(sets):
        for other, common in Counter(j for g in s for j in where[g] if j < k).items():
            if 100 * common >= percent * (len(s) + len(sets[other]) - common):
                a, b = find(k), find(other)
                root[max(a, b)] = min(a, b)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            r = find(k)
            least[r] = min(least.get(r, doc_id), doc_id)
    ids = [least.get(find(k)) for k in range(len(rows))]
    return [(d, len(s), c, d is not None and d == c) for (d, _), s, c in zip(rows, sets, ids, strict=True)]


def without_repeats(rows, length):
    """Per row of (doc_id, text): n_bytes, n_removed, n_spans, digest of the rest."""
    bodies = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k : k + length] for b in bodies for k in range(len(b) - length + 1))
    out = []
    for (doc_id, _), body in zip(rows, bodies, strict=True):
        gone = bytearray(len(body))
        for k in range(len(body) - length + 1):
            if seen[body[k : k + length]] > 1:
                gone[k : k + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(body, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((doc_id, len(body), len(body) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def loads(texts, shards, overhead=8):
    """Shard loads of longest-processing-time scheduling over groups of equal texts."""
    groups = Counter()
    for t in texts:
        groups[t or ""] += len((t or "").encode()) + overhead
    heap = [(0, k) for k in range(shards)]
    for size in sorted(groups.values(), reverse=True):
        load, k = heap[0]
        heapq.heapreplace(heap, (load + size, k))
    return sorted(load for load, _ in heap)


def crc(text):
    return zlib.crc32((text or "").encode())


def word_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def conversation_digests(rows):
    """Per conv_id of (conv_id, turn, role, text): the digests a formatter must give back."""
    turns = defaultdict(list)
    null_first = lambda x: (x is not None, x or 0) if not isinstance(x, str) else (True, x)
    for conv_id, turn, role, text in sorted(rows, key=lambda r: (null_first(r[1]), null_first(r[2]), null_first(r[3]))):
        turns[conv_id].append((role or "", text or ""))
    out = {}
    for conv_id, own in turns.items():
        learned = "".join(t for r, t in own if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in own)
        out[conv_id] = (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def trie_nodes(rows, head=6, block=100):
    """Nodes of the rebuilt conversations' trie, from sequences and recursion-free sums over all prefixes."""
    turns = defaultdict(list)
    key = lambda r: ((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "")
    for conv_id, _, role, text in sorted((r for r in rows if r[0] is not None), key=key):
        turns[conv_id].append((role or "", text or ""))
    built = {}
    for c, own in turns.items():
        h = crc(str(c)) % head
        base = c - (abs(c) % block) * (1 if c >= 0 else -1)
        built[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    inner = {p[:-1] for p in members if p}
    leaves, saved, children = Counter(), Counter(), Counter()
    for p, own in members.items():
        if p:
            children[p[:-1]] += 1
        gain = (len(own) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in inner
            saved[p[:d]] += gain
    out = []
    for p, own in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in own if len(built[c]) == len(p)))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(own), len(p), parent, len(own), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nearest(rows, k=10, scale=1024, asked=lambda i: i % 100 == 0):
    """(query_id, rank, vec_id, score) of (vec_id, vector) rows, every pair scored."""
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in whole if i is not None and asked(i)}:
        scored = [(-sum(x * y for x, y in zip(a, b)), i is None, i) for i, b in whole if i != q]  # noqa: B905
        out += [(q, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def spelling_variants(rows, least_letters=6, least_count=5, slip=199, ratio=5):
    """(word, form, root, n, n_near, form_n) of (doc_id, text) rows, from all words one edit away."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(LOWER)
            h = crc(f"{'' if doc_id is None else doc_id}:{run}")
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % slip == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_letters and n >= least_count}
    holes = defaultdict(set)  # a word with one place open, or one letter less
    for w in words:
        for k in range(len(w)):
            holes[w[:k] + "\0" + w[k + 1 :]].add(w)
            holes[w[:k] + w[k + 1 :]].add(w)
        holes[w].add(w)
    near = {w: {x for k in range(len(w)) for g in (w[:k] + "\0" + w[k + 1 :], w[:k] + w[k + 1 :], w) for x in holes[g] if len(g) + 1 >= max(len(w), len(x)) or "\0" in g} for w in words}
    near = {w: {x for x in own if x != w and one_edit(w, x)} for w, own in near.items()}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))  # noqa: B905
    return a != b and len(b) - len(a) <= 1 and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :])
