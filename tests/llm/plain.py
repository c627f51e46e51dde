"""Plain single-machine versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash


def closure(nodes, links):
    """Smallest node reachable from each node."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def repeats(texts: dict, length: int) -> dict:
    raw = {k: (t or "").encode() for k, t in texts.items()}
    seen = Counter(r[i : i + length] for r in raw.values() for i in range(len(r) - length + 1))
    out = {}
    for k, r in raw.items():
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(r, np.uint8)[~gone])
        out[k] = (len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def fingerprint(text) -> int:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(texts: dict) -> dict:
    prints = {k: fingerprint(t) for k, t in texts.items()}
    ids = sorted(texts)
    fp = np.array([prints[k] for k in ids], np.uint64)
    links = []
    for i in range(len(ids)):
        near = np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= 3)
        links += [(ids[i], ids[i + 1 + j]) for j in near]
    root = closure(ids, links)
    return {k: (f"{prints[k]:016x}", root[k]) for k in ids}


def pieces_hold(rows, texts, window=4096, end_id=2):
    """Check packed pieces (tuples in the order of the contract) against whole-text tokenization."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, total, sequence, offset in rows:
        by_doc[doc].append((start, length, crc, total))
        by_sequence[sequence].append((offset, length))
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, end_id], "<u4")
        at = 0
        for start, length, crc, total in sorted(pieces):
            assert start == at and length > 0 and total == len(ids), doc
            assert crc == zlib.crc32(ids[start : start + length].tobytes()), doc
            at += length
        assert at == len(ids), doc
    last = max(by_sequence, default=-1)
    assert sorted(by_sequence) == list(range(last + 1))
    for sequence, parts in by_sequence.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or (sequence == last and at <= window)


def near_vectors(vectors: dict, least=0.9) -> dict:
    sound = {}
    for k, v in vectors.items():
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            sound[k] = x / np.sqrt((x * x).sum())
    links = []
    for size in {len(v) for v in sound.values()}:
        ids = sorted(k for k in sound if len(sound[k]) == size)
        x = np.array([sound[k] for k in ids])
        for i in range(len(ids)):
            links += [(ids[i], ids[i + 1 + j]) for j in np.flatnonzero(x[i + 1 :] @ x[i] >= least)]
    n = Counter(k for pair in links for k in pair)
    root = closure(vectors, links)
    return {k: (n[k], root[k], root[k] == k) for k in vectors}


def secrets(text) -> list:
    text = text or ""
    rules = [
        ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
        ("access", r"(AKIA[A-Z0-9]+)", 20),
        ("hex", r"([0-9a-f]+)", 24),
    ]
    found = []
    for rank, (kind, rule, least) in enumerate(rules):
        for m in re.finditer(rule, text, re.A):
            if len(m[1]) >= least:
                found.append((m.start(), rank, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def spelling(texts: list, least_count=3) -> dict:
    """word -> (form, root, n, n_near, form_n); texts are (doc_id, text)."""
    count = Counter()
    for doc, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if n >= least_count and len(w) >= 5}
    cut = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            cut[w[:i] + w[i + 1 :]].add((w, i))
    near = defaultdict(set)
    for gone, found in cut.items():
        for w, i in found:
            near[w] |= {x for x, j in found if x != w and i == j}
            if gone in words:
                near[w].add(gone)
                near[gone].add(w)
    out = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        out[w] = (best, n, len(near[w]), words[best]) if best and words[best] >= 2 * n else (None, n, len(near[w]), None)

    def root(w):
        return root(out[w][0]) if out[w][0] else w

    return {w: (form, root(w), *rest) for w, (form, *rest) in out.items()}


def kneser_ney(texts: list[str]):
    """Bits per character of a text under an interpolated Kneser-Ney model of order 4, by dictionaries."""

    def grams(text):
        letters = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "")
        folded = "  " + re.sub(" +", " ", f" {letters} ")
        found = [folded[k : k + 4] for k in range(len(folded) - 3)]
        return found or ["    "]

    levels = {4: Counter(g for t in texts for g in grams(t))}
    for k in (3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    total, kinds, discount = {}, {}, {}
    for k, counts in levels.items():
        total[k], kinds[k] = Counter(), Counter()
        for g, n in counts.items():
            total[k][g[:-1]] += n
            kinds[k][g[:-1]] += 1
        ones, twos = (sum(n == x for n in counts.values()) for x in (1, 2))
        discount[k] = ones / (ones + 2 * twos) if ones else 0.5

    def probability(gram, k):
        if k == 0:
            return 1 / (len(levels[1]) + 1)
        g, lower = gram[-k:], probability(gram, k - 1)
        t = total[k][g[:-1]]
        return (max(levels[k][g] - discount[k], 0) if levels[k][g] else 0) / t + discount[k] * kinds[k][g[:-1]] / t * lower if t else lower

    return lambda text: -sum(np.log2(probability(g, 4)) for g in grams(text)) / len(grams(text))


def attention(model, text) -> float:
    """The score of one text, passage by passage, unit by unit."""
    from twinlake.llm import quality

    x, _ = quality.encode([text])
    p, squash = model.params, lambda v: 1 / (1 + np.exp(-v))
    hidden, weights = [], []
    for passage in x:
        seen = [(float(v) - float(m)) * float(s) for v, m, s in zip(passage, model.mean, model.scale)]
        h = [np.tanh(sum(v * float(w) for v, w in zip(seen, column)) + float(b)) for column, b in zip(p["W"].T, p["bw"])]
        gate = lambda k: [sum(a * float(w) for a, w in zip(h, column)) for column in p[k].T]  # noqa: B023, E731
        weights.append(np.exp(sum(np.tanh(a) * squash(b) * float(w) for a, b, w in zip(gate("V"), gate("U"), p["w"]))))
        hidden.append(h)
    mixed = [sum(w * h[k] for w, h in zip(weights, hidden)) / sum(weights) for k in range(len(hidden[0]))]
    return float(squash(sum(z * float(c) for z, c in zip(mixed, p["c"])) + float(p["b"])))
