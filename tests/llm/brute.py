"""Plain restatements of what the operators compute, for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from itertools import accumulate, pairwise

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text: str | None, n: int) -> set:
    w = words((text or "").translate(LOW))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(rows: dict[int, str | None], n: int, percent: int) -> dict[int, int]:
    sets, up = {d: shingles(t, n) for d, t in rows.items()}, {d: d for d in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(rows)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: root(d) for d in rows}


def repeats(rows: dict[int, str | None], length: int = 50) -> dict[int, tuple]:
    """n_bytes, n_removed, n_spans, kept_sha256 by id."""
    seen, out = set(), {}
    for d in sorted(rows):
        b = (rows[d] or "").encode()
        gone, new = bytearray(len(b)), []
        for j in range(len(b) - length + 1):
            s = b[j : j + length]
            if s in seen:
                gone[j : j + length] = b"\1" * length
            new.append(s)
        seen.update(new)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def base_figures(text: str | None) -> tuple:
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def unigram(token: str, score: dict[str, float], byte: float) -> tuple[int, float]:
    """Pieces and score of the best segmentation; of equal ones that with fewer pieces."""
    best = [(0.0, 0)] + [(float("-inf"), 0)] * len(token)
    for end in range(1, len(token) + 1):
        for begin in range(max(0, end - 20), end):
            p = token[begin:end]
            if p in score:
                best[end] = max(best[end], (best[begin][0] + score[p], best[begin][1] - 1))
        width = len(token[end - 1].encode())
        best[end] = max(best[end], (best[end - 1][0] + width * byte, best[end - 1][1] - width))
    return -best[-1][1], best[-1][0]


def token_counts(rows: dict, held) -> tuple[Counter, int]:
    c = Counter()
    for d, t in rows.items():
        if not held(d):
            c.update([*words((t or "").translate(LOW)), None])
    return c, sum(c.values())


def merges(text: str, index: dict[str, int], skipped=lambda begin, middle, end: False) -> list[str]:
    """Merge-type pieces: the best-ranked adjacent pair that is not skipped first, then the leftmost; spans end at None with the text."""
    s = list(text)
    while True:
        begin = [*accumulate((len(x) for x in s), initial=0)]
        spans = [(begin[i], begin[i + 1], begin[i + 2] if i + 2 < len(s) else None) for i in range(len(s) - 1)]
        options = [(index[a + b], i) for i, (a, b) in enumerate(pairwise(s)) if a + b in index and not skipped(*spans[i])]
        if not options:
            return s
        _, i = min(options)
        s[i : i + 2] = [s[i] + s[i + 1]]


def mix(h: int) -> int:
    """The 64-bit finaliser of dropout's hash, in whole numbers."""
    for k in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ h >> 33) * k % 2**64
    return h ^ h >> 33


def skips(document: int, nth: int, seed: int, dropout: float):
    """Whether a candidate merge of the nth pre-token of a document is skipped."""
    k1, k2, k3 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93
    key = mix((mix((document + seed * k2) % 2**64) + nth * k1) % 2**64)
    return lambda b, m, e: mix((key + b * k1 + m * k2 + (2**40 if e is None else e) * k3) % 2**64) < int(dropout * 2**64)
