"""Token counts by dynamic programming over a trie of pre-tokens (operator 1).

The distinct pre-tokens (words, each with a word-start mark) of some texts go into a trie. The unigram
forward score of a prefix, that is the best log probability of a segmentation of it into pieces, depends
on the prefix alone, so it is computed once for each trie node, with the number of pieces of that best
segmentation: level by level for pre-tokens of up to 64 bytes, depth first for longer ones. The nodes
where pre-tokens end hold their counts; a document's count is the sum over its pre-tokens.

Piece probabilities come from the vocabulary file as they are: a piece of rank r has weight 1 / (r + 1).
A character that no piece covers costs its UTF-8 bytes in byte pieces. Of equal scores the segmentation
with fewer pieces is counted, then the one with the longer last piece.

Texts are handled a few MB at a time, so memory stays bounded; pre-tokens of any length are exact.
Defined results: null, empty and blank texts have no tokens; equal texts have equal counts; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import read_documents
from ._pieces import SPACE, HashTable, is_special, load_pieces
from ._text import K3, U64, Words, chunks, mix, powers, to_bytes

MARK = SPACE.encode()


class Unigram:
    """Log probabilities of the pieces, looked up by length and polynomial hash of their bytes."""

    def __init__(self, pieces: list[str]):
        ranked = [(r, p.encode()) for r, p in enumerate(p for p in pieces if not is_special(p))]
        total = np.log(sum(1 / (r + 1) for r, _ in ranked))
        self.score = np.array([-np.log(r + 1) - total for r, _ in ranked])
        self.byte = float(self.score.min()) - 10.0
        raw = [p for _, p in ranked]
        self.longest = max(map(len, raw))
        self.lengths = sorted({len(p) for p in raw})
        up, _ = powers(1 << 10)
        h = np.array([(np.frombuffer(p, np.uint8).astype(U64) * up[: len(p)]).sum() for p in raw], U64)
        h += np.array([len(p) for p in raw], U64) * K3
        self.table = HashTable(mix(h), np.arange(len(raw), dtype=np.int32))

    def find(self, h: np.ndarray, length: int) -> np.ndarray:
        return self.table.get(mix(h + np.full(1, length, U64) * K3))


def shared_prefixes(tokens: list[bytes]) -> np.ndarray:
    """Length of the prefix that each token has in common with the one above it; tokens are in sorted order."""
    shared = np.zeros(len(tokens), np.int64)
    for k in range(1, len(tokens)):
        a, b = tokens[k - 1], tokens[k]
        n = min(len(a), len(b))
        if a[:n] == b[:n]:
            shared[k] = n
        else:
            lo, hi = 0, n
            while hi - lo > 1:
                mid = (lo + hi) // 2
                if a[:mid] == b[:mid]:
                    lo = mid
                else:
                    hi = mid
            shared[k] = lo
    return shared


def count_distinct(tokens: list[bytes], model: Unigram) -> tuple[np.ndarray, np.ndarray]:
    """Pieces and forward score of each of the distinct tokens (bytes), which are given in sorted order."""
    m = len(tokens)
    size = np.array([len(t) for t in tokens], np.int64)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    buf = np.frombuffer(b"".join(tokens), np.uint8)
    # Trie: a row's prefix of length d is a new node unless the row above shares it.
    shared = shared_prefixes(tokens)
    up, down = powers(len(buf) + 1)
    total = np.concatenate([[U64(0)], np.cumsum(buf.astype(U64) * up[: len(buf)])])
    cont = (buf & 0xC0) == 0x80
    # Nodes are kept by level for as many levels as the longest piece, in row order.
    best, count, top = np.zeros(m), np.zeros(m, np.int32), int(size.max(initial=0))
    levels: dict[int, tuple] = {0: (np.zeros(1, np.int64), np.zeros(1), np.zeros(1, np.int32))}
    node_of = {0: np.zeros(m, np.int64)}
    rows = np.arange(m)
    for d in range(1, top + 1):
        rows = rows[size[rows] >= d]
        new = shared[rows] < d
        owner = rows[new]  # the first row through each node of this level
        s, c = np.full(len(owner), -np.inf), np.zeros(len(owner), np.int32)
        at = begin[owner] + d
        is_end = ~cont[np.minimum(at, len(buf) - 1)] | (size[owner] == d)
        # Longest piece first, so that of equal ones the longer last piece stays.
        for length in reversed(model.lengths):
            if length > d:
                continue
            src = node_of[d - length][owner]
            ps, pc = levels[d - length][1][src], levels[d - length][2][src]
            ok = np.flatnonzero(ps > -np.inf)
            if not len(ok):
                continue
            x = at[ok]
            found = model.find((total[x] - total[x - length]) * down[x - length], length)
            hit = found >= 0
            ok, value, pieces = ok[hit], ps[ok[hit]] + model.score[found[hit]], pc[ok[hit]] + 1
            take = (value > s[ok]) | ((value == s[ok]) & (pieces < c[ok]))
            s[ok[take]], c[ok[take]] = value[take], pieces[take]
        for length in (1, 2, 3, 4):  # one whole character as byte pieces
            if length <= d:
                head = buf[at - length]
                fits = is_end & ((head < 0x80) if length == 1 else (head >= (0xC0, 0xE0, 0xF0)[length - 2]) & ((head < (0xE0, 0xF0, 0xF8)[length - 2])))
                src = node_of[d - length][owner]
                value, pieces = levels[d - length][1][src] + length * model.byte, levels[d - length][2][src] + length
                take = fits & ((value > s) | ((value == s) & (pieces < c)))
                s[take], c[take] = value[take], pieces[take]
        levels[d] = (owner, s, c)
        index = np.zeros(m, np.int64)
        index[rows] = np.cumsum(new) - 1
        node_of[d] = index
        ended = rows[size[rows] == d]
        best[ended], count[ended] = s[index[ended]], c[index[ended]]
        if d >= model.longest:
            del levels[d - model.longest], node_of[d - model.longest]
    return count, best


def count_deep(tokens: list[bytes], model: Unigram, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """The same for long tokens, whose trie is deep and narrow: it is walked depth first.

    The scores of the path down to the present node are kept, so a token goes on from the last node that it shares
    with the token above. The pieces that end at new nodes are looked up for `step` bytes of all tokens at once.
    """
    m = len(tokens)
    size = np.array([len(t) for t in tokens], np.int64)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    buf = np.frombuffer(b"".join(tokens), np.uint8)
    shared = shared_prefixes(tokens)
    top = int(size.max(initial=0))
    path, pieces = [0.0] + [-np.inf] * top, [0] * (top + 1)
    best, count = np.zeros(m), np.zeros(m, np.int64)
    for lo in range(0, len(buf), step):
        hi, back = min(lo + step, len(buf)), max(0, lo - max(model.longest, 4))
        part = buf[back:hi]
        up, down = powers(len(part) + 1)
        total = np.concatenate([[U64(0)], np.cumsum(part.astype(U64) * up[: len(part)])])
        head = (part & 0xC0) != 0x80
        end = np.arange(lo + 1, hi + 1)
        owner = np.searchsorted(begin, end - 1, side="right") - 1
        depth = end - begin[owner]
        # Nodes are at the ends of characters; every token begins with a whole one.
        new = (depth > shared[owner]) & np.append(head[lo + 1 - back :], hi == len(buf) or (buf[hi : hi + 1] & 0xC0) != 0x80)
        end, owner, depth = end[new], owner[new], depth[new]
        at, found = end - back, []
        # Longest piece first and byte pieces last, as in count_distinct.
        for length in reversed(model.lengths):
            ok = np.flatnonzero(depth >= length)
            ok = ok[head[at[ok] - length]]
            x = at[ok]
            piece = model.find((total[x] - total[x - length]) * down[x - length], length)
            hit = piece >= 0
            found.append((ok[hit], np.full(hit.sum(), length), model.score[piece[hit]], np.ones(hit.sum(), np.int64)))
        for length in (1, 2, 3, 4):
            ok = np.flatnonzero(depth >= length)
            ok = ok[head[at[ok] - length]]
            if length > 1:  # one character, and not several
                first = part[at[ok] - length]
                ok = ok[(first >= (0xC0, 0xE0, 0xF0)[length - 2]) & (first < (0xE0, 0xF0, 0xF8)[length - 2])]
            else:
                ok = ok[part[at[ok] - 1] < 0x80]
            found.append((ok, np.full(len(ok), length), np.full(len(ok), length * model.byte), np.full(len(ok), length)))
        node, length, value, n = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(node, kind="stable")
        node, length, value, n = node[order], length[order], value[order], n[order]
        first, last = (np.searchsorted(begin, x, side="right") - 1 for x in (lo, hi - 1))
        edges = np.searchsorted(owner[node], np.arange(first, last + 2))
        for k, a, b in zip(range(first, last + 1), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if begin[k] >= lo:
                path[shared[k] + 1 : size[k] + 1] = [-np.inf] * int(size[k] - shared[k])
            ends = depth[node[a:b]]
            for d, src, v, c in zip(ends.tolist(), (ends - length[a:b]).tolist(), value[a:b].tolist(), n[a:b].tolist(), strict=True):
                v += path[src]
                c += pieces[src]
                if v > path[d] or (v == path[d] and c < pieces[d]):
                    path[d], pieces[d] = v, c
            if begin[k] + size[k] <= hi:
                best[k], count[k] = path[size[k]], pieces[size[k]]
    return count, best


def count_texts(texts: list[bytes], model: Unigram, limit: int = 6 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens, tokens and score of each text."""
    words, tokens, scores = [], [], []
    for lo, hi in chunks(texts, limit):
        w = Words(texts[lo:hi], lower=False)
        distinct, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        raw = w.buf.tobytes()
        spelled = [MARK + raw[a:b] for a, b in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)]
        order = sorted(range(len(spelled)), key=spelled.__getitem__)
        n, s = np.zeros(len(distinct), np.int64), np.zeros(len(distinct))
        if order:
            # A trie by levels for short rows, one walked depth first for long ones.
            for rows, fn in (([i for i in order if len(spelled[i]) <= 64], count_distinct), ([i for i in order if len(spelled[i]) > 64], count_deep)):
                if rows:
                    n[rows], s[rows] = fn([spelled[i] for i in rows], model)
        for out, v in ((tokens, n), (scores, s)):
            upto = np.concatenate([[0], np.cumsum(v[inverse])])
            out.append(np.diff(upto[w.bounds]))
        words.append(w.counts)
    join = lambda v, t: np.concatenate(v).astype(t) if v else np.zeros(0, t)
    return join(words, np.int64), join(tokens, np.int64), join(scores, np.float64)


def token_counts(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens and score (log probability of the best segmentation) of each text.

    No shuffle: each task shares prefixes within its own texts.
    """
    pieces = load_pieces(folder)

    def run(batches):
        model = Unigram(pieces)
        for b in batches:
            words, tokens, score = count_texts(to_bytes(b.column(1)), model)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(tokens), pa.array(np.round(score, 6))], names=["doc_id", "n_pretokens", "n_tokens", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long, score double")


def op1_tokens(spark, sf_dir):
    return token_counts(read_documents(spark, sf_dir))
