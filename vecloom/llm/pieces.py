"""SentencePiece encoding with seeded merge dropout, and lossless decoding (operator 7).

A text is cut into pre-tokens that join to it exactly: a word with the one space before it, or a single
white-space character. Merge-type encoding keeps an agenda of adjacent pairs whose union is a piece and
applies the best-ranked, leftmost first. With dropout each candidate merge is skipped by a hash of seed,
document, place of the pre-token in it, and span, so every occurrence of a word is segmented on its own,
yet reruns agree. Only without dropout do equal pre-tokens share their work.

A space is spelled with the word-start mark; any character without a piece of its own, the mark itself
included, is spelled in byte pieces. So decoding gives back every text exactly.

Defined results: null and empty texts have no pieces and decode to the empty text; equal rows get equal
pieces; texts of any length are whole; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import read_documents
from ._pieces import SPACE, HashTable, is_special, load_pieces
from ._text import K1, K2, K3, U64, chunks, mix, powers, to_bytes, trim

NONE = np.int32(1 << 30)
#: Words of more symbols are merged with a heap, one at a time; the results are the same.
LONG = 400
#: Bytes of texts that are merged at once; bounds scratch memory and changes no result.
CHUNK = 1 << 18
BYTE0 = "<0x00>"


class Vocabulary:
    def __init__(self, pieces: list[str]):
        index = {p: i for i, p in enumerate(pieces)}
        self.byte0 = index[BYTE0]
        self.space = index[SPACE]
        usable = {p: i for p, i in index.items() if not is_special(p) and SPACE not in p[1:]}
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in usable.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.char[ord(SPACE)] = -1
        self.char[0x20] = self.space
        keys, values = [], []
        for p, i in usable.items():
            for k in range(1, len(p)):
                a, b = usable.get(p[:k]), usable.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(i)
        self.pairs = HashTable(np.array(keys, U64), np.array(values, np.int32))
        # Bytes of each piece, one after the other, for decoding.
        raw = [bytes([i - self.byte0]) if self.byte0 <= i < self.byte0 + 256 else b"" if is_special(p) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.width = np.array([len(r) for r in raw], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.width)[:-1]])
        self.flat = np.frombuffer(b"".join(raw), np.uint8)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = self.pairs.get(a.astype(U64) << U64(32) | b.astype(U64))
        return np.where(found < 0, NONE, found)


@lru_cache(1)
def vocabulary(pieces: tuple[str, ...]) -> Vocabulary:
    """A worker builds its tables once and keeps them for later tasks."""
    return Vocabulary(pieces)


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices begin[i] .. begin[i] + size[i] - 1 for all i, one after the other."""
    upto = np.cumsum(size)
    total = int(upto[-1]) if len(upto) else 0
    return np.arange(total) - np.repeat(upto - size - begin, size)


def agenda(sym: np.ndarray, word: np.ndarray, at: np.ndarray, key: np.ndarray, voc: Vocabulary, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Merge the symbols of many words at once, one merge a word and round.

    sym: piece ids; word: their word, ascending; at: their offset in it; key: of each word, for dropout.
    Returns the merged symbols with their words, in order of words.
    """
    limit = U64(min(int(dropout * 2**64), 2**64 - 1))

    def rank(left, right):
        """Ids that pairs merge into; NONE where nothing or a skipped candidate."""
        r = voc.merged(sym[left], sym[right])
        if dropout > 0:
            live = np.flatnonzero(r != NONE)
            a, m = at[left[live]].astype(U64), at[right[live]].astype(U64)
            end = stop[right[live]].astype(U64)
            h = mix(key[word[left[live]]] + a * K1 + m * K2 + end * K3)
            r[live[h < limit]] = NONE
        return r

    if not len(sym):
        return sym, word
    out_sym, out_word = [], []
    stop = np.append(at[1:], 0)
    last = np.append(word[1:] != word[:-1], True)
    stop[last] = 1 << 40
    pos = np.arange(len(sym))
    cand = np.full(len(sym), NONE, np.int32)
    inner = pos[~last]
    cand[inner] = rank(inner, inner + 1)
    while len(sym):
        head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        size = np.diff(np.append(head, len(sym)))
        best = np.minimum.reduceat(cand, head)
        live = best != NONE
        if not live.all():
            keep = np.repeat(live, size)
            out_sym.append(sym[~keep])
            out_word.append(word[~keep])
            sym, word, at, stop, cand = sym[keep], word[keep], at[keep], stop[keep], cand[keep]
            if not len(sym):
                break
            best, size = best[live], size[live]
            head = np.cumsum(size) - size
        hit = np.flatnonzero(cand == np.repeat(best, size))
        first = hit[np.append(True, word[hit[1:]] != word[hit[:-1]])]
        sym[first], stop[first] = best, stop[first + 1]
        alive = np.ones(len(sym), bool)
        alive[first + 1] = False
        new = first - np.arange(len(first))
        sym, word, at, stop, cand = sym[alive], word[alive], at[alive], stop[alive], cand[alive]
        # Only the pairs around a merge change.
        n = len(sym)
        right = new[(new + 1 < n) & (word[np.minimum(new + 1, n - 1)] == word[new])]
        cand[new] = NONE
        cand[right] = rank(right, right + 1)
        left = new[(new > 0) & (word[np.maximum(new - 1, 0)] == word[new])] - 1
        cand[left] = rank(left, left + 1)
    if not out_sym:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    s, w = np.concatenate(out_sym), np.concatenate(out_word)
    order = np.argsort(w, kind="stable")
    return s[order], w[order]


def agenda_long(sym: list[int], key: int, voc: Vocabulary, dropout: float) -> list[int]:
    """The same merges for one long word, with a heap of candidates."""
    n = len(sym)
    nxt, prv, stop = [*range(1, n + 1)], [*range(-1, n - 1)], [*range(1, n), 1 << 40]
    heap: list = []
    limit = min(int(dropout * 2**64), 2**64 - 1)

    def offer(lefts: list[int]):
        a = np.array(lefts)
        b = np.array([nxt[i] for i in lefts])
        got = voc.merged(np.array([sym[i] for i in a]), np.array([sym[i] for i in b]))
        if dropout > 0:
            end = np.array([stop[i] for i in b]).astype(U64)
            h = mix(U64(key) + a.astype(U64) * K1 + b.astype(U64) * K2 + end * K3)
            got[h < U64(limit)] = NONE
        for i, j, r in zip(a.tolist(), b.tolist(), got.tolist(), strict=True):
            if r != NONE:
                heapq.heappush(heap, (r, i, j, stop[i], stop[j]))

    if n > 1:
        offer([*range(n - 1)])
    while heap:
        r, i, j, si, sj = heapq.heappop(heap)
        if sym[i] < 0 or sym[j] < 0 or nxt[i] != j or stop[i] != si or stop[j] != sj:
            continue
        sym[i], sym[j], stop[i], nxt[i] = r, -1, sj, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        around = [x for x in (prv[i], i) if x >= 0 and nxt[x] < n]
        if around:
            offer(around)
    return [x for x in sym if x >= 0]


def draw_keys(document: np.ndarray, nth: np.ndarray, seed: int) -> np.ndarray:
    """Hash key of each pre-token's candidate merges: of the seed, its document and its place among the document's pre-tokens."""
    return mix(mix(document + np.full(1, seed % 2**63, U64) * K2) + nth.astype(U64) * K1)


def encode_texts(texts: list[bytes], keys: np.ndarray, voc: Vocabulary, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts and the number of pieces of each; keys tell documents apart."""
    strings = [t.decode("utf-8") for t in texts]
    cp = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cp)
    sizes = np.array([len(s) for s in strings], np.int64)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    text_at = np.cumsum(sizes) - sizes
    opens = np.zeros(n + 1, bool)
    opens[text_at] = True
    opens = opens[:n]
    white = (cp == 32) | ((cp >= 9) & (cp <= 13))
    start = white | opens
    start[1:] |= white[:-1] & (cp[:-1] != 32) & ~white[1:]
    begin = np.flatnonzero(start)
    size = np.diff(np.append(begin, n))
    owner = np.searchsorted(text_at, begin, "right") - 1
    if len(texts):
        empty = np.flatnonzero(sizes == 0)
        if len(empty):  # several texts may begin at one place; the last of them holds the characters
            filled = np.flatnonzero(sizes > 0)
            owner = filled[np.searchsorted(text_at[filled], begin, "right") - 1]
    if dropout > 0:
        per = np.bincount(owner, minlength=len(texts))
        key = draw_keys(keys[owner], np.arange(len(begin)) - (np.cumsum(per) - per)[owner], seed)
        inverse, b, s = None, begin, size
    else:
        up, down = powers(n + 1)
        total = np.cumsum((cp.astype(U64) + U64(1)) * up[:n])
        h = (total[begin + size - 1] - np.where(begin > 0, total[begin - 1], U64(0))) * down[begin]
        key, first, inverse = np.unique(mix(h + size.astype(U64) * K3), return_index=True, return_inverse=True)
        b, s = begin[first], size[first]
    index = spread(b, s)
    sym, word = voc.char[cp[index]], np.repeat(np.arange(len(b)), s)
    lone = np.flatnonzero(sym < 0)
    if len(lone):
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in cp[index[lone]].tolist()]
        times = np.ones(len(sym), np.int64)
        times[lone] = [len(r) for r in raw]
        where = np.repeat(np.arange(len(sym)), times)
        fallback = sym[where] < 0
        sym, word = sym[where], word[where]
        sym[fallback] = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32) + voc.byte0
    length = np.bincount(word, minlength=len(b))
    head = np.cumsum(length) - length
    at = np.arange(len(sym)) - head[word]
    large = length > LONG
    apart = large[word]
    whole = [agenda_long(sym[head[i] : head[i] + length[i]].tolist(), int(key[i]), voc, dropout) for i in np.flatnonzero(large).tolist()]
    sym, word = agenda(sym[~apart], word[~apart], at[~apart], key, voc, dropout)
    if whole:
        sym = np.concatenate([sym, *(np.array(x, np.int32) for x in whole)])
        word = np.concatenate([word, np.repeat(np.flatnonzero(large), [len(x) for x in whole])])
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
    count = np.bincount(word, minlength=len(b))
    if inverse is not None:
        where = np.cumsum(count) - count
        sym, count = sym[spread(where[inverse], count[inverse])], count[inverse]
    return sym, np.bincount(owner, count, len(texts)).astype(np.int64)


def decode_ids(ids: np.ndarray, voc: Vocabulary) -> bytes:
    return voc.flat[spread(voc.begin[ids], voc.width[ids])].tobytes()


def encode(docs: DataFrame, dropout: float = 0.1, seed: int = 5, folder: str | None = None) -> DataFrame:
    """doc_id, n_pieces, pieces (ids) and lossless (the pieces decode to the text) of every whole text; no shuffle."""
    pieces = tuple(load_pieces(folder))

    def run(batches):
        voc = vocabulary(pieces)
        for b in batches:
            texts = to_bytes(b.column(1))
            names = b.column(0).cast("string").to_pylist()
            keys = np.array([hash_id(x) for x in names], U64)
            for lo, hi in chunks(texts, CHUNK):
                ids, count = encode_texts(texts[lo:hi], keys[lo:hi], voc, dropout, seed)
                upto = np.concatenate([[0], np.cumsum(count)])
                same = decode_ids(ids, voc) == b"".join(texts[lo:hi])
                ok = [True] * (hi - lo) if same else [decode_ids(ids[upto[i] : upto[i + 1]], voc) == texts[lo + i] for i in range(hi - lo)]
                lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(count), lists, pa.array(ok)], names=["doc_id", "n_pieces", "pieces", "lossless"])
                del ids, lists
                trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_pieces long, pieces array<int>, lossless boolean")


def hash_id(x: str | None) -> int:
    """64-bit key of an id; null has one too."""
    import zlib

    raw = (x if x is not None else "\0null").encode()
    return zlib.crc32(raw) << 32 | zlib.crc32(raw[::-1])


def decode(encoded: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id and text, from doc_id and pieces."""
    pieces = tuple(load_pieces(folder))

    def run(batches):
        voc = vocabulary(pieces)
        for b in batches:
            texts = [decode_ids(np.array(x or [], np.int64), voc).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "pieces").mapInArrow(run, f"doc_id {kind}, text string")


def op7_pieces(spark, sf_dir):
    return encode(read_documents(spark, sf_dir))
