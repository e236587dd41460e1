"""A public vocabulary file as sorted arrays, and a vectorised hash table."""

from __future__ import annotations

import os

import numpy as np

from ._text import U64, mix

#: Folder of the public tokenizers; a parameter of every function that needs it.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
PIECE_MODEL = "piece_bpe_32k.model"
SPACE = "▁"


def load_pieces(folder: str | None = None, name: str = PIECE_MODEL) -> list[str]:
    """Pieces by id, read on the driver; they travel to the workers inside the task."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder or TOKENIZER_DIR, name))
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size())]


def is_special(piece: str) -> bool:
    """Control pieces and byte pieces, which no text merges into."""
    return piece in ("<unk>", "<s>", "</s>") or (len(piece) == 6 and piece.startswith("<0x"))


class HashTable:
    """Distinct 64-bit keys to int32 values by linear probing; lookups are whole arrays at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(10, int(np.ceil(np.log2(max(1, len(keys)) * 8))))
        self.shift, self.size = U64(64 - bits), 1 << bits
        self.keys = np.zeros(self.size, U64)
        self.values = np.full(self.size, -1, np.int32)
        left = np.arange(len(keys))
        at = self._slot(keys)
        self.longest = 0
        while len(left):
            free = self.values[at[left]] == -1
            tried = left[free]
            _, first = np.unique(at[tried], return_index=True)
            done = tried[first]
            self.keys[at[done]], self.values[at[done]] = keys[done], values[done]
            left = np.setdiff1d(left, done)
            at[left] = (at[left] + 1) % self.size
            self.longest += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, -1 where there is none."""
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], np.int32(-1))
        more = np.flatnonzero((self.keys[at] != keys) & (self.values[at] != -1))
        at = at[more]
        while len(more):
            at = (at + 1) % self.size
            hit = (self.keys[at] == keys[more]) & (self.values[at] != -1)
            out[more[hit]] = self.values[at[hit]]
            go = ~hit & (self.values[at] != -1)
            more, at = more[go], at[go]
        return out
