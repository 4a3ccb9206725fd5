"""Encoding white-space chunks once: bounded per-worker caches in front of the tokenizer libraries.

Both vocabularies used here never join characters across the white space at which a text is cut, so a
text's ids are the ids of its chunks one after another; tests hold that against whole-text encoding.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np

CACHE_CHUNKS = 400_000


@contextmanager
def uncollected() -> Iterator[None]:
    """No garbage collections, each of which would walk the caches; for code that makes no cycles."""
    collecting = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if collecting:
            gc.enable()


class ChunkCache(dict):
    """chunk -> value.  When it is full, what it holds becomes the older half, and what is used again comes back."""

    def __init__(self) -> None:
        super().__init__()
        self.older: dict = {}

    def __missing__(self, key):
        value = self[key] = self.older[key]
        return value

    def holds(self, key) -> bool:
        return key in self or key in self.older

    def gather(self, keys: list, learn) -> bytes:
        """Values of the keys, joined; learn(missing keys) puts what isn't known yet."""
        try:
            return b"".join([self[k] for k in keys])
        except KeyError:
            distinct = set(keys)
            held = {k for k in distinct if self.holds(k)}
            for k in held:
                self[k]  # to the newer half, so that making room keeps it
            learn(list(distinct - held))
            return b"".join([self[k] for k in keys])

    def room(self, more: int) -> None:
        if len(self) + more > CACHE_CHUNKS:
            self.older = dict(self)
            self.clear()


# Letters whose normal form is themselves and whose lower case is one letter, then ASCII signs that
# neither start a contraction nor a special token.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?%$&#*|()\-]*)")
_WORD = re.compile(r"[a-zà-öø-ÿ]+")


class WordPieces:
    """Ids of a tokenizers file that drops white space (lower-casing BPE with word ends)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.cache: ChunkCache = ChunkCache()
        self.parts: ChunkCache = ChunkCache()

    def _learn(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        plain, split = _PLAIN.fullmatch, {}
        for chunk in chunks:
            s = chunk.decode("utf-8", "replace")
            m = plain(s)
            split[chunk] = (m[1].lower(), m[2]) if m else (s, "")
        new, older = self.parts, self.parts.older
        known = {"": b""}
        for p in {p for own in split.values() for p in own if p}:
            known[p] = new[p] if p in new or p in older else None
        missing = [p for p, ids in known.items() if ids is None]
        words = [p for p in missing if _WORD.fullmatch(p)]
        for at in range(0, len(words), 512):  # words of letters alone: many in one text, each a pre-token
            part = words[at : at + 512]
            e = self.library.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(e.ids, "<u4").tobytes()
            cuts = (4 * np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(part) + 1))).tolist()
            known.update(zip(part, [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
        others = [p for p in missing if known[p] is None]
        for at in range(0, len(others), 4096):
            part = others[at : at + 4096]
            for p, e in zip(part, self.library.encode_batch(part, add_special_tokens=False), strict=True):
                known[p] = np.array(e.ids, "<u4").tobytes()
        self.parts.room(len(missing))
        self.parts.update({p: known[p] for p in missing})
        self.cache.room(len(split))
        learnt = {chunk: known[first] + known[second] for chunk, (first, second) in split.items()}
        self.cache.update(learnt)
        return learnt

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [t.split() for t in texts]
        # a small dict of these texts' chunks: the large one is asked once for each distinct chunk
        cache, older, here, missing = self.cache, self.cache.older, {}, []
        for chunk in set().union(*cut):
            ids = cache.get(chunk)
            if ids is None:
                ids = older.get(chunk)
                if ids is None:
                    missing.append(chunk)
                    continue
                cache[chunk] = ids  # to the newer half, so that making room keeps it
            here[chunk] = ids
        if missing:
            here.update(self._learn(missing))
        return [b"".join(map(here.__getitem__, words)) for words in cut]


_LOADED: dict[tuple, object] = {}


def loaded(kind: type, path: str):
    """One encoder per worker process and file."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]
