"""Edit-aware token counts: a segment tree over each document's pre-tokens.

Byte-level BPE never merges across pre-tokens, so a text's token count is the sum over its pre-tokens.
`TokenTree` keeps them in leaves of some dozens, and above the leaves a binary tree of sums (characters,
tokens).  An edit finds its place by descending the sums, re-splits the pre-tokens that it touches with their
boundary context, and adds the difference to the sums on the way up.

Boundary context.  Where a pre-token starts at a place, what follows it decides the split, nothing before.  But a
pre-token can depend on what comes after it: white space on the next character, and an apostrophe on the next two
letters, as it may begin a contraction ('re, 've, 'll).  So the re-split starts at the pre-token that holds the
character before the edit, one further back if that one ends in an apostrophe, then before the white space that runs
up to it, and ends as soon as a new boundary falls on an old one behind the edit.
"""

from __future__ import annotations

import base64

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.chunked import ChunkCache, loaded
from quarry.llm.common import map_rows, row_struct, with_row

LEAF = 64
AHEAD = 8
TREES = "id long, text string, lengths binary, counts binary"
EDITED = "id long, text string, lengths binary, counts binary, n_before long, n_tokens long, n_edits long, reencoded_chars long"


class Counter:
    """Splits into pre-tokens and counts a pre-token's tokens, each once per worker."""

    def __init__(self, ranks: str):
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(public_tokenizers.PATTERN)
        self.library = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.cache: ChunkCache = ChunkCache()

    def count(self, token: str) -> int:
        try:
            return self.cache[token]
        except KeyError:
            self.cache.room(1)
            n = self.cache[token] = len(self.library.encode_ordinary(token))
            return n


class TokenTree:
    def __init__(self, tokens: list[str], counts: list[int], counter: Counter):
        self.counter = counter
        self.leaves = [tokens[i : i + LEAF] for i in range(0, len(tokens), LEAF)] or [[]]
        self.counts = [counts[i : i + LEAF] for i in range(0, len(tokens), LEAF)] or [[]]
        self.reencoded = 0
        self._build()

    @classmethod
    def of(cls, text: str, counter: Counter) -> TokenTree:
        tokens = counter.split.findall(text)
        return cls(tokens, [counter.count(t) for t in tokens], counter)

    def _build(self) -> None:
        self.base = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        for i, (leaf, counts) in enumerate(zip(self.leaves, self.counts, strict=True)):
            self.chars[self.base + i], self.tokens[self.base + i] = sum(map(len, leaf)), sum(counts)
        for i in range(self.base - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def _find(self, at: int) -> tuple[int, int, int]:
        """Leaf, index in it and start of the pre-token that holds character `at` (the last one, past the end)."""
        node, start = 1, 0
        at = min(at, self.n_chars - 1)
        while node < self.base:
            node *= 2
            if at >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        leaf = node - self.base
        for i, token in enumerate(self.leaves[leaf]):
            if at < start + len(token):
                return leaf, i, start
            start += len(token)
        raise IndexError(at)

    def _before(self, leaf: int, i: int) -> tuple[int, int] | None:
        """The pre-token before this one; leaves may be empty."""
        while i == 0:
            if leaf == 0:
                return None
            leaf -= 1
            i = len(self.leaves[leaf])
        return leaf, i - 1

    def _replace(self, leaf: int, i: int, end_leaf: int, end_i: int, tokens: list[str]) -> None:
        """Put tokens for those from (leaf, i) up to (end_leaf, end_i), and update the sums above."""
        counts = [self.counter.count(t) for t in tokens]
        if leaf == end_leaf:
            self.leaves[leaf][i:end_i], self.counts[leaf][i:end_i] = tokens, counts
        else:
            self.leaves[leaf][i:], self.counts[leaf][i:] = tokens, counts
            for k in range(leaf + 1, end_leaf):
                self.leaves[k], self.counts[k] = [], []
            del self.leaves[end_leaf][:end_i], self.counts[end_leaf][:end_i]
        if len(self.leaves[leaf]) > 2 * LEAF or end_leaf - leaf > LEAF:
            self.leaves = [part[k : k + LEAF] for part in self.leaves for k in range(0, len(part), LEAF)] or [[]]
            self.counts = [part[k : k + LEAF] for part in self.counts for k in range(0, len(part), LEAF)] or [[]]
            self._build()
            return
        for k in range(leaf, end_leaf + 1):
            node = self.base + k
            chars, own = sum(map(len, self.leaves[k])) - self.chars[node], sum(self.counts[k]) - self.tokens[node]
            while node and (chars or own):
                self.chars[node] += chars
                self.tokens[node] += own
                node //= 2

    def edit(self, at: int, deleted: int, inserted: str) -> None:
        """Replace `deleted` characters from `at` on; places beyond the text mean its end."""
        at = max(0, min(at, self.n_chars))
        deleted = max(0, min(deleted, self.n_chars - at))
        if not deleted and not inserted:
            return
        if not self.n_chars:
            self.reencoded += len(inserted)
            self._replace(0, 0, 0, len(self.leaves[0]), self.counter.split.findall(inserted))
            return
        leaf, i, start = self._find(max(at - 1, 0))
        while (back := self._before(leaf, i)) and ((text := self.leaves[back[0]][back[1]]).isspace() or text[-1] == "'"):
            leaf, i = back
            start -= len(text)
        # Old pre-tokens behind the edit, as many as it takes.
        old, ends, where = [], [], []  # text, end in the old text, place after it
        k, j, end = leaf, i, start
        more, want = True, 0
        while True:
            want = 2 * want or AHEAD
            while more and (end < at + deleted or len([e for e in ends if e > at + deleted]) < want):
                while k < len(self.leaves) and j >= len(self.leaves[k]):
                    k, j = k + 1, 0
                if k >= len(self.leaves):
                    more = False
                    break
                old.append(self.leaves[k][j])
                end += len(old[-1])
                j += 1
                ends.append(end)
                where.append((k, j))
            region = "".join(old)
            new_text = region[: at - start] + inserted + region[at + deleted - start :]
            shift = len(inserted) - deleted
            places = {e + shift - start: w for e, w in zip(ends, where, strict=True) if e >= at + deleted}
            tokens, stop = [], None
            for m in self.counter.split.finditer(new_text):
                if m.end() == len(new_text) and more:
                    break
                tokens.append(m[0])
                if m.end() >= at - start + len(inserted) and m.end() in places:
                    stop = places[m.end()]
                    break
            if stop is None and not more:
                stop = where[-1]
            if stop is not None:
                break
        self.reencoded += sum(map(len, tokens))
        self._replace(leaf, i, *stop, tokens)

    def text(self) -> str:
        return "".join(t for leaf in self.leaves for t in leaf)

    def pack(self) -> tuple[bytes, bytes]:
        lengths = np.array([len(t) for leaf in self.leaves for t in leaf], "<u4")
        return lengths.tobytes(), np.array([c for leaf in self.counts for c in leaf], "<u4").tobytes()


def build_trees(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(id, text, lengths, counts), with `carry` also the input row without its text as a struct `row`: characters and tokens of each pre-token, little-endian unsigned 32-bit.

    A null text counts as empty; null ids and repeated rows are kept.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = loaded(Counter, ranks)
        packed = []
        for text in batch.column(1).to_pylist():
            tokens = counter.split.findall(text)
            packed.append((np.fromiter(map(len, tokens), "<u4", len(tokens)).tobytes(), np.fromiter(map(counter.count, tokens), "<u4", len(tokens)).tobytes()))
        lengths, counts = zip(*packed, strict=True) if packed else ((), ())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths, pa.binary()), pa.array(counts, pa.binary()), *batch.columns[2:]], ["id", "text", "lengths", "counts", "row"][: 2 + batch.num_columns])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([row_struct(docs.drop(text_col))] if carry else []))
    return map_rows(rows, run, with_row(TREES, rows), rows=128)


def apply_edits(trees: DataFrame, ranks: str, edits_col: str = "row.edits") -> DataFrame:
    """Apply each row's edits, array<struct<at: long, deleted: long, inserted: string>>, in order.

    Returns the edited text and tree, the counts before and after, and how many characters were encoded anew.
    A null array is no edit, a null place is 0, a null length deletes nothing, a null text inserts nothing.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = loaded(Counter, ranks)
        out = []
        for row in batch.to_pylist():
            lengths, counts = np.frombuffer(row["lengths"], "<u4"), np.frombuffer(row["counts"], "<u4")
            ends = np.cumsum(lengths, dtype=np.int64)
            tree = TokenTree([row["text"][b - n : b] for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)], counts.tolist(), counter)
            before, edits = tree.n_tokens, row["edits"] or []
            for e in edits:
                if e:
                    tree.edit(e["at"] or 0, e["deleted"] or 0, e["inserted"] or "")
            out.append((row["id"], tree.text(), *tree.pack(), before, tree.n_tokens, len(edits), tree.reencoded))
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate(kinds)], ["id", "text", "lengths", "counts", "n_before", "n_tokens", "n_edits", "reencoded_chars"])

    return map_rows(trees.select("id", "text", "lengths", "counts", F.col(edits_col).alias("edits")), run, EDITED, rows=128)
