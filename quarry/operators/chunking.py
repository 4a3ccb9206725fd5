"""Chunking documents: fixed windows natively; sentence and recursive packing, which are folds over a text, in Arrow functions."""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = ["\n\n", "\n", "。", ". ", " ", ""]
_STOPS = re.compile(r"[。！？\n.!?]")


def fixed_chunks(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Windows of `size` characters, each `size - overlap` after the one before, trimmed, blank ones dropped."""
    if overlap >= size:
        raise ValueError("overlap must be less than size")
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.filter(F.transform(starts, lambda i: trim(F.substr(text, i + 1, F.lit(size)))), lambda c: c != "")


Span = tuple[int, int]


def _packed(units: list[Span], size: int, overlap: int) -> Iterator[Span]:
    """Spans of as many neighbouring units as `size` holds; the next span begins at the first unit from which no more
    than `overlap` characters remain.  All lengths are distances in the text, so what lies between units counts; a span that
    keeps no unit of the one before also counts what lies between them."""
    starts = [a for a, _ in units]
    first = before = 0
    for i, (_, end) in enumerate(units):
        if i > first and end - starts[first] + before > size:
            last = units[i - 1][1]
            yield starts[first], last
            first = bisect.bisect_left(starts, last - overlap, first, i)
            before = starts[i] - last if first == i else 0
    if units:
        yield starts[first], units[-1][1]


def _runs(units: Iterable[Span], size: int) -> Iterator[tuple[bool, list[Span]]]:
    """Units in runs: those that fit a chunk, and those longer than one."""
    for long, run in itertools.groupby(units, key=lambda u: u[1] - u[0] > size):
        yield long, list(run)


def sentence_pieces(text: str | None, size: int, overlap: int) -> list[str]:
    """Whole sentences up to `size`; an overlong one is cut hard; trailing sentences up to `overlap` open the next chunk."""
    text = text or ""
    ends = sorted({m.end() for m in _STOPS.finditer(text)} | {len(text)} - {0})
    out: list[str] = []
    for long, run in _runs(zip([0, *ends], ends, strict=False), size):
        if long:
            cuts = (text[i : min(i + size, b)].strip() for a, b in run for i in range(a, b, size - overlap))
            out += filter(None, cuts)
        else:
            out += (text[a:b].strip() for a, b in _packed(run, size, overlap))
    return out


def _between(text: str, separator: str, begin: int, end: int) -> list[Span]:
    """What stands between the separators of a part of the text; its characters for the empty separator."""
    if not separator:
        return [(i, i + 1) for i in range(begin, end)]
    at = [m.span() for m in re.compile(re.escape(separator)).finditer(text, begin, end)]
    return list(zip([begin, *(b for _, b in at)], [*(a for a, _ in at), end], strict=True))


def recursive_pieces(text: str | None, size: int, overlap: int, separators: list[str]) -> list[str]:
    """Split at the coarsest separator, join up to `size`, and split what is still too long at the next one."""
    text = text or ""
    out: list[str] = []
    parts = [(0, len(text), 0)]  # a stack: the part of the text that comes first lies on top
    while parts:
        begin, end, level = parts.pop()
        if level < 0:  # a finished chunk
            out.append(text[begin:end].strip())
            continue
        finer = level + 1 < len(separators)
        found: list[tuple[int, int, int]] = []
        for long, run in _runs(_between(text, separators[level], begin, end), size if finer else len(text)):
            found += [(*u, level + 1) for u in run] if long else [(*u, -1) for u in _packed(run, size, overlap)]
        parts += reversed(found)
    return [c for c in out if c]


def chunk_documents(docs: DataFrame, strategy: str = "fixed", size: int = 500, overlap: int = 50, text_col: str = "text", separators: list[str] | None = None) -> DataFrame:
    """One row per chunk: the document's columns but for its text, content, chunk_index from 0, chunk_total, chunk_strategy."""
    if overlap >= size:
        raise ValueError("overlap must be less than size")
    if strategy == "fixed":
        pieces = fixed_chunks(F.col(text_col), size, overlap)
    elif strategy == "sentence":
        pieces = F.udf(lambda t: sentence_pieces(t, size, overlap), "array<string>", useArrow=True)(F.col(text_col))
    elif strategy == "recursive":
        order = separators or SEPARATORS
        pieces = F.udf(lambda t: recursive_pieces(t, size, overlap, order), "array<string>", useArrow=True)(F.col(text_col))
    else:
        raise ValueError(f"no such strategy: {strategy}")
    kept = [c for c in docs.columns if c != text_col]
    cut = docs.select(*kept, pieces.alias("pieces")).withColumn("chunk_total", F.size("pieces"))
    return cut.select(*kept, "chunk_total", F.posexplode("pieces").alias("chunk_index", "content")).withColumn("chunk_strategy", F.lit(strategy))
