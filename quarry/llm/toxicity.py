"""Toxic spans by a linear-chain conditional random field over words.

Labels say only which documents are toxic, not which words.  So the field's tags are latent and a document's label
constrains them: in a clean document no word is toxic, in a toxic one at least one is.  With Z a chain's partition
function and all scores of the clean tag fixed at zero, a document is clean with probability 1 / product of Z over its
chains; the likelihood of the labels has the gradient of forward-backward marginals, scaled by a factor per document.
Words, their beginnings and ends are features, so word families are learnt as well as single words.

A text's chains are its sentences, all of them.  Forward and backward passes give each word's marginal; a
document's score is its highest one, and runs of words at or above one half are the offending spans.
"""

from __future__ import annotations

import gc
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fold, map_rows, materialize, row_struct, text_bytes, with_row

#: At most so many labelled texts of each class are learnt from, chosen by hashes of id and text, and only texts of at most
#: TRAINING_CHARS characters: longer ones say too little about which of their words counts.  All texts are scored whole.
SAMPLE_TOXIC = 2_000
SAMPLE_CLEAN = 3_500
TRAINING_CHARS = 20_000
STEPS = 90
FOLDS = 5
SLOTS = 1 << 17

_WORD = re.compile(r"[^\W_]+|[.!?\n]")
_STOPS = ".!?\n"


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text) if w not in _STOPS]


def _slot(kind: str, value: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}={value}") % SLOTS


def word_slots(word: str) -> list[int]:
    """What a word tells about itself: its identity, its beginnings and ends and its size (it comes in lower case)."""
    heads = [_slot("head", word[:n]) for n in range(3, 8) if n <= len(word)]
    tails = [_slot("tail", word[-n:]) for n in range(3, 6) if n <= len(word)]
    return [_slot("word", word), *heads, *tails, _slot("size", str(min(len(word), 12)))]


class SpanField:
    """Weights of the toxic tag's log-odds: per feature slot and for any word, and the transitions' log potentials."""

    def __init__(self, slots: np.ndarray, transition: np.ndarray, start: np.ndarray, bias: float = 0.0):
        self.slots, self.transition, self.start, self.bias = slots, transition, start, bias
        self.clear()

    def clear(self) -> None:
        """Forget the words met so far; number 0 stands for sentence ends."""
        self.number: dict[str, int] = dict.fromkeys(_STOPS, 0)
        self.odds: list[float] = [0.0]

    def numbers(self, words: list[str]) -> list[int]:
        known = self.number
        try:
            return [known[w] for w in words]
        except KeyError:
            for w in {w for w in words if w not in known}:
                known[w] = len(self.odds)
                self.odds.append(self.bias + float(self.slots[word_slots(w.lower())].sum()))
            return [known[w] for w in words]

    def marginals(self, odds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Marginal of the toxic tag at each place of the chains that lie one after another."""
        out = np.zeros(len(odds))
        for _, place, row, own, where in chain_groups(lengths):
            grid = np.zeros((int(own.max()), len(own)))
            grid[place, row] = odds[where]
            out[where] = chain_pass(grid, own, self.transition, self.start)[0][place, row]
        return out


def chain_groups(lengths: np.ndarray):
    """Chains of like length together: yields (chains, place, row, lengths, where each word lies) of each group."""
    begin = np.cumsum(lengths) - lengths
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    at = 0
    while at < len(order):
        longest = max(8, 2 * int(lengths[order[at]]))
        upto = at + int(np.searchsorted(lengths[order[at:]], longest, "right"))
        upto = min(upto, at + max(1, (1 << 20) // longest))
        group = order[at:upto]
        own = lengths[group]
        row = np.repeat(np.arange(len(group)), own)
        place = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own)
        yield group, place, row, own, np.repeat(begin[group], own) + place
        at = upto


#: The field of this worker process, with the words it has met: one, whichever task comes.
_HELD: list = []


def _worker_field(name: int, model: tuple) -> SpanField:
    if not _HELD or _HELD[0] != name:
        _HELD[:] = [name, SpanField(*model)]
    return _HELD[1]


def chain_pass(odds: np.ndarray, lengths: np.ndarray, transition: np.ndarray, start: np.ndarray, counts: bool = False):
    """Forward and backward pass over chains (places x chains) by the ratio of the two tags' messages.

    odds: log-odds of tag 1 at each place.  Returns the marginals of tag 1 and, with `counts`, log Z of each chain and
    its expected transitions by (from, to), 4 x chains.
    """
    width, n = odds.shape
    weight = np.exp(np.clip(odds, -40, 40))
    t = np.exp(transition)
    forward, backward = np.empty_like(weight), np.ones_like(weight)
    forward[0] = np.exp(start[1] - start[0]) * weight[0]
    log_z = np.full(n, float(start[0]))
    for k in range(1, width):
        g = forward[k - 1]
        rest = t[0, 0] + t[1, 0] * g
        forward[k] = weight[k] * (t[0, 1] + t[1, 1] * g) / rest
        if counts:
            log_z += np.where(lengths > k, np.log(rest), 0)
    for k in range(width - 2, -1, -1):
        b = weight[k + 1] * backward[k + 1]
        backward[k] = np.where(lengths > k + 1, (t[1, 0] + t[1, 1] * b) / (t[0, 0] + t[0, 1] * b), 1.0)
    ratio = forward * backward
    marginal = ratio / (1 + ratio)
    if not counts:
        return marginal, None, None
    log_z += np.log1p(forward[lengths - 1, np.arange(n)])
    pairs = np.zeros((4, n))
    for k in range(1, width):
        g, b = forward[k - 1], weight[k] * backward[k]
        joint = np.stack([np.full(n, t[0, 0]), t[0, 1] * b, t[1, 0] * g, t[1, 1] * g * b])
        pairs += np.where(lengths > k, joint / joint.sum(0), 0)
    return marginal, log_z, pairs


def fit_field(texts: list[str], labels: list[int], steps: int = STEPS, rate: float = 0.2, l2: float = 1e-5) -> SpanField:
    """Maximum likelihood of the documents' labels with Adam; both classes weigh the same.

    Free are the slots' weights, the bias, the transitions but from clean to clean, and the start.
    """
    types: dict[str, int] = {}
    words, lengths, doc_of = [], [], []
    for d, text in enumerate(texts):
        size = 0
        for w in [*_WORD.findall(text), "."]:
            if w in _STOPS:
                if size:
                    lengths.append(size)
                    doc_of.append(d)
                size = 0
            else:
                words.append(types.setdefault(w.lower(), len(types)))
                size += 1
    words, lengths, doc_of = np.array(words, np.int32), np.array(lengths, np.int64), np.array(doc_of, np.int64)
    slots = [word_slots(w) for w in types]
    of_type, slots = np.repeat(np.arange(len(types), dtype=np.int32), list(map(len, slots))), np.array([x for own in slots for x in own], np.int32)
    toxic = np.array(labels) == 1
    share = np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum()))
    groups = list(chain_groups(lengths))
    w = np.zeros(SLOTS + 5)  # then the bias, transitions (0, 1), (1, 0), (1, 1), start
    w[SLOTS] = -5.0
    m, v = np.zeros_like(w), np.zeros_like(w)

    def parts(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.array([[0.0, w[SLOTS + 1]], [w[SLOTS + 2], w[SLOTS + 3]]]), np.array([0.0, w[SLOTS + 4]])

    for k in range(1, steps + 1):
        odds = (np.bincount(of_type, w[slots], minlength=len(types)) + w[SLOTS])[words]
        transition, start = parts(w)
        log_z = np.zeros(len(lengths))
        marginal, edges, first = np.zeros(len(words)), np.zeros((4, len(lengths))), np.zeros(len(lengths))
        for chains, place, row, own, where in groups:
            grid = np.zeros((int(own.max()), len(own)))
            grid[place, row] = odds[where]
            p, z, pairs = chain_pass(grid, own, transition, start, counts=True)
            marginal[where], log_z[chains], edges[:, chains], first[chains] = p[place, row], z, pairs, p[0]
        clean = np.exp(-np.bincount(doc_of, log_z, minlength=len(texts)))  # no word is toxic
        # Expected features: those of a toxic document given that some word is, less those without that condition.
        factor = np.where(toxic, -clean / np.maximum(1 - clean, 1e-12), 1.0) * share
        by_chain = factor[doc_of]
        by_type = np.bincount(words, marginal * np.repeat(by_chain, lengths), minlength=len(types))
        g = np.concatenate([np.bincount(slots, by_type[of_type], minlength=SLOTS) + l2 * w[:SLOTS], [by_type.sum()], edges[1:] @ by_chain, [first @ by_chain]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate / np.sqrt(1 + k / 20) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return SpanField(w[:SLOTS], *parts(w), float(w[SLOTS]))


def _sample(docs: DataFrame, told: DataFrame, value: int, most: int) -> DataFrame:
    """At most `most` texts of labelled rows; equal texts once, so that copies don't pass for evidence."""
    ids = told.where(F.col("label") == value).select("id")
    n = ids.count()
    if n > 2 * most:
        ids = ids.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * (2 * most / n)))
    own = docs.join(F.broadcast(ids), "id", "left_semi").where(F.octet_length("text") <= TRAINING_CHARS).select("text").distinct()
    return own.orderBy(F.xxhash64("text")).limit(most).withColumn("label", F.lit(value))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN
) -> SpanField | None:
    """Learn from labelled rows outside fold 0; None without texts of both labels.

    Null ids and labels are no labels; an id labelled both ways counts as neither.  The driver gets at most `toxic` + `clean`
    texts of TRAINING_CHARS bytes at most, whatever the input's size.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    told = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("l"))
    told = told.where(fold("id", FOLDS) != 0).groupBy("id").agg(F.min("l").alias("label"), F.max("l").alias("most")).where("label = most").select("id", "label")
    told = materialize(told, "told")
    got = _sample(rows, told, 1, toxic).unionByName(_sample(rows, told, 0, clean)).toArrow()
    texts, marks = [t.decode("utf-8", "replace") for t in got.column("text").to_pylist()], got.column("label").to_pylist()
    if not any(words_of(t) for t, x in zip(texts, marks, strict=True) if x) or 0 not in marks:
        return None
    return fit_field(texts, marks)


def tag_toxicity(docs: DataFrame, field: SpanField | None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(id, score, spans), with `carry` also the whole input row as a struct `row`: spans are begin, end (in characters) and marginal of toxic runs, in order.

    Texts without words, null ones included, and all texts without a model score 0.  Null ids are kept.
    """
    model = (field.slots.astype(np.float32), field.transition, field.start, field.bias) if field else None
    name = xxhash.xxh64_intdigest(b"".join(np.asarray(x).tobytes() for x in model)) if model else 0
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        score, spans = np.zeros(n), [[] for _ in range(n)]
        if model and n:
            field = _worker_field(name, model)
            if len(field.odds) > 200_000:
                field.clear()
                gc.collect()
            texts = [t.decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            words = [field.numbers(_WORD.findall(t)) for t in texts]
            sizes = np.array([len(w) + 1 for w in words])  # one more: the text's end
            number = np.fromiter((x for w in words for x in (*w, 0)), np.int64, int(sizes.sum()))
            inside = number > 0
            odds = np.array(field.odds)[number]
            chain = np.cumsum(~inside)
            lengths = np.bincount(chain[inside], minlength=int(chain[-1]) + 1)
            p = np.zeros(len(number))
            p[inside] = field.marginals(odds[inside], lengths)
            ends = np.cumsum(sizes)
            score = np.maximum.reduceat(p, ends - sizes)
            hits = p >= 0.5
            for k in np.flatnonzero(np.logical_or.reduceat(hits, ends - sizes)).tolist():
                own = slice(int(ends[k] - sizes[k]), int(ends[k]) - 1)
                spans[k] = _spans(texts[k], hits[own], p[own])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(spans, span), *batch.columns[2:]], ["id", "score", "spans", "row"][: 1 + batch.num_columns])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"), *([row_struct(docs)] if carry else []))
    return map_rows(rows, run, with_row("id long, score double, spans array<struct<begin:bigint,end:bigint,marginal:double>>", rows), rows=256)


def _spans(text: str, hits: np.ndarray, p: np.ndarray) -> list[dict]:
    """Runs of words that are hits, with their places in the text."""
    out: list[dict] = []
    before = -1
    for i, m in enumerate(_WORD.finditer(text)):
        if hits[i]:
            if before == i - 1 and before >= 0:
                out[-1] |= {"end": m.end(), "marginal": max(out[-1]["marginal"], float(p[i]))}
            else:
                out.append({"begin": m.start(), "end": m.end(), "marginal": float(p[i])})
            before = i
    return out
