import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import packing
from quarry.llm.chunked import WordPieces

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY, OWN = Tokenizer.from_file(PATH), WordPieces(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aZé'ÉßİΣσ 's't\n\t\x1c\x85 |<>endoftext.,%1²½́ǅ"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_chunks_encode_as_whole_texts(text):
    assert np.frombuffer(OWN.encode([text.encode()])[0], "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_special_tokens_and_small_cache(monkeypatch):
    import quarry.llm.chunked as chunked

    monkeypatch.setattr(chunked, "CACHE_CHUNKS", 5)
    own = WordPieces(PATH)
    for t in ("a <|endoftext|> b<|startoftext|>c", "Don't can't WE'LL x's", " ".join(f"w{i}" for i in range(50)), ""):
        for _ in range(2):
            assert np.frombuffer(own.encode([t.encode()])[0], "<u4").tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


def test_cache_is_asked_once_for_a_chunk():
    """The large cache is asked for distinct chunks of a batch, not for each word."""
    import quarry.llm.chunked as chunked

    class Counting(chunked.ChunkCache):
        asked = 0

        def get(self, key, default=None):
            Counting.asked += 1
            return super().get(key, default)

        def holds(self, key):
            Counting.asked += 1
            return super().holds(key)

    own = WordPieces(PATH)
    own.cache = Counting()
    texts = ["alpha beta, Gamma " * 300, "beta, delta " * 200, ""]
    for _ in range(2):
        Counting.asked = 0
        got = own.encode([t.encode() for t in texts])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
        assert Counting.asked <= 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 2048), max_size=200))
def test_windows_hold_every_item_once(sizes):
    sizes = np.array(sizes, np.int64)
    windows = packing.pack(sizes)
    assert sorted(np.concatenate(windows).tolist() if windows else []) == list(range(len(sizes)))
    assert all(sizes[w].sum() <= 2048 for w in windows)


def test_differencing_is_near_equal():
    # Two-way: the method leaves a difference of two here (8 7 | 6 5 4 -> 14 | 16).
    window, worst = packing.difference(np.array([8, 7, 6, 5, 4]), 2)
    assert worst == 16 and sorted(np.bincount(window, [8, 7, 6, 5, 4])) == [14, 16]


def test_documents(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(["alpha", "Beta,", "été", "x1"]) for _ in range(rnd.choice([0, 5, 300, 900, 5000])))) for i in range(60)]
    rows += [(60, None), (61, ""), (None, "no id"), (5, rows[5][1]), (62, "long " * 30000)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, bucket int, length string")
    got = packing.pack_documents(df, PATH).toPandas()
    by = {}
    for d, t in rows:
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1]
        by.setdefault(d, []).append(ids)
    seen = {}
    for r in got.itertuples():
        d = None if r.doc_id != r.doc_id else int(r.doc_id)
        ids = by[d][0]
        assert r.doc_tokens == len(ids)
        assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        seen.setdefault(d, []).append((r.start, r.length))
    for d, all_ids in by.items():
        at = 0
        pieces = sorted(set(seen[d]))
        assert len(seen[d]) == len(pieces) * len(all_ids)
        for a, n in pieces:
            assert a == at
            at += n
        assert at == len(all_ids[0])
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()] and g.length.sum() <= 2048
    fill = got.length.sum() / 2048 / got.sequence_id.nunique()
    assert fill > 0.95


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
