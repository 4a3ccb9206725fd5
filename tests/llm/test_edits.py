import hashlib
import random

import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import edits, queries

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
COUNTER = edits.Counter(RANKS)
TEXT = st.text(alphabet=st.sampled_from("ab's \n\t1!é²\x1c 　d"), max_size=40)


@pytest.mark.parametrize("leaf", [3, 64])
@settings(max_examples=400, deadline=None)
@given(text=TEXT, changes=st.lists(st.tuples(st.integers(0, 45), st.integers(0, 12), TEXT), max_size=8))
def test_counts_follow_edits(leaf, text, changes):
    kept, edits.LEAF = edits.LEAF, leaf
    try:
        tree = edits.TokenTree.of(text, COUNTER)
        for at, deleted, inserted in changes:
            at = min(at, len(text))
            text = text[:at] + inserted + text[at + deleted :]
            tree.edit(at, deleted, inserted)
            assert tree.text() == text
            assert [t for part in tree.leaves for t in part] == COUNTER.split.findall(text)
            assert tree.n_tokens == len(COUNTER.library.encode_ordinary(text)) and tree.n_chars == len(text)
    finally:
        edits.LEAF = kept


@pytest.mark.parametrize("text, at, deleted, inserted", [("they'r", 6, 0, "e"), ("we'v", 4, 0, "e"), ("x'l", 3, 0, "l"), ("they'r!e", 6, 1, ""), ("a 'v", 4, 0, "e"), ("a' 'l", 5, 0, "l")])
def test_contractions(text, at, deleted, inserted):
    tree = edits.TokenTree.of(text, COUNTER)
    tree.edit(at, deleted, inserted)
    text = text[:at] + inserted + text[at + deleted :]
    assert [t for part in tree.leaves for t in part] == COUNTER.split.findall(text)
    assert tree.n_tokens == len(COUNTER.library.encode_ordinary(text))


LETTERS = st.text(alphabet=st.sampled_from("revlRE'' \n!1"), max_size=40)


@settings(max_examples=800, deadline=None)
@given(text=LETTERS, changes=st.lists(st.tuples(st.integers(0, 45), st.integers(0, 3), LETTERS.map(lambda t: t[:3])), max_size=8))
def test_contractions_follow_edits(text, changes):
    tree = edits.TokenTree.of(text, COUNTER)
    for at, deleted, inserted in changes:
        at = min(at, len(text))
        text = text[:at] + inserted + text[at + deleted :]
        tree.edit(at, deleted, inserted)
        assert [t for part in tree.leaves for t in part] == COUNTER.split.findall(text)
        assert tree.n_tokens == len(COUNTER.library.encode_ordinary(text))


def test_little_is_encoded_anew():
    rnd = random.Random(1)
    text = " ".join("word%d" % rnd.randrange(999) for _ in range(20000))
    tree = edits.TokenTree.of(text, COUNTER)
    for _ in range(50):
        tree.edit(rnd.randrange(len(text)), 5, "new text")
    assert tree.n_tokens == len(COUNTER.library.encode_ordinary(tree.text()))
    assert tree.reencoded < 50 * 60


def test_query_against_full_encoding(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(["one", "two's", "\n\n", "é!"]) for _ in range(rnd.randint(0, 400)))) for i in range(40)] + [(90, None), (91, ""), (None, "no id"), (3, "again"), (92, "long " * 40000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.tokens_before, r.tokens_after, r.edited_sha256) for r in queries.op7_edit_counts(spark, str(tmp_path)).collect())

    def place(doc, k, length):
        """Spark's hash of a long, then of an int with the first as its seed."""
        first = xxhash.xxh64_intdigest((-1 if doc is None else doc).to_bytes(8, "little", signed=True), 42)
        h = xxhash.xxh64_intdigest(k.to_bytes(4, "little"), first)
        return (h - 2**64 if h >> 63 else h) % (length + 1)

    want = []
    for d, t in rows:
        t = t or ""
        n, e = len(t), t
        for k, gone, new in ((1, 7, " revised, once"), (2, 0, "   \nA new line 42"), (3, 40, "")):
            at = min(place(d, k, n), len(e))
            e = e[:at] + new + e[at + gone :]
        want.append((-1 if d is None else d, len(COUNTER.library.encode_ordinary(t)), len(COUNTER.library.encode_ordinary(e)), hashlib.sha256(e.encode()).hexdigest()))
    assert got == sorted(want)


def test_odd_edits(spark):
    rows = [(1, "abc", [(None, None, None), None, (99, 5, "!")]), (2, None, [(0, 0, "x")]), (3, "abc", None), (4, "abc", [(-5, 1, None)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<at:long,deleted:long,inserted:string>>")
    trees = edits.build_trees(df, RANKS, carry=True)
    assert sorted((r.id, r.text) for r in edits.apply_edits(trees, RANKS).collect()) == [(1, "abc!"), (2, "x"), (3, "abc"), (4, "bc")]
    assert edits.apply_edits(trees.limit(0), RANKS).count() == 0
