import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
OWN = pieces.OffsetEncoder(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXT = st.text(alphabet=st.one_of(st.sampled_from("ab é\n\t▁ <s></unk>0x"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_ids_and_spans(text):
    ids, starts, ends = OWN.encode(text.encode())
    assert ids.tolist() == LIBRARY.encode(text)
    raw = text.encode()
    if len(ids) and "\0" not in text:
        assert starts[0] == 0 and ends[-1] == len(raw) and (starts[1:] == ends[:-1]).all()
        whole = OWN._encode_whole(raw)
        assert (whole[0] == ids).all() and (whole[1] == starts).all() and (whole[2] == ends).all()


def test_model_is_cut_at_spaces():
    assert OWN.cut_at_spaces
    for t in ("", " ", "  ", "a ", " a", "a  b", "   a   b   ", "\n \n", "x" * 3000):
        assert OWN.encode(t.encode())[0].tolist() == LIBRARY.encode(t)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ａＢ①㍿ｶﾞ 　 éﬁ½"), st.characters(exclude_categories=["Cs", "Cc"])), max_size=30))
def test_compiled_map_against_library(text):
    rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(rule.serialized_model_proto())
    own = pieces.Normalizer(model.normalizer_spec.precompiled_charsmap, False, False, False)
    got, align = own.normalize(text.encode())
    assert got.decode() == rule.normalize(text)
    assert len(align) == len(got) + 1 and align == sorted(align) and align[-1] == len(text.encode())


def test_documents(spark):
    rows = [(1, "Hello  wörld", 1), (2, None, 2), (3, "", None), (None, "x", 4), (1, "Hello  wörld", 1), (5, "long text " * 20000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = pieces.encode_documents(df, PATH).collect()
    assert sorted((r.id or 0, len(r.ids), r.decoded) for r in got) == sorted((d or 0, len(LIBRARY.encode(t or "")), t or "") for d, t, _ in rows)
    hello = next(r for r in got if r.id == 1)
    raw = "Hello  wörld".encode()
    assert b"".join(raw[a:b] for a, b in zip(hello.starts, hello.ends)) == raw
    assert pieces.encode_documents(df.limit(0), PATH).count() == 0
