"""SentencePiece models: both libraries agree, and texts come back."""

import hashlib
import struct

import pyarrow.parquet as pq
import pytest
import sentencepiece

from mergrove.llm import queries
from mergrove.llm import sentencepieces as sp

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ODD = ["", " ", "  a  b ", "\n\n x\n", "<s> </s> <0x0A> <unk>", "\U0001f600 é́ \x00 �", "a" * 50, "  " * 50 + "x   ", "tab\tcr\r\nend ", "ünï çødé", "日本語 text", "x\n y \n\nz"]


def field(number, wire, value):
    out, key = b"", number << 3 | wire

    def varint(n):
        piece = b""
        while n > 127:
            piece += bytes([n & 127 | 128])
            n >>= 7
        return piece + bytes([n])

    out = varint(key)
    return out + (varint(value) if wire == 0 else varint(len(value)) + value if wire == 2 else value)


def unigram(byte_fallback=True, trim=False):
    """A small model written by hand."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if byte_fallback:
        pieces += [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    words = ["▁", "▁the", "▁a", "th", "e", "t", "h", "a", "b", "▁ab", "ab", "ba", "▁b", "he", "bab", "▁▁", "."]
    pieces += [(w, -1.5 - i * 0.37, 1) for i, w in enumerate(words)]
    raw = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, k)) for p, s, k in pieces)
    raw += field(2, 2, field(3, 0, 1) + field(35, 0, int(byte_fallback)) + field(4, 0, len(pieces)))
    return raw + field(3, 2, field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, int(trim)) + field(5, 0, 1))


def test_bpe_model_matches_the_library():
    model = sp.Model.parse(sp.read_model(MODEL))
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert (model.kind, len(model.pieces), model.byte_fallback, model.splits, model.line_breaks) == (sp.BPE, own.get_piece_size(), True, True, True)
    codec = sp.Codec(model)
    blobs, agree, back = codec.encode([*ODD, None])
    assert [list(memoryview(b).cast("i")) for b in blobs] == own.encode([*ODD, ""]) and all(agree)
    assert codec.decode(blobs) == [*ODD, ""] and all(back)
    with_control = [[1, *i, 2] for i in own.encode(ODD)]
    assert codec.decode(with_control) == [own.decode(i) for i in with_control]
    whole = model.tokenizer()
    assert [whole.encode(t, add_special_tokens=False).ids for t in ODD] == own.encode(ODD)
    assert [whole.decode(i) for i in own.encode(ODD)] == [own.decode(i) for i in own.encode(ODD)]


@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("trim", [True, False])
def test_unigram_model_matches_the_library(fallback, trim):
    raw = unigram(fallback, trim)
    own = sentencepiece.SentencePieceProcessor(model_proto=raw)
    model = sp.Model.parse(raw)
    codec = sp.Codec(model)
    texts = ["the ab a.", "thebab  abab", "bbb aaa the.the", "x é the", "", "a  b", " the ", "ab\nba"]
    blobs, agree, back = codec.encode(texts)
    assert [list(memoryview(b).cast("i")) for b in blobs] == own.encode(texts) and all(agree)
    if fallback:
        assert codec.decode(blobs) == [codec.normalise(t) for t in texts] and all(back)
    else:
        assert back == [own.decode(own.encode(t)) == codec.normalise(t) for t in texts] and not all(back)
        assert codec.decode([[3, 0], [0]]) == [own.decode([3, 0]), own.decode([0])[1:]]


def test_whole_documents_match_the_library():
    """Ids are those that the tokenizers library gives by itself; whole texts go through the other library uncut."""
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for verify in (True, False):
        codec = sp.Codec(sp.Model.parse(sp.read_model(MODEL)), verify=verify)
        blobs, agree, back = codec.encode(texts)
        assert [list(memoryview(b).cast("i")) for b in blobs] == own.encode([t or "" for t in texts]) and all(agree)
        assert codec.decode(blobs) == [t or "" for t in texts] and all(back)


def test_a_wrong_backend_shows():
    """The library is a check and no more: a model that tokenizers reads otherwise gives other ids and no parity."""
    raw = unigram()
    codec = sp.Codec(sp.Model.parse(raw))
    codec.core = sp.Model.parse(raw.replace(struct.pack("<f", -1.5 - 0.37), struct.pack("<f", -90.0))).core()  # of the piece for "the"
    blobs, agree, back = codec.encode(["the ab", "ab"])
    own = sentencepiece.SentencePieceProcessor(model_proto=raw)
    assert agree == [False, True] and list(memoryview(blobs[0]).cast("i")) != own.encode("the ab") and list(memoryview(blobs[1]).cast("i")) == own.encode("ab")


def test_round_trip_is_of_the_whole_list():
    codec = sp.Codec(sp.Model.parse(unigram()))
    assert codec.encode(["the ab", "ab"])[2] == [True, True]
    codec.ids["▁the"] = codec.ids["▁ab"]
    assert codec.encode(["the ab", "ab"])[2] == [False, True]


def test_bytes_of_a_marker_stay_one():
    model = sp.Model.parse(sp.read_model(MODEL))
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    byte = {k: model.pieces.index(f"<0x{k:02X}>") for k in (0x0A, 0xE2, 0x96, 0x81, 0xC3)}
    lists = [[byte[0xE2], byte[0x96], byte[0x81], 263], [263, byte[0x0A], 263], [263, byte[0xC3], 263], []]
    assert sp.Codec(model).decode(lists) == [own.decode(i) for i in lists] and "▁" in own.decode(lists[0])


def test_query_returns_the_ids(spark):
    folder = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = queries.op1_sentencepiece(spark, folder).collect()
    assert {r.doc_id: list(r.ids) for r in got} == {i: own.encode(t) for i, t in text.items()}
    assert all(r.ids_sha256 == hashlib.sha256(struct.pack(f"<{r.n_tokens}i", *r.ids)).hexdigest() and r.round_trip for r in got)


def test_cache_limit_changes_nothing():
    model = sp.Model.parse(sp.read_model(MODEL))
    small, large = sp.Codec(model, cache=3), sp.Codec(model)
    for _ in range(3):
        assert small.encode(ODD) == large.encode(ODD)


def test_not_a_model(tmp_path):
    with pytest.raises(ValueError):
        sp.Model.parse(b"\xff\xff\xff\x01garbage")
    (tmp_path / "big").write_bytes(b"x" * 100)
    with pytest.raises(ValueError):
        sp.read_model(str(tmp_path / "big"), 10)
    with pytest.raises(ValueError):
        sp.Model.parse(field(2, 2, field(3, 0, 3)))


def codec_text(raw, ids):
    return sentencepiece.SentencePieceProcessor(model_proto=raw).decode(ids)


def test_frames(spark):
    raw = sp.read_model(MODEL)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a"), (3, None), (3, None), (50, "word " * 60000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as n_tokens")
    out = sp.encode(df, raw)
    got = sp.decode(out, raw).collect()
    assert len(got) == len(rows) and all(r.round_trip and r.parity and len(r.ids) == r.n_tokens for r in got)
    assert sorted(str((r.id, r.text)) for r in got) == sorted(str((i, t or "")) for i, t in rows)
    assert sp.encode(spark.createDataFrame([], "doc_id long, text string"), raw).count() == 0
    odd = sp.decode(spark.createDataFrame([(None, "x", "old"), ([], "y", "old"), ([None, 263], "z", "old")], "ids array<int>, TEXT string, text string"), raw)
    assert odd.columns == ["ids", "TEXT", "text"] and [(r[1], r[2]) for r in odd.collect()] == [("x", None), ("y", ""), ("z", codec_text(raw, [263]))]
