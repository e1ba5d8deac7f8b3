"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protocol buffer, read here field by field.  From it come the normaliser (character map, extra
blanks, dummy prefix, the blank marker U+2581), the model (unigram scores, or BPE merges ranked by the scores of
what they make) with byte fallback, and the decoder.

Where no piece of the vocabulary has the marker after another character, text between such places is encoded
independently, so each distinct stretch is encoded once per worker, in multithreaded batches, and compared with
the sentencepiece library as it is first met.  What is decoded is each text's whole list of ids.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import take

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(buffer: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of one protocol-buffer message: number and value (integers, or raw bytes)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = buffer[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(buffer):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(wire) or (varint() if wire == 2 else None)
        if size is None or at + size > len(buffer):
            raise ValueError(f"not a SentencePiece model: field {number} of wire type {wire}")
        yield number, buffer[at : at + size]
        at += size


@dataclass(frozen=True)
class Model:
    """What a model file says."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    kind: int = UNIGRAM
    byte_fallback: bool = False
    char_map: bytes = b""
    dummy_prefix: bool = True
    trim_blanks: bool = True
    escape_blanks: bool = True
    raw: bytes = field(default=b"", repr=False, compare=False)

    @staticmethod
    def parse(raw: bytes) -> Model:
        pieces, scores, kinds, options = [], [], [], {}
        for number, value in _fields(raw):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    piece = v.decode() if n == 1 else piece
                    score = struct.unpack("<f", v)[0] if n == 2 else score
                    kind = v if n == 3 else kind
                pieces.append(piece)
                scores.append(score)
                kinds.append(kind)
            elif number == 2:
                names = {3: "kind", 35: "byte_fallback", 24: "suffix"}
                options |= {names[n]: v for n, v in _fields(value) if n in names}
            elif number == 3:
                names = {2: "char_map", 3: "dummy_prefix", 4: "trim_blanks", 5: "escape_blanks"}
                options |= {names[n]: v for n, v in _fields(value) if n in names}
        if options.pop("suffix", 0) or options.get("kind", UNIGRAM) not in (UNIGRAM, BPE) or not options.get("escape_blanks", 1):
            raise ValueError("only unigram and BPE models with escaped blanks as prefixes are read")
        flags = {k: bool(options.pop(k)) for k in ("byte_fallback", "dummy_prefix", "trim_blanks", "escape_blanks") if k in options}
        return Model(tuple(pieces), tuple(scores), tuple(kinds), raw=raw, **flags, **options)

    @cached_property
    def unknown(self) -> int:
        return self.kinds.index(UNKNOWN)

    @cached_property
    def merges(self) -> list[tuple[str, str]]:
        """BPE merges by the score of their result: every cut of a piece into two others."""
        own = {p for p, k in zip(self.pieces, self.kinds) if k in (NORMAL, USER_DEFINED, UNUSED)}
        ranked = sorted((i for i, k in enumerate(self.kinds) if k == NORMAL and len(self.pieces[i]) > 1), key=lambda i: (-self.scores[i], i))
        return [(p[:n], p[n:]) for p in (self.pieces[i] for i in ranked) for n in range(1, len(p)) if p[:n] in own and p[n:] in own]

    @cached_property
    def splits(self) -> bool:
        """Whether stretches that begin at a marker can be encoded apart: no piece has the marker after another character."""
        return not any(re.search(f"[^{MARK}]{MARK}", p) for p, k in zip(self.pieces, self.kinds) if k in (NORMAL, USER_DEFINED))

    @cached_property
    def line_breaks(self) -> bool:
        """Whether a line end stands alone too: it is not normalised away, is in no longer piece, and does not melt
        into one unknown piece with its neighbours."""
        return (self.byte_fallback or "\n" in self.pieces) and not self.char_map and not self.trim_blanks and not any("\n" in p for p in self.pieces if len(p) > 1)

    def core(self):
        """The tokenizers model, for text that is normalised already; its decoder is for lists of :attr:`ordinary` pieces."""
        from tokenizers import Tokenizer, decoders, models

        if self.kind == BPE:
            vocab = {p: i for i, p in enumerate(self.pieces)}
            out = Tokenizer(models.BPE(vocab, self.merges, unk_token=self.pieces[self.unknown], fuse_unk=True, byte_fallback=self.byte_fallback))
        else:
            out = Tokenizer(self._unigram())
        strip = [decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []
        out.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse(), decoders.Replace(MARK, " "), *strip])
        return out

    @cached_property
    def ordinary(self) -> np.ndarray:
        """The pieces among which markers may become blanks after all are joined: no byte of theirs begins a marker."""
        return np.array([k in (NORMAL, USER_DEFINED) or (k == BYTE and self.byte_fallback and p.upper() != "<0XE2>") for p, k in zip(self.pieces, self.kinds)])

    def _unigram(self):
        from tokenizers import models

        lowest = min(self.scores) - 10.0
        # control, byte and unused pieces never come from text: out of reach under a name no text has
        vocab = [(p if k in (NORMAL, USER_DEFINED) or (k == BYTE and self.byte_fallback) else f"{p}\0{i}", s if k in (NORMAL, USER_DEFINED) else lowest)
                 for i, (p, s, k) in enumerate(zip(self.pieces, self.scores, self.kinds))]
        return models.Unigram(vocab, self.unknown, self.byte_fallback)

    def tokenizer(self):
        """A whole tokenizers pipeline with the same normaliser, model and decoder."""
        from tokenizers import Regex, decoders, normalizers, pre_tokenizers

        out = self.core()
        steps = [normalizers.Precompiled(self.char_map)] if self.char_map else []
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()] if self.trim_blanks else []
        steps += [normalizers.Prepend(MARK)] if self.dummy_prefix else []
        out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        if self.splits:
            out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
        strip = [decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []
        names = [decoders.Replace(Regex("\0[0-9]+$"), "")] if self.kind == UNIGRAM else []
        names.append(decoders.Replace(self.pieces[self.unknown], " ⁇ "))
        out.decoder = decoders.Sequence([*names, decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
        return out


class Codec:
    """Encodes and decodes whole texts; keeps the ids of the stretches it has met (``cache`` of them at most)."""

    def __init__(self, model: Model, threads: int = 1, cache: int = 400_000, verify: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model, self.threads, self.limit = model, threads, cache
        self.core = model.core()
        self.cut = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if model.line_breaks else f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.ids: dict[str, bytes] = {}
        self.differ: set[str] = set()
        self.whole = model.tokenizer()
        self.silent = np.array([k == CONTROL for k in model.kinds])
        self.map = None
        if model.char_map:
            from tokenizers import normalizers

            self.map = normalizers.Precompiled(model.char_map)
        self.own = None
        if verify:
            import sentencepiece

            self.own = sentencepiece.SentencePieceProcessor(model_proto=model.raw)

    def normalise(self, text: str) -> str:
        """The text as the model sees it, without the dummy prefix and with plain blanks."""
        if self.map and text:
            text = self.map.normalize_str(text)
        return re.sub(" +", " ", text).strip(" ") if self.model.trim_blanks else text

    def stretches(self, text: str) -> list[str]:
        """A normalised text in pieces that are encoded apart."""
        if not text:
            return []
        marked = (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)
        return self.cut(marked) if self.model.splits else [marked]

    def _learn(self, new: list[str]) -> None:
        from array import array

        pack = lambda ids: array("i", ids).tobytes()
        got = [pack(e.ids) for e in self.core.encode_batch_fast(new, add_special_tokens=False)]
        if self.own:
            plain = [s.replace(MARK, " ") for s in new]
            if self.model.line_breaks:  # after a line end a stretch is as within a text
                skip = len(self.own.encode("\n"))
                want = [x[skip:] for x in self.own.encode(["\n" + s for s in plain], num_threads=self.threads)]
            else:  # the library adds the first marker itself
                want = self.own.encode([s[1:] if self.model.dummy_prefix else s for s in plain], num_threads=self.threads)
            for s, mine, theirs in zip(new, got, map(pack, want)):
                if s == MARK and not self.model.line_breaks:  # a blank at a text's end; alone it is no text to the library
                    theirs = pack(self.own.encode("a ")[len(self.own.encode("a")) :])
                if mine != theirs:
                    self.differ.add(s)
        self.ids.update(zip(new, got))

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[bool], list[bool]]:
        """For each text its ids as 32-bit little-endian integers, from the tokenizers library; whether the
        sentencepiece library has the same for all of it; and whether its whole list of ids, decoded, is the text as normalised."""
        shown = [self.normalise(t or "") for t in texts]
        cut = [self.stretches(t) for t in shown]
        met = set().union(*cut)
        if len(self.ids) > self.limit:
            # those at hand stay, and the quarter learned last
            late = dict(islice(self.ids.items(), len(self.ids) - len(self.ids) // 4, None))
            late.update((s, self.ids[s]) for s in met if s in self.ids)
            self.ids = late
            self.differ = {s for s in self.differ if s in late}
        new = [s for s in met if s not in self.ids]
        for at in range(0, len(new), 20_000):
            self._learn(new[at : at + 20_000])
        find = self.ids.__getitem__
        agree = [True] * len(cut) if not self.differ else [self.differ.isdisjoint(c) for c in cut]
        blobs = [b"".join(map(find, c)) for c in cut]
        return blobs, agree, [x == t for x, t in zip(self.decode(blobs), shown)]

    def decode(self, many: list[bytes | list[int]]) -> list[str]:
        """The texts that lists of ids stand for; control pieces stand for nothing.  (An unknown piece that begins a text has no blank before it.)"""
        held: dict[bool, tuple[list, list]] = {True: ([], []), False: ([], [])}
        for at, ids in enumerate(many):
            numbers = np.frombuffer(ids, np.int32) if isinstance(ids, bytes) else np.array(ids, np.int64)
            if not (ordinary := bool(self.model.ordinary[numbers].all())):
                numbers = numbers[~self.silent[numbers]]
            places, lists = held[ordinary]
            places.append(at)
            lists.append(numbers.tolist())
        out = [""] * len(many)
        for ordinary, (places, lists) in held.items():
            for at, text in zip(places, (self.core if ordinary else self.whole).decode_batch(lists, skip_special_tokens=False)):
                out[at] = text
        return out


_HELD: dict[tuple, Codec] = {}


def _codec(raw: bytes, threads: int, verify: bool = True, cache: int = 400_000) -> Codec:
    """One codec a worker process and model."""
    key = (hashlib.sha1(raw).digest(), threads, verify, cache)
    if key not in _HELD:
        _HELD[key] = Codec(Model.parse(raw), threads, cache, verify)
    return _HELD[key]


def read_model(path: str, most: int = 64 << 20) -> bytes:
    """The model file; it goes to every worker, so its size is checked."""
    with open(path, "rb") as f:
        raw = f.read(most + 1)
    if len(raw) > most:
        raise ValueError(f"{path} has more than {most} bytes")
    return raw


def _chunks(column: pa.Array, most: int) -> Iterator[list[str | None]]:
    """Texts in lists of about ``most`` characters, so that one batch of long texts does not fill memory."""
    held, size = [], 0
    for t in column:
        held.append(t.as_py())
        size += len(held[-1] or "")
        if size > most:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", threads: int = 2, ids: bool = True, cache: int = 400_000, chunk: int = 4 << 20) -> DataFrame:
    """``(id, n_tokens, ids, ids_sha256, round_trip, parity)`` for every row (``ids=False`` leaves ``ids`` out).

    ``ids_sha256`` is over the ids as 32-bit little-endian integers; ``round_trip`` says that decoding gives the
    normalised text back; ``parity`` that the tokenizers and sentencepiece libraries agree.  Null texts count as
    empty and have no tokens; null ids, repeated rows and other columns change nothing; an empty table gives none.
    ``threads`` is how many threads of the tokenizers library a worker's batches use, ``cache`` how many stretches a worker
    remembers, ``chunk`` how many characters it takes at a time.  One narrow pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = take(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, threads, cache=cache)
        for batch in batches:
            at = 0
            for texts in _chunks(batch.column(1), chunk):
                blobs, agree, back = codec.encode(texts)
                sizes = pa.array([len(b) // 4 for b in blobs], pa.int64())
                out = [batch.column(0).slice(at, len(texts)), sizes]
                if ids:
                    ends = pc.cumulative_sum(sizes).cast(pa.int32())
                    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
                    flat = pa.Array.from_buffers(pa.int32(), offsets[-1].as_py(), [None, pa.py_buffer(b"".join(blobs))])
                    out.append(pa.ListArray.from_arrays(offsets, flat))
                out += [pa.array([hashlib.sha256(b).hexdigest() for b in blobs]), pa.array(back), pa.array(agree)]
                yield pa.RecordBatch.from_arrays(out, names)
                at += len(texts)

    names = ["id", "n_tokens", *(["ids"] if ids else []), "ids_sha256", "round_trip", "parity"]
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long{', ids array<int>' if ids else ''}, ids_sha256 string, round_trip boolean, parity boolean")


def decode(df: DataFrame, model: bytes, ids_col: str = "ids", text_col: str = "text", threads: int = 2) -> DataFrame:
    """``df`` with the text of its ids as a further column ``text_col``, in place of one of that very name.

    Null ids give a null text, no ids an empty one, null numbers within a list count for nothing; ids outside the model raise.
    Repeated rows and other columns change nothing, clashing names included; an empty table gives none.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = df.columns
    if ids_col not in names:
        raise ValueError(f"the input has no column {ids_col}; it has {names}")
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    at, out = names.index(ids_col), names.index(text_col) if text_col in names else len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, threads, False)
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            lists = batch.column(at).to_pylist()
            texts = codec.decode([[n for n in x if n is not None] for x in lists if x is not None])
            found = iter(texts)
            column = pa.array([None if x is None else next(found) for x in lists], pa.string())
            columns = batch.columns
            columns[out : out + 1] = [column]
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    fields = list(plain.schema.fields)
    fields[out : out + 1] = [T.StructField(f"c{out}", T.StringType())]
    return plain.mapInArrow(run, T.StructType(fields)).toDF(*names[:out], text_col, *names[out + 1 :])
