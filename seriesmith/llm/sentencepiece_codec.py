"""SentencePiece models run by the tokenizers library.

The model file is a protobuf; its wire format is read here without generated classes. From it come
the pieces with scores and kinds, and the normaliser; a ``tokenizers.Tokenizer`` is rebuilt with the
same normaliser, the metaspace marker, unigram scores or merges, and byte fallback. Where no piece
has the marker after another character, no merge crosses the start of a marker run, and a text's ids
are those of its units (marker run and what follows) in a row. Units are encoded in multithreaded
batches and remembered by each worker; when a worker first meets a unit it is decoded again and held
against the sentencepiece library, which verifies and never gives the ids.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmith.llm.common import read_table
from seriesmith.llm.unit_cache import UnitCache, chunks, per_worker

MARK = "▁"
#: Piece kinds of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Threads of the tokenizers library in one worker.
THREADS = 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        octet = data[at]
        at += 1
        value |= (octet & 127) << shift
        shift += 7
        if octet < 128:
            return value, at


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field number and raw value of each field of a protobuf message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                n, at = _varint(data, at)
            elif kind in (1, 5):
                n = 8 if kind == 1 else 4
            else:
                raise ValueError(f"wire type {kind}")
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class Model:
    """Pieces, scores, kinds, and the switches that matter for encoding."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        trainer, normalizer = {}, {}
        for number, value in wire_fields(data):
            if number == 1:
                piece = dict(wire_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(wire_fields(value))
            elif number == 3:
                normalizer = dict(wire_fields(value))
        self.is_bpe = trainer.get(3, 1) == 2
        if trainer.get(3, 1) not in (1, 2):
            raise ValueError("only unigram and BPE models are read")
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap = normalizer.get(2, b"")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.squeeze = bool(normalizer.get(4, 1))
        self.escape = bool(normalizer.get(5, 1))
        self.unknown = self.kinds.index(UNKNOWN)
        self.by_units = self.escape and not any(MARK in p.lstrip(MARK) for p, k in zip(self.pieces, self.kinds) if k in (NORMAL, USER_DEFINED))

    def tokenizer(self):
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        if self.is_bpe:
            ids = {p: k for k, p in enumerate(self.pieces)}
            usable = {p for p, k in zip(self.pieces, self.kinds) if k in (NORMAL, USER_DEFINED, UNUSED)}
            pairs = []
            for k, piece in enumerate(self.pieces):
                if piece in usable and len(piece) > 1:
                    cuts = [(piece[:c], piece[c:]) for c in range(1, len(piece)) if piece[:c] in usable and piece[c:] in usable]
                    pairs += [(-self.scores[k], k, ids[a], ids[b], a, b) for a, b in cuts]
            merges = [(a, b) for *_, a, b in sorted(pairs)]
            model = models.BPE(ids, merges, unk_token=self.pieces[self.unknown], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            model = models.Unigram(list(zip(self.pieces, self.scores)), self.unknown, self.byte_fallback)
        out = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if self.escape else " "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        out.normalizer = normalizers.Sequence(steps)
        if self.by_units:
            out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
        own = [AddedToken(p, normalized=False) for p, k in zip(self.pieces, self.kinds) if k == USER_DEFINED]
        if own:
            out.add_tokens(own)
        after = [decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *after])
        return out


#: Flags on the first id of a remembered unit: the libraries differ; decoding does not give the unit back.
_UNEQUAL, _CHANGED = 1 << 31, 1 << 30
_IDS = np.uint32(_CHANGED - 1)
_UNITS = re.compile(f"{MARK}+[^{MARK}]*")
#: Stands for the end of a text among its units: no text holds a lone surrogate, no flagged id is this one.
_END, _END_ID = "\udfff", 0xFFFFFFFF


#: Bytes that one generation of remembered units may hold, and rows whose texts are taken from a batch together.
CACHE_BYTES = 32 << 20
ROWS = 64


class Codec:
    """Encoder and decoder of one worker; ids are those of the rebuilt tokenizer."""

    def __init__(self, path: str):
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        import sentencepiece
        from tokenizers import normalizers

        with open(path, "rb") as file:
            self.model = Model(file.read())
        self.tokenizer = self.model.tokenizer()
        #: Takes units, which are normalised already.
        self.on_units = self.model.tokenizer()
        self.on_units.normalizer = normalizers.Sequence([])
        self.identity = not self.model.charsmap and not self.model.squeeze
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.by_units = self.model.by_units and self.model.dummy_prefix and USER_DEFINED not in self.model.kinds and MARK in self.model.pieces
        self.cache = UnitCache(self._new_units, CACHE_BYTES)

    def _decoded(self, ids: list) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def _new_units(self, units: list[str]) -> list[bytes]:
        """Units stand without their first marker, and markers as spaces: so the library takes them."""
        ends = [k for k, u in enumerate(units) if u == _END]
        texts = [" " if u == _END else u for u in units]
        ours = [e.ids for e in self.on_units.encode_batch_fast([MARK + t.replace(" ", MARK) for t in texts], add_special_tokens=False)]
        theirs, backs = self.library.encode(texts, num_threads=1), self._decoded(ours)
        # a lone marker is an empty text to the library
        flags = np.array([(_UNEQUAL if a != b and t else 0) | (_CHANGED if c != t else 0) for t, a, b, c in zip(texts, ours, theirs, backs)], "<u4")
        upto = np.cumsum(np.fromiter(map(len, ours), np.int64, len(ours)))
        flat = np.fromiter(itertools.chain.from_iterable(ours), "<u4", upto[-1])
        flat[np.concatenate([[0], upto[:-1]])] |= flags  # no unit is without ids
        data, ends_at = flat.tobytes(), (4 * upto).tolist()
        out = [data[a:b] for a, b in zip([0, *ends_at], ends_at)]
        for k in ends:
            out[k] = struct.pack("<I", _END_ID)
        return out

    def _split(self, text: str) -> tuple[list[str], bool]:
        """Units of a text as the cache takes them, and whether they are the text itself."""
        if not text:
            return [], True
        if self.identity and text[0] != " " and "  " not in text and MARK not in text:
            return text.split(" "), True
        normal = MARK + text.replace(" ", MARK) if self.identity else self.tokenizer.normalizer.normalize_str(text)
        return [u[1:].replace(MARK, " ") for u in _UNITS.findall(normal)], normal[1:].replace(MARK, " ") == text

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row; for each text how many, whether the libraries agree, whether decoding gives it back."""
        if not self.by_units:
            ours = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            same = [a == b for a, b in zip(ours, self.library.encode(texts, num_threads=1))]
            back = [a == b for a, b in zip(self._decoded(ours), texts)]
            flat = np.fromiter((i for ids in ours for i in ids), "<u4")
            return flat, np.array(list(map(len, ours)), np.int64), np.array(same, bool), np.array(back, bool)
        units, whole = [], []
        for text in texts:
            some, unchanged = self._split(text)
            units += some
            units.append(_END)
            whole.append(unchanged)
        marked = np.frombuffer(b"".join(self.cache.values(units)), "<u4")
        end = marked == _END_ID
        at = np.flatnonzero(end)
        sizes = np.diff(at, prepend=-1) - 1
        wrong = lambda flag: np.diff(np.concatenate([[0], np.cumsum((marked & np.uint32(flag) != 0) & ~end)[at]])) > 0
        return marked[~end] & _IDS, sizes, ~wrong(_UNEQUAL), ~wrong(_CHANGED) & np.array(whole, bool)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self._decoded(ids)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, token_ids (array of int), n_tokens, ids_crc32, round_trip, parity; one row per row of ``docs``.

    ``token_ids`` are those of the tokenizer rebuilt from the model. ``round_trip``: decoding them gives
    the text back. A text that holds the marker itself or, for a model that squeezes or maps characters,
    anything so changed does not. ``parity``: the sentencepiece library gives the same ids, for each
    unit of the text. Nulls and empty texts have no ids. Any id type passes through; other columns are
    not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = per_worker(("sentencepiece", path), lambda: Codec(path))
        for batch in batches:
            at = 0
            parts = (batch.column(1).slice(k, ROWS) for k in range(0, batch.num_rows, ROWS))
            for texts in chunks(t or "" for part in parts for t in part.to_pylist()):
                ids, sizes, same, back = codec.encode(texts)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                data = memoryview(ids.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32))),
                        pa.array(sizes, pa.int64()),
                        pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist())], pa.int64()),
                        pa.array(back),
                        pa.array(same),
                    ],
                    ["doc_id", "token_ids", "n_tokens", "ids_crc32", "round_trip", "parity"],
                )
                at += len(texts)

    schema = f"doc_id {id_type}, token_ids array<int>, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """doc_id and text from arrays of ids; a null array is an empty text."""
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = per_worker(("sentencepiece", path), lambda: Codec(path))
        for batch in batches:
            texts = codec.decode([x or [] for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col)).mapInArrow(run, f"doc_id {id_type}, text string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark, sf_dir) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), model_path())
