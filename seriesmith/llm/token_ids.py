"""Token ids as bit-packed files: fixed width, blocks with offsets, random access.

A file holds the ids of consecutive documents. Each id takes the fewest bits that hold the largest
id of the vocabulary, lowest bit first. Layout: blocks of BLOCK_IDS ids, each padded to whole bytes;
footer: the documents' ids as an Arrow stream, so of any type and null, the number of tokens of each,
then the byte offset of each block; trailer: width, bytes of the ids' stream, number of documents,
token ids and blocks, offset of the footer, MAGIC.

Writers and readers stream. Files go to the folder that all executors share, each attempt under a
name of its own, and only files of finished tasks are in the manifest.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from seriesmith.llm.common import materialize, read_table, shared_folder
from seriesmith.llm.unit_cache import UnitCache, chunks, per_worker

BLOCK_IDS = 4096
MAGIC = b"SMTIDS02"
TRAILER = "<IQQQQQ8s"
#: Threads of the tokenizers library in one worker.
THREADS = 2
#: Blocks read at a time.
READ_BLOCKS = 256
#: Files whose sizes are summed together on the way to their global offsets.
FILES_A_SET = 1000


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids to bytes, ``bits`` each, lowest bit first."""
    if bits in (8, 16, 32):  # whole bytes are laid out like little-endian integers
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(each[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of what ``pack`` made."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    each = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    full = np.zeros((n, 32), np.uint8)
    full[:, :bits] = each
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    def __init__(self, sink, bits: int):
        self.sink, self.bits = sink, bits
        self.rest = np.zeros(0, np.uint32)
        self.ids, self.sizes, self.blocks, self.at, self.total = [], [], 0, 0, 0

    def _blocks(self, ids: np.ndarray) -> None:
        """Ids that fill blocks; BLOCK_IDS is a multiple of 8, so a full block is whole bytes."""
        self.blocks += -(-len(ids) // BLOCK_IDS)
        self.sink.write(data := pack(ids, self.bits))
        self.at += len(data)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Consecutive documents: their ids in a row, and how many each has."""
        self.ids.append(doc_ids)
        self.sizes.append(np.asarray(sizes))
        self.total += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK_IDS * BLOCK_IDS
        if whole:
            self._blocks(ids[:whole])
        self.rest = ids[whole:]

    def close(self) -> int:
        """Writes the footer; returns the number of documents."""
        if len(self.rest):
            self._blocks(self.rest)
        doc_ids = pa.chunked_array(self.ids) if self.ids else pa.chunked_array([pa.array([], pa.int64())])
        named = pa.BufferOutputStream()
        with pa.ipc.new_stream(named, pa.schema([("doc_id", doc_ids.type)])) as stream:
            stream.write_table(pa.table({"doc_id": doc_ids}))
        names = named.getvalue().to_pybytes()
        offsets = np.arange(self.blocks, dtype="<u8") * (BLOCK_IDS * self.bits // 8)
        self.sink.write(names + np.concatenate([np.zeros(0, "<u8"), *self.sizes]).astype("<u8").tobytes() + offsets.tobytes())
        self.sink.write(struct.pack(TRAILER, self.bits, len(names), len(doc_ids), self.total, self.blocks, self.at, MAGIC))
        return len(doc_ids)


class Reader:
    """Random access to a file: ``source`` is a seekable Arrow input file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - struct.calcsize(TRAILER))
        self.bits, names, docs, self.total, blocks, footer, magic = struct.unpack(TRAILER, source.read(struct.calcsize(TRAILER)))
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        source.seek(footer)
        self.doc_ids = pa.ipc.open_stream(source.read(names)).read_all().column(0)
        take = lambda n: np.frombuffer(source.read(8 * n), "<u8").astype(np.int64)
        self.sizes = take(docs)
        self.offsets = np.concatenate([take(blocks), [footer]])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids from position ``a`` up to, not including, ``b``."""
        if a >= b:
            return np.zeros(0, np.uint32)
        first, last = a // BLOCK_IDS, (b - 1) // BLOCK_IDS
        self.source.seek(int(self.offsets[first]))
        data = self.source.read(int(self.offsets[last + 1] - self.offsets[first]))
        return unpack(data, self.bits, min((last + 1) * BLOCK_IDS, self.total) - first * BLOCK_IDS)[a - first * BLOCK_IDS : b - first * BLOCK_IDS]


#: Letters whose lower case is one letter more of the same kind.
_LETTERS = "".join(map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
#: ASCII punctuation.
_MARKS = "".join(map(chr, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]))
#: Letters, then punctuation.
_PLAIN = f"^[{_LETTERS}]+[{re.escape(_MARKS)}]*$"
_STEM = re.compile(f"[{_LETTERS}]+")
#: Begins the tokenizer's special tokens, which letters of another case do not make.
_SPECIAL = "<|"
#: Stems that are encoded as one text.
STEMS = 2000
#: Bytes of text whose words are told apart together.
WORDS_BYTES = 1 << 21
#: Bytes that one generation of remembered pieces may hold.
PIECES_BYTES = 48 << 20


def _cells(column: pa.Array) -> list[bytes]:
    """The values of a column of large strings without nulls."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, "<i8")[column.offset :][: len(column) + 1].tolist() if len(column) else [0]
    data = data.to_pybytes() if data else b""
    return [data[a:b] for a, b in zip(ends, ends[1:])]


class WordTokenizer:
    """Whole-text ids from a tokenizer that drops white space, with pieces of words remembered.

    Such a tokenizer never joins characters across white space, so a text's ids are its words' ids in
    a row. A word of letters and punctuation after them is two pieces to it, any other word is one.
    The words of many texts are told apart in Arrow, and each different piece is looked up once.
    Unknown letters are encoded many at a time; where a piece ends is seen from the word ends in the
    vocabulary.
    """

    def __init__(self, path: str):
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))  # else each worker takes every core of its machine
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.size = self.whole.get_vocab_size()
        suffix = getattr(self.whole.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.size, bool)
        if suffix:
            for token, k in self.whole.get_vocab(with_added_tokens=False).items():
                self.ends[k] = token.endswith(suffix)
        self.pieces = UnitCache(self._new_pieces, PIECES_BYTES)

    def _each(self, units: list[bytes]) -> list[bytes]:
        found = self.whole.encode_batch_fast([u.decode() for u in units], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _new_stems(self, units: list[bytes]) -> list[bytes]:
        texts = [b" ".join(units[k : k + STEMS]).decode() for k in range(0, len(units), STEMS)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)])
        upto = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(upto) != len(units):  # a vocabulary without word ends
            return self._each(units)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *upto], upto)]

    def _new_pieces(self, units: list[bytes]) -> list[bytes]:
        stems = [u for u in units if _STEM.fullmatch(u.decode())]
        found = dict(zip(stems, self._new_stems(stems))) if stems else {}
        if odd := [u for u in units if u not in found]:
            found |= zip(odd, self._each(odd))
        return list(map(found.__getitem__, units))

    def _words(self, words: pa.Array) -> pa.Array:
        """The ids of each word, as bytes."""
        plain = pc.match_substring_regex(words, _PLAIN)
        letters = words.filter(plain)
        pieces = pa.concat_arrays([pc.ascii_rtrim(letters, _MARKS), pc.utf8_ltrim(letters, _LETTERS), words.filter(pc.invert(plain))])
        pieces = pieces.dictionary_encode()
        found = self.pieces.each(_cells(pieces.dictionary))
        at, n = pieces.indices.to_numpy(), len(letters)
        first, last = np.full((2, len(words)), len(found))  # behind the pieces is one without ids
        is_plain = plain.to_numpy(zero_copy_only=False)
        first[is_plain], last[is_plain], first[~is_plain] = at[:n], at[n : 2 * n], at[2 * n :]
        ids = pa.array([*found, b""], pa.large_binary())
        return pc.binary_join_element_wise(ids.take(pa.array(first)), ids.take(pa.array(last)), pa.scalar(b"", pa.large_binary()))

    def encode(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has; ``end_id`` is appended to each if given."""
        column = pa.array(texts, pa.large_string())
        if not any(_SPECIAL in t for t in texts):
            column = pc.ascii_lower(column)
        split = pc.ascii_split_whitespace(column)
        words = split.flatten().dictionary_encode()
        ids, order, upto = self._words(words.dictionary), words.indices.to_numpy(), split.offsets.to_numpy()
        if end_id is not None:  # one word more in every text
            order, upto = np.insert(order, upto[1:], len(ids)), upto + np.arange(len(upto))
            ids = pa.concat_arrays([ids, pa.array([struct.pack("<I", end_id)], pa.large_binary())])
        _, ends, data = ids.take(pa.array(order)).buffers()
        sizes = np.diff(np.frombuffer(ends, "<i8")[upto]) // 4 if len(texts) else np.zeros(0, np.int64)
        return np.frombuffer(data or b"", "<u4", sizes.sum()), sizes


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write files in ascending id order; returns the manifest: part, path, docs, ids.

    A null text is empty, a null id comes first. Rows that repeat an id are ordered by their text.
    Ids may be of any type that sorts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = per_worker(("words", path), lambda: WordTokenizer(path))
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name = f"{base}/{uuid.uuid4().hex}.ids"
        with fs.open_output_stream(name) as sink:
            out = Writer(sink, bits_for(max(coder.size, end_id + 1)))
            for batch in batches:
                at = 0
                for some in chunks([t or "" for t in batch.column(1).to_pylist()], WORDS_BYTES, lambda t: len(t.encode())):
                    out.add(batch.column(0).slice(at, len(some)), *coder.encode(some, end_id))
                    at += len(some)
            n = out.close()
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([name]), pa.array([n]), pa.array([out.total])], ["part", "path", "docs", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(dealt.mapInArrow(run, "part long, path string, docs long, ids long"), "manifest")


def _ids_before(manifest: DataFrame) -> DataFrame:
    """Adds before: ids in the files of lesser parts. Running sums of groups of files, then inside each group."""
    grouped = manifest.withColumn("set", F.floor(F.col("part") / FILES_A_SET))
    sums = grouped.groupBy("set").agg(F.sum("ids").alias("n"))
    starts = sums.select("set", (F.sum("n").over(Window.orderBy("set")) - F.col("n")).alias("start"))  # one row per set of files
    inside = F.sum("ids").over(Window.partitionBy("set").orderBy("part")) - F.col("ids")
    return grouped.join(starts, "set").withColumn("before", F.col("start") + inside)


def read_token_files(manifest: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32. ``id_type`` is that of the written ids."""
    kind = to_arrow_type(T._parse_datatype_string(id_type))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(path) as source:
                    file = Reader(source)
                    crcs = np.zeros(len(file.sizes), np.int64)
                    ends, doc = file.starts + file.sizes, 0
                    for a in range(0, file.total, READ_BLOCKS * BLOCK_IDS):
                        b = min(file.total, a + READ_BLOCKS * BLOCK_IDS)
                        data, at = memoryview(file.ids(a, b).astype("<u4").tobytes()), a
                        while at < b:
                            upto = min(b, int(ends[doc]))
                            crcs[doc] = zlib.crc32(data[4 * (at - a) : 4 * (upto - a)], int(crcs[doc]))
                            at = upto
                            doc += at == ends[doc]
                    doc_ids = file.doc_ids.cast(kind).combine_chunks()
                    columns = [doc_ids, pa.array(file.starts + before), pa.array(file.sizes), pa.array(crcs)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return _ids_before(manifest).select("path", "before").repartition(n, "path").mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def op6_token_ids(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    folder = shared_folder(spark, "token-ids")
    docs = read_table(spark, sf_dir, "documents")
    manifest = write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), folder, end_id=1)
    return read_token_files(manifest, folder, docs.schema["doc_id"].dataType.simpleString())
