"""Token files, SentencePiece, media and WARC: round trips and parity."""

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmith.llm import media, sentencepiece_codec, token_ids, warc
from seriesmith.llm.common import shared_folder

ODD = ["", " ", "  ", "a  b", " x   y ", "\n\t ", "Héllo Wörld's don't", "日本語 テスト 😀", "a" * 3000, "<|endoftext|> <s> <0x41>", "A<|ENDOFTEXT|>B The", "ΑΣ Σς İi", "x́ é", "ﬁ 　z 12,345.67%%%", "\x00 b\x00", "▁ ▁▁x"]


@pytest.fixture(scope="module")
def vocab():
    return pytest.importorskip("public_tokenizers").path


def table(spark, texts, name="text"):
    return spark.createDataFrame([(k, t, 5, "x") for k, t in enumerate(texts)], f"doc_id long, {name} string, ids int, part string")


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 32])
def test_packing(bits):
    ids = np.array([random.Random(bits).getrandbits(bits) for _ in range(1001)], np.uint32)
    data = token_ids.pack(ids, bits)
    assert len(data) == (1001 * bits + 7) // 8
    assert np.array_equal(token_ids.unpack(data, bits, 1001), ids)
    assert token_ids.bits_for(49_408) == 16 and token_ids.bits_for(1) == 1 and token_ids.bits_for(65_537) == 17


def test_random_access(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_ids, "BLOCK_IDS", 8)
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 1 << 11, n).astype(np.uint32) for n in (0, 3, 20, 1, 64)]
    sink = io.BytesIO()
    out = token_ids.Writer(sink, 11)
    for k, p in enumerate(parts):
        out.add(pa.array([None if k == 3 else k], pa.int64()), p, [len(p)])
    assert out.close() == 5
    file = token_ids.Reader(pa.BufferReader(sink.getvalue()))
    whole = np.concatenate(parts)
    for a, b in ((0, 88), (0, 0), (5, 9), (8, 16), (87, 88), (3, 70)):
        assert np.array_equal(file.ids(a, b), whole[a:b])
    assert file.starts.tolist() == [0, 0, 3, 23, 24] and file.doc_ids.to_pylist() == [0, 1, 2, None, 4]
    with pytest.raises(ValueError):
        token_ids.Reader(pa.BufferReader(sink.getvalue()[:-1] + b"x"))


def test_word_ids_are_those_of_whole_texts(vocab):
    from tokenizers import Tokenizer

    path = vocab("word_bpe_49k.json")
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("abT's \n.,é1!漢ΣßÀ<|>\x0b\x0c\x1c\x1f\x85\u2028\u00a0\u0301") for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    whole = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    coder = token_ids.WordTokenizer(path)
    for _ in range(2):  # the second time from memory
        ids, sizes = coder.encode(texts)
        assert sizes.tolist() == list(map(len, whole)) and ids.tolist() == [i for ids in whole for i in ids]
    ids, sizes = coder.encode(texts, end_id=1)
    assert sizes.tolist() == [len(x) + 1 for x in whole] and ids.tolist() == [i for ids in whole for i in [*ids, 1]]


def test_token_files(spark, vocab):
    from tokenizers import Tokenizer

    path = vocab("word_bpe_49k.json")
    texts = [None, *ODD, "word " * 9000, "tail"]
    folder = shared_folder(spark, "t")
    manifest = token_ids.write_token_files(table(spark, texts).repartition(3), path, folder, end_id=1)
    got = [tuple(r) for r in token_ids.read_token_files(manifest, folder).orderBy("doc_id").collect()]
    start, want = 0, []
    for k, e in enumerate(Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)):
        ids = np.array([*e.ids, 1], "<u4")
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    none = token_ids.write_token_files(table(spark, []), path, shared_folder(spark, "t"), end_id=1)
    assert token_ids.read_token_files(none, folder).count() == 0


def test_sentencepiece_parity(spark, vocab):
    import sentencepiece

    path = vocab("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    texts = ODD + [None] + ["".join(rng.choice("ab  \n\t,.é漢😀▁1") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    encoded = sentencepiece_codec.encode_documents(table(spark, texts), path).orderBy("doc_id").collect()
    assert [r["token_ids"] for r in encoded] == library.encode([t or "" for t in texts])
    assert all(r["parity"] for r in encoded)
    assert all(r["round_trip"] for r, t in zip(encoded, texts) if "▁" not in (t or ""))
    back = sentencepiece_codec.decode_documents(sentencepiece_codec.encode_documents(table(spark, texts), path), path).orderBy("doc_id").collect()
    assert [r["text"] for r in back] == [(t or "").replace("▁", " ") for t in texts]
    tokenizer = sentencepiece_codec.Codec(path).tokenizer  # without units or memory
    assert [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)] == library.encode([t or "" for t in texts])


def field(number, kind, value):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    return varint(number << 3 | kind) + (varint(value) if kind == 0 else value if kind == 5 else varint(len(value)) + value)


def test_unigram_model_is_rebuilt():
    import struct

    pieces = [("<unk>", 0.0, 2)] + [(p, s, 1) for p, s in (("▁", -3.0), ("▁he", -2.0), ("l", -2.5), ("lo", -2.6), ("h", -5.0), ("e", -5.0), ("o", -4.0), ("▁hello", -9.0))]
    data = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, k)) for p, s, k in pieces)
    data += field(2, 2, field(3, 0, 1)) + field(3, 2, field(3, 0, 1) + field(4, 0, 1))
    model = sentencepiece_codec.Model(data)
    assert not model.is_bpe and model.squeeze and model.unknown == 0
    assert [p for p in model.tokenizer().encode("  hello   he ").tokens] == ["▁he", "l", "lo", "▁he"]


def gray_image(rng, h, w):
    return rng.integers(0, 256, (h, w), dtype=np.uint8)


def test_image_formats():
    rng = np.random.default_rng(2)
    gray, color = gray_image(rng, 5, 7), rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert np.array_equal(media.decode_image(media.encode_netpbm(gray)), gray)
    assert np.array_equal(media.decode_image(media.encode_netpbm(color)), color)
    assert np.array_equal(media.decode_image(media.encode_bmp(color)), color)
    plain = b"P2 # a comment\n7 5\n# another\n255\n" + b" ".join(str(v).encode() for v in gray.ravel()) + b"\n"
    assert np.array_equal(media.decode_image(plain), gray)
    assert np.array_equal(media.decode_image(b"P3 7 5 255 " + b" ".join(str(v).encode() for v in color.ravel())), color)
    bits = gray > 127
    assert np.array_equal(media.decode_image(b"P4\n7 5\n" + np.packbits(~bits, axis=1).tobytes()), bits * np.uint8(255))
    assert np.array_equal(media.decode_image(b"P1\n7 5\n" + b"".join(b"0" if b else b"1" for b in bits.ravel())), bits * np.uint8(255))
    deep = rng.integers(0, 65536, (3, 4)).astype(">u2")
    assert np.array_equal(media.decode_image(b"P5 4 3 65535\n" + deep.tobytes()), deep)
    palette = np.arange(256, dtype=np.uint8)
    import struct

    table = np.stack([palette, palette, palette, 0 * palette], axis=1).tobytes()
    rows = np.zeros((5, 8), np.uint8)
    rows[:, :7] = gray[::-1]
    eight = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 0, 0, 0, 54 + 1024, 40, 7, 5, 1, 8, 0, 40, 0, 0, 0, 0) + table + rows.tobytes()
    assert np.array_equal(media.decode_image(eight)[:, :, 0], gray)
    for bad in (b"", b"GIF89a", b"P5\n4 4\n255\nx", b"P5 4"):
        with pytest.raises(ValueError):
            media.decode_image(bad)


def test_area_resize():
    image = gray_image(np.random.default_rng(3), 6, 8).astype(float)
    assert np.allclose(media.resize_area(image, 3, 4), image.reshape(3, 2, 4, 2).mean(axis=(1, 3)))
    fine = np.kron(image, np.ones((35, 45)))  # any smaller grid by whole pixels
    assert np.allclose(media.resize_area(image, 7, 9), fine.reshape(7, 30, 9, 40).mean(axis=(1, 3)))
    tiles = media.npy_tiles(image)
    assert len(tiles) == 4 and np.load(io.BytesIO(tiles[0])).shape == (8, 8)
    assert media.difference_hash(np.tile(np.arange(90.0), (80, 1))) == "ff" * 8


def test_stored_texts(spark):
    texts = ["", None, "x" * 576, "é" * 400, "y" * 577]
    stored = media.store_texts(table(spark, texts))
    got = media.image_digests(stored).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        raw = (t or "").encode()
        whole = raw + b"\xff" * (max(576, -len(raw) // 576 * -576) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
    features = media.image_features(stored.union(stored.limit(1).select("doc_id", "n_bytes", F.lit(None).cast("binary")))).collect()
    assert {len(r["tiles"]) if r["tiles"] else None for r in features} == {4, None}
    assert media.image_digests(media.store_texts(table(spark, []))).count() == 0


def archive(*records):
    return io.BytesIO(b"".join(records))


def test_records_are_framed_and_verified():
    big = bytes(random.Random(5).randrange(256) for _ in range(700_000))
    data = [warc.record(1, "http://a/ b\r\n", b"<p>\r\n\r\nx</p>"), warc.record(None, None, b""), warc.record(3, "u", big), warc.record(4, "u", big, refers_to=3)]
    got = list(warc.read_records(archive(*data), keep_payload=True))
    assert [r["page_id"] for r in got] == [1, None, 3, 4]
    assert [r["payload"] for r in got] == [b"<p>\r\n\r\nx</p>", b"", big, None]
    assert got[0]["url"] == "http://a/%20b%0D%0A" and got[1]["url"] is None
    assert (got[3]["record_type"], got[3]["refers_to"], got[3]["payload_bytes"], got[3]["payload_digest"]) == ("revisit", 3, len(big), hashlib.sha1(big).hexdigest())
    plain = zlib.decompress(data[0], 31)
    for bad in (plain.replace(b"x</p>", b"y</p>"), plain[:-2], plain + b"z"):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        with pytest.raises(ValueError):
            list(warc.read_records(archive(packer.compress(bad) + packer.flush())))
    with pytest.raises(ValueError):
        list(warc.read_records(archive(data[0][:-9])))


def test_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    long = "é" * 600
    pages = [(1, "a", long), (2, "b", long), (5, "c", long), (3, None, "short"), (4, "d", "short"), (None, "e", long), (6, "f", None), (7, "g", "")]
    df = spark.createDataFrame([(i, u, h, 1, "x") for i, u, h in pages], "page_id long, url string, html string, last int, sha string")
    folder = shared_folder(spark, "w")
    manifest = warc.write_archives(df, folder)
    got = {(r["page_id"], r["url"]): r for r in warc.read_archives(manifest, folder, keep_payload=True).collect()}
    assert len(got) == len(pages)
    kinds = {k[0]: (r["record_type"], r["refers_to"]) for k, r in got.items()}
    assert kinds == {1: ("revisit", 5), 2: ("revisit", 5), 5: ("response", None), None: ("revisit", 5), 3: ("response", None), 4: ("response", None), 6: ("response", None), 7: ("response", None)}
    assert got[(5, "c")]["payload"].decode() == long and got[(1, "a")]["payload_bytes"] == 1200 and got[(6, "f")]["payload_bytes"] == 0
    none = warc.write_archives(df.limit(0), folder)
    assert warc.read_archives(none, folder).count() == 0
