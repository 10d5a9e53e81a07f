"""The encoding queries over a whole table against the libraries, ids of any type, and bounded memories."""

import random
import zlib

import numpy as np
import pytest

from seriesmith.llm import sentencepiece_codec, token_ids
from seriesmith.llm.common import shared_folder
from seriesmith.llm.unit_cache import LONGEST, UnitCache

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocab():
    return pytest.importorskip("public_tokenizers").path


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_op6_over_the_table(spark, vocab, texts):
    from tokenizers import Tokenizer

    plain, start, want = Tokenizer.from_file(vocab("word_bpe_49k.json")), 0, []
    for doc_id in sorted(texts):
        ids = np.array([*plain.encode(texts[doc_id], add_special_tokens=False).ids, 1], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = token_ids.op6_token_ids(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_op1_over_the_table(spark, vocab, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocab("piece_bpe_32k.model"))
    got = sentencepiece_codec.op1_sentencepiece(spark, SF).collect()
    assert {r["doc_id"]: r["token_ids"] for r in got} == {k: library.encode(t) for k, t in texts.items()}
    for r in got:
        assert r["parity"] and r["round_trip"] and r["n_tokens"] == len(r["token_ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["token_ids"], "<u4").tobytes())


def test_ids_of_any_type(spark, vocab):
    rows = [("b", "one two"), (None, "three"), ("a", None), ("b", "again")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    folder = shared_folder(spark, "t")
    manifest = token_ids.write_token_files(docs, vocab("word_bpe_49k.json"), folder, end_id=1)
    got = token_ids.read_token_files(manifest, folder, "string").orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, "a", "b", "b"]
    assert [r["n_tokens"] for r in got][:2] == [2, 1]


def test_offsets_over_many_files(spark, monkeypatch):
    monkeypatch.setattr(token_ids, "FILES_A_SET", 3)
    rows = [(k, f"f{k}", 1, (k * 7) % 5 + 1) for k in range(20) if k != 4]
    manifest = spark.createDataFrame(rows, "part long, path string, docs long, ids long")
    got = {r["part"]: r["before"] for r in token_ids._ids_before(manifest).collect()}
    assert got == {k: sum(n for j, _, _, n in rows if j < k) for k, *_ in rows}


def test_parity_is_reported_not_repaired(vocab):
    codec = sentencepiece_codec.Codec(vocab("piece_bpe_32k.model"))
    true = codec.library
    codec.library = type("Wrong", (), {"encode": staticmethod(lambda texts, num_threads=1: [[9999]] * len(texts))})
    ids, sizes, same, back = codec.encode(["hello there", ""])
    assert ids.tolist() == true.encode("hello there") and same.tolist() == [False, True] and back.tolist() == [True, True]


def test_memory_of_units_is_bounded_by_bytes():
    cache = UnitCache(lambda units: [u.upper() for u in units], generation=20_000)
    rng = random.Random(1)
    for _ in range(200):
        units = [bytes(rng.choices(b"abcdef", k=rng.choice([1, 3, 9]))) for _ in range(50)] + [b"x" * (LONGEST + 1)]
        assert cache.values(units) == [u.upper() for u in units]
        held = sum(len(k) + len(v) + 160 for some in (cache.young, cache.old) for k, v in some.items())
        assert held < 2 * 40_000 and not any(len(u) > LONGEST for u in cache.young)


def test_words_are_remembered_by_their_pieces(vocab):
    """op6: letters and the punctuation behind them are kept apart, not every pair of them."""
    from tokenizers import Tokenizer

    path = vocab("word_bpe_49k.json")
    stems, tails = [a + b for a in "bcdfghklmn" for b in ("ab", "é", "ost")], ["", ",", ".", "!?", "$$$"]
    texts = [" ".join(s + t for s in stems) for t in tails] + ["", " \n", "don't 12,5 x y, <|endoftext|>"]
    whole = [[*e.ids, 7] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    coder = token_ids.WordTokenizer(path)
    for some in ([], [""], texts[:5], texts):
        ids, sizes = coder.encode(some, end_id=7)
        want = [[7]] if some == [""] else whole[: len(some)]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    held = [len(c.young) + len(c.old) for c in vars(coder).values() if isinstance(c, UnitCache)]
    assert sum(held) <= len(stems) + len(tails) + 20 < len(stems) * len(tails)
