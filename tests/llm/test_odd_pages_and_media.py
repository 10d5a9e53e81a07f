"""Deep and odd pages, media fields over a whole table, archives with ids of any type, windows of long texts."""

import hashlib
import time
import zlib

import numpy as np
import pytest

from seriesmith.llm import html_extraction, media, substring_dedup, warc
from seriesmith.llm.common import shared_folder
from seriesmith.llm.html_blocks import leaf_blocks

SF = "/root/testdata/sf0.001"


def test_deep_pages_take_time_in_proportion():
    def took(n):
        began = time.process_time()
        assert len(leaf_blocks("<div>x" * n + "</span>" * n)) == n
        return time.process_time() - began

    took(500)
    assert took(16_000) < 40 * max(took(2000), 0.005)
    assert time.process_time() and len(leaf_blocks("<p " + "a= '" * 20_000)) == 0


def test_apostrophes_in_tags_and_quotes_after_equals_signs():
    page = "<p it's>one</p><p>two isn't</p><p a='x>y' b = \"q>r\">three</p><p c=>four</p>"
    assert [b.text for b in leaf_blocks(page)] == ["one", "two isn't", "three", "four"]


def test_pages_without_wrapper():
    field = html_extraction.trained_field()
    article = "<article><p>One sentence here.</p><p>Two sentences there.</p></article>"
    for page in (article, f"<body>{article}</body>", f"<nav><a href=x>menu</a></nav>{article}<footer>Legal</footer>"):
        assert html_extraction.main_text(page, field) == "One sentence here. Two sentences there."


def plain_resize(image, height, width):
    """Area means by spreading every sample over the targets that it overlaps."""
    def share(n, m):
        out = np.zeros((m, n))
        for i in range(m):
            for k in range(n):
                out[i, k] = max(0.0, min((i + 1) * n / m, k + 1) - max(i * n / m, k))
        return out / (n / m)

    return share(image.shape[0], height) @ image.astype(float) @ share(image.shape[1], width).T


@pytest.mark.parametrize("strip", [1, 50, 1 << 20])
def test_resizing_by_strips(monkeypatch, strip):
    monkeypatch.setattr(media, "STRIP", strip)
    rng = np.random.default_rng(strip)
    for shape in ((24, 24), (5, 24), (97, 24), (3, 2), (1, 1)):
        image = rng.integers(0, 256, shape, dtype=np.uint8)
        for target in ((8, 9), (16, 16)):
            assert np.allclose(media.resize_area(image, *target), plain_resize(image, *target))


def test_op8_over_the_table(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in media.op8_media(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for k, data in texts.items():
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        stored = f"P5\n24 {len(payload) // 24}\n255\n".encode() + payload
        image = np.frombuffer(payload, np.uint8).reshape(-1, 24)
        small = np.round(plain_resize(image, 8, 9), 6) if len(payload) < 20_000 else None
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest())
        if small is not None:
            assert r["feature"].split(":")[0] == np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def test_repeated_and_clashing_media_rows(spark):
    rows = [(1, "same", 5, "t"), (1, "same", 6, "t"), (2, None, 7, "t"), (None, "", 8, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int, tiles string")
    got = media.image_digests(media.with_tiles(media.store_texts(docs))).collect()
    assert len(got) == 4 and len({(r["payload_sha256"], r["feature"]) for r in got}) == 2


def test_archives_with_ids_as_text(spark):
    long = "<p>long enough</p>" * 100
    rows = [("b/1", "u", long), ("a 2", "u", long), (None, None, None), ("", "u", "short")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    folder = shared_folder(spark, "t")
    got = {r["page_id"]: r for r in warc.read_archives(warc.write_archives(pages, folder), folder, id_type="string").collect()}
    assert got.keys() == {"b/1", "a 2", None, ""}
    assert got["a 2"]["record_type"] == "revisit" and got["a 2"]["refers_to"] == "b/1" and got["b/1"]["refers_to"] is None


def test_one_long_stretch_in_many_rows(spark):
    """Equal words give one stretch for a whole text; many such texts go by window hashes, not into one automaton."""
    rows = [(k, " ".join(["w"] * 3000 + [f"x{k}"] * 10)) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(docs, shard=20).collect()}
    assert got == {0: 0} | {k: 3000 for k in range(1, 80)}
