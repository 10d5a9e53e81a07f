"""Media and tiles are written, and the digests are those of the stored table."""

from pyspark.sql import functions as F

from seriesmith.llm import media


def test_op8_digests_come_from_the_stored_table(spark, monkeypatch):
    texts = [(1, "a b c"), (2, None), (None, "x" * 2000), (1, "a b c")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    monkeypatch.setattr(media, "read_table", lambda spark, sf_dir, name: docs)
    stored, write = [], media.materialize
    monkeypatch.setattr(media, "materialize", lambda df, label: stored.append(write(df, label)) or stored[-1])
    got = media.op8_media(spark, "")
    (kept,) = stored
    assert kept.columns == ["doc_id", "n_bytes", "media", "tiles"] and set(got.inputFiles()) == set(kept.inputFiles())
    for row in kept.collect():
        image = media.decode_image(bytes(row["media"]))
        assert image.shape[1] == media.WIDTH and [bytes(t) for t in row["tiles"]] == media.npy_tiles(media.gray(image))
    plain = media.image_digests(media.store_texts(docs))
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect())) and got.count() == 4
    other = kept.withColumn("tiles", F.array(F.lit(b"x")))
    assert not {r["feature"] for r in media.image_digests(other).collect()} & {r["feature"] for r in plain.collect()}
