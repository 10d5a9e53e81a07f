"""SimHash near-dedup: tiled exact comparison by exclusive-or and bit counts.

Fingerprints are made in Arrow batches. Rows with one fingerprint are one class, and classes are
dealt to tiles by keys of their bits. The fingerprint is cut into blocks; within 4 differing bits all
but four blocks at most are equal, so every link has all bits of some choice of the others in common
and meets under that key: none is lost. With more classes more blocks and so longer keys are taken
(5 keys of 13 bits, 15 of 21, 35 of 27), that buckets stay small. A tile is compared exactly in
numpy, ordered by population count, leaving out blocks whose counts differ by more than the radius. A
key with more classes than a tile holds is split into sub-tiles by population count and hash, and the
pairs of sub-tiles become tasks of their own. Links are united block by block, and a tile reports a
spanning forest of them, which has the same components as all links.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmith.llm.common import ROW_KEY, join_dealt, materialize, read_table, row_key, without_rows
from seriesmith.llm.components import connected_components

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
#: Classes that one tile holds.
TILE = 4096
#: Blocks that the bits are cut into, by the number of classes up to which their keys leave small buckets.
#: All but RADIUS blocks make a key, so each scheme finds every link.
SCHEMES = (5, 6, 7)
SCHEME_CLASSES = (4_000_000, 1_000_000_000)
#: Rows and columns of one comparison in numpy.
BLOCK = 512

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, size: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of a UTF-8 text: a bit is 1 if it is set in over half of the shingles' hashes."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist())] or [digest(joined, seed)]
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long. A null text is an empty one."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            fps = np.array([fingerprint(t or b"", size) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary")).mapInArrow(run, f"doc_id {id_type}, fp long")


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining the sets of i and j, pair by pair; a label is the least index of its set."""
    while len(i):
        x, y = label[i], label[j]
        apart = x != y
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, deeper := label[label]):
            label = deeper
    return label


def forest(values: np.ndarray, side: np.ndarray | None = None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among ``values``, or between its two sides.

    What is held at a time is one block of comparisons, whatever the number of links.
    """
    order = np.argsort(np.bitwise_count(values), kind="stable")
    values = values[order]
    every = np.arange(len(values))
    left, right = (every, every) if side is None else (np.flatnonzero(~side[order]), np.flatnonzero(side[order]))
    a, b = values[left], values[right]
    ones_a, ones_b = np.bitwise_count(a).astype(int), np.bitwise_count(b).astype(int)
    label = every.copy()
    for i in range(0, len(a), BLOCK):
        x, low, high = a[i : i + BLOCK], ones_a[i], ones_a[min(i + BLOCK, len(a)) - 1]
        for j in range(0, len(b), BLOCK):
            if ones_b[j] > high + radius or ones_b[min(j + BLOCK, len(b)) - 1] < low - radius or (side is None and j > i):
                continue
            r, c = np.nonzero(np.bitwise_count(x[:, None] ^ b[None, j : j + BLOCK]) <= radius)
            label = _unite(label, left[r + i], right[c + j])
    child = np.flatnonzero(label != every)
    return values[child], values[label[child]]


def _tile_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by tile, so one tile at a time is held."""

        def solve(key, held):
            fp, side = (np.concatenate(x) for x in zip(*held))
            # two sub-tiles are compared across only, and with one of them empty not at all
            u, v = forest(fp.view(np.uint64), side if key[1] != key[2] else None, radius)
            return u.view(np.int64), v.view(np.int64)

        held_key, held = None, []
        out_u, out_v = [], []
        for batch in batches:
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1)
            fp = batch.column(3).to_numpy(zero_copy_only=False)
            side = batch.column(4).to_numpy(zero_copy_only=False)
            if not len(fp):
                continue
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(fp)]):
                if held_key is None or not np.array_equal(held_key, key[a]):
                    if held and sum(len(x[0]) for x in held) > 1:
                        u, v = solve(held_key, held)
                        out_u.append(u)
                        out_v.append(v)
                    held_key, held = key[a], []
                held.append((fp[a:b], side[a:b]))
            if sum(map(len, out_u)) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_u)), pa.array(np.concatenate(out_v))], ["u", "v"])
                out_u, out_v = [], []
        if held and sum(len(x[0]) for x in held) > 1:
            u, v = solve(held_key, held)
            out_u.append(u)
            out_v.append(v)
        if out_u:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_u)), pa.array(np.concatenate(out_v))], ["u", "v"])

    return run


def band_keys(fp: Column, blocks: int) -> list[Column]:
    """The bits of every choice of all but RADIUS blocks, in place."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:])]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return [fp.bitwiseAND(F.lit(signed(sum(some)))) for some in itertools.combinations(masks, blocks - RADIUS)]


def scheme_for(classes: int) -> int:
    """Blocks whose keys leave buckets far below a tile's size for this many classes."""
    return SCHEMES[sum(classes > n for n in SCHEME_CLASSES)]


def tile_edges(classes: DataFrame, tile: int = TILE, scheme: int = SCHEMES[0]) -> DataFrame:
    """Edges (u, v) between the distinct fingerprints ``fp`` with the components of all links within RADIUS."""
    banded = classes.select("fp", F.posexplode(F.array(*band_keys(F.col("fp"), scheme))).alias("band", "value"))
    banded = banded.select("fp", F.struct("band", "value").alias("bucket")).withColumn("bucket", F.xxhash64("bucket"))  # buckets that share a hash are only larger
    crowded = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile)
    marked = join_dealt(banded, crowded.select("bucket", F.ceil(F.col("n") / tile).cast("int").alias("parts")), ["bucket"], "left")
    plain = marked.where("parts is null").select("bucket", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "fp", F.lit(False).alias("side"))
    # a crowded bucket: sub-tiles by population count, in steps beyond which no link reaches, and by hash
    step = F.floor(F.bit_count("fp") / (RADIUS + 1))
    mine = F.col("step") * F.col("parts") + F.pmod(F.xxhash64("fp"), F.col("parts"))
    others = F.sequence(F.greatest(F.lit(0), F.col("step") - 1) * F.col("parts"), (F.col("step") + 2) * F.col("parts") - 1)
    split = (
        marked.where("parts is not null")
        .withColumn("step", step)
        .withColumn("mine", mine.cast("long"))
        .withColumn("other", F.explode(others))
        .select("bucket", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "fp", (F.col("mine") > F.col("other")).alias("side"))
    )
    dealt = plain.unionByName(split).repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    return dealt.mapInArrow(_tile_links(RADIUS), "u long, v long")


def _classes(prints: DataFrame) -> DataFrame:
    """Each fingerprint with its component's smallest id, and the one of its classes that this id is in."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "fp"))
    classes = materialize(prints.groupBy("fp").agg(least.alias("least")), "simhash")
    roots = connected_components(tile_edges(classes.select("fp"), scheme=scheme_for(classes.count())))
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    owner = named.groupBy("root").agg(F.min("least").alias("first"))
    return join_dealt(named, owner, ["root"]).select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.fp").alias("first_fp"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id.

    Lower-cases A-Z, splits at ASCII white space and hashes 4-word shingles with repeats; fewer words
    are one shingle, none give fingerprint zero, which links like any other. Documents link at 4 or
    fewer differing bits; component_id is the smallest id reachable. A null text is an empty one; a
    null id never names a component unless it is alone in it. Repeated rows are kept as they are.
    """
    prints = materialize(fingerprints(docs, id_col, text_col), "simhash")
    joined = join_dealt(prints, _classes(prints), ["fp"])
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the document with the smallest id.

    Rows go one by one, not by id: of texts that share the smallest id in a component those with the
    lesser fingerprint stay, and a text that is near no other stays whatever its id. Rows that repeat id
    and fingerprint are one document. Rows with a null id cannot be named and stay.
    """
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), *row_key(id_col, text_col)).alias("key"), F.col(text_col).alias("text"))
    prints = materialize(fingerprints(keyed, "key", "text").select("doc_id.*", "fp").withColumnRenamed("id", "doc_id"), "simhash")
    joined = join_dealt(prints, _classes(prints.select("doc_id", "fp")), ["fp"])
    gone = joined.where(F.col("doc_id").isNotNull() & ((F.col("doc_id") != F.col("component_id")) | (F.col("fp") != F.col("first_fp"))))
    return without_rows(docs, gone.select(*ROW_KEY).distinct(), id_col, text_col)


def op5_simhash(spark, sf_dir) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"))
