"""Recognised text, log headers and settings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that a recogniser confuses, and what they stand for; fixed, position by position.
CONFUSED = "OoQDIl|!ZzSsBGgTt,"
MEANT = "00001111225586677."

#: Fixed values of the log format: header keys with their kinds.
SETTINGS = {
    "roi": "roi",
    "frame_start": "int",
    "frame_end": "int",
    "fps": "float",
    "max_speed": "float",
    "max_accel": "float",
    "force_aspect": "float",
    "fill_width": "int",
    "format": "str",
    "backend": "str",
    "model": "str",
    "ocr_backend": "str",
    "video": "str",
    "div": "int",
    "buffer": "int",
    "codec": "str",
}

#: Header keys whose option has another name; fixed.
RENAMED = {"model": "ocr_model"}

#: Engine names that were written to logs, and the name to ask for; fixed.
BACKENDS = {"onnxruntime": "cpu", "cpu": "cpu", "tensorrt": "tensorrt", "tensorrt+onnxruntime": "auto", "auto": "auto"}


def normalise_text(text: Column) -> Column:
    """Confusable characters become digits; a comma becomes a point."""
    return F.translate(text, CONFUSED, MEANT)


def extract_number(text: Column) -> Column:
    """The first number of a recognised text, its decimal separator removed; null if there is none."""
    flat = F.replace(normalise_text(F.trim(text)), F.lit(" "), F.lit(""))
    digits = F.regexp_replace(F.regexp_extract(flat, r"[0-9]+(?:[.,][0-9]+)?", 0), r"[^0-9]", "")
    return F.when(F.length(F.trim(text)) > 0, digits.try_cast("bigint"))


def unwrap(texts: Column, scores: Column) -> Column:
    """First text and score of a recogniser's batch; no score is 0.0."""
    return F.struct(F.get(texts, F.lit(0)).alias("text"), F.coalesce(F.get(scores, F.lit(0)), F.lit(0.0)).alias("score"))


def header_map(line: Column) -> Column:
    """key=value pairs of a header line; a value may hold commas, and the last of equal keys wins."""
    # a comma parts two pairs where a key follows it; what stands before a key in its part is no key's
    parts = F.filter(F.split(line, r",\s*(?=\w+=)"), lambda part: part.rlike(r"\w="))
    pairs = F.transform(parts, lambda part: F.struct(F.regexp_extract(part, r"(\w+)=", 1).alias("k"), F.trim(F.regexp_extract(part, r"\w=(.*)", 1)).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def destination(key: Column) -> Column:
    """The option that a header key sets; null for an unknown key."""
    out = F.when(key.isin(*SETTINGS), key)
    for name, other in RENAMED.items():
        out = F.when(key == name, F.lit(other)).otherwise(out)
    return out


def to_int(text: Column) -> Column:
    """Integer part of a number in text, else null."""
    return F.trim(text).try_cast("double").try_cast("int")


def to_float(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def to_roi(text: Column) -> Column:
    """Four comma-separated integers, else null."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("int"))
    return F.when((F.size(parts) == 4) & ~F.exists(parts, lambda x: x.isNull()), parts)


def backend_name(text: Column) -> Column:
    """The engine to ask for, or null for an unknown name."""
    name = F.lower(F.trim(text))
    out = F.lit(None).cast("string")
    for k, v in BACKENDS.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def setting(explicit: Column, header: Column, default: Column) -> Column:
    """An explicit value wins even if it equals the default, then the header's, then the default."""
    return F.coalesce(explicit, header, default)


def duration(seconds: Column) -> Column:
    """h:mm:ss or m:ss, rounded half to even; negative is zero."""
    s = F.bround(F.greatest(seconds, F.lit(0.0)), 0).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def ctc_decode(indices: Column, probabilities: Column, characters: Column) -> Column:
    """Greedy decoding of one text: best index of each step, repeats and blank 0 dropped.

    Struct of text and score, the mean probability of the kept steps, both rounded to 5 places; no
    kept step gives the empty text and 0.0.
    """
    steps = F.arrays_zip(indices.alias("i"), probabilities.alias("p"))
    kept = F.filter(steps, lambda s, k: (s["i"] != 0) & ((k == 0) | (s["i"] != F.get(indices, k - 1))))
    text = F.array_join(F.transform(kept, lambda s: F.get(characters, s["i"].cast("int"))), "")
    # whole hundred-thousandths, so that halves are halves
    total = F.aggregate(kept, F.lit(0).cast("long"), lambda acc, s: acc + F.bround(s["p"] * 1e5, 0).cast("long"))
    score = F.when(F.size(kept) > 0, F.bround(total / F.size(kept), 0) / 1e5).otherwise(0.0)
    return F.struct(text.alias("text"), score.alias("score"))
