"""Scalar text functions of the catalog: picks, qualities, token ids, seeded perturbations. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.functions.hashing import uniform
from lapwing.functions.vectors import let

#: Neighbours of each key on a keyboard: fixed values.
KEY_NEIGHBOURS = {
    "q": "wased", "w": "qeasd", "e": "wrsdf", "r": "etdfg", "t": "ryfgh", "y": "tughj", "u": "yihjk", "i": "uojkl", "o": "ipkl",
    "p": "ol", "a": "qwsz", "s": "awedxz", "d": "serfcx", "f": "drtgvc", "g": "ftyhbv", "h": "gyujnb", "j": "huikmn", "k": "jiolm",
    "l": "kop", "z": "asx", "x": "zsdc", "c": "xdfv", "v": "cfgb", "b": "vghn", "n": "bhjm", "m": "njk",
}


def words(text: Column) -> Column:
    """Words between white space; none for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def pick_localised(entries: Column, prefix: str = "en") -> Column:
    """Text of an array of (language_tag, value): the first whose tag starts with ``prefix``, else the first; '' if none."""
    chosen = F.get(F.filter(entries, lambda e: F.coalesce(e["language_tag"].startswith(prefix), F.lit(False))), F.lit(0))["value"]
    return F.trim(F.coalesce(chosen, F.get(entries, F.lit(0))["value"], F.lit("")))


def or_other(category: Column) -> Column:
    return F.when(F.coalesce(category, F.lit("")) == "", "OTHER").otherwise(category)


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def text_quality(text: Column, full: int = 20) -> Column:
    """Words over ``full``, one at most, zero for blank text."""
    return F.least(F.size(words(text)) / F.lit(float(full)), F.lit(1.0))


def image_weight(text: Column) -> Column:
    """Weight of the image beside a title of few (3 or less: .85), some (.70) or many (10 or more: .50) words."""
    n = F.size(words(text))
    return F.when(n <= 3, 0.85).when(n >= 10, 0.50).otherwise(0.70)


def hash_tokens(text: Column, length: int = 64, vocabulary: int = 30000) -> Column:
    """Token ids 1..vocabulary of the first ``length`` lower-case words by md5, padded with zeros."""
    ids = F.transform(
        F.slice(words(F.lower(text)), 1, length),
        lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % vocabulary + 1,
    )
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0).cast("long"), length)), 1, length)


def token_mask(ids: Column) -> Column:
    return F.transform(ids, lambda i: (i > 0).cast("int"))


def threshold_band(threshold: Column) -> Column:
    return F.when(threshold >= 0.85, "High Precision").when(threshold >= 0.70, "Balanced").otherwise("Recall-Oriented")


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


# Perturbations. Each takes the row's key and a seed; draws are uniforms of (seed, step, key).


def _at(u: Column, n: Column) -> Column:
    """A place 0..n-1."""
    return F.least(F.floor(u * n), n - 1).cast("int")


def typo(text: Column, key: Column, seed: int) -> Column:
    """One letter becomes a neighbour of its key, in its case; texts under 3 characters and other characters stay."""
    n = F.char_length(text)
    at = _at(uniform(f"{seed}:typo-at", key), n) + 1
    found = F.substring(text, at, F.lit(1))
    table = F.create_map(*[F.lit(x) for pair in KEY_NEIGHBOURS.items() for x in pair])
    near = F.try_element_at(table, F.lower(found))
    new = F.substring(near, _at(uniform(f"{seed}:typo-to", key), F.char_length(near)) + 1, F.lit(1))
    new = F.when(found == F.lower(found), new).otherwise(F.upper(new))
    return F.when((n >= 3) & near.isNotNull(), F.overlay(text, new, at, F.lit(1))).otherwise(text)


def swap(text: Column, key: Column, seed: int) -> Column:
    """Two neighbouring characters change places; texts under 4 characters stay."""
    n = F.char_length(text)
    at = _at(uniform(f"{seed}:swap", key), n - 1) + 1
    moved = F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, F.lit(1)), F.substring(text, at, F.lit(1)), F.substring(text, at + 2, n))
    return F.when(n >= 4, moved).otherwise(text)


def drop_words(text: Column, brand: Column, key: Column, seed: int, brand_p: float = 0.4, word_p: float = 0.15) -> Column:
    """Of over 2 words, the brand goes with ``brand_p`` and each word with ``word_p``; never all of them."""
    gone = (F.coalesce(brand, F.lit("")) != "") & (uniform(f"{seed}:brand", key) < brand_p)

    def drop(every: Column) -> Column:
        some = F.when(gone, F.filter(every, lambda w: F.lower(w) != F.lower(brand))).otherwise(every)
        left = F.filter(some, lambda w, i: uniform(f"{seed}:word", key, i) > word_p)
        return let(left, lambda x: F.when(F.size(x) > 0, F.array_join(x, " ")).otherwise(text))

    return let(words(text), lambda every: F.when(F.size(every) > 2, drop(every)).otherwise(text))


def truncate(text: Column, key: Column, seed: int) -> Column:
    """Of over 3 words, the first 2 to n-1."""
    cut = lambda every, n: F.array_join(F.slice(every, F.lit(1), 2 + _at(uniform(f"{seed}:cut", key), n - 2)), " ")
    return let(words(text), lambda every: F.when(F.size(every) > 3, cut(every, F.size(every))).otherwise(text))


def perturb(
    df: DataFrame, text: str, brand: str, key: str, seed: int = 42, typo_p: float = 0.3, swap_p: float = 0.2, drop_p: float = 0.2,
    cut_p: float = 0.15, empty_p: float = 0.05,
) -> DataFrame:
    """``df`` with ``text`` perturbed by word dropout, truncation, swap and typo, each with its probability; all zero leaves
    texts but for white space. A step uses its input several times; ``let`` has it computed once."""
    draw = lambda step, p: uniform(f"{seed}:{step}?", F.col(key)) < p
    k = F.col(key)
    steps = (
        lambda t: F.when(draw("drop", drop_p), drop_words(t, F.col(brand), k, seed)).otherwise(t),
        lambda t: F.when(draw("cut", cut_p), truncate(t, k, seed)).otherwise(t),
        lambda t: F.when(draw("swap", swap_p), swap(t, k, seed)).otherwise(t),
        lambda t: F.when(draw("typo", typo_p), typo(t, k, seed)).otherwise(t),
        collapse_spaces,
    )
    now = F.col(text)
    for step in steps:
        now = let(now, step)
    out, now = df.withColumn("_text", now), F.col("_text")
    blank = F.coalesce(F.trim(F.col(text)), F.lit("")) == ""
    result = F.when(blank | draw("empty", empty_p), "").otherwise(F.when(now == "", F.col(text)).otherwise(now))
    return out.withColumn(text, result).drop("_text")
