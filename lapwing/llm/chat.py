"""Quotation linking: from messages that quote each other to reply-ordered conversations.

Each message is parsed into its own lines and quoted blocks by nested quote level (leading ``>``
marks). Lines and blocks are normalised (marks off, case folded, white space collapsed) and hashed; a line of under
``LEAST_WORDS`` words says too little to name its source, unless it is a whole message or paragraph. So that quotations that were wrapped anew or cut are found,
runs of ``RUN`` words are hashed too, those that begin at words chosen by their own hash, the same in original and quotation.
The first message of a conversation that holds a passage of its own is the passage's original, so
each quoted passage joins one row at most, however often it is repeated. The message answered is the
original of most quoted words at the lowest matched level. Threads are found by pointer doubling.

Defined results for odd input: a null text is empty; rows without conversation or turn are carried
and not linked; rows that share conversation and turn share one link; of equally quoted originals the
latest is taken; a quotation of nothing known, or of a later turn, links nothing and is still taken
out of the body. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import table

_marks = re.compile(r"\s*((?:>\s?)+)")
#: Lines that introduce a quotation.
_attribution = re.compile(r"\s*(?:on\b.*\bwrote:|.{1,80}\bwrote:|-+\s*original message\s*-+)\s*", re.IGNORECASE)


#: Words of a line that stands for itself; words of a run, and one word in so many begins one.
LEAST_WORDS, RUN, ONE_IN = 3, 8, 4


def quote_lines(text: str | None) -> list[tuple[int, str]]:
    """(level, line without marks) of each line; lines that introduce a quotation take the level of what they introduce."""
    out = []
    for line in (text or "").split("\n"):
        m = _marks.match(line)
        out.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    for i in range(len(out) - 1):
        if out[i + 1][0] > out[i][0] and _attribution.fullmatch(out[i][1]):
            out[i] = (-1, out[i][1])
    return out


def normal(text: str) -> str:
    return " ".join(text.casefold().split())


def passage_key(text: str) -> bytes:
    return hashlib.blake2b(normal(text).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def runs(text: str) -> set[bytes]:
    """Hashes of the chosen runs of words of a text."""
    words = normal(text).split()
    at = [i for i in range(len(words) - RUN + 1) if zlib.crc32(words[i].encode("utf-8", "surrogatepass")) % ONE_IN == 0]
    return {passage_key(f"run {' '.join(words[i : i + RUN])}") for i in at}


def parse(text: str | None) -> tuple[str, list[tuple[int, int, bytes, int]]]:
    """The body without quotations, and (level, passage number, key, words) of passages: level 0 are the message's own
    (whole body, paragraphs, lines, runs), others are quoted (blocks of one level, then their lines and runs, under one number). The
    words of runs are negative."""
    lines = quote_lines(text)
    own = [line for level, line in lines if level == 0]
    body = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n")
    keys = {passage_key(p) for p in [body, *re.split(r"\n\s*\n", body), *(x for x in own if len(x.split()) >= LEAST_WORDS)] if normal(p)}
    out = [(0, 0, k, 0) for k in sorted(keys | runs(body))]
    number, i = 0, 0
    while i < len(lines):
        level, j = lines[i][0], i
        while j < len(lines) and lines[j][0] == level:
            j += 1
        block = [line for _, line in lines[i:j]]
        if level > 0 and normal(whole := "\n".join(block)):
            number += 1
            out.append((level, number, passage_key(whole), len(whole.split())))
            out += [(level, number, passage_key(line), len(line.split())) for line in block if len(line.split()) >= LEAST_WORDS and normal(line) != normal(whole)]
            out += [(level, number, key, -ONE_IN) for key in sorted(runs(whole))]
        i = j
    return body, out


PARSED = "conv_id long, turn long, role string, body string, n_quotes int, passages array<struct<level int, number int, key binary, words int>>"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    passage = pa.struct([("level", pa.int32()), ("number", pa.int32()), ("key", pa.binary()), ("words", pa.int32())])
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            parsed = [parse(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                part.column("conv_id"), part.column("turn"), part.column("role"), pa.array([b for b, _ in parsed], pa.string()),
                pa.array([max((p[1] for p in ps), default=0) for _, ps in parsed], pa.int32()),
                pa.array([[dict(zip(("level", "number", "key", "words"), p)) for p in ps] for _, ps in parsed], pa.list_(passage)),
            ], ["conv_id", "turn", "role", "body", "n_quotes", "passages"])


def link_quotations(messages: DataFrame) -> DataFrame:
    """``messages`` (conv_id, turn, role, text) sorted into reply order: conv_id, ``thread`` (turn of the message that
    opened it), turn, role, ``body`` without quotations, ``reply_to`` (turn, null at an opening), ``depth``,
    ``n_quotes`` (quoted blocks) and ``n_linked`` (of these, found in an earlier message)."""
    rows = messages.select(*[F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")], F.col("role").cast("string").alias("role"), "text")
    parsed = table(rows.mapInArrow(_parsed, PARSED), "messages")
    passages = parsed.filter("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", "p.*")
    originals = passages.filter("level = 0").groupBy("conv_id", "key").agg(F.min("turn").alias("original"))
    quoted = passages.filter("level > 0").join(originals, ["conv_id", "key"]).filter("original < turn")
    # Whole blocks stand for their lines where both are found, and lines for the runs in them.
    whole, runs_ = F.greatest("words", F.lit(0)), F.greatest(-F.col("words"), F.lit(0))
    quoted = quoted.groupBy("conv_id", "turn", "level", "number", "original").agg(F.max(whole).alias("whole"), F.sum(whole).alias("words"), F.sum(runs_).alias("runs"))
    weight = F.greatest("whole", F.least("words", 2 * F.col("whole")), "runs")
    votes = quoted.groupBy("conv_id", "turn", "level", "original").agg(F.sum(weight).alias("words"))
    links = votes.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "words", "original")).alias("best"))
    linked = quoted.groupBy("conv_id", "turn").agg(F.countDistinct("number").cast("int").alias("n_linked"))
    links = links.join(linked, ["conv_id", "turn"]).select("conv_id", "turn", F.col("best.original").alias("reply_to"), "n_linked")
    links = table(links, "links")

    # Pointer doubling: each round joins a message's ancestor with that ancestor's ancestor.
    up = links.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).alias("depth"))
    while True:
        above = up.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("next"), F.col("depth").alias("more"))
        stepped = up.join(above, ["conv_id", "thread"], "left")
        if stepped.filter("next is not null").isEmpty():
            break
        up = table(stepped.select("conv_id", "turn", F.coalesce("next", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "threads")
    out = parsed.drop("passages").join(links, ["conv_id", "turn"], "left").join(up, ["conv_id", "turn"], "left")
    out = out.select(
        "conv_id", F.coalesce("thread", "turn").alias("thread"), "turn", "role", "body", "reply_to",
        F.coalesce("depth", F.lit(0)).alias("depth"), "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
    )
    order = ("conv_id", "thread", "turn")
    return out.repartitionByRange(*order).sortWithinPartitions(*order)
