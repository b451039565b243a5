"""Alignment of two tokenizers over the same bytes, by byte-owner arrays.

``np.repeat`` writes the number of the token that owns each byte, once for tokenizer A and once for B. Neighbouring bytes with
another pair of owners start a link (an A and a B token that overlap); bytes at which both owners change start a group (both tokenizers
cut there). Both tokenizers treat blank-separated words alone, so each distinct word of a chunk of documents is encoded and aligned
once, all of them in one array, and a document is the sum of its words. Where a tokenizer has pieces that cross a blank, or does not
split there, whole texts take the place of words.

Documents are dealt to chunks of about ``CHUNK_BYTES`` by a hash, and each chunk is encoded and aligned once. What it found is written to a table:
its documents as numbers of its words, its words as places in its linked id pairs, and these pairs with counts. Totals are summed, each chunk gets
the totals of its own pairs back and adds them up by those numbers; texts are not read again. Neither the pairs nor the totals go through the driver
or to all tasks.

Defined results for odd input: a null or empty text, or one that either tokenizer does not spell byte by byte, has no tokens: zeros
and no groups, and its links are not counted; a null doc_id is carried; repeated rows are documents each, and all count;
an empty table gives no rows; further columns are ignored. A chunk holds one document at least, however long.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapwing.llm.common import partitions, table
from lapwing.llm.packing import BLANK_RUN, _encoders

#: Bytes of text in a chunk; bytes that are encoded at once.
CHUNK_BYTES, PIECE_BYTES = 8_000_000, 1_000_000
COUNTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long"
#: An aligned chunk: a row per document, whose ``n_words`` words stand from ``start``, and one row of the chunk's own: the documents' words as
#: numbers, how many links each distinct word has, these links one word after the other as places in ``pairs`` (all three ``packed``), how many
#: links of the chunk hold each pair, and the distinct words' groups (deflated lines) where these are asked for.
ALIGNED = (
    "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, start long, n_words long, "
    "words binary, sizes binary, links binary, groups binary, pairs array<long>, n array<long>"
)
_kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
_ALIGNED = pa.schema([(name, _kinds[kind]) for name, kind in map(str.split, ALIGNED.split(", "))])
_beside_blank = re.compile(r" \s|\s |^ | $")
_between_words = re.compile(r"(?<=\S) (?=\S)")
_long_blank = re.compile(rf"\s{{{BLANK_RUN},}}")


class Tokenizers:
    """Tokenizer A (a byte-level file) and B (a sentence-piece model), and the bytes of their ids."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.exact, (_, self.fast, _) = Tokenizer.from_file(path_a), _encoders(path_a)
        self.exact.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in a byte-level vocabulary
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*shown}))}
        vocabulary = self.exact.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            if all(c in byte_of for c in token):
                self.bytes_a[k] = bytes(byte_of[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        named = [self.b.is_control(k) or self.b.is_unknown(k) for k in range(len(pieces))]
        self.bytes_b = [b"" if named[k] else bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.by_word = self.fast is not None and not any(re.search("[^▁]▁", p) for k, p in enumerate(pieces) if not named[k])
        self.size_a, self.size_b = (np.array(list(map(len, x))) for x in (self.bytes_a, self.bytes_b))
        # Decimal ids with what may follow them.
        ids = range(max(len(self.bytes_a), len(self.bytes_b)))
        self.spelt = np.array([[f"{k}{mark}" for k in ids] for mark in ",|;"], object)

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of blank + ``text`` by A and of ``text`` by B, which puts the blank itself."""
        slow = self.fast is None or (len(text) >= BLANK_RUN and _long_blank.search(text))
        a = self.exact.encode(" " + text, add_special_tokens=False).ids if slow else self.fast.encode_ordinary(" " + text)
        return a, self.b.encode(text)

    def words(self, text: str) -> list[str]:
        """``text`` cut at blanks between words; the blank belongs to the word behind it."""
        if not self.by_word:
            return [text]
        return _between_words.split(text) if _beside_blank.search(text) else text.split(" ")


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


@dataclass
class Words:
    """Aligned words: counts of each (a row of ``n``: A tokens, B tokens, groups, links; zeros if it is not spelt byte by byte), their
    linked id pairs (``a << 32 | b``) one word after the other, and their groups as text."""

    n: np.ndarray
    spelt: np.ndarray
    pairs: np.ndarray
    groups: list[str]


def owners(sizes: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(sizes)), sizes)


def align(words: Sequence[str], t: Tokenizers) -> Words:
    """Words encoded as one text. If that is not spelt byte by byte, halves are, down to single words."""
    text = " ".join(words)
    a, b = t.encode(text)
    spelling = (" " + text).encode()
    if not text or b"".join(map(t.bytes_a.__getitem__, a)) != spelling or b"".join(map(t.bytes_b.__getitem__, b)) != spelling:
        if len(words) == 1:
            return Words(np.zeros((1, 4), np.int64), np.zeros(1, bool), np.empty(0, np.int64), [""])
        return joined([align(x, t) for x in (words[: len(words) // 2], words[len(words) // 2 :])])
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    size_a, size_b = t.size_a[a], t.size_b[b]
    own_a, own_b = owners(size_a), owners(size_b)
    new_a, new_b = (np.diff(x, prepend=-1) != 0 for x in (own_a, own_b))
    links, cuts = np.flatnonzero(new_a | new_b), np.flatnonzero(new_a & new_b)
    pairs = a[own_a[links]] << 32 | b[own_b[links]]
    starts = np.concatenate([[0], np.cumsum([len(w.encode()) + 1 for w in words])])
    from_a, from_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    upto = np.stack([np.searchsorted(x, starts) for x in (from_a, from_b, cuts, links)], axis=1)
    # Tokens in the order of the groups' text, each with what follows it.
    group_a, group_b = (np.searchsorted(cuts, x, "right") for x in (from_a, from_b))
    order = np.empty(len(a) + len(b), object)
    last_a, last_b = (np.append(np.diff(g) != 0, True) for g in (group_a, group_b))
    order[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = t.spelt[last_a * 1, a]
    order[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = t.spelt[last_b * 2, b]
    order, at = order.tolist(), (upto[:, 0] + upto[:, 1]).tolist()
    return Words(np.diff(upto, axis=0), np.ones(len(words), bool), pairs, ["".join(order[i:j]) for i, j in zip(at, at[1:])])


def joined(parts: list[Words]) -> Words:
    return Words(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("n", "spelt", "pairs")), [g for p in parts for g in p.groups])


class _Names(dict):
    """Word -> number; a word not seen yet takes the next."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Chunk:
    """The documents of a chunk as numbers of its distinct aligned words."""

    def __init__(self, texts: Sequence[str | None], t: Tokenizers):
        names = _Names()
        rows = []
        for x in texts:
            words = t.words(x) if x else []
            rows.append(np.fromiter(map(names.__getitem__, words), np.int64, len(words)))
        # A word that ends in white space would join the blank of the next one: it is encoded alone.
        parts, some, held = [], [], 0
        order, alone = [], []
        for word, k in names.items():
            if not t.by_word or not word or word[-1].isspace():
                alone.append(k)
                parts.append(align([word], t))
        for word, k in names.items():
            if t.by_word and word and not word[-1].isspace():
                order.append(k)
                some.append(word)
                held += len(word)
                if held >= PIECE_BYTES:
                    parts.append(align(some, t))
                    some, held = [], 0
        if some:
            parts.append(align(some, t))
        self.words = joined(parts) if parts else Words(np.zeros((0, 4), np.int64), np.zeros(0, bool), np.empty(0, np.int64), [])
        place = np.empty(len(names), np.int64)
        place[alone + order] = np.arange(len(names))
        rows = [place[r] for r in rows]
        self.rows = [r if len(r) and self.words.spelt[r].all() else r[:0] for r in rows]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct linked id pairs, how many links of the chunk hold them, and the place among them of each link of the words. A link of a
        word that stands only in documents without tokens has any place."""
        times = np.bincount(np.concatenate([np.empty(0, np.int64), *self.rows]), minlength=len(self.words.n))
        pairs, which = np.unique(self.words.pairs, return_inverse=True)
        n = np.bincount(which, weights=np.repeat(times, self.words.n[:, 3]), minlength=len(pairs)).astype(np.int64)
        return pairs[n > 0], n[n > 0], np.maximum(np.cumsum(n > 0) - 1, 0)[which]

    def groups(self) -> list[str]:
        return [grouped(self.words.groups, r) for r in self.rows]


def grouped(groups: Sequence[str], words: np.ndarray) -> str:
    """The groups of a document of these words, as text."""
    return "".join(map(groups.__getitem__, words.tolist()))[:-1]


def run_sums(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of ``sizes[i]`` values from ``starts[i]``."""
    upto = np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0)])
    return upto[starts + sizes] - upto[starts]


def packed(values: np.ndarray) -> bytes:
    """Numbers under 2**32, deflated. Their lowest bytes come first and their highest last: most numbers are small, so these are runs of zeros."""
    return zlib.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def _dealt(docs: DataFrame) -> DataFrame:
    """(chunk, doc_id, text) of ``docs``; equal rows share a chunk."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(-(-size // CHUNK_BYTES), partitions(docs.sparkSession))
    return rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(chunks)))


def _aligned(docs: DataFrame, path_a: str, path_b: str, whole_groups: bool) -> DataFrame:
    """Aligned chunks of ``docs``, as ``ALIGNED`` says; digests of the groups or, with ``whole_groups``, the words' groups."""

    def chunk_rows(key: tuple, rows: pa.Table) -> pa.Table:
        chunk = Chunk(rows["text"].to_pylist(), tokenizers(path_a, path_b))
        words, n_words = np.concatenate(chunk.rows), np.array([len(r) for r in chunk.rows], np.int64)
        start = np.cumsum(n_words) - n_words
        counts = dict(zip(("n_a", "n_b", "n_groups", "n_links"), run_sums(chunk.words.n[words], start, n_words).T))
        documents = {"doc_id": rows["doc_id"], **counts, "start": start, "n_words": n_words}
        pairs, n, links = chunk.pairs()
        own = {"words": packed(words), "sizes": packed(chunk.words.n[:, 3]), "links": packed(links), "pairs": pairs.tolist(), "n": n.tolist()}
        if whole_groups:
            own["groups"] = zlib.compress("\n".join(chunk.words.groups).encode(), 1)
        else:
            documents["groups_sha256"] = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in chunk.groups()]
        own = {c: pa.array([x], _ALIGNED.field(c).type) for c, x in own.items()}
        parts = [pa.table(x | {"chunk": pa.repeat(key[0], size)}) for x, size in ((documents, len(rows)), (own, 1))]
        return pa.concat_tables([_ALIGNED.empty_table(), *parts], promote_options="default")

    return _dealt(docs).groupBy("chunk").applyInArrow(chunk_rows, ALIGNED)


def _chunk_pairs(aligned: DataFrame) -> DataFrame:
    """(from_chunk, pair, n)"""
    each = aligned.filter("pairs IS NOT NULL").select("chunk", F.explode(F.arrays_zip("pairs", "n")).alias("x"))
    return each.select(F.col("chunk").alias("from_chunk"), F.col("x.pairs").alias("pair"), F.col("x.n").alias("n"))


def _totals(counted: DataFrame) -> DataFrame:
    """(pair, total, best): links of each id pair in the corpus, and whether its B id has no pair of more. A B id has pairs with
    each A id at most."""
    totals = counted.groupBy("pair").agg(F.sum("n").alias("total"))
    most = F.max("total").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit(2**32 - 1))))
    return totals.withColumn("best", F.col("total") == most)


def id_pairs(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(a_id, b_id, n_links, best): id pairs that are linked in ``docs`` (doc_id, text), with their links, and whether no A id is linked to the B id more often."""
    totals = _totals(_chunk_pairs(_aligned(docs, path_a, path_b, False)))
    return totals.select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("b_id"), F.col("total").alias("n_links"), "best")


def align_documents(docs: DataFrame, path_a: str, path_b: str, whole_groups: bool = True) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): tokens of A and B, groups, links, links whose id pair is the best of its B id, the sum of the pairs'
    corpus-wide links over the links, and ``groups`` as text (``a1,a2|b1;a3|b2,b3``). That text is about five times the
    document; with ``whole_groups=False`` its digest is made in the task (``groups_sha256``, '' without tokens)."""
    aligned = table(_aligned(docs, path_a, path_b, whole_groups), "aligned-chunks")
    counted = _chunk_pairs(aligned)
    # As a table of its own: the shuffled texts are dropped before the aligned chunks are shuffled.
    answers = table(counted.select("from_chunk", "pair").join(_totals(counted), "pair"), "answers")
    last = "groups" if whole_groups else "groups_sha256"

    def finish(rows: pa.Table, known: pa.Table) -> pa.Table:
        documents, own = rows.filter(pc.is_null(rows["words"])), rows.filter(pc.is_valid(rows["words"])).to_pylist()[0]
        words, sizes, links = (unpacked(own[c]) for c in ("words", "sizes", "links"))
        start, n_words = (documents[c].to_numpy() for c in ("start", "n_words"))
        known = known.sort_by("pair")
        values = np.column_stack([known[c].cast(pa.int64()).to_numpy() for c in ("best", "total")])
        # Without any pair there are only documents without tokens.
        of_words = run_sums(values[links], np.cumsum(sizes) - sizes, sizes) if len(values) else np.zeros((len(sizes), 2), np.int64)
        best, total = run_sums(of_words[words], start, n_words).T
        out = documents.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"]).append_column("n_best", pa.array(best)).append_column("count_sum", pa.array(total))
        if not whole_groups:
            return out.append_column(last, documents[last])
        groups = zlib.decompress(own["groups"]).decode().split("\n")
        return out.append_column(last, pa.array([grouped(groups, words[i : i + n]) for i, n in zip(start, n_words)], pa.string()))

    return aligned.drop("pairs", "n").groupBy("chunk").cogroup(answers.groupBy("from_chunk")).applyInArrow(finish, f"{COUNTS}, {last} string")
