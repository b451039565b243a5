"""Hierarchical multi-length packing of tokenised documents.

Each task reads its rows once: tokenise, route, pack, emit pieces. Documents are routed by
length to tiers (context sizes); whole long-context windows are cut from long documents first.
A tier's windows are seeded with its own documents, and the gap behind each is filled with the
longest pieces of shorter tiers that fit, as long as these have more than their ``reserve``, a share that
stays for windows of their own; beyond it a piece is cut, its rest routed anew. Windows come out full.
What a task has left at its end is less than one window; it goes out as full windows of
power-of-two sizes. The windows of a flush form steps: the largest first, each goes to the step of fewest
tokens, so steps have equal tokens (but for one of the smallest windows) and every tier's windows are spread over them.

A task holds the tokens of ``hold`` ids at most, plus its longest document; nothing is shuffled,
so a lost executor costs its own partitions. Sequence ids carry the partition number; the layout
depends on how the input is split, not on timing, and a retried task repeats it.

Defined results for odd input: a null or empty text is the end id alone, a null doc_id is carried,
repeated rows are packed each, an empty table gives no pieces, further columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "context long, step_group long"
)
#: The split pattern of the byte-level vocabulary: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TIERS = (2048, 1024, 512, 256)


#: Characters of white space in a row, and of a text to look for them, from which the faster encoder's matcher is not safe.
BLANK_RUN = 50_000


@lru_cache(maxsize=2)
def _encoders(path: str):
    """The tokenizer of the file at ``path``; the same vocabulary in the faster of the two public byte-level encoders, or none if the
    file splits, normalises or merges in another way than that encoder; and the added tokens' strings."""
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    added = [t["content"] for t in spec.get("added_tokens", [])]
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(c) for c in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain &= split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not spec.get("normalizer")
    pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
    merged = [model["vocab"].get(a + b, -1) for a, b in pairs]
    plain = plain and merged == sorted(merged) and len(set(merged)) == len(merged)
    if not plain:
        return exact, None, added
    ranks = {bytes(byte_of[c] for c in token): k for token, k in model["vocab"].items() if token not in added}
    return exact, tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), added


def encode(text: str | None, path: str, end_id: int) -> np.ndarray:
    """Ids of one text and the end id. Texts that hold an added token's string or very long white space take the exact encoder."""
    exact, fast, added = _encoders(path)
    text = text or ""
    slow = fast is None or any(a in text for a in added)
    slow = slow or (len(text) > BLANK_RUN and any(len(m[0]) > BLANK_RUN for m in re.finditer(r"\s+", text)))
    ids = exact.encode(text, add_special_tokens=False).ids if slow else fast.encode_ordinary(text)
    return np.array([*ids, end_id], dtype="<u4")


class Packer:
    """Packs pieces into full windows. A piece is (length, serial, doc_id, ids, start)."""

    def __init__(self, first_sequence: int, tiers: Sequence[int] = TIERS, step_tokens: int = 16384, reserve: float = 0.5):
        self.tiers, self.reserve = sorted(tiers, reverse=True), reserve
        self.pools: dict[int, list[tuple]] = {t: [] for t in self.tiers}
        self.held, self.serial, self.first, self.step_tokens = 0, 0, first_sequence, step_tokens
        self.sequences = self.steps = 0
        self.of: dict[int, int] = dict.fromkeys(self.tiers, 0)  # ids held by tier
        self.windows: list[tuple[int, list[tuple]]] = []  # windows without a step
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        top, at = self.tiers[0], 0
        while len(ids) - at >= top:
            self._emit(top, [(top, 0, doc_id, ids, at)])
            at += top
        if at < len(ids):
            self._route(len(ids) - at, doc_id, ids, at)

    def _route(self, length: int, doc_id: int | None, ids: np.ndarray, start: int) -> None:
        """To the shortest tier that holds the whole piece."""
        tier = min((t for t in self.tiers if t >= length), default=self.tiers[0])
        self.serial += 1
        insort(self.pools[tier], (length, self.serial, doc_id, ids, start), key=lambda p: p[:2])
        self.held += length
        self.of[tier] += length

    def _take(self, tier: int, k: int) -> tuple:
        piece = self.pools[tier].pop(k)
        self.held -= piece[0]
        self.of[tier] -= piece[0]
        return piece

    def _fill(self, gap: int, least: dict[int, float]) -> list[tuple]:
        """Pieces of ``gap`` ids in all; the pools must hold as many. Tiers with no more than their ``least`` give whole pieces only if no other can."""
        out = []
        while gap:
            free = [t for t in self.tiers if self.of[t] > least.get(t, 0)]
            for tier in free:  # longest whole piece that fits
                pool = self.pools[tier]
                if k := bisect_right(pool, (gap, 2**62), key=lambda p: p[:2]):
                    out.append(piece := self._take(tier, k - 1))
                    gap -= piece[0]
                    break
            else:  # none fits whole: the shortest of them is cut
                tier = min(free or [t for t in self.tiers if self.pools[t]])
                length, serial, doc_id, ids, start = self._take(tier, 0)
                cut = min(gap, length)
                out.append((cut, serial, doc_id, ids, start))
                if length > cut:
                    self._route(length - cut, doc_id, ids, start + cut)
                gap -= cut
        return out

    def flush(self, last: bool = False) -> None:
        """Full windows, tier by tier from the longest, of the pools' pieces; at the ``last`` call nothing is left."""
        least = {t: self.reserve * n for t, n in self.of.items()}
        for tier in self.tiers:
            least[tier] = 0
            while self.pools[tier] and self.held >= tier:
                seed = self._take(tier, len(self.pools[tier]) - 1)
                self._emit(tier, [seed, *self._fill(tier - seed[0], least)])
        while last and self.held:
            size = 1 << (self.held.bit_length() - 1)
            self._emit(min(size, self.tiers[0]), self._fill(min(size, self.tiers[0]), {}))
        self.compose()

    def _emit(self, context: int, pieces: list[tuple]) -> None:
        offset, rows = 0, []
        for length, _, doc_id, ids, start in pieces:
            crc = zlib.crc32(ids[start : start + length].tobytes())
            rows.append((doc_id, start, length, crc, len(ids), self.first + self.sequences, offset, context))
            offset += length
        self.windows.append((context, rows))
        self.sequences += 1

    def compose(self) -> None:
        """Deals the windows without a step to steps of equal tokens."""
        total = sum(context for context, _ in self.windows)
        steps = [(0, k) for k in range(max(1, round(total / self.step_tokens)))] if total else []
        for context, rows in sorted(self.windows, key=lambda w: -w[0]):
            tokens, step = heapq.heappop(steps)
            heapq.heappush(steps, (tokens + context, step))
            self.rows += [(*row, self.first + self.steps + step) for row in rows]
        self.steps += len(steps)
        self.windows = []


def _pack(batches: Iterator[pa.RecordBatch], path: str, end_id: int, tiers: Sequence[int], step_tokens: int, hold: int):
    packer = Packer(TaskContext.get().partitionId() << 40, tiers, step_tokens)
    names = [x.split()[0] for x in PIECES.split(", ")]

    def out() -> pa.RecordBatch:
        columns = list(zip(*packer.rows)) or [()] * len(names)
        packer.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                packer.add(doc_id, encode(text, path, end_id))
                if packer.held >= hold:
                    packer.flush()
                elif len(packer.windows) * packer.tiers[0] >= hold:
                    packer.compose()
            if len(packer.rows) >= 8192:
                yield out()
    packer.flush(last=True)
    yield out()


def pack(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, tiers: Sequence[int] = TIERS, step_tokens: int = 16384, hold: int = 2_000_000,
) -> DataFrame:
    """A row per piece of ``docs`` (doc_id, text): where its ids lie in the document and in its sequence, their crc32,
    the sequence's context size and its step group. Sequences are full: their length is ``context``."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda batches: _pack(batches, tokenizer_path, end_id, tuple(tiers), step_tokens, hold), PIECES)
