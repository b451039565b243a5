"""Suffix-array deduplication: maximal repeats from the interval tree of an enhanced suffix array.

The suffixes of all texts are split by content: a window of 50 bytes belongs to the shard of its
key (see ``repeats``), so all equal windows of the corpus meet in one shard, whatever their
documents. A first exchange sends, for every run, its key, a hash of its context and its document, packed by chunk of text. A key
that one document holds has no repeated window. Under a key with one context in all of the corpus, every occurrence but the
first is a repeat from end to end (whole copies are mostly of this kind). Contexts of the other keys are sent, equal ones once per chunk of
text, with the least document of the chunk that has them; where they stand stays with the chunk. A shard sorts the
suffixes of its distinct contexts, eight bytes at a time, takes the array of common prefixes, and scans it with a stack, which gives
the tree of common-prefix intervals of 50 bytes or more. An interval whose members are preceded by different bytes
is a maximal repeat group, with every occurrence among its members; a context's first place counts as preceded by a byte of
its own, as what stands in front lies in another shard. Equal contexts of several documents are a group of their own.

Bytes go by these groups: a suffix loses the bytes of the longest group around it that an earlier document is a member of. Every repeated
window lies in such a group: to the left, its members stay the same until they differ or the context begins. Of the
groups around a suffix, one pointer to the next with an earlier document is kept, so a periodic text costs a step per suffix.
Answers go to chunks: a passage that very many documents share is one context per chunk of text in its shard, and
a chunk's documents are bounded. Shards hold some megabytes of text, in proportion to the input in number.

Groups are cut at contexts there. ``repeat_groups`` joins what belongs together and returns whole groups.

Defined results for odd input: a null text is empty; a row without doc_id stays whole and removes
nothing; rows that share a doc_id never remove each other's bytes, and each is judged by its own
text; texts shorter than a window stay whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import U64, table
from lapwing.llm.repeats import Windows, by_shard, codes, count_shards, covered, home_shard, spans, text_id


def packed(x: np.ndarray) -> bytes:
    """Numbers that are not negative, in 32 bits where these hold all of them, else in 64."""
    return x.astype(np.uint32 if x.max(initial=0) < 2**32 else np.int64).tobytes()


def unpacked(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, np.uint32 if len(x) == 4 * n else np.int64).astype(np.int64)


RUNS = "shard int, chunk long, first long, base long, docs binary, keys binary, runs binary, several binary"


def _runs(batches: Iterator[pa.RecordBatch], spec: Windows, shards: int, chunk_bytes: int, within: bool) -> Iterator[pa.RecordBatch]:
    """Entries of a chunk by shard: distinct (key, context hash), numbered from ``first``, with the least document (from ``base``) and whether there are
    several (or several places, with ``within``). The other documents of an entry are listed for the chunk itself, as (entry, document), in a row without keys."""
    read, chunk = spec.reader(), TaskContext.get().partitionId() << 32
    docs: list[int] = []
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0

    def send() -> pa.RecordBatch:
        nonlocal chunk, docs, found, held
        rows = []
        if found:
            code, run, many = map(np.concatenate, zip(*found))
            ids = np.repeat(np.array(docs, np.int64), [len(x[0]) for x in found])
            order = np.lexsort((ids, run, code))
            code, run, many, ids = code[order], run[order], many[order], ids[order]
            new = np.concatenate([[True], (code[1:] != code[:-1]) | (run[1:] != run[:-1])])
            at = np.flatnonzero(new)
            least = ids[at]
            several = np.maximum.reduceat(ids, at) != least
            entry = np.cumsum(new) - 1
            listed = np.flatnonzero((ids != least[entry]) & np.concatenate([[True], (ids[1:] != ids[:-1]) | new[1:]]))
            if len(listed):
                rows.append((home_shard(chunk, shards), chunk, -1, int(ids.min()), packed(ids[listed] - ids.min()), b"", entry[listed].astype(np.uint32).tobytes(), b""))
            if within:
                several |= np.logical_or.reduceat(many, at) | (np.diff(np.append(at, len(ids))) > 1)
            code, run, base = code[at], run[at], int(least.min())
            for s, i, j in by_shard((code >> U64(32)).astype(np.int64)):
                rows.append((s, chunk, i, base, packed(least[i:j] - base), code[i:j].astype(np.uint32).tobytes(), run[i:j].tobytes(), np.packbits(several[i:j]).tobytes()))
        chunk, docs, found, held = chunk + 1, [], [], 0
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4)
        names = [x.split()[0] for x in RUNS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(types), types)], names)

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
            text = texts[i].as_py()
            if doc_id is None or not text or len(text) < spec.width:
                continue
            v = read(text)
            starts, lengths, keys = spec.runs(v)
            docs.append(doc_id)
            # A run longer than the windows around one gram holds that gram twice.
            found.append((codes(keys, shards), spec.contents(v, starts, lengths), lengths > spec.width - spec.gram + 1))
            held += len(text)
            if held >= chunk_bytes:
                yield send()
    yield send()


#: What becomes of a document's runs under a key: their contexts are sent, or they go, or they go but for the chunk's least document.
SEND, GO, OTHERS_GO = range(3)
TOLD = "chunk long, shard int, base long, docs binary, entries binary, keys binary, states binary"


def _told(key: tuple, pdf: pd.DataFrame, within: bool) -> pd.DataFrame:
    """A shard's answers to chunks: entries, their least documents and what becomes of them. Lists of chunks pass through."""
    names = [x.split()[0] for x in TOLD.split(", ")]
    lists, sent = pdf[pdf["first"] < 0], pdf[pdf["first"] >= 0]
    rows = [(c, -1, b, d, r, b"", b"") for c, b, d, r in zip(lists["chunk"], lists["base"], lists["docs"], lists["runs"])]
    if len(sent):
        each = [np.frombuffer(k, np.uint32) for k in sent["keys"]]
        keys, runs = np.concatenate(each), np.frombuffer(b"".join(sent["runs"]), U64)
        docs = np.concatenate([unpacked(d, len(k)) + b for d, k, b in zip(sent["docs"], each, sent["base"])])
        several = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(k)) for m, k in zip(sent["several"], each)]).astype(bool)
        order = np.lexsort((runs, keys))
        k, r, d, m = keys[order], runs[order], docs[order], several[order]
        at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(at, len(k)))
        low, some = np.minimum.reduceat(d, at), np.logical_or.reduceat(m, at)
        repeated = some | (np.maximum.reduceat(d, at) != low)
        mixed = (np.maximum.reduceat(r, at) != np.minimum.reduceat(r, at)) | within
        low, repeated, mixed = np.repeat(low, size), np.repeat(repeated, size), np.repeat(mixed, size)
        state = np.empty(len(keys), np.int8)
        state[order] = np.where(~repeated, -1, np.where(mixed, SEND, np.where(d > low, GO, np.where(m, OTHERS_GO, -1))))
        at = 0
        for chunk, first, base, own in zip(sent["chunk"], sent["first"], sent["base"], each):
            here = state[at : at + len(own)]
            use = np.flatnonzero(here >= 0)
            if len(use):
                rows.append((chunk, key[0], base, packed(docs[at + use] - base), (first + use).astype(np.uint32).tobytes(), own[use].tobytes(), here[use].tobytes()))
            at += len(own)
    return pd.DataFrame(rows, columns=names).astype({"chunk": "int64", "shard": "int32", "base": "int64"})


def _for_documents(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """A chunk's answers, by document: codes of keys whose contexts are to be sent, and of those that go."""
    told, lists = pdf[pdf["shard"] >= 0], pdf[pdf["shard"] < 0]
    sizes = [len(x) for x in told["states"]]
    joined = lambda arrays: np.concatenate([*arrays, np.empty(0, np.int64)])
    least = joined(unpacked(d, n) + b for d, n, b in zip(told["docs"], sizes, told["base"]))
    entries = np.frombuffer(b"".join(told["entries"]), np.uint32).astype(np.int64)
    code = np.frombuffer(b"".join(told["keys"]), np.uint32) | (np.repeat(told["shard"].to_numpy().astype(U64), sizes) << U64(32))
    state = np.frombuffer(b"".join(told["states"]), np.int8)
    order = np.argsort(entries)
    least, entries, code, state = least[order], entries[order], code[order], state[order]
    of = np.frombuffer(b"".join(lists["entries"]), np.uint32).astype(np.int64)
    ids = joined(unpacked(d, len(r) // 4) + b for d, r, b in zip(lists["docs"], lists["entries"], lists["base"]))
    at = np.minimum(np.searchsorted(entries, of), max(0, len(entries) - 1))
    hit = (entries[at] == of) & (ids != least[at]) if len(entries) else np.zeros(len(of), bool)
    alone = state != OTHERS_GO
    docs, code, go = np.concatenate([least[alone], ids[hit]]), np.concatenate([code[alone], code[at[hit]]]), np.concatenate([state[alone], state[at[hit]]]) != SEND
    order = np.lexsort((code, go, docs))
    docs, code, go = docs[order], code[order], go[order]
    rows = [(d, code[i:j][~go[i:j]].tobytes(), code[i:j][go[i:j]].tobytes()) for d, i, j in by_shard(docs)]
    return pd.DataFrame(rows, columns=["doc_id", "keys", "gone"]).astype({"doc_id": "int64"})


def repeated_runs(docs: DataFrame, spec: Windows, shards: int, chunk_bytes: int, within: bool = False) -> DataFrame:
    """(doc_id, keys): for each document with repeated keys, arrays of their codes: those to ``send`` and those that have ``gone``. With
    ``within``, keys that stand twice in one document count, and all are to be sent."""
    sent = docs.mapInArrow(lambda b: _runs(b, spec, shards, chunk_bytes, within), RUNS)
    told = sent.groupBy("shard").applyInPandas(lambda key, pdf: _told(key, pdf, within), TOLD)
    found = told.groupBy("chunk").applyInPandas(_for_documents, "doc_id long, keys binary, gone binary")
    return table(found.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("keys").alias("send"), "gone")).alias("keys")), "repeated")


#: Kinds of messages: contexts of a chunk, for a shard; where they stand, for the chunk itself.
SENT, STANDS = range(2)
#: Of contexts: numbers in the chunk, least documents, lengths, packed bytes. Of places: context numbers, starts, document numbers, documents, lengths of contexts;
#: and, as rows of an array, document numbers, begins and ends of what goes in any case.
MESSAGE = "shard int, chunk long, kind int, a binary, b binary, c binary, d binary, e binary, f binary"
DOCUMENT = np.dtype([("doc_id", np.int64), ("text_id", np.int64)])


def _contexts(batches: Iterator[pa.RecordBatch], spec: Windows, shards: int, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """Contexts under repeated keys, packed by shard, and their places; each context's bytes once per chunk."""
    read, packer = spec.reader(), zstandard.ZstdCompressor(level=3)
    chunk = TaskContext.get().partitionId() << 32
    known: dict[bytes, int] = {}
    home: list[int] = []
    seen: list[tuple[int, int, int]] = []
    docs: list[tuple[int, int]] = []
    cut: list[np.ndarray] = []
    held = 0

    def send() -> pa.RecordBatch:
        nonlocal chunk, known, home, seen, docs, cut, held
        rows = []
        if docs:
            doc, start, context = np.array(seen, np.int64).reshape(-1, 3).T
            table_of = np.array(docs, DOCUMENT)
            bodies, shard = np.array([*known, None], object)[:-1], np.array(home, np.int64)
            lengths = np.array([len(b) for b in known], np.uint32)
            least = np.full(len(shard), np.iinfo(np.int64).max)
            np.minimum.at(least, context, table_of["doc_id"][doc])
            u32 = lambda x: x.astype(np.uint32).tobytes()
            rows.append((home_shard(chunk, shards), chunk, STANDS, u32(context), u32(start), u32(doc), table_of.tobytes(), lengths.tobytes(), u32(np.concatenate([np.empty((3, 0), np.int64), *cut], axis=1))))
            order = np.argsort(shard, kind="stable")
            for s, at, to in by_shard(shard[order]):
                c = order[at:to]
                rows.append((s, chunk, SENT, u32(c), least[c].tobytes(), lengths[c].tobytes(), packer.compress(b"".join(bodies[c].tolist())), b"", b""))
        chunk, known, home, seen, docs, cut, held = chunk + 1, {}, [], [], [], [], 0
        types = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 6)
        names = [x.split()[0] for x in MESSAGE.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(types), types)], names)

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
            text = texts[i].as_py() or b""
            told = batch.column("keys")[i].as_py()
            starts, lengths, keys = spec.runs(read(text))
            code = codes(keys, shards)
            use = np.isin(code, np.frombuffer(b"".join(t["send"] for t in told), U64))
            docs.append((doc_id, text_id(text)))
            if gone := b"".join(t["gone"] for t in told):
                go = np.isin(code, np.frombuffer(gone, U64))
                cut.append(np.array([np.full(go.sum(), len(docs) - 1), starts[go], (starts + lengths - 1 + spec.width)[go]]))
            for s, n, shard in zip(starts[use].tolist(), lengths[use].tolist(), (code[use] >> U64(32)).tolist()):
                body = text[s : s + n - 1 + spec.width]
                at = known.setdefault(body, len(known))
                if at == len(home):
                    home.append(shard)
                seen.append((len(docs) - 1, s, at))
            held += len(text)
            if held >= chunk_bytes:
                yield send()
    yield send()


def equal_bytes(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of numbers that are not zero."""
    return sum((x < (U64(1) << U64(64 - 8 * k))).astype(np.int64) for k in range(1, 8))


#: Bytes from which a context is long.
LONG = 512


class SuffixArray:
    """An enhanced suffix array of several texts, of the suffixes of ``least`` bytes or more.

    ``place`` has these suffixes' places in the joined texts, in sorted order, ``text`` the text of each, ``common[i]`` the bytes that the
    i-th shares with the one before (none past the end of its text), ``before[i]`` the byte in front, -1 at a start.
    """

    def __init__(self, texts: list[bytes], least: int):
        lengths = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(lengths) - lengths
        body = b"".join(texts)
        wide = np.ndarray(len(body) + 1, ">u8", body + bytes(9), strides=(1,))  # the eight bytes from each place on
        place, self.text = expand(self.start, np.maximum(lengths - least + 1, 0))
        left = (self.start + lengths)[self.text] - place

        def words(of: np.ndarray, offset: int) -> np.ndarray:
            """Eight bytes of some suffixes, zeros behind their ends."""
            rest = left[of] - offset
            out = wide[np.minimum(place[of] + offset, len(body))].astype(U64)
            out[rest <= 0] = 0
            short = np.flatnonzero((rest > 0) & (rest < 8))
            shift = U64(8) * (8 - rest[short]).astype(U64)
            out[short] = (out[short] >> shift) << shift
            return out

        n, most = len(place), int(left.max(initial=0))
        common = np.zeros(n, np.int64)
        w = words(np.arange(n), 0)
        order = np.argsort(w, kind="stable")
        w = w[order]
        new = np.ones(n + 1, bool)
        new[1:n] = w[1:] != w[:-1]
        if least < 8:
            common[1:] = equal_bytes(w[1:] ^ w[:-1])
        tied, offset = np.flatnonzero(~(new[:-1] & new[1:])), 8
        while len(tied) and offset < min(most, LONG):  # suffixes that are equal so far are sorted by their next bytes
            group, own = np.cumsum(new[tied]) - 1, order[tied]
            w = words(own, offset)
            same = group[1:] == group[:-1]
            torn = np.zeros(group[-1] + 1, bool)
            torn[group[1:][same & (w[1:] != w[:-1])]] = True
            some = np.flatnonzero(torn[group])
            if len(some):
                by = some[np.lexsort((w[some], group[some]))]
                order[tied[some]], w[some] = own[by], w[by]
                apart = np.flatnonzero(same & (w[1:] != w[:-1])) + 1
                common[tied[apart]] = offset + equal_bytes(w[apart] ^ w[apart - 1])
                new[tied[apart]] = True
                tied = tied[~(new[tied] & new[tied + 1])]
            offset += 8
        if len(tied):  # last, shorter ones go first, and what is longer still is ranked by itself
            group, own = np.cumsum(new[tied]), order[tied]
            at = lambda k: (self.text[k], place[k] - self.start[self.text[k]])
            doubled = Doubled(texts, lengths) if most > LONG else None
            order[tied] = own = own[np.lexsort((left[own] if doubled is None else doubled.rank(*at(own), left[own]), group))]
            pair = np.flatnonzero(group[1:] == group[:-1]) + 1
            i, j = own[pair], own[pair - 1]
            common[tied[pair]] = np.minimum(left[i], left[j])
            if doubled is not None:
                longer = np.minimum(left[i], left[j]) > LONG
                common[tied[pair[longer]]] = doubled.common(at(i[longer]), at(j[longer]))
        if n:
            common[1:] = np.minimum(common[1:], np.minimum(left[order[1:]], left[order[:-1]]))
        self.place, self.text, self.common = place[order], self.text[order], common
        front = np.frombuffer(body + b" ", np.uint8)[self.place - 1].astype(np.int64)
        self.before = np.where(self.place == self.start[self.text], -1, front)


class Doubled:
    """Ranks, by prefix doubling, of the suffixes of those texts that are long: a context is long if it is periodic, and then its
    suffixes have most of their bytes in common."""

    def __init__(self, texts: list[bytes], lengths: np.ndarray):
        chosen = np.flatnonzero(lengths > LONG)
        lengths = lengths[chosen]
        self.start = np.full(len(texts), -1)
        self.start[chosen] = np.cumsum(lengths + 1) - (lengths + 1)  # an end mark behind each text, below all bytes
        self.n = n = int(lengths.sum() + len(lengths))
        symbols = np.zeros(n, np.int64)
        symbols[expand(self.start[chosen], lengths)[0]] = np.frombuffer(b"".join(texts[c] for c in chosen.tolist()), np.uint8).astype(np.int64) + 1
        self.ranks, size = {1: symbols}, 1
        while size < lengths.max():
            pair = self.ranks[size] * np.int64(n + 258)
            pair[: n - size] += self.ranks[size][size:]
            size *= 2
            self.ranks[size] = np.unique(pair, return_inverse=True)[1]
        self.size = size

    def rank(self, text: np.ndarray, offset: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Of suffixes that are equal for ``LONG`` bytes: those no longer than that come first."""
        return np.where(left > LONG, self.n + self.ranks[self.size][np.maximum(self.start[text], 0) + np.where(left > LONG, offset, 0)], left)

    def common(self, x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        i, j = self.start[x[0]] + x[1], self.start[y[0]] + y[1]
        out, n = np.zeros(len(i), np.int64), self.n
        for size in sorted(self.ranks, reverse=True):
            rank = self.ranks[size]
            out += size * ((rank[np.minimum(i + out, n - 1)] == rank[np.minimum(j + out, n - 1)]) & (np.maximum(i, j) + out + size <= n))
        return out


@dataclass
class Intervals:
    """Intervals of a common-prefix tree, children before parents: the bytes in common, the first and the last member, whether
    members are preceded by different bytes, their least document, the parent (-1: none); and each suffix's innermost interval (-1: none)."""

    length: np.ndarray
    first: np.ndarray
    last: np.ndarray
    diverse: np.ndarray
    document: np.ndarray
    parent: np.ndarray
    of: np.ndarray


def interval_tree(common: np.ndarray, before: np.ndarray, documents: np.ndarray, least: int) -> Intervals:
    """The intervals with ``least`` bytes or more: a stack scan that carries up the byte in front of the members (-1: different
    ones) and their least document."""
    busy = np.flatnonzero(np.concatenate([common[1:] >= least, [False]]) | (common >= least)) if len(common) else np.empty(0, np.int64)
    places, common_, before_, docs_ = busy.tolist(), common[busy].tolist(), before[busy].tolist(), documents[busy].tolist()
    nodes: list[list[int]] = []  # bytes, first, last, byte in front, least document, parent
    done: list[int] = []
    inner: list[int] = []
    stack: list[int] = []

    def add(node: list[int], byte: int, doc: int) -> None:
        if node[3] != byte:
            node[3] = -1
        if doc < node[4]:
            node[4] = doc

    for k in range(1, len(places) + 1):
        now = common_[k] if k < len(places) else 0
        first, byte, doc, child = places[k - 1], before_[k - 1], docs_[k - 1], -1
        own = stack[-1] if stack and nodes[stack[-1]][0] >= now else -1
        while stack and nodes[stack[-1]][0] > now:
            name = stack.pop()
            node = nodes[name]
            add(node, byte, doc)
            if child >= 0:
                nodes[child][5] = name
            node[2] = places[k - 1]
            done.append(name)
            first, byte, doc, child = node[1], node[3], node[4], name
        if now >= least:
            if stack and nodes[stack[-1]][0] == now:
                add(nodes[stack[-1]], byte, doc)
            else:
                stack.append(len(nodes))
                nodes.append([now, first, -1, byte, doc, -1])
            if child >= 0:
                nodes[child][5] = stack[-1]
            if own < 0:
                own = stack[-1]
        inner.append(own)
    columns = np.array([nodes[name] for name in done], np.int64).reshape(-1, 6).T
    renamed = np.full(len(nodes) + 1, -1)
    renamed[np.array(done, np.int64)] = np.arange(len(done))
    of = np.full(len(common), -1)
    of[busy] = renamed[np.array(inner, np.int64)]
    length, first, last, byte, document, parent = columns
    return Intervals(length, first, last, byte == -1, document, renamed[parent], of)


def expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges [first, first + count), and which range each is of."""
    which = np.repeat(np.arange(len(count)), count)
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[which], which


def repeated_parts(contexts: list[bytes], earliest: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, begin, end) of the bytes of a context that maximal groups with members in documents before the context's own
    ``earliest`` cover."""
    array = SuffixArray(contexts, least)
    own = earliest[array.text]
    tree = interval_tree(array.common, array.before, own, least)
    n = len(tree.length)
    # Of each interval: the innermost diverse one around it, and the next around that with an earlier document.
    around, earlier = [-1] * (n + 1), [-1] * (n + 1)
    diverse, document, parent = tree.diverse.tolist(), tree.document.tolist(), tree.parent.tolist()
    for v in range(n - 1, -1, -1):
        outer = around[parent[v]] if parent[v] >= 0 else -1
        if not diverse[v]:
            around[v], earlier[v] = outer, earlier[parent[v]] if parent[v] >= 0 else -1
        else:
            around[v] = v
            earlier[v] = outer if outer < 0 or document[outer] < document[v] else earlier[outer]
    around, earlier = np.array(around), np.array(earlier)
    member = np.flatnonzero(tree.of >= 0)
    group = around[tree.of[member]]
    documents = np.append(tree.document, np.iinfo(np.int64).max)
    group = np.where(documents[group] < own[member], group, earlier[group])
    hit = group >= 0
    member, group = member[hit], group[hit]
    context = array.text[member]
    begin = array.place[member] - array.start[context]
    return context, begin, begin + tree.length[group]


#: Of answers: contexts that go wherever they stand in the chunk; contexts, begins and ends of parts of them that do.
ANSWER = "chunk long, kind int, a binary, b binary, c binary, d binary, e binary, f binary"


def _joined(pdf: pd.DataFrame) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    """A shard's distinct contexts, their numbers in each message, and each context's least document."""
    known: dict[bytes, int] = {}
    numbers = []
    unpack = zstandard.ZstdDecompressor()
    for sizes, body in zip(pdf["c"], pdf["d"]):
        body, sizes = unpack.decompress(body), np.frombuffer(sizes, np.uint32)
        ends = np.cumsum(sizes, dtype=np.int64).tolist()
        numbers.append(np.array([known.setdefault(body[e - n : e], len(known)) for e, n in zip(ends, sizes.tolist())], np.int64))
    earliest = np.full(len(known), np.iinfo(np.int64).max)
    for number, docs in zip(numbers, pdf["b"]):
        np.minimum.at(earliest, number, np.frombuffer(docs, np.int64))
    return list(known), numbers, earliest


def _repeated(key: tuple, pdf: pd.DataFrame, least: int) -> pd.DataFrame:
    """A shard's answers to chunks, and the places that pass through it."""
    names = [x.split()[0] for x in ANSWER.split(", ")]
    passed, sent = pdf.loc[pdf["kind"] == STANDS, names], pdf[pdf["kind"] == SENT]
    contexts, numbers, earliest = _joined(sent)
    context, begin, end = repeated_parts(contexts, earliest, least)
    order = np.lexsort((begin, context))
    context, begin, end = context[order], begin[order], end[order]
    edge = np.searchsorted(context, np.arange(len(contexts) + 1))
    rows = []
    for chunk, number, own, docs in zip(sent["chunk"], numbers, sent["a"], sent["b"]):
        own, whole = np.frombuffer(own, np.uint32), earliest[number] < np.frombuffer(docs, np.int64)
        at, which = expand(edge[number[~whole]], np.diff(edge)[number[~whole]])
        if whole.any() or len(at):
            rows.append((chunk, SENT, own[whole].tobytes(), own[~whole][which].tobytes(), begin[at].astype(np.uint32).tobytes(), end[at].astype(np.uint32).tobytes(), b"", b""))
    return pd.concat([pd.DataFrame(rows, columns=names).astype({"chunk": "int64", "kind": "int32"}), passed])


def _by_document(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """A chunk's repeated bytes, by document."""
    told, stands = pdf[pdf["kind"] == SENT], pdf[pdf["kind"] == STANDS].iloc[0]
    context, start, doc, lengths = (np.frombuffer(stands[c], np.uint32).astype(np.int64) for c in "abce")
    documents = np.frombuffer(stands["d"], DOCUMENT)
    ids = documents["doc_id"][doc]
    least = np.full(len(lengths), np.iinfo(np.int64).max)
    np.minimum.at(least, context, ids)
    least[np.frombuffer(b"".join(told["a"]), np.uint32)] = np.iinfo(np.int64).min
    part, begin, end = (np.frombuffer(b"".join(told[c]), np.uint32).astype(np.int64) for c in "bcd")
    order = np.argsort(part, kind="stable")
    part, begin, end = part[order], begin[order], end[order]
    edge = np.searchsorted(part, np.arange(len(lengths) + 1))
    whole = ids > least[context]
    rest = np.flatnonzero(~whole)
    at, which = expand(edge[context[rest]], np.diff(edge)[context[rest]])
    own = start[rest[which]]
    cut = np.frombuffer(stands["f"], np.uint32).astype(np.int64).reshape(3, -1)
    doc = np.concatenate([doc[whole], doc[rest[which]], cut[0]])
    begin = np.concatenate([start[whole], own + begin[at], cut[1]])
    end = np.concatenate([(start + lengths[context])[whole], own + end[at], cut[2]])
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    # Neighbours that overlap are one interval; a document's intervals are in order, and one may reach beyond the next.
    reach = np.maximum.accumulate(end + doc * (1 << 33)) - doc * (1 << 33)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (begin[1:] > reach[:-1])
    first = np.flatnonzero(new)
    doc, begin, end = doc[first], begin[first], np.maximum.reduceat(end, first) if len(first) else end
    rows = [(int(documents["doc_id"][d]), int(documents["text_id"][d]), begin[a:b].astype(np.uint32).tobytes(), end[a:b].astype(np.uint32).tobytes()) for d, a, b in by_shard(doc)]
    return pd.DataFrame(rows, columns=["doc_id", "text_id", "starts", "ends"]).astype({"doc_id": "int64", "text_id": "int64"})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for at in range(0, batch.num_rows, 128):
            rows = []
            for i in range(at, min(at + 128, batch.num_rows)):
                text, removed = texts[i].as_py() or b"", []
                kept, tid = text, None
                for f in batch.column("found")[i].as_py() or []:
                    tid = text_id(text) if tid is None else tid
                    if f["text_id"] == tid:
                        ends = np.frombuffer(f["ends"], np.uint32).astype(np.int64)
                        mask = covered(np.frombuffer(f["starts"], np.uint32).astype(np.int64), ends, len(text))
                        kept = np.frombuffer(text, np.uint8)[~mask].tobytes()
                        removed = [{"start": a, "stop": b} for a, b in zip(*map(np.ndarray.tolist, spans(mask)))]
                        break
                rows.append((batch.column("doc_id")[i].as_py(), len(text), removed, kept))
            types = (pa.int64(), pa.int64(), pa.list_(span), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, types)], ["doc_id", "n_bytes", "removed", "kept"])


def remove_repeated_bytes(docs: DataFrame, least: int = 50, gram: int = 16, shard_bytes: int = 2_000_000, chunk_bytes: int = 8_000_000) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, n_bytes, ``removed`` (spans of byte numbers, half open)
    and ``kept`` (the other bytes)."""
    spec = Windows("bytes", least, gram)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    shards = count_shards(texts, shard_bytes)
    keys = repeated_runs(texts, spec, shards, chunk_bytes)
    contexts = texts.join(keys, "doc_id").mapInArrow(lambda b: _contexts(b, spec, shards, chunk_bytes), MESSAGE)
    answers = contexts.groupBy("shard").applyInPandas(lambda key, pdf: _repeated(key, pdf, least), ANSWER)
    hits = answers.groupBy("chunk").applyInPandas(_by_document, "doc_id long, text_id long, starts binary, ends binary")
    hits = table(hits.groupBy("doc_id").agg(F.collect_list(F.struct("text_id", "starts", "ends")).alias("found")), "repeats")
    return texts.join(hits, "doc_id", "left").mapInArrow(_cut, "doc_id long, n_bytes long, removed array<struct<start:long,stop:long>>, kept binary")


PIECE = "piece long, length long, doc_id long, text_id long, start long, opens boolean, ends boolean"


def _pieces(key: tuple, pdf: pd.DataFrame, least: int) -> pd.DataFrame:
    """A shard's maximal groups, told to chunks: for each message, members as (piece, length, context number, place in it)."""
    names = [x.split()[0] for x in ANSWER.split(", ")]
    passed, sent = pdf.loc[pdf["kind"] == STANDS, names], pdf[pdf["kind"] == SENT]
    contexts, numbers, _ = _joined(sent)
    lengths = np.array([len(c) for c in contexts], np.int64)
    array = SuffixArray(contexts, least)
    tree = interval_tree(array.common, array.before, np.zeros(len(array.text), np.int64), least)
    groups = np.flatnonzero(tree.diverse)
    member, group = expand(tree.first[groups], (tree.last - tree.first + 1)[groups])
    context, size = array.text[member], tree.length[groups][group]
    place = array.place[member] - array.start[context]
    # A whole context is a group of its own, unless an interval is as long; chunks drop it where it stands once in the corpus.
    whole = np.flatnonzero(array.place == array.start[array.text])
    inner = np.where(tree.of[whole] >= 0, np.append(tree.length, 0)[tree.of[whole]], 0)
    whole = array.text[whole[inner < lengths[array.text[whole]]]]
    group = np.concatenate([group, len(groups) + np.arange(len(whole))]) + (np.int64(key[0]) << 32)
    context, place, size = np.concatenate([context, whole]), np.concatenate([place, np.zeros(len(whole), np.int64)]), np.concatenate([size, lengths[whole]])
    order = np.argsort(context, kind="stable")
    context, place, size, group = context[order], place[order], size[order], group[order]
    edge = np.searchsorted(context, np.arange(len(contexts) + 1))
    rows = []
    for chunk, number, own in zip(sent["chunk"], numbers, sent["a"]):
        at, which = expand(edge[number], np.diff(edge)[number])
        rows.append((chunk, SENT, group[at].tobytes(), np.frombuffer(own, np.uint32)[which].tobytes(), place[at].astype(np.uint32).tobytes(), size[at].astype(np.uint32).tobytes(), b"", b""))
    return pd.concat([pd.DataFrame(rows, columns=names).astype({"chunk": "int64", "kind": "int32"}), passed])


def _occurrences(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Where the pieces stand in a chunk's documents, and whether they begin and end with their contexts."""
    told, stands = pdf[pdf["kind"] == SENT], pdf[pdf["kind"] == STANDS].iloc[0]
    context, start, doc, lengths = (np.frombuffer(stands[c], np.uint32).astype(np.int64) for c in "abce")
    documents = np.frombuffer(stands["d"], DOCUMENT)[doc]
    piece = np.frombuffer(b"".join(told["a"]), np.int64)
    number, place, size = (np.frombuffer(b"".join(told[c]), np.uint32).astype(np.int64) for c in "bcd")
    order = np.argsort(context, kind="stable")
    edge = np.searchsorted(context[order], np.arange(len(lengths) + 1))
    at, which = expand(edge[number], np.diff(edge)[number])
    o = order[at]
    return pd.DataFrame({
        "piece": piece[which], "length": size[which], "doc_id": documents["doc_id"][o], "text_id": documents["text_id"][o], "start": start[o] + place[which],
        "opens": place[which] == 0, "ends": (place + size == lengths[number])[which],
    })


def repeat_groups(docs: DataFrame, least: int = 50, gram: int = 16, shard_bytes: int = 2_000_000, chunk_bytes: int = 8_000_000) -> DataFrame:
    """A row per occurrence of a repeat group of ``docs`` (doc_id, text), ``least`` bytes or more, in several documents or in one:
    (group, length, doc_id, text_id, start). Every group has all occurrences of its string. A row per repeated row; rows without doc_id have none.

    Groups are maximal, but for one case: where the occurrences of a repeat are, for a whole context (a run of windows under one key), a part
    only of those of the text there, as that text also repeats elsewhere, the repeat comes as its pieces on either side. Pieces that
    have the same occurrences, moved by one distance, are joined over any number of contexts. A periodic text has as many groups
    as periods, each with its occurrences, so the output grows with the square of these.
    """
    spec = Windows("bytes", least, gram)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    shards = count_shards(texts, shard_bytes)
    keys = repeated_runs(texts, spec, shards, chunk_bytes, within=True)
    contexts = texts.join(keys, "doc_id").mapInArrow(lambda b: _contexts(b, spec, shards, chunk_bytes), MESSAGE)
    answers = contexts.groupBy("shard").applyInPandas(lambda key, pdf: _pieces(key, pdf, least), ANSWER)
    found = table(answers.groupBy("chunk").applyInPandas(_occurrences, PIECE), "pieces")

    # A set of places is named by its size, its least place and the sum of its places' hashes.
    meeting = F.col("start") + F.col("length") - (least - 1)  # where the next context begins, if this one ends here
    name = lambda at: F.concat_ws(
        " ", F.count("*"), F.to_json(F.min(F.struct("doc_id", "text_id", at.alias("at")))), F.sum(F.xxhash64("doc_id", "text_id", at).cast("decimal(20,0)")))
    pieces = found.groupBy("piece").agg(
        F.first("length").alias("length"), F.count("*").alias("n"), F.min("opens").alias("opens"), F.min("ends").alias("ends"),
        name(F.col("start")).alias("from"), name(meeting).alias("to")).filter("n > 1")
    pieces = table(pieces, "piece-sets")
    before = pieces.filter("ends").select(F.col("piece").alias("head"), (F.col("length") - (least - 1)).alias("shift"), F.col("to").alias("meet"))
    after = pieces.filter("opens").select("piece", F.col("from").alias("meet"))
    up = table(after.join(before, "meet").filter("piece <> head").select("piece", "head", "shift"), "piece-links")
    while True:  # pointer doubling to the first piece of each chain
        above = up.select(F.col("piece").alias("head"), F.col("head").alias("next"), F.col("shift").alias("more"))
        stepped = up.join(above, "head", "left")
        if stepped.filter("next is not null").isEmpty():
            break
        up = table(stepped.select("piece", F.coalesce("next", "head").alias("head"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")), "piece-heads")
    chained = pieces.join(up, "piece", "left")
    whole = chained.groupBy(F.coalesce("head", "piece").alias("piece")).agg(F.max(F.coalesce("shift", F.lit(0)) + F.col("length")).alias("whole"))
    return found.join(whole, "piece").select(F.col("piece").alias("group"), F.col("whole").alias("length"), "doc_id", "text_id", "start")
