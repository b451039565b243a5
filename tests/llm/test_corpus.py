"""Corpus operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and odd columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lapwing.llm import ann, chat, licenses, line_dedup, mixing, ngram_join, packing, quality, substring_dedup, suffix_dedup
from lapwing.llm.components import components
from tests.conftest import same_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, run long, n int"


def corpus(seed: int = 7) -> list[tuple]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() + rng.choice(["", "", ",", ".\n"]) for _ in range(n))
    shared = text(70)
    out = [text(rng.randint(5, 200)) for _ in range(30)]
    out += [f"{text(20)} {shared} {text(rng.randint(1, 30))}" for _ in range(8)]
    base = out[3] + " " + text(200)
    for _ in range(6):
        w = base.split(" ")
        w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    out += [base, base, "", None, "a", "ab ab ab ab ab ab ab ab ab ab ab ab " * 30, text(4000)]
    rows = [(i, t, "en", ["s1", "s2", None][i % 3], None if t is None else len(t), "k", 1, 2) for i, t in enumerate(out)]
    return rows + [rows[4], (None, out[5], None, "s1", 1, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def known() -> dict[int, str]:
    return {r[0]: r[1] for r in corpus() if r[0] is not None}


def words(t: str | None) -> list[bytes]:
    return (t or "").encode().split()


def first_seen(units: dict[int, list], width: int) -> dict:
    seen: dict = {}
    for i in sorted(units):
        for k in range(len(units[i]) - width + 1):
            seen.setdefault(tuple(units[i][k : k + width]), i)
    return seen


def removed(unit: list, i: int, seen: dict, width: int) -> list[bool]:
    out = [False] * len(unit)
    for k in range(len(unit) - width + 1):
        if seen[tuple(unit[k : k + width])] < i:
            out[k : k + width] = [True] * width
    return out


def test_quality(docs):
    got = {r.doc_id: r for r in quality.quality_report(docs).collect()}
    for i, t in known().items():
        w = words(t)
        wins = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        marked = [False] * len(w)
        for k in range(len(w) - 4):
            if wins[tuple(w[k : k + 5])] > 1:
                marked[k : k + 5] = [True] * 5
        lines, dup, seen = (t or "").split("\n"), 0, set()
        for line in lines:
            dup += bool(line.encode().split()) and line in seen
            seen.add(line)
        want = (len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"), dup, sum(marked))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 10 or 100 * sum(marked) > 20 * len(w)) and not (r.base_failed and r.kept)
    junk = "Home | Login | Next\n" + "\n".join("A| B% C& D$ E# x* y| z|" for _ in range(5)) + "\nAll rights reserved."
    assert not quality.judge(junk.encode(), quality.LineRules())[0][6]
    kept = quality.clean_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in quality.quality_report(docs).collect())


def test_line_dedup(docs, spark):
    def distance(a: str, b: str) -> int:
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    rng, base = random.Random(5), []
    for _ in range(25):
        base.append("".join(rng.choice("abcde fg") for _ in range(rng.randint(19, 30))))
    rows = []
    for i in range(25):
        lines = []
        for _ in range(4):
            s = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                j = rng.randrange(len(s))
                s[j : j + rng.randint(0, 1)] = [rng.choice(["", "é", "a", "bc"])]
            lines.append("".join(s))
        rows.append((i, "\n".join(lines)))
    got = {(r.doc_id, r.line_no): r for r in line_dedup.line_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    where: dict[str, tuple] = {}
    every = [(i, k, x.strip()) for i, t in rows for k, x in enumerate(t.split("\n")) if len(x.strip()) >= 20]
    for i, k, x in every:
        where.setdefault(x, (i, k))
    assert set(got) == {(i, k) for i, k, _ in every}
    for i, k, x in every:
        near = [where[y] for y in where if y != x and abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2]
        r = got[(i, k)]
        assert (r.first_doc_id, r.first_line_no, r.n_links) == (*where[x], len(near))
        assert r.kept == (where[x] == (i, k) and (not near or min(near) > where[x]))
    out = line_dedup.without_repeated_lines(docs)
    assert out.columns == docs.columns and 0 < out.count() <= docs.count()


def test_line_dedup_short(spark):
    def distance(a: str, b: str) -> int:
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    rng, rows = random.Random(11), []
    base = ["".join(rng.choice("abcde é") for _ in range(n)) for n in [*range(1, 26), 9, 10, 10, 18, 19, 19, 20, 20, 21]]
    for i in range(60):
        lines = ["Home", "", "  "]
        for _ in range(8):
            s = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                j = rng.randrange(len(s) + 1)
                s[j : j + rng.randint(0, 1)] = [rng.choice(["", "x", "a"])]
            lines.append("".join(s))
        rows.append((i, "\n".join(lines)))
    every = [(i, k, x.strip()) for i, t in rows for k, x in enumerate(t.split("\n")) if x.strip()]
    where: dict[str, tuple] = {}
    for i, k, x in every:
        where.setdefault(x, (i, k))
    got = {(r.doc_id, r.line_no): r for r in line_dedup.line_links(spark.createDataFrame(rows, "doc_id long, text string"), least_chars=1).collect()}
    assert set(got) == {(i, k) for i, k, _ in every}
    mixed = set()
    for i, k, x in every:
        linked = [y for y in where if y != x and distance(x, y) <= min(2, max(len(x), len(y)) // 10)]
        mixed |= {(min(len(x), len(y)), max(len(x), len(y))) for y in linked}
        near, r = [where[y] for y in linked], got[(i, k)]
        assert (r.first_doc_id, r.first_line_no, r.n_links) == (*where[x], len(near))
        assert r.kept == (where[x] == (i, k) and (not near or min(near) > where[x]))
    assert {(19, 20), (18, 20), (9, 10), (19, 19)} <= mixed


def test_line_dedup_template_lines(spark):
    """One signature in all lines, dealt to blocks; rows repeated, without id, with clashing columns; very long lines."""
    rows = [(i, f"Page {i:04d} of the catalogue") for i in range(60)] + [(None, "Page 0003 of the catalogue"), (5, "Page 0005 of the catalogue")]
    long = "so it goes on " * 1200
    rows += [(100, long + "x"), (101, long + "yz"), (102, None), (103, "\n \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"line": F.lit("k"), "id": F.lit(1), "a": F.lit(2)})
    want = {f"{i:04d}": sum(0 < sum(p != q for p, q in zip(f"{i:04d}", f"{j:04d}")) <= 2 for j in range(60)) for i in range(60)}
    for block_rows in (7, 4096):
        got = line_dedup.line_links(df, block_rows=block_rows).collect()
        assert len(got) == 64
        pages = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id < 100}
        assert {f"{i:04d}": pages[i].n_links for i in range(60)} == want
        assert sorted(r.copies for r in got if r.doc_id == 5) == [2, 2] and [r.first_doc_id for r in got if r.doc_id is None] == [3]
        assert [(r.n_links, r.kept) for r in sorted(got, key=lambda r: r.doc_id or 0) if r.doc_id in (100, 101)] == [(1, True), (1, False)]
        assert [i for i in range(60) if pages[i].kept] == [0]


def test_fragments_go_with_their_lines(spark):
    rows = [(1, "a first line of text\na second line of text\na third line of text\nand a fourth line"), (2, "a first line of text\na second line of text\na third line of text\nrest"), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.without_repeated_lines(df, 1).collect()} == {1: rows[0][1], 2: "rest", 3: ""}
    assert {r.doc_id for r in line_dedup.without_repeated_lines(df, 1, 0.2).collect()} == {1, 3}


def test_lines_dropped_by_the_queries(spark, tmp_path):
    import corpus_pipeline
    from lapwing.llm import queries

    spark.createDataFrame([(1, "Home\nsome words"), (2, "Home\nothers here"), (3, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.line_no): r.kept for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {(1, 0): True, (1, 1): True, (2, 0): False, (2, 1): True, (3, 0): True}
    out = corpus_pipeline.lines(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), "")
    assert {r.doc_id: r.text for r in out.collect()} == {1: "Home\nsome words", 2: "others here", 3: "x"}


def test_lines_cut_from_their_own_row(spark):
    rows = [
        (1, "a line that others repeat\nanother line that is repeated"), (None, "a line that others repeat\nunique text of the first row"),
        (None, "unique text of some second row\nanother line that is repeated"), (None, "here all is said but once\nand nothing of it again"), (None, None),
        (7, "a line that others repeat\nwords of seven, first text"), (7, "seven has one more text too\nanother line that is repeated"),
    ]
    out = line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted([
        rows[0], (None, "unique text of the first row"), (None, "unique text of some second row"), rows[3], rows[4],
        (7, "words of seven, first text"), (7, "seven has one more text too"),
    ], key=str)


def test_neighbours(spark):
    x = np.random.default_rng(3).normal(size=(400, 16))
    x[50:120] = x[50]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [1.0, None] + [0.0] * 14), (404, [1.0]), rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("query_id", F.lit(1))
    got = ann.search(df, df.filter("vec_id % 10 = 0"), k=5)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert abs(r.score - u[r.query_id] @ u[r.vec_id]) < 1e-12 and r.query_id != r.vec_id
    hits = 0
    for q in range(0, 400, 10):
        s = u @ u[q]
        s[q] = -9
        best = sorted(range(400), key=lambda i: (-round(s[i], 12), i))[:5]
        assert [r for r, *_ in sorted(found[q])] == [1, 2, 3, 4, 5]
        hits += len(set(best) & {v for _, v, _ in found[q]})
    assert hits >= 0.9 * 200
    assert [v for _, v, _ in sorted(found[60])] == [50, 51, 52, 53, 54]
    assert ann.search(df.limit(0), df, k=5).count() == 0
    few = ann.search(df.filter("vec_id < 3"), df.filter("vec_id = 0"), k=5)
    assert sorted(r.vec_id for r in few.collect()) == [1, 2]


def test_neighbours_ties_and_ids(spark):
    rng = np.random.default_rng(9)
    one = rng.normal(size=16)
    ties = [(i, [float(v) for v in one * 2.0 ** (i % 30)]) for i in range(60)]
    far = [(i, [float(v) for v in rng.normal(size=16)]) for i in range(100, 130)]
    near = [(200, [float(v) for v in one * (1 + 1e-6 * j) + 1e-3 * rng.normal(size=16)]) for j in range(12)]
    df = spark.createDataFrame(ties + far + near, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, df.filter("vec_id in (59, 200)"), k=5).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    assert [got[59][k] for k in range(1, 6)] == [0, 1, 2, 3, 4]
    assert sorted(got[200].values()) == [0, 1, 2, 3, 4]
    df = spark.createDataFrame(far + near, "vec_id long, embedding array<double>")
    got = [r.vec_id for r in ann.search(df, df.filter("vec_id = 100"), k=8).orderBy("rank").collect()]
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in far}
    score = {i: unit[100] @ u for i, u in unit.items() if i != 100} | {200: max(unit[100] @ (np.array(v) / np.linalg.norm(v)) for _, v in near)}
    assert got == sorted(score, key=lambda i: (-score[i], i))[:8]
    sample = rng.normal(size=(300, 32))
    assert ann.fit_probes(sample / np.linalg.norm(sample, axis=1)[:, None], sample[:9], ann.Hashes(32, functions=12, width=0.05), 5, 1.0, 16) is None


def test_suffix_dedup(docs):
    units = {i: list((t or "").encode()) for i, t in known().items()}
    seen = first_seen(units, 50)
    for r in suffix_dedup.remove_repeated_bytes(docs).collect():
        gone = removed(units[r.doc_id], r.doc_id, seen, 50) if r.doc_id is not None else [False] * r.n_bytes
        text = bytes(units[r.doc_id]) if r.doc_id is not None else corpus()[5][1].encode()
        assert bytes(r.kept) == bytes(b for b, g in zip(text, gone) if not g)
        assert sum(s.stop - s.start for s in r.removed) == sum(gone)


def test_suffix_dedup_odd(spark):
    """Two texts under one doc_id, white space without end, NUL bytes, a periodic text, a row without doc_id; columns that clash."""
    base = "the quick brown fox jumps over the lazy dog and runs on into the deep dark wood behind the old stone mill. "
    rows = [
        (1, base * 3), (1, "other text of one " + base), (2, "x" + base + "y"), (3, " " * 200_000), (4, " " * 90_000 + "end"), (5, "ab" * 300), (6, "zz" + "ab" * 200),
        (7, "a\0b" * 40), (8, "c" + "a\0b" * 30 + "\0"), (None, base), (9, ""), (10, None), (2, "x" + base + "y"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("chunk", "keys", "found", "shard")}).repartition(2)
    seen: dict[bytes, int] = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            seen.setdefault(b[k : k + 50], i)
    want = []
    for i, t in rows:
        b, gone = (t or "").encode(), set()
        if i is not None:
            for k in range(len(b) - 49):
                if seen[b[k : k + 50]] < i:
                    gone.update(range(k, k + 50))
        want.append((i, len(b), bytes(x for k, x in enumerate(b) if k not in gone)))
    got = [(r.doc_id, r.n_bytes, bytes(r.kept)) for r in suffix_dedup.remove_repeated_bytes(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def maximal_repeats(texts: list[tuple[int, bytes]], least: int) -> dict[bytes, set]:
    """Strings that repeat and can't be extended without losing an occurrence, by brute force over pairs of places."""
    ends = {}
    for i, t in texts:
        for k in range(len(t) - least + 1):
            ends.setdefault(t[k : k + least], []).append((i, t, k))
    found = set()
    for places in ends.values():
        for a, (i, t, p) in enumerate(places):
            for j, u, q in places[a + 1 :]:
                n = least
                while p + n < len(t) and q + n < len(u) and t[p + n] == u[q + n]:
                    n += 1
                if not (p and q and t[p - 1] == u[q - 1]):
                    found.add(t[p : p + n])
    every = {s: {(i, k) for i, t in texts for k in range(len(t) - len(s) + 1) if t[k : k + len(s)] == s} for s in found}
    return {s: at for s, at in every.items() if len({t[k - 1] if k else -i - 1 for i, k in at for j, t in texts if j == i}) > 1
            and len({t[k + len(s)] if k + len(s) < len(t) else -i - 1 for i, k in at for j, t in texts if j == i}) > 1}


def test_repeat_groups(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(110)[:500], text(40)
    rows = [(i, f"{text(8)} {i} {passage} {i} {text(9)}") for i in range(40)]
    rows += [(100, f"{other} - {text(5)}"), (101, f"{text(3)} + {other}"), (102, f"{text(30)} {other[:120]}. {text(4)} {other[:120]}! {other[40:]}"), (103, "unique " + text(60)), (104, None)]
    got: dict = {}
    for r in suffix_dedup.repeat_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shard_bytes=2000, chunk_bytes=5000).collect():
        got.setdefault((r.group, r.length), []).append((r.doc_id, r.start))
    texts = [(i, (t or "").encode()) for i, t in rows]
    by = dict(texts)
    strings = {}
    for (_, n), at in got.items():
        assert len({by[i][k : k + n] for i, k in at}) == 1 and len(at) == len(set(at)) and len(at) > 1
        s = by[at[0][0]][at[0][1] : at[0][1] + n]
        assert s not in strings
        strings[s] = set(at)
    want = maximal_repeats(texts, 50)
    for s, at in strings.items():  # every occurrence
        assert at == {(i, k) for i, t in texts for k in range(len(t) - len(s) + 1) if t[k : k + len(s)] == s}
    passages = [s for s in strings if len(strings[s]) == 40]
    assert len(passages) == 1 and len(passages[0]) >= 502 and passages[0] in want
    covered = lambda groups: {(i, k + d) for s, at in groups.items() for i, k in at for d in range(len(s))}
    assert covered(strings) == covered(want)
    # What its parts have in common with no other text is whole.
    times = Counter(t[k : k + 50] for _, t in texts for k in range(len(t) - 49))
    alone = [s for s, at in want.items() if all(times[s[k : k + 50]] == len(at) for k in range(len(s) - 49))]
    assert len(alone) >= 2 and set(alone) <= set(strings)


def test_substring_dedup(docs):
    units = {i: words(t) for i, t in known().items()}
    seen = first_seen(units, 50)
    rows = substring_dedup.remove_repeated_words(docs).collect()
    assert len(rows) == len(corpus())
    for r in rows:
        if r.doc_id is not None:
            gone = removed(units[r.doc_id], r.doc_id, seen, 50)
            assert r.kept.encode() == b" ".join(w for w, g in zip(units[r.doc_id], gone) if not g)
            assert sum(s.stop - s.start for s in r.removed) == sum(gone)
    keys = np.random.default_rng(1).integers(0, 2**32, 500, dtype=np.uint32)
    sketch = substring_dedup.CountMin(256)
    sketch.merge(keys, 1)
    assert (sketch.estimate(keys) >= 1).all()


def test_packing(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    exact = packing._encoders(path)[0]
    rows = packing.pack(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), path).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, t in known().items():
        ids = [*exact.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == s[0].context <= 2048 and at & (at - 1) == 0
    special = "x <|endoftext|> y"
    assert packing.encode(special, path, 1).tolist() == [*exact.encode(special, add_special_tokens=False).ids, 1]


def test_packing_odd(spark):
    """White space without end, very long words, repeated and null rows, columns that clash, an empty table."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    exact = packing._encoders(path)[0]
    assert packing._encoders(path)[1] is not None
    rows = [(1, " " * 1_000_000 + "x"), (2, "\n\t " * 300_000), (3, "a" * 60_000), (None, "no id"), (None, None), (4, "twice"), (4, "twice"), (5, "long text " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit("s"), "offset": F.lit(0)})
    got = packing.pack(df, path).collect()
    want = Counter()
    for i, t in rows:
        ids = [*exact.encode(t or "", add_special_tokens=False).ids, 1]
        want[i] += len(ids)
        if i not in (None, 4):
            at = 0
            for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start):
                assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()))
                at += r.length
    sums = Counter()
    for r in got:
        sums[r.doc_id] += r.length
    assert sums == want
    assert packing.pack(df.limit(0), path).count() == 0


def test_packing_tiers_and_steps():
    rng = np.random.default_rng(5)
    packer = packing.Packer(0)
    for i in range(600):
        packer.add(i, np.arange(rng.integers(1, 901), dtype="<u4"))
    packer.flush(last=True)
    steps, windows = Counter(), {}
    for *_, sequence, _, context, step in packer.rows:
        windows[sequence] = (context, step)
    for context, step in windows.values():
        steps[step] += context
    made = Counter(c for c, _ in windows.values())
    assert all(made[t] >= 40 for t in (1024, 512, 256)), made
    assert max(steps.values()) - min(steps.values()) <= 256 and len(steps) > 10
    assert len({s for c, s in windows.values() if c == 1024}) == len(steps)


def test_licenses(spark):
    text = "Some words. Licensed under the Apache License, Version 2.0. More words of the license. "
    filler = "the of and to license version under work " * 400
    rows = [(1, text), (2, filler), (3, None), (4, ""), (5, filler + "released under the MIT license " * 3), (6, "All rights\nreserved"), (7, "nothing to see")]
    got = {(r.doc_id, r.license): r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[(1, "apache-2.0")].coverage == 1 and got[(1, "apache-2.0")].first_word == 2
    assert got[(5, "mit")].hits >= 1 and (6, "all-rights-reserved") in got
    assert {i for i, _ in got} == {1, 5, 6}
    assert licenses.longest_increasing([3, 1, 2, 9, 4]) == [1, 2, 4]


@pytest.mark.parametrize("text, names", [
    ("Licensed under CC BY 4.0", {"cc-by-4.0"}), ("CC-BY-SA 4.0", {"cc-by-sa-4.0"}), ("Attribution-NonCommercial 4.0", {"cc-by-nc-4.0"}),
    ("Released under the BSD License", {"bsd"}), ("GNU General Public License, version 2", {"gpl-2.0"}), ("Mozilla License, Version 2.0", {"mpl-2.0"}),
    ("CC BY-NC-SA 4.0", {"cc-by-nc-sa-4.0"}), ("GNU Lesser General Public License, version 3", {"lgpl-3.0"}), ("under the MIT License", {"mit"}),
    ("CC BY 3.0", set()), (licenses.TEMPLATES["mit-text"], {"mit-grant", "mit-text"}), ("Licensed under the Apache License, Version 1.1", set()),
])
def test_licenses_told_apart(text, names):
    ready = [licenses.Template(n, tuple(w := licenses.normal_words(t)), Counter(w)) for n, t in licenses.TEMPLATES.items()]
    filler = "some words of an ordinary text that says nothing at all about it "
    for around in (text, filler * 40 + text + " " + filler * 40):
        words = licenses.normal_words(around)
        assert {t.name.partition(":")[0] for t in ready if t.enough(set(words), 0.8) and t.scan(words, 0.8)} == names


def test_alignment_against_brute_force():
    """Matches are equal words, increasing on both sides, never more than the longest common subsequence, and all of it where anchors are unique."""
    def longest(a: list, b: list) -> int:
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    rng = random.Random(4)
    for _ in range(200):
        a = [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 14))]
        b = [x for x in a if rng.random() < 0.8] + [rng.choice("qrst") for _ in range(rng.randint(0, 6))]
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= longest(a, b)
        if len(set(a)) == len(a):
            assert len(pairs) == longest(a, b)


def test_quality_verdict(spark):
    """``kept`` against the rules said again, on every document of a table, and repeated words of a long text."""
    import re

    rules = quality.LineRules()
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    boiler = [p for some in quality.BOILERPLATE.values() for p in some]
    navigation = "|".join(re.escape(p) for some in quality.NAVIGATION.values() for p in some)

    def bad(line: str) -> bool:
        n = len(words(line))
        if n >= rules.flat_words and not any(c in line for c in ".!?…:;。！？"):
            return True
        symbols = sum(len(m) > 0 for m in re.findall(r"[#*$%&|<>{}\[\]\\~^=_@+]+", line))
        separators = len(re.findall(r"(?:^|(?<=\s))[|»›>·•](?=\s|$)", line))
        if (symbols >= 3 and symbols > rules.symbol_share * n) or len(re.findall(r"[!?]{2,}(?=\s|$)", line)) > rules.shout_share * n:
            return True
        if separators >= max(2, rules.separator_share * n) or any(p in line.lower() for p in boiler):
            return True
        return n <= 12 and re.fullmatch(rf"[\s|>/·•»›-]*(?:(?:{navigation})[\s|>/·•»›.-]*)+", line.lower().strip()) is not None

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(1000)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    kept = 0
    for r in quality.quality_report(docs).collect():
        left = sum(len(words(x)) for x in texts[r.doc_id].split("\n") if words(x) and not bad(x))
        assert r.kept == (not r.base_failed and left >= rules.least_words and left >= rules.kept_share * r.n_words), r.doc_id
        kept += r.kept
    assert 0 < kept < len(texts)
    for line in ("Startseite | Kontakt", "Alle Rechte vorbehalten.", "Accueil » Recherche", "Todos los derechos reservados"):
        assert rules.line_fails(line, len(line.split()))
    rng = random.Random(8)
    for n in (0, 4, 5, 6, 60, 3000):
        w = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(n)]
        times = Counter(tuple(w[k : k + 5]) for k in range(n - 4))
        mark = {k + d for k in range(n - 4) if times[tuple(w[k : k + 5])] > 1 for d in range(5)}
        assert quality.repeated_words(w) == len(mark)


def test_chat(spark):
    rows = [
        (1, 0, "u", "Hello there world.\nHow are you?"), (1, 1, "a", "> Hello there world.\n> How are you?\nFine!"),
        (1, 2, "u", "On Monday X wrote:\n>> How are  YOU?\n> Fine!\nGreat"), (1, 3, "u", "new"), (1, 4, "a", "> new\nok"), (1, 5, "a", "> unknown\nhm"),
        (2, 0, "u", None), (None, 1, "u", "> x"), (3, 0, "u", "> later\nfirst"), (3, 1, "u", "later"), (1, 3, "u", "new"),
    ]
    got = [tuple(r)[:9] for r in chat.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("body", F.lit(1))).collect()]
    by = {(r[0], r[2]): r for r in got}
    assert by[(1, 1)][4:7] == ("Fine!", 0, 1) and by[(1, 2)][4:7] == ("Great", 1, 2) and by[(1, 2)][1] == 0
    assert by[(1, 4)][5] == 3 and by[(1, 5)][5] is None and by[(1, 5)][4] == "hm" and by[(3, 0)][5] is None
    assert len(got) == len(rows)


def test_chat_planted(spark):
    """Random conversations whose replies quote an earlier message whole, cut, wrapped anew or with nested quotations: every link is found
    and none is made up; short lines that many messages share link nothing."""
    import textwrap

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    rows, want = [], {}
    for conv in range(12):
        bodies: list[str] = []
        for turn in range(12):
            own = "\n".join([" ".join(word() for _ in range(rng.randint(6, 12))) for _ in range(rng.randint(2, 5))] + ["Thanks!"])
            if turn and rng.random() < 0.75:
                to = rng.randrange(turn)
                want[conv, turn] = to
                text = bodies[to]
                kind = rng.randrange(4)
                if kind == 1:  # wrapped anew
                    text = "\n".join(textwrap.wrap(" ".join(text.split("\n")[:-1]), 31))
                elif kind == 2:  # one line of several words, in capitals
                    text = rng.choice(text.split("\n")[:-1]).upper()
                quote = "\n".join("> " + x for x in text.split("\n"))
                if kind == 3 and want.get((conv, to)) is not None:  # with what the quoted message itself quotes
                    quote = "\n".join(">> " + x for x in bodies[want[conv, to]].split("\n")) + "\n" + quote
                message = f"On Friday somebody wrote:\n{quote}\n{own}"
            else:
                message = own if rng.random() < 0.5 else f"> Thanks!\n{own}"
            bodies.append(own)
            rows.append((conv, turn, "u", message))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"thread": F.lit("x"), "key": F.lit(1)})
    got = chat.link_quotations(df.repartition(3)).collect()
    assert len(got) == len(rows)
    assert {(r.conv_id, r.turn): r.reply_to for r in got if r.reply_to is not None} == want
    for r in got:
        top, depth = r.turn, 0
        while (r.conv_id, top) in want:
            top, depth = want[r.conv_id, top], depth + 1
        assert (r.thread, r.depth) == (top, depth) and ">" not in r.body and "wrote:" not in r.body
    assert chat.link_quotations(df.limit(0)).count() == 0


def test_ngram_join(docs):
    sets = {}
    for i, t in known().items():
        w = words(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    degree = Counter()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                if sets[a] != sets[b]:
                    degree[a] += 1
                    degree[b] += 1
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: r for r in ngram_join.near_duplicates(docs, block_members=3).collect()}
    assert {i: got[i].class_id for i in sets} == {i: root(i) for i in sets}
    classes = {i: min(j for j in sets if sets[j] == sets[i]) if sets[i] else i for i in sets}
    for i in sets:
        links = {classes[j] for j in sets if sets[i] and sets[j] and sets[j] != sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
        assert got[i].n_links == len(links) and got[i].rep_id == classes[i]
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({root(i) for i in sets})


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 40), (40, 60), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 1 for i in range(1, 31)} | {40: 40, 50: 40, 60: 40}


def test_mixing(docs, duck):
    import duckdb

    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    con.register("documents", documents)
    unique = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    con.register("documents", unique.toPandas())
    got = mixing.mix(unique, rows_per_bucket=4).toPandas()
    same_rows(got, con.sql(mixing.MIX_SQL).df())
    totals = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert (abs(totals.taken - totals.target) <= totals.most + 1e-6).all() and (got.taken <= 3 * got["size"]).all()
    assert mixing.mix(docs.limit(0)).count() == 0
    out = mixing.mixed_documents(unique)
    assert out.columns == docs.columns and out.count() == got.copies.sum()


def test_mixing_shared_ids(docs, spark):
    """Rows that share a doc_id, equal or not, rows without id or source, columns that clash: the mix keeps to its budget, row by row."""
    rows = [(i % 7 if i % 5 else None, f"{'w ' * (i % 9 + 1)}{i % 11}", ["a", "b", None][i % 3], i) for i in range(90)] + [(3, "x y z", "a", 1)] * 4 + [(8, None, "a", 2), (9, "", "b", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, finish long").repartition(3)
    report = mixing.mix(df, rows_per_bucket=8).toPandas()
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    words = out.toPandas().text.map(lambda t: len(t.split())).sum()
    assert words == report.taken.sum() <= sum(len((r[1] or "").split()) for r in rows)
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_digests(docs):
    out = substring_dedup.remove_repeated_words(docs).filter("doc_id = 0").select(F.sha2("kept", 256).alias("h")).first().h
    assert out == hashlib.sha256(b" ".join(words(known()[0]))).hexdigest()


@pytest.mark.parametrize("work", [quality.quality_report, line_dedup.line_links, suffix_dedup.remove_repeated_bytes, substring_dedup.remove_repeated_words, licenses.license_scan, ngram_join.near_duplicates])
def test_empty(docs, work):
    assert work(docs.limit(0)).count() == 0
