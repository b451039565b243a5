"""Toxicity, token alignment and ranked search against brute force and held-out labels; messages between shards; odd vectors and lines."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import floor, log

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lapwing.llm import alignment, ann, lexical, licenses, quality, repeats, toxicity
from tests.llm.test_corpus import corpus

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, run long, n int"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


# Ranked search


def brute_ranks(docs: list[tuple], items: list[tuple], k: int) -> dict:
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, Counter(fold(t)), len(fold(t))) for d, t in docs]
    n_docs, n_terms = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked: dict = defaultdict(set)
    for i, t in items:
        asked[i] |= set(fold(t))
    out = {}
    for i, terms in asked.items():
        rows = []
        for d, c, n in held:
            m = 50 + (50 * n * n_docs) // max(n_terms, 1)
            score = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                rows.append((-score, d is None, d or 0))
        out[i] = [(None if gone else d, -s) for s, gone, d in sorted(rows)[:k]]
    return {i: r for i, r in out.items() if r}


ITEMS = [(1, "ab CD e"), (2, "É a, ab-ab"), (3, None), (4, "zzz"), (5, ""), (1, "bad"), (None, "cab ab a"), (7, " ".join(["abc"] * 500))]


@pytest.mark.parametrize("known, segment, block, batch", [(True, 8192, 16_384, 256), (False, 5, 12, 2), (True, 4, 9, 1)])
def test_ranked_search(spark, docs, monkeypatch, known, segment, block, batch):
    monkeypatch.setattr(lexical, "SEGMENT_DOCS", segment)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("term", F.lit("x"))
    asked = lexical.item_terms(items)
    words = [r[0].encode() for r in asked.select("term").distinct().collect()] if known else None
    index = lexical.lexical_index(docs, words).persist()
    found = defaultdict(list)
    for r in sorted(lexical.lexical_top_k(index, asked, 6, block, batch).collect(), key=lambda r: r["rank"]):
        found[r.item_id].append((r.doc_id, r.score))
    assert dict(found) == brute_ranks([(r[0], r[1]) for r in corpus()], ITEMS, 6)


def test_ranked_search_of_nothing(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.ranked_search(docs.filter("false"), items).isEmpty() and lexical.ranked_search(docs, items.filter("false")).isEmpty()


def test_sliced_arithmetic():
    rng = np.random.default_rng(1)
    for n in (1, 7, 200):
        total, want = [], np.zeros(n, np.int64)
        for _ in range(12):
            at = np.flatnonzero(rng.random(n) < 0.4)
            values = rng.integers(1, 2**35, len(at))
            if len(at):
                lexical.add(total, lexical.sliced(at, values, n))
                want[at] += values
        for k in (1, 3, n, n + 4):
            at, value = lexical.largest(total, n, k)
            order = [i for i in np.lexsort((np.arange(n), -want)) if want[i] > 0][:k]
            assert sorted(order) == at.tolist() and (value == want[at]).all()
    assert lexical.largest(lexical.sliced(np.arange(9), np.full(9, 5), 9), 9, 4)[0].tolist() == [0, 1, 2, 3]  # ties


# Token alignment


def brute_groups(text: str | None, t: alignment.Tokenizers):
    if not text:
        return None
    a, b, full = t.exact.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text), (" " + text).encode()
    if b"".join(t.bytes_a[i] for i in a) != full or b"".join(t.bytes_b[i] for i in b) != full:
        return None
    own = lambda ids, of: [k for k, i in enumerate(ids) for _ in of[i]]
    links = [(a[i], b[j]) for i, j in sorted(set(zip(own(a, t.bytes_a), own(b, t.bytes_b))))]
    ends = lambda ids, of: np.cumsum([len(of[i]) for i in ids]).tolist()
    end_a, end_b = ends(a, t.bytes_a), ends(b, t.bytes_b)
    cuts = sorted({*end_a} & {*end_b})
    part = lambda ids, end, low, high: ",".join(str(i) for i, e in zip(ids, end) if low < e <= high)
    groups = ";".join(f"{part(a, end_a, x, y)}|{part(b, end_b, x, y)}" for x, y in zip([0, *cuts], cuts))
    return len(a), len(b), len(cuts), links, groups


ODD = [
    " ", "\n", "  a  b ", "a\n", "\n\na", "a \n b", "x▁y z", "<|endoftext|> <s> </s>", "it's 'tis I'll", "é́ ́x y", "\x1c a\x1c b", "tab\tx  \ty", "ＡＢ ｃ ﬁ", "　x 　 y",
    "a\r\nb c", "\x00 \x00", "😀 😀😀 x", "a b  c  d", "﻿x y﻿ z", "​ x​y z", "word " * 50 + " end", " " * 60_000 + "x y", "x" + " " * 60_000, "a\u0085 b\u0085c", None, "",
]


def test_alignment(spark):
    rng = random.Random(5)
    rows = [(r[0], r[1]) for r in corpus()] + [(1000 + i, x) for i, x in enumerate(ODD)]
    rows += [(2000 + i, "".join(rng.choice(["a", "é", " ", "  ", "\n", "the", "▁", "'s", "12", "。", " x"]) for _ in range(30))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit("clash")).repartition(3)
    t = alignment.tokenizers(*PATHS)
    want = [(d, brute_groups(x, t)) for d, x in rows]
    count = Counter(link for _, g in want if g for link in g[3])
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    row = lambda d, g: (d, g[0], g[1], g[2], len(g[3]), sum(count[x] == most[x[1]] for x in g[3]), sum(count[x] for x in g[3]), g[4]) if g else (d, 0, 0, 0, 0, 0, 0, "")
    key = lambda r: tuple((x is None, x) for x in r)
    got = alignment.align_documents(docs, *PATHS).collect()
    assert sorted(map(tuple, got), key=key) == sorted((row(d, g) for d, g in want), key=key)
    digest = alignment.align_documents(docs, *PATHS, whole_groups=False).select("doc_id", "groups_sha256").collect()
    sha = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    assert sorted(map(tuple, digest), key=key) == sorted(((r.doc_id, sha(r.groups)) for r in got), key=key)
    pairs = {(r.a_id, r.b_id): (r.n_links, r.best) for r in alignment.id_pairs(docs, *PATHS).collect()}
    assert pairs == {x: (n, n == most[x[1]]) for x, n in count.items()}
    assert alignment.align_documents(docs.filter("false"), *PATHS).isEmpty()


def test_alignment_reads_texts_once(spark, tmp_path):
    big = 2**60 + 1
    rows = [(big, "the cat sat"), (None, "the end"), (big + 1, None), (7, "bad \ufffe the")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/texts")
    docs = spark.read.parquet(f"{tmp_path}/texts")
    for whole in (True, False):
        out = alignment.align_documents(docs, *PATHS, whole_groups=whole)
        assert not any("texts" in f for f in out.inputFiles())  # the second pass goes by the table of aligned chunks
        assert {r.doc_id for r in out.collect()} == {d for d, _ in rows}
    for x in ([], [0], [7, 2**32 - 1, 256, 0, 65_536]):
        assert alignment.unpacked(alignment.packed(np.array(x, np.int64))).tolist() == x
    unspelt = spark.createDataFrame([(1, None), (2, ""), (3, "x▁y z")], "doc_id long, text string")  # no link at all
    assert sorted(map(tuple, alignment.align_documents(unspelt, *PATHS).collect())) == [(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2, 3)]


# Toxicity


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    hit = (out["predicted"] == 1) & (out["toxic"] == 1)
    assert hit.sum() / (out["toxic"] == 1).sum() >= 0.85 and hit.sum() / (out["predicted"] == 1).sum() >= 0.85  # a twentieth of its labels say nothing of the text
    order = out["score"].rank().to_numpy()
    positive = (out["toxic"] == 1).to_numpy()
    auc = (order[positive].sum() - positive.sum() * (positive.sum() + 1) / 2) / (positive.sum() * (~positive).sum())
    assert auc >= 0.9


def toxic_corpus(n: int = 600) -> list[tuple]:
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    rows = []
    for i in range(n):
        sentences = [[word() for _ in range(8)] for _ in range(rng.randint(1, 12))]
        toxic = i % 7 == 0
        if toxic:
            for _ in range(2):
                rng.choice(sentences).insert(2, rng.choice(["Zonk", "grimblest", "grimbleau,"]))
        rows.append((i, " ".join(" ".join(s) + "." for s in sentences), int(toxic)))
    return rows


def test_toxic_sentences_are_located(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "zonk it. fine."), (9001, None), (9002, ""), (7, rows[7][1])], "doc_id long, text string").withColumn("toxic", F.lit(9)).repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (None, 1), (0, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model).collect()
    texts = {i: t for i, t, _ in rows}
    for r in out:
        if r.doc_id in texts:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
            assert r.predicted == int(r.doc_id % 7 == 0) == int(r.score >= 0.3)
            spans = [texts[r.doc_id][s.start : s.stop] for s in r.sentences]
            bad = [s + "." for s in texts[r.doc_id].split(".") if "onk" in s or "grimble" in s]
            assert spans == bad
    odd = {r.doc_id: r for r in out if r.doc_id is None or r.doc_id > 9000}
    assert odd[None].predicted == 1 and not odd[None].held_out and [(s.start, s.stop) for s in odd[None].sentences] == [(0, 8)]
    assert odd[9001].score == odd[9002].score == pytest.approx(model.leak) and len(out) == len(rows) + 4


def test_held_out_labels_and_ids_teach_nothing(spark):
    rows = toxic_corpus(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    told = [(i, y if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - y) for i, _, y in rows]  # held-out labels turned round
    fits = [toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in ([(i, y) for i, _, y in rows], told)]
    assert fits[0] == fits[1]
    for labels in ([], [(1, 0), (3, 0)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert not model.weights and {r.predicted for r in toxicity.score(docs, model).collect()} == {0}
    assert toxicity.toxicity(docs.filter("false"), spark.createDataFrame(told, "doc_id long, toxic int")).isEmpty()


# What was mended


@pytest.mark.parametrize("shards", [16, 64, 400, 4096])
def test_home_shards_are_even(shards):
    chunks = [(p << 32) + n for p in range(1000) for n in range(8)]
    load = Counter(repeats.home_shard(c, shards) for c in chunks)
    assert max(load.values()) <= max(12, 2.5 * len(chunks) / shards)


def test_vectors_of_any_scale(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * [1, 1e-200, 1e-30, 1e200, 1e-310][i % 5]).tolist()) for i in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(vectors, vectors.filter("vec_id % 30 < 5"), query_rows=9).toPandas()
    x = np.array([v for _, v in rows])
    x /= np.abs(x).max(axis=1)[:, None]
    x /= np.linalg.norm(x, axis=1)[:, None]
    near, hits = x @ x.T, 0
    np.fill_diagonal(near, -9)
    for q, found in got.groupby("query_id"):
        assert len(found) == 5 and np.allclose(found["score"], near[q][found["vec_id"]], atol=1e-9)
        hits += len({*np.argsort(-near[q])[:5]} & {*found["vec_id"]})
    assert got["query_id"].nunique() == 50 and hits >= 0.9 * 250


def test_recall_on_the_given_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.search(vectors, vectors.filter("vec_id % 50 = 0")).toPandas()
    rows = vectors.select("vec_id", "embedding").toPandas().sort_values("vec_id")
    ids, x = rows["vec_id"].to_numpy(), np.array(rows["embedding"].tolist(), np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q, found in got.groupby("query_id"):
        near = x @ x[ids == q][0]
        near[ids == q] = -9
        hits += len({*ids[np.argsort(-near)[:5]]} & {*found["vec_id"]})
    assert hits >= 0.9 * 5 * got["query_id"].nunique() == 0.9 * len(got)


def test_one_phrase_does_not_drop_a_long_line():
    rules, clean = quality.LineRules(), " ".join(f"word{i} goes on and on." for i in range(40))
    assert rules.line_fails(clean, 200) is None
    assert rules.line_fails(clean + " The mill is powered by the river.", 207) is None
    assert rules.line_fails("Powered by Acme.", 3) == rules.line_fails("All rights reserved. Terms of use. Hello there.", 8) == "boilerplate"


# Licenses


def found_licenses(text: str) -> dict[str, dict]:
    import pyarrow as pa

    ready = [licenses.Template(n, tuple(w := licenses.normal_words(t)), Counter(w)) for n, t in licenses.TEMPLATES.items()]
    batch = pa.record_batch([pa.array([1]), pa.array([text])], ["doc_id", "text"])
    return {r["license"]: r for x in licenses._scan([batch], ready, 0.8) for r in x.to_pylist()}


@pytest.mark.parametrize("text, names", [
    ("Licensed under the MIT License or the Apache License, Version 2.0", {"mit", "apache-2.0"}), ("dual licensed: the MIT License or Apache License, Version 2.0", {"mit", "apache-2.0"}),
    ("This is not licensed under the MIT License", set()), ("It was never released under the MIT License.", set()), ("Nothing here is not good. Released under the MIT License", {"mit"}),
    ("SPDX-License-Identifier: Apache-2.0", {"apache-2.0"}), ("Apache License 2.0", {"apache-2.0"}), ("GNU General Public License v3.0", {"gpl-3.0"}), ("GPLv3", {"gpl-3.0"}),
    ("BSD-3-Clause", {"bsd"}), ("SPDX-License-Identifier: BSD-2-Clause", {"bsd"}), ("GNU Lesser General Public License v3.0", {"lgpl-3.0"}), ("Apache/2.0.52 (Unix)", set()),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", {"mit", "apache-2.0"}), ("Apache-2.0 OR MIT", {"mit", "apache-2.0"}), ("Mozilla Public License 2.0", {"mpl-2.0"}),
])
def test_names_of_licenses(text, names):
    filler = "some words of an ordinary text that says nothing at all about it. "
    for around in (text, filler * 30 + text + ". " + filler * 30):
        assert set(found_licenses(around)) == names


def test_planted_licenses_are_found_where_they_stand():
    """Each wording, a tenth of its words gone or replaced where it is long, planted in random words."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    for name, template in licenses.TEMPLATES.items():
        own = licenses.normal_words(template)
        noisy = [w if len(own) < 60 or w in licenses.DECIDING or rng.random() > 0.1 else rng.choice(["", word()]) for w in own]
        before = rng.randint(0, 300)
        words = [word() for _ in range(before)] + [w for w in noisy if w] + [word() for _ in range(rng.randint(0, 300))]
        got = found_licenses(" ".join(words))
        hit = got[name.partition(":")[0]]
        assert hit["coverage"] >= 0.8 and before <= hit["first_word"] <= hit["last_word"] < before + len(own)
        assert hit["n_words"] == len(words)
    for _ in range(20):
        assert not found_licenses(" ".join(word() for _ in range(2000)))


def test_licenses_of_odd_rows(spark):
    rows = [(None, "GPLv3", "k"), (1, "x" * 3_000_000, "k"), (2, "GPLv3", "k"), (2, "GPLv3", "k"), (3, ("word " * 400_000) + "the MIT License " + ("word " * 400_000), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string").withColumn("hits", F.lit("clash"))
    got = [(r.doc_id, r.license, r.first_word) for r in licenses.license_scan(docs).collect()]
    assert sorted(got, key=str) == sorted([(None, "gpl-3.0", 0), (2, "gpl-3.0", 0), (2, "gpl-3.0", 0), (3, "mit", 400_000)], key=str)


def test_pipeline_of_empty_and_odd_tables(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame(corpus(), SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    docs.filter("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).isEmpty()
    docs.withColumn("shard", F.lit("clash")).withColumn("kept", F.lit(1)).write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert pieces and {p.doc_id for p in pieces} <= {r[0] for r in corpus()}
