"""Corpus queries against their DuckDB forms, and the pipeline from end to end, on the smallest tables."""

from __future__ import annotations

import re

import pytest

import corpus_pipeline
from lapwing.llm import line_dedup, queries
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, duck, data, name):
    same_rows(queries.QUERIES[name](spark, data).toPandas(), duck.sql(queries.ORACLES[name]).df())


def test_pipeline(spark, data):
    """``run`` stage by stage: columns, verdicts of each stage on its own input, and every token of what is left in exactly one piece."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, seen = docs.columns, [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.table(stage(spark, docs, data), "test")
        assert docs.columns == columns, name
        seen.append(docs.toPandas())
    raw, clean, lines, near, mixed = seen
    assert 0 < len(clean) < len(raw) and set(clean.doc_id) <= set(raw.doc_id)
    # Line dedup: no two lines that stay are equal, none that stays is new, and its own report has nothing more to say.
    left = [x.strip() for t in lines.text for x in t.split("\n") if x.strip()]
    assert len(left) == len(set(left))
    before = dict(zip(clean.doc_id, clean.text))
    assert all(set(t.split("\n")) <= set(before[i].split("\n")) and len(t) >= 0.2 * len(before[i]) for i, t in zip(lines.doc_id, lines.text))
    assert line_dedup.line_links(spark.createDataFrame(lines[["doc_id", "text"]]), 1).filter("not kept").isEmpty()
    # Near duplicates: of documents linked at the threshold, the least of each component stays.
    sets = {}
    for i, t in zip(lines.doc_id, lines.text):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)])
    root = {i: i for i in sets}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(near.doc_id) == sorted({find(i) for i in sets})
    words = near.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))
    assert set(mixed.doc_id) <= set(near.doc_id) and 0.9 * words.sum() < mixed.text.map(lambda t: len(t.split())).sum() <= words.sum()
    pieces = corpus_pipeline.run(spark, data).toPandas()
    tokens = pieces.groupby("doc_id").agg(got=("length", "sum"), each=("doc_tokens", "first"))
    assert (tokens.got == tokens.each * mixed.groupby("doc_id").size().reindex(tokens.index)).all() and set(tokens.index) == set(mixed.doc_id)
