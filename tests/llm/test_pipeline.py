"""The pipeline against a brute-force version of its stages, where a stage isn't a draw."""

import re
from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from shoebox.llm import pieces, quality, secrets
from shoebox.llm.common import durable

from .test_nearcopies import _kept
from .test_operators import WORD

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        found.append(durable(stage(spark, found[-1], DIR), f"test-{name}"))
    return [[r.asDict() for r in x.collect()] for x in found]


def test_stages_return_the_columns_of_documents(steps):
    columns = set(steps[0][0])
    assert all(set(r) == columns for step in steps[1:-1] for r in step)
    assert set(steps[-1][0]) == columns | {"pieces"}


def test_quality_stage(steps):
    wanted = Counter()
    for r in steps[0]:
        lines = (r["text"] or "").split("\n")
        text = "\n".join(x for x in lines if quality.line_fails(x.encode()) is None)
        (n, *_, base_failed, kept, lost, _, _, _), _ = quality.judge((r["text"] or "").encode())
        assert lost == len(WORD.findall(r["text"] or "")) - len(WORD.findall(text))
        assert kept == (not base_failed and lost <= quality.MOST_LOST * n)
        if kept:
            wanted[(r["doc_id"], text, len(text))] += 1
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in steps[1]) == wanted


def test_near_duplicate_stage(steps):
    """The stage's rule is similarity of five-word shingles, 0.8 or more; operator 8's four words and four bits bind its query alone."""
    rows = sorted(steps[1], key=lambda r: r["doc_id"])
    assert sorted(r["doc_id"] for r in steps[2]) == _kept([(r["doc_id"], r["text"]) for r in rows])


def test_secret_stage(steps):
    before = {r["doc_id"]: r["text"] for r in steps[2]}
    rules = [(re.compile(r.pattern + r.tail, re.A | (re.I if r.ignore_case else 0)), r) for r in secrets.RULES]
    for r in steps[3]:
        spans = sorted((m.start(), k, m.end(), rule.kind) for k, (p, rule) in enumerate(rules) for m in p.finditer(before[r["doc_id"]]) if len(m[rule.group]) >= rule.least)
        out, at = "", 0
        for start, _, end, kind in spans:
            if start >= at:
                out += before[r["doc_id"]][at:start] + f"[{kind} removed]"
            at = max(at, end)
        assert r["text"] == out + before[r["doc_id"]][at:] and r["n_chars"] == len(r["text"])
    assert len(steps[3]) == len(steps[2])


def test_mixing_stage(steps):
    sizes = Counter()
    for r in steps[3]:
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    taken = Counter((r["doc_id"], r["text"]) for r in steps[4])
    assert taken.keys() <= {(r["doc_id"], r["text"]) for r in steps[3]} and max(taken.values()) <= 3
    assert abs(sum(len(WORD.findall(r["text"])) for r in steps[4]) - sum(sizes.values())) <= 0.1 * sum(sizes.values())


def test_piece_stage(steps):
    with open(pieces.MODEL, "rb") as f:
        vocabulary = pieces.Vocabulary(f.read())
    assert len(steps[5]) == len(steps[4])
    assert all(vocabulary.decode(r["pieces"]).decode() == r["text"] for r in steps[5])


def test_registered_queries(spark):
    found = __spark_entry__.queries()
    assert {f"op{k}" for k in range(1, 11)} == {n.split("_")[0] for n in found if re.match(r"op\d+_", n)}
    assert found["pipeline"] is corpus_pipeline.run and "pipeline" not in __spark_entry__.oracle_sql()
