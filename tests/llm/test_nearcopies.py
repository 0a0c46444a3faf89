"""The pipeline's near copies against brute force over five-word shingles."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from shoebox.llm import nearcopies, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def _kept(rows):
    """The rows that one_of_each should keep, by id and text."""
    sets, parent = [_shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(least.values())


def _made():
    draw, texts = random.Random(8), []
    for _ in range(12):
        base = [f"w{draw.randint(0, 400)}" for _ in range(draw.randint(8, 220))]
        texts.append(" ".join(base))
        for _ in range(6):  # near copies on both sides of 0.8, some only alike through another
            copy = list(base)
            for _ in range(draw.randint(1, max(1, len(base) // 30))):
                copy[draw.randrange(len(copy))] = f"x{draw.randint(0, 99)}"
            texts.append("  ".join(copy).upper() if draw.random() < 0.2 else " ".join(copy))
    passage = " ".join(f"p{k}" for k in range(30))
    texts += [f"{passage} " + " ".join(f"q{draw.randint(0, 999)}" for _ in range(20)) for _ in range(8)]
    return [*enumerate(texts + ["", None, " \n", "one two", "ONE  two", "one two three"])]


@pytest.mark.parametrize("often", [4, 10**9])
def test_one_of_each_joins_what_brute_force_joins(spark, monkeypatch, often):
    monkeypatch.setattr(nearcopies, "OFTEN", often)
    rows = _made()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    one = simhash.one_of_each(df)
    assert one.columns == df.columns and sorted(r["doc_id"] for r in one.collect()) == _kept(rows)
    assert simhash.one_of_each(df.limit(0)).count() == 0


def test_sketches_never_tell_more_differences_than_there_are():
    draw = random.Random(2)
    for _ in range(200):
        x, y = ({draw.randrange(1 << 20) for _ in range(draw.randint(1, 300))} for _ in "xy")
        y |= set(draw.sample(sorted(x), draw.randint(0, len(x))))
        a, b = (nearcopies.sketch(np.array(sorted(v), np.uint64)) for v in (x, y))
        assert nearcopies._apart(a, b) == nearcopies._apart(b, a) <= len(x ^ y)


def test_stage_finds_copies_with_some_changed_words(spark):
    words = [f"w{k}" for k in range(150)]
    changed = [w if k not in (20, 70, 120) else "other" for k, w in enumerate(words)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(words[::-1]))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [1, 3]


def test_null_ids_repeated_rows_and_clashing_names(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(None, text, 1), (7, text, 2), (7, text, 2), (7, text + " more", 3), (None, "alone here", 4), (None, "alone here", 4), (3, None, 5), (4, "", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int").withColumnRenamed("node", "id").selectExpr("doc_id", "text", "id", "id as node", "id as `row`", "id as fp")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in simhash.one_of_each(df).collect())
    least = min((text, text + " more"), key=lambda t: spark.range(1).selectExpr(f"xxhash64('{t}') as h").first()["h"])
    assert got == [(False, 3, ""), (False, 7, least), (True, 0, "alone here")]


def _pairs_by_key(sets):
    """What _across gives under each shingle of the sets' prefixes, every set being a component of its own."""
    rows = {}
    for node, one in enumerate(sets):
        n = len(one)
        for at, key in enumerate(one[: n - (4 * n + 4) // 5 + 1]):
            rows.setdefault(key, []).append((key, node, n, at, one[at - 1] if at else 0, node, 0, nearcopies.sketch(np.array(one, np.uint64), nearcopies.SMALL)))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    out = []
    for key in sorted(rows):
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[key]), kinds)], names=list("knsahpfm"))
        out += [(a, b) for got in nearcopies._across(iter([batch])) for a, b in zip(got.column(0).to_pylist(), got.column(1).to_pylist())]
    return out


def test_a_pair_meets_under_its_first_common_shingle():
    assert _pairs_by_key([list(range(1, 101)), list(range(1, 101)) + [500]]) == [(0, 1)]
    draw, sets = random.Random(8), []
    for _ in range(40):
        base = draw.sample(range(1, 5000), draw.randint(1, 30))
        for _ in range(5):
            other = set(base) ^ set(draw.sample(base, draw.randint(0, len(base) // 6))) | set(draw.sample(range(1, 5000), draw.randint(0, len(base) // 6)))
            sets.append(sorted(other))
    similar = {(i, j) for (i, x), (j, y) in combinations(enumerate(map(set, sets)), 2) if 5 * len(x & y) >= 4 * len(x | y)}
    assert len(similar) > 100 and similar <= set(_pairs_by_key(sets))
