"""Near-duplicates against the similarity of all pairs."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from sparkweave.llm import simhash_verified

sys.path.insert(0, str(Path(__file__).parent))
from brute import brute_groups  # noqa: E402


def texts_with_near_copies(seed, n=60):
    rng = random.Random(seed)
    common = " ".join(f"c{i}" for i in range(9))
    texts = [None, "", " \n", "one two", "One  two", "one two three four five", "one two three four six"]
    for _ in range(n):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([5, 12, 60, 150]))]
        text = " ".join(words) + rng.choice(["", " " + common])
        texts.append(text)
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            words = text.split()
            for _ in range(rng.randrange(1, 1 + max(2, len(words) // 35))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(4000)}"
            texts.append(" ".join(words))
            if rng.random() < 0.3:
                text = texts[-1]
    return texts


@pytest.mark.parametrize("seed, often", [(1, 4), (2, 1)])
def test_one_of_each_group_stays(spark, monkeypatch, seed, often):
    """All groups by brute force, with and without a guess of what is frequent."""
    monkeypatch.setattr(simhash_verified, "OFTEN", often)
    monkeypatch.setattr(simhash_verified, "SAMPLED", 2)
    monkeypatch.setattr(simhash_verified, "BROADCAST_ROWS", 0 if seed == 1 else 1000)
    texts = texts_with_near_copies(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {i for i, r in enumerate(brute_groups(texts)) if i == r}
    assert len(want) < len(texts) - 20
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == want


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(4)
    for _ in range(500):
        a = np.unique(rng.integers(0, 1 << 40, rng.integers(1, 60)))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 1 << 40, rng.integers(0, 5))]))
        if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)):
            often = np.unique(rng.choice(a, len(a) // 2))
            counts = rng.integers(1, 4, len(often))
            assert np.intersect1d(simhash_verified.prefix(a, often, counts), simhash_verified.prefix(b, often, counts)).size


def test_rows_are_judged_each(spark):
    """Rows that repeat an id or have none go as near copies, and stay where nothing is like them."""
    base = " ".join(f"b{i}" for i in range(80))
    near = base.replace("b40", "other")
    rows = [(1, base), (2, near), (2, "z alone"), (2, "a alone too"), (None, near + " end"), (None, "unnamed and alone"), (None, "unnamed and alone")]
    kept = simhash_verified.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(1, base), (2, "a alone too"), (2, "z alone"), (None, "unnamed and alone")]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(want, key=repr)


def test_blocks_of_a_large_file_all_meet(spark, monkeypatch):
    """One shingle that all texts begin their order with, and blocks of four rows."""
    monkeypatch.setattr(simhash_verified, "_frequent", lambda *a: (np.zeros(0, dtype=np.int64),) * 2)
    rng = random.Random(9)
    texts = []
    for i in range(12):
        words = [f"w{i}_{k}" for k in range(40)]
        texts += [" ".join([*words[:k], f"x{rng.random()}", *words[k + 1 :]]) for k in (0, 20, 39)]
    monkeypatch.setattr(simhash_verified, "prefix", lambda found, *a: np.append(found, 7))
    monkeypatch.setattr(simhash_verified, "_may", lambda a, b: a == a)
    whole = simhash_verified._compared
    rows = [(7, b, c, d, v, simhash_verified.majority(simhash_verified.shingles(t.encode()).view(np.uint64)), 0, v) for b in range(9) for c in range(b, 9) for d in {b, c} for v, t in list(enumerate(texts))[4 * d : 4 * d + 4]]
    batch = simhash_verified.pa.RecordBatch.from_arrays([simhash_verified.pa.array(c, "int64") for c in zip(*sorted(rows), strict=True)], names=list("abcdefgh"))
    got = {(a, b) for out in whole(iter([batch.slice(0, 100), batch.slice(100)])) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)}
    prints = [simhash_verified.majority(simhash_verified.shingles(t.encode()).view(np.uint64)) for t in texts]
    assert got == {(i, j) for i in range(36) for j in range(i + 1, 36) if ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= simhash_verified.RADIUS}
    assert {(3 * i, 3 * i + 1) for i in range(12)} <= got
