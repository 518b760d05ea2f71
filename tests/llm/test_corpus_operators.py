"""SimHash, decontamination, quality rules, classifiers and the pipeline against brute force and SQL."""

import random
import re
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sparkweave.llm import decontaminate, labelled, packing, quality, rules, simhash, toxicity
from sparkweave.llm.queries import ORACLE, QUERIES
from sparkweave.storage import table

sys.path.insert(0, str(Path(__file__).parent))
from brute import brute_dedup, brute_groups  # noqa: E402

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("　", "　")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(values, radius):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprints():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("aB \tÉ\n\x0b　.") for _ in range(rng.randrange(60)))
        assert simhash.fingerprint(text.encode()) % (1 << 64) == brute_fingerprint(text)
    assert simhash.fingerprint(None) == 0


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_links_join_what_is_near(spark, radius):
    rng = random.Random(radius)
    values = {0, (1 << 64) - 1}
    for _ in range(40):
        v = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            values.add(v)
            for _ in range(rng.randrange(4)):
                v ^= 1 << rng.randrange(64)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), radius).collect()
    at = {v: i for i, v in enumerate(signed)}
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        assert (values[at[a]] ^ values[at[b]]).bit_count() <= 64
        x, y = find(at[a]), find(at[b])
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(values))] == components(values, radius)


def test_large_files_are_filed_again(spark, monkeypatch):
    """With a small BLOCK every shared file goes through its thirds."""
    monkeypatch.setattr(simhash, "BLOCK", 3)
    rng = random.Random(7)
    values = sorted({(0xABCDEF << 40) ^ rng.getrandbits(12) for _ in range(300)})
    links = simhash.fingerprint_links(spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")).collect()
    joined = {a for a, _ in links} | {b for _, b in links}
    want = components(values, 2)
    lonely = [i for i, r in enumerate(want) if want.count(r) == 1]
    assert len(joined) == len(values) - len(lonely)


def test_near_pairs_are_all_found():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    values = np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 90, dtype=np.uint64)) for b in base])
    values = np.unique(values)
    rng.shuffle(values)
    stops = np.array([70, 71, 150, len(values)])
    ends = np.repeat(stops, np.diff(np.concatenate([[0], stops])))
    for radius in (0, 1, 2, 5, 28):
        got = {(int(a), int(b)) for x, y in simhash.near(values, ends, radius) for a, b in zip(x, y, strict=True)}
        want = {(i, j) for i in range(len(values)) for j in range(i + 1, ends[i]) if int(values[i] ^ values[j]).bit_count() <= radius}
        assert got == want


def check(spark, duck, name, query, sql):
    got = query(spark, DATA)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want)), name


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "benchmark", "conversations", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_sql(spark, duck, name):
    check(spark, duck, name, QUERIES[name], ORACLE[name])


@needs_data
def test_proximity_query_against_sql(spark, duck):
    """As ``check``, with the column names quoted: ``at`` is a keyword of DuckDB."""
    got = QUERIES["benchmark_proximity"](spark, DATA).select("at", "doc_id", "item_id").collect()
    want = duck.execute(f'SELECT "at", doc_id, item_id FROM ({ORACLE["benchmark_proximity"]})').fetchall()
    assert want and sorted(map(tuple, got)) == sorted(want)


@needs_data
def test_simhash_query(spark, duck):
    rows = duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    prints = [brute_fingerprint(t) for _, t in rows]
    want = {rows[i][0]: (f"{prints[i]:016x}", rows[r][0]) for i, r in enumerate(components(prints, 2))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op10_simhash"](spark, DATA).collect()} == want


def test_hosts_take_their_documents_with_them(spark):
    """A bad host's clean documents go; hosts of one document take nothing."""
    good = " ".join(f"w{i}" for i in range(40))
    rows = [("bad", "too short")] * 60 + [("bad", good)] * 20 + [("noisy", good + " $#&|<>*%$#|")] * 60 + [("fine", good)] * 300
    rows += [(f"one{i}", good if i % 5 else "too short") for i in range(200)] + [(None, "too short"), (None, good)]
    frame = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    got = rules.judge(frame).join(frame.select("doc_id", "source"), "doc_id").collect()
    gone = {r["source"] for r in got if not r["base_failed"] and not r["kept"]}
    assert gone == {"bad", "noisy"}
    assert all(not r["kept"] for r in got if r["source"] in gone) and all(r["kept"] for r in got if r["source"] == "fine")
    assert [r["kept"] for r in got if r["source"] is None and not r["base_failed"]] == [True]
    assert all(r["host_rate"] < 0.7 for r in got if (r["source"] or "").startswith("one"))  # shrunk from 1


def test_prior_of_hosts():
    rng = np.random.default_rng(1)
    for a, b, sizes in ((2.0, 6.0, [400] * 300), (1.0, 1.0, [5, 50] * 400)):
        n = np.array(sizes)
        f = rng.binomial(n, rng.beta(a, b, len(n)))
        mean, strength = rules.prior(int(n.sum()), int(f.sum()), len(n), float((n * n).sum()), float((f * f / n).sum()))
        assert mean == pytest.approx(a / (a + b), abs=0.05) and strength == pytest.approx(a + b, rel=0.3)
    n = np.full(2000, 3)
    f = rng.binomial(n, 0.2)  # hosts that differ by chance alone
    assert rules.prior(int(n.sum()), int(f.sum()), len(n), float((n * n).sum()), float((f * f / n).sum()))[1] > 20


def test_decontamination_windows(spark):
    """Hits by hand: a window at the start, one at the end, overlapping ones, a short item, and a near miss."""
    words = [f"w{i}" for i in range(14)]
    items = [(1, " ".join(words)), (2, "tiny item"), (3, " ".join(words[2:12])), (4, "W1, w2; w3")]
    docs = [
        (1, " ".join(words[:10]) + " x"),
        (2, "x " + " ".join(words[4:])),
        (3, " ".join(words)),
        (4, " ".join(words[:9]) + " x " + " ".join(words[9:])),
        (5, "a TINY-item here, tiny item"),
        (6, "item tiny"),
    ]
    found = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in found.collect()}
    assert got == {1: (11, 10, ["1", "4"]), 2: (11, 10, ["1"]), 3: (14, 14, ["1", "3", "4"]), 4: (15, 3, ["4"]), 5: (6, 4, ["2"]), 6: (2, 0, [])}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "green tea and black coffee"), (2, "tea x x x x x x x x x green"), (3, "coffee green")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "green tea"), (8, "coffee green tea")], "item_id long, text string")
    near = {(r["doc_id"], r["item_id"]) for r in decontaminate.proximity(docs, items, 4).collect()}
    assert near == {(1, 9), (1, 8)}
    assert (2, 9) in {(r["doc_id"], r["item_id"]) for r in decontaminate.proximity(docs, items, 10).collect()}


def _corpus(rng, n):
    syllables = ["tion", "the", "er", "ing", "an", "on", "re", "st"]

    def word():
        return "".join(rng.choice(syllables) for _ in range(rng.choice([1, 1, 2, 3])))

    rows = []
    for i in range(n):
        ws = [word() for _ in range(rng.randrange(30, 200))]
        good, bad = rng.random() < 0.6, rng.random() < 0.3
        if not good:
            ws = [w + rng.choice(["###", "$$$", "%%%"]) for w in ws]
        if bad:
            for _ in range(max(3, len(ws) // 15)):
                ws[rng.randrange(len(ws))] = rng.choice(["grobok", "wuxelp", "fimplod"])
        rows.append((i, " ".join(ws), int(good), int(bad)))
    return rows


def test_classifiers_on_held_out(spark):
    rows = _corpus(random.Random(5), 600)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, quality int, toxic int")
    truth = {r[0]: r for r in rows}
    for module, column, folds, fold in ((quality, 2, 3, 1), (toxicity, 3, 5, 0)):
        found = module.classify(docs, labels).collect()
        assert len(found) == 600
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold) for r in found)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
        unseen = [r for r in found if r["held_out"]]
        right = np.mean([r["predicted"] == truth[r["doc_id"]][column] for r in unseen])
        assert right > 0.95, (module.__name__, right)


LABELLED = "/root/testdata/sf0.1"


@pytest.mark.skipif(not Path(LABELLED).is_dir(), reason="no test tables")
def test_toxicity_of_labelled_documents():
    """Held-out rows of the real labels. A seventh of the toxic ones have no word or fragment that sets them apart."""
    rows = duckdb.sql(
        f"SELECT doc_id, text, toxic FROM '{LABELLED}/documents.parquet' JOIN '{LABELLED}/labels.parquet' USING (doc_id) ORDER BY doc_id"
    ).fetchall()
    unseen = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    model = toxicity.train([(t, y, 1.0) for _, t, y in learned])
    distance = toxicity.Distance(model.ordinary, model.toxic)
    found = model.probability(np.array([toxicity.features(distance.saved(toxicity.normal(t))) for _, t, _ in unseen])) >= 0.5
    truth = np.array([y for _, _, y in unseen]) == 1
    assert (found == truth).mean() > 0.94 and (found & truth).sum() > 0.65 * truth.sum()


def test_dictionaries_are_trained_on_their_own_texts():
    rng = random.Random(3)
    plain = [" ".join(rng.choice(["tion", "ther", "ing", "stone"]) * rng.randrange(1, 3) for _ in range(60)) for _ in range(300)]
    toxic = [t.replace("stone", rng.choice(["grobok", "wuxelp"]), 3) for t in plain[:100]]
    rows = [(toxicity.normal(t), 0) for t in plain[100:]] + [(toxicity.normal(t), 1) for t in toxic]
    ordinary, bad = toxicity.dictionaries(rows)
    assert ordinary[:4] == b"\x37\xa4\x30\xec" and b"grobok" not in ordinary  # the mark of trained dictionaries
    assert b"grobok" in bad and b"wuxelp" in bad
    runs = toxicity.toxic_runs([t for t, y in rows if y], [t for t, y in rows if not y])
    assert runs and all(b"grobok" in r or b"wuxelp" in r for r in runs)


def test_sample_is_bounded_and_never_held_out(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, y int")
    rows = labelled.sample(docs, labels, "y", 3, 1, 20)
    assert len(rows) == 40 and sum(y for _, y, _ in rows) == 20
    assert all(zlib.crc32(t[1:].encode()) % 3 != 1 and int(t[1:]) % 2 == y for t, y, _ in rows)
    assert rows == labelled.sample(docs.repartition(7), labels.repartition(3), "y", 3, 1, 20)
    known = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(300))
    assert sum(w for _, _, w in rows) == pytest.approx(known)


def test_gradients():
    rng = np.random.default_rng(0)

    def w(*shape):
        return rng.normal(0, 0.5, shape)

    d = quality.FEATURES
    model = quality.Model(np.zeros(d), np.ones(d), w(d, 4), w(4), w(4, 3), w(4, 3), w(3), w(4), w(1))
    x, counts, y, weight = w(9, d), np.array([2, 4, 3]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        p = model.forward(x, counts)["score"]
        return -np.mean(weight * (y * np.log(p) + (1 - y) * np.log(1 - p)))

    names = ["encode", "encode_bias", "attend", "gate", "weigh", "out", "out_bias"]
    for name, g in zip(names, model.gradients(x, counts, y, weight), strict=True):
        value = getattr(model, name)
        for at in [tuple(rng.integers(0, s) for s in value.shape) for _ in range(5)]:
            old = value[at]
            value[at] = old + 1e-6
            up = loss()
            value[at] = old - 1e-6
            down = loss()
            value[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_passages_don_t_depend_on_neighbours():
    texts = [b"", b"one two", b" ".join(b"word%d" % (i % 70) for i in range(300)), b" \n ", "äöü 東京".encode() * 50]
    together, counts = quality.passages(texts)
    assert counts.tolist() == [1, 1, 5, 1, 1]
    alone = np.concatenate([quality.passages([t])[0] for t in texts])
    assert np.allclose(together, alone, atol=1e-6)


def test_long_texts_are_scored_in_slices(monkeypatch):
    rng = random.Random(11)
    rows = [(t, q, 1.0) for _, t, q, _ in _corpus(rng, 80)]
    model = quality.train(rows)
    texts = [t.encode() for t, _, _ in rows[:3]] + [b" ".join(t.encode() for t, _, _ in rows), b"  \n x " * 900, b"y" * 5000 + b" z" * 400, b" " * 3000]
    monkeypatch.setattr(quality, "SLICE", 700)
    for text in texts:
        pieces = list(quality.slices(text))
        assert b"".join(p for p, _, _ in pieces) == text and [e for *_, e in pieces] == [False] * (len(pieces) - 1) + [True]
        x = np.concatenate([quality.passages([p], before, last)[0] for p, before, last in pieces])
        assert np.allclose(x, quality.passages([text])[0], atol=1e-6)
        assert model.score_long(text) == pytest.approx(model.score(*quality.passages([text]))[0], abs=1e-9)
    assert len(list(quality.slices(texts[3]))) > 10


@needs_data
def test_pipeline(spark, duck):
    """Stage by stage: what each keeps is what its operator says of its own input."""
    docs = table(spark, DATA, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, DATA).cache()
        kept[name] = docs
        if name == "quality_classifier":
            scores = quality.score(before, quality.learn(table(spark, DATA, "documents"), table(spark, DATA, "labels"))).collect()
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in scores if r["score"] >= 0.5}
        if name == "line_dedup":
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == brute_dedup([(r["doc_id"], r["text"]) for r in before.collect()])
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        if name == "near_duplicates":
            rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
            want = brute_groups([t for _, t in rows])
            assert {r["doc_id"] for r in docs.collect()} == {rows[i][0] for i, r in enumerate(want) if r == i}
        if name == "benchmark_decontamination":
            judged = decontaminate.decontaminate(before, table(spark, DATA, "benchmark")).collect()
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in judged if not r["contaminated"]}
        if name == "packing":
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()}
            whole = packing.pieces(before).agg(F.sum("length")).first()[0]
            assert docs.agg(F.sum("length")).first()[0] == whole
    run = corpus_pipeline.run(spark, DATA)
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, run.select(key).collect())) == sorted(map(tuple, kept["packing"].select(key).collect()))
