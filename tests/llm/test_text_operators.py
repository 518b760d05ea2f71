"""License scans, line dedup, packing, the id store and chat formatting against brute force."""

import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkweave.llm import chat, licenses, linededup, packing, store, tokens
from sparkweave.llm.tokens import Encoder
from sparkweave.storage import delete_path, new_path

sys.path.insert(0, str(Path(__file__).parent))
from brute import brute_dedup  # noqa: E402


def test_encoder_equals_library():
    texts = [
        "It's  a\t\ntest… _foo_ 12 ''s <|endoftext|> naïve İstanbul 东京 x² ",
        "'S 'LL don't\x1cfoo", "  lead", "tail  \n", "", "ﬁ é ſ", "á  b", "Größe ÉÈ <|startoftext|>", "½ ª º µ", "​﻿", "ǅ ŉ",
    ]
    rng = random.Random(4)
    letters = "ab' \n\tÉßs._-9#é’"
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["x <|endoftext|> y", "<|endoftext|><|startoftext|>", "a<|startoftext|>b", "<|ENDOFTEXT|> x", "<|endoftext|"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        mine, plain = Encoder(name), Tokenizer.from_file(public_tokenizers.path(name))
        assert plain.encode("x <|endoftext|> y", add_special_tokens=False).ids.count(plain.token_to_id("<|endoftext|>")) == 1
        for _ in range(2):  # the second time from memory
            for t in texts:
                assert np.frombuffer(mine.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_texts_together_equal_library(monkeypatch):
    """Texts cut at once have the library's ids, whatever the groups, and the memory is asked once for each distinct piece of a group."""
    rng = random.Random(9)
    letters = "''''ssttrreevvllmmddabSLİÉéßſıŊŽ×÷09 \n\t\x0b\x00\x1b.,-_‐‧‰›€"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += ["", " ", "'", "''", "'s", "'l", "'ll", "'r", "'re", "'string'll've", "x'", "é", "€", "1", "東", "\x85 \xa0", "<|endoftext|>", "a <|startoftext|>'s"]
    texts += ["don't stop, " * 300, "it's 10,000!\n" * 300]
    rng.shuffle(texts)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        plain = Tokenizer.from_file(public_tokenizers.path(name))
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        for together in (1, 100, 1 << 22):
            monkeypatch.setattr(tokens, "TOGETHER", together)
            mine = Encoder(name)
            for _ in range(2):  # the second time from memory
                assert [np.frombuffer(x, "<u4").tolist() for x in mine.encode_all(texts)] == want
    assert mine.encode_all([]) == [] and mine.encode_all(["", " \n"]) == [b"", b""]

    class Asked(tokens._Memory):
        times = 0

        def __getitem__(self, piece):
            self.times += 1
            return super().__getitem__(piece)

    mine.memory = Asked(mine.tokenizer.model)
    mine.encode_all(["don't stop, Stop " * 50] * 20)
    assert mine.memory.times == 4  # don, 't, stop and the comma


def _automata():
    return licenses.compile_all(licenses.BASE, licenses.TEMPLATES)


@pytest.mark.parametrize(
    ("text", "labels", "base"),
    [
        ("Released under the MIT License.", "mit", "mit"),
        ("Licensed under the Apache License, Version 2.0.", "apache-2", "apache-2"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc", "cc-by-nc"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3", ""),
        ("redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License", "gpl-2", ""),
        ("Released under the terms of the MIT License", "mit", ""),
        ("Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc", ""),
        ("under the GNU Lesser General Public License", "lgpl", ""),
        ("distributed under the 3-clause BSD License", "bsd", ""),
        ("a license under the sun; no license version", "", ""),
        ("licensed under the GNU General Private License, version 3", "", ""),
        (None, "", ""),
    ],
)
def test_license_labels(text, labels, base):
    found = licenses.scan_text(text and text.encode(), _automata())
    assert (found[5], found[4]) == (labels, base) and (found[6] > 0) == bool(labels)


def test_license_places():
    text = "Under the MIT license! under the mit LICENSE; cc by nc, cc-by-nc ünder the mit license".encode()
    n, base, first, last, base_labels, labels, score, spans = licenses.scan_text(text, _automata())
    assert (n, base, first, last, base_labels) == (18, 4, 0, 11, "cc-by-nc,mit") and 0 < score <= 1
    assert {(s["start"], s["end"]) for s in spans if s["base"]} == {(0, 4), (4, 8), (8, 11), (11, 14)}


def _expansions(template):
    """All word sequences of a template with small replaceable regions over two words."""
    parts = licenses._MARKUP.findall(template)

    def walk(i, depth):
        out = [[]]
        while i < len(parts):
            mark, word = parts[i]
            kind = mark.split()
            if mark and kind[0] == "opt":
                inner, i = walk(i + 1, depth + 1)
                options = [[], *inner]
            elif mark and kind[0] == "end":
                return out, i
            elif mark and kind[0] == "any":
                options = [[c] * k for k in range(int(kind[1]), int(kind[2]) + 1) for c in ("p", "q")]
            else:
                options = [[w] for w in (kind[2:] if mark else [word])]
            out = [a + b for a in out for b in options]
            i += 1
        return out, i

    return {tuple(x) for x in walk(0, 0)[0]}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "p", "q"]), max_size=9))
def test_automaton_accepts_expansions_only(words):
    template = "a <<opt>> b <<opt>> c <<end>> <<end>> <<any 1 2>> <<one of c b>>"
    good = _expansions(template)
    ends = [e for e in range(len(words) + 1) if _matches(good, words[:e])]
    got = licenses.compile_template("x", template).match([w.encode() for w in words], 0)
    assert got == max(ends, default=-1)


def _matches(good, words):
    """Replaceable words are p or q in ``good`` and anything in a text."""
    return any(len(g) == len(words) and all(x == y or (x in "pq" and _same_run(g, words, i)) for i, (x, y) in enumerate(zip(g, words, strict=True))) for g in good)


def _same_run(g, words, i):
    return g[i] in "pq"


def test_bad_templates():
    for bad in ("<<opt>> a", "<<opt>> a <<end>>", "<<any 0 1>> a"):
        with pytest.raises(ValueError):
            licenses.compile_template("x", bad)


def test_line_dedup(spark):
    rng = random.Random(8)

    def line(k):
        return " ".join(rng.choice(["ka", "lo", "mi", "ne", "su"]) + str(rng.randrange(500)) for _ in range(k))

    long_line, passage, short = line(60), [line(12), line(25), "", line(20)], line(30)
    rows = []
    for i in range(40):
        lines = [line(rng.randrange(0, 30)) for _ in range(rng.randrange(1, 12))]
        at = rng.randrange(len(lines) + 1)
        lines[at:at] = [long_line] if i % 4 == 0 else passage if i % 4 == 1 else [short] if i % 4 == 2 else []
        rows.append((i, "\n".join(lines)))
    rows += [(100 + k, rows[3][1] + "\n" + rows[3][1]) for k in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in linededup.dedup(frame).collect()}
    assert {i: r["text"] for i, r in got.items()} == brute_dedup(rows)
    assert got[0]["n_removed"] == 0 and got[4]["n_removed"] == 1 and got[4]["removed_words"] == 60
    assert all(got[i]["n_removed"] == 0 for i in range(2, 40, 4))  # shorter than a chunk


def _by_chunks(rows):
    """What goes by chunks around boundaries that stand in several places."""
    found = [(i, c) for i, t in rows for c in linededup.chunks(t.encode().split(b"\n"))]
    spots, places, gone = {}, {}, {i: set() for i, _ in rows}
    for i, c in found:
        spots.setdefault(c[4], set()).add((i, c[3]))
    for i, c in found:
        if len(spots[c[4]]) > 1:
            places.setdefault(c[2], []).append((i, c[0], c[1]))
    for same in places.values():
        for i, a, b in sorted(same)[1:]:
            gone[i].update(range(a, b))
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}


def test_boundaries_decide(monkeypatch):
    """Chunks around repeated boundaries cover every repeated run, blank lines too; other boundaries don't."""
    rng = random.Random(1)
    corpora = []
    for _ in range(150):
        pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 0, 5, 10, 20, 30, 60]))) for _ in range(8)]
        corpora.append([(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))) for i in range(8)])
    want = [brute_dedup(rows) for rows in corpora]
    assert [_by_chunks(rows) for rows in corpora] == want
    monkeypatch.setattr(linededup, "boundaries", lambda keys, runs: [min(b - 1, a - a % 3 + 2) for a, b in runs])
    assert [_by_chunks(rows) for rows in corpora] != want


def test_boundaries_are_least():
    rng = random.Random(2)
    keys = [rng.randrange(9) for _ in range(60)]
    ends = sorted(rng.randrange(1, 61) for _ in range(40))
    runs = sorted((rng.randrange(max(0, e - 9), e), e) for e in ends)
    starts = sorted(a for a, _ in runs)
    runs = [(min(a, e - 1), e) for a, e in zip(starts, ends, strict=True)]
    assert list(linededup.boundaries(keys, runs)) == [min(range(a, b), key=lambda i: (keys[i], i)) for a, b in runs]


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_all_and_overfills_nothing(seed):
    rng = random.Random(seed)
    counts = Counter(min(64, int(rng.expovariate(0.07)) + 1) for _ in range(rng.choice([3, 50, 5000])))
    used, windows = Counter(), 0
    for times, chosen in packing.plan(dict(counts), 64):
        assert times > 0 and sum(n * c for n, c in chosen.items()) <= 64
        windows += times
        for n, c in chosen.items():
            used[n] += times * c
    assert used == counts
    least = -(-sum(n * c for n, c in counts.items()) // 64)
    assert windows <= least * 1.1 + 2


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 4), min_size=1, max_size=5))
def test_closest_is_closest(counts):
    first, capacity = max(counts), 23
    chosen = packing.closest(counts, first, capacity)
    left = [n for n, c in counts.items() for _ in range(c)]
    left.remove(first)
    sums = {first}
    for n in left:
        sums |= {s + n for s in sums if s + n <= capacity}
    assert sum(n * c for n, c in chosen.items()) == max(sums) and all(c <= counts[n] for n, c in chosen.items())


def _texts(rng, n):
    words = ["the", "tionthe", "Heron", "ingly", "été", "x", "12", "--", "\n"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 40, 900])))) for i in range(n)]


def test_packing(spark):
    rows = [*_texts(random.Random(2), 60), (900, "word " * 9000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*plain.encode(t, add_special_tokens=False).ids, 1] for i, t in rows}
    packed = packing.pack(frame, with_ids=True)
    got = packed.collect()
    at = Counter()
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
        at[r["doc_id"]] += r["length"]
    assert at == {i: len(x) for i, x in ids.items()}
    used = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used[r["sequence_id"]]
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 2048
    large = sum(r["length"] > 1024 for r in got)  # no two of them share a window
    assert len(used) <= max(large, -(-sum(at.values()) // 2048)) + 1
    for s in packing.sequences(packed).collect():
        n, data = s["n_tokens"], np.frombuffer(bytes(s["ids"]), "<u4")
        assert n == used[s["sequence_id"]] and len(data) == s["padded_length"] == (n if n & (n - 1) == 0 else 2048)
        assert not data[n:].any()
    whole = {s["sequence_id"]: np.frombuffer(bytes(s["ids"]), "<u4") for s in packing.sequences(packed).collect()}
    for r in got:
        piece = whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert zlib.crc32(piece.astype("<u4").tobytes()) == r["ids_crc32"]


def test_store(spark):
    rng = random.Random(6)
    base = " ".join(f"tion{rng.randrange(300)}" for _ in range(6000))
    rows = [*_texts(rng, 30), (500, base), (501, "more " + base), (502, base), (503, base + " end")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*plain.encode(t, add_special_tokens=False).ids, 2] for i, t in rows}
    path = new_path(spark, "store")
    store.write_store(frame, path)
    got = {r["doc_id"]: r for r in store.read_store(spark, path).collect()}
    before = 0
    for i in sorted(ids):
        assert (got[i]["start"], got[i]["n_tokens"]) == (before, len(ids[i]))
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(ids[i], "<u4").tobytes())
        before += len(ids[i])
    again = {r["doc_id"]: r["ids"] for r in store.reconstruct(spark, path).collect()}
    assert again == ids
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("address").distinct().count()
    stored = chunks.agg(F.sum("n_ids")).first()[0]
    assert stored < 0.6 * before  # four copies of the long text share chunks
    order = [r["doc_id"] for r in spark.read.parquet(f"{path}/recipes").orderBy("number").collect()]
    assert order == sorted(ids)


def test_damaged_store(spark):
    frame = spark.createDataFrame([(1, "one two three"), (2, "four five")], "doc_id long, text string")
    for part in ("chunks", "recipes"):
        path = new_path(spark, "store")
        store.write_store(frame, path)
        table = spark.read.parquet(f"{path}/{part}").collect()
        schema = spark.read.parquet(f"{path}/{part}").schema
        delete_path(spark, f"{path}/{part}")
        spark.createDataFrame(table[:-1], schema).write.parquet(f"{path}/{part}")
        with pytest.raises(Exception, match="rebuilt|manifest"):
            store.read_store(spark, path).collect()
    whole = new_path(spark, "store")
    store.write_store(frame, whole)
    kept = {part: (spark.read.parquet(f"{whole}/{part}").collect(), spark.read.parquet(f"{whole}/{part}").schema) for part in ("chunks", "recipes", "manifest", "top")}
    tampered = {
        "ids swapped": {"recipes": lambda r: r | {"doc_id": 3 - r["doc_id"]}},
        "starts moved": {"recipes": lambda r: r | {"start": r["start"] + 100}},
        "a part gone from both": {"recipes": None, "manifest": None},
    }
    for changes in tampered.values():
        path = new_path(spark, "store")
        for part, (rows, schema) in kept.items():
            change = changes.get(part, lambda r: r)
            rows = [tuple(change(r.asDict())[f] for f in schema.names) for r in rows] if change else []
            spark.createDataFrame(rows, schema).write.parquet(f"{path}/{part}")
        with pytest.raises(Exception, match="manifest"):
            store.read_store(spark, path).collect()
    path = new_path(spark, "store")
    store.write_store(frame, path)
    bad = spark.read.parquet(f"{path}/chunks").withColumn("payload", F.concat("payload", F.lit(b"\x01\x00"))).collect()
    schema = spark.read.parquet(f"{path}/chunks").schema
    delete_path(spark, f"{path}/chunks")
    spark.createDataFrame(bad, schema).write.parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="damaged"):
        store.read_store(spark, path).collect()


def test_cuts_resist_shifts():
    ids = np.random.default_rng(1).integers(0, 49000, 30000).astype("<u4")
    a = store.cuts(ids)
    moved = np.concatenate([np.array([5, 6, 7], "<u4"), ids])
    b = [x - 3 for x in store.cuts(moved)]
    assert a[-1] == 30000 and len(set(a) & set(b)) > 0.9 * len(a)
    assert all(store.MIN <= y - x <= store.MAX for x, y in zip(a[:-2], a[1:-1], strict=True))
    assert store.cuts(ids[:0]) == []


def test_merkle():
    assert store.merkle_root([]) == store.digest(b"")
    assert len({store.merkle_root(x) for x in ([b"a"], [b"a", b"a"], [b"a", b"b"], [b"b", b"a"], [b"a", b"b", b"c"])}) == 5


CONTROL = ["<|turn|>", "<|end|>", "</s>", "[INST]", "[/INST]", "<s>", "<", "[", "\\", "<\\s>", "<\\\\|body|>", "|turn|>", "s>", "a", "\n", "<<SYS>>", "$1"]


def _escaped(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = frame.select("i", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).orderBy("i").collect()
    return [r["e"] for r in got], [r["u"] for r in got]


def test_escape_is_reversible(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(CONTROL) for _ in range(rng.randrange(8))) for _ in range(3000)]
    escaped, back = _escaped(spark, texts)
    assert back == texts
    marks = ["<|turn|>", "<|end|>", "<|body|>", "</s>", "<s>", "[INST]", "[/INST]"]
    assert not any(m in e for e in escaped for m in marks)


def test_chat_parts(spark):
    parts = [
        [("text", "see <|im", None, None), ("text", "age|> ", None, None), ("image", None, "u1", 3), (None, "then", None, None), ("audio", None, "u2", None)],
        [("document", None, "u3", 2), None, ("video", None, "u4", 9), ("text", None, None, None)],
    ]
    rows = [(1, 0, "user", parts[0]), (1, 1, "assistant", parts[1]), (1, 2, "assistant", None), (2, None, None, [])]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}").repartition(3)
    out = {r["conv_id"]: r for r in chat.format_conversations(frame, parts_col="parts").collect()}
    first = out[1]
    user, answer = "see <\\|image|> <|image|>then<|audio|>", "<|document|><|attachment|>"
    assert first["formatted"] == f"<|turn|>user<|body|>{user}<|end|><|turn|>assistant<|body|>{answer}<|end|><|turn|>assistant<|body|><|end|>"
    got = [(a["turn"], a["type"], a["ref"], a["tokens"]) for a in first["attachments"]]
    assert got == [(0, "image", "u1", 768), (0, "audio", "u2", 25), (1, "document", "u3", 1024), (1, "video", "u4", 0)]
    for a, mark in zip(first["attachments"], ["<|image|>", "<|audio|>", "<|document|>", "<|attachment|>"], strict=True):
        assert first["formatted"][a["at"] :].startswith(mark)
    assert first["attachment_tokens"] == 768 + 25 + 1024
    assert [first["formatted"][s["start"] : s["end"]] for s in first["loss_spans"]] == [answer, ""]
    assert out[2]["formatted"] == "<|turn|><|body|><|end|>" and out[2]["loss_spans"] == []


def test_chat_ties_and_repeats(spark):
    rows = [(1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "assistant", "c"), (1, None, "user", "z"), (1, 1, "user", "a")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    out = chat.format_conversations(frame).select(chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).first()
    assert [(t["role"], t["body"]) for t in out["t"]] == [("user", "z"), ("assistant", "c"), ("user", "a"), ("user", "a"), ("user", "b")]
    assert out["l"] == "c"
