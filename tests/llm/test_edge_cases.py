"""Every operator over nulls, empty and very long texts, repeated rows, empty tables, and clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkweave.llm import chat, decontaminate, licenses, linededup, packing, quality, rules, simhash, store, toxicity
from sparkweave.storage import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHING = ["k1", "fp", "ws", "h", "row", "k", "n", "start", "length", "label", "host", "score", "found", "pos", "term", "ids"]
LONG = "\n".join(f"line {i} of a very long text under the MIT License" for i in range(6000))
ROWS = [
    (1, "One two three four.\nFive six seven.", "en", "a", 0),
    (1, "One two three four.\nFive six seven.", "en", "a", 0),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (None, "A text without an id", "en", "b", 0),
    (None, None, None, "b", None),
    (4, " \n\t ", "de", None, 0),
    (5, LONG, "en", "a", 0),
    (5, "Another text of document five, ÄÖ İstanbul 東京   x²", "xx", "c", 0),
    (6, "\x00\x1c control </s> <|turn|> [INST]", "xx", "c", 0),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHING})


def benchmark(spark, rows=((7, "very long text under the mit license line 9"), (None, "nothing to see here at all, in any text"), (8, None), (9, ""))):
    return spark.createDataFrame(list(rows), "item_id long, text string").withColumn("doc_id", F.lit("clash")).withColumn("k1", F.lit(1))


def labels(spark, rows=((1, 1, 0), (1, 0, 0), (5, 0, 1), (5, None, None), (None, 1, 1), (77, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


def turns(frame):
    return frame.select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("assistant").alias("role"), "text", *CLASHING)


OPERATORS = {
    "quality": lambda s, d: quality.classify(d, labels(s)),
    "quality_keep": lambda s, d: quality.keep(d, quality.learn(d, labels(s))),
    "chat": lambda s, d: chat.format_conversations(turns(d)),
    "packing": lambda s, d: packing.pack(d),
    "decontaminate": lambda s, d: decontaminate.decontaminate(d, benchmark(s)),
    "drop_contaminated": lambda s, d: decontaminate.drop_contaminated(d, benchmark(s)),
    "licenses": lambda s, d: licenses.scan(d),
    "rules": lambda s, d: rules.judge(d),
    "store": lambda s, d: store.round_trip(d),
    "linededup": lambda s, d: linededup.dedup(d),
    "linededup_cleaned": lambda s, d: linededup.cleaned(d),
    "toxicity": lambda s, d: toxicity.classify(d, labels(s)),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "simhash_keep": lambda s, d: simhash.keep_one(d),
}
#: Operators with a row for each row that they get.
WHOLE = ["quality", "decontaminate", "licenses", "rules", "store", "linededup", "linededup_cleaned", "toxicity", "simhash"]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_hard_rows(spark, name):
    found = OPERATORS[name](spark, docs(spark)).collect()
    if name in WHOLE:
        assert len(found) == len(ROWS)
        ids = sorted((next(r[c] for c in ("doc_id", "id") if c in r.__fields__) for r in found), key=str)
        assert ids == sorted((r[0] for r in ROWS), key=str)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_no_rows(spark, name):
    assert OPERATORS[name](spark, docs(spark, [])).collect() == []


def test_results_of_hard_rows(spark):
    d = docs(spark)
    scored = toxicity.classify(d, labels(spark)).collect()
    assert all(0 <= r["score"] <= 1 for r in scored)
    judged = {r["doc_id"]: r for r in rules.judge(d).collect() if r["doc_id"] in (2, 3, 4)}
    assert all(r["n_words"] == 0 and r["base_failed"] and not r["kept"] for r in judged.values())
    pieces = [r for r in packing.pack(d).collect() if r["doc_id"] in (2, 3)]
    assert [(r["length"], r["doc_tokens"]) for r in pieces] == [(1, 1), (1, 1)]
    hit = {r["doc_id"]: r for r in decontaminate.decontaminate(d, benchmark(spark)).collect()}
    assert hit[2]["n_words"] == 0 and not hit[3]["contaminated"]
    marks = [r["component"] for r in simhash.near_duplicates(d).collect() if r["fp"] == 0]
    assert set(marks) == {2} and len(marks) == 4
    kept = simhash.keep_one(d).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] in (1, 2, 3, 4)) == [1, 2]
    assert kept[0].__fields__ == d.columns
    clean = linededup.cleaned(d)
    assert clean.columns == d.columns and {r["doc_id"]: r["text"] for r in clean.collect()}[2] is None


def test_no_labels_and_no_benchmark(spark):
    d, none = docs(spark), labels(spark, [])
    assert {r["score"] for r in quality.classify(d, none).collect()} == {0.5}
    assert {r["score"] for r in toxicity.classify(d, none).collect()} == {0.0}
    assert not any(r["contaminated"] for r in decontaminate.decontaminate(d, benchmark(spark, [])).collect())


def test_text_keys(spark):
    """Ids can be strings."""
    d = docs(spark).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    assert simhash.near_duplicates(d).where("id = 'd3' AND component = 'd2'").count() == 1
    assert linededup.dedup(d).count() == len(ROWS)
    assert store.round_trip(d).count() == len(ROWS)
    assert rules.judge(d).count() == len(ROWS)


@pytest.mark.parametrize("rows", [ROWS, []])
def test_pipeline_stages(spark, rows):
    folder = new_path(spark, "tables")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    benchmark(spark).write.parquet(f"{folder}/benchmark.parquet")
    labels(spark).write.parquet(f"{folder}/labels.parquet")
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, folder)
        if name != "packing":
            assert out.columns == frame.columns, name
        out.collect()
    corpus_pipeline.run(spark, folder).collect()
