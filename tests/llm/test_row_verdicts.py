"""Stages that drop rows judge each row by its own text, also where ids are absent or repeat."""

from sparkweave.llm import decontaminate, simhash

BASE = " ".join(f"b{i}" for i in range(80))


def kept(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_one_of_each_group_of_fingerprints(spark):
    rows = [(1, BASE), (2, BASE.upper()), (2, "z alone"), (2, "an unrelated text"), (None, BASE + " "), (None, "unnamed"), (None, "unnamed")]
    found = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert kept(found) == sorted([(1, BASE), (2, "z alone"), (2, "an unrelated text"), (None, "unnamed")], key=repr)


def test_contaminated_rows_go_each(spark):
    leak = "a passage of the benchmark that has more than ten words in it"
    items = spark.createDataFrame([(7, leak)], "item_id long, text string")
    rows = [(1, "clean"), (1, "x " + leak), (None, leak + " x"), (None, "clean too"), (None, None), (2, leak), (2, None)]
    found = decontaminate.drop_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert kept(found) == sorted([(1, "clean"), (None, "clean too"), (None, None), (2, None)], key=repr)
    named = spark.createDataFrame([("a", leak), (leak, None), (None, leak)], "doc_id string, text string")
    assert kept(decontaminate.drop_contaminated(named, items)) == [(leak, None)]
