from pyspark.sql import functions as F

from tidemark.llm.decontaminate import contaminated, decontaminate, template

ITEM = "A farmer sells 12 crates of apples to Anna for 3.5 dollars each and then buys 12 more kg of pears from Tom near the old river mill"
FILL = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))


def texts():
    swap = ITEM.replace("12", "40").replace("Anna", "Maria").replace("3.5", "7,25")
    broken = ITEM.replace("12 crates", "40 crates").replace("12 more", "99 more").replace("to Anna", "to Maria")
    return [(1, f"{FILL} {ITEM}. {FILL}"), (2, f"{FILL}\n{swap}\n"), (3, FILL), (4, None), (5, ""), (6, ITEM[:60]), (7, ITEM.upper() + " " + FILL * 50), (None, ITEM), (9, ITEM), (9, ITEM), (10, broken)]


def frames(spark):
    docs = spark.createDataFrame([(i, t, 0.5, "k") for i, t in texts()], "doc_id long, text string, coverage double, h string")
    items = spark.createDataFrame([(1, ITEM, "q"), (2, "short one", "q"), (3, None, "q"), (4, "x " * 20, "q")], "item_id long, text string, tok string")
    return docs, items


def test_finds_copies_and_new_parameters(spark):
    docs, items = frames(spark)
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, items).collect()}
    assert {(1, 1), (2, 1), (9, 1), (None, 1)} <= got
    assert not {d for d, _ in got} & {3, 4, 5, 6}
    left = sorted(r["doc_id"] for r in decontaminate(docs, items).select("doc_id").collect())
    assert {3, 4, 5, 6} <= set(left) and not {1, 2, 9, None} & set(left)
    assert decontaminate(docs, items).columns == docs.columns


def test_slots(spark):
    docs, items = frames(spark)
    same = {r["doc_id"]: r["consistency"] for r in contaminated(docs, items).collect()}
    assert same[2] == 1.0 and same[1] == 1.0
    one = spark.range(1).select(template(F.lit("It costs 3.5 kg, said Bob of 7 x"), True).alias("v"), template(F.lit("It costs 3.5 kg, said Bob of 7 x"), False).alias("t")).first()
    assert len(one["v"]) == len(one["t"]) and "" in one["t"] and "bob" in one["v"] and "kg" in one["v"]


def test_empty(spark):
    docs, items = frames(spark)
    assert contaminated(docs.limit(0), items).count() == 0 and contaminated(docs, items.limit(0)).count() == 0
    assert decontaminate(docs, items.limit(0)).count() == docs.count()


def test_each_occurrence_is_judged(spark):
    one = ITEM.replace("12", "40").replace("Anna", "Maria").replace("3.5", "7,25")
    two = ITEM.replace("12", "55").replace("Anna", "Paula").replace("3.5", "8").replace("Tom", "Emil")
    three = ITEM.replace("12", "77").replace("Anna", "Berta").replace("3.5", "9").replace("Tom", "Otto")
    part = lambda a, b: f"how many of the {a} blue marbles are left after {b} of them were given away"
    twice = f"{part(12, 5)} and {part(30, 9)}"
    docs = spark.createDataFrame([(1, f"{one}. {two}. {three}"), (2, f"{FILL} {twice} {FILL}"), (3, f"{ITEM} {FILL} {one} {FILL} {two}"), (4, FILL)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, twice)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(docs, items).collect()} == {(1, 1), (2, 2), (3, 1)}


def test_items_without_windows(spark):
    numbers = "Compute 3 + 4 + 5 + 6 + 7 and 8 + 9 + 10 + 11"
    docs = spark.createDataFrame([(1, f"{FILL} so, {numbers}. {FILL}"), (2, f"{FILL} {numbers.replace('9', '2')} {FILL}"), (3, f"{FILL}\nWhat is 7 times 8?\n{FILL}"), (4, "what is 7 times 9"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, numbers), (2, "What is 7 times 8?"), (3, ""), (4, None), (5, ITEM)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["coverage"]) for r in contaminated(docs, items).collect()} == {(1, 1, 1.0), (3, 2, 1.0)}
    assert sorted(r["doc_id"] for r in decontaminate(docs, items).collect()) == [2, 4, 5]
