"""Questions come back with other numbers, names and units; other texts do not."""

from llm_rows import rows

from lectern.llm import decontaminate

ITEM = (
    "Last summer a farmer called Anna sold 12 baskets of apples to the old baker, and Anna carried every basket "
    "for 3 km along the dusty road while her brother counted 12 coins twice."
)
SWAPPED = ITEM.replace("Anna", "Boris").replace("12", "57").replace("km", "miles").replace("3", "8")


def found(frame, spark, *texts, items=(ITEM,)):
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.find(frame(rows(*texts)), benchmark).collect()}


def test_copies_and_exchanges(frame, spark):
    text = "Some words before. {} And some words after it, as texts have them."
    mixed_up = SWAPPED.replace("57 coins", "58 coins").replace("Boris carried", "Clara carried")
    got = found(frame, spark, text.format(ITEM), text.format(SWAPPED), text.format(ITEM.lower()), text.format(mixed_up), text)
    assert {d for d, _ in got} >= {0, 1}
    assert got[0, 0].exchanged == 0 and got[0, 0].matched >= got[0, 0].windows - 1
    assert got[1, 0].exchanged == 4
    assert (3, 0) not in got and (4, 0) not in got


def test_part_of_a_question(frame, spark):
    part = " ".join(ITEM.split()[3:17])
    assert set(found(frame, spark, "so " + part, " ".join(ITEM.split()[3:12]))) == {(0, 0)}


def test_placeholders_alone_are_no_evidence(frame, spark):
    numbers = " ".join(map(str, range(40)))
    assert not found(frame, spark, numbers, items=(numbers, "7 km"))


def test_short_items(frame, spark):
    got = found(frame, spark, "Why is the sky blue today?", "the sky", items=("why is the sky blue",))
    assert set(got) == {(0, 0)}


def test_repeated_and_null_rows(frame, spark):
    docs = frame(rows(ITEM, None, "") + rows(ITEM, "clean"))
    benchmark = spark.createDataFrame([(1, ITEM), (1, ITEM), (None, None)], "item_id long, text string")
    got = decontaminate.find(docs, benchmark).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(0, 1)]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, benchmark).collect()) == [1, 1, 2]


def test_both_ways_to_join_agree(frame, spark, monkeypatch):
    texts = [ITEM, SWAPPED, "clean text of no interest at all in any way"]
    sent = found(frame, spark, *texts)
    monkeypatch.setattr(decontaminate, "SENT_WINDOWS", 0)
    assert found(frame, spark, *texts) == sent


def test_no_python_in_the_plan(frame, spark):
    benchmark = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    plan = decontaminate.find(frame(rows(ITEM)), benchmark)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_verbatim_copies_poor_in_literals(frame, spark):
    """Copies whose windows are nearly all placeholders are found by their plain words, with other values they are not."""
    items = ("What is 12 times 34?", "Mix 2 cups and 3 grams, 5 cups and 7 grams, 11 cups and 13 grams, 17 cups and 19 grams.", "The Old Man And The Sea By Ernest Hemingway In Havana")
    text = "Some words before it. {} And some words after."
    others = "What is 13 times 35?", items[1].replace("2", "4").replace("7", "8").replace("cups", "jars")
    assert set(found(frame, spark, *[text.format(x) for x in [*items, *others]], items=items)) == {(0, 0), (1, 1), (2, 2)}


def test_tables_of_numbers_in_the_corpus(frame, spark):
    numbers = " ".join(map(str, range(40)))
    benchmark = spark.createDataFrame([(0, numbers)], "item_id long, text string")
    docs = frame(rows("so " + numbers, "so 5 6 7 8 9 10 11 1 2"))
    assert [r.doc_id for r in decontaminate.find(docs, benchmark, bare=True).collect()] == [0]
    assert [r.doc_id for r in decontaminate.clean(docs, benchmark).collect()] == [1]


def test_layout_does_not_hide_a_copy(frame, spark):
    item = "my little brother once asked whether kind old Anna would come to tea"
    texts = item.replace(" Anna", "\nAnna"), item.upper(), item.lower(), item.replace(" Anna", "  Anna")
    assert {d for d, _ in found(frame, spark, *texts, items=(item,))} == {0, 1, 2, 3}


def test_one_edited_value_in_a_long_copy(frame, spark):
    tail = " Then they went home by the river and spoke of nothing else until the evening came."
    edited = (ITEM + tail).replace("12 coins", "13 coins")
    assert set(found(frame, spark, edited, items=(ITEM + tail,))) == {(0, 0)}


def test_names_at_beginnings_and_numbers_of_two_things(frame, spark):
    items = ("Tom has 5 marbles. Sam gives him 3 more.", "Mix 2 cups of flour and 2 eggs in the old bowl, then wait for an hour.")
    texts = (
        "So: Anna has 8 marbles. Lily gives him 7 more. The end.",
        "Mix 3 cups of flour and 4 eggs in the old bowl, then wait for an hour.",
        "Anna has 8 marbles. Lily keeps them in a box at home for the winter.",
    )
    assert set(found(frame, spark, *texts, items=items)) == {(0, 0), (1, 1)}


def planted(rng):
    """Questions with names at beginnings and within, numbers and units; each comes back in a text with others."""
    people, units = ["Anna", "Boris", "Clara", "Dmitri", "Elena", "Farid", "Grete", "Hugo"], ["kg", "miles", "minutes", "liters"]
    verbs, things = ["carries", "sells", "counts", "paints", "finds", "hides"], ["apples", "bricks", "letters", "lamps", "ropes", "stones"]
    items, texts = [], []
    for _ in range(60):
        v, t, w = rng.sample(verbs, 2), rng.sample(things, 2), rng.sample("quickly slowly gladly sadly rarely often".split(), 2)

        def question():
            a, b = rng.sample(people, 2)
            n, m, u = rng.randint(2, 99), rng.randint(2, 99), rng.choice(units)
            return (
                f"{a} {v[0]} {n} {t[0]} {w[0]} on the way to the market. {b} {v[1]} {m} {t[1]} there and walks for {n} {u} {w[1]}. "
                f"How many {t[0]} does {a} have at the end?"
            )

        items.append(question())
        texts.append(f"Some talk before it came up. {question()} And so they went on.")
    return items, texts


def test_recall_on_other_parameters(frame, spark):
    """Names stand in several places of a question; the same texts with other words in between are left alone."""
    import random

    items, texts = planted(random.Random(7))
    got = found(frame, spark, *texts, items=items)
    assert sum((i, i) in got for i in range(60)) >= 54
    clean = [" ".join(w if k % 4 else "other" for k, w in enumerate(t.split())) for t in texts]
    assert not found(frame, spark, *clean, items=items)


def test_sql_agrees_on_hard_cases(frame, spark):
    """The SQL of the query over a table of copies, exchanges, tables of numbers, layouts and beginnings."""
    import random

    import duckdb

    from lectern.llm.oracle import OP9

    items, texts = planted(random.Random(8))
    items = [*items[:10], ITEM, "What is 12 times 34?", "Tom has 5 marbles. Sam gives him 3 more.", " ".join(map(str, range(40))), "the sky", "", "...", "A B C D E F G H I"]
    texts = [*texts[:10], SWAPPED, ITEM.upper(), ITEM.replace(" Anna", "\nAnna"), "so What is 12 times 34? yes", "Anna has 8 marbles. Lily gives him 7 more.",
             "so " + " ".join(map(str, range(5, 30))), "Blue is The Sky", "", "a b c d e f g h i", *items, "I I I am. Who? WHO-ELSE 3.Anna"]
    docs = frame(rows(*texts))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.find(docs, benchmark, bare=True).groupBy("doc_id", "item_id").agg({"matched": "max", "windows": "max", "exchanged": "min"})
    got = sorted((r.doc_id, r.item_id, r["max(matched)"], r["max(windows)"], r["min(exchanged)"]) for r in got.collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", list(enumerate(items)))
    want = con.execute(f"SELECT doc_id, item_id, matched, windows, exchanged FROM ({OP9})").fetchall()
    assert got == sorted(want) and len(got) > 25
