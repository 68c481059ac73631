"""Columns whose names operators might use themselves come back as they went in; many labels are no reason to stop."""

import corpus_pipeline
from lectern.llm import decontaminate, jaccard, langid, mixing, sharding

NAMES = "doc_id long, text string, lang string, source string, n_chars long, __id long, __turn long, __group long, __print long, row string, print long, slot int, found string, rows int"


def documents(spark):
    words = "the and of to in that was with house water green stone winter letter under river".split()
    made = [(i, " ".join(words[(i * 7 + k * k) % 16] for k in range(40 + i)), "en", "ab"[i % 2], 1, 10 + i, 20 + i, 30 + i, 40 + i, "r", 5, 6, "f", 7) for i in range(30)]
    return spark.createDataFrame(made, NAMES)


def by_id(df):
    return {r.doc_id: tuple(r) for r in df.collect()}


def test_columns_of_any_name_are_kept(spark):
    df = documents(spark)
    whole = by_id(df)
    benchmark = spark.createDataFrame([(1, "nothing of the kind is written anywhere in here at all")], "item_id long, text string")
    for made in (jaccard.representatives(df), mixing.apply(df), decontaminate.clean(df, benchmark)):
        assert made.columns == df.columns
        got = by_id(made)
        assert got and all(whole[k] == v for k, v in got.items())
    placed = sharding.assign(df, 3)
    assert placed.columns == [*df.columns, "shard"] and {k: v[:-1] for k, v in by_id(placed).items()} == whole
    named = corpus_pipeline.identify_languages(spark, df, "")
    assert named.columns == df.columns and all(whole[k] == v for k, v in by_id(named).items())


def test_many_labels(spark):
    rows = [(i, f"word{i} common text " * 3, f"l{i % 300}", "s", 1) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.fit(df)
    assert len(model) == 300 and all(n == 3 and words for _, n, words in model)
    assert langid.identify(df.where("doc_id < 20"), model).where("lang_pred = 'und'").count() == 0


def test_dictionaries_hold_words_of_whole_texts(spark):
    text = "filler " * 5000 + "zebra"
    df = spark.createDataFrame([(1, text, "x"), (2, "other", "y"), (3, None, "x"), (4, "no label", None)], "doc_id long, text string, lang string")
    assert {lang: words.split() for lang, _, words in langid.fit(df)} == {"x": [b"filler", b"zebra"], "y": [b"other"]}
