import pytest
from pyspark.sql import functions as F

from lectern.functions import prompts as T
from lectern.operators import dialog as D
from lectern.operators.embedding import embed_text

TURNS = [
    (1, 0, "user", "only one"),
    (2, 0, "user", "first"),
    (2, 1, "assistant", "it's \"quoted\"\n\\end"),
    (2, 2, "user", "it's last"),
    (3, 0, "system", "be brief"),
    (3, 1, "user", "hello"),
    (3, 2, "assistant", "good bye"),
]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")


@pytest.fixture(scope="module")
def dialogs(spark):
    by = {}
    for c, _, role, text in TURNS:
        by.setdefault(c, []).append((role, text))
    return spark.createDataFrame(
        list(by.items()), "conv_id long, messages array<struct<role: string, content: string>>"
    )


def test_question_and_history(turns):
    q = {r.conv_id: (r.turn, r.role, r.question) for r in D.extract_question(turns).collect()}
    assert q == {1: (0, "user", "only one"), 2: (2, "user", "it's last"), 3: (2, "assistant", "good bye")}
    h = {(r.conv_id, r.turn) for r in D.extract_history(turns).collect()}
    assert h == {(2, 0), (2, 1), (3, 0), (3, 1)}


def test_last_user_question(turns):
    q = {r.conv_id: r.question for r in D.extract_question(turns, last_user=True).collect()}
    assert q == {1: "only one", 2: "it's last", 3: "hello"}
    h = {(r.conv_id, r.turn) for r in D.extract_history(turns, last_user=True).collect()}
    assert h == {(2, 0), (2, 1), (3, 0)}


def test_search_query(turns, dialogs):
    flat = {r.conv_id: r.search_query for r in D.search_query(turns).collect()}
    assert flat == {1: "only one", 2: "first it's last", 3: "hello good bye"}
    rows = dialogs.select("conv_id", D.search_text_of(F.col("messages")).alias("q")).collect()
    assert {r.conv_id: r.q for r in rows} == flat


def test_state_vector_is_the_vector_of_the_search_query(turns):
    state = D.dialog_state(turns)
    asked = D.search_query(turns).withColumn("direct", embed_text(F.col("search_query")))
    for r in state.join(asked, "conv_id").collect():
        assert r.embedding == r.direct


def test_printed_history_equals_python(dialogs):
    for r in dialogs.select("messages", D.history_text_of(F.col("messages")).alias("h")).collect():
        assert r.h == str([{"role": m.role, "content": m.content} for m in r.messages[:-1]])


@pytest.mark.parametrize("template", ["rewrite", "rewrite_knn", "gate"])
def test_prompts_equal_the_filled_template(turns, dialogs, template):
    got = {r.conv_id: r.prompt for r in D.prompts(turns, template).collect()}
    for r in dialogs.collect():
        said = str([{"role": m.role, "content": m.content} for m in r.messages[:-1]])
        want = T.TEMPLATES[template].format(chat_history=said, question=r.messages[-1].content, subject=T.SUBJECT)
        assert got[r.conv_id] == want


def test_answer_prompt_only_for_dialogs_with_context(spark, turns):
    context = spark.createDataFrame([(2, "some\n\ntexts")], "conv_id long, context string")
    rows = D.prompts(turns, "answer", extra=context).collect()
    assert [r.conv_id for r in rows] == [2]
    assert "some\n\ntexts" in rows[0].prompt and "it's last" in rows[0].prompt


def test_a_template_of_the_user(spark):
    df = spark.createDataFrame([("q",)], "q string")
    assert df.select(T.render("<{x}|{y}>", x=F.col("q"), y="z")).first()[0] == "<q|z>"
    with pytest.raises(KeyError):
        T.render("<{x}>")


@pytest.mark.parametrize("scale, shift", [(1, 0), (86_400_000, 1_700_000_000_000)])
def test_a_dialog_is_one_row_whatever_its_turns(spark, scale, shift):
    n = 2035
    said = [(7, shift + i * scale, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(n)]
    turns = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    history = str([{"role": r, "content": t} for _, _, r, t in said[:-1]])
    prompt = T.GATE.format(chat_history=history, question=f"m{n - 1}", subject=T.SUBJECT)
    assert [tuple(r) for r in D.prompts(turns, "gate").collect()] == [(7, prompt)]
    query = " ".join(f"m{i}" for i in range(0, n, 2))
    assert [tuple(r) for r in D.search_query(turns).collect()] == [(7, query)]
