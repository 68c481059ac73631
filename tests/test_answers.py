import pytest
from pyspark.sql import functions as F

from lectern.operators import answers as A
from lectern.operators.chunks import chunk_documents
from lectern.operators.index import build_index
from lectern.operators.models import model_stage
from lectern.plans.answering import answer_all, answer_dialogs
from lectern.schemas import ANSWER
from lectern.session import materialise

VISA = " ".join(["visa form fee card resident apply green status"] * 4)
BOATS = " ".join(["boat sail wind harbour mast anchor deck tide"] * 4)


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(
        [("v", "Visas", VISA + "\nThe fee of the visa is ten."), ("w", None, VISA + " green"), ("x", "X", VISA + " card card")],
        "url string, page_title string, content string",
    )
    return materialise(build_index(chunk_documents(docs)), "index")


def test_routing(spark):
    verdicts = ["Yes.", "no", "I don't know", None, "YES", "yes and no"]
    df = spark.createDataFrame(list(enumerate(verdicts)), "conv_id int, question_is_relevant string")
    yes, no = A.route(df)
    assert {r.conv_id for r in yes.collect()} == {0, 4, 5}
    refused = A.refuse(no).collect()
    assert {r.conv_id for r in refused} == {1, 2, 3}
    assert all(r.result == A.REFUSAL and r.sources == [] for r in refused)


def test_gate_marks_and_ties(spark):
    centroid = spark.createDataFrame([([1.0, 0.0],)], "centroid array<double>")
    rows = [(1, [1.0, 0.0], None), (2, [0.6, 0.8], False), (3, [1.0, 0.0], True), (4, [0.0, 1.0], False), (5, None, None)]
    df = spark.createDataFrame(rows, "id int, embedding array<float>, bad boolean")
    got = {r.id: r.question_is_relevant for r in A.topic_gate(df, centroid, 0.6, inappropriate="bad").collect()}
    assert got == {1: "yes", 2: "yes", 3: "no", 4: "no", 5: None}


DOC = "array<struct<rk: int, text: string, url: string, page_title: string>>"


def test_context_and_sources(spark):
    df = spark.createDataFrame([([(1, "a", "u", "T"), (2, "b", "v", None)],)], f"docs {DOC}")
    r = df.select(A.format_context(F.col("docs")), A.source_urls(F.col("docs"))).first()
    assert r[0] == "a\n\nb"
    assert r[1] == ["u page:T", "v page:None"]


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ("red fish", "a red fish"),
        ("blue", "blue one"),
        ("nothing shared", "top first"),
        ("fish", "fish here"),
        ("", "top first"),
    ],
)
def test_extractive_answer(spark, question, want):
    docs = [(1, "top first\nblue one\nfish here", "u", "T"), (2, "a red fish\nblue two", "v", "T")]
    df = spark.createDataFrame([(question, docs)], f"question string, docs {DOC}")
    assert df.select(A.answer_extractive(F.col("question"), F.col("docs"))).first()[0] == want


def turns_of(spark, dialogs):
    rows = [(c, i, role, text) for c, said in dialogs.items() for i, (role, text) in enumerate(said)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_answer_all(spark, index):
    turns = turns_of(
        spark,
        {
            1: [("user", "what is the visa fee")],
            2: [("user", "boat sail wind harbour")],
            3: [("user", "green card"), ("assistant", "status of a resident"), ("user", "visa form fee apply status")],
            4: [("user", "???")],
        },
    )
    done = answer_all(turns, index, k=2, threshold=0.3)
    assert A.answer_struct(done).schema["answer"].dataType.simpleString() == ANSWER.simpleString()
    got = {r.conv_id: r for r in done.collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1].result == "The fee of the visa is ten." and len(got[1].sources) == 2
    for off in (2, 4):
        assert got[off].result == A.REFUSAL and got[off].sources == []
    assert got[3].result.startswith("visa form fee")


def test_answer_all_checks_the_model(spark, index):
    turns = turns_of(spark, {1: [("user", "visa")]})
    with pytest.raises(ValueError):
        answer_all(turns, index, dim=32)


def test_answer_dialogs_with_models_of_the_user(spark, index):
    """Gold pairs: a follow-up is on topic, a poem is not."""
    dialogs = spark.createDataFrame(
        [
            (1, [("user", "What is the purpose of the manual?"), ("assistant", "visa rules"), ("user", "Do you have more details?")]),
            (2, [("user", "What is the purpose of the manual?"), ("assistant", "visa rules"), ("user", "Write me a song.")]),
            (3, [("user", "visa fee?")]),
        ],
        "conv_id long, messages array<struct<role: string, content: string>>",
    )
    models = {
        "gate": lambda prompts: ["No" if "song" in p.rsplit("New message: ", 1)[1] else "Yes" for p in prompts],
        "rewrite": lambda prompts: ["visa form" for _ in prompts],
        "answer": lambda prompts: ["answer to " + p.rsplit('New message from "user": ', 1)[1].split("\n")[0] for p in prompts],
    }
    got = {r.conv_id: r for r in answer_dialogs(dialogs, index, models, k=4).collect()}
    assert got[1].result == "answer to Do you have more details?" and len(got[1].sources) == 3
    assert got[2].result == A.REFUSAL and got[2].sources == []
    assert got[3].result == "answer to visa fee?"
    without = {k: v for k, v in models.items() if k != "rewrite"}
    assert answer_dialogs(dialogs, index, without).count() == 3
    assert answer_dialogs(dialogs, index, models, always_rewrite=True).count() == 3


def test_model_stage(spark):
    df = spark.range(10).withColumn("p", F.col("id").cast("string"))
    out = model_stage(df, lambda xs: [[float(x), 0.0] for x in xs], "p", "v", "array<float>")
    assert out.schema["v"].dataType.simpleString() == "array<float>"
    assert {r.id: r.v for r in out.collect()} == {i: [float(i), 0.0] for i in range(10)}
    with pytest.raises(Exception, match="outputs for"):
        model_stage(df, lambda xs: xs[1:], "p", "v").collect()
