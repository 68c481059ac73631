import pytest

from lectern.operators.models import batches, model_batches, model_stage


def test_batches_fit_the_budget():
    costs = [1, 1, 2, 3, 3, 5, 9, 40]
    cut = list(batches(costs, 10))
    assert [i for a, b in cut for i in range(a, b)] == list(range(8))
    assert all((b - a) * max(costs[a:b]) <= 10 or b - a == 1 for a, b in cut)
    assert cut == [(0, 3), (3, 5), (5, 6), (6, 7), (7, 8)] and list(batches([], 10)) == []


def test_each_distinct_prompt_is_sent_once_in_batches_of_like_length(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def model(texts):
        import os
        import uuid

        with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
            f.write("\n".join(str(len((t or "").split())) + " " + (t or "NULL")[:20] for t in texts))
        return [t and t[::-1] for t in texts]

    rows = [(i, f"{i % 37} " + "word " * (i % 37), i) for i in range(500)] + [(-1, None, 0), (-2, None, 0), (-3, "", 0)]
    df = spark.createDataFrame(rows, "id int, prompt string, output int")
    got = model_batches(df, model, "prompt", "reply", budget=100)
    assert got.columns == ["id", "prompt", "output", "reply"]
    want = model_stage(df, lambda ts: [t and t[::-1] for t in ts], "prompt", "reply")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    calls = [f.read_text().split("\n") for f in log.iterdir()]
    sent = [line.split(" ", 1)[1] for call in calls for line in call]
    assert len(sent) == 37 + 2 and len(calls) < 30
    for call in calls:
        sizes = [int(line.split()[0]) for line in call]
        assert len(sizes) == 1 or len(sizes) * max(sizes) <= 100


def test_a_wrong_number_of_outputs_is_an_error(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string")
    with pytest.raises(Exception, match="model returned"):
        model_batches(df, lambda ts: [], "t", "r").collect()
    assert model_batches(df.limit(0), lambda ts: ts, "t", "r").count() == 0
