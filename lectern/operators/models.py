"""The hook for user-supplied models."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import n_tokens
from ..session import materialise

#: Tokens in a batch, with each input padded to the longest.
BUDGET = 16_384


def model_stage(
    df: DataFrame,
    model: Callable[[list], Iterable],
    input_col: str,
    output_col: str,
    output_type: str = "string",
) -> DataFrame:
    """Add ``output_col`` = model(input_col), one call per Arrow batch.

    The callable gets the batch's input values as a list and returns as many
    outputs. It is sent to the tasks as it is; no model is shipped. Only the
    input column leaves the JVM.
    """
    arrow = to_arrow_type(T.DataType.fromDDL(output_type))

    @F.arrow_udf(output_type)
    def run(values: pa.Array) -> pa.Array:
        inputs = values.to_pylist()
        outputs = list(model(inputs)) if inputs else []
        if len(outputs) != len(inputs):
            raise ValueError(f"model returned {len(outputs)} outputs for {len(inputs)} inputs")
        return pa.array(outputs, type=arrow)

    # a deterministic function could be moved below a join or filter, and then be called for rows that are not wanted
    return df.withColumn(output_col, run.asNondeterministic()(F.col(input_col)))


def batches(costs: list[int], budget: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of inputs, given by their costs, that fit the budget when each costs as much as the largest; one input at least."""
    begin, most = 0, 0
    for at, cost in enumerate(costs):
        if at > begin and max(most, cost) * (at + 1 - begin) > budget:
            yield begin, at
            begin, most = at, 0
        most = max(most, cost)
    if costs:
        yield begin, len(costs)


def model_batches(
    df: DataFrame,
    model: Callable[[list], Iterable],
    input_col: str,
    output_col: str,
    output_type: str = "string",
    cost: Column | None = None,
    budget: int = BUDGET,
) -> DataFrame:
    """``model_stage`` for inputs that repeat and differ in length: the same rows, with fewer and fuller calls.

    Each distinct input is sent once, NULL included, and its output is joined
    to the rows that have it. Inputs of like ``cost``, by default their tokens,
    are sent together, as many as fit ``budget`` when each is padded to the
    longest. The outputs are written before they are joined, so no later
    failure asks the model again.
    """
    arrow = to_arrow_type(T.DataType.fromDDL(output_type))
    price = F.coalesce(n_tokens(F.col("input")) if cost is None else cost, F.lit(0)).cast("long")
    # rows that have one input combine before the shuffle
    inputs = df.select(F.col(f"`{input_col}`").alias("input")).distinct()
    # equal costs are dealt by hash, so no range is one cost that most inputs have
    priced = inputs.select("input", price.alias("cost"), F.xxhash64("input").alias("place"))
    ordered = priced.repartitionByRange("cost", "place").sortWithinPartitions("cost", "place").select("input", "cost")
    kind = df.schema[input_col].dataType
    schema = T.StructType([T.StructField("input", kind), T.StructField("output", T.DataType.fromDDL(output_type))])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            values = batch.column(0).to_pylist()
            outputs: list = []
            for begin, end in batches(batch.column(1).to_pylist(), budget):
                some = list(model(values[begin:end]))
                if len(some) != end - begin:
                    raise ValueError(f"model returned {len(some)} outputs for {end - begin} inputs")
                outputs += some
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(outputs, type=arrow)], ["input", "output"])

    made = materialise(ordered.mapInArrow(run, schema), "outputs")
    rows, known = df.select(F.struct("*").alias("row"), F.col(f"`{input_col}`").alias("input")).alias("rows"), made.alias("known")
    joined = rows.join(known, F.col("rows.input").eqNullSafe(F.col("known.input")))
    return joined.select("rows.row.*", F.col("known.output").alias(output_col))
