"""Extraction by an injected model: chunks in, JSON answers out, answers merged, status of every row.

The model is any function from (text, entity, name) to an answer text; it runs in Arrow batches beside the
data. Defined cases: a null or too short text is SKIPPED and never reaches the model; an answer without JSON,
or a model that raises, is an ERROR of its row only; a category outside the taxonomy becomes the fallback.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import jsons, text
from millrace.operators.windows import sorted_set

Model = Callable[[str, str, str], str]
RATES = "rates array<struct<interest_rate:string,description:string>>"


def answers(df: DataFrame, model: Model, id_col: str, text_col: str, entity: str, name: str, most: int = 8000, least: int = 50) -> DataFrame:
    """(id, chunk_no, answer, error): one row for each chunk the model was asked about."""
    parts = F.posexplode(F.when(F.length(text_col) >= least, text.chunks(F.col(text_col), most)).otherwise(F.array().cast("array<string>")))
    one = df.select(F.col(id_col).cast("long").alias(id_col), F.col(entity).alias("entity"), F.col(name).alias("name"), parts.alias("chunk_no", "chunk"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said, wrong = [], []
            for e, n, t in zip(*(b.column(c).to_pylist() for c in ("entity", "name", "chunk"))):
                try:
                    said.append(model(t, e or "", n or ""))
                    wrong.append(None)
                except Exception as x:  # noqa: BLE001 - a model may fail in any way
                    said.append(None)
                    wrong.append(f"{type(x).__name__}: {x}")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column("chunk_no"), pa.array(said, pa.string()), pa.array(wrong, pa.string())], names=[id_col, "chunk_no", "answer", "error"])

    return one.mapInArrow(run, f"`{id_col}` long, chunk_no int, answer string, error string")


def merged(said: DataFrame, id_col: str, first: list[str], lists: list[str], sets: list[str]) -> DataFrame:
    """One row an id: of the chunks' answers the first non-empty value, the joined values, the sorted sets, and rates without repeats.

    Chunks of one text are few; their answers are folded in chunk order.
    """
    schema = ", ".join([f"{c} string" for c in [*first, *lists, *sets]] + [RATES])
    one = said.withColumn("a", jsons.parse_answer(F.col("answer"), schema))
    full = lambda c: F.when(F.length(F.col(f"a.{c}")) > 0, F.col(f"a.{c}"))
    in_order = lambda v: F.transform(F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct("chunk_no", v.alias("v"))))), lambda x: x["v"])
    aggs = [F.coalesce(F.min_by(full(c), F.when(full(c).isNotNull(), F.col("chunk_no"))), F.lit("")).alias(c) for c in first]
    aggs += [F.array_join(in_order(full(c)), "; ").alias(c) for c in lists]
    aggs += [sorted_set(full(c)).alias(c) for c in sets]
    aggs += [F.array_distinct(F.flatten(in_order(F.col("a.rates")))).alias("rates"), F.count("a").alias("n_read"), F.first("error", ignorenulls=True).alias("error")]
    return one.groupBy(id_col).agg(*aggs)


def status(text_col: Column, n_read: Column, error: Column, least: int = 50) -> Column:
    """'OK', 'SKIPPED: ...' or 'ERROR: ...' of a row."""
    return (
        F.when(text_col.isNull() | (F.length(text_col) == 0), "SKIPPED: no context").when(F.length(text_col) < least, "SKIPPED: insufficient context").when(n_read > 0, "OK").when(error.isNotNull(), F.concat(F.lit("ERROR: "), error)).otherwise("ERROR: no JSON in answer")
    )


def in_taxonomy(c: Column, taxonomy: list[str], fallback: str = "Other") -> Column:
    """The category, or the fallback where it is none of the taxonomy; null stays null."""
    return F.when(c.isNull(), None).when(c.isin(taxonomy), c).otherwise(fallback)
