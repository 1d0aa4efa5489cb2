"""File sources: tolerant delimited files, documents in folders, logs, quarter folders, pages that are PDFs.

Everything is read as text by the executors; a delimited file of a feed is one row until it is parsed, so quoted
line ends and per-file headers are no trouble. Files too large for that belong to `spark.read.csv`.

Defined cases: an empty folder gives an empty table of the asked columns; a file without header row gives no rows;
NUL characters are dropped; bytes that are no UTF-8 become replacement characters.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace.functions import dates
from millrace.operators import generators, rules
from millrace.operators.windows import keep_first

FILE = "file_path"


def whole_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(file_path, text): every file below a folder whose name fits the pattern, NULs dropped."""
    one = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    # the path is given as an address, with its signs escaped
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return one.select(path.alias(FILE), F.translate("value", "\0", "").alias("text"))


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(file_path, folder, name, bytes) of the files below a folder; contents are not read."""
    one = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select(F.col("path").alias(FILE), F.col("length").alias("bytes"))
    return one.select(FILE, F.regexp_extract(FILE, r"([^/]*)/[^/]*$", 1).alias("folder"), F.regexp_extract(FILE, r"([^/]*)$", 1).alias("name"), "bytes")


def rows_of(text: str, sep: str, strict: bool) -> tuple[list[str], list[list[str]], int]:
    """(names, rows, skipped): rows with surplus fields are skipped, short ones padded; empty header names are dropped.

    strict: broken quoting makes the whole file be read again with quotes as ordinary signs.
    """
    try:
        got = list(csv.reader(io.StringIO(text, newline=""), delimiter=sep, strict=strict))
    except csv.Error:
        got = list(csv.reader(io.StringIO(text, newline=""), delimiter=sep, quoting=csv.QUOTE_NONE))
    got = [r for r in got if r]
    if not got:
        return [], [], 0
    names = [n.strip().strip('"').strip() for n in got[0]]
    keep = [i for i, n in enumerate(names) if n]
    rows = [r + [""] * (len(names) - len(r)) for r in got[1:] if len(r) <= len(names)]
    return [names[i] for i in keep], [[r[i] for i in keep] for r in rows], len(got) - 1 - len(rows)


def delimited(spark: SparkSession, root: str, columns: list[str], pattern: str = "*.csv", sep: str = ",", strict: bool = True, required: list[str] = ()) -> DataFrame:
    """(file_path, row_no, columns...): all files as one table by column name, every value a string, empty ones null.

    A column that a file lacks is null; one of `required` that it lacks is an error that names the file. Names are
    met without regard to case.
    """
    low = {c.lower(): c for c in columns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                names, rows, _ = rows_of(text, sep, strict)
                at = {}
                for i, n in enumerate(names):
                    at.setdefault(low.get(n.lower(), ""), i)
                missing = [c for c in required if c not in at]
                if missing:
                    raise ValueError(f"{path} lacks {', '.join(missing)}")
                data = [pa.array([path] * len(rows), pa.string()), pa.array(range(1, len(rows) + 1), pa.int64())]
                data += [pa.array([r[at[c]] or None for r in rows] if c in at else [None] * len(rows), pa.string()) for c in columns]
                yield pa.RecordBatch.from_arrays(data, names=[FILE, "row_no", *columns])

    schema = ", ".join([f"{FILE} string", "row_no long", *(f"`{c}` string" for c in columns)])
    return whole_files(spark, root, pattern).mapInArrow(run, schema)


def lines(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(file_path, line_no, line) of logs."""
    return whole_files(spark, root, pattern).select(FILE, F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))


def first_in_folder(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(folder, file_path): the first file of each folder, by name, that fits the pattern."""
    return keep_first(listing(spark, root, pattern), ["folder"], F.col("name")).select("folder", FILE)


def quarters(spark: SparkSession, root: str, pattern: str, first: str, last: str) -> DataFrame:
    """(quarter_end, quarter_code, file_path, status): every quarter of a span with the file of its MMDDYY folder, or none."""
    found = first_in_folder(spark, root, pattern).select(dates.quarter_end(F.col("folder")).alias("quarter_end"), FILE).where("quarter_end is not null")
    return rules.with_status(generators.quarter_ends(spark, first, last), found, ["quarter_end"], "status", "missing").select("quarter_end", "quarter_code", FILE, "status")


def documents(spark: SparkSession, root: str, pattern: str = "*.html", entities: list[str] | None = None) -> DataFrame:
    """(file_path, entity, kind, name, text) of <root>/<entity>[/<kind>]/<name>; entities: only these."""
    inner = F.regexp_extract(FILE, rf"{root.rstrip('/').split('/')[-1]}/(.*)$", 1)
    parts = F.split(inner, "/")
    one = whole_files(spark, root, pattern).select(FILE, F.regexp_replace(F.get(parts, F.lit(0)), "_", " ").alias("entity"), F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).alias("kind"), F.element_at(parts, -1).alias("name"), "text")
    return one.where(F.col("entity").isin(entities)) if entities else one


def is_binary(text: Column) -> Column:
    """Whether a page is a PDF or an archive that was saved as text."""
    return F.startswith(text, F.lit("%PDF")) | F.startswith(text, F.lit("PK"))


def pdf_text(df: DataFrame, content: str, reader: Callable[[bytes], str], least: int = 100) -> DataFrame:
    """`df` with pdf_text and pdf_status ('OK', 'corrupted_pdf' for too little text, 'pdf_error'); reader: any function from bytes to text."""


    @F.pandas_udf(StructType([StructField("text", StringType()), StructField("status", StringType())]))
    def run(content: pd.Series) -> pd.DataFrame:
        out = []
        for c in content:
            try:
                t = reader(bytes(c)).strip() if c is not None else ""
                out.append((t, "OK") if len(t) >= least else (None, "corrupted_pdf"))
            except Exception:  # noqa: BLE001 - a reader may fail in any way
                out.append((None, "pdf_error"))
        return pd.DataFrame(out, columns=["text", "status"])

    got = run(F.col(content))
    return df.select("*", got["text"].alias("pdf_text"), got["status"].alias("pdf_status"))


def json_values(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON list or of JSON lines; what is no JSON is left out."""
    one = spark.read.text(path, wholetext=True).select(F.explode(F.coalesce(F.from_json("value", f"array<struct<{schema}>>"), F.array())).alias("v"))
    return one.select("v.*")
