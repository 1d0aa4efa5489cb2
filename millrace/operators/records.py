"""Loading delimited records that were kept as raw lines, with rejects and their reasons.

Structure is read by Arrow's CSV reader, whose invalid-row callback hands over the records with a
wrong number of columns; all fields arrive as strings and the key field is then checked as a vector.
Records with broken quoting are told apart before, as they would swallow the records behind them.

Defined cases: a null line is an empty record of one blank column; a record whose file has no header
has no column count to meet and fails with 'column_count'; a key column that the header lacks makes
'invalid_value'; of several headers of one file the one with the least record_id counts; a header is
no record. Blanks around a quoted value stand outside the quotes and so break it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import small_side

BROKEN, COUNT, VALUE = "broken_quote", "column_count", "invalid_value"
# key column -> patterns (RE2) that a valid and an invalid bare key match
KEYS = {
    "IDRSSD": (r"^0*[1-9][0-9]{0,6}$", r"^.{8,}$"),
    "COMPANY_NAME": (r"\pL", r"(?i)^(nan|null|none|n/a)$"),
}
# line ends inside records are stood in for, so that each record is one line to the reader
LF, CR = chr(0xE01E), chr(0xE01F)


def quoted_away(line: Column, sep: str) -> Column:
    """The record with each well-formed quoted field emptied; a quote that is left is a broken one."""
    return F.regexp_replace(line, rf'(?<=^|{sep})"[^"]*+(?:""[^"]*+)*+"(?={sep}|$)', "")


def header_names(line: Column, sep: str) -> Column:
    """Field names of a header line: upper case, without quotes and outer blanks; empty ones stay."""
    return F.transform(F.split(line, sep), lambda c: F.upper(F.regexp_replace(c, r'^[\s"]+|[\s"]+$', "")))


def with_headers(raw: DataFrame, sep: str, key: str) -> DataFrame:
    """Records (line_no above 0) beside the names, column count and key position of their file's header.

    The header side has one row per file and is written once; where it is small it is broadcast, so that the
    records are not shuffled on a key of which one value may hold any share of them.
    """
    head = (
        raw.where("line_no = 0")
        .groupBy("file_name")
        .agg(F.min_by("raw_line", "record_id").alias("line"))
        .select("file_name", header_names(F.coalesce("line", F.lit("")), sep).alias("names"))
        .withColumn("n_cols", F.size("names"))
        .withColumn("key_pos", F.array_position("names", key).cast("int"))
    )
    return raw.where("line_no > 0 or line_no is null").join(small_side(head), "file_name", "left")


def _one_shape(ids: pa.Array, lines: pa.Array, n_cols: int, sep: str) -> tuple[dict[int, int], pa.Table | None]:
    """Ids of records without n_cols columns, by their count, and the table of the others; column 0 is the id."""
    bad: dict[int, int] = {}

    def reject(row: pacsv.InvalidRow) -> str:
        text = row.text
        bad[int(text[: text.index(sep)])] = row.actual_columns - 1
        return "skip"

    body = pc.binary_join_element_wise(pc.cast(ids, pa.string()), lines, sep)
    data = "\n".join(body.to_pylist()).encode()
    names = ["#id", *(f"c{i}" for i in range(n_cols))]
    got = pacsv.read_csv(
        pa.py_buffer(data),
        read_options=pacsv.ReadOptions(use_threads=False, block_size=len(data) + 16, column_names=names),
        parse_options=pacsv.ParseOptions(delimiter=sep, quote_char='"', double_quote=True, newlines_in_values=False, ignore_empty_lines=False, invalid_row_handler=reject),
        convert_options=pacsv.ConvertOptions(column_types={n: pa.int64() if n == "#id" else pa.string() for n in names}, strings_can_be_null=False),
    )
    return bad, got


def _bare(a: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(a, r'^[\s"]+|[\s"]+$', "")


def parser(sep: str, key: str, keep_values: bool):
    """mapInArrow function: adds `reason` (null: the record loads) and, if asked for, the bare `values`."""
    good, never = KEYS[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            reason: list[str | None] = [None] * n
            values: list[pa.ListArray] = []
            valued: list[np.ndarray] = []
            broken = b.column("broken").to_pylist()
            n_cols, key_pos = b.column("n_cols").to_pylist(), b.column("key_pos").to_pylist()
            groups: dict[tuple[int, int], list[int]] = {}
            for i in range(n):
                if broken[i]:
                    reason[i] = BROKEN
                elif n_cols[i] is None:
                    reason[i] = COUNT
                else:
                    groups.setdefault((n_cols[i], key_pos[i] or 0), []).append(i)
            lines = b.column("raw_line")
            for (count, pos), at in groups.items():
                idx = pa.array(at, pa.int64())
                # row numbers within the batch serve as ids, so repeated record ids cannot be confused
                text = pc.replace_substring(pc.replace_substring(pc.take(lines, idx), "\n", LF), "\r", CR)
                bad, got = _one_shape(idx, text, count, sep)
                for i in bad:
                    reason[i] = COUNT
                ids = got.column("#id").to_pylist()
                if pos:
                    k = _bare(got.column(f"c{pos - 1}").combine_chunks())
                    ok = pc.and_not(pc.match_substring_regex(k, good), pc.match_substring_regex(k, never))
                    flags = ok.to_pylist()
                else:
                    flags = [False] * len(ids)
                for i, f in zip(ids, flags):
                    if not f:
                        reason[i] = VALUE
                if keep_values and got.num_rows:
                    # columns laid end to end, then turned into one list a record
                    flat = pa.concat_arrays([_bare(got.column(f"c{c}").combine_chunks()) for c in range(count)])
                    flat = pc.take(flat, pa.array(np.arange(count * got.num_rows).reshape(count, -1).T.ravel()))
                    flat = pc.replace_substring(pc.replace_substring(flat, LF, "\n"), CR, "\r")
                    values.append(pa.ListArray.from_arrays(pa.array(np.arange(got.num_rows + 1) * count, pa.int32()), flat))
                    valued.append(got.column("#id").to_numpy())
            cols = [b.column(c) for c in ("record_id", "file_name")] + [pa.array(reason, pa.string())]
            out = ["record_id", "file_name", "reason"]
            if keep_values:
                held = pa.nulls(n, pa.list_(pa.string()))
                if values:
                    place = np.full(n, -1)
                    place[np.concatenate(valued)] = np.arange(sum(map(len, valued)))
                    held = pc.take(pa.concat_arrays(values), pa.array(place, mask=place < 0))
                cols += [b.column("names"), held]
                out += ["names", "values"]
            yield pa.RecordBatch.from_arrays(cols, names=out)

    return run


def parse(raw: DataFrame, sep: str, key: str, keep_values: bool = False) -> DataFrame:
    """(record_id, file_name, reason[, names, values]) of every record of `raw`."""
    d = "\\t" if sep == "\t" else sep
    line = F.coalesce("raw_line", F.lit(""))
    prepared = with_headers(raw.select("record_id", "file_name", "line_no", "raw_line"), d, key).select(
        "record_id", "file_name", "n_cols", "key_pos", line.alias("raw_line"), F.contains(quoted_away(line, d), F.lit('"')).alias("broken"), *(["names"] if keep_values else [])
    )
    schema = "record_id long, file_name string, reason string" + (", names array<string>, values array<string>" if keep_values else "")
    return prepared.mapInArrow(parser(sep, key, keep_values), schema)


def failing_cells(raw: DataFrame, sep: str, key: str, kinds: dict[str, str], source: str) -> DataFrame:
    """(source_table, record_id, field_name, value, wanted): the cells of loading records that do not cast to the kind of their field.

    kinds: field name, or '*' for all others but the key -> 'integer' or 'number'. Cells are checked as whole
    vectors, column by column; blank cells are no failures.
    """
    rule = {"integer": r"^\s*[+-]?\d+\s*$", "number": r"^\s*[+-]?(\d+\.?\d*|\.\d+)\s*$"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, out = b.column("values"), []
            flat, parent = pc.list_flatten(values), pc.list_parent_indices(values).to_numpy()
            field = pc.list_flatten(b.column("names"))
            wanted = pc.replace_with_mask(field, pa.array([True] * len(field)), pa.array([kinds.get(f, "" if f in ("", key) else kinds.get("*", "")) for f in field.to_pylist()], pa.string()))
            filled = pc.match_substring_regex(flat, r"\S")
            for kind, rx in rule.items():
                odd = pc.and_(pc.and_(pc.equal(wanted, kind), filled), pc.invert(pc.match_substring_regex(flat, rx)))
                at = pc.indices_nonzero(odd)
                rows = pa.array(parent[at.to_numpy()], pa.int64())
                out.append(pa.RecordBatch.from_arrays([pc.take(b.column("record_id"), rows), pc.take(field, at), pc.take(flat, at), pa.array([kind] * len(at), pa.string())], names=["record_id", "field_name", "value", "wanted"]))
            yield from out

    one = loaded(raw, sep, key).select("record_id", "names", "values")
    return one.mapInArrow(run, "record_id long, field_name string, value string, wanted string").select(F.lit(source).alias("source_table"), "record_id", "field_name", "value", "wanted")


def rejects(raw: DataFrame, sep: str, key: str, source: str) -> DataFrame:
    """(source_table, record_id, reason): the records that do not load, each with its first reason."""
    return parse(raw, sep, key).where("reason is not null").select(F.lit(source).alias("source_table"), "record_id", "reason")


def loaded(raw: DataFrame, sep: str, key: str) -> DataFrame:
    """(record_id, file_name, names, values): the records that load."""
    return parse(raw, sep, key, keep_values=True).where("reason is null").drop("reason")
