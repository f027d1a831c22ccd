"""CSV records from lines, with line breaks in quoted cells, in parallel over the blocks of a file.

Whether a line begins inside a quoted cell depends on all lines before it. As a block does not know that, a first scan follows both
cases (one, as soon as they meet) and leaves a row per block: for either state at its beginning the records begun and the state at its end.
The blocks of a file are then chained, which settles the case of every block. A second scan cuts the records; only parts of
records that lie in several blocks are shuffled and joined.

A quote opens a cell only at its beginning, as the format has it; elsewhere it is a character. A file that ends inside a quoted cell has no
such cell: from the line that opens it on, lines are records by themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewarden.session import staged


def _machines(delimiter: str) -> tuple[re.Pattern, re.Pattern]:
    """What a line must match to end inside a quoted cell: if it begins a record, and if it begins inside one."""
    d = re.escape(delimiter)
    cell = rf'(?:"(?:[^"]|"")*+"[^{d}]*+|(?!")[^{d}]*+)'
    opened = rf'(?:{cell}{d})*+"(?:[^"]|"")*+'
    return re.compile(rf"{opened}\Z", re.S), re.compile(rf'(?:[^"]|"")*+(?:"[^{d}]*+{d}{opened})?\Z', re.S)


def _states(state: int, texts: list[str], machines, known: list[int] | None = None) -> list[int]:
    """The state before each of some lines and after the last; from where it equals ``known`` it is taken from there."""
    states = [state]
    for i, text in enumerate(texts):
        if known is not None and state == known[i]:
            return states + known[i + 1 :]
        state = int(machines[state].match(text) is not None)
        states.append(state)
    return states


def _before(part: pa.Array, starts: list[int], machines) -> list[tuple[np.ndarray, int]]:
    """For each state a block may be in: the state before each of some lines, and after the last. Lines without a quote keep it."""
    quoted = np.flatnonzero(pc.match_substring(part, '"').to_numpy(zero_copy_only=False))
    texts = part.take(pa.array(quoted)).to_pylist()
    spans = np.diff(np.concatenate([[0], quoted + 1, [len(part)]]))
    out, known = [], None
    for start in starts:
        known = _states(start, texts, machines, known)
        out.append((np.repeat(np.array(known, np.int64), spans), known[-1]))
    return out


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """The stretches of lines of one block: its file and beginning, and where they begin and end in the batch."""
    number, name = batch.column("block").to_numpy(zero_copy_only=False), batch.column("file").dictionary_encode()
    code = name.indices.to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (number[1:] != number[:-1])][: len(code)]).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(code)]):
        yield (name.dictionary[int(code[a])].as_py(), int(number[a])), a, b


def _block_ends(lines: DataFrame, delimiter: str) -> DataFrame:
    """A row per block: its lines and, for both cases, the state at its end, the records begun, and the line that began the last one."""
    columns = ("file", "block", "lines", "out0", "out1", "records0", "records1", "begin0", "begin1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines, at, held = _machines(delimiter), None, None

        def given() -> pa.RecordBatch:
            n, state, records, begin = held
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*at, n, *state, *records, *begin)], names=list(columns))

        for batch in batches:
            for here, a, b in _runs(batch):
                if here != at:
                    if at is not None:
                        yield given()
                    at, held = here, (0, [0, 1], [0, 0], [-1, -1])
                n, state, records, begin = held
                for case, (before, after) in enumerate(_before(batch.column("line").slice(a, b - a), state, machines)):
                    begins = np.flatnonzero(before == 0)
                    state[case], records[case] = after, records[case] + len(begins)
                    begin[case] = n + int(begins[-1]) if len(begins) else begin[case]
                held = n + b - a, state, records, begin
        if at is not None:
            yield given()

    return lines.mapInArrow(run, "file string, " + ", ".join(f"{c} long" for c in columns[1:]))


def _chained(blocks: pd.DataFrame) -> pd.DataFrame:
    """The blocks of a file in order: the state each begins in, lines and records before it, and where an unclosed cell begins."""
    state = lines = records = 0
    tail = None
    out = []
    for r in blocks.sort_values("block").itertuples():
        case = state
        out.append((r.file, r.block, case, lines, records))
        last, begun = (r.begin1, r.records1) if case else (r.begin0, r.records0)
        if last >= 0:
            tail = (lines + last, records + begun - 1)
        state = r.out1 if case else r.out0
        lines, records = lines + r.lines, records + begun
    found = pd.DataFrame(out, columns=["file", "block", "case", "lines_before", "records_before"])
    open_ = bool(state) and tail is not None
    return found.assign(tail_line=tail[0] if open_ else -1, tail_record=tail[1] if open_ else -1)


def _records(lines: DataFrame, delimiter: str) -> DataFrame:
    """``file, row_no, line_no, whole, text`` of every record, or of the part of it that lies in a block, of lines whose block is settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines, at = _machines(delimiter), None
        n = state = records = 0
        row_no, line_no, begun, open_, held = 0, 0, False, False, []

        def given(file: str, rows: np.ndarray, numbers: np.ndarray, whole: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
            arrays = [pa.array([file] * len(rows), pa.string()), pa.array(rows), pa.array(numbers), pa.array(whole), texts.cast(pa.string())]
            return pa.RecordBatch.from_arrays(arrays, names=["file", "row_no", "line_no", "whole", "text"])

        def last(ends: bool) -> Iterator[pa.RecordBatch]:
            """What is held; ``ends`` if its record does not go on elsewhere."""
            if held:
                yield given(at[0], np.array([row_no]), np.array([line_no]), np.array([begun and ends]), pa.array(["\n".join(held)], pa.string()))

        for batch in batches:
            for here, a, b in _runs(batch):
                case, lines_before, records_before, tail_line, tail_record = (
                    batch.column(c)[a].as_py() for c in ("case", "lines_before", "records_before", "tail_line", "tail_record"))
                if here != at:
                    yield from last(not open_)
                    at, n, state, records = here, lines_before, case, records_before
                    row_no, line_no, begun, held = records - 1, n, False, []
                part = batch.column("line").slice(a, b - a)
                (before, state), = _before(part, [state], machines)
                numbers = np.arange(n, n + b - a)
                in_tail = (numbers >= tail_line) & (tail_line >= 0)
                rows = np.where(in_tail, tail_record + numbers - tail_line, records + np.cumsum(before == 0) - 1)
                begins = np.flatnonzero((before == 0) | in_tail)
                n, records = n + b - a, records + int((before == 0).sum())
                held = held + part.slice(0, int(begins[0]) if len(begins) else b - a).to_pylist()
                if len(begins):
                    yield from last(True)
                    parts = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), part)
                    whole = begins[:-1]
                    if len(whole):
                        yield given(here[0], rows[whole], numbers[whole], np.ones(len(whole), bool), pc.binary_join(parts, "\n"))
                    row_no, line_no, begun, held = int(rows[begins[-1]]), int(numbers[begins[-1]]), True, part.slice(int(begins[-1])).to_pylist()
                open_ = bool(state) and not bool(in_tail[-1])
        if at is not None:
            yield from last(not open_)

    return lines.mapInArrow(run, "file string, row_no long, line_no long, whole boolean, text string")


def csv_records(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """``file, row_no, text`` of every record of the CSV files under ``path``; records are numbered from 0, blank lines count and are left out.

    Lines end in a line feed, with or without a carriage return before it.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    settled = staged(_block_ends(lines, delimiter).groupBy("file").applyInPandas(
        _chained, "file string, block long, case long, lines_before long, records_before long, tail_line long, tail_record long"))
    # A row per block travels to the lines, which stay in their order.
    found = staged(_records(lines.join(F.broadcast(settled), ["file", "block"]), delimiter))
    broken = found.where("not whole").groupBy("file", "row_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("parts"))
    joined = broken.select("file", "row_no", F.array_join("parts.text", "\n").alias("text"))
    records = found.where("whole").select("file", "row_no", "text").unionByName(joined)
    return records.select("file", "row_no", F.regexp_replace("text", "\r$", "").alias("text")).where("text <> ''")
