"""Delimited files that are still appended to, as a stream.

Spark's file source takes a file once, as it is when it is first seen. This source remembers how many bytes of every file
have been read and takes what was added since, up to the last complete line; a line that is still being written waits.
New files join as they appear. The offsets of a batch are the byte positions of all files, kept in the checkpoint of the
query, so a restart goes on where the last batch ended.

Added bytes are dealt to tasks in pieces of ``CHUNK``; a piece holds the lines that begin in it. A task opens the file's
header itself, so files may differ in their columns as in ``read_delimited``; cells are picked by name. A line with
more or fewer cells than its header is kept with what it has, and its text is in ``_corrupt_record``. Cells hold no
line breaks. Files are opened through Arrow's file systems, by the scheme of the path.

Defined cases: a file without a complete header line, or with nothing else, gives no rows; a file that became shorter
than what was read of it raises; a file that was removed is forgotten; no matching file is no row yet.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.delimited import CORRUPT

FORMAT = "appended_lines"
CHUNK = 32 << 20


def _source(chunk: int):
    """The data source, made here so that it travels by value to workers without this package."""
    import csv
    import fnmatch
    import io
    import json

    import pyarrow as pa
    import pyarrow.csv as pacsv
    import pyarrow.fs as pafs
    from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

    corrupt = CORRUPT
    tail = 1 << 16

    def located(uri: str):
        plain = uri if "://" in uri or uri.startswith("file:") else f"file://{uri}"
        return pafs.FileSystem.from_uri(plain.replace("file:/", "file:///", 1) if plain.startswith("file:/") and not plain.startswith("file://") else plain)

    def fixed_part(pattern: str) -> str:
        """The folder above the first part with a wildcard, or above the file."""
        parts = pattern.split("/")
        first = next((i for i, p in enumerate(parts) if any(c in p for c in "*?[")), len(parts) - 1)
        return "/".join(parts[:first])

    def complete(file, size: int, known: int) -> int:
        """Where the last complete line ends, not before ``known``."""
        end = size
        while end > known:
            begin = max(known, end - tail)
            file.seek(begin)
            at = file.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
        return known

    def line_from(file, at: int, size: int) -> int:
        """Where the line after the first line break at or after ``at`` begins."""
        while at < size:
            file.seek(at)
            block = file.read(min(tail, size - at))
            if not block:
                break
            found = block.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(block)
        return size

    class Piece(InputPartition):
        def __init__(self, path: str, begin: int, end: int, low: int, high: int):
            super().__init__((path, begin, end))
            self.path, self.begin, self.end, self.low, self.high = path, begin, end, low, high

    class Reader(DataSourceStreamReader):
        def __init__(self, path: str, columns: list[str], chunk: int):
            self.uri, self.columns, self.chunk = path, columns, chunk
            self.seen: dict[str, tuple[int, int]] = {}  # size when last looked at, end of the last complete line

        def initialOffset(self) -> dict:
            return {"files": "{}"}

        def latestOffset(self) -> dict:
            # glob signs are no part of a URI
            head = fixed_part(self.uri)
            fs, base = located(head)
            pattern = base + self.uri[len(head):]
            ends = {}
            for info in fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True)):
                if info.type != pafs.FileType.File or info.path.count("/") != pattern.count("/") or not fnmatch.fnmatchcase(info.path, pattern):
                    continue
                size, end = self.seen.get(info.path, (0, 0))
                if info.size < end:
                    raise ValueError(f"{info.path} became shorter than what was read of it")
                if info.size != size:
                    with fs.open_input_file(info.path) as file:
                        end = complete(file, info.size, end)
                    self.seen[info.path] = (info.size, end)
                if end:
                    ends[info.path] = end
            return {"files": json.dumps(ends, sort_keys=True)}

        def partitions(self, start: dict, end: dict) -> list:
            before, after = json.loads(start["files"]), json.loads(end["files"])
            out = []
            for path, high in sorted(after.items()):
                low = before.get(path, 0)
                if high < low:
                    raise ValueError(f"{path} became shorter than what was read of it")
                out += [Piece(path, at, min(at + self.chunk, high), low, high) for at in range(low, high, self.chunk)]
            return out

        def commit(self, end: dict) -> None:
            pass

        def read(self, piece):
            fs, _ = located(fixed_part(self.uri))
            with fs.open_input_file(piece.path) as file:
                first = line_from(file, 0, piece.high)
                file.seek(0)
                header = file.read(first).decode("utf-8", "replace").lstrip("﻿")
                names = [c.strip().removeprefix('"').removesuffix('"') for c in header.rstrip("\r\n").split(",")]
                begin = max(first, piece.begin if piece.begin == piece.low else line_from(file, piece.begin - 1, piece.high))
                end = piece.high if piece.end == piece.high else line_from(file, piece.end - 1, piece.high)
                if begin >= end:
                    return
                file.seek(begin)
                data = file.read(end - begin).decode("utf-8", "replace")
            odd = []

            def misfit(row):
                odd.append(row.text)
                return "skip"

            unique = [f"{i}:{n}" for i, n in enumerate(names)]  # a header may repeat a name; the first counts
            at = {n: i for i, n in reversed(list(enumerate(names)))}
            wanted = [unique[at[c]] for c in self.columns if c in at] or unique[:1]
            try:
                table = pacsv.read_csv(
                    io.BytesIO(data.encode()), read_options=pacsv.ReadOptions(column_names=unique, use_threads=False),
                    parse_options=pacsv.ParseOptions(invalid_row_handler=misfit),
                    convert_options=pacsv.ConvertOptions(column_types=dict.fromkeys(unique, pa.string()), include_columns=wanted, null_values=[""],
                                                         strings_can_be_null=True, quoted_strings_can_be_null=False))
                rows = {c: table.column(unique[at[c]]).to_pylist() if c in at else [None] * table.num_rows for c in self.columns}
                n = table.num_rows
            except pa.ArrowInvalid as nothing:  # not one line that fits
                if "Empty CSV" not in str(nothing):
                    raise
                rows, n = {c: [] for c in self.columns}, 0
            for text in odd:
                cells = next(csv.reader([text]), [])
                for c in self.columns:
                    rows[c].append((cells[at[c]] or None) if c in at and at[c] < len(cells) else None)
            n += len(odd)
            spot = pa.StructArray.from_arrays([pa.array([begin] * n, pa.int64()), pa.array(range(n), pa.int64())], ["block", "row"])
            batch = pa.RecordBatch.from_arrays(
                [*(pa.array(rows[c], pa.string()) for c in self.columns), pa.array([piece.path] * n, pa.string()), spot,
                 pa.array([None] * (n - len(odd)) + odd, pa.string())], [*self.columns, "file_path", "seq", corrupt])
            for i in range(0, n, 10_000):
                yield batch.slice(i, 10_000)

    class AppendedLines(DataSource):
        @classmethod
        def name(cls) -> str:
            return "appended_lines"

        def _columns(self) -> list[str]:
            return json.loads(self.options["columns"])

        def schema(self) -> str:
            return ", ".join(f"`{c}` string" for c in self._columns()) + \
                f", file_path string, seq struct<block: bigint, row: bigint>, `{corrupt}` string"

        def streamReader(self, schema):
            return Reader(self.options["path"], self._columns(), int(self.options.get("chunk", chunk)))

    return AppendedLines


def follow_delimited(spark: SparkSession, path: str, columns: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """A stream of what is appended to the files of ``path`` (a pattern): text columns by name, as in ``read_delimited``."""
    spark.dataSource.register(_source(CHUNK))
    return spark.readStream.format(FORMAT).option("path", path).option("columns", json.dumps(list(columns))) \
        .option("chunk", str(chunk)).load()
