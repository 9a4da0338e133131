"""A Spark data source for append-only logs of JSON lines, in batch and as a stream.

    spark.dataSource.register(LogSource)
    spark.read.format("conversation_logs").option("kind", "codex").load("/archive/host1/codex")

A file is read in byte ranges; a range owns the lines whose line end lies in it, so ranges of one file
meet without a gap, a line that an append goes on with is found whole, and a torn last line, which has no
end, waits. Lines end at ``\\n`` only. The stream's offsets are the files' sizes: a batch reads what
files have grown by, and nothing of what was read before. A file that has become shorter gives one row
that says so, and is read on from where it ends now. Only files physically below the root are read.

Options: ``path``; ``kind``, claude-code (``*.jsonl``; at depth two searchable, else for tools only) or
codex (``rollout-*.jsonl`` at any depth); ``host``; ``rangebytes``; ``emit`` (batch), lines or ranges.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import storage
from .providers import TOOLS_ONLY
from .storage import listed, opened

FORMAT = "conversation_logs"
#: Bytes of a range, of what is read at once, and of the steps back to where a line begins.
RANGE, BLOCK, BACK = 64 << 20, 4 << 20, 1 << 16
#: Bytes of the ranges that one task reads, and what a range counts for besides its bytes.
TASK, OPENING = 64 << 20, 256 << 10
# The file names of each kind.
PATTERNS = {"claude-code": "*.jsonl", "codex": "rollout-*.jsonl"}
INVALID, SHORTER = "invalid UTF-8", "truncated"

_FIELDS = [("host", pa.string()), ("source", pa.string()), ("email", pa.string()), ("path", pa.string()), ("rel_path", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC"))]
_LINES = pa.schema([*_FIELDS, ("range_no", pa.int32()), ("nth", pa.int64()), ("at", pa.int64()), ("ends", pa.int64()), ("line", pa.string()), ("reason", pa.string())])
_RANGES = pa.schema([("host", pa.string()), ("path", pa.string()), ("range_no", pa.int32()), ("n", pa.int64()), ("valid", pa.bool_())])
_SQL = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.timestamp("us", "UTC"): "timestamp"}


@dataclass
class ByteRange(InputPartition):
    """Lines of a file that end in [start, end). ``whole``: the range is the file, and one invalid byte in it
    (also behind the last line end) invalidates all of it. ``shorter``: what was read before, if there is less now."""

    rel_path: str
    size: int
    modified: int
    number: int
    start: int
    end: int
    whole: bool
    shorter: int | None = None

    def __hash__(self) -> int:
        return hash((self.rel_path, self.start, self.end))


@dataclass
class Bundle(InputPartition):
    """Ranges that one task reads one after another."""

    ranges: list[ByteRange]

    def __hash__(self) -> int:
        return hash(tuple(self.ranges))


def bundled(ranges: list[ByteRange]) -> list[Bundle]:
    """Consecutive ranges of about ``TASK`` bytes: small files don't get a task each."""
    out, size = [], 0
    for r in ranges:
        cost = r.end - r.start + OPENING
        if not out or size + cost > TASK:
            out.append(Bundle([]))
            size = 0
        out[-1].ranges.append(r)
        size += cost
    return out


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ", ".join(f"{f.name} {_SQL[f.type]}" for f in (_RANGES if self.options.get("emit") == "ranges" else _LINES))

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


class _Files:
    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}
        self.root, self.kind, self.host = options["path"], options.get("kind", "claude-code"), options.get("host", "")
        self.range, self.emit = int(options.get("rangebytes", RANGE)), options.get("emit", "lines")
        if self.kind not in PATTERNS:
            raise ValueError(f"kind must be one of {', '.join(PATTERNS)}")

    def files(self) -> Iterator[tuple[str, int, int]]:
        for rel_path, size, modified in listed(self.root):
            if fnmatch(rel_path.rsplit("/", 1)[-1], PATTERNS[self.kind]):
                yield rel_path, size, modified

    def ranges(self, rel_path: str, size: int, modified: int, start: int = 0) -> list[ByteRange]:
        cuts = [*range(start, size, self.range), size]
        return [ByteRange(rel_path, size, modified, k, a, b, start == 0 and len(cuts) == 2) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]

    def _facts(self, r: ByteRange) -> list:
        steps = r.rel_path.split("/")
        searchable = self.kind == "codex" or len(steps) == 2
        email = steps[0] if self.kind == "claude-code" and searchable else ""
        return [self.host, self.kind if searchable else TOOLS_ONLY, email, f"{self.root.rstrip('/')}/{r.rel_path}", r.rel_path, r.size, r.modified]

    def _batch(self, r: ByteRange, rows: list[tuple]) -> pa.RecordBatch:
        """``rows``: (nth, at, ends, line, reason)."""
        facts = [pa.array([v] * len(rows), kind) for v, (_, kind) in zip(self._facts(r), _FIELDS, strict=True)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([*facts, pa.array([r.number] * len(rows), pa.int32()), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], schema=_LINES)

    def lines(self, r: ByteRange) -> Iterator[list[tuple[int, bytes]]]:
        """(offset, line without its end) of the range's lines, block by block; last, what stands behind the file's
        last line end, if the range reaches the file's end."""
        store, base = opened(self.root)
        with store.open_input_file(f"{base}/{r.rel_path}") as f:
            begin = r.start
            while begin > 0:  # back to behind the line end before the range
                step = max(0, begin - BACK)
                f.seek(step)
                found = f.read(begin - step).rfind(b"\n")
                begin = step + found + 1 if found >= 0 else step
                if found >= 0:
                    break
            f.seek(begin)
            held, at, left = [], begin, r.end - begin
            while left > 0:
                data = f.read(min(BLOCK, left))
                if not data:
                    break  # shorter by now
                left -= len(data)
                end = data.rfind(b"\n")
                if end < 0:
                    held.append(data)
                    continue
                whole, out = b"".join([*held, data[:end]]), []
                for line in whole.split(b"\n"):
                    out.append((at, line))
                    at += len(line) + 1
                held = [data[end + 1 :]]
                yield out
            self.tail = b"".join(held)

    def read(self, bundle: Bundle) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for r in bundle.ranges:
            for batch in self.read_range(r):
                held.append(batch)
                size += batch.nbytes
                if size > BLOCK:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def read_range(self, r: ByteRange) -> Iterator[pa.RecordBatch]:
        if r.shorter is not None:
            yield self._batch(r, [(0, r.shorter, r.size, None, SHORTER)])
            return
        if self.emit == "ranges":
            n, valid = 0, True
            for lines in self.lines(r):
                n += len(lines)
                valid = valid and all(_text(x) is not None for _, x in lines)
            valid = valid and (r.end < r.size or _text(self.tail) is not None)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([self.host, self._facts(r)[3], r.number, n, valid], _RANGES.types, strict=True)], schema=_RANGES)
            return
        nth, held = 0, []
        for lines in self.lines(r):
            rows = []
            for at, raw in lines:
                text = _text(raw)
                rows.append((nth, at, at + len(raw) + 1, text, None if text is not None else INVALID))
                nth += 1
            if r.whole:  # nothing is given before all is known to be valid
                held.append(rows)
            else:
                yield self._batch(r, rows)
        if r.whole:
            if _text(self.tail) is None or any(row[4] for rows in held for row in rows):
                yield self._batch(r, [(0, 0, 0, None, INVALID)])
            else:
                for rows in held:
                    yield self._batch(r, rows)


def _text(raw: bytes) -> str | None:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return None


class _Batch(_Files, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        out = [ranges for f in self.files() if (ranges := self.ranges(*f))]
        return bundled([r for ranges in out if self.emit == "lines" or len(ranges) > 1 for r in ranges]) or [Bundle([])]

    def read(self, bundle: Bundle) -> Iterator[pa.RecordBatch]:
        return super().read(bundle)


class _Stream(_Files, DataSourceStreamReader):
    """Offsets: the size of each file that was ever seen, by path."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {rel_path: size for rel_path, size, _ in self.files()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out: list[ByteRange] = []
        for rel_path, size in end.items():
            before = start.get(rel_path, 0)
            if size > before:
                out += [ByteRange(r.rel_path, size, 0, r.number, r.start, r.end, False) for r in self.ranges(rel_path, size, 0, before)]
            elif size < before:
                out.append(ByteRange(rel_path, size, 0, 0, size, size, False, before))
        return bundled(out)

    def read(self, bundle: Bundle) -> Iterator[pa.RecordBatch]:
        return super().read(bundle)


def register(spark: SparkSession) -> None:
    """The process that plans a stream doesn't get the files that were added to a session, so the source is sent with
    its code."""
    for module in (sys.modules[__name__], storage):
        cloudpickle.register_pickle_by_value(module)
    spark.dataSource.register(LogSource)


def read_lines(spark: SparkSession, sources: list[tuple[str, str]], kind: str, range_bytes: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """(lines, bad files) of all hosts' logs of a kind: lines with their number from 0; a file with any invalid byte
    gives none. A file of one range is judged and numbered where it is read; the ranges of larger ones are
    counted first."""
    register(spark)
    load = lambda host, path, emit: spark.read.format(FORMAT).options(kind=kind, host=host, rangebytes=range_bytes, emit=emit).load(path)
    each = [(load(h, p, "lines"), load(h, p, "ranges")) for h, p in sources]
    rows, ranges = each[0]
    for more_rows, more_ranges in each[1:]:
        rows, ranges = rows.unionByName(more_rows), ranges.unionByName(more_ranges)
    file = Window.partitionBy("host", "path")
    before = F.coalesce(F.sum("n").over(file.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select("host", "path", "range_no", before.alias("before"), F.min("valid").over(file).alias("good"))
    joined = rows.join(starts, ["host", "path", "range_no"], "left")
    lines = joined.where(F.coalesce("good", F.lit(True)) & F.col("line").isNotNull()).withColumn("line_no", F.col("nth") + F.coalesce("before", F.lit(0)))
    single = rows.where("reason IS NOT NULL").select("path")
    bad = single.unionByName(ranges.where("NOT valid").select("path")).distinct()
    return lines.drop("before", "good", "nth", "range_no", "reason"), bad.select("path", F.lit(None).cast("long").alias("line_no"), F.lit(INVALID).alias("reason"))


def stream_lines(spark: SparkSession, path: str, kind: str, host: str = "", range_bytes: int = RANGE) -> DataFrame:
    """The stream: at and ends (bytes) identify a line; ``reason`` tells why ``line`` is null."""
    register(spark)
    return spark.readStream.format(FORMAT).options(kind=kind, host=host, rangebytes=range_bytes).load(path)
