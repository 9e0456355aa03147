"""``format("fcs")``: FCS files as a Spark data source, in batches and streams, and as a sink with commit.

``register`` makes it known to a session. Reading takes the options

* ``channels``: names, parted by commas, that become the columns c0, c1, ... (found in any case, the first of equals; null in files that haven't them);
  without it they are those of the first file that can be read;
* ``view``: ``events`` or ``files`` (one row for each file, of its header and TEXT alone);
* ``mode``: ``PERMISSIVE`` (a file that can't be read gives one row with its ``error``), ``DROPMALFORMED`` or ``FAILFAST``;
* ``rangeBytes``: a task reads about so many bytes: a range of a large file's events, or several small files;
* for streams ``eventsPerBatch``, ``progress``, ``part`` and ``parts``, see ``FcsStreamReader``.

Files are read through ``pyarrow.fs``, in a folder those that end in ``.fcs``. Filters on ``path`` and ``sample_id`` choose files before any is opened.
"""

from __future__ import annotations

import fnmatch
import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from ..model import Panel
from . import fcs
from .shared import settled, written

CHUNK, RANGE_BYTES = 65_536, 32 << 20
FILES = "path string, sample_id string, version string, n_events long, n_params int, keywords map<string,string>, channels array<struct<index:int,name:string,label:string,range:double,bits:int>>, error string"


def register(spark: SparkSession) -> None:
    """Make ``format("fcs")`` known; its filters need the session's switch for sources written in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FcsDataSource)


def stem(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0] if "." in name else name


@dataclass(frozen=True, order=True)
class Found:
    """A file; ``stamp`` is its time of change in nanoseconds."""

    stamp: int
    path: str
    size: int


def list_files(path: str) -> list[Found]:
    """A file, the ``.fcs`` files of a folder and all below it, or those that fit a pattern in their last part; others' names start with ``_`` or ``.`` while they are written."""
    from pyarrow import fs as afs

    files, place = fcs.filesystem(path)
    lead = path[: len(path) - len(place)] if path.endswith(place) else ""
    pattern = "*.fcs"
    if re.search(r"[*?\[]", place.rsplit("/", 1)[-1]):
        place, pattern = place.rsplit("/", 1)
    else:
        info = files.get_file_info(place)
        if info.type == afs.FileType.File:
            return [Found(info.mtime_ns or 0, lead + info.path, info.size)]
        if info.type == afs.FileType.NotFound:
            raise FileNotFoundError(path)
    below = files.get_file_info(afs.FileSelector(place, recursive=True))
    hidden = re.compile(r"(^|/)[_.]")
    return sorted((Found(x.mtime_ns or 0, lead + x.path, x.size) for x in below if x.type == afs.FileType.File and fnmatch.fnmatchcase(x.base_name.lower(), pattern.lower()) and not hidden.search(x.path[len(place) :])), key=lambda f: f.path)


@dataclass
class Slice:
    """Events of a file: the given numbers, or one of some parts of about the same size."""

    path: str
    part: int = 0
    parts: int = 1
    first: int | None = None
    last: int | None = None


class Slices(InputPartition):
    def __init__(self, slices: list[Slice]):
        self.slices = slices


def packed(files: Sequence[Found], range_bytes: int) -> list[Slices]:
    """Partitions of about ``range_bytes``: parts of large files alone, small files together."""
    out, held, size = [], [], 0
    for f in files:
        parts = max(1, -(-f.size // range_bytes))
        if parts > 1:
            out += [Slices([Slice(f.path, k, parts)]) for k in range(parts)]
            continue
        if held and size + f.size > range_bytes:
            out.append(Slices(held))
            held, size = [], 0
        held.append(Slice(f.path))
        size += f.size
    return out + ([Slices(held)] if held else [])


class _Events:
    """Record batches of slices, under the names that the reader's channels have."""

    def __init__(self, channels: list[str], mode: str):
        self.channels, self.mode = channels, mode

    def schema(self) -> pa.Schema:
        return pa.schema([("path", pa.string()), ("sample_id", pa.string()), ("event_idx", pa.int64()), *[(f"c{i}", pa.float64()) for i in range(len(self.channels))], ("error", pa.string())])

    def read(self, slices: list[Slice]) -> Iterator[pa.RecordBatch]:
        for s in slices:
            try:
                yield from self.events(s)
            except (ValueError, OSError) as e:
                if self.mode == "FAILFAST":
                    raise fcs.FcsError(f"{s.path}: {e}") from e
                if self.mode == "PERMISSIVE" and s.part == 0 and not s.first:
                    yield pa.RecordBatch.from_pylist([{"path": s.path, "sample_id": stem(s.path), "error": str(e)}], self.schema())
        settled("read")

    def events(self, s: Slice) -> Iterator[pa.RecordBatch]:
        remote = fcs.Remote(s.path)
        head = fcs.read_header(remote)
        width, names = head.record().itemsize, [c["name"].upper() for c in head.channels()]
        at = [names.index(c.upper()) if c.upper() in names else None for c in self.channels]
        first = head.n_events * s.part // s.parts if s.first is None else s.first
        last = head.n_events * (s.part + 1) // s.parts if s.last is None else min(s.last, head.n_events)
        for begin in range(first, last, CHUNK):
            n = min(CHUNK, last - begin)
            values = fcs.decode(head, remote[head.data_start + begin * width : head.data_start + (begin + n) * width], 0, n)
            columns = [pa.array(np.ascontiguousarray(values[:, i])) if i is not None else pa.nulls(n, pa.float64()) for i in at]
            same = [pa.array([x]).take(pa.array(np.zeros(n, np.int32))) for x in (s.path, stem(s.path))]
            yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(begin, begin + n)), *columns, pa.nulls(n, pa.string())], schema=self.schema())


class FcsReader(DataSourceReader):
    def __init__(self, options: dict, channels: list[str]):
        self.options, self.mode, self.view = options, options.get("mode", "PERMISSIVE").upper(), options.get("view", "events")
        self.events, self.tests = _Events(channels, self.mode), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = ".".join(getattr(f, "attribute", ()))
            if column in ("path", "sample_id") and isinstance(f, EqualTo | EqualNullSafe | In | StringStartsWith):
                self.tests.append((column, f))
            else:
                yield f

    def _wanted(self, file: Found) -> bool:
        def fits(column: str, f: Filter) -> bool:
            value = file.path if column == "path" else stem(file.path)
            return value in f.value if isinstance(f, In) else value.startswith(f.value) if isinstance(f, StringStartsWith) else value == f.value

        return all(fits(*t) for t in self.tests)

    def partitions(self) -> list[Slices]:
        files = [f for f in list_files(self.options["path"]) if self._wanted(f)]
        if self.view == "files":
            return [Slices([Slice(f.path) for f in files[i : i + 64]]) for i in range(0, len(files), 64)]
        return packed(files, int(self.options.get("rangeBytes", RANGE_BYTES)))

    def read(self, partition: Slices) -> Iterator:
        return self._files(partition.slices) if self.view == "files" else self.events.read(partition.slices)

    def _files(self, slices: list[Slice]) -> Iterator[tuple]:
        for s in slices:
            try:
                h = fcs.read_header(fcs.Remote(s.path))
                yield s.path, stem(s.path), h.version, h.n_events, h.n_params, h.keywords, [tuple(c.values()) for c in h.channels()], None
            except (ValueError, OSError) as e:
                if self.mode == "FAILFAST":
                    raise fcs.FcsError(f"{s.path}: {e}") from e
                if self.mode == "PERMISSIVE":
                    yield s.path, stem(s.path), None, None, None, None, None, str(e)


class FcsStreamReader(DataSourceStreamReader):
    """Files in the order of their time of change and name; an offset is a file and how many of its events are taken.

    So the log has one file whatever their number, and a file may go over several batches. A file that comes in with an
    earlier time than one already taken isn't seen: files are to be moved in whole, with the time of their arrival.
    ``eventsPerBatch`` bounds a batch (a file that can't be read counts as one event). Spark doesn't tell a source
    where it stands when it asks how far it may go, so the bound needs ``progress``: a folder of this query alone, beside its checkpoint,
    in which the end of each batch is noted before it runs. Without a bound, a batch takes all there is.
    A query runs one batch at a time, so small batches leave a cluster idle. Several queries can share the files: with ``parts`` queries, each takes the
    part ``part`` (from 0) of every file's events, in batches, a checkpoint and a progress of its own, and counts in offsets the events of its part.
    A file that can't be read is a row of part 0.
    """

    def __init__(self, options: dict, channels: list[str]):
        self.options, self.events = options, _Events(channels, options.get("mode", "PERMISSIVE").upper())
        self.limit, self.folder, self.at = int(options.get("eventsPerBatch", 0)), options.get("progress"), None
        self.part, self.parts = int(options.get("part", 0)), int(options.get("parts", 1))
        if not 0 <= self.part < self.parts:
            raise ValueError("part is a number from 0 to parts - 1")
        if self.limit and not self.folder:
            raise ValueError("eventsPerBatch needs a folder as progress")

    def initialOffset(self) -> dict:
        return {"stamp": -1, "path": "", "event": 0}

    def _noted(self) -> dict:
        files, place = fcs.filesystem(self.folder)
        try:
            with files.open_input_stream(f"{place}/end.json") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return self.initialOffset()

    def _note(self, end: dict) -> None:
        files, place = fcs.filesystem(self.folder)
        files.create_dir(place, recursive=True)
        with files.open_output_stream(f"{place}/_end.json") as f:
            f.write(json.dumps(end).encode())
        files.move(f"{place}/_end.json", f"{place}/end.json")

    def _span(self, path: str) -> tuple[int, int]:
        """First event of this query's part of a file, and the next part's."""
        try:
            n = fcs.read_header(fcs.Remote(path)).n_events
        except (ValueError, OSError):
            n = 0
        return (n * self.part // self.parts, n * (self.part + 1) // self.parts) if n else (0, int(self.part == 0))

    def _count(self, path: str) -> int:
        first, last = self._span(path)
        return last - first

    def _from(self, start: dict) -> list[tuple[Found, int]]:
        """(file, events taken of it) from an offset on."""
        key = (start["stamp"], start["path"])
        files = sorted(list_files(self.options["path"]))
        return [(f, start["event"] if (f.stamp, f.path) == key else 0) for f in files if (f.stamp, f.path) >= key]

    def latestOffset(self) -> dict:
        if not self.limit:
            files = sorted(list_files(self.options["path"]))
            return {"stamp": files[-1].stamp, "path": files[-1].path, "event": self._count(files[-1].path)} if files else self.initialOffset()
        end, left = self.at or self._noted(), self.limit
        for file, taken in self._from(end):
            n = self._count(file.path)
            step = min(left, n - taken)
            if step > 0:
                end, left = {"stamp": file.stamp, "path": file.path, "event": taken + step}, left - step
            if not left:
                break
        return end

    def partitions(self, start: dict, end: dict) -> list[Slices]:
        self.at = end
        if self.folder:
            self._note(end)
        out, last, step = [], (end["stamp"], end["path"]), int(self.options.get("eventsPerTask", 4 * CHUNK))
        for file, taken in self._from(start):
            key = (file.stamp, file.path)
            if key > last:
                break
            first, stop = self._span(file.path)
            upto = first + end["event"] if key == last else stop
            out += [Slices([Slice(file.path, first=i, last=min(i + step, upto))]) for i in range(first + taken, upto, step)]
        return out

    def read(self, partition: Slices) -> Iterator[pa.RecordBatch]:
        return self.events.read(partition.slices)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class FcsWriter(DataSourceArrowWriter):
    """Each sample as ``path``/sample_id + ``suffix``.fcs, once the whole job is done.

    Rows come by sample, in event order; a row without an event number, first of its sample, brings the file's keywords. With a column ``place`` rows are not events
    but runs of them that other tasks have written there (``_write_runs``), under their first event's number, of ``n`` events. Tasks write below a
    folder of the job and of their attempt, so that nothing of a killed or repeated attempt gets a final name; ``commit`` moves the files that the job counts and
    ``abort`` removes all. Files that are there are replaced only in the mode ``overwrite``, those of ``inputs`` (paths or folders, parted by commas) never.
    """

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.folder, self.suffix, self.overwrite = options["path"].rstrip("/"), options.get("suffix", ""), overwrite
        self.columns = [f.name for f in schema if f.name not in ("sample_id", "event_idx", "keywords")]
        self.runs = "place" in self.columns
        self.names = json.loads(options["channels"]) if "channels" in options else self.columns
        self.spillover, self.inputs = options.get("spillover"), [x for x in options.get("inputs", "").split(",") if x]
        self.job = f"{self.folder}/_temporary-{uuid.uuid4().hex}"
        if not self.runs and len(self.names) != len(self.columns):
            raise ValueError("there is one channel name for each column")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, place = fcs.filesystem(f"{self.job}/{uuid.uuid4().hex}")
        files.create_dir(place, recursive=True)
        out, now = [], None
        for batch in iterator:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            samples = batch.column(at["sample_id"]).to_pylist()
            edges = [0, *[i for i in range(1, len(samples)) if samples[i] != samples[i - 1]], len(samples)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if now is None or now.sample != samples[a]:
                    out += now.done() if now else []
                    now = _File(samples[a], files, f"{place}/{len(out)}", self)
                part = batch.slice(a, b - a)
                head = part.column(at["event_idx"]).is_null() if "keywords" in at else None
                if head is not None:
                    for words in part.column(at["keywords"]).filter(head).to_pylist():
                        now.keywords |= dict(words or [])
                    part = part.filter(pa.compute.invert(head))
                if self.runs:
                    for run in part.to_pylist():
                        now.take(run["place"], run["n"])
                    continue
                now.add(np.column_stack([part.column(at[c]).to_numpy(zero_copy_only=False) for c in self.columns]))
        return Written(out + (now.done() if now else []))

    def commit(self, messages: list[Written | None]) -> None:
        files, place = fcs.filesystem(self.folder)
        made = [f for m in messages if m for f in m.files]
        names = [name for name, _ in made]
        if len(set(names)) < len(names):
            raise ValueError("rows of a sample come from several tasks: deal them by sample_id")
        sources = {fcs.filesystem(f.path)[1] for x in self.inputs for f in list_files(x)}
        from pyarrow import fs as afs

        for name in names:
            final = f"{place}/{name}"
            if final in sources:
                raise ValueError(f"{final} is one of the files that the events come from")
            if not self.overwrite and files.get_file_info(final).type != afs.FileType.NotFound:
                raise ValueError(f"{final} is there already")
        for name, temporary in made:
            files.move(temporary, f"{place}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files, place = fcs.filesystem(self.job)
        from pyarrow import fs as afs

        if files.get_file_info(place).type != afs.FileType.NotFound:
            files.delete_dir(place)


class _File:
    """One sample's file: its events go to a file of their own, before which header and TEXT are put once their number is known."""

    def __init__(self, sample: str, files, place: str, writer: FcsWriter):
        self.sample, self.files, self.place, self.writer, self.keywords, self.n = sample, files, place, writer, {}, 0
        self.data, self.taken = files.open_output_stream(f"{place}.data"), []

    def take(self, place: str, n: int) -> None:
        """Events that lie at a place."""
        self.n += n
        self.taken.append(place)

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        self.data.write(np.ascontiguousarray(values, "<f4").tobytes())

    def done(self) -> list[tuple[str, str]]:
        self.data.close()
        if not self.n:  # a file has one event at least
            return []
        w, words = self.writer, self.keywords
        spill = w.spillover or next((words[k] for k in fcs.SPILL_KEYWORDS if words.get(k)), None)
        head = fcs.head_bytes(self.n, w.names, [words.get(f"$P{i + 1}S") for i in range(len(w.names))], words, spill)
        with self.files.open_output_stream(f"{self.place}.fcs") as out:
            out.write(head)
            for files, place in [(self.files, f"{self.place}.data"), *map(fcs.filesystem, self.taken)]:
                with files.open_input_stream(place) as data:
                    while part := data.read(8 << 20):
                        out.write(part)
        self.files.delete_file(f"{self.place}.data")
        return [(f"{self.sample}{w.suffix}.fcs", f"{self.place}.fcs")]


def _write_runs(folder: str, columns: list[str]):
    """A task's events, which come by sample and event number, as a file of 32-bit floats for each sample, below a folder of its attempt: (sample_id, event_idx, place, n)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, runs, now = f"{folder}/{uuid.uuid4().hex}", [], None
        files, place = fcs.filesystem(own)
        try:
            for batch in batches:
                encoded, a = pa.compute.run_end_encode(batch.column("sample_id")), 0
                for sample, b in zip(encoded.values.to_pylist(), encoded.run_ends.to_pylist(), strict=True):
                    part, a = batch.slice(a, b - a), b
                    if not runs or runs[-1]["sample_id"] != sample:
                        if now is None:
                            files.create_dir(place, recursive=True)
                        else:
                            now.close()
                        runs.append({"sample_id": sample, "event_idx": part.column("event_idx")[0].as_py(), "place": f"{own}/{len(runs)}", "n": 0})
                        now = files.open_output_stream(f"{place}/{len(runs) - 1}")
                    runs[-1]["n"] += len(part)
                    now.write(np.column_stack([part.column(c).to_numpy(zero_copy_only=False) for c in columns]).astype("<f4").tobytes())
        finally:
            if now is not None:
                now.close()
        yield pa.RecordBatch.from_pylist(runs, pa.schema([("sample_id", pa.string()), ("event_idx", pa.int64()), ("place", pa.string()), ("n", pa.int64())]))

    return write


class FcsDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fcs"

    def channels(self) -> list[str]:
        given = self.options.get("channels")
        if given:
            return json.loads(given) if given.startswith("[") else [c.strip() for c in given.split(",")]
        for f in list_files(self.options["path"]):
            try:
                return [c["name"] for c in fcs.read_header(fcs.Remote(f.path)).channels()]
            except (ValueError, OSError):
                continue
        return []

    def schema(self) -> str:
        if self.options.get("view", "events") == "files":
            return FILES
        return "path string, sample_id string, event_idx long, " + "".join(f"c{i} double, " for i in range(len(self.channels()))) + "error string"

    def reader(self, schema: StructType) -> FcsReader:
        return FcsReader(self.options, [] if self.options.get("view") == "files" else self.channels())

    def streamReader(self, schema: StructType) -> FcsStreamReader:
        return FcsStreamReader(self.options, self.channels())

    def writer(self, schema: StructType, overwrite: bool) -> FcsWriter:
        return FcsWriter(self.options, schema, overwrite)


def read_events(spark: SparkSession, path: str, channels: Sequence[str] | None = None, **options: str) -> DataFrame:
    """(path, sample_id, event_idx, c0..., error) of a file, folder or pattern."""
    register(spark)
    reader = spark.read.format("fcs").options(**options)
    return (reader.option("channels", json.dumps(list(channels))) if channels else reader).load(path)


def read_files(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """One row for each file: (path, sample_id, version, n_events, n_params, keywords, channels, error)."""
    register(spark)
    return spark.read.format("fcs").options(view="files", **options).load(path)


def stream_events(spark: SparkSession, path: str, channels: Sequence[str], **options: str) -> DataFrame:
    """The events of files that come into a folder, as a stream."""
    register(spark)
    return spark.readStream.format("fcs").options(channels=json.dumps(list(channels)), **options).load(path)


def save_events(
    events: DataFrame, panel: Panel, folder: str, keywords: dict[str, str] | None = None, originals: DataFrame | None = None, spillover: str | None = None, suffix: str = "", overwrite: bool = False, inputs: Sequence[str] = ()
) -> DataFrame:
    """Write each sample's events, in event order, as ``folder``/sample_id + suffix.fcs; returns (sample_id, n_events, path) of the files of these samples.

    ``keywords`` go into every file; ``originals`` (sample_id, keywords) gives each file its own, stains and ranges included. Events are ordered and written in ranges of
    samples and event numbers, so a large tube goes over many tasks; one task then puts a file's ranges one after the other, as bytes. Samples without events give no file.
    See ``FcsWriter`` for commit and refusals.
    """
    from pyarrow import fs as afs

    spark = events.sparkSession
    register(spark)
    columns, tasks = [f"c{i}" for i in range(len(panel.columns))], int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = events.where("event_idx IS NOT NULL").select("sample_id", F.col("event_idx").cast("long").alias("event_idx"), *[F.col(c).cast("double").alias(n) for c, n in zip(panel.columns, columns, strict=True)])
    own = F.coalesce(F.col("keywords"), F.create_map().cast("map<string,string>")) if originals is not None else F.create_map().cast("map<string,string>")
    more = F.create_map(*[F.lit(x) for kv in (keywords or {}).items() for x in kv]).cast("map<string,string>")
    heads = originals if originals is not None else events.select("sample_id").distinct()
    merged = F.map_concat(F.map_filter(own, lambda k, _: ~k.isin(*(keywords or {"": ""}))), more)
    heads = heads.select("sample_id", F.lit(None).cast("long").alias("event_idx"), merged.alias("keywords"), F.lit(None).cast("string").alias("place"), F.lit(None).cast("long").alias("n"))
    parts = f"{folder.rstrip('/')}/_temporary-{uuid.uuid4().hex}"
    try:
        ranges = rows.repartitionByRange(tasks, "sample_id", "event_idx").sortWithinPartitions("sample_id", "event_idx")
        runs = written(ranges.mapInArrow(_write_runs(parts, columns), "sample_id string, event_idx long, place string, n long"), "runs")
        runs = runs.select("sample_id", "event_idx", F.lit(None).cast("map<string,string>").alias("keywords"), "place", "n")
        dealt = runs.unionByName(heads).repartition(tasks, "sample_id").sortWithinPartitions("sample_id", F.col("event_idx").asc_nulls_first())
        writer = dealt.write.format("fcs").mode("overwrite" if overwrite else "append").option("channels", json.dumps(list(panel.channels))).option("suffix", suffix).option("inputs", ",".join(inputs))
        (writer.option("spillover", spillover) if spillover else writer).save(folder)
    finally:
        files, place = fcs.filesystem(parts)
        if files.get_file_info(place).type != afs.FileType.NotFound:
            files.delete_dir(place)
    there = events.select(F.concat("sample_id", F.lit(suffix)).alias("sample_id")).distinct()
    return read_files(spark, folder).join(there, "sample_id", "left_semi").select(F.expr(f"substring(sample_id, 1, length(sample_id) - {len(suffix)})").alias("sample_id"), "n_events", "path")
