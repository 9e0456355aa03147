"""FCS list-mode files: parsing, a Spark source that splits files by events, and a writer.

Files are listed by Spark; header and TEXT, and later the bytes of each range of events, are read by the tasks
through ``pyarrow.fs``, so that no task holds a whole file. Where only Spark can read a store, ``whole``
takes the files as ``binaryFile`` rows instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Panel
from ..operators.compensation import SPILL_KEYWORDS

if TYPE_CHECKING:  # loaded only where it's used, as each stream's process on the driver would hold it
    import pandas as pd

#: Header layout and limits of the format.
VERSIONS, HEADER, MOST_PARAMETERS = ("FCS2.0", "FCS3.0", "FCS3.1"), 58, 100_000
HEADER_MAX = 99_999_999
DELIMITERS = "\x0c|/\\\t\x1e"
META = "path string, version string, n_events long, n_params int, keywords map<string,string>, channels array<struct<index:int,name:string,label:string,range:double,bits:int>>, data_start long, error string"


class FcsError(ValueError):
    pass


@dataclass
class FcsText:
    """What the header and the TEXT segments say."""

    version: str
    keywords: dict[str, str]
    data_start: int
    data_end: int

    @property
    def n_params(self) -> int:
        return _whole(self.keywords, "$PAR")

    @property
    def n_events(self) -> int:
        return _whole(self.keywords, "$TOT")

    def channels(self) -> list[dict]:
        k = self.keywords
        return [{"index": i, "name": k.get(f"$P{i}N") or f"P{i}", "label": k.get(f"$P{i}S") or None, "range": _number(k.get(f"$P{i}R")), "bits": int(_number(k.get(f"$P{i}B")) or 32)} for i in range(1, self.n_params + 1)]

    def record(self) -> np.dtype:
        """Layout of one event."""
        order = [int(x) for x in self.keywords.get("$BYTEORD", "1,2,3,4").split(",") if x.strip()]
        if order not in (sorted(order), sorted(order, reverse=True)):
            raise FcsError("mixed byte order")
        end = ">" if len(order) > 1 and order[0] > order[-1] else "<"
        kind = self.keywords.get("$DATATYPE", "F").upper()
        if kind in "FD":
            codes = [f"{end}f{4 if kind == 'F' else 8}"] * self.n_params
        elif kind == "I":
            sizes = [c["bits"] for c in self.channels()]
            if any(b not in (8, 16, 32, 64) for b in sizes):
                raise FcsError("integer widths of 8, 16, 32 and 64 bits are read")
            codes = [f"{end}u{b // 8}" for b in sizes]
        else:
            raise FcsError(f"data type {kind}")
        return np.dtype([(f"f{i}", c) for i, c in enumerate(codes)])


def _whole(keywords: dict[str, str], name: str) -> int:
    try:
        return int(keywords[name])
    except (KeyError, ValueError) as e:
        raise FcsError(f"{name} is missing or no number") from e


def _number(text: str | None) -> float:
    try:
        return float(text) if text else 0.0
    except ValueError:
        return 0.0


def _offset(raw: bytes, strict: bool = True) -> int:
    text = raw.decode("latin-1").strip()
    if not text:
        return 0
    if text.isdigit():
        return int(text)
    if strict:
        raise FcsError(f"offset {text!r}")
    return 0


def parse_text(raw: bytes) -> dict[str, str]:
    """Keywords of a TEXT segment: the first byte parts them, doubled it stands for itself; later ones win."""
    if not raw:
        return {}
    mark = re.escape(raw[:1])
    parts = [p.replace(raw[:1] * 2, raw[:1]) for p in re.findall(b"((?:[^" + mark + b"]|" + mark * 2 + b")+)(?:" + mark + b"|$)", raw[1:], re.S)]
    text = [p.decode("utf-8", "replace").strip() for p in parts]
    return {k.upper(): v for k, v in zip(text[::2], text[1::2], strict=False)}


def read_header(raw: bytes, size: int | None = None) -> FcsText:
    """Parse header and TEXT of a file's bytes; ``size`` is the whole file's, if ``raw`` is its start."""
    size = size or len(raw)
    version = raw[:6].decode("latin-1")
    if version not in VERSIONS or len(raw) < HEADER:
        raise FcsError(f"not an FCS file: {version!r}")
    begin, end = _offset(raw[10:18]), _offset(raw[18:26])
    if not 0 < begin <= end < size:
        raise FcsError("TEXT lies outside the file")
    keywords = parse_text(raw[begin : end + 1])
    try:
        more = (int(keywords.get("$BEGINSTEXT", 0)), int(keywords.get("$ENDSTEXT", 0)))
        if 0 < more[0] <= more[1] < len(raw):
            keywords = parse_text(raw[more[0] : more[1] + 1]) | keywords
    except ValueError:
        pass
    start, stop = _offset(raw[26:34], False) or int(_number(keywords.get("$BEGINDATA"))), _offset(raw[34:42], False) or int(_number(keywords.get("$ENDDATA")))
    out = FcsText(version, keywords, start, stop)
    if not 1 <= out.n_params <= MOST_PARAMETERS:
        raise FcsError("$PAR out of range")
    if out.n_events and not 0 < start <= stop < size:
        raise FcsError("DATA lies outside the file")
    if out.n_events * out.record().itemsize > (stop - start + 1 if out.n_events else 0):
        raise FcsError("DATA is too short for $TOT events")
    return out


def decode(head: FcsText, data: bytes, first: int = 0, count: int | None = None) -> np.ndarray:
    """Events as doubles, integers under the mask of their range."""
    record = head.record()
    rows = np.frombuffer(data, record, head.n_events if count is None else count, first * record.itemsize)
    out = np.empty((len(rows), head.n_params))
    for i, c in enumerate(head.channels()):
        v = rows[f"f{i}"]
        if record[i].kind == "u" and c["range"] >= 1 and c["range"] == int(c["range"]) and c["range"] < 2.0 ** (8 * record[i].itemsize):
            v = v & v.dtype.type((1 << max(int(c["range"]) - 1, 0).bit_length()) - 1)
        out[:, i] = v
    return out


class Remote:
    """A file whose slices are read when they are asked for."""

    def __init__(self, path: str):
        files, place = filesystem(path)
        self.file = files.open_input_file(place)

    def __len__(self) -> int:
        return self.file.size()

    def __getitem__(self, part: slice) -> bytes:
        start, stop, _ = part.indices(len(self))
        return self.file.read_at(max(stop - start, 0), start)


def filesystem(uri: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _said(path: str, content) -> tuple:
    try:
        h = read_header(content)
        return path, h.version, h.n_events, h.n_params, h.keywords, h.channels(), h.data_start, None
    except (FcsError, OSError) as e:
        return path, None, None, None, None, None, None, str(e)


def read_metadata(spark: SparkSession, paths: str | list[str], whole: bool = False) -> DataFrame:
    """One row for each file, of its header and TEXT alone; a file that can't be read has its ``error`` and nothing else."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for pdf in batches:
            rows = [_said(path, bytes(pdf["content"].iloc[i]) if whole else Remote(path)) for i, path in enumerate(pdf["path"])]
            yield pd.DataFrame(rows, columns=["path", "version", "n_events", "n_params", "keywords", "channels", "data_start", "error"])

    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", *(["content"] if whole else [])).mapInPandas(run, META)


def peek_events(raw) -> int:
    """$TOT from the TEXT segment alone."""
    return _whole(parse_text(raw[_offset(raw[10:18]) : _offset(raw[18:26]) + 1]), "$TOT")


def peek_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, n_events): $TOT of each file, with no other check; null if it has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for pdf in batches:
            found = []
            for path in pdf["path"]:
                try:
                    found.append(peek_events(Remote(path)))
                except (FcsError, OSError):
                    found.append(None)
            yield pd.DataFrame({"path": pdf["path"], "n_events": pd.array(found, "Int64")})

    return spark.read.format("binaryFile").load(paths).select("path").mapInPandas(run, "path string, n_events long")


def events_schema(n_params: int) -> str:
    return "sample_id string, event_idx long, " + ", ".join(f"c{i} double" for i in range(n_params))


def _frame(path: str, head: FcsText, data: bytes, first: int) -> pd.DataFrame:
    import pandas as pd

    values = decode(head, data, 0, len(data) // head.record().itemsize)
    out = pd.DataFrame(values, columns=[f"c{i}" for i in range(head.n_params)])
    out.insert(0, "event_idx", np.arange(first, first + len(values)))
    out.insert(0, "sample_id", path.rsplit("/", 1)[-1].rsplit(".", 1)[0])
    return out


def decode_files(files: DataFrame, n_params: int, chunk: int = 65_536) -> DataFrame:
    """(sample_id, event_idx, c0..cN) of ``binaryFile`` rows of one panel; the sample is the file's stem.

    Events go out ``chunk`` at a time. A file that can't be read has no rows here; ``read_metadata`` says why.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                raw = bytes(content)
                try:
                    head = read_header(raw)
                except FcsError:
                    continue
                if head.n_params == n_params:
                    width = head.record().itemsize
                    for at in range(0, head.n_events, chunk):
                        yield _frame(path, head, raw[head.data_start + at * width : head.data_start + min(at + chunk, head.n_events) * width], at)

    return files.select("path", "content").mapInPandas(run, events_schema(n_params))


def decode_ranges(meta: DataFrame, n_params: int, chunk: int = 65_536) -> DataFrame:
    """The same from rows of ``read_metadata``: ranges of ``chunk`` events are dealt to tasks, which read their bytes alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, ranges in pdf.groupby("path"):
                remote = Remote(path)
                head = read_header(remote)
                width = head.record().itemsize
                for at in ranges["first"]:
                    yield _frame(path, head, remote[head.data_start + at * width : head.data_start + min(at + chunk, head.n_events) * width], at)

    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_events") - 1, F.lit(chunk).cast("long")))
    ranges = meta.where((F.col("n_params") == n_params) & (F.col("n_events") > 0)).select("path", starts.alias("first"))
    parts = int(meta.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(parts, "path", "first").mapInPandas(run, events_schema(n_params))


def read_panels(spark: SparkSession, paths: str | list[str]) -> tuple[dict[tuple[str, ...], tuple[Panel, DataFrame]], DataFrame]:
    """({channel names: (panel, events)}, rejected files). The distinct panels alone come to the driver, not the files."""
    meta = read_metadata(spark, paths).withColumn("names", F.transform("channels", lambda c: c["name"]))
    found = {}
    for (names,) in meta.where("error IS NULL").select("names").distinct().collect():
        files = meta.where(F.col("names") == F.array(*[F.lit(n) for n in names]))
        found[tuple(names)] = (Panel(tuple(names)), decode_ranges(files, len(names)))
    return found, meta.where("error IS NOT NULL").select("path", "error")


def samples(meta: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(path, sample_id, grp, n_events, n_params, error): the tubes of a listing; ``groups`` has (sample_id, grp), others have the group ""."""
    stem = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    out = meta.select("path", stem.alias("sample_id"), "n_events", "n_params", "error")
    out = out.join(groups, "sample_id", "left") if groups is not None else out.withColumn("grp", F.lit(""))
    return out.select("path", "sample_id", F.coalesce("grp", F.lit("")).alias("grp"), "n_events", "n_params", "error")


def info(meta: DataFrame) -> DataFrame:
    """What a file says of itself: version, counts, cytometer, date, channels, start of the spillover keyword."""
    k = lambda *names: F.coalesce(*[F.try_element_at("keywords", F.lit(n)) for n in names])
    spill = F.substring(k("$SPILLOVER", "SPILLOVER", "$SPILL", "SPILL"), 1, 80)
    return meta.select("path", "version", "n_events", "n_params", k("$CYT", "$CYTOMETER").alias("cytometer"), k("$DATE").alias("date"), F.transform("channels", lambda c: c["name"]).alias("channels"), spill.alias("spillover"))


def pick_delimiter(texts: list[str]) -> str:
    for d in DELIMITERS:
        if not any(d in t for t in texts):
            return d
    raise FcsError("no delimiter is free")


def head_bytes(n_events: int, names: list[str], labels: list[str | None] | None = None, keywords: dict[str, str] | None = None, spillover: str | None = None) -> bytes:
    """Header and TEXT of an FCS3.0 file of little-endian floats; other keywords are copied, sorted."""
    if not n_events:
        raise FcsError("no events")
    own = {"$PAR": str(len(names)), "$TOT": str(n_events), "$DATATYPE": "F", "$BYTEORD": "1,2,3,4", "$MODE": "L", "$NEXTDATA": "0"}
    for i, n in enumerate(names):
        top = (keywords or {}).get(f"$P{i + 1}R") or "262144"
        own |= {f"$P{i + 1}N": n, f"$P{i + 1}B": "32", f"$P{i + 1}E": "0,0", f"$P{i + 1}R": top} | ({f"$P{i + 1}S": labels[i]} if labels and labels[i] else {})
    if spillover:
        own |= {"$SPILLOVER": spillover, "SPILL": spillover}
    taken = {k for k in own} | {"$BEGINDATA", "$ENDDATA", "$BEGINANALYSIS", "$ENDANALYSIS", "$BEGINSTEXT", "$ENDSTEXT", "SPILLOVER", "$SPILL"}
    rest = {k: v for k, v in sorted((keywords or {}).items()) if k and v and k not in taken and not re.fullmatch(r"\$P\d+[A-Z]+", k)}
    mark, size = pick_delimiter([*own, *own.values(), *rest, *rest.values()]), 4 * n_events * len(names)

    def text(begin: int) -> bytes:
        where = {"$BEGINDATA": f"{begin:012d}", "$ENDDATA": f"{begin + size - 1:012d}", "$BEGINANALYSIS": "0", "$ENDANALYSIS": "0", "$BEGINSTEXT": "0", "$ENDSTEXT": "0"}
        return (mark + mark.join(x for kv in {**where, **own, **rest}.items() for x in kv) + mark).encode()

    begin = HEADER + len(text(0))
    ends = [HEADER, begin - 1, begin, begin + size - 1]
    places = [x if max(ends[2:]) <= HEADER_MAX or i < 2 else 0 for i, x in enumerate(ends)]
    return b"FCS3.0    " + b"".join(f"{x:>8d}".encode() for x in [*places, 0, 0]) + text(begin)


def to_bytes(values: np.ndarray, names: list[str], labels: list[str | None] | None = None, keywords: dict[str, str] | None = None, spillover: str | None = None) -> bytes:
    """A whole FCS3.0 file."""
    return head_bytes(len(values), names, labels, keywords, spillover) + np.ascontiguousarray(values, "<f4").tobytes()


def export_population(events: DataFrame, mask: Column, panel: Panel, originals: DataFrame, population: str, folder: str) -> DataFrame:
    """Raw events of one population, a file for each tube with the tube's own keywords; ``mask`` is that of compensated data."""
    from .fcs_source import save_events

    return save_events(events.where(mask), panel, folder, originals=originals, suffix="_" + re.sub(r"[^A-Za-z0-9._-]", "_", population))
