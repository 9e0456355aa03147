"""Token ids in framed binary records, with an offset index for reads in any order.

A record: length of the payload (uint64), masked CRC-32 of those eight bytes, payload,
masked CRC-32 of the payload; all little-endian. The payload: 1 and the doc_id, or 0 and 0
without one (uint8, int64), the number of ids (uint64), the bytes of an id (uint8: 2 if the vocabulary fits,
else 4), the ids. The mask turns the checksum right by 15 bits and adds a constant, so that a checksum
of data that holds checksums isn't weak. The index beside each file has (flag, doc_id, offset, number of ids) for each record.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import textkit as tk
from .scratch import fresh_path, materialize, qualified
from .segments import SegmentEncoder

MASK = 0xA282EAD8  # fixed value of the record format
HEAD, PAYLOAD, INDEX = "<QI", "<BqQB", np.dtype([("flag", "u1"), ("doc_id", "<i8"), ("offset", "<u8"), ("n", "<u8")])
#: Segments encoded as one text.
TOGETHER = 1024
NO_IDS = np.zeros(0, np.int32)
_encoders: dict[str, SegmentEncoder] = {}


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))


def _space_cuts(data: np.ndarray) -> np.ndarray:
    """Before a space after a character that isn't white space; white space of more bytes counts as such."""
    edge = np.zeros(len(data), bool)
    if len(data) < 4:
        return edge
    one = ~tk.IS_SPACE[data]
    two = np.concatenate([[np.uint8(0)], data[:-1]])
    three = np.concatenate([[np.uint8(0)] * 2, data[:-2]])
    wide = (data >= 0x80) & ((two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3) & np.isin(two, [0x80, 0x81, 0x9A])))
    edge[1:] = (data[1:] == 32) & (one & ~wide)[:-1]
    return edge


def _encoder(path: str) -> SegmentEncoder:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        vocabulary = tokenizer.get_vocab()
        token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a byte-level token has a character for each byte
        for token, i in vocabulary.items():
            token_bytes[i] = len(token)
        for i, added in tokenizer.get_added_tokens_decoder().items():  # these stand in texts as they are
            token_bytes[i] = len(added.content.encode())
            if " " in added.content:
                raise ValueError(f"the added token {added.content!r} has a space, where segments are cut")

        def encode(pieces: list[bytes]) -> list[np.ndarray]:
            texts = [p.decode() for p in pieces]
            # pieces that may stand one after another are encoded together, and their ids are parted by bytes
            row = [i for i, x in enumerate(texts) if x[0] == " " and not x[-1].isspace()]
            rows = [row[at : at + TOGETHER] for at in range(0, len(row), TOGETHER)]
            rows += [[i] for i, x in enumerate(texts) if x[0] != " " or x[-1].isspace()]
            out: list[np.ndarray] = [NO_IDS] * len(pieces)
            for at in range(0, len(rows), 256):
                some = rows[at : at + 256]
                for own, found in zip(some, tokenizer.encode_batch_fast(["".join([texts[i] for i in r]) for r in some], add_special_tokens=False), strict=True):
                    ids = np.array(found.ids, np.int32)
                    ends, upto = np.cumsum([len(pieces[i]) for i in own]), np.cumsum(token_bytes[ids])
                    cut = np.searchsorted(upto, ends)
                    if not np.array_equal(upto[cut], ends):
                        raise ValueError("a token spans two segments: the tokenizer isn't byte-level, or splits in another way")
                    start = 0
                    for i, stop in zip(own, (cut + 1).tolist(), strict=True):
                        out[i] = ids[start:stop]
                        start = stop
            return out

        _encoders[path] = SegmentEncoder(encode, _space_cuts)
    return _encoders[path]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _write(tokenizer: str, end_id: int, wide: int, uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, encoder = TaskContext.get(), _encoder(tokenizer)
        part = context.partitionId()
        files, folder = _filesystem(uri)
        files.create_dir(folder, recursive=True)
        own = f"{folder}/attempt-{part:05d}-{context.taskAttemptId()}"
        offset = docs = tokens = 0
        with files.open_output_stream(f"{own}.rec") as out, files.open_output_stream(f"{own}.idx") as index:
            for batch in batches:
                ids = batch.column(0)
                known, values = np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0))
                for row, off, data in tk.blocks(batch.column(1)):
                    found, first = encoder.block(off, data)
                    entries = np.zeros(len(off) - 1, INDEX)
                    chunk = []
                    for i in range(len(entries)):
                        seq = np.append(found[first[i] : first[i + 1]], end_id)
                        width = wide if seq.max() <= 0xFFFF else 4
                        head = (int(known[row + i]), int(values[row + i]))
                        record = frame(struct.pack(PAYLOAD, *head, len(seq), width) + seq.astype(f"<u{width}").tobytes())
                        entries[i] = (*head, offset, len(seq))
                        chunk.append(record)
                        offset += len(record)
                        tokens += len(seq)
                    docs += len(entries)
                    out.write(b"".join(chunk))
                    index.write(entries.tobytes())
        for kind_ in ("rec", "idx"):  # a second attempt puts the same file in place
            files.move(f"{own}.{kind_}", f"{folder}/part-{part:05d}.{kind_}")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([docs]), pa.array([tokens])], names=["part", "docs", "tokens"])

    return run


def records(stream, size: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each record of a stream of ``size`` bytes; raises ValueError on a wrong checksum."""
    at = 0
    while at < size:
        head = stream.read(struct.calcsize(HEAD))
        length, check = struct.unpack(HEAD, head)
        if masked(head[:8]) != check:
            raise ValueError(f"length at {at} is damaged")
        payload = stream.read(length)
        if masked(payload) != struct.unpack("<I", stream.read(4))[0]:
            raise ValueError(f"record at {at} is damaged")
        flag, doc_id, n, wide = struct.unpack_from(PAYLOAD, payload)
        yield (doc_id if flag else None), np.frombuffer(payload, f"<u{wide}", n, struct.calcsize(PAYLOAD))
        at += struct.calcsize(HEAD) + length + 4


def read_record(uri: str, part: int, row: int) -> tuple[int | None, np.ndarray]:
    """One record, found through the index."""
    files, folder = _filesystem(uri)
    with files.open_input_file(f"{folder}/part-{part:05d}.idx") as index:
        entry = np.frombuffer(index.read_at(INDEX.itemsize, row * INDEX.itemsize), INDEX)[0]
    with files.open_input_file(f"{folder}/part-{part:05d}.rec") as stream:
        stream.seek(int(entry["offset"]))
        return next(records(stream, 1))


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, vocabulary: int = 50257, uri: str | None = None) -> tuple[str, DataFrame]:
    """Encode whole texts and write them in ascending doc_id order; returns (folder, table of parts).

    A null text has the end id alone; null doc_ids come first and are written without one;
    rows that repeat a doc_id are all written, in the order of their texts (nulls first). Added tokens of the tokenizer that stand in a text
    get their own id, as in the library by default. Ids take two bytes up to a ``vocabulary`` of 65,536, else four; a record
    with a greater id than two bytes hold takes four in any case. Other columns are ignored; an empty table
    gives parts without records. Files are written by the tasks to ``uri`` (by default a new
    folder beside ``spark.checkpoint.dir``'s tables; without a scheme it is in Spark's default file system),
    under a name of the attempt, and then moved in place.
    """
    spark = docs.sparkSession
    uri = qualified(spark, uri or fresh_path(spark, "tokens"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    written = ordered.mapInArrow(_write(tokenizer, end_id, 2 if vocabulary <= 65536 else 4, uri), "part int, docs long, tokens long")
    return uri, materialize(written, "token-parts")


def read_token_files(uri: str, parts: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: start counts the ids of all records before.

    Only the totals of the parts, one row for each file, come to the driver.
    """
    totals = {r["part"]: r["tokens"] for r in parts.collect()}
    starts, at = {}, 0
    for part in sorted(totals):
        starts[part], at = at, at + totals[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _filesystem(uri)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                start, rows = starts[part], []
                name = f"{folder}/part-{part:05d}.rec"
                with files.open_input_stream(name, buffer_size=1 << 20) as stream:
                    for doc_id, ids in records(stream, files.get_file_info(name).size):
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    n = max(len(totals), 1)
    return parts.select("part").repartition(n, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])
