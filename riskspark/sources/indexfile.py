"""Data source ``posting_files``: compressed index files, written and read in parallel.

A file is one zlib stream: a little-endian count of documents, a label byte for each, and
for each token, in order, its length and bytes, its number of postings, and (document,
score) pairs. The writer compresses runs of tokens apart from each other and lists where
they begin in a file beside it: any inflater reads the stream as a whole, and this reader
gives the runs of a large file to several tasks. A file without such a list is one task,
read in pieces.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "token string, doc_id long, score int, label int"
#: More postings than this end a file, postings of a token that are kept.
MOST_ENTRY, KEPT_POSTINGS = 100_000, 100
#: Bytes of entries that are compressed together, and of compressed runs that a task reads.
RUN_BYTES, SPLIT_BYTES, PIECE = 1 << 20, 1 << 27, 1 << 20
POSTING = np.dtype([("doc", "<u4"), ("score", "<u2")])
HEAD, LIST, HIDDEN = b"\x78\xda", ".runs", "_staged-"
#: What an empty last deflate block looks like.
END = b"\x03\x00"


def store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def joined_adler(a: int, b: int, size_b: int) -> int:
    """The checksum of two byte strings one after the other, from theirs."""
    base = 65521
    low_a, high_a, low_b, high_b = a & 0xFFFF, a >> 16, b & 0xFFFF, b >> 16
    low = (low_a + low_b - 1) % base
    high = (high_a + high_b + size_b * (low_a - 1)) % base
    return high << 16 | low


def run_of(entries: bytes) -> bytes:
    """A run that is inflated without what is before it."""
    z = zlib.compressobj(9, zlib.DEFLATED, -15)
    return z.compress(entries) + z.flush(zlib.Z_FULL_FLUSH)


def entry(token: str, postings: np.ndarray) -> bytes:
    raw = token.encode()
    return struct.pack("<H", len(raw)) + raw + struct.pack("<I", len(postings)) + postings.tobytes()


def entries(pieces: Iterator[bytes], at: int = 0) -> Iterator[tuple[str, np.ndarray]]:
    """Tokens and their postings; the first entry that cannot be right ends them."""
    held = b""

    def filled(n: int) -> bool:
        nonlocal held, at
        while len(held) - at < n:
            more = next(pieces, b"")
            if not more:
                return False
            held, at = held[at:] + more, 0
        return True

    while filled(2):
        n = int.from_bytes(held[at : at + 2], "little")
        if not n or not filled(6 + n):
            return
        token = held[at + 2 : at + 2 + n].decode("utf-8", "replace")
        count = int.from_bytes(held[at + 2 + n : at + 6 + n], "little")
        if not 0 < count <= MOST_ENTRY or not filled(6 + n + 6 * count):
            return
        yield token, np.frombuffer(held, POSTING, count, at + 6 + n)
        at += 6 + n + 6 * count


def inflated(f, wbits: int, stop: int | None = None) -> Iterator[bytes]:
    """The bytes of a stream in pieces; a broken one ends where it breaks."""
    z = zlib.decompressobj(wbits)
    while not z.eof and (stop is None or f.tell() < stop):
        data = f.read(PIECE if stop is None else min(PIECE, stop - f.tell()))
        if not data:
            return
        try:
            while data:
                yield z.decompress(data, 8 * PIECE)
                data = z.unconsumed_tail
        except zlib.error:
            return


@dataclass
class Part(InputPartition):
    """A file (``begin`` None), or some of its runs, and where its first run ends."""

    path: str
    begin: int | None
    end: int | None
    head_end: int | None


class PostingFiles(DataSource):
    """``spark.read.format("posting_files")``, and ``df.write`` of rows in token order."""

    @classmethod
    def name(cls) -> str:
        return "posting_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite, int(self.options.get("runBytes", RUN_BYTES)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[InputPartition]:
        files, at = store(self.path)
        info = files.get_file_info(at)
        found = [info] if info.is_file else files.get_file_info(pafs.FileSelector(at, allow_not_found=True))
        sizes = {f.path: f.size for f in found if f.is_file and not f.base_name.startswith(("_", "."))}
        parts: list[InputPartition] = []
        for path, size in sorted(sizes.items()):
            if path.endswith(LIST):
                continue
            if path + LIST not in sizes:
                parts.append(Part(path, None, None, None))
                continue
            with files.open_input_stream(path + LIST) as f:
                runs = json.loads(f.read())
            begin = first = runs[0] if runs else size
            for end in [*runs[1:], size]:
                if end - begin >= self.split_bytes or end == size:
                    parts.append(Part(path, begin, end, first))
                    begin = end
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        files, _ = store(self.path)
        with files.open_input_file(partition.path) as f:
            if partition.begin is None:
                pieces = inflated(f, 15)
            else:
                f.seek(len(HEAD))
                pieces = inflated(f, -15, partition.head_end)
            head = b""
            while len(head) < 4 or len(head) < 4 + int.from_bytes(head[:4], "little"):
                more = next(pieces, b"")
                if not more:
                    return
                head += more
            n = 4 + int.from_bytes(head[:4], "little")
            labels = np.frombuffer(head[4:n], "u1")
            if partition.begin is not None:
                f.seek(partition.begin)
                pieces, head = inflated(f, -15, partition.end), head[:n]
            held, size = [], 0

            def batch() -> pa.RecordBatch:
                posted = np.concatenate([p for _, p in held])
                doc = posted["doc"].astype("i8")
                known = doc < len(labels)
                label = pa.array(labels[np.where(known, doc, 0)].astype("i4") if len(labels) else np.zeros(len(doc), "i4"), mask=~known)
                token = pa.array([t for t, _ in held]).take(pa.array(np.repeat(np.arange(len(held)), [len(p) for _, p in held])))
                return pa.RecordBatch.from_arrays([token, pa.array(doc), pa.array(posted["score"].astype("i4")), label], names=["token", "doc_id", "score", "label"])

            def rest() -> Iterator[bytes]:
                if head[n:]:
                    yield head[n:]
                yield from (p for p in pieces if p)

            for token, postings in entries(rest()):
                held.append((token, postings))
                size += len(postings)
                if size >= 1 << 16:
                    yield batch()
                    held, size = [], 0
            if held:
                yield batch()


@dataclass
class Written(WriterCommitMessage):
    staged: str
    name: str


class _Writer(DataSourceArrowWriter):
    """Each task writes a file of its own among staged ones; the commit puts those in
    place that tasks have reported, so one that is run twice counts once."""

    def __init__(self, path: str, overwrite: bool, run_bytes: int):
        self.path, self.overwrite, self.run_bytes, self.job = path.rstrip("/"), overwrite, run_bytes, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        files, at = store(self.path)
        task = TaskContext.get()
        name, staged = f"part-{task.partitionId():05}-{self.job[:8]}.bin", f"{at}/{HIDDEN}{self.job}/{task.taskAttemptId()}"
        files.create_dir(staged)
        runs: list[bytes] = []
        raw, adler, total = bytearray(), 1, 0
        labels = np.zeros(0, "u1")
        held: tuple[str, list[np.ndarray]] | None = None

        def close_run() -> None:
            nonlocal raw, adler, total
            runs.append(run_of(bytes(raw)))
            adler, total = zlib.adler32(raw, adler), total + len(raw)
            raw = bytearray()

        def close_token() -> None:
            raw.extend(entry(held[0], np.concatenate(held[1])))
            if len(raw) >= self.run_bytes:
                close_run()

        for batch in iterator:
            token, doc, score, label = (batch.column(batch.schema.get_field_index(c)) for c in ("token", "doc_id", "score", "label"))
            doc = doc.to_numpy(zero_copy_only=False).astype("i8")
            posted = np.empty(len(doc), POSTING)
            posted["doc"], posted["score"] = doc, np.minimum(score.to_numpy(zero_copy_only=False), 65_535)
            if len(doc) and (top := int(doc.max()) + 1) > len(labels):
                labels = np.append(labels, np.zeros(top - len(labels), "u1"))
            known = label.fill_null(0).to_numpy(zero_copy_only=False)
            labels[doc] = known
            names = token.to_pylist()
            cuts = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)] if names else [0]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if held is not None and held[0] != names[a]:
                    close_token()
                    held = None
                held = held or (names[a], [])
                held[1].append(posted[a:z])
        if held is not None:
            close_token()
        if raw:
            close_run()
        first = struct.pack("<I", len(labels)) + labels.tobytes()
        head = HEAD + run_of(first)
        sizes = [len(head), *map(len, runs)]
        with files.open_output_stream(f"{staged}/{name}") as f:
            for part in (head, *runs, END, struct.pack(">I", joined_adler(zlib.adler32(first), adler, total))):
                f.write(part)
        with files.open_output_stream(f"{staged}/{name}{LIST}") as f:
            f.write(json.dumps(np.cumsum(sizes)[:-1].tolist()).encode())
        return Written(staged, name)

    def commit(self, messages: list[Written | None]) -> None:
        files, at = store(self.path)
        new = {n for m in messages if m for n in (m.name, m.name + LIST)}
        for m in filter(None, messages):
            for name in (m.name + LIST, m.name):  # a file is never there without its list
                files.move(f"{m.staged}/{name}", f"{at}/{name}")
        if self.overwrite:
            for old in files.get_file_info(pafs.FileSelector(at)):
                if old.is_file and old.base_name not in new:
                    files.delete_file(old.path)
        self._clear(files, at)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*store(self.path))

    def _clear(self, files: pafs.FileSystem, at: str) -> None:
        staged = f"{at}/{HIDDEN}{self.job}"
        if files.get_file_info(staged).type != pafs.FileType.NotFound:
            files.delete_dir(staged)


def index_postings(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``token, doc_id, score, label`` of an index file or a folder of them."""
    spark.dataSource.register(PostingFiles)
    return spark.read.format("posting_files").option("splitBytes", split_bytes).load(path)


def write_postings(postings: DataFrame, path: str, files: int = 1, most: int | None = KEPT_POSTINGS, run_bytes: int = RUN_BYTES) -> None:
    """Write ``token, doc_id, score, label`` as ``files`` index files of token ranges; the best
    ``most`` postings of each token, ties by id, best first. A task holds what it has compressed."""
    postings.sparkSession.dataSource.register(PostingFiles)
    rows = postings.where(F.col("token").isNotNull() & (F.octet_length("token") < 1 << 16) & (F.col("token") != "")).select("token", "doc_id", "score", "label")
    if most is not None:
        w = Window.partitionBy("token").orderBy(F.col("score").desc(), "doc_id")
        rows = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")
    rows = rows.repartitionByRange(files, "token").sortWithinPartitions("token", F.col("score").desc(), "doc_id")
    rows.write.format("posting_files").option("runBytes", run_bytes).mode("overwrite").save(path)
