"""Token-id files with shuffled planes.

A file holds blocks of BLOCK ids. Each block is transposed into its four byte
planes (or 32 bit planes), each compressed by zstandard on its own; planes of
zeros take no room. Layout: magic, the planes, an Arrow footer with the chunk
index (``n, at, sizes`` of every block) and one with the documents (``key, n``),
then the places of both footers and the magic again. Any block can be read alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import TEXT_ROWS
from scanloom.llm.tokens import Encoder
from scanloom.session import cut, scratch_path

MAGIC = b"BPLANE01"
BLOCK = 65_536
#: Ids of one file; a document is never cut over two files.
FILE_IDS = 4_000_000


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [raw[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        raw = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            if p:
                raw[:, k] = np.frombuffer(p, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(planes):
            if p:
                bits[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


def _arrow(columns: dict[str, pa.Array]) -> bytes:
    sink, t = pa.BufferOutputStream(), pa.table(columns)
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def encode_file(keys: pa.Array, documents: list[bytes], kind: str = "byte", level: int = 3) -> bytes:
    """The file of documents given as id bytes."""
    squeeze = zstandard.ZstdCompressor(level=level)
    ids = np.frombuffer(b"".join(documents), "<u4")
    out, size, index = [MAGIC], len(MAGIC), {"n": [], "at": [], "sizes": []}
    for lo in range(0, len(ids), BLOCK):
        block = ids[lo : lo + BLOCK]
        planes = [squeeze.compress(p) if any(p) else b"" for p in to_planes(block, kind)]
        index["n"].append(len(block)), index["at"].append(size), index["sizes"].append([len(p) for p in planes])
        out += planes
        size += sum(map(len, planes))
    chunks = _arrow({"n": pa.array(index["n"], pa.int64()), "at": pa.array(index["at"], pa.int64()), "sizes": pa.array(index["sizes"], pa.list_(pa.int64()))})
    docs = squeeze.compress(_arrow({"key": keys, "n": pa.array([len(d) // 4 for d in documents], pa.int64())}))
    ends = np.array([size, size + len(chunks), size + len(chunks) + len(docs)], "<i8").tobytes()
    return b"".join([*out, chunks, docs, ends, MAGIC])


class PlaneFile:
    """Reads the format; ``blocks()`` decodes one block at a time."""

    def __init__(self, content: bytes) -> None:
        if content[:8] != MAGIC or content[-8:] != MAGIC:
            raise ValueError("not a plane file, or not whole")
        self.content = content
        a, b, c = np.frombuffer(content[-32:-8], "<i8").tolist()
        self.index = pa.ipc.open_stream(content[a:b]).read_all()
        self.documents = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(content[b:c])).read_all()

    def block(self, k: int) -> np.ndarray:
        open_ = zstandard.ZstdDecompressor()
        at, planes = self.index["at"][k].as_py(), []
        for size in self.index["sizes"][k].as_py():
            planes.append(open_.decompress(self.content[at : at + size]) if size else b"")
            at += size
        return from_planes(planes, self.index["n"][k].as_py())

    def blocks(self) -> Iterator[np.ndarray]:
        for k in range(self.index.num_rows):
            yield self.block(k)


def store_name(path: str) -> str:
    """The URI of a path as Spark writes it under the name that the readers in tasks know: Hadoop has names of its own for some stores."""
    scheme, _, rest = path.partition(":")
    if scheme in ("s3a", "s3n"):
        return f"s3:{rest}"
    if scheme == "dbfs":  # mounted on every machine
        return "file:///dbfs/" + rest.lstrip("/")
    return "file:///" + rest.lstrip("/") if scheme == "file" else path


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", kind: str = "byte", file_ids: int = FILE_IDS, partitions: int | None = None) -> DataFrame:
    """Encode all texts and write them below path in ascending key order.

    Returns the manifest ``part, roll, file, n_docs, n_ids, base`` (base: ids in all
    files before). Null and blank texts are the end id alone, null keys come
    first, rows that share a key come in the order of their texts' hashes, repeated rows as often as they are there; texts of any length
    are encoded whole, other columns are ignored, whatever their names. A task writes under a name of its own and renames it when whole, so a task that
    runs again after a lost executor replaces the same file.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task = TaskContext.get()
        part, roll, encoder = task.partitionId(), 0, Encoder.of(tokenizer, spaced=True)
        store, root = fs.FileSystem.from_uri(store_name(path))
        store.create_dir(root)
        keys: list[pa.Array] = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, held, size, roll
            name = f"part-{part:06d}-{roll:06d}.bpl"
            own = f"{root}/_{name}.{task.taskAttemptId()}"
            with store.open_output_stream(own) as out:
                out.write(encode_file(pa.concat_arrays(keys), held, kind))
            store.move(own, f"{root}/{name}")
            row = pa.RecordBatch.from_arrays([pa.array([part]), pa.array([roll]), pa.array([name]), pa.array([len(held)]), pa.array([size])], names=["part", "roll", "file", "n_docs", "n_ids"])
            keys, held, size, roll = [], [], 0, roll + 1
            return row

        for whole in batches:
            for lo in range(0, whole.num_rows, TEXT_ROWS):
                some = whole.slice(lo, TEXT_ROWS)
                for i, ids in enumerate(encoder.encode([t or "" for t in some.column(1).to_pylist()])):
                    own = ids + end
                    if held and size + len(own) // 4 > file_ids:
                        yield flush()
                    keys.append(some.column(0).slice(i, 1))
                    held.append(own)
                    size += len(own) // 4
        if held:
            yield flush()

    ordered = docs.select(F.col(key), F.col(text)).repartitionByRange(n, key).sortWithinPartitions(F.col(key), F.xxhash64(text))
    files = cut(ordered.mapInArrow(run, "part long, roll long, file string, n_docs long, n_ids long"))
    # One row a part, as many as the partitions asked for: small enough for one ordered window.
    before = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("roll")) - F.col("n_ids")
    return files.withColumn("inside", inside).join(F.broadcast(before), "part").select("part", "roll", "file", "n_docs", "n_ids", (F.col("before") + F.col("inside")).alias("base"))


def read_token_files(docs_type: str, path: str, spark, with_ids: bool = False) -> DataFrame:
    """``file, key, at, n, ids_crc32[, ids]`` of every document in the files below path (at: ids before it in its file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                f = PlaneFile(batch.column(1)[i].as_py())
                name = batch.column(0)[i].as_py().rsplit("/", 1)[-1]
                lengths = f.documents["n"].to_numpy()
                blocks, held, have = f.blocks(), [], 0
                crc, got = [], []
                for n in lengths.tolist():
                    while have < n:
                        held.append(next(blocks))
                        have += len(held[-1])
                    ids = np.concatenate(held) if len(held) > 1 else held[0]
                    own = ids[:n].tobytes()
                    crc.append(zlib.crc32(own))
                    if with_ids:
                        got.append(own)
                    held, have = [ids[n:]], have - n
                cols = [pa.array([name] * len(lengths)), f.documents["key"].combine_chunks(), pa.array(np.cumsum(lengths) - lengths), pa.array(lengths), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(got, pa.binary())] * with_ids, names=["file", "key", "at", "n", "ids_crc32"] + ["ids"] * with_ids)

    shape = f"file string, key {docs_type}, at long, n long, ids_crc32 long" + ", ids binary" * with_ids
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*.bpl").load(path).select("path", "content").mapInArrow(run, shape)


def token_index(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, key: str = "doc_id", text: str = "text", kind: str = "byte") -> DataFrame:
    """Write token files, read them back: ``key, start, n_tokens, ids_crc32`` of each document from them."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-files")
    manifest = cut(write_token_files(docs, path, tokenizer, end_id, key, text, kind))
    if not manifest.head(1):
        return spark.createDataFrame([], f"{key} {dict(docs.dtypes)[key]}, start long, n_tokens long, ids_crc32 long")
    rows = read_token_files(dict(docs.dtypes)[key], path, spark)
    return rows.join(manifest.select("file", "base"), "file").select(F.col("key").alias(key), (F.col("base") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32")
