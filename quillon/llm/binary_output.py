"""Token ids as Arrow stream files of fixed-size lists.

A shard is one Arrow IPC stream file, written in the shared folder. Its rows are sequences of exactly
`seq_len` ids (FixedSizeList of uint16 for vocabularies of up to 65536 ids, else uint32) with a mask of the
same shape (FixedSizeList of bits, set for ids, not set for the padding of the shard's last row); all record batches but the last have the same number of rows,
so row i is row i % rows of batch i // rows, and a memory map gives any sequence or mask without a copy.
A second stream file beside it lists the shard's documents (doc_id, start within the shard, n_tokens).
Shards follow each other in ascending doc_id order; a manifest holds one row per shard.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.bpe import default_vocabulary, tokenizer
from quillon.llm.common import bounded_batches, needs, shared_path, table

SEQ_LEN = 2048
#: Sequences in one record batch.
BATCH_ROWS = 64
#: Documents a shard should hold; the number of shards grows with the table, up to what a manifest should list.
SHARD_DOCS, MOST_SHARDS = 4096, 20_000
#: doc_ids sampled for each shard, in expectation, to find the shards' borders.
SAMPLED = 64

MANIFEST = "shard int, path string, docs long, ids long"


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """A file system for a path in the shared folder: a mounted one, or an object store that Arrow knows."""
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return pa.fs.LocalFileSystem(), unquote(parsed.path)
    return pa.fs.FileSystem.from_uri(path)


def _fixed(values: np.ndarray, seq_len: int, kind: pa.DataType) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values, kind), seq_len)


class ShardWriter:
    """Writes one shard; holds at most one record batch of ids and the shard's list of documents.

    It writes under a name of its own and renames at the end, so a repeated or speculative task leaves
    whole files only.
    """

    def __init__(self, folder: str, shard: int, seq_len: int, batch_rows: int, kind: np.dtype):
        self.fs, base = file_system(folder)
        self.fs.create_dir(base, recursive=True)
        self.path, self.tmp = f"{base}/shard-{shard:06d}", f"{base}/.tmp-{shard:06d}-{uuid.uuid4().hex}"
        self.name, self.seq_len, self.room = f"{folder}/shard-{shard:06d}", seq_len, seq_len * batch_rows
        self.kind = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("ids", pa.list_(self.kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.out = self.fs.open_output_stream(f"{self.tmp}.arrow")
        self.stream = pa.ipc.new_stream(self.out, self.schema)
        self.held, self.n_held, self.n = [], 0, 0
        self.docs: list[tuple[int | None, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.n, len(ids)))
        self.n += len(ids)
        while len(ids):
            part, ids = ids[: self.room - self.n_held], ids[self.room - self.n_held :]
            self.held.append(part)
            self.n_held += len(part)
            if self.n_held == self.room:
                self._flush()

    def _flush(self) -> None:
        ids = np.concatenate(self.held)
        rows = -(-len(ids) // self.seq_len)
        mask = np.arange(rows * self.seq_len) < len(ids)
        ids = np.concatenate([ids, np.zeros(len(mask) - len(ids), dtype=ids.dtype)])
        self.stream.write_batch(pa.RecordBatch.from_arrays([_fixed(ids, self.seq_len, self.kind), _fixed(mask, self.seq_len, pa.bool_())], schema=self.schema))
        self.held, self.n_held = [], 0

    def close(self) -> tuple[str, int, int]:
        if self.n_held:
            self._flush()
        self.stream.close()
        self.out.close()
        keys, starts, counts = zip(*self.docs, strict=True) if self.docs else ((), (), ())
        index = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "start", "n_tokens"])
        with self.fs.open_output_stream(f"{self.tmp}.docs") as out, pa.ipc.new_stream(out, index.schema) as stream:
            stream.write_batch(index)
        self.fs.move(f"{self.tmp}.docs", f"{self.path}.docs.arrow")
        self.fs.move(f"{self.tmp}.arrow", f"{self.path}.arrow")
        return self.name, len(self.docs), self.n


class Shard:
    """Random access to a written shard; on a mounted folder by a memory map, without copies."""

    def __init__(self, name: str):
        fs, path = file_system(name)
        opened = (lambda p: pa.memory_map(p)) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file
        self.docs = pa.ipc.open_stream(opened(f"{path}.docs.arrow")).read_all()
        self.source = opened(f"{path}.arrow")
        self.batches = list(pa.ipc.open_stream(self.source))
        self.rows = len(self.batches[0]) if self.batches else 0

    def _values(self, batch: int) -> np.ndarray:
        return self.batches[batch].column(0).flatten().to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> tuple[pa.Array, pa.Array]:
        """Ids and mask of row i; views of the file."""
        b, r = divmod(i, self.rows)
        return self.batches[b].column(0)[r].values, self.batches[b].column(1)[r].values

    def ids(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from start on, as views: one a record batch."""
        per_batch = self.rows * self.batches[0].schema.field(0).type.list_size if self.batches else 1
        while n > 0:
            b, at = divmod(start, per_batch)
            part = self._values(b)[at : at + n]
            yield part
            start, n = start + len(part), n - len(part)


@dataclass
class Ranges:
    """Ranges of doc_id, and the shards of each: number of the first, and how many. Null counts as the least doc_id."""

    ends: np.ndarray
    first: np.ndarray
    shards: np.ndarray

    def shard(self, keys: pa.Array, rows: np.ndarray) -> np.ndarray:
        """The shard of each row by doc_id; the rows of a doc_id that fills several by their numbers."""
        r = np.searchsorted(self.ends, pc.fill_null(keys, _NULL).to_numpy(zero_copy_only=False), side="left")
        return (self.first[r] + rows % self.shards[r]).astype(np.int32)


_NULL = -(2**63)


def ranges_of(ids: DataFrame, shard_docs: int) -> Ranges:
    """Ranges of about shard_docs rows, by quantiles of a sample of SAMPLED ids a shard.

    A doc_id that stands at two quantiles or more is a range of its own, which is cut into as many shards as its rows fill.
    The sample, and then one count per range, reach the driver; no task merges anything.
    """
    n = ids.count()
    shards = max(1, min(-(-n // shard_docs), MOST_SHARDS))
    ends = np.empty(0, dtype=np.int64)
    if shards > 1:
        share = min(1.0, SAMPLED * shards / n)
        sample = np.sort(pc.fill_null((ids if share == 1 else ids.sample(share, seed=3)).toArrow()["doc_id"], _NULL).to_numpy())
        steps = sample[np.arange(1, shards) * len(sample) // shards] if len(sample) else ends
        values, times = np.unique(steps, return_counts=True)
        ends = np.unique(np.concatenate([values, np.maximum(values[times > 1], _NULL + 1) - 1]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ends) + 1, dtype=np.int64)
        for batch in batches:
            total += np.bincount(np.searchsorted(ends, pc.fill_null(batch.column(0), _NULL).to_numpy(zero_copy_only=False), side="left"), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["range", "n"])

    counts = np.zeros(len(ends) + 1, dtype=np.int64)
    for r in ids.mapInArrow(count, "range long, n long").groupBy("range").agg(F.sum("n").alias("n")).collect():
        counts[r["range"]] = r["n"]
    single = np.concatenate([ends[:1] == _NULL, np.diff(ends) == 1, [False]])[-len(counts) :]
    pieces = np.where(single, np.maximum(1, -(-counts // max(shard_docs, -(-n // MOST_SHARDS)))), 1)
    return Ranges(ends, np.cumsum(pieces) - pieces, pieces)


def write(docs: DataFrame, vocabulary: str, folder: str, end_id: int | None = 0, key: str = "doc_id", text: str = "text", seq_len: int = SEQ_LEN, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Encode every text, append end_id, write shards into folder; returns the manifest, one row per shard.

    Texts are encoded where they are read; then only ids move, two bytes each for small vocabularies.
    Shards are ranges of doc_id with about as many documents each. A task sorts one shard's documents (with spill) and streams
    them to its file. Null and empty texts hold end_id only, very long ones all their ids; null doc_ids come first; repeated rows
    are all written, rows of equal doc_id within a shard in the order of their ids. A doc_id, or null, whose rows fill several
    shards is dealt out to them by the rows' place in the table. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    narrow = needs(docs, key, text).select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), F.monotonically_increasing_id().alias("place"))
    ranges = ranges_of(narrow.select("doc_id"), shard_docs)
    shards = int(ranges.shards.sum())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary)
        end = b"" if end_id is None else np.array([end_id], dtype=bpe.dtype).tobytes()
        for batch in batches:
            shard = ranges.shard(batch.column(0), batch.column(2).to_numpy())
            ids = [bpe.encode_bytes(x.as_py()) + end for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column(0), pa.array(ids, pa.binary())], names=["shard", "doc_id", "ids"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, writer, current = tokenizer(vocabulary).dtype, None, None

        def closed() -> pa.RecordBatch:
            name, docs, ids = writer.close()
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([name]), pa.array([docs], pa.int64()), pa.array([ids], pa.int64())], names=["shard", "path", "docs", "ids"])

        for batch in batches:
            for shard, doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if shard != current:
                    if writer:
                        yield closed()
                    current, writer = shard, ShardWriter(folder, shard, seq_len, BATCH_ROWS, kind)
                writer.add(doc_id, np.frombuffer(ids.as_buffer(), dtype=kind))
        if writer:
            yield closed()

    encoded = narrow.mapInArrow(encode, "shard int, doc_id long, ids binary")
    dealt = encoded.repartitionById(shards, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    return dealt.mapInArrow(store, MANIFEST)


def read_digests(spark: SparkSession, manifest: list) -> DataFrame:
    """Reads shards back: (doc_id, start, n_tokens, ids_crc32), start counting the ids of all shards before.

    manifest: the rows that write() gave, one per shard; each shard is one task.
    """
    start, rows = 0, []
    for m in sorted(manifest, key=lambda m: m["shard"]):
        rows.append((m["shard"], m["path"], start))
        start += m["ids"]
    frame = spark.createDataFrame(rows, "shard int, path string, start long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                shard, crcs = Shard(name), []
                starts, counts = shard.docs["start"].to_numpy(), shard.docs["n_tokens"].to_numpy()
                for at, n in zip(starts.tolist(), counts.tolist(), strict=True):
                    crc = 0
                    for part in shard.ids(at, n):
                        crc = zlib.crc32(part.astype("<u4"), crc)
                    crcs.append(crc)
                docs = shard.docs.combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.array(docs["doc_id"].to_pylist(), pa.int64()), pa.array(starts + start), pa.array(counts), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return frame.repartition(max(1, len(rows)), "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "tokens")
    manifest = write(table(spark, sf_dir, "documents"), default_vocabulary(), folder).collect()  # one row per shard
    return read_digests(spark, manifest)


QUERIES = {"op8_binary_output": op8_binary_output}
ORACLE: dict[str, str] = {}
