"""Blocks of documents that ask a distributed table by key, and get answers, in bulk.

A block is a few megabytes of whole texts, chosen by hash of the row and its place, so that copies of one row spread over all blocks.
The packed blocks are written to the shared folder once: all later passes see the same rows in the same order, also after an
executor is lost. For a table that grows with the corpus (n-gram counts, fingerprints of windows) a block sends its distinct sorted
keys, cut into buckets by key range, one blob for each bucket; a bucket's task merges the blobs of all blocks and answers each in its
own order. So a key that occurs everywhere travels once for each block, no key's occurrences are gathered, and no side is broadcast.

There are as many buckets as blocks, so a block sends as many rows as there are blocks, and at most one for each of its distinct keys: the
bytes grow with the corpus, the rows with its square until that bound is reached. `block_bytes` sets how early.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, releasing, slices

BLOCK_BYTES = 8 << 20
FLUSH_BYTES = 12 << 20
ROWS = "part int, key int, kind int, blob binary"
_KIND_DOCS = -1


def squeeze(a: np.ndarray) -> bytes:
    """An array of unsigned integers as compressed byte planes."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def unsqueeze(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def pack_sorted(*columns: np.ndarray) -> bytes:
    """A sorted uint64 array (kept as differences) and arrays beside it, each with its type."""
    first = np.diff(columns[0], prepend=np.uint64(0)).astype(np.uint64)
    parts = [squeeze(first), *(squeeze(c) for c in columns[1:])]
    return np.array([len(p) for p in parts], np.uint32).tobytes() + b"".join(parts)


def unpack_sorted(blob: bytes, *dtypes) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.uint32, len(dtypes) + 1)
    at, out = 4 * (len(dtypes) + 1), []
    for n, dtype in zip(sizes, (np.uint64, *dtypes)):
        out.append(unsqueeze(blob[at : at + int(n)], dtype))
        at += int(n)
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def row(part: int, key: int, kind: int, blob: bytes) -> tuple[int, int, int, bytes]:
    return part, key, kind, blob


def number_of_blocks(documents: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // block_bytes))


def packed(documents: DataFrame, n: int) -> DataFrame:
    """ROWS of kind -1: part is the block, blob the compressed rows that a task has for it. documents: any columns, with doc_id and text."""
    schema = documents.schema
    names = schema.names
    keyed = documents.withColumn("_block", F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(n)).cast("int"))

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def flush():
            all_rows = pa.Table.from_batches(held)
            order = pa.array(np.argsort(all_rows["_block"].to_numpy(), kind="stable"))
            all_rows = all_rows.take(order).combine_chunks()
            blocks = all_rows["_block"].to_numpy()
            cuts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])).tolist() + [len(blocks)]
            body = all_rows.select(names)
            out = []
            for a, b in zip(cuts, cuts[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, body.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(body.slice(a, b - a))
                out.append(row(int(blocks[a]), 0, _KIND_DOCS, sink.getvalue().to_pybytes()))
            return _batch(out)

        for part in slices(batches):
            held.append(part)
            size += part.nbytes
            if size > FLUSH_BYTES:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return materialise(keyed.mapInArrow(releasing(run), ROWS), "blocks")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [(), (), (), ()]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=["part", "key", "kind", "blob"])


def by_part(rows: DataFrame, n: int, work: Callable[[int, list[tuple[int, int, bytes]]], Iterable], schema: str = ROWS, make: Callable = _batch) -> DataFrame:
    """Brings the rows of each part together in one task and calls work(part, [(key, kind, blob)]); `make` turns its rows into a record batch."""

    def run(batches: Iterator[pa.RecordBatch]):
        name, held = None, []
        for batch in batches:
            for p, key, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "kind", "blob"))):
                if p != name:
                    if held:
                        yield make(list(work(name, held)))
                    name, held = p, []
                held.append((key, kind, blob))
        if held:
            yield make(list(work(name, held)))

    return rows.repartition(n, "part").sortWithinPartitions("part", "kind", "key").mapInArrow(releasing(run), schema)


def documents_of(held: list[tuple[int, int, bytes]]) -> pa.Table:
    """A block's documents, in an order that doesn't depend on tasks' timing: that of their packed bytes."""
    blobs = sorted(blob for _, kind, blob in held if kind == _KIND_DOCS)
    return pa.concat_tables([pa.ipc.open_stream(blob).read_all() for blob in blobs]).combine_chunks()


def bucket_bounds(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that sorted keys fall into, and where each begins in them (with the end)."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
    begins = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    return bucket[begins], np.append(begins, len(keys))


def ask(block: int, kind: int, n: int, keys: np.ndarray, *beside: np.ndarray) -> Iterator[tuple]:
    """Rows that send sorted keys, and arrays beside them, to their buckets."""
    buckets, cuts = bucket_bounds(keys, n)
    for b, i, j in zip(buckets.tolist(), cuts.tolist(), cuts[1:].tolist()):
        yield row(b, block, kind, pack_sorted(keys[i:j], *(c[i:j] for c in beside)))


def answers(held: list[tuple[int, int, bytes]], kind: int, dtype) -> np.ndarray:
    """The answers to a block, in the order of the keys that it had sent."""
    parts = [unsqueeze(blob, dtype) for _, k, blob in sorted(h for h in held if h[1] == kind)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)
