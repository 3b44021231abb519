"""One ordered local file from distributed rows: executors make its bytes, the driver appends them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

#: Bytes of data in a BGZF block.
BLOCK = 0xFF00

#: Bytes that a task hands on at a time.
CHUNK = 16 * BLOCK


def block(data: bytes, level: int = 6) -> bytes:
    """A BGZF block: a gzip member whose extra field ``BC`` holds its size."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    if len(body) > 0xFFFF - 26:  # data that do not compress
        c = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = c.compress(data) + c.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def blocks(data: bytes, level: int = 6) -> bytes:
    return b"".join(block(data[i : i + BLOCK], level) for i in range(0, len(data), BLOCK))


def unblocked(parts: Iterator[bytes]) -> Iterator[bytes]:
    """The data of a series of gzip members, of which BGZF blocks are a kind, as they come."""
    d = zlib.decompressobj(31)
    for raw in parts:
        while raw:
            out = d.decompress(raw)
            if out:
                yield out
            raw = d.unused_data
            if d.eof:
                d = zlib.decompressobj(31)


def write(rows: DataFrame, path: str, order: tuple[str, ...], make: Callable[..., bytes], head: bytes = b"", compressed: bool = False, level: int = 6) -> int:
    """Write ``head`` and then ``make(*row)`` of each row, in order; returns the number of rows.

    Rows are sorted over the whole table by range, so that partitions follow each other. Each
    task makes, and compresses, the bytes of its own partition in chunks; the driver takes the
    chunks a partition at a time and appends them. An empty table leaves the head alone.
    """
    columns = [c for c in rows.columns if c not in order]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, size, n = [], 0, 0

        def chunk():
            data = b"".join(held)
            return pa.RecordBatch.from_pydict({"bytes": pa.array([blocks(data, level) if compressed else data], pa.binary()), "n": pa.array([n], pa.int64())})

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(len(columns)))):
                held.append(make(*row))
                size, n = size + len(held[-1]), n + 1
                if size >= CHUNK:
                    yield chunk()
                    held, size, n = [], 0, 0
        if n:
            yield chunk()

    chunks = rows.orderBy(*order).select(*columns).mapInArrow(run, "bytes binary, n long")
    total = 0
    with open(path, "wb") as f:
        f.write(blocks(head, level) if compressed else head)
        for r in chunks.toLocalIterator(prefetchPartitions=True):
            f.write(bytes(r.bytes))
            total += r.n
        if compressed:
            f.write(block(b"", level))
    return total
