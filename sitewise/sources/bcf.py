"""Binary call format (BCF2): read records of many files, and write one.

A BGZF file is a series of gzip members, so a file is one task, which decompresses it and yields
its records as they come; many files run in parallel. Spark hands a task the whole compressed
file, which must stay under 2 GB.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ordered_file
from .vcf import file_numbers

MAGIC = b"BCF\2\2"

#: Type codes with their struct letters and missing and end-of-vector values.
TYPES = {1: ("b", -128, -127), 2: ("h", -32768, -32767), 3: ("i", -2147483648, -2147483647)}
FLOAT_MISSING, FLOAT_END = 0x7F800001, 0x7F800002


class _Cursor:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, fmt: str) -> tuple:
        out = struct.unpack_from(fmt, self.data, self.at)
        self.at += struct.calcsize(fmt)
        return out

    def kind(self) -> tuple[int, int]:
        (b,) = self.take("<B")
        n = b >> 4
        return b & 15, n if n < 15 else self.value()[0]

    def vector(self, kind: int, n: int):
        """A list with None for missing values, ended early by the end mark; text for type 7."""
        if kind == 0:
            return []
        if kind == 7:
            raw = self.take(f"<{n}s")[0]
            return raw.rstrip(b"\0").decode()
        if kind == 5:
            raw, out = self.take(f"<{n}I"), []
            for x in raw:
                if x == FLOAT_END:
                    break
                out.append(None if x == FLOAT_MISSING else struct.unpack("<f", struct.pack("<I", x))[0])
            return out
        letter, missing, end = TYPES[kind]
        out = []
        for x in self.take(f"<{n}{letter}"):
            if x == end:
                break
            out.append(None if x == missing else x)
        return out

    def value(self):
        return self.vector(*self.kind())


def dictionaries(header: str) -> tuple[list[str], list[str], list[str]]:
    """(strings, contigs, samples) that record numbers refer to; explicit IDX values win."""
    strings, contigs, samples = {"PASS": 0}, [], []
    for line in header.splitlines():
        if line.startswith("#CHROM"):
            samples = line.rstrip("\0").split("\t")[9:]
        m = re.match(r"##(FILTER|INFO|FORMAT|contig)=<.*?ID=([^,>]+)", line)
        if not m:
            continue
        if m[1] == "contig":
            contigs.append(m[2])
        elif m[2] not in strings:
            idx = re.search(r"IDX=(\d+)", line)
            strings[m[2]] = int(idx[1]) if idx else max(strings.values()) + 1
    out = [""] * (max(strings.values()) + 1)
    for k, i in strings.items():
        out[i] = k
    return out, contigs, samples


def _shown(v) -> str:
    if isinstance(v, str):
        return v or "."
    return ",".join("." if x is None else _number(x) if isinstance(x, float) else str(x) for x in v) or "."


def _number(x: float) -> str:
    """A 32-bit float as the shortest text that gives it back."""
    import numpy as np

    text = np.format_float_positional(np.float32(x), trim="-") if x == x and 1e-4 <= abs(x) < 1e16 or x == 0 else f"{x:g}"
    return text


def _framed(parts: Iterator[bytes]) -> Iterator[tuple[str, bytes, int]]:
    """(header, record, bytes of its shared part): a stream cut into records, which hold at most one part more."""
    held = b""

    def need(n: int) -> bool:
        nonlocal held
        while len(held) < n:
            more = next(parts, None)
            if more is None:
                return False
            held += more
        return True

    if not need(9) or held[:5] != MAGIC:
        raise ValueError("not a BCF2 file")
    (length,) = struct.unpack_from("<I", held, 5)
    need(9 + length)
    header, held = held[9 : 9 + length].rstrip(b"\0").decode(), held[9 + length :]
    yield header, b"", 0
    while need(8):
        shared, indiv = struct.unpack_from("<II", held)
        if not need(8 + shared + indiv):
            raise ValueError("the file ends inside a record")
        yield header, held[8 : 8 + shared + indiv], shared
        held = held[8 + shared + indiv :]


def record_lines(parts: Iterator[bytes]) -> Iterator[str]:
    """Text lines of a file's decompressed parts: the header, then the records in order."""
    strings = contigs = None
    for header, record, shared in _framed(parts):
        if strings is None:
            strings, contigs, _ = dictionaries(header)
            yield from header.splitlines()
            continue
        yield _record_text(record, shared, strings, contigs)


def _record_text(record: bytes, shared: int, strings: list[str], contigs: list[str]) -> str:
    c = _Cursor(record)
    chrom, pos, _, qual, counts, samples = c.take("<iiiIII")
    alleles, infos, formats, n = counts >> 16, counts & 0xFFFF, samples >> 24, samples & 0xFFFFFF
    id_ = c.value() or "."
    bases = [c.value() for _ in range(alleles)]
    filters = c.value()
    info = []
    for _ in range(infos):
        key = strings[c.value()[0]]
        v = c.value()
        info.append(key if not v and v != "" else f"{key}={_shown(v)}")
    keys, cells = [], [[] for _ in range(n)]
    c.at = shared
    for _ in range(formats):
        key = strings[c.value()[0]]
        kind, width = c.kind()
        keys.append(key)
        for cell in cells:
            v = c.vector(kind, width)
            if key == "GT":
                text = "".join(("" if i == 0 else "|" if x & 1 else "/") + ("." if x >> 1 == 0 else str((x >> 1) - 1)) for i, x in enumerate(y or 0 for y in v))
                cell.append(text or ".")
            else:
                cell.append(_shown(v))
    q = "." if qual == FLOAT_MISSING else _number(struct.unpack("<f", struct.pack("<I", qual))[0])
    fields = [contigs[chrom], str(pos + 1), id_, bases[0] if bases else ".", ",".join(bases[1:]) or ".", q, ";".join(strings[i] for i in filters) or ".", ";".join(info) or "."]
    return "\t".join(fields + ([":".join(keys)] + [":".join(x) for x in cells] if n else []))


def read_lines(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """(file_no, offset, line) as of text files: headers first, then records in order."""
    paths = [paths] if isinstance(paths, str) else list(paths)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for no, raw in zip(*(c.to_pylist() for c in b.columns)):
                parts = (raw[i : i + (1 << 20)] for i in range(0, len(raw), 1 << 20))
                if raw[:2] == b"\x1f\x8b":
                    parts = ordered_file.unblocked(parts)
                held, at = [], 0
                for line in record_lines(parts):
                    held.append(line)
                    if len(held) == 2_000:
                        yield pa.RecordBatch.from_pydict({"file_no": pa.array([no] * len(held), pa.int32()), "offset": pa.array(range(at, at + len(held)), pa.int64()), "line": held})
                        at, held = at + len(held), []
                if held:
                    yield pa.RecordBatch.from_pydict({"file_no": pa.array([no] * len(held), pa.int32()), "offset": pa.array(range(at, at + len(held)), pa.int64()), "line": held})

    files = spark.read.format("binaryFile").load(paths)
    numbers = file_numbers(spark, files.inputFiles(), paths)
    rows = files.select(F.input_file_name().alias("uri"), "content").join(F.broadcast(numbers), "uri")  # as many rows on the right as there are files
    return rows.select("file_no", "content").mapInArrow(run, "file_no int, offset long, line string")


def _head(kind: int, n: int) -> bytes:
    return bytes([n << 4 | kind]) if n < 15 else bytes([0xF0 | kind]) + _typed([n], 3)


def _typed(values: list, kind: int) -> bytes:
    return _head(kind, len(values)) + struct.pack(f"<{len(values)}{TYPES[kind][0]}", *values)


def _string(s: str) -> bytes:
    raw = b"" if s == "." else s.encode()
    return _head(7, len(raw)) + raw


def field_types(header: str) -> dict[tuple[str, str], str]:
    """The declared type of each INFO and FORMAT key."""
    return {(m[1], m[2]): m[3] for m in re.finditer(r"##(INFO|FORMAT)=<ID=([^,>]+).*?Type=(\w+)", header)}


def _numbers(texts: list[str], kind: str) -> list | None:
    """Values of a field with None for ``.``; None if some are not of the declared type."""
    try:
        return [None if x == "." else int(x) if kind == "Integer" else float(x) for x in texts]
    except ValueError:
        return None


def _vectors(rows: list[list], kind: str) -> bytes:
    """The type and the values of vectors that are filled up to one width with end marks."""
    width = max(1, max(map(len, rows)))
    if kind == "Float":
        word = lambda x: struct.pack("<I", FLOAT_MISSING) if x is None else struct.pack("<f", x)
        return _head(5, width) + b"".join(b"".join(map(word, r)) + struct.pack("<I", FLOAT_END) * (width - len(r)) for r in rows)
    flat = [x for r in rows for x in r if x is not None]
    low, high = min(flat, default=0), max(flat, default=0)
    code = next((k for k, (_, missing, _) in TYPES.items() if missing + 8 <= low and high < -missing), None)
    if code is None:  # beyond 32 bits: as text
        return _texts([",".join("." if x is None else str(x) for x in r) for r in rows])
    letter, missing, end = TYPES[code]
    return _head(code, width) + struct.pack(f"<{width * len(rows)}{letter}", *(v for r in rows for v in [missing if x is None else x for x in r] + [end] * (width - len(r))))


def _texts(rows: list[str]) -> bytes:
    raw = [r.encode() for r in rows]
    width = max(1, max(map(len, raw)))
    return _head(7, width) + b"".join(r.ljust(width, b"\0") for r in raw)


def _field(values: list[str], kind: str) -> bytes:
    """One value of each sample (or of the site): typed as declared, else as text."""
    numbers = [_numbers(v.split(","), kind) for v in values] if kind in ("Integer", "Float") else [None]
    return _texts(values) if any(n is None for n in numbers) else _vectors(numbers, kind)


def _genotypes(cells: list[str]) -> bytes:
    rows = [[((0 if a == "." else int(a) + 1) << 1) | (p == "|") for p, a in re.findall(r"([|/]?)([.\d]+)", c)] for c in cells]
    return _vectors(rows, "Integer")


def record_bytes(line: str, strings: dict[str, int], contigs: dict[str, int], types: dict[tuple[str, str], str]) -> bytes:
    """A text record as bytes: core columns, FILTER, and the INFO and FORMAT fields by their declared types."""
    f = line.split("\t")
    chrom, pos, id_, ref, alt, qual, filters, info = f[:8]
    bases = [ref] + ([] if alt == "." else alt.split(","))
    entries = [] if info == "." else [x.partition("=") for x in info.split(";")]
    n = max(0, len(f) - 9)
    keys = f[8].split(":") if n and f[8] != "." else []
    body = struct.pack("<iii", contigs[chrom], int(pos) - 1, len(ref)) + (struct.pack("<I", FLOAT_MISSING) if qual == "." else struct.pack("<f", float(qual)))
    body += struct.pack("<II", len(bases) << 16 | len(entries), len(keys) << 24 | n)
    body += _string(id_) + b"".join(map(_string, bases)) + (b"\0" if filters == "." else _typed([strings[x] for x in filters.split(";")], 3))
    for key, eq, value in entries:
        body += _typed([strings[key]], 3) + (_field([value], types.get(("INFO", key), "String")) if eq else b"\0")
    cells, indiv = [c.split(":") for c in f[9:]], b""
    for i, key in enumerate(keys):
        values = [c[i] if i < len(c) else "." for c in cells]
        indiv += _typed([strings[key]], 3) + (_genotypes(values) if key == "GT" else _field(values, types.get(("FORMAT", key), "String")))
    return struct.pack("<II", len(body), len(indiv)) + body + indiv


def write_bcf(lines: DataFrame, header: str, path: str, level: int = 6) -> int:
    """One ordered BGZF file; ``lines`` has site_id and line. A key that the header lacks raises."""
    names, contig_names, _ = dictionaries(header)
    strings, contigs, types = {s: i for i, s in enumerate(names)}, {c: i for i, c in enumerate(contig_names)}, field_types(header)
    raw = header.encode() + b"\0"
    head = MAGIC + struct.pack("<I", len(raw)) + raw
    return ordered_file.write(lines.select("site_id", "line"), path, ("site_id",), lambda line: record_bytes(line, strings, contigs, types), head, True, level)
