"""Byte-level BPE: encoding by a segment tree over adjacent pair ranks, and decoding."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sliced

#: The pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pieces whose ids a worker keeps; later pieces are kept for one batch only.
CACHE = 400_000

_NONE = 1 << 62
_PLACE = (1 << 32) - 1


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves; the others take the characters from
    U+0100 on, in byte order.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256))
    return [chr(b) if b in plain else chr(256 + next(other)) for b in range(256)]


class PairTree:
    """Minimum segment tree over the ranks of adjacent pairs of one piece.

    A leaf holds ``rank << 32 | place`` of the pair that begins at its place, so that the
    root is the leftmost pair of the lowest rank. A merge updates three leaves, each in
    logarithmic time.
    """

    def __init__(self, keys: list[int]):
        self.size = size = 1 << max(0, (len(keys) - 1).bit_length())
        self.tree = tree = [_NONE] * size + keys + [_NONE] * (size - len(keys))
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

    def put(self, place: int, key: int) -> None:
        tree, i = self.tree, self.size + place
        tree[i] = key
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            if b < a:
                a = b
            if tree[i] == a:
                break
            tree[i] = a


class ByteBpe:
    """A byte-level BPE vocabulary read from a tokenizer file.

    ``encode`` gives the ids that the tokenizers library gives without added special
    tokens; strings of special tokens inside a text become their ids, as there.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.pairs = {(vocab[a] << 32 | vocab[b]): (rank << 32, vocab[a + b]) for rank, (a, b) in reversed([*enumerate(merges)])}
        symbols = byte_symbols()
        self.first = [vocab[s] for s in symbols]
        back = {s: b for b, s in enumerate(symbols)}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.cache: dict[str, bytes] = {}
        import regex

        self.split = regex.compile(PATTERN).findall
        longest = sorted(self.special, key=len, reverse=True)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")").split if longest else lambda t: [t]

    def merge(self, ids: list[int]) -> list[int]:
        """Merge the leftmost lowest-ranked pair until no adjacent pair can be merged."""
        n, pairs = len(ids), self.pairs
        if n < 2:
            return ids
        found = [pairs.get(ids[i] << 32 | ids[i + 1]) for i in range(n - 1)]
        tree = PairTree([p[0] | i if p else _NONE for i, p in enumerate(found)])
        after, before, put = [*range(1, n + 1)], [*range(-1, n)], tree.put
        while (top := tree.tree[1]) != _NONE:
            i = top & _PLACE
            j = after[i]
            ids[i] = pairs[ids[i] << 32 | ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            before[k] = i
            if j < n - 1:
                put(j, _NONE)
                p = pairs.get(ids[i] << 32 | ids[k]) if k < n else None
                put(i, p[0] | i if p else _NONE)
            else:
                put(i, _NONE)
            h = before[i]
            if h >= 0:
                p = pairs.get(ids[h] << 32 | ids[i])
                put(h, p[0] | h if p else _NONE)
        return [x for x in ids if x >= 0]

    def _piece(self, piece: str) -> bytes:
        import numpy as np

        first = self.first
        return np.array(self.merge([first[b] for b in piece.encode()]), "<i4").tobytes()

    def encode_bytes(self, text: str, extra: dict[str, bytes]) -> bytes:
        """Ids of the whole text as little-endian 32-bit integers; ``extra`` takes pieces beyond the cache."""
        cache, out = self.cache, []
        for k, part in enumerate(self.parts(text)):
            if k % 2:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            pieces = self.split(part)
            for p in set(pieces).difference(cache):
                if p not in extra:
                    (cache if len(cache) < CACHE else extra)[p] = self._piece(p)
            try:
                out.append(b"".join(map(cache.__getitem__, pieces)))
            except KeyError:
                out.append(b"".join([cache[p] if p in cache else extra[p] for p in pieces]))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        import numpy as np

        return np.frombuffer(self.encode_bytes(text, {}), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def bpe_round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the ids of each whole text and the text decoded from these ids.

    ``path`` is the tokenizer file, which every worker must have (it is part of the
    installed environment). A null text counts as empty: no ids, and an empty text decoded.
    Pieces are cached by worker up to a fixed number; beyond it they are encoded anew, so
    memory is bounded and results do not depend on the cache. Columns of ``docs`` named
    like ``ids`` or ``decoded`` are replaced; repeated rows give repeated results.
    """
    docs = docs.drop(ids, decoded)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bpe = load(path)
        for b in sliced(batches, text):
            extra: dict[str, bytes] = {}
            coded = [bpe.encode_bytes(x or "", extra) for x in b.column(b.schema.get_field_index(text)).to_pylist()]
            values = np.frombuffer(b"".join(coded), "<i4")
            ends = np.cumsum([0, *(len(x) // 4 for x in coded)])
            back = [bpe.decode(values[i:j].tolist()) for i, j in zip(ends, ends[1:])]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(back, pa.string())], names=[*b.schema.names, ids, decoded])

    return docs.mapInArrow(run, schema)


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> dict:
    """Columns ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of a round trip."""
    return {
        "n_tokens": F.size(ids).cast("bigint"),
        "ids_sha256": F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256),
        "decoded_sha256": F.sha2(F.col(decoded).cast("binary"), 256),
    }
