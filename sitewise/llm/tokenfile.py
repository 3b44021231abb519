"""Token ids in Arrow stream files: equal-length sequences and masks, read without copies.

A data set is a folder of shards. A shard has two Arrow IPC streams: ``*.arrow`` with
record batches of fixed-size lists (``input_ids``, unsigned, and ``mask``, one bit for each
position, false only where the last sequence is padded), and ``*.docs.arrow`` with the
document ids, first positions and lengths. All batches of a shard have the same number of
sequences (``BATCH``) but the last, so that sequence i is row i % BATCH of batch i // BATCH:
a view into the mapped file.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, stored

#: Sequences in a record batch.
BATCH = 64

#: Words, and stems of words, whose ids a worker keeps; later ones are kept for one view only.
CACHE = 400_000

#: Stems that the library is given in one text, and texts in one call.
JOINED = 200

#: Rows of a view that is encoded at a time; ``sliced`` bounds its bytes.
VIEW = 4096

#: Tokenizers of this kind encode a word as its lower-case letters, then the marks after them.
STEMS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"

_MANIFEST = "shard int, path string, docs long, tokens long"


class WordEncoder:
    """The tokenizers library behind a cache of words.

    For a tokenizer that drops white space and never merges across it, the ids of a text
    are the ids of its words in order; each distinct word goes through the library once.
    Texts with control characters that the two libraries split differently, or with ``<|``
    as special tokens begin, go through the library whole. Arrow splits texts, tells the distinct
    words of a view and strings their ids together: Python sees each of them once a view.

    A tokenizer as in ``STEMS`` has the ids of a word of Latin letters with ASCII marks behind it
    (no apostrophe) as those of its lower-case stem and those of the marks. Each distinct stem goes
    through the library once, many in one text: a stem ends with the only token that ends words.
    Such stems need no normalizer and no expression to part them, so ``plain`` is the library with
    the same model and without both.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json
        import re

        import numpy as np
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib, self.cache, self.stems = Tokenizer.from_file(path), {}, {}
        self.lib.no_truncation()
        self.lib.no_padding()
        self.latin = re.compile("[a-zß-öø-įı-ɏ]+").fullmatch
        self.dtype = "<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4"
        said, self.last = json.loads(self.lib.to_str()), None
        suffix = said["model"].get("end_of_word_suffix")
        if suffix and not said["model"].get("dropout") and all(said[k] == x for k, x in STEMS.items()):
            vocab = self.lib.get_vocab()
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for x, i in vocab.items() if x.endswith(suffix)]] = True
            self.plain = Tokenizer(self.lib.model)
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _ids(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        parts = (texts[i : i + JOINED] for i in range(0, len(texts), JOINED))
        return [np.array(e.ids, self.dtype).tobytes() for x in parts for e in self.lib.encode_batch_fast(x, add_special_tokens=False)]

    def _stems(self, stems: list[str]) -> dict[str, bytes]:
        import numpy as np

        out = {}
        for i in range(0, len(stems), JOINED):
            words = stems[i : i + JOINED]
            ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.dtype)
            ends = ((np.flatnonzero(self.last[ids]) + 1) * ids.itemsize).tolist()
            if len(ends) != len(words):
                out.update(zip(words, self._ids(words)))
                continue
            raw = ids.tobytes()
            out.update(zip(words, [raw[a:b] for a, b in zip([0, *ends], ends)]))
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words that are not in the cache."""
        if self.last is None or not words:
            return self._ids(words) if words else []
        low = "\n".join(words).lower().split("\n")
        stems = [w.rstrip(MARKS) for w in low]
        marks = [w[len(x) :] for w, x in zip(low, stems)]
        known = self.stems
        found = self._stems([*filter(self.latin, set(stems).difference(known))])
        known.update(islice(found.items(), max(0, CACHE - len(known))))
        ids = [found.get(x) if i is None else i for x, i in zip(stems, map(known.get, stems))]
        tails = [*set(marks) - {""}]
        after = dict(zip(["", *tails], [b"", *(self._ids(tails) if tails else [])]))
        out = [None if i is None else i + after[m] for i, m in zip(ids, marks)]
        odd = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(odd, self._ids([words[i] for i in odd]) if odd else ()):
            out[i] = x
        return out

    def pack(self, texts, end: bytes = b"") -> tuple:
        """Ids of the whole texts of an Arrow array and ``end`` behind each, as one string of little-endian
        integers of ``dtype``, and their numbers. A null text counts as empty."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        cache, texts = self.cache, pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, pattern="[\x1c-\x1f]|<\\|")
        odd = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        split = pc.utf8_split_whitespace(pc.if_else(whole, "", texts) if len(odd) else texts)
        last = np.cumsum(pc.list_value_length(split).to_numpy(), dtype="i8")
        words = split.flatten().dictionary_encode()
        seen = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = [*map(cache.get, seen)]
        new = [i for i, x in enumerate(ids) if x is None]
        fresh = [seen[i] for i in new]
        for i, x in zip(new, coded := self._words(fresh)):
            ids[i] = x
        cache.update(islice(zip(fresh, coded), max(0, CACHE - len(cache))))
        # behind the words of each text: its end, or all of its ids if it went through the library whole
        behind = np.full(len(texts), len(ids), "i4")
        behind[odd] += np.arange(1, len(odd) + 1, dtype="i4")
        ids += [end, *(self._ids([x])[0] + end for x in texts.take(pa.array(odd)).to_pylist())]
        order = np.insert(words.indices.to_numpy(), last, behind)
        found = pa.array(ids, pa.large_binary()).take(pa.array(order))
        at = np.frombuffer(found.buffers()[1], "i8")[np.concatenate([[0], last + np.arange(1, len(last) + 1)])]
        return memoryview(found.buffers()[2] or b"")[: at[-1]], np.diff(at) // np.dtype(self.dtype).itemsize

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text as little-endian integers of ``dtype``."""
        import numpy as np
        import pyarrow as pa

        raw, sizes = self.pack(pa.array(texts, pa.string()))
        ends = np.cumsum(sizes * np.dtype(self.dtype).itemsize).tolist()
        return [bytes(raw[a:b]) for a, b in zip([0, *ends], ends)]


_LOADED: dict[str, WordEncoder] = {}


def load(path: str) -> WordEncoder:
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class ShardWriter:
    """Packs documents into sequences of ``length`` ids and writes full batches as they come."""

    def __init__(self, path: str, length: int, dtype: str):
        import numpy as np
        import pyarrow as pa

        self.np, self.pa, self.length, self.dtype = np, pa, length, np.dtype(dtype)
        unsigned = pa.uint16() if self.dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("input_ids", pa.list_(unsigned, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])
        where, at = _filesystem(path)
        where.create_dir(os.path.dirname(at), recursive=True)
        self.sink, self.docs_sink = where.open_output_stream(at), where.open_output_stream(f"{at.removesuffix('.arrow')}.docs.arrow")
        self.out, self.docs_out = pa.ipc.new_stream(self.sink, self.schema), pa.ipc.new_stream(self.docs_sink, self.index)
        self.waiting, self.held, self.tokens, self.docs = [], 0, 0, 0

    def add(self, doc_ids, coded, sizes) -> None:
        """Arrow ids of documents, the token ids of all of them in one buffer, and the number of each."""
        np, pa = self.np, self.pa
        first = self.tokens + np.cumsum(sizes) - sizes
        self.docs_out.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(first), pa.array(sizes)], schema=self.index))
        self.docs += len(doc_ids)
        self.tokens += int(sizes.sum())
        self.waiting.append(coded)
        self.held += len(coded)
        if self.held >= BATCH * self.length * self.dtype.itemsize:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        np, pa, step = self.np, self.pa, BATCH * self.length
        ids = np.frombuffer(b"".join(self.waiting), self.dtype)
        full = len(ids) // step * step
        for i in range(0, len(ids) if last else full, step):
            part = ids[i : i + step]
            pad = -len(part) % self.length
            values, mask = np.concatenate([part, np.zeros(pad, self.dtype)]), np.ones(len(part) + pad, bool)
            mask[len(part) :] = False
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (values, mask)]
            self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        rest = b"" if last else ids[full:].tobytes()
        self.waiting, self.held = [rest], len(rest)

    def close(self) -> None:
        self._flush(True)
        for x in (self.out, self.docs_out, self.sink, self.docs_sink):
            x.close()


class Shard:
    """A written shard. Local files are mapped; others are read into one buffer."""

    def __init__(self, path: str):
        import pyarrow as pa
        from pyarrow import fs

        where, at = _filesystem(path)
        open_ = pa.memory_map if isinstance(where, fs.LocalFileSystem) else (lambda p: pa.BufferReader(where.open_input_file(p).read()))
        stream = pa.ipc.open_stream(open_(at))
        self.length, self.batches = stream.schema.field("input_ids").type.list_size, [*stream]
        self.docs = pa.ipc.open_stream(open_(f"{at.removesuffix('.arrow')}.docs.arrow")).read_all()

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def _column(self, name: str, batch: int):
        return self.batches[batch].column(name).flatten()

    def sequence(self, i: int):
        """Ids of sequence ``i``: a view, without a copy."""
        return self._column("input_ids", i // BATCH).slice(i % BATCH * self.length, self.length).to_numpy(zero_copy_only=True)

    def mask(self, i: int):
        return self._column("mask", i // BATCH).slice(i % BATCH * self.length, self.length)

    def ids(self, first: int, n: int):
        """Ids from position ``first`` on; a view if they lie in one batch."""
        import numpy as np

        step, parts = BATCH * self.length, []
        while n > 0:
            b, at = divmod(first, step)
            part = self._column("input_ids", b).slice(at, min(n, step - at)).to_numpy(zero_copy_only=True)
            parts.append(part)
            first, n = first + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, "u2")])


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, length: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id``, and write shards in ascending id order.

    Returns the stored manifest ``shard, path, docs, tokens``: shards follow each other in
    id order. ``folder`` must be one that all executors share. A task writes files named by
    shard and attempt, and only those of the attempt that succeeded are in the manifest, so
    a lost executor or a repeated task leaves no wrong shard. A null text counts as empty
    and yields the end id alone; null ids come first; rows with equal ids keep any order. An
    empty table gives an empty manifest. Memory: one batch of texts and one of sequences.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # rows with equal ids are dealt by a hash of their texts as well, so that no id is one task
    rows = rows.withColumn("__h", F.xxhash64("text")).repartitionByRange("doc_id", "__h").sortWithinPartitions("doc_id", "__h").drop("__h")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task, out = TaskContext.get(), None
        for b in sliced(batches, 1, VIEW):
            enc = load(tokenizer)
            if out is None:
                path = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.arrow"
                out, end = ShardWriter(path, length, enc.dtype), end_id.to_bytes(int(enc.dtype[2:]), "little")
            out.add(b.column(0), *enc.pack(b.column(1), end))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int32()), "path": [path], "docs": [out.docs], "tokens": [out.tokens]})

    return stored(rows.mapInArrow(run, _MANIFEST), "token-manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row for each document of the shards: ``doc_id, start, n_tokens, ids_crc32, shard``.

    ``start`` counts the ids of all documents before, over all shards. The manifest has one
    row for each written partition, and only it comes to the driver.
    """
    shards, start = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r.shard):
        shards.append((r.shard, r.path, start))
        start += r.tokens
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"
    if not shards:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        for b in batches:
            for no, path, start in zip(*(c.to_pylist() for c in b.columns)):
                shard = Shard(path)
                for d in shard.docs.to_batches():
                    doc, first, n = (c.to_pylist() for c in d.columns)
                    crc = [zlib.crc32(shard.ids(i, k).astype("<u4").tobytes()) for i, k in zip(first, n)]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(doc, pa.int64()), "start": pa.array([start + i for i in first], pa.int64()), "n_tokens": pa.array(n, pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()), "shard": pa.array([no] * len(doc), pa.int32()),
                    })

    return spark.createDataFrame(shards, "shard int, path string, start long").repartition(len(shards)).mapInArrow(run, schema)
