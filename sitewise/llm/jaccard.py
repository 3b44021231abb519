"""N-gram Jaccard self-join: MinHash candidates, Bayesian pruning, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few, sliced, stored

#: Words in a shingle, and the least similarity of a link.
WORDS, LEAST = 5, 0.8

#: MinHash values of 16 bits each; a band is four values in one 64-bit integer. Two texts at
#: similarity 0.8 share no band with probability (1 - 0.8^4)^32 = 5e-8.
BANDS, ROWS = 32, 4
VALUES = BANDS * ROWS

#: A pair is dropped once the posterior probability of similarity >= LEAST is below this.
TOLERANCE = 1e-9

#: Values compared at a time.
STEP = 16

#: Members of a block of a large bucket, and characters of text in it.
BLOCK, BLOCK_CHARS = 1024, 4_000_000

#: Bytes of a long text that are cut into shingles at a time.
PIECE = 1 << 20

_SPACE = bytes((9, 10, 11, 12, 13, 32))


@lru_cache(None)
def least_matches(least: float = LEAST, tolerance: float = TOLERANCE) -> list[int]:
    """For n = STEP, 2 STEP, ...: the fewest matching values of n that keep a pair.

    With a uniform prior the posterior of the similarity after m matches of n is
    Beta(m + 1, n - m + 1); its upper tail at ``least`` is a binomial sum.
    """
    from math import comb

    out = []
    for n in range(STEP, VALUES + 1, STEP):
        tail = lambda m: sum(comb(n + 1, i) * least**i * (1 - least) ** (n + 1 - i) for i in range(m + 1))  # noqa: E731, B023
        out.append(next(m for m in range(n + 1) if tail(m) >= tolerance))
    return out


@lru_cache(None)
def _odd(n: int, seed: int, bits: int):
    import numpy as np

    return np.random.default_rng(seed).integers(0, 1 << bits, n, dtype=np.uint64) | np.uint64(1)


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _powers(n: int):
    """Powers of an odd base modulo 2^64, and of its inverse, up to n."""
    import numpy as np

    base = 0x9E3779B97F4A7C15
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]), dtype=np.uint64)
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, pow(base, -1, 1 << 64), np.uint64)]), dtype=np.uint64)
    return up, down


def shingle_hashes(texts: list[bytes]):
    """(hashes, counts): 64-bit hashes of the word shingles of each text, text after text.

    A text of one to four words has one shingle, of all its words; one without words none.
    """
    import numpy as np

    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    table = np.ones(256, bool)
    table[list(_SPACE)] = False
    word = table[raw]
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = 1 << max(16, (len(raw)).bit_length())
    up, down = _powers(size)
    total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
    w = _mix((total[last] - total[first]) * down[first])
    upto = np.searchsorted(first, ends_of)  # words up to the end of each text
    n = np.diff(np.concatenate([[0], upto]))
    count = np.where(n == 0, 0, np.maximum(1, n - WORDS + 1))
    start = upto - n
    at = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
    end = np.repeat(upto, count)
    h = np.zeros(len(at), np.uint64)
    mult = _odd(WORDS, 3, 63)
    for j in range(WORDS):
        i = at + j
        inside = i < end
        h += np.where(inside, w[np.minimum(i, max(0, len(w) - 1))], np.uint64(0)) * mult[j] if len(w) else np.uint64(0)
    return _mix(h), count


def pieces(text: bytes) -> Iterator[bytes]:
    """A long text in parts of about ``PIECE`` bytes that have all its shingles and no others.

    Parts end between words, and each begins with the last words of the one before. A part with
    fewer words than a shingle is joined to the next.
    """
    import re

    gap, at, held = re.compile(rb"[\x20\x09-\x0d]"), 0, b""
    while at < len(text):
        found = gap.search(text, at + PIECE)
        end = found.start() if found else len(text)
        part, at = held + b" " + text[at:end], end
        words = part.rsplit(None, WORDS)
        if at < len(text):
            if len(words) <= WORDS and len(part.split(None, WORDS)) < WORDS:
                held = part
                continue
            if not text[at:].strip(_SPACE):  # nothing but white space is left
                at = len(text)
        yield part
        held = b" ".join(words[-(WORDS - 1) :])


def minima(hashes, counts):
    """The least of each of ``VALUES`` hash functions over the shingles of each text that has any."""
    import numpy as np

    some = counts > 0
    starts = (np.cumsum(counts) - counts)[some]
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((VALUES, len(starts)), np.uint32)
    a, b = _odd(VALUES, 1, 32).astype(np.uint32), _odd(VALUES, 2, 32).astype(np.uint32)
    buf = np.empty_like(x)
    for k in range(VALUES):
        np.multiply(x, a[k], out=buf)
        np.add(buf, b[k], out=buf)
        if len(starts):
            out[k] = np.minimum.reduceat(buf, starts)
    return out, some


def signatures(texts: list[bytes]):
    """Bands of each text with shingles: array (texts, BANDS) of 64-bit integers; and which have any.

    A text longer than a piece must be alone; its pieces are hashed one after another.
    """
    import numpy as np

    if len(texts) == 1 and len(texts[0]) > PIECE:
        parts = [minima(*shingle_hashes([p]))[0] for p in pieces(texts[0])]
        least = np.minimum.reduce([p for p in parts if p.shape[1]] or [np.empty((VALUES, 0), np.uint32)])
        some = np.array([least.shape[1] > 0])
    else:
        least, some = minima(*shingle_hashes(texts))
    low = ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    return np.ascontiguousarray(low.T).view(np.int64), some


def _sketch(docs: DataFrame) -> DataFrame:
    """Of each row: node (digest of the text), characters, bands; bands are null without words."""
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != "__t"), *T.StructType.fromDDL("__node binary, __chars long, __bands array<long>").fields])

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        for b in sliced(batches, "__t"):
            texts = [(t or "").encode() for t in b.column(b.schema.get_field_index("__t")).to_pylist()]
            node = [hashlib.sha256(t).digest()[:16] for t in texts]
            bands: list = [None] * len(texts)
            i = 0
            while i < len(texts):  # about a piece at a time; a longer text alone
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) < PIECE):
                    size += len(texts[j])
                    j += 1
                sig, some = signatures(texts[i:j])
                for k, s in zip(np.flatnonzero(some), sig):
                    bands[i + int(k)] = s
                i = j
            columns = [b.column(b.schema.get_field_index(f.name)) for f in schema.fields[:-3]]
            columns += [pa.array(node, pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def _grouped(batches: Iterator, columns: list[str]) -> Iterator:
    """(key, rows) of neighbouring rows with the same value in the first column."""
    key, rows = None, []
    for b in batches:
        for r in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in columns)):
            if r[0] != key:
                if rows:
                    yield key, rows
                key, rows = r[0], []
            rows.append(r)
    if rows:
        yield key, rows


def _survivors(left, right, band: int, same: bool):
    """Index pairs whose first common band is ``band`` and that the posterior keeps."""
    import numpy as np

    a, b = left.view(np.uint16).reshape(len(left), VALUES), right.view(np.uint16).reshape(len(right), VALUES)
    least, out = least_matches(), []
    for i0 in range(0, len(a), 128):
        ok = np.ones((min(128, len(a) - i0), len(b)), bool)
        if same:
            ok &= np.arange(len(b))[None, :] > np.arange(i0, i0 + len(ok))[:, None]
        for k in range(band):
            ok &= left[i0 : i0 + 128, k][:, None] != right[:, k][None, :]
        i, j = np.nonzero(ok)
        i += i0
        match = np.zeros(len(i), np.int32)
        for s, m in enumerate(least):
            if not len(i):
                break
            part = slice(s * STEP, (s + 1) * STEP)
            match = match + (a[i, part] == b[j, part]).sum(1)
            keep = match >= m
            i, j, match = i[keep], j[keep], match[keep]
        if len(i):
            out.append((i, j))
    return out


def _candidates(nodes: DataFrame) -> DataFrame:
    """Rows (task, left, rights): pairs that survive pruning, each once, in lists of at most a block;
    and for each task a row (task, needs) with the nodes of all its pairs, each once.

    A bucket of a band with more members or text than a block is split into g hashed
    blocks, and each pair of blocks is a task of its own: no task holds a whole bucket.
    """
    bands = nodes.select("node", "chars", F.posexplode("bands").alias("band", "value"))
    load = bands.groupBy("band", "value").agg(F.count("*").alias("n"), F.sum("chars").alias("c")).filter("n > 1")
    load = load.select("band", "value", F.greatest(F.ceil(F.col("n") / BLOCK), F.least(F.col("n"), F.ceil(F.col("c") / BLOCK_CHARS))).cast("int").alias("g"))
    members = bands.select("band", "value", "node").join(load, ["band", "value"])
    members = members.withColumn("own", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    members = members.select("node", "band", F.xxhash64("band", "value", lo, hi).alias("task"), "value", lo.alias("lo"), hi.alias("hi"), (F.col("own") != lo).alias("right"))
    rows = members.join(nodes.select("node", "bands"), "node")
    rows = rows.select(F.struct("task", "band", "value", "lo", "hi").alias("key"), "right", "node", "bands")
    rows = rows.repartition(F.col("key.task")).sortWithinPartitions("key", "right", "node")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def flat():
            for b in batches:
                yield pa.RecordBatch.from_pydict({"key": pa.array([tuple(x.values()) for x in b.column(0).to_pylist()], pa.list_(pa.int64())), "right": b.column(1), "node": b.column(2), "bands": b.column(3)})

        def batch(out):
            task, left, rights, needs = zip(*out) if out else ((), (), (), ())
            lists = pa.list_(pa.binary())
            return pa.RecordBatch.from_pydict({"task": pa.array(task, pa.int64()), "left": pa.array(left, pa.binary()), "rights": pa.array(rights, lists), "needs": pa.array(needs, lists)})

        out: list[tuple] = []
        for key, rows in _grouped(flat(), ["key", "right", "node", "bands"]):
            task, band, _, lo, hi = key
            sig = np.array([r[3] for r in rows], np.int64)
            cut = sum(not r[1] for r in rows) if lo != hi else len(rows)
            a, b, off = (sig, sig, 0) if lo == hi else (sig[:cut], sig[cut:], cut)
            used: set[int] = set()
            for i, j in _survivors(a, b, band, lo == hi):
                for k in np.unique(i):
                    own = [int(x) + off for x in j[i == k]]
                    out.append((task, rows[int(k)][2], [rows[x][2] for x in own], None))
                    used.update(own, (int(k),))
            if used:
                out.append((task, None, None, [rows[x][2] for x in sorted(used)]))
            if len(out) >= 1000:
                yield batch(out)
                out = []
        yield batch(out)

    return rows.mapInArrow(run, "task long, left binary, rights array<binary>, needs array<binary>")


def shingle_set(text: str, known: dict) -> frozenset:
    """The shingles of a text as numbers that ``known`` gives them; equal shingles, equal numbers."""
    import re

    w = re.split("[\x20\x09-\x0d]+", text.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    if w == [""]:
        return frozenset()
    return frozenset(known.setdefault(" ".join(w[i : i + WORDS]), len(known)) for i in range(max(1, len(w) - WORDS + 1)))


def shingle_array(text: str):
    """The distinct shingles of a long text in order, as 64-bit hashes: eight bytes each."""
    import numpy as np

    return np.unique(np.concatenate([np.unique(shingle_hashes([p])[0]) for p in pieces(text.encode())] or [np.empty(0, np.uint64)]))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Exact links: rows (a, b, links, docs), where b is null in rows that count links of a.

    ``texts`` has node, text and copies. A task gets the texts of its block once each. Rows
    with b are a spanning forest of the task's links, enough for components. Shingles are
    compared as they are; if one text of a pair is longer than a piece, by 64-bit hashes.
    """
    need = pairs.select("task", F.explode("needs").alias("node")).distinct()
    give = need.join(texts, "node").select("task", F.lit(0).alias("kind"), "node", "text", "copies", F.lit(None).cast("array<binary>").alias("rights"))
    ask = pairs.filter("left is not null").select("task", F.lit(1).alias("kind"), F.col("left").alias("node"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"), "rights")
    rows = give.unionByName(ask).repartition("task").sortWithinPartitions("task", "kind")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for _, rows in _grouped(batches, ["task", "kind", "node", "text", "copies", "rights"]):
            known: dict[str, int] = {}
            sets, arrays, copies, links, docs, parent = {}, {}, {}, {}, {}, {}
            long = {r[2] for r in rows if r[1] == 0 and len(r[3] or "") > PIECE}
            whole = {r[2]: r[3] or "" for r in rows if r[1] == 0} if long else {}

            def overlap(a, b):
                """(common shingles, shingles of both lists)"""
                if a not in long and b not in long:  # noqa: B023
                    return len(sets[a] & sets[b]), len(sets[a]) + len(sets[b])  # noqa: B023
                import numpy as np

                for x in (a, b):
                    if x not in arrays:  # noqa: B023
                        arrays[x] = shingle_array(whole[x])  # noqa: B023
                return len(np.intersect1d(arrays[a], arrays[b], assume_unique=True)), len(arrays[a]) + len(arrays[b])  # noqa: B023

            def root(x):
                while parent[x] != x:  # noqa: B023
                    parent[x] = parent[parent[x]]  # noqa: B023
                    x = parent[x]  # noqa: B023
                return x

            for _, kind, node, text, n, rights in rows:
                if kind == 0:
                    copies[node], links[node], docs[node], parent[node] = n, 0, 0, node
                    if node not in long:
                        sets[node] = shingle_set(text or "", known)
                    continue
                for other in rights:
                    common, both = overlap(node, other)
                    if common >= LEAST * (both - common) - 1e-9:
                        links[node] += 1
                        links[other] += 1
                        docs[node] += copies[other]
                        docs[other] += copies[node]
                        x, y = root(node), root(other)
                        parent[max(x, y)] = min(x, y)
            found = [x for x in links if links[x]]
            tree = [x for x in found if root(x) != x]
            yield pa.RecordBatch.from_pydict({
                "a": pa.array(found + tree, pa.binary()), "b": pa.array([None] * len(found) + [root(x) for x in tree], pa.binary()),
                "links": pa.array([links[x] for x in found] + [0] * len(tree), pa.int64()), "docs": pa.array([docs[x] for x in found] + [0] * len(tree), pa.int64()),
            })

    return rows.mapInArrow(run, "a binary, b binary, links long, docs long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node of each connected component of ``edges`` (a, b).

    Large-star and small-star rounds in turn, each stored, until nothing changes; the number
    of rounds grows with the logarithm of the graph. Nothing but counts comes to the driver.
    """
    pairs = stored(few(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), "edges")
    seen = None
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        pairs = stored(few(small), "edges")
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("label"))


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, class_id, copy_of, n_copies, n_links, n_linked_docs``.

    Words are runs of characters other than space and U+0009 to U+000D; a text is the set of
    its five-word shingles. Texts with Jaccard similarity of 0.8 or more are linked.
    ``copy_of`` is the least id with the very same text, ``n_copies`` the number of such rows
    (itself included); ``n_links`` counts linked different texts, ``n_linked_docs`` the rows
    that have them; ``class_id`` is the least id of the connected component.

    Equal texts are joined first, by digest. Different texts that share a band are compared
    by MinHash values, 16 at a time, until the posterior falls below the tolerance; what is
    left is verified on the shingles themselves. Texts without words (null, empty, blank)
    link to nothing and are classes of their own, row by row. The least id is the least that is
    not null; it is null where all ids of the class are. Repeated rows are copies of each other.
    Long texts are read in pieces. An empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("__id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__t"))
    sketch = stored(few(_sketch(rows)), "sketch")
    worded = sketch.filter("__bands is not null")
    # equal texts have equal bands: any row's will do, and copies are counted before they are shuffled
    firsts = worded.groupBy(F.col("__node").alias("node")).agg(F.min("__id").alias("rep"), F.count("*").alias("copies"), F.first("__chars").alias("chars"), F.first("__bands").alias("bands"))
    firsts = stored(few(firsts), "nodes")
    pairs = stored(few(_candidates(firsts)), "pairs")
    wanted = pairs.select(F.explode("needs").alias("node")).distinct().join(firsts.select("node", "rep", "copies"), "node")
    digest = F.substring(F.unhex(F.sha2("__t", 256)), 1, 16)
    texts = rows.withColumn("__node", digest).join(wanted, (F.col("__node") == F.col("node")) & F.col("__id").eqNullSafe(F.col("rep")))
    texts = texts.select("node", F.col("__t").alias("text"), "copies").dropDuplicates(["node"])
    links = stored(few(_verified(pairs, texts)), "links")
    degree = links.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"), F.sum("docs").alias("n_linked_docs"))
    label = components(links.filter("b is not null").select("a", "b"))
    of = firsts.select("node", "rep", "copies").join(label, "node", "left").select("node", "rep", "copies", F.coalesce("label", "node").alias("label"))
    least = of.groupBy("label").agg(F.min("rep").alias("class_id"))
    of = of.join(least, "label").join(degree, "node", "left")
    out = sketch.select(F.col("__id"), F.when(F.col("__bands").isNotNull(), F.col("__node")).alias("node")).join(of, "node", "left")
    none = F.lit(0).cast("long")
    return out.select(
        F.col("__id").alias(doc_id), F.coalesce("class_id", "__id").alias("class_id"), F.coalesce("rep", "__id").alias("copy_of"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("n_copies"), F.coalesce("n_links", none).alias("n_links"), F.coalesce("n_linked_docs", none).alias("n_linked_docs"),
    )
