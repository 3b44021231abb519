"""Language identification by nearest centroids of normalised TF-IDF letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sliced

#: Hashed places of a vector.
PLACES = 1 << 12

#: Characters handled at once; longer texts are taken in blocks cut between words.
BLOCK = 1_000_000

_LETTERS = None


def _letters():
    """Whether each code point is a letter."""
    global _LETTERS
    if _LETTERS is None:
        import numpy as np

        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS


def _blocks(text: str) -> Iterator[str]:
    """Pieces of at most ``BLOCK`` characters, cut at a space where there is one."""
    at = 0
    while len(text) - at > BLOCK:
        cut = text.rfind(" ", at + 1, at + BLOCK)
        cut = cut if cut > 0 else at + BLOCK
        yield text[at:cut]
        at = cut
    yield text[at:]


def _count(texts: list[str], out) -> None:
    """Add hashed counts of letter 2- and 3-grams of each text to its row of ``out``.

    Runs of other characters count as one gap; n-grams may begin or end with a gap but
    not span one.
    """
    import numpy as np

    lengths = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    code = np.frombuffer("".join(f"\0{t}\0" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    doc = np.repeat(np.arange(len(texts)), lengths)
    letter = _letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    keep[np.cumsum(lengths)[:-1]] = True
    c, doc = np.where(letter, code, 0)[keep].astype(np.uint32), doc[keep]
    h1, h2, h3 = (c * np.uint32(k) for k in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))
    mix = lambda h: ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(20)
    two = (doc[:-1] == doc[1:]) & ((c[:-1] > 0) | (c[1:] > 0))
    three = two[:-1] & two[1:] & (c[1:-1] > 0)
    pair = h1[:-1] + h2[1:]
    for ok, h, d in ((two, mix(pair), doc[:-1]), (three, mix(pair[:-1] + h3[2:] + np.uint32(0x165667B1)), doc[:-2])):
        out += np.bincount(d[ok] * PLACES + h[ok], minlength=out.size).reshape(out.shape).astype(np.float32)


def count_vectors(texts: list[str]):
    """Matrix of raw n-gram counts, one row for each whole text (lower-cased)."""
    import numpy as np

    out, group, size, first = np.zeros((len(texts), PLACES), np.float32), [], 0, 0
    for i, t in enumerate(texts):
        t = t.lower()
        if len(t) > BLOCK:
            for piece in _blocks(t):
                _count([piece], out[i : i + 1])
            t = ""
        group.append(t)
        size += len(t)
        if size > BLOCK or i == len(texts) - 1:
            _count(group, out[first : i + 1])
            group, size, first = [], 0, i + 1
    return out


@dataclass
class Centroids:
    """Unit centroids, the language of each, the weights of the places, and reject limits."""

    languages: list[str]
    matrix: object
    idf: object
    limits: object

    def weigh(self, counts):
        import numpy as np

        v = np.log1p(counts) * self.idf
        norm = np.sqrt((v * v).sum(1, keepdims=True))
        return v / np.where(norm > 0, norm, 1)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, cosine and rejection of each text; ``und`` where it has no letter."""
        import numpy as np

        counts = count_vectors([t or "" for t in texts])
        empty = counts.sum(1) == 0
        if not len(self.languages):
            return [("und", 0.0, True)] * len(texts)
        cosine = np.clip(self.weigh(counts) @ self.matrix.T, 0, 1)
        best = cosine.argmax(1)
        return [
            ("und", 0.0, True) if e else (self.languages[b], float(cosine[i, b]), bool(cosine[i, b] < self.limits[b]))
            for i, (b, e) in enumerate(zip(best, empty))
        ]


def cluster(v, k: int, rounds: int = 12, seed: int = 7):
    """Unit centroids of at most ``k`` clusters of unit rows, by cosine k-means."""
    import numpy as np

    rng = np.random.default_rng(seed)
    at = [int(rng.integers(len(v)))]
    while len(at) < min(k, len(v)):  # the row farthest from the chosen ones
        at.append(int((v @ v[at].T).max(1).argmin()))
    c = v[at]
    for _ in range(rounds):
        own = (v @ c.T).argmax(1)
        c = np.stack([v[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit_centroids(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = 400, most: int = 8_000, clusters: int = 4, reject: float = 0.5) -> Centroids:
    """Centroids from a bounded sample: about ``sample`` texts a language, ``most`` in all.

    Rows are chosen by a hash of ``key``; rows with a null text or language, or without a
    letter, teach nothing. A text is rejected if its cosine is below ``reject`` times the
    cosine that all but one in 200 of the centroid's own training texts reach. Without
    rows there are no centroids, and every text is ``und``.
    """
    import numpy as np

    rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    each = min(sample, max(1, most // max(1, len(counts))))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, each / n)))]) if counts else None
    if share is None:
        return Centroids([], None, None, None)
    rows = rows.filter(F.pmod(F.xxhash64(F.col(key), F.lit(4)), F.lit(1_000_000)) < F.element_at(share, F.col(lang)) * 1_000_000)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in sliced(batches, 1):
            v = np.minimum(count_vectors(b.column(1).to_pylist()), 65_000).astype("<u2")
            yield pa.RecordBatch.from_pydict({"lang": b.column(0), "v": pa.array([x.tobytes() for x in v], pa.binary())})

    found = rows.select(F.col(lang).alias("lang"), text).mapInArrow(run, "lang string, v binary").collect()
    if not found:
        return Centroids([], None, None, None)
    counts_ = np.stack([np.frombuffer(bytes(r.v), "<u2") for r in found]).astype(np.float32)
    languages = np.array([r.lang for r in found])
    some = counts_.sum(1) > 0
    counts_, languages = counts_[some], languages[some]
    idf = np.log((1 + len(counts_)) / (1 + (counts_ > 0).sum(0))).astype(np.float32) + 1
    model = Centroids([], None, idf, None)
    v = model.weigh(counts_)
    names, parts, limits = [], [], []
    for name in sorted(set(languages)):
        own = v[languages == name]
        c = cluster(own, clusters)
        names += [str(name)] * len(c)
        parts.append(c)
        limits += [reject * float(np.quantile((own @ c.T).max(1), 0.005))] * len(c)
    return Centroids(names, np.concatenate(parts).astype(np.float32) if parts else None, idf, np.array(limits))


def identify(docs: DataFrame, model: Centroids, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``.

    Whole texts count, in blocks. A text that is null or has no letter is ``und`` with
    score 0, and rejected; so is every text if the model knows no language. ``rejected``
    is set too if the nearest centroid is farther than the model's limit for it. Columns
    of ``docs`` with these names are replaced; repeated rows give repeated results.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    # at most 8 000 / clusters languages of 16 KB a centroid; 64 KB a language as it stands
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in sliced(batches, text):
            out = shared.value.predict(b.column(b.schema.get_field_index(text)).to_pylist())
            columns = [pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, *(f.name for f in added)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))
