"""Toxicity by compression distance: windows compressed with dictionaries trained on toxic and on ordinary text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from heapq import nlargest
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hashed_sample, sliced, stored

#: Words in a window.
WINDOW = 8

#: Letters at the start of a word that are written as capitals, so that starts of words match only starts of words.
START = 5

#: Characters of the substrings whose counts tell the labels apart.
PART = 5

#: Windows whose savings count on their own: those that save most.
TOP = 3

#: Parts of the sample, each scored with dictionaries trained on the others, for calibration.
FOLDS = 5

#: Bytes of the content trained on ordinary and on toxic text.
ORDINARY, TOXIC = 2048, 1024

#: Both dictionaries end with this and every window begins with it: so each is compressed, never stored raw.
LEAD = bytes(range(1, 25))

#: What every window ends with: the compressor looks for no match in the last eight bytes.
TAIL = b"\0" * 8

#: Characters of a long text that are cut into words at a time.
BLOCK = 1 << 20

_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
_GAP = re.compile(r"\s")


@dataclass(frozen=True)
class Model:
    """``ordinary`` and ``toxic`` are dictionary contents; ``weights`` (first the constant) calibrate the savings."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...] = (-4.0, 0.0, 0.0, 0.0)

    def compressors(self):
        """(ordinary, toxic) compressors. Both have the ordinary content; where the toxic one has
        the toxic content, the other has as many bytes that no text contains, so that distances
        are the same. Frames have no optional fields, only lengths count."""
        import zstandard as z

        p = z.ZstdCompressionParameters(
            strategy=z.STRATEGY_LAZY2, min_match=6, window_log=16, hash_log=14, chain_log=14, search_log=6, target_length=32,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        out = []
        for content in (b"\xff" * len(self.toxic), self.toxic):
            d = z.ZstdCompressionDict(self.ordinary + content + LEAD, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            out.append(z.ZstdCompressor(compression_params=p, dict_data=d))
        return out

    def score(self, features):
        """Calibrated probabilities of rows of features."""
        import numpy as np

        w = np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(features @ w[1:] + w[0], -60, 60)))


def windows(text: str | None) -> Iterator[str]:
    """Windows of a whole text: words in lower case, their first letters as capitals."""
    held, i, text = [], 0, text or ""
    while i < len(text):
        gap = _GAP.search(text, i + BLOCK)  # words have no white space, so that none is cut
        end = gap.start() if gap else len(text)
        held += [w[:START].upper() + w[START:] for w in _WORD.findall(text[i:end].lower())]
        for k in range(0, len(held) - WINDOW + 1, WINDOW):
            yield f" {' '.join(held[k : k + WINDOW])} "
        del held[: len(held) - len(held) % WINDOW]
        i = end
    if held:
        yield f" {' '.join(held)} "


def saved_bytes(text: str | None, ordinary, toxic) -> tuple[int, int, int]:
    """What the toxic dictionary saves in the ``TOP`` windows where it saves most, what in all
    windows where it saves anything, and the number of windows."""
    n, saved = 0, []
    for w in windows(text):
        x, n = LEAD + w.encode("utf-8", "replace") + TAIL, n + 1
        if (s := len(ordinary.compress(x)) - len(toxic.compress(x))) > 0:
            saved.append(s)
    return sum(nlargest(TOP, saved)), sum(saved), n


def parts(text: str | None) -> set[str]:
    """The distinct substrings of ``PART`` characters inside the words of a text, a space at either end."""
    out: set[str] = set()
    for words in windows(text):
        for w in words.split():
            w = f" {w} "
            out.update([w[i : i + PART] for i in range(len(w) - PART + 1)])
    return out


def rest(word: str, telling: frozenset[str]) -> str:
    """What telling substrings cover of a word with a space at either end; all else is common."""
    out, end = [], 0
    for i in range(len(word) - PART + 1):
        if word[i : i + PART] in telling:
            out.append(word[max(i, end) : i + PART])
            end = i + PART
    return "".join(out)


def likelihood(a: int, b: int, na: int, nb: int) -> float:
    """Log-likelihood ratio of what ``a`` of na toxic and ``b`` of nb ordinary texts have."""
    def part(k: int, n: int, p: float) -> float:
        return (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if k < n else 0.0)

    p = (a + b) / (na + nb)
    return 2 * (part(a, na, a / na) + part(b, nb, b / nb) - part(a, na, p) - part(b, nb, p))


def _counts(rows: DataFrame, only: set[str] | None = None) -> dict[str, dict[int, int]]:
    """In how many texts of each fold a substring is; summed by task before the exchange."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found: Counter[tuple[str, int]] = Counter()
        for b in sliced(batches, 1):
            for fold, t in zip(*(c.to_pylist() for c in b.columns)):
                found.update((p, fold) for p in (parts(t) if only is None else parts(t) & only))
        yield pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in found], pa.string()), "fold": pa.array([f for _, f in found], pa.int32()), "n": pa.array(found.values(), pa.int64())})

    sums = rows.select("__fold", "__t").mapInArrow(run, "part string, fold int, n long").groupBy("part", "fold").agg(F.sum("n").alias("n"))
    of = sums.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("fold", "n"))).alias("n"), F.sum("n").alias("all"))
    return {r.part: r.n for r in of.filter("all >= 3").collect()} if only is None else {r.part: r.n for r in of.collect()}


def _telling(toxic: dict, ordinary: dict, sizes: dict[tuple[int, int], int], without: int, least: float = 15.0, lift: float = 4.0) -> frozenset[str]:
    """Substrings that tell toxic from ordinary texts, by the counts of all folds but one: a
    likelihood ratio of ``least``, and ``lift`` times the ordinary rate."""
    na, nb = (sum(n for (y, f), n in sizes.items() if y == kind and f != without) for kind in (1, 0))
    rest = lambda of: sum(n for f, n in of.items() if f != without)
    out = ((s, rest(of), rest(ordinary.get(s, {}))) for s, of in toxic.items())
    return frozenset(s for s, a, b in out if a and nb and a / na >= lift * b / nb and likelihood(a, b, na, nb) >= least)


def _trained(samples: Iterable[str], size: int, segment: int, part: int) -> bytes:
    """Content of a dictionary that the zstandard trainer makes of the samples, if they are more than fit."""
    import zstandard as z

    samples = [s.encode("utf-8", "replace") for s in samples]
    if sum(map(len, samples)) <= size:
        return b"".join(samples)
    try:
        return z.train_dictionary(size + 256, samples, k=segment, d=part, level=3).as_bytes()[-size:]
    except z.ZstdError:  # too few samples to train on: they are the content themselves
        return b"".join(samples)[-size:]


def _dictionaries(rows: DataFrame, sizes: dict[tuple[int, int], int], snippets: int) -> list[Model]:
    """Dictionaries of the sample without each fold in turn, and last of the whole sample."""
    toxic = _counts(rows.filter("__y = 1"))
    ordinary = _counts(rows.filter("__y = 0"), set(toxic))
    telling = [_telling(toxic, ordinary, sizes, k) for k in (*range(FOLDS), -1)]

    def cut(y: int, text: str, fold: int) -> Iterator[tuple[int, str, str]]:
        """(model, kind, string): whole windows of ordinary texts, for all models but one; of toxic
        ones what is left of a window, and the beginnings of the words it is from."""
        if not y:
            best = nlargest(snippets, ((crc32(w.encode("utf-8", "replace")), w) for w in windows(text)))
            yield from ((fold, "window", w) for _, w in best)
            return
        for w in windows(text):
            words = [f" {x} " for x in w.split()]
            for k, t in enumerate(telling):
                left = [(x, r) for x in words if k != fold and (r := rest(x, t))]
                if left:
                    yield k, "rest", "".join(r for _, r in left)
                    yield from ((k, "start", x[1 : START + 1]) for x, _ in left)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in sliced(batches, 1):
            out = sorted({x for row in zip(*(c.to_pylist() for c in b.columns)) for x in cut(*row)})
            yield pa.RecordBatch.from_pydict({n: pa.array([x[i] for x in out], pa.string() if i else pa.int32()) for i, n in enumerate("kts")})

    found = rows.select("__y", "__t", "__fold").mapInArrow(run, "k int, t string, s string").distinct().orderBy("k", "t", "s").collect()
    out = []
    for k in range(len(telling)):
        starts, toxic_ = ([r.s for r in found if r.k == k and r.t == kind] for kind in ("start", "rest"))
        starts = {f"{x.rstrip():{START}}" for x in starts}
        plain = {" ".join(x for x in r.s.split() if f"{x[:START]:{START}}" not in starts) for r in found if r.t == "window" and r.k != k}
        out.append(Model(_trained((f" {w} " for w in sorted(plain)), ORDINARY, 200, 8), _trained(toxic_, TOXIC, 24, 6)))
    return out


def _features(best, all_, n):
    """Rows of features: savings of the best windows, and the logarithms of all savings and of the number of windows."""
    import numpy as np

    return np.column_stack([np.array(best, float), np.log1p(np.array(all_, float)), np.log1p(np.array(n, float))])


def calibrate(features, labels, ridge: float = 1.0, rounds: int = 50) -> tuple[float, ...]:
    """Weights of a logistic curve (first the constant), by Newton's method on standardised
    features; the constant is such that the curve is one half at the best threshold."""
    import numpy as np

    mean, dev = features.mean(0), features.std(0)
    dev[dev == 0] = 1.0
    x = np.column_stack([np.ones(len(features)), (features - mean) / dev])
    pull, w = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)]), np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (p - labels) + pull @ w)
    slope = w[1:] / dev
    return (float(w[0] - slope @ mean - _threshold(x @ w, labels)), *map(float, slope))


def _threshold(z, labels) -> float:
    """Where to cut, for the best F1; halfway to the next value below."""
    import numpy as np

    order = np.argsort(-z, kind="stable")
    hit, last = np.cumsum(labels[order]), np.append(z[order][1:] < z[order][:-1], True)  # equal values fall on one side
    k = int(np.where(last, 2 * hit / (np.arange(1, len(z) + 1) + labels.sum()), -1).argmax())
    return float(z[order][k] + z[order][min(k + 1, len(z) - 1)]) / 2


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 4_000, snippets: int = 2, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Train both dictionaries and the calibration on a bounded sample of labelled rows.

    The bound: about ``sample`` rows of each label, chosen by a hash of the id, equal texts
    once. The zstandard trainer makes the ordinary dictionary of ``snippets`` windows of each
    ordinary text, chosen by a hash, and the toxic one of the windows of toxic texts from which
    all is taken out but the substrings whose counts tell toxic from ordinary texts. Words that
    begin like words of which anything is left are taken out of the ordinary windows. The toxic
    dictionary begins with the ordinary content, so that ordinary windows compress alike with
    both, and what a window saves is due to toxic text.

    The sample is in ``FOLDS`` parts, by a hash of the text. The savings of each part under
    dictionaries trained on the others, with the number of windows, calibrate a logistic curve
    and its threshold; the dictionaries of the model are trained on the whole sample. Without
    rows of both labels no window saves anything, and every text scores below one half.
    """
    import numpy as np

    labels = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).cast("int").alias("__y"))
    counts = {r[0]: r[1] for r in labels.groupBy("__y").count().collect()}
    some = [hashed_sample(labels.filter(F.col("__y") == y), doc_id, n, sample, seed=1) for y, n in counts.items()]
    if len(some) < 2:
        return Model(b"", b"")
    rows = docs.select(doc_id, text).join(F.broadcast(some[0].unionByName(some[1])), doc_id).filter(F.col(text).isNotNull())
    rows = rows.groupBy(F.col(text).cast("string").alias("__t")).agg(F.max("__y").alias("__y"))
    rows = stored(rows.withColumn("__fold", F.pmod(F.xxhash64("__t", F.lit(5)), F.lit(FOLDS)).cast("int")), "toxicity-sample")
    sizes = {(r[0], r[1]): r[2] for r in rows.groupBy("__y", "__fold").count().collect()}
    if len({y for y, _ in sizes}) < 2:
        return Model(b"", b"")
    models = _dictionaries(rows, sizes, snippets)
    found = _saved(rows.select("__y", "__fold", "__t"), models, "__t", "__fold").collect()
    weights = calibrate(_features(*zip(*((r.best, r.saved, r.n_windows) for r in found))), np.array([r[0] for r in found], float))
    return Model(models[-1].ordinary, models[-1].toxic, weights)


def _saved(df: DataFrame, models: list[Model], text: str, which: str | None = None) -> DataFrame:
    """``df`` without its text, with ``best``, ``saved``, ``n_windows`` and ``score`` by the last
    model, or by the one whose number is in column ``which``."""
    kept = [f for f in df.schema.fields if f.name != text]
    new = T.StructType.fromDDL("best long, saved long, n_windows long, score double")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        pairs = [m.compressors() for m in models]
        for b in sliced(batches, text):
            column = lambda name: b.column(b.schema.get_field_index(name))  # noqa: E731, B023
            numbers = column(which).to_pylist() if which else [-1] * b.num_rows
            best, all_, n = zip(*(saved_bytes(t, *pairs[k]) for k, t in zip(numbers, column(text).to_pylist())))
            score = np.where(np.array(n) > 0, models[-1].score(_features(best, all_, n)), 0.0)
            columns = [*(column(f.name) for f in kept), *(pa.array(x, pa.int64()) for x in (best, all_, n)), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), *new.names])

    return df.mapInArrow(run, T.StructType([*kept, *new.fields]))


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without its text column, with ``best``, ``saved``, ``n_windows``, ``score`` and ``predicted``.

    Every whole text is scored, window by window, a block of a long text at a time; the windows
    that save most decide, with the number of windows, so that a long clean text scores no higher
    for its length. Null and empty texts and texts without words have score 0. Columns of
    ``docs`` with these names are replaced; repeated rows give repeated results.
    """
    df = docs.drop("best", "saved", "n_windows", "score", "predicted").withColumn(text, F.col(text).cast("string"))
    return _saved(df, [model], text).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
