"""Quality rules: base checks and a learned list of threshold conjunctions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample

_SPACE = r"[\x20\x09-\x0D]+"

#: Ratios that conditions may test; all are built from the counts of ``text_counts``.
FEATURES = {
    "symbol_ratio": "n_symbols / greatest(word_chars, 1)",
    "upper_ratio": "n_upper / greatest(word_chars, 1)",
    "digit_ratio": "n_digits / greatest(word_chars, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "n_words": "double(n_words)",
}


def _from(array: str, n: int) -> Column:
    """The array without its first ``n`` items; lambdas then need no index into it."""
    return F.slice(array, F.lit(n + 1), F.greatest(F.size(array), F.lit(0)))


def text_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with counts of each whole text; rows keep their order and partitions.

    Words are runs of characters other than space and U+0009 to U+000D. A null text has
    no words and counts of 0. ``n_repeat_words`` counts the words inside 5-word windows
    that the text holds twice or more; windows of one text are compared by a hash of 64
    bits. Columns of ``df`` named like a count are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("__t", t).withColumn("__w", F.array_remove(F.split("__t", _SPACE, -1), ""))
    df = df.withColumn("n_words", F.size("__w").cast("bigint")).withColumn("__j", F.array_join("__w", ""))
    df = df.withColumn("word_chars", F.length("__j").cast("bigint"))
    count = lambda kind: (F.length("__j") - F.length(F.regexp_replace("__j", kind, ""))).cast("bigint")
    lines = F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({
        "n_symbols": count(r"[#*$%&|<>]+"), "n_digits": count(r"[0-9]+"), "n_upper": count(r"\p{Lu}+"),
        "__l": lines, "__h": F.transform("__w", lambda w: F.xxhash64(w)),
    })
    df = df.withColumns({
        "n_lines": F.size("__l").cast("bigint"), "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint"),
        "__p": F.zip_with("__h", _from("__h", 1), lambda a, b: F.xxhash64(a, b)),
    })
    # windows by doubling: two words, four words, five; ends shorter than a window are cut off
    df = df.withColumn("__p", F.zip_with("__p", _from("__p", 2), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("__g", F.slice(F.zip_with("__p", _from("__h", 4), lambda a, b: F.xxhash64(a, b)), F.lit(1), F.greatest(F.size("__h") - 4, F.lit(0))))
    places = F.sort_array(F.transform("__g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    df = df.withColumn("__s", F.when(F.size("__g") > F.size(F.array_distinct("__g")), places))
    # sorted by window, then place: a place repeats if a neighbour has the same window
    df = df.withColumn("__e", F.zip_with("__s", _from("__s", 1), lambda a, b: F.coalesce(a["g"] == b["g"], F.lit(False))))
    df = df.withColumn("__r", F.zip_with("__s", F.zip_with(F.concat(F.array(F.lit(False)), "__e"), "__e", lambda a, b: a | F.coalesce(b, F.lit(False))), lambda s, e: F.when(e, s["i"])))
    df = df.withColumn("__r", F.sort_array(F.array_compact("__r")))
    covered = F.aggregate(
        "__r", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-5).cast("bigint").alias("at")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(5).cast("bigint"), i - a["at"])).alias("n"), i.cast("bigint").alias("at")),
        lambda a: a["n"],
    )
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint")))
    return df.drop("__t", "__w", "__j", "__l", "__h", "__p", "__g", "__s", "__e", "__r")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    """``feature >= threshold`` if ``above``, else ``feature < threshold``."""

    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict[str, float]) -> bool:
        return (row[self.feature] >= self.threshold) == self.above

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>=' if self.above else '<'} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects; ``wrong`` and ``right`` are its counts on the rows it was pruned on."""

    tests: tuple[Test, ...]
    right: int = 0
    wrong: int = 0

    def holds(self, row: dict[str, float]) -> bool:
        return all(t.holds(row) for t in self.tests)

    def sql(self) -> str:
        return " AND ".join(t.sql() for t in self.tests)


def _thresholds(values: list[float], most: int) -> list[float]:
    """Midpoints between neighbouring values, thinned evenly by rank to ``most``."""
    v = sorted(values)
    cuts = [(a + b) / 2 for a, b in zip(v, v[1:]) if a < b]
    return cuts if len(cuts) <= most else [cuts[i * len(cuts) // most] for i in range(most)]


def _grow(bad: list[dict], good: list[dict], depth: int, most: int) -> tuple[Test, ...]:
    """Add the test with the best information gain of covered bad rows until no good row is left."""
    tests: tuple[Test, ...] = ()
    while good and len(tests) < depth:
        base, best = math.log2(len(bad) / (len(bad) + len(good))), (1e-9, None)
        for f in FEATURES:
            b, g = sorted(r[f] for r in bad), sorted(r[f] for r in good)
            i = j = 0
            for cut in _thresholds(b + g, most):
                while i < len(b) and b[i] < cut:
                    i += 1
                while j < len(g) and g[j] < cut:
                    j += 1
                for above, p, n in ((True, len(b) - i, len(g) - j), (False, i, j)):
                    if p and (gain := p * (math.log2(p / (p + n)) - base)) > best[0]:
                        best = (gain, Test(f, above, cut))
        if best[1] is None:
            break
        tests += (best[1],)
        bad, good = [r for r in bad if best[1].holds(r)], [r for r in good if best[1].holds(r)]
    return tests


def _prune(tests: tuple[Test, ...], bad: list[dict], good: list[dict]) -> Rule:
    """Cut final tests while the held-back rows do not prefer the longer rule."""
    best = None
    for n in range(len(tests), 0, -1):
        rule = Rule(tests[:n])
        p, q = sum(map(rule.holds, bad)), sum(map(rule.holds, good))
        value = (p - q) / (p + q) if p + q else -1.0
        if best is None or value > best[0]:
            best = (value, Rule(tests[:n], p, q))
    return best[1] if best else Rule(())


def learn_list(rows: list[dict], precision: float = 0.9, depth: int = 3, most_rules: int = 12, most_thresholds: int = 200) -> list[Rule]:
    """Sequential covering: ordered rules that reject rows with ``label`` 0.

    Each round splits what is left into a growing part (two thirds, by the hash of the
    key) and a pruning part, grows one conjunction, prunes it, and takes its rows away.
    It ends when a rule's precision on the pruning part falls below ``precision``.
    Without rows of both labels the list is empty and rejects nothing.
    """
    left, rules = list(rows), []
    while len(rules) < most_rules:
        grow, prune = [r for r in left if r["fold"] != 0], [r for r in left if r["fold"] == 0]
        split = lambda part: ([r for r in part if r["label"] == 0], [r for r in part if r["label"] == 1])
        (bad, good), (held_bad, held_good) = split(grow), split(prune)
        if not bad or not good or not held_bad:
            break
        rule = _prune(_grow(bad, good, depth, most_thresholds), held_bad, held_good)
        if not rule.tests or not rule.right or rule.right < precision * (rule.right + rule.wrong):
            break
        rules.append(rule)
        left = [r for r in left if not rule.holds(r)]
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, sample: int = 8_000, doc_id: str = "doc_id", text: str = "text", label: str = "quality", **options) -> list[Rule]:
    """Learn a list from at most about ``sample`` labelled documents that pass the base checks.

    The bound applies to labelled rows of the fit alone: about ``sample`` rows, chosen by
    a hash of the id, are brought to the driver as a few numbers each, never as texts.
    """
    labels = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.min(label).alias("__y"))
    labels = hashed_sample(labels, doc_id, labels.count(), sample)
    rows = docs.select(doc_id, text).join(F.broadcast(labels), doc_id)
    rows = text_counts(rows, text)
    rows = rows.select(base_failed().alias("failed"), F.pmod(F.xxhash64(doc_id), F.lit(3)).alias("fold"), F.col("__y").cast("int").alias("label"), *(F.expr(e).alias(k) for k, e in FEATURES.items()))
    return learn_list([r.asDict() for r in rows.collect() if not r.failed], **options)


def reject_rule(rules: list[Rule]) -> Column:
    """The number of the first rule that rejects the row, as one ordered conditional; else null."""
    out = F.when(base_failed(), F.lit(0))
    for i, r in enumerate(rules, 1):
        out = out.when(F.expr(r.sql()), F.lit(i))
    return out.cast("int")


def judge_quality(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``rule_no`` (null: none rejects) and ``kept``.

    Null, empty and blank texts have no words and fail the base checks. Very long texts
    are counted whole. Repeated rows are judged alike; an empty table stays empty.
    Columns of ``docs`` that have the name of a result are replaced.
    """
    df = text_counts(docs, text)
    return df.withColumns({"base_failed": base_failed(), "rule_no": reject_rule(rules)}).withColumn(
        # always true, but not deterministic: a filter on kept is then not pushed below the counts, where it would compute them again
        "kept", F.col("rule_no").isNull() & (F.monotonically_increasing_id() >= 0)
    )


__all__ = ["FEATURES", "Rule", "Test", "base_failed", "fit_rules", "judge_quality", "learn_list", "reject_rule", "text_counts"]
