"""Query formats: ``%CHROM\\t%POS[\\t%SAMPLE=%GT]\\n`` compiled to one Spark expression over sites and their calls.

Outside brackets tags are site fields; a bracket is repeated for each sample in order. Tags are
columns in capitals, ``INFO/x`` the entry of a map ``info``, or one of: POS0, END, END0, FIRST_ALT,
N_ALT, TYPE, MISSING_RATE over sites, and SAMPLE, GT and TGT (alleles as bases) over samples.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"%([A-Za-z_][\w]*(?:/\w+)?)")
_ESCAPES = {"t": "\t", "n": "\n", "\\": "\\"}


def _parts(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    for m in _TAG.finditer(text):
        out += [("text", text[at : m.start()]), ("tag", m[1])]
        at = m.end()
    return [x for x in [*out, ("text", text[at:])] if x[1]]


def parse(spec: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """("site" or "samples", parts) in order; brackets must close and do not nest."""
    spec = re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), spec)
    out = []
    for i, piece in enumerate(re.split(r"[\[\]]", spec)):
        if piece:
            out.append(("samples" if i % 2 else "site", _parts(piece)))
    if re.sub(r"[^\[\]]", "", spec) != "[]" * spec.count("["):
        raise ValueError(f"brackets do not match: {spec!r}")
    return out


def _shown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("."))


def _site(tag: str, columns: Sequence[str]) -> Column:
    from sitewise.operators.plugins import variant_type

    first = F.substring_index("alt", ",", 1)
    made = {
        "POS0": lambda: F.col("pos") - 1, "END": lambda: F.col("pos") + F.length("ref") - 1, "END0": lambda: F.col("pos") + F.length("ref") - 2, "FIRST_ALT": lambda: first,
        "N_ALT": lambda: F.when(F.col("alt") == ".", 0).otherwise(F.size(F.split("alt", ","))), "TYPE": lambda: variant_type(F.col("ref"), first),
    }
    name = tag.removeprefix("INFO/")
    if tag == name and name.lower() in columns:
        return F.col(name.lower())
    if tag in made:
        return made[tag]()
    if "info" in columns:
        return F.col("info")[name]
    raise ValueError(f"no such field: {tag}")


def format_records(sites: DataFrame, spec: str, calls: DataFrame | None = None, keys: Sequence[str] = ("chrom", "pos"), sample: str = "sample_idx", alleles: Sequence[str] = ("a1", "a2")) -> DataFrame:
    """(keys, line): each site by the format. ``calls`` has keys, a sample and the columns that tags name; a site
    without calls has empty brackets. Alleles are two columns, negative if missing; GT has ``/`` between them."""
    pieces = parse(spec)
    fields = list(sites.columns)
    if any(k == "samples" for k, _ in pieces):
        if calls is None:
            raise ValueError("the format has a bracket, but there are no calls")
        rest = [c for c in calls.columns if c not in keys and c != sample]
        cells = calls.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(sample), *(F.col(c) for c in rest)))).alias("__cells"))
        sites = sites.join(cells, list(keys), "left")

    def of_sample(tag: str, cell: Column) -> Column:
        letter = lambda c: F.when(cell[c] < 0, ".").otherwise(cell[c].cast("string"))
        bases = F.concat(F.array("ref"), F.split("alt", ","))
        base = lambda c: F.when(cell[c] < 0, ".").otherwise(F.coalesce(F.get(bases, cell[c].cast("int")), F.lit(".")))
        if tag == "SAMPLE":
            return cell[sample]
        if tag == "GT":
            return F.concat_ws("/", *map(letter, alleles))
        if tag == "TGT":
            return F.concat_ws("/", *map(base, alleles))
        return cell[tag.lower()] if tag.lower() in rest else _site(tag, fields)

    def joined(parts, value) -> Column:
        return F.concat(*(F.lit(x) if kind == "text" else _shown(value(x)) for kind, x in parts))

    def of_cell(parts):
        return lambda cell: joined(parts, lambda t: of_sample(t, cell))

    out = []
    for kind, parts in pieces:
        if kind == "site":
            out.append(joined(parts, lambda t: _site(t, fields)))
        else:
            out.append(F.coalesce(F.array_join(F.transform("__cells", of_cell(parts)), ""), F.lit("")))
    return sites.select(*keys, F.concat(*out).alias("line"))
