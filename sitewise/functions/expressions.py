"""Filter expressions on sites and cells, compiled to Spark SQL.

``QUAL>20 && (TYPE="snp" || N_ALT>1) && ID!~"^x"``: comparisons, arithmetic, ``&&``/``&``,
``||``/``|``, ``!``, regular expressions with ``~`` and ``!~``, and functions. Names are
columns, or entries of ``NAMES``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?)|"([^"]*)"|([A-Za-z_][\w/]*)|(&&|\|\||==|!=|<=|>=|!~|[-+*/()<>=~&|!,]))')

#: Site fields by name; the value is an SQL expression over the site columns.
NAMES = {
    "CHROM": "chrom", "POS": "pos", "ID": "id", "REF": "ref", "ALT": "alt", "QUAL": "try_cast(qual AS double)", "AC": "ac", "AN": "an", "DP": "dp", "GQ": "gq",
    "AF": "(ac / nullif(an, 0))", "MAF": "least(ac / nullif(an, 0), 1 - ac / nullif(an, 0))", "MAC": "least(ac, an - ac)",
    "N_ALT": "(CASE WHEN alt = '.' THEN 0 ELSE size(split(alt, ',')) END)", "ILEN": "(length(substring_index(alt, ',', 1)) - length(ref))",
    "TYPE": "(CASE WHEN alt = '.' THEN 'ref' WHEN alt LIKE '%<%' THEN 'other' WHEN length(ref) = length(substring_index(alt, ',', 1)) THEN IF(length(ref) = 1, 'snp', 'mnp') ELSE 'indel' END)",
}

_KNOWN = "filter({0}, x -> x IS NOT NULL)"
_SUM = "aggregate({0}, 0D, (a, x) -> a + coalesce(x, 0))"
_AVG = f"({_SUM} / nullif(size({_KNOWN}), 0))"
_SORTED = f"array_sort({_KNOWN})"

#: Functions of one array or number; arrays may be columns of per-sample values. Nulls count in none.
FUNCTIONS = {
    "MAX": "array_max({0})", "MIN": "array_min({0})", "SUM": _SUM, "AVG": _AVG, "MEAN": _AVG, "COUNT": f"size({_KNOWN})", "ABS": "abs({0})", "STRLEN": "length({0})",
    "PHRED": "(-10 * log10({0}))", "N_PASS": "size(filter({0}, x -> x))", "F_PASS": "(size(filter({0}, x -> x)) / nullif(size({0}), 0))",
    "MEDIAN": f"((get({_SORTED}, int((size({_KNOWN}) - 1) / 2)) + get({_SORTED}, int(size({_KNOWN}) / 2))) / 2)",
    "STDEV": f"sqrt(greatest(0D, aggregate({{0}}, 0D, (a, x) -> a + coalesce(double(x) * x, 0)) / nullif(size({_KNOWN}), 0) - {_AVG} * {_AVG}))",
    "BINOM": "(CASE WHEN {0}[0] + {0}[1] = 0 THEN 1D WHEN {0}[0] = {0}[1] THEN 1D ELSE least(1D, 2 * aggregate(sequence(0, int(least({0}[0], {0}[1]))), "
    "named_struct('l', -({0}[0] + {0}[1]) * ln(2D), 's', 0D), (a, i) -> named_struct('l', a.l + ln(double({0}[0] + {0}[1] - i) / (i + 1)), 's', a.s + exp(a.l)), a -> a.s)) END)",
}

#: The same of each sample's values, where a field is an array of arrays.
FUNCTIONS |= {f"{p}{k}": "transform({0}, s -> " + FUNCTIONS[k].format("s") + ")" for k in ("MAX", "MIN", "SUM", "AVG", "MEAN", "MEDIAN", "STDEV", "BINOM") for p in ("SMPL_", "s")}

_LEVELS = (("||", "|"), ("&&", "&"), ("==", "=", "!=", "<", ">", "<=", ">=", "~", "!~"), ("+", "-"), ("*", "/"))
_SQL = {"||": "OR", "|": "OR", "&&": "AND", "&": "AND", "==": "=", "!=": "<>"}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not understood: {text[at:]!r}")
        kind = ("number", "string", "name", "sign")[next(i for i in range(4) if m[i + 1] is not None)]
        out.append((kind, m[m.lastindex]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str, names: dict[str, str]):
        self.rest, self.names = tokens(text), names

    def sign(self, *wanted: str) -> str | None:
        if self.rest and self.rest[0][0] == "sign" and self.rest[0][1] in wanted:
            return self.rest.pop(0)[1]
        return None

    def level(self, n: int = 0) -> str:
        if n == len(_LEVELS):
            return self.unary()
        left = self.level(n + 1)
        while op := self.sign(*_LEVELS[n]):
            right = self.level(n + 1)
            if op in ("~", "!~"):
                left = f"({'NOT ' if op == '!~' else ''}{left} RLIKE {right})"
            else:
                left = f"({left} {_SQL.get(op, op)} {right})"
        return left

    def unary(self) -> str:
        if self.sign("!"):
            return f"(NOT {self.unary()})"
        if self.sign("-"):
            return f"(-{self.unary()})"
        if self.sign("("):
            inner = self.level()
            if not self.sign(")"):
                raise ValueError("a bracket is not closed")
            return inner
        if not self.rest:
            raise ValueError("the expression ends early")
        kind, value = self.rest.pop(0)
        if kind == "number":
            return value if re.fullmatch(r"\d+", value) else f"{value}D"
        if kind == "string":
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        if kind == "name":
            if self.sign("("):
                if value not in FUNCTIONS:
                    raise ValueError(f"no such function: {value}")
                inner = self.level()
                if not self.sign(")"):
                    raise ValueError("a bracket is not closed")
                return FUNCTIONS[value].format(inner)
            name = value.removeprefix("INFO/").removeprefix("FMT/")
            return self.names.get(name, f"`{name}`")
        raise ValueError(f"unexpected {value!r}")


def to_sql(text: str, names: dict[str, str] | None = None) -> str:
    p = _Parser(text, NAMES | (names or {}))
    out = p.level()
    if p.rest:
        raise ValueError(f"left over: {p.rest[0][1]!r}")
    return out


def compile_filter(text: str, names: dict[str, str] | None = None) -> Column:
    """The expression as a condition; null counts as false."""
    return F.coalesce(F.expr(to_sql(text, names)), F.lit(False))
