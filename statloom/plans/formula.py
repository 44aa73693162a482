"""Model formulas, ``y ~ x1 * x2 + log(x) + poly(x, 2) + I(a^2 + b) + (1 + t | g)``, as Column expressions.

Grammar: terms joined by ``+``; ``a:b`` is a product, ``a*b`` is both and their product; ``1`` is the
intercept (always there unless turned off); names with other characters stand in backticks. The syntax tree
stays with the model, so that the same expressions are evaluated on new data.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FUNCTIONS = {"log": F.log, "log10": F.log10, "log2": F.log2, "sqrt": F.sqrt, "exp": F.exp, "abs": F.abs, "sin": F.sin, "cos": F.cos, "tan": F.tan}
_TOKEN = re.compile(r"\s*(?:(`[^`]+`)|([A-Za-z_.][\w.]*)|(\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)|(\*\*|[-+*/^:()|~,]))")


class FormulaError(ValueError):
    pass


@dataclass(frozen=True)
class Factor:
    """One factor of a term: kind is "name", "call", "poly" or "expr"."""

    kind: str
    name: str
    detail: str | int = ""

    def label(self) -> str:
        return {"name": self.name, "call": f"{self.name}({self.detail})", "poly": f"poly({self.name},{self.detail})", "expr": f"I({self.name})"}[self.kind]

    def columns(self) -> list[tuple[str, Column]]:
        if self.kind == "name":
            return [(self.name, F.col(f"`{self.name}`").cast("double"))]
        if self.kind == "call":
            return [(self.label(), FUNCTIONS[self.name](F.col(f"`{self.detail}`").cast("double")))]
        if self.kind == "poly":
            x = F.col(f"`{self.name}`").cast("double")
            return [(self.name if k == 1 else f"{self.name}^{k}", x if k == 1 else F.pow(x, F.lit(float(k)))) for k in range(1, int(self.detail) + 1)]
        return [(self.label(), arithmetic(self.name))]


@dataclass(frozen=True)
class Formula:
    response: Factor
    terms: tuple[tuple[Factor, ...], ...]
    intercept: bool = True
    random: tuple[tuple[str, bool, tuple[str, ...]], ...] = field(default=())  # (group, intercept, slopes)
    text: str = ""


def tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"can't read {text[at:]!r}")
        out.append(next(g for g in m.groups() if g is not None))
        at = m.end()
    return out


def plain(name: str) -> str:
    return name[1:-1] if name.startswith("`") else name


def _is_name(t: str) -> bool:
    return bool(re.fullmatch(r"`[^`]+`|[A-Za-z_.][\w.]*", t))


class _Reader:
    def __init__(self, toks: list[str]):
        self.toks, self.at = toks, 0

    def peek(self) -> str:
        return self.toks[self.at] if self.at < len(self.toks) else ""

    def take(self, want: str | None = None) -> str:
        t = self.peek()
        if not t or (want is not None and t != want):
            raise FormulaError(f"{want or 'a term'} expected, {t or 'the end'} found")
        self.at += 1
        return t

    def bracketed(self) -> list[str]:
        """The tokens up to the bracket that closes the one just taken."""
        depth, start = 1, self.at
        while depth:
            t = self.take()
            depth += (t == "(") - (t == ")")
        return self.toks[start : self.at - 1]


def _factor(r: _Reader) -> Factor:
    t = r.take()
    if not _is_name(t):
        raise FormulaError(f"a name expected, {t!r} found")
    if r.peek() != "(" or t.startswith("`"):
        return Factor("name", plain(t))
    r.take("(")
    inner = r.bracketed()
    if t == "I":
        text = " ".join(inner)
        arithmetic(text)
        return Factor("expr", text)
    if t == "poly":
        if len(inner) != 3 or inner[1] != "," or not inner[2].isdigit() or int(inner[2]) < 1:
            raise FormulaError("poly(name, degree) expected")
        return Factor("poly", plain(inner[0]), int(inner[2]))
    if t not in FUNCTIONS or len(inner) != 1 or not _is_name(inner[0]):
        raise FormulaError(f"{t}() takes one name and is one of {', '.join(FUNCTIONS)}, I or poly")
    return Factor("call", t, plain(inner[0]))


def parse(text: str) -> Formula:
    """The syntax tree of a formula."""
    toks = tokens(text)
    if toks.count("~") != 1:
        raise FormulaError("a formula has one ~")
    cut = toks.index("~")
    left = _Reader(toks[:cut])
    response = _factor(left)
    if left.peek():
        raise FormulaError("one response expected")
    r, terms, random, intercept = _Reader(toks[cut + 1 :]), [], {}, True
    while True:
        if r.peek() == "-":
            raise FormulaError("terms can't be taken away; use intercept=False for no intercept")
        if r.peek() == "(":
            r.take("(")
            inner = r.bracketed()
            if inner.count("|") != 1:
                raise FormulaError("a random part is (1 + slope | group)")
            bar = inner.index("|")
            group, parts = inner[bar + 1 :], [t for t in inner[:bar] if t != "+"]
            if len(group) != 1:
                raise FormulaError("a random part has one group")
            has, slopes = random.get(plain(group[0]), (False, ()))
            random[plain(group[0])] = (has or "1" in parts or "0" not in parts, (*slopes, *(plain(p) for p in parts if p not in ("0", "1") and plain(p) not in slopes)))
        elif r.peek() in ("0", "1"):
            intercept = r.take() == "1"
        else:
            chain, joins = [[_factor(r)]], []
            while r.peek() in ("*", ":"):
                if r.take() == ":":
                    chain[-1].append(_factor(r))
                else:
                    chain.append([_factor(r)])
                joins.append(1)
            for size in range(1, len(chain) + 1):
                terms += [tuple(f for part in pick for f in part) for pick in combinations(chain, size)]
        if not r.peek():
            break
        r.take("+")
        if not r.peek():
            raise FormulaError("a term expected behind +")
    seen, kept = set(), []
    for t in terms:
        if (k := frozenset(f.label() for f in t)) not in seen:
            seen.add(k)
            kept.append(t)
    return Formula(response, tuple(kept), intercept, tuple((g, i, s) for g, (i, s) in random.items()), text)


def arithmetic(text: str) -> Column:
    """A Column for + - * / ^ ** with brackets, numbers, names and the known functions; never evaluated as code."""
    r = _Reader(tokens(text))

    def atom() -> Column:
        t = r.take()
        if t == "(":
            v = added()
            r.take(")")
            return v
        if t == "-":
            return -powered()
        if re.fullmatch(r"\d.*", t):
            return F.lit(float(t))
        if not _is_name(t):
            raise FormulaError(f"{t!r} has no place in an expression")
        if r.peek() == "(" and t in FUNCTIONS:
            r.take("(")
            v = added()
            r.take(")")
            return FUNCTIONS[t](v)
        return F.col(f"`{plain(t)}`").cast("double")

    def powered() -> Column:
        v = atom()
        if r.peek() in ("^", "**"):
            r.take()
            return F.pow(v, powered())
        return v

    def multiplied() -> Column:
        v = powered()
        while r.peek() in ("*", "/"):
            v = v * powered() if r.take() == "*" else F.try_divide(v, powered())
        return v

    def added() -> Column:
        v = multiplied()
        while r.peek() in ("+", "-"):
            v = v + multiplied() if r.take() == "+" else v - multiplied()
        return v

    out = added()
    if r.peek():
        raise FormulaError(f"{r.peek()!r} is left over")
    return out


def design(formula: Formula, intercept: bool | None = None) -> dict[str, Column]:
    """The named columns of the design; an interaction of several-column factors has all their products."""
    out: dict[str, Column] = {}
    if formula.intercept if intercept is None else intercept:
        out["(Intercept)"] = F.lit(1.0)
    for term in formula.terms:
        made = [("", F.lit(1.0))]
        for f in term:
            made = [(f"{a}:{b}" if a else b, y if not a else x * y) for a, x in made for b, y in f.columns()]
        out |= dict(made)
    return out


def response(formula: Formula) -> Column:
    return formula.response.columns()[0][1]


def apply(formula: str | Formula, df: DataFrame, intercept: bool | None = None) -> DataFrame:
    """``y``, the design's columns and the groups of a formula over ``df``; rows with a missing value are dropped."""
    f = parse(formula) if isinstance(formula, str) else formula
    kinds = dict(df.dtypes)
    for t in (f.response, *(x for term in f.terms for x in term)):
        if t.kind in ("name", "poly") and kinds.get(t.name) == "string":
            raise FormulaError(f"{t.name} is text: encode it first")
    cols = [response(f).alias("y"), *[c.alias(k) for k, c in design(f, intercept).items()]]
    return df.select(*cols, *[F.col(f"`{g}`") for g, _, _ in f.random]).dropna()
