"""Unit algebra for the compiler: a unit is a vector of base dimensions; scales don't matter, as nothing is converted."""

from __future__ import annotations

import re
from fractions import Fraction

#: Unit names and their dimensions (power per base dimension). Prefixed and scaled units share a dimension.
BASES = {
    "meter": {"L": 1},
    "gram": {"M": 1},
    "second": {"T": 1},
    "kelvin": {"K": 1},
    "ampere": {"I": 1},
    "mole": {"N": 1},
    "candela": {"J": 1},
    "euro": {"€": 1},
    "watt": {"M": 1, "L": 2, "T": -3},
    "joule": {"M": 1, "L": 2, "T": -2},
    "pascal": {"M": 1, "L": -1, "T": -2},
    "newton": {"M": 1, "L": 1, "T": -2},
    "volt": {"M": 1, "L": 2, "T": -3, "I": -1},
    "hertz": {"T": -1},
    "liter": {"L": 3},
    "dimensionless": {},
}
SYMBOLS = {
    "m": "meter", "metre": "meter", "g": "gram", "s": "second", "sec": "second", "K": "kelvin", "W": "watt", "J": "joule", "Pa": "pascal", "N": "newton", "V": "volt",
    "A": "ampere", "Hz": "hertz", "l": "liter", "L": "liter", "litre": "liter", "EUR": "euro", "eur": "euro", "mol": "mole",
    "degC": "kelvin", "celsius": "kelvin", "degree_Celsius": "kelvin", "degF": "kelvin", "minute": "second", "min": "second", "hour": "second", "h": "second", "hr": "second",
    "day": "second", "d": "second", "bar": "pascal", "mbar": "pascal", "percent": "dimensionless", "ppm": "dimensionless", "ppb": "dimensionless", "degree": "dimensionless",
    "deg": "dimensionless", "radian": "dimensionless", "count": "dimensionless", "inch": "meter", "foot": "meter", "mile": "meter", "tonne": "gram",
}
PREFIXES = ("yotta", "zetta", "exa", "peta", "tera", "giga", "mega", "kilo", "hecto", "deca", "deci", "centi", "milli", "micro", "nano", "pico")
SHORT_PREFIXES = ("G", "M", "k", "h", "d", "c", "m", "u", "µ", "n")
COMPOUNDS = {"watt_hour": {"M": 1, "L": 2, "T": -2}, "Wh": {"M": 1, "L": 2, "T": -2}}

Dims = tuple[tuple[str, Fraction], ...]


class UnitError(ValueError):
    pass


def _atom(name: str) -> dict[str, int]:
    plain = name[:-1] if name.endswith("s") and len(name) > 3 else name
    for n in (name, plain):
        if n in COMPOUNDS:
            return COMPOUNDS[n]
        if n in BASES:
            return BASES[n]
        if n in SYMBOLS:
            return BASES[SYMBOLS[n]]
        for p in PREFIXES:
            rest = n.removeprefix(p)
            if rest != n and (rest in BASES or rest in COMPOUNDS):
                return COMPOUNDS.get(rest) or BASES[rest]
        for p in SHORT_PREFIXES:
            rest = n.removeprefix(p)
            if rest != n and rest in {"m", "g", "s", "W", "J", "Pa", "V", "A", "Hz", "l", "Wh", "K", "N"}:
                return COMPOUNDS.get(rest) or BASES[SYMBOLS[rest]]
    raise UnitError(f"unknown unit {name!r}")


_TOKEN = re.compile(r"\s*(\*\*|\^|[*/()]|[+-]?\d+(?:\.\d+)?|[^\W\d]\w*|·)")


def parse(text: str) -> Dims:
    """Dimensions of a unit expression: names joined by ``*``, ``/``, ``**`` and brackets."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise UnitError(f"can't read unit {text!r}")
        tokens.append(m[1])
        at = m.end()
    pos = 0

    def power() -> dict[str, Fraction]:
        nonlocal pos
        if pos >= len(tokens):
            raise UnitError(f"can't read unit {text!r}")
        tok = tokens[pos]
        pos += 1
        if tok == "(":
            base = product()
            if pos >= len(tokens) or tokens[pos] != ")":
                raise UnitError(f"can't read unit {text!r}")
            pos += 1
        elif re.match(r"[+-]?\d", tok):
            base = {}
        elif tok in "*/)^" or tok == "**":
            raise UnitError(f"can't read unit {text!r}")
        else:
            base = {k: Fraction(v) for k, v in _atom(tok).items()}
        if pos < len(tokens) and tokens[pos] in ("**", "^"):
            if pos + 1 >= len(tokens) or not re.match(r"[+-]?\d", tokens[pos + 1]):
                raise UnitError(f"can't read unit {text!r}")
            base = {k: v * Fraction(tokens[pos + 1]) for k, v in base.items()}
            pos += 2
        return base

    def product() -> dict[str, Fraction]:
        nonlocal pos
        total = power()
        while pos < len(tokens) and tokens[pos] != ")":
            sign = 1
            if tokens[pos] in ("*", "·", "/"):
                sign = -1 if tokens[pos] == "/" else 1
                pos += 1
            for k, v in power().items():
                total[k] = total.get(k, Fraction(0)) + sign * v
        return total

    if not tokens:
        return ()
    out = product()
    if pos != len(tokens):
        raise UnitError(f"can't read unit {text!r}")
    return tuple(sorted((k, v) for k, v in out.items() if v))


def compatible(left: str, right: str) -> bool:
    return parse(left or "dimensionless") == parse(right or "dimensionless")


def combine(rule: str, left: str, right: str) -> str:
    """The unit of a product or quotient, '' if its dimensions cancel."""
    sign = 1 if rule == "multiply" else -1
    dims = dict(parse(left or "dimensionless"))
    for k, v in parse(right or "dimensionless"):
        dims[k] = dims.get(k, Fraction(0)) + sign * v
    if not any(dims.values()):
        return ""
    if not right:
        return left
    if rule == "multiply":
        return f"{left} ** 2" if left == right and left.isidentifier() else f"{left} * {right}" if left else right
    return f"{left or '1'} / {right if right.isidentifier() else f'({right})'}"
