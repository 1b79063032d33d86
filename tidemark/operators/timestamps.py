"""Mixed timestamp formats and zones to one UTC instant (problem 4).

Every text gets the list of its valid parses (``candidates``), each one a format and an instant. Which parse holds is
decided per source by expectation-maximisation over the source's mixture of formats. One pass over the rows counts, per
source, the formats and days of their parses; from these counts come the span of days that the source's times lie in and the
counts of *signatures* (the set of formats that parse a text, and which of these instants lie in the span). The EM runs on
the signatures, and the posterior of each chooses its format. A second pass gives the result. A text whose best posterior
stays below ``min_posterior`` is marked ``unresolved``: it has no instant, but the list of those it may mean.

Results for odd input: a null, empty or unparsable text gives a null instant and status ``unparsed``; a local hour
skipped by a clock change is moved forward by the skipped amount; a local hour that occurs twice is the first
occurrence unless a row of the source with a smaller key has the same text within ``fold_by``, then the second (both are
marked); columns of the input are kept, a column of the same name as a result column is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from zoneinfo import available_timezones

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.common import US_DAY, US_HOUR, US_SECOND, cut, fits, floordiv, fresh, small_join

#: Zone abbreviations in texts, hours east of UTC.
ABBREVIATIONS = {"Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "MSK": 3}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
REGIONS = sorted(z for z in available_timezones() if z.split("/")[0] in {"Africa", "America", "Antarctica", "Asia", "Atlantic", "Australia", "Europe", "Indian", "Pacific"})

_REGIONS = ", ".join(f"'{z}'" for z in REGIONS)  # as one text, as it goes to the JVM

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:\s*([AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?:\s*(Z|z|[A-Z]{3,4}|[+-]\d{2}(?::?\d{2})?|[A-Z][A-Za-z]+/[A-Za-z_/]+))?"
#: layout -> (pattern, its groups as y|month|d|h|min|s|fraction|am or pm|zone)
LAYOUTS = {
    "ymd": (rf"^\s*(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:(?:\s+|[Tt]){_TIME}{_ZONE})?\s*$", "$1|$3|$4|$5|$6|$7|$8|$9|$10"),
    "compact": (rf"^\s*(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}}):?(\d{{2}}):?(\d{{2}})?{_ZONE}\s*$", "$1|$2|$3|$4|$5|$6|||$7"),
    "numeric": (rf"^\s*(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}})(?:[,\sT]+{_TIME}{_ZONE})?\s*$", "$4|$3|$1|$5|$6|$7|$8|$9|$10|$2"),
    "dmon": (rf"^\s*(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})[\s-]+([A-Za-z]{{3}})[a-z]*\.?[\s,-]+(\d{{4}})(?:[,\s]+{_TIME}{_ZONE})?\s*$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    "mond": (rf"^\s*(?:[A-Za-z]{{3,9}},\s+)?([A-Za-z]{{3}})[a-z]*\.?\s+(\d{{1,2}})(?:,|\s)\s*(\d{{4}})(?:[,\s]+{_TIME}{_ZONE})?\s*$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
}
_YEAR = r"^\s*(\d{4}|\d{2})(?:\.0*)?\s*$"
_DIGITS = r"^\s*\d{8,19}(?:\.0*)?\s*$"
EPOCHS = {"epoch_s": US_SECOND, "epoch_ms": 1000, "epoch_us": 1}
#: An instant outside the source's span has this likelihood against one inside it.
OUTSIDE = 1e-6


@dataclass(frozen=True)
class Fields:
    """Columns that hold a local time in parts, beside the text column, which then is the year."""

    month: str
    day: str
    hour: str


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _local_us(y: Column, mo: Column, d: Column, clock: Column) -> Column:
    """Wall-clock µs since 1970 from a date and the µs of its day; null for an invalid date."""
    zero = F.lit(0)
    date = F.call_function("try_make_timestamp_ntz", y, mo, d, zero, zero, F.lit(0).cast("decimal(16,6)")).cast("date")
    return F.unix_date(date).cast("long") * US_DAY + clock


def _offset_us(zone: Column) -> Column:
    """µs east of UTC of an abbreviation or a numeric offset, else null."""
    hours = F.lit(None).cast("int")
    for name, east in ABBREVIATIONS.items():
        hours = F.when(F.upper(zone) == name, F.lit(east)).otherwise(hours)
    digits = F.regexp_replace(zone, ":", "")
    minutes = _int(F.substring(digits, 2, 2)) * 60 + F.coalesce(_int(F.substring(digits, 4, 2)), F.lit(0))
    signed = F.when(zone.startswith("-"), -minutes).otherwise(minutes)
    return F.when(zone.rlike(r"^[+-]"), signed.cast("long") * 60 * US_SECOND).otherwise(hours.cast("long") * US_HOUR)


USUAL = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"
_PARSES = "array<struct<fmt:string,us:bigint,fold:boolean>>"


def with_candidates(df: DataFrame, text: str, zone: str, out: str, fields: Fields | None = None) -> DataFrame:
    """Add ``out``: array<struct<fmt, us, fold>> of every valid parse; ``fold``: the local time occurs twice, ``us`` is its first.

    Times in the plain form (or in parts) go through a few substring operations, the rest through all layouts: two branches,
    each with code that is small enough to be compiled well.
    """
    if fields is None:
        plain = F.col(text).rlike(USUAL)
    else:
        plain = F.col(text).rlike(r"^\d{4}$") & F.col(fields.month).isNotNull() & F.col(fields.day).isNotNull() & F.col(fields.hour).between(0, 23)
    plain = F.coalesce(plain, F.lit(False))
    return _plain_times(df.filter(plain), text, zone, out, fields).unionByName(_all_layouts(df.filter(~plain), text, zone, out, fields))


def _plain_times(df: DataFrame, text: str, zone: str, out: str, fields: Fields | None) -> DataFrame:
    have = list(df.columns)
    local, us = fresh(have, "_tc_local"), fresh(have, "_tc_us")
    cut_at = lambda a, n: F.substring(F.col(text), a, n).cast("int")
    zero = F.lit(0)
    if fields is None:
        y, mo, d, h, mi, s = (cut_at(*x) for x in ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2), (18, 2)))
    else:
        y, mo, d, h, mi, s = cut_at(1, 4), *(F.col(c).cast("int") for c in (fields.month, fields.day, fields.hour)), zero, zero
    clock = F.when((h < 24) & (mi < 60) & (s < 60), (h * 3600 + mi * 60 + s).cast("long") * US_SECOND).when((h == 24) & (mi + s == 0), F.lit(US_DAY))
    df = df.withColumn(local, _local_us(y, mo, d, clock))
    df = df.withColumn(us, F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), zone)))
    fold = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(F.col(us) + F.lit(US_HOUR)), zone)) == F.col(local)
    one = F.array(F.struct(F.lit("ymd" if fields is None else "fields").alias("fmt"), F.col(us).alias("us"), fold.alias("fold")))
    # see _all_layouts
    return df.select(*have, F.explode(F.array(F.when(F.col(us).isNotNull(), one).otherwise(F.array().cast(_PARSES)))).alias(out))


def _all_layouts(df: DataFrame, text: str, zone: str, out: str, fields: Fields | None) -> DataFrame:
    """Each step is a projection of its own, so that no expression is computed more than once a row."""
    have = list(df.columns)
    c = {k: fresh(have, f"_tc_{k}") for k in ("raw", "p", "y", "m", "d", "clock", "z", "off", "region", "a", "b", "fa", "fb", "n")}
    col = lambda k: F.col(c[k])
    t = F.col(text)
    raw = F.coalesce(
        *[F.when(t.rlike(pattern), F.concat(F.lit(f"{name}|"), F.regexp_replace(t, pattern, groups))) for name, (pattern, groups) in LAYOUTS.items()],
        F.when(t.rlike(_DIGITS), F.concat(F.lit("digits|"), F.regexp_extract(t, r"(\d+)", 1))),
    )
    if fields is not None:
        parts = F.concat_ws("|", F.lit("fields"), F.regexp_extract(t, _YEAR, 1), *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (fields.month, fields.day, fields.hour)], *[F.lit("")] * 5)
        raw = F.when(t.rlike(_YEAR) & F.col(fields.month).isNotNull() & F.col(fields.day).isNotNull() & F.col(fields.hour).isNotNull(), parts).otherwise(raw)
    df = df.withColumn(c["raw"], raw)
    df = df.withColumn(c["p"], F.when(col("raw").startswith("digits|") & (F.length(col("raw")) == 21), F.split(F.regexp_replace(col("raw"), r"^digits\|(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "packed|$1|$2|$3|$4|$5|$6|||"), r"\|")).otherwise(F.split(col("raw"), r"\|")))
    at = lambda i: F.try_element_at(col("p"), F.lit(i + 1))
    part = lambda i: F.coalesce(_int(at(i)), F.lit(0))
    place = F.instr(F.lit("".join(MONTHS)), F.lower(at(2)))
    hour = F.when(at(8) == "", part(4)).when(part(4) > 12, F.lit(None)).otherwise(part(4) % 12 + F.when(F.lower(at(8)) == "p", 12).otherwise(0))
    frac = F.coalesce(F.rpad(F.substring(at(7), 1, 6), 6, "0").try_cast("long"), F.lit(0).cast("long"))
    year = _int(at(1))
    df = df.withColumns({
        c["y"]: F.when((at(0) == "fields") & (year < 100), year + 2000).otherwise(year),
        c["m"]: F.coalesce(_int(at(2)), F.when((F.length(at(2)) == 3) & (place % 3 == 1), F.call_function("div", place + 2, F.lit(3)).cast("int"))),
        c["d"]: _int(at(3)),
        c["clock"]: F.struct(hour.alias("h"), part(5).alias("mi"), part(6).alias("s"), frac.alias("f")),
        c["z"]: F.coalesce(at(9), F.lit("")),
        c["n"]: F.when(at(0) == "digits", at(1).try_cast("long")),
    })
    k = col("clock")
    valid = (k["h"] < 24) & (k["mi"] < 60) & (k["s"] < 60) | (k["h"] == 24) & (k["mi"] == 0) & (k["s"] == 0)
    df = df.withColumns({
        c["clock"]: F.when(valid, k["h"].cast("long") * US_HOUR + (k["mi"].cast("long") * 60 + k["s"]) * US_SECOND + k["f"]),
        c["off"]: F.when(col("z") != "", _offset_us(col("z"))),
        c["region"]: F.when(col("z") == "", F.lit(zone)).when(F.expr(f"`{c['z']}` IN ({_REGIONS})"), col("z")),
    })
    df = df.withColumns({
        c["a"]: F.when(col("n").isNull(), _local_us(col("y"), col("m"), col("d"), col("clock"))),
        c["b"]: F.when((at(0) == "numeric") & (at(10) != "."), _local_us(col("y"), col("d"), col("m"), col("clock"))),  # dotted dates are day first
    })

    def first(local: Column) -> Column:
        there = lambda tz: F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), tz))
        return F.when(col("off").isNotNull(), local - col("off")).when(col("region") == zone, there(zone)).otherwise(there(col("region")))

    df = df.withColumns({c["fa"]: first(col("a")), c["fb"]: first(col("b"))})

    def parse(fmt: Column, us: str, local: str) -> Column:
        later = lambda tz: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(col(us) + F.lit(US_HOUR)), tz)) == col(local)
        fold = F.when(col("off").isNotNull(), F.lit(False)).when(col("region") == zone, later(zone)).otherwise(later(col("region")))
        return F.when(col(us).isNotNull(), F.struct(fmt.alias("fmt"), col(us).alias("us"), F.coalesce(fold, F.lit(False)).alias("fold")))

    found = [parse(F.when(at(0) == "numeric", "dmy").otherwise(at(0)), "fa", "a"), parse(F.lit("mdy"), "fb", "b")]
    for name, unit in EPOCHS.items():
        us = F.when(col("n") < F.lit((1 << 62) // unit), col("n") * F.lit(unit))
        found.append(F.when(us.isNotNull(), F.struct(F.lit(name).alias("fmt"), us.alias("us"), F.lit(False).alias("fold"))))
    # one row each: an explode is what no filter, alias or join key is traced through (all steps above would be copied into it)
    return df.select(*have, F.explode(F.array(F.array_compact(F.array(*found)))).alias(out))


EM_ROUNDS = 50
MARGIN_DAYS = 400


def em_formats(counts: pd.DataFrame) -> pd.DataFrame:
    """EM over one source. counts: source, sig (``format:inside`` of every parse, joined by commas), n. Gives source, sig, fmt,
    posterior; a source has few signatures (sets of formats), however many rows."""
    sigs, n = counts["sig"].tolist(), counts["n"].to_numpy(float)
    names = sorted({x.split(":")[0] for s in sigs for x in s.split(",")})
    like = np.zeros((len(sigs), len(names)))
    for i, s in enumerate(sigs):
        for x in s.split(","):
            f, inside = x.split(":")
            like[i, names.index(f)] = 1.0 if inside == "1" else OUTSIDE
    pi = np.full(len(names), 1 / len(names))
    for _ in range(EM_ROUNDS):
        post = like * pi
        post /= post.sum(axis=1, keepdims=True)
        new = (n @ post + 1e-9) / (n.sum() + 1e-9 * len(names))
        if np.abs(new - pi).max() < 1e-12:
            break
        pi = new
    best = post.argmax(axis=1)
    return pd.DataFrame({"source": counts["source"].to_numpy(), "sig": sigs, "fmt": [names[b] for b in best], "posterior": post.max(axis=1)})


def _spans(counts: DataFrame) -> DataFrame:
    """source -> lo, hi: the days that nearly all its certain times lie between, with a margin (all its times', if none is certain)."""
    days = counts.select("source", "n", (F.size("parses") == 1).alias("sure"), F.explode("parses.day").alias("day"))
    ends = days.groupBy("source", "sure").agg(F.percentile("day", [0.01, 0.99], F.col("n")).alias("q")).groupBy("source").agg(F.max_by("q", "sure").alias("q"))
    return ends.select("source", (F.floor(F.col("q")[0]) - MARGIN_DAYS).alias("lo"), (F.ceil(F.col("q")[1]) + MARGIN_DAYS).alias("hi"))


def normalise(
    df: DataFrame,
    text: str,
    zone: str,
    *,
    source: Column | str = "",
    key: str | None = None,
    fold_by: Sequence[str] = (),
    usual: Column | None = None,
    fields: Fields | None = None,
    min_posterior: float = 0.9,
    out: str = "ts",
) -> DataFrame:
    """Add ``{out}_us`` (UTC µs), ``{out}_format``, ``{out}_posterior``, ``{out}_status``, ``{out}_usual`` and ``{out}_candidates``.

    ``source`` names each row's source (one mixture each). ``key`` and ``fold_by`` settle hours that occur twice.
    Status: ok, first, second (of an hour that occurs twice), unresolved (null instant; ``{out}_candidates`` has the possible
    ones, null otherwise), unparsed.
    """
    results = [f"{out}_{x}" for x in ("us", "format", "posterior", "status", "usual", "candidates")]
    keep = [c for c in df.columns if c not in results]
    src, cand, parses, got, least, hits = (fresh(df, f"_tm_{x}") for x in ("src", "cand", "parses", "got", "least", "hits"))
    base = with_candidates(df.withColumn(src, F.lit(source) if isinstance(source, str) else source), text, zone, cand, fields)
    parsed = F.transform(cand, lambda c: F.struct(c["fmt"].alias("fmt"), floordiv(c["us"], US_DAY).alias("day")))
    by = [*fold_by, text]
    # one pass: rows by the formats and days of their parses, and the least key of each text that may name an hour twice
    keyed = F.struct(*[F.col(c).alias(f"b{i}") for i, c in enumerate(by)])
    some = [F.struct(F.col(src).alias("source"), parsed.alias("parses"), F.lit(None).cast(df.select(keyed.alias("x")).schema["x"].dataType).alias("by"))]
    if key is not None:
        some.append(F.when(F.exists(cand, lambda c: c["fold"]), F.struct(F.col(src).alias("source"), F.array().cast("array<struct<fmt:string,day:bigint>>").alias("parses"), keyed.alias("by"))))
    counts = base.filter(F.size(cand) > 0).select(F.explode(F.array_compact(F.array(*some))).alias("x"), *([F.col(key).alias("least")] if key is not None else [])).groupBy("x.source", "x.parses", "x.by")
    counts = cut(counts.agg(F.count(F.lit(1)).alias("n"), *([F.min("least").alias("least")] if key is not None else [])))
    fit = fits(counts)  # all that is joined below comes from it
    forms = counts.filter(F.size("parses") > 0).select("source", "parses", "n")
    inside = lambda p: F.when(p["day"].between(F.col("lo"), F.col("hi")), ":1").otherwise(":0")
    signed = small_join(forms, _spans(forms), ["source"], fit).withColumn("sig", F.concat_ws(",", F.transform("parses", lambda p: F.concat(p["fmt"], inside(p)))))
    chosen = signed.groupBy("source", "sig").agg(F.sum("n").alias("n")).groupBy("source").applyInPandas(em_formats, "source string, sig string, fmt string, posterior double")
    chosen = small_join(signed.filter(F.size("parses") > 1), chosen, ["source", "sig"], fit)
    chosen = cut(chosen.select(F.col("source").alias(src), F.col("parses").alias(parses), F.struct("fmt", "posterior").alias(got)))
    # a text with one parse has it for certain; the others look theirs up
    base = base.withColumn(parses, F.when(F.size(cand) > 1, parsed))
    base = small_join(base, chosen, [src, parses], fit)
    if key is not None:
        again = counts.filter(F.size("parses") == 0).select(F.col("source").alias(src), *[F.col(f"by.b{i}").alias(c) for i, c in enumerate(by)], F.col("least").alias(least))
        base = small_join(base, again, [src, *by], fit)
    fmt = F.coalesce(F.col(got)["fmt"], F.get(cand, F.lit(0))["fmt"])
    base = base.withColumn(hits, F.when(F.size(cand) > 1, F.get(F.filter(cand, lambda c: c["fmt"] == F.col(got)["fmt"]), F.lit(0))).otherwise(F.get(cand, F.lit(0))))
    us, fold = F.col(hits)["us"], F.coalesce(F.col(hits)["fold"], F.lit(False))
    post = F.when(us.isNotNull(), F.coalesce(F.col(got)["posterior"], F.lit(1.0)))
    second = fold & (F.coalesce(F.col(key) > F.col(least), F.lit(False)) if key is not None else F.lit(False))
    unresolved = F.coalesce(F.col(got)["posterior"] < min_posterior, F.lit(False))
    named = F.coalesce(usual if usual is not None else F.col(text).rlike(USUAL), F.lit(False))
    return base.select(
        *keep,
        F.when(~unresolved, us + F.when(second, F.lit(US_HOUR)).otherwise(0)).alias(results[0]),
        fmt.alias(results[1]),
        post.alias(results[2]),
        F.when(us.isNull(), "unparsed").when(unresolved, "unresolved").when(second, "second").when(fold, "first").otherwise("ok").alias(results[3]),
        (us.isNotNull() & named).alias(results[4]),
        F.when(unresolved, F.array_sort(F.transform(cand, lambda c: c["us"]))).alias(results[5]),
    )


def unusual(df: DataFrame, out: str = "ts") -> DataFrame:
    """Rows whose time isn't in the usual form, or is in it but names an hour that occurs twice."""
    return df.filter(F.col(f"{out}_us").isNotNull() & (~F.col(f"{out}_usual") | F.col(f"{out}_status").isin("first", "second")))
