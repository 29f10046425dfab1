"""Column expressions: missing values, ratios, months, bands, ids and text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

# English month names and their number.
MONTH_NUMBERS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9,
    "oct": 10, "nov": 11, "dec": 12,
}

# Visits per month for a cadence word, and for a customer priority.
CADENCE_PER_MONTH = {
    "weekly": 4.0, "biweekly": 2.0, "fortnightly": 2.0, "monthly": 1.0, "quarterly": 1.0 / 3.0,
    "high": 2.0, "medium": 1.0, "low": 0.5,
}
PRIORITY_PER_MONTH = {"high": 2.0, "medium": 1.0, "low": 0.5}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(mapping: Mapping) -> Column:
    """A literal map; use it for small fixed vocabularies only."""
    return F.create_map(*[F.lit(x) for x in chain(*mapping.items())])


# --- missing values -------------------------------------------------------------------------

def number(c: str | Column) -> Column:
    """Numeric coercion: text that is no number, NaN and infinities become null."""
    value = col(c).try_cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def finite_or_null(c: str | Column) -> Column:
    value = col(c)
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def finite_or(c: str | Column, fill: float = 0.0, low: float | None = None, high: float | None = None) -> Column:
    """Replace missing and infinite by ``fill`` and clip."""
    value = F.coalesce(finite_or_null(c), F.lit(float(fill)))
    if low is not None:
        value = F.greatest(value, F.lit(float(low)))
    if high is not None:
        value = F.least(value, F.lit(float(high)))
    return value


def missing_flag(c: str | Column) -> Column:
    return F.when(finite_or_null(c).isNull(), 1).otherwise(0)


def clean_text(c: str | Column, fill: str = "Unknown") -> Column:
    return F.trim(F.coalesce(col(c).cast("string"), F.lit(fill)))


def complete_rows(df: DataFrame, required: Sequence[str], measures: Sequence[str] = ()) -> DataFrame:
    """Keep rows whose required columns are present and whose measures are finite numbers."""
    keep = F.lit(True)
    for name in required:
        keep = keep & F.col(name).isNotNull()
    for name in measures:
        keep = keep & number(name).isNotNull()
    return df.filter(keep)


# --- ratios ---------------------------------------------------------------------------------

def ratio_or(numerator, denominator, fill: float = 0.0) -> Column:
    """Quotient, or ``fill`` where the denominator is (nearly) zero, missing or infinite."""
    d = finite_or_null(denominator)
    return F.when(F.abs(d) > 1e-12, col(numerator) / d).otherwise(F.lit(float(fill)))


def ratio_floored(numerator, denominator) -> Column:
    """Quotient by a denominator whose magnitude is at least one."""
    return col(numerator) / F.greatest(F.abs(col(denominator)), F.lit(1.0))


def ratio_or_null(numerator, denominator) -> Column:
    """Quotient for a positive denominator, else null."""
    d = col(denominator)
    return F.when(d > 0, col(numerator) / d)


# --- months ---------------------------------------------------------------------------------

def month_start(c: str | Column) -> Column:
    return F.trunc(col(c).cast("date"), "MM")


def month_index(c: str | Column) -> Column:
    """Consecutive integers for consecutive calendar months (RANGE frames need a number)."""
    d = col(c)
    return F.year(d) * 12 + F.month(d)


def month_from_parts(year, month) -> Column:
    """First of the month from a year and a month given as number, name or abbreviation."""
    text = F.lower(F.trim(col(month).cast("string")))
    as_number = text.try_cast("double")
    n = F.coalesce(as_number, F.element_at(lookup(MONTH_NUMBERS), text).cast("double"))
    y = col(year).try_cast("double")
    valid = (n >= 1) & (n <= 12) & (n == F.floor(n)) & (y == F.floor(y))
    return F.when(valid, F.make_date(y.cast("int"), n.cast("int"), F.lit(1)))


def tenure_months(period, start) -> Column:
    return F.greatest(F.lit(1), month_index(period) - month_index(start))


def payout_date(period, delay_days) -> Column:
    return F.date_add(F.last_day(col(period)), col(delay_days).cast("int") if not isinstance(delay_days, int) else delay_days)


def split_label(period, train_end, validation_end) -> Column:
    p = col(period)
    return (
        F.when(p <= F.to_date(F.lit(train_end)), "train")
        .when(p <= F.to_date(F.lit(validation_end)), "validation")
        .otherwise("test")
    )


# --- booleans -------------------------------------------------------------------------------

TRUE_WORDS = ("true", "1", "1.0", "yes", "y", "completed")
FALSE_WORDS = ("false", "0", "0.0", "no", "n", "cancelled", "canceled")


def lenient_bool(c, default: bool = False) -> Column:
    """Truthy or falsy words; any other word takes the default."""
    word = F.lower(F.trim(col(c).cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False).otherwise(default)


def numeric_bool(c) -> Column:
    """Truthy or falsy words; any other number is true unless it is zero, anything else is false."""
    word = F.lower(F.trim(col(c).cast("string")))
    n = word.try_cast("double")
    return F.when(word.isin("true", "yes", "y", "1"), True).when(word.isin("false", "no", "n", "0"), False).otherwise(F.coalesce((n != 0) & ~F.isnan(n), F.lit(False)))


def strict_bool(c, label: str = "flag") -> Column:
    """Boolean words only; anything else fails the query."""
    word = F.lower(F.trim(col(c).cast("string")))
    return (
        F.when(word.isin("true", "1", "1.0"), True)
        .when(word.isin("false", "0", "0.0"), False)
        .otherwise(F.raise_error(F.lit(f"{label}: missing or ambiguous boolean")).cast("boolean"))
    )


# --- bands ----------------------------------------------------------------------------------

def first_match(conditions: Iterable[tuple[Column, object]], default) -> Column:
    """The label of the first condition that holds."""
    out = None
    for condition, label in conditions:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out.otherwise(default)


def right_closed_band(c, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Bands (-inf, e1], (e1, e2], ..., (en, inf); ``len(labels) == len(edges) + 1``."""
    if len(labels) != len(edges) + 1:
        raise ValueError("one label more than edges")
    value = col(c)
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels):
        out = out.when(value <= edge, label)
    return out.otherwise(labels[-1])


def payout_multiplier(attainment) -> Column:
    """Piecewise-linear payout multiplier of target attainment (1.0 = on target)."""
    a = col(attainment)
    return (
        F.when(a < 0.70, 0.20 * a / 0.70)
        .when(a < 0.90, 0.60 + 1.0 * (a - 0.70))
        .when(a < 1.00, 0.80 + 2.0 * (a - 0.90))
        .when(a < 1.20, 1.00 + 1.5 * (a - 1.00))
        .otherwise(F.least(F.lit(2.0), 1.30 + 1.2 * (a - 1.20)))
    )


def signed_log(c) -> Column:
    value = col(c)
    return F.signum(value) * F.log1p(F.abs(value))


def whole_count(c) -> Column:
    """A nonnegative product that is an integer up to 1e-7, as a count; else null."""
    value = col(c)
    return F.when((value >= 0) & (F.abs(value - F.rint(value)) <= 1e-7), F.rint(value).cast("long"))


# --- geography ------------------------------------------------------------------------------

def spread(latitude_std, longitude_std) -> Column:
    return F.hypot(F.coalesce(col(latitude_std), F.lit(0.0)), F.coalesce(col(longitude_std), F.lit(0.0)))


def planar_km(lat_a, lon_a, lat_b, lon_b) -> Column:
    """Flat-earth distance, 111 km per degree, longitude shrunk by the mean latitude."""
    mean_lat = F.radians((col(lat_a) + col(lat_b)) / 2.0)
    return F.hypot((col(lat_a) - col(lat_b)) * 111.0, (col(lon_a) - col(lon_b)) * 111.0 * F.cos(mean_lat))


# --- stable ids and seeded values -----------------------------------------------------------

def _parts(values) -> Column:
    return F.concat_ws("|", *[F.lower(F.trim(F.coalesce(col(v).cast("string"), F.lit("")))) for v in values])


def stable_id(prefix: str, *values, length: int = 12) -> Column:
    """Prefix and the first hex digits of SHA-256 over the trimmed, lower-cased parts."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(_parts(values), 256), 1, length))


def exact_id(prefix: str, *values, length: int = 16) -> Column:
    """Like ``stable_id`` but over the parts exactly as written."""
    text = F.concat_ws("|", *[col(v).cast("string") for v in values])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(text, 256), 1, length))


def stable_integer(value, seed: int = 42, modulus: int | None = None, digits: int = 15) -> Column:
    """First hex digits of a seeded SHA-256 as a number, optionally reduced."""
    digest = F.sha2(F.concat(F.lit(f"{seed}|"), col(value).cast("string")), 256)
    n = F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")
    return F.pmod(n, F.lit(modulus)) if modulus else n


def stable_uniform(token, seed: int, salt: str, low: float = 0.0, high: float = 1.0) -> Column:
    """Seeded hash of a token spread over [low, high]."""
    digest = F.sha2(F.concat(F.lit(f"{seed}|{salt}|"), col(token).cast("string")), 256)
    share = F.conv(F.substring(digest, 1, 15), 16, 10).cast("double") / float(16**15 - 1)
    return F.lit(float(low)) + (float(high) - float(low)) * share


def value_or_seeded(df: DataFrame, column: str, token, seed: int, low: float, high: float,
                    integers: bool = False) -> Column:
    """The column's own finite value, else a seeded fallback for the row's token."""
    fallback = stable_uniform(token, seed, column, low, high)
    if integers:
        fallback = F.floor(fallback + 1e-12).cast("double")
    return F.coalesce(number(column), fallback) if column in df.columns else fallback


# --- text lists and JSON --------------------------------------------------------------------

def has_label(c, value) -> Column:
    """Whether a ``a|b|c`` list holds the value."""
    return F.array_contains(F.split(col(c), r"\|"), value)


def share_tokens(c) -> Column:
    """``id:share|id:share`` as an array of (key, share); null when any token is malformed."""
    tokens = F.split(col(c), r"\|")
    parsed = F.transform(
        tokens,
        lambda t: F.struct(
            F.regexp_extract(t, r"^(.*):[^:]*$", 1).alias("key"),
            F.regexp_extract(t, r"^.*:([^:]*)$", 1).try_cast("double").alias("share"),
        ),
    )
    return F.when(
        F.forall(parsed, lambda x: x["share"].isNotNull()),
        F.filter(parsed, lambda x: (x["key"] != "") & (x["share"] > 0)),
    )


def visits_per_month(cadence, priority, divisor: float = 1.6) -> Column:
    """A numeric cadence score over the service cycle, a cadence word, or the priority's default."""
    word = F.lower(F.trim(col(cadence).cast("string")))
    rank = F.lower(col(priority).cast("string"))
    return F.greatest(
        F.coalesce(
            col(cadence).try_cast("double") / divisor,
            F.element_at(lookup(CADENCE_PER_MONTH), word),
            F.element_at(lookup(PRIORITY_PER_MONTH), rank),
            F.lit(1.0),
        ),
        F.lit(0.0),
    )


def json_object(*columns) -> Column:
    return F.to_json(F.struct(*columns))


def json_number(payload, field: str) -> Column:
    """A numeric field of a JSON object, or of the first object in a JSON array."""
    text = col(payload).cast("string")
    return F.coalesce(F.get_json_object(text, f"$.{field}"), F.get_json_object(text, f"$[0].{field}")).try_cast("double")


def json_strings(payload) -> Column:
    """A JSON list of strings as an array (null when it is not a list)."""
    return F.from_json(col(payload).cast("string"), "array<string>")


# --- column formulas ------------------------------------------------------------------------

FORMULA_NAMES = {"greatest", "least", "abs"}


def with_formulas(df: DataFrame, formulas: Mapping[str, str], constants: Mapping[str, float] | None = None) -> DataFrame:
    """Add columns from Spark SQL arithmetic, in order; later formulas see earlier columns.

    Only column names, constants, numbers, + - * / ( ) , and greatest / least / abs are allowed.
    """
    constants = dict(constants or {})
    for name, text in formulas.items():
        if re.sub(r"[A-Za-z0-9_.\s+\-*/(),]", "", text) or "--" in text or "/*" in text:
            raise ValueError(f"formula {name} has characters outside the arithmetic language")
        known = {c.lower() for c in df.columns}
        expression = text
        for word in sorted(set(re.findall(r"[A-Za-z_]\w*", text)), key=len, reverse=True):
            if word in constants and word.lower() not in known:
                expression = re.sub(rf"\b{word}\b", f"{float(constants[word])!r}D", expression)
            elif word.lower() not in known and word not in FORMULA_NAMES:
                raise ValueError(f"formula {name} names an unknown column {word}")
        for call in re.findall(r"([A-Za-z_]\w*)\s*\(", text):
            if call not in FORMULA_NAMES:
                raise ValueError(f"formula {name} calls {call}")
        df = df.withColumn(name, F.expr(expression))
    return df
