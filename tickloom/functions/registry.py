"""The dialect's functions as Spark SQL text.

Each entry takes the argument texts and gives the Spark expression.  Where
Spark's function of the same name differs (null and NaN rules, one-based
positions, the base of log, rounding), the text spells the dialect's meaning out
in built-ins, so expressions stay inside generated code.
"""

from __future__ import annotations

from collections.abc import Callable

from . import times
from .widths import micros

Text = Callable[..., str]



def guarded(name: str, x: str) -> str:
    """A logarithm that is NaN below 0 and minus infinity at 0."""
    return f"CASE WHEN ({x}) < 0 THEN DOUBLE('NaN') WHEN ({x}) = 0 THEN DOUBLE('-Infinity') ELSE {name}({x}) END"


def divide(a: str, b: str) -> str:
    """Division of doubles as IEEE has it: x/0 is infinite, 0/0 is no number."""
    try:
        zero = float(b) == 0
    except ValueError:
        zero = None
    if zero is False:
        return f"(CAST({a} AS DOUBLE) / {b})"
    return f"(CASE WHEN ({b}) = 0 THEN CAST({a} AS DOUBLE) * DOUBLE('Infinity') ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END)"


def modulo(a: str, b: str) -> str:
    return f"(({a}) % nullif({b}, 0))"


#: From here on doubles have no fraction, and beyond 2^63 none fits in the whole numbers that floor and ceil give.
LARGE = "4503599627370496D"
#: The double before a half, so that adding it never rounds up what lies below a half.
HALF = "0.49999999999999994D"


def whole(name: str, x: str) -> str:
    """floor or ceil as a double; large numbers, infinity and NaN stay as they are."""
    return f"CASE WHEN abs({x}) < {LARGE} THEN CAST({name}({x}) AS DOUBLE) ELSE CAST({x} AS DOUBLE) END"


def rounded(x: str, digits: str = "0") -> str:
    """Half away from zero, after scaling by a power of ten; large numbers, infinity and NaN stay as they are."""
    if digits == "0":
        return f"CASE WHEN abs({x}) < {LARGE} THEN sign({x}) * floor(abs({x}) + {HALF}) ELSE CAST({x} AS DOUBLE) END"
    scale = f"pow(10D, {digits})"
    scaled = f"(({x}) * {scale})"
    return f"CASE WHEN abs{scaled} < {LARGE} THEN sign({x}) * floor(abs{scaled} + {HALF}) / {scale} WHEN abs{scaled} < DOUBLE('Infinity') THEN {scaled} / {scale} ELSE CAST({x} AS DOUBLE) END"


def substr(x: str, start: str, count: str | None = None) -> str:
    """From a position that may lie before the text, up to start + count."""
    if count is None:
        return f"substring({x}, greatest({start}, 1))"
    return f"substring({x}, greatest({start}, 1), greatest(({start}) + ({count}) - greatest({start}, 1), 0))"


def split_part(x: str, by: str, i: str) -> str:
    return f"CASE WHEN ({i}) < 1 THEN '' ELSE split_part({x}, {by}, {i}) END"


def like(x: str, pattern: str, fold: bool = False) -> str:
    """LIKE with no escape character: a backslash stands for itself."""
    if pattern.startswith("'"):
        pattern = pattern.replace("\\\\", "\\\\\\\\")
    return f"(({x}) {'ILIKE' if fold else 'LIKE'} {pattern})"


def replace_first(x: str, pattern: str, to: str, flags: str = "''") -> str:
    if flags == "'g'":
        return f"regexp_replace({x}, {pattern}, {to})"
    # The first match is cut out by its place; what it is replaced with may refer to its groups.
    hit = f"regexp_substr({x}, {pattern})"
    at = f"regexp_instr({x}, {pattern})"
    changed = f"regexp_replace({hit}, {pattern}, {to})"
    return f"CASE WHEN {hit} IS NULL THEN {x} ELSE concat(left({x}, {at} - 1), {changed}, substring({x}, {at} + length({hit}))) END"


def array_slice(x: str, start: str, count: str = "2147483647") -> str:
    """From a place (from 1, or from the end if negative) so many; a negative count stops before the end."""
    s = f"IF(({start}) < 0, size({x}) + ({start}) + 1, {start})"
    n = f"IF(({count}) < 0, size({x}) - {s} + 1 + ({count}), {count})"
    return f"CASE WHEN ({start}) = 0 THEN slice({x}, 1, 0) WHEN {s} < 1 OR {s} > size({x}) THEN slice({x}, 1, 0) ELSE slice({x}, {s}, greatest({n}, 0)) END"


def time_bucket(width: str, ts: str, other: str | None = None) -> str:
    w = literal(width)
    if other is None:
        return times.bucket(w, ts)
    if other.startswith("'") and not other[1:2].isdigit():
        return times.zoned_bucket(w, ts, other)
    return times.bucket(w, ts, f"TIMESTAMP_NTZ{other}" if other.startswith("'") else other)


def literal(text: str) -> str:
    """The content of a literal's text."""
    if text.startswith("INTERVAL "):
        number = text.split("'")[1]
        return f"{round(float(number) * 1_000_000)}us" if text.endswith("SECOND") else text.split("'")[1]
    if not text.startswith("'"):
        raise ValueError(f"{text} must be a constant")
    return text[1:-1].replace("\\'", "'").replace("\\\\", "\\")


def to_time(x: str) -> str:
    return f"CAST(coalesce(timestamp_micros(CAST(round(try_cast({x} AS DOUBLE) * 1000000D) AS BIGINT)), try_to_timestamp(CAST({x} AS STRING))) AS TIMESTAMP_NTZ)"


def epoch(per_second: int) -> Text:
    def of_time(x: str) -> str:
        per = 1_000_000 // per_second if per_second <= 1_000_000 else None
        return f"({times.us(x)} DIV {per})" if per else f"({times.us(x)} * {per_second // 1_000_000})"

    return of_time


def from_epoch(per_second: int) -> Text:
    """The time that a number of units since 1970 stands for."""
    if per_second > 1_000_000:
        return lambda x: times.from_us(f"(CAST({x} AS BIGINT) DIV {per_second // 1_000_000})")
    return lambda x: times.from_us(f"CAST({x} AS BIGINT) * {1_000_000 // per_second}L")


#: What functions of a time give for a number instead.
OF_NUMBERS: dict[str, Text] = {"epoch_ms": from_epoch(1_000), "epoch_us": from_epoch(1_000_000), "epoch_ns": from_epoch(1_000_000_000)}
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


SPACE = r"[\\s\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"

SCALARS: dict[str, Text] = {
    # numbers
    "abs": lambda x: f"abs({x})",
    "floor": lambda x: whole("floor", x),
    "ceil": lambda x: whole("ceil", x),
    "trunc": lambda x: f"CASE WHEN abs({x}) < {LARGE} THEN sign({x}) * floor(abs({x})) ELSE CAST({x} AS DOUBLE) END",
    "round": rounded,
    "sqrt": lambda x: f"CASE WHEN ({x}) < 0 THEN DOUBLE('NaN') ELSE sqrt({x}) END",
    "ln": lambda x: guarded("ln", x),
    "log10": lambda x: guarded("log10", x),
    "log2": lambda x: guarded("log2", x),
    "log": lambda x, y=None: guarded("log10", x) if y is None else f"(ln({y}) / ln({x}))",
    "exp": lambda x: f"exp({x})",
    "pow": lambda x, y: f"pow({x}, {y})",
    "sign": lambda x: f"CAST(sign({x}) AS INT)",
    "pi": lambda: "pi()",
    "greatest": lambda *x: f"greatest({', '.join(x)})",
    "least": lambda *x: f"least({', '.join(x)})",
    "coalesce": lambda *x: f"coalesce({', '.join(x)})",
    "nullif": lambda x, y: f"nullif({x}, {y})",
    "if": lambda c, a, b: f"IF({c}, {a}, {b})",
    "to_float32": lambda x: f"CAST({x} AS FLOAT)",
    "to_float64": lambda x: f"CAST({x} AS DOUBLE)",
    "to_int32": lambda x: f"CAST({x} AS INT)",
    "to_string": lambda x: f"CAST({x} AS STRING)",
    "to_int64_or_zero": lambda x: f"coalesce(try_cast({x} AS BIGINT), 0)",
    # times
    "time_bucket": time_bucket,
    "date_trunc": lambda unit, x: times.trunc(literal(unit), x),
    "date_part": lambda name, x: times.part(literal(name), x),
    "date_diff": lambda unit, a, b: times.diff(literal(unit), a, b),
    "epoch_ms": epoch(1_000),
    "epoch_us": epoch(1_000_000),
    "epoch_ns": epoch(1_000_000_000),
    "to_timestamp": to_time,
    "to_unix_timestamp64_micro": times.us,
    "from_unix_timestamp64_micro": times.from_us,
    "to_start_of_day": lambda x: times.trunc("day", x),
    "to_start_of_hour": lambda x: times.trunc("hour", x),
    "to_start_of_minute": lambda x: times.trunc("minute", x),
    "strftime": lambda x, p: times.strftime(x, literal(p)),
    "format_datetime": lambda x, p: times.strftime(x, literal(p)),
    "timezone": lambda zone, x: f"CAST(from_utc_timestamp(CAST({x} AS TIMESTAMP), {zone}) AS TIMESTAMP_NTZ)",
    "now": lambda: "CAST(now() AS TIMESTAMP_NTZ)",
    "current_timestamp": lambda: "CAST(now() AS TIMESTAMP_NTZ)",
    # texts
    "lower": lambda x: f"lower({x})",
    "upper": lambda x: f"upper({x})",
    "reverse": lambda x: f"reverse({x})",
    "trim": lambda x: f"regexp_replace({x}, '^{SPACE}|{SPACE}$', '')",
    "ltrim": lambda x: f"regexp_replace({x}, '^{SPACE}', '')",
    "rtrim": lambda x: f"regexp_replace({x}, '{SPACE}$', '')",
    "length": lambda x: f"CAST(length({x}) AS BIGINT)",
    "starts_with": lambda x, y: f"startswith({x}, {y})",
    "ends_with": lambda x, y: f"endswith({x}, {y})",
    "contains": lambda x, y: f"contains({x}, {y})",
    "strpos": lambda x, y: f"CAST(instr({x}, {y}) AS BIGINT)",
    "left": lambda x, n: f"left({x}, {n})",
    "right": lambda x, n: f"right({x}, {n})",
    "repeat": lambda x, n: f"repeat({x}, CAST(least(greatest({n}, 0), 1048576) AS INT))",
    "substr": substr,
    "replace": lambda x, a, b: f"replace({x}, {a}, {b})",
    "split_part": split_part,
    "lpad": lambda x, n, p: f"lpad({x}, {n}, {p})",
    "rpad": lambda x, n, p: f"rpad({x}, {n}, {p})",
    "concat": lambda *x: f"concat({', '.join(x)})",
    "concat_ws": lambda *x: f"concat_ws({', '.join(x)})",
    "like": like,
    "ilike": lambda x, p: like(x, p, True),
    "regexp_matches": lambda x, p: f"(({x}) RLIKE {p})",
    "regexp_extract": lambda x, p, g="0": f"regexp_extract({x}, {p}, {g})",
    "regexp_replace": replace_first,
    "replace_regexp_all": lambda x, p, to: f"regexp_replace({x}, {p}, {_dollars(to)})",
    # arrays
    "array_sum": lambda x: f"aggregate({x}, 0D, (a, y) -> a + coalesce(y, 0))",
    "array_slice": array_slice,
    "array_length": lambda x: f"CAST(size({x}) AS BIGINT)",
}


def _dollars(to: str) -> str:
    import re

    return re.sub(r"\\(\d)", r"$\1", to)


#: Other names of the same functions.
ALIASES = {
    "ceiling": "ceil", "power": "pow", "signum": "sign", "ifnull": "coalesce", "nvl": "coalesce", "null_if": "nullif", "date_bin": "time_bucket",
    "datetrunc": "date_trunc", "datepart": "date_part", "datediff": "date_diff", "from_unixtime": "to_timestamp", "lcase": "lower", "ucase": "upper",
    "char_length": "length", "character_length": "length", "strlen": "length", "prefix": "starts_with", "suffix": "ends_with", "instr": "strpos",
    "position": "strpos", "substring": "substr", "regexp_like": "regexp_matches", "match": "regexp_matches", "len": "length",
}
for _name in ("year", "quarter", "month", "day", "hour", "minute", "second", "millisecond", "microsecond", "dayofweek", "dow", "isodow", "dayofyear", "doy", "week", "weekofyear", "epoch"):
    SCALARS[_name] = lambda x, _part=_name: times.part(_part, x)


def numbers(x: str) -> str:
    """x, or null where it is no number: what percentiles leave out."""
    return f"CASE WHEN NOT isnan({x}) THEN {x} END"


def both(x: str, y: str, value: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL AND ({y}) IS NOT NULL THEN {value} END"


def vwap(x: str, w: str) -> str:
    return f"(sum({both(x, w, f'({x}) * ({w})')}) / nullif(CAST(sum({both(x, w, w)}) AS DOUBLE), 0D))"


def skewness(x: str) -> str:
    """Adjusted by the sample size; null for under three values."""
    n = f"count({x})"
    return f"CASE WHEN {n} > 2 THEN sqrt({n} * ({n} - 1D)) / ({n} - 2D) * coalesce(skewness({x}), DOUBLE('NaN')) END"


def kurtosis(x: str) -> str:
    """Adjusted excess; null for under four values or without variance."""
    n = f"count({x})"
    return f"CASE WHEN {n} > 3 AND var_pop({x}) > 0 THEN ({n} - 1D) / (({n} - 2D) * ({n} - 3D)) * (({n} + 1D) * kurtosis({x}) + 6D) END"


def sample_moment(name: str, power: str, plus: str) -> Text:
    """A moment ratio over the sample variance instead of the population's."""
    return lambda x: f"(({name}({x}) + {plus}) * pow((count({x}) - 1D) / count({x}), {power}))"


AGGREGATES: dict[str, Text] = {
    "skew_samp": sample_moment("skewness", "1.5D", "0D"),
    "kurt_samp": sample_moment("kurtosis", "2D", "3D"),
    "sum": lambda x: f"sum({x})",
    "avg": lambda x: f"avg({x})",
    "min": lambda x: f"min({x})",
    "max": lambda x: f"max({x})",
    "count_if": lambda c: f"count_if({c})",
    "arg_min": lambda x, y: f"min_by({x}, {y})",
    "arg_max": lambda x, y: f"max_by({x}, {y})",
    "vwap": vwap,
    "corr": lambda x, y: f"nullif(corr({x}, {y}), DOUBLE('NaN'))",
    "covar_samp": lambda x, y: f"covar_samp({x}, {y})",
    "covar_pop": lambda x, y: f"covar_pop({x}, {y})",
    "stddev": lambda x: f"stddev_samp({x})",
    "stddev_pop": lambda x: f"stddev_pop({x})",
    "variance": lambda x: f"var_samp({x})",
    "var_pop": lambda x: f"var_pop({x})",
    "skewness": skewness,
    "kurtosis": kurtosis,
    "kurtosis_pop": lambda x: f"CASE WHEN var_pop({x}) > 0 THEN kurtosis({x}) END",
    "median": lambda x: f"percentile({numbers(x)}, 0.5)",
    "quantile_cont": lambda x, p: f"percentile({numbers(x)}, {p})",
    "quantile_t_digest": lambda x, p="0.5": f"CAST(approx_percentile({numbers(x)}, {p}, 10000) AS FLOAT)",
    "approx_quantile": lambda x, p: f"CAST(approx_percentile({numbers(x)}, {p}, 10000) AS DOUBLE)",
    "uniq_exact": lambda x: f"count(DISTINCT {x})",
    "string_agg": lambda x, by="','": f"array_join(collect_list({x}), {by})",
    "bool_and": lambda x: f"bool_and({x})",
    "bool_or": lambda x: f"bool_or({x})",
}
AGGREGATE_ALIASES = {
    "first": "arg_min", "min_by": "arg_min", "last": "arg_max", "max_by": "arg_max", "mean": "avg", "stddev_samp": "stddev", "var_samp": "variance",
    "var": "variance", "approx_count_distinct": "uniq_exact", "uniq": "uniq_exact", "weighted_avg": "vwap", "quantile": "quantile_cont",
    "percentile_cont": "quantile_cont", "quantile_exact": "quantile_cont", "median_tdigest": "quantile_t_digest",
}


def width_us(text: str) -> int:
    return micros(literal(text))


def scalar(name: str) -> Text | None:
    return SCALARS.get(ALIASES.get(name, name))


def aggregate(name: str) -> Text | None:
    return AGGREGATES.get(AGGREGATE_ALIASES.get(name, name))
