"""Series written inline in prompts: removing, thinning and parsing ``<timeseries>`` blocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip_block(prompt: Column) -> Column:
    """The prompt without any of its series blocks, tags included."""
    return F.regexp_replace(prompt, r"(?s)<timeseries>.*?</timeseries>", "")


def block_body(prompt: Column) -> Column:
    """What stands in the first block, or null without one."""
    return F.when(prompt.rlike(r"(?s)<timeseries>.*?</timeseries>"), F.regexp_extract(prompt, r"(?s)<timeseries>(.*?)</timeseries>", 1))


def parse_block(df: DataFrame, key: list[str], prompt: str, strict: bool = False) -> DataFrame:
    """(key, step, t, channel, value): the first block's data lines in long form, steps from 0.

    Only lines ``number: name=value, ...`` are data; ``null`` and empty values come out as null, and so does what is
    not a number. Rows without a block, or without data lines, give nothing; channels may differ from line to line.
    With ``strict`` all three raise instead.
    """
    lines = F.filter(F.split(block_body(F.col(prompt)), "\n"), lambda x: x.rlike(r"^[0-9.]+:\s*\S"))
    if strict:
        lines = F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, lines).otherwise(F.raise_error(F.lit("no series block with data")))
    steps = df.select(*key, F.posexplode(lines).alias("step", "_line"))
    pairs = steps.select(
        *key, "step", F.regexp_extract("_line", r"^([0-9.]+):", 1).try_cast("double").alias("t"),
        F.explode(F.split(F.regexp_extract("_line", r"^[0-9.]+:\s*(.+)$", 1), ",")).alias("_kv"))
    value = F.btrim(F.substr(F.col("_kv"), F.instr(F.col("_kv"), "=") + 1))
    number = F.when(value.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), value.try_cast("double"))
    if strict:
        number = F.when(number.isNotNull() | value.isin("", "null"), number).otherwise(F.raise_error(F.concat(F.lit("not a number: "), value)))
    return pairs.where(F.col("_kv").contains("=")).select(*key, "step", "t", F.btrim(F.substring_index("_kv", "=", 1)).alias("channel"), number.alias("value"))


def linspace_picks(n: Column, m: Column) -> Column:
    """At most ``m`` distinct places among 0..n-1, evenly spread and rounded half to even, ends included."""
    step = F.try_divide((n - 1).cast("double"), (m - 1).cast("double"))
    spread = F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.when(i == m - 1, n - 1).otherwise(F.rint(i * step).cast("int")))
    return F.when(m == 1, F.array(F.lit(0))).otherwise(F.array_distinct(spread))


#: What ends a line of a block, and the numbers that are rounded. Fixed values.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
DATA_LINE = r"^\s*[0-9.]+\s*:\s*\S"
DECIMAL = r"-?[0-9]+\.[0-9]+"


def _rounded(decimals: int):  # noqa: ANN202
    @F.pandas_udf("array<string>")
    def rounded(numbers: pd.Series) -> pd.Series:
        return numbers.map(lambda xs: None if xs is None else [x if x == "\n" else format(float(x), f".{decimals}f") for x in xs])

    return rounded


def thin_block(prompt: Column, max_lines: int = 12, decimals: int = 1) -> Column:
    """The prompt with its first block cut to ``max_lines`` data lines and their decimals rounded; 0 or less keeps all lines.

    Other lines stay. Decimals are rounded whether or not lines are dropped. Lines end with one line feed each, the last
    with none. Only the rounding leaves the JVM: exact halves of a binary number have no counterpart among built-in functions.
    """
    opening, closing = "<timeseries>", "</timeseries>"
    start = F.instr(prompt, opening) + len(opening)
    rest = F.substr(prompt, start)
    end = F.instr(rest, closing)
    body = F.substr(rest, F.lit(1), end - 1)
    lines = F.split(F.regexp_replace(body, f"(?:{LINE_BREAK})\\z", ""), LINE_BREAK, -1)
    is_data = lambda x: x.rlike(DATA_LINE)
    places = F.array_compact(F.transform(lines, lambda x, i: F.when(is_data(x), i)))
    if max_lines > 0:
        some = F.transform(linspace_picks(F.size(places), F.lit(max_lines)), lambda i: F.get(places, i))
        places = F.when(F.size(places) > max_lines, some).otherwise(places)
    kept = F.array_compact(F.transform(lines, lambda x, i: F.when(~is_data(x) | F.array_contains(places, i), x)))
    # a line is its parts between numbers, each followed by its number, the last by the line's end
    parts = F.transform(kept, lambda x: F.when(is_data(x), F.split(x, DECIMAL, -1)).otherwise(F.array(x)))
    numbers = F.transform(kept, lambda x: F.concat(F.when(is_data(x), F.regexp_extract_all(x, F.lit(DECIMAL), F.lit(0))).otherwise(F.array().cast("array<string>")), F.array(F.lit("\n"))))
    joined = F.array_join(F.zip_with(F.flatten(parts), _rounded(decimals)(F.flatten(numbers)), lambda a, b: F.concat(a, b)), "")
    thin = F.concat(F.substr(prompt, F.lit(1), start - 1), F.regexp_replace(joined, r"\n\z", ""), F.substr(rest, end))
    return F.when((F.instr(prompt, opening) > 0) & (end > 0), thin).otherwise(prompt)
