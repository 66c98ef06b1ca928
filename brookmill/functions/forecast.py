"""Forecast blocks in text: parsing them to labelled rows of numbers, and cutting them out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type of a parsed forecast: rows in the order of the text, each with its label and at least one number.
PARSED = "array<struct<pos:int,label:string,values:array<double>>>"
_BLOCK = r"(?is)<forecast>(.*?)(?:</forecast>|\z)"
_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def parse_forecast(text: Column) -> Column:
    """Rows ``(label: numbers)`` of the first forecast block, or of the whole text without one; null if there are none.

    A block may lack its closing tag. The last colon separates label and numbers, else the first comma; groups with
    neither, or without a number, are left out. Dates among the numbers are taken away first.
    """
    body = F.when(text.rlike("(?i)<forecast>"), F.regexp_extract(text, _BLOCK, 1)).otherwise(text)
    inner = F.transform(F.regexp_extract_all(body, F.lit(r"\(([^()\n]+)\)"), F.lit(1)), _strip)

    def row(x: Column) -> Column:
        colon = x.contains(":")
        value = F.when(colon, F.substring_index(x, ":", -1)).when(x.contains(","), F.substr(x, F.instr(x, ",") + 1))
        label = F.when(colon, F.substr(x, F.lit(1), F.length(x) - F.length(value) - 1)).otherwise(F.substring_index(x, ",", 1))
        numbers = F.regexp_extract_all(F.regexp_replace(value, r"\b[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\b", ""), F.lit(_NUMBER), F.lit(0))
        return F.struct(_strip(label).alias("label"), F.transform(numbers, lambda v: v.try_cast("double")).alias("values"))

    rows = F.filter(F.transform(inner, row), lambda r: F.size(r["values"]) > 0)
    numbered = F.transform(rows, lambda r, i: F.struct(i.alias("pos"), r["label"].alias("label"), r["values"].alias("values")))
    return F.when(F.size(rows) > 0, numbered)


def forecast_block(text: Column) -> Column:
    """The first block, wrapped anew and without blanks at its end; null where the text has no opening tag."""
    return F.when(text.rlike("(?i)<forecast>"), F.concat(F.lit("<forecast>"), F.regexp_replace(F.regexp_extract(text, _BLOCK, 1), r"\s+$", ""), F.lit("\n</forecast>")))


def number_text(v: Column) -> Column:
    """A number with up to six significant digits and no padding zeros."""
    size = F.greatest(F.abs(v), F.lit(1e-300))
    scale = F.pow(F.lit(10.0), F.greatest(F.lit(0), 5 - F.floor(F.log10(size))))
    plain = F.call_function("format_number", F.rint(v * scale) / scale, F.lit("0.##########"))
    return F.when(v == 0, "0").when((size >= 1e-4) & (size < 1e6), plain).otherwise(F.regexp_replace(F.format_string("%.5e", v), r"\.?0+e", "e"))


def forecast_text(parsed: Column, channel: Column) -> Column:
    """One channel of a parsed forecast as a block of ``(label: number)`` lines, in order; null for no rows."""
    lines = F.transform(parsed, lambda r: F.concat(F.lit("("), r["label"], F.lit(": "), number_text(F.get(r["values"], channel)), F.lit(")")))
    return F.concat(F.lit("<forecast>\n"), F.array_join(lines, "\n"), F.lit("\n</forecast>"))


def step_text(values: Column) -> Column:
    """Numbers as a forecast block whose labels are the numbers of the steps, from 0; null for null."""
    lines = F.transform(values, lambda v, i: F.concat(F.lit("("), i.cast("string"), F.lit(": "), number_text(v), F.lit(")")))
    return F.when(values.isNotNull(), F.array_join(F.concat(F.array(F.lit("<forecast>")), lines, F.array(F.lit("</forecast>"))), "\n"))


def reply_text(response: Column) -> Column:
    """The text of a service's JSON reply: ``output_text`` unless empty, else the first non-empty ``text`` of its output's contents; null without any."""
    v = F.try_parse_json(response)
    whole = F.nullif(F.try_variant_get(v, "$.output_text", "string"), F.lit(""))
    items = F.coalesce(F.try_variant_get(v, "$.output", "array<variant>"), F.array().cast("array<variant>"))
    parts = F.flatten(F.transform(items, lambda x: F.coalesce(F.try_variant_get(x, "$.content", "array<variant>"), F.array().cast("array<variant>"))))
    texts = F.filter(F.transform(parts, lambda c: F.try_variant_get(c, "$.text", "string")), lambda t: t.isNotNull() & (t != ""))
    return F.coalesce(whole, F.try_element_at(texts, F.lit(1)))
