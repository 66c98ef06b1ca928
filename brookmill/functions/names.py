"""What a manifest id or path names: entity, window and channel. Column expressions only, so they stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEP = "[^a-z0-9]+"
#: The last place in a text where an entity (ten letters and digits, at least one a letter) is followed by two numbers, then perhaps a channel.
PATTERN = (
    r"(?s)^(?:.*[^a-z0-9])?((?=[0-9]*[a-z])[a-z0-9]{10})" + _SEP + "f?0*([0-9]{1,18})" + _SEP + "f?0*([0-9]{1,18})(?![0-9])"
    + "(?:[^a-z0-9]*ch[^a-z0-9]*0*([0-9]{1,9})(?![0-9]))?"
)


def canonical(text: Column) -> Column:
    """Lower case, URL escapes undone, full-width forms narrowed, invisible characters removed, blanks at the ends removed.

    Null stays null. A text with a stray percent sign keeps it.
    """
    s = F.regexp_replace(text, "[­​-‏⁠﻿]", "")
    wide = "".join(chr(c) for c in [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), 0xFF3F])
    plain = "".join(chr(ord(c) - 0xFEE0) for c in wide)
    s = F.when(s.contains("%"), F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), F.regexp_replace(s, "(?i)%5f", "_"))).otherwise(s)
    return F.btrim(F.lower(F.translate(s, wide, plain)), F.lit(" \t\r\n\f "))


def entity(text: Column) -> Column:
    """The entity that an id or path names, or null."""
    return F.nullif(F.regexp_extract(canonical(text), PATTERN, 1), F.lit(""))


def window_names(texts: Column) -> Column:
    """What each of an array of texts names: ARRAY<STRUCT<entity STRING, ch INT, first BIGINT, last BIGINT>>.

    An element is null where the text is null, names nothing, or ends before it begins. Separators, zero padding, ``f``
    before frame numbers, folders, source prefixes, extensions and copy marks don't matter. One pattern is run per text.
    """
    mark = "\x01"
    found = F.transform(F.transform(texts, canonical), lambda s: F.regexp_replace(s, PATTERN + "(?s:.*)$", mark + "$1|$2|$3|$4"))
    parts = F.transform(found, lambda s: F.when(F.startswith(s, F.lit(mark)), F.split(F.substr(s, F.lit(2)), r"\|", -1)))
    named = F.transform(parts, lambda x: F.struct(x[0].alias("entity"), x[3].try_cast("int").alias("ch"), x[1].try_cast("bigint").alias("first"), x[2].try_cast("bigint").alias("last")))
    return F.transform(named, lambda n: F.when(n["first"] <= n["last"], n))


def window_name(text: Column) -> Column:
    """What one text names; see window_names."""
    return window_names(F.array(text))[0]
