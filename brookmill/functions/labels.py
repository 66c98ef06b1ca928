"""Reading a class label off a model's free text, as one column expression per label set."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Characters that a label of only such characters must not touch on either side. Fixed values.
UNTOUCHED = ("[0-9]", "[A-Za-z]")


def longest_first(labels: Iterable[str]) -> list[str]:
    """Distinct labels, longest first, those of one length by code points."""
    by_code = sorted(set(map(str, labels)))
    return [x for n in sorted(set(map(len, by_code)), reverse=True) for x in by_code if len(x) == n]


def label_pattern(labels: Iterable[str]) -> str:
    """One group of alternatives per kind of label: first those of mixed characters, which match anywhere, then those
    that must stand apart from characters like their own. Where two kinds match at one place the mixed label is longer,
    so groups keep the order of longest_first. Case doesn't count, in any script.
    """
    kinds: dict[str, list[str]] = {kind: [] for kind in ("", *UNTOUCHED)}
    for label in longest_first(labels):
        kind = next((k for k in UNTOUCHED if re.fullmatch(f"{k}+", label)), "")
        kinds[kind].append("".join(c if c.isalnum() else "\\" + c for c in label))
    groups = [("(?<!{0})(?:{1})(?!{0})" if kind else "(?:{1})").format(kind, "|".join(found)) for kind, found in kinds.items() if found]
    return "(?iu)" + "|".join(groups)


def parse_label(raw: Column, labels: Iterable[str], fallback: bool = True) -> Column:
    """The label that ``raw`` states, in the label set's own spelling, or null.

    The leftmost strict match wins, case aside. Only without one, and with ``fallback``, the text's leading run of
    letters or of digits is read, and the longest label it begins with is taken. Null, empty and label-free texts, and
    an empty label set, give null. Labels that differ only by case stand for the last of them in label order.
    """
    ordered = longest_first(labels)
    if not ordered:
        return F.lit(None).cast("string")
    spelling = {x.lower(): x for x in ordered}
    known = F.create_map(*[F.lit(v) for kv in spelling.items() for v in kv])
    strict = F.try_element_at(known, F.lower(F.regexp_substr(raw, F.lit(label_pattern(ordered)))))
    if not fallback:
        return strict
    head = F.lower(F.regexp_substr(F.regexp_replace(raw, r"^\s+", ""), F.lit(r"^(?:[A-Za-z]+|[0-9]+)")))
    begun = F.filter(F.array(*(F.lit(x) for x in ordered)), lambda x: F.startswith(head, F.lower(x)))
    return F.coalesce(strict, F.try_element_at(known, F.lower(F.try_element_at(begun, F.lit(1)))))
