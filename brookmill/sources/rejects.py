"""Loading delimited and JSON-line records while setting aside, with a reason, those that fail."""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fields of a record, in order. Fixed values.
FIELDS = ("id", "task", "timeseries_path", "prompt", "answer", "n_steps", "n_channels")
TASKS = ("classification", "prediction")
DELIMITERS = {"csv": ",", "tsv": "\t"}
QUOTING, COLUMNS, VALUE = "quoting", "columns", "value"

LOADED = (
    "raw_id bigint, file_name string, fmt string, id string, task string, timeseries_path string, prompt string, answer string, "
    "n_steps bigint, n_channels bigint, reason string, detail string, payload string"
)

#: A field as RFC 4180 has it; Arrow's own parser forgives quotes in the wrong place, so they are judged first, a column at a time.
_FIELD = r'(?:"[^"]*(?:""[^"]*)*"|[^"{d}\r\n]*)'
_QUOTED = {d: f"^{_FIELD.format(d=d)}(?:{d}{_FIELD.format(d=d)})*(?:\\r\\n|\\n)?$" for d in DELIMITERS.values()}
_TAG = re.compile(r"</?timeseries>")
_DATA = re.compile(r"^[0-9.]+:[^\S\n]*(\S.*)$", re.M)
_NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_CONTROL = r"[\x00-\x1f\x7f\x{80}-\x{9f}]"
_COUNT = r"^[0-9]*[1-9][0-9]*$"
_SURROGATE = re.compile("[\ud800-\udfff]")


def _no_constant(name: str) -> None:
    raise ValueError(name)


def parse_json(text: str | None) -> tuple[dict[str, object] | None, str | None]:
    """The object of one JSON line, or why it isn't one: not well-formed, or other keys than the seven, each once."""
    try:
        repeated: list[bool] = []

        def pairs(kv: list[tuple[str, object]]) -> dict[str, object]:
            d = dict(kv)
            repeated.append(len(d) < len(kv))
            return d

        found = json.loads(text, parse_constant=_no_constant, object_pairs_hook=pairs)
    except (ValueError, TypeError, RecursionError):
        return None, QUOTING
    if not isinstance(found, dict):
        return None, QUOTING
    if set(found) != set(FIELDS) or repeated[-1]:
        return None, COLUMNS
    # half a surrogate pair is well-formed JSON but no text: it becomes the replacement character
    return {k: _SURROGATE.sub("\ufffd", v) if isinstance(v, str) else v for k, v in found.items()}, None


def bad_prompt(prompt: object) -> bool:
    """Blank, with unpaired series tags, or with a data line in a block that gives a name something else than a number, ``null`` or nothing."""
    if not isinstance(prompt, str) or not prompt.strip():
        return True
    inside, start = False, 0
    for tag in _TAG.finditer(prompt):
        if (tag[0] == "<timeseries>") == inside:
            return True
        if inside:
            for line in _DATA.finditer(prompt[start : tag.start()]):
                for pair in line[1].split(","):
                    name, eq, value = pair.partition("=")
                    value = value.strip()
                    if eq and value not in ("", "null") and not _NUMBER.fullmatch(value):
                        return True
        inside, start = not inside, tag.end()
    return inside


def _texts(values: list) -> pa.Array:
    return pa.array([v if isinstance(v, str) else None for v in values], pa.string())


def _yes(mask: pa.Array) -> pa.Array:
    return pc.fill_null(mask, False)


def _count(values: list, json_: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(good, value, beyond): which cells are counts, their BIGINT values, and which of them are beyond a BIGINT."""
    text = _texts(values)
    digits = pc.and_(pc.invert(json_), _yes(pc.match_substring_regex(text, _COUNT)))
    number = pa.array([v if isinstance(v, int) and not isinstance(v, bool) and v > 0 else None for v in values], pa.decimal256(76, 0)) if all(not isinstance(v, int) or abs(v) < 10**70 for v in values) else None
    if number is None:  # a JSON integer of more than 70 digits
        number = pa.array([min(v, 10**70) if isinstance(v, int) and not isinstance(v, bool) and v > 0 else None for v in values], pa.decimal256(76, 0))
    good = pc.or_(digits, pc.and_(json_, pc.is_valid(number)))
    bare = pc.if_else(digits, pc.utf8_ltrim(text, characters="0"), None)
    # what has at most 19 digits is compared as a number
    parsed = pc.cast(pc.if_else(pc.less_equal(pc.utf8_length(bare), 19), bare, None), pa.decimal256(76, 0))
    any_ = pc.coalesce(pc.if_else(json_, number, None), parsed)
    fits = _yes(pc.less_equal(any_, pa.scalar(2**63 - 1, pa.decimal256(76, 0))))
    return good, pc.cast(pc.if_else(fits, any_, None), pa.int64()), pc.and_(good, pc.invert(fits))


def _labels(cols: dict[str, list], is_json: list[bool]) -> tuple[list[str | None], dict[str, pa.Array], list[str | None]]:
    """For each record the first field whose value is bad, or None; the typed counts; and the first count beyond a BIGINT.

    Cells are read as texts and judged and cast a column at a time; only prompts with series tags are read one by one.
    """
    json_ = pa.array(is_json, pa.bool_())
    ident, task, path, prompt = (_texts(cols[c]) for c in FIELDS[:4])
    full = lambda t: _yes(pc.greater(pc.utf8_length(pc.utf8_trim_whitespace(t)), 0))
    none = pa.array([v is None for v in cols["timeseries_path"]], pa.bool_())
    empty = pc.or_(none, pc.and_(pc.invert(json_), _yes(pc.equal(path, ""))))
    named = pc.and_(_yes(pc.ends_with(path, ".csv")), pc.invert(_yes(pc.match_substring_regex(path, _CONTROL))))
    tagged = _yes(pc.match_substring(prompt, "timeseries>")).to_pylist()
    said = pa.array([not t or not bad_prompt(p) for t, p in zip(tagged, cols["prompt"])], pa.bool_())
    counts = {c: _count(cols[c], json_) for c in ("n_steps", "n_channels")}
    good = {
        "id": full(ident), "task": pc.is_in(task, value_set=pa.array(TASKS)), "timeseries_path": pc.or_(empty, named), "prompt": pc.and_(full(prompt), said),
        **{c: x[0] for c, x in counts.items()}}
    first = lambda ok: pc.coalesce(*(pc.if_else(m, None, pa.scalar(f, pa.string())) for f, m in ok.items())).to_pylist() if is_json else []
    return first(good), {c: x[1] for c, x in counts.items()}, first({c: pc.invert(x[2]) for c, x in counts.items()})


def read_delimited(payloads: list[str], delimiter: str) -> tuple[dict[int, list[str]], dict[int, str]]:
    """Fields of each well-quoted record by its place, and the structural rejects by theirs.

    Quoting is judged within records, so that one open quote can't swallow its neighbours. What is well quoted goes
    through one Arrow CSV read with every field a string; rows of another width come back through its callback.
    """
    good, rejects, lines = {}, {}, []
    quoted = pc.match_substring_regex(pa.array(payloads, pa.string()), _QUOTED[delimiter]).to_pylist()
    for i, text in enumerate(payloads):
        if text is None:
            rejects[i] = COLUMNS
        elif not quoted[i]:
            rejects[i] = QUOTING
        else:
            lines.append(f"{i}{delimiter}{text.rstrip(chr(13) + chr(10)) if text.endswith(chr(10)) else text}")
    if not lines:
        return good, rejects

    def invalid(row: pacsv.InvalidRow) -> str:
        rejects[int(row.text.partition(delimiter)[0])] = COLUMNS
        return "skip"

    names = ["_at", *FIELDS]
    data = ("\n".join(lines) + "\n").encode("utf-8", "surrogatepass")
    found = pacsv.read_csv(
        io.BytesIO(data),
        read_options=pacsv.ReadOptions(use_threads=False, column_names=names, block_size=len(data) + 1),
        parse_options=pacsv.ParseOptions(delimiter=delimiter, newlines_in_values=True, invalid_row_handler=invalid),
        convert_options=pacsv.ConvertOptions(column_types={n: pa.string() for n in names}, strings_can_be_null=False, check_utf8=False),
    ).to_pydict()
    for i, *fields in zip(*(found[n] for n in names)):
        good[int(i)] = fields
    return good, rejects


def load_records(raw: DataFrame) -> DataFrame:
    """Every record of ``raw`` (raw_id, file_name, fmt, payload) once: typed where ``reason`` is null, else a reject.

    ``reason`` is the first of quoting, columns and value that applies, ``detail`` the field of a bad value. A reject
    keeps its payload and no fields; a loaded row has fields and no payload. An empty path is null. A row with a count
    beyond a BIGINT loads with null there, ``detail`` naming the field and the payload kept. A null payload has no fields (columns; for jsonl, quoting); a format that isn't known is
    ``columns``. Extra columns of ``raw`` are not carried. No shuffle: records are judged where they are read.
    """

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("raw_id", pa.int64()), ("file_name", pa.string()), ("fmt", pa.string()), *((f, pa.string()) for f in FIELDS[:5]),
            ("n_steps", pa.int64()), ("n_channels", pa.int64()), ("reason", pa.string()), ("detail", pa.string()), ("payload", pa.string()),
        ])
        for batch in batches:
            got = batch.to_pydict()
            n = len(got["raw_id"])
            fields: list[list | None] = [None] * n
            reason: list[str | None] = [None] * n
            for fmt, delimiter in DELIMITERS.items():
                at = [i for i in range(n) if got["fmt"][i] == fmt]
                good, bad = read_delimited([got["payload"][i] for i in at], delimiter)
                for k, i in enumerate(at):
                    fields[i], reason[i] = good.get(k), bad.get(k)
            for i in range(n):
                if got["fmt"][i] == "jsonl":
                    found, reason[i] = parse_json(got["payload"][i])
                    fields[i] = [found[f] for f in FIELDS] if found is not None else None
                elif got["fmt"][i] not in DELIMITERS:
                    reason[i] = COLUMNS
            at = [i for i in range(n) if reason[i] is None]
            cols = {f: [fields[i][k] for i in at] for k, f in enumerate(FIELDS)}
            detail: list[str | None] = [None] * n
            bad, counts, beyond = _labels(cols, [got["fmt"][i] == "jsonl" for i in at])
            for i, d, more in zip(at, bad, beyond):
                if d:
                    reason[i], detail[i], fields[i] = VALUE, d, None
                else:
                    detail[i] = more
            loaded = {i: k for k, i in enumerate(at) if fields[i] is not None}
            out: dict[str, list] = {c: got[c] for c in ("raw_id", "file_name", "fmt")}
            for k, f in enumerate(FIELDS):
                if f in counts:
                    known = counts[f].to_pylist()
                    out[f] = [known[loaded[i]] if i in loaded else None for i in range(n)]
                else:
                    col = [fields[i][k] if i in loaded else None for i in range(n)]
                    out[f] = [(v if isinstance(v, str) else json.dumps(v)) if v is not None and not (f == "timeseries_path" and v == "") else None for v in col]
            out["reason"], out["detail"] = reason, detail
            out["payload"] = [p if r or d else None for p, r, d in zip(got["payload"], reason, detail)]
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return raw.select("raw_id", "file_name", "fmt", "payload").mapInArrow(load, LOADED)


def rejects(raw: DataFrame) -> DataFrame:
    return load_records(raw).where(F.col("reason").isNotNull()).select("raw_id", "reason")
