import csv
import io
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brookmill.sources.rejects import FIELDS, bad_prompt, load_records, parse_json, read_delimited

GOOD = ["a_1_2", "classification", "d/x.csv", 'say "go"\n<timeseries>\n1.0: v=2.5, w=null, x=\n</timeseries>', "A", "10", "2"]


def line(fields, d=","):
    out = io.StringIO()
    csv.writer(out, delimiter=d, lineterminator="").writerow(fields)
    return out.getvalue()


def with_(k, v):
    f = list(GOOD)
    f[k] = v
    return f


def as_json(**changes):
    d = dict(zip(FIELDS, GOOD)) | {"n_steps": 10, "n_channels": 2} | changes
    return json.dumps({k: v for k, v in d.items() if v != "DROP"})


CASES = [
    ("csv", line(GOOD), None), ("tsv", line(GOOD, "\t"), None), ("jsonl", as_json(), None), ("csv", line(with_(2, "")), None), ("jsonl", as_json(timeseries_path=None), None),
    ("csv", 'a,b "c" d', "quoting"), ("csv", '"open,classification', "quoting"), ("csv", 'a,"b"c,d', "quoting"), ("csv", "a\nb,c", "quoting"), ("tsv", 'a\t"x\\"y"', "quoting"),
    ("csv", line(GOOD[:6]), "columns"), ("csv", line(GOOD + ["x"]), "columns"), ("csv", "", "columns"), ("csv", None, "columns"), ("xml", "<a/>", "columns"), (None, "x", "columns"),
    ("jsonl", None, "quoting"), ("jsonl", "", "quoting"), ("jsonl", "[1]", "quoting"), ("jsonl", as_json() + as_json(), "quoting"), ("jsonl", '{"id": NaN}', "quoting"), ("jsonl", as_json()[:-1], "quoting"),
    ("jsonl", as_json(answer="DROP"), "columns"), ("jsonl", as_json(more=1), "columns"), ("jsonl", as_json()[:-1] + ', "id": "b"}', "columns"),
    ("csv", line(with_(0, "  ")), "value"), ("csv", line(with_(1, "other")), "value"), ("csv", line(with_(2, "x.mp4")), "value"), ("csv", line(with_(2, "x\x1b.csv")), "value"),
    ("csv", line(with_(3, " \n")), "value"), ("csv", line(with_(3, "<timeseries>\n1: a=1")), "value"), ("csv", line(with_(3, "<timeseries>\n1.5: a=1..2\n</timeseries>")), "value"),
    ("csv", line(with_(5, "1.0")), "value"), ("csv", line(with_(5, "0")), "value"), ("csv", line(with_(6, "-3")), "value"), ("csv", line(with_(6, " 3")), "value"), ("csv", line(with_(5, "٣")), "value"),
    ("jsonl", as_json(n_steps=1.0), "value"), ("jsonl", as_json(n_steps=True), "value"), ("jsonl", as_json(n_steps="3"), "value"), ("jsonl", as_json(id=None), "value"), ("jsonl", as_json(timeseries_path=""), "value"),
    ("csv", line(with_(3, "x" * 300000)), None), ("csv", line(with_(4, "")), None),
]


def test_reasons_and_rows(spark):
    rows = [(k, "f", f, p, "extra") for k, (f, p, _) in enumerate(CASES)]
    got = {r["raw_id"]: r for r in load_records(spark.createDataFrame(rows, "raw_id bigint, file_name string, fmt string, payload string, reason string")).collect()}
    assert len(got) == len(CASES)
    for k, (f, p, want) in enumerate(CASES):
        assert got[k]["reason"] == want, (f, (p or "")[:80], got[k]["reason"], got[k]["detail"])
        assert (got[k]["id"] is None) == (want is not None)
        assert (got[k]["payload"] is None) == (want is None) or p is None
    assert got[0]["prompt"] == GOOD[3] and got[0]["n_steps"] == 10 and got[3]["timeseries_path"] is None


def test_empty_table(spark):
    assert load_records(spark.createDataFrame([], "raw_id bigint, file_name string, fmt string, payload string")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab",\n\r\t \'é', max_size=6), min_size=1, max_size=9), min_size=1, max_size=6), st.sampled_from([",", "\t"]))
def test_round_trip_of_well_formed_rows(rows, d):
    quote = lambda f: '"' + f.replace('"', '""') + '"' if any(c in f for c in d + '"\r\n') else f
    good, bad = read_delimited([d.join(map(quote, r)) for r in rows], d)
    for k, r in enumerate(rows):
        if len(r) == 7:
            assert good[k] == r
        else:
            assert bad[k] == "columns"


@pytest.mark.parametrize("text", ["x </timeseries>", "<timeseries> <timeseries> </timeseries> </timeseries>", None, 3])
def test_bad_prompts(text):
    assert bad_prompt(text)


def test_two_good_blocks_and_text_outside():
    assert not bad_prompt("<timeseries>\n1.0:\nunit=km\n</timeseries>")
    assert not bad_prompt("1: a=zz\n<timeseries>\n1: a=1e-3\n</timeseries> and <timeseries>\nt: a=\n2: b=-.5\n</timeseries>")


def test_json_parts():
    assert parse_json("{}") == (None, "columns") and parse_json("7") == (None, "quoting")


def test_counts_up_to_a_bigint_are_kept(spark):
    top = 2**63 - 1
    counts = [("csv", "0" * 17 + "12", 12), ("tsv", "0" * 5000 + "7", 7), ("csv", str(10**18), 10**18), ("csv", str(top), top), ("csv", str(top + 1), None), ("csv", "1" * 5000, None), ("jsonl", top, top), ("jsonl", top + 1, None)]
    rows = [(k, "f", f, as_json(n_steps=v) if f == "jsonl" else line(with_(5, v), "," if f == "csv" else "\t")) for k, (f, v, _) in enumerate(counts)]
    got = {r["raw_id"]: r for r in load_records(spark.createDataFrame(rows, "raw_id bigint, file_name string, fmt string, payload string")).collect()}
    assert [(got[k]["reason"], got[k]["n_steps"], got[k]["n_channels"]) for k in range(len(counts))] == [(None, want, 2) for *_, want in counts]


def test_a_count_beyond_a_bigint_is_told(spark):
    rows = [(0, "f", "csv", line(with_(6, str(2**63)))), (1, "f", "jsonl", as_json(n_steps=10**80)), (2, "f", "jsonl", as_json(n_steps=-(10**80))), (3, "f", "jsonl", as_json(prompt="\ud83d x", id="a\udc00"))]
    got = [tuple(r) for r in load_records(spark.createDataFrame(rows, "raw_id bigint, file_name string, fmt string, payload string")).select("reason", "detail", "n_steps", "n_channels", "payload", "prompt", "id").orderBy("raw_id").collect()]
    assert got[0][:4] == (None, "n_channels", 10, None) and got[0][4] == rows[0][3] and got[1][:4] == (None, "n_steps", None, 2) and got[1][4] == rows[1][3]
    assert got[2][:2] == ("value", "n_steps") and got[3][0] is None and got[3][5:] == ("\ufffd x", "a\ufffd") and got[3][4] is None
