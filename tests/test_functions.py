"""Timestamps, tokens, the codec, types, labels, keywords."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patternloom.functions import clp, labels, severity, variables
from patternloom.functions.timestamps import extract_timestamp, strip_timestamp


def column(spark, values, expr, name="v"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [r.out for r in rows.select("i", expr(F.col(name)).alias("out")).orderBy("i").collect()]


TIMES = [
    ("2024-01-15T14:22:01.123Z INFO request completed", "2024-01-15 14:22:01", "<TS> INFO request completed"),
    ("2024-01-15T14:22:01+05:30 INFO x", "2024-01-15 08:52:01", "<TS> INFO x"),
    ("2024-01-15T14:22:01+0530 INFO x", "2024-01-15 08:52:01", "<TS> INFO x"),
    ("2024-01-15 14:22:01.456 INFO x", "2024-01-15 14:22:01", "<TS> INFO x"),
    ('127.0.0.1 - - [15/Jan/2024:14:22:01 +0000] "GET / HTTP/1.1" 200', "2024-01-15 14:22:01", '127.0.0.1 - - [<TS>] "GET / HTTP/1.1" 200'),
    ("Jan 15 14:22:01 myhost sshd[1234]: Accepted publickey", "2021-01-15 14:22:01", "<TS> myhost sshd[1234]: Accepted publickey"),
    ("Jan  5 14:22:01 myhost x", "2021-01-05 14:22:01", "<TS> myhost x"),
    ("timestamp=1705328521 level=info msg=hello", "2024-01-15 14:22:01", "timestamp=<TS> level=info msg=hello"),
    ("ts=1705328521123 level=info", "2024-01-15 14:22:01", "ts=<TS> level=info"),
    ("just a plain log line with no timestamp", None, "just a plain log line with no timestamp"),
    ("2024-01-15T14:22:01Z a 2025-01-15T14:22:01Z", "2024-01-15 14:22:01", "<TS> a 2025-01-15T14:22:01Z"),
    ("[Thu Jun 09 06:07:04 2005] [notice] LDAP: x", "2005-06-09 06:07:04", "<TS> [notice] LDAP: x"),
    ("[Fri Jun 09 06:07:04 2005] [notice] LDAP: x", "2021-06-09 06:07:04", "[Fri <TS> 2005] [notice] LDAP: x"),
    ("2024-13-45T14:22:01Z but 1705328521", "2024-01-15 14:22:01", "2024-13-45T14:22:01Z but <TS>"),
    ("a12345678901 is no epoch", None, "a12345678901 is no epoch"),
    (None, None, None),
]


def test_timestamps(spark):
    lines = [t[0] for t in TIMES]
    got = column(spark, lines, lambda c: F.date_format(extract_timestamp(c, 2021)["ts"], "yyyy-MM-dd HH:mm:ss"))
    assert got == [t[1] for t in TIMES]
    assert column(spark, lines, lambda c: strip_timestamp(c, extract_timestamp(c, 2021))) == [t[2] for t in TIMES]


def test_timestamps_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = column(spark, [t[0] for t in TIMES[:12]], lambda c: F.unix_seconds(extract_timestamp(c, 2021)["ts"]))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got[0] == got[3] == got[4] == 1705328521 and got[11] == 1118297224


KINDS = {"abc123def": "D", "10.0.1.15": "D", "45ms": "D", "007": "D", "+5": "D", "be": "D", "face": "D", "-5": "I", "0": "I", "-0": "D", "1.50": "F", "-0.25": "F", "9223372036854775807": "I", "9223372036854775808": "D", "1.": "D"}


def test_kinds(spark):
    assert column(spark, list(KINDS), clp.kind) == list(KINDS.values())
    assert column(spark, list(KINDS), lambda c: F.to_json(clp.variables(c))) == [f'["{k}"]' for k in KINDS]
    assert column(spark, ["status=OK dir Hello World", "a=b"], lambda c: F.to_json(clp.variables(c))) == ['["OK"]', '["b"]']


MESSAGES = [
    "", "Hello World", "123", "User john.doe processed payment $123.45 at timestamp 1640995200 with session abc123",
    'x ± 5 \U0001f600 {"k": 1.5, "path": "C:\\\\tmp"}', "tab\tand \\ and \x11 \x12 \x13 end", "-5 -0.25 1e5 0x1f 007 .5 5. 17.123456789012345",
]


def test_codec_round_trip(spark):
    def both(width):
        def run(c):
            rows = clp.encode_message(c, width)
            return clp.decode_message(rows["logtype"], rows["encoded_vars"], rows["dictionary_vars"], width)

        return run

    assert column(spark, MESSAGES, both(8)) == MESSAGES
    assert column(spark, MESSAGES, both(4)) == MESSAGES
    assert column(spark, [MESSAGES[3]], lambda c: F.to_json(clp.encode_message(c)["dictionary_vars"])) == ['["abc123"]']
    assert column(spark, ["hello\x11world\x12foo\x13", "\\\x11a"], lambda c: F.to_json(clp.placeholder_counts(c))) == ['{"encoded":2,"dictionary":1}', '{"encoded":0,"dictionary":0}']


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abf019.-+= \t\\\x11\x12\x13:"), st.characters(codec="utf-8", exclude_characters="\x00")), max_size=40), min_size=1, max_size=20))
def test_codec_round_trip_of_any_text(spark, texts):
    def run(c):
        m = clp.encode_message(c)
        return clp.decode_message(m["logtype"], m["encoded_vars"], m["dictionary_vars"])

    assert column(spark, texts, run) == texts


TYPES = {
    "Integer": ("42", "-100", "0", "1234"), "Float": ("3.14", "-0.5", "100.0", "1."), "Duration": ("45ms", "1.2s", "500us", "100ns", "2h", "5µs"),
    "IPv4": ("10.0.1.15", "192.168.1.1:8080", "255.255.255.255"), "IPv6": ("::1", "fe80::1", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "14:22:01"),
    "UUID": ("550e8400-e29b-41d4-a716-446655440000", "550E8400-E29B-41D4-A716-446655440000"), "HexID": ("0x1a2b3c", "deadbeef", "abc123def456", "1e55"),
    "Timestamp": ("2024-01-15T14:22:01.123Z", "2024-01-15 14:22:01"), "String": ("GET", "/api/users", "some-random-text", "999.999.999.999", "1.5d", "9223372036854775808", "", "a\n"),
}


def test_types(spark):
    pairs = [(v, t) for t, vs in TYPES.items() for v in vs]
    assert column(spark, [v for v, _ in pairs], variables.classify) == [t for _, t in pairs]


def test_numbers(spark):
    got = column(spark, ["45ms", "1.5s", "2h", "7", "-0.5", "x"], lambda c: variables.numeric_value(c, variables.classify(c)))
    assert got == [45.0, 1500.0, 7.2e6, 7.0, -0.5, None]


@pytest.mark.parametrize(
    "template,slot,kind,label",
    [
        ("INFO request status= <*>", 0, "Integer", "status"), ("completed in <*>", 0, "Duration", "duration"), ("completed in <*>", 0, "Integer", "duration_ms"),
        ("connecting to <*>", 0, "IPv4", "ip"), ("something <*> happened", 0, "Integer", "n1"), ("trace <*> started", 0, "UUID", "uuid"),
        ("user <*> port <*>", 1, "Integer", "port"), ("<*> ms", 0, "Float", "duration"), ("no wildcard", 2, "String", "var3"),
    ],
)
def test_labels(spark, template, slot, kind, label):
    assert column(spark, [template], lambda c: labels.infer_label(c, F.lit(slot), F.lit(kind))) == [label]


def test_keywords(spark):
    cases = {"[ERROR] foo bar": 10.0, "level=WARN something": 5.0, "DEBUG: checking value": 0.1, "INFO normal log message": 1.0, "warning_count is 5": 1.0, "x" * 101 + " ERROR": 1.0, "é" * 49 + " ERROR": 1.0, "é" * 40 + " ERROR": 10.0}
    assert column(spark, list(cases), severity.keyword_weight) == list(cases.values())
    assert column(spark, ["x"], lambda c: F.to_json(F.array(*[severity.severity(F.lit(w)) for w in (10.0, 5.0, 0.1, 1.0)]))) == ['["error","warn","debug","info"]']


def test_long_tokens(spark):
    long = "a" * 20 + "b" * 40 + "c" * 10
    wide = "é" * 30
    got = column(spark, [f"x  {long}\ty", wide], labels.truncate_long_tokens)
    assert got == ["x " + "a" * 20 + "..." + "c" * 10 + " y", "é" * 10 + "..." + "é" * 5]
    named = column(spark, ["a <*> b=<*> <*>"], lambda c: labels.labelled_template(c, F.array(F.lit("x"))))
    assert named == ["a {x} b=<*> <*>"]
