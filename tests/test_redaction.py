"""Redaction: families, numbering, opacity, limits, custom rules."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from runlore.functions import redaction as R
from runlore.operators import redaction as ops
from runlore.plans import more_queries  # noqa: F401  registers its queries
from runlore.plans.queries import QUERIES

PEM = "-----BEGIN {0}PRIVATE KEY-----\nabc\n-----END {0}PRIVATE KEY-----"
MANY = " ".join([
    "Bearer abcdefgh12", "eyJabcdefg.abcdefg.abcdefg", "ghp_" + "a" * 20, "sk-" + "b" * 20, "AIza" + "c" * 35, "AKIA" + "D" * 16, "https://user:pw@host/",
    "a.b@example.org", "+1 (212) 555-0100", "/home/ann/x",
])


def text(value, policy=None):
    return R.Redactor(policy).redact(value)


def test_families():
    out, counts = text(MANY)
    assert counts == {k: 1 for k in ("API_TOKEN", "AUTH", "AWS_ACCESS_KEY", "EMAIL", "GITHUB_TOKEN", "GOOGLE_API_KEY", "JWT", "PHONE", "URI_PASSWORD", "USER_PATH")}
    assert "example.org" not in out and out.endswith("<REDACTED:USER_PATH:1>/x")


@pytest.mark.parametrize("label", ["", "RSA ", "EC ", "DSA ", "OPENSSH ", "ENCRYPTED "])
def test_pem(label):
    assert text(PEM.format(label)) == ("<REDACTED:PRIVATE_KEY:1>", {"PRIVATE_KEY": 1})


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("AWS_SECRET_ACCESS_KEY=abc", "AWS_SECRET_ACCESS_KEY=<REDACTED:AWS_SECRET:1>"), ("  password = 'x y'", "  password = '<REDACTED:CONNECTION_PASSWORD:1>'"),
        ('Server=a;Pwd="q"', 'Server=a;Pwd="<REDACTED:CONNECTION_PASSWORD:1>"'), ("MY_API_KEY_2=z", "MY_API_KEY_2=<REDACTED:ENV_SECRET:1>"),
        ("The password = secret is prose", "The password = secret is prose"), ("C:\\Users\\ann\\repo", "<REDACTED:USER_PATH:1>\\repo"),
    ],
)
def test_lines(line, expected):
    assert text(line)[0] == expected


def test_overlong_value_fails_closed():
    with pytest.raises(R.ScanFailedError):
        text("APP_PASSWORD=" + "x" * 4097)


def test_numbers_and_opacity():
    once, counts = text("a@b.co a@b.co c@d.co <REDACTED:NOPE:4>")
    assert once == "<REDACTED:EMAIL:1> <REDACTED:EMAIL:2> <REDACTED:EMAIL:3> <REDACTED:KEYED:1>" and counts == {"EMAIL": 3, "KEYED": 1}
    assert text(once) == (once, {})


def test_tree():
    out, counts = text({"items": [{"password": {"x": 1}}], "ok": True, "token": "<REDACTED:KEYED:7>", "z": "a@b.co"})
    assert out == {"items": [{"password": "<REDACTED:KEYED:1>"}], "ok": True, "token": "<REDACTED:KEYED:7>", "z": "<REDACTED:EMAIL:1>"} and counts == {"EMAIL": 1, "KEYED": 1}
    with pytest.raises(R.KeyCollisionError):
        text({"<REDACTED:EMAIL:1>": 1, "a@b.co": 2})


def test_limits():
    deep = []
    for _ in range(40):
        deep = [deep]
    for bad in (deep, "x" * 1_000_001, 1 << 2049, [0] * 100_001):
        with pytest.raises(R.LimitError):
            text(bad)
    for bad in (float("nan"), "\ud800", {1: 2}):
        with pytest.raises(R.InputError):
            text(bad)


@pytest.mark.parametrize("bad", ["a+", "a*", "(a)", "a|b", "a?", "a{2,}", "a{0}", r"\b", r"(?=a)", "a{300}", "", "^$", ".", "[]", r"\1"])
def test_custom_grammar_rejects(bad):
    with pytest.raises(R.ConfigError):
        R.Policy(patterns=(("x", bad),))


def test_custom_rules():
    policy = R.Policy(literals=("hunter2",), patterns=(("ticket", r"TCK-\d{6}"),))
    assert text("hunter2 TCK-123456", policy)[0] == "<REDACTED:LITERAL:1> <REDACTED:CUSTOM_TICKET:1>"
    with pytest.raises(R.ConfigError):
        R.Policy(literals=("EMAIL",))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab@.+1 =;'\"<>:_/REDACTEDPWKY\n-", max_size=120))
def test_second_pass_changes_nothing(value):
    try:
        once = text(value)[0]
    except R.ScanFailedError:
        return
    assert text(once) == (once, {})


def test_columns(spark):
    rows = spark.createDataFrame([(1, MANY), (2, None), (3, ""), (4, "x" * 1_000_001)], "id int, redaction string")
    got = {r.id: r.out for r in ops.redact_text(rows, "redaction", into="out").collect()}
    assert got[1].total == 10 and got[2].redacted is None and got[2].error_code is None and got[3].redacted == "" and got[4].error_code == "LIMIT_ERROR"
    totals = ops.redaction_totals(ops.redact_text(rows, "redaction", into="out"), "out")
    assert totals.filter("kind = 'EMAIL'").first().replacements == 1
    bad = spark.createDataFrame([('{"a":1,"a":2}',), ('{"secret":"s"}',)], "j string")
    got = [r.redaction for r in ops.redact_json(bad, "j").collect()]
    assert got[0].error_code == "INPUT_ERROR" and got[1].redacted == '{"secret":"<REDACTED:KEYED:1>"}'
    assert ops.secret_scan(rows.limit(1), "redaction").first().found[0] == "API_TOKEN"


PLANTED = {
    "EMAIL": "a.b@example.org", "PHONE": "+1 (212) 555-0100", "GITHUB_TOKEN": "ghp_" + "a" * 20, "API_TOKEN": "sk-" + "b" * 20, "USER_PATH": "/home/ann/x",
    "AWS_ACCESS_KEY": "AKIA" + "D" * 16, "ENV_SECRET": "MY_API_KEY_2=z", "PRIVATE_KEY": PEM.format("RSA "), "CONNECTION_PASSWORD": "password = q1",
}


def test_totals_of_all_kinds(spark, tmp_path):
    kinds = sorted(PLANTED)
    planted = [[k for j, k in enumerate(kinds) if (i + j) % 3 == 0 for _ in range(1 + (i * j) % 3)] for i in range(20)]
    rows = [(i, "\n".join(["some prose", *[PLANTED[k] for k in said], "more prose"])) for i, said in enumerate(planted)]
    spark.createDataFrame([*rows, (20, None), (21, "")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = {(k, sum(k in said for said in planted), sum(said.count(k) for said in planted)) for k in kinds}
    assert {tuple(r) for r in QUERIES["redaction_totals_all"](spark, str(tmp_path)).collect()} == expected
    assert {r.kind for r in QUERIES["redaction_totals"](spark, str(tmp_path)).collect()} == {"EMAIL", "PHONE"}


def test_totals_count_texts_that_fail_the_scan(spark, tmp_path):
    """A bare value in prose leaves words behind its placeholder, so the scan fails and no text comes out; what was found in it counts."""
    prose = "some words, password=15959ad9338a more words +1 (443) 555-5793 and a.b@example.org at the end"
    rows = spark.createDataFrame([(1, prose), (2, "c@d.co"), (3, "\ufdd0 " + prose)], "doc_id bigint, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.redaction for r in ops.redact_text(rows, "text").collect()}
    for i in (1, 3):  # by expressions and by the engine
        assert (got[i].error_code, got[i].redacted, got[i].passed, got[i].total) == ("SCAN_FAILED", None, False, 3)
        assert got[i].counts == {"CONNECTION_PASSWORD": 1, "EMAIL": 1, "PHONE": 1}
    assert {tuple(r) for r in QUERIES["redaction_totals"](spark, str(tmp_path)).collect()} == {("EMAIL", 3, 3), ("PHONE", 2, 2)}


def test_expressions_do_what_the_engine_does(spark):
    """Texts made of bits that the passes look for, joined at random: reports and scans of both ways are the same."""
    rng = random.Random(3)
    bits = [
        *MANY.split(" ") * 2, PEM.format("RSA "), "-----BEGIN PRIVATE KEY-----", "+12125550100", "a@b.co", "x.y+z@[IPv6:1::2]", "C:\\Users\\ann", "AWS_SECRET_ACCESS_KEY=abc",
        "password = 'x y'", ';Pwd="q;r"', "MY_API_KEY_2=z", "token=", "secret = <REDACTED:EMAIL:3>", "<REDACTED:NOPE:4>", "<REDACTED:PHONE:12>", "<REDACTED:EMAIL:0>", "basic dXNlcjpwdw==",
        "\n", "\r\n", " ", " ", ";", ",", "'", '"', "=", "é", "²", "\x1c", "\u2028", "\u0301", "/", ".", "-", "_", ":", "word", "\t", "\x01", "\\", "$1", "ba\u017fic abcdefgh12",
    ]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(4000)]
    texts += ["", "APP_PASSWORD=" + "x" * 4096, "APP_PASSWORD=" + "x" * 4097, "\ufdd0 a@b.co", "\ufdef", "x" * 1_000_001, "\x01" * 999_999, "a@b.co " * 50_000, "/home/" + "y" * 900_000]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, t string").repartition(8)
    got = {r.id: r for r in ops.secret_scan(ops.redact_text(rows, "t", into="o"), "t").collect()}
    redactor, failed = R.Redactor(), 0
    for i, x in enumerate(texts):
        o = got[i].o
        assert got[i].found == sorted(redactor.scan(x)), x[:200]
        try:
            out, report = redactor.report(x)
        except R.RedactionError as e:
            failed += 1
            assert (o.error_code, o.redacted, o.passed) == (e.code, None, False), x[:200]
            continue
        assert (o.redacted, o.counts, o.total, o.error_code) == (out, report["counts"], report["total"], None), x[:200]
        assert (o.input_hash, o.output_hash, o.config_hash) == (report["input_hash"], report["output_hash"], report["config_hash"]), x[:200]
    assert 3 < failed < len(texts) / 2
