"""Places, keys, maps, budgets and loggers: nothing sensitive gets around them."""

from __future__ import annotations

import io
import json
import logging
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sablecloth.errors import LimitError, PolicyError
from sablecloth.functions import rules as r, texts as t
from sablecloth.operators.documents import MAX_STEP, audit_json, audit_value, to_safe_data
from sablecloth.plans.compiler import clean_frame
from sablecloth.plans.policy import FieldRule, PathRule, Policy, canonical_field
from sablecloth.streaming.logs import SafeFilter, safe_logger


@pytest.mark.parametrize(
    ("name", "want"),
    [("cardType", "card_type"), ("HTTPServer", "http_server"), ("user-ID", "user_id"), ("  a  b ", "a_b"), ("__x__", "x"), ("v2Name", "v2_name"), ("ÄrgerName", "ärger_name"), ("ABC", "abc"), ("", "")],
)
def test_field_names(name, want):
    assert canonical_field(name) == want


@pytest.mark.parametrize("key", ["a@b.co", "line\nbreak", "‮", "x" * 400, "password=abc123456"])
def test_places_show_no_values(key):
    found, _ = audit_value({key: {"token": "x"}}, Policy())
    place = found[-1].location
    assert "a@b.co" not in place and "abc123456" not in place and "\n" not in place and "‮" not in place
    assert len(place) <= MAX_STEP + 40


def test_audit_of_json_columns(spark):
    rows = spark.createDataFrame([('{"a@b.co": ["x", "y@z.org"]}',), ("no json",), (None,)], "v string")
    got = [x[0] for x in rows.select(audit_json(F.col("v"), Policy(rules=(r.email,)))).collect()]
    assert [f.location for f in got[0].findings] == ['$["[EMAIL]"]', '$["[EMAIL]"][1]'] and got[0].complete
    assert got[1].limitations == ["invalid_json"] and not got[1].complete and got[2].findings == []


@pytest.mark.parametrize(
    "policy",
    [
        Policy(),
        Policy().add_path_rules(PathRule("m.status", "remove"), PathRule("m.*.deep", "mask", "glob")),
        Policy().add_field_rules(FieldRule("status", "truncate", max_chars=2), FieldRule("^x", "remove", "regex")),
        Policy().allow_paths("id", "m.status", "m.password"),
        Policy().allow_paths("id"),
    ],
)
def test_map_columns_equal_the_walk(spark, policy):
    rand = random.Random(5)
    keys, values = ["status", "password", "a@b.co", "xAbc", "other", "card-type"], ["ok", "me@mail.org", "token=abcdefgh1", "", None, "12"]
    rows = [(i, {k: rand.choice(values) for k in rand.sample(keys, rand.randint(0, 5))}) for i in range(60)] + [(60, None)]
    out = clean_frame(spark.createDataFrame(rows, "id long, m map<string,string>"), policy)
    assert policy.allowlist is None or ("m" in out.columns) == (len(policy.allowlist) > 1)
    for row, (i, m) in zip(out.collect(), rows, strict=True):
        want = to_safe_data({"id": i, "m": m}, policy).cleaned.get("m")
        assert "m" not in out.columns or row.m == want, (m, row.m, want)


def test_arrays_are_cut_at_the_budget(spark):
    rows = spark.createDataFrame([(["a", "b", "c"], [1, 2, 3]), (["a"], [1]), (None, None)], "s array<string>, n array<int>")
    got = clean_frame(rows, replace(Policy(), max_items=2)).collect()
    assert [tuple(x) for x in got] == [(["a", "b", "[TRUNCATED]"], [1, 2]), (["a"], [1]), (None, None)]


def test_records_of_children_are_cleaned():
    shown = io.StringIO()
    parent, child = logging.getLogger("shop9"), logging.getLogger("shop9.till")
    handler, own = logging.StreamHandler(shown), logging.StreamHandler(shown)
    parent.addHandler(handler)
    child.addHandler(own)
    parent.propagate = False
    safe_logger("shop9", Policy(rules=(r.email,)))
    safe_logger("shop9", Policy(rules=(r.email,)))
    child.warning("mail %s", "a@b.co")
    parent.warning("mail a@b.co")
    assert "a@b.co" not in shown.getvalue() and shown.getvalue().count("[EMAIL]") == 3
    assert sum(isinstance(f, SafeFilter) for f in handler.filters) == 1


def test_policies_as_json():
    policy = Policy.web().with_masking("partial").add_field_rules(FieldRule("card", "truncate", "contains", 4)).add_path_rules(PathRule("a.*", "remove", "glob")).allow_paths("a.b")
    again = Policy.from_json(policy.to_json())
    assert again == policy and again.to_json() == policy.to_json()
    assert not Policy.from_dict({"schema_version": 1}).clean_mapping_keys
    for bad in ({}, {"schema_version": True}, {"schema_version": 2}, {"max_items": 0}, {"base": "x"}, {"masking": 1}, {"field_rules": [{"match": "a", "action": "x"}]}, {"path_rules": {}}, {"allowlist": {"paths": ["a..b"]}}, {"clean_mapping_keys": 1}, {"sensitive_keys": [""]}, {"more": 1}):
        with pytest.raises(PolicyError):
            Policy.from_dict({"schema_version": 1, **bad} if "schema_version" not in bad and bad else bad)
    for bad in ({"max_depth": -1}, {"max_items": 0}, {"masking": object()}):
        with pytest.raises(PolicyError):
            Policy(**bad)


def test_unknown_objects_by_policy():
    class Thing:
        def __str__(self) -> str:
            return "thing of a@b.co"

    assert to_safe_data(Thing()).cleaned == "[UNSUPPORTED:Thing]"
    assert to_safe_data(Thing(), Policy(clean_unknown_objects=True)).cleaned == "thing of [EMAIL]"


def test_rules_stop_early_and_spans_are_checked(spark):
    class Limited:
        name, category = "own", "own"
        asked: list[int] = []

        def find(self, text):
            raise AssertionError

        def find_limited(self, text, most):
            self.asked.append(most)
            yield 0, 1, "", text[:1], "first character"

    rule = Limited()
    assert t.redact("abc", Policy(rules=(rule,)))[0] == "[REDACTED]bc" and rule.asked == [t.MAX_MATCHES + 1]
    with pytest.raises(LimitError):
        t.find_all("x" * (t.MAX_MATCHES + 5), (r.CustomRule("x", "x", "x"),))

    class Wrong:
        name, category = "wrong", "wrong"

        def find(self, text):
            yield 2, 90, "", "x", "outside"

    from sablecloth.operators import clean

    got = spark.createDataFrame([("abc",)], "v string").select(clean.clean_text(F.col("v"), Policy(rules=(Wrong(),))).alias("c")).first()
    assert got.c is None


def test_keys_of_structs_are_scanned(spark):
    rows = spark.createDataFrame([(1,)], "id int").select(F.struct(F.lit("v").alias("a@b.co")).alias("s"))
    assert clean_frame(rows).schema["s"].dataType.names == ["[EMAIL]"]
    assert json.loads(clean_frame(rows).toJSON().first()) == {"s": {"[EMAIL]": "v"}}
