from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sablecloth.errors import BlockedError, LimitError, NotCleanError, RuleError
from sablecloth.functions import masking as m, rules as r, texts as t
from sablecloth.operators import clean as c
from sablecloth.plans.policy import Policy

CLEANED = [
    ("email=john@example.com password=123", "email=[EMAIL] password=[SECRET]"),
    ("token=abc123456789", "token=[SECRET]"),
    ("GET https://example.com/users?email=john@example.com", "GET [URL]"),
    ("Bearer abcdefgh12345678", "Bearer [TOKEN]"),
    ("card=4111 1111 1111 1111", "card=[CREDIT_CARD]"),
    ("card=4111 1111 1111 1112", "card=4111 1111 1111 1112"),
    ("<ghp_" + "A" * 20 + ">", "<[SECRET]>"),
    ("/tmp/password=secret123", "/tmp/password=[SECRET]"),
    ("password=secret\rnext", "password=[SECRET]\rnext"),
    ("Authorization: Bearer abcdefgh12345678", "Authorization: Bearer [TOKEN]"),
    ("password=[SECRET]", "password=[SECRET]"),
    ("nothing here", "nothing here"),
    ("", ""),
]


def test_cleaned_texts_in_python_and_in_spark(spark):
    policy = Policy.default()
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CLEANED)], "i int, t string")
    got = {x.i: x.c for x in rows.select("i", c.clean_text(F.col("t"), policy).alias("c")).collect()}
    for i, (text, want) in enumerate(CLEANED):
        assert t.redact(text, policy)[0] == want
        assert got[i] == want
        assert t.redact(want, policy)[0] == want


def test_random_texts_agree(spark):
    """The columns and the Python form find the same spans in odd mixtures."""
    rand = random.Random(5)
    bits = ["a@b.co", "@", ".", " ", "4111111111111111", "10.0.0.1", "555-123-4567", "é𝄞", "token=", "secret", "=", ":", "https://x.y/z", "eyJ" + "a" * 9, "." + "b" * 9, "Bearer ", "\n", "٣٤", "'", "sk_live_abcdefgh1234", "password: "]
    texts = ["".join(rand.choice(bits) for _ in range(rand.randint(0, 14))) for _ in range(300)]
    policy = Policy.strict()
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x.i: x.r for x in rows.select("i", c.result(F.col("t"), policy).alias("r")).collect()}
    for i, text in enumerate(texts):
        cleaned, found = t.redact(text, policy)
        assert got[i].cleaned == cleaned, text
        assert [(x.start, x.end, x.rule_name) for x in got[i].findings] == [(f.start, f.end, f.rule_name) for f in found]


@pytest.mark.parametrize(
    ("spans", "kept"),
    [
        ([(0, 20), (5, 30)], [(0, 20)]),
        ([(0, 5), (0, 10)], [(0, 10)]),
        ([(0, 5), (5, 10)], [(0, 5), (5, 10)]),
        ([(0, 5), (3, 8), (6, 12)], [(0, 5), (6, 12)]),
    ],
)
def test_resolution(spans, kept):
    got = t.resolve([(a, a - b, 0, None, "", "", "") for a, b in spans])
    assert [(g[0], g[0] - g[1]) for g in got] == kept


def test_null_and_long_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, "a" * 1_000_001)], "i int, t string").select("i", c.result(F.col("t"), Policy.default(), audit=True).alias("r"))
    got = {x.i: x.r for x in rows.collect()}
    assert got[1].cleaned is None and got[1].findings == []
    assert got[2].limitations == ["max_text_chars"] and got[2].cleaned is None
    with pytest.raises(LimitError):
        t.redact("a" * 1_000_001, Policy.default())


def test_masks(spark):
    assert m.Partial().mask("john@example.com", "email") == "j***@example.com"
    assert m.Partial().mask("abcdefghijkl", "token") == "abcd****ijkl"
    assert m.Partial().mask("abcdefgh", "token") == "********"
    assert m.Partial().mask("abcdef", "phone") == "ab**ef"
    assert m.Hashed(salt="s").mask("x", "email") != m.Hashed().mask("x", "email")
    keyed = m.Hashed(key="k" * 16)
    values = spark.createDataFrame([("x",), ("é𝄞",), ("",)], "v string")
    for strategy in (m.Partial(), m.Hashed(), m.Hashed(salt="s", length=20), keyed, m.Pseudonyms(b"k" * 16)):
        got = [x.c for x in values.select(strategy.column(F.col("v"), F.lit("email")).alias("c")).collect()]
        assert got == [strategy.mask(v, "email") for v in ("x", "é𝄞", "")]
    for bad in ({"length": 8}, {"key": "short"}, {"key": "k" * 16, "salt": "s"}):
        with pytest.raises(ValueError):
            m.Hashed(**bad)


def test_keys_never_show(spark):
    key = b"canary-key-0123456789"
    policy = Policy.default().with_masking(m.Hashed(key=key))
    frame = spark.createDataFrame([("a@b.co",)], "t string").select(c.clean_text(F.col("t"), policy).alias("c"))
    plan = frame._jdf.queryExecution().toString()
    assert "canary" not in plan and "canary" not in repr(policy) and "canary" not in repr(m.Pseudonyms(key))
    assert frame.first().c.startswith("[EMAIL:")


def test_blocking_modes(spark):
    policy = Policy.production()
    rows = spark.createDataFrame([("password=abc",), ("fine",)], "t string")
    assert [x.c for x in rows.select(c.clean_text(F.col("t"), policy, "marker").alias("c")).collect()] == ["[BLOCKED categories=credential]", "fine"]
    assert [x.t for x in c.clean(rows, ["t"], policy, "drop").collect()] == ["fine"]
    with pytest.raises(Exception, match="credential"):
        c.clean(rows, ["t"], policy, "raise").collect()
    with pytest.raises(BlockedError):
        t.redact("password=abc", policy)


def test_custom_rules_and_deadline(spark):
    ssn = r.CustomRule("ssn", "ssn", r"\d{3}-\d{2}-\d{4}")
    rows = spark.createDataFrame([("SSN: 123-45-6789",)], "t string")
    for rule in (ssn, r.CustomRule("ssn", "ssn", r"\d{3}-\d{2}-\d{4}", trusted=True)):
        assert rows.select(c.clean_text(F.col("t"), Policy(rules=(rule,))).alias("c")).first().c == "SSN: [REDACTED]"
    slow = r.CustomRule("slow", "x", r"(a+)+$", timeout=0.1)
    with pytest.raises(LimitError, match="regex_execution_ms"):
        list(slow.find("a" * 40 + "!"))
    for bad in ({"name": " ", "category": "x", "pattern": "a"}, {"name": "x", "category": "x", "pattern": "("}):
        with pytest.raises(RuleError):
            r.CustomRule(**bad)
    with pytest.raises(RuleError):
        r.checked((ssn, ssn))


def test_reports(spark):
    rows = spark.createDataFrame([(1, "a@b.co 10.0.0.1", "x@y.zz"), (2, "none", None)], "i int, a string, b string")
    got = {x.i: x for x in c.reports(rows, ["a", "b"], ["i"], Policy.strict()).collect()}
    assert got[1].locations == ["$.a", "$.b"] and got[1].risk_level == "medium" and got[1].finding_count == 3
    assert got[2].safe and got[2].risk_level == "none"
    assert c.findings_table(rows, ["a", "b"], ["i"], Policy.strict()).count() == 3
    with pytest.raises(NotCleanError, match="risk"):
        c.assert_clean(rows, ["a"], Policy.strict())
    c.assert_clean(rows.filter("i = 2"), ["a", "b"], Policy.strict())


def test_bytes_keep_what_is_not_text(spark):
    rows = spark.createDataFrame([(bytearray(b"\xff a@b.co \xfe"),)], "b binary")
    assert bytes(rows.select(c.clean_bytes(F.col("b"), Policy.default()).alias("c")).first().c) == b"\xff [EMAIL] \xfe"


class Shouting:
    """A rule of a user: find() and names, nothing else."""

    name = category = "shout"

    def find(self, text):
        for i, word in enumerate(text.split(" ")):
            if word.isupper():
                at = len(" ".join(text.split(" ")[:i])) + (i > 0)
                yield at, at + len(word), "", word, "a loud word"


class Lowered:
    """A mask of a user."""

    def mask(self, value, category):
        return value.lower()

    def label(self, category):
        return "[x]"


def test_rules_and_masks_of_users(spark):
    policy = Policy(rules=(Shouting(),), masking=Lowered())
    rows = spark.createDataFrame([("be QUIET now",), (None,)], "t string")
    assert t.redact("be QUIET now", policy)[0] == "be quiet now"
    assert [x.c for x in rows.select(c.clean_text(F.col("t"), policy).alias("c")).collect()] == ["be quiet now", None]


def test_too_many_matches_are_a_limit(spark):
    rows = spark.createDataFrame([("a@b.co " * 10_001,), ("a@b.co " * 10_000,), ("a@b.co",)], "t string")
    policy = Policy(rules=(r.email,), max_findings=10_000)
    got = rows.select(c.result(F.col("t"), policy).alias("r")).select("r.limitations", F.size("r.findings").alias("n")).collect()
    assert [(x.limitations, x.n) for x in got] == [(["max_matches"], 0), ([], 10_000), ([], 1)]


def test_rules_of_users_beside_native_ones(spark):
    policy = Policy(rules=(r.email, Shouting()))
    text = "be QUIET a@b.co"
    rows = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    assert [x.c for x in rows.select(c.clean_text(F.col("t"), policy).alias("c")).collect()] == [t.redact(text, policy)[0], "", None]
