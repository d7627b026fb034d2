"""Functions for spark.sql, under a session's policy."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import SparkSession, functions as F

from ..errors import BlockedError, LimitError
from ..functions import texts as t
from ..operators.documents import safe_json
from ..operators.urls import clean_url
from ..plans.policy import HIGH_RISK, Policy

POLICY_KEY = "sablecloth.policy"


def session_policy(spark: SparkSession) -> Policy:
    text = spark.conf.get(POLICY_KEY, None)
    return Policy.from_json(text) if text else Policy()


def register(spark: SparkSession, policy: Policy | None = None) -> None:
    """clean_text, sensitive_categories, risk_level, clean_url and clean_json_text in SQL.

    clean_url gives null where a limit or a block forbids a result; clean_json_text gives
    {"_error": "invalid_json"} for what isn't JSON."""
    policy = policy or session_policy(spark)

    @F.pandas_udf("string")
    def clean_text(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else t.redact(v, policy)[0] for v in values], dtype=object)

    @F.pandas_udf("array<string>")
    def categories(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else list(dict.fromkeys(f.category for f in t.inspect(v, policy))) for v in values])

    @F.pandas_udf("string")
    def risk(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            found = t.inspect(v, policy) if v is not None else []
            out.append("high" if any(f.category in HIGH_RISK for f in found) else "none" if not found else "medium" if len(found) >= 3 else "low")
        return pd.Series(out)

    @F.pandas_udf("string")
    def url(values: pd.Series) -> pd.Series:
        def one(v: str | None) -> str | None:
            try:
                return None if v is None else clean_url(v, policy)
            except (BlockedError, LimitError):
                return None

        return pd.Series([one(v) for v in values], dtype=object)

    @F.pandas_udf("string")
    def json_text(values: pd.Series) -> pd.Series:
        def one(v: str | None) -> str | None:
            try:
                return None if v is None else safe_json(json.loads(v), policy)
            except json.JSONDecodeError:
                return json.dumps({"_error": "invalid_json"})

        return pd.Series([one(v) for v in values], dtype=object)

    spark.udf.register("clean_url", url)
    spark.udf.register("clean_json_text", json_text)
    spark.udf.register("clean_text", clean_text)
    spark.udf.register("sensitive_categories", categories)
    spark.udf.register("risk_level", risk)


__all__ = ["register", "session_policy"]
