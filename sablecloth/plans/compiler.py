"""Structured columns: a policy compiled against a schema into a projection.

Names are in the schema, so field, path and allowlist decisions are made once, on
the driver, and the plan holds only what is left: pruned structs, masks, and text
rules at the leaves.  Pruned fields aren't read from Parquet at all.  Array
elements are addressed by their source index, and an array longer than max_items is
cut there, with a mark if its elements are texts.  Map keys are data, so columns with
maps go through the JSON walk.  A masked number becomes a string, so its column does for all rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..errors import BlockedError, PseudonymError
from ..functions.masking import keyed
from ..functions.texts import redact
from ..operators.clean import clean_text
from ..operators.documents import MAX_DEPTH, NON_FINITE, REMOVED, TRUNCATED, clean_json
from .policy import Policy, canonical_path

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.NullType)


@dataclass
class Compiled:
    """A projection and what the driver knows of it."""

    columns: list[Column]
    counts: dict[str, int] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)


class Compiler:
    def __init__(self, policy: Policy, adapters: dict[str, Callable[[Column], Column]] | None = None):
        """adapters: converters by column type (simpleString) or dotted name, applied before anything else."""
        self.policy, self.adapters = policy, adapters or {}
        self.counts = dict.fromkeys(("field_rule_matches", "path_rule_matches", "not_allowed", "masked", "removed", "truncated", "pseudonymized"), 0)
        self.dropped: list[str] = []
        #: Lambdas around the current place, and whether Python is needed inside of one.
        self.inside, self.python_inside = 0, False

    def needs_python(self, native: bool) -> bool:
        """Python functions can't stand in lambdas: such columns go through the JSON walk."""
        if self.inside and not native:
            self.python_inside = True
            return True
        return False

    def count(self, name: str) -> None:
        self.counts[name] += 1

    def text(self, c: Column) -> Column:
        if self.needs_python(getattr(self.policy.masking, "native", False) and all(getattr(r, "native", False) for r in self.policy.rules)):
            return F.lit("")
        return clean_text(c, self.policy, "null")

    def as_text(self, c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.BinaryType):
            return F.decode(c, "UTF-8")
        if isinstance(kind, T.BooleanType):
            return F.when(c, "True").when(~c, "False")
        return c.cast("string")

    def mask(self, c: Column, kind: T.DataType) -> Column:
        """A mask of category credential; nothing to hash or to show gives the label."""
        self.count("masked")
        if "credential" in self.policy.block_categories:
            raise BlockedError(("credential",))
        label = F.lit(self.policy.masking.label("credential"))
        if self.needs_python(getattr(self.policy.masking, "native", False)):
            return label
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            return F.when(c.isNotNull(), label).otherwise(label)
        text = self.as_text(c, kind)
        masked = self.policy.masking.column if hasattr(self.policy.masking, "column") else keyed(self.policy.masking)
        return F.when(text.isNull() | (text == ""), label).otherwise(masked(text, F.lit("credential")))

    def act(self, rule, c: Column, kind: T.DataType) -> Column:  # noqa: ANN001
        if rule.action == "remove":
            self.count("removed")
            return F.lit(REMOVED)
        if rule.action == "block":
            return F.when(c.isNotNull() | F.lit(True), F.raise_error(F.lit("blocked categories: field")).cast("string"))
        if rule.action == "truncate":
            self.count("truncated")
            if not isinstance(kind, (T.StringType, T.BinaryType)):
                return F.lit(TRUNCATED)
            n = rule.max_chars
            return F.transform(F.array(self.text(self.as_text(c, kind))), lambda x: F.when(F.length(x) <= n, x).otherwise(F.concat(F.substring(x, 1, n), F.lit(TRUNCATED))))[0]
        if rule.action == "pseudonymize":
            if self.policy.pseudonyms is None:
                raise PseudonymError("pseudonymize needs a policy with pseudonyms")
            if isinstance(kind, (T.StringType, T.BinaryType, T.NumericType)) and not isinstance(kind, T.DecimalType):
                self.count("pseudonymized")
                if self.needs_python(False):
                    return F.lit("")
                return self.policy.pseudonyms.column(self.as_text(c, kind), F.lit(rule.category or "credential"))
        return self.mask(c, kind)

    def child(self, c: Column, kind: T.DataType, path: tuple, name: str | None, depth: int) -> Column | None:
        """What comes of a value at a place; None if nothing."""
        for key in (".".join(map(str, path)), kind.simpleString()):
            if key in self.adapters:
                c = self.adapters[key](c)
                kind = T.StringType()
        scalar = not isinstance(kind, (T.StructType, T.ArrayType, T.MapType))
        source, rule = self.policy.decide(path, name, scalar, name is not None and self.policy.is_sensitive_key(name))
        if source == "omit":
            self.count("not_allowed")
            self.dropped.append(".".join(map(str, path)))
            return None
        if source in ("path", "field", "sensitive"):
            if source != "sensitive":
                self.count(f"{source}_rule_matches")
            if rule is None or rule.action != "block":
                if self.policy.allowed(canonical_path(path)) == "prefix":  # a scalar where a container was allowed
                    self.count("not_allowed")
                    self.dropped.append(".".join(map(str, path)))
                    return None
            return self.mask(c, kind) if rule is None else self.act(rule, c, kind)
        return self.value(c, kind, path, depth)

    def value(self, c: Column, kind: T.DataType, path: tuple, depth: int) -> Column:
        if depth > self.policy.max_depth:
            return F.lit(MAX_DEPTH)
        if isinstance(kind, _NUMBERS):
            return c
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)  # JSON has no such number; NON_FINITE in text outputs
        if isinstance(kind, T.StringType):
            return self.text(c)
        if isinstance(kind, T.BinaryType):
            return self.text(F.decode(c, "UTF-8"))
        if isinstance(kind, T.DecimalType):
            return self.text(c.cast("string"))
        if isinstance(kind, T.DateType):
            return self.text(F.date_format(c, "yyyy-MM-dd"))
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            part = F.date_format(c, "SSSSSS")
            return self.text(F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(part == "000000", "").otherwise(F.concat(F.lit("."), part))))
        if isinstance(kind, T.StructType):
            made, taken = [], set()
            for f in kind.fields:
                out = self.child(c.getField(f.name), f.dataType, (*path, f.name), f.name, depth + 1)
                if out is not None:
                    made.append(out.alias(self.key(f.name, taken)))
            return F.when(c.isNotNull(), F.struct(*made)) if made else F.when(c.isNotNull(), F.expr("named_struct()"))
        if isinstance(kind, (T.ArrayType, T.MapType)):
            self.inside += 1
            out = self.shortened(self.array(F.slice(c, 1, self.policy.max_items), kind, path, depth), c, kind) if isinstance(kind, T.ArrayType) else self.map(c, kind, path, depth)
            self.inside -= 1
            return out
        self.counts["unsupported"] = self.counts.get("unsupported", 0) + 1
        return F.when(c.isNotNull(), F.lit(f"[UNSUPPORTED:{kind.typeName()}]"))

    def shortened(self, made: Column, c: Column, kind: T.ArrayType) -> Column:
        if not isinstance(kind.elementType, T.StringType):
            return made
        return F.when(F.size(c) > self.policy.max_items, F.concat(made, F.array(F.lit(TRUNCATED)))).otherwise(made)

    def key(self, name: str, taken: set[str]) -> str:
        shown = redact(name, self.policy)[0]
        unique, k = shown, 2
        while unique in taken:
            unique, k = f"{shown}#{k}", k + 1
        taken.add(unique)
        return unique

    def _indices(self, path: tuple) -> list[int]:
        """Indices that a rule or the allowlist names below a place."""
        place = canonical_path(path)
        segments = [r.segments for r in self.policy.path_rules] + list(self.policy._allowed)
        found = {int(s[len(place)]) for s in segments if len(s) > len(place) and all(a in ("*", b) for a, b in zip(s, place, strict=False)) and s[len(place)].isdigit()}
        return sorted(found)

    def array(self, c: Column, kind: T.ArrayType, path: tuple, depth: int) -> Column:
        own = self._indices(path)
        if not own:
            keep = self.child_or_drop(kind.elementType, (*path, -1), depth)
            if not keep:
                return F.slice(c, 1, 0)
            return F.transform(c, lambda x: self.child(x, kind.elementType, (*path, -1), None, depth + 1))
        # an element is handled by its own index if a rule names it, else like all others
        rest = self.child_or_drop(kind.elementType, (*path, -1), depth)
        parts = {i: self.child_or_drop(kind.elementType, (*path, i), depth) for i in own}
        named = lambda i: i.isin(own)

        def element(x: Column, i: Column) -> Column:
            out = self.child(x, kind.elementType, (*path, -1), None, depth + 1) if rest else None
            for k in own:
                if parts[k]:
                    made = self.child(x, kind.elementType, (*path, k), None, depth + 1)
                    out = made if out is None else F.when(i == k, made).otherwise(out)
            return out if out is not None else x

        stays = lambda i: F.when(named(i), i.isin([k for k in own if parts[k]]) if any(parts.values()) else F.lit(False)).otherwise(F.lit(rest))
        tagged = F.transform(c, lambda x, i: F.struct(stays(i).alias("stays"), element(x, i).alias("x")))
        return F.transform(F.filter(tagged, lambda t: t["stays"]), lambda t: t["x"])

    def child_or_drop(self, kind: T.DataType, path: tuple, depth: int) -> bool:
        scalar = not isinstance(kind, (T.StructType, T.ArrayType, T.MapType))
        return self.policy.decide(path, None, scalar)[0] != "omit"

    def map(self, c: Column, kind: T.MapType, path: tuple, depth: int) -> Column:
        """A map's keys are data: rules, allowlist and key scanning need the JSON walk."""
        self.python_inside = True
        return F.when(c.isNotNull(), F.expr("cast(map() AS map<string,string>)"))


def compile_policy(schema: T.StructType, policy: Policy | None = None, adapters: dict | None = None) -> Compiled:
    """The projection of a schema under a policy."""
    compiler = Compiler(policy or Policy(), adapters)
    columns, taken = [], set()
    for f in schema.fields:
        compiler.python_inside = False
        c = F.col(f"`{f.name}`")
        out = compiler.child(c, f.dataType, (f.name,), f.name, 1)
        if out is not None and compiler.python_inside:
            kind = SparkSession.active().createDataFrame([], T.StructType([f])).select(out.alias(f.name)).schema
            walked = clean_json(F.to_json(F.struct(c.alias(f.name))), replace(policy, max_depth=policy.max_depth + 1) if policy else None)
            out = F.from_json(walked["cleaned"], kind)[f.name]
        if out is not None:
            columns.append(out.alias(compiler.key(f.name, taken)))
    return Compiled(columns, compiler.counts, compiler.dropped)


def clean_frame(df: DataFrame, policy: Policy | None = None, adapters: dict | None = None) -> DataFrame:
    """A frame of any nested schema, redacted, masked and pruned."""
    return df.select(*compile_policy(df.schema, policy, adapters).columns)


__all__ = ["Compiled", "clean_frame", "compile_policy", "NON_FINITE"]
