"""Parameters of a check, one model for both ways in: literals of a declared check, and the JSON
text in a row of a checks table. Builders only ever ask for typed Columns, so a template means
the same in both."""
from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofline.functions import jsonpath as jp
from proofline.functions.regex import PY_SEARCH_FLAGS, search_pattern


def compact(value: Any) -> str:
    """JSON text as VARIANT prints it: no blanks, keys sorted, not escaped."""
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False, sort_keys=True)


class Literal:
    """Parameters known when the plan is built."""

    def __init__(self, values: dict[str, Any]):
        self.values = values

    def string(self, name: str) -> Column:
        v = self.values[name]
        return F.lit(v if isinstance(v, str) else compact(v))

    def number(self, name: str, default: float) -> Column:
        return F.lit(float(self.values.get(name, default)))

    def shown(self, name: str, default: str) -> Column:
        return F.lit(str(self.values[name]) if name in self.values else default)

    def flag(self, name: str, default: bool) -> Column:
        return F.lit(bool(self.values.get(name, default)))

    def strings(self, name: str, default: list[str] = ()) -> Column:
        found = self.values.get(name, list(default))
        return F.array(*[F.lit(x) for x in found]) if found else F.expr("cast(array() as array<string>)")

    def json_values(self, name: str) -> Column:
        return F.array(*[F.lit(compact(x)) for x in self.values[name]])

    def json_value(self, name: str) -> Column:
        return F.lit(compact(self.values[name]))

    def pattern(self, name: str) -> Column:
        return F.lit(search_pattern(self.values[name]))

    def matches(self, body: Column) -> Column:
        return jp.matches(body, self.values["field"])


class Data:
    """Parameters in a VARIANT column, parsed once per row of the checks table."""

    def __init__(self, params: Column):
        self.params = params

    def _get(self, name: str, kind: str) -> Column:
        return F.try_variant_get(self.params, jp._key_path(name), kind)

    def _text(self, name: str) -> Column:
        return F.to_json(self._get(name, "variant"))

    def string(self, name: str) -> Column:
        v = self._get(name, "variant")
        return F.when(F.schema_of_variant(v) == "STRING", self._get(name, "string")).otherwise(F.to_json(v))

    def number(self, name: str, default: float) -> Column:
        return F.coalesce(self._get(name, "double"), F.lit(float(default)))

    def shown(self, name: str, default: str) -> Column:
        return F.coalesce(self._text(name), F.lit(default))

    def flag(self, name: str, default: bool) -> Column:
        return F.coalesce(self._get(name, "boolean"), F.lit(default))

    def strings(self, name: str, default: list[str] = ()) -> Column:
        return F.coalesce(self._get(name, "array<string>"), Literal({}).strings(name, default))

    def json_values(self, name: str) -> Column:
        return F.transform(self._get(name, "array<variant>"), lambda v: F.to_json(v))

    def json_value(self, name: str) -> Column:
        return self._text(name)

    def pattern(self, name: str) -> Column:
        p = self._get(name, "string")
        for python, java in ((r"\(\?P<", "(?<"), (r"\(\?P=([A-Za-z_][A-Za-z0-9_]*)\)", r"\\k<$1>"),
                             (r"(?<!\\)((?:\\\\)*)\\Z", r"$1\\z")):
            p = F.regexp_replace(p, python, java)
        return F.concat(F.lit(PY_SEARCH_FLAGS), p)

    def steps(self) -> Column:
        """The path of this row, read once."""
        return jp.path_steps(self._get("field", "string"))

    def matches(self, body: Column, steps: Column) -> Column:
        return F.coalesce(jp.matches_by_steps(body, steps), jp.no_variants())

    def problem(self, required: tuple[str, ...]) -> Column:
        """What is wrong with the parameters of this row, NULL if nothing is."""
        out = F.when(self.params.isNull(), F.lit("parameters are not JSON"))
        for name in required:
            out = out.when(self._get(name, "variant").isNull(), F.lit(f"missing parameter: {name}"))
        if "field" in required:
            out = out.when(~jp.path_supported(self._get("field", "string")),
                           F.concat(F.lit("path not supported in a checks table: "), self._get("field", "string")))
        return out


INFINITY = math.inf
