"""Objects and facts out of what a model wrote around them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .shared import ship
from .text import strip


def last_object(text: str | None) -> str | None:
    """The whole text if it is JSON, else the last balanced {...} of it that is; braces in strings don't count. Null where there is none."""
    import json

    def parses(part):
        try:
            json.loads(part)
            return True
        except ValueError:
            return False

    if not text:
        return None
    if parses(text):
        return text
    found, opened, depth, quoted, escaped = None, 0, 0, False, False
    for i, c in enumerate(text):
        if quoted:
            quoted, escaped = escaped or c != '"', not escaped and c == "\\"
        elif c == '"':
            quoted = True
        elif c == "{":
            opened, depth = (i, 1) if not depth else (opened, depth + 1)
        elif c == "}" and depth:
            depth -= 1
            if not depth and parses(text[opened : i + 1]):
                found = text[opened : i + 1]
    return found


def _each(texts):
    import pyarrow as pa

    return pa.array([last_object(t) for t in texts.to_pylist()], pa.string())


def json_in(c: Column) -> Column:
    """last_object of each text; a scan with a stack, which no built-in function has."""
    return F.arrow_udf(_each, "string")(c)


def facts_in(c: Column) -> Column:
    """The facts of a model's JSON: a list, or an object's list `facts`, of strings, objects (their values joined) or other values; stripped, blank ones left out."""
    v = F.try_parse_json(c)
    listed = F.when(F.schema_of_variant(v).startswith("ARRAY"), v).otherwise(F.try_variant_get(v, "$.facts", "variant"))
    items = F.coalesce(F.try_variant_get(listed, "$", "array<variant>"), F.array().cast("array<variant>"))
    values = lambda x: F.map_values(F.try_variant_get(x, "$", "map<string,string>"))
    full = lambda a: F.filter(F.transform(a, lambda t: strip(t)), lambda t: t != "")
    told = F.transform(items, lambda x: F.coalesce(F.array_join(full(values(x)), "; "), F.try_variant_get(x, "$", "string")))
    return full(F.filter(told, lambda t: t.isNotNull()))


ship(__name__)
