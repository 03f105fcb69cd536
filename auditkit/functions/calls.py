"""Canonical form of a logged call."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditkit.functions.text import strip


def quoted(text: Column) -> Column:
    """The text as a JSON string, so that no text can imitate another argument."""
    return F.regexp_replace(F.to_json(F.struct(text.alias("t"))), r'(?s)^\{"t":|\}$', "")


def canonical_arguments(tool: Column, arguments: Column, schema_args: dict[str, tuple[str, ...]],
                        defaults: dict[str, dict[str, object]]) -> Column:
    """One text per distinct meaning of a JSON argument object.

    Strings of arguments the tool knows lose the blanks at their ends, defaults fill what is absent, keys are sorted, and every value is
    written as JSON. Text that is not an object is kept as written.
    """
    given = F.from_json(arguments, "map<string,variant>")
    known, fill = F.lit(None).cast("array<string>"), F.lit(None).cast("map<string,string>")
    for t, names in schema_args.items():
        known = F.when(tool == t, F.array(*[F.lit(n) for n in names])).otherwise(known)
    for t, values in defaults.items():
        pairs = [F.lit(x) for k, v in values.items() for x in (k, json.dumps(v, sort_keys=True))]
        fill = F.when(tool == t, F.create_map(*pairs)).otherwise(fill)

    def written(k: Column, v: Column) -> Column:
        text = F.try_variant_get(v, "$", "string")
        is_text = F.schema_of_variant(v) == "STRING"
        trim = F.coalesce(F.array_contains(known, k), F.lit(False))
        return F.when(is_text & trim, quoted(strip(text))).when(is_text, quoted(text)).otherwise(F.to_json(v))

    shown = F.transform_values(given, written)
    absent = F.map_filter(F.coalesce(fill, F.expr("map()").cast("map<string,string>")),
                          lambda k, _: ~F.map_contains_key(given, k))
    entries = F.sort_array(F.map_entries(F.map_concat(shown, absent)))
    plain = lambda k: F.when(k.rlike(r"^\w+$"), k).otherwise(quoted(k))
    text = F.array_join(F.transform(entries, lambda e: F.concat(plain(e["key"]), F.lit("="), e["value"])), "&")
    return F.when(strip(arguments).startswith("{"), text).otherwise(arguments)
