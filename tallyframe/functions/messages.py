"""Replies and tool calls in the shapes that different services give them, as JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys that may hold the visible answer, in order.
ANSWER_KEYS = ["response", "content", "text", "answer"]
CALLS = "array<struct<id:string,function:struct<name:string,arguments:string>,name:string,arguments:string>>"


def response_text(reply: Column) -> Column:
    """The visible answer: the first of the keys of a JSON object that holds a text with content, a plain text as it is, else the empty text."""
    v = F.try_parse_json(reply)
    kind = F.schema_of_variant(v)
    from_object = F.coalesce(*[F.when(F.trim(x) != "", x) for x in (F.try_variant_get(v, f"$.{k}", "string") for k in ANSWER_KEYS)], F.lit(""))
    text = F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).otherwise(reply)
    return F.when(reply.isNull(), "").when(F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False)), from_object).otherwise(text)


def tool_calls(raw: Column) -> Column:
    """ARRAY<STRUCT<id, name, arguments>> of a JSON array of calls, nested in ``function`` or flat; a call without an id is named by its place, and
    without arguments has an empty object. Anything else gives an empty array."""
    empty = F.array().cast("array<struct<id:string,name:string,arguments:string>>")
    calls = F.from_json(raw, CALLS)
    one = lambda c, i: F.struct(
        F.coalesce(c["id"], F.concat(F.lit("call_"), i.cast("string"))).alias("id"), F.coalesce(c["function"]["name"], c["name"], F.lit("")).alias("name"), F.coalesce(c["function"]["arguments"], c["arguments"], F.lit("{}")).alias("arguments")
    )
    return F.coalesce(F.transform(F.filter(calls, lambda c: c.isNotNull()), one), empty)
