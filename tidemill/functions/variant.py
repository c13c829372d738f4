"""JSON of unknown depth by Spark's VARIANT: every value of a text with its path, without a shuffle and without a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NODE = "struct<path:string,place:string,depth:int,node:variant>"


def depth(text: Column) -> Column:
    """How many levels a JSON text can have at most: the deepest brackets outside strings, and the value itself."""
    bare = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", "")
    step = lambda a, c: F.struct((a["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(a["most"], a["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("most"))
    signs = F.filter(F.split(bare, ""), lambda c: c != "")
    return F.aggregate(signs, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a["most"] + 1)


def _children(path: Column, place: Column, level: Column, node: Column) -> Column:
    """A value's members or items, as an array of nodes; empty for one that has none."""
    named = lambda k: F.concat(path, F.lit("."), k)
    members = F.transform(F.map_entries(F.try_variant_get(node, "$", "map<string,variant>")), lambda e: F.struct(named(e["key"]), F.concat(place, F.lit("."), e["key"]), level + 1, e["value"]).cast(_NODE))
    items = F.transform(F.try_variant_get(node, "$", "array<variant>"), lambda v, i: F.struct(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), F.concat(place, F.lit("[*]")), level + 1, v).cast(_NODE))
    return F.coalesce(members, items, F.array().cast(f"array<{_NODE}>"))


def kind(name: Column) -> Column:
    """object, array, string, number, boolean or null, by the name of a value's schema."""
    return (
        F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").otherwise("number")
    )


def paths(rows: DataFrame, text: str, keep: list[str], levels: int | None = None) -> DataFrame:
    """Each value of each JSON text: the kept columns, path ($.a[0].b), place (the path with [*] for positions), kind, value.

    value is the text of a string, number or boolean, else null. A null text has no rows; one that is no JSON, or names a member twice,
    has one of kind "invalid". Members stand in no order. levels: how deep texts are nested; where it is not given, one pass over the
    column finds out. Every level is one more generator of the same stage.
    """
    if levels is None:
        levels = rows.agg(F.max(depth(F.col(text)))).head()[0] or 1
    whole = F.try_parse_json(F.col(text))
    out = rows.where(F.col(text).isNotNull()).select(*keep, F.lit("$").alias("path"), F.lit("$").alias("place"), F.lit(0).alias("depth"), whole.alias("node"))
    for level in range(levels - 1):
        self = F.array(F.struct("path", "place", "depth", "node").cast(_NODE))
        more = F.when((F.col("depth") == level) & F.col("node").isNotNull(), _children(F.col("path"), F.col("place"), F.col("depth"), F.col("node")))
        out = out.select(*keep, F.inline(F.concat(self, F.coalesce(more, F.array().cast(f"array<{_NODE}>")))))
    # a schema's name is taken once a value, as a column of its own
    named = out.select(*keep, "path", "place", "node", F.schema_of_variant("node").alias("schema"))
    named = named.select(*keep, "path", "place", "node", F.when(F.col("node").isNull(), "invalid").otherwise(kind(F.col("schema"))).alias("kind"))
    scalar = F.when(F.col("kind").isin("string", "number", "boolean"), F.try_variant_get("node", "$", "string"))
    return named.select(*keep, "path", "place", "kind", scalar.alias("value"))


def catalog(found: DataFrame) -> DataFrame:
    """Places with their kinds, how often each stands there and in how many different values: a schema read off the data."""
    return found.groupBy("place", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values"))
