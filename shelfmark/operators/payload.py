"""JSON payloads against a schema, at every depth.

A schema is a dictionary in JSON Schema's words: ``type`` (a name or a list of names), ``properties``, ``required``, ``additionalProperties`` (false closes an object), ``items``, ``enum``, ``minimum``, ``pattern``, and
``$ref`` to ``#/$defs/name``, also within itself. Payloads are parsed once into VARIANT and walked level by level: a value meets the rule of its place and gives way to itself, if it is faulty, and to those of its members
that have a rule. A few levels are one pass over the rows; what is settled after them are faulty values and values still deeper, and the walk ends with the deepest payload.

Defined cases: a null body has no faults, a body that is no JSON (or names a key of an object twice) the fault ``json``; what a ``$ref`` doesn't find is an error of the schema; an empty frame gives no rows.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import settle

#: Types of VARIANT by their names in a schema.
KINDS = {"object": ["OBJECT"], "array": ["ARRAY"], "string": ["STRING"], "boolean": ["BOOLEAN"], "null": ["VOID"], "number": ["BIGINT", "DOUBLE", "FLOAT", "DECIMAL"], "integer": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"]}


@dataclass
class Rule:
    """What a place asks of its value; members are rules by number."""

    kinds: list[str] = field(default_factory=list)
    whole: bool = False
    members: dict[str, int] = field(default_factory=dict)
    required: list[str] = field(default_factory=list)
    closed: bool = False
    each: int = -1
    allowed: list[str] | None = None
    least: float | None = None
    pattern: str | None = None


def rules_of(schema: dict) -> list[Rule]:
    """The schema's rules in a list, the root's first."""
    out: list[Rule] = []
    named: dict[str, int] = {}

    def add(s: dict) -> int:
        ref = s.get("$ref")
        if ref in named:
            return named[ref]
        at = len(out)
        out.append(Rule())
        if ref:
            named[ref] = at
            s = schema["$defs"][ref.removeprefix("#/$defs/")]
        types = [s["type"]] if isinstance(s.get("type"), str) else s.get("type", [])
        r = out[at]
        r.kinds = [k for name in types for k in KINDS[name]]
        r.whole = "integer" in types and "number" not in types
        r.members = {name: add(p) for name, p in s.get("properties", {}).items()}
        r.required, r.closed = list(s.get("required", [])), s.get("additionalProperties", True) is False
        r.each = add(s["items"]) if "items" in s else -1
        r.allowed, r.least, r.pattern = s.get("enum"), None if s.get("minimum") is None else float(s["minimum"]), s.get("pattern")
        return at

    add(schema)
    return out


#: Payloads a task, and levels a pass.
PAYLOADS = 50_000
LEVELS = 8
RULE = "array<struct<kinds array<string>, whole boolean, members map<string,int>, required array<string>, closed boolean, each int, allowed array<string>, least double, pattern string>>"


def kind_of(v: Column) -> Column:
    """The type of a value that has no members."""
    return F.substring_index(F.schema_of_variant(v), "(", 1)


def _asked(kind: Column, v: Column, rule: Column) -> tuple[Column, Column, Column]:
    """Whether a value's type fits, whether the value is unlike what is asked, and its text. Values are cast only where a rule asks for it."""
    number = kind.isin(*KINDS["number"])
    text = F.when(kind == "STRING", v.try_cast("string"))
    fits = (F.size(rule["kinds"]) == 0) | F.array_contains(rule["kinds"], kind) & ~(rule["whole"] & number & (kind != "BIGINT") & (v.try_cast("double") % 1 != 0))
    unlike = rule["allowed"].isNotNull() & ~F.array_contains(rule["allowed"], F.coalesce(text, F.to_json(v))) | rule["least"].isNotNull() & number & (v.try_cast("double") < rule["least"]) | rule["pattern"].isNotNull() & ~F.rlike(text, rule["pattern"])
    return fits, unlike, text


def _deeper(level: DataFrame, asked: Column) -> DataFrame:
    """``key, path, rule, v, kind``: faulty values, which have a kind, as they are; every other value gives way to itself with its kind if it is faulty, and to its members that have a rule, without a kind.

    ``asked`` holds the rules, by number. Generators bind what a value is, so that it is read once, and only such expressions are used as Spark compiles.
    """
    v, path, rule, done = F.col("v"), F.col("path"), F.get(asked, F.col("rule")), F.col("kind").isNotNull()
    b = level.select("*", F.inline(F.array(F.struct(F.when(~done, v.try_cast("map<string,variant>")).alias("fields"), F.when(~done, v.try_cast("array<variant>")).alias("items")))))
    kind = F.when(done, F.col("kind")).when(F.col("fields").isNotNull(), "OBJECT").when(F.col("items").isNotNull(), "ARRAY").otherwise(kind_of(v))
    b = b.select("key", "path", "rule", "v", done.alias("done"), "fields", "items", F.explode(F.array(kind)).alias("kind"))
    fits, unlike, _ = _asked(F.col("kind"), v, rule)
    names = F.map_keys("fields")
    short = (F.size(rule["required"]) > 0) & (F.size(F.array_except(rule["required"], names)) > 0)
    over = rule["closed"] & (F.size(F.array_except(names, F.map_keys(rule["members"]))) > 0)
    object_ = F.col("kind") == "OBJECT"
    inside = object_ & (F.size(rule["members"]) > 0) & (F.size("fields") > 0) | (F.col("kind") == "ARRAY") & (rule["each"] >= 0) & (F.size("items") > 0)
    own, none = F.array(F.lit(True)), F.array().cast("array<boolean>")
    roles = F.when(F.col("done") | ~fits, own).otherwise(F.concat(F.when(F.coalesce(unlike, F.lit(False)) | object_ & (short | over), own).otherwise(none), F.when(inside, F.array(F.lit(False))).otherwise(none)))
    b = b.select("*", F.explode(roles).alias("own"))
    b = b.select("*", F.explode_outer(F.when(~F.col("own"), F.col("fields"))).alias("name", "field"))
    b = b.select("*", F.posexplode_outer(F.when(~F.col("own"), F.col("items"))).alias("pos", "item"))
    step = F.coalesce(F.col("pos").cast("string"), F.replace(F.replace("name", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
    at = F.when(F.col("own"), F.col("rule")).when(F.col("pos").isNotNull(), rule["each"]).otherwise(F.try_element_at(rule["members"], F.col("name")))
    out = b.select("key", F.when(F.col("own"), path).otherwise(F.concat(path, F.lit("/"), step)).alias("path"), at.alias("rule"), F.when(F.col("own"), v).otherwise(F.coalesce("item", "field")).alias("v"), F.when(F.col("own"), F.col("kind")).alias("kind"))
    return out.where("rule IS NOT NULL")


def _faults(values: DataFrame, asked: Column) -> DataFrame:
    """``key, path, fault, detail`` of values that are faulty: a wrong type alone, else all that is missing, extra and unlike."""
    kind, v, rule = F.col("kind"), F.col("v"), F.get(asked, F.col("rule"))
    fits, unlike, text = _asked(kind, v, rule)
    names = F.when(kind == "OBJECT", F.map_keys(v.try_cast("map<string,variant>")))
    fault = lambda name, detail: F.struct(F.lit(name).alias("fault"), detail.alias("detail"))
    none = F.array().cast("array<struct<fault:string,detail:string>>")
    faults = F.when(~fits, F.array(fault("type", kind))).otherwise(
        F.concat(
            F.when((kind == "OBJECT") & (F.size(rule["required"]) > 0), F.transform(F.array_except(rule["required"], names), lambda n: fault("missing", n))).otherwise(none),
            F.when((kind == "OBJECT") & rule["closed"], F.transform(F.array_except(names, F.map_keys(rule["members"])), lambda n: fault("extra", n))).otherwise(none),
            F.when(unlike, F.array(fault("value", F.coalesce(text, F.to_json(v))))).otherwise(none),
        )
    )
    return values.select("key", "path", F.inline(faults))


def violations(payloads: DataFrame, key: str, body: str, schema: dict) -> DataFrame:
    """``key, path, fault, detail``: faults are ``json``, ``type``, ``missing``, ``extra`` and ``value``; a path is a JSON pointer, empty for the whole payload."""
    spark = payloads.sparkSession
    asked = F.from_json(F.lit(json.dumps([asdict(r) for r in rules_of(schema)])), RULE)  # as many as the schema has places
    # One file may hold many payloads, and each makes many values: they are dealt by their number, at least over the cores there are. By hash: dealt in turn, a file's payloads would be sorted first.
    rows = payloads.count()
    n = max(1 + rows // PAYLOADS, min(spark.sparkContext.defaultParallelism, 1 + rows // 1000))
    parsed = settle(payloads.where(F.col(body).isNotNull()).select(F.col(key).alias("key"), F.col(body).alias("_b")).repartition(n, "key", "_b").select("key", F.try_parse_json("_b").alias("v")))
    found = [parsed.where("v IS NULL").select("key", F.lit("").alias("path"), F.lit("json").alias("fault"), F.lit("").alias("detail"))]
    level = parsed.where("v IS NOT NULL").select("key", F.lit("").alias("path"), F.lit(0).alias("rule"), "v", F.lit(None).cast("string").alias("kind"))
    while True:
        for _ in range(LEVELS):
            level = _deeper(level, asked)
        walked = settle(level)
        found.append(_faults(walked.where("kind IS NOT NULL"), asked))
        level = walked.where("kind IS NULL")
        if level.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.withColumnRenamed("key", key)


def summary(faults: DataFrame, key: str, shown: int = 5) -> DataFrame:
    """By payload: how many faults, and the first ``shown`` of them in order, as text. Spark's window limit keeps no more than these of a payload before the shuffle."""
    line = F.concat(F.when(F.col("path") == "", F.lit("<root>")).otherwise(F.col("path")), F.lit(": "), "fault", F.lit(" "), "detail")
    lines = faults.select(key, line.alias("line"))
    first = lines.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("line"))).where(F.col("_n") <= shown)
    first = first.groupBy(key).agg(F.array_sort(F.collect_list("line")).alias("first_faults"))
    return lines.groupBy(key).agg(F.count("*").alias("n_faults")).join(first, key)
