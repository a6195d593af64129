"""JSON payloads: canonical form, hash, field access, inferred schema and schema differences."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

ROOT = "<root>"


#: Whether a payload may repeat a key, of which the last then counts; else it is no JSON to Spark.
_REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"


def allow_repeated_keys(spark: SparkSession) -> None:
    """Let payloads repeat a key in this session, as JSON readers usually do: the last one counts."""
    if spark.conf.get(_REPEATED_KEYS, "false") != "true":
        spark.conf.set(_REPEATED_KEYS, "true")


def variant(payload: Column) -> Column:
    return F.try_parse_json(payload)


def canonical_json(payload: Column) -> Column:
    """The payload with the keys of every object in order; {} for null, the text itself where it is no JSON.

    Equal numbers have one form, so 1 and 1.0 are the same.
    """
    return F.coalesce(F.to_json(variant(payload)), payload, F.lit("{}"))


def payload_hash(payload: Column) -> Column:
    return F.sha2(canonical_json(payload), 256)


def strict_canonical_json(payload: Column) -> Column:
    """Like canonical_json(), but whole numbers and fractions differ (1 and 1.0), fractions as doubles: 1.50 is 1.5, 1e2 is 100.0.

    Fractions are given an exponent, which makes them doubles to Spark. Escapes of backslash and quote are set aside
    while text is looked through, by characters that no JSON holds unescaped, so that a string ends at the next quote.
    Text after the first value does not count; whole numbers of more than 38 digits are doubles too.
    """
    text = F.replace(F.replace(payload, F.lit("\\\\"), F.lit("\x03")), F.lit('\\"'), F.lit("\x04"))
    text = F.regexp_replace(text, r'("[^"]*+")|(-?[0-9]++\.[0-9]++)(?![0-9eE])', "$1\x02$2\x01")
    for mark, plain in (("\x02\x01", ""), ("\x02", ""), ("\x01", "e0"), ("\x04", '\\"'), ("\x03", "\\\\")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    found = F.when(variant(payload).isNotNull(), F.to_json(variant(text)))
    return F.coalesce(found, F.nullif(payload, F.lit("")), F.lit("{}"))


def token(value: Column) -> Column:
    """STRING, NUMBER, BOOLEAN, NULL, ARRAY or OBJECT."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "VOID", F.lit("NULL"))
        .when(kind.startswith("OBJECT"), F.lit("OBJECT"))
        .when(kind.startswith("ARRAY"), F.lit("ARRAY"))
        .when(kind == "STRING", F.lit("STRING"))
        .when(kind == "BOOLEAN", F.lit("BOOLEAN"))
        .when(kind.isNull(), F.lit("NULL"))
        .when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), F.lit("NUMBER"))
        .otherwise(F.lit("UNKNOWN"))
    )


_ENTRIES = "array<struct<path:string,type:string>>"
#: Of the text of a variant's schema: a name, an opened object or array, a closed one, another type.
_TOKENS = r"(?:`(?:[^`]|``)*`|[^`<>,():\s]+): |OBJECT<|ARRAY<|>|[A-Z][A-Z_]*(?:\([0-9, ]+\))?"


def shape(payload: Column) -> Column:
    """The text of the payload's schema as Spark writes it: the same for payloads of the same keys and types; "" of none."""
    return F.coalesce(F.schema_of_variant(variant(payload)), F.lit(""))


def raw_entries(shape: Column) -> Column:
    """array<struct<path, type>> of a shape, unsorted; an object appears itself and with its fields, at any depth.

    Walks through the text with a stack of paths; what is inside of arrays is left out. A value that is no object is
    one entry <root>.
    """

    def step(state: Column, t: Column) -> Column:
        stack, inside, name, out = (state[c] for c in ("stack", "inside", "name", "out"))
        named, opened, closed = t.endswith(": "), t.endswith("<"), t == ">"
        kind = (
            F.when(t == "OBJECT<", F.lit("OBJECT")).when(t == "ARRAY<", F.lit("ARRAY")).when(t == "VOID", F.lit("NULL")).when(t.isin("STRING", "BOOLEAN"), t)
            .when(t.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), F.lit("NUMBER")).otherwise(F.lit("UNKNOWN"))
        )
        top = F.size(stack) == 0
        path = F.when(top, F.lit(ROOT)).otherwise(F.concat(F.element_at(stack, -1), name))
        silent = named | closed | (inside > 0) | (top & (t == "OBJECT<"))
        plain = F.substring(t, F.lit(1), F.length(t) - 2)
        quoted = F.replace(F.substring(t, F.lit(2), F.length(t) - 4), F.lit("``"), F.lit("`"))
        below = F.when(top, F.lit("")).otherwise(F.concat(path, F.lit(".")))
        outside = inside == 0
        return F.struct(
            F.when(outside & (t == "OBJECT<"), F.concat(stack, F.array(below))).when(outside & closed, F.slice(stack, 1, F.size(stack) - 1)).otherwise(stack).alias("stack"),
            F.when(opened & ((inside > 0) | (t == "ARRAY<")), inside + 1).when(closed & (inside > 0), inside - 1).otherwise(inside).alias("inside"),
            F.when(named & outside, F.when(t.startswith("`"), quoted).otherwise(plain)).otherwise(name).alias("name"),
            F.when(silent, out).otherwise(F.concat(out, F.array(F.struct(path.alias("path"), kind.alias("type"))))).alias("out"),
        )

    none = F.array().cast("array<string>")
    start = F.struct(none.alias("stack"), F.lit(0).alias("inside"), F.lit("").alias("name"), F.array().cast(_ENTRIES).alias("out"))
    found = F.aggregate(F.regexp_extract_all(shape, F.lit(_TOKENS), F.lit(0)), start, step, lambda state: state["out"])
    return F.when(shape == "", F.array(F.struct(F.lit(ROOT).alias("path"), F.lit("NULL").alias("type")))).otherwise(found)


def sorted_entries(found: Column) -> Column:
    """Entries by path; where a dotted key equals a nested path the last one counts."""
    later = lambda e, i: F.exists(F.slice(found, i + 2, F.size(found)), lambda x: x["path"] == e["path"])
    once = F.size(F.array_distinct(F.transform(found, lambda e: e["path"]))) == F.size(found)
    return F.array_sort(F.when(once, found).otherwise(F.filter(found, lambda e, i: ~later(e, i))))


def schema_entries(payload: Column) -> Column:
    """The schema of a payload: its entries sorted by path."""
    return sorted_entries(raw_entries(shape(payload)))


def schema_json(entries: Column) -> Column:
    return F.to_json(F.map_from_entries(entries))


def schema_hash(entries: Column) -> Column:
    return F.sha2(F.array_join(F.transform(entries, lambda e: F.concat(e["path"], F.lit("="), e["type"], F.lit(";"))), ""), 256)


def leaves(entries: Column) -> Column:
    """Paths that are no objects."""
    return F.transform(F.filter(entries, lambda e: e["type"] != "OBJECT"), lambda e: e["path"])


def nullish(schema: Column, path: Column) -> Column:
    """Whether a field is missing from a map of path to type, or null."""
    return F.coalesce(F.try_element_at(schema, path), F.lit("NULL")) == "NULL"


def missing_fields(expected: Column, observed: Column) -> Column:
    return F.array_sort(F.array_except(F.map_keys(expected), F.map_keys(observed)))


def added_fields(expected: Column, observed: Column) -> Column:
    return missing_fields(observed, expected)


def changed_fields(expected: Column, observed: Column) -> Column:
    """Map of path to struct<expected, observed> where the type differs."""
    common = F.map_filter(expected, lambda k, v: F.try_element_at(observed, k).isNotNull() & (F.try_element_at(observed, k) != v))
    return F.transform_values(common, lambda k, v: F.struct(v.alias("expected"), F.try_element_at(observed, k).alias("observed")))


def first_changed_field(changed: Column, missing: Column, added: Column) -> Column:
    """The first field whose type changed, else the first missing one, else the first added one."""
    return F.coalesce(F.get(F.array_sort(F.map_keys(changed)), F.lit(0)), F.get(missing, F.lit(0)), F.get(added, F.lit(0)))
