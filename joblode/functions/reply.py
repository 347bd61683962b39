"""From the raw text of a model's reply to a checked extraction.

All of it is column code. A reply is parsed as a one-element array of maps to
VARIANT: the brackets make trailing junk an error, the map tells a missing key
from a null, and VARIANT keeps the type of each value. The parser leaves repeated
keys in the map; turned around, the last of them is found first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from joblode import constants as K
from joblode.functions.text import infer_role, let, nonempty, seniority_by_years, strip
from joblode.schemas import EXTRACTION_SCHEMA

_LISTS = ("skills_must", "skills_nice", "past_experience")


def unfence(raw: Column) -> Column:
    """Drop the Markdown fences around a reply."""
    bare = F.regexp_replace(raw, r"(?U)^```(?:json)?\s*", "")
    bare = F.regexp_replace(bare, r"(?U)\s*```$", "")
    return F.when(raw.startswith("```"), bare).otherwise(raw)


def outer_braces(raw: Column) -> Column:
    """From the first ``{`` to the last ``}``; the text itself if there is no such span."""
    return F.coalesce(nonempty(F.regexp_extract(raw, r"(?s)(\{.*\})", 1)), raw)


def parse_fields(raw: Column) -> Column:
    """STRUCT ``keys, values`` of the reply's fields, last first, with VARIANT values.

    NULL unless the reply is exactly one JSON object.
    """
    text = outer_braces(unfence(strip(raw)))
    parsed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string,variant>>",
                         {"allowSingleQuotes": "false"})

    def turned(objects: Column) -> Column:
        fields = F.get(objects, 0)
        return F.when(F.size(objects) == 1,
                      F.struct(F.reverse(F.map_keys(fields)).alias("keys"),
                               F.reverse(F.map_values(fields)).alias("values")))

    return let(parsed, turned)


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _text(value: Column) -> Column:
    """A value's text; booleans as ``True`` / ``False``."""
    plain = F.try_variant_get(value, "$", "string")
    return F.when(_kind(value) == "BOOLEAN", F.initcap(plain)).otherwise(plain)


def _truthy(value: Column) -> Column:
    kind = _kind(value)
    number = F.try_variant_get(value, "$", "double")
    nested = F.try_variant_get(value, "$", "string")
    return (F.when(kind == "VOID", F.lit(False))
            .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
            .when(kind == "STRING", nested != "")
            .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"),
                  ~nested.isin("[]", "{}"))
            .otherwise(F.coalesce(number != 0, F.lit(True))))


def _list(value: Column) -> Column:
    """Truthy items of a list as text; anything but a list gives an empty one."""
    items = F.try_variant_get(value, "$", "array<variant>")
    kept = F.transform(F.filter(items, _truthy), _text)
    return F.when(_kind(value).startswith("ARRAY"), kept).otherwise(
        F.array().cast("array<string>"))


def _years(value: Column) -> Column:
    """Whole number of a numeric value (cut toward zero) or of a text that is an integer."""
    kind = _kind(value)
    text = strip(F.try_variant_get(value, "$", "string"))
    integral = F.when(text.rlike(r"^[+-]?\d+(_\d+)*$"), F.replace(text, F.lit("_"), F.lit("")))
    number = F.try_variant_get(value, "$", "double")
    cut = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).try_cast("int")
    return (F.when(kind == "STRING", integral.try_cast("int"))
            .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("int"))
            .when(kind.startswith("ARRAY") | kind.startswith("OBJECT") | (kind == "VOID"),
                  F.lit(None).cast("int"))
            .otherwise(F.when(~F.isnan(number), cut)))


def empty_extraction() -> Column:
    """What a posting without a usable description or reply gets."""
    none = F.array().cast("array<string>")
    return F.struct(
        F.lit(K.DEFAULT_ROLE).alias("role"), F.lit(K.DEFAULT_SENIORITY).alias("seniority"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("int").alias("yearsexperience"),
        *[none.alias(name) for name in _LISTS])


def _as_extraction(struct: Column) -> Column:
    return struct.cast(EXTRACTION_SCHEMA)


def checked_fields(fields: Column, title: Column, description: Column) -> Column:
    """STRUCT extraction from the parsed fields of a reply for a posting.

    A missing key takes its default; a key with a null or unknown value is
    judged: the role is then inferred from the title. ``experience`` hides
    ``yearsexperience`` wherever it is present. A role or seniority that is a
    list or an object makes the reply unusable.
    """
    def has(key: str) -> Column:
        return F.array_contains(fields["keys"], key)

    def get(key: str) -> Column:
        return F.get(fields["values"], (F.array_position(fields["keys"], key) - 1).cast("int"))

    def nested(key: str) -> Column:
        kind = _kind(get(key))
        return has(key) & (kind.startswith("ARRAY") | kind.startswith("OBJECT"))

    def member(key: str, allowed: tuple[str, ...]) -> Column:
        return F.coalesce((_kind(get(key)) == "STRING") & _text(get(key)).isin(*allowed),
                          F.lit(False))

    role = (F.when(~has("role"), F.lit(K.DEFAULT_ROLE))
            .when(member("role", K.VALID_ROLES), _text(get("role")))
            .otherwise(infer_role(title)))
    seniority = F.when(member("seniority", K.VALID_SENIORITY),
                       _text(get("seniority"))).otherwise(F.lit(K.DEFAULT_SENIORITY))
    years = (F.when(has("experience"), _years(get("experience")))
             .when(has("yearsexperience"), _years(get("yearsexperience"))))
    about = F.when(has("description") & _truthy(get("description")),
                   strip(_text(get("description"))))
    lists = [F.when(has(k), _list(get(k))).otherwise(F.array().cast("array<string>")).alias(k)
             for k in _LISTS]
    full = F.struct(role.alias("role"), seniority_by_years(seniority, years).alias("seniority"),
                    about.alias("description"), years.alias("yearsexperience"), *lists)
    unusable = (fields.isNull() | nested("role") | nested("seniority")
                | no_description(description))
    return F.when(F.coalesce(unusable, F.lit(True)), _as_extraction(empty_extraction())
                  ).otherwise(_as_extraction(full))


def no_description(description: Column) -> Column:
    return description.isNull() | description.isin("", K.MISSING)
