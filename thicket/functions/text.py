"""Text expressions: tokens, clean-up, display forms. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# A token is a run of non-blanks with the blanks before it, so joining tokens gives the text back.
TOKEN = r"[ \t\n\r\f]*[^ \t\n\r\f]+"

# Keys left out of a node's property list.
HIDDEN_PROPERTIES = ["name", "description", "properties", "label", "chunk id", "level"]


def tokens(text: Column) -> Column:
    """Default tokenizer: an array of blank-preserving words."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def sanitized(value: Column) -> Column:
    """Null becomes '', other text is trimmed."""
    return F.coalesce(F.trim(value), F.lit(""))


def sanitized_list(value: Column) -> Column:
    """A list field as one string."""
    return F.coalesce(F.array_join(value, ", "), F.lit(""))


def node_text(name: Column, description: Column, node_id: Column) -> Column:
    """``name description``, or the id in brackets when both are empty."""
    text = F.trim(F.concat_ws(" ", sanitized(name), sanitized(description)))
    return F.when(text == "", F.concat(F.lit("[Node: "), node_id, F.lit("]"))).otherwise(text)


def index_text(name: Column, description: Column) -> Column:
    """``name,description`` with 'none' for empty parts."""
    filled = lambda c: F.coalesce(F.nullif(sanitized(c), F.lit("")), F.lit("none"))
    return F.trim(F.concat(filled(name), F.lit(","), filled(description)))


def valid_node_text(text: Column) -> Column:
    """Not empty and not an error or unknown marker."""
    return (
        text.isNotNull() & (text != "") & ~text.startswith("[Error") & ~text.startswith("[Unknown")
    )


def property_list(props: Column) -> Column:
    """``[key: value, …]`` of a property map without the technical keys, '' when nothing is left."""
    shown = F.map_filter(props, lambda k, v: ~k.isin(HIDDEN_PROPERTIES) & v.isNotNull())
    parts = F.transform(F.array_sort(F.map_entries(shown)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    joined = F.array_join(parts, ", ")
    return F.when(F.coalesce(joined, F.lit("")) == "", "").otherwise(F.concat(F.lit("["), joined, F.lit("]")))


def triple_text(head: Column, relation: Column, tail: Column) -> Column:
    """``head relation tail``, null when an end has no usable text."""
    return F.when(
        valid_node_text(head) & valid_node_text(tail), F.concat_ws(" ", head, relation, tail)
    )


def fill_template(template: Column, values: Mapping[str, Column]) -> Column:
    """Replace ``${name}`` by its value; missing or empty values and unknown names give ''."""
    out = template
    for name, value in values.items():
        falsy = value.isNull() | value.cast("string").isin("", "0", "0.0", "false")
        out = F.replace(out, F.lit("${" + name + "}"), F.when(falsy, "").otherwise(value.cast("string")))
    return F.regexp_replace(out, r"\$\{[^}]+\}", "")


_INVISIBLE = "\u200b\u200c\u200d\ufeff"
_OUTER = " \t\n\u000b\f\r"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used.

    A column that is used several times is put in place of each use, so steps that build on one another
    would multiply; the variable of a lambda is not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean_response(text: Column) -> Column:
    """The answer inside a model's output.

    Line ends become newlines and invisible characters go. If the rest stands between two code
    fences, the part between them is the answer, without the line that names the language; a first
    line that says only ``json`` goes too.
    """
    trimmed = lambda c: F.btrim(c, F.lit(_OUTER))
    lines = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n|\r", "\n")
    body = trimmed(F.translate(trimmed(lines), _INVISIBLE, ""))
    fence = F.lit("```")

    def without_language(between: Column) -> Column:
        named = between.contains("\n") & trimmed(F.substring_index(between, "\n", 1)).rlike("^[0-9A-Za-z_]*$")
        return F.when(named, F.substring(between, F.instr(between, "\n") + 1, F.length(between))).otherwise(between)

    def unfenced(body: Column) -> Column:
        fenced = F.startswith(body, fence) & F.endswith(body, fence) & (F.length(body) >= 6)
        return F.when(fenced, bound(F.substring(body, F.lit(4), F.length(body) - 6), without_language)).otherwise(body)

    def without_json(answer: Column) -> Column:
        says_json = (F.lower(F.substring_index(answer, "\n", 1)) == "json") & answer.contains("\n")
        return F.when(says_json, trimmed(F.substring(answer, F.lit(6), F.length(answer)))).otherwise(answer)

    return bound(trimmed(bound(body, unfenced)), without_json)


def decimals(value: Column, pattern: str = "0.00") -> Column:
    """Fixed decimals, rounded on the exact binary value as printf does."""
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))


def byte_size(size: Column) -> Column:
    """Bytes as text with KB, MB, GB from 1024 up."""
    scaled = lambda n, unit: F.concat(decimals(size / n), F.lit(f" {unit}"))
    return (
        F.when(size.isNull() | (size == 0), "0 bytes")
        .when(size >= 1 << 30, scaled(1 << 30, "GB"))
        .when(size >= 1 << 20, scaled(1 << 20, "MB"))
        .when(size >= 1 << 10, scaled(1 << 10, "KB"))
        .otherwise(F.concat(size.cast("string"), F.lit(" bytes")))
    )


def duration_text(us: Column) -> Column:
    """Microseconds as μs, ms or s."""
    return (
        F.when(us < 1000, F.concat(us.cast("long").cast("string"), F.lit("μs")))
        .when(us < 1_000_000, F.concat(decimals(us / 1000), F.lit("ms")))
        .otherwise(F.concat(decimals(us / 1_000_000), F.lit("s")))
    )


def ttl_text(ms: Column) -> Column:
    """Milliseconds to the largest whole unit; 0 means the key never expires."""
    whole = lambda n, unit: F.concat(F.floor(ms / n).cast("string"), F.lit(unit))
    return (
        F.when(ms == 0, "permanent")
        .when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60_000, whole(1000, "s"))
        .when(ms < 3_600_000, whole(60_000, "min"))
        .when(ms < 86_400_000, whole(3_600_000, "h"))
        .otherwise(whole(86_400_000, "d"))
    )


def counters_map(text: Column) -> Column:
    """``a=1,b=2`` as a map of longs; values that are not numbers become null."""
    return F.transform_values(F.str_to_map(text, F.lit(","), F.lit("=")), lambda k, v: v.try_cast("long"))


def capitalized(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))


def camel_key(key: Column, parent: Column) -> Column:
    """Key with its parent as camel-case prefix; no parent leaves the key alone."""
    return F.when(F.coalesce(parent, F.lit("")) == "", key).otherwise(F.concat(parent, capitalized(key)))


def kebab_to_camel(text: Column) -> Column:
    words = F.filter(F.split(text, "-"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(capitalized(w))), "")


def zoned_date(raw: Column, pattern: str = "yyyy-MM-dd", zone: str = "UTC") -> Column:
    """Text to a date text in a zone; text that is no time is returned unchanged."""
    moment = F.try_to_timestamp(raw)
    return F.coalesce(F.date_format(F.from_utc_timestamp(moment, zone), pattern), raw)
