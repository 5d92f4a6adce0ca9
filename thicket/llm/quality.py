"""Quality rules as a bitmask ledger, in SQL functions only.

Every rule is measured once per text. The ledger keeps the measurements and one bit per failed rule.
A policy is a version name and the mask of rules that reject; applying it is one bitwise AND, and
policies can be compared, or rules left out, without reading a text again.

Repeated three-word windows are found inside the row: window hashes with the place in their lowest
bits are sorted as plain numbers; only neighbours that agree above those bits are compared by their
whole hashes. No row leaves its place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = "\t\n\u000b\f\r "
SYMBOLS = "#*$%&|<>"
WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """``fails`` is a condition on the measurements; rules divide nothing, so no text is undefined."""

    name: str
    fails: str


#: The order gives the bits and must not change; new rules go to the end.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("many_words", "n_words > 1000000"),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BIT[n] for n in names)


BASE = mask("few_words", "repeated_windows")
#: Versioned policies: which failed rules reject a text.
POLICIES = {
    "base": BASE,
    "v1": BASE | mask("many_symbols", "short_words", "long_words"),
    "v2": BASE | mask("many_symbols", "short_words", "long_words", "repeated_lines", "many_words"),
}


def _windows(words: Column) -> Column:
    """Hash of every window of three words; the separator cannot occur in a word."""
    return F.when(
        F.size(words) >= WINDOW,
        F.zip_with(
            F.zip_with(F.slice(words, 1, F.size(words) - 2), F.slice(words, 2, F.size(words) - 2), lambda a, b: F.concat(a, F.lit(" "), b)),
            F.slice(words, 3, F.size(words) - 2),
            lambda a, b: F.xxhash64(a, b),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _maybe_places(packed: Column, low: Column) -> Column:
    """Places of neighbours that agree in their upper bits, in a sorted array of numbers that carry a place in the lower ones."""
    agree = lambda a, b: a.bitwiseXOR(b).bitwiseAND(F.bitwise_not(low)) == 0
    rest = F.slice(packed, 2, F.size(packed))
    left = F.zip_with(packed, rest, lambda a, b: F.when(agree(a, b), a.bitwiseAND(low).cast("int")))
    right = F.zip_with(packed, rest, lambda a, b: F.when(agree(a, b), b.bitwiseAND(low).cast("int")))
    return F.array_distinct(F.array_compact(F.concat(left, right)))


def _repeated_places(windows: Column, maybe: Column) -> Column:
    """Of the places ``maybe``, those whose window occurs more than once: neighbours in sorted (hash, place) pairs."""
    pairs = F.sort_array(F.transform(maybe, lambda i: F.struct(F.get(windows, i).alias("h"), i.alias("i"))))
    after = F.slice(pairs, 2, F.size(maybe))
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(pairs, 1, F.size(maybe) - 1))
    either = F.zip_with(
        F.zip_with(pairs, before, lambda x, b: F.struct(x["h"].alias("h"), x["i"].alias("i"), F.coalesce(x["h"] == b["h"], F.lit(False)).alias("r"))),
        after,
        lambda x, a: F.when(x["r"] | F.coalesce(x["h"] == a["h"], F.lit(False)), x["i"]),
    )
    return F.array_compact(either)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the measurements: ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines``, ``n_dup_lines``, ``n_repeat_words``.

    Words are runs without blanks (space, tab to carriage return); a null text has none. Lines are
    cut at newlines and count if they hold a word. The columns replace any of the same name.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    out = docs.withColumns({"_words": words, "_lines": lines})
    out = out.withColumn("_windows", _windows(F.col("_words")))
    low = F.expr("shiftleft(1L, cast(ceil(log2(size(_windows) + 2)) AS int)) - 1")
    out = out.withColumn("_low", low)
    packed = F.sort_array(F.transform("_windows", lambda h, i: h.bitwiseAND(F.bitwise_not("_low")).bitwiseOR(i.cast("long"))))
    out = out.withColumn("_packed", packed)
    none = F.array().cast("array<int>")
    out = out.withColumn("_maybe", F.when(F.size("_packed") > 1, _maybe_places(F.col("_packed"), F.col("_low"))).otherwise(none))
    out = out.withColumn("_places", F.when(F.size("_maybe") > 1, _repeated_places(F.col("_windows"), F.col("_maybe"))).otherwise(none))
    reach = F.array_distinct(F.flatten(F.transform("_places", lambda i: F.array(i, i + 1, i + 2))))
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.size(reach).cast("long"),
    })
    return out.drop("_words", "_lines", "_windows", "_low", "_packed", "_maybe", "_places")


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The measurements and ``failed``, one bit per failed rule. All other columns stay."""
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(BIT[rule.name])).otherwise(F.lit(0)).cast("long"))
    out = measure(docs, text_col).withColumn("failed", bits)
    # A generated column stops later filters from being pushed into, and repeating, the measurements.
    rest = [c for c in out.columns if c != "failed"]
    return out.select(*rest, F.explode(F.array("failed")).alias("failed"))


def apply_policy(entries: DataFrame, policy: str = "v1") -> DataFrame:
    """Add ``base_failed`` and ``kept`` under a policy."""
    return entries.withColumns({
        "base_failed": F.col("failed").bitwiseAND(F.lit(BASE)) != 0,
        "kept": F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) == 0,
    })


def ablations(entries: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of a policy: rows that fail it, and rows that only it rejects (kept if it were left out).

    One pass of sums over the bits, then one row per rule.
    """
    rules = [r for r in RULES if BIT[r.name] & POLICIES[policy]]
    rejecting = F.col("failed").bitwiseAND(F.lit(POLICIES[policy]))
    sums = [F.sum((rejecting.bitwiseAND(F.lit(BIT[r.name])) != 0).cast("long")).alias(f"f_{r.name}") for r in rules]
    sums += [F.sum((rejecting == BIT[r.name]).cast("long")).alias(f"o_{r.name}") for r in rules]
    one = entries.agg(F.count(F.lit(1)).alias("n_rows"), F.sum((rejecting == 0).cast("long")).alias("n_kept"), *sums)
    each = [F.struct(F.lit(r.name).alias("rule"), F.col(f"f_{r.name}").alias("n_failed"), F.col(f"o_{r.name}").alias("n_only_this")) for r in rules]
    return one.select("n_rows", "n_kept", F.explode(F.array(*each)).alias("r")).select("r.*", "n_rows", "n_kept")
