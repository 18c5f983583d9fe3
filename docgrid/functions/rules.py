"""Rule lists compiled to column expressions: tag rules, substitutions, list splitting, regex-keyed look-ups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAGS = ("u", "i", "b", "sub", "sup", "br", "p")
SPLITTERS = r" |,|/|<br>"


def replaced(text: Column, **subs: str) -> Column:
    """Apply tag rules first, in fixed order, then all others as regex substitutions, in the order given.

    A tag's rule `*` (the default) strips its tags; any other value replaces what `<t>...</t>` encloses, tags included,
    by that value, in which `$1` is what they enclosed.
    """
    rules = dict.fromkeys(TAGS, "*") | {k: v for k, v in subs.items() if k in TAGS}
    for tag, rule in rules.items():
        text = F.regexp_replace(text, f"</?{tag}>", "") if rule == "*" else F.regexp_replace(text, f"<{tag}>(.*?)</{tag}>", rule)
    for pattern, value in subs.items():
        if pattern not in TAGS:
            text = F.regexp_replace(text, pattern, value)
    return text


def listify(text: Column, pattern: str = SPLITTERS) -> Column:
    """Split, trim, and drop empty parts."""
    return F.filter(F.transform(F.split(text, pattern), lambda x: F.trim(x)), lambda x: x != "")


def contextual(text: Column, context: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Rules (context pattern, pattern, replacement), each applied only where its context pattern is found."""
    for where, pattern, value in rules:
        text = F.when(context.rlike(where), F.regexp_replace(text, pattern, value)).otherwise(text)
    return text


def renumbered(text: Column, pattern: str, number) -> Column:
    """Replace a number (group 2 of prefix, number, suffix) by number(value), where the pattern is found."""
    part = lambda k: F.regexp_extract(text, pattern, k)
    return F.when(text.rlike(pattern), F.concat(part(1), number(part(2).cast("bigint")).cast("string"), part(3))).otherwise(text)


def fan_out(text: Column, prefix: str) -> Column:
    """Array of names: `prefix` followed by several digits stands for one name a digit; other names for themselves."""
    digits = F.regexp_extract(text, f"^{prefix}(\\d{{2,}})$", 1)
    return F.when(digits != "", F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: F.concat(F.lit(prefix), c))).otherwise(F.array(text))


def match_values(map_col: Column, pattern: str) -> Column:
    """All values of a map whose keys match the pattern, ordered by key."""
    kept = F.map_filter(map_col, lambda k, _: k.rlike(f"(?i){pattern}"))
    return F.transform(F.array_sort(F.map_entries(kept)), lambda e: e["value"])


def match_value(map_col: Column, pattern: str, default: Column | None = None) -> Column:
    """The only value whose key matches; the default if none does; an error if several do."""
    found = match_values(map_col, pattern)
    several = F.raise_error(F.concat(F.lit(f"several keys match {pattern}: "), F.array_join(F.array_sort(F.map_keys(map_col)), ", ")))
    return F.when(F.size(found) > 1, several.cast("string")).when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise(F.lit(None) if default is None else default)


def match_key(map_col: Column, pattern: str, default: Column | None = None) -> Column:
    """The only key that matches; without a default, anything but one match is an error."""
    keys = F.filter(F.map_keys(map_col), lambda k: k.rlike(f"(?i){pattern}"))
    other = F.raise_error(F.lit(f"not exactly one key matches {pattern}")).cast("string") if default is None else default
    return F.when(F.size(keys) == 1, F.get(keys, F.lit(0))).otherwise(other)


def wildcard_regex(name: Column) -> Column:
    """A name with wildcards as a lower-case regex: `x` is any character, `+` one of the option letters s, r, q, p."""
    return F.replace(F.replace(F.lower(name), F.lit("x"), F.lit(".")), F.lit("+"), F.lit("[srqp]"))


def suffix_expanded(text: Column) -> Column:
    """`ABC12/34/56` -> [ABC12, ABC34, ABC56]: later parts replace as many last characters of the first."""
    parts = F.split(text, "/")
    base = F.get(parts, F.lit(0))
    return F.transform(parts, lambda p, i: F.when(i == 0, base).otherwise(F.concat(F.substring(base, F.lit(1), F.greatest(F.length(base) - F.length(p), F.lit(0))), p)))


def slug(text: Column) -> Column:
    """Lower-case ASCII letters and digits, joined by single underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def filters_pass(filters: Column, key: str, value: Column) -> Column:
    """No patterns under the key: true; otherwise any of them is found in value, ignoring case."""
    own = F.element_at(filters, F.lit(key))
    return own.isNull() | F.exists(F.coalesce(own, F.array().cast("array<string>")), lambda p: F.regexp_like(value, F.concat(F.lit("(?i)"), p)))


def contains_each_other(names: Column) -> Column:
    """No conflict among names: one of them is part of all the others."""
    return F.exists(names, lambda n: F.forall(names, lambda m: F.contains(m, n)))


def agreeing(a: Column, b: Column) -> Column:
    """Names agree if one holds the other, or all tokens of one are tokens of the other."""
    ta, tb = F.split(a, "_"), F.split(b, "_")
    return F.contains(a, b) | F.contains(b, a) | (F.size(F.array_except(ta, tb)) == 0) | (F.size(F.array_except(tb, ta)) == 0)
