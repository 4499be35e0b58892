"""Column expressions that the operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing_as_null(c: Column | str) -> Column:
    """Null for a null or an empty string: both count as missing context."""
    return F.nullif(col(c), F.lit(""))


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product in double precision, in the arrays' order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column | str) -> Column:
    """The vector divided by its length; lengths below 1e-9 count as 1e-9."""
    length = F.greatest(norm(a), F.lit(1e-9))
    return F.transform(a, lambda x: x.cast("double") / length)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-9)) * F.greatest(norm(b), F.lit(1e-9)))


def calibrated(p: Column | str, has_actor: Column, has_location: Column) -> Column:
    """0.6 of the model's confidence (0.7 if null) and 0.4 of completeness: 1, less 0.2 without an actor, less 0.1 without a place."""
    complete = F.lit(1.0) - F.when(has_actor, 0.0).otherwise(0.2) - F.when(has_location, 0.0).otherwise(0.1)
    return F.round(0.6 * F.coalesce(col(p).cast("double"), F.lit(0.7)) + 0.4 * complete, 4)


def truncate_safe(c: Column | str, n: int) -> Column:
    """The first n characters; a run of backslashes that the cut leaves at the end goes."""
    c = col(c)
    return F.when(F.char_length(c) > n, F.regexp_replace(F.left(c, F.lit(n)), r"\\+$", "")).otherwise(c)


def sanitized(name: Column | str) -> Column:
    """Part of a canonical id: lower case, `_` for spaces, without quotes, colons and backslashes; empty: `unknown`."""
    name = col(name)
    clean = F.translate(F.replace(F.lower(name), F.lit(" "), F.lit("_")), "\"':\\", "")
    return F.when(F.coalesce(name, F.lit("")) == "", "unknown").otherwise(clean)


def canonical_uid(kind: Column | str, name: Column | str) -> Column:
    """agent_<name> for actors and patients, <kind>_<name> for others; reasons are cut to 30 characters at last."""
    kind, name = col(kind), sanitized(name)
    return F.when(kind.isin("actor", "patient"), F.concat(F.lit("agent_"), name)).when(kind == "whyfactor", F.concat(F.lit("whyfactor_"), F.left(name, F.lit(30)))).otherwise(F.concat(kind, F.lit("_"), name))


def natural_id(prefix: str, *parts: Column | str) -> Column:
    """A reproducible id: 16 hex digits of the SHA-256 of the parts."""
    return F.concat(F.lit(f"{prefix}/"), F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(col(p).cast("string"), F.lit("")) for p in parts)), 256), 1, 16))


def cache_key(model: str, *content: Column | str) -> Column:
    """Key of a model's answer: the whole content counts."""
    return F.sha2(F.concat_ws("::", F.lit(model), *(F.coalesce(col(c).cast("string"), F.lit("")) for c in content)), 256)


def theory(c: Column | str) -> Column:
    """@McKee or @Truby whatever the case and the `@`; other names as they are."""
    c = col(c)
    bare, out = F.lower(F.replace(c, F.lit("@"), F.lit(""))), c
    for t in V.THEORIES:
        out = F.when(bare == t[1:].lower(), t).otherwise(out)
    return out


def normalized_weights(weights: Column | str) -> Column:
    """Array of doubles as shares of their sum, 3 digits; equal shares where the sum is 0 or less; nulls are dropped."""
    w = F.filter(weights, lambda x: x.isNotNull())
    total = F.aggregate(w, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.transform(w, lambda x: F.when(total > 0, F.round(x.cast("double") / total, 3)).otherwise(F.round(1.0 / F.size(w), 3)))


def in_list(c: Column, values: tuple[str, ...]) -> Column:
    return c.isin(*values)


def is_character(name: Column | str, legacy_prefix: bool = False) -> Column:
    """A name that can stand for a character: two characters or more, no pronoun or generic word, also after an article.

    Names that begin with a pronoun and a word boundary ("his sister") are none. legacy_prefix drops the boundary, and
    with it names such as Herbert. Null is no name.
    """
    x = F.btrim(F.lower(col(name)))
    after = F.regexp_replace(x, r"^(the|a|an) ", "")
    pronoun = "^(" + "|".join(V.PRONOUNS) + ")" + ("" if legacy_prefix else r"\b")
    bad = (F.char_length(x) < 2) | in_list(x, V.GENERIC_NAMES) | x.rlike(pronoun) | (x.rlike("^(the|a|an) ") & in_list(after, V.GENERIC_NAMES))
    return F.coalesce(~bad, F.lit(False))


def normalized_name(name: Column | str) -> Column:
    """The name without parentheses, leading age words and one leading title, unless that is all there is."""
    x = F.regexp_replace(col(name), r"\s*\([^)]*\)", "")
    for word in V.AGE_WORDS:
        x = F.when(x.startswith(word + " "), F.btrim(F.substr(x, F.lit(len(word) + 1)))).otherwise(x)
    words = F.filter(F.split(x, r"\s+"), lambda w: w != "")
    titled = (F.size(words) > 1) & in_list(F.get(words, F.lit(0)), V.TITLES)
    return F.btrim(F.when(titled, F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), " ")).otherwise(x))


def needs_backticks(c: Column | str) -> Column:
    """An identifier that Cypher takes in backticks only: empty, reserved, with special characters, or a leading digit."""
    c = col(c)
    special = "[" + re.escape(V.CYPHER_SPECIAL).replace("&", r"\&") + "]"
    return (c == "") | in_list(F.lower(c), V.CYPHER_RESERVED) | c.rlike(special) | c.rlike(r"^\d")


def cypher_name(c: Column | str) -> Column:
    c = col(c)
    return F.when(needs_backticks(c), F.concat(F.lit("`"), F.replace(c, F.lit("`"), F.lit("``")), F.lit("`"))).otherwise(c)


def cypher_value(c: Column | str, kind: str = "string") -> Column:
    """A literal: kind is string, number, boolean or array (of strings); null for null."""
    c = col(c)
    if kind == "array":
        out = F.concat(F.lit("["), F.array_join(F.transform(c, cypher_value), ", "), F.lit("]"))
    elif kind in ("number", "boolean"):
        out = c.cast("string")
    else:
        s = c.cast("string")
        for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            s = F.replace(s, F.lit(a), F.lit(b))
        out = F.concat(F.lit('"'), s, F.lit('"'))
    return F.coalesce(out, F.lit("null"))


def cypher_properties(props: dict[str, tuple[Column, str]]) -> Column:
    """{name: value, ...} of (column, kind) by name; nulls are left out."""
    parts = []
    for name, (c, kind) in props.items():
        bare = name.lower() not in V.CYPHER_RESERVED and re.fullmatch(r"[^\d\W]\w*", name)
        parts.append(F.when(c.isNotNull(), F.concat(F.lit(name if bare else "`" + name.replace("`", "``") + "`"), F.lit(": "), cypher_value(c, kind))))
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def supertype(relation: Column | str) -> Column:
    """The broad type of a fine relation, null if unknown; case doesn't count."""
    up, out = F.upper(col(relation)), F.lit(None).cast("string")
    for broad, fine in V.SUPERTYPES.items():
        out = F.when(in_list(up, fine), broad).otherwise(out)
    return out
