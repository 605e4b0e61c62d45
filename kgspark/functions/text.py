"""Column functions on texts: folding, hashing, ids, parsing.  All but ``nfc`` are built-in expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """NFC form; Spark has no built-in for it, so apply it once, when rows come in."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def fold(text: Column) -> Column:
    """Key under which spellings of one name agree: trimmed, lower case, without blanks and joining signs."""
    return F.regexp_replace(F.lower(F.trim(text)), r"[\s·\-_/()]", "")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over code points as eight hex digits."""
    units = F.filter(F.split(text, ""), lambda c: c != "")
    mixed = F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c)) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))
    return F.lower(F.lpad(F.hex(mixed), 8, "0"))


def auto_id(kind: Column, label: Column) -> Column:
    """Id of an object that was created from a text."""
    return F.concat(F.lit("AUTO_"), kind, F.lit("_"), fnv1a(fold(label)))


def entity_id(kind: Column, label: Column) -> Column:
    """Readable ASCII part and eight digits of the hash of type and label."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    digest = F.substring(F.sha1(F.concat_ws("|", kind, label).cast("binary")), 1, 8)
    return F.when(slug == "", digest).otherwise(F.concat_ws("-", slug, digest))


def nospace(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"\s+", "")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def tokens(text: Column, least: int = 2) -> Column:
    """Distinct lower-case tokens of at least ``least`` characters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[\s·\-_/()]+"), lambda t: F.length(t) >= least))


def is_subset(small: Column, big: Column) -> Column:
    return (F.size(small) > 0) & (F.size(F.array_except(small, big)) == 0)


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def starts_as_number(text: Column) -> Column:
    """Whether a lenient parser would read a number at the start."""
    return F.coalesce(text.rlike(r"^\s*[+-]?[.]?[0-9]"), F.lit(False))


def is_decimal(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^-?[0-9]+([.][0-9]+)?$"), F.lit(False))


def ellipsis(text: Column, most: int = 120) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def stripped_html(html: Column) -> Column:
    """Tags to blanks, four entities, blanks collapsed."""
    text = F.regexp_replace(html, "<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.regexp_replace(text, name, sign)
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def field(text: Column, names: str) -> Column:
    """First item of the value of a "key: value" line; ``names`` is a pattern of keys."""
    value = F.regexp_extract(text, rf"(?m)^\s*(?:{names})\s*:\s*(.+)$", 1)
    return F.nullif(F.trim(F.split(value, "[,·/]")[0]), F.lit(""))


def outer_json(text: Column) -> Column:
    """What stands between the outermost braces of an answer, thoughts taken out."""
    plain = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return F.nullif(F.regexp_extract(plain, r"(?s)\{.*\}", 0), F.lit(""))


def cosine_distance(one: Column, other: Column) -> Column:
    """1 minus the cosine; null for vectors of unlike size or without length."""
    dot = F.aggregate(F.zip_with(one, other, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    length = norm(one) * norm(other)
    return F.when((F.size(one) == F.size(other)) & (length > 0), 1 - dot / length)


def edge_weight(weight: Column, rel: Column) -> Column:
    """The weight, else the first number in the relation's name."""
    return F.coalesce(weight, F.regexp_extract(rel, r"([0-9]*[.]?[0-9]+)", 1).try_cast("double"))


def hop(src: Column, rel: Column, dst: Column) -> Column:
    return F.concat_ws("→", src, rel, dst)


def slug(name: Column, empty: str = "canvas") -> Column:
    """Letters and digits of any script in lower case, all else as single hyphens between them."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit(empty))


def prefixed(text: Column, kind: str = "passage") -> Column:
    """Text with the prefix that asymmetric embedding models want: ``passage`` for what is searched, ``query`` for questions."""
    return F.concat(F.lit(f"{kind}: "), text)
