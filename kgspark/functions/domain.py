"""Scores and tables of the domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clamp01, half_up, nospace

# Thermal expansion of materials.
EXPANSION = {"PC": 65, "PC+ABS": 75, "PMMA": 70, "PA6": 80, "FR-4": 16, "EPDM": 160, "실리콘": 250, "고무": 150}
# Words that tell a market.
MARKETS = {
    "북미": ["북미", "미국", "캐나다", "FMVSS", "North"],
    "유럽": ["유럽", "ECE", "R149", "Europe"],
    "한국": ["한국", "KMVSS", "Korea"],
    "중국": ["중국", "GB", "China"],
    "아시아": ["아시아", "Asia", "한국", "KMVSS", "Korea"],
}
# Weights of the confidence and of shape features.
CONFIDENCE = {"sim": 0.4, "evid": 0.15, "sev": 0.3, "master": 0.15}
SHAPE = {"vent": 0.25, "seal": 0.2, "housing": 0.2, "connector": 0.15, "gasket": 0.1, "lens": 0.1}


def confidence(sim: Column, docs: Column, severity: Column, master: Column, boost: Column) -> Column:
    """Struct of the percentage and its five terms; terms shrink together when their sum is above 1."""
    terms = {
        "sim": CONFIDENCE["sim"] * clamp01(sim),
        "evid": CONFIDENCE["evid"] * clamp01(docs / 10),
        "sev": CONFIDENCE["sev"] * clamp01(severity / 10),
        "master": F.when(master, CONFIDENCE["master"]).otherwise(0.0),
        "boost": boost.cast("double"),
    }
    raw = sum(list(terms.values())[1:], list(terms.values())[0])
    scale = F.when(raw > 1, 1 / raw).otherwise(1.0)
    return F.struct(half_up(clamp01(raw) * 100).alias("confidence"), *((t * scale).alias(k) for k, t in terms.items()))


def priority(rpn: Column) -> Column:
    return F.when(rpn >= 125, "high").when(rpn >= 60, "middle").otherwise("low")


def vent(text: Column) -> Column:
    """Count and layout of a vent note such as "2 (up, down)"."""
    note = r"([0-9]+)\s*(?:\(([^)]+)\))?"
    return F.struct(F.regexp_extract(text, note, 1).try_cast("int").alias("count"), F.nullif(F.trim(F.regexp_extract(text, note, 2)), F.lit("")).alias("layout"))


def string_similarity(one: Column, other: Column) -> Column:
    """1 for equal, 0.5 if one holds the other, else 0; null if one is missing."""
    a, b = nospace(F.nullif(one, F.lit(""))), nospace(F.nullif(other, F.lit("")))
    return F.when(a == b, 1.0).when(a.contains(b) | b.contains(a), 0.5).when(a.isNotNull() & b.isNotNull(), 0.0)


def grade_similarity(one: Column, other: Column) -> Column:
    """1 for equal, 0.5 for numbers at most 1 apart, else 0; null if one is missing."""
    number = lambda c: F.regexp_extract(c, "[0-9]+", 0).try_cast("int")
    near = F.abs(number(one) - number(other)) <= 1
    return F.when(one == other, 1.0).when(near, 0.5).when(one.isNotNull() & other.isNotNull(), 0.0)


def expansion(material: Column, table: dict[str, int] = EXPANSION) -> Column:
    """Value of the material with this name, else of the longest name it holds."""
    upper = F.upper(material)
    names = sorted(table, key=lambda k: (-len(k), k))
    exact = F.coalesce(*(F.when(upper == k.upper(), table[k]) for k in names))
    return F.coalesce(exact, *(F.when(upper.contains(k.upper()), table[k]) for k in names))


def market_words(market: Column) -> Column:
    """Words that tell a market, else the market itself; empty for none."""
    chosen = F.coalesce(*(F.when(market.contains(k), F.array(*(F.lit(w) for w in v))) for k, v in MARKETS.items()))
    return F.coalesce(chosen, F.when(F.length(market) > 0, F.array(market)), F.array().cast("array<string>"))


def holds_any(text: Column, words: Column) -> Column:
    return F.exists(words, lambda w: (F.length(w) > 0) & text.contains(w))


def shape_similarity(one: str, other: str) -> Column:
    """Weighted agreement of two feature structs (vent_count, vent_layout, seal, housing, connector, gasket, lens), over the features both have."""
    a, b = (lambda n: F.col(f"{one}.{n}")), (lambda n: F.col(f"{other}.{n}"))
    gap = F.abs(a("vent_count") - b("vent_count"))
    count = F.when(gap == 0, 1.0).when(gap == 1, 0.4).when(gap > 1, 0.0)
    vents = count * 0.6 + F.coalesce(string_similarity(a("vent_layout"), b("vent_layout")), F.lit(0.0)) * 0.4
    parts = {"vent": vents, "connector": grade_similarity(a("connector"), b("connector"))}
    parts |= {n: string_similarity(a(n), b(n)) for n in ("seal", "housing", "gasket", "lens")}
    score = total = F.lit(0.0)
    for name in ("vent", "seal", "housing", "connector", "gasket", "lens"):
        score = score + F.coalesce(parts[name] * SHAPE[name], F.lit(0.0))
        total = total + F.when(parts[name].isNotNull(), SHAPE[name]).otherwise(0.0)
    return F.when(total > 0, F.floor(F.round(score / total * 100 + 0.5, 9)) / 100).otherwise(0.0)


# Conditions on shape and light, and what failures and causes they make more frequent.
MORE_FREQUENT = [("shape", "슬림", "수축|변형"), ("light", "(?i)LED", "방열|발열|열|배광")]


def occurrence_boost(shape: Column, light: Column, failure: Column, cause: Column, rules: list[tuple[str, str, str]] = MORE_FREQUENT) -> Column:
    """One for each rule that a design (shape as an array, light) sets off and a failure mode or its cause meets by label."""
    text = F.concat_ws(" ", F.coalesce(failure, F.lit("")), F.coalesce(cause, F.lit("")))
    on = {"shape": F.concat_ws(" ", shape), "light": F.coalesce(light, F.lit(""))}
    return sum((F.when(on[what].rlike(pattern) & text.rlike(met), 1).otherwise(0) for what, pattern, met in rules), F.lit(0))


def matched_features(one: str, other: str) -> Column:
    """Names of the features in which two feature structs agree wholly, the weightiest first."""
    a, b = (lambda n: F.col(f"{one}.{n}")), (lambda n: F.col(f"{other}.{n}"))
    same = {"vent": a("vent_count") == b("vent_count")}
    same |= {n: (grade_similarity if n == "connector" else string_similarity)(a(n), b(n)) == 1 for n in ("seal", "housing", "connector", "gasket", "lens")}
    return F.array_compact(F.array(*(F.when(cond, name) for name, cond in same.items())))
