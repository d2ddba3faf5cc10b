"""Names, codes and keys: normalisers as column expressions, and one similarity that has none."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations of station names, and the words that name no station.
ABBREVIATIONS = {
    "ПАСС": "ПАССАЖИРСКИЙ",
    "ГЛ": "ГЛАВНЫЙ",
    "СОРТ": "СОРТИРОВОЧНЫЙ",
    "ЮЖ": "ЮЖНЫЙ",
    "СЕВ": "СЕВЕРНЫЙ",
    "ЗАП": "ЗАПАДНЫЙ",
    "ВОСТ": "ВОСТОЧНЫЙ",
}
GENERIC_WORDS = ["СТ", "СТАНЦИЯ", "ОП", "ОСТАНОВОЧНЫЙ", "ПУНКТ", "ПЛАТФОРМА", "РАЗЪЕЗД"]
TIMETABLE_DROPS = ["СТАНЦИЯ", "СТ", "ПАССАЖИРСКАЯ", "ПАСС", "ВОКЗАЛ", "ОСТАНОВОЧНЫЙ", "ПУНКТ", "ОСТ", "ПЛАТФОРМА"]
NULL_WORDS = ["значение_отсутствует", "нет", "nan", "none", "null"]
ADMIN_MARKERS = ["округ", "район", "внутригород", "муниципальный_округ", "административный_округ"]


def blank_to_null(c: Column) -> Column:
    """STR14, STR23."""
    return F.nullif(F.trim(c), F.lit(""))


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def station_name(c: Column) -> Column:
    """Upper case, dashes and signs to spaces, runs of spaces to one (STR1)."""
    upper = F.translate(F.upper(F.coalesce(c, F.lit(""))), "Ё-—–", "Е   ")
    return _squeeze(F.regexp_replace(upper, r"[^\p{L}\p{N}_\s]+", " "))


def canonical_tokens(c: Column) -> Column:
    """Abbreviations spelled out, generic words dropped (STR2)."""
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    tokens = F.transform(F.split(station_name(c), " "), lambda t: F.coalesce(F.try_element_at(table, t), t))
    return F.filter(tokens, lambda t: (t != "") & ~t.isin(GENERIC_WORDS))


def canonical_name(c: Column) -> Column:
    return F.array_join(canonical_tokens(c), " ")


def import_name(c: Column) -> Column:
    """STR7."""
    return F.regexp_replace(F.translate(F.upper(F.trim(c)), "Ё", "Е"), "[^A-ZА-Я0-9]", "")


def import_name_quirk(c: Column) -> Column:
    """The database form of ``import_name``: lower-case letters vanish, as signs are stripped before upper-casing (STR8)."""
    return F.upper(F.regexp_replace(F.translate(F.trim(c), "Ёё", "Ее"), "[^A-ZА-Я0-9]", ""))


def timetable_name(c: Column) -> Column:
    """Nine substrings become spaces, wherever they stand (STR9)."""
    text = F.translate(F.upper(F.coalesce(c, F.lit(""))), "Ё-—–", "Е   ")
    for word in TIMETABLE_DROPS:
        text = F.replace(text, F.lit(word), F.lit(" "))
    return _squeeze(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]+", " "))


def simple_name_score(a: Column, b: Column) -> Column:
    """Shared words over all words, with a bonus when one name holds the other (STR10)."""
    x, y = timetable_name(a), timetable_name(b)
    s, t = F.array_distinct(F.split(x, " ")), F.array_distinct(F.split(y, " "))
    score = F.size(F.array_intersect(s, t)) / F.size(F.array_union(s, t)) + F.when(x.contains(y) | y.contains(x), 0.25).otherwise(0.0)
    return F.when((x == "") | (y == ""), F.lit(0.0)).when(x == y, F.lit(1.0)).otherwise(F.least(F.lit(1.0), score))


def clean_text(c: Column) -> Column:
    """STR11."""
    return _squeeze(F.translate(F.coalesce(c.cast("string"), F.lit("")), "ёЁ ", "еЕ "))


def slug(c: Column) -> Column:
    """STR12."""
    text = F.regexp_replace(F.replace(F.lower(clean_text(c)), F.lit("-"), F.lit("_")), "[^0-9a-zа-я_]+", "_")
    return F.regexp_replace(F.regexp_replace(text, "_+", "_"), "^_|_$", "")


def optional(c: Column) -> Column:
    """STR13."""
    text = clean_text(c)
    return F.when((text == "") | slug(c).isin(NULL_WORDS), F.lit(None)).otherwise(text)


def administrative(c: Column) -> Column:
    """STR15."""
    return F.coalesce(slug(c).rlike("|".join(ADMIN_MARKERS)), F.lit(False))


def city_of(c: Column) -> Column:
    """"... город X" to "г. X" (STR16)."""
    found = F.regexp_extract(clean_text(c), "(?iu)город +(.+)$", 1)
    return F.when(found != "", F.concat(F.lit("г. "), F.trim(found)))


def canonical_place(name: Column, down: Column, up: Column) -> Column:
    """STR17: the name, unless it names an administrative part; then what the municipality gives."""
    name, down, up = optional(name), optional(down), optional(up)
    plain = lambda c: F.when(c.isNotNull() & ~administrative(c), c)
    return F.coalesce(plain(name), plain(down), city_of(down), city_of(up), plain(up), name)


def external_route_id(given: Column, train: Column, date: Column, name: Column) -> Column:
    """STR20."""
    train, date, name = blank_to_null(train), blank_to_null(date.cast("string")), blank_to_null(name)
    return F.coalesce(blank_to_null(given), F.when(train.isNotNull() & date.isNotNull(), F.concat_ws(":", train, date)), F.when(train.isNotNull() & name.isNotNull(), F.concat_ws(":", train, name)))


def route_label(name: Column, code: Column) -> Column:
    """A stop that is a label: no code, and brackets, a comma or a dash between names (FLT24)."""
    n = F.trim(F.coalesce(name, F.lit("")))
    return blank_to_null(code).isNull() & (n.startswith("[") | n.endswith("]") | n.contains(",") | n.contains(" - "))


# Similarity (STR3-STR6): the longest matching blocks of two strings have no built-in.


def fits(raw: str, other: str) -> bool:
    """Whether one word abbreviates the other (STR4)."""
    if raw == other or len(raw) == 1 and other.startswith(raw):
        return bool(raw)
    return len(raw) >= 3 and other.startswith(raw) or len(other) >= 3 and raw.startswith(other)


def covered(words: list[str], others: list[str], match) -> float:
    """The share of words that find a free partner, each the first one free (STR5)."""
    free = list(others)
    hits = 0
    for w in words:
        k = next((k for k, o in enumerate(free) if match(w, o)), None)
        if k is not None:
            hits += 1
            del free[k]
    return hits / len(words) if words and others else 0.0


def similarity(a: str, b: str) -> float:
    """Of canonical names (STR6)."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    x, y = a.split(), b.split()
    score = 0.45 * SequenceMatcher(None, a, b).ratio() + 0.35 * covered(x, y, fits) + 0.20 * covered(y, x, lambda o, r: fits(r, o))
    return max(0.0, min(1.0, score + (0.10 if fits(x[0], y[0]) else 0.0)))


def _similarities(a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a.fillna(""), b.fillna(""), strict=True):
        if pair not in seen:
            seen[pair] = similarity(*pair)
        out.append(seen[pair])
    return pd.Series(out, dtype="float64")


def canonical_similarity(a: Column, b: Column) -> Column:
    """Of names that are canonical already."""
    return F.pandas_udf(_similarities, "double")(a, b)


def name_similarity(a: Column, b: Column) -> Column:
    return canonical_similarity(canonical_name(a), canonical_name(b))
