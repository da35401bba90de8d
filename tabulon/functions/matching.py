"""Matching of noisy labels through aliases, as column expressions."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Other spellings of makes, body types and colours.
MAKES = {
    "vw": "volkswagen", "mercedes": "mercedesbenz", "chevy": "chevrolet",
    "bwm": "bmw", "benz": "mercedesbenz", "buck": "buick", "chrey": "chery", "lamorghini": "lamborghini",
    "yiqi": "faw", "riich": "ruiqi", "jac": "jianghuai", "ssangyong": "shuanglong", "zotye": "zoyte", "maxus": "shangqidatong", "saicmaxus": "shangqidatong",
    "trumpchi": "guangqichuanqi", "gactrumpchi": "guangqichuanqi", "bestune": "besturn", "fawbesturn": "besturn", "dongfengvenucia": "venucia", "greatwallmotors": "greatwall",
    "minicooper": "mini", "dsautomobiles": "ds",
}
BODIES = {
    "wagon": "estate", "stationwagon": "estate", "hatch": "hatchback", "pickuptruck": "pickup", "ute": "pickup",
    "minivan": "mpv", "sportscar": "sports", "cabriolet": "convertible", "roadster": "convertible",
}
COLOURS = {
    "gray": "silver", "grey": "silver", "gold": "champagne", "beige": "champagne", "tan": "champagne",
    "cream": "champagne", "maroon": "red", "burgundy": "red", "navy": "blue",
}
# Body types that end a model's name.
BODY_SUFFIXES = ["hatchback", "sedan", "suv", "coupe", "estate", "convertible", "mpv", "pickup", "fastback", "sports", "crossover", "minibus", "wagon"]
BODY_WORDS = ["hatchback", "sedan", "suv", "coupe", "couple", "estate", "convertible", "mpv", "pickup", "fastback", "sports", "crossover", "minibus", "wagon"]
# Spellings of makes that are put right.
MAKE_FIXES = {"BWM": "BMW", "Benz": "Mercedes-Benz", "Buck": "Buick", "Chrey": "Chery", "Lamorghini": "Lamborghini"}


def ascii_key(value: Column) -> Column:
    """Lower-case ASCII letters and digits; null if none is left. For texts without accents equal to folded_key."""
    return F.nullif(F.regexp_replace(F.lower(value.cast("string")), "[^a-z0-9]+", ""), F.lit(""))


@functools.cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """Characters beyond ASCII whose compatibility decomposition has one ASCII letter or digit, these, and those with several."""
    one, to, several = [], [], {}
    for code in range(128, sys.maxunicode + 1):
        if not unicodedata.decomposition(chr(code)):
            continue
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        kept = "".join(c for c in plain if c.isalnum())
        if len(kept) == 1:
            one.append(chr(code))
            to.append(kept)
        elif kept:
            several[chr(code)] = kept
    return "".join(one), "".join(to), several


def _classes(chars: Iterable[str]) -> tuple[str, str]:
    """Patterns of one of these characters and of one other: ranges, as patterns test the members of a class one after another; the first is told at once of what is below all of them."""
    within, without, at = [], [], 0
    for c in sorted(map(ord, chars)):
        if within and c == at:
            within[-1][1] = c
        else:
            within.append([c, c])
            without.append([at, c - 1])
        at = c + 1
    told = ["".join(f"\\x{{{x:x}}}-\\x{{{y:x}}}" for x, y in ranges) for ranges in (within, [*without, [at, sys.maxunicode]])]
    return f"[[^\\x00-\\x{{{within[0][0] - 1:x}}}]&&[{told[0]}]]", f"[{told[1]}]"


def folded_key(value: Column) -> Column:
    """As ascii_key, after accents and other forms of ASCII letters and digits became these (NFKD). Only texts with other characters are folded."""
    one, to, several = _folds()
    text, (wide, other) = value.cast("string"), _classes(several)
    names = F.map_from_arrays(*[F.split(F.lit(" ".join(x)), " ") for x in (several, several.values())])  # a constant
    pieces = F.regexp_extract_all(text, F.lit(f"{wide}|{other}+"), F.lit(0))  # these characters, and what lies between them
    spread = F.array_join(F.transform(pieces, lambda c: F.coalesce(F.try_element_at(names, c), c)), "")
    whole = F.when(text.rlike(wide), spread).otherwise(text)
    return ascii_key(F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(whole, one, to)).otherwise(text))  # inside of the branches a key's steps would be taken twice


def alias(value: Column, names: dict[str, str]) -> Column:
    """The name that `names` has for a value, else the value."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, value), value)


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def make_matches(truth: Column, said: Column, key=folded_key) -> Column:
    return _true(alias(key(truth), MAKES) == alias(key(said), MAKES))


def body_matches(truth: Column, said: Column, key=folded_key) -> Column:
    return _true(alias(key(truth), BODIES) == alias(key(said), BODIES))


def colour_matches(truth: Column, said: Column) -> Column:
    """Whether the true colour is among the words of what was said, by aliases."""
    names = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])
    words = F.transform(F.regexp_extract_all(F.lower(said), F.lit("([a-z]+)"), 1), lambda w: F.coalesce(F.try_element_at(names, w), w))
    return _true(folded_key(truth).isNotNull() & F.array_contains(words, alias(F.trim(F.lower(truth)), COLOURS)))


def _without_suffix(key: Column) -> Column:
    """A key without the body type at its end, if something is left; none ends another, so one applies at most."""
    return F.regexp_replace(key, f"(?<=.)({'|'.join(BODY_SUFFIXES)})$", "")


def model_matches(truth: Column, said: Column, make: Column | None = None, key=folded_key) -> Column:
    """Equal names, or equal once the make before and one body type after the true name are gone."""
    g, p = key(truth), key(said)
    short = g
    if make is not None:
        m = key(make)
        # nothing may be left after the make; that is no name
        short = F.when(m.isNotNull() & g.startswith(m), g.substr(F.length(m) + 1, F.length(g))).otherwise(g)
    return _true(p.isNotNull() & ((g == p) | (_without_suffix(short) == p)))


MATCHERS = {"make": make_matches, "model": model_matches, "body_type": body_matches, "colour": colour_matches}


def clean_make(value: Column) -> Column:
    return alias(F.trim(value), MAKE_FIXES)


def clean_model(model: Column, make: Column) -> Column:
    """A model's name without the make before it and one body type after it, unless nothing would be left."""
    name, prefix = F.trim(model), F.trim(make)
    rest = F.regexp_replace(name.substr(F.length(prefix) + 1, F.length(name)), "^[ -]+|[ -]+$", "")
    named = F.when((prefix != "") & F.lower(name).startswith(F.lower(prefix)) & (rest != ""), rest).otherwise(name)
    words = F.filter(F.split(named, r"\s+"), lambda w: w != "")
    last = F.lower(F.element_at(words, -1))
    return F.when((F.size(words) > 1) & last.isin(BODY_WORDS), F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")).otherwise(named)
