"""Labels and split names as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.errors import RefusedInput

# Texts that stand for a missing label, once trimmed and in lower case.
MISSING = ["nan", "<na>", "null", "na", "n/a"]
# Labels that tell a state of assessment, not a class.
RESERVED = ["unknown", "not_assessed", "unassessed", "synthetic", "synthetic_smoke_only"]
# Split names that need a confirmation before they are read.
GUARDED = ["test", "tests", "testing", "officialtest", "testset", "testdata", "finaltest", "holdout", "holdouts", "holdoutset"]
# Split names that say what their rows are.
TEST_LIKE = ["test", "tests", "testing", "officialtest", "testset", "holdout", "holdouts", "holdoutset"]
TRAIN_LIKE = ["train", "training", "fit", "validation", "valid", "val", "dev"]
# Texts that a CSV reader with default settings takes for missing.
CSV_MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

_BLANKS = r"(?U)^\s+|(?U)\s+$"


def strip(value: Column) -> Column:
    """Without white space of any script around it."""
    return F.regexp_replace(value, _BLANKS, "")


def csv_value(value: Column) -> Column:
    return F.when(~value.isin(CSV_MISSING), value)


def raw_label(value: Column) -> Column:
    """The label as it is stored, white space included; null where it is missing. White space alone is a label."""
    text = value.cast("string")
    return F.when(text.isNotNull() & (text != "") & ~F.lower(strip(text)).isin(MISSING), text)


def normaliser(name: str) -> Callable[[Column], Column]:
    """The label adapter `none` or `strip`."""
    if name == "none":
        return lambda c: c
    if name == "strip":
        return strip
    raise RefusedInput(f"unknown label adapter {name!r}; there are 'none' and 'strip'")


def is_reserved(label: Column) -> Column:
    return F.lower(label).isin(RESERVED)


def split_name(value: Column) -> Column:
    """Lower case, letters and digits of any script."""
    return F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]", "")


def ascii_split_name(value: Column) -> Column:
    """Without white space around, lower case, ASCII letters and digits: it differs from split_name for other scripts."""
    return F.regexp_replace(F.lower(strip(value)), "[^a-z0-9]", "")


def is_guarded(value: Column) -> Column:
    return split_name(value).isin(GUARDED)


def problem(label: Column, key_known: Column, side: str) -> Column:
    """Why a label can't be scored; null if it can. Reserved tokens count as such even if they are declared classes."""
    return (
        F.when(label.isNull(), F.lit(f"missing {side} label"))
        .when(is_reserved(label), F.concat(F.lit(f"reserved {side} token '"), label, F.lit("'")))
        .when(~key_known, F.concat(F.lit(f"{side} label '"), label, F.lit("' outside the declared class list")))
    )


def display(value: Column) -> Column:
    """An empty value as `not assessed`."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("not assessed"))


def html_escaped(value: Column) -> Column:
    """A text for HTML: the five characters that mean something there as references."""
    out = F.replace(value, F.lit("&"), F.lit("&amp;"))
    for mark, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def title(value: Column) -> Column:
    """An attribute's name for people: `body_type` as `Body Type`."""
    return F.initcap(F.translate(value, "_", " "))
