"""Column expressions over text: code maps, reason text, search and figures in prose."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from tidewatch.functions.numbers import col

MISSING = "missing"
UNRECOGNIZED = "other_unrecognized"

# Inclusive whole-number code ranges and the chapter each belongs to.
CODE_CHAPTERS: tuple[tuple[int, int, str], ...] = (
    (1, 139, "infectious_parasitic"),
    (140, 239, "neoplasms"),
    (240, 249, "endocrine_metabolic_other"),
    (251, 279, "endocrine_metabolic_other"),
    (280, 289, "blood"),
    (290, 319, "mental"),
    (320, 389, "nervous_sense_organs"),
    (390, 459, "circulatory"),
    (460, 519, "respiratory"),
    (520, 579, "digestive"),
    (580, 629, "genitourinary"),
    (630, 679, "pregnancy_childbirth"),
    (680, 709, "skin"),
    (710, 739, "musculoskeletal"),
    (740, 759, "congenital_anomalies"),
    (760, 779, "perinatal"),
    (780, 799, "symptoms_ill_defined"),
    (800, 999, "injury_poisoning"),
)

# Admission source codes and their risk groups.
SOURCE_GROUPS: dict[int, str] = {
    1: "referral", 2: "referral", 3: "referral",
    7: "emergency",
    4: "transfer", 5: "transfer", 6: "transfer", 10: "transfer", 22: "transfer", 25: "transfer", 26: "transfer",
    11: "delivery_birth", 12: "delivery_birth", 13: "delivery_birth", 14: "delivery_birth",
    23: "delivery_birth", 24: "delivery_birth",
    8: "legal_other",
}

# Fixed pattern: a quantity in prose, not part of a word, identifier, date or version.
FIGURE_PATTERN = r"(?U)(?<![\w\-.])(-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?)(?![\w\-]|\.\d)"
# Fixed pattern: an ISO calendar date in prose.
DATE_PATTERN = r"(?U)(?<![\w\-])(\d{4}-\d{2}-\d{2})(?![\w\-])"
# Fixed pattern: the date at the front of a stored timestamp or alone.
STORED_DATE_PATTERN = r"(?U)(?<![\w\-])(\d{4}-\d{2}-\d{2})(?:T|(?![\w\-]))"
# Fixed pattern: a card or run id inside a log reason.
SUBJECT_PATTERN = r"((?:dc|rr)-[0-9]{4}-[0-9]{2}-[0-9]{2}(?:-[0-9a-f]{8})+)"


def code_chapter(
    code: Column | str,
    chapters: Sequence[tuple[int, int, str]] = CODE_CHAPTERS,
    carve_out: tuple[float, float, str] = (250.0, 251.0, "diabetes"),
) -> Column:
    """Chapter of a diagnosis code kept as text; fractions between ranges stay unrecognized."""
    raw = F.trim(col(code).cast("string"))
    number = raw.try_cast("double")
    low, high, carved = carve_out
    out = F.when(raw.isNull() | (raw == ""), F.lit(MISSING))
    out = out.when(F.upper(raw).startswith("V"), F.lit("supplementary_v"))
    out = out.when(F.upper(raw).startswith("E"), F.lit("external_causes_e"))
    out = out.when(number.isNull() | F.isnan(number), F.lit(UNRECOGNIZED))
    out = out.when((number >= low) & (number < high), F.lit(carved))
    for first, last, name in chapters:
        out = out.when(number.between(first, last), F.lit(name))
    return out.otherwise(F.lit(UNRECOGNIZED))


def map_or_default(code: Column | str, groups: Mapping, default: str = "other") -> Column:
    pairs = [F.lit(x) for pair in groups.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(code)), F.lit(default))


def squeeze(text: Column | str) -> Column:
    """Trims and turns each run of whitespace into one blank."""
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def metric_name(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"[^A-Za-z0-9_.\-]", "_")


def contains_all_fields(query: str, *fields: Column) -> Column:
    """Case-insensitive search over the joined fields; an empty query matches every row."""
    needle = query.strip().lower()
    if not needle:
        return F.lit(True)
    shown = [F.coalesce(f.cast("string"), F.lit("None")) for f in fields]
    return F.lower(F.concat_ws(" ", *shown)).contains(needle)


def fixed(value: Column | str, places: int) -> Column:
    """The number to so many places, rounding its exact binary value half to even.

    ``format_string`` rounds the shortest decimal form half up instead, which differs on
    numbers such as 0.50615.
    """
    return F.call_function("format_number", col(value).cast("double"), F.lit("0." + "0" * places))


def four_places(value: Column | str) -> Column:
    return F.coalesce(fixed(value, 4), F.lit("n/a"))


def figures(text: Column | str) -> Column:
    """Every quantity written in the text, in order, as written."""
    return F.regexp_extract_all(col(text), F.lit(FIGURE_PATTERN), F.lit(1))


def dates(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(DATE_PATTERN), F.lit(1))


def figure_value(written: Column) -> Column:
    return F.regexp_replace(written, "[,%]", "").try_cast("double")


def figure_decimals(written: Column) -> Column:
    return F.length(F.regexp_extract(written, r"\.(\d+)", 1))
