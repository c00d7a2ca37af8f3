"""String functions on names and identifiers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Corporate suffix words that a stripped name leaves out.
SUFFIX_WORDS = (
    "INC", "CORP", "CO", "LTD", "LLC", "LP", "PLC", "NV", "SA", "AG", "GROUP", "HOLDINGS", "ENTERPRISES",
    "INTERNATIONAL", "INTL", "COMPANY", "COMPANIES", "THE", "OF", "AND",
)

# Names of aggregates and governments that no firm stands behind.
IGNORED = (
    "US Government", "U.S. Government", "U.S. Department of Defense", "Foreign Sales", "Not Reported", "Commercial",
    "Other Government and Defense", "Other Government", "Federal Government", "State and Local Government", "International",
    "Domestic", "Export", "Exports", "Intercompany", "Intersegment", "Eliminations", "Corporate and Other", "All Other", "Other",
    "Unallocated", "Non-US", "Asia Pacific", "Europe", "Americas", "United States", "Rest of World", "Middle East",
    "Latin America", "Japan", "China", "Canada", "UK", "Germany", "France", "India",
)
#: The same as ``normalise`` gives them.
IGNORED_NAMES = tuple(sorted({"".join(c for c in name.upper() if c.isascii() and c.isalnum()) for name in IGNORED}))


def normalise(name: Column) -> Column:
    """ASCII letters and digits only, in upper case."""
    return F.upper(F.regexp_replace(name, "[^A-Za-z0-9]", ""))


def tokens(name: Column) -> Column:
    """Upper-case alphanumeric words of a raw name."""
    return F.filter(F.split(F.upper(name), "[^A-Z0-9]+"), lambda t: t != "")


def strip_suffixes(name: Column) -> Column:
    """The words of a name that are no corporate suffix, joined; repeated words stay."""
    words = F.array(*(F.lit(w) for w in SUFFIX_WORDS))
    return F.array_join(F.filter(tokens(name), lambda t: ~F.array_contains(words, t)), "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1))).otherwise(0.0)


def trim_blanks(value: Column) -> Column:
    """Without spaces, tabs and line ends around it."""
    return F.trim(value, F.lit(" \t\r\n"))


def csv_fields(line: Column) -> Column:
    """The fields of one line: every quote toggles and goes, commas between quotes stay.

    Parts between quotes alternate: commas of the even ones are marked by a line end, which no
    line holds, and the parts are joined again before they are cut. A quote that is not closed
    lasts to the end of the line.
    """
    marked = F.transform(F.split(line, '"', -1), lambda part, i: F.when(i % 2 == 0, F.translate(part, ",", "\n")).otherwise(part))
    return F.split(F.array_join(marked, ""), "\n", -1)


def zero_fill(value: Column, width: int = 6) -> Column:
    """Zeros in front up to ``width``; longer values stay whole."""
    return F.when(F.length(value) < width, F.lpad(value, width, "0")).otherwise(value)


def six_decimals(value: Column) -> Column:
    return F.format_string("%.6f", value)


def is_ignored(norm: Column, names: tuple[str, ...] = IGNORED_NAMES) -> Column:
    return norm.isin(*names)
