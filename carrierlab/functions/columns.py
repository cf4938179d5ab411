"""Scalar expressions. All of them stay on the JVM side."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_true(cond: Column) -> Column:
    """Three-valued condition to two-valued: unknown counts as false."""
    return F.coalesce(cond, F.lit(False))


def member(col: str | Column, values: Iterable) -> Column:
    """Membership that is false, never null, for a null value.

    ``~member(...)`` therefore keeps nulls, unlike SQL ``NOT IN``.
    """
    return is_true(as_col(col).isin(list(values)))


def level_in(col: str | Column, levels: Iterable[str]) -> Column:
    """Case-insensitive membership; levels are given in lower case."""
    return member(F.lower(as_col(col)), levels)


def recode(col: str | Column, mapping: Mapping, default: Column | None = None) -> Column:
    """Replace listed values; others keep their value, or get ``default``."""
    col = as_col(col)
    expr = None
    for old, new in mapping.items():
        expr = (F if expr is None else expr).when(col == F.lit(old), F.lit(new))
    if expr is None:
        return col
    return expr.otherwise(col if default is None else default)


def level_rank(col: str | Column, order: Iterable[str]) -> Column:
    """Position of a value in a custom order; values outside it sort last."""
    order = list(order)
    pos = F.array_position(F.array(*[F.lit(v) for v in order]), as_col(col))
    return F.when(pos > 0, pos.cast("int")).otherwise(F.lit(len(order) + 1))


def variant_key(*parts: str | Column, sep: str = "-") -> Column:
    return F.concat_ws(sep, *[as_col(p).cast("string") for p in parts])


def parse_us_date(col: str | Column) -> Column:
    """``Mon dd, yyyy`` to date; unparseable text becomes null."""
    return F.try_to_timestamp(as_col(col), F.lit("MMM d, yyyy")).cast("date")


def info_field(info: str | Column, key: str) -> Column:
    """One value out of a ``k=v;k=v`` text; null when the key is absent."""
    found = F.regexp_extract(as_col(info), rf"(?:^|;){key}=([^;]*)", 1)
    return F.when(found != "", found)


def alt_count(counts: str | Column) -> Column:
    """Second number of an array-like text ``[ref,alt]``, as an integer."""
    return F.try_element_at(F.from_json(as_col(counts), "array<int>"), F.lit(2))


def split_part_or_null(col: str | Column, sep_regex: str, index: int) -> Column:
    return F.try_element_at(F.split(as_col(col), sep_regex), F.lit(index))


def locus_allele_key(locus: str | Column, alleles: str | Column) -> Column:
    """``c:p`` and ``[ref,alt]`` to ``c-p-ref-alt``."""
    bases = F.regexp_replace(as_col(alleles), r'[\[\]"\s]', "")
    return F.concat_ws(
        "-",
        split_part_or_null(locus, ":", 1), split_part_or_null(locus, ":", 2),
        split_part_or_null(bases, ",", 1), split_part_or_null(bases, ",", 2),
    )


def parse_interval(text: str | Column, buffer: int = 0) -> tuple[Column, Column, Column]:
    """``chrom:start-end`` to (contig, start, end), widened and clamped at 1.

    The result is start-inclusive and end-exclusive.
    """
    window = split_part_or_null(text, ":", 2)
    start = split_part_or_null(window, "-", 1).cast("long") - buffer
    end = split_part_or_null(window, "-", 2).cast("long") + buffer
    return split_part_or_null(text, ":", 1), F.greatest(F.lit(1).cast("long"), start), end


def treatment_adjusted(value: str | Column, on_meds: str | Column, factor: float) -> Column:
    """Value divided by ``factor`` when treated; unknown treatment is untreated."""
    treated = is_true(as_col(on_meds).cast("int") != 0)
    return F.when(treated, as_col(value) / F.lit(factor)).otherwise(as_col(value))


def flag_where(flag: str | Column, *conditions: Column) -> Column:
    """Set a flag to 1 where any condition is true, else keep it (null included)."""
    hit = F.lit(False)
    for cond in conditions:
        hit = hit | is_true(cond)
    return F.when(hit, F.lit(1)).otherwise(as_col(flag))


def frequency_band(af: str | Column, ac: str | Column) -> Column:
    af, ac = as_col(af), as_col(ac)
    return (
        F.when(is_true(ac == 0) | ac.isNull(), "Novel")
        .when(af < F.lit(1 / 10000), "<1/10000")
        .when(af < F.lit(1 / 1000), "<1/1000")
        .when(af >= F.lit(1 / 1000), ">=1/1000")
    )


def compare(col: str | Column, rule: str, threshold: float) -> Column:
    """Outcome by rule; a null value gives a null outcome."""
    col, limit = as_col(col), F.lit(threshold)
    return {">": col > limit, "<": col < limit, ">=": col >= limit, "=": col == limit}[rule]


def distinct_sorted_text(col: str | Column, sep: str = ", ") -> Column:
    """Aggregate: distinct non-null values, sorted and joined; empty gives ''."""
    return F.concat_ws(sep, F.sort_array(F.collect_set(as_col(col))))


def rename_evidence(col: str | Column) -> Column:
    from carrierlab.settings import EVIDENCE_RENAMES

    return recode(col, EVIDENCE_RENAMES)


def significant_digits(col: str | Column, digits: int = 3) -> Column:
    """C-style ``%.{digits}g``: significant digits, trailing zeros dropped."""
    col = as_col(col).cast("double")
    sci = F.format_string(f"%.{digits - 1}e", col)
    exponent = F.regexp_extract(sci, r"e([+-]\d+)$", 1)
    power = F.when(exponent != "", exponent.cast("int"))

    def stripped(text: Column) -> Column:
        return F.when(
            F.instr(text, ".") > 0, F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")
        ).otherwise(text)

    mantissa = stripped(F.regexp_extract(sci, r"^([^e]*)e", 1))
    fixed = stripped(sci.try_cast("decimal(38,18)").cast("string"))
    return (
        F.when(col.isNull(), None)
        .when(F.isnan(col), "NaN")
        .when((power < -4) | (power >= digits), F.concat(mantissa, F.lit("e"), exponent))
        .otherwise(F.when(col == 0, "0").otherwise(fixed))
    )


def estimate_interval_text(
    mean: str | Column, low: str | Column, high: str | Column, decimals: int = 2, gap: str = " "
) -> Column:
    """``mean (low-high)`` with a fixed number of decimals."""
    fmt = f"%.{decimals}f{gap}(%.{decimals}f-%.{decimals}f)"
    parts = [as_col(c).cast("double") for c in (mean, low, high)]
    known = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull()
    return F.when(known, F.format_string(fmt, *parts))


def any_or_null(cond: Column) -> Column:
    """Aggregate: true if any is true, else null if any is unknown, else false."""
    return F.when(F.bool_or(cond), F.lit(True)).when(
        F.count(F.when(cond.isNull(), 1)) > 0, F.lit(None).cast("boolean")
    ).otherwise(F.lit(False))
