
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medspan.functions import lexicon as lx
from medspan.functions.textnorm import fold, normalize, strip_space

VALUES = "array<double>"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def numbers(found: Column) -> Column:
    return F.transform(found, lambda x: x.cast("double"))


def strength_tokens(norm: Column) -> Column:
    """Distinct ``number unit`` strings that are no rate or concentration."""
    return F.array_distinct(F.transform(_all(norm, lx.STRENGTH, 0), F.trim))


def canonical_unit(unit: Column) -> Column:
    return F.when(unit.startswith("unit"), F.lit("unit")).otherwise(unit)


def canonical_number(value: Column) -> Column:
    """Whole numbers plain, others with six significant digits and no zeros at the end."""
    short = F.regexp_replace(F.format_string("%.6g", value), r"\.?0+(?=e|$)", "")
    return F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(short)


def strength_signatures(text: Column) -> Column:
    """Distinct ``number+unit`` keys of a text, milligrams and micrograms given both ways."""
    line = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9./%+\-\s]+", " "), r"\s+", " "))

    def zipped(value: Column, unit: Column) -> Column:
        return F.transform(F.arrays_zip(value.alias("v"), unit.alias("u")), lambda x: F.struct(x["v"].cast("double").alias("v"), canonical_unit(x["u"]).alias("u")))

    pair_unit = _all(line, lx.RATIO_STRENGTH, 3)
    found = F.concat(
        zipped(_all(line, lx.RATIO_STRENGTH, 1), pair_unit),
        zipped(_all(line, lx.RATIO_STRENGTH, 2), pair_unit),
        zipped(_all(line, lx.SINGLE_STRENGTH, 1), _all(line, lx.SINGLE_STRENGTH, 2)),
    )

    def key(value: Column, unit: Column) -> Column:
        return F.concat(canonical_number(value), unit)

    both = F.transform(
        found,
        lambda x: F.array_compact(
            F.array(
                key(x["v"], x["u"]),
                F.when(x["u"] == "mg", key(x["v"] * 1000.0, F.lit("mcg"))).when(x["u"] == "mcg", key(x["v"] / 1000.0, F.lit("mg"))),
            )
        ),
    )
    return F.array_sort(F.array_distinct(F.flatten(both)))


def strengths_mg(name: Column) -> Column:
    """Sorted distinct milligram values of a name, rounded to six places."""
    low = F.lower(name)
    pairs = F.arrays_zip(_all(low, lx.SINGLE_STRENGTH, 1).alias("v"), _all(low, lx.SINGLE_STRENGTH, 2).alias("u"))

    def milligrams(p: Column) -> Column:
        v = p["v"].cast("double")
        return F.when(p["u"] == "mg", v).when(p["u"] == "mcg", v / 1000.0).when(p["u"] == "g", v * 1000.0)

    return F.array_sort(F.array_distinct(F.transform(F.array_compact(F.transform(pairs, milligrams)), lambda v: F.round(v, 6))))


def close(values: Column, expected: Column) -> Column:
    """Whether any value is within max(0.005, 6 %) of the expected one."""
    return F.exists(values, lambda v: F.abs(v - expected) <= F.greatest(F.lit(0.005), F.abs(expected) * 0.06))


def overlap_count(reference: Column, values: Column) -> Column:
    return F.size(F.filter(reference, lambda e: close(values, e)))


def form_tokens(norm: Column) -> Column:
    """Form classes with a whole-word hint in a normalised text."""
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    held = [F.when(reduce(lambda a, b: a | b, [padded.contains(f" {h} ") for h in hints]), F.lit(form)) for form, hints in lx.FORM_HINTS.items()]
    return F.array_compact(F.array(*held))


def form_flags(norm: Column) -> Column:
    """Form classes of a candidate name, and ``oral``."""
    return F.concat(form_tokens(norm), F.when(F.concat(F.lit(" "), norm, F.lit(" ")).contains(" oral "), F.array(F.lit("oral"))).otherwise(F.array().cast("array<string>")))


#: Form classes as bits, so that scoring tests and counts them with integer operations.
FORM_BITS = {form: 1 << i for i, form in enumerate([*lx.FORM_HINTS, "oral"])}


def form_bits(forms: Column) -> Column:
    """Bit set of an array of form classes."""
    return reduce(lambda a, b: a + b, [F.when(F.array_contains(forms, form), F.lit(bit)).otherwise(0) for form, bit in FORM_BITS.items()])


def has_strength_signal(norm: Column) -> Column:
    return norm.rlike(lx.STRENGTH) | norm.rlike(lx.RATIO_STRENGTH) | norm.rlike(lx.UNITS_PER_KG_HOUR)


def record_parts(text: Column) -> Column:
    """Struct (name, strength, route, schedule, status) of a ``med|`` or ``rxe|`` record as written, or null."""
    own = strip_space(text)
    low, parts = F.lower(own), F.transform(F.split(own, r"\|", -1), strip_space)
    payload = F.transform(F.split(F.element_at(parts, -1), r"\^", -1), strip_space)
    names = ("name", "strength", "route", "schedule", "status")
    med = F.struct(*[F.get(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(names)])
    rxe = F.struct(*[(F.get(payload, F.lit(i)) if n != "status" else F.lit("")).alias(n) for i, n in enumerate(names)])
    return F.when(low.startswith("med|") & (F.size(parts) >= 6), med).when(low.startswith("rxe|") & (F.size(parts) >= 3) & (F.size(payload) >= 4), rxe)


def with_record(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``record_name``, ``record_route``, ``record_schedule``, ``record_status`` (normalised) and ``structured``."""
    record = "record"
    while record in rows.columns:
        record += "_"
    own, parsed = F.col(record), rows.withColumn(record, record_parts(F.col(text)))
    norm = {f"record_{n}": F.coalesce(normalize(own[n]), F.lit("")) for n in ("route", "schedule", "status")}
    return parsed.withColumns(norm | {"record_name": own["name"], "record_strength": own["strength"], "structured": own.isNotNull()}).drop(record)


def combo_hint(raw: Column, norm: Column) -> Column:
    padded, low = F.concat(F.lit(" "), norm, F.lit(" ")), F.lower(raw)
    return raw.contains("+") | padded.contains(" and ") | padded.contains(" with ") | low.rlike(r"(?U)\b[a-z]{3,}\s*/\s*[a-z]{3,}\b") | low.rlike(r"(?U)\b[a-z]{3,}\s*-\s*[a-z]{3,}\b")


def _positive(found: Column, most: float) -> Column:
    return F.filter(numbers(found), lambda v: (v > 0.0) & (v <= most))


def with_mention_features(rows: DataFrame) -> DataFrame:
    """Features of mentions: ``mention_text``, ``projection_norm``, ``context`` (repaired text around it), ``surface`` (repaired
    mention text) and the columns of ``with_record``.  Columns that others build on come first, so nothing is computed twice."""
    mention, context, surface = F.col("mention_text"), F.col("context"), F.col("surface")
    route, schedule = F.col("record_route"), F.col("record_schedule")
    first = rows.withColumns(
        {
            "rate": context.rlike(lx.INFUSION_RATE),
            "context_forms": form_tokens(context),
            "schedule": context.rlike(lx.SCHEDULE),
            "oral": context.rlike(lx.ORAL_ROUTE) | route.isin(*lx.ORAL_ROUTES),
            "ascii_mention": F.lower(fold(mention, lookalikes=False)),
            "surface_numbers": _positive(_all(surface, lx.BARE_NUMBER, 0), 1500.0),
        }
    )
    ascii_mention = F.col("ascii_mention")
    ratios = F.transform(F.arrays_zip(_all(ascii_mention, lx.SLASH_RATIO, 1).alias("a"), _all(ascii_mention, lx.SLASH_RATIO, 2).alias("b")), lambda p: F.struct(p["a"].cast("double").alias("a"), p["b"].cast("double").alias("b")))
    injected = F.when(route.isin(*lx.IV_ROUTES) | F.col("rate"), F.array(F.lit("injection"))).otherwise(F.array().cast("array<string>"))
    second = first.withColumns(
        {
            "iv": context.rlike(lx.IV_ROUTE) | route.isin(*lx.IV_ROUTES) | F.col("rate"),
            "continuous": context.rlike(lx.CONTINUOUS) | schedule.isin(*lx.CONTINUOUS_SCHEDULES) | F.col("rate"),
            "forms": F.array_distinct(F.concat("context_forms", injected)),
            "strength_tokens": strength_tokens(context),
            "strength_sigs": strength_signatures(context),
            "combo": combo_hint(F.coalesce("record_name", mention), F.col("projection_norm")),
            "ratios": F.filter(ratios, lambda p: (p["a"] > 0) & (p["b"] > 0)),
            "numbers": F.array_sort(F.array_distinct(F.transform(_positive(_all(context, lx.BARE_NUMBER, 0), 1500.0), lambda v: F.round(v, 6)))),
        }
    )
    oral_form = F.arrays_overlap("forms", F.array(*[F.lit(x) for x in lx.SOLID_FORMS]))
    implicit = ~F.col("iv") & ~F.col("continuous") & ~surface.rlike(lx.PER_UNIT) & (F.size("surface_numbers") > 0) & (F.col("schedule") | F.col("oral") | oral_form)
    return second.withColumn("dose_signal", (surface != "") & (has_strength_signal(surface) | implicit)).drop("rate", "context_forms", "ascii_mention", "surface_numbers")
