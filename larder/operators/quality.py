"""Nutrition validation: rules, confidence and routing of what fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import vocab
from larder.functions.nutrition import is_complete
from larder.functions.text import exact_round, lookup, stage, tags_where

# Order in which negative values are reported.
NON_NEGATIVE = [
    "protein_g", "fat_g", "carb_g", "calories_kcal", "serving_size_g", "servings_per_container",
]


def _c(name: str) -> Column:
    return F.col(name)


def is_missing_required() -> Column:
    return ~is_complete(_c("protein_g"), _c("servings_per_container"))


def is_negative(field: str) -> Column:
    return _c(field) < 0


def is_protein_over_serving() -> Column:
    return _c("protein_g") > _c("serving_size_g")


def is_below_min_servings() -> Column:
    return _c("servings_per_container") < vocab.MIN_SERVINGS


def is_implied_serving_too_big() -> Column:
    servings = _c("servings_per_container")
    return (servings > 0) & (F.try_divide(_c("size_g"), servings) > vocab.MAX_IMPLIED_SERVING_G)


def is_serving_size_odd() -> Column:
    return ~_c("serving_size_g").between(vocab.SERVING_SIZE_MIN_G, vocab.SERVING_SIZE_MAX_G)


def is_servings_odd() -> Column:
    return ~_c("servings_per_container").between(vocab.SERVINGS_MIN, vocab.SERVINGS_MAX)


def predicted_calories() -> Column:
    return F.lit(4.0) * _c("protein_g") + F.lit(4.0) * _c("carb_g") + F.lit(9.0) * _c("fat_g")


def is_calories_off() -> Column:
    kcal = _c("calories_kcal")
    off = F.try_divide(F.abs(kcal - predicted_calories()), kcal)
    return (kcal > 0) & (off > vocab.CALORIE_TOLERANCE)


def is_container_off() -> Column:
    size = _c("size_g")
    built = _c("serving_size_g") * _c("servings_per_container")
    return (size > 0) & (F.try_divide(F.abs(built - size), size) > vocab.CONTAINER_TOLERANCE)


# Rule code -> condition, in report order. A null operand makes a rule silent.
def error_rules() -> dict[str, Column]:
    return {
        "missing_required": is_missing_required(),
        **{f"negative_{field}": is_negative(field) for field in NON_NEGATIVE},
        "protein_exceeds_serving": is_protein_over_serving(),
        "servings_below_min": is_below_min_servings(),
        "implied_serving_too_big": is_implied_serving_too_big(),
    }


def warning_rules() -> dict[str, Column]:
    return {
        "serving_size_range": is_serving_size_odd(),
        "servings_range": is_servings_odd(),
        "calories_disagree": is_calories_off(),
        "container_disagrees": is_container_off(),
    }


def confidence_score(method: Column, errors: Column, warnings: Column) -> Column:
    base = lookup(vocab.CONFIDENCE_BY_METHOD, method, vocab.DEFAULT_CONFIDENCE)
    scored = F.greatest(F.lit(0.0), base - F.lit(vocab.WARNING_PENALTY) * F.size(warnings))
    return F.when(F.size(errors) > 0, F.lit(0.0)).otherwise(exact_round(scored, 3))


def validate_nutrition(df: DataFrame) -> DataFrame:
    """Adds ``errors``, ``warnings``, ``ok`` and ``confidence`` in one pass over the rows."""
    checked = stage(df, {"errors": tags_where(error_rules()), "warnings": tags_where(warning_rules())})
    return checked.withColumns(
        {
            "ok": F.size("errors") == 0,
            "confidence": confidence_score(
                _c("extraction_method"), _c("errors"), _c("warnings")
            ),
        }
    )


def _number(value: Column) -> Column:
    return value.cast("string")


def error_messages() -> Column:
    """Errors in words, for people who read the issues table."""
    servings, size = _c("servings_per_container"), _c("size_g")
    parts = [
        F.when(
            is_missing_required(),
            "missing required fields (protein_g, servings_per_container)",
        ),
        *[
            F.when(
                is_negative(field),
                F.concat(F.lit(f"{field} is negative ("), _number(_c(field)), F.lit(")")),
            )
            for field in NON_NEGATIVE
        ],
        F.when(
            is_protein_over_serving(),
            F.concat(
                F.lit("protein_g ("), _number(_c("protein_g")), F.lit(") exceeds serving_size_g ("),
                _number(_c("serving_size_g")), F.lit(")"),
            ),
        ),
        F.when(
            is_below_min_servings(),
            F.concat(F.lit("servings_per_container ("), _number(servings), F.lit(") is below 2")),
        ),
        F.when(
            is_implied_serving_too_big(),
            F.concat(
                F.lit("implied serving size "), _whole(F.try_divide(size, servings)),
                F.lit(" g exceeds 200 g"),
            ),
        ),
    ]
    return F.concat_ws("; ", *parts)


def warning_messages() -> Column:
    serving, servings = _c("serving_size_g"), _c("servings_per_container")
    kcal, size = _c("calories_kcal"), _c("size_g")
    off = F.try_divide(F.abs(kcal - predicted_calories()), kcal)
    parts = [
        F.when(
            is_serving_size_odd(),
            F.concat(F.lit("serving_size_g "), _number(serving), F.lit(" outside plausible range")),
        ),
        F.when(
            is_servings_odd(),
            F.concat(
                F.lit("servings_per_container "), _number(servings),
                F.lit(" outside plausible range"),
            ),
        ),
        F.when(
            is_calories_off(),
            F.concat(
                F.lit("calories "), _number(kcal), F.lit(" disagree with macros (~"),
                _whole(predicted_calories()), F.lit(" kcal, "), _whole(off * 100.0), F.lit("% off)"),
            ),
        ),
        F.when(
            is_container_off(),
            F.concat(
                F.lit("serving math ("), _whole(serving * servings),
                F.lit(" g) disagrees with container size ("), _whole(size), F.lit(" g)"),
            ),
        ),
    ]
    return F.concat_ws("; ", *parts)


def _whole(value: Column) -> Column:
    return F.rint(value).cast("long").cast("string")


def route_validated(df: DataFrame, enrichment: bool = False, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Split validated rows into accepted nutrition and issues, which have the ``keep`` columns too.

    Rejected rows become error issues and accepted rows with warnings become warning issues.
    In enrichment a reject is only a warning, with a prefix, and accepted rows log nothing.
    """
    accepted = df.filter("ok")
    if enrichment:
        issues = df.filter(~F.col("ok")).select(
            "variant_id", *keep, F.lit("validate").alias("stage"), F.lit("warning").alias("severity"),
            F.concat(F.lit("OFF enrichment: "), error_messages()).alias("message"),
            F.array_join("errors", ",").alias("codes"),
        )
    else:
        flagged = df.filter((F.size("errors") > 0) | (F.size("warnings") > 0))
        issues = flagged.select(
            "variant_id", *keep, F.lit("validate").alias("stage"),
            F.when(F.col("ok"), "warning").otherwise("error").alias("severity"),
            F.when(F.col("ok"), warning_messages()).otherwise(error_messages()).alias("message"),
            F.array_join(F.when(F.col("ok"), F.col("warnings")).otherwise(F.col("errors")), ",").alias(
                "codes"
            ),
        )
    return accepted, issues
