"""Row-level functions: bands, labels, ids, periods, units, sentences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sugartrace import constants as K
from sugartrace.functions import rounding


def glucose_status(value: Column, inclusive: bool = True) -> Column:
    """Five bands. `inclusive` keeps both upper edges in the lower band; the bulk loader does not."""
    in_range = value <= K.HIGH if inclusive else value < K.HIGH
    high = value <= K.VERY_HIGH if inclusive else value < K.VERY_HIGH
    return (
        F.when(value < K.VERY_LOW, "very_low")
        .when(value < K.LOW, "low")
        .when(in_range, "in_range")
        .when(high, "high")
        .when(value.isNotNull(), "very_high")
    )


def status_rank(status: Column) -> Column:
    rank = F.when(status == K.STATUS_ORDER[0], 1)
    for i, name in enumerate(K.STATUS_ORDER[1:], 2):
        rank = rank.when(status == name, i)
    return rank


def meal_type(minute_of_day: Column) -> Column:
    return (
        F.when(minute_of_day.between(300, 539), "breakfast")
        .when(minute_of_day.between(660, 839), "lunch")
        .when(minute_of_day.between(1020, 1319), "dinner")
        .otherwise("snack")
    )


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def intensity_from_text(text: Column) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("low")))
    return (
        F.when(lowered.rlike("high|intense|vigorous"), "high")
        .when(lowered.rlike("medium|moderate"), "medium")
        .otherwise("low")
    )


def patient_age(date_of_birth: Column, as_of: Column) -> Column:
    """Completed years; someone born on 29 February turns on 1 March of a common year."""
    had_birthday = F.date_format(as_of, "MMdd") >= F.date_format(date_of_birth, "MMdd")
    return F.year(as_of) - F.year(date_of_birth) - F.when(had_birthday, 0).otherwise(1)


def external_id(raw: Column) -> Column:
    number = raw.try_cast("int")
    return F.when(number.isNotNull(), F.format_string("SIM_%06d", number)).otherwise(
        F.concat(F.lit("SIM_"), raw)
    )


def synthetic_birth_date(raw_id: Column, age_years: Column, base: Column) -> Column:
    """Repeatable date of birth: year from the age, month and day from two bytes of a hash of the id."""
    digest = F.md5(raw_id.cast("string"))
    byte = lambda at: F.conv(F.substring(digest, at, 2), 16, 10).cast("int")
    month = F.make_date(
        (F.year(base) - F.coalesce(age_years, F.lit(35.0)).cast("int")).cast("int"),
        (byte(1) % 12 + 1).cast("int"),
        F.lit(1),
    )
    days = F.dayofmonth(F.last_day(month))
    return F.date_add(month, byte(3) % days)


def parse_period(text: Column) -> Column:
    """`24h`, `7d`, `2w`, `1m` (months) to struct(n, unit); null when malformed or n = 0."""
    n = F.regexp_extract(text, r"^(\d+)[hdwm]$", 1).try_cast("int")
    unit = F.regexp_extract(text, r"^\d+([hdwm])$", 1)
    return F.when(n > 0, F.struct(n.alias("n"), unit.alias("unit")))


def shift_by_period(ts: Column, period: Column, sign: int) -> Column:
    n, unit = period["n"] * sign, period["unit"]
    zero = F.lit(0)
    return (
        F.when(unit == "h", ts + F.make_interval(hours=n))
        .when(unit == "d", ts + F.make_interval(days=n))
        .when(unit == "w", ts + F.make_interval(weeks=n))
        .when(unit == "m", ts + F.make_interval(years=zero, months=n))
    )


def minute_to_timestamp(base: Column, minute: Column) -> Column:
    return F.timestamp_add("MINUTE", minute, base.cast("timestamp"))


def minutes_between(ts: Column, origin: Column, rounded: bool = False) -> Column:
    seconds = (F.unix_micros(ts) - F.unix_micros(origin)) / F.lit(60_000_000.0)
    return (F.bround(seconds) if rounded else F.floor(seconds)).cast("long")


def convert_glucose(value: Column, unit: Column | str) -> Column:
    unit = F.lit(unit) if isinstance(unit, str) else unit
    return F.when(unit == "mg/dL", rounding.display(value * K.MGDL_DISPLAY)).otherwise(
        rounding.display(value, 1)
    )


def format_glucose(value: Column, unit: Column | str) -> Column:
    unit = F.lit(unit) if isinstance(unit, str) else unit
    shown = convert_glucose(value, unit)
    return F.concat(
        F.when(unit == "mg/dL", shown.cast("long").cast("string")).otherwise(
            F.format_string("%.1f", shown)
        ),
        F.lit(" "),
        unit,
    )


def describe_anomaly(
    residual: Column, duration: Column, anomaly_type: Column, unit: Column | str, fallback: Column
) -> Column:
    sentence = F.concat(
        F.lit("Glucose ran "),
        format_glucose(F.abs(residual), unit),
        F.when(residual >= 0, " above").otherwise(" below"),
        F.lit(" forecast for "),
        duration.cast("string"),
        F.lit(" min · "),
        F.when(anomaly_type == "late_bolus", "covering bolus arrived late").otherwise(
            "no bolus logged around the rise"
        ),
    )
    return F.when(residual.isNull() | duration.isNull(), fallback).otherwise(sentence)


def excursion_size(residual: Column, duration: Column) -> Column:
    return F.coalesce(F.abs(residual) * duration, F.lit(0.0))


def percent_of_day(pct: Column) -> Column:
    total = rounding.display(pct / 100.0 * 1440.0).cast("long")
    hours, minutes = F.floor(total / 60).cast("long"), F.pmod(total, F.lit(60))
    return (
        F.when(hours == 0, F.concat(minutes.cast("string"), F.lit("min.")))
        .when(minutes == 0, F.concat(hours.cast("string"), F.lit("h")))
        .otherwise(
            F.concat(hours.cast("string"), F.lit("h "), minutes.cast("string"), F.lit("min."))
        )
    )


def day_band(average: Column, very_low: Column, low: Column, high: Column, very_high: Column) -> Column:
    return (
        F.when((average < very_low) | (average > very_high), "Danger")
        .when((average < low) | (average > high), "Warning")
        .otherwise("Success")
    )


def severity_visible(severity: Column, acknowledged: Column, minimum: float, show_acknowledged: bool = False):
    passes = severity.isNull() | (severity >= minimum)
    return passes if show_acknowledged else passes & ~acknowledged


def window_class(flags: Sequence[Column], names: Sequence[str] = K.CLASSES) -> Column:
    """Single class by precedence, first name first."""
    chain = F.when(flags[0] > 0, names[0])
    for flag, name in zip(flags[1:], names[1:]):
        chain = chain.when(flag > 0, name)
    return chain.otherwise("normal")


def any_flag(flags: Sequence[Column]) -> Column:
    return (F.greatest(*flags) > 0).cast("double")


def top_class(probabilities: Column, names: Sequence[str]) -> Column:
    best = F.array_position(probabilities, F.array_max(probabilities)).cast("int")
    return F.element_at(F.array(*[F.lit(n) for n in names]), best)


def event_characterised(probabilities: Column, names: Sequence[str], distance: Column, radius: Column | float,
                        minimum: float = 0.30) -> Column:
    """A class is shown only near the normal cluster, when not `normal`, and when confident enough."""
    radius = F.lit(radius) if isinstance(radius, (int, float)) else radius
    return (
        ~(distance > radius)
        & (top_class(probabilities, names) != "normal")
        & (F.array_max(probabilities) >= minimum)
    )


def label_flag(label: Column, name: str) -> Column:
    """Null label means normal / none."""
    return F.coalesce(label == name, F.lit(False)).cast("double")
