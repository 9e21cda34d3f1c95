"""Column expressions over event and record columns (no shuffles, codegen only)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from frayline.functions import lookups as L


def _sql(value) -> str:
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(_sql(v) for v in value)})"
    return f"'{value}'" if isinstance(value, str) else str(value)


def lookup(mapping: Mapping, key: Column) -> Column:
    """Value of a small fixed mapping, null when the key is absent."""
    pairs = ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in mapping.items())
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def safe_rate(total: Column, seconds: Column) -> Column:
    """``total / seconds``; 0.0 for a missing or zero duration, error for a negative one."""
    return (
        F.when(seconds < 0, F.raise_error(F.lit("duration must not be negative")).cast("double"))
        .when(seconds > 0, total / seconds)
        .otherwise(F.lit(0.0))
    )


def clamp_magnitude(value: Column) -> Column:
    """Sentinel-sized values are 'no value'; negatives are 0."""
    return F.when(value >= L.MAGNITUDE_CEILING, F.lit(0)).otherwise(F.greatest(value, F.lit(0)))


def condition_landed(result: Column, build: Column) -> Column:
    recoded = F.when(result >= 13, result % 2 == 0).otherwise(False)
    return (
        F.when(result == L.ABSORB_RESULT, False)
        .when(build >= L.RECODED_BUILD, recoded)
        .otherwise(result == 0)
    )


def condition_absorbed(result: Column, build: Column) -> Column:
    recoded = F.when(result >= 13, result % 2 == 1).otherwise(False)
    return (
        F.when(result == L.ABSORB_RESULT, True)
        .when(build >= L.RECODED_BUILD, recoded)
        .otherwise(result != 0)
    )


def buff_change_kind(code: Column) -> Column:
    return (
        F.when(code < 0, F.raise_error(F.lit("buff-change code must not be negative")).cast("string"))
        .when(code == 0, "apply")
        .when(code == 1, "remove_all")
        .otherwise("remove_single")
    )


def buff_category(buff_id: Column) -> Column:
    return (
        F.when(buff_id.isin(L.BOON_IDS), "boon")
        .when(buff_id.isin(L.DAMAGING_CONDITION_IDS), "condition_damage")
        .when(buff_id.isin(L.CONTROL_CONDITION_IDS), "condition_control")
    )


def is_condition_buff(buff_id: Column) -> Column:
    return buff_id.isin(L.DAMAGING_CONDITION_IDS + L.CONTROL_CONDITION_IDS)


def landed_hit() -> Column:
    return (
        F.when(F.col("is_condition"), F.col("connected"))
        .when(F.col("connected"), True)
        .when(F.col("buff_dmg") > 0, F.col("damage") > 0)
        .otherwise(F.col("result").isin(L.HIT_RESULTS))
    )


def absorbed_hit() -> Column:
    return F.when(F.col("is_condition"), F.col("absorbed")).otherwise(
        F.col("absorbed") | (F.col("result") == L.ABSORB_RESULT)
    )


def condition_part(
    build: Column,
    skill_name: Column,
    portion: Column | None = None,
    names: Iterable[str] = tuple(L.CONDITION_SKILL_NAMES),
) -> Column:
    """Condition share of one hit: carried by the hit on newer builds, else by skill name."""
    portion = F.col("buff_dmg") if portion is None else portion
    numeric = F.when(build.rlike("^[0-9]+$"), build.try_cast("bigint"))
    carried = F.least(F.col("damage"), F.greatest(portion, F.lit(0)))
    by_name = F.when(skill_name.isin(list(names)), F.col("damage")).otherwise(F.lit(0))
    return F.when(F.coalesce(numeric >= L.SPLIT_BUILD, F.lit(False)), carried).otherwise(by_name)


def catalogue_condition(condition_ids: Iterable[int] | None = None) -> Column:
    """Condition by buff catalogue when one is given, else by the hit's own flags."""
    if condition_ids is not None:
        return F.col("skill_id").isin(list(condition_ids))
    return F.col("is_condition") | (F.col("buff_dmg") > 0)


def catalogue_condition_damage(condition_ids: Iterable[int] | None = None) -> Column:
    counted = catalogue_condition(condition_ids) & ~F.col("is_life_leech")
    return F.when(counted, F.least(F.col("damage"), F.col("buff_dmg"))).otherwise(F.lit(0))


def float32_from_bits(bits: Column) -> Column:
    """IEEE-754 single precision value of a 32-bit pattern held in a long; null if not finite."""
    exponent = F.shiftright(bits, 23).bitwiseAND(F.lit(255))
    fraction = bits.bitwiseAND(F.lit(8388607)).cast("double")
    sign = F.when(F.shiftright(bits, 31).bitwiseAND(F.lit(1)) == 1, -1.0).otherwise(1.0)
    normal = F.pow(F.lit(2.0), exponent - 127) * (1.0 + fraction / 8388608.0)
    subnormal = F.pow(F.lit(2.0), F.lit(-126)) * (fraction / 8388608.0)
    return F.when(exponent < 255, sign * F.when(exponent == 0, subnormal).otherwise(normal))
