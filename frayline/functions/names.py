"""Label and text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from frayline.functions import lookups as L
from frayline.functions.combat import lookup

COMMANDER_SUFFIX = " [CMDR]"


def sanitise_name(name: Column, limit: int = 128) -> Column:
    return F.substring(F.replace(F.coalesce(name, F.lit("")), F.lit("\x00"), F.lit("")), 1, limit)


def bare_account(account: Column) -> Column:
    """Account names are compared without their leading colons."""
    return F.ltrim(account, F.lit(":"))


def strip_one_colon(account: Column) -> Column:
    """Stored-name migration: drop exactly one leading colon."""
    return F.regexp_replace(account, "^:", "")


def profession_label(code: Column) -> Column:
    return F.when(code == 0, "UNKNOWN").otherwise(
        F.coalesce(lookup(L.PROFESSIONS, code), F.format_string("PROF(%d)", code))
    )


def elite_label(code: Column) -> Column:
    return F.when(code == 0, "BASE").otherwise(
        F.coalesce(lookup(L.SPEC_NAMES, code), F.format_string("ELITE(%d)", code))
    )


def spec_label(profession: Column, elite: Column) -> Column:
    core = F.when(profession == 0, "Unknown").otherwise(lookup(L.PROFESSIONS, profession))
    return F.when(elite == 0, core).otherwise(lookup(L.SPEC_NAMES, elite))


def valid_elite(profession: Column, elite: Column) -> Column:
    """The specialisation if it belongs to the profession, else 0 (base)."""
    return F.when(lookup(L.SPEC_PROFESSION, elite) == profession, elite).otherwise(F.lit(0))


def profession_code(value: str) -> int | None:
    """Profession filter given by name or number; '' means no filter."""
    if not value:
        return None
    codes = {name.upper(): code for code, name in L.PROFESSIONS.items()} | {"UNKNOWN": 0}
    if value.upper() in codes:
        return codes[value.upper()]
    if value.isdigit() and int(value) in codes.values():
        return int(value)
    raise ValueError(f"unknown profession {value!r}")


def subgroup_number(label: Column) -> Column:
    """Whole label as a number, else its last word when there are several, else 0."""
    words = F.split(F.trim(label), r"\s+")
    last = F.when(F.size(words) > 1, F.element_at(words, -1).try_cast("int"))
    return F.coalesce(F.trim(label).try_cast("int"), last, F.lit(0))


def is_commander(name: Column) -> Column:
    return F.coalesce(F.endswith(name, F.lit(COMMANDER_SUFFIX)), F.lit(False))


def without_commander_tag(name: Column) -> Column:
    cut = F.substr(name, F.lit(1), F.length(name) - len(COMMANDER_SUFFIX))
    return F.when(is_commander(name), cut).otherwise(F.coalesce(name, F.lit("")))


def clock_label(ms: Column) -> Column:
    """Milliseconds as m:ss."""
    whole = F.floor(ms / 1000)
    minutes = F.floor(whole / 60).cast("string")
    return F.concat(minutes, F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def byte_size(size: Column) -> Column:
    """Size label with one decimal; a tie goes to the even digit (``format_string`` would round it up)."""
    mib = 1024 * 1024
    scaled = lambda unit: F.format_string("%.1f", F.bround(size * 10 / unit) / 10)
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < mib, F.concat(scaled(1024), F.lit(" KiB")))
        .otherwise(F.concat(scaled(mib), F.lit(" MiB")))
    )


def tick_label(value: Column) -> Column:
    """Axis label: 950, 1k, 1.5k, 2M, 3.1B."""

    def scaled(unit: int, suffix: str) -> Column:
        part = value / unit
        return F.when(
            part == F.floor(part), F.concat(F.floor(part).cast("string"), F.lit(suffix))
        ).otherwise(F.format_string(f"%.1f{suffix}", part))

    return (
        F.when(value < 1_000, value.cast("string"))
        .when(value < 1_000_000, scaled(1_000, "k"))
        .when(value < 1_000_000_000, scaled(1_000_000, "M"))
        .otherwise(scaled(1_000_000_000, "B"))
    )
