"""Role classification as staged columns (R1-R7).

Each stage adds a named temporary column, so no expression is repeated and the
whole classification stays in one code-generated projection chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frayline.functions import lookups as L
from frayline.functions.combat import lookup


def effort_shares(df: DataFrame, damage: str, healing: str, removal: str) -> DataFrame:
    """Weighted effort per axis and its share of the total (0 when there is none)."""
    weights = L.EFFORT_WEIGHTS
    parts = {
        "_e_damage": F.greatest(F.col(damage), F.lit(0)) * weights["damage"],
        "_e_heal": F.greatest(F.col(healing), F.lit(0)) * weights["healing"],
        "_e_strip": F.greatest(F.col(removal), F.lit(0)) * weights["strip"],
    }
    df = df.withColumns(parts).withColumn("_effort", F.expr("_e_damage + _e_heal + _e_strip"))
    share = lambda c: F.when(F.col("_effort") > 0, F.col(c) / F.col("_effort")).otherwise(0.0)
    return df.withColumns(
        {"r_damage": share("_e_damage"), "r_heal": share("_e_heal"), "r_strip": share("_e_strip")}
    ).drop("_e_damage", "_e_heal", "_e_strip")


def with_role(
    df: DataFrame,
    damage: str = "total_damage",
    healing: str = "total_healing",
    removal: str = "total_buff_removal",
    profession: str = "profession",
    elite: str = "elite",
    power: str | None = None,
    condi: str | None = None,
    outgoing_prefix: str | None = None,
) -> DataFrame:
    """Adds ``detected_role`` and ``detected_tags``.

    ``outgoing_prefix`` names boon-output columns (``<prefix><boon>``, null = no
    data); without it boon output plays no part.
    """
    keep = df.columns
    df = effort_shares(df, damage, healing, removal)
    df = df.withColumns(
        {"_spec": lookup(L.SPEC_NAMES, F.col(elite)), "_prof": lookup(L.PROFESSIONS, F.col(profession))}
    )
    df = df.withColumns(
        {
            "_hint": F.coalesce(lookup(L.SPEC_HINT, F.col("_spec")), lookup(L.PROFESSION_HINT, F.col("_prof"))),
            "_caps": lookup(L.SPEC_CAPABILITIES, F.col("_spec")),
        }
    )
    r_damage, r_heal, r_strip = F.col("r_damage"), F.col("r_heal"), F.col("r_strip")
    pure = F.array_compact(
        F.array(
            F.when(r_damage >= L.PURE_SHARE["DPS"], "DPS"),
            F.when(r_heal >= L.PURE_SHARE["HEAL"], "HEAL"),
            F.when(r_strip >= L.PURE_SHARE["STRIP"], "STRIP"),
        )
    )
    df = df.withColumn("_b1", pure)
    b1, hint, caps = F.col("_b1"), F.col("_hint"), F.col("_caps")
    promoted = (
        (hint == "HEAL")
        & (r_heal >= L.HEALER_OVERRIDE_SHARE)
        & (F.get(b1, F.lit(0)) == "DPS")
        & ~F.array_contains(b1, "HEAL")
    )
    df = df.withColumn("_b2", F.when(promoted, F.array_prepend(b1, F.lit("HEAL"))).otherwise(b1))
    has = lambda role: F.coalesce(F.array_contains(caps, role), F.lit(False))
    hinted = (
        F.when((hint == "DPS") & (r_damage >= L.HINT_SHARE), "DPS")
        .when((hint == "HEAL") & (r_heal >= L.HINT_SHARE), "HEAL")
        .when((hint == "STRIP") & (r_strip >= L.HINT_SHARE), "STRIP")
        .when(
            (hint == "BOON") & has("BOON") & ((~has("DPS") & ~has("HEAL")) | (r_heal + r_strip > r_damage)),
            "BOON",
        )
    )
    fallback = F.array_compact(F.array(hinted))
    df = df.withColumn("_b3", F.when(F.size("_b2") > 0, F.col("_b2")).otherwise(fallback))
    b3 = F.col("_b3")
    if outgoing_prefix is None:
        df = df.withColumn("_b4", b3)
    else:
        columns = {name: F.col(outgoing_prefix + name) for name in L.BOON_WEIGHTS}
        weighted = sum((F.coalesce(col * L.BOON_WEIGHTS[n], F.lit(0.0)) for n, col in columns.items()), F.lit(0.0))
        active = F.coalesce(*columns.values()).isNotNull() & (weighted >= L.BOON_MINIMUM) & has("BOON")
        first = (hint == "BOON") & (F.coalesce(F.get(b3, F.lit(0)), F.lit("")) != "HEAL")
        boosted = F.when(F.coalesce(first, F.lit(False)), F.array_prepend(b3, F.lit("BOON"))).otherwise(
            F.array_append(b3, F.lit("BOON"))
        )
        df = df.withColumn("_b4", F.when(active & ~F.array_contains(b3, "BOON"), boosted).otherwise(b3))
    b4 = F.col("_b4")
    primary = F.when(F.size(b4) > 0, F.get(b4, F.lit(0))).when(F.col("_effort") == 0, "UNKNOWN").otherwise("MIXED")
    df = df.withColumn("detected_role", primary)
    df = df.withColumn("_foreign", F.when(caps.isNotNull(), F.array_except(b4, caps)))
    foreign = F.coalesce(F.size("_foreign"), F.lit(0)) > 0
    off_meta = hint.isNotNull() & (F.col("detected_role") != hint) & ~foreign
    tags = [
        F.when(foreign, F.concat(F.lit("foreign_badges:"), F.array_join("_foreign", ","))),
        F.when(off_meta, "off_meta"),
        F.when(r_damage >= L.HIGH_SHARE["high_dps"], "high_dps"),
        F.when(r_heal >= L.HIGH_SHARE["high_healing"], "high_healing"),
        F.when(r_strip >= L.HIGH_SHARE["high_strips"], "high_strips"),
    ]
    if power is not None and condi is not None:
        typed = F.col(power) + F.col(condi)
        share = F.when(typed > 0, F.col(power) / typed)
        tags.append(F.when(share >= 0.80, "high_power").when(share <= 0.20, "high_condi"))
    empty = F.array().cast("array<string>")
    df = df.withColumn(
        "detected_tags",
        F.when(F.size(b4) > 0, F.array_compact(F.array(*tags)))
        .when(F.col("_effort") == 0, F.array(F.lit("zero_output")))
        .otherwise(empty),
    )
    return df.select(*keep, "detected_role", "detected_tags")


def readout_roles(df: DataFrame, out: str = "roles", cleanses: str = "cleanses", cc: str = "cc") -> DataFrame:
    """Readout labels: the detected role's label, Cleanser, CC; DPS when nothing applies.

    Uses the numeric profession and elite codes of the agent.
    """
    labels = F.array_compact(
        F.array(
            lookup(L.ROLE_LABELS, F.col("detected_role")),
            F.when(F.col(cleanses) > 10, "Cleanser"),
            F.when(F.col(cc) > 3, "CC"),
        )
    )
    df = df.withColumn("_labels", labels)
    return df.withColumn(out, F.when(F.size("_labels") > 0, F.col("_labels")).otherwise(F.array(F.lit("DPS")))).drop("_labels")


def additive_roles(healing_share: Column, boon_rate: Column, strips: Column, cleanses: Column, cc: Column) -> Column:
    """Every role whose threshold is passed; DPS when none is."""
    roles = F.array_compact(
        F.array(
            F.when(healing_share > 0.10, "Heal"),
            F.when(boon_rate > 1.0, "Support"),
            F.when(strips > 5, "Strip"),
            F.when(cleanses > 10, "Cleanser"),
            F.when(cc > 3, "CC"),
        )
    )
    return F.when(F.size(roles) > 0, roles).otherwise(F.array(F.lit("DPS")))
