import pytest
from pyspark.sql import functions as F

from frayline.functions import lookups as L
from frayline.functions.roles import additive_roles, readout_roles, with_role

CASES = [
    # damage, healing, strips, profession, elite, power, condi, quickness -> role, tags
    ((0, 0, 0, 1, 62, 0, 0, None), "UNKNOWN", ["zero_output"]),
    ((1000, 0, 0, 2, 18, 1000, 0, None), "DPS", ["high_dps", "high_power"]),
    ((100, 1000, 0, 4, 5, 100, 0, None), "HEAL", ["high_healing", "high_power"]),
    ((1000, 0, 1, 2, 61, 500, 500, None), "STRIP", ["high_strips"]),
    ((700, 120, 0, 4, 5, 700, 0, None), "HEAL", ["high_power"]),  # healer override at 30 %
    ((1000, 0, 0, 9, 52, 0, 1000, None), "DPS", ["off_meta", "high_dps", "high_condi"]),
    ((1000, 0, 0, 9, 52, 500, 500, 100_000), "BOON", ["high_dps"]),
    ((1000, 0, 0, 9, 52, 500, 500, 99_999), "DPS", ["off_meta", "high_dps"]),
    ((1000, 0, 0, 3, 70, 500, 500, 100_000), "DPS", ["high_dps"]),
    ((0, 0, 5, 4, 5, 0, 0, None), "STRIP", ["foreign_badges:STRIP", "high_strips"]),
    ((600, 180, 0, 1, 0, 300, 300, None), "MIXED", []),
    ((600, 180, 0, 5, 0, 300, 300, None), "DPS", []),
    ((500, 120, 0, 0, 0, 250, 250, None), "MIXED", []),
]


@pytest.mark.parametrize("case,role,tags", CASES)
def test_detected_role(spark, case, role, tags):
    ddl = "total_damage BIGINT, total_healing BIGINT, total_buff_removal BIGINT, profession INT, elite INT, p BIGINT, c BIGINT, out_quickness BIGINT"
    df = spark.createDataFrame([case], ddl).withColumns({f"out_{b}": F.lit(None).cast("bigint") for b in L.BOON_WEIGHTS if b != "quickness"})
    row = with_role(df, power="p", condi="c", outgoing_prefix="out_").first()
    assert (row.detected_role, row.detected_tags) == (role, tags)


def test_additive_and_readout_roles(spark):
    one = spark.range(1)
    pick = lambda *v: one.select(additive_roles(*[F.lit(x) for x in v]).alias("r")).first().r
    assert pick(0.1, 1.0, 5, 10, 3) == ["DPS"]
    assert pick(0.11, 1.1, 6, 11, 4) == ["Heal", "Support", "Strip", "Cleanser", "CC"]
    df = spark.createDataFrame([("HEAL", 11, 0), ("MIXED", 0, 0), ("BOON", 0, 4)], "detected_role STRING, cleanses INT, cc INT")
    assert [r.roles for r in readout_roles(df).collect()] == [["Heal", "Cleanser"], ["DPS"], ["Support", "CC"]]
