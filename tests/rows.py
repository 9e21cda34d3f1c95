"""Row builders for hand-made event frames."""

from frayline.schema import EVENT_DDL


def event_frame(spark, events):
    """Events given as dicts; seq is the list position unless set, missing payload is null."""
    names = [part.strip().split(" ")[0] for part in EVENT_DDL.replace("(20,0)", "").split(",")]
    ddl = EVENT_DDL.replace("DECIMAL(20,0)", "BIGINT")
    rows = []
    for i, e in enumerate(events):
        row = {"fight_id": "f1", "seq": i, "source_agent_id": 0, "target_agent_id": 0, "skill_id": 0} | e
        rows.append(tuple(row.get(n) for n in names))
    return spark.createDataFrame(rows, ddl)


def hit(t, src, dst, damage, skill=1, **more):
    base = dict(
        event_type="DAMAGE", time_ms=t, source_agent_id=src, target_agent_id=dst, skill_id=skill, damage=damage, buff_dmg=0, result=0,
        is_condition=False, connected=True, absorbed=False, against_downed=False, is_life_leech=False,
    )
    return base | more


def boon(t, src, dst, buff, duration=0, kind="apply", stacks=1, stack_id=None):
    return dict(
        event_type="BOON_APPLY", time_ms=t, source_agent_id=src, target_agent_id=dst, skill_id=buff, duration_ms=duration, kind=kind,
        stacks=stacks, stack_id=stack_id,
    )


def state(t, kind, agent, **more):
    return dict(event_type=kind, time_ms=t, source_agent_id=agent) | more
