"""Declared schemas. Agent ids are unsigned 64-bit at the boundary, hence DECIMAL(20,0)."""

from __future__ import annotations

COMMON = (
    "fight_id STRING, seq BIGINT, time_ms BIGINT, source_agent_id DECIMAL(20,0), "
    "target_agent_id DECIMAL(20,0), skill_id BIGINT, event_type STRING"
)

# payload columns by event kind
PAYLOAD: dict[str, str] = {
    "DAMAGE": (
        "damage BIGINT, buff_dmg BIGINT, result SMALLINT, is_condition BOOLEAN, shield_damage BIGINT, "
        "connected BOOLEAN, absorbed BOOLEAN, against_downed BOOLEAN, is_life_leech BOOLEAN, "
        "iff SMALLINT, src_master_instid INT, dst_master_instid INT"
    ),
    "HEALING": "healing BIGINT, barrier BIGINT, iff SMALLINT, src_is_peer BOOLEAN",
    "BUFF_REMOVAL": "buff_removal BIGINT, buff_id INT",
    "BOON_APPLY": "duration_ms BIGINT, stacks INT, stack_id BIGINT, added_active BOOLEAN, kind STRING",
    "CC": "cc_value BIGINT",
    "CONDITION_REMOVE": "condition_removal BIGINT",
    "DOWN": "downtime_ms BIGINT",
    "DEATH": "killed_by_agent_id DECIMAL(20,0), killing_skill_id BIGINT",
    "UP": "",
    "HEALTH_UPDATE": "health_percent DOUBLE",
    "COMBAT_OUTCOME": "outcome STRING",
    "STUN_BREAK": "",
    "DODGE": "",
    "BLOCK": "",
    "INTERRUPT": "",
    "BARRIER": "barrier_amount BIGINT, duration_ms BIGINT",
    "BUFF_APPLY": "duration_ms BIGINT, original_duration_ms BIGINT, stacks INT, stack_id BIGINT, "
    "added_active BOOLEAN",
    "BUFF_EXTENSION": "extended_duration_ms BIGINT, new_duration_ms BIGINT, stack_id BIGINT",
    "BUFF_STACK_ACTIVE": "stack_id BIGINT",
    "BUFF_INFO": "max_stacks INT, duration_cap BIGINT",
    "POSITION": "x DOUBLE, y DOUBLE",
    "SKILL_ACTIVATION": "activation INT, duration_ms BIGINT, expected_duration_ms BIGINT, "
    "src_master_instid INT",
    "WEAPON_SWAP": "swapped_from INT, swapped_to INT",
    "EFFECT": "guid STRING, is_around_dst BOOLEAN, duration_ms BIGINT",
    "SPAWN": "",
    "MISSILE": "",
    "DESPAWN": "",
}
EVENT_KINDS = sorted(PAYLOAD)


def _wide() -> str:
    seen: dict[str, str] = {}
    for ddl in PAYLOAD.values():
        for field in filter(None, (f.strip() for f in ddl.replace("DECIMAL(20,0)", "DECIMAL(20;0)").split(","))):
            name, kind = field.split(" ", 1)
            seen.setdefault(name, kind.replace(";", ","))
    return ", ".join(f"{n} {t}" for n, t in seen.items())


EVENT_DDL = f"{COMMON}, {_wide()}"

RAW_RECORD_DDL = (
    "fight_id STRING, seq BIGINT, build INT, time BIGINT, src DECIMAL(20,0), dst DECIMAL(20,0), "
    "value BIGINT, buff_dmg BIGINT, overstack BIGINT, skill BIGINT, src_inst INT, dst_inst INT, "
    "src_master INT, dst_master INT, iff SMALLINT, buff SMALLINT, result SMALLINT, activation SMALLINT, "
    "buffremove SMALLINT, statechange SMALLINT, shields SMALLINT, offcycle SMALLINT, pad BIGINT, "
    "nondamage SMALLINT"
)
CATALOGUE_DDL = (
    "id BIGINT, name STRING, profession INT, is_elite BOOLEAN, skill_type STRING, "
    "icon_url STRING, description STRING"
)
SIDECAR_DDL = (
    "players MAP<STRING, STRUCT<healingBySkill: MAP<STRING,STRING>, barrierBySkill: MAP<STRING,STRING>>>"
)
UPLOAD_DDL = (
    "id BIGINT, sha256 STRING, original_filename STRING, size_bytes BIGINT, uploaded_at TIMESTAMP, "
    "status STRING, error_message STRING, parser_version STRING"
)
UPLOAD_STATUSES = ["pending", "completed", "failed"]
