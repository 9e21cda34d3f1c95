"""Codes, names and thresholds results depend on.

Everything in this file is data. Operators take these tables as parameters, so
a deployment with other codes passes its own.
"""

from __future__ import annotations

# --- fixed values: core professions -------------------------------------
PROFESSIONS = {
    1: "Guardian",
    2: "Warrior",
    3: "Engineer",
    4: "Ranger",
    5: "Thief",
    6: "Elementalist",
    7: "Mesmer",
    8: "Necromancer",
    9: "Revenant",
}

# --- fixed values: elite specialisations, (id, name, profession id) ------
SPECIALISATIONS = [
    (5, "Druid", 4),
    (7, "Daredevil", 5),
    (18, "Berserker", 2),
    (27, "Dragonhunter", 1),
    (34, "Reaper", 8),
    (40, "Chronomancer", 7),
    (43, "Scrapper", 3),
    (48, "Tempest", 6),
    (52, "Herald", 9),
    (55, "Soulbeast", 4),
    (56, "Weaver", 6),
    (57, "Holosmith", 3),
    (58, "Deadeye", 5),
    (59, "Mirage", 7),
    (60, "Scourge", 8),
    (61, "Spellbreaker", 2),
    (62, "Firebrand", 1),
    (63, "Renegade", 9),
    (64, "Harbinger", 8),
    (65, "Willbender", 1),
    (66, "Virtuoso", 7),
    (67, "Catalyst", 6),
    (68, "Bladesworn", 2),
    (69, "Vindicator", 9),
    (70, "Mechanist", 3),
    (71, "Specter", 5),
    (72, "Untamed", 4),
    (73, "Troubadour", 7),
    (74, "Paragon", 2),
    (75, "Amalgam", 3),
    (76, "Ritualist", 8),
    (77, "Antiquary", 5),
    (78, "Galeshot", 4),
    (79, "Conduit", 9),
    (80, "Evoker", 6),
    (81, "Luminary", 1),
]
SPEC_NAMES = {code: name for code, name, _ in SPECIALISATIONS}
SPEC_PROFESSION = {code: prof for code, _, prof in SPECIALISATIONS}

# --- fixed values: default role per profession and per specialisation ----
PROFESSION_HINT = {
    "Guardian": "BOON",
    "Warrior": "DPS",
    "Engineer": "HEAL",
    "Ranger": "DPS",
    "Thief": "DPS",
    "Elementalist": "DPS",
    "Mesmer": "DPS",
    "Necromancer": "DPS",
    "Revenant": "BOON",
}
SPEC_HINT = {
    "Firebrand": "BOON",
    "Chronomancer": "BOON",
    "Herald": "BOON",
    "Harbinger": "BOON",
    "Catalyst": "BOON",
    "Druid": "HEAL",
    "Tempest": "HEAL",
    "Scourge": "HEAL",
    "Specter": "HEAL",
    "Spellbreaker": "STRIP",
    "Reaper": "STRIP",
    "Berserker": "DPS",
    "Soulbeast": "DPS",
    "Untamed": "DPS",
    "Dragonhunter": "DPS",
    "Weaver": "DPS",
    "Willbender": "DPS",
    "Vindicator": "DPS",
    "Daredevil": "DPS",
    "Deadeye": "DPS",
    "Mechanist": "DPS",
    "Mirage": "DPS",
    "Virtuoso": "DPS",
}
# --- fixed values: roles a specialisation can play -----------------------
SPEC_CAPABILITIES = {
    "Berserker": ["DPS"],
    "Spellbreaker": ["DPS", "STRIP"],
    "Dragonhunter": ["DPS"],
    "Firebrand": ["DPS", "BOON", "HEAL"],
    "Willbender": ["DPS"],
    "Herald": ["DPS", "BOON"],
    "Renegade": ["DPS", "BOON"],
    "Vindicator": ["DPS"],
    "Daredevil": ["DPS"],
    "Deadeye": ["DPS"],
    "Specter": ["DPS", "HEAL"],
    "Scrapper": ["DPS", "HEAL"],
    "Holosmith": ["DPS"],
    "Mechanist": ["DPS", "BOON"],
    "Druid": ["DPS", "HEAL"],
    "Soulbeast": ["DPS"],
    "Untamed": ["DPS"],
    "Tempest": ["DPS", "HEAL"],
    "Weaver": ["DPS"],
    "Catalyst": ["DPS", "BOON"],
    "Chronomancer": ["DPS", "BOON"],
    "Mirage": ["DPS"],
    "Virtuoso": ["DPS", "STRIP"],
    "Reaper": ["DPS", "STRIP"],
    "Scourge": ["DPS", "BOON", "HEAL", "STRIP"],
    "Harbinger": ["DPS", "BOON"],
}

# --- fixed values: role heuristic ----------------------------------------
EFFORT_WEIGHTS = {"damage": 1.0, "healing": 2.5, "strip": 5000.0}
PURE_SHARE = {"DPS": 0.65, "HEAL": 0.50, "STRIP": 0.35}
HIGH_SHARE = {"high_dps": 0.85, "high_healing": 0.75, "high_strips": 0.60}
HINT_SHARE = 0.30
HEALER_OVERRIDE_SHARE = 0.20
BOON_WEIGHTS = {
    "quickness": 1.5,
    "alacrity": 1.5,
    "stability": 1.0,
    "resistance": 1.0,
    "aegis": 0.5,
    "protection": 0.5,
    "might": 0.2,
}
BOON_MINIMUM = 150_000.0
ROLE_LABELS = {"HEAL": "Heal", "BOON": "Support", "STRIP": "Strip", "DPS": "DPS"}

# --- fixed values: tracked boons, name -> buff id -------------------------
TRACKED_BOONS = {
    "might": 740,
    "fury": 725,
    "quickness": 1187,
    "alacrity": 30328,
    "protection": 717,
    "regeneration": 718,
    "vigor": 726,
    "aegis": 743,
    "stability": 1122,
    "swiftness": 719,
    "resistance": 26980,
    "resolution": 873,
    "superspeed": 5974,
    "stealth": 13017,
}
INTENSITY_BOONS = ["might", "stability"]
# --- fixed values: stack capacity per tracked boon ------------------------
BOON_CAPACITY = {
    "might": 25,
    "stability": 25,
    "regeneration": 15,
    "stealth": 9,
    "fury": 15,
    "quickness": 15,
    "alacrity": 9,
    "protection": 15,
    "vigor": 9,
    "aegis": 9,
    "swiftness": 15,
    "resistance": 9,
    "resolution": 15,
    "superspeed": 9,
}
REMOVAL_TOLERANCE_MS = 15
DESPAWN_GRACE_MS = 10

# --- fixed values: the six boon columns of the readout --------------------
READOUT_BOONS = {
    "stability": 1122,
    "alacrity": 30328,
    "resistance": 894,
    "aegis": 743,
    "superspeed": 597,
    "stealth": 1305,
}

# --- fixed values: buff categories ----------------------------------------
BOON_IDS = [740, 725, 717, 718, 719, 726, 743, 1122, 1187, 873, 5974, 30336, 13017, 26980]
DAMAGING_CONDITION_IDS = [736, 737, 721, 722, 723]
CONTROL_CONDITION_IDS = [727, 728, 730, 731, 732, 733, 734, 735, 742]
CONDITION_SKILL_NAMES = ["Bleeding", "Burning", "Confusion", "Poisoned", "Torment"]

# --- fixed values: record codes -------------------------------------------
HIT_RESULTS = [0, 1, 2, 8, 10]
ABSORB_RESULT = 6
MAGNITUDE_CEILING = 2147483647
SPLIT_BUILD = 20240501
RECODED_BUILD = 20260507
MODERN_BUILD = 20250000
HEAL_EXTENSION_SIGNATURE = 0x9C9B3C99
FIXED_OWNER_GUID = "28346F32FD199C4B8F9B15438F27A434"
CAST_START_CODES = [1, 2]
SWAP_SKILL_ID = -2
