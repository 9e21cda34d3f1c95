"""Time windows, timelines, profiles, paging and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frayline.functions.names import profession_code
from frayline.operators import profiles, rollups, summaries, timelines
from frayline.plans.registry import query
from frayline.plans.rollup_queries import rounded
from frayline.sources.corpus import Corpus

HOUR = 3600
_SUMS = """CAST(coalesce(sum(damage), 0) AS BIGINT) AS total_damage, CAST(coalesce(sum(healing), 0) AS BIGINT) AS total_healing,
      CAST(coalesce(sum(buff_removal), 0) AS BIGINT) AS total_buff_removal"""
_COALESCED = ", ".join(f"coalesce({t}, 0) AS {t}" for t in timelines.TOTALS)
_EDGES = "bucket * 3600000 AS start_ms, (bucket + 1) * 3600000 AS end_ms"


def _window_sql(where: str, count: bool) -> str:
    return f"""
    WITH b AS (SELECT fight_id, time_ms // 3600000 AS bucket, count(*) AS event_count, {_SUMS} FROM ev {where} GROUP BY 1, 2),
    fr AS (SELECT fight_id, unnest(generate_series(0, max(bucket))) AS bucket FROM b GROUP BY fight_id)
    SELECT fr.fight_id, fr.bucket, fr.{_EDGES.replace('(bucket', '(fr.bucket')}, {_COALESCED}
      {', coalesce(event_count, 0) AS event_count' if count else ''}
    FROM fr LEFT JOIN b ON fr.fight_id = b.fight_id AND fr.bucket = b.bucket"""


_ACTING = "WHERE event_type IN ('DAMAGE', 'HEALING', 'BUFF_REMOVAL')"


@query("V7", "SELECT fight_id, max(time_ms // 5000) + 1 AS buckets FROM ev GROUP BY 1 HAVING max(time_ms // 5000) + 1 > 10000")
def oversized_timelines(c: Corpus) -> DataFrame:
    """Fights with more than 10,000 windows of 5 s."""
    return timelines.oversized(c.events(), bound=10_000)


@query("W1 V5", _window_sql("", True))
def event_windows(c: Corpus) -> DataFrame:
    return timelines.event_windows(c.events(), HOUR)


def _fight_timeline(c: Corpus) -> DataFrame:
    return timelines.fight_timeline(c.events(rollups.ACTION_KINDS), HOUR)


@query("W2", _window_sql(_ACTING, False))
def fight_timeline(c: Corpus) -> DataFrame:
    return _fight_timeline(c)


@query("W3 V6", f"""
    WITH b AS (SELECT e.fight_id, account_name, time_ms // 3600000 AS bucket, {_SUMS} FROM ev e
               JOIN players p ON e.fight_id = p.fight_id AND e.source_agent_id = p.agent_id GROUP BY 1, 2, 3),
    acc AS (SELECT fight_id, account_name, CAST(sum(total_damage) AS BIGINT) AS account_damage FROM b GROUP BY 1, 2),
    lst AS (SELECT fight_id, max(bucket) AS last_bucket FROM b GROUP BY 1),
    fr AS (SELECT acc.fight_id, account_name, account_damage, unnest(generate_series(0, last_bucket)) AS bucket
           FROM acc JOIN lst ON acc.fight_id = lst.fight_id)
    SELECT fr.fight_id, fr.account_name, account_damage, fr.bucket, fr.bucket * 3600000 AS start_ms,
           (fr.bucket + 1) * 3600000 AS end_ms, {_COALESCED}
    FROM fr LEFT JOIN b ON fr.fight_id = b.fight_id AND fr.account_name = b.account_name AND fr.bucket = b.bucket""")
def player_timelines(c: Corpus) -> DataFrame:
    return timelines.player_timelines(c.events(), c.players(), HOUR)


CONTRIB = f"""SELECT e.fight_id, account_name, min(agent_id) AS seq, min_by(name, agent_id) AS name,
      min_by(profession, agent_id) AS profession, min_by(elite, agent_id) AS elite, {_SUMS}
      FROM ev e JOIN players p ON e.fight_id = p.fight_id AND e.source_agent_id = p.agent_id {_ACTING} GROUP BY 1, 2"""


def contributions(c: Corpus) -> DataFrame:
    return summaries.contributions(c.events(rollups.ACTION_KINDS), c.players())


def points(c: Corpus) -> DataFrame:
    rows = contributions(c).join(c.fights().select("fight_id", "started_at"), "fight_id")
    return rows.select("account_name", "fight_id", "started_at", "name", "profession", *timelines.TOTALS)


@query("contributions", CONTRIB)
def account_contributions(c: Corpus) -> DataFrame:
    return contributions(c)


_TZ = "America/New_York"
_DAYS = f"""SELECT account_name, local_day, arg_max(fight_id, struct_pack(a := started_at, b := fight_id)) AS fight_id,
      CAST(sum(total_damage) AS BIGINT) AS total_damage, CAST(sum(total_healing) AS BIGINT) AS total_healing,
      CAST(sum(total_buff_removal) AS BIGINT) AS total_buff_removal,
      min(started_at) AS first_started
      FROM (SELECT cc.*, started_at, CAST(started_at - INTERVAL 5 HOUR AS DATE) AS local_day
            FROM contrib cc JOIN fights f ON cc.fight_id = f.fight_id) x GROUP BY 1, 2"""


def _day_points(c: Corpus) -> DataFrame:
    return timelines.day_points(points(c), _TZ)


@query("W4", f"""
    WITH contrib AS ({CONTRIB}), dys AS ({_DAYS})
    SELECT account_name, strftime(local_day, '%Y-%m-%d') AS local_day, fight_id, total_damage, total_healing, total_buff_removal,
      strftime(CAST(local_day AS TIMESTAMP) + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M') AS started_at FROM dys""")
def account_days(c: Corpus) -> DataFrame:
    # January in New York is UTC-5 throughout, which is what the SQL twin uses
    rows = _day_points(c)
    return rows.withColumns(
        {
            "local_day": F.date_format("local_day", "yyyy-MM-dd"),
            "started_at": F.date_format("started_at", "yyyy-MM-dd HH:mm"),
        }
    )


@query("W5 J3 T8", f"""
    WITH contrib AS ({CONTRIB})
    SELECT account_name, cc.fight_id, strftime(started_at, '%Y-%m-%d %H:%M') AS started_at, total_damage, total_healing, total_buff_removal,
      row_number() OVER (PARTITION BY account_name ORDER BY started_at DESC, cc.fight_id DESC) AS position,
      count(*) OVER (PARTITION BY account_name) AS total_points
    FROM contrib cc JOIN fights f ON cc.fight_id = f.fight_id
    QUALIFY position <= 10""")
def account_timeline_page(c: Corpus) -> DataFrame:
    """Newest ten points of every account with the account's total point count."""
    rows = points(c).withColumn("order_key", F.concat(F.date_format("started_at", "yyyyMMddHHmm"), "fight_id"))
    counts = rows.groupBy("account_name").agg(F.count(F.lit(1)).alias("total_points"))
    top = profiles.top_per_key(rows, ["account_name"], "order_key", "fight_id", 10)
    return top.join(counts, "account_name").select(
        "account_name", "fight_id", F.date_format("started_at", "yyyy-MM-dd HH:mm").alias("started_at"),
        *timelines.TOTALS, F.col("rank").alias("position"), "total_points",
    )


@query("W6 U5", f"""
    WITH contrib AS ({CONTRIB}), pts AS (SELECT cc.*, started_at FROM contrib cc JOIN fights f ON cc.fight_id = f.fight_id),
    req AS (SELECT * FROM (VALUES (0, 'acct.3'), (1, 'acct.1'), (2, 'acct.none')) AS r(position, account_name)),
    nw AS (SELECT account_name, count(*) AS point_count, arg_max(name, struct_pack(a := started_at, b := fight_id)) AS display_name
           FROM pts GROUP BY 1)
    SELECT req.account_name, position, display_name, coalesce(point_count, 0) AS point_count, fight_id,
      strftime(started_at, '%Y-%m-%d %H:%M') AS started_at, total_damage, total_healing, total_buff_removal
    FROM req LEFT JOIN nw ON req.account_name = nw.account_name LEFT JOIN pts ON req.account_name = pts.account_name""")
def cross_account_timelines(c: Corpus) -> DataFrame:
    wanted = timelines.requested_accounts(c.spark, ["acct.3", ":acct.1", "acct.none", "acct.3"])
    rows = timelines.compare_accounts(points(c).drop("profession"), wanted)
    return rows.withColumn("started_at", F.date_format("started_at", "yyyy-MM-dd HH:mm"))


@query("W7", f"""
    WITH contrib AS ({CONTRIB}), dys AS (SELECT * FROM ({_DAYS}) x WHERE account_name IN ('acct.1', 'acct.3'))
    SELECT a.account_name, strftime(d.local_day, '%Y-%m-%d') AS local_day, dys.total_damage
    FROM (SELECT DISTINCT local_day FROM dys) d CROSS JOIN (SELECT unnest(['acct.3', 'acct.1', 'acct.none']) AS account_name) a
    LEFT JOIN dys ON dys.account_name = a.account_name AND dys.local_day = d.local_day""")
def aligned_account_days(c: Corpus) -> DataFrame:
    wanted = timelines.requested_accounts(c.spark, ["acct.3", ":acct.1", "acct.none"])
    rows = timelines.aligned_days(_day_points(c), wanted)
    return rows.withColumn("local_day", F.date_format("local_day", "yyyy-MM-dd"))


@query("W12", f"""
    WITH contrib AS ({CONTRIB}), dys AS ({_DAYS}), al AS (
      SELECT a.account_name, d.local_day, dys.total_damage
      FROM (SELECT DISTINCT local_day FROM dys) d CROSS JOIN (SELECT DISTINCT account_name FROM dys) a
      LEFT JOIN dys ON dys.account_name = a.account_name AND dys.local_day = d.local_day),
    rr AS (SELECT *, count(*) FILTER (total_damage IS NULL) OVER (PARTITION BY account_name ORDER BY local_day) AS run FROM al)
    SELECT account_name, strftime(min(local_day), '%Y-%m-%d') AS run_start, strftime(max(local_day), '%Y-%m-%d') AS run_end,
      count(*) AS points FROM rr WHERE total_damage IS NOT NULL GROUP BY account_name, run""")
def account_day_runs(c: Corpus) -> DataFrame:
    rows = timelines.day_runs(_day_points(c)).drop("run")
    return rows.withColumns({n: F.date_format(n, "yyyy-MM-dd") for n in ("run_start", "run_end")})


_TEN_MIN = f"""b AS (SELECT fight_id, time_ms // 600000 AS bucket, {_SUMS} FROM ev {_ACTING} GROUP BY 1, 2),
    fr AS (SELECT fight_id, unnest(generate_series(0, max(bucket))) AS bucket FROM b GROUP BY fight_id),
    tl AS (SELECT fr.fight_id, fr.bucket, fr.bucket * 600000 AS start_ms, (fr.bucket + 1) * 600000 AS end_ms, {_COALESCED}
           FROM fr LEFT JOIN b ON fr.fight_id = b.fight_id AND fr.bucket = b.bucket)"""


def _ten_minutes(c: Corpus) -> DataFrame:
    return timelines.fight_timeline(c.events(rollups.ACTION_KINDS), 600)


@query("W8", f"""
    WITH {_TEN_MIN}, n AS (SELECT fight_id, max(bucket) + 1 AS n FROM tl GROUP BY 1)
    SELECT tl.fight_id, bucket // CAST(greatest(ceil(n / 50), 1) AS BIGINT) AS point, min(start_ms) AS start_ms, max(end_ms) AS end_ms,
      CAST(sum(total_damage) AS BIGINT) AS total_damage, CAST(sum(total_healing) AS BIGINT) AS total_healing
    FROM tl JOIN n ON tl.fight_id = n.fight_id GROUP BY 1, 2""")
def timeline_points(c: Corpus) -> DataFrame:
    return timelines.rebucket(_ten_minutes(c), ["fight_id"], ["total_damage", "total_healing"], 50)


@query("W9", f"""
    WITH {_TEN_MIN}, act AS (SELECT *, lag(end_ms) OVER (PARTITION BY fight_id ORDER BY start_ms) AS gap_start_ms
      FROM tl WHERE total_damage + total_healing + total_buff_removal > 0)
    SELECT fight_id, gap_start_ms, start_ms AS gap_end_ms, start_ms - gap_start_ms AS gap_ms, (gap_start_ms + start_ms) // 2 AS midpoint_ms
    FROM act WHERE start_ms - gap_start_ms > 30000""")
def timeline_gaps(c: Corpus) -> DataFrame:
    return timelines.activity_gaps(_ten_minutes(c), ["fight_id"])


@query("W10", f"""
    WITH {_TEN_MIN}, a AS (SELECT fight_id, min(bucket) FILTER (total_damage + total_healing + total_buff_removal > 0) AS f,
      max(bucket) FILTER (total_damage + total_healing + total_buff_removal > 0) AS l FROM tl GROUP BY 1)
    SELECT tl.* FROM tl JOIN a ON tl.fight_id = a.fight_id WHERE bucket BETWEEN f - 1 AND l + 1""")
def trimmed_timeline(c: Corpus) -> DataFrame:
    return timelines.trim_inactive(_ten_minutes(c), ["fight_id"])


@query("W11", f"""
    WITH {_TEN_MIN}, mx AS (SELECT fight_id, max(greatest(total_damage, total_healing)) AS top FROM tl GROUP BY 1)
    SELECT tl.fight_id, bucket, round(log10(total_damage + 1) / log10(greatest(top, 1) + 1), 6) AS total_damage_scaled,
      round(log10(total_healing + 1) / log10(greatest(top, 1) + 1), 6) AS total_healing_scaled
    FROM tl JOIN mx ON tl.fight_id = mx.fight_id""")
def log_scaled_timeline(c: Corpus) -> DataFrame:
    rows = timelines.log_scaled(_ten_minutes(c), ["fight_id"], ["total_damage", "total_healing"])
    return rounded(rows, "total_damage_scaled", "total_healing_scaled").select(
        "fight_id", "bucket", "total_damage_scaled", "total_healing_scaled"
    )


# -- profiles ---------------------------------------------------------------------
@query("A21 V8", f"""
    WITH contrib AS ({CONTRIB})
    SELECT account_name, count(*) AS fights_attended, CAST(sum(total_damage) AS BIGINT) AS total_damage,
      CAST(sum(total_healing) AS BIGINT) AS total_healing, CAST(sum(total_buff_removal) AS BIGINT) AS total_buff_removal,
      arg_min(profession, fight_id) AS profession, arg_min(elite, fight_id) AS elite, arg_max(name, fight_id) AS name
    FROM contrib GROUP BY 1""")
def player_profiles(c: Corpus) -> DataFrame:
    return profiles.profiles(contributions(c))


@query("A21 M5", f"WITH contrib AS ({CONTRIB}) SELECT DISTINCT account_name, fight_id FROM contrib")
def attended_fights(c: Corpus) -> DataFrame:
    return profiles.attended_fights(contributions(c))


_MODAL = """pc AS (SELECT account_name, profession, count(*) AS n FROM contrib GROUP BY 1, 2),
    md AS (SELECT account_name, profession FROM (SELECT *, row_number() OVER (PARTITION BY account_name ORDER BY n DESC, profession) AS rn FROM pc) x WHERE rn = 1),
    pf AS (SELECT contrib.account_name, max(name) AS name, md.profession, max(elite) AS elite, count(*) AS fights_attended,
      CAST(sum(total_damage) AS BIGINT) AS total_damage, CAST(sum(total_healing) AS BIGINT) AS total_healing,
      CAST(sum(total_buff_removal) AS BIGINT) AS total_buff_removal
      FROM contrib JOIN md ON contrib.account_name = md.account_name GROUP BY contrib.account_name, md.profession)"""


@query("A31 N1", f"WITH contrib AS ({CONTRIB}), {_MODAL} SELECT * FROM pf")
def modal_profiles(c: Corpus) -> DataFrame:
    return profiles.modal_profiles(contributions(c))


@query("A31 T1 C21", f"""
    WITH contrib AS ({CONTRIB}), {_MODAL} SELECT * FROM pf ORDER BY total_damage DESC, account_name LIMIT 20 OFFSET 10""")
def profile_page(c: Corpus) -> DataFrame:
    rows = profiles.modal_profiles(contributions(c))
    return profiles.page(rows, [F.col("total_damage").desc(), F.col("account_name").asc()], 20, 10)


@query("C21 A31", f"WITH contrib AS ({CONTRIB}), {_MODAL} SELECT * FROM pf WHERE profession = 3")
def profiles_of_profession(c: Corpus) -> DataFrame:
    """Profiles whose modal profession is the named one."""
    return profiles.modal_profiles(contributions(c), profession=profession_code("Engineer"))


@query("T2", f"""
    WITH contrib AS ({CONTRIB}), {_MODAL} SELECT * FROM pf
    WHERE total_damage < 100000 OR (total_damage = 100000 AND account_name > 'acct.5')
    ORDER BY total_damage DESC, account_name LIMIT 26""")
def profile_keyset_page(c: Corpus) -> DataFrame:
    cursor = profiles.encode_cursor(100000, "acct.5")
    return profiles.keyset_page(profiles.modal_profiles(contributions(c)), 25, cursor).drop("next_cursor")


@query("A34", f"""
    WITH contrib AS ({CONTRIB}), pts AS (SELECT cc.*, started_at FROM contrib cc JOIN fights f ON cc.fight_id = f.fight_id)
    SELECT account_name, count(*) AS fights, CAST(sum(total_damage) AS BIGINT) AS total_damage,
      CAST(sum(total_healing) AS BIGINT) AS total_healing, CAST(sum(total_buff_removal) AS BIGINT) AS total_buff_removal,
      arg_max(name, struct_pack(a := started_at, b := fight_id)) AS name,
      arg_max(profession, struct_pack(a := started_at, b := fight_id)) AS profession FROM pts GROUP BY 1""")
def account_totals(c: Corpus) -> DataFrame:
    return profiles.account_totals(points(c))


@query("T3", """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fight_id ORDER BY total_damage DESC, target_agent_id) AS rank
      FROM (SELECT fight_id, target_agent_id, CAST(sum(damage) AS BIGINT) AS total_damage, count(*) AS hit_count
            FROM ev WHERE event_type = 'DAMAGE' GROUP BY 1, 2) r) x WHERE rank <= 100""")
def top_targets(c: Corpus) -> DataFrame:
    rows = c.events(["DAMAGE"]).groupBy("fight_id", "target_agent_id").agg(
        F.sum("damage").alias("total_damage"), F.count(F.lit(1)).alias("hit_count")
    )
    return profiles.top_per_key(rows, ["fight_id"], "total_damage", "target_agent_id", 100)


def _top_sql(kind: str, value: str, key: str) -> str:
    return f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fight_id ORDER BY total DESC, {key}) AS rank
      FROM (SELECT fight_id, {key}, CAST(sum({value}) AS BIGINT) AS total FROM ev WHERE event_type = '{kind}' GROUP BY 1, 2) r) x WHERE rank <= 100"""


def _top(c: Corpus, kind: str, value: str, key: str) -> DataFrame:
    rows = c.events([kind]).groupBy("fight_id", key).agg(F.sum(value).alias("total"))
    return profiles.top_per_key(rows, ["fight_id"], "total", key, 100)


@query("T3", _top_sql("HEALING", "healing", "target_agent_id"))
def top_healed_targets(c: Corpus) -> DataFrame:
    return _top(c, "HEALING", "healing", "target_agent_id")


@query("T3", _top_sql("BUFF_REMOVAL", "buff_removal", "target_agent_id"))
def top_stripped_targets(c: Corpus) -> DataFrame:
    return _top(c, "BUFF_REMOVAL", "buff_removal", "target_agent_id")


@query("T3", _top_sql("DAMAGE", "damage", "skill_id"))
def top_damage_skills(c: Corpus) -> DataFrame:
    return _top(c, "DAMAGE", "damage", "skill_id")


@query("T3", """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fight_id, source_agent_id ORDER BY total DESC, skill_id) AS rank
      FROM (SELECT e.fight_id, source_agent_id, skill_id, CAST(sum(damage) AS BIGINT) AS total FROM ev e
        JOIN players p ON p.fight_id = e.fight_id AND p.agent_id = e.source_agent_id WHERE event_type = 'DAMAGE' GROUP BY 1, 2, 3) r) x WHERE rank <= 100""")
def top_player_skills(c: Corpus) -> DataFrame:
    """The 100 best skills of every player."""
    who = c.players().select("fight_id", F.col("agent_id").alias("source_agent_id"))
    rows = c.events(["DAMAGE"]).groupBy("fight_id", "source_agent_id", "skill_id").agg(F.sum("damage").alias("total"))
    return profiles.top_per_key(rows.join(who, ["fight_id", "source_agent_id"], "left_semi"), ["fight_id", "source_agent_id"], "total", "skill_id", 100)


@query("T1", """
    SELECT fight_id, strftime(started_at, '%Y-%m-%d %H:%M') AS started_at FROM (
      SELECT fight_id, started_at, row_number() OVER (ORDER BY started_at DESC, fight_id) AS position FROM fights) x WHERE position BETWEEN 6 AND 15""")
def fights_page(c: Corpus) -> DataFrame:
    """The second page after an offset of five: ten fights, newest first."""
    rows = profiles.page(c.fights().select("fight_id", "started_at"), [F.desc("started_at"), F.asc("fight_id")], offset=5, limit=10)
    return rows.select("fight_id", F.date_format("started_at", "yyyy-MM-dd HH:mm").alias("started_at"))


@query("T4", f"""
    WITH contrib AS ({CONTRIB}) SELECT * FROM (SELECT fight_id, account_name, total_healing,
      row_number() OVER (PARTITION BY fight_id ORDER BY total_healing DESC, account_name) AS rank FROM contrib) x WHERE rank <= 5""")
def top_series(c: Corpus) -> DataFrame:
    rows = contributions(c).select("fight_id", "account_name", "total_healing")
    return profiles.top_per_key(rows, ["fight_id"], "total_healing", "account_name", 5)


_SIX = ["total_damage", "total_healing", "total_buff_removal", "boon_strips", "condition_cleanses", "cc_applied"]


@query("T5", f"""
    WITH sd AS (SELECT e.*, account_name FROM ev e JOIN players p ON e.fight_id = p.fight_id AND e.source_agent_id = p.agent_id),
    sm AS (SELECT fight_id, account_name, CAST(coalesce(sum(damage), 0) AS BIGINT) AS total_damage, CAST(coalesce(sum(healing), 0) AS BIGINT) AS total_healing,
      CAST(coalesce(sum(buff_removal), 0) AS BIGINT) AS total_buff_removal,
      CAST(coalesce(sum(stacks) FILTER (kind <> 'apply' AND skill_id <> 50001), 0) + coalesce(sum(buff_removal), 0) AS BIGINT) AS boon_strips,
      CAST(coalesce(sum(stacks) FILTER (kind <> 'apply' AND skill_id = 50001), 0) AS BIGINT) AS condition_cleanses,
      count(*) FILTER (event_type = 'CC') AS cc_applied FROM sd GROUP BY 1, 2),
    lg AS (UNPIVOT sm ON {", ".join(_SIX)} INTO NAME metric VALUE value)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fight_id, metric ORDER BY value DESC, account_name) AS rank FROM lg WHERE value > 0) x WHERE rank <= 3""")
def six_cards(c: Corpus) -> DataFrame:
    """Top three accounts of each of the six card metrics."""
    rows = summaries.account_buckets(c.events(), c.players(), c.skills()).select("fight_id", "account_name", *[F.col(m).cast("bigint").alias(m) for m in _SIX])
    return profiles.top_per_metric(rows, ["fight_id"], "account_name", _SIX)


@query("T5", f"""
    WITH contrib AS ({CONTRIB}), lg AS (UNPIVOT (SELECT fight_id, account_name, total_damage, total_healing, total_buff_removal FROM contrib)
      ON total_damage, total_healing, total_buff_removal INTO NAME metric VALUE value)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fight_id, metric ORDER BY value DESC, account_name) AS rank FROM lg WHERE value > 0) x
    WHERE rank <= 3""")
def top_cards(c: Corpus) -> DataFrame:
    rows = contributions(c).select("fight_id", "account_name", *timelines.TOTALS)
    return profiles.top_per_metric(rows, ["fight_id"], "account_name", timelines.TOTALS)


_TARGET_UNION = "SELECT DISTINCT fight_id, target_agent_id FROM ev WHERE event_type IN ('DAMAGE', 'HEALING', 'BUFF_REMOVAL')"


@query("U1", _TARGET_UNION)
def known_targets(c: Corpus) -> DataFrame:
    parts = [c.events([k]).select("fight_id", "target_agent_id").distinct() for k in rollups.ACTION_KINDS]
    return profiles.union_of_targets(*parts)


@query("T10 N3", """
    SELECT r.fight_id, r.target_agent_id, coalesce(d, h, b) AS first_total, CASE WHEN d IS NOT NULL THEN 'damage' WHEN h IS NOT NULL THEN 'healing' ELSE 'removal' END AS first_source
    FROM (SELECT fight_id, target_agent_id, CAST(sum(damage) AS BIGINT) AS d, CAST(sum(healing) AS BIGINT) AS h, CAST(sum(buff_removal) AS BIGINT) AS b
          FROM ev WHERE event_type IN ('DAMAGE', 'HEALING', 'BUFF_REMOVAL') GROUP BY 1, 2) r""")
def target_lookup(c: Corpus) -> DataFrame:
    """First non-null value in precedence order damage, healing, removal for every target."""
    rows = c.events(rollups.ACTION_KINDS).groupBy("fight_id", "target_agent_id").agg(
        F.sum("damage").alias("d"), F.sum("healing").alias("h"), F.sum("buff_removal").alias("b")
    )
    source = F.when(F.col("d").isNotNull(), "damage").when(F.col("h").isNotNull(), "healing").otherwise("removal")
    return rows.select("fight_id", "target_agent_id", F.coalesce("d", "h", "b").alias("first_total"), source.alias("first_source"))


@query("U2", f"""
    WITH contrib AS ({CONTRIB}), pg AS (SELECT fight_id, account_name, total_damage FROM contrib WHERE total_damage > 0)
    SELECT * FROM pg UNION ALL
    SELECT fight_id, account_name, total_healing FROM contrib WHERE total_healing > 0
      AND NOT EXISTS (SELECT 1 FROM pg WHERE pg.fight_id = contrib.fight_id AND pg.account_name = contrib.account_name)""")
def merged_page(c: Corpus) -> DataFrame:
    rows = contributions(c)
    held = rows.filter("total_damage > 0").select("fight_id", "account_name", "total_damage")
    fresh = rows.filter("total_healing > 0").select("fight_id", "account_name", F.col("total_healing").alias("total_damage"))
    return profiles.merge_page(held, fresh, ["fight_id", "account_name"])


# stored summaries: every contribution whose fight drew a click-type heal larger than 30000
_STORED = f"""contrib AS ({CONTRIB}), st AS (SELECT * FROM contrib WHERE fight_id IN
      (SELECT fight_id FROM ev WHERE event_type = 'HEALING' AND healing > 15000))"""


def _stored(c: Corpus) -> DataFrame:
    big = c.events(["HEALING"]).filter("healing > 15000").select("fight_id").distinct()
    return contributions(c).join(big, "fight_id", "left_semi")


@query("J5", f"WITH {_STORED} SELECT fight_id FROM fights WHERE fight_id NOT IN (SELECT fight_id FROM st)")
def fights_without_summary(c: Corpus) -> DataFrame:
    return profiles.fights_without_summary(c.fights(), _stored(c)).select("fight_id")


@query("J20", f"""
    WITH {_STORED} SELECT * FROM st UNION ALL SELECT * FROM contrib WHERE fight_id NOT IN (SELECT fight_id FROM st)""")
def merged_contributions(c: Corpus) -> DataFrame:
    return profiles.merged_contributions(_stored(c), contributions(c))


@query("A32", f"""
    WITH {_STORED}, x AS (SELECT (SELECT count(*) FROM fights) AS total_fights, (SELECT count(DISTINCT fight_id) FROM st) AS fights_with_summaries)
    SELECT *, total_fights - fights_with_summaries AS drift_count,
      round((total_fights - fights_with_summaries) / total_fights * 100, 2) AS drift_pct,
      CASE WHEN total_fights = fights_with_summaries THEN 'ok' ELSE 'drift' END AS status FROM x""")
def summary_drift(c: Corpus) -> DataFrame:
    return profiles.summary_drift(c.fights(), _stored(c))


@query("A33", f"""
    WITH {_STORED}, x AS (SELECT (SELECT count(*) FROM fights) AS tf, (SELECT count(DISTINCT fight_id) FROM st) AS fs,
      (SELECT count(DISTINCT fight_id) FROM contrib) AS fc)
    SELECT tf - fc AS before, tf - fs AS after, fc - fs AS delta, fc - fs <= 2 AS passed FROM x""")
def drift_gate(c: Corpus) -> DataFrame:
    before = profiles.summary_drift(c.fights(), contributions(c))
    after = profiles.summary_drift(c.fights(), _stored(c))
    return profiles.drift_gate(before, after)


@query("J4", f"""
    WITH contrib AS ({CONTRIB}), gm AS (SELECT DISTINCT account_name, profession % 5 AS guild_id FROM contrib)
    SELECT DISTINCT gm.account_name, gm.guild_id, r_name AS guild_name, upper(substring(r_name, 1, 3)) AS tag
    FROM gm JOIN region ON r_regionkey = gm.guild_id""")
def account_guilds(c: Corpus) -> DataFrame:
    """Regions stand in for guilds, professions decide membership."""
    members = contributions(c).select("account_name", (F.col("profession") % 5).alias("guild_id"))
    guilds = c.table("region").select(
        F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"),
        F.upper(F.substring("r_name", 1, 3)).alias("tag"),
    )
    return profiles.guilds_of_accounts(members, guilds)
