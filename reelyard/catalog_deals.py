"""Queries of the whole deal of cards and of its check, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelyard.catalog import FAMILIES, _sql_eligible
from reelyard.jobs import adapters as A
from reelyard.operators import dealing, reports
from reelyard.queries import query, sql_list

_NAMES = {"in_place": dealing.IN_PLACE, "short": dealing.SHORT, "long": dealing.LONG}
_WEIGHTS = {1: 30, 2: 25, 3: 20, 4: 12, 5: 8, 6: 5}
AXES = {
    "small_venue_max_people": 3, "long_range_sizes": ["large"], "motion_ranges": {dealing.IN_PLACE: 3, dealing.SHORT: 4, dealing.LONG: 3},
    "weather_outdoor": [{"name": w, "hostile": w in ("rain", "snow", "fog")} for w in ("clear", "overcast", "rain", "haze", "snow", "dusk", "fog")],
    "lighting_indoor": ["tungsten", "window", "neon", "fluorescent"],
    "env_motion": [{"name": n, "where": w} for n, w in (("leaves", "outdoor"), ("flags", "both"), ("curtains", "indoor"), ("fountain", "both"), ("traffic", "outdoor"), ("fan", "indoor"))],
    "shares": {"hostile_weather_cap": 0.2, "still_env": 0.4, "crowd": 0.2, "close_approach": 0.15},
    "cameras": ["static", "pan left", "pan right", "dolly in", "dolly out", "orbit", "crane"], "vibes": ["calm", "tense", "festive", "playful", "solemn"],
    "bounce_ground_keywords": ["e", "steel"], "no_bounce_keywords": ["blue"], "holdout_suffixes": ["49", "99"],
    "action_families": [f | {"ranges": [_NAMES[r] for r in f["ranges"]]} for f in FAMILIES] + [
        {"name": "stand", "ranges": [dealing.IN_PLACE], "small_ok": True, "ice_ok": True},
        {"name": "stroll", "ranges": [dealing.SHORT, dealing.LONG], "small_ok": True, "ice_ok": True},
    ],
}


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, dict, DataFrame, DataFrame]:
    """Orders as cards, nations (25 rows) as regions, parts as archetypes with their tags."""
    cards = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    regions = [r["n_name"] for r in A.table(spark, d, "nation").select("n_name").collect()]
    axes = AXES | {"regions": regions, "person_count_plan": dealing.largest_remainder(_WEIGHTS, cards.count())}
    k, name = F.col("p_partkey"), F.col("p_partkey").cast("string").alias("name")
    size = F.when(F.col("p_size") <= 5, "small").when(F.col("p_size") <= 20, "medium").otherwise("large")
    surface = F.when(k % 8 == 0, "ice").when(k % 8 == 1, "water").when(k % 8 == 2, "reflective").otherwise("normal")
    parts = A.table(spark, d, "part")
    tags = parts.select(name, (k % 10 < 3).alias("indoor"), size.alias("size"), (k % 5 < 2).alias("audience_natural"), surface.alias("surface"), F.when(k % 4 != 1, k % 5 == 0).alias("low_ceiling"))
    return cards, axes, parts.select(name, F.lower("p_name").alias("ground")), tags


def _counts(name: str, source: str, n: str) -> str:
    """Exact counts by largest remainder of source (value, weight, pos), then each value's range of ranks."""
    return f"""{name}_x AS (SELECT value, pos, weight * ({n}) / CAST(sum(weight) OVER () AS DOUBLE) AS x FROM {source}),
{name} AS (SELECT value, pos, CAST(floor(x) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, pos) <= ({n}) - (SELECT CAST(sum(floor(x)) AS BIGINT) FROM {name}_x) THEN 1 ELSE 0 END AS c FROM {name}_x)"""


def _ranges(name: str, counts: str) -> str:
    return f"{name} AS (SELECT value, CAST(sum(c) OVER (ORDER BY pos) AS BIGINT) - c AS low, CAST(sum(c) OVER (ORDER BY pos) AS BIGINT) AS high FROM {counts})"


def _rank(stratum: str, salt: str) -> str:
    return f"row_number() OVER (PARTITION BY {stratum} ORDER BY md5(concat_ws('|', '0', '{salt}', CAST(id AS VARCHAR))), id) - 1"


def _turn(values: list[str], salt: str, at: str) -> str:
    return f"(SELECT list(v ORDER BY md5('0|{salt}|' || v), v) FROM (SELECT unnest({sql_list(values)}) AS v))[1 + ({at}) % {len(values)}]"


_HOSTILE, _MILD = ([w["name"] for w in AXES["weather_outdoor"] if w["hostile"] == flag] for flag in (True, False))
_MOVING = {w: dealing.allowed_motion(AXES, w) for w in ("indoor", "outdoor")}
_VALUES = "unnest([{}]) AS value, unnest([{}]) AS weight, unnest([{}]) AS pos"
_PEOPLE = _VALUES.format(*(", ".join(map(str, x)) for x in (_WEIGHTS, _WEIGHTS.values(), range(6))))
_REACH = _VALUES.format(", ".join(f"'{r}'" for r in AXES["motion_ranges"]), "3, 4, 3", "0, 1, 2")
_DEALT = f"""vocabulary AS (SELECT CAST(p_partkey AS VARCHAR) AS archetype, lower(p_name) AS ground, p_partkey % 10 < 3 AS indoor, CASE WHEN p_size <= 5 THEN 'small' WHEN p_size <= 20 THEN 'medium' ELSE 'large' END AS size, p_partkey % 5 < 2 AS natural_crowd,
  CASE p_partkey % 8 WHEN 0 THEN 'ice' WHEN 1 THEN 'water' WHEN 2 THEN 'reflective' ELSE 'normal' END AS surface, p_partkey % 4 <> 1 AND p_partkey % 5 = 0 AS low_ceiling FROM part),
regions AS (SELECT n_name AS region, row_number() OVER (ORDER BY md5('0|region|' || n_name), n_name) - 1 AS i FROM nation), kinds AS (SELECT archetype, row_number() OVER (ORDER BY md5('0|archetype|' || archetype), archetype) - 1 AS i FROM vocabulary),
o AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS rank FROM orders),
placed AS (SELECT id, region, v.*, size = 'small' AS small, size = 'large' AS far FROM o JOIN regions g ON rank // ((SELECT count(*) FROM orders) // (SELECT count(*) FROM nation)) = g.i JOIN kinds k ON rank % (SELECT count(*) FROM part) = k.i JOIN vocabulary v USING (archetype)),
n AS (SELECT count(*) AS total, count(*) FILTER (small) AS small, count(*) FILTER (NOT far) AS near, count(*) FILTER (indoor) AS inside, count(*) FILTER (NOT indoor) AS outside, count(*) FILTER (natural_crowd) AS crowds FROM placed),
people AS (SELECT {_PEOPLE}), {_counts("plan", "people", "SELECT total FROM n")},
few_w AS (SELECT value, c AS weight, pos FROM plan WHERE value <= 3), {_counts("few", "few_w", "SELECT small FROM n")}, many AS (SELECT value, pos, plan.c - coalesce(few.c, 0) AS c FROM plan LEFT JOIN few USING (value, pos)), {_ranges("few_r", "few")}, {_ranges("many_r", "many")},
reaches AS (SELECT {_REACH}), {_counts("target", "reaches", "SELECT total FROM n")}, near_w AS (SELECT * FROM reaches WHERE pos < 2), {_counts("near", "near_w", "SELECT near FROM n")},
far AS (SELECT value, pos, target.c - coalesce(near.c, 0) AS c FROM target LEFT JOIN near USING (value, pos)), {_ranges("near_r", "near")}, {_ranges("far_r", "far")},
ranked AS (SELECT *, {_rank("small", "person_count")} AS rp, {_rank("far", "motion_range")} AS rm, {_rank("indoor", "lighting")} AS rl, {_rank("indoor", "env_motion")} AS re, {_rank("true", "camera")} AS rc, {_rank("true", "vibe")} AS rv, {_rank("natural_crowd", "crowd")} AS rf FROM placed),
decks AS (SELECT id, region, archetype, ground, indoor, size, natural_crowd, surface, low_ceiling, CASE WHEN small THEN (SELECT value FROM few_r WHERE rp >= low AND rp < high) ELSE (SELECT value FROM many_r WHERE rp >= low AND rp < high) END AS person_count,
  CASE WHEN far THEN (SELECT value FROM far_r WHERE rm >= low AND rm < high) ELSE (SELECT value FROM near_r WHERE rm >= low AND rm < high) END AS motion_range,
  CASE WHEN indoor THEN {_turn(AXES["lighting_indoor"], "lighting.indoor", "rl")} WHEN rl < round_even(CAST(0.2 AS DOUBLE) * (SELECT outside FROM n), 0) THEN {_turn(_HOSTILE, "lighting.True", "rl")} ELSE {_turn(_MILD, "lighting.False", "rl - CAST(round_even(CAST(0.2 AS DOUBLE) * (SELECT outside FROM n), 0) AS BIGINT)")} END AS lighting,
  CASE WHEN re < round_even(CAST(0.4 AS DOUBLE) * CASE WHEN indoor THEN (SELECT inside FROM n) ELSE (SELECT outside FROM n) END, 0) THEN 'still' WHEN indoor THEN {_turn(_MOVING["indoor"], "env_motion.indoor", "re - CAST(round_even(CAST(0.4 AS DOUBLE) * (SELECT inside FROM n), 0) AS BIGINT)")}
    ELSE {_turn(_MOVING["outdoor"], "env_motion.outdoor", "re - CAST(round_even(CAST(0.4 AS DOUBLE) * (SELECT outside FROM n), 0) AS BIGINT)")} END AS env_motion,
  {_turn(AXES["cameras"], "camera", "rc")} AS camera, {_turn(AXES["vibes"], "vibe", "rv")} AS vibe, natural_crowd AND rf < least(round_even(CAST(0.2 AS DOUBLE) * (SELECT total FROM n), 0), (SELECT crowds FROM n)) AS crowd,
  NOT contains(ground, 'blue') AND (contains(ground, 'e') OR contains(ground, 'steel')) AS hard_ground, CAST(id AS VARCHAR) LIKE '%49' OR CAST(id AS VARCHAR) LIKE '%99' AS holdout FROM ranked),
dealt AS (SELECT *, motion_range <> 'in_place' AND {_rank("motion_range <> 'in_place'", "close_approach")} < least(round_even(CAST(0.15 AS DOUBLE) * (SELECT total FROM n), 0), (SELECT sum(c) FROM target WHERE value <> 'in_place')) AS close_approach FROM decks)"""
_DECKS = ("id", "region", "archetype", "person_count", "motion_range", "lighting", "env_motion", "camera", "vibe", "crowd", "hard_ground", "close_approach", "holdout")


@query(f"WITH {_DEALT} SELECT {', '.join(_DECKS)} FROM dealt")
def dealt_decks(spark: SparkSession, d: str) -> DataFrame:
    """A card for each order: all its decks, which SQL repeats; dealt_cards adds the families."""
    return dealing.deal_decks(*_inputs(spark, d)).select(*_DECKS)


@query()
def dealt_cards(spark: SparkSession, d: str) -> DataFrame:
    """The whole deal, whose families are balanced card set by card set; tests hold it against the rules of a deal."""
    return dealing.deal_cards(*_inputs(spark, d)).select(*_DECKS, "action_family")


def _sql_hash01(seed: int, salt: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', '{salt}', CAST(id AS VARCHAR))), 1, 8) AS BIGINT) / 4294967296.0"


def _redeal(name: str, source: str, round_: int) -> str:
    draw = lambda axis: _sql_hash01(round_, f"redeal{round_}.{axis}")
    pick = lambda values, axis: f"{sql_list(values)}[1 + CAST(floor({draw(axis)} * {len(values)}) AS BIGINT)]"
    fits = lambda source: ", ".join(f"CASE WHEN {_sql_eligible(f)} THEN '{f['name']}' END" for f in source)
    families = fits(AXES["action_families"])
    flag = f"md5(concat_ws('|', 'flag{round_}', CAST(id AS VARCHAR)))"
    return f"""{name}_f AS (SELECT *, CASE WHEN {flag}[1:2] = '00' THEN 'an Audience in the dark' WHEN {flag}[1:1] = '0' THEN 'too dark' END AS reason FROM {source}),
{name}_d AS (SELECT * REPLACE (CASE WHEN indoor THEN {pick(AXES["lighting_indoor"], "lighting")} ELSE {pick([w["name"] for w in AXES["weather_outdoor"]], "lighting")} END AS lighting,
  CASE WHEN {draw("still")} < 0.4 THEN 'still' WHEN indoor THEN {pick(_MOVING["indoor"], "env")} ELSE {pick(_MOVING["outdoor"], "env")} END AS env_motion,
  CASE WHEN size = 'large' THEN {pick(["in_place", "short_range", "long_range"], "range")} ELSE {pick(["in_place", "short_range"], "range")} END AS motion_range, {pick(AXES["cameras"], "camera")} AS camera) FROM {name}_f WHERE reason IS NOT NULL),
{name}_m AS (SELECT *, list_sort(list_filter([{families}], lambda x: x IS NOT NULL)) AS moving FROM {name}_d), {name}_s AS (SELECT * REPLACE (CASE WHEN len(moving) = 0 THEN 'in_place' ELSE motion_range END AS motion_range) FROM {name}_m),
{name}_p AS (SELECT *, list_sort(list_filter([{families}], lambda x: x IS NOT NULL)) AS fit FROM {name}_s),
{name} AS (SELECT * EXCLUDE (reason) FROM {name}_f WHERE reason IS NULL UNION ALL BY NAME SELECT * EXCLUDE (reason, moving, fit) REPLACE (fit[1 + CAST(floor({draw("family")} * len(fit)) AS BIGINT)] AS action_family, close_approach AND motion_range <> 'in_place' AS close_approach, crowd AND natural_crowd AND NOT contains(lower(reason), 'audience') AS crowd) FROM {name}_p)"""


_CHECKED = ("id", "person_count", "motion_range", "lighting", "env_motion", "camera", "crowd", "close_approach", "action_family")


@query(f"WITH {_DEALT}, start AS (SELECT *, 'undealt' AS action_family FROM dealt), {_redeal('once', 'start', 1)}, {_redeal('twice', 'once', 2)} SELECT {', '.join(_CHECKED)} FROM twice")
def prechecked_cards(spark: SparkSession, d: str) -> DataFrame:
    """The decks after two rounds of a check that flags one card in sixteen by its hash; cards that it flags get a family."""

    def check(cards: DataFrame, round_: int) -> DataFrame:
        h = F.md5(F.concat_ws("|", F.lit(f"flag{round_}"), F.col("id").cast("string")))
        reason = F.when(h.substr(1, 2) == "00", "an Audience in the dark").otherwise("too dark")
        flagged = cards.where(h.substr(1, 1) == "0").select(F.lit(1).alias("batch"), F.lit(0).alias("item"), "id", reason.alias("reason"))
        return flagged.unionByName(flagged.withColumns({"batch": F.lit(0), "reason": F.lit("the crowd is odd")}))  # what a later batch says wins

    cards, axes, archetypes, tags = _inputs(spark, d)
    dealt = dealing.deal_decks(cards, axes, archetypes, tags).withColumn("action_family", F.lit("undealt"))
    return dealing.precheck(dealt, check, axes)[0].select(*_CHECKED)


_VIOLATIONS = """count(*) FILTER (size <> 'large' AND motion_range = 'long_range') AS long_range_outside_its_sizes, count(*) FILTER (size = 'small' AND person_count > 3) AS crowded_small_venues, count(*) FILTER (crowd AND NOT natural_crowd) AS crowds_where_none_is_natural"""
_FLAGS = f"""count(*) AS cards, count(DISTINCT (region, archetype)) AS pairs, {_VIOLATIONS}, count(*) FILTER (NOT indoor) AS outdoor, count(*) FILTER (NOT indoor AND lighting IN ('rain', 'snow', 'fog')) AS hostile_outdoor, count(*) FILTER (surface <> 'normal') AS odd_surfaces,
  count(*) FILTER (crowd) AS crowds, count(*) FILTER (close_approach) AS close_approaches, count(*) FILTER (holdout) AS held_out"""
_ENDS = " UNION ALL ".join(f"SELECT '{c}.' || unnest(['used', 'least', 'most']) AS figure, unnest([count(*), min(n), max(n)]) AS value FROM (SELECT count(*) AS n FROM dealt GROUP BY {c})" for c in ("region", "archetype"))


def _decks(spark: SparkSession, d: str) -> DataFrame:
    return dealing.deal_decks(*_inputs(spark, d))


@query(f"""WITH {_DEALT}, a AS (SELECT {_FLAGS} FROM dealt), u AS (SELECT * FROM a UNPIVOT (value FOR figure IN (COLUMNS(*))))
SELECT figure, CAST(value AS DOUBLE) AS value FROM (SELECT figure, value FROM u UNION ALL {_ENDS}) UNION ALL SELECT 'hostile_percent', round(100 * hostile_outdoor / CAST(outdoor AS DOUBLE), 4) FROM a""")
def deal_checks(spark: SparkSession, d: str) -> DataFrame:
    """The checks of the deal of all orders' cards."""
    return reports.coverage_checks(_decks(spark, d), AXES)


_HISTOGRAMS = ("person_count", "motion_range", "env_motion", "lighting", "camera", "vibe", "size", "indoor", "surface")


@query(f"WITH {_DEALT}, h AS ({' UNION ALL '.join(f'''SELECT '{a}' AS axis, CAST({a} AS VARCHAR) AS value, count(*) AS cards FROM dealt GROUP BY {a}''' for a in _HISTOGRAMS)}) SELECT axis, value, cards, round(100 * cards / CAST(sum(cards) OVER (PARTITION BY axis) AS DOUBLE), 4) AS percent, row_number() OVER (PARTITION BY axis ORDER BY cards DESC, value) AS place FROM h")
def deal_histograms(spark: SparkSession, d: str) -> DataFrame:
    """How often each value of each axis was dealt."""
    return reports.axis_histograms(_decks(spark, d), _HISTOGRAMS).select("axis", "value", "cards", F.round("percent", 4).alias("percent"), F.col("place").cast("long").alias("place"))
