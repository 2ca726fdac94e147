"""The registered queries and their SQL: each reads whole tables of the given schema through jobs.adapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelyard.functions import text, vec
from reelyard.jobs import adapters as A
from reelyard.operators import cameras, captions, cards, decks, ground_paths, manifest, plane, sample_plan, scenes, tracks
from reelyard.operators.manifest import REQUIRED
from reelyard.queries import ORACLES, QUERIES, query
from reelyard.queries import sql_list as _sql_list
from reelyard.storage import keep

__all__ = ["ORACLES", "QUERIES"]

def _sql_tokens(col: str, drop=text.STOP_WORDS) -> str:
    return f"list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(lower(coalesce({col}, '')), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda x: x <> '' AND NOT list_contains({_sql_list(drop)}, x))))"


def _sql_words(col: str) -> str:
    return rf"len(list_filter(string_split_regex(coalesce({col}, ''), '[\x09-\x0D\x20]+'), lambda x: x <> ''))"


def _sql_jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / CAST(len({a}) + len({b}) - len(list_intersect({a}, {b})) AS DOUBLE) END"


_ISSUE = f"""issues AS (SELECT *, CASE WHEN n < 60 OR n > 125 THEN 'word count ' || n || ' outside 60-125' WHEN found <> '' THEN 'forbidden word: ' || found
  WHEN NOT regexp_matches(caption, '{text.CONTINUOUS}') THEN 'missing continuous-shot phrase' WHEN scene_n > 24 THEN 'scene summary longer than 20 words'
  WHEN family <> '' AND sim >= 0.7 THEN 'action restates the family name; write a specific sibling move, variation or combination' END AS issue
  FROM (SELECT *, {_sql_words("caption")} AS n, {_sql_words("scene")} AS scene_n, regexp_extract(caption, '{text.FORBIDDEN}', 2) AS found, {_sql_jaccard("ta", "tf")} AS sim
    FROM (SELECT *, {_sql_tokens("action", text.STOP_WORDS + text.COUNT_WORDS)} AS ta, {_sql_tokens("family", text.STOP_WORDS + text.COUNT_WORDS)} AS tf FROM captions)))"""


# --- captions


@query(f"WITH {A.CAPTIONS} SELECT id, {_sql_words('caption')} AS words, array_to_string({_sql_tokens('scene')}, ' ') AS scene_tokens FROM captions")
def caption_tokens(spark: SparkSession, d: str) -> DataFrame:
    return A.captions(spark, d).select("id", text.word_count(F.col("caption")).cast("long").alias("words"), F.concat_ws(" ", text.tokens(F.col("scene"))).alias("scene_tokens"))


@query(f"WITH {A.CAPTIONS}, {_ISSUE} SELECT id, issue FROM issues")
def mechanical_issues(spark: SparkSession, d: str) -> DataFrame:
    return A.captions(spark, d).select("id", text.mechanical_issue(F.col("caption"), F.col("scene"), F.col("action"), F.col("family")).alias("issue"))


@query(f"WITH {A.CAPTIONS}, k AS (SELECT id, array_to_string({_sql_tokens('caption')}, ' ') AS key FROM captions), f AS (SELECT *, min(id) OVER (PARTITION BY key) AS first_id FROM k) SELECT id, first_id FROM f WHERE id > first_id")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return captions.exact_duplicates(A.captions(spark, d))


@query(f"WITH {A.CAPTIONS}, s AS (SELECT id, {_sql_tokens('scene')} AS t FROM captions) SELECT x.id AS a, y.id AS b, round({_sql_jaccard('x.t', 'y.t')}, 6) AS similarity FROM s x JOIN s y ON x.id < y.id WHERE {_sql_jaccard('x.t', 'y.t')} > 0.6")
def similar_scenes(spark: SparkSession, d: str) -> DataFrame:
    return captions.similar_pairs(A.captions(spark, d), "scene", 0.6).withColumn("similarity", F.round("similarity", 6))


def _checked(spark: SparkSession, d: str) -> DataFrame:
    """Captions of 60 to 125 words, the length that the mechanical rules allow."""
    return A.captions(spark, d).where(text.word_count(F.col("caption")).between(60, 125))


@query(f"WITH {A.CAPTIONS}, s AS (SELECT id, family, {_sql_tokens('caption')} AS t FROM captions WHERE {_sql_words('caption')} BETWEEN 60 AND 125) SELECT x.id AS a, y.id AS b, round({_sql_jaccard('x.t', 'y.t')}, 6) AS similarity FROM s x JOIN s y ON x.id < y.id AND x.family = y.family WHERE {_sql_jaccard('x.t', 'y.t')} > 0.45")
def similar_captions_in_family(spark: SparkSession, d: str) -> DataFrame:
    return captions.similar_pairs(_checked(spark, d), "caption", 0.45, "family").withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {A.CAPTIONS}, s AS (SELECT id, family, {_sql_tokens('caption')} AS t FROM captions) SELECT x.id AS a, y.id AS b, round({_sql_jaccard('x.t', 'y.t')}, 6) AS similarity FROM s x JOIN s y ON x.id < y.id AND x.family = y.family WHERE {_sql_jaccard('x.t', 'y.t')} > 0.45")
def all_similar_captions_in_family(spark: SparkSession, d: str) -> DataFrame:
    """As similar_captions_in_family, whose SQL takes one range of lengths, over captions of any length."""
    return captions.similar_pairs(A.captions(spark, d), "caption", 0.45, "family").withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH RECURSIVE {A.CAPTIONS}, t AS (SELECT id, family, {_sql_tokens('scene')} AS st, {_sql_tokens('caption')} AS ct FROM captions), f AS (SELECT *, min(id) OVER (PARTITION BY ct) AS first_id FROM t), r AS (SELECT * FROM f WHERE id = first_id),
e AS (SELECT a.id AS a, b.id AS b, 0 AS kind FROM r a JOIN r b ON a.id < b.id WHERE {_sql_jaccard('a.st', 'b.st')} > 0.6 UNION ALL SELECT a.id, b.id, 1 FROM r a JOIN r b ON a.id < b.id AND a.family = b.family WHERE {_sql_jaccard('a.ct', 'b.ct')} > 0.45),
nb AS (SELECT b AS id, list(DISTINCT a) AS before, bool_or(a NOT IN (SELECT b FROM e)) AS sure FROM e GROUP BY 1),
g AS (SELECT CAST([] AS BIGINT[]) AS stay, CAST([] AS BIGINT[]) AS gone UNION ALL SELECT list_concat(stay, new_stay), list_concat(gone, new_gone) FROM (SELECT stay, gone,
  (SELECT coalesce(list(id), []) FROM nb WHERE NOT list_contains(stay, id) AND NOT list_contains(gone, id) AND NOT sure AND len(list_filter(before, lambda a: NOT list_contains(gone, a))) = 0) AS new_stay,
  (SELECT coalesce(list(id), []) FROM nb WHERE NOT list_contains(stay, id) AND NOT list_contains(gone, id) AND (sure OR list_has_any(before, stay))) AS new_gone FROM g) WHERE len(new_stay) + len(new_gone) > 0),
z AS (SELECT unnest(gone) AS id FROM (SELECT gone FROM g ORDER BY len(gone) + len(stay) DESC LIMIT 1)), w AS (SELECT b AS id, min({{'a': a, 'kind': kind}}) AS w FROM e WHERE b IN (SELECT id FROM z) AND a NOT IN (SELECT id FROM z) GROUP BY 1)
SELECT id, first_id AS cause, 'exact' AS kind FROM f WHERE id > first_id UNION ALL SELECT id, w.a, ['scene', 'caption'][w.kind + 1] FROM w""")
def near_duplicate_captions(spark: SparkSession, d: str) -> DataFrame:
    return captions.near_duplicates(A.captions(spark, d))


@query(f"WITH {A.CAPTIONS}, {_ISSUE}, k AS (SELECT id, array_to_string({_sql_tokens('caption')}, ' ') AS key FROM captions), f AS (SELECT id, min(id) OVER (PARTITION BY key) AS first_id FROM k) SELECT i.family, count(*) AS captions, count(*) FILTER (issue IS NULL) AS sound, count(*) FILTER (f.id > first_id) AS copies FROM issues i JOIN f USING (id) GROUP BY i.family")
def caption_check_flags(spark: SparkSession, d: str) -> DataFrame:
    """Captions of each family: all, sound by the mechanical rules, copies of an earlier one."""
    items = A.captions(spark, d)
    issue = text.mechanical_issue(F.col("caption"), F.col("scene"), F.col("action"), F.col("family"))
    flagged = items.select("id", "family", issue.isNull().alias("ok")).join(captions.exact_duplicates(items), "id", "left")
    return flagged.groupBy("family").agg(F.count(F.lit(1)).alias("captions"), F.count_if("ok").alias("sound"), F.count_if(F.col("first_id").isNotNull()).alias("copies"))


def _verdicts(spark: SparkSession, d: str, fixed: Column) -> DataFrame:
    labels, docs = A.table(spark, d, "labels"), A.table(spark, d, "documents").select("doc_id", "text")
    verdict = F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "ok").otherwise("fixed")
    return labels.join(docs, "doc_id").select(F.col("doc_id").alias("id"), verdict.alias("verdict"), F.when((F.col("toxic") == 1) & (F.col("doc_id") % 2 == 0), "toxic").alias("issue"), fixed.alias("caption"))


_VERDICTS = "verdicts AS (SELECT l.doc_id AS id, CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'ok' ELSE 'fixed' END AS verdict, CASE WHEN toxic = 1 AND l.doc_id % 2 = 0 THEN 'toxic' END AS issue, substr(d.text, 1, 500) AS fixed FROM labels l JOIN documents d USING (doc_id))"


@query(f"""WITH {A.CAPTIONS}, {_VERDICTS}, j AS (SELECT c.id, c.scene, c.action, c.family, c.caption AS old, verdict, v.issue AS said, fixed, CASE WHEN verdict = 'fixed' AND fixed <> '' THEN fixed ELSE c.caption END AS caption FROM captions c LEFT JOIN verdicts v USING (id)),
{_ISSUE.replace("issues AS", "issues AS").replace("FROM captions)", "FROM j)")}
SELECT id, reason IS NULL AS accepted, reason, md5(caption) AS caption_md5 FROM (SELECT id, caption, CASE WHEN verdict IS NULL THEN 'validator returned no verdict' WHEN verdict = 'ok' THEN NULL WHEN verdict = 'fixed' AND fixed <> '' THEN 'after fix: ' || issue WHEN said <> '' THEN said ELSE 'rejected by validator' END AS reason FROM issues)""")
def verdicts_applied(spark: SparkSession, d: str) -> DataFrame:
    """The verdicts alone; their SQL fixes captions by the first 500 characters."""
    return captions.apply_verdicts(A.captions(spark, d), _verdicts(spark, d, F.substring("text", 1, 500))).select("id", "accepted", "reason", F.md5("caption").alias("caption_md5"))


@query()
def validated_captions(spark: SparkSession, d: str) -> DataFrame:
    """The whole validation step, fixed captions being whole texts: rules, verdicts, near duplicates of what is accepted."""
    return captions.validate(A.captions(spark, d), _verdicts(spark, d, F.col("text"))).select("id", "accepted", "reason", F.md5("caption").alias("caption_md5"))


@query("WITH r AS (SELECT conv_id % 10 * 1000 + turn AS id, conv_id AS batch, turn AS item, trim(text, ' ') AS text FROM conversations WHERE text IS NOT NULL) SELECT id, batch, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch DESC, item DESC, text DESC) AS n FROM r) WHERE n = 1")
def merged_responses(spark: SparkSession, d: str) -> DataFrame:
    said = A.table(spark, d, "conversations").select((F.col("conv_id") % 10 * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("batch"), F.col("turn").alias("item"), "text")
    return captions.merge_responses(said).select("id", "batch", F.md5("text").alias("text_md5"))


@query("WITH r AS (SELECT doc_id AS id, text, (row_number() OVER (ORDER BY doc_id) - 1) // 40 AS batch FROM documents) SELECT batch, count(*) AS items, min(id) AS first_id, max(id) AS last_id, md5(string_agg(text, chr(10) ORDER BY id)) AS prompt_md5 FROM r GROUP BY batch")
def prompt_batches(spark: SparkSession, d: str) -> DataFrame:
    made = captions.make_batches(A.captions(spark, d), 40)
    return made.select("batch", F.col("items").cast("long").alias("items"), F.element_at("ids", 1).alias("first_id"), F.element_at("ids", -1).alias("last_id"), F.md5("prompt").alias("prompt_md5"))


@query("WITH r AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS rank FROM documents) SELECT id, rank FROM r WHERE rank % 100 = 0 AND rank < 2000")
def review_sample(spark: SparkSession, d: str) -> DataFrame:
    return captions.review_sample(A.captions(spark, d).select("id")).select("id", "rank")


# --- dealing

_CAMERA_WORDS = ["static", "pan left", "pan right", "dolly in", "dolly out", "orbit", "crane"]


@query(f"""WITH r AS (SELECT o_orderkey AS id, o_orderstatus AS stratum, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(concat_ws('|', '0', 'camera', CAST(o_orderkey AS VARCHAR))), o_orderkey) - 1 AS r FROM orders),
v AS (SELECT v, row_number() OVER (ORDER BY md5('0|camera|' || v), v) - 1 AS i FROM (SELECT unnest({_sql_list(_CAMERA_WORDS)}) AS v)) SELECT id, stratum, v AS camera FROM r JOIN v ON r.r % {len(_CAMERA_WORDS)} = v.i""")
def even_camera_deck(spark: SparkSession, d: str) -> DataFrame:
    cards = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("stratum"))
    return decks.even_deck(cards, _CAMERA_WORDS, "camera", "camera", ["stratum"]).select("id", "stratum", "camera")


_SHARES = "w AS (SELECT n_name AS value, CAST(n_nationkey % 7 + 1 AS DOUBLE) AS weight, n_nationkey AS pos FROM nation), n AS (SELECT count(*) AS n FROM orders), e AS (SELECT *, weight * (SELECT n FROM n) / (SELECT sum(weight) FROM w) AS x FROM w), f AS (SELECT *, CAST(floor(x) AS BIGINT) AS fl, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, pos) AS i FROM e), c AS (SELECT value, pos, fl + CASE WHEN i <= (SELECT n FROM n) - (SELECT sum(fl) FROM f) THEN 1 ELSE 0 END AS count FROM f), g AS (SELECT *, CAST(sum(count) OVER (ORDER BY pos) AS BIGINT) AS high FROM c)"


def _shares(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    weights = A.table(spark, d, "nation").select(F.col("n_name").alias("value"), (F.col("n_nationkey") % 7 + 1).cast("double").alias("weight"), F.col("n_nationkey").alias("pos"))
    cards = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return decks.weighted_counts(weights, cards.count()), cards


@query(f"WITH {_SHARES} SELECT value, count, high - count AS low, high FROM g")
def largest_remainder_counts(spark: SparkSession, d: str) -> DataFrame:
    return _shares(spark, d)[0].select("value", "count", "low", "high")


@query(f"WITH {_SHARES}, r AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY md5(concat_ws('|', '0', 'people', CAST(o_orderkey AS VARCHAR))), o_orderkey) - 1 AS r FROM orders) SELECT id, value AS people FROM r JOIN g ON r >= high - count AND r < high")
def weighted_people_deck(spark: SparkSession, d: str) -> DataFrame:
    counts, cards = _shares(spark, d)
    return decks.weighted_deck(cards, counts, "people", "people").select("id", "people")


@query("""WITH g AS (SELECT n_name AS region, row_number() OVER (ORDER BY md5('region|' || n_name), n_name) - 1 AS i FROM nation), a AS (SELECT CAST(p_partkey AS VARCHAR) AS archetype, row_number() OVER (ORDER BY md5('archetype|' || p_partkey), CAST(p_partkey AS VARCHAR)) - 1 AS i FROM part),
r AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS rank FROM orders) SELECT id, region, archetype FROM r JOIN g ON rank // ((SELECT count(*) FROM orders) // (SELECT count(*) FROM nation)) = g.i JOIN a ON rank % (SELECT count(*) FROM part) = a.i""")
def dealt_places(spark: SparkSession, d: str) -> DataFrame:
    cards = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    regions, kinds = A.table(spark, d, "nation").select(F.col("n_name").alias("value")), A.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("value"))
    return decks.deal_places(cards, regions, kinds).select("id", "region", "archetype")


@query("WITH r AS (SELECT o_orderkey AS id, o_orderstatus = 'O' AS fit, row_number() OVER (PARTITION BY o_orderstatus = 'O' ORDER BY md5(concat_ws('|', '0', 'crowd', CAST(o_orderkey AS VARCHAR))), o_orderkey) AS n FROM orders) SELECT id, fit AND n <= 1000 AS crowd FROM r")
def exact_crowd_sample(spark: SparkSession, d: str) -> DataFrame:
    cards = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"))
    return decks.exact_sample(cards, 1000, "crowd", where=F.col("s") == "O").select("id", F.col("chosen").alias("crowd"))


@query("SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) LIKE '%49' OR CAST(o_orderkey AS VARCHAR) LIKE '%99' AS holdout FROM orders")
def holdout_ids(spark: SparkSession, d: str) -> DataFrame:
    return decks.holdout_split(A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")))


_AXES = ("p_brand", "p_type", "p_size", "p_name")


@query(" UNION ALL ".join(f"SELECT '{a}' AS axis, CAST({a} AS VARCHAR) AS value, count(*) AS cards, round(100.0 * count(*) / (SELECT count(*) FROM part), 4) AS pct FROM part GROUP BY {a}" for a in _AXES))
def axis_histograms(spark: SparkSession, d: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in _AXES]))
    counts = A.table(spark, d, "part").select(each.alias("v")).groupBy("v.axis", "v.value").agg(F.count(F.lit(1)).alias("cards"))
    return counts.withColumn("pct", F.round(100.0 * F.col("cards") / F.sum("cards").over(Window.partitionBy("axis")), 4))


@query("WITH c AS (SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1) SELECT min(n) AS least, max(n) AS most, count(*) AS regions, CAST(sum(parts) AS BIGINT) AS pairs, (SELECT count(*) FILTER (l_discount > 0.05 AND l_returnflag = 'R') FROM lineitem) AS violations FROM c")
def coverage_checks(spark: SparkSession, d: str) -> DataFrame:
    lines = A.table(spark, d, "lineitem")
    pairs = lines.groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("l_discount") > 0.05) & (F.col("l_returnflag") == "R")).alias("bad"))
    each = pairs.groupBy("l_suppkey").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"), F.sum("bad").alias("bad"))
    return each.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count(F.lit(1)).alias("regions"), F.sum("parts").alias("pairs"), F.sum("bad").alias("violations"))


FAMILIES = [
    {"name": "walk", "ranges": ["short", "long"], "small_ok": True},
    {"name": "skate", "ranges": ["long"], "ice_only": True},
    {"name": "glide", "ranges": ["short", "long"], "ice_ok": True, "min_people": 2},
    {"name": "dribble", "ranges": ["in_place", "short"], "needs_hard_surface": True},
    {"name": "tumble", "ranges": ["short"], "dry_only": True, "needs_space": True},
    {"name": "sprint", "ranges": ["long"], "large_only": True, "outdoor_only": True},
    {"name": "toss", "ranges": ["in_place"], "needs_headroom": True, "min_people": 3},
    {"name": "splash", "ranges": ["in_place", "short"], "surface_any": ["water"], "small_ok": True},
    {"name": "march", "ranges": ["long"], "ground_any": ["red", "green"], "surface_any": ["reflective"]},
    {"name": "kneel", "ranges": ["in_place"], "ground_none": ["blue"], "small_ok": True},
    {"name": "salute", "ranges": ["in_place", "short", "long"], "archetype_any": ["an", "or"], "small_ok": True, "ice_ok": True},
    {"name": "bow", "ranges": ["in_place"], "archetype_none": ["e"], "small_ok": True, "ice_ok": True},
]
_CARDS = """cards AS (SELECT p_partkey AS id, lower(p_name) AS archetype, lower(p_name) AS ground, CASE WHEN p_size <= 5 THEN 'small' WHEN p_size <= 20 THEN 'medium' ELSE 'large' END AS size, p_partkey % 10 < 3 AS indoor,
  CASE p_partkey % 8 WHEN 0 THEN 'ice' WHEN 1 THEN 'water' WHEN 2 THEN 'reflective' ELSE 'normal' END AS surface, p_partkey % 6 + 1 AS person_count, ['in_place', 'short', 'long'][1 + p_partkey % 3] AS motion_range, p_partkey % 5 = 0 AS low_ceiling,
  NOT contains(lower(p_name), 'blue') AND (contains(lower(p_name), 'e') OR contains(lower(p_name), 'steel')) AS hard_ground FROM part)"""


def _cards(spark: SparkSession, d: str) -> DataFrame:
    k, name = F.col("p_partkey"), F.lower("p_name")
    size = F.when(F.col("p_size") <= 5, "small").when(F.col("p_size") <= 20, "medium").otherwise("large")
    surface = F.when(k % 8 == 0, "ice").when(k % 8 == 1, "water").when(k % 8 == 2, "reflective").otherwise("normal")
    reach = F.element_at(F.array(*map(F.lit, ("in_place", "short", "long"))), (k % 3 + 1).cast("int"))
    rows = A.table(spark, d, "part").select(k.alias("id"), name.alias("archetype"), name.alias("ground"), size.alias("size"), (k % 10 < 3).alias("indoor"), surface.alias("surface"), (k % 6 + 1).alias("person_count"), reach.alias("motion_range"), (k % 5 == 0).alias("low_ceiling"))
    return rows.withColumn("hard_ground", cards.hard_ground(F.col("ground"), ["e", "steel"], ["blue"]))


def _sql_eligible(f: dict) -> str:
    words = "regexp_extract_all(ground, '[a-z]+')"
    rules = [f"list_contains({_sql_list(f['ranges'])}, motion_range)", f"person_count >= {f.get('min_people', 1)}"]
    rules += ["surface = 'ice'"] if f.get("ice_only") else [] if f.get("ice_ok") else ["surface <> 'ice'"]
    rules += ["surface NOT IN ('ice', 'water')"] if (f.get("needs_hard_surface") or f.get("dry_only")) and not f.get("ice_ok") else []
    rules += ["size = 'large'"] if f.get("large_only") else []
    rules += ["hard_ground"] if f.get("needs_hard_surface") else []
    rules += [] if f.get("small_ok") else ["size <> 'small'"]
    rules += ["NOT indoor"] if f.get("outdoor_only") else []
    rules += ["(NOT indoor OR size = 'large' AND NOT low_ceiling)"] if f.get("needs_headroom") else []
    rules += [f"(list_has_any({words}, {_sql_list(f['ground_any'])}) OR list_contains({_sql_list(f.get('surface_any', []))}, surface))"] if f.get("ground_any") else [f"list_contains({_sql_list(f['surface_any'])}, surface)"] if f.get("surface_any") else []
    rules += [f"NOT list_has_any({words}, {_sql_list(f['ground_none'])})"] if f.get("ground_none") else []
    rules += ["(" + " OR ".join(f"contains(archetype, '{w}')" for w in f["archetype_any"]) + ")"] if f.get("archetype_any") else []
    rules += ["NOT (" + " OR ".join(f"contains(archetype, '{w}')" for w in f["archetype_none"]) + ")"] if f.get("archetype_none") else []
    return " AND ".join(rules)


@query(f"WITH {_CARDS} " + " UNION ALL ".join(f"SELECT id, '{f['name']}' AS family FROM cards WHERE {_sql_eligible(f)}" for f in FAMILIES))
def eligible_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cards.eligible_families(_cards(spark, d), FAMILIES).select("id", F.explode("families").alias("family"))


@query()
def assigned_families(spark: SparkSession, d: str) -> DataFrame:
    fit = cards.eligible_families(_cards(spark, d), FAMILIES).where(F.size("families") > 0)
    return cards.assign_least_used(fit.select("id", "families")).select("id", "action_family")


# --- files, quality, manifests


@query(rf"""SELECT page_id AS id, clip_id, file, CASE WHEN parent = '_reports' THEN CASE WHEN file LIKE '%.jsonl' THEN 'report' END WHEN clip_id IS NOT NULL AND list_contains({_sql_list(REQUIRED)}, file) THEN 'clip' END AS kind
FROM (SELECT page_id, list_filter(p, lambda x: regexp_matches(x, '^c[0-9]{{4}}$'))[1] AS clip_id, p[len(p)] AS file, p[len(p) - 1] AS parent FROM (SELECT page_id, string_split(path, '/') AS p FROM (
  SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '_reports/' || page_id || CASE WHEN page_id % 2 = 0 THEN '.jsonl' ELSE '.txt' END ELSE 'clips/c' || right('0000' || (page_id % 10000), CASE WHEN page_id % 7 = 0 THEN 3 ELSE 4 END) || '/' || {_sql_list(REQUIRED)}[1 + page_id % 13] END AS path FROM pages)))""")
def routed_members(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    names = F.element_at(F.array(*map(F.lit, REQUIRED)), (i % 13 + 1).cast("int"))
    digits = F.concat(F.lit("0000"), (i % 10000).cast("string"))
    clip = F.concat(F.lit("clips/c"), F.when(i % 7 == 0, F.expr("right(concat('0000', cast(page_id % 10000 as string)), 3)")).otherwise(F.right(digits, F.lit(4))), F.lit("/"), names)
    path = F.when(i % 5 == 0, F.concat(F.lit("_reports/"), i.cast("string"), F.when(i % 2 == 0, ".jsonl").otherwise(".txt"))).otherwise(clip)
    members = A.table(spark, d, "pages").select(i.alias("id"), path.alias("path"))
    return manifest.route_members(members).select("id", "clip_id", "file", "kind")


@query(f"""WITH {A.INVENTORY}, h AS (SELECT clip_id, list(DISTINCT file) AS have FROM inventory WHERE valid AND size > 0 AND list_contains({_sql_list(REQUIRED)}, file) GROUP BY 1)
SELECT o_orderkey AS clip_id, array_to_string(list_sort(list_filter({_sql_list(REQUIRED)}, lambda x: NOT list_contains(coalesce(have, []), x))), ',') AS missing, have IS NULL AS absent, coalesce(len(have), 0) = 13 AS complete FROM orders LEFT JOIN h ON o_orderkey = clip_id""")
def missing_files(spark: SparkSession, d: str) -> DataFrame:
    expected = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("clip_id"))
    return manifest.missing_files(expected, A.inventory(spark, d)).withColumn("missing", F.concat_ws(",", "missing"))


@query(f"WITH {A.QC} SELECT id, array_to_string(hard_flags, ',') AS hard_flags, array_to_string(soft_flags, ',') AS soft_flags, len(hard_flags) = 0 AS training_ready FROM flags")
def qc_flags(spark: SparkSession, d: str) -> DataFrame:
    return manifest.qc_flags(A.qc(spark, d)).select("id", F.concat_ws(",", "hard_flags").alias("hard_flags"), F.concat_ws(",", "soft_flags").alias("soft_flags"), "training_ready")


def _demoted(spark: SparkSession, d: str) -> DataFrame:
    return manifest.demote_flags(manifest.qc_flags(A.qc(spark, d)))


@query(f"WITH {A.QC} SELECT id, array_to_string(hard_flags, ',') AS hard_flags, array_to_string(soft_flags, ',') AS soft_flags, len(hard_flags) = 0 AS training_ready FROM demoted")
def demoted_flags(spark: SparkSession, d: str) -> DataFrame:
    return _demoted(spark, d).select("id", F.concat_ws(",", "hard_flags").alias("hard_flags"), F.concat_ws(",", "soft_flags").alias("soft_flags"), "training_ready")


@query(f"WITH {A.QC}, e AS (SELECT 'hard' AS kind, unnest(hard_flags) AS flag FROM demoted UNION ALL SELECT 'soft', unnest(soft_flags) FROM demoted) SELECT kind, flag, count(*) AS clips FROM e GROUP BY 1, 2")
def flag_summary(spark: SparkSession, d: str) -> DataFrame:
    return manifest.flag_summary(_demoted(spark, d))


_MANIFEST = f"{A.QC}, {A.INVENTORY}, have AS (SELECT clip_id AS id, max(CASE WHEN file = 'control.mp4' THEN 1 ELSE 0 END) AS control, max(CASE WHEN file = 'background.png' THEN 1 ELSE 0 END) AS background FROM inventory WHERE valid GROUP BY 1), manifest AS (SELECT d.id, 'order ' || o_orderkey AS caption, len(hard_flags) = 0 AND coalesce(control, 0) = 1 AND coalesce(background, 0) = 1 AS training_ready, soft_flags, CAST(d.id AS VARCHAR) LIKE '%49' OR CAST(d.id AS VARCHAR) LIKE '%99' AS holdout FROM orders JOIN demoted d ON o_orderkey = d.id LEFT JOIN have ON have.id = d.id)"


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    texts = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("caption"))
    return manifest.build_manifest(texts, _demoted(spark, d).select("id", "training_ready", "hard_flags", "soft_flags"), A.inventory(spark, d))


@query(f"WITH {_MANIFEST} SELECT id, caption, training_ready, array_to_string(soft_flags, ',') AS soft_flags, holdout FROM manifest")
def training_manifest(spark: SparkSession, d: str) -> DataFrame:
    return _manifest(spark, d).select("id", "caption", "training_ready", F.concat_ws(",", "soft_flags").alias("soft_flags"), "holdout")


@query(f"WITH {_MANIFEST} SELECT count(*) AS rows, count(*) FILTER (training_ready AND NOT holdout) AS train_ready, count(*) FILTER (training_ready AND holdout) AS holdout_ready, count(*) FILTER (training_ready AND NOT holdout AND NOT list_contains(soft_flags, 'bystanders')) AS without_bystanders FROM manifest")
def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    return manifest.manifest_counts(_manifest(spark, d))


@query(f"WITH {A.SIDECARS} SELECT status, count(*) AS clips, CAST(round(sum(coalesce(cost_usd, 0.0)), 4) AS DOUBLE) AS cost FROM sidecars GROUP BY 1 UNION ALL SELECT 'todo', count(*), CAST(round(count(*) * 0.1 * 6.0, 4) AS DOUBLE) FROM orders WHERE o_orderkey NOT IN (SELECT id FROM sidecars WHERE status = 'ok')")
def spend_summary(spark: SparkSession, d: str) -> DataFrame:
    return manifest.spend_summary(A.sidecars(spark, d), A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")))


@query("""WITH r AS (SELECT conv_id * 1000 + turn AS id, substr(sha256('batch' || chr(31) || role || chr(31) || '' || chr(31) || coalesce(text, '') || chr(31) || '' || chr(31) || 'low'), 1, 24) AS key FROM conversations), c AS (SELECT DISTINCT key FROM r WHERE id % 3 = 0) SELECT id, key FROM r WHERE key NOT IN (SELECT key FROM c)""")
def uncached_requests(spark: SparkSession, d: str) -> DataFrame:
    asked = A.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("batch").alias("backend"), F.col("role").alias("model"), F.lit("").alias("system"), F.col("text").alias("user"), F.lit("").alias("schema"), F.lit("low").alias("effort"))
    empty = spark.createDataFrame([], "key string")
    cache = manifest.uncached_requests(asked.where("id % 3 = 0"), empty).select("key").distinct()
    return manifest.uncached_requests(asked, cache).select("id", "key")


# --- cameras and tracks

_MOTION = f"""{A.CAMERAS}, s AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS step FROM cams WINDOW w AS (PARTITION BY clip_id ORDER BY kf)),
m AS (SELECT clip_id, sum(coalesce(step, 0)) / CASE WHEN clip_id % 4 = 0 THEN 1.0 ELSE (clip_id % 4) / 2.0 END AS path, max(degrees(abs(a))) AS rot_deg FROM s GROUP BY clip_id), motion AS (SELECT *, path < 0.25 AND rot_deg < 3 AS static FROM m)"""


def _motion(spark: SparkSession, d: str) -> DataFrame:
    spacing = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("clip_id"), (F.col("s_suppkey") % 4 / 2.0).alias("grid_spacing"))
    return cameras.camera_motion(A.cameras(spark, d), spacing)


@query(f"WITH {_MOTION} SELECT clip_id, round(path, 5) AS path, round(rot_deg, 3) AS rot_deg, static FROM motion")
def camera_motion(spark: SparkSession, d: str) -> DataFrame:
    return _motion(spark, d).select("clip_id", F.round("path", 5).alias("path"), F.round("rot_deg", 3).alias("rot_deg"), "static")


@query(f"WITH {_MOTION} SELECT n_name AS label, count(*) AS clips, round(100.0 * avg(CASE WHEN static THEN 0 ELSE 1 END), 4) AS moving_pct FROM motion JOIN supplier ON clip_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ROLLUP (n_name)")
def moving_share(spark: SparkSession, d: str) -> DataFrame:
    labels = A.table(spark, d, "supplier").join(A.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("clip_id"), F.col("n_name").alias("label"))
    return cameras.moving_share(_motion(spark, d).join(labels, "clip_id"))


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return A.dealt(spark, d, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("clip_id"), F.explode(F.sequence(F.lit(-1), F.lit(82))).alias("frame"))


_FRAMES = "frames AS (SELECT s_suppkey AS clip_id, unnest(range(-1, 83)) AS frame FROM supplier)"


@query(f"""WITH {A.CAMERAS}, {_FRAMES}, b AS (SELECT f.clip_id, f.frame, max(CASE WHEN c.frame <= f.frame THEN kf END) AS lo, min(CASE WHEN c.frame > f.frame THEN kf END) AS hi FROM frames f JOIN cams c USING (clip_id) GROUP BY 1, 2)
SELECT b.clip_id, b.frame, round(CASE WHEN lo IS NULL THEN h.x WHEN hi IS NULL THEN l.x ELSE l.x + (h.x - l.x) * (b.frame - l.frame) / CAST(h.frame - l.frame AS DOUBLE) END, 5) AS x FROM b LEFT JOIN cams l ON l.clip_id = b.clip_id AND l.kf = lo LEFT JOIN cams h ON h.clip_id = b.clip_id AND h.kf = hi""")
def interpolated_centers(spark: SparkSession, d: str) -> DataFrame:
    return cameras.interpolated_centers(_frames(spark, d), A.cameras(spark, d)).select("clip_id", "frame", (F.round("x", 5) + 0.0).alias("x"))


@query(f"WITH {A.CAMERAS}, {_FRAMES} SELECT clip_id, frame, kf FROM (SELECT f.clip_id, f.frame, kf, row_number() OVER (PARTITION BY f.clip_id, f.frame ORDER BY abs(f.frame - c.frame), kf) AS n FROM frames f JOIN cams c USING (clip_id)) WHERE n = 1")
def nearest_keyframes(spark: SparkSession, d: str) -> DataFrame:
    return cameras.nearest_keyframe(_frames(spark, d), A.cameras(spark, d))


@query(f"WITH {A.DETECTIONS} SELECT clip_id, track_id, list_sort(list(height) FILTER (visible AND height > 0))[1 + count(*) FILTER (visible AND height > 0) // 2] AS height, count(*) FILTER (visible) AS visible_frames FROM detections GROUP BY 1, 2")
def median_heights(spark: SparkSession, d: str) -> DataFrame:
    return tracks.median_heights(A.detections(spark, d))


_FILLED = f"""{A.DETECTIONS}, g AS (SELECT clip_id, track_id, frame, foot_x, last_value(CASE WHEN foot_x IS NOT NULL THEN frame END IGNORE NULLS) OVER p AS bf, last_value(foot_x IGNORE NULLS) OVER p AS bv, first_value(CASE WHEN foot_x IS NOT NULL THEN frame END IGNORE NULLS) OVER q AS af, first_value(foot_x IGNORE NULLS) OVER q AS av FROM detections
  WINDOW p AS (PARTITION BY clip_id, track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY clip_id, track_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT clip_id, track_id, frame, foot_x IS NULL AS interpolated, CASE WHEN bf IS NULL THEN av WHEN af IS NULL OR af = bf THEN bv ELSE bv + (frame - bf) / CAST(af - bf AS DOUBLE) * (av - bv) END AS x FROM g)"""


def _filled(spark: SparkSession, d: str) -> DataFrame:
    return tracks.fill_gaps(A.detections(spark, d).select("clip_id", "track_id", "frame", F.col("foot_x").alias("x")))


@query(f"WITH {_FILLED} SELECT clip_id, track_id, frame, interpolated, round(x, 5) AS x FROM filled")
def filled_paths(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d).select("clip_id", "track_id", "frame", "interpolated", F.round("x", 5).alias("x"))


_SMOOTH = f"""{_FILLED}, a AS (SELECT clip_id, track_id, list(x ORDER BY frame) AS xs, list(frame ORDER BY frame) AS fs FROM filled WHERE x IS NOT NULL GROUP BY 1, 2),
i AS (SELECT clip_id, track_id, xs, fs[i] AS frame, i FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS i FROM a)),
smoothed AS (SELECT clip_id, track_id, frame, list_sum(list_transform(range(-8, 9), lambda k: xs[greatest(1, least(len(xs), i + k))] * exp(-(k * k) / 8.0))) / (SELECT sum(exp(-(k * k) / 8.0)) FROM (SELECT unnest(range(-8, 9)) AS k)) AS x FROM i)"""


@query(f"WITH {_SMOOTH} SELECT clip_id, track_id, frame, round(x, 4) AS x FROM smoothed")
def smooth_paths(spark: SparkSession, d: str) -> DataFrame:
    return tracks.smooth_path(_filled(spark, d).where("x is not null")).select("clip_id", "track_id", "frame", F.round("smooth", 4).alias("x"))


@query(f"WITH {A.DETECTIONS}, f AS (SELECT clip_id, track_id, coalesce(arg_min(foot_x, frame) FILTER (foot_x IS NOT NULL), 0.0) AS x FROM detections GROUP BY 1, 2) SELECT clip_id, track_id, place, place % 6 AS color FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY x, track_id) - 1 AS place FROM f)")
def left_to_right(spark: SparkSession, d: str) -> DataFrame:
    return tracks.left_to_right(A.detections(spark, d)).select("clip_id", "track_id", F.col("place").cast("long").alias("place"), F.col("color").cast("long").alias("color"))


@query(f"WITH {A.DETECTIONS} SELECT clip_id, track_id, frame, 2 * (frame // 3) + frame % 3 AS kept FROM detections WHERE frame % 3 <> 2 AND 2 * (frame // 3) + frame % 3 < 81")
def kept_frames(spark: SparkSession, d: str) -> DataFrame:
    return tracks.keep_frames(A.detections(spark, d)).select("clip_id", "track_id", "frame", "kept")


def _points(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return A.table(spark, d, "embeddings").select(F.col("label").cast("string").alias("clip_id"), *[F.get(e, F.lit(i)).cast("double").alias(name) for i, name in enumerate(("x", "y", "z", "nx", "ny", "nz"))])


@query("SELECT CAST(label AS VARCHAR) AS clip_id, count(*) AS points, count(*) FILTER (abs(CAST(embedding[2] AS DOUBLE) + 0.01 * label) < 0.05) AS inliers FROM embeddings GROUP BY label")
def plane_inliers(spark: SparkSession, d: str) -> DataFrame:
    planes = A.table(spark, d, "embeddings").groupBy(F.col("label").cast("string").alias("clip_id")).agg((F.first("label") * 0.01).alias("d")).select("clip_id", F.lit(0.0).alias("nx"), F.lit(1.0).alias("ny"), F.lit(0.0).alias("nz"), "d")
    return plane.inlier_counts(_points(spark, d), planes, 0.05)


@query()
def fitted_ground(spark: SparkSession, d: str) -> DataFrame:
    return plane.fit_ground(_points(spark, d))


@query(f"WITH {A.CAMERAS} SELECT clip_id, kf, round(500 * (cos(a) * (1 - x) + sin(a) * (6 - z)) / greatest(-sin(a) * (1 - x) + cos(a) * (6 - z), 1e-9) + 640, 4) AS u, round(-sin(a) * (1 - x) + cos(a) * (6 - z), 4) AS depth FROM cams")
def projected_points(spark: SparkSession, d: str) -> DataFrame:
    n = F.lit
    p = vec.project(n(500.0), n(500.0), n(640.0), n(360.0), F.col("r"), F.col("t"), F.array(n(1.0), n(0.0), n(6.0)))
    return A.cameras(spark, d).select("clip_id", "kf", p.alias("p")).select("clip_id", "kf", F.round("p.u", 4).alias("u"), F.round("p.depth", 4).alias("depth"))


# --- sample plan


def _meta(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 == 0, "image").otherwise("video").alias("type"), F.col("n_chars").alias("length"), F.col("source").alias("text"))


_META = "meta AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'image' ELSE 'video' END AS type, n_chars AS length, source AS text FROM documents)"
_HASH01 = "CAST(('0x' || substr({0}, 1, 8)) AS BIGINT) / 4294967296.0"


@query(f"WITH {_META} SELECT id, type, copy, row_number() OVER (ORDER BY type <> 'image', copy, id) - 1 AS position FROM (SELECT *, unnest(range(1, CASE WHEN type = 'image' THEN 2 ELSE 4 END)) AS copy FROM meta)")
def repeated_videos(spark: SparkSession, d: str) -> DataFrame:
    return sample_plan.repeat_videos(_meta(spark, d), 3).select("id", "type", F.col("copy").cast("long").alias("copy"), "position")


@query(f"""WITH {_META}, s AS (SELECT id, CAST(least(81, floor(length * (CAST(0.95 AS DOUBLE) - CAST(0.05 AS DOUBLE)) / 3)) AS BIGINT) AS n, CAST(floor(length * CAST(0.95 AS DOUBLE)) AS BIGINT) AS total, {_HASH01.format("md5(concat_ws('|', '0', 'start', CAST(id AS VARCHAR)))")} AS h FROM meta),
r AS (SELECT *, least(total, (n - 1) * 3 + 1) AS run FROM s), b AS (SELECT *, CAST(floor(total * CAST(0.05 AS DOUBLE)) AS BIGINT) AS low, total - run AS high, CASE WHEN n < 1 THEN 'no frames' WHEN n < 9 THEN 'too short' END AS error FROM r),
f AS (SELECT *, CASE WHEN total = run THEN 0 ELSE least(low, high) + floor(h * (greatest(high - low, 0) + 1)) END AS first FROM b)
SELECT id, error, CASE WHEN error IS NULL THEN array_to_string(list_transform(range(0, n), lambda i: CAST(first + floor(i * (run - 1) / CAST(greatest(n - 1, 1) AS DOUBLE)) AS BIGINT)), ',') ELSE '' END AS frames FROM f""")
def frame_plans(spark: SparkSession, d: str) -> DataFrame:
    return sample_plan.frame_plan(_meta(spark, d), 81, 0.05, 0.95, 3, 9).select("id", "error", F.concat_ws(",", "frames").alias("frames"))


@query(f"WITH {_META} SELECT id, CASE WHEN {_HASH01.format(chr(109) + 'd5(concat_ws(' + repr('|') + ', ' + repr('0.0') + ', ' + repr('drop') + ', CAST(id AS VARCHAR)))')} < 0.1 THEN '' ELSE text END AS text FROM meta")
def dropped_captions(spark: SparkSession, d: str) -> DataFrame:
    return sample_plan.caption_dropout(_meta(spark, d), 0.1).select("id", "text")


@query(f"""WITH {_META}, o AS (SELECT *, md5(concat_ws('|', '0', 'order', CAST(id AS VARCHAR))) AS h FROM meta), p AS (SELECT *, row_number() OVER (ORDER BY h, id) - 1 AS position, (row_number() OVER (PARTITION BY type ORDER BY h, id) - 1) // 8 AS batch FROM o)
SELECT type, batch, array_to_string(list(id ORDER BY position), ',') AS ids, max(position) AS position FROM p GROUP BY 1, 2 HAVING count(*) = 8""")
def bucketed_batches(spark: SparkSession, d: str) -> DataFrame:
    return sample_plan.bucket_batches(_meta(spark, d), 8).select("type", "batch", F.concat_ws(",", F.transform("ids", lambda i: i.cast("string"))).alias("ids"), "position")


@query(f"WITH {_META}, {_MOTION} SELECT id, copy FROM (SELECT id, unnest(range(1, CASE WHEN coalesce(static, true) THEN 2 ELSE 3 END)) AS copy FROM meta LEFT JOIN motion ON id = clip_id)")
def oversampled_moving(spark: SparkSession, d: str) -> DataFrame:
    moving = _motion(spark, d).withColumnRenamed("clip_id", "id")
    return manifest.oversample_moving(_meta(spark, d), moving).select("id", F.col("copy").cast("long").alias("copy"))




def _md5_01(salt: str, col: str = "id") -> str:
    return _HASH01.format(f"md5(concat_ws('|', '0', '{salt}', CAST({col} AS VARCHAR)))")


@query(f"""WITH b AS (SELECT l_orderkey AS batch, CAST(min(l_quantity) AS BIGINT) AS shortest, CASE WHEN l_orderkey % 3 <> 0 THEN 180 + max(l_partkey) % 600 END AS side FROM lineitem GROUP BY 1),
c AS (SELECT *, CASE WHEN side IS NULL OR 256 >= 1.25 * side THEN [256, 512, 640, 768] ELSE list_filter([256, 512, 640, 768], lambda x: x < 1.25 * side) END AS choices FROM b),
m AS (SELECT *, list_sort(list_transform(choices, lambda x: {{'far': abs(x - 640), 'x': x}}))[1].x AS near FROM c), o AS (SELECT *, list_filter(choices, lambda x: x <> near) AS others FROM m),
s AS (SELECT *, CASE WHEN {_md5_01("half", "batch")} < 0.5 OR len(others) = 0 THEN near ELSE others[1 + CAST(floor({_md5_01("size", "batch")} * len(others)) AS BIGINT)] END AS size FROM o)
SELECT batch, size, CAST(greatest(1, floor((least(floor(least(12000000 / CAST(size AS DOUBLE) / size, 45) / 4) * 4 + 1, shortest) - 1) / 4.0) * 4 + 1) AS BIGINT) AS frames FROM s""")
def token_budgets(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey")
    batches = A.table(spark, d, "lineitem").groupBy(k.alias("batch")).agg(F.min("l_quantity").cast("long").alias("shortest"), (F.max("l_partkey") % 600 + 180).alias("side"))
    batches = batches.withColumn("side", F.when(F.col("batch") % 3 != 0, F.col("side")))
    return sample_plan.token_budget_frames(batches, [256, 512, 640, 768], 640, 12_000_000, 45)


@query(f"WITH {_META} SELECT id, CASE WHEN id % 4 = 0 THEN -1 WHEN length <= 1 OR {_md5_01('ref0')} < 0.4 THEN 0 ELSE CAST(floor({_md5_01('ref')} * greatest(length - 1, 1)) AS BIGINT) + 1 END AS ref_frame FROM meta")
def reference_frames(spark: SparkSession, d: str) -> DataFrame:
    return sample_plan.reference_frame_choice(_meta(spark, d).withColumn("has_reference", F.col("id") % 4 == 0))


@query("""WITH i AS (SELECT c_nationkey AS id, CAST(c_custkey AS VARCHAR) AS x FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY md5(concat_ws('|', '0', 'image', CAST(id AS VARCHAR), x)), x) AS n FROM i) SELECT id, array_to_string(list(x ORDER BY n), ',') AS images FROM r WHERE n <= 4 GROUP BY id""")
def subject_images(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.collect_list(F.col("c_custkey").cast("string")).alias("images"))
    return sample_plan.subject_images(rows).select("id", F.concat_ws(",", "images").alias("images"))


@query(f"""WITH {_META}, p AS (SELECT id, type, id % 7 = 0 AS bad FROM meta), g AS (SELECT id AS used, type, row_number() OVER (PARTITION BY type ORDER BY id) - 1 AS r FROM p WHERE NOT bad), n AS (SELECT type, count(*) AS n FROM g GROUP BY 1)
SELECT id, id AS used FROM p WHERE NOT bad UNION ALL SELECT p.id, g.used FROM p LEFT JOIN n ON p.type = n.type LEFT JOIN g ON g.type = p.type AND g.r = floor({_md5_01("bad", "p.id")} * n.n) WHERE bad""")
def replaced_samples(spark: SparkSession, d: str) -> DataFrame:
    plan = _meta(spark, d).select("id", "type", F.when(F.col("id") % 7 == 0, "unreadable").alias("error"))
    return sample_plan.replace_bad_samples(plan)


@query(f"WITH {A.CAMERAS} SELECT clip_id, kf, round(360 - 500 * (sin(a) * 0.2 * 40 / 500.0 + cos(a) * 0.2) / -1.0, 4) AS horizon FROM cams")
def horizon_rows(spark: SparkSession, d: str) -> DataFrame:
    n = F.lit
    y = vec.horizon_y(n(500.0), n(640.0), n(360.0), n(500.0), F.col("r"), F.array(n(0.0), n(-1.0), n(0.2)), n(680.0))
    return A.cameras(spark, d).select("clip_id", "kf", F.round(y, 4).alias("horizon"))


# --- paths on the ground


def _ground(spark: SparkSession, d: str):
    found = A.ground_detections(spark, d)
    planes = A.level_planes(found)
    # heights and positions read the hits, and most queries both of these more than once
    hits = keep(ground_paths.hit_frames(found, A.level_cameras(found), planes), "hits")
    heights = keep(ground_paths.subject_heights(hits), "heights")
    return planes, hits, heights, ground_paths.ground_positions(hits, heights)


@query(f"WITH {A.GROUND} SELECT clip_id, track_id, round(height, 5) AS height, round(0.2 * height, 5) AS radius, anchor_source FROM hts")
def subject_heights(spark: SparkSession, d: str) -> DataFrame:
    _, _, heights, _ = _ground(spark, d)
    return heights.select("clip_id", "track_id", F.round("height", 5).alias("height"), F.round("radius", 5).alias("radius"), "anchor_source")


@query(f"WITH {A.GROUND} SELECT clip_id, track_id, frame, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, method, feet_visible FROM pos")
def ground_positions(spark: SparkSession, d: str) -> DataFrame:
    _, _, _, positions = _ground(spark, d)
    return positions.select("clip_id", "track_id", "frame", *[(F.round(c, 4) + 0.0).alias(c) for c in "xyz"], "method", "feet_visible")


_GAPLESS = ", ".join(
    f"CASE WHEN bf IS NULL THEN next_{c} WHEN af IS NULL OR af = bf THEN last_{c} ELSE last_{c} + (frame - bf) / CAST(af - bf AS DOUBLE) * (next_{c} - last_{c}) END AS {c}" for c in "xyz"
)
_GROUND_PATHS = f"""{A.GROUND}, allf AS (SELECT clip_id, track_id, unnest(range(81)) AS frame FROM hts), pj AS (SELECT f.*, x, y, z, coalesce(method, '') AS method, coalesce(feet_visible, false) AS feet_visible FROM allf f LEFT JOIN pos USING (clip_id, track_id, frame)),
gg AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN frame END IGNORE NULLS) OVER p AS bf, first_value(CASE WHEN x IS NOT NULL THEN frame END IGNORE NULLS) OVER q AS af,
  {", ".join(f"last_value({c} IGNORE NULLS) OVER p AS last_{c}, first_value({c} IGNORE NULLS) OVER q AS next_{c}" for c in "xyz")} FROM pj
  WINDOW p AS (PARTITION BY clip_id, track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY clip_id, track_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
ff AS (SELECT clip_id, track_id, frame, method, feet_visible, x IS NULL AS interpolated, {_GAPLESS} FROM gg),
aa AS (SELECT clip_id, track_id, {", ".join(f"list({c} ORDER BY frame) AS {c}s" for c in "xyz")} FROM ff WHERE x IS NOT NULL GROUP BY 1, 2),
paths AS (SELECT ff.clip_id, ff.track_id, ff.frame, method, feet_visible, interpolated,
  {", ".join(f"list_sum(list_transform(range(-8, 9), lambda k: {c}s[greatest(1, least(81, frame + 1 + k))] * exp(-(k * k) / 8.0))) / (SELECT sum(exp(-(k * k) / 8.0)) FROM (SELECT unnest(range(-8, 9)) AS k)) AS {c}" for c in "xyz")}
  FROM ff JOIN aa USING (clip_id, track_id) WHERE x IS NOT NULL)"""


@query(f"WITH {_GROUND_PATHS} SELECT clip_id, track_id, frame, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, method, feet_visible, interpolated FROM paths")
def subject_paths(spark: SparkSession, d: str) -> DataFrame:
    _, _, heights, positions = _ground(spark, d)
    return ground_paths.subject_paths(positions, heights).select("clip_id", "track_id", "frame", *[(F.round(c, 3) + 0.0).alias(c) for c in "xyz"], "method", "feet_visible", "interpolated")


@query(f"""WITH {_GROUND_PATHS}, st AS (SELECT clip_id, track_id, frame, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS step FROM paths WINDOW w AS (PARTITION BY clip_id, track_id ORDER BY frame)),
mv AS (SELECT clip_id, count(*) FILTER (j > 0) AS jumps FROM (SELECT clip_id, track_id, count(*) FILTER (step > height) AS j FROM st JOIN hts USING (clip_id, track_id) GROUP BY 1, 2) GROUP BY 1),
fd AS (SELECT clip_id, count(*) AS subjects, CASE WHEN bool_or(anchor_source = 'clip') THEN 'clip' ELSE 'anchor' END AS src, quantile_cont(height, 0.5) AS h FROM hts GROUP BY 1),
fc AS (SELECT clip_id, coalesce(avg(CASE WHEN frame >= 16 THEN CASE WHEN feet_visible THEN 0.0 ELSE 1.0 END END), 0.0) AS feet_cut FROM paths GROUP BY 1),
pl AS (SELECT DISTINCT user_id AS clip_id, 1.5 + (user_id % 3) * 0.5 AS ch, CASE WHEN user_id % 29 = 0 THEN 'no points' END AS error, CASE WHEN user_id % 5 <> 0 THEN user_id % 4 END AS expected_persons, CASE WHEN user_id % 9 <> 0 THEN abs(360.0 - (user_id % 90 + 310)) END AS hd FROM events),
al AS (SELECT pl.*, coalesce(subjects, 0) AS subjects, src, h, coalesce(jumps, 0) AS jumps, coalesce(feet_cut, 0.0) AS feet_cut FROM pl LEFT JOIN fd USING (clip_id) LEFT JOIN mv USING (clip_id) LEFT JOIN fc USING (clip_id)),
fl AS (SELECT *, array_to_string(list_sort(list_filter([CASE WHEN clip_id % 17 = 0 THEN 'ground_fail' END, CASE WHEN clip_id % 13 = 0 THEN 'plane_fail' END, CASE WHEN subjects = 0 THEN 'no_anchor' END, CASE WHEN subjects <> expected_persons THEN 'count_mismatch' END], lambda x: x IS NOT NULL)), ',') AS hard,
  array_to_string(list_sort(list_filter([CASE WHEN jumps > 0 THEN 'track_jump' END, CASE WHEN src = 'clip' THEN 'anchor_late' END, CASE WHEN feet_cut > 0.3 THEN 'feet_cut_later' END, CASE WHEN ch / h < 0.4 THEN 'low_camera' END, CASE WHEN hd > 60 THEN 'horizon_disagree' END], lambda x: x IS NOT NULL)), ',') AS soft FROM al)
SELECT clip_id, error, expected_persons, CASE WHEN error IS NULL THEN subjects END AS subjects, CASE WHEN error IS NULL THEN round(coalesce(h, ch / 3), 3) END AS grid_spacing, CASE WHEN error IS NULL THEN round(ch / h, 2) END AS cam_ratio, CASE WHEN error IS NULL THEN round(feet_cut, 3) END AS feet_cut,
  CASE WHEN error IS NULL THEN round(hd, 1) END AS horizon_diff, CASE WHEN error IS NULL THEN hard ELSE '' END AS hard_flags, CASE WHEN error IS NULL THEN soft ELSE '' END AS soft_flags, error IS NULL AND hard = '' AS training_ready FROM fl""")
def clip_qc(spark: SparkSession, d: str) -> DataFrame:
    planes, _, heights, positions = _ground(spark, d)
    k = F.col("clip_id")
    expected = planes.select("clip_id", F.when(k % 5 != 0, k % 4).alias("expected_persons"))
    horizons = planes.where(k % 9 != 0).select("clip_id", (k % 90 + 310).cast("double").alias("horizon"))
    paths = keep(ground_paths.subject_paths(positions, heights), "paths")
    rows = ground_paths.clip_qc(planes, heights, paths, expected, horizons)
    return rows.withColumns({c: F.concat_ws(",", c) for c in ("hard_flags", "soft_flags")})


@query(f"WITH {_GROUND_PATHS} SELECT clip_id, frame, track_id, row_number() OVER (PARTITION BY clip_id, frame ORDER BY round(sqrt(x * x + y * y + z * z), 6) DESC, track_id) AS place FROM paths SEMI JOIN gd USING (clip_id, frame)")
def painter_order(spark: SparkSession, d: str) -> DataFrame:
    _, _, heights, positions = _ground(spark, d)
    cams = A.level_cameras(A.ground_detections(spark, d).where("visible"))
    return ground_paths.painter_order(ground_paths.subject_paths(positions, heights), cams).select("clip_id", "frame", "track_id", F.col("order").cast("long").alias("place"))


_HEIGHTS = f"""{A.DETECTIONS}, mh AS (SELECT clip_id, track_id, list_sort(list(height) FILTER (visible AND height > 0))[1 + count(*) FILTER (visible AND height > 0) // 2] AS height, count(*) FILTER (visible) AS seen FROM detections GROUP BY 1, 2)"""


@query(f"""WITH {_HEIGHTS}, top AS (SELECT *, max(height) OVER (PARTITION BY clip_id) AS clip_max FROM mh)
SELECT clip_id, track_id, clip_max, track_id % 7 = 3 OR coalesce(seen >= 40 AND height >= greatest(72.0, 0.4 * clip_max), false) AS main FROM top""")
def main_subjects(spark: SparkSession, d: str) -> DataFrame:
    heights = tracks.median_heights(A.detections(spark, d)).withColumn("main_subject_prelim", F.col("track_id") % 7 == 3)
    return tracks.main_subjects(heights).select("clip_id", "track_id", "clip_max", "main")


@query(f"""WITH {A.CAMERAS}, p AS (SELECT *, CASE WHEN clip_id % 2 = 1 THEN 0.6 ELSE 0.0 END AS nx, CASE WHEN clip_id % 2 = 1 THEN -0.8 ELSE -1.0 END AS ny FROM cams),
f AS (SELECT *, nx * x + 1.5 AS h, -sin(a) * nx AS fn FROM p), w AS (SELECT *, -sin(a) - fn * nx AS wx, -fn * ny AS wy, cos(a) AS wz FROM f), u AS (SELECT *, wx / m AS ux, wy / m AS uy, wz / m AS uz FROM (SELECT *, sqrt(wx * wx + wy * wy + wz * wz) AS m FROM w)),
g AS (SELECT *, x - h * nx AS ox, -h * ny AS oy, z AS oz, ny * uz AS vx, -nx * uz AS vy, nx * uy - ny * ux AS vz FROM u)
SELECT clip_id, kf, round(ox, 6) AS ox, round(oy, 6) AS oy, round(oz, 6) AS oz, round(h, 6) AS camera_height, round((1 - ox) * ux + (2 - oy) * uy + (3 - oz) * uz, 6) AS u, round((1 - ox) * vx + (2 - oy) * vy + (3 - oz) * vz, 6) AS v, round((1 - ox) * nx + (2 - oy) * ny, 6) AS n FROM g""")
def plane_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """The point (1, 2, 3) in the frame of a clip's plane, as each keyframe sees it."""
    odd = F.col("clip_id") % 2 == 1
    normal = vec.vec(F.when(odd, 0.6).otherwise(0.0), F.when(odd, -0.8).otherwise(-1.0), F.lit(0.0))
    framed = A.cameras(spark, d).withColumn("n", normal).withColumn("p", vec.plane_frame(F.col("n"), F.lit(1.5), F.col("r"), F.col("t")))
    at = vec.to_plane(vec.vec(*map(F.lit, (1.0, 2.0, 3.0))), F.col("p.origin"), F.col("p.u"), F.col("p.v"), F.col("n"))
    named = {"ox": vec.at(F.col("p.origin"), 0), "oy": vec.at(F.col("p.origin"), 1), "oz": vec.at(F.col("p.origin"), 2), "camera_height": F.col("p.h"), "u": at.u, "v": at.v, "n": at.n}
    return framed.select("clip_id", "kf", *[(F.round(c, 6) + 0.0).alias(k) for k, c in named.items()])


# --- cards as prompts show them, generation runs, intake


@query(f"WITH {_CARDS} SELECT id, CAST(to_json({{'id': id, 'person_count': person_count, 'archetype': archetype, 'ground': ground, 'indoor': indoor, 'size': size, 'motion_range': motion_range}}) AS VARCHAR) AS card FROM cards")
def card_view(spark: SparkSession, d: str) -> DataFrame:
    return cards.card_view(_cards(spark, d))


@query(f"WITH {_CARDS}, a AS (SELECT DISTINCT archetype AS name FROM cards), t AS (SELECT lower(p_name) AS name, max(p_size) AS largest, min(p_retailprice) AS least FROM part GROUP BY 1) SELECT name, largest, least FROM a JOIN t USING (name)")
def tagged_archetypes(spark: SparkSession, d: str) -> DataFrame:
    archetypes = _cards(spark, d).select(F.col("archetype").alias("name")).distinct()
    tags = A.table(spark, d, "part").groupBy(F.lower("p_name").alias("name")).agg(F.max("p_size").alias("largest"), F.min("p_retailprice").alias("least"))
    others = A.table(spark, d, "supplier").select(F.lower("s_name").alias("name"), F.lit(None).cast("int").alias("largest"), F.lit(None).cast("double").alias("least"))
    return cards.attach_tags(archetypes, tags.unionByName(others))


@query(f"WITH {A.CAPTIONS}, {_CARDS} SELECT c.id, person_count, motion_range, caption FROM cards c JOIN captions USING (id)")
def assembled_captions(spark: SparkSession, d: str) -> DataFrame:
    return cards.assemble_captions(_cards(spark, d), A.captions(spark, d).select("id", "caption")).select("id", "person_count", "motion_range", "caption")


@query(f"WITH {_CARDS} SELECT id, archetype FROM cards ORDER BY id LIMIT 20")
def trial_cards(spark: SparkSession, d: str) -> DataFrame:
    return cards.first_n(_cards(spark, d).select("id", "archetype"), 20)


@query("SELECT 'c' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS id, o_totalprice AS price FROM orders WHERE o_orderkey BETWEEN 100 AND 5000")
def selected_ids(spark: SparkSession, d: str) -> DataFrame:
    named = A.table(spark, d, "orders").select(F.concat(F.lit("c"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("id"), F.col("o_totalprice").alias("price"))
    return manifest.select_ids(named, "c000000100-c000005000")


@query(f"WITH {A.SIDECARS} SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT id FROM sidecars WHERE status = 'ok')")
def clips_to_do(spark: SparkSession, d: str) -> DataFrame:
    return manifest.todo(A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), A.sidecars(spark, d).where("status = 'ok'"))


@query(f"WITH {A.SIDECARS} SELECT 'c' || doc_id AS id, text AS prompt, doc_id AS seed, '720p' AS resolution FROM documents WHERE doc_id NOT IN (SELECT id FROM sidecars WHERE status = 'ok' AND id % 2 = 0)")
def generation_requests(spark: SparkSession, d: str) -> DataFrame:
    """Clips of even events are done already."""
    named = F.concat(F.lit("c"), F.col("id").cast("string")).alias("id")
    done = A.sidecars(spark, d).where("status = 'ok' and id % 2 = 0").select(named)
    asked = manifest.generation_requests(A.captions(spark, d).select(named, "caption"), done, {"resolution": "720p"})
    return asked.select("id", F.from_json("payload", "prompt string, seed long, resolution string").alias("p")).select("id", "p.*")


@query("SELECT count(*) AS calls, count(*) FILTER (turn % 3 = 1) AS cached, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS input_tokens, CAST(sum(turn) AS BIGINT) AS output_tokens, CAST(coalesce(sum(conv_id + 1) FILTER (turn % 3 = 1), 0) AS BIGINT) AS cached_tokens FROM conversations")
def usage_summary(spark: SparkSession, d: str) -> DataFrame:
    cached = F.when(F.col("turn") % 3 == 1, F.col("conv_id") + 1)
    return manifest.usage_summary(A.table(spark, d, "conversations").select(F.length("text").cast("long").alias("input_tokens"), F.col("turn").alias("output_tokens"), cached.alias("cached_tokens")))


def _members(spark: SparkSession, d: str) -> DataFrame:
    return A.inventory(spark, d).withColumn("archive", F.expr("clip_id div 50"))


@query(f"WITH {A.INVENTORY} SELECT clip_id // 50 AS archive, count(*) FILTER (valid) AS ok, coalesce(array_to_string(list_sort(list(file) FILTER (NOT valid)), ','), '') AS bad, count(DISTINCT clip_id) AS clips FROM inventory GROUP BY 1")
def intake_summary(spark: SparkSession, d: str) -> DataFrame:
    return manifest.intake_summary(_members(spark, d)).withColumn("bad", F.concat_ws(",", "bad"))


@query(f"WITH {A.INVENTORY} SELECT DISTINCT clip_id FROM inventory")
def touched_clips(spark: SparkSession, d: str) -> DataFrame:
    return manifest.union_clips(_members(spark, d))


@query("SELECT o_orderkey AS id, '/data/clips/' || o_orderkey || '.mp4' AS video, CASE WHEN o_orderkey % 4 <> 0 THEN '/data/control/' || o_orderkey || '.mp4' END AS control FROM orders")
def resolved_paths(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    named = {"video": F.concat(F.lit("clips/"), k, F.lit(".mp4")), "control": F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("control/"), k, F.lit(".mp4")))}
    return manifest.resolve_paths(A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), *[c.alias(n) for n, c in named.items()]), "/data/")


_OUTCOMES = f"{A.CAPTIONS}, {_ISSUE}"


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    issue = text.mechanical_issue(F.col("caption"), F.col("scene"), F.col("action"), F.col("family"))
    return A.captions(spark, d).withColumn("reason", issue).withColumn("accepted", F.col("reason").isNull())


@query(f"WITH {_OUTCOMES} SELECT issue IS NULL AS accepted, CASE WHEN issue IS NULL THEN 'accepted' ELSE trim(regexp_extract(issue, '^([a-z -]*[a-z])', 1)) END AS outcome, count(*) AS rows FROM issues GROUP BY 1, 2")
def acceptance_report(spark: SparkSession, d: str) -> DataFrame:
    return captions.acceptance_report(_outcomes(spark, d))


@query(f"WITH {_OUTCOMES}, second AS (SELECT id, reason FROM (SELECT id, 'repaired' AS reason FROM issues WHERE issue LIKE 'forbidden word%')) SELECT id, issue AS reason FROM issues WHERE id NOT IN (SELECT id FROM second) UNION ALL SELECT id, reason FROM second")
def merged_rounds(spark: SparkSession, d: str) -> DataFrame:
    first = _outcomes(spark, d).select("id", "reason")
    return captions.merge_rounds(first, first.where("reason like 'forbidden word%'").withColumn("reason", F.lit("repaired")))


def _sql_dealt(flag: str, values: list[str]) -> str:
    return f"""SELECT r.id, r.stratum, v.v AS weather FROM (SELECT id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat_ws('|', '0', 'weather.{flag}', CAST(id AS VARCHAR))), id) - 1 AS r FROM marked WHERE inside = {flag}) r
  JOIN (SELECT v, row_number() OVER (ORDER BY md5('0|weather.{flag}|' || v), v) - 1 AS i FROM (SELECT unnest({_sql_list(values)}) AS v)) v ON r.r % {len(values)} = v.i"""


_HOSTILE, _MILD = ["rain", "snow", "storm"], ["clear", "overcast", "haze", "mist"]


@query(f"""WITH marked AS (SELECT id, stratum, s < round(n * 0.2) AS inside FROM (SELECT o_orderkey AS id, o_orderstatus AS stratum, count(*) OVER (PARTITION BY o_orderstatus) AS n,
  row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(concat_ws('|', '0', 'weather.share', CAST(o_orderkey AS VARCHAR))), o_orderkey) - 1 AS s FROM orders))
{_sql_dealt("True", _HOSTILE)} UNION ALL {_sql_dealt("False", _MILD)}""")
def weather_deck(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("stratum"))
    return decks.exact_share_deck(rows, _HOSTILE, _MILD, 0.2, "weather", "weather", ["stratum"]).select("id", "stratum", "weather")


# --- extents of grids, paths of cameras


@query(f"""WITH {A.GROUND}, pl AS (SELECT DISTINCT user_id AS clip_id, CAST(1.5 + (user_id % 3) * 0.5 AS DOUBLE) AS ch FROM events), m AS (SELECT clip_id, quantile_cont(height, 0.5) AS h FROM hts GROUP BY 1),
s AS (SELECT clip_id, coalesce(h, ch / 3) AS s FROM pl LEFT JOIN m USING (clip_id)), p AS (SELECT clip_id, z AS u, -x AS v FROM pos WHERE x IS NOT NULL UNION ALL SELECT clip_id, 0.0, 0.0 FROM pl),
e AS (SELECT clip_id, s, min(u) - 6 * s AS u0, max(u) + 6 * s AS u1, min(v) - 6 * s AS v0, max(v) + 6 * s AS v1 FROM p JOIN s USING (clip_id) GROUP BY 1, 2)
SELECT clip_id, round(u0, 9) AS u0, round(u1, 9) AS u1, round(v0, 9) AS v0, round(v1, 9) AS v1, CAST(ceil((u1 + 1e-9 - floor(u0 / s + 1e-9) * s) / s) AS BIGINT) AS u_lines, CAST(ceil((v1 + 1e-9 - floor(v0 / s + 1e-9) * s) / s) AS BIGINT) AS v_lines, round(0.05 * s, 9) AS zmin FROM e""")
def plane_extents(spark: SparkSession, d: str) -> DataFrame:
    planes, _, heights, positions = _ground(spark, d)
    o, i = F.lit(0.0), F.lit(1.0)
    framed = planes.select("clip_id", vec.plane_frame(F.col("normal"), F.col("d"), F.array(i, o, o, o, i, o, o, o, i), F.array(o, o, o)).alias("p")).select("clip_id", "p.*")
    framed = framed.join(ground_paths.grid_spacing(heights, planes), "clip_id")
    points = positions.where("x is not null").select("clip_id", "x", "y", "z").unionByName(planes.select("clip_id", *[o.alias(c) for c in "xyz"]))
    out = ground_paths.plane_extent(points, framed, 6.0)
    return out.select("clip_id", *[(F.round(c, 9) + 0.0).alias(c) for c in ("u0", "u1", "v0", "v1")], F.size("us").cast("long").alias("u_lines"), F.size("vs").cast("long").alias("v_lines"), F.round("zmin", 9).alias("zmin"))


@query(f"""WITH {A.CAMERAS}, st AS (SELECT clip_id, sqrt(pow(x - lag(x) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS step FROM cams WINDOW w AS (PARTITION BY clip_id ORDER BY kf)), l AS (SELECT clip_id, sum(coalesce(step, 0)) AS len FROM st GROUP BY 1)
SELECT s_suppkey AS clip_id, s_suppkey % 10 / 10.0 AS inlier_ratio, 1.0 + s_suppkey % 4 AS camera_height, s_suppkey % 10 >= 3 AS plane_ok, round(len / (2.0 + s_suppkey % 7), 6) AS path_depth FROM supplier JOIN l ON s_suppkey = clip_id""")
def camera_paths(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    fits = A.table(spark, d, "supplier").select(k.alias("clip_id"), (k % 10 / 10.0).alias("inlier_ratio"), (k % 4 + 1.0).alias("camera_height"), (k % 10 >= 3).alias("plane_ok"), (k % 7 + 2.0).alias("median_depth"))
    table = cameras.camera_path_table(_frames(spark, d).where("frame between 0 and 80"), A.cameras(spark, d), fits)
    return table.select("clip_id", "inlier_ratio", "camera_height", "plane_ok", F.round("path_depth", 6).alias("path_depth"))


# --- authored scenes, grids as polylines, horizons from gravity


@query("""WITH b AS (SELECT l_orderkey AS scene, min(l_linenumber) AS bare FROM lineitem WHERE l_orderkey % 5 = 0 AND l_linenumber > 5 GROUP BY 1),
s AS (SELECT o_orderkey AS scene, CASE WHEN o_orderkey % 11 = 0 THEN 80 WHEN o_orderkey % 11 < 9 THEN 81 END AS n, CASE WHEN o_orderkey % 13 = 0 THEN 640 ELSE 1280 END AS w, CASE o_orderkey % 4 WHEN 0 THEN 'orbit' WHEN 1 THEN 'pan' WHEN 2 THEN lower(o_orderstatus) END AS p FROM orders),
r AS (SELECT s.scene, CASE WHEN coalesce(n, 81) <> 81 THEN 'not 81 frames' WHEN w <> 1280 THEN 'not 1280 x 720' WHEN coalesce(p, 'static') NOT IN ('static', 'dolly_in', 'dolly_out', 'orbit', 'pan', 'crane') THEN 'unknown camera path ' || p
  WHEN bare IS NOT NULL THEN 'no keyframes for cylinder ' || CAST(bare AS VARCHAR) END AS reason FROM s LEFT JOIN b USING (scene)) SELECT scene, reason IS NULL AS accepted, reason FROM r""")
def checked_scenes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    path = F.when(k % 4 == 0, "orbit").when(k % 4 == 1, "pan").when(k % 4 == 2, F.lower("o_orderstatus"))
    frames = F.when(k % 11 == 0, 80).when(k % 11 < 9, 81)
    rows = A.table(spark, d, "orders").select(k.alias("scene"), frames.alias("n_frames"), F.when(k % 13 == 0, 640).otherwise(1280).alias("width"), F.lit(None).cast("int").alias("height"), path.alias("path"))
    lines = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scene"), F.col("l_linenumber").alias("cylinder"))
    return scenes.scene_checks(rows, lines, lines.where("scene % 5 <> 0 or cylinder <= 5"))


@query("""SELECT l_orderkey AS scene, l_linenumber AS cylinder, round(CAST(l_quantity AS DOUBLE) / 8 - 0.5, 3) AS u, CAST(l_discount AS DOUBLE) AS v,
  CASE WHEN l_linenumber % 2 = 0 THEN round(CAST(l_quantity AS DOUBLE) / 4 - 0.5, 3) END AS handle_in_u, CAST(NULL AS DOUBLE) AS handle_out_u FROM lineitem""")
def shifted_scenes(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("double")
    rows = A.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("scene"), F.col("l_linenumber").alias("cylinder"), (q / 8).alias("u"), F.col("l_discount").cast("double").alias("v"),
        F.when(F.col("l_linenumber") % 2 == 0, q / 4).alias("handle_in_u"), F.lit(None).cast("double").alias("handle_out_u"),
    )
    return scenes.shift_scenes(rows, -0.5)


@query("SELECT c_custkey AS clip_id, CASE WHEN c_custkey % 7 <> 3 THEN round((360 - (900.0 + c_custkey % 100) * (c_custkey % 4 / 20.0) / ((c_custkey % 7 - 3) / 3.0)) * 720 / (360 + c_custkey % 2 * 360), 6) END AS horizon FROM customer")
def gravity_horizons(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    g = F.array(F.lit(0.0), (k % 7 - 3) / 3.0, k % 4 / 20.0)
    y = vec.horizon_from_gravity(900.0 + k % 100, F.lit(360.0), g, 360 + k % 2 * 360)
    return A.table(spark, d, "customer").select(k.alias("clip_id"), F.round(y, 6).alias("horizon"))


@query(f"""WITH {A.GROUND}, pl AS (SELECT DISTINCT user_id AS clip_id, CAST(1.5 + (user_id % 3) * 0.5 AS DOUBLE) AS ch FROM events), m AS (SELECT clip_id, quantile_cont(height, 0.5) AS h FROM hts GROUP BY 1),
s AS (SELECT clip_id, coalesce(h, ch / 3) AS s FROM pl LEFT JOIN m USING (clip_id)), p AS (SELECT clip_id, z AS u, -x AS v FROM pos WHERE x IS NOT NULL UNION ALL SELECT clip_id, 0.0, 0.0 FROM pl),
e AS (SELECT clip_id, s, min(u) - 6 * s AS u0, max(u) + 6 * s AS u1, min(v) - 6 * s AS v0, max(v) + 6 * s AS v1 FROM p JOIN s USING (clip_id) GROUP BY 1, 2)
SELECT clip_id, (n_u + CASE WHEN cnt >= 2 THEN v_n ELSE 0 END)::BIGINT AS lines, (60 * n_u + CASE WHEN cnt >= 2 THEN cnt * v_n ELSE 0 END)::BIGINT AS points FROM (SELECT clip_id,
  len(list_filter(range(CAST(ceil((u1 + 1e-9 - floor(u0 / s + 1e-9) * s) / s) AS BIGINT)), lambda i: floor(u0 / s + 1e-9) * s + i * s > 0.05 * s)) AS n_u, CAST(ceil((v1 + 1e-9 - floor(v0 / s + 1e-9) * s) / s) AS BIGINT) AS v_n,
  len(list_filter(range(60), lambda i: u0 + (u1 - u0) * (i / 59.0) > 0.05 * s)) AS cnt FROM e)""")
def grid_lines(spark: SparkSession, d: str) -> DataFrame:
    """The grid of every clip as its level camera sees it: how many lines are drawn, and of how many points."""
    planes, _, heights, positions = _ground(spark, d)
    o, i = F.lit(0.0), F.lit(1.0)
    r, t = F.array(i, o, o, o, i, o, o, o, i), F.array(o, o, o)
    framed = planes.select("clip_id", vec.plane_frame(F.col("normal"), F.col("d"), r, t).alias("p")).select("clip_id", "p.*")
    points = positions.where("x is not null").select("clip_id", "x", "y", "z").unionByName(planes.select("clip_id", *[o.alias(c) for c in "xyz"]))
    extents = ground_paths.plane_extent(points, framed.join(ground_paths.grid_spacing(heights, planes), "clip_id"), 6.0)
    cams = planes.select("clip_id", F.lit(0).alias("frame"), F.lit(811.3037).alias("fx"), F.lit(907.7023).alias("fy"), F.lit(640.0).alias("cx"), F.lit(360.0).alias("cy"), r.alias("r"), t.alias("t"))
    drawn = scenes.grid_polylines(extents, framed, cams)
    return drawn.groupBy("clip_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.size("points")).cast("long").alias("points"))


from reelyard import catalog_clips, catalog_deals  # noqa: E402, F401  (more queries, which use the vocabularies above)
