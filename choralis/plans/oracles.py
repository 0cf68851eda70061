"""The queries in DuckDB SQL, over the driver's raw tables."""

from __future__ import annotations

import re

from choralis.functions import signals, text
from choralis.operators import views
from choralis.plans import fixtures
from choralis.sources import targets


def _str(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (int, float)):
        return str(x)
    if isinstance(x, list):
        return "[" + ", ".join(map(_str, x)) + "]"
    return "'" + x.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(_str, r)) + ")" for r in rows)


def _r3(x: str) -> str:
    return f"floor(({x}) * 1000 + 0.5) / 1000"


def _m3(x: str) -> str:
    return f"floor(avg(CAST(round({x} * 1000) AS BIGINT)) + 0.5) / 1000"


def _clamp(x: str, a: float = 0, b: float = 1) -> str:
    return f"least(greatest({x}, {a}::DOUBLE), {b}::DOUBLE)"


STOP = _str(text.STOP_WORDS)
#: Named parts; each may use those before it.
PARTS: dict[str, str] = {}

PARTS["r"] = """SELECT concat_ws('-', rest, ids, rank // 400) AS conv_id, CAST(rank % 400 AS INTEGER) AS pos,
  'd' || doc_id AS reply_id, source AS account_id, text, 1704067200 + doc_id % 120 AS e FROM (SELECT *, row_number() OVER (PARTITION BY rest, ids ORDER BY doc_id) - 1 AS rank
  FROM (SELECT *, coalesce(n_chars, length(text), 0) % 32 AS rest, doc_id // 10000 AS ids FROM documents))"""
PARTS["a"] = """SELECT conv_id, account_id, min(pos) AS first_pos, CAST(substr(account_id, 4) AS INTEGER) AS k FROM r GROUP BY conv_id, account_id"""
PARTS["am"] = f"""SELECT conv_id, account_id, first_pos, k % 4 <> 0 AS has_metadata,
  CASE WHEN k % 4 <> 0 THEN k * 137 END AS age, CASE WHEN k % 4 <> 0 THEN (k * 7919) % 1000 END AS followers,
  CASE WHEN k % 4 <> 0 THEN (k * 104729) % 2500 END AS following,
  CASE WHEN k % 4 <> 0 THEN {_r3("((k * 7919) % 1000)::DOUBLE / greatest(1, (k * 104729) % 2500)")} END AS follow_ratio,
  CASE WHEN k % 4 <> 0 THEN {_r3("(k * 4001)::DOUBLE / greatest(1, k * 137)")} END AS posts_per_day FROM a"""
PARTS["nm"] = r"""SELECT *, trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(replace(lower(text), '’', ''''), 'https?://\S+', ' ', 'g'),
  '@\w+', ' ', 'g'), '''', ''), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM r"""
PARTS["w"] = """SELECT conv_id, pos, reply_id, account_id, e, norm, CASE WHEN norm = '' THEN [] ELSE string_split(norm, ' ') END AS words FROM nm"""
PARTS["t"] = """SELECT conv_id, pos, term, count(*) AS tf FROM (SELECT conv_id, pos, unnest(words) AS term FROM w) GROUP BY ALL"""
PARTS["dfq"] = "SELECT conv_id, term, count(*) AS df FROM t GROUP BY ALL"
PARTS["nq"] = "SELECT conv_id, count(*) AS n FROM r GROUP BY conv_id"
PARTS["raw"] = "SELECT conv_id, pos, term, tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM t JOIN dfq USING (conv_id, term) JOIN nq USING (conv_id)"
PARTS["wt"] = "SELECT conv_id, pos, term, w / sqrt(sum(w * w) OVER (PARTITION BY conv_id, pos)) AS w FROM raw"
PARTS["p"] = """SELECT x.conv_id, x.pos AS i, y.pos AS j, round(least(greatest(sum(x.w * y.w), 0), 1), 12) AS sim FROM wt x JOIN wt y
  ON x.conv_id = y.conv_id AND x.term = y.term AND x.pos < y.pos GROUP BY ALL"""
PARTS["d"] = """SELECT q.conv_id, q.i, q.j, q.sim, abs(y.e - x.e) AS dt FROM (SELECT * FROM p UNION ALL SELECT conv_id, j, i, sim FROM p) q
  JOIN r x ON x.conv_id = q.conv_id AND x.pos = q.i JOIN r y ON y.conv_id = q.conv_id AND y.pos = q.j"""
PARTS["te"] = """SELECT conv_id, least(i, j) AS i, greatest(i, j) AS j, max(sim) AS sim, min(dt) AS dt FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, i ORDER BY sim DESC, dt, j) AS k FROM d WHERE sim >= 0.72) WHERE k <= 6 GROUP BY ALL"""
PARTS["ds"] = """SELECT conv_id, i AS pos, max(sim) AS best, arg_max(j, (sim, -j)) AS best_pos, bool_or(sim >= 0.93) AS near, count(*) FILTER (sim >= 0.72) AS nb,
  avg(sim) FILTER (sim >= 0.72) AS mean, list(j ORDER BY sim DESC, j) FILTER (sim >= 0.72) AS js FROM d GROUP BY ALL"""
PARTS["s"] = f"""SELECT w.conv_id, w.pos, w.reply_id, w.account_id, len(words) AS token_count,
  {_r3("CASE WHEN len(words) = 0 THEN 0 ELSE len(list_distinct(words))::DOUBLE / len(words) END")} AS lex, {_r3("coalesce(best, 0)")} AS max_sim,
  CASE WHEN coalesce(best, 0) > 0 THEN best_pos WHEN n < 2 THEN NULL WHEN w.pos = 0 THEN 1 ELSE 0 END AS most_similar_pos,
  count(*) OVER (PARTITION BY w.conv_id, norm) > 1 OR coalesce(near, false) AS near_duplicate, coalesce(nb, 0) AS neighbours,
  {_r3("coalesce(mean, 0)")} AS neighbour_mean, coalesce(js, []) AS js FROM w JOIN nq USING (conv_id) LEFT JOIN ds ON ds.conv_id = w.conv_id AND ds.pos = w.pos"""


def _regularity(times: str) -> str:
    """Of a sorted list of whole seconds."""
    gaps = f"[g FOR g IN list_transform(range(2, len({times}) + 1), lambda k: {times}[k] - {times}[k - 1])]"
    return f"""CASE WHEN len({times}) < 4 THEN NULL WHEN list_avg({gaps}) = 0 THEN 1.0 ELSE {_r3(_clamp(f"1 - sqrt(list_avg([(g - list_avg({gaps})) * (g - list_avg({gaps})) FOR g IN {gaps}])) / nullif(list_avg({gaps}), 0)"))} END"""


PARTS["tm0"] = """SELECT r.conv_id, r.pos, r.reply_id, r.account_id, greatest(0, r.e - 1704067200) AS seconds_after, count(dt) FILTER (dt <= 30) AS within30, count(dt) FILTER (dt <= 60) AS within60,
  list_sort(list_concat([any_value(r.e)], coalesce(list(y.e) FILTER (y.e IS NOT NULL), []))) AS times
  FROM r LEFT JOIN (SELECT * FROM d WHERE sim >= 0.72) q ON q.conv_id = r.conv_id AND q.i = r.pos LEFT JOIN r y ON y.conv_id = q.conv_id AND y.pos = q.j GROUP BY r.conv_id, r.pos, r.reply_id, r.account_id, r.e"""
PARTS["tm"] = f"SELECT conv_id, pos, reply_id, account_id, seconds_after, within30, within60, within60 >= 2 AS in_burst, {_regularity('times')} AS regularity FROM tm0"
PARTS["tg0"] = """SELECT conv_id, pos, reply_id, account_id, k - 1 AS ix, words[k] AS a, words[k + 1] AS b, words[k + 2] AS c
  FROM (SELECT *, unnest(range(1, len(words) - 1)) AS k FROM w WHERE len(words) >= 3)"""
PARTS["tg"] = f"SELECT *, a || ' ' || b || ' ' || c AS trigram FROM tg0 WHERE NOT (a IN (SELECT unnest({STOP})) AND b IN (SELECT unnest({STOP})) AND c IN (SELECT unnest({STOP})))"
PARTS["sh"] = """SELECT conv_id, trigram, count(DISTINCT account_id) AS accounts, list_sort(list_distinct(list(reply_id))) AS rs, min((pos, ix)) AS f1
  FROM tg GROUP BY ALL HAVING count(DISTINCT account_id) >= 3"""
PARTS["gr"] = "SELECT conv_id, rs, min(f1) AS f1, any_value(accounts) AS account_count FROM sh GROUP BY conv_id, rs"
PARTS["sp"] = "SELECT DISTINCT sh.conv_id, sh.rs, tg.reply_id, tg.ix FROM sh JOIN tg ON tg.conv_id = sh.conv_id AND tg.trigram = sh.trigram AND tg.reply_id = sh.rs[1]"
PARTS["il"] = """SELECT *, sum(CASE WHEN ix > coalesce(b4, -9) + 3 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, rs ORDER BY ix) AS island
  FROM (SELECT *, lag(ix) OVER (PARTITION BY conv_id, rs ORDER BY ix) AS b4 FROM sp)"""
PARTS["ct"] = "SELECT conv_id, rs, reply_id, island, min(ix) AS a, max(ix) AS b FROM il GROUP BY ALL"
PARTS["pt0"] = "SELECT ct.conv_id, ct.rs, ct.a, array_to_string(words[ct.a + 1:ct.b + 3], ' ') AS text, f1, account_count FROM ct JOIN w USING (conv_id, reply_id) JOIN gr ON gr.conv_id = ct.conv_id AND gr.rs = ct.rs"
PARTS["pt"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY account_count DESC, length(text) DESC, f1, a) AS rank FROM pt0) WHERE rank <= 30"
PARTS["rp"] = "SELECT conv_id, reply_id, list_sort(list(rank)) AS ranks FROM (SELECT conv_id, rank, unnest(rs) AS reply_id FROM pt) GROUP BY ALL"
PARTS["rr"] = "SELECT r.conv_id, pos, reply_id, account_id, e, first_pos, coalesce(ranks, []) AS ranks FROM r JOIN a USING (conv_id, account_id) LEFT JOIN rp USING (conv_id, reply_id)"
PARTS["co0"] = f"""SELECT p.conv_id, sim, CASE WHEN x.first_pos < y.first_pos THEN x ELSE y END AS l, CASE WHEN x.first_pos < y.first_pos THEN y ELSE x END AS m, abs(x.e - y.e) AS dt,
  greatest(0, 1 - abs(x.e - y.e) / 120.0) AS timing, CASE WHEN len(x.ranks) = 0 OR len(y.ranks) = 0 THEN 0 ELSE
  len(list_intersect(x.ranks, y.ranks))::DOUBLE / len(list_distinct(list_concat(x.ranks, y.ranks))) END AS shared
  FROM p JOIN rr x ON x.conv_id = p.conv_id AND x.pos = p.i JOIN rr y ON y.conv_id = p.conv_id AND y.pos = p.j WHERE x.account_id <> y.account_id"""
PARTS["co1"] = f"SELECT *, {_r3(_clamp('0.55 * sim + 0.30 * timing::DOUBLE + 0.15 * shared'))} AS score FROM co0"
PARTS["co"] = f"""SELECT conv_id, least(l.account_id, m.account_id) AS source, greatest(l.account_id, m.account_id) AS target, score, {_r3('sim')} AS text_similarity,
  {_r3('timing::DOUBLE')} AS timing, {_r3('shared')} AS shared, dt, CASE WHEN l.account_id < m.account_id THEN l.reply_id ELSE m.reply_id END AS source_reply,
  CASE WHEN l.account_id < m.account_id THEN m.reply_id ELSE l.reply_id END AS target_reply FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, l.account_id, m.account_id ORDER BY score DESC, l.pos, m.pos) AS k FROM co1 WHERE score >= 0.75) WHERE k = 1"""
PARTS["bt0"] = f"""SELECT x.conv_id, coalesce(sim, 0) AS sim, CASE WHEN x.first_pos < y.first_pos THEN x ELSE y END AS l, CASE WHEN x.first_pos < y.first_pos THEN y ELSE x END AS m, abs(x.e - y.e) AS dt,
  greatest(0, 1 - abs(x.e - y.e) / 120.0) AS timing, CASE WHEN len(x.ranks) = 0 OR len(y.ranks) = 0 THEN 0 ELSE
  len(list_intersect(x.ranks, y.ranks))::DOUBLE / len(list_distinct(list_concat(x.ranks, y.ranks))) END AS shared
  FROM rr x JOIN rr y ON y.conv_id = x.conv_id AND x.pos < y.pos LEFT JOIN p ON p.conv_id = x.conv_id AND x.pos = p.i AND y.pos = p.j WHERE x.account_id <> y.account_id"""
PARTS["bt1"] = f"SELECT *, {_r3(_clamp('0.3 * sim + 0.6 * timing::DOUBLE + 0.1 * shared'))} AS score FROM bt0"
PARTS["bt"] = f"""SELECT conv_id, least(l.account_id, m.account_id) AS source, greatest(l.account_id, m.account_id) AS target, score, {_r3('sim')} AS text_similarity,
  {_r3('timing::DOUBLE')} AS timing, {_r3('shared')} AS shared, dt, CASE WHEN l.account_id < m.account_id THEN l.reply_id ELSE m.reply_id END AS source_reply,
  CASE WHEN l.account_id < m.account_id THEN m.reply_id ELSE l.reply_id END AS target_reply FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, l.account_id, m.account_id ORDER BY score DESC, l.pos, m.pos) AS k FROM bt1 WHERE score >= 0.69) WHERE k = 1"""
PARTS["dc"] = "SELECT conv_id, source AS account_id, target AS other, score, text_similarity, dt FROM co UNION ALL SELECT conv_id, target, source, score, text_similarity, dt FROM co"
PARTS["walk"] = "SELECT conv_id, account_id, account_id AS other FROM a UNION SELECT walk.conv_id, walk.account_id, dc.other FROM walk JOIN dc ON dc.conv_id = walk.conv_id AND dc.account_id = walk.other"
PARTS["cm"] = "SELECT conv_id, account_id, min(other) AS component FROM walk GROUP BY ALL"
PARTS["al"] = "SELECT conv_id, account_id, avg(text_similarity) AS similarity, count(*) AS links, max(score) AS max_score FROM dc GROUP BY ALL"
PARTS["sa"] = f"""SELECT te.conv_id, least(x.account_id, y.account_id) AS source, greatest(x.account_id, y.account_id) AS target, {_r3('max(sim)')} AS weight, min(dt) AS dt
  FROM te JOIN r x ON x.conv_id = te.conv_id AND x.pos = te.i JOIN r y ON y.conv_id = te.conv_id AND y.pos = te.j WHERE x.account_id <> y.account_id GROUP BY ALL"""
PARTS["sy"] = "SELECT conv_id, account_id, list_distinct(list(other)) AS alike FROM (SELECT conv_id, source AS account_id, target AS other FROM sa UNION ALL SELECT conv_id, target, source FROM sa) GROUP BY ALL"
PARTS["pa"] = "SELECT conv_id, account_id, list_distinct(list(other)) AS partners FROM dc GROUP BY ALL"
PARTS["ac"] = "SELECT conv_id, account_id, count(*) AS reply_count, min(seconds_after) AS first_seconds, min(pos) AS first_pos FROM tm GROUP BY ALL"
PARTS["g"] = f"""SELECT cm.conv_id, cm.account_id, component, count(*) OVER c AS component_size, {_r3('coalesce(avg(similarity) OVER c, 0)')} AS component_similarity,
  len(coalesce(partners, [])) AS coordinated, coalesce(max_score, 0) AS max_score, len(coalesce(alike, [])) AS "similar",
  len([x FOR x IN coalesce(alike, []) IF NOT list_contains(coalesce(partners, []), x)]) + len(coalesce(partners, [])) + reply_count AS degree, first_seconds, first_pos
  FROM cm LEFT JOIN al USING (conv_id, account_id) LEFT JOIN sy USING (conv_id, account_id) LEFT JOIN pa USING (conv_id, account_id) JOIN ac USING (conv_id, account_id)
  WINDOW c AS (PARTITION BY cm.conv_id, component)"""
PARTS["cl0"] = "SELECT conv_id, component, count(*) AS size, min(place) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY first_seconds, first_pos) AS place FROM g) GROUP BY ALL HAVING count(*) >= 3"
PARTS["cl"] = "SELECT conv_id, component, printf('cluster_%02d', index) AS cluster_id, index, size FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY size DESC, place) AS index FROM cl0)"
PARTS["mb"] = "SELECT conv_id, cluster_id, account_id, row_number() OVER (PARTITION BY conv_id, cluster_id ORDER BY first_seconds, first_pos) AS place FROM g JOIN cl USING (conv_id, component)"
PARTS["ie"] = "SELECT co.*, x.cluster_id FROM co JOIN mb x ON x.conv_id = co.conv_id AND x.account_id = source JOIN mb y ON y.conv_id = co.conv_id AND y.account_id = target AND y.cluster_id = x.cluster_id"
PARTS["ss"] = f"SELECT p.conv_id, x.account_id, {_r3('max(sim)')} AS self_similarity FROM p JOIN r x ON x.conv_id = p.conv_id AND x.pos = i JOIN r y ON y.conv_id = p.conv_id AND y.pos = j AND y.account_id = x.account_id GROUP BY ALL"
PARTS["f"] = f"""SELECT s.conv_id, s.account_id, count(*) AS reply_count, min(s.pos) AS first_pos, arg_max(s.reply_id, (max_sim, -s.pos)) AS representative, max(max_sim) AS max_sim,
  {_m3('lex')} AS lex, max(neighbour_mean) AS neighbour_mean, bool_or(near_duplicate) AS near_duplicate, max(within30) AS within30, max(within60) AS within60,
  bool_or(in_burst) AS in_burst, max(regularity) AS regularity, min(seconds_after) AS first_seconds, coalesce(any_value(self_similarity), 0) AS self_similarity,
  flatten(list(coalesce(ranks, []) ORDER BY s.pos)) AS ranks FROM s JOIN tm USING (conv_id, pos) LEFT JOIN rp ON rp.conv_id = s.conv_id AND rp.reply_id = s.reply_id
  LEFT JOIN ss ON ss.conv_id = s.conv_id AND ss.account_id = s.account_id GROUP BY s.conv_id, s.account_id"""
PARTS["pn"] = "SELECT conv_id, account_id, max(account_count) AS phrase_accounts, count(DISTINCT rank) AS n_phrases FROM (SELECT conv_id, account_id, unnest(ranks) AS rank FROM f) JOIN pt USING (conv_id, rank) GROUP BY conv_id, account_id"



def _any(pattern: str, col: str = "everything", flags: str = "i") -> str:
    return f"regexp_matches({col}, {_str(pattern)}, '{flags}')"


def _distinct(pattern: str, col: str = "everything") -> str:
    return f"least(6, len(list_distinct([lower(x) FOR x IN regexp_extract_all({col}, {_str(pattern)}, 0, 'i')])))"


CONTENT = r"list_distinct([x FOR x IN regexp_extract_all(lower(%s), '[\p{L}\p{N}'']+') IF length(x) > 3])"
PARTS["sg"] = f"""SELECT conv_id, account_id, string_agg(text, chr(10) ORDER BY pos) AS everything,
  max(CASE WHEN len({CONTENT % 'text'}) = 0 THEN 0 ELSE len(list_intersect({CONTENT % 'text'}, ['that']))::DOUBLE / len({CONTENT % 'text'}) END) AS off FROM r GROUP BY ALL"""
PARTS["sx"] = f"""SELECT conv_id, account_id, {_any(signals.LINK)} AS linked, {_r3('off')} AS off, length(regexp_replace(everything, '[^\\p{{L}}]', '', 'g')) AS letters,
  length(regexp_replace(everything, '[^\\p{{Lu}}]', '', 'g')) AS upper, {_distinct(signals.URGENCY)} AS urgency FROM sg"""
PARTS["rq"] = """SELECT f.*, am.has_metadata, am.age, am.followers, am.following, am.posts_per_day, g.coordinated, g.max_score, g.component_size, g.component_similarity, g.degree,
  coalesce(phrase_accounts, 0) AS phrase_accounts, coalesce(n_phrases, 0) AS n_phrases, linked, off, urgency, CASE WHEN letters < 20 THEN 0 ELSE floor(upper::DOUBLE / letters * 1000 + 0.5) / 1000 END AS shouting
  FROM f JOIN am USING (conv_id, account_id) JOIN g USING (conv_id, account_id) JOIN sx USING (conv_id, account_id) LEFT JOIN pn USING (conv_id, account_id)"""
_OFF, _LOUD = "(off < 0.05 AND linked)", "(shouting >= 0.5)"
_SKEW = "(coalesce(following >= 5 * greatest(1, followers) AND following >= 200, false))"
PARTS["c0"] = f"""SELECT *, 0.05 + 0.28 * {_clamp('(max_sim - 0.25) / 0.7')} + CASE WHEN near_duplicate THEN 0.10 ELSE 0 END + CASE WHEN in_burst THEN 0.10 ELSE 0 END
  + CASE WHEN reply_count > 1 AND self_similarity >= 0.8 THEN 0.10 ELSE 0 END + CASE WHEN phrase_accounts >= 3 THEN 0.06 ELSE 0 END + CASE WHEN coalesce(regularity >= 0.85, false) THEN 0.05 ELSE 0 END
  + 0.05 * {_clamp('(1 - lex) / 0.4')} + coalesce(0.12 * {_clamp('1 - age / 365.0')}, 0) + CASE WHEN {_SKEW} THEN 0.05 ELSE 0 END + coalesce(0.07 * {_clamp('(posts_per_day - 15) / 45')}, 0) AS raw,
  CASE WHEN coalesce(age, 0) >= 1500 THEN 0.25 WHEN coalesce(age, 0) >= 730 THEN 0.12 ELSE 0 END + CASE WHEN max_sim < 0.35 THEN 0.15 ELSE 0 END AS damp,
  CASE WHEN {_OFF} THEN 0.2 ELSE 0 END + CASE WHEN {_LOUD} THEN 0.05 ELSE 0 END + CASE WHEN urgency >= 2 THEN 0.2 WHEN urgency = 1 THEN 0.08 ELSE 0 END AS spam,
  (max_sim >= 0.5)::INT + near_duplicate::INT + in_burst::INT + (reply_count > 1 AND self_similarity >= 0.8)::INT + (phrase_accounts >= 3)::INT + coalesce(regularity >= 0.85, false)::INT
  + (lex < 0.75)::INT + coalesce(age < 180, false)::INT + {_SKEW}::INT + coalesce(posts_per_day >= 25, false)::INT + {_OFF}::INT + {_LOUD}::INT + (urgency > 0)::INT AS n_for,
  coalesce(age >= 730, false)::INT + (max_sim < 0.35)::INT + (within60 = 0)::INT + (lex >= 0.9 AND max_sim < 0.5)::INT + coalesce(followers >= following AND age >= 365, false)::INT AS n_against,
  (coordinated > 0)::INT + (component_size >= 3)::INT AS n_coordination FROM rq"""
PARTS["c1"] = f"""SELECT *, {_r3(_clamp('greatest((raw / CASE WHEN has_metadata THEN 1 ELSE 0.76 END) * (1 - least(0.5, damp)), spam)', 0.01, 0.97))} AS automation,
  CASE WHEN coordinated = 0 THEN {_r3('least(0.2, 0.05 + 0.03 * within60)')} ELSE {_r3(_clamp('max_score * (0.45 + 0.55 * (1 - exp(-coordinated / 2.5)))'))} END AS coordination FROM c0"""
PARTS["c"] = f"""SELECT *, {_r3(_clamp('0.35 + abs(automation - 0.5) * 0.7 + least(0.12, (n_for + n_against) * 0.02)', 0, 0.85))} AS confidence,
  CASE WHEN automation < 0.4 THEN 'human_like' WHEN automation < 0.65 THEN 'uncertain' ELSE 'automation_like' END AS label,
  CASE WHEN automation < 0.4 THEN 'personal' WHEN automation < 0.65 THEN 'mixed' ELSE 'automated' END AS category FROM c1"""
PARTS["big"] = "SELECT conv_id, sum(n) AS large FROM (SELECT conv_id, cluster_id, count(*) AS n FROM mb GROUP BY ALL HAVING count(*) >= 5) GROUP BY conv_id"
PARTS["sc0"] = """SELECT conv_id, count(*) FILTER (label = 'automation_like')::DOUBLE / count(*) AS au, count(*) FILTER (coordinated > 0)::DOUBLE / count(*) AS cs, count(*) AS n FROM c GROUP BY conv_id"""
PARTS["sc"] = f"""SELECT conv_id, {_r3('least(1, 0.40 * au + 0.20 * cs + 0.25 * dup + 0.15 * (coalesce(large, 0)::DOUBLE / n))')} AS score, {_r3('au')} AS automation_share, {_r3('cs')} AS coordinated_share,
  {_r3('dup')} AS duplicate_share, {_r3('coalesce(large, 0)::DOUBLE / n')} AS large_cluster_share
  FROM sc0 JOIN (SELECT conv_id, avg(near_duplicate::INT) AS dup FROM s GROUP BY conv_id) USING (conv_id) LEFT JOIN big USING (conv_id)"""
PARTS["ed"] = "SELECT conv_id, source, target, 'SIMILAR' AS type, weight, dt FROM sa UNION ALL SELECT conv_id, source, target, 'COORDINATED', score, dt FROM co"
PARTS["lk0"] = """SELECT conv_id, 'a:' || account_id AS a, 'r:' || reply_id AS b, 'POSTED' AS kind FROM r UNION ALL
  SELECT te.conv_id, 'r:' || x.reply_id, 'r:' || y.reply_id, 'SIMILAR_TO' FROM te JOIN r x ON x.conv_id = te.conv_id AND x.pos = i JOIN r y ON y.conv_id = te.conv_id AND y.pos = j
  UNION ALL SELECT conv_id, 'a:' || source, 'a:' || target, 'COORDINATED_WITH' FROM co"""
PARTS["lk"] = "SELECT conv_id, a, b, kind FROM lk0 UNION ALL SELECT conv_id, b, a, kind FROM lk0"
PARTS["src"] = "SELECT conv_id, arg_min(account_id, first_pos) AS source FROM a GROUP BY conv_id"
PARTS["bfs"] = "SELECT conv_id, source, 'a:' || source AS node, 0 AS n FROM src UNION SELECT bfs.conv_id, source, b, n + 1 FROM bfs JOIN lk ON lk.conv_id = bfs.conv_id AND lk.a = bfs.node WHERE n < 12"
PARTS["dst"] = "SELECT conv_id, source, node, min(n) AS n FROM bfs GROUP BY ALL"
PARTS["way"] = """SELECT conv_id, source, 'a:' || source AS node, ['a:' || source] AS path, 0 AS n FROM src UNION ALL SELECT way.conv_id, way.source, lk.b, min(list_append(way.path, lk.b)), way.n + 1
  FROM way JOIN lk ON lk.conv_id = way.conv_id AND lk.a = way.node JOIN dst ON dst.conv_id = way.conv_id AND dst.source = way.source AND dst.node = lk.b AND dst.n = way.n + 1 GROUP BY way.conv_id, way.source, lk.b, way.n"""
RECURSIVE = {"walk", "bfs", "way"}
#: Parts that several others read.
KEPT = {"r", "w", "t", "wt", "p", "d", "te", "s", "tm", "tg", "sh", "pt", "rp", "co", "dc", "cm", "g", "cl", "mb", "f", "c", "sa", "lk", "dst"}


def _uses(sql: str) -> set[str]:
    return {n for n in PARTS if re.search(rf"(?:FROM|JOIN)\s+{n}\b", sql)}


def _sql(select: str) -> str:
    """The select behind all parts that it needs, in order."""
    need, todo = set(), _uses(select)
    while todo:
        n = todo.pop()
        if n not in need:
            need.add(n)
            todo |= _uses(PARTS[n]) - need
    parts = [f"{n} AS {'MATERIALIZED ' if n in KEPT else ''}({sql})" for n, sql in PARTS.items() if n in need]
    if not parts:
        return select
    own = select.removeprefix("WITH ")
    return "WITH RECURSIVE " + ",\n".join(parts) + (",\n" if own != select else "\n") + own


def _labels(low: float, high: float, p: str = "automation") -> str:
    return f"CASE WHEN {p} < {low} THEN 'human_like' WHEN {p} < {high} THEN 'uncertain' ELSE 'automation_like' END"


FEATURES = "conv_id, account_id, reply_count, first_pos, representative, max_sim, lex, neighbour_mean, near_duplicate, within30, within60, in_burst, regularity, first_seconds, self_similarity"
ORDER = "CASE category " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(views.CATEGORIES)) + " END"
SAMPLES = _values([(k, t, p) for k, (_, t, p) in enumerate(fixtures.SIGNAL_TEXTS)])
LITERAL_TEXTS = f"""SELECT doc_id, array_to_string(texts, chr(10)) AS everything, texts, parent FROM (SELECT doc_id, parent,
  CASE WHEN doc_id // {len(fixtures.SIGNAL_TEXTS)} % 2 = 0 THEN list_append(said, coalesce(text, '')) ELSE list_append(said[1:len(said) - 1], said[len(said)] || ' ' || coalesce(source, '')) END AS texts
  FROM documents JOIN ({SAMPLES}) AS v(k, said, parent) ON k = doc_id % {len(fixtures.SIGNAL_TEXTS)})"""
RULE_COUNT = r"len(regexp_extract_all(everything, %s, 0, '%s'))"
WORD_SQL = r"'[\p{L}\p{N}'']+'"
URL_ROWS = f"SELECT page_id, replace({_str(fixtures.URLS)}[page_id % {len(fixtures.URLS)} + 1], 'jane', 'u' || page_id) AS raw FROM pages"
ANALYSIS_ROWS = """(SELECT md5(CAST(o_orderkey AS VARCHAR)) AS analysis_id, (CAST(o_orderdate AS DATE) - DATE '1970-01-01')::BIGINT * 86400 + o_orderkey % 86400 AS created_at,
  o_orderkey % 11 = 0 AS demo, o_orderkey % 13 = 0 AS running, o_orderkey AS n FROM orders)"""
SCAN_TIME = "1704067200 + turn * 10 - CASE WHEN turn % 4 = 2 THEN 100 ELSE 0 END AS sec"
SCAN_ROWS = f"""(SELECT CAST(conv_id AS VARCHAR) AS conv_id, turn AS seq, turn = 0 AS focal, 't' || turn AS id, role AS handle, CASE WHEN turn % 5 <> 3 THEN text ELSE '' END AS text, {SCAN_TIME} FROM conversations
  UNION ALL SELECT CAST(conv_id AS VARCHAR), turn + 1000000, turn = 0, 't' || turn, upper(role), 'again ' || text, {SCAN_TIME} FROM conversations)"""
DT120 = "greatest(0, 1 - abs(dt) / 120.0::DOUBLE)"
SHARED5 = "(CASE WHEN k < 1 THEN 1 WHEN k < 2 THEN 2 ELSE 3 END)::DOUBLE / CASE WHEN k + 3 < 5 THEN 5 ELSE k + 3 END"
MERGED_SQL = f"""(SELECT conv_id, id, handle, text, sec, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY seq) - 1 AS INTEGER) AS pos FROM (
  SELECT conv_id, id, min(seq) AS seq, arg_min(handle, seq) AS handle, arg_min(text, seq) AS text, arg_min(sec, seq) AS sec FROM {SCAN_ROWS}
  WHERE NOT focal AND trim(text) <> '' AND id <> 't0' GROUP BY conv_id, id))"""

def _firsts(pattern: str) -> str:
    """The first six distinct matches, in lower case."""
    return f"list_filter([lower(x) FOR x IN regexp_extract_all(everything, {_str(pattern)}, 0, 'i')], lambda x, i: list_position([lower(y) FOR y IN regexp_extract_all(everything, {_str(pattern)}, 0, 'i')], x) = i)[1:6]"


def _pct(x: str) -> str:
    return f"(CAST(floor({x} * 100 + 0.5) AS BIGINT) || '%')"


PARTS["ev"] = f"""SELECT c.*, [x FOR x IN [
    CASE WHEN max_sim >= 0.5 THEN {_pct('max_sim')} || ' text similarity with another reply' END, CASE WHEN near_duplicate THEN 'Near-duplicate of another reply in this conversation' END,
    CASE WHEN in_burst THEN within60 || ' similar replies posted within 60 seconds' END,
    CASE WHEN reply_count > 1 AND self_similarity >= 0.8 THEN 'Posted the same reply ' || reply_count || ' times (' || {_pct('self_similarity')} || ' self-similarity)' END,
    CASE WHEN phrase_accounts >= 3 THEN 'Uses a stock phrase shared by ' || phrase_accounts || ' accounts' END,
    CASE WHEN regularity >= 0.85 THEN 'Similar replies arrive at evenly spaced intervals (' || {_pct('regularity')} || ' regularity)' END,
    CASE WHEN lex < 0.75 THEN 'Low lexical variation (' || {_pct('lex')} || ')' END, CASE WHEN age < 180 THEN 'Account is ' || age || ' days old' END,
    CASE WHEN {_SKEW} THEN 'Follows ' || following || ' accounts but has ' || followers || ' followers' END,
    CASE WHEN posts_per_day >= 25 THEN 'Posts about ' || CAST(floor(posts_per_day + 0.5) AS BIGINT) || ' times per day' END,
    CASE WHEN urgency > 0 THEN 'Pressure language (' || array_to_string({_firsts(signals.URGENCY)}, ', ') || ')' END,
    CASE WHEN {_OFF} THEN 'Off-topic reply carrying a link' END, CASE WHEN {_LOUD} THEN 'Mostly upper-case text' END] IF x IS NOT NULL] AS for_,
  [x FOR x IN [CASE WHEN age >= 1500 THEN 'Account history spans ' || printf('%.1f', age / 365.0::DOUBLE) || ' years' END, CASE WHEN age >= 730 AND age < 1500 THEN 'Account is more than two years old' END,
    CASE WHEN max_sim < 0.35 THEN 'Reply language is distinct from every other reply' END, CASE WHEN within60 = 0 THEN 'No similar replies posted around the same time' END,
    CASE WHEN lex >= 0.9 AND max_sim < 0.5 THEN 'Varied vocabulary (' || {_pct('lex')} || ' lexical diversity)' END,
    CASE WHEN followers >= following AND age >= 365 THEN 'Established audience (' || followers || ' followers)' END] IF x IS NOT NULL] AS against,
  [x FOR x IN [CASE WHEN coordinated > 0 THEN 'Coordinated text and timing with ' || coordinated || ' other account' || CASE WHEN coordinated = 1 THEN '' ELSE 's' END || ' (strongest link ' || {_pct('max_score')} || ')' END,
    CASE WHEN component_size >= 3 THEN 'Member of a ' || component_size || '-account group averaging ' || {_pct('component_similarity')} || ' text similarity' END] IF x IS NOT NULL] AS shared
  FROM c JOIN (SELECT conv_id, account_id, everything FROM sg) USING (conv_id, account_id)"""


def _spam_sql() -> str:
    """All spam rules and categories, from the counts of text_signals."""
    pointers = ["check my bio", "check out my bio", "check my profile", "check out my profile", "link in bio", "link in my bio"]
    strong = f"len([x FOR x IN adults IF NOT list_contains({_str(pointers)}, x)]) > 0"
    pointed = "(mentions > 0 OR n_messaging > 0)"
    spam = " + ".join(f"CASE {x} ELSE 0 END" for x in (
        "WHEN n_messaging > 0 THEN 0.45", "WHEN n_crypto >= 2 AND links > 0 THEN 0.45 WHEN n_crypto >= 2 THEN 0.25", "WHEN n_urgency >= 2 THEN 0.2 WHEN n_urgency = 1 THEN 0.08",
        "WHEN n_shortened > 0 THEN 0.15", "WHEN parent_overlap < 0.05 AND links > 0 THEN 0.2", "WHEN thread_hook THEN 0.12", "WHEN emojis >= 3 AND emoji_density >= 0.12 THEN 0.08",
        "WHEN uppercase_ratio >= 0.5 THEN 0.05", "WHEN strong THEN 0.7 WHEN n_adult > 0 THEN 0.1", "WHEN n_money >= 2 AND pointed THEN 0.7 WHEN n_money = 1 AND pointed THEN 0.5 WHEN n_money > 0 THEN 0.2",
        "WHEN n_job >= 2 OR n_job > 0 AND n_messaging > 0 THEN 0.45 WHEN n_job > 0 THEN 0.2", "WHEN n_follow >= 2 THEN 0.7 WHEN n_follow = 1 THEN 0.45", "WHEN generic_praise THEN 0.3",
    ))
    scam = "(n_messaging > 0 OR n_crypto >= 2 OR strong OR n_money > 0 AND pointed OR n_job >= 2 OR n_job > 0 AND n_messaging > 0)"

    def category(name: str) -> str:
        """Of accounts with that label."""
        human = name == "human_like"
        last = {"human_like": "personal", "uncertain": "mixed", "automation_like": "automated"}[name]
        return f"""CASE WHEN {scam} AND {not human} THEN 'scam' WHEN n_milestones > 0 THEN 'milestone' WHEN n_promotions >= 2 OR n_promotions > 0 AND (n_ai_style >= 2 OR hashtags >= 3) THEN 'ai_ad'
          WHEN n_ai_style >= 3 AND substantive THEN 'ai_useful' WHEN n_ai_style >= 3 THEN 'ai_low_value' WHEN {human} THEN 'personal' WHEN n_follow > 0 THEN 'follow_farming'
          WHEN generic_praise THEN 'generic_comment' WHEN thread_hook THEN 'engagement_bait' ELSE '{last}' END AS category_{name}"""

    more = f"""SELECT doc_id, len(regexp_extract_all(everything, '(^|[^\\w@])@\\w{{2,}}')) AS mentions, len(regexp_extract_all(everything, '(^|[^\\w#])#[\\p{{L}}\\p{{N}}_]{{2,}}')) AS hashtags, {_firsts(signals.ADULT)} AS adults FROM ({LITERAL_TEXTS})"""
    return f"""SELECT doc_id, {_r3(f'least(0.95, {spam})::DOUBLE')} AS spam, {", ".join(map(category, ("human_like", "uncertain", "automation_like")))}
      FROM (SELECT *, {strong} AS strong, {pointed} AS pointed FROM (%s) JOIN ({more}) USING (doc_id))"""


SELECTS: dict[str, str] = {
    "normalised_text": "SELECT conv_id, pos, norm FROM w",
    "lexical_diversity": "SELECT conv_id, pos, token_count, lex FROM s",
    "shingle_counts": "SELECT w.conv_id, w.pos, greatest(0, len(words) - 2) AS shingles, count(trigram) AS contentful FROM w LEFT JOIN tg ON tg.conv_id = w.conv_id AND tg.pos = w.pos GROUP BY ALL",
    "tfidf_df": "SELECT conv_id, term, df FROM dfq",
    "tfidf_weights": f"SELECT conv_id, pos, term, {_r3('w')} AS w FROM wt",
    "tfidf_pairs": f"SELECT conv_id, i, j, {_r3('sim')} AS sim FROM p",
    "similar_pairs": f"SELECT conv_id, i, j, {_r3('sim')} AS sim FROM p WHERE sim >= 0.72",
    "coordination_candidates": f"SELECT conv_id, i, j, {_r3('sim')} AS sim FROM p WHERE sim >= (0.75 - 0.0005 - 0.30 - 0.15) / 0.55",
    "best_matches": f"SELECT conv_id, pos, {_r3('best')} AS best, best_pos FROM ds WHERE best > 0",
    "event_neighbours": """WITH x AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS t FROM events), y AS (SELECT event_id,
      count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 1800 PRECEDING AND 1800 FOLLOWING) - 1 AS within30,
      count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 3600 PRECEDING AND 3600 FOLLOWING) - 1 AS within60, user_id, t FROM x)
      SELECT event_id, CASE WHEN user_id IS NOT NULL AND t IS NOT NULL THEN within30 END AS within30, CASE WHEN user_id IS NOT NULL AND t IS NOT NULL THEN within60 END AS within60,
      CASE WHEN user_id IS NOT NULL AND t IS NOT NULL THEN within60 >= 2 END AS in_burst FROM y""",
    "click_bursts": """WITH x AS (SELECT click_id, client_id, kind, epoch_us(ts) // 1000000 AS t, client_id IS NOT NULL AND kind IS NOT NULL AND ts IS NOT NULL AS ok FROM clicks), y AS (SELECT click_id,
      count(*) OVER (PARTITION BY client_id, kind ORDER BY t RANGE BETWEEN 30 PRECEDING AND 30 FOLLOWING) - 1 AS within30,
      count(*) OVER (PARTITION BY client_id, kind ORDER BY t RANGE BETWEEN 60 PRECEDING AND 60 FOLLOWING) - 1 AS within60, ok FROM x)
      SELECT click_id, CASE WHEN ok THEN within30 END AS within30, CASE WHEN ok THEN within60 END AS within60, CASE WHEN ok THEN within60 >= 2 END AS in_burst FROM y""",
    "errors_near_purchases": """WITH x AS (SELECT client_id, kind, click_id, epoch_us(ts) // 1000000 AS t FROM clicks)
      SELECT a.client_id, a.click_id AS purchase, b.click_id AS error, b.t - a.t AS seconds FROM x a JOIN x b ON a.client_id = b.client_id AND a.kind = 'purchase' AND b.kind = 'error' AND abs(a.t - b.t) <= 600""",
    "coordination_by_time": "SELECT * FROM bt",
    "embedding_pairs": f"""WITH v AS (SELECT vec_id % 64 AS conv_id, vec_id // 64 AS pos, embedding::DOUBLE[] AS x FROM embeddings) SELECT a.conv_id, a.pos AS i, b.pos AS j,
      {_r3('least(greatest(list_cosine_similarity(a.x, b.x), 0), 1)')} AS sim FROM v a JOIN v b ON a.conv_id = b.conv_id AND a.pos < b.pos""",
    "pair_lookup": f"""SELECT q.conv_id, q.a, q.b, {_r3('CASE WHEN q.a = q.b THEN 1.0 ELSE coalesce(sim, 0) END')} AS sim
      FROM (SELECT conv_id, pos AS a, (pos * 7 + 3) % 11 AS b FROM r) q LEFT JOIN p ON p.conv_id = q.conv_id AND i = least(q.a, q.b) AND j = greatest(q.a, q.b)""",
    "similarity_edges": f"SELECT conv_id, i, j, {_r3('sim')} AS sim, dt FROM te",
    "reply_similarity": "SELECT conv_id, pos, max_sim, near_duplicate, neighbours, neighbour_mean FROM s",
    "most_similar_reply": "SELECT conv_id, pos, most_similar_pos FROM s",
    "neighbour_lists": "SELECT conv_id, pos, array_to_string(js[1:5], ',') AS first_neighbours FROM s WHERE neighbours > 0",
    "near_duplicates": "SELECT conv_id, reply_id, account_id FROM s WHERE near_duplicate",
    "comparisons": "SELECT conv_id, n * (n - 1) // 2 AS comparisons FROM nq",
    "repeated_trigrams": "SELECT conv_id, trigram, accounts, array_to_string(rs, ',') AS replies FROM sh",
    "repeated_phrases": "SELECT conv_id, 'pattern_' || rank AS pattern_id, text, account_count, len(rs) AS replies FROM pt",
    "reply_phrases": "SELECT conv_id, reply_id, array_to_string(ranks, ',') AS patterns FROM rp",
    "timing_bursts": "SELECT conv_id, pos, seconds_after, within30, within60, in_burst FROM tm",
    "timing_regularity": "SELECT conv_id, pos, regularity FROM tm WHERE regularity IS NOT NULL",
    "event_regularity": f"""WITH x AS (SELECT user_id, event_type, list(epoch_us(ts) // 1000000 ORDER BY ts) AS t FROM events GROUP BY ALL)
      SELECT user_id, event_type, len(t) AS events, {_regularity('t')} AS regularity FROM x""",
    "event_gaps": """SELECT event_id, CAST(floor((epoch_us(ts) - epoch_us(b)) / 1000000.0) AS BIGINT) AS ahead, CAST(abs(floor((epoch_us(b) - epoch_us(ts)) / 1000000.0)) AS BIGINT) AS back
      FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)""",
    "coordination_edges": "SELECT * FROM co",
    "coordination_adjacency": "SELECT conv_id, account_id, count(*) AS edges, max(score) AS best FROM dc GROUP BY ALL",
    "coordination_terms": f"""WITH x AS (SELECT id % 10 / 9.0::DOUBLE AS text, id // 10 % 10 * 17 - 20 AS dt, id // 100 AS k FROM range(0, 1000) AS v(id))
      SELECT text, dt, k, {_r3(DT120)} AS timing, {_r3(SHARED5)} AS shared, {_r3(_clamp(f'0.55 * text + 0.30 * {DT120} + 0.15 * ({SHARED5})'))} AS score FROM x""",
    "components": "SELECT conv_id, account_id, component FROM cm",
    "components_iterative": "SELECT conv_id, account_id, component FROM cm",
    "client_groups": """WITH RECURSIVE cli AS MATERIALIZED (SELECT client_id, master_id, lower(email) AS email, lower(name) AS name FROM clients WHERE client_id IS NOT NULL),
      gro AS (SELECT CAST(client_id AS VARCHAR) AS a, CAST(master_id AS VARCHAR) AS b FROM cli WHERE master_id IS NOT NULL
        UNION SELECT CAST(x.client_id AS VARCHAR), CAST(y.client_id AS VARCHAR) FROM cli x JOIN cli y ON x.email = y.email
        UNION SELECT CAST(x.client_id AS VARCHAR), CAST(y.client_id AS VARCHAR) FROM cli x JOIN cli y ON x.name = y.name),
      edg AS MATERIALIZED (SELECT a, b FROM gro UNION SELECT b, a FROM gro),
      ver AS (SELECT CAST(client_id AS VARCHAR) AS a FROM cli UNION SELECT a FROM edg),
      hop AS (SELECT a, a AS b FROM ver UNION SELECT hop.a, edg.b FROM hop JOIN edg ON edg.a = hop.b),
      mem AS (SELECT a AS account_id, min(b) AS component FROM hop GROUP BY a)
      SELECT account_id, component, count(*) OVER (PARTITION BY component) AS size FROM mem""",
    "account_links": f"SELECT conv_id, account_id, {_r3('similarity')} AS similarity, links, max_score FROM al",
    "graph_features": """SELECT conv_id, account_id, component, component_size, component_similarity, coordinated, max_score, "similar", degree, first_seconds FROM g""",
    "similar_account_edges": "SELECT * FROM sa",
    "account_edges": "SELECT * FROM ed",
    "clusters": "SELECT * FROM cl",
    "cluster_members": "SELECT * FROM mb",
    "graph_counts": """SELECT nq.conv_id, coalesce(x.n, 0) AS accounts, nq.n AS replies, coalesce(y.n, 0) AS edges, coalesce(z.n, 0) AS clusters FROM nq
      LEFT JOIN (SELECT conv_id, count(*) AS n FROM a GROUP BY conv_id) x USING (conv_id) LEFT JOIN (SELECT conv_id, count(*) AS n FROM co GROUP BY conv_id) y USING (conv_id)
      LEFT JOIN (SELECT conv_id, count(*) AS n FROM cl GROUP BY conv_id) z USING (conv_id)""",
    "ranked_members": "SELECT mb.conv_id, cluster_id, account_id, automation, row_number() OVER (PARTITION BY mb.conv_id, cluster_id ORDER BY automation DESC, place) AS place FROM mb JOIN c USING (conv_id, account_id)",
    "account_details": f"""WITH q AS (SELECT x.conv_id, x.account_id AS xa, x.reply_id AS xr, y.account_id AS ya, y.reply_id AS yr, {_r3('sim')} AS sim, dt FROM te JOIN r x ON x.conv_id = te.conv_id AND x.pos = i
      JOIN r y ON y.conv_id = te.conv_id AND y.pos = j WHERE x.account_id <> y.account_id), u AS (SELECT conv_id, xa AS account_id, xr AS reply_id, ya AS other, yr AS other_reply, sim, dt FROM q UNION ALL SELECT conv_id, ya, yr, xa, xr, sim, dt FROM q),
      top AS (SELECT *, row_number() OVER (PARTITION BY conv_id, account_id ORDER BY sim DESC, dt, reply_id, other_reply) AS place FROM u QUALIFY place <= 5),
      near AS (SELECT conv_id, account_id, string_agg(other_reply, ',' ORDER BY place) AS "similar", string_agg(CAST(round(sim * 1000) AS BIGINT) || ':' || dt, ',' ORDER BY place) AS similarities FROM top GROUP BY ALL),
      far AS (SELECT conv_id, account_id, count(DISTINCT other) AS reach FROM (SELECT conv_id, account_id, other FROM dc UNION SELECT x.conv_id, x.account_id, y.other FROM dc x JOIN dc y
        ON y.conv_id = x.conv_id AND y.account_id = x.other AND y.other <> x.account_id) GROUP BY ALL),
      met AS (SELECT conv_id, account_id, string_agg(other, ',' ORDER BY score DESC, other) AS coordinated, string_agg(CAST(round(score * 1000) AS BIGINT) || ':' || dt, ',' ORDER BY score DESC, other) AS scores FROM dc GROUP BY ALL),
      own AS (SELECT conv_id, account_id, string_agg(reply_id, ',' ORDER BY seconds_after, pos) AS replies, string_agg(seconds_after, ',' ORDER BY seconds_after, pos) AS times FROM tm GROUP BY ALL)
      SELECT c.conv_id, c.account_id, label, automation, cluster_id, coalesce(reach, 0) AS reach, coalesce(own.replies, '') AS replies, coalesce("similar", '') AS "similar", coalesce(met.coordinated, '') AS coordinated,
      coalesce(times, '') AS times, coalesce(similarities, '') AS similarities, coalesce(scores, '') AS scores
      FROM c LEFT JOIN mb USING (conv_id, account_id) LEFT JOIN near USING (conv_id, account_id) LEFT JOIN far USING (conv_id, account_id) LEFT JOIN met USING (conv_id, account_id) LEFT JOIN own USING (conv_id, account_id)""",
    "cluster_details": f"""WITH who AS (SELECT mb.conv_id, cluster_id, count(*) AS size, {_m3('automation')} AS automation, {_m3('coordination')} AS coordination, string_agg(account_id, ',' ORDER BY c.automation DESC, place) AS accounts,
          string_agg(CAST(round(c.automation * 1000) AS BIGINT), ',' ORDER BY c.automation DESC, place) AS automations
        FROM mb JOIN c USING (conv_id, account_id) GROUP BY ALL),
      inner_ AS (SELECT conv_id, cluster_id, count(*) AS k, {_m3('text_similarity')} AS similarity, {_m3('score')} AS score FROM ie GROUP BY ALL),
      uses AS (SELECT mb.conv_id, cluster_id, rank, q.text, count(*) AS n FROM mb JOIN r USING (conv_id, account_id) JOIN (SELECT conv_id, rank, text, unnest(rs) AS reply_id FROM pt) q USING (conv_id, reply_id) GROUP BY ALL),
      best AS (SELECT *, row_number() OVER (PARTITION BY conv_id, cluster_id ORDER BY n * len(string_split(text, ' ')) DESC, rank) AS place FROM uses QUALIFY place <= 3),
      told AS (SELECT conv_id, cluster_id, string_agg(text, '|' ORDER BY place) AS phrases, string_agg(n, ',' ORDER BY place) AS uses FROM best GROUP BY ALL)
      SELECT who.conv_id, who.cluster_id, who.size, {_r3('coalesce(k, 0) / (who.size * (who.size - 1) / 2.0)::DOUBLE')} AS density, similarity, score, automation, coordination, accounts, coalesce(phrases, '') AS phrases, automations, coalesce(told.uses, '') AS uses
      FROM who LEFT JOIN inner_ USING (conv_id, cluster_id) LEFT JOIN told USING (conv_id, cluster_id)""",
    "cluster_stats": f"""SELECT conv_id, cluster_id, similarity, score, first_seconds, span_seconds FROM (SELECT conv_id, cluster_id, {_m3('text_similarity')} AS similarity, {_m3('score')} AS score FROM ie GROUP BY ALL) JOIN
      (SELECT q.conv_id, cluster_id, min(seconds_after) AS first_seconds, max(seconds_after) - min(seconds_after) AS span_seconds FROM (SELECT conv_id, cluster_id, source_reply AS reply_id FROM ie UNION SELECT conv_id, cluster_id, target_reply FROM ie) q
      JOIN tm USING (conv_id, reply_id) GROUP BY ALL) USING (conv_id, cluster_id)""",
    "cluster_likelihoods": f"""SELECT *, {_labels(0.4, 0.65)} AS label FROM (SELECT mb.conv_id, cluster_id, {_m3('automation')} AS automation, {_m3('coordination')} AS coordination FROM mb JOIN c USING (conv_id, account_id) GROUP BY ALL)""",
    "cluster_density": f"""SELECT conv_id, cluster_id, size, coalesce(k, 0) AS internal_edges, {_r3('coalesce(k, 0) / (size * (size - 1) / 2.0)::DOUBLE')} AS density
      FROM (SELECT conv_id, cluster_id, count(*) AS size FROM mb GROUP BY ALL) LEFT JOIN (SELECT conv_id, cluster_id, count(*) AS k FROM ie GROUP BY ALL) USING (conv_id, cluster_id)""",
    "cluster_top_phrases": """SELECT conv_id, cluster_id, place, text, uses FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, cluster_id ORDER BY uses * len(string_split(text, ' ')) DESC, rank) AS place FROM (
      SELECT mb.conv_id, cluster_id, rank, q.text, count(*) AS uses FROM mb JOIN r USING (conv_id, account_id) JOIN (SELECT conv_id, rank, text, unnest(rs) AS reply_id FROM pt) q USING (conv_id, reply_id) GROUP BY ALL)) WHERE place <= 3""",
    "account_similar_top5": f"""WITH q AS (SELECT x.conv_id, x.account_id AS xa, x.reply_id AS xr, y.account_id AS ya, y.reply_id AS yr, {_r3('sim')} AS sim, dt FROM te JOIN r x ON x.conv_id = te.conv_id AND x.pos = i
      JOIN r y ON y.conv_id = te.conv_id AND y.pos = j WHERE x.account_id <> y.account_id), u AS (SELECT conv_id, xa AS account_id, xr AS reply_id, ya AS other, yr AS other_reply, sim, dt FROM q UNION ALL SELECT conv_id, ya, yr, xa, xr, sim, dt FROM q)
      SELECT *, row_number() OVER (PARTITION BY conv_id, account_id ORDER BY sim DESC, dt, reply_id, other_reply) AS place FROM u QUALIFY place <= 5""",
    "coordinated_neighbours": "SELECT conv_id, account_id, other, score, dt, row_number() OVER (PARTITION BY conv_id, account_id ORDER BY score DESC, other) AS place FROM dc",
    "two_hop_reach": """SELECT a.conv_id, a.account_id, count(DISTINCT q.other) AS reach FROM a LEFT JOIN (SELECT conv_id, account_id, other FROM dc UNION SELECT x.conv_id, x.account_id, y.other FROM dc x JOIN dc y
      ON y.conv_id = x.conv_id AND y.account_id = x.other AND y.other <> x.account_id) q ON q.conv_id = a.conv_id AND q.account_id = a.account_id GROUP BY ALL""",
    "shortest_path_length": "SELECT conv_id, source, substr(node, 3) AS target, min(n) AS length FROM bfs WHERE node LIKE 'a:%' AND node <> 'a:' || source GROUP BY ALL",
    "shortest_path_steps": """WITH z AS (SELECT conv_id, source, substr(node, 3) AS target, path FROM way WHERE node LIKE 'a:%' AND n > 0),
      y AS (SELECT *, unnest(range(1, len(path))) AS k FROM z), x AS (SELECT conv_id, source, target, CAST(k - 1 AS INTEGER) AS step, path[k] AS a, path[k + 1] AS b FROM y),
      q AS (SELECT conv_id, a, b, min(kind) AS kind FROM lk GROUP BY ALL)
      SELECT x.*, kind, CASE WHEN kind = 'POSTED' AND a LIKE 'r:%' THEN 'POSTED BY' ELSE kind END AS wording FROM x JOIN q USING (conv_id, a, b)""",
    "account_metadata": "SELECT conv_id, account_id, has_metadata, follow_ratio, posts_per_day FROM am",
    "self_similarity": "SELECT * FROM ss",
    "account_features": f"SELECT {FEATURES} FROM f",
    "account_patterns": """SELECT conv_id, account_id, string_agg(rank, ',' ORDER BY k) AS patterns FROM (SELECT conv_id, account_id, rank, min(k) AS k FROM (SELECT conv_id, account_id, unnest(ranks) AS rank, generate_subscripts(ranks, 1) AS k FROM f) GROUP BY ALL) GROUP BY ALL""",
    "account_replies": "SELECT conv_id, account_id, string_agg(reply_id, ',' ORDER BY seconds_after, pos) AS replies FROM tm GROUP BY ALL",
    "classify_accounts": "SELECT conv_id, account_id, label, automation, coordination, confidence, category FROM c",
    "classification_evidence": "SELECT conv_id, account_id, n_for, n_against, n_coordination FROM c",
    "scorer_requests": """SELECT rq.conv_id, rq.account_id, coalesce(k, 0) AS neighbours, reply_count - 1 AS others, least(3, n_phrases) AS phrases, phrase_accounts FROM rq LEFT JOIN (
      SELECT s.conv_id, s.account_id, s.reply_id, least(4, count(DISTINCT y.text)) AS k FROM (SELECT conv_id, account_id, reply_id, unnest(js[1:5]) AS j FROM s) s JOIN r y ON y.conv_id = s.conv_id AND y.pos = s.j AND y.account_id <> s.account_id GROUP BY s.conv_id, s.account_id, s.reply_id) q
      ON q.conv_id = rq.conv_id AND q.reply_id = rq.representative""",
    "thread_score": "SELECT * FROM sc",
    "label_counts": f"SELECT conv_id, label, n, {_r3('n::DOUBLE / sum(n) OVER (PARTITION BY conv_id)')} AS share FROM (SELECT conv_id, label, count(*) AS n FROM c GROUP BY ALL)",
    "sensitivity_relabel": f"SELECT conv_id, account_id, {_labels(0.4 + 0.2, 0.65 + 0.2)} AS at_0, {_labels(0.4, 0.65)} AS at_50, {_labels(0.4 - 0.2, 0.65 - 0.2)} AS at_100 FROM c",
    "coordinated_filter": "SELECT conv_id, account_id FROM g LEFT JOIN mb USING (conv_id, account_id) WHERE cluster_id IS NOT NULL OR coordinated > 0",
    "classification_texts": """SELECT conv_id, account_id, array_to_string(for_, '|') AS signals_for, array_to_string(against, '|') AS signals_against, array_to_string(shared, '|') AS coordination_signals,
      CASE WHEN automation < 0.4 THEN 'Signals are consistent with individual human activity' WHEN automation < 0.65 THEN 'Signals are mixed' ELSE 'Signals suggest automated behavior' END
      || CASE WHEN coordination >= 0.65 THEN ', with strong coordination with other accounts.' WHEN coordination >= 0.4 THEN ', with some coordination with other accounts.' ELSE '.' END
      || CASE WHEN has_metadata THEN '' ELSE ' Account metadata was unavailable, so only text, timing and graph signals were used.' END || ' Local heuristic; behavioral patterns are not proof of automation.' AS summary,
      'LOCAL_HEURISTIC' AS source FROM ev""",
    "common_signals": r"""WITH one AS (SELECT conv_id, category, unnest(list_distinct([regexp_replace(x, '\s*\(\d+%\)$', '') FOR x IN for_])) AS signal FROM ev), q AS (SELECT conv_id, category, signal, count(*) AS n FROM one GROUP BY ALL)
      SELECT *, row_number() OVER (PARTITION BY conv_id, category ORDER BY n DESC, signal) AS place FROM q QUALIFY place <= 4""",
    "feed_groups": f"""SELECT conv_id, category, row_number() OVER (PARTITION BY conv_id ORDER BY {ORDER}) AS index, members, automation, {_r3('members::DOUBLE / sum(members) OVER (PARTITION BY conv_id)')} AS share
      FROM (SELECT conv_id, category, count(*) AS members, {_m3('automation')} AS automation FROM c GROUP BY ALL)""",
    "group_members": "SELECT conv_id, category, account_id, automation, row_number() OVER (PARTITION BY conv_id, category ORDER BY automation DESC, first_pos) AS place FROM c",
    "hidden_counts": f"SELECT conv_id, category, sum(reply_count) AS hidden_posts FROM c WHERE category IN (SELECT unnest({_str(views.HIDEABLE)})) GROUP BY ALL",
    "badges": "SELECT r.conv_id, r.reply_id, r.account_id AS username, label, automation, coordination, cl.index AS cluster FROM r JOIN c USING (conv_id, account_id) LEFT JOIN mb ON mb.conv_id = r.conv_id AND mb.account_id = r.account_id LEFT JOIN cl ON cl.conv_id = mb.conv_id AND cl.cluster_id = mb.cluster_id",
    "reveal_order": "SELECT conv_id, account_id, row_number() OVER (PARTITION BY conv_id ORDER BY first_seconds, first_pos) AS place FROM g",
    "account_search": "SELECT conv_id, account_id FROM a WHERE '@' || lower(account_id) LIKE '%@src1%'",
    "account_lookup": "SELECT conv_id, account_id, first_pos FROM a WHERE lower(account_id) = 'src7'",
    "focus": "SELECT conv_id, source AS account_id, target AS focus FROM ed UNION SELECT conv_id, target, source FROM ed UNION SELECT conv_id, account_id, account_id FROM a",
    "result_lines": """SELECT conv_id, n || ' accounts: ' || h || ' human-like, ' || u || ' uncertain, ' || m || ' automation-like · ' || coalesce(k, 0) || ' clusters · score ' || CAST(floor(score * 100 + 0.5) AS BIGINT) || '%. Experimental heuristic, not ground truth.' AS line
      FROM (SELECT conv_id, count(*) AS n, count(*) FILTER (label = 'human_like') AS h, count(*) FILTER (label = 'uncertain') AS u, count(*) FILTER (label = 'automation_like') AS m FROM c GROUP BY conv_id)
      JOIN sc USING (conv_id) LEFT JOIN (SELECT conv_id, count(*) AS k FROM cl GROUP BY conv_id) USING (conv_id)""",
    "node_sizes": f"SELECT conv_id, account_id, {_r3('(5.5 + 2.1 * sqrt(degree + reply_count)) * (0.55 + 0.45 * least(greatest(sqrt(90.0::DOUBLE / count(*) OVER (PARTITION BY conv_id)), 0.5), 1.0))')} AS size FROM c",
    "text_signals": f"""SELECT doc_id, len(regexp_extract_all(everything, {_str(signals.EMOJI)})) AS emojis, {_r3(f"len(regexp_extract_all(everything, {_str(signals.EMOJI)}))::DOUBLE / greatest(1, len(regexp_extract_all(everything, {WORD_SQL})))")} AS emoji_density,
      {RULE_COUNT % (_str(signals.LINK), 'i')} AS links, CASE WHEN length(regexp_replace(everything, '[^\\p{{L}}]', '', 'g')) < 20 THEN 0 ELSE {_r3("length(regexp_replace(everything, '[^\\p{Lu}]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(everything, '[^\\p{L}]', '', 'g')), 0)")} END AS uppercase_ratio,
      regexp_matches(everything, {_str(signals.THREAD_HOOK.replace("(🧵", "(?m)(🧵", 1))}, 'i') AS thread_hook,
      CASE WHEN parent IS NOT NULL THEN {_r3(f"list_max([CASE WHEN len({CONTENT % 'x'}) = 0 THEN 0 ELSE len(list_intersect({CONTENT % 'x'}, {CONTENT % 'parent'}))::DOUBLE / len({CONTENT % 'x'}) END FOR x IN texts])")} END AS parent_overlap,
      len([x FOR x IN texts IF NOT (regexp_matches(x, {_str(signals.PRAISE)}, 'i') AND len(regexp_extract_all(lower(regexp_replace(x, '@\\w+', ' ', 'g')), {WORD_SQL})) <= 25
        AND len([y FOR y IN regexp_extract_all(lower(regexp_replace(x, '@\\w+', ' ', 'g')), {WORD_SQL}) IF length(y) > 3 AND NOT list_contains({_str(signals.GENERIC_WORDS)}, y)]) <= 1)]) = 0 AS generic_praise,
      len(regexp_extract_all(everything, {WORD_SQL})) >= 60 AND len(regexp_extract_all(everything, {_str("(?m)" + signals.STEPS)}, 0, 'i')) >= 2 AS substantive,
      {", ".join(f"{_distinct(p)} AS n_{n}" for n, p in signals.LISTS.items())} FROM ({LITERAL_TEXTS})""",
    "text_signal_lists": f"""SELECT doc_id, len(regexp_extract_all(everything, '(^|[^\\w@])@\\w{{2,}}')) AS mentions, len(regexp_extract_all(everything, '(^|[^\\w#])#[\\p{{L}}\\p{{N}}_]{{2,}}')) AS hashtags,
      {", ".join(f"array_to_string({_firsts(p)}, '|') AS {n}" for n, p in signals.LISTS.items())} FROM ({LITERAL_TEXTS})""",
    "document_signals": f"""SELECT source, sum({RULE_COUNT.replace('everything', 'text') % (_str(signals.LINK), 'i')}) AS links,
      count(*) FILTER (length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) >= 20 AND {_r3("length(regexp_replace(text, '[^\\p{Lu}]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(text, '[^\\p{L}]', '', 'g')), 0)")} >= 0.5) AS shouting,
      count(*) FILTER ({_any(signals.URGENCY, 'text')}) AS urgent FROM documents GROUP BY source""",
    "target_urls": f"""WITH x AS (SELECT page_id, raw, trim(raw) AS u FROM ({URL_ROWS})), y AS (SELECT *, regexp_matches(u, {_str(targets.X_HOME)}) AS xh, regexp_matches(u, {_str(targets.LINKEDIN_HOME)}) AS lh,
      regexp_matches(u, {_str(targets.X_POST)}) AS xp, regexp_matches(u, {_str(targets.LINKEDIN_POST)}) AS lp FROM x)
      SELECT page_id, raw, CASE WHEN xh OR xp THEN 'X' WHEN lh OR lp THEN 'LinkedIn' END AS site, CASE WHEN xh THEN 'https://x.com/home' WHEN lh THEN 'https://www.linkedin.com/feed/'
      WHEN xp THEN 'https://x.com/' || regexp_extract(u, {_str(targets.X_POST)}, 1) || '/status/' || regexp_extract(u, {_str(targets.X_POST)}, 2) WHEN lp THEN 'https://www.linkedin.com/' || regexp_extract(u, {_str(targets.LINKEDIN_POST)}, 1) || '/' END AS url,
      CASE WHEN xh OR lh THEN true WHEN xp OR lp THEN false END AS feed, {" OR ".join(f"regexp_matches(raw, {_str(p)})" for p in targets.LOGIN)} AS login FROM y""",
    "profile_handles": f"""SELECT page_id, CASE WHEN regexp_matches(raw, '/in/[^/?#]+') THEN url_decode(regexp_extract(raw, '/in/([^/?#]+)', 1)) WHEN regexp_matches(raw, '/company/[^/?#]+') THEN 'company-' || url_decode(regexp_extract(raw, '/company/([^/?#]+)', 1)) END AS handle FROM ({URL_ROWS})""",
    "item_times": f"""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN ((1600000000000 + doc_id * 60000) * 4194304 + doc_id) // 4194304 WHEN doc_id % 4 = 1 THEN doc_id // 4194304 END AS ms, {_str([r for _, r in fixtures.TIMES])}[doc_id % {len(fixtures.TIMES)} + 1] AS relative FROM documents), y AS (SELECT *, regexp_extract(trim(relative), '^(\\d+)\\s*(mo|yr|s|m|h|d|w|y)', 1, 'i') AS n, lower(regexp_extract(trim(relative), '^(\\d+)\\s*(mo|yr|s|m|h|d|w|y)', 2, 'i')) AS u FROM x)
      SELECT doc_id, CASE WHEN ms > 1325376000000 AND ms < 1767225600000 + 86400000 THEN ms ELSE 1767225600000 - coalesce(CASE WHEN n <> '' THEN n::BIGINT * 1000 * CASE u {" ".join(f"WHEN '{k}' THEN {v}" for k, v in targets.UNIT_SECONDS.items())} END END, 0) END AS ms FROM y""",
    "threshold_labels": f"SELECT event_id, p, {_labels(0.4, 0.65, 'p')} AS label, {_labels(0.2, 0.9, 'p')} AS wide FROM (SELECT event_id, CAST(floor(value * 100) AS BIGINT) % 101 / 100.0::DOUBLE AS p FROM events)",
    "duration_texts": """SELECT o_orderkey, n, CASE WHEN n < 90 THEN n || 's' WHEN n < 3600 THEN CAST(floor(n / 60.0 + 0.5) AS BIGINT) || ' min' ELSE printf('%.1f h', floor(n / 3600.0::DOUBLE * 10 + 0.5) / 10) END AS duration,
      CASE WHEN n % 5 = 0 THEN 'account metadata not available' WHEN n >= 365 THEN printf('%.1f years old', floor(n / 365.0::DOUBLE * 10 + 0.5) / 10) ELSE n || ' days old' END AS age FROM (SELECT o_orderkey, o_orderkey * 97 % 20000 AS n FROM orders)""",
    "sent_texts": "SELECT doc_id, length(coalesce(nullif(left(text, 5000), ''), '(post without text)')) AS sent FROM documents",
    "stored_tables": """SELECT conv_id AS analysis_id, name, count(*) AS n FROM (SELECT conv_id, 'analysis' AS name FROM sc UNION ALL SELECT conv_id, 'post' FROM nq UNION ALL SELECT conv_id, 'account' FROM c
      UNION ALL SELECT conv_id, 'reply' FROM r UNION ALL SELECT conv_id, 'pattern' FROM pt UNION ALL SELECT conv_id, 'cluster' FROM cl UNION ALL SELECT conv_id, 'posted' FROM r UNION ALL SELECT conv_id, 'replies_to' FROM r
      UNION ALL SELECT conv_id, 'similar_to' FROM te UNION ALL SELECT conv_id, 'coordinated_with' FROM co UNION ALL SELECT conv_id, 'contains_pattern' FROM (SELECT conv_id, unnest(rs) FROM pt)
      UNION ALL SELECT conv_id, 'member_of' FROM mb) GROUP BY ALL""",
    "turn_similarity": rf"""WITH zr AS (SELECT CAST(conv_id AS VARCHAR) AS conv_id, turn AS pos, trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(replace(lower(text), '’', ''''), 'https?://\S+', ' ', 'g'),
        '@\w+', ' ', 'g'), '''', ''), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM conversations),
      zt AS (SELECT conv_id, pos, term, count(*) AS tf FROM (SELECT conv_id, pos, unnest(string_split(norm, ' ')) AS term FROM zr WHERE norm <> '') GROUP BY ALL),
      zd AS (SELECT conv_id, term, count(*) AS df FROM zt GROUP BY ALL), zn AS (SELECT conv_id, count(*) AS n FROM zr GROUP BY conv_id),
      zw AS (SELECT conv_id, pos, term, tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM zt JOIN zd USING (conv_id, term) JOIN zn USING (conv_id)),
      zu AS (SELECT conv_id, pos, term, w / sqrt(sum(w * w) OVER (PARTITION BY conv_id, pos)) AS w FROM zw),
      zp AS (SELECT x.conv_id, x.pos AS i, y.pos AS j, round(least(greatest(sum(x.w * y.w), 0), 1), 12) AS sim FROM zu x JOIN zu y ON x.conv_id = y.conv_id AND x.term = y.term AND x.pos < y.pos GROUP BY ALL)
      SELECT conv_id, count(*) AS pairs, {_r3('max(sim)')} AS best FROM zp GROUP BY conv_id""",
    "conversation_files": """SELECT CAST(conv_id AS VARCHAR) AS conversation, turn AS pos, 't_' || conv_id || '_' || turn AS reply_id, role AS account_id, text, 1704067200 + turn AS created_at FROM conversations
      WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) <= 400 AND NOT bool_or(trim(text) = '' OR length(text) > 5000))""",
    "validation_report": "SELECT conv_id, 0 AS duplicate_ids, count(*) FILTER (e < 1704067200) AS early, 0 AS two_names, 0 AS reused FROM r GROUP BY conv_id",
    "document_violations": """SELECT CAST(conv_id AS VARCHAR) AS conv_id, (count(*) > 400)::INT + bool_or(trim(text) = '' OR length(text) > 5000)::INT AS n,
      array_to_string([x FOR x IN [CASE WHEN count(*) > 400 THEN 'replies must number 1 to 400' END, CASE WHEN bool_or(trim(text) = '' OR length(text) > 5000) THEN 'replies.text must have 1 to 5000 characters' END] IF x IS NOT NULL], '; ') AS problem FROM conversations GROUP BY conv_id""",
    "retention_keep": f"SELECT x.* EXCLUDE n, demo OR running OR coalesce(k <= 30, false) AS kept FROM {ANALYSIS_ROWS} x LEFT JOIN (SELECT analysis_id, row_number() OVER (ORDER BY created_at DESC, analysis_id) AS k FROM {ANALYSIS_ROWS} WHERE NOT demo AND NOT running) USING (analysis_id)",
    "analysis_status": f"SELECT analysis_id, CASE WHEN running THEN 'COMPARING' ELSE 'COMPLETE' END AS status, n % 50 + CASE WHEN running THEN 0 ELSE 100 END AS replies, n % 7 + CASE WHEN running THEN 0 ELSE 10 END AS accounts FROM {ANALYSIS_ROWS} WHERE running OR NOT demo",
    "stored_ids": f"""SELECT substr(name, 6) AS analysis_id FROM (SELECT CASE n % 4 WHEN 0 THEN 'lens_' || analysis_id WHEN 1 THEN 'lens_' || upper(analysis_id) WHEN 2 THEN 'lens_' || left(analysis_id, 31) ELSE 'other_' || analysis_id END AS name FROM {ANALYSIS_ROWS})
      WHERE regexp_full_match(name, 'lens_[a-f0-9]{{32}}')""",
    "graph_view": """SELECT conv_id, 'account' AS part, account_id AS id, NULL::VARCHAR AS other, label AS kind, automation AS x, coordination AS y, c.degree::BIGINT AS m, replies_made::BIGINT AS n
        FROM c JOIN (SELECT conv_id, account_id, count(*) AS replies_made FROM r GROUP BY ALL) k USING (conv_id, account_id)
      UNION ALL SELECT conv_id, 'edge', source, target, type, weight, NULL, dt::BIGINT, NULL FROM ed
      UNION ALL SELECT conv_id, 'cluster', cluster_id, NULL, NULL, NULL, NULL, size::BIGINT, index::BIGINT FROM cl
      UNION ALL SELECT conv_id, 'score', NULL, NULL, NULL, score, automation_share, NULL, NULL FROM sc""",
    "stored_upserts": """WITH q AS (SELECT o_custkey AS c_custkey, max(o_totalprice) AS most, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS u FROM orders GROUP BY 1)
      SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS nation, CASE WHEN n > 0 AND c_nationkey < 12 THEN most ELSE c_acctbal END AS c_acctbal,
        CASE WHEN u > 0 AND c_nationkey >= 8 THEN n * 10 WHEN c_nationkey < 12 THEN n END AS n_orders, CASE WHEN u > 0 AND c_nationkey >= 8 THEN u END AS n_urgent FROM customer LEFT JOIN q USING (c_custkey)""",
    "clustered_orders": """SELECT o_orderkey, o_orderpriority, count(*) AS n_lines, sum(l_quantity::BIGINT)::BIGINT AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""",
    "customer_totals": """SELECT c_custkey, c_mktsegment, CASE WHEN n_orders IS NULL THEN c_acctbal ELSE most END AS c_acctbal, n_orders FROM customer
      LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS most, count(*) AS n_orders FROM orders GROUP BY ALL) ON o_custkey = c_custkey""",
    "completed_analyses": f"SELECT * EXCLUDE n, CASE WHEN NOT running THEN created_at % 7 / 7.0::DOUBLE END AS score, NOT running AS complete FROM {ANALYSIS_ROWS}",
    "reset_ids": f"SELECT analysis_id FROM {ANALYSIS_ROWS} WHERE demo OR running",
    "scan_merge": f"SELECT conv_id, pos, id, handle, text, sec AS created_at FROM {MERGED_SQL}",
    "finished_thread": f"""WITH m AS (SELECT *, lower(handle) AS account_id FROM {MERGED_SQL}) SELECT m.conv_id, m.account_id, pos, id AS reply_id, text, greatest(sec, 1704067200) AS created_at, username
      FROM m JOIN (SELECT conv_id, account_id, arg_min(handle, pos) AS username FROM m GROUP BY ALL) USING (conv_id, account_id)""",
    "finished_feed": f"""SELECT conv_id, 'feed' AS kind, 'feed-1704104430' AS post_id, 'your X feed' AS author, 'Your X feed: ' || count(*) || ' posts from ' || count(DISTINCT lower(handle)) || ' accounts, captured 2024-01-01 10:20 UTC' AS text, min(sec) - 1 AS created_at FROM {MERGED_SQL} GROUP BY conv_id""",
    "stream_merge": "SELECT doc_id % 32 || '-' || doc_id // 9600 AS conv_id, count(DISTINCT doc_id) AS items FROM documents WHERE trim(text) <> '' GROUP BY ALL",
    "stopped_capture": """WITH xd AS (SELECT doc_id % 32 || '-' || doc_id // 9600 AS conv_id, doc_id, text FROM documents), xs AS (SELECT conv_id, min(doc_id) AS stop FROM xd WHERE doc_id % 97 = 50 GROUP BY ALL)
      SELECT conv_id, count(DISTINCT doc_id) AS items FROM xd LEFT JOIN xs USING (conv_id) WHERE trim(text) <> '' AND doc_id <= coalesce(stop, doc_id) GROUP BY ALL""",
    "live_status": """WITH scanned AS (SELECT CAST(conv_id AS VARCHAR) AS conv_id, turn, turn AS seq, CASE WHEN turn % 5 = 3 THEN '' ELSE text END AS text FROM conversations WHERE turn IS NOT NULL
        UNION ALL SELECT CAST(conv_id AS VARCHAR), turn, turn + 1000000, 'again ' || text FROM conversations WHERE turn IS NOT NULL),
      ends AS (SELECT conv_id, min(seq) + 3 AS stop FROM scanned WHERE turn = 0 AND CAST(conv_id AS BIGINT) % 5 = 2 GROUP BY conv_id),
      seen AS (SELECT conv_id, turn, stop, bool_or(trim(coalesce(text, '')) <> '') AS told FROM scanned LEFT JOIN ends USING (conv_id) WHERE seq <= coalesce(stop, seq) GROUP BY ALL)
      SELECT conv_id, CASE WHEN any_value(stop) IS NOT NULL OR count(*) FILTER (turn <> 0 AND told) >= 400 THEN 'FULL' ELSE 'COLLECTING' END AS status, least(400, count(*) FILTER (turn <> 0 AND told)) AS replies,
      bool_or(turn = 0) AS has_post, count(*) FILTER (turn <> 0 AND NOT told) AS waiting, least(400, count(*) FILTER (turn <> 0 AND told)) AS taken FROM seen GROUP BY conv_id""",
    "cached_answers": f"SELECT conv_id, account_id, k * 4 % 101 / 100.0::DOUBLE AS automation, {_labels(0.4, 0.65, '(k * 4 % 101 / 100.0::DOUBLE)')} AS label, 'SCORER' AS source FROM a",
    "page_items": """SELECT CAST(conv_id AS VARCHAR) AS page, CASE WHEN conv_id % 4 = 2 THEN 'item' WHEN turn = 0 THEN 'post' ELSE 'reply' END AS role, CAST(turn AS INTEGER) AS item,
      CAST(CASE WHEN conv_id % 2 = 0 THEN conv_id * 1000 + turn ELSE 1704067200000 * 4194304 + conv_id * 1000 + turn END AS VARCHAR) AS id, role AS handle, text,
      CASE WHEN conv_id % 2 = 0 THEN 1704067200000 + turn * 1000 ELSE 1704067200000 + (conv_id * 1000 + turn) // 4194304 END AS created_at FROM conversations""",
    "scorer_fallback": "SELECT 'uncertain' AS label, 'HEURISTIC_FALLBACK' AS source, count(*) AS n, max(least(0.3, confidence)) AS most FROM c",
}
SELECTS["spam_floor"] = _spam_sql().replace("%s", SELECTS["text_signals"])


def oracles() -> dict[str, str]:
    return {name: _sql(select) for name, select in SELECTS.items()}
