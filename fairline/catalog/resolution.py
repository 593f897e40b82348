"""Registered entity-resolution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.checks import join_checked
from ..functions.names import compact_key, indel_by_places, letter_places, matching_ratio, team_key, token_key
from ..functions.scalars import collapse_spaces, round6, uuid_from_name
from ..functions.temporal import keep_latest
from ..operators import players as pl
from ..operators import resolve as r
from ..plans.views import view
from ..session import table
from .history import matches
from .players import lineups, observations
from .registry import query

NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"  # the public DNS namespace of RFC 4122


def canonical(spark, sf):
    return view(spark, sf, "v_fixture").withColumnsRenamed({"home_id": "home_team_id", "away_id": "away_team_id"})


def external(spark, sf):
    ext = view(spark, sf, "v_external")
    return ext.withColumn("home_team_id", F.col("external_home_id") - 500000).withColumn("away_team_id", F.col("external_away_id") - 500000)


# ---- name keys ----------------------------------------------------------------------------

@query("b11_collapse_alias", "SELECT club_id, CASE WHEN club_name LIKE 'red widget %' THEN concat('Red/', CAST(p_size AS VARCHAR)) ELSE club_name END AS name FROM v_club JOIN part ON p_partkey = club_id")
def b11(spark, sf):
    clubs = view(spark, sf, "v_club")
    padded = F.concat(F.lit("  "), F.regexp_replace("club_name", " ", "   "), F.lit("\t"))
    aliases = clubs.filter("club_name LIKE 'red widget %'").select(F.col("club_name").alias("alias"), F.regexp_replace("club_name", "red widget ", "Red/").alias("canonical")).distinct()
    named = clubs.select("club_id", collapse_spaces(padded).alias("alias"))
    return named.join(aliases, "alias", "left").select("club_id", F.coalesce("canonical", "alias").alias("name"))


@query("b12_token_key", "SELECT club_id, lower(club_name) AS key FROM v_club")
def b12(spark, sf):
    k = F.col("club_id") % 4
    name = F.when(k == 0, F.concat(F.lit("A.C. "), F.upper("club_name"))).when(k == 1, F.concat("club_name", F.lit(" F.C."))).when(
        k == 2, F.concat(F.lit("Hellas "), F.initcap("club_name"))).otherwise(F.col("club_name"))
    return view(spark, sf, "v_club").select("club_id", token_key(name).alias("key"))


@query("b13_compact_key", "SELECT club_id, replace(lower(club_name), ' ', '') AS key FROM v_club")
def b13(spark, sf):
    name = F.concat(F.lit("The "), F.col("club_name"), F.lit(" de Club-Calcio"))
    return view(spark, sf, "v_club").select("club_id", compact_key(name).alias("key"))


@query("b14_team_key", "SELECT doc_id, length(regexp_replace(strip_accents(replace(lower(text), 'ß', 'ss')), '[^a-z]', '', 'g')) AS letters FROM documents")
def b14(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.length(F.regexp_replace(team_key("text", noise=["-"], aliases={"-": "-"}), "[^a-z]", "")).alias("letters"))


@query("b22_name_uuid", "SELECT club_id, 36 AS length, '5' AS version FROM v_club")
def b22(spark, sf):
    made = view(spark, sf, "v_club").select("club_id", uuid_from_name(NAMESPACE, F.concat(F.lit("club|"), "club_name")).alias("id"))
    return made.select("club_id", F.length("id").alias("length"), F.substring("id", 15, 1).alias("version"))


# ---- identities ---------------------------------------------------------------------------

@query(
    "j3_register_names",
    """ex AS (SELECT DISTINCT club_name FROM v_club WHERE club_id % 2 = 0), nw AS (SELECT DISTINCT club_name FROM v_club WHERE club_name NOT IN (SELECT club_name FROM ex))
 SELECT club_name, concat('known-', club_name) AS team_id FROM ex UNION ALL SELECT club_name, substr(sha256(concat('team|', club_name)), 1, 24) FROM nw""",
)
def j3(spark, sf):
    clubs = view(spark, sf, "v_club")
    known = clubs.filter("club_id % 2 = 0").select(F.concat(F.lit("known-"), "club_name").alias("team_id"), "club_name").distinct()
    return r.register_names(known, clubs, "club_name", "team_id", "team").select("club_name", "team_id")


J4 = """ex AS (SELECT CAST(match_date AS VARCHAR) AS day, league, home_team, away_team, CAST(min(match_id) AS VARCHAR) AS natural_id FROM v_match WHERE match_id % 3 = 0 GROUP BY ALL),
 fd AS (SELECT m.match_id AS source, CASE WHEN m.match_id % 4 = 0 THEN concat('old-', CAST(m.match_id AS VARCHAR)) END AS mapped, e.natural_id, substr(sha256(concat(CAST(m.match_date AS VARCHAR), '|', m.league, '|', m.home_team, '|', m.away_team)), 1, 24) AS made
  FROM v_match m LEFT JOIN ex e ON e.day = CAST(m.match_date AS VARCHAR) AND e.league = m.league AND e.home_team = m.home_team AND e.away_team = m.away_team)"""


def j4_run(spark, sf):
    games = matches(spark, sf).withColumn("source", F.col("match_id"))
    known = games.filter("match_id % 3 = 0").select(F.col("match_id"), "date", "league", "home_team", "away_team")
    known = keep_latest(known, ["date", "league", "home_team", "away_team"], [F.col("match_id")], first=True).withColumn("match_id", F.col("match_id").cast("string"))
    pid = F.concat(F.lit("x"), F.col("source").cast("string"))
    mapping = games.filter("match_id % 4 = 0").select(F.lit("X").alias("provider"), pid.alias("provider_match_id"), F.concat(F.lit("old-"), F.col("match_id").cast("string")).alias("match_id"))
    incoming = games.select(pid.alias("provider_match_id"), "date", "league", "home_team", "away_team", "source")
    return r.upsert_matches(known, mapping, incoming, "X")


@query("j4_match_identity", J4 + " SELECT source, coalesce(mapped, natural_id, made) AS match_id, CASE WHEN mapped IS NOT NULL THEN 'mapped' WHEN natural_id IS NOT NULL THEN 'natural_key' ELSE 'created' END AS method FROM fd")
def j4(spark, sf):
    return j4_run(spark, sf)["records"].select("source", "match_id", "method")


@query(
    "j5_replace_snapshots",
    """q AS (SELECT *, CASE WHEN timing = 'snapshot' THEN CAST(quoted_at AS VARCHAR) ELSE '*' END AS stamp, l_partkey % 5 AS batch FROM v_quote),
 inc AS (SELECT *, max(batch) OVER (PARTITION BY match_id, bookmaker, timing, stamp) AS mb FROM q WHERE l_partkey % 2 = 1),
 kept AS (SELECT match_id, bookmaker, timing, seq, 'new' AS src FROM inc WHERE batch = mb),
 old AS (SELECT match_id, bookmaker, timing, seq, 'old' AS src FROM q WHERE l_partkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM inc i WHERE i.match_id = q.match_id AND i.bookmaker = q.bookmaker AND i.timing = q.timing AND i.stamp = q.stamp))
 SELECT bookmaker, timing, src, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs FROM (SELECT * FROM kept UNION ALL SELECT * FROM old) GROUP BY ALL""",
)
def j5(spark, sf):
    quotes = view(spark, sf, "v_quote").select(
        "match_id", "bookmaker", F.lit("P").alias("provider"), F.lit("1X2").alias("market"), "timing", F.col("quoted_at").alias("timestamp"), "seq", "l_partkey",
        (F.col("l_partkey") % 5).alias("batch"))
    old, new = quotes.filter("l_partkey % 2 = 0").withColumn("src", F.lit("old")), quotes.filter("l_partkey % 2 = 1").withColumn("src", F.lit("new"))
    return r.replace_snapshots(old, new).groupBy("bookmaker", "timing", "src").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"))


TEAMS = """cand AS (SELECT league, lower(team_name) AS k, count(DISTINCT team_id) AS n, min(team_id) AS tid FROM (SELECT league, home_id AS team_id, home_name AS team_name FROM v_fixture UNION ALL SELECT league, away_id, away_name FROM v_fixture) GROUP BY ALL)"""


@query(
    "j6_resolve_teams",
    TEAMS + """, pt AS (SELECT DISTINCT league, external_home_id AS provider_team_id, lower(substr(home_name, 4)) AS k FROM v_external)
 SELECT p.league, p.provider_team_id, CASE WHEN p.provider_team_id % 10 = 0 THEN -1 WHEN n = 1 THEN tid END AS team_id, CASE WHEN p.provider_team_id % 10 = 0 THEN 'mapped' WHEN n = 1 THEN 'normalized_exact' ELSE 'unresolved' END AS method FROM pt p LEFT JOIN cand c ON c.league = p.league AND c.k = p.k""",
)
def j6(spark, sf):
    ext, can = external(spark, sf), canonical(spark, sf)
    asked = ext.select("league", F.col("external_home_id").alias("provider_team_id"), F.col("home_name").alias("provider_team_name")).distinct()
    teams = can.select("league", F.col("home_team_id").alias("team_id"), F.col("home_name").alias("team_name")).unionByName(
        can.select("league", F.col("away_team_id").alias("team_id"), F.col("away_name").alias("team_name")))
    known = asked.filter("provider_team_id % 10 = 0").select("provider_team_id", F.lit(-1).cast("long").alias("team_id")).distinct()
    return r.resolve_teams(asked, teams, known).select("league", "provider_team_id", "team_id", "method")


J7 = TEAMS + """, mt AS (SELECT league, match_date, home_id, away_id, count(*) AS hits, min(match_id) AS mid FROM v_fixture GROUP BY ALL),
 nm AS (SELECT league, external_home_id AS pid, lower(substr(home_name, 4)) AS k FROM v_external UNION ALL SELECT league, external_away_id, lower(replace(away_name, ' Calcio', '')) FROM v_external),
 tr AS (SELECT nm.league, pid, CASE WHEN min(tid) = max(tid) THEN min(tid) END AS tid FROM nm JOIN cand c ON c.league = nm.league AND c.k = nm.k AND c.n = 1 GROUP BY ALL),
 fx AS (SELECT e.external_id, e.true_match_id, CASE WHEN e.league IN ('1', '2', '3') THEN e.league END AS league, e.match_date, h.tid AS ht, a.tid AS at2 FROM v_external e
  LEFT JOIN tr h ON h.league = e.league AND h.pid = e.external_home_id LEFT JOIN tr a ON a.league = e.league AND a.pid = e.external_away_id),
 st AS (SELECT f.*, m.hits, m.mid, CASE WHEN f.league IS NULL THEN 'unsupported_league' WHEN f.external_id % 10 = 0 THEN 'already_mapped' WHEN ht IS NULL OR at2 IS NULL THEN 'team_unresolved'
  WHEN m.hits IS NULL THEN 'match_not_found' WHEN m.hits > 1 THEN 'match_not_unique' ELSE 'mapped' END AS status FROM fx f LEFT JOIN mt m ON m.league = f.league AND m.match_date = f.match_date AND m.home_id = ht AND m.away_id = at2)"""


@query("j7_reconcile_fixtures", J7 + " SELECT external_id AS fixture_id, status, CASE status WHEN 'mapped' THEN mid WHEN 'already_mapped' THEN true_match_id END AS match_id FROM st")
def j7(spark, sf):
    ext, can = external(spark, sf), canonical(spark, sf)
    fixtures = ext.select(
        F.col("external_id").alias("fixture_id"), F.col("league").alias("provider_league_id"), F.col("match_date").alias("date"), F.col("external_home_id").alias("home_provider_id"),
        F.col("external_away_id").alias("away_provider_id"), "home_name", "away_name")
    leagues = ext.select(F.col("league").alias("provider_league_id")).distinct().filter("provider_league_id IN ('1', '2', '3')").withColumn("league", F.col("provider_league_id"))
    games = can.select("match_id", F.col("match_date").alias("date"), "league", "home_team_id", "away_team_id", F.col("home_name").alias("home_team"), F.col("away_name").alias("away_team"))
    known = ext.filter("external_id % 10 = 0").select(F.col("external_id").alias("fixture_id"), F.col("true_match_id").alias("match_id"))
    return r.reconcile_fixtures(fixtures, leagues, games, known).select("fixture_id", "status", "match_id")


# Name keys of both sides as the views spell the clubs.
KEYS = """ext AS (SELECT external_id, league, match_date, home_goals, away_goals, lower(substr(home_name, 4)) AS h, lower(replace(away_name, ' Calcio', '')) AS a FROM v_external),
 can AS (SELECT match_id, league, match_date, home_goals, away_goals, lower(home_name) AS h, lower(away_name) AS a FROM v_fixture)"""
NAMED = KEYS + """, np AS (SELECT e.external_id, c.match_id, e.h AS eh, c.h AS ch, e.a AS ea, c.a AS ca FROM ext e JOIN can c ON c.league = e.league AND c.home_goals = e.home_goals AND c.away_goals = e.away_goals
  AND abs(date_diff('day', e.match_date, c.match_date)) <= 1), dp AS (SELECT eh AS a0, ch AS b0 FROM np UNION SELECT ea, ca FROM np)"""
# Ratcliff-Obershelp: the longest common block, leftmost in both names, then both sides of it; ``dp`` has the pairs.
RATIOS = """, seg AS (SELECT a0, b0, a0 AS a, b0 AS b, 0 AS got, 'x' AS path FROM dp
  UNION ALL SELECT a0, b0, CASE side WHEN 'l' THEN substr(a, 1, i - 1) ELSE substr(a, i + size) END, CASE side WHEN 'l' THEN substr(b, 1, j - 1) ELSE substr(b, j + size) END, CASE side WHEN 'l' THEN size ELSE 0 END, path || side
  FROM (SELECT *, instr(b, substr(a, i, size)) AS j FROM (SELECT *, best // 1000 AS size, 999 - best % 1000 AS i FROM (SELECT *, list_max(flatten(
   [[n * 1000 + 999 - s FOR n IN range(1, length(a) - s + 2) IF contains(b, substr(a, s, n))] FOR s IN range(1, length(a) + 1)])) AS best FROM seg)) WHERE best IS NOT NULL), (VALUES ('l'), ('r')) k(side)),
 ro AS (SELECT a0, b0, CASE WHEN a0 = '' AND b0 = '' THEN 1.0e0 ELSE 2.0e0 * sum(got) / (length(a0) + length(b0)) END AS ratio FROM seg GROUP BY a0, b0)"""
BY_NAMES = NAMED + RATIOS + """, sc AS (SELECT external_id, match_id, x.ratio + y.ratio AS score FROM np JOIN ro x ON x.a0 = eh AND x.b0 = ch JOIN ro y ON y.a0 = ea AND y.b0 = ca),
 tw AS (SELECT *, lead(score) OVER w AS runner_up, row_number() OVER w AS rn FROM sc WINDOW w AS (PARTITION BY external_id ORDER BY score DESC, match_id)),
 nm AS (SELECT external_id, match_id, score FROM tw WHERE rn = 1 AND score >= 1.2e0 AND (runner_up IS NULL OR score - runner_up >= 0.2e0))"""


@query("j8_fuzzy_names", BY_NAMES + " SELECT external_id, match_id, r6(score) AS score FROM nm")
def j8(spark, sf):
    return r.by_similar_names(external(spark, sf), canonical(spark, sf)).select("external_id", "match_id", round6("score").alias("score"))


@query("u1_matching_ratio", NAMED + RATIOS + " SELECT DISTINCT eh, ch, r6(ratio) AS ratio FROM np JOIN ro ON a0 = eh AND b0 = ch")
def u1(spark, sf):
    met = r.met_names(external(spark, sf), canonical(spark, sf)).select(F.col("_eh").alias("eh"), F.col("_ch").alias("ch"))
    return met.withColumn("ratio", round6(matching_ratio("eh", "ch")))


@query("t3_best_and_runner_up", "SELECT match_id, max(event_id) FILTER (rn = 1) AS event_id, r6(max(odds) FILTER (rn = 1)) AS odds, r6(max(odds) FILTER (rn = 2)) AS runner_up FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY odds DESC, event_id) AS rn FROM v_snap) GROUP BY match_id")
def t3(spark, sf):
    best = r.best_and_runner_up(view(spark, sf, "v_snap").select("match_id", "event_id", "odds"), "match_id", "odds", "event_id")
    return best.select("match_id", "event_id", round6("odds").alias("odds"), round6("runner_up").alias("runner_up"))


NEAR = "e.league = c.league AND e.external_home_id - 500000 = c.home_id AND e.external_away_id - 500000 = c.away_id AND abs(date_diff('day', e.match_date, c.match_date)) <= 1"


@query("j9_team_ids_and_score", f"SELECT e.external_id, min(c.match_id) AS match_id FROM v_external e JOIN v_fixture c ON {NEAR} AND e.home_goals = c.home_goals AND e.away_goals = c.away_goals GROUP BY e.external_id HAVING count(*) = 1")
def j9(spark, sf):
    return r.by_team_ids(external(spark, sf), canonical(spark, sf))


J10 = f"hit AS (SELECT e.external_id, min(c.match_id) AS match_id, max(CAST(e.home_goals <> c.home_goals OR e.away_goals <> c.away_goals AS INT)) AS score_differs FROM v_external e JOIN v_fixture c ON {NEAR} GROUP BY e.external_id HAVING count(*) = 1)"


@query("j10_team_ids_and_day", J10 + " SELECT * FROM hit")
def j10(spark, sf):
    return r.by_team_date(external(spark, sf), canonical(spark, sf)).withColumn("score_differs", F.col("score_differs").cast("int"))


# Indel ratio by a bit-parallel longest common subsequence; ``dq`` has the pairs of names up to 62 letters.
INDEL = KEYS + """, sp AS (SELECT c.match_id, e.external_id AS source_id, replace(c.h, ' ', '') AS ch, replace(e.h, ' ', '') AS sh, replace(c.a, ' ', '') AS ca, replace(e.a, ' ', '') AS sa
  FROM can c JOIN ext e ON e.match_date = c.match_date AND e.home_goals = c.home_goals AND e.away_goals = c.away_goals),
 dq AS (SELECT ch AS a0, sh AS b0 FROM sp UNION SELECT ca, sa FROM sp),
 lc AS (SELECT a0, b0, length(a0) - bit_count(list_reduce(list_transform(string_split(b0, ''), lambda y: CAST(coalesce(list_sum([CASE WHEN a0[i + 1] = y THEN 1::BIGINT << i ELSE 0 END FOR i IN range(length(a0))]), 0) AS BIGINT)),
  lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::BIGINT << length(a0)) - 1), (1::BIGINT << length(a0)) - 1)) AS common FROM dq),
 si AS (SELECT a0, b0, CASE WHEN a0 = b0 THEN 100.0e0 WHEN a0 = '' OR b0 = '' THEN 0.0e0 ELSE 200.0e0 * common / (length(a0) + length(b0)) END AS s FROM lc)"""


@query("u2_indel_ratio", INDEL + " SELECT DISTINCT ch, sh, r6(s) AS similarity FROM sp JOIN si ON a0 = ch AND b0 = sh")
def u2(spark, sf):
    ext = external(spark, sf).select("match_date", "home_goals", "away_goals", compact_key("home_name").alias("sh"))
    can = canonical(spark, sf).select("match_date", "home_goals", "away_goals", compact_key("home_name").alias("ch"))
    met = can.join(ext, ["match_date", "home_goals", "away_goals"]).select("ch", "sh").distinct()
    # places of a name are made once a name, not once a pair
    places = can.select("ch").distinct().withColumn("places", letter_places("ch"))
    return met.join(places, "ch", "left").select("ch", "sh", round6(indel_by_places("ch", "places", "sh")).alias("similarity"))


@query(
    "j11_similarity_quarantine",
    INDEL + """, sc AS (SELECT match_id, source_id, x.s AS hs, y.s AS as2, (x.s + y.s) / 2 AS mean FROM sp JOIN si x ON x.a0 = ch AND x.b0 = sh JOIN si y ON y.a0 = ca AND y.b0 = sa),
 tw AS (SELECT *, coalesce(mean - lead(mean) OVER w, 100.0e0) AS margin, row_number() OVER w AS rn FROM sc WINDOW w AS (PARTITION BY match_id ORDER BY mean DESC, source_id))
 SELECT match_id, source_id, r6(mean) AS mean_similarity, CASE WHEN mean >= 78 AND least(hs, as2) >= 65 AND margin >= 8 THEN 'accepted' WHEN mean >= 65 THEN 'quarantined' ELSE 'dropped' END AS outcome FROM tw WHERE rn = 1""",
)
def j11(spark, sf):
    source = external(spark, sf).select(F.col("external_id").alias("source_id"), "match_date", "home_goals", "away_goals", "home_name", "away_name")
    good, doubtful, dropped = r.reconcile_by_similarity(canonical(spark, sf), source)
    parts = [f.select("match_id", "source_id", round6("mean_similarity").alias("mean_similarity"), F.lit(label).alias("outcome"))
             for f, label in ((good, "accepted"), (doubtful, "quarantined"), (dropped, "dropped"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "j12_name_key_join",
    """c AS (SELECT match_date, lower(home_name) AS h, lower(away_name) AS a, max(match_id) AS match_id FROM v_fixture GROUP BY ALL)
 SELECT e.external_id, c.match_id FROM v_external e LEFT JOIN c ON c.match_date = e.match_date AND c.h = lower(substr(e.home_name, 4)) AND c.a = lower(replace(e.away_name, ' Calcio', ''))""",
)
def j12(spark, sf):
    return r.by_name_key(external(spark, sf), canonical(spark, sf))


@query(
    "j13_waterfall",
    J10.replace("hit AS", "h2 AS", 1) + f", h1 AS (SELECT e.external_id, min(c.match_id) AS match_id FROM v_external e JOIN v_fixture c ON {NEAR} AND e.home_goals = c.home_goals AND e.away_goals = c.away_goals GROUP BY e.external_id HAVING count(*) = 1), "
    + BY_NAMES + """ SELECT e.external_id, coalesce(h1.match_id, h2.match_id, nm.match_id) AS match_id, CASE WHEN h1.match_id IS NOT NULL THEN 'ids_and_score' WHEN h2.match_id IS NOT NULL THEN 'ids_and_day'
 WHEN nm.match_id IS NOT NULL THEN 'names' ELSE 'unresolved' END AS method, CASE WHEN h1.match_id IS NULL THEN coalesce(h2.score_differs, 0) ELSE 0 END AS score_differs
 FROM v_external e LEFT JOIN h1 USING (external_id) LEFT JOIN h2 USING (external_id) LEFT JOIN nm USING (external_id)""",
)
def j13(spark, sf):
    out = r.resolve_waterfall(external(spark, sf), canonical(spark, sf))
    return out.withColumn("score_differs", F.col("score_differs").cast("int"))


@query(
    "j15_nearest_reading",
    """p AS (SELECT DISTINCT user_id FROM events), n AS (SELECT e.user_id, e.ts, e.value, row_number() OVER (PARTITION BY e.user_id ORDER BY abs(epoch_us(e.ts) - epoch_us(TIMESTAMP '2024-01-10 20:45:00')), e.ts) AS rn FROM events e)
 SELECT user_id, r6(value) AS value, epoch_us(ts) AS at_micros FROM n WHERE rn = 1""",
)
def j15(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    probes = events.select("user_id").distinct().withColumn("kickoff", F.lit("2024-01-10 20:45:00").cast("timestamp"))
    out = r.nearest_in_time(probes, events.select("user_id", "ts", "value"), ["user_id"], "kickoff", "ts", ["value"])
    return out.select("user_id", round6("value").alias("value"), F.unix_micros("ts").alias("at_micros"))


@query(
    "j16_missing_elevens",
    """ok AS (SELECT match_id, team FROM v_lineup WHERE lineup_role = 'starter' AND match_id % 5 <> 1 GROUP BY match_id, team HAVING count(*) = 11 AND count(position) = 11)
 SELECT DISTINCT match_id FROM (SELECT match_id, home_team AS team FROM v_match UNION ALL SELECT match_id, away_team FROM v_match) s WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.match_id = s.match_id AND ok.team = s.team)""",
)
def j16(spark, sf):
    games = matches(spark, sf)
    sides = games.select("match_id", F.explode(F.array("home_team", "away_team")).alias("team"))
    stored = lineups(spark, sf).filter("match_id % 5 <> 1").withColumn("lineup_id", F.concat_ws("-", F.col("match_id"), F.col("side")))
    return r.lacking_complete_eleven(sides, stored)


@query("j17_validated_join", "SELECT m.match_id, m.result, r6(p.p_h) AS p_h FROM v_match m JOIN v_pred p ON p.match_id = m.match_id AND p.model = 'candidate'")
def j17(spark, sf):
    pred = view(spark, sf, "v_pred").filter("model = 'candidate'").select("match_id", "p_h")
    return join_checked(matches(spark, sf), pred, ["match_id"]).select("match_id", "result", round6("p_h").alias("p_h"))


FACTS = """d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, player_id ORDER BY line, l_extendedprice, l_partkey, team_id) AS rn FROM v_obs) WHERE rn = 1),
 li AS (SELECT match_id, player_id, team_id, lineup_role, position_original FROM d WHERE line % 4 <> 1), ap AS (SELECT match_id, player_id, team_id, coalesce(minutes_played, 10.0e0) AS minutes_played FROM d WHERE line % 5 <> 2),
 ou AS (SELECT match_id, player_id, max_by(l_quantity, ev) AS minute_out FROM (SELECT l_orderkey AS match_id, concat('P', CAST(l_partkey % 300 AS VARCHAR)) AS player_id, l_quantity, l_extendedprice * 100 + l_linenumber AS ev FROM lineitem WHERE l_linenumber % 3 = 1) GROUP BY ALL),
 inn AS (SELECT match_id, player_id, max_by(l_quantity, ev) AS minute_in FROM (SELECT l_orderkey AS match_id, concat('P', CAST((l_partkey + 1) % 300 AS VARCHAR)) AS player_id, l_quantity, l_extendedprice * 100 + l_linenumber AS ev FROM lineitem WHERE l_linenumber % 3 = 1 AND l_suppkey % 4 <> 0) GROUP BY ALL),
 fa AS (SELECT coalesce(li.match_id, ap.match_id) AS game_id, coalesce(li.player_id, ap.player_id) AS player_id, coalesce(li.team_id, ap.team_id) AS club_id, lineup_role, minutes_played FROM li FULL OUTER JOIN ap ON ap.match_id = li.match_id AND ap.player_id = li.player_id),
 ff AS (SELECT fa.*, ou.minute_out, inn.minute_in FROM fa LEFT JOIN ou ON ou.match_id = game_id AND ou.player_id = fa.player_id LEFT JOIN inn ON inn.match_id = game_id AND inn.player_id = fa.player_id)"""


def facts(spark, sf):
    obs = observations(spark, sf).withColumnsRenamed({"match_id": "game_id", "team_id": "club_id"})
    listed = obs.filter("line % 4 <> 1").select(
        "game_id", "player_id", "club_id", F.when(F.col("lineup_role") == "starter", "starting_lineup").otherwise("substitutes").alias("type"), F.col("position_original").alias("position"), F.col("line").alias("number"))
    played = obs.filter("line % 5 <> 2").select("game_id", "player_id", "club_id", F.coalesce("minutes_played", F.lit(10.0)).alias("minutes_played"), F.lit("{}").alias("statistics"))
    items = table(spark, sf, "lineitem").filter("l_linenumber % 3 = 1")
    code = lambda c: F.concat(F.lit("P"), (c % 300).cast("string"))
    subs = items.select(
        F.col("l_orderkey").alias("game_id"), code(F.col("l_partkey")).alias("player_id"), F.when(F.col("l_suppkey") % 4 != 0, code(F.col("l_partkey") + 1)).alias("player_in_id"),
        F.col("l_quantity").alias("minute"), (F.col("l_extendedprice") * 100 + F.col("l_linenumber")).alias("event_id"))
    return r.merge_player_facts(listed, played, subs)


@query("j18_merge_player_facts", FACTS + " SELECT game_id, player_id, club_id, lineup_role, minutes_played, minute_in, minute_out FROM ff")
def j18(spark, sf):
    return facts(spark, sf).select("game_id", "player_id", "club_id", "lineup_role", "minutes_played", "minute_in", "minute_out")


@query(
    "j19_translate_ids",
    FACTS + """, kn AS (SELECT * FROM ff WHERE game_id % 6 <> 0 AND club_id % 9 <> 0) SELECT season, count(*) AS rows, count(CASE WHEN minute_in > minute_out THEN 1 END) AS quarantined FROM kn JOIN v_match ON match_id = game_id GROUP BY season""",
)
def j19(spark, sf):
    games = matches(spark, sf)
    match_map = games.filter("match_id % 6 <> 0").select(F.col("match_id").alias("game_id"), "match_id", "season")
    obs = observations(spark, sf)
    player_map = obs.select("player_id").distinct().withColumn("internal_player_id", F.concat(F.lit("i-"), "player_id"))
    team_map = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("club_id"), F.col("s_name").alias("team")).filter("club_id % 9 <> 0")
    good, bad = r.translate_ids(facts(spark, sf), match_map, player_map, team_map)
    seasons = match_map.select("game_id", "season")
    rejected = bad.join(seasons, "game_id").select("season", F.lit(1).alias("bad"))
    both = good.select("season", F.lit(0).alias("bad")).unionByName(rejected)
    return both.groupBy("season").agg(F.count(F.lit(1)).alias("rows"), F.sum("bad").alias("quarantined"))


@query("j21_unmapped_league_seasons", "SELECT league, season, count(*) AS unmapped FROM v_match WHERE NOT (match_id % 2 = 0 OR league = '3') GROUP BY ALL")
def j21(spark, sf):
    games = matches(spark, sf)
    return r.unmapped_league_seasons(games, games.filter("match_id % 2 = 0 OR league = '3'").select("match_id"))


@query(
    "j22_rebuild_starters",
    """ap AS (SELECT match_id, team, player_id, slot, position FROM v_lineup WHERE slot < 13), st AS (SELECT * FROM ap WHERE NOT (slot IN (11, 12) AND match_id % 4 <> 1)),
 ok AS (SELECT match_id, team FROM st GROUP BY ALL HAVING count(*) = 11 AND count(position) = 11) SELECT match_id AS game_id, team AS club_id, player_id, concat('reconstructed:', position) AS formation_grid FROM st JOIN ok USING (match_id, team)""",
)
def j22(spark, sf):
    rows = lineups(spark, sf).withColumnsRenamed({"match_id": "game_id", "team": "club_id"})
    played = rows.filter("slot < 13")
    subs = rows.filter("slot IN (11, 12) AND game_id % 4 <> 1").select("game_id", "club_id", F.col("player_id").alias("player_in_id"))
    positions = rows.select("player_id", "game_id", "position")
    # position per player depends on the match in this view, so the game is part of the player key
    tag = lambda df, c="player_id": df.withColumn(c, F.concat_ws("#", F.col(c), F.col("game_id")))
    out = r.rebuild_starters(tag(played), tag(subs, "player_in_id"), tag(positions).select("player_id", "position"))
    return out.select("game_id", "club_id", F.substring_index("player_id", "#", 1).alias("player_id"), "formation_grid")


@query(
    "j23_first_stadium",
    """c AS (SELECT l_suppkey AS team_id, l_orderkey * 10 + l_linenumber AS rk, l_partkey, l_extendedprice, CASE l_partkey % 5 WHEN 0 THEN 'stadium' WHEN 1 THEN 'pitch' WHEN 2 THEN 'city' ELSE 'road' END AS type, CASE WHEN l_partkey % 7 = 0 THEN 'leisure' END AS category FROM lineitem),
 n AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY rk, l_partkey, l_extendedprice) AS rn FROM c WHERE type IN ('stadium', 'pitch') OR category = 'leisure') SELECT team_id, l_partkey AS place FROM n WHERE rn = 1""",
)
def j23(spark, sf):
    kind = F.col("l_partkey") % 5
    found = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("team_id"), F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("a"), F.col("l_partkey").alias("b"), F.col("l_extendedprice").alias("c")).alias("rank"),
        F.col("l_partkey").alias("place"), F.when(kind == 0, "stadium").when(kind == 1, "pitch").when(kind == 2, "city").otherwise("road").alias("type"),
        F.when(F.col("l_partkey") % 7 == 0, "leisure").alias("category"))
    return r.first_stadium(found).select("team_id", "place")


J25 = """inc AS (SELECT match_id, team, player_id, lineup_role, match_date FROM v_lineup WHERE match_id % 3 = 0), okf AS (SELECT match_id FROM inc GROUP BY match_id HAVING NOT (match_id % 7 = 0) AND count(CASE WHEN team = 'T7' THEN 1 END) = 0),
 nr AS (SELECT i.* FROM inc i JOIN okf USING (match_id)), oldr AS (SELECT match_id, team, player_id, lineup_role FROM v_lineup WHERE match_id % 2 = 0 AND slot < 11 AND NOT EXISTS (SELECT 1 FROM nr WHERE nr.match_id = v_lineup.match_id AND nr.team = v_lineup.team))"""


def j25_run(spark, sf):
    rows = lineups(spark, sf)
    games = rows.select("match_id").distinct()
    stored = rows.filter("match_id % 2 = 0 AND slot < 11").select("match_id", F.col("team").alias("team_id"), F.lit("X").alias("provider"), F.concat(F.lit("i-"), "player_id").alias("player_id"), "lineup_role", "position")
    incoming = rows.filter("match_id % 3 = 0").select(
        F.concat(F.lit("x"), F.col("match_id").cast("string")).alias("provider_match_id"), F.concat(F.lit("ext-"), "team").alias("provider_team_id"), F.col("player_id").alias("provider_player_id"),
        F.col("player_id").alias("player_name"), "lineup_role", "position", F.col("date").alias("match_day"))
    match_map = games.filter("match_id % 7 <> 0").select(F.concat(F.lit("x"), F.col("match_id").cast("string")).alias("provider_match_id"), "match_id")
    team_map = rows.select(F.col("team").alias("team_id")).distinct().filter("team_id <> 'T7'").withColumn("provider_team_id", F.concat(F.lit("ext-"), "team_id"))
    registry = rows.filter("match_id % 2 = 0").select(F.lit("X").alias("provider"), F.col("player_id").alias("provider_player_id"), F.concat(F.lit("i-"), "player_id").alias("player_id")).distinct()
    members = rows.filter("match_id % 4 = 0 AND ascii(right(player_id, 1)) % 3 <> 0").select(F.concat(F.lit("i-"), "player_id").alias("player_id"), F.col("team").alias("team_id"), F.lit("X").alias("provider")).distinct()
    return r.load_lineups(stored, incoming, match_map, team_map, registry, members, "X", F.concat(F.lit("i-"), "provider_player_id"))


@query("j25_load_lineups", J25 + " SELECT match_id, team AS team_id, count(*) AS players, count(CASE WHEN lineup_role = 'starter' THEN 1 END) AS starters FROM (SELECT match_id, team, player_id, lineup_role FROM nr UNION ALL SELECT * FROM oldr) GROUP BY ALL")
def j25(spark, sf):
    out = j25_run(spark, sf)["lineups"]
    return out.groupBy("match_id", "team_id").agg(F.count(F.lit(1)).alias("players"), F.count(F.when(F.col("lineup_role") == "starter", 1)).alias("starters"))


@query("j25_rejected_fixtures", J25 + " SELECT concat('x', CAST(match_id AS VARCHAR)) AS provider_match_id, CASE WHEN match_id % 7 = 0 THEN 'match_not_mapped' ELSE 'team_not_mapped' END AS reason FROM (SELECT DISTINCT match_id FROM inc WHERE match_id NOT IN (SELECT match_id FROM okf))")
def j25_rejected(spark, sf):
    return j25_run(spark, sf)["rejected"]


@query("j25_new_memberships", J25 + """, op AS (SELECT player_id, team, min(match_date) AS valid_from FROM nr GROUP BY ALL) SELECT concat('i-', player_id) AS player_id, team AS team_id, CAST(valid_from AS VARCHAR) AS valid_from FROM op o
 WHERE NOT EXISTS (SELECT 1 FROM v_lineup l WHERE l.match_id % 4 = 0 AND ascii(right(l.player_id, 1)) % 3 <> 0 AND l.player_id = o.player_id AND l.team = o.team)""")
def j25_members(spark, sf):
    return j25_run(spark, sf)["new_memberships"].select("player_id", "team_id", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"))


@query(
    "j27_upsert_latest",
    """n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS rn FROM lineitem)
 SELECT l_suppkey AS team_id, l_orderkey AS place FROM n WHERE rn = 1 UNION ALL SELECT k, -1 FROM (SELECT unnest([s_suppkey, -1 - s_suppkey]) AS k FROM supplier) WHERE k NOT IN (SELECT l_suppkey FROM n)""",
)
def j27(spark, sf):
    # every supplier is stored, and once more under a key that no new row has
    stored = table(spark, sf, "supplier").select(F.explode(F.array(F.col("s_suppkey"), -1 - F.col("s_suppkey"))).alias("team_id"), F.lit(-1).cast("long").alias("place"))
    new = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("team_id"), F.col("l_orderkey").alias("place"), "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")
    return r.upsert_latest(stored, new, ["team_id"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"]).select("team_id", "place")


@query(
    "j29_feed_persist",
    """f AS (SELECT match_id, team, player_id, CASE WHEN lineup_role = 'starter' THEN greatest(least(coalesce(minute_out, 90), 90), 0) WHEN minute_in IS NOT NULL THEN greatest(90 - least(minute_in, 90), 0) END AS minutes FROM v_lineup WHERE match_id % 3 = 0)
 SELECT match_id, team, count(*) AS players, count(minutes) AS timed, r4(sum(minutes)) AS minutes FROM (SELECT match_id, team, player_id, CAST(minutes AS DOUBLE) AS minutes FROM f UNION ALL
  SELECT match_id, team, player_id, NULL FROM v_lineup WHERE match_id % 2 = 0 AND match_id % 3 <> 0) GROUP BY ALL""",
)
def j29(spark, sf):
    rows = lineups(spark, sf)
    minutes = pl.minutes_estimate(F.col("lineup_role") == "starter", F.col("minute_in"), F.col("minute_out"))
    feed = rows.filter("match_id % 3 = 0").select("match_id", "team", "player_id", minutes.alias("minutes"))
    stored = rows.filter("match_id % 2 = 0").select("match_id", "team", "player_id", F.lit(None).cast("double").alias("minutes"))
    kept = stored.join(feed.select("match_id", "team").distinct(), ["match_id", "team"], "left_anti")
    return kept.unionByName(feed).groupBy("match_id", "team").agg(F.count(F.lit(1)).alias("players"), F.count("minutes").alias("timed"), F.round(F.sum("minutes"), 4).alias("minutes"))
