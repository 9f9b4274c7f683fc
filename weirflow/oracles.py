"""DuckDB SQL for the registered queries, from the tables alone."""

from __future__ import annotations

from .sources import bridge

_NOW = "WITH RECURSIVE " + bridge.sql()
_BOTH = "WITH RECURSIVE " + bridge.sql() + ", " + bridge.sql(True, "_old")
_OWN = "EXISTS (SELECT 1 FROM direct d WHERE d.fn = i.fn AND d.effect = i.effect)"
_CONTAINED = "('Db', 'Net', 'Llm', 'Exec', 'Fs', 'Ipc', 'Clipboard')"
# all names start with app:: and have three segments, and those of several kinds, so a name's layer is its second segment
_LAYER = "split_part(fn, '::', 2)"
_MATCH = "(fn = '{q}' OR fn LIKE '%::{q}')"
_CHANGES = """, changes AS (
  SELECT i.fn, i.effect, CASE WHEN EXISTS (SELECT 1 FROM direct d WHERE d.fn = i.fn AND d.effect = i.effect) THEN 'introduced' ELSE 'inherited' END AS change,
    CASE WHEN i.fn IN (SELECT fn FROM units_old) THEN 'changed' ELSE 'new' END AS status
  FROM (SELECT * FROM inferred EXCEPT SELECT * FROM inferred_old) i
  UNION ALL
  SELECT l.fn, l.effect, 'lost', CASE WHEN l.fn IN (SELECT fn FROM units) THEN 'changed' ELSE 'removed' END
  FROM (SELECT * FROM inferred_old EXCEPT SELECT * FROM inferred) l
), top AS (
  SELECT effect, fn FROM changes WHERE change <> 'lost'
  EXCEPT SELECT c.effect, e.dst FROM changes c JOIN edges e ON e.src = c.fn WHERE c.change <> 'lost'
)"""
_CALLERS = """, up AS (
  SELECT src AS fn FROM edges WHERE dst IN (SELECT fn FROM units WHERE {match})
  UNION SELECT e.src FROM up JOIN edges e ON e.dst = up.fn
)"""
_LEVELS = """, hop(fn, hops) AS (
  SELECT fn, 0 FROM units WHERE {match}
  UNION SELECT e.src, h.hops + 1 FROM hop h JOIN edges e ON e.dst = h.fn WHERE h.hops < 8
), near AS (SELECT fn, min(hops) FILTER (hops > 0) AS hops, min(hops) AS least FROM hop GROUP BY fn)"""
_CLASS = "CASE WHEN why LIKE 'dispatch%' THEN 'dispatch' WHEN why LIKE 'callback%' THEN 'indirect' WHEN why LIKE 'reflect%' THEN 'reflect' ELSE 'native' END"
_CLASSES = f""", classes AS (
  SELECT fn, {_CLASS} AS class FROM reasons UNION SELECT e.src, c.class FROM classes c JOIN edges e ON e.dst = c.fn
)"""
_SOURCES = """, reach(fn, effect, source, hops) AS (
  SELECT fn, effect, fn, 0 FROM direct
  UNION SELECT e.src, r.effect, r.source, r.hops + 1 FROM reach r JOIN edges e ON e.dst = r.fn WHERE r.hops < 8
), sourced AS (
  SELECT fn, effect, min(hops) AS hops FROM reach GROUP BY fn, effect
), nearest AS (
  SELECT s.fn, s.effect, s.hops, min(r.source) AS source FROM sourced s JOIN reach r ON r.fn = s.fn AND r.effect = s.effect AND r.hops = s.hops
  WHERE s.hops > 0 GROUP BY ALL
)"""
_EFFECTS = ["Net", "Db", "Llm", "Fs", "Exec", "Ipc", "Env", "Clock", "Rand", "Clipboard", "Log", "Unknown"]
_VOCAB = "(VALUES " + ", ".join(f"({i}, '{e}')" for i, e in enumerate(_EFFECTS, 1)) + ") AS v(position, effect)"
_TALLY = f"SELECT v.effect, count(i.fn)::BIGINT AS units FROM {_VOCAB} LEFT JOIN inferred i ON i.effect = v.effect GROUP BY v.effect"
_SCOPE = {
    "app::nation": "fn LIKE 'app::nation%'", "order": "fn LIKE 'app::order%'", "region": "fn LIKE 'app::region%'", "app::customer": "fn LIKE 'app::customer%'", "nowhere": "false",
    "supplier": "fn LIKE 'app::supplier%'", "app::part": "fn LIKE 'app::part%'", "customer": "fn LIKE 'app::customer%'", "app::order": "fn LIKE 'app::order%'",
}
_RULES = [("deny Net app::nation", "'Net'", "app::nation", 3), ("deny Db Fs order", "'Db', 'Fs'", "order", 4), ("pure region", ", ".join(f"'{e}'" for e in _EFFECTS[:-1]), "region", 5), ("deny Unknown[dispatch,native] app::customer", "'Unknown'", "app::customer", 6), ("deny Exec nowhere", "'Exec'", "nowhere", 7)]


def _hits() -> str:
    out = []
    for raw, effects, scope, order in _RULES:
        extra = " AND fn IN (SELECT fn FROM classes WHERE class IN ('dispatch', 'native'))" if "[" in raw else ""
        out.append(f"SELECT '{raw}' AS raw, {order} AS ord, fn, effect FROM inferred WHERE effect IN ({effects}) AND {_SCOPE[scope]}{extra}")
    return ", hits AS (" + " UNION ALL ".join(out) + ")"


def _binding() -> str:
    pairs = [(r[0], r[2]) for r in _RULES] + [
        ("allow Net in supplier blog.therst.example.net m.tionsh.example.net", "supplier"), ("allow Fs in app::part /data/economy /data/promo", "app::part"),
        ("forbid customer -> supplier", "customer"), ("forbid customer -> supplier", "supplier"), ("forbid app::part -> app::order", "app::part"), ("forbid app::part -> app::order", "app::order"),
        ("only app::order -> app::part", "app::order"), ("only app::order -> app::part", "app::part"),
    ]
    return " UNION ALL ".join(f"SELECT '{raw}' AS raw, '{s}' AS scope, count(*)::BIGINT AS names FROM all_names WHERE {_SCOPE[s]}" for raw, s in pairs)


_NAMES = ", all_names AS (SELECT fn FROM units UNION SELECT src FROM edges UNION SELECT dst FROM edges)"
_UPGRADES = [("deny Net app::nation", "app::nation", 3, "deny Net Unknown app::nation"), ("deny Db Fs order", "order", 4, "deny Db Fs Unknown order"), ("pure region", "region", 5, "deny Unknown region"), ("deny Unknown[dispatch,native] app::customer", "app::customer", 6, "deny Unknown Unknown app::customer")]
_PATH = """, walk(fn, path) AS (
  SELECT 'app::nation::n1', ['app::nation::n1']
  UNION ALL SELECT e.dst, list_append(w.path, e.dst) FROM walk w JOIN edges e ON e.src = w.fn
  JOIN inferred i ON i.fn = e.dst AND i.effect = 'Db' WHERE len(w.path) < 4 AND NOT list_contains(w.path, e.dst)
), best AS (
  SELECT path FROM walk WHERE fn IN (SELECT fn FROM direct WHERE effect = 'Db') ORDER BY len(path), path LIMIT 1
)"""
_NETUP = """, carriers AS (SELECT fn FROM inferred WHERE effect = 'Net'), down AS (
  SELECT fn FROM carriers WHERE fn = 'app::nation::n1' UNION SELECT e.dst FROM down d JOIN edges e ON e.src = d.fn JOIN carriers c ON c.fn = e.dst
), sites AS (SELECT fn FROM down WHERE fn IN (SELECT fn FROM direct WHERE effect = 'Net')
), climb AS (
  SELECT fn FROM sites UNION SELECT e.src FROM climb c JOIN edges e ON e.dst = c.fn JOIN carriers k ON k.fn = e.src WHERE e.src LIKE 'app::customer%' OR e.src LIKE 'app::supplier%'
), hoist AS (
  SELECT DISTINCT e.src AS fn FROM climb c JOIN edges e ON e.dst = c.fn JOIN carriers k ON k.fn = e.src WHERE NOT (e.src LIKE 'app::customer%' OR e.src LIKE 'app::supplier%')
), above AS (
  SELECT fn FROM hoist UNION SELECT e.src FROM above a JOIN edges e ON e.dst = a.fn JOIN carriers k ON k.fn = e.src WHERE NOT (e.src LIKE 'app::customer%' OR e.src LIKE 'app::supplier%')
)"""

SQL: dict[str, str] = {
    "effect_fixpoint": f"{_NOW} SELECT fn, effect FROM inferred",
    "effect_counts": f"{_NOW} SELECT effect, count(*)::BIGINT AS units FROM inferred GROUP BY effect",
    "reason_class_closure": f"{_NOW}{_CLASSES} SELECT fn, class FROM classes",
    "literal_surfaces": f"{_NOW}, reached AS (SELECT fn, kind, value FROM literals WHERE kind = 'hosts' UNION SELECT e.src, r.kind, r.value FROM reached r JOIN edges e ON e.dst = r.fn) SELECT * FROM reached",
    "show": f"{_NOW} SELECT i.fn, i.effect, CASE WHEN {_OWN} THEN 'direct' ELSE 'inherited' END AS how FROM inferred i WHERE fn = 'app::nation::n1'",
    "where_effect": f"{_NOW} SELECT i.effect, CASE WHEN {_OWN} THEN 'directly' ELSE 'inherited' END AS how, i.fn FROM inferred i",
    "tally": f"{_NOW} {_TALLY}",
    "module_map": f"{_NOW} SELECT 'app' AS module, (SELECT string_agg(DISTINCT effect, ',' ORDER BY effect) FROM inferred WHERE effect <> 'Unknown') AS effects, count(*)::BIGINT AS functions FROM units",
    "broadest_units": f"{_NOW} SELECT fn, count(*)::BIGINT AS width FROM inferred WHERE effect <> 'Unknown' GROUP BY fn ORDER BY width DESC, fn LIMIT 8",
    "reachable": f"{_NOW} SELECT effect, count(*)::BIGINT AS entry_points FROM inferred WHERE fn IN (SELECT fn FROM units WHERE entry_point) GROUP BY effect",
    "containment": f"{_NOW}, placed AS (SELECT effect, {_LAYER} AS layer, count(*) AS n FROM direct WHERE effect IN {_CONTAINED} GROUP BY ALL) SELECT effect, count(*)::BIGINT AS layers, arg_max(layer, (n, layer)) AS owner, (100 * max(n) // sum(n))::BIGINT AS percent FROM placed GROUP BY effect",
    "ambient_layers": f"{_NOW} SELECT effect, count(DISTINCT {_LAYER})::BIGINT AS layers FROM direct WHERE effect IN ('Log', 'Clock', 'Rand', 'Env') GROUP BY effect",
    "containment_ratchet": f"""{_NOW}, b0 AS (SELECT * FROM direct WHERE effect <> 'Fs' UNION SELECT fn, 'Fs' FROM units WHERE fn LIKE 'app::supplier%'),
        a AS (SELECT DISTINCT effect, {_LAYER} AS layer FROM direct WHERE effect IN {_CONTAINED}), b AS (SELECT DISTINCT effect, {_LAYER} AS layer FROM b0 WHERE effect IN {_CONTAINED})
        SELECT *, 'leak' AS change FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'cleanup' FROM (FROM b EXCEPT FROM a)""",
    "callers": f"{_NOW}{_LEVELS.format(match=_MATCH.format(q='supplier::s1'))} SELECT fn, hops = 1 AS direct, hops::INT AS hops FROM near WHERE hops IS NOT NULL",
    "possible_callers": f"""{_NOW}, asks AS (SELECT fn, CASE WHEN (regexp_extract(fn, '([0-9]+)$', 1)::BIGINT // 4) % 5 = 0 THEN 2 ELSE 1 END AS m FROM reasons WHERE why LIKE 'dispatch%')
        SELECT fn, 'dispatch:app::supplier.s' || m AS why FROM asks WHERE m = 1""",
    "impact": f"{_NOW}{_LEVELS.format(match=_MATCH.format(q='app::supplier::s1'))} SELECT n.fn, n.hops::INT AS hops, u.entry_point FROM near n JOIN units u ON u.fn = n.fn WHERE n.least > 0",
    "path": f"{_NOW}{_PATH} SELECT (s - 1)::INT AS step, path[s] AS fn, s = len(path) AS source FROM best, generate_series(1, len(path)) g(s)",
    "blindspots": f"""{_NOW}, up AS (SELECT fn AS source, fn FROM reasons UNION SELECT u.source, e.src FROM up u JOIN edges e ON e.dst = u.fn)
        SELECT r.fn, r.why, (SELECT count(*) FROM up WHERE source = r.fn AND up.fn <> r.fn)::BIGINT AS reaches FROM (SELECT fn, string_agg(DISTINCT why, ',' ORDER BY why) AS why FROM reasons GROUP BY fn) r""",
    "blindspot_stats": f"{_NOW} SELECT v.class, count(DISTINCT r.fn)::BIGINT AS sources FROM (VALUES ('reflect'), ('dispatch'), ('indirect'), ('native'), ('unresolved'), ('setup')) v(class) LEFT JOIN (SELECT fn, {_CLASS} AS class FROM reasons) r ON r.class = v.class GROUP BY v.class",
    "nearest_sources": f"{_NOW}{_SOURCES} SELECT fn, effect, hops::INT AS hops, source FROM nearest",
    "tour": f"""{_NOW}{_SOURCES}, scored AS (
          SELECT *, CASE WHEN effect IN ('Net', 'Exec', 'Db', 'Llm', 'Ipc') THEN 5 WHEN effect IN ('Fs', 'Env') THEN 3 ELSE 0 END * CASE WHEN hops = 1 THEN 2 WHEN hops <= 4 THEN 3 WHEN hops <= 6 THEN 2 ELSE 1 END
            * CASE WHEN split_part(fn, '::', 2) <> split_part(source, '::', 2) THEN 2 ELSE 1 END AS score FROM nearest WHERE effect <> 'Unknown'
        ), one AS (SELECT * FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY fn ORDER BY score DESC, hops, effect) = 1)
        SELECT fn, effect, hops::INT AS hops, source, score::INT AS score FROM one ORDER BY score DESC, hops, fn LIMIT 10""",
    "audit": f"""{_NOW} SELECT 'units' AS metric, '' AS name, count(*)::BIGINT AS value FROM units UNION ALL SELECT 'suspect', '', count(*) FROM units WHERE regexp_matches(fn, 'nation|n2')
        UNION ALL SELECT 'effect', effect, units FROM ({_TALLY}) UNION ALL (SELECT 'broadest', fn, count(*) AS n FROM inferred WHERE effect <> 'Unknown' GROUP BY fn ORDER BY n DESC, fn LIMIT 8)""",
    "whatif": f"""{_NOW}{_CALLERS.format(match=_MATCH.format(q='supplier::s1'))}, affected AS (SELECT fn FROM up UNION SELECT fn FROM units WHERE {_MATCH.format(q='supplier::s1')})
        SELECT fn, CASE WHEN fn LIKE 'app::nation%' THEN 'deny Net app::nation' WHEN fn LIKE 'app::region%' THEN 'pure region' END AS rule,
          CASE WHEN fn LIKE 'app::nation%' OR fn LIKE 'app::region%' THEN false END AS conditional FROM affected""",
    "diff": f"{_BOTH}{_CHANGES} SELECT fn, effect, change, status FROM changes",
    "diff_endpoints": f"{_BOTH}{_CHANGES} SELECT effect, fn FROM top WHERE fn NOT IN (SELECT fn FROM changes WHERE change = 'introduced')",
    "diff_ranking": f"""{_BOTH}{_CHANGES} SELECT fn, CASE WHEN bool_or(change = 'introduced') THEN 0 WHEN fn IN (SELECT fn FROM top) THEN 1 WHEN bool_or(change <> 'lost') THEN 2 ELSE 3 END::INT AS place FROM changes GROUP BY fn""",
    "gains": f"""{_BOTH} SELECT fn, effect, CASE WHEN fn IN (SELECT fn FROM units_old UNION SELECT src FROM edges_old UNION SELECT dst FROM edges_old) THEN 'existing' ELSE 'new' END AS origin FROM (FROM inferred EXCEPT FROM inferred_old)""",
    "gained_effects": f"{_BOTH} SELECT DISTINCT effect FROM (FROM inferred EXCEPT FROM inferred_old)",
    "dropped_calls": f"{_BOTH} SELECT src, dst FROM (FROM edges EXCEPT FROM edges_old)",
    "missing_units": f"{_BOTH} SELECT fn FROM (SELECT fn FROM units EXCEPT SELECT fn FROM units_old)",
    "baseline_guard": f"""{_BOTH}, g AS (SELECT fn, effect, fn IN (SELECT fn FROM units_old) AS old FROM (FROM inferred EXCEPT FROM inferred_old))
        SELECT 'AS-EFF-005' AS rule, fn, string_agg(effect, ',' ORDER BY effect) AS effects, CASE WHEN bool_or(old) THEN 'existing' ELSE 'new' END AS origin, string_agg(effect, ',' ORDER BY effect) = 'Unknown' AS advisory FROM g GROUP BY fn""",
    "receipt": f"{_NOW} SELECT v.position::INT AS position, v.effect AS key, count(i.fn)::VARCHAR AS value FROM {_VOCAB} LEFT JOIN inferred i ON i.effect = v.effect GROUP BY ALL",
    "gate_deny": f"{_NOW}{_CLASSES}{_hits()} SELECT 'AS-EFF-006' AS rule, raw, fn, string_agg(effect, ',' ORDER BY effect) AS effects, '' AS detail FROM hits GROUP BY raw, fn",
    "gate_withheld": f"{_NOW}{_CLASSES} SELECT 'deny Unknown[dispatch,native] app::customer' AS raw, fn, 'Unknown' AS effect FROM units WHERE fn LIKE 'app::customer%' AND fn NOT IN (SELECT fn FROM classes)",
    "gate_allow": f"""{_NOW}, lits AS (SELECT * FROM literals) 
        SELECT 'allow Net in supplier blog.therst.example.net m.tionsh.example.net' AS raw, fn, detail FROM (
          SELECT i.fn, CASE WHEN count(l.value) = 0 THEN 'no visible literal' ELSE string_agg(DISTINCT l.value, ',' ORDER BY l.value) FILTER (l.value NOT IN ('blog.therst.example.net', 'm.tionsh.example.net')) END AS detail
          FROM inferred i LEFT JOIN lits l ON l.fn = i.fn AND l.kind = 'hosts' WHERE i.effect = 'Net' AND i.fn LIKE 'app::supplier%' GROUP BY i.fn) WHERE detail IS NOT NULL
        UNION ALL SELECT 'allow Fs in app::part /data/economy /data/promo', i.fn, l.value FROM inferred i JOIN lits l ON l.fn = i.fn AND l.kind = 'paths'
          WHERE i.effect = 'Fs' AND i.fn LIKE 'app::part%' AND NOT regexp_matches(l.value, '^/data/(economy|promo)/')""",
    "gate_forbid": f"""{_NOW}, rs(fn, source, hops) AS (
          SELECT src, dst, 1 FROM edges WHERE dst LIKE 'app::supplier%' AND src LIKE 'app::order%'
          UNION SELECT e.src, r.source, r.hops + 1 FROM rs r JOIN edges e ON e.dst = r.fn WHERE r.hops < 5 AND (e.src LIKE 'app::order%' OR e.src LIKE 'app::customer%')
        ), least_ AS (SELECT fn, min(hops) AS hops FROM rs GROUP BY fn)
        SELECT 'forbid customer -> supplier' AS raw, r.fn, 'via ' || min(r.source) AS detail FROM rs r JOIN least_ l ON l.fn = r.fn AND l.hops = r.hops WHERE r.fn LIKE 'app::customer%' GROUP BY r.fn""",
    "gate_only": f"{_NOW} SELECT DISTINCT 'only app::order -> app::part' AS raw, src AS fn FROM edges WHERE src LIKE 'app::order%' AND dst NOT LIKE 'app::order%' AND dst NOT LIKE 'app::part::%'",
    "gate_scope_binding": f"{_NOW}{_NAMES} {_binding()}",
    "gate_zero_match": f"{_NOW}{_NAMES} SELECT * FROM ({_binding()}) WHERE names = 0",
    "gate_multi_match": f"{_NOW}{_NAMES} SELECT * FROM ({_binding()}) WHERE names > 1 AND NOT contains(scope, '::')",
    "unverified_holes": f"{_NOW}{_CLASSES}{_hits()}, open AS (" + " UNION ALL ".join(f"SELECT fn, '{raw}' AS rule, {o} AS ord, '{up}' AS upgrade FROM inferred i WHERE effect = 'Unknown' AND {_SCOPE[s]} AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.raw = '{raw}' AND h.fn = i.fn)" for raw, s, o, up in _UPGRADES) + ") SELECT fn, rule, upgrade FROM open QUALIFY row_number() OVER (PARTITION BY fn ORDER BY ord) = 1",
    "ambient_authority": f"{_NOW} SELECT fn, string_agg(effect, ',' ORDER BY effect) AS effects FROM direct WHERE effect NOT IN ('Log', 'Unknown') GROUP BY fn",
    "fix_remedy": f"""{_NOW}{_NETUP} SELECT 'site' AS role, fn FROM sites UNION ALL SELECT 'span', fn FROM climb WHERE fn LIKE 'app::customer%' OR fn LIKE 'app::supplier%' UNION ALL SELECT 'hoist', fn FROM hoist
        UNION ALL SELECT 'higher', fn FROM (FROM above EXCEPT FROM hoist)
        UNION ALL SELECT DISTINCT 'sandwiched', e.src FROM above a JOIN edges e ON e.dst = a.fn JOIN carriers k ON k.fn = e.src WHERE e.src LIKE 'app::customer%' OR e.src LIKE 'app::supplier%'""",
    "accept_settlement": f"""{_NOW} SELECT fn, 'violation' AS status FROM inferred WHERE effect = 'Net' AND fn LIKE 'app::nation%' AND fn <> 'app::nation::n1'
        UNION ALL SELECT v.fn, CASE WHEN i.fn IS NULL THEN 'stale' WHEN v.e = 'Net' THEN 'accepted' ELSE 'exceeded' END FROM (VALUES ('app::nation::n1', 'Net'), ('app::nation::n2', 'Fs'), ('app::nation::n999', 'Net')) v(fn, e) LEFT JOIN inferred i ON i.fn = v.fn AND i.effect = 'Net'""",
    "subtype_closure": f"{_NOW}, s AS (SELECT dst AS type, src AS owner FROM edges WHERE src LIKE 'app::region%' OR src LIKE 'app::nation%'), t AS (SELECT * FROM s UNION SELECT t.type, s.owner FROM t JOIN s ON s.type = t.owner) SELECT type, owner FROM t",
    "scalar_hosts": "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, regexp_extract(url, '^[a-z]+://([^/:]*)', 1) AS bare FROM pages",
    "scalar_commands": "SELECT p_partkey, replace(p_name, ' ', '-') AS base FROM part",
    "scalar_path_cover": "SELECT p_partkey, lower(p_type) = 'promo' AS promo, false AS sibling FROM part",
    "scalar_table_cover": "SELECT p_partkey, lower(p_type) = 'promo' AS whole, lower(p_type) = 'economy' AND replace(p_name, ' ', '_') = 'cold_widget' AS one FROM part",
    "scalar_names": f"""{_NOW} SELECT fn, CASE WHEN fn = 'order::o1' THEN 3 WHEN fn LIKE '%::order::o1' THEN 2 WHEN contains(fn, 'order::o1') THEN 1 ELSE 0 END::INT AS tier, fn LIKE 'app::order::o1%' AS prefix, fn = 'app::order::o1' AS exact,
        split_part(fn, '::', 3) AS method, split_part(fn, '::', 1) || '::' || split_part(fn, '::', 2) AS type, 'app' AS module, replace(fn, '::', ' ') AS tokens, false AS test FROM units""",
    "scalar_reasons": f"{_NOW} SELECT fn, {_CLASS} AS class FROM reasons",
    "scalar_tokens": "SELECT p_partkey, lower(p_name) AS tokens, CASE WHEN p_name LIKE '%widget' THEN 'widget' WHEN p_name LIKE '%bolt' THEN 'bolt' END AS hit FROM part",
    "net_destinations": f"""{_NOW}, reached AS (SELECT fn, value FROM literals WHERE kind = 'hosts' UNION SELECT e.src, r.value FROM reached r JOIN edges e ON e.dst = r.fn)
        SELECT DISTINCT i.fn, CASE WHEN r.value LIKE '%.example.org' OR r.value = 'example.org' THEN 'known-partner' WHEN r.value LIKE '%.example.net' OR r.value = 'example.net' THEN 'known-telemetry' ELSE 'unknown-host' END AS class
        FROM inferred i LEFT JOIN reached r ON r.fn = i.fn WHERE i.effect = 'Net'""",
    "capability_conformance": f"""{_NOW}, d AS (SELECT fn FROM units WHERE fn LIKE 'app::nation%' OR fn LIKE 'app::region%'), has AS (SELECT d.fn, i.effect FROM d JOIN inferred i USING (fn))
        SELECT 'AS-EFF-001' AS rule, fn, string_agg(effect, ',' ORDER BY effect) AS effects FROM has WHERE effect NOT IN ('Net', 'Db', 'Unknown') AND fn LIKE 'app::nation%' GROUP BY fn
        UNION ALL SELECT 'AS-EFF-002', d.fn, string_agg(e, ',' ORDER BY e) FROM d, (VALUES ('Net'), ('Db')) v(e) WHERE (d.fn, e) NOT IN (SELECT (fn, effect) FROM has) GROUP BY d.fn
        UNION ALL SELECT 'AS-EFF-003', fn, 'Unknown' FROM has WHERE effect = 'Unknown' AND fn LIKE 'app::nation%'""",
    "coverage_delta": "WITH p AS (SELECT l_orderkey, l_partkey || '@' || l_suppkey AS name FROM lineitem), a AS (SELECT DISTINCT name FROM p WHERE l_orderkey % 5 <> 0), b AS (SELECT DISTINCT name FROM p WHERE l_orderkey % 7 <> 0) SELECT name, 'added' AS change FROM (FROM a EXCEPT FROM b) UNION ALL SELECT name, 'removed' FROM (FROM b EXCEPT FROM a)",
    "twin_names": "SELECT p_name AS fn, count(DISTINCT p_partkey)::BIGINT AS units FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey) > 1",
    "accept_proposals": f"{_NOW} SELECT 'accept ' || fn || ' ' || string_agg(effect, ' ' ORDER BY effect) || ' for deny Net Db app::nation because agreed' AS line FROM inferred WHERE fn LIKE 'app::nation%' AND effect IN ('Net', 'Db') GROUP BY fn",
    "first_broken_rule": f"""{_NOW} SELECT fn, CASE WHEN fn LIKE 'app::nation%' AND bool_or(effect = 'Db') THEN 'deny Db app::nation' WHEN bool_or(effect = 'Net') THEN 'deny Net' ELSE 'pure app' END AS raw FROM inferred WHERE effect <> 'Unknown' GROUP BY fn""",
    "explain_unit": f"""{_NOW}, walk(fn, path) AS (
          SELECT 'app::region::r1', ['app::region::r1'] UNION ALL SELECT e.dst, list_append(w.path, e.dst) FROM walk w JOIN edges e ON e.src = w.fn WHERE len(w.path) < 5
        ), ends AS (SELECT d.effect, w.path FROM walk w JOIN direct d ON d.fn = w.fn)
        SELECT effect, array_to_string(path, ' > ') AS path FROM ends QUALIFY row_number() OVER (PARTITION BY effect ORDER BY len(path), path) = 1""",
    "uncovered_packages": """WITH seen AS (SELECT lower(p_type) || '_' || replace(p_name, ' ', '_') AS name FROM part UNION SELECT lower(p_type) FROM part UNION SELECT replace(p_name, ' ', '_') FROM part)
        SELECT name FROM seen WHERE name NOT IN ('promo', 'red_bolt', 'medium') AND NOT starts_with(name, 'promo_') AND NOT starts_with(name, 'red_bolt_') AND NOT starts_with(name, 'eco') AND NOT starts_with(name, 'small_r')
          AND name NOT IN (SELECT replace(p_name, ' ', '_') FROM part WHERE p_size = 1)""",
    "user_rules": """WITH c AS (SELECT 'app::order::o' || l_orderkey AS fn, lower(p_type) AS package, lower(p_type) || '::' || replace(p_name, ' ', '_') AS path FROM lineitem JOIN part ON l_partkey = p_partkey)
        SELECT fn, 'Net' AS effect FROM c WHERE package = 'promo' UNION SELECT fn, 'Fs' FROM c WHERE starts_with(path, 'economy::small') UNION SELECT fn, 'Db' FROM c WHERE starts_with(path, 'standard::')""",
    "dispatch_targets": "SELECT DISTINCT 'app::customer::c' || c_custkey AS src, 'app::nation::n' || n_nationkey AS dst FROM customer JOIN nation ON c_mktsegment = ['MACHINERY', 'BUILDING', 'AUTOMOBILE', 'HOUSEHOLD', 'nothing'][n_nationkey % 5 + 1]",
    "dispatch_unknown": "SELECT DISTINCT 'app::customer::c' || c_custkey AS fn, 'dispatch:' || c_mktsegment || '.run' AS why FROM customer WHERE c_mktsegment NOT IN ('MACHINERY', 'BUILDING', 'AUTOMOBILE', 'HOUSEHOLD')",
    "late_unknown": f"{_NOW} SELECT fn, effect FROM inferred UNION SELECT fn, 'Unknown' FROM units WHERE fn LIKE 'app::customer%'",
    "tour_caveat": f"{_NOW}, c AS (SELECT count(DISTINCT fn) FILTER (effect = 'Unknown') AS unknown, count(DISTINCT fn) AS total FROM inferred) SELECT unknown, total, total > 0 AND unknown * 3 >= total AS caveat FROM c",
    "enforcement_scope": f"{_NOW} SELECT fn, false AS unset, true AS whole, true AS blank, fn LIKE 'app::part%' AS prefix FROM units",
    "scalar_reason_match": f"""{_NOW}, own AS (SELECT DISTINCT fn, {_CLASS} AS class FROM reasons)
        SELECT fn, fn IN (SELECT fn FROM own WHERE class = 'dispatch') AS dispatch, fn NOT IN (SELECT fn FROM own) AS unresolved, fn NOT IN (SELECT fn FROM own) OR fn IN (SELECT fn FROM own WHERE class = 'native') AS native_or_unresolved FROM units""",
    "scalar_fs_kind": "SELECT p_partkey, ['read', 'write', 'read,write', '', 'read', '', ''][p_partkey % 7 + 1] AS kind FROM part",
    "scalar_spec": "SELECT p_partkey, p_partkey % 10 = 0 OR p_size < 9 OR (p_size = 9 AND p_partkey % 60 < 30) AS older FROM part",
    "scalar_keys": "SELECT p_partkey, 'deny ' || p_type || ' ' || p_name AS rule, p_partkey % 3 = 0 AS positional, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_partkey::VARCHAR END AS key FROM part",
    "scalar_segments": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type || '/' || replace(p_name, ' ', '.') ELSE p_type || '/' || replace(p_name, ' ', '/') END AS segments, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 2 + len(p_name) - len(replace(p_name, ' ', '')) END::INT AS n FROM part",
    "key_states": "SELECT p_partkey, ['present', 'absent', 'corrupt', 'present', 'corrupt'][p_partkey % 5 + 1] AS state, [2, -1, -1, 0, -1][p_partkey % 5 + 1]::INT AS n FROM part",
    "merged_repeats": "SELECT p_name AS fn, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS inferred, string_agg(DISTINCT p_size::VARCHAR, ',' ORDER BY p_size::VARCHAR) AS direct, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS calls FROM part GROUP BY p_name",
    "last_of_repeats": "SELECT p_name AS fn, p_brand AS path, p_partkey AS pos FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_brand DESC, p_partkey DESC) = 1",
    "resolved_calls": """WITH u AS (SELECT p_brand || '#' || p_partkey AS key, p_brand AS package, CASE WHEN p_partkey % 4 = 0 THEN p_name || ' ' || p_partkey ELSE p_name END AS fn, unnest(['red bolt', 'red bolt 4', p_type, p_name || ' 8']) AS call FROM part),
        n AS (SELECT fn, count(DISTINCT key) AS n, min(key) AS only_ FROM u GROUP BY fn), s AS (SELECT package, fn, min(key) AS same FROM u GROUP BY package, fn)
        SELECT u.key AS caller, u.call, coalesce(s.same, CASE WHEN n.n = 1 THEN n.only_ END) AS target, s.same IS NULL AND coalesce(n.n, 0) > 1 AS ambiguous
        FROM u LEFT JOIN n ON n.fn = u.call LEFT JOIN s ON s.fn = u.call AND s.package = u.package""",
    "dependency_effects": """WITH v AS (SELECT p_name AS fn, min(p_partkey) % 2 = 0 AS mine FROM part GROUP BY p_name), e AS (SELECT DISTINCT p_name AS fn, lower(p_type) AS effect FROM part)
        SELECT DISTINCT 'p' || p_partkey AS fn, CASE WHEN mine THEN effect ELSE 'Unknown' END AS effect FROM part JOIN v ON v.fn = p_name JOIN e ON e.fn = p_name""",
    "tainted_effects": "SELECT 'AS-EFF-007' AS rule, 'u' || user_id AS fn, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS effects FROM events WHERE value > 50 GROUP BY user_id",
    "zero_match_parts": "SELECT l_partkey::VARCHAR AS rule, 0::BIGINT AS count FROM lineitem GROUP BY l_partkey HAVING count(*) FILTER (l_quantity > 40) = 0",
    "violation_order": f"""{_NOW}{_CLASSES}{_hits()}, rows_ AS (
          SELECT 'AS-EFF-006' AS rule, raw, fn, string_agg(effect, ',' ORDER BY effect) AS effects FROM hits GROUP BY raw, fn
          UNION ALL SELECT 'AS-EFF-004', '', fn, string_agg(effect, ',' ORDER BY effect) FROM direct WHERE effect NOT IN ('Log', 'Unknown') GROUP BY fn
        ), placed AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY fn, raw)::INT AS place FROM rows_)
        SELECT rule, place, fn, raw, effects FROM placed WHERE place <= 20""",
}

_RULES = [
    "deny Net app::nation", "deny Db Fs order", "pure region", "deny Unknown[dispatch,native] app::customer", "deny Exec nowhere",
    "allow Net in supplier blog.therst.example.net m.tionsh.example.net", "allow Fs in app::part /data/economy /data/promo",
    "forbid customer -> supplier", "forbid app::part -> app::order", "only app::order -> app::part",
]
_BROKEN = " UNION ALL ".join(f"SELECT raw, fn FROM ({SQL[q]})" for q in ("gate_deny", "gate_allow", "gate_forbid", "gate_only"))
_BLIND = f"{_NOW}{_CLASSES} SELECT DISTINCT fn FROM inferred WHERE effect = 'Unknown' AND fn LIKE 'app::customer%' AND fn NOT IN (SELECT fn FROM classes)"
SQL["gate_judged"] = f"""SELECT raw, violations, unevaluated, CASE WHEN violations > 0 THEN 'violations' WHEN unevaluated > 0 THEN 'unevaluated' ELSE 'clear' END AS verdict FROM (
    SELECT r.raw, (SELECT count(*) FROM ({_BROKEN}) b WHERE b.raw = r.raw) AS violations,
      CASE WHEN r.raw LIKE 'deny Unknown%' THEN (SELECT count(*) FROM ({_BLIND})) ELSE 0 END AS unevaluated
    FROM (VALUES {", ".join(f"('{r}')" for r in _RULES)}) r(raw))"""

_ODD = "(fn LIKE 'app::customer%1' OR fn LIKE 'app::customer%7')"
SQL["show_unit"] = f"""{_NOW}, below AS (SELECT 'app::nation::n1' AS fn UNION SELECT e.dst FROM below b JOIN edges e ON e.src = b.fn)
    SELECT 'app::nation::n1' AS fn, (SELECT coalesce(string_agg(effect, ',' ORDER BY effect), '') FROM inferred WHERE fn = 'app::nation::n1') AS inferred, '' AS direct, '' AS fs,
      (SELECT coalesce(string_agg(DISTINCT value, ',' ORDER BY value), '') FROM literals WHERE kind = 'hosts' AND fn IN (FROM below)) AS hosts, '' AS tables,
      EXISTS (SELECT 1 FROM inferred WHERE fn = 'app::nation::n1' AND effect = 'Unknown') AS unresolved, '' AS loc"""
SQL["blindspot_reach"] = f"""{_NOW}, up AS (SELECT DISTINCT fn AS source, fn FROM reasons UNION SELECT u.source, e.src FROM up u JOIN edges e ON e.dst = u.fn)
    SELECT source AS fn, fn AS affected FROM up WHERE fn <> source"""
SQL["unresolved_units"] = f"{_NOW} SELECT DISTINCT fn FROM inferred WHERE effect = 'Unknown'"
SQL["audit_packages"] = f"""{_NOW}, per AS (SELECT {_LAYER} AS package, effect, count(*) AS n FROM inferred GROUP BY ALL), size AS (
      SELECT {_LAYER} AS package, count(DISTINCT fn)::BIGINT AS units, count(*) FILTER (effect = 'Unknown')::BIGINT AS unresolved FROM inferred GROUP BY ALL)
    SELECT s.package, s.units, s.unresolved, coalesce(string_agg(p.n || ' ' || p.effect, ',' ORDER BY p.n DESC, p.effect DESC), '') AS effects
    FROM size s LEFT JOIN per p ON p.package = s.package AND p.effect <> 'Unknown' GROUP BY ALL"""
SQL["subtype_answers"] = """SELECT 'c' || c_custkey AS type, 'r' || (c_custkey % 5) AS owner,
      CASE WHEN n_regionkey = c_custkey % 5 THEN 'yes' WHEN n_nationkey % 5 = 3 THEN 'unanswerable' ELSE 'no' END AS answer FROM customer JOIN nation ON c_nationkey = n_nationkey"""
SQL["fix_gate"] = f"""{_NOW}, up AS (SELECT effect, fn AS site, fn FROM direct WHERE effect IN ('Db', 'Exec') UNION SELECT u.effect, u.site, e.src FROM up u JOIN edges e ON e.dst = u.fn),
    per AS (SELECT effect, CASE effect WHEN 'Db' THEN 'app::customer' ELSE 'app::nation' END AS layer, fn, string_agg(site, ',' ORDER BY site) AS sites FROM up
      WHERE (effect = 'Db' AND fn LIKE 'app::customer::%') OR (effect = 'Exec' AND fn LIKE 'app::nation::%') GROUP BY ALL)
    SELECT effect, layer, sites, min(fn) AS fn FROM per GROUP BY ALL"""
SQL["accept_plan"] = f"""{_NOW}, found AS (SELECT fn, list(effect ORDER BY effect) AS has FROM inferred WHERE fn LIKE 'app::nation%' AND effect IN ('Db', 'Exec') GROUP BY fn),
    entries(fn, accepted, because) AS (VALUES ('app::nation::n1', ['Db', 'Exec', 'Fs'], 'known'), ('app::nation::n2', ['Db'], 'some'), ('app::nation::n999', ['Db'], 'gone')),
    pairs AS (SELECT e.*, f.has, list_sort(list_filter(accepted, lambda x: NOT list_contains(has, x))) AS gone, list_sort(list_filter(has, lambda x: NOT list_contains(accepted, x))) AS more FROM entries e JOIN found f USING (fn)),
    plan AS (
      SELECT 'removed' AS kind, fn, array_to_string(accepted, ',') AS effects, '' AS line FROM entries WHERE fn NOT IN (SELECT fn FROM found)
      UNION ALL SELECT 'narrowed', fn, array_to_string(gone, ','), 'accept ' || fn || ' ' || array_to_string(list_sort(list_intersect(accepted, has)), ' ') || ' for deny Db Exec app::nation because ' || because FROM pairs WHERE len(more) = 0 AND len(gone) > 0
      UNION ALL SELECT 'proposed', fn, array_to_string(more, ','), 'accept ' || fn || ' ' || array_to_string(list_sort(list_distinct(list_concat(accepted, has))), ' ') || ' for deny Db Exec app::nation because ' || because FROM pairs WHERE len(more) > 0
      UNION ALL SELECT 'created', fn, array_to_string(has, ','), 'accept ' || fn || ' ' || array_to_string(has, ' ') || ' for deny Db Exec app::nation because agreed' FROM found WHERE fn NOT IN (SELECT fn FROM entries))
    SELECT kind, fn, 'deny Db Exec app::nation' AS raw, effects, line FROM plan"""
SQL["gate_forbid_beyond"] = """SELECT 'forbid app::nation -> elsewhere' AS raw, 'app::nation::n' || c_nationkey AS fn, 'via ' || min('app::customer::c' || c_custkey) AS detail FROM customer WHERE c_custkey % 10 = 0 GROUP BY c_nationkey"""
SQL["gate_verdict"] = f"""SELECT sum(violations)::BIGINT AS violations, sum(unevaluated)::BIGINT AS unevaluated, (SELECT count(*) FROM ({SQL["gate_zero_match"]}))::BIGINT AS zero_match,
      CASE WHEN sum(violations) > 0 THEN 1 WHEN sum(unevaluated) > 0 THEN 2 ELSE 0 END::INT AS status, CASE WHEN sum(violations) > 0 THEN 'violations' WHEN sum(unevaluated) > 0 THEN 'refused' ELSE 'clear' END AS verdict
    FROM ({SQL["gate_judged"]})"""
SQL["verdict_parts"] = f"SELECT raw, fn, effects FROM ({SQL['gate_deny']})"
SQL["reports_scan"] = f"""{_NOW} SELECT u.fn, coalesce((SELECT string_agg(effect, ',' ORDER BY effect) FROM inferred i WHERE i.fn = u.fn), '') AS inferred,
      coalesce((SELECT string_agg(effect, ',' ORDER BY effect) FROM direct d WHERE d.fn = u.fn), '') AS direct, u.entry_point FROM units u WHERE regexp_matches(u.fn, '^app::(region|nation|customer)')"""
SQL["report_envelopes"] = f"""{_NOW} SELECT CASE WHEN {_ODD} THEN 'odd' WHEN fn LIKE 'app::customer%' THEN 'even' ELSE 'top' END AS package, CASE WHEN {_ODD} THEN '1' ELSE '2' END AS version,
      count(*)::BIGINT AS units, 'absent' AS switches_state FROM units WHERE regexp_matches(fn, '^app::(region|nation|customer)') GROUP BY ALL"""
SQL["sibling_effects"] = f"""{_NOW} SELECT DISTINCT src AS fn, effect FROM (
      SELECT e.src, i.effect FROM edges e JOIN inferred i ON i.fn = e.dst WHERE e.src LIKE 'app::nation%' AND NOT (e.dst LIKE '%1' OR e.dst LIKE '%7')
      UNION ALL SELECT src, 'Unknown' FROM edges WHERE src LIKE 'app::nation%' AND (dst LIKE '%1' OR dst LIKE '%7'))"""
SQL["baseline_effects"] = f"{_NOW} SELECT fn, effect FROM inferred WHERE fn LIKE 'app::customer%' AND NOT {_ODD}"
