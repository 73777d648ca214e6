"""DuckDB SQL for the registered queries, written from definitions and not from the engine's plans."""

from __future__ import annotations

FIELD = """
f AS (SELECT CAST(vec_id // 64 AS VARCHAR) AS surface_id, CAST(vec_id % 64 AS INTEGER) AS r, CAST(i - 1 AS INTEGER) AS c,
             CASE WHEN ((vec_id % 64) * 31 + (i - 1) * 17) % 23 = 0 THEN NULL ELSE CAST(embedding[i] AS DOUBLE) END AS h
      FROM embeddings, range(1, 65) AS t(i)),
e AS (SELECT *, max(r) OVER (PARTITION BY surface_id) + 1 AS n_rows, (r - max(r) OVER (PARTITION BY surface_id) / 2.0) * 4.0 AS y, (c - 31.5) * 4.0 AS x FROM f)
"""
MOVED = """
m AS (SELECT a.surface_id, a.r, a.c, b.h + 0.01 * ((7 * a.r + 13 * a.c) % 11) AS h
      FROM e a LEFT JOIN e b ON a.surface_id = b.surface_id AND b.r = a.r - 2 AND b.c = a.c + 3 AND a.c < 61)
"""


def _field(body: str, *more: str) -> str:
    return f"WITH {', '.join((FIELD, *more))} {body}"


def _without(condition: str) -> str:
    return _field(f"SELECT surface_id, r, c, CASE WHEN {condition} THEN NULL ELSE h END AS h FROM e")


BAND = "abs(y * cos(radians(30)) - x * sin(radians(30)) + 31.0) <= 11.0"
DISC = "sqrt((y - 50.0) * (y - 50.0) + x * x) <= 41.0"
PLANE = """
, s AS (SELECT surface_id, regr_slope(x, y) AS xs, regr_intercept(x, y) AS xi, regr_slope(h, y) AS hs, regr_intercept(h, y) AS hi FROM e WHERE h IS NOT NULL GROUP BY 1),
p AS (SELECT e.*, x - xi - xs * y AS xr, h - hi - hs * y AS hr FROM e JOIN s USING (surface_id)),
b AS (SELECT surface_id, sum(xr * hr) / sum(xr * xr) AS slope FROM p WHERE h IS NOT NULL GROUP BY 1)
SELECT surface_id, r, c, round(hr - slope * xr, 6) AS h FROM p JOIN b USING (surface_id)
"""


def _smooth(name: str, cutoff: float) -> str:
    """Direct two-dimensional weighted mean."""
    import math

    half = int(math.sqrt(math.log(2) / math.pi) * cutoff * math.sqrt(math.log(2.0**52) / math.pi) / 4.0)
    weight = f"exp(-pi() * (pow((a.y - b.y) / (sqrt(ln(2) / pi()) * {cutoff}), 2) + pow((a.x - b.x) / (sqrt(ln(2) / pi()) * {cutoff}), 2)))"
    return f"""{name} AS (SELECT a.surface_id, a.r, a.c, sum(b.h * {weight}) / sum({weight}) AS h FROM e a, range(-{half}, {half + 1}) AS dr(i), range(-{half}, {half + 1}) AS dc(j), e b
      WHERE b.surface_id = a.surface_id AND b.r = a.r + i AND b.c = a.c + j AND b.h IS NOT NULL GROUP BY 1, 2, 3)"""


def _turn(source: str, name: str, degrees: str) -> str:
    """Four corners around each turned position, from ``source`` (surface_id, r, c, h) with angles of ``degrees``."""
    return f"""{name}_at AS (SELECT s.surface_id, s.r, s.c, n_rows, d.deg, cos(radians(d.deg)) * (s.r - (n_rows - 1) / 2.0) - sin(radians(d.deg)) * (s.c - 31.5) + (n_rows - 1) / 2.0 AS sr,
         sin(radians(d.deg)) * (s.r - (n_rows - 1) / 2.0) + cos(radians(d.deg)) * (s.c - 31.5) + 31.5 AS sc
      FROM e s, (SELECT unnest({degrees}) AS deg) d),
{name}_w AS (SELECT surface_id, r, c, deg, CAST(floor(sr) AS INTEGER) + i AS tr, CAST(floor(sc) AS INTEGER) + j AS tc,
         abs(1 - i - (sr - floor(sr))) * abs(1 - j - (sc - floor(sc))) AS w FROM {name}_at, range(2) AS a(i), range(2) AS b(j)),
{name}_s AS (SELECT t.surface_id, t.r, t.c, t.deg, sum(w) AS w, sum(w * q.h) AS v FROM {name}_w t JOIN {source} q ON q.surface_id = t.surface_id AND q.r = tr AND q.c = tc WHERE q.h IS NOT NULL GROUP BY ALL),
{name} AS (SELECT e.surface_id, e.r, e.c, d.deg, CASE WHEN w >= 1 - 1e-9 THEN v / w END AS h FROM e, (SELECT unnest({degrees}) AS deg) d LEFT JOIN {name}_s s ON s.surface_id = e.surface_id AND s.r = e.r AND s.c = e.c AND s.deg = d.deg)"""


GRID = """
g AS (SELECT surface_id, r, c, h, x.k AS cell_r, z.k AS cell_c FROM e
      JOIN (SELECT n, k, k * (n // {g}) + least(k, n % {g}) AS low, (k + 1) * (n // {g}) + least(k + 1, n % {g}) AS high FROM (SELECT DISTINCT n_rows AS n FROM e), range({g}) AS t(k)) x ON x.n = n_rows AND r >= x.low AND r < x.high
      JOIN (SELECT k, k * (64 // {g}) + least(k, 64 % {g}) AS low, (k + 1) * (64 // {g}) + least(k + 1, 64 % {g}) AS high FROM range({g}) AS t(k)) z ON c >= z.low AND c < z.high),
u AS (SELECT surface_id, cell_r, cell_c, min(r) AS top, min(c) AS left_, count(*) AS size, count(h) AS measured, count(h) >= 0.5 * count(*) AS usable FROM g GROUP BY 1, 2, 3)
"""


def _correlated(reference: str, deg: str = "0") -> str:
    """Correlation about the means of each overlap."""
    return f"""
o AS (SELECT g.surface_id, g.cell_r, g.cell_c, u.size, q.{deg} AS deg, CAST(i AS INTEGER) AS down, CAST(j AS INTEGER) AS across, g.h AS x, q.h AS y
      FROM g JOIN u USING (surface_id, cell_r, cell_c), range(-3, 4) AS di(i), range(-3, 4) AS dj(j), {reference} q
      WHERE u.usable AND g.h IS NOT NULL AND q.surface_id = g.surface_id AND q.r = g.r + i AND q.c = g.c + j AND q.h IS NOT NULL),
a AS (SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM o WINDOW w AS (PARTITION BY surface_id, cell_r, cell_c, deg, down, across)),
k AS (SELECT surface_id, cell_r, cell_c, deg, down, across, count(*) AS overlap, CASE WHEN sum((x - mx) * (x - mx)) > 1e-12 * sum(x * x) AND sum((y - my) * (y - my)) > 1e-12 * sum(y * y)
        THEN greatest(-1, least(1, sum((x - mx) * (y - my)) / sqrt(sum((x - mx) * (x - mx)) * sum((y - my) * (y - my))))) END AS correlation
      FROM a GROUP BY surface_id, cell_r, cell_c, size, deg, down, across HAVING count(*) >= greatest(1, ceil(0.5 * size))),
n AS (SELECT * FROM k WHERE correlation IS NOT NULL),
b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY surface_id, cell_r, cell_c, deg ORDER BY round(correlation, 9) DESC, down, across) = 1)"""


M0 = MOVED + ", mm AS (SELECT *, 0 AS deg FROM m)"
PLAIN = (GRID.format(g=4), M0, _correlated("mm", "deg"))
TURNED = (GRID.format(g=4), MOVED, _turn("m", "tm", "[-6.0, 0.0, 6.0]"), _correlated("tm", "deg"))
TURNED_ROWS = "surface_id AS pair_id, CAST(deg AS DOUBLE) AS angle_deg, CAST(cell_r AS INTEGER) AS cell_r, CAST(cell_c AS INTEGER) AS cell_c, down, across, round(correlation, 6) + 0.0 AS correlation, CAST(overlap AS BIGINT) AS overlap"
BEST_TURN = "QUALIFY row_number() OVER (PARTITION BY surface_id, cell_r, cell_c ORDER BY round(correlation, 9) DESC, deg) = 1"

EVENTS = """
reg AS (SELECT CAST(event_id // 125 AS VARCHAR) AS pair_id, CAST((event_id % 5 - 2) * 2 AS DOUBLE) AS angle_deg, CAST((event_id % 125) // 25 AS INTEGER) AS cell_r, CAST(((event_id % 125) // 5) % 5 AS INTEGER) AS cell_c,
        CAST(CAST(floor(value * 10) AS BIGINT) % 5 - 2 AS INTEGER) AS down, CAST(CAST(floor(value * 100) AS BIGINT) % 5 - 2 AS INTEGER) AS across, round(value - floor(value), 4) AS correlation FROM events),
best AS (SELECT * FROM reg QUALIFY row_number() OVER (PARTITION BY pair_id, cell_r, cell_c ORDER BY round(correlation, 9) DESC, angle_deg) = 1)
"""
MEDIANS = "con AS (SELECT pair_id, median(down) AS down_at, median(across) AS across_at, median(angle_deg) AS angle_deg_at FROM best GROUP BY 1)"


def _mode(column: str, width: float) -> str:
    return f"(SELECT pair_id, {column}_at FROM (SELECT pair_id, median({column}) AS {column}_at, count(*) AS n, floor({column} / {width}) AS bin FROM best GROUP BY pair_id, bin QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY n DESC, bin) = 1))"


MODES = f"con AS (SELECT pair_id, down_at, across_at, angle_deg_at FROM {_mode('down', 2.0)} JOIN {_mode('across', 2.0)} USING (pair_id) JOIN {_mode('angle_deg', 4.0)} USING (pair_id))"
JUDGED = """jd AS (SELECT *, abs(down - down_at) <= 1 AS nd, abs(across - across_at) <= 1 AS na, abs(angle_deg - angle_deg_at) <= 2 AS nr, correlation >= 0.3 AS nc FROM best JOIN con USING (pair_id)),
sc AS (SELECT pair_id, count(*) FILTER (nd AND na AND nr AND nc) AS congruent, count(*) AS eligible, count(*) FILTER (NOT (nd AND na AND nr AND nc)) AS discarded, count(*) FILTER (NOT nd) AS failed_down, count(*) FILTER (NOT na) AS failed_across,
  count(*) FILTER (NOT nr) AS failed_rotation, count(*) FILTER (NOT nc) AS failed_correlation, round(any_value(down_at), 6) + 0.0 AS down_at, round(any_value(across_at), 6) + 0.0 AS across_at, round(any_value(angle_deg_at), 6) + 0.0 AS angle_deg_at,
  coalesce(string_agg(cell_r || ':' || cell_c, ' ' ORDER BY cell_r, cell_c) FILTER (nd AND na AND nr AND nc), '') AS cells FROM jd GROUP BY 1)"""
HIGH = """ac AS (SELECT pair_id, angle_deg, median(down) AS d, median(across) AS a FROM reg GROUP BY 1, 2),
ag AS (SELECT reg.*, abs(down - d) <= 1 AND abs(across - a) <= 1 AND correlation >= 0.3 AS agrees FROM reg JOIN ac USING (pair_id, angle_deg)),
cn AS (SELECT pair_id, angle_deg, count(*) FILTER (agrees) AS n, max(count(*) FILTER (agrees)) OVER (PARTITION BY pair_id) AS peak FROM ag GROUP BY 1, 2),
hi AS (SELECT * FROM cn WHERE peak > 0 AND n >= peak - 1),
hc AS (SELECT DISTINCT ag.pair_id, cell_r, cell_c FROM ag JOIN hi USING (pair_id, angle_deg) WHERE agrees),
hs AS (SELECT p.pair_id, (SELECT count(*) FROM hc WHERE hc.pair_id = p.pair_id) AS congruent, p.eligible, p.eligible - (SELECT count(*) FROM hc WHERE hc.pair_id = p.pair_id) AS discarded, p.peak,
  coalesce((SELECT string_agg(CAST(CAST(angle_deg AS INTEGER) AS VARCHAR), ' ' ORDER BY angle_deg) FROM hi WHERE hi.pair_id = p.pair_id), '') AS high_angles,
  coalesce((SELECT string_agg(cell_r || ':' || cell_c, ' ' ORDER BY cell_r, cell_c) FROM hc WHERE hc.pair_id = p.pair_id), '') AS cells
  FROM (SELECT pair_id, count(DISTINCT (cell_r, cell_c)) AS eligible, max(peak) AS peak FROM ag JOIN cn USING (pair_id, angle_deg) GROUP BY 1) p)"""

COMPARED = """
q AS (SELECT 'suppliers' AS set_name, CAST(a.l_quantity AS INTEGER) % 21 AS score, CAST(a.l_suppkey AS VARCHAR) AS source_a, CAST(b.l_suppkey AS VARCHAR) AS source_b,
             CASE WHEN a.l_suppkey = b.l_suppkey THEN 'same-source' ELSE 'different-source' END AS proposition
      FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber),
ends AS (SELECT proposition, source_a AS source FROM q UNION ALL SELECT proposition, source_b FROM q WHERE source_a <> source_b)
"""
RATIO = "CASE WHEN b > 0 AND d > 0 AND (a > 0 OR c > 0) THEN CASE WHEN a = 0 THEN CAST('-infinity' AS DOUBLE) WHEN c = 0 THEN CAST('infinity' AS DOUBLE) ELSE log10((a / b) / (c / d)) END END"

ORACLES = {
    "surface_explode": _field("SELECT surface_id, r, c, h FROM e"),
    "unit_convert": _field("SELECT surface_id, r, c, round(h * [0.001, 1.0, 1000.0, 1000000.0][CAST(surface_id AS INTEGER) % 4 + 1], 6) + 0.0 AS h FROM e"),
    "trim_frame": _without("r < 3 OR r >= n_rows - 3 OR c < 3 OR c >= 61"),
    "trim_grow": _without("EXISTS (SELECT 1 FROM e n WHERE n.surface_id = e.surface_id AND n.r BETWEEN e.r - 1 AND e.r + 1 AND n.c BETWEEN e.c - 1 AND e.c + 1 AND n.h IS NULL)"),
    "mask_band": _without(BAND),
    "mask_disc": _without(DISC),
    "mask_counts": _field(f"SELECT surface_id, count(*) FILTER (h IS NOT NULL AND {BAND}) AS drag_samples, count(*) FILTER (h IS NOT NULL AND {DISC}) AS extractor_samples FROM e GROUP BY 1"),
    "outlier_global_mad": _field("SELECT e.surface_id, r, c, CASE WHEN abs(h - m) > 3.0 * s THEN NULL ELSE h END AS h FROM e JOIN (SELECT surface_id, median(h) AS m, mad(h) AS s FROM e GROUP BY 1) USING (surface_id)"),
    "outlier_global_std": _field("SELECT e.surface_id, r, c, CASE WHEN abs(h - m) > 1.5 * s THEN NULL ELSE h END AS h FROM e JOIN (SELECT surface_id, avg(h) AS m, stddev_pop(h) AS s FROM e GROUP BY 1) USING (surface_id)"),
    "level_plane": f"WITH {FIELD}{PLANE}",
    "chain_trim_frame": _without("r < 3 OR r >= n_rows - 3 OR c < 3 OR c >= 61"),
    "chain_mask_marks": _without(f"{BAND} OR sqrt(y * y + (x - 50.0) * (x - 50.0)) <= 41.0"),
    "mask_pin_fixed": _without("sqrt((y - 10.0) * (y - 10.0) + (x + 20.0) * (x + 20.0)) <= 37.0"),
    "outlier_local": _field(
        "SELECT surface_id, r, c, CASE WHEN abs(h - m) > 3.0 * s THEN NULL ELSE h END AS h FROM e LEFT JOIN (SELECT surface_id, r, c, median(v) AS m, mad(v) AS s FROM near GROUP BY 1, 2, 3) USING (surface_id, r, c)",
        "near AS MATERIALIZED (SELECT surface_id, CAST(r + i AS INTEGER) AS r, CAST(c + j AS INTEGER) AS c, h AS v FROM e, range(-2, 3) AS dr(i), range(-2, 3) AS dc(j) WHERE h IS NOT NULL)",
    ),
    "chain_level_plane": f"WITH {FIELD}{PLANE}",
    "gauss_smooth": _field("SELECT e.surface_id, e.r, e.c, round(g.h, 6) AS h FROM e LEFT JOIN g USING (surface_id, r, c)", _smooth("g", 12.0)),
    "bandpass_linear": _field("SELECT e.surface_id, e.r, e.c, CASE WHEN e.h IS NOT NULL THEN round(s.h - l.h, 6) END AS h FROM e LEFT JOIN s USING (surface_id, r, c) LEFT JOIN l USING (surface_id, r, c)", _smooth("s", 8.0), _smooth("l", 16.0)),
    "transmission": "SELECT s_suppkey, round(exp(-pi() * pow(sqrt(ln(2) / pi()) * 20.0 / s_suppkey, 2)), 8) AS low, round(exp(-pi() * pow(sqrt(ln(2) / pi()) * 20.0 / s_suppkey, 2)) - exp(-pi() * pow(sqrt(ln(2) / pi()) * 120.0 / s_suppkey, 2)), 8) AS band FROM supplier WHERE s_suppkey > 0",
    "rotate_six": _field("SELECT surface_id, r, c, round(h, 6) AS h FROM t", _turn("e", "t", "[6.0]")),
    "cell_assign": _field("SELECT surface_id, r, c, CAST(cell_r AS INTEGER) AS cell_r, CAST(cell_c AS INTEGER) AS cell_c FROM g", GRID.format(g=5)),
    "cell_usable": _field("SELECT surface_id, CAST(cell_r AS INTEGER) AS cell_r, CAST(cell_c AS INTEGER) AS cell_c, top, left_ AS \"left\", size, measured, usable FROM u", GRID.format(g=4).replace("x.k AS cell_r, z.k AS cell_c FROM e", "x.k AS cell_r, z.k AS cell_c FROM (SELECT * REPLACE (CASE WHEN " + DISC + " THEN NULL ELSE h END AS h) FROM e) e")),
    "masked_ncc": _field("SELECT surface_id, CAST(cell_r AS INTEGER) AS cell_r, CAST(cell_c AS INTEGER) AS cell_c, down, across, overlap, round(correlation, 6) + 0.0 AS correlation FROM n", *PLAIN),
    "best_placement": _field("SELECT surface_id, CAST(cell_r AS INTEGER) AS cell_r, CAST(cell_c AS INTEGER) AS cell_c, down, across, overlap, round(correlation, 6) + 0.0 AS correlation FROM b", *PLAIN),
    "register_by_angle": _field(f"SELECT {TURNED_ROWS} FROM b", *TURNED),
    "register_best": _field(f"SELECT {TURNED_ROWS} FROM b {BEST_TURN}", *TURNED),
    "consensus_median": f"WITH {EVENTS}, {MEDIANS} SELECT * FROM con",
    "consensus_mode": f"WITH {EVENTS}, {MODES} SELECT * FROM con",
    "cmc_score": f"WITH {EVENTS}, {MEDIANS}, {JUDGED} SELECT * FROM sc",
    "cmc_score_mode": f"WITH {EVENTS}, {MODES}, {JUDGED} SELECT * FROM sc",
    "high_cmc": f"WITH {EVENTS}, {HIGH} SELECT * FROM hs",
    "rule_disagreements": f"""WITH {EVENTS}, {MEDIANS}, {JUDGED}, {HIGH}, oc AS (SELECT pair_id, cell_r, cell_c FROM jd WHERE nd AND na AND nr AND nc)
      SELECT pair_id, coalesce((SELECT string_agg(cell_r || ':' || cell_c, ' ' ORDER BY cell_r, cell_c) FROM (SELECT * FROM oc WHERE pair_id = sc.pair_id EXCEPT SELECT * FROM hc WHERE pair_id = sc.pair_id)), '') AS only_original,
        coalesce((SELECT string_agg(cell_r || ':' || cell_c, ' ' ORDER BY cell_r, cell_c) FROM (SELECT * FROM hc WHERE pair_id = sc.pair_id EXCEPT SELECT * FROM oc WHERE pair_id = sc.pair_id)), '') AS only_high FROM sc""",
    "proposition_counts": f"WITH {COMPARED} SELECT 'suppliers' AS set_name, proposition, pairs, sources FROM (SELECT proposition, count(*) AS pairs FROM q GROUP BY 1) JOIN (SELECT proposition, count(DISTINCT source) AS sources FROM ends GROUP BY 1) USING (proposition)",
    "score_distribution": f"""WITH {COMPARED}, t AS (SELECT proposition, count(*) AS total FROM q GROUP BY 1)
      SELECT 'suppliers' AS set_name, t.proposition, CAST(s AS INTEGER) AS score, count(q.score) AS n, round(count(q.score) / total, 9) + 0.0 AS frequency FROM t CROSS JOIN range(21) AS r(s) LEFT JOIN q ON q.proposition = t.proposition AND q.score = s GROUP BY t.proposition, s, total""",
    "diagnostics": f"""WITH {COMPARED} SELECT 'suppliers' AS set_name, proposition, min(score) AS least, max(score) AS most, count(DISTINCT score) AS distinct_scores,
      round((SELECT max(n) FROM (SELECT count(*) AS n FROM ends x WHERE x.proposition = q.proposition GROUP BY source)) / count(*), 9) + 0.0 AS largest_source_share, round(1 - count(DISTINCT score) / 21, 9) + 0.0 AS unobserved_share FROM q GROUP BY proposition""",
    "supportable_range": f"WITH {COMPARED} SELECT 'suppliers' AS set_name, round(-log10(count(DISTINCT source) FILTER (proposition = 'same-source')), 6) + 0.0 AS low, round(log10(count(DISTINCT source) FILTER (proposition = 'different-source')), 6) + 0.0 AS high FROM ends",
    "log_ratio_point": f"WITH {COMPARED}, w AS (SELECT count(*) FILTER (source_a = source_b AND score = 7) AS a, count(*) FILTER (source_a = source_b) AS b, count(*) FILTER (source_a <> source_b AND score = 7) AS c, count(*) FILTER (source_a <> source_b) AS d FROM q) SELECT 'suppliers' AS set_name, round({RATIO}, 6) + 0.0 AS log_ratio FROM w",
    "disjoint_check": f"WITH {COMPARED} SELECT source_a, source_b, count(*) AS n FROM q WHERE source_a IN ('3', '8') OR source_b IN ('3', '8') GROUP BY 1, 2",
    "bootstrap_interval": f"""WITH {COMPARED}, src AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM ends)),
      dr AS (SELECT CAST(i AS INTEGER) AS resample, ('0x' || substr(md5('11-' || i || '-' || j), 1, 8))::BIGINT % (SELECT max(n) FROM src) AS k FROM range(20) AS a(i), range((SELECT max(n) FROM src)) AS b(j)),
      mu AS (SELECT resample, source, count(*) AS m FROM dr JOIN src USING (k) GROUP BY 1, 2),
      w AS (SELECT x.resample, sum(CASE WHEN source_a = source_b AND score = 7 THEN x.m ELSE 0 END) AS a, sum(CASE WHEN source_a = source_b THEN x.m ELSE 0 END) AS b,
          sum(CASE WHEN source_a <> source_b AND score = 7 THEN x.m * y.m ELSE 0 END) AS c, sum(CASE WHEN source_a <> source_b THEN x.m * y.m ELSE 0 END) AS d FROM q JOIN mu x ON x.source = source_a JOIN mu y ON y.source = source_b AND y.resample = x.resample GROUP BY 1),
      l AS (SELECT resample, {RATIO} AS v FROM w), o AS (SELECT list(v ORDER BY v) FILTER (v IS NOT NULL) AS vs FROM l)
      SELECT 'suppliers' AS set_name, round(vs[CAST(floor(((1 - 0.95::DOUBLE) / 2) * (len(vs) - 1)) AS INTEGER) + 1], 6) + 0.0 AS low, round(vs[CAST(ceil((1 - (1 - 0.95::DOUBLE) / 2) * (len(vs) - 1)) AS INTEGER) + 1], 6) + 0.0 AS high, CAST(20 - len(vs) AS BIGINT) AS unusable FROM o""",
    "design_one_at_a_time": """WITH v AS (SELECT r_name AS parameter, n_name AS value, n_name = min(n_name) OVER (PARTITION BY r_name) AS is_base FROM nation JOIN region ON n_regionkey = r_regionkey),
      h AS (SELECT parameter AS moved, value AS to_ FROM v WHERE NOT is_base UNION ALL SELECT NULL, NULL)
      SELECT coalesce(moved || '=' || to_, '') AS assignment, parameter, CASE WHEN parameter = moved THEN to_ ELSE value END AS value FROM h CROSS JOIN v WHERE is_base""",
    "design_factorial": "SELECT CAST(grid AS INTEGER) AS grid, CAST(lim AS INTEGER) AS \"limit\", model FROM (SELECT unnest([3, 6, 12]) AS grid), (SELECT unnest([0, 8]) AS lim), (SELECT unnest(['plane', 'sphere']) AS model)",
    "resume_anti_join": "SELECT o_orderkey AS cell FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
    "range_admits": """SELECT parameter, admitted, count(*) AS n FROM (SELECT 'p' || (p_partkey % 4) AS parameter,
      CASE p_partkey % 4 WHEN 0 THEN p_partkey % 7 <> 0 AND p_size BETWEEN 5 AND 20 WHEN 1 THEN p_partkey % 7 = 0 OR p_size BETWEEN 1 AND 50 WHEN 2 THEN p_partkey % 7 = 0 OR p_size = 30 ELSE false END AS admitted FROM part) GROUP BY 1, 2""",
    "conclusion_words": r"""WITH l AS (SELECT doc_id AS source, unnest(ls) AS body, generate_subscripts(ls, 1) AS line FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS ls FROM documents)),
      k AS (SELECT source, line, body, regexp_extract_all(body, '[A-Za-z]+') AS ws, string_split_regex(body, '[A-Za-z]+') AS gs FROM l WHERE NOT regexp_matches(body, '\[(cited:|measured over)\s*[^\]\s][^\]]*\]')),
      w AS (SELECT source, line, ws, gs, unnest(range(1, len(ws) + 1)) AS i FROM k)
      SELECT source, CAST(line AS INTEGER) AS line, CAST(coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ws[1:i - 1], lambda x: length(x))), 0) + 1 AS INTEGER) AS "column", ws[i] AS word
      FROM w WHERE regexp_matches(lower(ws[i]), '^(identif|exclud|match|ther)') AND lower(ws[i]) NOT IN ('identifier', 'identifiers')""",
}
ORACLES["rotate_right_angle"] = _field("SELECT a.surface_id, a.r, a.c, round(q.h, 6) AS h FROM e a LEFT JOIN e q ON q.surface_id = a.surface_id AND q.r = (a.n_rows - 1) / 2.0 - (a.c - 31.5) AND q.c = (a.r - (a.n_rows - 1) / 2.0) + 31.5")
ORACLES["container_roundtrip"] = _field("SELECT DISTINCT surface_id, CAST(n_rows AS INTEGER) AS n_rows, 64 AS n_cols, true AS was_read, true AS heights_agree FROM e")
ORACLES["chain_trim_grow"] = ORACLES["trim_grow"]
ORACLES["registered_score"] = _field(
    f"""SELECT pair_id, count(*) FILTER (ok) AS congruent, count(*) AS eligible, count(*) FILTER (NOT ok) AS discarded FROM
      (SELECT pair_id, abs(down - median(down) OVER w) <= 1 AND abs(across - median(across) OVER w) <= 1 AND abs(angle_deg - median(angle_deg) OVER w) <= 2 AND correlation >= 0.3 AS ok FROM (SELECT {TURNED_ROWS} FROM b {BEST_TURN}) WINDOW w AS (PARTITION BY pair_id)) GROUP BY 1""",
    *TURNED,
)

#: The whole table as one field.
TALL = FIELD.replace("CAST(vec_id // 64 AS VARCHAR)", "'all'").replace("vec_id % 64", "vec_id")
SIDES = "(VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) AS side(i, j)"


def _reach(name: str, source: str) -> str:
    """Every sample of ``source`` with those that it is connected to."""
    return f"""{name} AS (SELECT surface_id, n_rows, r AS r0, c AS c0, r, c FROM {source} UNION
      SELECT t.surface_id, t.n_rows, t.r0, t.c0, q.r, q.c FROM {name} t, {SIDES}, {source} q WHERE q.surface_id = t.surface_id AND q.r = t.r + i AND q.c = t.c + j),
{name}_of AS (SELECT surface_id, n_rows, r0 AS r, c0 AS c, min(r * 64 + c) AS region FROM {name} GROUP BY ALL),
{name}_all AS (SELECT surface_id, any_value(n_rows) AS n_rows, CAST(region AS BIGINT) AS region, count(*) AS size, CAST(sum(r) AS BIGINT) AS sum_r, CAST(sum(c) AS BIGINT) AS sum_c, bool_or(r = 0 OR c = 0 OR r = n_rows - 1 OR c = 63) AS at_edge FROM {name}_of GROUP BY surface_id, region)"""


def _deep(threshold: float) -> str:
    return f"deep AS (SELECT e.surface_id, n_rows, r, c, coalesce(h < m - {threshold}, false) AS below FROM e JOIN (SELECT surface_id, median(h) AS m FROM e GROUP BY 1) USING (surface_id))"


def _spread(name: str, cutoff: float) -> str:
    """Two-dimensional weighted mean: each measured sample is handed to all that it reaches."""
    import math

    half = int(math.sqrt(math.log(2) / math.pi) * cutoff * math.sqrt(math.log(2.0**52) / math.pi) / 4.0)
    return f"""{name} AS (SELECT surface_id, r + i AS r, c + j AS c, sum(h * w) / sum(w) AS h FROM e,
      (SELECT i, j, exp(-pi() * 16.0 * (i * i + j * j) / pow(sqrt(ln(2) / pi()) * {cutoff}, 2)) AS w FROM range(-{half}, {half + 1}) AS a(i), range(-{half}, {half + 1}) AS b(j))
      WHERE h IS NOT NULL GROUP BY ALL)"""


ORACLES["tiled_smooth"] = f"WITH {TALL}, {_spread('g', 12.0)} SELECT e.surface_id, e.r, e.c, round(g.h, 6) AS h FROM e LEFT JOIN g USING (surface_id, r, c)"
ORACLES["tiled_bandpass"] = f"WITH {TALL}, {_spread('s', 8.0)}, {_spread('l', 16.0)} SELECT e.surface_id, e.r, e.c, CASE WHEN e.h IS NOT NULL THEN round(s.h - l.h, 6) END AS h FROM e LEFT JOIN s USING (surface_id, r, c) LEFT JOIN l USING (surface_id, r, c)"
for _name in ("trim_grow", "outlier_local"):
    ORACLES[f"tiled_{_name}"] = ORACLES[_name].replace(FIELD, TALL)
ORACLES["tiled_median"] = _field("SELECT surface_id, median(h) AS median FROM e GROUP BY 1")
ORACLES["tiled_regions"] = f"WITH RECURSIVE {TALL}, {_deep(0.1)}, low AS (SELECT * FROM deep WHERE below), {_reach('t', 'low')} SELECT surface_id, region, size, sum_r, sum_c, at_edge FROM t_all"
ORACLES["tiled_pins"] = f"""WITH RECURSIVE {FIELD}, {_deep(0.05)}, open AS (SELECT * FROM deep WHERE NOT below),
  outer_ AS (SELECT surface_id, r, c FROM open WHERE r = 0 OR c = 0 OR r = n_rows - 1 OR c = 63 UNION
    SELECT q.surface_id, q.r, q.c FROM outer_ t, {SIDES}, open q WHERE q.surface_id = t.surface_id AND q.r = t.r + i AND q.c = t.c + j),
  whole AS (SELECT * FROM deep ANTI JOIN outer_ USING (surface_id, r, c)), {_reach('t', 'whole')},
  best AS (SELECT * FROM t_all QUALIFY row_number() OVER (PARTITION BY surface_id ORDER BY size DESC, region) = 1),
  pin AS (SELECT f.surface_id, size, (sum_r / size - (f.n_rows - 1) / 2.0) * 4.0 AS cy, (sum_c / size - 31.5) * 4.0 AS cx, sqrt(size * 16.0 / pi()) AS radius
    FROM (SELECT DISTINCT surface_id, n_rows FROM e) f LEFT JOIN best USING (surface_id))
  SELECT surface_id, size, round(cy, 6) + 0.0 AS centre_y, round(cx, 6) + 0.0 AS centre_x, round(radius, 6) + 0.0 AS radius,
    CASE WHEN size IS NULL THEN 'no-depression' WHEN sqrt(cy * cy + cx * cx) > radius THEN 'depression-off-centre' END AS refused FROM pin"""


def _left(name: str, source: str, terms: list[str], right: str, weight: str) -> str:
    """``source`` with ``b``, what its weighted least-squares fit by ``terms`` leaves of ``right``, and ``last``, the last term's coefficient.

    Each term in turn, and the right side, lose their parts along the terms before, field by field.
    """
    steps = [f"{name}0 AS MATERIALIZED (SELECT *, {right} AS b, {weight} AS w, {', '.join(f'{t} AS t{k}' for k, t in enumerate(terms))} FROM {source})"]
    last = len(terms) - 1
    for k in range(len(terms)):
        lost = [f"{x} - t{k} * (sum(w * {x} * t{k}) OVER s / sum(w * t{k} * t{k}) OVER s) AS {x}" for x in ["b", *(f"t{j}" for j in range(k + 1, len(terms)))]]
        coefficient = f", sum(w * b * t{k}) OVER s / sum(w * t{k} * t{k}) OVER s AS last" if k == last else ""
        steps.append(f"{name}{k + 1} AS MATERIALIZED (SELECT * REPLACE ({', '.join(lost)}){coefficient} FROM {name}{k} WINDOW s AS (PARTITION BY surface_id))")
    return ", ".join(steps) + f", {name} AS MATERIALIZED (SELECT * EXCLUDE (w, {', '.join(f't{k}' for k in range(len(terms)))}) FROM {name}{len(terms)})"


SEEN, FLAT_TERMS = "CASE WHEN h IS NULL THEN 0 ELSE 1 END", ["1.0", "y / 128", "x / 128"]
POLY2 = _left("p", "e", [*FLAT_TERMS, "y * y / 16384", "y * x / 16384", "x * x / 16384"], "coalesce(h, 0)", SEEN)
LEFT = "SELECT surface_id, r, c, CASE WHEN h IS NOT NULL THEN round({}, 6) END AS h FROM {}"
SUMMED = "SELECT surface_id, count(*) AS measured, round(avg(b), 6) + 0.0 AS mean, round(min(b), 6) + 0.0 AS least, round(max(b), 6) + 0.0 AS most FROM {} WHERE h IS NOT NULL GROUP BY 1"


def _huber(tuning: float, passes: int) -> str:
    """A plane, and ``passes`` times again with weights from what the last one left."""
    steps = [_left("u0", "e", FLAT_TERMS, "coalesce(h, 0)", SEEN)]
    for k in range(passes):
        limit = f"(SELECT surface_id AS field, {tuning} * 1.4826 * mad(b) AS most FROM u{k} WHERE h IS NOT NULL GROUP BY 1)"
        steps.append(f"g{k} AS MATERIALIZED (SELECT u{k}.* EXCLUDE (b, last), CASE WHEN h IS NULL THEN 0 WHEN abs(b) <= most THEN 1 ELSE most / abs(b) END AS share FROM u{k} JOIN {limit} ON surface_id = field)")
        steps.append(_left(f"v{k}", f"g{k}", FLAT_TERMS, "coalesce(h, 0)", "share") + f", u{k + 1} AS (SELECT * EXCLUDE (share) FROM v{k})")
    return ", ".join(steps)


ORACLES["tiled_level_poly2"] = _field(LEFT.format("b", "p"), POLY2)
ORACLES["level_poly2"] = _field(SUMMED.format("p"), POLY2)
ORACLES["tiled_level_huber"] = _field(LEFT.format("b", "u1"), _huber(1.5, 1))
ORACLES["level_huber"] = _field(SUMMED.format("u3"), _huber(4.0, 3))

_BALL = {"a": "2 * y / 128", "b": "2 * x / 128", "c": "2 * coalesce(z, 0) / 128", "k": "1.0"}
_FITS = [_left(f"s{n}", "z", [*(t for m, t in _BALL.items() if m != n), _BALL[n]], "(y * y + x * x + coalesce(z * z, 0)) / 16384", SEEN) for n in _BALL]
ORACLES["tiled_level_sphere"] = _field(
    LEFT.format("z - CASE WHEN more < less THEN up ELSE low END", "judged"),
    "z AS MATERIALIZED (SELECT *, h + sqrt(360000.0 - y * y - x * x) - 600 AS z FROM e)",
    *_FITS,
    f"ball AS (SELECT * FROM {' JOIN '.join(f'(SELECT surface_id, any_value(last) AS b{n} FROM s{n} GROUP BY 1)' + (' USING (surface_id)' if n != 'a' else '') for n in _BALL)})",
    "inner_ AS (SELECT z.*, bc, sqrt(bk + ba * ba + bb * bb + bc * bc - pow(y / 128 - ba, 2) - pow(x / 128 - bb, 2)) AS root FROM z JOIN ball USING (surface_id))",
    "judged AS (SELECT *, sum(pow(z - low, 2)) OVER s AS less, sum(pow(z - up, 2)) OVER s AS more FROM (SELECT *, (bc - root) * 128 AS low, (bc + root) * 128 AS up FROM inner_) WINDOW s AS (PARTITION BY surface_id))",
)

#: Sums at every displacement up to 32, about values that differ little from 0.
ORACLES["blocked_ncc"] = _field(
    "SELECT surface_id, CAST(cell_r AS INTEGER) AS cell_r, CAST(cell_c AS INTEGER) AS cell_c, down, across, n AS overlap, round(greatest(-1, least(1, (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)))), 6) + 0.0 AS correlation FROM k WHERE sxx - sx * sx / n > 1e-12 * sxx AND syy - sy * sy / n > 1e-12 * syy",
    GRID.format(g=4),
    MOVED,
    """k AS (SELECT g.surface_id, g.cell_r, g.cell_c, CAST(q.r - g.r AS INTEGER) AS down, CAST(q.c - g.c AS INTEGER) AS across, count(*) AS n, sum(g.h) AS sx, sum(q.h) AS sy, sum(g.h * g.h) AS sxx, sum(q.h * q.h) AS syy, sum(g.h * q.h) AS sxy
      FROM g JOIN u USING (surface_id, cell_r, cell_c) JOIN m q ON q.surface_id = g.surface_id AND q.r BETWEEN g.r - 32 AND g.r + 32 AND q.c BETWEEN g.c - 32 AND g.c + 32
      WHERE u.usable AND g.h IS NOT NULL AND q.h IS NOT NULL GROUP BY g.surface_id, g.cell_r, g.cell_c, u.size, q.r - g.r, q.c - g.c HAVING count(*) >= greatest(1, ceil(0.5 * u.size)))""",
)

ORACLES["bootstrap_interval_200"] = ORACLES["bootstrap_interval"].replace("range(20) AS a(i)", "range(200) AS a(i)").replace("CAST(20 - len(vs)", "CAST(200 - len(vs)")
ORACLES["tiled_rotate_six"] = ORACLES["rotate_six"]
ORACLES["tiled_register_by_angle"] = ORACLES["register_by_angle"]
ORACLES["registered_or_refused"] = ORACLES["register_best"]
ORACLES["correlation_work"] = _field("SELECT surface_id AS pair_id, count(*) FILTER (usable) AS usable, 3 * count(*) FILTER (usable) AS correlations FROM u GROUP BY 1", GRID.format(g=4))
ORACLES["compare_one_orientation"] = _field(
    "SELECT surface_id AS pair_id, CAST(0 AS DOUBLE) AS angle_deg, CAST(cell_r AS INTEGER) AS cell_r, CAST(cell_c AS INTEGER) AS cell_c, down, across, round(correlation, 6) + 0.0 AS correlation, n AS overlap FROM o QUALIFY row_number() OVER (PARTITION BY surface_id, cell_r, cell_c ORDER BY round(correlation, 9) DESC, down, across) = 1",
    GRID.format(g=4),
    MOVED,
    "lim AS (SELECT surface_id, cell_r, cell_c, size, usable, -top AS low_r, -left_ AS low_c, n_rows - 1 - bottom AS high_r, 63 - right_ AS high_c FROM u JOIN (SELECT surface_id, cell_r, cell_c, max(r) AS bottom, max(c) AS right_ FROM g GROUP BY 1, 2, 3) USING (surface_id, cell_r, cell_c) JOIN (SELECT DISTINCT surface_id, n_rows FROM e) USING (surface_id))",
    """k AS (SELECT g.surface_id, g.cell_r, g.cell_c, CAST(q.r - g.r AS INTEGER) AS down, CAST(q.c - g.c AS INTEGER) AS across, count(*) AS n, sum(g.h) AS sx, sum(q.h) AS sy, sum(g.h * g.h) AS sxx, sum(q.h * q.h) AS syy, sum(g.h * q.h) AS sxy
      FROM g JOIN lim USING (surface_id, cell_r, cell_c) JOIN m q ON q.surface_id = g.surface_id AND q.r BETWEEN g.r + low_r AND g.r + high_r AND q.c BETWEEN g.c + low_c AND g.c + high_c
      WHERE usable AND g.h IS NOT NULL AND q.h IS NOT NULL GROUP BY g.surface_id, g.cell_r, g.cell_c, size, q.r - g.r, q.c - g.c HAVING count(*) >= greatest(1, ceil(0.5 * size)))""",
    "o AS (SELECT *, greatest(-1, least(1, (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)))) AS correlation FROM k WHERE sxx - sx * sx / n > 1e-12 * sxx AND syy - sy * sy / n > 1e-12 * syy)",
)


#: A sweep's cells: for each width of the trimmed frame the best placements, judged by each pair of thresholds.
TRIMMED = "e AS (SELECT * REPLACE (CASE WHEN r < {n} OR r >= n_rows - {n} OR c < {n} OR c >= 64 - {n} THEN NULL ELSE h END AS h) FROM e0)"


def _trimmed(n: int) -> str:
    """Best placements of fields, and of moved ones, of which each lost ``n`` samples at every side after the move."""
    moved = MOVED.replace("m AS (", "m0 AS (", 1).replace("e a LEFT JOIN e b", "e0 a LEFT JOIN e0 b")
    cut = f"m AS (SELECT m0.surface_id, m0.r, m0.c, e0.n_rows, CASE WHEN m0.r < {n} OR m0.r >= n_rows - {n} OR m0.c < {n} OR m0.c >= 64 - {n} THEN NULL ELSE m0.h END AS h FROM m0 JOIN e0 USING (surface_id, r, c))"
    turned = _turn("m", "tm", "[-6.0, 0.0, 6.0]").replace("FROM e s, (", "FROM e AS s, (")
    return f"(WITH {FIELD.replace('e AS (', 'e0 AS (')}, {TRIMMED.format(n=n)}, {GRID.format(g=4)}, {moved}, {cut}, {turned}, {_correlated('tm', 'deg')} SELECT {4.0 * n} AS width, {TURNED_ROWS} FROM b {BEST_TURN})"


SWEPT = f"""p AS ({' UNION ALL '.join(f'SELECT * FROM {_trimmed(n)}' for n in (1, 3))}),
t AS (SELECT *, abs(down - median(down) OVER w) AS off_down, abs(across - median(across) OVER w) <= 1 AND abs(angle_deg - median(angle_deg) OVER w) <= 2 AS near FROM p WINDOW w AS (PARTITION BY width, pair_id)),
s AS (SELECT pair_id AS pair, true AS same_source, CAST(k AS DOUBLE) AS correlation_threshold, CAST(d AS DOUBLE) AS down_threshold, CAST(width AS DOUBLE) AS width,
  count(*) FILTER (near AND off_down <= d AND correlation >= k) AS congruent, count(*) AS eligible, count(*) FILTER (NOT (near AND off_down <= d AND correlation >= k)) AS discarded
  FROM t, (SELECT unnest([0.3, 0.9]) AS k), (SELECT unnest([0, 1]) AS d) GROUP BY ALL)"""
ORACLES["sweep_cells"] = f"WITH {SWEPT} SELECT * FROM s"
ORACLES["sweep_report"] = f"""WITH {SWEPT}, v AS (SELECT CAST(correlation_threshold AS VARCHAR) AS compare_cmc_correlation_threshold, CAST(down_threshold AS VARCHAR) AS compare_cmc_down_threshold, CAST(width AS VARCHAR) AS trim_edge_width, * FROM s)
  SELECT compare_cmc_correlation_threshold, compare_cmc_down_threshold, trim_edge_width, CAST(grouping(compare_cmc_correlation_threshold, compare_cmc_down_threshold, trim_edge_width) AS BIGINT) AS "grouping",
    count(*) AS cells, CAST(sum(congruent) AS BIGINT) AS congruent, CAST(sum(eligible) AS BIGINT) AS eligible, min(congruent) AS least, max(congruent) AS most, count(*) AS same_source FROM v GROUP BY CUBE (compare_cmc_correlation_threshold, compare_cmc_down_threshold, trim_edge_width)"""
ORACLES["sweep_manifests"] = _field(
    "SELECT 0 AS pos, 'trim-edge' AS identifier, 'frame' AS criterion, CAST(width AS DOUBLE) AS width, 'reference subject' AS inputs_roles, 'reference-preprocessed subject-preprocessed' AS outputs_roles, CAST(4 * n AS BIGINT) AS cells, n AS inputs, n AS outputs FROM (SELECT count(DISTINCT surface_id) AS n FROM e), (SELECT unnest([4.0, 12.0]) AS width)"
)
ORACLES["sql_preprocessed"] = ORACLES["chain_level_plane"]
