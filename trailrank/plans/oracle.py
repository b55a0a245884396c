"""DuckDB SQL for the registered queries, written from their definitions."""

from __future__ import annotations

A = """a AS (SELECT CAST(l_orderkey AS VARCHAR) AS session_id, CAST(l_partkey AS VARCHAR) AS job_id,
    CASE WHEN l_returnflag = 'R' THEN 'apply' ELSE 'view' END AS action, l_orderkey AS so,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_shipdate) - 1 AS pos,
    count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"""
B = """a AS (SELECT CAST(user_id AS VARCHAR) AS session_id, regexp_extract(props, '"k"\\s*:\\s*(\\d+)', 1) AS job_id,
    CASE WHEN event_type = 'purchase' THEN 'apply' WHEN event_type IN ('view', 'click') THEN 'view' ELSE event_type END AS action, user_id AS so,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
    count(*) OVER (PARTITION BY user_id) AS n FROM events)"""
HT = """h AS (SELECT session_id, job_id, action, so, pos, n - 1 AS n FROM a WHERE pos < n - 1),
    t AS (SELECT session_id, job_id, action, so FROM a WHERE pos = n - 1)"""
TRANS = """pairs AS (SELECT job_id AS from_job, lead(job_id) OVER (PARTITION BY session_id ORDER BY pos) AS to_job FROM {src}),
    tn AS (SELECT from_job, to_job, count(*) AS n FROM pairs WHERE to_job IS NOT NULL GROUP BY ALL),
    tr AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY from_job) AS prob FROM tn),
    pop AS (SELECT to_job AS job_id, CAST(sum(n) AS BIGINT) AS n, row_number() OVER (ORDER BY sum(n) DESC, to_job) AS rank FROM tn GROUP BY to_job QUALIFY rank <= 10)"""
LASTJOB = "lj AS (SELECT session_id, arg_max(job_id, pos) AS last_job FROM h GROUP BY 1)"
RECS = f"""{LASTJOB},
    best AS (SELECT *, row_number() OVER (PARTITION BY from_job ORDER BY prob DESC, to_job) AS rank FROM tr QUALIFY rank <= 10),
    rk AS (SELECT session_id, rank, to_job AS job_id FROM lj JOIN best ON last_job = from_job),
    recs AS (SELECT * FROM rk UNION ALL SELECT t.session_id, p.rank, p.job_id FROM t CROSS JOIN pop p WHERE t.session_id NOT IN (SELECT session_id FROM rk))"""


def _a(*ctes: str, final: str) -> str:
    return "WITH " + ",\n".join([A, *ctes]) + "\n" + final


def _b(*ctes: str, final: str) -> str:
    return "WITH " + ",\n".join([B, *ctes]) + "\n" + final


ALL_T = TRANS.format(src="a")
HIST_T = TRANS.format(src="h")
HITS = """hit AS (SELECT t.session_id, min(r.rank) AS hit_rank FROM t LEFT JOIN recs r ON r.session_id = t.session_id AND r.job_id = t.job_id AND r.rank <= 10 GROUP BY 1)"""
MRR = "SELECT count(*) AS sessions, round(coalesce(avg(coalesce(1.0::DOUBLE / hit_rank, 0)), 0), 6) AS mrr FROM hit"
MRR_CTE = "m AS (SELECT round(avg(coalesce(1.0::DOUBLE / hit_rank, 0)), 6) AS mrr FROM hit)"


def _session_recs(recency: bool, last: int | None = None, name: str = "recs") -> str:
    tag = name if name != "recs" else ""
    cut = f"WHERE n - pos <= {last}" if last else ""
    weight = "row_number() OVER (PARTITION BY session_id ORDER BY pos)::DOUBLE / count(*) OVER (PARTITION BY session_id)" if recency else "1.0::DOUBLE"
    return f"""w{tag} AS (SELECT session_id, job_id, {weight} AS w FROM (SELECT * FROM h {cut})),
    sc{tag} AS (SELECT session_id, to_job AS job_id, round(sum(w * prob), 9) AS score FROM w{tag} JOIN tr ON job_id = from_job GROUP BY ALL),
    rk{tag} AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, job_id) AS rank, job_id FROM sc{tag} QUALIFY rank <= 10),
    {name} AS (SELECT * FROM rk{tag} UNION ALL SELECT t.session_id, p.rank, p.job_id FROM t CROSS JOIN pop p WHERE t.session_id NOT IN (SELECT session_id FROM rk{tag}))"""


def _sweep() -> str:
    parts, finals = [], []
    for k in (1, 3, 5, 7, 10):
        parts.append(_session_recs(True, k, f"r{k}"))
        finals.append(f"SELECT {k} AS k, count(*) AS sessions, round(avg(coalesce(1.0::DOUBLE / hit_rank, 0)), 6) AS mrr FROM (SELECT t.session_id, min(r.rank) AS hit_rank FROM t LEFT JOIN r{k} r ON r.session_id = t.session_id AND r.job_id = t.job_id GROUP BY 1)")
    return _a(HT, ALL_T, *parts, final=" UNION ALL ".join(finals))


VIEWS = "tv AS (SELECT session_id, CAST(sum((action = 'view')::INT) AS BIGINT) AS n_views, CAST(count(*) - coalesce(max(CASE WHEN action <> 'view' THEN pos + 1 END), 0) AS BIGINT) AS trail_view FROM h GROUP BY 1)"


def _shares(by: str) -> str:
    return _a(HT, VIEWS, final=f"""SELECT {by}, count(*) AS sessions, round(sum((action = 'apply')::INT)::DOUBLE / count(*), 6) AS "apply",
        round(sum((action = 'view')::INT)::DOUBLE / count(*), 6) AS "view" FROM tv JOIN t USING (session_id) GROUP BY {by}""")


LAST_ACTION = """la AS (SELECT t.session_id, t.action AS y_true, coalesce(CASE WHEN s.said IN ('view', 'apply') THEN s.said END, 'view') AS y_pred
    FROM t LEFT JOIN (SELECT session_id, arg_max(action, pos) AS said FROM h GROUP BY 1) s USING (session_id))"""

_SW = "CASE WHEN action = 'apply' THEN {a}::DOUBLE ELSE {v}::DOUBLE END"


def _w(v: float, a: float) -> str:
    return _SW.format(a=a, v=v)


POP_W = _w(0.9299464263001853, 6.335092003805592)
ALPHA = 1.6483148299436956
COUNTS = "raw AS (SELECT job_id, count(*)::DOUBLE AS score FROM h GROUP BY 1)"
WEIGHTED = f"raw AS (SELECT job_id, sum({POP_W} * power(0.5825575752466695::DOUBLE, n - pos - 1)) AS score FROM h GROUP BY 1)"
WEIGHTED_T = f"""raw AS (SELECT job_id, sum(w) AS score FROM (SELECT job_id, {POP_W} * power(0.5825575752466695::DOUBLE, n - pos - 1) AS w FROM h
    UNION ALL SELECT job_id, 6.335092003805592::DOUBLE FROM t) GROUP BY 1)"""
TREND = """ranked AS (SELECT session_id, row_number() OVER (ORDER BY so) - 1 AS r, count(*) OVER () AS total FROM (SELECT DISTINCT session_id, so FROM h)),
    {name} AS (SELECT job_id, sum(exp(-ln(2.0::DOUBLE) * (total - r) / 100.0::DOUBLE)) AS score FROM (SELECT DISTINCT session_id, job_id FROM h) JOIN ranked USING (session_id) GROUP BY 1)"""
HYBRID = f"""{TREND.format(name='trend')}, cnt AS (SELECT job_id, count(*)::DOUBLE AS score FROM h GROUP BY 1),
    raw AS (SELECT job_id, sum(score) AS score FROM (SELECT job_id, 0.7::DOUBLE * score / (SELECT max(score) FROM cnt) AS score FROM cnt
    UNION ALL SELECT job_id, (1 - 0.7::DOUBLE) * score / (SELECT max(score) FROM trend) FROM trend) GROUP BY 1)"""
POP_FIT = f"""known AS (SELECT job_id FROM h UNION SELECT job_id FROM t),
    fit AS (SELECT known.job_id, coalesce(score, 0) + {ALPHA}::DOUBLE AS s FROM known LEFT JOIN raw USING (job_id))"""
POP_OUT = f"SELECT job_id, round(s / (SELECT max(s) FROM fit), 6) AS score, round({ALPHA}::DOUBLE / (SELECT max(s) FROM fit), 6) AS fallback FROM fit"


def _pop(raw: str) -> str:
    return _a(HT, raw, POP_FIT, final=POP_OUT)


II_W = _w(1.24, 1.63)
X_H = f"x AS (SELECT session_id, job_id, sum({II_W} * power(0.89::DOUBLE, n - 1 - pos)) AS w FROM h GROUP BY ALL)"
X_HT = f"""x AS (SELECT session_id, job_id, sum(w) AS w FROM (SELECT session_id, job_id, {II_W} * power(0.89::DOUBLE, n - 1 - pos) AS w FROM h
    UNION ALL SELECT session_id, job_id, 1.63::DOUBLE FROM t) GROUP BY ALL)"""
TVERSKY = """pops AS (SELECT job_id, sum(w) AS pop FROM x GROUP BY 1),
    both2 AS (SELECT p.job_id AS job_i, q.job_id AS job_j, sum(p.w * q.w) AS common FROM x p JOIN x q USING (session_id) GROUP BY ALL),
    sims AS (SELECT job_i, job_j, round(common / CASE WHEN d <= 1e-12 THEN 1 ELSE d END * common / (common + 17), 9) AS sim FROM
        (SELECT b.*, common * (1 - 0.29::DOUBLE - 0.03::DOUBLE) + 0.29::DOUBLE * i.pop + 0.03::DOUBLE * j.pop AS d FROM both2 b JOIN pops i ON i.job_id = job_i JOIN pops j ON j.job_id = job_j)),
    sim AS (SELECT job_i, job_j, sim FROM (SELECT *, row_number() OVER (PARTITION BY job_i ORDER BY sim DESC, job_j) AS r FROM sims) WHERE r <= 100 AND job_i <> job_j AND sim > 0)"""
COSINE = """pops AS (SELECT job_id, sqrt(sum(w * w)) AS pop FROM x GROUP BY 1),
    both2 AS (SELECT p.job_id AS job_i, q.job_id AS job_j, sum(p.w * q.w) AS common FROM x p JOIN x q USING (session_id) GROUP BY ALL),
    sims AS (SELECT job_i, job_j, round(common / (i.pop * j.pop) * common / (common + 17), 9) AS sim FROM both2 JOIN pops i ON i.job_id = job_i JOIN pops j ON j.job_id = job_j),
    sim AS (SELECT job_i, job_j, sim FROM (SELECT *, row_number() OVER (PARTITION BY job_i ORDER BY sim DESC, job_j) AS r FROM sims) WHERE r <= 100 AND job_i <> job_j AND sim > 0)"""
II_PRIOR = """xs AS (SELECT job_id, sum(w) AS raw FROM x GROUP BY 1), xt AS (SELECT sum(raw) + 17 * count(*) AS tot FROM xs),
    ip AS (SELECT job_id, (raw + 17) / tot AS prior, 17 / tot AS fallback FROM xs, xt)"""
II_QUERY = f"""qr AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS m, row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1 AS p2 FROM h WHERE n - pos <= 10),
    q AS (SELECT session_id, job_id, sum({II_W} * power(0.74::DOUBLE, m - 1 - p2)) AS w FROM qr WHERE job_id IN (SELECT job_id FROM x) GROUP BY ALL),
    per AS (SELECT session_id, job_j AS job_id, sum(q.w * sim) AS score FROM q JOIN sim ON q.job_id = job_i GROUP BY ALL HAVING sum(q.w * sim) > 0)"""
GRID = "cands AS (SELECT DISTINCT job_id FROM a), grid AS (SELECT t.session_id, c.job_id FROM t CROSS JOIN cands c)"
II_SCORE = f"""{GRID}, iis AS (SELECT g.session_id, g.job_id, coalesce(per.score, CASE WHEN g.session_id IN (SELECT session_id FROM q) AND ip.prior IS NOT NULL THEN greatest(ip.prior, f.fallback)
        ELSE coalesce(ip.prior, f.fallback) END) AS score
    FROM grid g LEFT JOIN per USING (session_id, job_id) LEFT JOIN ip ON ip.job_id = g.job_id, (SELECT max(fallback) AS fallback FROM ip) f)"""
II_ALL = [X_H, TVERSKY, II_PRIOR, II_QUERY, II_SCORE]

STORED = "st AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1 AS p2, count(*) OVER (PARTITION BY session_id) AS m FROM h WHERE n - pos <= 8)"
IUF = """uf AS (SELECT job_id, count(DISTINCT session_id) AS df, power(ln((1 + (SELECT count(DISTINCT session_id) FROM st)) / (1 + count(DISTINCT session_id))::DOUBLE + 1), 1.4::DOUBLE) AS iuf FROM st GROUP BY 1)"""
UU_NEAR = """uv AS (SELECT session_id, job_id, iuf / sqrt(sum(iuf * iuf) OVER (PARTITION BY session_id)) AS w FROM (SELECT DISTINCT session_id, job_id FROM st) JOIN uf USING (job_id)),
    us AS (SELECT p.session_id, q.session_id AS neighbor, round(sum(p.w * q.w), 9) AS sim FROM uv p JOIN uv q USING (job_id) GROUP BY ALL HAVING round(sum(p.w * q.w), 9) > 0),
    un AS (SELECT session_id, neighbor, sim FROM us QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY sim DESC, neighbor) <= 83)"""


def _prior(v: float, a: float, targets: bool) -> str:
    more = f"UNION ALL SELECT job_id, {_w(v, a)} FROM t" if targets else ""
    return f"""ps AS (SELECT job_id, sum(w) AS raw FROM (SELECT job_id, {_w(v, a)} AS w FROM h {more}) GROUP BY 1),
    pt AS (SELECT sum(raw) + count(*) AS tot FROM ps), ap AS (SELECT job_id, (raw + 1) / tot AS prior, 1 / tot AS fallback FROM ps, pt)"""


UU_SCORE = f"""ui AS (SELECT session_id AS neighbor, job_id, sum({_w(1.53, 1.59)} * power(0.94::DOUBLE, m - 1 - p2)) AS v FROM st GROUP BY ALL),
    uraw AS (SELECT session_id, job_id, sum(power(sim, 0.87::DOUBLE) * v) AS raw FROM un JOIN ui USING (neighbor) GROUP BY ALL),
    uper AS (SELECT session_id, job_id, raw / max(raw) OVER (PARTITION BY session_id) AS score FROM uraw),
    uus AS (SELECT g.session_id, g.job_id, coalesce(u.score, ap.prior, f.fallback) AS score FROM grid g LEFT JOIN uper u USING (session_id, job_id)
        LEFT JOIN ap ON ap.job_id = g.job_id, (SELECT max(fallback) AS fallback FROM ap) f)"""
UU_ALL = [STORED, IUF, UU_NEAR, _prior(1.53, 1.59, False)]
STACK = f"""{POP_FIT.replace('known AS (SELECT job_id FROM h UNION SELECT job_id FROM t)', 'known AS (SELECT DISTINCT job_id FROM h)')},
    pops2 AS (SELECT g.session_id, g.job_id, coalesce(s, {ALPHA}::DOUBLE) / (SELECT max(s) FROM fit) AS score FROM grid g LEFT JOIN fit USING (job_id)),
    stacked AS (SELECT 'pop' AS model, session_id, job_id, round(score, 9) AS score FROM pops2 UNION ALL SELECT 'ii', session_id, job_id, round(score, 9) FROM iis
        UNION ALL SELECT 'uu', session_id, job_id, round(score, 9) FROM uus)"""
STACK_ALL = [HT, *II_ALL, *UU_ALL, UU_SCORE, WEIGHTED, STACK]
MINMAX = """nm AS (SELECT session_id, job_id, model, CASE WHEN hi - lo < 1e-12 THEN 0 ELSE (score - lo) / (hi - lo) END AS score FROM
    (SELECT *, min(score) OVER (PARTITION BY session_id, model) AS lo, max(score) OVER (PARTITION BY session_id, model) AS hi FROM stacked))"""
#: Training sessions whole, held-out ones without their targets.
REFIT_HT = """v AS (SELECT *, CAST(concat('0x', substr(md5(session_id), 1, 8)) AS BIGINT) % 10 < 3 AS valid FROM a),
    h AS (SELECT session_id, job_id, action, so, pos, n - valid::INT AS n FROM v WHERE NOT valid OR pos < n - 1),
    t AS (SELECT session_id, job_id, action, so FROM v WHERE valid AND pos = n - 1)"""
CAND = "cr AS (SELECT job_id, row_number() OVER (ORDER BY count(*) DESC, job_id) AS cand_rank FROM h GROUP BY 1)"
BLENDED = "bl AS (SELECT session_id, job_id, round(sum(CASE model WHEN 'pop' THEN 0.2::DOUBLE WHEN 'ii' THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END * score), 9) AS score FROM nm GROUP BY ALL), b1 AS (SELECT session_id, job_id, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, cand_rank) AS rank FROM bl JOIN cr USING (job_id) WHERE (session_id, job_id) NOT IN (SELECT session_id, job_id FROM h) QUALIFY rank <= 10)"


def _trials(trials: list[tuple[float, float, float]]) -> str:
    rows = ", ".join(f"({n}, {p}::DOUBLE, {i}::DOUBLE, {u}::DOUBLE)" for n, (p, i, u) in enumerate(trials))
    return f"""tw AS (SELECT * FROM (VALUES {rows}) v(trial, wp, wi, wu)),
    wide AS (SELECT session_id, job_id, sum(CASE WHEN model = 'pop' THEN score END) AS p, sum(CASE WHEN model = 'ii' THEN score END) AS i, sum(CASE WHEN model = 'uu' THEN score END) AS u FROM nm GROUP BY ALL),
    ts AS (SELECT trial, session_id, job_id, cand_rank, round(wp * p + wi * i + wu * u, 9) AS score FROM wide JOIN cr USING (job_id) CROSS JOIN tw
        WHERE (session_id, job_id) NOT IN (SELECT session_id, job_id FROM h)),
    tk AS (SELECT *, row_number() OVER (PARTITION BY trial, session_id ORDER BY score DESC, cand_rank) AS rank FROM ts QUALIFY rank <= 10),
    rr AS (SELECT tw.trial, (SELECT count(*) FROM t) AS sessions, round(coalesce((SELECT sum(1.0::DOUBLE / rank) FROM tk JOIN t USING (session_id) WHERE tk.trial = tw.trial AND tk.job_id = t.job_id), 0) / (SELECT count(*) FROM t), 6) AS mrr FROM tw)"""


def _terms(listing: str, min_df: int, max_df: float, sublinear: bool, limit: int | None) -> str:
    tf = "(1 + ln(tf))" if sublinear else "tf::DOUBLE"
    cut = f"ORDER BY al DESC, term LIMIT {limit}" if limit else ""
    return f"""ls AS ({listing}), tk0 AS (SELECT job_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS ws FROM ls),
    gr AS (SELECT job_id, unnest(list_concat(ws, CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1]) ELSE [] END)) AS term FROM tk0),
    tc AS (SELECT job_id, term, count(*) AS tf FROM gr GROUP BY ALL), nn AS (SELECT count(*) AS nd FROM ls),
    tdf AS (SELECT term, ln((1 + nd) / (1 + df)::DOUBLE) + 1 AS idf FROM (SELECT term, count(*) AS df, sum(tf) AS al, any_value(nd) AS nd FROM tc, nn GROUP BY 1)
        WHERE df >= {min_df} AND df <= {max_df}::DOUBLE * nd {cut}),
    tv AS (SELECT job_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY job_id)) AS w FROM (SELECT job_id, term, {tf} * idf AS x FROM tc JOIN tdf USING (term)))"""


PART_LISTING = "SELECT CAST(p_partkey AS VARCHAR) AS job_id, concat_ws(' ', p_name, p_brand, p_type) AS text FROM part"
PART_TERMS = _terms(PART_LISTING, 2, 0.95, True, 30000)
NEAR_TERMS = _terms(PART_LISTING, 3, 1.0, False, None)
NEAR = """nb AS (SELECT p.job_id AS src, q.job_id AS dst, round(sum(p.w * q.w), 6) AS sim FROM tv p JOIN tv q USING (term) WHERE p.job_id <> q.job_id GROUP BY ALL),
    near50 AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM nb QUALIFY rank <= 50)"""
#: What cleaned listings of all known jobs are: those without a part are empty and count among the listings.
CBF_LISTING = """SELECT j.job_id, trim(regexp_replace(coalesce(concat_ws(' ', p_name, p_brand, p_type), ''), '\\s+', ' ', 'g')) AS text
    FROM (SELECT job_id FROM h UNION SELECT CAST(p_partkey AS VARCHAR) FROM part) j LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = j.job_id"""


def _cbf(pooling: str) -> str:
    decay = "* power(0.62::DOUBLE, m - 1 - p2)" if pooling in ("recency", "max_sim") else ""
    raw = "1.0::DOUBLE" if pooling == "last_item" else f"{_w(1.73, 2.55)} {decay}"
    last = "WHERE p2 = m - 1" if pooling == "last_item" else ""
    if pooling == "max_sim":
        scored = """sp AS (SELECT p.job_id, q.job_id AS cand, sum(p.w * q.w) AS sim FROM tv p JOIN tv q USING (term) GROUP BY ALL),
        cs AS (SELECT session_id, cand AS job_id, max(hw * sim) AS score FROM hw JOIN sp USING (job_id) GROUP BY ALL)"""
    else:
        scored = """pr AS (SELECT session_id, term, sum(hw * w) AS pw FROM hw JOIN tv USING (job_id) GROUP BY ALL),
        cs AS (SELECT session_id, job_id, sum(pw * w) AS score FROM pr JOIN tv USING (term) GROUP BY ALL)"""
    prior = f"""ps AS (SELECT job_id, sum(w) AS raw FROM (SELECT job_id, {_w(1.73, 2.55)} AS w FROM h UNION ALL SELECT CAST(p_partkey AS VARCHAR), 0 FROM part) GROUP BY 1),
    pt AS (SELECT sum(raw) + count(*) AS tot FROM ps), ap AS (SELECT job_id, (raw + 1) / tot AS prior, 1 / tot AS fallback FROM ps, pt)"""
    return _b(HT, _terms(CBF_LISTING, 2, 0.95, True, 30000), f"""kh AS (SELECT session_id, job_id, action, row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1 AS p2, count(*) OVER (PARTITION BY session_id) AS m
        FROM h WHERE job_id IN (SELECT job_id FROM tv)),
    hw AS (SELECT session_id, job_id, raw / sum(raw) OVER (PARTITION BY session_id) AS hw FROM (SELECT session_id, job_id, {raw} AS raw FROM kh {last}))""", scored, prior, GRID, final="""
    SELECT g.session_id, g.job_id, round(coalesce(CASE WHEN cs.score > 0 THEN cs.score END, ap.prior, f.fallback), 6) AS score
    FROM grid g LEFT JOIN cs USING (session_id, job_id) LEFT JOIN ap ON ap.job_id = g.job_id, (SELECT max(fallback) AS fallback FROM ap) f""")  # fmt: skip


#: White space and word characters as ranges of a regular expression.
SPACE = "\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x0B"
WORD = "\\p{L}\\p{M}\\p{N}\\p{Pc}"
SHARE = "sh AS (SELECT job_id, round(count(*)::DOUBLE / (SELECT count(*) FROM a), 9) AS share, row_number() OVER (ORDER BY round(count(*)::DOUBLE / (SELECT count(*) FROM a), 9) DESC, job_id) AS pr FROM a GROUP BY 1)"
CHAIN = "ch AS (SELECT from_job, to_job, round(prob, 9) AS prob FROM tr QUALIFY row_number() OVER (PARTITION BY from_job ORDER BY prob DESC, to_job) <= 50)"
SEEN = f"{LASTJOB}, seen AS (SELECT DISTINCT session_id, job_id FROM h), first AS (SELECT session_id, to_job AS job_id, prob AS score FROM lj JOIN ch ON last_job = from_job WHERE (session_id, to_job) NOT IN (SELECT * FROM seen))"


def _pops(source: str, gate: int, weight: float, cap: int) -> str:
    return f"""have AS (SELECT t.session_id, count(DISTINCT r.job_id) AS have FROM t LEFT JOIN {source} r USING (session_id) GROUP BY 1),
    pp AS (SELECT s.session_id, sh.job_id, have, {weight}::DOUBLE * share AS score, row_number() OVER (PARTITION BY s.session_id ORDER BY pr) AS k
        FROM have s CROSS JOIN sh LEFT JOIN seen x ON x.session_id = s.session_id AND x.job_id = sh.job_id LEFT JOIN {source} y ON y.session_id = s.session_id AND y.job_id = sh.job_id
        WHERE have < {gate} AND x.job_id IS NULL AND y.job_id IS NULL),
    allr AS (SELECT session_id, job_id, score FROM {source} UNION ALL SELECT session_id, job_id, score FROM pp WHERE k + have <= {cap}),
    recs AS (SELECT session_id, job_id, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, job_id) AS rank FROM allr QUALIFY rank <= 10)"""


HYBRID_RECS = _a(HT, ALL_T, CHAIN, SEEN, SHARE, NEAR_TERMS, NEAR, """h1 AS (SELECT t.session_id, count(f.job_id) AS have FROM t LEFT JOIN first f USING (session_id) GROUP BY 1),
    nears AS (SELECT session_id, dst AS job_id, 0.8::DOUBLE * sim AS score FROM h1 JOIN lj USING (session_id) JOIN near50 ON src = last_job WHERE have < 10 AND (session_id, dst) NOT IN (SELECT * FROM seen)),
    rows1 AS (SELECT session_id, job_id, max(score) AS score FROM (SELECT * FROM first UNION ALL SELECT * FROM nears) GROUP BY ALL)""", _pops("rows1", 10, 0.1, 200), final="SELECT session_id, rank, job_id FROM recs")

ORACLE_SQL: dict[str, str] = {
    "interactions_norm": _b(final="SELECT session_id, job_id, action, pos FROM a"),
    "explode_sessions": _a(final="SELECT session_id, job_id, action, pos FROM a"),
    "session_arrays": _a(final="SELECT session_id, string_agg(job_id, ',' ORDER BY pos) AS job_ids, string_agg(action, ',' ORDER BY pos) AS actions FROM a GROUP BY 1"),
    "append_target": _a(final="SELECT session_id, string_agg(job_id, ',' ORDER BY pos) AS job_ids, string_agg(action, ',' ORDER BY pos) AS actions FROM a WHERE n > 1 GROUP BY 1"),
    "session_split": _a(final="SELECT CAST(concat('0x', substr(md5(session_id), 1, 8)) AS BIGINT) % 10 < 3 AS valid, count(*) AS n_rows, count(DISTINCT session_id) AS n_sessions FROM a GROUP BY 1"),
    "targets_norm": _b(HT, final="SELECT session_id, job_id, 'view' AS action FROM t WHERE so % 7 <> 0"),
    "id_coercion": "WITH g AS (SELECT CAST(p_partkey AS VARCHAR) AS k, concat(CASE p_partkey % 3 WHEN 0 THEN '00' WHEN 1 THEN 'x' ELSE '-' END, p_partkey) AS v FROM part) SELECT k, coalesce(CAST(TRY_CAST(v AS BIGINT) AS VARCHAR), v) AS job_id FROM g",
    "last_k_history": _b(HT, final="SELECT session_id, job_id, action, row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1 AS pos FROM h WHERE n - pos <= 5"),
    "action_codes": _b(final="SELECT action, CASE WHEN action = 'apply' THEN 'apply' ELSE 'view' END AS \"binary\", CASE WHEN action = 'apply' THEN 1 ELSE 0 END AS code, count(*) AS n FROM a GROUP BY ALL"),
    "disjoint_union": _b("s AS (SELECT *, CAST(concat('0x', substr(md5(session_id), 1, 8)) AS BIGINT) % 10 < 3 AS valid FROM a), top AS (SELECT max(so) AS mx FROM s WHERE NOT valid AND n > 1)", final="SELECT CASE WHEN valid THEN CAST(so + mx + 1 AS VARCHAR) ELSE session_id END AS session_id, count(*) AS n, arg_max(job_id, pos) AS last_job FROM s, top GROUP BY 1"),
    "vocab_union": _a("j AS (SELECT job_id, 0 AS tier, min(so * 1000 + pos) AS first_pos FROM a GROUP BY 1), p AS (SELECT CAST(p_partkey AS VARCHAR) AS job_id, 1 AS tier, 0 AS first_pos FROM part)", final="SELECT tier, count(*) AS jobs, CAST(min(first_pos) AS BIGINT) AS first_at FROM (SELECT * FROM j UNION ALL SELECT * FROM p WHERE job_id NOT IN (SELECT job_id FROM j)) GROUP BY 1"),
    "transitions": _a(ALL_T, final="SELECT from_job, to_job, n FROM tn"),
    "transition_probs": _a(ALL_T, final="SELECT from_job, to_job, round(prob, 6) AS prob FROM tr"),
    "transition_histogram": _a(ALL_T, final="SELECT n, count(*) AS pairs FROM tn GROUP BY 1"),
    "markov_topk": _a(ALL_T, final="SELECT from_job, to_job, round(prob, 6) AS prob, row_number() OVER (PARTITION BY from_job ORDER BY prob DESC, to_job) AS rank FROM tr QUALIFY rank <= 50"),
    "popular_jobs": _a(ALL_T, final="SELECT job_id, n, rank FROM pop"),
    "job_share": _a(final="SELECT job_id, round(count(*)::DOUBLE / (SELECT count(*) FROM a), 6) AS share FROM a GROUP BY 1"),
    "markov_last_recs": _a(HT, ALL_T, RECS, final="SELECT session_id, rank, job_id FROM recs"),
    "markov_session_recs": _a(HT, ALL_T, _session_recs(False), final="SELECT session_id, rank, job_id FROM recs"),
    "markov_recency_recs": _a(HT, ALL_T, _session_recs(True), final="SELECT session_id, rank, job_id FROM recs"),
    "markov_mrr": _a(HT, ALL_T, RECS, HITS, final=MRR),
    "markov_train_only_mrr": _a(HT, HIST_T, RECS, HITS, final=MRR),
    "k_sweep_mrr": _sweep(),
    "topk_stats": _a(HT, ALL_T, RECS, HITS, final="SELECT count(*) AS sessions, count(hit_rank) AS hits, CAST(sum((hit_rank IS NULL)::INT) AS BIGINT) AS misses, round(avg((hit_rank IS NULL)::INT), 6) AS miss_rate, round(avg(hit_rank), 6) AS mean_rank, min(hit_rank) AS min_rank, max(hit_rank) AS max_rank FROM hit"),
    "cold_rate": _a(HT, HIST_T, LASTJOB, final="SELECT count(*) AS sessions, CAST(sum(cold) AS BIGINT) AS cold, round(avg(cold), 6) AS cold_rate FROM (SELECT (last_job NOT IN (SELECT from_job FROM tn))::INT AS cold FROM lj)"),
    "trailing_views": _b(HT, VIEWS, final="SELECT * FROM tv"),
    "action_by_nview": _shares("n_views"),
    "action_by_trail": _shares("trail_view"),
    "last_action_acc": _a(HT, LAST_ACTION, final="SELECT count(*) AS \"rows\", round(avg((y_true = y_pred)::INT), 6) AS accuracy FROM la"),
    "action_report": _a(HT, LAST_ACTION, "c AS (SELECT y_true AS label, count(*) AS support, sum((y_true = y_pred)::INT) AS ok FROM la GROUP BY 1), p AS (SELECT y_pred AS label, count(*) AS claims FROM la GROUP BY 1)", final="SELECT label, support, round(coalesce(ok::DOUBLE / claims, 0), 6) AS \"precision\", round(ok::DOUBLE / support, 6) AS recall, round(coalesce(2.0 * (ok::DOUBLE / claims) * (ok::DOUBLE / support) / nullif(ok::DOUBLE / claims + ok::DOUBLE / support, 0), 0), 6) AS f1 FROM c LEFT JOIN p USING (label)"),
    "pop_global": _pop(COUNTS),
    "pop_session_weighted": _pop(WEIGHTED),
    "pop_session_weighted_targets": _pop(WEIGHTED_T),
    "pop_trending": _pop(TREND.format(name="raw")),
    "pop_hybrid": _pop(HYBRID),
    "session_item_weights": _a(HT, X_HT, final="SELECT session_id, job_id, round(w, 6) AS w FROM x"),
    "ii_tversky": _a(HT, X_HT, TVERSKY, final="SELECT job_i, job_j, sim FROM sim"),
    "ii_cosine": _a(HT, X_HT, COSINE, final="SELECT job_i, job_j, sim FROM sim"),
    "ii_priors": _a(HT, X_HT, II_PRIOR, final="SELECT job_id, round(prior, 6) AS prior, round(fallback, 6) AS fallback FROM ip"),
    "ii_scores": _b(HT, *II_ALL, final="SELECT session_id, job_id, round(score, 6) AS score FROM iis"),
    "ii_recs_mrr": _a(HT, X_H, TVERSKY, II_PRIOR, II_QUERY, """un AS (SELECT t.session_id, ip.job_id, coalesce(per.score, greatest(ip.prior, ip.fallback)) AS score FROM t CROSS JOIN ip
        LEFT JOIN per ON per.session_id = t.session_id AND per.job_id = ip.job_id LEFT JOIN (SELECT DISTINCT session_id, job_id FROM h) s ON s.session_id = t.session_id AND s.job_id = ip.job_id WHERE s.job_id IS NULL),
        recs AS (SELECT session_id, job_id, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, job_id) AS rank FROM un QUALIFY rank <= 10)""", HITS, final=MRR),
    "iuf": _a(HT, STORED, IUF, final="SELECT job_id, df, round(iuf, 6) AS iuf FROM uf"),
    "uu_neighbors": _b(HT, STORED, IUF, UU_NEAR, final="SELECT session_id, neighbor, sim FROM un"),
    "uu_scores": _b(HT, GRID, *UU_ALL, UU_SCORE, final="SELECT session_id, job_id, round(score, 6) AS score FROM uus"),
    "uu_scores_boost": _b(HT, GRID, *UU_ALL, UU_SCORE.replace("m - 1 - p2))", "m - 1 - p2) * CASE WHEN p2 >= greatest(0, m - 2) THEN 1.32::DOUBLE ELSE 1 END * CASE WHEN p2 = m - 1 THEN 1.27::DOUBLE ELSE 1 END)"), final="SELECT session_id, job_id, round(score, 6) AS score FROM uus"),
    "action_priors": _a(HT, _prior(1.53, 1.59, True), final="SELECT job_id, round(prior, 6) AS prior, round(fallback, 6) AS fallback FROM ap"),
    "mf_ratings": _a(HT, f"mr AS (SELECT session_id, job_id, sum(s) AS raw_signal, count(*) AS events FROM (SELECT session_id, job_id, {_w(0.76, 1.48)} * power(0.95::DOUBLE, n - 1 - pos) AS s FROM h WHERE n - pos <= 7 UNION ALL SELECT session_id, job_id, {_w(0.76, 1.48)} FROM t) GROUP BY ALL)", final="SELECT session_id, job_id, round(greatest(least(ln(1 + greatest(raw_signal, 0)), 2.47::DOUBLE), 1e-6), 6) AS rating, round(raw_signal, 6) AS raw_signal, events FROM mr"),
    "mf_priors": _a(HT, f"mr AS (SELECT session_id, job_id, sum(s) AS raw FROM (SELECT session_id, job_id, {_w(0.76, 1.48)} * power(0.95::DOUBLE, n - 1 - pos) AS s FROM h WHERE n - pos <= 7 UNION ALL SELECT session_id, job_id, {_w(0.76, 1.48)} FROM t) GROUP BY ALL), sp AS (SELECT job_id, sum(greatest(least(ln(1 + raw), 2.47::DOUBLE), 1e-6)) AS support FROM mr GROUP BY 1), sa AS (SELECT sum(support) + count(*) + 1 AS under FROM sp)", final="SELECT job_id, round(support, 6) AS support, round((support + 1) / under, 6) AS prior, round(1 / under, 6) AS fallback FROM sp, sa"),
    "gnn_edges": _b("s AS (SELECT session_id, job_id AS src, lead(job_id) OVER w AS dst, lead(action) OVER w AS action FROM a WINDOW w AS (PARTITION BY session_id ORDER BY pos))", final=f"SELECT session_id, src, dst, round(sum({_w(1.0, 1.19208)}), 6) AS w FROM s WHERE dst IS NOT NULL GROUP BY ALL"),
    "gnn_nodes": _b(final="SELECT session_id, job_id, row_number() OVER (PARTITION BY session_id ORDER BY min(pos)) - 1 AS alias FROM a GROUP BY session_id, job_id"),
    "gnn_examples": _b(final="SELECT session_id, pos AS t, string_agg(job_id, ',') OVER w AS prefix_items, string_agg(action, ',') OVER w AS prefix_actions, job_id AS pos_item FROM a WINDOW w AS (PARTITION BY session_id ORDER BY pos ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) QUALIFY pos > 0"),
    "gnn_priors": _a(HT, f"g AS (SELECT job_id, sum(w) + 1e-6 AS raw FROM (SELECT session_id, job_id, max({_w(1.0, 1.19208)}) AS w FROM h GROUP BY ALL UNION ALL SELECT session_id, job_id, {_w(1.0, 1.19208)} FROM t) GROUP BY 1), gm AS (SELECT max(raw) AS top FROM g)", final="SELECT job_id, round(raw / top, 6) AS prior, round(1e-6 / top, 6) AS fallback FROM g, gm"),
    "gnn_sampler_pop": _a("c AS (SELECT job_id, count(DISTINCT session_id) AS k FROM a GROUP BY 1)", final="SELECT job_id, round(k::DOUBLE / (SELECT sum(k) FROM c), 6) AS share FROM c"),
    "text_clean": "WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS job_id, trim(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(8203), ' '), '_+x000D_+', ' ', 'g'), '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x0B]+', ' ', 'g')) AS b FROM documents) SELECT job_id, md5(b) AS basic, CAST(length(strip_accents(b)) AS BIGINT) AS chars FROM c",
    "text_modes": f"WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS job_id, lower(coalesce(text, '')) AS t, lower(regexp_replace(replace(coalesce(text, ''), chr(8203), ' '), '_+x000D_+', ' ', 'g')) AS b FROM documents) SELECT job_id, md5(trim(regexp_replace(regexp_replace(b, '[^{WORD}{SPACE}]', ' ', 'g'), '[{SPACE}]+', ' ', 'g'))) AS normalized, md5(trim(regexp_replace(regexp_replace(t, '[^{WORD}{SPACE}/+-]', ' ', 'g'), '[{SPACE}]+', ' ', 'g'))) AS listing FROM c",
    "text_sections": """WITH c AS (SELECT CAST(p_partkey AS VARCHAR) AS job_id, p_partkey % 4 AS m, CASE m WHEN 0 THEN concat(p_name, ' [SEP] ', p_type) WHEN 1 THEN p_name WHEN 2 THEN p_type ELSE concat(p_name, ' - ', p_brand) END AS section FROM part)
    SELECT job_id, section, trim(regexp_replace(regexp_replace(lower(section), '[^a-z0-9_ ]', ' ', 'g'), ' +', ' ', 'g')) AS cleaned FROM c""",
    "text_tokens": "SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents) GROUP BY 1",
    "tfidf": f"WITH {PART_TERMS} SELECT job_id, term, round(w, 6) AS w FROM tv",
    "text_neighbors": f"WITH {NEAR_TERMS}, {NEAR} SELECT src, dst, sim, rank FROM near50",
    "cbf_recency": _cbf("recency"),
    "cbf_mean": _cbf("mean"),
    "cbf_max_sim": _cbf("max_sim"),
    "cbf_last_item": _cbf("last_item"),
    "hybrid_recs": HYBRID_RECS,
    "text_only_recs": _a(HT, LASTJOB, NEAR_TERMS, NEAR, final="SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY sim DESC, dst) AS rank, dst AS job_id FROM lj JOIN near50 ON src = last_job WHERE (session_id, dst) NOT IN (SELECT session_id, job_id FROM h) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY sim DESC, dst) <= 10"),
    "markov_only_mrr": _a(HT, ALL_T, CHAIN, SEEN, SHARE, _pops("first", 500, 0.01, 500), HITS, final=MRR),
    "norm_minmax": _b(*STACK_ALL, MINMAX, final="SELECT session_id, job_id, model, round(score, 6) AS score FROM nm"),
    "norm_rank": _b(*STACK_ALL, final="SELECT session_id, job_id, model, round(CASE WHEN c = 1 THEN 1 ELSE 1 - (r - 1)::DOUBLE / (c - 1) END, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY session_id, model ORDER BY score DESC, job_id) AS r, count(*) OVER (PARTITION BY session_id, model) AS c FROM stacked)"),
    "ensemble_recs": _b(*STACK_ALL, MINMAX, CAND, BLENDED, final="SELECT session_id, rank, job_id FROM b1"),
    "weight_grid_mrr": _b(*STACK_ALL, MINMAX, CAND, _trials([(0.2, 0.5, 0.3), (1, 0, 0), (0, 1, 0), (0, 0, 1), (0.25, 0.25, 0.5)]), final="SELECT trial, sessions, mrr FROM rr"),
    "model_breakdown": _b(*STACK_ALL, MINMAX, CAND, _trials([(0, 1, 0), (1, 0, 0), (0, 0, 1)]), final="SELECT CASE trial WHEN 0 THEN 'ii' WHEN 1 THEN 'pop' ELSE 'uu' END AS model, sessions, mrr FROM rr"),
    "challenge_score": _a(HT, ALL_T, RECS, HITS, MRR_CTE, LAST_ACTION, "ac AS (SELECT round(avg((y_true = y_pred)::INT), 6) AS accuracy FROM la)", final="SELECT mrr, accuracy, round(mrr * 0.7::DOUBLE + accuracy * 0.3::DOUBLE, 6) AS score FROM m, ac"),
    "submission_blend": _b(REFIT_HT, *STACK_ALL[1:], MINMAX, CAND, BLENDED, LAST_ACTION, final="SELECT session_id, y_pred AS action, string_agg(job_id, ',' ORDER BY rank) AS job_id FROM la JOIN b1 USING (session_id) GROUP BY ALL"),
    "submission_checks": _a(HT, ALL_T, RECS, final="SELECT count(*) AS asked, count(n) AS answered, CAST(sum((coalesce(n, 0) <> 10)::INT) AS BIGINT) AS not_k, 0::BIGINT AS null_jobs FROM t LEFT JOIN (SELECT session_id, count(job_id) AS n FROM recs GROUP BY 1) USING (session_id)"),
    "submission": _a(HT, ALL_T, RECS, LAST_ACTION, """sh AS (SELECT job_id, row_number() OVER (ORDER BY count(*) DESC, job_id) AS pr FROM a GROUP BY 1),
    out AS (SELECT session_id, job_id FROM recs UNION SELECT session_id, job_id FROM h), hv AS (SELECT t.session_id, count(r.job_id) AS have FROM t LEFT JOIN recs r USING (session_id) GROUP BY 1),
    mo AS (SELECT s.session_id, have + row_number() OVER (PARTITION BY s.session_id ORDER BY pr) AS rank, sh.job_id FROM (SELECT * FROM hv WHERE have < 10) s CROSS JOIN (SELECT * FROM sh WHERE pr <= (SELECT max(c) FROM (SELECT count(*) AS c FROM out GROUP BY session_id)) + 10) sh
        LEFT JOIN out x ON x.session_id = s.session_id AND x.job_id = sh.job_id WHERE x.job_id IS NULL QUALIFY rank <= 10),
    fl AS (SELECT session_id, rank, job_id FROM recs UNION ALL SELECT session_id, rank, job_id FROM mo)""", final="SELECT session_id, y_pred AS action, string_agg(fl.job_id, ',' ORDER BY rank) AS job_id FROM la JOIN fl USING (session_id) GROUP BY ALL"),
}
