"""The SQL of the queries in catalog.py, for DuckDB."""

from __future__ import annotations

LINES = """(SELECT l_returnflag AS corpus, l_orderkey::VARCHAR AS entity, metric, value FROM
    (SELECT l_returnflag, l_orderkey, unnest(['l_quantity', 'l_discount', 'l_tax', 'l_extendedprice']) AS metric, unnest([l_quantity, l_discount, l_tax, l_extendedprice]) AS value FROM lineitem))"""

_JUDGED = """count(*) AS n, round_even(median(value)::DOUBLE, 3) AS median, round_even(quantile_cont(value, 0.1)::DOUBLE, 3) AS lo, round_even(quantile_cont(value, 0.9)::DOUBLE, 3) AS hi,
    round_even(min(value)::DOUBLE, 3) AS min, round_even(max(value)::DOUBLE, 3) AS max, round_even(CASE WHEN avg(value) = 0 THEN 9.9 ELSE stddev_pop(value) / avg(value) END, 3) AS cv,
    CASE WHEN count(*) < 20 THEN 'insufficient' WHEN (CASE WHEN avg(value) = 0 THEN 9.9 ELSE stddev_pop(value) / avg(value) END) <= 0.3 THEN 'constraint' ELSE 'free' END AS verdict"""


def judged(rows: str, keys: str) -> str:
    return f"SELECT {keys}, {_JUDGED} FROM {rows} WHERE value IS NOT NULL GROUP BY {keys}"


def layered(rows: str, keys: str) -> str:
    """CTEs d, g, lim and lay: (keys, value, n, layer)."""
    on = " AND ".join(f"g.{k.strip()} IS NOT DISTINCT FROM lim.{k.strip()}" for k in keys.split(","))
    return f"""d AS (SELECT {keys}, value, count(*) AS n FROM {rows} WHERE value IS NOT NULL GROUP BY {keys}, value),
        g AS (SELECT *, value - lag(value) OVER (PARTITION BY {keys} ORDER BY value) AS gap FROM d),
        lim AS (SELECT {keys}, CASE WHEN sum(n) >= 4 THEN 10 * median(gap) END AS most FROM g GROUP BY {keys}),
        lay AS (SELECT g.*, (1 + sum(CASE WHEN gap > most THEN 1 ELSE 0 END) OVER (PARTITION BY {", ".join("g." + k.strip() for k in keys.split(","))} ORDER BY value))::BIGINT AS layer FROM g JOIN lim ON {on})"""


def derived_tables(rows: str, entities: str) -> str:
    """CTEs o to drv: the judged parts and the derived rules of (corpus, entity, metric, value) rows."""
    k = "corpus, metric"
    return f"""o AS MATERIALIZED (SELECT * FROM {rows} WHERE value IS NOT NULL), {layered("o", k)},
        sz AS (SELECT {k}, layer, sum(n) AS size FROM lay GROUP BY {k}, layer),
        p AS (SELECT o.*, CASE WHEN size >= 20 THEN layer ELSE 0 END AS part FROM o JOIN lay USING (corpus, metric, value) JOIN sz USING (corpus, metric, layer)),
        j AS ({judged("p", k + ", part")}),
        parts AS (SELECT * REPLACE (CASE WHEN part = 0 THEN 'mixed' ELSE verdict END AS verdict) FROM j),
        whole AS ({judged("p", k)}),
        best AS (SELECT * FROM parts WHERE verdict = 'constraint' QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY n DESC, median, part) = 1),
        cov AS (SELECT {k}, count(*) AS n_all, count(DISTINCT entity) AS n_entities FROM p GROUP BY {k}),
        np AS (SELECT {k}, count(*) AS n_parts, max(part) AS top FROM parts GROUP BY {k}),
        e AS ({entities}),
        drv AS (SELECT w.corpus, w.metric, {", ".join(f"CASE WHEN NOT (n_parts = 1 AND top > 0) AND b.n IS NOT NULL THEN b.{c} ELSE w.{c} END AS {c}" for c in ("n", "median", "lo", "hi", "min", "max", "cv", "verdict"))},
               n_all, CASE WHEN n_parts = 1 AND top > 0 THEN 0 ELSE n_parts END AS n_layers, n_entities, n_entities_all,
               (CASE WHEN NOT (n_parts = 1 AND top > 0) AND b.n IS NOT NULL THEN b.verdict ELSE w.verdict END) = 'constraint' AS is_rule
        FROM whole w LEFT JOIN best b USING (corpus, metric) JOIN cov USING (corpus, metric) JOIN np USING (corpus, metric) JOIN e USING (corpus)),
        bands AS (SELECT corpus, metric, row_number() OVER (PARTITION BY {k} ORDER BY p.median, part) AS layer, p.* EXCLUDE (corpus, metric, part) FROM parts p JOIN np USING (corpus, metric) WHERE NOT (n_parts = 1 AND top > 0)
                  UNION ALL SELECT corpus, metric, 1, d.* EXCLUDE (corpus, metric, n_all, n_layers, n_entities, n_entities_all, is_rule) FROM drv d WHERE n_layers = 0)"""


def derived(rows: str, entities: str) -> str:
    return f"WITH {derived_tables(rows, entities)} SELECT * FROM drv"


def intervals(rows: str, keys: str) -> str:
    """A query (keys, n, median, ci_lo, ci_hi), the median not rounded."""
    at = lambda h: f"l[floor({h})::INT + 1] + (l[ceil({h})::INT + 1] - l[floor({h})::INT + 1]) * ({h} - floor({h}))"
    ends = {"ci_lo": "greatest((n - 1) / 2 - 1.959964::DOUBLE * sqrt(n) / 2, 0)", "ci_hi": "least((n - 1) / 2 + 1.959964::DOUBLE * sqrt(n) / 2, n - 1)"}
    return f"""SELECT {keys}, n, median, {", ".join(f"CASE WHEN n >= 3 THEN round_even({at(h)}, 4) END AS {c}" for c, h in ends.items())}
        FROM (SELECT {keys}, count(*) AS n, median(value)::DOUBLE AS median, list_sort(list(value::DOUBLE)) AS l FROM {rows} WHERE value IS NOT NULL GROUP BY {keys})"""


def resampled(rows: str, key: str, replicates: int, seed: int) -> str:
    """A query (key, n, median, ci_lo, ci_hi) by weights from the bits of hashes."""
    ones = " + ".join(f"bit_count(('0x' || substr(x, {8 * w + 1}, 8))::BIGINT >> (32 - greatest(least(n - {32 * w}, 32), 0))::BIGINT)::BIGINT" for w in range(8))
    at = lambda q: f"l[floor({q}::DOUBLE * (len(l) - 1))::INT + 1] + (l[ceil({q}::DOUBLE * (len(l) - 1))::INT + 1] - l[floor({q}::DOUBLE * (len(l) - 1))::INT + 1]) * ({q}::DOUBLE * (len(l) - 1) - floor({q}::DOUBLE * (len(l) - 1)))"
    return f"""WITH v AS (SELECT {key}, value::DOUBLE AS value, count(*)::BIGINT AS n FROM {rows} WHERE value IS NOT NULL GROUP BY ALL),
        b AS (SELECT *, (sum(n) OVER (PARTITION BY {key} ORDER BY value) - n)::BIGINT AS before, (sum(n) OVER (PARTITION BY {key}))::BIGINT AS total FROM v),
        s AS (SELECT {key}, value, n, CASE WHEN before + n - 1 < (total - 1) / 2 - 4 * sqrt(total) THEN -1 WHEN before > (total - 1) / 2 + 4 * sqrt(total) THEN total ELSE before END AS place FROM b WHERE total >= 3),
        t AS (SELECT {key}, place, sum(n)::BIGINT AS n, CASE WHEN place < 0 THEN max(value) ELSE min(value) END AS value FROM s GROUP BY {key}, place),
        h AS (SELECT *, sha256('{seed}:' || replicate || ':' || place || ':' || coalesce({key}::VARCHAR, '')) AS x FROM t CROSS JOIN (SELECT unnest(range(0, {replicates})) AS replicate)),
        o AS (SELECT {key}, replicate, place, n, value, {ones} AS ones FROM h),
        w AS (SELECT {key}, replicate, place, value, CASE WHEN n <= 256 THEN 16 * ones ELSE 8 * n + floor(sqrt(n) * (ones - 128))::BIGINT END AS weight FROM o),
        c AS (SELECT *, sum(weight) OVER (PARTITION BY {key}, replicate ORDER BY place) AS up_to, sum(weight) OVER (PARTITION BY {key}, replicate) AS whole FROM w),
        m AS (SELECT {key}, replicate, (min(value) FILTER (WHERE 2 * up_to >= whole) + min(value) FILTER (WHERE 2 * up_to > whole)) / 2 AS m FROM c GROUP BY {key}, replicate),
        l AS (SELECT {key}, list_sort(list(m)) AS l FROM m WHERE m IS NOT NULL GROUP BY {key}),
        g AS (SELECT {key}, count(*) AS n, round_even(median(value)::DOUBLE, 4) AS median FROM {rows} WHERE value IS NOT NULL GROUP BY {key})
        SELECT g.*, round_even({at("0.025")}, 4) AS ci_lo, round_even({at("0.975")}, 4) AS ci_hi FROM g LEFT JOIN l ON g.{key} IS NOT DISTINCT FROM l.{key}"""


HOURLY = """h0 AS (SELECT event_type, floor(epoch(ts) / 3600)::BIGINT AS "at", count(*) AS value FROM events GROUP BY ALL),
        h1 AS (SELECT event_type, unnest(range(min("at"), max("at") + 1)) AS "at" FROM h0 GROUP BY event_type),
        h AS (SELECT h1.event_type, h1."at", coalesce(value, 0)::DOUBLE AS value FROM h1 LEFT JOIN h0 USING (event_type, "at"))"""

#: Blocks out of line items, as orders_as_posters() makes them.
BLOCKS = """bl AS (SELECT l_orderkey, l_linenumber, l_quantity::INT AS q, l_quantity, (l_partkey % 400)::INT AS x1, (l_suppkey % 100 * 5)::INT AS y1,
            (l_partkey % 400)::INT + 4 * l_quantity::INT AS x2, (l_suppkey % 100 * 5)::INT + 2 * l_quantity::INT AS y2 FROM lineitem)"""

OBSERVED = f"""{BLOCKS},
        po AS (SELECT 'c' || (l_orderkey % 3) AS corpus, l_orderkey::VARCHAR AS entity, l_orderkey AS k, min(x1) AS rx1, min(y1) AS ry1, max(x2) AS rx2, max(y2) AS ry2, count(*) AS nb,
               max(CASE WHEN l_quantity > 0 THEN l_quantity END) / min(CASE WHEN l_quantity > 0 THEN l_quantity END) AS cr, sum(greatest(x2 - x1, 0) * greatest(y2 - y1, 0)::DOUBLE) / (1000 * 1200) AS ta FROM bl GROUP BY l_orderkey),
        fx AS (SELECT l_orderkey, CASE WHEN x1 - lag(x1) OVER (PARTITION BY l_orderkey ORDER BY x1) <= 2 THEN 0 ELSE 1 END AS new FROM bl),
        ar AS (SELECT l_orderkey AS k, sum(new) / count(*) AS v FROM fx GROUP BY l_orderkey HAVING count(*) >= 3),
        ob AS (
            SELECT 'c' || (l_orderkey % 3) AS corpus, l_orderkey::VARCHAR AS entity, 'lead_over_cap' AS metric, (q + l_linenumber) / q::DOUBLE AS value FROM bl WHERE l_linenumber >= 3 AND l_linenumber <> 5 AND q <> 0
            UNION ALL SELECT 'c' || (l_orderkey % 3), l_orderkey::VARCHAR, 'gap_px', l_linenumber::DOUBLE FROM bl WHERE l_linenumber >= 3 AND l_linenumber <> 5
            UNION ALL SELECT 'c' || (l_orderkey % 3), l_orderkey::VARCHAR, 'asc_over_xh', q / (q - l_linenumber % 2)::DOUBLE FROM bl WHERE q - l_linenumber % 2 > 0
            UNION ALL SELECT corpus, entity, 'align_ratio', v FROM po JOIN ar USING (k)
            UNION ALL SELECT corpus, entity, 'margin_left', rx1 / 1000.0::DOUBLE FROM po WHERE k % 10 <> 0
            UNION ALL SELECT corpus, entity, 'margin_right', (1000 - rx2) / 1000.0::DOUBLE FROM po WHERE k % 10 <> 0
            UNION ALL SELECT corpus, entity, 'margin_top', ry1 / 1200.0::DOUBLE FROM po WHERE k % 10 <> 0
            UNION ALL SELECT corpus, entity, 'margin_bottom', (1200 - ry2) / 1200.0::DOUBLE FROM po WHERE k % 10 <> 0
            UNION ALL SELECT corpus, entity, 'n_columns', (k % 4)::DOUBLE FROM po WHERE k % 4 <> 0
            UNION ALL SELECT corpus, entity, 'n_blocks', nb::DOUBLE FROM po
            UNION ALL SELECT corpus, entity, 'cap_range', cr FROM po WHERE nb >= 2
            UNION ALL SELECT corpus, entity, 'text_area', ta FROM po WHERE k % 10 <> 0)"""

#: CTE fi: what check() finds in orders as layouts against the rules of all orders.
CHECKED = f"""{OBSERVED}, {derived_tables("(SELECT 'all' AS corpus, * EXCLUDE (corpus) FROM ob)", "SELECT 'all' AS corpus, 0 AS n_entities_all")},
        bs AS (SELECT * FROM bands WHERE metric = 'lead_over_cap'),
        mx AS (SELECT max(layer) AS top FROM bs),
        lo AS (SELECT l_orderkey AS k, l_orderkey::VARCHAR AS layout, CASE WHEN l_orderkey % 3 = 0 THEN 1 WHEN l_orderkey % 50 = 1 THEN 99 END AS asked FROM lineitem GROUP BY l_orderkey),
        bb AS (SELECT lo.*, row_number() OVER () AS n, bl.q AS h, 30 / bl.q::DOUBLE AS r FROM lo JOIN bl ON bl.l_orderkey = lo.k WHERE bl.q > 0 AND (asked IS NULL OR asked <= (SELECT top FROM mx))),
        cd AS (SELECT bb.*, bs.layer, bs.verdict = 'constraint' AND r BETWEEN lo AND hi AS fit, bs.verdict <> 'constraint' AND r BETWEEN min AND max AS seen FROM bb JOIN bs ON asked IS NULL OR layer = asked),
        jd AS (SELECT k, layout, asked, n, h, r, min(CASE WHEN fit THEN layer END) AS f, min(CASE WHEN seen THEN layer END) AS s, count(*) AS c FROM cd GROUP BY ALL),
        am AS (SELECT *, coalesce((SELECT median FROM bs WHERE layer = asked), (SELECT median FROM drv WHERE metric = 'lead_over_cap' AND is_rule), (SELECT median FROM bs WHERE layer = 1)) AS aim FROM jd),
        me AS (SELECT l_orderkey AS k, unnest(['cap_range', 'n_blocks', 'margin_left', 'margin_right', 'margin_top', 'margin_bottom', 'text_area']) AS metric,
                      unnest([CASE WHEN count(*) FILTER (WHERE q > 0) >= 2 THEN max(q) / min(CASE WHEN q > 0 THEN q END)::DOUBLE END, count(*)::DOUBLE, min(x1) / 1000::DOUBLE, (1000 - max(x2)) / 1000::DOUBLE, min(y1 + 10 - q) / 1200::DOUBLE, (1200 - max(y1 + 40)) / 1200::DOUBLE,
                              CASE WHEN sum((x2 - x1) * (30 + q)) <> 0 THEN sum((x2 - x1) * (30 + q))::DOUBLE / (1000 * 1200) END]) AS v FROM bl GROUP BY l_orderkey),
        fi AS (SELECT layout, 'all' AS corpus, 'lead_over_cap' AS rule, CASE WHEN f IS NOT NULL THEN 'accepted' WHEN s IS NOT NULL THEN 'held' ELSE 'violation' END AS status, round_even(r, 2) AS value, CASE WHEN f IS NULL AND s IS NULL THEN round_even(h * aim, 1) END AS fix, coalesce(f, s) AS layer FROM am
            UNION ALL SELECT layout, 'all', 'overlap', 'violation', 30 - h, NULL, NULL FROM am WHERE 30 - h < 1
            UNION ALL SELECT layout, 'all', metric, CASE WHEN verdict = 'constraint' AND NOT v BETWEEN lo AND hi THEN 'violation' WHEN v BETWEEN lo AND hi THEN 'in_band' WHEN v BETWEEN min AND max THEN 'observed' ELSE 'outside' END, round_even(v, 4),
                      CASE WHEN verdict = 'constraint' AND NOT v BETWEEN lo AND hi THEN median END, NULL FROM lo l JOIN me USING (k) JOIN drv USING (metric) WHERE v IS NOT NULL AND (asked IS NULL OR asked <= (SELECT top FROM mx))
            UNION ALL SELECT layout, 'all', 'no_such_layer', 'error', NULL, NULL, NULL FROM lo WHERE asked > (SELECT top FROM mx))"""

_INK = """px AS (SELECT DISTINCT img, p // 12 AS y, p % 12 AS x FROM (SELECT c_custkey // 60 AS img, ((round(c_acctbal * 100)::BIGINT % 144) + 144) % 144 AS p FROM customer))"""


def components(near: str, first: int = 0) -> str:
    """CTEs px, w and co: the components of the pictures' pixels from row `first` on, by walks from every pixel."""
    return f"""RECURSIVE {_INK.replace("px AS", "p0 AS")}, px AS (SELECT * FROM p0 WHERE y >= {first}),
        w AS (SELECT img, x * 100 + y AS k, x, y FROM px UNION SELECT w.img, w.k, q.x, q.y FROM w JOIN px q ON q.img = w.img AND {near}),
        lb AS (SELECT img, x, y, min(k) AS lab FROM w GROUP BY ALL),
        co AS (SELECT img, count(*) AS area, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2 FROM lb GROUP BY img, lab)"""


_SIDES, _CORNERS = "abs(q.x - w.x) + abs(q.y - w.y) = 1", "abs(q.x - w.x) <= 1 AND abs(q.y - w.y) <= 1"

#: Line items as lines of text.
_ORDER_LINES = """ol AS (SELECT l_orderkey, (l_suppkey % 4)::DOUBLE AS xs, l_suppkey % 4 + l_quantity::DOUBLE AS xe FROM lineitem)"""


def median_cut(rounds: int) -> str:
    """CTEs b0 to b`rounds`: the box of each colour (file, r, g, b, n, box) of table hist after so many splits."""
    steps = ["b0 AS (SELECT *, 0 AS box FROM hist)"]
    for i in range(1, rounds + 1):
        b = f"b{i - 1}"
        steps.append(f"""s{i} AS (SELECT file, box, sum(n)::BIGINT AS al, max(r) - min(r) AS dr, max(g) - min(g) AS dg, max(b) - min(b) AS db FROM {b} GROUP BY file, box),
        c{i} AS (SELECT file, box, al, CASE WHEN dr >= greatest(dg, db) THEN 0 WHEN dg >= db THEN 1 ELSE 2 END AS axis FROM s{i} WHERE greatest(dr, dg, db) > 0 QUALIFY row_number() OVER (PARTITION BY file ORDER BY al DESC, box) = 1),
        v{i} AS (SELECT x.*, CASE axis WHEN 0 THEN r WHEN 1 THEN g ELSE b END AS v, c.al, c.box IS NOT DISTINCT FROM x.box AS mine FROM {b} x LEFT JOIN c{i} c ON c.file = x.file),
        u{i} AS (SELECT file, v, al, sum(sum(n)) OVER o AS upto, lead(v) OVER o AS more FROM v{i} WHERE mine GROUP BY file, v, al WINDOW o AS (PARTITION BY file ORDER BY v)),
        a{i} AS (SELECT file, coalesce(min(v) FILTER (WHERE 2 * upto >= al), max(v)) AS cut FROM u{i} WHERE more IS NOT NULL GROUP BY file),
        b{i} AS MATERIALIZED (SELECT file, r, g, b, n, CASE WHEN mine AND v > cut THEN {i} ELSE box END AS box FROM v{i} LEFT JOIN a{i} USING (file))""")
    return ", ".join(steps)


def turn(angle: str) -> str:
    """Cosine and sine of an angle in 65 536ths, and the size of the plate of a picture of w by h."""
    return f"round_even(cos(radians({angle})) * 65536, 0)::BIGINT AS c, round_even(sin(radians({angle})) * 65536, 0)::BIGINT AS s"


#: Line items as measured text boxes, and what was read in them at each of three turns.
_BOXES = """f AS (SELECT l_orderkey AS img, l_linenumber AS box, l_quantity::DOUBLE * 4 AS w, (l_partkey % 21 - 10) * 0.5::DOUBLE AS angle, l_suppkey FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_linenumber)),
        rd AS (SELECT f.*, t.i, t.turn, (l_suppkey * (i + 3) % 11)::DOUBLE * (i + 4) AS score FROM f CROSS JOIN (VALUES (0, 0), (1, 90), (2, -90)) t(i, turn))"""

ORACLE_SQL = {
    "judge_doc_length_by_lang": judged("(SELECT coalesce(lang, 'none') AS corpus, n_chars::DOUBLE AS value FROM documents)", "corpus"),
    "coverage_by_corpus": """
        WITH e AS (SELECT coalesce(lang, 'none') AS corpus, d.doc_id, max((quality IS NOT NULL)::INT) AS has FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL)
        SELECT corpus, sum(has)::BIGINT AS n_entities, count(*) AS n_entities_all, round_even(sum(has) / count(*), 6) AS share FROM e GROUP BY corpus""",
    "gap_layers_events": f"WITH {layered('events', 'event_type')} SELECT event_type, layer, sum(n)::BIGINT AS n, min(value) AS lowest, max(value) AS highest FROM lay GROUP BY ALL",
    "gap_layers_prices": f"WITH r AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS value FROM lineitem), {layered('r', 'l_returnflag, l_linestatus')} SELECT l_returnflag, l_linestatus, layer, sum(n)::BIGINT AS n, min(value) AS lowest, max(value) AS highest FROM lay GROUP BY ALL",
    "derive_rules_lineitem": derived(LINES, "SELECT l_returnflag AS corpus, count(DISTINCT l_orderkey) AS n_entities_all FROM lineitem GROUP BY 1"),
    "representative_layer": f"""
        WITH r AS (SELECT o_orderpriority, o_totalprice AS value FROM orders), {layered("r", "o_orderpriority")},
        s AS (SELECT o_orderpriority, layer, sum(n)::BIGINT AS n, min(value) AS lowest, max(value) AS highest FROM lay GROUP BY ALL)
        SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, layer) = 1""",
    "align_clusters": """
        WITH e AS (SELECT user_id, floor(epoch(ts))::BIGINT AS "at" FROM events), f AS (SELECT *, "at" - lag("at") OVER (PARTITION BY user_id ORDER BY "at") AS gap FROM e)
        SELECT user_id, count(*) AS n, count(*) FILTER (WHERE gap IS NULL OR gap > 21600) AS n_clusters FROM f GROUP BY user_id""",
    "cap_range_orders": "SELECT o_custkey, count(*) AS n, round_even(max(o_totalprice) / min(o_totalprice), 6) AS cap_range FROM orders WHERE o_totalprice > 0 GROUP BY o_custkey HAVING count(*) >= 2",
    "margins_like_ratio": """
        WITH w AS (SELECT *, min(p_retailprice) OVER b AS least, max(p_retailprice) OVER b AS most FROM part WINDOW b AS (PARTITION BY p_brand))
        SELECT p_partkey, round_even((p_retailprice - least) / (most - least), 6) AS margin_left, round_even((most - p_retailprice) / (most - least), 6) AS margin_right FROM w WHERE most > least""",
    "leading_gaps": """
        WITH o AS (SELECT o_custkey, floor(epoch(o_orderdate) / 86400)::BIGINT AS day FROM orders), g AS (SELECT o_custkey, day - lag(day) OVER (PARTITION BY o_custkey ORDER BY day) AS gap FROM o)
        SELECT o_custkey, count(*) AS n, round_even(median(gap)::DOUBLE, 6) AS median_gap, (max(gap) - min(gap))::DOUBLE AS reach, count(*) < 2 OR max(gap) - min(gap) <= 1 AS regular
        FROM g WHERE gap IS NOT NULL GROUP BY o_custkey""",
    "position_vs_band": f"""
        WITH b AS ({judged("(SELECT c_mktsegment AS corpus, c_acctbal AS value FROM customer)", "corpus")})
        SELECT c_custkey, corpus, CASE WHEN c_acctbal BETWEEN lo AND hi THEN 'in_band' WHEN c_acctbal BETWEEN min AND max THEN 'observed' ELSE 'outside' END AS position
        FROM customer JOIN b ON corpus = c_mktsegment""",
    "range_join_layers": """
        WITH b(band, verdict, lo, hi, least, most) AS (VALUES (1, 'constraint', 950.0, 1100.0, 900.0, 1150.0), (2, 'mixed', 1200.0, 1300.0, 1150.0, 1400.0), (3, 'constraint', 1090.0, 1250.0, 1000.0, 1300.0), (4, 'free', 1500.0, 1600.0, NULL, NULL)),
        c AS (SELECT p_partkey, p_retailprice, min(CASE WHEN verdict = 'constraint' AND p_retailprice BETWEEN lo::DOUBLE AND hi::DOUBLE THEN band END) AS a,
              min(CASE WHEN verdict <> 'constraint' AND p_retailprice BETWEEN coalesce(least, lo)::DOUBLE AND coalesce(most, hi)::DOUBLE THEN band END) AS h FROM part CROSS JOIN b GROUP BY ALL)
        SELECT p_partkey, p_retailprice, CASE WHEN a IS NOT NULL THEN 'accepted' WHEN h IS NOT NULL THEN 'held' ELSE 'violation' END AS status, coalesce(a, h) AS band FROM c""",
    "shadow_antijoin": """
        SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem o WHERE o.l_orderkey = a.l_orderkey
            AND a.l_quantity <= 0.45::DOUBLE * o.l_quantity AND a.l_extendedprice <= 0.45::DOUBLE * o.l_extendedprice)""",
    "overlap_antijoin": """
        WITH s AS (SELECT event_id AS row_id, user_id, floor(epoch(ts))::BIGINT AS lo, floor(epoch(ts))::BIGINT + 3600 AS hi, event_type, value FROM events),
        c AS (SELECT user_id, lo - 43200 AS lo, hi + 43200 AS hi FROM s WHERE value > 50 AND event_type = 'purchase')
        SELECT row_id, user_id, lo, hi FROM s WHERE event_type <> 'purchase' AND NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = s.user_id AND c.lo < s.hi AND s.lo < c.hi)""",
    "corpus_pairs_separated": """
        WITH b AS (SELECT l_returnflag || '-' || l_linestatus || '-' || (l_linenumber % 3) AS corpus, quantile_cont(l_quantity + 40 * (l_linenumber % 3), 0.025) AS lo, quantile_cont(l_quantity + 40 * (l_linenumber % 3), 0.975) AS hi FROM lineitem GROUP BY 1)
        SELECT a.corpus AS one, b.corpus AS other, a.hi < b.lo OR b.hi < a.lo AS apart FROM b a JOIN b ON a.corpus < b.corpus""",
    "metric_catalog_left_join": f"""
        WITH r AS ({judged(LINES, "metric")})
        SELECT metric, n, median, coalesce(verdict, 'no_value') AS verdict FROM (SELECT unnest(['l_quantity', 'l_discount', 'l_tax', 'l_extendedprice', 'l_weight']) AS metric) LEFT JOIN r USING (metric)""",
    "golden_diff": """
        WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS after FROM part WHERE p_partkey % 7 <> 0)
        SELECT p_partkey, p_retailprice AS before, after FROM part FULL JOIN n USING (p_partkey) WHERE p_retailprice IS DISTINCT FROM after""",
    "top_labels": "SELECT row_number() OVER (ORDER BY n DESC, label) AS rank, label, n FROM (SELECT p_brand AS label, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1) ORDER BY n DESC, label LIMIT 6",
    "place_grid": """
        WITH g AS (SELECT p_brand AS layout, p_partkey::VARCHAR AS id, (p_partkey % 100)::DOUBLE AS y, p_size::DOUBLE AS h, p_partkey % 4 AS n,
                   greatest(1.0::DOUBLE, round_even(min(CASE WHEN p_size > 0 THEN p_size::DOUBLE END) OVER (PARTITION BY p_brand) * 1.5::DOUBLE, 0)) AS grid FROM part),
        k AS (SELECT *, CASE WHEN h > 0 THEN greatest(greatest(1.0::DOUBLE, round_even(h * 1.5::DOUBLE / grid, 0)), ceil((h + 1) / grid)) * grid END AS lead FROM g)
        SELECT layout, id, grid, lead, round_even(lead / h, 3) AS ratio, n AS n_lines, CASE WHEN n > 0 THEN round_even(y + h + (n - 1) * lead, 1) END AS last FROM k""",
    "polarity_threshold": """
        WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS value FROM embeddings),
        q AS (SELECT vec_id, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM v GROUP BY vec_id)
        SELECT vec_id, round_even(p5, 6) AS p5, round_even(p50, 6) AS p50, round_even(p95, 6) AS p95, p95 - p50 > p50 - p5 AS inverted,
               round_even(0.72::DOUBLE * CASE WHEN p95 - p50 > p50 - p5 THEN 255.0::DOUBLE - p50 ELSE p50 END, 6) AS level FROM q""",
    "ink_profile_runs": f"""
        WITH {HOURLY}, l AS (SELECT event_type, greatest(quantile_cont(value, 0.05), coalesce(0.5::DOUBLE * quantile_cont(value, 0.9) FILTER (WHERE value > 0), 0)) AS level FROM h GROUP BY event_type),
        a AS (SELECT h.*, "at" - row_number() OVER (PARTITION BY h.event_type ORDER BY "at") AS run FROM h JOIN l USING (event_type) WHERE value > level)
        SELECT event_type, min("at") AS first, max("at") AS last, sum(value) AS total FROM a GROUP BY event_type, run HAVING max("at") - min("at") + 1 >= 2""",
    "autocorr_peak": f"""
        WITH {HOURLY}, c AS (SELECT event_type, "at", value - avg(value) OVER (PARTITION BY event_type) AS d FROM h),
        p AS (SELECT a.event_type, b."at" - a."at" AS lag, sum(a.d * b.d) AS s FROM c a JOIN c b ON a.event_type = b.event_type AND b."at" BETWEEN a."at" AND a."at" + 24 GROUP BY ALL)
        SELECT p.event_type, p.lag, round_even(p.s / z.s, 6) AS r FROM p JOIN p z ON z.event_type = p.event_type AND z.lag = 0 WHERE z.s > 0""",
    "step_bands": f"""
        WITH {HOURLY}, m AS (SELECT event_type, "at", median(value) OVER a AS a, count(*) OVER a AS na, median(value) OVER b AS b, count(*) OVER b AS nb FROM h
            WINDOW a AS (PARTITION BY event_type ORDER BY "at" ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING), b AS (PARTITION BY event_type ORDER BY "at" ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
        SELECT event_type, "at", abs(a - b) AS step FROM m WHERE na = 12 AND nb = 12 AND abs(a - b) > 0""",
    "flatten_json_props": """
        WITH k AS (SELECT event_id, props, unnest(json_keys(props)) AS path FROM events WHERE props IS NOT NULL)
        SELECT event_id, path, json_extract_string(props, '$.' || path) AS value FROM k""",
    "line_metrics_explode": "SELECT conv_id, count(*) AS n_lines, sum(length(text))::BIGINT AS total, min(turn) AS first FROM conversations WHERE role = 'assistant' AND length(text) > 0 GROUP BY conv_id",
    "upsert_last_wins": "SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, page_id, url FROM pages QUALIFY row_number() OVER (PARTITION BY regexp_extract(url, '://([^/?#]*)', 1) ORDER BY page_id DESC) = 1",
    "observe_orders_as_posters": f"""
        WITH {OBSERVED} SELECT corpus, metric, count(*) AS n, count(DISTINCT entity) AS n_posters, round_even(avg(value), 6) AS mean, round_even(min(value), 6) AS least, round_even(max(value), 6) AS most FROM ob GROUP BY ALL""",
    "derive_orders_as_posters": f"WITH {OBSERVED} SELECT * FROM ({derived('ob', 'SELECT corpus, count(*) AS n_entities_all FROM po GROUP BY corpus')})",
    "layers_lineitem": f"WITH {derived_tables(LINES, 'SELECT l_returnflag AS corpus, count(DISTINCT l_orderkey) AS n_entities_all FROM lineitem GROUP BY 1')} SELECT * FROM bands WHERE metric = 'l_extendedprice'",
    "bootstrap_median_ci": f"SELECT * REPLACE (round_even(median, 4) AS median) FROM ({intervals('events', 'event_type')})",
    "resampled_median_events": resampled("events", "event_type", 1000, 7),
    "compare_corpora": f"""
        WITH q AS (SELECT * FROM {LINES} WHERE metric = 'l_quantity'), {layered("q", "corpus, metric")},
        r AS (SELECT corpus, metric, min(value) AS a, max(value) AS b FROM lay GROUP BY corpus, metric, layer QUALIFY row_number() OVER (PARTITION BY corpus, metric ORDER BY sum(n) DESC, layer) = 1),
        k AS (SELECT q.* FROM q JOIN r USING (corpus, metric) WHERE value BETWEEN a AND b UNION ALL SELECT * FROM {LINES} WHERE metric <> 'l_quantity'),
        ci AS ({intervals("k", "corpus, metric")}),
        pr AS (SELECT x.metric, x.corpus AS one, y.corpus AS other, coalesce(x.ci_hi < y.ci_lo OR y.ci_hi < x.ci_lo, false) AS apart FROM ci x JOIN ci y ON x.metric = y.metric AND x.corpus < y.corpus),
        pp AS (SELECT metric, count(*) FILTER (WHERE apart) AS n_separated, count(*) AS n_pairs, coalesce(string_agg(one || '/' || other, ',' ORDER BY one || '/' || other) FILTER (WHERE apart), '') AS separated FROM pr GROUP BY metric)
        SELECT metric, count(*) AS n_corpora, CASE WHEN min(median) > 0 THEN round_even(max(median) / min(median), 3) END AS spread, any_value(n_separated) AS n_separated, any_value(n_pairs) AS n_pairs, any_value(separated) AS separated
        FROM ci JOIN pp USING (metric) GROUP BY metric""",
    "check_layout_totals": f"""
        WITH {CHECKED}
        SELECT layout, corpus, count(*) FILTER (WHERE status = 'violation') AS n_violations, count(*) FILTER (WHERE status = 'held') AS n_held, count(*) FILTER (WHERE status IN ('violation', 'error')) = 0 AS ok FROM fi GROUP BY layout, corpus""",
    "check_layout_findings": f"""
        WITH {CHECKED}
        SELECT rule, status, count(*) AS n, count(DISTINCT layout) AS n_layouts, round_even(sum(value), 1) AS total, round_even(sum(fix), 3) AS fixes, min(layer) AS low_layer, max(layer) AS high_layer FROM fi GROUP BY rule, status""",
    "place_text_orders": f"""
        WITH {OBSERVED}, {derived_tables("(SELECT 'all' AS corpus, * EXCLUDE (corpus) FROM ob)", "SELECT 'all' AS corpus, 0 AS n_entities_all")},
        bs AS (SELECT *, row_number() OVER (ORDER BY layer) AS nr FROM bands WHERE metric = 'lead_over_cap'), ad AS (SELECT * FROM drv WHERE metric = 'lead_over_cap' AND is_rule),
        rq AS (SELECT l_orderkey, CASE WHEN l_orderkey % 5 = 0 THEN 1 WHEN l_orderkey % 5 = 1 THEN 99 END AS layer, CASE WHEN l_orderkey % 4 = 0 THEN 12.0::DOUBLE WHEN l_orderkey % 40 = 1 THEN 0.0::DOUBLE END AS gl,
                      min(CASE WHEN l_quantity > 3 THEN l_quantity END) AS least FROM lineitem GROUP BY l_orderkey),
        bd AS (SELECT rq.*, coalesce(f.median, CASE WHEN rq.layer IS NULL THEN coalesce((SELECT median FROM ad), (SELECT median FROM bs WHERE nr = 1)) END) AS m, coalesce(f.lo, CASE WHEN rq.layer IS NULL THEN coalesce((SELECT lo FROM ad), (SELECT lo FROM bs WHERE nr = 1)) END) AS lo,
               coalesce(f.hi, CASE WHEN rq.layer IS NULL THEN coalesce((SELECT hi FROM ad), (SELECT hi FROM bs WHERE nr = 1)) END) AS hi, coalesce(f.verdict, CASE WHEN rq.layer IS NULL THEN coalesce((SELECT verdict FROM ad), (SELECT verdict FROM bs WHERE nr = 1)) END) AS v FROM rq LEFT JOIN bs f ON f.nr = rq.layer),
        gd AS (SELECT *, coalesce(gl, CASE WHEN least IS NOT NULL THEN greatest(1.0::DOUBLE, round_even(least * m, 0)) END) AS grid FROM bd),
        er AS (SELECT *, CASE WHEN layer IS NOT NULL AND m IS NULL THEN 'no_such_layer' WHEN grid IS NULL THEN 'no_cap_height' WHEN grid <= 0 THEN 'bad_grid' END AS error FROM gd),
        pl AS (SELECT er.*, l_linenumber AS n, l_linenumber % 4 AS nl, CASE WHEN l_quantity > 3 THEN l_quantity END AS h, (l_partkey % 100)::DOUBLE AS y FROM er JOIN lineitem USING (l_orderkey) WHERE error IS NULL),
        kk AS (SELECT *, CASE WHEN h > 0 THEN greatest(greatest(1.0::DOUBLE, round_even(h * m / grid, 0)), ceil((h + 1) / grid))::BIGINT END AS multiple FROM pl)
        SELECT l_orderkey::VARCHAR AS layout, n::VARCHAR AS id, grid, multiple * grid AS lead, multiple, round_even(multiple * grid / h, 6) AS ratio, CASE WHEN nl > 0 THEN round_even(y + h + (nl - 1) * multiple * grid, 1) END AS last,
               (multiple * grid / h BETWEEN lo AND hi)::VARCHAR AS in_band, concat_ws(',', CASE WHEN h IS NULL THEN 'no_cap_height' END, CASE WHEN NOT (multiple * grid / h BETWEEN lo AND hi) THEN 'outside_band' END, CASE WHEN v <> 'constraint' THEN 'not_adopted' END) AS notes, NULL::VARCHAR AS error FROM kk
        UNION ALL SELECT l_orderkey::VARCHAR, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '', error FROM er WHERE error IS NOT NULL""",
    "style_card_orders": f"""
        WITH {OBSERVED}, {derived_tables("ob", "SELECT corpus, count(*) AS n_entities_all FROM po GROUP BY corpus")},
        pc AS (SELECT corpus, count(*) AS n_posters, count(*) FILTER (WHERE k % 10 = 0) AS n_rotated FROM po GROUP BY corpus),
        mt AS (SELECT unnest(['lead_over_cap', 'gap_px', 'asc_over_xh', 'align_ratio', 'margin_left', 'margin_right', 'margin_top', 'margin_bottom', 'n_columns', 'cap_range', 'text_area', 'n_blocks', 'ground_share', 'n_colors', 'saturation', 'value', 'gray_share', 'cap_ratio', 'descender', 'margin_const']) AS metric)
        SELECT pc.corpus, mt.metric, coalesce(verdict, CASE WHEN mt.metric IN ('cap_ratio', 'descender', 'margin_const') THEN 'blocked' ELSE 'no_value' END) AS verdict, n, median, CASE WHEN verdict IS NOT NULL THEN greatest(n_layers, 1) END AS n_layers, n_all, n_entities, n_posters,
               CASE WHEN verdict IS NOT NULL AND mt.metric IN ('margin_left', 'margin_right', 'margin_top', 'margin_bottom', 'text_area') THEN n_rotated END AS n_excluded
        FROM pc CROSS JOIN mt LEFT JOIN drv ON drv.corpus = pc.corpus AND drv.metric = mt.metric""",
    "ascender_lines": f"""
        WITH {OBSERVED} SELECT entity, count(*) AS n, round_even(sum(value), 6) AS total FROM ob WHERE metric = 'asc_over_xh' GROUP BY entity""",
    "box_shadows": f"""
        WITH {BLOCKS} SELECT l_orderkey AS ord, x1, y1, x2, y2 FROM bl a WHERE NOT EXISTS (SELECT 1 FROM bl o WHERE o.l_orderkey = a.l_orderkey AND (o.x2 - o.x1) * (o.y2 - o.y1) > (a.x2 - a.x1) * (a.y2 - a.y1)
            AND a.y2 - a.y1 <= 0.45::DOUBLE * (o.y2 - o.y1) AND a.x2 - a.x1 <= 0.45::DOUBLE * (o.x2 - o.x1) AND a.x1 >= o.x1 - 5 AND a.y1 >= o.y1 - 5 AND a.x2 <= o.x2 + 5 AND a.y2 <= o.y2 + 5)""",
    "seeded_boxes": """
        WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, max(l_quantity) AS q FROM lineitem GROUP BY ALL),
        b AS (SELECT l_suppkey, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS row_id, q, l_partkey % 400 * 10 AS x1, l_orderkey % 500 * 10 AS y1, (l_partkey % 400 * 10 + q)::BIGINT AS x2, (l_orderkey % 500 * 10 + q)::BIGINT AS y2 FROM r)
        SELECT l_suppkey, row_id, x1, y1, x2, y2 FROM b WHERE q > 25 AND NOT EXISTS (SELECT 1 FROM b o WHERE o.q <= 25 AND o.l_suppkey = b.l_suppkey AND o.x1 < b.x2 AND b.x1 < o.x2 AND o.y1 < b.y2 AND b.y1 < o.y2)""",
    "ink_components": f"WITH {components(_SIDES)} SELECT * FROM co",
    "ink_components_diagonal": f"WITH {components(_CORNERS)} SELECT * FROM co",
    "ink_strata": f"""
        WITH {components(_SIDES)}, b AS (SELECT img, coalesce(median(y2 - y1) FILTER (WHERE y2 - y1 >= 2), 0)::DOUBLE AS body FROM co GROUP BY img)
        SELECT img, body, count(*) AS n, count(*) FILTER (WHERE body > 0 AND y2 - y1 > 1.5::DOUBLE * body) AS n_tall FROM co JOIN b USING (img) GROUP BY img, body""",
    "ink_shape": f"""
        WITH {components(_SIDES)}, k AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY area DESC) AS nr FROM co WHERE area >= 3)
        SELECT img, sum(area)::BIGINT AS area, count(*) AS n_comp, round_even(max(area) / sum(area)::DOUBLE, 3) AS top1, round_even(sum(area) FILTER (WHERE nr <= 3) / sum(area)::DOUBLE, 3) AS top3,
               round_even(median(area / ((x2 - x1) * (y2 - y1))::DOUBLE), 3) AS solidity FROM k GROUP BY img""",
    "ink_closed": f"""
        WITH {_INK}, o AS (SELECT unnest(range(-1, 2)) AS d), n AS (SELECT a.d AS dx, b.d AS dy FROM o a CROSS JOIN o b),
        g AS (SELECT DISTINCT img, y + dy AS y, x + dx AS x FROM px CROSS JOIN n WHERE x + dx BETWEEN 0 AND 11 AND y + dy BETWEEN 0 AND 11)
        SELECT g.img, g.y, g.x FROM g JOIN g o ON o.img = g.img AND abs(o.x - g.x) <= 1 AND abs(o.y - g.y) <= 1 GROUP BY ALL HAVING count(*) = 9""",
    "line_baselines": f"""
        WITH {HOURLY}, d AS (SELECT event_type, "at" // 24 AS day, "at" % 24 AS r, value FROM h),
        m AS (SELECT event_type, day, median(value) FILTER (WHERE value > 0) AS half FROM d GROUP BY ALL),
        l AS (SELECT d.event_type, d.day, 0.5::DOUBLE * median(value) AS lev FROM d JOIN m USING (event_type, day) WHERE value > 0 AND value >= half GROUP BY ALL)
        SELECT d.event_type, d.day, max(r) FILTER (WHERE value > 0 AND value >= lev) + 1 AS base FROM d LEFT JOIN l USING (event_type, day) GROUP BY ALL""",
    "align_axis": f"""
        WITH {_ORDER_LINES}, s AS (SELECT l_orderkey, count(*) AS n, round_even(stddev_pop(xs), 9) AS l, round_even(stddev_pop(xe), 9) AS r, round_even(stddev_pop((xs + xe) / 2), 9) AS c FROM ol GROUP BY l_orderkey),
        t AS (SELECT *, CASE WHEN l <= r AND l <= c THEN 'left' WHEN r <= c THEN 'right' ELSE 'center' END AS name, least(l, r, c) AS best FROM s)
        SELECT l_orderkey, CASE WHEN n >= 2 THEN CASE WHEN best <= 3 THEN name ELSE 'none' END END AS align, round_even(l, 2) AS "left", round_even(r, 2) AS "right", round_even(c, 2) AS center FROM t""",
    "color_levels_parts": """
        WITH p AS (SELECT p_brand AS file, greatest(p_partkey % 256, p_size * 5, p_partkey % 7) AS hi, least(p_partkey % 256, p_size * 5, p_partkey % 7) AS lo FROM part)
        SELECT file, round_even(median(CASE WHEN hi > 0 THEN (hi - lo) / hi::DOUBLE ELSE 0 END), 4) AS saturation, round_even(median(hi / 255::DOUBLE), 4) AS value FROM p GROUP BY file""",
    "color_cells_parts": """
        WITH p AS (SELECT p_brand AS file, p_partkey % 256 AS r, p_size * 5 AS g, p_partkey % 7 AS b FROM part),
        c AS (SELECT file, r // 64 * 16 + g // 64 * 4 + b // 64 AS cell, count(*) AS n, count(*) FILTER (WHERE CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b)::DOUBLE ELSE 0 END < 0.12::DOUBLE) AS gray FROM p GROUP BY ALL),
        s AS (SELECT *, n / sum(n) OVER (PARTITION BY file) AS share FROM c)
        SELECT file, round_even(max(share), 4) AS ground_share, count(*) FILTER (WHERE share > 0.02::DOUBLE) AS n_colors, round_even(sum(gray) / sum(n), 4) AS gray_share FROM s GROUP BY file""",
    "autocorr_first_peak": f"""
        WITH {HOURLY}, c AS (SELECT event_type, "at", value - avg(value) OVER (PARTITION BY event_type) AS d FROM h),
        p AS (SELECT a.event_type, b."at" - a."at" AS lag, sum(a.d * b.d) AS s FROM c a JOIN c b ON a.event_type = b.event_type AND b."at" BETWEEN a."at" AND a."at" + 24 GROUP BY ALL),
        r AS (SELECT p.event_type, p.lag, p.s / z.s AS r FROM p JOIN p z ON z.event_type = p.event_type AND z.lag = 0 WHERE z.s > 0),
        w AS (SELECT *, lag(r) OVER o AS before, lead(r) OVER o AS after FROM r WINDOW o AS (PARTITION BY event_type ORDER BY lag))
        SELECT event_type, min(lag) AS lag, round_even(arg_min(r, lag), 6) AS r FROM w WHERE lag >= 2 AND r > before AND r >= after AND r > 0 GROUP BY event_type""",
    "text_columns_orders": """
        WITH d AS (SELECT o_orderpriority AS p, floor(epoch(o_orderdate) / 86400)::BIGINT AS day, count(*)::DOUBLE AS value FROM orders WHERE o_custkey % 20 = 0 GROUP BY ALL),
        e AS (SELECT p, min(day) AS a, max(day) - min(day) + 1 AS size, quantile_cont(value, 0.9) AS peak FROM d GROUP BY p),
        f AS (SELECT p, day - a AS pos, size, day - a - lag(day - a) OVER (PARTITION BY p ORDER BY day) - 1 AS empty FROM d JOIN e USING (p) WHERE value > 0.13::DOUBLE * peak),
        g AS (SELECT *, sum(CASE WHEN empty IS NULL OR empty >= 6 THEN 1 ELSE 0 END) OVER (PARTITION BY p ORDER BY pos) AS nr FROM f),
        k AS (SELECT p, nr, min(pos) AS a, max(pos) AS b FROM g GROUP BY p, nr)
        SELECT p AS o_orderpriority, a AS first, b + 1 AS "end" FROM k WHERE b + 1 - a > 10""",
    "line_marks_customers": f"""
        WITH {components(_CORNERS)}, rw AS (SELECT img, y, count(*) AS v FROM px GROUP BY ALL),
        t AS (SELECT img, min(y) AS x_top FROM (SELECT *, max(v) OVER (PARTITION BY img) AS most FROM rw) WHERE v >= 0.5::DOUBLE * most GROUP BY img),
        m AS (SELECT t.img, x_top, min(CASE WHEN y2 > x_top THEN y1 END) AS body, min(CASE WHEN y2 <= x_top THEN y1 END) AS mark_top, count(*) FILTER (WHERE y2 <= x_top) AS n_mark FROM t JOIN co USING (img) GROUP BY ALL)
        SELECT img, x_top, CASE WHEN x_top - body >= 2 THEN body END AS cap, mark_top, n_mark, CASE WHEN body IS NULL THEN 'none' WHEN x_top - body >= 2 THEN 'ascender' ELSE 'x_only' END AS kind FROM m""",
    "dark_edges_customers": f"""
        WITH {_INK}, s AS (SELECT img, unnest(['left', 'right', 'top', 'bottom']) AS side, unnest([count(*) FILTER (WHERE x = 0), count(*) FILTER (WHERE x = 11), count(*) FILTER (WHERE y = 0), count(*) FILTER (WHERE y = 11)]) / 12::DOUBLE AS share FROM px GROUP BY img)
        SELECT img, side, round_even(share, 3) AS share FROM s WHERE share > 0.35::DOUBLE""",
    "trimmed_customers": f"""
        WITH {_INK}, c AS (SELECT img, y, count(*) / 12::DOUBLE AS v FROM px GROUP BY ALL), i AS (SELECT DISTINCT img, unnest(range(12)) AS y FROM px),
        l AS (SELECT img, list(coalesce(v, 0) ORDER BY y) AS a, list(coalesce(v, 0) ORDER BY y DESC) AS b FROM i LEFT JOIN c USING (img, y) GROUP BY img),
        d AS (SELECT *, coalesce(list_position([v <= 0.4::DOUBLE for v in a], true) - 1, 12) AS da, coalesce(list_position([v <= 0.4::DOUBLE for v in b], true) - 1, 12) AS db FROM l),
        f AS (SELECT *, a[da + 1 : da + 3] AS fa, b[db + 1 : db + 3] AS fb FROM d)
        SELECT img, CASE WHEN da > 0 THEN da + coalesce(list_position([v <= 0 for v in fa], true) - 1, len(fa)) ELSE 0 END AS first, 12 - CASE WHEN db > 0 THEN db + coalesce(list_position([v <= 0 for v in fb], true) - 1, len(fb)) ELSE 0 END AS end FROM f""",
    "skew_lines": """
        WITH b AS (SELECT l_orderkey AS img, l_quantity * 4 AS dx, l_quantity * 4 * (l_orderkey % 7 - 3 + l_linenumber % 2 * 0.2::DOUBLE) / 60 AS dy FROM lineitem),
        a AS (SELECT img, sqrt(dx * dx + dy * dy) AS w, degrees(atan2(dy, dx)) AS angle FROM b WHERE sqrt(dx * dx + dy * dy) >= 40),
        t AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY img ORDER BY w DESC, angle) <= 8),
        m AS (SELECT img, median(angle) AS m, stddev_pop(angle) AS s FROM t GROUP BY img)
        SELECT img, round_even(CASE WHEN abs(m) >= 1 AND abs(m) <= 10 AND s <= 2 THEN m ELSE 0 END, 6) AS angle FROM m""",
    "gradient_embeddings": """
        WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) AS n FROM embeddings),
        p AS (SELECT vec_id, i * 4 // n AS y, i % (n // 4) AS x, coalesce((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 0) AS v FROM v WINDOW w AS (PARTITION BY vec_id)),
        g AS (SELECT *, coalesce((coalesce(lead(v) OVER r, v) - coalesce(lag(v) OVER r, v)) / nullif((lead(v) OVER r IS NOT NULL)::INT + (lag(v) OVER r IS NOT NULL)::INT, 0), 0) AS gx,
                     coalesce((coalesce(lead(v) OVER c, v) - coalesce(lag(v) OVER c, v)) / nullif((lead(v) OVER c IS NOT NULL)::INT + (lag(v) OVER c IS NOT NULL)::INT, 0), 0) AS gy
              FROM p WINDOW r AS (PARTITION BY vec_id, y ORDER BY x), c AS (PARTITION BY vec_id, x ORDER BY y))
        SELECT vec_id, round_even(avg(sqrt(gx * gx + gy * gy)), 6) AS gradient FROM g GROUP BY vec_id""",
    "photo_verdicts_events": """
        WITH e AS (SELECT value / 20000 AS d, event_id % 2 = 0 AND event_id % 5 IN (0, 2, 4) AND user_id % 3 <> 0 AS seen FROM events)
        SELECT CASE WHEN seen AND d >= 0.0026::DOUBLE THEN 'yes' WHEN NOT seen AND d < 0.0018::DOUBLE THEN 'no' ELSE 'unknown' END AS verdict, count(*) AS n FROM e GROUP BY 1""",
    "on_grid_orders": """
        WITH b AS (SELECT l_orderkey, list_sort(list((l_linenumber * 15 + l_partkey % 3)::DOUBLE)) AS l FROM lineitem GROUP BY l_orderkey),
        r AS (SELECT l_orderkey, l, unnest(l) AS b, l[1] AS f, len(l) AS n, list_median([l[i + 1] - l[i] for i in range(1, len(l))]) AS step FROM b),
        k AS (SELECT *, n >= 3 AND abs(15 - step) <= 2 AS fit, round_even((b - f) / 15, 0) AS k FROM r),
        p AS (SELECT *, avg(b - k * 15) OVER (PARTITION BY l_orderkey) AS phase FROM k),
        g AS (SELECT l_orderkey, b, fit, CASE WHEN fit THEN round_even(phase + k * 15, 0) ELSE b END AS g FROM p)
        SELECT l_orderkey, CASE WHEN coalesce(bool_or(fit), false) THEN 15.0::DOUBLE END AS lead, round_even(CASE WHEN coalesce(bool_or(fit), false) THEN avg(abs(g - b)) ELSE 0 END, 6) AS residual, min(g) AS first, max(g) AS last FROM g GROUP BY l_orderkey""",
    "tallies_orders": """
        WITH p AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
        SELECT 'c' || (k % 3) AS corpus, count(*) AS n_posters, count(*) FILTER (WHERE k % 10 = 0) AS n_rotated, count(*) FILTER (WHERE k % 4 <> 0) AS n_judged, count(*) FILTER (WHERE k % 4 = 1) AS n_yes, count(*) FILTER (WHERE k % 4 = 2) AS n_no, count(*) FILTER (WHERE k % 4 = 3) AS n_unknown
        FROM p GROUP BY 1""",
    "text_blocks": """
        WITH RECURSIVE ol AS (SELECT l_orderkey AS k, (l_linenumber * 20 + l_partkey % 13)::DOUBLE AS base, (l_suppkey % 4)::DOUBLE AS xs, l_suppkey % 4 + l_quantity::DOUBLE AS xe, (5 + l_suppkey % 6)::DOUBLE AS xh FROM lineitem),
        t AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY base, xs, xe, xh) AS i FROM ol),
        u AS (SELECT k, median(base - prev) AS usual FROM (SELECT k, base, lag(base) OVER (PARTITION BY k ORDER BY i) AS prev FROM t) GROUP BY k),
        p AS (SELECT b.*, b.base - a.base > 1.5::DOUBLE * usual OR NOT (abs(a.xs - b.xs) <= 2 OR abs(a.xe - b.xe) <= 2 OR abs(a.xs + a.xe - b.xs - b.xe) <= 4) AS parted, c.xh AS next FROM t b JOIN t a ON a.k = b.k AND a.i = b.i - 1 JOIN u ON u.k = b.k LEFT JOIN t c ON c.k = b.k AND c.i = b.i + 1),
        s AS (SELECT k, i, 0 AS block, [xh] AS sizes FROM t WHERE i = 1
              UNION ALL SELECT k, i, block + new::INT, CASE WHEN new THEN [xh] ELSE list_append(sizes, xh) END
              FROM (SELECT k, i, xh, block, sizes, parted OR (abs(m - xh) > 2 AND abs(m - xh) > 0.25::DOUBLE * least(m, xh) AND coalesce(abs(m - next) > 2 AND abs(m - next) > 0.25::DOUBLE * least(m, next), false)) AS new
                    FROM (SELECT p.*, s.block, s.sizes, list_median(s.sizes) AS m FROM s JOIN p ON p.k = s.k AND p.i = s.i + 1)))
        SELECT s.k AS l_orderkey, block, count(*) AS n, min(xs) AS x1, min(base - 12) AS y1, max(xe) AS x2, max(base) AS y2, 12.0::DOUBLE AS height, round_even(median(xh), 1) AS xh FROM s JOIN t ON t.k = s.k AND t.i = s.i GROUP BY s.k, block""",
    "sharpest_lines": f"""
        WITH i AS (SELECT DISTINCT l_suppkey AS img, l_linenumber * 10 + floor(l_partkey % 160 * (l_suppkey % 9 - 4) / 40::DOUBLE)::BIGINT + 20 AS y, l_partkey % 160 AS x FROM lineitem),
        k AS (SELECT k, k * 0.5::DOUBLE - 15 AS angle, {turn("k * 0.5::DOUBLE - 15")} FROM (SELECT unnest(range(0, 61)) AS k)),
        p AS (SELECT *, ceil((abs(s) * 160 + abs(c) * 120) / 65536::DOUBLE)::BIGINT AS h FROM i CROSS JOIN k),
        r AS (SELECT img, k, angle, h, count(*) AS n FROM p GROUP BY img, k, angle, h, floor((c * (2 * y + 1 - 120) - s * (2 * x + 1 - 160) + h * 65536) / 131072::DOUBLE)),
        t AS (SELECT img, k, angle, (sum(n * n) * h)::BIGINT AS score, sum(n)::BIGINT AS n FROM r GROUP BY img, k, angle, h)
        SELECT img, angle, round_even(sqrt(greatest(score::DOUBLE / n / n - 1, 0)), 6) AS sharpness FROM t QUALIFY row_number() OVER (PARTITION BY img ORDER BY score DESC, k) = 1""",
    "turned_embeddings": f"""
        WITH px AS (SELECT vec_id, i * 4 // n AS y, i % (n // 4) AS x, ((floor(v * 1000)::BIGINT % 256) + 256) % 256 AS gray FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) AS n FROM embeddings)),
        z AS (SELECT vec_id, len(embedding) // 4 AS w, 4 AS h, {turn("vec_id % 10 * 15 - 45")} FROM embeddings),
        g AS (SELECT *, ceil((abs(c) * w + abs(s) * h) / 65536::DOUBLE)::BIGINT AS nw, ceil((abs(s) * w + abs(c) * h) / 65536::DOUBLE)::BIGINT AS nh FROM z),
        t AS (SELECT *, unnest(range(0, nh)) AS ty FROM g), t2 AS (SELECT *, unnest(range(0, nw)) AS tx FROM t),
        q AS (SELECT *, c * (2 * tx + 1 - nw) - s * (2 * ty + 1 - nh) + w * 65536 AS u, s * (2 * tx + 1 - nw) + c * (2 * ty + 1 - nh) + h * 65536 AS v FROM t2),
        e AS (SELECT *, u >= 0 AND u < w * 131072 AND v >= 0 AND v < h * 131072 AS inside, floor((u - 65536) / 131072::DOUBLE)::BIGINT AS x0, floor((v - 65536) / 131072::DOUBLE)::BIGINT AS y0 FROM q),
        d AS (SELECT *, u - 65536 - x0 * 131072 AS fx, v - 65536 - y0 * 131072 AS fy FROM e),
        o AS (SELECT d.vec_id, ty, tx, greatest(0, least(w - 1, x0 + a)) AS x, greatest(0, least(h - 1, y0 + b)) AS y, (CASE a WHEN 0 THEN 131072 - fx ELSE fx END) * (CASE b WHEN 0 THEN 131072 - fy ELSE fy END) AS m
              FROM d CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) n(a, b) WHERE inside),
        dr AS (SELECT o.vec_id, ty AS y, tx AS x, sum(m * gray)::DOUBLE / 17179869184 AS gray FROM o JOIN px ON px.vec_id = o.vec_id AND px.x = o.x AND px.y = o.y GROUP BY o.vec_id, ty, tx),
        fl AS (SELECT vec_id, floor(median(gray)) AS gray FROM px GROUP BY vec_id)
        SELECT vec_id, y, x, round_even(gray, 4) AS gray FROM dr UNION ALL SELECT vec_id, ty, tx, gray FROM d JOIN fl USING (vec_id) WHERE NOT inside""",
    "thumbnail_parts": """
        WITH a AS (SELECT p_brand AS file, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS p, count(*) OVER (PARTITION BY p_brand) // 16 AS h, p_partkey % 256 AS r, p_size * 5 AS g, p_partkey % 7 AS b FROM part),
        px AS (SELECT *, p // 16 AS y, p % 16 AS x, CASE WHEN greatest(16, h) <= 10 THEN 16 ELSE greatest(1, (2 * 160 + greatest(16, h)) // (2 * greatest(16, h))) END AS nw,
                      CASE WHEN greatest(16, h) <= 10 THEN h ELSE greatest(1, (2 * h * 10 + greatest(16, h)) // (2 * greatest(16, h))) END AS nh FROM a WHERE p // 16 < h),
        cy AS (SELECT *, unnest(range(0, nh)) AS j FROM px), cx AS (SELECT *, unnest(range(0, nw)) AS i FROM cy),
        m AS (SELECT *, greatest(0, least((y + 1) * nh, (j + 1) * h) - greatest(y * nh, j * h)) * greatest(0, least((x + 1) * nw, (i + 1) * 16) - greatest(x * nw, i * 16)) AS m FROM cx),
        t AS (SELECT file, j, i, max(h) * 16 AS area, sum(m * r)::BIGINT AS r, sum(m * g)::BIGINT AS g, sum(m * b)::BIGINT AS b FROM m WHERE m > 0 GROUP BY file, j, i)
        SELECT file, j AS y, i AS x, ((2 * r + area) // (2 * area))::INT AS r, ((2 * g + area) // (2 * area))::INT AS g, ((2 * b + area) // (2 * area))::INT AS b FROM t""",
    "palette_parts": f"""
        WITH RECURSIVE hist AS (SELECT p_brand AS file, p_partkey % 256 AS r, p_size * 5 AS g, p_partkey % 7 AS b, count(*) AS n FROM part GROUP BY ALL), {median_cut(7)},
        p AS (SELECT file, box, (2 * sum(r * n) + sum(n))::BIGINT // (2 * sum(n))::BIGINT AS r, (2 * sum(g * n) + sum(n))::BIGINT // (2 * sum(n))::BIGINT AS g, (2 * sum(b * n) + sum(n))::BIGINT // (2 * sum(n))::BIGINT AS b, sum(n)::BIGINT AS n FROM b7 GROUP BY file, box),
        q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, box) AS place FROM p),
        l AS (SELECT file, 1::BIGINT AS place, [{{'p': place, 'r': r, 'g': g, 'b': b}}] AS held FROM q WHERE place = 1
              UNION ALL SELECT q.file, q.place, CASE WHEN len([h FOR h IN held IF (h.r - q.r) ** 2 + (h.g - q.g) ** 2 + (h.b - q.b) ** 2 < 6400]) > 0 THEN held ELSE list_append(held, {{'p': q.place, 'r': q.r, 'g': q.g, 'b': q.b}}) END
              FROM l JOIN q ON q.file = l.file AND q.place = l.place + 1)
        SELECT q.file, q.place::INT AS place, q.r::INT AS r, q.g::INT AS g, q.b::INT AS b, q.n, ([h FOR h IN held IF (h.r - q.r) ** 2 + (h.g - q.g) ** 2 + (h.b - q.b) ** 2 < 6400])[1].p::INT AS leader FROM q JOIN l ON l.file = q.file AND l.place = q.place""",
    "read_angles_lines": f"""
        WITH {_BOXES}, w AS (SELECT img, angle + turn AS angle FROM rd QUALIFY row_number() OVER (PARTITION BY img, box ORDER BY score DESC, i) = 1),
        m AS (SELECT *, median(angle) OVER (PARTITION BY img) AS mid FROM w)
        SELECT img, median(CASE WHEN angle - mid > 90 THEN angle - 180 WHEN mid - angle > 90 THEN angle + 180 ELSE angle END) AS angle, count(*) AS n FROM m GROUP BY img""",
    # the angles are halves, whose sums are exact: stddev_pop left it to the order of rows whether a spread of 2 is over 2
    "skew_by_reading_lines": f"""
        WITH {_BOXES}, b AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY w DESC, box) AS place FROM f QUALIFY place <= 8),
        m AS (SELECT *, median(angle) OVER (PARTITION BY img) AS mid FROM b),
        t AS (SELECT img, median(a) AS angle, sqrt(count(a) * sum(a * a) - sum(a) * sum(a)) / count(a) AS spread FROM (SELECT img, CASE WHEN angle - mid > 45 THEN angle - 90 WHEN mid - angle > 45 THEN angle + 90 ELSE angle END AS a FROM m) GROUP BY img),
        v AS (SELECT rd.img, rd.i, rd.turn, sum(score) AS score FROM rd JOIN b ON b.img = rd.img AND b.box = rd.box AND b.place <= 2 GROUP BY rd.img, rd.i, rd.turn HAVING sum(score) > 0 QUALIFY row_number() OVER (PARTITION BY rd.img ORDER BY sum(score) DESC, rd.i) = 1)
        SELECT img, CASE WHEN abs(angle) >= 1 AND abs(angle + coalesce(turn, 0)) <= 10 AND spread <= 2 THEN angle + coalesce(turn, 0) ELSE 0 END AS angle, round_even(spread, 6) AS spread FROM t LEFT JOIN v USING (img)""",
    "picture_failures_documents": """
        WITH i AS (SELECT doc_id, n_chars, octet_length(encode(text)) AS held, CASE WHEN doc_id IS NOT NULL THEN count(*) OVER (PARTITION BY doc_id) END AS named FROM documents),
        r AS (SELECT doc_id::VARCHAR AS file, 'read' AS step, CASE WHEN doc_id IS NULL THEN 'no name' WHEN coalesce(n_chars, 0) <= 0 THEN 'no size' WHEN held IS NULL THEN 'no data'
            WHEN held <> n_chars THEN held || ' bytes where ' || n_chars || ' are needed' WHEN named > 1 THEN 'several pictures have this name' END AS reason FROM i)
        SELECT * FROM r WHERE reason IS NOT NULL""",
    "rounded_amounts_lineitem": """
        WITH x AS (SELECT l_returnflag, l_linestatus, l_extendedprice::DOUBLE * l_discount::DOUBLE AS x FROM lineitem),
        h AS (SELECT *, 134217729::DOUBLE * x - (134217729::DOUBLE * x - x) AS top, x * 100::DOUBLE AS p FROM x),
        d AS (SELECT *, p - floor(p) - 0.5::DOUBLE + ((top * 100::DOUBLE - p) + (x - top) * 100::DOUBLE) AS over FROM h)
        SELECT l_returnflag, l_linestatus, sum(floor(p)::BIGINT + CASE WHEN over > 0 OR (over = 0 AND floor(p)::BIGINT % 2 = 1) THEN 1 ELSE 0 END)::BIGINT AS cents, count(*) AS n FROM d GROUP BY ALL""",
    "box_measures_orders": """
        WITH b AS (SELECT l_orderkey, l_linenumber * 15 + l_partkey % 3 AS base, 5 + l_suppkey % 4 AS xh, l_suppkey % 3 > 0 AS tall, l_suppkey % 4 * (l_orderkey % 5) AS xs, l_quantity::BIGINT AS q FROM lineitem),
        t AS (SELECT *, base - xh AS x_top, CASE WHEN tall THEN base - xh - 3 END AS cap, xs + q AS xe FROM b),
        l AS (SELECT *, coalesce(cap, x_top) AS top, row_number() OVER w AS i, base - lag(base) OVER w AS gap FROM t WINDOW w AS (PARTITION BY l_orderkey ORDER BY base, coalesce(cap, x_top), x_top, cap NULLS FIRST, xh, xs, xe)),
        m AS (SELECT l_orderkey, count(*) AS n, min(base) AS f, median(gap) AS gap, median(xh) AS xh, 14 + l_orderkey % 3 AS step FROM l GROUP BY l_orderkey),
        k AS (SELECT l_orderkey, base, step, n >= 3 AND abs(step - m.gap) <= 2 AS fit, round_even((base - f) / step::DOUBLE, 0) AS k FROM l JOIN m USING (l_orderkey)),
        p AS (SELECT *, sum(base - k * step) OVER (PARTITION BY l_orderkey) / count(*) OVER (PARTITION BY l_orderkey) AS phase FROM k),
        g AS (SELECT l_orderkey, CASE WHEN bool_or(fit) THEN sum(abs(round_even(phase + k * step, 0) - base)) / count(*) ELSE 0 END AS residual, coalesce(bool_or(fit), false) AS fit FROM p GROUP BY l_orderkey),
        s AS (SELECT l_orderkey, round_even(stddev_pop(xs), 9) AS a, round_even(stddev_pop(xe), 9) AS b, round_even(stddev_pop((xs + xe) / 2::DOUBLE), 9) AS c FROM l GROUP BY l_orderkey),
        j AS (SELECT l_orderkey, string_agg(base::VARCHAR, ',' ORDER BY i) AS baselines, string_agg(x_top::VARCHAR, ',' ORDER BY i) AS x_tops, string_agg(coalesce(cap::VARCHAR, '-'), ',' ORDER BY i) AS caps, string_agg(xh::VARCHAR, ',' ORDER BY i) AS x_heights,
                     string_agg(xs::VARCHAR, ',' ORDER BY i) AS x_starts, string_agg(xe::VARCHAR, ',' ORDER BY i) AS x_ends, concat_ws(',', min(xs), min(top), max(xe), max(base)) AS box_ink FROM l GROUP BY l_orderkey)
        SELECT j.*, n AS n_lines, round_even(m.xh, 1) AS xh_median, CASE WHEN fit THEN step::DOUBLE END AS lead, round_even(gap, 1) AS lead_measured, round_even(gap / m.xh, 3) AS lead_over_xh, round_even(residual, 2) AS grid_resid,
               CASE WHEN n >= 2 THEN CASE WHEN least(a, b, c) > 3 THEN 'none' WHEN a <= least(b, c) THEN 'left' WHEN b <= c THEN 'right' ELSE 'center' END END AS align,
               CASE WHEN n >= 2 THEN round_even(a, 2) END AS align_left, CASE WHEN n >= 2 THEN round_even(b, 2) END AS align_right, CASE WHEN n >= 2 THEN round_even(c, 2) END AS align_center
        FROM j JOIN m USING (l_orderkey) JOIN g USING (l_orderkey) JOIN s USING (l_orderkey)""",
    "descenders_customers": f"WITH {components(_CORNERS, 8)} SELECT img, max(CASE WHEN y2 - y1 >= 2 THEN y2 END) AS desc FROM co GROUP BY img",
    "absorbed_orders": """
        WITH RECURSIVE r AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS u, min(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL),
        t AS (SELECT l_orderkey, l_linenumber * 11 + p % 3 AS s, l_linenumber * 11 + p % 3 + 2 + u % 8 AS e, p % 6 AS x0, p % 6 + q AS x1 FROM r),
        f AS (SELECT l_orderkey, 0 AS i, list({'s': s::BIGINT, 'e': e::BIGINT, 'x0': x0::BIGINT, 'x1': x1::BIGINT, 'kept': false} ORDER BY s, e, x0, x1) AS l FROM t GROUP BY l_orderkey
              UNION ALL SELECT l_orderkey, i, list_transform(l, lambda v, k: CASE WHEN k = taker THEN {'s': least(v.s, own.s), 'e': greatest(v.e, own.e), 'x0': v.x0, 'x1': v.x1, 'kept': v.kept}
                    WHEN k = i THEN {'s': v.s, 'e': v.e, 'x0': v.x0, 'x1': v.x1, 'kept': taker = 0 AND v.e - v.s >= 4} ELSE v END)
              FROM (SELECT l_orderkey, i, l, own, CASE WHEN na AND NOT (nb AND gb < ga) THEN i + 1 WHEN nb THEN i - 1 ELSE 0 END AS taker
                FROM (SELECT *, a.s - own.e AS ga, own.s - b.e AS gb,
                        coalesce(a.e - a.s > own.e - own.s AND own.x0 >= a.x0 - 1 AND own.x1 <= a.x1 + 1 AND own.e - own.s <= 0.5::DOUBLE * (a.e - a.s) AND own.x1 - own.x0 <= 0.4::DOUBLE * greatest(a.x1 - a.x0, 1) AND a.s - own.e <= greatest(3, 0.6::DOUBLE * (a.e - a.s)), false) AS na,
                        coalesce(b.e - b.s > own.e - own.s AND own.x0 >= b.x0 - 1 AND own.x1 <= b.x1 + 1 AND own.e - own.s <= 0.5::DOUBLE * (b.e - b.s) AND own.x1 - own.x0 <= 0.4::DOUBLE * greatest(b.x1 - b.x0, 1) AND own.s - b.e <= greatest(3, 0.6::DOUBLE * (b.e - b.s)), false) AS nb
                      FROM (SELECT l_orderkey, i + 1 AS i, l, l[i + 1] AS own, l[i + 2] AS a, CASE WHEN i > 0 THEN l[i] END AS b FROM f WHERE i < len(l))))),
        o AS (SELECT l_orderkey, unnest(l) AS v FROM f WHERE i = len(l))
        SELECT l_orderkey, v.s AS s, v.e AS e, v.x0 AS x0, v.x1 AS x1 FROM o WHERE v.kept""",
    "union_boxes_lines": """
        WITH q AS (SELECT l_orderkey AS img, l_partkey % 400 + 0.25::DOUBLE AS x, l_suppkey % 100 * 2 + 0.5::DOUBLE AS y, l_quantity::DOUBLE AS w FROM lineitem)
        SELECT img, greatest(0, trunc(min(x) - 6)::INT) AS x1, greatest(0, trunc(min(y) - 6)::INT) AS y1, least(420, trunc(max(x + w) + 6)::INT) AS x2, least(200, trunc(max(y) + 9 + 6)::INT) AS y2 FROM q GROUP BY img""",
    "box_sizes_lines": """
        WITH b AS (SELECT l_returnflag, l_partkey % 70 AS x1, l_suppkey % 60 AS y1, l_partkey % 70 + l_quantity::DOUBLE / 10 AS x2, l_suppkey % 60 + l_linenumber AS y2 FROM lineitem),
        p AS (SELECT l_returnflag, least(64, floor(x2) + 3) AS x2, least(64, floor(x2) + 3) - greatest(0, x1 - 3) AS w, least(52, y2 + 3) - greatest(0, y1 - 3) AS h, least(64, floor(x2) + 4) - greatest(0, x1 - 4) AS sw, least(52, y2 + 4) - greatest(0, y1 - 4) AS sh FROM b)
        SELECT l_returnflag, count(*) FILTER (WHERE w < 4 OR h < 4) AS n_small, count(*) FILTER (WHERE w >= 4 AND h >= 4) AS n_measured, sum(x2)::BIGINT AS x2, count(*) FILTER (WHERE sw >= 8 AND sh >= 6) AS n_seeds FROM p GROUP BY l_returnflag""",
    "regression_orders": """
        WITH p AS (SELECT l_orderkey AS k, count(*) AS nb FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY l_orderkey),
        d AS (SELECT *, CASE WHEN k % 11 = 0 THEN 2 + 7 * nb - missing ELSE (k % 5 = 0)::INT + CASE WHEN k % 7 = 0 THEN nb ELSE 0 END END AS n
              FROM p JOIN (SELECT l_orderkey AS k, count(*) FILTER (WHERE l_linenumber = 5) AS missing FROM lineitem GROUP BY l_orderkey) USING (k))
        SELECT k::VARCHAR AS name, 'turned by ' || CASE WHEN k % 10 = 0 THEN '2.5' ELSE '0.0' END AS why, n AS n_changed, least(n, 10)::INT AS n_shown,
               CASE WHEN k % 11 = 0 OR k % 5 = 0 THEN 'angle' ELSE 'blocks[0].box[0]' END AS first FROM d WHERE n > 0""",
    "bands_hours": f"""
        WITH {HOURLY}, o AS (SELECT event_type, "at" - min("at") OVER (PARTITION BY event_type) AS i, value FROM h),
        m AS (SELECT event_type, i, median(value) OVER a AS a, count(*) OVER a AS na, median(value) OVER b AS b, count(*) OVER b AS nb FROM o
            WINDOW a AS (PARTITION BY event_type ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING), b AS (PARTITION BY event_type ORDER BY i ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
        c AS (SELECT event_type, list([i] ORDER BY abs(a - b) DESC, i) AS l FROM m WHERE na = 12 AND nb = 12 AND abs(a - b) >= 1 GROUP BY event_type),
        r AS (SELECT event_type, list_sort(list_reduce(l, lambda d, p: CASE WHEN len(list_filter(d, lambda q: abs(q - p[1]) < 12)) > 0 THEN d ELSE list_concat(d, p) END)) AS cuts FROM c),
        e AS (SELECT event_type, list_concat([0::BIGINT], coalesce(cuts, []), [max(i) + 1]) AS edges FROM o LEFT JOIN r USING (event_type) GROUP BY event_type, cuts)
        SELECT event_type, (k - 1)::INT AS band, edges[k] AS first, edges[k + 1] AS "end" FROM (SELECT *, unnest(range(1, len(edges))) AS k FROM e)""",
}
