"""The queries of the training-data operators and, where SQL can express them, the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallystone.llm import decontaminate, exact_dedup, language_id, line_dedup, near_dedup, ngram_join, packing, perspectives, pii, prefix_trie, secrets, spelling, url_rules
from tallystone.llm.common import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.similar(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_secrets, op2_decontaminate, op3_exact_dedup, op4_line_dedup, op5_near_dedup, op6_language_id, op7_packing, op8_perspectives, op9_pii, op10_url_rules, op11_prefix_trie, op12_spelling, op13_ngram_join, pipeline)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: Of each kind of op1, its text and pattern; kind 5 takes runs, kind 6 the empty lines that part scopes.
_PARTS = {
    0: ("lo", """(?:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?[A-Za-z0-9+/_.=-]+"""),
    1: ("t", "AKIA[A-Z0-9]+"),
    2: ("t", "[0-9a-f]{24,}"),
    3: ("lo", """(?:client|account|user|tenant)[_-]?(?:id|name)["'']?\\x20*[:=]\\x20*["'']?[A-Za-z0-9@_.-]+"""),
    4: ("t", "(?:https?|postgres|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9.-]+(?::[0-9]+)?"),
    5: ("t", "[A-Za-z0-9+/_=-]+"),
    6: ("t", "\\n[\\x20\\t\\r]*\\n"),
}
_CUT = " UNION ALL ".join(f"SELECT doc_id, {k} AS rank, unnest(string_split_regex({c}, '{x}')) AS g, unnest(regexp_extract_all({c}, '{x}')) AS m, generate_subscripts(string_split_regex({c}, '{x}'), 1) AS i FROM tx" for k, (c, x) in _PARTS.items())



def _crc_row(i: int) -> int:
    for _ in range(8):
        i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
    return i


#: Unsigned crc32 of a text's UTF-8, byte by byte with the table of the reversed polynomial.
_CRC = "xor(4294967295, list_reduce(list_concat([4294967295], [('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT FOR i IN range(octet_length(encode({0})))]), lambda c, b: xor(c >> 8, [" + ", ".join(str(_crc_row(i)) for i in range(256)) + "][xor(c & 255, b) + 1])))"

ORACLE_SQL = {
    "op1_secrets": f"""
        WITH tx AS (SELECT doc_id, coalesce(text, '') AS t, {_LOWER.format("coalesce(text, '')")} AS lo FROM documents),
        f AS (SELECT doc_id, rank, m, (upto - length(m))::BIGINT AS a, upto::BIGINT AS b FROM (SELECT *, sum(length(g) + coalesce(length(m), 0)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS upto FROM ({_CUT})) WHERE m IS NOT NULL),
        base AS (SELECT * FROM f WHERE (rank = 0 AND length(regexp_extract(m, '["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6) OR (rank = 1 AND b - a >= 20) OR rank = 2),
        ext AS (SELECT f.doc_id, a, b + length(regexp_extract(substring(t, b + 1), '^[^\\x20\\t\\r\\n"''<>]*')) AS b FROM f JOIN tx USING (doc_id) WHERE rank = 4),
        k3 AS (SELECT * FROM base UNION ALL SELECT * FROM f WHERE rank = 3 AND NOT EXISTS (SELECT 1 FROM base o WHERE o.doc_id = f.doc_id AND o.a < f.b AND f.a < o.b)),
        k4 AS (SELECT * FROM k3 UNION ALL SELECT * FROM f WHERE rank = 4 AND NOT EXISTS (SELECT 1 FROM k3 o WHERE o.doc_id = f.doc_id AND o.a < f.b AND f.a < o.b)),
        k5 AS (SELECT * FROM f WHERE rank = 5 AND regexp_full_match(m, '[A-Za-z0-9+/_-]{{32,64}}={{0,2}}') AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')
               AND NOT EXISTS (SELECT 1 FROM ext o WHERE o.doc_id = f.doc_id AND o.a < f.b AND f.a < o.b) AND NOT EXISTS (SELECT 1 FROM k4 o WHERE o.doc_id = f.doc_id AND o.a < f.b AND f.a < o.b)),
        p0 AS (SELECT doc_id, rank, a, b FROM k4 UNION ALL SELECT doc_id, rank, a, b FROM k5),
        p AS (SELECT p0.doc_id, p0.rank, p0.a, p0.b, count(e.a) AS scope, ['assign', 'access', 'hex', 'ident', 'endpoint', 'bare'][p0.rank + 1] || ':' || p0.a || ':' || p0.b AS shown, CASE WHEN p0.rank IN (1, 3) THEN 0 WHEN p0.rank = 4 THEN 2 ELSE 1 END AS role
              FROM p0 LEFT JOIN f e ON e.doc_id = p0.doc_id AND e.rank = 6 AND e.a < p0.a GROUP BY p0.doc_id, p0.rank, p0.a, p0.b),
        met AS (SELECT x.doc_id, x.rank, x.a, x.b, y.role, y.shown FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.scope = y.scope AND x.role <> y.role AND abs(x.a - y.a) <= 400 AND (x.b <= y.a OR y.b <= x.a)
                QUALIFY row_number() OVER (PARTITION BY x.doc_id, x.rank, x.a, x.b, y.role ORDER BY greatest(y.a - x.b, x.a - y.b), y.a, y.rank, y.b) = 1),
        near AS (SELECT doc_id, rank, a, b, max(CASE WHEN role = 0 THEN shown END) AS idn, max(CASE WHEN role = 1 THEN shown END) AS sec, max(CASE WHEN role = 2 THEN shown END) AS edp FROM met GROUP BY ALL),
        told AS (SELECT p.*, idn, edp, coalesce(CASE role WHEN 0 THEN sec IS NOT NULL WHEN 1 THEN idn IS NOT NULL OR edp IS NOT NULL ELSE idn IS NOT NULL AND sec IS NOT NULL END, false) AS linked FROM p LEFT JOIN near USING (doc_id, rank, a, b)),
        s AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex, string_agg(shown, ',' ORDER BY a, rank) FILTER (WHERE rank < 3) AS base,
                     string_agg(shown, ',' ORDER BY a, rank) FILTER (WHERE rank < 3 OR linked) AS spans, count(*) FILTER (WHERE linked) AS n_linked,
                     string_agg(shown || '|' || coalesce(idn, '') || '|' || coalesce(edp, ''), ',' ORDER BY a, rank) FILTER (WHERE linked AND role = 1) AS links FROM told GROUP BY doc_id)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked, coalesce(links, '') AS links
        FROM tx LEFT JOIN s USING (doc_id)""",
    "op2_decontaminate": f"""
        WITH i AS (SELECT item_id, {_WORDS.format(_LOWER.format("text"))} AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
        w AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[k : k + least(len(ws), 10) - 1], ' ') AS key
              FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS k FROM i WHERE len(ws) > 0)),
        d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
        p AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM w) WHERE len(ws) >= n),
        h AS (SELECT doc_id, k, w.n, item_id FROM (SELECT doc_id, n, k, array_to_string(ws[k : k + n - 1], ' ') AS key FROM p) g JOIN w ON w.key = g.key AND w.n = g.n),
        x AS (SELECT DISTINCT doc_id, unnest(range(k, k + n)) - 1 AS x FROM h),
        sp AS (SELECT doc_id, min(x) AS a, max(x) + 1 AS b FROM (SELECT doc_id, x, x - row_number() OVER (PARTITION BY doc_id ORDER BY x) AS run FROM x) GROUP BY doc_id, run),
        hit AS (SELECT doc_id, sum(b - a)::BIGINT AS n_hit, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM sp GROUP BY doc_id),
        it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS spans
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op4_line_dedup": f"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split),
        keyed AS (SELECT *, {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k FROM lines),
        shared AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        told AS (SELECT doc_id, line, pos, coalesce(keeper <> doc_id, false) AS lost FROM keyed LEFT JOIN shared USING (k)),
        runs AS (SELECT doc_id, min(pos) - 1 AS first, count(*) AS n FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM told WHERE NOT lost) GROUP BY doc_id, run),
        kept AS (SELECT doc_id, string_agg(first || '+' || n, ',' ORDER BY first) AS kept_runs FROM runs GROUP BY doc_id)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256,
               coalesce(any_value(kept_runs), '') AS kept_runs
        FROM told LEFT JOIN kept USING (doc_id) GROUP BY doc_id""",
    "op5_near_dedup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        sh AS (SELECT DISTINCT doc_id, array_to_string(ws[k : k + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS k FROM d WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 85 * (i.n + j.n - c)),
        b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
        w AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT w.doc_id, b.y FROM w JOIN b ON b.x = w.r)
        SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, coalesce(min(r), d.doc_id) AS component_id, d.doc_id = coalesce(min(r), d.doc_id) AS kept
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN w USING (doc_id) GROUP BY d.doc_id""",
    "op8_perspectives": """
        WITH m AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
        sp AS (SELECT DISTINCT conv_id, role AS speaker FROM m WHERE role <> 'system'),
        v AS (SELECT m.*, speaker, '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant'
                         ELSE 'user name=' || regexp_replace(replace(role, '<|im_', '<\\|im_'), '[\r\n]', ' ', 'g') END || chr(10) AS head,
                     replace(text, '<|im_', '<\\|im_') || '<|im_end|>' AS body FROM m JOIN sp ON m.conv_id IS NOT DISTINCT FROM sp.conv_id),
        p AS (SELECT *, sum(length(head) + length(body) + 1) OVER w - length(body) - 1 AS begin_at, row_number() OVER w AS nr
              FROM v WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
        SELECT conv_id, 0::BIGINT AS segment, speaker, count(*) AS n_messages, count(*) FILTER (WHERE role = speaker) AS n_masked,
               string_agg(head || body || chr(10), '' ORDER BY nr) AS rendered,
               coalesce(string_agg(begin_at::BIGINT || ':' || (begin_at + length(body))::BIGINT, ',' ORDER BY nr) FILTER (WHERE role = speaker), '') AS mask
        FROM p GROUP BY conv_id, speaker""",
    "op11_prefix_trie": f"""
        WITH m AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
        h AS (SELECT c, c - c % 20 AS b, {_CRC.format("c::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT c FROM m)),
        turns AS (SELECT h.c, 0 AS own, p, r, t FROM h JOIN m ON m.c = h.b AND p <= h.h UNION ALL SELECT h.c, 1, p, r, t FROM h JOIN m ON m.c = h.c AND p > h.h),
        dialogue AS (SELECT h.c, coalesce(list(struct_pack(r := r, t := t) ORDER BY own, p) FILTER (WHERE r IS NOT NULL), []) AS s FROM h LEFT JOIN turns USING (c) GROUP BY h.c),
        begun AS (SELECT c, len(s) AS whole, unnest(range(0, len(s) + 1)) AS d, s FROM dialogue),
        node AS (SELECT s[1 : d] AS s, d, min(c) AS conv_id, count(*) AS n_convs, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE whole = d) AS ends,
                        CASE WHEN d > 0 THEN len(regexp_extract_all(any_value(s)[d].t, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS words FROM begun GROUP BY s[1 : d], d),
        kids AS (SELECT s[1 : d - 1] AS s, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
        x AS (SELECT node.*, coalesce(n, 0) AS n_children FROM node LEFT JOIN kids USING (s, d)),
        below AS (SELECT a.s, a.d, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.words)::BIGINT AS saved_tokens FROM x a JOIN x b ON b.d >= a.d AND b.s[1 : a.d] = a.s GROUP BY a.s, a.d)
        SELECT x.conv_id, x.d AS depth, up.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
        FROM x JOIN below USING (s, d) LEFT JOIN x up ON x.d > 0 AND up.d = x.d - 1 AND up.s = x.s[1 : x.d - 1]""",
    "op12_spelling": f"""
        WITH RECURSIVE r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all({_LOWER.format("text")}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
        c AS (SELECT run, n, {_CRC.format("(id || ':' || run)")} AS h FROM (SELECT id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY id, run)),
        w AS (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM c),
        v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        del AS (SELECT word, n, i, substring(word, 1, (i - 1)::INT) || substring(word, (i + 1)::INT) AS k FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
        near AS (SELECT d.word, v.word AS other, v.n AS m FROM del d JOIN v ON d.k = v.word UNION SELECT v.word, d.word, d.n FROM del d JOIN v ON d.k = v.word
                 UNION SELECT a.word, b.word, b.n FROM del a JOIN del b ON a.k = b.k AND a.i = b.i AND a.word <> b.word),
        best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
        f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN other END AS form, CASE WHEN m >= 10 * v.n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
        up AS (SELECT word, word AS root, 0 AS steps FROM f UNION ALL SELECT up.word, f.form, steps + 1 FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL)
        SELECT f.word, form, arg_max(root, steps) AS root, n, n_near, form_n FROM f JOIN up USING (word) GROUP BY ALL""",
    "op13_ngram_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        sh AS (SELECT DISTINCT doc_id, array_to_string(ws[k : k + 2], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS k FROM d WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 90 * (i.n + j.n - c)),
        b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
        w AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT w.doc_id, b.y FROM w JOIN b ON b.x = w.r)
        SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, coalesce(min(r), d.doc_id) AS component_id
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN w USING (doc_id) GROUP BY d.doc_id""",
    # FP-growth by listing every combination of the tokens of each labelled page
    "op10_url_rules": r"""
        WITH u AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
        w AS (SELECT u.*, r.name AS rule, r.says FROM u LEFT JOIN (VALUES ('allow', 'com', '/', 'com/'), ('block', 'example.com', '/en/', 'example.com/en/'), ('allow', 'www.example.com', '/en/', 'www.example.com/en/'), ('block', 'net', '/es/', 'net/es/'), ('block', 'net', '/fr/', 'net/fr/')) r(says, h, p, name)
              ON (host = h OR suffix(host, '.' || h)) AND prefix(path, p) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(r.name) DESC NULLS LAST) = 1),
        t AS (SELECT w.*, CASE WHEN contains(url, '://') THEN list_sort(list_distinct(
                  [concat('h', i - 1, ':', list_reverse(string_split(host, '.'))[i]) for i in range(1, len(string_split(host, '.')) + 1)]
                  || ['p:' || regexp_replace(x, '[0-9]+', '0', 'g') for x in string_split(path, '/') if x <> '']
                  || ['q:' || string_split(x, '=')[1] for x in string_split(regexp_extract(url, '(?s)\?([^#]*)', 1), '&') if x <> '']
                  || ['s:' || lower(string_split(url, '://')[1])] || CASE WHEN contains(url, '#') THEN ['f'] ELSE [] END)) ELSE [] END AS toks FROM w),
        l AS (SELECT doc_id, max(coalesce(toxic = 1 OR quality = 0, false)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
        b AS (SELECT toks, bad, count(*) OVER () AS n_pages, sum(bad::INT) OVER () AS n_bad FROM t JOIN l ON page_id = doc_id WHERE len(toks) > 0),
        c AS (SELECT bad, n_pages, n_bad, [toks[i] for i in range(1, len(toks) + 1) if (m >> (i - 1)) & 1 = 1] AS s FROM (SELECT *, unnest(range(1, 1 << len(toks))) AS m FROM b)),
        f AS (SELECT s, count(*) FILTER (WHERE bad) / count(*)::DOUBLE AS confidence FROM c GROUP BY s
              HAVING count(*) FILTER (WHERE bad) >= greatest(0.002 * any_value(n_pages), 2) AND count(*) FILTER (WHERE bad) / count(*)::DOUBLE >= 0.6
                 AND count(*) FILTER (WHERE bad) / count(*)::DOUBLE / (any_value(n_bad) / any_value(n_pages)::DOUBLE) > 1 + 1e-9),
        g AS (SELECT page_id, max(confidence) AS confidence FROM t JOIN f ON list_has_all(toks, s) GROUP BY page_id)
        SELECT t.page_id, host, path, rule, coalesce(says, CASE WHEN confidence IS NOT NULL THEN 'block' END, 'allow') AS verdict, confidence FROM t LEFT JOIN g USING (page_id)""",
}
