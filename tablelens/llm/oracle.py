"""DuckDB SQL for the queries that SQL can express.

Without SQL are op1 (a crc32 of whole texts is too slow), op7 and op8 (learned and approximate), op9 and the pipeline
(merging), op13 (all windows of 400 bytes): the tests hold these against plain models.
"""

from __future__ import annotations

from tablelens.llm import exponion, mixing, prefix_trie, quotation, spotsigs, url_filter

UPPER, LOWER = url_filter.UPPER, url_filter.LOWER


def _list(names: list[str] | tuple[str, ...]) -> str:
    return ", ".join("'" + n.replace("'", "''") + "'" for n in names)


def _breaks() -> str:
    return " || ".join(f"chr({ord(c)})" for c in spotsigs.BREAKS)


OP2 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nt FROM d),
e AS (SELECT doc_id, length(t) AS n_chars, t, substr(t, 1, length(t) - length(t) // 2) || substr(nt, 1, length(t) // 2) AS et FROM n),
x AS (SELECT doc_id, 0 AS kind, t FROM e UNION ALL SELECT doc_id, 1, et FROM e),
s AS (SELECT doc_id, kind, string_split(translate(lower(t), {_breaks()}, '{' ' * len(spotsigs.BREAKS)}'), ' ') AS l FROM x),
w AS (SELECT doc_id, kind, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM s),
p AS (SELECT doc_id, kind, w, i, lag(w) OVER (PARTITION BY doc_id, kind ORDER BY i) AS p FROM w WHERE w <> ''),
c AS (SELECT *, lead(w) OVER (PARTITION BY doc_id, kind ORDER BY i) AS f FROM p WHERE w NOT IN ({_list(spotsigs.ANCHORS)})),
g AS (
  SELECT doc_id, kind, 0 AS rank, p || ' ' || w || ' ' || coalesce(f, '') AS g FROM c WHERE p IN ({_list(spotsigs.ANCHORS)})
  UNION ALL SELECT doc_id, kind, 1, ' ' || w || ' ' || coalesce(f, '') FROM c UNION ALL SELECT doc_id, kind, 2, w FROM p
),
b AS (SELECT doc_id, kind, list_sort(list_distinct(list(substr(md5(g), 1, {spotsigs.SIG_CHARS})))) AS sig FROM (SELECT *, min(rank) OVER (PARTITION BY doc_id, kind) AS best FROM g) WHERE rank = best GROUP BY 1, 2),
f AS (SELECT e.*, coalesce(b0.sig, []) AS sig, coalesce(b1.sig, []) AS esig FROM e LEFT JOIN b b0 ON b0.doc_id = e.doc_id AND b0.kind = 0 LEFT JOIN b b1 ON b1.doc_id = e.doc_id AND b1.kind = 1),
k AS (SELECT *, coalesce(lead(sig) OVER (ORDER BY doc_id), first_value(sig) OVER (ORDER BY doc_id)) AS nsig FROM f),
m AS (SELECT *, len(list_intersect(sig, esig)) AS ie, len(list_intersect(sig, nsig)) AS inx FROM k)
SELECT doc_id, n_chars::BIGINT AS n_chars, sha256(et) AS edited_sha256, array_to_string(sig, '') AS fingerprint, array_to_string(esig, '') AS edited_fingerprint,
CASE WHEN len(sig) = 0 AND len(esig) = 0 THEN 1.0 ELSE ie::DOUBLE / (len(sig) + len(esig) - ie) END AS near_edited,
CASE WHEN len(sig) = 0 AND len(nsig) = 0 THEN 1.0 ELSE inx::DOUBLE / (len(sig) + len(nsig) - inx) END AS near_next,
(CASE WHEN len(sig) > 0 THEN floor(ln(len(sig)) / -ln({spotsigs.THRESHOLD}) + 1e-9) ELSE -1 END)::INTEGER AS length_partition FROM m
"""


def _rule_case(field: str, rules: list[tuple[str, str]]) -> str:
    out = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, tail = rule.partition("/")
        value = rule if field == "rule" else verdict
        out.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{tail}') THEN '{value}'")
    return f"CASE {' '.join(out)} END"


def op3(rules: list[tuple[str, str]]) -> str:
    return f"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, {_rule_case('rule', rules)} AS rule, {_rule_case('verdict', rules)} AS ruled, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM u),
c AS (SELECT page_id, host, path, rule, ruled, list_transform(seg, lambda s: CASE WHEN regexp_matches(s, '^[0-9]+$') THEN '<num>' WHEN regexp_matches(s, '^[0-9]+[.][A-Za-z]+$') THEN '<num>' || regexp_extract(s, '([.][A-Za-z]+)$', 1)
  WHEN regexp_matches(s, '^[0-9A-Fa-f-]{{8,}}$') THEN '<hex>' WHEN regexp_matches(s, '[0-9]') THEN '<id>' ELSE s END) AS shape FROM r),
s AS (SELECT host, shape, count(*) FILTER (WHERE ruled = 'block') AS bad, count(*) FILTER (WHERE ruled = 'allow') AS good FROM c GROUP BY 1, 2),
e AS (SELECT host, shape, bad, good, generate_subscripts(shape, 1) AS pos, unnest(shape) AS segment FROM s),
n AS (SELECT *, shape[1:pos - 1] AS parent, CASE WHEN pos = len(shape) THEN '$' WHEN starts_with(shape[pos + 1], '<') THEN shape[pos + 1] ELSE 'word' END AS kind FROM e),
t AS (SELECT host, parent, segment, list_sort(list_distinct(list(kind))) AS goes_on, CASE WHEN sum(bad) + sum(good) = 0 THEN 'none' WHEN sum(good) * 10 <= sum(bad) THEN 'bad' WHEN sum(bad) * 10 <= sum(good) THEN 'good' ELSE 'mixed' END AS state, starts_with(segment, '<') AS wild FROM n GROUP BY 1, 2, 3),
a AS (SELECT *, count(*) OVER (PARTITION BY host, parent, wild, goes_on, state) AS alike, count(*) OVER (PARTITION BY host, parent, wild) AS names FROM t),
k AS (SELECT host, parent, segment, CASE WHEN wild THEN segment WHEN alike >= 2 THEN '*' || state WHEN names >= {url_filter.MANY_CHILDREN} THEN '*' ELSE segment END AS token FROM a),
m AS (SELECT n.host, n.shape, '/' || string_agg(token, '/' ORDER BY pos) AS template FROM n JOIN k ON n.host = k.host AND n.parent = k.parent AND n.segment = k.segment GROUP BY 1, 2),
p AS (SELECT s.host, s.shape, coalesce(m.template, '/') AS template, bad, good FROM s LEFT JOIN m ON s.host = m.host AND s.shape = m.shape),
v AS (SELECT host, template, sum(bad) AS bad, sum(bad) + sum(good) AS labelled FROM p GROUP BY 1, 2)
SELECT c.page_id, c.host, c.path, c.rule, coalesce(c.ruled, CASE WHEN (v.bad + 1) * {url_filter.SMOOTH_DEN} >= (v.labelled + 2) * {url_filter.SMOOTH_NUM} THEN 'block' ELSE 'allow' END) AS verdict, p.template, v.labelled::BIGINT AS labelled, v.bad::BIGINT AS bad
FROM c JOIN p ON c.host = p.host AND c.shape = p.shape JOIN v ON p.host = v.host AND p.template = v.template
"""


OP4 = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{mixing.WORD}')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [{', '.join(map(str, mixing.CYCLE))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.CYCLE)} + 1] AS w, source_size * {mixing.MOST} AS lim FROM s),
r AS (SELECT *, sum(source_size) OVER () AS total, coalesce(sum(lim) OVER o, 0) AS used, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS w_left FROM w
  WINDOW o AS (ORDER BY lim / w, w, lim, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - used)::DOUBLE / w_left::DOUBLE AS level_here FROM r),
v AS (SELECT *, arg_min(level_here, used) FILTER (WHERE lim::DOUBLE >= level_here * w) OVER () AS level FROM l),
t AS (SELECT source, source_size, least(lim::DOUBLE, level * w) AS target, CASE WHEN source_size > 0 THEN least({float(mixing.MOST)}::DOUBLE, least(lim::DOUBLE, level * w) / source_size) ELSE 0 END AS rate FROM v),
k AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, z.k, floor(rate) + CASE WHEN ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':{mixing.SEED}:' || z.k), 1, 12))::BIGINT / 281474976710656.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS copies
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, (SELECT unnest(range({mixing.SEEDS})) AS k) z),
b AS (SELECT source, arg_min(k, off * 1000 + k) AS k FROM (SELECT source, k, round(abs(sum(size * copies) - max(target))) AS off FROM k GROUP BY 1, 2) GROUP BY 1)
SELECT k.doc_id, k.size, k.source_size, k.target, (k.size * k.copies)::BIGINT AS taken, k.copies::INTEGER AS copies FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source AND k.k = b.k
"""

OP5 = rf"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS t, regexp_matches(coalesce(text, ''), '(?m){quotation.QUOTE}') AS q FROM conversations),
x AS (SELECT DISTINCT conv_id, turn, role, t, regexp_split_to_array(t, '\r\n|\r|\n') AS a FROM m WHERE q),
l AS (SELECT conv_id, turn, role, t, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM x),
b AS (SELECT *, length(regexp_replace(regexp_extract(x, '{quotation.PREFIX}'), '[ \t]', '', 'g')) AS level, regexp_replace(x, '{quotation.PREFIX}', '') AS body FROM l),
n AS (SELECT *, coalesce(lead(level) OVER w, 0) AS after, level IS DISTINCT FROM lag(level) OVER w AS fresh FROM b WINDOW w AS (PARTITION BY conv_id, turn, role, t ORDER BY i)),
r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY conv_id, turn, role, t ORDER BY i) AS run FROM n),
o AS (SELECT conv_id, turn, role, t, regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (WHERE level = 0 AND NOT (after > 0 AND regexp_matches(body, '{quotation.ATTRIBUTION}'))), ''), '^\s+|\s+$', '', 'g') AS content FROM r GROUP BY 1, 2, 3, 4),
p AS (SELECT m.conv_id, m.turn, m.role, CASE WHEN m.q THEN o.content ELSE m.t END AS content FROM m LEFT JOIN o ON m.q AND m.conv_id IS NOT DISTINCT FROM o.conv_id AND m.turn IS NOT DISTINCT FROM o.turn AND m.role IS NOT DISTINCT FROM o.role AND m.t = o.t),
u AS (SELECT DISTINCT conv_id, turn, level, md5(k) AS unit, weight FROM (
  SELECT conv_id, turn, level, trim(regexp_replace(lower(body), '[\s ]+', ' ', 'g')) AS k, 1 AS weight FROM r WHERE level > 0
  UNION ALL SELECT conv_id, turn, level, trim(regexp_replace(lower(string_agg(body, chr(10) ORDER BY i)), '[\s ]+', ' ', 'g')), 1000 FROM r WHERE level > 0 GROUP BY conv_id, turn, role, t, run, level HAVING count(*) > 1
) WHERE k <> '' AND turn IS NOT NULL),
g AS (SELECT DISTINCT conv_id, turn, md5(trim(regexp_replace(lower(k), '[\s ]+', ' ', 'g'))) AS unit FROM (
  SELECT conv_id, turn, unnest(list_append(list_filter(regexp_split_to_array(content, '\r\n|\r|\n'), lambda x: trim(x) <> ''), content)) AS k FROM p WHERE turn IS NOT NULL AND EXISTS (SELECT 1 FROM u WHERE u.conv_id IS NOT DISTINCT FROM p.conv_id)
) WHERE trim(k) <> ''),
h AS (SELECT u.conv_id, u.turn, u.level, u.unit, u.weight, max(g.turn) AS source FROM u JOIN g ON u.conv_id IS NOT DISTINCT FROM g.conv_id AND u.unit = g.unit AND g.turn < u.turn GROUP BY 1, 2, 3, 4, 5),
s AS (SELECT conv_id, turn, level, source, sum(weight) AS w FROM h GROUP BY 1, 2, 3, 4),
k AS (SELECT conv_id, turn, arg_min(source, (level, -w, -source)) AS parent_turn, count(*) AS n_linked FROM s GROUP BY 1, 2),
c AS (SELECT conv_id, turn, count(*) AS n_quotes FROM u GROUP BY 1, 2),
z AS (SELECT conv_id, turn, parent_turn AS root_turn, 1 AS depth FROM k UNION ALL SELECT z.conv_id, z.turn, k.parent_turn, z.depth + 1 FROM z JOIN k ON z.conv_id IS NOT DISTINCT FROM k.conv_id AND z.root_turn = k.turn),
d AS (SELECT conv_id, turn, min(root_turn) AS root_turn, max(depth) AS depth FROM z GROUP BY 1, 2)
SELECT p.conv_id, coalesce(d.root_turn, p.turn)::BIGINT AS root_turn, p.turn::BIGINT AS turn, k.parent_turn::BIGINT AS parent_turn, coalesce(d.depth, 0)::INTEGER AS depth, p.role, p.content,
coalesce(c.n_quotes, 0)::BIGINT AS n_quotes, coalesce(k.n_linked, 0)::BIGINT AS n_linked
FROM p LEFT JOIN c ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.turn = c.turn LEFT JOIN k ON p.conv_id IS NOT DISTINCT FROM k.conv_id AND p.turn = k.turn LEFT JOIN d ON p.conv_id IS NOT DISTINCT FROM d.conv_id AND p.turn = d.turn
"""

OP6 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to FROM f
"""

OP10 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.k >= 75 * (x.n + y.n - p.k)),
c AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(c.b) AS component_id FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY 1
"""


def _op11() -> str:
    """Every round is a plain scan of all centroids."""
    k, scale, dim = exponion.CLUSTERS, exponion.SCALE, exponion.DIM
    digest = f"sha256('{exponion.SEED}:' || vec_id)"
    parts = [
        f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {digest} NULLS LAST, v) - 1 AS c, v AS m FROM v ORDER BY {digest} NULLS LAST, v LIMIT {k})",
    ]
    for r in range(exponion.ROUNDS + 1):
        d = f"(list_dot_product(v, v) + list_dot_product(m, m) - 2 * list_dot_product(v, m))::BIGINT"
        parts.append(f"a{r} AS MATERIALIZED (SELECT r, min(d * {k} + c) % {k} AS c, min(d) AS d FROM (SELECT r, c, {d} AS d FROM v, c{r}) GROUP BY r)")
        if r < exponion.ROUNDS:
            x = "SELECT c, unnest(v)::BIGINT AS x, generate_subscripts(v, 1) AS i FROM v JOIN a{0} USING (r)".format(r)
            mean = f"SELECT c, i, ((sum(x) - ((sum(x) % count(*) + count(*)) % count(*))) // count(*))::DOUBLE AS x FROM ({x}) GROUP BY 1, 2"
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.m, o.m) AS m FROM c{r} o LEFT JOIN (SELECT c, list(x ORDER BY i) AS m FROM ({mean}) GROUP BY c) n USING (c))")
    last = exponion.ROUNDS
    return ",\n".join(parts) + f"""
SELECT v.vec_id, a.c::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
sha256(array_to_string(list_transform(m, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM v JOIN a{last} a USING (r) JOIN c{last} USING (c)
"""


_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"
OP12 = rf"""
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t),
own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS pos, d, w FROM (SELECT conv_id, turn, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS d,
  len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}'))::BIGINT AS w FROM conversations WHERE conv_id IS NOT NULL)),
conv AS (SELECT c, c - c % {prefix_trie.FAMILY} AS f, {_CRC} % {prefix_trie.HEADS} AS h FROM (SELECT DISTINCT c FROM own), tab),
r AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS depth, d, w FROM (SELECT v.c, 0 AS part, o.pos, o.d, o.w FROM conv v JOIN own o ON o.c = v.f AND o.pos <= v.h UNION ALL SELECT v.c, 1, o.pos, o.d, o.w FROM conv v JOIN own o ON o.c = v.c AND o.pos > v.h)),
s AS (SELECT c, depth, md5(string_agg(d, '') OVER (PARTITION BY c ORDER BY depth)) AS k, w FROM r UNION ALL SELECT c, 0, '', 0 FROM conv),
e AS (SELECT *, lag(k) OVER o AS pk, lead(k) OVER o AS ck FROM s WINDOW o AS (PARTITION BY c ORDER BY depth)),
n AS (SELECT k, any_value(depth) AS depth, any_value(pk) AS pk, any_value(w) AS w, min(c) AS conv_id, count(*) AS n_convs, count(DISTINCT ck) AS n_children, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ck IS NULL), '')) AS ends_sha256 FROM e GROUP BY k),
p AS (SELECT DISTINCT a.k, b.k AS below FROM s a JOIN s b ON a.c = b.c AND b.depth >= a.depth),
t AS (SELECT p.k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * w)::BIGINT AS saved_tokens FROM p JOIN n ON n.k = p.below GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, t.n_leaves, t.saved_tokens, n.ends_sha256 FROM n JOIN t USING (k) LEFT JOIN n u ON u.k = n.pk
"""


def oracles(rules: list[tuple[str, str]]) -> dict[str, str]:
    return {"op2_fingerprints": OP2, "op3_url_filter": op3(rules), "op4_mixing": OP4, "op5_chat_format": OP5, "op6_warc": OP6, "op10_ngram_join": OP10, "op11_centroids": _op11(), "op12_prefix_trie": OP12}
