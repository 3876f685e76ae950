"""SQL forms, for DuckDB, of the queries that SQL can express."""

from __future__ import annotations

from stemline.llm.secrets import ADDED, BASE, Rule

#: The least id that links reach from each node, by transitive closure over nodes(id) and links(a, b).
REACHED = "reached(id, root) AS (SELECT id, id FROM nodes UNION SELECT r.id, l.b FROM reached r JOIN links l ON r.root = l.a)"

VECTORS = f"""WITH RECURSIVE nodes AS MATERIALIZED (SELECT vec_id AS id FROM embeddings),
v AS MATERIALIZED (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0),
n AS MATERIALIZED (SELECT id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.label = b.label AND a.id <> b.id AND len(a.e) = len(b.e) WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
{REACHED},
c AS (SELECT a, COUNT(*) AS n FROM links GROUP BY a)
SELECT r.id AS vec_id, CAST(COALESCE(MAX(c.n), 0) AS BIGINT) AS n_links, MIN(root) AS component_id, MIN(root) = r.id AS kept FROM reached r LEFT JOIN c ON r.id = c.a GROUP BY r.id"""

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NEAR = f"""WITH RECURSIVE nodes AS MATERIALIZED (SELECT doc_id AS id FROM documents),
w AS MATERIALIZED (SELECT doc_id AS id, regexp_extract_all(translate(COALESCE(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
u AS MATERIALIZED (SELECT id, len(s) AS n, unnest(s) AS x FROM s),
links AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.x = b.x AND a.id <> b.id GROUP BY a.id, b.id, a.n, b.n HAVING 100 * COUNT(*) >= 75 * (a.n + b.n - COUNT(*))),
{REACHED}
SELECT r.id AS doc_id, CAST(MAX(len(s.s)) AS BIGINT) AS n_shingles, MIN(root) AS component_id, MIN(root) = r.id AS kept FROM reached r JOIN s ON r.id = s.id GROUP BY r.id"""


def _spans(at: int, rule: Rule) -> str:
    """A list of (start, at, end, kind) of a rule's matches: pieces between matches give the places."""
    pattern = rule.pattern.replace("'", "''")
    whole, parts = f"regexp_extract_all(t, '{pattern}')", f"string_split_regex(t, '{pattern}')"
    start = f"CAST(COALESCE(list_sum(list_transform({parts}[1:i], lambda p: length(p))), 0) + COALESCE(list_sum(list_transform({whole}[1:i - 1], lambda p: length(p))), 0) AS BIGINT)"
    item = f"{{'s': {start}, 'r': {at}, 'e': {start} + length({whole}[i]), 'k': '{rule.kind}'}}"
    kept = f"list_filter(range(1, len({whole}) + 1), lambda i: length(regexp_extract_all(t, '{pattern}', {rule.group})[i]) >= {rule.least})"
    return f"list_transform({kept}, lambda i: {item})"


def secrets_sql(rules: tuple[Rule, ...] = BASE + ADDED) -> str:
    each = ", ".join(f"{_spans(i, r)} AS f{i}" for i, r in enumerate(rules))
    every = "list_sort(flatten([" + ", ".join(f"f{i}" for i in range(len(rules))) + "]))"
    line = lambda rows: f"COALESCE(array_to_string(list_transform({rows}, lambda x: x.k || ':' || x.s || ':' || x.e), ','), '')"
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    counts = ", ".join(f"CAST(len(f{i}) AS BIGINT) AS n_{r.kind}" for i, r in enumerate(BASE))
    return f"""WITH d AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents), f AS MATERIALIZED (SELECT doc_id, {each} FROM d), a AS MATERIALIZED (SELECT *, {every} AS found FROM f)
SELECT doc_id, {counts}, sha256({line(f"list_filter(found, lambda x: x.k IN ({base}))")}) AS base_sha256, {line("found")} AS spans FROM a"""


#: Shares are dense here: every kept term in every group of its language.
SHARE = "1 + CAST(1000000000 * (CAST({n} AS HUGEINT) + 1) // ({total} + v) AS BIGINT)"
EXCESS = "CAST((CAST({p} AS HUGEINT) - {q}) * ({p} - {q}) // {q} AS BIGINT)"
DIVERGENCE = f"""WITH d AS (SELECT COALESCE(lang, '') AS lang, COALESCE(source, '') AS source, row_number() OVER () AS r, regexp_extract_all(translate(COALESCE(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT lang, source, r, unnest(w) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, COUNT(*) AS n_lang FROM t GROUP BY lang, term HAVING COUNT(DISTINCT r) >= 3),
s AS (SELECT lang, COUNT(*) AS v, SUM(n_lang) AS total_lang FROM k GROUP BY lang),
c AS (SELECT lang, source, term, COUNT(*) AS n FROM t GROUP BY lang, source, term),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
m AS (SELECT g.lang, g.source, k.term, k.n_lang, COALESCE(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
w AS (SELECT *, SUM(n) OVER (PARTITION BY lang, source) AS total FROM m JOIN s USING (lang)),
p AS MATERIALIZED (SELECT lang, source, term, n, {SHARE.format(n="n", total="total")} AS p, {SHARE.format(n="n_lang", total="total_lang")} AS q FROM w),
b AS (SELECT a.lang, a.source, b.source AS item, SUM({EXCESS.format(p="a.p", q="b.p")}) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
e AS (SELECT a.lang, a.source, 'pair' AS part, z.source AS item, CAST(COALESCE(b.value, 0) AS BIGINT) AS value FROM g a JOIN g z ON a.lang = z.lang AND a.source <> z.source LEFT JOIN b ON a.lang = b.lang AND a.source = b.source AND z.source = b.item UNION ALL SELECT lang, source, 'term', term, {EXCESS.format(p="p", q="q")} FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM e) WHERE part = 'pair' OR rank <= 200"""


def centroids_sql(centroids: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """One pair of tables a round: the nearest centroids, and the centroids after them."""
    parts = [
        "f AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings WHERE len(embedding) = 64)",
        "v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(x, lambda y: CAST(floor(1024 * y) AS BIGINT)) AS e FROM f WHERE len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, e) - 1 AS k, e FROM (SELECT sha256('{seed}:' || vec_id) AS h, e FROM v WHERE vec_id IS NOT NULL ORDER BY h, e LIMIT {centroids}))",
    ]
    square = "list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, v.e, MIN(CAST({square} AS HUGEINT) * {centroids} + c.k) AS best FROM v CROSS JOIN c{i} c GROUP BY r, vec_id, v.e)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT best % {centroids} AS k, d, SUM(x) AS s, COUNT(*) AS n FROM (SELECT best, unnest(e) AS x, unnest(range(1, 65)) AS d FROM a{i}) GROUP BY 1, 2)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.k, COALESCE(m.e, c.e) AS e FROM c{i} c LEFT JOIN (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY d) AS e FROM s{i} GROUP BY k) m ON c.k = m.k)")
    last = f"l AS (SELECT vec_id, CAST(best % {centroids} AS INTEGER) AS cluster, CAST(best // {centroids} AS BIGINT) AS distance FROM a{rounds})"
    return f"WITH {', '.join([*parts, last])} SELECT vec_id, cluster, distance, CAST(SUM(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(SUM(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256 FROM l JOIN c{rounds} c ON l.cluster = c.k"


ORACLE_SQL = {"op2_cross_polytope": VECTORS, "op5_trigram_secrets": secrets_sql(), "op10_odd_sketch_minhash": NEAR, "op12_source_divergence": DIVERGENCE, "op13_partial_distance": centroids_sql()}
