"""DuckDB twins of the queries that SQL can express on whole tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(separators: str) -> str:
    """Lower-cased words of `text`, empty for a null."""
    return f"coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^{separators}]+'), [])"


# The rules that the url query is asked for, longest first; suffixes of two labels under which domains are registered.
URL_FILTER = rf"""
WITH rests AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rests
), labelled AS (
    SELECT p.host, CASE WHEN l.toxic = 1 OR l.quality = 0 THEN 1 WHEN l.toxic IS NULL OR l.quality IS NULL THEN NULL ELSE 0 END AS bad
    FROM parts p JOIN labels l ON l.doc_id = p.page_id
), names AS (
    SELECT host, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS labels FROM (SELECT DISTINCT host FROM parts)
), ends AS (
    SELECT host, labels, list_aggregate(labels[-1:], 'string_agg', '.') AS one, list_aggregate(labels[-2:], 'string_agg', '.') AS two,
        list_aggregate(labels[-3:], 'string_agg', '.') AS three,
        list_aggregate(labels[-2:], 'string_agg', '.') IN (
            'ac.uk', 'co.uk', 'gov.uk', 'org.uk', 'com.au', 'net.au', 'org.au', 'co.jp', 'ne.jp', 'or.jp', 'co.kr', 'co.nz', 'co.za',
            'com.ar', 'com.br', 'com.cn', 'com.mx', 'com.tr', 'com.tw', 'co.in', 'co.il') AS long
    FROM names
), placed AS (
    SELECT host, CASE WHEN long THEN three ELSE two END AS domain, CASE WHEN long THEN two ELSE one END AS suffix FROM ends
), hosts AS (
    SELECT l.host, p.domain, p.suffix, CAST(count(*) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad
    FROM labelled l JOIN placed p USING (host) WHERE bad IS NOT NULL GROUP BY ALL
), domains AS (
    SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL
), suffixes AS (
    SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL
), every AS (
    SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mean, coalesce(sum(n), 0) + 2 AS weight FROM suffixes
), suffix_prior AS (
    SELECT s.*, e.mean AS prior FROM suffixes s, every e
), suffix_k AS (
    SELECT {{strength}} AS k FROM suffix_prior
), of_suffix AS (
    SELECT suffix, (bad + k * prior) / (n + k) AS mean, n + k AS weight FROM suffix_prior, suffix_k
), domain_prior AS (
    SELECT d.*, s.mean AS prior FROM domains d JOIN of_suffix s USING (suffix)
), domain_k AS (
    SELECT {{strength}} AS k FROM domain_prior
), of_domain AS (
    SELECT domain, suffix, (bad + k * prior) / (n + k) AS mean, n + k AS weight FROM domain_prior, domain_k
), host_prior AS (
    SELECT h.*, d.mean AS prior FROM hosts h JOIN of_domain d USING (domain, suffix)
), host_k AS (
    SELECT {{strength}} AS k FROM host_prior
), of_host AS (
    SELECT host, n, (bad + k * prior) / (n + k) AS mean, n + k AS weight FROM host_prior, host_k
), chosen AS (
    SELECT p.host, CAST(coalesce(h.n, 0) AS BIGINT) AS labelled, coalesce(h.mean, d.mean, s.mean, e.mean) AS mean,
        coalesce(h.weight, d.weight, s.weight, e.weight) AS weight
    FROM placed p CROSS JOIN every e LEFT JOIN of_host h USING (host)
        LEFT JOIN of_domain d ON d.domain = p.domain AND d.suffix = p.suffix LEFT JOIN of_suffix s ON s.suffix = p.suffix
), judged AS (
    SELECT host, labelled, mean, mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) AS bound FROM chosen
), ruled AS (
    SELECT page_id, host, path, CASE
        WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
        WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
    FROM parts
)
SELECT page_id, host, path, rule,
    CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
    labelled, round(mean, 9) AS bad_mean, round(bound, 9) AS bad_bound
FROM ruled JOIN judged USING (host)
"""

_MORE, _SPREAD = "sum((n - 1) * prior * (1 - prior))", "sum(n * power(bad / n - prior, 2)) - sum(prior * (1 - prior))"
_R = f"CASE WHEN {_MORE} > 0 THEN ({_SPREAD}) / {_MORE} ELSE 0 END"
URL_FILTER = URL_FILTER.replace("{strength}", f"CASE WHEN {_R} <= 1e-6 THEN 1e6 WHEN {_R} >= 0.5 THEN 1.0 ELSE 1 / ({_R}) - 1 END")

JACCARD = rf"""
WITH RECURSIVE tokens AS (
    SELECT doc_id, {_words(r'\x20\x09-\x0D')} AS w FROM documents
), grams AS (
    SELECT DISTINCT doc_id, gram FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS gram
        FROM tokens)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM shared JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * k >= 90 * (s.n + t.n - k)
), reached AS (
    SELECT doc_id AS a, doc_id AS b FROM sizes
    UNION
    SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
), named AS (
    SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a
)
SELECT t.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.component_id, t.doc_id) AS component_id
FROM tokens t LEFT JOIN sizes s USING (doc_id) LEFT JOIN named c USING (doc_id)
"""

DECONTAMINATION = rf"""
WITH tokens AS (
    SELECT row_number() OVER () AS r, doc_id, {_words(r'\x00-\x2F\x3A-\x60\x7B-\x7F')} AS w FROM documents
), items AS (
    SELECT CAST(item_id AS VARCHAR) AS item, {_words(r'\x00-\x2F\x3A-\x60\x7B-\x7F')} AS w FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
    SELECT DISTINCT item, least(10, len(w)) AS k,
        unnest([array_to_string(w[i:i + least(10, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(10, len(w)) + 2)]) AS gram
    FROM items WHERE len(w) > 0
), spans AS (
    SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram
    FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM tokens, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
), hits AS (
    SELECT r, k, i, item FROM spans JOIN windows USING (k, gram)
), hit_words AS (
    SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(i, i + k)) AS place FROM hits) GROUP BY r
), hit_items AS (
    SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM tokens LEFT JOIN hit_words h USING (r) LEFT JOIN hit_items m USING (r)
"""

# All anchors against all rows: brute force, for checking only.
HARD_NEGATIVES = """
WITH v AS (
    SELECT CAST(vec_id AS BIGINT) AS vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x) OR abs(floor(256 * CAST(x AS DOUBLE))) >= 2147483648)) = 0
), parts AS (
    SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v
), q AS (
    SELECT vec_id, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS q FROM parts
), products AS (
    SELECT a.vec_id AS anchor_id, c.vec_id AS cand, sum(a.q * c.q) AS s FROM q a JOIN q c ON a.i = c.i WHERE a.vec_id % 100 = 0 GROUP BY ALL
), scored AS (
    SELECT a.vec_id AS anchor_id, a.label AS alabel, c.vec_id AS cand, c.label AS clabel, coalesce(p.s, 0) AS score
    FROM v a JOIN v c ON a.vec_id % 100 = 0 LEFT JOIN products p ON p.anchor_id = a.vec_id AND p.cand = c.vec_id
), pos AS (
    SELECT * FROM (
        SELECT anchor_id, alabel, cand AS positive_id, score AS positive_score,
            row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, cand) AS k
        FROM scored WHERE clabel = alabel AND cand <> anchor_id
    ) WHERE k <= 5
), neg AS (
    SELECT p.anchor_id, p.positive_id, p.positive_score, s.cand AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.cand) AS rank
    FROM pos p JOIN scored s ON s.anchor_id = p.anchor_id AND s.clabel <> p.alabel
        AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 5
"""
