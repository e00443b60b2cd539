"""DuckDB SQL for the queries that SQL can express. The classifier, the encoder and the packing have none."""

from __future__ import annotations

from kindred.llm import licenses, urls

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

TOPK = """WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

NEAR = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) END s FROM w),
u AS MATERIALIZED (SELECT doc_id, len(s) n, unnest(s) x FROM s),
links AS MATERIALIZED (SELECT a.doc_id i, b.doc_id j FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
ends AS MATERIALIZED (SELECT i, j FROM links UNION ALL SELECT j, i FROM links),
reach(i, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT ends.j, reach.c FROM reach JOIN ends ON ends.i = reach.i WHERE reach.c < ends.j),
comp AS (SELECT i, min(c) c FROM reach GROUP BY i)
SELECT s.doc_id, len(s.s)::BIGINT n_shingles, comp.c component_id, s.doc_id = comp.c kept FROM s JOIN comp ON comp.i = s.doc_id"""

EXACT = """WITH t AS (SELECT doc_id, coalesce(text, '') t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) keep_id, count(*) OVER (PARTITION BY t) group_size, doc_id = max(doc_id) OVER (PARTITION BY t) kept, sha256(t) text_sha256 FROM t"""

_ESCAPED = "replace(replace(replace({0}, '\\', '\\\\'), '###', '\\###'), '</turn>', '\\</turn>')"
CHAT = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') text FROM conversations
UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok'))
SELECT conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) loss_sha256,
sum(4 + length(replace({_ESCAPED.format('role')}, ':', '\\:')) + 2 + length({_ESCAPED.format('text')}) + 8)::BIGINT formatted_chars FROM t GROUP BY conv_id"""


def link_trust(rules: list[tuple[str, str]]) -> str:
    """Rules and all rounds of trust and distrust, one after the other."""
    fits = [f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN {{'rule': '{r}', 'verdict': '{v}'}}" for v, r in sorted(rules, key=lambda x: (-len(x[1]), x[1]))]
    url = "(?s)^.*?://([^/?#]*)([^?#]*)"
    low = lambda x: f"translate({x}, '{_UPPER}', '{_LOWER}')"
    d = urls.DAMPING
    out = [
        f"WITH p AS MATERIALIZED (SELECT page_id, {low(f"coalesce(regexp_extract(url, '{url}', 1), '')")} host, coalesce(regexp_extract(url, '{url}', 2), '') path, html FROM pages)",
        f"j AS MATERIALIZED (SELECT *, CASE {' '.join(fits)} END r FROM p)",
        "a AS (SELECT host src, unnest(list_distinct(regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*[\"'']?([^\"''\\s>]+)', 1))) link FROM p WHERE host <> '')",
        f"b AS (SELECT src, {low(f"regexp_extract(CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END, '{url}', 1)")} dst FROM a WHERE regexp_matches(link, '{urls.ABSOLUTE}'))",
        "e AS MATERIALIZED (SELECT src, dst, count(*) n FROM b WHERE dst <> '' AND src <> dst GROUP BY ALL)",
        "g AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) fw, n / sum(n) OVER (PARTITION BY dst) bw FROM e)",
        "s AS (SELECT host, count(*) FILTER (r.verdict = 'allow') / count(*) t0, count(*) FILTER (r.verdict = 'block') / count(*) b0 FROM j WHERE host <> '' GROUP BY host)",
        "h AS MATERIALIZED (SELECT host, coalesce(t0, 0) t0, coalesce(b0, 0) b0 FROM (SELECT host FROM s UNION SELECT src FROM e UNION SELECT dst FROM e) LEFT JOIN s USING (host))",
        f"k0 AS MATERIALIZED (SELECT host, {1 - d} * t0 t, {1 - d} * b0 b FROM h)",
    ]
    for k in range(1, urls.ROUNDS + 1):
        out.append(f"f{k} AS (SELECT dst host, sum(t * fw) x FROM g JOIN k{k - 1} k ON k.host = g.src GROUP BY dst)")
        out.append(f"r{k} AS (SELECT src host, sum(b * bw) x FROM g JOIN k{k - 1} k ON k.host = g.dst GROUP BY src)")
        out.append(f"k{k} AS MATERIALIZED (SELECT h.host, {1 - d} * t0 + {d} * coalesce(f{k}.x, 0) t, {1 - d} * b0 + {d} * coalesce(r{k}.x, 0) b FROM h LEFT JOIN f{k} ON f{k}.host = h.host LEFT JOIN r{k} ON r{k}.host = h.host)")
    last = f"k{urls.ROUNDS}"
    return ",\n".join(out) + f"\nSELECT page_id, j.host, path, j.r.rule AS rule, coalesce(j.r.verdict, CASE WHEN {last}.b - {last}.t > {(1 - d) / 2} THEN 'block' ELSE 'allow' END) verdict FROM j LEFT JOIN {last} ON {last}.host = j.host"


def license_windows(templates: dict[str, str]) -> str:
    """All windows of all texts against all templates."""
    parts = []
    for name, shingles, k, stride, width in licenses.shapes(templates):
        own = "[" + ", ".join(f"'{' '.join(s)}'" for s in shingles) + "]"
        parts.append(
            f"SELECT doc_id, '{name}' license, a AS pos, len(list_intersect(h[a + 1 : a + {width}], {own})) / {len(shingles)} c FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) - {width}, 0) + {stride}, {stride})) a FROM h{k} WHERE len(list_intersect(h, {own})) > 0)"
        )
    ks = sorted({x[2] for x in licenses.shapes(templates)})
    grams = ", ".join(f"h{k} AS MATERIALIZED (SELECT doc_id, list_transform(generate_series(1, len(w) - {k - 1}), lambda i: array_to_string(w[i : i + {k - 1}], ' ')) h FROM w WHERE len(w) >= {k})" for k in ks)
    words = "w AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') w FROM documents)"
    return f"WITH {words}, {grams}, c AS ({' UNION ALL '.join(parts)}) SELECT doc_id, license, max(c) containment, min(pos)::INT first_word, count(*) n_windows FROM c WHERE c >= {licenses.CONTAINED} GROUP BY doc_id, license"
