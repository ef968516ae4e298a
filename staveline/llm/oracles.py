"""DuckDB SQL for the queries that SQL can express, written from their definitions."""

from __future__ import annotations

MINHASH = r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
          ELSE list_transform(generate_series(1, len(words) - 2), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS shingle FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * common >= 85 * (nx.n + ny.n - common)),
    e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    r(node, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, reach FROM r JOIN e ON r.node = e.x),
    c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept
    FROM documents LEFT JOIN n USING (doc_id) JOIN c ON c.node = doc_id"""

WARC = """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
    k AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS keeper FROM p),
    b AS (SELECT *, array_to_string(list_transform(range(20), lambda i: lpad(bin(('0x' || substr(hex, 2 * CAST(i AS INT) + 1, 2))::INT), 8, '0')), '') AS bits FROM k)
    SELECT page_id, octet_length(payload) AS payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(5),
               lambda j: CAST(substr(bits, 5 * CAST(i AS INT) + CAST(j AS INT) + 1, 1) AS INT) * CAST(power(2, 4 - j) AS INT))) AS INT), 1)), '') AS payload_digest,
           CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM b"""

EMBEDDINGS = """
    WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL),
    l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.98),
    r(node, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.y, reach FROM r JOIN l ON r.node = l.x)
    SELECT node AS vec_id, coalesce(n, 0) AS n_links, min(reach) AS component_id, min(reach) = node AS kept
    FROM r LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) ON x = node GROUP BY node, n"""


def url_templates(rules: list[tuple[str, str, str]], depth: int = 3) -> str:
    """The rules and the template tree of the url query."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in ordered]
    rule = "CASE " + " ".join(f"{w} THEN '{h + p}'" for w, (_, h, p) in zip(fits, ordered, strict=True)) + " END"
    told = "CASE " + " ".join(f"{w} THEN '{v}'" for w, (v, _, _) in zip(fits, ordered, strict=True)) + " END"
    parts = [r"""
    WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    q AS (SELECT *, regexp_replace(path, '[0-9]+', '#', 'g') AS shape, TRY_CAST(nullif(regexp_extract(path, '([0-9]+)[^/0-9]*/?$', 1), '') AS BIGINT) AS number FROM u),
    b AS (SELECT doc_id, min(quality) = 0 AS bad FROM labels GROUP BY doc_id),
    y AS (SELECT q.*, bad FROM q LEFT JOIN b ON doc_id = number),
    t0 AS (SELECT host, shape, count(*) AS n, count(bad) AS labelled, count(*) FILTER (bad) AS bad,
                  list_filter(string_split(shape, '/'), lambda x: x <> '') AS parts, CAST([] AS VARCHAR[]) AS levels FROM y GROUP BY host, shape)"""]
    for k in range(depth):
        parts.append(f"""
    a{k} AS (SELECT *, array_to_string(levels, '/') AS prefix, parts[{k + 1}] AS part FROM t{k}),
    n{k} AS (SELECT host, prefix, part, sum(n) AS r FROM a{k} WHERE part IS NOT NULL GROUP BY ALL),
    k{k} AS (SELECT *, r >= 5 AND r >= 0.01 * sum(r) OVER (PARTITION BY host, prefix) AS literal FROM n{k}),
    t{k + 1} AS (SELECT a.host, shape, n, labelled, bad, parts, CASE WHEN a.part IS NULL THEN levels WHEN literal THEN list_append(levels, a.part)
                 ELSE list_append(levels, '*') END AS levels FROM a{k} a LEFT JOIN k{k} k ON k.host = a.host AND k.prefix = a.prefix AND k.part = a.part)""")
    parts.append(f"""
    m{depth} AS (SELECT host, shape, labelled, bad, CASE WHEN len(parts) > {depth} THEN list_append(levels, '**') ELSE levels END AS levels FROM t{depth})""")
    for k in range(depth, 0, -1):
        parts.append(f"""
    e{k} AS (SELECT *, array_to_string(levels[1:{k - 1}], '/') AS parent, levels[{k}] AS branch FROM m{k}),
    o{k} AS (SELECT host, parent, branch, sum(labelled) AS own_n, sum(bad) AS own_bad FROM e{k} WHERE branch IS NOT NULL GROUP BY ALL),
    f{k} AS (SELECT *, sum(own_n) OVER w AS all_n, sum(own_bad) OVER w AS all_bad FROM o{k} WINDOW w AS (PARTITION BY host, parent)),
    g{k} AS (SELECT *, all_n - own_n AS rest_n, all_bad - own_bad AS rest_bad, all_bad / greatest(all_n, 1) AS p FROM f{k}),
    h{k} AS (SELECT host, parent, branch, own_n > 0 AND rest_n > 0 AND power(own_bad / greatest(own_n, 1) - rest_bad / greatest(rest_n, 1), 2)
                    > 1.96 * 1.96 * p * (1 - p) * (1 / greatest(own_n, 1) + 1 / greatest(rest_n, 1)) AS apart FROM g{k}),
    m{k - 1} AS (SELECT e.host, shape, labelled, bad, CASE WHEN NOT apart THEN list_concat(list_concat(levels[1:{k - 1}], ['+']), levels[{k + 1}:]) ELSE levels END AS levels
                 FROM e{k} e LEFT JOIN h{k} h ON h.host = e.host AND h.parent = e.parent AND h.branch = e.branch)""")
    parts.append("""
    z AS (SELECT *, '/' || array_to_string(levels, '/') AS template FROM m0),
    r AS (SELECT sum(bad) / greatest(sum(labelled), 1) AS base FROM z),
    x AS (SELECT host, template, (sum(bad) + 4 * any_value(base)) / (sum(labelled) + 4) AS purity FROM z, r GROUP BY host, template)""")
    return ",".join(parts) + f"""
    SELECT page_id, y.host, path, {rule.replace("host", "y.host")} AS rule, z.template, round(purity, 9) AS purity,
           coalesce({told.replace("host", "y.host")}, CASE WHEN purity >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict
    FROM y JOIN z ON z.host = y.host AND z.shape = y.shape JOIN x ON x.host = y.host AND x.template = z.template"""
