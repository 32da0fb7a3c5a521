"""The queries in SQL for DuckDB, written apart from the DataFrame code: walks are joined whole, nothing is shared."""

from __future__ import annotations

import re

from strikegraph.functions.columns import DECAYS
from strikegraph.sources.star_schema import EDGES, KEYED, MORE, TYPES, VALUES, base, etype

STOP, HOPS = 0.85, 8
#: No walk of the sampled relevance takes more steps.
WALK_STEPS = 14


def _forward() -> str:
    out = []
    for name, src, dst, table, a, b in EDGES + MORE:
        if dst in VALUES:
            vt, vc = VALUES[dst]
            out.append(f"SELECT {a} + {base(src)} AS src, {etype(name)} AS etype, v.nid AS dst FROM {table} JOIN (SELECT DISTINCT {vc} AS value, {base(dst)} + dense_rank() OVER (ORDER BY {vc}) AS nid FROM {vt}) v ON v.value = {table}.{b}")
        else:
            out.append(f"SELECT {a} + {base(src)} AS src, {etype(name)} AS etype, {b}::BIGINT + {base(dst)} AS dst FROM {table}")
    return "\nUNION ".join(out)


def _nodes() -> str:
    out = []
    for kind in TYPES:
        if kind in VALUES:
            t, c = VALUES[kind]
            out.append(f"SELECT DISTINCT {base(kind)} + dense_rank() OVER (ORDER BY {c}) AS nid, '{kind}/' || {c} AS iri, '{kind}' AS kind FROM {t}")
        else:
            t, c = KEYED[kind]
            out.append(f"SELECT {c} + {base(kind)} AS nid, '{kind}/' || {c} AS iri, '{kind}' AS kind FROM {t}")
    return "\nUNION ALL ".join(out)


def _d(level: str) -> str:
    return "(CASE " + level + " ".join(f" WHEN {i} THEN {x!r}" for i, x in enumerate(DECAYS[:5])) + " END)"


CTES = {
    "fwd": f"SELECT DISTINCT src::BIGINT AS src, etype, dst::BIGINT AS dst FROM ({_forward()}) WHERE src <> dst",
    "edges": "SELECT src, etype, dst FROM fwd UNION ALL SELECT dst, etype + 1, src FROM fwd",
    "knodes": _nodes(),
    "nodes": "SELECT nid::BIGINT AS nid, iri FROM knodes",
    "ntypes": "SELECT nid::BIGINT AS nid, type FROM knodes JOIN (VALUES " + ", ".join(f"('{k}', '{t}')" for k, ts in TYPES.items() for t in ts) + ") t(kind, type) USING (kind)",
    "names": "SELECT * FROM (VALUES " + ", ".join(f"({2 * i + r}, '{'r-' if r else ''}{e[0]}')" for i, e in enumerate(EDGES) for r in (0, 1)) + ") t(etype, name)",
    "degree": "SELECT src AS nid, count(*) AS degree FROM edges GROUP BY src",
    "q": f"""SELECT 1 AS qid, c_custkey + {base("cust")} AS target, n_regionkey + {base("region")} AS context FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = (SELECT min(c_custkey) FROM customer WHERE c_custkey >= 2)
        UNION ALL SELECT 2, c_custkey + {base("cust")}, c_nationkey + {base("nation")} FROM customer WHERE c_custkey = (SELECT min(c_custkey) FROM customer WHERE c_custkey >= 2)
        UNION ALL SELECT 3, s_suppkey + {base("supp")}, s_nationkey + {base("nation")} FROM supplier WHERE s_suppkey = (SELECT min(s_suppkey) FROM supplier WHERE s_suppkey >= 1)
        UNION ALL SELECT 4, p_partkey + {base("part")}, (SELECT count(DISTINCT p_brand) FROM part b WHERE b.p_brand < a.p_brand) + {base("brand") + 1} FROM part a WHERE p_partkey = (SELECT min(p_partkey) FROM part WHERE p_partkey >= 5)""",
    "moves": "SELECT src, dst, count(*) / any_value(degree) AS w FROM edges JOIN degree ON src = nid GROUP BY src, dst",
    "m0": "SELECT DISTINCT context, context AS nid, 1.0::DOUBLE AS mass FROM q",
    **{f"m{k}": f"SELECT context, dst AS nid, sum(mass * w) AS mass FROM m{k - 1} JOIN moves ON nid = src GROUP BY context, dst" for k in range(1, HOPS + 1)},
    "rel": "SELECT context, nid, round(sum(s), 12) AS score FROM (" + " UNION ALL ".join(f"SELECT context, nid, mass * {STOP * (1 - STOP) ** k!r} AS s FROM m{k}" for k in range(HOPS + 1)) + ") GROUP BY context, nid HAVING round(sum(s), 12) >= 1e-6",
    # A million walks from each context, by number and step.
    "numbered": "SELECT src, dst, row_number() OVER (ORDER BY src, etype, dst) - 1 AS place FROM edges",
    "spans": "SELECT src AS nid, min(place) AS first, count(*) AS degree FROM numbered GROUP BY src",
    "w0": "SELECT context, t.walk, context AS nid FROM (SELECT DISTINCT context FROM q), range(1, 1000001) t(walk)",
    **{f"d{k}": f"SELECT context, walk, nid, CASE WHEN degree IS NOT NULL AND ('0x' || substr(d, 1, 13))::BIGINT / 4503599627370496.0 >= {STOP} THEN first + floor(('0x' || substr(d, 14, 13))::BIGINT / 4503599627370496.0 * degree)::BIGINT END AS place "
       f"FROM (SELECT *, md5('1:' || context || ':' || walk || ':{k}') AS d FROM w{k}) LEFT JOIN spans USING (nid)" for k in range(WALK_STEPS)},
    **{f"w{k + 1}": f"SELECT context, walk, dst AS nid FROM d{k} JOIN numbered USING (place)" for k in range(WALK_STEPS - 1)},
    "trel": "SELECT qid, type, round(sum(coalesce(score, 0)) / count(*), 12) AS score FROM q JOIN ntypes n ON n.nid <> target LEFT JOIN rel ON rel.context = q.context AND rel.nid = n.nid GROUP BY qid, type HAVING sum(score) IS NOT NULL",
    "best": "SELECT qid, nid, type FROM (SELECT qid, nid, type, row_number() OVER (PARTITION BY qid, nid ORDER BY score DESC, type) AS r FROM trel JOIN ntypes USING (type) WHERE score > 0) WHERE r = 1",
    "inn": "SELECT context, nid FROM rel WHERE nid IN (SELECT nid FROM ntypes)",
    "p2": "SELECT qid, target, q.context, e0.etype AS e0 FROM q JOIN edges e0 ON e0.src = target AND e0.dst = q.context",
    "p3": """SELECT qid, target, q.context, e0.etype AS e0, e0.dst AS x, e1.etype AS e1 FROM q JOIN edges e0 ON e0.src = target JOIN edges e1 ON e1.src = e0.dst AND e1.dst = q.context
        WHERE e0.dst <> target AND e0.dst <> q.context AND (q.context, e0.dst) IN (SELECT context, nid FROM inn)""",
    "p4": """SELECT qid, target, q.context, e0.etype AS e0, e0.dst AS x, e1.etype AS e1, e1.dst AS y, e2.etype AS e2
        FROM q JOIN edges e2 ON e2.dst = q.context JOIN edges e0 ON e0.src = target JOIN edges e1 ON e1.src = e0.dst AND e1.dst = e2.src
        WHERE e0.dst NOT IN (target, q.context) AND e1.dst NOT IN (target, q.context) AND e0.dst <> e1.dst
          AND (q.context, e0.dst) IN (SELECT context, nid FROM inn) AND (q.context, e1.dst) IN (SELECT context, nid FROM inn)""",
    "paths": """SELECT qid, target, context, 2 AS n, [target, context] AS nodes, [e0] AS etypes FROM p2
        UNION ALL SELECT qid, target, context, 3, [target, x, context], [e0, e1] FROM p3 UNION ALL SELECT qid, target, context, 4, [target, x, y, context], [e0, e1, e2] FROM p4""",
    "pnodes": "SELECT qid, context, n, nodes, etypes, unnest(nodes) AS nid, unnest(range(n)) AS pos FROM paths",
    "pscore": f"SELECT qid, context, n, nodes, etypes, round(min(coalesce(score, 0) * {_d('pos')}), 12) AS path_score FROM pnodes LEFT JOIN rel USING (context, nid) GROUP BY ALL HAVING round(min(coalesce(score, 0) * {_d('pos')}), 12) > 0",
    "live": "SELECT * FROM q WHERE (context, target) IN (SELECT context, nid FROM rel)",
    "nl": "SELECT nid, 'T:' || type AS label FROM ntypes UNION ALL SELECT nid, 'I:' || nid FROM nodes",
    # Patterns with a label for each position; * stands for any node.
    "lab": "SELECT s.*, b.type FROM (SELECT DISTINCT qid, nid FROM pnodes) s JOIN best b USING (qid, nid)",
    "lpat_all": """SELECT qid, context, n, l0, e0, l1, e1, l2, e2, max(path_score) AS path_score,
               l0 || '|' || e0 || '|' || CASE n WHEN 2 THEN '' WHEN 3 THEN l1 || '|' || e1 || '|' ELSE l1 || '|' || e1 || '|' || l2 || '|' || e2 || '|' END || 'I:' || context AS pattern
        FROM (SELECT p.qid, p.context, n, 'T:' || t0.type AS l0, etypes[1] AS e0, NULL AS l1, NULL::INT AS e1, NULL AS l2, NULL::INT AS e2, path_score FROM pscore p JOIN lab t0 ON t0.qid = p.qid AND t0.nid = nodes[1] WHERE n = 2
              UNION ALL SELECT p.qid, p.context, n, 'T:' || t0.type, etypes[1], unnest(['T:' || t1.type, 'I:' || nodes[2]]), etypes[2], NULL, NULL, path_score
              FROM pscore p JOIN lab t0 ON t0.qid = p.qid AND t0.nid = nodes[1] JOIN lab t1 ON t1.qid = p.qid AND t1.nid = nodes[2] WHERE n = 3
              UNION ALL SELECT p.qid, p.context, n, 'T:' || t0.type, etypes[1], a.l, etypes[2], b.l, etypes[3], path_score
              FROM pscore p JOIN lab t0 ON t0.qid = p.qid AND t0.nid = nodes[1] JOIN lab t1 ON t1.qid = p.qid AND t1.nid = nodes[2] JOIN lab t2 ON t2.qid = p.qid AND t2.nid = nodes[3],
                   unnest(['T:' || t1.type, 'I:' || nodes[2]]) a(l), unnest(['T:' || t2.type, 'I:' || nodes[3]]) b(l) WHERE n = 4)
        GROUP BY ALL""",
    "lpat": "SELECT * FROM lpat_all WHERE n >= 3 AND (qid IN (SELECT qid FROM live))",
    # Edge types only: the target counts as 1 and the context not at all.
    "uscore": f"SELECT qid, context, n, nodes, etypes, round(min(CASE WHEN pos = 0 OR pos = n - 1 THEN 1.0 ELSE coalesce(score, 0) * {_d('pos')} END), 12) AS path_score FROM pnodes LEFT JOIN rel USING (context, nid) WHERE qid IN (SELECT qid FROM live) GROUP BY ALL",
    "upat": "SELECT qid, context, n, '*' AS l0, etypes[1] AS e0, '*' AS l1, etypes[2] AS e1, '*' AS l2, etypes[3] AS e2, max(path_score) AS path_score, array_to_string(etypes, '-') AS pattern FROM uscore WHERE path_score > 0 GROUP BY ALL",
    "anyl": "SELECT nid, '*' AS label FROM nodes",
}

#: Templates over a table of patterns {p} and of labels {l}.
MATCH = {
    "{p}_w2": "SELECT p.qid, p.pattern, a.src AS v0, p.context AS v1 FROM {p} p JOIN edges a ON a.dst = p.context AND a.etype = p.e0 JOIN {l} l0 ON l0.nid = a.src AND l0.label = p.l0 WHERE n = 2",
    "{p}_w3": """SELECT DISTINCT p.qid, p.pattern, a.src AS v0, b.src AS v1, p.context AS v2 FROM {p} p JOIN edges b ON b.dst = p.context AND b.etype = p.e1 JOIN {l} l1 ON l1.nid = b.src AND l1.label = p.l1
        JOIN edges a ON a.dst = b.src AND a.etype = p.e0 JOIN {l} l0 ON l0.nid = a.src AND l0.label = p.l0 WHERE n = 3""",
    "{p}_w4": """SELECT DISTINCT p.qid, p.pattern, a.src AS v0, b.src AS v1, c.src AS v2, p.context AS v3 FROM {p} p JOIN edges c ON c.dst = p.context AND c.etype = p.e2 JOIN {l} l2 ON l2.nid = c.src AND l2.label = p.l2
        JOIN edges b ON b.dst = c.src AND b.etype = p.e1 JOIN {l} l1 ON l1.nid = b.src AND l1.label = p.l1 JOIN edges a ON a.dst = b.src AND a.etype = p.e0 JOIN {l} l0 ON l0.nid = a.src AND l0.label = p.l0 WHERE n = 4""",
    "{p}_all": "SELECT qid, pattern, level, nid FROM (" + " UNION ALL ".join(f"SELECT qid, pattern, {i} AS level, v{i} AS nid FROM {{p}}_w{n}" for n in (2, 3, 4) for i in range(n)) + ") GROUP BY ALL",
    "{p}_m": "SELECT * FROM {p}_all WHERE (qid, pattern) IN (SELECT (qid, pattern) FROM {p}_all WHERE level = 0 GROUP BY qid, pattern HAVING count(*) >= 5)",
    "{p}_lv": "SELECT m.qid, m.pattern, level, p.n, path_score, sum(coalesce(score, 0)) AS s, count(*) AS c FROM {p}_m m JOIN {p} p USING (qid, pattern) LEFT JOIN rel r ON r.context = p.context AND r.nid = m.nid WHERE {where} GROUP BY ALL",
    "{p}_rel": "SELECT qid, pattern, n AS n_nodes, round(least(min(round(s / c, 12) * " + _d("level") + "), path_score), 10) AS relevance, coalesce(max(c) FILTER (WHERE level = 0), 0) AS n_peers FROM {p}_lv GROUP BY qid, pattern, n, path_score",
    "{p}_rank": "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, n_nodes, pattern) AS rank FROM {p}_rel",
    "{p}_top": "SELECT * FROM {p}_rank WHERE {keep}",
    "{p}_peers": "SELECT qid, pattern, nid FROM {p}_m WHERE level = 0 AND (qid, pattern) IN (SELECT (qid, pattern) FROM {p}_top)",
}
#: Templates over peers {p}_peers(qid, pattern, nid).
FACTS = {
    "{p}_size": "SELECT qid, pattern, count(*) AS n_peers FROM {p}_peers GROUP BY qid, pattern",
    "{p}_elig": "SELECT p.qid, p.pattern, e.etype, count(DISTINCT p.nid) AS n_have, any_value(n_peers) AS n_peers FROM {p}_peers p JOIN {p}_size USING (qid, pattern) JOIN edges e ON e.src = p.nid JOIN asked a ON a.qid = p.qid AND a.etype = e.etype GROUP BY p.qid, p.pattern, e.etype HAVING count(DISTINCT p.nid) >= {cov} * any_value(n_peers)",
    "{p}_gelig": "SELECT s.qid, s.pattern, a.etype, n_have, n_peers FROM {p}_size s JOIN asked a USING (qid) JOIN (SELECT etype, count(DISTINCT src) AS n_have FROM edges GROUP BY etype) g ON g.etype = a.etype WHERE n_have >= {cov} * n_peers",
    "{p}_val": """SELECT p.qid, p.pattern, f.etype, f.value, CASE WHEN h.dst IS NOT NULL OR p.nid = f.target THEN f.value ELSE fv.value END AS x
        FROM {p}_peers p JOIN {p}_{elig} g USING (qid, pattern) JOIN tf f ON f.qid = p.qid AND f.etype = g.etype JOIN firsts fv ON fv.src = p.nid AND fv.etype = f.etype
        LEFT JOIN edges h ON h.src = p.nid AND h.etype = f.etype AND h.dst = f.value WHERE p.nid <> f.target
        UNION ALL SELECT g.qid, g.pattern, f.etype, f.value, f.value FROM {p}_{elig} g JOIN tf f ON f.qid = g.qid AND f.etype = g.etype""",
    "{p}_freq": "SELECT qid, pattern, etype, value, x, count(*) AS f FROM {p}_val GROUP BY ALL",
    "{p}_strike": """SELECT a.qid, a.pattern, a.etype, a.value, CASE WHEN sum(a.f) < {least} THEN 0 ELSE round(coalesce(sum(a.f) FILTER (WHERE a.f > o.f), 0) / sum(a.f), 10) END AS strikingness, any_value(o.f) AS value_freq,
        arg_min(a.x, (-a.f, a.x)) AS top_value, max(a.f) AS top_freq, sum(a.f)::BIGINT AS population
        FROM {p}_freq a JOIN {p}_freq o ON o.qid = a.qid AND o.pattern = a.pattern AND o.etype = a.etype AND o.value = a.value AND o.x = o.value GROUP BY a.qid, a.pattern, a.etype, a.value""",
}
CTES |= {
    "tf": "SELECT qid, target, etype, dst AS value FROM q JOIN edges ON src = target",
    "asked": "SELECT DISTINCT qid, etype FROM tf",
    "nbr": "SELECT src, etype, dst, row_number() OVER (PARTITION BY src, etype ORDER BY degree DESC, dst DESC) AS pos FROM edges JOIN degree ON dst = nid",
    "firsts": "SELECT src, etype, dst AS value FROM nbr WHERE pos = 1",
}


def _family(name: str, source: str, labels: str, where: str = "true", keep: str = "rank <= 20", cov: float = 0.8, elig: str = "elig", least: int = 0) -> None:
    CTES[name] = f"SELECT * FROM {source}"
    fill = lambda t: t.replace("{p}", name).replace("{l}", labels).replace("{where}", where).replace("{keep}", keep).replace("{cov}", repr(cov)).replace("{elig}", elig).replace("{least}", str(least))
    CTES.update({fill(k): fill(t) for k, t in {**MATCH, **FACTS}.items()})


_family("bi", "lpat", "nl")
_family("th", "lpat", "nl", keep="relevance >= 1e-6")
_family("re", "upat", "anyl", where="level < p.n - 1 AND m.nid <> p.context", least=5)
_family("gu", "upat", "anyl", where="level < p.n - 1 AND m.nid <> p.context", elig="gelig", least=5)
CTES |= {
    "dv": "SELECT r.*, list_aggregate([l for l in [l0, l1, l2] if l IS NOT NULL], 'string_agg', '|') AS ls FROM bi_rel r JOIN bi USING (qid, pattern)",
    "bi_bounds": """SELECT p.qid, p.pattern, n AS n_nodes, c AS n_peers, round(path_score, 10) AS path_bound, round(round(s / c, 12), 10) AS peer_bound
        FROM bi p JOIN (SELECT p.qid, p.pattern, count(*) AS c, sum(coalesce(score, 0)) AS s FROM bi_all m JOIN bi p USING (qid, pattern) LEFT JOIN rel r ON r.context = p.context AND r.nid = m.nid WHERE level = 0 GROUP BY p.qid, p.pattern) USING (qid, pattern)""",
    "waves": """SELECT preset, qid, bound, relevance, row_number() OVER (PARTITION BY preset, qid ORDER BY bound DESC, pattern) AS r, row_number() OVER (PARTITION BY preset, qid ORDER BY relevance DESC, n_nodes, pattern) AS top
        FROM (SELECT preset, b.qid, b.pattern, b.n_nodes, relevance, least(CASE WHEN preset IN ('path scores', 'both') THEN path_bound ELSE 'inf'::DOUBLE END, CASE WHEN preset IN ('peer means', 'both') THEN peer_bound ELSE 'inf'::DOUBLE END) AS bound
              FROM bi_bounds b JOIN bi_rel USING (qid, pattern), (VALUES ('none'), ('path scores'), ('peer means'), ('both')) t(preset))""",
    "kths": "SELECT preset, qid, min(relevance) AS kth FROM (SELECT preset, qid, relevance, row_number() OVER (PARTITION BY preset, qid ORDER BY relevance DESC) AS o FROM waves WHERE r <= 40) WHERE o <= 20 GROUP BY preset, qid HAVING count(*) = 20",
    # Peers by one hop.
    "oh_all": "SELECT f.qid, f.etype, f.value, e.src AS nid FROM tf f JOIN edges e ON e.etype = f.etype AND e.dst = f.value",
    "oh_peers": "SELECT qid, etype || '=' || value AS pattern, nid FROM oh_all WHERE (qid, etype, value) IN (SELECT (qid, etype, value) FROM oh_all GROUP BY qid, etype, value HAVING count(*) >= 5)",
    # Blind: sequences of up to two edges from the target, by end.
    "b1": "SELECT DISTINCT qid, target, e.etype AS e0, e.dst AS w FROM q JOIN edges e ON e.src = target",
    "b2": "SELECT DISTINCT qid, a.etype AS e0, b.etype AS e1, b.dst AS w FROM q JOIN edges a ON a.src = target JOIN edges b ON b.src = a.dst WHERE b.dst <> target AND a.dst <> target",
    "bn_all": """SELECT DISTINCT qid, e0 || '>I:' || w AS pattern, e.src AS nid FROM b1 JOIN edges e ON e.etype = e0 AND e.dst = w
        UNION ALL SELECT DISTINCT qid, e0 || '-' || e1 || '>I:' || w, a.src FROM b2 JOIN edges b ON b.etype = e1 AND b.dst = w JOIN edges a ON a.etype = e0 AND a.dst = b.src""",
    "bn_peers": "SELECT * FROM bn_all WHERE (qid, pattern) IN (SELECT (qid, pattern) FROM bn_all GROUP BY qid, pattern HAVING count(*) >= 5)",
    "lab1": "SELECT nid, coalesce(min(type), 'ANY') AS label FROM nodes LEFT JOIN ntypes USING (nid) GROUP BY nid",
    "bt1": "SELECT DISTINCT qid, e0, label FROM b1 JOIN lab1 ON nid = w",
    "bt2": "SELECT DISTINCT qid, e0, e1, label FROM b2 JOIN lab1 ON nid = w",
    "inany": "SELECT nid, type AS label FROM ntypes UNION ALL SELECT nid, 'ANY' FROM nodes",
    "bt_all": """SELECT DISTINCT qid, e0 || '>T:' || t.label AS pattern, e.src AS nid FROM bt1 t JOIN edges e ON e.etype = e0 JOIN inany i ON i.nid = e.dst AND i.label = t.label
        UNION ALL SELECT DISTINCT qid, e0 || '-' || e1 || '>T:' || label, a.src FROM bt2 JOIN (SELECT DISTINCT b.etype, b.src, i.label AS bl FROM edges b JOIN inany i ON i.nid = b.dst) b ON b.etype = e1 AND b.bl = label JOIN edges a ON a.etype = e0 AND a.dst = b.src""",
    "bt_peers": "SELECT * FROM bt_all WHERE (qid, pattern) IN (SELECT (qid, pattern) FROM bt_all GROUP BY qid, pattern HAVING count(*) >= 5)",
    "sp": "SELECT src, etype, 1.0 / count(*) AS spread FROM edges GROUP BY src, etype",
    "se": "SELECT e.src, e.etype, e.dst, a.spread, b.spread AS back FROM edges e JOIN sp a USING (src, etype) JOIN sp b ON b.src = e.dst AND b.etype = xor(e.etype, 1)",
    "pp": """SELECT qid, target AS source, CAST(etype AS VARCHAR) AS etypes, dst AS nid, sum(spread) AS f, sum(back) AS b FROM q JOIN se ON src = target GROUP BY qid, target, etype, dst
        UNION ALL SELECT qid, target, a.etype || '-' || b.etype, b.dst, sum(a.spread * b.spread), sum(a.back * b.back) FROM q JOIN se a ON a.src = target JOIN se b ON b.src = a.dst WHERE b.dst <> target GROUP BY qid, target, a.etype, b.etype, b.dst""",
    "prob": "SELECT qid, source, etypes, nid, round(f, 10) AS forward, round(b, 10) AS backward, round((f + b) / 2, 10) AS score FROM pp",
    "pp3": """SELECT * FROM pp UNION ALL SELECT qid, target, a.etype || '-' || b.etype || '-' || c.etype, c.dst, sum(a.spread * b.spread * c.spread), sum(a.back * b.back * c.back)
        FROM q JOIN se a ON a.src = target JOIN se b ON b.src = a.dst JOIN se c ON c.src = b.dst WHERE b.dst <> target AND c.dst <> a.dst GROUP BY qid, target, a.etype, b.etype, c.etype, c.dst""",
    "prob3": "SELECT qid, source, etypes, nid, round(f, 10) AS forward, round(b, 10) AS backward, round((f + b) / 2, 10) AS score FROM pp3",
    "sup1": "SELECT etype AS e0, count(DISTINCT dst) AS n FROM edges GROUP BY etype",
    "sup2": "SELECT a.etype AS e0, b.etype AS e1, count(DISTINCT b.dst) AS n FROM (SELECT DISTINCT etype, dst FROM edges) a JOIN edges b ON b.src = a.dst GROUP BY a.etype, b.etype",
    "sup3": "SELECT e0, e1, c.etype AS e2, count(DISTINCT c.dst) AS n FROM (SELECT DISTINCT a.etype AS e0, b.etype AS e1, b.dst FROM (SELECT DISTINCT etype, dst FROM edges) a JOIN edges b ON b.src = a.dst) ab JOIN edges c ON c.src = ab.dst GROUP BY e0, e1, c.etype",
    "support3": "SELECT * FROM support UNION ALL SELECT sup3.e0 || '-' || sup3.e1 || '-' || e2, least(sup1.n, sup2.n, sup3.n) FROM sup3 JOIN sup2 USING (e0, e1) JOIN sup1 USING (e0)",
    "support": "SELECT CAST(e0 AS VARCHAR) AS etypes, n AS support FROM sup1 UNION ALL SELECT sup2.e0 || '-' || e1, least(sup1.n, sup2.n) FROM sup2 JOIN sup1 USING (e0)",
}
for _p, _least in (("oh", 0), ("bn", 5)):
    _e = "elig" if _p == "oh" else "gelig"
    CTES |= {k.replace("{p}", _p): t.replace("{p}", _p).replace("{cov}", "0.8" if _p == "oh" else "0.9").replace("{elig}", _e).replace("{least}", str(_least)) for k, t in FACTS.items()}

_ORDER = list(CTES)


def sql(final: str, **over: str) -> str:
    """``final`` after the tables that it needs; ``over`` replaces some of them."""
    tables = {**CTES, **over}
    need, todo = set(), [final]
    while todo:
        for w in set(re.findall(r"[a-z]\w*", todo.pop())) & set(tables) - need:
            need.add(w)
            todo.append(tables[w])
    done: list[str] = []

    def place(name: str) -> None:
        if name not in done:
            for w in sorted(set(re.findall(r"[a-z]\w*", tables[name])) & need - {name}):
                place(w)
            done.append(name)

    for name in _ORDER:
        if name in need:
            place(name)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({tables[n]})" for n in done) + "\n" + final


def _join(column: str) -> str:
    return f"array_to_string({column}, '-') AS {column}"


_STRIKE = "SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY strikingness DESC, etype, value{more}) AS fact_rank FROM {of}"
_SETS = "SELECT qid, pattern, count(*) || ':' || sum(nid) || ':' || sum((nid % 1000003) * (nid % 1000003)) || ':' || sum((nid * 2654435) % 999983) AS set_id, count(*) AS n_peers FROM {p}_peers GROUP BY qid, pattern"
_MINE = "SELECT qid, rank::INT AS rank, pattern, n_nodes, relevance, n_peers, fact_rank::INT AS fact_rank, etype, value, strikingness, value_freq, top_value, top_freq FROM (" + _STRIKE.format(by="qid, pattern", more="", of="{p}_strike{where}") + ") s JOIN {p}_top t USING (qid, pattern) WHERE fact_rank <= {k}"
_RANKED = "SELECT qid, rank::INT AS rank, pattern, n_nodes, relevance, n_peers FROM {p}_top"
_SIZED = "SELECT qid, pattern, count(*) AS n_peers, sum(nid)::BIGINT AS sum_nid FROM {p}_peers GROUP BY qid, pattern"
_MATCHED = "SELECT qid, pattern, level, count(*) AS n, sum(nid)::BIGINT AS sum_nid, min(nid) AS min_nid, max(nid) AS max_nid FROM {p}_all GROUP BY qid, pattern, level"

#: Every supplier with its nation.
SUPPLIERS = f"SELECT s_suppkey::BIGINT AS qid, s_suppkey + {base('supp')} AS target, s_nationkey + {base('nation')} AS context FROM supplier"

ORACLE_SQL: dict[str, str] = {
    name: sql(final)
    for name, final in {
        "kg_edges": "SELECT src, etype, dst FROM edges",
        "kg_edge_types": "SELECT etype, name FROM names",
        "kg_nodes": "SELECT nid, iri FROM nodes",
        "kg_node_types": "SELECT nid, type FROM ntypes",
        "kg_degree": "SELECT nid, degree FROM degree",
        "edge_spread_ratio": "SELECT src, etype, round(spread, 10) AS spread FROM sp",
        "etype_sources": "SELECT DISTINCT etype, src FROM edges",
        "neighbors_by_degree": "SELECT src, etype, dst, pos::INT AS pos FROM nbr",
        "first_value": "SELECT src, etype, value FROM firsts",
        "specific_type": "SELECT nid, arg_min(type, (c, type)) AS type FROM ntypes JOIN (SELECT type, count(*) AS c FROM ntypes GROUP BY type) USING (type) GROUP BY nid",
        "one_label": "SELECT nid, label FROM lab1",
        "relevance_scores": "SELECT context, nid, round(score, 9) AS score FROM rel",
        "sampled_relevance": "SELECT context, nid, count(*) AS visits, round(count(*) / 1000000, 12) AS score FROM (" + " UNION ALL ".join(f"SELECT context, nid FROM d{k} WHERE place IS NULL" for k in range(WALK_STEPS)) + ") GROUP BY context, nid",
        "total_relevance": "SELECT context, round(round(sum(score), 10), 8) AS total FROM rel WHERE nid <> context GROUP BY context",
        "type_relevance": "SELECT qid, type, round(score, 10) AS score FROM trel",
        "best_type": "SELECT b.qid, b.nid, b.type FROM best b JOIN q USING (qid) WHERE (q.context, b.nid) IN (SELECT context, nid FROM rel)",
        "edge_type_score_sum": "SELECT context, etype, type, round(round(sum(score), 10), 8) AS score_sum FROM rel JOIN (SELECT DISTINCT etype, src FROM edges) e ON e.src = rel.nid JOIN ntypes n ON n.nid = rel.nid WHERE rel.nid <> context GROUP BY context, etype, type",
        "sequence_propagation": f"""SELECT source, nid, round(sum(p), 10) AS prob FROM (
            SELECT DISTINCT source, a.dst AS x, b.dst AS y, c.dst AS nid, a.spread * b.spread * c.spread AS p FROM (SELECT DISTINCT target AS source FROM q) s
            JOIN se a ON a.src = source AND a.etype = {etype("from_supplier") + 1} JOIN se b ON b.src = a.dst AND b.etype = {etype("placed_by")} JOIN se c ON c.src = b.dst AND c.etype = {etype("in_nation")}) GROUP BY source, nid""",
        "one_hop_expand": "SELECT qid, target || '-' || dst AS nodes, etype::VARCHAR AS etypes FROM q JOIN edges ON src = target WHERE (context, dst) IN (SELECT context, nid FROM inn)",
        "simple_paths": """SELECT qid, e AS etypes, count(*) AS n_paths, count(DISTINCT w) AS n_ends FROM (SELECT qid, e.etype::VARCHAR AS e, e.dst AS w FROM q JOIN edges e ON e.src = target
            UNION ALL SELECT qid, a.etype || '-' || b.etype, b.dst FROM q JOIN edges a ON a.src = target JOIN edges b ON b.src = a.dst WHERE b.dst <> target) GROUP BY qid, e""",
        "simple_paths_3hop": """SELECT qid, e AS etypes, count(*) AS n_paths, count(DISTINCT w) AS n_ends FROM (SELECT qid, e.etype::VARCHAR AS e, e.dst AS w FROM q JOIN edges e ON e.src = target
            UNION ALL SELECT qid, a.etype || '-' || b.etype, b.dst FROM q JOIN edges a ON a.src = target JOIN edges b ON b.src = a.dst WHERE b.dst <> target
            UNION ALL SELECT qid, a.etype || '-' || b.etype || '-' || c.etype, c.dst FROM q JOIN edges a ON a.src = target JOIN edges b ON b.src = a.dst JOIN edges c ON c.src = b.dst WHERE b.dst <> target AND c.dst <> target AND c.dst <> a.dst) GROUP BY qid, e""",
        **{name: f"SELECT qid, {_join('nodes')}, {_join('etypes')} FROM paths" for name in ("bidirectional_paths", "reverse_paths", "forward_paths")},
        "paths_by_mean_relevance": """SELECT qid, path, seq, n_nodes, mean_score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY mean_score DESC, n_nodes, path, seq) AS rank FROM (
            SELECT qid, array_to_string(nodes, '-') AS path, array_to_string(etypes, '-') AS seq, n AS n_nodes, round(sum(coalesce(score, 0)) / n, 10) AS mean_score FROM pnodes LEFT JOIN rel USING (context, nid) GROUP BY qid, nodes, etypes, n)) WHERE rank <= 20""",
        "paths_from_by_mean_relevance": """SELECT qid, path, seq, n_nodes, mean_score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY mean_score DESC, n_nodes, path, seq) AS rank FROM (
            SELECT qid, target || '-' || a.dst AS path, a.etype::VARCHAR AS seq, 2 AS n_nodes, round((coalesce(r0.score, 0) + coalesce(r1.score, 0)) / 2, 10) AS mean_score FROM q JOIN edges a ON a.src = target
            LEFT JOIN rel r0 ON r0.context = q.context AND r0.nid = target LEFT JOIN rel r1 ON r1.context = q.context AND r1.nid = a.dst
            UNION ALL SELECT qid, target || '-' || a.dst || '-' || b.dst, a.etype || '-' || b.etype, 3, round((coalesce(r0.score, 0) + coalesce(r1.score, 0) + coalesce(r2.score, 0)) / 3, 10) FROM q JOIN edges a ON a.src = target JOIN edges b ON b.src = a.dst
            LEFT JOIN rel r0 ON r0.context = q.context AND r0.nid = target LEFT JOIN rel r1 ON r1.context = q.context AND r1.nid = a.dst LEFT JOIN rel r2 ON r2.context = q.context AND r2.nid = b.dst WHERE b.dst <> target)) WHERE rank <= 100""",
        "reverse_index_2hop": f"""SELECT qid, nid, etypes, round(round(max(s), 12), 10) AS score FROM (
            SELECT qid, b.dst AS nid, xor(b.etype, 1)::VARCHAR AS etypes, least(r0.score * {DECAYS[1]!r}, r1.score) AS s FROM q JOIN rel r0 ON r0.context = q.context AND r0.nid = q.context JOIN edges b ON b.src = q.context JOIN rel r1 ON r1.context = q.context AND r1.nid = b.dst WHERE b.dst NOT IN (target, q.context)
            UNION ALL SELECT qid, a.dst, xor(a.etype, 1) || '-' || xor(b.etype, 1), least(least(r0.score * {DECAYS[1]!r}, r1.score) * {DECAYS[1]!r}, r2.score) FROM q JOIN rel r0 ON r0.context = q.context AND r0.nid = q.context JOIN edges b ON b.src = q.context JOIN rel r1 ON r1.context = q.context AND r1.nid = b.dst
                JOIN edges a ON a.src = b.dst JOIN rel r2 ON r2.context = q.context AND r2.nid = a.dst WHERE b.dst NOT IN (target, q.context) AND a.dst NOT IN (target, q.context)) GROUP BY qid, nid, etypes""",
        "best_paths": f"""SELECT qid, rank::INT AS rank, {_join('nodes')}, {_join('etypes')}, round(path_score, 10) AS path_score FROM (
            SELECT *, row_number() OVER (PARTITION BY qid ORDER BY path_score DESC, array_to_string(nodes, '-'), array_to_string(etypes, '-')) AS rank FROM pscore) WHERE rank <= 20""",
        "pattern_names": """SELECT t.qid, rank::INT AS rank, CASE x.n WHEN 2 THEN w0 || c WHEN 3 THEN w0 || w1 || c ELSE w0 || w1 || w2 || c END AS text, display FROM bi_top t JOIN (
              SELECT p.qid, p.pattern, n, substr(l0, 3) || ' -' || n0.name || '-> ' AS w0, coalesce(i1.iri, substr(l1, 3)) || ' -' || n1.name || '-> ' AS w1, coalesce(i2.iri, substr(l2, 3)) || ' -' || n2.name || '-> ' AS w2, c.iri AS c
              FROM bi p LEFT JOIN names n0 ON n0.etype = e0 LEFT JOIN names n1 ON n1.etype = e1 LEFT JOIN names n2 ON n2.etype = e2 LEFT JOIN nodes i1 ON 'I:' || i1.nid = l1 LEFT JOIN nodes i2 ON 'I:' || i2.nid = l2 JOIN nodes c ON c.nid = p.context) x USING (qid, pattern)
            JOIN (SELECT qid, pattern, CASE WHEN count(DISTINCT nid) = 1 THEN min(iri) ELSE coalesce(min(type), 'ANY') END AS display FROM bi_peers LEFT JOIN ntypes USING (nid) JOIN nodes USING (nid) GROUP BY qid, pattern) d USING (qid, pattern)""",
        "path_scores": f"SELECT qid, {_join('nodes')}, {_join('etypes')}, round(path_score, 10) AS path_score FROM pscore",
        "pattern_enumeration": "SELECT qid, pattern, round(path_score, 10) AS path_score FROM lpat_all WHERE qid IN (SELECT qid FROM live)",
        "match_sets_labelled": _MATCHED.format(p="bi"),
        "match_sets_edges": _MATCHED.format(p="re"),
        "pattern_relevance": "SELECT qid, pattern, n_nodes, relevance, n_peers FROM bi_rel",
        "top_patterns": _RANKED.format(p="bi"),
        "top_patterns_in_waves": _RANKED.format(p="bi"),
        "pattern_bounds": "SELECT qid, pattern, n_nodes, n_peers, path_bound, peer_bound FROM bi_bounds",
        "mine_counters": """SELECT preset, qid, (SELECT count(*) FROM bi b WHERE b.qid = c.qid) - count(*) AS n_rejected, count(*) FILTER (WHERE NOT go) AS n_pruned, count(*) FILTER (WHERE go) AS n_evaluated, count(*) FILTER (WHERE top <= 20) AS n_top
            FROM (SELECT preset, qid, r <= 40 OR kth IS NULL OR bound + 2e-10 >= kth AS go, top FROM waves LEFT JOIN kths USING (preset, qid)) c GROUP BY preset, qid""",
        "threshold_patterns": _RANKED.format(p="th"),
        "reverse_patterns": _RANKED.format(p="re"),
        "diversified_patterns": """SELECT qid, rank::INT AS rank, pattern, n_nodes, relevance, n_peers FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, n_nodes, pattern) AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY qid, ls ORDER BY relevance DESC, pattern) AS r FROM dv) WHERE r = 1) WHERE rank <= 20""",
        "one_hop_peers": "SELECT qid, etype, value, nid FROM oh_all",
        "one_hop_peers_first_value": "SELECT o.qid, o.etype, o.value, o.nid FROM oh_all o JOIN q USING (qid) JOIN firsts f ON f.src = target AND f.etype = o.etype AND f.value = o.value",
        "one_hop_facts": "SELECT qid, pattern, fact_rank::INT AS fact_rank, etype, value, strikingness, value_freq, top_value, top_freq FROM (" + _STRIKE.format(by="qid, pattern", more="", of="oh_strike WHERE strikingness > 0") + ") WHERE fact_rank <= 5",
        "peer_set_dedup": f"SELECT qid, n_peers, count(*) AS n_patterns, min(pattern) AS first_pattern FROM ({_SETS.format(p='th')}) GROUP BY qid, set_id, n_peers",
        "peer_jaccard": """SELECT * FROM (SELECT x.qid, x.pattern AS a, y.pattern AS b, round(1 - count(*) / (any_value(sx.n_peers) + any_value(sy.n_peers) - count(*)), 10) AS distance FROM th_peers x JOIN th_peers y ON x.qid = y.qid AND x.nid = y.nid AND x.pattern < y.pattern
            JOIN th_size sx ON sx.qid = x.qid AND sx.pattern = x.pattern JOIN th_size sy ON sy.qid = y.qid AND sy.pattern = y.pattern GROUP BY x.qid, x.pattern, y.pattern) WHERE distance < 0.1""",
        "merged_peer_sets": """SELECT qid, pattern, min(o) AS merged FROM (WITH RECURSIVE close AS (SELECT x.qid, x.pattern AS a, y.pattern AS b FROM th_peers x JOIN th_peers y ON x.qid = y.qid AND x.nid = y.nid AND x.pattern <> y.pattern
            JOIN th_size sx ON sx.qid = x.qid AND sx.pattern = x.pattern JOIN th_size sy ON sy.qid = y.qid AND sy.pattern = y.pattern GROUP BY x.qid, x.pattern, y.pattern
            HAVING round(1 - count(*) / (any_value(sx.n_peers) + any_value(sy.n_peers) - count(*)), 10) < 0.1),
            reach AS (SELECT qid, pattern, pattern AS o FROM th_size UNION SELECT r.qid, r.pattern, c.b FROM reach r JOIN close c ON c.qid = r.qid AND c.a = r.o) SELECT * FROM reach) GROUP BY qid, pattern""",
        "attribute_eligibility_peer": "SELECT qid, pattern, etype, n_have, n_peers FROM bi_elig",
        "attribute_eligibility_global": "SELECT s.qid, s.pattern, a.etype, n_have, n_peers FROM bi_size s JOIN asked a USING (qid) JOIN (SELECT etype, count(DISTINCT src) AS n_have FROM edges GROUP BY etype) g ON g.etype = a.etype WHERE n_have >= 0.9 * n_peers",
        "value_frequency": "SELECT qid, pattern, etype, value, count(*) AS n_values, sum(f)::BIGINT AS population, max(f) AS most FROM bi_freq GROUP BY qid, pattern, etype, value",
        "strikingness": "SELECT qid, pattern, etype, value, strikingness, value_freq, population FROM bi_strike",
        "most_frequent_value": "SELECT qid, pattern, etype, value, top_value, top_freq FROM bi_strike",
        "top_facts": "SELECT qid, pattern, fact_rank::INT AS fact_rank, etype, value, strikingness FROM (" + _STRIKE.format(by="qid, pattern", more="", of="bi_strike") + ") WHERE fact_rank <= 3",
        "diverse_top_facts": """SELECT qid, fact_rank::INT AS fact_rank, pattern, etype, value, strikingness FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY strikingness DESC, etype, value, n_nodes, pattern) AS fact_rank FROM (
            SELECT s.*, n_nodes, row_number() OVER (PARTITION BY qid, pattern ORDER BY strikingness DESC, etype, value) AS r FROM bi_strike s JOIN bi_top USING (qid, pattern) WHERE strikingness > 0) WHERE r = 1) WHERE fact_rank <= 10""",
        "blind_end_node": _SIZED.format(p="bn"),
        "blind_end_type": _SIZED.format(p="bt"),
        "blind_top_facts": "SELECT qid, fact_rank::INT AS fact_rank, pattern, etype, value, strikingness, value_freq, top_value, top_freq FROM (" + _STRIKE.format(by="qid", more=", pattern", of=f"bn_strike JOIN (SELECT qid, min(pattern) AS pattern FROM ({_SETS.format(p='bn')}) GROUP BY qid, set_id) USING (qid, pattern) WHERE strikingness > 0") + ") WHERE fact_rank <= 100",
        "guided_facts": "SELECT qid, fact_rank::INT AS fact_rank, pattern, etype, value, strikingness FROM (" + _STRIKE.format(by="qid", more=", pattern", of=f"gu_strike JOIN (SELECT qid, min(pattern) AS pattern FROM ({_SETS.format(p='gu')}) GROUP BY qid, set_id) USING (qid, pattern) JOIN q USING (qid) JOIN rel ON rel.context = q.context AND rel.nid = value JOIN (SELECT qid, min(relevance) AS kth FROM gu_top GROUP BY qid) k USING (qid) WHERE strikingness > 0 AND score >= kth") + ") WHERE fact_rank <= 20",
        "pattern_probability": "SELECT DISTINCT source, etypes, nid, forward, backward, score FROM prob",
        "pattern_support": "SELECT DISTINCT etypes, support FROM support JOIN prob USING (etypes)",
        "pattern_support_3hop": "SELECT DISTINCT etypes, support FROM support3 JOIN prob3 USING (etypes)",
        "pattern_probability_3hop": "SELECT DISTINCT source, etypes, nid, forward, backward, score FROM prob3",
        "scores_between_3hop": "SELECT source, context AS target, etypes, forward, backward, score FROM prob3 JOIN q ON q.qid = prob3.qid AND context = nid",
        "top_path_patterns": """SELECT source, target, pattern, pattern_rank::INT AS pattern_rank, score, support, nid, peer_rank::INT AS peer_rank, peer_score FROM (
            SELECT t.*, p.nid, p.score AS peer_score, row_number() OVER (PARTITION BY t.source, t.target, t.pattern ORDER BY p.score DESC, p.nid) AS peer_rank FROM (
                SELECT q.qid, p.source, q.context AS target, p.etypes AS pattern, p.score, support, row_number() OVER (PARTITION BY q.qid ORDER BY p.score DESC, support DESC, p.etypes) AS pattern_rank
                FROM q JOIN prob p ON p.qid = q.qid AND p.nid = q.context JOIN support USING (etypes)) t JOIN prob p ON p.qid = t.qid AND p.etypes = t.pattern WHERE pattern_rank <= 10) WHERE peer_rank <= 10""",
        "top_path_patterns_3hop": """SELECT source, target, pattern, pattern_rank::INT AS pattern_rank, score, support, nid, peer_rank::INT AS peer_rank, peer_score FROM (
            SELECT t.*, p.nid, p.score AS peer_score, row_number() OVER (PARTITION BY t.source, t.target, t.pattern ORDER BY p.score DESC, p.nid) AS peer_rank FROM (
                SELECT q.qid, p.source, q.context AS target, p.etypes AS pattern, p.score, support, row_number() OVER (PARTITION BY q.qid ORDER BY p.score DESC, support DESC, p.etypes) AS pattern_rank
                FROM q JOIN prob3 p ON p.qid = q.qid AND p.nid = q.context JOIN support3 USING (etypes)) t JOIN prob3 p ON p.qid = t.qid AND p.etypes = t.pattern WHERE pattern_rank <= 10) WHERE peer_rank <= 10""",
        "pattern_probability_forward": """SELECT source, etypes, nid, round(f, 10) AS forward, round(b, 10) AS backward, round((f + b) / 2, 10) AS score FROM (
            SELECT source, CAST(etype AS VARCHAR) AS etypes, dst AS nid, sum(spread) AS f, sum(back) AS b FROM (SELECT DISTINCT target AS source FROM q) JOIN se ON src = source WHERE etype % 2 = 0 GROUP BY source, etype, dst
            UNION ALL SELECT source, a.etype || '-' || b.etype, b.dst, sum(a.spread * b.spread), sum(a.back * b.back) FROM (SELECT DISTINCT target AS source FROM q) JOIN se a ON a.src = source JOIN se b ON b.src = a.dst WHERE b.dst <> source AND a.etype % 2 = 0 AND b.etype % 2 = 0 GROUP BY source, a.etype, b.etype, b.dst)""",
        "scores_between": "SELECT source, context AS target, etypes, forward, backward, score FROM prob JOIN q ON q.qid = prob.qid AND context = nid",
        "edge_file": "SELECT s.iri AS src_iri, name AS label, d.iri AS dst_iri FROM fwd JOIN names USING (etype) JOIN nodes s ON s.nid = src JOIN nodes d ON d.nid = dst",
        "type_file": "SELECT iri, type FROM nodes JOIN ntypes USING (nid) WHERE nid IN (SELECT src FROM edges)",
        "pair_file": "SELECT target, context FROM q",
        "snapshot": "SELECT etype, count(*) AS n, sum(src)::BIGINT AS sum_src, sum(dst)::BIGINT AS sum_dst FROM edges GROUP BY etype",
        "snapshot_edges": "SELECT src, etype, dst FROM edges",
        "snapshot_relevance": "SELECT context, nid, round(score, 9) AS score FROM rel",
        "size_bound": "SELECT context, etype, type, level, round(x * s / 1e-4, 4) AS bound FROM (SELECT context, etype, type, sum(score) AS s FROM rel JOIN (SELECT DISTINCT etype, src FROM edges) e ON e.src = rel.nid JOIN ntypes n ON n.nid = rel.nid GROUP BY context, etype, type), (VALUES " + ", ".join(f"({i}, {x!r})" for i, x in enumerate(DECAYS[:3])) + ") d(level, x)",
        "mine_bidirectional": _MINE.format(p="bi", where="", k=10),
        "mine_reverse": _MINE.format(p="re", where=" WHERE strikingness > 0", k=10),
        "mine_naive": _MINE.format(p="re", where=" WHERE strikingness > 0", k=10),
        "render_facts": "SELECT qid, rank, fact_rank, '#' || rank || ' ' || pattern || ' peers=' || n_peers || ' ' || name || '=' || v.iri || ' shared by ' || value_freq || ' most have ' || t.iri || ' (' || top_freq || ')' AS text FROM (" + _MINE.format(p="bi", where="", k=2) + ") JOIN names USING (etype) JOIN nodes v ON v.nid = value JOIN nodes t ON t.nid = top_value",
    }.items()
}
ORACLE_SQL |= {
    "patterns_every_supplier": sql(_RANKED.format(p="bi"), q=SUPPLIERS),
    "mine_every_supplier": sql(_MINE.format(p="bi", where="", k=1), q=SUPPLIERS),
    "pair_names": sql("SELECT target, context FROM q", q=SUPPLIERS),
    "mine_folder": sql("SELECT target, context, f.* EXCLUDE (qid) FROM (" + _MINE.format(p="bi", where="", k=1) + ") f JOIN q USING (qid)", q=SUPPLIERS),
    "effective_pairs": sql("SELECT DISTINCT target, context FROM (" + _MINE.format(p="bi", where="", k=1) + ") f JOIN q USING (qid)", q=SUPPLIERS),
}
