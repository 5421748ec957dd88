"""Domain views over the driver's tables, as SQL for both engines; base tables are in braces.

Facts: annotations (entity mentions by document), relations and their evidence (parts bought
together), interactions (suppliers that share orders), candidates of three sources, entities with
messy ids, groundings, usage rows. Where order matters there is a ``seq`` column.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "annotations": """select l_orderkey as pmid, 'S' || cast(l_suppkey as string) as entity_id, s_name as entity_text,
        case s_nationkey % 3 when 0 then 'Gene' when 1 then 'Disease' else 'Chemical' end as entity_type,
        cast(l_linenumber as bigint) * 100000000 + l_partkey as seq
        from {lineitem} join {supplier} on l_suppkey = s_suppkey""",
    "mentions": "select distinct pmid, upper(trim(entity_id)) as entity from annotations",
    "bought": "select distinct l_orderkey as o, l_partkey as p from {lineitem}",
    "edges": "select a.p as u, b.p as v, count(*) as n, min(a.o) as first_order from bought a join bought b on a.o = b.o and a.p < b.p group by a.p, b.p having count(*) >= 2",
    "both_ways": "select u, v from edges union all select v as u, u as v from edges",
    "degrees": "select u as node, count(*) as degree from both_ways group by u",
    "relations": """select 'P' || cast(u as string) as source, 'P' || cast(v as string) as target,
        case (u + v) % 4 when 0 then 'interacts_with' when 1 then 'activates' when 2 then 'hypothesized' else 'cooccurs_with' end as relation_type,
        case when (u + v) % 3 <> 1 then ((u * 31 + v * 17) % 1000) / 1000.0E0 end as ml_score, u * 1000003 + v as seq from edges""",
    "evidence": """select 'P' || cast(a.p as string) as source, 'P' || cast(b.p as string) as target,
        case when a.o % 3 = 0 then 'literature' when a.o % 3 = 1 then 'database' else 'ml_predicted' end as source_type,
        cast(a.o as string) as source_id, ((a.o * 7 + a.p) % 100) / 100.0E0 as confidence
        from bought a join bought b on a.o = b.o and a.p < b.p join edges e on e.u = a.p and e.v = b.p""",
    "typed": "select 'P' || cast(p_partkey as string) as id, p_name as name, p_type as type, p_brand as brand, p_size as size from {part}",
    "shared_orders": "select a.entity as a, b.entity as b, count(*) as n from mentions a join mentions b on a.pmid = b.pmid and a.entity < b.entity group by a.entity, b.entity",
    "interactions": "select a as a, b as b, n / ((select max(n) from shared_orders) * 1.0E0) as score from shared_orders",
    "pairs": "select a, b, n as n_ab from shared_orders",
    "doc_counts": "select entity, count(*) as n from mentions group by entity",
    "pmi": """select p.a, p.b, n_ab, x.n as n_a, y.n as n_b,
        log2((cast(n_ab as double) / t.n) / ((cast(x.n as double) / t.n) * (cast(y.n as double) / t.n))) as pmi
        from pairs p join doc_counts x on x.entity = p.a join doc_counts y on y.entity = p.b cross join (select count(*) as n from {orders}) t""",
    "candidates": """select a as source, b as target, 'interacts_with' as relation_type, 'STRING' as data_source, score as base, 1 as prio from interactions where score >= 0.4
        union all select b, a, 'interacts_with', 'cooccurrence', cast(pmi as double), 2 from pmi where n_ab >= 5
        union all select a, b, case n_ab % 3 when 0 then 'activates' else 'interacts_with' end, 'llm', 0.7E0, 3 from pairs where n_ab % 4 = 1""",
    "scored": "select source, target, ml_score as score from relations where ml_score is not null",
    "usage": """select event_id, event_type as phase, cast(json_k as bigint) * 10 as prompt_tokens, cast(json_k as bigint) * 3 as completion_tokens, value as latency_ms,
        case user_id % 3 when 0 then 'small' when 1 then 'large' else 'other' end as model from (select *, {k_of_props} as json_k from {events})""",
    "messy": """select 'P' || cast(p_partkey as string) as id, p_name as name, case p_size % 7 when 0 then '-' when 1 then '' when 2 then 'None' else cast(p_partkey % 97 as string) end as ncbi,
        p_partkey as seq from {part}""",
    "groundings": """select p_partkey as pos, p_name as term, case p_size % 5 when 0 then 'HGNC' when 1 then 'CHEBI' when 2 then 'MESH' when 3 then 'GO' else 'DOID' end as db,
        cast(p_partkey % 1000 as string) as db_id, round((p_partkey * 37 % 100) / 100.0E0, 2) as score from {part}""",
    "seeds": "select 'P' || cast(p_partkey as string) as id from {part} where p_partkey % 50 = 0",
    "neighbours": "select source as node, target as other, 'out' as direction, relation_type, ml_score from relations union all select target, source, 'in', relation_type, ml_score from relations",
    "two_hop": "select a.u as u, b.v as v, count(*) as common from both_ways a join both_ways b on a.v = b.u and a.u < b.v left join edges e on e.u = a.u and e.v = b.v where e.u is null group by a.u, b.v",
    "articles": "select doc_id as pmid, text as abstract, lang, source from {documents}",
}



def uses(body: str, name: str, views: dict[str, str] = VIEWS) -> int:
    """How often a view would be evaluated where ``body`` is planned with its views inlined."""
    found = re.findall(r"(?:from|join|,)\s+(\w+)\b", body)
    return sum(1 if x == name else uses(views[x], name, views) for x in found if x in views)


def chain(body: str, views: dict[str, str] = VIEWS, kept: bool = False) -> str:
    """``body`` with the views it reads, directly or not, as common table expressions; ``kept`` asks the
    engine to evaluate each once."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in views:
            if re.search(rf"(?:from|join|,)\s+{name}\b", text) and name not in needed:
                visit(views[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    ctes = ", ".join(f"{n} as {'materialized ' if kept else ''}({views[n]})" for n in needed)
    return f"with {ctes}, {body.strip()[5:]}" if body.strip().startswith("with ") else f"with {ctes} {body.strip()}"
