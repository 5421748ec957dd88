"""Queries stated once in SQL over the domain views; each engine gets its own dialect.

On Spark they are ordinary SQL plans: filters and columns reach the Parquet scans, dictionaries are
joined as relations, and join strategies and skew are left to adaptive execution.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ligature.functions.vocabularies import ENTITY_TYPES, RELATION_TYPES, SYNONYMS
from ligature.plans.dialect import Duck, Spark
from ligature.session import materialized_path
from ligature.sources.views import VIEWS, chain, uses

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
Body = Callable[[Spark], str]
BODIES: dict[str, Body] = {}


def sql_for(name: str, dialect: Spark, table: Callable[[str], str]) -> str:
    return placed(chain(BODIES[name](dialect), kept=isinstance(dialect, Duck)), dialect, table)


def placed(text: str, dialect: Spark, table: Callable[[str], str]) -> str:
    text = text.replace("{k_of_props}", dialect.json("props", "k"))
    for t in TABLES:
        text = text.replace("{" + t + "}", table(t))
    return text


#: Views that cost a self-join: where a plan would evaluate one several times, it is written first.
WRITTEN = ("shared_orders", "edges", "two_hop")


def views_for(spark: SparkSession, sf_dir: str, body: str) -> dict[str, str]:
    """The views, those that ``body`` uses several times and that cost much as written tables."""
    views = dict(VIEWS)
    for name in WRITTEN:
        if uses(body, name, views) > 1:
            rows = spark.sql(placed(chain(f"select * from {name}", views), Spark(), lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))
            views[name] = f"select * from parquet.`{materialized_path(rows, name)}`"
    return views


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        body = BODIES[name](Spark())
        return spark.sql(placed(chain(body, views_for(spark, sf_dir, body)), Spark(), lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))

    return run


def values(rows: dict[str, str], a: str, b: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    listed = " union all ".join(f"select {quoted(k)} as {a}, {quoted(v)} as {b}" for k, v in rows.items())
    return f"({listed})"


def case(column: str, steps: list[tuple[float, str]], rest: str) -> str:
    return "case " + " ".join(f"when {column} >= {t}E0 then '{n}'" for t, n in steps) + f" else '{rest}' end"


#: Names of the tiers of a percentile.
TIER = [(99.0, "Very Strong"), (95.0, "Strong"), (90.0, "Moderate"), (75.0, "Weak")]
BAND = [(0.8, "high"), (0.6, "moderate"), (0.4, "low")]
SYMMETRIC = "('interacts_with', 'binds_to', 'cooccurs_with', 'associated_with')"
CONFIDENCE = """case data_source when 'STRING' then 0.9E0 * least(base, 1.0E0) when 'llm' then 0.7E0
    when 'cooccurrence' then case when base > 2.0E0 then 0.5E0 * (0.5E0 + 0.5E0 * least(base / 5.0E0, 1.0E0)) else 0.25E0 end else 0.0E0 end"""

B = BODIES
# scans
B["scan_dictionary_first_wins"] = lambda d: "select name, id from (select p_name as name, 'P' || cast(p_partkey as string) as id, row_number() over (partition by p_name order by p_partkey) as r from {part}) x where r = 1"
B["scan_filter_score"] = lambda d: "select source, target, ml_score from relations where ml_score >= 0.7E0"
B["partners_topk_per_seed"] = lambda d: "select seed, partner, round(score, 6) as score from (select *, row_number() over (partition by seed order by score desc, partner) as r from (select a as seed, b as partner, score from interactions union all select b, a, score from interactions) x) y where r <= 10"
B["literature_search_topn"] = lambda d: f"select doc_id as pmid, n_chars from {{documents}} where {d.found('lower(text)', 'licen|release')} order by n_chars desc, doc_id limit 50"
B["json_extract_events"] = lambda d: "select event_id, event_type, cast({k_of_props} as bigint) as k from {events} where event_type in ('click', 'view', 'purchase', 'signup') or {k_of_props} is not null"
B["relkey_parse"] = lambda d: f"""select {d.item('parts', 0)} as source, {d.item('parts', 1)} as target, case when {d.item('parts', 2)} in ('activates', 'interacts_with', 'hypothesized') then {d.item('parts', 2)} else 'associated_with' end as relation_type
    from (select {d.split("source || '|' || target || case when seq % 10 = 0 then '|x|' else '|' end || relation_type", '[|]')} as parts from relations) x where {d.item('parts', 3)} is null"""
# sinks
B["rel_flat_key_export"] = lambda d: "select source || '|' || target || '|' || relation_type as flat_key, ml_score from relations"
B["query_slug"] = lambda d: f"select event_id, {d.text(d.head(d.split(d.replaced('lower(q)', '[^a-z0-9 ]', ''), ' '), 3), '_')} as slug from (select event_id, event_type || ' Of User: ' || cast(user_id as string) || ' Now' as q from {{events}}) x"
B["edge_style_case"] = lambda d: "select source, target, case when ml_score >= 0.9E0 then 'strong' when ml_score >= 0.7E0 then 'likely' when ml_score is not null then 'weak' when relation_type = 'cooccurs_with' then 'dashed' else 'plain' end as style, case when ml_score is null then 1.0E0 else 1.0E0 + 4.0E0 * ml_score end as width from relations"
# projections and predicates
B["norm_entity_id"] = lambda d: f"select s_suppkey, upper({d.replaced('raw', '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '')}) as entity from (select s_suppkey, case s_suppkey % 3 when 0 then chr(9) || s_name || chr(10) when 1 then '  ' || s_name || ' ' || chr(13) else s_name end as raw from {{supplier}}) x"
B["norm_lookup"] = lambda d: "select s_suppkey, replace(replace(replace(lower(trim(s_name)), '-', ''), '_', ''), ' ', '') as entity, replace(replace(replace(lower(trim(s_name)), '#', ''), '0', ''), ' ', '') as short from {supplier}"
B["edge_key_canonical"] = lambda d: f"select source, target, relation_type, case when relation_type in {SYMMETRIC} then least(upper(source), upper(target)) else upper(source) end as key_a, case when relation_type in {SYMMETRIC} then greatest(upper(source), upper(target)) else upper(target) end as key_b from (select target as source, source as target, relation_type from relations) r"
B["map_relation_type"] = lambda d: f"select event_type, coalesce(m.relation_type, 'associated_with') as relation_type, count(*) as n from (select event_id, event_type, case event_id % 9 when 6 then 'Co-occurs with' when 7 then 'linked to' when 8 then 'PREDICTED' when 0 then 'Binds' when 1 then ' inhibits ' when 2 then 'up-regulates' when 3 then 'phosphorylates' when 4 then 'interacts with' else event_type end as raw from {{events}}) e left join {values(RELATION_TYPES, 'word', 'relation_type')} m on m.word = replace(replace(lower(trim(raw)), '-', '_'), ' ', '_') group by event_type, coalesce(m.relation_type, 'associated_with')"
B["map_entity_type"] = lambda d: f"select x.entity_type, coalesce(m.kind, nullif(lower(trim(x.entity_type)), ''), 'unknown') as kind, count(*) as n from (select case seq % 7 when 0 then ' SNP' when 1 then 'Organism' when 2 then '' when 3 then 'Biological_Process' else entity_type end as entity_type from annotations) x left join {values(ENTITY_TYPES, 'word', 'kind')} m on m.word = lower(trim(x.entity_type)) group by x.entity_type, coalesce(m.kind, nullif(lower(trim(x.entity_type)), ''), 'unknown')"
B["map_inferred_type"] = lambda d: "select source, target, case relation_type when 'interacts_with' then 'binds_to' when 'cooccurs_with' then 'associated_with' else 'hypothesized' end as inferred from relations"
B["edge_candidates_union"] = lambda d: "select source, target, relation_type, data_source, round(base, 6) as base from candidates"
B["filter_high_confidence"] = lambda d: "select source, target, ml_score from relations where ml_score >= 0.9E0 order by ml_score desc, source, target"
B["high_conf_partners"] = lambda d: "select distinct case when a.id is null then r.source else r.target end as partner from relations r left join seeds a on a.id = r.source left join seeds b on b.id = r.target where r.ml_score >= 0.9E0 and ((a.id is null and b.id is not null) or (a.id is not null and b.id is null))"
B["novel_predictions"] = lambda d: "select r.source, r.target, r.relation_type, r.ml_score from relations r left join (select distinct source, target from evidence where source_type = 'literature') e on e.source = r.source and e.target = r.target where r.ml_score >= 0.5E0 and e.source is null order by r.ml_score desc, r.source, r.target"
B["ml_predictions"] = lambda d: "select source, target, ml_score from relations where ml_score >= 0.5E0 order by ml_score desc, source, target"
B["try_cast_scores"] = lambda d: f"select source, target, {d.try_double('raw')} as score from (select source, target, case when seq % 5 = 0 then 'None' when seq % 5 = 1 then 'bad' else cast(ml_score as string) end as raw from relations) x where {d.try_double('raw')} is not null"
B["groundable_entities"] = lambda d: "select entity_id, entity_text, count(*) as n from annotations where lower(entity_type) in ('protein', 'gene') group by entity_id, entity_text"
B["confidence_tier"] = lambda d: f"select source, target, {case('percentile', TIER, 'Low')} as tier, case when percentile >= 99 then 'Top 1% - highly likely interaction' when percentile >= 95 then 'Top 5% - strong prediction' when percentile >= 90 then 'Top 10% - moderate confidence' when percentile >= 75 then 'Top 25% - weak signal' else 'Below top 25% - low confidence' end as interpretation from {_RANKED} x"
B["score_band"] = lambda d: f"select source, target, {case('score', BAND, 'very_low')} as band from scored"
B["min_conf_filter"] = lambda d: "select source, target, coalesce(ml_score, 0.5E0) as confidence from relations where coalesce(ml_score, 0.5E0) >= 0.5E0"
B["partner_proteins"] = lambda d: "select distinct n.other as partner from neighbours n join seeds s on s.id = n.node where n.other not in (select id from seeds)"
# joins
B["cooc_pairs"] = lambda d: "select a, b, n as n_ab from shared_orders"
B["cooc_pmi"] = lambda d: "select a, b, n_ab, n_a, n_b, round(pmi, 6) as pmi, round(case when pmi >= 20 then n_ab when pmi <= -20 then 0 else n_ab / (1.0E0 + exp(-pmi)) end, 6) as weight from pmi"
B["cooc_llm_full_outer"] = lambda d: """select coalesce(c.a, l.a) as a, coalesce(c.b, l.b) as b, coalesce(l.kind, 'cooccurs_with') as relation_type,
    round(case when l.a is null then least(0.9E0, 0.3E0 + 0.1E0 * c.n) else l.confidence end, 6) as confidence, c.n as raw_count
    from (select a, b, n from shared_orders where n % 2 = 0) c
    full outer join (select a, b, 'activates' as kind, 0.7E0 as confidence from shared_orders where n % 3 = 0) l on lower(c.a) = lower(l.a) and lower(c.b) = lower(l.b)"""
B["type_fallback_lookup"] = lambda d: """select r.source, coalesce(a.type, b.type, c.type, 'unknown') as type from (select distinct case when seq % 3 = 0 then lower(source) when seq % 3 = 1 then source || ' ' else source end as source from relations) r
    left join typed a on a.id = r.source left join typed b on b.id = trim(r.source) left join typed c on lower(c.id) = lower(trim(r.source))"""
B["type_enrichment"] = lambda d: """select x.id, case when x.type <> 'unknown' then x.type when i.a is not null then 'protein' else 'unknown' end as type
    from (select distinct entity_id as id, case when entity_type = 'Chemical' then 'unknown' else lower(entity_type) end as type from annotations) x
    left join (select distinct a from interactions where score >= 0.9E0) i on i.a = x.id"""
B["candidate_nonedges"] = lambda d: "select a.id as source, b.id as target from seeds a join seeds b on a.id < b.id left join relations r on least(r.source, r.target) = a.id and greatest(r.source, r.target) = b.id where r.source is null"
B["relationship_lookup"] = lambda d: "select r.relation_type, r.ml_score, r.source, r.target from relations r where r.seq = (select min(seq) from relations where relation_type = 'activates')"
B["query_evidence"] = lambda d: """with asked as (select source as a, target as b from relations where source in (select id from seeds) or target in (select id from seeds) union select target, source from relations where source in (select id from seeds) or target in (select id from seeds)),
    typed_both as (select q.a, q.b, r.source, r.target, r.relation_type as kind from asked q join relations r on r.source = q.a and r.target = q.b
    union all select q.a, q.b, r.source, r.target, r.relation_type || '_reverse' from asked q join relations r on r.source = q.b and r.target = q.a
    where not exists (select 1 from relations f where f.source = q.a and f.target = q.b and f.relation_type = r.relation_type))
    select t.a, t.b, t.kind, count(e.source_id) as evidence_count, max(case when e.source_type = 'database' then 1 else 0 end) as has_string,
    max(case when e.source_type = 'literature' then 1 else 0 end) as has_literature, max(case when e.source_type = 'ml_predicted' then 1 else 0 end) as has_ml
    from typed_both t left join evidence e on e.source = t.source and e.target = t.target group by t.a, t.b, t.kind"""
B["neighbors_topk"] = lambda d: """select node, other, direction, relation_type, n_evidence, ml_score from (
    select n.node, n.other, n.direction, n.relation_type, n.ml_score, coalesce(e.n, 0) as n_evidence, row_number() over (partition by n.node order by coalesce(e.n, 0) desc, coalesce(n.ml_score, -1) desc, n.other, n.direction) as r
    from neighbours n left join (select source, target, count(*) as n from evidence group by source, target) e
    on e.source = case when direction = 'out' then node else other end and e.target = case when direction = 'out' then other else node end) x where r <= 5"""
B["shared_neighbors"] = lambda d: "select a.node as a, b.node as b, count(distinct a.other) as shared from neighbours a join neighbours b on a.other = b.other and a.node < b.node where a.node in (select id from seeds) group by a.node, b.node"
B["merge_interactions_anti"] = lambda d: """select a, b, round(score, 6) as score, 'base' as origin from interactions where score >= 0.5E0
    union all select y.b, y.a, round(y.score, 6), 'new' from interactions y where y.score >= 0.3E0 and not exists (select 1 from interactions x where x.score >= 0.5E0 and least(x.a, x.b) = least(y.a, y.b) and greatest(x.a, x.b) = greatest(y.a, y.b))"""
B["pipeline_input_merge"] = lambda d: """select 'article' as part, cast(doc_id as string) as id, '' as detail from {documents} where doc_id % 3 <> 2 union select 'article', cast(doc_id as string), '' from {documents} where doc_id % 3 <> 0
    union all select distinct 'annotation', cast(pmid as string), entity_text from annotations
    union all select 'interaction', least(a, b), greatest(a, b) from (select a, b from interactions where score >= 0.2E0 union select b, a from interactions) i group by least(a, b), greatest(a, b)
    union all select 'seed', id, '' from (select id from seeds union select id from typed where size = 1) z"""
B["in_reference_flag"] = lambda d: "select c.u, c.v, e.u is not null as in_reference from (select u, v from two_hop union all select u, v from edges) c left join edges e on e.u = c.u and e.v = c.v"
# aggregation
B["edge_confidence"] = lambda d: f"""select a, b, relation_type, count(distinct data_source) as n_sources, round(least(1.0E0, max({CONFIDENCE}) + 0.15E0 * (count(distinct data_source) - 1) + least(0.1E0 * (count(distinct evidence) - 1), 0.2E0)), 6) as confidence
    from (select least(source, target) as a, greatest(source, target) as b, relation_type, data_source, base, data_source || '/' || source as evidence from candidates) c group by a, b, relation_type"""
B["doc_freq"] = lambda d: "select entity, n from doc_counts"
B["graph_summary"] = lambda d: "select 'entity' as what, type as name, count(*) as n from typed group by type union all select 'relation', relation_type, count(*) from relations group by relation_type union all select 'evidence', source_type, count(*) from evidence group by source_type union all select 'total', 'ml_edges', count(*) from relations where ml_score is not null"
B["grounding_summary"] = lambda d: "select db, count(*) as n, sum(case when score >= 0.5E0 then 1 else 0 end) as accepted, round(avg(score), 6) as mean_score from groundings group by db"
B["interaction_summary"] = lambda d: "select count(*) as n, round(avg(score), 6) as mean_score, round(max(score), 6) as max_score, round(min(score), 6) as min_score, sum(case when score >= 0.7E0 then 1 else 0 end) as high from interactions"
B["mining_stats"] = lambda d: "select phase, count(*) as calls, sum(case when completion_tokens > 0 then 1 else 0 end) as answered, sum(case when completion_tokens > 0 then 0 else 1 end) as failures, round(sum(case when completion_tokens > 0 then 1 else 0 end) / (count(*) * 1.0E0), 6) as valid_rate, sum(prompt_tokens + completion_tokens) as tokens, round(sum(prompt_tokens + completion_tokens) / nullif(sum(latency_ms), 0) * 1000, 3) as tokens_per_s from usage group by phase"
B["batch_metrics"] = lambda d: "select count(*) as n, sum(prompt_tokens) as prompt_tokens, sum(completion_tokens) as completion_tokens, round(avg(latency_ms), 4) as mean_ms, round(sum(prompt_tokens + completion_tokens) / nullif(sum(latency_ms), 0) * 1000, 3) as tokens_per_s from usage"
B["phase_rollup"] = lambda d: "select coalesce(phase, 'total') as phase, count(*) as calls, sum(prompt_tokens) as prompt_tokens, sum(completion_tokens) as completion_tokens, round(avg(latency_ms), 4) as mean_ms from usage group by rollup(phase)"
B["cost_estimate"] = lambda d: "select phase, round(sum(u.prompt_tokens / 1.0E6 * coalesce(p.input, 0.5E0) + u.completion_tokens / 1.0E6 * coalesce(p.output, 1.5E0)), 6) as cost_usd from usage u left join (select 'small' as model, 0.075E0 as input, 0.3E0 as output union all select 'large', 1.25E0, 5.0E0) p on p.model = u.model group by phase"
B["evidence_per_doc_stats"] = lambda d: "select source_type, round(avg(n), 6) as mean_n, round(coalesce(stddev_samp(n), 0), 6) as std_n, round(avg(m), 6) as mean_distinct from (select source_type, source_id, count(*) as n, count(distinct source) as m from evidence group by source_type, source_id) x group by source_type"
B["degree_distribution_compare"] = lambda d: f"select kind, round(avg(degree), 6) as mean_degree, {d.quantile('degree', 0.5)} as median_degree, round(stddev_pop(degree), 6) as std_degree from (select 'all' as kind, degree from degrees union all select 'even', degree from degrees where node % 2 = 0) x group by kind"
B["graph_homophily"] = lambda d: """select round(s.same / (s.n * 1.0E0), 6) as homophily, round(p.expected, 6) as expected, case when s.same / (s.n * 1.0E0) >= 0.7E0 then 'high' when s.same / (s.n * 1.0E0) >= 0.5E0 then 'moderate' when s.same / (s.n * 1.0E0) >= 0.3E0 then 'low' else 'heterophilous' end as band
    from (select count(*) as n, sum(case when a.type = b.type then 1 else 0 end) as same from relations r join typed a on a.id = r.source join typed b on b.id = r.target) s
    cross join (select sum(share * share) as expected from (select count(*) / (sum(count(*)) over () * 1.0E0) as share from typed group by type) x) p"""
B["node_properties"] = lambda d: """select g.nodes, g.mean_degree, g.std_degree, g.max_degree, g.density, g.cv, round(c.closed / (g.nodes * 1.0E0), 9) as mean_clustering from
    (select count(*) as nodes, round(avg(degree), 6) as mean_degree, round(stddev_pop(degree), 6) as std_degree, max(degree) as max_degree, round(sum(degree) / (count(*) * (count(*) - 1.0E0)), 9) as density, round(stddev_pop(degree) / avg(degree), 6) as cv from degrees) g
    cross join (select coalesce(sum(t.n * 2.0E0 / (g.degree * (g.degree - 1))), 0) as closed from (select a.u as node, count(*) as n from both_ways a join both_ways b on a.u = b.u and a.v < b.v join edges e on e.u = a.v and e.v = b.v group by a.u) t join degrees g on g.node = t.node) c"""
B["community_dominant_type"] = lambda d: "select community, type, n from (select size % 10 as community, type, count(*) as n, row_number() over (partition by size % 10 order by count(*) desc, type) as r from typed group by size % 10, type) x where r = 1"
B["score_distribution"] = lambda d: f"select round({d.quantile('score', 0.5)}, 6) as p50, round({d.quantile('score', 0.95)}, 6) as p95, round({d.quantile('score', 0.99)}, 6) as p99, count(*) as n from scored"
_MODELS = "(select source, target, score as s from scored union all select source, target, score * score from scored union all select source, target, (score + 0.5E0) / 2 from scored)"
_AGREE = "case when min(s) <= 0.5E0 and max(s) > 0.5E0 then 'conflicting' when avg(s) = 0 then case when stddev_samp(s) < 0.05E0 then 'high' when stddev_samp(s) < 0.15E0 then 'moderate' else 'low' end when stddev_samp(s) / avg(s) < 0.1E0 then 'high' when stddev_samp(s) / avg(s) < 0.25E0 then 'moderate' else 'low' end"
B["ensemble_agreement"] = lambda d: f"select source, target, round(avg(s), 6) as mean_score, round(stddev_samp(s), 6) as std_score, {_AGREE} as agreement from {_MODELS} x group by source, target"
B["ensemble_mean_popstd"] = lambda d: f"select source, target, round(avg(s), 6) as mean_score, round(stddev_pop(s), 6) as std_score from {_MODELS} x group by source, target"
B["ensemble_interpretation"] = lambda d: f"select source, target, case when m >= 0.7E0 then 'likely' when m >= 0.5E0 then 'possible' else 'unlikely' end || ' interaction, ' || agreement || ' agreement (' || {d.fixed('m')} || ')' as interpretation from (select source, target, round(avg(s), 6) as m, {_AGREE} as agreement from {_MODELS} x group by source, target) y"
B["unique_entities"] = lambda d: "select source as entity from relations union select target from relations"
B["annotations_grouped"] = lambda d: f"select pmid, count(*) as n, {d.joined('entity', ',', True)} as entities from mentions group by pmid"
B["prune_delta_stats"] = lambda d: "select (select count(*) from relations) as edges_before, (select count(*) from relations where relation_type <> 'cooccurs_with') as edges_after, (select count(*) from (select source from relations union select target from relations) a) as nodes_before, (select count(*) from (select source from relations where relation_type <> 'cooccurs_with' union select target from relations where relation_type <> 'cooccurs_with') b) as nodes_after"
B["batch_prediction_summary"] = lambda d: "select source, target, coalesce(ml_score, 0) as score, (select round(avg(ml_score), 6) from relations) as mean_score, (select sum(case when ml_score >= 0.7E0 then 1 else 0 end) from relations) as n_high from relations order by coalesce(ml_score, 0) desc, source, target limit 50"
B["evidence_by_pmid"] = lambda d: f"select coalesce(source_id, 'Unknown') as pmid, {d.joined(chr(115) + 'ource || ' + chr(39) + '-' + chr(39) + ' || target', ';')} as snippets, count(*) as n from evidence where source_type = 'literature' group by coalesce(source_id, 'Unknown')"
B["network_extension_compare"] = lambda d: "select a.n as base_n, b.n as wide_n, b.n / (a.n * 1.0E0) as ratio, c.n as only_wide, p.base_nodes, p.wide_nodes, (p.wide_nodes - p.base_nodes) / (p.base_nodes * 1.0E0) as expansion from (select count(*) as n from interactions where score >= 0.6E0) a cross join (select count(*) as n from interactions where score >= 0.3E0) b cross join (select count(*) as n from (select a, b from interactions where score >= 0.3E0 except select a, b from interactions where score >= 0.6E0) x) c cross join (select count(distinct case when score >= 0.6E0 then id end) as base_nodes, count(distinct id) as wide_nodes from (select a as id, score from interactions where score >= 0.3E0 union all select b, score from interactions where score >= 0.3E0) y) p"
# ranking
_RANKED = "(select source, target, score, 100.0E0 * (rank() over (order by score) - 1) / count(*) over () as percentile from scored)"
B["score_percentile_tier"] = lambda d: f"select source, target, round(percentile, 1) as percentile, {case('percentile', TIER, 'none')} as tier from {_RANKED} x"
B["top_predictions"] = lambda d: "select source, target, score from scored where score >= 0.6E0 order by score desc, source, target limit 100"
B["enrichment_novel_budget"] = lambda d: """select source, target, kind, score from (select *, least(25, sum(case when kind = 'enrichment' then 1 else 0 end) over ()) as enriched, row_number() over (partition by kind order by score desc, source, target) as r
    from (select source, target, score, case when relation_type = 'hypothesized' then 'novel' else 'enrichment' end as kind from (select source, target, ml_score as score, relation_type from relations where ml_score >= 0.5E0) s) x) y where (kind = 'enrichment' and r <= enriched) or (kind = 'novel' and r <= 50 - enriched)"""
B["topn_per_class"] = lambda d: "select relation_type, source, target, ml_score from (select *, row_number() over (partition by relation_type order by ml_score desc, source, target) as r from relations where ml_score is not null) x where r <= 50"
B["seeds_first_order"] = lambda d: "select id, is_seed, row_number() over (order by is_seed desc, id) as place from (select t.id, case when s.id is null then 0 else 1 end as is_seed from typed t left join seeds s on s.id = t.id) x"
B["best_grounding"] = lambda d: "select term, db, db_id, score from (select *, row_number() over (partition by term order by case when db = 'HGNC' and score >= 0.5E0 then 0 else 1 end, case when db = 'HGNC' and score >= 0.5E0 then 0 else case db when 'HGNC' then 0 when 'CHEBI' then 3 when 'GO' then 4 when 'MESH' then 5 else 6 end end, score desc, pos) as r from groundings where trim(db) <> '' and trim(db_id) <> '') x where r = 1"
# sets
B["set_union_entities"] = lambda d: "select id from seeds union select source from relations where source <> '' union select target from relations where ml_score > 0.5E0"
B["set_intersect_neighbors"] = lambda d: "select other as node from neighbours where node in ('P1', 'P2', 'P3', 'P4', 'P5', 'P10') intersect select other from neighbours where node not in ('P1', 'P2', 'P3', 'P4', 'P5', 'P10')"
B["set_except_seeds"] = lambda d: "select source as node from relations except select id from seeds"
B["entity_union_sources"] = lambda d: f"""select entity, min(case when prio = first_prio then name end) as name, {d.joined("cast(prio as string) || ':' || src", ',', True)} as sources from (
    select entity, name, src, prio, min(prio) over (partition by entity) as first_prio from (
    select distinct upper(entity_id) as entity, entity_text as name, 'ner' as src, 1 as prio from annotations union all select distinct a, a, 'string', 2 from interactions where score >= 0.5E0) x) y group by entity"""
# resolution
B["resolve_name_chain"] = lambda d: "select q.q, coalesce(a.id, b.id, c.id) as id from (select distinct case when p_partkey % 3 = 0 then upper(p_name) when p_partkey % 3 = 1 then p_name else 'P' || cast(p_partkey as string) end as q from {part}) q left join typed a on a.id = q.q left join (select name, min(id) as id from typed group by name) b on b.name = q.q left join (select lower(name) as name, min(id) as id from typed group by lower(name)) c on c.name = lower(q.q)"
_SPACED = "replace(replace(trim(lower(raw)), '-', ' '), '_', ' ')"
B["canonicalize_synonyms"] = lambda d: f"""select raw, coalesce(a.canonical, b.canonical, raw) as canonical from (select distinct case p_partkey % 9 when 0 then 'Tnf-Alpha' when 1 then 'OX1R' when 2 then ' GSK-3b' when 3 then 'Amyloid beta' when 4 then 'alzheimers_disease' when 5 then 'APOE' when 6 then 'Beta-Amyloid' when 7 then 'Prepro_orexin' else p_name end as raw from {{part}}) x
    left join {values(SYNONYMS, 'word', 'canonical')} a on a.word = replace({_SPACED}, ' ', '') left join {values(SYNONYMS, 'word', 'canonical')} b on b.word = {_SPACED}"""
B["entity_key"] = lambda d: "select pmid, coalesce(nullif(trim(case when seq % 4 = 0 then ' ' else entity_id end), ''), lower(trim(entity_text))) as entity, count(*) as n from annotations group by pmid, coalesce(nullif(trim(case when seq % 4 = 0 then ' ' else entity_id end), ''), lower(trim(entity_text)))"
B["ground_entities"] = lambda d: "select t.id, case when g.db = 'HGNC' then g.db_id end as hgnc_id, case when g.db = 'DOID' then g.db_id end as doid_id, case when g.db = 'MESH' then g.db_id end as mesh_id, g.score from typed t left join (select term, db, db_id, score, row_number() over (partition by term order by score desc, pos) as r from groundings where score >= 0.5E0) g on g.term = t.name and g.r = 1"
B["ground_to_hgnc"] = lambda d: "select term, min(db_id) as db_id, max(score) as score from groundings where db = 'HGNC' and score >= 0.5E0 group by term"


def _dedup(group: str, where: str, order: str) -> str:
    return f"select id, first_value(id) over (partition by {group} order by {order}) as canonical from messy where {where}"


_NCBI = _dedup("ncbi", "ncbi not in ('', '-', 'None', 'null')", "case when id = upper(id) and length(id) between 2 and 6 then 0 else 1 end, length(id), lower(id)")
_SAME = "trim(replace(replace(lower(name), '''', ''), '-', ' '))"
B["dedup_ncbi"] = lambda d: _NCBI
B["dedup_case_insensitive"] = lambda d: f"select m.id, first_value(m.id) over (partition by {_SAME} order by case when substr(m.id, 1, 1) = upper(substr(m.id, 1, 1)) then 0 else 1 end, coalesce(g.degree, 0) desc, m.id) as canonical from messy m left join degrees g on 'P' || cast(g.node as string) = m.id"
B["dedup_hgnc"] = lambda d: "select id, canonical from (select t.id, first_value(t.id) over (partition by g.db_id order by case when lower(t.id) = lower(t.name) then 0 else 1 end, t.id) as canonical from typed t join (select term, min(db_id) as db_id from groundings where db = 'HGNC' group by term) g on g.term = t.name) x"
B["dedup_doid"] = lambda d: "select id, canonical from (select t.id, first_value(t.id) over (partition by replace(replace(lower(g.db_id), '''', ''), ' ', '_') order by t.id) as canonical from typed t join (select term, min(db_id) as db_id from groundings where db = 'DOID' group by term) g on g.term = t.name) x"
_MAPPED = f"select r.source as old_source, r.target as old_target, coalesce(a.canonical, r.source) as source, coalesce(b.canonical, r.target) as target, r.relation_type, r.ml_score from relations r left join ({_NCBI}) a on a.id = r.source left join ({_NCBI}) b on b.id = r.target"
B["remap_edges"] = lambda d: f"""select x.source, x.target, x.relation_type, x.merged, x.ml_score, coalesce(e.n_evidence, 0) as n_evidence, coalesce(e.source_ids, '') as source_ids from
    (select source, target, relation_type, count(*) as merged, max(ml_score) as ml_score from ({_MAPPED}) m group by source, target, relation_type) x
    left join (select m.source, m.target, m.relation_type, count(distinct e.source_id) as n_evidence, {d.joined('e.source_id', ',', True)} as source_ids from ({_MAPPED}) m join evidence e on e.source = m.old_source and e.target = m.old_target group by m.source, m.target, m.relation_type) e
    on e.source = x.source and e.target = x.target and e.relation_type = x.relation_type"""
B["alias_merge"] = lambda d: f"select canonical, {d.joined('id', ',', True)} as aliases, count(*) as n from ({_NCBI}) x where id <> canonical group by canonical"
B["dedup_pipeline"] = lambda d: f"select id, first_value(step) over (partition by {_SAME} order by step) as canonical from (select m.id, m.name, coalesce(a.canonical, m.id) as step from messy m left join ({_NCBI}) a on a.id = m.id) x"
# building
B["entity_upsert_last_wins"] = lambda d: "select id, name, type from (select id, name, type, row_number() over (partition by id order by seq desc) as r from (select entity_id as id, entity_text as name, entity_type as type, pmid * 1000000000 + seq % 1000000000 as seq from annotations union all select id, name, type, cast(-1 as bigint) from typed) x) y where r = 1"
B["relationship_upsert"] = lambda d: f"""select x.source, x.target, x.relation_type, x.ml_score, x.reasoning, coalesce(a.type, 'unknown') as source_type, coalesce(b.type, 'unknown') as target_type, coalesce(e.n, 0) as n_evidence, coalesce(e.source_ids, '') as source_ids from (
    select source, target, relation_type, max(ml_score) as ml_score, max(case when r = 1 then reasoning end) as reasoning from (
    select *, row_number() over (partition by source, target, relation_type order by case when reasoning is null then 1 else 0 end, batch desc) as r from (
    select source, target, relation_type, ml_score, case when seq % 2 = 0 then 'first' end as reasoning, 1 as batch from relations
    union all select source, target, relation_type, ml_score * 0.9E0 + 0.06E0, case when seq % 3 = 0 then 'second' end, 2 from relations where seq % 5 < 3) u) v group by source, target, relation_type) x
    left join typed a on a.id = x.source and a.size % 4 <> 0 left join typed b on b.id = x.target and b.size % 4 <> 0
    left join (select source, target, count(distinct source_id) as n, {d.joined('source_id', ',', True)} as source_ids from (select source, target, source_id from evidence union all select source, target, source_id from evidence where source_type = 'literature') y group by source, target) e on e.source = x.source and e.target = x.target"""
B["build_graph_live"] = lambda d: """select least(a, b) as source, greatest(a, b) as target, relation_type, max(score) as ml_score, count(*) as n_sources from (
    select a, b, 'interacts_with' as relation_type, round(score, 6) as score from interactions where score >= 0.4E0 union all select a, b, 'cooccurs_with', cast(null as double) from pairs where n_ab >= 2
    union all select a, b, 'activates', 0.7E0 from pairs where n_ab % 4 = 1) x group by least(a, b), greatest(a, b), relation_type"""
B["build_graph_tool"] = lambda d: "select source, target, relation_type, count(*) as n from (select a as source, b as target, 'interacts_with' as relation_type from interactions where score >= 0.7E0 union all select source, target, relation_type from relations) x group by source, target, relation_type"
B["merge_to_graph"] = lambda d: f"select a, b, relation_type, round(least(1.0E0, max({CONFIDENCE}) + 0.15E0 * (count(distinct data_source) - 1)), 6) as confidence, {d.joined('data_source', ',', True)} as sources, count(distinct data_source) > 1 as is_multi_source from (select least(source, target) as a, greatest(source, target) as b, relation_type, data_source, base from candidates) c group by a, b, relation_type"
B["prune_cooccurrence_only"] = lambda d: "select r.source, r.target, r.relation_type, a.type as source_type, b.type as target_type from relations r left join typed a on a.id = r.source left join typed b on b.id = r.target where r.relation_type in ('activates', 'inhibits', 'associated_with', 'regulates', 'binds_to', 'interacts_with')"
B["predictions_to_edges"] = lambda d: "select u, v, case when common >= 2 then 'interacts_with' else 'hypothesized' end as relation_type, case when common >= 2 then 'enrichment' else 'novel' end as link_category from two_hop"
B["expand_rebuild"] = lambda d: "select a, b, count(*) as n from (select distinct x.pmid, x.entity as a, y.entity as b from (select pmid, entity from mentions where pmid % 2 = 0 union select pmid, entity from mentions where pmid % 2 = 1 or pmid % 5 = 0) x join mentions y on x.pmid = y.pmid and x.entity < y.entity) z group by a, b"
B["network_expand_1hop"] = lambda d: "select r.source, r.target from relations r where r.source in (select n.other from neighbours n join seeds s on s.id = n.node) and r.target in (select n.other from neighbours n join seeds s on s.id = n.node)"
# graph measures without iteration
B["degree_centrality"] = lambda d: "select node, degree / ((select count(distinct u) from both_ways) - 1.0E0) as centrality from degrees"
B["clustering_coefficient"] = lambda d: "select g.node, round(coalesce(t.n, 0) * 2.0E0 / nullif(g.degree * (g.degree - 1), 0), 6) as clustering from degrees g left join (select node, count(*) as n from (select a.u as node, a.v as x, b.v as y from both_ways a join both_ways b on a.u = b.u and a.v < b.v join edges e on e.u = a.v and e.v = b.v) w group by node) t on t.node = g.node"
B["two_hop_pairs"] = lambda d: "select u, v, common from two_hop"
_LP = "from two_hop t join degrees a on a.node = t.u join degrees b on b.node = t.v"
B["lp_jaccard"] = lambda d: f"select t.u, t.v, round(t.common / (a.degree + b.degree - t.common * 1.0E0), 6) as score {_LP}"
B["lp_pref_attachment"] = lambda d: f"select t.u, t.v, a.degree * b.degree as score {_LP}"
_COMMON = "from both_ways a join both_ways b on a.v = b.u and a.u < b.v join degrees g on g.node = a.v left join edges e on e.u = a.u and e.v = b.v where e.u is null group by a.u, b.v"
B["lp_adamic_adar"] = lambda d: f"select a.u, b.v, round(sum(1.0E0 / ln(g.degree)), 6) as score {_COMMON}"
B["lp_resource_alloc"] = lambda d: f"select a.u, b.v, round(sum(1.0E0 / g.degree), 6) as score {_COMMON}"
B["lp_ensemble_topk"] = lambda d: f"select u, v, score, n_methods, round(100.0E0 * (rank() over (order by score) - 1) / count(*) over (), 1) as percentile from (select t.u, t.v, round(t.common / (a.degree + b.degree - t.common * 1.0E0) + x.adamic + x.alloc, 6) as score, 3 as n_methods {_LP} join (select a.u as u, b.v as v, sum(1.0E0 / ln(g.degree)) as adamic, sum(1.0E0 / g.degree) as alloc {_COMMON}) x on x.u = t.u and x.v = t.v) y order by score desc, u, v limit 100"
B["modularity_given_labels"] = lambda d: "select round(sum(inside / (2.0E0 * m) - (total / (2.0E0 * m)) * (total / (2.0E0 * m))), 9) as modularity from (select c, sum(case when c = c2 then 1 else 0 end) as inside, count(*) as total, max(m) as m from (select u % 5 as c, v % 5 as c2, (select count(*) from edges) as m from both_ways) x group by c) y"
B["entity_summary_text"] = lambda d: f"""select node, 'Known interactions for ' || node || ':' || chr(10) || {d.ordered('line', 'r', chr(10))} as summary from (select node, r, '  - ' || case when direction = 'out' then node || ' ' || relation_type || ' ' || other else other || ' ' || relation_type || ' ' || node end
    || case when n > 0 then ' (evidence: ' || cast(n as string) || ' sources)' else '' end || case when ml_score is null then '' else ' (ML score: ' || {d.fixed('coalesce(ml_score, 0.0E0)')} || ')' end as line from (
    select n.node, n.other, n.direction, n.relation_type, n.ml_score, coalesce(e.n, 0) as n, row_number() over (partition by n.node order by coalesce(e.n, 0) desc, coalesce(n.ml_score, 0) desc, n.direction desc, n.other) as r
    from neighbours n left join (select source, target, count(*) as n from evidence group by source, target) e on e.source = case when direction = 'out' then node else other end and e.target = case when direction = 'out' then other else node end) x where r <= 10) y group by node"""
# learning
B["edge_split_hash"] = lambda d: "select case when (u * 31 + v * 17) % 100 < 20 then 'test' else 'train' end as part, count(*) as n, sum(u) as sum_u, sum(v) as sum_v from edges group by case when (u * 31 + v * 17) % 100 < 20 then 'test' else 'train' end"
B["hadamard_features"] = lambda d: f"select a.vec_id as a, b.vec_id as b, {d.text(d.rounded(d.product('a.embedding', 'b.embedding')), ',')} as features from {{embeddings}} a join {{embeddings}} b on b.vec_id = a.vec_id + 1"
_ROC = "(select source, target, score, case when (length(source) + length(target)) % 2 = 0 then 1 else 0 end as y from scored)"
B["roc_auc_rank"] = lambda d: f"select round((sum(case when y = 1 then r end) - sum(y) * (sum(y) + 1) / 2.0E0) / (sum(y) * 1.0E0 * (count(*) - sum(y))), 9) as auc from (select y, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0E0 as r from {_ROC} x) z"
B["average_precision"] = lambda d: f"select round(sum((tp - before) / (pos * 1.0E0) * (tp / (seen * 1.0E0))), 9) as ap from (select tp, seen, pos, coalesce(lag(tp) over (order by score desc), 0) as before from (select score, sum(sum(y)) over (order by score desc) as tp, sum(count(*)) over (order by score desc) as seen, sum(sum(y)) over () as pos from {_ROC} x group by score) z) w"
B["roc_curve_points"] = lambda d: f"select score, sum(sum(y)) over (order by score desc) / (sum(sum(y)) over () * 1.0E0) as tpr, sum(count(*) - sum(y)) over (order by score desc) / (sum(count(*) - sum(y)) over () * 1.0E0) as fpr from {_ROC} x group by score"
B["degree_buckets"] = lambda d: "select cast(floor(log2(degree + 1)) as bigint) as bucket, count(*) as n from degrees group by cast(floor(log2(degree + 1)) as bigint)"
B["classify_enrichment_novel"] = lambda d: "select u, v, case when in_reference = 1 then 'enrichment' when common >= 2 then 'novel' else 'below' end as link_category from (select t.u, t.v, t.common, case when (t.u + t.v) % 9 = 0 then 1 else 0 end as in_reference from two_hop t) x"
# text
B["token_count_approx"] = lambda d: "select doc_id, cast(floor(length(text) / 4) as bigint) as tokens from {documents}"
B["seed_regex_extract"] = lambda d: f"select doc_id, {d.text(d.head(d.matching(d.all_found('text', '[A-Za-z0-9_]+'), '^[A-Z][A-Z0-9]{1,10}$'), 5), ',')} as seeds from {{documents}}"
B["query_validate"] = lambda d: "select event_id, case when length(q) = 0 then 'empty' when length(q) > 40 then 'too long' when length(replace(q, '(', '')) <> length(replace(q, ')', '')) then 'unbalanced' else 'ok' end as verdict from (select event_id, case event_id % 4 when 0 then '(' || event_type || ' AND x' when 1 then '' when 2 then '(' || event_type || ')' else event_type || ' AND a long further condition on it all' end as q from {events}) x"
B["query_truncate"] = lambda d: f"select event_id, {d.replaced('q', ' AND [^A]*$', '')} as cut from (select event_id, '(' || event_type || ') AND (user) AND part ' || cast(user_id as string) as q from {{events}}) x"
B["evidence_exact_match"] = lambda d: "select d.doc_id, b.item_id from {documents} d join {benchmark} b on instr(lower(d.text), lower(b.text)) > 0"
B["json_relationships_parse"] = lambda d: "select event_id, event_type as relation, cast({k_of_props} as double) / 100 as confidence from {events} where cast({k_of_props} as double) / 100 >= 0.5E0"

B["centrality_topk"] = lambda d: "select node, degree / ((select count(distinct u) from both_ways) - 1.0E0) as centrality from degrees order by degree desc, node limit 10"
B["ordered_entities"] = lambda d: f"select pmid, {d.ordered('entity_id', 'first', ',')} as entities from (select pmid, entity_id, min(seq) as first from annotations group by pmid, entity_id) x group by pmid"
B["cooc_by_weight"] = lambda d: "select a, b, n_ab, round(pmi, 6) as pmi from pmi order by n_ab desc, a, b limit 100"
QUERIES = {name: runner(name) for name in BODIES}
ORACLE = {name: sql_for(name, Duck(), lambda t: t) for name in BODIES}
