"""Queries over the DataFrame operators; SQL oracles where SQL can state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ligature.operators import build, fusion, graph, learning, text
from ligature.plans.dialect import Duck, Spark
from ligature.plans.relational import placed, views_for
from ligature.session import materialized, materialized_path, table
from ligature.sources.views import VIEWS, chain


def view(spark: SparkSession, sf_dir: str, name: str, given: dict[str, str] | None = None) -> DataFrame:
    """A view's rows; ``given`` has the text of views that are stated in another way here."""
    body = f"select * from {name}"
    views = VIEWS | given if given else views_for(spark, sf_dir, body)
    return spark.sql(placed(chain(body, views), Spark(), lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))


def duck(body: str) -> str:
    return placed(chain(body, kept=True), Duck(), lambda t: t)


def edges(spark, sf_dir):
    """Written once: a self-join that several steps read."""
    return materialized(view(spark, sf_dir, "edges"), "edges")


def articles(spark, sf_dir):
    return view(spark, sf_dir, "articles")


def _candidates(spark, sf_dir):
    found = view(spark, sf_dir, "candidates")
    return found.withColumn("evidence_id", F.concat("data_source", F.lit("/"), "source")).withColumn("seq", F.struct("prio", "source", "target"))


def edge_fusion(spark, sf_dir):
    x = fusion.fuse(_candidates(spark, sf_dir))
    return x.select("source", "target", "relation_type", F.array_join("evidence_ids", ",").alias("evidence_ids"), F.array_join("sources", ",").alias("sources"), "is_multi_source", F.round("confidence", 6).alias("confidence"))


_FUSED = """select source, target, relation_type, array_to_string(evidence, ',') as evidence_ids, array_to_string(sources, ',') as sources, len(sources) > 1 as is_multi_source,
    round(least(1.0, best + 0.15 * (len(sources) - 1) + least(0.1 * (len(evidence) - 1), 0.2)), 6) as confidence from (
    select min_by(source, (prio, source, target)) as source, min_by(target, (prio, source, target)) as target, relation_type, list_sort(list(distinct data_source || '/' || source)) as evidence, list_sort(list(distinct data_source)) as sources,
    max(case data_source when 'STRING' then 0.9 * least(base, 1.0) when 'llm' then 0.7 else case when base > 2 then 0.5 * (0.5 + 0.5 * least(base / 5.0, 1.0)) else 0.25 end end) as best
    from candidates group by case when relation_type = 'activates' then source else least(source, target) end, case when relation_type = 'activates' then target else greatest(source, target) end, relation_type) x"""


def flagship_fused_pairs(spark, sf_dir):
    """Pairs associated more than chance, fused over sources: the 50 of highest confidence."""
    return edge_fusion(spark, sf_dir).orderBy(F.col("confidence").desc(), "source", "target", "relation_type").limit(50)


def pagerank_k10(spark, sf_dir):
    return graph.pagerank(edges(spark, sf_dir)).select("node", F.round("rank", 9).alias("rank"))


def _pagerank_sql(rounds: int = 10) -> str:
    steps = ["nodes as (select u as node from edges union select v from edges)", "outs as (select u, count(*) as c from edges group by u)", "r0 as (select node, 1.0::double / (select count(*) from nodes) as rank from nodes)"]
    for i in range(rounds):
        steps.append(f"r{i + 1} as (select n.node, 0.15 / (select count(*) from nodes) + 0.85 * (coalesce(f.flow, 0) + (select coalesce(sum(rank), 0) from r{i} where node not in (select u from outs)) / (select count(*) from nodes)) as rank from nodes n left join (select e.v as node, sum(r.rank / o.c) as flow from edges e join outs o on o.u = e.u join r{i} r on r.node = e.u group by e.v) f on f.node = n.node)")
    return f"with {', '.join(steps)} select node, round(rank, 9) as rank from r{rounds}"


def connected_components(spark, sf_dir):
    return graph.connected_components(edges(spark, sf_dir))


_COMPONENTS = "with recursive reach(node, r) as (select u, u from both_ways union select b.v, reach.r from reach join both_ways b on b.u = reach.node) select node, min(r) as component from reach group by node"


def _sources(spark, sf_dir):
    return edges(spark, sf_dir).select(F.col("u").alias("source")).where("source % 40 = 1").distinct()


def shortest_path(spark, sf_dir):
    return graph.distances(edges(spark, sf_dir), _sources(spark, sf_dir), 6).select("source", "node", "distance")


_DIST = "with recursive walk(source, node, d) as (select distinct u, u, 0 from edges where u % 40 = 1 union select w.source, e.v, w.d + 1 from walk w join {links} e on e.u = w.node where w.d < {depth}) select source, node, min(d) as distance from walk group by source, node"


def closeness(spark, sf_dir):
    return graph.closeness(edges(spark, sf_dir), _sources(spark, sf_dir), 6).select("node", F.round("closeness", 9).alias("closeness"))


def betweenness(spark, sf_dir):
    return graph.betweenness(edges(spark, sf_dir)).select("node", F.round("betweenness", 6).alias("betweenness"))


def communities(spark, sf_dir):
    return graph.communities(edges(spark, sf_dir))


def simple_paths_cutoff(spark, sf_dir):
    e = edges(spark, sf_dir)
    start, end = e.agg(F.min("u"), F.max("v")).first()
    return graph.simple_paths(e, start, end, 4).select(F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


_PATHS = "with recursive ends as (select min(u) as s, max(v) as t from edges), walk(node, path, d) as (select s, [s], 0 from ends union all select e.v, list_append(w.path, e.v), w.d + 1 from walk w join edges e on e.u = w.node, ends where w.d < 4 and not list_contains(w.path, e.v) and w.node <> t) select array_to_string(path, ',') as path from walk, ends where node = t and d > 0"


def annotate_path(spark, sf_dir):
    r = view(spark, sf_dir, "relations").groupBy("source", "target").agg(F.min_by("relation_type", "seq").alias("relation_type"), F.max("ml_score").alias("ml_score"))
    n = view(spark, sf_dir, "evidence").groupBy("source", "target").agg(F.count("*").alias("n_evidence"))
    return r.join(n, ["source", "target"], "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)))


_ANNOTATED = "select r.source, r.target, min_by(relation_type, seq) as relation_type, max(ml_score) as ml_score, coalesce(max(n), 0) as n_evidence from relations r left join (select source, target, count(*) as n from evidence group by source, target) e on e.source = r.source and e.target = r.target group by r.source, r.target"


def node2vec_walks(spark, sf_dir):
    return graph.walks(edges(spark, sf_dir), 8, 2).select("walk", "start", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


def _features(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    a, b = e.select(F.col("vec_id").alias("u"), F.col("embedding").alias("a"), F.col("label").alias("la")), e.select(F.col("vec_id").alias("v"), F.col("embedding").alias("b"), F.col("label").alias("lb"))
    near = a.join(b, (F.col("v") > F.col("u")) & (F.col("v") <= F.col("u") + 5) & (F.floor(F.col("u") / 100) == F.floor(F.col("v") / 100)))
    return near.select("u", "v", learning.hadamard().alias("features"), (F.col("la") == F.col("lb")).cast("int").alias("y"))


def lr_train_score(spark, sf_dir):
    x = _features(spark, sf_dir)
    return learning.predict(learning.train(x.where(~learning.is_test())), x.where(learning.is_test())).select("u", "v", "y", F.round("score", 4).alias("score"))


def predict_pairs(spark, sf_dir):
    return lr_train_score(spark, sf_dir).withColumn("verdict", F.when(F.col("score") >= 0.5, "likely").otherwise("unlikely"))


def eval_strategies(spark, sf_dir):
    e = edges(spark, sf_dir)
    n = e.count()
    deg = graph.both_ways(e).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("d"))
    out = None
    for name, f in (("random", learning.random_negatives), ("two_hop", learning.two_hop_negatives), ("degree", learning.degree_matched_negatives), ("combined", learning.combined_negatives)):
        rows = e.select("u", "v", F.lit(1).alias("y")).union(f(e, n).select("u", "v", F.lit(0)))
        rows = rows.join(deg.withColumnsRenamed({"node": "u", "d": "du"}), "u").join(deg.withColumnsRenamed({"node": "v", "d": "dv"}), "v").select((F.col("du") * F.col("dv")).alias("score"), "y")
        row = learning.roc_auc(rows).select(F.lit(name).alias("strategy"), F.round("auc", 6).alias("auc"))
        out = row if out is None else out.union(row)
    return out


def hypothesis_record(spark, sf_dir):
    hop = view(spark, sf_dir, "two_hop").where("common >= 1")
    deg = view(spark, sf_dir, "degrees")
    x = hop.join(deg.withColumnsRenamed({"node": "u", "degree": "du"}), "u").join(deg.withColumnsRenamed({"node": "v", "degree": "dv"}), "v")
    score = F.round(F.col("common") / (F.col("du") + F.col("dv") - F.col("common")), 6)
    return x.select("u", "v", score.alias("score"), F.concat(F.lit("P"), F.col("u").cast("string"), F.lit(" may interact with P"), F.col("v").cast("string"), F.lit(" through "), F.col("common").cast("string"), F.lit(" shared neighbours")).alias("hypothesis"))


_HYPOTHESIS = "select t.u, t.v, round(t.common / (a.degree + b.degree - t.common)::double, 6) as score, 'P' || t.u || ' may interact with P' || t.v || ' through ' || t.common || ' shared neighbours' as hypothesis from two_hop t join degrees a on a.node = t.u join degrees b on b.node = t.v"


def sentence_split(spark, sf_dir):
    return articles(spark, sf_dir).select("pmid", F.posexplode(text.sentences()).alias("i", "sentence"))


_SPLIT = """select pmid, i, s[i + 1] as sentence from (select pmid, s, unnest(range(0, len(s))) as i from (select pmid, list_filter(list_transform(string_split(regexp_replace(abstract, '([.?!])([ \n\t]|$)', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^[ \n\t\r]+|[ \n\t\r]+$', '', 'g')), lambda x: length(x) > 10) as s from articles) a) b"""


def sentence_number(spark, sf_dir):
    return articles(spark, sf_dir).select("pmid", text.numbered(text.sentences()).alias("numbered"))


_NUMBERED = f"select pmid, coalesce(n, '') as numbered from (select a.pmid, string_agg('[' || (i + 1) || '] ' || sentence, chr(10) order by i) as n from articles a left join ({_SPLIT}) x on x.pmid = a.pmid group by a.pmid) y"


def greedy_chunks(spark, sf_dir):
    return text.greedy_chunks(articles(spark, sf_dir), "source", "pmid", 2000)


_CHUNKS = """with recursive t as (select source, pmid, floor(length(abstract) / 4)::bigint as n, row_number() over (partition by source order by pmid) as r from articles),
    w(source, pmid, r, held, chunk) as (select source, pmid, r, n, 0::bigint from t where r = 1 union all
    select t.source, t.pmid, t.r, case when w.held > 0 and w.held + t.n > 2000 then t.n else w.held + t.n end, case when w.held > 0 and w.held + t.n > 2000 then w.chunk + 1 else w.chunk end from w join t on t.source = w.source and t.r = w.r + 1)
    select source, pmid, chunk from w"""


def _claims(spark, sf_dir):
    return articles(spark, sf_dir).select(F.col("pmid").alias("claim"), F.when(F.col("pmid") % 9 == 0, -1).otherwise(F.col("pmid")).alias("pmid"), F.array(F.lit(1), (F.col("pmid") % 4).cast("int"), (F.col("pmid") % 30).cast("int")).alias("indices"))


def provenance_indexed(spark, sf_dir):
    return text.provenance(_claims(spark, sf_dir), articles(spark, sf_dir)).select("claim", "pmid_valid", "evidence_valid", F.round("similarity", 6).alias("similarity"))


_COUNTED = f"select c.pmid as claim, case when c.pmid % 9 = 0 then -1 else c.pmid end as p, [1, c.pmid % 4, c.pmid % 30] as ix from articles c"
_PROVENANCE = f"""select claim, known as pmid_valid, known and ok = 3 as evidence_valid, round(ok / 3.0, 6) as similarity from (select claim, a.pmid is not null as known, len(list_filter(ix, lambda i: i >= 1 and i <= coalesce(s.n, 0))) as ok
    from ({_COUNTED}) c left join articles a on a.pmid = c.p left join (select pmid, count(*) as n from ({_SPLIT}) z group by pmid) s on s.pmid = c.p) y"""


def evidence_from_indices(spark, sf_dir):
    return text.provenance(_claims(spark, sf_dir), articles(spark, sf_dir)).select("claim", "evidence")


_EVIDENCE = f"""select claim, coalesce(string_agg(sentence, ' ' order by k), '') as evidence from (select claim, p, unnest(ix) as ix, unnest([1, 2, 3]) as k from ({_COUNTED}) c) x left join ({_SPLIT}) s on s.pmid = x.p and s.i + 1 = x.ix group by claim"""


def evidence_fuzzy(spark, sf_dir):
    found = articles(spark, sf_dir).select(F.col("pmid").alias("claim"), text.sentences().alias("found"))
    return text.fuzzy_evidence(found.select("claim", F.concat(F.get("found", F.lit(0)), F.lit(" x")).alias("evidence"), "found"))


def prompt_assembly(spark, sf_dir):
    chunks = text.greedy_chunks(articles(spark, sf_dir), "source", "pmid", 2000)
    parts = articles(spark, sf_dir).select("pmid", F.concat(F.lit("PMID "), F.col("pmid").cast("string"), F.lit(":\n"), text.numbered(text.sentences())).alias("part"))
    return chunks.join(parts, "pmid").groupBy("source", "chunk").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pmid", "part"))), lambda x: x.part), "\n\n").alias("prompt"))


_PROMPT = f"select c.source, c.chunk, string_agg('PMID ' || c.pmid || ':' || chr(10) || n.numbered, chr(10) || chr(10) order by c.pmid) as prompt from ({{chunks}}) c join ({_NUMBERED}) n on n.pmid = c.pmid group by c.source, c.chunk"


def pagerank(spark, sf_dir):
    return graph.pagerank_converged(edges(spark, sf_dir)).select("node", F.round("rank", 9).alias("rank"))


def closeness_inward(spark, sf_dir):
    return graph.closeness_inward(edges(spark, sf_dir)).select("node", F.round("closeness", 9).alias("closeness"))


def betweenness_directed(spark, sf_dir):
    return graph.betweenness_directed(edges(spark, sf_dir)).select("node", F.round("betweenness", 9).alias("betweenness"))


def _shared_orders(spark, sf_dir) -> str:
    """The view shared_orders over a written table: pairs are counted and kept by the suppliers' numbers,
    and orders are dealt out once."""
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s")).join(known, "s", "left_semi")
    held = lines.repartition("o").distinct()
    path = materialized_path(held.join(held.withColumnRenamed("s", "t"), "o").where("s < t").groupBy("s", "t").agg(F.count("*").alias("n")), "shared_orders")
    return f"select least('S' || s, 'S' || t) as a, greatest('S' || s, 'S' || t) as b, n from parquet.`{path}`"


def _live(spark, sf_dir):
    """The live graph's inputs: annotated names with synonyms among them, interactions, and literature
    that writes names in other ways."""
    a = view(spark, sf_dir, "annotations").withColumn("entity_text", F.expr("case entity_id when 'S1' then 'OX-1R' when 'S2' then 'orexin receptor 1' when 'S3' then 'abeta' else entity_id end")).withColumn("entity_type", F.expr("case when entity_id in ('S4', 'S5') then 'unknown' else entity_type end"))
    a = a.select("pmid", "entity_text", "entity_type", (F.col("pmid") * 10_000_000_000 + F.col("seq")).alias("seq"))
    given = {"shared_orders": _shared_orders(spark, sf_dir)}
    i = view(spark, sf_dir, "interactions", given).where("score >= 0.6").selectExpr("a", "b", "round(score, 6) as score", "cast(substr(a, 2) as bigint) * 1000000 + cast(substr(b, 2) as bigint) as seq")
    p = view(spark, sf_dir, "pairs", given).where("n_ab % 4 = 1")
    l = p.selectExpr("lower(a) as entity1", "case when n_ab % 8 = 1 then 'Amyloid-Beta' else b end as entity2", "case n_ab % 3 when 0 then 'Activates' when 1 then 'binds' else 'regulates' end as relationship", "case when n_ab % 8 = 5 then 0.7D end as confidence", "n_ab as pmid", "a || b as evidence_text", "cast(substr(a, 2) as bigint) * 1000000 + cast(substr(b, 2) as bigint) as seq")
    return build.live_graph(a, i, l)


def live_graph_relations(spark, sf_dir):
    r = _live(spark, sf_dir)[1]
    total = F.aggregate("evidence", F.lit(0.0), lambda x, e: x + e.confidence)
    return r.select("source", "target", "relation_type", F.size("evidence").cast("long").alias("n_evidence"), F.round(total, 4).alias("confidence"), F.array_join(F.array_sort(F.transform("evidence", lambda e: e.source_id)), ",").alias("source_ids"))


def live_graph_entities(spark, sf_dir):
    return _live(spark, sf_dir)[0].select("id", "type", "name")


_LIVE_SQL = """ann as (select pmid, entity_text as raw, ty, sq, case when entity_text in ('OX-1R', 'orexin receptor 1') then 'HCRTR1' when entity_text = 'abeta' then 'APP' else entity_text end as id from (
      select pmid, case entity_id when 'S1' then 'OX-1R' when 'S2' then 'orexin receptor 1' when 'S3' then 'abeta' else entity_id end as entity_text, lower(case when entity_id in ('S4', 'S5') then 'unknown' else entity_type end) as ty, pmid * 10000000000 + seq as sq from annotations) z),
    inter as (select a, b, round(score, 6) as score from interactions where score >= 0.6),
    lit as (select lower(a) as source, case when n_ab % 8 = 1 then 'APP' else b end as target, case n_ab % 3 when 0 then 'activates' when 1 then 'associated_with' else 'regulates' end as kind, case when n_ab % 8 = 5 then 0.7 else 0.5 end as conf, n_ab as pmid, cast(substr(a, 2) as bigint) * 1000000 + cast(substr(b, 2) as bigint) as sq, lower(a) as raw1, case when n_ab % 8 = 1 then 'Amyloid-Beta' else b end as raw2 from pairs where n_ab % 4 = 1)"""
_LIVE_RELATIONS = f"""with {_LIVE_SQL}, held as (select distinct pmid, id from ann),
    ev as (select x.id as source, y.id as target, 'cooccurs_with' as relation_type, 'PMID:' || x.pmid as sid, 0.3 as conf, 1 as o from held x join held y on x.pmid = y.pmid and x.id < y.id
      union all select a, b, 'interacts_with', 'STRING:' || a || '-' || b, score, 1 from inter union all select source, target, kind, 'PMID:' || pmid, conf, sq from lit)
    select source, target, relation_type, count(*) as n_evidence, round(sum(conf), 4) as confidence, string_agg(sid, ',' order by sid) as source_ids from (select source, target, relation_type, sid, min_by(conf, o) as conf from ev group by source, target, relation_type, sid) q group by source, target, relation_type"""
_LIVE_ENTITIES = f"""with {_LIVE_SQL}, words as (select w, max_by(ty, sq) as ty from (select raw as w, ty, sq from ann union all select lower(raw), ty, sq from ann union all select upper(raw), ty, sq from ann union all select replace(replace(replace(lower(raw), '-', ''), '_', ''), ' ', ''), ty, sq from ann
      union all select id, ty, sq from ann where id <> raw union all select lower(id), ty, sq from ann where id <> raw) q where ty <> 'unknown' group by w),
    noted as (select id, max_by(ty, sq) as ty from ann group by id), prot as (select a as id from inter union select b from inter),
    reads as (select id, min_by(raw, sq) as raw from (select source as id, raw1 as raw, sq from lit union all select target, raw2, sq from lit) q group by id),
    told as (select r.id, coalesce(a.ty, b.ty, c.ty, d.ty, 'unknown') as ty from reads r left join words a on a.w = r.id left join words b on b.w = r.raw left join words c on c.w = lower(r.raw) left join words d on d.w = replace(replace(replace(lower(r.raw), '-', ''), '_', ''), ' ', '')),
    firsts as (select i.id, case when p.id is not null then 'protein' else coalesce(n.ty, t.ty) end as ty from (select id from noted union select id from prot union select id from told) i left join prot p on p.id = i.id left join noted n on n.id = i.id left join told t on t.id = i.id)
    select f.id, case when f.ty = 'unknown' then coalesce(a.ty, b.ty, c.ty, d.ty, f.ty) else f.ty end as type, f.id as name from firsts f left join words a on a.w = replace(replace(replace(lower(f.id), '-', ''), '_', ''), ' ', '') left join words b on b.w = f.id left join words c on c.w = lower(f.id) left join words d on d.w = upper(f.id)"""


def component_delta(spark, sf_dir):
    """Components of the graph before and after relations that only occur together have left."""
    r = view(spark, sf_dir, "relations").select(F.substring("source", 2, 20).cast("long").alias("u"), F.substring("target", 2, 20).cast("long").alias("v"), "relation_type")
    r = materialized(r, "relations")
    count = lambda e: graph.connected_components(e).select("component").distinct().count()
    return spark.createDataFrame([(count(r.select("u", "v")), count(r.where("relation_type <> 'cooccurs_with'").select("u", "v")))], "components_before long, components_after long")




def node2vec_link_prediction(spark, sf_dir, p: float = 1.0, q: float = 1.0, length: int = 20, per_node: int = 4):
    """AUC and average precision of held-out edges by strategy of negatives: walks and embeddings of the
    training edges, products of embeddings, logistic regression trained against random negatives."""
    e = edges(spark, sf_dir).select("u", "v")
    held = learning.is_test()
    train, test = materialized(e.where(~held), "train"), materialized(e.where(held), "test")
    vectors = materialized(learning.node_embeddings(graph.node2vec_walks(train, p, q, length, per_node)), "vectors")
    n, m = train.count(), test.count()
    labelled = train.withColumn("y", F.lit(1)).union(learning.random_negatives(e, n, 7).withColumn("y", F.lit(0)))
    model = learning.train(materialized(learning.pair_features(labelled, vectors), "features"))
    out = None
    for name, f in (("random", learning.random_negatives), ("two_hop", learning.two_hop_negatives), ("degree", learning.degree_matched_negatives), ("combined", learning.combined_negatives)):
        rows = test.withColumn("y", F.lit(1)).union(f(e, m).select("u", "v").withColumn("y", F.lit(0)))
        scored = materialized(learning.predict(model, learning.pair_features(rows, vectors)).select("score", "y"), "scored")
        row = learning.roc_auc(scored).crossJoin(learning.average_precision(scored)).select(F.lit(name).alias("strategy"), F.round("auc", 6).alias("auc"), F.round("ap", 6).alias("ap"))
        out = row if out is None else out.union(row)
    return out


def candidate_nonedges(spark, sf_dir, block: int = 2048):
    """Pairs of seeds without a relation. Seeds go in blocks of about ``block``; a task pairs the seeds of
    two blocks, and each carries the seeds it is related to, so that pairs never shuffle."""
    seeds = view(spark, sf_dir, "seeds")
    given = {"bought": "select distinct l_orderkey as o, l_partkey as p from {lineitem} where l_partkey % 50 = 0 and l_partkey in (select p_partkey from {part} where p_partkey % 50 = 0)"}
    r = materialized(view(spark, sf_dir, "relations", given).select("source", "target"), "relations")
    related = r.union(r.select("target", "source")).groupBy(F.col("source").alias("id")).agg(F.collect_set("target").alias("related"))
    seeds = materialized(seeds.join(related, "id", "left"), "seeds")
    blocks = max(1, -(-seeds.count() // block))
    own, cells = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), blocks * (blocks + 1) // 2
    a = seeds.select("related", F.col("id").alias("a"), own.alias("x")).withColumn("y", F.explode(F.sequence("x", F.lit(blocks - 1)))).repartition(cells, "x", "y")
    b = seeds.select(F.col("id").alias("b"), own.alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), "y"))).repartition(cells, "x", "y")
    pairs = a.join(b.hint("shuffle_hash"), ["x", "y"]).where("(x < y or a < b) and not coalesce(array_contains(related, b), false)")
    return pairs.select(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target"))


def negatives(f):
    return lambda spark, sf_dir: f(edges(spark, sf_dir), 1000)


QUERIES = {f.__name__: f for f in (edge_fusion, flagship_fused_pairs, pagerank_k10, connected_components, shortest_path, closeness, betweenness, communities, simple_paths_cutoff, annotate_path, node2vec_walks, lr_train_score, predict_pairs, eval_strategies, hypothesis_record, sentence_split, sentence_number, greedy_chunks, provenance_indexed, evidence_from_indices, evidence_fuzzy, prompt_assembly, pagerank, closeness_inward, betweenness_directed, live_graph_relations, live_graph_entities, component_delta, node2vec_link_prediction, candidate_nonedges)}
QUERIES |= {"neg_random": negatives(learning.random_negatives), "neg_two_hop": negatives(learning.two_hop_negatives), "neg_degree_matched": negatives(learning.degree_matched_negatives), "neg_combined": negatives(learning.combined_negatives)}


def _recursive(text: str) -> str:
    return text.replace("with ", "with recursive ", 1).replace(", recursive ", ", ", 1) if "with recursive" in text or ", recursive " in text else text


ORACLE = {
    "edge_fusion": duck(_FUSED),
    "flagship_fused_pairs": duck(_FUSED + " order by confidence desc, source, target, relation_type limit 50"),
    "pagerank_k10": duck(_pagerank_sql()),
    "connected_components": _recursive(duck(_COMPONENTS)),
    "shortest_path": _recursive(duck(_DIST.replace("{links}", "edges").replace("{depth}", "6"))),
    "closeness": _recursive(duck(_DIST.replace("{links}", "both_ways").replace("{depth}", "6").replace("select source, node, min(d) as distance from walk group by source, node", "select source as node, round(count(*) / sum(d)::double * count(*) / ((select count(distinct u) from both_ways) - 1.0), 9) as closeness from (select source, node, min(d) as d from walk group by source, node) z where d > 0 group by source"))),
    "live_graph_relations": duck(_LIVE_RELATIONS),
    "live_graph_entities": duck(_LIVE_ENTITIES),
    "simple_paths_cutoff": _recursive(duck(_PATHS)),
    "annotate_path": duck(_ANNOTATED),
    "hypothesis_record": duck(_HYPOTHESIS),
    "sentence_split": duck(_SPLIT),
    "sentence_number": duck(_NUMBERED),
    "greedy_chunks": _recursive(duck(_CHUNKS)),
    "provenance_indexed": duck(_PROVENANCE),
    "evidence_from_indices": duck(_EVIDENCE),
}
