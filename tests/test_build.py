"""Graph building, names, readers and measures against hand-made rows and brute force."""

import gzip
import json
import random

import numpy as np
import pytest

from ligature.functions import names
from ligature.functions.vocabularies import SYNONYMS
from ligature.operators import build, graph, learning
from ligature.plans import catalog, frames
from ligature.plans.dialect import Spark
from ligature.sources import readers


def test_names(spark):
    rows = [("OX-1R",), (" gsk 3b ",), ("Beta_Amyloid",), ("apoe ε4",), ("Novel-X",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(names.canonical_name(_col("x"))).collect()]

    def plain(x):
        spaced = x.lower().strip().replace("-", " ").replace("_", " ")
        return SYNONYMS.get(spaced.replace(" ", ""), SYNONYMS.get(spaced, x))

    assert got == [None if x is None else plain(x) for (x,) in rows] and got[0] == "HCRTR1" and len(SYNONYMS) == 102
    kinds = spark.createDataFrame([("Up-Regulates", "SNP"), (" linked to", ""), ("sings", " Drug "), ("co occurs with", "odd")], "r string, e string")
    assert [tuple(r) for r in kinds.select(names.relation_type(_col("r")), names.entity_type(_col("e"))).collect()] == [("activates", "mutation"), ("associated_with", "unknown"), ("associated_with", "chemical"), ("cooccurs_with", "odd")]


def _col(name):
    from pyspark.sql import functions as F

    return F.col(name)


ROWS = "source string, target string, relation_type string, ml_score double, seq int, evidence struct<source_type: string, source_id: string, confidence: double, text_snippet: string>"


def told(relations):
    return {(r.source, r.target, r.relation_type): (r.ml_score, [(e.source_id, e.confidence) for e in r.evidence]) for r in relations.collect()}


def test_relations_are_merged_by_key(spark):
    rows = [("a", "b", "t", 0.2, 1, ("literature", "1", 0.5, None)), ("a", "b", "t", 0.9, 2, ("literature", "1", 0.7, "x")), ("a", "b", "t", None, 3, ("string", "2", 0.4, None)), ("b", "a", "t", None, 4, None)]
    got = build.merged_relations(spark.createDataFrame(rows, ROWS))
    assert told(got) == {("a", "b", "t"): (0.9, [("1", 0.5), ("2", 0.4)]), ("b", "a", "t"): (None, [])}
    ends = build.with_endpoints(spark.createDataFrame([("a", "gene", "A")], readers.ENTITIES), got)
    assert {tuple(r) for r in ends.collect()} == {("a", "gene", "A"), ("b", "unknown", "b")}
    mapping = spark.createDataFrame([("b", "a")], "alias string, canonical string")
    assert told(build.remapped(got, mapping)) == {("a", "a", "t"): (0.9, [("1", 0.5), ("2", 0.4)])}
    assert build.merged_relations(got.limit(0).selectExpr("source", "target", "relation_type", "ml_score", "1 as seq", "evidence[0] as evidence")).count() == 0


def test_live_graph(spark):
    notes = [("1", "OX1R", "Gene", 1), ("1", "sleep", "Disease", 2), ("2", "Ox 1R", "unknown", 3), ("2", "tau-like", "Protein", 4), ("2", "", "Gene", 5)]
    a = spark.createDataFrame(notes, "pmid string, entity_text string, entity_type string, seq int")
    i = spark.createDataFrame([("HCRTR1", "HCRT", 0.9, 1)], "a string, b string, score double, seq int")
    l = spark.createDataFrame([("TAU LIKE", "sleep", "Inhibits", None, "9", "said", 1), ("x", "y", "sings", 0.6, "9", None, 2), ("", "y", "binds_to", 0.6, "9", None, 3)], "entity1 string, entity2 string, relationship string, confidence double, pmid string, evidence_text string, seq int")
    entities, relations = build.live_graph(a, i, l)
    assert {r.id: r.type for r in entities.collect()} == {"HCRTR1": "protein", "HCRT": "protein", "sleep": "disease", "tau-like": "protein", "TAU LIKE": "protein", "x": "unknown", "y": "unknown"}
    assert told(relations) == {
        ("HCRTR1", "sleep", "cooccurs_with"): (None, [("PMID:1", 0.3)]), ("HCRTR1", "tau-like", "cooccurs_with"): (None, [("PMID:2", 0.3)]), ("HCRTR1", "HCRT", "interacts_with"): (None, [("STRING:HCRTR1-HCRT", 0.9)]),
        ("TAU LIKE", "sleep", "inhibits"): (None, [("PMID:9", 0.5)]), ("x", "y", "associated_with"): (None, [("PMID:9", 0.6)]),
    }
    kept, typed = build.kept_if_typed(entities, relations)
    assert typed.count() == 3 and {r.id for r in kept.collect()} == {"HCRTR1", "HCRT", "TAU LIKE", "sleep", "x", "y"}
    none = build.live_graph(a.limit(0), i.limit(0), l.limit(0))
    assert [t.count() for t in none] == [0, 0]


def test_relations_of_fused_edges(spark):
    rows = [("brca1 ", "TP53", "interacts_with", 0.9, ["11", "12"], ["one", "", "three"], ["STRING", "llm"], 0.8), ("a", "b", "activates", 0.7, None, None, ["llm"], None), ("a", "c", "activates", 0.7, [], ["lost"], ["STRING"], None)]
    df = spark.createDataFrame(rows, "source string, target string, relation_type string, confidence double, pmids array<string>, texts array<string>, data_sources array<string>, string_score double").fillna({})
    df = df.selectExpr("source", "target", "relation_type", "confidence", "coalesce(pmids, array()) as pmids", "coalesce(texts, array()) as texts", "data_sources", "string_score")
    got = {(r.source, r.target): [(e.source_type, e.source_id, e.confidence, e.text_snippet) for e in r.evidence] for r in build.relations_of_fused(df).collect()}
    assert got == {("BRCA1", "TP53"): [("literature", "11", 0.9, "one"), ("literature", "12", 0.9, None), ("string", "STRING_DB", 0.8, "three")], ("A", "B"): [], ("A", "C"): [("string", "STRING_DB", 0.7, "lost")]}


def test_readers_of_interaction_tables(spark, tmp_path):
    with gzip.open(tmp_path / "info.tsv.gz", "wt") as f:
        f.write("#id\tname\tsize\n9.P1\tAAA\t3\n9.P2\tBBB\t4\n9.P3\tAAA\t5\nbroken\n")
    assert {(r.name, r.id) for r in readers.protein_info(spark, f"file://{tmp_path}/info.tsv.gz").collect()} == {("AAA", "9.P1"), ("BBB", "9.P2")}
    (tmp_path / "links.txt").write_text("protein1 protein2 combined_score\n9.P1 9.P2 900\n9.P1 9.P3 300\nx\n")
    assert [tuple(r) for r in readers.links(spark, f"file://{tmp_path}/links.txt", 700).collect()] == [("9.P1", "9.P2", 900)]
    assert readers.links(spark, f"file://{tmp_path}/links.txt").count() == 2


def test_articles_of_xml(spark, tmp_path):
    one = """<PubmedArticle><MedlineCitation><PMID Version="1">77</PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>2019 Jan-Feb</MedlineDate></PubDate></JournalIssue><Title>J. of Things</Title></Journal><ArticleTitle>On a &amp; b</ArticleTitle><Abstract><AbstractText Label="AIM">To see.</AbstractText><AbstractText>We saw &lt;2.</AbstractText><AbstractText Label="END"/></Abstract><AuthorList><Author><LastName>Li</LastName><ForeName>Bo</ForeName></Author><Author><CollectiveName>Group</CollectiveName></Author><Author><LastName>Solo</LastName></Author></AuthorList></Article></MedlineCitation></PubmedArticle>"""
    two = "<PubmedArticle><MedlineCitation><PMID>78</PMID><Article><Journal><JournalIssue><PubDate><Year>2020</Year></PubDate></JournalIssue></Journal></Article></MedlineCitation></PubmedArticle>"
    (tmp_path / "a.xml").write_text(f'<?xml version="1.0"?>\n<PubmedArticleSet>{one}\n{two}<PubmedArticle><PMID/></PubmedArticle></PubmedArticleSet>')
    got = {r.pmid: (r.title, r.abstract, r.year, r.journal, r.authors) for r in readers.pubmed_articles(spark, f"file://{tmp_path}/a.xml").collect()}
    assert got == {"77": ("On a & b", "AIM: To see. We saw <2. END: ", "2019", "J. of Things", ["Bo Li", "Solo"]), "78": ("", "", "2020", "", [])}


def test_annotations_of_bioc_json(spark, tmp_path):
    note = lambda t, text, **k: {"infons": {"type": t, **k}, "text": text}
    docs = [{"id": "5", "passages": [{"annotations": [note("Gene", "BRCA1", identifier="672"), note("Gene", "", identifier="1"), note("Species", "mouse")]}, {"annotations": [note("Disease", "flu", normalized_id=["D1", "D2"])]}]}]
    for name, value in (("wrapped", {"PubTator3": docs}), ("listed", docs), ("single", docs[0])):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
        got = {tuple(r) for r in readers.bioc_annotations(spark, f"file://{tmp_path}/{name}.json").collect()}
        assert got == {("5", "672", "BRCA1", "Gene"), ("5", "D1", "flu", "Disease")}
    (tmp_path / "broken.json").write_text("{oops")
    assert readers.bioc_annotations(spark, f"file://{tmp_path}/broken.json").count() == 0


@pytest.mark.parametrize("kind", ["parquet", "json", "graphml"])
def test_graphs_come_back(spark, tmp_path, kind):
    entities = spark.createDataFrame([("a<b", "gene", 'A "x"'), ("c", "disease", "C&D")], readers.ENTITIES)
    rows = [("a<b", "c", "activates", 0.5, [("literature", "1", 0.5, 'said "so" & <more>')]), ("c", "a<b", "binds_to", None, [])]
    relations = spark.createDataFrame(rows, readers.RELATIONS)
    path = f"file://{tmp_path}/g"
    readers.write_graph(entities, relations, path, kind)
    e, r = readers.read_graph(spark, path, kind)
    assert sorted(map(tuple, e.collect())) == sorted(map(tuple, entities.collect()))
    assert sorted(map(str, r.collect())) == sorted(map(str, relations.collect()))


def test_two_decimals_as_python_rounds(spark):
    values = [0.695, 0.245, 0.155, 0.125, 0.375, 0.005, 0.045, 1.005, 99.995, 0.0, 1.0] + [i / 1000 for i in range(0, 2000, 5)] + [random.Random(1).random() for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "x double").selectExpr("x", f"{Spark().fixed('x')} as t")
    assert [(r.x, r.t) for r in df.collect()] == [(v, f"{v:.2f}") for v in values]


def random_graph(n, m, seed):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n)) for _ in range(m)]


def test_directed_measures_equal_brute_force(spark):
    pairs = [(u, v) for u, v in random_graph(14, 40, 3) if u != v] + [(90, 91)]
    edges = spark.createDataFrame(pairs, "u long, v long")
    nodes = sorted({x for p in pairs for x in p})
    near = {x: {v for u, v in pairs if u == x} for x in nodes}
    n, passed, dist = len(nodes), dict.fromkeys(nodes, 0.0), {}
    for s in nodes:
        far, paths, order = {s: 0}, {s: 1}, [s]
        for x in order:
            for y in near[x]:
                if y not in far:
                    far[y], paths[y] = far[x] + 1, 0
                    order.append(y)
                if far[y] == far[x] + 1:
                    paths[y] += paths[x]
        own = dict.fromkeys(order, 0.0)
        for y in reversed(order):
            for x in order:
                if y in near[x] and far[x] == far[y] - 1:
                    own[x] += paths[x] / paths[y] * (1 + own[y])
            if y != s:
                passed[y] += own[y]
        dist[s] = far
    got = {r.node: r.betweenness for r in graph.betweenness_directed(edges).collect()}
    assert got.keys() == passed.keys() and all(abs(got[x] - passed[x] / ((n - 1) * (n - 2))) < 1e-9 for x in nodes)
    want = {}
    for x in nodes:
        d = [dist[s][x] for s in nodes if s != x and x in dist[s]]
        want[x] = len(d) / sum(d) * len(d) / (n - 1) if d else 0.0
    got = {r.node: r.closeness for r in graph.closeness_inward(edges).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in nodes)
    out = {x: sum(u == x for u, _ in pairs) for x in nodes}
    rank = dict.fromkeys(nodes, 1 / n)
    for _ in range(100):
        loose = sum(rank[x] for x in nodes if not out[x])
        new = {x: 0.15 / n + 0.85 * (sum(rank[u] / out[u] for u, v in pairs if v == x) + loose / n) for x in nodes}
        change, rank = sum(abs(new[x] - rank[x]) for x in nodes), new
        if change < n * 1e-6:
            break
    got = {r.node: r.rank for r in graph.pagerank_converged(edges).collect()}
    assert got.keys() == rank.keys() and all(abs(got[x] - rank[x]) < 1e-9 for x in nodes)
    assert graph.pagerank_converged(edges.limit(0)).count() == 0


def test_walks_follow_edges_and_their_weights(spark):
    pairs = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3)]
    edges = spark.createDataFrame(pairs, "u long, v long")
    linked = {frozenset(p) for p in pairs}

    def turns(p, q):
        rows = graph.node2vec_walks(edges, p, q, 10, 30).collect()
        assert len(rows) == 6 * 30 and all(len(r.path) == 10 and r.path[0] == r.start and all(frozenset(s) in linked for s in zip(r.path, r.path[1:], strict=False)) for r in rows)
        steps = [(a, c) for r in rows for a, c in zip(r.path, r.path[2:], strict=False)]
        return sum(a == c for a, c in steps) / len(steps)

    assert turns(0.05, 1.0) > 0.8 > 0.55 > turns(1.0, 1.0) > 0.1 > turns(20.0, 0.5)


def test_average_precision(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.2, 1)]
    got = learning.average_precision(spark.createDataFrame(rows, "score double, y int")).first()[0]
    assert abs(got - (1 / 3 * 1 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 5)) < 1e-12


@pytest.mark.parametrize("shard", [20_000, 40])
def test_vectors_of_nodes_are_trained_in_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(learning, "SHARD", shard)
    ring = [(10 * c + i, 10 * c + j) for c in range(6) for i in range(10) for j in range(i + 1, 10)]
    walks = graph.node2vec_walks(spark.createDataFrame(ring, "u long, v long"), length=10, per_node=8)
    found = learning.node_embeddings(walks, rounds=2)
    # from files, not from rows that the driver holds
    assert "FileScan parquet" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "LocalTableScan" not in plan
    v = {r.node: np.array(r.embedding) / np.linalg.norm(r.embedding) for r in found.collect()}
    assert set(v) == set(range(60)) and all(len(x) == 32 for x in v.values())
    same = [v[a] @ v[b] for a in v for b in v if a < b and a // 10 == b // 10]
    other = [v[a] @ v[b] for a in v for b in v if a < b and a // 10 != b // 10]
    assert np.mean(same) > np.mean(other) + 0.3


def test_measures_without_a_class_are_null(spark):
    for rows in ([(0.9, 0), (0.2, 0)], [(0.9, 1)], []):
        scored = spark.createDataFrame(rows, "score double, y int")
        assert learning.roc_auc(scored).first()[0] is None
        assert (learning.average_precision(scored).first()[0] is None) == (not any(y for _, y in rows))


@pytest.mark.parametrize("pairs", [60, 0])
def test_link_prediction_where_no_held_out_edge_has_known_nodes(spark, tmp_path, pairs):
    # every edge stands alone, so the ends of held-out ones are in no walk; or there are no edges
    lines = [(2 * i + o, 2 * i + p) for i in range(pairs) for o in (0, 1) for p in (0, 1)] or [(1, 1), (1, 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.strategy: (r.auc, r.ap) for r in frames.node2vec_link_prediction(spark, str(tmp_path), length=3, per_node=1).collect()}
    assert got == dict.fromkeys(("random", "two_hop", "degree", "combined"), (None, None))


def test_entities_of_the_live_graph_are_read_from_what_was_reduced_once(spark):
    # neither orders nor pairs of suppliers are in the plan, so none is evaluated several times
    found = frames.live_graph_entities(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "l_suppkey" not in plan and "n_ab" not in plan and found.count() == 16


def test_pairs_of_seeds_without_a_relation(spark, tmp_path):
    lines = [(o, p) for o in (1, 2) for p in (50, 200, 300, 7)] + [(3, 100), (3, 150), (4, 400), (5, 400), (4, 900), (5, 900)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p,) for p in [*range(0, 801), 50]], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    seeds = [f"P{p}" for p in [*range(0, 801, 50), 50]]
    want = sorted((a, b) for a in seeds for b in seeds if a < b and not {a, b} <= {"P50", "P200", "P300"})
    for block in (2048, 3):
        found = frames.candidate_nonedges(spark, str(tmp_path), block)
        assert sorted(map(tuple, found.collect())) == want
    # pairs are made by an equal join of blocks, with nothing dealt out above it
    plan = catalog.QUERIES["candidate_nonedges"](spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.index("HashJoin") < plan.index("Exchange")
