"""Queries against their SQL oracles, and operators on hand-made rows."""

import difflib
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from ligature.operators import fusion, graph, learning, text
from ligature.plans import catalog, frames

SF = "/root/testdata/sf0.001"
SOME = ["cooc_pmi", "edge_confidence", "edge_fusion", "flagship_fused_pairs", "graph_summary", "phase_rollup", "score_percentile_tier", "average_precision", "roc_auc_rank", "remap_edges", "canonicalize_synonyms", "map_relation_type", "relkey_parse", "sentence_split", "provenance_indexed", "greedy_chunks", "connected_components", "lp_adamic_adar", "modularity_given_labels", "seed_regex_extract"]


def plain(rows):
    def one(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        return repr(round(float(v), 6) + 0.0) if isinstance(v, int | float) and not (isinstance(v, float) and math.isnan(v)) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(f"select {', '.join(columns)} from ({catalog.ORACLE[name]}) q")
    assert plain(got.select(*columns).collect()) == plain(want.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_fusion_keeps_the_first_orientation_and_the_best_score(spark):
    rows = [("a", "b", "interacts_with", "STRING", 0.8, "e1", 1), ("B", "A", "interacts_with", "llm", None, "e2", 2), ("a", "b", "activates", "llm", None, "e3", 3), ("b", "a", "activates", "cooccurrence", 2.0, "e4", 4)]
    out = {(r.source, r.target, r.relation_type): r for r in fusion.fuse(spark.createDataFrame(rows, "source string, target string, relation_type string, data_source string, base double, evidence_id string, seq int")).collect()}
    assert len(out) == 3
    both = out["a", "b", "interacts_with"]
    assert both.sources == ["STRING", "llm"] and both.is_multi_source and abs(both.confidence - (0.72 + 0.15 + 0.1)) < 1e-9
    assert out["b", "a", "activates"].confidence == 0.25


def test_sentences(spark):
    df = spark.createDataFrame([("What is this? It is amazing! And this is the end.",), (None,), ("Hi. This is a proper sentence with enough length.",)], "abstract string")
    assert [len(r[0]) for r in df.select(text.sentences()).collect()] == [3, 0, 1]


def test_graph_measures(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 3), (10, 11)], "u long, v long")
    assert {r.node: r.component for r in graph.connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10}
    assert abs(sum(r.rank for r in graph.pagerank(edges, 5).collect()) - 1) < 1e-9
    all_nodes = spark.createDataFrame([(n,) for n in (1, 2, 3, 4)], "source long")
    assert {r.node: r.betweenness for r in graph.betweenness(edges, all_nodes, 4).collect()}[3] == 4.0
    assert sorted(r.path for r in graph.simple_paths(edges, 1, 4, 4).collect()) == [[1, 2, 3, 4], [1, 3, 4]]


def brute_centrality(pairs):
    """Distances by source, and Brandes' betweenness over ordered pairs, of an undirected graph."""
    near, reached, passed = {}, {}, {}
    for u, v in pairs:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    for s in near:
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
            for x in near[y]:
                if far[x] == far[y] - 1:
                    own[x] += paths[x] / paths[y] * (1 + own[y])
            if y != s:
                passed[y] = passed.get(y, 0) + own[y]
        reached[s] = far
    return reached, passed


def test_centrality_takes_all_nodes_and_any_distance(spark):
    pairs = [(i, i + 1) for i in range(1, 12)] + [(3, 20), (20, 5), (30, 31)]
    reached, passed = brute_centrality(pairs)
    edges = spark.createDataFrame(pairs, "u long, v long")
    for block in (4096, 4):
        got = {r.node: r.betweenness for r in graph.betweenness(edges, block=block).collect()}
        assert got.keys() == passed.keys() and all(abs(got[n] - passed[n]) < 1e-9 for n in got)
    both = graph.both_ways(edges)
    assert {(r.source, r.node): r.distance for r in graph.distances(both).collect()} == {(s, n): d for s, far in reached.items() for n, d in far.items()}
    r, d = {s: len(far) - 1 for s, far in reached.items()}, {s: sum(far.values()) for s, far in reached.items()}
    got = {x.node: x.closeness for x in graph.closeness(edges).collect()}
    assert got.keys() == r.keys() and all(abs(got[s] - r[s] / d[s] * r[s] / (len(r) - 1)) < 1e-9 for s in got)


def test_betweenness_query_scores_every_node(spark):
    e = [(r.u, r.v) for r in frames.edges(spark, SF).collect()]
    want = brute_centrality(e)[1]
    got = {r.node: r.betweenness for r in catalog.QUERIES["betweenness"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-5 for n in got)


def best_by_difflib(evidence, found):
    e = (evidence or "").lower()
    return max([1.0 if e in s.lower() else difflib.SequenceMatcher(None, e, s.lower()).ratio() for s in found], default=0.0) if e else 0.0


def test_fuzzy_evidence_searches_all_sentences(spark):
    late = [f"Sentence number {i} tells of other things." for i in range(9)] + ["BRCA1 binds to RAD51 in the nucleus of the cell."]
    rows = [(1, "brca1 binds RAD51 in the nucleus of a cell", late), (2, "BRCA1 binds to RAD51", late), (3, "anything", []), (4, None, late), (5, "", late), (6, "x", None)]
    got = {r.claim: (r.similarity, r.valid) for r in text.fuzzy_evidence(spark.createDataFrame(rows, "claim long, evidence string, found array<string>")).collect()}
    assert got[1] == (best_by_difflib(rows[0][1], late), True) and got[1][0] > best_by_difflib(rows[0][1], late[:3])
    assert got[2] == (1.0, True) and all(got[i] == (0.0, False) for i in (3, 4, 5, 6))


def test_evidence_fuzzy_query_keeps_every_text(spark):
    found = {r.pmid: r.found for r in frames.articles(spark, SF).select("pmid", text.sentences().alias("found")).collect()}
    got = {r.claim: (r.similarity, r.valid) for r in catalog.QUERIES["evidence_fuzzy"](spark, SF).collect()}
    assert got.keys() == found.keys()
    for pmid in sorted(found)[:60]:
        want = best_by_difflib(found[pmid][0] + " x" if found[pmid] else None, found[pmid])
        assert got[pmid] == (want, want >= 0.7)


def test_each_strategy_has_a_negative_for_each_edge(spark, monkeypatch):
    some = "/root/testdata/sf0.01"
    e, seen, auc = frames.edges(spark, some), [], learning.roc_auc
    n = e.count()
    assert n > 3000 and learning.degree_matched_negatives(e, n).join(e, ["u", "v"]).isEmpty()
    monkeypatch.setattr(learning, "roc_auc", lambda rows: seen.append({r.y: r["count"] for r in rows.groupBy("y").count().collect()}) or auc(rows))
    assert catalog.QUERIES["eval_strategies"](spark, some).count() == 4
    assert seen == [{1: n, 0: n}] * 4


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], "score double, y int")
    assert learning.roc_auc(df).first()[0] == 0.875
