"""Building a property graph: tables of entities and of relations with their evidence.

Relations come from rows (source, target, relation_type, ml_score, seq, evidence), merged by their
key; evidence is a struct or null. Everything is joins and aggregations over written or given tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligature.functions.names import canonical_name, extracted_type, lookup_key
from ligature.session import materialized

KEY = ("source", "target", "relation_type")
EVIDENCE = "struct<source_type: string, source_id: string, confidence: double, text_snippet: string>"


def evidence(kind: str, source_id: Column, confidence: Column, snippet: Column | None = None) -> Column:
    text = (F.lit(None) if snippet is None else snippet).cast("string")
    return F.struct(F.lit(kind).alias("source_type"), source_id.alias("source_id"), confidence.cast("double").alias("confidence"), text.alias("text_snippet"))


def merged_relations(rows: DataFrame) -> DataFrame:
    """One row per key: the highest ml_score, and the evidence in the order of seq, the first of each
    source_id. Repeated source_ids are reduced before a key's evidence is brought together."""
    single = rows.groupBy(*KEY, F.col("evidence.source_id").alias("_id")).agg(F.max("ml_score").alias("ml_score"), F.min(F.when(F.col("evidence").isNotNull(), F.struct("seq", "evidence"))).alias("e"))
    ordered = F.transform(F.sort_array(F.collect_list("e")), lambda x: x.evidence)
    return single.groupBy(*KEY).agg(F.max("ml_score").alias("ml_score"), ordered.alias("evidence"))


def with_endpoints(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities (id, type, name), and as unknown the ends of relations that aren't among them."""
    ends = relations.select(F.col("source").alias("id")).union(relations.select("target")).distinct()
    return entities.unionByName(ends.join(entities, "id", "left_anti").select("id", F.lit("unknown").alias("type"), F.col("id").alias("name")))


def remapped(relations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Relations between canonical entities (mapping: alias, canonical); those that become one are
    merged with their evidence. Relations of an entity to itself may arise and stay."""
    ends = {e: mapping.select(F.col("alias").alias(e), F.col("canonical").alias(f"_{e}")) for e in ("source", "target")}
    rows = reduce(lambda t, e: t.join(ends[e], e, "left").withColumn(e, F.coalesce(f"_{e}", e)), ends, relations.withColumn("_old", F.struct("source", "target")))
    rows = rows.select(*KEY, "ml_score", "_old", F.posexplode_outer("evidence").alias("_at", "evidence"))
    return merged_relations(rows.withColumn("seq", F.struct("_old", "_at")))


def _types(annotations: DataFrame) -> DataFrame:
    """word, type: what each way to write an annotated entity says of its type; the last one counts."""
    text, canonical = F.col("entity_text"), canonical_name(F.col("entity_text"))
    other = canonical != text
    words = F.array(text, F.lower(text), F.upper(text), lookup_key(text), F.when(other, canonical), F.when(other, F.lower(canonical)))
    known = annotations.select("seq", F.lower(F.coalesce("entity_type", F.lit("unknown"))).alias("type"), F.explode(words).alias("word"))
    return known.where("word <> '' and type not in ('unknown', '')").groupBy("word").agg(F.max_by("type", "seq").alias("type"))


def _first_type(rows: DataFrame, types: DataFrame, words: list[Column]) -> DataFrame:
    """``rows`` with found: the type of the first of ``words`` that has one."""
    asked = rows.select("id", F.posexplode(F.array(*words)).alias("at", "word"))
    found = asked.join(types, "word").groupBy("id").agg(F.min_by("type", "at").alias("found"))
    return rows.join(found, "id", "left")


def live_graph(annotations: DataFrame, interactions: DataFrame, literature: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (id, type, name) and relations (source, target, relation_type, ml_score, evidence) of
    annotations (pmid, entity_text, entity_type, seq), interactions (a, b, score, seq) and literature
    (entity1, entity2, relationship, confidence, pmid, evidence_text, seq).

    Annotated entities under their canonical names, of the type annotated last, occur together where
    they share a document, in the order of their names; interacting ones are proteins; entities that
    only the literature has take the type of an annotation written alike, as do those left unknown.

    What entities need is first reduced to one row per way of writing, by plain maxima and minima, and
    written, so that neither names nor types are looked up per row of the inputs."""
    named = annotations.where("entity_text <> ''")
    kinds = materialized(named.groupBy("entity_text", F.lower(F.coalesce("entity_type", F.lit("unknown"))).alias("entity_type")).agg(F.max("seq").alias("seq")), "kinds")
    types = _types(kinds)
    last = kinds.groupBy(canonical_name(F.col("entity_text")).alias("id")).agg(F.max_by("entity_type", "seq").alias("noted"))
    pairs = interactions.where("a <> '' and b <> ''")
    proteins = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("protein", F.lit(True))
    told = literature.where("entity1 <> '' and entity2 <> ''")
    raw = told.select("seq", F.explode(F.array("entity1", "entity2")).alias("raw")).groupBy("raw").agg(F.min("seq").alias("seq"))
    raw = materialized(raw.groupBy(canonical_name(F.col("raw")).alias("id")).agg(F.min_by("raw", "seq").alias("raw")), "raw")
    read = _first_type(raw, types, [F.col("id"), F.col("raw"), F.lower("raw"), lookup_key(F.col("raw"))]).select("id", F.coalesce("found", F.lit("unknown")).alias("read"))
    both = last.join(proteins, "id", "full_outer").join(read, "id", "full_outer")
    first = materialized(both.select("id", F.when(F.col("protein"), "protein").otherwise(F.coalesce("noted", "read")).alias("type")), "first")
    found = _first_type(first, types, [lookup_key(F.col("id")), F.col("id"), F.lower("id"), F.upper("id")])
    entities = found.select("id", F.when(F.col("type").isin("unknown", ""), F.coalesce("found", "type")).otherwise(F.col("type")).alias("type"), F.col("id").alias("name"))

    held = named.select("pmid", canonical_name(F.col("entity_text")).alias("id")).distinct()
    told = told.withColumns({"source": canonical_name(F.col("entity1")), "target": canonical_name(F.col("entity2"))})
    together = held.join(held.withColumnRenamed("id", "other"), "pmid").where("id < other")
    none = F.lit(None).cast("double").alias("ml_score")
    order = lambda step, seq: F.struct(F.lit(step).alias("step"), F.col(seq).cast("long").alias("at")).alias("seq")
    about = F.concat(F.lit("PMID:"), F.col("pmid").cast("string"))
    rows = [
        together.select(F.col("id").alias("source"), F.col("other").alias("target"), F.lit("cooccurs_with").alias("relation_type"), none, order(2, "pmid"), evidence("literature", about, F.lit(0.3)).alias("evidence")),
        pairs.select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("interacts_with").alias("relation_type"), none, order(3, "seq"), evidence("string", F.concat(F.lit("STRING:"), "a", F.lit("-"), "b"), F.col("score")).alias("evidence")),
        told.select("source", "target", extracted_type(F.col("relationship")).alias("relation_type"), none, order(4, "seq"), evidence("literature", about, F.coalesce("confidence", F.lit(0.5)), F.col("evidence_text")).alias("evidence")),
    ]
    return entities, merged_relations(reduce(DataFrame.union, rows))


def relations_of_fused(fused: DataFrame) -> DataFrame:
    """Relations of fused edges (source, target, relation_type, confidence, pmids, texts, data_sources,
    string_score): a literature evidence per pmid, then one of the interactions' source if it is among
    the sources; text i goes to evidence i. Ends are upper-cased, confidence becomes the ml_score."""
    papers = F.transform("pmids", lambda p: evidence("literature", p, F.col("confidence")))
    known = F.when(F.array_contains("data_sources", "STRING"), F.array(evidence("string", F.lit("STRING_DB"), F.coalesce("string_score", F.lit(0.7))))).otherwise(F.array().cast(f"array<{EVIDENCE}>"))
    all_ = F.concat(papers, known)
    noted = F.transform(all_, lambda e, i: e.withField("text_snippet", F.nullif(F.get("texts", i), F.lit(""))))
    upper = lambda c: F.upper(F.trim(c)).alias(c)
    return fused.select(upper("source"), upper("target"), "relation_type", F.col("confidence").alias("ml_score"), noted.alias("evidence"))


def kept_if_typed(entities: DataFrame, relations: DataFrame, typed: tuple[str, ...] = ("activates", "inhibits", "associated_with", "regulates", "binds_to", "interacts_with")) -> tuple[DataFrame, DataFrame]:
    """Entities with a typed relation, and the typed relations without their scores."""
    kept = relations.where(F.col("relation_type").isin(*typed)).select(*KEY, "evidence")
    ends = kept.select(F.col("source").alias("id")).union(kept.select("target")).distinct()
    return entities.join(ends, "id", "left_semi"), kept
