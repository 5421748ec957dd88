"""Readers of the formats that facts come in, and graphs in JSON and GraphML.

Paths go through Spark, so they may lie in any store that it reads. Malformed records give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ligature.operators.build import EVIDENCE, KEY


def protein_info(spark: SparkSession, path: str) -> DataFrame:
    """name, id of a TSV (.gz) of protein ids and names: of a name's rows the one that comes first."""
    rows = spark.read.option("sep", "\t").csv(path).select(F.col("_c0").alias("id"), F.col("_c1").alias("name"), F.monotonically_increasing_id().alias("seq"))
    return rows.where("id not like '#%' and name is not null").groupBy("name").agg(F.min_by("id", "seq").alias("id"))


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """alias, id of a TSV (.gz) of protein ids and aliases: of an alias's rows the one that comes first."""
    return protein_info(spark, path).select(F.col("name").alias("alias"), "id")


def links(spark: SparkSession, path: str, least: int = 0) -> DataFrame:
    """a, b, score of a file of links, fields apart by white space, score in thousandths last of at least six or third."""
    fields = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(fields.alias("f")).where(F.size("f") >= 3)
    score = F.try_element_at("f", F.when(F.size("f") >= 6, 6).otherwise(3)).try_cast("int")
    return rows.select(F.get("f", 0).alias("a"), F.get("f", 1).alias("b"), score.alias("score")).where(F.col("score") >= least)


def _all(xml: Column, path: str) -> Column:
    return F.xpath(xml, F.lit(path))


def pubmed_articles(spark: SparkSession, path: str) -> DataFrame:
    """pmid, title, abstract, year, journal, authors of an XML file's PubmedArticle elements. Parts of
    an abstract are joined by a blank, with their label before a colon."""
    rows = spark.read.option("lineSep", "</PubmedArticle>").text(path).select(F.concat(F.regexp_extract("value", r"(?s)(<PubmedArticle[ >].*)$", 1), F.lit("</PubmedArticle>")).alias("x"))
    rows = rows.where("x like '<PubmedArticle%'")
    x = F.col("x")
    first = lambda p: F.get(_all(x, p), 0)
    date = first("//PubDate/MedlineDate/text()")
    counted = rows.select(x, first("(//PMID)[1]/text()").alias("pmid"), F.coalesce(first("//ArticleTitle/text()"), F.lit("")).alias("title"), F.coalesce(first("//PubDate/Year/text()"), F.substring(date, 1, 4)).alias("year"), F.coalesce(first("//Journal/Title/text()"), F.lit("")).alias("journal"))
    tags = F.regexp_extract_all(x, F.lit(r"(?s)(<AbstractText[^>]*?(?:/>|>.*?</AbstractText>))"), F.lit(1))
    label = lambda t: F.regexp_extract(t, r'^<AbstractText[^>]*\bLabel="([^"]*)"', 1)
    text = lambda t: unescaped(F.regexp_extract(t, r"(?s)^<AbstractText[^>]*>([^<]*)", 1))
    abstract = F.array_join(F.transform(tags, lambda t: F.when(label(t) != "", F.concat(label(t), F.lit(": "), text(t))).otherwise(text(t))), " ")
    people = F.regexp_extract_all(x, F.lit(r"(?s)(<Author[ >].*?</Author>)"), F.lit(1))
    last = lambda t: unescaped(F.regexp_extract(t, r"<LastName>([^<]*)", 1))
    fore = lambda t: unescaped(F.regexp_extract(t, r"<ForeName>([^<]*)", 1))
    authors = F.transform(F.filter(people, lambda t: last(t) != ""), lambda t: F.trim(F.concat(fore(t), F.lit(" "), last(t))))
    return counted.where("pmid is not null").select("pmid", "title", abstract.alias("abstract"), "year", "journal", authors.alias("authors"))


def unescaped(x: Column) -> Column:
    """Text of the five entities that XML defines."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        x = F.replace(x, F.lit(f"&{name};"), F.lit(char))
    return x


def escaped(x: Column) -> Column:
    for name, char in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"')):
        x = F.replace(x, F.lit(char), F.lit(f"&{name};"))
    return x


_INFONS = "struct<type: string, identifier: string, normalized_id: string>"
_DOC = f"struct<id: string, pmid: string, passages: array<struct<annotations: array<struct<infons: {_INFONS}, text: string>>>>>"


def bioc_annotations(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("Gene", "Disease", "Chemical")) -> DataFrame:
    """pmid, entity_id, entity_text, entity_type of BioC JSON, one response a file: wrapped documents,
    a list of them, or a single one. A list of identifiers gives its first."""
    whole = spark.read.text(path, wholetext=True).select("value")
    listed = F.when(F.col("value").rlike(r"^\s*\["), F.from_json("value", f"array<{_DOC}>"))
    wrapped = F.from_json("value", f"struct<PubTator3: array<{_DOC}>>")["PubTator3"]
    single = F.array(F.from_json("value", _DOC))
    docs = whole.select(F.explode(F.coalesce(listed, F.when(F.size(wrapped) > 0, wrapped), single)).alias("d"))
    notes = docs.select(F.coalesce(F.nullif("d.id", F.lit("")), "d.pmid", F.lit("")).alias("pmid"), F.explode("d.passages").alias("p")).select("pmid", F.explode("p.annotations").alias("a"))
    # an identifier that is a list arrives as its JSON text
    plain = lambda c: F.when(c.startswith("["), F.coalesce(F.get(F.from_json(c, "array<string>"), 0), F.lit(""))).otherwise(c)
    found = F.coalesce(F.nullif(F.col("a.infons.identifier"), F.lit("")), "a.infons.normalized_id", F.lit(""))
    return notes.select("pmid", plain(found).alias("entity_id"), F.col("a.text").alias("entity_text"), F.col("a.infons.type").alias("entity_type")).where(F.col("entity_type").isin(*kinds) & (F.col("entity_text") != ""))


RELATIONS = f"source string, target string, relation_type string, ml_score double, evidence array<{EVIDENCE}>"
ENTITIES = "id string, type string, name string"


def write_graph(entities: DataFrame, relations: DataFrame, path: str, kind: str = "parquet") -> None:
    """A graph as two tables below ``path``: parquet or json, or as one GraphML file a graph."""
    if kind == "graphml":
        data = lambda k, c: F.concat(F.lit(f'<data key="{k}">'), escaped(F.coalesce(c.cast("string"), F.lit(""))), F.lit("</data>"))
        nodes = entities.select(F.concat(F.lit('<node id="'), escaped(F.col("id")), F.lit('">'), data("type", F.col("type")), data("name", F.col("name")), F.lit("</node>")).alias("value"), F.lit(1).alias("o"))
        edges = relations.select(F.concat(F.lit('<edge source="'), escaped(F.col("source")), F.lit('" target="'), escaped(F.col("target")), F.lit('">'), data("relation_type", F.col("relation_type")), data("ml_score", F.col("ml_score")), data("evidence", F.to_json("evidence")), F.lit("</edge>")).alias("value"), F.lit(2).alias("o"))
        spark = entities.sparkSession
        keys = "".join(f'<key id="{k}" for="{f}" attr.name="{k}" attr.type="{t}"/>' for k, f, t in (("type", "node", "string"), ("name", "node", "string"), ("relation_type", "edge", "string"), ("ml_score", "edge", "double"), ("evidence", "edge", "string")))
        ends = spark.createDataFrame([(f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">', 0), ("</graph></graphml>", 3)], "value string, o int")
        # one file has one writer
        ends.union(nodes).union(edges).repartition(1).sortWithinPartitions("o").select("value").write.text(path)
    else:
        entities.write.format(kind).save(f"{path}/entities")
        relations.write.format(kind).save(f"{path}/relations")


def read_graph(spark: SparkSession, path: str, kind: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """Entities and relations that ``write_graph`` has written. Scores that aren't numbers are null."""
    if kind != "graphml":
        return tuple(spark.read.format(kind).schema(s).load(f"{path}/{t}") for t, s in (("entities", ENTITIES), ("relations", RELATIONS)))
    lines = spark.read.text(path)
    attribute = lambda a: unescaped(F.regexp_extract("value", rf' {a}="([^"]*)"', 1))
    data = lambda k: unescaped(F.regexp_extract("value", rf'<data key="{k}">([^<]*)</data>', 1))
    entities = lines.where("value like '<node %'").select(attribute("id").alias("id"), data("type").alias("type"), data("name").alias("name"))
    relations = lines.where("value like '<edge %'").select(attribute("source").alias("source"), attribute("target").alias("target"), data("relation_type").alias("relation_type"), data("ml_score").try_cast("double").alias("ml_score"), F.from_json(data("evidence"), f"array<{EVIDENCE}>").alias("evidence"))
    return entities, relations.select(*KEY, "ml_score", "evidence")
