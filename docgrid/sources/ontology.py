"""Ontology files: graphs as RDF/XML, written and read by row tags, so that files of any size are taken in parts.

Every edge is an rdf:Description of its own with one property element, so a subject may have any number of edges. An
annotated edge has an owl:Axiom that names its source, property and target, and whose id comes from these and the
annotation: the same annotation is the same axiom in every file. Properties are declared as owl:ObjectProperty; those that
have at most one object for each subject as owl:FunctionalProperty, too.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = "http://data.example.org/graph#"
ROOT = f'rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:g="{BASE}"'
#: Predicates become element names, and columns while a file is written or read.
PREDICATES = 1000
RESOURCE = "struct<`_rdf:resource`:string>"
AXIOM = f"`_rdf:nodeID` string, `owl:annotatedSource` {RESOURCE}, `owl:annotatedProperty` {RESOURCE}, `owl:annotatedTarget` {RESOURCE}, `rdfs:comment` string"


def iri(name: Column) -> Column:
    return F.concat(F.lit(BASE), F.url_encode(name))


def name_of(resource: Column) -> Column:
    """The name in an IRI of this base; null for any other."""
    return F.when(resource.startswith(BASE), F.try_url_decode(F.substring(resource, F.lit(len(BASE) + 1), F.length(resource))))


def _resource(at: Column) -> Column:
    return F.struct(at.alias("_rdf:resource"))


def _write(df: DataFrame, tag: str, path: str) -> None:
    df.write.format("xml").option("rootTag", ROOT).option("rowTag", tag).option("declaration", "").option("validateName", "false").mode("append").save(path)


def save(graph: DataFrame, path: str) -> None:
    """graph: (subject, predicate, object, annotation), a row an annotation, null for none. Edges with a null are left out.

    Predicates must be names that XML allows for elements, PREDICATES of them at most; others raise ValueError.
    """
    graph = graph.where("subject is not null and predicate is not null and object is not null")
    edges = graph.select("subject", "predicate", "object").distinct()
    many = edges.groupBy("predicate", "subject").count().groupBy("predicate").agg((F.max("count") == 1).alias("single"))
    found = many.orderBy("predicate").limit(PREDICATES + 1).collect()
    wrong = [r.predicate for r in found if not re.fullmatch(r"[A-Za-z_][\w.\-]*", r.predicate)]
    if wrong or len(found) > PREDICATES:
        raise ValueError(f"not an element's name: {wrong[0]}" if wrong else f"more than {PREDICATES} predicates")
    declared = lambda rows: graph.sparkSession.createDataFrame([(BASE + p,) for p in rows], "`_rdf:about` string").coalesce(1)
    _write(declared([r.predicate for r in found]), "owl:ObjectProperty", path)
    _write(declared([r.predicate for r in found if r.single]), "owl:FunctionalProperty", path)
    elements = [F.when(F.col("predicate") == r.predicate, _resource(iri(F.col("object")))).alias(f"g:{r.predicate}") for r in found]
    if elements:
        _write(edges.select(iri(F.col("subject")).alias("_rdf:about"), *elements), "rdf:Description", path)
    noted = graph.where("annotation is not null").distinct()
    key = F.concat(F.lit("a"), F.md5(F.to_json(F.struct("subject", "predicate", "object", "annotation"))))
    ends = {"owl:annotatedSource": "subject", "owl:annotatedProperty": "predicate", "owl:annotatedTarget": "object"}
    _write(noted.select(key.alias("_rdf:nodeID"), *[_resource(iri(F.col(c))).alias(n) for n, c in ends.items()], F.col("annotation").alias("rdfs:comment")), "owl:Axiom", path)


def _read(spark: SparkSession, path: str, tag: str, schema: T.StructType | str) -> DataFrame:
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    kind = T.StructType([*kind.fields, T.StructField("_broken", T.StringType())])
    return spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("pathGlobFilter", "*.xml").schema(kind).load(path)


def _declared(spark: SparkSession, path: str, tag: str) -> list[str]:
    names = _read(spark, path, tag, "`_rdf:about` string").select(name_of(F.col("`_rdf:about`")).alias("p")).where("p is not null")
    return sorted(r.p for r in names.distinct().limit(PREDICATES + 1).collect())


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(graph, quarantine) of the files: graph as save() takes it, with `single`, whether its predicate has at most one
    object for each subject; quarantine (raw, reason) with what cannot be taken: broken elements, names outside the base,
    axioms that name no edge, and second objects of single predicates."""
    predicates, single = _declared(spark, path, "owl:ObjectProperty"), _declared(spark, path, "owl:FunctionalProperty")
    fields = ", ".join(f"`g:{p}` array<{RESOURCE}>" for p in predicates)
    told = _read(spark, path, "rdf:Description", f"`_rdf:about` string{', ' * bool(fields)}{fields}")
    each = F.array(*[F.struct(F.lit(p).alias("predicate"), F.col(f"`g:{p}`").alias("objects")) for p in predicates]) if predicates else F.array().cast(f"array<struct<predicate:string,objects:array<{RESOURCE}>>>")
    raw = F.to_json(F.struct("`_rdf:about`", *[f"`g:{p}`" for p in predicates]))
    rows = told.select("_broken", raw.alias("raw"), name_of(F.col("`_rdf:about`")).alias("subject"), F.filter(each, lambda e: F.size(e["objects"]) > 0).alias("each"))
    edges = rows.where("_broken is null and subject is not null").select("raw", "subject", F.explode("each").alias("e")).select("raw", "subject", "e.predicate", F.explode("e.objects").alias("o"))
    edges = edges.select("raw", "subject", "predicate", name_of(F.col("o")["_rdf:resource"]).alias("object"))
    sound = edges.where("object is not null").select("subject", "predicate", "object").distinct()
    # Of a single predicate the object that is least by name is kept.
    first = sound.where(F.col("predicate").isin(single)).groupBy("subject", "predicate").agg(F.min("object").alias("object"))
    taken = sound.where(~F.col("predicate").isin(single)).unionByName(first).withColumn("single", F.col("predicate").isin(single))
    axioms = _read(spark, path, "owl:Axiom", AXIOM)
    end = lambda n: name_of(F.col(f"`owl:annotated{n}`")["_rdf:resource"])
    noted = axioms.select("_broken", F.to_json(F.struct(*[c for c in axioms.columns if c != "_broken"])).alias("raw"), end("Source").alias("subject"), end("Property").alias("predicate"), end("Target").alias("object"), F.col("`rdfs:comment`").alias("annotation"))
    whole = F.col("_broken").isNull() & F.col("subject").isNotNull() & F.col("predicate").isNotNull() & F.col("object").isNotNull() & F.col("annotation").isNotNull()
    keys = ["subject", "predicate", "object"]
    graph = taken.join(noted.where(whole).select(*keys, "annotation").distinct(), keys, "left")
    bad = lambda df, reason: df.select(F.coalesce("_broken", "raw").alias("raw"), F.lit(reason).alias("reason"))
    none = F.lit(None).cast("string").alias("_broken")
    quarantine = (
        bad(rows.where("_broken is not null or subject is null"), "broken description")
        .union(bad(edges.where("object is null").select(none, "raw"), "object outside the base"))
        .union(bad(sound.join(taken, keys, "left_anti").select(none, F.to_json(F.struct(*keys)).alias("raw")), "second object of a single predicate"))
        .union(bad(noted.where(~whole), "broken axiom"))
        .union(bad(noted.where(whole).join(taken, keys, "left_anti").select(none, "raw"), "axiom without its edge"))
    )
    return graph.select("subject", "predicate", "object", "annotation", "single"), quarantine
