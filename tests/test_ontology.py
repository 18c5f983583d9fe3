"""Ontology files: round trips and what goes to quarantine."""

import pytest
from conftest import rows

from docgrid.sources import ontology

GRAPH = "subject string, predicate string, object string, annotation string"
EDGES = [("PA0 <&> é", "hasSignal", "USART1", "AF7"), ("PA0 <&> é", "hasSignal", "USART1", "AF8"), ("PA0 <&> é", "hasSignal", "TIM 2#x", None), ("pin+1", "hasName", "one", None), ("pin+2", "hasName", "two", 'a "note"\nof two lines')]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([*EDGES, EDGES[0], (None, "hasName", "x", None), ("x", "hasName", None, None)], GRAPH)
    ontology.save(df, f"{tmp_path}/a")
    graph, quarantine = ontology.load(spark, f"{tmp_path}/a")
    assert rows(graph) == sorted([(*e, e[1] == "hasName") for e in EDGES], key=repr) and quarantine.count() == 0
    ontology.save(df.limit(0), f"{tmp_path}/none")
    assert ontology.load(spark, f"{tmp_path}/none")[0].count() == 0
    with pytest.raises(ValueError, match="not an element's name: has name"):
        ontology.save(spark.createDataFrame([("a", "has name", "b", None)], GRAPH), f"{tmp_path}/b")


def test_malformed_files(spark, tmp_path):
    b = ontology.BASE
    ontology.save(spark.createDataFrame(EDGES, GRAPH), f"{tmp_path}/a")
    (tmp_path / "a" / "more.xml").write_text(f"""<rdf:RDF>
<rdf:Description rdf:about="{b}pin%2B1"><g:hasName rdf:resource="{b}uno"/></rdf:Description>
<rdf:Description rdf:about="{b}q"><g:hasSignal rdf:resource="{b}S1"/><g:hasSignal rdf:resource="{b}S2"/></rdf:Description>
<rdf:Description rdf:about="{b}q"><g:hasSignal rdf:resource="http://elsewhere/S3"/></rdf:Description>
<rdf:Description rdf:about="elsewhere"><g:hasSignal rdf:resource="{b}S3"/></rdf:Description>
<owl:Axiom rdf:nodeID="x1"><owl:annotatedSource rdf:resource="{b}q"/><owl:annotatedTarget rdf:resource="{b}S1"/><rdfs:comment>no property</rdfs:comment></owl:Axiom>
<owl:Axiom rdf:nodeID="x2"><owl:annotatedSource rdf:resource="{b}q"/><owl:annotatedProperty rdf:resource="{b}hasSignal"/><owl:annotatedTarget rdf:resource="{b}S9"/><rdfs:comment>no edge</rdfs:comment></owl:Axiom>
<owl:Axiom rdf:nodeID="x3"><owl:annotatedSource rdf:resource="{b}q"/><owl:annotatedProperty rdf:resource="{b}hasSignal"/><owl:annotatedTarget rdf:resource="{b}S1"/><rdfs:comment>fine</rdfs:comment></owl:Axiom>
</rdf:RDF>""")
    graph, quarantine = ontology.load(spark, f"{tmp_path}/a")
    added = [("q", "hasSignal", "S1", "fine", False), ("q", "hasSignal", "S2", None, False)]
    assert rows(graph) == sorted([*[(*e, e[1] == "hasName") for e in EDGES], *added], key=repr)
    assert sorted(r.reason for r in quarantine.collect()) == ["axiom without its edge", "broken axiom", "broken description", "object outside the base", "second object of a single predicate"]
