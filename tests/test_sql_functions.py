import math

import pytest

from kgloom.functions import sql


def test_functions_in_sql(spark):
    sql.register(spark)
    spark.createDataFrame([(1, '<http://a> <http://p> "x"@en, <http://b> .'), (2, None)], "id int, doc string").createOrReplaceTempView("docs")
    got = spark.sql("SELECT d.id, t.o, t.is_lit, t.o_lang FROM docs d, LATERAL parse_turtle(d.doc, 'm') t").collect()
    assert sorted((r.id, r.o, r.is_lit, r.o_lang) for r in got) == [(1, "http://b", False, None), (1, "x", True, "en")]
    xml = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:x="http://x/"><x:C rdf:about="http://a"/></rdf:RDF>'
    assert spark.sql(f"SELECT o FROM parse_rdfxml('{xml}', '')").first().o == "http://x/C"
    want = math.lgamma(101) - math.lgamma(100) - math.lgamma(1) + math.lgamma(103) + math.lgamma(3) - math.lgamma(106)
    assert spark.sql("SELECT log_betabin(3, 5, 100, 1) AS x").first().x == pytest.approx(want)
    said = spark.sql("SELECT is_number(v) AS x FROM VALUES ('1e3'), (' .5 '), ('x'), (NULL), ('1.0f') t(v)").collect()
    assert [r.x for r in said] == [True, True, False, False, False]
