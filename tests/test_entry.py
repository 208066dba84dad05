import __spark_entry__ as E


def test_names_agree():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q) and len(q) > 80
    assert {"p1_found", "p3_found", "p4_found"} <= set(q)


def test_flagship(spark, data):
    assert E.entry(spark).count() > 0
