"""Stored extractions are parsed once, however many of their fields are read."""

from ledgerloom.operators import assembly


def test_a_text_is_parsed_once(spark):
    df = spark.createDataFrame([('{"document_id": 1, "proposal": {"amount": "2.50", "tax_rate": ""}, "line_items": [{"total": "3"}]}',), ("{",), (None,)], "j string")
    out = df.select("j", assembly.decoded(df.j).alias("d"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    one, *none = [r.d for r in out.collect()]
    assert (str(one.proposal.amount), one.proposal.tax_rate, str(one.line_items[0].total), one.confidence) == ("2.50", None, "3.0000", None)
    assert none == [None, None]
