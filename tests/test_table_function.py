import pytest

from quarrygraph.functions import tables
from quarrygraph.sources import extract
from tests.test_operators import CLAIM, POLICY

ENTITY_SQL = "select {id} as source, record_id as doc_id, label, id, entity_props(texts, numbers) as props, entity_nums(numbers) as nums from printed_entities(table({{rows}}), source => '{id}', position => 'at', line => 'printed', hint => 'file')"


def rows_of(df):
    return sorted((r.source, r.doc_id or "", r.label, r.id, sorted(r.props.items()), sorted(r.nums.items())) for r in df.collect())


def test_equals_the_dataframe_form(spark):
    docs = [
        (1, POLICY, "a.pdf"), (2, CLAIM, "b.pdf"), (3, "Policy Endorsement\nPolicy POL-001\nType RIDER\nPremium Adjustment -$1,005", "END-0042.pdf"), (4, "nothing", "x"), (5, None, None), (6, "", "y"),
        (7, "\n\n  Claim Report  \nClaim ID CLM-1\nClaim ID CLM-2\nCause Rain\nCause Hail\nfirst\nSeverity\nEND-1 E-7 RIDER 2020-01-02 $9\nFraud Flag\nsecond", None),
        (8, "Commercial Insurance Policy\nTerm soon\nAnnual Premium high\nPolicyholder ID\nCOV-9 AUTO-A AUTO $, $7 ;; ", "POL-77.pdf"), (9, "Claim Report\nAmount 5\nFlag ID F-1", None),
    ]
    table = spark.createDataFrame(docs, "n int, body string, file string")
    cut = table.selectExpr("n", "file", "posexplode(split(body, '\\n')) as (at, printed)", "'clash' as label").repartition(3, "at")
    tables.register(spark)
    got = rows_of(spark.sql(ENTITY_SQL.format(id="n"), rows=cut))
    want = rows_of(extract.entities(table, "n", "body", "file"))
    assert got == want and len(got) >= 11
    assert rows_of(spark.sql(ENTITY_SQL.format(id="n"), rows=cut.limit(0))) == []


def test_result_follows_the_table(spark):
    tables.register(spark)
    lines = spark.createDataFrame([("a", 1.5, "Claim Report"), ("a", 2.5, "Claim ID CLM-1"), (None, 1.0, "Claim Report"), (None, 2.0, "Claim ID CLM-2"), ("b", 1.0, None)], "`my doc` string, pos double, line string")
    got = spark.sql("select * from printed_entities(table({rows}), source => 'My Doc')", rows=lines)
    assert got.dtypes[0] == ("my doc", "string") and [(r["my doc"], r.id) for r in got.collect()] == [("a", "CLM-1")]
    with pytest.raises(Exception, match="columns page"):
        spark.sql("select * from printed_entities(table({rows}), source => 'page')", rows=lines)
    with pytest.raises(Exception, match="not a column of text"):
        spark.sql("select * from printed_entities(table({rows}), source => 'my doc', line => 'pos')", rows=lines)


def test_runs_of_lines_in_a_row(spark):
    tables.register(spark)
    docs = [(1, POLICY, "a.pdf"), (2, CLAIM, "b.pdf"), (3, "Claim Report\n\n", "CLM-0042.pdf"), (4, None, None)]
    table = spark.createDataFrame(docs, "n int, body string, file string")
    cut = table.selectExpr("n", "file", "split(body, '\\n') as lines").selectExpr("n", "file", "explode(array((0, slice(lines, 1, 4)), (1, slice(lines, 5, 999)))) as part")
    cut = cut.selectExpr("n", "file", "part.col1 as at", "part.col2 as printed").repartition(3, "at")
    got = rows_of(spark.sql(ENTITY_SQL.format(id="n"), rows=cut))
    assert got == rows_of(extract.entities(table, "n", "body", "file")) and len(got) >= 4
