import pytest
from emberline.functions import text as t
from emberline.plans import catalog
from pyspark.sql import functions as F

from tests.helpers import assert_same


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, name):
    assert_same(spark, catalog.queries()[name], catalog.oracle_sql()[name])


def test_text(spark):
    body = "Hi\n> old\n> older\n\n\n\nend\n-----Original Message-----\nFrom: x"
    row = spark.createDataFrame([(body, "  Re: Fwd:  A  b ")], "b string, s string").select(t.strip_quotes(F.col("b")), t.normalize_subject(F.col("s"))).first()
    assert tuple(row) == ("Hi\n\nend", "a b")
