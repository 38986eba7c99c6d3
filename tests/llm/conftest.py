import pytest


@pytest.fixture
def rows(spark):
    """Builds a table from rows and a DDL schema; collects results as dictionaries."""
    class Rows:
        def frame(self, data, ddl):
            return spark.createDataFrame(data, ddl)

        def dicts(self, df, *order):
            return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]
    return Rows()
