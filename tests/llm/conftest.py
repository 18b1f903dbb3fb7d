import pytest
from samples import DDL, edge_rows


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), DDL)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="session")
def docs(spark, data):
    from quern.session import table

    return table(spark, data, "documents")
