import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def texts(spark):
    def make(*values, **more):
        df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(values)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        return df.withColumns({k: F.lit(v) for k, v in more.items()})

    return make


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
