"""What is committed is read, and nothing else."""

from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from plumbline.sources.ledger import Ledger
from plumbline.sources.store import shared_folder
from tests.conftest import rows

SCHEMA = StructType([StructField("n", LongType()), StructField("part", IntegerType())])


def test_commits(spark):
    ledger = Ledger(spark, shared_folder(spark, "ledger"))

    def written(*numbers, by=None):
        return ledger.write("t", spark.createDataFrame([(n, n % 2) for n in numbers], SCHEMA), by)

    def read(before=None):
        return [n for n, _ in rows(ledger.read("t", SCHEMA, before))]

    assert read() == [] and ledger.committed() == []
    written(9)  # never committed
    ledger.commit("001", {"t": [written(1, 2)]})
    ledger.commit("003", {"t": [written(5)], "other": []})
    ledger.commit("002", {"t": [written(3), written(4)]})
    assert read() == [1, 2, 3, 4, 5] and read("003") == [1, 2, 3, 4] and read("001") == []
    ledger.commit("002", {"t": [written(7, 8)]})  # done again
    assert read() == [1, 2, 5, 7, 8]
    ledger.commit("003", {"t": [written(1, 2, 5, 7, 8)]}, upto=True)
    ledger.commit("004", {"t": [written(6)]})
    assert read() == [1, 2, 5, 6, 7, 8] and [e["key"] for e in ledger.committed()] == ["003", "004"]
    assert read("003") == [1, 2, 7, 8] and ledger.folders("other") == []


def test_partitioned_folders(spark):
    ledger = Ledger(spark, shared_folder(spark, "ledger"))
    made = spark.createDataFrame([(n, n % 2) for n in range(4)], SCHEMA)
    ledger.commit("a", {"t": [ledger.write("t", made, "part"), ledger.write("t", made.limit(0), "part")]})
    assert rows(ledger.read("t", SCHEMA)) == [(0, 0), (1, 1), (2, 0), (3, 1)]
    assert rows(ledger.read("t", SCHEMA).where("part = 1"), "n") == [(1,), (3,)]
