import pyarrow as pa

from lexloom.llm.common import BATCH_ROWS, written


def test_batches_are_short_while_a_table_is_written(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    sizes = lambda parts: (pa.RecordBatch.from_arrays([pa.array([p.num_rows], pa.int64())], ["n"]) for p in parts)
    made, _ = written(spark.range(0, 9_000, 1, 2).mapInArrow(sizes, "n long"), "sizes")
    rows = [r.n for r in made.collect()]
    assert sum(rows) == 9_000 and max(rows) == BATCH_ROWS and spark.conf.get(key) == before
