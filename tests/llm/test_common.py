import re
from pathlib import Path

import pyarrow as pa

from tidewater.llm import common, registry

ROOT = Path(__file__).resolve().parents[2]


def test_nothing_outside_imports_the_operators():
    for file in (ROOT / "tidewater").rglob("*.py"):
        if "llm" not in file.parts:
            assert not re.search(r"tidewater\.llm|from \.*llm", file.read_text()), file


def test_operators_are_registered():
    numbers = [int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES]
    assert list(dict.fromkeys(numbers)) == list(range(1, 14))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_written_tables_lie_in_the_shared_folder_and_can_be_deleted(spark):
    path = common.shared_dir(spark)
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
    df = common.written(spark.range(10), path)
    assert df.count() == 10 and path.removeprefix("file://") in df.inputFiles()[0].removeprefix("file:").replace("///", "/")
    common.delete(spark, path)
    assert not Path(path.removeprefix("file://")).exists()


def test_batches_are_small_and_empty_ones_are_skipped(spark):
    def make():
        def fn(batch: pa.RecordBatch) -> dict:
            return {"n": [batch.num_rows]}

        return fn

    sizes = [r["n"] for r in common.arrow_map(spark.range(0, 3500, 1, 1), make, "n long").collect()]
    assert sum(sizes) == 3500 and max(sizes) <= common.BATCH_ROWS
    assert common.arrow_map(spark.range(0), make, "n long").count() == 0


def test_settings_hold_whatever_was_called_before(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    spark.conf.unset("parquet.block.size")
    common.small_batches(spark.range(1))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "100"
    for key, most in common.SETTINGS.items():
        assert 0 < int(spark.conf.get(key)) <= most
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(common.BATCH_ROWS))


def test_a_cluster_needs_a_shared_folder():
    assert common.ONE_PROCESS.match("local[8]") and common.ONE_PROCESS.match("local")
    assert not any(common.ONE_PROCESS.match(x) for x in ("local-cluster[3,2,1024]", "yarn", "spark://h:7077"))
