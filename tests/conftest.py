import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parents[1]), os.environ.get("PYTHONPATH", "")])

SF = "/root/testdata/sf0.001"


# A few rows a table: compiling code for each plan would take most of the time. The queries of test_entry.py are run compiled by whoever calls them.
@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[8]").config(map={"spark.sql.shuffle.partitions": "2", "spark.default.parallelism": "2", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))}).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
