"""Files under given names: what is published, what a failure leaves, what an update deletes."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from storylake.sources import named


def listed(folder):
    return {str(p.relative_to(folder)): p.read_text() for p in Path(folder).rglob("*") if p.is_file()}


def test_append_overwrite_and_delete(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.json", "{}"), ("b/é.json", '{"k": "ü"}')], "name string, content string").repartition(2)
    named.write_named(rows, str(tmp_path / "lib"))
    assert listed(tmp_path / "lib") == {"a/x.json": "{}", "b/é.json": '{"k": "ü"}'}
    named.write_named(spark.createDataFrame([("a/x.json", None), ("a/y.json", "[]"), ("no", None)], "name string, content string"), f"file:{tmp_path}/lib")
    assert set(listed(tmp_path / "lib")) == {"a/y.json", "b/é.json"}
    named.write_named(rows.where("name like 'a%'"), str(tmp_path / "lib"), "overwrite")
    assert set(listed(tmp_path / "lib")) == {"a/x.json"}
    named.write_named(rows.where("false"), str(tmp_path / "lib"))
    assert set(listed(tmp_path / "lib")) == {"a/x.json"}


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    (tmp_path / "lib").mkdir()
    fails = F.when(F.col("id") == 199, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string"))
    rows = spark.range(0, 200, 1, 4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), fails.alias("content"))
    with pytest.raises(Exception, match="no"):
        named.write_named(rows, str(tmp_path / "lib"))
    # An attempt that runs on while the job ends may write into the staging folder, which no reader takes up.
    assert all(name.startswith("_staged-") for name in listed(tmp_path / "lib"))
    assert named.read_named(spark, str(tmp_path / "lib")).count() == 0


def test_a_name_given_twice_leaves_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("same", "1"), ("same", "2"), ("other", "3")], "name string, content string").repartition(3)
    with pytest.raises(Exception, match="named"):
        named.write_named(rows, str(tmp_path / "lib"))
    assert all(name.startswith("_staged-") for name in listed(tmp_path / "lib"))


def test_names_stay_below_the_path(spark, tmp_path):
    with pytest.raises(Exception, match="not a name"):
        named.write_named(spark.createDataFrame([("../x", json.dumps(1))], "name string, content string"), str(tmp_path / "lib"))


def sent_to_driver(spark, work):
    """Bytes of the results of all tasks that ``work`` runs."""
    context = spark.sparkContext
    stages = lambda: context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    of = lambda: {(s.stageId(), s.attemptId()): s.resultSize() for s in (found.apply(i) for found in [stages()] for i in range(found.size()))}
    before = of()
    work()
    context._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(size for at, size in of().items() if at not in before)


def test_names_do_not_pass_through_the_driver(spark, tmp_path):
    rows = lambda n: spark.range(0, n, 1, 4).select(F.format_string("folder/a-rather-long-name-of-a-file-%09d", "id").alias("name"), F.lit("x").alias("content"))
    few, many = (sent_to_driver(spark, lambda n=n: named.write_named(rows(n), str(tmp_path / str(n)))) for n in (100, 2_100))
    assert len(listed(tmp_path / "2100")) == 2_100
    assert many - few < 2_000 * 20
