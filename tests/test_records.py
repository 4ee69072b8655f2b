"""CSV records over lines and splits against Python's reader."""

import csv
import io
import random

from storylake.sources import settings


def test_records_in_small_splits(spark, tmp_path):
    rnd = random.Random(4)
    cell = lambda: "".join(rnd.choices(['"', ",", "\n", "a", "é", " ", "\x01", "b\x01b"], k=rnd.randint(0, 12)))
    rows = [r for r in ([cell() for _ in range(rnd.randint(1, 4))] for _ in range(400)) if r != [""]] + [["x" * 900 + "\n" * 700 + '"'], ["end", ""]]
    text = io.StringIO()
    csv.writer(text, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows(rows[:200])
    csv.writer(text, lineterminator="\r\n").writerows(rows[200:])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(text.getvalue(), newline="")
    (tmp_path / "in" / "b.csv").write_text('1,"2\n"\n\n3', newline="")
    for size in ("300b", "64k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            found = settings.read_records(spark, str(tmp_path / "in")).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        of = lambda name: [r.cells for r in sorted(found, key=lambda r: (r.block, r.at)) if r.file.endswith(name)]
        assert of("b.csv") == [["1", "2\n"], [""], ["3"]]
        assert of("a.csv") == rows
        assert (len({r.block for r in found}) > 10) == (size == "300b")


def test_written_records(spark, tmp_path):
    rows = [(["a", None, 'q"'],), ([],), (["\n,"],)]
    settings.write_records(spark.createDataFrame(rows, "c array<string>").coalesce(1), str(tmp_path / "out"), settings.F.col("c"))
    assert sorted(r.cells for r in settings.read_records(spark, str(tmp_path / "out")).collect()) == [[""], ["\n,"], ["a", "", 'q"']]
