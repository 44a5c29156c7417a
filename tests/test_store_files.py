"""A stored corpus has a file a folder for each batch, however many tasks the batch had."""

import glob

from feedloom.sources import corpus


def test_one_file_a_folder(spark, tmp_path):
    path = str(tmp_path / "corpus")
    rows = spark.range(2000).selectExpr("concat('c', id % 2) AS channel", "id AS message_id", "id AS at")
    for n, part in enumerate((rows.filter("id < 1500"), rows, rows), 1):
        corpus.store_first_write(part.repartition(8), path, ["channel", "message_id"], ["at"], span=500)
        files, folders = glob.glob(f"{path}/*/*/*.parquet"), glob.glob(f"{path}/*/*/")
        assert len(folders) == (6, 8, 8)[n - 1] and len(files) == (6, 8, 8)[n - 1]
    assert spark.read.parquet(path).select("channel", "message_id").distinct().count() == spark.read.parquet(path).count() == 2000
