"""Text files read again by the folder."""

from pyspark.sql import functions as F

from veilspark.sources import text_files


def test_files_come_back_by_the_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_files, "READ_FILES", 7)
    df = spark.range(50).select(F.concat("id", F.lit(".txt")).alias("name"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("tür\r\n"), "id")).alias("text")).repartition(3)
    text_files.write_text_files(df, str(tmp_path / "out"))
    got = text_files.read_text_files(spark, str(tmp_path / "out"))
    assert got.rdd.getNumPartitions() == 3  # not one a few files
    assert {r.name: r.text for r in got.collect()} == {f"{k}.txt": f"tür\r\n{k}" if k % 5 else "" for k in range(50)}
    text_files.write_text_files(df.limit(0), str(tmp_path / "none"))
    assert text_files.read_text_files(spark, f"file://{tmp_path}/none").count() == 0
