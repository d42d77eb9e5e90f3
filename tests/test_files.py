"""Header reads of season files: bounded by the number of files, quoted names."""

from touchline.sources import files as FS


def _bytes_read(spark) -> int:
    return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())


def _files(folder, rows):
    for season, head in ((1, 'a,"b, with comma",c'), (2, "a,c")):
        d = folder / f"__season={season}"
        d.mkdir(parents=True)
        with open(d / "part.csv", "w") as f:
            f.write(head + "\n")
            f.writelines(f"{i},{i * 7919 % 1000003},{i}\n" for i in range(rows))
    return str(folder)


def test_header_reads_do_not_grow_with_the_files(spark, tmp_path):
    short, long = _files(tmp_path / "short", 10), _files(tmp_path / "long", 2_000_000)
    used = []
    for root in (short, long):
        before = _bytes_read(spark)
        got = {(r["season"], tuple(r["columns"])) for r in FS.file_headers(spark, root).collect()}
        used.append(_bytes_read(spark) - before)
        assert got == {(1, ("a", "b, with comma", "c")), (2, ("a", "c"))}
    assert used[1] < 8_000_000, used  # two files of 35 MB and more


def test_quoted_names_and_missing_columns(spark, tmp_path):
    out = FS.scan_season_files(spark, _files(tmp_path / "x", 5), {"a": "INT"})
    assert set(out.columns) == {"a", "b, with comma", "c", "source_file"}
    assert out.count() == 10 and out.where("`b, with comma` IS NULL").count() == 5
    audit = {r["column_name"]: r["n_files"] for r in FS.schema_audit(FS.file_headers(spark, str(tmp_path / "x"))).collect()}
    assert audit == {"a": 2, "b, with comma": 1, "c": 2}


def test_a_header_read_takes_the_file_in_one_partition(spark, tmp_path):
    root = _files(tmp_path / "long", 1_500_000)
    plans = []
    read = type(spark.read).text

    def counted(reader, path, *args, **kwargs):
        out = read(reader, path, *args, **kwargs)
        if path.endswith(".csv"):
            plans.append(out.rdd.getNumPartitions())
        return out

    type(spark.read).text = counted
    try:
        assert FS.file_headers(spark, root).count() == 2
    finally:
        type(spark.read).text = read
    assert plans == [1, 1]  # a part of a file has no header of its own
