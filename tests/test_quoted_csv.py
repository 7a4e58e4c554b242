import csv
import io
import random

import pytest

from shelfrate.sources.feed_csv import list_csv_files, read_feed
from shelfrate.sources.quoted_csv import read_quoted_feed, read_records

COLUMNS = ("sku", "name", "category")


def quoted_file(path, n, seed, line_end="\n", header=COLUMNS):
    rng = random.Random(seed)
    pieces = ['a', ' ', ',', '"', '""', '\n', '\n\n', 'ü', 'word', "'"]
    out = io.StringIO()
    w = csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator=line_end)
    w.writerow(header)
    rows = [[f"s{i}"] + ["x" + "".join(rng.choices(pieces, k=rng.randrange(12))) + "y" for _ in header[1:]] for i in range(n)]
    w.writerows(rows)
    path.write_bytes(out.getvalue().encode())
    return rows


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def got_rows(df, columns=COLUMNS):
    return [[r[c] for c in columns] for r in sorted(df.collect(), key=lambda r: r.row_index)]


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_quoted_file_in_many_splits_equals_the_rows_written(spark, tmp_path, small_splits, line_end):
    want = quoted_file(tmp_path / "a.csv", 800, 5, line_end)
    files = list_csv_files(spark, [str(tmp_path)])
    assert spark.read.text(files).rdd.getNumPartitions() > 8
    feed = read_quoted_feed(spark, files, COLUMNS)
    assert got_rows(feed) == want
    assert [r.row_index for r in feed.orderBy("row_index").collect()] == list(range(800))


def test_equals_the_multi_line_reader_over_files_with_other_headers(spark, tmp_path, small_splits):
    quoted_file(tmp_path / "a.csv", 150, 1)
    quoted_file(tmp_path / "b.csv", 90, 2, header=("category", "sku", "name"))
    quoted_file(tmp_path / "c.csv", 40, 3, header=("sku", "name"))
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "e.csv").write_text('﻿"sku",name,category\n\n p1 , "two\n\nlines" ,\n\np2,short\np3,,"c"')
    files = list_csv_files(spark, [str(tmp_path)])
    got = read_quoted_feed(spark, files, COLUMNS)
    want = read_feed(spark, [str(tmp_path)], columns=COLUMNS)
    key = lambda r: (r.source_file, r.row_index)
    fields = [*COLUMNS, "source_file", "row_index"]
    assert ([tuple(r[f] for f in fields) for r in sorted(got.collect(), key=key)]
            == [tuple(r[f] for f in fields) for r in sorted(want.collect(), key=key)])
    bad = {(r.source_file.rsplit("/", 1)[1], r.row_index) for r in got.where("_corrupt_record IS NOT NULL").collect()}
    assert bad == {("e.csv", 1)}


def test_a_record_over_several_splits_and_files_without_records(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('sku,name\n1,"' + "line\n" * 4000 + '"\n2,b\n')
    (tmp_path / "b.csv").write_text("\n\n")
    got = read_records(spark, list_csv_files(spark, [str(tmp_path)])).orderBy("record").collect()
    assert [(r.record, len(r.text)) for r in got] == [(0, 8), (1, 2 + 1 + 20000 + 1), (2, 3)]
    assert read_quoted_feed(spark, [str(tmp_path / "b.csv")], COLUMNS).collect() == []
