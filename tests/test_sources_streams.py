import os
from multiprocessing.pool import ThreadPool

import pytest
from pyspark.sql import functions as F

from tabspark import sources as s
from tabspark.functions import session
from tabspark.operators import columns, features, rows, splits
from tabspark.sources import versions
from tabspark.sources.tables import stack_tables
from tabspark.streaming import read_stream, run_available


def csv(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_na_texts_become_null_and_types_hold(spark, tmp_path):
    path = csv(tmp_path, "a.csv", "i,f,b,t,n,d\n1,NA,True,x,nan,1d\n,2.5,False,null,,2\n3,1e3,N/A,\"a, \"\"b\"\"\",NULL,3\n")
    df = s.load_table(spark, path)
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [
        ("i", "bigint"), ("f", "double"), ("b", "boolean"), ("t", "string"), ("n", "double"), ("d", "string"),
    ]
    assert [tuple(r) for r in df.collect()] == [
        (1, None, True, "x", None, "1d"), (None, 2.5, False, None, None, "2"), (3, 1000.0, None, 'a, "b"', None, "3"),
    ]


def test_given_schema_skips_inference(spark, tmp_path):
    path = csv(tmp_path, "a.csv", "zip,n\n00501,1\n10001,x\n")
    df = s.load_table(spark, path, schema="zip string, n int")
    assert [tuple(r) for r in df.collect()] == [("00501", 1), ("10001", None)]
    with pytest.raises(ValueError):
        s.load_table(spark, path, schema="absent int")


def test_load_errors(spark, tmp_path):
    for name in ("absent.csv", "absent.parquet"):
        with pytest.raises(FileNotFoundError):
            s.load_table(spark, str(tmp_path / name))
    with pytest.raises(ValueError):
        s.load_table(spark, csv(tmp_path, "empty.csv", ""))


def test_parquet_nan_becomes_null(spark, tmp_path):
    spark.createDataFrame([(float("nan"),), (1.0,)], "x double").write.parquet(f"{tmp_path}/p")
    assert s.load_table(spark, f"{tmp_path}/p").where("x is null").count() == 1


def test_concat_unites_columns_and_widens(spark, tmp_path):
    a = csv(tmp_path, "a.csv", "k,v\n1,2\n2,3\n")
    b = csv(tmp_path, "b.csv", "v,w\n2.5,x\n")
    df = s.concat_tables(spark, [a, b], source_column="src")
    assert df.columns == ["k", "v", "src", "w"] and df.schema["v"].dataType.simpleString() == "double"
    assert {r["source"]: r["row_count"] for r in s.rows_per_source(df, "src").collect()} == {a: 2, b: 1}
    text = stack_tables([spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([("z",)], "k string")])
    assert sorted(r["k"] for r in text.collect()) == ["1", "z"]
    with pytest.raises(ValueError):
        s.concat_tables(spark, [])


def test_save_writes_parts_and_refuses_to_overwrite(spark, tmp_path):
    df = spark.range(100).repartition(4).withColumn("t", F.lit('a "quoted", text'))
    s.save_table(df, f"{tmp_path}/out.csv")
    assert len([f for f in os.listdir(f"{tmp_path}/out.csv") if f.startswith("part-")]) == 4
    back = s.load_table(spark, f"{tmp_path}/out.csv")
    assert back.count() == 100 and back.first()["t"] == 'a "quoted", text'
    with pytest.raises(Exception, match="exist"):
        s.save_table(df, f"{tmp_path}/out.csv")


def test_validate_counts_corrupt_rows(spark, tmp_path):
    path = csv(tmp_path, "v.csv", "a,b\n1,2\n3\n4,5,6\n7,NA\n")
    r = s.validate_source(spark, path).first()
    # The row of one cell is filled up by the reader, so it is not corrupt; its absent cell is missing, as is NA.
    assert (r["status"], r["row_count"], r["corrupt_rows"], r["missing_cells"], r["column_count"], r["columns"]) == ("corrupt rows", 4, 1, 2, 2, "a,b")
    short = s.validate_source(spark, csv(tmp_path, "s.csv", "a;b\n1;2\n3\n"), sep=";").first()
    assert (short["status"], short["missing_cells"], short["columns"]) == ("valid", 1, "a,b")
    good = s.validate_source(spark, csv(tmp_path, "g.csv", "a,b\n1,2\n")).first()
    assert good["status"] == "valid" and good["missing_cells"] == 0
    for bad in ("", "x.txt"):
        with pytest.raises(ValueError):
            s.validate_source(spark, bad)


def test_fingerprint_ignores_order_and_sees_copies(spark):
    df = spark.range(50).withColumn("t", F.concat(F.lit("v"), F.col("id") % 7))
    print_of = lambda d: s.content_fingerprint(d).first()["fingerprint"]
    assert print_of(df) == print_of(df.repartition(6).orderBy(F.desc("id")))
    assert print_of(df) != print_of(df.unionByName(df))
    assert print_of(df) != print_of(df.withColumnRenamed("t", "u"))
    assert print_of(df) != print_of(df.withColumn("t", F.when(F.col("id") != 3, F.col("t"))))
    assert len(print_of(df.limit(0))) == 64


def test_versions_count_per_dataset(spark, tmp_path):
    path = f"{tmp_path}/registry"
    a, b = spark.range(3), spark.range(4)
    numbers = [s.register_version(d, n, path).first()["version_number"] for d, n in [(a, "x"), (b, "x"), (a, "x"), (a, "y")]]
    assert numbers == [1, 2, 1, 1] and s.read_registry(spark, path).count() == 3


def test_writers_at_once_get_numbers_of_their_own(spark, tmp_path):
    path = f"{tmp_path}/registry"
    tables = [spark.range(n) for n in (3, 4, 5, 3)]
    with ThreadPool(4) as pool:
        numbers = pool.map(lambda d: s.register_version(d, "x", path).first()["version_number"], tables)
    assert numbers[0] == numbers[3] and sorted(numbers[:3]) == [1, 2, 3]
    assert s.read_registry(spark, path).count() == 3


def test_a_number_is_taken_once(spark, tmp_path):
    assert versions._commit(spark, f"{tmp_path}/d", "1.json", "first") and not versions._commit(spark, f"{tmp_path}/d", "1.json", "second")
    assert [p.name for p in (tmp_path / "d").iterdir()] == ["1.json"] and (tmp_path / "d" / "1.json").read_text() == "first"


def test_shared_folder_comes_from_the_session(spark):
    assert session.shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    kept = session.written(spark.range(5))
    assert kept.count() == 5 and kept.inputFiles()[0].startswith(session.shared_dir(spark))


def test_cluster_without_shared_folder_is_refused():
    class Conf:
        def get(self, *_):
            return None

    class Empty:
        def isEmpty(self):
            return True

    class Fake:
        master = "spark://somewhere:7077"
        conf = Conf()
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Empty()})()})()

        def getConf(self):
            return Conf()

        @property
        def sparkContext(self):
            return self

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Fake())


def test_streams_give_the_rows_of_the_batch(spark, tmp_path):
    batch = spark.range(300).select(
        "id",
        F.when(F.col("id") % 5 != 0, (F.col("id") % 17).cast("double")).alias("x"),
        F.when(F.col("id") % 4 != 0, F.concat(F.lit("v"), F.col("id") % 3)).alias("s"),
        F.concat(F.lit("w"), F.col("id") % 40).alias("w"),
    )
    batch.repartition(5).write.parquet(f"{tmp_path}/in")
    fill = columns.fit_fill(batch, "id")
    filled = columns.apply_fill(batch, fill)
    encoding = features.fit_encoding(filled, "id")
    scaler = splits.fit_scaler(filled, ["x"])
    bins = features.fit_bins(filled, "x", 3)

    def chain(df):
        df = features.apply_encoding(columns.apply_fill(rows.filter_rows(df, "id", "gte", 7), fill), encoding)
        return features.apply_bins(features.create_polynomials(splits.apply_scaler(df, scaler), ["x"]), bins)

    stream = read_stream(spark, f"{tmp_path}/in", batch.schema, files_per_trigger=2)
    got = run_available(stream, chain, f"{tmp_path}/out")
    assert sorted(map(str, got.collect())) == sorted(map(str, chain(batch).collect()))


def test_csv_stream(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    (tmp_path / "in" / "a.csv").write_text("k,v\n1,NaN\n2,3.5\n")
    got = run_available(read_stream(spark, f"{tmp_path}/in", "k int, v double", "csv"))
    assert sorted(map(tuple, got.collect())) == [(1, None), (2, 3.5)]


def test_fingerprint_tells_null_positions_apart(spark):
    from tabspark.sources.versions import content_fingerprint

    prints = [
        content_fingerprint(spark.createDataFrame(rows, "a long, b long")).first()["fingerprint"]
        for rows in ([(1, None), (None, 2)], [(None, 1), (2, None)], [(None, 2), (1, None)])
    ]
    assert prints[0] != prints[1] and prints[0] == prints[2]


def test_line_breaks_quotes_and_blanks_survive_a_round_trip(spark, tmp_path):
    rows = [(1, "two\nlines"), (2, ' "a",\r\n b '), (3, None), (4, "back\\slash\\"), (5, "\n"), (6, '"'), (7, "x,\ry")]
    df = spark.createDataFrame(rows, "id long, t string").repartition(2)
    s.save_table(df, f"{tmp_path}/breaks.csv")
    back = s.load_table(spark, f"{tmp_path}/breaks.csv")
    assert back.dtypes == [("id", "bigint"), ("t", "string")]
    assert sorted(map(tuple, back.collect())) == rows


def test_rows_of_another_length(spark, tmp_path):
    short = csv(tmp_path, "short.csv", 'a,b,c\n1,2,3\n4\n5,"x,\ny"\n')
    assert [tuple(r) for r in s.load_table(spark, short).collect()] == [(1, "2", 3), (4, None, None), (5, "x,\ny", None)]
    long = csv(tmp_path, "long.csv", "a,b\n1,2\n3,4,EXTRA\n5,,,\n6,7\n")
    for schema in (None, "a int"):
        with pytest.raises(ValueError, match="2 rows of .* do not fit its 2 columns"):
            s.load_table(spark, long, schema=schema)
    never_closed = csv(tmp_path, "open.csv", 'a,b,c\n1,"2,3\n4,5,6\n')
    with pytest.raises(ValueError, match="do not fit"):
        s.load_table(spark, never_closed)


def test_split_reader_notices_line_breaks(spark, tmp_path):
    broken = csv(tmp_path, "broken.csv", 'a,b\n1,"two\nlines"\n')
    with pytest.raises(ValueError, match="2 lines of .* end inside a quote"):
        s.load_table(spark, broken, line_breaks=False)
    plain = csv(tmp_path, "plain.csv", 'a,b\n1,"x ""y"""\n')
    assert s.load_table(spark, plain, line_breaks=False).first()["b"] == 'x "y"'


def test_separator_and_encoding(spark, tmp_path):
    path = tmp_path / "latin.csv"
    path.write_bytes("a;b\n1,5;käse\n".encode("latin-1"))
    assert tuple(s.load_table(spark, str(path), sep=";", encoding="ISO-8859-1").first()) == ("1,5", "käse")
    (tmp_path / "wide.csv").write_bytes("a;b\n1,5;käse\n".encode("utf-16"))
    assert tuple(s.load_table(spark, str(tmp_path / "wide.csv"), sep=";", encoding="UTF-16").first()) == ("1,5", "käse")
    both = s.concat_tables(spark, [str(path)] * 2, sep=";", encoding="ISO-8859-1").collect()
    assert [tuple(r) for r in both] == [("1,5", "käse")] * 2
    path.write_bytes(b"a,b\n1,\xff\n")
    assert s.load_table(spark, str(path)).first()["b"] == "\ufffd"
