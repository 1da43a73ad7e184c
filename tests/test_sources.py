import pyarrow as pa
import pytest

from ashlar.operators.frame import Frame
from ashlar.sources import readers as R
from ashlar.sources import writers as W
from ashlar.sources.policy import IoPolicy, PolicyError, set_io_policy


def test_csv_typing(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id,code,x,flag,t,t\n1,007,1.5,true,"",a\n2,+8,,false,NA,"b ""q"", c"\n9007199254740993,9,2e3,TRUE,z,\n')
    f = R.read_csv(spark, str(p))
    assert f.columns == ["id", "code", "x", "flag", "t", "t_1"]
    rows = f.collect()
    assert rows[0] == {"id": "1", "code": "007", "x": 1.5, "flag": True, "t": "", "t_1": "a"}
    assert rows[1]["t"] is None and rows[1]["x"] is None and rows[1]["t_1"] == 'b "q", c'
    assert f.dtypes["id"] == "string" and f.dtypes["x"] == "double" and f.dtypes["flag"] == "boolean"


def test_csv_options(spark):
    f = R.from_csv(spark, "junk\n#c\na;b;c\n1.234,5;x;1\n2,5;y;2\n3,5;z;3\n", separator=";", skip_rows=1, comment="#", decimal=",", thousands=".", n_rows=2, usecols=["a", 2])
    assert f.collect() == [{"a": 1234.5, "c": 1}, {"a": 2.5, "c": 2}]
    assert R.from_csv(spark, "1,2\n3,4\n", header=False, names=["p", "q"]).collect() == [{"p": 1, "q": 2}, {"p": 3, "q": 4}]


def test_csv_round_trip(spark, tmp_path):
    f = R.from_rows(spark, [{"a": 1, "s": "=x"}, {"a": None, "s": ""}, {"a": 3, "s": None}])
    W.write_csv(f, str(tmp_path / "o"), escape_formulas=True)
    back = sorted(R.read_csv(spark, str(tmp_path / "o")).collect(), key=str)
    assert back == sorted([{"a": 1, "s": "'=x"}, {"a": None, "s": ""}, {"a": 3, "s": None}], key=str)
    assert W.to_csv(f).splitlines()[:2] == ["a,s", "1,=x"]


def test_json(spark, tmp_path):
    for orient, text in {"records": '[{"a":1,"b":"x"},{"a":2,"b":null}]', "lines": '{"a":1,"b":"x"}\n{"a":2,"b":null}\n', "columns": '{"a":[1,2],"b":["x",null]}'}.items():
        (tmp_path / f"{orient}.json").write_text(text)
        got = R.read_json(spark, str(tmp_path / f"{orient}.json"), orient).df.orderBy("a").collect()
        assert [tuple(r) for r in got] == [(1, "x"), (2, None)]
    f = R.from_json(spark, '[{"a":1},{"a":2.5,"c":true}]')
    assert f.collect() == [{"a": 1.0, "c": None}, {"a": 2.5, "c": True}]
    assert W.to_json(f, "columns") == '{"a": [1.0, 2.5], "c": [null, true]}'
    W.write_json(f, str(tmp_path / "j"))
    assert R.read_json(spark, str(tmp_path / "j"), "lines").df.count() == 2


def test_parquet_arrow_excel(spark, tmp_path, sf):
    f = R.read_parquet(spark, f"{sf}/nation.parquet", columns=["n_name"], row_start=2, row_end=5, order=["n_nationkey"])
    assert f.df.count() == 3
    n = Frame(spark.read.parquet(f"{sf}/nation.parquet"))
    W.write_parquet(n, str(tmp_path / "p"), codec="GZIP")
    assert R.read(spark, str(tmp_path / "p"), "parquet").df.count() == 25
    W.write_arrow_ipc(n, str(tmp_path / "n.arrow"))
    assert sorted(map(str, R.read(spark, str(tmp_path / "n.arrow")).collect())) == sorted(map(str, n.collect()))
    assert R.from_arrow_ipc(spark, W.to_arrow_ipc(n)).df.count() == 25
    t = pa.table({"u": pa.array([1, None], pa.uint8()), "c": pa.array(["a", "b"]).dictionary_encode()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    assert R.from_arrow_ipc(spark, sink.getvalue().to_pybytes()).collect() == [{"u": 1, "c": "a"}, {"u": None, "c": "b"}]
    W.write_excel(n, str(tmp_path / "n.xlsx"))
    assert sorted(map(str, R.read_excel(spark, str(tmp_path / "n.xlsx")).collect())) == sorted(map(str, n.collect()))


def test_kafka_rows(spark):
    m = spark.createDataFrame([("t", 0, 5, "k", '{"a": 1, "u": {"id": 7}, "l": [1, 2]}'), ("t", 1, 6, None, '{"a": 2.5}')], "topic string, partition int, offset long, key string, value string").selectExpr("*", "timestamp'2024-01-01' as timestamp")
    f = R.kafka_rows(m)
    got = f.df.orderBy("_kafka_offset").collect()
    assert got[0]["u.id"] == 7.0 and got[1]["a"] == 2.5 and got[0]["l"] == "[1,2]" and got[1]["_kafka_key"] is None
    assert R.kafka_rows(m, "auto").columns == f.columns


def test_policy_and_limits(spark, tmp_path):
    set_io_policy(IoPolicy(allowed_dirs=[str(tmp_path)]))
    try:
        with pytest.raises(PolicyError):
            R.read_csv(spark, "/etc/passwd")
        with pytest.raises(PolicyError):
            IoPolicy(allowed_hosts=["a.example"]).check("https://b.example/x")
        with pytest.raises(PolicyError):
            IoPolicy(deny_private_hosts=True).check("http://127.0.0.1/x")
    finally:
        set_io_policy(None)
    assert R.limited("select 1;", 3) == "SELECT * FROM (select 1) q LIMIT 3"
    with pytest.raises(ValueError):
        R.limited("drop table x; select 1", 3)


def test_present(spark):
    f = R.from_columns(spark, {"a": [1, 2], "b": ["x|y", None]})
    assert W.to_markdown(f).splitlines() == ["| a | b |", "| ---: | --- |", "| 1 | x\\|y |", "| 2 |  |"]
    assert "<td>x|y</td>" in W.to_html(f)


def test_header_goes_once_per_file_and_words_stay(spark, tmp_path):
    from ashlar.sources import readers

    for n, rows in (("a", "a,b\nx,none\na,b\ny,n/a\n"), ("b", "a,b\nz,null\n")):
        (tmp_path / f"{n}.csv").write_text(rows)
    got = sorted(tuple(r) for r in readers.read_csv(spark, str(tmp_path)).df.collect())
    assert got == [("a", "b"), ("x", "none"), ("y", "n/a"), ("z", None)]
