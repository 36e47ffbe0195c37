import json

import pytest

from stepforge.operators.merge import LeakageError, merge_shards
from stepforge.sources import jsonl

FILES = {
    "shard_0": '{"file":"/c/E1/T.thy","line":1,"character":3,"v":0}\n\n{bad\n',
    "shard_10": '{"file":"/c/E1/T.thy","line":1,"character":3,"v":10}\n{"file":"/c/E2/T.thy","line":2,"character":0,"v":10}\n',
    "shard_2": '{"file":"/c/E2/T.thy","line":2,"character":0,"v":2}\n{"file":"/c/E3/sub/U.thy","line":5,"character":1,"v":2}\n',
    "shard_3": "",
}


@pytest.fixture
def shards(tmp_path):
    for name, text in FILES.items():
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "states.jsonl").write_text(text)
    (tmp_path / "in/shard_0/transitions.jsonl").write_text('{"file":"/c/E1/T.thy","line":1,"character":3,"tactic":"a"}\n{"file":"/c/E1/T.thy","line":1,"character":3,"tactic":"b"}\n"text"\n')
    return tmp_path


def entries(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "entry string")


def test_merge(spark, shards):
    out = str(shards / "out")
    m = merge_shards(spark, str(shards / "in"), out, held_out=entries(spark, "sub"), expected=entries(spark, "E1", "E2", "E3"))
    lines = spark.read.text(f"{out}/states.jsonl").collect()
    assert sorted(json.loads(r[0])["v"] for r in lines) == [0, 2, 10]
    r = m.report
    assert (m.status, r["n_shards"], r["n_states"], r["n_states_duplicates"], r["n_transitions"]) == (1, 4, 3, 2, 2)
    assert (r["n_files"], r["n_entries"], r["empty_shards"], r["missing_e_g"], r["leaked_e_g"]) == (3, 3, ["shard_3"], ["E3"], ["sub"])
    assert (r["coverage_ref_pct"], r["coverage_true_pct"]) == (100.0, 66.7)
    assert r["kept_per_shard"] == {"shard_0": 3, "shard_10": 1, "shard_2": 1}
    assert sorted((b.shard, b.line_no) for b in m.bad_lines.collect()) == [("shard_0", 3), ("shard_0", 3)]


def test_merge_is_idempotent(spark, shards):
    first, second = str(shards / "again/shard_0"), str(shards / "twice")
    merge_shards(spark, str(shards / "in"), first)
    merge_shards(spark, str(shards / "again"), second)
    read = lambda p: sorted(r[0] for r in spark.read.text(p).collect())
    for name in ("states", "transitions"):
        assert read(f"{first}/{name}.jsonl") == read(f"{second}/{name}.jsonl") != []


def test_lenient_fields_strict_objects(spark):
    lines = ['{"line":"5"}', ' {"line":5.0} ', '{"line":5,"x":[1]}', '{"line":true}', "{}", '{"line":1} x', '{"line":1},{"line":2}', "[1]", "3", '{"line":', "", " "]
    df = spark.createDataFrame([(x,) for x in lines], "raw string")
    good, bad = jsonl.parse_lines(df, "line long, file string")
    assert [(r.raw, r.rec.line) for r in good.collect()] == list(zip(lines[:5], [5, 5, 5, None, None]))
    assert [r.raw for r in bad.collect()] == lines[5:10]


def test_status(spark, shards):
    assert merge_shards(spark, str(shards / "none")).status == 2
    assert merge_shards(spark, str(shards / "in"), held_out=entries(spark, "E3")).status == 0
    with pytest.raises(LeakageError):
        merge_shards(spark, str(shards / "in"), held_out=entries(spark, "E1"), fail_before_write=True)


def test_encodings(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "a int, b string")
    jsonl.write_rows(df, str(tmp_path / "x"), "both")
    assert json.loads((tmp_path / "x.json").read_text()) == [{"a": 1, "b": "é"}, {"a": 2}]
    assert spark.read.text(str(tmp_path / "x")).count() == 2
    assert jsonl.read_raw(spark, str(tmp_path / "nothing*")).count() == 0
    (tmp_path / "list").write_text("b\n a \n\nb\n")
    assert sorted(r[0] for r in jsonl.read_entries(spark, str(tmp_path / "list")).collect()) == ["a", "b"]
