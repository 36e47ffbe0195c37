import json
import time

from stepforge.streaming import replay


def log_lines():
    t = lambda ms: f"2024-01-01T00:00:{ms // 1000:02d}.{ms % 1000:03d}Z"
    row = lambda ms, method, params, direction="in", id=None, doc="d": {"ts": t(ms), "doc": doc, "direction": direction, "id": id, "method": method, "params": json.dumps(params)}
    out = lambda ms, content, id=7: row(ms, replay.STATE_OUTPUT, {"id": id, "auto_update": True, "content": content})
    return [
        row(0, replay.STATE_INIT, {}, "out", 1), row(10, replay.STATE_INIT, {"state_id": 7}, "reply", 1),
        row(1000, replay.CARET, {"line": 3, "character": 4}, "out"), out(1100, "first"), out(1200, "second"), out(1250, "other panel", 8),
        row(1300, replay.DYNAMIC_OUTPUT, {"content": "hint"}),
        row(4000, replay.CARET, {"line": 4, "character": 0}, "out"), row(7000, replay.CARET, {"line": 5, "character": 1}, "out"), out(7100, "third"),
    ]


def written(tmp_path):
    path = tmp_path / "log"
    path.mkdir()
    (path / "a.json").write_text("\n".join(json.dumps(r) for r in log_lines()))
    return str(path)


def test_panels_at_carets(spark, tmp_path):
    log = replay.read_log(spark, written(tmp_path))
    got = [(r.line, r.character, r.content, r.n_outputs) for r in replay.panels_at_carets(log).orderBy("ts").collect()]
    assert got == [(3, 4, "second", 2), (4, 0, None, 0), (5, 1, "third", 1)]
    assert [r.id for r in replay.active_states(log).collect()] == [7]


def test_quiet_sessions(spark, tmp_path):
    got = replay.quiet_sessions(replay.outputs(replay.read_log(spark, written(tmp_path)))).orderBy("first_ts").collect()
    assert [(r.n_messages, r.content) for r in got] == [(3, "other panel"), (1, "third")]


def run(spark, stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        query.processAllAvailable()
        time.sleep(0.5)
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


def settled(spark, tmp_path, name, **options):
    path = written(tmp_path)
    later = {"ts": "2024-01-01T00:01:00Z", "doc": "z", "direction": "out", "method": replay.CARET, "params": '{"line":1,"character":1}'}
    (tmp_path / "log/b.json").write_text(json.dumps(later))
    stream = replay.settled_panels(replay.read_log(spark, path, stream=True), **options)
    rows = run(spark, stream, name).where("doc = 'd'").orderBy("ts").collect()
    batch = replay.panels_at_carets(replay.read_log(spark, path), **options).where("doc = 'd'").orderBy("ts").collect()
    cut = lambda rows: [(r.ts, r.line, r.character, r.content, r.n_outputs) for r in rows]
    return cut(rows), cut(batch)


def test_settled_panels_stream(spark, tmp_path):
    stream, batch = settled(spark, tmp_path, "settled")
    assert stream == batch and [r[3:] for r in stream] == [("second", 2), (None, 0), ("third", 1)]


def test_settled_panels_of_all_states(spark, tmp_path):
    stream, batch = settled(spark, tmp_path, "settled_all", only_active=False)
    assert stream == batch and [r[3:] for r in stream] == [("other panel", 3), (None, 0), ("third", 1)]
