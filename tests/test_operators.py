from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stepforge.functions import text
from stepforge.operators import audit, correlate, dedup, lookup, proofs, select
from stepforge.plans import harvest
from stepforge.sources import corpus


def test_first_wins_null_keys(spark):
    df = spark.createDataFrame([(None, 1, 9), (None, 1, 3), ("a", 1, 5), ("a", None, 5), ("a", None, 4)], "k string, l int, o int")
    kept = dedup.first_wins(df, ["k", "l"], ["o"])
    assert sorted((r.k or "", r.l or 0, r.o) for r in kept.collect()) == [("", 1, 3), ("a", 0, 4), ("a", 1, 5)]
    assert dedup.duplicate_counts(df, ["k", "l"]).first() == (5, 3, 2)
    assert dedup.duplicate_counts(df.limit(0), ["k"]).first() == (0, 0, 0)


def test_text_functions(spark):
    values = ["  a b ", " x \t", "\x1cq\x1f", "", None, "a\r\nb\rc\x0bd e\n"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select(text.strip("v"), text.rstrip("v"), text.split_lines("v"), text.first_word("v")).collect()
    for v, r in zip(values, got):
        assert tuple(r) == ((v.strip(), v.rstrip(), v.splitlines(), v.strip().split(" ")[0]) if v is not None else (None, None, None, None))
    paths = spark.createDataFrame([("/c/E1/T.thy",), ("T.thy",), ("/r/E/lib/x/U.thy",)], "p string")
    assert [tuple(r) for r in paths.select(text.parent_name("p"), text.entry_under("p", "/r")).collect()] == [("E1", None), ("", None), ("x", "E")]
    s = spark.createDataFrame([("goal (2 subgoals):",), ("goal (1 subgoal):",), ("No subgoals!",), ("x",)], "s string")
    assert [r[0] for r in s.select(text.subgoals("s")).collect()] == [2, 1, 0, None]


def test_shards_are_a_partition(spark):
    df = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("path"))
    placed = [r.path for r in select.with_ordinal(df, "path").orderBy("ordinal").collect()]
    assert placed == sorted(placed)
    parts = [{r.path for r in select.shard(df, i, 3).collect()} for i in range(3)]
    assert sum(map(len, parts)) == 1000 == len(set.union(*parts)) and max(map(len, parts)) == 334
    assert select.first_n(df, 5).count() == 5 and select.with_ordinal(df.limit(0), "path").count() == 0


def test_choose_files_and_resume(spark):
    files = spark.createDataFrame([(f"/c/E{i % 3}/T{i}.thy", f"E{i % 3}", "") for i in range(12)], "path string, entry_ref string, text string")
    everything = {r.path for r in harvest.choose_files(files).collect()}
    first = {r.path for r in harvest.choose_files(files, limit=5).collect()}
    done = spark.createDataFrame([(p,) for p in first] * 2, "file string")
    rest = {r.path for r in harvest.choose_files(files, done=done).collect()}
    assert first | rest == everything and not first & rest
    one = spark.createDataFrame([("E1",)], "entry string")
    assert harvest.choose_files(files, include="E[12]/", entries=one).count() == 4


def test_containing_both_ways(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "aquick brown foxes"), (3, None)], "i int, text string")
    needles = spark.createDataFrame([(1, "uick brown fox"), (2, "nothing of it"), (3, "ick b")], "n int, needle string")
    want = [(1, 1), (1, 3), (2, 1), (2, 3)]
    assert sorted((r.i, r.n) for r in audit.containing(docs, needles, "text", "needle").collect()) == want
    monkeypatch.setattr(audit, "BROADCAST_NEEDLES", 2)
    assert sorted((r.i, r.n) for r in audit.containing(docs, needles, "text", "needle").collect()) == want


def test_as_of_and_responses(spark):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    left = spark.createDataFrame([("u", at(5), 1), ("u", at(1), 2), ("v", at(5), 3)], "k string, ts timestamp, id int")
    right = spark.createDataFrame([("u", at(2), "a"), ("u", at(5), "b"), ("v", at(9), "c")], "k string, ts timestamp, x string")
    out = {r.id: r.matched_x for r in correlate.as_of(left, right, ["k"], "ts", ["x"]).collect()}
    assert out == {1: "b", 2: None, 3: None}
    near = {r.id: r.matched_x for r in correlate.as_of(left, right.where("x = 'a'"), ["k"], "ts", ["x"], "2 seconds").collect()}
    assert near == {1: None, 2: None, 3: None}
    assert [(r.id, r.reply_x) for r in correlate.responses(left, right, "k", "ts", "4 seconds").orderBy("id", "reply_x").collect()] == [(1, "b"), (2, "a"), (2, "b"), (3, "c")]
    asked, told = ([(f"u{i % 2}", at(i * step), i) for i in range(60)] for step in (7, 5))
    want = sorted((i, j) for k, s, i in asked for o, e, j in told if k == o and s <= e <= s + timedelta(seconds=10))
    kept = correlate.responses(spark.createDataFrame(asked, "k string, ts timestamp, id int"), spark.createDataFrame(told, "k string, ts timestamp, id int"), "k", "ts", "10 seconds")
    assert sorted((r.id, r.reply_id) for r in kept.collect()) == want and kept.columns == ["k", "ts", "id", "reply_ts", "reply_id"]
    flagged = correlate.sessions(right, ["k"], "ts", "2 seconds", "x")
    assert sorted((r.x, r.session) for r in flagged.collect()) == [("a", 1), ("b", 2), ("c", 1)]


def test_prefixes(spark):
    steps = spark.createDataFrame([("g", 1, None), ("g", 2, "a"), ("g", 3, None), ("g", 4, "b"), ("h", 1, "c")], "g string, n int, x string")
    got = {(r.g, r.n): (r.prefix, r.continuation) for r in proofs.prefixes(steps, ["g"], "n", "x", "-").collect()}
    assert got == {("g", 1): ("", "a-b"), ("g", 2): ("a", "b"), ("g", 3): ("a", "b"), ("g", 4): ("a-b", ""), ("h", 1): ("c", "")}


def test_chains(spark):
    rows = [(f"s{i}", f"s{i + 1}") for i in range(20)] + [("s20", "HOL"), ("x", "HOL"), ("top", None)]
    got = {r.k: (r.root, r.depth) for r in lookup.chains(spark.createDataFrame(rows, "k string, p string"), "k", "p").collect()}
    assert got["s0"] == ("HOL", 21) and got["s20"] == got["x"] == ("HOL", 1) and got["top"] == ("top", 0)


def test_corpus(spark, tmp_path):
    (tmp_path / "E/lib").mkdir(parents=True)
    (tmp_path / "E/A.thy").write_bytes(b"theory A imports Main \"lib/B\" Other.C begin lemma x: P by \xff end")
    (tmp_path / "E/lib/B.thy").write_text("theory B imports Main begin end")
    (tmp_path / "O").mkdir()
    (tmp_path / "O/C.thy").write_text("theory C imports Main begin end")
    (tmp_path / "O/ROOT").write_text("session Other = HOL + theories C")
    files = corpus.theories(spark, str(tmp_path))
    assert sorted((r.theory, r.entry_ref, r.entry_root) for r in files.collect()) == [("A", "E", "E"), ("B", "lib", "E"), ("C", "O", "O")]
    assert "�" in files.where("theory = 'A'").first().text
    table = corpus.session_table(spark, str(tmp_path))
    got = {r.imported: r.target for r in corpus.resolve_imports(corpus.imports(files), files, table).where("path like '%/A.thy'").collect()}
    assert got["Main"] is None and got["lib/B"].endswith("/E/lib/B.thy") and got["Other.C"].endswith("/O/C.thy")
    assert corpus.hol_only(table).count() == 1 and corpus.session_roots(table).first().root == "HOL"
