import json

from stepforge import cli

THEORY = "theory {0} imports Main begin\nlemma l: P\n  apply a\n  done\nend\n"


def corpus(tmp_path):
    for name in "ABC":
        (tmp_path / f"thys/E{name}").mkdir(parents=True)
        (tmp_path / f"thys/E{name}/{name}.thy").write_text(THEORY.format(name))
    return ["harvest", "--corpus", str(tmp_path / "thys")]


def states(spark, path):
    return [json.loads(r[0]) for r in spark.read.text(f"{path}/states.jsonl").collect()]


def test_harvest_resume_equals_full_run(spark, tmp_path):
    args = corpus(tmp_path)
    assert cli.run(spark, [*args, "--out", str(tmp_path / "full")]) == 0
    assert cli.run(spark, [*args, "--out", str(tmp_path / "part"), "--limit", "1"]) == 0
    assert cli.run(spark, [*args, "--out", str(tmp_path / "part"), "--resume"]) == 0
    key = lambda r: (r["file"], r["offset"])
    full = sorted(states(spark, tmp_path / "full"), key=key)
    assert full == sorted(states(spark, tmp_path / "part"), key=key) and len(full) == 3 * 7
    assert sum(r["in_proof"] for r in full) == 9


def test_harvest_shards_then_merge(spark, tmp_path, capsys):
    args = corpus(tmp_path)
    proof = "lemma l{0}: P\n  apply a\n  apply b\n  done\n"
    (tmp_path / "thys/EA/A.thy").write_text("theory A imports Main begin\n" + "".join(map(proof.format, range(3))) + "end\n")
    n = {}
    for i in range(2):
        out = str(tmp_path / f"out/shard_{i}")
        cli.run(spark, [*args, "--out", out, "--shard", str(i), "--num-shards", "2"])
        for name in ("states", "transitions"):
            n[name] = n.get(name, 0) + spark.read.text(f"{out}/{name}.jsonl").count()
    (tmp_path / "held").write_text("EB\n")
    capsys.readouterr()
    # the folders as they were written: equal tactics of several proofs stay apart
    assert cli.run(spark, ["merge", str(tmp_path / "out"), "--out", str(tmp_path / "merged"), "--test-entries", str(tmp_path / "held")]) == 1
    report = json.loads(capsys.readouterr().out)
    assert len(states(spark, tmp_path / "merged")) == n["states"] == report["n_states"]
    assert spark.read.text(f"{tmp_path}/merged/transitions.jsonl").count() == n["transitions"] == report["n_transitions"] >= 6
    assert report["empty_shards"] == [] and set(report["kept_per_shard"]) == {"shard_0", "shard_1"}


def test_resume_keeps_every_format(spark, tmp_path):
    args = corpus(tmp_path)
    for how, read in (("parquet", spark.read.parquet), ("both", spark.read.json)):
        out = str(tmp_path / how)
        assert cli.run(spark, [*args, "--out", out, "--format", how, "--limit", "1"]) == 0
        assert cli.run(spark, [*args, "--out", out, "--format", how, "--resume"]) == 0
        assert read(f"{out}/states.{'jsonl' if how == 'both' else how}").select("file", "offset").distinct().count() == 3 * 7
    assert len(json.loads((tmp_path / "both/states.jsonl.json").read_text())) == 3 * 7


def test_sample_is_stable(spark, tmp_path, capsys):
    (tmp_path / "x.jsonl").write_text("\n".join(f'{{"i":{i}}}' for i in range(50)))
    for _ in range(2):
        cli.run(spark, ["sample", str(tmp_path / "x.jsonl"), "--sample", "4"])
    lines = capsys.readouterr().out.split()
    assert len(lines) == 8 and lines[:4] == lines[4:]
