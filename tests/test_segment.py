import random
import re

from stepforge.functions import roots, segment
from stepforge.plans import harvest

#: A small theory of our own, with the shapes that matter.
THEORY = '''theory %invisible Garden
  imports Main "HOL-Library.FSet"
  keywords "claim_it" :: thy_goal and "display_it" :: diag
begin

(* a remark (* with lemma inside *) and done *)

lemma gate [intro]: "even m \\<Longrightarrow> even (m * n + m)"
  apply (erule evenE)
  apply (simp only: dvd_def)
  apply presburger
  done

theorem swapped: "prod.swap (prod.swap p) = p"
proof (cases p)
  case (Pair u v)
  then show ?thesis by simp
qed

text ‹done and proof in text›

instance ..
definition twin where "twin = (qed)"
claim_it pond: \\<open>theorem\\<close> sorry
lemma never_shown: "Q" oops
lemma hedge: "C & D & E"
proof (intro conjI)
  show C
  proof (rule ccontr)
    { assume "~ C" then have False by blast }
    then show False .
  qed
next
  show D subgoal by metis done
next
  show E by fact
qed

end
'''


def stops(text=THEORY, **k):
    return segment.segment(text, **k)


def test_commands_and_scopes():
    rows = stops()
    words = [r["command"] for r in rows]
    assert words[:8] == ["theory", "imports", "keywords", "begin", "lemma", "apply", "apply", "apply"]
    assert "text" not in words and words.count("claim_it") == 1 and words[-1] == "end"
    outside = {r["command"] for r in rows if not r["in_proof"]}
    assert outside == {"theory", "imports", "keywords", "begin", "definition", "end"}
    assert len({r["proof_id"] for r in rows if r["in_proof"]}) == 6
    nested = [r for r in rows if r["proof_id"] == 5]
    assert nested[0]["command"] == "lemma" and nested[-1]["command"] == "qed" and nested[-1]["depth"] == 0


def test_offsets_are_ends_of_commands():
    for r in stops():
        before = THEORY[: r["end"]]
        assert not THEORY[r["end"] - 1].isspace()
        assert (r["line"], r["character"]) == (before.count("\n") + 1, len(before) - before.rfind("\n") - 1)
        assert THEORY[r["start"] :].startswith(r["command"])


def test_prefix_and_continuation_make_the_proof(spark):
    files = spark.createDataFrame([("/c/E/Garden.thy", THEORY)], "path string, text string")
    rows = harvest.state_rows(files).collect()
    for r in rows:
        if r.in_proof:
            assert r.prefix + r.continuation == THEORY[r.proof_start : r.proof_end]
            assert (r.continuation == "") == (r.offset == r.proof_end) and (r.state == "") == (r.continuation == "")
    whole = harvest.state_rows(files, prefix_scope="file").collect()
    assert all(r.prefix == THEORY[: r.offset] for r in whole)


def test_counted_states_and_transitions(spark):
    shape = "lemma l: P\n  apply a\n  apply b\n  done\n"
    isar = "lemma m: P\nproof -\n  have P by s\n  thus P .\nqed\n"
    text = f"theory T imports Main begin\n{shape}{isar}{shape}{shape}end\n"
    files = spark.createDataFrame([("/c/E/T.thy", text)], "path string, text string")
    states = harvest.state_rows(files)
    assert states.where("in_proof").count() == 4 + 7 + 4 + 4
    assert segment.counted(states).count() == 3 + 5 + 3 + 3
    moves = harvest.transition_rows(states).collect()
    assert len(moves) == 2 + 4 + 2 + 2 and all(m.tactic.split()[0] in ("apply", "proof", "have", "by", "thus") for m in moves)


def test_token_mode_and_odd_texts():
    rows = stops("lemma x: P\n by simp", mode="tokens")
    assert [(r["start"], r["end"]) for r in rows] == [(0, 5), (6, 8), (9, 10), (12, 14), (15, 19)]
    assert stops(None) == [] and stops("") == [] and stops("(* lemma") == [] and stops('"unclosed lemma') == []
    assert [r["command"] for r in stops("lemma a: P\r\n by simp\r\nend")] == ["lemma", "by", "end"]
    assert [r["command"] for r in stops("lemma {* by *} oops")] == ["lemma", "oops"]


def test_damaged_texts_never_fail():
    rng = random.Random(0)
    signs = ["(*", "*)", '"', "`", "‹", "›", "{*", "*}", "\\<open>", "lemma ", "proof", " qed", " by x ", "\n", "begin", "end"]
    for _ in range(400):
        at = sorted(rng.randrange(len(THEORY)) for _ in range(4))
        text = THEORY[: at[0]] + "".join(rng.choices(signs, k=rng.randrange(8))) + THEORY[at[1] : at[2]] + THEORY[at[3] :]
        for r in segment.segment(text):
            assert 0 <= r["start"] < r["end"] <= len(text)


ROOT = """chapter One
(* session Not = HOL + theories X *)
session A_B (main slow) in "Sub-Dir" = "HOL-Library" +
  description ‹Text›
  options [timeout = 600, document = false, quick]
  sessions
    "HOL-Algebra"
    Deriving
  directories "lib" more
  theories [condition = VAR]
    A "lib/B" (global)
  theories C
  document_files "root.tex"
session
  Two
  = HOL + theories Two.X
"""


def test_sessions():
    one, two = roots.parse_root(ROOT)
    assert (one["session"], one["parent"], one["in_dir"], one["groups"]) == ("A_B", "HOL-Library", "Sub-Dir", ["main", "slow"])
    assert one["options"] == {"timeout": "600", "document": "false", "quick": "true"} and one["description"] == "Text"
    assert one["sessions"] == ["HOL-Algebra", "Deriving"] and one["directories"] == ["lib", "more"]
    assert [(t["name"], t["opts"], t["is_global"]) for t in one["theories"]] == [
        ("A", {"condition": "VAR"}, False), ("lib/B", {"condition": "VAR"}, True), ("C", {}, False),
    ]
    assert (two["session"], two["parent"], [t["name"] for t in two["theories"]]) == ("Two", "HOL", ["Two.X"])
    assert roots.parse_root("chapter_definition X\n") == roots.parse_root(None) == []


def test_sessions_frame(spark):
    df = roots.sessions(spark.createDataFrame([("/a/Entry/ROOT", ROOT)], "path string, text string"))
    assert [(r.entry, r.session) for r in df.orderBy("session").collect()] == [("Entry", "A_B"), ("Entry", "Two")]
    assert re.match("A_B", df.where("parent = 'HOL-Library'").first().session)


def test_program_code_is_no_stop():
    source = "theory P imports Main begin\nML \\<open>val a = 1\\<close>\nML_file \"p.ML\"\nlemma q: \"B\"\n  ML_prf \\<open>val b = 2\\<close>\n  by blast\nend"
    stops = segment.segment(source)
    assert [s["command"] for s in stops] == ["theory", "imports", "begin", "lemma", "by", "end"]
    assert [s["command"] for s in stops if s["in_proof"]] == ["lemma", "by"]
