"""Formal-proof sources into commands with exact offsets and proof scopes.

Text in comments (nested), strings, back quotes, cartouches (nested, ASCII or
Unicode form) and verbatim braces is never a command. Offsets count code points
from 0; lines count from 1, characters from 0.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Command words by role.
KINDS: dict[str, str] = {
    word: kind
    for kind, words in {
        "header": "theory imports keywords abbrevs begin end",
        "goal": "lemma theorem corollary proposition schematic_goal instance interpretation global_interpretation sublocale typedef "
        "termination specification quotient_type functor bnf",
        "maybe_goal": "lift_definition function nominal_function quotient_definition copy_bnf lift_bnf",
        "inner_goal": "have show hence thus obtain consider interpret guess subgoal",
        "step": "apply using unfolding defer prefer supply back also moreover ultimately finally then from with case next fix assume presume "
        "define def let note write include including apply_end { }",
        "open": "proof",
        "close": "by done qed sorry . ..",
        "abandon": "oops",
        "decl": "definition fun primrec abbreviation lemmas locale context class type_synonym typedecl declare datatype codatatype "
        "instantiation notation no_notation inductive coinductive inductive_set coinductive_set record axiomatization consts "
        "named_theorems bundle unbundle syntax no_syntax translations hide_const hide_fact hide_type code_printing export_code "
        "primcorec corec partial_function fun_cases inductive_cases inductive_simps setup_lifting lifting_update print_translation "
        "parse_translation overloading experiment notepad private qualified declaration method_setup simproc_setup attribute_setup "
        "setup local_setup oracle method code_datatype code_pred nitpick_params quickcheck_params "
        "type_notation no_type_notation derive free_constructors hide_class theorems code_reserved code_identifier",
        "program": "ML ML_file SML_file",
        "inner_program": "ML_prf ML_val ML_command",
        "markup": "text txt text_raw chapter section subsection subsubsection paragraph subparagraph",
        "diag": "thm term value typ prop print_theorems find_theorems find_consts thm_deps sledgehammer nitpick quickcheck try try0 "
        "print_locale print_state export_generated_files compile_generated_files generate_file",
    }.items()
    for word in words.split()
}
#: Roles of the kinds that theory headers declare keywords with.
DECLARED: dict[str, str] = {
    "thy_goal": "goal", "thy_goal_stmt": "goal", "thy_goal_defn": "maybe_goal", "prf_goal": "inner_goal", "prf_asm_goal": "inner_goal",
    "prf_script_goal": "inner_goal", "prf_script_asm_goal": "inner_goal", "prf_open": "step", "prf_close": "step", "prf_block": "open",
    "qed": "close", "qed_block": "close", "qed_script": "close", "qed_global": "abandon", "prf_decl": "step", "prf_asm": "step",
    "prf_chain": "step", "prf_script": "step", "thy_decl": "decl", "thy_defn": "decl", "thy_stmt": "decl", "thy_load": "decl",
    "thy_decl_block": "decl", "thy_begin": "decl", "thy_end": "header", "diag": "diag", "document_heading": "markup",
    "document_body": "markup", "document_raw": "markup",
}
#: Roles that only occur inside a proof; any other one ends a proof that was left open.
INSIDE = frozenset(("inner_goal", "step", "open", "close", "abandon", "diag", "markup", "inner_program"))
#: Roles without a cursor stop in commands mode: document text and program code.
NOT_PROBED = frozenset(("markup", "program", "inner_program"))
STOPS = (
    "array<struct<seq:int,command:string,kind:string,start:int,end:int,line:int,character:int,proof_id:int,depth:int,"
    "in_proof:boolean,proof_start:int,proof_end:int>>"
)
_NAMES = [x.split(":")[0] for x in STOPS[13:-2].split(",")]

_TOKEN = re.compile(
    r'(?P<skip>\s+)|(?P<comment>\(\*)|(?P<verbatim>\{\*)|(?P<string>"(?:\\.|[^"\\])*(?:"|\Z))|(?P<back>`(?:\\.|[^`\\])*(?:`|\Z))'
    r"|(?P<cartouche>\\<open>|‹)|(?P<tag>%\w+)|(?P<word>(?:[^\W\d_]|\\<\^?\w+>)(?:[\w']|\\<\^?\w+>|\.(?=[^\W\d_]))*)"
    r"|(?P<dots>\.+)|(?P<number>\d+)|(?P<other>\\<\^?\w+>|.)",
    re.S,
)
_NESTED = {"comment": (re.compile(r"\(\*|\*\)"), "(*"), "cartouche": (re.compile(r"\\<open>|\\<close>|‹|›"), ("\\<open>", "‹"))}


def tokens(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, text, start, end) of what is neither white space nor a comment; unclosed quotes reach to the end."""
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        kind, end = m.lastgroup, m.end()
        if kind in _NESTED:
            marks, opening = _NESTED[kind]
            depth = 0
            for k in marks.finditer(text, at):
                depth += 1 if k[0] in opening else -1
                end = k.end()
                if not depth:
                    break
            else:
                end = len(text)
        elif kind == "verbatim":
            end = text.find("*}", end)
            end = len(text) if end < 0 else end + 2
        if kind not in ("skip", "comment"):
            yield kind, text[at:end], at, end
        at = end


def declared_keywords(text: str) -> dict[str, str]:
    """Commands that the header of a theory declares, by role."""
    found, names, state = {}, [], None
    for kind, value, _, _ in tokens(text):
        if kind == "word" and value == "keywords":
            state = "names"
        elif state is None:
            if kind == "word" and value == "begin":
                break
        elif kind == "word" and value in ("begin", "abbrevs", "imports"):
            break
        elif kind == "string" and state == "names":
            names.append(value.strip('"'))
        elif kind == "other" and value == ":":
            state = "kind"
        elif kind in ("word", "string") and state == "kind":
            role = DECLARED.get(value.strip('"'))
            found |= {n: role for n in names if role}
            names, state = [], "options"
        elif kind == "word" and value == "and":
            names, state = ([], "names") if state != "names" else (names, state)
    return found


def commands(text: str, extra: dict[str, str] | None = None) -> list[tuple[str, str, int, int]]:
    """(word, role, start, end): each command reaches to its last token before the next one."""
    kinds = {**KINDS, **declared_keywords(text), **(extra or {})}
    found, in_header = [], False
    for kind, value, start, end in tokens(text):
        role = None
        if kind in ("word", "dots") or value in "{}":
            role = kinds.get(value)
        if value == "theory" and role == "header":
            in_header = True
        elif role and in_header and role != "header":
            role = None  # nothing but header words up to ``begin``
        if role == "header" and value in ("imports", "keywords", "abbrevs") and not in_header:
            role = None
        if value == "begin":
            if not in_header:
                role = None  # the begin of a block belongs to its command
            in_header = False
        if role:
            found.append([value, role, start, end])
        elif found:
            found[-1][3] = end
    return [tuple(f) for f in found]


def scopes(found: list[tuple[str, str, int, int]]) -> list[tuple[int | None, int]]:
    """(proof, depth) of each command: its proof's number, and the goals and blocks open after it."""
    out, stack, proof, last = [], [], None, -1
    for i, (word, role, _, _) in enumerate(found):
        if proof is not None and role not in INSIDE and not (word == "end" and "notepad" in stack):
            stack, proof = [], None
        following = found[i + 1][1] if i + 1 < len(found) else None
        own = proof
        if proof is None:
            optional = role == "maybe_goal" and following in ("open", "close", "step", "abandon")
            if role == "goal" or optional or word == "notepad":
                last += 1
                own = proof = last
                stack = ["notepad" if word == "notepad" else "goal"]
        elif role == "inner_goal":
            stack.append("goal")
        elif role == "open":
            stack.append("block")
        elif role == "abandon":
            stack = []
        elif word == "qed":
            while stack and stack.pop() != "block":
                pass
            if stack and stack[-1] == "goal":
                stack.pop()
        elif role == "close" and stack and stack[-1] == "goal":
            stack.pop()
        elif word == "end":
            stack = []
        out.append((own, len(stack)))
        if not stack:
            proof = None
    return out


def segment(text: str | None, mode: str = "commands", extra: dict[str, str] | None = None) -> list[dict]:
    """Cursor stops of a source: at the end of every command, or of every token between white space."""
    if mode not in ("commands", "tokens"):
        raise ValueError("mode is 'commands' or 'tokens'")
    text = text or ""
    found = commands(text, extra)
    scope = scopes(found)
    span: dict[int, list[int]] = {}
    for (_, _, start, end), (proof, _) in zip(found, scope):
        if proof is not None:
            span.setdefault(proof, [start, end])[1] = end
    breaks = [m.start() for m in re.finditer("\n", text)]
    if mode == "tokens":
        starts = [f[2] for f in found]
        stops = [(m.start(), m.end(), bisect_right(starts, m.start()) - 1) for m in re.finditer(r"\S+", text)]
    else:
        stops = [(f[2], f[3], i) for i, f in enumerate(found) if f[1] not in NOT_PROBED]
    rows = []
    for seq, (start, end, i) in enumerate(stops):
        word, role = found[i][:2] if i >= 0 else (None, None)
        proof, depth = scope[i] if i >= 0 else (None, 0)
        line = bisect_right(breaks, end - 1)
        values = (
            seq, word, role, start, end, line + 1, end - (breaks[line - 1] + 1 if line else 0), proof, depth,
            proof is not None, *(span[proof] if proof is not None else (None, None)),
        )
        rows.append(dict(zip(_NAMES, values)))
    return rows


def segments(text: str | Column, mode: str = "commands", extra: dict[str, str] | None = None) -> Column:
    """Array of stops of each source, an Arrow-batched UDF (one call per file)."""

    @F.pandas_udf(STOPS)
    def run(t: pd.Series) -> pd.Series:
        return pd.Series([segment(x, mode, extra) for x in t], dtype=object)

    return run(text)


def stops(files: DataFrame, path: str = "path", text: str = "text", mode: str = "commands", extra: dict[str, str] | None = None) -> DataFrame:
    """One row per stop: ``file``, the source ``text`` and the fields of the stop."""
    found = files.select(F.col(path).alias("file"), F.col(text).alias("text"), segments(text, mode, extra).alias("__s"))
    return found.select("file", "text", F.explode("__s").alias("s")).select("file", "text", "s.*")


def counted(rows: DataFrame) -> DataFrame:
    """Stops that count as states: in a proof, a command word, and a goal left to show."""
    return rows.where(F.col("in_proof") & F.col("command").rlike(r"^\w") & (F.col("end") < F.col("proof_end")))
