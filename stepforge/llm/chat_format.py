"""Chat formatting with typed content parts (operator 3).

A visitor turns the parts of a message (text, image, audio, document) into one
string: text is escaped, everything else becomes a numbered placeholder whose
reference and expanded token count are recorded. Only DataFrame functions are
used; rows are formatted independently of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Opens a turn, parts role from content, closes the turn.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Strings with a meaning in this or another widespread template.
CONTROL = r"<(\||/?s>|</?SYS>>)|\[(/?INST\]|/?SYSTEM_PROMPT\]|/?TOOL_CALLS\])"
PART_TYPE = "struct<type:string,text:string,uri:string,width:long,height:long,seconds:double,pages:long>"


def escape(c: Column) -> Column:
    """Doubles backslashes and puts one behind the first character of each control string."""
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), CONTROL.replace("<(", "(<)(", 1).replace(r"|\[(", r"|(\[)("), r"$1$3\\$2$4")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


class PartVisitor:
    """What each kind of part becomes: (kind, rendered text, expanded tokens, reference).

    Override a method to change a model's rules; ``n`` is the part's place in
    its message, counted from 0. Missing measures count as the smallest size.
    """

    patch = 28
    audio_tokens_a_second = 25
    tokens_a_page = 256

    def placeholder(self, kind: str, n: Column) -> Column:
        return F.concat(F.lit(f"<|{kind}:"), n.cast("string"), F.lit("|>"))

    def text(self, p: Column, n: Column) -> tuple[Column, Column]:
        return escape(F.coalesce(p["text"], F.lit(""))), F.lit(0).cast("long")

    def image(self, p: Column, n: Column) -> tuple[Column, Column]:
        side = lambda c: F.greatest(F.ceil(F.coalesce(c, F.lit(1)) / self.patch), F.lit(1)).cast("long")
        return self.placeholder("image", n), side(p["width"]) * side(p["height"])

    def audio(self, p: Column, n: Column) -> tuple[Column, Column]:
        return self.placeholder("audio", n), F.greatest(F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * self.audio_tokens_a_second), F.lit(1)).cast("long")

    def document(self, p: Column, n: Column) -> tuple[Column, Column]:
        return self.placeholder("document", n), F.greatest(F.coalesce(p["pages"], F.lit(1)), F.lit(1)) * self.tokens_a_page

    def visit(self, p: Column, n: Column) -> Column:
        rendered, tokens = self.text(p, n)
        for kind in ("image", "audio", "document"):
            r, t = getattr(self, kind)(p, n)
            rendered, tokens = (F.when(p["type"] == kind, x).otherwise(y) for x, y in ((r, rendered), (t, tokens)))
        media = F.coalesce(p["type"].isin("image", "audio", "document"), F.lit(False))
        kind = F.when(media, p["type"]).otherwise(F.lit("text"))
        return F.struct(
            kind.alias("kind"), F.coalesce(rendered, F.lit("")).alias("rendered"), tokens.alias("tokens"), p["uri"].alias("uri"), n.alias("part")
        )


def chat_format(
    rows: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str | None = "text",
    parts: str | None = None,
    learn_from: str = "assistant",
    visitor: PartVisitor | None = None,
) -> DataFrame:
    """One formatted row per message; a conversation is its rows' ``formatted`` in order of ``turn``.

    Returns ``conv_id, turn, formatted, loss, attachments, expanded_tokens``:
    loss: (start, length) in code points of ``formatted`` of the texts that a
    model learns from; attachments: (kind, uri, part, tokens) in order.
    Messages hold either plain ``text`` or an array ``parts`` of PART_TYPE; a
    part of an unknown type counts as text.

    NULL text, role or parts count as empty; a NULL conv_id or turn stays NULL.
    Repeated rows and equal turns stay as they are. An empty table gives an
    empty table; other columns are not read.
    """
    visitor = visitor or PartVisitor()
    if parts is None:
        fields = {"type": F.lit("text"), "text": F.col(text)}
        kinds = [x.split(":") for x in PART_TYPE[7:-1].split(",")]
        content = F.array(F.struct(*[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds]))
    else:
        content = F.coalesce(F.col(parts).cast(f"array<{PART_TYPE}>"), F.array().cast(f"array<{PART_TYPE}>"))
    head = F.concat(F.lit(TURN), escape(F.coalesce(F.col(role), F.lit(""))), F.lit(TEXT))
    out = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), (F.coalesce(F.col(role), F.lit("")) == learn_from).alias("learn"),
        head.alias("head"), F.transform(content, lambda p, n: visitor.visit(p, n)).alias("seen"),
    )
    formatted = F.concat(F.col("head"), F.array_join(F.transform("seen", lambda p: p["rendered"]), ""), F.lit(END))
    nothing = F.array().cast("array<struct<start:long,length:long>>")
    start = F.struct(F.length("head").cast("long").alias("at"), nothing.alias("spans"))

    def place(state: Column, p: Column) -> Column:
        n = F.length(p["rendered"]).cast("long")
        span = F.array(F.struct(state["at"].alias("start"), n.alias("length")))
        spans = F.when((p["kind"] == "text") & (n > 0), F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((state["at"] + n).alias("at"), spans.alias("spans"))

    loss = F.when(F.col("learn"), F.aggregate("seen", start, place, lambda s: s["spans"])).otherwise(nothing)
    media = F.transform(F.filter("seen", lambda p: p["kind"] != "text"), lambda p: F.struct(p["kind"].alias("kind"), p["uri"].alias("uri"), p["part"].alias("part"), p["tokens"].alias("tokens")))
    total = F.aggregate("seen", F.lit(0).cast("long"), lambda s, p: s + p["tokens"])
    return out.select("conv_id", "turn", formatted.alias("formatted"), loss.alias("loss"), media.alias("attachments"), total.alias("expanded_tokens"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``role, text, loss_text`` of each formatted row, unescaped, from ``formatted`` and ``loss`` alone.

    Placeholders of media parts stay in ``text`` as they are.
    """
    body = F.col("formatted")
    head = F.substring_index(body, TEXT, 1)
    content = F.substr(body, F.length(head) + F.lit(len(TEXT) + 1), F.length(body) - F.length(head) - F.lit(len(TEXT) + len(END)))
    learnt = F.transform("loss", lambda s: unescape(F.substr(body, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.withColumns(
        {"role": unescape(F.substr(head, F.lit(len(TURN) + 1))), "text": unescape(content), "loss_text": F.array_join(learnt, "")}
    )


def digests(read: DataFrame) -> DataFrame:
    """Per conversation: counts and SHA-256 digests over its turns, in order.

    A digest is sequential, so the rows of a conversation pass through one task,
    in sorted order and as a stream: memory doesn't depend on their number.
    Equal turns are ordered by role, then text. NULL conv_ids form one conversation.
    """
    import hashlib

    import pandas as pd

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    sent = read.select("conv_id", "turn", "role", "text", "loss_text", F.length("formatted").cast("long").alias("chars"), F.length("loss_text").cast("long").alias("loss_chars"))
    sent = sent.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def fold(batches):
        none = object()
        key, state = none, None

        def row():
            return (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for b in batches:
            done = []
            for conv, role, text, learnt, chars, n in zip(b.conv_id, b.role, b.text, b.loss_text, b.chars, b.loss_chars):
                conv = None if pd.isna(conv) else int(conv)
                if conv != key or key is none:
                    if key is not none:
                        done.append(row())
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += n
                state[3].update(learnt.encode())
                state[4] += chars
            yield pd.DataFrame(done, columns=names).astype({"conv_id": "Int64"})
        if key is not none:
            yield pd.DataFrame([row()], columns=names).astype({"conv_id": "Int64"})

    return sent.mapInPandas(fold, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
