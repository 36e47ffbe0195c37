"""Operators 1, 3, 4, 8 on small inputs, against brute force or by round trip."""

import hashlib
import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from stepforge.llm import chat_format, html_text, license_rules, quality_rules
from stepforge.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


GOOD = " ".join(f"{x} common" if i % 3 else f"{x} text" for i, x in enumerate(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)))
TEXTS = [None, "", " \n\t", "a", "a b c a b c d", "x\nx\n \nx y\nx y", GOOD, GOOD, "spam eggs ham " * 40, "日本語 テキスト " * 30, "ab cd e\x0bf\x1cg " * 20, "*&%$ " * 60]


def test_quality_rules(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", 0) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, DOCS).withColumn("quality", F.lit("clash"))
    got = quality_rules.quality_rules(df, vocabulary("piece_bpe_32k.model")).orderBy("doc_id").collect()
    for r, t in zip(got, TEXTS):
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == brute_base(t)
        assert not (q.base_failed and q.kept)
    assert got[6].quality.kept and got[7].quality.asDict() == got[6].quality.asDict() | {"script": got[7].quality.script}
    assert quality_rules.quality_rules(df.limit(0), vocabulary("piece_bpe_32k.model")).count() == 0


def test_fertility_figures():
    import math

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    tokens = quality_rules._Tokens(vocabulary("piece_bpe_32k.model"))
    for text in (GOOD, "日本語 テキスト ꙮꙮ " * 30):
        ids = [t for w in WORD.findall(text) for t in model.encode(w)]
        p = [ids.count(t) / len(ids) for t in set(ids)]
        row = quality_rules.measure(text, None, tokens, quality_rules.BANDS, 50, 50)
        assert row[6] == len(ids) and row[7] == sum(map(model.is_byte, ids))
        assert row[10] == pytest.approx(-sum(x * math.log2(x) for x in p))
    assert row[11] == "CJK" and row[7] > 0


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


TEXT = "Some longer paragraph of text, with enough words in it to count as one"
ARTICLE = f"<article class='post-12'><h1>Head</h1><p>{TEXT}.<p>Second&nbsp;&amp;   {TEXT}<br>end</article>"
CHROME = "<nav><a href='/'>Home and other links, many of them, to be longer than the text</a></nav><div class='ad'>Buy now, this is a very long advert indeed</div><form>Name<input></form><div id='cookie-notice'>We use cookies on this page, really we do</div>"
BELOW = f"<div class='comments'><p>{TEXT} says a reader</p></div><aside>More to read, more and more to read here</aside><footer>&copy; me</footer><script>var t='</p>'</script><!-- <p>x</p> -->"


def test_html(spark):
    main = f"Head {TEXT}. Second & {TEXT} end"
    pages = [(i, f"https://h.example/{i}", page(CHROME + ARTICLE + BELOW)) for i in range(5)]
    pages += [(5, None, None), (6, "no host", ""), (7, "https://H.example:80/x", page(f"<div><p>{TEXT}</div>" + BELOW)), (8, "https://o.example", "plain  text"), (8, "https://o.example", "plain  text"), (9, "https://o.example", "<p>never closed " + "<b>" * 3000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r.page_id: r.text for r in html_text.extract_text(df).collect()}
    assert all(got[i] == main for i in range(5))
    assert got[5] == got[6] == "" and got[7] == TEXT and got[8] == "plain text" and got[9] == "never closed"
    assert html_text.extract_text(df).count() == len(pages)
    wide = html_text.extract_text(df, broadcast_hosts=0)
    assert {r.page_id: r.text for r in wide.collect()} == got
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_host_vote_beats_page(spark):
    odd = page(f"<article class='post-9'><p>{TEXT}</p></article><div class='rail'>" + f"<p>{TEXT}, {TEXT}, {TEXT}</p>" * 4 + "</div>")
    pages = [(i, "https://h.example/a", page(ARTICLE)) for i in range(3)] + [(3, "https://h.example/b", odd)]
    got = html_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).where("page_id = 3").first()
    assert got.text == TEXT


@pytest.mark.parametrize(
    "body, want",
    [
        (f"<article><div class='entry-header'><h1>Head</h1></div><p>{TEXT}</p></article>", f"Head {TEXT}"),
        (f"<div class='post'><div class='entry-header'><h1>Head</h1></div><p>{TEXT}</p></div>", f"Head {TEXT}"),
        (f"<main><h1>Head</h1><div class='body'><p>{TEXT}</p></div></main>", f"Head {TEXT}"),
        (f"<article><h2 class='section-header'>Part</h2><p>{TEXT}</p><section id='discussion'><p>{TEXT}</p></section></article>", f"Part {TEXT} {TEXT}"),
        (f"<article><p>{TEXT}</p><figure><img src=x><figcaption>A figure</figcaption></figure><label>Name</label></article>", f"{TEXT} A figure Name"),
        (f"<article><p>{TEXT}</p><div class='discussion'>said</div><div class='header-ad'>buy</div><div class='share'>on</div></article>", TEXT),
        (f"<div class='site-header'>Site and all that belongs to it</div><div><p>{TEXT}</p></div>", TEXT),
        (f'<article><p>{TEXT} <a href="x>link more</a></p></article>', f"{TEXT} link more"),
        (f"<article><p title=it's>{TEXT}</p><p title='a > b'>x < y</p></article>", f"{TEXT} x < y"),
        (f"<article><p>{TEXT} a<span hidden>no</span>b</p></article>", f"{TEXT} ab"),
        (f"<article><svg><text>no</text></svg><p>{TEXT}</p><svg><p>left open</p></article>", f"{TEXT} left open"),
        ("<div><p>One</p><p>Two</p></div><nav>Menu</nav>", "One Two"),
        (f"<article><p>{TEXT}</p><!-- never closed <p>x</p></article>", TEXT),
    ],
)
def test_html_parts(body, want):
    assert html_text.page_text(page(body), None) == want


@pytest.mark.parametrize("piece", ['<div class="a', "<a ", "<div>", "</x>", "<b>", "<i><div><b>", "<div></i>", "<p a='", "<svg>", "<!--", "<li><ul>", "=' ", "<a b=\"c' d="])
def test_html_hostile(piece):
    def seconds(n):
        began = time.process_time()
        assert html_text.page_text("<p>hello " + piece * n, None).startswith("hello")
        return time.process_time() - began

    assert seconds(100_000) < 16 * seconds(12_500) + 1  # eight times the page


def test_html_long_names_and_deep_paths():
    def votes(name):
        return html_text.page_votes(page("<div>" * 20 + f"<div class='{name}'><p>{TEXT}</p>"))

    assert votes("a b c " + "d" * 50 + "x") != votes("a b c " + "d" * 50 + "y") and votes("post-1 b") == votes("b post-27")
    deep = [html_text.page_votes(page(f"<div class='{c}'>" + "<div>" * 12 + f"<p>{TEXT}</p>")) for c in "xy"]
    assert deep[0] != deep[1]


@pytest.mark.parametrize("seed", range(30))
def test_html_generated(seed):
    """Pages built from a list of blocks, of which those of the article are known."""
    pick = random.Random(seed)
    words = lambda: " ".join(pick.choice(["word", "x &amp; y", "é&#233;", "a<b>b</b>c", "two,\n three", "1 &lt; 2"]) for _ in range(pick.randint(20, 60)))
    plain = lambda x: " ".join(html.unescape(x.replace("<b>", "").replace("</b>", "")).split())
    around = ["<nav><ul><li><a href='/'>Menu</a></ul></nav>", f"<div class='ad-{seed}'>{words()}</div>", f"<aside>{words()}</aside>", "<form><p>Send</form>", "<script>if (a<b) '</p>'</script>", f"<!-- {words()} -->", "<div role='alert'>Hear</div>", f"<section class='comments'><p>{words()}</p></section>"]
    blocks = [(pick.choice(["<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<ul><li>{}</ul>", "<blockquote><p>{}</blockquote>", "<pre>{}</pre>", "<div class='part'><p>{}</p></div>"]), words()) for _ in range(pick.randint(2, 8))]
    inside = "".join(b.format(w) + pick.choice(["", *around]) for b, w in blocks)
    chrome = lambda: "".join(pick.sample(around, 4))
    got = html_text.page_text(page(f"{chrome()}<article><h1>Title</h1>{inside}</article>{chrome()}<footer>{words()}</footer>"), html_text.page_votes(page("<article><p>" + TEXT)))
    assert got == " ".join(["Title", *(plain(w) for _, w in blocks)])


CHATS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi <|end|>\n<|turn|>x \\<| \\\\"), (1, 2, "assistant", "</s>[INST] ok [/INST] \\"),
    (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "assistant", "é😀 <<SYS>> [/SYSTEM_PROMPT] <"),
    (2, 0, "user", "same"), (2, 0, "user", "same"), (3, 1, "assistant", "late"), (3, None, None, "no role"), (None, 0, "assistant", "x"), (4, 0, "od\nd<|text|>\\", "t"),
]
CHAT = "conv_id long, turn long, role string, text string"


def brute_chat(rows):
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns, loss = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine), "".join(r[3] or "" for r in mine if r[2] == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(mine), sha(turns), len(loss), sha(loss))
    return out


def test_chat_round_trip(spark):
    df = spark.createDataFrame(CHATS, CHAT).withColumn("formatted", F.lit(1))
    formatted = chat_format.chat_format(df)
    read = chat_format.read_back(formatted)
    got = {r.conv_id: tuple(r)[1:5] for r in chat_format.digests(read).collect()}
    assert got == brute_chat(CHATS)
    for r in read.collect():
        body = r.formatted[len(chat_format.TURN) : -len(chat_format.END)]
        assert body.count("<|") == 1 and not re.search(r"</s>|\[/?INST\]|<</?SYS>>", body)
    assert chat_format.digests(chat_format.read_back(chat_format.chat_format(df.limit(0)))).count() == 0


def test_chat_parts(spark):
    parts = "array<struct<type:string,text:string,uri:string,width:long,height:long,seconds:double,pages:long>>"
    row = [("text", "a<|b", None, None, None, None, None), ("image", None, "u1", 56, 29, None, None), ("audio", None, "u2", None, None, 1.5, None),
           ("text", "tail", None, None, None, None, None), ("document", None, "u3", None, None, None, 3), (None, "plain", None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "assistant", row), (1, 1, "user", None)], f"conv_id long, turn long, role string, p {parts}")
    one, two = chat_format.read_back(chat_format.chat_format(df, text=None, parts="p")).orderBy("turn").collect()
    assert one.formatted == "<|turn|>assistant<|text|>a<\\|b<|image:1|><|audio:2|>tail<|document:4|>plain<|end|>\n"
    assert [(a.kind, a.uri, a.part, a.tokens) for a in one.attachments] == [("image", "u1", 1, 4), ("audio", "u2", 2, 38), ("document", "u3", 4, 768)]
    assert (one.expanded_tokens, one.loss_text, two.text, two.attachments) == (810, "a<|btailplain", "", [])


def test_license_rules(spark):
    mit = ". ".join(license_rules.SENTENCES[k] for k in ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")) + "."
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    texts = [
        (1, f"Intro. {mit} End"), (2, "Licensed under the Apache License, Version 2.0.\nx\nReleased under the MIT License."), (3, None), (4, ""),
        (5, "licence talk without any known sentence"), (6, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."), (7, bsd), (7, bsd),
    ]
    df = spark.createDataFrame(texts, "i int, text string").withColumn("licence", F.lit(0))
    got = {r.i: r.licence for r in license_rules.license_rules(df).collect()}
    assert got[1].matched == ["MIT"] and got[1].left == []
    assert got[2].sequence == ["apache-notice", "mit-released"] and got[2].matched == ["MIT", "Apache-2.0"]
    assert got[3].sequence == got[4].matched == got[5].sequence == []
    assert got[6].sequence == ["cc-by-nc"] * 2 and got[6].matched == ["CC-BY-NC-4.0"]
    assert license_rules.license_rules(df.limit(0)).count() == 0


def test_license_rules_wrapped(spark):
    import textwrap

    apache = """Copyright 2020 Someone
    Licensed under the Apache License, Version 2.0 (the "License");
    you may not use this file except in compliance with the License.
    You may obtain a copy of the License at

        http://www.apache.org/licenses/LICENSE-2.0

    Unless required by applicable law or agreed to in writing, software
    distributed under the License is distributed on an "AS IS" BASIS,
    WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
    See the License for the specific language governing permissions and
    limitations under the License."""
    gpl = """This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY. See the GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>."""
    join = lambda keys, sep: sep.join(textwrap.fill(license_rules.SENTENCES[k], 72) + "." for k in keys)
    mit = join(("mit-grant", "mit-notice", "mit-as-is", "mit-liability"), "\n\n").replace("\n", "\r\n")
    bsd = "All rights reserved.\n\n" + join(("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), "\n\n * ")
    comment = "\n".join(" * " + x.strip() for x in apache.split("\n"))
    near = "xx permission is hereby granted\nReleased under the\nMIT License of old"
    rows = [apache, comment, "# " + gpl.replace("\n", "\n# "), mit, bsd, near, "a | licence\n\nis this the\n\nLicensed under\nCC BY 4.0"]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, text string")
    got = {r.i: r.licence for r in license_rules.license_rules(df).collect()}
    assert got[0].matched == got[1].matched == ["Apache-2.0"] and len(got[0].sequence) == len(got[1].sequence) == 5
    assert got[2].matched == ["GPL-3.0-or-later"] and got[2].sequence == ["gpl-free", "gpl-hope", "gpl-copy"]
    assert got[3].matched == ["MIT"] and got[3].left == []
    assert got[4].matched == ["BSD-3-Clause", "LicenseRef-all-rights-reserved"] and got[4].left == []
    assert got[5].sequence == [] and got[6].matched == ["CC-BY-4.0"]
    tags = spark.createDataFrame([("// SPDX-License-Identifier: MIT\nint x;",), ("# SPDX-License-Identifier: GPL-2.0-or-later",), ("SPDX-License-Identifier: MIT OR Other",)], "text string")
    assert [r.licence.matched for r in license_rules.license_rules(tags).collect()] == [["MIT"], ["GPL-2.0-or-later"], []]


def test_license_oracle(spark, tmp_path):
    import duckdb

    from stepforge.llm.queries import op8_license_rules

    join = lambda keys: "\n  ".join(license_rules.SENTENCES[k].replace(" of ", "\n * of ") + "." for k in keys)
    texts = [join(("mit-grant", "mit-notice")), join(("bsd-grant", "bsd-source", "bsd-binary")), "SPDX-License-Identifier: MIT", "released under the mit license. All rights reserved", None, "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = sorted(map(tuple, op8_license_rules(spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(license_rules.oracle_sql()).fetchall())
    assert [r[3] for r in got] == ["MIT", "BSD-2-Clause", "MIT", "MIT LicenseRef-all-rights-reserved", "", ""]


def test_license_rules_order(spark):
    known, rules = {"a": "licence a", "b": "licence b"}, (("AB", ("a", "b")), ("A", ("a",)))
    df = spark.createDataFrame([(1, "Licence A. other. Licence B. Licence A"), (2, "licence b; licence a! licence b")], "i int, text string")
    got = {r.i: r.licence for r in license_rules.license_rules(df, sentences=known, rules=rules).collect()}
    assert (got[1].matched, got[1].left) == (["AB", "A"], []) and (got[2].matched, got[2].left) == (["AB"], ["b"])
