import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stepforge.functions import panel
from stepforge.functions.panel import panel_parse, panel_text, parse_panel

#: Inputs with the text and spans that the rules of panels give.
VECTORS = [
    ('<pre class="source"/>', "", []),
    (
        '<pre class="source"><span class="keyword1">proof</span> (<span class="keyword1">prove</span>)<br/>x</pre>',
        "proof (prove)\nx",
        [(0, 5, "keyword1"), (7, 12, "keyword1"), (0, 15, "source")],
    ),
    ('<b class="p">a<hr class="h">b</b>c</b>', "abc", [(1, 2, "h"), (0, 3, "p")]),
    ('<span class="z"></span>', "", []),
    ("a<br>b<br/>c</br>d", "a\nb\ncd", []),
    ('<script>var t="</p>";k(0);</script>x', 'var t="</p>";k(0);x', []),
    ("a &lt;b&gt; &nbsp;&#8658;&bogus; &amp", "a <b>  ⇒&bogus; &", []),
    ('<span class="k1 k2">q</span>', "q", [(0, 1, "k1 k2")]),
    ("</x>a", "a", []),
    ('unclosed <span class="f">yy', "unclosed yy", []),
    ("<!-- c > d -->z", "z", []),
    ('<i class="a" class="b">x</i>', "x", [(0, 1, "b")]),
    (None, "", []),
    ("", "", []),
]


@pytest.mark.parametrize(("content", "text", "spans"), VECTORS)
def test_vectors(content, text, spans):
    assert parse_panel(content) == (text, spans)


def test_columns(spark):
    df = spark.createDataFrame([(i, v[0]) for i, v in enumerate(VECTORS)], "i int, html string")
    rows = df.select("i", panel_text("html").alias("t"), panel_parse("html").alias("p")).orderBy("i").collect()
    assert [r.t for r in rows] == [v[1] for v in VECTORS]
    assert [[tuple(s) for s in r.p.spans] for r in rows] == [v[2] for v in VECTORS]


def test_portions():
    batches = [pa.array(["ab", None, "c", "defgh", "", "ü"]), pa.array([], pa.string()), pa.array(["i"])[:1], pa.array(["x", "jk", "l", "y"])[1:3]]
    assert list(panel.portions(iter(batches), 3)) == [["ab", None, "c"], ["defgh"], ["", "ü"], ["i"], ["jk", "l"]]


def test_batch_in_portions():
    """A worker gives what it has of a batch before it parses the rest, so memory doesn't grow with the batch."""
    html = "<b class='k'>a</b><!--" + "x" * panel.PORTION + "-->"
    for take, want in ((panel.texts, "a"), (panel.parsed, {"text": "a", "spans": [{"start": 0, "end": 1, "kind": "k"}]})):
        assert [a.to_pylist() for a in take(iter([pa.array([html] * 3 + [None])]))][:3] == [[want]] * 3


def test_many_batches(spark):
    """Rows keep their order where a partition has several batches, of several portions each."""
    html = F.concat(F.lit("<b class='k'>"), F.col("id").cast("string"), F.lit("</b><!--"), F.repeat(F.lit("x"), 100), F.lit("-->"))
    got = spark.range(25_000, numPartitions=1).select("id", panel_text(html).alias("t"), panel_parse(html).alias("p"))
    wrong = got.where("t <> id or p.text <> id or size(p.spans) <> 1 or p.spans[0].end <> length(t)")
    assert got.count() == 25_000 and wrong.count() == 0
