"""Operators 2, 5, 6, 7, 9, 10 and the pipeline on small inputs, against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stepforge.llm import circulant_minhash, cover_tree, lexical_packing, line_dedup, repeated_passages, source_mix
from stepforge.llm.common import Scratch, connected_components, slices
from stepforge.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def joined(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages, short, empty, NULL and long texts."""
    rng = random.Random(5)
    out, base = [], [words(rng, rng.randrange(40, 160)) for _ in range(12)]
    passage = words(rng, 60)
    for i in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5, 20])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        if i % 7 == 0:
            at = rng.randrange(len(w))
            w[at:at] = passage[: rng.choice([49, 50, 60])]
        sep = ["\n" if rng.random() < 0.1 else " " for _ in w]
        out.append("".join(a + b for a, b in zip(w, sep)))
    out += [None, "", " \n ", "one", "one", "Two words", "two WORDS", " ".join(words(rng, 30000, 9))]
    return [(1000 - i, t) for i, t in enumerate(out)]


def frame(spark, rows):
    full = [(i, t, "en", None if i is None else f"s{i % 3}", 0) for i, t in rows]
    return spark.createDataFrame(full, DOCS).withColumns({"component": F.lit("clash"), "size": F.lit("clash"), "rep": F.lit(1)})


def test_connected_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 6000 + i) for i in range(50)]
    want = joined(pairs, {x for p in pairs if p[0] != p[1] for x in p})
    df = spark.createDataFrame([*pairs, (None, 1), (7, None)], "a long, b long")
    assert {r.node: r.component for r in connected_components(df, Scratch(spark)).collect()} == want
    assert connected_components(df.limit(0), Scratch(spark)).count() == 0


def vectors():
    rng = np.random.default_rng(2)
    out = []
    for _ in range(30):
        c = rng.normal(size=8)
        out += [(c + rng.normal(size=8) * rng.choice([0, 0.05, 0.15, 0.3])).tolist() for _ in range(rng.integers(1, 12))]
    out += [out[0]] * 5 + [[2 * x for x in out[1]], None, [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [], [1.0, 2.0], [1e300] * 8, [-0.0, 1.0] + [0.0] * 6, [0.0, 1.0] + [0.0] * 6]
    return list(enumerate(out))


@pytest.mark.parametrize(("cell", "nodes"), [(4096, 1024), (40, 8), (16, 1)])
def test_cover_tree(spark, cell, nodes):
    rows = vectors()
    fine = {i: np.array(v) / np.abs(v).max() for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a, x in fine.items() for b, y in fine.items() if a != b and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.9]
    reach, n = joined(links, [i for i, _ in rows]), defaultdict(int)
    for a, _ in links:
        n[a] += 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit("clash"))
    got = {r.vec_id: tuple(r)[1:] for r in cover_tree.near_vectors(df, cosine=0.9, cell=cell, nodes=nodes).collect()}
    assert got == {i: (n[i], reach[i], reach[i] == i) for i, _ in rows}
    assert cover_tree.near_vectors(df.limit(0)).count() == 0


def shingle_sets(rows, width):
    out = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(width, len(w))
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    return out


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 85, 2048), (5, 80, 2048), (3, 60, 7)])
def test_minhash(spark, texts, width, percent, block):
    sets = shingle_sets(texts, width)
    links = [(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and x and y and 100 * len(x & y) >= percent * len(x | y)]
    reach = joined(links, sets)
    df = frame(spark, [*texts, (None, "gone")])
    got = {r.doc_id: tuple(r)[1:] for r in circulant_minhash.near_duplicates(df, width=width, percent=percent, block=block, rows=4).collect()}
    assert got == {i: (len(s), reach[i], reach[i] == i) for i, s in sets.items()}
    assert circulant_minhash.near_duplicates(df.limit(0)).count() == 0


def test_minhash_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "p q r s t"), (2, "a b c d e"), (3, "p q r s t"), (3, "p q r s t")], "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in circulant_minhash.near_duplicates(df, width=3).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (1, False)}


def test_packing(spark, texts):
    import zlib

    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [*texts, (1, "İstanbul é日本 <|endoftext|> don't ½ K " * 9), (2, "dup"), (2, "dup")]
    out = lexical_packing.lexical_packing(frame(spark, rows), path, window=256, shard_units=50).collect()
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in out:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for i, t in rows[:-2]:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(docs[i], key=lambda r: r.start)
        assert b"".join(p.ids for p in pieces) == ids.tobytes() and all(p.doc_tokens == len(ids) for p in pieces)
        assert all(zlib.crc32(p.ids) == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in pieces)
    assert len(docs[2]) == 2
    for s in seqs.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256 and at & (at - 1) == 0
    assert lexical_packing.lexical_packing(frame(spark, rows).limit(0), path).count() == 0


def test_packing_cuts_words_once():
    path = vocabulary("word_bpe_49k.json")
    tokens, seen = lexical_packing.WordTokens(path), []
    units = tokens.units
    tokens.units = lambda text: seen.append(len(text)) or units(text)
    texts = ["Don't\tsay 'twas, Été 12ab! " * 500, "", " \x0b", "a\x1cb x\xa0y \u4e00\u4e8c <|endoftext|> say " * 300, "x\x85y z", "say"]
    ids, ends = tokens.ids(pa.array(texts), 2, block=100)
    assert sum(seen) < 200  # it was given whole texts
    want = [[*tokens.tokenizer.encode(" ".join(WORD.findall(t)), add_special_tokens=False).ids, 2] for t in texts]
    assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == want
    assert lexical_packing.word_tokens(path) is lexical_packing.word_tokens(path)


def test_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 9, "b", None, "c" * 30, "", "d" * 5])], ["n", "text"])
    assert [x.to_pylist() for x, _ in slices([batch, batch.slice(0, 0)], "n", "text", size=10)] == [[0, 1, 2], [3], [4, 5]]


def test_word_hashes(texts, monkeypatch):
    seen = {}
    for t in ["A\x1cb a\x1cB \x00 \x00\x00 ab ba É é", *(t or "" for _, t in texts)]:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        found = circulant_minhash.word_hashes(t).tolist()
        assert len(found) == len(words) and all(seen.setdefault(w, h) == h for w, h in zip(words, found))
        with monkeypatch.context() as patch:
            patch.setattr(circulant_minhash, "PIECE", 7)
            assert circulant_minhash.word_hashes(t).tolist() == found
    assert len(set(seen.values())) == len(seen)


def test_packing_prefers_neighbours():
    ids = [np.array([1, 2, 3, 50 + k, 60 + k] * 4) for k in (0, 5, 0, 5, 0)]
    shard = lexical_packing.Shard(ids, np.ones(100, np.float32), 20.0)
    filled = next(shard.windows([20] * 5, 60))
    assert [u for u, _, _ in filled] == [0, 2, 4]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, x, k):
    x = list(x)
    for _ in range(k):
        i = rng.randrange(len(x) + 1)
        x[i : i + rng.choice([0, 1])] = rng.choice(["", "a", "ü", "b"])
    return "".join(x)


@pytest.mark.parametrize("t", [0, 1, 2, 3, 4])
def test_bit_parallel_distance(spark, t):
    rng = random.Random(t)
    rows = [("", ""), ("", "a"), ("abc", "")]
    for _ in range(150):
        a = "".join(rng.choice("abü😀") for _ in range(rng.randrange(20)))
        rows.append((a, edited(rng, a, rng.randrange(6))))
    got = spark.createDataFrame(rows, "a string, b string").select(line_dedup.within_edits("a", "b", t)).collect()
    assert [r[0] for r in got] == [distance(a, b) <= t for a, b in rows]


@pytest.mark.parametrize("t", [1, 2])
def test_line_dedup(spark, t):
    rng = random.Random(t)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(8, 50))) for _ in range(40)]
    rows = [(i, "\n".join(edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randrange(6)))) for i in range(80)]
    rows += [(500, None), (501, ""), (502, base[0]), (502, base[0])]
    seen, want = [], {}
    for i, text in rows[:-1]:
        equal = near = 0
        kept = []
        for line in (text or "").split("\n"):
            if len(line) < 12:
                kept.append(line)
            elif line in seen:
                equal += 1
            else:
                close = any(abs(len(line) - len(s)) <= t and distance(line, s) <= t for s in seen)
                near += close
                seen.append(line)
                kept += [] if close else [line]
        want[i] = (len((text or "").split("\n")), equal, near, "\n".join(kept))
    df = frame(spark, [*rows, (None, base[0])])
    got = line_dedup.line_dedup(df, t=t, min_chars=12).collect()
    assert {r.doc_id: (r.n_lines, r.n_equal, r.n_near, r.kept_text) for r in got if r.doc_id is not None} == want
    assert len(got) == len(rows) + 1 and [r.kept_text for r in got if r.doc_id is None] == [base[0]]
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_line_dedup_counts_letters_of_meeting_lines(spark, monkeypatch):
    """Words and letters are taken of lines that share a key with another one alone."""
    for name in ("letter_counts", "word_parities"):
        take = getattr(line_dedup, name)
        monkeypatch.setattr(line_dedup, name, lambda c, take=take: F.when(F.col(c).contains("alone"), F.raise_error(F.lit("needless")).cast("long")).otherwise(take(c)))
    rows = [(1, "a line that comes in two forms\nthis one stands alone here"), (2, "a line that comes in two farms\nthat other line, also alone")]
    got = line_dedup.line_dedup(frame(spark, rows), t=2, min_chars=16, short=True).orderBy("doc_id").collect()
    assert [(r.n_near, r.kept_text) for r in got] == [(0, rows[0][1]), (1, "that other line, also alone")]


@pytest.mark.parametrize("t", [1, 2, 3])
def test_short_lines(spark, t):
    rng = random.Random(10 + t)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(1, 26))) for _ in range(40)] + ["", "  ", "x"]
    rows = [(i, "\n".join(edited(rng, rng.choice(base), rng.choice([0, 0, 1, 1, 2, 3])) for _ in range(rng.randrange(8)))) for i in range(100)]
    seen, want = [], {}
    for i, text in rows:
        equal = near = 0
        kept = []
        for line in text.split("\n"):
            if len(line) < 16 and not line.strip(" "):
                kept.append(line)
            elif line in seen:
                equal += 1
            else:
                close = False
                for s in seen:
                    k = min(t, min(len(line), len(s)) * t // 16)
                    close = close or k > 0 and abs(len(line) - len(s)) <= k and distance(line, s) <= k
                near += close
                seen.append(line)
                kept += [] if close else [line]
        want[i] = (len(text.split("\n")), equal, near, "\n".join(kept))
    got = line_dedup.line_dedup(frame(spark, rows), t=t, min_chars=16, short=True).collect()
    assert {r.doc_id: (r.n_lines, r.n_equal, r.n_near, r.kept_text) for r in got} == want
    assert sum(r.n_near for r in got) and sum(r.n_equal for r in got)


@pytest.mark.parametrize("window", [50, 7])
def test_repeated_passages(spark, texts, window):
    seen, want = set(), {}
    for i, t in sorted(texts):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        own = [tuple(w[k : k + window]) for k in range(len(w) - window + 1)]
        for k, x in enumerate(own):
            if x in seen:
                gone[k : k + window] = [True] * window
        seen.update(own)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    df = frame(spark, [*texts, texts[3], (None, texts[3][1])])
    got = {r.doc_id: tuple(r)[1:4] for r in repeated_passages.remove_repeats(df, window=window).collect()}
    assert got == want and any(v[1] for v in want.values())
    assert repeated_passages.remove_repeats(df.limit(0)).count() == 0


def test_longest_repeats(spark):
    w = [f"u{i}" for i in range(300)]
    rows = [(1, " ".join(w)), (2, " ".join(["a", *w[:210], "b"])), (3, " ".join(["c", *w[100:155]])), (4, "none")]
    got = {r.doc_id: r.longest for r in repeated_passages.longest_repeats(frame(spark, rows)).collect()}
    assert got == {1: 200, 2: 200, 3: 50}


def test_source_mix(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 300)), "en", rng.choice(["a", "b", "b", "b", "c", None, "Z"]), 0) for i in range(400)]
    rows += [(900, None, "en", "a", 0), (901, "one two", "en", "rare", 0), (902, "", "en", "empty", 0), (901, "one two", "en", "rare", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash"))
    got = source_mix.source_mix(df, block_words=64).collect()
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(k for k in size if k is not None) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, target, open_ = 1.5 * sum(size.values()), {}, set(order)
    while True:
        left = total - sum(target.values())
        part = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if part[s] >= 2 * size[s]}
        if not over:
            target |= part
            break
        target |= {s: 2 * size[s] for s in over}
        open_ -= over
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order) and len(got) == len(rows)
    again = source_mix.source_mix(df.repartition(7), block_words=64).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    ordered = source_mix.mixed_documents(df, block_words=64, slot="at").orderBy("at").collect()
    share, done, held = {s: taken[s] / sum(taken.values()) for s in order}, 0, defaultdict(int)
    for r in ordered:  # every prefix of the mix holds the sources in about their shares
        n = len(WORD.findall(r.text))
        done, held[r.source] = done + n, held[r.source] + n
        assert all(abs(held[s] - share[s] * done) <= 6 * 300 for s in order)
    mixed = source_mix.mixed_documents(df, block_words=64)
    by = {(r.doc_id, r.source): r.taken for r in got}
    counts = defaultdict(int)
    for r in mixed.collect():
        counts[(r.doc_id, r.source)] += len(WORD.findall(r.text))
    assert all(counts[k] == v * (2 if k[0] == 901 else 1) for k, v in by.items())
    assert mixed.columns == df.columns
    assert source_mix.source_mix(df.limit(0)).count() == 0 and source_mix.mixed_documents(df.limit(0)).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, kept = Scratch(spark), []
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
        kept.append(docs)
    assert all(k.columns == list(corpus_pipeline.COLUMNS) for k in kept[:-1])
    quality, lines, near, mix, packed = kept
    assert 0 < near.count() <= lines.count() <= quality.count() < 200
    reach = {r.doc_id: r.component_id for r in circulant_minhash.near_duplicates(lines).collect()}
    assert {r.doc_id for r in near.collect()} == set(reach.values())
    n_mix = sum(len(WORD.findall(r.text)) for r in mix.collect())
    n_near = sum(len(WORD.findall(r.text)) for r in near.collect())
    assert abs(n_mix - 1.5 * n_near) <= 20
    tokens = packed.agg(F.sum("length")).first()[0]
    assert tokens == packed.where("start = 0").agg(F.sum("doc_tokens")).first()[0]


def test_pipeline_lines_short(spark):
    import corpus_pipeline

    head = "A heading that stands over every list"
    texts = [f"{head}\nfirst\nlist", f"{head}\nmilk\neggs", f"{head}\nmilk\n ", "milk", "\n", "an own line\nlist"]
    rows = [(i, x, "en", "s", len(x)) for i, x in enumerate(texts)]
    got = corpus_pipeline.lines(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert {r.doc_id: (r.text, r.n_chars) for r in got} == {0: (texts[0], len(texts[0])), 1: ("milk\neggs", 9), 4: ("\n", 1), 5: ("an own line", 11)}


def test_pipeline_lines_ids(spark):
    import corpus_pipeline

    line = "A line that stands in every document"
    rows = [(1, line, "en", "s", 0)] * 3 + [(2, f"{line}\nand its own", None, "t", 0)] * 2 + [(None, line, "de", "u", 0)] * 2 + [(None, None, "fr", "u", 0)]
    got = corpus_pipeline.lines(spark, spark.createDataFrame(rows, DOCS), "").collect()
    want = [(1, line, "en", "s", len(line))] * 3 + [(2, "and its own", None, "t", 11)] * 2
    want += [(None, line, "de", "u", len(line))] * 2 + [(None, "", "fr", "u", 0)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_pipeline_empty(spark):
    import corpus_pipeline

    docs, scratch = spark.createDataFrame([], DOCS), Scratch(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = scratch.write(stage(spark, docs, ""))
    assert docs.count() == 0
