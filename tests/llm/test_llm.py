"""Top-n, token ids, splitting and leaks against plain versions, with their odd inputs."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalith.llm import leaks, split, tokens
from catalith.llm.topn import top_n
from catalith.operators import skew

ODD = ["", None, " ", "\n\n", "<|endoftext|> x", "a" * 5000, " " * 4500 + "x", "x" + "\n" * 3000, "漢字かな" * 300, "é​\U0001f468‍\U0001f4bb", "\x00\x01\r\n\t", "ab　" * 900, "it's we'll", "1234567890" * 40]


@pytest.mark.parametrize("hot,most", [(10_000, 500_000), (20, 500_000), (20, 0)])
def test_top_n(spark, rows, hot, most, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", most)
    rng = random.Random(hot)
    data = [(rng.choice([1] * 6 + [2, 3, None]), n, rng.choice(["a", "b", None]), bytes([rng.choice([1, 127, 128, 255])]) * rng.randrange(1, 3)) for n in range(400)]
    data += data[:60] + [(7, 1000, "a", b"x")]
    df = spark.createDataFrame([(*d, 5) for d in data], "g int, id int, v string, k binary, place int")
    order = [F.desc("k"), F.asc_nulls_last("v"), F.asc("id")]
    got = rows(top_n(df.select("g", "id", "v", "k"), "g", ["id"], order, 5, hot_rows=hot))
    want = []
    for g in (1, 2, 3, 7):
        own = sorted({d[1:] for d in data if d[0] == g}, key=lambda d: ([255 - b for b in d[2]] + [256] * (2 - len(d[2])), d[1] is None, d[1] or "", d[0]))
        want += [(g, p, d[0]) for p, d in enumerate(own[:5], 1)]
    assert got == sorted(want, key=str)
    assert rows(top_n(df.limit(0).select("g", "id", "v", "k"), "g", ["id"], order, 5)) == []


def test_top_n_cuts_before_the_shuffle(spark):
    df = spark.createDataFrame([(n % 3, n) for n in range(30)], "g int, id int")
    plan = top_n(df, "g", ["id"], [F.desc("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert "dense_rank(id" in plan and plan.index("Final") < plan.rindex("Exchange") < plan.rindex("Partial")


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.Vocabulary.load()


def test_ids(spark, vocabulary):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.json"))
    other.encode_special_tokens = True
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    ids = {r.doc_id: r.ids for r in tokens.encode_corpus(df, "doc_id", "text", vocabulary).collect()}
    assert ids == {k: other.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(ODD)}
    back = tokens.decode_corpus(tokens.encode_corpus(df, "doc_id", "text", vocabulary), "doc_id", "ids", vocabulary)
    assert {r.doc_id: r.text for r in back.collect()} == {k: t or "" for k, t in enumerate(ODD)}
    half = spark.createDataFrame([(1, vocabulary.encode("漢")[:1]), (2, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: (r.data, r.text) for r in tokens.decode_corpus(half, "doc_id", "ids", vocabulary).collect()}
    assert got[1][1] is None and len(got[1][0]) > 0 and got[2] == (None, None)
    assert tokens.encode_corpus(df.limit(0), "doc_id", "text", vocabulary).collect() == []


def test_long_texts_are_cut_safely(vocabulary):
    rng = random.Random(5)
    bits = ["word", "it's", " ", "\n", "  \n ", "漢字。", "12", ".", "　", "é", "'ll", "_", "-", "x́", "\t"]
    text = "".join(rng.choice(bits) for _ in range(6000))
    whole = vocabulary.built[0].encode_ordinary(text)
    assert [i for p in tokens.safe_pieces(text, 300) for i in vocabulary.built[0].encode_ordinary(p)] == whole
    assert "".join(tokens.safe_pieces(text, 300)) == text and len(list(tokens.safe_pieces(text, 300))) > 5
    long = text * 20
    assert len(long) > tokens.LONG_TEXT and vocabulary.decode_bytes(vocabulary.encode(long)).decode() == long


@pytest.mark.parametrize("limit,overlap", [(512, 64), (40, 8)])
def test_pieces(spark, vocabulary, limit, overlap):
    rng = random.Random(limit)
    texts = [*ODD, *("".join(rng.choice(["word ", "Some thing. ", "line\n", "para\n\n", "漢字。", "x" * 50]) for _ in range(n)) for n in (30, 200, 900, 3000)), "漢字" * 2000, "z" * 9000]
    df = spark.createDataFrame([*enumerate(texts), *enumerate(texts[:3])], "doc_id long, text string").withColumn("piece", F.lit(9))
    got = {}
    for r in split.split_corpus(df, "doc_id", "text", vocabulary, limit=limit, overlap=overlap).orderBy("doc_id", "piece").collect():
        got.setdefault(r.doc_id, {})[r.piece] = r
    assert set(got) == set(range(len(texts)))
    for k, text in enumerate(texts):
        ids, pieces = vocabulary.encode(text), [got[k][p] for p in range(len(got[k]))]
        assert (len(pieces) > 1) == (len(ids) > limit) and all(p.n_tokens <= limit for p in pieces)
        at = 0
        for p in pieces:
            assert p.first_token == max(0, at - overlap if p.piece else 0) and p.text == vocabulary.decode_bytes(ids[p.first_token : p.first_token + p.n_tokens]).decode(errors="replace")
            assert p.ids == ids[p.first_token : p.first_token + p.n_tokens]
            at = p.first_token + p.n_tokens
        assert at == len(ids)
    words = [p for k, t in enumerate(texts) if t and " " in t and "\n" in t and len(t) > 5000 for p in got[k].values()]
    assert limit < 512 or all(p.cut >= split.WORD for p in words)


def test_cut_strengths(vocabulary):
    text = "One two. Three\nfour\n\nfive 漢。字"
    ids = vocabulary.encode(text)
    starts = np.concatenate([[0], np.cumsum(vocabulary.lengths(np.array(ids)))[:-1]])
    named = dict(zip([vocabulary.decode_bytes([i]) for i in ids], split.cut_strengths(np.frombuffer(text.encode(), np.uint8), starts).tolist()))
    assert (named[b" two"], named[b" Three"], named[b"four"], named[b"five"]) == (split.WORD, split.SENTENCE, split.LINE, split.PARAGRAPH)


# ---------------------------------------------------------------- leaks


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return row[-1]


def carries(doc, item):
    if not item:
        return False
    runs = {tuple(item[k : k + 12]) for k in range(len(item) - 11)}
    if any(tuple(doc[k : k + 12]) in runs for k in range(len(doc) - 11)):
        return True
    size = len(item) * 3 // 2
    return any(5 * lcs(doc[s : s + size], item) >= 3 * len(item) for s in range(max(1, len(doc) - size + 1)))


def test_leaks_against_brute_force(spark, rows):
    rng = random.Random(11)
    vocabulary = [f"w{n}" for n in range(25)]
    items = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 14, 20, 70, 90]))] for _ in range(14)]
    docs = []
    for _ in range(70):
        item, noise = rng.choice(items), lambda n: [rng.choice(vocabulary + ["other"] * 25) for _ in range(n)]
        kept = [w for w in item if rng.random() < rng.choice([0.5, 0.6, 0.7, 0.9])]
        mixed = [x for w in kept for x in [w, *noise(rng.random() < rng.choice([0.1, 0.5, 0.9]))]]
        a = rng.randrange(len(item))
        docs.append([*noise(rng.randrange(40)), *rng.choice([mixed, item[a : a + rng.choice([11, 12, 13])], item[::-1]]), *noise(rng.randrange(40))])
    docs += [[], ["w1"]]
    df = spark.createDataFrame([*((k, " ".join(d)) for k, d in enumerate(docs)), (500, None), (0, " ".join(docs[0]))], "doc_id long, text string").repartition(3)
    held = spark.createDataFrame([*((k, ", ".join(w)) for k, w in enumerate(items)), (90, None), (91, " "), (0, ", ".join(items[0]))], "item_id long, text string")
    want = sorted(((k, n) for k, d in enumerate(docs) for n, w in enumerate(items) if carries(d, w)), key=str)
    assert rows(leaks.find_leaks(df, held)) == want and len(want) > 30
    assert rows(leaks.find_leaks(df, held, item_chars=400)) == want
    assert rows(leaks.find_leaks(df.limit(0), held)) == [] and rows(leaks.find_leaks(df, held.limit(0))) == []


def test_words_as_a_reader_sees_them():
    plain = "each path with a static link starts near owner plugin before the cold mirror hides"
    words = [w.encode() for w in plain.split()]
    wide = "".join(chr(ord(c) + 0xFEE0) if c != " " else "　" for c in plain)
    disguises = [
        plain.upper(), plain.replace("static", "<b>static</b>").replace(" link", "&nbsp;<i>link</i>"), wide, plain.replace("path", "pa­th").replace("owner", "ow​ner"),
        plain.replace("static", "sta-\r\n> tic").replace("mirror", "mir-\nror"), plain.replace("e", "е").replace("a", "а"), plain.replace(" ", "\\n"), plain.replace(" ", "%20"),
        plain.replace(" ", "\n> "), "\x1b[31m" + plain.replace(" with", "\x1b[0m with"), plain.replace("each", "\\u0065ach"), plain.replace("e", "&#101;"), "| " + plain.replace(" ", " | ") + " |",
        plain.replace("path", "pa﻿th\x01"), "<p>" + plain + "</p><p></p>", "**" + plain.replace(" ", "** `"),
    ]
    for text in disguises:
        assert leaks.reader_words([text]) == words, text
    assert leaks.reader_words(["a", None, "b\x1ec \\u001e d"]) == [b"a", b"\x1e", b"\x1e", b"b", b"c", b"d"]
    assert leaks.reader_words(["Café"]) == leaks.reader_words(["CAFÉ"])


def test_percent_escapes_name_no_separator(spark, rows):
    passage = "each path with a static link starts near owner plugin before the cold mirror hides"
    for text in ("b %1E d", "b%1ed", "b?%20%1E&d", "b &#30; %c3%a9%1E d"):
        assert b"\x1e" not in b"".join(leaks.reader_words([text])) and leaks.reader_words(["a", text, "e"]).count(b"\x1e") == 2, text
    assert leaks.reader_words(["a", "b%1Ed %25", "e"]) == [b"a", b"\x1e", b"b", b"d", b"\x1e", b"e"]
    docs = [(1, "?q=%1E&x"), (2, passage), (3, passage.replace(" link ", " %1E link ")), (4, "none of it ?q=%1e&x")]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    held = spark.createDataFrame([(6, "nothing like it ?p=%1E&y"), (7, passage)], "item_id long, text string")
    assert rows(leaks.find_leaks(df, held)) == [(2, 7), (3, 7)]


def test_every_length_has_a_bound(monkeypatch):
    monkeypatch.setattr(leaks, "DENSE", 0)
    held = leaks.Items([(n, " ".join(f"w{k}" for k in range(n))) for n in range(1, 700)])
    assert (held.bound >= 1).all() and held.reach.max() <= 12


def made(rng, words, sizes, n_items, n_docs):
    """Documents and items whose words often repeat, and documents that hold items changed about as far as the limit."""
    items = [[rng.choice(words) for _ in range(rng.choice(sizes))] for _ in range(n_items)]
    docs = [[rng.choice(words + ["other"] * 60) for _ in range(rng.randrange(150))] for _ in range(n_docs)]
    for d in docs[::2]:
        at, share, more = rng.randrange(len(d) + 1), rng.choice([0.6, 0.65, 0.8, 1]), rng.choice([0.2, 0.5, 0.9, 1.5])
        d[at:at] = [x for w in rng.choice(items) if rng.random() < share for x in [w, "y"][: 1 + (rng.random() < more)]]
    return items, docs


def test_leaks_in_slices_of_any_size(monkeypatch):
    rng = random.Random(7)
    for words, sizes in ((40, (1, 2, 3, 4, 5, 9, 30, 75)), (6, (3, 5, 7, 10, 20)), (400, (8, 10, 13, 40, 130))):
        items, docs = made(rng, [f"w{n}" for n in range(words)], sizes, 16, 40)
        items.append(items[0])
        texts = [" ".join(d) for d in docs]
        want = sorted((k, n) for k, d in enumerate(docs) for n, w in enumerate(items) if carries(d, w))
        for cells, part, dense in ((1, 50, 0), (500, 90, 0), (leaks.CELLS, leaks.SLICE, 0), (1, 50, leaks.DENSE), (500, 90, leaks.DENSE), (leaks.CELLS, leaks.SLICE, leaks.DENSE)):
            monkeypatch.setattr(leaks, "DENSE", dense)
            held = leaks.Items([(n, " ".join(w)) for n, w in enumerate(items)])
            monkeypatch.setattr(leaks, "CELLS", cells)
            monkeypatch.setattr(leaks, "SLICE", part)
            assert sorted((k, int(held.ids[n])) for k, n in leaks.leaks_of(texts, held)) == want and len(want) > 5, (words, cells)
        monkeypatch.undo()


def test_many_items_and_a_very_long_text():
    """A hundred thousand items, some of two thousand words, many with one instruction line, and a text of ten million characters: 1 GB is enough."""
    import subprocess
    import sys

    program = """
import random, resource
from catalith.llm import leaks
rng = random.Random(1)
words = [f"w{n}" for n in range(60_000)]
line = "read the text below and answer the question that follows it in one word"
def item(n):
    size = rng.choice([3, 8, 20, 20, 40]) if n % 5000 else 2000
    return " ".join(([line] if n % 10 == 0 else []) + rng.choices(words, k=size))
items = [(n, item(n)) for n in range(100_000)]
held = leaks.Items(items)
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
parts, want, size = [], set(), 0
while size < 10_000_000:
    part = " ".join(rng.choices(words, k=2000))
    if len(parts) % 40 == 7:
        n = rng.randrange(100_000)
        own = items[n][1].split()
        part += " " + " ".join(w for k, w in enumerate(own) if k % 4 != 1)  # three quarters of the item
        want.add(n)
    parts.append(part)
    size += len(part) + 1
got = {int(held.ids[k]) for _, k in leaks.leaks_of([" ".join(parts), line], held)}
lined = {n for n in range(0, 100_000, 10)}
assert want <= got and {n for n, t in items if t.startswith(line)} == lined <= got, (len(want - got), len(lined - got))
print(len(got), base // 1024, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    done = subprocess.run([sys.executable, "-c", program], capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split()[-1]) < 1024, done.stdout
