"""Repeated passages, token files, archives, toxicity and languages: brute force, round trips and held-out accuracy."""

import base64
import hashlib
import io
import random

import numpy as np
import pyarrow.fs as pafs
import pytest
import zstandard
from pyspark.sql import functions as F

from tablesmith.llm import langid, suffixes, tokens, toxicity, warc
from tablesmith.session import shared_folder

# Repeated passages


def removed_by_hand(rows, depth):
    first = {}
    for i, raw in rows:
        for k in range(len(raw) - depth + 1):
            w = raw[k:k + depth]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, raw in rows:
        gone = bytearray(len(raw))
        for k in range(len(raw) - depth + 1):
            if first[raw[k:k + depth]] < i:
                gone[k:k + depth] = b"\1" * depth
        out.append((i, len(raw), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("radix", [suffixes.Radix(), suffixes.Radix(depth=12, digit=6, chunk_bytes=300, bucket_entries=50, file_bytes=2000)])
def test_repeats(spark, make_docs, radix):
    rng = random.Random(radix.depth)
    pool = ["".join(rng.choice("ab é") for _ in range(rng.randrange(5, 90))) for _ in range(12)]
    rows = [(k, "".join(rng.choice(pool) for _ in range(rng.randrange(6))) + "q" * rng.randrange(200)) for k in range(60)]
    rows += [(60, None), (61, ""), (5, rows[5][1]), (62, "x" * 500), (63, "x" * 70)]
    docs = make_docs([(i, t, "s") for i, t in rows]).repartition(3)
    found = suffixes.remove_repeats(docs, radix)
    got = found.select("doc", "n_bytes", F.col("n_bytes") - F.length("kept"), F.size("spans"), F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == removed_by_hand([(i, (t or "").encode()) for i, t in rows], radix.depth)
    assert suffixes.remove_repeats(docs.limit(0), radix).count() == 0


# Token files


def test_token_counts(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows).repartition(3)
    folder = tokens.new_folder(spark)
    places = tokens.write_tokens(docs, folder)
    coder = tokens.encoding(tokens.TOKENIZERS, tokens.VOCABULARY)
    want = sorted((i is not None, i or 0, len(coder.encode_ordinary(t or ""))) for i, t, _ in odd_rows)
    for block in (1 << 21, 5000):
        got = tokens.count_tokens(spark, folder, block_tokens=block).join(places, ["file", "ordinal"]).collect()
        assert sorted((r.doc is not None, r.doc or 0, r.n_tokens) for r in got) == want


@pytest.mark.parametrize("ids, want", [([], []), ([9], [0]), ([1, 2, 9, 9, 3], [2, 0, 1]), ([1, 2, 3], [3]), ([9, 9, 9, 9, 5, 5, 5, 5, 5, 9], [0, 0, 0, 0, 5])])
def test_stitching(spark, ids, want):
    folder = tokens.new_folder(spark)
    files, path = pafs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/a.tok") as sink:
        sink.write(np.array(ids, "<u2").tobytes())
    got = tokens.count_tokens(spark, folder, separator=9, block_tokens=3).orderBy("ordinal").collect()
    assert [r.n_tokens for r in got] == want and [r.ordinal for r in got] == list(range(len(want)))


# Archives


def test_archive_round_trip(spark):
    pages = spark.createDataFrame([(3, "http://a/", "same"), (1, None, "same"), (2, "http://b/\r\n", None), (5, "u", ""), (4, "u", "other é"), (None, "u", "same"), (4, "u", "other é"), (9, "u", "x" * 300_000)],
                                  "page_id long, url string, html string").withColumn("raw", F.lit("clash"))
    folder = warc.new_folder(spark)
    assert warc.write_archive(pages, folder) == 8
    got = warc.read_archive(spark, folder).collect()
    sha = lambda x: base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()
    want = [("1", "response", None, "same"), ("2", "response", None, ""), ("3", "revisit", "1", "same"), ("4", "response", None, "other é"), ("4", "response", None, "other é"),
            ("5", "revisit", "2", ""), ("9", "response", None, "x" * 300_000), (None, "revisit", "1", "same")]
    assert sorted((str(r.page), r.kind, r.refers_to, r.payload_bytes, r.payload_digest) for r in got) == sorted((str(p), k, t, len(x.encode()), sha(x)) for p, k, t, x in want)
    assert all((r.payload is None) == (r.kind == "revisit") for r in got)
    assert warc.write_archive(pages.limit(0), warc.new_folder(spark)) == 0


def test_archive_frames():
    records = [warc.record(str(k), "http://x/", f"page {k} ".encode() * 50, "response", None) for k in range(20)]
    sink = io.BytesIO()
    warc.write_file(sink, iter(records))
    raw = sink.getvalue()
    assert list(warc.read_file(io.BytesIO(raw), chunk=37)) == records
    size = int.from_bytes(raw[4:8], "little")
    packed = zstandard.compress(raw[8:8 + size])
    assert list(warc.read_file(io.BytesIO(raw[:4] + len(packed).to_bytes(4, "little") + packed + raw[8 + size:]))) == records
    with pytest.raises(warc.DamagedRecord):
        list(warc.read_file(io.BytesIO(raw[:-5])))
    with pytest.raises(warc.DamagedRecord):
        list(warc.read_file(io.BytesIO(b"no archive")))


@pytest.mark.parametrize("old, new", [(b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: 5", b"Content-Length: 6"), (b"hello", b"hallo"), (b"WARC-Date", b"WARC-Gate")])
def test_damaged_records(old, new):
    good = warc.record("1", "http://x/", b"hello", "response", None)
    assert warc.parse(good)["payload"] == b"hello"
    with pytest.raises(warc.DamagedRecord):
        warc.parse(good.replace(old, new))


# Toxicity and languages


def test_toxicity_held_out(spark):
    rng = random.Random(3)
    bad = ["rottenfool", "vilescum", "dimwitted"]
    rows = []
    for k in range(400):
        words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnr')}{rng.choice('aeiou')}" for _ in range(120)]
        for at in range(0, 120, 15) if k % 2 else []:
            words[at] = rng.choice(bad)
        rows.append((k, " ".join(words), k % 2))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(table.filter("doc_id < 300"))
    odd = spark.createDataFrame([(500, None), (501, ""), (502, "ok")], "doc_id long, text string")
    got = {r.doc: r.score for r in toxicity.score(table.select("doc_id", "text").union(odd), model).collect()}
    assert sum((got[k] >= 0.5) == (k % 2 == 1) for k in range(300, 400)) >= 97
    assert all(0 <= x <= 1 for x in got.values()) and got[500] == got[501]
    assert toxicity.score_text(b"any", toxicity.train(table.limit(0))) == 0.0


def test_cut_covers_text():
    for text in (b"", b"abc", b"a" * 500, b"some words here " * 40):
        assert b"".join(toxicity.cut(text, 60)) == text


def languages(rng, lang, n):
    parts = {"aa": "kalo", "bb": "zivu", "cc": "hеш"}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(3, 8))) for _ in range(n))


def test_languages(spark):
    rng = random.Random(1)
    rows = [(k, languages(rng, x, 40), x) for k, x in enumerate(["aa", "bb", "cc"] * 60)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tests = [(k, languages(rng, x, 12), x) for k, x in enumerate(["aa", "bb", "cc"] * 20)]
    mixed = languages(rng, "aa", 30) + " " + languages(rng, "bb", 20)
    odd = [(900, None, None), (901, "12 ++ 34", None), (902, mixed, None), (903, "", None)]
    got = {r.doc: r for r in langid.identify(spark.createDataFrame(tests + odd, "doc_id long, text string, lang string"), model).collect()}
    assert all(got[k].lang_pred == x for k, _, x in tests)
    assert [got[k].lang_pred for k in (900, 901, 903)] == ["und"] * 3 and got[900].score == 0
    assert [(s.start, s.end, s.lang) for s in got[902].spans] == [(0, 30, "aa"), (30, 50, "bb")] and got[902].lang_pred == "aa"
    assert 0.5 <= got[902].score < 0.7


def test_copies_do_not_crowd_out_other_labelled_texts(spark):
    rng = random.Random(21)
    pool = [" ".join(f"{stem}{rng.choice('abcdef')}{rng.choice('xyz')}" for stem in rng.choices(["stone", "river", "plain", "cloud", "grass"], k=40)) for _ in range(120)]
    rows = [(k, t if k % 2 else f"{t} vile{k % 7} rotten{k % 5} vile{k % 3}", 1 - k % 2, "aabb"[k % 4]) for k, t in enumerate(pool)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, toxic int, lang string")
    ranked = frame(rows).orderBy(F.xxhash64(F.col("text").cast("binary"), F.lit(5))).collect()
    lowest = next(r for r in ranked if r.toxic)
    copied = rows + [(1000 + k, *lowest[1:]) for k in range(60)]
    fit = toxicity.Fit(fit_rows=30, least_neighbours=2)
    alone, crowded = toxicity.train(frame(rows), fit), toxicity.train(frame(copied), fit)
    assert alone.weights and alone == crowded
    common = next(r for r in frame(rows).orderBy(F.pmod(F.xxhash64(F.col("text").cast("binary")), F.lit(1_000_000))).collect())
    settings = langid.Settings(fit_rows=20)
    alone, crowded = (langid.train(frame(x), settings) for x in (rows, rows + [(1000 + k, *common[1:]) for k in range(60)]))
    assert np.array_equal(alone.tables, crowded.tables) and alone.languages == crowded.languages


def test_marks_and_symbols_are_no_letters(spark):
    rng = random.Random(5)
    rows = [(k, languages(rng, x, 40), x) for k, x in enumerate(["aa", "bb"] * 60)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    none = ["12 \u2013 15", "5 \u20ac", "3 \u00d7 4", "\u201c7\u201d", "\U0001f600 8", "6 \u00f7 2", "\u3010 1 \u3011"]
    word = languages(rng, "aa", 1)
    some = ["\u201c" + " \u201c".join(languages(rng, "aa", 9).split()) + "\u201d", "\u201e" + word, "\u4e00"]
    docs = spark.createDataFrame(list(enumerate(none + some)), "doc_id long, text string")
    got = {r.doc: r for r in langid.identify(docs, model).collect()}
    assert [(got[k].lang_pred, got[k].score) for k in range(len(none))] == [("und", 0.0)] * len(none)
    assert [got[len(none) + k].lang_pred for k in range(2)] == ["aa"] * 2 and got[len(none) + 2].lang_pred != "und"


def test_scripts_by_first_letter():
    text = "\u201cabc\u201d \u00d7 \u00bfqu\u00e9? \u201e\u0436\u0443 \u3008\u6f22 \u20ac5 \U00020000 \U0001f600a \u00e9t\u00e9 \ud55c\uae00 \u0391\u03b1 12 \u0e01"
    raw = np.frombuffer(text.encode(), np.uint8)
    _, at, _ = langid.trigrams(raw, np.array([0, len(raw)]))
    want = "latin none latin cyrillic east_asian none east_asian latin latin hangul greek none other".split()
    assert [langid.NAMES[k] for k in langid.word_scripts(raw, at)] == want
    every = "".join(chr(k) for k in range(0x20000) if not 0xD800 <= k < 0xE000)
    raw = np.frombuffer(every.encode(), np.uint8)
    assert (langid.byte_scripts(raw)[(raw & 0xC0) != 0x80] > 0).tolist() == [c.isalpha() for c in every]


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n, k, switch = rng.integers(1, 6), rng.integers(2, 4), rng.uniform(0.2, 4)
        scores = rng.normal(size=(n, k)) * 2
        best = max(sum(scores[t, (p // k**t) % k] for t in range(n)) - switch * sum((p // k**t) % k != (p // k ** (t + 1)) % k for t in range(n - 1)) for p in range(k**n))
        path = langid.viterbi(scores, switch)
        assert abs(scores[np.arange(n), path].sum() - switch * (np.diff(path) != 0).sum() - best) < 1e-9


def test_shared_folder_is_used(spark):
    assert warc.new_folder(spark).startswith(shared_folder(spark))
