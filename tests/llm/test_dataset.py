"""Phrases, lines and manifests against plain versions, on odd rows too."""

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesmith.llm import collocations, linededup, manifest
from tablesmith.llm.collocations import Mining
from tablesmith.llm.linededup import Lines


# -- phrases --


def plain_phrases(rows, longest=5, least=100, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, longest + 1):
                for k in range(len(words) - m + 1):
                    counts[lang][tuple(words[k:k + m])] += 1
    out = []
    for lang, f in counts.items():
        found, n = [], total[lang]
        chosen = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        for p, a in chosen.items():
            if any(len(q) > len(p) and b >= a and any(q[k:k + len(p)] == p for k in range(len(q) - len(p) + 1)) for q, b in chosen.items()):
                continue
            score, _, left, right = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n, -score) for k, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def mined(spark, rows, mining):
    docs = spark.createDataFrame([(lang, text, 1, 2) for lang, text in rows], "lang string, text string, f long, phrase long")
    found = collocations.mine(docs.repartition(3), mining).collect()
    return sorted((r["lang"], r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found)


@pytest.mark.parametrize("mining", [Mining(min_count=3), Mining(min_count=3, chunk_bytes=150, stretch_bytes=90, sample_windows=16), Mining(min_count=2, top=5, longest=3, chunk_bytes=64, stretch_bytes=40)])
def test_phrases(spark, make_docs, mining):
    rng = random.Random(5)
    words = ["the", "The", "of", "a\x01b", "a", "élan", " ", "ĀĀ", "x-y", "the the", "new york city hall", "é ", "zz"]
    marks = [" ", "  ", "\t", ", ", ".", "\n", "\x0b", " ", " ", " ", "! "]
    text = lambda n: "".join(rng.choice(words) + rng.choice(marks) for _ in range(n))
    rows = [(rng.choice(["en", "de", None]), text(rng.randrange(0, 60))) for _ in range(60)]
    rows += [("en", None), ("en", ""), ("en", " ., "), (None, "a b a b a b a b"), ("de", text(900)), ("fr", "the of " * 400), ("fr", "the of " * 400)]
    assert mined(spark, rows, mining) == plain_phrases(rows, mining.longest, mining.min_count, mining.top)


def test_no_phrases(spark, make_docs):
    assert mined(spark, [], Mining()) == [] and mined(spark, [("en", None), (None, "one two. three")], Mining()) == []


def test_large_products(spark):
    """Counts of which the products pass 64 bits."""
    n = 10**13
    counts = spark.createDataFrame([("en", "a", 1, n // 2), ("en", "b", 1, n // 3), ("en", "a b", 2, n // 3 - 7), ("en", "", 0, n)], "lang string, phrase string, length int, f long")
    [row] = collocations.joined_counts(counts).collect()
    assert (row.lefts, row.rights, row.extended) == ([n // 2], [n // 3], None)
    score = collocations.scored(collocations.joined_counts(counts).withColumn("n", F.lit(n))).first().score
    assert score == 1000 * (n // 3 - 7) * n // ((n // 2) * (n // 3))


def test_parts_of_a_long_text():
    rng = random.Random(3)
    text = "".join(rng.choice(["ab", "c", "def"]) + rng.choice([" ", " ", ".", "\t"]) for _ in range(3000)).encode()

    def counted(parts):
        total = Counter()
        for data, end in parts:
            vocabulary, ids, counts = collocations.windows(data, 4, end)
            names = vocabulary.to_pylist()
            for row, n in zip(ids, counts):
                total[b"".join(names[k - 1] for k in row if k)] += int(n)
        return total

    assert counted(collocations.parts(text, 100, 4)) == counted([(text, len(text))]) and len(list(collocations.parts(text, 100, 4))) > 50


def test_packs_come_back():
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["x", "yy", "ž", "w" * 300]) for _ in range(rng.randrange(1, 400))).encode() for _ in range(4)]
    made = [collocations.windows(x, 5) for x in texts]
    one = collocations.merged([collocations.pack(*x) for x in made], 5)
    whole = collocations.windows(b"\n".join(texts), 5)
    assert one[0].equals(whole[0]) and np.array_equal(one[1], whole[1]) and np.array_equal(one[2], whole[2])


# -- lines --


def plain_lines(rows, min_chars=20, min_docs=3):
    held, last = Counter(), {}
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                held[k] += 1
                last[k] = max(last.get(k, -2**63), -2**63 if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < min_chars or held[key(x)] < min_docs or last[key(x)] == (-2**63 if doc is None else doc)]
        out.append((doc, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limits", [Lines(), Lines(shard_keys=3), Lines(min_chars=1, min_docs=2, shard_keys=7)])
def test_lines(spark, make_docs, odd_rows, limits):
    rng = random.Random(6)
    pool = [f"line {k} " + "é" * rng.randrange(5, 20) for k in range(40)] + ["LINE 1 in capitals, long enough", "line 1 in capitals, long enough", "short", "", " " * 21, "ß" * 19, "ß" * 20]
    rows = [(i, "\n".join(rng.choice([" ", "", "\t\x0b"]) + rng.choice(pool) + rng.choice(["", "\r", "  "]) for _ in range(rng.randrange(0, 12)))) for i in range(120)]
    rows += [(i, t) for i, t, _ in odd_rows] + [(500, "held by everyone, once or twice\n" * 3)] * 3 + [(None, "held by everyone, once or twice")] * 2
    rows += [(600, "\n".join(pool[k % 40] for k in range(20_000)))]
    docs = spark.createDataFrame([(i, t, "a", 5) for i, t in rows], "doc_id long, text string, n_lines string, document int").repartition(5)
    found = linededup.dedup_lines(docs, limits)
    assert found.columns == ["doc_id", "text", "n_lines", "document", "_n_lines", "n_dropped"]
    got = sorted(((r.doc_id, r._n_lines, r.n_dropped, r.text or "") for r in found.collect()), key=repr)
    assert got == plain_lines(rows, limits.min_chars, limits.min_docs)


def test_no_lines(spark, make_docs):
    assert linededup.dedup_lines(make_docs([])).collect() == []
    [row] = linededup.dedup_lines(make_docs([(1, None, "a")])).collect()
    assert (row.text, row.n_lines, row.n_dropped) == (None, 1, 0)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**64, 40_000, np.uint64).view(linededup.HASH))
    index = linededup.PerfectHash.build(keys)
    again = linededup.PerfectHash.unpacked(*index.packed())
    assert np.array_equal(np.sort(again.numbers(keys)), np.arange(len(keys))) and sum(map(len, index.levels)) < 7 * len(keys)
    same = np.zeros(50, linededup.HASH)
    same["low"] = np.arange(50)  # alike in one half
    assert np.array_equal(np.sort(linededup.PerfectHash.build(same).numbers(same)), np.arange(50))


# -- manifests --


def hashed(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """Root and, for each leaf, its steps."""
    steps, at = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        for leaf, k in enumerate(at):
            other = k ^ 1
            steps[leaf].append("N" if other >= len(leaves) else ("L" if other < k else "R") + leaves[other])
        leaves, at = [hashed(*leaves[k:k + 2]) for k in range(0, len(leaves), 2)], [k // 2 for k in at]
    return leaves[0], steps


def plain_manifest(rows):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    trees = defaultdict(list)
    for row in rows:
        trees[row["lang"]].append((row["doc_id"] is not None, row["doc_id"], hashed(*[field(row[x]) for x in manifest.FIELDS])))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    tops = {lang: plain_tree([x[2] for x in sorted(trees[lang], key=lambda x: (x[0], x[1] or 0, x[2]))]) for lang in order}
    root, upper = plain_tree([tops[lang][0] for lang in order])
    out = []
    for lang, above in zip(order, upper):
        for leaf, below in zip(sorted(trees[lang], key=lambda x: (x[0], x[1] or 0, x[2])), tops[lang][1]):
            out.append((leaf[1], leaf[2], tops[lang][0], root, below + above))
    return sorted(out, key=repr)


@pytest.mark.parametrize("band", [1, 3, manifest.BAND])
def test_manifest(spark, make_docs, odd_rows, band):
    rng = random.Random(8)
    docs = make_docs(odd_rows).withColumn("lang", F.lit(None).cast("string"))
    for lang, n in [("en", 37), ("é", 1), ("", 16), ("de", 2)]:
        docs = docs.unionByName(make_docs([(rng.randrange(10**6), f"text {k}", "s") for k in range(n)], lang=lang))
    docs = docs.withColumn("leaf", F.lit("x")).withColumn("steps", F.lit(1)).repartition(4)
    rows = docs.collect()
    found = manifest.manifest(docs, keep=["size_"], band=band).withColumn("folded", manifest.fold(F.col("leaf"), F.col("steps"))).collect()
    assert sorted(((r.doc, r.leaf, r.subroot, r.root, r.steps) for r in found), key=repr) == plain_manifest(rows)
    assert all(r.folded == r.root and r.size_ == "x" for r in found)


def test_no_manifest(spark, make_docs):
    assert manifest.manifest(make_docs([])).collect() == []
    [row] = manifest.manifest(make_docs([(1, "a", "b")])).collect()
    assert row.leaf == row.subroot == row.root and row.steps == []
