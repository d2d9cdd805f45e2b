"""Quality rules, mixing, secrets, decontamination and near duplicates against brute force on small tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesmith.llm import decontaminate as D
from tablesmith.llm import graph, mixing, neardup, quality, secrets
from tablesmith.llm.common import mix64, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


# Quality rules


def measured_by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
    inside = {k + j for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


@pytest.mark.parametrize("seed", range(3))
def test_measures(seed):
    rng = random.Random(seed)
    for _ in range(60):
        text = "".join(rng.choice(["a", "b ", "é#", "\n", "\t", "漢 ", " x y z", "|"]) for _ in range(rng.randrange(60)))
        assert quality.measure(text.encode()) == measured_by_hand(text)
    assert quality.measure(None) == (0, 0, 0, 0, 0)


def test_quality_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    found = sorted((r.doc is not None, r.doc or 0, r.n_words, r.kept) for r in quality.score_documents(docs).collect())
    assert len(found) == len(odd_rows)
    want = sorted((i is not None, i or 0, len(WORD.findall(t or ""))) for i, t, _ in odd_rows)
    assert [x[:3] for x in found] == want
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(x[3] for x in found) > 0
    assert quality.filter_documents(docs.limit(0)).count() == 0


def test_boilerplate_lines_go(make_docs):
    rng = random.Random(4)
    own = [prose(rng, 70, 5000) for _ in range(60)]
    frame = "\n".join(["Sign up for our NEWS letter 2024"] + [f"menu item {w}" for w in range(30)])
    rows = [(k, t + "\nsign up for  our news letter 2031", "a") for k, t in enumerate(own)]
    rows += [(100 + k, frame + f"\nodd {k} tail", "a") for k in range(40)]
    rows += [(200, own[0] + "\nsign up for our news letter 2001", "b")]
    kept = {r.doc_id: r.text for r in quality.filter_documents(make_docs(rows)).collect()}
    assert set(kept) == {*range(60), 200}
    assert kept[3] == own[3] and kept[200].endswith("2001")


def test_copies_are_not_boilerplate(make_docs):
    text = "\n".join(prose(random.Random(k), 20, 5000) for k in range(5))
    assert quality.filter_documents(make_docs([(k, text, "a") for k in range(50)])).count() == 50


# Mixing


def level_targets(sizes, weights, total, most):
    open_, target = dict(sizes), {}
    left = total
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * open_[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = most * open_.pop(s)
            left -= target[s]
    return target


def test_mix_meets_targets(make_docs, odd_rows):
    rng = random.Random(1)
    rows = odd_rows + [(k, prose(rng, rng.randrange(200)), rng.choice("abbbbbbbcde")) for k in range(100, 500)]
    docs = make_docs(rows)
    got = mixing.mix_documents(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = level_targets(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    again = mixing.mix_documents(docs.repartition(7)).select("doc_id", "size", "taken")
    assert sorted(map(str, again.collect())) == sorted(str(r) for r in mixing.mix_documents(docs).select("doc_id", "size", "taken").collect())
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_mix_prefers_plain_text(make_docs):
    clean, noisy = "word " * 20, "##$$ %%&& " * 10
    rows = [(k, clean if k % 2 else noisy, "s") for k in range(600)]
    got = mixing.mix_documents(make_docs(rows), mixing.Mix(share=0.5)).filter("taken > 0").collect()
    assert sum(r.doc_id % 2 for r in got) > 0.8 * len(got)


def test_mix_refuses_clashing_names(make_docs):
    with pytest.raises(ValueError, match="rename"):
        mixing.mix_documents(make_docs([(1, "a", "s")]).withColumn("taken", F.lit(1)))


# Secrets


def test_forest_on_look_alikes_that_were_not_in_the_fit(spark, make_docs):
    """Hashes, uuids, slugs, placeholders, pass phrases and keys of other draws: every score is the forest's own."""
    other = secrets.known_findings(each=40, seed=101)
    seen = {x[0] for x in secrets.known_findings()}
    rows = [x for x in other if x[0] not in seen]
    fresh = spark.createDataFrame(rows, "candidate string, before string, after string, label double").repartition(2)
    scanner = secrets.fit(fresh.limit(0))
    got = scanner.score(fresh).select("label", "secret", "score").collect()
    hit = sum(r.secret for r in got if r.label == 1)
    false = sum(r.secret for r in got if r.label == 0)
    assert hit >= 0.95 * sum(r.label for r in got) and hit >= 0.95 * (hit + false), (hit, false, len(got))
    assert len({r.score for r in got}) > 50
    print("look-alikes", len(got), "recall", hit / sum(r.label for r in got), "precision", hit / (hit + false))


def test_secrets_found_and_masked(make_docs, odd_rows):
    rng = random.Random(2)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = list(odd_rows)
    for k in range(40):
        around = prose(rng, 20)
        key = [f'token = "{hexes(40)}"', f"password={hexes(18)}", "AKIA" + "".join(rng.choice("ABCDEFGHIJ234567") for _ in range(16)), str(rng.randrange(10**15, 10**16))][k % 4]
        rows.append((100 + k, f"{around} {key} {around}", "s"))
    docs = make_docs(rows)
    verdict = {r.doc: r.secret for r in secrets.scan(docs).filter("doc >= 100").collect()}
    assert verdict == {100 + k: k % 4 != 3 for k in range(40)}
    masked = secrets.redact(docs)
    assert masked.columns == docs.columns and masked.count() == len(rows)
    changed = {r.doc_id for r in masked.filter(F.col("text").contains("[SECRET]")).collect()}
    assert changed == {100 + k for k in range(40) if k % 4 != 3}
    assert secrets.redact(docs.limit(0)).count() == 0


def test_one_text_has_the_same_verdicts_in_every_table(make_docs):
    rng = random.Random(12)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    uuid = "-".join(hexes(n) for n in (8, 4, 4, 4, 12))
    text = f'{prose(rng, 9)} 1234567890123456 {prose(rng, 9)} {hexes(40)} {prose(rng, 9)} {uuid} {prose(rng, 9)} token = "{hexes(40)}" {prose(rng, 9)}'
    numbers = [(100 + k, f"{prose(rng, 20)} {rng.randrange(10**15, 10**16)} {prose(rng, 9)}", "s") for k in range(300)]
    keys = [(500 + k, f'{prose(rng, 20)} password="{hexes(32)}" {prose(rng, 9)}', "s") for k in range(100)]
    bare = [(1, " ".join(text.split(" token =")[0].split()), "s")]
    for table in (bare, bare + numbers[:7], bare + numbers + keys):
        assert [r.secret for r in secrets.scan(make_docs(table)).filter("doc = 1").orderBy("place").collect()] == [False] * 3
    for table in ([], numbers[:7], keys[:7], numbers + keys):
        got = secrets.scan(make_docs([(1, text, "s")] + table)).filter("doc = 1").orderBy("place").collect()
        assert [r.secret for r in got] == [False, False, False, True]


def test_candidate_places(make_docs):
    text = "x abcdefgh12345678 y 1234567890123456 \x01 z"
    found = secrets.candidates(make_docs([(1, text, "s")]), "doc_id", "text").orderBy("place").collect()
    assert [(r.place, r.candidate, r.before, r.after) for r in found] == [(1, "abcdefgh12345678", "x ", " y "), (2, "1234567890123456", " y ", "   z")]


def test_values_of_credential_names(make_docs):
    secret = ["password=Xk7pQ2vd tail", "a secret=Tr0ub4dor&3x9 b", 'db_password = "m4Lq!w.T9z@p2K#e8" b', 'passphrase = "winter river stone window orange"',
              "password: correct-horse-battery-staple-lamp", '{"password": "hQ7!zzTk2"}', "passwd: 'jK2.sW9@', next"]
    plain = ["password: required", "the secret: everybody knew", "token = None", "password = getpass() b", "no name Xk7pQ2vd.x!y b", "password=<password> b"]
    rows = [(k, f"They walked along the river. {t}", "s") for k, t in enumerate(secret + plain)]
    got = {k: [] for k, _, _ in rows}
    for r in secrets.scan(make_docs(rows)).orderBy("place").collect():
        got[r.doc].append((r.candidate, r.secret))
    want = ["Xk7pQ2vd", "Tr0ub4dor&3x9", "m4Lq!w.T9z@p2K#e8", "winter river stone window orange", "correct-horse-battery-staple-lamp", "hQ7!zzTk2", "jK2.sW9@"]
    assert [got[k] for k in range(len(secret))] == [[(x, True)] for x in want]
    assert not [x for k in range(len(secret), len(rows)) for x in got[k] if x[1]]
    masked = {r.doc_id: r.text for r in secrets.redact(make_docs(rows)).collect()}
    assert masked[2].endswith('db_password = "[SECRET]" b') and masked[6].endswith("passwd: '[SECRET]', next") and masked[9].endswith("token = None")


# Decontamination


def distance_inside(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row = row, [i] + [0] * len(text)
        for j, c in enumerate(text, 1):
            row[j] = min(last[j - 1] + (p != c), last[j] + 1, row[j - 1] + 1)
    return min(row)


def edited(rng, text, n):
    for _ in range(n):
        k = rng.randrange(len(text))
        text = rng.choice([text[:k] + text[k + 1:], text[:k] + "q" + text[k:], text[:k] + "z" + text[k + 1:]])
    return text


def test_search_agrees_with_brute_force():
    rng = random.Random(5)
    items = tuple("".join(rng.choice("abc ") for _ in range(60)).strip().ljust(60, "d") for _ in range(4))
    for trial in range(40):
        item = rng.choice(items)
        text = "".join(rng.choice("abc ") for _ in range(80)) + edited(rng, item, rng.randrange(9)) + "".join(rng.choice("abc ") for _ in range(80))
        found = D.search(text, items, 0.1)
        for k, pattern in enumerate(items):
            best = distance_inside(pattern, text)
            assert (k in found) == (best <= 6)
            if k in found:
                d, a, b = found[k]
                assert d <= 6 and distance_inside(pattern, text[a:b]) <= d


def test_items_of_all_lengths_against_brute_force():
    """Found or not, and the smallest distance, for items of 1 to 200 characters."""
    rng = random.Random(12)
    for trial in range(150):
        size = rng.choice([1, 2, 5, 11, 25, 39, 40, 41, 63, 90, 200])
        item = D.normalised("".join(rng.choice("abcd ") for _ in range(size + 9)))[:size].strip() or "a"
        held = edited(rng, item, rng.choice([0, 0, 1, 2, len(item) // 10])) if trial % 3 else ""
        text = D.normalised(" ".join(["".join(rng.choice("abcd ") for _ in range(60)), held, "".join(rng.choice("abcd ") for _ in range(60)), held if trial % 5 == 0 else ""]))
        found = D.search(text, (item,), 0.1)
        if len(item) < 40:
            edge = lambda k: 0 < k < len(text) and text[k - 1].isalnum() and text[k].isalnum()
            want = any(text.startswith(item, k) and not (edge(k) and item[0].isalnum()) and not (edge(k + len(item)) and item[-1].isalnum()) for k in range(len(text)))
            assert (0 in found) == want and (not want or (found[0][0] == 0 and text[found[0][1]:found[0][2]] == item))
        else:
            best = distance_inside(item, text)
            assert (0 in found) == (best <= len(item) // 10)
            if found:
                d, a, b = found[0]
                assert d == best and distance_inside(item, text[a:b]) == d


def test_short_items_are_leaks_too(spark, make_docs):
    items = spark.createDataFrame([(1, "What is the capital of France?"), (2, "x"), (3, " \n"), (4, "é")], "item_id long, text string")
    docs = make_docs([(1, "He asked: what is  the\ncapital of FRANCE? Paris.", "s"), (2, "somewhat is the capital of france?", "s"), (3, "axe x-ray", "s"), (4, "café é", "s"), (5, "clean text", "s")])
    assert sorted((r.doc, r.item, r.distance) for r in D.find_leaks(docs, items).collect()) == [(1, 1, 0), (3, 2, 0), (4, 4, 0)]
    assert {r.doc_id for r in D.remove_leaks(docs, items).collect()} == {2, 5}


def test_leaks_go(spark, make_docs, odd_rows):
    rng = random.Random(6)
    items = spark.createDataFrame([(k, prose(rng, 40, 10**6)) for k in range(3)] + [(8, None), (9, "short")], "item_id long, text string")
    passage = items.filter("item_id = 1").first().text
    rows = odd_rows + [(50, prose(rng, 100), "s"), (51, prose(rng, 30) + "\n" + edited(rng, passage.upper(), 5).replace(" ", "\n") + " tail", "s"), (52, passage[:60], "s")]
    docs = make_docs(rows)
    assert [(r.doc, r.item) for r in D.find_leaks(docs, items).collect()] == [(51, 1)]
    clean = D.remove_leaks(docs, items)
    assert clean.columns == docs.columns and clean.count() == len(rows) - 1
    assert D.find_leaks(docs, items.limit(0)).count() == 0 and D.find_leaks(docs.limit(0), items).count() == 0
    assert D.find_leaks(docs, items, D.Budget(block_chars=100)).count() == 1


# Near duplicates


@pytest.mark.parametrize("seed, top", [(1, 3), (2, 2000), (3, 60)])
def test_registers_agree_as_often_as_multisets_overlap(seed, top):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, top, 200), rng.integers(0, top, 200)
    b = np.where(rng.random(200) < 0.6, a, b)
    element = mix64(np.arange(200, dtype=np.uint64) + np.uint64(1))
    counts = np.concatenate([a, b])
    live = counts > 0
    values = neardup.bag_minhash(np.concatenate([element, element])[live], np.repeat([0, 1], 200)[live], counts[live], 2, 4096)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((values[0] == values[1]).mean() - want) < 4 * (want * (1 - want) / 4096) ** 0.5 + 0.005


def test_word_hashes():
    texts = [b"", b"a b", b"  a\tb\n", b"b", "é a".encode()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    hashes, owner = word_hashes(data, np.cumsum([0, *map(len, texts)]))
    assert owner.tolist() == [1, 1, 2, 2, 3, 4, 4] and len(set(hashes.tolist())) == 3
    assert hashes[0] == hashes[2] == hashes[6] and hashes[1] == hashes[3] == hashes[4]


def classes_by_hand(rows):
    bags = {}
    for k, (_, t, _) in enumerate(rows):
        w = WORD.findall(t or "")
        if w:
            bags[k] = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(bags)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            both = sum((bags[a] & bags[b]).values())
            if both >= 0.8 * (bags[a].total() + bags[b].total() - both):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(rows[k][0])
    return groups


def test_classes(make_docs, odd_rows):
    rng = random.Random(8)
    rows = list(odd_rows)
    for base in range(3):
        words = prose(rng, 150, 3000).split()
        for copy in range(14):
            changed = list(words)
            for _ in range(copy % 7):
                changed[rng.randrange(len(changed))] = f"new{rng.randrange(10**6)}"
            rows.append((1000 * base + 100 + copy, " ".join(changed), "s"))
    docs = make_docs(rows)
    groups = classes_by_hand(rows)
    want = Counter(min((x for x in ids if x is not None), default=None) for ids in groups.values() for _ in ids)
    got = neardup.classify(docs).collect()
    assert Counter(r.class_id for r in got) == want and sum(r.kept for r in got) == len(groups)
    left = neardup.near_dedup(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert neardup.classify(docs.limit(0)).count() == 0


def near_copies(rng, bases, copies):
    for base in range(bases):
        words = prose(rng, 500, 3000).split()
        for copy in range(copies):
            changed = list(words)
            for _ in range(copy % 5):
                changed[rng.randrange(len(changed))] = f"new{rng.randrange(10**6)}"
            yield 100 * base + copy, " ".join(changed), "s"


def test_members_of_buckets_are_joined_once_a_step(spark, make_docs, monkeypatch):
    """A step reads the members of all buckets a few times, not a dozen, and the driver plans a job for each step, not for each look."""
    plans, kept = [], neardup.saved

    def watched(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return kept(df)

    monkeypatch.setattr(neardup, "saved", watched)
    monkeypatch.setattr(graph, "saved", watched)
    rows = list(near_copies(random.Random(5), 4, 10))
    spark.sparkContext.setJobGroup("near", "near duplicates")
    try:
        got = neardup.classify(make_docs(rows)).collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("near"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert Counter(r.class_id for r in got) == {100 * base: 10 for base in range(4)}
    reads = sum(len(re.findall(r"Relation \[bucket#\d+L,band#\d+,node#\d+L\]", p)) for p in plans)
    assert 0 < reads <= 4 and len(plans) <= 18 and jobs <= 80


@pytest.mark.parametrize("edges, want", [
    ([], None),
    ([(2, 1)], {1: 1, 2: 1}),
    ([(k + 1, k) for k in range(20)] + [(40, 50), (50, 60), (40, 60), (40, 50)], {**dict.fromkeys(range(21), 0), 40: 40, 50: 40, 60: 40}),
])
def test_components(spark, edges, want):
    got = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert want is None and got is None or {r.node: r.component for r in got.collect()} == want
