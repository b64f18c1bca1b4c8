"""Spelling variants, conversation trie and quality scores against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rangeloom.llm import classifier, prefix_trie, spelling
from rangeloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def words_of(rows):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            total[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    n = words_of(rows)
    near = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and one_apart(v, w)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    root = lambda w: w if form[w] is None else root(form[w])
    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def spelled(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_variants(spark, edge, nothing):
    rng = random.Random(11)
    base = ["maison", "maisons", "aaaaa", "aaaab", "aaaa", "aaaaaa", "élève", "éleve", "über×y", "x" * 300, "x" * 299, "x" * 299 + "é", "colour", "color", "colours", "zzzzz", "日本abcde"]
    typo = lambda w: w[: (k := rng.randrange(len(w)))] + rng.choice(["", "a", "é", "x"]) + w[k + rng.choice([0, 1]) :]
    pool = base + [typo(rng.choice(base)) for _ in range(80)]
    rows = [(i if i % 9 else None, " ".join(rng.choice(pool).title() if rng.random() < 0.2 else rng.choice(pool) for _ in range(60)) + "-" + "ŒabcdefÐ") for i in range(60)]
    docs = spark.createDataFrame([*rows, (7, None), (8, ""), rows[3], rows[3]], "doc_id long, text string")
    got = spelled(spelling.variants(docs))
    assert got == plain_variants([tuple(r) for r in docs.collect()])
    assert sum(f is not None for f, *_ in got.values()) > 20
    assert spelled(spelling.variants(edge)) == plain_variants([(r.doc_id, r.text) for r in edge.collect()])
    assert spelling.variants(nothing).count() == 0


def test_variants_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    n = words_of(rows)
    got = spelled(QUERIES["op11_spelling_variants"](spark, SF))
    assert {w: r[2] for w, r in got.items()} == n
    some = {w: r for w, r in got.items() if zlib.crc32(w.encode()) % 40 == 0}
    for w, r in some.items():
        near = [v for v in n if v != w and abs(len(v) - len(w)) < 2 and one_apart(v, w)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        assert r[3] == len(near) and r[0] == (best if best and n[best] >= 2 * n[w] else None)


def test_runs_split_at_other_letters():
    for t in ["naïve Łódź ÀÿĀ×b÷c", "ABC déf日本ghi", "plain Words_here9now\x00x"]:
        want = [re.sub("[A-Z]", lambda m: m[0].lower(), r) for r in re.findall("[A-Za-zÀ-ÿ]+", t)]
        assert [r.decode() for r in spelling.runs(t.encode())] == want


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [(r[3], r[4]) for r in sorted(x)] for c, x in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        full = own.get(base, [])[:h] + turns[h:]
        for d in range(len(full) + 1):
            members[tuple(full[:d])].append(c)
        ends[tuple(full)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        below = [out[k] for k in children[p]]
        saved = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(b[5] for b in below)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out[p] = (min(members[p]), len(p), len(members[p]), len(below), sum(b[4] for b in below) or 1, saved, min(members[p[:-1]]) if p else None, sha)
    return sorted(map(str, out.values()))


def grown(df):
    return sorted(str((r.conv_id, r.depth, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.parent_conv_id, r.ends_sha256)) for r in df.collect())


TURNS = "text string, conv_id long, turn long, role string, depth long, node string, a string"


def test_prefix_trie(spark, monkeypatch):
    rng = random.Random(12)
    say = ["hi", "no", "", None, "long answer " * 5, "é日本"]
    rows = []
    for c in [*range(-130, 330, 1), 10**12]:
        if c % 7:
            for t in range(rng.choice([1, 1, 2, 3, 6, 9])):
                rows.append((rng.choice(say[: 2 + t % 5]), c, rng.choice([t, t, None]), rng.choice(["user", None]), 5, "x", None))
    rows += [(rng.choice(say), 500, t, "user", 1, "y", None) for t in range(400)] + [("a", 501, 3, "user", 1, "y", None)] * 90 + [("lost", None, 1, "user", 1, "z", None)]
    df = spark.createDataFrame(rows, TURNS)
    want = plain_trie([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])
    assert grown(prefix_trie.prefix_trie(df)) == want
    monkeypatch.setattr(prefix_trie, "RANGE_BITS", 1)
    assert grown(prefix_trie.prefix_trie(df)) == want
    assert prefix_trie.prefix_trie(df.filter("conv_id IS NULL")).count() == 0


def test_prefix_trie_of_the_conversations(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert grown(QUERIES["op12_prefix_trie"](spark, SF)) == plain_trie(map(tuple, rows))


@pytest.mark.parametrize("shape", ["chain", "star", "comb", "random"])
def test_contraction(spark, shape):
    rng, n = random.Random(5), 300
    up = {"chain": lambda i: i - 1, "star": lambda i: 0, "comb": lambda i: i - 1 if i % 2 else max(0, i - 2), "random": lambda i: rng.randrange(max(0, i - 4), i)}[shape]
    parent = {i: up(i) if i else None for i in range(n)}
    depth, total = {0: 0}, {i: i * i for i in range(n)}
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
    for i in range(n - 1, 0, -1):
        total[parent[i]] += total[i]
    df = spark.createDataFrame([(i, parent[i], depth[i], i * i) for i in range(n)], "node long, parent long, depth long, v long")
    assert {r.node: r.v for r in prefix_trie.contract(df, ["v"]).collect()} == total


def test_pools_are_the_least_squares_fit():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = rng.integers(0, 5, 12)
        good = np.minimum(n, rng.integers(0, 5, 12)).astype(float)
        if not n.sum():
            continue
        at = np.flatnonzero(n)
        # Largest over starts of the least mean over ends: the classical min-max formula.
        mean = lambda i, j: good[at[i : j + 1]].sum() / n[at[i : j + 1]].sum()
        want = [max(min(mean(i, j) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]
        place, share = classifier.isotonic(n.astype(float), good)
        assert (np.diff(share) >= 0).all() and len(place) == len(set(np.round(want, 9)))


def test_normal_equations_sum_over_any_tasks(spark):
    rng = np.random.default_rng(1)
    x, y = rng.random((500, len(classifier.STATISTICS))).astype(np.float32), rng.integers(0, 2, 500).astype(float)
    df = spark.createDataFrame([([float(v) for v in a], float(b)) for a, b in zip(x, y, strict=True)], "x array<float>, y double")
    f = classifier.Fourier(x.mean(axis=0), x.std(axis=0), 40)
    z = np.hstack([f(x.astype(float)), y[:, None]])
    for tasks in (1, 7):
        assert (classifier.normal_equations(df.repartition(tasks), f, 5) == z.T @ z).all()
    # Products of the features approximate the kernel.
    f = classifier.Fourier(x.mean(axis=0), x.std(axis=0), 8192)
    z, s = f(x[:40].astype(float))[:, :-1], (x[:40] - f.mean) / f.scale
    kernel = np.exp(-((s[:, None] - s[None]) ** 2).sum(axis=2) / (2 * len(f.mean)))
    assert np.abs(2 * z @ z.T / 8192 - kernel).max() < 0.06


def test_quality_scores_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op13_quality_scores"](spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1 for i in got)
    assert all(r.predicted == (r.score >= 0.3) for r in got.values())
    assert np.mean([got[i].predicted == labels[i] for i in held]) > 0.95


def test_quality_scores_do_not_see_held_out_labels(spark, edge, nothing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60, 2)] + [(3, None, 0), (5, 1, 0), (5, 0, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0]
    turned = labels.selectExpr("doc_id", f"CASE WHEN doc_id IN ({','.join(map(str, held))}) THEN 1 - quality ELSE quality END AS quality")
    a, b = (sorted(map(str, classifier.quality_scores(edge, x).collect())) for x in (labels, turned))
    assert a == b and len(a) == edge.count()
    assert {r.score for r in classifier.quality_scores(edge, labels.limit(0)).collect()} == {0.5}
    assert classifier.quality_scores(nothing, labels).count() == 0
    same = labels.withColumn("quality", labels.quality * 0 + 1)
    assert min(r.score for r in classifier.quality_scores(edge, same).collect()) > 0.5
