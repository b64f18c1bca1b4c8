"""Content operators against brute force on small tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rangeloom.llm import common, gru, langmix, lm, media, quality, simhash, suffixes


def fingerprint(text, words):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def component(fps, ids, bits):
    """Smallest id reachable, by plain search."""
    left, out = set(range(len(fps))), [None] * len(fps)
    while left:
        todo = [left.pop()]
        group = list(todo)
        while todo:
            i = todo.pop()
            near = [j for j in left if (fps[i] ^ fps[j]).bit_count() <= bits]
            left.difference_update(near)
            todo += near
            group += near
        known = [ids[i] for i in group if ids[i] is not None]
        for i in group:
            out[i] = min(known, default=None)
    return out


def test_simhash(edge):
    rows = edge.select("doc_id", "text").collect()
    fps = [fingerprint(r.text, 3) for r in rows]
    want = sorted(map(str, zip((r.doc_id for r in rows), fps, component(fps, [r.doc_id for r in rows], 2), strict=True)))
    got = simhash.near_duplicates(edge, 3, 2).collect()
    assert sorted(str((r.doc_id, r.fp % (1 << 64), r.component_id)) for r in got) == want


@pytest.mark.parametrize(("bits", "hot"), [(2, 4096), (2, 4), (6, 4096), (3, 10)])
def test_gray_index_finds_all_links(spark, bits, hot):
    rng = np.random.default_rng(bits)
    v = [int(rng.integers(1 << 63))] * 60 + [int(rng.integers(1 << 63)) for _ in range(60)]
    for i in range(60):
        for _ in range(i % 9):
            v[i] ^= 1 << int(rng.integers(64))
    v = np.unique(np.array(v, np.uint64))
    idx = simhash.GrayIndex(np.zeros(len(v), np.int64), v)
    pairs = {(int(a), int(b)) for x, y in idx.pairs(bits) for a, b in zip(x, y, strict=True)}
    assert pairs == {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if int(v[i] ^ v[j]).bit_count() <= bits}
    edges = simhash.near_links(spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long"), bits, hot).collect()
    at, f = {int(x): i for i, x in enumerate(v.view(np.int64))}, simhash.Forest(len(v))
    f.link(np.array([at[e.u] for e in edges], np.int64), np.array([at[e.v] for e in edges], np.int64))
    assert f.label.tolist() == component([int(x) for x in v], list(range(len(v))), bits)


def test_gray_neighbours_differ_in_a_bit():
    by_rank = sorted(range(256), key=lambda x: int(simhash.gray_rank(np.array([x], np.uint64))[0]))
    assert all((a ^ b).bit_count() == 1 for a, b in zip(by_rank, by_rank[1:], strict=False))


def test_one_of_each(edge):
    kept = [(r.doc_id, r.text) for r in simhash.one_of_each(edge, 5, 6).collect()]
    rows = edge.select("doc_id", "text").collect()
    groups, _ = shingle_groups([r.text or "" for r in rows])
    # Texts without a shingle are one group, which the brute force keeps apart.
    groups = [-1 if not simhash.shingles((r.text or "").encode(), 5) else g for r, g in zip(rows, groups, strict=True)]
    assert len(set(kept)) == len(kept) == len(set(groups))


def shingle_groups(texts, least=0.8):
    """Group of every text by brute-force Jaccard similarity of five-word shingles, and the number of similar pairs."""
    sets = [set(simhash.shingles(t.encode(), 5)) for t in texts]
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if (k := len(sets[i] & sets[j])) and k >= least * len(sets[i] | sets[j])]
    f = simhash.Forest(len(texts))
    f.link(np.array([i for i, _ in pairs], np.int64), np.array([j for _, j in pairs], np.int64))
    return f.label.tolist(), len(pairs)


def near_copies(families, copies, words, seed=11):
    """Texts with copies in which one to three words in a hundred are others."""
    rng, out = random.Random(seed), []
    for _ in range(families):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice(words))]
        out.append(" ".join(base))
        for _ in range(copies):
            own = list(base)
            for _ in range(max(1, len(base) * rng.randint(1, 3) // 100)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**9)}"
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("families", "copies", "words"), [(60, 4, [50, 80, 200, 600]), (1, 300, [50])])
def test_one_of_each_links_what_is_similar(spark, families, copies, words):
    texts = near_copies(families, copies, words)
    want, pairs = shingle_groups(texts)
    assert pairs > 100
    kept = simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want))


@pytest.mark.parametrize("block", [256, 7])
def test_torn_buckets_lose_no_pair(spark, monkeypatch, block):
    # A template family: similarities lie on both sides of the bound, so leaders alone leave buckets torn.
    rng = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        own = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            own[rng.randrange(120)] = f"x{rng.randrange(40)}"
        texts.append(" ".join(own))
    want, pairs = shingle_groups(texts)
    monkeypatch.setattr(simhash, "LEADERS", 0)
    rows = simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=block).collect()
    groups = defaultdict(set)
    for r in rows:
        groups[r.root].add(r.doc_id)
    assert pairs > 500 and sorted(map(min, groups.values())) == sorted(set(want))


def test_every_training_document_reaches_the_recurrent_weights(spark):
    start = gru.initial(np.array([40, 40, 40]), 1, 1)
    for i in range(4):
        symbols = bytearray(np.array([0, 1, 2] * 40 + [gru.END], "<i2").tobytes())
        texts = spark.createDataFrame([(0, 0, i, False, symbols)], "block long, at int, doc_id long, held boolean, symbols binary")
        model = lm.fit(texts, start, 121)
        assert not np.array_equal(model["wo"], start["wo"])


def test_components_of_a_chain(spark):
    rows = simhash.components(spark.createDataFrame([(i + 1, i) for i in range(40)], "u long, v long")).collect()
    assert {(r.node, r.root) for r in rows} == {(i, 0) for i in range(41)}


def repeats(texts, n=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + n] for b in data for i in range(len(b) - n + 1))
    out = []
    for b in data:
        m = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                m[i : i + n] = True
        d = np.diff(np.concatenate([[0], m.astype(int), [0]]))
        out.append((len(b), int(m.sum()), int((d == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest()))
    return out


def planted():
    rng = random.Random(3)
    rnd = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared, base = [rnd(260), rnd(205), rnd(900)], rnd(1500)
    out = [None, "", "a" * 150, "a" * 200, "a" * 201, "ab" * 400, shared[0], shared[0][:210], base, base, base[:700] + "X" + base[700:], base[:700] + "YY" + base[705:]]
    out += [rnd(rng.randint(0, 300)) + shared[i % 3] + rnd(rng.randint(0, 300)) for i in range(30)]
    out += [base[: i * 37] + rnd(3) + base[i * 37 + 2 :] for i in range(20)]
    return [*out, rnd(170) + shared[1][:200] + rnd(100), rnd(99) + shared[1][2:201] + rnd(5), "\x00" * 300 + rnd(100), rnd(50) + "\x00" * 250]


@pytest.mark.parametrize("crowd", [5000, 5])
def test_repeats(spark, crowd):
    texts = planted()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(df, crowd=crowd).collect()}
    assert [got[i] for i in range(len(texts))] == repeats(texts)


def test_repeats_on_odd_tables(edge):
    rows = edge.select("doc_id", "text").collect()
    want = sorted(map(str, zip((r.doc_id for r in rows), repeats([r.text for r in rows]), strict=True)))
    got = suffixes.remove_repeats(edge).collect()
    assert sorted(str((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))) for r in got) == want
    cut = suffixes.without_repeats(edge)
    assert cut.columns == edge.columns and cut.count() == edge.count()


def test_long_texts_have_the_same_anchors(monkeypatch):
    data = np.random.default_rng(0).integers(97, 103, 40_000).astype(np.uint8)
    data[5000:6000] = data[20_000:21_000]
    _, *whole = suffixes.anchors(data, np.array([len(data)]))
    monkeypatch.setattr(suffixes, "PIECE", 7001)
    _, *pieces = suffixes.long_anchors(data)
    assert all((a == b).all() for a, b in zip(whole, pieces, strict=True))


def test_interval_tree_by_stack():
    text = "abracadabra_abra"
    order = sorted(range(len(text)), key=lambda i: text[i:])
    lcp = [0] + [next((k for k in range(99) if text[a : a + k + 1] != text[b : b + k + 1] or max(a, b) + k >= len(text))) for a, b in zip(order, order[1:], strict=False)]
    nodes = {(d, frozenset(order[i : j + 1])) for d, i, j in suffixes.intervals(np.array(lcp)).tolist()}
    want = set()
    for d in range(1, len(text)):
        for s in {text[i : i + d] for i in range(len(text) - d + 1)}:
            at = [i for i in range(len(text)) if text[i : i + d] == s]
            if len(at) > 1 and len({text[i + d : i + d + 1] or f"end{i}" for i in at}) > 1:
                want.add((d, frozenset(at)))
    assert nodes == want


def statistics(text):
    w = (text or "").encode().split()
    n, tri = len(w), None
    tri = [tuple(w[i : i + 3]) for i in range(n - 2)]
    seen, cov = Counter(tri), np.zeros(n, bool)
    for i, g in enumerate(tri):
        if seen[g] > 1:
            cov[i : i + 3] = True
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return n, sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), int(cov.sum())


def test_quality_statistics(edge):
    rows = edge.select("doc_id", "text").collect()
    want = []
    for r in rows:
        s = statistics(r.text)
        want.append(str((r.doc_id, *s, s[0] < 50 or 100 * s[4] > 50 * s[0])))
    got = quality.quality_rules(edge).collect()
    assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got) == sorted(want)
    assert not any(r.kept for r in got if r.base_failed)


def test_quality_outliers(spark):
    rng = random.Random(1)
    words = ["the", "ation", "erre", "and", "of", "ontion", "whes"]
    say = lambda: " ".join(rng.choice(words) + rng.choice(words) for _ in range(rng.randint(60, 400)))
    good = [say() for _ in range(80)]
    bad = [" ".join(x + "###" for x in say().split()) for _ in range(12)] + [say().replace(" ", " | ") for _ in range(12)]
    rows = [(i, t, "en", ["a", "b", None][i % 3]) for i, t in enumerate(good + bad)]
    got = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [got[i] for i in range(len(rows))] == [True] * 80 + [False] * 24


def test_quality_plan_has_no_python(edge):
    plan = quality.quality_rules(edge)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mixture_recovers_shares():
    rng = np.random.default_rng(0)
    rel = np.full((3000, 3), 1e-4, np.float32)
    rel[np.arange(3000), np.r_[rng.choice(3, 2000, p=[0.7, 0.3, 0.0]), np.full(1000, 2)]] = 1
    share = langmix.select(rel, np.array([2000, 1000]))
    assert share[0] == pytest.approx([0.7, 0.3, 0.0], abs=0.05) and share[1].tolist() == [0, 0, 1]


def test_language(spark, edge, nothing):
    rng = random.Random(5)
    pools = {"aa": ["tho", "ing", "ther", "wh"], "bb": ["öß", "sch", "ung", "ein"], "cc": ["ción", "ado", "que", "ñar"]}
    rows = []
    for i in range(120):
        lang = list(pools)[i % 3]
        rows.append((i, " ".join(rng.choice(pools[lang]) + rng.choice(pools[lang]) for _ in range(40)), lang))
    rows += [(200, "12 !", "aa"), (201, None, "bb"), (202, rows[0][1] + " " + rows[1][1], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langmix.identify(df).collect()}
    for i, _, lang in rows[:120]:
        assert got[i].lang_pred == lang and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert got[200].lang_pred == got[201].lang_pred == "und" and got[200].score == 0
    assert got[202].languages and set(got[202].languages) == {"aa", "bb"} and 0.4 < got[202].score < 0.6
    assert langmix.identify(edge).count() == edge.count() and langmix.identify(nothing).count() == 0
    assert langmix.accepted(edge).columns == edge.columns


def test_media(edge):
    rows = edge.select("doc_id", "text").collect()
    got = media.media_features(media.encode_media(edge)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert len(got) == len(rows)
    for r in rows:
        data = (r.text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        one = next(x for x in by[r.doc_id] if x.payload_sha256 == hashlib.sha256(payload).hexdigest())
        assert (one.n_bytes, one.payload_bytes, one.tail_crc32) == (len(data), len(payload), zlib.crc32(payload[-32:]))
        wav = media.to_wav(payload)
        assert wav[:4] == b"RIFF" and one.media_sha256 == hashlib.sha256(wav).hexdigest() and media.from_wav(wav) == payload


def test_fingerprint_finds_a_tone():
    t = np.arange(576 * 6)
    k = 40
    x = np.rint(127 + 100 * np.sin(2 * np.pi * k * t / 576)).astype(np.uint8)
    times, codes = media.fingerprint(x)
    assert len(codes) and {int(c) >> 20 for c in codes} == {k - 1} and (np.diff(times) >= 0).all()


def test_spectrum_in_parts_is_the_same(monkeypatch):
    x = np.random.default_rng(0).integers(0, 256, 576 * 20).astype(np.uint8)
    whole = media.fingerprint(x)
    monkeypatch.setattr(media, "FRAMES_AT_ONCE", 7)
    parts = media.fingerprint(x)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


@pytest.mark.parametrize("window", [0, 2, 3])
def test_gradients_by_differences(monkeypatch, window):
    # Windows with all lanes, with a sequence that starts and a lane that ends inside, and with one lane left.
    monkeypatch.setattr(gru, "_F", np.float64)
    rng = np.random.default_rng(0)
    symbols = rng.integers(0, gru.FREQUENT + 2, 200)
    sizes = np.array([80, 50, 70])
    p = {k: v.astype(float) + rng.normal(0, 0.2, v.shape) for k, v in gru.initial(rng.integers(1, 100, gru.FREQUENT), 3, 50).items()}
    grid = gru.Grid(symbols, sizes, 2)
    a, b, cells = list(grid.windows())[window]
    h0 = np.full((gru.STATE, int(grid.active[a])), 0.3)

    def loss():
        return -gru.log_probs(p, gru.Run(p, grid, a, b, cells, h0).after, grid.target[cells]).mean()

    g, _ = gru.gradients(p, grid, a, b, cells, h0)
    for k in p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        keep, eps = p[k][at], 1e-3
        p[k][at] = keep + eps
        up = loss()
        p[k][at] = keep - eps
        down = loss()
        p[k][at] = keep
        assert g[k][at] == pytest.approx((up - down) / (2 * eps), rel=2e-2, abs=1e-5)


def test_state_runs_through_whole_sequences():
    rng = np.random.default_rng(3)
    p = {k: v + rng.normal(0, 0.2, v.shape).astype(np.float32) for k, v in gru.initial(np.arange(gru.FREQUENT, 0, -1), 5, 9).items()}
    symbols, sizes = rng.integers(0, gru.FREQUENT + 3, 300), np.array([1, 199, 100])
    together = gru.score(p, symbols, sizes, width=2)
    alone = np.concatenate([gru.score(p, s, np.array([len(s)]), width=1) for s in np.split(symbols, np.cumsum(sizes)[:-1])])
    assert together == pytest.approx(alone, abs=1e-3)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    p = {k: v + rng.normal(0, 0.1, v.shape).astype(np.float32) for k, v in gru.initial(np.arange(gru.FREQUENT, 0, -1), 5, 9).items()}
    h = np.repeat(rng.uniform(-1, 1, (1, gru.STATE)).astype(np.float32), gru.FREQUENT + 2, axis=0)
    assert np.exp(gru.log_probs(p, h.T, np.arange(gru.FREQUENT + 2))).sum() == pytest.approx(1, abs=1e-3)


def test_language_model(edge, nothing):
    rows = edge.select("doc_id", "text").collect()
    toks = [(r.text or "").encode().lower().split() + [b""] for r in rows]
    key = ["" if r.doc_id is None else str(r.doc_id) for r in rows]
    count = Counter(w for k, t in zip(key, toks, strict=True) if zlib.crc32(k.encode()) % 7 != 2 for w in t)
    n, v = sum(count.values()), len(count)
    want = sorted((k, len(t), sum(count[w] > 0 for w in t), round(sum(np.log10((count[w] + 1) / (n + v + 1)) for w in t), 6)) for k, t in zip(key, toks, strict=True))
    got = lm.score_documents(edge).collect()
    assert sorted(("" if r.doc_id is None else str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert lm.score_documents(nothing).count() == 0


def test_empty_tables(nothing):
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.one_of_each(nothing).count() == 0
    assert suffixes.remove_repeats(nothing).count() == 0 and suffixes.without_repeats(nothing).count() == 0
    assert quality.quality_rules(nothing).count() == 0 and quality.accepted(nothing).count() == 0
    assert media.media_features(media.encode_media(nothing)).count() == 0


def test_media_fingerprint_by_a_plain_transform(spark):
    rng = random.Random(21)
    text = "".join(rng.choice("abcdefgh tuvw.XYZ09\n") for _ in range(media.FRAME * 4))
    x = [b / 128 - 1 for b in text.encode()]
    frame, hop = media.FRAME, media.HOP
    window = [0.5 - 0.5 * np.cos(2 * np.pi * n / (frame - 1)) for n in range(frame)]
    found = []
    for a in range(0, len(x) - frame + 1, hop):
        own = np.array([x[a + n] * window[n] for n in range(frame)])
        mags = [abs((own * np.exp(-2j * np.pi * k * np.arange(frame) / frame)).sum()) for k in range(1, frame // 2 + 1)]
        floor = media.FLOOR * sum(mags) / len(mags)
        tops = [k for k in range(1, len(mags) - 1) if mags[k - 1] < mags[k] >= mags[k + 1] and mags[k] > floor]
        found.append(sorted(tops, key=lambda k: -mags[k])[: media.PEAKS])
    want = sorted((t, (i << 20) | (j << 8) | gap) for t in range(len(found)) for gap in range(1, media.SPAN + 1) if t + gap < len(found) for i in found[t] for j in found[t + gap])
    times, codes = media.fingerprint(np.frombuffer(text.encode(), np.uint8))
    assert want and list(zip(times.tolist(), codes.tolist(), strict=True)) == want
    row = media.media_features(media.encode_media(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert list(zip(row.peak_times, row.peak_codes, strict=True)) == want


def test_sequence_score_by_single_steps():
    # The batched score against one symbol at a time: gates, class share and share within the class written out.
    rng = np.random.default_rng(4)
    p = gru.initial(np.arange(60, 0, -1), 5, 9)
    p = {k: v + rng.normal(0, 0.2, v.shape).astype(np.float32) for k, v in p.items()}
    sizes = np.array([7, 1, 40, 12])
    symbols = rng.choice([*range(60), gru.RARE], int(sizes.sum()))
    symbols[np.cumsum(sizes) - 1] = gru.END
    s, want, at = gru.STATE, [], 0
    sig = lambda v: 1 / (1 + np.exp(-v))
    for n in sizes:
        h, last = np.zeros(s), gru.END
        for y in symbols[at : at + n]:
            x, u = p["embed"][last] @ p["wx"] + p["b"], h @ p["wh"]
            z, r = sig(x[:s] + u[:s]), sig(x[s : 2 * s] + u[s : 2 * s])
            h = (1 - z) * np.tanh(x[2 * s :] + r * u[2 * s :]) + z * h
            logits = h @ p["wc"] + p["bc"]
            k = int(gru.class_of(np.array([y]))[0])
            like = logits[k] - np.log(np.exp(logits).sum())
            if y < gru.FREQUENT:
                w = slice(k * gru.CLASS_WORDS, (k + 1) * gru.CLASS_WORDS)
                inner = p["wo"][w] @ h + p["bo"][w]
                like += inner[y - w.start] - np.log(np.exp(inner).sum())
            want.append(like)
            last = y
        at += n
    assert np.allclose(gru.score(p, symbols, sizes, width=2), want, atol=1e-3)


def test_components_write_as_many_files_as_rows_ask_for(spark, monkeypatch):
    files = []
    plain = common.stored
    monkeypatch.setattr(common, "stored", lambda df, *a: files.append(len((out := plain(df, *a)).inputFiles())) or out)
    edges = spark.range(60).select((F.col("id") + 1).alias("u"), F.col("id").alias("v")).repartition(16, "u")
    got = simhash.components(edges, 60).select("node", "root").distinct().collect()
    assert sorted((r.node, r.root) for r in got) == [(i, 0) for i in range(61)]
    assert files and set(files) == {1}
