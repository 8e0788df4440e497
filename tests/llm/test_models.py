from __future__ import annotations

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from cadastra.llm.graph_index import nearest
from cadastra.llm.mixing import _knapsack, fill_budget, mix
from cadastra.llm.resampling import best_cut, features, resample, top_k
from cadastra.llm.toxicity import BUCKETS, fit, noisy_or, original_spans, score, sentence_scores, sentences
from cadastra.llm.url_filter import judge_urls, rule_table
from llm_odd import ODD


# --- importance resampling


def test_log_weights_against_counts(spark, documents):
    good = [(i, "plain words in a row number " + "abcdefghij"[i % 10]) for i in range(40)]
    bad = [(100 + i, "### $$$ ### $$$ spam spam spam") for i in range(10)]
    rows = [*good, *bad, *ODD]
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:20]] + [(i, 0) for i, _ in bad[:5]] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {(r.doc_id, round(r.log_weight, 3)) for r in resample(documents(rows), labels).collect()}
    raw, target = np.ones(1 << 14), np.ones(1 << 14)
    for i, t in rows:
        bucket, _ = features([(t or "").encode()])
        np.add.at(raw, bucket, 1)
        if i is not None and i < 20:  # every row of a labelled id
            np.add.at(target, bucket, 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    weight = {(i, t): ratio[features([(t or "").encode()])[0]].sum() for i, t in rows}
    kept = {i for i, _ in got}
    assert {i for i, _ in good} <= kept and not kept & {i for i, _ in bad}
    for i, w in got:
        assert any(abs(weight[i, t] - w) < 2e-3 for j, t in rows if j == i)
    assert resample(documents([]), labels).count() == 0
    assert resample(documents(rows), labels.limit(0)).count() == len(rows)


def test_draw_of_k(spark):
    draw = random.Random(4)
    values = [draw.uniform(-5, 5) for _ in range(3000)] + [1.0] * 50 + [-1e6, 1e6, 1e-9]
    table = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (0, 1, 7, 1500, len(values) - 1, len(values), 9999):
        want = sorted(values, reverse=True)[:k]
        got = sorted((r.key for r in top_k(table, "key", k).collect()), reverse=True)
        assert got == [v for v in sorted(values, reverse=True) if want and v >= want[-1]]


def test_best_cut():
    assert best_cut(np.array([1.0, 2.0, 8.0, 9.0]), np.array([False, False, True, True])) == 5.0
    assert best_cut(np.array([]), np.array([], bool)) == -math.inf
    assert best_cut(np.array([1.0, 1.0]), np.array([True, False])) == -math.inf


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    learnt = labels.where("doc_id % 2 = 0")
    kept = {r.doc_id for r in resample(docs, learnt).collect()}
    held = labels.where("doc_id % 2 = 1").collect()
    right = sum((r.doc_id in kept) == (r.quality == 1) for r in held)
    assert right / len(held) > 0.95


# --- toxicity


def test_sentences_cover_the_text():
    for text in ["", "a", "One. Two! 3.5 is one\nThree", "x" * 5000, "word " * 2000 + "."]:
        spans = sentences(text.encode())
        assert "".join(text.encode()[a:b].decode() for a, b in spans) == text
        assert all(b - a <= 2000 for a, b in spans)


def test_noisy_or():
    p = np.array([0.1, 0.5, 0.2])
    assert noisy_or(p) == pytest.approx(1 - 0.9 * 0.5 * 0.8)
    assert noisy_or(p, 0.3) == pytest.approx(1 - 0.7 * 0.9 * 0.5 * 0.8)
    assert noisy_or(np.empty(0)) == 0.0 and noisy_or(np.empty(0), 0.3) == pytest.approx(0.3) and noisy_or(np.array([1.0, 1.0])) <= 1.0


def test_toxic_sentences_are_found(spark, documents):
    draw = random.Random(2)
    words = [f"w{draw.randrange(300)}x" for _ in range(300)]
    rows, toxic = [], {}
    for i in range(800):
        parts = [" ".join(draw.choices(words, k=8)) + "." for _ in range(5)]
        toxic[i] = int(i % 4 == 0)
        if toxic[i]:
            parts[draw.randrange(5)] = "you are a " + draw.choice(["moronic", "stupid"]) + " " + draw.choice(words) + "."
        rows.append((i, " ".join(parts)))
    labels = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    got = {r.doc_id: r for r in score(documents([*rows, *[(i + 5000 if i is not None else None, t) for i, t in ODD]]), labels).collect()}
    for i, y in toxic.items():
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i].predicted == y, (i, got[i])
        if y:
            assert any("you are a" in s.text for s in got[i].offending)
    text = dict(rows)
    for i in toxic:
        assert all(text[i][s.start : s.start + len(s.text)] == s.text for s in got[i].offending)
    assert 0 <= got[5003].score < 0.05 and not got[5003].offending and got[None].held_out is False
    assert score(documents([]), labels).count() == 0
    assert {r.predicted for r in score(documents(ODD), labels.limit(0)).collect()} == {0}


def test_long_clean_texts_stay_clean():
    draw = random.Random(5)
    words = [f"{draw.choice('abcdefghij')}{k}x" for k in range(400)]
    say = lambda: " ".join(draw.choices(words, k=9)) + ". "
    insult = lambda: f"you are a {draw.choice(['moronic', 'stupid'])} {draw.choice(words)}. "
    clean, bad = ["".join(say() for _ in range(6)) for _ in range(400)], ["".join(say() for _ in range(5)) + insult() for _ in range(150)]
    weights, bias, leak = fit(clean + bad, [0] * len(clean) + [1] * len(bad))
    used = weights != 0
    whole = lambda text: noisy_or(sentence_scores(text, weights, bias, used), leak)
    long = "".join(say() for _ in range(10_000))
    assert whole(long) < 0.3 and whole(long + insult()) > 0.3
    p = sentence_scores(long + insult(), weights, bias, used)
    assert int(np.argmax(p)) == 10_000
    rest = 1 - leak
    for x in p:
        rest *= 1 - x
    assert noisy_or(p, leak) == pytest.approx(1 - rest, abs=1e-9)
    assert sentence_scores("", weights, bias, used).tolist() == [] and not sentence_scores("qq qq.", np.zeros(BUCKETS), 5.0, np.zeros(BUCKETS, bool)).any()


def test_spans_of_the_original_text():
    for text in ["Ab. Cd! EF", "\u0130stanbul. \u0130S. UP", "\u023a\u023a. Xy. \u00c9t\u00c9", "\u0130" * 3000 + ". End"]:
        lowered = text.lower()
        spans = sentences(lowered.encode())
        places = original_spans(text, lowered, spans)
        assert "".join(text[a:b] for a, b in places) == text
        if len(text) < 100:
            assert [text[a:b].lower() for a, b in places] == [lowered.encode()[a:b].decode() for a, b in spans]


def test_one_labelled_id_on_many_rows(spark, documents):
    rows = [(i, f"you are a stupid thing {i}. more words") for i in range(40)] + [(100 + i, f"a calm day {i}. more words") for i in range(40)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "doc_id long, toxic int")
    once = {(r.doc_id, r.score) for r in score(documents(rows), labels).collect()}
    often = {(r.doc_id, r.score) for r in score(documents(rows + [rows[3]] * 500), labels).collect()}
    assert once == often


def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = score(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    caught = sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows)
    wrong = sum(r.predicted for r in rows if not r.toxic) / sum(1 - r.toxic for r in rows)
    assert caught > 0.8 and wrong < 0.02


# --- URL filter


def test_urls_against_rules(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.com", "", "block")]
    urls = [
        None, "", "no scheme", "http://", "http://Example.ORG", "http://example.org/", "https://x.example.org/es/1?q", "http://notexample.org/es/", "http://example.org/en/17", "http://example.org/en",
        "ftp://user@b.com:80/de/", "http://b.com/de/x", "http://b.com/fr/#/de/", "http://org/x", "http://a.com", "http://a.com/fr/1", "x://y://z.com/de/", "http://b.com?/de/", "http://É.org/Ü\n/x",
    ]
    draw = random.Random(1)
    urls += [f"http://{draw.choice(['', 'www.', 'x.y.'])}{draw.choice(['example', 'a', 'b'])}.{draw.choice(['org', 'com', 'net'])}/{draw.choice(['es', 'en', 'de', 'fr'])}/{draw.randrange(200)}" for _ in range(300)]
    rows = [(i, u, "x", "x") for i, u in enumerate(urls)] + [(7, urls[7], "x", "x"), (None, "http://b.com/de/", "x", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, key string, host string")

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = rest[: min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))]
        path = rest[len(host) :]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    got = sorted(((r.page_id if r.page_id is not None else -1), r.host, r.path, r.rule or "", r.verdict) for r in judge_urls(pages, rule_table(spark, rules)).collect())
    want = sorted(((i if i is not None else -1), *[x or "" for x in judge(u)]) for i, u, *_ in rows)
    assert got == want
    assert judge_urls(pages.limit(0), rule_table(spark, rules)).count() == 0
    assert {r.verdict for r in judge_urls(pages, rule_table(spark, rules).limit(0)).collect()} == {"allow"}


# --- nearest neighbours


def test_recall_and_rules_of_neighbours(spark):
    draw = np.random.default_rng(3)
    vectors = draw.normal(size=(1500, 12)).astype(np.float32).astype(float)
    vectors[600:1100] = vectors[600]  # a hot vector
    vectors[1100:1200] *= 3
    rows = [(i, v.tolist(), "x", 0.0) for i, v in enumerate(vectors)]
    odd = [(2000, None), (2020, [0.0] * 12), (2040, [float("nan")] * 12), (2060, [1.0, None] + [0.0] * 10), (2080, [float("inf")] + [0.0] * 11), (2100, [1.0]), (None, [1.0] * 12), (2120, [])]
    rows += [(i, v, "x", 0.0) for i, v in odd] + [rows[40]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key string, score double")
    got = defaultdict(list)
    for r in nearest(table, shard_vectors=300).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    found = []
    for q, answers in got.items():
        scores = (vectors[q] * vectors).sum(axis=1)
        scores[q] = -np.inf
        want = np.lexsort((np.arange(1500), -scores))[:20]
        assert [a[0] for a in answers] == list(range(1, 21)) and q not in [a[1] for a in answers]
        assert all(s == scores[i] for _, i, s in answers)
        assert answers == [(k, i, s) for k, (_, i, s) in enumerate(sorted(answers, key=lambda a: (-a[2], a[1])), 1)]
        found.append(len({a[1] for a in answers} & set(want.tolist())) / 20)
    assert np.mean(found) >= 0.95
    few = table.where("vec_id < 5")
    assert sorted((r["rank"], r.vec_id) for r in nearest(few).collect()) == sorted(
        (k, int(i)) for k, i in enumerate(sorted(range(1, 5), key=lambda i: -(vectors[0] * vectors[i]).sum()), 1)
    )
    assert nearest(table.limit(0)).count() == 0


def test_equal_scores_and_other_lengths(spark):
    draw = np.random.default_rng(8)
    vectors = {int(i): draw.integers(-1, 2, 4 if i % 3 else 3).astype(float) for i in draw.permutation(400)}
    vectors = {i: v for i, v in vectors.items() if v.any()} | {20: np.array([2.0, 1.0, 0, 0, 5.0])}
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in vectors.items()], "vec_id long, embedding array<double>, size int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(table, shard_vectors=30).collect())
    want = []
    for q in (q for q in vectors if q % 20 == 0):
        scores = sorted((-float(vectors[q] @ v), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:20], 1)]
    assert got == sorted(want)


# --- mixing


def test_knapsack_against_all_sums():
    draw = random.Random(6)
    for _ in range(60):
        lengths = draw.sample(range(1, 30), draw.randint(1, 5))
        counts = [draw.randint(0, 4) for _ in lengths]
        budget = draw.randint(0, 120)
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        used = _knapsack(np.array(lengths), np.array(counts), budget)
        assert all(0 <= u <= c for u, c in zip(used, counts))
        assert int((used * np.array(lengths)).sum()) == max(s for s in sums if s <= budget)
        big = fill_budget(lengths, counts, budget)
        assert all(0 <= u <= c for u, c in zip(big, counts)) and (big * np.array(lengths)).sum() <= max(budget, 0)


def test_large_budgets_are_met():
    draw = random.Random(7)
    lengths = draw.sample(range(1, 5000), 900)
    counts = [draw.randint(1, 40) for _ in lengths]
    total = sum(a * b for a, b in zip(lengths, counts))
    for budget in (0, 1000, 30_000, total // 7, total // 2, total - 5000, total):
        taken = fill_budget(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        assert 0 <= budget - int((taken * np.array(lengths)).sum()) <= (0 if budget <= total // 2 or budget == total else 5000)


def test_long_documents_fill_the_budget():
    assert fill_budget([45_000], [3], 94_500).tolist() == [2]
    draw = random.Random(11)
    for _ in range(300):
        lengths = draw.sample(range(10_001, 90_000), draw.randint(1, 6))
        counts = [draw.randint(1, 4) for _ in lengths]
        budget = draw.randint(0, sum(a * b for a, b in zip(lengths, counts)))
        taken = fill_budget(lengths, counts, budget)
        rest = budget - sum(int(t) * n for t, n in zip(taken, lengths))
        assert rest >= 0 and all(0 <= t <= c for t, c in zip(taken, counts))
        assert all(n > rest for n, t, c in zip(lengths, taken, counts) if t < c)


def test_long_documents_are_combined():
    for lengths, budget in (([30_000, 28_000, 22_000], 50_000), ([60_000, 40_000, 39_000, 21_000], 100_000)):
        assert int((fill_budget(lengths, [1] * len(lengths), budget) * np.array(lengths)).sum()) == budget
    draw = random.Random(12)
    for _ in range(100):
        lengths = draw.sample(range(15_000, 60_000), draw.randint(1, 5))
        counts = [draw.randint(1, 2) for _ in lengths]
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        budget = draw.randint(0, min(sum(a * b for a, b in zip(lengths, counts)), 4 * max(lengths)))
        taken = fill_budget(lengths, counts, budget)
        assert sum(int(t) * n for t, n in zip(taken, lengths)) == max(s for s in sums if s <= budget)


def test_mix_of_sources(documents):
    draw = random.Random(9)
    rows = []
    for i in range(400):
        source = draw.choice(["a", "b", "b", "b", "b", "b", "b", "c", None, "tiny"] if i < 390 else ["hot"])
        if source == "tiny" and draw.random() < 0.9:
            source = "b"
        rows.append((i, " ".join(["w"] * draw.randint(0, 30)), source))
    rows += [(1000, None, "a"), (1001, "", "empty"), (1002, "x y", None), (1002, "x y", None), (None, "a b c", "a")]
    first = sorted(((r.doc_id if r.doc_id is not None else -1), r["size"], r.source_size, round(r.target, 6), r.taken) for r in mix(documents(rows)).collect())
    again = sorted(((r.doc_id if r.doc_id is not None else -1), r["size"], r.source_size, round(r.target, 6), r.taken) for r in mix(documents(rows[::-1])).collect())
    assert first == again and len(first) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        whole = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / whole > 3 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / whole for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    source = {(i if i is not None else -1): s for i, _, s in rows}
    taken = defaultdict(int)
    for i, size, whole, goal, took in first:
        s = source[i]
        assert whole == sizes[s] and goal == pytest.approx(target[s], abs=1e-5)
        assert took % size == 0 and took <= 3 * size if size else took == 0
        taken[s] += took
    for s in names:
        assert abs(taken[s] - target[s]) <= 1
    assert mix(documents([])).count() == 0
