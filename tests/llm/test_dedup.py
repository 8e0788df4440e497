from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest
from cadastra.llm.components import components
from cadastra.llm.exact_dedup import CuckooFilter, DedupIndex, dedup, digests
from cadastra.llm.ngram_join import similar_groups
from llm_odd import ODD


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_cuckoo_filter_against_a_set():
    draw = random.Random(1)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    own, live = CuckooFilter(), set()
    for _ in range(9000):
        key = draw.choice(keys)
        if key in live and draw.random() < 0.6:
            assert own.delete(key)
            live.discard(key)
        elif key not in live:
            own.insert(key)
            live.add(key)
        assert (own.find(key) is not None) == (key in live)
    assert set(own.keys.values()) == live and all(own.may_hold(k) for k in live)
    assert own.size > 4  # it has grown from the stored keys
    assert not any(own.delete(k) for k in keys if k not in live)


def test_exact_dedup(documents):
    groups = defaultdict(list)
    for i, t in ODD:
        groups[normal(t)].append(i)
    got = dedup(documents(ODD)).collect()
    assert len(got) == len(ODD)
    assert sum(r.kept for r in got) == len(groups)
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        ids = [i for i in groups[text] if i is not None]
        assert r.group_size == len(groups[text]) and r.keep_id == (min(ids) if ids else None)
    assert dedup(documents([])).count() == 0


def test_index_inserts_and_deletes(spark, documents):
    first = digests(documents([(5, "a"), (6, "a"), (7, "b")]))
    index = DedupIndex(spark, 2).insert(first)
    index = index.insert(digests(documents([(3, "a"), (9, "c")])))
    live = {bytes(r.digest): (r.keep_id, r.group_size) for r in index.live().collect()}
    assert sorted(live.values()) == [(3, 3), (7, 1), (9, 1)]
    gone = digests(documents([(0, "a"), (0, "unknown")]))
    index = index.delete(gone)
    assert sorted((r.keep_id, r.group_size) for r in index.live().collect()) == [(7, 1), (9, 1)]
    assert sorted((r.keep_id, r.group_size) for r in index.insert(digests(documents([(8, "a")]))).live().collect()) == [(7, 1), (8, 1), (9, 1)]


def test_index_over_growing_and_shrinking_batches(spark, documents):
    """Against a dictionary; batches are much larger and much smaller than what is stored."""
    index, want = DedupIndex(spark, 1), {}
    text = lambda i: f"text {i}"
    for step, ids in (("in", range(10)), ("in", range(4000)), ("out", range(10, 4000)), ("in", range(5, 25)), ("in", range(3)), ("out", range(7))):
        if step == "in":
            index = index.insert(digests(documents([(100_000 * len(want) + i, text(i)) for i in ids])))
            base = 100_000 * len(want)
            for i in ids:
                keep, n = want.get(text(i), (base + i, 0))
                want[text(i)] = (min(keep, base + i), n + 1)
        else:
            index = index.delete(digests(documents([(0, text(i)) for i in ids])))
            for i in ids:
                want.pop(text(i), None)
        got = {bytes(r.digest): (r.keep_id, r.group_size) for r in index.live().collect()}
        assert got == {hashlib.sha256(t.encode()).digest(): v for t, v in want.items()}


def shingles(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def groups(rows):
    """Components over all pairs."""
    sets = [shingles(t) if i is not None else frozenset() for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    smallest = defaultdict(lambda: 1 << 60)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            smallest[find(k)] = min(smallest[find(k)], i)
    return sorted((-1 if i is None else i, len(shingles(t)), smallest[find(k)] if i is not None else -1) for k, (i, t) in enumerate(rows))


def near_copies(seed):
    """Chains and stars of edited texts, a passage that many share, and texts exactly at the bound."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(draw.choices(words, k=40))
    rows, at = [], 0
    for _ in range(12):
        base = draw.choices(words, k=draw.choice([3, 5, 9, 40, 120]))
        for _ in range(draw.randint(1, 14)):
            text = list(base)
            for _ in range(draw.randint(0, 3)):
                text[draw.randrange(len(text))] = draw.choice(words)
            if draw.random() < 0.3:
                base = text
            rows.append((at, (" ".join(text) + (" " + passage if draw.random() < 0.3 else "")).title() if draw.random() < 0.5 else " ".join(text)))
            at += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_against_all_pairs(documents, seed):
    rows = near_copies(seed)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in similar_groups(documents(rows)).collect())
    assert got == groups(rows)


def test_near_copies_with_small_limits(documents, monkeypatch):
    from cadastra.llm import ngram_join

    monkeypatch.setattr(ngram_join, "LIST_ROWS", 2)
    monkeypatch.setattr(ngram_join, "LOCALLY_FREQUENT", 2)
    rows = near_copies(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in similar_groups(documents(rows)).collect())
    assert got == groups(rows)


def test_near_copies_of_odd_rows(documents):
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in similar_groups(documents(ODD)).collect())
    assert got == groups(ODD)
    assert similar_groups(documents([])).count() == 0


def test_components_of_a_long_path(spark):
    n = 70
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(200, 201), (201, 200), (300, 300)], "u long, v long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 200: 200, 201: 200}


def test_steps_of_groups_dont_repeat_each_other(spark, documents, monkeypatch):
    """The driver plans each step on written tables: one join for a step of the components, a few for what is still open."""
    from cadastra.llm import components as steps
    from cadastra.llm import ngram_join

    joins, write = [], steps.stage

    def counted(df):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return write(df)

    monkeypatch.setattr(steps, "stage", counted)
    components(spark.createDataFrame([(i, i + 1) for i in range(9)], "u long, v long"))
    assert len(joins) > 3 and max(joins) == 1
    monkeypatch.setattr(ngram_join, "stage", counted)
    monkeypatch.setattr(ngram_join, "LIST_ROWS", 2)
    monkeypatch.setattr(ngram_join, "LOCALLY_FREQUENT", 2)
    rows = near_copies(3)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in similar_groups(documents(rows)).collect()) == groups(rows)
    assert max(joins) <= 5


def test_garbage_is_collected_when_the_heap_is_half_full():
    from types import SimpleNamespace

    from cadastra.session import collect_garbage

    for total, times in ((50, 0), (51, 1)):
        seen = []
        heap = SimpleNamespace(totalMemory=lambda: total, maxMemory=lambda: 100)
        lang = SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: heap), System=SimpleNamespace(gc=lambda: seen.append(1)))
        jvm = SimpleNamespace(java=SimpleNamespace(lang=lang))
        collect_garbage(SimpleNamespace(sparkContext=SimpleNamespace(_jvm=jvm)))
        assert len(seen) == times


@pytest.mark.parametrize("tile", [1 << 17, 600])
def test_links_without_leaders(spark, documents, monkeypatch, tile):
    """Against all pairs on one list, with one tile for a size and with many."""
    import cadastra.llm.ngram_join as join
    import numpy as np
    from pyspark.sql import functions as F

    monkeypatch.setattr(join, "TILE", tile)
    draw = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(draw.randint(1, 5)):
            words[draw.randrange(60)] = f"x{draw.randrange(10**6)}"
        rows.append((i, " ".join(words[: draw.randint(44, 60)])))
    sets = [shingles(t) for _, t in rows]
    held = documents(rows).select(F.col("doc_id").alias("node"), "text")
    lists = documents(rows).select(F.lit(7).alias("token"), F.col("doc_id").alias("node"), F.lit(0).alias("n"), (F.col("doc_id") % 80).alias("root"))
    lists = lists.drop("n").join(spark.createDataFrame([(i, len(s)) for i, s in enumerate(sets)], "node long, n int"), "node")
    orders = spark.sparkContext.broadcast(join.Orders(np.empty(0, np.uint64), np.empty(0, np.int64)))
    got = [tuple(sorted(r)) for r in join._links_without_leaders(lists, held, orders).collect()]
    want = sorted((a, b) for b in range(90) for a in range(b) if a % 80 != b % 80 and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    assert want and sorted(got) == want


def test_bitmaps_never_hide_what_is_shared(spark):
    """Bits in one bitmap alone are at most the shingles in that set alone, whatever the sizes."""
    import numpy as np
    from pyspark.sql import functions as F

    from cadastra.llm.ngram_join import _only_in, bitmap

    draw = np.random.default_rng(2)
    rows, want = [], []
    for n, m in ((1, 1), (16, 17), (20, 33), (100, 130), (129, 200), (1000, 1025)):
        shared = draw.integers(0, 2**63, min(n, m) // 2, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([shared, draw.integers(0, 2**63, k - len(shared), dtype=np.uint64)])) for k in (n, m))
        rows.append((bitmap(a).view(np.int64).tolist(), bitmap(b).view(np.int64).tolist()))
        want.append((len(np.setdiff1d(a, b)), len(np.setdiff1d(b, a))))
    got = spark.createDataFrame(rows, "a array<long>, b array<long>").select(_only_in(F.col("a"), F.col("b")), _only_in(F.col("b"), F.col("a"))).collect()
    for (x, y), (u, v) in zip(got, want):
        assert u * 0.6 <= x <= u and v * 0.6 <= y <= v


def test_a_common_passage_makes_no_candidates(documents, monkeypatch):
    """Texts that have nothing but a short passage in common aren't paired; copies among them still are."""
    import cadastra.llm.ngram_join as join

    draw = random.Random(5)
    rows = [(i, " ".join([f"p{i // 3}_{j}" for j in range(10)] + [f"w{draw.randrange(10**9)}" for _ in range(100)])) for i in range(60)]
    seen, judged = [], join._judged
    monkeypatch.setattr(join, "_judged", lambda pairs, held: seen.append(pairs.count()) or judged(pairs, held))
    assert all(r.component_id == r.doc_id for r in join.similar_groups(documents(rows)).collect())
    assert sum(seen) == 0
    rows.append((99, rows[7][1] + " more"))
    assert {r.doc_id: r.component_id for r in join.similar_groups(documents(rows)).collect()} == {i: 7 if i == 99 else i for i, _ in rows}


def test_lists_keep_every_similar_pair(spark, documents):
    """Against all pairs, and at the bound: what a set has more than its part comes first under the order."""
    import cadastra.llm.ngram_join as join
    import numpy as np

    def check(rows, orders):
        sets = dict(join.shingle_sets([t for _, t in rows]))
        lists = defaultdict(set)
        for r in join._lists(documents(rows).select("text"), spark.sparkContext.broadcast(orders)).collect():
            lists[r.node].add(r.list)
        want = 0
        for a in range(len(rows)):
            for b in range(a):
                shared = len(np.intersect1d(sets[a], sets[b]))
                if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared) and join._node(sets[a]) != join._node(sets[b]):
                    assert lists[join._node(sets[a])] & lists[join._node(sets[b])]
                    want += 1
        assert want

    check(near_copies(6), join.Orders(np.empty(0, np.uint64), np.empty(0, np.int64)))
    for n in (5, 40, 100, 101, 333):
        words = [f"w{i}" for i in range(n + 4)]
        rows = [(1, " ".join(words)), (2, " ".join(words[: -(-4 * n // 5) + 4]))]
        _, part = list(join.shingle_sets([rows[1][1]]))[0]
        check(rows, join.Orders(part, np.full(len(part), 5)))
