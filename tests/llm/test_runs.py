from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from cadastra.llm.runs import collapse, find_runs, runs_of
from cadastra.llm.text_queries import op11_periodic_runs
from llm_odd import ODD


def brute(words, least=12):
    """Every stretch that no neighbour extends, period by period; of equal stretches the smallest period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        same = [words[k] == words[k + q] for k in range(len(words) - q)] + [False]
        start = None
        for k, equal in enumerate(same):
            if equal and start is None:
                start = k
            elif not equal and start is not None:
                if k - start + q >= max(least, 2 * q):
                    found.setdefault((start, k - start + q), q)
                start = None
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("seed", range(60))
def test_runs_against_brute_force(seed):
    draw = random.Random(seed)
    texts = []
    for _ in range(draw.randint(1, 6)):
        words = [str(draw.randrange(draw.choice([1, 2, 2, 3, 5, 20]))) for _ in range(draw.randint(0, 70))]
        if words and draw.random() < 0.6:
            a, p = draw.randrange(len(words)), draw.randint(1, 12)
            words = [w if i < a else words[min(a + (i - a) % p, len(words) - 1)] for i, w in enumerate(words)]
        texts.append(" ".join(words).encode())
    for least in (12, 2, 5):
        got = list(runs_of(texts, least))
        assert got == [brute(t.decode().split(), least) for t in texts]
        assert [collapse(t, r).decode() for t, r in zip(texts, got)] == [kept(t.decode().split(), r) for t, r in zip(texts, got)]


def test_long_repetitive_texts():
    fibonacci, b = "a", "ab"
    while len(b) < 5000:
        fibonacci, b = b, b + fibonacci
    lines = " ".join(f"x{i} a b c d e f g h" for i in range(20_000))
    one, fib, far, period = runs_of([b"a " * 50_000, " ".join(b).encode(), lines.encode(), " ".join(str(i % 7000) for i in range(60_000)).encode()])
    assert one == [(0, 50_000, 1)] and period == [(0, 60_000, 7000)] and far == []
    assert fib == brute(list(b))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_find_runs_of_odd_rows(documents):
    rows = [*ODD, (20, "x y " * 9 + "\x1c z\xa0z " * 8)]
    got = find_runs(documents(rows)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.collapsed) for r in got) == sorted((str(i), len(words_of(t)), kept(words_of(t), brute(words_of(t)) if len(words_of(t)) < 1000 else [(0, 30_000, 1)])) for i, t in rows)
    assert find_runs(documents([])).count() == 0
    with pytest.raises(ValueError):
        find_runs(documents([]), min_length=1)


def test_query_against_brute_force(spark, documents, tmp_path):
    draw = random.Random(5)
    rows = [(i, draw.choice([" ", "\n", " \t "]).join(draw.choices(["ab", "cd", "e,", "é"], k=draw.randint(0, 90)))) for i in range(-40, 120)]
    rows += [(500, None), (501, ""), (None, "a " * 30)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    changed = 0
    for i, text in rows:
        words = words_of(text)
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            changed += 1
        runs = brute(words)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        want = (len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2])
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), kept(words, runs))]
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == (*want, *digests), i
    assert changed > 5
