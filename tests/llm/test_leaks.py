import random
import re
import resource
import time

import numpy as np
import pytest

from millrace.llm import leaks

DOCS = "doc_id BIGINT, text STRING, doc BIGINT, item_id STRING, t STRING"
ITEMS = "item_id BIGINT, text STRING, i INT, suite STRING"


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, 1, "x", "y") for d in docs], DOCS), spark.createDataFrame([(*i, 1, "s") for i in items], ITEMS)


def words(text):
    return re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = set()
    for i, t in items:
        w = words(t)
        grams = {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
        for d, text in docs:
            v = words(text)
            if d is not None and i is not None and any(tuple(v[k : k + 13]) in grams for k in range(len(v) - 12)):
                out.add((d, i))
    return out


def test_random(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["aa", "Bb", "c1", "dé", "E", "f-g", "hh\n", "ii_jj"]) for _ in range(n))
    items = [(i, say(rng.randrange(5, 30))) for i in range(30)] + [(30, None), (31, ""), (32, "one two"), (None, say(20))]
    items.append((33, items[0][1]))
    docs = [(0, None), (1, ""), (2, "﻿ \n"), (None, items[3][1])]
    for d in range(3, 150):
        t = say(rng.randrange(40))
        if rng.random() < 0.6:
            w = re.split(r"(?<=\s)", rng.choice(items[:30])[1])
            a = rng.randrange(max(1, len(w) - 12))
            t += " " + "".join(w[a : a + rng.randrange(8, 25)]).upper() + " " + say(5)
        docs.append((d, t))
    docs += docs[10:12]
    d, i = frames(spark, docs, items)
    want = brute(docs, items)
    assert want and {tuple(r) for r in leaks.leaked_documents(d, i).collect()} == want
    # the way of item sets too large to be sent gives the same rows
    joined = leaks.find_leaks(d, i, block=7)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, leaks.find_leaks(d, i).collect()))
    assert {tuple(r) for r in joined.where("exact_words >= 13").select("doc_id", "item_id").collect()} == want


def test_every_single_substitution_is_met(spark):
    item = [f"w{k}" for k in range(13)]
    docs = [(k, "before " + " ".join(item[:k] + ["other"] + item[k + 1 :]) + " after") for k in range(13)]
    docs.append((99, " ".join(item[:5] + ["other", "two"] + item[7:])))
    d, i = frames(spark, docs, [(1, " ".join(item))])
    rows = {r.doc_id: (r.exact_words, r.overlap_words, r.substituted) for r in leaks.find_leaks(d, i).collect()}
    # a substitution at either end leaves 12 words, too short; the others keep all 13 with one substituted
    assert rows == {k: (max(k, 12 - k), 13, 1) for k in range(1, 12)}
    assert leaks.leaked_documents(d, i).collect() == []


def test_repeats_and_long_texts(spark):
    item = " ".join(f"w{k % 4}" for k in range(40))
    docs = [(1, item * 3), (2, "x " * 200_000 + item), (3, "w0 " * 50)]
    d, i = frames(spark, docs, [(1, item), (2, item)])
    assert {tuple(r) for r in leaks.leaked_documents(d, i).collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}


def longest(equal, subs):
    """Plainly: the longest run, the longest tolerant stretch, its substitutions."""
    exact = run = 0
    for e in equal:
        run = run + 1 if e else 0
        exact = max(exact, run)
    at = [i for i, e in enumerate(equal) if e]
    best = (0, 0)
    for x in range(len(at)):
        for y in range(x, len(at)):
            inside = at[y] - at[x] + 1
            if inside - (y - x + 1) <= subs:
                best = max(best, (inside, -(inside - (y - x + 1))))
    return exact, best[0], -best[1]


@pytest.mark.parametrize("subs", range(4))
def test_overlaps_of_truth_tables(subs):
    table = np.random.default_rng(subs).random((400, 18)) < 0.7
    table[0], table[1] = True, False
    assert list(zip(*(x.tolist() for x in leaks.overlaps(table, subs)))) == [longest(r, subs) for r in table.tolist()]


@pytest.mark.parametrize("subs", range(4))
def test_all_overlaps_are_found(subs):
    """Against all diagonals, with periodic texts and repeated words; no overlap within ``subs`` is missed."""
    rng = random.Random(subs)
    pool = ["0", "a", "b", "x y", "0 0 0 0 0 0 0", "a b a b a b a b", "q r s t u v w"]
    say = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(k, say(rng.randrange(2, 12))) for k in range(12)] + [(12, "0 " * 40)]
    docs = []
    for _ in range(40):
        w = (say(rng.randrange(8)) + " " + rng.choice(items)[1] + " " + say(rng.randrange(8))).split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "zz"
        docs.append(" ".join(w).encode())
    got = {(n, i): x for n, i, *x in leaks.Matcher(items, subs).matches(docs)}
    for n, d in enumerate(docs):
        v = d.decode().split()
        for i, t in items:
            w = t.split()
            rows = [longest([0 <= s + k < len(v) and v[s + k] == w[k] for k in range(len(w))], subs) for s in range(1 - len(w), len(v))]
            rows = [r for r in rows if r[1] >= 13]
            if not rows:
                assert (n, i) not in got
            else:
                overlap, used = max((r[1:] for r in rows), key=lambda x: (x[0], -x[1]))
                assert got[n, i] == [max(r[0] for r in rows), overlap, used]


def test_more_substitutions_are_refused(spark):
    d, i = frames(spark, [(1, "a")], [(1, "a")])
    with pytest.raises(ValueError, match="at most 3"):
        leaks.find_leaks(d, i, subs=4)


def test_two_substitutions_are_met(spark):
    item = [f"w{k}" for k in range(13)]
    docs = [(a * 100 + b, " ".join("other" if k in (a, b) else w for k, w in enumerate(item))) for a in range(1, 12) for b in range(a + 1, 12)]
    d, i = frames(spark, docs, [(1, " ".join(item))])
    assert {(r.doc_id, r.overlap_words, r.substituted) for r in leaks.find_leaks(d, i, subs=2).collect()} == {(n, 13, 2) for n, _ in docs}


def test_a_megabyte_of_zeros_is_quick():
    matcher = leaks.Matcher([(1, "0 " * 40), (2, "a b " * 20)], 1)
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    assert list(matcher.matches([b"0 " * 500_000])) == [(0, 1, 40, 40, 0)]
    assert list(matcher.matches([b"a b " * 250_000])) == [(0, 2, 40, 40, 0)]
    assert time.time() - began < 4 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000


def test_portions_of_work_do_not_matter(monkeypatch):
    rng = random.Random(9)
    words = [f"w{k % 7}" for k in range(60)]
    docs = [" ".join(rng.choice(words) if rng.random() < 0.1 else words[(k + d) % 60] for k in range(200)).encode() for d in range(20)]
    matcher = leaks.Matcher([(n, " ".join(words[n : n + 30])) for n in range(9)], 1)
    want = sorted(matcher.matches(docs))
    monkeypatch.setattr(leaks, "_PAIRS", 5)
    monkeypatch.setattr(leaks, "_CELLS", 70)
    assert len(want) > 20 and sorted(matcher.matches(docs)) == want


def test_long_texts_are_cut_without_loss(monkeypatch):
    rng = random.Random(10)
    item = " ".join(f"w{k}" for k in range(40))
    texts = [" ".join([*(f"r{rng.randrange(99)}" for _ in range(n)), item, *(f"r{rng.randrange(99)}" for _ in range(50))]) for n in range(0, 120, 7)]
    texts += ["x" * 900 + " " + item, item + "-" * 900, item * 3, ""]
    matcher = leaks.Matcher([(5, item), (6, "w3 w4 w5 " * 9)], 1)
    want = [sorted(x[1:] for x in matcher.matches([t.encode()])) for t in texts]
    monkeypatch.setattr(leaks, "LONG", 100)
    assert [sorted(matcher.long_matches(t.encode())) for t in texts] == want and want[0] == [(5, 40, 40, 0)]


def test_segments_do_not_matter(monkeypatch):
    text = b"one two  three-four " * 30 + b"x" * 50 + b" five"
    whole = leaks.Words([text, b"", text])
    monkeypatch.setattr(leaks, "_SEGMENT", 16)
    cut = leaks.Words([text, b"", text])
    assert (whole.hash == cut.hash).all() and (whole.hash[: len(whole.hash) // 2] == whole.hash[len(whole.hash) // 2 :]).all()
    assert len(set(whole.hash.tolist())) == 6


def test_empty(spark):
    d, i = frames(spark, [(1, "a " * 20)], [(1, "a " * 20)])
    assert leaks.leaked_documents(d.limit(0), i).collect() == [] and leaks.leaked_documents(d, i.limit(0)).collect() == []
    assert leaks.leaked_documents(d, i).count() == 1
    assert leaks.find_leaks(d.limit(0), i, block=0).collect() == [] and leaks.find_leaks(d, i, block=0).count() == 1
