"""Operators 11 to 13 against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from keelson.llm import keyset, negatives, spelling, winnow

_LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


# -- keys -------------------------------------------------------------------

def test_key_filter_lets_all_keys_through(spark):
    r = np.random.default_rng(1)
    keys = r.integers(-2 ** 63, 2 ** 63 - 1, 3000)
    df = spark.createDataFrame([(int(k),) for k in keys] + [(None,)], "h long")
    field = keyset.key_filter(df, "h").value
    assert len(keyset.maybe(field, keys.view(np.uint64))) == len(keys)
    others = r.integers(-2 ** 63, 2 ** 63 - 1, 100_000).view(np.uint64)
    assert len(keyset.maybe(field, others)) < 100
    assert len(keyset.maybe(keyset.key_filter(df.limit(0), "h").value, others)) == 0


# -- spelling ---------------------------------------------------------------

def edits(word, alphabet):
    out = set()
    for i in range(len(word) + 1):
        for a in alphabet:
            out |= {word[:i] + a + word[i:], word[:i] + a + word[i + 1:]}
        out.add(word[:i] + word[i + 1:])
    return out - {word}


def plain_spelling(rows, length=7):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(_LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= length:
                counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= 2}
    form, near = {}, {}
    for w in n:
        found = [x for x in edits(w, set("".join(n))) if x in n]
        best = min(found, key=lambda x: (-n[x], x)) if found else None
        near[w], form[w] = len(found), best if best and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], near[w], n.get(form[w])) for w in n}


def test_neighbourhood_is_whole_and_distinct():
    alphabet = np.array([ord(c) for c in "abcé"], np.uint32)
    for words in (["aab", "bca", "ccc"], ["a", "é"], ["abcabcaabbccé" * 3]):
        codes = np.array([[ord(c) for c in w] for w in words], np.uint32)
        for block in (1, 7, 1 << 16):
            found = defaultdict(list)
            for row, keys, place, skip, letter in spelling.neighbourhood(codes, alphabet, lambda k: np.arange(len(k)), block):
                for i, k, p, s, c in zip(row, keys.view(np.int64), place, skip, letter):
                    w = words[i]
                    found[w].append(w[:p] + (chr(c) if c else "") + w[p + s:])
                    assert spelling.hash_of(found[w][-1]) == k
            for w in words:
                assert len(found[w]) == len(set(found[w])) and set(found[w]) == edits(w, "abcé")


def test_spelling_variants(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abcÉé") for _ in range(r.randint(6, 9))) for _ in range(12)] + ["Letters", "lettersx", "letterss", "Õtherword"]
    words = [w for w in base for _ in range(r.choice([1, 3, 40, 500]))]
    for _ in range(300):
        w = r.choice(base)
        i = r.randrange(len(w))
        words += [r.choice([w[:i] + w[i + 1:], w[:i] + "b" + w[i + 1:], w[:i] + "a" + w[i:]])] * r.randint(1, 12)
    words += ["colourful"] * 900 + ["colourfull"] * 60 + ["kolourfull"] * 3
    r.shuffle(words)
    rows = [(i, r.choice([" ", ", ", "1", "\n"]).join(words[i * 40:i * 40 + 40])) for i in range(len(words) // 40 + 1)]
    rows += [(None, "nullword nullword"), (900, None), (901, ""), *((i, "acgt" * 3000) for i in range(902, 906)), *((i, "acgt" * 2999 + "acg") for i in range(906, 910))]
    rows += rows[:3]  # repeated rows
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in spelling.spelling_variants(df).collect()}
    want = plain_spelling(rows)
    assert got == want
    assert any(v[0] and v[1] != v[0] for v in want.values()) and any(len(w) > 10_000 and v[3] for w, v in want.items())
    none = spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string"))
    assert none.count() == 0 and none.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.spelling_variants(spark.createDataFrame([(1, "short words only"), (2, None)], "doc_id long, text string")).count() == 0


# -- negatives --------------------------------------------------------------

def plain_negatives(rows, every=50, moved=7, positives=5, wanted=3):
    use = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        use.append((i, (label + 1) % 10 if i % moved == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = []
    anchors = {(i, k, tuple(v)) for i, k, v in use if i % every == 0}
    for i, k, v in anchors:
        scored = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in use]
        near = sorted((s, j) for s, j, m in scored if m == k and j != i)[:positives]
        for s, j in near:
            far = sorted((t, x) for t, x, m in scored if m != k and 50 * -s <= 100 * -t <= 95 * -s)[:wanted]
            out += [(i, j, rank, x, -s, -t) for rank, (t, x) in enumerate(far, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_hard_negatives(spark, kind, monkeypatch):
    monkeypatch.setattr(negatives, "LISTED", 40)
    monkeypatch.setattr(negatives, "ASKING", 3)
    r = np.random.default_rng(7)
    centres = r.normal(size=(5, 6))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 5] + 0.4 * r.normal(size=6)], int(r.integers(0, 10))) for i in range(700)]
    rows += [(1000 + i, list(map(float, np.float32(centres[0]))), i % 3) for i in range(120)]  # one vector many times: ties
    rows += [(2000, None, 1), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2002, [float("nan")] + [0.0] * 5, 1), (2003, [float("inf")] + [0.0] * 5, 1), (2004, [1.0] * 6, None),
             (None, [1.0] * 6, 1), (2050, [], 1), (2051, [2.0, 1.0], 1), (2052, [0.0] * 6, 1)]
    rows += [rows[0], rows[50], rows[3]]  # repeated rows, two of them anchors
    df = spark.createDataFrame([(*x, "t") for x in rows], f"vec_id long, embedding array<{kind}>, label int, id string").repartition(4)
    got = sorted(tuple(x) for x in negatives.hard_negatives(df).collect())
    want = plain_negatives(rows)
    assert got == want and len(want) > 60


def test_hard_negatives_beyond_doubles(spark):
    r = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in 1e6 * r.normal(size=3)], i % 3) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(x) for x in negatives.hard_negatives(df).collect()) == plain_negatives(rows)
    wild = spark.createDataFrame([(i, [1e200 * (i + 1), 1.0], i % 2) for i in range(60)], "vec_id long, embedding array<double>, label int")
    assert {x.positive_score for x in negatives.hard_negatives(wild).collect()} <= {(1 << 63) - 1}  # clipped, no crash
    assert negatives.hard_negatives(df.limit(0)).count() == 0 and negatives.hard_negatives(df.filter("vec_id = 50")).count() == 0


def test_bounds_skip_lists(spark):
    """Far clusters are not visited, and the result stays exact."""
    r = np.random.default_rng(9)
    centres = np.eye(8) * 3
    rows = [(i, [float(np.float32(x)) for x in centres[i % 8] + 0.05 * r.normal(size=8)], int(r.integers(0, 2))) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    index = negatives.Lists(negatives.vectors(df, "vec_id", "label", "embedding"), "<f4")
    assert len(index.shared.value[1]) >= 8
    asked = spark.createDataFrame([(1, [(0, 0, -(1 << 63), (1 << 63) - 1, 500_000)], [np.array([768, *[0] * 7], "<f4").tobytes()])],
                                  f"asking long, asked {negatives._ASKED}, vectors array<binary>")
    visits = asked.mapInArrow(negatives._planned("<f4", 8, index.shared, 0, 1 << 20), "asking long, list int, who array<int>").count()
    assert 1 <= visits <= len(index.shared.value[1]) // 4
    assert sorted(tuple(x) for x in negatives.hard_negatives(df).collect()) == plain_negatives(rows)


# -- decontamination --------------------------------------------------------

def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))


def plain_contamination(docs, items):
    windows = defaultdict(set)
    for i, text in items:
        w = words_of(text)
        n = min(10, len(w))
        for a in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[a:a + n])].add(i)
    out = []
    for i, text in docs:
        w, hit, named = words_of(text), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a:a + n]) in windows:
                    hit |= set(range(a, a + n))
                    named |= windows[tuple(w[a:a + n])]
        names = sorted(str(x) for x in named - {None})
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [1 << 20, 400])
def test_contamination(spark, monkeypatch, size):
    monkeypatch.setattr(winnow.slices, "__defaults__", (size,))
    r = random.Random(3)
    some = [f"w{i}" for i in range(30)] + ["Éa", "ÉA", "x1", "7"]
    say = lambda n, bag=some: "".join(r.choice(bag) + r.choice([" ", ", ", "\n", " - ", "\x00"]) for _ in range(n))
    items = [(i, say(r.randint(10, 60))) for i in range(20)] + [(30, say(9)), (31, say(4)), (32, "w1 W2"), (33, "zebra"), (34, ""), (35, None), (36, "..!"), (None, say(12))]
    items += [items[0], (40, items[1][1]), (41, items[1][1].upper()), (41, say(15)), (42, "a a a a a a a a a a a a a")]
    docs = []
    for i in range(60):
        w = words_of(say(r.randint(0, 150)))
        for _ in range(r.randint(0, 3)):
            part = words_of(r.choice(items)[1])
            a = r.randint(0, max(0, len(part) - 5))
            at = r.randint(0, len(w))
            w[at:at] = part[a:a + r.randint(5, 30)]
        docs.append((i, " ".join(w)))
    docs += [(100, None), (101, ""), (102, "?!"), (103, "zebra"), (104, "a " * 40), (None, items[2][1]), (105, say(30_000) + items[3][1] + say(20)), (106, "q" * 5000 + " " + items[4][1]), docs[0], docs[0]]
    df = spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id long, text string, row long").repartition(3)
    its = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, hash string").repartition(2)
    got = sorted((tuple(x) for x in winnow.contamination(df, its).collect()), key=repr)
    want = plain_contamination(docs, items)
    assert got == want and sum(x[5] for x in want) > 30
    if size > 400:
        assert winnow.contamination(df.limit(0), its).count() == 0
        assert {x.contaminated for x in winnow.contamination(df, its.limit(0)).collect()} == {False}


def test_slices_cover_every_window():
    r = random.Random(4)
    for _ in range(200):
        text = " ".join("x" * r.choice([1, 2, 5, 40]) for _ in range(r.randint(0, 80))).encode()
        words, seen = text.split(), []
        for part, again in winnow.slices(text, 9, r.choice([20, 100, 300])):
            w = part.split()
            seen += w[:len(w) - again] if again else w
            assert not again or w[-again:] == words[len(seen):len(seen) + again]
        assert seen == words
