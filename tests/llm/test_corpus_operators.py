"""Operators over groups of rows, and the pipeline, against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keelson.llm import _common, exact_dedup, jaccard_join, pii


def test_filters(spark):
    df = spark.createDataFrame([(i if i % 7 else None, f"t{i}") for i in range(500)], "id long, t string")
    some = df.filter("id % 3 = 0").select("id")
    want = {r.id for r in some.collect()} - {None}
    assert {r.id for r in _common.rows_with(df, "id", some).collect()} == want
    rest = _common.rows_without(df, "id", some).collect()
    assert len(rest) == 500 - len(want) and not want & {r.id for r in rest} and any(r.id is None for r in rest)


def test_rice_codes():
    r = np.random.default_rng(3)
    for n in (1, 2, 500):
        v = np.unique(r.integers(1 << 40, 1 << 44, n, dtype=np.uint64))
        assert (exact_dedup.rice_decode(exact_dedup.rice_encode(v, 1 << 40), 1 << 40) == v).all()
    assert len(exact_dedup.rice_encode(np.arange(1000, dtype=np.uint64), 0)) < 1000
    assert exact_dedup.rice_decode(b"", 0).size == 0


def test_normalise():
    r = random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice("ab \t\n\r\x0b\x0c\x1f\xa0é") for _ in range(r.randint(0, 12)))
        assert exact_dedup.normalise(t.encode()) == re.sub(r"[\x20\x09-\x0D]+", " ", t).encode(), repr(t)


def test_exact_dedup(spark):
    r = random.Random(2)
    texts = [r.choice(["a b", "a  b", "a\nb ", "c", "", None, " ", "d" * 50_000]) for _ in range(200)] + [f"own {i}" for i in range(100)]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(5)
    got = {x.doc_id: x for x in exact_dedup.exact_dedup(df, owners=3).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    assert len(got) == 300
    for t, ids in groups.items():
        for i in ids:
            x = got[i]
            assert (x.keep_id, x.group_size, x.kept, x.text_sha256) == (min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest())
    kept = exact_dedup.drop_copies(df, _common.settle(exact_dedup.exact_dedup(df), "v"))
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == sorted(min(v) for v in groups.values())


def test_fewer_groups_lose_no_link_just_at_the_bar():
    """What the pipeline's near copies rest on: sets as far apart as links may be still share signatures."""
    r = np.random.default_rng(8)
    few = jaccard_join.Plan(80, 100, exact=False)
    fewest = []
    for n in (600, 1000, 1700, 2500, 3500, 5000):
        for own in (0, 1):  # a larger set and its subset; two sets of one size
            for _ in range(40):
                both = -(-80 * n // 100) if not own else few.need(2 * n)
                x = np.unique(r.integers(0, 1 << 64, 2 * n - both + 50, dtype=np.uint64))
                r.shuffle(x)
                a, b = np.sort(x[:n]), np.sort(np.append(x[:both], x[n:2 * n - both] if own else x[:0]))
                same = len(np.intersect1d(a, b))
                assert 100 * same >= 80 * (len(a) + len(b) - same) and 100 * (same - 1) < 80 * (len(a) + len(b) - same + 1)
                of = lambda s: few.signatures(s, jaccard_join.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
                fewest.append(len(np.intersect1d(of(a), of(b))))
    assert few.groups(few.class_of(600))[1] == -1  # from here on not by counting
    assert min(fewest) >= 15, sorted(fewest)[:9]  # far from none


def test_exact_dedup_edges(spark, monkeypatch):
    schema = "doc_id long, text string"
    assert exact_dedup.exact_dedup(spark.createDataFrame([], schema)).count() == 0
    odd = spark.createDataFrame([(None, "a"), (3, "a"), (3, "a"), (5, "a"), (None, "z"), (None, "z"), (7, "q"), (7, "r")], schema)
    got = sorted(((x.doc_id, x.keep_id, x.group_size, x.kept) for x in exact_dedup.exact_dedup(odd).collect()), key=str)
    assert got == sorted([(None, 3, 4, False), (3, 3, 4, True), (3, 3, 4, False), (5, 3, 4, False), (None, None, 2, True), (None, None, 2, False), (7, 7, 1, True), (7, 7, 1, True)], key=str)
    kept = exact_dedup.drop_copies(odd, _common.settle(exact_dedup.exact_dedup(odd), "v")).collect()
    assert sorted(((x.doc_id, x.text) for x in kept), key=str) == sorted([(3, "a"), (7, "q"), (7, "r"), (None, "a"), (None, "z"), (None, "z")], key=str)


def test_exact_dedup_takes_small_batches(spark):
    """Its rows are whole texts: none of its tasks holds 10000 of them at once, which is Spark's own batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        exact_dedup.exact_dedup(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
        rows = spark.range(3000, numPartitions=1)
        most = [r.n for r in rows.mapInArrow(lambda bs: (b.from_pydict({"n": [b.num_rows]}) for b in bs), "n long").collect()]
        assert sum(most) == 3000 and max(most) <= _common.BATCH
    finally:
        spark.conf.set(key, before)


def plain_sets(texts, k):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        out.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def plain_components(rows, k, num):
    sets, parent = plain_sets([t for _, t in rows], k), {d: d for d, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in where[x]:
                if j > i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= num * (len(s) + len(sets[j]) - n):
                a, b = top(rows[i][0]), top(rows[j][0])
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), top(d)) for (d, _), s in zip(rows, sets)}


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_jaccard_components(spark, k, num):
    r = random.Random(k)
    words = [f"W{i}é" if i % 9 == 0 else f"w{i}" for i in range(2000)]
    rows = []

    def edit(base, rate):
        out = [r.choice(words) if r.random() < rate else w for w in base]
        return out[:max(1, int(len(out) * r.uniform(0.9, 1)))] if r.random() < 0.3 else out

    for n in (1, 2, 3, 5, 9, 15, 40, 120, 400, 700, 2500):
        for _ in range(6):
            base = [r.choice(words) for _ in range(n)]
            for _ in range(r.choice((1, 4))):
                rows.append((len(rows), " ".join(edit(base, r.choice((0, 0.005, 0.015, 0.03))))))
    base = [r.choice(words) for _ in range(150)]
    rows += [(len(rows) + i, "\n".join(edit(base, 0.012))) for i in range(60)]
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", " \t", "same words here", "SAME  words here", "z" * 30_000])]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("n", F.lit(1))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(df, k, num, 100).collect()}
    assert got == plain_components(rows, k, num)


def test_every_linked_pair_shares_a_signature():
    r = np.random.default_rng(8)
    for num in (80, 90):
        plan = jaccard_join.Plan(num, 100)
        for n in (3, 20, 150, 600, 1500, 5000):
            for _ in range(4):
                x = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
                both = -(-num * 2 * len(x) // (100 + num))  # just at the bar: so many stay, the others are replaced
                y = np.unique(np.append(r.permutation(x)[:both], r.integers(0, 1 << 63, len(x) - both, dtype=np.uint64)))
                if both == len(x):
                    continue
                assert 100 * both >= num * (len(x) + len(y) - both)
                sent = [set(plan.signatures(v, jaccard_join.mix(v)).tolist()) for v in (x, y)]
                assert sent[0] & sent[1]


def test_hot_signatures_are_split(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "INDEX", 7)
    monkeypatch.setattr(jaccard_join, "ASKS", 5)
    r = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    base = [r.choice(words) for _ in range(60)]
    rows = []
    for i in range(90):  # many share half of their text, some link
        own = base[:30] + [r.choice(words) for _ in range(30)] if i % 3 else base[:58] + [r.choice(words) for _ in range(2)]
        rows += [(3 * i, " ".join(own)), (3 * i + 1, " ".join(own[:-1] + ["end"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(df, 3, 90, 100).collect()}
    assert got == plain_components(rows, 3, 90)


def test_jaccard_edges(spark):
    schema = "doc_id long, text string"
    assert jaccard_join.jaccard_components(spark.createDataFrame([], schema)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "else where"), (1, None)], schema)
    got = sorted(((x.doc_id, x.component_id) for x in jaccard_join.jaccard_components(odd).collect()), key=str)
    assert got == sorted([(None, 4), (4, 4), (4, 4), (None, None), (1, 1)], key=str)


def test_tree_finds_what_a_scan_finds():
    r = np.random.default_rng(5)
    plan = jaccard_join.Plan(80, 100)
    points = r.poisson(5, (400, 16))
    points[200:] = np.maximum(points[:200] + r.integers(-1, 2, (200, 16)), 0)
    sizes = points.sum(axis=1)
    tree = jaccard_join.CountTree(points, sizes, plan)
    for q in points[::17]:
        n = int(q.sum())
        want = np.flatnonzero((np.minimum(q, points).sum(axis=1) >= plan.need(n + sizes)))
        assert sorted(tree.search(q, n).tolist()) == want.tolist()


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1080)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in parent if top(x) != x}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(3)
    words = ["".join(r.choice("aeioustnrl") for _ in range(r.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n)).capitalize() + "."
    rows = [(i, prose(r.randint(60, 200)), "en", "s", 1) for i in range(240)]
    rows += [(240 + i, " ".join([r.choice(words).upper() + "!!"] * 60), "en", "s", 1) for i in range(60)]
    rows += [(300, rows[5][1].replace(" ", "  "), "en", "s", 1), (301, rows[6][1] + " tail", "en", "s", 1), (302, prose(80) + " mail me@example.org", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1 if i < 240 else 0, 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = _common.settle(stage(spark, docs, str(tmp_path)), f"test-{name}")
        kept[name] = {x.doc_id: x for x in docs.collect()}
        if name != "packing":
            assert docs.columns == columns
    assert len(set(range(240)) & set(kept["quality"])) >= 234 and not set(range(240, 300)) & set(kept["quality"])
    assert {5, 6, 300, 301, 302} <= set(kept["quality"])
    assert set(kept["quality"]) - set(kept["exact_copies"]) == {300} and set(kept["exact_copies"]) - set(kept["near_copies"]) == {301}
    clean = kept["personal_data"][302].text
    assert "[EMAIL]" in clean and kept["personal_data"][302].n_chars == len(clean) and kept["personal_data"][5].text == rows[5][1]
    assert not any(pii.find_spans(x.text) for x in kept["personal_data"].values())
    assert set(kept["packing"]) == set(kept["personal_data"])
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(kept["packing"])


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, node string"
    good = " ".join(f"word{i} follows" for i in range(40))
    rows = [(1, good, "en", "s", 1, 9.0, "n"), (None, good, "en", "s", 1, None, None), (None, None, None, None, None, None, None), (2, None, "en", "s", 1, 1.0, "n"),
            (3, "", "en", "s", 1, 1.0, "n"), (4, good + " tail", "en", "s", 1, 1.0, "n"), (4, good + " tail", "en", "s", 1, 1.0, "n"), (5, "z " * 60_000, "en", "s", 1, 1.0, "n")]
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (77, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            if name != "packing":
                assert out.columns == table.columns
            assert out.count() <= len(rows) or name == "packing"
    table = spark.createDataFrame(rows, schema)
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    stages = dict(corpus_pipeline.STAGES)
    assert ids(stages["exact_copies"](spark, table, "")) == [1, 2, 4, 5, None, None]  # of null texts the one with an id stays, too
    assert ids(stages["near_copies"](spark, table, "")) == [1, 2, 3, 5, None, None]
    assert ids(stages["personal_data"](spark, table, "")) == ids(table)


def test_queries_return_their_contracts(spark):
    from keelson.llm import queries

    want = {"op1_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], "op2_quality": ["doc_id", "held_out", "score", "predicted"],
            "op3_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"], "op4_merge_dropout": ["doc_id"], "op6_token_counts": ["doc_id"],
            "op5_id_files": ["doc_id", "start", "n_tokens", "ids_crc32"], "op7_jaccard_join": ["doc_id", "n_shingles", "component_id"],
            "op8_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            "op9_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            "op10_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]}
    sf = "/root/testdata/sf0.001"
    size = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("documents", "pages")}
    for name, query in queries.QUERIES.items():
        out = query(spark, sf)
        assert out.columns[:len(want[name])] == want[name], name
        rows = out.collect()
        assert len(rows) == size["pages" if name == "op1_warc" else "documents"] or name == "op3_packing"
        if name == "op2_quality":
            import zlib

            assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_pages_of_one_template_are_not_paired():
    """Pages just below the bar, all of one template: the counts that travel with a signature rule nearly all pairs out."""
    r = random.Random(12)
    template = [f"t{i}" for i in range(400)]
    pages = []
    for p in range(120):
        own = list(template)
        for at in sorted(r.sample(range(400), 12)):
            own[at] = f"p{p}w{at}"
        pages.append(" ".join(own).encode())
    plan = jaccard_join.Plan(90, 100)
    index, sets = jaccard_join._Index(plan), []
    for i, x in enumerate(jaccard_join.Words(pages).shingles(3)):
        vector = jaccard_join.coarse(jaccard_join.point(x, jaccard_join.mix(x)))
        sets.append((len(x), vector, set(x.tolist())))
        index.add(i, i, len(x), vector)
    found = 0
    for i, (n, vector, own) in enumerate(sets):
        near = set(index.search(n, vector)[0].tolist()) - {i}
        linked = {j for j, s in enumerate(sets) if j != i and 190 * len(own & s[2]) >= 90 * (len(own) + len(s[2]))}
        assert linked <= near
        found += len(near - linked)
    assert found <= 0.1 * 120 * 119


def test_links_of_a_cell_are_those_of_all_pairs():
    """A group of near copies leaves its task as at most one link for each component joined, not as its pairs."""
    r = np.random.default_rng(3)
    plan, base = jaccard_join.Plan(80, 100), r.integers(0, 1 << 62, 200)
    sets = [np.unique(np.append(r.permutation(base)[:r.integers(150, 200)], r.integers(0, 1 << 62, r.integers(0, 12)))) for _ in range(120)]
    vectors = [jaccard_join.coarse(jaccard_join.point(x.astype(np.uint64), jaccard_join.mix(x.astype(np.uint64)))) for x in sets]
    rows = [(1, 0, 0, query, i, i // 2, 0, len(x), v, r.permutation(x).tolist()) for query in (False, True) for i, (x, v) in enumerate(zip(sets, vectors)) if not query or i // 2]
    names = ["sig", "block", "part", "query", "node", "comp", "main", "n", "vector", "shingles"]
    batches = [pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows[i:i + 50]))))) for i in range(0, len(rows), 50)]
    got = [(a, b) for out in jaccard_join._linked(80, 100)(iter(batches)) for a, b in zip(*(c.to_pylist() for c in out.columns))]
    linked = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= plan.need(len(sets[a]) + len(sets[b]))
    want, have = jaccard_join._Joined(), jaccard_join._Joined()
    assert all(linked(a, b) and have.join(a // 2, b // 2) for a, b in got)  # true links, each joins something
    for a in range(120):
        for b in range(a):
            if linked(a, b):
                want.join(a // 2, b // 2)
    assert [want.root(i) for i in range(60)] == [have.root(i) for i in range(60)] and 0 < len(got) < 60


def test_driver_collects_between_the_jobs_of_near_copies(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    table = spark.createDataFrame([(i, f"{'a b c d e f g h ' * 3}{i % 3} end") for i in range(9)], "doc_id long, text string")
    before = whole()
    found = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(table, k=5, num=80, den=100).collect()}
    assert len(found) == 9 and all(found[i] == found[i % 3] for i in found)
    assert whole() - before >= 11  # of the components, sets and likeliest pairs; none before
