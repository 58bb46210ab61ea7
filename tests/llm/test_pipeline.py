"""The pipeline, stage by stage, and the registered queries."""

import time

import pytest
from test_operators import plain_components, plain_fingerprint, prose

import corpus_pipeline
from burnish.llm import _shared, queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    item = " ".join(f"item{k}" for k in range(20))
    texts = [*prose(21, 40), prose(21, 40)[0], f"{prose(22, 1)[0]} {item}", f"{prose(23, 1)[0]} a.b@mail.example.com", None, ""]
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = queries.table(spark, folder, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    after = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = _shared.written(stage(spark, docs, folder), name)
        assert docs.columns == columns
        after.append({r.doc_id: r.text for r in docs.collect()})
    assert after[0] == texts  # no bad labels: nothing is rejected
    ids = sorted(texts)
    roots = plain_components([plain_fingerprint(texts[k]) for k in ids])
    assert sorted(after[1]) == sorted({ids[r] for r in roots})
    assert set(after[1]) - set(after[2]) == {41}
    assert set(after[3]) == set(after[2]) and "a.b@" not in after[3][42] and {k for k in after[3] if after[3][k] != after[2][k]} == {42}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == set(after[3])
    assert len(corpus_pipeline.run(spark, folder).collect()) == len(packed)


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_near_duplicates_are_found(spark):
    """Copies with a word changed in every hundred go, texts below 0.8 stay."""
    base = [" ".join(f"d{k}w{i}" for i in range(300)) for k in range(8)]

    def edited(text, step):
        return " ".join("new" if i % step == step // 2 else w for i, w in enumerate(text.split()))

    texts = [*base, *(edited(t, 100) for t in base), *(edited(t, 40) for t in base)]

    def grams(text):
        words = text.split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    def alike(a, b):
        return len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.8

    assert alike(base[0], texts[8]) and not alike(base[0], texts[16])
    docs = spark.createDataFrame([*((k, t) for k, t in enumerate(texts)), (None, texts[8]), (None, "alone"), (3, "other text")], "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert {(r.doc_id, r.text) for r in kept} == {*((k, texts[k]) for k in [*range(8), *range(16, 24)]), (None, "alone"), (3, "other text")}
    assert len(kept) == 18


def test_near_duplicates_by_broadcast_or_shuffle(spark, monkeypatch):
    """Both ways to fetch the texts to compare keep the same rows, null and zero ids apart."""
    from burnish.llm import jaccard

    base = prose(11, 6, vocabulary=5000, length=200)
    edited = [f"{t} and one end more" for t in base]
    rows = [(k, t) for k, t in enumerate(base + edited)] + [(None, base[0]), (None, "alone"), (0, "alone too"), (3, base[3]), (20, None), (21, "")]
    kept = []
    for most in (jaccard.BROADCAST_BYTES, -1):
        monkeypatch.setattr(jaccard, "BROADCAST_BYTES", most)
        out = jaccard.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        kept.append(sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out))
    assert kept[0] == kept[1]
    assert kept[0] == sorted([(False, k, t) for k, t in enumerate(base)] + [(True, 0, "alone"), (False, 0, "alone too"), (False, 20, "")])


def test_written_tables_leave_no_shuffle_files(spark):
    """A written table's shuffle files go when it is written, and the session's setting stays."""
    from pyspark.sql import functions as F

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
        return {f.rsplit("/", 1)[1] for f in files.split() if "/shuffle_" in f}

    before, setting = shuffled(), spark.conf.get(_shared.CLEANUP, None)
    out = _shared.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    for _ in range(50):  # removal isn't awaited by Spark
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(_shared.CLEANUP, None) == setting
    assert sorted(map(tuple, out.collect())) == [(k, 143 if k < 6 else 142) for k in range(7)]


def test_near_duplicates_come_through_fingerprints(spark):
    """Without a radius only equal sets meet; with it the trees find what brute force finds."""
    import numpy as np

    from burnish.llm import jaccard, simhash

    base = prose(11, 4, vocabulary=5000, length=200)
    docs = spark.createDataFrame([*enumerate([*base, *(f"{t} and one end more" for t in base), base[0]])], "doc_id long, text string")
    assert {r.doc_id for r in jaccard.representatives(docs).collect()} == {0, 1, 2, 3}
    assert {r.doc_id for r in jaccard.representatives(docs, radius=-1).collect()} == set(range(8))

    values = jaccard.shingles(base[0].encode())
    ones = [sum(int(v) >> k & 1 for v in values) for k in range(64)]
    assert jaccard.fingerprint(values) % (1 << 64) == sum(1 << k for k in range(64) if 2 * ones[k] > len(values))
    rng = np.random.default_rng(5)
    group = np.sort(rng.integers(0, 9, 200))
    prints = rng.integers(0, 1 << 64, 3, np.uint64, endpoint=False)[rng.integers(0, 3, 200)] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    for radius in (0, 2, 28, 40):
        want = set()
        for g in set(group.tolist()):
            tree, places = simhash.BKTree(), np.flatnonzero(group == g).tolist()
            for k in places:
                tree.add(int(prints[k]))
            near = {k: set(tree.within(int(prints[k]), radius)) for k in places}
            want |= {(a, b) for a in places for b in places if int(prints[b]) in near[a]}
        a, b = jaccard.Forest(group, prints).within(group, prints, radius)
        assert len(a) == len(want) and set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_unlike_texts_that_share_shingles_go_no_further(spark):
    """Places in shards where a text finds none like it aren't carried on."""
    from burnish.llm import jaccard

    texts = [f"{t} five words they all share" for t in prose(12, 12, vocabulary=5000, length=300)]
    texts += [f"{texts[0]} and one end more"]
    rows = []
    for k, text in enumerate(texts):
        values = jaccard.shingles(text.encode())
        shared = jaccard.shingles(b"five words they all share")
        rows.append((k, len(values), jaccard.fingerprint(values), [int(x) for x in sorted({*jaccard.prefix(values, shared[:0]).view("int64").tolist(), *shared.view("int64").tolist()})]))
    found = jaccard.shared(spark.createDataFrame(rows, "key long, n int, fp long, prefix array<long>"), 12).collect()
    assert {r.key for r in found} == {0, 12} and len(found) > 20


def near_copies(seed, n, edits, name="b"):
    """Copies of one text with some words replaced, each by a word of its own."""
    import random

    rng, out = random.Random(seed), []
    for k in range(n):
        words = [f"{name}{i}" for i in range(150)]
        for place in rng.sample(range(150), rng.choice(edits)):
            words[place] = f"{name}{place}x{k}"
        out.append(" ".join(words))
    return out


def rows_written(monkeypatch):
    """The name and number of rows of each table that is written from now on."""
    made, written = [], _shared.written

    def told(df, name):
        out = written(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(_shared, "written", told)
    return made


def test_large_groups_of_near_copies_make_few_rows(spark, monkeypatch):
    """Texts that are almost similar to all of a large group make no row for each pair."""
    from burnish.llm import jaccard

    made, n = rows_written(monkeypatch), 400
    docs = spark.createDataFrame([*enumerate(near_copies(3, n, (2, 3, 4, 5)))], "doc_id long, text string")
    jaccard.classes(docs).count()
    assert max(rows for name, rows in made if name != "frequent") <= 6 * n


def test_farther_pairs_come_in_later_rounds(spark, monkeypatch):
    """However few pairs a round takes, the groups are those of all similar pairs."""
    from burnish.llm import jaccard

    texts = [t for k in range(2) for t in near_copies(k, 70, (1, 2, 3, 4), f"b{k}w")]
    sets = [set(jaccard.shingles(t.encode()).tolist()) for t in texts]
    root = list(range(len(texts)))
    for a, one in enumerate(sets):
        for b in range(a):
            if 5 * len(one & sets[b]) >= 4 * len(one | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    assert 2 < len(set(root)) < len(root) - 20
    monkeypatch.setattr(jaccard, "NEAREST", 1)
    monkeypatch.setattr(jaccard, "FARTHER", 4)
    made = rows_written(monkeypatch)
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.representatives(docs).collect()) == sorted(set(root))
    assert sum(name == "pairs" for name, _ in made) > 2
