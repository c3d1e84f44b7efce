"""Near-duplicate operators and components against brute force."""

import math
import random
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.functions.pixels import encode_pnm, encode_png, resized
from pixelframe.llm import embedding_dedup, image_copies, minhash_dedup
from pixelframe.llm.linkage import block_counts, blocked, components
from pixelframe.llm.runtime import Workspace
from tests.llm.conftest import words


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(3)
    links = {"chain": [(i, i + 1) for i in range(300)], "star": [(7, i) for i in range(300) if i != 7], "random": [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(350)], "none": []}[shape]
    rng.shuffle(links)
    frame = spark.createDataFrame(links, "a long, b long").repartition(5)
    found = {r["id"]: r["root"] for r in components(Workspace(spark, "t"), frame).collect()}
    nodes = {n for link in links if link[0] != link[1] for n in link}
    assert found == {n: r for n, r in roots(nodes, links).items()}


def test_blocks_let_every_pair_meet_once(spark):
    members = spark.createDataFrame([(1, i, i) for i in range(50)] + [(2, 99, 99)], "bucket long, node long, salt long")
    met = blocked(members.join(block_counts(members, block=8), "bucket", "left")).collect()
    groups = {}
    for r in met:
        groups.setdefault((r["bucket"], r["i"], r["j"]), []).append(r)
    pairs = [(a["node"], b["node"]) for (_, i, j), g in groups.items() for a in g for b in g if a["node"] < b["node"] and (i == j or a["own"] != b["own"])]
    assert sorted(pairs) == [(a, b) for a in range(50) for b in range(a + 1, 50)]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(120, 24))
    rows = [c for c in centres]
    for k in range(600):  # a hot group, small groups, links near the threshold
        c = centres[0 if k % 3 == 0 else k % 120]
        rows.append(c + rng.normal(size=24) * rng.choice([0.05, 0.25, 0.45]))
    rows += [rows[0]] * 40 + [rows[1] * 3.0]
    return [r.astype(np.float32).tolist() for r in rows]


def test_vectors_by_brute_force(spark, vectors):
    bad = [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] * 24, [None] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, v, i % 3) for i, v in enumerate(vectors)] + [(5000 + i, v, 0) for i, v in enumerate(bad)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    found = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(frame).collect()}
    m = np.array(vectors, dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= embedding_dedup.COSINE
    np.fill_diagonal(near, False)
    got = np.array([found[i]["n_links"] for i in range(len(vectors))])
    true = near.sum(axis=1)
    assert (got <= true).all() and got.sum() >= 0.99 * true.sum()
    expected = roots(range(len(vectors)), zip(*(x.tolist() for x in np.nonzero(near))))
    assert np.mean([found[i]["component_id"] == r for i, r in expected.items()]) > 0.99
    assert [found[5000 + i]["n_links"] for i in range(8)] == [0, 0, 0, 0, 0, 0, 1, 1]
    assert found[5007]["component_id"] == 5006 and not found[5007]["kept"] and found[5000]["kept"]
    assert all(r["kept"] == (r["component_id"] == i) for i, r in found.items())


def test_vectors_repeated_null_and_none(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.1]), (None, [0.0, 1.0])], "vec_id long, embedding array<double>")
    found = sorted(map(tuple, embedding_dedup.near_duplicates(frame).collect()), key=str)
    assert found == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, True)], key=str)
    assert embedding_dedup.near_duplicates(frame.where("false")).count() == 0


@pytest.mark.parametrize("dimension", [64, 256])
def test_tables_miss_few_vectors(dimension):
    k, tables = embedding_dedup.tables_for(1_000_000, dimension)
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(2, 1500, dimension))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(0.19) * b / np.linalg.norm(b, axis=1, keepdims=True)
    hasher = embedding_dedup.CrossPolytope(dimension, k, 4, seed=1)
    x, y = hasher.codes(a), hasher.codes(b)
    found = ((y == x[:, :, :1]).any(axis=2) | (x == y[:, :, :1]).any(axis=2)).mean()
    assert (1 - found) ** tables <= 1.5 * embedding_dedup.MISS


def text_groups(docs, damping=minhash_dedup.DAMPING):
    weigh = None
    profiles = {}
    counts = {}
    for i, t in docs:
        profiles[i] = minhash_dedup.shingles((t or "").encode())
        for h in profiles[i][0].tolist():
            counts[h] = counts.get(h, 0) + 1
    heavy = sorted(h for h, n in counts.items() if n >= minhash_dedup.HEAVY * len(docs))
    weigh = minhash_dedup.Weights(np.array(heavy, dtype=np.uint64), np.array([counts[h] for h in heavy], dtype=float), len(docs), damping)
    weighted = {i: (h, weigh.damped(h, c)) for i, (h, c) in profiles.items()}
    ids = sorted(weighted)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if minhash_dedup.weighted_jaccard(weighted[a], weighted[b]) >= minhash_dedup.SIMILARITY]
    texts = {}
    for i, t in docs:
        texts.setdefault(t or "", []).append(i)
    links += [(g[0], x) for g in texts.values() for x in g[1:]]
    return roots(ids, links)


def test_texts_by_brute_force(spark, docs, rows):
    rng = random.Random(8)
    base = words(rng, 90)
    extra = []
    for k in range(60):  # one hot group of near copies, each changed elsewhere
        copy = list(base)
        copy[rng.randrange(90)] = f"q{k}"
        extra.append((2000 + k, " ".join(copy), None, None, None, 0.0, ""))
    passage = " ".join(words(rng, 60))
    extra += [(3000 + k, " ".join(words(rng, 150)) + " " + passage, None, None, None, 0.0, "") for k in range(25)]
    extra += [(4000, "few words", None, None, None, 0.0, ""), (4001, "Few, WORDS!", None, None, None, 0.0, "")]
    frame = docs.union(spark.createDataFrame(extra, docs.schema))
    found = minhash_dedup.near_duplicates(frame).collect()
    known = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    expected = text_groups({(r[0], r[1]) for r in [*rows, *extra] if r[0] is not None})
    assert {i: r["component_id"] for i, r in known.items()} == expected
    assert all(r["kept"] == (i == r["component_id"]) for i, r in known.items())
    assert len(found) == len(rows) + len(extra)
    assert [(r["component_id"], r["kept"]) for r in found if r["doc_id"] is None] == [(None, True)] * 2
    assert len({known[3000 + k]["component_id"] for k in range(25)}) == 25
    kept = minhash_dedup.deduplicate(frame)
    assert kept.columns == frame.columns
    left = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert left == sorted([*{*expected.values()}, None, None], key=str)


def test_pairs_that_share_mostly_a_common_passage(spark, docs):
    passage = [f"p{k}" for k in range(79)]
    texts = [(2 * k + side, " ".join(passage + [f"s{k}x{j}" for j in range(5)] + [f"o{k}x{side}x{j}" for j in range(8)])) for k in range(60) for side in (0, 1)]
    texts += [(1000 + k, " ".join(f"f{k}x{j}" for j in range(30))) for k in range(240)]
    expected = text_groups(texts)
    assert sum(expected[2 * k + 1] == 2 * k for k in range(60)) == 60
    frame = spark.createDataFrame([(i, t, None, None, None, 0.0, "") for i, t in texts], docs.schema)
    found = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(frame).collect()}
    assert sum(found[2 * k + 1] == 2 * k for k in range(60)) == 60
    assert found == expected


def test_full_strength_by_brute_force(spark, docs):
    """Plain TF-IDF: equal bodies with different boilerplate that a third of all texts hold are linked, which damped weights leave apart."""
    rng = random.Random(23)
    boilerplate = [" ".join(f"b{k}x{j}" for j in range(24)) for k in range(3)]
    texts = []
    for k in range(100):
        body = " ".join(words(rng, 110))
        texts += [(3 * k, body + " " + boilerplate[k % 3]), (3 * k + 1, body + " " + boilerplate[(k + 1) % 3]), (3 * k + 2, " ".join(words(rng, 60)) + " " + boilerplate[(k + 2) % 3])]
    frame = spark.createDataFrame([(i, t, None, None, None, 0.0, "") for i, t in texts], docs.schema)
    found = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(frame, damping=1.0).collect()}
    expected = text_groups(texts, 1.0)
    assert sum(expected[3 * k + 1] == 3 * k for k in range(100)) == 100
    missed = [i for i in found if found[i] != expected[i]]
    assert len(missed) <= 1 and all(found[i] == i for i in missed)  # bands find 99.9 of 100 pairs at 0.82
    damped = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(frame).collect()}
    assert damped == text_groups(texts) and all(i == c for i, c in damped.items())


def test_texts_of_nothing(empty):
    assert minhash_dedup.near_duplicates(empty).count() == 0 and minhash_dedup.deduplicate(empty).count() == 0


def test_long_texts_hash_alike(monkeypatch):
    text = " ".join(words(random.Random(1), 400)).encode()
    whole = minhash_dedup.word_hashes(text)
    monkeypatch.setattr(minhash_dedup, "_PIECE", 64)
    assert np.array_equal(minhash_dedup.word_hashes(text), whole)
    assert len(whole) == 400 and len(set(whole.tolist())) == len(set(text.split()))


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    sampler = minhash_dedup.Sampler(samples=2000)
    hashes = np.sort(rng.integers(0, 2**63, 300, dtype=np.uint64))
    a, b = hashes[:220], hashes[60:]
    wa, wb = rng.uniform(0.5, 8, 220), rng.uniform(0.5, 8, 240)
    true = minhash_dedup.weighted_jaccard((a, wa), (b, wb))
    assert abs((sampler(a, wa) == sampler(b, wb)).mean() - true) < 0.04


def picture(seed: int, height: int = 150, width: int = 190) -> np.ndarray:
    rng = np.random.default_rng(seed)
    coarse = rng.normal(size=(height // 6 + 1, width // 6 + 1, 3))
    y, x = np.mgrid[:height, :width]
    image = np.stack([image_copies._at(coarse[:, :, c], y / 6, x / 6) for c in range(3)], axis=2)
    return ((image - image.min()) / np.ptp(image) * 255).astype(np.uint8)


def test_edited_and_cropped_pictures(spark):
    rows, expected = [], {}
    for k in range(5):
        image = picture(k)
        noisy = np.clip(image + np.random.default_rng(k).normal(0, 4, image.shape), 0, 255).astype(np.uint8)
        versions = [image, image[12:140, 20:180], np.clip(image * 0.8 + 25, 0, 255).astype(np.uint8), noisy, np.ascontiguousarray(np.rot90(image)), resized(image, 150, 118)]
        for v, version in enumerate(versions):
            rows.append((10 * k + v, encode_png(np.ascontiguousarray(version)), "x"))
            expected[10 * k + v] = 10 * k
    rows += [(900, None, ""), (901, b"", ""), (902, b"\x89PNG broken", ""), (903, encode_png(np.zeros((40, 40, 1), dtype=np.uint8)), ""), (904, encode_png(np.zeros((40, 40, 1), dtype=np.uint8)), ""), (None, rows[0][1], "")]
    expected |= {900: 900, 901: 900, 902: 902, 903: 903, 904: 903}
    frame = spark.createDataFrame(rows, "image_id long, image binary, component_id string").repartition(3)
    found = image_copies.copies(frame).collect()
    known = {r["image_id"]: r["component_id"] for r in found if r["image_id"] is not None}
    wrong = {i for i, c in known.items() if c != expected[i]}
    assert len(wrong) <= 2 and all(known[i] == i for i in wrong)  # a hard crop may stay alone; nothing is linked wrongly
    assert len(found) == len(rows)
    assert image_copies.copies(frame.where("false")).count() == 0


def turned(image: np.ndarray, degrees: float) -> np.ndarray:
    h, w = image.shape[:2]
    y, x = np.mgrid[:h, :w] - np.array([h / 2, w / 2]).reshape(2, 1, 1)
    cos, sin = np.cos(np.deg2rad(degrees)), np.sin(np.deg2rad(degrees))
    return np.stack([image_copies._at(image[:, :, c].astype(float), h / 2 + y * cos + x * sin, w / 2 + x * cos - y * sin) for c in range(3)], axis=2).astype(np.uint8)


EDITS = {
    "turned by 10": lambda m, k: turned(m, 10), "turned by 25": lambda m, k: turned(m, 25), "turned by 45": lambda m, k: turned(m, 45),
    "halved": lambda m, k: np.stack([image_copies._halved(m[:, :, c].astype(float)) for c in range(3)], axis=2).astype(np.uint8),
    "cropped": lambda m, k: m[22:127, 28:161],
    "noisy": lambda m, k: np.clip(m + np.random.default_rng(k).normal(0, 24, m.shape), 0, 255).astype(np.uint8),
}


def accepted(a, b) -> bool:
    return max(image_copies.agreeing(a, b), image_copies.agreeing(b, a)) >= image_copies.AGREE


def test_pictures_by_brute_force(spark):
    """All pairs, verified one by one, whether they share a bucket or not."""
    pictures = []
    for k in range(8):
        image = picture(k)
        pictures += [("original", k, image)] + [(name, k, edit(image, k)) for name, edit in EDITS.items()]
    packed = [image_copies._unpack(image_copies._pack(*image_copies.features(m))) for _, _, m in pictures]
    links = [(a, b) for a in range(len(pictures)) for b in range(a + 1, len(pictures)) if accepted(packed[a], packed[b])]
    assert all(pictures[a][1] == pictures[b][1] for a, b in links)
    shared = {pair: len(np.intersect1d(image_copies.keys(packed[pair[0]][1]), image_copies.keys(packed[pair[1]][1]))) for pair in links}
    for name in EDITS:
        own = [pair for pair in links if pictures[pair[0]][0] == "original" and pictures[pair[1]][0] == name]
        assert len(own) >= 4 and sum(shared[pair] >= image_copies.COMMON for pair in own) >= 0.9 * len(own), name
    assert sum(n >= image_copies.COMMON for n in shared.values()) >= 0.85 * len(links)  # two edited copies of one original are edits of edits
    blobs = [encode_png(np.ascontiguousarray(m)) for _, _, m in pictures]
    found = {r["image_id"]: r["component_id"] for r in image_copies.copies(spark.createDataFrame(list(enumerate(blobs)), "image_id long, image binary").repartition(3)).collect()}
    expected = roots(range(len(pictures)), links)
    assert sum(found[i] != expected[i] for i in found) <= 2


def test_keys_of_descriptors():
    rng = np.random.default_rng(6)
    words = rng.integers(0, 2**63, (5, 4), dtype=np.uint64)
    assert len(image_copies.keys(words)) == 30 and len(image_copies.keys(np.concatenate((words, words)))) == 30
    other = words.copy()
    other.view(np.uint8)[:, [0, 7, 12, 31]] ^= 1  # three of the six pieces differ; the last byte is in none
    assert len(np.intersect1d(image_copies.keys(words), image_copies.keys(other))) == 15
    assert len(image_copies.keys(words[:0])) == 0


@pytest.mark.parametrize(("dimension", "n"), [(64, 900), (384, 700), (768, 500)])
def test_links_of_vectors_by_length(spark, dimension, n):
    """Pairs a little above the threshold among others: at least 99 of 100 are found."""
    rng = np.random.default_rng(dimension)
    base = rng.normal(size=(n, dimension))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.normal(size=(n, dimension))
    other -= (base * other).sum(axis=1, keepdims=True) * base
    other = 0.905 * base + np.sqrt(1 - 0.905**2) * other / np.linalg.norm(other, axis=1, keepdims=True)
    rows = [(i, v) for i, v in enumerate(np.concatenate((base, other)).tolist())]
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    assert sum(r["n_links"] > 0 for r in found) >= 0.99 * 2 * n
    assert all(r["component_id"] == r["vec_id"] % n for r in found if r["n_links"])


def test_sketches_pass_pairs_at_the_threshold():
    rng = np.random.default_rng(4)
    for dimension in (3, 24, 64, 300):
        a, b = rng.normal(size=(2, 3000, dimension))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b = 0.9 * a + np.sqrt(0.19) * b / np.linalg.norm(b, axis=1, keepdims=True)
        sketcher = embedding_dedup.Sketcher(dimension)
        differ = np.bitwise_count(sketcher(a) ^ sketcher(b)).sum(axis=1)
        assert (differ <= sketcher.most(0.9)).all()


def test_crops_and_rescales_of_large_pictures(spark):
    rows, expected = [], {}
    for k in range(2):
        image = picture(100 + k, 700, 900)
        versions = [image, image[35:665, 45:855], image[101:451, 203:653], image[201:411, 303:573], resized(image, 630, 490), resized(image, 225, 175)]
        for v, version in enumerate(versions):
            rows.append((10 * k + v, encode_png(np.ascontiguousarray(version))))
            expected[10 * k + v] = 10 * k
    found = image_copies.copies(spark.createDataFrame(rows, "image_id long, image binary").repartition(3)).collect()
    assert {r["image_id"]: r["component_id"] for r in found} == expected


def test_long_matches_in_parts(monkeypatch):
    image = picture(3)
    a, b = image_copies.features(image), image_copies.features(image[12:140, 20:180])
    whole = image_copies.agreeing(a, b)
    monkeypatch.setattr(image_copies, "CELLS", 300)
    monkeypatch.setattr(image_copies, "STRIP", 40)
    again = image_copies.features(image)
    assert np.array_equal(a[0], again[0]) and np.array_equal(a[1], again[1])
    assert image_copies.agreeing(a, b) == whole >= image_copies.AGREE


def test_pictures_are_written_once(spark, monkeypatch):
    """Of all tables only one holds descriptors, and shuffles go when a later step needs them no more."""
    sizes, held, write = {}, [], Workspace.write

    def measured(self, frame, label):
        out = write(self, frame, label)
        sizes[out._pixelframe_path] = sum(f.stat().st_size for f in Path(out._pixelframe_path.removeprefix("file://")).glob("*.parquet"))
        return out

    class Counted(Workspace):
        def release(self):
            super().release()
            held.append(self)

    monkeypatch.setattr(Workspace, "write", measured)
    monkeypatch.setattr(image_copies, "Workspace", Counted)
    rows = [(i, encode_png(picture(200 + i, 70, 80))) for i in range(30)]
    assert image_copies.copies(spark.createDataFrame(rows, "image_id long, image binary").repartition(2)).count() == 30
    described = next(n for path, n in sizes.items() if path.endswith("-described"))
    classes = next(n for path, n in sizes.items() if path.endswith("-classes"))
    assert classes < described / 10 and len(held) >= 3


def test_shuffles_of_written_tables_go(spark):
    work, cleaned = Workspace(spark, "t"), []
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    written = work.write(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "t")
    for _ in range(50):
        work.release()
        cleaned.append(tracker.shuffleStatuses().size())
        if cleaned[-1] <= before:
            break
        time.sleep(0.2)
    assert cleaned[-1] <= before and written.count() == 7


def test_rendered_vectors(spark):
    frame = spark.createDataFrame([(1, [0.5, -1.0, 2.0, 0.1]), (2, None), (3, [float("nan")])], "vec_id long, embedding array<float>")
    found = {r["image_id"]: r["image"] for r in image_copies.rendered_embeddings(frame).collect()}
    assert found[1].startswith(b"P5") and found[2] is None and found[3] is None


def test_heavy_shingles_are_counted_exactly(spark, monkeypatch):
    """However tasks hand over, what is in more than HEAVY of the documents shows with its exact count."""
    monkeypatch.setattr(minhash_dedup, "HEAVY", 0.02)
    rng = random.Random(17)
    passages = [" ".join(words(rng, 8)) for _ in range(12)]
    data = [(i, " ".join(words(rng, 10)) + " | " + passages[min(11, int(rng.expovariate(0.5)))]) for i in range(900)]
    counts = {}
    for _, t in data:
        for h in minhash_dedup.shingles(t.encode())[0].tolist():
            counts[h] = counts.get(h, 0) + 1
    expected = {h: n for h, n in counts.items() if n > 18}
    docs = spark.createDataFrame([(t.encode(),) for _, t in data], "raw binary").repartition(7)
    for held in (8_000_000, 700):
        monkeypatch.setattr(minhash_dedup, "HELD", held)
        found = minhash_dedup.heavy_shingles(docs, 900, sum(len(t) for _, t in data))
        assert dict(zip(found.heavy.tolist(), np.log1p(np.minimum(900 / np.array([expected[h] for h in found.heavy.tolist()]), 50)).tolist())) == pytest.approx(dict(zip(found.heavy.tolist(), found.idf.tolist())))
        assert set(found.heavy.tolist()) == set(expected)


def test_every_shingle_is_counted(spark, monkeypatch):
    """Exact document frequencies of rare shingles too, however blocks and ranges are cut; copies and repeated rows count."""
    monkeypatch.setattr(minhash_dedup, "HEAVY", 0.05)
    rng = random.Random(31)
    passages = [" ".join(words(rng, 9)) for _ in range(40)]
    data = [(i, " ".join(words(rng, 12)) + " | " + passages[min(39, int(rng.expovariate(0.1)))]) for i in range(400)] + [(1000 + i, passages[i % 3]) for i in range(9)] + [(2000, ""), (2001, "one two"), (2001, "one two")]
    counts = {}
    for _, t in data:
        for h in minhash_dedup.shingles(t.encode())[0].tolist():
            counts[h] = counts.get(h, 0) + 1
    docs = spark.createDataFrame([(i, t.encode()) for i, t in data], "doc_id long, raw binary").repartition(3)
    docs = docs.select("doc_id", *minhash_dedup._text_key("raw"), "raw")
    for block, size in ((1_000_000, 1 << 24), (300, 5_000)):
        monkeypatch.setattr(minhash_dedup, "BLOCK_SHINGLES", block)
        monkeypatch.setattr(minhash_dedup, "RANGE_BYTES", size)
        total = sum(len(t) for _, t in data)
        weights = minhash_dedup.heavy_shingles(docs, len(data), total)
        assert 0 < len(weights.heavy) < len([h for h, n in counts.items() if n > 1])
        found = minhash_dedup._signed(docs, weights, total).collect()
        assert sorted(r["doc_id"] for r in found) == sorted(i for i, _ in data)
        texts = dict(data)
        for r in found:
            hashes = minhash_dedup.shingles(texts[r["doc_id"]].encode())[0]
            assert minhash_dedup._widen(r["frequency"], len(hashes), "<u4").tolist() == [counts[h] for h in hashes.tolist()]


def test_signing_takes_no_longer_in_large_blocks(spark, monkeypatch):
    """Each text of a block is found without reading the whole block."""
    rng = np.random.default_rng(6)
    data = [(i, " ".join(map(str, rng.integers(0, 1 << 40, 129).tolist())).encode()) for i in range(8_000)]
    docs = spark.createDataFrame(data, "doc_id long, raw binary").coalesce(1).select("doc_id", *minhash_dedup._text_key("raw"), "raw").cache()
    weights = minhash_dedup.Weights(np.empty(0, dtype=np.uint64), np.empty(0), docs.count())
    seconds = {}
    for block in (20_000, 2_000_000) * 2:
        monkeypatch.setattr(minhash_dedup, "BLOCK_SHINGLES", block)
        start = time.perf_counter()
        signed = minhash_dedup._signed(docs, weights, 1 << 24).select(F.count("*"), F.sum("bytes")).first()
        seconds[block] = min(time.perf_counter() - start, seconds.get(block, math.inf))
        assert tuple(signed) == (8_000, 8_000 * (8 * minhash_dedup.BANDS + 12 * 125))
    docs.unpersist()
    assert seconds[2_000_000] < 2 * seconds[20_000], seconds


def test_links_by_frequencies_of_rare_shingles(spark, docs, monkeypatch):
    """With one weight for all shingles of at most HEAVY of the texts, the first pairs would be linked and the others not."""
    tails = [" ".join(f"t{k}x{j}" for j in range(14)) for k in range(5)]
    texts = []
    for k in range(30):
        shared, body = " ".join(f"s{k}x{j}" for j in range(45)), " ".join(f"b{k}x{j}" for j in range(104))
        texts += [(10 * k + side, shared + " " + " ".join(f"o{k}x{side}x{j}" for j in range(5))) for side in (0, 1)]
        texts += [(10 * k + 2 + side, body + " " + tails[(k + side) % 5]) for side in (0, 1)]
    texts += [(1000 + k, " ".join(f"f{k}x{j}" for j in range(30))) for k in range(280)]
    expected = text_groups(texts, 1.0)
    assert all(expected[10 * k + 1] == 10 * k + 1 and expected[10 * k + 3] == 10 * k + 2 for k in range(30))
    monkeypatch.setattr(minhash_dedup, "HEAVY", 0.05)
    frame = spark.createDataFrame([(i, t, None, None, None, 0.0, "") for i, t in texts], docs.schema)
    assert {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(frame, damping=1.0).collect()} == expected


def test_dense_buckets_are_cut_by_longer_keys(spark):
    """Buckets with ever more unlike images don't make ever more pairs; images whose longer keys agree too still meet."""
    from pixelframe.llm.linkage import pairs_across, sparse_meetings
    from pixelframe.llm.runtime import Workspace

    def pairs(n):
        work = Workspace(spark, "dense")
        rows = spark.range(n).selectExpr("id AS node", "id % 4 AS bucket", "CAST(id / 8 AS LONG) AS step0", "CAST(id % 8 / 4 AS LONG) AS step1")
        found = sparse_meetings(work, rows.select("bucket", "node"), lambda: rows, ["step0", "step1"], spark.createDataFrame([], "id long, root long"), 0.4)
        return {(r["a"], r["b"]) for r in pairs_across(found).collect()}

    assert not pairs(400)  # 19,800 pairs by the short keys
    work = Workspace(spark, "dense")
    rows = spark.range(400).selectExpr("id AS node", "id % 4 AS bucket", "id % 4 + CAST(id / 8 AS LONG) * 4 AS step0", "0L AS step1")
    found = sparse_meetings(work, rows.select("bucket", "node"), lambda: rows, ["step0", "step1"], spark.createDataFrame([], "id long, root long"), 0.4)
    assert {(r["a"], r["b"]) for r in pairs_across(found).collect()} == {(i, i + 4) for i in range(400) if i % 8 < 4}


def test_long_keys_extend_short_ones():
    words = np.random.default_rng(8).integers(0, 2**63, (5, 4), dtype=np.uint64)
    for order in (0, 1):
        buckets, steps = image_copies.long_keys(words, order)
        assert np.array_equal(np.unique(buckets), image_copies.keys(words, order)) and steps.shape == (30, len(image_copies.LONGER))
    assert not len(np.intersect1d(image_copies.keys(words), image_copies.keys(words, 1)))
    other = words.copy()
    other.view(np.uint8)[:, 5] ^= 1  # the byte after the first piece, the first of the second
    short = np.intersect1d(image_copies.keys(words), image_copies.keys(other))
    assert len(short) == 25


def test_only_members_of_dense_buckets_get_longer_keys(spark):
    """Keys of all members were lengthened and shuffled, though few buckets are cut."""
    from pixelframe.llm.linkage import cut_meetings, pairs_across
    from pixelframe.llm.runtime import Workspace

    told = []

    def longer(members):
        told.extend((r["bucket"], r["node"]) for r in members.collect())
        return members.withColumn("step0", F.col("node") % 10)

    sparse = spark.range(100).selectExpr("CAST(id / 2 AS LONG) AS bucket", "id AS node")
    dense = spark.range(20).selectExpr("-1L AS bucket", "id AS node")
    found = cut_meetings(Workspace(spark, "cut"), [sparse, dense], longer, ["step0"], spark.createDataFrame([(19, 9)], "id long, root long"), 1.5)
    assert sorted(told) == [(-1, i) for i in range(20)]
    expected = {(2 * i, 2 * i + 1) for i in range(50)} | {(i, i + 10) for i in range(9)}  # 9 and 19 are linked already
    assert {(r["a"], r["b"]) for r in pairs_across(found).collect()} == expected


def test_long_keys_of_wanted_buckets():
    words = np.random.default_rng(9).integers(0, 2**63, (5, 4), dtype=np.uint64)
    buckets, steps = image_copies.long_keys(words, 1)
    some, own = image_copies.long_keys(words, 1, buckets[::3])
    assert np.array_equal(some, buckets[::3]) and np.array_equal(own, steps[::3])
    assert not len(image_copies.long_keys(words, 0, buckets)[0])


def test_described_pictures_hold_no_keys(spark, monkeypatch):
    """Keys follow from descriptors; written beside them they doubled the table."""
    columns, write = {}, Workspace.write
    monkeypatch.setattr(Workspace, "write", lambda self, frame, label: columns.setdefault(label, frame.columns) and write(self, frame, label))
    assert image_copies.copies(spark.createDataFrame([(i, encode_png(picture(300 + i, 70, 80))) for i in range(3)], "image_id long, image binary")).count() == 3
    assert columns["described"] == ["image_id", "t1", "t2", "n_corners", "payload", "node"]


def test_every_pair_with_common_keys_is_verified(spark, monkeypatch):
    """Pairs in buckets of many unlike images were left out where their longer keys differed."""
    met, described, write = set(), {}, Workspace.write

    def seen(self, frame, label):
        out = write(self, frame, label)
        if label in ("pairs", "shared", "across-pairs"):
            met.update((min(r["a"], r["b"]), max(r["a"], r["b"])) for r in out.collect())
        if label == "described":
            described.update({r["node"]: (r["image_id"], r["payload"]) for r in out.collect()})
        return out

    monkeypatch.setattr(Workspace, "write", seen)
    monkeypatch.setattr(image_copies, "MET", 10, raising=False)  # several rounds
    rng = np.random.default_rng(12)
    rows = [(i, encode_pnm(image_copies.rendering(rng.normal(size=64)))) for i in range(500)]
    found = {r["image_id"]: r["component_id"] for r in image_copies.copies(spark.createDataFrame(rows, "image_id long, image binary").repartition(4)).collect()}
    buckets, common = defaultdict(list), Counter()
    for node in sorted(described):
        words = image_copies._unpack(described[node][1])[1]
        for bucket in np.concatenate([image_copies.keys(words, order) for order in (0, 1)]).tolist() if len(words) >= image_copies.AGREE else ():
            buckets[bucket].append(node)
    for members in buckets.values():
        common.update((a, b) for k, a in enumerate(members) for b in members[k + 1 :])
    component = {node: found[image_id] for node, (image_id, _) in described.items()}
    wanted = {pair for pair, n in common.items() if n >= image_copies.COMMON and component[pair[0]] != component[pair[1]]}
    assert max(map(len, buckets.values())) >= 8 and len(wanted) > 100 and not wanted - met


@pytest.mark.parametrize("at_once", [10**9, 2_000])
def test_rounds_give_every_shared_pair_once(spark, at_once):
    from pixelframe.llm.linkage import shared_pairs, whole_meetings

    rng = np.random.default_rng(13)
    members = {(int(b), int(n)) for b, n in zip(rng.integers(0, 12, 2_000), rng.integers(0, 400, 2_000))} | {(99, n) for n in range(300)}
    roots = {n: n - n % 3 for n in range(90)}
    frame = spark.createDataFrame(sorted(members), "bucket long, node long")
    work = Workspace(spark, "rounds")
    whole = whole_meetings(work, [frame.where("bucket < 6"), frame.where("bucket >= 6")], spark.createDataFrame(list(roots.items()), "id long, root long"), 64)
    rounds = [[(r["a"], r["b"]) for r in part.collect()] for part in shared_pairs(work, whole, 2, at_once)]
    common = Counter((a, b) for k in range(100) for own in [sorted(n for b, n in members if b == k)] for i, a in enumerate(own) for b in own[i + 1 :])
    expected = sorted(p for p, n in common.items() if n >= 2 and roots.get(p[0], p[0]) != roots.get(p[1], p[1]))
    assert sorted(p for part in rounds for p in part) == expected and (len(rounds) > 3) == (at_once < 10**9)
