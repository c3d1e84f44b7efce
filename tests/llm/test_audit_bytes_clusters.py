"""Filter audits, byte-level BPE and Exponion search against brute force, the rank library and SQL."""

import hashlib
import math
import re
from itertools import permutations
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelframe.llm import byte_bpe, exponion, filter_audit
from pixelframe.llm.queries import ORACLE_SQL, queries
from pixelframe.llm.runtime import Workspace

TEXT = st.text(alphabet=st.sampled_from("abcéß İΣ'’strelvmd.,!?-_#|<>/ \n\t \u0085́̉0159日ﬁ🙂") | st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=80)


# --- filter audit ---


def audited_by_hand(rows, labels):
    """Every order applied to the list of documents, one filter after the other."""
    texts = [(r[0], r[1] or "", r[2] or "") for r in rows]
    first = {}
    for doc_id, text, _ in texts:
        if doc_id is not None:
            first[text] = min(first.get(text, doc_id), doc_id)
    told = []
    for doc_id, text, part in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc_id is not None and doc_id > first[text],
        }
        marks = [m for m in labels if doc_id is not None and m[0] == doc_id]
        told.append((part, fails, any(m[1] == 1 for m in marks), any(m[2] == 1 for m in marks)))
    out, shapley = {}, {}
    for part in {t[0] for t in told}:
        own = [t for t in told if t[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [t for t in left if t[1][name]]
                failing = [t for t in own if t[1][name]]
                unique = sum(sum(t[1].values()) == 1 for t in failing)
                left = [t for t in left if not t[1][name]]
                out[part, "".join(order), step] = (len(left), len(gone), len(failing) - len(gone), unique, sum(t[2] for t in gone), sum(t[3] for t in gone))
                shapley[part, name] = shapley.get((part, name), 0) + len(gone)
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_audit_by_hand(spark, docs, rows):
    long = " ".join(f"w{i}" for i in range(250))
    extra = [(600, long, None, "s", 0), (601, long, "en", "s", 0), (599, long + " ", "en", "s", 0), (602, long + " # A", "", "s", 0), (603, "A" * 4 + "é" * 97, "de", "s", 0)]
    extra += [(604, " ".join(["same"] * 300), "de", "s", 0), (605, " ".join(f"w{i % 100}" for i in range(200)), "de", "s", 0), (606, " ".join(["x"] * 250), "de", "s", 0)]
    extra = [(*r, 0.5, "clash") for r in extra]
    labels = [(600, 1, 0), (600, 0, 1), (601, 1, None), (100, 0, 1), (101, 1, 1), (None, 1, 1), (999, 1, 1)]
    frame = docs.union(spark.createDataFrame(extra, docs.schema)).withColumnsRenamed({"score": "A", "ids": "part"})  # clashing names
    found = filter_audit.audit_documents(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r)[:3]: tuple(r)[3:] for r in found.collect()} == audited_by_hand(rows + extra, labels)


def test_audit_shares_states(spark, monkeypatch):
    """Every unordered state is counted once, and no more than one state a filter is persisted at a time."""
    counted, real = [], filter_audit._counts

    def counts(survivors, applied, *rest):
        counted.append((applied, spark.sparkContext._jsc.getPersistentRDDs().size()))
        return real(survivors, applied, *rest)

    monkeypatch.setattr(filter_audit, "_counts", counts)
    failing = spark.range(64).selectExpr("'p' AS part", *(f"(id >> {i}) % 2 = 1 AS `{c}`" for i, c in enumerate("xyz")))
    work = Workspace(spark, "audit-test")
    found = filter_audit.audit(work, failing, "xyz").collect()
    assert sorted(a for a, _ in counted) == list(range(7))
    assert counted[0][0] == 0 and max(n for _, n in counted) <= 3
    assert len(found) == 18 and all(r["removed"] == 32 >> (r["step"] - 1) and r["unique_fails"] == 8 for r in found)
    assert {r["shapley"] for r in found} == {2 * 32 + 2 * 16 + 2 * 8}
    with pytest.raises(ValueError):
        filter_audit.audit(work, failing, "xx")
    nulls = spark.createDataFrame([(None, None, True), (None, True, None)], "part string, x boolean, o boolean")
    assert [tuple(r) for r in filter_audit.audit(work, nulls, "x", ["o"]).collect()] == [("", "x", 1, 1, 1, 0, 1, 0, 1)]


def test_audit_of_nothing(spark, empty):
    assert filter_audit.audit_documents(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# --- byte-level BPE ---


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.codec(byte_bpe.default_path(), byte_bpe.default_pattern())


@pytest.fixture(scope="module")
def ranked(codec):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=byte_bpe.default_pattern(), mergeable_ranks={t: i for i, t in enumerate(codec.tokens)}, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TEXT, max_size=5))
def test_bytes_as_the_rank_library(codec, ranked, texts):
    found = list(codec.encode([t.encode() for t in texts]))
    assert [f.tolist() for f in found] == [ranked.encode_ordinary(t) for t in texts]
    for text, ids in zip(texts, found):
        assert codec.decode(ids).tobytes() == text.encode()
        assert "".join(codec.pieces(ids.tolist())) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50255), max_size=12))
def test_any_ids_decode_as_the_rank_library(codec, ranked, ids):
    assert codec.decode(np.array(ids, dtype=np.int32)).tobytes() == ranked.decode_bytes(ids)
    assert "".join(codec.pieces(ids)) == ranked.decode_bytes(ids).decode("utf-8", "replace")


def test_every_token_is_itself_or_its_merges(codec, ranked):
    texts = [t.decode() for t in codec.tokens if t == t.decode("utf-8", "ignore").encode()]
    assert len(texts) > 49_000
    assert [i.tolist() for i in codec.encode([t.encode() for t in texts])] == [ranked.encode_ordinary(t) for t in texts]


def test_both_patterns_find_the_same_matches(codec, ranked):
    """Over all characters: what the memo is asked for is what the library would split; unknown characters leave it to the library."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    told = [f"a {c}a1{c}{c} b\n" for c in points]
    ordinary = [t for t in told if codec._ordinary(t)]
    assert len(ordinary) > 280_000
    for k in range(0, len(ordinary), 20_000):
        text = "".join(ordinary[k : k + 20_000])
        assert codec.matches(text) == [m for m, _ in codec.library.pre_tokenizer[0].pre_tokenize_str(text)]
    unknown = [t for t in told if not codec._ordinary(t)]
    assert [i.tolist() for i in codec.encode([t.encode() for t in unknown[::97]])] == [ranked.encode_ordinary(t) for t in unknown[::97]]


def test_memo_is_bounded(codec, ranked, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO_WORDS", 50)
    texts = [" ".join(f"v{k}x{j}" for j in range(30)) for k in range(20)] * 2
    assert [i.tolist() for i in codec.encode([t.encode() for t in texts])] == [ranked.encode_ordinary(t) for t in texts]
    assert len(codec.memo) < 200


def test_bytes_of_documents(spark, docs, rows, ranked):
    long = "Ein langer Text, 日本語 und emoji 🙂 again; don't  stop\n\n" * 40_000 + "q" * 5_000
    frame = docs.union(spark.createDataFrame([(700, long, "de", "s", 0, 0.0, "x")], docs.schema))
    encoded = byte_bpe.encode(frame, spans=True)
    found = byte_bpe.decode(encoded, pieces=True).collect()
    texts = {r[0]: r[1] or "" for r in rows if r[0] not in (None, 400)} | {700: long}
    assert len(found) == len(rows) + 1
    for r in found:
        assert r["decoded"].encode() == bytes(r["raw"]) and r["n_tokens"] == len(r["ids"]) == len(r["pieces"])
        if r["doc_id"] in texts:
            text = texts[r["doc_id"]]
            assert r["ids"] == ranked.encode_ordinary(text) and r["decoded"] == text == "".join(r["pieces"])
            raw, at, split = text.encode(), 0, 0
            for i, end, a, b in list(zip(r["ids"], r["byte_ends"], r["char_starts"], r["char_ends"]))[:3000]:
                token = ranked.decode_single_token_bytes(i)
                assert raw[at:end] == token
                assert len(raw[:at].decode("utf-8", "ignore")) == a and text[a:b].encode().find(token) >= 0
                at = end
            ends = set(np.cumsum([len(c.encode()) for c in text]).tolist())
            assert r["n_split"] == sum(e not in ends for e in r["byte_ends"])
    plain = byte_bpe.digest(byte_bpe.decode(byte_bpe.encode(frame)))
    by_id = {r["doc_id"]: r for r in plain.collect()}
    for doc_id, text in texts.items():
        ids = ranked.encode_ordinary(text)
        assert by_id[doc_id]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert by_id[doc_id]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_decoding_nulls_unknown_ids_and_nothing(spark, empty):
    assert byte_bpe.decode(byte_bpe.encode(empty)).count() == 0
    frame = spark.createDataFrame([(1, None, "kept"), (2, [], "kept"), (3, [50256 - 1], "kept")], "doc_id long, ids array<int>, decoded string")
    assert [(r["doc_id"], r["raw"] is None, r["decoded"] is None) for r in byte_bpe.decode(frame).orderBy("doc_id").collect()] == [(1, True, True), (2, False, False), (3, False, False)]
    with pytest.raises(Exception, match="no token of the rank file"):
        byte_bpe.decode(spark.createDataFrame([(1, [50256])], "doc_id long, ids array<int>")).collect()


def test_rank_files_are_checked(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        byte_bpe.read_ranks(str(path))


def test_byte_characters():
    found = byte_bpe.byte_characters()
    assert len(set(found)) == 256 and found[65] == "A" and found[32] == "Ġ" and not any(c.isspace() for c in found)


# --- Exponion search ---


def clustered_by_hand(rows, k, rounds, seed, dims, scale):
    usable = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    ordered = sorted(usable, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in ordered[:k]]
    for step in range(rounds + 1):
        told = [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in usable]
        if step < rounds:
            for n in range(len(centroids)):
                own = [v for (_, v), (_, c) in zip(usable, told) if c == n]
                if own:
                    centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    return sorted((i is None, i or 0, c, d, tuple(centroids[c])) for (i, _), (d, c) in zip(usable, told))


@pytest.mark.parametrize(("kind", "k", "rounds"), [("blobs", 12, 5), ("ties", 8, 4), ("copies", 7, 3), ("large", 5, 3), ("few", 9, 2), ("blobs", 1, 2), ("blobs", 5, 0)])
def test_clusters_by_hand(spark, kind, k, rounds):
    rng = np.random.default_rng(5)
    dims = 6
    vectors = {
        "blobs": rng.normal(0, 1, (300, dims)) + 4 * rng.integers(0, 4, (300, 1)),
        "ties": rng.integers(-1, 2, (300, dims)) / 1.0,  # many vectors at equal distance from several centroids
        "copies": np.repeat(rng.normal(0, 1, (5, dims)), 50, axis=0),
        "large": rng.normal(0, 1e5, (200, dims)),  # beyond what products of doubles hold exactly
        "few": rng.normal(0, 1, (4, dims)),
    }[kind]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1001, [1.0]), (1002, [float("nan")] * dims), (1003, [None] * dims), (1004, [float("inf")] + [0.0] * (dims - 1)), (1005, []), (None, [0.25] * dims), (3, rows[3][1])]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, cluster string").repartition(3)
    found = exponion.cluster(frame, k=k, rounds=rounds, dims=dims, scale=256).collect()
    told = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["cluster"], r["distance"], tuple(r["centroid"])) for r in found)
    assert told == clustered_by_hand(rows, k, rounds, exponion.SEED, dims, 256)
    assert {r["inertia"] for r in found} == {sum(r["distance"] for r in found)}
    for r in found:
        assert r["cluster_inertia"] == sum(x["distance"] for x in found if x["cluster"] == r["cluster"])


def test_balls_hold_the_nearest_and_save_work():
    """Bounds over rounds of moving centroids give plain search's answers and look at far fewer centroids."""
    rng = np.random.default_rng(9)
    x = (100 * (rng.normal(0, 1, (4000, 3)) + 9 * rng.integers(0, 6, (4000, 3)))).astype(np.int64)
    centroids = x[:64].tolist()
    cluster, upper, lower, before, looked = np.full(len(x), -1), np.zeros(len(x)), np.zeros(len(x)), None, []
    for _ in range(8):
        search = exponion.Search(centroids, before)
        cluster, upper, lower, scanned = search.assign(x, cluster, upper, lower)
        distances = exponion.squared_distances(x, search.centroids)
        assert (cluster == distances.argmin(axis=1)).all()
        exact = np.sqrt(np.sort(distances.astype(float), axis=1))
        assert (upper >= exact[:, 0]).all() and (lower <= exact[:, 1]).all()
        looked.append(int(scanned.sum()))
        before, centroids = centroids, [[int(s) // max(1, int((cluster == c).sum())) for s in x[cluster == c].sum(axis=0)] if (cluster == c).any() else centroids[c] for c in range(64)]
    assert looked[0] == 64 * len(x) and max(looked[2:]) < 0.3 * looked[0]


def test_distances_are_exact_at_any_size():
    for largest in (10, 1 << 20, 1 << 23, 1 << 26):
        x = np.array([[largest, -largest, 3], [largest - 1, 0, 1]], dtype=np.int64)
        expected = [[sum((a - b) ** 2 for a, b in zip(p, q)) for q in x.tolist()] for p in x.tolist()]
        assert exponion.squared_distances(x, x).tolist() == expected


def test_no_vectors(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert exponion.digest(exponion.cluster(frame)).count() == 0
    beyond = spark.createDataFrame([(1, [1e30] * 64), (2, [3e38] * 64), (3, [1.0] * 64)], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in exponion.cluster(beyond).collect()] == [3]


# --- queries ---


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_exponion"])
def test_equals_sql(name, spark, sf_dir):
    if not Path(sf_dir).exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for table in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    frame = queries()[name](spark, sf_dir)
    expected = con.execute(f"SELECT {', '.join(frame.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(tuple(r) for r in frame.collect()) == sorted(expected) and len(expected) > 100


def test_byte_query_on_its_table(spark, sf_dir, ranked):
    if not Path(sf_dir).exists():
        pytest.skip("no test tables")
    texts = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{sf_dir}/documents.parquet'").fetchall()
    found = {r["doc_id"]: r for r in queries()["op12_byte_bpe"](spark, sf_dir).collect()}
    assert len(found) == len(texts)
    for doc_id, text in texts:
        ids = ranked.encode_ordinary(text)
        assert found[doc_id]["n_tokens"] == len(ids) and found[doc_id]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[doc_id]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
