"""Canonical documents, differences of documents, and digests handed over between partitions."""

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelframe.functions import documents, hashing
from pixelframe.operators import identity, statistics
from pixelframe.sources import files

JSON = st.recursive(st.none() | st.booleans() | st.integers(-(10**12), 10**12) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8)


def test_canonical_at_every_depth(spark, tmp_path):
    rows = spark.sql("""SELECT 2 AS b, named_struct('z', array(named_struct('y', 1.5D, 'x', map('k2', 'é"\\n', 'k1', null))), 'a', CAST(null AS string), 'e', array(), 'big', 1e22D, 'small', 1e-7D) AS a, 'one.json' AS file""")
    value = {"b": 2, "a": {"z": [{"y": 1.5, "x": {"k2": 'é"\n', "k1": None}}], "a": None, "e": [], "big": 1e22, "small": 1e-7}}
    assert files.canonical_json(rows.drop("file")).first()["json"] == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    files.write_documents(rows, str(tmp_path / "out"), "file")
    assert (tmp_path / "out" / "one.json").read_text() == json.dumps(value, sort_keys=True, indent=2) + "\n"
    texts = spark.createDataFrame([('{"b":1, "a":2}',), ("{bad",), (None,)], "t string")
    assert [r[0] for r in texts.select(documents.canonical(F.col("t"))).collect()] == ['{"a":2,"b":1}', None, None]


def test_pairs_of_documents(spark):
    rows = [("same", '{"a":1,"b":[1,2]}'), ("same", '{"b":[1, 2], "a":1}'), ("order", '{"a":[1,2]}'), ("order", '{"a":[2,1]}'), ("bad", "{"), ("bad", "{}"), ("one", "{}"), ("null", None), ("null", "{}")]
    frame = spark.createDataFrame(rows, "k string, t string")
    found = {r["k"]: r["deterministic"] for r in statistics.pair_determinism(frame, "k", F.col("t"), documents=True).collect()}
    assert found == {"same": True, "order": False, "bad": False, "one": False, "null": False}


def test_null_is_a_value_of_its_own(spark):
    frame = spark.createDataFrame([("a", None), ("a", "\0"), ("b", None), ("b", None), ("c", "x")], "k string, v string")
    assert {r["k"]: r["v_stable"] for r in statistics.stable(frame, ["k"], ["v"]).collect()} == {"a": False, "b": True, "c": True}


def test_differences(spark):
    left = [(1, '{"a":{"b":[1,2,{"c":null}],"x/y~z":1},"gone":[]}'), (2, "[1]"), (3, "{}"), (4, '{"n":1.0,"t":true}'), (5, None), (None, '"s"'), (6, "{bad")]
    right = [(1, '{"a":{"x/y~z":"1","b":[1,{"c":null},2]},"new":{}}'), (2, "[1]"), (4, '{"t":1,"n":1}'), (5, "1"), (None, '"t"'), (6, "{bad")]
    schema = "k long, d string"
    found = {tuple(r) for r in documents.differences(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "k", "d").collect()}
    assert found == {
        (1, "/a/x~1y~0z", "changed"), (1, "/a/b/1", "changed"), (1, "/a/b/2", "changed"), (1, "/a/b/1/c", "added"), (1, "/a/b/2/c", "missing"), (1, "/gone", "missing"), (1, "/new", "added"),
        (3, "", "missing"), (4, "/t", "changed"), (5, "", "added"), (None, "", "changed"),
    }


@settings(max_examples=200, deadline=None)
@given(JSON, JSON)
def test_places_tell_documents_apart(a, b):
    def plain(v):  # as json: 1.0 is 1, but true isn't
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return (type(v).__name__, v)
        if isinstance(v, dict):
            return ("d", tuple(sorted((k, plain(x)) for k, x in v.items())))
        return ("l", tuple(map(plain, v))) if isinstance(v, list) else ("n", v)

    assert (sorted(map(repr, documents._places(a))) == sorted(map(repr, documents._places(b)))) == (plain(a) == plain(b))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=6))
def test_hash_states_are_handed_over(parts):
    state = hashing.started()
    for part in parts:
        state = hashing.updated(bytes(bytearray(state)), part)
    assert hashing.finished(state) == hashlib.sha256(b"".join(parts)).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_identity_over_ranges(spark, n):
    entries = [{"byteCount": i * 7, "executable": i % 3 == 0, "path": f'd{i % 13}/é"{i}\x1f', "sha256": f"{i:064x}"} for i in range(n)]
    frame = spark.createDataFrame([(e["path"], e["byteCount"], e["sha256"], e["executable"]) for e in entries], "path string, byte_count long, sha256 string, executable boolean").repartition(3)
    payload = json.dumps({"schemaVersion": 2, "identityID": "té", "coverage": {"b": [1], "a": "x"}, "files": sorted(entries, key=lambda e: e["path"])}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert tuple(identity.canonical_digest(frame, "té", 2, {"b": [1], "a": "x"}).first()) == (n, hashlib.sha256(payload.encode()).hexdigest())


def test_a_million_entries(spark):
    frame = spark.range(1_000_000).selectExpr("lpad(CAST(id AS string), 9, '0') AS path", "id AS byte_count", "'" + "0" * 64 + "' AS sha256", "false AS executable")
    digest = hashlib.sha256(b'{"files":[')
    for i in range(1_000_000):
        digest.update(b'%s{"byteCount":%d,"executable":false,"path":"%09d","sha256":"%s"}' % (b"," if i else b"", i, i, b"0" * 64))
    digest.update(b'],"identityID":"m","schemaVersion":1}')
    assert tuple(identity.canonical_digest(frame, "m").first()) == (1_000_000, digest.hexdigest())
