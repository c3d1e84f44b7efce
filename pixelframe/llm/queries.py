"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from . import byte_bpe, chunk_bpe, embedding_dedup, exponion, filter_audit, image_copies, language_id, licenses, minhash_dedup, packing, quality, simple8b, toxicity
from .runtime import table


def op1_license_scan(spark, sf_dir):
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op2_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language_id.predictions(language_id.identify(docs, language_id.learn(docs)))


def op4_packing(spark, sf_dir):
    return packing.digest(packing.pack(table(spark, sf_dir, "documents")))


def op5_simple8b(spark, sf_dir):
    return simple8b.digest(simple8b.round_trip(table(spark, sf_dir, "documents")))


def op6_chunk_bpe(spark, sf_dir):
    return chunk_bpe.digest(chunk_bpe.encode_and_decode(table(spark, sf_dir, "documents")))


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.predictions(toxicity.score(docs, model))


def op8_image_copies(spark, sf_dir):
    return image_copies.copies(image_copies.rendered_embeddings(table(spark, sf_dir, "embeddings")))


def op9_minhash_dedup(spark, sf_dir):
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.selections(quality.score(docs, model))


def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_byte_bpe(spark, sf_dir):
    return byte_bpe.digest(byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"))))


def op13_exponion(spark, sf_dir):
    return exponion.digest(exponion.cluster(table(spark, sf_dir, "embeddings")))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_COMPONENTS = """reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN mutual l ON l.a = r.b),
  comps AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""

def _exponion_sql() -> str:
    """Rounds of plain k-means by all distances, each round two views."""
    near = """(SELECT vec_id, v, arg_min(c, (d, c)) AS cluster, min(d) AS distance FROM (SELECT vec_id, v, c, CAST(list_dot_product(v, v) - 2 * list_dot_product(v, m) + list_dot_product(m, m) AS BIGINT) AS d FROM x, {}) GROUP BY ALL)"""
    text = """WITH x AS (SELECT vec_id, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
  c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS m FROM (SELECT v, sha256('2:' || vec_id) AS h FROM x ORDER BY h LIMIT 40)),
  """
    for r in range(exponion.ROUNDS):
        text += f"""a{r} AS MATERIALIZED {near.format(f'c{r}')}, n{r} AS (SELECT cluster, list(t ORDER BY i) AS m FROM (SELECT cluster, i, floor(sum(e) / count(*)) AS t FROM (SELECT cluster, unnest(v) AS e, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY ALL) GROUP BY cluster),
  c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN n{r} ON cluster = c),
  """
    return (
        text
        + f"""z AS {near.format(f'c{exponion.ROUNDS}')}
  SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(list_transform(m, lambda e: CAST(e AS BIGINT)), ',')) AS centroid_sha256 FROM z JOIN c{exponion.ROUNDS} ON c = cluster"""
    )


#: DuckDB twins where SQL can express an operator's result: brute force over all pairs that can be near.
ORACLE_SQL: dict[str, str] = {
    "op2_embedding_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.9),
  mutual AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), nodes AS (SELECT vec_id AS id FROM embeddings), {_COMPONENTS}
  SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN comps ON id = vec_id LEFT JOIN (SELECT a, count(*) AS n FROM mutual GROUP BY a) ON a = vec_id""",
    "op9_minhash_dedup": f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
  s AS (SELECT doc_id, shingle, count(*) AS tf FROM (SELECT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)) GROUP BY ALL),
  f AS (SELECT shingle, ln(1 + (SELECT count(*) FROM documents) / count(*)::DOUBLE) AS idf FROM s GROUP BY shingle),
  w AS (SELECT doc_id, s.shingle, tf * pow(idf, 0.125) AS weight FROM s JOIN f ON f.shingle = s.shingle), t AS (SELECT doc_id, sum(weight) AS total FROM w GROUP BY doc_id),
  p AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.weight, y.weight)) AS common FROM w x JOIN w y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
  links AS (SELECT a, b FROM p JOIN t x ON x.doc_id = a JOIN t y ON y.doc_id = b WHERE common / (x.total + y.total - common) >= 0.8 UNION SELECT min(doc_id) OVER (PARTITION BY text), doc_id FROM d),
  mutual AS (SELECT a, b FROM links WHERE a <> b UNION ALL SELECT b, a FROM links WHERE a <> b), nodes AS (SELECT doc_id AS id FROM documents), {_COMPONENTS}
  SELECT doc_id, component_id, doc_id = component_id AS kept, CAST(count(*) OVER (PARTITION BY text) AS BIGINT) AS n_copies FROM d JOIN comps ON id = doc_id""",
    "op11_filter_audit": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
  f AS (SELECT part, CAST(len(w) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) AS INTEGER)
      + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INTEGER) AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d LEFT JOIN l USING (doc_id)),
  m AS (SELECT part, CAST(fails AS BIGINT) AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
  s(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
  o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM s a, s b, s c, s d, s e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
  k AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS letter, (SELECT coalesce(sum(bit), 0) FROM s WHERE instr(substr(filter_order, 1, step - 1), s.letter) > 0) AS seen FROM o, range(1, 6) AS r(step)),
  g AS (SELECT part, filter_order, step, k.letter,
      sum(CASE WHEN fails & (CAST(seen AS BIGINT) | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails & CAST(seen AS BIGINT) = 0 AND fails & bit > 0 THEN n ELSE 0 END) AS removed,
      sum(CASE WHEN fails & CAST(seen AS BIGINT) > 0 AND fails & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
      sum(CASE WHEN fails & CAST(seen AS BIGINT) = 0 AND fails & bit > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails & CAST(seen AS BIGINT) = 0 AND fails & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM m, k JOIN s USING (letter) GROUP BY ALL)
  SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
    CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM g""",
    "op13_exponion": _exponion_sql(),
}
