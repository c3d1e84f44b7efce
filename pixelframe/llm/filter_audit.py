"""Filter interaction audit: what each filter removes in every order, by a trie of permutations.

A node of the trie is a prefix of an order; two prefixes with the same filters leave the same rows, so a node's state is
kept by the unordered set of its filters and computed once. The trie is walked depth first: a state's survivors are a
persisted DataFrame, made from its parent's by one filter, counted once for all edges that leave it, handed to its
children and given up when the walk leaves it, so that at most one state for each filter is persisted at a time.
n filters have n! orders but only 2^n states and n * 2^(n-1) edges. Rows that an edge removes are counted on the survivors
that reach it, never derived from other edges.

Filters are boolean columns, true where a row fails; null counts as passing. A null part is the empty string. Repeated rows
count once each. An empty table has no parts and gives no rows. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import Workspace, prepare

#: Orders grow as the factorial of the filters; their table is broadcast.
MOST_FILTERS = 6
#: Fixed values of the audited document filters: words under 200, fewer than 50 in 100 words distinct, more than 3 in 100 code points capital, marks.
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 200, 50, 3, r"[#$%&*|]"
_BLANKS = r"[ \t-\r]+"


def text_failures(text: Column) -> dict[str, Column]:
    """Whether a text fails for being short (A), repetitive (B), in capitals (C) or full of marks (D)."""
    words = F.array_remove(F.split(text, _BLANKS), "")
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > CAPITAL_PERCENT * F.length(text),
        "D": text.rlike(MARKS),
    }


def failures(work: Workspace, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E, good and toxic of every document.

    E, a copy of a smaller doc_id's text, is told from the smallest doc_id of each SHA-256: a row is no copy if it holds
    that doc_id, and is joined on both, so a text that a third of all rows share is spread by doc_id. Rows without a doc_id
    are neither copies nor labelled. A null text is empty. Of several labels of a document, one that says 1 counts.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    told = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        text.alias("_text"),
    ).select("doc_id", "part", *(c.alias(name) for name, c in text_failures(F.col("_text")).items()), F.unhex(F.sha2("_text", 256)).alias("digest"))
    told = work.write(told, "told")
    first = told.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(F.col(c) == 1).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    joined = told.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    return joined.select("part", *"ABCD", (F.col("doc_id").isNotNull() & F.col("first").isNull()).alias("E"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def _counts(survivors: DataFrame, applied: int, left: list[int], filters: Sequence[str], outcomes: Sequence[str]) -> DataFrame:
    """A row for each part and filter still to apply: survivors that reach the edge and those it removes, in one aggregation."""
    counts = ["count(1) AS reach"]
    for i in left:
        counts.append(f"count_if(`{filters[i]}`) AS `_{i}`")
        counts += [f"count_if(`{filters[i]}` AND `{o}`) AS `_{i}_{j}`" for j, o in enumerate(outcomes)]
    edges = [f"named_struct({', '.join([f"'applied', {applied}, 'next', {i}, 'removed', `_{i}`", *(f"'lost_{j}', `_{i}_{j}`" for j in range(len(outcomes)))])})" for i in left]
    return survivors.groupBy("part").agg(*map(F.expr, counts)).selectExpr("part", "reach", f"inline(array({', '.join(edges)}))")


def _walk(work: Workspace, start: DataFrame, filters: Sequence[str], outcomes: Sequence[str]) -> DataFrame:
    """Visits every unordered state once, depth first, and writes the counts of its edges."""
    path, visited = work.new_path("edges"), set()

    def visit(applied: int, survivors: DataFrame) -> None:
        visited.add(applied)
        left = [i for i in range(len(filters)) if not applied >> i & 1]
        if not left:
            return
        survivors = survivors.persist()
        _counts(survivors, applied, left, filters, outcomes).write.mode("append").parquet(path)
        for i in left:
            if applied | 1 << i not in visited:
                visit(applied | 1 << i, survivors.where(f"NOT `{filters[i]}`"))
        survivors.unpersist()

    visit(0, start)
    schema = f"part string, reach long, applied int, next int, removed long, {', '.join(f'lost_{j} long' for j in range(len(outcomes)))}".rstrip(", ")
    return work.spark.read.schema(schema).parquet(path)


def audit(work: Workspace, failing: DataFrame, filters: Sequence[str], outcomes: Sequence[str] = (), part: str = "part") -> DataFrame:
    """One row for each part, filter_order and step, zeros included.

    ``failing`` has a boolean column for each of at most six one-letter ``filters`` and for each of ``outcomes`` (what is worth
    counting among the removed). Columns: kept, removed, redundant (fail the filter, removed earlier), unique_fails (fail no other
    filter), <outcome>_lost, shapley (the filter's removals summed over all orders).
    """
    n, full = len(filters), (1 << len(filters)) - 1
    if not 1 <= n <= MOST_FILTERS or len(set(filters)) < n or any(len(f) != 1 for f in filters):
        raise ValueError(f"from one to {MOST_FILTERS} filters with names of one letter each, all different")
    prepare(failing.sparkSession)
    flags = [F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(c) for c in (*filters, *outcomes)]
    start = work.write(failing.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), *flags), "failing")
    counted = _walk(work, start, filters, outcomes)

    # A part without survivors in a state has no count there: all edges of every part are added with zeros.
    sums = ["reach", "removed", *(f"lost_{j}" for j in range(len(outcomes)))]
    every = F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(i).alias("next")) for s in range(full) for i in range(n) if not s >> i & 1))
    zeros = counted.where("applied = 0 AND next = 0").select("part", F.inline(every), *(F.lit(0).cast("long").alias(c) for c in sums))
    edges = counted.unionByName(zeros).groupBy("part", "applied", "next").agg(*(F.sum(c).alias(c) for c in sums))

    own = "PARTITION BY part, next"
    before = F.bit_count("applied").cast("int")
    edges = edges.withColumn("weighted", F.col("removed") * F.factorial(before) * F.factorial(n - 1 - before)).withColumns({
        "fails": F.expr(f"max(CASE WHEN applied = 0 THEN removed END) OVER ({own})"),
        "unique_fails": F.expr(f"max(CASE WHEN applied = {full} - shiftleft(1, next) THEN removed END) OVER ({own})"),
        "shapley": F.expr(f"sum(weighted) OVER ({own})"),
    })
    steps = [("".join(filters[i] for i in order), k + 1, sum(1 << i for i in order[:k]), order[k]) for order in permutations(range(n)) for k in range(n)]
    orders = F.broadcast(failing.sparkSession.createDataFrame(steps, "filter_order string, step int, applied int, next int"))  # n * n! rows, 4,320 at most
    return edges.join(orders, ["applied", "next"]).select(
        "part", "filter_order", "step", (F.col("reach") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", *(F.col(f"lost_{j}").alias(f"{o}_lost") for j, o in enumerate(outcomes)), "shapley",
    )


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over whole texts, by language, with the good and the toxic documents that they cost."""
    work = Workspace(docs.sparkSession, "filter-audit")
    return audit(work, failures(work, docs, labels), "ABCDE", ("good", "toxic"))
