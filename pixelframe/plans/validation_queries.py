"""Queries that check whole reports: one report for each customer, order or supplier, each with at most a few flaws, and the first rule that each breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import validation
from ..shipping import spread
from ..sources.files import table
from .registry import query

_HASH = "repeat('d', 64)"
_CHUNKS = {"first": 1024, "second": 4096}


def _sized() -> Column:
    return F.create_map(*(F.lit(x).cast("long") if isinstance(x, int) else F.lit(x) for pair in _CHUNKS.items() for x in pair))


def _case(flaws: dict[int, str], key: str = "k") -> str:
    """What a twin expects: the rule of the first step that divides the key."""
    return "CASE " + " ".join(f"WHEN {key} % {step} = 0 THEN '{rule}'" for step, rule in flaws.items()) + " END"


def _flawed(step: int, bad: str, good: str) -> str:
    return f"CASE WHEN k % {step} = 0 THEN {bad} ELSE {good} END"


def _metrics(absolute: str, squared: str, maes: str, coverage: str) -> str:
    """Metrics of 600 channels with the sums given."""
    return f"""named_struct('channelCount', 600, 'differentChannelCount', 5, 'maximumAbsoluteError', 200, 'absoluteErrorSum', {absolute}, 'squaredErrorSum', {squared}, 'meanAbsoluteErrorMicrounits', {absolute} * 1000000L div 600 + {maes},
      'meanSquaredErrorMicrounits', {squared} * 1000000L div 600, 'psnrMicrodecibels', cast(rint(10 * log10(65025D / ({squared} / 600)) * 1000000) as bigint), 'absoluteErrorAtMost8PPM', 10, 'absoluteErrorAtMost16PPM', 20, 'absoluteErrorAtMost32PPM', 30, 'absoluteErrorAtMost64PPM', {coverage})"""


_ENVELOPE = f"""'schemaVersion', {_flawed(61, '2', '1')}, 'evidenceVersion', {_flawed(59, "'v0'", "'v1'")}, 'buildConfiguration', {_flawed(53, "'debug'", "'release'")}, 'manifestSHA256', {_flawed(47, "'other'", "'m'")}, 'caseID', 'c'"""
_ENVELOPE_FLAWS = {61: "schema", 59: "evidence", 53: "build", 47: "manifest"}

_PHOTO_FLAWS = {67: "json", **_ENVELOPE_FLAWS, 43: "chunk size", 41: "chunk count", 37: "digests", 31: "output", 29: "generation numbers", 23: "source bytes", 19: "append boundary", 17: "fractions", 13: "mean errors", 11: "coverage", 7: "generation digests"}
_PHOTO = f"""to_json(named_struct({_ENVELOPE}, 'encodedByteCount', 5000, 'chunkSizeBytes', {_flawed(43, '512', '1024')}, 'chunkCount', {_flawed(41, '4', '5')}, 'encodedSHA256', {_flawed(37, "'d'", _HASH)}, 'finalPixelRGBSHA256', {_HASH}, 'outputPixelWidth', {_flawed(31, '0', '20')}, 'outputPixelHeight', 10,
  'generations', transform(array(1024, {_flawed(23, '1024', _flawed(19, '2047', '2048'))}, 5000), (n, i) -> named_struct('generation', i + {_flawed(29, '2', '1')}, 'sourceByteCount', n, 'encodedByteFractionPPM', n * 1000000L div 5000 + {_flawed(17, '1', '0')}, 'pixelRGBSHA256', {_flawed(7, 'null', _HASH)}, 'metricsAgainstFinal', {_metrics('(k % 1000 + 7)', '(k % 1000 * 3 + 9)', _flawed(13, '1', '0'), _flawed(11, '25', '40'))}))))"""


def _documents(rows: DataFrame, key: str, document: str) -> DataFrame:
    return spread(rows.select(F.col(key).alias("k"))).select("k", F.when(F.col("k") % 67 == 0, F.lit("no json")).otherwise(F.expr(document)).alias("document"))


def _expected(**more: Column) -> dict[str, Column]:
    return {"evidence": F.lit("v1"), "manifest": F.lit("m"), "benchmark": F.lit("b1"), "chunk_sizes": _sized(), **more}


@query(f"SELECT c_custkey AS k, {_case(_PHOTO_FLAWS, 'c_custkey')} AS broken FROM customer")
def photo_case_rules(spark, sf_dir):
    return validation.failures(_documents(table(spark, sf_dir, "customer"), "c_custkey", _PHOTO), "k", "document", validation.PHOTO_CASE, _expected(chunk_sizes=F.array(F.lit(1024).cast("long"), F.lit(4096).cast("long"))))


def _attempt(digest: str, shown: str, width: str, maes: str) -> str:
    told = f"named_struct('sourceStatusRawValue', {_flawed(13, 'null', '0')}, 'frameStatusRawValue', 0, 'propertiesAvailable', true, 'rasterAvailable', {shown}"
    drawn = _metrics("(k % 1000 + 7)", "(k % 1000 * 3 + 9)", maes, "40")
    return f"{told}, 'outputPixelWidth', CASE WHEN {shown} OR k % 11 = 0 THEN {width} END, 'outputPixelHeight', CASE WHEN {shown} THEN 10 END, 'pixelRGBSHA256', CASE WHEN {shown} THEN {digest} END, 'metricsAgainstFinal', CASE WHEN {shown} THEN {drawn} END)"


_SCAN_FLAWS = {67: "json", **_ENVELOPE_FLAWS, 43: "scan count", 41: "scan order", 37: "scan bounds", 31: "marker", 29: "checkpoint offsets", 23: "labels", 19: "checkpoint fractions", 13: "attempt status", 11: "attempt without raster", 7: "attempt output", 5: "mean errors", 3: "attempts differ", 2: "pixels within a scan"}
# A scan starts at 1000 i + 100, its entropy ends at + 500 and its marker at + 502; the first checkpoint has no raster.
_POINT = f"""named_struct('offset', o, 'labels', CASE WHEN j = 1 THEN {_flawed(23, "array('terminating-marker-code-end')", "array('entropy-end-before-marker')")} WHEN j = 2 THEN array('immediate-following-segment-end', 'terminating-marker-code-end') ELSE array() END, 'encodedByteFractionPPM', o * 1000000L div 9000 + {_flawed(19, '1', '0')},
    'freshSource', {_attempt(f"CASE WHEN k % 2 = 0 AND j = 2 THEN repeat('e', 64) ELSE {_HASH} END", '(j > 0)', _flawed(7, '21', '20'), _flawed(5, '1', '0'))}, 'sequentialSource', {_attempt(f"CASE WHEN k % 3 = 0 OR k % 2 = 0 AND j = 2 THEN repeat('e', 64) ELSE {_HASH} END", '(j > 0)', '20', '0')})"""
_SCANS = f"""to_json(named_struct({_ENVELOPE}, 'encodedByteCount', 9000, 'encodedSHA256', {_HASH}, 'outputPixelWidth', 20, 'outputPixelHeight', 10, 'declaredScanCount', {_flawed(43, '4', '3')},
  'scans', transform(array(1, 2, 3), i -> named_struct('scan', i, 'entropyStartOffset', CASE WHEN k % 41 = 0 THEN 100 ELSE 1000 * i + 100 END, 'entropyEndMarkerStartOffset', 1000 * i + {_flawed(37, '600', '500')}, 'terminatingMarkerCodeEndOffset', 1000 * i + 502, 'immediateFollowingSegmentEndOffset', 1000 * i + 502, 'nextScanEntropyStartOffset', null,
  'terminatingMarkerHex', {_flawed(31, 'null', "'ffda'")}, 'checkpoints', transform({_flawed(29, 'array(1000 * i + 300, 1000 * i + 300, 1000 * i + 502)', 'array(1000 * i + 300, 1000 * i + 500, 1000 * i + 502)')}, (o, j) -> {_POINT}))))) """


@query(f"SELECT o_orderkey AS k, {_case(_SCAN_FLAWS, 'o_orderkey')} AS broken FROM orders")
def scan_checkpoint_rules(spark, sf_dir):
    return validation.failures(_documents(table(spark, sf_dir, "orders"), "o_orderkey", _SCANS), "k", "document", validation.SCAN_CHECKPOINTS, _expected())


# Sample i of n takes 1000 (i + 1) for its first generation; all other times lie a fixed time after it, so that its statistics do too.
_TIMES = {"generation": [0, 10, 20, 30], "finish": 40, "total": 50}


def _spread(n: int, after: int) -> str:
    ranks = {"minimum": 1, "median": (n + 1) // 2, "p90": (9 * n + 9) // 10, "maximum": n}
    fields = ", ".join(f"'{name}Nanoseconds', {1000 * rank + after}" for name, rank in ranks.items())
    return f"named_struct({fields}, 'meanNanoseconds', {1000 * n * (n + 1) // 2 // n + after} + {{mean}})"


def _timeline(n: int, chunk: str) -> str:
    """samples, source, output and summary of a timeline of n samples; ``mean`` is added to the means of the ends."""
    size = f"(20 * {chunk})"
    point = "named_struct('generation', g + 1, 'sourceByteCount', (g + 1) * {chunk}, 'elapsedNanoseconds', 1000 * i + 10 * {turn})".replace("{chunk}", chunk).replace("{turn}", _flawed(29, "(3 - g)", "g"))
    samples = f"transform(sequence(1, {n}), i -> named_struct('generations', transform(sequence(0, {_flawed(19, 'CASE WHEN i = 2 THEN 2 ELSE 3 END', '3')}), g -> {point}), 'finishElapsedNanoseconds', 1000 * i + 40, 'totalElapsedNanoseconds', 1000 * i + {_flawed(23, '30', '50')}))"
    summed = ", ".join(f"named_struct('generation', {g + 1}, 'sourceByteCount', {g + 1} * {chunk}, 'encodedByteFractionPPM', {g + 1} * {chunk} * 1000000L div {size}, 'elapsed', {_spread(n, after).format(mean='0')})" for g, after in enumerate(_TIMES["generation"]))
    summary = f"named_struct('generationCount', 4, 'firstPreviewSourceByteCount', {chunk} + {_flawed(13, '1', '0')}, 'firstPreviewEncodedByteFractionPPM', {chunk} * 1000000L div {size}, 'firstPreviewElapsed', {_spread(n, 0).format(mean='0')}, 'generations', array({summed}), 'finishElapsed', {_spread(n, 40).format(mean=_flawed(11, '1', '0'))}, 'totalElapsed', {_spread(n, 50).format(mean='0')})"
    return f"'samples', {samples}, 'source', named_struct('encodedByteCount', {_flawed(31, '0', size)}, 'encodedSHA256', 'x'), 'output', map('width', 20), 'summary', {summary}"


_PROCESS_FLAWS = {67: "json", 61: "schema", 59: "benchmark", 53: "build", 47: "case", 43: "chunk size", 41: "warmup", 37: "sample count", 31: "source", 29: "generation times", 23: "end times", 19: "sample shapes", 13: "summary of first preview", 11: "summary of ends", 7: "low power", 5: "thermal state"}
_PROCESS = f"""to_json(named_struct('schemaVersion', {_flawed(61, '2', '1')}, 'benchmarkVersion', {_flawed(59, "'b0'", "'b1'")}, 'buildConfiguration', {_flawed(53, "'debug'", "'release'")}, 'caseID', {_flawed(47, "'third'", "'first'")}, 'chunkSizeBytes', {_flawed(43, '4096', '1024')}, 'warmupIterations', {_flawed(41, '1', '2')}, 'iterations', {_flawed(37, '8', '7')},
  {_timeline(7, '1024')}, 'environment', named_struct('lowPowerModeEnabled', k % 7 = 0, 'thermalState', {_flawed(5, "'serious'", "'fair'")})))"""


@query(f"SELECT c_custkey AS k, {_case(_PROCESS_FLAWS, 'c_custkey')} AS broken FROM customer")
def process_timeline_rules(spark, sf_dir):
    return validation.failures(_documents(table(spark, sf_dir, "customer"), "c_custkey", _PROCESS), "k", "document", validation.PROCESS_TIMELINE, _expected())


_CAMPAIGN_FLAWS = {67: "json", 61: "schema", 59: "benchmark", 53: "build", 47: "identity", 43: "case set", 41: "repetitions", 37: "chunk size", 31: "source", 19: "sample shapes", 29: "summary of generations", 13: "summary of first preview", 23: "summary of ends", 11: "summary of ends", 7: "low power", 5: "thermal states"}
_CASES = ", ".join(
    f"named_struct('caseID', {_flawed(43, f"'{name}{name}'", f"'{name}'")}, 'processRepetitions', 3, 'warmupIterationsPerProcess', 2, 'iterationsPerProcess', {_flawed(41, '6', '7')}, 'totalIterations', 21, 'chunkSizeBytes', {_flawed(37, '512', str(size))}, {_timeline(21, str(size))}, 'environment', named_struct('lowPowerModeEnabled', k % 7 = 0, 'thermalStates', array('nominal', {_flawed(5, "'serious'", "'fair'")})))"
    for name, size in _CHUNKS.items()
)
_CAMPAIGN = f"""to_json(named_struct('schemaVersion', {_flawed(61, '2', '1')}, 'benchmarkVersion', {_flawed(59, "'b0'", "'b1'")}, 'buildConfiguration', {_flawed(53, "'debug'", "'release'")}, 'swiftVersion', '6', 'runtime', {_flawed(47, "''", "'r'")}, 'decoderFingerprint', 'f', 'hardware', map('model', 'h'), 'cases', array({_CASES})))"""


@query(f"SELECT s_suppkey AS k, {_case(_CAMPAIGN_FLAWS, 's_suppkey')} AS broken FROM supplier")
def campaign_rules(spark, sf_dir):
    return validation.failures(_documents(table(spark, sf_dir, "supplier"), "s_suppkey", _CAMPAIGN), "k", "document", validation.CAMPAIGN, _expected())


@query("""SELECT c_nationkey, c_mktsegment, CASE WHEN count(*) <> 12 THEN 'reports' WHEN count(DISTINCT c_custkey % 47 = 0) > 1 THEN 'manifestSHA256' WHEN count(DISTINCT c_custkey % 31 = 0) > 1 THEN 'outputPixelWidth' WHEN count(DISTINCT c_custkey % 41 = 0) > 1 THEN 'chunkCount' END AS broken FROM customer GROUP BY 1, 2""")
def report_group_rules(spark, sf_dir):
    """Reports of the customers of a nation and segment: as many as asked for, and equal in all that must not differ."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", F.col("c_custkey").alias("k")).select("c_nationkey", "c_mktsegment", F.expr(_PHOTO).alias("document"))
    return validation.group_failures(rows, ["c_nationkey", "c_mktsegment"], "document", validation.PHOTO_CASE, ["manifestSHA256", "outputPixelWidth", "chunkCount"], 12)
