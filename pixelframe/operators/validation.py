"""Whole reports checked against rules held as data.

A rule is a name and a SQL condition over the report ``r``, what is expected of it ``e``, and items of its arrays. A
validator's rules become one ordered CASE over the parsed document, so that a report costs a row of one scan. The answer is the
first rule in the validator's order that a report breaks; what is missing, of another type or overflows is null, and a null breaks a rule.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reports import first_broken


@dataclass(frozen=True)
class Rule:
    """``each`` names arrays as "path name", outermost first: the condition must hold for all of their items."""

    name: str
    holds: str
    each: tuple[str, ...] = ()

    def condition(self) -> Column:
        condition = self.holds
        for array in reversed(self.each):
            path, name = array.split()
            condition = f"forall({path}, {name} -> coalesce({condition}, false))"
        return F.expr(condition)


@dataclass(frozen=True)
class Validator:
    """``schema``: the report's fields; ``expected``: the types of what is expected."""

    schema: str
    rules: tuple[Rule, ...]


def _ascending(values: str, strictly: bool = True) -> str:
    return f"({values}) = array_sort(array_distinct({values}))" if strictly else f"({values}) = array_sort({values})"


def _millionths(part: str, whole: str) -> str:
    return f"try_multiply({part}, 1000000L) div nullif({whole}, 0)"


def _numbered(array: str, field: str) -> str:
    return f"forall(transform({array}, (x, i) -> x.{field} = i + 1), ok -> ok)"


def _statistics(values: str) -> str:
    """Nearest-rank statistics of a report's own (few) samples."""
    ranks = {"minimumNanoseconds": "array_min(v)", "medianNanoseconds": "try_element_at(array_sort(v), cast(greatest(1, (size(v) + 1) div 2) as int))", "p90Nanoseconds": "try_element_at(array_sort(v), cast(greatest(1, (size(v) * 9 + 9) div 10) as int))"}
    ranks |= {"maximumNanoseconds": "array_max(v)", "meanNanoseconds": "aggregate(v, 0L, (s, x) -> try_add(s, x)) div nullif(size(v), 0)"}
    fields = ", ".join(f"'{k}', cast({v} as bigint)" for k, v in ranks.items())
    return f"transform(array({values}), v -> named_struct({fields}))[0]"


_METRICS_FIELDS = (
    "channelCount", "differentChannelCount", "maximumAbsoluteError", "absoluteErrorSum", "squaredErrorSum", "meanAbsoluteErrorMicrounits", "meanSquaredErrorMicrounits", "psnrMicrodecibels",
    "absoluteErrorAtMost8PPM", "absoluteErrorAtMost16PPM", "absoluteErrorAtMost32PPM", "absoluteErrorAtMost64PPM",
)
_METRICS = f"struct<{','.join(f'{name}:bigint' for name in _METRICS_FIELDS)}>"
_STATISTICS = "struct<minimumNanoseconds:bigint,medianNanoseconds:bigint,p90Nanoseconds:bigint,maximumNanoseconds:bigint,meanNanoseconds:bigint>"
_DIGEST = "length({0}) = 64"


def metrics_rules(path: str, channels: str, each: tuple[str, ...] = (), unless: str = "false") -> tuple[Rule, ...]:
    """Recorded error metrics follow from their own sums. Where ``unless`` holds nothing is asked."""
    m, n = path, f"{path}.channelCount"
    mse = f"try_divide({m}.squaredErrorSum, {n})"
    psnr = f"cast(rint(CASE WHEN {m}.squaredErrorSum = 0 THEN 999D ELSE 10 * log10(try_divide(65025D, {mse})) END * 1000000) as bigint)"
    coverage = f"array({', '.join(f'{m}.{name}' for name in _METRICS_FIELDS[-4:])})"
    rules = {
        "channel count": f"{n} = {channels} AND {n} > 0",
        "error counts": f"{m}.differentChannelCount BETWEEN 0 AND {n} AND {m}.maximumAbsoluteError BETWEEN 0 AND 255",
        "error sums": f"{m}.absoluteErrorSum BETWEEN 0 AND try_multiply(255L, {n}) AND {m}.squaredErrorSum BETWEEN 0 AND try_multiply(65025L, {n})",
        "mean errors": f"{m}.meanAbsoluteErrorMicrounits = {_millionths(f'{m}.absoluteErrorSum', n)} AND {m}.meanSquaredErrorMicrounits = {_millionths(f'{m}.squaredErrorSum', n)}",
        "psnr": f"{m}.psnrMicrodecibels = {psnr}",
        "coverage": f"forall({coverage}, x -> x BETWEEN 0 AND 1000000) AND {_ascending(coverage, strictly=False)}",
    }
    return tuple(Rule(name, f"{unless} OR coalesce({holds}, false)", each) for name, holds in rules.items())


_OUTPUT = Rule("output", "r.outputPixelWidth > 0 AND r.outputPixelHeight > 0")
_CHANNELS = "try_multiply(try_multiply(r.outputPixelWidth, r.outputPixelHeight), 3L)"
_ENVELOPE = (
    Rule("schema", "r.schemaVersion = 1"),
    Rule("evidence", "r.evidenceVersion = e.evidence"),
    Rule("build", "r.buildConfiguration = 'release'"),
    Rule("manifest", "r.manifestSHA256 = e.manifest"),
    Rule("encoded bytes", "r.encodedByteCount > 0"),
)
_ENVELOPE_FIELDS = "schemaVersion bigint, evidenceVersion string, buildConfiguration string, manifestSHA256 string, caseID string, encodedByteCount bigint, encodedSHA256 string, outputPixelWidth bigint, outputPixelHeight bigint"

_GENERATION = ("r.generations g",)
_SOURCES = "transform(r.generations, g -> g.sourceByteCount)"
#: A case of the photo matrix. Expected: evidence, manifest, chunk_sizes.
PHOTO_CASE = Validator(
    f"{_ENVELOPE_FIELDS}, chunkSizeBytes bigint, chunkCount bigint, finalPixelRGBSHA256 string, generations array<struct<generation:bigint,sourceByteCount:bigint,encodedByteFractionPPM:bigint,pixelRGBSHA256:string,metricsAgainstFinal:{_METRICS}>>",
    (
        *_ENVELOPE,
        Rule("chunk size", "array_contains(e.chunk_sizes, r.chunkSizeBytes)"),
        Rule("chunk count", "r.chunkCount = try_add(r.encodedByteCount, r.chunkSizeBytes - 1) div nullif(r.chunkSizeBytes, 0)"),
        Rule("digests", f"{_DIGEST.format('r.encodedSHA256')} AND {_DIGEST.format('r.finalPixelRGBSHA256')}"),
        _OUTPUT,
        Rule("generation count", "size(r.generations) BETWEEN 1 AND 4"),
        Rule("generation numbers", _numbered("r.generations", "generation")),
        Rule("source bytes", f"forall({_SOURCES}, n -> n BETWEEN 1 AND r.encodedByteCount) AND {_ascending(_SOURCES)}"),
        Rule("append boundary", "g.sourceByteCount = r.encodedByteCount OR g.sourceByteCount % nullif(r.chunkSizeBytes, 0) = 0", _GENERATION),
        Rule("fractions", f"g.encodedByteFractionPPM = {_millionths('g.sourceByteCount', 'r.encodedByteCount')}", _GENERATION),
        *metrics_rules("g.metricsAgainstFinal", _CHANNELS, _GENERATION),
        Rule("generation digests", _DIGEST.format("g.pixelRGBSHA256"), _GENERATION),
    ),
)

_ATTEMPT = f"struct<sourceStatusRawValue:bigint,frameStatusRawValue:bigint,propertiesAvailable:boolean,rasterAvailable:boolean,outputPixelWidth:bigint,outputPixelHeight:bigint,pixelRGBSHA256:string,metricsAgainstFinal:{_METRICS}>"


def attempt_rules(path: str, each: tuple[str, ...]) -> tuple[Rule, ...]:
    """A decode attempt: statuses and flags are told, and what was drawn is told if and only if something was."""
    a = path
    return (
        Rule("attempt status", f"{a}.sourceStatusRawValue IS NOT NULL AND {a}.frameStatusRawValue IS NOT NULL AND {a}.propertiesAvailable IS NOT NULL AND {a}.rasterAvailable IS NOT NULL", each),
        Rule("attempt without raster", f"{a}.rasterAvailable OR coalesce({a}.outputPixelWidth, {a}.outputPixelHeight) IS NULL AND {a}.pixelRGBSHA256 IS NULL AND {a}.metricsAgainstFinal IS NULL", each),
        Rule("attempt output", f"NOT {a}.rasterAvailable OR {a}.outputPixelWidth = r.outputPixelWidth AND {a}.outputPixelHeight = r.outputPixelHeight AND {_DIGEST.format(f'{a}.pixelRGBSHA256')}", each),
        *metrics_rules(f"{a}.metricsAgainstFinal", _CHANNELS, each, f"NOT {a}.rasterAvailable"),
    )


#: Where a checkpoint of a label lies: fixed names, by the field of the scan that holds the offset.
LABELS = {
    "entropy-end-before-marker": "entropyEndMarkerStartOffset",
    "terminating-marker-code-end": "terminatingMarkerCodeEndOffset",
    "immediate-following-segment-end": "immediateFollowingSegmentEndOffset",
    "next-scan-entropy-start": "nextScanEntropyStartOffset",
}
_SCAN, _CHECKPOINT = ("r.scans s",), ("r.scans s", "s.checkpoints c")
_LABELLED = " ".join(f"WHEN '{label}' THEN s.{field}" for label, field in LABELS.items())
_DRAWN = "array_distinct(transform(filter(s.checkpoints, c -> c.{0}.rasterAvailable), c -> c.{0}.pixelRGBSHA256))"
#: A report of scan checkpoints with two attempts each. Expected: evidence, manifest.
SCAN_CHECKPOINTS = Validator(
    f"{_ENVELOPE_FIELDS}, declaredScanCount bigint, scans array<struct<scan:bigint,entropyStartOffset:bigint,{','.join(f'{field}:bigint' for field in LABELS.values())},terminatingMarkerHex:string,"
    f"checkpoints:array<struct<offset:bigint,labels:array<string>,encodedByteFractionPPM:bigint,freshSource:{_ATTEMPT},sequentialSource:{_ATTEMPT}>>>>",
    (
        *_ENVELOPE,
        Rule("digests", _DIGEST.format("r.encodedSHA256")),
        _OUTPUT,
        Rule("scan count", "size(r.scans) = r.declaredScanCount"),
        Rule("scan numbers", _numbered("r.scans", "scan")),
        Rule("scan order", f"coalesce(get(r.scans, 0).entropyStartOffset > 0, size(r.scans) = 0) AND {_ascending('transform(r.scans, s -> s.entropyStartOffset)')}"),
        Rule("scan bounds", "s.entropyStartOffset < s.entropyEndMarkerStartOffset AND s.entropyEndMarkerStartOffset < s.terminatingMarkerCodeEndOffset AND s.terminatingMarkerCodeEndOffset <= s.immediateFollowingSegmentEndOffset AND s.immediateFollowingSegmentEndOffset <= r.encodedByteCount", _SCAN),
        Rule("next scan", "s.nextScanEntropyStartOffset IS NULL OR s.nextScanEntropyStartOffset BETWEEN s.immediateFollowingSegmentEndOffset AND r.encodedByteCount", _SCAN),
        Rule("marker", "s.terminatingMarkerHex IS NOT NULL", _SCAN),
        Rule("checkpoint offsets", f"size(s.checkpoints) > 0 AND {_ascending('transform(s.checkpoints, c -> c.offset)')}", _SCAN),
        Rule("checkpoint order", _ascending("flatten(transform(r.scans, s -> transform(s.checkpoints, c -> c.offset)))", strictly=False)),
        Rule("labels", f"{_ascending('c.labels')} AND forall(c.labels, l -> coalesce(c.offset = CASE l {_LABELLED} END, false))", _CHECKPOINT),
        Rule("checkpoint fractions", f"c.encodedByteFractionPPM = {_millionths('c.offset', 'r.encodedByteCount')}", _CHECKPOINT),
        *attempt_rules("c.freshSource", _CHECKPOINT),
        *attempt_rules("c.sequentialSource", _CHECKPOINT),
        Rule("attempts differ", "c.freshSource.rasterAvailable = c.sequentialSource.rasterAvailable AND c.freshSource.pixelRGBSHA256 <=> c.sequentialSource.pixelRGBSHA256", _CHECKPOINT),
        Rule("entropy end", "size(filter(s.checkpoints, c -> array_contains(c.labels, 'entropy-end-before-marker'))) = 1", _SCAN),
        Rule("pixels within a scan", f"size({_DRAWN.format('freshSource')}) = 1 AND {_DRAWN.format('freshSource')} = {_DRAWN.format('sequentialSource')}", _SCAN),
    ),
)

_SAMPLES = "array<struct<generations:array<struct<generation:bigint,sourceByteCount:bigint,elapsedNanoseconds:bigint>>,finishElapsedNanoseconds:bigint,totalElapsedNanoseconds:bigint>>"
_SUMMARY = f"struct<generationCount:bigint,firstPreviewSourceByteCount:bigint,firstPreviewEncodedByteFractionPPM:bigint,firstPreviewElapsed:{_STATISTICS},generations:array<struct<generation:bigint,sourceByteCount:bigint,encodedByteFractionPPM:bigint,elapsed:{_STATISTICS}>>,finishElapsed:{_STATISTICS},totalElapsed:{_STATISTICS}>"
_SOURCE = "struct<encodedByteCount:bigint,encodedSHA256:string>"


def _summary_rules(t: str, each: tuple[str, ...] = ()) -> tuple[Rule, ...]:
    """The samples of a timeline ``t`` are of one shape, and its summary follows from them."""
    first, bytes_of = f"get({t}.samples, 0).generations", f"{t}.source.encodedByteCount"
    identity = "transform({0}, q -> struct(q.generation, q.sourceByteCount))"
    elapsed = f"transform({t}.samples, q -> get(q.generations, i).elapsedNanoseconds)"
    generations = f"transform({first}, (q, i) -> named_struct('generation', q.generation, 'sourceByteCount', q.sourceByteCount, 'encodedByteFractionPPM', least(1000000, {_millionths('q.sourceByteCount', bytes_of)}), 'elapsed', {_statistics(elapsed)}))"
    summary = f"{t}.summary"
    return (
        Rule("sample shapes", f"size({first}) BETWEEN 2 AND 4 AND forall({t}.samples, x -> {identity.format('x.generations')} = {identity.format(first)})", each),
        Rule("summary of generations", f"{summary}.generationCount = size({first}) AND {summary}.generations = {generations}", each),
        Rule("summary of first preview", f"{summary}.firstPreviewSourceByteCount = get({first}, 0).sourceByteCount AND {summary}.firstPreviewEncodedByteFractionPPM = least(1000000, {_millionths(f'get({first}, 0).sourceByteCount', bytes_of)}) AND {summary}.firstPreviewElapsed = get({summary}.generations, 0).elapsed", each),
        Rule("summary of ends", f"{summary}.finishElapsed = {_statistics(f'transform({t}.samples, q -> q.finishElapsedNanoseconds)')} AND {summary}.totalElapsed = {_statistics(f'transform({t}.samples, q -> q.totalElapsedNanoseconds)')}", each),
    )


#: One process's timeline. Expected: benchmark, chunk_sizes (by case id).
PROCESS_TIMELINE = Validator(
    f"schemaVersion bigint, benchmarkVersion string, buildConfiguration string, caseID string, chunkSizeBytes bigint, warmupIterations bigint, iterations bigint, samples {_SAMPLES}, source {_SOURCE}, output map<string,bigint>, summary {_SUMMARY}, environment struct<lowPowerModeEnabled:boolean,thermalState:string>",
    (
        Rule("schema", "r.schemaVersion = 1"),
        Rule("benchmark", "r.benchmarkVersion = e.benchmark"),
        Rule("build", "r.buildConfiguration = 'release'"),
        Rule("case", "map_contains_key(e.chunk_sizes, r.caseID)"),
        Rule("chunk size", "r.chunkSizeBytes = try_element_at(e.chunk_sizes, r.caseID)"),
        Rule("warmup", "r.warmupIterations = 2"),
        Rule("sample count", "r.iterations > 0 AND size(r.samples) = r.iterations"),
        Rule("source", "r.source.encodedByteCount > 0 AND r.source.encodedSHA256 <> '' AND size(r.output) > 0"),
        Rule("generation times", f"size(s.generations) > 0 AND {_ascending('transform(s.generations, g -> g.elapsedNanoseconds)', strictly=False)}", ("r.samples s",)),
        Rule("end times", "s.finishElapsedNanoseconds >= try_element_at(s.generations, -1).elapsedNanoseconds AND s.totalElapsedNanoseconds >= s.finishElapsedNanoseconds", ("r.samples s",)),
        *_summary_rules("r"),
        Rule("low power", "NOT coalesce(r.environment.lowPowerModeEnabled, false)"),
        Rule("thermal state", "r.environment.thermalState IN ('nominal', 'fair')"),
    ),
)

_CASE = ("r.cases t",)
_CASE_SOURCES = "transform(t.summary.generations, g -> g.sourceByteCount)"
#: A campaign over all cases, three processes of seven samples each. Expected: benchmark, chunk_sizes (by case id).
CAMPAIGN = Validator(
    f"schemaVersion bigint, benchmarkVersion string, buildConfiguration string, swiftVersion string, runtime string, decoderFingerprint string, hardware map<string,string>, cases array<struct<caseID:string,processRepetitions:bigint,warmupIterationsPerProcess:bigint,iterationsPerProcess:bigint,totalIterations:bigint,chunkSizeBytes:bigint,samples:{_SAMPLES},source:{_SOURCE},output:map<string,bigint>,summary:{_SUMMARY},environment:struct<lowPowerModeEnabled:boolean,thermalStates:array<string>>>>",
    (
        Rule("schema", "r.schemaVersion = 1"),
        Rule("benchmark", "r.benchmarkVersion = e.benchmark"),
        Rule("build", "r.buildConfiguration = 'release'"),
        Rule("identity", "r.swiftVersion <> '' AND r.runtime <> '' AND r.decoderFingerprint <> '' AND size(r.hardware) > 0"),
        Rule("case set", "array_sort(transform(r.cases, t -> t.caseID)) = array_sort(map_keys(e.chunk_sizes))"),
        Rule("repetitions", "t.processRepetitions = 3 AND t.warmupIterationsPerProcess = 2 AND t.iterationsPerProcess = 7 AND t.totalIterations = 21", _CASE),
        Rule("chunk size", "t.chunkSizeBytes = try_element_at(e.chunk_sizes, t.caseID)", _CASE),
        Rule("sample count", "size(t.samples) = 21", _CASE),
        Rule("source", "t.source.encodedByteCount > 0 AND t.source.encodedSHA256 <> '' AND size(t.output) > 0", _CASE),
        *_summary_rules("t", _CASE),
        Rule("generations", f"t.summary.generationCount = 4 AND {_numbered('t.summary.generations', 'generation')} AND {_ascending(_CASE_SOURCES)}", _CASE),
        Rule("first preview", "t.summary.firstPreviewSourceByteCount % nullif(t.chunkSizeBytes, 0) = 0", _CASE),
        Rule("low power", "NOT coalesce(t.environment.lowPowerModeEnabled, false)", _CASE),
        Rule("thermal states", "size(array_except(coalesce(t.environment.thermalStates, array()), array('nominal', 'fair'))) = 0", _CASE),
    ),
)


def failures(rows: DataFrame, key: str, document: str, validator: Validator, expected: Mapping[str, Column]) -> DataFrame:
    """``key`` and ``broken`` of every report: the first rule that it breaks, ``json`` for text that is no object, null for a good one.

    No shuffle. ``expected`` holds the columns that the validator's rules call e.
    """
    parsed = rows.select(F.col(key).alias("key"), F.from_json(F.col(document).cast("string"), validator.schema, {"mode": "PERMISSIVE"}).alias("r"), F.col(document).cast("string").alias("text"), F.struct(*(v.alias(k) for k, v in expected.items())).alias("e"))
    readable = F.coalesce(F.get_json_object("text", "$").startswith("{"), F.lit(False))
    return parsed.select(F.col("key").alias(key), first_broken({"json": readable} | _by_name(validator)).alias("broken"))


def _by_name(validator: Validator) -> dict[str, Column]:
    """Rules by name; rules of one name, as for both attempts of a checkpoint, are one."""
    rules: dict[str, Column] = {}
    for rule in validator.rules:
        rules[rule.name] = rules[rule.name] & rule.condition() if rule.name in rules else rule.condition()
    return rules


def group_failures(rows: DataFrame, groups: list[str], document: str, validator: Validator, same: list[str], reports: int) -> DataFrame:
    """Per group of reports: ``broken`` is ``reports`` if there aren't so many, else the first path of ``same`` that has several values in them (null is one of its own).

    Least and greatest spelling of a value are compared, so that a group of any size is combined before the shuffle and never gathered.
    """
    parsed = rows.select(*groups, F.from_json(F.col(document).cast("string"), validator.schema).alias("r"))
    spelt = {path: F.to_json(F.struct(F.expr(f"r.{path}").alias("v"))) for path in same}
    sums = parsed.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"), *(x for i, v in enumerate(spelt.values()) for x in (F.min(v).alias(f"_low{i}"), F.max(v).alias(f"_high{i}"))))
    rules = {"reports": F.col("_n") == reports} | {path: F.col(f"_low{i}").eqNullSafe(F.col(f"_high{i}")) for i, path in enumerate(same)}
    return sums.select(*groups, first_broken(rules).alias("broken"))
