"""Queries over encoded images that are built from table rows, so that SQL can tell what each must give."""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..contracts import DecodeLimits
from ..functions import builders as b
from ..functions import jpeg
from ..operators import prepared
from ..operators.probe import container_parts as parts
from ..operators.probe import decode, decoded_again, jpeg_structures, prefix_decodes, previews, probe, scan_boundaries
from ..shipping import ship, spread
from ..sources.files import table
from .registry import query

LIMITS = DecodeLimits(encoded_bytes=2_400, dimension=3_000, pixel_count=6_000_000, metadata_bytes=1_500)

#: One image for each part: its kind by the key, sizes by key and p_size. ``n``: metadata bytes, ``c``: profile chunks.
_IMAGES = """(SELECT *, CASE kind WHEN 0 THEN 70 WHEN 1 THEN 120 + n WHEN 2 THEN 68 + n WHEN 3 THEN 75 + n WHEN 4 THEN 2 + 38 + (c - 1) * (18 + p_size) + 33 WHEN 5 THEN 13 + m + 4 + 15 * f + 1 WHEN 6 THEN 35 ELSE 4 + n END AS size FROM (
  SELECT p_partkey AS k, p_partkey % 8 AS kind, p_size, p_size * 50 AS n, p_size * 5 AS m, p_partkey // 8 % 2 + 1 AS f, p_partkey // 8 % 3 + 1 AS c, p_partkey // 8 % 5 = 0 AS gap, p_partkey // 8 % 7 = 0 AS grey, p_partkey // 8 % 10 AS o, p_size * 64 AS w, p_partkey % 900 * 3 + 7 AS h FROM part))"""


def _images(spark, sf_dir) -> DataFrame:
    key = F.col("p_partkey")
    other = F.floor(key / 8).cast("long")
    size = F.col("p_size").cast("long")
    made = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select(key.alias("k"), (key % 8).alias("kind"), size.alias("p"), (size * 50).alias("n"), (size * 5).alias("m"), (other % 2 + 1).alias("f"), (other % 3 + 1).alias("c"), (other % 5 == 0).alias("gap"), (other % 7 == 0).alias("grey"), (other % 10).alias("o"), (size * 64).alias("w"), (key % 900 * 3 + 7).alias("h"))
    w, h, n = F.col("w"), F.col("h"), F.col("n")
    exif = F.concat(F.lit("Exif").cast("binary"), F.unhex(F.lit("0000")), b.exif_block(F.col("o")))
    empty, tag = F.unhex(F.lit("")), F.concat(F.lit("ICC_PROFILE").cast("binary"), F.unhex(F.lit("00")))
    srgb, data = b.png_chunk("sRGB", F.unhex(F.lit("00"))), b.png_chunk("IDAT", empty)
    count = F.col("c") + F.col("gap").cast("long")  # with a gap one more chunk is declared than comes
    head = F.concat(b.filled(16), F.when(F.col("grey"), F.lit("GRAY")).otherwise(F.lit("RGB ")).cast("binary"))

    def icc(number: int):
        body = head if number == 1 else b.filled(F.col("p"))
        return F.when(F.lit(number) <= F.col("c"), b.jpeg_segment("E2", F.concat(tag, b.big_endian(number, 1), b.big_endian(count, 1), body))).otherwise(empty)

    text = b.png_file(w, h, b.png_chunk("tEXt", b.filled(n, "61")))
    kinds = [
        b.png_file(w, h, srgb, data),
        b.png_file(w, h, srgb, b.png_chunk("iCCP", b.filled(n)), b.png_chunk("eXIf", b.exif_block(F.col("o"))), data),
        F.substring(text, F.lit(1), F.octet_length(text) - 1),
        b.jpeg_file(b.jpeg_segment("E1", exif), b.jpeg_segment("FE", b.filled(n, "62")), b.jpeg_frame("C0", w, h)),
        b.jpeg_file(icc(1), icc(2), icc(3), b.jpeg_frame("C2", w, h)),
        b.gif_file(w, h, F.col("f"), b.filled(F.col("m"), "63")),
        F.concat(F.unhex(F.lit("FFD8")), b.jpeg_file(b.jpeg_frame("C0", w, h))),
        F.concat(F.lit("BM\0\0").cast("binary"), b.filled(n)),
    ]
    content = F.coalesce(*(F.when(F.col("kind") == i, made_of) for i, made_of in enumerate(kinds)))
    return made.select("k", content.alias("content"))


@query(f"""WITH i AS (SELECT *, CASE WHEN size > 2400 THEN 'encodedBytesExceeded' WHEN kind = 7 THEN 'unsupportedFormat' WHEN kind IN (1, 2, 3) AND meta > 1500 THEN 'metadataLimitExceeded' WHEN kind IN (2, 6) THEN 'unsupportedOrCorruptImage'
  WHEN kind = 4 AND gap THEN 'unsupportedOrCorruptImage' END AS broken, kind = 4 AND grey AND NOT gap AS odd, kind IN (1, 3) AND o BETWEEN 5 AND 8 AS turned FROM (SELECT *, CASE kind WHEN 1 THEN n + 26 WHEN 2 THEN n WHEN 3 THEN n + 32 WHEN 4 THEN 34 + (c - 1) * (14 + p_size) WHEN 5 THEN m ELSE 0 END AS meta FROM {_IMAGES}))
  SELECT k, CASE WHEN broken IS NULL THEN CASE WHEN kind < 3 THEN 'png' WHEN kind < 5 THEN 'jpeg' ELSE 'gif' END END AS format, CASE WHEN broken IS NULL THEN CAST(CASE WHEN turned THEN h ELSE w END AS BIGINT) END AS width, CASE WHEN broken IS NULL THEN CAST(CASE WHEN turned THEN w ELSE h END AS BIGINT) END AS height,
  CASE WHEN broken IS NULL THEN CAST(CASE WHEN kind = 5 THEN f ELSE 1 END AS BIGINT) END AS frame_count, CASE WHEN broken IS NULL THEN CAST(CASE WHEN kind IN (1, 3) AND o BETWEEN 1 AND 8 THEN o ELSE 1 END AS INTEGER) END AS orientation, CASE WHEN broken IS NULL THEN CAST(meta AS BIGINT) END AS metadata_byte_count, CAST(0 AS BIGINT) AS attachment_count,
  CASE WHEN broken IS NULL THEN CASE kind WHEN 0 THEN 'standardSRGB' WHEN 1 THEN 'embeddedICC' WHEN 4 THEN 'embeddedICC' ELSE 'absent' END END AS source_profile,
  CASE WHEN broken IS NOT NULL THEN broken WHEN odd THEN 'unsupportedOrCorruptImage' WHEN greatest(w, h) > 3000 THEN 'dimensionLimitExceeded' WHEN w * h > 6000000 THEN 'pixelLimitExceeded' WHEN kind = 5 AND f > 1 THEN 'frameLimitExceeded' END AS failure FROM i""")
def corpus_probe(spark, sf_dir):
    """Sniffing, container walks, metadata and profile accounting, orientation, admission in their order."""
    return probe(_images(spark, sf_dir), limits=LIMITS)


@query(f"""WITH i AS (SELECT *, CASE kind
  WHEN 0 THEN [('IHDR', 0, 13, 25, false), ('sRGB', 0, 1, 13, false), ('IDAT', 0, 0, 12, false), ('IEND', 0, 0, 12, false)]
  WHEN 1 THEN [('IHDR', 0, 13, 25, false), ('sRGB', 0, 1, 13, false), ('iCCP', 0, n, n + 12, true), ('eXIf', 0, 26, 38, true), ('IDAT', 0, 0, 12, false), ('IEND', 0, 0, 12, false)]
  WHEN 2 THEN [('IHDR', 0, 13, 25, false), ('tEXt', 0, n, n + 12, true)]
  WHEN 3 THEN [('E1', 1, 32, 36, true), ('FE', 1, n, n + 4, true), ('C0', 1, 9, 13, false), ('DA', 1, 6, 18, false), ('D9', 1, 0, 2, false)]
  WHEN 4 THEN list_concat(list_transform(range(c), lambda x: ('E2', 1, CASE WHEN x = 0 THEN 34 ELSE 14 + p_size END, CASE WHEN x = 0 THEN 38 ELSE 18 + p_size END, true)), [('C2', 1, 9, 13, false), ('DA', 1, 6, 18, false), ('D9', 1, 0, 2, false)])
  WHEN 5 THEN list_concat([('21', 0, m, m + 4, true)], list_concat(list_transform(range(f), lambda x: ('2C', 0, 2, 15, false)), [('3B', 0, 0, 1, false)])) ELSE [] END AS p, CASE WHEN kind < 3 THEN 8 WHEN kind = 5 THEN 13 ELSE 2 END AS start FROM {_IMAGES})
  SELECT k, x[1] AS kind, CAST(start + x[2] + before AS BIGINT) AS "offset", CAST(x[3] AS BIGINT) AS payload_length, x[5] AS is_metadata, NULL AS failure FROM (
  SELECT k, start, unnest(p) AS x, unnest(list_transform(range(len(p)), lambda j: coalesce(list_sum(list_transform(p[1:j], lambda q: q[4])), 0))) AS before FROM i)
  UNION ALL SELECT k, NULL, NULL, NULL, NULL, CASE kind WHEN 7 THEN 'unsupportedFormat' ELSE 'unsupportedOrCorruptImage' END FROM i WHERE kind IN (2, 6, 7)""")
def container_parts(spark, sf_dir):
    """Every chunk, segment and block up to the first corruption."""
    return parts(_images(spark, sf_dir), ["k"])


_PROPERTY_LIMITS = DecodeLimits(encoded_bytes=4_096, metadata_bytes=1_500, attachments=2)


@query("""WITH p AS (SELECT doc_id AS k, doc_id % 8 AS kind, doc_id // 8 % 5 + 1 AS f, n_chars % 50 * 10 + 10 AS m FROM documents),
  s AS (SELECT *, CASE kind WHEN 0 THEN 26 WHEN 3 THEN 32 + 12 * f + f * m WHEN 5 THEN 38 + 16 * f ELSE 14 + 12 * f + f * m END AS held,
    CASE kind WHEN 0 THEN 32 WHEN 3 THEN 38 + 12 * f + m WHEN 5 THEN 42 + 16 * f WHEN 7 THEN 14 + 12 * f + m ELSE 20 + 12 * f + m END AS told, kind IN (2, 6) OR kind = 4 AND f % 2 = 1 AS unmeasurable FROM p),
  r AS (SELECT *, CASE WHEN unmeasurable OR held > 1500 THEN 'metadataLimitExceeded' WHEN kind = 5 AND f > 3 THEN 'auxiliaryAttachmentLimitExceeded' END AS failure FROM s)
  SELECT k, CASE WHEN failure IS DISTINCT FROM 'metadataLimitExceeded' THEN CAST(greatest(held, told) AS BIGINT) END AS metadata_byte_count, CAST(CASE WHEN kind = 5 THEN f - 1 ELSE 0 END AS BIGINT) AS attachment_count, CASE WHEN failure IS NULL THEN 1 END AS orientation, failure FROM r""")
def property_limits(spark, sf_dir):
    """Images whose EXIF fields share bytes, point at a directory of their own or beyond the block, run in a circle, or list pictures: the larger of two metadata sizes, attachments, and what can't be measured."""
    key, empty = F.col("doc_id"), F.unhex(F.lit(""))
    other = F.floor(key / 8).cast("long")
    made = table(spark, sf_dir, "documents").select(key.alias("k"), (key % 8).alias("kind"), (other % 5 + 1).alias("f"), (F.col("n_chars") % 50 * 10 + 10).cast("long").alias("m"))
    f, m = F.col("f"), F.col("m")
    value, note, pointer = b.filled(m, "61"), 0x9286, 8 + 6 + 12

    def notes(start, late=0):
        return b.directory(f, b.repeated(b.entry(note, 7, m, start + 6 + 12 * f + late), f))

    def exif(block):
        return b.jpeg_segment("E1", F.concat(F.lit("Exif").cast("binary"), F.unhex(F.lit("0000")), block))

    def index(listed):
        entries = b.directory(2, b.entry(0xB001, 4, 1, listed), b.entry(0xB002, 7, 16 * f, 38))
        return b.jpeg_segment("E2", F.concat(F.lit("MPF").cast("binary"), F.unhex(F.lit("00")), b.tiff_block(entries, b.filled(16 * f))))

    shared = b.tiff_block(notes(F.lit(8)), value)
    segments = [
        exif(b.exif_block(F.lit(1))),
        exif(shared),
        exif(b.tiff_block(b.directory(1, b.entry(note, 7, 4, 0), after=8))),
        exif(b.tiff_block(b.directory(1, b.entry(0x8825, 4, 1, pointer)), notes(F.lit(pointer)), value)),
        exif(b.tiff_block(notes(F.lit(8), f % 2), value)),
        index(f),
        index(f + 1),
        empty,
    ]
    segment = F.coalesce(*(F.when(F.col("kind") == i, s) for i, s in enumerate(segments)))
    content = F.when(F.col("kind") == 7, b.png_file(9, 7, b.png_chunk("eXIf", shared), b.png_chunk("IDAT", empty))).otherwise(b.jpeg_file(segment, b.jpeg_frame("C0", 9, 7)))
    return probe(made.select("k", content.alias("content")), limits=_PROPERTY_LIMITS).select("k", "metadata_byte_count", "attachment_count", "orientation", "failure")


def _progressive(spark, sf_dir) -> DataFrame:
    """Supplier images of 1 to 10 scans with two quantisation tables; every ninth is baseline, every tenth has no end."""
    key = F.col("s_suppkey")
    dqt = b.jpeg_segment("DB", F.concat(b.big_endian(key, 2), b.filled(key % 60)))
    frame = F.when(key % 9 == 0, b.jpeg_frame("C0", key % 500 + 1, key % 400 + 2)).otherwise(b.jpeg_frame("C2", key % 500 + 1, key % 400 + 2))
    empty = F.unhex(F.lit(""))
    whole = b.jpeg_file(dqt, dqt, frame, scans=key % 10 + 1)
    return table(spark, sf_dir, "supplier").select(key.alias("k"), F.when(key % 10 == 7, F.substring(whole, F.lit(1), F.octet_length(whole) - 2)).otherwise(F.concat(whole, empty)).alias("content"))


@query("""SELECT k, CASE WHEN ok THEN CASE WHEN k % 9 = 0 THEN 'C0' ELSE 'C2' END END AS frame_marker, CASE WHEN ok THEN 8 END AS sample_precision, CASE WHEN ok THEN CAST(k % 500 + 1 AS INTEGER) END AS width, CASE WHEN ok THEN CAST(k % 400 + 2 AS INTEGER) END AS height, CASE WHEN ok THEN 1 END AS component_count,
  CASE WHEN ok THEN sha256(unhex(repeat(printf('%04x', k) || repeat('00', k % 60), 2))) END AS quantization_sha256, CASE WHEN ok THEN CAST(k % 10 + 1 AS INTEGER) END AS scan_count, CASE WHEN NOT ok THEN 'unsupportedOrCorruptImage' END AS failure, CASE WHEN ok THEN k % 9 <> 0 END AS progressive
  FROM (SELECT s_suppkey AS k, s_suppkey % 10 <> 7 AS ok FROM supplier)""")
def jpeg_structure(spark, sf_dir):
    return jpeg_structures(_progressive(spark, sf_dir), "k")


@query("""WITH s AS (SELECT k, n, unnest(range(1, n + 1)) AS scan, 2 + 2 * (6 + k % 60) + 13 AS start FROM (SELECT s_suppkey AS k, s_suppkey % 10 + 1 AS n FROM supplier WHERE s_suppkey % 10 <> 7)),
  e AS (SELECT *, start + 18 * (scan - 1) + 10 AS a, start + 18 * scan AS z FROM s), l AS (SELECT k, n, scan, a, z, unnest([(z, 'entropy-end-before-marker'), (z + 2, 'terminating-marker-code-end'), (CASE WHEN scan < n THEN z + 10 ELSE z + 2 END, 'immediate-following-segment-end'), (CASE WHEN scan < n THEN z + 10 ELSE z + 2 END, 'next-scan-entropy-start')]) AS x FROM e)
  SELECT k, CAST(scan AS INTEGER) AS scan, CAST(a AS BIGINT) AS entropy_start, CAST(z AS BIGINT) AS entropy_end, CASE WHEN scan < n THEN 'DA' ELSE 'D9' END AS terminating_marker, CAST(x[1] AS BIGINT) AS "offset", list_sort(list(x[2])) AS labels FROM l GROUP BY k, scan, n, a, z, x[1]""")
def scan_checkpoints(spark, sf_dir):
    """Boundaries of every scan and the prefixes worth decoding around its end, with their labels."""
    return scan_boundaries(_progressive(spark, sf_dir), "k")


_LABELS = ("entropy-end-before-marker", "terminating-marker-code-end", "immediate-following-segment-end", "next-scan-entropy-start")


@query("""SELECT s_suppkey AS k, CAST(n AS INTEGER) AS scan, label, CAST(start + 18 * n + CASE label WHEN 'entropy-end-before-marker' THEN 0 ELSE 2 END AS BIGINT) AS "offset" FROM (SELECT s_suppkey, s_suppkey % 10 + 1 AS n, 2 + 2 * (6 + s_suppkey % 60) + 13 AS start FROM supplier WHERE s_suppkey % 10 <> 7),
  (VALUES ('entropy-end-before-marker'), ('terminating-marker-code-end'), ('immediate-following-segment-end'), ('next-scan-entropy-start')) v(label)""")
def label_offsets(spark, sf_dir):
    """The prefix length of each label at a file's last scan, by lookup in a map."""
    found = scan_boundaries(_progressive(spark, sf_dir), "k")
    flat = found.select("k", "scan", "offset", F.explode("labels").alias("label"))
    maps = flat.groupBy("k", "scan").agg(F.map_from_entries(F.collect_list(F.struct("label", "offset"))).alias("by_label"))
    last = maps.groupBy("k").agg(F.max_by(F.struct("scan", "by_label"), "scan").alias("last")).select("k", "last.*")
    wanted = F.explode(F.array(*(F.lit(x) for x in _LABELS))).alias("label")
    return last.select("k", "scan", "by_label", wanted).select("k", "scan", "label", F.col("by_label")[F.col("label")].alias("offset"))


@query("""SELECT p_partkey, p_size * 65536 + p_partkey % 65536 AS word, p_partkey % 65536 AS half, p_partkey % 256 AS last, p_size % 256 = 1 AS starts, CAST(NULL AS BIGINT) AS beyond, p_partkey % 128 AS masked, CAST(p_size AS BIGINT) AS shifted FROM part""")
def binary_reads(spark, sf_dir):
    """Big-endian reads, prefix tests, masks and shifts on byte columns."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("long")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(b.big_endian(size, 2), b.big_endian(key, 2)).alias("c"), size.alias("p"))
    c = F.col("c")
    word = b.read_big_endian(c, 0, 4)
    low = b.read_big_endian(c, 3, 1)
    return rows.select("p_partkey", word.alias("word"), b.read_big_endian(c, 2, 2).alias("half"), low.alias("last"), b.has_prefix_at(c, 1, b"\1").alias("starts"), b.read_big_endian(c, 2, 4).alias("beyond"), low.bitwiseAND(127).alias("masked"), F.shiftright(word, 16).alias("shifted"))


#: Pictures of flat cells, one for each part: cells across and down, and the value of a cell.
_CELLS = """(SELECT p_partkey AS k, 8 * (p_partkey % 3 + 1) AS w, 8 * (p_size % 3 + 1) AS h FROM part)"""


def _cells_sha(value: str) -> str:
    return f"sha256(unhex(list_aggregate(list_transform(range(w * h), lambda i: printf('%02x', CAST({value} AS INTEGER))), 'string_agg', '')))"


_CELL = "((k * 7 + i % w // 8 * 13 + i // w // 8 * 29) % 256)"
#: Scans that send the means of cells with four bits left out, then one after another.
_MEANS = ((None, 0, 0, 0, 4), (None, 0, 0, 4, 3), (None, 0, 0, 3, 2), (None, 0, 0, 2, 1), (None, 0, 0, 1, 0))


@lru_cache(maxsize=8192)
def _cell_file(value: int, across: int, down: int, script) -> bytes:
    y, x = np.mgrid[: 8 * down, : 8 * across]
    return jpeg.encode(((value * 7 + x // 8 * 13 + y // 8 * 29) % 256).astype(np.uint8)[:, :, None], 1.0, script)


@lru_cache(maxsize=16384)
def _ink_file(inks: tuple[int, ...]) -> bytes:
    return jpeg.encode(np.tile(np.array(inks, dtype=np.uint8), (8, 8, 1)), 1.0)


def _cell_files(spark, sf_dir, script=None) -> DataFrame:
    """Grey JPEG files of flat cells at quality 1, which keep every value."""
    ship(spark)

    def made(keys: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([_cell_file(k % 256, k % 3 + 1, size % 3 + 1, script) for k, size in zip(keys.tolist(), sizes.tolist())], dtype=object)

    key, size = F.col("p_partkey"), F.col("p_size")
    dealt = spread(table(spark, sf_dir, "part").select(key, size), key % 256, key % 3, size % 3)  # equal pictures to one task
    return dealt.select(key.alias("k"), pandas_udf(made, "binary")(key, size).alias("content"))


@query(f"""SELECT k, mode, CAST(w AS INTEGER) AS width, CAST(h AS INTEGER) AS height, 1 AS channels, {_cells_sha(_CELL)} AS pixels_sha256, true AS survives FROM {_CELLS}, (VALUES ('baseline'), ('progressive')) m(mode)""")
def jpeg_round_trip(spark, sf_dir):
    """Baseline and progressive JPEG decoded, encoded and decoded again without loss."""
    whole = (DecodeLimits().dimension,) * 2
    out = []
    for mode, script in (("baseline", None), ("progressive", jpeg.PROGRESSIVE)):
        both = decoded_again(decode(_cell_files(spark, sf_dir, script), "k", whole), ["pixels"], format="jpeg", quality=1.0, progressive=script is not None)
        out.append(both.select("k", F.lit(mode).alias("mode"), "width", "height", "channels", F.sha2("pixels", 256).alias("pixels_sha256"), (F.col("pixels") == F.col("again")).alias("survives")))
    return out[0].unionByName(out[1])


#: Scan scripts of a corpus; all leave the same final pixels.
_SCRIPTS = {"baseline": None, "bands": ((None, 0, 0, 0, 0), (0, 1, 5, 0, 0), (0, 6, 63, 0, 0)), "means-by-bit": (*_MEANS, (0, 1, 63, 0, 0)), "successive": jpeg.PROGRESSIVE}


@query(f"""SELECT k, script, {_cells_sha(_CELL)} AS pixels_sha256, true AS same_as_baseline FROM {_CELLS}, (VALUES ('baseline'), ('bands'), ('means-by-bit'), ('successive')) s(script)""")
def scan_script_corpus(spark, sf_dir):
    """Sources by scan scripts: every script's file decodes to the same final pixels."""
    whole = (DecodeLimits().dimension,) * 2
    made = [decode(_cell_files(spark, sf_dir, script), "k", whole).select("k", F.lit(name).alias("script"), F.sha2("pixels", 256).alias("pixels_sha256")) for name, script in _SCRIPTS.items()]
    base = F.max(F.when(F.col("script") == "baseline", F.col("pixels_sha256"))).over(Window.partitionBy("k"))  # no second decoding of the baseline files
    return reduce(DataFrame.unionByName, made).select("k", "script", "pixels_sha256", (F.col("pixels_sha256") == base).alias("same_as_baseline"))


@query("""SELECT k, 3 AS channels, sha256(unhex(repeat(printf('%02x%02x%02x', CAST(floor(c * b / 255.0 + 0.5) AS INTEGER), CAST(floor(m * b / 255.0 + 0.5) AS INTEGER), CAST(floor(y * b / 255.0 + 0.5) AS INTEGER)), 64))) AS pixels_sha256, CAST(NULL AS VARCHAR) AS failure
  FROM (SELECT p_partkey AS k, p_partkey % 256 AS c, p_partkey * 3 % 256 AS m, p_size * 5 % 256 AS y, (p_partkey + p_size) * 7 % 256 AS b FROM part)""")
def cmyk_files(spark, sf_dir):
    """JPEG files of four inverted ink channels, decoded to RGB."""
    ship(spark)

    def made(keys: pd.Series, sizes: pd.Series) -> pd.Series:
        inks = [(k % 256, k * 3 % 256, s * 5 % 256, (k + s) * 7 % 256) for k, s in zip(keys.tolist(), sizes.tolist())]
        return pd.Series([_ink_file(i) for i in inks], dtype=object)

    key, size = F.col("p_partkey"), F.col("p_size")
    dealt = spread(table(spark, sf_dir, "part").select(key, size), key % 256, size % 256)  # equal pictures to one task
    files = dealt.select(key.alias("k"), pandas_udf(made, "binary")(key, size).alias("content"))
    return decode(files, "k", (64, 64)).select("k", "channels", F.sha2("pixels", 256).alias("pixels_sha256"), "failure")


@query(f"""SELECT k, CAST(w AS INTEGER) AS width, CAST(h AS INTEGER) AS height, {_cells_sha(_CELL)} AS pixels_sha256, true AS timed FROM {_CELLS}""")
def instrumented_decode(spark, sf_dir):
    """Decoding with diagnostics: the same pixels, and nanoseconds of both steps."""
    rows = decode(_cell_files(spark, sf_dir), "k", (64, 64), diagnostics=True)
    return rows.select("k", "width", "height", F.sha2("pixels", 256).alias("pixels_sha256"), ((F.col("decode_ns") > 0) & (F.col("render_ns") >= 0)).alias("timed"))


@query(f"""WITH c AS (SELECT *, {_cells_sha(_CELL)} AS whole, {_cells_sha(f'{_CELL} - {_CELL} % 2')} AS half, len(list_filter(range(w * h), lambda i: {_CELL} % 2 = 1)) AS odd FROM {_CELLS}), l AS (SELECT *, unnest(range(1, 6)) AS scan FROM c),
  p AS (SELECT *, unnest(CASE WHEN scan < 5 THEN [['entropy-end-before-marker'], ['terminating-marker-code-end'], ['immediate-following-segment-end', 'next-scan-entropy-start']] ELSE [['entropy-end-before-marker'], ['immediate-following-segment-end', 'next-scan-entropy-start', 'terminating-marker-code-end']] END) AS labels FROM l)
  SELECT k, CAST(scan AS INTEGER) AS scan, labels, true AS available, CASE WHEN scan = 1 THEN half ELSE whole END AS pixels_sha256, scan > 1 OR odd = 0 AS is_final, CASE WHEN scan = 1 THEN CAST(odd * 1000000 // (w * h) AS BIGINT) ELSE 0 END AS mse_micro FROM p""")
def prefix_decode(spark, sf_dir):
    """Every prefix around the ends of scans, decoded on its own: the first scan leaves the last bit of each value out."""
    return prefix_decodes(_cell_files(spark, sf_dir, _MEANS), "k").drop("offset")


@query(f"""SELECT k, CAST(g AS INTEGER) AS generation, CAST(scan AS INTEGER) AS scan, CAST(w AS INTEGER) AS width, CAST(h AS INTEGER) AS height, CASE WHEN scan = 1 THEN {_cells_sha(f'{_CELL} - {_CELL} % 2')} ELSE {_cells_sha(_CELL)} END AS pixels_sha256, CAST(NULL AS VARCHAR) AS failure FROM {_CELLS}, (VALUES (1, 1), (2, 2), (3, 4), (NULL, 5)) v(g, scan)""")
def session_previews(spark, sf_dir):
    """What a progressive session draws: previews at 1, 2 and 4 scans, then the final picture."""
    return previews(_cell_files(spark, sf_dir, _MEANS), "k").withColumn("pixels_sha256", F.sha2("pixels", 256)).drop("pixels")


_COLOURS = ("sRGB", "Display P3", "Generic Gray Gamma 2.2", None)


@query("""SELECT p_partkey, profile, interpreted, CASE WHEN (policy = 'convertToSRGB' AND coalesce(interpreted, image, '') <> 'sRGB') OR (interpreted IS NOT NULL AND interpreted IS DISTINCT FROM image AND image IS NOT NULL AND (interpreted LIKE 'Generic%') <> (image LIKE 'Generic%')) THEN 'convert'
  WHEN interpreted IS NULL OR interpreted IS NOT DISTINCT FROM image THEN 'keep' ELSE 'retag' END AS step FROM (SELECT *, CASE WHEN profile IN ('absent', 'standardSRGB') THEN 'sRGB' WHEN profile = 'embeddedICC' THEN coalesce(inspected, image) ELSE coalesce(image, inspected) END AS interpreted FROM (
  SELECT p_partkey, ['absent','standardSRGB','embeddedICC','unknown'][p_partkey % 4 + 1] AS profile, ['sRGB','Display P3','Generic Gray Gamma 2.2',NULL][p_partkey // 4 % 4 + 1] AS inspected, ['sRGB','Display P3','Generic Gray Gamma 2.2',NULL][p_partkey // 16 % 4 + 1] AS image, CASE WHEN p_size % 2 = 0 THEN 'preserveSource' ELSE 'convertToSRGB' END AS policy FROM part))""")
def colour_interpretation(spark, sf_dir):
    key = F.col("p_partkey")

    def pick(items, step):
        return F.element_at(F.array(*(F.lit(x) for x in items)), (F.floor(key / step) % 4 + 1).cast("int"))

    def model(c):
        return F.when(c.isNotNull(), F.when(c.startswith("Generic"), F.lit("monochrome")).otherwise(F.lit("rgb")))

    rows = table(spark, sf_dir, "part").select("p_partkey", pick(("absent", "standardSRGB", "embeddedICC", "unknown"), 1).alias("profile"), pick(_COLOURS, 4).alias("inspected"), pick(_COLOURS, 16).alias("image"), F.when(F.col("p_size") % 2 == 0, F.lit("preserveSource")).otherwise(F.lit("convertToSRGB")).alias("policy"))
    rows = rows.withColumn("interpreted", prepared.interpreted_colour(F.col("profile"), F.col("inspected"), F.col("image")))
    step = prepared.colour_step(F.col("interpreted"), model(F.col("interpreted")), F.col("image"), model(F.col("image")), F.col("policy"))
    return rows.select("p_partkey", "profile", "interpreted", step.alias("step"))


@query(f"""SELECT k, CASE WHEN size > 2400 THEN 'encodedBytesExceeded' WHEN kind = 7 THEN 'unsupportedFormat' WHEN kind IN (1, 2, 3) AND n + CASE kind WHEN 1 THEN 26 WHEN 3 THEN 32 ELSE 0 END > 1500 THEN 'metadataLimitExceeded' WHEN kind IN (2, 6) OR kind = 4 AND (gap OR grey) THEN 'unsupportedOrCorruptImage'
  WHEN greatest(w, h) > 3000 THEN 'dimensionLimitExceeded' WHEN w * h > 6000000 THEN 'pixelLimitExceeded' WHEN kind = 5 AND f > 1 THEN 'frameLimitExceeded' WHEN k % 3 = 0 THEN 'probeMismatch' END AS failure FROM {_IMAGES}""")
def probe_agreement(spark, sf_dir):
    """Decoding with a given probe: the source is probed again, and every third caller's width is off by one."""
    fresh = probe(_images(spark, sf_dir), limits=LIMITS).repartition("k")  # probed once for both sides
    off = F.when(F.col("k") % 3 == 0, F.lit(1)).otherwise(F.lit(0))
    fields = [(F.col(f) + off).alias(f) if f == "width" else F.col(f) for f in prepared.PROBE_FIELDS]
    return prepared.matched(fresh.select("k", F.struct(*fields).alias("given")), fresh, "k").select("k", "failure")


_STORE = "(SELECT 's' || user_id % 7 AS store, event_id AS seq, CASE event_type WHEN 'view' THEN 'insert' WHEN 'click' THEN 'take' ELSE CASE WHEN event_id % 2 = 0 THEN 'insert' ELSE 'remove' END END AS kind, 't' || user_id % 50 AS token FROM events)"


@query(f"""SELECT store, seq, kind, token, (kind = 'insert') <> coalesce(lag(kind = 'insert') OVER (PARTITION BY store, token ORDER BY seq), false) AS accepted FROM {_STORE}""")
def preparation_store(spark, sf_dir):
    """One-time tokens of sources: inserted once while held, taken once."""
    return prepared.store(_store_events(spark, sf_dir))


@query(f"""SELECT store, seq, kind, token, (kind = 'insert') <> coalesce(lag(kind = 'insert') OVER (PARTITION BY store, token ORDER BY seq), false) AS accepted FROM {_STORE}""")
def preparation_takes(spark, sf_dir):
    """The same of a store without a bound, as a window over each token's own events."""
    return prepared.takes(_store_events(spark, sf_dir), ["store"], "token", ["seq"], "kind")


def _store_events(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "insert").when(F.col("event_type") == "click", "take").otherwise(F.when(F.col("event_id") % 2 == 0, "insert").otherwise("remove"))
    return table(spark, sf_dir, "events").select(F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string")).alias("store"), F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("t"), (F.col("user_id") % 50).cast("string")).alias("token"))
