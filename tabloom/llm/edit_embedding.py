"""Document fingerprints by a randomised edit embedding, with bit-sampled banding and verification.

A pointer walks over the characters of a text. At step j it shows the character under it
and moves on if a coin shared by all texts, drawn for (j, character), says so. Texts at a
small edit distance fall back into step after each edit, so the shown characters differ
in few steps: edit distance becomes Hamming distance. The fingerprint samples bits of the
shown sequence, as many in each octave of steps (64-128, 128-256, ...), so short and long
texts are sampled alike and any two can be compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import _importable, c, map_batches, stored

CLASSES, PERIOD = 256, 4096  # characters share coins by a hash of the code point; coins repeat after PERIOD steps
SAMPLES = 128  # bits per octave
AGREE, RECALL = 0.85, 0.98  # share of bits that near texts agree on, and how many of them are to meet
FIRST_OCTAVE, OCTAVES = 6, 40  # octave 0 covers the first 64 steps


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit integer hash, elementwise."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _class(points: np.ndarray) -> np.ndarray:
    return (_mixed(points) >> np.uint64(56)).astype(np.int64)


class Walks:
    """The shared coins, as tables: how many steps the pointer stays, and the bit shown at each sampled step."""

    def __init__(self):
        coins = (_mixed(np.arange(CLASSES * PERIOD)) >> np.uint64(63)).reshape(CLASSES, PERIOD).astype(bool)
        self.stay = []
        for row in coins:
            go = np.flatnonzero(row)
            after = np.append(go, go[0] + PERIOD)
            at = np.arange(PERIOD)
            self.stay.append((after[np.searchsorted(after, at)] - at + 1).tolist())
        starts = [0] + [1 << k for k in range(FIRST_OCTAVE, FIRST_OCTAVE + OCTAVES - 1)]
        widths = [1 << FIRST_OCTAVE] + starts[1:]
        draw = (_mixed(np.arange(OCTAVES * SAMPLES) + (1 << 40)) >> np.uint64(11)) / 2.0**53
        self.steps = np.concatenate([
            a + np.floor(draw[k * SAMPLES:(k + 1) * SAMPLES] * w).astype(np.int64)
            for k, (a, w) in enumerate(zip(starts, widths))])
        self.starts = starts
        grid = np.arange(OCTAVES * SAMPLES)[None, :] * (CLASSES + 1) + np.arange(CLASSES + 1)[:, None] + (1 << 50)
        self.bit = (_mixed(grid) >> np.uint64(63)).astype(np.uint8)
        self.rows: dict[str, list[int]] = {}

    def walk(self, text: str, start: int = 0) -> list[int]:
        """For each character, the step at which the pointer leaves it."""
        rows, stay, mask = self.rows, self.stay, PERIOD - 1
        new = set(text) - rows.keys()
        if new:
            for ch, k in zip(new, _class(np.array([ord(ch) for ch in new]))):
                rows[ch] = stay[k]
        leave, j = [], start
        add = leave.append
        for ch in text:
            j += rows[ch][j & mask]
            add(j)
        return leave

    def fingerprint(self, text: str, leave: list[int]) -> str:
        """Hex: 8 digits of the number of steps, a colon, then SAMPLES bits for each octave reached."""
        total = leave[-1] if leave else 0
        n = SAMPLES * self.octaves(total)
        steps = self.steps[:n]
        shown = np.searchsorted(np.array(leave, np.int64), steps, side="right")
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = np.append(_class(points), CLASSES)[shown]
        return f"{total:08x}:" + np.packbits(self.bit[kinds, np.arange(n)]).tobytes().hex()

    def octaves(self, total: int) -> int:
        """Octaves that hold a step below *total*."""
        return 0 if not total else max(1, (total - 1).bit_length() - FIRST_OCTAVE + 1)

    def likeness(self, left: str, right: str) -> float:
        """Estimated share of steps at which both show the same character; equal fingerprints give 1."""
        if left == right:
            return 1.0
        (a, x), (b, y) = self.parse(left), self.parse(right)
        total = max(a, b)
        if not min(a, b):
            return 0.0
        same = total_weight = 0.0
        for k in range(self.octaves(total)):
            begin = self.starts[k]
            width = min(total, self.starts[k + 1]) - begin
            total_weight += width
            part = slice(k * SAMPLES, (k + 1) * SAMPLES)
            use = self.steps[part] < total
            if len(x) > part.start and len(y) > part.start and use.any():
                # unlike characters show the same bit half of the time
                same += width * (2 * (x[part][use] == y[part][use]).mean() - 1)
        return float(min(1.0, max(0.0, same / total_weight)))

    @staticmethod
    def parse(fingerprint: str) -> tuple[int, np.ndarray]:
        total, _, digits = fingerprint.partition(":")
        return int(total, 16), np.unpackbits(np.frombuffer(bytes.fromhex(digits), np.uint8))


_WALKS: list[Walks] = []


def walks() -> Walks:
    """One set of tables per Python process."""
    if not _WALKS:
        _WALKS.append(Walks())
    return _WALKS[0]


def fingerprint_texts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row; NULL texts count as empty, equal texts have equal fingerprints."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        w = walks()
        texts = [t or "" for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "fingerprint": [w.fingerprint(t, w.walk(t)) for t in texts]}

    return map_batches(docs.select(c(doc_id), c(text)), run, f"doc_id {kind}, fingerprint string")


def edit_distance_within(a: str, b: str, limit: int) -> int | None:
    """Edit distance of *a* and *b* if at most *limit*: furthest-reaching diagonals, O(limit * length)."""
    if abs(len(a) - len(b)) > limit:
        return None

    def slide(i: int, j: int) -> int:
        step = 64
        while i < len(a) and j < len(b):
            if a[i:i + step] == b[j:j + step]:
                i, j = min(i + step, len(a)), j + step
            elif step > 1:
                step = max(1, step // 8)
                continue
            else:
                break
            if i >= len(a) or j >= len(b):
                break
        return min(i, len(a))

    goal = len(b) - len(a)
    far = {0: slide(0, 0)}
    for edits in range(limit + 1):
        if far.get(goal, -1) >= len(a):
            return edits
        grown = {}
        for d in range(-edits - 1, edits + 2):
            i = max(far.get(d - 1, -2), far.get(d, -2) + 1, far.get(d + 1, -2) + 1)
            if i < 0 or i > len(a) or i + d < 0 or i + d > len(b):
                continue
            grown[d] = slide(i, i + d)
        far = grown
    return None


def _bands(texts: int, least: int) -> np.ndarray:
    """The sampled bits of each band of an octave."""
    bits = min(SAMPLES, max(least, math.ceil(math.log2(max(2, texts))) + 2))
    bands = math.ceil(math.log(1 - RECALL) / math.log(1 - AGREE**bits) / 2)  # two octaves
    return np.array([
        np.random.default_rng([42, n]).choice(SAMPLES, bits, replace=False)
        for n in range(max(bands, SAMPLES // least))])


def near_edit_pairs(
    docs: DataFrame, max_edits: int, *, doc_id: str = "doc_id", text: str = "text", band_bits: int = 16,
) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, edits) of distinct texts at most *max_edits* apart, and membership (doc_id, representative).

    Copies are collapsed to the smallest id first, so a large group of copies is one text.
    Bands sample bits of the last full octave and of the one before; all texts that share a
    band and whose lengths allow it are candidates, and each is verified on whole texts.
    Bands have *band_bits* bits or more: they lengthen with the logarithm of the number of texts, so
    unrelated texts seldom meet, and grow in number, so near texts meet as surely as ever.
    Rows with a NULL id take no part. The search is approximate (bands can all differ): texts that agree on
    AGREE of the bits share a band in RECALL of the cases.
    """
    used = docs.filter(c(doc_id).isNotNull()).select(
        c(doc_id).alias("doc_id"), F.coalesce(c(text), F.lit("")).alias("text"))
    members = stored(
        used.withColumn("h", F.sha2("text", 256))
        .select("doc_id", F.min("doc_id").over(Window.partitionBy("h")).alias("representative")), "edit-members")
    texts = used.join(members.filter("doc_id = representative").select("doc_id").distinct(), "doc_id") \
        .dropDuplicates(["doc_id"])

    texts = stored(texts, "edit-texts")
    chosen = _bands(texts.count(), band_bits)

    def bands(batch: pa.RecordBatch) -> dict:
        w, rows = walks(), []
        for i, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total, bits = w.parse(fp)
            last = max(0, w.octaves(total) - 2)
            for octave in {last, max(0, last - 1)}:
                part = bits[octave * SAMPLES:(octave + 1) * SAMPLES]
                if len(part):
                    rows += [
                        (i, f"{octave}.{n}." + np.packbits(band).tobytes().hex()) for n, band in enumerate(part[chosen])]
            if not len(bits):
                rows.append((i, "empty"))
        return {"doc_id": [r[0] for r in rows], "key": [r[1] for r in rows]}

    kind = docs.schema[doc_id].dataType.simpleString()
    keys = map_batches(fingerprint_texts(texts), bands, f"doc_id {kind}, key string")
    keys = stored(
        keys.join(texts.select("doc_id", F.length("text").alias("length")), "doc_id"), "edit-bands")
    candidates = (
        keys.alias("p").join(
            keys.alias("q"),
            (F.col("p.key") == F.col("q.key")) & (F.col("p.doc_id") < F.col("q.doc_id"))
            & (F.abs(F.col("p.length") - F.col("q.length")) <= max_edits))
        .select(F.col("p.doc_id").alias("a"), F.col("q.doc_id").alias("b")).distinct()
    )
    joined = (
        candidates.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a")
        .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y"))

    def verify(batch: pa.RecordBatch) -> dict:
        rows = [
            (a, b, d) for a, b, x, y in zip(*[batch.column(i).to_pylist() for i in range(4)])
            if (d := edit_distance_within(x, y, max_edits)) is not None]
        return {"a": [r[0] for r in rows], "b": [r[1] for r in rows], "edits": [r[2] for r in rows]}

    return map_batches(joined, verify, f"a {kind}, b {kind}, edits int"), members


def _with_next(docs: DataFrame, pieces: int) -> DataFrame:
    """Rows (part, term, doc_id, text): within a part in descending order of the id, NULL ids last.

    Parts are ranges of ids. The first rows of a part come a second time, with term = 1,
    as the last rows of the part before (those of the first part: of the last one), so
    every row meets its successor in its own part. Texts are shuffled once.
    """
    spark: SparkSession = docs.sparkSession
    ids = docs.withColumn("_id", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("bigint")))
    cuts = ids.agg(F.percentile_approx("_id", [i / pieces for i in range(1, pieces)], 10_000)).first()[0] or []
    edges = [-float("inf"), *sorted({float(x) for x in cuts} or {0.0}), float("inf")]
    cut = Bucketizer(splits=edges, inputCol="_x", outputCol="_bucket")
    placed = cut.transform(ids.withColumn("_x", F.col("_id").cast("double"))).withColumn(
        "part", F.lit(len(edges)) - F.col("_bucket").cast("int"))
    # one row per part
    heads = sorted(placed.groupBy("part").agg(F.max("_id").alias("id")).collect())
    before = {head.part: heads[i - 1].part for i, head in enumerate(heads)}
    moved = spark.createDataFrame(
        pa.table({"_id": pa.array([h.id for h in heads], pa.int64()),
                  "_to": pa.array([before[h.part] for h in heads], pa.int32())}))
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("term"))
    copy = F.struct(F.col("_to").alias("part"), F.lit(1).alias("term"))
    return (
        placed.join(F.broadcast(moved), "_id", "left")
        .select("doc_id", "text", "_id", F.explode(
            F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("p"))
        .select("p.part", "p.term", "_id", "doc_id", "text")
        .repartition("part")
        .sortWithinPartitions("part", "term", F.desc("_id"), F.col("text").asc_nulls_first())
        .select("part", "term", "doc_id", "text")
    )


RESULT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double")


def edited_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness.

    The edited text has its last floor(n / 3) code points replaced by the first as many
    of the next document (descending doc_id, NULL ids last, equal ids by text; after the
    last comes the first). The walk over the edited text goes on where the common part ends.
    """
    spark = docs.sparkSession
    pieces = max(8, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = _with_next(docs.select(F.col("doc_id").cast("bigint"), "text"), pieces)
    kind = to_arrow_schema(T.StructType.fromDDL(RESULT))
    _importable(spark)

    def result(w: Walks, current: tuple, following: tuple) -> tuple:
        _, doc_id, text, leave, fp = current
        keep = len(text) - len(text) // 3
        tail = following[2][:len(text) // 3]
        edited = text[:keep] + tail
        edited_fp = fp if edited == text else w.fingerprint(
            edited, leave[:keep] + w.walk(tail, leave[keep - 1] if keep else 0))
        return (
            doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fp, edited_fp,
            w.likeness(fp, edited_fp), w.likeness(fp, following[4]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, held, out = walks(), None, []
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                piece = batch.slice(i, 64)
                for part, term, doc_id, text in zip(*[col.to_pylist() for col in piece.columns]):
                    text = text or ""
                    if held is not None and held[0] != part:
                        held = None
                    if term and held is None:
                        continue  # copies after the first one have nothing before them
                    leave = w.walk(text)
                    current = (part, doc_id, text, leave, w.fingerprint(text, leave))
                    if held is not None:
                        out.append(result(w, held, current))
                    held = None if term else current
                if len(out) >= 512:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, f.type) for v, f in zip(zip(*out), kind)], names=kind.names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), kind)], names=kind.names)

    return rows.mapInArrow(run, RESULT)
