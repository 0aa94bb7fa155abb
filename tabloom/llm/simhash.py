"""SimHash near-duplicates: pigeonhole keys propose, pivot distance tables discard, exact tests verify."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import c, map_batches, stored
from .components import member_roots

# Reference fingerprints of the distance table; 16 distances of 7 bits fit two longs.
PIVOTS = 16
PER_WORD = 8

def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of *words* words (the whole sequence if shorter), A-Z in lower case.

    ``bytes.lower`` changes A-Z only and ``bytes.split`` splits at exactly 09-0D and 20.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends.tolist()
    k = min(words, len(tokens))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1:])], np.uint64)

def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits set, lowest bit first."""
    total = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 14):  # bounded memory for very long texts
        block = hashes[part:part + (1 << 14)].astype("<u8")
        total += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total

def simhash(text: str | None, words: int = 3) -> int:
    hashes = shingle_hashes(text, words)
    if not len(hashes):
        return 0
    bits = bit_counts(hashes) * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])

def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint as a long; 0 for NULL texts and texts without words."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        values = [simhash(t, words) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "fp": pa.array(np.array(values, np.uint64).astype(np.int64))}

    return map_batches(docs.select(c(doc_id), c(text)), run, f"doc_id {kind}, fp bigint")

def _pivots() -> list[int]:
    """The reference fingerprints: fixed pseudo-random 64-bit words."""
    return [xxhash.xxh64_intdigest(f"pivot {i}".encode(), 42) for i in range(PIVOTS)]

def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value

def distance_table(fp: Column) -> list[Column]:
    """The fingerprint's Hamming distances to all pivots, 7 bits each, eight to a long."""
    out = []
    pivots = _pivots()
    for word in range(0, PIVOTS, PER_WORD):
        packed = F.lit(0).cast("bigint")
        for j, pivot in enumerate(pivots[word:word + PER_WORD]):
            away = F.bit_count(fp.bitwiseXOR(F.lit(_signed(pivot)))).cast("bigint")
            packed = packed.bitwiseOR(F.shiftleft(away, 7 * j))
        out.append(packed.alias(f"d{word // PER_WORD}"))
    return out

def may_be_near(left: str, right: str, limit: int) -> Column:
    """Largest difference of the pivot distances at most *limit* (true for all pairs within *limit*)."""
    keep = F.lit(True)
    for word in range(PIVOTS // PER_WORD):
        for j in range(PER_WORD):
            a, b = (F.shiftright(F.col(f"{side}.d{word}"), 7 * j).bitwiseAND(F.lit(127)) for side in (left, right))
            keep = keep & (F.abs(a - b) <= limit)
    return keep

def _keys(fp: Column, limit: int, spare: int) -> Column:
    """Pigeonhole keys: of ``limit + spare`` blocks of bits at least *spare* agree within *limit* bits.

    One key for each choice of *spare* blocks, so near fingerprints share a key for
    certain. More spare blocks mean longer keys and fewer chance meetings, but more keys.
    """
    blocks = limit + spare
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), spare)):
        mask = 0
        for i in chosen:
            mask |= ((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1)
        keys.append(F.struct(F.lit(number).cast("tinyint").alias("t"), fp.bitwiseAND(F.lit(_signed(mask))).alias("v")))
    return F.array(*keys)

def _spare_blocks(n: int) -> int:
    """Spare blocks so that chance meetings stay below the number of keys; any value gives the same links."""
    return 2 if n < 1 << 25 else 3 if n < 1 << 32 else 4

def fingerprint_components(fps: DataFrame, limit: int = 3, spare: int | None = None) -> DataFrame:
    """(fp, root) of every distinct fingerprint; links are pairs with at most *limit* differing bits.

    First every fingerprint is linked to the next one and to the first one in each of its buckets if near:
    dense groups of copies collapse into few components that way, in linear work, and the first ones
    keep the paths short that the rounds of the components follow.
    Then only pairs of different components in a bucket are looked at: those the pivot
    table can't discard are verified by counting bits. No link that joins two
    components is lost, and none within a component is listed.
    """
    nodes = fps.select("fp").distinct()
    spare = spare or _spare_blocks(fps.agg(F.approx_count_distinct("fp")).first()[0])
    keyed = stored(
        nodes.select("fp", *distance_table(F.col("fp")), F.explode(_keys(F.col("fp"), limit, spare)).alias("k"))
        .select("k.t", "k.v", "fp", "d0", "d1"), "simhash-keys")
    bucket = Window.partitionBy("t", "v").orderBy("fp")
    chain = (
        keyed.select("fp", F.array(F.lead("fp").over(bucket), F.first("fp").over(bucket)).alias("others"))
        .select(F.col("fp").alias("a"), F.explode("others").alias("b"))
        .filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= limit))
    )
    first = member_roots(chain)  # the roots are in no row: they are their own
    labelled = (
        keyed.join(first.withColumnRenamed("node", "fp"), "fp", "left")
        .withColumn("root", F.coalesce("root", "fp"))
    )
    # buckets whose members all have one root have nothing more to say
    mixed = stored(
        labelled.join(
            labelled.groupBy("t", "v").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
            .filter("lo <> hi").select("t", "v"), ["t", "v"], "left_semi"), "simhash-mixed")
    pairs = (
        mixed.alias("a").join(
            mixed.alias("b"),
            (F.col("a.t") == F.col("b.t")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.root") < F.col("b.root"))
            & may_be_near("a", "b", limit)
            & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= limit))
        .select(F.col("a.root").alias("a"), F.col("b.root").alias("b"))
    )
    second = member_roots(pairs).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return (
        nodes.join(first.withColumnRenamed("node", "fp"), "fp", "left")
        .withColumn("root", F.coalesce("root", "fp"))
        .join(second, "root", "left")
        .select("fp", F.coalesce("top", "root").alias("root"))
    )

def simhash_components(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 3, limit: int = 3,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of *docs*.

    component_id is the smallest id reachable over links of at most *limit* bits, itself
    included; rows with a NULL id take part and have the component of their fingerprint
    (NULL if nobody in it has an id). NULL and wordless texts have fingerprint zero and
    are linked like any other. Repeated rows come back as often as they came.
    """
    fps = stored(fingerprints(docs, doc_id=doc_id, text=text, words=words), "simhash")
    lowest = fps.groupBy("fp").agg(F.min("doc_id").alias("lowest"))
    roots = stored(
        fingerprint_components(fps, limit).join(lowest, "fp"), "simhash-roots")
    named = roots.groupBy("root").agg(F.min("lowest").alias("component_id"))
    return (
        fps.join(roots.select("fp", "root").join(named, "root").select("fp", "component_id"), "fp")
        .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    )

def simhash_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return simhash_components(docs.select("doc_id", "text"))
