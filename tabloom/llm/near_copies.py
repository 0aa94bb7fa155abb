"""Near copies by shingle sets: one document of each group stays.

Texts are near if their sets of 5-word shingles have a Jaccard similarity of 0.8 or more.
First the 64-bit SimHash fingerprints of the sets are linked at FINGERPRINT_BITS or fewer differing bits (the operator
of :mod:`.simhash`), and each text is verified on whole sets against one text of its fingerprint's component.
Texts at the limit differ in more bits than such keys can find, so what is still apart goes on: each text is filed under BANDS keys, a key being the least hashes of its set under BAND_ROWS
orders; near texts share a key but for odds of 7 in 100,000 at the limit. In each bucket all texts
are compared with one of them first, the one that shares keys with most texts, and what is still
apart with another. Then the texts of different components are: how many shingles of a text
are found in other components bounds for certain what it can share with any of their texts, wide SimHash
fingerprints of the sets discard pairs that are too far apart, and what is left is verified on
whole sets, once for each pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import remove_path
from .common import c, map_batches, stored
from .components import connected_components
from .simhash import bit_counts, fingerprint_components, shingle_hashes

BANDS, BAND_ROWS = 24, 5
FINGERPRINT_BITS = 3  # that fingerprints of close copies differ in at most
WORDS = 16  # of 64 bits in a wide fingerprint
HUBS = 2  # texts of a bucket that all others are compared with first
DEVIATIONS = 3.5  # how far above the mean of pairs at the limit a distance may lie


def word_key(text: Column) -> Column:
    """64-bit hash of the words of a text, A-Z in lower case; texts that differ in spacing or case share it."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.xxhash64(F.trim(F.regexp_replace(lower, r"[\x20\x09-\x0D]+", " ")))


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the shingles."""
    return np.unique((shingle_hashes(text, words) >> np.uint64(32)).astype(np.uint32))


def _odd_numbers(name: str, count: int) -> np.ndarray:
    """Fixed pseudo-random odd multipliers."""
    return np.random.default_rng(list(name.encode())).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values spread over all bits."""
    for shift in (33, 29):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def band_keys(s: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """One key per band: the least hashes of the set under the orders of the band."""
    orders = _odd_numbers("orders", bands * rows)
    spread = _mixed(s.astype(np.uint64) + np.uint64(1))
    least = np.full(bands * rows, np.iinfo(np.uint64).max)
    for at in range(0, len(s), 1 << 12):  # bounded memory for very long texts
        least = np.minimum(least, _mixed(spread[at:at + (1 << 12), None] * orders[None, :]).min(0))
    weights = _odd_numbers("weights", rows)
    numbers = np.arange(bands, dtype=np.uint64)
    return _mixed((least.reshape(bands, rows) * weights[None, :]).sum(1, dtype=np.uint64) + numbers).view(np.int64)


def fingerprint(s: np.ndarray, words: int = WORDS) -> np.ndarray:
    """A SimHash of 64 bits per word over the distinct shingles."""
    spread = _mixed(s.astype(np.uint64) + np.uint64(1))
    bits = [bit_counts(_mixed(spread * m)) * 2 > len(s) for m in _odd_numbers("words", words)]
    return np.packbits(np.concatenate(bits), bitorder="little").view("<i8")


def distance_limit(similarity: float, words: int = WORDS) -> int:
    """Differing bits that pairs at the limit hardly ever exceed.

    At a Jaccard similarity of J the cosine of two sets is 2 J / (1 + J) at least, and a bit differs with the
    angle's share of a half turn.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * words
    return math.ceil(bits * share + DEVIATIONS * math.sqrt(bits * share * (1 - share)))


def _filed(sets: DataFrame) -> DataFrame:
    """(t, n, size): each text under those of its keys that others have too."""
    def run(batch: pa.RecordBatch) -> dict:
        keys, sizes = [], []
        for s in batch.column(1).to_pylist():
            s = np.frombuffer(s, np.uint32)
            keys.append(band_keys(s))
            sizes.append(len(s))
        return {"t": np.concatenate(keys), "n": np.repeat(batch.column(0).to_numpy(), BANDS), "size": np.repeat(sizes, BANDS)}

    rows = map_batches(sets, run, "t bigint, n bigint, size int")
    # counted before anything meets, so a key that a third of the texts share is no hot spot
    buckets = rows.groupBy("t").agg(F.min("n").alias("low"), F.max("n").alias("high")).filter("low <> high")
    return rows.join(buckets.select("t"), "t", "left_semi")


def _lengths_fit(a: str, b: str, similarity: float) -> Column:
    """False where the sizes of two sets alone rule the similarity out."""
    return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - F.lit(1e-6)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar."""
    both = (
        pairs.join(sets.select(F.col("n").alias("a"), F.col("s").alias("x")), "a")
        .join(sets.select(F.col("n").alias("b"), F.col("s").alias("y")), "b").select("a", "b", "x", "y"))

    def verify(batch: pa.RecordBatch) -> dict:
        rows = []
        for a, b, x, y in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            common = len(np.intersect1d(x, y, assume_unique=True))
            if common and common >= similarity * (len(x) + len(y) - common):
                rows.append((a, b))
        return {"a": [r[0] for r in rows], "b": [r[1] for r in rows]}

    return map_batches(both, verify, "a bigint, b bigint", rows=1024)


def simhash_links(sets: DataFrame, similarity: float) -> DataFrame:
    """Verified links (a, b) of texts to one text of their SimHash component: the one with the smallest key."""
    def prints(batch: pa.RecordBatch) -> dict:
        found = [fingerprint(np.frombuffer(s, np.uint32), 1)[0] for s in batch.column(1).to_pylist()]
        return {"n": batch.column(0), "fp": pa.array(np.array(found, np.int64)), "size": [len(s) // 4 for s in batch.column(1).to_pylist()]}

    fps = stored(map_batches(sets, prints, "n bigint, fp bigint, size int"), "near-prints")
    members = fps.join(fingerprint_components(fps, FINGERPRINT_BITS), "fp")
    hubs = members.groupBy("root").agg(
        F.min(F.struct(F.col("n").alias("hub"), F.col("size").alias("hub_size"))).alias("h"),
        F.count(F.lit(1)).alias("members")).filter("members > 1").select("root", "h.*")
    pairs = members.join(hubs, "root").filter("n <> hub").filter(_lengths_fit("size", "hub_size", similarity))
    return _verified(pairs.select(F.col("n").alias("a"), F.col("hub").alias("b")), sets, similarity)


def _told_apart(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """(n, no_joined, no_single): how many shingles of a text no text of another root holds; no row if there are none.

    Texts of *mixed* (n, root, joined, more) are of two kinds: those joined with a text already, and the others.
    With one of another root and either kind, a text can have no more than its other shingles in common.
    """
    def run(batch: pa.RecordBatch) -> dict:
        found = [np.frombuffer(s, np.int32) for s in batch.column(3).to_pylist()]
        out = {name: np.repeat(batch.column(i).to_numpy(zero_copy_only=False), [len(s) for s in found])
               for i, name in enumerate(("n", "root", "joined"))}
        return out | {"shingle": np.concatenate(found)}

    texts = mixed.select("n", "root", "joined").distinct().join(sets, "n").select("n", "root", "joined", "s")
    rows = map_batches(texts, run, "n bigint, root bigint, joined boolean, shingle int", rows=32)
    by_kind = {"joined": F.when(F.col("joined"), F.col("root")), "single": F.when(~F.col("joined"), F.col("root"))}
    holders = rows.groupBy("shingle").agg(*[
        f(root).alias(f"{kind}_{end}") for kind, root in by_kind.items() for end, f in (("lo", F.min), ("hi", F.max))])
    # shingles that several roots of either kind hold are no text's own, so none that is common is joined below
    own = holders.filter(" or ".join(f"{k}_lo is null or {k}_lo = {k}_hi" for k in by_kind))

    def lacking(kind: str) -> Column:
        other = (F.col(f"{kind}_lo") != F.col("root")) | (F.col(f"{kind}_hi") != F.col("root"))
        return F.count(F.when(~F.coalesce(other, F.lit(False)), 1))

    return rows.join(own, "shingle").groupBy("n").agg(*[lacking(k).alias(f"no_{k}") for k in by_kind])


def _close_pairs(
    told: DataFrame, mixed: DataFrame, sets: DataFrame, similarity: float, kept: Callable[[DataFrame, str], DataFrame],
) -> DataFrame:
    """Pairs (a, b) of one bucket and different roots that may be similar, each of them once.

    Left out are pairs that the sizes of the sets or the shingles found in other texts rule out for certain,
    and those whose wide fingerprints are too far apart.
    """
    words_of = [f"f{i}" for i in range(WORDS)]

    def prints(batch: pa.RecordBatch) -> dict:
        found = [fingerprint(np.frombuffer(s, np.uint32)) for s in batch.column(1).to_pylist()]
        table = np.array(found, np.int64).reshape(-1, WORDS)
        return {"n": batch.column(0), **{name: table[:, i] for i, name in enumerate(words_of)}}

    able = kept(
        mixed.join(told, "n", "left")
        .withColumn("with_joined", F.col("size") - F.coalesce("no_joined", F.lit(0)))
        .withColumn("with_single", F.col("size") - F.coalesce("no_single", F.lit(0)))
        .filter(F.greatest("with_joined", "with_single") >= F.lit(similarity) * F.col("size") - F.lit(1e-6)), "near-able")
    texts = able.groupBy("n").agg(F.collect_list("t").alias("keys"))
    wide = map_batches(
        sets.join(texts.select("n"), "n", "left_semi"), prints,
        "n bigint, " + ", ".join(f"{name} bigint" for name in words_of))
    marked = kept(able.join(texts, "n").join(wide, "n"), "near-marked")

    def held(one: str, other: str) -> Column:
        return F.when(F.col(f"{other}.joined"), F.col(f"{one}.with_joined")).otherwise(F.col(f"{one}.with_single"))

    common = F.least(held("a", "b"), held("b", "a"))
    fit = common >= F.lit(similarity) * (F.col("a.size") + F.col("b.size") - common) - F.lit(1e-6)
    away = sum((F.bit_count(F.col(f"a.{f}").bitwiseXOR(F.col(f"b.{f}"))) for f in words_of[1:]),
               F.bit_count(F.col("a.f0").bitwiseXOR(F.col("b.f0"))))
    # a pair meets in every bucket that it shares; the first of them has it
    once = F.array_min(F.array_intersect("a.keys", "b.keys")) == F.col("a.t")
    return (
        marked.alias("a").join(
            marked.alias("b"),
            (F.col("a.t") == F.col("b.t")) & (F.col("a.root") < F.col("b.root"))
            & _lengths_fit("a.size", "b.size", similarity) & fit & (away <= distance_limit(similarity)) & once)
        .select(F.col("a.n").alias("a"), F.col("b.n").alias("b")))


def near_copy_groups(
    docs: DataFrame, *, text: str = "text", words: int = 5, similarity: float = 0.8,
) -> DataFrame:
    """(n, root) of every word key (see :func:`word_key`) that has a near copy; groups share a root.

    A link is a Jaccard similarity of *similarity* or more between the sets of shingles of
    *words* words (the whole sequence if shorter), verified on whole texts. A link at the limit is
    missed with odds of about 1 in 2,000 (the keys' and the fingerprints' together), one of 0.85 hardly ever.
    """
    keyed = docs.select(word_key(c(text)).alias("n"), c(text).alias("text"))

    def distinct(batch: pa.RecordBatch) -> dict:
        return {"n": batch.column(0), "s": [shingle_set(t, words).tobytes() for t in batch.column(1).to_pylist()]}

    spark, used = docs.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        out = stored(df, name)
        used.extend({f.rsplit("/", 1)[0] for f in out.inputFiles()})
        return out

    # texts with one key have the same words, so any of them will do
    sets = kept(map_batches(keyed, distinct, "n bigint, s binary").dropDuplicates(["n"]), "shingles")
    whole = sets.filter(F.length("s") > 0)
    links = kept(simhash_links(whole, similarity), "simhash-links")
    close = kept(connected_components(links), "near-close").withColumnRenamed("node", "n")
    filed = kept(_filed(whole), "filed")
    sizes = filed.select(F.col("n").alias("hub"), F.col("size").alias("hub_size")).distinct()
    # how many texts share a key with it: the texts in the middle of a group have most
    buckets = filed.groupBy("t").agg(F.count(F.lit(1)).alias("members"))
    shared = kept(filed.join(buckets, "t").groupBy("n").agg(F.sum("members").alias("shared")), "shared")
    mixed = filed.join(close, "n", "left").withColumn("root", F.coalesce("root", "n")).join(shared, "n")
    free = None
    for _ in range(HUBS):
        # one text of each bucket against all that are not joined with it yet; the second time one that the
        # first is not joined with, and only in buckets whose members do not all have one root
        chosen = kept((mixed if free is None else free).groupBy("t").agg(
            F.max_by(F.struct(F.col("n").alias("hub"), F.col("root").alias("hub_root")), F.struct("shared", "n")).alias("h")
        ).select("t", "h.*"), "hubs")
        to_hub = (
            mixed.join(chosen, "t").filter("root <> hub_root").select("n", "size", "hub").distinct()
            .join(sizes, "hub").filter(_lengths_fit("size", "hub_size", similarity))
            .select(F.col("n").alias("a"), F.col("hub").alias("b")))
        near = kept(_verified(to_hub, sets, similarity), "hub-links")
        links = links.unionAll(near)
        first = kept(connected_components(links), "near-first")
        rooted = (
            filed.select("t", "n", "size").join(first.withColumnRenamed("node", "n"), "n", "left")
            .withColumn("joined", F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "n")))
        mixed = kept(
            rooted.join(
                rooted.groupBy("t").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
                .filter("lo <> hi").select("t"), "t", "left_semi").join(shared, "n"), "near-mixed")
        taken = mixed.join(chosen.select("t", F.col("hub").alias("n")), ["t", "n"]).select("t", F.col("root").alias("taken"))
        free = mixed.join(taken, "t").filter("root <> taken")
    pairs = _close_pairs(kept(_told_apart(mixed, sets), "near-told"), mixed, sets, similarity, kept)
    # texts that fingerprints alone have linked are in no bucket
    roots = rooted.select("n", "root").unionAll(first.select(F.col("node").alias("n"), "root")).distinct()
    second = connected_components(
        kept(_verified(pairs, sets, similarity), "near-links")
        .join(roots.select(F.col("n").alias("a"), F.col("root").alias("p")), "a")
        .join(roots.select(F.col("n").alias("b"), F.col("root").alias("q")), "b")
        .select(F.col("p").alias("a"), F.col("q").alias("b")))
    second = second.select(F.col("node").alias("root"), F.col("root").alias("top"))
    groups = stored(
        roots.join(second, "root", "left").select("n", F.coalesce("top", "root").alias("root")), "near-groups")
    for path in used:  # nothing reads them any more
        remove_path(spark, path)
    return groups


def drop_near_copies(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8,
) -> DataFrame:
    """One row of each group of near copies, all columns as they are.

    The row with the smallest id stays (NULL ids last; then the smallest text). Texts that
    agree but for spacing and the case of A-Z are copies; NULL texts count as empty, and
    empty ones are copies of each other.
    """
    groups = near_copy_groups(docs, text=text, words=words, similarity=similarity)
    rows = docs.select(
        F.struct(*[c(n) for n in docs.columns]).alias("row"), word_key(c(text)).alias("n"),
        c(doc_id).isNull().alias("last"), c(doc_id).alias("id"))
    first = (
        rows.select("n", "last", "id").join(groups, "n", "left")
        .groupBy(F.coalesce("root", "n").alias("root"))
        .agg(F.min(F.struct("last", "id", "n")).alias("m"))
        .select(F.col("m.n").alias("n"), F.col("m.last").alias("last"), F.col("m.id").alias("id")))
    same = (F.col("r.n") == F.col("f.n")) & F.col("r.id").eqNullSafe(F.col("f.id"))
    kept = rows.alias("r").join(first.alias("f"), same, "left_semi")
    # rows that share id and words: the one with the smallest text
    return (
        kept.groupBy("n", "id").agg(F.min_by("row", F.coalesce(F.col("row").getField(text), F.lit(""))).alias("row"))
        .select("row.*"))
