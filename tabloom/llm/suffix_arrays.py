"""Remove repeated byte strings: suffix arrays of shards, Kasai common prefixes, merging across shards.

Only places that can repeat reach a suffix array. From every run of ``size`` bytes one
short gram is chosen by its hash alone (the smallest; the first of equals), so both
copies of a repeated string choose the same gram at the same place. Grams that occur at
one place only rule their strings out. The surroundings of the others are dealt to shards
by the gram, so the copies of a string meet in one shard. Equal surroundings are
represented by two of them. A gram with very many different surroundings is spread over
several shards, whose sorted strings are merged by binary search afterwards.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored

GRAM = 64
SIZE = 200
SHARD_BYTES = 1 << 19
# Different surroundings of one gram beyond which they are spread over several shards.
SPREAD = 3_000
LANE = 48
BASE, BASE2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
POSITION = np.uint64((1 << 28) - 1)  # bits of a key that hold the place in a text (texts up to 256 MB)


def _power(base: int, n: int) -> np.uint64:
    return np.uint64(pow(base, n, 1 << 64))


def _spread_bytes(data: np.ndarray) -> np.ndarray:
    x = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling_hash(data: np.ndarray, length: int, base: int = BASE) -> np.ndarray:
    """Polynomial hash of every run of *length* bytes, by doubling."""
    levels, width = {1: _spread_bytes(data)}, 1
    while width * 2 <= length:
        h = levels[width]
        levels[width * 2] = h[:-width] * _power(base, width) + h[width:]
        width *= 2
    total, out = 0, None
    for width in sorted(levels, reverse=True):
        if length - total >= width:
            part = levels[width][total:]
            out = part if out is None else out[:len(part)] * _power(base, width) + part[:len(out)]
            total += width
    out = out[:len(data) - length + 1]
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def anchors(data: np.ndarray, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the chosen grams, and the first and last run of *size* bytes that chose each."""
    if len(data) < size:
        return tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
    h = rolling_hash(data, gram)
    h ^= h >> np.uint64(32)
    low = (h & ~POSITION) | np.arange(len(h), dtype=np.uint64)
    span, width = size - gram + 1, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[:len(low) - (span - width)], low[span - width:])
    place = (low & POSITION).astype(np.int64)  # never goes back from one run to the next
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    place = place[first]
    return place, h[place], first, np.append(first[1:], len(low)) - 1


def laid_out(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Segments end to end, a slot for a mark after each, and for every byte the place of its segment's mark."""
    sizes = np.array([len(x) + 1 for x in parts], np.int32)
    return np.frombuffer(b"\0".join([*parts, b""]), np.uint8), np.repeat(np.cumsum(sizes, dtype=np.int32) - 1, sizes)


def _order(key: np.ndarray, bits: int) -> np.ndarray:
    """The order of unsigned keys of so many bits (any order of equal ones)."""
    room = len(key).bit_length()
    if bits + room > 64:
        return np.argsort(key)
    # place and key in one word: sorting words is several times faster than sorting places
    packed = np.sort((key << np.uint64(room)) | np.arange(len(key), dtype=np.uint64))
    return (packed & np.uint64((1 << room) - 1)).astype(np.int64)


def suffix_array(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of segments laid out with their marks (Larsson-Sadakane refinement).

    A mark is less than any byte, and earlier marks less than later ones. Suffixes are
    sorted by their first 5 bytes; then groups still equal are sorted by the rank of what
    follows, twice as far in each round. Suffixes alone in their group are left alone.
    """
    n = len(data)
    rest = ends - np.arange(n, dtype=np.int32)
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(5):
        key = (key << np.uint64(8)) | np.where(rest > k, padded[k:k + n], np.uint64(0))
    key = (key << np.uint64(3)) | np.minimum(rest, 5).astype(np.uint64)
    sa = _order(key, 43).astype(np.int32)
    ordered = key[sa]
    heads = np.append(True, ordered[1:] != ordered[:-1])
    marks = np.flatnonzero(rest == 0).astype(np.int32)
    sa[:len(marks)], heads[:len(marks)] = marks, True
    heads[len(marks):len(marks) + 1] = True
    group = np.maximum.accumulate(np.where(heads, np.arange(n, dtype=np.int32), 0))
    rank = np.empty(n, np.int32)
    rank[sa] = group
    active = np.flatnonzero(~(heads & np.append(heads[1:], True)))
    group, step = group[active], 5
    while len(active):
        at = sa[active]
        # members of a group share step bytes, or all bytes up to their marks, which tell them apart
        nxt = rank[at + np.minimum(rest[at], step)]
        first = np.append(True, group[1:] != group[:-1])
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, len(at)))
        # pairs are put in order by one comparison, larger groups are sorted
        two = begin[size == 2]
        swap = two[nxt[two] > nxt[two + 1]]
        for x in (at, nxt):
            x[swap], x[swap + 1] = x[swap + 1], x[swap]
        many = np.flatnonzero(np.repeat(size > 2, size))
        order = many[_order(group[many].astype(np.uint64) * np.uint64(n) + nxt[many].astype(np.uint64), (n * n).bit_length())]
        at[many], nxt[many] = at[order], nxt[order]
        sa[active] = at
        first[1:] |= nxt[1:] != nxt[:-1]
        group = np.maximum.accumulate(np.where(first, active, 0)).astype(np.int32)
        rank[at] = group
        shared = ~(first & np.append(first[1:], True))
        active, group = active[shared], group[shared]
        step *= 2
    return sa, rank


def common_prefixes(
    data: np.ndarray, ends: np.ndarray, sa: np.ndarray, rank: np.ndarray, most: int, wanted: np.ndarray | None = None,
) -> np.ndarray:
    """For every place, the common prefix (at most *most*) with the suffix before it in the array (Kasai).

    A place's prefix is at least that of the place before it less one. Many stretches of
    at most LANE places advance side by side, eight bytes at a time. Only *wanted* places
    (a mask; all if None) are looked at, others get 0.
    """
    n = len(data)
    out = np.zeros(n, np.int32)
    places = np.arange(n) if wanted is None else np.flatnonzero(wanted)
    if not len(places):
        return out
    # stretches of neighbouring places, cut to LANE
    first = np.append(True, np.diff(places) != 1)
    since = np.arange(len(places)) - np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))
    at = np.flatnonzero(since % LANE == 0)
    sizes = np.diff(np.append(at, len(places)))
    lanes = places[at]
    order = np.argsort(-sizes)
    lanes, sizes = lanes[order], sizes[order]
    before = np.where(rank > 0, sa[np.maximum(rank - 1, 0)], -1)
    rest = ends - np.arange(n, dtype=np.int32)
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    word = np.zeros(n + 1, np.uint64)
    for k in range(8):
        word[:n] |= padded[k:k + n] << np.uint64(8 * k)
    h = np.zeros(len(lanes), np.int32)
    for t in range(int(sizes[0])):
        alive = int(np.searchsorted(-sizes, -t, "left"))  # lanes longer than t
        i, h = lanes[:alive] + t, h[:alive]
        j = before[i]
        limit = np.where(j >= 0, np.minimum(np.minimum(rest[i], rest[j]), most), 0)
        h = np.minimum(np.maximum(h - 1, 0), limit)
        go = np.flatnonzero(h < limit)
        while len(go):
            hg = h[go]
            differ = word[i[go] + hg] ^ word[j[go] + hg]
            lowest = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, (np.frexp(lowest.astype(np.float64))[1] - 1) >> 3)
            hg = np.minimum(hg + same, limit[go])
            h[go] = hg
            go = go[(differ == 0) & (hg < limit[go])]
        out[i] = h
    return out


def repeated_starts(data: np.ndarray, ends: np.ndarray, size: int = SIZE) -> np.ndarray:
    """True at each place whose next *size* bytes (within the segment) also start at another place."""
    found = np.zeros(len(data), bool)
    if len(data):
        sa, rank = suffix_array(data, ends)
        whole = ends - np.arange(len(data), dtype=np.int32) >= size
        deep = np.flatnonzero(common_prefixes(data, ends, sa, rank, size, whole) >= size)
        found[deep] = True
        found[sa[rank[deep] - 1]] = True
    return found


def _text_key(text: Column) -> list[Column]:
    """120 bits of the text's SHA-256 as two longs."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint").alias(name) for at, name in ((1, "h1"), (16, "h2"))]


def _data(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _sketch(docs: DataFrame, size: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("h1", "h2", "n_bytes", "sha256", "pos", "gram")}
        for text in batch.column(1).to_pylist():
            raw = _data(text)
            digest = hashlib.sha256(raw).hexdigest()
            place, h, _, _ = anchors(np.frombuffer(raw, np.uint8), size, min(GRAM, size))
            for k, v in zip(out, (int(digest[:15], 16), int(digest[15:30], 16), len(raw), digest, place, h.view(np.int64))):
                out[k].append(v)
        return {"doc_id": batch.column(0), **out}

    return map_batches(
        docs.select("doc_id", "text"), run,
        "doc_id bigint, h1 bigint, h2 bigint, n_bytes bigint, sha256 string, pos array<int>, gram array<bigint>")


def _surroundings(texts: DataFrame, size: int) -> DataFrame:
    """(gram, around, h1, h2, pos, first, last): the runs that chose the gram, and a hash of the bytes they cover."""
    def run(batch: pa.RecordBatch) -> dict:
        rows = []
        for h1, h2, text, marks in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            raw, wanted = _data(text), {m["pos"] for m in marks}
            for pos, h, a, b in zip(*[x.tolist() for x in anchors(np.frombuffer(raw, np.uint8), size, min(GRAM, size))]):
                if pos in wanted:
                    digest = xxhash.xxh3_64_intdigest(raw[a:b + size], pos - a)
                    rows.append((h - (h >> 63 << 64), digest - (1 << 63), h1, h2, pos, a, b))
        return {k: [r[i] for r in rows] for i, k in enumerate(("gram", "around", "h1", "h2", "pos", "first", "last"))}

    return map_batches(
        texts, run, "gram bigint, around bigint, h1 bigint, h2 bigint, pos int, first int, last int", rows=256)


MARK = "struct<pos:int,first:int,last:int,gram:bigint,around:bigint>"
SEGMENTS = f"shard bigint, spread boolean, h1 bigint, h2 bigint, start int, bytes binary, marks array<{MARK}>"


def _segments(chosen: DataFrame, size: int) -> DataFrame:
    """The stretches of each text that its chosen surroundings cover, per shard."""
    names = ("pos", "first", "last", "gram", "around")

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("shard", "spread", "h1", "h2", "start", "bytes", "marks")}
        for h1, h2, text, marks in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            raw, by = _data(text), {}
            for m in sorted(marks, key=lambda m: m["first"]):
                by.setdefault((m["shard"], m["spread"]), []).append({k: m[k] for k in names})
            for (shard, spread), own in by.items():
                runs: list[list] = []
                for m in own:
                    if runs and m["first"] <= runs[-1][1]:
                        runs[-1][1] = max(m["last"] + size, runs[-1][1])
                        runs[-1][2].append(m)
                    else:
                        runs.append([m["first"], m["last"] + size, [m]])
                for a, b, held in runs:
                    for k, v in zip(out, (shard, spread, h1, h2, a, raw[a:b], held)):
                        out[k].append(v)
        return out

    return map_batches(chosen, run, SEGMENTS, rows=256)


FOUND = "gram bigint, around bigint, first int, last int, bucket bigint, one binary, two binary, owner binary"


def _search_shard(size: int, buckets: int):
    """Arrow function of one shard: runs of repeated starts per surrounding, relative to the gram.

    Shards of a spread gram also give, per bucket of hashes, the sorted hashes of their
    strings for the merge.
    """
    gram = min(GRAM, size)
    reach = size - gram

    def run(table: pa.Table) -> pa.Table:
        rows = table.drop_columns(["marks"]).to_pylist()
        parts = [r["bytes"] for r in rows]
        data, ends = laid_out(parts)
        found = repeated_starts(data, ends, size)
        begin = np.cumsum([0, *[len(x) + 1 for x in parts[:-1]]]) - np.array([r["start"] for r in rows])
        marks = table.column("marks").combine_chunks()
        owner = np.repeat(begin, pc.list_value_length(marks).to_numpy())
        pos, first, last, gram_, around = (marks.flatten().field(k).to_numpy() for k in ("pos", "first", "last", "gram", "around"))
        at, low, high = pos + owner, first + owner, last + owner
        grid = at[:, None] + np.arange(-reach, 1)[None, :]
        real = (grid >= low[:, None]) & (grid <= high[:, None])
        hit = real & found[np.clip(grid, 0, len(data) - 1)]
        edge = np.zeros((len(at), reach + 3), np.int8)
        edge[:, 1:-1] = hit
        change = np.diff(edge, axis=1)
        who, first = np.nonzero(change == 1)
        _, last = np.nonzero(change == -1)
        out = {
            "gram": pa.array(gram_[who]), "around": pa.array(around[who]),
            "first": pa.array((first - reach).astype(np.int32)), "last": pa.array((last - 1 - reach).astype(np.int32))}
        n = len(who)
        blank = {"bucket": pa.nulls(n, pa.int64()), **{k: pa.nulls(n, pa.binary()) for k in ("one", "two", "owner")}}
        result = pa.table({**out, **blank})
        if rows[0]["spread"] and len(data) >= size:
            who, rel = np.nonzero(real)
            place = grid[who, rel]
            # copies hold the gram at the same offset; a string seen from two grams is one string still
            seen_from = gram_[who].view(np.uint64) * np.uint64(BASE2) + rel.astype(np.uint64) * np.uint64(BASE)
            one, two = (rolling_hash(data, size, b)[place] + seen_from for b in (BASE, BASE2))
            one = (one ^ (one >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            order = np.argsort(one, kind="stable")
            one, two, who, rel = one[order], two[order], who[order], rel[order]
            bucket = (one >> np.uint64(32)).astype(np.int64) * buckets >> 32
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))  # sorted by hash, so buckets are stretches
            parts = []
            for b in np.unique(bucket):
                s = slice(cuts[b], cuts[b + 1])
                owner = np.stack([gram_[who[s]], around[who[s]], rel[s] - reach])
                parts.append((int(b), one[s].tobytes(), two[s].tobytes(), owner.astype(np.int64).tobytes()))
            m = len(parts)
            blank = {**{k: pa.nulls(m, pa.int64()) for k in ("gram", "around")},
                     **{k: pa.nulls(m, pa.int32()) for k in ("first", "last")}}
            result = pa.concat_tables([result, pa.table({
                **blank, "bucket": pa.array([p[0] for p in parts], pa.int64()),
                **{k: pa.array([p[i] for p in parts], pa.binary()) for i, k in ((1, "one"), (2, "two"), (3, "owner"))}})])
        return result

    return run


def merge_shards(one: list[np.ndarray], two: list[np.ndarray]) -> list[np.ndarray]:
    """For each shard's sorted hashes, which of them some other shard has too.

    Shards are merged pairwise, neighbours first, like runs of a merge sort; each is
    searched in the other by bisection. *two* holds second hashes of the same strings.
    """
    hit = [np.zeros(len(x), bool) for x in one]
    runs = [(x, y, np.full(len(x), k), np.arange(len(x))) for k, (x, y) in enumerate(zip(one, two))]
    while len(runs) > 1:
        merged = []
        for left, right in zip(runs[::2], runs[1::2]):
            for a, b in ((left, right), (right, left)):
                at = np.searchsorted(b[0], a[0])
                inside = np.minimum(at, max(0, len(b[0]) - 1))
                same = (b[0][inside] == a[0]) & (b[1][inside] == a[1]) if len(b[0]) else np.zeros(len(a[0]), bool)
                for k in np.unique(a[2][same]):
                    pick = same & (a[2] == k)
                    hit[k][a[3][pick]] = True
            both = [np.concatenate(x) for x in zip(left, right)]
            order = np.argsort(both[0], kind="stable")
            merged.append(tuple(x[order] for x in both))
        runs = merged + runs[len(runs) // 2 * 2:]
    return hit


def _merge_bucket(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    one, two = ([np.frombuffer(r[k], np.uint64) for r in rows] for k in ("one", "two"))
    hits = merge_shards(one, two)
    parts = [np.frombuffer(r["owner"], np.int64).reshape(3, -1)[:, hit] for r, hit in zip(rows, hits)]
    gram_, around, rel = np.concatenate(parts, axis=1) if parts else np.empty((3, 0), np.int64)
    return pa.table({
        "gram": pa.array(gram_), "around": pa.array(around), "first": pa.array(rel.astype(np.int32)),
        "last": pa.array(rel.astype(np.int32))})


def _kept(size: int):
    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_removed", "n_spans", "kept_sha256")}
        for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            raw = _data(text)
            cover = np.zeros(len(raw) + 1, np.int64)
            np.add.at(cover, [s["a"] for s in spans], 1)
            np.add.at(cover, [min(s["b"] + size, len(raw)) for s in spans], -1)
            gone = np.cumsum(cover)[:-1] > 0
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(int((np.diff(np.append(0, gone.astype(np.int8))) == 1).sum()))
            out["kept_sha256"].append(hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
        return {"h1": batch.column(0), "h2": batch.column(1), **out}

    return run


def remove_repeats(
    docs: DataFrame, *, size: int = SIZE, shard_bytes: int = SHARD_BYTES, spread: int = SPREAD,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of *docs* (doc_id, text).

    A byte goes if a string of *size* bytes that covers it also starts at any other place
    of the corpus. Rows are documents of their own, also those that share an id or have
    none; a NULL text is empty. A text that occurs twice and has *size* bytes goes whole;
    texts shorter than that never lose a byte.
    """
    docs = docs.select("doc_id", "text")
    sketch = stored(_sketch(docs, size), "repeat-sketch")
    marks = sketch.select("h1", "h2", F.explode(F.arrays_zip("pos", "gram")).alias("m")).select(
        "h1", "h2", "m.pos", "m.gram")
    place = F.xxhash64("h1", "h2", "pos")
    again = (
        marks.groupBy("gram").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).filter("lo <> hi").select("gram"))
    per_text = (
        marks.join(again, "gram", "left_semi")
        .groupBy("h1", "h2").agg(F.collect_set(F.struct("pos", "gram")).alias("marks")))
    texts = stored(
        docs.select(*_text_key(F.col("text")), "text").groupBy("h1", "h2").agg(F.first("text").alias("text"))
        .join(per_text, ["h1", "h2"]), "repeat-texts")
    around = stored(_surroundings(texts, size).withColumn("p", place), "repeat-around")
    two = around.groupBy("gram", "around").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    chosen = stored(
        around.join(two, ["gram", "around"]).filter("p = lo or p = hi").select(
            "gram", "around", "h1", "h2", "pos", "first", "last", "p"), "repeat-chosen")
    total = chosen.count()
    shards = max(1, -(-total * (2 * size - min(GRAM, size)) // shard_bytes))
    wide = (
        chosen.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > spread)
        .withColumn("salts", F.ceil(F.col("n") / spread)))
    dealt = chosen.join(wide, "gram", "left").select(
        "h1", "h2", "pos", "first", "last", "gram", "around", F.col("salts").isNotNull().alias("spread"),
        F.when(F.col("salts").isNull(), F.pmod(F.xxhash64("gram"), F.lit(shards))).otherwise(
            # a salt of its own number range for every spread gram
            F.xxhash64("gram", F.pmod("p", "salts")).bitwiseOR(F.lit(1 << 62))).alias("shard"))
    segments = _segments(
        texts.select("h1", "h2", "text").join(
            dealt.groupBy("h1", "h2").agg(
                F.collect_list(F.struct("pos", "first", "last", "gram", "around", "shard", "spread")).alias("own")), ["h1", "h2"])
        .select("h1", "h2", "text", "own"), size)
    # hashes of up to size - GRAM + 1 strings for each place in a spread shard, about a million to a bucket
    buckets = max(1, total * (size - min(GRAM, size) + 1) >> 20)
    searched = stored(segments.groupBy("shard").applyInArrow(_search_shard(size, buckets), FOUND), "repeat-found")
    merged = searched.filter("bucket is not null").groupBy("bucket").applyInArrow(
        _merge_bucket, "gram bigint, around bigint, first int, last int")
    runs = searched.filter("bucket is null").select("gram", "around", "first", "last").unionAll(merged)
    spans = (
        around.join(
            runs.groupBy("gram", "around").agg(F.collect_set(F.struct("first", "last")).alias("runs")),
            ["gram", "around"])
        .select("h1", "h2", "pos", F.explode("runs").alias("r"))
        .select("h1", "h2", F.struct(
            (F.col("pos") + F.col("r.first")).alias("a"), (F.col("pos") + F.col("r.last")).alias("b")).alias("s"))
        .groupBy("h1", "h2").agg(F.collect_set("s").alias("spans")))
    partial = map_batches(
        texts.select("h1", "h2", "text").join(spans, ["h1", "h2"]).select("h1", "h2", "text", "spans"), _kept(size),
        "h1 bigint, h2 bigint, n_removed bigint, n_spans bigint, kept_sha256 string", rows=256)
    unique = sketch.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies")).join(partial, ["h1", "h2"], "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= size)
    zero = F.lit(0).cast("bigint")
    return (
        sketch.select("doc_id", "h1", "h2", "n_bytes", "sha256").join(unique, ["h1", "h2"])
        .select(
            "doc_id", "n_bytes",
            F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
            F.when(whole, F.lit(1).cast("bigint")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
            F.when(whole, F.lit(hashlib.sha256(b"").hexdigest()))
            .otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256")))
