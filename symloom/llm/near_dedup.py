"""Near deduplication by b-bit MinHash: candidates from bands, estimates from packed low bits, links from full sets.

1. Each text becomes its set of word shingles (64-bit hashes), a digest of that set, the packed low bits of its minima
   and one key for each band of minima. Rows with the same set are one class; its smallest id stands for it.
2. Classes that share a band are candidates. In each band's bucket, members are first compared with one pivot - the
   member whose buckets are fullest, which in a family of copies is their origin - and linked on their full sets.
3. What a bucket still holds of different components is compared block by block: its members outside its largest
   component with each other and with that component's, never the largest with itself. A family of n copies with k
   strays in its buckets costs n * k packed comparisons at most, not n * n.
   Before any two full sets are compared, the collision-corrected similarity estimated from the packed bits must not be
   more than `SIGMAS` standard errors below the threshold. Members of such buckets alone get a second, wider sketch, whose
   standard error is less than half as large: most pairs of a family that are merely related end there.
4. Links make components. Sets travel once per class and block of up to `BLOCK` partners, never once per pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.components import components
from symloom.llm.storage import discard, settle
from symloom.llm.words import gram_hashes, mix, spans, word_hashes

BANDS, ROWS = 32, 6
MINIMA = BANDS * ROWS
BITS = 2
SIGMAS = 6.0
BLOCK = 512
_LONGS = MINIMA * BITS // 64
#: Minima of the wider sketch.
WIDE = 1024

_rng = np.random.Generator(np.random.PCG64(77))
_FACTORS = _rng.integers(1, 2**31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _rng.integers(0, 2**32, MINIMA, dtype=np.uint32)
_wide_rng = np.random.Generator(np.random.PCG64(78))
_WIDE_FACTORS = _wide_rng.integers(1, 2**31, WIDE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_WIDE_SHIFTS = _wide_rng.integers(0, 2**32, WIDE, dtype=np.uint32)
_SKETCH = "doc_id long, n_shingles long, digest binary, packed binary, bands array<long>"


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the shingles: runs of `width` words after A-Z are lower-cased; of fewer words, all."""
    data = (text or "").encode().lower()
    words = word_hashes(data, *spans(data))
    size = min(width, len(words))
    return np.unique(gram_hashes(words, size, seed=size)) if size else np.zeros(0, np.uint64)


def minima(shingles: np.ndarray, factors: np.ndarray = _FACTORS, shifts: np.ndarray = _SHIFTS) -> np.ndarray:
    """The minimum of each of the hash functions, MINIMA of them, over a non-empty set."""
    low = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        values = (low[at : at + 2048, None] * factors + shifts) ^ (high[at : at + 2048, None] * factors[::-1])
        values = (values ^ (values >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        np.minimum(best, values.min(axis=0), out=best)
    return best


def pack(best: np.ndarray) -> bytes:
    """The low BITS bits of each minimum."""
    mixed = mix(best.astype(np.uint64) + np.uint64(1)) & np.uint64(2**BITS - 1)
    lanes = mixed.reshape(-1, 64 // BITS) << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))
    return np.bitwise_or.reduce(lanes, axis=1).tobytes()


def band_keys(best: np.ndarray) -> list[int]:
    """One 64-bit key for each band of ROWS minima."""
    return gram_hashes_by_row(best.astype(np.uint64).reshape(BANDS, ROWS)).view(np.int64).tolist()


def gram_hashes_by_row(rows: np.ndarray) -> np.ndarray:
    out = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for k in range(rows.shape[1]):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + rows[:, k])
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of packed rows a with packed rows b: agreeing groups of bits, corrected for chance."""
    return estimate_each(a[:, None, :], b[None, :, :])


def estimate_each(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of each of a with the one of b at its place."""
    lanes = np.uint64(0x5555555555555555)
    apart = a ^ b
    apart = (apart | (apart >> np.uint64(1))) & lanes
    agree = 1.0 - np.bitwise_count(apart).sum(axis=-1) / (apart.shape[-1] * (64 // BITS))
    chance = 2.0**-BITS
    return (agree - chance) / (1 - chance)


def estimate_floor(percent: int, n: int = MINIMA) -> float:
    """The estimate from n minima below which a pair at the threshold lies with the odds of SIGMAS standard errors."""
    j, chance = percent / 100, 2.0**-BITS
    agree = j + (1 - j) * chance
    return j - SIGMAS * (agree * (1 - agree) / n) ** 0.5 / (1 - chance)


def _sketch(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, packs, bands = [], [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), width)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                best = minima(s) if len(s) else None
                packs.append(pack(best) if len(s) else None)
                bands.append(band_keys(best) if len(s) else None)
            arrays = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(packs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "n_shingles", "digest", "packed", "bands"])

    return run


def _sets(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("packed"), pa.array(sets, pa.binary())], ["doc", "packed", "shingles"])

    return run


def _wide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wide = [pack(minima(np.frombuffer(v.as_py(), np.uint64), _WIDE_FACTORS, _WIDE_SHIFTS)) for v in batch.column("shingles")]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(wide, pa.binary())], ["doc", "wide"])


def _groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from rows sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


_PAIRS = "p long, q long, i int, j int, a long, partners array<long>"
_KEY = ["p", "q", "i", "j"]


def _likely(percent: int):
    """From the members of bucket blocks, sorted by key: pairs of different components that may be alike.

    A pair is put out by its first common bucket alone, its partners gathered by family block: one row for each member
    and block; rows without partners name the documents that a block needs.
    """
    floor, wide_floor = estimate_floor(percent), estimate_floor(percent, MINIMA + WIDE)
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 6
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [*_KEY, "a", "partners"])

        for g in _groups(batches, ["key", "bi", "bj"]):
            docs, label, size, side, pivot, block = (g.column(c).to_numpy() for c in ("doc", "component", "n_shingles", "side", "pivot", "block"))
            packed = np.frombuffer(b"".join(g.column("packed").to_pylist()), np.uint64).reshape(-1, _LONGS)
            one_block = g.column("bi")[0].as_py() == g.column("bj")[0].as_py()
            x = np.flatnonzero(side == 0)
            y = x if one_block else np.flatnonzero(side == 1)
            if not len(x) or not len(y):
                continue
            small, large = np.minimum(size[x][:, None], size[y]), np.maximum(size[x][:, None], size[y])
            may = (label[x][:, None] != label[y]) & (small * 100 >= large * percent)
            if one_block:
                may &= docs[x][:, None] < docs[y]
            if not may.any():
                continue
            i, j = np.nonzero(may & (estimate(packed[x], packed[y]) >= floor))
            if not len(i):
                continue
            both = np.hstack([packed, np.frombuffer(b"".join(g.column("wide").to_pylist()), np.uint64).reshape(len(packed), -1)])
            steps = [slice(at, at + 50_000) for at in range(0, len(i), 50_000)]
            near = np.concatenate([estimate_each(both[x[i[s]]], both[y[j[s]]]) >= wide_floor for s in steps])
            i, j = i[near], j[near]
            if not len(i):
                continue
            bands = np.concatenate([v.values.to_numpy() for v in g.column("bands")]).reshape(-1, BANDS)
            first, second = x[i], y[j]
            mine = int((bands[x[0]] == g.column("key")[0].as_py()).argmax())
            here = (bands[first] == bands[second]).argmax(axis=1) == mine
            first, second = first[here], second[here]
            swap = docs[first] > docs[second]
            first, second = np.where(swap, second, first), np.where(swap, first, second)
            gathered: dict[tuple, list[int]] = {}
            needed: set[tuple] = set()
            for a, b in zip(first.tolist(), second.tolist(), strict=True):
                key = int(pivot[a]), int(pivot[b]), int(block[a]), int(block[b])
                gathered.setdefault((*key, int(docs[a])), []).append(int(docs[b]))
                needed.add((*key, int(docs[b])))
            rows += [(*key, partners) for key, partners in gathered.items()]
            rows += [(*key, None) for key in needed]
            if len(rows) > 20_000:
                yield flush()
        yield flush()

    return run


def _confirm(percent: int):
    """From sets and pairs of the same key, sorted by key: links among the pairs whose sets are alike.

    Within a key, a pair that links so far found already connect is not compared; nor is one whose estimate is too low.
    """
    floor = estimate_floor(percent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, _KEY):
            docs = g.column("a").to_pylist()
            rows = list(zip(docs, g.column("shingles").to_pylist(), g.column("packed").to_pylist(), strict=True))
            sets = {d: np.frombuffer(s, np.uint64) for d, s, _ in rows if s is not None}
            bits = {d: np.frombuffer(p, np.uint64)[None, :] for d, _, p in rows if p is not None}
            up = {d: d for d in sets}

            def top(d: int, up: dict[int, int] = up) -> int:
                while up[d] != d:
                    up[d] = up[up[d]]
                    d = up[d]
                return d

            links = []
            for x, partners in zip(docs, g.column("partners").to_pylist(), strict=True):
                for y in partners or ():
                    if top(x) == top(y):
                        continue
                    s, t = sets[x], sets[y]
                    if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)) or estimate(bits[x], bits[y])[0, 0] < floor:
                        continue
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * both >= percent * (len(s) + len(t) - both):
                        links.append((x, y))
                        up[top(y)] = top(x)
            if links:
                xs, ys = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], ["a", "b"])

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the pairs that have the same key: a row's a with each of its partners."""
    needed = pairs.select(*_KEY, F.col("a").alias("doc")).distinct()
    rows = needed.join(sets, "doc").select(*_KEY, F.col("doc").alias("a"), F.lit(None).cast("array<long>").alias("partners"), "packed", "shingles")
    none = F.lit(None).cast("binary")
    rows = rows.union(pairs.where("partners is not null").select(*_KEY, "a", "partners", none, none))
    return rows.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(_confirm(percent), "a long, b long")


def _strays(labelled: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, bi, bj, side, doc, component): the blocks of buckets with more than one component, from (key, doc, component).

    Blocks from 0 on hold members outside the bucket's largest component, negative ones those inside it.
    """
    sizes = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("all")).where("all > main.n")
    count = lambda n: F.ceil(n / block).cast("int")
    mixed = mixed.select("key", F.col("main.component").alias("largest"), count(F.col("all") - F.col("main.n")).alias("others"), count(F.col("main.n")).alias("inside"))
    stray = F.col("component") != F.col("largest")
    mine = F.pmod(F.xxhash64("doc", F.lit("part")), F.when(stray, F.col("others")).otherwise(F.col("inside"))).cast("int")
    spot = lambda i, j, side: F.struct(i.cast("int").alias("bi"), j.cast("int").alias("bj"), side.alias("side"))
    others, inside = F.sequence(F.lit(0), F.col("others") - 1), F.sequence(F.lit(0), F.col("inside") - 1)
    among = F.transform(others, lambda o: spot(F.least("mine", o), F.greatest("mine", o), F.when(F.col("mine") <= o, 0).otherwise(1)))
    against = F.transform(inside, lambda o: spot(F.col("mine"), -1 - o, F.lit(0)))
    within = F.transform(others, lambda o: spot(o, -1 - F.col("mine"), F.lit(1)))
    spots = F.when(stray, F.concat(among, against)).otherwise(within)
    return labelled.join(mixed, "key").withColumn("mine", mine).select("key", "doc", "component", F.explode(spots).alias("s")).select("key", "s.*", "doc", "component")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs.

    Two rows are linked when 100 * (shingles of both) >= percent * (shingles of either); component_id is the smallest
    doc_id that links reach, the row's own included; kept is doc_id = component_id. With fewer than `width` words the
    whole sequence is the one shingle; without words or text the set is empty and linked with nothing. Bands miss a
    pair of similarity s with the odds (1 - s ** 6) ** 32: 3e-7 at 0.85, 6e-5 at 0.8; the estimate, six standard errors wide, with less than 1e-7;
    a link that is found is confirmed on the full sets. A null doc_id is linked with nothing and kept. Repeated rows get the same values. No rows give no rows; other
    columns are not read.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sketches = settle(source.mapInArrow(_sketch(width), _SKETCH))
    usable = sketches.where("doc_id is not null and n_shingles > 0")
    classes = usable.groupBy("digest").agg(F.min("doc_id").alias("doc"))
    firsts = usable.join(classes.select("doc", F.col("digest").alias("of")), (F.col("doc_id") == F.col("doc")) & (F.col("digest") == F.col("of"))).dropDuplicates(["doc"])
    firsts = settle(firsts.select("doc", "n_shingles", "packed", "bands"))

    spread = firsts.select("doc", F.explode("bands").alias("key"))
    full = spread.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = settle(spread.join(full, "key"))
    central = members.groupBy("doc").agg(F.sum("members").alias("fullness"))
    ranked = members.select("key", "doc").join(central, "doc")
    pivot = ranked.groupBy("key").agg(F.max(F.struct("fullness", (-F.col("doc")).alias("minus"))).alias("best"))
    nearest = settle(ranked.join(pivot, "key").groupBy("doc").agg(F.max("best").alias("best")).select("doc", (-F.col("best.minus")).alias("pivot")))

    wanted = source.withColumnRenamed("doc_id", "doc").join(firsts.select("doc", "packed").join(nearest.select("doc"), "doc"), "doc").dropDuplicates(["doc"])
    sets = settle(wanted.mapInArrow(_sets(width), "doc long, packed binary, shingles binary"))

    of_family = nearest.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    families = settle(nearest.join(of_family, "pivot").select("doc", "pivot", F.pmod(F.xxhash64("doc", F.lit("block")), F.col("blocks")).cast("int").alias("block")))
    left, right = (families.select(F.col("doc").alias(c), F.col("pivot").alias(f"pivot_{c}"), F.col("block").alias(f"block_{c}")) for c in "ab")
    with_pivot = nearest.where("doc != pivot").select(F.col("pivot").alias("a"), F.col("doc").alias("b"))
    with_pivot = with_pivot.join(left, "a").join(right, "b").select(F.col("pivot_a").alias("p"), F.col("pivot_b").alias("q"), F.col("block_a").alias("i"), F.col("block_b").alias("j"), "a", "b")
    first_pairs = with_pivot.select(*_KEY, "a", F.array("b").alias("partners")).union(with_pivot.select(*_KEY, "b", F.lit(None).cast("array<long>")))
    own = nearest.select(F.col("doc").alias("a"), F.col("doc").alias("b"))
    links = settle(_links(first_pairs, sets, percent))
    labels = components(links.union(own))

    labelled = members.select("key", "doc").join(labels.withColumnRenamed("node", "doc"), "doc")
    spots = settle(_strays(labelled))
    wide = settle(sets.join(spots.select("doc").distinct(), "doc", "left_semi").select("doc", "shingles").mapInArrow(_wide, "doc long, wide binary"))
    placed = spots.join(firsts.select("doc", "n_shingles", "packed", "bands"), "doc").join(wide, "doc").join(families, "doc")
    order = ["key", "bi", "bj"]
    second_pairs = settle(placed.repartition(*order).sortWithinPartitions(*order).mapInArrow(_likely(percent), _PAIRS))
    more = settle(_links(second_pairs, sets, percent))
    final = components(links.union(more).union(own))
    discard(members, sets, links, more, labels, nearest, families, second_pairs, firsts, spots, wide)

    of_class = classes.join(final.withColumnRenamed("node", "doc"), "doc", "left").select("digest", F.coalesce("component", "doc").alias("component"))
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    return sketches.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
