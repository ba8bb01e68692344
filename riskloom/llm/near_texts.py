"""Near-duplicate texts: weighted samples of five-word shingles, banded, then verified.

A shingle weighs how often its text has it times a smoothed inverse document frequency, which is
counted over all documents for each shingle that more than one in RARE texts has; all others are rare
and have the full weight, so that a weight depends on the share of texts and not on the size of
the corpus. Hashed counters, which are never too low, say which shingles can be that frequent;
only these are counted one by one, and at most RARE times the shingles of a text are shared with
every task. IDF runs from 1 to 1 + IDF_SPAN only: a stronger one would make members of a very
large group of copies look unlike each other, since what they share is then common.

Improved consistent weighted sampling draws from every text BANDS x ROWS shingles; two texts draw
the same one with a probability of their weighted Jaccard similarity. Equal texts are one class
first. Classes that share a band are compared by their samples in blocks; what looks similar is
joined by a tree, and its links are verified on the texts. Then every similar-looking pair that
the verified links do not connect yet is verified as well, in blocks that hold their texts and give
only links between components. So a large group of copies costs a tree, and no list of pairs of a
group is ever made. A pair that shares no band, or fewer than LOOKS samples, is not verified: expected are
0.51% and 0.03% of pairs at a similarity of 0.8, 0.24% and 0.008% at 0.82, 0.06% and 0.0006% at 0.85;
other members of a group may still link such a pair.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import chunks
from riskloom.llm.bloom import may_hold
from riskloom.llm.components import components
from riskloom.operators.skew import salted_join
from riskloom.session import settle

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 10, 4
IDF_SPAN = 0.25
COUNTERS = 1 << 20
# A shingle that at most one in so many texts has is rare.
RARE = 512
POOL = 1 << 16
# Equal samples, of all, from which on a pair is verified: at a similarity of 0.8 a pair has fewer
# once in some five thousand pairs.
LOOKS = 23
CHUNK = 1_000
# Texts of one bucket that are verified against as many others at once.
TEXTS = 250
# Bytes of text worked on at once: a word takes some two hundred bytes on the way.
WORK_BYTES = 4 << 20
SEED = 29

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _A
    return h ^ (h >> np.uint64(29))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, times) of all distinct shingles, sorted; words are lower-case.

    A text of fewer than five words has them all as its one shingle; one without words has none.
    """
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    parts = pc.utf8_split_whitespace(low)
    flat, starts = parts.flatten(), np.asarray(parts.offsets.to_numpy(), np.int64)
    starts = starts - starts[0]
    edges = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1, flat.offset * 8) if len(flat) \
        else np.zeros(1, np.int64)
    raw = flat.buffers()[2] if len(flat) else None
    letters = np.frombuffer(raw, np.uint8)[edges[0]:edges[-1]] if raw else np.zeros(0, np.uint8)
    sizes = np.diff(edges)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(sizes.max(initial=0)) + 1, _B, np.uint64))
        place = np.arange(len(letters)) - np.repeat(edges[:-1] - edges[0], sizes)
        codes = np.zeros(len(sizes), np.uint64)
        filled = np.flatnonzero(sizes)
        if len(filled):
            codes[filled] = np.add.reduceat((letters + np.uint64(1)) * powers[place], (edges[:-1] - edges[0])[filled])
        codes = _stir(codes)
        # utf8_split_whitespace gives an empty word at white space on either end: drop these.
        owner = np.repeat(np.arange(len(texts)), np.diff(starts))[filled]
        codes = codes[filled]
        counts = np.bincount(owner, minlength=len(texts))
        n = len(codes)
        left = np.repeat(np.cumsum(counts), counts) - np.arange(n)  # words of the text from here on
        rolled = codes.copy()
        for i in range(1, SHINGLE):
            more = np.zeros(n, np.uint64)
            more[:max(0, n - i)] = codes[i:]
            rolled = np.where(left > i, rolled * _B + more, rolled)
        first = np.zeros(n, bool)
        first[(np.cumsum(counts) - counts)[counts > 0]] = True
        keep = (left >= SHINGLE) | first
        owner, found = owner[keep], _stir(rolled[keep])
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], found[at], np.diff(np.append(at, len(found)))


def _counter(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


@dataclass
class Idf:
    """Weights of the frequent shingles, sorted by hash, and that of all others."""

    found: np.ndarray
    weight: np.ndarray
    rare: float

    def of(self, found: np.ndarray) -> np.ndarray:
        if not len(self.found):
            return np.full(len(found), self.rare, np.float32)
        place = np.minimum(np.searchsorted(self.found, found), len(self.found) - 1)
        return np.where(self.found[place] == found, self.weight[place], np.float32(self.rare))


def idf_of(seen: np.ndarray, texts: int) -> np.ndarray:
    """Weights from the numbers of texts that have a shingle: 1 if all have it, 1 + IDF_SPAN if one in RARE or fewer.

    Up to RARE texts the scale is the corpus itself.
    """
    scale = np.log((texts + 1) / (np.minimum(seen, texts) + 1)) / np.log(min(texts, RARE) + 1)
    return (1 + IDF_SPAN * np.minimum(scale, 1)).astype(np.float32)


def _upper_counts(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts, and for each counter how often a text has one of its shingles: never below a shingle's own."""
    block = 4_096

    def count(batches):
        total, texts = np.zeros(COUNTERS, np.int64), 0
        for batch in batches:
            for _, part in chunks.slices(batch.column(0), WORK_BYTES):
                _, found, _ = shingles(part)
                total += np.bincount(_counter(found), minlength=COUNTERS)
                texts += len(part)
        pieces = [total[i:i + block].astype("<i8").tobytes() for i in range(0, COUNTERS, block)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, len(pieces)), pa.int32()),
             pa.array([np.array([texts], "<i8").tobytes(), *pieces], pa.binary())], names=["part", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(raw, "<i8")
                sums[part] = sums[part] + own if part in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()),
                                          pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                                         names=["part", "counts"])

    schema = "part int, counts binary"
    summed = rows.select("text").mapInArrow(chunks.tidied(count), schema).repartition("part").mapInArrow(chunks.tidied(add), schema)
    parts: dict[int, np.ndarray] = {}
    for row in summed.collect():  # COUNTERS numbers
        parts[row["part"]] = np.frombuffer(row["counts"], "<i8")
    texts = int(parts.pop(-1)[0]) if parts else 0
    return texts, np.concatenate([parts[i] for i in sorted(parts)] or [np.zeros(COUNTERS, np.int64)])


def idf_weights(rows: DataFrame) -> Idf:
    """Weights from the document frequencies in all rows of (key, text)."""
    texts, upper = _upper_counts(rows)
    if not texts:
        return Idf(np.zeros(0, np.uint64), np.zeros(0, np.float32), 1.0)
    least = max(1, texts // RARE)  # a shingle in one text only is as rare as can be
    maybe = rows.sparkSession.sparkContext.broadcast(np.packbits(upper > least))

    def count(batches):
        wanted = np.unpackbits(maybe.value).view(bool)
        for batch in batches:
            for _, part in chunks.slices(batch.column(0), WORK_BYTES):
                _, found, _ = shingles(part)
                own, times = np.unique(found[wanted[_counter(found)]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(times, pa.int64())],
                                                 names=["shingle", "n"])

    counted = (rows.select("text").mapInArrow(chunks.tidied(count), "shingle bigint, n bigint").groupBy("shingle")
               .agg(F.sum("n").alias("n")).where(F.col("n") > least).toPandas())
    found = counted["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(found)
    rare = float(idf_of(np.array([least]), texts)[0]) if texts <= RARE else 1 + IDF_SPAN
    return Idf(found[order], idf_of(counted["n"].to_numpy(np.int64)[order], texts), rare)


def weigh(found: np.ndarray, times: np.ndarray, idf: Idf) -> np.ndarray:
    return times.astype(np.float32) * idf.of(found)


def _draws() -> tuple[np.ndarray, ...]:
    """The random numbers of weighted sampling for every place of the pool: 1/r, r, beta, ln c."""
    random = np.random.default_rng(SEED)
    r, c = random.gamma(2, 1, POOL), random.gamma(2, 1, POOL)
    return tuple(x.astype(np.float32) for x in (1 / r, r, random.uniform(0, 1, POOL), np.log(c)))


def samples(owner: np.ndarray, found: np.ndarray, weight: np.ndarray, texts: int,
            step: int = 1 << 16) -> np.ndarray:
    """One 64-bit sample per text and hash; 0 where a text has no shingle."""
    inverse, r, beta, log_c = _draws()
    hashes = BANDS * ROWS
    odd = np.random.default_rng(SEED + 1).integers(1, 1 << 62, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((texts, hashes), np.uint64)
    log_w = np.log(weight)
    counts = np.bincount(owner, minlength=texts)
    ends = np.cumsum(counts)
    at = 0
    with np.errstate(over="ignore"):
        while at < texts:
            begin = ends[at] - counts[at]
            stop = max(at + 1, int(np.searchsorted(ends, begin + step, side="right")))
            part = slice(begin, ends[stop - 1])
            own, logs, size = found[part], log_w[part], counts[at:stop]
            rows = np.flatnonzero(size) + at
            size = size[size > 0]
            starts = np.cumsum(size) - size
            if len(own):
                for k in range(hashes):
                    place = ((own * odd[k]) >> np.uint64(48)).astype(np.int64)
                    rate, shift = r[place], beta[place]
                    t = np.floor(logs * inverse[place] + shift)
                    value = log_c[place] - rate * (t - shift + 1)
                    least = np.minimum.reduceat(value, starts)
                    hit = np.flatnonzero(value == np.repeat(least, size))
                    row = np.searchsorted(starts, hit, side="right") - 1
                    first = hit[np.flatnonzero(np.diff(row, prepend=-1))]  # ties: the smaller hash
                    out[rows, k] = _stir(own[first] + _B * t[first].astype(np.int64).view(np.uint64)
                                         + np.uint64(k)) | np.uint64(1)
            at = stop
    return out


def _signatures(rows: DataFrame, idf) -> DataFrame:
    """(key, h1, h2, bands, samples): a key per band and 16 bits of each sample; none without words."""
    def sign(batches):
        weights = idf.value
        for batch in batches:
            for at, part in chunks.slices(batch.column(3), WORK_BYTES):
                owner, found, times = shingles(part)
                drawn = samples(owner, found, weigh(found, times, weights), len(part))
                some = drawn[:, 0] != 0
                keys = np.zeros((len(part), BANDS), np.uint64)
                with np.errstate(over="ignore"):
                    for b in range(BANDS):
                        for i in range(ROWS):
                            keys[:, b] = _stir(keys[:, b] * _B + drawn[:, b * ROWS + i])
                short = (drawn >> np.uint64(40)).astype(np.uint16)
                bands = [k if s else None for k, s in zip(keys.view(np.int64), some, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(at, len(part)) for i in range(3)),
                     pa.array(bands, pa.list_(pa.int64())), pa.array([s.tobytes() for s in short], pa.binary())],
                    names=["key", "h1", "h2", "bands", "samples"])

    return rows.select("key", "h1", "h2", "text").mapInArrow(
        chunks.tidied(sign), "key bigint, h1 bigint, h2 bigint, bands array<bigint>, samples binary")


def _tree(alike: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of pairs that look alike, the most alike first (Prim's way)."""
    m = len(alike)
    out, best, link = [], np.zeros(m, np.int64), np.full(m, -1)
    left = np.ones(m, bool)
    for _ in range(m):
        i = int(np.argmax(np.where(left, best, -1)))
        left[i] = False
        if best[i]:
            out.append((int(link[i]), i))
        better = left & (alike[i] > best)
        best[better], link[better] = alike[i][better], i
    return out


def _alike(rows: dict[str, list], split: bool) -> np.ndarray:
    """Equal samples of each pair of a block, 0 where too few to look alike."""
    drawn = np.array([np.frombuffer(s, np.uint16) for s in rows["samples"]])
    keys, part = np.array(rows["rep"], np.int64), np.array(rows["part"])
    alike = np.zeros((len(keys), len(keys)), np.int16)
    for k in range(drawn.shape[1]):
        alike += drawn[:, k][:, None] == drawn[:, k][None, :]
    alike[alike < LOOKS] = 0
    alike[keys[:, None] == keys[None, :]] = 0
    if split:
        alike[part[:, None] == part[None, :]] = 0
    return alike


def _tree_pairs(rows: dict[str, list], split: bool) -> list[tuple[int, int]]:
    keys = rows["rep"]
    return [(min(keys[a], keys[b]), max(keys[a], keys[b])) for a, b in _tree(_alike(rows, split))]


def _apart(rows: dict[str, list], split: bool) -> list[tuple[int]]:
    """Members that look like one of another component."""
    component = np.array(rows["component"], np.int64)
    open_ = (_alike(rows, split) > 0) & (component[:, None] != component[None, :])
    return [(rows["rep"][i],) for i in np.flatnonzero(open_.any(axis=1))]


def _joining(rows: dict[str, list], split: bool, weights: Idf, similar: float) -> list[tuple[int, int]]:
    """Verified links between components of a block; pairs that are connected by then need none."""
    alike, (_, label) = _alike(rows, split), np.unique(rows["component"], return_inverse=True)
    owner, found, times = shingles(pa.array(rows["text"], pa.large_string()))
    weight = weigh(found, times, weights).astype(np.float64)
    edges = np.searchsorted(owner, np.arange(len(label) + 1))
    total = np.bincount(owner, weight, len(label))
    out = []
    for a in range(len(label)):
        others = np.flatnonzero((alike[a] > 0) & (label != label[a]))
        own, own_weight = found[edges[a]:edges[a + 1]], weight[edges[a]:edges[a + 1]]
        if not len(others) or not len(own):
            continue
        size = edges[others + 1] - edges[others]
        at = np.repeat(edges[others] - np.cumsum(size) + size, size) + np.arange(size.sum())
        place = np.minimum(np.searchsorted(own, found[at]), len(own) - 1)
        both = np.where(own[place] == found[at], np.minimum(own_weight[place], weight[at]), 0)
        shared = np.bincount(np.repeat(np.arange(len(others)), size), both, len(others))
        near = shared >= similar * (total[a] + total[others] - shared)
        for b in others[near]:
            if label[b] != label[a]:
                out.append((rows["rep"][a], rows["rep"][b]))
                label[label == label[b]] = label[a]
    return out


def _blocks(members: DataFrame, chunk: int, columns: tuple[str, ...], work, out: str) -> DataFrame:
    """`work` on each bucket, or on each pair of its parts of about `chunk` rows.

    `members` has band, bucket, n (rows of the bucket) and `columns`; `out` is the schema of what comes out.
    """
    parts = F.ceil(F.col("n") / chunk).cast("int")
    met = F.transform(F.sequence(F.lit(0), parts - 1), lambda q: F.struct(
        F.least(q, F.col("part")).alias("lo"), F.greatest(q, F.col("part")).alias("hi")))
    keys = ["band", "bucket", "lo", "hi"]
    dealt = (members.withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int"))
             .select("band", "bucket", "part", *columns, F.inline(met)))
    names = [x.split()[0] for x in out.split(", ")]

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(len(names))],
                                          names=names)

    def blocks(batches):
        key, held = None, None

        def close():
            return [] if held is None or len(held["rep"]) < 2 else work(held, key[2] != key[3])

        for batch in batches:
            given = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
            at = list(zip(*(given[k] for k in keys), strict=True))
            i, found = 0, []
            while i < len(at):
                j = i + 1
                while j < len(at) and at[j] == at[i]:
                    j += 1
                rows = {k: given[k][i:j] for k in (*columns, "part")}
                if at[i] == key:
                    for k, v in rows.items():
                        held[k] += v
                else:
                    found += close()
                    key, held = at[i], rows
                i = j
            yield batch_of(found)
        yield batch_of(close())

    return dealt.repartition(*keys).sortWithinPartitions(*keys, "rep").mapInArrow(chunks.tidied(blocks), out)


def similarity(left: pa.Array, right: pa.Array, idf: Idf) -> np.ndarray:
    """Weighted Jaccard similarity of texts side by side; 0 where one has no words."""
    n = len(left)
    owner, found, times = shingles(pa.concat_arrays([left.cast(pa.large_string()), right.cast(pa.large_string())]))
    weight = weigh(found, times, idf).astype(np.float64)
    order = np.lexsort((found, owner % n if n else owner))
    pair, found, weight = (owner % n if n else owner)[order], found[order], weight[order]
    twice = np.flatnonzero((pair[1:] == pair[:-1]) & (found[1:] == found[:-1]))
    shared = np.bincount(pair[twice], np.minimum(weight[twice], weight[twice + 1]), n)
    total = np.bincount(pair, weight, n) - shared
    return np.where(total > 0, shared / np.maximum(total, 1e-300), 0.0)


def _verified(pairs: DataFrame, texts: DataFrame, idf, similar: float) -> DataFrame:
    """The pairs whose texts are similar enough."""
    left = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))

    def verify(batches):
        weights = idf.value
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            for at, part in chunks.slices(a, WORK_BYTES // 2):
                value = similarity(part, b.slice(at, len(part)), weights)
                good = pa.array(value >= similar)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(at, len(part)).filter(good) for i in range(2)], names=["a", "b"])

    return (pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
            .mapInArrow(chunks.tidied(verify), "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(key, class_id, kept), one row per row of `docs`.

    `class_id` is the smallest key among all texts linked to this one, directly or through others:
    equal texts, and texts whose weighted Jaccard similarity is at least `similar`. Null text and null keys
    are linked with nothing (class_id is the key); empty texts are equal texts; rows that repeat a key are one
    document; an empty table gives no rows; other columns are not read. `kept` marks the
    document whose key names the class, and rows with a null key.
    """
    words = F.col(text)
    fit = words.isNotNull() & F.col(key).isNotNull()
    rows = docs.select(F.col(key).cast("bigint").alias("key"), words.alias("text"),
                       F.when(fit, F.xxhash64(words)).alias("h1"),
                       F.when(fit, F.xxhash64(words, F.lit(SEED))).alias("h2"))
    idf = docs.sparkSession.sparkContext.broadcast(idf_weights(rows))
    signed = settle(_signatures(rows, idf), "signatures")
    classes = settle(signed.where("h1 is not null").groupBy("h1", "h2").agg(
        F.min("key").alias("rep"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"),
        F.any_value("samples").alias("samples")), "text-classes")
    narrow = classes.select("rep", F.posexplode("bands").alias("band", "bucket"))
    shared = settle(narrow.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared-bands")
    met = narrow.join(shared, ["band", "bucket"])
    members = settle(met.join(classes.select("rep", "samples"), "rep"), "members")
    tried = settle(_blocks(members, CHUNK, ("rep", "samples"), _tree_pairs, "a bigint, b bigint").distinct(),
                   "tree-pairs")
    wanted = members.select("rep").distinct()
    texts = settle(rows.where(may_hold(wanted, "rep", "key")).select("key", "text")
                   .join(wanted.withColumnRenamed("rep", "key"), "key", "left_semi")
                   .dropDuplicates(["key"]), "texts")
    links = settle(_verified(tried, texts, idf, similar), "tree-links")
    joined = components(links).withColumnRenamed("node", "rep")
    known = settle(members.join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep")),
                   "known")
    # What still looks alike across components is verified where it meets, in small blocks of texts.
    apart = (_blocks(known, CHUNK, ("rep", "samples", "component"), _apart, "rep bigint").distinct())
    still = known.join(settle(apart, "apart"), "rep", "left_semi")
    some = still.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    open_ = (still.drop("n").join(some, ["band", "bucket"])
             .join(texts.select(F.col("key").alias("rep"), "text"), "rep"))
    more = settle(_blocks(open_, TEXTS, ("rep", "samples", "component", "text"),
                          lambda block, split: _joining(block, split, idf.value, similar), "a bigint, b bigint"),
                  "links")
    # The components found so far stand as stars, which take a single round.
    stars = joined.select(F.col("rep").alias("a"), F.col("component").alias("b"))
    final = components(stars.unionByName(more)).withColumnRenamed("node", "rep")
    info = settle(classes.select("h1", "h2", "rep", "copies").join(final, "rep", "left")
                  .where("copies > 1 or component is not null")
                  .select("h1", "h2", F.coalesce("component", "rep").alias("class_id")), "linked-texts")
    out = salted_join(signed.select("key", "h1", "h2"), info, ["h1", "h2"], "left", salt_from=("key",))
    class_id = F.coalesce("class_id", "key")
    return out.select(F.col("key").alias(key), class_id.alias("class_id"),
                      (F.col("key").eqNullSafe(class_id)).alias("kept"))


def keep_first(docs: DataFrame, similar: float = SIMILAR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, with their columns, of the one document that stays of each class.

    A filter of bounded size lets rows pass that surely stay; only the others are joined with the
    list of documents to drop.
    """
    # Own names for the caller's columns: none of them can clash with those added here.
    marked = docs.withColumnsRenamed({c: f"in_{i}" for i, c in enumerate(docs.columns)})
    name = dict(zip(docs.columns, marked.columns, strict=True))
    drop = settle(near_duplicates(docs.select(key, text), similar, key, text).where("not kept")
                  .select(F.col(key).alias("_drop")), "dropped").distinct()
    marked = marked.withColumn("_maybe", may_hold(drop, "_drop", name[key]))
    joined = marked.where("_maybe").join(drop, F.col(name[key]) == F.col("_drop"), "left_anti")
    return marked.where("not _maybe").unionByName(joined).select(*(F.col(n).alias(c) for c, n in name.items()))
