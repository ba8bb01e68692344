"""Corpus curation: clean, label, resolve conflicts, dedupe, split, vocabulary, encode.

Rows carry a unique `ord` (input order). Text is hashed once; only (hash, label, ord)
takes part in the grouping, and the text itself moves when the winners are known.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions import scoring, text
from ..session import settle
from .skew import compute_once, salted_join


def clean_labelled(df: DataFrame, min_length: int = 10) -> DataFrame:
    """`code, language, safety` to `code_clean, language, safety, label, code_hash`."""
    safety = F.lower(text.strip(F.col("safety")))
    kept = (df.dropna(subset=["code", "safety"])
            .withColumn("language", F.lower(text.strip(
                F.coalesce(F.col("language"), F.lit("Other")))))
            .withColumn("safety", safety)
            .where(F.col("safety").isin("vulnerable", "safe"))
            .withColumn("label", (F.col("safety") == "vulnerable").cast("int")))
    return (compute_once(kept, code_clean=text.clean_text(F.col("code")))
            .where(F.length("code_clean") > min_length)
            .withColumn("code_hash", F.sha2("code_clean", 256))
            .drop("code"))


def conflicting(df: DataFrame, key: str = "code_hash", label: str = "label") -> DataFrame:
    """Keys that occur with more than one label, with their number of rows."""
    return (df.groupBy(key).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi"),
                                F.count("*").alias("n_rows"))
            .where("_lo <> _hi").select(key, "n_rows"))


def drop_conflicting(df: DataFrame, key: str = "code_hash", label: str = "label",
                     ord: str = "ord") -> DataFrame:
    """Remove every row of a key with contradictory labels.

    The rows of a much-copied key are shared out by salt; the conflicting keys are few.
    """
    return salted_join(df, conflicting(df, key, label), [key], "left_anti", [ord], "n_rows")


def dedupe_first(df: DataFrame, keys: Sequence[str] = ("code_hash", "label"),
                 ord: str = "ord") -> DataFrame:
    """Keep the first row of each key. `min(ord)` combines map-side, so copies of one text
    never meet in one task; the semi-join is on the unique `ord`."""
    first = df.groupBy(*keys).agg(F.min(ord).alias(ord)).select(ord)
    return df.join(first, ord, "left_semi")


def resolve_copies(df: DataFrame, key: str = "code_hash", label: str = "label",
                   ord: str = "ord") -> DataFrame:
    """`drop_conflicting` and `dedupe_first` in one grouping."""
    winners = (df.groupBy(key)
               .agg(F.min(label).alias("_lo"), F.max(label).alias("_hi"),
                    F.min(ord).alias(ord))
               .where("_lo = _hi").select(ord))
    # Only the winners' positions are held in a hash table; the texts pass by it unsorted.
    return df.join(winners.hint("shuffle_hash"), ord, "left_semi")


def language_slice(df: DataFrame, language: str | None = "py") -> DataFrame:
    if not language:
        return df
    wanted = language.lower()
    names = ["py", "python"] if wanted in ("py", "python") else [wanted]
    return df.where(F.col("language").isin(names))


def normalise(df: DataFrame, code: str = "code_clean", language: Column | None = None,
              tokenise=text.corpus_tokens) -> DataFrame:
    """Add `normalized_code`, `tokens`, `token_length`; rows without tokens are dropped."""
    lang = F.col("language") if language is None else language
    normal = compute_once(df, normalized_code=text.normalise_code(F.col(code), lang))
    return (compute_once(normal, tokens=tokenise(F.col("normalized_code")))
            .withColumn("token_length", F.size("tokens"))
            .where("token_length > 0"))


def union_corpora(parts: Sequence[DataFrame], ord: str = "ord",
                  drop_conflicts: bool = False) -> DataFrame:
    """Concatenate corpora (earlier ones win) and dedupe on (normalized_code, label).

    `ord` becomes a text that sorts by part first, so it is unique over the union: whole numbers are
    written at full width above zero, texts of any length stay as they are.
    Labels may contradict each other again after the merge unless `drop_conflicts`.
    """
    tagged = [p.withColumn(ord, F.concat(F.lit(f"{i:06d}:"), _sortable(p, ord)))
              for i, p in enumerate(parts)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    both = compute_once(both, _h=F.sha2("normalized_code", 256))
    out = (resolve_copies(both, "_h", ord=ord) if drop_conflicts
           else dedupe_first(both, ("_h", "label"), ord))
    return out.drop("_h")


def _sortable(df: DataFrame, ord: str) -> Column:
    """A text that sorts like `ord` and differs where `ord` does."""
    if isinstance(df.schema[ord].dataType, T.IntegralType):
        above = F.col(ord).cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")
        return F.lpad(above.cast("decimal(20,0)").cast("string"), 20, "0")
    return F.col(ord).cast("string")


def diff_sides(parts: DataFrame, min_length: int = 10) -> DataFrame:
    """Bad parts (label 1) and good parts (label 0) of `side, code` rows, one pass."""
    return (parts.where(F.col("side").isin("bad", "good"))
            .where(F.length(text.strip(F.col("code"))) > min_length)
            .withColumn("label", (F.col("side") == "bad").cast("int"))
            .withColumn("safety", F.when(F.col("label") == 1, "vulnerable").otherwise("safe")))


# Vocabulary and encoding -------------------------------------------------------------

def token_frequency(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    return (df.select(F.explode(tokens).alias("token")).groupBy("token")
            .agg(F.count("*").alias("n")))


def build_vocabulary(df: DataFrame, tokens: str = "tokens", max_size: int = 10_000
                     ) -> DataFrame:
    """(token, id): reserved ids first, then tokens by count, ties by token.

    A reserved token among the most frequent uses up a place but gets no new id. Only the
    kept top is ranked, so the single-task window sees at most `max_size` rows.
    """
    spark, reserved = df.sparkSession, fixed.RESERVED_TOKENS
    top = (token_frequency(df, tokens).orderBy(F.desc("n"), "token")
           .limit(max_size - len(reserved)).where(~F.col("token").isin(*reserved)))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "token"))
    fresh = top.select("token", (rank + len(reserved) - 1).cast("int").alias("id"))
    head = spark.createDataFrame([(t, i) for i, t in enumerate(reserved)],
                                 "token string, id int")
    return head.unionByName(fresh)


def encode_tokens(df: DataFrame, vocabulary: DataFrame, key: str | Sequence[str],
                  tokens: str = "tokens", length: int = fixed.SEQUENCE_LENGTH,
                  max_broadcast: int = 100_000) -> DataFrame:
    """Fixed-length id sequences: first `length` tokens, unknown = 1, zero-padded.

    `key` names the columns that tell rows apart. A vocabulary counted to have at most
    `max_broadcast` rows is sent to the tasks once and looked up there in Arrow batches, so no row is
    shuffled. A larger one is joined, with hot tokens salted; the result is the same. The vocabulary is
    written down first: it is counted and then read, and may be the count of a whole corpus.
    """
    vocabulary = settle(vocabulary.select("token", "id"), "vocabulary")
    if vocabulary.limit(max_broadcast + 1).count() <= max_broadcast:
        return df.withColumn("features", _lookup(vocabulary, length)(
            F.slice(tokens, 1, length)))
    return _encode_by_join(df, vocabulary, key, tokens, length)


def _lookup(vocabulary: DataFrame, length: int):
    rows = vocabulary.select("token", "id").collect()
    shared = vocabulary.sparkSession.sparkContext.broadcast(
        ([r["token"] for r in rows], [r["id"] for r in rows]))

    def encode(lists: pa.Array) -> pa.Array:
        words, ids = shared.value
        # One place past the end stands for unknown words.
        table = np.array([*ids, fixed.UNK_ID], dtype=np.int32)
        place = pc.fill_null(pc.index_in(lists.flatten(), pa.array(words)), len(words))
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        out = np.full((len(lists), length), fixed.PAD_ID, dtype=np.int32)
        out[np.arange(length) < sizes[:, None]] = table[place.to_numpy(zero_copy_only=False)]
        ends = pa.array(np.arange(len(lists) + 1, dtype=np.int32) * length)
        return pa.ListArray.from_arrays(ends, pa.array(out.ravel()))

    return F.arrow_udf(encode, T.ArrayType(T.IntegerType()))


def _encode_by_join(df: DataFrame, vocabulary: DataFrame, key: str | Sequence[str], tokens: str,
                    length: int) -> DataFrame:
    """The join collects at most `length` pairs per row when it regroups."""
    keys = [key] if isinstance(key, str) else list(key)
    spots = df.select(*keys, F.posexplode(F.slice(tokens, 1, length)).alias("pos", "token"))
    vocab = vocabulary.select("token", F.col("id").alias("_id"))
    looked = salted_join(spots, vocab, ["token"], "left", [*keys, "pos"])
    pair = F.struct("pos", F.coalesce("_id", F.lit(fixed.UNK_ID)).alias("id"))
    ids = (looked.groupBy(*keys).agg(F.array_sort(F.collect_list(pair)).alias("_p"))
           .select(*keys, F.transform("_p", lambda p: p["id"]).alias("_ids")))
    empty = F.array().cast("array<int>")
    return (df.join(ids, keys, "left")
            .withColumn("features", scoring.pad_right(F.coalesce("_ids", empty), length))
            .drop("_ids"))


# Split -------------------------------------------------------------------------------

def split_sizes(n: Column, holdout: float, test_share: float) -> tuple[Column, Column]:
    """Rows for training and validation: both held-out sizes are rounded up."""
    held = F.ceil(n * holdout)
    test = F.ceil(held * test_share)
    return n - held, held - test


def _allocate(classes: DataFrame, total: str, weight: str, out: str) -> DataFrame:
    """Share `total` over the classes by `weight`, largest remainders first."""
    everyone = Window.partitionBy(F.lit(1))
    exact = F.col(total) * F.col(weight) / F.sum(weight).over(everyone)
    step = (classes.withColumn("_exact", exact).withColumn("_base", F.floor("_exact"))
            .withColumn("_left", F.col(total) - F.sum("_base").over(everyone)))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc(F.col("_exact") - F.col("_base")),
                                                 "label")
    return (step.withColumn(out, F.col("_base") + F.when(
        F.row_number().over(order) <= F.col("_left"), 1).otherwise(0))
        .drop("_exact", "_base", "_left"))


def _at_cuts(counts: DataFrame, goals: DataFrame) -> DataFrame:
    """Of each (label, _parent) the prefix that holds a cut, and the place of the cut in it."""
    upto = (Window.partitionBy("label", "_parent").orderBy("_p")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reach = counts.withColumn("_upto", F.sum("_n").over(upto))
    return (reach.join(F.broadcast(goals), ["label", "_parent"])
            .where((F.col("goal") > F.col("_upto") - F.col("_n"))
                   & (F.col("goal") <= F.col("_upto")))
            .select("label", "_p", "cut", "_n",
                    (F.col("goal") - F.col("_upto") + F.col("_n")).alias("_want")))


def stratified_split(df: DataFrame, key: str, label: str = "label", seed: int = 42,
                     ratios: tuple[float, float, float] = (0.70, 0.15, 0.15),
                     digits: int = 3, most: int = 100_000) -> DataFrame:
    """Add `split` (train, val, test) with exact sizes per class, the same on every run.

    Rows are ordered by a hash of (seed, key). The rank is never computed for all rows:
    counts per hash prefix (a small table) show which prefix holds each cut. While such a
    prefix has more than `most` rows only its rows are counted again, by `digits` more digits;
    then they are ranked, and the hash found at the cut decides every other row by comparison.
    No class is gathered in one task, and no task ranks more than `most` rows of different
    keys. Counts and cuts are found when this is called; each reader of the result then hashes keys only.
    """
    if abs(sum(ratios) - 1.0) >= 1e-5:
        raise ValueError("split ratios must sum to 1")
    holdout = ratios[1] + ratios[2]
    hashed = df.withColumn("_h", F.sha2(F.concat_ws(":", F.lit(seed), F.col(key)), 256))
    slim = hashed.select(F.col(label).alias("label"), F.col(key).alias("_key"), "_h")
    counts = slim.groupBy("label", F.lit("").alias("_parent"), F.substring("_h", 1, digits).alias("_p")
                          ).agg(F.count("*").alias("_n"))

    everyone = Window.partitionBy(F.lit(1))
    classes = (counts.groupBy("label").agg(F.sum("_n").alias("_class"))
               .withColumn("_all", F.sum("_class").over(everyone)))
    train, val = split_sizes(F.col("_all"), holdout, ratios[2] / holdout)
    classes = classes.withColumn("_train_all", train).withColumn("_val_all", val)
    classes = _allocate(classes, "_train_all", "_class", "_train")
    classes = classes.withColumn("_rest", F.col("_class") - F.col("_train"))
    classes = _allocate(classes, "_val_all", "_rest", "_val")
    goals = classes.select("label", F.lit("").alias("_parent"), F.explode(F.array(
        F.struct(F.lit("train").alias("cut"), F.col("_train").alias("goal")),
        F.struct(F.lit("val").alias("cut"), (F.col("_train") + F.col("_val")).alias("goal")),
    )).alias("_g")).select("label", "_parent", "_g.*")

    # Two rows per class label: they may pass through the driver.
    depth = digits
    while True:
        at_cuts = _at_cuts(counts, goals)
        found = at_cuts.collect()
        edges = df.sparkSession.createDataFrame(found, at_cuts.schema)
        if depth >= 64 or all(row["_n"] <= most for row in found):
            break
        goals = edges.select("label", F.col("_p").alias("_parent"), "cut", F.col("_want").alias("goal"))
        parent = slim.withColumn("_parent", F.substring("_h", 1, depth))
        depth += digits
        counts = (parent.join(F.broadcast(goals.select("label", "_parent").distinct()), ["label", "_parent"])
                  .groupBy("label", "_parent", F.substring("_h", 1, depth).alias("_p"))
                  .agg(F.count("*").alias("_n")))
    inside = Window.partitionBy("label", "_p", "cut").orderBy("_h", "_key")
    found = (slim.withColumn("_p", F.substring("_h", 1, depth)).join(F.broadcast(edges), ["label", "_p"])
             .withColumn("_rn", F.row_number().over(inside))
             .where("_rn = _want")
             .select("label", "cut", F.struct("_h", "_key").alias("_at")))
    cuts = (found.groupBy(F.col("label").alias("_label"))
            .agg(F.max(F.when(F.col("cut") == "train", F.col("_at"))).alias("_train"),
                 F.max(F.when(F.col("cut") == "val", F.col("_at"))).alias("_val")))
    cuts = df.sparkSession.createDataFrame(cuts.collect(), cuts.schema)
    here = F.struct(F.col("_h"), F.col(key).alias("_key"))
    # One row per class label.
    return (hashed.join(F.broadcast(cuts), hashed[label] == cuts["_label"], "left")
            .withColumn("split", F.when(here <= F.col("_train"), "train")
                        .when(here <= F.col("_val"), "val").otherwise("test"))
            .drop("_h", "_label", "_train", "_val"))


# Summaries ---------------------------------------------------------------------------

def dataset_summary(split: DataFrame) -> DataFrame:
    """Rows, classes and token lengths per split, with a grand total."""
    return split.rollup("split").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("label") == 1).alias("vulnerable"),
        F.count_if(F.col("label") == 0).alias("safe"),
        F.avg("token_length").alias("mean_length"),
        F.median("token_length").alias("median_length"),
        F.max("token_length").alias("max_length"),
        F.min("token_length").alias("min_length"),
    ).withColumn("split", F.coalesce("split", F.lit("all")))


def summary_document(summary: DataFrame, language: str | None = None,
                     length: int = fixed.SEQUENCE_LENGTH, categories: DataFrame | None = None,
                     **tables: DataFrame) -> DataFrame:
    """One row for a summary file: splits as a map, token lengths, and the row count of each
    of `tables` under its name. `summary` has one row per split."""
    share = F.struct("total", "vulnerable", "safe")
    overall = F.col("split") == "all"
    stats = F.struct(*[F.col(f"{s}_length").alias(s) for s in ("mean", "median", "max", "min")])
    parts = [summary.agg(
        F.max(F.when(overall, F.col("total"))).alias("target_samples"),
        F.map_from_entries(F.collect_list(F.when(~overall, F.struct("split", share))))
        .alias("splits"), F.max(F.when(overall, stats)).alias("token_length_stats"))]
    parts += [df.agg(F.count("*").alias(name)) for name, df in tables.items()]
    if categories is not None:
        entry = F.struct(*categories.columns)
        parts.append(categories.agg(F.map_from_entries(F.collect_list(entry))
                                    .alias("category_distribution")))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    merged = rows.agg(*[F.first(c, ignorenulls=True).alias(c) for c in rows.columns])
    return merged.withColumn("language", F.lit(language)).withColumn(
        "max_sequence_length", F.lit(length))


def copy_audit(df: DataFrame, keys: Sequence[str], code: str = "code") -> DataFrame:
    """Rows, distinct stripped texts (by SHA-256) and duplicates per key."""
    per_hash = (df.withColumn("_h", text.sha256_stripped(F.col(code)))
                .groupBy(*keys, "_h").agg(F.count("*").alias("_n")))
    return per_hash.groupBy(*keys).agg(
        F.sum("_n").alias("rows"), F.count("*").alias("unique_hashes"),
        (F.sum("_n") - F.count("*")).alias("duplicates"))


def raw_audit(df: DataFrame, keys: Sequence[str] = (), languages: Sequence[str] = ("py", "python"),
              code: str = "code", language: str = "language", safety: str = "safety",
              digest: str | None = None) -> DataFrame:
    """Counts of an unprocessed corpus, one row per `keys` (one in all without).

    `records` are all rows, `slice_rows` those in one of `languages` (any case), `safe` and
    `vulnerable` the slice by its label as it stands; `unique_hashes` the distinct stripped texts
    of slice rows with code and label, `duplicates` the others of these. A null language is in no
    slice. Rows that are not compared are one row per task in the shuffle. `digest` names a column
    that holds the texts' hashes (null for a null text) in place of `code`: where labels are joined
    to the texts, hash before, so that no text is moved.
    """
    inside = F.coalesce(F.lower(language).isin([name.lower() for name in languages]), F.lit(False))
    hashed = F.col(digest) if digest else text.sha256_stripped(F.col(code))
    whole = inside & F.col(digest or code).isNotNull() & F.col(safety).isNotNull()
    per_hash = df.groupBy(*keys, F.when(whole, hashed).alias("_h")).agg(
        F.count("*").alias("_records"), F.count_if(inside).alias("_slice"),
        F.count_if(inside & (F.col(safety) == "safe")).alias("_safe"),
        F.count_if(inside & (F.col(safety) == "vulnerable")).alias("_vulnerable"),
        F.count_if(whole).alias("_whole"))
    total = {"records": "_records", "slice_rows": "_slice", "safe": "_safe", "vulnerable": "_vulnerable"}
    return per_hash.groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in total.items()],
        F.count("_h").alias("unique_hashes"),
        (F.coalesce(F.sum("_whole"), F.lit(0)) - F.count("_h")).alias("duplicates"))


def audit_sketches(df: DataFrame, keys: Sequence[str], languages: Sequence[str] = ("py", "python"),
                   code: str = "code", language: str = "language", safety: str = "safety",
                   log_size: int = 14) -> DataFrame:
    """Exact counts and a theta sketch of the distinct texts per `keys` (a day, a source), to be stored.

    Up to 2^log_size distinct texts a sketch is exact; beyond that its standard error is
    1 / sqrt(2^log_size), 0.8% as given, and it takes at most 8 * 2^log_size bytes. Nothing but
    the partial sketches is shuffled. See `merge_audits` and `audit_overlap`.
    """
    inside = F.coalesce(F.lower(language).isin([name.lower() for name in languages]), F.lit(False))
    whole = inside & F.col(code).isNotNull() & F.col(safety).isNotNull()
    return df.groupBy(*keys).agg(
        F.count("*").alias("records"), F.count_if(inside).alias("slice_rows"),
        F.count_if(inside & (F.col(safety) == "safe")).alias("safe"),
        F.count_if(inside & (F.col(safety) == "vulnerable")).alias("vulnerable"),
        F.count_if(whole).alias("complete"),
        F.theta_sketch_agg(F.when(whole, text.sha256_stripped(F.col(code))), log_size).alias("texts"))


def merge_audits(stored: DataFrame, keys: Sequence[str] = (), log_size: int = 14) -> DataFrame:
    """Stored audits added up per coarser `keys`, distinct texts and duplicates estimated; no text is read."""
    counts = ["records", "slice_rows", "safe", "vulnerable", "complete"]
    merged = stored.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts],
                                       F.theta_union_agg("texts", log_size).alias("texts"))
    return merged.withColumn("unique_estimate", F.theta_sketch_estimate("texts")).withColumn(
        "duplicates_estimate", F.greatest(F.col("complete") - F.col("unique_estimate"), F.lit(0)))


def audit_overlap(stored: DataFrame, key: str, first, second, log_size: int = 14) -> DataFrame:
    """Estimated distinct texts of two values of `key`, of both together, and in common."""
    sides = merge_audits(stored.where(F.col(key).isin(first, second)), [key], log_size)
    pair = sides.agg(F.first(F.when(F.col(key) == F.lit(first), F.col("texts")), ignorenulls=True).alias("_a"),
                     F.first(F.when(F.col(key) == F.lit(second), F.col("texts")), ignorenulls=True).alias("_b"))
    return pair.select(
        F.theta_sketch_estimate("_a").alias("first_texts"), F.theta_sketch_estimate("_b").alias("second_texts"),
        F.theta_sketch_estimate(F.theta_union("_a", "_b", log_size)).alias("all_texts"),
        F.theta_sketch_estimate(F.theta_intersection("_a", "_b")).alias("common_texts"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def class_weight(df: DataFrame, factor: float = 1.2) -> DataFrame:
    """Safe over vulnerable rows, and the factor used in the loss."""
    counted = df.agg(F.count_if(F.col("label") == 1).alias("n_vulnerable"),
                     F.count_if(F.col("label") == 0).alias("n_safe"))
    weight = F.try_divide(F.col("n_safe"), F.col("n_vulnerable"))
    return counted.withColumn("pos_weight", F.bround(weight, 6)).withColumn(
        "loss_weight", F.bround(weight * factor, 6))
