"""Small table operators of the dataset loaders: target selection, keys,
corrections, split selection, audits, lookups, label encodings and
positional joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import global_row_index

# The 26 movie-clip emotion categories (multi-hot order).
MOVIE_CLASSES = [
    "Affection", "Anger", "Annoyance", "Anticipation", "Aversion", "Confidence", "Disapproval",
    "Disconnection", "Disquietment", "Doubt/Conf", "Embarrassment", "Engagement", "Esteem", "Excitement",
    "Fatigue", "Fear", "Happiness", "Pain", "Peace", "Pleasure", "Sadness", "Sensitivity", "Suffering",
    "Surprise", "Sympathy", "Yearning",
]


def select_target(df: DataFrame, mode: str, targets: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """Keep the key columns and the target columns of ``mode``; unknown modes raise (PRJ-01)."""
    if mode not in targets:
        raise ValueError(f"unknown target mode {mode!r}; expected one of {sorted(targets)}")
    return df.select(*keep, *targets[mode])


def clip_key(dialogue: Column, utterance: Column) -> Column:
    """``dia{d}_utt{u}`` (PRJ-02)."""
    return F.format_string("dia%d_utt%d", dialogue, utterance)


def apply_corrections(df: DataFrame, drops: DataFrame | None, patches: DataFrame | None, keys: list[str],
                      patch_col: str | None = None) -> DataFrame:
    """Remove known-bad rows and patch values, keyed by natural ids (FLT-08).
    A correction that matches no row is an error (the identity assertion)."""
    out = df
    if drops is not None:
        unmatched = drops.join(df.select(*keys), keys, "left_anti")
        if unmatched.limit(1).count():
            raise ValueError("a drop correction matches no row")
        out = out.join(drops.select(*keys), keys, "left_anti")
    if patches is not None and patch_col:
        unmatched = patches.join(df.select(*keys), keys, "left_anti")
        if unmatched.limit(1).count():
            raise ValueError("a patch correction matches no row")
        p = patches.select(*keys, F.col(patch_col).alias("_patch"))
        out = out.join(p, keys, "left").withColumn(patch_col, F.coalesce("_patch", F.col(patch_col))) \
            .drop("_patch")
    return out


def select_split(df: DataFrame, splits: DataFrame, key: str, split: str) -> DataFrame:
    """Rows whose key is listed for the split (``train+val`` and ``all`` combine lists) (FLT-09)."""
    if split == "all":
        wanted = splits
    elif "+" in split:
        wanted = splits.where(F.col("split").isin(split.split("+")))
    else:
        wanted = splits.where(F.col("split") == split)
    return df.join(wanted.select(F.col("key").alias(key)).distinct(), key, "left_semi")


def audit_nulls(df: DataFrame, group: str, cols: list[str]) -> DataFrame:
    """Null count per group and column (FLT-10)."""
    return df.groupBy(group).agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols])


def audit_clips(clips: DataFrame, totals: DataFrame, movie: str, length: int = 8, max_label: int = 7) -> DataFrame:
    """Clip bounds audit (FLT-11): clips whose length, label position or end
    does not fit; an empty result means every clip is sound."""
    j = clips.join(totals, movie)   # one row per movie
    bad = ((F.col("end_frame") - F.col("start_frame") != length) | (F.col("label_frame") < 0)
           | (F.col("label_frame") > max_label) | (F.col("end_frame") > F.col("total")))
    return j.where(bad)


def min_frames(clips: DataFrame, first: str, last: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Clips with at least ``k`` frames, and the count of dropped clips (FLT-18)."""
    n = F.col(last) - F.col(first) + 1
    return clips.where(n >= k), clips.where(n < k).agg(F.count(F.lit(1)).alias("n_dropped"))


def annotated_only(images: DataFrame, labels: DataFrame, image_path: str, label_path: Column) -> DataFrame:
    """Images that have a label file (FLT-19)."""
    im = images.withColumn("_lp", label_path)
    return im.join(labels.select(F.col("file").alias("_lp")).distinct(), "_lp", "left_semi").drop("_lp")


def subset_language(df: DataFrame, lang_col: str, lang: str, title: str, description: str) -> DataFrame:
    """Rows in one language with a title or a description (FLT-20)."""
    has_text = (F.length(F.trim(F.coalesce(F.col(title), F.lit("")))) > 0) | \
               (F.length(F.trim(F.coalesce(F.col(description), F.lit("")))) > 0)
    return df.where((F.col(lang_col) == lang) & has_text)


def subset_geo(df: DataFrame, countries: DataFrame, key: str) -> DataFrame:
    """Rows whose coordinate key maps to a country (FLT-20)."""
    return df.join(countries, key, "inner")


def attach_boxes(frames: DataFrame, boxes: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """Frame -> box list: strict lookups must hit (error at run time),
    otherwise a missing frame gets an empty list (JN-05)."""
    j = frames.join(boxes.select(*keys, F.col("boxes").alias("_b")), keys, "left")
    missing = F.raise_error(F.lit("no boxes for a frame")).cast("array<array<double>>") if strict \
        else F.array().cast("array<array<double>>")
    return j.withColumn("boxes", F.when(F.col("_b").isNull(), missing).otherwise(F.col("_b"))).drop("_b")


def positional_join(left: DataFrame, right: DataFrame, order_left: list[str], order_right: list[str],
                    unmatched: str = "raise") -> DataFrame:
    """Join two tables by row position (JN-06, JN-15): each side gets a dense
    index (``sequence.global_row_index``: range partitions, per-partition
    counts, local positions), then an equi-join on it.  Rows of a longer side
    are an error at run time, or with ``unmatched="null"`` returned with nulls
    for the other side, or with ``unmatched="drop"`` left out."""
    if unmatched not in ("raise", "null", "drop"):
        raise ValueError(f"unmatched is raise, null or drop, not {unmatched}")
    a = global_row_index(left, order_left, "row_idx")
    b = global_row_index(right, order_right, "row_idx")
    if unmatched == "drop":
        return a.join(b, "row_idx")
    j = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), "row_idx", "full")
    if unmatched == "raise":
        miss = F.raise_error(F.concat(F.lit("no row on the other side at position "), F.col("row_idx").cast("string"))).cast("boolean")
        j = j.where(F.when(F.col("_a").isNull() | F.col("_b").isNull(), miss).otherwise(F.lit(True)))
    return j.drop("_a", "_b")


def label_index(df: DataFrame, label: str, classes: DataFrame, name: str = "name", idx: str = "class_id") -> DataFrame:
    """Label name -> index through a small class table; an unknown name is an error (SC-27)."""
    j = df.join(classes.select(F.col(name).alias(label), F.col(idx).alias("_i")), label, "left")
    unknown = F.raise_error(F.concat(F.lit("unknown label "), F.coalesce(F.col(label).cast("string"), F.lit("null")))).cast("boolean")
    return j.where(F.when(F.col("_i").isNull(), unknown).otherwise(F.lit(True))).withColumn(idx, F.col("_i")).drop("_i")


def multi_hot(names: Column, classes: list[str] = MOVIE_CLASSES) -> Column:
    """Names -> multi-hot array in class order (SC-28)."""
    return F.transform(F.array(*[F.lit(c) for c in classes]), lambda c: F.array_contains(names, c).cast("double"))


def nearest_category(words: DataFrame, word_map: DataFrame, word: str = "word") -> DataFrame:
    """Word -> category through a (category, words array) map table (SC-28)."""
    flat = word_map.select(F.col("category"), F.explode("words").alias(word))
    return words.join(flat, word, "left")


def label_score(scores: Column, label: str = "neutral") -> Column:
    """Score of one label out of an array of (label, score) (SC-30)."""
    return F.try_element_at(F.filter(scores, lambda s: s["label"] == label), F.lit(1))["score"]


def repeat_item(item: Column, k: int) -> Column:
    """One item as a clip of k copies (SC-32)."""
    return F.array_repeat(item, k)


def single_class(labels: Column) -> Column:
    """All classes collapsed to 0 for label rows ``[cls, ...]`` (SC-33)."""
    return F.transform(labels, lambda r: F.concat(F.array(F.lit(0.0)), F.slice(r, 2, F.size(r))))


def oriented_size(w: Column, h: Column, orientation: Column) -> Column:
    """Width and height swapped for EXIF orientation 6 or 8 (SC-34)."""
    swap = orientation.isin(6, 8)
    return F.struct(F.when(swap, h).otherwise(w).alias("w"), F.when(swap, w).otherwise(h).alias("h"))


def union_ids(*dfs: DataFrame, col: str) -> DataFrame:
    """Union of id sets (SET-01)."""
    out = None
    for d in dfs:
        out = d.select(col) if out is None else out.unionByName(d.select(col))
    return out.distinct()


def intersection_size(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """|A ∩ B| (SET-02)."""
    return a.select(col).intersect(b.select(col)).agg(F.count(F.lit(1)).alias("n"))


def is_subset(a: DataFrame, b: DataFrame, col: str) -> bool:
    """A ⊆ B (SET-03): no element of A is missing from B (bounded probe)."""
    return a.select(col).join(b.select(col), col, "left_anti").limit(1).count() == 0


def concat_tables(*dfs: DataFrame) -> DataFrame:
    """Concatenate splits keeping duplicates (SET-04)."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def dedupe_keep_first(arr: Column) -> Column:
    """Order-preserving dedupe of an array (SET-06)."""
    return F.array_distinct(arr)


def has_duplicate_rows(rows: Column) -> Column:
    """Any duplicate row inside one array of rows (SET-07)."""
    return F.size(F.array_distinct(rows)) != F.size(rows)
