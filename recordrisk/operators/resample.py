"""Splits, folds, class weights, upsampling and SMOTE, all decided by hashes of keys."""

from pyspark.sql import DataFrame, Window as W, functions as F

from recordrisk.functions.columns import HASH_BITS, hash60, zero_filled
from recordrisk.operators.neighbours import nearest_in_class
from recordrisk.operators.ordering import BUCKET_BITS, class_index, counter_rows
from recordrisk.workspace import durable, lookup

SEED = 42


def random_split(df: DataFrame, key, test_pct=20, seed=SEED, out="is_test") -> DataFrame:
    """Marks about ``test_pct`` percent of the rows, by a hash of the key: a pure map."""
    limit = (1 << HASH_BITS) * test_pct // 100
    return df.withColumn(out, F.when(hash60(seed, F.col(key)) < limit, 1).otherwise(0))


def class_counts(df: DataFrame, label) -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def test_quotas(counts: DataFrame, label, test_pct=20) -> DataFrame:
    """Test rows per class: whole shares, the remainder to the largest fractions.

    The total is rounded up and everything is whole-number arithmetic. One row per class.
    """
    total = counts.agg(F.sum("n").alias("n"))
    n = total.scalar()
    wanted = F.floor((n * test_pct + 99) / 100).cast("long")
    share = F.col("n").cast("decimal(38,0)") * wanted
    parts = counts.select(
        label, "n", wanted.alias("_wanted"),
        F.floor(share / n.cast("decimal(38,0)")).cast("long").alias("_whole"),
        F.pmod(share, n.cast("decimal(38,0)")).alias("_rest"))
    everything = W.partitionBy()
    place = F.row_number().over(W.orderBy(F.desc("_rest"), label))
    spare = F.col("_wanted") - F.sum("_whole").over(everything)
    return parts.select(label, "n", (F.col("_whole") + F.when(place <= spare, 1).otherwise(0)).alias("quota"))


def stratified_split(df: DataFrame, key, label, test_pct=20, seed=SEED, out="is_test") -> DataFrame:
    """Marks exactly the quota of every class: its rows with the smallest hashes.

    Rows are counted per class and leading hash bits. The counts name the one bucket per
    class in which the quota ends; only that bucket is sorted, to find the last test row.
    Marking the table is then a comparison with one threshold per class, without a shuffle. Rows that share a key share
    a side; if a quota would end among them, the split is an error. A missing key counts as an empty text.
    """
    df = df.where(F.col(label).isNotNull())
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    quotas = test_quotas(class_counts(df, label), label, test_pct).where("quota > 0").select(label, "quota")
    hashed = df.select(text.alias("_key"), label, hash60(seed, text).alias("_hash"))
    hashed = hashed.withColumn("_bucket", F.shiftright("_hash", HASH_BITS - BUCKET_BITS).cast("int"))
    buckets = hashed.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(label).orderBy("_bucket"))
    last = (
        buckets.withColumn("_upto", upto).join(quotas, label)
        .where((F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("_n") < F.col("quota")))
        .select(label, "_bucket", (F.col("quota") - F.col("_upto") + F.col("_n")).alias("_left"))
    )
    # a key once, however many rows have it, so a hot key is no long window
    inside = lookup(hashed, last, [label, "_bucket"], "inner").groupBy(label, "_hash", "_key", "_left").agg(F.count(F.lit(1)).alias("_n"))
    place = F.sum("_n").over(W.partitionBy(label).orderBy("_hash", "_key"))
    ends = (
        inside.withColumn("_place", place)
        .where((F.col("_place") >= F.col("_left")) & (F.col("_place") - F.col("_n") < F.col("_left")))
        .select(label, F.col("_hash").alias("_last_hash"), F.col("_key").alias("_last_key"), (F.col("_place") > F.col("_left")).alias("_torn"))
    )
    ends = durable(ends)
    for row in ends.where("_torn").limit(1).collect():
        raise ValueError(f"class {row[label]}: the key {row['_last_key']!r} is repeated, so its quota cannot be met exactly")
    h = hash60(seed, text)
    inside = (h < F.col("_last_hash")) | ((h == F.col("_last_hash")) & (text <= F.col("_last_key")))
    marked = lookup(df, ends, label).withColumn(out, F.when(inside, 1).otherwise(0))
    return marked.select(*df.columns, out)


def stratified_folds(df: DataFrame, key, label, k=5, seed=SEED, out="fold") -> DataFrame:
    """Fold number 0..k-1 with every class spread evenly over the folds."""
    indexed = class_index(df.where(F.col(label).isNotNull()), key, label, seed, "_idx")
    return indexed.withColumn(out, (F.col("_idx") % k).cast("int")).select(*df.columns, out)


def union_all(*dfs: DataFrame) -> DataFrame:
    """Tables stacked by column name."""
    first, *rest = dfs
    for df in rest:
        first = first.unionByName(df)
    return first


def upsample_with_replacement(df: DataFrame, key, label, majority=None, seed=SEED) -> DataFrame:
    """Every other class drawn with replacement to the size of the majority class.

    ``majority`` names the class that is kept as it is; the largest one by default. The
    result has a ``draw`` column: the number of the draw, or NULL for the kept class.
    """
    df = df.where(F.col(label).isNotNull())
    counts = class_counts(df, label)
    if majority is None:
        majority = counts.orderBy(F.desc("n"), label).limit(1).select(label).scalar()
    else:
        majority = F.lit(majority)
    size = counts.where(F.col(label) == majority).select("n").scalar()
    minority = F.col(label) != majority
    plan = counts.where(minority).select(label, F.col("n").alias("_m"), size.alias("_want"))
    draws = counter_rows(plan, "_want", "draw").select(
        label, "draw", F.pmod(hash60(seed, F.col(label), F.col("draw")), F.col("_m")).alias("_idx"))
    indexed = class_index(df.where(minority), key, label, seed, "_idx")
    drawn = draws.join(indexed, [label, "_idx"])
    kept = df.where(F.col(label) == majority).withColumn("draw", F.lit(None).cast("long"))
    return kept.unionByName(drawn.select(*df.columns, "draw"))


def smote(df: DataFrame, key, label, features, k=5, seed=SEED, integer_cols=(), scale=False, shrink_k=False, cells=None) -> DataFrame:
    """Synthetic rows until every class is as large as the largest.

    A draw picks a row of the class, one of its ``k`` nearest rows of the same class, and a
    point on the line between them. Only rows that are drawn are searched for neighbours.
    Features are compared as they are unless ``scale`` is set; ``integer_cols`` are cut to
    whole numbers and missing values count as zero. Returns key (NULL for synthetic rows), label, features and ``draw``.
    A class of fewer than two rows is an error, and one of ``k`` rows or fewer too unless ``shrink_k``
    allows all its others as neighbours. The largest class needs none. With ``cells`` neighbours come from a cell index.
    """
    features = list(features)
    rows = df.where(F.col(label).isNotNull()).select(key, label, *[zero_filled(c).alias(c) for c in features])
    rows = durable(rows)
    counts = class_counts(rows, label)
    for row in counts.where(F.col("n") <= (1 if shrink_k else k)).where(F.col("n") < counts.agg(F.max("n")).scalar()).orderBy("n").limit(1).collect():
        raise ValueError(f"class {row[label]} has {row['n']} rows, too few for {k} neighbours")
    synthetic = smote_rows(rows, key, label, features, k, seed, integer_cols, scale, cells)
    original = rows.withColumn("draw", F.lit(None).cast("long"))
    return original.unionByName(synthetic.withColumn(key, F.lit(None).cast(rows.schema[key].dataType)).select(
        key, label, *features, "draw"))


def smote_draws(rows: DataFrame, key, label, k=5, seed=SEED) -> DataFrame:
    """Per draw: the class, the base row's key, the neighbour's rank and the position u."""
    counts = class_counts(rows, label)
    largest = counts.agg(F.max("n").alias("m")).scalar()
    plan = counts.where("n > 1").select(
        label, F.col("n").alias("_m"), F.least(F.lit(k), F.col("n") - 1).alias("_k"),
        (largest - F.col("n")).alias("_want"))
    pick = F.pmod(hash60(seed, F.col(label), F.col("draw")), F.col("_m") * F.col("_k"))
    draws = counter_rows(plan, "_want", "draw").select(
        label, "draw", F.floor(pick / F.col("_k")).cast("long").alias("_idx"),
        (pick % F.col("_k") + 1).cast("int").alias("rank"),
        (hash60(f"{seed}:u", F.col(label), F.col("draw")) / float(1 << HASH_BITS)).alias("u"))
    indexed = class_index(rows.select(key, label), key, label, seed, "_idx")
    return draws.join(indexed, [label, "_idx"]).select(label, "draw", key, "rank", "u")


def smote_rows(rows: DataFrame, key, label, features, k, seed, integer_cols=(), scale=False, cells=None) -> DataFrame:
    """The synthetic rows alone, with the keys of both parents."""
    draws = durable(smote_draws(rows, key, label, k, seed))
    pairs = nearest_in_class(rows, draws.select(label, key).distinct(), key, label, features, k, scale, cells=cells)
    parents = draws.join(pairs, [label, key, "rank"])
    position = {c: i for i, c in enumerate(features)}

    def between(c):
        start, end = F.col("features")[position[c]], F.col("neighbour_features")[position[c]]
        value = start + F.col("u") * (end - start)
        whole = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("double")
        return whole if c in integer_cols else value

    return parents.select(
        F.col(key).alias("base"), "neighbour", "u", label, "draw", *[between(c).alias(c) for c in features])


def balanced_weights(df: DataFrame, label, out="weight") -> DataFrame:
    """Weight n / (classes * class rows), so that every class weighs the same."""
    counts = class_counts(df, label)
    n, classes = counts.agg(F.sum("n")).scalar(), counts.agg(F.count(F.lit(1))).scalar()
    weights = counts.select(label, (n.cast("double") / (classes * F.col("n"))).alias(out))
    return lookup(df, weights, label).select(*[c for c in df.columns if c != out], out)


def positive_weight(df: DataFrame, label, positive=1, negative=0) -> DataFrame:
    """Class sizes and negatives per positive as one row."""
    sizes = df.agg(
        F.count_if(F.col(label) == negative).alias("negatives"),
        F.count_if(F.col(label) == positive).alias("positives"))
    return sizes.withColumn("scale_pos_weight", F.try_divide("negatives", "positives"))


def split_report(df: DataFrame, split, label) -> DataFrame:
    """Rows per split and class."""
    return df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))
