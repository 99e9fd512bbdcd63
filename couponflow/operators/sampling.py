"""Reproducible splits by a hash of the row id: no global sort, no state, one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from couponflow.operators.spread import HotKeys, matching
from couponflow.session import stage

#: Hex digits of the hash that name a bucket of :func:`stratified_folds`: 16 ** 6 buckets a class, whatever
#: the table, so a row's fold depends on the rows that share its bucket and on nothing else.
HASH_DIGITS = 6
#: Rows with the same leading hash digits that are looked at one by one in :func:`exact_sample`.
SMALL_BUCKET = 100_000


def hash_fraction(seed: int | str, row_id: str = "row_id") -> Column:
    """Uniform number in [0, 1) from the first 32 bits of an MD5."""
    return F.conv(F.substring(_hash(seed, row_id), 1, 8), 16, 10).cast("double") / (2.0**32)


def split_train_test(
    rows: DataFrame, test_share: float = 0.25, train_share: float = 1.0, seed: int = 0
) -> DataFrame:
    """Add ``part``: ``test``, ``train`` (a share of the other rows) or ``rest``.

    Both parts depend on the row alone, so they never overlap.
    """
    part = (
        F.when(hash_fraction(seed) < test_share, "test")
        .when(hash_fraction(f"{seed}-train") < train_share, "train")
        .otherwise("rest")
    )
    return rows.withColumn("part", part)


def split_exact(
    rows: DataFrame, train_rows: int | None, test_share: float = 0.25, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Exactly ``train_rows`` training rows (all others, if ``None`` or too few) and the share kept for testing."""
    is_test = hash_fraction(seed) < test_share
    others = rows.where(~is_test)
    train = others if train_rows is None else exact_sample(others, train_rows, f"{seed}-train")
    return train, rows.where(is_test)


def exact_sample(
    rows: DataFrame, wanted: int, seed: int | str = 0, row_id: str = "row_id", small: int = SMALL_BUCKET
) -> DataFrame:
    """Exactly ``wanted`` rows (all, if there are no more): those with the smallest hashes, equal hashes by id.

    ``rows`` should be a written table: it is read once for each four digits that it takes to find the last row's hash (a
    histogram of at most 65,536 numbers each time, until at most ``small`` rows are left), once for that row, and once
    for the result. Nothing is sorted as a whole and nothing is counted beforehand.
    """
    hashed = rows.withColumn("_hash", _hash(f"{seed}-sample", row_id))
    prefix, missing, left = "", wanted, None
    if wanted <= 0:
        return rows.limit(0)
    while left is None or (left > small and len(prefix) < 32):
        bucket = F.substring("_hash", len(prefix) + 1, 4)
        counts = hashed.where(F.col("_hash").startswith(prefix)).groupBy(bucket.alias("bucket")).count()
        earlier = F.sum("count").over(Window.orderBy("bucket"))
        found = counts.withColumn("upto", earlier).where(F.col("upto") >= missing).orderBy("bucket").first()
        if found is None:
            return rows
        prefix, missing, left = prefix + found["bucket"], missing - (found["upto"] - found["count"]), found["count"]
    keys = hashed.where(F.col("_hash").startswith(prefix)).groupBy("_hash", F.col(row_id).alias("_id")).count()
    upto = F.sum("count").over(Window.orderBy("_hash", "_id"))
    last = keys.withColumn("upto", upto).where(F.col("upto") >= missing).orderBy("_hash", "_id").first()
    hash_, id_ = F.col("_hash"), F.col(row_id)
    same = (hash_ == last["_hash"]) & (id_ == last["_id"])
    below = (hash_ < last["_hash"]) | ((hash_ == last["_hash"]) & (id_ < last["_id"]))
    copies = last["count"] - (last["upto"] - missing)
    if copies == last["count"]:
        return hashed.where(below | same).drop("_hash")
    # Only some of the rows with the last id.
    return hashed.where(below).unionByName(hashed.where(same).limit(copies)).drop("_hash")


def stratified_folds(rows: DataFrame, k: int, seed: int = 0, digits: int = HASH_DIGITS) -> DataFrame:
    """Add ``split`` 0..k-1 with equal class shares.

    Rows of a class are dealt out in hash order inside 16 ** digits hash buckets, so every sort stays
    small. A bucket starts at its own number, which keeps the class shares equal.
    """
    hashed = rows.withColumn("_hash", _hash(seed, "row_id"))
    bucket = F.substring("_hash", 1, digits)
    order = Window.partitionBy("label", bucket).orderBy("_hash", "row_id")
    offset = F.conv(bucket, 16, 10).cast("bigint")
    dealt = ((F.row_number().over(order) + offset) % k).cast("int")
    return hashed.withColumn("split", dealt).drop("_hash")


def bagging_split(rows: DataFrame, bag: int, test_share: float = 0.33) -> DataFrame:
    """Add ``is_test`` for one bag; the bag number is the seed."""
    return rows.withColumn("is_test", hash_fraction(f"bag-{bag}") < test_share)


def undersample(rows: DataFrame, others: int, key: str = "user_id", seed: int = 0) -> DataFrame:
    """All rows of users that have a positive, and exactly ``others`` rows of the other users. Reads ``rows`` several times."""
    with_positive = rows.where(F.col("label") == 1).select(key).distinct()
    hot = HotKeys(rows).of([key])
    kept = matching(rows, with_positive, [key], hot)
    rest = stage(matching(rows, with_positive, [key], hot, keep=False), "without-positive")
    return kept.unionByName(exact_sample(rest, others, seed))


def _hash(seed: int | str, row_id: str) -> Column:
    return F.md5(F.concat(F.col(row_id), F.lit(f"/{seed}")))
