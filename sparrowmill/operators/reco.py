"""Preparing interactions, baselines, ranking metrics and exploration for implicit feedback."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cosine
from ..plans import cut, global_row_number


def kcore(df: DataFrame, user: str, item: str, k_user: int, k_item: int, rounds: int = 100) -> DataFrame:
    """Drop users, then items, with too few rows, until nothing changes.  Rows count before de-duplication."""
    n = df.count()
    for _ in range(rounds):
        for key, k in ((user, k_user), (item, k_item)):
            df = df.join(df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= k).select(key), key, "left_semi")
        df = cut(df)
        m = df.count()
        if m == n:
            return df
        n = m
    raise RuntimeError(f"rows still go after {rounds} rounds")


def encode(df: DataFrame, key: str, to: str) -> DataFrame:
    """key, to: the distinct keys numbered from 0 in their order, without a single-partition window."""
    return global_row_number(df.select(key).where(F.col(key).isNotNull()).distinct(), key, to=to).withColumn(to, F.col(to) - 1)


def map_ids(df: DataFrame, **maps: DataFrame) -> DataFrame:
    """`df` with `<key>_idx` for each key given with its map (key, idx) from `encode`; rows whose key has no index go."""
    for key, ids in maps.items():
        df = df.join(ids.select(key, F.col([c for c in ids.columns if c != key][0]).alias(f"{key}_idx")), key)
    return df


def binarize(df: DataFrame, rating: str | None = None, least: float | None = None) -> DataFrame:
    """`df` with value 1.0 for each interaction; with a rating, only those of at least `least`."""
    kept = df if rating is None or least is None else df.where(F.col(rating) >= least)
    return kept.withColumn("value", F.lit(1.0))


def explain_user(train: DataFrame, recs: DataFrame, titles: DataFrame, user: str, item: str, who, n: int = 10) -> DataFrame:
    """kind (seen, recommended), place, item, title, score: what a user has seen, by item, and their first `n` recommendations."""
    seen = train.where(F.col(user) == who).select(item).distinct()
    seen = seen.select(F.lit("seen").alias("kind"), F.row_number().over(Window.orderBy(item)).cast("bigint").alias("place"), item, F.lit(None).cast("double").alias("score"))  # one user's rows
    mine = recs.where((F.col(user) == who) & (F.col("rank") <= n)).select(F.lit("recommended").alias("kind"), F.col("rank").cast("bigint").alias("place"), item, F.col("score").cast("double").alias("score"))
    named = seen.unionByName(mine).join(titles.select(item, "title"), item, "left")
    return named.select("kind", "place", item, F.coalesce("title", F.concat(F.lit("Item "), F.col(item).cast("string"))).alias("title"), "score")


def first_per_pair(df: DataFrame, user: str = "user_id", item: str = "item_id", ts: str = "ts") -> DataFrame:
    """The earliest interaction of each user and item; a plain aggregate does it, partly before the shuffle."""
    return df.groupBy(user, item).agg(F.min(ts).alias(ts))


def split_last(df: DataFrame, user: str, *order: str, val: float = 0.1, test: float = 0.1) -> DataFrame:
    """`df` with split: of each user's rows in order the last go to test, those before to val; fewer than 3 all train."""
    w = Window.partitionBy(user)
    pos, n = F.row_number().over(w.orderBy(*order)), F.count("*").over(w)
    part = lambda share: F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("_n")))
    kind = (F.when(F.col("_n") < 3, "train").when(F.col("_pos") > F.col("_n") - part(test), "test")
            .when(F.col("_pos") > F.col("_n") - part(test) - part(val), "val").otherwise("train"))
    return df.withColumns({"_pos": pos, "_n": n}).withColumn("split", kind).drop("_pos", "_n")


def leaks(split: DataFrame, user: str, item: str) -> DataFrame:
    """pair, n: (user, item) pairs that two splits share; all are 0 in a sound split."""
    per = split.groupBy(user, item).agg(F.collect_set("split").alias("s"))
    cols = [F.sum(F.when(F.array_contains("s", a) & F.array_contains("s", b), 1).otherwise(0)).cast("bigint").alias(f"{a}_{b}") for a, b in (("train", "val"), ("train", "test"), ("val", "test"))]
    return per.agg(*cols)


#: Items up to this many are broadcast with their places.
HEAD = 1_000_000


def popularity(train: DataFrame, user: str, item: str, n: int) -> DataFrame:
    """user, item, score, rank: each user's n most popular items they haven't seen.

    A user's list lies within the n + (number seen) most popular items, so each user meets as many places of
    the ranking, by an equi-join; the part of the ranking that the longest history needs is broadcast if it is at most `HEAD` items.
    """
    score = train.groupBy(item).agg(F.count("*").cast("double").alias("score"))
    ranked = global_row_number(score, F.col("score").desc(), F.col(item), to="place")
    history = train.groupBy(user).agg(F.count_distinct(item).alias("seen"))
    most = (history.agg(F.max("seen").alias("m")).first()["m"] or 0) + n
    head = ranked.where(F.col("place") <= most)
    cand = history.select(user, F.explode(F.sequence(F.lit(1), F.col("seen") + n)).alias("place")).join(F.broadcast(head) if most <= HEAD else head, "place")
    rest = cand.join(train.select(user, item).distinct(), [user, item], "left_anti")
    rank = F.row_number().over(Window.partitionBy(user).orderBy("place"))
    return rest.withColumn("rank", rank).where(F.col("rank") <= n).select(user, item, "score", F.col("rank").cast("bigint").alias("rank"))


def _prime(least: int) -> int:
    p = max(least, 2)
    while any(p % d == 0 for d in range(2, int(p**0.5) + 1)):
        p += 1
    return p


def random_items(train: DataFrame, user: str, item: str, n: int, seed: int = 42) -> DataFrame:
    """user, item, score 0.0, rank: n unseen items per user, drawn from the whole catalogue.

    A user's draws are a + s, a + 2 s, ... modulo a prime p, the least that isn't under the number of items; a and s come from
    md5(user:seed), so no item comes twice.  Draws that have no item or a seen one are passed over, so
    n + (number seen) + (p - number of items) draws are enough, and nobody meets the whole catalogue.
    """
    items = encode(train, item, "_i")
    m = items.count()
    p = _prime(m)
    hashed = lambda kind: F.conv(F.substring(F.md5(F.concat_ws(":", F.col(user).cast("string"), F.lit(f"{seed}{kind}"))), 1, 12), 16, 10).cast("bigint")
    who = train.groupBy(user).agg(F.count_distinct(item).alias("_seen")).withColumns({"_a": hashed("a") % p, "_s": 1 + hashed("s") % max(p - 1, 1)})
    draws = who.select(user, "_a", "_s", F.explode(F.sequence(F.lit(1), F.least(F.col("_seen") + n + (p - m), F.lit(p)))).alias("_j"))
    drawn = draws.withColumn("_i", (F.col("_a") + F.col("_j") * F.col("_s")) % p).join(items, "_i")
    rest = drawn.join(train.select(user, item).distinct(), [user, item], "left_anti")
    rank = F.row_number().over(Window.partitionBy(user).orderBy("_j"))
    return rest.withColumn("rank", rank).where(F.col("rank") <= n).select(user, item, F.lit(0.0).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def user_metrics(recs: DataFrame, test: DataFrame, user: str, item: str, ks: tuple[int, ...]) -> DataFrame:
    """One row for each user with test items: precision, recall, ndcg, map and hit rate at each k, and the reciprocal rank.

    Gains are binary; precision divides by k even if fewer items were recommended; average precision and the
    ideal gain take min(relevant, k) items; the reciprocal rank looks at the longest list.
    """
    rel = test.select(user, item).distinct()
    n_rel = rel.groupBy(user).agg(F.count("*").alias("_n"))
    top = max(ks)
    hits = recs.where(F.col("rank") <= top).join(rel, [user, item], "left_semi").groupBy(user).agg(F.array_sort(F.collect_list("rank")).alias("_h"))
    j = n_rel.join(hits, user, "left").withColumn("_h", F.coalesce("_h", F.array().cast("array<bigint>")))
    cols = {}
    for k in ks:
        h = F.filter("_h", _upto(k))
        got = F.size(h).cast("double")
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_n").cast("int"), F.lit(k))), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
        cols[f"precision_{k}"] = got / k
        cols[f"recall_{k}"] = got / F.col("_n")
        cols[f"ndcg_{k}"] = F.aggregate(h, F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0)) / ideal
        cols[f"map_{k}"] = F.aggregate(F.transform(h, lambda r, i: (i + 1).cast("double") / r), F.lit(0.0), lambda s, x: s + x) / F.least("_n", F.lit(k))
        cols[f"hr_{k}"] = F.when(got > 0, 1.0).otherwise(0.0)
    cols["mrr"] = F.coalesce(1.0 / F.get("_h", F.lit(0)), F.lit(0.0))
    return j.select(user, *[c.alias(n) for n, c in cols.items()])


def _upto(k: int):
    return lambda r: r <= k


def evaluate(recs: DataFrame, test: DataFrame, user: str, item: str, ks: tuple[int, ...] = (5, 10, 20), sample: int | None = None, seed: int = 42) -> DataFrame:
    """One row of means, rounded to nine digits; `sample` users by the order of a hash, if given."""
    m = user_metrics(recs, test, user, item, ks)
    if sample:
        m = m.orderBy(F.md5(F.concat(F.col(user).cast("string"), F.lit(f":{seed}"))), user).limit(sample)
    return m.agg(F.count("*").cast("bigint").alias("n_users"), *[F.round(F.avg(c), 9).alias(c) for c in m.columns if c != user])


def compare(models: dict[str, DataFrame], test: DataFrame, user: str, item: str, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    return reduce(DataFrame.unionByName, [evaluate(r, test, user, item, ks).withColumn("model", F.lit(n)) for n, r in models.items()])


def similar(vectors: DataFrame, key: str, vector: str, of: int, n: int) -> DataFrame:
    """The n vectors most similar to one; a single row is broadcast."""
    one = vectors.where(F.col(key) == of).select(F.col(vector).alias("_v")).limit(1)
    return (vectors.where(F.col(key) != of).crossJoin(F.broadcast(one)).select(key, F.round(cosine(F.col(vector), F.col("_v")), 6).alias("score"))
            .orderBy(F.col("score").desc(), key).limit(n))


def longtail(train: DataFrame, item: str, share: float = 0.8) -> DataFrame:
    """One row: how many items, the most popular first, make up `share` of the interactions.

    Items are first counted by popularity, so the running sum goes over distinct counts, not over items.
    """
    per = train.groupBy(item).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("k"))
    w = Window.orderBy(F.col("n").desc())
    run = w.rowsBetween(Window.unboundedPreceding, -1)
    c = per.select("n", "k", F.coalesce(F.sum(F.col("n") * F.col("k")).over(run), F.lit(0)).alias("before"), F.coalesce(F.sum("k").over(run), F.lit(0)).alias("items"),
                   F.sum(F.col("n") * F.col("k")).over(Window.partitionBy()).alias("total"), F.sum("k").over(Window.partitionBy()).alias("all_items"))
    ten = round(share * 1000)
    need = F.expr(f"items + cast(ceil(greatest({ten} * total - 1000 * before, 0) / (1000.0 * n)) AS bigint)")
    hit = c.where(F.col("before") * 1000 + F.col("n") * F.col("k") * 1000 >= F.col("total") * ten)
    return hit.agg(F.min(need).alias("items_needed"), F.max("all_items").alias("all_items"), F.max("total").alias("interactions"))


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """bin (1 to bins), n: equal widths between least and greatest value, the last bin closed."""
    lo_hi = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))  # one row
    b = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.floor((F.col(col) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))) + 1, F.lit(bins)))
    return df.crossJoin(F.broadcast(lo_hi)).groupBy(b.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
