"""Recommendations and score fusion as joins and aggregates over users, items and interactions."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexel.operators import knn
from vexel.operators.shared import small_batches, written


def best(scores: DataFrame, k: int, by: str = "user_id", id_col: str = "item_id") -> DataFrame:
    """The k highest scores of each group with rank; scores closer than 1e-9 are equal, and go by id."""
    w = Window.partitionBy(by).orderBy(F.desc(F.round("score", 9)), id_col)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def user_vectors(interactions: DataFrame, items: DataFrame, attribute: str) -> DataFrame:
    """id, vector: how often each user took items of each value of an attribute with few values."""
    values = [r[0] for r in items.select(attribute).where(F.col(attribute).isNotNull()).distinct().orderBy(attribute).limit(10_000).collect()]
    met = interactions if attribute in interactions.columns else interactions.join(items.select("item_id", attribute), "item_id")
    joined = met.where(F.col(attribute).isNotNull()).groupBy(F.col("user_id").alias("id"), attribute).agg(F.count("*").cast("double").alias("n"))
    of = joined.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(attribute, "n"))).alias("m"))
    return of.select("id", F.transform(F.lit(values), lambda v: F.coalesce(F.element_at("m", v), F.lit(0.0))).alias("vector"))


def nearest_users(vectors: DataFrame, k: int = 20, metric: str = "cosine") -> DataFrame:
    """user_id, other, distance: each user's k nearest other users. Exact, block by block; for very many users, search lists instead.

    Users with equal vectors are searched once, and of these the k + 1 smallest ids can be near to anyone.
    """
    w = Window.partitionBy("vector").orderBy("id")
    users = written(vectors.where("vector is not null").select("id", "vector", F.first("id").over(w).alias("own"), F.row_number().over(w).alias("n")))
    rows = users.where("n = 1").select("id", "vector")
    near = knn.search(rows, rows.select(F.col("id").alias("query_id"), F.col("vector").alias("query")), k + 1, metric, many=True)
    members = users.where(F.col("n") <= k + 1).select(F.col("own").alias("__of"), F.col("id").alias("other"))
    met = near.select("query_id", F.col("id").alias("__of"), "distance").join(members, "__of")
    best_of = Window.partitionBy("query_id").orderBy("distance", "other")
    first = met.withColumn("r", F.row_number().over(best_of)).where(F.col("r") <= k + 1)
    lists = first.groupBy(F.col("query_id").alias("own")).agg(F.array_sort(F.collect_list(F.struct("distance", "other"))).alias("near"))
    others = F.slice(F.filter("near", lambda x: x["other"] != F.col("id")), 1, k)
    return written(users.select("id", "own").join(lists, "own").select(F.col("id").alias("user_id"), F.inline(others)).select("user_id", "other", "distance"))


def _best_unseen(scores: DataFrame, taken: DataFrame, k: int) -> DataFrame:
    """The k best items of each user by the sum of their scores (user_id, item_id, score), without those taken; dealt out by user once."""
    marked = scores.withColumn("seen", F.lit(False)).unionByName(taken.select("user_id", "item_id", F.lit(0.0).alias("score"), F.lit(True).alias("seen")))
    summed = marked.repartition("user_id").groupBy("user_id", "item_id").agg(F.sum("score").alias("score"), F.bool_or("seen").alias("seen"))
    return best(summed.where("not seen").drop("seen"), k)


def _by_user(batches: Iterator[pa.RecordBatch], of: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """of(rows) for batches sorted by their first column, so that all rows of a user are in one call."""
    rest = None
    for batch in batches:
        now = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        users = now.column(0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(users[1:] != users[:-1])
        begun = int(starts[-1]) + 1 if len(starts) else 0
        if begun:
            yield of(now.slice(0, begun))
        rest = now.slice(begun)
    if rest is not None and rest.num_rows:
        yield of(rest)


def _dense(users: np.ndarray) -> np.ndarray:
    """Numbers from 0 of sorted users."""
    return np.concatenate([[0], np.cumsum(users[1:] != users[:-1])]) if len(users) else np.zeros(0, np.int64)


def _pair_keys(user: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Numbers that order pairs of a user's number and an item."""
    if items.dtype.kind not in "iu" or not len(items) or (int(user.max()) + 1) * (int(items.max()) - int(items.min()) + 1) >= 1 << 62:
        kinds, items = np.unique(items, return_inverse=True)
        return user * max(1, len(kinds)) + items
    low = int(items.min())
    return user.astype(np.int64) * (int(items.max()) - low + 1) + (items.astype(np.int64) - low)


def _ranked(user: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and ranks of the k best of each user by best()'s order; the pairs are sorted by user and item."""
    by = np.lexsort((-np.round(score, 9), user))
    rank = np.arange(len(by)) - np.searchsorted(user[by], user[by]) + 1
    return by[rank <= k], rank[rank <= k]


def by_users(neighbours: DataFrame, taken: DataFrame, k: int) -> DataFrame:
    """From each user's nearest users (user_id, other, distance): the sum of 1 - distance over those who took an item; items seen go.

    taken: (user_id, item_id). A user's items travel as one list, and the k best of each user are all that is made into rows.
    """
    lists = written(taken.where("user_id is not null").repartition("user_id").select("user_id", "item_id").distinct().groupBy("user_id").agg(F.collect_list("item_id").alias("items")))
    theirs = neighbours.where("user_id is not null").join(lists.withColumnRenamed("user_id", "other"), "other").select("user_id", (1.0 - F.col("distance")).alias("score"), "items")
    dealt = theirs.unionByName(lists.withColumn("score", F.lit(None).cast("double"))).repartition("user_id").sortWithinPartitions("user_id")

    def of(rows: pa.RecordBatch) -> pa.RecordBatch:
        lists = rows.column(2)
        items, row = lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        user = _dense(rows.column(0).to_numpy(zero_copy_only=False))[row]
        score = rows.column(1).to_numpy(zero_copy_only=False)[row]  # not a number: the user's own
        key = _pair_keys(user, items.to_numpy(zero_copy_only=False))
        by = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]])) if len(by) else by
        total = np.add.reduceat(score[by], starts) if len(by) else score
        first = by[starts][~np.isnan(total)]
        total = total[~np.isnan(total)]
        at, rank = _ranked(user[first], total, k)
        return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row[first[at]])), items.take(pa.array(first[at])), pa.array(total[at]), pa.array(rank, pa.int32())], names=["user_id", "item_id", "score", "rank"])

    kinds = [df.schema[c].dataType.simpleString() for df, c in ((neighbours, "user_id"), (taken, "item_id"))]
    return small_batches(dealt).select("user_id", "score", "items").mapInArrow(lambda batches: _by_user(batches, of), f"user_id {kinds[0]}, item_id {kinds[1]}, score double, rank int")


def by_items(similar: DataFrame, taken: DataFrame, k: int) -> DataFrame:
    """From items similar (item_id, other, similarity) to those a user took: the sum of similarities; items seen go."""
    near = similar.select(F.col("item_id").alias("liked"), F.col("other").alias("item_id"), F.col("similarity").alias("score"))
    return _best_unseen(taken.withColumnRenamed("item_id", "liked").join(near, "liked").select("user_id", "item_id", "score"), taken, k)


def profile(interactions: DataFrame, items: DataFrame, strong: float = 1.0, weak: float = 0.5) -> DataFrame:
    """user_id, category, weight: `strong` for each interaction marked strong, else `weak`."""
    joined = interactions if "category" in interactions.columns else interactions.join(items.select("item_id", "category"), "item_id")
    return joined.groupBy("user_id", "category").agg(F.sum(F.when(F.col("strong"), strong).otherwise(weak)).alias("weight"))


def attribute_profile(interactions: DataFrame, items: DataFrame, each: float = 0.3) -> DataFrame:
    """user_id, attribute, weight."""
    long = items.select("item_id", F.explode("attributes").alias("attribute"))
    return interactions.join(long, "item_id").groupBy("user_id", "attribute").agg((F.count("*") * each).alias("weight"))


def price_band(price: Column, low: float, high: float) -> Column:
    """1 within the band, 0.5 within half as much around it, else 0."""
    return F.when(price.between(low, high), 1.0).when(price.between(low * 0.5, high * 1.5), 0.5).otherwise(0.0)


def content_score(category: Column, attribute: Column, price: Column, quality: Column) -> Column:
    """0.4, 0.2, 0.2, 0.2 of four parts, each between 0 and 1; at most 1."""
    return F.least(F.lit(1.0), 0.4 * category + 0.2 * attribute + 0.2 * price + 0.2 * quality)


def shares(profiles: DataFrame) -> DataFrame:
    """user_id, category, share: a category's weight over the user's greatest."""
    return profiles.withColumn("share", F.col("weight") / F.max("weight").over(Window.partitionBy("user_id"))).select("user_id", "category", "share")


def by_content(profiles: DataFrame, items: DataFrame, least: float = 0.5, each: int | None = None) -> DataFrame:
    """user_id, item_id, score of items in a user's categories: the category counts by its share of the user's greatest weight.

    items: item_id, category, attribute, price, quality (three parts between 0 and 1). Within a category the users agree on
    the order of items; with `each` only a category's first so many are scored, which are all that a cut to as many best ones
    can need, so that users don't meet all items of a large category.
    """
    own = content_score(F.lit(0.0), F.col("attribute"), F.col("price"), F.col("quality"))
    first = items.withColumn("own", own)
    score = F.least(F.lit(1.0), 0.4 * F.col("share") + F.col("own"))
    if each is not None:
        w = Window.partitionBy("category").orderBy(F.desc(F.round("own", 9)), "item_id")
        first = first.withColumn("r", F.row_number().over(w)).where(F.col("r") <= each)
    found = shares(profiles).join(first.select("item_id", "category", "own"), "category").select("user_id", "item_id", score.alias("score"))
    return found.where(F.round("score", 9) > least)  # sums in another order don't cross the bound


def fuse(parts: list[tuple[DataFrame, float]], keys: list[str]) -> DataFrame:
    """keys, score: the weighted sum of scores over all parts; a key missing in a part counts 0 there."""
    weighted = [df.select(*keys, (F.col("score") * w).alias("score")) for df, w in parts]
    return reduce(DataFrame.unionByName, weighted).groupBy(*keys).agg(F.sum("score").alias("score"))


def boost_popular(scores: DataFrame, interactions: DataFrame, weight: float = 0.1) -> DataFrame:
    """Adds the weight times an item's share of the greatest number of interactions."""
    counts = interactions.groupBy("item_id").agg(F.count("*").alias("n"))
    top = counts.agg(F.max("n").alias("top"))
    boosted = scores.join(counts, "item_id", "left").crossJoin(F.broadcast(top))
    return boosted.select("user_id", "item_id", (F.col("score") + weight * F.coalesce("n", F.lit(0)) / F.col("top")).alias("score"))


def diversify(scores: DataFrame, items: DataFrame, penalty: float = 0.3) -> DataFrame:
    """Lowers the scores of further items of a category: times 1 - penalty * 0.1 * items of it before, by score."""
    joined = scores.join(items.select("item_id", "category"), "item_id")
    before = F.row_number().over(Window.partitionBy("user_id", "category").orderBy(F.desc("score"), "item_id")) - 1
    return joined.withColumn("before", before).select("user_id", "item_id", (F.col("score") * F.greatest(F.lit(0.0), 1.0 - penalty * F.col("before") * 0.1)).alias("score"))


def first_in_category(items: DataFrame, k: int) -> DataFrame:
    """Of each category the items (category, item_id, own, order) that for some bound on `own` are among its k first above it, by order.

    An item stays if fewer than k of its category come before it with no smaller `own`.
    """
    w = Window.partitionBy("category", "own").orderBy(F.desc("order"), "item_id")
    few = items.where("category is not null and own is not null").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "item_id"], ascending=[False, True], kind="stable")
        best_own: list[float] = []
        stay = []
        for own in rows["own"]:
            stay.append(len(best_own) < k or own > best_own[0])
            if stay[-1]:
                heapq.heappushpop(best_own, own) if len(best_own) == k else heapq.heappush(best_own, own)
        return rows[stay]

    return few.groupBy("category").applyInPandas(keep, few.schema)


def hybrid(near: DataFrame, profiles: DataFrame, items: DataFrame, k: int, mix: tuple[float, float] = (0.6, 0.4), least: float = 0.5, penalty: float = 0.3) -> DataFrame:
    """user_id, rank, item_id, score: the k best by content_score() above `least` and neighbours' scores (user_id, item_id, score), mixed, boosted and diversified.

    items: item_id, category, own (content without the category's share) and boost, which is added. What fuse(), boost_popular()
    and diversify() do over the pairs of users and items is done here a user at a time. Besides the items that neighbours took,
    only a category's k first above the bound can be among the k best, so first_in_category() is all that users meet of the others.
    """
    info = items.select("item_id", "category", "own", "boost")
    band = first_in_category(info.withColumn("order", F.round(F.col("own") + F.col("boost") / mix[0], 9)), k).orderBy("category", F.desc("order"), "item_id").toArrow().combine_chunks()
    kinds = pc.unique(band.column("category")) if band.num_rows else pa.array([], pa.string())
    of_band = pc.index_in(band.column("category"), value_set=kinds).to_numpy() if band.num_rows else np.zeros(0, np.int64)
    own_band, boost_band, items_band = band.column("own").to_numpy(), band.column("boost").to_numpy(), band.column("item_id").combine_chunks()
    met = near.join(info, "item_id").select("user_id", "item_id", "category", "own", "boost", F.col("score").alias("value"))
    none = F.lit(None).cast("double")
    part = shares(profiles).where("category is not null and user_id is not null").select("user_id", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), "category", none.alias("own"), none.alias("boost"), F.col("share").alias("value"))
    dealt = met.unionByName(part).repartition("user_id").sortWithinPartitions("user_id")

    def of(rows: pa.RecordBatch) -> pa.RecordBatch:
        users = _dense(rows.column(0).to_numpy(zero_copy_only=False))
        kind = pc.fill_null(pc.index_in(rows.column(2), value_set=kinds), len(kinds)).to_numpy().astype(np.int64)
        own, boost, value = (rows.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5))
        taken = pc.is_valid(rows.column(1)).to_numpy(zero_copy_only=False)
        n, s = np.flatnonzero(taken), np.flatnonzero(~taken)
        key = users * (len(kinds) + 1) + kind
        s = s[np.argsort(key[s], kind="stable")]
        if len(s):
            at = np.minimum(np.searchsorted(key[s], key[n]), len(s) - 1)
            share = np.where(key[s][at] == key[n], value[s][at], np.nan)
        else:
            share = np.full(len(n), np.nan)
        content = np.minimum(1.0, 0.4 * share + own[n])
        content = np.where(np.round(content, 9) > least, content, 0.0)
        who, what, score, place = [users[n]], [kind[n]], [mix[0] * content + mix[1] * value[n] + boost[n]], [n]
        for c in np.unique(kind[s]):
            mine, those = s[kind[s] == c], np.flatnonzero(of_band == c)
            like = np.minimum(1.0, 0.4 * value[mine][:, None] + own_band[those][None, :])
            good = np.round(like, 9) > least
            i, j = np.nonzero(good & (np.cumsum(good, axis=1) <= k))
            who.append(users[mine[i]])
            what.append(np.full(len(i), c))
            score.append(mix[0] * like[i, j] + boost_band[those[j]])
            place.append(those[j] + len(rows))
        who, what, score, place = (np.concatenate(z) for z in (who, what, score, place))
        item = pa.concat_arrays([rows.column(1), items_band]).take(pa.array(place))
        _, once = np.unique(_pair_keys(who, item.to_numpy(zero_copy_only=False)), return_index=True)  # neighbours' items come first
        who, what, score = who[once], what[once], np.round(score[once], 9)
        by = np.lexsort((-score, what, who))
        group = who[by] * (len(kinds) + 1) + what[by]
        before = np.empty(len(by))
        before[by] = np.arange(len(by)) - np.searchsorted(group, group)
        score = score * np.maximum(0.0, 1.0 - penalty * before * 0.1)
        at, rank = _ranked(who, score, k)
        row = np.searchsorted(users, who[at])
        return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row)), pa.array(rank, pa.int32()), item.take(pa.array(once[at])), pa.array(score[at])], names=["user_id", "rank", "item_id", "score"])

    columns = [profiles.schema["user_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()]
    return small_batches(dealt).mapInArrow(lambda batches: _by_user(batches, of), f"user_id {columns[0]}, rank int, item_id {columns[1]}, score double")


def realtime(scores: DataFrame, context: dict[str, object]) -> DataFrame:
    """Multiplies scores by context: evening hours 1.2 for leisure, mobile 1.1 for small prices, viewed categories 1.3, cart 1.5."""
    s, c = F.col("score"), F.col("category")
    hour = int(context.get("hour", 12))  # type: ignore[call-overload]
    s = s * F.when(F.lit(18 <= hour <= 23) & c.isin(list(context.get("leisure", []))), 1.2).otherwise(1.0)  # type: ignore[call-overload]
    s = s * F.when(F.lit(context.get("device") == "mobile") & (F.col("price") < float(context.get("small", 1000))), 1.1).otherwise(1.0)  # type: ignore[arg-type]
    s = s * F.when(c.isin(list(context.get("viewed", []))), 1.3).otherwise(1.0)  # type: ignore[call-overload]
    s = s * F.when(c.isin(list(context.get("cart", []))), 1.5).otherwise(1.0)  # type: ignore[call-overload]
    return scores.select("user_id", "item_id", s.alias("score"))


def popular(interactions: DataFrame, k: int) -> DataFrame:
    """rank, item_id, n: the most taken items."""
    counts = interactions.groupBy("item_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item_id").limit(k)
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "item_id"))).select("rank", "item_id", "n")


def cold_start(items: DataFrame, categories: list[str], low: float, high: float, brands: list[str]) -> DataFrame:
    """item_id, score: 0.5 for a preferred category, 0.3 for a price in the band, 0.2 for a preferred brand."""
    part = lambda c, x: F.when(c, x).otherwise(0.0)
    return items.select("item_id", (part(F.col("category").isin(categories), 0.5) + part(F.col("price").between(low, high), 0.3) + part(F.col("brand").isin(brands), 0.2)).alias("score"))


def similar_items(items: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """query_id, rank, id, distance, shared: nearest items with the attributes they share."""
    found = knn.search(items.select(F.col("item_id").alias("id"), "vector"), queries.select("query_id", "query"), k, metric)
    own = queries.select("query_id", F.col("attributes").alias("mine"))
    joined = found.join(items.select(F.col("item_id").alias("id"), "attributes"), "id").join(own, "query_id")
    return joined.select("query_id", "rank", "id", "distance", F.array_sort(F.array_intersect("mine", "attributes")).alias("shared"))


def potential_users(profiles: DataFrame, category: str, least: float = 0.6) -> DataFrame:
    """user_id, score: users whose weight of the category, of all their weights, is above the bound."""
    whole = profiles.groupBy("user_id").agg(F.sum("weight").alias("all"), F.sum(F.when(F.col("category") == category, F.col("weight")).otherwise(0.0)).alias("mine"))
    return whole.select("user_id", (F.col("mine") / F.col("all")).alias("score")).where(F.col("score") > least)


def explain(scores: DataFrame) -> DataFrame:
    """A sentence for each recommendation, by its score."""
    how = F.when(F.col("score") >= 0.8, "strongly matches").when(F.col("score") >= 0.5, "matches").otherwise("may suit")
    return scores.withColumn("explanation", F.concat(F.lit("This item "), how, F.lit(" your interests")))


def concat_vectors(a: Column | str, b: Column | str, alpha: float) -> Column:
    """Early fusion: the two vectors side by side, weighted alpha and 1 - alpha."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.concat(F.transform(x.cast("array<double>"), lambda v: v * alpha), F.transform(y.cast("array<double>"), lambda v: v * (1 - alpha)))


def blend_vectors(a: Column | str, b: Column | str, alpha: float) -> Column:
    """Hybrid fusion: alpha * a + (1 - alpha) * b."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda v, w: v * alpha + w * (1 - alpha))
