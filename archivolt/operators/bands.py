"""Visual search by bands: coarse features of views, a band index that is kept and brought up to date, a shortlist by votes, and the
distance of views in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archivolt.operators.ranking import bounded_top
from archivolt.operators.states import overwrite_partitions
from archivolt.storage import materialize

# Fixed values of the search.
METHOD = "quadrants-1"
GRID, BIN_WIDTH = 4, 32
COLOUR_WEIGHT, VOTE_WEIGHT = 0.15, 25.0
HIT_LIMIT, SHORTLIST, SCORE_MULTIPLIER, MOST_SCORED = 50_000, 1000, 8, 5000
#: Targets and paths of a cell of ``likeliest``, and numbers that it lays out at once.
CELL_TARGETS, CELL_PATHS, CELL_HITS = 1024, 4096, 1 << 20

VIEW = "struct<name:string,gray:array<double>,mean_rgb:array<double>>"
FEATURE = "struct<name:string,gray:array<double>,mean_rgb:array<double>,gray_bins:array<int>,colour_bins:array<int>>"


def _side(gray: Column) -> Column:
    return F.round(F.sqrt(F.size(gray)), 0).cast("int")


def coarse_grid(gray: Column, grid: int = GRID) -> Column:
    """Means of grid x grid cells of a square gray image; borders of cells are rounded half to even."""
    side = _side(gray)

    def span(i: Column) -> tuple[Column, Column]:
        start = F.bround(i * side / grid, 0).cast("int")
        return start, F.greatest(start + 1, F.bround((i + 1) * side / grid, 0).cast("int"))

    def cell(k: Column) -> Column:
        (top, bottom), (left, right) = span(F.floor(k / grid)), span(k % grid)
        row = lambda y: F.aggregate(F.slice(gray, y * side + left + 1, right - left), F.lit(0.0), lambda s, x: s + x)
        total = F.aggregate(F.sequence(top, bottom - 1), F.lit(0.0), lambda s, y: s + row(y))
        return total / ((bottom - top) * (right - left))

    return F.transform(F.sequence(F.lit(0), F.lit(grid * grid - 1)), cell)


def descriptor_issue(descriptor: str, width: str, height: str) -> Column:
    """Why a descriptor has no features; empty if it has: sizes missing, no views, an incomplete view, or one that is not square."""
    views = F.col(descriptor)
    whole = lambda v: (F.size(F.coalesce(v["gray"], F.array())) > 0) & (F.size(F.coalesce(v["mean_rgb"], F.array())) == 3)
    square = lambda v: (_side(v["gray"]) * _side(v["gray"]) == F.size(v["gray"])) & (_side(v["gray"]) >= GRID)
    return (
        F.when(F.coalesce(F.col(width), F.lit(0)) <= 0, "dimensions_missing")
        .when(F.coalesce(F.col(height), F.lit(0)) <= 0, "dimensions_missing")
        .when(F.coalesce(F.size(views), F.lit(0)) <= 0, "views_missing")
        .when(~F.forall(views, whole), "view_incomplete")
        .when(~F.forall(views, square), "gray_not_square")
        .otherwise("")
    )


def features(views: Column) -> Column:
    """Coarse features of each view; gray and colours are rounded to three places, bins are taken before."""

    def feature(view: Column) -> Column:
        def made(grid: Column) -> Column:
            rounded = lambda values: F.transform(values, lambda x: F.bround(x, 3))
            bins = lambda values: F.transform(values, lambda x: F.floor(x / BIN_WIDTH).cast("int"))
            return F.struct(
                view["name"].alias("name"),
                rounded(grid).alias("gray"),
                rounded(view["mean_rgb"]).alias("mean_rgb"),
                bins(grid).alias("gray_bins"),
                bins(view["mean_rgb"]).alias("colour_bins"),
            )

        # An array of one value binds the value to a name, so that it is computed once.
        return F.element_at(F.transform(F.array(coarse_grid(view["gray"])), made), 1)

    return F.transform(views, feature)


def orientation(width: Column, height: Column) -> Column:
    return F.when(width == height, "square").when(width > height, "landscape").otherwise("portrait")


def view_bands(feature: Column, width: Column, height: Column) -> Column:
    """Six bands of a view: its colours, its four quadrants, and the orientation with the aspect in tenths."""
    joined = lambda values: F.array_join(F.transform(values, lambda x: x.cast("string")), "-")
    gray = feature["gray_bins"]
    quadrant = lambda top, left: joined(F.concat(*[F.slice(gray, y * GRID + left + 1, 2) for y in (top, top + 1)]))
    aspect = F.bround(width / F.greatest(height, F.lit(1)) * 10, 0).cast("int").cast("string")
    values = {
        "color": joined(feature["colour_bins"]),
        "gray_tl": quadrant(0, 0),
        "gray_tr": quadrant(0, 2),
        "gray_bl": quadrant(2, 0),
        "gray_br": quadrant(2, 2),
        "orientation": F.concat_ws(":", orientation(width, height), aspect),
    }
    return F.array(*[F.struct(F.lit(n).alias("band_name"), v.alias("band_value")) for n, v in values.items()])


def bands_of(featured: DataFrame, key: str) -> DataFrame:
    """(key, view, band_name, band_value), each once, of rows with key, width, height and features."""
    views = featured.select(key, "width", "height", F.explode("features").alias("f"))
    listed = views.select(key, F.col("f.name").alias("view"), F.explode(view_bands(F.col("f"), F.col("width"), F.col("height"))).alias("b"))
    return listed.select(key, "view", "b.band_name", "b.band_value").distinct()


_VERSION = ["byte_size", "mtime_ns", "sha256"]


def _stored(spark: SparkSession, folder: str, kind: str, schema: str) -> DataFrame:
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(f"{folder}/{kind}")
    except (AnalysisException, Py4JJavaError):
        return spark.createDataFrame([], schema)


_FEATURES = f"path string, byte_size long, mtime_ns long, sha256 string, width int, height int, features array<{FEATURE}>, issue string, quality double, method string, shard int"
_BANDS = "path string, view string, band_name string, band_value string, method string, shard int"


def band_features(spark: SparkSession, folder: str) -> DataFrame:
    return _stored(spark, folder, "features", _FEATURES)


def band_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _stored(spark, folder, "bands", _BANDS)


def build_band_index(descriptors: DataFrame, folder: str, method: str = METHOD, shards: int = 32, rebuild: bool = False) -> DataFrame:
    """Bring the index below ``folder`` up to date with descriptors (path, byte_size, mtime_ns, sha256, width, height, views, quality).

    Rows whose size, time and hash are those of the index are reused; features of all others are made anew, and only the
    shards (by hash of the path) that hold such rows are written again. Paths that the descriptors no longer hold stay.
    Returns one row of counters: total, reused, indexed, errors.
    """
    spark = descriptors.sparkSession
    shard = F.pmod(F.xxhash64("path"), F.lit(shards)).cast("int")
    given = descriptors.withColumns({"method": F.lit(method), "shard": shard})
    stored = band_features(spark, folder).filter(F.col("method") == method)
    good = stored.filter("issue = ''").select("path", *_VERSION)
    stale = given if rebuild else given.join(good, ["path", *_VERSION], "left_anti")
    issue = descriptor_issue("views", "width", "height")
    made = stale.withColumn("issue", issue).withColumn("features", F.when(F.col("issue") == "", features(F.col("views"))))
    columns = [c.split()[0] for c in _FEATURES.split(", ")]
    made = materialize(made.select(*columns), "band-features")
    touched = made.select("shard").distinct()
    kept = stored.join(touched, "shard", "left_semi").join(made.select("path"), "path", "left_anti").select(*columns)
    new = materialize(kept.unionByName(made), "touched-shards")
    if not made.isEmpty():
        overwrite_partitions(new, f"{folder}/features", ["method", "shard"])
        listed = bands_of(new.filter("issue = ''"), "path").join(new.select("path", "method", "shard"), "path")
        overwrite_partitions(listed.select("path", "view", "band_name", "band_value", "method", "shard"), f"{folder}/bands", ["method", "shard"])
    total = descriptors.agg(F.count(F.lit(1)).alias("total"))
    done = made.agg(F.count_if(F.col("issue") == "").alias("indexed"), F.count_if(F.col("issue") != "").alias("errors"))
    return total.crossJoin(F.broadcast(done)).select("total", (F.col("total") - F.col("indexed") - F.col("errors")).alias("reused"), "indexed", "errors")


def ensure_ready(spark: SparkSession, folder: str, method: str = METHOD) -> None:
    """An error where the index has no features of this method: a match may not start without any."""
    if band_features(spark, folder).filter((F.col("method") == method) & (F.col("issue") == "")).isEmpty():
        raise RuntimeError(f"the band index of {method} is not built")


def view_votes(target_bands: DataFrame, index: DataFrame, cap: int | None = HIT_LIMIT) -> DataFrame:
    """(target, path) with votes, rarity, best_band and hit_views of band hits.

    A vote is a (path, view) in a band of the target. Of a band at most ``cap`` hits count, by path and view, or all if it is
    None; a hit's rarity is one by the number of hits that count in its band.
    """
    band = ["band_name", "band_value"]
    held = index.select("path", "view", *band)
    if cap is not None:
        # The first hits of a band are the same for all targets, so the index is cut before the join.
        held = bounded_top(held, band, [F.col("path"), F.col("view")], cap, F.concat_ws(":", "path", "view"))
    sizes = held.groupBy(*band).agg(F.count(F.lit(1)).alias("band_hits"))
    hits = target_bands.select("target", *band).distinct().join(held, band).join(sizes, band)
    return hits.groupBy("target", "path").agg(
        F.count(F.lit(1)).alias("votes"),
        F.sum(1 / F.col("band_hits")).alias("rarity"),
        F.min("band_hits").alias("best_band"),
        F.collect_set("view").alias("hit_views"),
    )


def _by_votes(votes: DataFrame, most: int) -> DataFrame:
    """Of each target the ``most`` paths with most votes, then the rarest bands."""
    order = Window.partitionBy("target").orderBy(F.col("votes").desc(), F.bround("rarity", 9).desc(), "best_band", "path")
    return votes.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= most).drop("_place")


def likeliest(target_bands: DataFrame, index: DataFrame, most: int) -> DataFrame:
    """The ``most`` first rows of each target of ``view_votes`` without a cap, by votes, then the rarest bands, then path.

    Bands that many pictures share have hits in proportion to the square of the table, so hits are no rows here: a cell of
    some targets and some paths counts them in a matrix, and hands on what may be among the first of a target.
    """
    band = ["band_name", "band_value"]
    index = index.select("path", "view", *band)
    sizes = index.groupBy(*band).agg(F.count(F.lit(1)).alias("band_hits"))
    asked = materialize(target_bands.select("target", *band).distinct().join(sizes, band), "asked-bands")
    blocks = max(1, -(-asked.select("target").distinct().count() // CELL_TARGETS))
    parts = max(1, -(-index.select("path").distinct().count() // CELL_PATHS))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumns({"block": dealt("target", blocks), "part": every(parts)}).repartition(blocks * parts, "block", "part")
    right = index.withColumns({"block": every(blocks), "part": dealt("path", parts)}).repartition(blocks * parts, "block", "part")
    target, path, view = asked.schema["target"], index.schema["path"], index.schema["view"]
    schema = f"target {target.dataType.simpleString()}, path {path.dataType.simpleString()}, votes long, rarity double, best_band long, hit_views array<{view.dataType.simpleString()}>"
    cells = left.groupBy("block", "part").cogroup(right.groupBy("block", "part"))
    return _by_votes(cells.applyInArrow(lambda a, b: _cell_votes(a, b, most), schema), most)


def _stretches(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches (from, to) of neighbours whose sizes are at most ``most`` together; one that is larger stands alone."""
    ends = np.cumsum(sizes)
    low = 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(ends, most + (ends[low - 1] if low else 0), side="right")))
        yield low, high
        low = high


def _coded(values: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The distinct values and the place of each row's among them."""
    held = values.combine_chunks().dictionary_encode()
    return held.dictionary, np.asarray(held.indices).astype(np.int64)


_VOTES = ["target", "path", "votes", "rarity", "best_band", "hit_views"]


def _cell_votes(asked: pa.Table, held: pa.Table, most: int) -> pa.Table:
    """Rows of ``view_votes`` of a cell's targets and paths, with all that may be among the ``most`` first of a target."""
    named = lambda rows: pc.binary_join_element_wise(rows["band_name"], rows["band_value"], "\0")
    names, of_ask = _coded(named(asked))
    targets, target = _coded(asked["target"])
    at = pc.index_in(named(held), value_set=names)
    held, at = held.filter(pc.is_valid(at)), np.asarray(pc.drop_null(at)).astype(np.int64)
    paths, path = _coded(held["path"])
    views, view = _coded(held["view"])
    # Rows lie by path, and in it by band, so that rarities of equal bands add up to the same number.
    by_path = np.lexsort((at, path))
    at, view = at[by_path], view[by_path]
    size = np.bincount(path, minlength=len(paths))
    start = np.cumsum(size) - size
    band_hits = np.ones(len(names), dtype=np.int64)
    band_hits[of_ask] = np.asarray(asked["band_hits"])
    asks = np.zeros((len(names), len(targets)), dtype=bool)
    asks[of_ask, target] = True
    # Votes and rarity are one sum: a vote weighs more than all rarities of a path, each of which is one at most.
    weight = asks * (size.max(initial=0) + 1.0 + 1.0 / band_hits)[:, None]
    score = np.zeros((len(paths), len(targets)))
    for low, high in _stretches(size * len(targets), CELL_HITS):
        rows = at[start[low] : start[high - 1] + size[high - 1]]
        score[low:high] = np.add.reduceat(weight[rows], start[low:high] - start[low], axis=0)
    cut = len(paths) - most
    least = np.partition(score, cut, axis=0)[cut] if cut > 0 else np.zeros(len(targets))
    # Rarities are ranked to nine places, so that one which is a little less may stand before.
    near = ((score >= least - 1e-8) & (score > 0)).T
    place = np.empty(len(paths), dtype=np.int64)
    place[np.asarray(pc.sort_indices(paths))] = np.arange(len(paths))
    found = []
    for low, high in _stretches(near @ size, CELL_HITS):
        t, p = np.nonzero(near[low:high])
        t += low
        pair = np.repeat(np.arange(len(t)), size[p])
        row = np.arange(len(pair)) + np.repeat(start[p] - (np.cumsum(size[p]) - size[p]), size[p])
        hit = asks[at[row], t[pair]]
        pair, row = pair[hit], row[hit]
        hits = band_hits[at[row]]
        votes, rarity = np.bincount(pair, minlength=len(t)), np.bincount(pair, 1.0 / hits, minlength=len(t))
        best = np.full(len(t), np.iinfo(np.int64).max)
        np.minimum.at(best, pair, hits)
        # Of rows that are equal in all but the path the first by path are enough.
        order = np.lexsort((place[p], best, rarity, votes, t))
        same = np.append(False, np.all([x[order][1:] == x[order][:-1] for x in (t, votes, rarity, best)], axis=0)) if len(t) else np.zeros(0, dtype=bool)
        number = np.arange(len(t))
        number -= np.maximum.accumulate(np.where(same, 0, number))
        keep = np.zeros(len(t), dtype=bool)
        keep[order[number < most]] = True
        seen = np.unique(pair[keep[pair]] * len(views) + view[row[keep[pair]]])
        ends = np.append(0, np.cumsum(np.bincount(seen // max(1, len(views)), minlength=len(t))[keep]))
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), views.take(pa.array(seen % max(1, len(views)))))
        numbers = [pa.array(x[keep]) for x in (votes, rarity, best)]
        found.append(pa.RecordBatch.from_arrays([targets.take(pa.array(t[keep])), paths.take(pa.array(p[keep])), *numbers, listed], _VOTES))
    fields = [targets.type, paths.type, pa.int64(), pa.float64(), pa.int64(), pa.list_(views.type)]
    return pa.Table.from_batches(found, pa.schema(list(zip(_VOTES, fields, strict=True))))


def _spread(lists: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """The row of each struct of a list column, and the structs."""
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten()


def _rows(structs: pa.StructArray, name: str) -> np.ndarray:
    values = structs.field(name)
    return np.asarray(values.flatten(), dtype=np.float64).reshape(len(values), -1) if len(values) else np.zeros((0, 1))


def nearest_views(pairs: DataFrame, left: str, right: str, preferred: str | None = None, all_left: bool = True) -> DataFrame:
    """Adds distance and best_view: over all pairs of views of two feature arrays the least mean squared difference of the gray
    grids plus a share of that of the colours, and the right view that has it (the first by name of equals).

    Right views are those in ``preferred``, or all where none of them is; left ones all, or the first alone. A batch is one
    block: views are laid out as rows of matrices. The square of the difference of two means is never above the mean square,
    so pairs whose bound exceeds the distance of their row's lowest bound are left out of the full computation.
    """
    names = pairs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields), "distance double, best_view string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                yield block(whole.slice(start, 2048))

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        a_row, a = _spread(batch.column(names.index(left)))
        b_row, b = _spread(batch.column(names.index(right)))
        if not all_left:
            first = np.flatnonzero(np.append(True, a_row[1:] != a_row[:-1])) if len(a_row) else np.zeros(0, dtype=int)
            a_row, a = a_row[first], a.take(pa.array(first))
        labels = np.asarray(b.field("name").to_pylist(), dtype=object)
        use = np.ones(len(b_row), dtype=bool)
        if preferred is not None:
            wanted = [set(p or ()) for p in batch.column(names.index(preferred)).to_pylist()]
            liked = np.array([label in wanted[r] for r, label in zip(b_row.tolist(), labels, strict=True)], dtype=bool)
            some = np.zeros(n, dtype=bool)
            some[b_row[liked]] = True
            use = liked | ~some[b_row]
        b_at = np.flatnonzero(use)
        # Pairs of views of a row: each left view with a stretch of right ones.
        sizes = np.bincount(b_row[b_at], minlength=n)
        offset = np.cumsum(sizes) - sizes
        each = sizes[a_row]
        i = np.repeat(np.arange(len(a_row)), each)
        j = b_at[np.repeat(offset[a_row] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
        row = a_row[i]
        x, y, u, v = _rows(a, "gray"), _rows(b, "gray"), _rows(a, "mean_rgb"), _rows(b, "mean_rgb")
        low = (x.mean(axis=1)[i] - y.mean(axis=1)[j]) ** 2 + COLOUR_WEIGHT * (u.mean(axis=1)[i] - v.mean(axis=1)[j]) ** 2 if len(i) else np.zeros(0)

        def full(at: np.ndarray) -> np.ndarray:
            return ((x[i[at]] - y[j[at]]) ** 2).mean(axis=1) + COLOUR_WEIGHT * ((u[i[at]] - v[j[at]]) ** 2).mean(axis=1)

        best = np.full(n, np.inf)
        promising = np.lexsort((low, row))
        head = promising[np.flatnonzero(np.append(True, row[promising][1:] != row[promising][:-1]))] if len(row) else promising
        best[row[head]] = full(head)
        stay = np.flatnonzero(low <= best[row] + 1e-9)
        score = np.round(full(stay), 9)
        order = np.lexsort((labels[j[stay]].astype(str), score, row[stay])) if len(stay) else stay
        own = row[stay][order]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else own
        distance, view = np.full(n, 999_999.0), np.full(n, "", dtype=object)
        distance[own[first]], view[own[first]] = score[order][first], labels[j[stay]][order][first]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(distance), pa.array(view.tolist(), pa.string())], [*names, "distance", "best_view"])

    return pairs.mapInArrow(run, schema)


def shortlist(targets: DataFrame, index: DataFrame, featured: DataFrame, size: int = SHORTLIST, cap: int | None = HIT_LIMIT) -> DataFrame:
    """(target, path, votes, distance, best_view, score, rank): of each target the ``size`` likeliest paths.

    ``targets`` has target, width, height and features. The paths with most votes, then the rarest bands, are scored by
    the distance of the target's first view to the views that were hit, less a share for each vote. All hits of a band count
    where ``cap`` is None.
    """
    scored = min(MOST_SCORED, max(size, size * SCORE_MULTIPLIER))
    wanted = bands_of(targets, "target")
    likely = likeliest(wanted, index, scored) if cap is None else _by_votes(view_votes(wanted, index, cap), scored)
    pairs = likely.join(targets.select("target", F.col("features").alias("wanted")), "target").join(featured.select("path", "features"), "path")
    near = nearest_views(pairs, "wanted", "features", "hit_views", all_left=False).drop("wanted", "features", "hit_views")
    score = F.bround(F.col("distance") - VOTE_WEIGHT * F.col("votes"), 6)
    rank = F.row_number().over(Window.partitionBy("target").orderBy("score", F.bround("distance", 6), "path"))
    return near.withColumn("score", score).withColumn("rank", rank).filter(F.col("rank") <= size).drop("rarity", "best_band")


def dense_ranks(short: DataFrame, targets: DataFrame, featured: DataFrame, most: int) -> DataFrame:
    """(target, path, distance, place): the ``most`` nearest of the shortlisted paths by all views of both."""
    pairs = short.select("target", "path").join(targets.select("target", F.col("features").alias("wanted")), "target")
    near = nearest_views(pairs.join(featured.select("path", "features"), "path"), "wanted", "features")
    order = Window.partitionBy("target").orderBy(F.bround("distance", 6), "path")
    return near.select("target", "path", "distance", F.row_number().over(order).alias("place")).filter(F.col("place") <= most)


def benchmark_records(confirmed: DataFrame, readable: DataFrame, short: DataFrame, dense: DataFrame) -> DataFrame:
    """(target, path, prefilter_rank, rank, status, error): where the confirmed path of each target was lost.

    A target without features is a source error; a path that the shortlist lacks is a miss of the prefilter, one that the
    shortlist has and the ranking has not a miss of the ranking.
    """
    seen = readable.select("target", F.lit(True).alias("_readable")).distinct()
    found = (
        confirmed.join(seen, "target", "left")
        .join(short.select("target", "path", F.col("rank").alias("_short")), ["target", "path"], "left")
        .join(dense.select("target", "path", F.col("place").alias("_dense")), ["target", "path"], "left")
    )
    lost = F.when(F.col("_readable").isNull(), "source_fingerprint_error").when(F.col("_short").isNull(), "prefilter_miss").otherwise("dense_ranker_miss")
    status = F.when(F.col("_readable").isNull(), "").when(F.col("_dense").isNotNull(), "hit").otherwise("miss")
    return found.select(
        "target",
        "path",
        F.coalesce("_short", F.lit(0)).alias("prefilter_rank"),
        F.coalesce("_dense", F.lit(0)).alias("rank"),
        status.alias("status"),
        F.when(F.col("_dense").isNotNull(), "").otherwise(lost).alias("error"),
    )


def benchmark_summary(records: DataFrame, sizes: list[int], most: int) -> DataFrame:
    """One row: confirmed targets, hits, misses by their reason, recall of the ranking at 1, 5 and ``most``, and of the prefilter at each size."""
    n = F.count(F.lit(1))
    share = lambda c: F.bround(F.count_if(c) / F.greatest(n, F.lit(1)), 4)
    rank, short = F.col("rank"), F.col("prefilter_rank")
    return records.agg(
        n.alias("confirmed"),
        F.count_if(F.col("status") == "hit").alias("hits"),
        *[F.count_if(F.col("error") == e).alias(e) for e in ("source_fingerprint_error", "prefilter_miss", "dense_ranker_miss")],
        share(rank == 1).alias("recall_at_1"),
        share(rank.between(1, 5)).alias("recall_at_5"),
        share(rank.between(1, most)).alias("recall_at_n"),
        *[share(short.between(1, k)).alias(f"prefilter_recall_at_{k}") for k in sizes],
    )
