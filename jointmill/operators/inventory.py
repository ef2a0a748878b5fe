"""Inventory of files: names, folders, tokens, duplicates, cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jointmill.functions.paths import IN_SCOPE, LIGHT, TASKS, extension, file_name, folder, lookup, path_info, stem
from jointmill.operators.windows import global_rank

#: Extensions of photos.
IMAGES = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp")
NO_SETUP = "<no setup folder>"


def described(files: DataFrame, path: str = "path") -> DataFrame:
    """files with folder, name, stem, ext, is_image and the path's board, package, viewpoint, setup, task, in_scope, light."""
    f = files.withColumns({"folder": folder(path), "name": file_name(path), "stem": stem(path), "ext": extension(path)})
    f = f.withColumn("_i", path_info(F.split("folder", "/")))
    f = f.withColumns({k: F.col(f"_i.{k}") for k in ("board", "package", "viewpoint", "setup")}).drop("_i")
    whole = F.when(F.col("viewpoint").isNotNull(), F.concat_ws("/", "viewpoint", "setup"))
    return f.withColumns({"is_image": F.col("ext").isin(*IMAGES), "task": lookup("viewpoint", TASKS), "in_scope": F.col("package").isin(*IN_SCOPE), "light_direction": lookup("viewpoint", LIGHT), "viewpoint_folder": whole})


def value_counts(rows: DataFrame, columns: list[str], name: str = "n") -> DataFrame:
    return rows.groupBy(*columns).agg(F.count("*").alias(name))


def ranked_counts(rows: DataFrame, column: str) -> DataFrame:
    """Values with their count and rank: most frequent first, then by value, however many values there are."""
    return global_rank(value_counts(rows, [column]), [F.desc("n"), F.asc(column)]).withColumn("rank", F.col("rank").cast("int"))


def name_tokens(name_stem: Column | str) -> Column:
    """Tokens of a stem between `_`, `-` and `.`, without empty ones."""
    return F.filter(F.split(name_stem, r"[_\-.]"), lambda t: t != "")


def position_table(rows: DataFrame, tokens: Column, order: str, examples: int = 4) -> DataFrame:
    """(position, distinct, total, min_n, median_n, max_n, role, examples) of the tokens at each place, from 0.

    Examples are the most frequent values, of equally frequent ones the first seen by `order`. role is constant for one
    value, unique if there are as many values as rows, else grouping.
    """
    each = rows.select(F.col(order).alias("_o"), F.posexplode(tokens).alias("position", "value"))
    counts = each.groupBy("position", "value").agg(F.count("*").alias("n"), F.min("_o").alias("first"))
    w = Window.partitionBy("position").orderBy(F.desc("n"), "first")
    top = counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= examples)
    top = top.groupBy("position").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x["value"]), "|").alias("examples"))
    t = counts.groupBy("position").agg(F.count("*").alias("distinct"), F.sum("n").alias("total"), F.min("n").alias("min_n"), F.median("n").alias("median_n"), F.max("n").alias("max_n"))
    role = F.when(F.col("distinct") <= 1, "constant").when(F.col("distinct") >= F.col("total"), "unique").otherwise("grouping")
    return t.withColumn("role", role).join(top, "position")


def token_outliers(rows: DataFrame, tokens: Column, order: str) -> DataFrame:
    """Rows whose number of tokens isn't the commonest; of equally common numbers the first seen by `order` is."""
    counted = rows.withColumn("n_tokens", F.size(tokens))
    modal = counted.groupBy("n_tokens").agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first").limit(1)
    return counted.join(F.broadcast(modal.select(F.col("n_tokens").alias("_m"))), F.col("n_tokens") != F.col("_m")).drop("_m")


def mirrored_folders(rows: DataFrame, name: str, place: str, examples: int = 2) -> DataFrame:
    """(folders, names, example names): names found in several folders, by their set of folders."""
    per = rows.select(name, place).distinct().groupBy(name).agg(F.array_join(F.array_sort(F.collect_set(place)), "|").alias("folders"), F.count("*").alias("k")).where("k > 1")
    w = Window.partitionBy("folders").orderBy(name)
    some = per.withColumn("r", F.row_number().over(w)).where(F.col("r") <= examples).groupBy("folders").agg(F.array_join(F.array_sort(F.collect_list(name)), "|").alias("examples"))
    return per.groupBy("folders").agg(F.count("*").alias("names")).join(some, "folders")


def deepest(rows: DataFrame, name: str, path: str) -> DataFrame:
    """One path a name: the deepest, of equally deep ones the last in string order; with the number set aside."""
    depth = F.size(F.split(path, "/"))
    best = F.max(F.struct(depth.alias("d"), F.col(path).alias("p")))
    return rows.groupBy(name).agg(best.alias("b"), (F.count_distinct(path) - 1).alias("set_aside")).select(name, F.col("b.p").alias(path), "set_aside")


def ragged_cells(rows: DataFrame, cell: list[str], part: str) -> DataFrame:
    """(cell..., parts, total, least, most, ragged): counts of each cell's parts; ragged if those present differ."""
    per = rows.where(F.col(part).isNotNull()).groupBy(*cell, part).agg(F.count("*").alias("n"))
    c = per.groupBy(*cell).agg(F.count("*").alias("parts"), F.sum("n").alias("total"), F.min("n").alias("least"), F.max("n").alias("most"))
    return c.withColumn("ragged", F.col("least") < F.col("most"))


def cell_table(rows: DataFrame, cell: list[str] | None = None, part: str = "viewpoint_folder") -> DataFrame:
    """(cell..., in_scope, counts, ragged): photos of every cell by viewpoint folder, setups apart; ragged if the counts differ.

    counts is a map of folder to number; photos that lack a part of the cell or the folder are unclassified() instead.
    """
    cell = cell or ["board", "package"]
    per = rows.na.drop(subset=[*cell, part]).groupBy(*cell, part).agg(F.count("*").alias("n"))
    c = per.groupBy(*cell).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(part, "n")))).alias("counts"), (F.min("n") < F.max("n")).alias("ragged"))
    return c.withColumn("in_scope", F.col(cell[-1]).isin(*IN_SCOPE))


def unclassified(rows: DataFrame, needed: list[str] | None = None) -> DataFrame:
    """Rows whose path doesn't tell board, package and viewpoint folder."""
    return rows.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in needed or ["board", "package", "viewpoint_folder"]]))


def select_cell(rows: DataFrame, board: str, package: str, viewpoint: str, setup: str | None = None) -> DataFrame:
    """Photos of one cell, in the order of their names (then paths), which is the order they were taken in."""
    there = (F.col("board") == board) & (F.col("package") == package) & (F.col("viewpoint") == viewpoint)
    return rows.where(there if setup is None else there & (F.col("setup") == setup)).orderBy("name", "path")


def found_paths(wanted: DataFrame, files: DataFrame, text: str = "wanted", path: str = "path") -> DataFrame:
    """(wanted, path, how): the file that each text means: a whole path, else the only file of that name.

    Either separator will do. how is path, name, ambiguous or none; the last two have a null path.
    """
    w = wanted.select(F.col(text).alias("wanted"), F.translate(text, "\\", "/").alias("_w")).distinct()
    f = files.select(F.col(path).alias("path")).distinct()
    names = f.groupBy(file_name("path").alias("_w")).agg(F.count("*").alias("_n"), F.min("path").alias("_one"))
    j = w.join(f.withColumn("_w", F.col("path")), "_w", "left").join(names, "_w", "left")
    how = F.when(F.col("path").isNotNull(), "path").when(F.col("_n") == 1, "name").when(F.col("_n") > 1, "ambiguous").otherwise("none")
    return j.select("wanted", F.coalesce("path", F.when(F.col("_n") == 1, F.col("_one"))).alias("path"), how.alias("how"))


def find_path(files: DataFrame, text: str, path: str = "path") -> str:
    """The one file that the text means; none, or several, is an error that says so."""
    r = found_paths(files.sparkSession.createDataFrame([(text,)], "wanted string"), files, path=path).first()
    if r["path"] is None:
        raise ValueError(f"{text!r} names {'no photo' if r['how'] == 'none' else 'more than one photo'}")
    return r["path"]


def by_task(rows: DataFrame, name: str = "name") -> DataFrame:
    """(task, name) of annotated photos by the task of their place; one without a place or a task is unclassified."""
    return rows.select(F.coalesce("task", F.lit("unclassified")).alias("task"), name)


def annotation_gaps(found: DataFrame, name: str = "name") -> DataFrame:
    """(name, reason): names of annotations that several files answer to, or none; of joins.resolve_prefer_elsewhere()."""
    reason = F.when(F.col("resolved_path").isNull(), "missing").when(F.col("ambiguous"), "ambiguous")
    return found.select(name, reason.alias("reason")).where("reason is not null").distinct()


def coverage(rows: DataFrame, cell: list[str], part: str, values: list[str]) -> DataFrame:
    """Cells with a column of counts for each value of `part`, 0 where there is none, and their total."""
    p = rows.groupBy(*cell).pivot(part, values).agg(F.count(F.lit(1)))
    p = p.select(*cell, *[F.coalesce(F.col(f"`{v}`"), F.lit(0).cast("long")).alias(v) for v in values])
    return p.withColumn("total", sum((F.col(f"`{v}`") for v in values), F.lit(0)))


def duplicate_contents(rows: DataFrame, content: str, place: str) -> DataFrame:
    """(hash, n, places): contents that occur more than once, by MD5, with the sorted places they occur at."""
    g = rows.groupBy(F.md5(F.col(content).cast("binary")).alias("hash")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(place)), "|").alias("places"))
    return g.where("n > 1")


def duplicate_sample(rows: DataFrame, name: str, place: str, content: str, size: int = 30) -> DataFrame:
    """(name, copies, identical) of up to `size` names that occur in several places.

    The first name of every set of places comes first, sets with most names before others; the rest is filled by name.
    identical compares the MD5 of the copies; it is null where a content is.
    """
    per = rows.groupBy(name).agg(F.array_sort(F.collect_set(place)).alias("places"), F.count("*").alias("copies"), F.count_distinct(F.md5(F.col(content).cast("binary"))).alias("k"), F.count(content).alias("there")).where(F.size("places") > 1)
    sets = per.groupBy("places").agg(F.count("*").alias("size"), F.min(name).alias("head"))
    p = per.join(sets, "places").withColumn("is_head", F.col(name) == F.col("head"))
    order = [F.desc("is_head"), F.when(F.col("is_head"), -F.col("size")).otherwise(0), F.col(name)]
    same = F.when(F.col("there") == F.col("copies"), F.col("k") == 1)
    return p.orderBy(*order).limit(size).select(name, "copies", same.alias("identical"))


def brightness(photos: DataFrame) -> DataFrame:
    """(board, setup, images, mean_brightness) of V1 photos with a board; photos that weren't decoded are left out, a missing setup is marked."""
    p = photos.where("viewpoint = 'V1' and board is not null and brightness is not null")
    return p.groupBy("board", F.coalesce("setup", F.lit(NO_SETUP)).alias("setup")).agg(F.count("*").alias("images"), F.avg("brightness").alias("mean_brightness"))
