"""Reading projects of files as tables, checking what is there, and writing wide tables.

Decoders of image formats aren't part of this: file names, JSON, logs and manifests are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCAN = "name string, voxel_size double, threshold double, original_format string, faulty boolean, is_mesh boolean, voxelized boolean, alignment_to string, elastic_to string, linked_to string, flag boolean"
POINT = "double"


def scan_rows(files: DataFrame) -> DataFrame:
    """One row per folder that holds its own <name>.json, with that file's values; files: path, text. Broken JSON gives nulls."""
    parts = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.element_at(F.split("path", "/"), -2).alias("folder"), F.from_json("text", SCAN).alias("s"))
    return parts.where(F.col("file") == F.concat("folder", F.lit(".json"))).select("s.*", "folder")


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    """scan_rows of the JSON files under extracted/, sorted by folder."""
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(f"{path}/extracted", wholetext=True)
    return scan_rows(texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))).orderBy("folder")


def parse_edit_names(files: DataFrame) -> DataFrame:
    """scan, edit_number, kind, lossy and role (image, mask or warp) of file names like <scan>_edit_<n>_<kind>[_lossy][_mask|_warp].ext."""
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[A-Za-z0-9.]+$", "")
    p = files.select("file", stem.alias("stem")).where(F.col("stem").rlike(r"_edit_[0-9]+"))
    rest = F.regexp_extract("stem", r"_edit_[0-9]+_?(.*)$", 1)
    role = F.when(F.col("stem").endswith("_mask"), "mask").when(F.col("stem").endswith("_warp"), "warp").otherwise("image")
    kind = F.regexp_replace(F.regexp_replace(rest, "_(mask|warp)$|^(mask|warp)$", ""), "_lossy$|^lossy$", "")
    return p.select(F.regexp_extract("stem", r"^(.*)_edit_[0-9]+", 1).alias("scan"), F.regexp_extract("stem", r"_edit_([0-9]+)", 1).cast("int").alias("edit_number"), kind.alias("kind"), F.col("stem").rlike("_lossy(_|$)").alias("lossy"), role.alias("role"), "file")


def read_edits(spark: SparkSession, path: str) -> DataFrame:
    """Edits of the files under a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"))
    return parse_edit_names(files)


def slice_series_manifest(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Series of numbered slice files by folder, prefix and extension (tif is tiff, jpg is jpeg), and their issues.

    files: folder, file. Issues: more than one series in a folder; indices after which slices are missing.
    """
    name = r"^(.*?)([0-9]+)\.([A-Za-z]+)$"
    ext = F.lower(F.regexp_extract("file", name, 3))
    f = files.where(F.col("file").rlike(name)).select("folder", F.regexp_extract("file", name, 1).alias("prefix"), F.regexp_extract("file", name, 2).cast("int").alias("idx"), F.when(ext == "tif", "tiff").when(ext == "jpg", "jpeg").otherwise(ext).alias("ext"))
    by = ["folder", "prefix", "ext"]
    gap = f.withColumn("gap", F.lead("idx").over(W.partitionBy(*by).orderBy("idx")) - F.col("idx"))
    step = gap.groupBy(*by).agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last"), F.min("gap").alias("step"))
    holes = gap.join(step.select(*by, "step"), by).where(F.col("gap") > F.col("step")).groupBy(*by).agg(F.array_sort(F.collect_list("idx")).alias("missing_after"))
    several = step.groupBy("folder").agg(F.count("*").alias("series")).where("series > 1")
    issues = holes.select("folder", F.lit("missing slices").alias("issue"), F.array_join("missing_after", ",").alias("detail")).union(several.select("folder", F.lit("several series"), F.col("series").cast("string")))
    return step, issues


def acquisition_log_kv(logs: DataFrame) -> DataFrame:
    """folder, section, key, value of INI-like logs (folder, file, text): lower-cased names, the first value of a key in a folder wins."""
    lines = logs.select("folder", "file", F.posexplode(F.split("text", r"\r?\n")).alias("line", "body"))
    head = F.regexp_extract("body", r"^\s*\[(.*)\]\s*$", 1)
    w = W.partitionBy("folder", "file").orderBy("line")
    marked = lines.withColumn("section", F.last(F.when(head != "", F.lower(F.trim(head))), True).over(w))
    pair = marked.where(F.col("body").rlike(r"^[^\[=]+=")).select("folder", "file", "line", F.coalesce("section", F.lit("")).alias("section"), F.lower(F.trim(F.regexp_extract("body", r"^([^=]+)=", 1))).alias("key"), F.trim(F.regexp_extract("body", r"=(.*)$", 1)).alias("value"))
    first = F.row_number().over(W.partitionBy("folder", "section", "key").orderBy("file", "line"))
    return pair.withColumn("r", first).where("r = 1").select("folder", "section", "key", "value")


def log_disagreements(logs: DataFrame, keys: list[str], rtol: float = 1e-6) -> DataFrame:
    """Keys whose numbers differ between the logs of a folder; logs as for acquisition_log_kv."""
    per_file = acquisition_log_kv(logs.withColumn("folder", F.concat_ws("|", "folder", "file")))
    n = per_file.where(F.col("key").isin(keys)).select(F.substring_index("folder", "|", 1).alias("folder"), "key", F.col("value").try_cast("double").alias("v"))
    return n.groupBy("folder", "key").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where(F.col("hi") - F.col("lo") > rtol * F.abs("hi"))


def read_landmarks(texts: DataFrame) -> DataFrame:
    """scan_id, idx, type, x, y, z of landmark JSON (scan_id, text): bare triples, {position} with an array or x/y/z, or a dict keyed by number."""
    items = F.from_json("text", "array<string>")
    keyed = F.transform(F.array_sort(F.map_entries(F.from_json("text", "map<string,string>")), lambda a, b: (a["key"].cast("int") - b["key"].cast("int"))), lambda e: e["value"])
    rows = texts.select("scan_id", F.posexplode(F.when(F.trim("text").startswith("["), items).otherwise(keyed)).alias("idx", "item"))
    bare = F.from_json("item", "array<double>")
    position = F.get_json_object("item", "$.position")
    listed, named = F.from_json(position, "array<double>"), F.from_json(position, "x double, y double, z double")
    at = lambda k, a: F.coalesce(F.when(F.trim("item").startswith("["), bare[k]), F.when(F.trim(position).startswith("["), listed[k]), named[a])
    kind = F.coalesce(F.get_json_object("item", "$.landmark_type"), F.lit("main"))
    return rows.select("scan_id", "idx", kind.alias("type"), *[at(k, a).alias(a) for k, a in enumerate("xyz")])


def frame_manifest(frames: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The frames with T = P = U = 0 in order of Z, and issues: selected frames never stored, and axes dropped; frames: file, frame, t, p, u, z."""
    chosen = frames.where("t = 0 AND p = 0 AND u = 0")
    lost = chosen.join(stored.select("file", "frame"), ["file", "frame"], "left_anti").groupBy("file").agg(F.count("*").alias("n")).select("file", F.lit("frame not stored").alias("issue"), F.col("n").cast("string").alias("detail"))
    axes = frames.groupBy("file").agg(F.concat_ws(",", *[F.when(F.max(a) > 0, a.upper()) for a in "tpu"]).alias("detail")).where("detail <> ''").select("file", F.lit("axes dropped").alias("issue"), "detail")
    order = F.row_number().over(W.partitionBy("file").orderBy("z", "frame")) - 1
    return chosen.withColumn("slice", order), lost.union(axes)


def landmarks_wide(landmarks: DataFrame, scans: DataFrame, most: int) -> DataFrame:
    """One row per subject that isn't faulty, columns [semi_]landmark_<i>_<axis> as text, '' where missing, ordered by lower-cased name."""
    named = F.concat(F.when(F.col("type") == "semi", "semi_").otherwise(""), F.lit("landmark_"), F.col("idx").cast("string"))
    long = landmarks.join(scans.where("NOT coalesce(faulty, false)").select("scan_id", "name"), "scan_id")
    cells = long.select("name", F.explode(F.array(*[F.struct(F.concat(named, F.lit(f"_{a}")).alias("c"), F.col(a).cast("string").alias("v")) for a in "xyz"])).alias("e")).select("name", "e.c", "e.v")
    columns = [f"{p}landmark_{i}_{a}" for p in ("", "semi_") for i in range(most) for a in "xyz"]
    wide = cells.groupBy("name").pivot("c", columns).agg(F.first("v"))
    return wide.na.fill("").orderBy(F.lower("name"))


def write_landmarks_csv(wide: DataFrame, path: str) -> None:
    """Writes landmarks_wide as CSV with a header, the subject first, in part files that follow its order; missing values are empty."""
    wide.withColumnRenamed("name", "Subject").orderBy(F.lower("Subject"), "Subject").write.csv(path, header=True, emptyValue="")


def distances_wide(distances: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Two tables, a row per subject and a column per landmark: distances now and before snapping."""
    one = lambda c: distances.groupBy("scan_id").pivot("idx", list(range(most))).agg(F.first(c))
    return one("distance"), one("snap_distance")


def upsert_label_names(names: DataFrame, changes: DataFrame) -> DataFrame:
    """label, name after changes (label, seq, name): the last change wins, a blank name deletes."""
    last = changes.groupBy("label").agg(F.max_by(F.trim("name"), "seq").alias("new"), F.lit(True).alias("hit"))
    joined = names.join(last, "label", "full_outer")
    return joined.select("label", F.when(F.col("hit"), F.col("new")).otherwise(F.col("name")).alias("name")).where("coalesce(name, '') <> ''")


def probe_slices(series: DataFrame, k: int = 32) -> DataFrame:
    """k evenly spaced slices of each series, first and last among them: ranks rint(i (n - 1) / (k - 1)); series: folder, idx, ..."""
    by = W.partitionBy("folder")
    ranked = series.withColumn("r", F.row_number().over(by.orderBy("idx")) - 1).withColumn("n", F.count("*").over(by))
    i = F.rint(F.col("r") * (k - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    chosen = (F.col("n") <= k) | (F.rint(i * (F.col("n") - 1) / (k - 1)) == F.col("r"))
    return ranked.where(chosen).drop("r", "n")


def mixed_series(probes: DataFrame) -> DataFrame:
    """Folders whose probed slices differ in shape or type; probes: folder, shape, dtype."""
    return probes.groupBy("folder").agg(F.count_distinct(F.struct("shape", "dtype")).alias("kinds")).where("kinds > 1")


def rename_tokens(scans: DataFrame, new: str, token: str = "atlas") -> DataFrame:
    """Rewrites token, token_... and token.... to the new name in every text column."""
    pattern = f"^{token}(?=$|[_.])"
    return scans.withColumns({c: F.regexp_replace(c, pattern, new) for c, t in scans.dtypes if t == "string"})
