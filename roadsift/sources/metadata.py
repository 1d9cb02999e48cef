"""Relational metadata in versioned directories of JSON arrays, and the frame indexes built from it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import yaw
from ..operators.joins import chain_walk, many_to_one
from ..schemas import CAMERAS, ContractError

# Names and columns of the metadata tables.
REQUIRED = {
    "scene": "token string, name string, description string, log_token string, nbr_samples int, first_sample_token string, last_sample_token string",
    "sample": "token string, timestamp long, scene_token string, prev string, next string",
    "sample_data": "token string, sample_token string, ego_pose_token string, calibrated_sensor_token string, timestamp long, fileformat string, is_key_frame boolean, filename string, width int, height int, prev string, next string",
    "sensor": "token string, channel string, modality string",
    "calibrated_sensor": "token string, sensor_token string, translation array<double>, rotation array<double>, camera_intrinsic array<array<double>>",
    "ego_pose": "token string, timestamp long, rotation array<double>, translation array<double>",
}
OPTIONAL = {
    "log": "token string, logfile string, vehicle string, date_captured string, location string",
    "category": "token string, name string, description string",
    "attribute": "token string, name string, description string",
    "visibility": "token string, level string, description string",
    "instance": "token string, category_token string, nbr_annotations int, first_annotation_token string, last_annotation_token string",
    "sample_annotation": "token string, sample_token string, instance_token string, attribute_tokens array<string>, visibility_token string, num_lidar_pts int, num_radar_pts int, translation array<double>, size array<double>, rotation array<double>, prev string, next string",
}
LIDAR = "LIDAR_TOP"


def _list(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def version_folder(spark: SparkSession, root: str, prefix: str = "v1.0-") -> str:
    """The one version directory below a root; none or several raise."""
    found = [n for n in _list(spark, root) if n.startswith(prefix)]
    if not found:
        raise FileNotFoundError(f"no {prefix}* below {root}")
    if len(found) > 1:
        raise ContractError(f"several versions below {root}: {sorted(found)}")
    return f"{root.rstrip('/')}/{found[0]}"


def load_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All metadata tables with declared schemas; optional ones only where their file exists."""
    folder = version_folder(spark, root)
    there = set(_list(spark, folder))
    if lost := [t for t in REQUIRED if f"{t}.json" not in there]:
        raise ContractError(f"tables missing: {', '.join(lost)}")
    schemas = REQUIRED | {t: s for t, s in OPTIONAL.items() if f"{t}.json" in there}
    return {t: spark.read.schema(s).option("multiLine", True).json(f"{folder}/{t}.json") for t, s in schemas.items()}


def has_annotations(tables: Mapping[str, DataFrame]) -> bool:
    return "sample_annotation" in tables and "instance" in tables


def scene_samples(spark: SparkSession, tables: Mapping[str, DataFrame], by_chain: bool = False) -> DataFrame:
    """sample_token, scene_token, timestamp, frame_idx. By time within the scene, or by walking the links from the first sample."""
    s = tables["sample"].select(F.col("token").alias("sample_token"), "scene_token", "timestamp", F.col("next").alias("following"))
    if not by_chain:
        return s.drop("following").withColumn("frame_idx", F.row_number().over(Window.partitionBy("scene_token").orderBy("timestamp", "sample_token")) - 1)
    walked = chain_walk(spark, s, tables["scene"].select("first_sample_token"), "sample_token", "following", "first_sample_token")
    return s.drop("following").join(walked.select(F.col("token").alias("sample_token"), F.col("position").alias("frame_idx")), "sample_token")


def check_chains(spark: SparkSession, tables: Mapping[str, DataFrame]) -> None:
    """Raises where the order by links differs from the order by time."""
    a = scene_samples(spark, tables, by_chain=True).select("sample_token", F.col("frame_idx").alias("i"))
    b = scene_samples(spark, tables).select("sample_token", F.col("frame_idx").alias("j"))
    if not a.join(b, "sample_token", "full").filter(~F.col("i").eqNullSafe(F.col("j"))).isEmpty():
        raise ContractError("sample links disagree with timestamps")


def existing_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Relative paths below a root; the content column is pruned, so nothing is read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return df.select(F.regexp_replace("path", "^[a-z]+:/*", "/").alias("path")).select(F.substring_index("path", f"{root.rstrip('/')}/", -1).alias("filename"))


def _keyed(tables: Mapping[str, DataFrame]) -> DataFrame:
    cal = tables["calibrated_sensor"].select(F.col("token").alias("calibrated_sensor_token"), "sensor_token", "translation", "rotation", "camera_intrinsic")
    sensor = tables["sensor"].select(F.col("token").alias("sensor_token"), "channel")
    return tables["sample_data"].filter("is_key_frame").join(cal, "calibrated_sensor_token").join(sensor, "sensor_token")


def camera_place(cam: str | Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in CAMERAS]), F.col(cam) if isinstance(cam, str) else cam)


def frame_index(spark: SparkSession, tables: Mapping[str, DataFrame], files: DataFrame | None = None) -> DataFrame:
    """Key frames of the six cameras with scene, position and path; ``files`` (filename) keeps only images that exist."""
    images = _keyed(tables).filter(F.col("channel").isin(*CAMERAS))
    images = images.join(files.select("filename"), "filename", "left_semi") if files is not None else images
    scenes = tables["scene"].select(F.col("token").alias("scene_token"), F.col("name").alias("scene_name"), F.col("description").alias("scene_desc"))
    met = images.select("sample_token", F.col("channel").alias("cam"), F.col("token").alias("sd_token"), F.col("filename").alias("img_path")).join(scene_samples(spark, tables), "sample_token").join(scenes, "scene_token")
    return met.select("sample_token", "cam", "sd_token", "scene_token", "scene_name", "scene_desc", F.lit("pool").alias("split"), F.col("frame_idx").cast("int").alias("frame_idx"), "timestamp", "img_path").orderBy("scene_token", "frame_idx", camera_place("cam"))


def camera_poses(tables: Mapping[str, DataFrame], frames: DataFrame) -> DataFrame:
    """Camera to ego translation and rotation, and the intrinsic matrix as nine numbers, for the rows of ``frames``."""
    poses = _keyed(tables).select(F.col("token").alias("sd_token"), "translation", "rotation", F.flatten("camera_intrinsic").alias("intrinsic"))
    return many_to_one(frames.select("sample_token", "cam", "sd_token"), poses, ["sd_token"]).drop("sd_token")


def lidar_index(spark: SparkSession, tables: Mapping[str, DataFrame], files: DataFrame | None = None) -> DataFrame:
    """One row a sample with a LiDAR key frame: path, ego position and yaw."""
    sweeps = _keyed(tables).filter(F.col("channel") == LIDAR)
    sweeps = sweeps.join(files.select("filename"), "filename", "left_semi") if files is not None else sweeps
    ego = tables["ego_pose"].select(F.col("token").alias("ego_pose_token"), F.col("translation").alias("ego_t"), F.col("rotation").alias("ego_q"))
    scenes = tables["scene"].select(F.col("token").alias("scene_token"), F.col("name").alias("scene_name"))
    met = sweeps.select("sample_token", "ego_pose_token", F.col("filename").alias("lidar_path")).join(ego, "ego_pose_token").join(scene_samples(spark, tables), "sample_token").join(scenes, "scene_token")
    return met.select("sample_token", "scene_token", "scene_name", F.lit("pool").alias("split"), F.col("frame_idx").cast("int").alias("frame_idx"), "timestamp", "lidar_path", F.col("ego_t")[0].cast("float").alias("ego_x"), F.col("ego_t")[1].cast("float").alias("ego_y"), yaw(F.col("ego_q")).cast("float").alias("ego_yaw"))


def lidar_calibration(tables: Mapping[str, DataFrame], wanted: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """R (row-major) and t of the LiDAR for the wanted samples; a cache is used only when it covers all of them."""
    from ..functions.geometry import rotation_matrix

    if cache is not None and wanted.select("sample_token").join(cache, "sample_token", "left_anti").isEmpty():
        return cache.join(wanted.select("sample_token").distinct(), "sample_token", "left_semi")
    return _keyed(tables).filter(F.col("channel") == LIDAR).join(wanted.select("sample_token").distinct(), "sample_token", "left_semi").select("sample_token", rotation_matrix(F.col("rotation")).alias("R"), F.col("translation").alias("t"))


def sun_inputs(tables: Mapping[str, DataFrame], places: Mapping[str, tuple[float, float]]) -> DataFrame:
    """sample_token, timestamp and the coordinates of its log's location; unknown places give nulls."""
    where = F.create_map(*[x for k, (a, b) in places.items() for x in (F.lit(k), F.array(F.lit(a), F.lit(b)))])[F.col("location")] if places else F.lit(None).cast("array<double>")
    log = tables["log"].select(F.col("token").alias("log_token"), where.alias("at"))
    scene = tables["scene"].select(F.col("token").alias("scene_token"), "log_token").join(log, "log_token", "left")
    return tables["sample"].select(F.col("token").alias("sample_token"), "scene_token", "timestamp").join(scene, "scene_token", "left").select("sample_token", "timestamp", F.col("at")[0].alias("lat"), F.col("at")[1].alias("lon"))
