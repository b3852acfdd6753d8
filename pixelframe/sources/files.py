"""Sources and sinks: image listings and pixels, presets, ledgers, jobs, 3-D LUTs, saved masks, pixel stores."""

from __future__ import annotations

import base64
import json
import re
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelframe.functions.color import quantize
from pixelframe.sources.shared import cut

# The supported extensions of image files (raw formats, then others), and the fields of ledger and job records.
IMAGE_EXTENSIONS = ("raw", "dng", "cr2", "nef", "arw", "jpg", "jpeg", "png", "tif", "tiff", "bmp")
LEDGER_FIELDS = ("batch_key", "error", "job_id", "job_mode", "output_format", "output_path", "preset_hash", "preset_name", "reason", "source_path", "status", "suffix", "ts")
LEDGER = T.StructType([T.StructField(f, T.StringType()) for f in LEDGER_FIELDS])
JOB = T.StructType([T.StructField(f, T.StringType()) for f in ("job_id", "mode", "created_at", "preset_path", "input_dir", "output_dir", "suffix", "output_format")] + [T.StructField("skip_completed", T.BooleanType()), T.StructField("source_paths", T.ArrayType(T.StringType()))])
#: Rows of one batch of pixels.
PIXELS_AT_ONCE = 1 << 18
NUMBERS = T.MapType(T.StringType(), T.DoubleType())
PRESET = T.StructType([
    T.StructField("version", T.IntegerType()), T.StructField("global_params", NUMBERS), T.StructField("color_settings", T.MapType(T.StringType(), T.StringType())),
    T.StructField("selective_params", T.MapType(T.StringType(), NUMBERS)),
    T.StructField("layer_options", T.MapType(T.StringType(), T.StructType([T.StructField("enabled", T.BooleanType()), T.StructField("opacity", T.DoubleType()), T.StructField("blend_mode", T.StringType())]))),
    T.StructField("layer_order", T.ArrayType(T.StringType())), T.StructField("mask_adjustments", T.MapType(T.StringType(), NUMBERS)),
    T.StructField("meta", T.StructType([T.StructField("name", T.StringType()), T.StructField("category", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("saved_at", T.StringType())])),
])


def extension(path: Column) -> Column:
    """The last extension in lower case, without its dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def stem(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]+$", "")


def is_image(path: Column) -> Column:
    return extension(path).isin(*IMAGE_EXTENSIONS)


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, modificationTime of a folder's own image files, by name. Contents aren't read."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime")
    return files.where(is_image(F.col("path"))).orderBy("path")


def read_images(spark: SparkSession, places: str | list[str]) -> DataFrame:
    """image_id (the path, as list_images has it), height, width, nChannels, data of each image, a row each; unreadable files are left out.

    places: a folder, or paths of files, of which only these are read and decoded.
    """
    paths = places if isinstance(places, str) else [re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in places]
    path = F.url_decode(F.replace(F.regexp_replace("image.origin", "^(\\w+):///", "$1:/"), F.lit("+"), F.lit("%2B")))
    return spark.read.format("image").option("dropInvalid", True).load(paths).select(path.alias("image_id"), "image.height", "image.width", "image.nChannels", "image.data")


def read_pixels(spark: SparkSession, places: str | list[str]) -> DataFrame:
    """image_id (the path, as list_images has it), y, x, r, g, b in [0, 1] of each pixel; grey is repeated, alpha dropped, unreadable files left out.

    places: as for read_images.
    """
    return pixels_of(read_images(spark, places))


def pixels_of(images: DataFrame) -> DataFrame:
    """The pixels of images, as read_images has them, as image_id (of its type there), y, x, r, g, b. What is to be joined with images is joined before."""
    kind = images.schema["image_id"].dataType

    def unpack(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                h, w, n = (batch.column(k)[i].as_py() for k in range(1, 4))
                flat = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint8).reshape(h * w, n)
                for a in range(0, h * w, PIXELS_AT_ONCE):
                    p = flat[a : a + PIXELS_AT_ONCE, [0, 0, 0] if n == 1 else [2, 1, 0]] / 255.0
                    y, x = np.divmod(np.arange(a, a + len(p), dtype=np.int32), np.int32(w))
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[i], len(p)), pa.array(y), pa.array(x), *(pa.array(p[:, k]) for k in range(3))], names=["image_id", "y", "x", "r", "g", "b"])

    columns = images.select("image_id", "height", "width", "nChannels", "data")
    return columns.mapInArrow(unpack, f"image_id {kind.simpleString()}, y int, x int, r double, g double, b double")


def _png(levels: np.ndarray) -> bytes:
    """A file of 8-bit RGB rows (height, width, 3)."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    height, width = levels.shape[:2]
    rows = np.zeros((height, 1 + 3 * width), np.uint8)  # each row begins with its filter: none
    rows[:, 1:] = levels.reshape(height, -1)
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def write_png(pixels: DataFrame, folder: str, name: Column | None = None) -> DataFrame:
    """Write the images of pixels (image_id, y, x, r, g, b in [0, 1]) as PNG files of a folder that all executors reach; name is the file's, without its
    extension (image_id, unless given). Returns name, path, height, width of each.

    Pixels that aren't there, and null channels, are black. An image is encoded in one task, its pixels cut to 8 bits before they are sent there.
    A file is written whole under a name that isn't an image's and then moved, so a task that is repeated leaves the same file.
    """
    uri = re.sub("^file:/+", "file:///", folder)
    levels = [F.coalesce(quantize(F.col(c)), F.lit(0)).cast("int").alias(c) for c in "rgb"]
    cells = pixels.select((F.col("image_id") if name is None else name).cast("string").alias("name"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *levels)

    def run(key: tuple, image: pa.Table) -> pa.Table:
        y, x = (image.column(c).to_numpy() for c in "yx")
        frame = np.zeros((int(y.max()) + 1, int(x.max()) + 1, 3), np.uint8)
        for k, c in enumerate("rgb"):
            frame[y, x, k] = image.column(c).to_numpy()
        out, base = pafs.FileSystem.from_uri(uri)
        out.create_dir(base, recursive=True)
        file = key[0].as_py() + ".png"
        waiting = f"{base}/.{file}.{uuid.uuid4().hex}"
        with out.open_output_stream(waiting) as stream:
            stream.write(_png(frame))
        out.move(waiting, f"{base}/{file}")
        return pa.table({"name": [key[0].as_py()], "path": [f"{folder}/{file}"], "height": pa.array([frame.shape[0]], pa.int32()), "width": pa.array([frame.shape[1]], pa.int32())})

    return cut(cells.where("name IS NOT NULL AND y >= 0 AND x >= 0").groupBy("name").applyInArrow(run, "name string, path string, height int, width int"))


def scan_presets(spark: SparkSession, folder: str) -> DataFrame:
    """path and preset (PRESET) of each file; one that is no JSON object becomes an empty preset."""
    return presets_of(spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")).drop("value")


def presets_of(texts: DataFrame) -> DataFrame:
    """texts with the preset that their value has; an empty one if that is no JSON object."""
    whole = F.from_json("value", PRESET, {"mode": "PERMISSIVE"})
    return texts.withColumn("preset", F.coalesce(F.when(F.try_parse_json("value").isNotNull(), whole), F.from_json(F.lit("{}"), PRESET)))


def scan_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's records; blank and malformed lines are skipped."""
    return spark.read.schema(LEDGER).option("mode", "DROPMALFORMED").json(path)


def append_ledger(outcomes: DataFrame, path: str) -> None:
    """Append records as JSON lines with the ledger's fields in sorted order."""
    outcomes.select(*LEDGER_FIELDS).write.mode("append").json(path)


def scan_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """The job records, newest name first; job_id defaults to the file's stem; malformed files are skipped."""
    jobs = spark.read.schema(JOB).option("multiLine", True).option("mode", "DROPMALFORMED").json(folder)
    jobs = jobs.select(*[f.name for f in JOB.fields], F.col("_metadata.file_path").alias("path"))
    return jobs.withColumn("job_id", F.coalesce("job_id", stem(F.col("path")))).orderBy(F.desc("path"))


def scan_jobs_lines(spark: SparkSession, path: str) -> DataFrame:
    """Job records kept one to a line, as large job tables are; malformed lines are skipped."""
    return spark.read.schema(JOB).option("mode", "DROPMALFORMED").json(path)


def scan_luts(spark: SparkSession, folder: str) -> DataFrame:
    """lut_id, size, ri, gi, bi, r, g, b of .cube files; red's index runs fastest; lut_id is the title, or the file's stem. Files that aren't 3-D or lack rows are left out."""
    text = spark.read.text(folder, wholetext=True).select(F.coalesce(F.nullif(F.regexp_extract("value", r'(?m)^\s*TITLE\s+"([^"]*)"', 1), F.lit("")), stem(F.col("_metadata.file_path"))).alias("lut_id"), "value")
    text = text.withColumn("size", F.regexp_extract("value", r"(?m)^\s*LUT_3D_SIZE\s+(\d+)", 1).try_cast("int"))
    rows = F.filter(F.transform(F.split("value", r"\r?\n"), lambda s: F.trim(s)), lambda s: s.rlike(r"^[-+.\d]\S*\s+\S+\s+\S+$"))
    text = text.withColumn("rows", rows).where((F.col("size") > 1) & (F.size("rows") == F.col("size") * F.col("size") * F.col("size")) & ~F.col("value").rlike(r"(?m)^\s*LUT_1D_SIZE"))
    each = text.select("lut_id", "size", F.posexplode("rows").alias("k", "row")).withColumn("v", F.split("row", r"\s+"))
    n = F.col("size")
    index = [F.pmod(F.col("k"), n), F.pmod(F.floor(F.col("k") / n), n), F.floor(F.col("k") / (n * n))]
    return each.select("lut_id", "size", *[i.cast("int").alias(c) for i, c in zip(index, ("ri", "gi", "bi"))], *[F.get("v", F.lit(k)).cast("double").alias(c) for k, c in enumerate("rgb")])


def pack_plane(plane: np.ndarray) -> dict:
    return {"shape": list(plane.shape), "dtype": str(plane.dtype), "data": base64.b64encode(zlib.compress(plane.tobytes())).decode()}


def scan_saved_masks(spark: SparkSession, folder: str) -> DataFrame:
    """image_id, face_id, layer, y, x, v of the masks in project files: image_path, and faces, a list of packed planes by layer."""
    return masks_of(spark.read.text(folder, wholetext=True))


def masks_of(projects: DataFrame) -> DataFrame:
    """The masks of project texts (value); texts that aren't JSON have none."""

    def unpack(batches):
        for batch in batches:
            for value in batch["value"]:
                try:
                    project = json.loads(value)
                except ValueError:
                    continue
                for face, layers in enumerate(project.get("faces") or []):
                    for layer, packed in sorted(layers.items()):
                        m = np.frombuffer(zlib.decompress(base64.b64decode(packed["data"])), packed["dtype"]).reshape(packed["shape"])
                        h, w = m.shape
                        yield pd.DataFrame({"image_id": project.get("image_path"), "face_id": face, "layer": layer, "y": np.repeat(np.arange(h), w), "x": np.tile(np.arange(w), h), "v": m.ravel().astype(float)})

    return projects.mapInPandas(unpack, "image_id string, face_id int, layer string, y int, x int, v double")


def store_pixels(pixels: DataFrame, path: str, buckets: int = 64) -> None:
    """Write pixels as Parquet under bucket=...; a bucket has whole images."""
    pixels.withColumn("bucket", F.pmod(F.hash("image_id"), F.lit(buckets))).repartition("bucket").write.partitionBy("bucket").parquet(path)
