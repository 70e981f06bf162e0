"""File listings, frame names, dense arrays, refreshes and release manifests."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def refresh(listing: DataFrame, loaded: DataFrame) -> DataFrame:
    """Files that are new or changed since they were loaded; ``loaded`` is (path, modified)."""
    seen = loaded.select("path", F.col("modified").alias("_seen"))
    return listing.join(seen, "path", "left").where(F.col("_seen").isNull() | (F.col("modified") > F.col("_seen"))).drop("_seen")


def path_parts(listing: DataFrame) -> DataFrame:
    """Add factory, seed and file from ``…/<factory>/<seed>/<file>``."""
    cut = F.split("path", "/")
    return listing.withColumns({"factory": F.element_at(cut, -3), "seed": F.element_at(cut, -2), "file": F.element_at(cut, -1)})


TEXTURE_KINDS = ("color", "roughness", "normalgl", "metalness", "displacement")


def texture_sets(listing: DataFrame) -> DataFrame:
    """(category, set, kind, path) of texture images ``…/<category>/<set>/…_<kind>….jpg``; a set needs a colour image."""
    cut = F.split("path", "/")
    kind = F.regexp_extract(F.lower(F.element_at(cut, -1)), f"_({'|'.join(TEXTURE_KINDS)}).*\\.jpg$", 1)
    rows = listing.select(F.element_at(cut, -3).alias("category"), F.element_at(cut, -2).alias("set"), kind.alias("kind"), "path").where("kind <> ''")
    usable = rows.where("kind = 'color'").select("category", "set").distinct()
    return rows.join(usable, ["category", "set"], "left_semi")


def model_rows(texts: DataFrame, category: str | None = None) -> DataFrame:
    """(category, model, folder) of ``…/<dir>/meta.json`` documents; broken ones are skipped, a missing id is the folder name."""
    cut = F.split("path", "/")
    meta = texts.where(F.try_parse_json("text").isNotNull()).select(
        F.from_json("text", "model_cat string, anno_id string").alias("m"), F.element_at(cut, -2).alias("folder"))
    rows = meta.select(F.coalesce("m.model_cat", F.lit("")).alias("category"), F.coalesce("m.anno_id", "folder").alias("model"), "folder")
    return rows if category is None else rows.where(F.col("category") == category)


def camera_rows(cams: DataFrame, keys: list[str]) -> DataFrame:
    """Flat camera columns from row-major K (9), T (16, camera to world) and hw arrays."""
    k, t = F.col("K"), F.col("T")
    turn = [t[4 * i + j].alias(f"r{3 * i + j}") for i in range(3) for j in range(3)]
    return cams.select(*keys, k[0].alias("fx"), k[4].alias("fy"), k[2].alias("cx"), k[5].alias("cy"), *turn,
                       *[t[4 * i + 3].alias(f"t{i}") for i in range(3)], F.col("hw")[0].alias("height"), F.col("hw")[1].alias("width"))


def frame_name(name: Column, strict: bool = True) -> Column:
    """struct(dtype, rig, resample, frame, subcam, ext) of a frame file name; null when tokens are missing.

    More tokens than the format has are an error when strict.
    """
    stem, ext = F.substring_index(name, ".", 1), F.regexp_extract(name, r"\.([^.]+)$", 1)
    tok = F.split(F.regexp_replace(stem, "^_+|_+$", ""), "_")
    n = F.size(tok)
    def at(i: int) -> Column:
        return F.try_element_at(tok, F.lit(i)).try_cast("bigint")
    parsed = F.struct(F.when(n == 5, F.get(tok, F.lit(0))).alias("dtype"), at(-4).alias("rig"), at(-3).alias("resample"),
                      at(-2).alias("frame"), at(-1).alias("subcam"), ext.alias("ext"))
    out = F.when(n.isin(4, 5), parsed)
    return F.when(n > 5, F.raise_error(F.concat(F.lit("too many tokens in frame name "), name))).otherwise(out) if strict else out


def encode_arrays(tiles: DataFrame, keys: list[str], values: str, shape: tuple[int, ...]) -> DataFrame:
    """(keys…, content): flat float arrays as npy bytes."""
    def run(batches):
        for pdf in batches:
            out = pdf[keys].copy()
            blobs = []
            for v in pdf[values]:
                buf = io.BytesIO()
                np.save(buf, np.asarray(v, dtype=np.float32).reshape(shape))
                blobs.append(buf.getvalue())
            out["content"] = blobs
            yield out

    schema = ", ".join(f"{k} {tiles.schema[k].dataType.simpleString()}" for k in keys)
    return tiles.select(*keys, values).mapInPandas(run, f"{schema}, content binary")


#: Pixels that leave a task together.
TOGETHER = 1 << 16


def pixel_frames(keys: list[str]) -> Callable[[pd.DataFrame], Iterator[pd.DataFrame]]:
    """Decoded pixels of a batch of frames: small frames leave together, a large one alone, so no batch is held as pixels."""
    def decoded(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        places, held, rows = {}, [], 0

        def together() -> pd.DataFrame:
            own = pdf[keys].iloc[np.repeat([i for i, *_ in held], [v.size for *_, v in held])].reset_index(drop=True)
            y, x, c = np.concatenate([places[shape] for _, shape, _ in held], axis=1)
            return own.assign(y=y, x=x, c=c, value=np.concatenate([v for *_, v in held]))

        for i, content in enumerate(pdf["content"]):
            data = np.load(io.BytesIO(content), allow_pickle=False)
            if isinstance(data, np.lib.npyio.NpzFile):
                data = data["vals"][data["indices"]]
            data = data.reshape(*data.shape[:2], -1)
            if held and rows + data.size > TOGETHER:
                yield together()
                places, held, rows = {}, [], 0
            if data.shape not in places:
                places[data.shape] = np.indices(data.shape).reshape(3, -1)
            held.append((i, data.shape, data.astype(np.float64).ravel()))
            rows += data.size
        if held:
            yield together()

    return decoded


def decode_arrays(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, y, x, c, value): npy and npz frames as pixels; dictionary-coded masks are expanded.

    ``files`` carries the bytes in ``content``. A file is one frame.
    """
    decoded = pixel_frames(keys)

    def run(batches):
        for pdf in batches:
            yield from decoded(pdf)

    schema = ", ".join(f"{k} {files.schema[k].dataType.simpleString()}" for k in keys)
    return files.select(*keys, "content").mapInPandas(run, f"{schema}, y bigint, x bigint, c bigint, value double")


def release_selection(wanted: DataFrame, released: DataFrame, keys: list[str]) -> DataFrame:
    """File names of wanted (seed, camera, dtype) rows; a row missing in the release is an error."""
    have = released.select(*keys).distinct().withColumn("_ok", F.lit(True))
    name = F.concat_ws("_", *[F.col(k).cast("string") for k in keys])
    return wanted.join(have, keys, "left").select(*keys, F.when(F.col("_ok"), name).otherwise(
        F.raise_error(F.concat(F.lit("not in the release: "), name)).cast("string")).alias("file"))


def release_gaps(wanted: DataFrame, released: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(released, keys, "left_anti")
