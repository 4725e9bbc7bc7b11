"""Commands of text programs (``.load_csv``, ``.load_atlas``) and table loaders."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, header: bool = True, schema: str | None = None, names: list[str] | None = None) -> DataFrame:
    """CSV or TSV, plain or gzipped; columns are positional in programs. The separator follows the file's name."""
    if sep is None:
        sep = "\t" if ".tsv" in path else ","
    reader = spark.read.option("sep", sep).option("header", header)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return df.toDF(*names) if names else df


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A label image exploded to voxel rows: parquet or delimited (i, j, k, label)."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if ".nii" in path:
        return _nifti(spark, path)
    return read_delimited(spark, path)


def _nifti(spark: SparkSession, path: str) -> DataFrame:
    """Non-zero voxels of NIfTI-1 images as (path, i, j, k, label); decoded on the executors."""
    import pandas as pd

    kinds = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}

    def run(batches):
        import gzip
        import struct

        import numpy as np

        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                data = gzip.decompress(raw) if name.endswith(".gz") else bytes(raw)
                end = "<" if struct.unpack("<i", data[:4])[0] == 348 else ">"
                dim = struct.unpack(end + "8h", data[40:56])
                kind = struct.unpack(end + "h", data[70:72])[0]
                at = int(struct.unpack(end + "f", data[108:112])[0])
                shape = dim[1:4]
                image = np.frombuffer(data, end + kinds[kind], int(np.prod(shape)), at).reshape(shape, order="F")
                i, j, k = np.nonzero(image)
                yield pd.DataFrame({"path": name, "i": i, "j": j, "k": k, "label": image[i, j, k].astype(float)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, i long, j long, k long, label double")


def register(engine: Any) -> None:
    def load_csv(path: str, name: str, sep: str | None = None, header: bool = True, **options: Any) -> None:
        engine.add_table(read_delimited(engine.spark, path, sep, bool(header), options.get("schema")), name)

    def load_atlas(path: str, name: str, labels: str | None = None) -> None:
        """(label, region) from a label image's voxels, optionally with names of labels (label, name)."""
        from clausewise.functions.spatial import register as register_directions
        from clausewise.functions.spatial import regions_of

        rows = regions_of(read_labels(engine.spark, path).filter(F.col("label") != 0), ["label"])
        if labels:
            names = read_delimited(engine.spark, labels).toDF("label", "name")
            rows = rows.join(names, "label").select(F.col("name").alias("label"), "region")
        register_directions(engine.functions)
        engine.add_table(rows, name, distinct=True)

    def load_parquet(path: str, name: str) -> None:
        engine.add_table(engine.spark.read.parquet(path), name)

    engine.commands |= {"load_csv": load_csv, "load_atlas": load_atlas, "load_parquet": load_parquet}
