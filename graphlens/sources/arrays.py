"""``.npy`` matrices as DataFrames and back: two-dimensional little-endian float32 in C order."""

from __future__ import annotations

import ast
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x93NUMPY"


def read_header(data: bytes) -> tuple[int, int, int]:
    """Rows, columns and where the numbers begin; anything else but such a matrix is an error."""
    if data[:6] != MAGIC or data[6] not in (1, 2):
        raise ValueError("not a version 1 or 2 array file")
    wide = data[6] == 2
    size = struct.unpack_from("<I" if wide else "<H", data, 8)[0]
    at = (12 if wide else 10) + size
    head = ast.literal_eval(data[12 if wide else 10 : at].decode("latin1").strip())
    if head["descr"] != "<f4" or head["fortran_order"] or len(head["shape"]) != 2:
        raise ValueError("only two-dimensional little-endian float32 in C order")
    return head["shape"][0], head["shape"][1], at


def to_bytes(matrix: np.ndarray) -> bytes:
    """Version 1 file of a matrix, data aligned to 64 bytes."""
    m = np.ascontiguousarray(matrix, dtype="<f4")
    head = f"{{'descr': '<f4', 'fortran_order': False, 'shape': ({m.shape[0]}, {m.shape[1]}), }}".encode()
    head += b" " * (-(len(MAGIC) + 4 + len(head) + 1) % 64) + b"\n"
    return MAGIC + b"\x01\x00" + struct.pack("<H", len(head)) + head + m.tobytes()


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """``(path, row, vec)`` of every file; rows stream out in slices."""

    def run(batches):
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"]):
                n, d, at = read_header(data)
                m = np.frombuffer(data, dtype="<f4", count=n * d, offset=at).reshape(n, d)
                for s in range(0, n, 4096):
                    part = m[s : s + 4096]
                    yield pd.DataFrame({"path": p, "row": np.arange(s, s + len(part)), "vec": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row long, vec array<float>")


def slice_npy(vectors: DataFrame, rows: DataFrame) -> DataFrame:
    """One row ``content``: the file of the wanted ``rows(row, place)`` in order of place."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        return pd.DataFrame({"content": [to_bytes(np.stack(pdf["vec"].to_numpy()))]})

    return vectors.join(rows, "row").select("place", "vec", F.lit(1).alias("one")).groupBy("one").applyInPandas(pack, "content binary")
