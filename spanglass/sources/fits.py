"""FITS images as pixels: a Spark data source in Python, one partition for each block of image rows.

``spark.dataSource.register(FitsSource)``, then ``spark.read.format("fits").load(path)`` gives
(i0, i1, i2, value) with i0 the fastest axis.  The path is any URI that the executors reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CARD, BLOCK = 80, 2880
#: Fixed values of the FITS standard: BITPIX to big-endian types.
TYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
ROWS = 1 << 20  # pixels of a partition, about


def parse_header(data: bytes) -> tuple[dict, int]:
    """Keywords of the primary header and where its data begin."""
    head, at = {}, 0
    while at + CARD <= len(data):
        card = data[at : at + CARD].decode("ascii")
        at += CARD
        key = card[:8].strip()
        if key == "END":
            return head, -(-at // BLOCK) * BLOCK
        if card[8:10] == "= ":
            text = card[10:].strip()
            if text.startswith("'"):
                head[key] = text[1:].split("'")[0].rstrip()
            else:
                text = text.split("/")[0].strip()
                head[key] = text == "T" if text in "TF" and text else float(text.replace("D", "E")) if any(c in text for c in ".ED") else int(text) if text else None
    raise ValueError("the header has no END")


def read_header(path: str) -> tuple[dict, int]:
    store, name = pafs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        data = b""
        while b"END" + b" " * 77 not in data:
            more = f.read(BLOCK)
            if not more:
                break
            data += more
    return parse_header(data)


class _Part(InputPartition):
    def __init__(self, first: int, n: int):
        super().__init__((first, n))
        self.first, self.n = first, n


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.head, self.start = read_header(path)
        self.shape = [self.head[f"NAXIS{i + 1}"] for i in range(self.head["NAXIS"])]
        if len(self.shape) > 3 and prod(self.shape[3:]) != 1:
            raise ValueError("images of up to three axes are read")

    def partitions(self) -> list[InputPartition]:
        total = prod(self.shape) if self.shape else 0
        return [_Part(i, min(ROWS, total - i)) for i in range(0, total, ROWS)] or [_Part(0, 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(TYPES[self.head["BITPIX"]])
        store, name = pafs.FileSystem.from_uri(self.path)
        with store.open_input_file(name) as f:
            f.seek(self.start + partition.first * kind.itemsize)
            raw = np.frombuffer(f.read(partition.n * kind.itemsize), kind)
        value = raw.astype(np.float64) * float(self.head.get("BSCALE", 1)) + float(self.head.get("BZERO", 0))
        if "BLANK" in self.head and kind.kind != "f":
            value = np.where(raw == self.head["BLANK"], np.nan, value)
        at = partition.first + np.arange(len(raw))
        n0, n1 = (*self.shape, 1, 1)[:2]
        yield pa.RecordBatch.from_arrays([pa.array((at % n0).astype(np.int32)), pa.array((at // n0 % n1).astype(np.int32)), pa.array((at // (n0 * n1)).astype(np.int32)), pa.array(value)], ["i0", "i1", "i2", "value"])


class FitsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return "i0 int, i1 int, i2 int, value double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def write_image(pixels: DataFrame, path: str, shape: list[int], keywords: dict | None = None, limit: int = 1 << 28) -> None:
    """One file of doubles; an image of over ``limit`` pixels isn't one file's work and raises.

    Pixels are (i0, i1, i2, value); missing ones are NaN.  Planes come to the driver one partition at a time.
    """
    if prod(shape) > limit:
        raise ValueError(f"over {limit} pixels")
    n0, n1, n2 = (*shape, 1, 1)[:3]
    cube = np.full(n0 * n1 * n2, np.nan, ">f8")
    for r in pixels.select("i0", "i1", "i2", "value").toLocalIterator():
        cube[r.i0 + n0 * (r.i1 + n1 * r.i2)] = np.nan if r.value is None else r.value
    cards = {"SIMPLE": True, "BITPIX": -64, "NAXIS": len(shape)} | {f"NAXIS{i + 1}": n for i, n in enumerate(shape)} | (keywords or {})
    show = lambda v: f"{'T' if v else 'F':>20}" if isinstance(v, bool) else f"'{v:<8}'" if isinstance(v, str) else f"{v!r:>20}"
    head = "".join(f"{k:<8}= {show(v)}"[:CARD].ljust(CARD) for k, v in cards.items()) + "END".ljust(CARD)
    body = cube.tobytes()
    store, name = pafs.FileSystem.from_uri(path)
    with store.open_output_stream(name) as f:
        f.write(head.encode().ljust(-(-len(head) // BLOCK) * BLOCK))
        f.write(body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0"))
