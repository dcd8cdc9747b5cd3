"""Table functions for SQL: rows from arguments and tables, where a column expression can't make them."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import DoubleType, IntegerType, StructType


def _starts(length: int, tile: int, stride: int) -> list[int]:
    """Where tiles begin; the last one ends at the edge."""
    starts = list(range(0, max(length - tile, 0) + 1, stride))
    return starts if starts[-1] + tile >= length else [*starts, length - tile]


class TileCorners:
    """``scene_id, y, x``: upper left corners of overlapping tiles of the scenes of a table (``scene_id, height, width``).

    ``SELECT * FROM tile_corners(TABLE(scenes) PARTITION BY scene_id, tile => 256, overlap => 32)``.  The type of ``scene_id`` is
    that of the table; what is wrong with the arguments is said before anything runs.
    """

    @staticmethod
    def analyze(scenes: AnalyzeArgument, tile: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        if not scenes.isTable:
            raise ValueError("the first argument of tile_corners is a table")
        names = scenes.dataType.fieldNames()
        if missing := [n for n in ("scene_id", "height", "width") if n not in names]:
            raise ValueError(f"tile_corners needs {missing} in its table, which has {names}")
        if tile.value is None or overlap.value is None or not 0 <= overlap.value < tile.value:
            raise ValueError("tile_corners needs constants with 0 <= overlap < tile")
        return AnalyzeResult(StructType().add("scene_id", scenes.dataType["scene_id"].dataType).add("y", IntegerType()).add("x", IntegerType()))

    def eval(self, scenes, tile, overlap):
        if scenes["height"] is None or scenes["width"] is None:
            return
        xs = _starts(scenes["width"], tile, tile - overlap)
        for y in _starts(scenes["height"], tile, tile - overlap):
            for x in xs:
                yield scenes["scene_id"], y, x


class GridPoints:
    """``scene_id, i, j, lat, lon``: points of a regular grid over the boxes of a table (``scene_id, west, south, east, north``),
    from the south-west corner on, ``step`` degrees apart."""

    @staticmethod
    def analyze(boxes: AnalyzeArgument, step: AnalyzeArgument) -> AnalyzeResult:
        if step.value is None or step.value <= 0:
            raise ValueError("grid_points needs a positive constant step")
        return AnalyzeResult(StructType().add("scene_id", boxes.dataType["scene_id"].dataType).add("i", IntegerType()).add("j", IntegerType()).add("lat", DoubleType()).add("lon", DoubleType()))

    def eval(self, boxes, step):
        step = float(step)
        rows, cols = (int((boxes[b] - boxes[a]) / step + 1e-9) + 1 for a, b in (("south", "north"), ("west", "east")))
        for i in range(rows):
            for j in range(cols):
                yield boxes["scene_id"], i, j, boxes["south"] + i * step, boxes["west"] + j * step


def register_tables(spark: SparkSession) -> None:
    """Make the table functions known to SQL of the session."""
    spark.udtf.register("tile_corners", udtf(TileCorners))
    spark.udtf.register("grid_points", udtf(GridPoints))
