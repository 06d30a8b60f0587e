"""Settings of a session, validated, as Spark configuration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from .options import CODECS, _within


@dataclass(frozen=True)
class Settings:
    compression: str = "zstd"
    compression_level: int = 3
    stripe_row_limit: int = 150_000
    chunk_group_row_limit: int = 10_000
    parallel: bool = True
    min_parallel_processes: int = 8
    vectorization: bool = True
    qual_pushdown: bool = True
    column_cache_mb: int = 0

    def __post_init__(self):
        if self.compression not in CODECS:
            raise ValueError(f"unknown compression {self.compression!r}")
        _within("compression_level", self.compression_level, 1, 19)
        _within("stripe_row_limit", self.stripe_row_limit, 1000, 100_000_000)
        _within("chunk_group_row_limit", self.chunk_group_row_limit, 1000, 100_000_000)
        _within("min_parallel_processes", self.min_parallel_processes, 1, 32)
        if self.column_cache_mb:
            _within("column_cache_mb", self.column_cache_mb, 20, 20_000)

    def conf(self) -> dict[str, str]:
        on = lambda x: str(x).lower()
        return {
            "spark.sql.session.timeZone": "UTC",
            "spark.sql.ansi.enabled": "true",
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.parquet.compression.codec": CODECS[self.compression],
            "spark.sql.files.maxRecordsPerFile": str(self.stripe_row_limit),
            "spark.sql.codegen.wholeStage": on(self.vectorization),
            "spark.sql.parquet.enableVectorizedReader": on(self.vectorization),
            "spark.sql.parquet.filterPushdown": on(self.qual_pushdown),
            "spark.sql.shuffle.partitions": str(self.min_parallel_processes if self.parallel else 1),
        }

    def apply(self, spark: SparkSession) -> SparkSession:
        for k, v in self.conf().items():
            spark.conf.set(k, v)
        return spark
