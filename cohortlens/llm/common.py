"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

import cohortlens
from cohortlens.sources.staging import record, scratch_path

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, as ``--py-files`` does, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(cohortlens.__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="cohortlens-code-"), "cohortlens.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(os.path.dirname(os.path.abspath(cohortlens.__file__))):
            for name in sorted(n for n in names if n.endswith(".py")):
                out.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), root))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged_path(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back; also the path, for ``drop_path``."""
    path = record(scratch_path(df.sparkSession, name))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, name: str) -> DataFrame:
    return staged_path(df, name)[0]


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a staged table through the file system it lies on."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Bytes that end a word (ASCII other than letters and digits) as blanks, A-Z as a-z; all others as they are.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Bytes of a text that are split at a time.
PORTION = 1 << 22


def word_portions(text: bytes) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text (runs of ASCII letters, lower-cased, digits and all points from U+0080 on), a portion at a time."""
    at = 0
    while len(text) - at > PORTION:
        clean = text[at : at + PORTION].translate(_WORD_BYTES)
        end = clean.rfind(b" ") + 1
        while not end and at + len(clean) < len(text):
            # A word longer than a portion.
            clean = text[at : at + 2 * len(clean)].translate(_WORD_BYTES)
            end = clean.rfind(b" ") + 1
        if not end:
            break
        yield clean[:end].split()
        at += end
    yield text[at:].translate(_WORD_BYTES).split()
