"""Shared helpers: table access, the cluster's shared folder, and retry-safe file output."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, shared_dir, work_dir, written  # noqa: F401

#: A word is a maximal run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, so that a session started anywhere can run it."""
    sc = spark.sparkContext
    if getattr(sc, "_trellis_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="trellis-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "trellis"), "zip", root, "trellis"))
    sc._trellis_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of a test table, nothing else, so the scan is pruned."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


_kept: list = []


def kept(make, *args):
    """make(*args), one object per worker process, so that what one task worked out serves the next. Workers outlive a stage:
    the object goes as another one is asked for, or by `release`."""
    if not _kept or _kept[0] != (make, args):
        release()
        _kept[:] = [(make, args), make(*args)]
    return _kept[1]


def release() -> None:
    """Let go of what another operator's tasks kept in this worker process."""
    _kept.clear()


def apart(spark: SparkSession, conf: dict[str, str]) -> SparkSession:
    """A session of the same application with spark's SQL settings and those of conf; spark's own stay as they are."""
    own = spark.newSession()
    for k, v in {**spark.conf.getAll, **conf}.items():
        if k.startswith("spark.sql.") and own.conf.isModifiable(k):
            own.conf.set(k, v)
    return own


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"{name}_{uuid.uuid4().hex}"


def row_key(*cols: str):
    """Column: 128 bits that stand for the values of cols, nulls included; the last one is a text."""
    *ids, text = cols
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ids] + [F.when(F.col(text).isNull(), "0").otherwise("1")]
    return F.unhex(F.md5(F.concat(F.concat_ws(":", *parts), F.coalesce(F.col(text), F.lit("")))))


def open_fs(uri: str):
    """(filesystem, path) for a URI on any filesystem that pyarrow knows."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + os.path.abspath(uri)
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, chunks) -> int:
    """Write chunks of bytes under a private name, then rename: a retried or speculative task can't leave half a file."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part, n = f"{path}.{uuid.uuid4().hex}", 0
    with fs.open_output_stream(part) as out:
        for c in chunks:
            out.write(c)
            n += len(c)
    try:
        fs.move(part, path)
    except OSError:  # some filesystems don't rename onto a file: an earlier attempt of this task had finished
        if fs.get_file_info(path).size != n:
            raise
        fs.delete_file(part)
    return n


def words(text):
    """Column: array of the words of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def n_words(text):
    """Column: number of words of a text (long); a null text has none."""
    return F.size(words(text)).cast("long")
