"""Header lines of text formats, read by the driver from the head of a file."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_FIELD = re.compile(r'(\w+)=("(?:[^"\\]|\\.)*"|[^,]*)')
MAX_HEADER_LINES = 1_000_000


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def header_lines(spark: SparkSession, path: str, mark: str) -> list[str]:
    """The lines that start with `mark` before the first other line of the file, of a folder's or pattern's first file by name.

    Read through the Hadoop file system, compressed files too; no more of the
    file is read than its header.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsparkSession.sessionState().newHadoopConf()
    where = hadoop.fs.Path(path)
    system = where.getFileSystem(conf)
    files = []
    for status in system.globStatus(where) or []:
        files += system.listStatus(status.getPath()) if status.isDirectory() else [status]
    paths = sorted((f.getPath() for f in files if not f.isDirectory() and f.getPath().getName()[0] not in "._"), key=lambda p: p.toString())
    if not paths:
        raise FileNotFoundError(path)
    codec = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(paths[0])
    stream = system.open(paths[0])
    java = spark._jvm.java.io
    reader = java.BufferedReader(java.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
    found = []
    try:
        line = reader.readLine()
        while line is not None and (line.startswith(mark) or not line):
            if len(found) >= MAX_HEADER_LINES:
                raise ValueError("the header is too long")
            found += [line] if line else []
            line = reader.readLine()
    finally:
        reader.close()
    return found


def structured(lines: list[str], key: str, required: tuple[str, ...]) -> list[dict[str, str]]:
    """The fields of ``##key=<a=1,b="x">`` lines."""
    out = []
    for line in lines:
        m = re.match(rf"##{key}=<(.*)>\s*$", line)
        if m:
            fields = {k: v[1:-1].replace('\\"', '"') if v.startswith('"') else v for k, v in _FIELD.findall(m[1])}
            missing = [r for r in required if r not in fields]
            if missing:
                raise ValueError(f"header {key} line lacks {', '.join(missing)}")
            out.append(fields)
    return out
