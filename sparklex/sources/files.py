"""Single files by way of the session's file systems, so that a path may lie on any store that the executors share."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(path: str):
    """The file system and the path; the local one without its checksum files."""
    sc = SparkSession.builder.getOrCreate().sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(sc._jsc.hadoopConfiguration())
    return (system.getRawFileSystem() if system.getScheme() == "file" else system), at


def exists(path: str) -> bool:
    system, at = _place(path)
    return bool(system.exists(at))


def names(folder: str) -> list[str]:
    """Names of what is in the folder, sorted."""
    system, at = _place(folder)
    return sorted(s.getPath().getName() for s in system.listStatus(at))


def make_folder(folder: str) -> None:
    system, at = _place(folder)
    system.mkdirs(at)


def write_bytes(path: str, content: bytes) -> None:
    system, at = _place(path)
    out = system.create(at, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def write_text(path: str, text: str) -> None:
    write_bytes(path, text.encode())


def read_bytes(path: str) -> bytes:
    """A file that is small by its nature."""
    return bytes(SparkSession.builder.getOrCreate().read.format("binaryFile").load(path).first()["content"])


def one_file(write, path: str) -> None:
    """Calls write with a folder beside the path and moves its one part file to the path; without a part it is empty."""
    folder = f"{path}.parts"
    write(folder)
    parts = [n for n in names(folder) if n.startswith("part-")]
    if len(parts) > 1:
        raise ValueError(f"{path}: {len(parts)} part files")
    system, at = _place(path)
    if parts:
        system.delete(at, False)
        system.rename(_place(f"{folder}/{parts[0]}")[1], at)
    else:
        write_bytes(path, b"")
    system.delete(_place(folder)[1], True)
