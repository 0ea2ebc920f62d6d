"""Binary files that tasks write to the shared folder."""

from collections.abc import Callable

from pyarrow import fs
from pyspark import TaskContext


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, also by the names that Spark has for S3, and the place in it."""
    scheme, sign, rest = path.partition("://")
    if not sign:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(f"{({'s3a': 's3', 's3n': 's3'}).get(scheme, scheme)}://{rest}")


def write_file(path: str, content: bytes) -> None:
    """Write under a name of this task attempt, then rename: a repeated or parallel attempt
    leaves one whole file."""
    system, target = file_system(path)
    context = TaskContext.get()
    draft = f"{target}.{context.taskAttemptId() if context else 0}.draft"
    with system.open_output_stream(draft) as out:
        out.write(content)
    if system.type_name != "local" and system.get_file_info(target).type != fs.FileType.NotFound:
        system.delete_file(target)
    system.move(draft, target)


def make_folder(path: str) -> None:
    system, target = file_system(path)
    system.create_dir(target, recursive=True)


def shard_names(folder: str, suffix: str) -> Callable[[int], str]:
    """Names by partition and running number, so that a repeated task writes the same files."""
    part = TaskContext.get().partitionId()
    return lambda k: f"{folder}/part-{part:07d}-{k:05d}{suffix}"
