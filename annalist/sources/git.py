"""History of a local git repository as a batch source: ``spark.read.format("git_history")``.

Options: ``path`` (a clone that all executors can read), ``max_count``,
``since_sha``, ``per_task`` (commits per partition, 200).  Diffs go from the first
parent to the commit; a commit without parents is compared with the empty tree.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from annalist import schemas

EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"


def _git(path: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", path, *args], capture_output=True, check=True)
    return done.stdout.decode("utf-8", "replace")


class _Shas(InputPartition):
    def __init__(self, shas: list[str]):
        super().__init__(shas)
        self.shas = shas


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.most = options.get("max_count")
        self.since = options.get("since_sha")
        self.per_task = int(options.get("per_task", 200))

    def partitions(self) -> list[InputPartition]:
        limit = [f"--max-count={self.most}"] if self.most else []
        shown = [f"{self.since}..HEAD"] if self.since else ["HEAD"]
        shas = _git(self.path, "rev-list", *limit, *shown).split()
        return [_Shas(shas[i : i + self.per_task]) for i in range(0, len(shas), self.per_task)]

    def read(self, partition: _Shas) -> Iterator[tuple]:
        for sha in partition.shas:
            yield self._commit(sha)

    def _commit(self, sha: str) -> tuple:
        head = _git(self.path, "show", "-s", "--format=%P%x00%an%x00%ae%x00%aI%x00%B", sha)
        parents, name, email, when, message = head.split("\x00", 4)
        old = parents.split()[0] if parents else EMPTY_TREE
        changes, diff = [], ""
        try:
            counts = _git(self.path, "diff", "--numstat", "--no-renames", old, sha).splitlines()
            kinds = dict(
                reversed(x.split("\t", 1)) for x in _git(self.path, "diff", "--name-status", "--no-renames", old, sha).splitlines()
            )
            for line in counts:
                added, removed, file = line.split("\t", 2)
                n, m = (0 if x == "-" else int(x) for x in (added, removed))
                changes.append((file, file, file, kinds.get(file, "M")[:1], n, m))
            diff = _git(self.path, "diff", "--no-renames", "--no-color", old, sha)
        except subprocess.CalledProcessError:
            changes, diff = [], ""
        stats = (len(changes), sum(c[4] for c in changes), sum(c[5] for c in changes))
        return sha, name, email, when, message.rstrip("\n"), [c[0] for c in changes], diff, changes, stats


class GitHistory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return schemas.COMMIT

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitHistory)
