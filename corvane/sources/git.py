"""Histories as tables: commits, lines added by each, and the commit of each line, read by git in the executors."""

from __future__ import annotations

import json
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corvane.runtime import ship

SCHEMAS = {
    "commits": "repo string, sha string, ct long, author string, committer string, message string, on_head boolean",
    "numstat": "repo string, sha string, rel string, added long, deleted long",
    "blame": "repo string, rel string, line int, sha string",
}


def git(root: str, *args: str) -> str:
    """What a git command prints, empty if it fails; never asks and reads no settings of the repository's owner."""
    run = subprocess.run(["git", "-c", "safe.directory=*", "-c", "core.quotepath=off", "-C", root, *args], capture_output=True, timeout=600, env={"GIT_TERMINAL_PROMPT": "0", "GIT_CONFIG_NOSYSTEM": "1", "PATH": "/usr/local/bin:/usr/bin:/bin", "LC_ALL": "C.UTF-8"})
    return run.stdout.decode("utf-8", "replace") if run.returncode == 0 else ""


def tracked(root: str) -> list[str]:
    return [x for x in git(root, "ls-files", "-z").split("\0") if x]


def commits(root: str):
    head = set(git(root, "rev-list", "HEAD").split())
    for entry in git(root, "log", "--all", "--format=%H%x00%ct%x00%an <%ae>%x00%cn <%ce>%x00%B%x01").split("\x01"):
        if entry := entry.strip("\n"):
            sha, when, author, committer, message = (entry.split("\0", 4) + [""] * 4)[:5]
            yield sha.strip(), int(when) if when.isdigit() else 0, author, committer, message, sha.strip() in head


def numstat(root: str):
    for entry in git(root, "log", "HEAD", "--no-merges", "--numstat", "--no-renames", "--format=%x01%H").split("\x01"):
        sha, _, rest = entry.strip("\n").partition("\n")
        for line in rest.split("\n"):
            added, deleted, rel = ([*line.split("\t", 2), "", ""])[:3]
            if rel:
                yield sha.strip(), rel, int(added) if added.isdigit() else None, int(deleted) if deleted.isdigit() else None


def blame(root: str, rel: str):
    for line in git(root, "blame", "--porcelain", "--", rel).split("\n"):
        if m := re.match(r"^([0-9a-f]{40}) \d+ (\d+)", line):
            yield int(m[2]), m[1]


class _Part(InputPartition):
    def __init__(self, repo: str, root: str, rels: list[str]):
        self.repo, self.root, self.rels = repo, root, rels


class GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.kind, self.roots, self.step = options.get("kind", "commits"), json.loads(options["roots"]), int(options.get("filesperpartition", 64))

    def partitions(self):
        out = []
        for repo, root in sorted(self.roots.items()):
            files = tracked(root)
            if not files:
                continue  # no history of its own: a folder inside another repository
            if self.kind == "blame":
                out += [_Part(repo, root, files[i : i + self.step]) for i in range(0, len(files), self.step)]
            else:
                out.append(_Part(repo, root, []))
        return out or [_Part("", "", [])]

    def read(self, p):
        if not p.root:
            return
        if self.kind == "blame":
            for rel in p.rels:
                for line, sha in blame(p.root, rel):
                    yield p.repo, rel, line, sha
        else:
            for row in (commits if self.kind == "commits" else numstat)(p.root):
                yield (p.repo, *row)


class GitSource(DataSource):
    """Options: roots (JSON, repo -> path), kind = commits, numstat or blame, filesperpartition."""

    @classmethod
    def name(cls):
        return "git"

    def schema(self):
        return SCHEMAS[self.options.get("kind", "commits")]

    def reader(self, schema):
        return GitReader(self.options)


def read_git(spark: SparkSession, roots: dict[str, str], kind: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(GitSource)
    return spark.read.format("git").option("roots", json.dumps(roots)).option("kind", kind).load()
