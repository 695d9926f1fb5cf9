"""Repositories as tables: a Python data source that walks folders, prunes before it opens files, and reads in parallel.

Spark's own file sources hide names that start with _ or ., among them __init__.py and .github, so they can't serve.
    spark.dataSource.register(TreeSource)
    spark.read.format("repository").option("path", root).load()
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import tokenize

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corvane.functions import lookups as L
from corvane.functions import scalars as S
from corvane.runtime import ship

# --- fixed values: folders and suffixes that are never read
SKIP_FOLDERS = {".git", ".hg", ".svn", ".venv", "venv", "env", ".env", "node_modules", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".nox", "build", "dist", "site-packages", ".eggs"}
INDEX_SKIP_FOLDERS = {
    ".git", ".hg", ".svn", "node_modules", "bower_components", ".venv", "venv", "env", "site-packages", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox",
    ".nox", ".eggs", ".next", ".nuxt", ".svelte-kit", ".turbo", ".cache", ".parcel-cache", ".gradle", "Pods", "DerivedData", "target", "coverage",
}
BINARY_SUFFIXES = {
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".pdf", ".zip", ".gz", ".tar", ".whl", ".so", ".dylib", ".dll", ".exe", ".bin", ".pyc", ".db", ".sqlite", ".sqlite3", ".woff",
    ".woff2", ".ttf", ".otf", ".mp3", ".mp4", ".mov", ".onnx", ".pt", ".pkl", ".npy", ".parquet", ".lock",
}

SCHEMA = "repo string, rel string, size long, sha string, text string, lines long, binary boolean"


def skipped(parts: list[str], folders: set[str]) -> bool:
    """Whether a path has one of these folders, or the folder of an installed package's description, in it."""
    return not folders.isdisjoint(parts) or ".egg-info/" in "/".join(parts) + "/"


def decode(rel: str, data: bytes) -> str:
    """Python by its mark or coding line, all else as UTF-8; what can't be decoded is replaced."""
    encoding = "utf-8"
    if rel.endswith(".py"):
        try:
            encoding = tokenize.detect_encoding(io.BytesIO(data).readline)[0]
        except (SyntaxError, LookupError):
            pass
    text = data.decode(encoding, "replace")
    return text.replace("\r\n", "\n").replace("\r", "\n") if rel.endswith(".py") else text


def walk(root: str, folders: set[str], most: int):
    """(rel, size) of regular files under root in path order; no link on the way, none skipped. Those over `most` bytes have a size of None."""
    for name in sorted(os.listdir(root)):
        todo = [(os.path.join(root, name), [name])]
        while todo:
            path, parts = todo.pop()
            if os.path.islink(path) or skipped(parts, folders):
                continue
            if os.path.isdir(path):
                todo += [(os.path.join(path, x), [*parts, x]) for x in sorted(os.listdir(path), reverse=True)]
            elif os.path.isfile(path) and os.path.splitext(path)[1].lower() not in BINARY_SUFFIXES:
                yield "/".join(parts), size if (size := os.path.getsize(path)) <= most else None


class _Files(InputPartition):
    def __init__(self, repo: str, root: str, rels: list[str]):
        self.repo, self.root, self.rels = repo, root, rels


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = json.loads(options["roots"]) if "roots" in options else {options.get("repo", os.path.basename(options["path"].rstrip("/"))): options["path"]}
        self.folders = INDEX_SKIP_FOLDERS if options.get("for", "audit") == "index" else SKIP_FOLDERS
        self.most = int(options.get("maxbytes", L.INDEX_BYTES if options.get("for", "audit") == "index" else L.TEXT_BYTES))
        self.bytes = int(options.get("partitionbytes", 32_000_000))
        self.large = options.get("only") == "large"

    def partitions(self):
        out = []
        for repo, root in sorted(self.roots.items()):
            held, size = [], 0
            for rel, n in walk(root, self.folders, self.most):
                if (n is None) != self.large:
                    continue
                held.append(rel)
                size += n or 0
                if size >= self.bytes:
                    out.append(_Files(repo, root, held))
                    held, size = [], 0
            if held:
                out.append(_Files(repo, root, held))
        return out or [_Files("", "", [])]

    def read(self, part):
        for rel in part.rels:
            if self.large:
                yield part.repo, rel, os.path.getsize(os.path.join(part.root, rel)), None, None, 0, False
                continue
            try:
                with open(os.path.join(part.root, rel), "rb") as f:
                    data = f.read()
            except OSError:
                continue
            binary = b"\0" in data[: L.SNIFF_BYTES]
            text = None if binary else decode(rel, data)
            lines = 0 if not text else text.count("\n") + (not text.endswith("\n"))
            yield part.repo, rel, len(data), hashlib.sha256(data).hexdigest()[:16], text, lines, binary


class TreeSource(DataSource):
    """Options: path (and repo), or roots (JSON, repo -> path); for = audit or index; maxbytes; partitionbytes; only = large for the files over maxbytes, without text."""

    @classmethod
    def name(cls):
        return "repository"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TreeReader(self.options)


def read_tree(spark: SparkSession, roots: dict[str, str], purpose: str = "audit") -> DataFrame:
    ship(spark)
    spark.dataSource.register(TreeSource)
    return spark.read.format("repository").option("roots", json.dumps(roots)).option("for", purpose).load().filter("not binary").drop("binary")


def too_large(spark: SparkSession, roots: dict[str, str], purpose: str = "audit") -> DataFrame:
    """repo, rel, size of the files that read_tree leaves out for their size."""
    ship(spark)
    spark.dataSource.register(TreeSource)
    return spark.read.format("repository").option("roots", json.dumps(roots)).option("for", purpose).option("only", "large").load().select("repo", "rel", "size").filter("rel <> ''")


def census(files: DataFrame) -> DataFrame:
    """Files of known languages outside others' code (repo, rel, lang, lines, sha, generated, text); the text stays for copy languages only."""
    lang = S.language(F.col("rel"))
    parts = F.split("rel", "/")
    mine = ~F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, L.SKIP_FOLDERS_EXTRA)))
    f = files.withColumn("lang", lang).filter(F.col("lang").isNotNull() & mine)
    text = F.when(F.col("lang").isin(L.COPY_LANGUAGES), F.col("text")).otherwise("")
    return f.select("repo", "rel", "lang", "lines", "sha", S.is_generated(F.col("rel"), F.col("text")).alias("generated"), text.alias("text"))
