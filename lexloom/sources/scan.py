"""Where source files come from: directories, git trees, change feeds. Paths are filtered before contents are read."""

from __future__ import annotations

import fnmatch
import os
import re
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import DEFAULT_GLOBS, DETECT_SKIPPED, TREE_SKIPPED
from ..schemas import EXTENSIONS


def language_of(path):
    """The language of a path column by its extension; null for others."""
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.element_at(known, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def language_counts(files: DataFrame, depth: int = 3) -> DataFrame:
    """(language, n) of files (file, relative) of at most ``depth`` path parts, neither hidden nor in a hidden or skipped folder."""
    parts = F.split("file", "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    ok = (F.size(parts) <= depth) & ~F.exists(parts, lambda x: F.startswith(x, F.lit("."))) & ~F.exists(folders, lambda x: x.isin(*DETECT_SKIPPED))
    return files.where(ok).select(language_of(F.col("file")).alias("language")).where("language is not null").groupBy("language").agg(F.count(F.lit(1)).alias("n"))


def detect(files: DataFrame) -> DataFrame:
    """One row (language, n): the dominant language and how many files count at all.

    Rust must lead all others, TypeScript Python and JavaScript, JavaScript Python and TypeScript; else it is Python,
    so also with no file.
    """
    of = lambda x: F.coalesce(F.sum(F.when(F.col("language") == x, F.col("n"))), F.lit(0))
    one = language_counts(files).agg(of("python").alias("py"), of("typescript").alias("ts"), of("javascript").alias("js"), of("rust").alias("rs"))
    best = F.when(F.expr("rs > py and rs > ts and rs > js"), "rust").when(F.expr("ts > py and ts > js"), "typescript").when(F.expr("js > py and js > ts"), "javascript").otherwise("python")
    return one.select(best.alias("language"), F.expr("py + ts + js + rs").alias("n"))


def detect_all(files: DataFrame, min_files: int = 5) -> DataFrame:
    """Languages with enough files, most first."""
    return language_counts(files).where(F.col("n") >= min_files).orderBy(F.desc("n"), "language")


def globs(languages: list[str], include: list[str] | None = None, exclude: list[str] | None = None) -> tuple[list[str], list[str]]:
    """Include and exclude globs: the union of the languages' defaults in order, unless given."""
    a = include or list(dict.fromkeys(g for x in languages for g in DEFAULT_GLOBS[x][0]))
    b = exclude or list(dict.fromkeys(g for x in languages for g in DEFAULT_GLOBS[x][1]))
    return a, b


def glob_regex(globs_: list[str]) -> str:
    """A pattern for the paths that any of the globs names, or that lie in a folder it names. Without globs: none."""
    parts = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    made = ["".join(parts.get(x, re.escape(x)) for x in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", g)) for g in globs_]
    return f"^(?:{'|'.join(made)})(?:/.*)?$" if made else r"$.^"


def _fits(path: str, patterns: list[str]) -> bool:
    return re.match(glob_regex(patterns), path) is not None


def ignored(path: str, rules: list[str]) -> bool:
    """Whether ignore rules (one a line, later ones win, ``!`` keeps) exclude a relative path or a folder above it."""
    out = False
    for rule in rules:
        r = rule.strip()
        if not r or r.startswith("#"):
            continue
        keep, r = r.startswith("!"), r.removeprefix("!")
        anchored, name = "/" in r.rstrip("/"), r.strip("/")
        parts = path.split("/")
        heads = ["/".join(parts[:i]) for i in range(1, len(parts) + (not r.endswith("/")))]
        if any(fnmatch.fnmatch(h if anchored else h.rsplit("/", 1)[-1], name) for h in heads):
            out = not keep
    return out


def list_files(root: str, include: list[str], exclude: list[str]) -> list[str]:
    """Relative paths of the files of a local tree that globs and ignore files let through, sorted."""
    found: list[str] = []

    def walk(folder: Path, rules: list[str]) -> None:
        own = folder / ".gitignore"
        if own.is_file():
            at = folder.relative_to(root).as_posix()
            lines = own.read_text(errors="replace").splitlines()
            rules = rules + ([x if at == "." else (f"!{at}/{x[1:].lstrip('/')}" if x.startswith("!") else f"{at}/{x.lstrip('/')}" if "/" in x.strip("/") else x) for x in lines])
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            path = Path(entry.path).relative_to(root).as_posix()
            if entry.name.startswith(".") or ignored(path + ("/x" if entry.is_dir() else ""), rules):
                continue
            if entry.is_dir(follow_symlinks=False):
                walk(Path(entry.path), rules)
            elif _fits(path, include) and not _fits(path, exclude):
                found.append(path)

    walk(Path(root), [])
    return sorted(found)


def scan(spark: SparkSession, root: str, languages: list[str], include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(file, language, content, modified) of a tree; files that are no UTF-8 are left out.

    A local tree is listed on the driver for its ignore files; in any other store the globs alone decide, as a
    filter on the paths. Contents are read by the tasks.
    """
    inc, exc = globs(languages, include, exclude)
    if "://" in root:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        base = re.sub("^file:/+", "/", root).rstrip("/")
    else:
        base = str(Path(root).resolve())
        paths = [f"{base}/{p}" for p in list_files(base, inc, exc)]
        if not paths:
            return spark.createDataFrame([], "file string, language string, content string, modified timestamp")
        raw = spark.read.format("binaryFile").load(paths)
    # Spark names local files file:/a where file:///a was asked for
    local = F.regexp_replace("path", "^file:/+", "/")
    file = F.substring(local, F.locate(base + "/", local) + F.lit(len(base) + 1), F.length(local))
    named = raw.withColumn("file", file).where(F.regexp_like("file", F.lit(glob_regex(inc))) & ~F.regexp_like("file", F.lit(glob_regex(exc))))
    out = named.select("file", "content", F.col("modificationTime").alias("modified")).withColumn("language", language_of(F.col("file")))
    return out.where(F.col("language").isin(languages) & F.is_valid_utf8(F.col("content").cast("string"))).select("file", "language", F.col("content").cast("string").alias("content"), "modified")


def git_tree(spark: SparkSession, repo: str, ref: str, languages: list[str], partitions: int = 8) -> DataFrame:
    """(file, language, content) of a commit. An unknown ref is an error. Names are listed first, blobs are read by tasks."""
    listed = subprocess.run(["git", "-C", repo, "ls-tree", "-r", "--name-only", "-z", ref], capture_output=True)
    if listed.returncode:
        raise ValueError(f"cannot resolve {ref}: {listed.stderr.decode(errors='replace').strip()}")
    names = [n for n in listed.stdout.decode(errors="replace").split("\0") if EXTENSIONS.get(n.rpartition(".")[2]) in languages and not any(x in n[: n.rfind("/") + 1] for x in TREE_SKIPPED)]
    paths = spark.createDataFrame([(n,) for n in names], "file string").repartition(partitions)

    def read(parts):
        for part in parts:
            texts = []
            for n in part["file"]:
                got = subprocess.run(["git", "-C", repo, "show", f"{ref}:{n}"], capture_output=True).stdout
                try:
                    texts.append(got.decode())
                except UnicodeDecodeError:
                    texts.append(None)
            part["content"] = texts
            yield part[["file", "content"]]

    return paths.mapInPandas(read, "file string, content string").where("content is not null").withColumn("language", language_of(F.col("file"))).select("file", "language", "content")


def check_root(path: str, force: bool = False) -> str:
    """A repository's path, refusing the file system's root, the temp folder, the home folder, and trees without .git."""
    p = Path(os.path.expanduser(path)).resolve()
    if p in (Path("/"), Path("/tmp"), Path.home().resolve()):
        raise ValueError(f"{p} is no repository")
    if not force and not (p / ".git").exists():
        raise ValueError(f"{p} has no .git; force to go on")
    return str(p)
