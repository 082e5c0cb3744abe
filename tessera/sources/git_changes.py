"""Git change sets as a Spark data source.

`spark.read.format("git_changes")` with options `repo`, `mode` and the refs
that the mode needs. The driver lists the changed paths; tasks read contents
and hunks, a chunk of paths each, with plain git. Executors need the
repository at the same path.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "old_path string, new_path string, old_content string, new_content string, "
    "hunks array<struct<old_start:bigint,old_lines:bigint,new_start:bigint,new_lines:bigint>>, "
    "status string, additions bigint, deletions bigint, is_binary boolean"
)
STATUS = {"A": "Added", "M": "Modified", "D": "Deleted", "R": "Renamed", "C": "Copied"}
MODES = ("refs", "staged", "unstaged", "worktree", "branch_worktree", "merge_base", "merge_base_worktree")
CHUNK = 64
_HUNK = re.compile(rb"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", re.MULTILINE)


def git(repo: str, *args: str, check: bool = True) -> bytes:
    return subprocess.run(["git", "-C", repo, "-c", "core.quotepath=off", *args], check=check, capture_output=True).stdout


def revision(repo: str, name: str) -> str:
    return git(repo, "rev-parse", "--verify", f"{name}^{{commit}}").decode().strip()


def sides(repo: str, mode: str, base: str, head: str) -> tuple[list[str], str | None, str | None]:
    """Arguments of git diff, and where old and new contents are: a commit, `:` the index, or None the work tree."""
    renames = ["-M", "-C"]
    if mode == "refs":
        old, new = revision(repo, base), revision(repo, head)
        return [*renames, old, new], old, new
    if mode == "staged":
        return ["--no-renames", "--cached"], "HEAD", ":"
    if mode == "unstaged":
        return ["--no-renames"], ":", None
    if mode == "worktree":
        return ["--no-renames", "HEAD"], "HEAD", None
    if mode == "branch_worktree":
        old = revision(repo, base)
        return [*renames, old], old, None
    if mode in ("merge_base", "merge_base_worktree"):
        old = git(repo, "merge-base", base, head or "HEAD").decode().strip()
        if mode == "merge_base_worktree":
            return [*renames, old], old, None
        new = revision(repo, head)
        return [*renames, old, new], old, new
    raise ValueError(f"mode must be one of {', '.join(MODES)}")


def parse_range(text: str) -> tuple[str, str]:
    """`A..B` as two refs."""
    parts = text.split("..")
    if len(parts) != 2 or not all(parts):
        raise ValueError(f"not a range of two refs: {text}")
    return parts[0], parts[1]


class Paths(InputPartition):
    def __init__(self, entries: list[tuple[str, str | None, str | None]]) -> None:
        self.entries = entries


class ChangesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.repo, self.mode = options["repo"], options.get("mode", "branch_worktree")
        self.args, self.old, self.new = sides(self.repo, self.mode, options.get("base", "HEAD"), options.get("head", "HEAD"))

    def _entries(self) -> list[tuple[str, str | None, str | None]]:
        fields = git(self.repo, "diff", "--raw", "-z", "--no-abbrev", *self.args).decode("utf-8", "surrogateescape").split("\0")
        out, i = [], 0
        while i < len(fields) - 1:
            letter = fields[i].split(" ")[-1][0]
            if letter in "RC":
                out.append((STATUS[letter], fields[i + 1], fields[i + 2]))
                i += 3
                continue
            if letter in STATUS:  # a changed type is passed over
                out.append((STATUS[letter], None if letter == "A" else fields[i + 1], None if letter == "D" else fields[i + 1]))
            i += 2
        if self.new is None and self.mode != "unstaged":
            untracked = git(self.repo, "ls-files", "--others", "--exclude-standard", "-z").decode("utf-8", "surrogateescape").split("\0")
            known = {e[2] for e in out}
            out += [("Untracked", None, p) for p in untracked if p and p not in known]
        return sorted(out, key=lambda e: e[2] or e[1] or "")

    def partitions(self) -> list[InputPartition]:
        entries = self._entries()
        return [Paths(entries[i : i + CHUNK]) for i in range(0, len(entries), CHUNK)] or [Paths([])]

    def _content(self, where: str | None, path: str | None) -> bytes | None:
        if path is None:
            return None
        if where is None:
            try:
                with open(os.path.join(self.repo, path), "rb") as f:
                    return f.read()
            except OSError:
                return None
        name = f":{path}" if where == ":" else f"{where}:{path}"
        done = subprocess.run(["git", "-C", self.repo, "show", name], capture_output=True)
        return done.stdout if done.returncode == 0 else None

    def read(self, partition: Paths) -> Iterator[tuple]:
        for status, old_path, new_path in partition.entries:
            old, new = self._content(self.old, old_path), self._content(self.new, new_path)
            texts = [_text(old), _text(new)]
            if any(t is None and raw is not None for t, raw in zip(texts, (old, new))):
                continue  # binary files are passed over
            if status == "Untracked":
                lines = len(texts[1].splitlines()) if texts[1] else 0
                yield None, new_path, None, texts[1], [], "Added", lines, 0, False
                continue
            diff = git(self.repo, "diff", *self.args, "--", *[p for p in dict.fromkeys((old_path, new_path)) if p], check=False)
            hunks = [tuple(int(x) if x else 1 for x in m.groups()) for m in _HUNK.finditer(diff)]
            body = diff[diff.index(b"\n@@") + 1 :] if hunks else b""
            added = sum(line[:1] == b"+" for line in body.split(b"\n"))
            removed = sum(line[:1] == b"-" for line in body.split(b"\n"))
            yield old_path, new_path, texts[0], texts[1], hunks, status, added, removed, False


def _text(raw: bytes | None) -> str | None:
    """UTF-8 text without NUL, else None."""
    if raw is None or b"\0" in raw:
        return None
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return None


class GitChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_changes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ChangesReader(self.options)


def changes(spark: SparkSession, repo: str, mode: str = "branch_worktree", base: str = "HEAD", head: str = "HEAD") -> DataFrame:
    """One row for each changed file."""
    spark.dataSource.register(GitChanges)
    return spark.read.format("git_changes").options(repo=os.path.abspath(repo), mode=mode, base=base, head=head).load()


def changes_or_worktree(spark: SparkSession, repo: str, mode: str, base: str, head: str) -> tuple[DataFrame, bool]:
    """The changes between two refs, or those of the work tree where there are none; and which it was."""
    between = changes(spark, repo, mode, base, head)
    return (between, False) if not between.isEmpty() else (changes(spark, repo, "worktree"), True)


def branches(spark: SparkSession, repo: str) -> DataFrame:
    """(name, is_current, upstream): local branches."""
    lines = git(repo, "for-each-ref", "--format=%(refname:short)%00%(HEAD)%00%(upstream:short)", "refs/heads").decode().splitlines()
    rows = [(n, h == "*", u or None) for n, h, u in (x.split("\0") for x in lines)]
    return spark.createDataFrame(rows, "name string, is_current boolean, upstream string")


def worktrees(spark: SparkSession, repo: str) -> DataFrame:
    """(path, head, branch): the main work tree and linked ones."""
    rows = []
    for block in git(repo, "worktree", "list", "--porcelain").decode().strip().split("\n\n"):
        values = dict((x.split(" ", 1) + [""])[:2] for x in block.splitlines())
        rows.append((values.get("worktree"), values.get("HEAD"), (values.get("branch") or "").removeprefix("refs/heads/") or None))
    return spark.createDataFrame(rows, "path string, head string, branch string")


def branch_status(spark: SparkSession, repo: str) -> DataFrame:
    """(branch, upstream, ahead, behind) of the current branch; nulls without an upstream."""
    name = git(repo, "rev-parse", "--abbrev-ref", "HEAD").decode().strip()
    upstream = git(repo, "rev-parse", "--abbrev-ref", "@{upstream}", check=False).decode().strip() or None
    ahead = behind = None
    if upstream:
        ahead, behind = map(int, git(repo, "rev-list", "--left-right", "--count", f"HEAD...{upstream}").split())
    return spark.createDataFrame([(name, upstream, ahead, behind)], "branch string, upstream string, ahead int, behind int")


def default_branch(repo: str) -> str:
    """main, master or develop if there is one, else the first branch."""
    names = git(repo, "for-each-ref", "--format=%(refname:short)", "refs/heads").decode().split()
    if not names:
        raise ValueError("the repository has no branch")
    return next((n for n in ("main", "master", "develop") if n in names), names[0])


def file_at(repo: str, ref: str, path: str) -> str | None:
    done = subprocess.run(["git", "-C", repo, "show", f"{ref}:{path}"], capture_output=True)
    return _text(done.stdout) if done.returncode == 0 else None


# How commits name the directory of a merged subtree.
_SUBTREES = (re.compile(r"Add '([^']+)/?' from commit"), re.compile(r"Squashed '([^']+)/?' (?:content|changes)"), re.compile(r"Merge commit '[0-9a-f]+' as '([^']+)'"))


def subtree_paths(repo: str) -> list[str]:
    """Directories that commits say were merged in as subtrees and that still exist."""
    found = []
    for line in git(repo, "log", "--format=%s").decode("utf-8", "replace").splitlines():
        for pattern in _SUBTREES:
            if (m := pattern.search(line)) and os.path.isdir(os.path.join(repo, m[1].rstrip("/"))):
                found.append(m[1].rstrip("/"))
    return list(dict.fromkeys(found))
