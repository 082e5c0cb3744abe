import json
import os
import subprocess

import pytest

from tessera.plans.analyze import analyze, analyze_repository
from tessera.sources.git_changes import branches, changes, changes_or_worktree, default_branch, file_at, parse_range


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("repo"))

    def write(path, text):
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "w") as f:
            f.write(text)

    def git(*args):
        subprocess.run(["git", "-C", root, "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True)

    git("init", "-q", "-b", "main")
    write("src/routes/users.ts", "import { getUser } from '../services/user';\napp.get('/u', list);\n")
    write("src/services/user.ts", "import { find } from '../repo/user';\nexport function getUser(id) { return find(id); }\n")
    write("src/repo/user.ts", "export function find(id) { return 1; }\n")
    write("package.json", "{}")
    write("src/old.ts", "export const a = 1;\nexport const b = 2;\nexport const c = 3;\n")
    git("add", "-A")
    git("commit", "-qm", "one")
    git("checkout", "-qb", "feature")
    write("src/routes/users.ts", "import { getUser } from '../services/user';\napp.get('/u', function (req) { return getUser(req.id); });\n")
    write("src/services/user.ts", "import { find } from '../repo/user';\nexport function getUser(id) { const u = find(id); return audit(u); }\n")
    write("src/repo/user.ts", "export function find(id) { return userRepo.findOne(id); }\n")
    write("package.json", '{"name": "x"}')
    git("mv", "src/old.ts", "src/new.ts")
    git("add", "-A")
    git("commit", "-qm", "two")
    write("notes.txt", "a\nb\n")
    with open(f"{root}/x.bin", "wb") as f:
        f.write(b"\0\1")
    return root


def test_modes(spark, repo):
    def listed(mode, base="main", head="feature"):
        return [(r.status, r.old_path, r.new_path, r.additions, r.deletions) for r in changes(spark, repo, mode, base, head).orderBy("new_path").collect()]

    between = listed("refs")
    assert ("Renamed", "src/old.ts", "src/new.ts", 0, 0) in between and ("Modified", "src/repo/user.ts", "src/repo/user.ts", 1, 1) in between
    assert listed("merge_base") == between
    assert listed("worktree") == [("Added", None, "notes.txt", 2, 0)]
    assert set(listed("branch_worktree")) == {*between, ("Added", None, "notes.txt", 2, 0)}
    assert listed("staged") == [] and listed("unstaged") == []
    same, fell_back = changes_or_worktree(spark, repo, "refs", "feature", "feature")
    assert fell_back and same.count() == 1


def test_repository_facts(spark, repo):
    assert {(r.name, r.is_current) for r in branches(spark, repo).collect()} == {("main", False), ("feature", True)}
    assert default_branch(repo) == "main"
    assert file_at(repo, "main", "package.json") == "{}" and file_at(repo, "main", "none") is None
    assert parse_range("a..b") == ("a", "b")
    with pytest.raises(ValueError):
        parse_range("a")


def test_groups(spark, repo):
    a = analyze_repository(spark, repo, "refs", "main", "feature")
    files = {r.path: (r.group_id, r.role, r.flow_position) for r in a.group_files.collect()}
    assert files["src/routes/users.ts"] == ("group_1", "Entrypoint", 0)
    assert files["src/services/user.ts"][2] == 1 and files["src/repo/user.ts"][2] == 2
    assert {r.path for r in a.infrastructure.collect()} == {"package.json", "src/new.ts"}
    document = json.loads(a.document().first().json)
    assert document["summary"]["total_files_changed"] == 5 and document["groups"][0]["review_order"] == 1


def test_without_entrypoints_and_empty(spark):
    files = [("lib/a.ts", "import { b } from './b';", 1, 0), ("lib/b.ts", "export const b = 1;", 1, 0), ("util/c.ts", "", 1, 0), ("Dockerfile", "", 1, 0)]
    a = analyze(spark.createDataFrame(files, "path string, content string, additions bigint, deletions bigint"))
    groups = {}
    for r in a.group_files.collect():
        groups.setdefault(r.group_id, set()).add(r.path)
    assert sorted(map(sorted, groups.values())) == [["lib/a.ts", "lib/b.ts"], ["util/c.ts"]]
    assert [r.path for r in a.infrastructure.collect()] == ["Dockerfile"]
    none = analyze(spark.createDataFrame([], "path string, content string, additions bigint, deletions bigint"))
    assert none.groups.count() == 0 and none.infrastructure.count() == 0


def test_large_changes_stay_in_their_buckets(spark):
    files = [("apps/web/src/main.go", "package main\nfunc main() { }\n", 1, 0), ("apps/api/src/x.ts", "export const x = 1;", 1, 0), ("docs/guide.md", "", 1, 0), ("apps/web/src/y.ts", "", 1, 0)]
    a = analyze(spark.createDataFrame(files, "path string, content string, additions bigint, deletions bigint"), large=2)
    groups = {}
    for r in a.group_files.collect():
        groups.setdefault(r.group_id, set()).add(r.path)
    assert sorted(map(sorted, groups.values())) == [["apps/api/src/x.ts"], ["apps/web/src/main.go", "apps/web/src/y.ts"]]
    assert {r.path for r in a.infrastructure.collect()} == {"docs/guide.md"}
