import pytest

from tessera.extract import brace_source, go_source, python_source, script_source
from tessera.extract.files import parse, rows

SCRIPT = """
import express from 'express';
import { getUser, type Foo as Bar } from './services/user';
import * as db from "../db";
import './side';
export { a as b } from './re';
export default function main(req: Request) { const u = await getUser(req.id); return save(u); }
export const handler = async (x: number): Promise<void> => { logger.info(`hi ${x}`); };
export class Svc extends Base {
  constructor(private repo: Repo) { super(); }
  async find(id: string): Promise<User> { return this.repo.findOne(id); }
}
interface I { m(): void }
app.get('/x', (req, res) => { res.send(db.list(req)); });
"""


def test_script():
    f = script_source.extract(SCRIPT).rows
    assert [(i["source"], i["is_default"], i["is_namespace"], len(i["names"])) for i in f["imports"]] == [("express", True, False, 1), ("./services/user", False, False, 2), ("../db", False, True, 1), ("./side", False, False, 0)]
    assert [(d["name"], d["kind"]) for d in f["definitions"]] == [("main", "Function"), ("handler", "Function"), ("Svc", "Class"), ("constructor", "Function"), ("find", "Function"), ("I", "Interface")]
    assert [(e["name"], e["is_default"], e["source"]) for e in f["exports"]] == [("b", False, "./re"), ("main", True, None), ("handler", False, None), ("Svc", False, None)]
    assert [(c["callee"], c["containing_function"]) for c in f["calls"]] == [("getUser", "main"), ("save", "main"), ("logger.info", "handler"), ("this.repo.findOne", "find"), ("app.get", None), ("res.send", None), ("db.list", None)]
    assert [(a["variable"], a["callee"]) for a in f["assignments"]] == [("u", "getUser")]


def test_go():
    f = go_source.extract('package main\nimport (\n "fmt"\n g "github.com/gin-gonic/gin"\n)\ntype User struct { Name string }\nfunc (s *S) Handle(c *g.Context) error {\n u := s.repo.Find(c.Param("id"))\n return save(u)\n}\n').rows
    assert [(i["source"], i["names"][0]["alias"]) for i in f["imports"]] == [("fmt", None), ("github.com/gin-gonic/gin", "g")]
    assert [(d["name"], d["kind"], d["start_line"], d["end_line"]) for d in f["definitions"]] == [("User", "Struct", 6, 6), ("Handle", "Function", 7, 10)]
    assert [c["callee"] for c in f["calls"]] == ["s.repo.Find", "c.Param", "save"]
    assert [e["name"] for e in f["exports"]] == ["User", "Handle"]


def test_python():
    f = python_source.extract('import os\nfrom .m import A as B\n@app.route("/x")\ndef get(id):\n    u = load(id)\n    return render(u, k=1)\nclass C(Base):\n    def m(self):\n        self.repo.save(1)\n').rows
    assert [(c["callee"], c["containing_function"]) for c in f["calls"]] == [("app.route", None), ("load", "get"), ("render", "get"), ("self.repo.save", "m")]
    assert [(d["name"], d["kind"]) for d in f["definitions"]] == [("get", "Function"), ("C", "Class"), ("m", "Function")]
    assert f["definitions"][1]["bases"] == ["Base"] and f["assignments"][0]["variable"] == "u"
    assert f["imports"][1]["source"] == ".m" and f["imports"][1]["names"] == [{"name": "A", "alias": "B"}]


def test_rows_and_errors(spark):
    df = spark.createDataFrame([("a.py", "def f(): pass"), ("b.py", "def ("), ("c.rb", "x"), ("d.ts", None), ("e.ts", "(((")], "path string, content string")
    got = {r.path: r for r in parse(df).collect()}
    assert got["b.py"].error.startswith("SyntaxError") and got["b.py"].definitions == []
    assert got["c.rb"].language == "Ruby" and got["d.ts"].calls == []
    assert [r.name for r in rows(parse(df), "definitions").collect()] == ["f"]
    assert parse(df.limit(0)).count() == 0


CASES = {
    "Rust": ("use std::io::{Read, Write as W};\nuse axum::Router;\npub struct A { a: u32 }\nimpl A {\n  pub fn new(x: u32) -> Self { let y = db::load(x); A { a: y } }\n}\nconst K: u32 = 3;\n", ["std::io", "axum::Router"], [("A", "Struct"), ("new", "Function"), ("K", "Constant")], [("db::load", "new")]),
    "Java": ("import java.util.List;\npublic class A {\n  public A(int x) { this.x = x; }\n  public List<String> get(int id) throws E { User u = repo.find(id); return save(u); }\n}\ninterface I { void m(); }\n", ["java.util.List"], [("A", "Class"), ("A", "Function"), ("get", "Function"), ("I", "Interface")], [("repo.find", "get"), ("save", "get")]),
    "CSharp": ("using System;\nusing X = A.B;\npublic class C { public async Task<int> Get(int id) { var u = await svc.Load(id); return u; } }\n", ["System", "A.B"], [("C", "Class"), ("Get", "Function")], [("svc.Load", "Get")]),
    "Php": ("<?php\nuse App\\Models\\User;\nuse A\\{B, C as D};\nclass X { public function get($id) { $u = User::find($id); return $this->save($u); } }\n", ["App\\Models\\User", "A"], [("X", "Class"), ("get", "Function")], [("User::find", "get"), ("$this->save", "get")]),
    "Ruby": ("require 'json'\nclass A < B\n  def get(id)\n    u = load(id)\n    if u\n      save(u)\n    end\n  end\nend\n", ["json"], [("A", "Class"), ("get", "Function")], [("load", "get"), ("save", "get")]),
    "Kotlin": ("import io.ktor.server.*\nimport a.b as c\nclass A { fun get(id: Int): Int { val u = load(id); return save(u) } }\n", ["io.ktor.server.*", "a.b"], [("A", "Class"), ("get", "Function")], [("load", "get"), ("save", "get")]),
    "Swift": ("import Vapor\nstruct A { func get(_ id: Int) -> Int { let u = load(id); return save(u) } }\n", ["Vapor"], [("A", "Struct"), ("get", "Function")], [("load", "get"), ("save", "get")]),
    "Scala": ("import a.b.{C, D => E}\nobject A { def get(id: Int): Int = { val u = load(id); save(u) } }\n", ["a.b"], [("A", "Class"), ("get", "Function")], [("load", "get"), ("save", "get")]),
    "C": ('#include <stdio.h>\nstruct s { int a; };\nstatic int add(int a, int b) { int c = mul(a, b); return c; }\n', ["stdio.h"], [("s", "Struct"), ("add", "Function")], [("mul", "add")]),
    "Cpp": ("#include <crow.h>\nclass A { public: int get(int id) { auto u = repo->find(id); return std::max(u, 1); } };\n", ["crow.h"], [("A", "Class"), ("get", "Function")], [("repo->find", "get"), ("std::max", "get")]),
}


@pytest.mark.parametrize("language", CASES)
def test_brace_languages(language):
    source, imports, definitions, calls = CASES[language]
    f = brace_source.extract(language, source).rows
    assert [i["source"] for i in f["imports"]] == imports
    assert [(d["name"], d["kind"]) for d in f["definitions"]] == definitions
    assert [(c["callee"], c["containing_function"]) for c in f["calls"]] == calls


def test_rust_use_trees():
    source = "use std::{collections::HashMap, fmt::{self, Debug}};\nuse a::{b, c::{d as e, f::*}, g::h,};\npub(crate) use crate::{\n  x, // one, two\n  y::z,\n};\nuse k::l;\n"
    found = [(i["source"], [(n["name"], n["alias"]) for n in i["names"]], i["line"]) for i in brace_source.extract("Rust", source).rows["imports"]]
    assert found == [
        ("std::collections", [("HashMap", None)], 1), ("std::fmt", [("self", None), ("Debug", None)], 1),
        ("a", [("b", None)], 2), ("a::c", [("d", "e")], 2), ("a::c::f", [("*", None)], 2), ("a::g", [("h", None)], 2),
        ("crate", [("x", None)], 3), ("crate::y", [("z", None)], 3), ("k::l", [("l", None)], 7),
    ]


def test_python_recovers_around_bad_lines():
    f = python_source.extract("import os\nprint 'old'\ndef get(id):\n    print 'x', id\n    u = load(id)\n    exec 'y'\n    return u\nclass C(B):\n    pass\n").rows
    assert [i["source"] for i in f["imports"]] == ["os"]
    assert [(d["name"], d["start_line"]) for d in f["definitions"]] == [("get", 3), ("C", 8)]
    assert [(c["callee"], c["containing_function"]) for c in f["calls"]] == [("load", "get")]
    with pytest.raises(SyntaxError):
        python_source.extract("def (")
