import pytest

from graphloom.operators import code_index
from graphloom.sources.code_parsers import parse, parse_entities

SOURCES = {
    "python": ("a/m.py", "import os\nfrom x import y\nclass A(B, object):\n    @p\n    def f(self): pass\nasync def g(): pass\n", {("class", "A", "B"), ("method", "f", ""), ("function", "g", "")}, {"os", "x"}),
    "go": ("m.go", 'package m\nimport (\n\t"fmt"\n)\ntype S struct {\n}\ntype I interface {\n\tRun(x int)\n}\nfunc (s *S) Do() {\n}\nfunc New() *S { return nil }\n', {("struct", "S", ""), ("interface", "I", ""), ("method", "Run", ""), ("method", "Do", ""), ("function", "New", "")}, {"fmt"}),
    "typescript": ("src/a.ts", "import { x } from './x';\nexport class A extends B implements C {\n  constructor(a: string) {\n  }\n  async run(x: number): Promise<void> {\n    if (x) {\n    }\n  }\n}\nexport interface I {\n}\nexport const f = (a: number) => a;\nfunction g() {\n}\n", {("class", "A", "B,C"), ("constructor", "constructor", ""), ("method", "run", ""), ("interface", "I", ""), ("function", "f", ""), ("function", "g", "")}, {"./x"}),
    "csharp": ("A.cs", "using System;\nnamespace N.M {\n  public class A : B, IC {\n    public A(int x) {\n    }\n    public int Size { get; set; }\n    public void Run() {\n    }\n  }\n  enum E { X }\n}\n", {("class", "A", "B,IC"), ("constructor", "A", ""), ("property", "Size", ""), ("method", "Run", ""), ("enum", "E", "")}, {"System"}),
    "json": ("p.json", '{"a": 1,\n"b": {}}', {("config", "a", ""), ("config", "b", "")}, set()),
    "yaml": ("p.yml", "trigger: none\nstages:\n- stage: Build\n  jobs:\n  - job: One\n", {("config", "trigger", ""), ("config", "stages", ""), ("stage", "Build", ""), ("job", "One", "")}, set()),
    "dockerfile": ("Dockerfile", "FROM node:1 AS build\nRUN x \\\n  y\nFROM alpine\nCOPY --from=build /a /b\nEXPOSE 80\n", {("stage", "build", "node:1"), ("image", "alpine", "alpine")}, set()),
}


@pytest.mark.parametrize("language", SOURCES)
def test_parsers(language):
    path, text, want, modules = SOURCES[language]
    found = parse(text, path, language)
    assert {(r[3], r[4], ",".join(r[10])) for r in found.rows} == want and set(found.modules) == modules
    assert parse(None, path, language).rows == [] and parse("{[(", path, language).rows in ([], found.rows[:0])


def test_entities_and_edges(spark):
    files = spark.createDataFrame([(p, lang, t) for lang, (p, t, _, _) in SOURCES.items()] + [("x.js", "javascript", "a"), ("bad.json", "json", "[1")], "file_path string, language string, text string")
    entities = parse_entities(files)
    assert entities.count() == sum(len(w) for _, _, w, _ in SOURCES.values())
    edges = {(r["source"], r["target"], r["relationship"]) for r in code_index.structural_edges(entities).collect()}
    assert {("A.cs", "N.M.A", "defines"), ("N.M.A", "IC", "implements"), ("N.M.A", "N.M.A.Run", "contains"), ("N.M.A", "N.M", "belongs_to")} <= edges
