import json

import pytest

from strataloom.operators import captions, review
from strataloom.sources import manifests

TEXT = "\n".join(f"line {i}" for i in range(100))


def test_patch_exact_drifted_and_bare():
    done, out, _ = review.apply_patch(TEXT, "@@ -11,2 +11,2 @@\n line 10\n-line 11\n+LINE 11")
    assert done and out.split("\n")[11] == "LINE 11"
    assert review.apply_patch(TEXT, "@@ -41,2 +11,2 @@\n line 10\n-line 11\n+x")[0]
    assert review.apply_patch(TEXT, "@@ -90 +90 @@\n-line 11\n+x") == (False, TEXT, "not found")
    assert review.apply_patch(TEXT, "@@ @@\n-line 42\n+x")[0]
    assert review.apply_patch("a\na", "@@ @@\n-a\n+b") == (False, "a\na", "ambiguous")
    assert review.apply_patch("a", "@@ -1 +1 @@\n+b")[2] == "no context" and review.apply_patch("a", "")[2] == "no hunks"


def test_patch_shifts_later_hunks():
    done, out, _ = review.apply_patch(TEXT, "@@ -1 +1,3 @@\n-line 0\n+a\n+b\n+c\n@@ -50 +52 @@\n-line 49\n+z")
    assert done and out.split("\n")[51] == "z"


def test_patched_and_reanchored(spark):
    df = spark.createDataFrame([("a", "x\ny", "@@ -1 +1 @@\n-x\n+z"), ("b", None, "p"), ("c", "x", None)], "id string, text string, patch string")
    assert [(r.id, r.result) for r in review.patched(df).collect()] == [("a", "z\ny")]
    claims = spark.createDataFrame([("1", "f", 5, " b( "), ("2", "f", 1, "gone"), ("3", "g", 1, "b("), ("4", "f", 1, " ")], "claim_id string, path string, start_line int, quote string")
    texts = spark.createDataFrame([("f", "b(\nx\ny\nb(\nz\nb(")], "path string, content string")
    assert {r.claim_id: r.line_no for r in review.reanchored(claims, texts, ["path"]).collect()} == {"1": 4, "2": None, "3": None, "4": None}


def test_blank_literals():
    assert review.blank_literals('f("eval(x)"); // eval(y)\ng(`a ${eval(z)} b`)') == 'f("       ");           \ng(`  ${eval(z)}  `)'


def test_call_arguments():
    text = "f(a, [1, 2], 'x,y', g(b, c))"
    assert review.call_arguments(text, 1) == ["a", "[1, 2]", "'x,y'", "g(b, c)"]
    assert review.call_arguments("f()", 1) == [] and review.call_arguments("f(a", 1) == []


def test_dedupe(spark):
    rows = [("1", "f", "SQL built from input", 10, 12, 1), ("2", "f", "SQL is built from user input", 14, 14, 2), ("3", "f", "SQL built from input", 90, 90, 2), ("4", "g", "SQL built from input", 10, 10, 2), ("5", None, None, None, None, 0)]
    df = spark.createDataFrame(rows, "id string, path string, title string, start_line int, end_line int, rank int")
    assert {r.id for r in review.deduped(df, ["path"]).collect()} == {"1", "3", "4", "5"}


def test_captions_round_trip(spark):
    words = [("t", "s1", i, w, i * 500, i * 500 + 400) for i, w in enumerate("One two three. Four five six seven. Eight".split())] + [("t", "s2", 99, "Next", 9000, 9400)]
    df = spark.createDataFrame(words, "track string, section string, idx int, text string, start_ms long, end_ms long")
    c = captions.cues(df)
    assert [(r.text, r.start_ms) for r in c.orderBy("cue").collect()] == [("One two three.", 0), ("Four five six seven.", 1500), ("Eight", 3500), ("Next", 9000)]
    back = captions.read_vtt(captions.vtt(c))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, c.collect()))


def test_interpolation(spark):
    df = spark.createDataFrame([("t", i, w, s) for i, (w, s) in enumerate([("ab", None), ("ab", 300), ("abcde", None), ("ab", None), ("ab", 1500), ("x", 100)])], "track string, idx int, text string, start_ms long")
    assert [r.start_ms for r in captions.interpolated(df).orderBy("idx").collect()] == [300, 300, 600, 1200, 1500, 1500]


MANIFESTS = [
    ("package.json", json.dumps({"dependencies": {"a": "^1"}, "devDependencies": {"b": "2"}}), [("npm", "a", "^1", False), ("npm", "b", "2", True)]),
    ("requirements-dev.txt", "x[y]>=1.0 ; python_version>'3'\n# c\n-r other.txt\nz\n", [("pypi", "x", ">=1.0", True), ("pypi", "z", "", True)]),
    ("pyproject.toml", '[project]\ndependencies = ["q~=2"]\n', [("pypi", "q", "~=2", False)]),
    ("go.mod", "module m\n\nrequire (\n\tgithub.com/a/b v1.2.3\n\tgolang.org/x/c v0.1.0 // indirect\n)\n", [("go", "github.com/a/b", "v1.2.3", False), ("go", "golang.org/x/c", "v0.1.0", True)]),
    ("Cargo.toml", '[dependencies]\ns = "1"\nt = { version = "2" }\n', [("cargo", "s", "1", False), ("cargo", "t", "2", False)]),
    ("pom.xml", "<dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version><scope>test</scope></dependency>", [("maven", "g:a", "1", True)]),
    ("build.gradle", "implementation 'g:a:1'\ntestImplementation(\"g:b:2\")", [("maven", "g:a", "1", False), ("maven", "g:b", "2", True)]),
    ("Gemfile", "gem 'rails', '~> 7'\n", [("gem", "rails", "~> 7", False)]),
    ("composer.json", '{"require": {"php": "8", "a/b": "1"}}', [("composer", "a/b", "1", False)]),
    ("x.csproj", '<PackageReference Include="N" Version="1" />', [("nuget", "N", "1", False)]),
    ("pubspec.yaml", "dependencies:\n  http: ^1.0\ndev_dependencies:\n  test: any\n", [("pub", "http", "^1.0", False), ("pub", "test", "any", True)]),
    ("package.json", "{broken", []),
]


@pytest.mark.parametrize(("name", "text", "expected"), MANIFESTS)
def test_manifests(name, text, expected):
    assert list(manifests.dependencies_of(f"sub/{name}", text)) == expected


def test_aliases_and_first_wins(spark):
    assert list(manifests.aliases_of("web/tsconfig.json", '{ // c\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["./src/*"],}}}')) == [("@/*", "web/src/*")]
    df = spark.createDataFrame([("p", "b/package.json", '{"dependencies": {"a": "2"}}'), ("p", "a/package.json", '{"dependencies": {"a": "1"}}'), ("p", None, "x"), ("p", "c/package.json", None)], "project_id string, path string, content string")
    assert [(r.name, r.version) for r in manifests.dependencies(df).collect()] == [("a", "1")]
