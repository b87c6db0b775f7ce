from strataloom.operators import resolve


def test_resolution(spark):
    paths = ["src/a/b.ts", "src/a/index.ts", "src/c.js", "pkg/m/__init__.py", "pkg/m/x.py", "pkg/y.py", "internal/q/one.go", "internal/q/two.go"]
    imports = [("src/a/b.ts", "TypeScript", "."), ("src/a/b.ts", "TypeScript", "../c.js"), ("src/c.js", "JavaScript", "./a/b"), ("src/c.js", "JavaScript", "@scope/lib/deep"), ("pkg/m/x.py", "Python", ".."), ("pkg/m/x.py", "Python", "..y"), ("pkg/m/x.py", "Python", "pkg.m"), ("pkg/m/x.py", "Python", "m.x"), ("pkg/m/x.py", "Python", "os.path"), ("main.go", "Go", "example.com/mod/internal/q"), ("main.go", "Go", "fmt"), ("main.go", "Go", None)]
    df = spark.createDataFrame([("p", *i) for i in imports], "project_id string, path string, language string, spec string")
    known = spark.createDataFrame([("p", x) for x in paths] + [("other", "lib/z.ts")], "project_id string, path string")
    got = {(r.path, r.spec): r.target or r.package for r in resolve.resolved(df, known).collect()}
    assert got == {
        ("src/a/b.ts", "."): "src/a/index.ts", ("src/a/b.ts", "../c.js"): "src/c.js", ("src/c.js", "./a/b"): "src/a/b.ts", ("src/c.js", "@scope/lib/deep"): "@scope/lib", ("pkg/m/x.py", ".."): "", ("pkg/m/x.py", "..y"): "pkg/y.py",
        ("pkg/m/x.py", "pkg.m"): "pkg/m/__init__.py", ("pkg/m/x.py", "m.x"): "pkg/m/x.py", ("pkg/m/x.py", "os.path"): "os", ("main.go", "example.com/mod/internal/q"): "internal/q/one.go", ("main.go", "fmt"): "fmt",
    }


def test_aliases():
    assert resolve.candidates("a/b.ts", "@/x", "TypeScript", {"@/*": "src/*"})[0] == ("src/x", True)
    assert resolve.joined("a/b", "../../../c") == "c"
