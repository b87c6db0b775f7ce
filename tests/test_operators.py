import io
import random
import stat
import zipfile

import pytest
from pyspark.sql import functions as F

from strataloom.functions import text as fn
from strataloom.operators import extract, graph, relational, retrieval, rules
from strataloom.operators.components import connected_components
from strataloom.sources import archives, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, fn.count_lines(F.lit(""))) == 0
    assert one(spark, fn.count_lines(F.lit("a\nb\n"))) == 3
    assert one(spark, fn.slice_lines(F.lit("a\nb\nc"), 2, 9)) == "b\nc"
    assert one(spark, fn.words(F.lit("getHTTPServerName_v2"))) == ["get", "http", "server", "name", "v2"]
    assert one(spark, fn.resolve_path(F.lit("a/./b/../../../c//d"))) == "c/d"
    assert one(spark, fn.stamp(F.lit(3_723_004))) == "01:02:03.004"
    assert one(spark, fn.singular(F.lit("Categories"))) == "category"
    assert one(spark, fn.mask_mail(F.lit("x ann.b@shop.example y"))) == "x a***@shop.example y"
    assert one(spark, fn.luhn(F.lit("79927398713"))) is True
    assert one(spark, fn.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert one(spark, fn.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0.0
    assert one(spark, fn.format_bytes(F.lit(None).cast("long"))) is None
    assert one(spark, fn.first_sentence(F.lit("One.  Two."))) == "One."
    assert one(spark, fn.extension_of(F.lit("a.b/Makefile"))) == ""


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(100, i) for i in range(101, 140)] + [(3, 3), (None, 1)]
    out = {row.node: row.component for row in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert out == {x: root(x) for x in parent}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string")).collect() == []


def test_importance(spark):
    edges = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "c"), ("d", "a"), ("d", "ghost")]
    out = {r.node: r["rank"] for r in graph.importance(spark.createDataFrame([(x,) for x in "abcd"], "node string"), spark.createDataFrame(edges, "src string, dst string"), 20).collect()}
    rank, links = dict.fromkeys("abcd", 0.25), {"a": "b", "b": "c", "c": "c", "d": "a"}
    for _ in range(20):
        rank = {n: 0.15 / 4 + 0.85 * sum(rank[s] for s, t in links.items() if t == n) for n in "abcd"}
    assert {k: round(v, 9) for k, v in out.items()} == {k: round(v / max(rank.values()), 9) for k, v in rank.items()}


def test_reach(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    out = {(r.node, r.steps) for r in graph.reach(e, spark.createDataFrame([("a",)], "start string"), 3).collect()}
    assert out == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


@pytest.mark.parametrize("seed", [3, 4])
def test_smallest_enclosing(spark, seed):
    r = random.Random(seed)
    spans = [("f", f"s{i:03}", a, a + r.randrange(900)) for i in range(60) for a in [r.randrange(2000)]]
    points = [(f"p{i}", "f", a, a + r.randrange(40)) for i in range(60) for a in [r.randrange(2500)]] + [("null", "f", None, None)]
    out = {x.id: x.span_id for x in relational.smallest_enclosing(spark.createDataFrame(points, "id string, file string, start_line int, end_line int"), spark.createDataFrame(spans, "file string, span_id string, span_start int, span_end int"), ["file"], "id").collect()}
    for p, _, a, b in points:
        fit = [] if a is None else [(e - s, s, i) for _, i, s, e in spans if s <= a and e >= b]
        assert out[p] == (min(fit)[2] if fit else None)


def test_pack(spark):
    rows = [("p", i, s) for i, s in enumerate([5, 6, 20, 1, 1, 9, 3])]
    out = {r.o: r.batch for r in relational.pack(spark.createDataFrame(rows, "k string, o int, s int"), ["k"], "o", "s", 10).collect()}
    assert out == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 4, 6: 5}


def test_diff(spark):
    a = spark.createDataFrame([("x", "1"), ("y", None), ("z", "3")], "k string, v string")
    b = spark.createDataFrame([("x", "1"), ("y", "2"), ("w", None)], "k string, v string")
    assert {(r.k, r.change) for r in relational.diff(a, b, "k", "v").collect()} == {("x", "unchanged"), ("y", "changed"), ("z", "added"), ("w", "removed")}


RULE_LINES = {
    "eval": ("Python", "y = eval(x)", "y = 'eval(x)'"), "new-function": ("JavaScript", "f = new Function(a)", "f = newFunction(a)"), "child-process-exec": ("TypeScript", "exec(cmd)", "re.exec(cmd)"),
    "python-shell": ("Python", "os.system(x)", "run(x, shell=False)"), "pickle-load": ("Python", "pickle.loads(x)", "unpickle.load(x)"), "sql-concat": ("Go", 'q := "select a from b " + x', 'q := "select a"'),
    "tls-verify-off": ("Python", "get(u, verify=False)", "get(u, verify=True)"), "weak-hash": ("Python", "h = md5(x)", "h = sha256(x)"), "weak-random": ("JavaScript", "const token = Math.random()", "const angle = Math.random()"),
    "innerhtml": ("TypeScript", "a.innerHTML = b", "a.innerHTML == b"), "cors-wildcard": ("JavaScript", "cors({ origin: '*' })", "cors({ origin: 'a' })"), "debug-on": ("Python", "DEBUG = True", "DEBUG = False"),
    "jwt-none": ("JavaScript", "algorithms: ['none']", "algorithms: ['RS256']"), "hardcoded-password": ("Go", 'password := "hunter22"', 'password := "your-one"'), "path-join-user": ("JavaScript", "path.join(a, req.query.f)", "path.join(a, b)"),
    "open-redirect": ("JavaScript", "res.redirect(req.query.to)", "res.redirect('/')"), "ssrf": ("JavaScript", "fetch(req.body.url)", "fetch(url)"), "empty-catch": ("JavaScript", "try { a() } catch (e) {\n}", "try { a() } catch (e) { // fine\n}"),
    "python-bare-except": ("Python", "except:", "except E:"), "python-except-pass": ("Python", "except E: pass", "except E: x"), "unhandled-promise": ("JavaScript", "load(a).then(b)", "load(a).then(b).catch(c)"),
    "todo-fixme": ("Go", "// TODO later", "// to do"), "console-log": ("JavaScript", "console.log(a)", "console.error(a)"), "pii-logging": ("Python", "logger.info(user.email)", "logger.info('email')"),
    "pii-in-url": ("JavaScript", "u = `/a?email=${x}`", "u = '/a?id=1'"), "sync-io": ("TypeScript", "fs.readFileSync(a)", "fs.readFile(a)"), "loop-await": ("TypeScript", "for (const a of b) {\n  await c(a)\n}", "for await (const a of b) {\n  c(a)\n}"),
    "select-star": ("SQL", "select * from a", "select b from a"), "float-money": ("Python", "price = float(x)", "weight = float(x)"), "http-plain": ("Go", 'u := "http://a.b"', 'u := "http://localhost"'),
    "cookie-insecure": ("JavaScript", "cookie({ secure: false })", "cookie({ secure: true })"), "csrf-disabled": ("Python", "@csrf_exempt", "@csrf_protect"), "go-unchecked-err": ("Go", "a, _ := f.g(x)", "a, err := f.g(x)"),
    "java-printstack": ("Java", "e.printStackTrace();", "e.print();"), "dotnet-async-void": ("C#", "async void Run()", "async void OnClick()"), "rails-html-safe": ("Ruby", "a.html_safe", "a.safe"),
    "php-extract": ("PHP", "extract($_POST);", "extract($a);"), "rust-unsafe": ("Rust", "unsafe { a() }", "safe { a() }"), "rust-unwrap": ("Rust", "a.unwrap()", "a.unwrap_or(b)"),
}


def test_each_rule(spark):
    assert set(RULE_LINES) == {r.name for r in rules.RULES} and len(rules.RULES) == 39
    rows = [(f"{name}+", lang, good) for name, (lang, good, _) in RULE_LINES.items()] + [(f"{name}-", lang, bad) for name, (lang, _, bad) in RULE_LINES.items()]
    found = {(r.id, r.rule) for r in rules.scan(spark.createDataFrame(rows, "id string, language string, content string")).collect()}
    assert [n for n in RULE_LINES if (f"{n}+", n) not in found] == []
    assert [n for n in RULE_LINES if (f"{n}-", n) in found] == []


def test_rules(spark):
    long = "x" * 1300
    text = "import os\nos.system(x)\n# eval(x)\ny = eval(x)\nz = eval(y)  # lint-ignore:eval\n" + "eval(1)\n" * 9 + f"# TODO a\n# TODO b\neval({long})\n"
    frame = [("f", "Python", text, "a.py", False), ("g", "Rust", "eval(x)", None, None), ("n", "Python", None, "a", False), ("e", "Python", "", "a", False), ("t", "Python", "eval(x)", "a", True), ("cli", "JavaScript", "console.log(1)", "x/bin/a.js", False), ("s", "Python", "a\n# no-eval\nb\neval(x)", "a", False)]
    df = spark.createDataFrame(frame, "id string, language string, content string, path string, is_test boolean")

    def hits(**limits):
        got = {}
        for r in rules.scan(df, **limits).collect():
            got.setdefault((r.id, r.rule), []).append((r.line_no, r.more))
        return {k: sorted(v) for k, v in got.items()}

    assert hits() == {("f", "python-shell"): [(2, 0)], ("f", "eval"): [(4, 0), (7, 0), (8, 0), (9, 0), (10, 0)], ("f", "todo-fixme"): [(15, 1)]}
    assert hits(per_file=None, longest=None, most_lines=None)[("f", "eval")] == [(n, 0) for n in (4, *range(7, 15), 17)]
    assert rules.scan(df.limit(0)).isEmpty()


def test_python_symbols():
    text = 'class A:\n    def b(self, x):\n        """Doc."""\n        if x and y or z:\n            return f(x)\n\nasync def c(): pass\n'
    assert extract.python_symbols_of(text) == [("A", "class", 1, 5, 0, 1, ""), ("A.b", "method", 2, 5, 4, 1, "Doc."), ("c", "function", 7, 7, 1, 0, "")]
    assert extract.python_symbols_of("def (") == []


def test_bm25_prefers_rare_words(spark):
    docs = spark.createDataFrame([(1, "common rare"), (2, "common common"), (3, None), (4, "other")], "id int, t string")
    out = retrieval.bm25(docs, "id", "t", spark.createDataFrame([(7, "rare"), (7, "common"), (7, "rare")], "query_id int, term string")).collect()
    assert [(r.id, r.matched, r["rank"]) for r in sorted(out, key=lambda r: r["rank"])] == [(1, 2, 1), (2, 1, 2)]


def test_nearest_in_blocks(spark):
    r = random.Random(5)
    rows = [(i, [r.random() for _ in range(4)]) for i in range(120)] + [(500, None), (501, [1.0]), (502, [0.0] * 4)]
    df = spark.createDataFrame(rows, "i int, v array<double>")
    asked = df.where("i % 10 = 0")
    small = {(x.query_id, x.id) for x in retrieval.nearest(df, "i", "v", asked, 3, block=4).collect()}
    whole = {(x.query_id, x.id) for x in retrieval.nearest(df, "i", "v", asked, 3).collect()}
    assert small == whole and len([q for q, _ in whole if q == 10]) == 3


def test_archive_limits(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a/b.txt", "hello")
        z.writestr("../evil.txt", "x")
        z.writestr("/abs.txt", "x")
        z.writestr("bomb.txt", "0" * 1_000_000)
        link = zipfile.ZipInfo("link")
        link.external_attr = (stat.S_IFLNK | 0o777) << 16
        z.writestr(link, "a/b.txt")
    (tmp_path / "one.zip").write_bytes(buf.getvalue())
    (tmp_path / "two.zip").write_bytes(b"no zip")
    rows = archives.read_archives(spark, f"{tmp_path}/*.zip").collect()
    assert {(r.path, r.skipped) for r in rows} == {("a/b.txt", None), ("../evil.txt", "unsafe path"), ("/abs.txt", "unsafe path"), ("bomb.txt", "ratio"), ("link", "link"), ("", "no archive")}


def test_folder(spark, tmp_path):
    for name in ("src/a.py", "node_modules/x/b.js", "node_modules/c.js"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    files, pruned = archives.read_folder(spark, str(tmp_path))
    assert [r.path for r in files.collect()] == ["src/a.py"]
    assert [(r.folder, r.n) for r in pruned.collect()] == [("node_modules/", 2)]


def test_sinks(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.append_new(spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string"), path, ["k"])
    sinks.append_new(spark.createDataFrame([(2, "x"), (3, "c")], "k int, v string"), path, ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    base = spark.createDataFrame([(1, "a", 9), (2, "b", 8)], "k int, v string, w int")
    out = sinks.merged(base, spark.createDataFrame([(2, None), (4, "d")], "k int, v string"), ["k"])
    assert sorted((r.k, r.v, r.w) for r in out.collect()) == [(1, "a", 9), (2, None, 8), (4, "d", None)]
    sinks.replace_partitions(spark.createDataFrame([("p", 1), ("q", 1)], "project_id string, n int"), f"{tmp_path}/r")
    sinks.replace_partitions(spark.createDataFrame([("q", 2)], "project_id string, n int"), f"{tmp_path}/r")
    assert sorted((r.project_id, r.n) for r in spark.read.parquet(f"{tmp_path}/r").collect()) == [("p", 1), ("q", 2)]


def test_nearest_of_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(60, 0, -1)]
    df = spark.createDataFrame(rows, "i int, v array<double>").coalesce(1)
    got = [x.id for x in retrieval.nearest(df, "i", "v", df.where("i = 50"), 5).orderBy("rank").collect()]
    assert got == [1, 2, 3, 4, 5]
