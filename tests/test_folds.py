"""Folds, sources and streams on small inputs."""

import json
import time

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from quarry.functions import canonical
from quarry.functions import text as tx
from quarry.operators import annotation, evaluate, events, graph, pages, publication, quality, structure, temporal
from quarry.operators import catalog as cat
from quarry.plans import datasets
from quarry.plans import log as log_plans
from quarry.sources import objects
from quarry.streaming import events as stream


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "c string").select(expr(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "reasons"),
    [
        ("", ["too_short", "too_few_words"]),
        ("The quick brown fox jumps over the lazy dog near the river bank today.", []),
        ("a b c d e f g h i j k l m n o p q r s t u v w x y z", ["fragmented"]),
        ("Left column text here     right column text\n" * 5, ["columnar_layout"]),
        ("Introductio to the activatio of retentio and engagemen with feedbac from every single alignmen in optimisatio", ["truncated_words"]),
        ("The quick brown fox jumps over the lazy dog near the \ue001\uf8ff river bank.", ["private_use_glyphs"]),
    ],
)
def test_page_assessment(spark, text, reasons):
    assert one(spark, tx.assess_page, text) == reasons


def test_clean_page(spark):
    assert one(spark, tx.clean_page, "water-\r\nfall  \n\n\n\nend ") == "waterfall\n\nend"


@pytest.mark.parametrize(
    ("line", "role"),
    [("", "paragraph"), ("- item", "ul_item"), ("a. Stir it", "ol_item"), ("(2) other", "ol_item"), ("3. Short one", "ol_item"), ("Why it works:", "heading"), ("Rain Gauge", "heading"), ("This is a long sentence that ends the way that prose does end.", "paragraph"), ("lower case words", "paragraph")],
)
def test_line_roles(spark, line, role):
    assert one(spark, lambda c: tx.best_role(tx.line_roles(c))["role"], line) == role


def test_markdown_validation(spark):
    says = lambda t: one(spark, tx.validate_markdown, t)
    assert says(" \n") == ["empty"]
    assert says("# Page 3\n---") == ["too_short", "chrome_only"]
    assert says("```\n" + "x" * 30) == ["unbalanced_fences"]
    assert says("A page with enough words on it.") == []


def test_fences_breadcrumbs_and_limits(spark):
    assert one(spark, tx.without_fence, "```markdown\n# A\n```") == "# A"
    assert one(spark, tx.breadcrumb, "Roof > 2. Rain Gauge > ") == ["Roof", "Rain Gauge"]
    assert one(spark, tx.breadcrumb, "no path") == []
    assert one(spark, lambda c: tx.rate_limited(F.lit(None), c), "Too Many Requests") is True


def test_list_runs(spark):
    rows = [(1, 1, i, t, r) for i, (t, r) in enumerate([("a. One", "ol_item"), ("b. Two", "heading"), ("text", "paragraph"), ("a. Lone", "ol_item"), ("text", "paragraph"), ("b. Lone", "ol_item"), ("1. To see it:", "ol_item")])]
    out = values(pages.list_runs(spark.createDataFrame(rows, "doc long, page long, pos long, text string, role string")), "pos", "promoted")
    assert out == [(0, True), (1, True), (2, False), (3, True), (4, False), (5, False), (6, False)]


def test_merge_continuations(spark):
    rows = [
        (1, 1, 0, "paragraph", "one ", "start", None, None), (1, 2, 1, "paragraph", " two", "mid", None, None), (1, 3, 2, "paragraph", "three", "end", None, None), (1, 3, 3, "paragraph", "four", "end", None, None),
        (2, 1, 0, "list", "a", "start", ["x", "y"], None), (2, 1, 1, "list", "b", "end", ["z"], None), (2, 1, 2, "paragraph", "c", "end", None, None), (2, 1, 3, "paragraph", "d", "mid", None, None), (2, 1, 4, "paragraph", "e", "end", None, None),
        (3, 1, 0, "table", " ", "start", None, [["1"]]), (3, 1, 1, "table", "grid", "mid", None, [["2"], ["3"]]), (3, 1, 2, "table", "late", "end", None, [["4"]]),
    ]
    df = spark.createDataFrame(rows, "doc long, page long, pos long, k string, t string, cont string, items array<string>, rows array<array<string>>")
    out = values(pages.merge_continuations(df), "doc", "pos", "t", "items", "rows")
    assert out == [(1, 0, "one two three", [], []), (1, 3, "four", [], []), (2, 0, "a", ["x", "y", "z"], []), (2, 2, "c", [], []), (2, 3, "d", [], []), (2, 4, "e", [], []), (3, 0, "grid", [], [["1"], ["2"], ["3"], ["4"]])]


def test_figures_in_order(spark):
    """High figures follow the first heading, each before those put there earlier; low ones precede the last texts at the bottom; others go by height."""
    kinds = {"h": ("heading", None, "body", None), "t": ("paragraph", None, "body", None), "f": ("paragraph", None, "bottom", None), "hi": ("figure", 0.1, None, None), "hi2": ("figure", 200.0, None, None), "mid": ("figure", 0.5, None, None), "lo": ("figure", 0.9, None, None), "z": ("figure", None, "bottom", None)}

    def order(*names):
        df = spark.createDataFrame([(1, 1, i, *kinds[n]) for i, n in enumerate(names)], "doc long, page long, pos long, k string, y double, z string, edge string")
        return [names[p] for _, p in values(pages.figures_in_order(df), "rank", "pos")]

    assert order("lo", "hi2", "t", "h", "t", "hi", "f") == ["t", "h", "hi2", "hi", "t", "lo", "f"]
    assert order("mid", "t", "t", "t", "t") == ["t", "t", "mid", "t", "t"]
    assert order("hi", "t", "z", "f", "lo", "f") == ["hi", "t", "z", "lo", "f", "f"]
    assert order("mid", "hi") == ["hi", "mid"] and order("lo") == ["lo"]


def test_deep_contents(spark):
    """Eight levels; a loop that no root reaches doesn't come out."""
    rows = [(1, f"n{i}", f"n{i - 1}" if i else None, f"{i + 1}. Part {i}", i) for i in range(8)] + [(1, "x", "y", "x", 1), (1, "y", "x", "y", 1)]
    out = values(structure.flatten_toc(spark.createDataFrame(rows, "doc long, id string, parent string, title string, printed long")), "id", "path")
    assert out == [(f"n{i}", [f"Part {j}" for j in range(i + 1)]) for i in range(8)]


def test_numbered_groups(spark):
    lists = {
        1: ["3. First", "- one", "two • in • out", "To see more:", "three"],
        2: ["orphan", "1. First", "2. Second", "x"],
        3: ["1. First", "x", "y"],
        4: ["1. First", "2. Second"],
        5: ["7) Head\n  4. nested\n• too", "", "8) Tail"],
    }
    df = spark.createDataFrame([(d, i, t) for d, ts in lists.items() for i, t in enumerate(ts)], "doc long, pos long, text string")
    out = dict(values(structure.numbered_groups(df), "doc", "md"))
    assert out == {1: "1. First\n   - one\n   - two\n   - in\n   - out\n2. To see more:\n   - three", 5: "1. Head\n   - nested\n   - too\n2. Tail"}


def test_containments(spark):
    one = spark.createDataFrame([("Growth loops",), ("A",), ("!",), ("Other",)], "t string")
    two = spark.createDataFrame([("2. LOOPS",), ("The growth  loops",), ("zz",), ("",)], "t string")
    assert values(cat.containments(one, two)) == [("Growth loops", "2. LOOPS"), ("Growth loops", "The growth  loops")]


def test_path_headings(spark):
    rows = [(1, 1, ["Roof", "Rain Gauge"]), (1, 2, []), (1, 3, ["1. Roof", "Other", "Deep"])]
    p = pages.carry_path(spark.createDataFrame(rows, "doc long, page long, path array<string>"))
    assert values(pages.path_headings(p), "page", "level", "title") == [(1, 1, "Roof"), (1, 2, "Rain Gauge"), (3, 2, "Other"), (3, 3, "Deep")]


def test_quality_edges(spark):
    rows = [("a", "x", {"k": "false"}), ("b", "x", {"k": "null"}), ("c", "x", {}), ("d", "y", {"k": '""'})]
    m = spark.createDataFrame(rows, "sample_id string, split string, metadata map<string,string>")
    rules = [quality.Rule("half", "required_metadata", key="k", max_missing="0.5"), quality.Rule("less", "required_metadata", key="k", max_missing="0.49"), quality.Rule("none", "required_metadata", split="z", key="k"), quality.Rule("few", "minimum_samples", split="z", minimum=1)]
    got = {r["rule_id"]: (r["status"], r["failures"], r["offending"], r["truncated"]) for r in quality.report(m, rules, 1).collect()}
    assert got == {"half": ("passed", 2, "b", True), "less": ("failed", 2, "b", True), "none": ("unknown", 0, "", False), "few": ("failed", 0, "", False)}


def test_agreement_edges(spark):
    cells = [("a", "b", x, y, n) for (x, y), n in {("0", "0"): 5, ("0", "1"): 0, ("1", "0"): 0, ("1", "1"): 0}.items()] + [("a", "c", x, y, 0) for x in "01" for y in "01"] + [("b", "c", "0", "0", 4), ("b", "c", "1", "0", 1), ("b", "c", "0", "1", 0), ("b", "c", "1", "1", 0)]
    df = spark.createDataFrame(cells, "left string, right string, left_label string, right_label string, n long")
    got = {(r["left"], r["right"]): (r["observed"], r["kappa"], r["undefined"]) for r in annotation.agreement(df).collect()}
    assert got == {("a", "b"): (1.0, None, "constant identical marginals"), ("a", "c"): (None, None, "no overlap"), ("b", "c"): (0.8, 0.0, None)}


def test_availability(spark):
    acts = ["deprecate", "archive", "activate", "archive", "unarchive", "unarchive", "activate"]
    df = spark.createDataFrame([(1, i, a) for i, a in enumerate(acts)], "version long, seq long, action string")
    out = values(temporal.availability_fold(df), "seq", "state", "refused", "revision")
    assert [r[1:] for r in out] == [("deprecated", False, 1), ("archived", False, 2), ("archived", True, 2), ("archived", False, 2), ("deprecated", False, 3), ("deprecated", False, 3), ("active", False, 4)]


def test_preview(spark):
    df = spark.createDataFrame([(b"ab\xc3\xa9z",), (b"a\x00b",), (b"\xff\xfe",), (b"abc",)], "c binary")
    kind, text, cut = cat.utf8_preview(F.col("c"), 3)
    assert [tuple(r) for r in df.select(kind, text, cut).collect()] == [("text", "ab", True), ("binary", None, False), ("binary", None, False), ("text", "abc", False)]


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (9, None), (6, 5), (10, 11), (11, 12), (12, 13), (13, 10)]
    out = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert values(out) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (10, 10), (11, 10), (12, 10), (13, 10)]
    assert values(graph.components(spark.createDataFrame([], "a long, b long"))) == []


def test_objects(spark, tmp_path):
    import hashlib

    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "good").write_bytes(b"hello")
    (tmp_path / "o" / "bad").write_bytes(b"hullo")
    digest = hashlib.sha256(b"hello").hexdigest()
    wanted = spark.createDataFrame([(n, digest, 5) for n in ("good", "bad", "none")], "name string, sha256 string, size long")
    assert values(objects.read_verified(spark, str(tmp_path / "o"), wanted), "name", "status") == [("bad", "corrupt"), ("good", "verified"), ("none", "missing")]
    first, token = objects.listing(spark, str(tmp_path / "o"), limit=1)
    rest, end = objects.listing(spark, str(tmp_path / "o"), after=token, limit=1)
    assert [[r["path"].rsplit("/", 1)[1] for r in page.collect()] for page in (first, rest)] == [["bad"], ["good"]] and end is None
    (tmp_path / "o" / "page-002.ir.json").write_text("```json\n" + json.dumps({"v": 1, "page": 2}) + "\n```")
    got = objects.page_files(spark, str(tmp_path / "o"), "v int, page int").first()
    assert got["page"] == 2 and got["ir"]["v"] == 1


def test_manifest(spark, tmp_path):
    rows = [(f"s{i}", f"r{i}", "train", "ünï \"q\"\n", "abc", 5) for i in (3, 1, 2)]
    m = spark.createDataFrame(rows, "sample_id string, revision_id string, split string, source_key string, artifact_id string, size_bytes long")
    member = publication.manifest_members(m).orderBy("sample_id").first()
    assert json.loads(member["member"]) == {"artifact": {"id": "abc", "size_bytes": 5}, "revision_id": "r1", "sample_id": "s1", "split": "train"}
    assert member["member"] == json.dumps(json.loads(member["member"]), sort_keys=True, separators=(",", ":"))
    publication.manifest_lines(m, {"b": 1}).select("value").coalesce(1).write.text(str(tmp_path / "m"))
    assert [r["sample_id"] for r in objects.read_manifest(spark, str(tmp_path / "m")).orderBy("line").collect()] == ["s1", "s2", "s3"]


def test_write_once(spark, tmp_path):
    df = spark.range(100).withColumn("t", F.col("id").cast("string"))
    path, back = objects.write_once(df, str(tmp_path))
    again, _ = objects.write_once(df.repartition(3), str(tmp_path))
    other, _ = objects.write_once(df.limit(99), str(tmp_path))
    assert path == again != other and back.count() == 100
    import shutil

    part = next((tmp_path / path.rsplit("/", 1)[1]).glob("part-*.parquet"))
    shutil.copy(part, part.with_name("part-extra.parquet"))
    with pytest.raises(ValueError):
        objects.write_once(df, str(tmp_path))


def test_verified_manifest(spark, tmp_path):
    import hashlib

    def put(name, *lines):
        data = "\n".join(lines).encode()
        (tmp_path / name).write_bytes(data)
        return str(tmp_path / name), hashlib.sha256(data).hexdigest(), len(data)

    head, a, b = '{"dataset_id":"d1"}', '{"sample_id":"a"}', '{"sample_id":"b"}'
    good = put("m", head, a, b)
    assert [r["sample_id"] for r in objects.verified_manifest(spark, *good, {"dataset_id": "d1"}).collect()] == ["a", "b"]
    for args in ((*good, {"dataset_id": "d2"}), (good[0], good[1], 1, {}), (good[0], "0" * 64, good[2], {}), (*put("n", head, b, a), {}), (*put("p", head, a, a), {})):
        with pytest.raises(ValueError):
            objects.verified_manifest(spark, *args)


def test_run_outputs(spark, tmp_path):
    for name in ("document.md", "pages/page-001.md", "pages/page-001.ir.json", "pages/x.txt", "artifacts/f.png", "plan.json", ".hidden", "deep/pages/page-002.md", "page-progress.json", "document.html"):
        (tmp_path / "run" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "run" / name).write_text("é" if name.endswith(".md") else "xy")
    out = values(objects.run_outputs(spark, str(tmp_path / "run")), "name", "kind", "bytes", "chars")
    assert out == [("artifacts/f.png", "artifact", 2, None), ("deep/pages/page-002.md", "other", 2, None), ("document.html", "html", 2, 2), ("document.md", "markdown", 2, 1), ("page-progress.json", "progress", 2, None), ("pages/page-001.ir.json", "page", 2, 2), ("pages/page-001.md", "page", 2, 1), ("pages/x.txt", "other", 2, None), ("plan.json", "plan", 2, None)]


def test_fixture_cases(spark, tmp_path):
    for name, text in {"a/input.pdf": "x", "a/expected.md": "# A", "a/meta.json": "{}", "b/Input.png": "x", "b/Expected.MD": "# B", "c/input.pdf": "x", "d/expected.md": "# D"}.items():
        (tmp_path / "f" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "f" / name).write_text(text)
    files = spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "f"), wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    assert values(objects.fixture_cases(files), "id", "expected", "meta") == [("a", "# A", "{}"), ("b", "# B", None)]
    kinds = spark.createDataFrame([("x/a.PDF",), ("b.jpeg",), ("c.webp",), ("d.gif",), ("none",)], "p string").select(objects.input_kind(F.col("p")))
    assert [r[0] for r in kinds.collect()] == ["pdf", "image", "image", None, None]


def test_imports(spark, tmp_path):
    (tmp_path / "jobs").mkdir()
    job = lambda run, status, *events: json.dumps({"runId": run, "status": status, "events": [{"ts": t, "message": t, "phase": None} for t in events]})
    for name, text in {"1.json": job("r1", "running", "a", "b"), "2.json": job("r1", "completed", "a", "b", "c"), "3.json": "not json", "4.json": "{}", "5.json.migrated": job("r9", "x"), "6.json": job("r2", "failed")}.items():
        (tmp_path / "jobs" / name).write_text(text)
    jobs, evs = objects.import_jobs(spark, str(tmp_path / "jobs"))
    assert values(jobs, "run_id", "status") == [("r1", "completed"), ("r2", "failed")]
    assert values(evs, "run_id", "seq", "ts", "phase") == [("r1", 0, "a", None), ("r1", 1, "b", None), ("r1", 2, "c", None)]
    for run, v in (("r1", 1), ("r2", 2)):
        (tmp_path / "out" / run).mkdir(parents=True)
        (tmp_path / "out" / run / "review.json").write_text(json.dumps({"v": v, "updatedAt": "now"}))
    assert values(objects.import_reviews(spark, str(tmp_path / "out")), "run_id", "updated_at") == [("r1", "now")]


def test_block_markdown(spark):
    blank = {"k": "paragraph", "t": "", "lvl": 1, "tone": None, "ordered": None, "items": [], "headers": None, "rows": None, "caption": None, "artifact": None, "src": None, "display": None, "lang": None}
    cases = [
        ({"k": "list", "items": ["one", "* two\n- in", "", "4. x"]}, "- one\n- two\n  - in\n- 4. x"),
        ({"k": "list", "items": ["1) a", "b", "7. c"], "ordered": None}, "1. a\n2. b\n3. c"),
        ({"k": "list", "items": ["a • b • c"], "ordered": True}, "1. a\n   - b\n   - c"),
        ({"k": "figure", "t": "text", "artifact": " a.png "}, "![text](a.png)\n\n*text*"),
        ({"k": "figure", "t": " ", "caption": None}, "*[Missing figure: Figure]*"),
        ({"k": "figure", "t": "t", "caption": "cap"}, "*[Missing figure: cap]*\n\n*cap*"),
        ({"k": "math", "t": "x", "display": True}, "$$\nx\n$$"),
        ({"k": "math", "t": "x"}, "$x$"),
        ({"k": "code", "t": "y = 1  ", "lang": "py"}, "```py\ny = 1\n```"),
        ({"k": "mermaid", "src": " graph TD "}, "```mermaid\ngraph TD\n```"),
        ({"k": "table", "headers": ["a", "b"], "rows": [["1|2"]]}, "| a | b |\n| --- | --- |\n| 1\\|2 |  |"),
        ({"k": "heading", "t": " H ", "lvl": 3}, "### H"),
    ]
    schema = "i long, k string, t string, lvl int, tone string, ordered boolean, items array<string>, headers array<string>, rows array<array<string>>, caption string, artifact string, src string, display boolean, lang string"
    df = spark.createDataFrame([(i, *(blank | c).values()) for i, (c, _) in enumerate(cases)], schema)
    out = dict(values(df.select("i", structure.keep_markdown().alias("md"))))
    assert [out[i] for i in range(len(cases))] == [md for _, md in cases]


def test_ascii_json(spark):
    text = 'ü "q" \\ \n\x01 \U0001f600 ~'
    assert one(spark, canonical.quoted_ascii, text) == json.dumps(text)


def test_materialise(spark):
    rows = [(0, "Book:", "heading", 2), (1, "3. one", "ol_item", None), (2, "b. 4) two", "ol_item", None), (3, "- three", "ul_item", None), (4, "7", "chrome", None), (5, " text ", "paragraph", None), (6, "Part A", "heading", None)]
    lines = spark.createDataFrame([(1, 1, *r) for r in rows], "doc long, page long, pos long, text string, role string, level long")
    sections = spark.createDataFrame([(1, 1, ["1. Book", "Intro"]), (1, 2, ["1. Book", "Intro", "Deep"])], "doc long, page long, section array<string>")
    raw = spark.createDataFrame([(1, "part a", "12. Part A"), (1, "intro", "Intro")], "doc long, key string, raw string")
    out = values(structure.materialise(lines, sections, raw), "page", "seq", "k", "lvl", "t", "ordered")
    assert out == [(1, 1, "heading", 2, "Intro", None), (1, 2, "heading", 2, "Book", None), (1, 3, "list", None, "one\ntwo", True), (1, 4, "list", None, "three", False), (1, 5, "paragraph", None, "text", None), (1, 6, "heading", 2, "12. Part A", None), (2, 1, "heading", 3, "Deep", None)]


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    rows = [(o, o * 10 + i, f"2024-01-01 00:0{i}:00", k) for o in (1, 2) for i, k in enumerate(["queued", "running", "effect_completed", "failed", "succeeded", "odd"])]
    path = str(tmp_path_factory.mktemp("log") / "events")
    df = spark.createDataFrame(rows, "operation_id long, event_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.unionByName(df.filter("event_id % 2 = 0")).write.parquet(path)
    return path


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_streaming_inbox(spark, log):
    out = run(stream.inbox(spark.readStream.schema(stream.LOG).parquet(log)), "inbox", "append")
    assert out.count() == 12
    assert values(out.groupBy("outcome").count()) == [("applied", 2), ("ignored", 8), ("quarantined", 2)]


def test_streaming_fold_equals_batch(spark, log):
    once = spark.read.parquet(log).dropDuplicates(["event_id"])
    batch = values(events.fold_states(once), "operation_id", "state", "applied", "refused")
    path = log + "-once"
    once.write.parquet(path)
    out = run(stream.fold_states(spark.readStream.schema(stream.LOG).parquet(path)), "fold", "update")
    assert values(out.groupBy("operation_id").agg(F.max_by(F.struct("state", "applied", "refused"), "applied").alias("s")).select("operation_id", "s.*"), "operation_id", "state", "applied", "refused") == batch


def test_streaming_windows(spark, log):
    out = run(stream.kind_counts(spark.readStream.schema(stream.LOG).parquet(log)), "windows", "complete")
    assert sum(r["n"] for r in out.collect()) == 18


def test_merge_into(spark, tmp_path):
    """Keys repeated in a batch, batches run again, late rows, and two versions of a bucket."""
    at, schema = str(tmp_path / "t"), "k long, n long, v string"
    write = stream.merge_into(at, "k", "n", buckets=2)
    table = lambda: [tuple(r) for r in stream.read_merged(spark, at, schema).select("k", "n", "v").collect()]
    put = lambda batch, *rows: write(spark.createDataFrame(rows, schema), batch)
    put(0, (1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (None, 1, "x"))
    assert sorted(table(), key=str) == sorted([(1, 2, "b"), (2, 1, "c"), (None, 1, "x")], key=str)
    for _ in range(2):
        put(1, (2, 3, "d"), (2, 2, "late"), (1, 1, "older"), (3, 1, "e"))
        assert sorted(table(), key=str) == sorted([(1, 2, "b"), (2, 3, "d"), (3, 1, "e"), (None, 1, "x")], key=str)
    put(2)
    for batch in range(3, 7):
        put(batch, (2, batch + 1, "d"))
    assert (2, 7, "d") in table() and len(table()) == 4
    assert all(len(v) <= 2 for v in stream._versions(spark, at).values())


def test_append_and_dispatch(spark, log, tmp_path):
    source = lambda: spark.readStream.schema(stream.LOG).parquet(log)
    for _ in range(2):  # started again, it appends nothing twice
        stream.append_log(source(), str(tmp_path / "log"), str(tmp_path / "at")).awaitTermination()
    rows = stream.ordered_log(spark.read.schema(stream.LOG).parquet(str(tmp_path / "log")))
    assert rows.count() == 18 and values(rows.filter("operation_id = 1"), "n", "event_id")[:3] == [(1, 10), (2, 10), (3, 11)]
    current = spark.createDataFrame([(1, 1)], "operation_id long, epoch long")
    q = source().withColumn("epoch", F.lit(1)).writeStream.foreachBatch(stream.dispatch_into(str(tmp_path / "ticks"), current)).option("checkpointLocation", str(tmp_path / "at2")).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "ticks"))
    assert values(out.groupBy("outcome").count()) == [("applied", 1), ("ignored", 4), ("quarantined", 7)] and out.filter("submitted").count() == 1


def test_upload_with_a_last_part_of_any_size(spark):
    rows = [(1, 1, events.PART_BYTES, events.PART_BYTES * 2 + 5), (1, 2, events.PART_BYTES + 5, events.PART_BYTES * 2 + 5)]
    parts = spark.createDataFrame(rows, "upload long, number long, bytes long, declared long")
    assert [r["complete"] for r in events.upload_complete(parts).collect()] == [False]
    assert [r["complete"] for r in events.upload_complete(parts, last_bytes=None).collect()] == [True]


def test_uploads_of_large_keys(spark, tmp_path):
    """The last part has as many bytes as the key and more than a part's size."""
    rows = [(9_000_001, 1), (9_000_001, 2), (9_000_002, 2), (8_999_999, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = log_plans.e24_uploads(spark, str(tmp_path))
    assert values(out, "upload", "parts", "complete") == [(8_999_999, 1, True), (9_000_001, 2, True), (9_000_002, 1, False)]


def test_batches_are_compared_whatever_the_join(spark):
    """Without broadcasts both sides end in merge joins dealt by one of the columns."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert datasets.p09_batch_differences(spark, DATA).collect() == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_batch_differences_count_repeats_and_nulls(spark):
    batch = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "x"), ("b", None), ("c", "x")], "k string, v string")
    sealed = spark.createDataFrame([("a", "x"), ("b", None), (None, "x"), (None, "x"), ("c", "y")], "k string, v string")
    got = sorted(map(tuple, publication.accepted_batch(batch, sealed).collect()), key=repr)
    assert got == sorted([("a", "x", "not_sealed")] * 2 + [("c", "x", "not_sealed"), ("c", "y", "lacking")] + [(None, "x", "lacking")] * 2, key=repr)


def test_token_f1_goes_through_no_lambda(spark):
    """Odd blanks, fences and signs that lower to a-z; the plan has no function over arrays, which is what made it slow."""
    rows = [(1, "A﻿b K b", "k B x"), (2, None, ""), (3, "```a b``` c", "C"), (4, "é", "e"), (5, "a a b", "a b b")]
    out = evaluate.token_f1(spark.createDataFrame(rows, "id long, predicted string, expected string"))
    assert "lambda" not in out._jdf.queryExecution().toString()
    assert values(out) == [(1, round(4 / 7, 12)), (2, 1.0), (3, 1.0), (4, 0.0), (5, round(4 / 6, 12))]


def test_trim_is_linear_and_stops_at_other_controls(spark):
    """Inner white space doesn't cost its square; what isn't white space at the end isn't passed over."""
    wide = "a" + " " * 300_000 + "b"
    rows = spark.createDataFrame([(" \t" + wide + " \ufeff",), ("abc \x85",), ("  \n",)], "c string")
    begun = time.monotonic()
    got = [tuple(r) for r in rows.select(tx.trim("c"), tx.trim_end("c"), tx.trim_start("c")).collect()]
    assert time.monotonic() - begun < 20
    assert got == [(wide, " \t" + wide, wide + " \ufeff"), ("abc \x85", "abc \x85", "abc \x85"), ("", "", "")]


def test_line_blocks_weigh_a_line_once(spark):
    """The proposals for a line stand once in the plan, however often their best one is read."""
    lines = spark.createDataFrame([(1, 1, 0, "a. One"), (1, 1, 1, "Two")], "doc long, page long, pos long, text string")
    plan = structure.line_blocks(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("what it is|why it works") == 1
