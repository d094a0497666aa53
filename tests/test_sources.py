import json
import pickle
import re

import pytest
from pyspark.sql import functions as F

from mathloom.functions import loadprep, nested, text
from mathloom.plans import prepare
from mathloom.sources import folders, scans, sinks


@pytest.fixture
def pair_file(tmp_path):
    p = tmp_path / "pairs.txt"
    p.write_text("2*x0^2 + 3*x1#5*x0^2 + 3*x1\n\nno mark\n  x0 + x1 # x0 + x1#rest \n1#1\n")
    return str(p)


def test_pairs(spark, pair_file):
    want = [("2*x0^2 + 3*x1", "5*x0^2 + 3*x1"), ("x0 + x1", "x0 + x1#rest"), ("1", "1")]
    assert [tuple(r) for r in scans.read_pairs(spark, pair_file).collect()] == want
    assert [tuple(r) for r in scans.read_pairs(spark, pair_file, 2).collect()] == want[:2]
    assert scans.read_pairs(spark, pair_file, -1).count() == 3
    with pytest.raises(ValueError):
        scans.read_pairs(spark, pair_file, 0)
    with pytest.raises(Exception, match="no # in line"):
        scans.read_pairs(spark, pair_file, on_missing="raise").collect()
    with pytest.raises(Exception):
        scans.read_pairs(spark, pair_file + "x")


LINES = [
    ({"problem": "p", "answer": "a"}, "a"), ({"problem": "p", "answer": "", "solution": "s"}, "s"), ({"problem": "p", "answer": 0, "solution": "s"}, "s"),
    ({"problem": "p", "answer": 0.0, "solution": "s"}, "s"), ({"problem": "p", "answer": [], "solution": "s"}, "s"), ({"problem": "p", "answer": False, "solution": ["s", "t"]}, "s t"),
    ({"problem": "p", "answer": "0", "solution": "s"}, "0"), ({"problem": "p", "answer": "false"}, "false"), ({"problem": "p", "answer": None, "solution": 0}, "0"),
    ({"problem": "p", "answer": 0}, None), ({"answer": "a"}, None), ([1, 2], None), ({"problem": [["a", "b"], "c"], "answer": ["x", "y"]}, "x y"),
]


def test_records(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text("\n".join([*(json.dumps(x) for x, _ in LINES), "{broken", ""]))
    got = scans.read_records(spark, str(p))
    assert [r[0] for r in got.select(nested.to_words(got["answer"])).collect()] == [a for _, a in LINES if a is not None]
    last = got.collect()[-1]["problem"]
    assert last["kind"] == "nested" and last["cells"] == [["a", "b"], ["c"]]
    assert scans.load(spark, jsonl=str(p)).count() == scans.load(spark, text=str(p)).count() == 10
    deep = spark.createDataFrame([('{"problem": [[["x"]]], "answer": "a"}',)], "value string")
    with pytest.raises(Exception, match="two levels"):
        scans.parse_records(deep).collect()


def test_pickles(spark, tmp_path):
    p = tmp_path / "d.pkl"
    p.write_bytes(pickle.dumps([("a", ["b", "c"]), ("d", [["e"], ["f", "g"]])]))
    assert [tuple(r) for r in scans.load(spark, text=str(p)).collect()] == [("a", "b c"), ("d", "e f g")]
    p.write_bytes(pickle.dumps({"a": 1}))
    with pytest.raises(TypeError):
        scans.load(spark, pickled=str(p))


VALUES = ["x", ["a", "b"], [["a", "b"], ["c"]], [["a"], "b"], [], 'quo"te']


def test_nested_values(spark):
    df = spark.createDataFrame([(i, nested.of_python(v)) for i, v in enumerate(VALUES)], "i int, v struct<kind:string,cells:array<array<string>>>")
    rows = df.orderBy("i").select(nested.to_text(df["v"]).alias("t"), nested.to_json(df["v"]).alias("j"), nested.to_words(df["v"]).alias("w")).collect()
    assert [r["t"] for r in rows] == ["x", "a | b", "a | b || c", "a || b", "", 'quo"te']
    assert [json.loads(r["j"]) for r in rows] == ["x", ["a", "b"], [["a", "b"], ["c"]], [["a"], ["b"]], [], 'quo"te']
    assert rows[2]["w"] == "a b c"
    with pytest.raises(ValueError):
        nested.of_python([[["a"]]])


def test_samples_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("train", i, nested.of_python(f"p{i}"), nested.of_python([f"a{i}", "b"])) for i in range(5)], f"tag string, sample_index long, problem {nested.TYPE.simpleString()}, answer {nested.TYPE.simpleString()}")
    sinks.write_samples(df, str(tmp_path))
    assert [tuple(r) for r in scans.read_pairs(spark, f"{tmp_path}/train_raw.txt").collect()] == [(f"p{i}", f"a{i} | b") for i in range(5)]
    back = scans.read_records(spark, f"{tmp_path}/train_data.jsonl").collect()
    assert [r["answer"]["cells"] for r in back] == [[[f"a{i}", "b"]] for i in range(5)]
    sinks.write_samples(df.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    for bad in ("", None):
        with pytest.raises(ValueError):
            sinks.check_tag(bad)


def test_results_and_log(spark, tmp_path):
    sinks.write_eval_results(spark.createDataFrame([("a", "b")], "generated string, reference string"), str(tmp_path), 7)
    (tmp_path / "array.json").write_text('[{"generated": "x"}, {"reference": "y"}]')
    assert sorted(map(tuple, scans.read_eval_results(spark, str(tmp_path / "array.json")).collect())) == [("", "y"), ("x", "")]
    files = spark.createDataFrame([("d/step_9.json",), ("d/step_10.json",), ("d/x.json",)], "path string")
    assert scans.latest_step(files).first()[0] == "d/step_10.json"
    log = str(tmp_path / "log")
    for k, s in (("a", "queued"), ("b", "queued"), ("a", "complete")):
        sinks.append_jobs(spark.createDataFrame([(k, s)], "job_id string, status string").coalesce(1), log)
    assert spark.read.text(log).count() == 3
    one = tmp_path / "one.txt"
    one.write_text('{"job_id": "a", "n": 1}\n\nbad\n[1]\n{"job_id": "b", "n": 2}\n{"job_id": "a", "n": 3}\n')
    rows = scans.read_job_log(spark, str(one))
    assert {r["job_id"]: json.loads(r["record"])["n"] for r in scans.latest_jobs(rows).collect()} == {"a": 3, "b": 2}
    assert [json.loads(r[0])["n"] for r in scans.last_jobs(rows, 2).select(F.to_json("record")).collect()] == [3, 2] and scans.last_jobs(rows, 0).count() == 1
    assert [r[0].rsplit("/", 1)[1] for r in scans.manifest(spark, str(tmp_path)).filter("path like '%one.txt'").collect()] == ["one.txt"]


def test_reports(tmp_path):
    from datetime import timedelta

    import yaml

    sinks.write_yaml({"b": {"t": timedelta(minutes=1)}, "a": 1}, str(tmp_path / "r.yaml"))
    assert list(yaml.safe_load((tmp_path / "r.yaml").read_text()).items()) == [("b", {"t": 60.0}), ("a", 1)]
    assert scans.read_config(str(tmp_path / "r.yaml"))["a"] == 1


@pytest.mark.parametrize("sizes", [{}, {"a": 0}, {"a": True}, {"a": "1"}])
def test_sizes_are_checked(spark, sizes):
    with pytest.raises(ValueError):
        scans.indices(spark, sizes)


def test_load_steps(spark):
    df = spark.createDataFrame([("a | b", " x | | y | z ")], "problem string, answer string")
    row = loadprep.chain(loadprep.on_answer(loadprep.reversed_order), loadprep.on_both(loadprep.last_element))(df).first()
    assert tuple(row) == ("b", "x")
    assert df.select(loadprep.last_element(F.lit(" | "))).first()[0] == " | "
    with pytest.raises(ValueError):
        loadprep.chain()
    with pytest.raises(ValueError):
        loadprep.chain(lambda d: d.drop("answer"))(df)


def test_text_functions(spark):
    row = spark.range(1).select(
        text.strip(F.lit("  a  \n")).alias("strip"), text.slug(F.lit("--My Job: v2!")).alias("slug"), text.title_of_id(F.lit("me/my-job")).alias("title"), text.owned_id(F.lit("me"), F.lit("My Job")).alias("owned"),
        text.truth_text(F.lit(True)).alias("truth"), text.shorten(F.lit("x" * 51)).alias("short"), text.two_decimals(F.lit(1.234)).alias("two"), text.utc_now().alias("now"), text.new_job_id().alias("job"),
        text.seconds_of(F.expr("interval '1 02:03:04.5' day to second")).alias("seconds"),
    ).first()
    assert (row["strip"], row["slug"], row["title"], row["owned"], row["truth"], row["two"]) == ("a", "my-job-v2", "my job", "me/my-job", "true", "1.23")
    assert row["short"] == "x" * 47 + "..." and row["now"].endswith("+00:00") and len(row["job"]) == 16 and row["seconds"] == 93784.5
    states = {"Kernel complete": "complete", "failed: error": "failed", "CANCELED": "cancelled", "is running": "running", "queued": "queued", "": "unknown", "complete with error": "complete"}
    got = spark.createDataFrame([(k,) for k in states], "t string").select("t", text.state(F.col("t"))).collect()
    assert dict(map(tuple, got)) == states


def part_files(folder, sizes, line=lambda i: f"{i} # a{i}"):
    """Files of consecutive lines in the order of their names."""
    folder.mkdir()
    at = 0
    for k, n in enumerate(sizes):
        (folder / f"part-{k:05d}.txt").write_text("".join(f"{line(i)}\n" for i in range(at, at + n)))
        at += n
    return at


SIZES = [5, 4995, 0, 3, 1200, 1, 700, 2500, 40, 9]


def test_rows_are_numbered_in_the_order_of_the_files(spark, tmp_path):
    n = part_files(tmp_path / "in", SIZES, lambda i: f"{i} # a{i}" if i % 7 else f"{i} # a{i}\n\n  \nno mark {i}")
    for small in ("128m", "4k"):  # whole files, and files in several splits
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        try:
            rows = prepare.numbered(scans.load(spark, text=str(tmp_path / "in"), place=True))
            assert sorted((r["idx"], int(r["problem"])) for r in rows.collect()) == [(i, i) for i in range(n)]
            # a load step that drops rows leaves no gaps, one that moves them is put right
            odd = scans.load(spark, text=str(tmp_path / "in"), place=True).filter("problem % 2 = 1")
            for df in (odd, odd.repartition(5)):
                assert sorted((r["idx"], int(r["problem"])) for r in prepare.numbered(df).collect()) == [(i, 2 * i + 1) for i in range(n // 2)]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    with pytest.raises(ValueError, match="_line"):
        prepare.numbered(scans.load(spark, text=str(tmp_path / "in")))


@pytest.mark.parametrize("limit", [1, 5, 6, 5003, 6204, 9453, 10**6])
def test_first_rows_in_the_order_of_the_files(spark, tmp_path, limit):
    n = part_files(tmp_path / "in", SIZES)
    (tmp_path / "in" / "part-00005.txt").rename(tmp_path / "in" / "part-00005 {x}[1]*.txt")
    got = scans.load(spark, text=str(tmp_path / "in"), limit=limit)
    assert sorted(int(r["problem"]) for r in got.collect()) == list(range(min(n, limit)))


def metrics_of(df):
    """What the scans of an executed plan have counted."""
    nodes, out = [df._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
            continue
        if name.startswith("Scan"):
            out.append(f"number of files read: {node.metrics().apply('numFiles').value()}")
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return "; ".join(out)


def test_limit_reads_the_first_files_only(spark, tmp_path):
    part_files(tmp_path / "in", SIZES)
    for limit, files in ((5, 1), (6, 3)):  # of four, the empty one is no work
        plan = scans.read_pairs(spark, str(tmp_path / "in"), limit)
        plan.collect()
        scan = re.search(r"number of files read: (\d+)", metrics_of(plan))
        assert int(scan[1]) == files


def test_job_log_of_files_with_equal_times(spark, tmp_path):
    """Later appends win, whatever their files are called and whenever they seem to be written."""
    import os

    log = str(tmp_path / "log")
    for status in ("queued", "running", "failed", "done"):
        sinks.append_jobs(spark.createDataFrame([(f"j{i}", status) for i in range(20)], "job_id string, status string").coalesce(1), log)
    sinks.delete_jobs(scans.latest_jobs(scans.read_job_log(spark, log)), spark.createDataFrame([("j3",)], "job_id string"), log)
    for name in os.listdir(log):
        os.utime(f"{log}/{name}", (1_700_000_000, 1_700_000_000))
    rows = {r["job_id"]: json.loads(r["record"])["status"] for r in scans.present_jobs(scans.read_job_log(spark, log)).collect()}
    assert rows == {f"j{i}": "done" for i in range(20) if i != 3}


def test_yaml_in_a_store(spark, tmp_path):
    sinks.write_yaml({"a": [1]}, f"file://{tmp_path}/deep/r.yaml")
    assert scans.read_config(f"file://{tmp_path}/deep/r.yaml", spark) == {"a": [1]}
    with pytest.raises(Exception):
        folders.write_text(spark, f"file://{tmp_path}/deep/r.yaml", "again", replace=False)
    folders.write_text(spark, f"{tmp_path}/deep/r.yaml", "b: 2\n")
    assert scans.read_config(f"{tmp_path}/deep/r.yaml") == {"b": 2} and sorted(p.name for p in (tmp_path / "deep").iterdir() if not p.name.endswith(".crc")) == ["r.yaml"]
