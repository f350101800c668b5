"""Files, logs, manifests, staged runs."""

import json

from pareframe.operators import reduction, search
from pareframe.operators.stages import Pipeline, Settings, keep_found, keep_graph, keep_levels
from pareframe.sources import files
from pyspark.sql import functions as F


def test_tree_and_logs(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/one.kt").write_text("x\ny")
    (tmp_path / "a/b/two.kt").write_text("z")
    (tmp_path / "a/b/run.log").write_text("noise\n00:00:01.500 - Start P\n00:01:00.000 - Code LOC: 12\n00:02:00.000 - End P\n00:03:00.000 - Code LOC: 7\n")
    assert {r.path.rpartition("/")[2]: r.length for r in files.tree(spark, str(tmp_path), "kt").collect()} == {"one.kt": 3, "two.kt": 1}
    entries = files.log_entries(files.lines(spark, str(tmp_path), "log"))
    assert [float(r.seconds) for r in entries.orderBy("number").collect()] == [1.5, 60, 120, 180]
    inside = files.slice_log(entries, "Start P", "End P").select(files.number_after(F.col("message"), "LOC:").alias("n"), "number").orderBy("number").collect()
    assert [r.n for r in inside] == [0, 12, 0]


def test_manifest_counts_and_reports(spark, tmp_path):
    place = tmp_path / "m.yaml"
    place.write_text("projects:\n- {name: a, build_system: gradle, modules: single}\n- {name: b, build_system: gradle, modules: single, extra: {tags: [android]}}\n- {name: c, build_system: maven, modules: single, extra: {tags: []}}\n")
    projects = files.manifest(spark, str(place))
    assert [r.name for r in files.suitable(projects).collect()] == ["a"]
    counted = files.line_counts(spark.createDataFrame([('{"SUM": {"blank": 1, "code": 5, "other": 2}}',), ("broken",)], "j string"), "j")
    assert sorted(r.total for r in counted.collect()) == [0, 6]
    files.write_report(projects.select("name"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 3
    files.write_trace(spark, [{"kind": "chunk", "retained": 3, "outcome": True}], str(tmp_path / "json"))
    found = [json.loads(x) for p in (tmp_path / "json").glob("part*") for x in p.read_text().splitlines()]
    assert found == [{"test": 0, "kind": "chunk", "retained": 3, "outcome": True}]


def test_stages(spark):
    data = spark.range(24).withColumn("g", F.col("id") % 6)
    wanted = lambda column, values: lambda items: reduction.contains_all(items.withColumn("wanted", F.col(column).isin(values).cast("int")), "wanted")
    stages = {
        "groups": lambda rows, s: keep_found(rows, "g", wanted("g", [2, 5]), s.find),
        "rows": lambda rows, s: keep_found(rows, "id", wanted("id", [8, 11]), s.find),
    }
    state = Pipeline(stages).run(data, Settings(search="pdd", stages=("groups", "rows")))
    assert sorted(r.id for r in state.data.collect()) == [8, 11] and state.version == 2
    assert search.size(search.ddmin(wanted("id", [])(search.numbered(data, "id")), zero=True)) == 0


def test_stages_by_levels_and_by_graph(spark):
    """Functions of files of folders by levels, then what they need by a graph, then single rows."""
    rows = [(i, f"d{i % 3}", f"f{i % 6}", i) for i in range(18)]
    data = spark.createDataFrame(rows, "id long, folder string, file string, n long")
    edges = spark.createDataFrame([(i, i - 6) for i in range(6, 18)] + [(0, 3), (3, 0), (99, 5)], "src long, dst long")
    wanted = {8, 15}

    def of_level(items):
        keys = [c for c in items.columns if c != "idx"]
        counts = data.groupBy(*keys).agg(F.sum(F.col("n").isin(wanted).cast("int")).alias("wanted"))
        return reduction.contains_all(items.join(counts, keys), "wanted")

    targets = spark.createDataFrame([(w,) for w in wanted], "id long")
    stages = {
        "file": lambda rows, s: keep_levels(rows, ["folder", "file"], of_level, s.find),
        "graph": lambda rows, s: keep_graph(rows, edges, s.find, targets=targets),
        "function": lambda rows, s: keep_found(rows, "id", lambda items: reduction.contains_all(items.withColumn("wanted", F.col("id").isin(wanted).cast("int")), "wanted"), s.find),
    }
    steps = {("file",): {2, 8, 14, 3, 9, 15}, ("file", "graph"): {2, 8, 3, 9, 15}, ("file", "graph", "function"): wanted, ("graph",): {2, 8, 3, 9, 15, 0}}
    for names, left in steps.items():
        state = Pipeline(stages).run(data, Settings(stages=names))
        assert {r.id for r in state.data.collect()} == left, names
