import json
import os

from tallyforge.operators import dedup as D, flatten as FL
from tallyforge.sources import files as IO


def record(sha, label, units, **more):
    return {"sha256": sha, "label": label, "intra_procedural_graphs": units, **more}


def unit(addr, nodes=(), **more):
    return {"addr": addr, "name": f"f{addr}", "nodes": list(nodes), "edges_seq": None, "edges_cfg": [[0, 1], [1, 1]],
            "blocks": [], "api_calls": [], **more}


def node(i, api):
    return {"node_id": hex(i), "idx": i, "addr": i, "block": 0, "token": "t", "mnemonic": "call", "api": api}


def test_graph_records(spark, tmp_path):
    units = {"func_70": unit(70), "func_1200": unit(1200, [node(0, None), node(1, "X"), node(2, ["A", "B"])]),
             "func_0x40": unit(64, seed_edges=[])}
    (tmp_path / "a_static.json").write_text(json.dumps(record("a", 1, units)))
    (tmp_path / "b_static.json").write_text(json.dumps(record(None, None, {})))
    (tmp_path / "c_static.json").write_text(json.dumps(record("c", 0, units))[:-40])
    (tmp_path / "vocab.json").write_text("[]")
    rec = IO.read_graph_json(spark, str(tmp_path))
    assert sorted((r["sample_id"], r["label"]) for r in rec.select("sample_id", "label").collect()) == [("a", 1), ("b", None)]
    u = FL.explode_units(rec)
    # numeric address order, not key order
    assert [r["unit"] for r in u.orderBy("ord").collect()] == ["func_0x40", "func_70", "func_1200"]
    assert {r["idx"]: r["api"] for r in FL.explode_nodes(u).collect()} == {0: [], 1: ["X"], 2: ["A", "B"]}
    assert FL.explode_edges(u, "edges_seq").count() == 0
    assert FL.explode_edges(u, "edges_cfg").count() == 6
    assert [r["unit"] for r in u.filter("seed_edges is not null").collect()] == ["func_0x40"]


def test_event_log_skips_damaged_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"ts": 1.5, "app": "x", "step": "kept"}\n{"ts": 2, "ap\n\n{"ts": 3.0, "step": "app_done"}\n')
    assert sorted(r["step"] for r in IO.read_event_log(spark, str(tmp_path)).collect()) == ["app_done", "kept"]


def in_order(spark, path):
    """Lines of all part files, in their order."""
    parts = sorted(r[0] for r in spark.read.text(path).select("_metadata.file_path").distinct().collect())
    return [r["value"] for p in parts for r in spark.read.text(p).collect()]


def test_result_table(spark, tmp_path):
    df = spark.createDataFrame([("c", None, 3), ("a_b", 1.5, 2), ('q,"', 2.0, None)], "name string, v double, `n_$` long").repartition(3)
    IO.write_result_table(df, str(tmp_path / "t"), "src", "a note")
    assert in_order(spark, str(tmp_path / "t/latex")) == [
        "% source: src", "% note: a note", r"\begin{tabular}{lrr}", r"\toprule", r"name & v & n\_\$ \\", r"\midrule",
        r"a\_b & 1.5 & 2 \\", r"c & -- & 3 \\", r'q," & 2.0 & -- \\', r"\bottomrule", r"\end{tabular}"]
    assert in_order(spark, str(tmp_path / "t/csv"))[:4] == ["# source: src", "# note: a note", "name,v,n_$", "a_b,1.5,2"]
    back = IO.read_result_table(spark, str(tmp_path / "t"), "name string, v double, `n_$` long")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    mark = spark.read.json(str(tmp_path / "t/provenance")).first()
    assert (mark["columns"], mark["n_rows"], mark["fingerprint"]) == ("name,v,n_$", 3, D.dataset_fingerprint(df).first()["fingerprint"])


def test_table_manifest(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "name string, n long")
    IO.write_result_table(df, str(tmp_path / "first"), "one")
    IO.write_result_table(df.limit(0), str(tmp_path / "second"), "two")
    IO.write_table_manifest(spark, str(tmp_path), ["second", "first"])
    lines = in_order(spark, str(tmp_path / "TABLES_MANIFEST"))
    mark = D.dataset_fingerprint(df).first()["fingerprint"]
    assert lines == ["# Result tables", "", "| table | files | source | fingerprint | rows |", "|---|---|---|---|---|",
                     f"| first | first/csv, first/latex | one | {mark[:16]} | 1 |", "| second | second/csv, second/latex | two | empty | 0 |",
                     "", f"- first = {mark}", "- second = empty"]
    assert in_order(spark, str(tmp_path / "first/csv"))[0] == "# source: one"


def test_binary_dir(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/one.bin").write_bytes(b"MZ\x00one")
    (tmp_path / "two.bin").write_bytes(b"MZ\x00one")
    (tmp_path / "three.bin").write_bytes(b"ELF")
    known = spark.createDataFrame([], "sha256 string")
    got = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in IO.ingest_binary_dir(spark, "MZ", known, str(tmp_path)).collect()}
    assert got["three.bin"] == "bad_magic" and sorted([got["one.bin"], got["two.bin"]]) == ["already_present", "import"]


def test_forwarders(spark):
    df = spark.createDataFrame([("API-ms-win-x.dll",), ("MySetup.exe",), ("tool.exe",), (None,)], "n string")
    assert [r["n"] for r in IO.filename_exclusion(df, "n").collect()] == ["tool.exe", None]


def test_filters_and_columns_reach_the_scan(spark):
    import __spark_entry__ as entry
    plan = entry.queries()["metadata_prefilter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(p_size,30)" in plan and "p_retailprice" not in plan


def test_graph_json_is_compressed(spark, tmp_path):
    path = str(tmp_path / "records")
    IO.write_graph_json(spark.createDataFrame([("a", 1), ("b", 0)], "sample_id string, label int"), path)
    assert [f for f in os.listdir(path) if f.startswith("part-") and not f.endswith(".json.gz")] == []
    assert sorted(map(tuple, IO.read_graph_json(spark, path, "*.json").select("sample_id", "label").collect())) == [("a", 1), ("b", 0)]


def test_edge_lists_take_one_pass(spark):
    units = spark.createDataFrame([("s", "u", [[0, 1]], [[1, 2], [2, 3]]), ("s", "v", None, [[5, 6]])], "sample string, unit string, edges_cfg array<array<int>>, edges_seq array<array<int>>")
    edges = FL.explode_edge_lists(units, {"cfg": "edges_cfg", "seq": "edges_seq"})
    assert sorted(map(tuple, edges.collect())) == [("s", "u", 0, 1, "cfg"), ("s", "u", 1, 2, "seq"), ("s", "u", 2, 3, "seq"), ("s", "v", 5, 6, "seq")]
    assert "Union" not in edges._jdf.queryExecution().executedPlan().toString()
