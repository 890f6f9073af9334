import gzip
import random
from dataclasses import replace
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from contactlink.operators import linking, mapping, reports
from contactlink.operators.rules import parse_rules
from contactlink.plans import queries
from contactlink.plans.contacts import contacts
from contactlink.plans.run import run_match, run_with_store
from contactlink.sources import catalog as cat
from contactlink.sources import files
from contactlink.sources.keystore import (
    HASH_KEY, KEY_IDENTIFIER, KeyState, KeyStore, LevelledKeyStore, empty_state, followed, identifiers_per_key, import_mappings,
    with_current_key,
)
from contactlink.sources.levels import LevelledTable
from contactlink.streaming import incremental

CATALOG = cat.default_catalog()


def write(folder, name, content):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(content)
    return str(folder)


def test_csv_edge_cases(spark, tmp_path):
    content = b'\xef\xbb\xbfA,B,C\n"x ""q"", y","line\nbreak",007\n\nshort\nbad \xff byte,,\n a ,b,c\n'
    df = files.read_csv(spark, write(tmp_path / "in", "a.csv", content))
    rows = [tuple(r[c] or "" for c in "ABC") for r in df.orderBy(files.ORDER).collect()]
    assert df.columns == ["A", "B", "C", files.ORDER]
    assert rows == [('x "q", y', "line\nbreak", "007"), ("short", "", ""), ("bad � byte", "", ""), (" a ", "b", "c")]


def test_headers_that_differ_by_case_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="differ only by case"):
        mapping.check_names(["zip", "ZIP"])


def test_csv_round_trip_keeps_white_space_and_quotes(spark, tmp_path):
    values = [(" a ", 'say "x", y', ""), ("\tb", "two\nlines", None)]
    df = spark.createDataFrame(values, "p string, q string, r string").coalesce(1)
    path = str(tmp_path / "out")
    files.write_csv(files.select_output(df, ["p", "q", "r", "P", "s"][:3] + ["s"]), path)
    back = files.read_csv(spark, path).orderBy(files.ORDER).collect()
    assert [(r.p, r.q, r.r, r.s) for r in back] == [(" a ", 'say "x", y', None, None), ("\tb", "two\nlines", None, None)]


def test_file_inventory_and_profile(spark, tmp_path):
    folder = write(tmp_path / "in", "a.csv", b"A,B\n1,2\n3,4\n")
    write(tmp_path / "in", "notes.txt", b"x")
    assert [(r.filename, r["size"]) for r in files.inventory(spark, folder).collect()] == [("a.csv", 12)]
    names, first, total = files.profile(files.read_csv(spark, folder), files.ORDER, 1)
    assert names == ["A", "B"] and total == 2 and [r.A for r in first.collect()] == ["1"]


def test_auto_mapping(spark):
    cases = {
        "company_name": ("COMPANY_NAME", 100), "SRC_ID": ("SOURCE_ID", 95), "ZIP_SUPP": ("ZIP_CODE", 95), "ZIP4": ("ZIP4", 100),
        "NAME": ("COMPANY_NAME", 70), "ADDRESS": ("ADDRESS_LINE_1", 70), "favourite_colour": None, "": ("RECORD_ID", 70),
        "Phone": ("PHONE_NUMBER", 95), " email\t": ("EMAIL_ADDRESS", 95), "my_city_2": ("CITY", 70),
    }
    headers = spark.createDataFrame([(h,) for h in cases], "header string")
    got = {r.header: (r.standard, r.confidence) for r in mapping.auto_map(headers, CATALOG).collect()}
    assert got == {h: m for h, m in cases.items() if m}
    assert mapping.auto_mapping(["Phone", "x_y_z", "SRC_ID"], CATALOG, spark) == {"Phone": "PHONE_NUMBER", "SRC_ID": "SOURCE_ID"}


def test_apply_mapping_collisions(spark):
    df = spark.createDataFrame([("1", "2", "3", "4")], "a string, b string, T string, d string")
    out = mapping.apply_mapping(df, {"b": "X", "a": "X", "d": "T", "no": "Y"})
    assert out.columns == ["X", "T"] and tuple(out.first()) == ("1", "3")
    assert mapping.apply_mapping(df, {}).columns == df.columns


def test_catalog(spark):
    assert len(CATALOG.columns) == 41 and sum(c.required for c in CATALOG.columns) == 6
    assert cat.default_output_columns(CATALOG)[-4:] == ["DEDUP_KEY", "MATCH_REASON", "MATCH_TIMESTAMP", "MATCHED_RECORD_IDS"]
    found = [r.name for r in cat.search(spark, CATALOG, "zip", "input-fields-(address)").collect()]
    assert found == ["ZIP_CODE", "ZIP4"]
    assert [r["group"] for r in cat.groups(spark, CATALOG).collect()][0] == "confidence-scores"


def test_golden_sample(spark, tmp_path):
    folder = write(tmp_path / "in", "a.csv", b"company_name,phone_number\r\nAcme Modified,415-555-1234\r\n")
    df = files.read_csv(spark, folder)
    names = mapping.auto_mapping([c for c in df.columns if c != files.ORDER], CATALOG, spark)
    known = KeyState(
        spark.createDataFrame([("e3fc8a28d61226c8", "2bf7196f-0cd7-460a-8e9f-976aa5284731", 0)], HASH_KEY),
        empty_state(spark).key_identifier,
        empty_state(spark).key_hash,
    )
    run = run_match(df, mapping=names, state=known, at=datetime(2025, 12, 18, 16, 20, 21, 362286))
    columns = cat.all_output_columns(CATALOG)
    row = files.select_output(run.result, columns).first().asDict()
    filled = {k: v for k, v in row.items() if v}
    assert len(columns) == 44
    assert filled == {
        "COMPANY_NAME": "Acme Modified", "PHONE_NUMBER": "415-555-1234", "COMPANY_NAME_STD": "acme modified",
        "PHONE_STD": "4155551234", "MATCH_REASON": "NEW", "DEDUP_KEY": "2bf7196f-0cd7-460a-8e9f-976aa5284731",
        "MATCH_TIMESTAMP": "2025-12-18T16:20:21.362286",
    }
    assert columns[:8] == ["ADDRESS_CONFIDENCE", "COMPANY_CONFIDENCE", "EMAIL_CONFIDENCE", "PHONE_CONFIDENCE",
                           "COMPANY_NAME", "NAICS_CD", "RECORD_ID", "SIC_CODE"]


def people(spark, names):
    rows = [(i, "CRM", str(i), n, "1 Main St", "94105", "4155551234") for i, n in enumerate(names)]
    return spark.createDataFrame(
        rows, "RID long, SOURCE_TYPE string, SOURCE_ID string, COMPANY_NAME string, ADDRESS_LINE_1 string, ZIP_CODE string, PHONE_NUMBER string"
    )


def test_keys_persist_replays_are_ignored_and_compaction_keeps_state(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path / "store"))
    df = people(spark, ["Acme", "Acme Inc", "Zeta"])
    first = run_with_store(df, store, str(tmp_path / "o1"), "run-1", order="RID")
    second = run_with_store(df, store, str(tmp_path / "o2"), "run-2", order="RID")
    keys = lambda d: {r.RID: r.DEDUP_KEY for r in d.collect()}
    assert keys(first) == keys(second) and second.filter("is_new").isEmpty()
    assert store.commit(KeyState(*(t.limit(0) for t in vars(store.state()).values())), "run-2") == 2
    before = sorted(map(tuple, identifiers_per_key(store.state()).collect()))
    run_with_store(people(spark, ["Omega"]), store, str(tmp_path / "o3"), "run-3", order="RID")
    store.compact()
    assert store.total_runs() == 3
    after = sorted(map(tuple, identifiers_per_key(store.state()).collect()))
    assert set(map(str, before)) <= set(map(str, after)) and len(after) == len(before) + 1
    assert store.state().hash_key.count() == 4


def test_two_writers_of_one_run_are_noticed(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path / "store"))
    row = spark.createDataFrame([(1, i, "x", False, "") for i in "ab"], "run_no bigint, run_id string, path string, is_base boolean, committed_at string")
    row.write.parquet(f"{store.path}/runs")
    with pytest.raises(RuntimeError, match="two writers"):
        store.state()


def test_mapping_import(spark):
    text = '{"data_hash_to_key": {"h1": "k"}, "key_to_data_hashes": {"k": ["h1", "h2"]}, "key_to_identifiers": {"k": ["A:2", "A:1"]}}'
    state = import_mappings(spark.createDataFrame([(text,)], "value string"))
    assert [tuple(r) for r in state.hash_key.collect()] == [("h1", "k", 0)]
    assert identifiers_per_key(state).first().identifiers == ["A:2", "A:1"]
    with pytest.raises(Exception, match="(?i)malformed"):
        import_mappings(spark.createDataFrame([("{broken",)], "value string")).hash_key.collect()


def test_batches_of_a_stream_agree_with_one_run(spark, tmp_path):
    df = people(spark, ["Acme", "Acme Inc", "Zeta", "Acme Co", "Eta"]).withColumn("RID", F.col("RID").cast("string"))
    drop = str(tmp_path / "drop")
    for part in (df.filter("RID < 3"), df.filter("RID >= 3")):
        files.write_csv(part.coalesce(1), drop, mode="append")
    arguments = (str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "progress"))
    for _ in range(2):  # the second start finds nothing to do
        stream = incremental.read_folder(spark, drop, df.columns, max_files=1).withColumn("RID", F.col("RID").cast("long"))
        incremental.incremental_dedup(stream, *arguments, order="RID").awaitTermination()
    got = {r.RID: r.DEDUP_KEY for r in spark.read.parquet(arguments[1]).collect()}
    once = run_match(df.withColumn("RID", F.col("RID").cast("long")), order="RID").result
    assert got == {r.RID: r.DEDUP_KEY for r in once.collect()}
    assert KeyStore(spark, arguments[0]).total_runs() == 2


def test_keys_as_state_of_a_stream(spark, tmp_path):
    names = ["Acme", "Zeta", "Acme", "Eta"]
    df = people(spark, names).drop("RID")
    drop, out, progress = (str(tmp_path / n) for n in ("drop", "out", "progress"))
    hashes = run_match(people(spark, names), order="RID").changes.hash_key.select("data_hash", "dedup_key").collect()
    minted = {r.data_hash: r.dedup_key for r in hashes}
    old = sorted(minted)[0]
    known = replace(empty_state(spark), hash_key=spark.createDataFrame([(old, "older", 1), (old, "old", 2), ("unseen", "x", 1)], HASH_KEY))
    known.hash_key.write.parquet(str(tmp_path / "known"))
    known = replace(known, hash_key=spark.read.parquet(str(tmp_path / "known")))
    read, batches = [], [([1, 2, 3, 4], 4), ([5, None, 7, 8], 4), ([], 0), ([1, 2, 3, 4] * 500, 2000)]
    for numbers, _ in batches:  # batches of equal contacts; the second has a record without a number, the last one many copies
        rows = [(n, *r) for n, r in zip(numbers, df.collect() * 500)]
        part = spark.createDataFrame(rows, f"RID long, {', '.join(f'`{c}` string' for c in df.columns)}")
        files.write_csv(part.coalesce(1), drop, mode="append")
        stream = incremental.read_folder(spark, drop, part.columns)
        query = incremental.stateful_keys(stream, out, progress, "RID", known)
        query.awaitTermination()
        read.append(sum(p["numInputRows"] for p in query.recentProgress))
    assert read == [n for _, n in batches]  # earlier batches are not read again
    assert spark.conf.get(incremental.STATE_STORE, None) is None or "RocksDB" not in spark.conf.get(incremental.STATE_STORE)
    got = spark.read.schema(incremental.HASH_KEYS).parquet(out).collect()
    want = minted | {old: "old"}
    assert {r.data_hash: r.dedup_key for r in got} == want and len({(r.data_hash, r.dedup_key) for r in got}) == len(want)
    for h in want:
        mine = [r for r in got if r.data_hash == h]
        assert sum(r.is_new for r in mine) == (h != old) and [r.first_ord for r in mine].count(None) <= 1
    assert sum(r.n_records for r in got) == 2008


def test_a_group_of_hashes_is_one_call_that_touches_its_own_hashes():
    class Map(dict):
        getValue, updateValue = dict.get, dict.__setitem__  # noqa: N815

    class Handle:
        def getMapState(self, *_):  # noqa: N802
            return Map()

    state = incremental._HashKeys()
    state.init(Handle())
    state.handleInitialState((7,), pd.DataFrame({"hash_group": [7, 7], "data_hash": ["a", "z"], "dedup_key": ["old", "x"]}), None)
    parts = [{"data_hash": ["a", "b"], "minted": ["ma", "mb"], "first_ord": [5.0, None], "n_records": [2, 1]},
             {"data_hash": ["b", "c", "a"], "minted": ["mb", "mc", "ma"], "first_ord": [9, 4, 3], "n_records": [1, 1, 4]}]
    for new in (True, False):  # the same rows again bring nothing new
        out = list(state.handleInputRows((7,), iter([pd.DataFrame(p) for p in parts]), None))
        rows = [tuple(None if pd.isna(v) else v for v in r) for r in out[0].itertuples(index=False)]
        assert len(out) == 1 and rows == [("a", "old", 3, 6, False), ("b", "mb", 9, 2, new), ("c", "mc", 4, 1, new)]
    assert state.keys == {("a",): ("old",), ("z",): ("x",), ("b",): ("mb",), ("c",): ("mc",)}


def test_a_group_does_not_ask_for_what_it_began_with():
    """Records of the first batch are looked up in the rows that the state was started with; other groups ask the store."""
    asked = []

    class Map(dict):
        updateValue = dict.__setitem__  # noqa: N815

        def getValue(self, key):  # noqa: N802
            asked.append(key)
            return self.get(key)

    class Handle:
        def getMapState(self, *_):  # noqa: N802
            return Map()

    state = incremental._HashKeys()
    state.init(Handle())
    state.handleInitialState((7,), pd.DataFrame({"hash_group": [7], "data_hash": ["a"], "dedup_key": ["old"]}), None)
    rows = pd.DataFrame({"data_hash": ["a", "b"], "minted": ["ma", "mb"], "first_ord": [2, 1], "n_records": [1, 1]})
    (out,) = state.handleInputRows((7,), iter([rows]), None)
    assert list(zip(out["dedup_key"], out["is_new"])) == [("old", False), ("mb", True)] and not asked
    (out,) = state.handleInputRows((8,), iter([rows]), None)
    assert asked == [("a",), ("b",)]


def test_a_stream_arrives_in_files_of_bounded_size(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "STREAM_FILE_RECORDS", 100)
    df = contacts(spark, sf_dir)
    half = queries._dropped(df, str(tmp_path / "drop"))
    read = spark.read.options(header=True).csv(str(tmp_path / "drop"))
    sizes = [r["count"] for r in read.groupBy(F.input_file_name()).count().collect()]
    assert half == 2 * (1 + df.count() // 400) and len(sizes) == 2 * half and max(sizes) < 400 and sum(sizes) == df.count()


def test_a_levelled_table_reads_ranges_that_many_keys_ask_for_without_probing(spark, tmp_path, monkeypatch):
    rows = spark.range(6000).select(F.sha2(F.col("id").cast("string"), 256).alias("data_hash"), F.col("id").cast("string").alias("dedup_key"))
    table = LevelledTable(spark, str(tmp_path / "store"), HASH_KEY, "data_hash")
    table.add(rows, "one")
    table.add(rows.limit(0), "none")
    assert [bool(s.buckets) for s in table.sheets()] == [True, False]
    few = {r.dedup_key for r in table.ask(rows.filter("dedup_key < '2' AND length(dedup_key) = 1")).rows.collect()}
    assert few == {"0", "1"}
    monkeypatch.setattr(LevelledTable, "_maybe", lambda *a: pytest.fail("every range is asked for"))
    found = table.ask(rows.filter("dedup_key <> '5'")).rows
    assert sorted(r.dedup_key for r in found.collect()) == sorted(str(i) for i in range(6000) if i != 5)


def test_a_stream_on_a_levelled_store(spark, tmp_path):
    df = people(spark, ["Acme", "Acme Inc", "Zeta", "Acme Co", "Eta"]).withColumn("RID", F.col("RID").cast("string"))
    drop, arguments = str(tmp_path / "drop"), [str(tmp_path / n) for n in ("store", "out", "progress")]
    for part in (df.filter("RID < 3"), df.filter("RID >= 3"), df.filter("RID = 1")):
        files.write_csv(part.coalesce(1), drop, mode="append")
    stream = incremental.read_folder(spark, drop, df.columns, max_files=1).withColumn("RID", F.col("RID").cast("long"))
    incremental.incremental_dedup(stream, *arguments, order="RID", levelled=True).awaitTermination()
    got = spark.read.parquet(arguments[1]).collect()
    once = run_match(df.withColumn("RID", F.col("RID").cast("long")), order="RID").result
    assert {r.RID: r.DEDUP_KEY for r in got} == {r.RID: r.DEDUP_KEY for r in once.collect()} and len(got) == 6
    assert LevelledKeyStore(spark, arguments[0]).total_runs() == 3 and not any(r.is_new for r in got if r.batch == 2)


def test_required_report(spark):
    df = spark.createDataFrame([("CRM", " "), ("CRM", "x")], "SOURCE_TYPE string, COMPANY_NAME string")
    rows = {r.required_column: (r.present, r.filled, r.blank) for r in mapping.required_report(df, CATALOG).collect()}
    assert rows["COMPANY_NAME"] == (True, 1, 1) and rows["ZIP_CODE"] == (False, 0, 2) and len(rows) == 6


def test_files_are_read_by_header_and_in_order(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "b.csv").write_bytes(b"id,name\n1,one\n2,two\n")
    (folder / "c.CSV").write_bytes(b"name,id,more\n" + b"".join(b"n%d,%d,x\n" % (i, i) for i in range(3, 3000)))
    (folder / "a.csv.gz").write_bytes(gzip.compress(b"id,name\n0,zero\n"))
    (folder / "notes.txt").write_bytes(b"id,name\n9,nine\n")
    df = files.read_csv(spark, str(folder), multi_line=False)
    rows = df.orderBy(files.ORDER).collect()
    assert [r["id"] for r in rows] == [str(i) for i in range(3000)]
    assert rows[0]["name"] == "zero" and rows[5]["name"] == "n5" and rows[1]["more"] is None
    named = files.read_csv(spark, [str(folder / "notes.txt"), str(folder / "b.csv")], order=None)
    assert sorted(r["id"] for r in named.collect()) == ["1", "2", "9"]


def jobs_of(spark, name, action):
    """What the action gives, and the number of Spark jobs it starts."""
    spark.sparkContext.setJobGroup(name, name)
    result = action()
    started = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setJobGroup("other", "other")
    return result, started


def test_headers_of_many_files_take_as_many_jobs_as_those_of_few(spark, tmp_path, monkeypatch):
    headers = [b"id,name\n", b"name,id\n", b'"id","na\nme"\n']
    started, rows = {}, {}
    for count in (102, 204):  # Spark lists over 32 paths in a job of its own
        folder = tmp_path / f"in {count}+%41"
        folder.mkdir()
        for i in range(count):
            (folder / f"f {i:03d}%20+é.csv").write_bytes(headers[i % 3] + (b"x%d,%d\n" % (i, i) if i % 3 == 1 else b"%d,x%d\n" % (i, i)))
        (folder / "empty.csv").write_bytes(b"")
        df, started[count] = jobs_of(spark, f"read-{count}", lambda: files.read_csv(spark, str(folder), order=None))
        rows[count] = {r["id"]: r["name"] or r["na\nme"] for r in df.collect()}
        assert sorted(df.columns) == ["id", "na\nme", "name"] and rows[count] == {str(i): f"x{i}" for i in range(count)}
    assert started[102] == started[204]
    # The same where no file is small enough to be read whole.
    monkeypatch.setattr(files, "SMALL_FILE", 0)
    for multi_line in (True, False):
        df = files.read_csv(spark, str(write(tmp_path / "large", "a.csv", b"\nid,name\n" + b"1,x\n" * 9000)), multi_line, order=None)
        assert df.columns == ["id", "name"] and df.count() == 9000
    few = [str(tmp_path / "in 204+%41" / f"f {i:03d}%20+é.csv") for i in range(9)]
    large = files.read_csv(spark, few, order=None)
    assert {r["id"]: r["name"] or r["na\nme"] for r in large.collect()} == {str(i): f"x{i}" for i in range(9)}


def test_files_are_dealt_by_a_session_with_the_same_settings(spark):
    spark.conf.set("fs.some.key", "value")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        session = files._with_sizes(spark, 77)
        assert [session.conf.get(k) for k in ("fs.some.key", "spark.sql.caseSensitive", "spark.sql.files.openCostInBytes")] == ["value", "true", "77"]
        assert spark.conf.get("spark.sql.files.openCostInBytes") != "77"
    finally:
        spark.conf.unset("fs.some.key")
        spark.conf.unset("spark.sql.caseSensitive")


def test_first_records_tell_fields_from_quoted_text(spark, tmp_path):
    write(tmp_path / "in", "a.csv", b'"A,B"\n1\n')
    write(tmp_path / "in", "b.csv", b"A,B\n2,3\n")
    df = files.read_csv(spark, str(tmp_path / "in"), order=None)
    assert df.columns == ["A,B", "A", "B"] and sorted((r[0] or "", r[1] or "") for r in df.collect()) == [("", "2"), ("1", "")]
    write(tmp_path / "none", "a.csv", b"\n\n")
    assert files.read_csv(spark, str(tmp_path / "none"), order=None).count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_csv(spark, write(tmp_path / "other", "notes.txt", b"x"))


def test_bad_records_reach_the_run(spark, tmp_path):
    df = files.read_csv(spark, write(tmp_path / "in", "a.csv", b"COMPANY_NAME,ZIP_CODE\nA,1\nB,2,3,4\nC\n"), keep_corrupt=True)
    run = run_match(df)
    assert run.errors == 2 and run.result.count() == 3
    rows = {r["COMPANY_NAME"]: r for r in run.result.collect()}
    assert [rows[c]["MATCH_REASON"] for c in "ABC"] == ["NEW", "ERROR", "ERROR"]
    assert rows["B"]["ERROR"].endswith("B,2,3,4") and rows["B"]["DEDUP_KEY"] is None and rows["A"]["ERROR"] is None
    assert reports.run_statistics(run.result).first()["errors"] == 2
    # Without an order column the scan itself tells them apart, also where only their number is asked for.
    plain = files.read_csv(spark, str(tmp_path / "in"), order=None, keep_corrupt=True)
    assert tuple(files.count_bad_rows(plain).first()) == (3, 2) and run_match(plain).errors == 2


def test_a_bad_record_may_be_a_partner(spark, tmp_path):
    lines = b"COMPANY_NAME,ADDRESS_LINE_1,ZIP_CODE,PHONE_NUMBER\nAcme,1 Main St,94105,1\nAcme,1 Main St,94105,1,surplus\n"
    run = run_match(files.read_csv(spark, write(tmp_path / "in", "a.csv", lines), keep_corrupt=True))
    assert sorted(r["MATCH_REASON"] for r in run.result.collect()) == ["CMP_ADDR", "ERROR"]


def test_replay_reads_the_first_result_and_writers_do_not_clash(spark, tmp_path):
    df = spark.createDataFrame([(1, "A", "b"), (2, "C", "d")], "RID long, COMPANY_NAME string, ADDRESS_LINE_1 string")
    store = KeyStore(spark, str(tmp_path / "store"))
    first = run_with_store(df, store, str(tmp_path / "out"), "one", order="RID")
    again = run_with_store(df, store, str(tmp_path / "out"), "one", order="RID")
    assert {r["is_new"] for r in again.collect()} == {True} and store.total_runs() == 1 and first.count() == 2
    assert store._claimed(1) == 2 and store._claimed(1) == 3
    with pytest.raises(ValueError):
        run_match(df.withColumn("RID", F.lit(1)), order="RID")


def test_stream_refuses_exchanged_columns(spark, tmp_path):
    folder = write(tmp_path / "in", "a.csv", b"name,id\nx,1\n")
    stream = incremental.read_folder(spark, folder, ["id", "name"])
    with pytest.raises(Exception):
        stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()


def test_a_levelled_table_reads_what_it_is_asked_for(spark, tmp_path):
    table = LevelledTable(spark, str(tmp_path / "t"), HASH_KEY, "data_hash", fan=2, ranges=3)
    assert table.ask(spark.createDataFrame([("a",)], "data_hash string")).rows.count() == 0
    want, rng = {}, random.Random(1)
    for run in range(5):
        rows = {f"h{rng.randrange(60) + 40 * run}": f"k{run}" for _ in range(40)}
        asked = table.ask(spark.createDataFrame([(h,) for h in rows], "data_hash string"))
        assert {r["data_hash"]: r["dedup_key"] for r in asked.rows.collect()} == {h: want[h] for h in rows if h in want}
        assert asked.ranges_read <= asked.ranges <= 3 * 2 * 3
        table.add(spark.createDataFrame(list(rows.items()), "data_hash string, dedup_key string"), f"run-{run}")
        want |= rows
    assert sorted((s.level, s.run) for s in table.sheets()) == [(0, 5), (2, 4)]
    assert {r["data_hash"]: r["dedup_key"] for r in table.rows().collect()} == want
    last = table.ask(spark.createDataFrame([(h,) for h in list(want)[-3:]], "data_hash string"))
    assert last.rows.count() == 3 and last.ranges_read < last.ranges
    nothing = table.ask(spark.createDataFrame([("unknown",)], "data_hash string"))
    assert nothing.rows.count() == 0 and nothing.ranges_read == 0
    assert table.add(spark.createDataFrame([("x", "y")], "data_hash string, dedup_key string"), "run-3") == 4 and len(table.runs()) == 5
    table.add(spark.createDataFrame([], "data_hash string, dedup_key string"), "empty")
    assert table.rows().count() == len(want)
    first = LevelledTable(spark, str(tmp_path / "f"), "k string, v string, run_no bigint, ord bigint", "k", identity=["k", "v"], keep_first=True, fan=2)
    for run in range(2):
        first.add(spark.createDataFrame([("a", "x", 5 - run), ("a", f"y{run}", 1)], "k string, v string, ord long"), str(run))
    assert sorted(map(tuple, first.rows().select("v", "run_no", "ord").collect())) == [("x", 1, 5), ("y0", 1, 1), ("y1", 2, 1)]


def test_a_levelled_store_gives_the_keys_of_a_plain_one(spark, sf_dir, tmp_path):
    df = contacts(spark, sf_dir).filter("RID < 120")
    plain, levelled = KeyStore(spark, str(tmp_path / "plain")), LevelledKeyStore(spark, str(tmp_path / "levelled"), fan=2, ranges=1)
    outputs = []
    for store in (plain, levelled):
        for run, part in enumerate((df.filter("RID % 3 <> 1"), df)):
            run_with_store(part, store, str(tmp_path / f"{type(store).__name__}-{run}"), f"run-{run}", order="RID")
        last = run_with_store(df, store, str(tmp_path / f"{type(store).__name__}-1"), "run-1", order="RID")  # a replay
        state = store.state() if store is plain else store.whole_state()
        outputs.append([sorted(map(tuple, t.collect())) for t in (last.select("RID", "DEDUP_KEY", "is_new", "MATCHED_RECORD_IDS"), state.hash_key.select("data_hash", "dedup_key"),
                        state.key_identifier.select("dedup_key", "identifier"), state.key_hash.select("dedup_key", "data_hash"))])
        assert store.total_runs() == 2
    assert outputs[0] == outputs[1]


def test_aliases_lead_to_the_last_key(spark):
    chain = [(f"k{i}", f"k{i + 1}", i) for i in range(9)] + [("x", "k3", 0), ("y", "z", 1), ("y", "k9", 2)]
    got = {r["alias"]: r["dedup_key"] for r in followed(spark.createDataFrame(chain, "alias string, dedup_key string, run_no long")).collect()}
    assert got == {**{f"k{i}": "k9" for i in range(9)}, "x": "k9", "y": "k9"}


def test_clusters_that_meet_later_share_one_key(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path / "store"))
    rows = [(i, str(i), name, "1 Main St", "94105", "4155551234") for i, name in enumerate(["acme works co", "acme wxxks", "zebra", "acme wxrks"])]
    df = spark.createDataFrame(rows, "RID long, SOURCE_ID string, COMPANY_NAME string, ADDRESS_LINE_1 string, ZIP_CODE string, PHONE_NUMBER string")
    rules = parse_rules({"rules": {"R": {"conditions": [{"field": "COMPANY_NAME", "percentage": 85}]}}})
    first = run_with_store(df.filter("RID < 3"), store, str(tmp_path / "one"), "one", order="RID", mode="cluster", rules=rules)
    before = {r["RID"]: r["DEDUP_KEY"] for r in first.collect()}
    assert len(set(before.values())) == 3
    loose = parse_rules({"rules": {"R": {"conditions": [{"field": "COMPANY_NAME", "percentage": 75}]}}})
    second = run_with_store(df, store, str(tmp_path / "two"), "two", order="RID", mode="cluster", rules=loose)
    after = {r["RID"]: r["DEDUP_KEY"] for r in second.collect()}
    assert after[0] == after[1] == after[3] == min(before[0], before[1]) and after[2] == before[2]
    assert {r["RID"]: r["DEDUP_KEY"] for r in with_current_key(first, store.aliases()).collect()} == {i: after[i] for i in range(3)}
    assert {r["dedup_key"] for r in store.state().hash_key.collect()} == {after[0], after[2]}
    assert {r["dedup_key"] for r in identifiers_per_key(store.state()).collect()} == {after[0], after[2]}


def test_identifier_pointers_equal_the_lists(spark, sf_dir):
    df = contacts(spark, sf_dir).filter("RID < 200").withColumn("DEDUP_KEY", F.when(F.col("RID") % 4 == 1, "HOT").when(F.col("RID") % 7 == 2, "B").otherwise(""))
    known = spark.createDataFrame([("HOT", f"OLD:{i}", i % 3, i) for i in range(40)] + [("HOT", "CRM:10", 9, 1), ("HOT", "OLD:1", 8, 8)], KEY_IDENTIFIER)
    state = KeyState(empty_state(spark).hash_key, known, empty_state(spark).key_hash)
    listed = {r["RID"]: r["MATCHED_RECORD_IDS"] for r in run_match(df, order="RID", state=state).result.collect()}
    run = run_match(df, order="RID", state=state, id_lists=False)
    records = run.result.select(F.col("RID").alias("ord"), F.col("DEDUP_KEY").alias("dedup_key"), F.col("MATCHED_RECORD_COUNT").alias("n_ids"))
    texts = {r["ord"]: r["matched_ids"] for r in linking.ids_text(records, run.identifiers).collect()}
    assert texts == listed and max(map(len, listed.values())) > 400
    resolved = spark.createDataFrame([(i, "K", f"id{i // 2}", True, False) for i in range(50)], "ord long, dedup_key string, identifier string, is_match boolean, is_new boolean")
    ranked, entries = linking.with_id_ranks(resolved, empty_state(spark), slice_bits=2)
    chunks = linking.id_chunks(entries, size=4)
    assert {r["ord"]: r["n_ids"] for r in ranked.collect()} == {i: i // 2 + 1 for i in range(50)}
    assert max(len(r["identifiers"]) for r in chunks.collect()) == 4
    texts = {r["ord"]: r["matched_ids"] for r in linking.ids_text(ranked, chunks, size=4).collect()}
    assert texts == {i: "|".join(f"id{k}" for k in range(i // 2 + 1)) for i in range(50)}
