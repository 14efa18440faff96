"""Readers, numbering, previews, profiles and drift."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import GOLDEN
from loomtrail.model import ColumnBinding, SemanticContract
from loomtrail.operators import dfg
from loomtrail.operators import normalize as norm
from loomtrail.sources import csv_blocks, drift, profile, readers

HEADER = "event_id,case_id,activity,event_ts,source_sequence\n"
TEXT = HEADER + "".join(",".join(map(str, r)) + "\n" for r in GOLDEN)


@pytest.fixture()
def csv_file(tmp_path):
    path = tmp_path / "log.csv"
    path.write_text(TEXT)
    return str(path)


def graph_of(raw):
    binding = ColumnBinding("case_id", "activity", "event_ts", "event_id", {"source_sequence": "source_sequence"})
    return [tuple(r) for r in dfg.dfg_edges(norm.normalize(raw, binding, SemanticContract(), "d").events).collect()]


def test_formats_give_the_same_graph(spark, csv_file, tmp_path, golden):
    zipped = tmp_path / "log.csv.gz"
    zipped.write_bytes(gzip.compress(TEXT.encode()))
    rows = readers.read_csv(spark, csv_file)
    assert set(dict(rows.dtypes).values()) == {"string"}
    parquet = str(tmp_path / "p")
    rows.repartition(3, "case_id").write.parquet(parquet)
    expected = [tuple(r) for r in dfg.dfg_edges(golden).collect()]
    assert graph_of(readers.number_rows(rows)) == expected
    assert readers.read_csv_gz(spark, str(zipped), 4).rdd.getNumPartitions() == 4
    numbered = readers.number_rows(readers.read_csv(spark, str(zipped)))
    assert [r.event_id for r in numbered.orderBy("source_row_number").collect()] == [r[0] for r in GOLDEN]
    assert graph_of(numbered) == expected
    assert graph_of(readers.number_parquet_rows(spark, parquet)) == expected


def test_row_numbers_are_contiguous(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(1000).repartition(7).write.parquet(path)
    numbers = sorted(r[0] for r in readers.number_parquet_rows(spark, path).select("source_row_number").collect())
    assert numbers == list(range(1, 1001))
    staged = readers.number_rows(spark.range(500).repartition(6))
    assert sorted(r[0] for r in staged.select("source_row_number").collect()) == list(range(1, 501))


def test_schema_detection_and_header(spark, csv_file, tmp_path):
    types = {r.column_name: r.inferred_type for r in readers.detect_schema(spark, csv_file, "CSV").collect()}
    assert types["event_ts"] == "timestamp" and types["source_sequence"] == "int" and len(types) == 5
    mixed = spark.createDataFrame(
        [("1", "5000000000", "1.5", "true", "2026-01-01", None, "1"), (" 7", "1", "2", "False", "2026-01-02", None, "x")],
        "i string, l string, d string, b string, day string, none string, s string",
    )
    found = [r.inferred_type for r in readers.infer_types(mixed).orderBy("ordinal_position").collect()]
    assert found == ["int", "bigint", "double", "boolean", "date", "string", "string"]
    twice = tmp_path / "twice.csv"
    twice.write_text("a,b,a\n1,2,3\n")
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(twice))


def test_quoted_values(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('a,b\n"say ""hi"", you",\n"",x\n')
    rows = [tuple(r) for r in readers.read_csv(spark, str(path)).collect()]
    assert rows == [('say "hi", you', None), (None, "x")]


def test_json_array(spark, tmp_path, golden):
    path = tmp_path / "log.json"
    keys = ["event_id", "case_id", "activity", "event_ts", "source_sequence"]
    path.write_text(json.dumps([dict(zip(keys, r)) | {"ingest_sequence": i} for i, r in enumerate(GOLDEN)], indent=1))
    log = readers.read_json_events(spark, str(path))
    assert [tuple(r) for r in dfg.dfg_edges(log).collect()] == [tuple(r) for r in dfg.dfg_edges(golden).collect()]


def test_profile(spark, csv_file):
    rows = {r.column_name: r for r in profile.profile(readers.read_csv(spark, csv_file)).collect()}
    assert rows["case_id"].row_count == 10 and rows["case_id"].approx_distinct == 3
    assert (rows["activity"].min_value, rows["activity"].max_value) == ("A", "D")
    assert rows["case_id"].sample_values == ["CASE-001", "CASE-002", "CASE-003"]
    assert not rows["event_id"].nullable_observed


def test_preview_is_bounded(spark):
    wide = spark.range(250).select("id", F.encode(F.lit("abc"), "UTF-8").alias("b"), F.lit(1.50).cast("decimal(5,2)").alias("d"))
    rows = profile.preview(wide, 10_000).collect()
    assert len(rows) == 200 and rows[0].b == "<binary:3 bytes>" and rows[0].d == "1.50"
    assert len(profile.preview(wide, 5).collect()) == 5


def test_timestamp_preview(spark):
    df = spark.createDataFrame([("2026-09-01 10:00:00",), ("2026-09-01T10:00:00Z",), (None,), ("x",)], "t string")
    rows = {r.source_value: r for r in profile.timestamp_preview(df, "t", "Asia/Seoul").collect()}
    assert rows["2026-09-01 10:00:00"].utc_value == "2026-09-01 01:00:00Z"
    assert rows["2026-09-01 10:00:00"].display_value == "2026-09-01 10:00:00 Asia/Seoul"
    assert rows["2026-09-01T10:00:00Z"].timezone_aware and rows["x"].utc_value is None
    assert rows["x"].display_value is None
    assert profile.needs_source_timezone(df, "t").first()[0]
    aware = df.filter(F.col("t").endswith("Z"))
    assert not profile.needs_source_timezone(aware, "t").first()[0]


def test_personal_data_candidates(spark):
    df = spark.createDataFrame([("a@b.org", "10.1.2.3"), ("none", "x")], "m string, ip string")
    found = {(r.column_name, r.pii_kind): r.match_share for r in profile.pii_candidates(df).filter("is_candidate").collect()}
    assert found == {("m", "email"): 0.5, ("ip", "ip_address"): 0.5}


def test_drift(spark, tmp_path):
    for name in ("same", "changed", "gone"):
        (tmp_path / name).write_text(name)
    manifest = drift.file_listing(spark, f"{tmp_path}/*", checksum=True).drop("modified_at").cache()
    assert manifest.count() == 3
    (tmp_path / "changed").write_text("Changed")
    (tmp_path / "gone").rename(tmp_path / "new")
    now = drift.file_listing(spark, f"{tmp_path}/*", checksum=True).drop("modified_at")
    state = {r.path.rsplit("/", 1)[1]: r.drift for r in drift.source_drift(now, manifest).collect()}
    assert state == {"same": "UNCHANGED", "changed": "CHANGED", "gone": "MISSING", "new": "NEW"}


def _write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    return str(folder)


def test_csv_line_breaks_inside_values(spark, tmp_path):
    path = _write(tmp_path / "a", "x.csv", 'id,note\n1,"two\nlines"\n2,b\n')
    assert [tuple(r) for r in readers.read_csv(spark, path).orderBy("id").collect()] == [("1", "two\nlines"), ("2", "b")]


def test_csv_columns_in_another_order_fail(spark, tmp_path):
    path = _write(tmp_path / "b", "x.csv", "id,case_id\n1,c\n")
    _write(tmp_path / "b", "y.csv", "case_id,id\nc,2\n")
    with pytest.raises(Exception):
        readers.read_csv(spark, path).collect()


def test_csv_names_that_differ_in_case_only(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.check_header(spark, _write(tmp_path / "c", "x.csv", "id,ID\n1,2\n"))


def test_late_text_makes_a_column_text(spark, tmp_path):
    path = _write(tmp_path / "d", "x.csv", "n\n" + "1\n" * 21_000 + "word\n")
    assert readers.detect_schema(spark, path, "CSV").first().inferred_type == "string"


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    sizes = {"1.csv": 3, "2.csv": 400, "3.csv": 20}
    for name, n in sizes.items():
        _write(tmp_path / "e", name, "f,i\n" + "".join(f"{name},{i}\n" for i in range(n)))
    rows = readers.number_rows(readers.read_csv(spark, str(tmp_path / "e"))).orderBy("source_row_number").collect()
    assert [(r.f, int(r.i)) for r in rows] == [(name, i) for name, n in sizes.items() for i in range(n)]
    assert [r.source_row_number for r in rows] == list(range(1, 424))


def test_zones_named_by_letters_and_hours(spark):
    from loomtrail.functions.timestamps import parse_utc

    texts = {
        "2026-01-01 10:00:00 UTC": 10, "2026-01-01 10:00:00GMT": 10, "2026-01-01 10:00:00+09": 1,
        "2026-01-01 10:00:00 Etc/GMT+9": 19, "2026-01-01 10:00:00 Asia/Seoul": 1, "2026-01-01 10:00:00": 1,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", F.hour(parse_utc(F.col("t"), "Asia/Seoul")).alias("h")).collect()
    assert {r.t: r.h for r in got} == texts


CSV_PARTS = ['"', '""', ",", "\n", "a", 'b"', '"c', "\r\n", '"x\ny"', '5" pipe', ' "late"', "é", '"q""r"', '"junk"z,']


def _sequential(text):
    """Records of a CSV text, read letter by letter: where a quoted value begins, is left, or is no quoted value."""
    out, record, state, begin = [], "", "field", True
    for c in text.removesuffix("\n") + "\n":
        if c == "\n" and state != "in":
            out.append(record)
            record, state = "", "field"
            continue
        if state == "field":
            state = "in" if c == '"' else ("field" if c == "," else "bare")
        elif state == "in":
            state = "quote" if c == '"' else "in"
        elif state == "quote":
            state = "in" if c == '"' else ("field" if c == "," else "bare")
        else:
            state = "field" if c == "," else "bare"
        record += c
    if state == "in":
        out.append(record.removesuffix("\n"))
    return [r.removesuffix("\r") for r in out if r.removesuffix("\r")]


@pytest.mark.parametrize("block", [3, 11, 64])
def test_csv_records_cut_at_any_byte(spark, tmp_path, block):
    rng = random.Random(block)
    texts = ["h,i\n" + "".join(rng.choice(CSV_PARTS) for _ in range(60)) for _ in range(4)]
    texts.append('h,i\n"' + "open to the end\n" * 5)
    for k, text in enumerate(texts):
        (tmp_path / f"{k}.csv").write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        found = csv_blocks.records(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for k, text in enumerate(texts):
        own = sorted((r for r in found if r["_file"].endswith(f"/{k}.csv")), key=lambda r: (r["_block"], r["_id"]))
        assert [r.value for r in own] == _sequential(text)


def test_one_csv_file_is_many_tasks(spark, tmp_path):
    path = _write(tmp_path / "f", "x.csv", "id,note\n" + "".join(f'{k},"line {k}\nand ""more"""\n' for k in range(3000)) + '3000,"x\n"')
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        assert csv_blocks.lines(spark, path).rdd.getNumPartitions() > 10
        rows = readers.number_rows(readers.read_csv(spark, path)).orderBy("source_row_number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [tuple(r) for r in rows[:-1]] == [(str(k), f'line {k}\nand "more"', k + 1) for k in range(3000)]
    assert tuple(rows[-1]) == ("3000", "x\n", 3001)


def test_header_with_a_line_break(spark, tmp_path):
    path = _write(tmp_path / "g", "x.csv", '"a\nb",c\r\n1,2\r\n')
    assert readers.check_header(spark, path) == ["a\nb", "c"]
    assert [tuple(r) for r in readers.read_csv(spark, path).collect()] == [("1", "2")]
    _write(tmp_path / "g", "y.csv", 'c,"a\nb"\n1,2\n')
    with pytest.raises(ValueError):
        readers.check_header(spark, path)


def test_range_checksums_do_not_depend_on_the_split(spark, tmp_path):
    rng = random.Random(4)
    body = bytes(rng.randrange(256) for _ in range(5000)) + b"\n\n" + b"z" * 700 + b"\n"
    (tmp_path / "a.bin").write_bytes(body)
    (tmp_path / "b.bin").write_bytes(body[:3000] + b"!" + body[3001:])
    (tmp_path / "c.bin").write_bytes(body[:-1])
    path, found, sums = str(tmp_path), [], []
    for block in (37, 1000, 1 << 20):
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        try:
            ranges = drift.range_checksums(spark, path, 512)
            found.append({(r.path.split("/")[-1], r.range_number): r.digest for r in ranges.collect()})
            sums.append({r.path.split("/")[-1]: r.checksum for r in drift.file_checksums(ranges, drift.file_listing(spark, path)).collect()})
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found[0] == found[1] == found[2] and sums[0] == sums[1] == sums[2]
    assert len(set(sums[0].values())) == 3 and max(n for _, n in found[0]) == 5002 // 512
    ranges = ranges.withColumn("file", F.element_at(F.split("path", "/"), -1)).withColumn("path", F.lit("p"))
    a, b = (ranges.where(F.col("file") == f"{n}.bin") for n in "ab")
    changed = drift.changed_ranges(b, a).collect()
    assert [(r.drift, r.start_byte <= 3000 < r.start_byte + 1024) for r in changed] == [("CHANGED", True)]


def test_first_rows_of_many_parts(spark, tmp_path):
    """Spark reads the largest part first; previews and samples still show the first rows in the order of files."""
    for k, n in enumerate((3, 40_000, 5)):
        spark.range(k * 100_000, k * 100_000 + n, 1, 1).selectExpr("id", "concat('v', id) AS v").write.parquet(f"{tmp_path}/part={k}")
    whole = spark.read.parquet(str(tmp_path))
    want = [0, 1, 2, *range(100_000, 100_047)]
    assert [r["id"] for r in profile.preview(whole, 50).collect()] == want
    samples = profile.profile(whole.select("v")).first()["sample_values"]
    assert samples == ["v0", "v1", "v2"]


@pytest.mark.parametrize("held", [csv_blocks.HELD_BYTES, 0])
def test_records_are_put_together_in_order_and_written_once(spark, tmp_path, monkeypatch, held):
    long = "\n".join(f'line ""{k}"", more' for k in range(300))
    body = "".join(f'{k},"text {k}\n{long if k % 40 == 7 else "b"}"\n' for k in range(120))
    path = _write(tmp_path / "o", "x.csv", "id,note\n" + body)
    labels = []
    for module in (csv_blocks, readers):
        if hasattr(module, "stage"):
            monkeypatch.setattr(module, "stage", lambda df, label, own=module.stage: labels.append(label) or own(df, label))
    monkeypatch.setattr(csv_blocks, "HELD_BYTES", held)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2048)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        found = csv_blocks.records(spark, path).collect()
        labels.clear()
        rows = readers.read_numbered_csv(spark, path).orderBy("source_row_number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    places = [(r["_block"], r["_id"]) for r in found]
    assert len({b for b, _ in places}) > 5 and places == sorted(places)
    texts = [f"text {k}\n" + (long.replace('""', '"') if k % 40 == 7 else "b") for k in range(120)]
    assert [tuple(r) for r in rows] == [(str(k), t, k + 1) for k, t in enumerate(texts)]
    assert not {"csv-lines", "numbered-rows"} & set(labels)
