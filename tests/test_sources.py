"""Readers, source specs and sinks on real files."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from townhall_spark.schemas import CANONICAL_MEETING, PLACE_TO_COUNTY
from townhall_spark.sources import readers, sinks, specs

COLUMNS = ["st_fips", "state_name", "place_name", "place_govt", "meeting_date",
           "caption_text_clean", "vid_id"]


def caption(i, year):
    return (f"{1000000 + i}", "Ohio", f"Town {i}", "City Council", f"{year}-01-05",
            f"caption {i}", f"v{year}{i}", "unused")


@pytest.fixture(scope="module")
def raw_dir(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    for year, n in ((2014, 3), (2015, 2)):
        rows = [caption(i, year) for i in range(n)]
        spark.createDataFrame(rows, [*COLUMNS, "extra"]).coalesce(1).write.parquet(
            f"{root}/localview/meetings.{year}.parquet")
    (root / "meetingbank").mkdir()
    with (root / "meetingbank" / "sample.jsonl").open("w") as out:
        for i in range(5):
            out.write(json.dumps({"uid": f"DenverCityCouncil_0501201{i // 2}_x{i}",
                                  "transcript": f"segment {i}", "id": i}) + "\n\n")
    return str(root)


def test_years(spark, raw_dir):
    known = [2014, "2015", 2016]
    df = readers.read_years(spark, f"{raw_dir}/localview", [2013, 2014, 2015], known, COLUMNS)
    assert df.count() == 5 and df.columns == COLUMNS
    assert readers.read_years(spark, f"{raw_dir}/localview", [2015], known).count() == 2
    with pytest.raises(ValueError):
        readers.read_years(spark, raw_dir, [1999], known)


def test_shipped_sources(spark, raw_dir):
    pytest.importorskip("yaml")
    assert specs.available_sources() == ["localview", "meetingbank"]
    loaded = [specs.load_spec(name) for name in specs.available_sources()]
    records = specs.ingest(spark, loaded, raw_dir)
    rows = records.collect()
    assert {r.source: r.kept for r in specs.ingest_counts(records).collect()} == {
        "localview": 3, "meetingbank": 3}
    assert len({r.ingest_seq for r in rows}) == 6
    assert max(r.ingest_seq for r in rows if r.source == "localview") < min(
        r.ingest_seq for r in rows if r.source == "meetingbank")
    denver = sorted((r.meeting_date.year, r.transcript) for r in rows
                    if r.source == "meetingbank")
    assert denver == [(2010, "segment 0\n\nsegment 1"), (2011, "segment 2\n\nsegment 3"),
                      (2012, "segment 4")]
    town = next(r for r in rows if r.source_record_id == "v20141")
    assert (town.state, town.source_url, town.transcript) == (
        "OH", "https://www.youtube.com/watch?v=v20141", "caption 1")


def test_a_present_file_is_read_whole_unless_a_sample_is_asked_for(spark, tmp_path):
    (tmp_path / "meetingbank").mkdir()
    with (tmp_path / "meetingbank" / "sample.jsonl").open("w") as out:
        for i in range(500):
            out.write(json.dumps({"uid": f"DenverCityCouncil_05012017_x{i}",
                                  "transcript": f"segment {i}"}) + "\n")
    mapping = {"loader": {"type": "huggingface_streaming"},
               "mapper": {"type": "meetingbank_segments"}}
    whole, = specs.run_source(
        spark, specs.SourceSpec.from_mapping("meetingbank", mapping), str(tmp_path)).collect()
    assert whole.transcript == "\n\n".join(f"segment {i}" for i in range(500))
    sampled, = specs.run_source(spark, specs.SourceSpec.from_mapping(
        "meetingbank", {**mapping, "sample": {"size": 3}}), str(tmp_path)).collect()
    assert sampled.transcript == "segment 0\n\nsegment 1\n\nsegment 2"


@pytest.mark.parametrize("split", ["128m", "2k"])
def test_arrival_follows_files_and_rows_not_their_sizes(spark, tmp_path, split):
    """Small, large and middle files, packed into tasks by size, and cut into small splits."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        wanted, at = [], 0
        folder = tmp_path / "meetingbank" / "sample.jsonl"
        folder.mkdir(parents=True)
        for part, n in enumerate((3, 700, 90)):
            with (folder / f"part-{part}.json").open("w") as out:
                for _ in range(n):
                    wanted.append(f"segment {at}")
                    out.write(json.dumps({"uid": "DenverCityCouncil_05012017_x",
                                          "transcript": f"segment {at}"}) + "\n" * (1 + at % 3))
                    at += 1
        spec = specs.SourceSpec.from_mapping("meetingbank", {
            "loader": {"type": "huggingface_streaming"}, "mapper": {"type": "meetingbank_segments"}})
        row, = specs.run_source(spark, spec, str(tmp_path)).collect()
        assert row.transcript.split("\n\n") == wanted
        assert row.ingest_seq == 0

        year = tmp_path / "localview" / "meetings.2014.parquet"
        for part, n in enumerate((3, 700, 90)):
            spark.createDataFrame([caption(1000 * part + i, 2014) for i in range(n)],
                                  [*COLUMNS, "extra"]).coalesce(1).write.mode("append").parquet(
                str(tmp_path / f"made{part}"))
            made, = (tmp_path / f"made{part}").glob("part-*.parquet")
            year.mkdir(parents=True, exist_ok=True)
            (year / f"part-{part}.parquet").write_bytes(made.read_bytes())
        rows = readers.read_years(spark, str(tmp_path / "localview"), [2014], [2014],
                                  ["vid_id"], arrival="n").orderBy("n").collect()
        assert [r.vid_id for r in rows] == [
            f"v2014{1000 * p + i}" for p, n in enumerate((3, 700, 90)) for i in range(n)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_new_source_is_a_mapping(spark, raw_dir):
    spec = specs.SourceSpec.from_mapping("localview", {
        "loader": {"type": "dataverse_parquet", "years": [2014, 2015],
                   "known_years": [2014, 2015]},
        "mapper": {"type": "generic_tabular"}, "sample": {"size": 4},
        "field_map": {"jurisdiction_fips": {"copy": "st_fips"},
                      "meeting_date": {"parse_date": {"column": "meeting_date"}},
                      "meeting_type": {"const": "other"}}})
    rows = specs.run_source(spark, spec, raw_dir).collect()
    assert len(rows) == 4
    assert {(r.meeting_type, r.state, r.transcript_quality) for r in rows} == {
        ("other", "", "metadata_only")}
    with pytest.raises(KeyError):
        specs.run_source(spark, specs.SourceSpec("x", {"type": "ftp"}, "generic_tabular"),
                         raw_dir)


def test_read_or_empty(spark, raw_dir, tmp_path):
    missing = readers.read_or_empty(spark, str(tmp_path / "none.csv"), PLACE_TO_COUNTY, "csv")
    assert missing.count() == 0 and missing.columns == PLACE_TO_COUNTY.names
    (tmp_path / "p.csv").write_text("junk,county_fips,place_fips\nx,01001,0007\n")
    found = readers.read_or_empty(
        spark, [str(tmp_path / "none.csv"), str(tmp_path / "p.csv")], PLACE_TO_COUNTY, "csv")
    assert tuple(found.first())[:2] == ("0007", "01001")


def test_csv_keys_stay_text(spark, tmp_path):
    (tmp_path / "nri.csv").write_text(
        "STCOFIPS,STATEABBRV,COUNTY,POPULATION,RISK_SCORE,IFLD_RISKS,OTHER\n"
        "01001,AL,Autauga,58805,bad,1.5,9\n")
    row = readers.read_counties(spark, str(tmp_path / "nri.csv")).first()
    assert (row.STCOFIPS, row.POPULATION, row.RISK_SCORE, row.IFLD_RISKS, row.HRCN_RISKS) == (
        "01001", 58805, None, 1.5, None)


def test_canonical_jsonl_round_trip(spark, raw_dir, tmp_path):
    pytest.importorskip("yaml")
    records = specs.ingest(spark, [specs.load_spec("localview")], raw_dir).withColumn(
        "ingested_at", F.current_timestamp()).select(*CANONICAL_MEETING.names)
    sinks.write_jsonl(records, str(tmp_path / "c"))
    valid, rejects = readers.read_canonical(spark, str(tmp_path / "c"))
    assert valid.count() == 3 and rejects.count() == 0
    with open(tmp_path / "bad.jsonl", "w") as out:
        out.write('{"canonical_id": "x", "meeting_type": "party"}\n')
    valid, rejects = readers.read_canonical(spark, str(tmp_path / "bad.jsonl"))
    assert valid.count() == 0
    assert "meeting_type" in rejects.first().violations and rejects.first().line is None
    whole = next(json.loads(line) for part in (tmp_path / "c").glob("part-*")
                 for line in part.read_text().splitlines())
    broken = ['{"canonical_id": "cut', "no json", json.dumps({**whole, "ingest_seq": "a word"})]
    (tmp_path / "mixed.jsonl").write_text("\n".join([json.dumps(whole), *broken]))
    valid, rejects = readers.read_canonical(spark, str(tmp_path / "mixed.jsonl"))
    assert [r.canonical_id for r in valid.collect()] == [whole["canonical_id"]]
    assert valid.columns == CANONICAL_MEETING.names
    found = rejects.collect()
    assert sorted(r.line for r in found) == sorted(broken)
    assert all(r.violations[0] == "line" for r in found)


def test_labels_append_and_latest_report(spark, tmp_path):
    labels = spark.createDataFrame([("a", "both")], "action_text string, action_category string")
    sinks.append_labels(labels, str(tmp_path / "g"))
    sinks.append_labels(labels, str(tmp_path / "g"))
    assert readers.read_jsonl(spark, str(tmp_path / "g")).count() == 2
    for stamp, method in (("20240101T000000Z", "lexicon"), ("20240102T000000Z", "lexicon"),
                          ("20230101T000000Z", "model")):
        report = spark.createDataFrame([(method, f"{method}@{stamp}")],
                                       "method string, report string")
        sinks.write_report(report, str(tmp_path / "r"), stamp)
    again = spark.createDataFrame([("model", "model@20230101T000000Z")],
                                  "method string, report string")
    sinks.write_report(again, str(tmp_path / "r"), "20230101T000000Z")
    assert sinks.reports(spark, str(tmp_path / "r")).count() == 3
    assert sinks.newest_report(spark, str(tmp_path / "r")).first().run_ts == "20240102T000000Z"
    latest = {r.method: (r.run_ts, r.report)
              for r in sinks.latest_reports(spark, str(tmp_path / "r")).collect()}
    assert latest == {"lexicon": ("20240102T000000Z", "lexicon@20240102T000000Z"),
                      "model": ("20230101T000000Z", "model@20230101T000000Z")}


@pytest.mark.parametrize("sent", [1 << 20, 3])
def test_any_number_of_files_counts_in_order(spark, tmp_path, monkeypatch, sent):
    """More files than a task lists, in two years, numbered without gaps; also where their
    numbers are too many to be sent to all tasks."""
    monkeypatch.setattr(readers, "SENT_FILES", sent)
    for year, n in ((2014, 60), (2015, 45)):
        spark.range(n).repartitionByRange(n, "id").select(
            F.lit(year).alias("year"), F.explode(F.expr("sequence(1, 1 + CAST(id % 3 AS INT))"))
            .alias("row"), "id").write.parquet(f"{tmp_path}/meetings.{year}.parquet")
    df = readers.read_years(spark, str(tmp_path), [2014, 2015], [2014, 2015],
                            ["year", "row", "id"], arrival="n")
    rows = sorted(df.collect(), key=lambda r: r.n)
    assert [r.n for r in rows] == list(range(len(rows)))
    assert [(r.year, r.id, r.row) for r in rows] == sorted((r.year, r.id, r.row) for r in rows)
    assert len({r.id for r in rows}) == 60


@pytest.mark.parametrize("split", ["128m", "1k"])
def test_broken_lines_are_kept_verbatim(spark, tmp_path, split):
    good = json.dumps({"uid": "DenverCityCouncil_05012017_x", "transcript": "text"})
    bad = ['{"uid": "cut', "  not json  ", '{"uid": 1} trailing', '{"transcript": {"a": 1}']
    folder = tmp_path / "meetingbank" / "sample.jsonl"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text("\n".join([good, bad[0], "", "   ", good, bad[1]] + [good] * 40))
    (folder / "b.json").write_text("\n".join([bad[2], good, bad[3]]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        spec = specs.SourceSpec.from_mapping("meetingbank", {
            "loader": {"type": "huggingface_streaming"}, "mapper": {"type": "meetingbank_segments"}})
        rejects = sorted(specs.line_rejects(spark, [spec], str(tmp_path)).collect(),
                         key=lambda r: r.ingest_seq)
        row, = specs.run_source(spark, spec, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.line for r in rejects] == bad
    assert [r.file[-6:] for r in rejects] == ["a.json", "a.json", "b.json", "b.json"]
    assert {r.source for r in rejects} == {"meetingbank"}
    assert row.transcript == "\n\n".join(["text"] * 43)


def test_scratch_folders_are_released(spark):
    sinks.release(spark)
    kept = sinks.stored(spark.range(5))
    sinks.stored(kept.where("id > 2"))
    made = [Path(p) for p in sinks._MADE[spark.sparkContext.applicationId]]
    other = made[0].parent / f"other-{made[0].name}"
    other.mkdir()
    assert kept.count() == 5 and len(made) == 2 and all(p.is_dir() for p in made)
    assert sinks.release(spark) == 2 and not any(p.exists() for p in made) and other.is_dir()
    assert sinks.release(spark) == 0
    other.rmdir()


def test_a_write_that_fails_leaves_the_table_as_it_was(spark, tmp_path):
    """And a table may be computed from the one that it replaces."""
    lost = F.when(F.col("id") == 39, F.raise_error(F.lit("lost"))).otherwise(F.col("id"))
    for write, read in ((sinks.write_parquet, spark.read.parquet), (sinks.write_jsonl, spark.read.json)):
        path = str(tmp_path / write.__name__ / "table")
        write(spark.range(3), path)
        with pytest.raises(Exception, match="lost"):
            write(spark.range(40).select(lost.alias("id")), path)
        assert sorted(r.id for r in read(path).collect()) == [0, 1, 2]
        write(read(path).select((F.col("id") + 10).alias("id")), path + "/")
        assert sorted(r.id for r in read(path).collect()) == [10, 11, 12]
        assert [p.name for p in (tmp_path / write.__name__).iterdir()] == ["table"]
    parts = str(tmp_path / "parts")
    sinks.write_parquet(spark.range(4).withColumn("k", F.col("id") % 2), parts, ["k"])
    assert sorted(p.name for p in Path(parts).glob("k=*")) == ["k=0", "k=1"]
