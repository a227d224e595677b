"""Sources, sinks and streams: round trips in fresh folders."""

import zipfile

import pytest
from pyspark.sql import functions as F

from platwork.operators import clean, jobs, match, validate
from platwork.plans.standins import Tables
from platwork.sources import catalog, feeds, jdbc, sinks
from platwork.sources.workbooks import scan_workbooks
from platwork.streaming import watch

AS_OF = "2025-06-30 12:00:00"
SAMPLE = """
Status,Address,Valuation,Permit Number,Description,Issue Date,Type
Open,8 Mill Lane,61000,K-17,Barn with loft,03/09/2021,Farm
Open,77 Quarry Rd,NA,K-18,"Porch ""deep"", rear side",11/30/2021,House

 NA,5 Harbor Sq,48500,K-19,Shop front glazing,06/02/2022,n/a
"""


def test_sample_feed(spark, tmp_path):
    path = tmp_path / "sample.csv"
    path.write_text(SAMPLE)
    df = feeds.scan_feed(spark, str(path))
    rows = df.collect()
    assert len(rows) == 3 and dict(df.dtypes)["Valuation"] == "string"
    assert [r["Valuation"] for r in rows] == ["61000", None, "48500"]
    assert rows[1]["Description"] == 'Porch "deep", rear side' and rows[2]["Type"] is None and rows[2]["Status"] == " NA"
    done = clean.clean_permits(df, AS_OF).collect()
    assert [r.permit_number for r in done] == ["K-17", "K-18", "K-19"]
    assert done[1].address == "77 QUARRY RD" and done[2].valuation == 48500 and str(done[0].issue_date.date()) == "2021-03-09"


def test_formats_and_missing_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        feeds.scan_feed(spark, str(tmp_path / "none.csv"))
    (tmp_path / "a.pdf").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="Unsupported file format: pdf"):
        feeds.scan_feed(spark, str(tmp_path / "a.pdf"))
    assert feeds.scan_feed(spark, str(tmp_path / "a.pdf"), format_type="csv").first().asDict() == {"a": "1", "b": "2"}
    (tmp_path / "b.txt").write_text("a,b\n007,\n")
    assert feeds.scan_feed(spark, str(tmp_path / "b.txt"), columns_map={"x": "a"}).first().asDict() == {"x": "007", "validation_errors": ""}


def test_skip_rows(spark, tmp_path):
    for name, rows in (("one", ["1,x", "2,y"]), ("two", ["3,z"])):
        (tmp_path / f"{name}.csv").write_text("\n".join(["title, with comma", "", "id,v", *rows, "id,v"]) + "\n")
    got = feeds.scan_csv(spark, str(tmp_path), skip_rows=2).collect()
    assert sorted((r.id, r.v) for r in got) == [("1", "x"), ("2", "y"), ("3", "z"), ("id", "v"), ("id", "v")]
    (tmp_path / "three.csv").write_text("t\n\nother,v\n1,2\n")
    with pytest.raises(ValueError, match="Different headers"):
        feeds.scan_csv(spark, str(tmp_path), skip_rows=2)


def test_ragged_records_are_never_cut_in_silence(spark, tmp_path):
    (tmp_path / "r.csv").write_text("id,note\n1,a,b,c\n2\n3,ok\n")
    with pytest.raises(Exception, match="MALFORMED"):
        feeds.scan_csv(spark, str(tmp_path / "r.csv")).collect()
    kept = feeds.scan_feed(spark, str(tmp_path / "r.csv"), ragged="line", columns_map={"key": "id"}).collect()
    assert sorted((r.line, r.validation_errors) for r in kept if r.line) == [("1,a,b,c", "Ragged record; "), ("2", "Ragged record; ")]
    assert [(r.key, r.validation_errors) for r in kept if not r.line] == [("3", "")]
    (tmp_path / "s.csv").write_text("title\nid,note\n1,a,b,c\n3,ok\n")
    skipped = feeds.scan_csv(spark, str(tmp_path / "s.csv"), skip_rows=1, ragged="line").collect()
    assert sorted((r.id, r.line) for r in skipped if not r.line) == [("3", None)] and len(skipped) == 2
    broken = spark.createDataFrame([(1, 'one\ntwo, "three"'), (2, "x")], "id int, note string")
    assert sinks.write_feed(broken, str(tmp_path / "b.csv"))
    back = feeds.scan_csv(spark, str(tmp_path / "b.csv"), multi_line=True).collect()
    assert sorted((r.id, r.note) for r in back) == [("1", 'one\ntwo, "three"'), ("2", "x")]


def write_workbook(path, sheets):
    """A minimal workbook; cells are (kind, value) with kinds shared, inline, number, date, bool."""
    shared, parts = [], {}
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def cell(ref, kind, value):
        if kind == "shared":
            shared.append(value)
            return f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'
        if kind == "inline":
            return f'<c r="{ref}" t="inlineStr"><is><t>{value}</t></is></c>'
        style = {"number": "", "date": ' s="1"', "bool": ' t="b"'}[kind]
        return f'<c r="{ref}"{style}><v>{value}</v></c>'

    for i, (name, rows) in enumerate(sheets.items(), 1):
        xml = "".join(
            f'<row r="{r}">' + "".join(cell(f"{chr(65 + c)}{r}", *v) for c, v in enumerate(row) if v) + "</row>" for r, row in rows.items()
        )
        parts[f"xl/worksheets/sheet{i}.xml"] = f"<worksheet {main}><sheetData>{xml}</sheetData></worksheet>"
    names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
    parts["xl/workbook.xml"] = f'<workbook {main} xmlns:r="{rel}"><sheets>{names}</sheets></workbook>'
    links = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>'
    parts["xl/styles.xml"] = f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'
    parts["xl/sharedStrings.xml"] = f"<sst {main}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>"
    with zipfile.ZipFile(path, "w") as book:
        for name, text in parts.items():
            book.writestr(name, text)


def test_workbooks(spark, tmp_path):
    header = [("shared", "id"), ("inline", "when"), ("shared", "ok"), ("inline", "note")]
    first = {1: header, 2: [("number", "7.0"), ("date", "44941"), ("bool", "1"), None], 4: [("shared", "N/A"), ("date", "44941.5"), None, ("inline", "n")]}
    write_workbook(tmp_path / "a.xlsx", {"Permits": first, "Other": {3: [("inline", "z")], 4: [("number", "1.25")]}})
    write_workbook(tmp_path / "b.xlsx", {"Permits": {1: [header[3], header[0], header[1], header[2]], 2: [("inline", "m"), ("number", "8")]}})
    df = scan_workbooks(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 2
    rows = sorted(map(tuple, df.collect()), key=str)
    assert rows == [("7", "2023-01-15", "True", None), ("8", None, None, "m"), ("N/A", "2023-01-15 12:00:00", None, "n")]
    assert [r.id for r in feeds.scan_feed(spark, str(tmp_path / "a.xlsx")).collect()] == ["7", None]
    other = feeds.scan_feed(spark, str(tmp_path / "a.xlsx"), sheet_name="Other", skip_rows=2)
    assert [r.z for r in other.collect()] == ["1.25"]


def test_jdbc_options():
    whole = jdbc.jdbc_options("jdbc:x", query="SELECT 1", properties={"user": "u"})
    assert whole == {"url": "jdbc:x", "fetchsize": "10000", "user": "u", "query": "SELECT 1"}
    split = jdbc.jdbc_options("jdbc:x", query="SELECT 1", partition_column="id", bounds=(0, 9), num_partitions=4)
    assert split["dbtable"] == "(SELECT 1) AS q" and split["numPartitions"] == "4" and "query" not in split
    for bad in ({}, {"query": "a", "table": "b"}, {"table": "b", "partition_column": "id"}):
        with pytest.raises(ValueError):
            jdbc.jdbc_options("jdbc:x", **bad)


def test_sql_and_catalog(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    assert [r.id for r in jdbc.sql_query(spark, "SELECT id FROM {t} WHERE name = ?", ["b"], t=df).collect()] == [2]
    df.createOrReplaceTempView("people")
    assert [r.id for r in jdbc.sql_query(spark, "SELECT id FROM people WHERE id < :top", {"top": 2}).collect()] == [1]
    assert catalog.table_exists(spark, "people") and not catalog.table_exists(spark, "nobody")
    assert catalog.table_schema(spark, "nobody") is None
    spark.sql("CREATE OR REPLACE TEMP VIEW typed AS SELECT CAST(1 AS DECIMAL(18,2)) AS amount, 'x' AS name")
    rows = catalog.table_schema(spark, "typed").collect()
    assert [(r.ordinal, r.name, r.data_type, r.precision, r.scale, r.is_identity) for r in rows] == [
        (1, "amount", "decimal(18,2)", 18, 2, False), (2, "name", "string", None, None, False),
    ]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, " a ", ["x"]), (2, 'q"u,o', None)], "id int, name string, tags array<string>")
    assert sinks.write_feed(df, str(tmp_path / "deep" / "out.xyz"))
    back = feeds.scan_csv(spark, str(tmp_path / "deep" / "out.csv")).orderBy("id").collect()
    assert [(r.name, r.tags) for r in back] == [(" a ", '["x"]'), ('q"u,o', None)]
    assert not sinks.write_feed(df, str(tmp_path / "deep" / "out.csv"), mode="error")
    assert sinks.append_rows(df, str(tmp_path / "t"), ["id", "name"]) and sinks.append_rows(df, str(tmp_path / "t"), ["id", "name"])
    assert not sinks.append_rows(df.limit(0), str(tmp_path / "t"), ["id", "name"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    rows = jobs.permit_staging_rows(spark.createDataFrame([("1", 5.0), ("2", 6.0)], "permit_number string, valuation double"), F.lit(3), AS_OF)
    sinks.write_staging(rows, str(tmp_path / "s"))
    sinks.write_staging(rows.withColumn("ImportJobID", F.lit(4)), str(tmp_path / "s"))
    sinks.write_staging(rows, str(tmp_path / "s"))
    assert sorted(r.ImportJobID for r in sinks.read_staging(spark, str(tmp_path / "s")).collect()) == [3, 3, 4, 4]
    sinks.write_staging(rows.limit(1), str(tmp_path / "s"), load_id="second file")
    assert sorted(r.ImportJobID for r in sinks.read_staging(spark, str(tmp_path / "s")).collect()) == [3, 3, 3, 4, 4]


def test_stream_equals_batch_and_archives(spark, folder, tmp_path):
    t = Tables(spark, folder)
    raw = t.view("fx_permit_raw").withColumnRenamed("src_row", watch.RECORD)
    parcels = match.parcel_dimension(t.view("fx_parcel"))
    inbox, archive = tmp_path / "in", tmp_path / "done"
    raw.filter(f"{watch.RECORD} % 2 = 0").write.options(header=True, **sinks.CSV_WRITE).csv(str(inbox))

    def run():
        rows = watch.stream_watch_folder(spark, str(inbox), raw.columns, archive=str(archive))
        rows = rows.withColumn(watch.RECORD, F.col(watch.RECORD).cast("bigint"))
        query = watch.stream_match_and_stage(
            rows, parcels, watch.PERMIT, str(tmp_path / "staged"), str(tmp_path / "errors"), str(tmp_path / "state"), AS_OF, job_path=str(tmp_path / "jobs")
        )
        query.awaitTermination()

    run()
    raw.filter(f"{watch.RECORD} % 2 = 1").write.mode("append").options(header=True, **sinks.CSV_WRITE).csv(str(inbox))
    run()
    staged = sinks.read_staging(spark, str(tmp_path / "staged"))
    assert staged.select("ImportJobID").distinct().count() == 2
    logged = {r.import_job_id: r.RecordsTotal for r in spark.read.parquet(str(tmp_path / "jobs")).collect()}
    assert logged == {r.ImportJobID: r["count"] for r in staged.groupBy("ImportJobID").count().collect()}
    assert watch.batch_job_id("a", 0) == watch.batch_job_id("a", 0) != watch.batch_job_id("b", 0)
    columns = ["PermitStagingID", "PermitNumber", "ParcelNumber", "ValidationStatus", "ValidationMessage"]
    batch = match.attach_best_parcel(validate.validate_permits(clean.clean_permits(raw, AS_OF, report=True), AS_OF), parcels)
    want = jobs.permit_staging_rows(batch, 1, AS_OF, row_id=F.col(watch.RECORD)).select(*columns)
    # An empty cell cannot be told from a missing one in delimited text.
    blank = F.nullif(F.col("PermitNumber"), F.lit("")).alias("PermitNumber")
    rows = [sorted(map(repr, d.select(columns[0], blank, *columns[2:]).collect())) for d in (staged, want)]
    assert rows[0] == rows[1]
    errors = spark.read.parquet(str(tmp_path / "errors"))
    assert errors.count() == want.filter("ValidationMessage is not null").count()
    assert errors.filter("RecordData like '%\"permit_number\"%'").count() == errors.count()


def test_stored_tables_can_be_removed(spark, tmp_path):
    from platwork.session import remove_stored

    spark.range(3).write.parquet(str(tmp_path / "platwork" / "few-1"))
    (tmp_path / "other").mkdir()
    for _ in range(2):
        remove_stored(spark, str(tmp_path))
        assert [p.name for p in tmp_path.iterdir()] == ["other"]
