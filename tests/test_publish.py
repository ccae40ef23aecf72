
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from wardline import schemas
from wardline.operators import marts
from wardline.sources import history, sinks, tables
from wardline.sources.files import Files
from wardline.sources.publish import manifest_of, publish, read_published, unlike_manifest, write_version


def test_versions_follow_each_other(make, tmp_path):
    path = str(tmp_path / "t")
    for n in range(5):
        got = publish(make("a long, b string", *[(k, f"v{n}") for k in range(n + 1)]), path, ["b"])
        assert rows(got.select("a", "b")) == [(k, f"v{n}") for k in range(n + 1)]
    spark = got.sparkSession
    assert read_published(spark, path).count() == 5 and read_published(spark, path, back=2).count() == 3
    # The last and two before it are kept.
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("version-")]) == 3
    assert unlike_manifest(spark, path).count() == 0
    assert publish(make("a long, b string"), path).count() == 0


@pytest.mark.parametrize("after", ["nothing", "rows"])
def test_a_write_that_is_killed_leaves_the_version_before(spark, make, tmp_path, after):
    path = str(tmp_path / "t")
    publish(make("a long, p string", (1, "x"), (2, "y")), path, ["p"])

    def killed(df, folder, by):
        if after == "rows":
            write_version(df.filter("p = 'x'"), folder, by)
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        publish(make("a long, p string", (3, "x"), (4, "y")), path, ["p"], write=killed)
    assert rows(read_published(spark, path), "a") == [(1,), (2,)]
    # A driver that died outright leaves its folder; the next version clears it away.
    (tmp_path / "t" / "version-dead").mkdir()
    publish(make("a long, p string", (5, "x")), path, ["p"])
    assert not (tmp_path / "t" / "version-dead").exists() and read_published(spark, path).count() == 1


def test_changed_and_lost_files_are_told(spark, make, tmp_path):
    path = str(tmp_path / "t")
    publish(make("a long, p string", *[(n, f"p{n % 3}") for n in range(30)]), path, ["p"])
    files = sorted((tmp_path / "t").glob("version-*/rows/p=p0/*.parquet"))
    spark.range(3).select(F.col("id").alias("a")).coalesce(1).write.parquet(str(tmp_path / "other"))
    other = next((tmp_path / "other").glob("*.parquet")).read_bytes()
    files[0].write_bytes(other)
    (files[0].parent / f".{files[0].name}.crc").unlink(missing_ok=True)
    told = rows(unlike_manifest(spark, path))
    assert len(told) == 1 and "p=p0/" in told[0][0]


def test_manifest_counts_equal_rows(make):
    one, two = (manifest_of(make("a string", *[("x",)] * n)).agg(F.min("digest")).first()[0] for n in (2, 3))
    assert one != two


def test_exported_month_is_replaced_whole(spark, make, tmp_path):
    made = [(f"q{i}", f"2024-02-0{1 + i % 3} 10:00:00", "u", None) for i in range(9)]
    full = make(schemas.ACCESS_HISTORY, *made).drop("base_objects_accessed")
    args = ("access_history", "query_start_time", "2024-02", str(tmp_path))
    first = rows(history.export_history(full, *args))
    broken = full.withColumn("user_name", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        history.export_history(broken, *args)
    copy = read_published(spark, str(tmp_path / "access_history" / "period=2024-02"))
    assert copy.count() == 9 and rows(history.history_digest(copy.drop("event_date"), *args[1::-1])) == first
    again = history.export_history(full.filter("query_id <> 'q0'"), *args)
    assert again.agg(F.sum("row_count")).first()[0] == 8


def test_owner_reports_are_published_together(make, tmp_path):
    found = make(schemas.EXCEPTIONS, *[(str(i), "STALE", f"u{i % 3}", None, "LOW", "x", "d", None, None) for i in range(9)])
    owners = make("identity string, owner string", ("u0", "ann"), ("u1", "bob"))
    got = sinks.publish_owner_reports(found, owners, str(tmp_path / "o"))
    assert rows(got.groupBy("owner").count()) == [("UNOWNED", 3), ("ann", 3), ("bob", 3)]


def test_mart_readers_keep_their_version(make, tmp_path):
    path = str(tmp_path / "m")
    before = marts.materialize(make("f string, n long", ("A", 1)), "m", "table", path)
    after = marts.materialize(make("f string, n long", ("A", 2), ("B", 1)), "m", "table", path)
    assert rows(before) == [("A", 1)] and rows(after) == [("A", 2), ("B", 1)]


def test_configuration_from_any_storage(spark, tmp_path):
    matrix = tmp_path / "m.json"
    matrix.write_text('{"entra_groups": [{"entra_group_id": "g", "fr_roles": ["A"], "data_sensitivity": "phi"}]}')
    for path in (str(matrix), f"file://{matrix}"):
        assert rows(tables.read_role_matrix(spark, path), "entra_group_id", "fr_roles") == [("g", ["A"])]


def test_files(spark, tmp_path):
    files = Files(spark, f"file://{tmp_path}/x")
    assert files.names() == [] and not files.exists("a")
    files.replace("a", "één")
    files.replace("a", "two")
    assert files.read("a") == "two" and files.names() == ["a"]
    files.remove("a")
    files.remove("a")
    assert files.names() == []

