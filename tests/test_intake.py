import gzip

import pytest

from linkweave import schemas
from linkweave.streaming import intake

BODIES = {
    intake.TEXT: [("  https://a 　", "https://a", None), ("", None, "blank"), ("\t ", None, "blank"), (None, None, "blank")],
    intake.OBJECT: [
        ('{"url":" https://a"}', " https://a", None), ('{"URL":"b"} tail', "b", None), ("{}", None, "blank"), ("null", None, "blank"),
        ('{"url":1}', None, "type"), ("[]", None, "type"), ('{"url"', None, "syntax"), ("", None, "syntax"), (None, None, "syntax"),
    ],
    intake.BATCH: [
        ('[{"correlation_id":"1","original_url":"a"}]', [("1", "a")], None), ("[]", None, "empty"), ("null", None, "empty"),
        ('[{"correlation_id":"1","original_url":" "}]', None, "blank"), ('[{"original_url":"a"}]', None, "blank"),
        ('[{"correlation_id":1,"original_url":"a"}]', None, "type"), ("{}", None, "type"), ("[", None, "syntax"), (None, None, "syntax"),
    ],
    intake.DELETE: [('["a","b"]', ["a", "b"], None), ("[]", None, "empty"), ("[1]", None, "type"), ("no", None, "syntax"), (None, None, "syntax")],
    intake.AUDIT: [
        ('{"ts":5,"action":"follow","url":"a"}', (5, "follow", "", "a"), None), ('{"ts":9223372036854775807}', (2**63 - 1, "", "", ""), None),
        ('{"ts":9223372036854775808}', None, "type"), ('{"ts":1.5}', None, "type"), ('{"ts":"1"}', None, "type"), ('{"url":null,"ts":null}', (0, "", "", ""), None),
        ('{"ts":1} {}', None, "syntax"), ("{", None, "syntax"), ("", None, "type"), (None, None, "syntax"),
    ],
}


@pytest.mark.parametrize("kind", BODIES)
def test_judge(spark, kind):
    cases = BODIES[kind]
    rows = spark.createDataFrame([(i, body) for i, (body, _, _) in enumerate(cases)], "i int, body string").coalesce(1)
    got = sorted(intake.judge(rows, kind).select("i", "value", "reason", "accepted").collect())
    for row, (body, value, reason) in zip(got, cases):
        plain = [tuple(v) for v in row.value] if kind == intake.BATCH and row.value is not None else tuple(row.value) if kind == intake.AUDIT and row.value else row.value
        assert (plain, row.reason, row.accepted) == (value, reason, reason is None), body


def test_unknown_kind(spark):
    with pytest.raises(ValueError, match="no such kind"):
        intake.judge(spark.createDataFrame([], "body string"), "xml")


def test_accepted_and_rejected_are_all_lines_exactly_once(spark, tmp_path):
    folder, target = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    lines = [f'{{"url":"u{i}"}}' if i % 3 else f"bad {i}" for i in range(60)]

    def run(checkpoint="cp"):
        stream = intake.body_stream(spark, str(folder), maxFilesPerTrigger=1)
        intake.stream_intake(stream, intake.OBJECT, target, str(tmp_path / checkpoint)).awaitTermination()

    (folder / "a.txt").write_text("\n".join(lines[:20]) + "\n")
    run()
    with gzip.open(folder / "b.txt.gz", "wt") as out:
        out.write("\n".join(lines[20:40]) + "\n")
    (folder / "c.txt").write_text("\n".join(lines[40:]) + "\n" + lines[0] + "\n")
    run()

    def check():
        good = sorted(r.value for r in intake.accepted(spark, target, intake.OBJECT).collect())
        bad = intake.rejected(spark, target, intake.OBJECT).collect()
        assert good == sorted(f"u{i}" for i in range(60) if i % 3)
        assert sorted(r.body for r in bad) == sorted([f"bad {i}" for i in range(60) if i % 3 == 0] + ["bad 0"])
        assert {r.reason for r in bad} == {"syntax"}
        where = {r.body: r.place.file.rsplit("/", 1)[1] for r in bad if r.body != "bad 0"}
        assert all(where[f"bad {i}"] == ("a.txt", "b.txt.gz", "c.txt")[i // 20] for i in range(3, 60, 3))

    check()
    assert intake.accepted(spark, target, intake.OBJECT).select("batch").distinct().count() == 3
    # every micro-batch runs a second time over its own output
    run("other")
    check()


def test_a_batch_without_rejects_and_one_without_lines(spark, tmp_path):
    rows = spark.createDataFrame([('["a"]', None)], f"body string, place {intake.PLACE.simpleString()}")
    write = intake.intake(intake.DELETE, str(tmp_path))
    write(rows, 0)
    write(rows.limit(0), 1)
    assert [r.value for r in intake.accepted(spark, str(tmp_path), intake.DELETE).collect()] == [["a"]]
    assert intake.rejected(spark, str(tmp_path), intake.DELETE).isEmpty()
    write(rows.limit(0), 0)  # run again with other lines: nothing of the first run is left
    assert intake.accepted(spark, str(tmp_path), intake.DELETE).isEmpty()


def test_the_folder_of_rejects_is_not_opened(spark, tmp_path):
    rows = spark.createDataFrame([("{}",), ("x",)], "body string").selectExpr("body", f"cast(null as {intake.PLACE.simpleString()}) as place")
    intake.intake(intake.AUDIT, str(tmp_path))(rows, 0)
    good = intake.accepted(spark, str(tmp_path), intake.AUDIT)
    assert good.columns == ["batch", "place", *schemas.AUDIT.names]
    assert "PartitionFilters: [isnotnull(accepted" in good._jdf.queryExecution().executedPlan().toString()
    assert good.count() == 1


def test_bodies_of_whole_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n"x",\n"y"]\n')
    rows = intake.judge(intake.bodies_of(spark, str(tmp_path), whole=True), intake.DELETE).collect()
    assert [(r.value, r.reason) for r in rows] == [(["x", "y"], None)]
