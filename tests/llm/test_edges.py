"""Every operator and stage on odd rows and on an empty table."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkweave.llm import decontaminate, language, languagemodel, licenses, linedup, mixing, neardup, quality, secrets, toxicity

LABELS = "doc_id long, quality int, toxic int"
BENCH = "item_id long, text string"


def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 1, 1), (6, None, None), (None, 1, 1), (5, 1, 0), (9, 1, 0)], LABELS)


def bench(spark, empty=False):
    rows = [] if empty else [(1, " ".join(f"w{i}" for i in range(40))), (2, None), (3, ""), (None, "words"), (4, "x"), (1, " ".join(f"w{i}" for i in range(40)))]
    return spark.createDataFrame(rows, BENCH)


OPERATORS = {
    "neardup": lambda s, d: neardup.components(d, 2),
    "linedup": lambda s, d: linedup.deduplicated(d),
    "quality": lambda s, d: quality.quality(d),
    "licenses": lambda s, d: licenses.scan(d),
    "language": lambda s, d: language.identify(d),
    "toxicity": lambda s, d: toxicity.score(d, labels(s)),
    "model": lambda s, d: languagemodel.score(d),
    "secrets": lambda s, d: secrets.scan(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, odd, nothing, name):
    rows = OPERATORS[name](spark, odd).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((r.doc_id is None, r.doc_id or 0) for r in odd.select("doc_id").collect())
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    check = globals().get(f"check_{name}")
    if check:
        check(by)
    assert OPERATORS[name](spark, nothing).collect() == []


def check_neardup(by):
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id and r.kept for i in (1, 2, 3) for r in by[i])
    assert {r.component_id for r in by[6]} == {5} and not by[6][0].kept
    assert all(r.component_id is None and r.kept for r in by[None])
    assert by[7][0].n_shingles == 1


def check_linedup(by):
    assert by[1][0].text is None and by[2][0].text == "" and by[3][0].text == " \t\n\x0b"
    # nulls come first, so the row without an id is the first place of its text
    assert all(r.text == "" and r.n_removed_words == 80 for r in by[5] if r.n_removed_lines)
    assert by[9][0].n_removed_lines == 0 and by[10][0].text == "before. after."


def check_quality(by):
    assert by[1][0].n_words == 0 and by[1][0].base_failed and not by[1][0].kept
    assert by[8][0].n_words == 6 and by[8][0].word_chars == 13
    assert by[9][0].kept and by[4][0].n_words == 4000 * 3 * 8


def check_language(by):
    assert all(r.lang_pred == "und" and r.score == 0 for i in (1, 2, 3) for r in by[i])
    assert all(r.held_out for r in by[None])


def check_toxicity(by):
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for rows in by.values() for r in rows)


def check_model(by):
    assert by[1][0].n_tokens == by[2][0].n_tokens == 1 and by[7][0].n_tokens == 2
    assert all(r.score < 0 and r.base_score < 0 for rows in by.values() for r in rows)


def check_secrets(by):
    assert by[1][0].spans == "" and by[1][0].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_leaks_on_odd_rows(spark, odd, nothing):
    found = decontaminate.contaminated(odd, bench(spark)).collect()
    assert {(r.doc_id, r.item_id) for r in found if r.item_id == 1} == {(9, 1), (10, 1)}
    assert decontaminate.contaminated(odd, bench(spark, True)).collect() == []
    assert decontaminate.contaminated(nothing, bench(spark)).collect() == []


def test_mixing_on_odd_rows(spark, odd, nothing):
    out = mixing.mix(odd, total=1000.0).select("doc_id", "source", "n_copies", "copy").collect()
    assert {r.source for r in out} == {"a", "b", None} and all(1 <= r.copy <= r.n_copies for r in out)
    assert mixing.mix(nothing).collect() == []


@pytest.mark.parametrize("name,step", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, odd, nothing, tmp_path, name, step):
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    out = step(spark, odd, str(tmp_path))
    rows = out.collect()
    assert out.columns[:5] == columns and (name == "source_mixing" or out.columns == columns)
    assert dict(out.dtypes)["n_chars"] == "bigint"
    assert step(spark, nothing, str(tmp_path)).collect() == []
    ids = {r.doc_id for r in rows}
    if name == "quality_rules":
        assert ids == {None, 5, 6, 9, 10}
    if name == "line_dedup":
        assert {1, 2, 3, 4, 6, 7, 8, 9, 10} <= ids
    if name == "near_dedup":
        assert 6 not in ids and {1, 2, 3, 5, 9} <= ids
    if name == "decontamination":
        assert not ids & {9, 10} and {1, 2, 3, 4, 5, 6, 7} <= ids


def test_extra_columns_do_not_reach_results(spark, odd):
    assert quality.clean(odd.select("doc_id", "text", "lang", "source", "n_chars")).where(F.col("doc_id") == 9).count() == 1


def test_near_dedup_keeps_what_is_judged_kept(spark):
    """One id with two texts, one of them a copy; and rows that repeat an id with its text."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (6, a), (6, c), (7, b), (7, b), (8, ""), (8, ""), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    judged = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.components(docs).collect() if r.doc_id in (5, 6))
    assert judged == [(5, 5, True), (6, 5, False), (6, 6, True)]
    got = sorted((r.doc_id or 0, r.text) for r in neardup.deduplicated(docs).collect())
    assert got == [(0, a), (5, a), (6, c), (7, b), (8, ""), (8, "")]
