"""Journalled publication: stopped after each step, and with two writers."""

import pytest

from corvane.operators import journal as J
from corvane.operators import publish


class Stopped(Exception):
    pass


@pytest.fixture
def places(tmp_path):
    return str(tmp_path / "journal"), [str(tmp_path / "chunks"), str(tmp_path / "index")]


def tables(spark, roots, n):
    return {r: {"t": spark.range(n)} for r in roots}


def sizes(spark, roots):
    return [publish.read_published(spark, r, "t").count() for r in roots]


def test_stopping_after_any_step_leaves_all_or_none(spark, places):
    journal, roots = places
    J.publish_all(journal, tables(spark, roots, 1))
    assert sizes(spark, roots) == [1, 1] and J.recover_all(spark, journal) is None
    steps: list[str] = []
    for n in range(6):
        done = iter(range(n, -1, -1))

        def step(name, done=done):
            steps.append(name)
            if next(done) == 0:
                raise Stopped

        before = sizes(spark, roots)
        with pytest.raises(Stopped):
            J.publish_all(journal, tables(spark, roots, 10 + n), step=step)
        with pytest.raises(RuntimeError, match="another publication is open"):
            J.publish_all(journal, tables(spark, roots, 99))
        forward = steps[-1] in ("committed", "switched")
        assert J.recover_all(spark, journal) == ("forward" if forward else "back")
        assert sizes(spark, roots) == ([10 + n] * 2 if forward else before)
    assert steps[-6:] == ["opened", "written", "written", "committed", "switched", "switched"]
    J.publish_all(journal, tables(spark, roots, 7))
    assert sizes(spark, roots) == [7, 7]


def test_of_two_writers_the_later_is_refused(spark, places):
    journal, roots = places
    made_from = {r: publish.current(spark, r) for r in roots}
    J.publish_all(journal, tables(spark, roots, 1))
    with pytest.raises(RuntimeError, match="another writer"):
        J.publish_all(journal, tables(spark, roots, 2), expected=made_from)
    assert sizes(spark, roots) == [1, 1] and J.recover_all(spark, journal) is None
    with pytest.raises(ValueError, match="empty table"):
        J.publish_all(journal, {roots[0]: {"t": spark.range(0)}})
    assert J.recover_all(spark, journal) is None and sizes(spark, roots) == [1, 1]
    with pytest.raises(ValueError, match="nothing"):
        J.publish_all(journal, {})


def test_a_half_written_journal_goes_back(spark, places, tmp_path):
    journal, roots = places
    J.publish_all(journal, tables(spark, roots, 3))
    (tmp_path / "journal" / "OPEN").write_text('{"publi')
    for crc in (tmp_path / "journal").glob(".OPEN.crc"):
        crc.unlink()
    assert J.recover_all(spark, journal) == "back" and sizes(spark, roots) == [3, 3]
