"""Staged publication: gates, swaps and repeats after a crash."""

import pytest

from millrace.sources import publication as pub


def frames(spark, programs, offerings):
    return {"programs": spark.createDataFrame(programs, "program int, name string"), "offerings": spark.createDataFrame(offerings, "offering int, program int")}


CHECKS = {"orphans": pub.orphans("offerings", "program", "programs", "program"), "repeats": pub.repeated("programs", "program"), "blanks": pub.lacking("programs", "name")}


def seen(site):
    return {n: sorted(map(tuple, df.collect())) for n, df in site.tables().items()}


def test_a_failing_gate_leaves_the_old_version_readable(spark, tmp_path):
    site = pub.Publication(spark, f"file://{tmp_path}/site")
    assert site.manifest() is None and site.tables() == {}
    assert site.publish("v1", frames(spark, [(1, "a")], [(10, 1), (11, None)]), CHECKS).current
    first = seen(site)
    assert first == {"programs": [(1, "a")], "offerings": [(10, 1), (11, None)]} or first["programs"] == [(1, "a")]
    bad = site.publish("v2", frames(spark, [(1, "a"), (1, "b"), (2, None)], [(10, 1), (12, 9), (13, 9)]), CHECKS)
    assert (bad.current, bad.findings) == (False, {"orphans": 2, "repeats": 1, "blanks": 1})
    assert seen(site) == first and site.manifest()["version"] == "v1"
    mended = site.publish("v2", frames(spark, [(1, "a"), (2, "b")], [(10, 1), (12, 2)]), CHECKS)
    assert mended.current and seen(site) == {"programs": [(1, "a"), (2, "b")], "offerings": [(10, 1), (12, 2)]}
    assert [len(df.collect()) for df in site.staged("v1", ["programs", "offerings"]).values()] == [1, 2]  # the old version is still there


def test_a_crash_changes_nothing_and_can_be_repeated(spark, tmp_path, monkeypatch):
    site = pub.Publication(spark, f"file://{tmp_path}/site")
    site.publish("v1", frames(spark, [(1, "a")], []), CHECKS)

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(pub.Publication, "_swap", crash)
        with pytest.raises(OSError):
            site.publish("v2", frames(spark, [(2, "b")], []), CHECKS)
    assert seen(site)["programs"] == [(1, "a")]
    assert site.publish("v2", frames(spark, [(2, "b")], []), CHECKS).current and seen(site)["programs"] == [(2, "b")]
    assert site.publish("v2", frames(spark, [(3, "c")], []), CHECKS) == pub.Report("v2", True) and seen(site)["programs"] == [(2, "b")]
    with pytest.raises(ValueError):
        site.stage("v2", frames(spark, [], []))
