"""A folder of subtitles as a report."""

from cuelattice.plans.reports import folder_report

SRT = "1\n00:00:01,000 --> 00:00:02,500\nHello there\n你好\n\n2\n00:00:02,520 --> 00:00:12,000\nSecond line\n（略）\n\n3\n00:00:11,000 --> 00:00:11,100\n[A] Much too long for so short a time\n"


def test_report(spark, tmp_path):
    (tmp_path / "a.srt").write_text(SRT)
    r = folder_report(spark, str(tmp_path)).collect()
    assert len(r) == 1
    got = r[0].asDict()
    assert (got["cues"], got["first_ms"], got["last_ms"], got["speakers"], got["units"]) == (3, 1000, 12000, 1, 12)
    assert {k: got[k] for k in ("bad_time", "fast", "close", "long", "missing", "note", "leak")} == {"bad_time": 1, "fast": 1, "close": 1, "long": 1, "missing": 1, "note": 1, "leak": 0}
