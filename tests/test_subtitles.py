"""Readers and writers: known files, and round trips through every format."""

from cuelattice.sources import subtitles as sub
from cuelattice.sources import writers as wr

SRT = "1\n00:00:01,000 --> 00:00:02,500\nHello there\n你好\n\n2\n00:00:03.000 --> 00:00:04,000\n[Speaker 2] Second\nline\n\nbroken\nblock\n\n3\n01:00:00,5 --> 01:00:01,050\nLast\n"
VTT = "WEBVTT\n\nNOTE a note\n\n00:01.000 --> 00:02.500 align:start\n<c.x>Hello</c> there\n\n00:00:03.000 --> 00:00:04.000\nSecond\n"
ASS = "[Events]\nDialogue: 0,0:00:01.00,0:00:02.50,Default,,0,0,0,,{\\b1}你好\nDialogue: 0,0:00:01.00,0:00:02.50,Secondary,,0,0,0,,Hello, there\nDialogue: 0,0:00:03.00,0:00:04.00,Default,,0,0,0,,One\\Ntwo\n"


def files(spark, *contents):
    return spark.createDataFrame([(f"d{i}", c) for i, c in enumerate(contents)], "doc_id string, content string")


def rows(df):
    return [(r.doc_id, r.idx, r.start_ms, r.end_ms, r.text, r.translated, r.speaker) for r in df.orderBy("doc_id", "idx").collect()]


def test_srt(spark):
    assert rows(sub.parse_srt(files(spark, SRT, "", SRT.replace("\n", "\r\n")))) == [
        (d, i, *x)
        for d in ("d0", "d2")
        for i, x in enumerate([(1000, 2500, "Hello there", "你好", None), (3000, 4000, "Second\nline", None, "Speaker 2"), (3600500, 3601050, "Last", None, None)])
    ]


def test_vtt_and_ass(spark):
    assert [r[2:5] for r in rows(sub.parse_vtt(files(spark, VTT)))] == [(1000, 2500, "Hello there"), (3000, 4000, "Second")]
    assert [r[2:6] for r in rows(sub.parse_ass(files(spark, ASS)))] == [(1000, 2500, "Hello, there", "你好"), (3000, 4000, "One\ntwo", None)]


def test_round_trips(spark):
    cues = sub.parse_srt(files(spark, SRT))
    for name in ("srt", "vtt", "ass", "json"):
        back = sub.PARSERS[name](wr.FORMATS[name](cues))
        assert sorted(r[2:4] for r in rows(back)) == [(1000, 2500), (3000, 4000), (3600500, 3601050)], name
        assert rows(back)[0][4:6] in [("Hello there", "你好"), ("你好", "Hello there")], name
    assert wr.to_txt(cues, "only_translation").collect()[0].content == "你好\nSecond\nline\nLast\n"
    assert "- Second\n- line" in wr.to_srt(cues, speakers="dash").collect()[0].content


def test_files(spark, tmp_path):
    (tmp_path / "a.srt").write_bytes(b"\xef\xbb\xbf" + SRT.encode())
    (tmp_path / "b.vtt").write_text(VTT)
    (tmp_path / "c.srt").write_bytes("1\n00:00:01,000 --> 00:00:02,000\n你好\n".encode("gbk"))
    got = rows(sub.read_cues(spark, str(tmp_path)))
    assert [(r[0], r[1]) for r in got] == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1), ("c", 0)] and got[-1][4] == "你好"


def test_rttm(spark):
    lines = spark.createDataFrame([("SPEAKER rec 1 1.500 2.250 <NA> <NA> A <NA> <NA>",), ("",), ("SPKR-INFO x",)], "value string")
    turns = sub.parse_rttm(lines)
    assert [tuple(r) for r in turns.collect()] == [("rec", 1500, 3750, "A")]
    assert wr.rttm_lines(turns).collect()[0].value == "SPEAKER rec 1 1.500 2.250 <NA> <NA> A <NA> <NA>"
