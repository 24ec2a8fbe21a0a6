import struct

import pytest
from pyspark.sql import functions as F

from auralake.sources import scene

AXML = """<?xml version="1.0"?><ebuCoreMain><coreMetadata><format><audioFormatExtended version="x">
<audioProgramme audioProgrammeID="P1" audioProgrammeName="Main"><audioContentIDRef>C1</audioContentIDRef><audioContentIDRef>C9</audioContentIDRef></audioProgramme>
<audioContent audioContentID="C1" audioContentName="Music"><audioObjectIDRef>O1</audioObjectIDRef></audioContent>
<audioObject audioObjectID="O1" audioObjectName="Bed" start="00:00:01.00000"><audioObjectIDRef>O2</audioObjectIDRef></audioObject>
<audioObject audioObjectID="O2" audioObjectName="Kick" start="00:00:00.50000" duration="00:00:02.00000" importance="5"><gain>0.5</gain>
 <audioPackFormatIDRef>K1</audioPackFormatIDRef><audioTrackUIDRef>atu_1</audioTrackUIDRef><audioTrackUIDRef>ATU_2</audioTrackUIDRef></audioObject>
<audioPackFormat audioPackFormatID="K1" typeDefinition="Objects"><audioChannelFormatIDRef>F2</audioChannelFormatIDRef></audioPackFormat>
<audioChannelFormat audioChannelFormatID="F1" typeDefinition="Objects">
 <audioBlockFormat audioBlockFormatID="B1" rtime="00:00:00.00000" duration="00:00:01.00000"><position coordinate="azimuth">30</position><position coordinate="elevation">-5.5</position></audioBlockFormat>
 <audioBlockFormat audioBlockFormatID="B2" rtime="00:00:01.00000" duration="00:00:09.00000"><cartesian>1</cartesian><position coordinate="X">1</position><position coordinate="Y">0</position><jumpPosition interpolationLength="0.2">1</jumpPosition></audioBlockFormat>
 <audioBlockFormat audioBlockFormatID="B3"><gain>2</gain></audioBlockFormat></audioChannelFormat>
<audioChannelFormat audioChannelFormatID="F2" typeDefinition="DirectSpeakers"><audioBlockFormat><speakerLabel>M+030</speakerLabel></audioBlockFormat></audioChannelFormat>
<audioStreamFormat audioStreamFormatID="S1"><audioChannelFormatIDRef>F1</audioChannelFormatIDRef></audioStreamFormat>
<audioTrackFormat audioTrackFormatID="T1"><audioStreamFormatIDRef>S1</audioStreamFormatIDRef></audioTrackFormat>
<audioTrackUID UID="ATU_1"><audioTrackFormatIDRef>T1</audioTrackFormatIDRef></audioTrackUID>
</audioFormatExtended></format></coreMetadata></ebuCoreMain>"""


def test_scene_tables(spark):
    docs = scene.parsed(spark.createDataFrame([("s", 1000, AXML)], "scene_id string, sample_rate int, axml string")).cache()
    objs = {r["object_id"]: r for r in scene.started(scene.objects(docs)).collect()}
    assert objs["O1"]["start"] == 1000 and objs["O2"]["start"] == 1500 and objs["O2"]["gain"] == 0.5 and objs["O2"]["importance"] == 5
    assert [tuple(r) for r in scene.membership(docs).collect()] == [("s", "O1", "Music", "Main")]
    chna = spark.createDataFrame([("s", "ATU_1", 3)], "scene_id string, uid string, channel int")
    rows = sorted(scene.object_blocks(docs, chna).collect(), key=lambda r: (r["track_ord"], r["block_ord"]))
    assert [(r["uid"], r["channel"], r["channel_format"], r["start_sample"], r["end_sample"]) for r in rows] == [
        ("ATU_1", 3, "F1", 1500, 2500), ("ATU_1", 3, "F1", 2500, 3500), ("ATU_2", None, "F2", 1500, 3500),
    ]
    assert (rows[0]["azimuth"], rows[0]["elevation"]) == (30.0, -5.5) and rows[1]["x"] == 1.0 and rows[1]["jump"] and rows[2]["labels"] == ["M+030"]
    assert spark.range(1).select(scene.nanos(F.lit("01:00:00.5")).alias("n"), scene.nanos(F.lit("x")).alias("b")).head()["n"] == 3600_500_000_000


def bw64(text: bytes, uids: list[str], frames=100):
    chunk = lambda name, data: name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    chna = struct.pack("<HH", len(uids), len(uids)) + b"".join(struct.pack("<H12s14s11sx", k + 1, u.encode(), b"", b"") for k, u in enumerate(uids))
    body = b"WAVE" + chunk(b"fmt ", struct.pack("<HHIIHH", 1, 2, 1000, 4000, 4, 16)) + (chunk(b"axml", text) if text else b"") + chunk(b"chna", chna) + chunk(b"data", bytes(4 * frames))
    return b"BW64" + struct.pack("<I", len(body)) + body


def test_import_from_files(spark, tmp_path):
    text = AXML.replace('audioChannelFormatID="F2" typeDefinition="DirectSpeakers"', 'audioChannelFormatID="F2" typeDefinition="Matrix"')
    (tmp_path / "a.wav").write_bytes(bw64(AXML.encode(), ["ATU_9", "atu_1"]))
    (tmp_path / "b.wav").write_bytes(bw64(text.encode(), ["ATU_1"]))
    got = scene.import_scenes(spark, [str(tmp_path / "a.wav"), str(tmp_path / "b.wav")])
    assert [tuple(r) for r in got["files"].select("scene_id", "sample_rate", "channels", "frames").orderBy("scene_id").collect()] == [("a", 1000, 2, 100), ("b", 1000, 2, 100)]
    assert {(r["scene_id"], r["object_id"], r["start"]) for r in got["objects"].collect()} == {(s, o, t) for s in "ab" for o, t in (("O1", 1000), ("O2", 1500))}
    assert {(r["scene_id"], r["uid"], r["channel"]) for r in got["tracks"].collect()} == {("a", "ATU_1", 1), ("a", "ATU_2", None), ("b", "ATU_1", 0), ("b", "ATU_2", None)}
    assert got["blocks"].count() == 6 and got["membership"].count() == 2
    assert [tuple(r) for r in got["skipped"].collect()] == [("b", ["Matrix"])]
    (tmp_path / "c.wav").write_bytes(bw64(b"", []))
    with pytest.raises(Exception, match="no scene description in .*c.wav"):
        scene.import_scenes(spark, [str(tmp_path / "c.wav")])["files"].collect()
