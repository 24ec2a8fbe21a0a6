import json
import struct

import numpy as np
import pytest

from auralake.sources import pcm, policy, registry


def doc(**rules):
    return json.dumps({"schema": f"anyone.{policy.SCHEMA}", **rules})


def test_policy_is_strict(spark):
    text = doc(**{"global": {"gain": {"gain_db": -3}}, "objects": [{"name_glob": "k*", "importance_min": 2, "diffuse": {"enabled": False}}]})
    rows = policy.rules_table(spark, text).collect()
    assert [(r["rule_ord"], r["gain_gain_db"], r["name_glob"], r["diffuse_enabled"]) for r in rows] == [(-1, -3.0, None, None), (0, None, "k*", False)]
    nested = doc(objects=[{"all": True, "position": {"offset": {"azimuth": 10}}, "direct_speakers": {"lfe": True, "gain": {"mute": True}}}])
    (row,) = policy.rules_table(spark, nested).collect()
    assert (row["position_offset_azimuth"], row["direct_speakers_lfe"], row["direct_speakers_gain_mute"]) == (10.0, True, True)
    for bad in (
        "{", "[]", doc(extra=1), json.dumps({"schema": "x"}), json.dumps({}), doc(objects=[{"gain": {}}]), doc(objects=[{"nme": "x"}]), doc(objects=[{"id": ""}]),
        doc(objects=[{"all": True, "gain": {"scale": "1"}}]), doc(objects=[{"all": 1}]), doc(objects={}), doc(objects=[{"all": True, "gain": {"scale": -1}}]),
        doc(objects=[{"dialogue_id": 1.5}]), doc(objects=[{"all": True, "position": {"offset": 3}}]), doc(**{"global": {"all": True}}),
        '{"schema": "a.%s", "global": {"gain": {"scale": NaN}}}' % policy.SCHEMA,
    ):
        with pytest.raises(policy.PolicyError):
            policy.parse(bad)


def test_registry(spark):
    reg = registry.Registry()
    reg.register("mine", "Mine", [("A", 10, 0, False), ("S", 0, 0, True)])
    for bad in (("mine", [("A", 1, 1, False)]), ("x", []), ("y", [("S", 0, 0, True)]), ("z", [("A", float("nan"), 0, False)])):
        with pytest.raises(ValueError):
            reg.register(bad[0], "n", bad[1])
    got = {r["layout_id"]: (r["channels"], r["lfe"], r["is_3d"]) for r in registry.layout_summary(reg.speakers(spark)).collect()}
    assert got["9+10+3"] == (24, 2, True) and got["wav71"] == (8, 1, False) and got["mine"] == (2, 1, False) and len(got) == 10
    assert registry.output_layouts(spark).count() == 33 and registry.label_names(spark).count() == 34
    from pyspark.sql import functions as F

    names = spark.createDataFrame([("Atmos714",), ("",), ("7.1",), ("odd",)], "n string")
    assert [r[0] for r in names.select(registry.layout_id(F.col("n"))).collect()] == ["4+7+0", "0+2+0", "wav71", "odd"]


@pytest.mark.parametrize("bits,encoding,tol", [(32, "float", 0), (16, "int", 1e-4), (24, "int", 1e-6), (32, "int", 1e-6)])
def test_wave_round_trip(spark, tmp_path, bits, encoding, tol):
    pcm.register(spark)
    x = (np.arange(10_000)[:, None] * 1e-4 - 0.5 + np.arange(3) * 0.1).astype(np.float32)
    rows = [("sc", k, lo, min(4096, 10_000 - lo), 3, 48000, x[lo : lo + 4096].reshape(-1).tolist()) for k, lo in enumerate(range(0, 10_000, 4096))]
    df = spark.createDataFrame(rows, pcm.PCM_BLOCKS).repartition(3)
    df.write.format("pcm").mode("append").option("bits", bits).option("encoding", encoding).save(str(tmp_path / "out"))
    back = spark.read.format("pcm").option("block_frames", 1000).option("blocks_per_partition", 3).load(str(tmp_path / "out"))
    got = back.orderBy("start_frame").collect()
    assert [r["start_frame"] for r in got] == list(range(0, 10_000, 1000)) and {r["channels"] for r in got} == {3}
    assert np.concatenate([r["samples"] for r in got]) == pytest.approx(x.reshape(-1), abs=tol + 1e-9)
    part = spark.read.format("pcm").option("block_frames", 1000).option("start_frame", 4000).option("end_frame", 6000).load(str(tmp_path / "out"))
    assert sorted(r["start_frame"] for r in part.collect()) == [4000, 5000]
    inside = spark.read.format("pcm").option("block_frames", 1000).option("start_frame", 4321).option("end_frame", 6123).load(str(tmp_path / "out"))
    rows = inside.orderBy("start_frame").collect()
    assert [(r["start_frame"], r["frames"]) for r in rows] == [(4321, 679), (5000, 1000), (6000, 123)]
    assert np.concatenate([r["samples"] for r in rows]) == pytest.approx(x[4321:6123].reshape(-1), abs=tol + 1e-9)
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["sc.wav"]


def test_caf_round_trip(spark, tmp_path):
    pcm.register(spark)
    x = (np.arange(3000) * 1e-4 - 0.1).astype(np.float32)
    rows = [("sc", k, lo, 1000, 1, 44100, x[lo : lo + 1000].tolist()) for k, lo in enumerate(range(0, 3000, 1000))]
    out = spark.createDataFrame(rows, pcm.PCM_BLOCKS).write.format("pcm").mode("append").option("container", "caf")
    out.save(str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == ["sc.caf"]
    got = spark.read.format("pcm").load(str(tmp_path)).orderBy("start_frame").collect()
    assert np.concatenate([r["samples"] for r in got]) == pytest.approx(x) and got[0]["sample_rate"] == 44100


def test_caf_and_metadata_chunks(spark, tmp_path):
    pcm.register(spark)
    x = np.arange(12, dtype="<f4")
    desc = struct.pack(">d4sIIIII", 44100.0, b"lpcm", 3, 8, 1, 2, 32)
    caf = b"caff" + struct.pack(">HH", 1, 0) + b"free" + struct.pack(">q", 3) + b"abc" + b"desc" + struct.pack(">q", 32) + desc
    (tmp_path / "a.caf").write_bytes(caf + b"data" + struct.pack(">q", -1) + b"\0\0\0\0" + x.tobytes())
    row = spark.read.format("pcm").load(str(tmp_path / "a.caf")).head()
    assert row["samples"] == x.tolist() and row["sample_rate"] == 44100 and row["channels"] == 2
    chna = struct.pack("<HH", 2, 2) + struct.pack("<H12s14s11sx", 1, b"atu_1  \0", b"", b"") + struct.pack("<H12s14s11sx", 2, b"ATU_1", b"", b"")
    body = b"WAVE" + b"axml" + struct.pack("<I", 3) + b"<a>\0" + b"chna" + struct.pack("<I", len(chna)) + chna
    (tmp_path / "b.wav").write_bytes(b"BW64" + struct.pack("<I", len(body)) + body)
    assert pcm.text_chunk(str(tmp_path / "b.wav")) == b"<a>" and pcm.channel_uids(str(tmp_path / "b.wav")) == {"ATU_1": 1}
    with pytest.raises(ValueError):
        list(pcm.chunks(open(tmp_path / "a.caf", "rb"), 100))
