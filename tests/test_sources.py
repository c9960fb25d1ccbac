"""Audio formats, the data source and its commit, the packed index and the segmented index."""

import os
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from echomark.operators import landmarks, matching, packed
from echomark.sources import audio, files, formats
from echomark.sources.segments import SegmentedIndex


def wav(tag, bits, channels, fs, raw, extensible=False):
    body = struct.pack("<HHIIHH", 0xFFFE if extensible else tag, channels, fs, fs * channels * bits // 8, channels * bits // 8, bits)
    if extensible:
        body += struct.pack("<HHIH", 22, bits, 3, tag) + b"\0" * 14
    odd = b"LIST\x03\0\0\0abc\0"  # a chunk of odd size is padded
    return b"RIFF" + struct.pack("<I", 0) + b"WAVEfmt " + struct.pack("<I", len(body)) + body + odd + b"data" + struct.pack("<I", len(raw)) + raw


def aiff(bits, channels, fs, raw, kind=None):
    power = int(np.floor(np.log2(fs)))
    rate = struct.pack(">HQ", 16383 + power, int(fs * 2.0 ** (63 - power)))
    n = len(raw) // (channels * max(1, bits // 8))
    common = struct.pack(">hIh", channels, n, bits) + rate + ((kind + b"\0\0") if kind else b"")
    return b"FORM" + struct.pack(">I", 0) + (b"AIFC" if kind else b"AIFF") + b"COMM" + struct.pack(">I", len(common)) + common + b"SSND" + struct.pack(">III", len(raw) + 8, 0, 0) + raw


def au(code, channels, fs, raw, size=None):
    return b".snd" + struct.pack(">5I", 28, len(raw) if size is None else size, code, fs, channels) + b"note" + raw


@pytest.fixture(scope="module")
def x():
    return np.round(np.random.default_rng(4).uniform(-0.99, 0.99, (300, 2)) * 64) / 64  # whole steps of every integer width


def ints(x, bits, big):
    y = np.round(x * (1 << (bits - 1))).astype(np.int64).reshape(-1)
    if bits == 24:
        b = y.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3]
        return (b[:, ::-1] if big else b).tobytes()
    return y.astype(f"{'>' if big else '<'}i{bits // 8}").tobytes()


def test_every_format_gives_the_same_samples(x):
    made = {
        "u8": wav(1, 8, 2, 44100, (np.round(x * 128) + 128).astype(np.uint8).tobytes()),
        **{f"w{b}": wav(1, b, 2, 44100, ints(x, b, False), b == 24) for b in (16, 24, 32)},
        "wf32": wav(3, 32, 2, 44100, x.astype("<f4").tobytes(), True),
        "wf64": wav(3, 64, 2, 44100, x.astype("<f8").tobytes()),
        **{f"a{b}": aiff(b, 2, 44100, ints(x, b, True)) for b in (8, 16, 24, 32)},
        "sowt": aiff(16, 2, 44100, ints(x, 16, False), b"sowt"),
        "fl32": aiff(32, 2, 44100, x.astype(">f4").tobytes(), b"fl32"),
        "fl64": aiff(64, 2, 44100, x.astype(">f8").tobytes(), b"FL64"),
        **{f"au{c}": au(c, 2, 44100, ints(x, b, True)) for c, b in ((2, 8), (3, 16), (4, 24), (5, 32))},
        "au6": au(6, 2, 44100, x.astype(">f4").tobytes(), 0xFFFFFFFF),
        "au7": au(7, 2, 44100, x.astype(">f8").tobytes()),
    }
    for name, content in made.items():
        got, of = formats.decode(content)
        assert np.array_equal(got, x.mean(axis=1)), name
        assert (of.fs, of.channels, of.n_samples) == (44100, 2, 300), name
        with pytest.raises(formats.AudioError, match="2 channels and mono is off"):
            formats.decode(content, mono=False)


def test_companding_laws():
    """Values of the two laws at the ends of their scales and at their smallest steps."""
    u, a = formats.companded("ulaw"), formats.companded("alaw")
    assert (u[0x00], u[0x80], u[0xFF], u[0x7F], u[0xFE]) == (-32124, 32124, 0, 0, 8)
    assert (a[0x2A], a[0xAA], a[0xD5], a[0x55], a[0xD4]) == (-32256, 32256, 8, -8, 24)
    assert len(set(u.tolist())) == 255 and len(set(a.tolist())) == 256
    raw = bytes(range(256))
    for content, law in ((wav(7, 8, 1, 8000, raw), u), (au(1, 1, 8000, raw), u), (aiff(8, 1, 8000, raw, b"ulaw"), u), (wav(6, 8, 1, 8000, raw), a), (au(27, 1, 8000, raw), a), (aiff(8, 1, 8000, raw, b"alaw"), a)):
        assert np.array_equal(formats.decode(content, mono=False)[0] * 32768, law)


@pytest.mark.parametrize("content, why", [(b"", "neither"), (b"RIFF\0\0\0\0WAVE", "no samples"), (wav(1, 16, 1, 8000, b""), "no samples"), (wav(2, 4, 1, 8000, b"abcd"), "not supported"), (wav(1, 12, 1, 8000, b"abcd"), "not supported"), (b".snd\0\0", "ends inside"), (au(9, 1, 8000, b"abcd"), "not supported"), (wav(1, 16, 0, 8000, b"abcd"), "no channels")])
def test_what_is_no_audio_says_why(content, why):
    with pytest.raises(formats.AudioError, match=why):
        formats.decode(content)


@pytest.fixture
def folder(tmp_path, x):
    own = tmp_path / "lib"
    (own / "sub").mkdir(parents=True)
    for name, content in {"a.wav": wav(1, 16, 2, 8000, ints(x, 16, False)), "sub/b.AIFF": aiff(16, 1, 22050, ints(x[:, :1], 16, True)), "sub/c.au": au(1, 1, 8000, bytes(range(200))), "bad.wav": b"junk", ".hidden.wav": b"junk", "notes.txt": b"text"}.items():
        (own / name).write_bytes(content)
    return own


def test_source_reads_what_the_decoder_reads(spark, folder):
    files.register(spark)
    read = spark.read.format("audio").option("onError", "row")
    got = {os.path.basename(r["path"]): r for r in read.load(str(folder)).collect()}
    assert set(got) == {"a.wav", "b.AIFF", "c.au", "bad.wav"} and got["bad.wav"]["message"] == "neither WAV nor AIFF nor AU" and got["bad.wav"]["samples"] is None
    for name in ("a.wav", "sub/b.AIFF", "sub/c.au"):
        r, content = got[os.path.basename(name)], (folder / name).read_bytes()
        want, fs, channels = audio.decode_wav(content)
        assert r["samples"] == want.tolist() and (r["fs"], r["n_channels"], r["n_samples"], r["bytes"], r["message"]) == (fs, channels, len(want), len(content), "")
    heads = {os.path.basename(r["path"]): r for r in read.option("samples", "false").load(str(folder)).collect()}
    assert all(heads[k]["samples"] is None and heads[k]["sha256"] == got[k]["sha256"] and heads[k]["n_samples"] == got[k]["n_samples"] for k in got)
    mono = {os.path.basename(r["path"]): r["message"] for r in read.option("mono", "false").load(str(folder)).collect()}
    assert "2 channels" in mono["a.wav"] and mono["c.au"] == ""
    with pytest.raises(Exception, match="neither WAV"):
        spark.read.format("audio").load(str(folder)).collect()
    with pytest.raises(Exception, match="no such file or folder"):
        spark.read.format("audio").load(str(folder / "none")).collect()


def test_source_prunes_files_before_it_opens_them(spark, folder):
    """bad.wav would be an error if it were opened."""
    files.register(spark)
    rows = spark.read.format("audio").load(str(folder))
    names = lambda where: sorted(os.path.basename(r["path"]) for r in rows.where(where).select("path").collect())
    assert names(f"startswith(path, '{folder}/sub/')") == ["b.AIFF", "c.au"] and names("path like '%.au'") == ["c.au"]
    assert names(f"path in ('{folder}/a.wav', '{folder}/sub/c.au')") == ["a.wav", "c.au"] and names("bytes > 100 and path like '%a%' and n_channels = 2") == ["a.wav"]
    reader = files.AudioReader({"path": str(folder), "partitionBytes": "1"})
    assert [len(p.rows) for p in reader.partitions()] == [1, 1, 1, 1]


def clips(spark, n=5):
    return spark.range(n).select(F.format_string("take/%d.wav", "id").alias("name"), F.expr("transform(sequence(1, 400), k -> sin(k * (id + 1) / 7D) / 2)").alias("samples"), F.lit(8000).alias("fs"), "id")


def all_files(root):
    return sorted(os.path.relpath(os.path.join(d, x), root) for d, _, names in os.walk(root) for x in names if not x.endswith(".crc"))


def test_written_files_come_back(spark, tmp_path):
    files.register(spark)
    at = f"{tmp_path}/out"
    clips(spark).repartition(3).write.format("audio").mode("append").save(at)
    assert all_files(at) == ["_SUCCESS", *(f"take/{k}.wav" for k in range(5))]
    with wave.open(f"{at}/take/3.wav") as w:
        assert (w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes()) == (8000, 1, 2, 400)
    got = {r["path"].rpartition("/")[2]: r["samples"] for r in spark.read.format("audio").load(at).collect()}
    for r in clips(spark).collect():
        assert np.abs(np.array(got[r["name"][5:]]) - r["samples"]).max() <= 1 / 65536
    with pytest.raises(Exception, match="is there already"):
        clips(spark, 7).write.format("audio").mode("append").save(at)
    assert len(all_files(at)) == 6
    clips(spark, 2).write.format("audio").mode("overwrite").save(at)
    assert all_files(at) == ["_SUCCESS", "take/0.wav", "take/1.wav"]


@pytest.mark.parametrize("bad", ["'../x.wav'", "'/x.wav'", "null", "'same.wav'", "'_x.wav'"])
def test_bad_names_leave_nothing(spark, tmp_path, bad):
    files.register(spark)
    rows = clips(spark).withColumn("name", F.when(F.col("id") > 2, F.expr(bad)).otherwise(F.col("name")))
    with pytest.raises(Exception, match="not a name|one name"):
        rows.repartition(4).write.format("audio").mode("append").save(f"{tmp_path}/out")
    assert all_files(tmp_path) == []


def test_a_failed_job_leaves_no_file_and_a_second_run_writes_each_once(spark, tmp_path):
    files.register(spark)
    at, flag = f"{tmp_path}/out", tmp_path / "flag"
    flag.write_text("")

    def once(batches):
        for b in batches:
            yield b
            if os.path.exists(flag) and 4 in b["id"].tolist():
                os.remove(flag)
                raise RuntimeError("lost")

    rows = clips(spark).repartition(3, "id").mapInPandas(once, "name string, samples array<double>, fs int, id long")
    with pytest.raises(Exception, match="lost"):
        rows.write.format("audio").mode("append").save(at)
    assert all_files(at) == []
    rows.write.format("audio").mode("append").save(at)
    assert all_files(at) == ["_SUCCESS", *(f"take/{k}.wav" for k in range(5))]


def test_what_a_lost_attempt_wrote_does_not_count(tmp_path):
    """The attempt of a lost executor wrote one of its files; the attempt after it reports both."""
    import pyarrow as pa

    writer = files.AudioWriter({"path": str(tmp_path)}, False)
    batch = pa.RecordBatch.from_pylist([{"name": f"{k}.wav", "samples": [0.1 * k] * 9, "fs": 8000} for k in range(2)])

    def lost():
        yield batch.slice(0, 1)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(lost())
    message = writer.write(iter([batch]))
    assert len(all_files(tmp_path)) == 4  # one of the lost attempt, two of the other, and the sign that the write goes on
    writer.commit([message, None])
    assert all_files(tmp_path) == ["0.wav", "1.wav", "_SUCCESS"]
    with pytest.raises(RuntimeError, match="aborted"):
        writer.write(iter([batch]))
    assert len(all_files(tmp_path)) == 3


# ---------------------------------------------------------------- index


@pytest.fixture(scope="module")
def index(spark):
    draw = np.random.default_rng(7)
    h = np.concatenate([draw.integers(0, 1 << 32, 3000), draw.integers(0, 40, 2000) * 99_999_937, np.full(900, (1 << 32) - 1)])
    rows = list(zip(h.tolist(), draw.integers(0, 60, len(h)).tolist(), draw.integers(0, 1 << 20, len(h)).tolist(), strict=True))
    postings = spark.createDataFrame(rows, "h long, song_id int, t1 int").repartition(3)
    asked = [(int(q), int(x), int(t)) for q, x, t in zip(draw.integers(0, 9, 500), draw.choice(np.append(h, draw.integers(0, 1 << 32, 500)), 500), draw.integers(0, 99, 500), strict=True)]
    songs = spark.createDataFrame([(k, "tag") for k in range(60)], "song_id int, cfg_tag string")
    return postings, spark.createDataFrame(asked + asked[:3], "query_id long, h long, t1 int"), songs


def sorted_rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("block", [None, 700, 90])
def test_packed_index_finds_the_same(index, block, monkeypatch):
    monkeypatch.setattr(packed, "HITS", 100)
    monkeypatch.setattr(packed, "QUERY_CHUNK", 50)
    postings, asked, songs = index
    blocks, bits = packed.pack(postings, songs, block)
    assert sorted_rows(packed.unpack(blocks)) == sorted_rows(postings)
    assert sorted_rows(packed.lookup_packed(asked, blocks, bits)) == sorted_rows(matching.lookup(asked, postings))
    s = packed.packed_stats(blocks).first()
    assert s["bytes"] == s["bytes_formula"] and s["n_postings"] == 5900
    rows = blocks.select("n_postings", "cfg_tag").collect()
    assert {r["cfg_tag"] for r in rows} == {"tag"} and (block is None) == (len(rows) == 1) and max(r["n_postings"] for r in rows) <= 3 * (block or 1 << 20)


def test_packed_index_of_nothing_and_of_one(index, spark):
    postings, asked, songs = index
    blocks, bits = packed.pack(postings.where("false"), songs)
    assert packed.lookup_packed(asked, blocks, bits).count() == 0
    one = spark.createDataFrame([(5, 1, 2)], "h long, song_id int, t1 int")
    blocks, bits = packed.pack(one, songs)
    assert sorted_rows(packed.lookup_packed(spark.createDataFrame([(1, 5, 9)], "query_id long, h long, t1 int"), blocks, bits)) == [(1, 1, 2, -7)]


@pytest.mark.parametrize("songs, why", [([], "no songs"), ([(1, "a"), (1, "a")], "repeat"), ([(1, "a"), (65536, "a")], "65536"), ([(-1, "a")], "-1"), ([(1, "a"), (2, "b")], "several"), ([(1, None)], "several")])
def test_packed_index_refuses(index, spark, songs, why):
    with pytest.raises(ValueError, match=why):
        packed.pack(index[0], spark.createDataFrame(songs, "song_id int, cfg_tag string"))


def test_segments_equal_an_index_built_anew(spark, index, tmp_path):
    postings, _, _ = index
    rows = spark.createDataFrame([(k, f"sha{k}", "tag") for k in range(60)], "song_id int, sha256 string, cfg_tag string")
    own = SegmentedIndex(spark, f"file://{tmp_path}/index", "tag")
    assert own.live().count() == 0 and own.stale(rows).count() == 60
    assert own.enrol(postings.where("song_id < 30"), rows.where("song_id < 30")) == 1
    assert sorted_rows(own.stale(rows).select("song_id")) == [(k,) for k in range(30, 60)]
    own.enrol(postings.where("song_id >= 30"), rows.where("song_id >= 30"))
    assert sorted_rows(own.live()) == sorted_rows(postings)
    own.retire(spark.createDataFrame([(3,), (4,), (3,), (999,)], "song_id int"))
    assert sorted_rows(own.live()) == sorted_rows(postings.where("song_id not in (3, 4)"))
    # 4 comes back with other postings, 5 is replaced while it is there
    new = postings.where("song_id in (4, 5)").withColumn("t1", F.col("t1") + 1)
    own.enrol(new, rows.where("song_id in (4, 5)").withColumn("sha256", F.lit("new")))
    want = sorted_rows(postings.where("song_id not in (3, 4, 5)").unionByName(new))
    assert sorted_rows(own.live()) == want
    assert own.compact() == 5 and sorted_rows(own.live()) == want
    assert sorted(os.listdir(tmp_path / "index" / "log")) == ["segment=5"] == sorted(os.listdir(tmp_path / "index" / "postings"))
    assert {r["song_id"]: r["sha256"] for r in own.songs().collect() if r["song_id"] in (3, 4, 6)} == {4: "new", 6: "sha6"}
    own.retire(rows.select("song_id"))
    assert own.live().count() == 0


def test_segments_hide_what_was_not_committed(spark, index, tmp_path):
    postings, _, _ = index
    rows = spark.createDataFrame([(k, "", "tag") for k in range(60)], "song_id int, sha256 string, cfg_tag string")
    own = SegmentedIndex(spark, f"file://{tmp_path}/index", "tag")
    own.enrol(postings.where("song_id < 10"), rows.where("song_id < 10"))
    postings.where("song_id = 20").write.parquet(f"{own.root}/postings/segment=2")  # an enrolment that stopped before its log
    assert sorted_rows(own.live()) == sorted_rows(postings.where("song_id < 10"))
    own.enrol(postings.where("song_id = 11"), rows.where("song_id = 11"))
    assert sorted_rows(own.live()) == sorted_rows(postings.where("song_id < 10 or song_id = 11"))
    for songs, posts, why in ((rows.where("false"), postings, "no songs"), (rows.unionByName(rows), postings, "repeat"), (rows.withColumn("cfg_tag", F.lit("x")), postings, "another configuration"), (rows.where("song_id = 1"), postings, "not enrolled with them")):
        with pytest.raises(ValueError, match=why):
            own.enrol(posts, songs)
    assert own.log().select("segment").distinct().count() == 2


def test_index_of_landmarks_packs(spark):
    hashes = spark.createDataFrame([(1, 10, 3), (2, 10, 4)], "clip long, h long, t1 int")
    blocks, _ = packed.pack(landmarks.build_index(hashes), spark.createDataFrame([(1, "t"), (2, "t")], "song_id int, cfg_tag string"))
    assert sorted_rows(packed.unpack(blocks)) == [(10, 1, 3), (10, 2, 4)]
