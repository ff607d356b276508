import pytest

from ledgerweave.operators import recovery
from ledgerweave.sources import log_files as lf


def record(lsn, **more):
    return {"type": "transfer", "lsn": lsn, "committed_at": 5, "key": f"k{lsn}é<", "fingerprint": [lsn % 256] * 32, "request": {"Amount": lsn}, "result": {"CommitLSN": lsn}} | more


def test_codec():
    data = lf.encode_record(record(7)) + lf.encode_record(record(8), 1)
    version, r, at = lf.decode_record(data)
    assert (version, r["lsn"], r["key"]) == (2, 7, "k7é<")
    assert lf.decode_record(data, at)[0] == 1
    for cut in (0, 1, 4, 15, 16, 31, 127, at - 1):
        assert lf.decode_record(data[:at][:cut]) is None
    for k in (0, 5, 13, 40):
        bad = bytearray(data)
        bad[k] ^= 0x40
        with pytest.raises(lf.Corrupt):
            lf.decode_record(bytes(bad))
    with pytest.raises(lf.Corrupt):
        lf.decode_record(lf.encode_record(record(0)))
    box = lf.encode_envelope(lf.CHECKPOINT_MAGIC, {"base_lsn": 3})
    assert lf.decode_envelope(lf.CHECKPOINT_MAGIC, box) == {"base_lsn": 3}
    for bad in (box[:-1], box + b"x", box[:3], b"X" + box[1:]):
        with pytest.raises(lf.Corrupt):
            lf.decode_envelope(lf.CHECKPOINT_MAGIC, bad)
    with pytest.raises(lf.Corrupt):
        lf.decode_envelope(lf.MANIFEST_MAGIC, box)


def test_read_log_with_torn_and_damaged_ends(spark, tmp_path):
    names = lf.write_segments(str(tmp_path), [record(k) for k in range(1, 21)], 900)
    assert len(names) > 2
    got = lf.read_log(spark, str(tmp_path)).orderBy("lsn").collect()
    assert [r.lsn for r in got] == list(range(1, 21)) and got[3].fingerprint == "04" * 32 and got[3].request == '{"Amount":4}'
    assert lf.read_log(spark, str(tmp_path), 15).count() == 5
    last = open(names[-1], "rb").read()
    n = len(lf.read_log(spark, str(tmp_path)).where(f"segment = {len(names)}").collect())
    for cut in (1, 4, 15, 16, 31):
        open(names[-1], "wb").write(last + lf.encode_record(record(99))[:cut])
        assert lf.read_log(spark, str(tmp_path)).count() == 20 and n
    open(names[-1], "wb").write(last)
    whole = open(names[0], "rb").read()
    for bad in (whole[:-3], whole[:20] + b"\0" + whole[21:]):
        open(names[0], "wb").write(bad)
        with pytest.raises(Exception, match="CORRUPT"):
            lf.read_log(spark, str(tmp_path)).collect()
    open(names[0], "wb").write(whole)
    (tmp_path / "7.wal").write_bytes(b"x")  # an empty file is no segment to Spark
    with pytest.raises(Exception, match="CORRUPT"):
        lf.read_log(spark, str(tmp_path)).collect()
    (tmp_path / "7.wal").unlink()
    lf.write_segments(str(tmp_path), [record(4)], 900, first_segment=50)
    with pytest.raises(Exception, match="CORRUPT"):
        lf.read_log(spark, str(tmp_path)).collect()


def test_log_breaks_and_rotation(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 6), (2, 2, 9), (3, 1, 8)], "segment long, position long, lsn long")
    assert sorted(r.lsn for r in recovery.log_breaks(df).collect()) == [6, 8]
    assert recovery.log_breaks(df, 8).count() == 0
    sizes = spark.createDataFrame([("w", k, s) for k, s in enumerate([50, 60, 10, 200, 1, 99])], "writer string, lsn long, size long")
    assert [r.segment for r in recovery.segments(sizes, 100).orderBy("lsn").collect()] == [1, 2, 2, 3, 4, 4]
