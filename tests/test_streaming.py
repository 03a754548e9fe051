from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
from oracle import assert_same

from cladewright.plans import catalog
from cladewright.streaming import counts

SF = "/root/testdata/sf0.001"


def events_in_files(folder, files):
    """One file a batch: rows (minute, cell, barcode), each file an hour after the one before if its minutes say so."""
    for k, rows in enumerate(files):
        ts = pa.array([None if m is None else m * 60_000_000 for m, *_ in rows], pa.timestamp("us"))
        cells, barcodes = ([r[i] for r in rows] for i in (1, 2))
        pq.write_table(pa.table({"ts": ts, "user_id": pa.array(cells, pa.int64()), "event_type": pa.array(barcodes, pa.string())}), folder / f"events{k}.parquet")
    return str(folder)


FILES = [[(0, 1, "A"), (5, 1, "A"), (12, 2, None)], [(13, 1, "A"), (14, None, "B")], [(3, 1, "A"), (15, 2, None)]]


def test_last_counts_over_several_batches(spark, tmp_path):
    stream = counts.event_stream(spark, events_in_files(tmp_path, FILES), maxFilesPerTrigger="1")
    got = {(r.cell, r.intBC): r.n for r in counts.drained(counts.count_molecules(stream), ["cell", "intBC"]).collect()}
    assert got == dict(Counter((c, b) for rows in FILES for _, c, b in rows))


def test_windows_leave_out_what_is_older_than_the_watermark(spark, tmp_path):
    files = [[(0, 1, "A"), (9, 1, "A")], [(100, 1, "A"), (None, 1, "A")], [(101, 1, "A")], [(2, 1, "A"), (102, 1, "B")]]
    stream = counts.event_stream(spark, events_in_files(tmp_path, files), maxFilesPerTrigger="1")
    got = sorted(tuple(r) for r in counts.drained(counts.windowed_counts(stream), ["started", "intBC"]).collect())
    assert got == [("1970-01-01 00:00", "A", 2), ("1970-01-01 01:40", "A", 2), ("1970-01-01 01:40", "B", 1)]


def test_no_events(spark, tmp_path):
    stream = counts.event_stream(spark, events_in_files(tmp_path, [[]]))
    assert counts.drained(counts.count_molecules(stream), ["cell", "intBC"]).count() == 0


def test_registered_streams_equal_sql(spark):
    for name in ("streamed_molecule_counts", "streamed_window_counts"):
        assert_same(catalog.QUERIES[name](spark, SF), catalog.SQL[name], SF)
