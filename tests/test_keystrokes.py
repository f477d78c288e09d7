"""Streams of keys are stitched once: what reads them reads what was written."""

from riskloom.plans import sequences


def test_streams_are_stitched_once_and_read_from_the_shared_folder(spark):
    made = sequences.streams(spark, "/root/testdata/sf0.001")
    files = made.inputFiles()
    assert files and not [f for f in files if "events" in f] and made.where("size(dwell) < 20 or size(dwell) != size(flight)").count() == 0
