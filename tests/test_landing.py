"""Files that the checks land for the readers."""

import glob

import __spark_entry__ as entry
from fleetlens.session import shared_folder


def test_landed_pods_are_compressed(spark):
    def landed():
        return set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/landing-pods-*/part-*"))

    before = landed()
    assert entry.queries()["scan_pods"](spark, "/root/testdata/sf0.001").count() == 1500
    assert landed() - before and all(f.endswith(".json.gz") for f in landed() - before)
