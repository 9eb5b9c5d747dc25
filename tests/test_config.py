import pytest
from pyspark.sql import functions as F

from veilframe.config import DEFAULT, from_env, read_env
from veilframe.functions.text import with_psm


def test_env_files():
    text = """
# a comment
export A=one # after it
B = "two # kept \\" quote"
C='three # kept'
D=
E=#none
F=x#y
no setting here
A=last
"""
    env = {"C": "own"}
    assert read_env(text, env) == {"A": "last", "B": 'two # kept " quote', "C": "three # kept", "D": "", "E": "", "F": "x#y"}
    assert env == {"A": "last", "B": 'two # kept " quote', "C": "own", "D": "", "E": "", "F": "x#y"}


def test_settings_from_env():
    got = from_env({"VEILFRAME_CHUNK_SIZE": "500", "VEILFRAME_TIGHTEN": "yes", "VEILFRAME_MATCH_IOU": "0.7", "OTHER": "1"})
    assert (got.chunk_size, got.tighten, got.match_iou, got.mask) == (500, True, 0.7, DEFAULT.mask)
    for bad in ({"VEILFRAME_CHUNK_SIZE": "many"}, {"VEILFRAME_TIGHTEN": "perhaps"}):
        with pytest.raises(ValueError):
            from_env(bad)


def test_page_segmentation_mode(spark):
    rows = spark.createDataFrame([("--oem 3 --psm 6 -l eng",), ("--oem 3",), ("--psm=11",), ("",), (None,)], "v string")
    got = [r[0] for r in rows.select(with_psm("v", 4)).collect()]
    assert got == ["--oem 3 --psm 4 -l eng", "--oem 3 --psm 4", "--psm 4", "--psm 4", "--psm 4"]
