"""The tag set and the tags that token typing gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tag names and their ids, which must be kept.
TAG_IDS = {
    "w": 25, "i": 119, "s": 115, "r": 126, "Rg": 170, "ns": 113, "v": 103, "Vg": 150, "f": 135, "d": 124, "vd": 33, "ad": 164, "Dg": 161, "k": 159, "nt": 140,
    "j": 104, "p": 148, "c": 132, "q": 114, "Qg": 177, "n": 100, "vn": 127, "an": 163, "Ng": 111, "o": 137, "nz": 109, "h": 176, "b": 107, "Bg": 172, "nr": 108,
    "t": 101, "Tg": 158, "m": 102, "Mg": 167, "e": 20, "nx": 112, "l": 118, "a": 110, "Ag": 138, "y": 147, "Yg": 11, "u": 149, "Ug": 169, "z": 106, "UDF": 0,
    "ma": 30, "mc": 31, "mp": 32, "url": 40,
}
UDF, MA, MC, MP, URL, T, NX, M, W = 0, 30, 31, 32, 40, 101, 112, 102, 25
NONE = -1


def tagset(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TAG_IDS.items()), "tag string, tag_id int")
