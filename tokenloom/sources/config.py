"""Settings of a segmenter: defaults, a file of `key = value` lines over them, and typed getters."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators.segment import Options
from tokenloom.sources import text as sources

#: Names the file of settings where none is given.
ENVIRONMENT = "TOKENLOOM_CONF"
DEFAULTS = {"DICT_ROOT": "dict", "CORE_DICT_NAME": "core", "PERSON_DICT_NAME": "person", "INVS_DICT_NAME": "inverse", "USER_DICT_DIR": "", "IS_LOAD_INVS": "false"}


@dataclass
class Config:
    """Strings by key; the getters read a leading number, and take true and TRUE for true."""

    values: dict[str, str] = field(default_factory=lambda: dict(DEFAULTS))

    def text(self, key: str, default: str = "") -> str:
        return self.values.get(key, default)

    def integer(self, key: str, default: int = 0) -> int:
        if key not in self.values:
            return default
        m = re.match(r"\s*([+-]?\d+)", self.values[key])
        return int(m[1]) if m else 0

    def real(self, key: str, default: float = 0.0) -> float:
        if key not in self.values:
            return default
        m = re.match(r"\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", self.values[key])
        return float(m[1]) if m else 0.0

    def flag(self, key: str, default: bool = False) -> bool:
        return self.values[key] in ("true", "TRUE") if key in self.values else default

    def options(self) -> Options:
        """Options of the segmenters: SPLIT_LEN, MAX_LEN, COMPAT, EXTENDED_TIME and TOTAL, each as it is by default where it is not set."""
        base = Options()
        total = self.integer("TOTAL") if "TOTAL" in self.values else base.total
        return Options(self.integer("SPLIT_LEN", base.split_len), self.integer("MAX_LEN", base.max_len), self.flag("COMPAT", base.compat), self.flag("EXTENDED_TIME", base.extended_time), total)


def of_settings(settings: DataFrame) -> Config:
    """DEFAULTS with the rows of settings (key, value) over them; a settings table is a few rows."""
    return Config(DEFAULTS | {r["key"]: r["value"] for r in settings.select("key", "value").collect()})


def load(spark: SparkSession, path: str | None = None) -> Config:
    """DEFAULTS with the settings of a file over them: path, else what the environment names, else none."""
    path = path or os.environ.get(ENVIRONMENT)
    if not path:
        return Config()
    # one row, so that the lines keep their order; of a repeated key the last holds
    lines = spark.read.option("wholetext", "true").text(path).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "value"))
    config = of_settings(sources.settings(lines, order_by="at"))
    config.values["CONF_PATH"] = path
    return config
